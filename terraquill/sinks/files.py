"""PNG, JSON and report files, one by one, in any file system that pyarrow knows (local, hdfs://, s3://, gs://).

Writing is idempotent: a file is written under a name of its own in its folder, then moved to its name. Executors write the
images' files themselves, so the folder must be one that all of them reach.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from terraquill.functions import expr


def put(path: str, data: bytes) -> None:
    """Makes the folder where it is missing."""
    system, at = _at(path)
    folder, _, name = at.rpartition("/")
    system.create_dir(folder or ".", recursive=True)
    own = f"{folder or '.'}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as f:
        f.write(data)
    system.move(own, at)


def there(path: str) -> bool:
    system, at = _at(path)
    return system.get_file_info(at).type != fs.FileType.NotFound


def _at(path: str) -> tuple[fs.FileSystem, str]:
    local = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in local else (fs.LocalFileSystem(), local)


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task's files."""

    folder: str


class TextFiles(DataSource):
    """Spark's writer of one file for each row (name, text) into the folder `path`, with a commit.

    Tasks write into a hidden folder beside the files, each attempt into its own. Only when all tasks have succeeded are the
    files of the attempts that did moved to their names, so a job that fails leaves nothing that can be seen (tasks that are
    still being stopped then may leave a hidden folder); files of the same names are replaced.
    """

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _TextFilesWriter(self.options["path"].rstrip("/"))


class _TextFilesWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.hidden = folder, f"{folder}/.writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        own = f"{self.hidden}/{TaskContext.get().taskAttemptId()}"
        system, at = _at(own)
        system.create_dir(at, recursive=True)
        for name, text in iterator:
            with system.open_output_stream(f"{at}/{name}") as f:
                f.write(text.encode())
        return Written(own)

    def commit(self, messages: list) -> None:
        system, to = _at(self.folder)

        def move(path: str) -> None:
            system.move(path, f"{to}/{path.rpartition('/')[2]}")

        with ThreadPoolExecutor(16) as pool:
            for m in messages:
                if m is not None:
                    list(pool.map(move, (f.path for f in system.get_file_info(fs.FileSelector(_at(m.folder)[1])))))
        self.abort(messages)

    def abort(self, messages: list) -> None:
        system, at = _at(self.hidden)
        if system.get_file_info(at).type == fs.FileType.Directory:
            system.delete_dir(at)


def write_metadata(made: DataFrame, folder: str) -> None:
    """One pretty-printed JSON file for each row (image_name, metadata), all of them or none."""

    def pretty(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"name": pdf["image_name"] + ".json", "text": [json.dumps(json.loads(t), indent=2) for t in pdf["text"]]})

    made.sparkSession.dataSource.register(TextFiles)
    rows = made.select("image_name", F.to_json("metadata").alias("text")).mapInPandas(pretty, "name string, text string")
    rows.write.format(TextFiles.name()).mode("append").option("path", folder).save()


def report_name(now: datetime | None = None) -> str:
    return f"benchmark_results_{now or datetime.now():%Y%m%d_%H%M%S}.json"


def benchmark_results(seen: DataFrame, failed: DataFrame) -> DataFrame:
    """(model_key, result): a JSON text for each model; of those in failed (model_key, error) only their error.

    A model's observations become arrays in image order; a benchmark has few images for each model.
    """
    row = F.struct("image_id", "caption", "inference_time", F.struct("length", "quantification", "spatial", "structures", "overall").alias("quality"), "keyword_count")
    each = seen.join(failed.select("model_key"), "model_key", "left_anti").groupBy("model_key").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    column = lambda name, c: F.transform("rows", lambda x: x[c]).alias(name)
    lists = F.struct(column("captions", "caption"), column("inference_times", "inference_time"), column("quality_scores", "quality"), column("aerial_keywords", "keyword_count"))
    good = each.select("model_key", F.to_json(lists).alias("result"))
    return good.unionByName(failed.select("model_key", F.to_json(F.struct("error")).alias("result")))


def write_report(results: DataFrame, summarised: DataFrame, folder: str, name: str | None = None) -> str:
    """Writes {results, summary} as one JSON file and returns its path. A benchmark's models are a fixed few."""
    by = {r["model_key"]: json.loads(r["result"]) for r in results.collect()}
    summary = [r.asDict() for r in summarised.orderBy("model_ord").drop("model_ord").collect()]
    for r in summary:
        by[r["model"]] = {"model_name": r["model_name"], "memory_gb": r["memory_gb"]} | by[r["model"]]
    path = f"{folder.rstrip('/')}/{name or report_name()}"
    put(path, json.dumps({"results": by, "summary": summary}, indent=2).encode())
    return path


def console(ranked: DataFrame, failed: DataFrame) -> list[str]:
    """The lines of a benchmark's report: failures, averages, ranking and the best model."""
    n = lambda c, places: expr.fixed(F.col(c), places).alias(c)
    rows = ranked.orderBy("rank").select("rank", "model", "model_name", n("memory_gb", 2), n("avg_time_s", 2), n("avg_quality", 3), n("avg_keywords", 1), n("combined_score", 3)).collect()
    out = [f"{r['model_key']}: FAILED - {r['error']}" for r in failed.orderBy("model_key").collect()]
    for r in rows:
        out += [f"{r['model']}: {r['model_name']}, GPU memory {r['memory_gb']} GB, {r['avg_time_s']} s, quality {r['avg_quality']}, aerial keywords {r['avg_keywords']}"]
    out += [f"{r['rank']}. {r['model']} (combined score {r['combined_score']})" for r in rows]
    return out + [f"best model: {r['model']} ({r['model_name']})" for r in rows[:1]]


def totals(results: DataFrame) -> str:
    """`successful / all` of a run's rows."""
    r = results.agg(F.coalesce(F.sum(F.col("ok").cast("long")), F.lit(0)).alias("good"), F.count(F.lit(1)).alias("n")).first()
    return f"{r['good']}/{r['n']}"
