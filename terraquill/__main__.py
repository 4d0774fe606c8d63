"""python -m terraquill pipeline | benchmark: runs over INPUT_DIR, writes below OUTPUT_DIR."""

import sys

from pyspark.sql import SparkSession

from terraquill.config import Config
from terraquill.plans import pipeline
from terraquill.sinks import files


def main(what: str) -> None:
    config = Config()
    spark = SparkSession.builder.appName(f"terraquill {what}").getOrCreate()
    if what == "pipeline":
        rows = pipeline.run(spark, config.input_dir, f"{config.output_dir}/work", root=config.output_dir, limit=config.max_images)
        print(f"{files.totals(rows)} images")
    elif what == "benchmark":
        done = pipeline.benchmark(spark, config.input_dir, f"{config.benchmark_dir}/work", limit=config.test_images)
        print("\n".join(done.console()))
        print(done.write(config.benchmark_dir))
    else:
        sys.exit(__doc__)


if __name__ == "__main__":
    main(*sys.argv[1:2] or [""])
