"""Tables stored by key: rows of a key lie in one bucket, so joins and groups by it need no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_key(df: DataFrame, key: str, folder: str, buckets: int) -> DataFrame:
    """df as read from a table of `buckets` buckets by `key`, sorted in each, below `folder`.

    The number of buckets is that of the join's tasks: rows / buckets should fit into one. A key with too many rows for a
    task is no key to store by.
    """
    name = f"stored_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, F.col(key))  # a file for each bucket, not for each bucket and task
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", f"{folder.rstrip('/')}/{name}").saveAsTable(name)
    return df.sparkSession.table(name)

