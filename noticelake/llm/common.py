"""What the operators of this subpackage share: table access, the shared work folder, word hashing."""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: a key with more than one in so many of all rows is hot and dealt over several tasks
HOT_SHARE = 1000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares.

    The folder is the one in spark.checkpoint.dir. Only where that is unset on a local master (tests, one machine) a
    temporary folder is made and remembered in the session; on a cluster executors would not share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("noticelake.work.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="spark-noticelake-")
            spark.conf.set("noticelake.work.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes the folder of a materialized table that nothing reads any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_spread(rows: DataFrame, facts: DataFrame, key: str | list[str], size: str, by: list[str], how: str = "inner") -> DataFrame:
    """Joins rows with facts on key. facts has one row per key, and `size` counts the key's rows.

    A key that holds more than one in HOT_SHARE of all counted rows is dealt over several tasks, by a hash of the
    columns `by`; its fact is copied to each. There are at most HOT_SHARE such keys, so their list is broadcast.
    """
    keys = [key] if isinstance(key, str) else key
    total = facts.agg(F.sum(size)).first()[0] or 0
    hot = facts.filter(F.col(size) * HOT_SHARE > total).select(*keys, F.ceil(F.col(size) * HOT_SHARE / max(total, 1)).cast("int").alias("_parts"))
    hot = F.broadcast(hot)  # at most HOT_SHARE rows
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("_parts")
    copied = facts.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    # a merge join at any size: a broadcast that only small inputs allow would make plans differ
    return dealt.join(copied.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fold_of(column: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


class WordBuckets(dict):
    """Bucket of a word: crc32 modulo a power of two. Remembers up to `most` words."""

    def __init__(self, buckets: int, most: int = 300_000) -> None:
        super().__init__()
        self.mask, self.most = buckets - 1, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = b = zlib.crc32(word.encode("utf-8", "surrogatepass")) & self.mask
        return b


def ragged(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and the len+1 offsets of a list of lists."""
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.fromiter((v for x in lists for v in x), np.int64, int(offsets[-1]))
    return flat, offsets


def chunks(texts: list[str | None], most_chars: int = 2_000_000):
    """Index ranges of a batch whose texts together hold about most_chars characters."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most_chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
