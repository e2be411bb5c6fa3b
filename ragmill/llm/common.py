"""Helpers that the corpus operators share: reading, shared folders, text buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Spark removes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. The session names it; only where it is unset, and driver and executors are one
    process (tests), a local one is made."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
        there = "file://" + tempfile.mkdtemp(prefix="ragmill-")
        spark.sparkContext.setCheckpointDir(there)
    return there


@contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of what runs within go at its end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back with the schema it had. Its shuffle files go as
    soon as it is written, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ragmill-{uuid.uuid4().hex}/{name}"
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._ragmill_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once all that was made from it is written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._ragmill_path).getParent()
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as make it none of the columns'."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id="doc_id"):
    """crc32 of the id's decimal text, modulo 5, is 0."""
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5) == 0


def bounded_sample(rows: DataFrame, group: str, key: str, most: int) -> list:
    """Rows of ``rows``, at most ``most`` of each value of ``group`` (of which there are few), those whose ``key`` hashes
    lowest. Groups are counted first, so that about four times ``most`` rows of each pass a threshold and are ranked, in one
    pass for all groups. A group of so few keys that too few rows pass is ranked as a whole."""
    sizes = {r[0]: r[1] for r in rows.groupBy(group).count().collect() if r[0] is not None}
    span, place = 1 << 30, free_name(rows, "place")
    nth = F.row_number().over(W.partitionBy(group).orderBy(place, *rows.columns))
    hashed = rows.withColumn(place, F.pmod(F.xxhash64(key), F.lit(span)))
    best = lambda near: near.withColumn(place, nth).where(F.col(place) <= most).select(*rows.columns).collect()
    if not sizes:
        return []
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, 4 * most / n) * span))))
    got = best(hashed.where(F.col(place) < F.element_at(share, F.col(group))))
    count = Counter(r[group] for r in got)
    few = [k for k, n in sizes.items() if count[k] < min(most, n)]
    return [r for r in got if r[group] not in few] + (best(hashed.where(F.col(group).isin(*few))) if few else [])


class Texts:
    """Some whole texts as one byte buffer: text i is ``data[offs[i]:offs[i + 1]]``; null counts as empty."""

    __slots__ = ("batch", "data", "offs", "nulls")

    def __init__(self, batch, data, offs, nulls):
        self.batch, self.data, self.offs, self.nulls = batch, data, offs, nulls

    def __len__(self):
        return len(self.offs) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()


def text_buffers(batches: Iterator, column: str, most: int = 1 << 21) -> Iterator[Texts]:
    """Slices of Arrow batches whose texts have ``most`` bytes together, or that hold one longer text."""
    import pyarrow as pa

    for whole in batches:
        if not whole.num_rows:
            continue
        col = whole.column(whole.schema.get_field_index(column)).cast(pa.large_string())
        n = whole.num_rows
        _, offsets, data = col.buffers()
        offs = np.frombuffer(offsets, np.int64)[col.offset : col.offset + n + 1]
        flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        nulls = np.asarray(col.is_null())
        at = 0
        while at < n:
            to = int(np.searchsorted(offs, offs[at] + most, side="right")) - 1
            to = min(max(to, at + 1), n)
            part = offs[at : to + 1] - offs[at]
            yield Texts(whole.slice(at, to - at), flat[offs[at] : offs[to]], part, nulls[at:to])
            at = to
