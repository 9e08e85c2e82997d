"""Helpers of the corpus operators: shared folder, written intermediate tables, size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of (narrow) rows that a join may broadcast; above it the join shuffles.
BROADCAST_ROWS = 500_000

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`. Where that is unset, a folder of our own on a single
    machine (tests), and an error on a cluster, whose executors would each write to a disk of their own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own_dirs[app]


def stash_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write `df` as Parquet under the shared folder and read it back: cuts lineage, survives lost executors. Also its path."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stash(df: DataFrame, label: str) -> DataFrame:
    return stash_at(df, label)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stashed table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if `df` (a stashed table, so counting is cheap) has at most `limit` rows."""
    return F.broadcast(df) if df.count() <= limit else df


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_of(df: DataFrame, alias: str = "row") -> Column:
    """All input columns as one struct, so that no helper column can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(alias)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts hold at most about BATCH_BYTES, in the JVM and in Python; rows are never split."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b") or 0) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20
#: Python operators work on about this many characters of text at a time.
BATCH_CHARS = 500_000


def text_batches(batches, chars: int = BATCH_CHARS):
    """(ids, texts) lists of about `chars` characters from Arrow batches of (id, text); one text may be longer."""
    for batch in batches:
        ids, texts, held = [], [], 0
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(i.as_py())
            texts.append(t.as_py())
            held += len(texts[-1])
            if held >= chars:
                yield ids, texts
                ids, texts, held = [], [], 0
        if ids:
            yield ids, texts


def give_back() -> None:
    """Return to the system what Arrow's pool and the C library keep of freed memory."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def leaving_nothing(run: Callable[[Iterator], Iterator], *forget: Callable[[], object]) -> Callable[[Iterator], Iterator]:
    """`run` for mapInArrow, of which a worker keeps no memory once the task has ended: `forget` drops what it remembers.

    Workers live on beside later stages, where the JVM needs the room.
    """

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            give_back()

    return whole
