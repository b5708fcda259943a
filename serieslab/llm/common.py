"""What the operators share: scratch tables, size-checked broadcasts, row keys, components."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side may be broadcast.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 32 << 20
#: Bytes of an Arrow batch: what a task holds at a time on either side of a Python operator.
BATCH_BYTES = 4 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Folders that scratch tables go to while a scratch_scope is open, the innermost last.
_scopes: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; where it is unset, in the warehouse, which executors share too."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    return "/".join([base.rstrip("/"), "serieslab", *_scopes[-1:], f"{name}-{uuid.uuid4().hex}"])


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside go to a folder of their own, which is deleted at the end: what is needed later must be written outside."""
    _scopes.append(f"scope-{uuid.uuid4().hex}")
    path = scratch(spark, "x").rsplit("/", 1)[0]
    try:
        yield
    finally:
        _scopes.pop()
        delete(spark, path)


def bounded_batches(spark: SparkSession) -> None:
    """Cut Arrow batches by bytes, not by rows alone: ten thousand long texts would fill a worker. A smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def materialise(df: DataFrame, name: str, files: int | None = None, path: str | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, so a lost executor recomputes nothing before it.

    `files` bounds the files (and the last stage's tasks) of a table whose size is known from what it is made of: small
    tables would else have one for each shuffle partition, and each costs more to create and open than to fill.
    """
    bounded_batches(df.sparkSession)
    path = path or scratch(df.sparkSession, name)
    (df.coalesce(files) if files else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files_for(spark: SparkSession, amount: int, each: int) -> int:
    """Files for a table of that many rows or bytes that is dear to make, `each` a file; two a core at least, so that cores stay busy."""
    return max(2 * spark.sparkContext.defaultParallelism, few_files(amount, each))


def few_files(rows: int, each: int = 250_000) -> int:
    """Files for a table of at most that many rows of a few numbers, made from tables that are there."""
    return max(1, -(-rows // each))


def drop_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables in this checkpoint folder. Call it when no query that uses the folder runs."""
    delete(spark, scratch(spark, "x").rsplit("/", 1)[0])


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows and BROADCAST_BYTES, else df as it is, to be joined by a shuffle.

    df should be cheap to read twice. Columns of fixed width count 8 bytes, others by their length.
    """

    def width(field: T.StructField) -> Column:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.octet_length(field.name)
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.octet_length(F.to_json(F.struct(field.name)))
        return F.lit(8)

    each = sum((F.coalesce(width(f), F.lit(0)) for f in df.schema), F.lit(16))
    rows, size = df.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(each), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and size <= BROADCAST_BYTES else df


_memo: tuple[object, Any] = (None, None)


def worker_memo(key: object, make: Callable[[], Any]) -> Any:
    """What this Python worker remembers for `key`, made anew if it was last asked for another: stages that take turns in a worker don't add up their memos."""
    global _memo
    if _memo[0] != key:
        _memo = (None, None)
        _memo = (key, make())
    return _memo[1]


def trim() -> None:
    """Give the memory that this Python worker has freed back to the system; the C libraries would keep it for the worker's life."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def trimming(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, with trim() after the task's last batch."""

    def run_and_trim(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return run_and_trim


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of df has (Spark does not tell case apart)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x computed once, however often body names it; the optimiser would copy a column into every element of a lambda."""
    return F.transform(F.array(x), body)[0]


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. On pure ASCII text lower() says the same and is much cheaper."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def min_neighbours(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Label each end of the edges (a, b: long) with the least id that it can reach: (id, root).

    Alternates large-star and small-star steps until nothing changes (about log n rounds). Every step is a
    pre-aggregated minimum and an equi-join, so a hub is split by the skew join; each round is written to the shared
    folder. Self loops and repeated edges are harmless; an empty input gives an empty output.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    now = materialise(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())
    before = state(now)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = min_neighbours(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        m = min_neighbours(large)
        small = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(m.select("u", F.col("m").alias("v"))).distinct()
        now = materialise(small, "edges", few_files(before[0]))
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected_components did not converge")
    return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
