"""Shards of near equal bytes by sampled splitters.

A size-weighted sample of sort keys gives quantile boundaries; records are range-partitioned by them and each range
is summed exactly. Global offsets of the ranges then turn a record's place in its range into its place among all
bytes, and so into a shard: an overfull range (a text that a third of all rows share) is subdivided wherever a shard
boundary falls into it. The sort key is (hash of the text, hash of doc_id), so equal texts stay together elsewhere. Texts are
read once and never shuffled, only their key and size.

Edge cases: null text has no bytes (its CRC is that of the empty text) but counts with the overhead; rows that are
equal in key and size are interchangeable; an empty table gives an empty result; with fewer rows than shards some
shards stay empty; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serieslab.llm.common import materialise

#: Most ranges: they and their splitters are held on the driver and in each task.
MAX_RANGES = 4096
#: Sampled keys for each range, about.
PER_RANGE = 16
#: Bytes of text that a range should hold where MAX_RANGES allows it.
RANGE_BYTES = 16 << 20


def keyed_sizes(docs: DataFrame, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32 and the sort key h of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("x")).select("doc_id", (F.octet_length("x") + overhead).cast("long").alias("size"), F.crc32(F.encode("x", "utf-8")).alias("text_crc32"), F.xxhash64("x").alias("h"))


def longs(values: list[int]) -> Column:
    """A constant array, which the optimiser folds into one literal."""
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})")


def range_of(h: Column, tie: Column, splitters: list[tuple[int, int]]) -> Column:
    """How many splitters are at most (h, tie): a binary search over a constant array."""
    if not splitters:
        return F.lit(0)
    hs, ties = (longs([x[i] for x in splitters]) for i in (0, 1))
    lo, hi = F.lit(0), F.lit(len(splitters))

    def halve(acc: Column, _: Column) -> Column:
        mid = ((acc["lo"] + acc["hi"]) / 2).cast("int")
        at, at_tie = F.get(hs, mid), F.get(ties, mid)
        open_, below = acc["lo"] < acc["hi"], (at < h) | ((at == h) & (at_tie <= tie))
        return F.struct(F.when(open_ & below, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~below, mid).otherwise(acc["hi"]).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(splitters).bit_length()))
    return F.aggregate(steps, F.struct(lo.alias("lo"), hi.alias("hi")), halve)["lo"]


def sample_splitters(keyed: DataFrame, total: int, n_ranges: int) -> list[tuple[int, int]]:
    """n_ranges - 1 quantile boundaries of about PER_RANGE x n_ranges keys drawn in proportion to their sizes.

    A row is drawn by a hash of its key, so a retried task draws the same; a row larger than the sampling step counts
    for as many keys as it spans steps.
    """
    step = max(1, total // (PER_RANGE * n_ranges))
    u = F.pmod(F.xxhash64("h", "tie", F.lit(11)), F.lit(step))
    drawn = keyed.withColumn("k", F.floor((F.col("size") + u) / step).cast("int")).where("k > 0")
    # The sample's size is bounded by the two constants above, whatever the input
    keys = drawn.select(F.explode(F.expr("array_repeat(struct(h, tie), k)")).alias("k")).agg(F.array_sort(F.collect_list("k")).alias("all"))
    n = F.size("all")
    cuts = F.transform(F.sequence(F.lit(1), F.lit(max(1, n_ranges - 1))), lambda i: F.get("all", (i * n / n_ranges).cast("int")))
    row = keys.where(n > 0).select(F.array_sort(F.array_distinct(cuts)).alias("cuts")).first()
    return [(c["h"], c["tie"]) for c in row["cuts"] if c is not None] if row and n_ranges > 1 else []


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row; shards differ by about one record's size."""
    # The last bits tell rows of one id and text apart, so that a range of them can be subdivided too
    tie = F.xxhash64(F.col("doc_id").cast("string")).bitwiseAND(F.lit(~4095)).bitwiseOR(F.monotonically_increasing_id().bitwiseAND(F.lit(4095)))
    keyed = materialise(keyed_sizes(docs, overhead).withColumn("tie", tie), "sizes")
    total = keyed.agg(F.sum("size")).first()[0] or 0
    n_ranges = int(min(MAX_RANGES, max(4 * n_shards, total // RANGE_BYTES)))
    ranged = keyed.withColumn("part", range_of(F.col("h"), F.col("tie"), sample_splitters(keyed, total, n_ranges)))

    order = [F.col(c) for c in ("h", "tie", "size", "text_crc32")]
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # Rows that tie in the whole order come in any order; the sums over a fixed row frame hold all the same
    summed = materialise(ranged.withColumn("upto", F.sum("size").over(inside)).withColumn("nth", F.row_number().over(inside)), "ranges")
    per_range = {r["part"]: r["size"] for r in summed.groupBy("part").agg(F.sum("size").alias("size")).toLocalIterator()}
    before, starts = 0, []
    for p in range(n_ranges + 1):
        starts.append(before)
        before += per_range.get(p, 0)
    start = F.get(longs(starts), F.col("part"))
    middle = start + F.col("upto") - F.col("size") / 2
    sharded = summed.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / max(total, 1))).cast("int"))

    # Where a shard begins in each range: at most n_ranges + n_shards rows
    cells = sorted((r["shard"], r["part"], r["n"], r["first"]) for r in sharded.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("nth").alias("first")).toLocalIterator())
    base, at = {}, {}
    for shard, part, n, first in cells:
        base[shard, part] = at.get(shard, 0) - first
        at[shard] = at.get(shard, 0) + n
    spark = docs.sparkSession
    offsets = spark.createDataFrame([(s, p, b) for (s, p), b in base.items()], "shard int, part int, base long")
    joined = sharded.join(F.broadcast(offsets), ["shard", "part"])
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("nth") + F.col("base")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 40) -> None:
    """Write doc_id and text as one Parquet folder a shard. Rows of one id, CRC and size are numbered on both sides, so each is written once."""
    key = ["doc_id", "text_crc32", "size"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    at = shard_by_bytes(docs, n_shards).select(*key, "shard").withColumn("nth", nth).withColumnsRenamed({c: f"at_{c}" for c in (*key, "nth")})
    x = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumns({"text_crc32": F.crc32(F.encode(x, "utf-8")), "size": (F.octet_length(x) + 16).cast("long")}).withColumn("nth", nth)
    same = F.col("doc_id").eqNullSafe(F.col("at_doc_id")) & (F.col("text_crc32") == F.col("at_text_crc32")) & (F.col("size") == F.col("at_size")) & (F.col("nth") == F.col("at_nth"))
    rows.join(at, same).select("doc_id", "text", "shard").write.partitionBy("shard").parquet(path)
