"""Near-duplicate vectors by Euclidean p-stable hashing.

Normalised vectors are hashed into several tables by quantised random projections; vectors of a bucket are compared
by exact cosine in double precision. Equal vectors are one class first. A bucket larger than TILE is cut into tiles
whose pairs are compared in tasks of their own, so every bucket is compared whole and none in one task. A pair counts
in the first table that it shares, and a tile hands on sums and a spanning forest, never its pairs.

The number of projections follows the largest label's rows and the number of tables follows from it and the recall
wanted at the threshold, so buckets stay small and recall stays the same at every size.

Edge cases: a null, empty or zero vector, one with a null or non-finite component, and one with a null label link with
nothing; vectors of different lengths never link; every row is a vector of its own, whether or not its vec_id or its
vector repeats; a row with a null vec_id takes part, gets the least id it reaches (null if none) and is not kept; an
empty table gives an empty result; columns other than vec_id, embedding and label are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serieslab.llm.common import connected_components, materialise, maybe_broadcast, trim, trimming

TILE = 512
GROUP_ROWS = 20_000  # rows that one call of the comparison gets, about
SALTS = 16


def collision(width: float, distance: float) -> float:
    """The chance that one quantised projection agrees for two points at that distance."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_for(rows: int, threshold: float, recall: float, width: float) -> tuple[int, int]:
    """(projections a table, tables): buckets of some 64 unrelated vectors, and the recall at the threshold."""
    near, far = collision(width, math.sqrt(2 - 2 * threshold)), collision(width, math.sqrt(2))
    k = max(4, math.ceil(math.log(max(rows, 1) / 64) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def signatures(x: np.ndarray, k: int, tables: int, width: float, salt: np.ndarray, seed: int = 3) -> np.ndarray:
    """The bucket (64 bits, with the label's salt in it) of each unit vector in each table."""
    rng = np.random.default_rng([seed, x.shape[1]])
    cells = np.floor((x @ rng.standard_normal((x.shape[1], tables * k)) + rng.uniform(0, width, tables * k)) / width).astype(np.int64)
    mix = rng.integers(1 << 20, 1 << 62, (tables, k), dtype=np.int64) | 1
    with np.errstate(over="ignore"):
        sums = (cells.reshape(len(x), tables, k) * mix).sum(axis=2) + np.arange(1, tables + 1) * np.int64(0x9E3779B97F4A7C1)
        return (sums ^ (sums >> 29)) * np.int64(0xBF58476D1CE4E5B) + salt[:, None] * np.int64(0x94D049BB133111E)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; large and small components neither overflow nor vanish."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def vectors_of(blobs: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches through the links a-b."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_duplicates(rows: DataFrame, threshold: float = 0.93, recall: float = 0.99, width: float = 1.2) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = rows.sparkSession
    single = dict(rows.dtypes)["embedding"] == "array<float>"
    v = F.col("embedding").cast("array<float>" if single else "array<double>")
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    keyed = rows.select("vec_id", "label", v.alias("embedding")).withColumn("sound", F.coalesce(sound, F.lit(False)))
    keyed = keyed.withColumns({"h": F.when(F.col("sound"), F.xxhash64("label", "embedding")), "g": F.when(F.col("sound"), F.hash("embedding", "label"))})
    one = keyed.where("sound").groupBy("h", "g").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"), F.min(F.struct("label", "embedding")).alias("s"))
    one = one.select("h", "g", F.monotonically_increasing_id().alias("node"), "least", "m", F.xxhash64("s.label", F.size("s.embedding")).alias("salt"), F.col("s.embedding").alias("x"))
    classes = materialise(one, "classes")  # from here on a class is its node, a number of its own
    largest = classes.groupBy("salt").count().agg(F.max("count")).first()[0] or 0
    k, tables = tables_for(largest, threshold, recall, width)
    kind = "<f4" if single else "<f8"

    def sign(batches):
        for batch in batches:
            nodes, m, salts, x = (batch.column(i) for i in range(4))
            sizes, salts = np.diff(x.offsets.to_numpy()), salts.to_numpy()
            flat, at = x.flatten().to_numpy(zero_copy_only=False).astype(kind), np.r_[0, np.cumsum(sizes)]
            for size in np.unique(sizes):
                of = np.flatnonzero(sizes == size)
                part = np.stack([flat[at[i] : at[i] + size] for i in of])
                sig = signatures(unit(part), k, tables, width, salts[of])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, tables, dtype=np.int32)), pa.array(sig.ravel()))
                yield pa.record_batch([nodes.take(pa.array(of)), m.take(pa.array(of)), pa.array([r.tobytes() for r in part], pa.binary()), lists], names=["node", "m", "x", "sig"])

    signed = classes.select("node", "m", "salt", "x").mapInArrow(trimming(sign), "node long, m long, x binary, sig array<long>")
    signed = materialise(signed, "signatures")
    hashed = signed.select("node", F.posexplode("sig").alias("t", "bucket"))
    sizes = hashed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialise(sizes.withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")), "buckets")
    work = sizes.agg(F.sum(F.col("n") * F.col("tiles"))).first()[0] or 0
    groups = max(1, math.ceil(work / GROUP_ROWS))

    # A table is sent the vector as it came and the buckets of the tables before it, which tell whether a pair is new
    placed = signed.select("node", "m", "x", "sig", F.posexplode("sig").alias("t", "bucket")).select("node", "m", "x", F.slice("sig", F.lit(1), F.col("t")).alias("sig"), "t", "bucket")
    placed = placed.join(maybe_broadcast(sizes.select("bucket", "tiles")), "bucket")
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(groups)))
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, m, t, bucket, side, i, j = (table.column(c).to_numpy() for c in ("node", "m", "t", "bucket", "own", "i", "j"))
        blobs, sigs = table.column("x").to_pylist(), table.column("sig").combine_chunks()
        sig_at, sig_flat = sigs.offsets.to_numpy(), sigs.values.to_numpy()
        width_of = np.fromiter(map(len, blobs), np.int64, len(blobs))
        order = np.lexsort((node, width_of, j, i, t, bucket))
        keys = np.stack([bucket, t, i, j, width_of])[:, order]
        starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]) if len(order) else []
        out: list[np.ndarray] = []
        for lo, hi in zip(starts, [*starts[1:], len(order)], strict=True):
            if hi - lo < 2:
                continue
            at = order[lo:hi]
            x = unit(vectors_of([blobs[r] for r in at], kind))
            if i[at[0]] == j[at[0]]:
                a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
            else:
                left, right = np.flatnonzero(side[at] == i[at[0]]), np.flatnonzero(side[at] == j[at[0]])
                a, b = np.nonzero(x[left] @ x[right].T >= threshold)
                a, b = left[a], right[b]
            if not len(a):
                continue
            sig = np.stack([sig_flat[sig_at[r] : sig_at[r + 1]] for r in at])
            first = ~(sig[a] == sig[b]).any(axis=1)
            links = np.zeros(len(x), np.int64)
            np.add.at(links, a[first], m[at[b[first]]])
            np.add.at(links, b[first], m[at[a[first]]])
            root, hit = _forest(len(x), a, b), np.unique(np.concatenate([a, b]))
            out.append(np.stack([node[at[hit]], node[at[root[hit]]], links[hit]]))
        found = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        del table, blobs
        trim()
        return pa.table([pa.array(c) for c in found], schema=schema)

    sent = placed.select("node", "m", "x", "sig", "t", "bucket", "own", "i", "j", "cell")
    linked = materialise(sent.groupBy("cell").applyInArrow(compare, "node long, root long, links long") if work else spark.range(0).selectExpr("id AS node", "id AS root", "id AS links"), "links")
    roots = connected_components(linked.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "node")
    found = linked.groupBy("node").agg(F.sum("links").alias("links"))
    told = classes.select("h", "g", "node", "least", "m").join(found, "node", "left").join(roots, "node", "left")
    told = told.select("h", "g", "least", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "node").alias("root")).where("links > 0")
    told = materialise(told, "told")
    told = materialise(told.join(told.groupBy("root").agg(F.min("least").cast("long").alias("component")), "root").select("h", "g", "links", "component"), "components")
    small = maybe_broadcast(told)
    if small is not told:
        both = keyed.join(small, ["h", "g"], "left")
    else:  # a class may hold a third of all rows
        salted = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = keyed.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int")).join(salted, ["h", "g", "salt"], "left")
    component = F.coalesce("component", F.col("vec_id").cast("long"))
    return both.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
