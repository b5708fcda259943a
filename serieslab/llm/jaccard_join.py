"""Near-duplicate documents by a parity-sketch join on word shingles.

A document is the set of its distinct 5-word shingles, as 64-bit hashes. XOR-ing tokens into bits gives a sketch in
which two sets differ in at most as many bits as their symmetric difference has elements, and similarity s bounds that
difference by (|A| + |B|)(1 - s)/(1 + s).

1. Each size band cuts the hash space into blocks; a block's value is the XOR of its tokens. Two similar sets differ
   in at most d blocks, so they agree in all other blocks of theirs that are not empty (pigeonhole).
2. As N non-empty blocks with at most d differences agree in N - d, a document needs to be looked up only by its d + 1
   rarest blocks, rarity being the number of distinct sets that hold a block's value. Values that many documents share
   (license lines, common passages) thus drop out without a cap on anything.
3. Documents that share a looked-up block are candidates. First each is held against the one partner it shares most
   blocks with, on their whole shingle sets; blocks whose documents are then all in one component say nothing more.
4. In the others, documents of different components whose sketches are near enough make families. All such pairs of a
   family are then held against each other on their whole sets, in tiles. A family may have as many pairs as the square
   of its size, near by sketch or similar, so no pair leaves its task: out of a cell of tiles come only edges that tie
   the same components together, fewer than the cell has documents.

Equal sets are one class from the first step on, each class being posted once a task, so copies are never paired. A
band's number of blocks leaves N > d by eight standard deviations or more (exactly, under 32 shingles); where a set
has fewer all the same, the tokens of all sets are dealt into blocks anew. So 64-bit hash collisions are the only
chance in the join.

Edge cases: null, empty or blank texts have an empty set and link with nothing; a text of fewer than five words is one
shingle; repeated rows are copies; rows with a null doc_id take part and get the least id they reach, null if there is
none; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from serieslab.llm.common import connected_components, few_files, files_for, materialise, maybe_broadcast, text_of, trim, trimming, worker_memo

WORDS = 5
TEXT_PER_GROUP = 4 << 20  # bytes of text whose blocks one grouping task gets, about
FILE_TEXT = 32 << 20  # bytes of text a file and a task of what is made of it, about
HOT = 64  # documents of one slice that share a block's value, from which on it stays with the slice, packed, and only its number goes to its group
HOT_ROW = np.dtype([("b", "<i8"), ("h", "<i8"), ("code", "<i4"), ("need", "<i4")])
HOT_ROWS = 50_000  # of them in a row of the table
TILE = 512
GROUP_ROWS = 20_000
TILE_BYTES = 8 << 20  # bytes of whole sets in a tile, about
CELL_BYTES = 4 << 20  # bytes of whole sets that one call of the comparison gets, about, or one pair of tiles
MEMO = 100_000
SLICE = 2 << 20  # bytes of rows whose block values a task sorts at a time, about
SALTS = 16
SEEDS = 8  # dealings of the tokens into blocks that are tried

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; A-Z are lower-cased, ASCII white space separates words."""
    ws = (text or "").encode().lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(worker_memo("word hashes", WordHash).__getitem__, ws), np.uint64, len(ws))
    width = min(words, len(ws))
    out = np.zeros(len(ws) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = out * _A + h[i : i + len(out)]
    return np.unique(mix(out + np.uint64(width)))


def set_hash(u: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(mix(u ^ _A).sum(dtype=np.uint64)[None] + np.uint64(len(u)))[0].view(np.int64))


def sketch(u: np.ndarray) -> bytes:
    """Parities of the tokens in 2^j bits, twice as many as tokens; halves XOR to the sketch of half the bits."""
    m = min(16384, max(256, 1 << (2 * len(u) - 1).bit_length()))
    return np.packbits((np.bincount((u >> np.uint64(7) & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(s: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(s, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def near_pairs(sketches: np.ndarray, n: np.ndarray, root: np.ndarray, side: np.ndarray | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions x < y of sets of different roots (and sides, if given) that may be similar, and their sketches' distance."""
    most = (den - num) * (n[:, None] + n[None, :])
    near = (den + num) * np.abs(n[:, None] - n[None, :]) <= most
    near &= root[:, None] != root[None, :]
    if side is not None:
        near &= side[:, None] != side[None, :]
    x, y = np.nonzero(np.triu(near, 1))
    if not len(x):
        return x, y, x
    # Only sets with some partner count for the common width
    who, at = np.unique(np.r_[x, y], return_inverse=True)
    width = min(len(s) for s in sketches[who])
    packed = np.stack([fold(s, width) for s in sketches[who]])
    a, b = at[: len(x)], at[len(x) :]
    if len(who) <= 16:
        d = np.bitwise_count(packed[a] ^ packed[b]).sum(axis=1, dtype=np.int64)
    else:
        bits = np.unpackbits(packed, axis=1).astype(np.float32)
        ones = bits.sum(axis=1)
        d = (ones[:, None] + ones[None, :] - 2 * (bits @ bits.T))[a, b].astype(np.int64)
    ok = (den + num) * d <= most[x, y]
    return x[ok], y[ok], d[ok]


def band(n: int) -> int:
    return n.bit_length() - 1


def block_values(u: np.ndarray, g: int, seed: int = 0) -> np.ndarray:
    """The values of the non-empty blocks of band g; under 32 shingles every token is a block. A seed other than 0 deals the tokens anew."""
    if seed:
        with np.errstate(over="ignore"):
            u = np.sort(mix(u + _B * np.uint64(seed)))
    with np.errstate(over="ignore"):
        x, step = mix(u + _C), _A * np.uint64(g + 1)
    if g < 5:
        return mix(x + step)
    per = 0.55 if g < 7 else 0.9 if g < 9 else 1.1 if g < 11 else 1.25  # tokens a block, at the band's lower end
    at = (u >> np.uint64(32)) * np.uint64(int((1 << g) / per)) >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    with np.errstate(over="ignore"):
        return mix(np.bitwise_xor.reduceat(x, starts) + step + at[starts] * _B)


def postings(u: np.ndarray, num: int, den: int, seed: int = 0) -> tuple[list[tuple[np.ndarray, int]], bool]:
    """((block values, code) for the own band, and the one below if a partner may be there; whether the blocks suffice).

    The code is twice the number of the commonest blocks that need no look-up, plus 1 in the band below. num/den is
    the similarity. Blocks suffice where there are more of them than two similar sets can differ in.
    """
    n = len(u)
    g = band(n)
    largest = n * den // num
    out, enough = [], True
    for lower in range(2):
        if lower and (g == 0 or -(-n * num // den) >= 1 << g):
            break
        d = (n + (n if lower else largest)) * (den - num) // (den + num)
        values = block_values(u, g - lower, seed)
        enough &= len(values) > d
        out.append((values, 2 * max(0, len(values) - d - 1) + lower))
    return out, enough


MAPPED = "p int, doc_id {0}, n long, h long, k long, sketch binary, values binary, classes binary, counts binary, codes binary, marks binary, marked binary, hot binary"


def _slices(batches):
    """The batches in parts of about SLICE bytes: block values take ten times the room of their texts."""
    for batch in batches:
        step = max(1, batch.num_rows * SLICE // max(1, batch.nbytes))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def _post(batches, groups: int, words: int, num: int, den: int, doc_type: pa.DataType, seed: int = 0):
    """Per batch: a row for each document (with codes if its blocks do not suffice), a row of block values for each group of values, and the slice's hot values, packed; h is the slice in both."""
    seen: set[int] = set()
    names = [x.split()[0] for x in MAPPED.split(", ")]
    types = [pa.int32(), doc_type, pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 8]
    for number, batch in enumerate(_slices(batches)):
        rows: list[tuple] = []
        values, owners, codes = [], [], []
        for i, (doc, text, k) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True)):
            u = shingles(text.as_py(), words)
            h = set_hash(u)
            new = len(u) and h not in seen
            posted, enough = postings(u, num, den, seed) if new else ([], True)
            rows.append((-1 - (i + number) % groups, doc, len(u), h, k, sketch(u) if new else None, None, None, None, None if enough else b"", None, None, None))
            if not new:
                continue
            seen.add(h)
            for v, code in posted:
                values.append(v)
                owners.append(h)
                codes.append(code)
        if values:
            sizes = np.array([len(v) for v in values])
            owners, codes = np.array(owners, np.int64), np.array(codes, np.int32)
            flat, at = np.concatenate(values), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            values.clear()
            order = np.argsort(flat, kind="stable")
            s = flat[order]
            starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            runs = np.diff(np.r_[starts, len(s)])
            hot = runs >= HOT
            mark, marked = s[starts[hot]], runs[hot]
            keep = np.ones(len(s), bool)
            keep[order] = ~np.repeat(hot, runs)
            hot_at = np.flatnonzero(~keep)
            hot_rows = np.empty(len(hot_at), HOT_ROW)
            hot_rows["b"], hot_rows["h"], hot_rows["code"] = flat[hot_at].view(np.int64), owners[at[hot_at]], codes[at[hot_at]]
            hot_rows["need"] = (sizes - codes // 2)[at[hot_at]]
            slice_id = xxhash.xxh3_64_intdigest(hot_rows.tobytes()) - (1 << 63)
            flat, at = flat[keep], at[keep]
            part = ((flat >> np.uint64(33)) % np.uint64(groups)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            flat, at, part = flat[order], at[order], part[order]
            mark_part = ((mark >> np.uint64(33)) % np.uint64(groups)).astype(np.int32)
            order = np.argsort(mark_part, kind="stable")
            mark, marked, mark_part = mark[order], marked[order].astype(np.int64), mark_part[order]
            present = np.union1d(part, mark_part)  # only the groups that this part has values of
            from_, to = np.searchsorted(part, present), np.searchsorted(part, present, "right")
            mark_from, mark_to = np.searchsorted(mark_part, present), np.searchsorted(mark_part, present, "right")
            for p, a, b, c, d in zip(present.tolist(), from_.tolist(), to.tolist(), mark_from.tolist(), mark_to.tolist(), strict=True):
                who = at[a:b]
                first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if b > a else np.zeros(0, np.int64)
                rows.append((p, None, None, slice_id, None, None, flat[a:b].tobytes(), owners[who[first]].tobytes(), np.diff(np.r_[first, b - a]).astype(np.int32).tobytes(), codes[who[first]].tobytes(), mark[c:d].tobytes(), marked[c:d].tobytes(), None))
            for i in range(0, len(hot_at), HOT_ROWS):
                rows.append((-1 - (i // HOT_ROWS + number) % groups, None, None, slice_id, *[None] * 8, hot_rows[i : i + HOT_ROWS].tobytes()))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)


def _size_blocks(table: pa.Table) -> pa.Table:
    """Of one group: documents and hot rows as they are; block values that more than one class holds, with their number; that of each slice's hot values for the slice."""
    if table.num_rows and table.column("p")[0].as_py() >= 0:
        join = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
        counts = join("counts", np.int32)
        b, h, code = join("values", np.int64), np.repeat(join("classes", np.int64), counts), np.repeat(join("codes", np.int32), counts)
        order = np.lexsort((code & 1, h, b))
        b, h, code = b[order], h[order], code[order]
        new = np.r_[True, (b[1:] != b[:-1]) | (h[1:] != h[:-1])] if len(b) else np.zeros(0, bool)
        b, h, code = b[new], h[new], code[new]
        marks, marked = join("marks", np.int64), join("marked", np.int64)
        of_slice = np.repeat(table.column("h").to_numpy(), [len(x) // 8 for x in table.column("marks").to_pylist()])
        which, where = np.unique(marks, return_inverse=True)
        extra = np.bincount(where, marked, len(which)).astype(np.int64) if len(which) else np.zeros(0, np.int64)
        starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(b)])
        if len(which) and len(starts):
            at = np.searchsorted(which, b[starts])
            there = (at < len(which)) & (which[np.minimum(at, len(which) - 1)] == b[starts])
            sizes = sizes + np.where(there, extra[np.minimum(at, len(which) - 1)], 0)
            own = np.searchsorted(b[starts], which)
            found = (own < len(starts)) & (b[starts][np.minimum(own, len(starts) - 1)] == which)
            total = np.where(found, sizes[np.minimum(own, len(starts) - 1)], extra)
        else:
            total = extra
        size = np.repeat(sizes, np.diff(np.r_[starts, len(b)]))
        keep = size > 1
        n, m = int(keep.sum()), len(marks)
        return pa.table({"kind": pa.array(np.r_[np.full(n, 1), np.full(m, 2)], pa.int32()), "doc_id": pa.nulls(n + m, table.schema.field("doc_id").type), "n": pa.nulls(n + m, pa.int64()), "h": pa.array(np.r_[h[keep], of_slice]), "k": pa.nulls(n + m, pa.int64()), "sketch": pa.nulls(n + m, pa.binary()), "b": pa.array(np.r_[b[keep], marks]), "size": pa.array(np.r_[size[keep], total[where]].astype(np.int64)), "code": pa.array(np.r_[code[keep], np.zeros(m, np.int32)].astype(np.int32)), "hot": pa.nulls(n + m, table.schema.field("hot").type)})
    n = table.num_rows
    return pa.table({"kind": pa.array(np.zeros(n, np.int32)), **{c: table.column(c) for c in ("doc_id", "n", "h", "k", "sketch")}, "b": pa.nulls(n, pa.int64()), "size": pa.array(np.where(table.column("codes").is_valid().to_numpy(), -1, 0)), "code": pa.nulls(n, pa.int32()), "hot": table.column("hot")})


def rarest(rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of HOT_ROWs and their values' sizes: positions of the `need` rarest of each class and band, a position of each class and band that has more, and how many more."""
    order = np.lexsort((rows["b"], size, rows["code"], rows["h"]))
    h, code = rows["h"][order], rows["code"][order]
    starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (code[1:] != code[:-1])])
    runs = np.diff(np.r_[starts, len(rows)])
    nth = np.arange(len(rows)) - np.repeat(starts, runs)
    left = runs - rows["need"][order[starts]]
    return order[nth < rows["need"][order]], order[starts[left > 0]], left[left > 0]


def _hot_blocks(found: DataFrame) -> DataFrame:
    """(b, h, size, code, weight) of the hot values that may be among the rarest d + 1 of their class and band.

    Others never become rows: a class and band has one row more, without b, whose weight is their number or, where a
    class was posted by several tasks, more. They are all commoner than what is to be kept.
    """
    sizes = found.where("kind = 2").groupBy("h").agg(F.collect_list(F.struct("b", "size")).alias("sizes"))
    packed = found.where("hot is not null").select("h", "hot").join(sizes, "h").select("hot", "sizes")

    def choose(batches):
        for batch in batches:
            for hot, sizes in zip(batch.column(0), batch.column(1), strict=True):
                rows, b, size = np.frombuffer(hot.as_py(), HOT_ROW), sizes.values.field("b").to_numpy(), sizes.values.field("size").to_numpy()
                order = np.argsort(b)
                size = size[order][np.searchsorted(b[order], rows["b"])]
                at, more, left = rarest(rows, size)
                none = [None] * len(more)
                yield pa.record_batch([pa.array([*rows["b"][at].tolist(), *none], pa.int64()), pa.array(np.r_[rows["h"][at], rows["h"][more]]), pa.array([*size[at].tolist(), *none], pa.int64()), pa.array(np.r_[rows["code"][at], rows["code"][more]]), pa.array(np.r_[np.ones(len(at), np.int64), left.astype(np.int64)])], names=["b", "h", "size", "code", "weight"])

    chosen = packed.mapInArrow(trimming(choose), "b long, h long, size long, code int, weight long")
    weight = F.when(F.col("b").isNull(), F.sum("weight")).otherwise(1).alias("weight")
    return chosen.groupBy("b", "h", "code").agg(F.max("size").alias("size"), weight).select("b", "h", "size", "code", "weight")


def _sets(ends: DataFrame, docs: DataFrame, classes: DataFrame, words: int, files: int) -> DataFrame:
    """(h, u): the whole shingle sets of the classes in ends (h, distinct), cut from the text of one row each."""
    need = classes.join(ends, "h").select("h", F.col("rep.doc_id").alias("id"), F.col("rep.k").alias("key"))
    need = maybe_broadcast(materialise(need, "needed", few_files(classes.count())))
    texts = docs.select("doc_id", text_of().alias("x")).withColumn("k", F.xxhash64("x"))
    texts = texts.join(need, F.col("k").eqNullSafe(F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("h", "x")

    def cut(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([shingles(x.as_py(), words).tobytes() for x in batch.column(1)], pa.binary())], names=["h", "u"])

    return materialise(texts.mapInArrow(trimming(cut), "h long, u binary").dropDuplicates(["h"]), "sets", files)


def common_tokens(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of tokens that sets x[i] and y[i] share, of distinct tokens each."""
    who, at = np.unique(np.r_[x, y], return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    pairwise = lambda: np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(x, y, strict=True)], np.int64)
    if len(x) <= 4 * len(who):
        return pairwise()
    sizes = np.array([len(sets[i]) for i in who])
    _, column, held = np.unique(np.concatenate([sets[i] for i in who]), return_inverse=True, return_counts=True)
    width = int((held > 1).sum())
    if 1000 * len(x) * (500 + sizes.mean()) < len(who) ** 2 * width:  # by the time that each way takes
        return pairwise()
    # Of many pairs all at once: products of parts of the table of sets by the tokens that two of them have
    row, shared = np.repeat(np.arange(len(who)), sizes), held[column] > 1
    row, column = row[shared], (np.cumsum(held > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(who), len(who)), np.float64)
    for lo in range(0, width, 4096):
        part = slice(*np.searchsorted(column, [lo, lo + 4096]))
        has = np.zeros((len(who), 4096), np.float32)
        has[row[part], column[part] - lo] = 1
        both += has @ has.T
    return both[a, b].astype(np.int64)


def leads(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Of each of n nodes the least that the edges (x, y) reach from it."""
    lead = np.arange(n)
    while True:
        now = lead.copy()
        np.minimum.at(now, x, lead[y])
        np.minimum.at(now, y, lead[x])
        now = now[now]
        if (now == lead).all():
            return lead
        lead = now


def _star(a: list[np.ndarray], b: list[np.ndarray]) -> pd.DataFrame:
    """Of the graph of the edges (a, b) an edge (a: lead, b) for each node but the least of its component."""
    if not a:
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    a, b = np.concatenate(a), np.concatenate(b)
    ids, at = np.unique(np.r_[a, b], return_inverse=True)
    lead = leads(at[: len(a)], at[len(a) :], len(ids))
    rest = lead != np.arange(len(ids))
    return pd.DataFrame({"a": ids[lead[rest]], "b": ids[rest]})


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, num: int, den: int, files: int) -> DataFrame:
    """The pairs (a, b) of classes that are similar, held against each other on their whole sets."""
    ends = pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).distinct()
    sets = _sets(ends, docs, classes, words, files)

    def hold(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = sets.select(F.col("h").alias("a"), F.col("u").alias("ua")), sets.select(F.col("h").alias("b"), F.col("u").alias("ub"))
    return materialise(pairs.join(right, "b").join(left, "a").select("a", "b", "ua", "ub").mapInArrow(trimming(hold), "a long, b long"), "verified", files)


def linked_classes(docs: DataFrame, words: int = WORDS, num: int = 75, den: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, n, h), (classes: h, rep, least, copies, n, sketch) and (edges a, b of classes that tie each component together, not each of them similar)."""
    source = docs.select("doc_id", text_of().alias("x")).withColumn("k", F.xxhash64("x"))
    size = source.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    groups = max(1, math.ceil(size / TEXT_PER_GROUP))
    files = files_for(docs.sparkSession, size, FILE_TEXT)
    kind = dict(docs.dtypes)["doc_id"]
    from pyspark.sql.pandas.types import to_arrow_type

    doc_type = to_arrow_type(docs.schema["doc_id"].dataType)
    def size_blocks(table: pa.Table) -> pa.Table:
        out = _size_blocks(table)
        trim()
        return out

    sized = f"kind int, doc_id {kind}, n long, h long, k long, sketch binary, b long, size long, code int, hot binary"
    for seed in range(SEEDS):
        mapped = source.mapInArrow(trimming(lambda batches, seed=seed: _post(batches, groups, words, num, den, doc_type, seed)), MAPPED.format(kind))
        found = materialise(mapped.groupBy("p").applyInArrow(size_blocks, sized), "blocks", files)
        if found.where("kind = 0 and size < 0").isEmpty():
            break
    else:
        raise RuntimeError("no dealing of the tokens leaves every set enough blocks")

    rows = found.where("kind = 0 and hot is null").select("doc_id", "n", "h", "k", "sketch")
    classes = rows.where("n > 0").groupBy("h").agg(F.min(F.struct("doc_id", "k")).alias("rep"), F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    classes = materialise(classes, "classes", files)
    few = few_files(classes.count())  # for what has a pair or a number a class at most

    blocks = found.where("kind = 1").select("b", "h", "size", "code", F.lit(1).cast("long").alias("weight")).unionByName(_hot_blocks(found))
    # The d + 1 rarest blocks of each class and band: all but the `code // 2` commonest, first of all those that are no rows
    order = Window.partitionBy("h", F.col("code") % 2).orderBy(F.desc_nulls_first("size"), F.desc("b")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = blocks.withColumn("nth", F.sum("weight").over(order)).where(F.col("b").isNotNull() & (F.col("nth") > F.floor(F.col("code") / 2))).select("b", "h").distinct()
    kept = materialise(kept, "kept", files)

    pivots = kept.groupBy("b").agg(F.min("h").alias("a"), F.count("*").alias("size")).where("size > 1").select("b", "a")
    star = kept.join(pivots, "b").where("h <> a").groupBy("h", "a").agg(F.count("*").alias("shared"))
    star = star.groupBy("h").agg(F.max(F.struct("shared", "a")).alias("m")).select("m.a", F.col("h").alias("b"))
    star = materialise(_near(star, classes, num, den), "star", few)
    edges = _verify(star, docs, classes, words, num, den, files)
    roots = materialise(connected_components(edges), "roots", few)
    maybe = _candidates(kept, roots, classes, num, den, files)
    if maybe is not None:
        found_too = _links(maybe, kept, roots, docs, classes, words, num, den, files)
        edges = materialise(edges.unionByName(found_too), "edges", few)
    return rows, classes, edges


def _tiled(member: DataFrame, tiles: DataFrame, classes: DataFrame, cells: int) -> DataFrame:
    """member (u, h, root, ...) once for each pair i <= j of its unit's tiles (u, tiles) that its own is one of, dealt to cells.

    The same pair of as many tiles goes to as few cells as their number allows: units that share members meet there.
    """
    placed = member.join(tiles, "u").join(classes.select("h", "n", "sketch"), "h")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("h"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    deal = F.pmod(F.xxhash64("u"), F.greatest(F.lit(1), F.floor(cells * 2 / (F.col("tiles") * (F.col("tiles") + 1)))).cast("long"))
    return placed.withColumn("cell", F.pmod(F.xxhash64("i", "j", "tiles", deal), F.lit(cells))).drop("tiles", "other")


def _near_in_tiles(pdf: pd.DataFrame, num: int, den: int):
    """Of each pair of tiles: the rows it has, and the pairs of near_pairs among them."""
    u, i, j, n, root, h, side = (pdf[c].to_numpy() for c in ("u", "i", "j", "n", "root", "h", "own"))
    sketches = pdf["sketch"].to_numpy()
    order = np.lexsort((h, j, i, u))
    key = np.stack([u, i, j])[:, order]
    starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
    for lo, hi in zip(starts, [*starts[1:], len(order)], strict=True):
        if hi - lo > 1:
            at = order[lo:hi]
            x, y, _ = near_pairs(sketches[at], n[at], root[at], side[at] if i[at[0]] != j[at[0]] else None, num, den)
            if len(x):
                yield at, x, y


def _candidates(kept: DataFrame, roots: DataFrame, classes: DataFrame, num: int, den: int, files: int) -> DataFrame | None:
    """(h, family) of the classes that in some block stand beside one of another component whose sketch is near enough; None if no block has two.

    Such classes of one block are of one family, so the pairs themselves need not be told. Blocks with the same members
    say the same, so one of each such set is enough.
    """
    member = kept.join(roots, kept["h"] == roots["id"], "left").select(F.col("b").alias("u"), "h", F.coalesce("root", "h").alias("root"))
    spread = F.bit_xor(F.xxhash64("h")).alias("x1"), F.bit_xor(F.xxhash64("h", F.lit(1))).alias("x2")
    blocks = member.groupBy("u").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("size"), *spread).where("r0 <> r1")
    blocks = blocks.groupBy("x1", "x2", "size").agg(F.min("u").alias("u"))
    open_ = materialise(blocks.select("u", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"), "size"), "open", files)
    work = open_.agg(F.sum(F.col("size") * F.col("tiles"))).first()[0]
    if not work:
        return None
    placed = _tiled(member, maybe_broadcast(open_.select("u", "tiles")), classes, max(1, math.ceil(work / GROUP_ROWS)))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        h = pdf["h"].to_numpy()
        a, b = [], []
        for at, x, y in _near_in_tiles(pdf, num, den):
            lead = leads(x, y, len(at))
            rest = np.flatnonzero(lead != np.arange(len(at)))
            a.append(h[at[lead[rest]]])
            b.append(h[at[rest]])
        return _star(a, b)

    near = materialise(placed.groupBy("cell").applyInPandas(compare, "a long, b long").distinct(), "near", files)
    return connected_components(near).select(F.col("id").alias("h"), F.col("root").alias("family"))


def _links(maybe: DataFrame, kept: DataFrame, roots: DataFrame, docs: DataFrame, classes: DataFrame, words: int, num: int, den: int, files: int) -> DataFrame:
    """Edges (a, b) between roots that tie together the components with similar classes in them.

    All pairs of a family that are of different components and near by their sketches are held against each other on
    their whole sets, in tiles; the pairs stay in the task, what leaves it is less than an edge a root. A family whose
    blocks, each in tiles of its own, have fewer rows than its own tiles is taken by blocks.
    """
    few = few_files(classes.count())
    maybe = materialise(maybe.join(roots, maybe["h"] == roots["id"], "left").select("h", "family", F.coalesce("root", "h").alias("root")), "maybe", few)
    if maybe.isEmpty():
        return maybe.select(F.col("h").alias("a"), F.col("h").alias("b"))
    sets = _sets(maybe.select("h"), docs, classes, words, files)
    sized = materialise(maybe.join(sets.select("h", F.octet_length("u").alias("bytes")), "h"), "sized", few)
    tiles = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("bytes") / TILE_BYTES)).cast("int").alias("tiles")
    measures = tiles, F.count("*").alias("size"), F.sum("bytes").alias("bytes")
    unit = sized.select(F.col("family").alias("u"), "h", "root", "bytes")
    large = materialise(sized.groupBy("family").agg(*measures).where("tiles > 1"), "large", few)
    # Blocks can only be the cheaper way where their members, each in one tile, have fewer rows than the family's tiles
    posted = sized.join(maybe_broadcast(large.select("family")), "family").join(kept.groupBy("h").agg(F.count("*").alias("posted")), "h")
    posted = posted.groupBy("family").agg(F.sum("posted").alias("posted"))
    large = materialise(large.join(posted, "family").where("posted < size * tiles").select("family", "size", "tiles"), "large", few)
    if not large.isEmpty():
        in_blocks = materialise(sized.join(maybe_broadcast(large.select("family")), "family").join(kept, "h"), "in_blocks", files)
        cost = in_blocks.groupBy("family", "b").agg(*measures).groupBy("family").agg(F.sum(F.col("size") * F.col("tiles")).alias("cost"))
        apart = materialise(large.join(cost, "family").where("cost < size * tiles").select("family"), "apart", few)
        blocks = in_blocks.join(maybe_broadcast(apart), "family").select(F.xxhash64("family", "b").alias("u"), "h", "root", "bytes")
        unit = sized.join(maybe_broadcast(apart), "family", "left_anti").select(F.col("family").alias("u"), "h", "root", "bytes").unionByName(blocks)
    units = materialise(unit.groupBy("u").agg(*measures, F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1"), "units", few)
    rows, size = units.agg(F.sum(F.col("size") * F.col("tiles")), F.sum(F.col("bytes") * F.col("tiles"))).first()
    cells = max(1, math.ceil(rows / GROUP_ROWS), math.ceil(size / CELL_BYTES))
    member = unit.select("u", "h", "root").join(sets.withColumnRenamed("u", "set"), "h")
    placed = _tiled(member, maybe_broadcast(units.select("u", "tiles")), classes, cells)

    def hold(pdf: pd.DataFrame) -> pd.DataFrame:
        n, root = pdf["n"].to_numpy(), pdf["root"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in pdf["set"]]
        a, b = [], []
        for at, x, y in _near_in_tiles(pdf, num, den):
            x, y = at[x], at[y]
            both = common_tokens(sets, x, y)
            ok = den * both >= num * (n[x] + n[y] - both)
            a.append(root[x[ok]])
            b.append(root[y[ok]])
        return _star(a, b)

    return materialise(placed.groupBy("cell").applyInPandas(hold, "a long, b long").distinct(), "links", few)


def _near(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sizes alone allow the similarity."""
    size = lambda c: classes.select(F.col("h").alias(c), F.col("n").alias(f"n_{c}"))
    both = pairs.join(size("a"), "a").join(size("b"), "b")
    return both.where(den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b")).select("a", "b")


def components(docs: DataFrame, words: int = WORDS, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach), k (hash of the text) and root of each row.

    The root is one number a component, whatever the ids of its rows; it is null where the set is empty.
    """
    rows, classes, edges = linked_classes(docs, words, num, den)
    roots = connected_components(edges).withColumnRenamed("id", "h")
    of_class = classes.select("h", "least", "copies").join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    of_root = of_class.groupBy("root").agg(F.min("least").alias("component"), F.sum("copies").alias("members")).where("members > 1")
    told = materialise(of_class.join(of_root, "root").select("h", "component", "root"), "components", few_files(classes.count()))
    small = maybe_broadcast(told)
    own = rows.select("doc_id", "n", "h", "k")
    if small is not told:
        both = own.join(small, "h", "left")
    else:  # a class may hold a third of all rows
        salted = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = own.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return both.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "k", F.when(F.col("n") > 0, F.coalesce("root", "h")).alias("root"))
