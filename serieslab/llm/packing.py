"""Best-fit packing by the sum-of-squares rule.

Documents become token pieces of at most `capacity` tokens; each piece goes to the open bin whose choice makes the sum
over all residual gaps of (number of open bins with that gap) squared the smallest.

At scale the rule needs nothing but how many pieces there are of each length, so the plan is made from that histogram
(at most `capacity` rows, whatever the input) and says which ranks of a length go to which bins. Pieces find their
rank by a salted window, hence no length that holds a third of all rows meets in one task.

Edge cases: null or empty text gives one piece of the end token alone; repeated rows are packed each on their own; an
empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from serieslab.llm.common import files_for, materialise, trimming, worker_memo

#: Space-led chunks that a worker remembers; as many again are kept from before the memo was last begun anew.
MEMO = 400_000
#: A space as byte-level BPE writes it.
SPACE = "\u0120"
#: A Latin word and signs after it, then maybe a line end, a word and signs.
WORDS = re.compile(r"([^\W\d_\u00b2\u00b3\u00b9\u00bc-\u00be\u0250-\U0010ffff]+)([.,;:!?%&$*#]*(?:\n(?=\w))?)(?:(?<=\n)([^\W\d_\u00b2\u00b3\u00b9\u00bc-\u00be\u0250-\U0010ffff]+)([.,;:!?%&$*#]*))?").fullmatch
#: Steps of the rule that the driver makes at most, about: pieces are placed in quanta beyond it.
STEPS = 200_000


class ChunkEncoder(dict):
    """Ids as the tokenizer file gives them, remembered for each space-led chunk of text.

    In a byte-level BPE a space before a non-space always begins a new pre-token, so a text cut before such spaces
    has the same ids as its chunks in turn. Texts with special strings, or with white space after a space, go to the
    tokenizer whole. As a mapping it gives the ids of a space and the chunk, or None where they can't be told from
    the chunk alone; a chunk of Latin words, signs and single line ends is put together from its pre-tokens.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.tokenize = self.tok.model.tokenize
        self.older: dict[str, bytes | None] = {}  # the chunks remembered before the last full memo
        self.signs: dict[str, bytes] = {}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the bytes that byte-level BPE writes as themselves
        self.bytes = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in plain)}

    def whole(self, text: str) -> bytes:
        return pack_ids(self.tok.encode(text, add_special_tokens=False).ids)

    def word(self, stem: str, lead: str = "") -> bytes:
        """Ids of Latin letters after `lead`, a space in byte characters or nothing: one pre-token, given to the model as its byte characters."""
        chars = lead + (stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.bytes))
        return pack_ids([t.id for t in self.tokenize(chars)])

    def sign(self, x: str) -> bytes:
        """Ids of a run of SIGNS, maybe with a line end after it."""
        ids = self.signs.get(x)
        if ids is None:
            ids = self.signs[x] = self.whole(x)
            if len(self.signs) > MEMO:
                self.signs.clear()
        return ids

    def __missing__(self, chunk: str) -> bytes | None:
        ids = self.older.get(chunk)
        if ids is None:
            parts = WORDS(chunk)
            if parts:
                stem, signs, line, signs_after = parts.groups()
                ids = self.word(stem, SPACE) if stem == chunk else self[stem] + (self.sign(signs) if signs else b"")
                if line:
                    ids += self.word(line) + (self.sign(signs_after) if signs_after else b"")
            elif chunk and not chunk[0].isspace():
                ids = self.whole(" " + chunk)
        if len(self) >= MEMO:
            self.older = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text or any(s in text for s in self.special):
            return self.whole(text)
        first, *rest = text.split(" ")
        try:
            ids = b"".join(map(self.__getitem__, rest))
        except TypeError:  # a chunk of no ids of its own
            return self.whole(text)
        return (self.whole(first) if first else b"") + ids


_SHORT = [struct.Struct(f"<{n}I").pack for n in range(32)]


def pack_ids(ids: list[int]) -> bytes:
    return _SHORT[len(ids)](*ids) if len(ids) < 32 else struct.pack(f"<{len(ids)}I", *ids)


def _encoder(path: str | None) -> ChunkEncoder:
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    return worker_memo(("chunks", path), lambda: ChunkEncoder(path))


def _piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first is shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids of each piece of each document."""

    def run(batches):
        enc = _encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                blob = enc.encode(text.as_py() or "") + end
                for k, (s, n) in enumerate(_piece_bounds(len(blob) // 4, capacity)):
                    part = blob[4 * s : 4 * (s + n)]
                    for out, x in zip(rows, (doc, k, s, n, zlib.crc32(part), np.frombuffer(part, "<u4") if with_ids else None), strict=True):
                        out.append(x)
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            yield pa.record_batch([pa.array(x, t) for x, t in islice(zip(rows, kinds, strict=True), 5 + with_ids)], names=names[: 5 + with_ids])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(trimming(run), schema)


def plan_bins(counts: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Where each rank of each length goes, by the sum-of-squares rule.

    counts[s] is the number of pieces of length s < capacity. Lengths are placed in falling order; a piece goes to the
    open bins' gap for which the sum of squares becomes smallest, and opens a bin only if none can hold it. Returns
    arrays sorted by (length, rank): the ranks rank..rank+n of a length go to bins bin..bin+n at `offset`.
    """
    quantum = max(1, int(counts.sum()) // STEPS)
    open_bins = np.zeros(capacity + 1, np.int64)  # by gap
    spans: list[list[list[int]]] = [[] for _ in range(capacity + 1)]  # of bins, by gap: [first, n]
    out: list[tuple[int, int, int, int, int]] = []
    n_bins = 0
    for s in np.flatnonzero(counts)[::-1].tolist():
        given, left = 0, int(counts[s])
        while left > 0:
            # Half the change of the sum, for each gap from s on
            cost = np.where(open_bins[s:] > 0, open_bins[: capacity + 1 - s] - open_bins[s:] + 1.0, np.inf)
            if open_bins[s]:
                cost[0] = 0.5 - open_bins[s]
            k = int(cost.argmin())
            best, gap, new = cost[k], s + k, not np.isfinite(cost[k])
            if new:  # as many bins as the rest needs, if these pieces fit one another too
                gap, n = capacity, -(-left // (capacity // s))
            else:
                cost[k] = np.inf
                second = cost.min()
                n = left if not np.isfinite(second) else max(quantum, int((second - best) // 2) + 1)
                n = min(n, left, int(open_bins[gap]))
            left -= n
            while n:
                if new:
                    first, m, n_bins = n_bins, n, n_bins + n
                else:
                    top = spans[gap][-1]
                    m = min(n, top[1])
                    top[1] -= m
                    first = top[0] + top[1]
                    if not top[1]:
                        spans[gap].pop()
                    open_bins[gap] -= m
                out.append((s, given, first, capacity - gap, m))
                if gap > s:
                    spans[gap - s].append([first, m])
                    open_bins[gap - s] += m
                given += m
                n -= m
    table = np.array(sorted(out), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "bin", "offset", "n"), table.T, strict=True)) | {"n_bins": np.array(n_bins)}


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None, salts: int = 64, with_ids: bool = False) -> DataFrame:
    """token_pieces() with sequence_id and offset, and the ids if asked for. Pieces of the full capacity get (negative) sequences of their own."""
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, capacity, end_id, tokenizer, with_ids), "pieces", files_for(spark, docs.count(), 10_000))
    salted = pieces.where(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))  # at most capacity x salts rows
    cells = sorted((r["length"], r["salt"], r["n"]) for r in sizes.toLocalIterator())
    counts = np.zeros(capacity + 1, np.int64)
    base = np.zeros((capacity + 1, salts), np.int64)
    for length, salt, n in cells:
        base[length, salt] = counts[length]
        counts[length] += n
    plan = plan_bins(counts, capacity)
    shared = spark.sparkContext.broadcast((plan, base))

    def place(batches):
        plan, base = shared.value
        key = plan["length"] * (1 << 44) + plan["rank"]
        for batch in batches:
            table = dict(zip(batch.schema.names, batch.columns, strict=True))
            length, salt, rank = (table[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "salt", "rank"))
            rank = base[length, salt] + rank - 1
            at = np.searchsorted(key, length * (1 << 44) + rank, "right") - 1
            yield pa.record_batch([*(table[c] for c in names), pa.array(plan["bin"][at] + rank - plan["rank"][at]), pa.array(plan["offset"][at])], names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")).cast("long"))
    kind = dict(docs.dtypes)["doc_id"]
    placed = ranked.select(*names, "salt", "rank").mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, " + "ids array<long>, " * with_ids + "sequence_id long, offset long")
    full = pieces.where(F.col("length") == capacity).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)


def sequences(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, doc_ids (one per token). A sequence is bounded by the capacity."""
    placed = materialise(pack(docs, capacity, end_id, tokenizer, with_ids=True), "packed")  # ids travel with their piece: no key tells repeated rows apart
    part = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(part.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.flatten(F.transform("p", lambda x: F.array_repeat(x["doc_id"], F.size(x["ids"])))).alias("doc_ids"))
