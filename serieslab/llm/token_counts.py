"""Token counts without materialising ids.

Pieces are counted once for each distinct pre-token of the corpus, as the tokenizer file's own normaliser and
pre-tokenizer cut them, then joined to each document's pre-token frequencies and summed. The `head` most frequent
pre-tokens go to every worker as a table of that bounded size; the rest are joined by a shuffle, so no vocabulary is
ever held whole in one place.

Edge cases: null text counts as empty (0 bytes, 0 tokens); special strings inside texts are one token each, as the
library has it by default; repeated rows each get their row; an empty table gives an empty result; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serieslab.llm.common import bounded_batches, materialise, trimming, worker_memo

#: Distinct pre-tokens after which a task hands on the counts it has.
FLUSH = 200_000
#: Letters that neither the normaliser nor the cut treat otherwise than re and str.lower do (NFC, one lower-case letter each).
LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e"
SIGNS = re.escape("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'")
PLAIN = f"{LETTERS}{SIGNS}0-9\t\n\r\x0b\x0c "


class Splitter:
    """A text's pre-tokens, as the file's normaliser and pre-tokenizer cut it.

    Latin letters, digits, ASCII signs and white space are cut by the file's own pattern here. Neither the normaliser
    nor the cut looks across a space, so stretches between spaces that hold any other character go through the library
    alone. Special strings are pre-tokens of their own; no other holds signs and letters side by side.
    """

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        self.special = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        self.at_special = re.compile("(" + ("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)") + ")")
        self.normalise, self.cut = self.tok.normalizer.normalize_str, self.tok.pre_tokenizer.pre_tokenize_str
        self.odd = re.compile(f"[^ ]*[^{PLAIN}][^ ]*")
        # The file's pattern, with the characters that plain text can have
        self.parts = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[{SIGNS}]+").findall
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the bytes that byte-level BPE writes as themselves
        chars = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in plain)}
        self.chars = chars  # byte -> the character that stands for it, where that is another
        self.byte = {chr(chars.get(b, b)): b for b in range(256)}

    def __call__(self, text: str) -> list[str]:
        if "<|" in text and self.at_special.search(text):
            parts = self.at_special.split(text)
            return [p for i, part in enumerate(parts) for p in ([part] if i % 2 else self.plain_cut(part))]
        return self.plain_cut(text)

    def plain_cut(self, text: str) -> list[str]:
        if not self.odd.search(text):
            return self.parts(text.lower())
        found = [p for chunk in self.odd.findall(text) for p in self.library_cut(chunk)]
        return found + self.parts(self.odd.sub(" ", text).lower())

    def library_cut(self, text: str) -> list[str]:
        return [bytes(map(self.byte.__getitem__, p)).decode() for p, _ in self.cut(self.normalise(text))]

    def pieces(self, pre: str) -> int:
        return 1 if pre in self.special else len(self.tok.model.tokenize(pre if pre.isascii() and pre.isprintable() else pre.encode().decode("latin-1").translate(self.chars)))


def _splitter(path: str | None) -> Splitter:
    return worker_memo(("pre-tokens", path), lambda: Splitter(path))


def vocabulary(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Every distinct pre-token, how often it occurs and how many pieces it has: (pre, n, pieces)."""

    def count(batches):
        cut = _splitter(tokenizer)
        seen: Counter[str] = Counter()
        out = lambda: pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["pre", "n"])
        for batch in batches:
            for text in batch.column(0):
                seen.update(cut(text.as_py() or ""))
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    def pieces(batches):
        cut = _splitter(tokenizer)
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([cut.pieces(p) for p in batch.column(0).to_pylist()], pa.int64())], names=["pre", "n", "pieces"])

    merged = docs.select(F.col("text").cast("string")).mapInArrow(trimming(count), "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n"))
    return merged.mapInArrow(trimming(pieces), "pre string, n long, pieces long")


def count_tokens(docs: DataFrame, limit: int = 2048, tokenizer: str | None = None, head: int = 100_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    vocab = materialise(vocabulary(docs, tokenizer), "vocabulary")
    common = {r["pre"]: r["pieces"] for r in vocab.orderBy(F.desc("n"), "pre").limit(head).select("pre", "pieces").toLocalIterator()}
    shared = spark.sparkContext.broadcast(common)
    kind = dict(docs.dtypes)["doc_id"]

    def split(batches):
        known, cut = shared.value, _splitter(tokenizer)
        rare = pa.list_(pa.struct([("pre", pa.string()), ("k", pa.int64())]))
        for batch in batches:
            sizes, sums, rest = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                sizes.append(len(text.encode()))
                total, tail = 0, []
                for pre, k in Counter(cut(text)).items():
                    p = known.get(pre)
                    if p is None:
                        tail.append({"pre": pre, "k": k})
                    else:
                        total += p * k
                sums.append(total)
                rest.append(tail)
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(rest, rare)], names=["doc_id", "n_bytes", "head", "rare"])

    rows = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(trimming(split), f"doc_id {kind}, n_bytes long, head long, rare array<struct<pre:string,k:long>>")
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "frequencies")
    rare = rows.select("row", F.inline("rare")).join(vocab.select("pre", "pieces"), "pre").groupBy("row").agg(F.sum(F.col("k") * F.col("pieces")).alias("tail"))
    n = F.col("head") + F.coalesce("tail", F.lit(0))
    return rows.drop("rare").join(rare, "row", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
