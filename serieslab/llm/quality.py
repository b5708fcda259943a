"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded (hashed word counts and simple shape
statistics, then a learned tanh layer); gated attention learns from document labels alone how much each passage tells,
and the attention-weighted mean of the encodings is scored. Training sees a bounded sample of labelled rows (MAX_DOCS
documents and MAX_BYTES of text, taken in the order of a hash of doc_id); scoring sees every word of every document.

Only the text is an input: labels, lang, source and doc_id never are.

Edge cases: a null or empty text is one empty passage and gets that passage's score; without labelled rows of both
classes every score is the share of label 1 (0.5 without any); labels that repeat a doc_id count once (the largest);
an empty table gives an empty result; repeated rows each get their row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serieslab.llm.common import bounded_batches, trim, trimming, worker_memo

PASSAGE = 64
HASHED = 512
STATS = 10
MAX_DOCS = 5000
MAX_BYTES = 32 << 20
HIDDEN, GATES = 32, 16
THRESHOLD = 0.3
MEMO = 120_000  # words that a worker remembers


class Words(dict):
    """word -> row of `table`: hash bucket, length, digits, capitals, other signs, non-ASCII characters."""

    def __init__(self) -> None:
        super().__init__()
        self.table = np.zeros((1024, 6), np.int32)

    def __missing__(self, w: str) -> int:
        n = len(self)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        digits, capitals, letters = sum(map(str.isdigit, w)), sum(map(str.isupper, w)), sum(map(str.isalpha, w))
        self.table[n] = zlib.crc32(w.strip(".,;:!?").lower().encode()) % HASHED, len(w), digits, capitals, len(w) - letters - digits, 0 if w.isascii() else sum(c > "\x7f" for c in w)
        self[w] = n
        return n


def features(text: str | None) -> np.ndarray:
    """One row of HASHED + STATS numbers for each passage."""
    known = worker_memo("words", Words)
    if len(known) > MEMO:
        known.clear()
    ws = (text or "").split()
    n = len(ws)
    if not n:
        return np.zeros((1, HASHED + STATS), np.float32)
    ids = np.fromiter(map(known.__getitem__, ws), np.int64, n)
    rows = -(-n // PASSAGE)
    at = np.arange(n) // PASSAGE
    t = known.table[ids]
    x = np.empty((rows, HASHED + STATS), np.float32)
    size = np.bincount(at, minlength=rows)
    x[:, :HASHED] = np.log1p(np.bincount(at * HASHED + t[:, 0], minlength=rows * HASHED).reshape(rows, HASHED)) / np.sqrt(size)[:, None]
    per = lambda v: np.bincount(at, v, minlength=rows) / size
    distinct = np.bincount(np.unique(at * (1 << 32) + ids) >> 32, minlength=rows) / size
    again = np.r_[0, (ids[1:] == ids[:-1]) & (at[1:] == at[:-1])]
    sign = t[:, 4] == t[:, 1]
    stats = (per(t[:, 1]) / 8, per(t[:, 2]), per(t[:, 3]), per(t[:, 4]), per(t[:, 5]), distinct, per(again), per(sign), per(t[:, 1] > 12), np.log1p(size) / 4)
    x[:, HASHED:] = np.stack(stats, axis=1)
    return x


def forward(model: dict, x: np.ndarray, starts: np.ndarray) -> tuple:
    """Scores of bags whose passages begin at `starts` in x, and what the gradient needs."""
    h = np.tanh((x - model["mean"]) / model["scale"] @ model["W"] + model["b"])
    v, u = np.tanh(h @ model["V"]), 1 / (1 + np.exp(-(h @ model["U"])))
    e = (v * u) @ model["a"]
    sizes = np.diff(np.r_[starts, len(x)])
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
    weight = e / np.repeat(np.add.reduceat(e, starts), sizes)
    z = np.add.reduceat(weight[:, None] * h, starts)
    score = 1 / (1 + np.exp(-np.clip(z @ model["w"] + model["c"], -30, 30)))
    return score, (h, v, u, weight, z, sizes)


def fit(bags: list[np.ndarray], y: np.ndarray, epochs: int = 25, batch: int = 64, rate: float = 0.004, decay: float = 1e-4, seed: int = 5) -> dict:
    """Adam on the documents' log loss."""
    rng = np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():
        model = init(rng)
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return model | {"w": np.zeros(HIDDEN, np.float32), "c": np.float32(np.log(share / (1 - share)))}
    model = init(rng)
    some = np.concatenate([b[:64] for b in bags[:1000]])
    model["mean"], model["scale"] = some.mean(axis=0), some.std(axis=0) + 0.05
    names = ("W", "b", "V", "U", "a", "w", "c")
    m, s, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            x = np.concatenate([bags[j] for j in pick])
            starts = np.cumsum([0, *(len(bags[j]) for j in pick[:-1])])
            p, (h, v, u, weight, z, sizes) = forward(model, x, starts)
            g = (p - y[pick]) / len(pick)
            gz = np.repeat(np.outer(g, model["w"]), sizes, axis=0)
            gw = (gz * h).sum(axis=1)
            ge = weight * (gw - np.repeat(np.add.reduceat(weight * gw, starts), sizes))
            gv, gu = ge[:, None] * u * model["a"] * (1 - v * v), ge[:, None] * v * model["a"] * u * (1 - u)
            gh = (weight[:, None] * gz + gv @ model["V"].T + gu @ model["U"].T) * (1 - h * h)
            grad = {"W": ((x - model["mean"]) / model["scale"]).T @ gh + decay * model["W"], "b": gh.sum(axis=0), "V": h.T @ gv, "U": h.T @ gu, "a": (v * u).T @ ge, "w": z.T @ g, "c": g.sum()}
            step += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                s[k] = 0.999 * s[k] + 0.001 * grad[k] ** 2
                model[k] = (model[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def init(rng: np.random.Generator) -> dict:
    d = HASHED + STATS
    normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    return {"mean": np.zeros(d, np.float32), "scale": np.ones(d, np.float32), "W": normal(d, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": normal(HIDDEN, GATES), "U": normal(HIDDEN, GATES), "a": normal(GATES), "w": normal(HIDDEN), "c": np.float32(0)}


def held_out(doc_id) -> F.Column:
    """Whether crc32(doc_id as text) mod 5 is 0: such rows are never learned from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> dict:
    """A model of the label, from rows that are not held out."""
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("y"))
    # Ids in the order of a hash, so that the sample depends on neither files nor partitions; max_docs bounds it
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    # Of texts that share an id the least is learned from, so that it depends on neither files nor partitions
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    bags, y, size = [], [], 0
    for r in rows.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").select("text", "y").toLocalIterator():
        size += len((r["text"] or "").encode())
        if size > max_bytes:
            break
        bags.append(features(r["text"]))
        y.append(r["y"])
    model = fit(bags, np.array(y, np.float32))
    del bags
    trim()  # the driver, too, gives back what the sample took
    return model


def score_batch(model: dict, texts: pa.Array) -> np.ndarray:
    """The score of each text; passages are taken in runs of bounded size."""
    out, bags, held = [], [], 0
    for k, text in enumerate(texts):
        bags.append(features(text.as_py()))
        held += len(bags[-1])
        if held > 4096 or k == len(texts) - 1:
            out.append(forward(model, np.concatenate(bags), np.cumsum([0, *map(len, bags[:-1])]))[0])
            bags, held = [], 0
    return np.concatenate(out).astype(np.float64) if out else np.zeros(0)


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(score_batch(shared.value, batch.column(1)), pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(trimming(run), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all columns, that the model does not reject."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(score_batch(shared.value, batch.column(at)) >= threshold))

    return docs.mapInArrow(trimming(run), docs.schema)
