"""Benchmark decontamination by a distributed positional inverted index.

The index holds the postings (document, position) of every training token that is a benchmark word. A window of a
test item is looked for from its rarest words on: their posting lists, each adjusted by the word's offset in the
window, are intersected, and the windows that remain are compared whole with the document. Everything is relational;
only benchmark-sized tables are broadcast, after a count of their rows.

Edge cases: a null or empty text has no words, no hits and no items; an item of fewer words than a window is one
window; items that repeat a text are all reported; repeated document rows each get their row; empty tables give no
rows or no hits; columns other than doc_id, text and item_id, text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslab.llm.common import ascii_lower, few_files, files_for, let, materialise, maybe_broadcast, text_of

#: What separates words: ASCII but digits and letters (A-Z are gone by then).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rarest words of a window whose lists are intersected before the whole comparison.
ANCHORS = 3


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), SEPARATORS), lambda w: w != "")


def windows_of(items: DataFrame, width: int = 10) -> DataFrame:
    """Every distinct window of the items: w (id), words, items (ids as strings, sorted)."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(text_of()).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - width, F.lit(0)))
    cut = words.select("item_id", F.explode(starts).alias("i"), "ws").select("item_id", F.slice("ws", F.col("i") + 1, width).alias("words"))
    return cut.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("items")).withColumn("w", F.monotonically_increasing_id())


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings (term, doc_id, k, pos) of the vocabulary's words (word, term) in all documents; k is a hash of the text.

    Each row also posts term -1 at the position after its last word, which keeps its number of words.
    """
    listed = docs.select("doc_id", text_of().alias("x")).select("doc_id", F.xxhash64("x").alias("k"), words_of(F.col("x")).alias("ws"))
    posted = listed.select("doc_id", "k", F.posexplode(F.concat("ws", F.array(F.lit("")))).alias("pos", "word"))
    end = vocabulary.sparkSession.sql("SELECT '' AS word, -1L AS term")
    return posted.join(maybe_broadcast(vocabulary.unionByName(end)), "word").select("term", "doc_id", "k", "pos")


def _anchors(windows: DataFrame, vocabulary: DataFrame, counts: DataFrame) -> DataFrame:
    """w, j (0 rarest), term and offset of the ANCHORS rarest words of each window that the corpus could hold at all."""
    placed = windows.select("w", F.posexplode("words").alias("offset", "word")).join(vocabulary, "word").join(counts, "term", "left")
    ranked = placed.groupBy("w").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset"))).alias("a"))
    return ranked.where(F.col("a")[0]["n"] > 0).select("w", F.posexplode(F.slice("a", 1, ANCHORS)).alias("j", "a")).select("w", "j", "a.term", "a.offset")


def candidates(index: DataFrame, windows: DataFrame, vocabulary: DataFrame, slop: int = 0) -> DataFrame:
    """(doc_id, k, start, w): where the rarest words of a window stand at their offsets, give or take slop.

    The lists are intersected by one grouping: a start that each of a window's anchors votes for.
    """
    counts = index.where("term >= 0").groupBy("term").agg(F.count("*").alias("n"))
    anchors = materialise(_anchors(windows, vocabulary, counts), "anchors", few_files(windows.count(), 10_000))
    need = maybe_broadcast(anchors.groupBy("w").agg(F.count("*").cast("int").alias("need")))
    hits = index.join(maybe_broadcast(anchors), "term").select("doc_id", "k", (F.col("pos") - F.col("offset")).alias("start"), "w", "j")
    if slop:
        shifts = F.when(F.col("j") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(-slop), F.lit(slop)))
        hits = hits.withColumn("by", F.explode(shifts)).withColumn("start", F.col("start") + F.col("by"))
    hits = hits.where("start >= 0")
    votes = hits.groupBy("doc_id", "k", "start", "w").agg(F.bit_or(F.expr("shiftleft(1, j)")).alias("votes"))
    return votes.where("votes % 2 = 1").join(need, "w").where("votes = shiftleft(1, need) - 1").select("doc_id", "k", "start", "w")


def _with_texts(docs: DataFrame, found: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, k, text x and the candidates c (start, words, items) of each document that has any.

    Only the documents' keys may be broadcast; their lists of windows, which may be long, meet them by a shuffle of
    the texts that have candidates.
    """
    listed = found.join(maybe_broadcast(windows), "w").select("doc_id", "k", "start", "words", "items").distinct()
    listed = listed.groupBy("doc_id", "k").agg(F.collect_list(F.struct("start", "words", "items")).alias("c")).withColumnsRenamed({"doc_id": "id", "k": "key"})
    keys = maybe_broadcast(materialise(found.select(F.col("doc_id").alias("id"), F.col("k").alias("key")).distinct(), "keys", few_files(found.count())))
    same = F.col("k").eqNullSafe(F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id"))
    texts = docs.select("doc_id", text_of().alias("x")).withColumn("k", F.xxhash64("x")).join(keys, same, "left_semi")
    return texts.join(listed, same).drop("id", "key")


def exact_matches(docs: DataFrame, found: DataFrame, windows: DataFrame) -> DataFrame:
    """The candidates whose window stands in the document word for word: doc_id, k, hits (start, n), items of each document."""
    both = _with_texts(docs, found, windows)
    holds = let(words_of(F.col("x")), lambda ws: F.filter("c", lambda c: F.slice(ws, c["start"] + 1, F.size(c["words"])) == c["words"]))
    kept = both.select("doc_id", "k", holds.alias("c")).where(F.size("c") > 0)
    spans = F.array_sort(F.array_distinct(F.transform("c", lambda c: F.struct(c["start"].alias("start"), (c["start"] + F.size(c["words"])).alias("end")))))
    kept = kept.select("doc_id", "k", spans.alias("hits"), F.array_sort(F.array_distinct(F.flatten("c.items"))).alias("items"))
    return kept.dropDuplicates(["doc_id", "k"])


def covered(spans: Column) -> Column:
    """How many positions sorted (start, end) spans cover."""
    step = lambda a, x: F.struct(F.greatest(a["to"], x["end"]).alias("to"), (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["to"], x["start"]))).alias("n"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")), step)["n"].cast("long")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs, and k, hits (word spans)."""
    few = few_files(items.count(), 10_000)
    windows = materialise(windows_of(items, width), "windows", few)
    vocabulary = materialise(windows.select(F.explode("words").alias("word")).distinct().withColumn("term", F.monotonically_increasing_id()), "vocabulary", few)
    index = materialise(build_index(docs, vocabulary), "postings", files_for(docs.sparkSession, docs.count(), 20_000))
    found = materialise(candidates(index, windows, vocabulary), "candidates", files_for(docs.sparkSession, docs.count(), 20_000))
    hits = exact_matches(docs, found, windows).withColumnsRenamed({"doc_id": "id", "k": "key"})
    rows = index.where("term = -1").select("doc_id", "k", F.col("pos").cast("long").alias("n_words"))
    both = rows.join(hits, F.col("k").eqNullSafe(F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce(covered(F.col("hits")), F.lit(0).cast("long"))
    return both.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "k", "hits")


def proximity_matches(docs: DataFrame, items: DataFrame, width: int = 10, slop: int = 2) -> DataFrame:
    """doc_id, start, items: places where every word of a window stands within slop words of its offset.

    Offsets count from the window's rarest word, which sets the start. A window of which a word is missing there, or
    has moved further, is no match.
    """
    few = few_files(items.count(), 10_000)
    windows = materialise(windows_of(items, width), "windows", few)
    vocabulary = materialise(windows.select(F.explode("words").alias("word")).distinct().withColumn("term", F.monotonically_increasing_id()), "vocabulary", few)
    index = materialise(build_index(docs, vocabulary), "postings", files_for(docs.sparkSession, docs.count(), 20_000))
    found = materialise(candidates(index, windows, vocabulary, slop), "candidates")
    both = _with_texts(docs, found, windows)

    def near(ws: Column, c: Column) -> Column:
        def stands(o: Column) -> Column:
            low = F.greatest(c["start"] + o - slop, F.lit(0))
            return F.array_contains(F.slice(ws, low + 1, F.greatest(c["start"] + o + slop + 1 - low, F.lit(0))), F.get(c["words"], o))

        return F.forall(F.sequence(F.lit(0), F.size(c["words"]) - 1), stands)

    return both.select("doc_id", F.explode(let(words_of(F.col("x")), lambda ws: F.filter("c", lambda c: near(ws, c)))).alias("c")).select("doc_id", "c.start", "c.items").distinct()
