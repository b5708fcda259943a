"""Personal data, and the terms near it that give it away.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Information-theoretic sanitisation adds two
kinds of spans:

* terms: the corpus tells how often a word stands near a protected value and how often it occurs at all, so the
  pointwise mutual information PMI(value; term) can be held against the value's own information IC(value). A term with
  PMI >= share x IC discloses the value even where the value itself is gone, and is generalised to a placeholder.
* secrets: a key-like string discloses by itself. Runs of ASCII letters and digits that hold both have an information
  of their length x log2(36) bits under even odds; from SECRET_BITS on (20 characters) they are spans.

Probabilities are over the corpus's rows: those that hold the value, those that hold the term, and those that hold
both, however far apart. A pair is a candidate only if enough distinct contexts of the value hold the term, so a
passage that thousands of copies repeat is one context. Words are counted by one pre-aggregation over all rows; pairs
that would fall short even if the rarer of the two never stood without the other are dropped, and only the words of
the remaining pairs are looked for in the rows. Everything is DataFrame functions, and what is broadcast has been
measured.

Edge cases: null text is empty and has no spans; repeated rows each get their row and count each; an empty table gives
an empty result; columns other than doc_id and text are not read; of equal texts all rows get the same spans. Offsets
are code points, end exclusive. The patterns use possessive forms that match the same strings as the plain ones in
linear time and constant stack.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslab.llm.common import few_files, files_for, fresh, let, materialise, maybe_broadcast, text_of

# What counts as personal data, by kind, in the order of the report.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
SECRET = r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{%d,}+(?![A-Za-z0-9])"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

CHUNK = 256  # matches whose places are summed in one go
SPAN = "array<struct<start:int,end:int,x:string>>"
CONTEXT = 80  # code points on either side of a value in which terms are taken
SUPPORT = 3  # distinct contexts of a value that must hold the term
SHARE = 0.95  # of the value's information that a term has to give away
MIN_TERM = 4  # letters
SECRET_BITS = 100  # of information from which on a key-like string is a span of its own
#: Kinds that the method adds to the base ones.
ADDED = ("secret", "term")


def find_all(text: Column, pattern: Column | str, needed: Column) -> Column:
    """(start, end, x) of every match: the gaps between matches and the matches' lengths, summed up.

    Sums run in chunks of CHUNK matches, so that a text of very many matches is not copied once a match.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("x"))
    length = lambda z: F.char_length(z["gap"]) + F.coalesce(F.char_length(z["x"]), F.lit(0))

    def step(acc: Column, z: Column) -> Column:
        start = acc["at"] + F.char_length(z["gap"])
        end = start + F.coalesce(F.char_length(z["x"]), F.lit(0))
        out = F.when(z["x"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), z["x"].alias("x"))))
        return F.struct(end.alias("at"), out.alias("out"))

    def summed(all_: Column) -> Column:
        chunk = lambda c: F.slice(all_, c * CHUNK + 1, CHUNK)
        of = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int"))
        sizes = F.transform(of, lambda c: F.aggregate(chunk(c), F.lit(0), lambda a, z: a + length(z)))
        starts = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
        spans = lambda c, at: F.aggregate(chunk(c), F.struct(at.alias("at"), F.array().cast(SPAN).alias("out")), step)["out"]
        return F.when(F.size(all_) <= CHUNK, spans(F.lit(0), F.lit(0))).otherwise(let(starts, lambda s: F.flatten(F.transform(of, lambda c: spans(c, F.get(s, c))))))

    return F.when(needed, let(found, summed)).otherwise(F.array().cast(SPAN))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    """The valid spans of each kind."""
    n = lambda s: F.char_length(digits(s["x"]))
    some_digits = text.rlike("[0-9]")
    return {
        "email": find_all(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(find_all(text, IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]")), lambda s: s["x"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        "card": F.filter(find_all(text, CARD, some_digits & text.rlike(r"[0-9](?:[ -]?[0-9]){15}")), lambda s: n(s).between(16, 19) & F.call_function("luhn_check", digits(s["x"]))),
        "phone": F.filter(find_all(text, PHONE, F.contains(text, F.lit("+"))), lambda s: n(s).between(8, 15)),
    }


def words_of(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), lambda w: F.char_length(w) >= MIN_TERM)


def secret_spans(text: Column, bits: float = SECRET_BITS) -> Column:
    pattern = SECRET % math.ceil(bits / math.log2(36))
    return find_all(text, pattern, text.rlike(pattern))


def bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"], s["end"]))


def free_of(spans: Column, *taken: str) -> Column:
    """The spans that overlap none of the taken kinds' spans."""
    return F.filter(spans, lambda s: ~F.exists(F.concat(*taken), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, k (hash of the text) and the arrays of base spans and secrets, with the contexts around the base spans."""
    rows = docs.select("doc_id", text_of().alias("x")).withColumn("k", F.xxhash64("x"))
    rows = rows.select("doc_id", "k", "x", *(c.alias(kind) for kind, c in base_spans(F.col("x")).items()), secret_spans(F.col("x")).alias("secret"))

    def around(kind: str) -> Column:
        def one(s: Column) -> Column:
            left = F.greatest(s["start"] - CONTEXT, F.lit(0))
            # Whole words only: what the cut may have halved goes
            before = F.regexp_replace(F.substring(F.col("x"), left + 1, s["start"] - left), r"^\p{L}+", "")
            after = F.regexp_replace(F.substring(F.col("x"), s["end"] + 1, F.lit(CONTEXT)), r"\p{L}+$", "")
            return F.struct(F.concat(F.lit(f"{kind}:"), F.lower(s["x"])).alias("value"), F.concat_ws(" ", before, after).alias("context"))

        return F.transform(kind, one)

    contexts = F.when(sum((F.size(k) for k in KINDS), F.lit(0)) > 0, F.concat(*(around(k) for k in KINDS)))
    return rows.select("doc_id", "k", *(bare(F.col(k)).alias(k) for k in KINDS), bare(free_of(F.col("secret"), *KINDS)).alias("secret"), contexts.alias("contexts"))


def words_in(docs: DataFrame) -> DataFrame:
    """doc_id, k and term for each distinct word of each row."""
    return docs.select("doc_id", text_of().alias("x")).select("doc_id", F.xxhash64("x").alias("k"), F.explode(words_of(F.col("x"))).alias("term"))


def disclosing_terms(docs: DataFrame, detected: DataFrame, share: float = SHARE, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """(terms that disclose a value: term, share) and (the rows of the terms that might: term, doc_id, k)."""
    seen = detected.where("contexts is not null").select("doc_id", "k", F.inline("contexts"))
    near = seen.select("value", F.xxhash64("context").alias("c"), F.explode(words_of(F.col("context"))).alias("term"))
    pairs = near.distinct().groupBy("value", "term").agg(F.count("*").alias("support")).where(F.col("support") >= support)
    n = max(1, detected.count())
    files, some = few_files(n), files_for(docs.sparkSession, n, 20_000)
    pairs = materialise(pairs.select("value", "term"), "pairs", some)
    # m rows share an id and a text; a value counts once in each
    each = detected.where("contexts is not null").groupBy("doc_id", "k").agg(F.count("*").alias("m"), F.first("contexts").alias("contexts"))
    valued = materialise(each.select("doc_id", "k", "m", F.explode(F.array_distinct(F.transform("contexts", lambda c: c["value"]))).alias("value")), "valued", some)
    of_value = valued.groupBy("value").agg(F.sum("m").alias("n_value"))
    of_term = words_in(docs).groupBy("term").agg(F.count("*").alias("n_term"))
    ic = -F.log2(F.col("n_value") / n)
    # No pair has more rows in common than the rarer of its two has
    most = F.log2(F.lit(float(n)) / F.greatest("n_value", "n_term"))
    able = pairs.join(of_value, "value").where(ic > 0).join(of_term, "term").where(most >= share * ic - 1e-9)
    able = materialise(able, "able", some)
    terms = maybe_broadcast(materialise(able.select("term").distinct(), "able-terms", files))
    held = materialise(words_in(docs).join(terms, "term", "left_semi").distinct(), "occurrences", some)
    values = maybe_broadcast(materialise(able.select("value").distinct(), "able-values", files))
    left = valued.join(values, "value", "left_semi").withColumnsRenamed({"doc_id": "id", "k": "key"})
    both = left.join(held, F.col("k").eqNullSafe(F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")))
    both = both.join(maybe_broadcast(able.select("value", "term")), ["value", "term"], "left_semi").groupBy("value", "term").agg(F.sum("m").alias("n_both"))
    pmi = F.log2(F.col("n_both") * F.lit(float(n)) / (F.col("n_value") * F.col("n_term")))
    told = able.join(both, ["value", "term"]).groupBy("term").agg(F.max(pmi / ic).alias("share")).where(F.col("share") >= share)
    return materialise(told, "told", files), held


def find_spans(docs: DataFrame, share: float = SHARE, support: int = SUPPORT) -> DataFrame:
    """doc_id, k and arrays of (start, end) for each kind, for secrets and for the disclosing terms ("term") of each row."""
    detected = materialise(detect(docs), "detected", files_for(docs.sparkSession, docs.count(), 20_000))
    told, held = disclosing_terms(docs, detected, share, support)
    files = few_files(detected.count())
    hit = held.join(maybe_broadcast(told), "term").groupBy("doc_id", "k").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    hit = materialise(hit, "disclosing", files).withColumnsRenamed({"doc_id": "id", "k": "key"})
    same = F.col("k").eqNullSafe(F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id"))
    rows = docs.select("doc_id", text_of().alias("x")).withColumn("k", F.xxhash64("x")).join(maybe_broadcast(hit), same)
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    terms = rows.select("id", "key", bare(find_all(F.col("x"), pattern, F.lit(True))).alias("term")).dropDuplicates(["id", "key"])
    spans = detected.drop("contexts").join(maybe_broadcast(materialise(terms, "terms", files_for(docs.sparkSession, detected.count(), 20_000))), same, "left").drop("id", "key")
    found = F.coalesce("term", F.array().cast("array<struct<start:int,end:int>>"))
    return spans.withColumn("term", free_of(found, *KINDS, "secret"))


def report(spans: DataFrame) -> DataFrame:
    """The digest: counts, the hash of the base spans and the string of all spans; found says whether there is any."""
    said = lambda kind: F.transform(kind, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))
    base = F.concat(*(said(k) for k in KINDS))
    every = F.concat(base, *(said(k) for k in ADDED))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in (*KINDS, *ADDED)]
    return spans.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"), (F.size(every) > 0).alias("found"))


def sanitise(text: Column, spans: Column) -> Column:
    """text with each of the (start, end, kind) spans replaced by [KIND]; of overlapping spans the first (longest) stays."""
    start = lambda s: F.struct(s["start"], -s["end"], s["kind"])
    ordered = F.array_sort(F.transform(spans, start))

    def step(acc: Column, s: Column) -> Column:
        kept = s["start"] >= acc["at"]
        out = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        return F.struct(F.when(kept, -s["col2"]).otherwise(acc["at"]).alias("at"), F.when(kept, out).otherwise(acc["out"]).alias("out"))

    def end(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.greatest(F.char_length(text) - acc["at"], F.lit(0))))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.when(F.size(spans) > 0, F.aggregate(ordered, zero, step, end)).otherwise(text)


def sanitise_documents(docs: DataFrame, share: float = SHARE, support: int = SUPPORT) -> DataFrame:
    """docs, all columns and rows, with personal data, secrets and disclosing terms in text replaced by placeholders."""
    spans = find_spans(docs, share, support)
    kinded = lambda kind: F.transform(kind, lambda s: F.struct(s["start"], s["end"], F.lit(kind).alias("kind")))
    listed = F.concat(*(kinded(k) for k in (*KINDS, *ADDED)))
    id_, key, kept = fresh(docs, "id", "key", "spans")
    found = spans.select(F.col("doc_id").alias(id_), F.col("k").alias(key), listed.alias(kept)).where(F.size(kept) > 0).dropDuplicates([id_, key])
    found = maybe_broadcast(materialise(found, "found", few_files(docs.count())), 100_000)
    same = F.xxhash64(text_of()).eqNullSafe(F.col(key)) & F.col("doc_id").eqNullSafe(F.col(id_))
    clean = F.when(F.col(kept).isNull(), F.col("text")).otherwise(sanitise(text_of(), F.col(kept)))
    return docs.join(found, same, "left").withColumn("text", clean).select(*docs.columns)
