"""The operators against brute force, round trips and held-out labels, with the awkward inputs of each."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from serieslab.llm import chat, decontaminate, embedding_dedup, jaccard_join, packing, pii, quality, queries, sharding, token_counts, warc
from serieslab.llm.common import connected_components

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())
rng = random.Random(4)
VOCAB = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]


def prose(n: int) -> str:
    return " ".join(rng.choice(VOCAB) for _ in range(n))


LONG = prose(6000)
NEAR = prose(120)
TEXTS = [None, "", " ", "\n\t", "one", "Two Words", "a b c d", "  lead  and   runs \n of\tspace  ", "<|endoftext|> x<|startoftext|>", LONG, LONG + " tail", NEAR, NEAR, NEAR + " more", NEAR.upper(), *(prose(rng.randint(5, 200)) for _ in range(40)), "é" * 5000, "z" * 4000, "it's we'll 12 34 5.6, (x) ¿qué?"]
ROWS = [(i, t, "en", "s", 0, 1.5) for i, t in enumerate(TEXTS)] + [(11, NEAR, "en", "s", 0, 1.5), (None, "Two Words", None, None, None, None)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"  # score: a name that operators use too


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs, capacity=128).collect()
    want = {}
    for doc, text, *_ in ROWS:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 128 or 128
        cuts = [0, *range(min(first, len(ids)), len(ids), 128), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want.setdefault((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())), 0)
            want[doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    have = {}
    for r in got:
        key = (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
        have[key] = have.get(key, 0) + 1
    assert have == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    total = sum(r["length"] for r in got)
    assert len(bins) <= 1.1 * -(-total // 128) + 2
    assert packing.pack(empty).count() == 0


def test_packed_sequences_hold_the_ids(docs):
    some = docs.where("doc_id between 15 and 30")
    seqs = packing.sequences(some, capacity=64).collect()
    assert sum(len(r["ids"]) for r in seqs) == sum(r["length"] for r in packing.pack(some, capacity=64).collect())
    assert all(len(r["ids"]) == len(r["doc_ids"]) <= 64 for r in seqs)


def test_sequences_and_shards_hold_every_row(spark, tmp_path):
    rows = [(i % 7 if i % 3 else None, f"{i % 5} some words of text " * (1 + i % 4)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    packed, seqs = packing.pack(df, capacity=32).collect(), packing.sequences(df, capacity=32).collect()
    owners = [(d, n) for r in seqs for d, n in zip(r["doc_ids"], r["ids"], strict=True)]
    assert len(owners) == sum(r["length"] for r in packed) and all(len(r["ids"]) <= 32 for r in seqs)
    assert sum(n == 2 for _, n in owners) == 60 and sum(n == 2 for d, n in owners if d is None) == 20
    sharding.write_shards(df, f"{tmp_path}/shards", 4)
    assert sorted((r["doc_id"] or -1, r["text"]) for r in spark.read.parquet(f"{tmp_path}/shards").collect()) == sorted((i or -1, t) for i, t in rows)


def test_plan_places_every_rank_once():
    counts = np.zeros(101, int)
    for s in np.random.default_rng(1).integers(1, 100, 5000):
        counts[s] += 1
    plan = packing.plan_bins(counts, 100)
    for s in range(1, 100):
        of = plan["length"] == s
        ranks = np.concatenate([np.arange(r, r + n) for r, n in zip(plan["rank"][of], plan["n"][of], strict=True)]) if of.any() else []
        assert sorted(ranks) == list(range(counts[s]))


@pytest.mark.parametrize("head", [100_000, 10])
def test_token_counts(docs, empty, head):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs, limit=50, head=head).collect())
    want = sorted((i or -1, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 50) for i, t, *_ in ROWS)
    assert got == want
    assert token_counts.count_tokens(empty).count() == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def valid(kind: str, x: str) -> bool:
    d = re.sub("[^0-9]", "", x)
    return {"email": True, "ip": all(int(p) <= 255 for p in x.split(".")) if kind == "ip" else None, "card": 16 <= len(d) <= 19 and luhn(d or "0"), "phone": 8 <= len(d) <= 15}[kind]


PRIVATE = [None, "", "a@b.c_d@e.f x@y", "mail a.b+c@d-e.co.uk, b@c@d.e 😀 z@z.zz", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 0000000000000000000", "+1 (363) 555-6578 +44 20 7946 0958 0 +1", "9" * 5000, "1 " * 4000, "a" * 30000 + "@" + "b.c", "😀 +12345678 é 10.0.0.1"]


def test_base_spans_equal_the_plain_patterns(spark):
    got = {r["doc_id"]: r for r in pii.report(pii.find_spans(spark.createDataFrame(list(enumerate(PRIVATE)), "doc_id long, text string"))).collect()}
    for i, text in enumerate(PRIVATE):
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if valid(k, m[0])]
        assert got[i]["spans"] == ",".join(spans)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert got[i]["n_email"] == sum(s.startswith("email") for s in spans)


def test_disclosing_terms_are_found_and_replaced(spark, empty):
    rows = [(i, f"{prose(30)} zaphod wrote {'x%d@corp.org' % (i % 3)} {prose(30)} {i}") for i in range(12)]
    rows = [(i, t.replace("zaphod", "zaphod" if i % 3 == 0 else "someone")) for i, t in rows] + [(i, f"{prose(60)} someone") for i in range(12, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise_documents(df).collect()}
    assert clean.keys() == {i for i, _ in rows}
    assert all("@" not in t for t in clean.values())
    assert "zaphod" not in clean[0] and "[TERM]" in clean[0] and "[EMAIL]" in clean[0]
    assert "someone" in clean[30]
    assert pii.sanitise_documents(empty).columns == empty.columns and pii.report(pii.find_spans(empty)).count() == 0


def test_disclosing_terms_in_groups_of_copies(spark):
    # Three contexts, each in 30 copies; the term stands within the window in each, far from the value in some more
    texts = [f"{prose(20)} zaphod wrote x@corp.org {prose(20)}" for _ in range(3)] + [f"zaphod {prose(60)} x@corp.org {prose(20)}" for _ in range(5)]
    rows = [(None if i == 0 else i, texts[i % 8]) for i in range(240)] + [(1, texts[1])] * 5 + [(1000 + i, prose(60)) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    told, _ = pii.disclosing_terms(df, pii.detect(df))
    assert {r["term"]: round(r["share"], 9) for r in told.collect()}["zaphod"] == 1
    assert not [t for t in pii.sanitise_documents(df).collect() if "zaphod" in t["text"]]


def brute_windows(items, rows):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for i, t in items:
        ws = word.findall((t or "").translate(LOWER))
        for j in range(max(len(ws) - 10, 0) + 1 if ws else 0):
            windows.setdefault(tuple(ws[j : j + 10]), set()).add(str(i))
    for doc, text, *_ in rows:
        ws, hit, found = word.findall((text or "").translate(LOWER)), set(), set()
        for w, who in windows.items():
            for j in range(len(ws) - len(w) + 1):
                if tuple(ws[j : j + len(w)]) == w:
                    hit |= set(range(j, j + len(w)))
                    found |= who
        yield (doc or -1, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))


def test_decontamination(spark, docs, empty):
    items = [(10, " ".join(NEAR.split()[20:45])), (2, " ".join(NEAR.split()[20:45])), (3, "two, WORDS"), (4, None), (5, "..."), (6, " ".join(LONG.split()[500:512])), (7, prose(30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.decontaminate(docs, bench).collect())
    assert got == sorted(brute_windows(items, ROWS))
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert not decontaminate.decontaminate(docs, bench.where("item_id < 0")).where("contaminated").count()


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma x delta epsilon zeta eta theta iota kappa"), (2, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.proximity_matches(docs, bench, slop=1).collect()} == {1}


def test_proximity_holds_every_word(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    # The rarest words are the first three; the commoner ones stand in the last document as well
    rows = [(1, " ".join(words)), (2, " ".join(words[:3] + ["x"] * 7)), (3, " ".join(words[:3] + ["x"] + words[3:])), (4, " ".join(words[:3] + ["x"] * 4 + words[3:])), (5, " ".join(words[3:] * 3))]
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.proximity_matches(docs, bench, slop=1).collect()} == {1, 3, None}


def test_quality_learns_and_scores_everything(spark, docs, empty):
    good = [(i, prose(150)) for i in range(200)]
    bad = [(i, " | ".join(["buy"] * 60)) for i in range(200, 300)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(300)], "doc_id long, quality int")
    model = quality.train(df, labels)
    held = [r for r in quality.score(df, model).collect() if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == (r["doc_id"] < 200) for r in held]) > 0.95
    every = quality.score(docs, model).collect()
    assert len(every) == len(ROWS) and all(0 <= r["score"] <= 1 for r in every)
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.score(empty, quality.train(empty, labels)).count() == 0
    assert quality.train(docs, labels.where("quality = 1")) is not None


def test_attention_gradient():
    r = np.random.default_rng(0)
    bags = [r.standard_normal((k, quality.HASHED + quality.STATS)).astype(np.float32) for k in (1, 3, 2)]
    model = quality.fit(bags, np.array([0, 1, 0], np.float32), epochs=60, rate=0.01)
    p, (_, _, _, weight, _, _) = quality.forward(model, np.concatenate(bags), np.array([0, 1, 4]))
    assert p[1] > 0.9 > 0.1 > p[0] and weight[1:4].sum() == pytest.approx(1, abs=1e-5)


def test_warc_round_trip(spark):
    pages = [(1, "http://a", "same"), (5, "http://b", "same"), (3, None, "same"), (2, "http://c\r\nx", None), (4, "u", ""), (7, "v", "é" * 3000), (None, "w", "same"), (8, "x", "two"), (8, "x", "two")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or -1) for r in warc.round_trip(df).collect())
    best = {}
    for p, _, h in pages:
        best[h or ""] = max(best.get(h or "", -1), p or -1)
    want = [(p or -1, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if (p or -1) == best[h or ""] else "revisit", -1 if (p or -1) == best[h or ""] else best[h or ""]) for p, _, h in pages]
    assert got == sorted(want)
    assert warc.round_trip(df.where("page_id = 99")).count() == 0
    planned = warc.plan_revisits(df, min_bytes=4)
    assert planned.where("refers_to is not null").count() == 3


@pytest.mark.parametrize("shards", [40, 4])
def test_sharding(docs, empty, shards):
    got = sharding.shard_by_bytes(docs, shards).collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted((i or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    largest, mean = max(r["size"] for r in got), sum(r["size"] for r in got) / shards
    assert all(sum(r["size"] for r in x) <= mean + largest for x in by.values())
    assert sharding.shard_by_bytes(empty).count() == 0


def test_one_text_over_many_shards(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("x" * 100)).otherwise(F.concat(F.lit("y" * 90), F.col("id").cast("string"))).alias("text"))
    sizes = [r["s"] for r in sharding.shard_by_bytes(df, 10).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) < 300


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        ws = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        s = frozenset(tuple(ws[k : k + 5]) for k in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)] if ws else [])
        sets.setdefault(i, s)
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                x, y = sets[a], sets[b]
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    root[b] = min(root[a], root[b])
    return {i: (len(sets[i]), root[i]) for i in ids}


def near_rows():
    base = [prose(n) for n in (6, 31, 33, 64, 130, 300, 700, 1500)]
    rows = []
    for t in base:
        ws = t.split()
        for k in range(6):
            cut = ws[:]
            for _ in range(rng.randint(0, max(1, len(ws) // 30))):
                cut[rng.randrange(len(cut))] = "changed%d" % rng.randrange(10**6)
            rows.append(" ".join(cut[: len(cut) - rng.randint(0, len(cut) // 6)]))
    return rows


def test_jaccard_join(spark, docs, empty, monkeypatch):
    rows = [(i, t) for i, t in enumerate([*near_rows(), *TEXTS[:20]])]
    for hot in (64, 2):  # with 2, every shared block travels as a hot one
        monkeypatch.setattr(jaccard_join, "HOT", hot)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
        assert got == brute_components(rows)
    assert jaccard_join.components(docs).count() == len(ROWS)
    assert jaccard_join.components(empty).count() == 0


def joined(spark, monkeypatch, rows):
    """Components by id, and the most rows of each scratch table that the join made."""
    made, keep = {}, jaccard_join.materialise

    def counted(df, name, *args, **kw):
        out = keep(df, name, *args, **kw)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(jaccard_join, "materialise", counted)
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}, made


@pytest.mark.parametrize("tile", [512, 2])
def test_pairs_of_a_family_do_not_become_rows(spark, monkeypatch, tile):
    draw = random.Random(7)
    base, rows = [f"word{draw.randrange(10**9)}" for _ in range(60)], []
    for i in range(100):  # of near copies of one text, half are near by sketch but hardly similar
        ws = base[:]
        for at in draw.sample(range(60), 1 if i % 2 else 2):
            ws[at] = f"changed{draw.randrange(10**9)}"
        rows.append((i, " ".join(ws)))
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    got, made = joined(spark, monkeypatch, rows)
    assert got == brute_components(rows)
    assert max(n for name, n in made.items() if name not in ("blocks", "kept", "in_blocks")) <= 2 * len(rows)


def test_a_family_of_similar_texts_has_less_edges_than_texts(spark):
    draw = random.Random(9)
    base, rows = [f"word{draw.randrange(10**9)}" for _ in range(150)], []
    for i in range(160):  # half are similar to each other; the others are to none, but stand first in many blocks
        ws = base[:]
        for at in draw.sample(range(150), 2 if i % 2 else 4):
            ws[at] = f"changed{draw.randrange(10**9)}"
        rows.append((i, " ".join(ws)))
    _, classes, edges = jaccard_join.linked_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    ends = connected_components(edges).collect()
    assert len(ends) >= 80 and len({r["root"] for r in ends}) == 1
    assert edges.count() < classes.count()


def test_families_of_many_tiles_are_taken_by_blocks(spark, monkeypatch):
    draw = random.Random(8)
    texts = [[f"word{draw.randrange(10**9)}" for _ in range(26)] for _ in range(40)]
    rows = list(enumerate(" ".join([*ws, *tail]) for ws in texts for tail in ([], ["a", "tail"], ["other", "longer", "end", "of", "it", draw.choice("xy")])))
    monkeypatch.setattr(jaccard_join, "TILE", 2)
    monkeypatch.setattr(jaccard_join, "_candidates", lambda kept, *_: kept.select("h").distinct().withColumn("family", F.lit(1).cast("long")))
    got, made = joined(spark, monkeypatch, rows)
    assert got == brute_components(rows)
    assert made["apart"] == 1 and made["units"] > 1


def test_common_tokens_of_few_and_many_pairs():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, most, 60).astype(np.uint64)) for most in [90] * 30 + [10**6] * 10]
    x, y = np.triu_indices(len(sets), 1)
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(x, y, strict=True)]
    assert jaccard_join.common_tokens(sets, x, y).tolist() == want
    assert jaccard_join.common_tokens(sets, x[:9], y[:9]).tolist() == want[:9]


def test_null_ids_do_not_hide_the_least_id(spark):
    a, b, c = prose(60), prose(60), prose(60)
    rows = [(None, a), (8, a), (7, a), (None, b), (3, b), (5, b + " tail"), (None, c), (None, c), (9, c + " tail")]
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted((r["component_id"], r["doc_id"] or 0) for r in got) == [(3, 0), (3, 3), (3, 5), (7, 0), (7, 7), (7, 8), (9, 0), (9, 0), (9, 9)]


def test_sketch_bounds_the_difference():
    a, b = jaccard_join.shingles(NEAR), jaccard_join.shingles(NEAR + " some more words here")
    x, y = jaccard_join.fold(jaccard_join.sketch(a), 32), jaccard_join.fold(jaccard_join.sketch(b), 32)
    assert np.unpackbits(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 300), (7, 7)]
    got = {r["id"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[300] == 100


def test_embeddings(spark):
    r = np.random.default_rng(3)
    centres = r.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + r.standard_normal(16) * 0.12).tolist(), i % 2) for i in range(200)]
    rows += [(1000 + i, centres[0].tolist(), 0) for i in range(30)]
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] + [1.0] * 15, 0), (2003, [None] + [1.0] * 15, 0), (2004, centres[0].tolist(), None), (2005, [1.0, 2.0], 0), (2006, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {x["vec_id"]: x for x in embedding_dedup.near_duplicates(df, recall=0.9999).collect()}
    ok = [(i, np.array(v, np.float32).astype(float), l) for i, v, l in rows if i < 2000 or i == 2005]
    links = {i: 0 for i, *_ in rows}
    for i, v, l in ok:
        for j, w, k in ok:
            if i != j and l == k and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                links[i] += 1
    assert sum(got[i]["n_links"] for i in links) >= 0.99 * sum(links.values())
    assert all(got[i]["n_links"] <= n for i, n in links.items())
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(2000, 2007))
    assert got[1029]["n_links"] >= 29 and got[1029]["component_id"] == got[1000]["component_id"]
    assert embedding_dedup.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_tiles_say_what_one_block_says(spark, monkeypatch):
    v = np.random.default_rng(1).standard_normal(8)
    rows = [(i, (v + 0.001 * i).tolist(), 1) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()))
    monkeypatch.setattr(embedding_dedup, "TILE", 7)
    assert sorted(map(tuple, embedding_dedup.near_duplicates(df).collect())) == want
    assert want[0][1] == 59


TURNS = [(1, 0, "system", "be <kind> & brief"), (1, 1, "user", "hi " * 40), (1, 2, "assistant", "</turn> &lt; \\ ok"), (1, 3, "user", None), (1, 4, "assistant", "x" * 900), (1, 5, "user", "y"), (1, 6, "assistant", ""), (1, 7, "assistant", "done"), (2, 0, "assistant", "alone"), (3, 0, None, "?"), (4, 0, "we>ird<", "t"), (None, 0, "user", "n"), (5, 0, "user", "same"), (5, 0, "user", "same")]


@pytest.mark.parametrize("budget", [40, 200, 4000])
def test_chat_round_trip(spark, budget):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    wins = chat.windows(df, budget=budget)
    got = {r["conv_id"]: r for r in chat.digest(wins).collect()}
    by = {}
    for c, t, r, x in TURNS:
        by.setdefault(c, []).append((t, r or "", x or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    if budget == 40:
        texts = [r["text"] for r in wins.where("conv_id = 1").collect()]
        assert len(texts) > 2 and all(" 0 system>" in t for t in texts)
    assert chat.digest(chat.windows(df.where("turn > 99"))).count() == 0


def test_windows_stay_in_budget(spark):
    turn = lambda c, i, role, tokens: (c, i, role, "x" * 4 * (tokens - 4))
    sizes = random.Random(8)
    rows = [turn(1, i, r, n) for i, (r, n) in enumerate([("system", 300), ("user", 400), ("assistant", 100), ("user", 100), ("assistant", 500), ("user", 512), ("assistant", 60)])]
    rows += [turn(2, 0, "system", 600), *(turn(2, i, "user", 100) for i in range(1, 12)), turn(3, 0, "system", 200), turn(3, 1, "user", 50), turn(3, 2, "assistant", 900), turn(3, 3, "user", 50)]
    rows += [turn(c, i, "system" if i == 0 else "user", sizes.randint(4, 500)) for c in range(10, 30) for i in range(40)]
    wins = {}
    for r in chat.read_back(chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect():
        wins.setdefault((r["conv_id"], r["window"]), []).append((r["no"], r["seen"], len(r["text"]) // 4 + 4))
    over = {w: sorted(x) for w, x in wins.items() if sum(n for *_, n in x) > 1024}
    assert list(over.values()) == [[(0, True, 200), (2, False, 900)]]
    # A system turn of more than half the budget stands in the first window alone, any other in all
    assert {c for (c, w), x in wins.items() if not any(no == 0 for no, *_ in x)} == {2}
    assert sum(not seen for x in wins.values() for _, seen, _ in x) == len(rows)
    assert any(seen and no for x in wins.values() for no, seen, _ in x)


def test_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 11))


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    clean = [(i, prose(80 + i)) for i in range(60)]
    bench = prose(40)
    rows = [*clean, (100, clean[0][1]), (101, clean[1][1] + " tail"), (102, prose(30) + " " + bench + " " + prose(30)), (103, None), (104, prose(20) + " me@x.org " + prose(20))]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "0L n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = corpus_pipeline.materialise(stage(spark, found, str(tmp_path)), name)
        assert found.columns == docs.columns
    left = {r["doc_id"]: r["text"] for r in found.collect()}
    assert left.keys() == {*range(60), 103, 104}
    assert "[EMAIL]" in left[104] and all(left[i] == t for i, t in clean)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == left.keys()


def test_near_duplicates_leave_one_row_a_component(spark):
    import corpus_pipeline

    a, b, c, d, e, f = (prose(60 + i) for i in range(6))
    rows = [(5, a), (5, b), (None, c), (None, c), (None, c + " tail"), (9, d), (9, d), (None, e), (1, e), (2, e + " tail"), (7, f), (7, f + " tail"), (3, ""), (3, ""), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    assert sorted(x for x in left if x[0] not in (None, 7)) == sorted([(5, a), (5, b), (9, d), (1, e), (3, ""), (4, "")])
    assert [x in ((None, c), (None, c + " tail"), (7, f), (7, f + " tail")) for x in left if x[0] in (None, 7)] == [True, True]
    assert {x[0] for x in left} == {1, 3, 4, 5, 7, 9, None}
