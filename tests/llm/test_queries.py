"""Every registered query on small tables with awkward rows and columns whose names the operators use themselves; SQL oracles; brute force where there is none."""

import base64
import hashlib
import math
import random
import re
import types
import zlib

import duckdb
import numpy as np
import pytest

from serieslab.llm import common, embedding_dedup, pii, queries, token_counts

rng = random.Random(9)
VOCAB = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(200)]
prose = lambda n: " ".join(rng.choice(VOCAB) for _ in range(n))
LONG = prose(30_000)
COPY = prose(150)
TEXTS = [None, "", "  ", COPY, COPY, COPY + " one more", "mail me@x.org or +12345678901 now", LONG, "é 漢字 😀 " + prose(20), *(prose(60) for _ in range(30))]
#: Columns that the operators make for themselves.
CLASH = "k long, x string, h long, id string, key long, c array<int>, n long, term string, pos int, shard int, size long, root long, row long, start int, words string, sig string, bucket long, __key string, __id int"
CLASHING = (1, "x", 2, "i", 3, [1], 4, "t", 5, 6, 7, 8, 9, 10, "w", "s", 11, "y", 12)
EXTRA = dict(zip((c.split()[0] for c in CLASH.split(", ")), CLASHING, strict=True))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    write = lambda rows, schema, name: spark.createDataFrame([(*r, *CLASHING) for r in rows], f"{schema}, {CLASH}").repartition(3).write.parquet(f"{folder}/{name}.parquet")
    write([(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    write([(1, " ".join(COPY.split()[20:60])), (2, prose(30)), (3, None), (4, "mail me")], "item_id long, text string", "benchmark")
    write([(i, i % 2, 0) for i in range(5, 30)], "doc_id long, quality int, toxic int", "labels")
    write([(i, f"http://h/{i}", t) for i, t in enumerate([*TEXTS, LONG])], "page_id long, url string, html string", "pages")
    turns = [(c, t, r, x) for c in range(4) for t, (r, x) in enumerate([("system", "be brief"), ("user", prose(40)), ("assistant", None if c == 1 else prose(900 if c == 2 else 50)), ("user", "<b>&"), ("assistant", LONG if c == 3 else "ok")])]
    write(turns, "conv_id long, turn long, role string, text string", "conversations")
    r = np.random.default_rng(1)
    centres = r.standard_normal((6, 16))
    vectors = [(i, (centres[i % 6] + r.standard_normal(16) * 0.1).tolist(), i % 3) for i in range(120)]
    write([*vectors, (500, None, 0), (501, [0.0] * 16, 0), (502, [1.0] * 16, None)], "vec_id long, embedding array<float>, label int", "embeddings")
    return folder


@pytest.fixture(scope="module")
def empty_tables(spark, tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "benchmark", "labels", "pages", "conversations", "embeddings"):
        spark.read.parquet(f"{tables}/{name}.parquet").where("false").write.parquet(f"{folder}/{name}.parquet")
    return folder


ROWS = {"documents": len(TEXTS), "pages": len(TEXTS) + 1, "conversations": 5, "embeddings": 123}
TABLE = {6: "pages", 9: "embeddings", 10: "conversations"}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs_and_agrees_with_its_sql(spark, tables, name):
    got = queries.queries()[name](spark, tables)
    assert not set(EXTRA) - {"shard", "size", "start"} & set(got.columns)
    rows = got.collect()
    number = int(name[2:].split("_")[0])
    if number != 1:
        assert len(rows) == ROWS[TABLE.get(number, "documents")]
    sql = queries.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for t in ("documents", "benchmark", "pages", "embeddings", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
        want = con.execute(sql)
        cols = [d[0] for d in want.description]
        assert sorted(cols) == sorted(got.columns)
        assert sorted(str(tuple(r[c] for c in cols)) for r in rows) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs_on_empty_tables(spark, empty_tables, name):
    assert queries.queries()[name](spark, empty_tables).count() == (1 if name.startswith("op10_") else 0)


def test_packing_of_whole_texts(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = queries.op1_best_fit_packing(spark, tables).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, t in enumerate(TEXTS):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for n, (piece, start, length, crc) in enumerate(sorted(by[i])):
            assert (piece, start, crc) == (n, at, zlib.crc32(ids[at : at + length].tobytes())) and length <= 1024
            at += length
        assert at == len(ids)
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(seqs) <= math.ceil(sum(r["length"] for r in rows) / 1024) + 1


def test_shards(spark, tables):
    rows = queries.op7_sampled_splitters(spark, tables).collect()
    shards = {}
    for r in rows:
        t = (TEXTS[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 16, zlib.crc32(t), "bytes", None) and 0 <= r["shard"] < 40
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_tricky_conversation(spark, tables):
    said = r"\### Assistant: </turn> ok"
    r = next(r for r in queries.op10_budgeted_windows(spark, tables).collect() if r["conv_id"] == -7)
    assert (r["n_turns"], r["loss_chars"]) == (2, len(said)) and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_pipeline_on_awkward_tables(spark, tables, empty_tables):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = corpus_pipeline.materialise(stage(spark, docs, tables), name)
        assert out.columns == docs.columns
        assert out.where("k <> 1 or x <> 'x' or root <> 8").count() == 0
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, tables).collect()}
    assert ids and ids <= set(range(len(TEXTS)))
    assert corpus_pipeline.run(spark, empty_tables).count() == 0


# --- personal data
def brute_terms(texts, share=pii.SHARE, support=pii.SUPPORT):
    """The terms that disclose a value, from the definition."""
    word = lambda t: {w for w in re.split(r"[^a-z]+", t.lower()) if len(w) >= pii.MIN_TERM}
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    n, words, valued, contexts = len(texts), {}, {}, {}
    for i, t in enumerate(texts):
        for w in word(t):
            words.setdefault(w, set()).add(i)
        for m in mail.finditer(t):
            v = m[0].lower()
            valued.setdefault(v, set()).add(i)
            left = max(0, m.start() - pii.CONTEXT)
            c = re.sub(r"^[a-z]+", "", t[left : m.start()], flags=re.I) + " " + re.sub(r"[a-z]+$", "", t[m.end() : m.end() + pii.CONTEXT], flags=re.I)
            for w in word(c):
                contexts.setdefault((v, w), set()).add(c)
    out = set()
    for (v, w), seen in contexts.items():
        ic = -math.log2(len(valued[v]) / n)
        both = len(valued[v] & words[w])
        if len(seen) >= support and ic > 0 and both and math.log2(both * n / (len(valued[v]) * len(words[w]))) >= share * ic - 1e-9:
            out.add(w)
    return out


def test_terms_equal_the_definition(spark):
    texts = []
    for who, n in (("alpha", 6), ("beta", 4), ("gamma", 2)):
        texts += [f"{prose(12)} secretname{who} at {who}@corp.org {prose(12)}" for _ in range(n)]
    texts += [f"{prose(10)} shared word x{i}@corp.org {prose(10)}" for i in range(3) for _ in range(4)] + [prose(40) for _ in range(60)] + ["shared word"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told, _ = pii.disclosing_terms(df, pii.detect(df))
    want = brute_terms(texts)
    assert {r["term"] for r in told.collect()} == want and "secretnamealpha" in want and "secretnamegamma" not in want
    rows = {r["doc_id"]: r for r in pii.report(pii.find_spans(df)).collect()}
    for i, t in enumerate(texts):
        base = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        terms = [(m.start(), m.end()) for w in sorted(want) for m in re.finditer(rf"(?i)(?<![a-z]){w}(?![a-z])", t)]
        terms = sorted(s for s in terms if not any(s[0] < e and b < s[1] for b, e in base))
        assert rows[i]["spans"] == ",".join([*(f"email:{a}:{b}" for a, b in base), *(f"term:{a}:{b}" for a, b in terms)])
        assert rows[i]["found"] == bool(base or terms)


def test_secrets_and_texts_of_many_matches(spark):
    key, other = "1eb9c654e721b4f812088970e66a6345cee33dd6", "a" * 40
    many = "a@b.c " * 700 + "end"
    rows = [(0, f'token = "{key}" {other} {"1" * 25}'), (1, many), (2, f"{key}@x.org"), (3, None), (4, key[:19])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.report(pii.find_spans(df)).collect()}
    assert got[0]["spans"] == "secret:9:49" and got[1]["n_email"] == 700 and got[1]["spans"].endswith("email:4194:4199")
    assert (got[2]["n_email"], got[2]["n_secret"], got[3]["spans"], got[4]["found"]) == (1, 0, "", False)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise_documents(df).collect()}
    assert clean[0] == f'token = "[SECRET]" {other} {"1" * 25}' and clean[1] == "[EMAIL] " * 700 + "end" and clean[3] is None


# --- vectors
def brute_links(rows, threshold=0.93):
    ok = [(r, np.array(v, float) / np.abs(v).max()) for r, (_, v, label) in enumerate(rows) if v and label is not None and np.isfinite(v).all() and np.abs(v).max() > 0]
    link = {r: set() for r in range(len(rows))}
    for a, x in ok:
        for b, y in ok:
            if a != b and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                link[a].add(b)
    return link


def test_vectors_with_repeated_null_and_huge_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (None, [-1.0, 0.0], 0), (None, [-1.0, 0.0], 0), (7, [-1.0, 0.01], 0), (8, [1e200, 1e200], 0), (9, [1.0, 1.0], 0), (10, [1e-200, 1e-200], 0), (None, [0.0, -1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (0, 2, 7, False), (0, 2, 7, False), (7, 2, 7, True), (8, 2, 8, True), (9, 2, 8, False), (10, 2, 8, False), (0, 0, 0, False)])


def test_recall_at_the_default(spark):
    r = np.random.default_rng(5)
    centres = r.standard_normal((60, 24))
    rows = [(i, (centres[i % 60] + r.standard_normal(24) * 0.24).tolist(), 0) for i in range(900)]
    got = {x["vec_id"]: x["n_links"] for x in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = {rows[a][0]: len(b) for a, b in brute_links(rows).items()}
    assert sum(want.values()) > 2000 and all(got[i] <= n for i, n in want.items())
    assert sum(got.values()) >= 0.99 * sum(want.values())


# --- tokens
def test_pre_tokens_are_the_librarys():
    cut = token_counts.Splitter(None)
    signs = "abcDEé ñ'stlved́̀ 12,.!<|>\t\n İJßΣ한한中😀\u200dﬁ²½ªº×÷ɏỳſK\x1c\x85_"
    for _ in range(20_000):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(0, 14)))
        t = t + "<|endoftext|>" + t if rng.random() < 0.05 else t
        assert sum(map(cut.pieces, cut(t))) == len(cut.tok.encode(t, add_special_tokens=False).ids), t


def test_digests_of_pages(spark, tables):
    rows = {r["page_id"]: r for r in queries.op6_warc_transactions(spark, tables).collect()}
    for i, t in enumerate([*TEXTS, LONG]):
        body = (t or "").encode()
        assert rows[i]["payload_bytes"] == len(body) and rows[i]["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()


# --- shared parts
def test_scratch_is_shared():
    conf = lambda **kw: types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d=None: kw.get(k, d)))
    assert common.scratch(conf(**{"spark.checkpoint.dir": "s3a://b/c/"}), "t").startswith("s3a://b/c/serieslab/t-")
    assert common.scratch(conf(**{"spark.sql.warehouse.dir": "hdfs://w"}), "t").startswith("hdfs://w/_checkpoints/serieslab/t-")


def test_broadcasts_are_checked_by_rows_and_bytes(spark, monkeypatch):
    df = spark.range(100).selectExpr("id", "repeat('x', 100) AS s", "array(repeat('y', 50)) AS a")
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(common.maybe_broadcast(df)) and not hinted(common.maybe_broadcast(df, 99))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 15_000)
    assert not hinted(common.maybe_broadcast(df))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 25_000)
    assert hinted(common.maybe_broadcast(df))


def test_tokens_are_dealt_anew_where_blocks_do_not_suffice(spark, monkeypatch):
    from serieslab.llm import jaccard_join

    texts = [prose(120) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate([*texts, *(t + " more words" for t in texts)])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = sorted(map(tuple, jaccard_join.components(df).select("doc_id", "component_id").collect()))
    assert want[12:] == [(i + 12, i) for i in range(12)]
    first = df.sparkSession.sparkContext.accumulator(0)
    real = jaccard_join.postings

    def short(u, num, den, seed=0):
        first.add(seed)
        out, enough = real(u, num, den, seed)
        return out, enough and seed > 0

    monkeypatch.setattr(jaccard_join, "postings", short)
    # Workers import the module anew, so the patched function travels in a closure of the posting
    post = jaccard_join._post
    source = types.FunctionType(post.__code__, {**post.__globals__, "postings": short}, "_post", post.__defaults__)
    monkeypatch.setattr(jaccard_join, "_post", source)
    assert sorted(map(tuple, jaccard_join.components(df).select("doc_id", "component_id").collect())) == want


def test_shards_split_rows_of_one_id_and_text(spark):
    from serieslab.llm import sharding

    df = spark.range(2000).selectExpr("7L AS doc_id", "repeat('x', 84) AS text").repartition(4)
    sizes = {r["shard"]: r["count"] for r in sharding.shard_by_bytes(df, 8).groupBy("shard").count().collect()}
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 2


def test_scopes_leave_nothing_behind(spark):
    with common.scratch_scope(spark):
        inside = common.scratch(spark, "t")
        df = common.materialise(spark.range(3), "t")
        outside = common.materialise(df, "u", path=common.scratch(spark, "u").replace(inside.rsplit("/", 2)[1] + "/", ""))
    assert outside.count() == 3 and "scope-" not in outside.inputFiles()[0]
    with pytest.raises(Exception):
        df.collect()
    assert "scope-" not in common.scratch(spark, "t")
