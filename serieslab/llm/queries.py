"""The thin queries over the operators: each returns its whole digest table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslab.llm import chat, decontaminate, embedding_dedup, jaccard_join, packing, pii, quality, sharding, token_counts, warc
from serieslab.llm.common import materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op3_disclosing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find_spans(_table(spark, sf_dir, "documents")))


def op4_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("k", "hits")


def op5_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op6_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op7_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(_table(spark, sf_dir, "documents")).drop("k", "root")


def op9_p_stable_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


#: The conversation that the contract of op10 adds: marks and escapes in plain text.
TRICKY = r"\### Assistant: </turn> ok"


def op10_budgeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return chat.digest(materialise(chat.windows(turns.unionByName(extra)), "windows"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_token_counts, op3_disclosing_terms, op4_positional_index, op5_attention_mil, op6_warc_transactions, op7_sampled_splitters, op8_parity_sketch_join, op9_p_stable_hashing, op10_budgeted_windows)}


_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Component of each node of reach(a, b), by following links until nothing new is found.
_REACH = "reach(a, b) AS (SELECT id, id FROM node UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)"

_OP4 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item, list_slice(ws, k.range + 1, least(k.range + 10, len(ws))) AS win FROM i, range(100000) k WHERE len(ws) > 0 AND k.range <= greatest(len(ws) - 10, 0)),
g AS (SELECT r, k.range AS pos, l.n, list_slice(ws, k.range + 1, k.range + l.n) AS win FROM d, (SELECT DISTINCT len(win) AS n FROM w) l, range(100000) k WHERE k.range + l.n <= len(ws)),
h AS (SELECT r, pos, n, item FROM g JOIN w ON g.win = w.win),
c AS (SELECT r, count(DISTINCT pos + k.range) AS n_hit FROM h, range(10) k WHERE k.range < n GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)"""

_OP6 = """WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages), h AS (SELECT page_id, strlen(x) AS payload_bytes, sha1(x) AS s, max(page_id) OVER (PARTITION BY x) AS best FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(s, CAST(1 + 5 * (k // 4) AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM h"""

_OP8 = f"""WITH RECURSIVE d AS (SELECT doc_id AS id, regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT id, array_to_string(list_slice(ws, k.range + 1, k.range + 5), ' ') AS s FROM d, range(100000) k WHERE len(ws) > 0 AND k.range <= greatest(len(ws) - 5, 0)),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id), pairs AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.id <> y.id GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)), node AS (SELECT id FROM d), {_REACH}
SELECT d.id AS doc_id, coalesce(n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n ON n.id = d.id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.id"""

_OP9 = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
link AS (SELECT p.id AS a, q.id AS b FROM ok p JOIN ok q ON p.label = q.label AND p.id <> q.id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.93), node AS (SELECT id FROM v), {_REACH}
SELECT v.id AS vec_id, coalesce(k, 0) AS n_links, CAST(c.component_id AS BIGINT) AS component_id, v.id = c.component_id AS kept FROM v LEFT JOIN (SELECT a, count(*) AS k FROM link GROUP BY a) l ON l.a = v.id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = v.id"""


_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_TRICKY = TRICKY.replace("'", "''")
#: Windows of 1,024 tokens with at most two repeated turns; what a turn's marks take is 15 characters, its number and its role.
_OP10 = f"""WITH t AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '{_TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{_TRICKY}'),
a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CAST(ceil(strlen(coalesce(text, '')) / 4.0) AS BIGINT) + 4 AS tokens FROM t),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS no FROM a), c AS (SELECT *, no = 0 AND role = 'system' AND tokens <= 512 AS system FROM b),
d AS (SELECT * REPLACE (CASE WHEN system THEN 0 ELSE tokens END AS tokens), 1024 - max(CASE WHEN system THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS room FROM c),
e AS (SELECT *, room // 4 AS again_room, greatest((room - room // 4) // 2, 1) AS size FROM d), f AS (SELECT *, tokens > size AS long, coalesce(lag(tokens > size) OVER (PARTITION BY conv_id ORDER BY no), false) AS after_long FROM e),
g AS (SELECT *, sum(CASE WHEN long OR after_long THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY no) AS stretch FROM f), h AS (SELECT *, (sum(tokens) OVER (PARTITION BY conv_id, stretch ORDER BY no) - tokens) // size AS cell FROM g),
i AS (SELECT *, CASE WHEN no = 0 OR stretch <> lag(stretch) OVER w OR cell <> lag(cell) OVER w THEN 1 ELSE 0 END AS turned FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY no)), j AS (SELECT *, sum(turned) OVER (PARTITION BY conv_id ORDER BY no) - 1 AS win FROM i),
z AS (SELECT conv_id, win, sum(tokens) AS total FROM j GROUP BY conv_id, win), l AS (SELECT j.*, row_number() OVER x AS nth, sum(tokens) OVER x AS ends, max(win) OVER (PARTITION BY conv_id) AS last FROM j WINDOW x AS (PARTITION BY conv_id, win ORDER BY no DESC)),
m AS (SELECT l.*, CASE WHEN system THEN last + 1 WHEN nth <= 2 AND ends <= again_room AND ends <= room - z.total THEN 2 ELSE 1 END AS copies FROM l LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM l.conv_id AND z.win = l.win + 1)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY no)) AS turns_sha256, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY no)) AS loss_sha256, CAST(sum(copies * (15 + length(CAST(no AS VARCHAR)) + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}))) AS BIGINT) AS formatted_chars FROM m GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    """What SQL can say of whole tables: all pairs there where the operators look up candidates."""
    return {"op4_positional_index": _OP4, "op6_warc_transactions": _OP6, "op8_parity_sketch_join": _OP8, "op9_p_stable_hashing": _OP9, "op10_budgeted_windows": _OP10}
