"""Every registered query of the library, with its SQL oracle where SQL can say it.

The series are daily sums of `orders` (one column) and daily means of `lineitem` (four). Randomness is hashed, so a
plan of blocks is the same here and in SQL. Floating results are rounded, as sums may be taken in any order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from serieslab.functions import portfolio, switching
from serieslab.functions.garch import GarchSpec
from serieslab.operators import benchmark, bootstrap, cv, diagnostics, em_log, fits, inference, montecarlo, resample, summary
from serieslab.sources import series as src

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

BOOTS, LENGTH, SEED = 20, 20, 1
DAY = """day AS (SELECT CAST(o_orderdate AS DATE) AS d, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v1 FROM orders GROUP BY 1),
s AS (SELECT row_number() OVER (ORDER BY d) - 1 AS t, v1 FROM day), n AS (SELECT count(*) AS n FROM s)"""
LINES = """day AS (SELECT CAST(l_shipdate AS DATE) AS d, {0} FROM lineitem GROUP BY 1),
s AS (SELECT row_number() OVER (ORDER BY d) - 1 AS t, quantity, price, discount, tax FROM day), n AS (SELECT count(*) AS n FROM s)""".format(
    ", ".join(f"CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS {n}" for n, c in (("quantity", "l_quantity"), ("price", "l_extendedprice"), ("discount", "l_discount"), ("tax", "l_tax")))
)


def u_sql(*parts: str) -> str:
    return f"(('0x' || substr(md5({' || ' + repr('-') + ' || '}), 1, 8))::UBIGINT / 4294967296.0)" if not parts else "(('0x' || substr(md5(" + " || '-' || ".join(f"({p})::VARCHAR" for p in parts) + "), 1, 8))::UBIGINT / 4294967296.0)"


def plan_sql(target: str = "n.n", aligned: bool = False, length: int = LENGTH) -> str:
    u = u_sql(f"'{SEED}'", "boot_id", "block_no")
    start = f"floor({u} * (n.n // {length})) * {length}" if aligned else f"floor({u} * (n.n - {length} + 1))"
    return f"""b AS (SELECT b.range AS boot_id, k.range AS block_no FROM range({BOOTS}) b, n, range(100000) k WHERE k.range * {length} < {target}),
plan AS (SELECT boot_id, block_no, CAST({start} AS BIGINT) AS start, {length} AS "full", least({length}, {target} - block_no * {length}) AS len, block_no * {length} AS pos0 FROM b, n)"""


def gather_sql(cols: tuple[str, ...] = ("v1",), weight: str = "1.0") -> str:
    return f"""g AS (SELECT boot_id, pos0 + i.range AS pos, block_no, (start + i.range) % n.n AS src_t, {weight} AS w FROM plan, n, range(100000) i WHERE i.range < len),
boots AS (SELECT boot_id, pos, block_no, src_t, w, {', '.join(f'{c} * w AS {c}' for c in cols)} FROM g JOIN s ON s.t = g.src_t)"""


STATS = "SELECT boot_id, count(*) AS n, round(avg(v1), 3) AS mean_v1, round(stddev_samp(v1), 3) AS sd_v1, sum(src_t) AS sum_t FROM boots GROUP BY boot_id"


def _stats(boots: DataFrame) -> DataFrame:
    return boots.groupBy("boot_id").agg(F.count("*").alias("n"), F.round(F.avg("v1"), 3).alias("mean_v1"), F.round(F.stddev_samp("v1"), 3).alias("sd_v1"), F.sum("src_t").alias("sum_t"))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _round(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# --- series
@query(f"WITH {DAY} SELECT t, v1 FROM s")
def series_from_table(spark, sf_dir):
    return src.validate(src.daily_revenue(spark, sf_dir))


@query(f"WITH {DAY}, x AS (SELECT t, v1, v1 - lag(v1) OVER (ORDER BY t) AS d1 FROM s) SELECT t, round(d1 - lag(d1) OVER (ORDER BY t), 2) AS v FROM x QUALIFY t >= 2")
def difference_twice(spark, sf_dir):
    return _round(summary.difference(src.daily_revenue(spark, sf_dir), "v1", 2), "v", digits=2)


@query(f"WITH {LINES} SELECT t, round(quantity, 6) AS quantity, round(tax, 6) AS tax, round(lag(quantity) OVER (ORDER BY t), 6) AS quantity_lag1, round(lag(tax) OVER (ORDER BY t), 6) AS tax_lag1, round(lag(quantity, 2) OVER (ORDER BY t), 6) AS quantity_lag2, round(lag(tax, 2) OVER (ORDER BY t), 6) AS tax_lag2 FROM s")
def lag_matrix(spark, sf_dir):
    out = resample.lagged(src.daily_lines(spark, sf_dir).select("t", "quantity", "tax"), ["quantity", "tax"], 2)
    return _round(out, *(c for c in out.columns if c != "t"))


@query(f"""WITH {LINES}, m AS (SELECT avg(quantity) AS mq, avg(tax) AS mt FROM s), l AS (SELECT t, quantity - mq AS q, tax - mt AS x, lag(quantity - mq) OVER (ORDER BY t) AS lq, lag(tax - mt) OVER (ORDER BY t) AS lx FROM s, m),
r AS (SELECT (abs(sum(q * lq) / sum(q * q)) + abs(sum(x * lx) / sum(x * x))) / 2 AS rho FROM l WHERE t > 0)
SELECT n, round(rho, 8) AS rho, CAST(greatest(5, least(floor(10 / (1 - rho)), floor(sqrt(n)))) AS INTEGER) AS block_length FROM r, n""")
def default_block_length(spark, sf_dir):
    return _round(resample.default_block_length(src.daily_lines(spark, sf_dir).select("t", "quantity", "tax")), "rho", digits=8)


@query("""WITH i AS (SELECT range AS i FROM range(20)) SELECT i, round(0.5 * (1 - cos(2 * pi() * i / 19.0)), 10) AS cosine, round(1 - abs((i - 9.5) / 9.5), 10) AS bartlett,
round(CASE WHEN i < 0.5 * 19 / 2 THEN 0.5 * (1 + cos(pi() * (2 * i / (0.5 * 19) - 1))) WHEN i <= 19 * 0.75 THEN 1.0 ELSE 0.5 * (1 + cos(pi() * (2 * i / (0.5 * 19) - 4 + 1))) END, 10) AS tukey FROM i""")
def taper_weights(spark, sf_dir):
    i = spark.range(LENGTH).select(F.col("id").alias("i"))
    return i.select("i", *(F.round(resample.taper_weight(F.col("i"), F.lit(LENGTH), t), 10).alias(t) for t in resample.TAPERS))


# --- resamplers
def _boots(spark, sf_dir, **kw) -> DataFrame:
    return resample.block_bootstrap(src.daily_revenue(spark, sf_dir), block_length=LENGTH, num_boots=BOOTS, seed=SEED, **kw)


@query(f"WITH {DAY}, {plan_sql()}, {gather_sql()} {STATS}")
def moving_overlapping(spark, sf_dir):
    return _stats(_boots(spark, sf_dir))


@query(f"WITH {DAY}, {plan_sql(aligned=True)}, {gather_sql()} {STATS}")
def moving_non_overlapping(spark, sf_dir):
    return _stats(_boots(spark, sf_dir, block_type="non-overlapping"))


@query(f"WITH {DAY}, {plan_sql(target='100')}, {gather_sql()} SELECT boot_id, pos, block_no, src_t, v1 FROM boots")
def moving_rows(spark, sf_dir):
    return _boots(spark, sf_dir, num_blocks=5).drop("w")


def _taper_query(name: str, weight: str) -> None:
    def run(spark, sf_dir):
        return _stats(_boots(spark, sf_dir, block_type="tapered", taper=name))

    run.__name__ = f"moving_tapered_{name}"
    query(f"WITH {DAY}, {plan_sql()}, {gather_sql(weight=weight)} {STATS}")(run)


_taper_query("cosine", "0.5 * (1 - cos(2 * pi() * i.range / 19.0))")
_taper_query("bartlett", "1 - abs((i.range - 9.5) / 9.5)")
_taper_query("tukey", "CASE WHEN i.range < 4.75 THEN 0.5 * (1 + cos(pi() * (2 * i.range / 9.5 - 1))) WHEN i.range <= 14.25 THEN 1.0 ELSE 0.5 * (1 + cos(pi() * (2 * i.range / 9.5 - 3))) END")


def _stationary_sql(aligned: bool) -> str:
    v = u_sql(f"'{SEED}'", "'start'", "boot_id", "block_no")
    start = f"floor({v} * greatest(1, floor(n.n / \"full\"))) * \"full\"" if aligned else f"floor({v} * n.n)"
    return f"""b AS (SELECT b.range AS boot_id, k.range AS block_no FROM range({BOOTS}) b, n, range(100000) k WHERE k.range < n.n),
f AS (SELECT boot_id, block_no, least(CAST(floor(ln(1 - {u_sql(f"'{SEED}'", "'len'", "boot_id", "block_no")}) / ln(0.9)) AS BIGINT) + 1, greatest(1, least(ceil(ln(0.01) / ln(0.9)), floor(0.1 * n.n)))) AS "full" FROM b, n),
c AS (SELECT *, sum("full") OVER (PARTITION BY boot_id ORDER BY block_no) - "full" AS pos0 FROM f),
plan AS (SELECT boot_id, block_no, CAST({start} AS BIGINT) AS start, "full", least("full", n.n - pos0) AS len, pos0 FROM c, n WHERE pos0 < n.n)"""


@query(f"WITH {DAY}, {_stationary_sql(False)}, {gather_sql()} {STATS}")
def stationary_overlapping(spark, sf_dir):
    return _stats(_boots(spark, sf_dir, bs_type="stationary"))


@query(f"WITH {DAY}, {_stationary_sql(True)}, {gather_sql()} {STATS}")
def stationary_non_overlapping(spark, sf_dir):
    return _stats(_boots(spark, sf_dir, bs_type="stationary", block_type="non-overlapping"))


WILD = f"""boots AS (SELECT b.range AS boot_id, t AS pos, t AS src_t, CASE WHEN {u_sql(f"'{SEED}'", "b.range", "t")} < 0.5 THEN -1.0 ELSE 1.0 END * v1 AS v1 FROM s, range({BOOTS}) b)"""


@query(f"WITH {DAY}, {WILD} {STATS}")
def wild(spark, sf_dir):
    return _stats(resample.wild_bootstrap(src.daily_revenue(spark, sf_dir), BOOTS, SEED))


@query(f"WITH {LINES}, {plan_sql()}, {gather_sql(('quantity', 'price', 'discount', 'tax'))} SELECT boot_id, round(corr(quantity, price), 8) AS c_qp, round(covar_samp(discount, tax), 8) AS c_dt, round(avg(price), 3) AS m_price FROM boots GROUP BY boot_id")
def moving_multivariate(spark, sf_dir):
    boots = resample.block_bootstrap(src.daily_lines(spark, sf_dir), block_length=LENGTH, num_boots=BOOTS, seed=SEED)
    return boots.groupBy("boot_id").agg(F.round(F.corr("quantity", "price"), 8).alias("c_qp"), F.round(F.covar_samp("discount", "tax"), 8).alias("c_dt"), F.round(F.avg("price"), 3).alias("m_price"))


STATES = "st AS (SELECT t, CASE WHEN v1 > (SELECT median(v1) FROM s) THEN 1 ELSE 0 END AS state FROM s)"
RUNS = "isl AS (SELECT t, state, t - row_number() OVER (PARTITION BY state ORDER BY t) AS g FROM st), runs AS (SELECT row_number() OVER (ORDER BY min(t)) - 1 AS run_no, state, min(t) AS start, count(*) AS len FROM isl GROUP BY state, g)"


def _states(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    s = src.daily_revenue(spark, sf_dir)
    m = s.agg(F.median("v1")).first()[0]
    return s, s.select("t", F.when(F.col("v1") > m, 1).otherwise(0).alias("state"))


@query(f"WITH {DAY}, {STATES}, {RUNS} SELECT run_no, state, start, len FROM runs")
def regime_runs(spark, sf_dir):
    return resample.runs(_states(spark, sf_dir)[1])


@query(f"""WITH {DAY}, {STATES}, {RUNS}, b AS (SELECT b.range AS boot_id, k.range AS block_no FROM range({BOOTS}) b, n, range(100000) k WHERE k.range < n.n),
d AS (SELECT boot_id, block_no, CAST(floor({u_sql(f"'{SEED}'", 'boot_id', 'block_no')} * (SELECT count(*) FROM runs)) AS BIGINT) AS run_no FROM b),
c AS (SELECT d.boot_id, block_no, state, start, len, sum(len) OVER (PARTITION BY boot_id ORDER BY block_no) - len AS pos0 FROM d JOIN runs USING (run_no)),
plan AS (SELECT boot_id, block_no, state, start, least(len, n.n - pos0) AS len, pos0 FROM c, n WHERE pos0 < n.n),
boots AS (SELECT boot_id, state, (start + i.range) % n.n AS src_t FROM plan, n, range(100000) i WHERE i.range < len)
SELECT boot_id, count(*) AS n, sum(src_t) AS sum_t, sum(state) AS in_state FROM boots GROUP BY boot_id""")
def regime_run_bootstrap(spark, sf_dir):
    s, st = _states(spark, sf_dir)
    return resample.regime_bootstrap(s, st, BOOTS, seed=SEED).groupBy("boot_id").agg(F.count("*").alias("n"), F.sum("src_t").alias("sum_t"), F.sum("state").alias("in_state"))


@query(f"WITH {DAY}, {STATES}, p AS (SELECT state AS i, lead(state) OVER (ORDER BY t) AS j FROM st), c AS (SELECT i, j, count(*) AS n FROM p WHERE j IS NOT NULL GROUP BY i, j), g AS (SELECT a.range AS i, b.range AS j FROM range(2) a, range(2) b) SELECT g.i, g.j, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY g.i), 8) AS p FROM g LEFT JOIN c ON g.i = c.i AND g.j = c.j")
def transition_matrix(spark, sf_dir):
    return _round(resample.transition_counts(_states(spark, sf_dir)[1]), "p", digits=8)


CHAIN = f"""tr AS (SELECT state AS i, lead(state) OVER (ORDER BY t) AS j FROM st),
pr AS (SELECT sum(CASE WHEN i = 0 AND j = 1 THEN 1.0 ELSE 0 END) / sum(CASE WHEN i = 0 AND j IS NOT NULL THEN 1.0 ELSE 0 END) AS p01, sum(CASE WHEN i = 1 AND j = 0 THEN 1.0 ELSE 0 END) / sum(CASE WHEN i = 1 AND j IS NOT NULL THEN 1.0 ELSE 0 END) AS p10 FROM tr),
ch(boot_id, pos, state) AS (SELECT b.range, CAST(0 AS BIGINT), CASE WHEN {u_sql(f"'{SEED}'", "'chain'", 'b.range', '0')} < p10 / (p01 + p10) THEN 0 ELSE 1 END FROM range({BOOTS}) b, pr
UNION ALL SELECT boot_id, pos + 1, CASE WHEN {u_sql(f"'{SEED}'", "'chain'", 'boot_id', 'pos + 1')} < CASE WHEN state = 0 THEN 1 - p01 ELSE p10 END THEN 0 ELSE 1 END FROM ch, pr WHERE pos + 1 < 200),
pool AS (SELECT t, state, row_number() OVER (PARTITION BY state ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY state) AS size FROM st)"""


@query(f"WITH RECURSIVE {DAY}, {STATES}, {CHAIN} SELECT ch.boot_id, ch.pos, pool.t AS src_t, ch.state, round(s.v1, 4) AS v1 FROM ch JOIN pool ON pool.state = ch.state AND pool.k = CAST(floor({u_sql(f"'{SEED}'", "'pool'", 'ch.boot_id', 'ch.pos')} * pool.size) AS BIGINT) JOIN s ON s.t = pool.t")
def state_pool_bootstrap(spark, sf_dir):
    s, st = _states(spark, sf_dir)
    return _round(resample.pool_bootstrap(s, st, BOOTS, 200, SEED), "v1", digits=4)


@query()
def micro_block_bootstrap(spark, sf_dir):
    s, st = _states(spark, sf_dir)
    return resample.pool_bootstrap(s, st, BOOTS, 200, SEED, micro_block=3)


@query(f"WITH {DAY}, {STATES}, tr AS (SELECT state, lead(state) OVER (ORDER BY t) AS j FROM st) SELECT state, round(1 / (1 - avg(CASE WHEN state = j THEN 1.0 ELSE 0 END)), 8) AS duration FROM tr WHERE j IS NOT NULL GROUP BY state")
def state_durations(spark, sf_dir):
    return _round(resample.duration_table(resample.transition_counts(_states(spark, sf_dir)[1])), "duration", digits=8)


@query(f"WITH {DAY}, {STATES} SELECT state, count(*) AS size, count(*) < 10 AS few FROM st GROUP BY state")
def state_pools(spark, sf_dir):
    return resample.pools(_states(spark, sf_dir)[1])


@query(f"WITH {DAY}, {STATES} SELECT x.range AS state, count(st.t) AS n, round(count(st.t) / (SELECT count(*) FROM st), 8) AS share FROM range(3) x LEFT JOIN st ON st.state = x.range GROUP BY 1")
def regime_shares(spark, sf_dir):
    return _round(diagnostics.regime_shares(_states(spark, sf_dir)[1], [0, 1, 2]), "share", digits=8)


# --- statistics of replicates
OUTS = f"WITH {DAY}, {plan_sql()}, {gather_sql()}, outs AS (SELECT 'v1:mean' AS name, boot_id, avg(v1) AS value FROM boots GROUP BY boot_id UNION ALL SELECT 'v1:sd', boot_id, stddev_samp(v1) FROM boots GROUP BY boot_id)"


def _outs(spark, sf_dir) -> DataFrame:
    return summary.apply_columns(_boots(spark, sf_dir), {"mean": F.avg, "sd": F.stddev_samp})


@query(f"{OUTS} SELECT name AS \"Name\", round(avg(value), 2) AS \"Mean\", round(stddev_samp(value), 2) AS \"SD\", round(quantile_cont(value, 0.025), 2) AS \"CI_Lower\", round(quantile_cont(value, 0.975), 2) AS \"CI_Upper\", round(quantile_cont(value, 0.975) - quantile_cont(value, 0.025), 2) AS \"CI_Width\" FROM outs GROUP BY name")
def func_summary(spark, sf_dir):
    return _round(summary.summarize(_outs(spark, sf_dir), digits=6), "Mean", "SD", "CI_Lower", "CI_Upper", "CI_Width", digits=2)


@query(f"{OUTS}, c AS (SELECT name, avg(value) AS m, stddev_samp(value) AS sd FROM outs GROUP BY name) SELECT name AS \"Name\", round(m, 2) AS \"Mean\", round(sd, 2) AS \"SD\", round(sd / (abs(m) + 1e-8), 8) AS \"CV\", CASE WHEN sd / (abs(m) + 1e-8) < 0.3 THEN 'Stable' WHEN sd / (abs(m) + 1e-8) < 0.6 THEN 'Moderate' ELSE 'Unstable' END AS \"Stability\" FROM c")
def func_variation(spark, sf_dir):
    return _round(_round(summary.variation(_outs(spark, sf_dir)), "Mean", "SD", digits=2), "CV", digits=8)


@query(f"{OUTS}, r AS (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY value) AS k, count(*) OVER (PARTITION BY name) AS n FROM outs) SELECT name AS \"Name\", round(avg(value), 2) AS \"Boot_Mean\", round(median(value), 2) AS \"Boot_Median\", round(avg(value) FILTER (k > floor(n * 0.1) AND k <= n - floor(n * 0.1)), 2) AS \"Winsorized\", round(quantile_cont(value, 0.25), 2) AS \"Conservative\" FROM r GROUP BY name")
def func_robust(spark, sf_dir):
    return _round(summary.robust(_outs(spark, sf_dir)), "Boot_Mean", "Boot_Median", "Winsorized", "Conservative", digits=2)


@query(f"{OUTS} SELECT boot_id, round(max(value) FILTER (name = 'v1:mean'), 3) AS mean, round(max(value) FILTER (name = 'v1:sd'), 3) AS sd FROM outs GROUP BY boot_id")
def func_matrix(spark, sf_dir):
    wide = _outs(spark, sf_dir).groupBy("boot_id").pivot("name", ["v1:mean", "v1:sd"]).agg(F.first("value"))
    return wide.select("boot_id", F.round("`v1:mean`", 3).alias("mean"), F.round("`v1:sd`", 3).alias("sd"))


@query(f"WITH {LINES}, {plan_sql()}, {gather_sql(('quantity', 'price', 'discount', 'tax'))} SELECT boot_id, 'means' AS name, k.range AS idx, round(CASE k.range WHEN 0 THEN avg(quantity) WHEN 1 THEN avg(price) WHEN 2 THEN avg(discount) ELSE avg(tax) END, 3) AS value FROM boots, range(4) k GROUP BY boot_id, k.range")
def func_of_frame(spark, sf_dir):
    boots = resample.block_bootstrap(src.daily_lines(spark, sf_dir), block_length=LENGTH, num_boots=BOOTS, seed=SEED)
    return _round(summary.apply_frames(boots, lambda x: {"means": x.mean().to_numpy()}), "value", digits=3)


AC = "SELECT {0} count(*) AS length, round(avg(v1), 2) AS mean, round(stddev_samp(v1), 2) AS sd, round(sum(d * l) / sum(d * d), 8) AS ac1 FROM e"


@query(f"WITH {DAY}, {plan_sql()}, {gather_sql()}, c AS (SELECT boot_id, pos, v1, v1 - avg(v1) OVER (PARTITION BY boot_id) AS d FROM boots), e AS (SELECT *, lag(d) OVER (PARTITION BY boot_id ORDER BY pos) AS l FROM c) {AC.format('boot_id,')} GROUP BY boot_id")
def replicate_stats(spark, sf_dir):
    return _round(_round(summary.replicate_stats(_boots(spark, sf_dir), "v1"), "mean", "sd", digits=2), "ac1", digits=8)


@query(f"WITH {DAY}, c AS (SELECT t, v1, v1 - avg(v1) OVER () AS d FROM s), e AS (SELECT *, lag(d) OVER (ORDER BY t) AS l FROM c) {AC.format('')}")
def original_stats(spark, sf_dir):
    return _round(_round(summary.original_stats(src.daily_revenue(spark, sf_dir), "v1"), "mean", "sd", digits=2), "ac1", digits=8)


@query(f"WITH {DAY}, {_stationary_sql(False)} SELECT boot_id AS replicate, block_no AS block_num, len AS length, start AS start_pos FROM plan")
def block_table(spark, sf_dir):
    return diagnostics.blocks_of(_boots(spark, sf_dir, bs_type="stationary"))


@query(f"WITH {DAY}, {_stationary_sql(False)}, {gather_sql()}, k AS (SELECT boot_id, pos, src_t, CASE WHEN src_t = (lag(src_t) OVER (PARTITION BY boot_id ORDER BY pos) + 1) % n.n THEN 0 ELSE 1 END AS new FROM boots, n), b2 AS (SELECT *, sum(new) OVER (PARTITION BY boot_id ORDER BY pos) AS block_num FROM k) SELECT boot_id, block_num, count(*) AS length, arg_min(src_t, pos) AS start_pos FROM b2 GROUP BY boot_id, block_num")
def recovered_blocks(spark, sf_dir):
    s = src.daily_revenue(spark, sf_dir)
    return diagnostics.blocks_by_source(_boots(spark, sf_dir, bs_type="stationary"), s.count())


@query(f"WITH {DAY}, {_stationary_sql(False)} SELECT len AS length, count(*) AS n FROM plan GROUP BY len")
def block_length_histogram(spark, sf_dir):
    return diagnostics.blocks_of(_boots(spark, sf_dir, bs_type="stationary")).groupBy("length").agg(F.count("*").alias("n"))


@query(f"WITH {DAY}, m AS (SELECT *, floor(t * 5 / (SELECT n FROM n)) AS fold FROM s) SELECT CAST(a.fold AS INTEGER) AS fold, round(avg((a.v1 - b.m) ** 2) / 1e6, 3) AS score FROM m a JOIN (SELECT f.range AS fold, avg(m.v1) AS m FROM range(5) f JOIN m ON m.fold <> f.range GROUP BY 1) b ON a.fold = b.fold GROUP BY a.fold")
def cross_validation(spark, sf_dir):
    return cv.cross_validate(src.daily_revenue(spark, sf_dir), "v1").select("fold", F.round(F.col("score") / 1e6, 3).alias("score"))


@query(f"""WITH {LINES}, m AS (SELECT avg(quantity) AS mq, avg(tax) AS mt, stddev_pop(quantity) AS sq, stddev_pop(tax) AS st FROM s),
l AS (SELECT t, (quantity - mq) / sq AS q, (tax - mt) / st AS x, lag((quantity - mq) / sq) OVER (ORDER BY t) AS lq, lag((tax - mt) / st) OVER (ORDER BY t) AS lx FROM s, m)
SELECT 'plugin' AS method, round(greatest(0.001, least(0.999, 1 - abs(sum((q + x) * (lq + lx)) / 4 / max(n.n)))), 6) AS p FROM l, n UNION ALL SELECT '1/n', round(1 / 20.0, 6)""")
def geometric_p(spark, sf_dir):
    s = src.daily_lines(spark, sf_dir).select("t", "quantity", "tax")
    rows = [("plugin", round(resample.geometric_p(s, "plugin"), 6)), ("1/n", round(resample.geometric_p(s, "1/n", LENGTH), 6))]
    return spark.createDataFrame(rows, "method string, p double")


# --- ordered functions and models
RET = "ret AS (SELECT t - 1 AS t, 100 * ln(v1 / lag(v1) OVER (ORDER BY t)) AS r FROM s QUALIFY lag(v1) OVER (ORDER BY t) IS NOT NULL)"


def _returns(spark, sf_dir) -> DataFrame:
    s = resample.lagged(src.daily_revenue(spark, sf_dir), ["v1"])
    return s.where("v1_lag1 is not null").select((F.col("t") - 1).alias("t"), (100 * F.log(F.col("v1") / F.col("v1_lag1"))).alias("r"))


@query(f"WITH {DAY}, {RET}, p AS (SELECT t, r, 100 * exp(sum(r / 100.0) OVER (ORDER BY t)) AS price FROM ret) SELECT t, round(price, 6) AS price, round(price / max(price) OVER (ORDER BY t) - 1, 8) AS drawdown, round(CASE WHEN t >= 20 THEN stddev_samp(r) OVER (ORDER BY t ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) END, 6) AS vol21, round(CASE WHEN t >= 251 THEN sqrt(252) * avg(r) OVER (ORDER BY t ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) / stddev_samp(r) OVER (ORDER BY t ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) END, 8) AS sharpe252 FROM p")
def price_path(spark, sf_dir):
    return _round(_round(summary.price_path(_returns(spark, sf_dir), "r"), "price", "vol21"), "drawdown", "sharpe252", digits=8)


@query(f"WITH RECURSIVE {DAY}, {RET}, z(t, h) AS (SELECT CAST(0 AS BIGINT), CAST(40 / (1 - 0.08 - 0.9) AS DOUBLE) UNION ALL SELECT z.t + 1, 40 + 0.08 * ret.r * ret.r + 0.9 * z.h FROM z JOIN ret ON ret.t = z.t WHERE z.t + 1 < (SELECT count(*) FROM ret)) SELECT z.t, round(h, 5) AS h, round(ret.r / sqrt(h), 6) AS z FROM z JOIN ret ON ret.t = z.t")
def garch_filter(spark, sf_dir):
    return _round(_round(summary.garch_path(_returns(spark, sf_dir), "r", 40.0, 0.08, 0.9), "h", digits=5), "z")


@query(f"WITH {DAY} SELECT t, rank() OVER (ORDER BY v1) + (count(*) OVER (PARTITION BY v1) - 1) / 2.0 AS rank, round(cume_dist() OVER (ORDER BY v1) * (SELECT n FROM n) / ((SELECT n FROM n) + 1), 10) AS u FROM s")
def pseudo_observations(spark, sf_dir):
    s = summary.average_rank(src.daily_revenue(spark, sf_dir), "v1")
    return _round(summary.pseudo_observations(s, "v1").select("t", F.col("rank").cast("double").alias("rank"), "u"), "u", digits=10)


@query(f"WITH {LINES}, m AS (SELECT sum(quantity * price) / sum(quantity) AS mx, sum(quantity * tax) / sum(quantity) AS my FROM s) SELECT round(mx, 4) AS mx, round(my, 8) AS my, round(sum(quantity * (price - mx) ** 2) / sum(quantity), 2) AS vx, round(sum(quantity * (tax - my) ** 2) / sum(quantity), 10) AS vy, round(sum(quantity * (price - mx) * (tax - my)) / sum(quantity), 6) AS cxy, round((sum(quantity * (price - mx) * (tax - my))) / sqrt(sum(quantity * (price - mx) ** 2) * sum(quantity * (tax - my) ** 2)), 8) AS corr FROM s, m GROUP BY mx, my")
def weighted_moments(spark, sf_dir):
    r = summary.weighted_moments(src.daily_lines(spark, sf_dir), "price", "tax", "quantity")
    return r.select(F.round("mx", 4).alias("mx"), F.round("my", 8).alias("my"), F.round("vx", 2).alias("vx"), F.round("vy", 10).alias("vy"), F.round("cxy", 6).alias("cxy"), F.round("corr", 8).alias("corr"))


@query(f"WITH {DAY}, {STATES}, p AS (SELECT t, x.range AS state, CASE WHEN state = x.range THEN 0.75 ELSE 0.25 END AS p FROM st, range(2) x) SELECT t, state, p, sum(p) OVER (PARTITION BY t ORDER BY state) AS ymax, sum(p) OVER (PARTITION BY t ORDER BY state) - p AS ymin FROM p")
def stacked_probabilities(spark, sf_dir):
    st = _states(spark, sf_dir)[1]
    probs = st.select("t", F.explode(F.array(F.lit(0), F.lit(1))).alias("x"), F.col("state").alias("s")).select("t", F.col("x").alias("state"), F.when(F.col("x") == F.col("s"), 0.75).otherwise(0.25).alias("p"))
    return diagnostics.stacked(probs)


def _one(df: DataFrame) -> DataFrame:
    return df.withColumn("series_id", F.lit("all"))


def _model(name: str, make: Callable[[SparkSession, str], DataFrame]) -> None:
    make.__name__ = name
    query()(make)


_model("fit_garch", lambda s, d: fits.fit_each(_one(_returns(s, d)), ["r"], fits.garch, "garch"))
_model("fit_hmm", lambda s, d: fits.fit_each(_one(_returns(s, d)), ["r"], fits.hmm, "hmm"))
_model("fit_msvar", lambda s, d: fits.fit_each(_one(src.daily_lines(s, d)), ["quantity", "price"], fits.msvar, "msvar"))
_model("decode_hmm", lambda s, d: fits.decode(_one(_returns(s, d)), ["r"]))
_model("hmm_bootstrap", lambda s, d: bootstrap.bootstrap(_returns(s, d), "hmm", num_boots=8, seed=SEED).series)


@query()
def portfolio_weights(spark, sf_dir):
    boots = resample.block_bootstrap(src.daily_lines(spark, sf_dir), block_length=LENGTH, num_boots=BOOTS, seed=SEED)
    return summary.apply_frames(boots, lambda x: {"min_variance": portfolio.min_variance(x.to_numpy()), "risk_parity": portfolio.risk_parity(x.to_numpy())})


# --- many series: 100 groups of customers, resampled side by side
MANY = """day AS (SELECT CAST(o_custkey % 100 AS VARCHAR) AS series_id, CAST(o_orderdate AS DATE) AS d, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v1 FROM orders GROUP BY 1, 2),
s AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY d) - 1 AS t, v1 FROM day), sz AS (SELECT series_id, count(*) AS n, least(20, count(*)) AS length FROM s GROUP BY 1)"""
MANY_BOOTS = 10
MANY_STATS = "SELECT series_id, boot_id, count(*) AS n, round(sum(v1), 2) AS sum_v1, round(stddev_samp(v1), 3) AS sd_v1, sum(src_t) AS sum_t FROM boots GROUP BY series_id, boot_id"
MANY_GATHER = """g AS (SELECT series_id, boot_id, pos0 + i.range AS pos, (start + i.range) % n AS src_t FROM plan, range(100000) i WHERE i.range < len),
boots AS (SELECT g.*, v1 FROM g JOIN s ON s.series_id = g.series_id AND s.t = g.src_t)"""


def _many_stats(boots: DataFrame) -> DataFrame:
    return boots.groupBy("series_id", "boot_id").agg(F.count("*").alias("n"), F.round(F.sum("v1"), 2).alias("sum_v1"), F.round(F.stddev_samp("v1"), 3).alias("sd_v1"), F.sum("src_t").alias("sum_t"))


@query(f"WITH {MANY} SELECT series_id, t, v1 FROM s")
def many_series(spark, sf_dir):
    return src.validate(src.revenue_by_group(spark, sf_dir))


@query(f"""WITH {MANY}, m AS (SELECT series_id, t, v1 - avg(v1) OVER (PARTITION BY series_id) AS x FROM s), l AS (SELECT *, lag(x) OVER (PARTITION BY series_id ORDER BY t) AS y FROM m),
r AS (SELECT series_id, count(*) AS n, coalesce(abs(sum(x * y) / nullif(sum(x * x) FILTER (t > 0), 0)), 0) AS rho FROM l GROUP BY series_id)
SELECT series_id, n, round(rho, 8) AS rho, CAST(least(n, greatest(5, CASE WHEN rho >= 1 THEN floor(sqrt(n)) ELSE least(floor(10 / (1 - rho)), floor(sqrt(n))) END)) AS INTEGER) AS block_length FROM r""")
def many_block_lengths(spark, sf_dir):
    return _round(resample.default_block_length(src.revenue_by_group(spark, sf_dir)), "rho", digits=8)


@query(f"""WITH {LINES}, m AS (SELECT t, quantity - avg(quantity) OVER () AS q, tax - avg(tax) OVER () AS x FROM s), l AS (SELECT *, lag(q) OVER (ORDER BY t) AS lq, lag(x) OVER (ORDER BY t) AS lx FROM m),
r AS (SELECT count(*) AS n, (abs(sum(q * lq) / sum(q * q)) + abs(sum(x * lx) / sum(x * x))) / 2 AS rho FROM l)
SELECT n, round(rho, 8) AS rho, CAST(greatest(5, least(floor(10 / (1 - rho)), floor(sqrt(n)))) AS INTEGER) AS block_length FROM r""")
def block_length_full_denominator(spark, sf_dir):
    return _round(resample.default_block_length(src.daily_lines(spark, sf_dir).select("t", "quantity", "tax"), "full"), "rho", digits=8)


@query(f"""WITH {MANY}, b AS (SELECT sz.*, b.range AS boot_id, k.range AS block_no FROM sz, range({MANY_BOOTS}) b, range(100000) k WHERE k.range * length < n),
plan AS (SELECT *, CAST(floor({u_sql(f"'{SEED}'", 'series_id', 'boot_id', 'block_no')} * (n - length + 1)) AS BIGINT) AS start, least(length, n - block_no * length) AS len, block_no * length AS pos0 FROM b), {MANY_GATHER} {MANY_STATS}""")
def many_moving(spark, sf_dir):
    return _many_stats(resample.block_bootstrap(src.revenue_by_group(spark, sf_dir), block_length=LENGTH, num_boots=MANY_BOOTS, seed=SEED))


@query(f"""WITH {MANY}, b AS (SELECT sz.*, b.range AS boot_id, k.range AS block_no FROM sz, range({MANY_BOOTS}) b, range(100000) k WHERE k.range < n),
f AS (SELECT *, least(CAST(floor(ln(1 - {u_sql(f"'{SEED}'", "'len'", 'series_id', 'boot_id', 'block_no')}) / ln(0.9)) AS BIGINT) + 1, greatest(1, least(ceil(ln(0.01) / ln(0.9)), floor(0.1 * n)))) AS "full" FROM b),
c AS (SELECT *, sum("full") OVER (PARTITION BY series_id, boot_id ORDER BY block_no) - "full" AS pos0 FROM f),
plan AS (SELECT *, CAST(floor({u_sql(f"'{SEED}'", "'start'", 'series_id', 'boot_id', 'block_no')} * n) AS BIGINT) AS start, least("full", n - pos0) AS len FROM c WHERE pos0 < n), {MANY_GATHER} {MANY_STATS}""")
def many_stationary(spark, sf_dir):
    return _many_stats(resample.block_bootstrap(src.revenue_by_group(spark, sf_dir), "stationary", num_boots=MANY_BOOTS, seed=SEED))


@query(f"WITH {MANY}, boots AS (SELECT series_id, b.range AS boot_id, t AS src_t, CASE WHEN {u_sql(f"'{SEED}'", 'series_id', 'b.range', 't')} < 0.5 THEN -1.0 ELSE 1.0 END * v1 AS v1 FROM s, range({MANY_BOOTS}) b) {MANY_STATS}")
def many_wild(spark, sf_dir):
    return _many_stats(resample.wild_bootstrap(src.revenue_by_group(spark, sf_dir), MANY_BOOTS, SEED))


MANY_STATES = "st AS (SELECT series_id, t, CASE WHEN v1 > median(v1) OVER (PARTITION BY series_id) THEN 1 ELSE 0 END AS state FROM s)"


def _many_states(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    s = src.revenue_by_group(spark, sf_dir)
    m = s.groupBy("series_id").agg(F.median("v1").alias("m"))
    return s, s.join(m, "series_id").select("series_id", "t", F.when(F.col("v1") > F.col("m"), 1).otherwise(0).alias("state"))


@query(f"""WITH {MANY}, {MANY_STATES}, isl AS (SELECT series_id, t, state, t - row_number() OVER (PARTITION BY series_id, state ORDER BY t) AS g FROM st),
runs AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY min(t)) - 1 AS run_no, state, min(t) AS start, count(*) AS len FROM isl GROUP BY series_id, state, g), tot AS (SELECT series_id, count(*) AS total FROM runs GROUP BY 1),
b AS (SELECT sz.*, total, b.range AS boot_id, k.range AS block_no FROM sz JOIN tot USING (series_id), range({MANY_BOOTS}) b, range(100000) k WHERE k.range < n),
d AS (SELECT *, CAST(floor({u_sql(f"'{SEED}'", 'series_id', 'boot_id', 'block_no')} * total) AS BIGINT) AS run_no FROM b),
c AS (SELECT d.*, start, len AS l, sum(len) OVER (PARTITION BY d.series_id, boot_id ORDER BY block_no) - len AS pos0 FROM d JOIN runs ON runs.series_id = d.series_id AND runs.run_no = d.run_no),
plan AS (SELECT *, least(l, n - pos0) AS len FROM c WHERE pos0 < n), {MANY_GATHER} {MANY_STATS}""")
def many_regime_runs(spark, sf_dir):
    return _many_stats(resample.regime_bootstrap(*_many_states(spark, sf_dir), MANY_BOOTS, seed=SEED))


@query(f"""WITH {MANY}, z AS (SELECT series_id, t, (v1 - avg(v1) OVER w) / nullif(stddev_pop(v1) OVER w, 0) AS z FROM s WINDOW w AS (PARTITION BY series_id)), l AS (SELECT *, lag(z) OVER (PARTITION BY series_id ORDER BY t) AS y FROM z)
SELECT series_id, round(least(0.999, greatest(0.001, 1 - abs(coalesce(sum(z * y), 0) / count(*)))), 6) AS p FROM l GROUP BY series_id""")
def many_geometric_p(spark, sf_dir):
    return _round(resample.geometric_p_table(src.revenue_by_group(spark, sf_dir), "plugin"), "p")


@query(f"WITH {MANY}, b AS (SELECT sz.*, b.range AS boot_id, k.range AS block_no FROM sz, range({MANY_BOOTS}) b, range(100000) k WHERE k.range * length < n), plan AS (SELECT *, CAST(floor({u_sql(f"'{SEED}'", 'series_id', 'boot_id', 'block_no')} * (n - length + 1)) AS BIGINT) AS start, least(length, n - block_no * length) AS len, block_no * length AS pos0 FROM b), {MANY_GATHER}, o AS (SELECT series_id, boot_id, sum(v1) AS value FROM boots GROUP BY 1, 2) SELECT series_id, 'v1:sum' AS name, round(avg(value), 3) AS mean_value, count(*) AS n FROM o GROUP BY series_id")
def front_door_means(spark, sf_dir):
    out = bootstrap.bootstrap(src.revenue_by_group(spark, sf_dir), "moving", block_length=LENGTH, num_boots=MANY_BOOTS, func={"sum": F.sum}, seed=SEED)
    return _round(out.func_out_means, "mean_value", digits=3)


# --- the front door's types
def _front(name: str, **options) -> None:
    def run(spark, sf_dir):
        series = src.daily_lines(spark, sf_dir).select("t", "quantity", "price") if options.get("bs_type") in ("msvar", "ms_varma_garch") else _returns(spark, sf_dir)
        out = bootstrap.bootstrap(series, num_boots=8, seed=SEED, func={"mean": F.avg, "sd": F.stddev_samp}, **options)
        return out.func_outs

    run.__name__ = name
    query()(run)


_front("front_hmm_sstd", bs_type="hmm", distribution="sstd_raw", micro_block_length=2)
_front("front_hmm_garch", bs_type="hmm", distribution="norm", variance_model="sGARCH")
_front("front_msvar", bs_type="msvar")
_front("front_ms_varma_garch", bs_type="ms_varma_garch", control={"max_iter": 5})


@query(f"WITH {LINES}, {plan_sql()}, {gather_sql(('quantity', 'price', 'discount', 'tax'))}, o AS (SELECT boot_id, k.range AS idx, CASE k.range WHEN 0 THEN avg(quantity) WHEN 1 THEN avg(price) WHEN 2 THEN avg(discount) ELSE avg(tax) END AS value FROM boots, range(4) k GROUP BY boot_id, k.range) SELECT 'means' AS name, idx, round(avg(value), 3) AS mean_value, count(*) AS n FROM o GROUP BY idx")
def vector_averages(spark, sf_dir):
    boots = resample.block_bootstrap(src.daily_lines(spark, sf_dir), block_length=LENGTH, num_boots=BOOTS, seed=SEED)
    return _round(summary.averages(summary.apply_frames(boots, lambda x: {"means": x.mean().to_numpy()})), "mean_value", digits=3)


WEIGHTS = "o AS (SELECT boot_id, k.range AS idx, CASE k.range WHEN 0 THEN avg(quantity) WHEN 1 THEN avg(discount) ELSE avg(tax) END / (avg(quantity) + avg(discount) + avg(tax)) AS value FROM boots, range(3) k GROUP BY boot_id, k.range)"


@query(f"WITH {LINES}, {plan_sql()}, {gather_sql(('quantity', 'price', 'discount', 'tax'))}, {WEIGHTS}, r AS (SELECT idx, avg(value) AS m, median(value) AS md, quantile_cont(value, 0.25) AS q FROM o GROUP BY idx) SELECT 'weights' AS \"Name\", idx, round(m, 6) AS \"Boot_Mean\", round(md, 6) AS \"Boot_Median\", round(q / sum(q) OVER (), 6) AS \"Conservative\" FROM r")
def robust_weights(spark, sf_dir):
    boots = resample.block_bootstrap(src.daily_lines(spark, sf_dir), block_length=LENGTH, num_boots=BOOTS, seed=SEED)
    outs = summary.apply_frames(boots.drop("price"), lambda x: {"weights": (x.mean() / x.mean().sum()).to_numpy()})
    return _round(summary.robust(outs).drop("Winsorized"), "Boot_Mean", "Boot_Median", "Conservative")


@query()
def portfolio_statistics(spark, sf_dir):
    boots = resample.block_bootstrap(src.daily_lines(spark, sf_dir), block_length=LENGTH, num_boots=BOOTS, seed=SEED)
    return summary.apply_frames(boots, lambda x: {n: f(x.to_numpy()) for n, f in portfolio.STATISTICS.items()})


@query()
def several_outputs(spark, sf_dir):
    boots = resample.block_bootstrap(src.daily_lines(spark, sf_dir), block_length=LENGTH, num_boots=BOOTS, seed=SEED)
    return summary.averages(summary.apply_frames(boots, lambda x: portfolio.several(x.to_numpy())))


@query(f"WITH {DAY}, {plan_sql()}, {gather_sql()} SELECT boot_id, 'v1:sharpe' AS name, 0 AS idx, round(avg(v1) / stddev_samp(v1) * sqrt(252), 6) AS value FROM boots GROUP BY boot_id")
def sharpe_by_column(spark, sf_dir):
    return _round(summary.apply_each(_boots(spark, sf_dir), lambda x: {"sharpe": portfolio.sharpe(x)}), "value")


# --- rows
@query("SELECT count(*) AS rows, count(*) FILTER (value IS NOT NULL AND NOT isnan(value)) AS complete FROM events")
def complete_cases(spark, sf_dir):
    return src.complete_count(spark.read.parquet(f"{sf_dir}/events.parquet").select("value"))


@query("""WITH a AS (SELECT CAST(o_orderdate AS DATE) AS d, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders GROUP BY 1), b AS (SELECT CAST(l_shipdate AS DATE) AS d, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS shipped FROM lineitem GROUP BY 1)
SELECT CAST(coalesce(a.d, b.d) AS VARCHAR) AS d, revenue, shipped FROM a FULL JOIN b ON a.d = b.d WHERE revenue IS NOT NULL AND shipped IS NOT NULL""")
def joined_on_time(spark, sf_dir):
    one = lambda t, k, v: spark.read.parquet(f"{sf_dir}/{t}.parquet").groupBy(F.to_date(k).alias("d")).agg(F.sum(F.col(v).cast("decimal(18,2)")).cast("double").alias("v"))
    return src.join_on_time({"revenue": one("orders", "o_orderdate", "o_totalprice"), "shipped": one("lineitem", "l_shipdate", "l_quantity")}, "d", "v").withColumn("d", F.col("d").cast("string"))


@query(f"WITH {DAY} SELECT t, v1 FROM s WHERE t >= (SELECT n FROM n) - 7")
def last_rows(spark, sf_dir):
    return src.tail(src.daily_revenue(spark, sf_dir), 7)


@query(f"WITH {LINES}, m AS (SELECT count(*) AS n, avg(price) AS m, stddev_samp(price) AS s, min(price) AS lo, max(price) AS hi FROM s) SELECT any_value(n) AS n, round(any_value(lo), 4) AS min, round(any_value(hi), 4) AS max, round(any_value(hi) - any_value(lo), 4) AS range, round(avg((price - m) ** 3) / any_value(m.s) ** 3, 6) AS skewness, round(avg((price - m) ** 4) / any_value(m.s) ** 4 - 3, 6) AS kurtosis, round(avg((price - m) ** 4) / avg((price - m) ** 2) ** 2 - 3, 6) AS excess_kurtosis FROM s, m")
def column_moments(spark, sf_dir):
    out = summary.moments(src.daily_lines(spark, sf_dir), "price")
    return _round(_round(out, "skewness", "kurtosis", "excess_kurtosis"), "min", "max", "range", digits=4)


@query(f"WITH {LINES} SELECT t, name, round(v, 6) AS v FROM (SELECT t, quantity, price, discount, tax FROM s) UNPIVOT (v FOR name IN (quantity, price, discount, tax))")
def long_values(spark, sf_dir):
    return _round(summary.long(src.daily_lines(spark, sf_dir), "t"), "v")


@query(f"WITH {MANY} SELECT series_id, t, round(CASE WHEN max(v1) OVER w > min(v1) OVER w THEN (v1 - min(v1) OVER w) / (max(v1) OVER w - min(v1) OVER w) ELSE 0.5 END, 8) AS scaled FROM s WINDOW w AS (PARTITION BY series_id)")
def scaled_series(spark, sf_dir):
    return _round(summary.normalised(src.revenue_by_group(spark, sf_dir), "v1", ["series_id"]).select("series_id", "t", "scaled"), "scaled", digits=8)


# --- diagnostics of replicates
PLAN_BOOTS = f"WITH {DAY}, {plan_sql()}, {gather_sql()}"


@query(f"{PLAN_BOOTS} SELECT s.t, count(src_t) AS times FROM s LEFT JOIN boots ON boots.src_t = s.t GROUP BY s.t")
def source_coverage(spark, sf_dir):
    return diagnostics.coverage(_boots(spark, sf_dir), src.daily_revenue(spark, sf_dir))


@query(f"{PLAN_BOOTS}, c AS (SELECT s.t, count(src_t) AS times FROM s LEFT JOIN boots ON boots.src_t = s.t GROUP BY s.t) SELECT count(*) FILTER (times = 0) AS never, round(avg(times), 6) AS mean, max(times) AS max, round(stddev_samp(times) / avg(times), 6) AS cv FROM c")
def coverage_summary(spark, sf_dir):
    return _round(diagnostics.coverage_summary(diagnostics.coverage(_boots(spark, sf_dir), src.daily_revenue(spark, sf_dir))), "mean", "cv")


@query(f"WITH {DAY}, {_stationary_sql(False)} SELECT count(*) AS n_blocks, round(avg(len), 6) AS mean, round(stddev_samp(len), 6) AS sd, min(len) AS min, max(len) AS max, median(len) AS median, quantile_cont(len, 0.25) AS q25, quantile_cont(len, 0.75) AS q75, round(count(*) / {BOOTS}.0, 6) AS per_replicate FROM plan")
def block_statistics(spark, sf_dir):
    return _round(diagnostics.block_stats(diagnostics.blocks_of(_boots(spark, sf_dir, bs_type="stationary"))), "mean", "sd", "per_replicate")


@query(f"WITH {DAY}, {_stationary_sql(False)} SELECT len AS length, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share, round(0.1 * 0.9 ** (len - 1), 8) AS expected FROM plan GROUP BY len")
def block_lengths_and_law(spark, sf_dir):
    return _round(diagnostics.block_length_table(diagnostics.blocks_of(_boots(spark, sf_dir, bs_type="stationary")), 0.1), "share", "expected", digits=8)


@query(f"WITH {DAY}, {plan_sql()} SELECT least(30, CAST(floor(start * 30.0 / n.n) AS INTEGER) + 1) AS bucket, count(*) AS n FROM plan, n GROUP BY 1")
def start_positions(spark, sf_dir):
    s = src.daily_revenue(spark, sf_dir)
    return diagnostics.start_position_table(diagnostics.blocks_of(_boots(spark, sf_dir)), s.count())


def _diagnosed(spark, sf_dir) -> diagnostics.Diagnostics:
    return diagnostics.compute(_boots(spark, sf_dir), src.daily_revenue(spark, sf_dir), "moving", {"block_length": LENGTH})


REPLICATES = "c AS (SELECT boot_id, pos, v1, v1 - avg(v1) OVER (PARTITION BY boot_id) AS d FROM boots), e AS (SELECT *, lag(d) OVER (PARTITION BY boot_id ORDER BY pos) AS l FROM c), st AS (SELECT boot_id, count(*) AS length, avg(v1) AS mean, stddev_samp(v1) AS sd, sum(d * l) / sum(d * d) AS ac1 FROM e GROUP BY boot_id)"


@query(f"{PLAN_BOOTS}, {REPLICATES}, bl AS (SELECT boot_id, count(*) AS n_blocks, avg(len) AS m, stddev_samp(len) AS sd FROM plan GROUP BY boot_id) SELECT st.boot_id AS replicate, st.length, n_blocks, round(m, 6) AS mean_block_length, round(bl.sd, 6) AS sd_block_length, round(st.mean, 2) AS v1_mean, round(st.sd, 2) AS v1_sd, round(ac1, 8) AS v1_ac1 FROM st LEFT JOIN bl ON st.boot_id = bl.boot_id")
def replicate_frame(spark, sf_dir):
    out = diagnostics.frame(_diagnosed(spark, sf_dir), "all")
    return _round(_round(_round(out, "v1_mean", "v1_sd", digits=2), "v1_ac1", digits=8), "mean_block_length", "sd_block_length")


@query(f"{PLAN_BOOTS}, {REPLICATES}, o AS (SELECT avg(v1) AS mean, stddev_samp(v1) AS sd FROM s), oa AS (SELECT sum(x * y) / sum(x * x) AS ac1 FROM (SELECT x, lag(x) OVER (ORDER BY t) AS y FROM (SELECT t, v1 - avg(v1) OVER () AS x FROM s))), u AS (SELECT 'mean' AS stat, mean AS v FROM st UNION ALL SELECT 'sd', sd FROM st UNION ALL SELECT 'ac1', ac1 FROM st), f AS (SELECT 'mean' AS stat, mean AS original FROM o UNION ALL SELECT 'sd', sd FROM o UNION ALL SELECT 'ac1', ac1 FROM oa) SELECT 'v1' AS name, u.stat, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, round(quantile_cont(v, 0.025), 4) AS q025, round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.5), 4) AS q50, round(quantile_cont(v, 0.75), 4) AS q75, round(quantile_cont(v, 0.975), 4) AS q975, round(any_value(original), 4) AS original, round(avg(v) - any_value(original), 4) AS bias FROM u JOIN f ON u.stat = f.stat GROUP BY u.stat")
def replicate_spread(spark, sf_dir):
    out = diagnostics.summary_stats(_diagnosed(spark, sf_dir))
    return _round(out, *(c for c in out.columns if c not in ("name", "stat")), digits=4)


@query(f"{PLAN_BOOTS}, {REPLICATES} SELECT boot_id, 'v1' AS name, round(mean, 2) AS value, round((SELECT avg(v1) FROM s), 2) AS original FROM st")
def means_comparison(spark, sf_dir):
    return _round(diagnostics.plot_table(_diagnosed(spark, sf_dir), "means_comparison"), "value", "original", digits=2)


@query(f"{PLAN_BOOTS}, {REPLICATES} SELECT min(length) AS min, max(length) AS max, round(avg(length), 4) AS mean, round(stddev_samp(length), 4) AS sd, min(length) < max(length) AS varies FROM st")
def replicate_lengths(spark, sf_dir):
    return _round(diagnostics.length_stats(_diagnosed(spark, sf_dir)), "mean", "sd", digits=4)


@query(f"{PLAN_BOOTS} SELECT boot_id, src_t AS t, count(*) AS times FROM boots WHERE boot_id < 5 GROUP BY 1, 2")
def coverage_cells(spark, sf_dir):
    return diagnostics.coverage_by_replicate(_boots(spark, sf_dir), 5)


NEAREST = f"""WITH {DAY}, {plan_sql(target='100')}, {gather_sql()}, w AS (SELECT * FROM boots WHERE boot_id < 5), d AS (SELECT w.boot_id, w.pos, arg_min(s.t, struct_pack(d := (s.v1 - w.v1) ** 2, t := s.t)) AS src FROM w, s GROUP BY 1, 2),
k AS (SELECT boot_id, pos, src, CASE WHEN src = (lag(src) OVER (PARTITION BY boot_id ORDER BY pos) + 1) % n.n THEN 0 ELSE 1 END AS new FROM d, n), b2 AS (SELECT *, sum(new) OVER (PARTITION BY boot_id ORDER BY pos) AS block_num FROM k)
SELECT boot_id, block_num, count(*) AS length, arg_min(src, pos) AS start_pos FROM b2 GROUP BY boot_id, block_num"""


@query(NEAREST)
def blocks_by_nearest_row(spark, sf_dir):
    boots = _boots(spark, sf_dir, num_blocks=5).where("boot_id < 5").drop("src_t", "block_no")
    return resample.recover_blocks(boots, src.daily_revenue(spark, sf_dir))


REGIMES = f"WITH {DAY}, {STATES}, {RUNS}"


@query(f"{REGIMES} SELECT 'original' AS series, state, start AS xmin, start + len - 1 AS xmax FROM runs")
def regime_bands(spark, sf_dir):
    return diagnostics.regime_bands(_states(spark, sf_dir)[1])


@query(f"""{REGIMES}, b AS (SELECT b.range AS boot_id, k.range AS block_no FROM range({BOOTS}) b, n, range(100000) k WHERE k.range < n.n),
d AS (SELECT boot_id, block_no, CAST(floor({u_sql(f"'{SEED}'", 'boot_id', 'block_no')} * (SELECT count(*) FROM runs)) AS BIGINT) AS run_no FROM b),
c AS (SELECT d.boot_id, block_no, state, len, sum(len) OVER (PARTITION BY boot_id ORDER BY block_no) - len AS pos0 FROM d JOIN runs USING (run_no)),
r AS (SELECT boot_id, state, sum(least(len, n.n - pos0)) AS k FROM c, n WHERE pos0 < n.n GROUP BY 1, 2), x AS (SELECT r.state, sum(k / n.n) / {BOOTS} AS m FROM r, n GROUP BY 1)
SELECT st.state, count(*) AS n, round(count(*) / (SELECT count(*) FROM st), 8) AS share, round(any_value(m), 8) AS mean_share FROM st JOIN x ON x.state = st.state GROUP BY st.state""")
def regime_diagnostics(spark, sf_dir):
    s, st = _states(spark, sf_dir)
    return _round(diagnostics.regime_summary(st, resample.regime_bootstrap(s, st, BOOTS, seed=SEED), [0, 1]), "share", "mean_share", digits=8)


@query(f"WITH {DAY}, {STATES}, p AS (SELECT t, state AS own, x.range AS state, CASE WHEN state = x.range THEN 0.75 ELSE 0.25 END AS p FROM st, range(2) x), {plan_sql()}, {gather_sql()} SELECT boot_id, pos, p.state, p.p FROM boots JOIN p ON p.t = boots.src_t WHERE boot_id < 2")
def replicate_probabilities(spark, sf_dir):
    s, st = _states(spark, sf_dir)
    probs = st.select("t", F.explode(F.array(F.lit(0), F.lit(1))).alias("x"), F.col("state").alias("s")).select("t", F.col("x").alias("state"), F.when(F.col("x") == F.col("s"), 0.75).otherwise(0.25).alias("p"))
    boots = _boots(spark, sf_dir).where("boot_id < 2").join(st.withColumnRenamed("t", "src_t"), "src_t")
    return diagnostics.replicate_probabilities(boots, probs)


@query(f"{REGIMES} SELECT state, max(len) AS longest FROM runs GROUP BY state")
def longest_stays(spark, sf_dir):
    return diagnostics.longest_run(_states(spark, sf_dir)[1])


@query(f"WITH {DAY}, {RET}, st AS (SELECT t, CASE WHEN r > 0 THEN 1 ELSE 0 END AS state FROM ret) SELECT 'original' AS series, t AS x, round(100 * exp(sum(r / 100.0) OVER (ORDER BY t)), 6) AS value, state FROM ret JOIN st USING (t)")
def regime_prices(spark, sf_dir):
    r = _returns(spark, sf_dir)
    st = r.select("t", F.when(F.col("r") > 0, 1).otherwise(0).alias("state"))
    boots = resample.regime_bootstrap(r, st, 1, seed=SEED)
    return _round(diagnostics.regime_composition(r, st, boots, "r").where("series = 'original'"), "value")


# --- cross-validation and benchmark tables
FOLDS = f"WITH {DAY}, p AS (SELECT t - 1 AS t, lag(v1) OVER (ORDER BY t) AS x, v1 AS y FROM s QUALIFY lag(v1) OVER (ORDER BY t) IS NOT NULL), z AS (SELECT count(*) AS m, count(*) // 5 AS size FROM p), f AS (SELECT f.range AS fold, f.range * size AS a, (f.range + 1) * size AS b FROM range(5) f, z)"


def _pairs(spark, sf_dir) -> DataFrame:
    return resample.lagged(src.daily_revenue(spark, sf_dir), ["v1"]).where("v1_lag1 is not null").select((F.col("t") - 1).alias("t"), F.col("v1_lag1").alias("x"), F.col("v1").alias("y"))


@query(f"{FOLDS}, tr AS (SELECT fold, avg(y) AS m FROM f, p WHERE t < a OR t >= b GROUP BY fold) SELECT g.p, CAST(f.fold AS INTEGER) AS fold, round(avg(abs(y - m)), 4) AS score FROM f JOIN tr USING (fold) JOIN p ON t >= a AND t < b, (VALUES (0.05), (0.1)) g(p) GROUP BY 1, 2")
def cv_grid_mae(spark, sf_dir):
    return _round(cv.k_fold(_pairs(spark, sf_dir), ["x"], "y", 5, [0.05, 0.1], score=cv.mae), "score", digits=4)


@query("SELECT CAST(0.01 AS DOUBLE) AS p")
def cv_choice_of_p(spark, sf_dir):
    # The mean model does not see p, so all candidates tie and the first wins
    return cv.best_p(cv.k_fold(_pairs(spark, sf_dir), ["x"], "y", 5, [0.01, 0.05, 0.1])).select("p")


#: Timings that a benchmark could have taken: the table operators are the same whatever the clock said.
TIMINGS = [(s, "num_boots", float(v), 0.01 * (i + 1) * v + 0.001 * r, r) for i, s in enumerate(("moving", "wild")) for v in (8, 16) for r in (1, 2, 3)]
TIMINGS_SQL = "t(\"Setup\", \"Parameter\", \"Value\", \"Time\", \"Rep\") AS (VALUES " + ", ".join(f"('{s}', '{p}', {v}, {t!r}, {r})" for s, p, v, t, r in TIMINGS) + ")"


@query(f"WITH {TIMINGS_SQL}, m AS (SELECT \"Setup\", \"Value\", avg(\"Time\") AS a, stddev_samp(\"Time\") AS sd FROM t GROUP BY 1, 2) SELECT \"Setup\", CAST(\"Value\" AS DOUBLE) AS \"Value\", round(CAST(a AS DOUBLE), 6) AS \"Mean_Time\", round(CAST(sd AS DOUBLE), 6) AS \"SD_Time\", round(CAST(a AS DOUBLE) / min(CAST(a AS DOUBLE)) OVER (PARTITION BY \"Value\"), 6) AS \"Relative\" FROM m")
def benchmark_summary(spark, sf_dir):
    return _round(benchmark.summarise(spark.createDataFrame(TIMINGS, benchmark.RESULTS)), "Mean_Time", "SD_Time", "Relative")


@query(f"WITH {TIMINGS_SQL} SELECT CAST(\"Value\" AS DOUBLE) AS \"Value\", round(CAST(avg(\"Time\") FILTER (\"Setup\" = 'moving') AS DOUBLE), 6) AS moving, round(CAST(avg(\"Time\") FILTER (\"Setup\" = 'wild') AS DOUBLE), 6) AS wild FROM t GROUP BY 1")
def benchmark_table(spark, sf_dir):
    return _round(benchmark.table(spark.createDataFrame(TIMINGS, benchmark.RESULTS)), "moving", "wild")


# --- recursions and likelihoods at fixed parameters
def _pair(spark, sf_dir) -> DataFrame:
    """Standardised daily means of two columns: (t, x, y)."""
    s = src.daily_lines(spark, sf_dir)
    z = lambda c: ((F.col(c) - F.avg(c).over(Window.partitionBy(F.lit(1)))) / F.stddev_pop(c).over(Window.partitionBy(F.lit(1))))
    return s.select("t", z("quantity").alias("x"), z("price").alias("y"))


PAIR = f"{LINES}, z AS (SELECT t, (quantity - avg(quantity) OVER ()) / stddev_pop(quantity) OVER () AS x, (price - avg(price) OVER ()) / stddev_pop(price) OVER () AS y FROM s)"
Q_PATH = "qb AS (SELECT corr(x, y) AS r FROM z), q(t, q11, q12, q22) AS (SELECT CAST(0 AS BIGINT), CAST(1 AS DOUBLE), r, CAST(1 AS DOUBLE) FROM qb UNION ALL SELECT z.t + 1, 0.05 + 0.05 * x * x + 0.9 * q11, 0.05 * r + 0.05 * x * y + 0.9 * q12, 0.05 + 0.05 * y * y + 0.9 * q22 FROM q JOIN z ON z.t = q.t, qb WHERE z.t + 1 < (SELECT n FROM n))"


@query(f"WITH RECURSIVE {DAY}, {RET}, z(t, h) AS (SELECT CAST(0 AS BIGINT), CAST(40 / (1 - 0.08 - 0.9) AS DOUBLE) UNION ALL SELECT z.t + 1, 40 + 0.08 * ret.r * ret.r + 0.9 * z.h FROM z JOIN ret ON ret.t = z.t WHERE z.t + 1 < (SELECT count(*) FROM ret)) SELECT 'all' AS series_id, 'garch' AS model, 'loglik' AS name, round(sum(-0.5 * (ln(2 * pi()) + ln(h) + r * r / h)), 4) AS value FROM z JOIN ret ON ret.t = z.t")
def garch_likelihood(spark, sf_dir):
    at = lambda y: {"loglik": float(GarchSpec().loglik(y[:, 0], np.array([40.0, 0.08, 0.9])).sum())}
    return _round(fits.fit_each(_returns(spark, sf_dir), ["r"], at, "garch"), "value", digits=4)


@query(f"WITH RECURSIVE {PAIR}, {Q_PATH} SELECT t, round(q11, 6) AS q11, round(q12, 6) AS q12, round(q22, 6) AS q22, round(q12 / sqrt(q11 * q22), 8) AS rho FROM q")
def dcc_correlations(spark, sf_dir):
    return _round(_round(fits.dcc_path_table(_pair(spark, sf_dir), "x", "y", 0.05, 0.9), "q11", "q12", "q22"), "rho", digits=8)


@query(f"WITH RECURSIVE {PAIR}, qb AS (SELECT corr(x, y) AS r FROM z), g(alpha, beta) AS (SELECT 0.02 + 0.04 * a.range, 0.8 + 0.04 * b.range FROM range(3) a, range(3) b), q(alpha, beta, t, q11, q12, q22) AS (SELECT CAST(alpha AS DOUBLE), CAST(beta AS DOUBLE), CAST(0 AS BIGINT), CAST(1 AS DOUBLE), r, CAST(1 AS DOUBLE) FROM g, qb UNION ALL SELECT alpha, beta, z.t + 1, 1 - alpha - beta + alpha * x * x + beta * q11, (1 - alpha - beta) * r + alpha * x * y + beta * q12, 1 - alpha - beta + alpha * y * y + beta * q22 FROM q JOIN z ON z.t = q.t, qb WHERE z.t + 1 < (SELECT n FROM n)), l AS (SELECT alpha, beta, q12 / sqrt(q11 * q22) AS p, x, y FROM q JOIN z ON z.t = q.t) SELECT round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(sum(0.5 * (ln(1 - p * p) + (x * x - 2 * p * x * y + y * y) / (1 - p * p) - x * x - y * y)), 4) AS nll FROM l GROUP BY 1, 2")
def dcc_surface(spark, sf_dir):
    z = _pair(spark, sf_dir).orderBy("t").toPandas()[["x", "y"]].to_numpy(float)
    p = inference.Problem(z, qbar=np.corrcoef(z.T))
    return _round(_round(inference.surface(spark, p, (0.02, 0.10), (0.8, 0.88), 3), "alpha", "beta"), "nll", digits=4)


@query(f"WITH RECURSIVE {DAY}, {RET}, f(t, a0, a1) AS (SELECT CAST(0 AS BIGINT), e0 / (e0 + e1), e1 / (e0 + e1) FROM (SELECT 0.5 * exp(-0.5 * (r / 30.0) ** 2) / 30 AS e0, 0.5 * exp(-0.5 * (r / 90.0) ** 2) / 90 AS e1 FROM ret WHERE t = 0) UNION ALL SELECT t1, e0 / (e0 + e1), e1 / (e0 + e1) FROM (SELECT ret.t AS t1, (0.95 * a0 + 0.1 * a1) * exp(-0.5 * (r / 30.0) ** 2) / 30 AS e0, (0.05 * a0 + 0.9 * a1) * exp(-0.5 * (r / 90.0) ** 2) / 90 AS e1 FROM f JOIN ret ON ret.t = f.t + 1)) SELECT 'all' AS series_id, t, round(a0, 8) AS p0, round(a1, 8) AS p1 FROM f")
def hidden_filter(spark, sf_dir):
    return _round(fits.filter_table(_returns(spark, sf_dir), "r", np.array([[0.95, 0.05], [0.1, 0.9]]), [0.0, 0.0], [30.0, 90.0]), "p0", "p1", digits=8)


# --- fits, one task a series
_model("fit_dcc", lambda s, d: fits.fit_each(src.daily_lines(s, d), ["quantity", "price"], fits.correlation, "dcc"))
_model("fit_dcc_t", lambda s, d: fits.fit_each(src.daily_lines(s, d), ["quantity", "price"], lambda y: fits.correlation(y, "mvt", criterion="bic"), "dcc"))
_model("fit_adcc", lambda s, d: fits.fit_each(src.daily_lines(s, d), ["quantity", "price"], fits.adcc, "adcc"))
_model("fit_copula", lambda s, d: fits.fit_each(src.daily_lines(s, d), ["quantity", "price"], lambda y: fits.copula_garch(y, transform="empirical"), "cgarch"))
_model("fit_gogarch", lambda s, d: fits.fit_each(src.daily_lines(s, d), ["quantity", "price", "tax"], fits.gogarch, "gogarch"))
_model("fit_garch_laws", lambda s, d: fits.fit_each(_returns(s, d), ["r"], lambda y: {law: float(fits.garch(y, GarchSpec(law=law))["loglik"]) for law in ("norm", "std", "ged", "sstd", "jsu")}, "garch"))
_model("fit_garch_models", lambda s, d: fits.fit_each(_returns(s, d), ["r"], lambda y: {m: float(fits.garch(y, GarchSpec(model=m))["loglik"]) for m in ("sGARCH", "gjrGARCH", "tGARCH", "eGARCH")}, "garch"))
_model("fit_garch_each", lambda s, d: fits.fit_each(src.revenue_by_group(s, d), ["v1"], fits.garch, "garch"))
_model("fit_hmm_sstd", lambda s, d: fits.fit_each(_returns(s, d), ["r"], fits.hmm_law, "hmm"))
_model("fit_ms_garch", lambda s, d: fits.fit_each(_returns(s, d), ["r"], fits.ms_garch, "ms_garch"))
_model("fit_switching", lambda s, d: fits.fit_switching_each(src.daily_lines(s, d), ["quantity", "price"], switching.specs("dcc", 2), max_iter=6))
_model("fit_switching_arma", lambda s, d: fits.fit_switching_each(_returns(s, d), ["r"], switching.specs("univariate", 2), max_iter=6))
_model("covariance_path", lambda s, d: fits.covariance_path(src.daily_lines(s, d), ["quantity", "price"], "gogarch"))


def _events(spark, sf_dir) -> DataFrame:
    return src.materialise(fits.switching_events(src.daily_lines(spark, sf_dir), ["quantity", "price"], switching.specs("dcc", 2), max_iter=6), "events")


_model("em_iterations", lambda s, d: em_log.iterations(_events(s, d)).drop("seconds"))
_model("em_overview", lambda s, d: em_log.overview(_events(s, d)).drop("seconds"))
_model("em_problems", lambda s, d: em_log.problems(_events(s, d)))
_model("em_trajectory", lambda s, d: em_log.trajectory_with_likelihood(_events(s, d)))


def _problem(spark, sf_dir, kind: str = "dcc") -> inference.Problem:
    return inference.residuals_of(src.daily_lines(spark, sf_dir), ["quantity", "price"], kind)


_model("dcc_inference", lambda s, d: inference.comprehensive(s, _problem(s, d), n_boot=16, points=10))
_model("copula_inference", lambda s, d: inference.comprehensive(s, _problem(s, d, "cgarch"), n_boot=16, boot_method="parametric", points=0))
_model("dcc_monte_carlo", lambda s, d: montecarlo.study_summary(montecarlo.dcc_study(s, 16, 300)))
_model("gogarch_monte_carlo", lambda s, d: montecarlo.study_summary(montecarlo.gogarch_study(s, 8, 300)))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.summarize(summary.apply_columns(_boots(spark, sf_dir, bs_type="stationary"), {"mean": F.avg, "sd": F.stddev_samp}))


from serieslab.plans import fixed as _fixed  # noqa: E402, F401  (it registers its queries)
