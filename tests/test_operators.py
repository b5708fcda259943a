"""Operators that no registered query reaches, on small frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from serieslab import demos
from serieslab.demos import portfolio as portfolio_demo
from serieslab.demos import regimes as regimes_demo
from serieslab.operators import benchmark, bootstrap, cv, diagnostics, resample, summary
from serieslab.sources import series as src

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def line(spark):
    return spark.createDataFrame([(i, float((i * 7) % 11)) for i in range(60)], "t long, v double")


def test_benchmark_runs_its_grid(spark, line):
    ticks = iter(range(1000))
    got = benchmark.benchmark(line, {"moving": {"bs_type": "moving"}, "broken": {"bs_type": "msvar"}}, "num_boots", [2, 4], 2, clock=lambda: float(next(ticks)))
    rows = got.collect()
    assert len(rows) == 8 and all((r["Time"] is None) == (r["Setup"] == "broken") for r in rows)
    assert benchmark.fastest(got.where("Setup = 'moving'")).first()["Setup"] == "moving"
    assert benchmark.plot_table(got).count() == 8 and benchmark.table(got).count() == 2 and benchmark.growth(got).count() == 4
    assert benchmark.benchmark(line, {"m": {}}, "n_assets", [1, 5], 1).count() == 1
    with pytest.raises(ValueError):
        benchmark.benchmark(line, {}, "num_boots", [1])


def test_cross_validation_with_a_model_of_p(spark, line):
    class Drift:
        """A model that looks at the candidate p."""

        def __init__(self, x, y, p):
            self.p = p

        def predict(self, x):
            return np.full(len(x), 5 + abs(self.p - 0.2))

    pairs = line.select("t", F.col("v").alias("x"), F.lit(5.0).alias("y"))
    scores = cv.k_fold(pairs, ["x"], "y", 4, [0.1, 0.2, 0.3], model=Drift, score=cv.mae)
    assert scores.count() == 12 and cv.best_p(scores).first()["p"] == 0.2
    assert cv.folds(10, 3) == [(0, 3), (3, 6), (6, 9)]
    with pytest.raises(ValueError):
        cv.folds(2, 3)
    preds = spark.createDataFrame([("a", 1.0, 3.0), ("a", 2.0, 1.0)], "g string, p double, y double")
    assert summary.weighted_score(preds, "p", "y", ["g"]).first()[1:] == (2.5, 1.5)


def test_blocks_that_do_not_wrap(spark, line):
    rows = resample.block_bootstrap(line, "stationary", block_length=6, num_boots=30, p=0.2, circular=False)
    last = rows.groupBy("boot_id", "block_no").agg((F.max("src_t") - F.min("src_t")).alias("span"), F.count("*").alias("n"))
    assert last.where("span <> n - 1").count() == 0


def test_point_estimates_stand_beside_robust_ones(spark, line):
    outs = summary.apply_columns(resample.block_bootstrap(line, num_boots=6), {"mean": F.avg})
    point = spark.createDataFrame([("v:mean", 5.0)], "name string, value double")
    assert summary.robust(outs, point=point).first()["Point"] == 5.0


def test_failing_statistics(spark, line):
    boots = resample.block_bootstrap(line, num_boots=3)

    def fails(x):
        raise RuntimeError("no")

    assert summary.apply_each(boots, fails, graceful=True).count() == 0
    with pytest.raises(Exception):
        summary.apply_each(boots, fails).count()


def test_regime_tables(spark, line):
    states = line.select("t", (F.floor(F.col("t") / 10) % 2).cast("int").alias("state"))
    boots = resample.regime_bootstrap(line, states, 3, seed=2)
    assert diagnostics.regime_composition(line, states, boots, "v", prices=False).count() == 120
    probs = diagnostics.probability_table(states.select("t", (1 - F.col("state")).cast("double").alias("p0"), F.col("state").cast("double").alias("p1")), ["p0", "p1"])
    for style in diagnostics.STYLES:
        assert diagnostics.probability_layer(probs, style).count() == 120
    with pytest.raises(ValueError):
        diagnostics.probability_layer(probs, "x")
    own = diagnostics.replicate_probabilities(boots, probs.drop("series")).groupBy("boot_id", "pos").agg(F.sum("p").alias("s"))
    assert own.where("abs(s - 1) > 1e-9").count() == 0
    assert diagnostics.replicate_probabilities(boots, probs.where("t < 0").drop("series")).where("p = 1").count() == boots.count()
    assert diagnostics.block_segments(boots, 2).where("end < start").count() == 0


def test_wild_replicates_are_the_series_up_to_signs(spark, line):
    rows = resample.wild_bootstrap(line, 40).join(line.withColumnRenamed("v", "x").withColumnRenamed("t", "pos"), "pos")
    assert rows.where("abs(v) <> abs(x)").count() == 0
    share = rows.where("x > 0").agg(F.avg((F.col("v") > 0).cast("double"))).first()[0]
    assert abs(share - 0.5) < 0.05


def test_logs_sources_and_sinks(spark, line, tmp_path):
    with src.log_to(f"{tmp_path}/log") as log:
        log.info("hello")
    assert "hello" in (tmp_path / "log").read_text()
    made = src.simulated(spark, 3, lambda i: np.random.default_rng(i).standard_normal((20, 2)), ["a", "b"])
    assert made.groupBy("series_id").count().where("count = 20").count() == 3
    assert src.head(made, 5).count() == src.tail(made, 5).count() == 15
    assert src.complete(line.withColumn("v", F.when(F.col("t") > 1, F.col("v")))).count() == 58
    src.write_tables({"a": line}, str(tmp_path / "t"))
    assert src.read_tables(spark, str(tmp_path / "t"), ["a"])["a"].count() == 60


def test_demos(spark):
    assert demos.names() == ["portfolio", "regimes"] and demos.path("regimes").exists()
    with pytest.raises(ValueError):
        demos.path("x")
    tables = portfolio_demo.run(spark, SF, 4)
    total = tables["outs"].groupBy("boot_id", "name").agg(F.sum("value").alias("s"))
    assert total.where("abs(s - 1) > 1e-6").count() == 0
    assert regimes_demo.run(spark, SF, 3)["shares"].count() == 2


def test_graceful_front_door(spark, line):
    assert bootstrap.bootstrap(line.withColumn("v", F.lit(None).cast("double")), graceful=True) is None
