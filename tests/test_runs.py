"""The execute phase and its store, result rows, trees under nested validation, kept models, prepared tables, type alignment."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.operators import compare, execute, metrics, results, selection, trees
from furrow.plans import runs
from furrow.sources import files

RES = "run_id int, model string, crop string, adm_id int, year int, y_true double, y_pred double, area double, weight double"


def res_rows(seed=0):
    rng = np.random.default_rng(seed)
    weight = {(u, c): float(rng.uniform(1, 9)) for u in range(6) for c in "ab"}
    rows = []
    for run in (1, 2):
        for c in "ab":
            for u in range(6):
                for y in range(2000, 2009):
                    t = float(rng.normal(10)) if (u, y) != (2, 2003) else None
                    p = float(rng.normal(10)) if (u, y, run) != (3, 2004, 2) else None
                    rows.append((run, f"m{run}", c, u, y, t, p, weight[u, c], weight[u, c]))
    return rows


def test_result_errors_match_the_levels_one_by_one(spark):
    res = spark.createDataFrame(res_rows(), RES)
    got = {(r.run_id, r.crop): r for r in results.errors(res).collect()}
    assert len(got) == 4
    of = lambda df: {(r.run_id, r.crop): r for r in df.collect()}
    overall, years, units, country, poor = of(metrics.overall(res)), of(metrics.averaged(res, "year")), of(metrics.averaged(res, "adm_id")), of(metrics.country_summary(res)), of(metrics.lowest_quartile(res))
    mean_true = {k: np.mean([r[5] for r in res_rows() if (r[0], r[2]) == k and r[5] is not None]) for k in got}
    country_mean = {}
    for r in metrics.country(res).collect():
        country_mean.setdefault((r.run_id, r.crop), []).append(r.y_true)
    for k, r in got.items():
        near = lambda a, b: a == pytest.approx(b, abs=1e-9)
        assert near(r.r2_overall, overall[k].r2) and near(r.mae, overall[k].mae) and near(r.me, overall[k].me) and near(r.rmse, overall[k].rmse)
        assert near(r.rmae_prct, overall[k].mae / mean_true[k] * 100) and near(r.rmse_spatial, years[k].rmse) and near(r.r2_spatial, years[k].r2) and near(r.r2_temporal, units[k].r2)
        assert near(r.country_r2, country[k].r2) and near(r.country_mae, country[k].mae) and near(r.country_rmse, country[k].rmse) and near(r.country_fq_rmse, poor[k].rmse)
        assert near(r.country_fq_rrmse_prct, poor[k].rmse / np.mean(country_mean[k]) * 100) and near(r.rrmse_spatial_prct, years[k].rmse / mean_true[k] * 100)


def test_result_errors_read_the_predictions_once(spark, tmp_path):
    path = f"file://{tmp_path}/res"
    spark.createDataFrame(res_rows(), RES).write.parquet(path)
    plan = results.errors(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("Expand") == 1


def test_result_rows_have_all_columns(spark, sf):
    rows = runs.result_rows(spark, sf).collect()
    assert rows[0].__fields__ == results.COLUMNS and len(results.COLUMNS) == 43
    families = {}
    for r in rows:
        families.setdefault(r.estimator, []).append(r)
    assert set(families) == {"Null_model", "Trend", "PeakModel", "Lasso", "RandomForest"} and len({len(v) for v in families.values()}) == 1
    assert all(r.rmse > 0 and r.country_rmse > 0 and r.hours > 0 and r.run_id == r.run_id.zfill(6) for r in rows)
    for r in families["Lasso"]:
        assert r.coefficients.startswith("Intercept: ") and r.hyper_params.startswith("alpha:") and r.r2_fit <= 1 and r.rmse_val > 0 and r.n_selected == 3


# --- execute phase


def panel(spark):
    return spark.createDataFrame([(c, i, float(i * k)) for k, c in enumerate("abc", 1) for i in range(20)], "crop string, i int, x double")


def specs(spark):
    return spark.createDataFrame([(k, c, kind) for k, (c, kind) in enumerate(((c, k) for c in "abc" for k in ("sum", "max")), 1)], "run_id int, crop string, kind string")


def runner(p, made):
    def run(s):
        made.append(s["run_id"])
        if s["crop"] == "b" and s["kind"] == "max":
            raise RuntimeError("this one breaks")
        return p.where(F.col("crop") == s["crop"]).groupBy("crop").agg((F.sum if s["kind"] == "sum" else F.max)("x").alias("value"))

    return run


def test_batch_equals_serial_and_one_failure_stops_nothing(spark):
    p, made = panel(spark), []
    source = execute.input_fingerprint(p)
    out = {}
    for parallel in (1, 4):
        store = execute.Store(spark, files.scratch(spark))
        got = execute.batch(specs(spark), runner(p, made), source, store, parallel).collect()
        assert {r.run_id: r.status for r in got} == {1: "done", 2: "done", 3: "done", 4: "failed", 5: "done", 6: "done"}
        assert "this one breaks" in next(r.error for r in got if r.run_id == 4)
        out[parallel] = sorted((r.fingerprint, r.crop, r.value) for r in store.predictions().collect())
    assert out[1] == out[4] and len(out[1]) == 5


def test_second_batch_plans_nothing_and_a_changed_input_is_new(spark):
    p, made = panel(spark), []
    store, source = execute.Store(spark, files.scratch(spark)), execute.input_fingerprint(p)
    execute.batch(specs(spark), runner(p, made), source, store)
    made.clear()
    again = {r.run_id: r.status for r in execute.batch(specs(spark), runner(p, made), source, store).collect()}
    assert made == [4] and [again[k] for k in (1, 2, 3, 5, 6)] == ["cached"] * 5
    # order and partitioning of the input don't matter, a value does; a run's number doesn't, its settings do
    assert execute.input_fingerprint(p.orderBy(F.desc("x")).repartition(7)) == source
    changed = execute.input_fingerprint(p.withColumn("x", F.when(F.col("i") == 3, F.col("x") + 1).otherwise(F.col("x"))))
    assert changed != source and execute.input_fingerprint(p.union(p.limit(1))) != source
    assert execute.fingerprint({"run_id": 1, "crop": "a"}, source) == execute.fingerprint({"run_id": 2, "crop": "a"}, source) != execute.fingerprint({"run_id": 1, "crop": "b"}, source)
    made.clear()
    assert {r.status for r in execute.batch(specs(spark).where("run_id <> 4"), runner(p, made), changed, store).collect()} == {"done"} and sorted(made) == [1, 2, 3, 5, 6]


def test_run_without_a_record_is_made_again(spark):
    """Predictions alone, as a run leaves them that broke off, don't count as done."""
    p, made = panel(spark), []
    store, source = execute.Store(spark, files.scratch(spark)), execute.input_fingerprint(p)
    first = specs(spark).where("run_id = 1")
    key = execute.fingerprint({"run_id": 1, "crop": "a", "kind": "sum"}, source)
    p.limit(1).write.parquet(f"{store.path}/predictions/fingerprint={key}")
    assert store.records().count() == 0 and execute.missing(execute.status(first, source, store)).count() == 1
    assert execute.batch(first, runner(p, made), source, store).first().status == "done" and made == [1]
    assert [r.value for r in store.predictions().collect()] == [190.0]


def test_slow_runs(spark):
    state = spark.createDataFrame([(1, True, 1.0), (2, True, 1.2), (3, True, 9.0), (4, False, None)], "run_id int, done boolean, seconds double")
    assert [r.run_id for r in execute.slow(state).collect()] == [3] and [r.run_id for r in execute.missing(state).collect()] == [4]


def test_prepared_tables_join_without_exchange(spark, sf):
    df = runs.prepared_join(spark, sf)
    assert df.count() > 0
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString().split("AggregateExec")[0].replace("BroadcastExchange", "Exchange")


# --- trees


def table(spark, seed=0, change=None):
    rng = np.random.default_rng(seed)
    rows = []
    for c in "ab":
        for u in range(8):
            for y in range(2000, 2004):
                x = float(rng.normal())
                rows.append((u, c, y, 3 * x + 10 + float(rng.normal(0, 0.1)) + (500 if y == change else 0), x, float(rng.normal())))
    return spark.createDataFrame(rows, "adm_id int, crop string, year int, yield double, x double, z double").coalesce(1)


def test_nested_trees_keep_all_cores_busy(spark, monkeypatch):
    """A fit has one small task at a time: there are more of them side by side than cores."""
    seen = []
    monkeypatch.setattr(trees, "side_by_side", lambda jobs, parallel: seen.append(parallel) or [job() for job in jobs])
    trees.nested(table(spark).where("year < 2003"), ["x", "z"], "boosted", {"rate": [0.3], "depth": [2], "share": [0.1], "trees": [2]})
    assert len(seen) == 2 and min(seen) > spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("kind, grid", [("forest", {"depth": [3], "subset": ["all"], "trees": [2, 6]}), ("boosted", {"rate": [0.3], "depth": [2], "share": [0.1], "trees": [2, 4]})])
def test_nested_trees_predict_every_year_from_the_others(spark, kind, grid):
    a = {(r.crop, r.adm_id, r.year): r for r in trees.nested(table(spark), ["x", "z"], kind, grid).collect()}
    b = {(r.crop, r.adm_id, r.year): r for r in trees.nested(table(spark, change=2002), ["x", "z"], kind, grid).collect()}
    assert len(a) == len(b) == 64 and {r.setting for r in a.values()} <= {trees.name(s | {"trees": n}) for s in trees.settings(grid) for n in grid["trees"]}
    # the labels of a year have no part in its own predictions or in the choice of its setting, but in those of the others
    assert all(a[k].y_pred == b[k].y_pred and a[k].setting == b[k].setting for k in a if k[2] == 2002)
    assert any(a[k].y_pred != b[k].y_pred for k in a if k[2] != 2002)
    if kind == "forest":
        assert np.mean([abs(r.y_pred - r.y_true) for r in a.values()]) < np.mean([abs(r.y_true - 10) for r in a.values()])


def test_settings_are_chosen_without_the_held_out_year():
    errors = {("a", 1, 2, "s"): 1.0, ("a", 1, 3, "s"): 5.0, ("a", 1, 2, "t"): 2.0, ("a", 1, 3, "t"): 2.0, ("a", 2, 1, "s"): 1.0, ("a", 2, 1, "t"): 1.0}
    assert trees.choose(errors) == {("a", 1): "t", ("a", 2): "s"}


def test_first_trees_are_the_smaller_model(spark):
    t = table(spark)
    setting = {"depth": 3, "subset": "all", "trees": 5}
    fitted = trees.pipeline("forest", ["x", "z"], setting).fit(t)
    rows, by_count = trees.predictions(fitted, t, [2, 5])
    whole = {(r.crop, r.adm_id, r.year): r.p for r in fitted.transform(t).select("crop", "adm_id", "year", F.col("__p").alias("p")).collect()}
    assert all(r.p == pytest.approx(whole[r.crop, r.adm_id, r.year]) for r in rows.select("crop", "adm_id", "year", by_count[5].alias("p")).collect())


def test_kept_model_forecasts_without_labels(spark):
    t = table(spark)
    fitted = trees.pipeline("boosted", ["x", "z"], {"rate": 0.1, "depth": 2, "trees": 3}).fit(t.where("year < 2003"))
    path = trees.keep(fitted, files.scratch(spark))
    now = t.where("year = 2003").drop("yield")
    got = {(r.crop, r.adm_id): r.y_pred for r in trees.forecast(spark, path, now).collect()}
    assert got == {(r.crop, r.adm_id): r.p for r in fitted.transform(now).select("crop", "adm_id", F.round("__p", 4).alias("p")).collect()} and len(got) == 16


# --- types and names


def test_widest_type():
    w = lambda a, b: compare.widest(T._parse_datatype_string(a), T._parse_datatype_string(b)).simpleString()
    for a, b, c in (("int", "bigint", "bigint"), ("tinyint", "smallint", "smallint"), ("bigint", "float", "double"), ("int", "decimal(5,2)", "decimal(12,2)"), ("decimal(5,2)", "decimal(9,4)", "decimal(9,4)"), ("string", "date", "date"), ("date", "timestamp", "timestamp"), ("string", "double", "double"), ("array<int>", "array<bigint>", "array<bigint>"), ("struct<a:int,b:date>", "struct<a:double,b:timestamp>", "struct<a:double,b:timestamp>"), ("map<string,int>", "map<string,bigint>", "map<string,bigint>"), ("boolean", "int", "int")):
        assert w(a, b) == w(b, a) == c
    with pytest.raises(TypeError):
        w("array<int>", "string")


def test_diff_aligns_types(spark):
    left = spark.createDataFrame([(1, 1.5, dt.date(2024, 1, 1), Decimal("2.50"), "a"), (2, 2.0, None, None, None)], "i int, x float, d date, m decimal(5,2), s string")
    right = spark.createDataFrame([(1, "1.5", dt.datetime(2024, 1, 1), 2.5, "a"), (2, "zwei", None, None, None)], "i bigint, x string, d timestamp, m double, s string")
    assert {(r.i, r.x, r.side) for r in compare.table_diff(left, right).collect()} == {(2, 2.0, "left_only"), (2, None, "right_only")}


def test_relevance_by_name_reads_names_as_names(spark):
    rows = [(float(i), float(i * i % 7), float(2 * i + i % 3), "t") for i in range(30)]
    spark.createDataFrame(rows, "`a b` double, `x``; DROP TABLE q; --` double, y double, label string").createOrReplaceTempView("odd_names")
    got = {r.feature: r.f for r in selection.relevance_by_name(spark, "odd_names", "y").collect()}
    assert set(got) == {"a b", "x`; DROP TABLE q; --"} and got["a b"] > 100
    for bad in ("odd_names; DROP VIEW odd_names", "(SELECT 1)", "odd_names WHERE 1 = 1"):
        with pytest.raises(Exception, match="(?i)parse|not found|identifier"):
            selection.relevance_by_name(spark, bad, "y")
    assert spark.table("odd_names").count() == 30
