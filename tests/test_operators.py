import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import dekad, stats
from furrow.operators import benchmarks, compare, features, forecast, learn, metrics, paired, panel, ranking, records, running, scaling, seasonal, selection, specs, trend, tuning
from furrow.sources import files


def labels(spark, rows):
    return spark.createDataFrame(rows, "adm_id int, crop string, year int, area double, production double, yield double")


def series(spark, ys, first=2001):
    return labels(spark, [(1, "a", first + i, 1.0, y, y) for i, y in enumerate(ys)])


def test_theil_sen_golden(spark):
    r = trend.theil_sen(series(spark, [2.0, 4.0, 3.0, 5.0, 9.0, 4.5, 6.0])).first()
    assert (r.slope, r.intercept) == (0.5, -997.5)


def test_mann_kendall_golden(spark):
    r = trend.mann_kendall(series(spark, [2.0, 4.0, 3.0, 5.0, 9.0, 4.5, 6.0])).first()
    assert (r.s, round(r.var_s, 4), round(r.z, 6), r.trend) == (13, 44.3333, 1.802254, "no trend")


def test_mann_kendall_of_constant_series(spark):
    r = trend.mann_kendall(series(spark, [3.0] * 6)).first()
    assert (r.s, r.z, r.trend) == (0, 0.0, "no trend")


def test_errors_golden(spark):
    d = spark.createDataFrame([(1.1, 1.0), (1.9, 2.0), (3.3, 3.0), (3.6, 4.0), (None, 5.0), (2.0, None)], "p double, t double").where("t < 5 or t is null")
    r = d.agg(*(c.alias(k) for k, c in stats.summary(F.col("p"), F.col("t")).items())).first()
    assert r.n == 4
    for k, v in {"me": -0.025, "mae": 0.225, "rmse": 0.259808, "rrmse_prct": 10.392305, "r2": 0.946, "r2_pearson": 0.950330}.items():
        assert r[k] == pytest.approx(v, abs=1e-6)


def test_constant_truth_has_no_r2(spark):
    r = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "p double, t double").agg(stats.r2(F.col("p"), F.col("t")).alias("a"), stats.pearson(F.col("p"), F.col("t")).alias("b")).first()
    assert r.a is None and r.b is None


def test_percentile_position_golden(spark):
    g = spark.createDataFrame([(x,) for x in (2.0, 4.0, 3.0, 5.0, 9.0)], "x double").agg(stats.percentile_grid(F.col("x")).alias("g"))
    for t, want in ((1.0, 0.0), (3.5, 0.38), (4.0, 0.51), (8.9, 1.0), (9.5, 1.0), (9.0, 1.0)):
        assert g.select(stats.percentile_position(F.col("g"), F.lit(t))).first()[0] == want


def test_dekads(spark):
    d = spark.createDataFrame([(dt.date(2020, 2, 29),), (dt.date(2021, 1, 31),)], "d date")
    k = dekad.from_date(F.col("d"))
    rows = d.select(k.alias("k"), dekad.to_raw(k).alias("raw"), dekad.days(k).alias("days"), dekad.from_raw(dekad.to_raw(k)).alias("back"), dekad.from_mmdd(F.date_format("d", "MMdd")).alias("kk")).collect()
    assert [tuple(r) for r in rows] == [(202006, 4326, 9, 202006, 6), (202103, 4359, 11, 202103, 3)]


def test_season_wraps(spark):
    d = spark.createDataFrame([(dt.date(2003, 12, 1),), (dt.date(2004, 3, 1),)], "d date")
    rows = d.select(dekad.season_year(F.col("d"), 11, 5), dekad.season_index(F.month("d"), 11)).collect()
    assert [tuple(r) for r in rows] == [(2004, 2), (2004, 5)]
    assert dekad.season_length(4, 4) == 1 and dekad.season_length(11, 5) == 7


def test_retain(spark):
    d = labels(spark, [(i, "a", 2001, x, x, 1.0) for i, x in enumerate((50.0, 30.0, 15.0, 5.0), 1)])
    s = panel.unit_statistics(d)
    assert sorted(r.adm_id for r in panel.retain(s, 90).collect()) == [1, 2, 3]
    assert panel.retain(s, 100).count() == 4


def test_outlier_golden(spark):
    ys = [1.0 + i * 1e-9 for i in range(12)] + [10.0]
    r = panel.flagged(series(spark, ys)).where("outlier is not null").collect()
    assert [x.outlier for x in r] == ["Removed"] and r[0].z == pytest.approx(3.4641, abs=1e-4)


def test_cleaning_drops_null_measures_and_keeps_flag_nulls(spark):
    d = labels(spark, [(1, "a", 1, 1.0, 1.0, 1.0), (1, "a", 2, None, 1.0, 2.0), (1, "a", 3, 1.0, 1.0, 1.5)])
    assert panel.cleaned(d).count() == 2


def test_interpolation(spark):
    d = spark.createDataFrame([(1, 1, None), (1, 2, 2.0), (1, 3, None), (1, 4, None), (1, 5, 8.0), (1, 6, None)], "k int, n int, v double")
    assert [r.v_filled for r in features.interpolate(d, ["k"], "n", "v").orderBy("n").collect()] == [None, 2.0, 4.0, 6.0, 8.0, 8.0]


def test_closed_form_peak_model_equals_refits(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=8), rng.normal(size=8)
    rows = [(1, "a", 2000 + i, 1.0, 1.0, None if i == 4 else float(y[i]), float(x[i])) for i in range(8)]
    d = spark.createDataFrame(rows, "adm_id int, crop string, year int, area double, production double, yield double, x double")
    got = {r.year: r.predicted for r in benchmarks.peak_model(d, "x").collect()}
    for i in range(8):
        use = [k for k in range(8) if k not in (i, 4)]
        a, b = np.polyfit(x[use], y[use], 1)
        assert got[2000 + i] == pytest.approx(a * x[i] + b)


def test_null_model_single_row(spark):
    assert benchmarks.null_model(series(spark, [1.0])).first().predicted is None


def test_clamp(spark):
    d = spark.createDataFrame([(1.0, 2.0, 4.0, 10.0, 3.0, 0.1, 0.2), (3.0, 2.0, 4.0, 10.0, 3.0, 0.5, 0.6), (9.0, 2.0, 4.0, 10.0, 3.0, 1.0, 1.0)], "fyield double, p10 double, p90 double, area_last5 double, yield_last5 double, fyield_position double, fproduction_position double")
    assert [(r.fyield, r.fproduction, r.fproduction_position) for r in forecast.clamp(d).orderBy("fyield").collect()] == [(2.0, 20.0, None), (3.0, 30.0, 0.6), (4.0, 40.0, None)]


def test_f_relevance_golden(spark):
    d = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 1.0, 2.0), (3.0, 5.0, 2.5), (4.0, 3.0, 4.0), (5.0, 6.0, 5.0)], "x1 double, x2 double, y double")
    f = {r.feature: r.f for r in selection.relevance_regression(d, ["x1", "x2"], "y").collect()}
    assert f["x1"] == pytest.approx(150.0) and f["x2"] == pytest.approx(2.796476, abs=1e-6)
    assert selection.correlations(d, ["x1", "x2"]).first().r == pytest.approx(0.762493, abs=1e-6)
    assert [r.feature for r in selection.mrmr(d, ["x1", "x2"], "y", 2).orderBy("rank").collect()] == ["x1", "x2"]


def test_percent_grid():
    assert selection.percent_grid(3, [5, 25, 50, 75, 100]) == [(25, 1), (75, 2), (100, 3)]  # 1.5 and 2.25 both round to 2; 0.15 is no feature


def test_forest_tasks_hold_bounded_rows(spark):
    d = spark.range(1000, numPartitions=1).selectExpr("CAST(id AS DOUBLE) AS x", "CAST(id % 7 AS DOUBLE) AS z", "CASE WHEN id % 10 > 0 THEN CAST(id * 2 AS DOUBLE) END AS y")
    t = selection.forest_rows(d, ["x", "z", "y"], 250)
    assert max(map(len, t.rdd.glom().collect())) <= 250 and sorted(t.collect()) == sorted(d.dropna().collect())
    assert selection.forest_rows(d, ["x", "z", "y"], 1000).rdd.getNumPartitions() == 1
    f = {r.feature: r.f for r in selection.forest_importance(d, ["x", "z"], "y").collect()}
    assert f["x"] > 0.9 and sum(f.values()) == pytest.approx(1)


def test_wilcoxon_signed_ranks(spark):
    d = spark.createDataFrame([(1, 2.0, 1.0), (1, 1.0, 2.0), (1, 5.0, 2.0), (1, 3.0, 3.0)], "g int, x double, y double")
    r = paired.signed_ranks(d, ["g"], "x", "y").first()
    assert (r.n, r.w_plus, r.w_minus) == (3, 4.5, 1.5)
    assert learn.wilcoxon(np.array([1.0, -1.0, 3.0, 0.0]))[0] == 4.5


def test_table_diff_counts_repeats(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted((r.x, r.side) for r in compare.table_diff(a, b).collect()) == [(1, "left_only"), (2, "left_only"), (3, "right_only")]


def test_constant_column_scales_to_zero(spark):
    assert {r.x_z for r in scaling.scale_global(spark.createDataFrame([(2.0,), (2.0,)], "x double"), ["x"]).collect()} == {0.0}


def test_lasso_kkt():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5)) * [1, 10, 0.1, 1, 1] + 3
    y = x @ np.array([2.0, 0, -10.0, 0, 0]) + 0.1 * rng.normal(size=60)
    sums = tuning.Sums(60, x.sum(axis=0), (x.T @ x).ravel(), y.sum(), x.T @ y, y @ y)
    w, b = sums.fit(0.2, sums.scale())
    z, r = (x - x.mean(axis=0)) / x.std(axis=0), y - x @ (w / x.std(axis=0)) - b
    g = z.T @ r / len(y)
    assert np.all(np.abs(g) <= 0.2 + 1e-6) and np.allclose(np.abs(g[w != 0]), 0.2, atol=1e-6)
    assert sums.rmse(w / x.std(axis=0), b) == pytest.approx(np.sqrt(np.mean(r * r)))
    assert np.all(sums.fit(sums.path(sums.scale())[0] * 1.0001, sums.scale())[0] == 0)


def panel_of(spark, crops=("a", "b"), years=6, units=7):
    rng = np.random.default_rng(5)
    rows = []
    for c in crops:
        for t in range(years):
            for u in range(units):
                x, z = rng.normal(), 5 * rng.normal()
                rows.append((u, c, 2000 + t, 1.0, 1.0, float(3 * x - 0.2 * z + 10 + 0.3 * rng.normal()) if (t, u) != (2, 3) else None, float(x) if (t, u) != (1, 1) else None, float(z)))
    return spark.createDataFrame(rows, "adm_id int, crop string, year int, area double, production double, yield double, x double, z double")


def test_nested_lasso_from_sums_equals_refits(spark):
    """Every fold and every inner fold fitted again on its rows, by coordinate descent over rows."""

    def fit(x, y, alpha):
        m, my = x.mean(axis=0), y.mean()
        w = np.zeros(x.shape[1])
        for _ in range(2000):
            for j in range(len(w)):
                r = y - my - (x - m) @ w + (x[:, j] - m[j]) * w[j]
                rho = ((x[:, j] - m[j]) * r).mean()
                w[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / ((x[:, j] - m[j]) ** 2).mean()
        return lambda q: (q - m) @ w + my

    alphas = [0.01, 0.3, 2.0]
    t = panel_of(spark)
    fitted = tuning.lasso(t, ["x", "z"], alphas)
    got = {(r.crop, r.year, r.adm_id): r for r in tuning.held_out_predictions(t, fitted, ["x", "z"]).collect()}
    pdf = t.toPandas()
    inputs = pdf[pdf[["x", "z"]].notna().all(axis=1)]
    assert len(got) == len(inputs)
    for crop in "ab":
        for held in range(2000, 2006):
            train = inputs[(inputs.crop == crop) & (inputs.year != held) & inputs["yield"].notna()]
            s = train[["x", "z"]].std(ddof=0)
            q, y, years = (train[["x", "z"]] / s).to_numpy(), train["yield"].to_numpy(), train.year.to_numpy()
            score = {a: np.mean([np.sqrt(np.mean((fit(q[years != h], y[years != h], a)(q[years == h]) - y[years == h]) ** 2)) for h in np.unique(years)]) for a in alphas}
            best = min(alphas, key=lambda a: score[a])
            test = inputs[(inputs.crop == crop) & (inputs.year == held)]
            for u, p in zip(test.adm_id, fit(q, y, best)((test[["x", "z"]] / s).to_numpy()), strict=True):
                r = got[crop, held, u]
                assert r.setting == f"alpha:{best}" and r.y_pred == pytest.approx(max(p, 0), abs=1e-5)
    assert {r.crop: r.n_folds for r in tuning.pegged(fitted, "alpha", "alpha", F.col("first"), F.col("last")).collect()} == {"a": 6, "b": 6}
    one = tuning.lasso(t, ["x", "z"], alphas, nested=False).collect()
    assert len(one) == 2 and all(r.held is None and r.rmse_val < 1 for r in one)
    assert tuning.lasso(t.where("year = 2000"), ["x", "z"], alphas).count() == 0 and tuning.lasso(t.limit(0), ["x", "z"], alphas).count() == 0


def test_components_from_sums(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 4)) @ rng.normal(size=(4, 4)) + 5
    d = spark.createDataFrame([("a", i, 2000, *map(float, x[i])) for i in range(40)], "crop string, adm_id int, year int, m1 double, m2 double, m3 double, m4 double")
    rows = tuning.component_scores(d, ["crop"], {"v": ["m1", "m2", "m3", "m4"]}, 0.9).collect()
    z = x - x.mean(axis=0)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    n = min(int(np.flatnonzero(np.cumsum(s * s) / (s * s).sum() > 0.9)[0]) + 1, 3)
    vt = vt * np.where(vt[np.arange(4), np.abs(vt).argmax(axis=1)] < 0, -1, 1)[:, None]
    assert len(rows) == 40 * n
    for r in rows:
        assert r.value == pytest.approx(z[r.adm_id] @ vt[int(r.feature[5:]) - 1], abs=1e-5)
    flat = d.select("crop", "adm_id", "year", "m1", F.col("m1").alias("m2"), F.col("m1").alias("m3"))
    assert {r.feature for r in tuning.component_scores(flat, ["crop"], {"v": ["m1", "m2", "m3"]}, 1.0).collect()} == {"v_PCA1", "v_PCA2"}  # one fewer than columns


@pytest.mark.parametrize("kind", ["svr", "gpr", "mlp"])
def test_kernel_models_learn_a_line(spark, kind):
    t = panel_of(spark, crops=("a",), years=5, units=6)
    rows = learn.nested_cv(t, kind, ["x", "z"]).where("y_true IS NOT NULL").toPandas()
    assert len(rows) == 28 and rows.setting.isin(list(learn.GRIDS[kind])).all()
    assert np.corrcoef(rows.y_true, rows.y_pred)[0, 1] > 0.8


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_trees_learn_steps(spark, kind):
    rows = [(u, c, 2000 + y, 1.0, 1.0, (10.0 if x > 0 else 2.0) + (c == "b"), float(x)) for c in "ab" for y in range(6) for u, x in enumerate((-3, -2, -1, 1, 2, 3))]
    t = spark.createDataFrame(rows, "adm_id int, crop string, year int, area double, production double, yield double, x double")
    got = learn.trees(t, ["x"], kind, 2005).join(t, ["crop", "adm_id", "year"]).collect()
    assert len(got) == 12 and all(abs(r.y_pred - r["yield"]) < 2 for r in got)


def test_same_domain_redundancy_counts_all_chosen():
    rel = {"a_1": 10.0, "a_2": 9.0, "b_1": 1.0}
    r = {("a_1", "a_2"): 0.9, ("a_1", "b_1"): 0.1, ("a_2", "b_1"): 0.2}
    chosen = selection.greedy(rel, r, 3, same_domain=True)
    assert [f for f, _ in chosen] == ["a_1", "b_1", "a_2"]
    assert chosen[1][1] == pytest.approx(1.0 / 0.001) and chosen[2][1] == pytest.approx(9.0 / ((0.9 + 0.001) / 2))


def test_ks_of_ranges_equals_plain(spark):
    rng = np.random.default_rng(2)
    rows = [(float(np.round(rng.normal() + (k == "y"), 1)), k) for k in rng.choice(["x", "y", "z"], 400)]
    d = spark.createDataFrame(rows, "v double, k string")
    got = selection.relevance_ks(d, ["v"], "k").first().ks
    v, k = np.array([a for a, _ in rows]), np.array([b for _, b in rows])
    grid = np.unique(v)
    share = lambda x: np.searchsorted(np.sort(x), grid, "right") / len(x)
    assert got == pytest.approx(np.mean([np.abs(share(v[k == c]) - share(v[k != c])).max() for c in "xyz"]))


def test_outliers_within_years(spark):
    ys = [1.0] * 5 + [50.0] + [1.0 + i * 1e-9 for i in range(12)] + [10.0]
    far = panel.flag_outliers(panel.flag_duplicates(series(spark, ys)), first_year=2007, last_year=2030)
    assert [r.year for r in far.where("outlier IS NOT NULL").collect()] == [2019] and far.where("year < 2007 AND z IS NOT NULL").count() == 0


def test_shapiro_of_few_values():
    x = np.array([148.0, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    w, p = learn.shapiro(x)
    assert w == pytest.approx(0.7888, abs=1e-3) and p == pytest.approx(0.0067, abs=3e-4)
    assert 0 < learn.shapiro(np.array([1.0, 2.0, 4.0]))[1] <= 1 and math.isnan(learn.shapiro(np.array([1.0, 2.0]))[0])
    assert learn.shapiro(np.random.default_rng(0).exponential(size=6000))[1] < 1e-6


def test_paired_tests_have_no_size_switch(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(a), 0.0) for g, n in ((1, 2), (2, 8), (3, 60)) for a in rng.normal(size=n)]
    r = {x.g: x for x in paired.paired_tests(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "g int, x double, y double, i int"), ["g"], "x", "y", ["i"]).collect()}
    assert r[1].inverted_p is None and all({r[g].inverted_p, r[g].standard_p} == {r[g].t_p, r[g].wilcoxon_p} for g in (2, 3))


def test_signed_rank_p_is_exact_for_few(spark):
    """Against all signs of the ranks."""
    from itertools import product

    for n in range(1, 13):
        sums = [sum(r for r, up in enumerate(signs, 1) if up) for signs in product((0, 1), repeat=n)]
        for w in range(n * (n + 1) // 2 + 2):
            assert paired.signed_rank_p(n, w, 0, 0) == pytest.approx(sum(s >= w for s in sums) / len(sums))
    assert math.isnan(paired.signed_rank_p(0, 0, 0, 0))
    big = paired.signed_rank_p(60, 60 * 61 / 4 + 200, 0, 0)  # normal beyond EXACT, and close to the exact one before it
    assert 0 < big < 0.1 and paired.signed_rank_p(50, 800, 0, 0) == pytest.approx(paired.signed_rank_p(50, 800, 0, 1), abs=0.003)


def test_paired_tests_match_plain_functions(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(round(a, 3)), float(round(b, 3)), i) for g, n in (("a", 3), ("b", 9), ("c", 40), (None, 300)) for i, (a, b) in enumerate(rng.exponential(size=(n, 2)) * [1.3, 1.0])]
    rows += [("a", None, 1.0, 90), ("c", 1.0, None, 91), ("d", 1.0, 1.0, 0), ("d", 2.0, 2.0, 1), ("e", 3.0, 1.0, 0)]
    got = {r.g: r for r in paired.paired_tests(spark.createDataFrame(rows, "g string, x double, y double, i int").repartition(5), ["g"], "x", "y", ["i"]).collect()}
    assert len(got) == 6
    for g, r in got.items():
        d = np.array([round(x - y, 6) for h, x, y, _ in rows if h == g and x is not None and y is not None])
        n, m = len(d), d[d != 0]
        (s, p_s), (t, p_t), (w, _) = learn.shapiro(d), learn.t_test(d), learn.wilcoxon(d)
        near = lambda a, b: a is None if math.isnan(b) else a == pytest.approx(b, abs=1e-6)
        assert r.n == n and near(r.shapiro_w, s) and near(r.shapiro_p, p_s) and near(r.t_p, p_t) and r.w_plus == pytest.approx(w)
        assert r.w_plus + r.w_minus == pytest.approx(len(m) * (len(m) + 1) / 2) and r.better == pytest.approx(np.mean(d > 0))
        ties = np.unique(np.abs(m), return_counts=True)[1]
        assert near(r.wilcoxon_p, paired.signed_rank_p(len(m), w, float((ties**3 - ties).sum()), n - len(m)) if len(m) else math.nan)


def test_running_positions(spark):
    rng = np.random.default_rng(6)
    rows = [(["a", "b", None][i % 3] if i % 2 else "a", float(rng.integers(50)), i) for i in range(500)]
    d = running.dealt(spark.createDataFrame(rows, "g string, x double, i int").repartition(7), [F.col("g"), F.col("x"), F.col("i")])
    got = {r.i: r.place for r in running.position(d, ["g"], [F.col("x"), F.col("i")], "place").collect()}
    for g in ("a", "b", None):
        assert [got[i] for _, i in sorted((x, i) for h, x, i in rows if h == g)] == list(range(1, sum(h == g for h, *_ in rows) + 1))


def test_ks_relevance_against_all_thresholds(spark):
    rng = np.random.default_rng(7)
    rows = [(float(rng.integers(0, 12)), float(rng.normal() + (c == "x")), c) for c in rng.choice(["x", "y", "z"], 300)] + [(None, 1.0, "x"), (1.0, 2.0, None)]
    got = {r.feature: r.ks for r in selection.relevance_ks(spark.createDataFrame(rows, "f double, g double, c string"), ["f", "g"], "c").collect()}
    for k, name in enumerate("fg"):
        have = [(r[k], r[2]) for r in rows if r[k] is not None and r[2] is not None]
        share = lambda v, ok: np.mean([x <= v for x, c in have if ok(c)])
        far = [max(abs(share(v, lambda c: c == cls) - share(v, lambda c: c != cls)) for v, _ in have) for cls in "xyz"]
        assert got[name] == pytest.approx(np.mean(far))


def test_seasonal_runs_leave_the_year_out(spark):
    """A changed yield changes the predictions of other years only, and seasonal forecasts come from earlier years."""
    rng = np.random.default_rng(8)
    labels = [(u, "a", y, float(rng.normal(5))) for u in range(3) for y in range(2000, 2008)]
    months = [(u, y, m, float(rng.normal())) for u in range(3) for y in range(2000, 2008) for m in range(1, 8)]
    m = spark.createDataFrame(months, "adm_id int, year int, month int, value double")
    run = lambda rows: {(r.run, r.lead_time, r.adm_id, r.year): r.y_pred for r in seasonal.runs(spark.createDataFrame(rows, "adm_id int, crop string, year int, yield double"), m).collect()}
    a, b = run(labels), run([(u, c, y, v + 50 * ((u, y) == (1, 2004))) for u, c, y, v in labels])
    assert len(a) == 3 * 3 * 24 and all((a[k] == b[k]) == (k[2] != 1 or k[3] == 2004 or a[k] is None) for k in a if a[k] is not None and b[k])
    assert {k[3] for k, v in a.items() if v is None} == {2000} and {k[0] for k, v in a.items() if v is None} == {"SF"}
    x = {(r.adm_id, r.year): r.x for r in seasonal.predictors(m).where("run = 'SF' AND lead_time = 4").collect()}
    v = {(u, y, k): z for u, y, k, z in months}
    usual = lambda y, k: np.mean([v[0, z, k] for z in range(2000, y)])
    assert x[0, 2003] == pytest.approx(np.mean([v[0, 2003, 1], v[0, 2003, 2], usual(2003, 3), usual(2003, 4)]), abs=1e-7)


def test_t_p_values(spark):
    d = spark.createDataFrame([(2.776445, 4), (1.959964, 100_000_000), (0.0, 7), (None, 3), (1.0, 0)], "t double, n int")
    p = [r.p for r in d.select(stats.t_two_sided(F.col("t"), F.col("n")).alias("p")).collect()]
    assert p[0] == pytest.approx(0.05, abs=1e-5) and p[1] == pytest.approx(0.05, abs=1e-4) and p[2] == pytest.approx(1.0) and p[3:] == [None, None]


def test_finite_pairs(spark):
    d = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 4.0), (1, float("nan"), 1.0), (1, float("inf"), 1.0), (2, 1.0, 1.0), (2, None, 3.0)], "g int, x double, y double")
    assert {r.g: r.r for r in d.groupBy("g").agg(stats.pearson_finite(F.col("x"), F.col("y")).alias("r")).collect()} == {1: pytest.approx(1.0), 2: None}


def test_hybrid_equals_the_join(spark):
    rng = np.random.default_rng(4)
    rows = [(r, f"m{r}", u, "a", 2000 + y, float(rng.normal()), float(rng.normal()) if (r, u) != (3, 1) else None, 1.0) for r in (1, 2, 3) for u in range(4) for y in range(5)]
    res = spark.createDataFrame(rows, "run_id int, model string, adm_id int, crop string, year int, y_true double, y_pred double, area double")
    best = ranking.best(metrics.by_unit(res).withColumn("rmse", F.round("rmse", 6)), ["crop", "adm_id"], "rmse")
    want = {(r.adm_id, r.year): r.y_pred for r in res.join(best.select("crop", "adm_id", "run_id"), ["crop", "adm_id", "run_id"]).collect()}
    assert {(r.adm_id, r.year): r.y_pred for r in ranking.hybrid(res).collect()} == want and len(want) == 20


def test_gaussian_process_interpolates_without_noise():
    x = np.linspace(0, 1, 8)[:, None]
    y = np.sin(5 * x[:, 0])
    assert np.allclose(learn.gaussian_process(5.0, 1e-8)(x, y)(x), y, atol=1e-3)


def test_p_values():
    d = np.array([0.3, -0.1, 0.5, 0.2, 0.9, -0.4, 0.6, 0.7, 0.1, 0.8, -0.2, 0.4])
    t, p = learn.t_test(d)
    import statistics

    assert t == pytest.approx(statistics.mean(d) / (statistics.stdev(d) / 12**0.5)) and 0.01 < p < 0.0125  # the 1 % point with 11 degrees is 2.718
    assert learn.t_test(-d)[1] == pytest.approx(1 - p)
    w, sp = learn.shapiro(d)
    assert 0.9 < w < 1 and 0.1 < sp <= 1
    assert math.isnan(learn.shapiro(np.ones(20))[0])


def test_files(spark, tmp_path):
    for v in (1, 3, 2):
        (tmp_path / f"x_v{v}.csv").write_text('a,b\n"1,234",x\nbad,y\n')
    assert files.latest_version(spark, str(tmp_path)).endswith("x_v3.csv")
    d = files.csv_thousands(spark, str(tmp_path / "x_v1.csv"), "a string, b string", ["a"])
    assert sorted((r.a or 0, r.b) for r in d.collect()) == [(0, "y"), (1234.0, "x")]
    assert files.union_with_rejects(spark, f"{tmp_path}/x_v*.csv", "a string, b string")[0].select("file").distinct().count() == 3
    assert files.from_listing(spark, "1 run\n2  idle\n\n", ["id", "state"]).collect()[1].state == "idle"
    assert files.numeric_columns(spark.sql("select cast(1 as smallint) a, 'x' b, cast(1 as decimal(9,2)) c")) == ["a", "c"]


def test_more_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\nbad,3\n4,5\n")
    (tmp_path / "b.csv").write_text("x,y\n6,7\n")
    (tmp_path / "empty.csv").write_text("")
    rows, broken = files.union_with_rejects(spark, str(tmp_path / "*.csv"), "x int, y int")
    assert sorted(r.x for r in rows.collect()) == [1, 4, 6] and [(r.file, r.line) for r in broken.collect()] == [("a.csv", "bad,3")]
    (tmp_path / "run.json").write_text('{"AOI": "ZA", "year_start": 2001}')
    (tmp_path / "run_ope.json").write_text('{"year_start": 2024}')
    schema = "AOI string, year_start int"
    assert files.config(spark, str(tmp_path / "run.json"), schema) == {"AOI": "ZA", "year_start": 2001}
    assert files.config(spark, str(tmp_path / "run.json"), schema, operational=True) == {"AOI": "ZA", "year_start": 2024}
    d = spark.createDataFrame([(1, "a")], "n int, s string")
    for _ in range(2):
        files.append_csv(d, str(tmp_path / "more"), ["s", "t", "n"])
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "more")).collect()] == [("a", None, "1")] * 2


def test_specs_count(spark):
    s = specs.all_specs(spark, ["Maize"], specs.AXES)
    assert s.where("algorithm IN ('Null_model', 'PeakFPAR', 'Trend')").count() == 6
    assert s.where("algorithm LIKE '%@%' AND feature_set NOT LIKE 'maxRS%'").count() == 0
    assert s.agg(F.max("run_id")).first()[0] == s.count() and s.where("selection = 'MRMR'").agg(F.max("run_id")).first()[0] < s.where("selection = 'none' AND algorithm = 'Lasso'").agg(F.min("run_id")).first()[0]
    r = records.task_batches(s).first()
    assert r.batch == 1 and r.id == "000001" and r.file == "000001_maize_Null_model.json"


def test_empty_panel(spark):
    e = labels(spark, [])
    assert panel.unit_statistics(e).count() == 0 and trend.theil_sen(e).count() == 0 and panel.complete_grid(e).count() == 0


def test_stream_counts_equal_the_batch(spark, sf, tmp_path):
    from furrow.streaming import dekad_counts

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = dekad_counts.counts(stream).writeStream.format("memory").queryName("dekads").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r.dekad, r.event_type, r.n)
    assert sorted(map(key, spark.table("dekads").collect())) == sorted(map(key, dekad_counts.counts(events).collect()))
