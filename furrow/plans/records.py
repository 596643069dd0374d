"""Queries of identifiers, task lists, reconciliation, comparison of runs, exchange forms and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import dekad
from furrow.operators import compare, features, metrics, paired, panel, ranking, records, specs
from furrow.plans.calendar_and_features import EOS, SOS, _PERFECT, _SEASON
from furrow.plans.models import _ALL, _UNITS, RES, _runs, _summ
from furrow.plans.panels import _GRID
from furrow.plans.register import LABELS, SALES, SPARSE, kk, query
from furrow.sources import files, tables


def _p(spark, sf):
    return tables.labels(spark, sf)


@query("surrogate_ids", "SELECT p_brand AS name, count(*) AS n, CAST(dense_rank() OVER (ORDER BY p_brand) AS INT) AS id FROM part GROUP BY 1")
def surrogate_ids(spark, sf):
    part = tables.read(spark, sf, "part").select(F.col("p_brand").alias("name"))
    return records.surrogate_ids(part, "name", "id").groupBy("name", "id").agg(F.count("*").alias("n"))


@query("duplicated_keys", "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE)) > 1")
def duplicated_keys(spark, sf):
    o = tables.read(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    return records.duplicated(o, ["o_custkey", "day"]).select("o_orderkey", "o_custkey", "day")


@query("model_family", f"{RES}, {_ALL} SELECT CASE WHEN model IN ('Null_model', 'Trend') THEN model ELSE 'ML_base' END AS family, count(*) AS n, round(min(rrmse_prct), 5) AS best FROM summ GROUP BY 1")
def model_family(spark, sf):
    s = _summ(spark, sf).withColumn("family", records.family(F.col("model"), ["Null_model", "Trend"], F.lit("base")))
    return s.groupBy("family").agg(F.count("*").alias("n"), F.round(F.min("rrmse_prct"), 5).alias("best"))


_TAX = "f AS (SELECT CAST(c_nationkey AS INT) AS adm_id, CAST(year(o_orderdate) AS INT) AS year, round(avg(o_totalprice), 4) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def _customer_years(spark, sf):
    customer = tables.read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("int").alias("adm_id"))
    return tables.read(spark, sf, "orders").join(customer, "o_custkey").groupBy("adm_id", F.year("o_orderdate").alias("year")).agg(F.round(F.avg("o_totalprice"), 4).alias("x"))


@query("features_by_crop", f"WITH {LABELS}, {_TAX} SELECT f.adm_id, f.year, x, crop FROM f LEFT JOIN (SELECT DISTINCT adm_id, crop FROM labels) USING (adm_id)")
def features_by_crop(spark, sf):
    return records.for_every_crop(_customer_years(spark, sf), _p(spark, sf)).select("adm_id", "year", "x", "crop")


@query("labels_with_features", f"WITH {SPARSE}, {_TAX} SELECT labels.adm_id, crop, labels.year, yield, x FROM labels LEFT JOIN f USING (adm_id, year)")
def labels_with_features(spark, sf):
    return tables.labels(spark, sf, crop="p_brand").select("adm_id", "crop", "year", "yield").join(_customer_years(spark, sf), ["adm_id", "year"], "left").select("adm_id", "crop", "year", "yield", "x")


@query(
    "reconcile_sources",
    f"""WITH {SALES}, a AS (SELECT adm_id, p_brand AS crop, CAST(year(day) AS INT) AS year, sum(l_quantity) AS area FROM sales JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
b AS (SELECT CAST(c_nationkey AS INT) AS region_id, p_brand AS brand, CAST(year(l_shipdate) AS INT) AS y, sum(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)
SELECT coalesce(adm_id, region_id) AS adm_id, coalesce(crop, brand) AS crop, coalesce(year, y) AS year, area AS area_left, qty AS area_right, area - qty AS area_diff, CASE WHEN qty IS NULL THEN 'left_only' WHEN area IS NULL THEN 'right_only' WHEN abs(area - qty) <= 1e-6 THEN 'both' ELSE 'differs' END AS status
FROM a FULL JOIN b ON adm_id = region_id AND crop = brand AND year = y""",
)
def reconcile_sources(spark, sf):
    a = tables.labels(spark, sf, crop="p_brand").select("adm_id", "crop", "year", "area")
    customer = tables.read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("int").alias("region_id"))
    orders = tables.read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(customer, "o_custkey")
    part = tables.read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    b = tables.read(spark, sf, "lineitem").join(orders, "l_orderkey").join(part, "l_partkey").groupBy("region_id", "brand", F.year("l_shipdate").alias("y")).agg(F.sum("l_quantity").alias("qty"))
    return records.reconcile(a, b, {"adm_id": "region_id", "crop": "brand", "year": "y"}, {"area": "qty"})


_UNIT_STATS = "us AS (SELECT adm_id, crop, round(avg(yield), 4) AS yield_mean, count(yield) AS n FROM labels GROUP BY 1, 2)"
_SHAPES = "shapes AS (SELECT DISTINCT CAST(c_nationkey AS INT) AS adm_id, c_mktsegment AS shape FROM customer)"


def _shapes(spark, sf):
    return tables.read(spark, sf, "customer").select(F.col("c_nationkey").cast("int").alias("adm_id"), F.col("c_mktsegment").alias("shape")).distinct()


@query("statistics_by_shape", f"WITH {LABELS}, {_UNIT_STATS}, {_SHAPES} SELECT us.adm_id, crop, yield_mean, n, shape FROM us LEFT JOIN shapes USING (adm_id)")
def statistics_by_shape(spark, sf):
    us = _p(spark, sf).groupBy("adm_id", "crop").agg(F.round(F.avg("yield"), 4).alias("yield_mean"), F.count("yield").alias("n"))
    return us.join(_shapes(spark, sf), "adm_id", "left").select("adm_id", "crop", "yield_mean", "n", "shape")


@query("shapes_with_data", f"WITH {LABELS}, {_UNIT_STATS} SELECT CAST(n_nationkey AS INT) AS adm_id, n_name AS adm_name, crop, yield_mean FROM us RIGHT JOIN nation ON n_nationkey = adm_id")
def shapes_with_data(spark, sf):
    """The table part of the join of geometries with data: every unit of the map has a row."""
    us = _p(spark, sf).groupBy("adm_id", "crop").agg(F.round(F.avg("yield"), 4).alias("yield_mean"))
    units = tables.read(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("adm_id"), F.col("n_name").alias("adm_name"))
    return us.join(units, "adm_id", "right").select("adm_id", "adm_name", "crop", "yield_mean")


# --- years and systems: brands are crops; a customer's segment and the order's status give two systems and none

_SYSTEM_ROWS = """r AS (SELECT CAST(o_custkey AS INT) AS adm_id, any_value(c_name) AS adm_name, any_value(c_mktsegment) AS crop, CAST(year(o_orderdate) AS INT) AS year, CASE o_orderstatus WHEN 'F' THEN 'riverine' WHEN 'O' THEN 'agro_pastoral' ELSE 'none' END AS system, round(sum(o_totalprice), 2) AS production
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey, 4, 5)"""


@query(
    "complete_years_of_systems",
    f"""WITH {_SYSTEM_ROWS}, span AS (SELECT adm_id, any_value(adm_name) AS adm_name, any_value(crop) AS crop, min(year) AS a, max(year) AS b, count(DISTINCT CASE WHEN system <> 'none' THEN system END) = 2 AS two FROM r GROUP BY 1),
years AS (SELECT adm_id, adm_name, crop, two, CAST(unnest(range(a, b + 1)) AS INT) AS year FROM span),
lone AS (SELECT adm_id, adm_name, crop, year, NULL AS system FROM years WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.adm_id = years.adm_id AND r.year = years.year)),
second AS (SELECT adm_id, adm_name, crop, year, s AS system FROM years, (SELECT unnest(['riverine', 'agro_pastoral']) AS s) WHERE two AND EXISTS (SELECT 1 FROM r WHERE r.adm_id = years.adm_id AND r.year = years.year) AND NOT EXISTS (SELECT 1 FROM r WHERE r.adm_id = years.adm_id AND r.year = years.year AND r.system = s))
SELECT adm_id, adm_name, crop, year, system, production, false AS added FROM r UNION ALL SELECT adm_id, adm_name, crop, year, system, NULL, true FROM lone UNION ALL SELECT adm_id, adm_name, crop, year, system, NULL, true FROM second""",
)
def complete_years_of_systems(spark, sf):
    customer = tables.read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("adm_name"), F.col("c_mktsegment").alias("crop"))
    system = F.when(F.col("o_orderstatus") == "F", "riverine").when(F.col("o_orderstatus") == "O", "agro_pastoral").otherwise("none")
    o = tables.read(spark, sf, "orders").join(customer, "o_custkey").groupBy(F.col("o_custkey").cast("int").alias("adm_id"), "adm_name", "crop", F.year("o_orderdate").alias("year"), system.alias("system"))
    return records.complete_years(o.agg(F.round(F.sum("o_totalprice"), 2).alias("production")), ("riverine", "agro_pastoral")).select("adm_id", "adm_name", "crop", "year", "system", "production", "added")


@query("season_bounds", f"WITH {LABELS}, a AS (SELECT CAST(s_nationkey AS INT) AS adm_id, avg(s_acctbal) AS m, avg(s_suppkey % 36 + 1) AS start, avg(s_suppkey % 36 + 13) AS stop FROM supplier GROUP BY 1), j AS (SELECT labels.*, start, stop FROM labels JOIN a USING (adm_id) WHERE m > 4500) SELECT crop, count(DISTINCT adm_id) AS units, CAST(round_even(avg(start), 0) AS INT) AS start, CAST(round_even(avg(stop), 0) AS INT) AS stop FROM j GROUP BY 1")
def season_bounds(spark, sf):
    a = tables.read(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("int").alias("adm_id")).agg(F.avg("s_acctbal").alias("m"), F.avg(F.col("s_suppkey") % 36 + 1).alias("start"), F.avg(F.col("s_suppkey") % 36 + 13).alias("stop"))
    return records.season_bounds(_p(spark, sf), a, "m > 4500")


# --- task lists

_SPEC_AXES = {"algorithm": ["Lasso", "SVR_linear"], "feature_set": ["rs", "rs_met", "met"], "reduction": ["none", "PCA"], "selection": ["none", "MRMR"], "one_hot": [False, True], "lead_time": [1, 4]}
_LIST = lambda v: "[" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in v) + "]"
_SPECS = f"""crops AS (SELECT DISTINCT p_type AS crop FROM part), lead AS (SELECT CAST(unnest({_LIST(_SPEC_AXES["lead_time"])}) AS INT) AS lead_time),
bench AS (SELECT crop, unnest({_LIST(specs.BENCHMARKS)}) AS algorithm, 'none' AS feature_set, 'none' AS reduction, 'none' AS selection, false AS one_hot, lead_time FROM crops, lead),
algos AS (SELECT unnest(['Lasso', 'SVR_linear', 'Lasso@PeakFPARAndLast3', 'SVR_linear@PeakFPARAndLast3']) AS algorithm),
tuned0 AS (SELECT crop, algorithm, fs, reduction, selection, one_hot, lead_time FROM crops, lead, algos, (SELECT unnest(['rs', 'rs_met', 'met']) AS fs), (SELECT unnest(['none', 'PCA']) AS reduction), (SELECT unnest(['none', 'MRMR']) AS selection), (SELECT unnest([false, true]) AS one_hot)
    WHERE NOT (reduction = 'PCA' AND lead_time = 1) AND NOT (reduction = 'PCA' AND selection = 'MRMR') AND NOT (contains(algorithm, '@') AND fs = 'met')),
tuned AS (SELECT crop, algorithm, CASE WHEN contains(algorithm, '@') AND fs = 'rs' THEN 'maxRS' WHEN contains(algorithm, '@') AND fs = 'rs_met' THEN 'maxRS_met' ELSE fs END AS feature_set, reduction, selection, one_hot, lead_time FROM tuned0),
num AS (SELECT CAST(row_number() OVER (ORDER BY k, crop, algorithm, lead_time, feature_set, reduction, selection, one_hot) AS INT) AS run_id, * EXCLUDE k FROM (SELECT 0 AS k, * FROM bench UNION ALL SELECT CASE WHEN selection <> 'none' THEN 1 ELSE 2 END, * FROM tuned))"""


@query("all_specs", f"WITH {_SPECS} SELECT * FROM num")
def all_specs(spark, sf):
    return specs.all_specs(spark, tables.crops(spark, sf), _SPEC_AXES)


@query("task_batches", f"WITH {_SPECS} SELECT run_id, CAST((run_id - 1) // 50 + 1 AS INT) AS batch, lpad(CAST(run_id AS VARCHAR), 6, '0') AS id, lpad(CAST(run_id AS VARCHAR), 6, '0') || '_' || lower(crop) || '_' || algorithm || '.json' AS file FROM num")
def task_batches(spark, sf):
    return records.task_batches(specs.all_specs(spark, tables.crops(spark, sf), _SPEC_AXES), 50).select("run_id", "batch", "id", "file")


@query("single_task", f"WITH {_SPECS} SELECT * FROM num WHERE run_id = 42")
def single_task(spark, sf):
    """One task's settings, to run it alone."""
    return specs.all_specs(spark, tables.crops(spark, sf), _SPEC_AXES).where("run_id = 42")


@query("settings_text", "WITH s AS (SELECT p_brand, p_type, string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) AS sizes FROM part GROUP BY 1, 2) SELECT p_brand AS brand, string_agg(p_type || ':' || sizes, '; ' ORDER BY p_type) AS text FROM s GROUP BY 1")
def settings_text(spark, sf):
    """The sizes that each brand's types come in, as text."""
    sizes = tables.read(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_set(F.col("p_size").cast("string"))).alias("sizes"))
    of_brand = sizes.groupBy(F.col("p_brand").alias("brand")).agg(F.map_from_entries(F.collect_list(F.struct("p_type", "sizes"))).alias("m"))
    return of_brand.select("brand", records.settings_text(F.col("m")).alias("text"))


@query("run_names", f"{RES}, {_ALL} SELECT crop, list_sort(list(DISTINCT model)) AS models FROM summ GROUP BY 1")
def run_names(spark, sf):
    return _summ(spark, sf).groupBy("crop").agg(F.array_sort(F.collect_set("model")).alias("models"))


# --- comparison of runs

_E = "(y_true - y_pred) ^ 2"


@query(
    "three_run_comparison",
    f"""{RES}, l AS (SELECT *, CASE WHEN year % 2 = 0 THEN 1 ELSE 4 END AS lead_time FROM res),
d AS (SELECT a.crop, a.lead_time, b.model AS other, {_E.replace("y_", "a.y_")} AS a, {_E.replace("y_", "b.y_")} AS b, round({_E.replace("y_", "a.y_")} - {_E.replace("y_", "b.y_")}, 6) AS d FROM l a JOIN l b USING (crop, lead_time, adm_id, year) WHERE a.model = 'Null_model' AND b.model <> 'Null_model'),
k AS (SELECT *, CASE WHEN d <> 0 THEN rank() OVER (PARTITION BY crop, lead_time, other, d <> 0 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY crop, lead_time, other, abs(d)) - 1) / 2.0 END AS k FROM d WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT crop, CAST(lead_time AS INT) AS lead_time, other, count(*) AS n, round(avg(a), 2) AS mse_base, round(avg(b), 2) AS mse_other, round(avg(CASE WHEN b < a THEN 1.0 ELSE 0.0 END), 6) AS better, round(avg(d) / nullif(stddev_samp(d) / sqrt(count(*)), 0), 4) + 0.0 AS t, round(sum(CASE WHEN d > 0 THEN k ELSE 0 END), 1) AS w_plus, round(sum(CASE WHEN d < 0 THEN k ELSE 0 END), 1) AS w_minus FROM k GROUP BY 1, 2, 3""",
)
def three_run_comparison(spark, sf):
    r = _runs(spark, sf).withColumns({"run": F.col("model"), "lead_time": F.when(F.col("year") % 2 == 0, 1).otherwise(4)})
    t = paired.against_base(r, "Null_model", ["Trend", "PeakModel"], ["crop", "lead_time"])
    digits = {"mse_base": 2, "mse_other": 2, "better": 6, "t": 4, "w_plus": 1, "w_minus": 1}
    return t.select("crop", "lead_time", "other", "n", *((F.round(c, k) + F.lit(0.0)).alias(c) for c, k in digits.items()))




@query("best_with_ties", f"{RES}, {_UNITS} SELECT crop, adm_id, run_id, model FROM units QUALIFY rank() OVER (PARTITION BY crop, adm_id ORDER BY round(rmse, 1) NULLS LAST) = 1")
def best_with_ties(spark, sf):
    u = metrics.by_unit(_runs(spark, sf)).withColumn("rmse", F.round(F.round("rmse", 6), 1))
    return ranking.ties_of_best(u, ["crop", "adm_id"], "rmse").select("crop", "adm_id", "run_id", "model")


@query("predictions_with_regions", f"{RES} SELECT run_id, crop, adm_id, n_name AS adm_name, year, y_pred FROM res LEFT JOIN nation ON n_nationkey = adm_id")
def predictions_with_regions(spark, sf):
    names = tables.read(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("adm_id"), F.col("n_name").alias("adm_name"))
    return _runs(spark, sf).join(names, "adm_id", "left").select("run_id", "crop", "adm_id", "adm_name", "year", "y_pred")


@query("predictions_with_season", f"{RES}, m AS (SELECT adm_id, CAST(year(month) AS INT) AS year, round(avg(sum), 4) AS rain FROM months WHERE variable_name = 'rainfall' GROUP BY 1, 2) SELECT run_id, crop, adm_id, year, y_true, y_pred, rain FROM res LEFT JOIN m USING (adm_id, year)")
def predictions_with_season(spark, sf):
    m = features.monthly(tables.indicators(spark, sf).where("variable_name = 'rainfall'")).groupBy("adm_id", F.year("month").alias("year")).agg(F.round(F.avg("sum"), 4).alias("rain"))
    return _runs(spark, sf).join(m, ["adm_id", "year"], "left").select("run_id", "crop", "adm_id", "year", "y_true", "y_pred", "rain")


@query("filled_names", f"WITH {_GRID} SELECT adm_id, crop, year, coalesce(area, first_value(area IGNORE NULLS) OVER (PARTITION BY adm_id ORDER BY year, crop ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS area FROM grid")
def filled_names(spark, sf):
    return panel.fill_with_first(panel.complete_grid(tables.labels(spark, sf, crop="p_brand")), "area", ["year", "crop"]).select("adm_id", "crop", "year", "area")


@query("rows_with_values", f"WITH {_GRID} SELECT adm_id, crop, year FROM grid WHERE NOT (area IS NULL AND production IS NULL AND yield IS NULL)")
def rows_with_values(spark, sf):
    return panel.complete_grid(tables.labels(spark, sf, crop="p_brand")).na.drop("all", subset=["area", "production", "yield"]).select("adm_id", "crop", "year")


# --- calendar, dates, texts, rounding

@query("season_calendar", f"WITH d AS (SELECT month(CAST(l_shipdate AS DATE)) AS month, count(DISTINCT CAST(l_shipdate AS DATE)) AS n_days FROM lineitem GROUP BY 1) SELECT CAST(i AS INT) AS month_index, month, round(i * 100.0 / 7, 6) AS progress, n_days FROM (SELECT i, CAST((i + {SOS} - 2) % 12 + 1 AS INT) AS month FROM (SELECT unnest(range(1, 8)) AS i)) LEFT JOIN d USING (month)")
def season_calendar(spark, sf):
    """The season's months, and on how many days of each there are sales."""
    day = F.to_date("l_shipdate")
    days = tables.read(spark, sf, "lineitem").groupBy(F.month(day).alias("month")).agg(F.count_distinct(day).alias("n_days"))
    return dekad.calendar(spark, SOS, EOS).withColumn("progress", F.round("progress", 6)).join(days, "month", "left").select("month_index", "month", "progress", "n_days")


@query("forecast_dates", f"WITH {_PERFECT} SELECT adm_id, variable_name, CASE WHEN contains(variable_name, 'SF_') THEN CAST(date - INTERVAL 1 MONTH AS DATE) ELSE date END AS date, round(mean, 6) AS mean FROM (SELECT adm_id, variable_name, date, mean FROM sf UNION ALL SELECT adm_id, variable_name, date, mean FROM ind)")
def forecast_dates(spark, sf):
    ind = tables.indicators(spark, sf)
    both = features.perfect_forecast(ind).select("adm_id", "variable_name", "date", "mean").unionByName(ind.select("adm_id", "variable_name", "date", "mean"))
    return features.issued_earlier(both).withColumn("mean", F.round("mean", 6))


@query("complete_seasons", f"WITH {_SEASON}, s AS (SELECT season_year, dense_rank() OVER (ORDER BY season_year) <= 2 AND count(DISTINCT month_index) < 7 AS dropped FROM season GROUP BY 1) SELECT adm_id, variable_name, season_year, month_index, round(mean, 6) AS mean FROM season JOIN s USING (season_year) WHERE NOT dropped")
def complete_seasons(spark, sf):
    return features.complete_seasons(tables.indicators(spark, sf), SOS, EOS).select("adm_id", "variable_name", "season_year", "month_index", F.round("mean", 6).alias("mean"))


@query("parsed_dates", f"""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'n/a ' || o_orderkey END AS text FROM orders), p AS (SELECT o_orderkey, text, CASE WHEN regexp_full_match(text, '[0-9]{{8}}') THEN CAST(try_strptime(text, '%Y%m%d') AS DATE) END AS date FROM t)
SELECT o_orderkey, text, date, {kk('date')} AS kk, strftime(date, '%d/%m/%Y') AS printed FROM p""")
def parsed_dates(spark, sf):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.concat(F.lit("n/a "), F.col("o_orderkey").cast("string")))
    t = tables.read(spark, sf, "orders").select("o_orderkey", text.alias("text")).withColumn("date", dekad.parsed(F.col("text"), "yyyyMMdd"))
    return t.select("o_orderkey", "text", "date", dekad.of_year(F.col("date")).alias("kk"), F.date_format("date", "dd/MM/yyyy").alias("printed"))


@query("text_predicates", "SELECT p_partkey, starts_with(p_name, 'cold') AS cold, contains(lower(p_name), 'widget') AS widget, regexp_matches(p_type, '(?i)^eco') AS eco, regexp_matches(p_brand, '1[0-9]$') AS teens, lower(replace(p_brand, '#', ' ')) AS tidy, trim('  ' || p_name || ' ') AS stripped FROM part")
def text_predicates(spark, sf):
    c = F.col
    tests = {"cold": c("p_name").startswith("cold"), "widget": F.lower("p_name").contains("widget"), "eco": c("p_type").rlike("(?i)^eco"), "teens": c("p_brand").rlike("1[0-9]$"), "tidy": F.lower(F.replace("p_brand", F.lit("#"), F.lit(" "))), "stripped": F.trim(F.concat(F.lit("  "), "p_name", F.lit(" ")))}
    return tables.read(spark, sf, "part").select("p_partkey", *(v.alias(k) for k, v in tests.items()))


@query("rounding", "SELECT p_partkey, CAST(round_even(p_size / 2.0, 0) AS DOUBLE) AS half_even, CAST(round(p_size / 2.0, 0) AS DOUBLE) AS half_up, CAST(ceil(p_size / 4.0) AS BIGINT) AS up, CAST(floor(p_size / 4.0) AS BIGINT) AS down, least(greatest(p_size, 10), 40) AS clipped, abs(p_size / 3.0 * 3 - p_size) <= 1e-8 + 1e-5 * p_size AS close FROM part")
def rounding(spark, sf):
    size = F.col("p_size")
    return tables.read(spark, sf, "part").select(
        "p_partkey", F.bround(size / 2.0, 0).alias("half_even"), F.round(size / 2.0, 0).alias("half_up"), F.ceil(size / 4.0).alias("up"), F.floor(size / 4.0).alias("down"),
        F.least(F.greatest(size, F.lit(10)), F.lit(40)).alias("clipped"), (F.abs(size / 3.0 * 3 - size) <= 1e-8 + 1e-5 * size).alias("close"),
    )


@query("list_functions", "SELECT p_brand, list_reverse(list_sort(list(DISTINCT p_size))) AS sizes, CAST(list_position(list_sort(list(DISTINCT p_size)), 10) AS INT) AS place FROM part GROUP BY 1")
def list_functions(spark, sf):
    sizes = F.array_sort(F.collect_set("p_size"))
    return tables.read(spark, sf, "part").groupBy("p_brand").agg(F.reverse(sizes).alias("sizes"), F.nullif(F.array_position(sizes, 10), F.lit(0)).cast("int").alias("place"))


@query("value_ranges", f"WITH {LABELS} SELECT min(year) AS first_year, max(year) AS last_year, round(min(yield), 4) AS low, round(max(yield), 4) AS high FROM labels")
def value_ranges(spark, sf):
    return _p(spark, sf).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.round(F.min("yield"), 4).alias("low"), F.round(F.max("yield"), 4).alias("high"))


# --- units and exchange forms

@query("unit_pair_conversion", f"WITH {LABELS}, u AS (SELECT *, ['ha', 'ha', 'km2'][adm_id % 3 + 1] AS area_unit, ['t/ha', 'kg/ha', '100t'][adm_id % 3 + 1] AS yield_unit FROM labels) SELECT adm_id, crop, year, round(production / CASE WHEN area_unit = 'ha' AND yield_unit = 't/ha' THEN 1000.0 WHEN area_unit = 'ha' AND yield_unit = 'kg/ha' THEN 1000000.0 WHEN yield_unit = '100t' THEN 10.0 END, 9) AS production_kt, round(area / CASE area_unit WHEN 'ha' THEN 100.0 WHEN 'km2' THEN 1.0 END, 6) AS area_km2 FROM u")
def unit_pair_conversion(spark, sf):
    at = (F.col("adm_id") % 3 + 1).cast("int")
    area, yields = F.element_at(F.array(*map(F.lit, ("ha", "ha", "km2"))), at), F.element_at(F.array(*map(F.lit, ("t/ha", "kg/ha", "100t"))), at)
    return _p(spark, sf).select("adm_id", "crop", "year", F.round(records.to_thousand_tonnes(F.col("production"), area, yields), 9).alias("production_kt"), F.round(records.to_square_km(F.col("area"), area), 6).alias("area_km2"))


_NAMES = "names AS (SELECT CAST(n_nationkey AS INT) AS adm_id, n_name AS adm_name, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey)"
_RECODE = "CASE crop WHEN 'PROMO' THEN 'Maize' ELSE crop END AS crop_name"


def _names(spark, sf):
    nation, region = tables.read(spark, sf, "nation"), tables.read(spark, sf, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").cast("int").alias("adm_id"), F.col("n_name").alias("adm_name"), F.col("r_name").alias("region"))


_ACC = {"rmse": "sqrt(avg((y_true - y_pred) ^ 2))", "mae": "avg(abs(y_true - y_pred))"}


@query(
    "exchange_accuracy",
    f"""{RES}, {_NAMES}, u AS (SELECT run_id, model, crop, adm_id, {_ACC["rmse"]} AS rmse, {_ACC["rmse"]} / nullif(avg(y_true), 0) * 100 AS rrmse_prct, {_ACC["mae"]} AS mae, 1 - sum((y_true - y_pred) ^ 2) / nullif(var_pop(CASE WHEN y_pred IS NOT NULL THEN y_true END) * count(CASE WHEN y_pred IS NOT NULL THEN y_true END), 0) AS r2 FROM res GROUP BY 1, 2, 3, 4),
v AS (SELECT *, unnest(['rmse', 'rrmse_prct', 'mae', 'r2']) AS variable, unnest([round(rmse, 3), round(rrmse_prct, 3), round(mae, 3), round(r2, 3)]) AS value, unnest(['t/ha', '%', 't/ha', '1']) AS unit FROM u)
SELECT region, adm_name, adm_id, {_RECODE}, model, variable, value + 0.0 AS value, unit, 'accuracy' AS status FROM v JOIN names USING (adm_id)""",
)
def exchange_accuracy(spark, sf):
    recode = F.when(F.col("crop") == "PROMO", "Maize").otherwise(F.col("crop"))
    return records.exchange_accuracy(metrics.by_unit(_runs(spark, sf)), _names(spark, sf), recode).withColumn("value", F.col("value") + F.lit(0.0))


@query(
    "exchange_history",
    f"""WITH {SPARSE}, {_NAMES}, v AS (SELECT *, unnest(['area', 'production', 'yield']) AS variable, unnest([round(area, 6), round(production, 6), round(yield, 6)]) AS value, unnest(['ha', 't', 't/ha']) AS unit FROM labels)
SELECT region, adm_name, adm_id, {_RECODE}, year, variable, value, unit, 'observed' AS status FROM v JOIN names USING (adm_id) WHERE value IS NOT NULL""",
)
def exchange_history(spark, sf):
    recode = F.when(F.col("crop") == "PROMO", "Maize").otherwise(F.col("crop"))
    return records.exchange_history(tables.labels(spark, sf, crop="p_brand"), _names(spark, sf), recode, 6)


@query(
    "download_union",
    """WITH d AS (SELECT o_orderkey, CAST(c_nationkey AS INT) AS region_id, n_name AS region_name, ['FPAR', 'Solar Radiation', 'Rainfall', 'Temperature'][o_orderkey % 4 + 1] AS v, o_totalprice AS value, CAST(o_orderdate AS DATE) AS date, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT region_name AS reg0_name, region_id AS adm_id, CASE v WHEN 'FPAR' THEN 'NDVI' WHEN 'Solar Radiation' THEN 'rad' WHEN 'Rainfall' THEN 'rainfall' ELSE 'temperature' END AS variable_name, CAST(o_orderkey % 4 AS INT) AS var_id, 'static masks' AS classset_name, CAST(2 AS INT) AS classesset_id, lower(o_orderpriority) AS class_name, CAST(o_orderpriority[1] AS INT) AS class_id, date, value AS mean, CAST(0 AS INT) AS stddev FROM d""",
)
def download_union(spark, sf):
    customer = tables.read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("int").alias("region_id"))
    nation = tables.read(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("region_id"), F.col("n_name").alias("region_name"))
    o = tables.read(spark, sf, "orders").join(customer, "o_custkey").join(nation, "region_id")
    name = F.array(*map(F.lit, ("FPAR", "Solar Radiation", "Rainfall", "Temperature")))
    kind = (F.col("o_orderkey") % 4).cast("int")
    return records.from_downloads([o.select("region_id", "region_name", name[kind].alias("variable_name"), kind.alias("variable_id"), F.date_format("o_orderdate", "yyyyMMdd").alias("date"), F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("class_name"), F.substring("o_orderpriority", 1, 1).cast("int").alias("class_id"))])


# --- files that are written and read again

@query("csv_round_trip", f"WITH {LABELS} SELECT adm_id, crop, year, round(yield, 3) AS yield FROM labels")
def csv_round_trip(spark, sf):
    labels = _p(spark, sf).select("adm_id", "crop", "year", F.round("yield", 3).alias("yield"))
    path = files.overwrite_csv(labels, f"{files.scratch(spark)}/labels")
    return files.csv(spark, path, "adm_id int, crop string, year int, yield double")


@query("csv_append_round_trip", f"WITH {LABELS} SELECT adm_id, crop, year, NULL::DOUBLE AS note FROM labels UNION ALL SELECT adm_id, crop, year, 1.0 FROM labels")
def csv_append_round_trip(spark, sf):
    folder, columns = f"{files.scratch(spark)}/appended", ["adm_id", "crop", "year", "note"]
    labels = _p(spark, sf).select("adm_id", "crop", "year")
    for rows in (labels, labels.withColumn("note", F.lit(1.0))):
        files.append_csv(rows, folder, columns)
    return spark.read.schema("adm_id int, crop string, year int, note double").csv(folder)


@query("json_specs_round_trip", f"WITH {_SPECS} SELECT run_id, crop, algorithm, feature_set, reduction, selection, one_hot, lead_time FROM num")
def json_specs_round_trip(spark, sf):
    s = specs.all_specs(spark, tables.crops(spark, sf), _SPEC_AXES)
    return files.json_specs(spark, files.overwrite_json(s, f"{files.scratch(spark)}/specs"), s.schema.simpleString()[7:-1].replace(":", " "), one_per_file=False)


@query("union_of_files", f"WITH {SPARSE} SELECT year, count(*) AS n, round(sum(yield), 2) AS total, CAST(0 AS BIGINT) AS n_broken FROM labels GROUP BY 1")
def union_of_files(spark, sf):
    labels = tables.labels(spark, sf, crop="p_brand").select("adm_id", "crop", "year", "yield")
    folder = f"{files.scratch(spark)}/parts"
    labels.repartition(4, "year").write.option("header", True).csv(folder)
    rows, broken = files.union_with_rejects(spark, folder, "adm_id int, crop string, year int, yield double")
    n = broken.agg(F.count("*").alias("n_broken"))
    return rows.groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("yield"), 2).alias("total")).crossJoin(F.broadcast(n))
