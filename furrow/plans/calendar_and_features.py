"""Queries of the calendar and of monthly and seasonal features."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import dekad
from furrow.operators import features
from furrow.plans.register import INDICATORS, MONTHS, SALES, dekad_of, from_raw, kk, query, raw_of, start_of
from furrow.sources import tables

SOS, EOS = 11, 5
LEAD = 4


def _days(spark, sf):
    return tables.read(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()


_D = "d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)"


@query("dekad_calendar", f"WITH {_D} SELECT date, {kk('date')} AS kk, {dekad_of('date')} AS dekad, {raw_of('date')} AS raw, {start_of(dekad_of('date'))} AS start, strftime({start_of(dekad_of('date'))}, '%Y%m%d') AS text, strftime({start_of(dekad_of('date'))}, '%m%d') AS mmdd FROM d")
def dekad_calendar(spark, sf):
    c = F.col("date")
    k = dekad.from_date(c)
    return _days(spark, sf).select("date", dekad.of_year(c).alias("kk"), k.alias("dekad"), dekad.raw_of_date(c).alias("raw"), dekad.start(k).alias("start"), dekad.format(k).alias("text"), dekad.mmdd(dekad.of_year(c)).alias("mmdd"))


@query("dekad_days", f"WITH {_D}, k AS (SELECT DISTINCT {dekad_of('date')} AS dekad, {raw_of('date')} AS raw FROM d) SELECT dekad, CAST({start_of(from_raw('raw + 1'))} - {start_of('dekad')} AS INT) AS days, CAST({start_of(from_raw('raw + 1'))} - INTERVAL 1 DAY AS DATE) AS last_day FROM k")
def dekad_days(spark, sf):
    k = _days(spark, sf).select(dekad.from_date(F.col("date")).alias("dekad")).distinct()
    return k.select("dekad", dekad.days(F.col("dekad")).alias("days"), dekad.last_day(F.col("dekad")).alias("last_day"))


@query("dekad_shift", f"WITH {_D}, m AS (SELECT date, CAST(date + INTERVAL 2 MONTH AS DATE) AS later, {raw_of('date')} AS raw FROM d) SELECT date, {from_raw('raw + 5')} AS plus5, {from_raw('raw - 40')} AS minus40, {start_of(from_raw(raw_of('later') + ' + 3'))} AS months_then_dekads FROM m")
def dekad_shift(spark, sf):
    k = dekad.from_date(F.col("date"))
    return _days(spark, sf).select("date", dekad.shift(k, 5).alias("plus5"), dekad.shift(k, -40).alias("minus40"), dekad.add(F.col("date"), months=2, dekads=3).alias("months_then_dekads"))


@query("pheno_fold", f"WITH {_D}, p AS (SELECT date, CAST({raw_of('date')} % 111 AS INT) AS pheno FROM d), q AS (SELECT date, pheno, CASE WHEN pheno BETWEEN 1 AND 108 THEN CAST((pheno - 1) % 36 + 1 AS INT) END AS kk, CASE WHEN pheno BETWEEN 1 AND 108 THEN {from_raw('(2020 - 1900) * 36 + pheno - 36')} END AS dekad FROM p) SELECT *, CAST((dekad // 100 - 1900) * 36 + dekad % 100 - 120 * 36 + 36 AS INT) AS back FROM q")
def pheno_fold(spark, sf):
    """Season values of three years, made of the days' running dekads."""
    p = _days(spark, sf).select("date", (dekad.to_raw(dekad.from_date(F.col("date"))) % 111).cast("int").alias("pheno"))
    q = p.select("date", "pheno", dekad.fold(F.col("pheno")).alias("kk"), dekad.from_pheno(F.col("pheno"), 2020).alias("dekad"))
    return q.withColumn("back", dekad.to_pheno(F.col("dekad"), 2020))


@query("season_index", f"WITH {_D} SELECT date, CAST((month(date) - 11 + 12) % 12 + 1 AS INT) AS month_index, CAST(CASE WHEN month(date) > 5 THEN year(date) + 1 ELSE year(date) END AS INT) AS season_year, (month(date) - 11 + 12) % 12 + 1 <= 7 AS in_season, CAST(CASE WHEN month(date) >= 3 THEN month(date) - 2 ELSE month(date) + 10 END AS INT) AS plain_index, CAST(month(date) % 12 + 1 AS INT) AS issue_month FROM d")
def season_index(spark, sf):
    m = F.month("date")
    return _days(spark, sf).select("date", dekad.season_index(m, SOS).alias("month_index"), dekad.season_year(F.col("date"), SOS, EOS).alias("season_year"), dekad.in_season(m, SOS, EOS).alias("in_season"), dekad.season_index(m, 3).alias("plain_index"), dekad.issue_month(m).alias("issue_month"))


@query(
    "lead_time_month",
    """WITH m AS (SELECT CAST(unnest(range(1, 8)) AS INT) AS idx), c AS (SELECT idx, CAST((idx + 9) % 12 + 1 AS INT) AS month, idx * 100.0 / 7 AS progress FROM m), w AS (SELECT DISTINCT p_size * 2 AS wanted FROM part),
r AS (SELECT wanted, month, round(progress, 6) AS progress, row_number() OVER (PARTITION BY wanted ORDER BY abs(progress - wanted), idx) AS k FROM w, c) SELECT CAST(wanted AS INT) AS wanted, month, progress, CAST(month % 12 + 1 AS INT) AS issue_month FROM r WHERE k = 1""",
)
def lead_time_month(spark, sf):
    cal = dekad.calendar(spark, SOS, EOS).withColumnRenamed("month_index", "idx")
    wanted = tables.read(spark, sf, "part").select((F.col("p_size") * 2).cast("int").alias("wanted")).distinct()
    near = wanted.crossJoin(F.broadcast(cal)).groupBy("wanted").agg(F.min_by(F.struct("month", "progress"), F.struct(F.abs(F.col("progress") - F.col("wanted")), "idx")).alias("m"))
    return near.select("wanted", "m.month", F.round("m.progress", 6).alias("progress"), dekad.issue_month(F.col("m.month")).alias("issue_month"))


@query("monthly_agg", f"WITH {MONTHS} SELECT adm_id, variable_name, month, first_date, n, round(mean, 6) AS mean, min, max, round(sum, 6) AS sum FROM months")
def monthly_agg(spark, sf):
    m = features.monthly(tables.indicators(spark, sf))
    return m.withColumns({c: F.round(c, 6) for c in ("mean", "sum")})


_DAYS = f"({start_of(from_raw(raw_of('date') + ' + 1'))} - date)"


@query("monthly_weighted_temp", f"WITH {INDICATORS} SELECT adm_id, CAST(date_trunc('month', date) AS DATE) AS month, round(sum(mean * {_DAYS}) / sum({_DAYS}), 6) AS mean FROM ind WHERE variable_name = 'temperature' GROUP BY 1, 2")
def monthly_weighted_temp(spark, sf):
    ind = tables.indicators(spark, sf).where("variable_name = 'temperature'")
    return features.monthly_weighted(ind).select("adm_id", "month", F.round("mean", 6).alias("mean"))


@query("complete_months", f"WITH {MONTHS} SELECT adm_id, variable_name, month, n FROM months WHERE day(first_date) = 1")
def complete_months(spark, sf):
    return features.complete_months(tables.indicators(spark, sf)).select("adm_id", "variable_name", "month", "n")


@query("first_indicator_cut", f"WITH {INDICATORS}, late AS (SELECT * FROM ind WHERE NOT (variable_name = 'FPAR' AND date < DATE '1996-06-01')) SELECT adm_id, variable_name, min(date) AS first_date, count(*) AS n FROM late WHERE date >= (SELECT min(date) FROM late WHERE variable_name = 'FPAR') GROUP BY 1, 2")
def first_indicator_cut(spark, sf):
    late = tables.indicators(spark, sf).where("NOT (variable_name = 'FPAR' AND date < DATE '1996-06-01')")
    return features.from_first_of(late, "FPAR").groupBy("adm_id", "variable_name").agg(F.min("date").alias("first_date"), F.count("*").alias("n"))


_SEASON = f"""{MONTHS},
season AS (SELECT *, CAST(CASE WHEN month(month) > {EOS} THEN year(month) + 1 ELSE year(month) END AS INT) AS season_year, CAST((month(month) - {SOS} + 12) % 12 + 1 AS INT) AS month_index FROM months WHERE (month(month) - {SOS} + 12) % 12 + 1 <= 7)"""


@query("incomplete_seasons", f"WITH {_SEASON}, s AS (SELECT season_year, count(DISTINCT month_index) AS months FROM season GROUP BY 1) SELECT *, dense_rank() OVER (ORDER BY season_year) <= 2 AND months < 7 AS dropped FROM s")
def incomplete_seasons(spark, sf):
    return features.season_months(tables.indicators(spark, sf), SOS, EOS)


_LONG = f"""{_SEASON},
long AS (SELECT adm_id, season_year, variable_name, month_index, variable_name || 'SumM' || month_index AS feature, sum AS value FROM season WHERE variable_name = 'rainfall'
    UNION ALL SELECT adm_id, season_year, variable_name, month_index, variable_name || 'M' || month_index, mean FROM season WHERE variable_name <> 'rainfall'
    UNION ALL SELECT adm_id, season_year, variable_name, month_index, variable_name || 'minM' || month_index, min FROM season WHERE variable_name <> 'rainfall'
    UNION ALL SELECT adm_id, season_year, variable_name, month_index, variable_name || 'maxM' || month_index, max FROM season WHERE variable_name <> 'rainfall')"""


def _features(spark, sf):
    return features.season_features(tables.indicators(spark, sf), SOS, EOS)


@query("season_matrix_long", f"WITH {_LONG} SELECT adm_id, season_year, variable_name, month_index, feature, round(value, 6) AS value FROM long")
def season_matrix_long(spark, sf):
    return _features(spark, sf).withColumn("value", F.round("value", 6))


WIDE = ["rainfallSumM1", "rainfallSumM2", "temperatureM1", "temperatureM2", "FPARmaxM3", "FPARminM4"]


@query("season_matrix_wide", f"WITH {_LONG} SELECT adm_id, season_year, " + ", ".join(f"round(max(CASE WHEN feature = '{c}' THEN value END), 6) AS {c}" for c in WIDE) + " FROM long GROUP BY 1, 2")
def season_matrix_wide(spark, sf):
    m = features.season_matrix(tables.indicators(spark, sf), SOS, EOS, WIDE)
    return m.select("adm_id", "season_year", *(F.round(c, 6).alias(c) for c in WIDE))


_MATRIX = [f"FPARmaxM{k}" for k in range(1, 8)] + [f"rainfallSumM{k}" for k in range(1, 8)] + [f"temperatureM{k}" for k in range(1, 8)]


@query("peak_last3_wide", f"WITH {_LONG} SELECT adm_id, season_year, round(max(CASE WHEN variable_name = 'FPAR' AND contains(feature, 'max') AND month_index <= 5 THEN value END), 6) AS peak, " + ", ".join(f"round(max(CASE WHEN feature = '{c}{k}' THEN value END), 6) AS {c}{k}" for c in ("rainfallSumM", "temperatureM") for k in (3, 4, 5)) + " FROM long GROUP BY 1, 2")
def peak_last3_wide(spark, sf):
    """Peak and last three months from a whole season matrix."""
    m = features.peak_and_last_wide(features.season_matrix(tables.indicators(spark, sf), SOS, EOS, _MATRIX), "FPAR", 5)
    return m.select("adm_id", "season_year", *(F.round(c, 6).alias(c) for c in m.columns if c not in ("adm_id", "season_year")))


@query("lead_time_features", f"WITH {_LONG} SELECT adm_id, season_year, count(*) AS n, round(sum(value), 4) AS total FROM long WHERE month_index <= {LEAD} GROUP BY 1, 2")
def lead_time_features(spark, sf):
    return features.up_to(_features(spark, sf), LEAD).groupBy("adm_id", "season_year").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("feature_group", f"WITH {_LONG} SELECT variable_name, feature, count(*) AS n, round(avg(value), 6) AS mean FROM long WHERE variable_name IN ('rainfall', 'temperature') GROUP BY 1, 2")
def feature_group(spark, sf):
    return features.group(_features(spark, sf), ["rainfall", "temperature"]).groupBy("variable_name", "feature").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("peak_last3", f"WITH {_LONG} SELECT adm_id, season_year, max(CASE WHEN variable_name = 'FPAR' AND contains(feature, 'max') THEN value END) AS peak, round(avg(CASE WHEN variable_name <> 'FPAR' AND month_index > 2 THEN value END), 4) AS tail_mean, count(CASE WHEN variable_name <> 'FPAR' AND month_index > 2 THEN 1 END) AS n_tail FROM long WHERE month_index <= 5 GROUP BY 1, 2")
def peak_last3(spark, sf):
    return features.peak_and_last(_features(spark, sf), "FPAR", 5).withColumn("tail_mean", F.round("tail_mean", 4))


_PERFECT = f"""{MONTHS},
weighted AS (SELECT adm_id, variable_name, CAST(date_trunc('month', date) AS DATE) AS month, sum(mean * {_DAYS}) / sum({_DAYS}) AS wmean FROM ind GROUP BY 1, 2, 3),
sf AS (SELECT adm_id, 'SF_' || left(variable_name, 1) || '_' || (h + 1) AS variable_name, CAST(month - to_months(CAST(h AS INT)) AS DATE) AS date, CASE WHEN variable_name = 'rainfall' THEN sum ELSE wmean END AS mean, CAST(h AS INT) AS h
    FROM months JOIN weighted USING (adm_id, variable_name, month), (SELECT unnest(range(0, 7)) AS h) WHERE day(first_date) = 1)"""


@query("perfect_forecast", f"WITH {_PERFECT} SELECT adm_id, variable_name, date, h, round(mean, 6) AS mean FROM sf")
def perfect_forecast(spark, sf):
    return features.perfect_forecast(tables.indicators(spark, sf)).select("adm_id", "variable_name", "date", "h", F.round("mean", 6).alias("mean"))


@query("sf_horizon_features", f"WITH {_PERFECT}, f AS (SELECT *, CAST((month(date) - {SOS} + 12) % 12 + 1 AS INT) AS month_index, h + 1 AS horizon FROM sf) SELECT adm_id, year(date)::INT AS year, variable_name, round(mean, 6) AS mean FROM f WHERE month_index = 3 AND horizon BETWEEN 1 AND 7 - 1 - 3")
def sf_horizon_features(spark, sf):
    p = features.perfect_forecast(tables.indicators(spark, sf)).withColumns({"month_index": dekad.season_index(F.month("date"), SOS), "horizon": F.col("h") + 1})
    return features.horizons(p, 3, dekad.season_length(SOS, EOS)).select("adm_id", F.year("date").alias("year"), "variable_name", F.round("mean", 6).alias("mean"))


@query("seasonal_sf_mean", f"WITH {_PERFECT} SELECT adm_id, date, count(*) AS n, round(avg(CASE WHEN starts_with(variable_name, 'SF_r') THEN mean END), 6) AS rain, round(avg(CASE WHEN starts_with(variable_name, 'SF_t') THEN mean END), 6) AS temp FROM sf GROUP BY 1, 2")
def seasonal_sf_mean(spark, sf):
    p = features.perfect_forecast(tables.indicators(spark, sf))
    mean = lambda prefix: F.round(F.avg(F.when(F.col("variable_name").startswith(prefix), F.col("mean"))), 6)
    return p.groupBy("adm_id", "date").agg(F.count("*").alias("n"), mean("SF_r").alias("rain"), mean("SF_t").alias("temp"))


@query("obs_vs_forecast_season", f"WITH {_PERFECT}, f AS (SELECT adm_id, date AS start, mean, CAST(date + to_months(h) AS DATE) AS month FROM sf WHERE starts_with(variable_name, 'SF_r_') AND h <= 2) SELECT f.adm_id, start, count(*) AS n, round(avg(f.mean), 6) AS forecast, round(avg(m.sum), 6) AS observed FROM f JOIN months m ON m.adm_id = f.adm_id AND m.month = f.month AND m.variable_name = 'rainfall' GROUP BY 1, 2")
def obs_vs_forecast_season(spark, sf):
    ind = tables.indicators(spark, sf)
    j = features.observed_vs_forecast(ind, features.perfect_forecast(ind), "rainfall")
    return j.withColumns({c: F.round(c, 6) for c in ("forecast", "observed")})


@query("persistence_fill", f"WITH {INDICATORS}, last AS (SELECT *, max(date) OVER (PARTITION BY adm_id, variable_name) AS last FROM ind), a AS (SELECT adm_id, variable_name, date, mean, false AS filled FROM ind UNION ALL SELECT adm_id, variable_name, CAST(date + INTERVAL 12 MONTH AS DATE), mean, true FROM last WHERE date > CAST(last - INTERVAL 12 MONTH AS DATE)) SELECT adm_id, variable_name, filled, count(*) AS n, min(date) AS first_date, max(date) AS last_date, round(sum(mean), 4) AS total FROM a GROUP BY 1, 2, 3")
def persistence_fill(spark, sf):
    p = features.persistence(tables.indicators(spark, sf))
    return p.groupBy("adm_id", "variable_name", "filled").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.round(F.sum("mean"), 4).alias("total"))


@query(
    "interpolate_gaps",
    f"""WITH {INDICATORS}, o AS (SELECT adm_id, variable_name, {raw_of('date')} AS raw, mean FROM ind WHERE variable_name = 'temperature'), span AS (SELECT adm_id, variable_name, min(raw) AS a, max(raw) AS b FROM o GROUP BY 1, 2),
grid AS (SELECT adm_id, variable_name, CAST(unnest(range(a, b + 1)) AS INT) AS raw FROM span), g AS (SELECT grid.*, mean FROM grid LEFT JOIN o USING (adm_id, variable_name, raw)),
near AS (SELECT g.adm_id, g.raw, g.mean, (SELECT max(raw) FROM o p WHERE p.adm_id = g.adm_id AND p.raw <= g.raw) AS ra, (SELECT min(raw) FROM o p WHERE p.adm_id = g.adm_id AND p.raw >= g.raw) AS rb FROM g)
SELECT n.adm_id, n.raw, n.mean, round(coalesce(n.mean, x.mean + (y.mean - x.mean) * (n.raw - ra) / (rb - ra)), 6) AS mean_filled FROM near n JOIN o x ON x.adm_id = n.adm_id AND x.raw = ra JOIN o y ON y.adm_id = n.adm_id AND y.raw = rb""",
)
def interpolate_gaps(spark, sf):
    g = features.on_full_calendar(tables.indicators(spark, sf).where("variable_name = 'temperature'"))
    return features.interpolate(g, ["adm_id", "variable_name"], "raw", "mean").select("adm_id", "raw", "mean", F.round("mean_filled", 6).alias("mean_filled"))


def _stream(spark, sf):
    from furrow.streaming import dekad_counts

    return dekad_counts.counts(tables.read(spark, sf, "events"))


@query("stream_dekad_counts", f"SELECT {dekad_of('CAST(ts AS DATE)')} AS dekad, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_dekad_counts(spark, sf):
    return _stream(spark, sf)
