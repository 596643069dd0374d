"""Forecasts and their accuracy in the columns of an exchange template.

A unit is known by the source's id if it has one, else by its own; crops may have other names there. What the template wants and a
forecast doesn't have is `n.a.` or empty, as it says."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's columns in their order.
FORECAST = [
    "source_id", "source_name_version", "admin_0", "admin_1", "admin_2", "admin_3", "planted_year", "approx_planted_month", "harvest_year", "approx_harvest_month",
    "crop", "crop_season", "forecast_issue_date (yyyy-mm-dd)", "date_model_run (yyyy-mm-dd)", "input_croptype_product", "group", "model_version", "yield_fcst (tn_ha)", "is_final", "notes",
]
ACCURACY = [
    "source_id", "source_name_version", "admin_0", "admin_1", "admin_2", "admin_3", "planted_year", "approx_planted_month", "harvest_year", "approx_harvest_month",
    "crop", "season", "forecast_issue_date (yyyy-mm-dd)", "date_model_run (yyyy-mm-dd)", "input_croptype_product", "group", "model_version", "cross_validation",
    "yield_mae", "yield_rmse", "yield_rrmse", "yield_mape", "yield_r2_pearson", "yield_r2_true", "metric_years", "notes",
]


@dataclass
class Settings:
    country: str
    source: str
    sos: int
    eos: int
    harvest_year: int
    group: str
    issued: str
    run: str
    version: str
    #: A season that starts in the year before its harvest.
    planting_delta: int = 0
    recode: dict[str, str] = field(default_factory=dict)


def _common(j: DataFrame, s: Settings) -> dict[str, Column]:
    """regions may bring source_id, source_name_version, admin_1 and admin_2; without these the unit's own id and name stand."""
    has = lambda c, other: F.col(c) if c in j.columns else other
    crop = F.coalesce(F.create_map(*(F.lit(x) for kv in s.recode.items() for x in kv))[F.col("crop")], F.col("crop")) if s.recode else F.col("crop")
    none, text = F.lit("n.a."), F.lit("")
    return {
        "source_id": has("source_id", F.col("adm_id")), "source_name_version": has("source_name_version", F.lit(s.source)), "admin_0": F.lit(s.country), "admin_1": has("admin_1", F.col("adm_name")), "admin_2": has("admin_2", text), "admin_3": text,
        "planted_year": F.lit(s.harvest_year + s.planting_delta), "approx_planted_month": F.lit(s.sos), "harvest_year": F.lit(s.harvest_year), "approx_harvest_month": F.lit(s.eos),
        "crop": crop, "crop_season": none, "season": none, "forecast_issue_date (yyyy-mm-dd)": F.lit(s.issued), "date_model_run (yyyy-mm-dd)": F.lit(s.run), "input_croptype_product": none,
        "group": F.lit(s.group), "model_version": F.lit(f"{s.version}_{s.run}"), "is_final": none, "notes": text,
    }


def forecast_form(rows: DataFrame, regions: DataFrame, s: Settings, digits: int = 6) -> DataFrame:
    """FORECAST of rows (adm_id, crop, fyield in t/ha)."""
    j = rows.join(regions, "adm_id")
    columns = _common(j, s) | {"yield_fcst (tn_ha)": F.round("fyield", digits)}
    return j.select(*(columns[c].alias(c) for c in FORECAST))


def accuracy_form(errors: DataFrame, regions: DataFrame, s: Settings, years: list[int], digits: int = 6) -> DataFrame:
    """ACCURACY of errors by unit and crop (mae, rmse, rrmse_prct, rmae_prct, r2_pearson, r2) over the given years."""
    j = errors.join(regions, "adm_id")
    of = {"yield_mae": "mae", "yield_rmse": "rmse", "yield_rrmse": "rrmse_prct", "yield_mape": "rmae_prct", "yield_r2_pearson": "r2_pearson", "yield_r2_true": "r2"}
    columns = _common(j, s) | {"cross_validation": F.lit(0), "metric_years": F.lit(",".join(map(str, years)))} | {c: F.round(e, digits) + F.lit(0.0) for c, e in of.items()}
    return j.select(*(columns[c].alias(c) for c in ACCURACY))
