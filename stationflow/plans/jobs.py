"""The jobs. Each reads its input tables, builds one plan per output and writes it.

Defaults of all paths are the caller's: one folder per job, named by the caller.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.config import BacktestConfig, MartConfig, PanelConfig
from stationflow.functions.cleaning import DATE_FORMATS
from stationflow.lineage import discard_path, settle
from stationflow.operators.eligibility import eligibility_stats
from stationflow.operators.hourly import direction_day, lane_totals, observed, source_facts
from stationflow.operators.panel import build_panel
from stationflow.operators.station_day import station_coverage, station_day
from stationflow.plans import forecast_reports as FR
from stationflow.plans import station_reports as SR
from stationflow.plans.backtest import rolling_backtest
from stationflow.plans.bakeoff import evaluate_models, fit_and_predict, sorted_comparison
from stationflow.plans.models import ModelSpec, model_zoo, pick_model
from stationflow.schemas import YEAR_FOLDER
from stationflow.sources.readers import load_panel, load_station_day, read_hourly
from stationflow.sources.writers import coverage_name, descending, station_day_name, write_table
from stationflow.streaming.chunked_ingest import chunked_direction_day, chunked_facts, ingest_chunks


def _moved(spark: SparkSession, old: str, new: str) -> None:
    """A written folder under its final name; one that stands there already goes."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(new).getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(path(new), True)
    if not system.rename(path(old), path(new)):
        raise OSError(f"{old} could not be renamed to {new}")


def build_station_days(spark: SparkSession, source: str, outdir: str, report: MartConfig = MartConfig(),
                       fmt: str = "parquet", formats: Sequence[str] = DATE_FORMATS, seen: dict | None = None,
                       work: str | None = None, files_per_chunk: int = 16) -> tuple[str, str]:
    """Hourly files -> station-day table and coverage table; returns the two paths.

    The source is read once: what the file name says (first and last year) and what must be known of it is observed while
    the table is written, which then gets its name. ``seen`` is told the rows read and those whose date is unreadable.
    ``formats`` are the forms of dates besides ISO; a source without any row, or any readable date, is an error.
    As Parquet the station-day table is split by year, so the window filter skips whole folders.

    With ``work``, a shared folder, a folder of files is taken in chunk by chunk: a run that is cut off goes on after its last
    finished chunk, and a later run reads only files that are new.
    """
    ending = ".csv" if fmt == "csv" else ""
    draft = f"{outdir}/_station_day_{uuid.uuid4().hex}{ending}"

    def written(totals: DataFrame) -> None:
        days = station_day(totals)
        if fmt == "parquet":
            write_table(days.withColumn(YEAR_FOLDER, F.year("date")), draft, fmt, partition_by=[YEAR_FOLDER])
        else:
            write_table(days, draft, fmt, order=["station_id", "date"])

    if work:
        ingest_chunks(spark, source, work, files_per_chunk, formats)
        written(chunked_direction_day(spark, work))
        facts = chunked_facts(spark, work)
    else:
        hourly = read_hourly(spark, source, check=False)
        facts = observed(hourly, source_facts(hourly, formats),
                         lambda rows: written(direction_day(lane_totals(rows, source, formats))))
    if seen is not None:
        seen.update(facts)
    if not facts["rows"] or facts["min_year"] is None:
        discard_path(spark, draft)
        raise ValueError("No data read from input." if not facts["rows"] else
                         f"{source}: no date could be read as ISO or {list(formats)}")
    days_path = f"{outdir}/{station_day_name(facts['min_year'], facts['max_year'])}{ending}"
    _moved(spark, draft, days_path)
    written = load_station_day(spark, days_path)
    coverage = station_coverage(written, report.coverage_year_start, report.coverage_year_end)
    cover_path = f"{outdir}/{coverage_name(report.coverage_year_start, report.coverage_year_end)}.csv"
    write_table(coverage, cover_path, "csv",
                order=descending("years_present", "min_cov", "avg_cov", "avg_volume"))
    return days_path, cover_path


def build_panel_job(spark: SparkSession, days_path: str, out: str, cfg: PanelConfig = PanelConfig(),
                    fmt: str = "parquet") -> tuple[str, str]:
    """Station days -> feature panel and eligibility statistics; returns the two paths."""
    days = load_station_day(spark, days_path)
    panel_path = write_table(build_panel(days, cfg), out, fmt, gzip=True)
    stats_path = write_table(eligibility_stats(days, cfg), f"{out.rsplit('/', 1)[0]}/eligible_station_stats.csv",
                             "csv", order=descending("eligible", "coverage", "mean_volume"))
    return panel_path, stats_path


def compare_models_job(spark: SparkSession, panel_path: str, out: str, sort_by: str = "test_VOL_RMSE",
                       zoo: dict[str, ModelSpec] | None = None) -> str:
    comparison = settle(evaluate_models(load_panel(spark, panel_path), zoo=zoo))
    ordered = sorted_comparison(comparison, sort_by)
    # One row per model: a single file keeps the order readable.
    return write_table(ordered.coalesce(1), out, "csv")


def predict_job(spark: SparkSession, panel_path: str, out: str, model: str = "ExtraTrees_600_leaf1",
                zoo: dict[str, ModelSpec] | None = None, fmt: str = "parquet") -> str:
    spec = pick_model(model_zoo() if zoo is None else zoo, model)
    return write_table(fit_and_predict(load_panel(spark, panel_path), spec), out, fmt, gzip=True)


def backtest_job(spark: SparkSession, panel_path: str, out: str, cfg: BacktestConfig = BacktestConfig()) -> str:
    folds = rolling_backtest(load_panel(spark, panel_path), cfg)
    return write_table(folds, out, "csv", order=["fold"])


def report_tables(days: DataFrame | None = None, predictions: DataFrame | None = None,
                  backtest: DataFrame | None = None, cfg: PanelConfig = PanelConfig(),
                  report: MartConfig = MartConfig()) -> dict[str, DataFrame]:
    """All report tables whose input is given; the others are left out."""
    tables: dict[str, DataFrame] = {}
    if days is not None:
        weekly = settle(SR.ratio_to_baseline_weekly(days, cfg, report))
        system = settle(SR.system_weekly(days, cfg))
        ratios = SR.winsorized_ratio(days, cfg)  # settled inside, read by two tables
        weekparts = settle(SR.weekpart_by_station(days, cfg, ratios))
        tables |= {
            "ratio_to_baseline_weekly": weekly,
            "volatility_change": SR.volatility_change(weekly, cfg),
            "system_weekly": system,
            "period_flags": SR.period_flags(system, cfg, report),
            "dow_profile": SR.dow_profile(days, cfg, ratios),
            "weekpart_by_station": weekparts,
            "weekpart_summary": SR.weekpart_summary(weekparts),
        }
    if predictions is not None:
        improvement = settle(FR.station_improvement(predictions))
        tiers = settle(FR.improvement_tiers(improvement))
        slots = settle(FR.example_stations(predictions))
        examples = settle(FR.example_forecasts(predictions, slots))
        tables |= {
            "station_improvement": improvement,
            "improvement_share": FR.improvement_share(improvement),
            "improvement_histogram": FR.improvement_histogram(improvement),
            "improvement_tiers": tiers,
            "improvement_trend": FR.improvement_trend(tiers),
            "tier_summary": FR.tier_summary(tiers),
            "improvement_axis": FR.improvement_axis(improvement),
            "example_forecasts": examples,
            "win_rate": FR.win_rate(examples),
            "system_total_forecast_weekly": FR.system_total_forecast_weekly(predictions),
        }
    if backtest is not None:
        tables |= {
            "backtest_deltas": FR.backtest_deltas(backtest),
            "backtest_summary": FR.backtest_summary(backtest),
        }
    return tables


def report_job(outdir: str, **inputs) -> list[str]:
    return [write_table(table, f"{outdir}/{name}") for name, table in report_tables(**inputs).items()]
