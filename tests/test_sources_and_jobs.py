import csv
import zipfile
from dataclasses import replace
from datetime import date, timedelta

import pytest

from stationflow.config import BacktestConfig, MartConfig
from stationflow.operators.eligibility import days_in_window
from stationflow.operators.hourly import direction_day, lane_totals
from stationflow.plans import jobs
from stationflow.plans.models import TRIAL_COUNTS, model_zoo
from stationflow.schemas import HOUR_COLUMNS, HOURLY_KEYS
from stationflow.sources.readers import (
    HOURLY_COLUMNS, load_backtest, load_panel, load_predictions, load_station_day, read_hourly, read_hourly_folder,
)
from stationflow.sources.writers import station_day_name, write_table
from stationflow.streaming.chunked_ingest import chunked_direction_day, ingest_chunks


def write_csv(path, rows, columns=tuple(HOURLY_COLUMNS)):
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(columns)
        for r in rows:
            full = dict(zip(HOURLY_KEYS, r[:4])) | {h: r[4] for h in HOUR_COLUMNS}
            out.writerow([full[c] for c in columns])


YEARS = {
    "2020": [(1, 1, 1, "2020-01-01", 1), (1, 2, 1, "2020-01-01", 2), (2, 1, 1, "bad", 1)],
    "2021": [(1, 1, 1, "2021-01-01", ""), (1, 1, 2, "2021-01-01", "x"), (1, 2, 1, "2021-01-01", 3)],
}
EXPECTED = {(1, date(2020, 1, 1), 1, 24.0), (1, date(2020, 1, 1), 2, 48.0),
            (1, date(2021, 1, 1), 1, 0.0), (1, date(2021, 1, 1), 2, 72.0)}


def totals(df):
    return {tuple(r) for r in df.select("station_id", "date", "dir_of_travel", "vol_dir").collect()}


def test_folder_matches_columns_by_name(spark, tmp_path):
    write_csv(tmp_path / "2020.csv", YEARS["2020"])
    write_csv(tmp_path / "2021.csv", YEARS["2021"], list(reversed(HOURLY_COLUMNS)) + ["note"][:0])
    (tmp_path / "readme.txt").write_text("not read")
    assert totals(direction_day(lane_totals(read_hourly(spark, str(tmp_path))))) == EXPECTED
    with pytest.raises(Exception, match="(?i)header"):
        read_hourly_folder(spark, str(tmp_path), uniform_header=True).collect()


def test_zip_gives_the_same_rows(spark, tmp_path):
    write_csv(tmp_path / "2020.csv", YEARS["2020"])
    write_csv(tmp_path / "2021.csv", YEARS["2021"], list(reversed(HOURLY_COLUMNS)))
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        for name in ("2021.csv", "2020.csv"):
            z.write(tmp_path / name, name)
        z.writestr("notes.txt", "skip me")
    assert totals(direction_day(lane_totals(read_hourly(spark, str(tmp_path / "all.zip"))))) == EXPECTED


def test_missing_columns_and_no_input(spark, tmp_path):
    with pytest.raises(ValueError, match="No data read"):
        read_hourly(spark, str(tmp_path))
    write_csv(tmp_path / "x.csv", YEARS["2020"], [c for c in HOURLY_COLUMNS if c not in ("date", "7")])
    with pytest.raises(ValueError, match=r"x.csv: missing required columns: \['7', 'date'\]"):
        read_hourly(spark, str(tmp_path))
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.write(tmp_path / "x.csv", "x.csv")
    with pytest.raises(Exception, match="missing required columns"):
        read_hourly(spark, str(tmp_path / "x.zip"))


def test_chunked_ingest_adds_up_and_resumes(spark, tmp_path):
    folder, work = tmp_path / "in", str(tmp_path / "work")
    folder.mkdir()
    write_csv(folder / "a.csv", YEARS["2020"])
    write_csv(folder / "b.csv", YEARS["2020"])
    ingest_chunks(spark, str(folder), work, files_per_chunk=1)
    doubled = {(s, d, k, 2 * v) for s, d, k, v in EXPECTED if d.year == 2020}
    assert totals(chunked_direction_day(spark, work)) == doubled
    ingest_chunks(spark, str(folder), work, files_per_chunk=1)  # nothing new: nothing counted twice
    write_csv(folder / "c.csv", YEARS["2021"])
    ingest_chunks(spark, str(folder), work, files_per_chunk=1)
    assert totals(chunked_direction_day(spark, work)) == doubled | {e for e in EXPECTED if e[1].year == 2021}


def test_station_day_from_an_outside_csv(spark, tmp_path):
    path = tmp_path / "days.csv"
    path.write_text("station_id,date,station_volume,valid_day\n1,2020-01-01,5.5,True\n2,2020-01-02,,False\n"
                    "x,2020-01-03,1,True\n3,nope,1,True\n4.0,2020-01-04,7,\n")
    got = {r["station_id"]: r for r in load_station_day(spark, str(path)).collect()}
    assert set(got) == {1, 2, 4} and got[2]["station_volume"] is None and not got[2]["valid_day"]
    assert got[4]["valid_day"] and got[1]["date"] == date(2020, 1, 1)
    with pytest.raises(ValueError, match="missing required columns"):
        (tmp_path / "bad.csv").write_text("station_id\n1\n")
        load_station_day(spark, str(tmp_path / "bad.csv"))


@pytest.mark.parametrize("gzip", [False, True])
def test_csv_sink_reads_back(spark, tmp_path, synthetic_panel, gzip):
    path = write_table(synthetic_panel, str(tmp_path / "panel.csv"), "csv", gzip=gzip)
    assert any(f.name.endswith(".csv.gz" if gzip else ".csv") for f in (tmp_path / "panel.csv").iterdir())
    back = load_panel(spark, path)
    names = ["station_id", "date", "split", "y", "y_roll_std_28"]
    assert back.select(*names).exceptAll(synthetic_panel.select(*names)).isEmpty()
    assert back.count() == synthetic_panel.count()


def test_jobs_end_to_end(spark, tmp_path, synthetic_cfg):
    source = tmp_path / "hourly"
    source.mkdir()
    rows = []
    for station in (1, 2, 3):
        for i in range(620):
            day = date(2022, 1, 1) + timedelta(days=i)
            for direction in (1, 2):
                if (i + station) % 37:
                    rows.append((station, direction, 1, day.isoformat(), station * 10 + (i * 13 + direction) % 7))
    write_csv(source / "one.csv", [r for r in rows if r[3] < "2023"])
    write_csv(source / "two.csv", [r for r in rows if r[3] >= "2023"])
    out = str(tmp_path / "out")
    days_path, cover_path = jobs.build_station_days(spark, str(source), out, MartConfig(coverage_year_start=2022))
    assert days_path.endswith(station_day_name(2022, 2023))
    days = load_station_day(spark, days_path)
    assert days.count() == len(rows) // 2 and days.where("valid_day").count() == days.count()
    pruned = days_in_window(days, synthetic_cfg)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date_year" in pruned and "GreaterThanOrEqual(date,2022-01-01)" in pruned
    assert [r["years_present"] for r in spark.read.option("header", True).csv(cover_path).collect()] == ["2"] * 3
    panel_path, stats_path = jobs.build_panel_job(spark, days_path, f"{out}/panel", synthetic_cfg)
    assert spark.read.option("header", True).csv(stats_path).where("eligible = 'true'").count() == 3
    zoo = {k: v for k, v in model_zoo(counts=TRIAL_COUNTS).items() if v.kind in ("mean", "station_linear") or "ExtraTrees" in k}
    table_path = jobs.compare_models_job(spark, panel_path, f"{out}/comparison.csv", zoo=zoo)
    assert spark.read.option("header", True).csv(table_path).count() == len(zoo) + 3
    pred_path = jobs.predict_job(spark, panel_path, f"{out}/pred.csv.gz", model="ExtraTrees_6_leaf1", zoo=zoo, fmt="csv")
    back_path = jobs.backtest_job(spark, panel_path, f"{out}/backtest.csv", BacktestConfig(
        n_estimators=2, min_train_days=450, step_days=60))
    predictions, backtest = load_predictions(spark, pred_path), load_backtest(spark, back_path)
    assert dict(predictions.dtypes)["vol_pred"] == "double" and dict(backtest.dtypes)["fold"] == "int"
    written = jobs.report_job(f"{out}/reports", days=days, predictions=predictions, backtest=backtest,
                              cfg=replace(synthetic_cfg, window_start=date(2023, 1, 1), min_valid_days=20,
                                          coverage_threshold=0.3),
                              report=MartConfig(baseline_year=2022, shade_from=date(2022, 3, 1)))
    assert len(written) == 19
    empty = [p.rsplit("/", 1)[1] for p in written if spark.read.parquet(p).isEmpty()]
    assert empty == []


# --- archives and folders of any size ------------------------------------------------------------

def jobs_run(spark, work):
    """What ``work`` gives, and how many Spark jobs it ran."""
    tracker, group = spark.sparkContext.statusTracker(), f"jobs-{id(work)}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        return work(), len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_many_files_take_a_constant_number_of_jobs(spark, tmp_path):
    counts = []
    for number in (120, 240):  # Spark lists more than 32 paths of one scan in a job of its own
        folder = tmp_path / str(number)
        folder.mkdir()
        for i in range(number):
            columns = list(HOURLY_COLUMNS) if i % 3 else list(reversed(HOURLY_COLUMNS))
            write_csv(folder / f"{i:03}.csv", [(i, 1, 1, "2020-01-01", 1)], columns)
        rows, jobs_of = jobs_run(spark, lambda: read_hourly_folder(spark, str(folder)))
        counts.append(jobs_of)
        got = totals(direction_day(lane_totals(rows)))
        assert got == {(i, date(2020, 1, 1), 1, 24.0) for i in range(number)}
    assert counts[0] == counts[1]


def test_an_archive_beyond_two_gib_is_read_a_block_at_a_time(spark, tmp_path):
    write_csv(tmp_path / "a.csv", [(s, 1, 1, "2020-01-01", s) for s in range(2_000)])
    with zipfile.ZipFile(tmp_path / "small.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.write(tmp_path / "a.csv", "a.csv")
        z.writestr("b.csv", (tmp_path / "a.csv").read_text().replace("2020-01-01", "2021-01-01"))
        z.writestr("empty.csv", ",".join(HOURLY_COLUMNS) + "\n")
    with open(tmp_path / "large.zip", "wb") as f:  # a hole of 2.2 GiB before the archive takes no room on disk
        f.seek(2_200 << 20)
        f.write((tmp_path / "small.zip").read_bytes())
    assert (tmp_path / "large.zip").stat().st_size > 1 << 31
    rows = read_hourly(spark, str(tmp_path / "large.zip"))
    assert rows.rdd.getNumPartitions() == 3  # a task for each member
    got = totals(direction_day(lane_totals(rows)))
    assert len(got) == 4_000 and (7, date(2021, 1, 1), 1, 168.0) in got


def test_odd_lines_of_a_member(spark, tmp_path):
    header = list(HOURLY_COLUMNS)
    good = ["1", "1", "1", "2020-01-01", *["1"] * 24]
    lines = [header, good, good[:6], [*good[:4], *["2"] * 24, "surplus"], ["2", "1", "1", "2020-01-01", *[""] * 24], []]
    text = "﻿" + "\r\n".join(",".join(line) for line in lines) + "\r\n"
    with zipfile.ZipFile(tmp_path / "odd.zip", "w") as z:
        z.writestr("odd.csv", text.encode())
        z.writestr("quoted.CSV", ",".join(reversed(header)) + "\n" + ",".join(f'"{v}"' for v in reversed(good)) + "\n")
    got = totals(direction_day(lane_totals(read_hourly(spark, str(tmp_path / "odd.zip")))))
    assert got == {(1, date(2020, 1, 1), 1, 24.0 + 2.0 + 48.0 + 24.0), (2, date(2020, 1, 1), 1, 0.0)}


def test_station_days_are_built_in_one_reading(spark, tmp_path):
    source = tmp_path / "hourly"
    source.mkdir()
    write_csv(source / "a.csv", YEARS["2020"] + YEARS["2021"])
    seen: dict = {}
    days_path, _ = jobs.build_station_days(spark, str(source), str(tmp_path / "out"), seen=seen)
    assert days_path.endswith("station_day_2020_2021")
    assert seen == {"rows": 6, "unreadable_dates": 1, "min_year": 2020, "max_year": 2021}  # each row once
    again, _ = jobs.build_station_days(spark, str(source), str(tmp_path / "out"))
    assert again == days_path and load_station_day(spark, again).count() == 2
    assert [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("_station")] == []
    empty = tmp_path / "none"
    empty.mkdir()
    write_csv(empty / "a.csv", [])
    with pytest.raises(ValueError, match="No data read"):
        jobs.build_station_days(spark, str(empty), str(tmp_path / "out2"))
    write_csv(empty / "a.csv", [(1, 1, 1, "never", 1)])
    with pytest.raises(ValueError, match="no date could be read"):
        jobs.build_station_days(spark, str(empty), str(tmp_path / "out2"))


def test_two_rows_for_one_day_are_an_error(spark, synthetic_days, synthetic_cfg):
    from stationflow.operators.panel import build_panel

    twice = synthetic_days.unionByName(synthetic_days.where("station_id = 2 AND date = DATE '2022-03-05'"))
    with pytest.raises(Exception, match="station 2 has more than one row for 2022-03-05"):
        build_panel(twice, synthetic_cfg).collect()


def test_a_chunked_job_that_is_cut_off_goes_on(spark, tmp_path, monkeypatch):
    from stationflow.streaming import chunked_ingest

    folder, work, out = tmp_path / "in", str(tmp_path / "work"), str(tmp_path / "out")
    folder.mkdir()
    rows = YEARS["2020"] + YEARS["2021"]
    for i in range(4):
        write_csv(folder / f"{i}.csv", [(s + 10 * i, *rest) for s, *rest in rows])
    real, done = chunked_ingest.observed, []

    def cut_off(chunk, facts, write):
        if len(done) == 2:
            raise RuntimeError("the lights went out")
        found = real(chunk, facts, write)
        done.append(found["rows"])
        return found

    monkeypatch.setattr(chunked_ingest, "observed", cut_off)
    with pytest.raises(Exception, match="the lights went out"):
        jobs.build_station_days(spark, str(folder), out, work=work, files_per_chunk=1)
    monkeypatch.setattr(chunked_ingest, "observed", lambda *a: done.append(0) or real(*a))
    seen: dict = {}
    days_path, _ = jobs.build_station_days(spark, str(folder), out, work=work, files_per_chunk=1, seen=seen)
    assert len(done) == 4 and done[:2] == [6, 6]  # the first two chunks were not read again
    assert seen == {"rows": 24, "unreadable_dates": 4, "min_year": 2020, "max_year": 2021}
    plain, _ = jobs.build_station_days(spark, str(folder), str(tmp_path / "plain"))
    first, second = (load_station_day(spark, p).drop("date_year") for p in (days_path, plain))
    assert first.count() == 8 and first.exceptAll(second.select(first.columns)).isEmpty()
