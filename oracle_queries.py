"""ANSI SQL twins of the registered queries, written for DuckDB over the same parquet tables.

They take the long way on purpose: gap-filled calendars in place of range frames, joins in place of
one-pass aggregates, range joins in place of fold arithmetic.
"""

from __future__ import annotations

import oracle_linear as OL
import oracle_trees as OT

HOURS = range(1, 25)
START, END = "DATE '1998-01-01'", "DATE '2001-06-30'"
TRAIN_END, VAL_END = "DATE '2000-06-30'", "DATE '2000-12-31'"
EXPECTED_DAYS = 1277
FEATURES = [
    "dow", "month", "sin_doy", "cos_doy", "y_lag_1", "y_lag_7", "y_lag_14", "y_lag_28",
    "y_roll_mean_7", "y_roll_std_7", "y_roll_mean_28", "y_roll_std_28",
]
METRICS = {
    "RMSE": "sqrt(avg(({y} - {p}) * ({y} - {p})))",
    "MAE": "avg(abs({y} - {p}))",
    "MAPE_%": "avg(abs(({y} - {p}) / greatest(abs({y}), 1e-9))) * 100",
    "sMAPE_%": "avg(2.0 * abs({p} - {y}) / greatest(abs({y}) + abs({p}), 1e-9)) * 100",
}


def r(*columns: str) -> str:
    """Rounded output columns; adding zero turns a negative zero into zero."""
    return ", ".join(f'round("{c}", 6) + 0.0 AS "{c}"' for c in columns)


def smape(y: str, p: str) -> str:
    return METRICS["sMAPE_%"].format(y=y, p=p)


def rmse(y: str, p: str) -> str:
    return METRICS["RMSE"].format(y=y, p=p)


def volume(z: str) -> str:
    return f"greatest(exp({z}) - 1, 0)"


# --- raw to station day -------------------------------------------------------------------------

def hourly(station: str = "l_suppkey % 5", direction: str = "CASE l_linestatus WHEN 'O' THEN 1 ELSE 2 END",
           source: str = "lineitem") -> list[str]:
    cols = ", ".join(f'sum(l_quantity) FILTER (WHERE l_orderkey % 24 + 1 = {h}) AS "{h}"' for h in HOURS)
    return [f"""hourly_lane AS (
      SELECT {station} AS station_id, {direction} AS dir_of_travel, l_linenumber AS lane_of_travel,
             CAST(l_shipdate AS DATE) AS date, {cols}
      FROM {source} GROUP BY 1, 2, 3, 4)"""]


BY_REGION = dict(
    station="n_regionkey",
    source="lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey",
)
THREE_DIRECTIONS = "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END"


def text_hours() -> list[str]:
    """Text rows as an outside file would hold them, and their typed copy."""
    value = """CASE WHEN l_tax = 0.08 THEN 'n/a' WHEN l_tax = 0.07 THEN ''
               ELSE CAST(l_quantity AS VARCHAR) END"""
    texts = ", ".join(f'CASE WHEN l_orderkey % 24 + 1 = {h} THEN {value} END AS "{h}"' for h in HOURS)
    typed = ", ".join(f'TRY_CAST("{h}" AS DOUBLE) AS "{h}"' for h in HOURS)
    return [f"""raw_text AS (
      SELECT CASE WHEN l_suppkey % 10 = 9 THEN '' WHEN l_suppkey % 10 = 8
                  THEN CAST(l_suppkey % 5 AS VARCHAR) || '.0' ELSE CAST(l_suppkey % 5 AS VARCHAR) END AS station_id,
             CASE WHEN l_linestatus = 'O' THEN '1' ELSE '2' END AS dir_of_travel,
             CAST(l_linenumber AS VARCHAR) AS lane_of_travel,
             CASE WHEN l_discount = 0.10 THEN 'no date' WHEN l_discount = 0.09
                  THEN strftime(l_shipdate, '%Y-%m-%d') || ' 00:00:00'
                  ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date, {texts}
      FROM lineitem)""", f"""hourly_lane AS (
      SELECT CAST(TRY_CAST(station_id AS DOUBLE) AS BIGINT) AS station_id,
             CAST(TRY_CAST(dir_of_travel AS DOUBLE) AS BIGINT) AS dir_of_travel,
             CAST(TRY_CAST(lane_of_travel AS DOUBLE) AS BIGINT) AS lane_of_travel,
             CAST(TRY_CAST(date AS TIMESTAMP) AS DATE) AS date, {typed}
      FROM raw_text)"""]


def lanes(source: list[str]) -> list[str]:
    names = ", ".join(f'"{h}"' for h in HOURS)
    total = " + ".join(f'coalesce("{h}", 0)' for h in HOURS)
    return source + [f"""lanes AS (
      SELECT station_id, dir_of_travel, lane_of_travel, date,
             CASE WHEN coalesce({names}) IS NOT NULL THEN {total} END AS lane_total
      FROM hourly_lane WHERE date IS NOT NULL)"""]


def dir_day(source: list[str]) -> list[str]:
    return lanes(source) + ["""dir_day AS (
      SELECT station_id, date, dir_of_travel, coalesce(sum(lane_total), 0) AS vol_dir
      FROM lanes WHERE station_id IS NOT NULL AND dir_of_travel IS NOT NULL GROUP BY 1, 2, 3)"""]


def top_two(source: list[str]) -> list[str]:
    return dir_day(source) + ["""dir_counts AS (
      SELECT station_id, dir_of_travel, count(*) AS n FROM dir_day GROUP BY 1, 2)""", """dir_ranked AS (
      SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY n DESC, dir_of_travel) AS place
      FROM dir_counts)""", """dirs AS (
      SELECT station_id, max(dir_of_travel) FILTER (WHERE place = 1) AS dir_a,
             max(dir_of_travel) FILTER (WHERE place = 2) AS dir_b, count(*) AS n_dirs
      FROM dir_ranked GROUP BY 1)"""]


def station_day(source: list[str]) -> list[str]:
    return top_two(source) + ["""totals AS (
      SELECT station_id, date, sum(vol_dir) AS station_volume FROM dir_day GROUP BY 1, 2)""", """joined AS (
      SELECT t.*, d.dir_a, d.dir_b, d.n_dirs, a.vol_dir AS vol_a, b.vol_dir AS vol_b,
             coalesce(a.vol_dir, 0) + coalesce(b.vol_dir, 0) AS both_dirs
      FROM totals t LEFT JOIN dirs d ON d.station_id = t.station_id
      LEFT JOIN dir_day a ON a.station_id = t.station_id AND a.date = t.date AND a.dir_of_travel = d.dir_a
      LEFT JOIN dir_day b ON b.station_id = t.station_id AND b.date = t.date AND b.dir_of_travel = d.dir_b)""",
      """station_day AS (
      SELECT station_id, date, station_volume, dir_a, dir_b, vol_a, vol_b,
             CASE WHEN both_dirs > 0 THEN vol_a / both_dirs END AS share_a,
             CASE WHEN both_dirs > 0 THEN vol_b / both_dirs END AS share_b, n_dirs,
             coalesce(station_volume > 0 AND n_dirs = 2 AND vol_a IS NOT NULL AND vol_b IS NOT NULL
                      AND both_dirs > 0, false) AS valid_day
      FROM joined)"""]


STATION_DAY_OUT = f"""station_id, date, dir_a, dir_b, n_dirs, valid_day,
    {r("station_volume", "vol_a", "vol_b", "share_a", "share_b")}"""

COVERAGE = ["""by_year AS (
      SELECT station_id, CAST(year(date) AS BIGINT) AS year, count(*) FILTER (WHERE valid_day) AS valid_days,
             avg(station_volume) AS avg_volume
      FROM station_day WHERE year(date) BETWEEN 1997 AND 2001 GROUP BY 1, 2)""", """covered AS (
      SELECT *, make_date(year + 1, 1, 1) - make_date(year, 1, 1) AS expected_days,
             valid_days / (make_date(year + 1, 1, 1) - make_date(year, 1, 1)) AS cov
      FROM by_year)"""]


def eligible(coverage: float, min_days: int) -> list[str]:
    return [f"""stats AS (
      SELECT station_id, count(DISTINCT date) AS valid_days, avg(station_volume) AS mean_volume,
             min(date) AS min_date, max(date) AS max_date, count(DISTINCT date) / {EXPECTED_DAYS} AS coverage
      FROM station_day WHERE valid_day AND date BETWEEN {START} AND {END} GROUP BY 1)""", f"""flags AS (
      SELECT *, coverage >= {coverage} AS eligible_cov, valid_days >= {min_days} AS eligible_days,
             coverage >= {coverage} AND valid_days >= {min_days} AS eligible
      FROM stats)""", "chosen AS (SELECT station_id FROM flags WHERE eligible)"]


ELIGIBLE = eligible(0.80, 730)
FLAGS_OUT = f"""station_id, valid_days, min_date, max_date, eligible_cov, eligible_days, eligible,
    {r("mean_volume", "coverage")}"""


# --- panel --------------------------------------------------------------------------------------

def panel(source: list[str] | None = None, limits: list[str] | None = None) -> list[str]:
    lag = ", ".join(f"lag(y, {k}) OVER by_day AS y_lag_{k}" for k in (1, 7, 14, 28))
    roll = ", ".join(
        f"""CASE WHEN count(y) OVER last_{w} >= {max(2, w // 3)} THEN avg(y) OVER last_{w} END AS y_roll_mean_{w},
            CASE WHEN count(y) OVER last_{w} >= {max(2, w // 3)} THEN stddev_samp(y) OVER last_{w} END AS y_roll_std_{w}"""
        for w in (7, 28)
    )
    frames = ", ".join(
        f"last_{w} AS (PARTITION BY station_id ORDER BY date ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        for w in (7, 28)
    )
    flag = ", ".join(
        [f"CAST(y_lag_{k} IS NOT NULL AS INTEGER) AS has_y_lag_{k}" for k in (1, 7, 14, 28)]
        + [f"CAST(y_roll_mean_{w} IS NOT NULL AS INTEGER) AS has_y_roll_{w}" for w in (7, 28)]
    )
    return station_day(source or hourly()) + (limits or ELIGIBLE) + [f"""days AS (
      SELECT CAST(d AS DATE) AS date FROM generate_series({START}, {END}, INTERVAL 1 DAY) AS g(d))""", """grid AS (
      SELECT station_id, date FROM chosen CROSS JOIN days)""", """filled AS (
      SELECT g.station_id, g.date, s.station_volume, ln(1 + s.station_volume) AS y
      FROM grid g LEFT JOIN station_day s
        ON s.station_id = g.station_id AND s.date = g.date AND s.valid_day)""", f"""history AS (
      SELECT *, {lag}, {roll} FROM filled
      WINDOW by_day AS (PARTITION BY station_id ORDER BY date), {frames})""", f"""panel AS (
      SELECT *, isodow(date) - 1 AS dow, month(date) AS month, year(date) AS year, dayofyear(date) AS dayofyear,
             sin(2 * pi() * dayofyear(date) / 365.25) AS sin_doy, cos(2 * pi() * dayofyear(date) / 365.25) AS cos_doy,
             {flag},
             CASE WHEN date <= {TRAIN_END} THEN 'train' WHEN date <= {VAL_END} THEN 'val' ELSE 'test' END AS split
      FROM history WHERE y IS NOT NULL AND y_lag_7 IS NOT NULL)"""]


LAGS = [f"y_lag_{k}" for k in (1, 7, 14, 28)]
ROLLS = [f"y_roll_{s}_{w}" for w in (7, 28) for s in ("mean", "std")]
HAS = [f"has_y_lag_{k}" for k in (1, 7, 14, 28)] + [f"has_y_roll_{w}" for w in (7, 28)]
COMPLETE = ["complete AS (SELECT * FROM panel WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in FEATURES) + ")"]

# --- scores -------------------------------------------------------------------------------------

BASELINES = {"seasonal_naive_lag7": "y_lag_7", "naive_lag1": "y_lag_1", "rolling_mean_7": "y_roll_mean_7"}


def long_form(models: dict[str, str], source: str = "complete") -> list[str]:
    parts = [
        f"SELECT '{name}' AS model, split, station_id, y, {expr} AS yhat FROM {source} WHERE split <> 'train'"
        for name, expr in models.items()
    ]
    return ["preds AS (" + " UNION ALL ".join(parts) + ")"]


def scores(prefix: str, station_weighted: bool) -> str:
    y, p = (volume("y"), volume("yhat")) if "VOL" in prefix else ("y", "yhat")
    cols = ", ".join(f'{expr.format(y=y, p=p)} AS "{prefix}{name}"' for name, expr in METRICS.items())
    names = [f"{prefix}{name}" for name in METRICS]
    if not station_weighted:
        return f"SELECT model, split, {r(*names)} FROM (SELECT model, split, {cols} FROM preds GROUP BY 1, 2)"
    means = ", ".join(f'avg("{n}") AS "{n}"' for n in names)
    return f"""SELECT model, split, "STW_n_stations", {r(*names)} FROM (
      SELECT model, split, count(*) AS "STW_n_stations", {means} FROM (
        SELECT model, split, station_id, {cols} FROM preds GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


def comparison() -> str:
    """All 34 metric columns of the comparison table."""
    plain, weighted, picks = [], [], []
    for scale, (y, p) in {"": ("y", "yhat"), "VOL_": (volume("y"), volume("yhat"))}.items():
        plain += [f'{e.format(y=y, p=p)} AS "{scale}{n}"' for n, e in METRICS.items()]
        weighted += [f'{e.format(y=y, p=p)} AS "STW_{scale}{n}"' for n, e in METRICS.items()]
    stw = [f"STW_{s}{n}" for s in ("", "VOL_") for n in METRICS]
    for split in ("val", "test"):
        for name in [f"{s}{n}" for s in ("", "VOL_") for n in METRICS]:
            picks.append(f"""round(max(p."{name}") FILTER (WHERE p.split = '{split}'), 6) AS "{split}_{name}" """)
        for name in stw:
            picks.append(f"""round(max(w."{name}") FILTER (WHERE w.split = '{split}'), 6) AS "{split}_{name}" """)
        picks.append(f"""max(w.n) FILTER (WHERE w.split = '{split}') AS "{split}_STW_n_stations" """)
        picks.append(f"""max(p.n_rows) FILTER (WHERE p.split = '{split}') AS "{split}_n_rows" """)
    means = ", ".join(f'avg("{n}") AS "{n}"' for n in stw)
    return f"""SELECT 'BASELINE::' || p.model AS model,
        'uses ' || CASE p.model WHEN 'naive_lag1' THEN 'y_lag_1' WHEN 'rolling_mean_7' THEN 'y_roll_mean_7'
                   ELSE 'y_lag_7' END AS notes, {", ".join(picks)}
      FROM (SELECT model, split, count(*) AS n_rows, {", ".join(plain)} FROM preds GROUP BY 1, 2) p
      JOIN (SELECT model, split, count(*) AS n, {means} FROM (
              SELECT model, split, station_id, {", ".join(weighted)} FROM preds GROUP BY 1, 2, 3) GROUP BY 1, 2) w
        ON w.model = p.model AND w.split = p.split
      GROUP BY p.model"""


# --- folds --------------------------------------------------------------------------------------

def folds(step: int = 56, horizon: int = 28, min_train: int = 365) -> list[str]:
    return [f"""fold_dates AS (
      SELECT CAST(s AS DATE) AS test_start,
             row_number() OVER (ORDER BY s) AS fold, d0
      FROM (SELECT min(date) AS d0, max(date) AS d1 FROM complete) b,
           generate_series(b.d0 + {min_train}, b.d1 - {horizon - 1}, INTERVAL {step} DAY) AS g(s))""",
      f"""folds AS (SELECT fold, CAST(test_start - 1 AS DATE) AS train_end, test_start,
             CAST(test_start + {horizon - 1} AS DATE) AS test_end FROM fold_dates)"""]


def backtest(model: str = "y_roll_mean_7", rows: str = "folds JOIN complete ON date BETWEEN test_start AND test_end") -> list[str]:
    vy, vm, vb = volume("y"), volume(model), volume("y_lag_7")
    return [f"""bt AS (
      SELECT fold, train_end, test_start, test_end, count(*) AS rows_test, count(DISTINCT station_id) AS stations_test,
             {smape("y", "y_lag_7")} AS y_smape_base, {smape("y", model)} AS y_smape_et,
             {smape(vy, vb)} AS vol_smape_base, {smape(vy, vm)} AS vol_smape_et,
             {rmse(vy, vb)} AS vol_rmse_base, {rmse(vy, vm)} AS vol_rmse_et
      FROM {rows} GROUP BY 1, 2, 3, 4)""", """backtest AS (
      SELECT *, y_smape_base - y_smape_et AS y_smape_improve_pp, vol_smape_base - vol_smape_et AS vol_smape_improve_pp,
             100.0 * (vol_rmse_base - vol_rmse_et) / greatest(vol_rmse_base, 1e-9) AS vol_rmse_improve_pct
      FROM bt)"""]


BACKTEST_OUT = "fold, train_end, test_start, test_end, rows_test, stations_test, " + r(
    "y_smape_base", "y_smape_et", "y_smape_improve_pp", "vol_smape_base", "vol_smape_et", "vol_smape_improve_pp",
    "vol_rmse_base", "vol_rmse_et", "vol_rmse_improve_pct",
)

# --- reports ------------------------------------------------------------------------------------

WEEK = "CAST(date_trunc('week', date) AS DATE) + 6"


def quantiles(column: str, **probs: float) -> str:
    return ", ".join(f"quantile_cont({column}, {p}) AS {name}" for name, p in probs.items())


RATIO = ["""base_year AS (
      SELECT station_id, median(station_volume) AS baseline FROM station_day
      WHERE valid_day AND year(date) = 1997 AND station_id IN (SELECT station_id FROM chosen) GROUP BY 1)""",
      f"""ratios AS (
      SELECT {WEEK} AS week_ending, station_volume / baseline AS ratio
      FROM station_day JOIN base_year USING (station_id) WHERE valid_day AND date >= DATE '1997-01-01')""",
      f"""weekly_ratio AS (
      SELECT week_ending, {quantiles("ratio", median=0.5, q25=0.25, q75=0.75)} FROM ratios GROUP BY 1)""",
      """ratio_weekly AS (
      SELECT *, CASE WHEN count(*) OVER w >= 8 THEN stddev_samp(median) OVER w END AS median_roll_std_13w
      FROM weekly_ratio WINDOW w AS (ORDER BY week_ending ROWS BETWEEN 12 PRECEDING AND CURRENT ROW))"""]

SKETCHED = RATIO[:2] + ["""weekly_ratio AS (
      SELECT week_ending, count(*) AS n, quantile_disc(ratio, 0.5) AS median, quantile_disc(ratio, 0.25) AS q25,
             quantile_disc(ratio, 0.75) AS q75 FROM ratios GROUP BY 1)"""] + RATIO[3:]

SYSTEM = [f"""plotted AS (
      SELECT * FROM station_day WHERE valid_day AND date BETWEEN {START} AND {END}
        AND station_id IN (SELECT station_id FROM chosen))""", """daily AS (
      SELECT date, sum(station_volume) AS total_volume, count(DISTINCT station_id) AS active_stations
      FROM plotted GROUP BY 1)""", f"""weekly AS (
      SELECT {WEEK} AS week_ending, sum(total_volume) AS total_volume, median(active_stations) AS active_stations,
             count(*) AS n_days FROM daily GROUP BY 1 HAVING count(*) >= 6)""", """system_weekly AS (
      SELECT *, total_volume / active_stations AS vol_per_station,
             avg(total_volume / active_stations) OVER w AS vps_ma8, avg(active_stations) OVER w AS stations_ma8
      FROM weekly WINDOW w AS (ORDER BY week_ending ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))"""]

WINSOR = [f"""plotted AS (
      SELECT * FROM station_day WHERE valid_day AND date BETWEEN {START} AND {END}
        AND station_id IN (SELECT station_id FROM chosen))""", """normed AS (
      SELECT p.station_id, isodow(date) - 1 AS dow, station_volume / m.station_median AS ratio
      FROM plotted p JOIN (SELECT station_id, median(station_volume) AS station_median FROM plotted GROUP BY 1) m
        ON m.station_id = p.station_id)""", f"""bounds AS (SELECT {quantiles("ratio", lo=0.01, hi=0.99)} FROM normed)""",
      """clipped AS (SELECT station_id, dow, least(greatest(ratio, lo), hi) AS ratio_w FROM normed, bounds)"""]

WEEKPARTS = ["""weekparts AS (
      SELECT station_id, avg(ratio_w) FILTER (WHERE dow < 5) AS weekday_mean,
             avg(ratio_w) FILTER (WHERE dow >= 5) AS weekend_mean
      FROM clipped GROUP BY 1 HAVING avg(ratio_w) FILTER (WHERE dow < 5) > 0
         AND avg(ratio_w) FILTER (WHERE dow >= 5) IS NOT NULL)"""]

# Twenty stations, no eligibility limit; prediction = rolling mean of 7 days.
WIDE_PANEL = panel(hourly("l_suppkey % 20"), eligible(0.0, 0))


def tidy(source: str) -> list[str]:
    return [f"""predictions AS (
      SELECT split, date, station_id, y AS y_true, y_roll_mean_7 AS y_pred, y_lag_7 AS y_base,
             station_volume AS vol_true, {volume("y_roll_mean_7")} AS vol_pred, {volume("y_lag_7")} AS vol_base
      FROM {source} WHERE split IN ('val', 'test') AND y_roll_mean_7 IS NOT NULL)"""]


IMPROVEMENT = WIDE_PANEL + tidy("panel") + [f"""improvement AS (
      SELECT *, smape_base - smape_et AS delta_smape_pp FROM (
        SELECT station_id, {smape("vol_true", "vol_base")} AS smape_base, {smape("vol_true", "vol_pred")} AS smape_et,
               avg(vol_true) AS mean_volume
        FROM predictions WHERE split = 'test' GROUP BY 1))"""]
TIERS = IMPROVEMENT + ["""logged AS (SELECT *, log10(greatest(mean_volume, 1)) AS log_mean_vol FROM improvement)""",
    """edges AS (SELECT quantile_cont(mean_volume, 1.0 / 3) AS t1, quantile_cont(mean_volume, 2.0 / 3) AS t2,
             list_distinct([""" + ", ".join(f"quantile_cont(log_mean_vol, {i / 8})" for i in range(9)) + """]) AS e
             FROM logged)""", """tiers AS (
      SELECT logged.*, CASE WHEN mean_volume <= t1 THEN 'low' WHEN mean_volume <= t2 THEN 'mid' ELSE 'high' END AS tier,
             greatest(1, len(list_filter(e, lambda x: x < log_mean_vol))) AS qbin
      FROM logged, edges)"""]
EXAMPLES = WIDE_PANEL + tidy("panel") + ["""test AS (SELECT * FROM predictions WHERE split = 'test')""", """means AS (
      SELECT station_id, mean_vol, row_number() OVER (ORDER BY mean_vol, station_id) AS pos, count(*) OVER () AS n
      FROM (SELECT station_id, avg(vol_true) AS mean_vol FROM test GROUP BY 1))""", """slots AS (
      SELECT slot, station_id, mean_vol FROM means,
        (VALUES ('low_1', 1, 0, 0), ('low_2', 2, 0, 0), ('mid_1', 0, 1, 0), ('mid_2', 1, 1, 0),
                ('high_1', -1, 0, 1), ('high_2', 0, 0, 1)) AS v(slot, off, mid, last)
      WHERE pos = off + mid * (n // 2) + last * n)""", """examples AS (
      SELECT slot, station_id, date, vol_true, vol_pred, vol_base FROM test JOIN slots USING (station_id)
      WHERE date >= (SELECT max(date) FROM test) - 90)"""]


def neighbours() -> list[str]:
    """Every held-out row against every train row; stations are all known to the train rows."""
    stats = ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS d_{f}" for f in FEATURES)
    scaled = ", ".join(f"({f} - m_{f}) / d_{f} AS z_{f}" for f in FEATURES)
    d2 = " + ".join(f"(h.z_{f} - t.z_{f}) * (h.z_{f} - t.z_{f})" for f in FEATURES)
    means = ", ".join(
        f"""sum(w * ty) FILTER (WHERE place <= {k}) / sum(w) FILTER (WHERE place <= {k}) AS "KNN_k{k}_dist",
            avg(ty) FILTER (WHERE place <= {k}) AS "KNN_k{k}_uniform" """ for k in NEIGHBOURS
    )
    return [f"feature_stats AS (SELECT {stats} FROM complete WHERE split = 'train')",
            f"scaled AS (SELECT station_id, date, split, y, {scaled} FROM complete, feature_stats)", f"""pairs AS (
      SELECT h.station_id, h.date, h.split, h.y, t.y AS ty,
             {d2} + CASE WHEN h.station_id = t.station_id THEN 0 ELSE 2 END AS d2
      FROM scaled h, scaled t WHERE h.split <> 'train' AND t.split = 'train')""", """placed AS (
      SELECT *, row_number() OVER (PARTITION BY station_id, date ORDER BY d2, ty) AS place FROM pairs)""",
      """near AS (SELECT *, CASE WHEN min(d2) OVER (PARTITION BY station_id, date) = 0
                  THEN CASE WHEN d2 = 0 THEN 1.0 ELSE 0.0 END ELSE 1 / sqrt(d2) END AS w
      FROM placed WHERE place <= 100)""",
      f"knn AS (SELECT station_id, date, split, y, {means} FROM near GROUP BY 1, 2, 3, 4)"]


NEIGHBOURS = (10, 25, 50, 100)
KNN = [f"KNN_k{k}_{w}" for k in NEIGHBOURS for w in ("dist", "uniform")]
STATION_EFFECTS = ["""centres AS (
      SELECT station_id, avg(y_roll_mean_28) AS mx, avg(y) AS my FROM complete WHERE split = 'train' GROUP BY 1)""",
      """slope AS (SELECT sum((y_roll_mean_28 - mx) * (y - my)) / sum((y_roll_mean_28 - mx) * (y_roll_mean_28 - mx)) AS b
      FROM complete JOIN centres USING (station_id) WHERE split = 'train')""",
      """effects AS (SELECT split, station_id, y, my + b * (y_roll_mean_28 - mx) AS p
      FROM complete JOIN centres USING (station_id), slope)"""]


RIDGE = ["""sums AS (
      SELECT station_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy
      FROM (SELECT station_id, y, (y_roll_mean_28 - m) / d AS x FROM complete,
              (SELECT avg(y_roll_mean_28) AS m, stddev_pop(y_roll_mean_28) AS d FROM complete WHERE split = 'train')
            WHERE split = 'train') GROUP BY 1)""", """system AS (
      SELECT sum(sxx - sx * sx / (n + 1)) + 1 AS a, sum(sx - sx * n / (n + 1)) AS b, sum(n - n * n / (n + 1.0)) AS c,
             sum(sxy - sx * sy / (n + 1)) AS r1, sum(sy - n * sy / (n + 1)) AS r2 FROM sums)""", """solved AS (
      SELECT (r1 * c - r2 * b) / (a * c - b * b) AS w, (a * r2 - b * r1) / (a * c - b * b) AS w0 FROM system)""",
      """ridge AS (
      SELECT split, c.station_id, y, w0 + w * (y_roll_mean_28 - m) / d + (sy - w * sx - n * w0) / (n + 1) AS p
      FROM complete c JOIN sums USING (station_id), solved,
           (SELECT avg(y_roll_mean_28) AS m, stddev_pop(y_roll_mean_28) AS d FROM complete WHERE split = 'train'))"""]


HISTOGRAM = OT.boosted(FEATURES, 2, 12, 20, 1e-3, 0.05)


def fold_predictions(source: str, fold: str) -> list[str]:
    """The fold table of a model whose predictions stand in ``source`` (fold, station, date, p)."""
    return backtest("p", f"""folds JOIN complete ON date BETWEEN test_start AND test_end
      JOIN (SELECT {fold} AS fold, station_id, date, p FROM {source}) USING (fold, station_id, date)""")


def q(ctes: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


def oracle_sql() -> dict[str, str]:
    sd, fx4 = station_day(hourly()), panel() + COMPLETE
    lane_out = f"SELECT station_id, dir_of_travel, lane_of_travel, date, {r('lane_total')} FROM lanes"
    dir_out = f"SELECT station_id, date, dir_of_travel, {r('vol_dir')} FROM dir_day"
    base = fx4 + long_form(BASELINES)
    keys = "station_id, date"
    many = station_day(hourly("l_suppkey")) + eligible(0.0, 0)
    out = {
        "lane_totals": q(lanes(hourly()), lane_out),
        "lane_totals_text": q(lanes(text_hours()), lane_out + " WHERE station_id IS NOT NULL"),
        "direction_day": q(dir_day(hourly()), dir_out),
        "direction_day_text": q(dir_day(text_hours()), dir_out),
        "top_two_dirs": q(top_two(hourly(direction=THREE_DIRECTIONS)), "SELECT * FROM dirs"),
        "station_day": q(sd, f"SELECT {STATION_DAY_OUT} FROM station_day"),
        "station_day_text": q(station_day(text_hours()), f"SELECT {STATION_DAY_OUT} FROM station_day"),
        "direction_day_dates": q(dir_day(hourly()), dir_out),
        "station_day_loaded": q(sd, f"SELECT {STATION_DAY_OUT} FROM station_day"),
        "valid_day_flags": """SELECT written, CASE WHEN written IN ('False', '0', '0.0') THEN false ELSE true END AS valid_day,
            count(*) AS n_rows
            FROM (SELECT ['true', 'False', '1', '0', '', 'yes', 'n/a', '0.0'][l_orderkey % 8 + 1] AS written FROM lineitem)
            GROUP BY 1, 2""",
        "finite_values": f"""SELECT l_suppkey, n_rows, n_finite, {r("largest")} FROM (
            SELECT l_suppkey, count(*) AS n_rows, count(*) FILTER (WHERE l_discount <> 0) AS n_finite,
                   max(CASE WHEN l_discount <> 0 THEN CAST(l_quantity AS DOUBLE) / CAST(l_discount AS DOUBLE) END) AS largest
            FROM lineitem GROUP BY 1)""",
        "extra_trees_scores": q(fx4 + OT.extra_trees(FEATURES, 10, 40, 7) + long_form({"ExtraTrees_10_depth40": "p"}, "et"),
                                scores("", False)),
        "extra_trees_levels_scores": q(fx4 + OT.extra_trees(FEATURES, 3, 6, 7) + long_form({"ExtraTrees_3_depth6": "p"}, "et"),
                                       scores("", False)),
        "random_forest_scores": q(fx4 + OT.random_forest(FEATURES, 5, 20, 7, 2) + long_form({"RandomForest_5_depth20": "p"}, "et"),
                                  scores("", False)),
        "random_forest_levels_scores": q(fx4 + OT.random_forest(FEATURES, 2, 5, 7, 2) + long_form({"RandomForest_2_depth5": "p"}, "et"),
                                         scores("", False)),
        "backtest_extra_trees": q(
            fx4 + folds() + OT.extra_trees(FEATURES, 2, 10, 7, source=OT.FOLD_ROWS) + fold_predictions("et", "forest"),
            f"SELECT {BACKTEST_OUT} FROM backtest"),
        "hist_boosting_scores": q(fx4 + HISTOGRAM + long_form({"HGB_2_leaves12": "p"}, "hb"), scores("", False)),
        "hist_boosting_passes_scores": q(fx4 + HISTOGRAM + long_form({"HGB_2_leaves12_passes": "p"}, "hb"), scores("", False)),
        "gradient_boosting_scores": q(
            fx4 + OT.boosted(FEATURES, 2, 8, 1, 0.0, 0.05, 3, 0.8) + long_form({"GradientBoosting_2_depth3_sub0.8": "p"}, "hb"),
            scores("", False)),
        "lasso_scores": q(fx4 + OL.sweeps(0.01, 1.0) + long_form({"Lasso_a0.01": "p"}, "swept"), scores("", False)),
        "elastic_net_scores": q(fx4 + OL.sweeps(0.01, 0.5) + long_form({"ElasticNet_a0.01_l1r0.5": "p"}, "swept"),
                                scores("", False)),
        "huber_scores": q(fx4 + OL.huber(8) + long_form({"Huber_8_steps": "p"}, "hub"), scores("", False)),
        "backtest_ridge": q(fx4 + folds() + OL.fold_ridge(1.0) + fold_predictions("fold_fit", "fold"),
                            f"SELECT {BACKTEST_OUT} FROM backtest"),
        "ridge_scores": q(fx4 + RIDGE + long_form({"ridge": "p"}, "ridge"), scores("", False)),
        "comparison_ranked": q(base, f"""SELECT model, row_number() OVER (ORDER BY v) AS place, round(v, 6) AS "test_VOL_RMSE"
            FROM (SELECT 'BASELINE::' || model AS model, {rmse(volume("y"), volume("yhat"))} AS v FROM preds
                  WHERE split = 'test' GROUP BY 1)"""),
        "backtest_gap_fold": q(fx4 + folds() + backtest(), f"SELECT {BACKTEST_OUT} FROM backtest WHERE fold <> 3"),
        "ratio_to_baseline_weekly_many": q(many + RATIO, f"""SELECT week_ending,
            {r("median", "q25", "q75", "median_roll_std_13w")} FROM ratio_weekly"""),
        "system_weekly_many": q(many + SYSTEM, f"""SELECT week_ending, n_days, {r("total_volume", "active_stations",
            "vol_per_station", "vps_ma8", "stations_ma8")} FROM system_weekly"""),
        "station_day_three_dirs": q(station_day(hourly(direction=THREE_DIRECTIONS)),
                                    f"SELECT {STATION_DAY_OUT} FROM station_day"),
        "year_span": q(text_hours(), "SELECT min(year(date)) AS min_year, max(year(date)) AS max_year FROM hourly_lane"),
        "station_year_coverage": q(sd + COVERAGE, f"""SELECT station_id, year, valid_days, expected_days,
            {r("avg_volume", "cov")} FROM covered"""),
        "station_coverage": q(sd + COVERAGE, f"""SELECT station_id, years_present, {r("min_cov", "avg_cov", "avg_volume")}
            FROM (SELECT station_id, count(DISTINCT year) AS years_present, min(cov) AS min_cov, avg(cov) AS avg_cov,
                         avg(avg_volume) AS avg_volume FROM covered GROUP BY 1)"""),
        "eligibility_stats": q(sd + ELIGIBLE, f"SELECT {FLAGS_OUT} FROM flags"),
        "eligibility_stats_by_region": q(station_day(hourly(**BY_REGION)) + eligible(0.90, 730),
                                         f"SELECT {FLAGS_OUT} FROM flags"),
        "panel_grid": q(panel(), f"SELECT {keys}, {r('station_volume', 'y')} FROM filled"),
        "panel_lags": q(panel(), f"SELECT {keys}, {r('y', *LAGS)} FROM history WHERE y IS NOT NULL"),
        "panel_rolling": q(panel(), f"SELECT {keys}, {r('y', *ROLLS)} FROM history WHERE y IS NOT NULL"),
        "panel_calendar": q(panel(), f"""SELECT {keys}, dow, month, year, dayofyear, {r("sin_doy", "cos_doy")}
            FROM panel"""),
        "panel_flags": q(panel(), f"SELECT {keys}, {', '.join(HAS)} FROM panel"),
        "panel_features": q(panel(), f"""SELECT {keys}, dow, month, year, dayofyear, {', '.join(HAS)}, split,
            {r("station_volume", "y", "sin_doy", "cos_doy", *LAGS, *ROLLS)} FROM panel"""),
        "panel_split_counts": q(fx4, """SELECT p.split, count(*) AS n_rows, count(c.date) AS n_complete
            FROM panel p LEFT JOIN complete c ON c.station_id = p.station_id AND c.date = p.date GROUP BY 1"""),
        "baseline_scores": q(base, scores("", False)),
        "baseline_scores_volume": q(base, scores("VOL_", False)),
        "station_weighted_scores": q(base, scores("STW_", True)),
        "station_weighted_scores_volume": q(base, scores("STW_VOL_", True)),
        "baseline_comparison": q(base, comparison()),
        "dummy_mean_scores": q(fx4 + long_form(
            {"DummyMean": "(SELECT avg(y) FROM complete WHERE split = 'train')"}), scores("", False)),
        "ols_one_feature": q(fx4, f"""SELECT n_rows, {r("slope", "intercept", "r2")} FROM (
            SELECT count(*) AS n_rows, regr_slope(y, y_lag_7) AS slope, regr_intercept(y, y_lag_7) AS intercept,
                   regr_r2(y, y_lag_7) AS r2 FROM complete WHERE split = 'train')"""),
        "station_effects_scores": q(fx4 + STATION_EFFECTS + long_form({"station_effects": "p"}, "effects"),
                                    scores("", False)),
        "knn_exact": q(fx4 + neighbours(), f"SELECT {keys}, split, {r('y', *KNN)} FROM knn"),
        "knn_exact_scores": q(fx4 + neighbours() + long_form({n: f'"{n}"' for n in KNN}, "knn"), scores("", False)),
        "predictions_tidy": q(fx4 + tidy("complete"), f"""SELECT split, {keys},
            {r("y_true", "y_pred", "y_base", "vol_true", "vol_pred", "vol_base")} FROM predictions"""),
        "fold_schedule": q(fx4 + folds(), "SELECT fold, train_end, test_start, test_end FROM folds"),
        "backtest_baseline": q(fx4 + folds() + backtest(), f"SELECT {BACKTEST_OUT} FROM backtest"),
        "backtest_overlapping_folds": q(fx4 + folds(step=14) + backtest(), f"SELECT {BACKTEST_OUT} FROM backtest"),
        "backtest_summary": q(fx4 + folds() + backtest(), f"""SELECT n_folds, all_improved, volatile_fold, volatile_start,
            volatile_end, horizon_days, step_days, {r("mean_improve_pp", "median_improve_pp", "min_improve_pp",
                                                      "max_improve_pp", "y_upper")}
            FROM (SELECT count(*) AS n_folds, avg(vol_smape_improve_pp) AS mean_improve_pp,
              median(vol_smape_improve_pp) AS median_improve_pp, min(vol_smape_improve_pp) AS min_improve_pp,
              max(vol_smape_improve_pp) AS max_improve_pp, max(vol_smape_improve_pp) + 0.75 AS y_upper,
              bool_and(vol_smape_improve_pp > 0) AS all_improved FROM backtest),
             (SELECT fold AS volatile_fold, test_start AS volatile_start, test_end AS volatile_end FROM backtest
              ORDER BY vol_smape_base DESC, test_start LIMIT 1),
             (SELECT test_end - test_start + 1 AS horizon_days, next_start - test_start AS step_days
              FROM (SELECT *, lead(test_start) OVER (ORDER BY test_start) AS next_start FROM backtest)
              ORDER BY test_start LIMIT 1)"""),
        "ratio_to_baseline_weekly": q(sd + ELIGIBLE + RATIO, f"""SELECT week_ending,
            {r("median", "q25", "q75", "median_roll_std_13w")} FROM ratio_weekly"""),
        "week_quantiles_banded": q(many + RATIO[:2] + [f"""weekly_ratio AS (
            SELECT week_ending, count(*) AS n, {quantiles("ratio", median=0.5, q25=0.25, q75=0.75)} FROM ratios GROUP BY 1)"""],
            f"SELECT week_ending, n, {r('median', 'q25', 'q75')} FROM weekly_ratio"),
        "ratio_weekly_sketched": q(sd + ELIGIBLE + SKETCHED, f"""SELECT week_ending, n,
            {r("median", "q25", "q75", "median_roll_std_13w")} FROM ratio_weekly"""),
        "volatility_change": q(sd + ELIGIBLE + RATIO, f"""SELECT {r("pre_median", "post_median", "reduction_pct")}
            FROM (SELECT *, 100 * (1 - post_median / pre_median) AS reduction_pct FROM (
              SELECT median(median_roll_std_13w) FILTER (WHERE week_ending < {START}) AS pre_median,
                     median(median_roll_std_13w) FILTER (WHERE week_ending >= {START}) AS post_median
              FROM ratio_weekly))"""),
        "system_weekly": q(sd + ELIGIBLE + SYSTEM, f"""SELECT week_ending, n_days, {r("total_volume", "active_stations",
            "vol_per_station", "vps_ma8", "stations_ma8")} FROM system_weekly"""),
        "period_flags": q(sd + ELIGIBLE + SYSTEM, f"""SELECT first_week, last_week,
            first_week < {START} AND {START} < last_week AS show_marker, shade_start, shade_end,
            shade_start < shade_end AS do_shade
            FROM (SELECT *, greatest(DATE '1997-03-01', first_week) AS shade_start, least({START}, last_week) AS shade_end
              FROM (SELECT min(week_ending) AS first_week, max(week_ending) AS last_week FROM system_weekly))"""),
        "winsorized_ratio_bounds": q(sd + ELIGIBLE + WINSOR, f"SELECT {r('lo', 'hi')} FROM bounds"),
        "dow_profile": q(sd + ELIGIBLE + WINSOR, f"""SELECT dow, dow_name, {r("p25", "med", "p75")} FROM (
            SELECT dow, ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][dow + 1] AS dow_name,
                   {quantiles("mean_ratio", p25=0.25, med=0.5, p75=0.75)}
            FROM (SELECT station_id, dow, avg(ratio_w) AS mean_ratio FROM clipped GROUP BY 1, 2) GROUP BY 1, 2)"""),
        "weekpart_by_station": q(sd + ELIGIBLE + WINSOR + WEEKPARTS,
                                 f"SELECT station_id, {r('weekday_mean', 'weekend_mean')} FROM weekparts"),
        "weekpart_summary": q(sd + ELIGIBLE + WINSOR + WEEKPARTS, f"""SELECT weekpart, n,
            {r("q25", "med", "q75", "low", "mean", "high")} FROM (
            SELECT weekpart, count(*) AS n, {quantiles("m", q25=0.25, med=0.5, q75=0.75)}, min(m) AS low, avg(m) AS mean,
                   max(m) AS high
            FROM (SELECT 'weekday' AS weekpart, weekday_mean AS m FROM weekparts
                  UNION ALL SELECT 'weekend', weekend_mean FROM weekparts) GROUP BY 1)"""),
        "dow_profile_many": q(many + WINSOR, f"""SELECT dow, dow_name, {r("p25", "med", "p75")} FROM (
            SELECT dow, ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][dow + 1] AS dow_name,
                   {quantiles("mean_ratio", p25=0.25, med=0.5, p75=0.75)}
            FROM (SELECT station_id, dow, avg(ratio_w) AS mean_ratio FROM clipped GROUP BY 1, 2) GROUP BY 1, 2)"""),
        "weekpart_summary_many": q(many + WINSOR + WEEKPARTS, f"""SELECT weekpart, n,
            {r("q25", "med", "q75", "low", "mean", "high")} FROM (
            SELECT weekpart, count(*) AS n, {quantiles("m", q25=0.25, med=0.5, q75=0.75)}, min(m) AS low, avg(m) AS mean,
                   max(m) AS high
            FROM (SELECT 'weekday' AS weekpart, weekday_mean AS m FROM weekparts
                  UNION ALL SELECT 'weekend', weekend_mean FROM weekparts) GROUP BY 1)"""),
        "backtest_summary_stated": q(fx4 + folds() + backtest(), f"""SELECT n_folds, all_improved, volatile_fold, volatile_start,
            volatile_end, horizon_days, step_days, {r("mean_improve_pp", "median_improve_pp", "min_improve_pp",
                                                      "max_improve_pp", "y_upper")}
            FROM (SELECT count(*) AS n_folds, avg(vol_smape_improve_pp) AS mean_improve_pp,
              median(vol_smape_improve_pp) AS median_improve_pp, min(vol_smape_improve_pp) AS min_improve_pp,
              max(vol_smape_improve_pp) AS max_improve_pp, max(vol_smape_improve_pp) + 0.75 AS y_upper,
              bool_and(vol_smape_improve_pp > 0) AS all_improved FROM backtest),
             (SELECT fold AS volatile_fold, test_start AS volatile_start, test_end AS volatile_end FROM backtest
              ORDER BY vol_smape_base DESC, test_start LIMIT 1),
             (SELECT 21 AS horizon_days, 63 AS step_days
              FROM (SELECT *, lead(test_start) OVER (ORDER BY test_start) AS next_start FROM backtest)
              ORDER BY test_start LIMIT 1)"""),
        "station_improvement": q(IMPROVEMENT, f"""SELECT station_id,
            {r("smape_base", "smape_et", "mean_volume", "delta_smape_pp")} FROM improvement"""),
        "improvement_share": q(IMPROVEMENT, f"""SELECT n_stations, {r("improved_pct")} FROM (
            SELECT count(*) AS n_stations, 100.0 * avg(CASE WHEN delta_smape_pp > 0 THEN 1.0 ELSE 0.0 END) AS improved_pct
            FROM improvement)"""),
        "improvement_histogram": q(IMPROVEMENT, f"""SELECT bin, n_stations, {r("bin_from", "bin_to")} FROM (
            SELECT bin, n_stations, lo + (hi - lo) / 30 * (bin - 1) AS bin_from, lo + (hi - lo) / 30 * bin AS bin_to
            FROM (SELECT CAST(least(floor((delta_smape_pp - lo) / ((hi - lo) / 30)), 29) AS INTEGER) + 1 AS bin,
                         lo, hi, count(*) AS n_stations
                  FROM improvement, (SELECT min(delta_smape_pp) AS lo, max(delta_smape_pp) AS hi FROM improvement)
                  GROUP BY 1, 2, 3))"""),
        "improvement_tiers": q(TIERS, f"""SELECT station_id, tier, qbin,
            {r("smape_base", "smape_et", "mean_volume", "delta_smape_pp", "log_mean_vol")} FROM tiers"""),
        "improvement_trend": q(TIERS, f"""SELECT qbin, n, {r("logx", "q25", "med", "q75", "x")} FROM (
            SELECT *, pow(10, logx) AS x FROM (
              SELECT qbin, count(*) AS n, median(log_mean_vol) AS logx,
                     {quantiles("delta_smape_pp", q25=0.25, med=0.5, q75=0.75)} FROM tiers GROUP BY 1))"""),
        "tier_summary": q(TIERS, f"""SELECT tier, n, {r("q25", "med", "q75", "low", "high")} FROM (
            SELECT tier, count(*) AS n, {quantiles("delta_smape_pp", q25=0.25, med=0.5, q75=0.75)},
                   min(delta_smape_pp) AS low, max(delta_smape_pp) AS high FROM tiers GROUP BY 1)"""),
        "improvement_axis": q(IMPROVEMENT, f"""SELECT {r("y_min", "y_max")} FROM (
            SELECT least(min(delta_smape_pp), 0) - 0.5 AS y_min, greatest(max(delta_smape_pp), 0) + 0.5 AS y_max
            FROM improvement)"""),
        "example_stations": q(EXAMPLES, f"SELECT slot, station_id, {r('mean_vol')} FROM slots"),
        "example_forecasts": q(EXAMPLES, f"SELECT slot, {keys}, {r('vol_true', 'vol_pred', 'vol_base')} FROM examples"),
        "win_rate": q(EXAMPLES, f"""SELECT slot, station_id, n_days,
            {r("smape_base", "smape_et", "win_rate", "delta_smape_pp")} FROM (
            SELECT *, smape_base - smape_et AS delta_smape_pp FROM (
              SELECT slot, station_id, count(*) AS n_days, {smape("vol_true", "vol_base")} AS smape_base,
                     {smape("vol_true", "vol_pred")} AS smape_et,
                     avg(CASE WHEN 2.0 * abs(vol_pred - vol_true) / greatest(abs(vol_true) + abs(vol_pred), 1e-9)
                              < 2.0 * abs(vol_base - vol_true) / greatest(abs(vol_true) + abs(vol_base), 1e-9)
                         THEN 1.0 ELSE 0.0 END) AS win_rate
              FROM examples GROUP BY 1, 2))"""),
        "system_total_forecast_weekly": q(fx4 + tidy("complete"), f"""SELECT week_ending, n_days,
            {r("true_total", "pred_total", "base_total", "active_stations", "true_ma8", "pred_ma8", "base_ma8")} FROM (
            SELECT *, avg(true_total) OVER w AS true_ma8, avg(pred_total) OVER w AS pred_ma8, avg(base_total) OVER w AS base_ma8
            FROM (SELECT {WEEK} AS week_ending, sum(t) AS true_total, sum(p) AS pred_total, sum(b) AS base_total,
                         median(a) AS active_stations, count(*) AS n_days
                  FROM (SELECT date, sum(vol_true) AS t, sum(vol_pred) AS p, sum(vol_base) AS b,
                               count(DISTINCT station_id) AS a FROM predictions WHERE split = 'test' GROUP BY 1)
                  GROUP BY 1 HAVING count(*) >= 6)
            WINDOW w AS (ORDER BY week_ending ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))"""),
    }
    return out
