"""SQL twins of the linear models on one feature with an effect per station, for DuckDB.

Where the library solves piece by piece, the twins take many small steps, or write every step out.
"""

from __future__ import annotations

X = "y_roll_mean_28"
SCALED = [f"""line_scale AS (SELECT avg({X}) AS m, stddev_pop({X}) AS d FROM complete WHERE split = 'train')""",
          f"""line AS (SELECT c.*, ({X} - m) / d AS x FROM complete c, line_scale)"""]


def sweeps(alpha: float, l1_ratio: float, steps: int = 4000) -> list[str]:
    """``swept`` (station_id, date, split, y, p): block after block of the elastic net's objective, ``steps`` times."""
    a, b = f"({alpha * l1_ratio!r} * total)", f"({alpha * (1 - l1_ratio)!r} * total)"

    def effect(w: str, w0: str) -> str:
        r = f"(s.sy - s.n * {w0} - s.sx * {w})"
        return f"(sign({r}) * greatest(abs({r}) - {a}, 0) / (s.n + {b}))"

    def summed(term: str) -> str:
        return f"list_sum(list_transform(stations, lambda s: {term}))"

    pull = f"(txy - w0 * tx - {summed('s.sx * ' + effect('w', 'w0'))})"
    return SCALED + ["""line_sums AS (
      SELECT list(s) AS stations, sum(s.n) AS total, sum(s.sx) AS tx, sum(s.sy) AS ty, sum(s.sxx) AS txx, sum(s.sxy) AS txy FROM (
        SELECT {'station_id': station_id, 'n': count(*), 'sx': sum(x), 'sy': sum(y), 'sxx': sum(x * x), 'sxy': sum(x * y)} AS s
        FROM line WHERE split = 'train' GROUP BY station_id))""", f"""steps(step, w, w0) AS (
      SELECT 0, CAST(0 AS DOUBLE), ty / total FROM line_sums
      UNION ALL
      SELECT step + 1, w, (ty - w * tx - {summed('s.n * ' + effect('w', 'w0'))}) / total
      FROM (SELECT step, sign({pull}) * greatest(abs({pull}) - {a}, 0) / (txx + {b}) AS w, w0, line_sums.* FROM steps, line_sums
            WHERE step < {steps}))""", f"""swept AS (
      SELECT station_id, date, split, y, w0 + w * x + {effect('w', 'w0')} AS p
      FROM line JOIN (SELECT unnest(stations) AS s, total FROM line_sums) ON s.station_id = line.station_id,
           (SELECT w, w0 FROM steps WHERE step = {steps}))"""]


def weighted_ridge(name: str, source: str, penalty: str, keys: str = "") -> list[str]:
    """``{name}_sums`` and ``{name}_solved`` (w, w0) from rows with x, y and weight v; one model per value of ``keys``."""
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return [f"""{name}_sums AS MATERIALIZED (
      SELECT {k}station_id, sum(v) AS n, sum(v * x) AS sx, sum(v * y) AS sy, sum(v * x * x) AS sxx, sum(v * x * y) AS sxy
      FROM {source} GROUP BY {k}station_id)""", f"""{name}_solved AS MATERIALIZED (
      SELECT {k}pen, (r1 * c - r2 * b) / (a * c - b * b) AS w, (a * r2 - b * r1) / (a * c - b * b) AS w0 FROM (
        SELECT {k}any_value(pen) AS pen, sum(sxx - sx * sx / (n + pen)) + any_value(pen) AS a, sum(sx - sx * n / (n + pen)) AS b,
               sum(n - n * n / (n + pen)) AS c, sum(sxy - sx * sy / (n + pen)) AS r1, sum(sy - n * sy / (n + pen)) AS r2
        FROM {name}_sums, (SELECT {penalty} AS pen) {group}))"""]


def huber(steps: int, epsilon: float = 1.35, alpha: float = 1e-4) -> list[str]:
    """``hub`` (station_id, date, split, y, p) after so many reweighted ridges."""
    def fitted(name: str) -> str:
        return (f"SELECT l.station_id, date, split, l.y, x, w0 + w * x + (sy - w * sx - n * w0) / (n + pen) AS p "
                f"FROM line l JOIN {name}_sums USING (station_id), {name}_solved")

    out = SCALED + ["hub_rows_0 AS (SELECT *, 1.0 AS v FROM line WHERE split = 'train')"]
    out += weighted_ridge("hub_0", "hub_rows_0", repr(alpha))
    scale = "(SELECT sqrt(avg((y - p) * (y - p))) FROM hub_fit_0 WHERE split = 'train')"
    for k in range(steps):
        out += [f"hub_fit_{k} AS MATERIALIZED ({fitted(f'hub_{k}')})", f"hub_scale_{k} AS MATERIALIZED (SELECT {scale} AS s)",
                f"""hub_rows_{k + 1} AS MATERIALIZED (
          SELECT station_id, x, y, abs(y - p) AS r, s, CASE WHEN abs(y - p) <= {epsilon} * s THEN 1.0 ELSE {epsilon} * s / abs(y - p) END AS v
          FROM hub_fit_{k}, hub_scale_{k} WHERE split = 'train')"""]
        out += weighted_ridge(f"hub_{k + 1}", f"hub_rows_{k + 1}", f"(SELECT {alpha!r} * s FROM hub_scale_{k})")
        scale = f"""(SELECT sqrt(sum(r * r) FILTER (WHERE r <= {epsilon} * s)
                     / (count(*) - count(*) FILTER (WHERE r > {epsilon} * s) * {epsilon * epsilon!r})) FROM hub_rows_{k + 1})"""
    return out + [f"hub AS ({fitted(f'hub_{steps}')})"]


def fold_ridge(alpha: float) -> list[str]:
    """``fold_fit`` (fold, station_id, date, p): a ridge of every fold on all rows before it."""
    return [f"""fold_rows AS (
      SELECT fold, station_id, {X} AS x, y, 1.0 AS v FROM folds JOIN complete ON date < test_start)"""] + weighted_ridge(
        "fold", "fold_rows", repr(alpha), "fold") + [f"""fold_fit AS (
      SELECT fold, c.station_id, c.date, w0 + w * {X} + coalesce((sy - w * sx - n * w0) / (n + pen), 0) AS p
      FROM folds JOIN complete c ON date BETWEEN test_start AND test_end JOIN fold_solved USING (fold)
      LEFT JOIN fold_sums USING (fold, station_id))"""]
