"""SQL twins of the tree models, for DuckDB: levels and rounds are written out one after the other.

Few trees, few levels, few leaves: what the twin spells out is the rule by which a tree grows.
"""

from __future__ import annotations

import math

PRIME = (1 << 31) - 1


def drawn(tree: str, node: str, feature: str, seed: int, source: str) -> str:
    """``source`` with the column h: the draw of a node and feature."""
    steps = [f"({node} % {PRIME} * 48271 + {tree} * 69621 + ({feature} + 1) * 16807 + {seed} * 40692 + 1) % {PRIME}"]
    for step in (11, 29, 53):
        steps += [f"(h * 48271 + {step}) % {PRIME}", f"(h * h + 3 * h + {step}) % {PRIME}"]
    query = f"SELECT *, CAST({steps[0]} AS BIGINT) AS h FROM {source}"
    for step in steps[1:]:
        query = f"SELECT * REPLACE ({step} AS h) FROM ({query})"
    return query


SPLIT_ROWS = "(SELECT *, 0 AS forest, CAST(split = 'train' AS INTEGER) AS w FROM complete)"
# every fold has its own train rows, all rows before its test period
FOLD_ROWS = """(
      SELECT c.*, fold AS forest, 1 AS w FROM complete c JOIN folds ON date < test_start
      UNION ALL SELECT c.*, fold, 0 FROM complete c JOIN folds ON date BETWEEN test_start AND test_end)"""


def tree_rows(features: list[str], source: str) -> list[str]:
    x = ", ".join(f"CAST(CAST({f} AS FLOAT) AS DOUBLE)" for f in features)
    return [f"""tree_rows AS (
      SELECT forest, station_id AS station, date, split, y, w, station_id * 100000 + (date - DATE '1970-01-01') AS number,
             CAST(round(y * 1000000) AS BIGINT) AS yq, [{x}] AS x FROM {source})"""]


def edges_of(features: list[str]) -> list[str]:
    """``edges`` (f, e): the distinct quantiles of each feature of the train rows, rising."""
    marks = ", ".join(f"{k / 255!r}e0" for k in range(1, 255))  # the exponent makes them doubles
    return ["edges AS MATERIALIZED (" + " UNION ALL ".join(
        f"""SELECT {f} AS f, list_sort(list_distinct(list_transform([{marks}],
              lambda p: v[CAST(greatest(1, ceil(p * len(v))) AS BIGINT)]))) AS e
            FROM (SELECT list(x[{f + 1}] ORDER BY x[{f + 1}]) AS v FROM tree_rows WHERE w = 1)""" for f in range(len(features))) + ")"]


def random_forest(features: list[str], trees: int, deepest: int, seed: int, min_leaf: int) -> list[str]:
    """``et`` as in ``extra_trees``, with Poisson draws of rows and the best edge of every feature."""
    chances, total = [], 0.0
    for k in range(11):
        total += math.exp(-1) / math.factorial(k)
        chances.append(total)
    times = " + ".join(f"CAST(u >= {c!r} AS INTEGER)" for c in chances)
    binned = ", ".join(f"len(list_filter((SELECT e FROM edges WHERE f = {f}), lambda c: c < x[{f + 1}])) + 0.0" for f in range(len(features)))
    drawn_rows = f"""(SELECT * EXCLUDE (h, t), CAST(t AS BIGINT) AS tree, CAST(h AS DOUBLE) / {PRIME}.0 AS u FROM ({
        drawn("t", "number", "200", seed, f"(SELECT * FROM tree_rows, range({trees}) AS g(t))")}))"""
    start = [f"""et_0 AS MATERIALIZED (
      SELECT * REPLACE ([{binned}] AS x, CASE WHEN w = 1 THEN {times} ELSE 0 END AS w) FROM (
        SELECT *, w AS trains, CAST(1 AS BIGINT) AS node FROM {drawn_rows})
      WHERE w = 0 OR {times} > 0)"""]
    return tree_rows(features, SPLIT_ROWS) + edges_of(features) + grown(features, start, deepest, seed, min_leaf, best=True)


def extra_trees(features: list[str], trees: int, deepest: int, seed: int, min_leaf: int = 1, source: str = SPLIT_ROWS) -> list[str]:
    """``et`` (forest, station_id, date, split, y, p): mean over trees of the leaf that a held-out row ends in."""
    start = [f"""et_0 AS (
      SELECT r.*, CAST(t AS BIGINT) AS tree, CAST(1 AS BIGINT) AS node, w AS trains FROM tree_rows r, range({trees}) AS g(t))"""]
    return tree_rows(features, source) + grown(features, start, deepest, seed, min_leaf)


def grown(features: list[str], start: list[str], deepest: int, seed: int, min_leaf: int, best: bool = False) -> list[str]:
    out = list(start)
    gain = """CAST(sl AS DOUBLE) * CAST(sl AS DOUBLE) / CAST(nl AS DOUBLE)
              + CAST(s - sl AS DOUBLE) * CAST(s - sl AS DOUBLE) / CAST(n - nl AS DOUBLE)"""
    done = []
    for d in range(deepest + 1):
        out.append(f"""et_nodes_{d} AS MATERIALIZED (
          SELECT forest, tree, node, sum(w) AS n, sum(w * yq) AS s, min(yq) < max(yq) AS mixes FROM et_{d} WHERE trains = 1 GROUP BY 1, 2, 3)""")
        value = "CAST(n.s AS DOUBLE) / CAST(n.n AS DOUBLE) / 1000000"
        if d == deepest:
            done.append(f"SELECT forest, station, date, split, y, {value} AS v FROM et_{d} JOIN et_nodes_{d} n USING (forest, tree, node) WHERE trains = 0")
            break
        one = f"""SELECT forest, tree, node, f, cut, CAST(NULL AS BIGINT) AS chosen, sum(w) AS nl, sum(w * yq) AS sl
          FROM et_long_{d} JOIN et_cuts_{d} USING (forest, tree, node, f) WHERE v <= cut GROUP BY 1, 2, 3, 4, 5"""
        every = f"""SELECT forest, tree, node, f, v AS cut, CAST(NULL AS BIGINT) AS chosen,
                 sum(n) OVER upto AS nl, sum(s) OVER upto AS sl
          FROM (SELECT forest, tree, node, f, v, sum(w) AS n, sum(w * yq) AS s FROM et_long_{d} GROUP BY 1, 2, 3, 4, 5)
          WINDOW upto AS (PARTITION BY forest, tree, node, f ORDER BY v)"""
        out += [f"""et_long_{d} AS (
          SELECT forest, tree, node, w, yq, unnest(range({len(features)})) AS f, unnest(x) AS v FROM et_{d} WHERE trains = 1)""", f"""et_cuts_{d} AS MATERIALIZED (
          SELECT forest, tree, node, f, low + CAST(h AS DOUBLE) / {PRIME}.0 * (high - low) AS cut
          FROM ({drawn("tree", "node", "f", seed, f'''(
            SELECT forest, tree, node, f, min(v) AS low, max(v) AS high FROM et_long_{d} GROUP BY 1, 2, 3, 4 HAVING min(v) < max(v))''')}))""",
          f"""et_tried_{d} AS (
          {every if best else one}
          UNION ALL
          SELECT forest, tree, node, 1000, NULL, station, sum(w), sum(w * yq) FROM et_{d} WHERE trains = 1 GROUP BY 1, 2, 3, station)""",
          f"""et_best_{d} AS MATERIALIZED (
          SELECT * FROM (
            SELECT forest, tree, node, f, cut, chosen,
                   row_number() OVER (PARTITION BY forest, tree, node ORDER BY {gain} DESC, f, cut, chosen) AS place
            FROM et_tried_{d} JOIN et_nodes_{d} USING (forest, tree, node)
            WHERE mixes AND n >= {2 * min_leaf} AND nl >= {min_leaf} AND n - nl >= {min_leaf})
          WHERE place = 1)""", f"""et_{d + 1} AS MATERIALIZED (
          SELECT forest, e.station, date, split, y, w, trains, yq, x, tree,
                 2 * node + CASE WHEN f < 1000 AND x[f + 1] <= cut OR f = 1000 AND e.station = chosen THEN 0 ELSE 1 END AS node
          FROM et_{d} e JOIN et_best_{d} b USING (forest, tree, node))"""]
        done.append(f"""SELECT forest, station, date, split, y, {value} AS v FROM et_{d} JOIN et_nodes_{d} n USING (forest, tree, node)
          ANTI JOIN et_best_{d} USING (forest, tree, node) WHERE trains = 0""")
    return out + [f"et_leaves AS ({' UNION ALL '.join(done)})",
                  "et AS (SELECT forest, station AS station_id, date, split, y, avg(v) AS p FROM et_leaves GROUP BY 1, 2, 3, 4, 5)"]


def boosted(features: list[str], rounds: int, leaves: int, min_leaf: int, l2: float, rate: float, deepest: int = 62,
            subsample: float = 1.0, seed: int = 7) -> list[str]:
    """``hb`` (station, date, split, y, p) after a few rounds, one split of the best leaf at a time."""
    out = tree_rows(features, SPLIT_ROWS) + edges_of(features) + ["""hb_p0 AS (
      SELECT *, (SELECT avg(y) FROM tree_rows WHERE w = 1) AS p FROM tree_rows)"""]
    gain = f"""sl * sl / (nl + {l2!r}) + (s - sl) * (s - sl) / (n - nl + {l2!r}) - s * s / (n + {l2!r})"""
    for k in range(rounds):
        # rows of a round: those whose hash of their number and the round's is low enough
        steps = f"SELECT *, CAST((number % {PRIME} * 48271 + {k} * 69621 + {seed} * 40692 + 1) % {PRIME} AS BIGINT) AS h FROM hb_p{k}"
        for step in (11, 29, 53):
            steps = f"SELECT * REPLACE ((h * 48271 + {step}) % {PRIME} AS h) FROM ({steps})"
            steps = f"SELECT * REPLACE ((h * h + 3 * h + {step}) % {PRIME} AS h) FROM ({steps})"
        out.append(f"""hb_{k}_0 AS MATERIALIZED (
          SELECT * EXCLUDE (h), CAST(round((y - p) * 1000000) AS BIGINT) AS q, 0 AS node, 0 AS depth,
                 CASE WHEN w = 1 AND CAST(h AS DOUBLE) / {PRIME}.0 < {subsample!r} THEN 1 ELSE 0 END AS u FROM ({steps}))""")
        for step in range(leaves - 1):
            at = f"hb_{k}_{step}"
            out += [f"""{at}_cells AS MATERIALIZED (
              SELECT node, f, edge, CAST(NULL AS BIGINT) AS chosen, count(*) AS n, sum(q) AS s FROM (
                SELECT node, q, f, len(list_filter(e, lambda c: c < v)) + 1 AS edge FROM (
                  SELECT node, q, unnest(range({len(features)})) AS f, unnest(x) AS v FROM {at} WHERE u = 1) JOIN edges USING (f))
              GROUP BY 1, 2, 3
              UNION ALL SELECT node, 1000, 0, station, count(*), sum(q) FROM {at} WHERE u = 1 GROUP BY node, station)""",
              f"""{at}_sums AS (
              SELECT node, any_value(depth) AS depth, CAST(count(*) AS DOUBLE) AS n, CAST(sum(q) AS DOUBLE) AS s
              FROM {at} WHERE u = 1 GROUP BY 1)""", f"""{at}_tried AS (
              SELECT node, f, edge, chosen,
                     CAST(CASE WHEN f < 1000 THEN sum(n) OVER upto ELSE n END AS DOUBLE) AS nl,
                     CAST(CASE WHEN f < 1000 THEN sum(s) OVER upto ELSE s END AS DOUBLE) AS sl
              FROM {at}_cells WINDOW upto AS (PARTITION BY node, f ORDER BY edge))""", f"""{at}_best AS MATERIALIZED (
              SELECT node, f, chosen, e[edge] AS cut FROM (
                SELECT node, f, edge, chosen, {gain} AS gain FROM {at}_tried JOIN {at}_sums USING (node)
                WHERE nl >= {min_leaf} AND n - nl >= {min_leaf} AND n >= {2 * min_leaf} AND depth < {deepest})
              LEFT JOIN edges USING (f) WHERE gain > 0 ORDER BY gain DESC, node, f, edge, chosen LIMIT 1)""",
              f"""hb_{k}_{step + 1} AS MATERIALIZED (
              SELECT a.* REPLACE (
                CASE WHEN b.node IS NULL THEN a.node
                     WHEN f < 1000 AND x[f + 1] <= cut OR f = 1000 AND station = chosen THEN {2 * step + 1} ELSE {2 * step + 2} END AS node,
                CASE WHEN b.node IS NULL THEN depth ELSE depth + 1 END AS depth)
              FROM {at} a LEFT JOIN {at}_best b ON a.node = b.node)"""]
        last = f"hb_{k}_{leaves - 1}"
        out.append(f"""hb_p{k + 1} AS MATERIALIZED (
          SELECT r.* EXCLUDE (q, node, depth, u) REPLACE (p + {rate!r} * (CAST(v.s AS DOUBLE) / 1000000) / (v.n + {l2!r}) AS p)
          FROM {last} r JOIN (SELECT node, sum(q) AS s, count(*) AS n FROM {last} WHERE u = 1 GROUP BY 1) v USING (node))""")
    return out + [f"hb AS (SELECT station AS station_id, date, split, y, p FROM hb_p{rounds} WHERE w = 0)"]
