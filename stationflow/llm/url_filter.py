"""URL filter: domain rules first, then a weighted vocabulary found by one Aho-Corasick pass.

The url is cut into host and path with built-in functions and held against the rules (longest
fitting rule wins). Urls that no rule decides are judged by the vocabulary: a term counts if the
characters around it are neither letters a-z nor digits; one strict term, or ``min_soft`` distinct
soft terms, block the page.

Defined cases: a null url, or one without ``://``, has an empty host and path (a null url holds no
term, any other text is searched whole). Repeated rows are judged one by one. Columns of the input
other than ``url`` pass through; the five added columns replace columns of the same name. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Domain rules (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

# A page is blocked by any one of these.
STRICT = (
    "adult", "camgirls", "casino", "casinos", "escort", "escorts", "gambling", "hentai", "jackpot", "milf",
    "nude", "nudes", "payday-loan", "payday-loans", "porn", "porno", "replica-watches", "sex", "slots", "viagra",
    "warez", "xxx",
)
# A page is blocked by several different ones of these.
SOFT = (
    "ads", "bet", "bets", "betting", "bonus", "cams", "cheap", "cialis", "coupon", "crack", "crypto", "dating", "deal",
    "deals", "discount", "download", "farm", "free", "girls", "hot", "keygen", "loan", "loans", "lottery",
    "pharmacy", "pills", "poker", "prize", "promo", "singles", "spam", "spin", "torrent", "torrents", "track",
    "tracker", "video", "videos", "win", "winner",
)
MIN_SOFT = 2
MOST_TERMS = 200_000  # of a vocabulary read from a table: it goes to every task as one automaton


def vocabulary_of(table: DataFrame, term: str = "term", weight: str = "weight", most: int = MOST_TERMS) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Strict terms (a weight of one or more) and soft terms (a weight below) of a table, A-Z lower-cased, in order.

    Terms without a weight above zero say nothing and are left out; a term listed twice has its larger weight.
    """
    rows = table.select(F.translate(term, UPPER, LOWER).alias("term"), F.col(weight).cast("double").alias("weight"))
    rows = rows.where("term <> '' AND weight > 0").groupBy("term").agg(F.max("weight").alias("weight")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the vocabulary has more than {most} terms")
    return tuple(tuple(sorted(r["term"] for r in rows if (r["weight"] >= 1) == strict)) for strict in (True, False))


def host_of(url: Column) -> Column:
    rest = _after_scheme(url)
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = _after_scheme(url)
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_columns(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits; both null where none does."""
    name = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest comes last and so outermost
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


@lru_cache(maxsize=8)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term in soft:
        found.add_word(term, (len(term), term, False))
    for term in strict:
        found.add_word(term, (len(term), term, True))
    found.make_automaton()
    return found


_PLAIN = re.compile("[a-z0-9]")


def term_hits(text: str, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[int, int]:
    """Numbers of distinct strict and distinct soft terms in ``text`` (lower case), on boundaries."""
    hits: tuple[set, set] = (set(), set())
    for last, (size, term, is_strict) in _automaton(strict, soft).iter(text):
        before, after = text[last - size:last - size + 1] if last >= size else "", text[last + 1:last + 2]
        if not _PLAIN.match(before) and not _PLAIN.match(after):
            hits[0 if is_strict else 1].add(term)
    return len(hits[0]), len(hits[1])


def vocabulary_hits(text: Column, strict: Iterable[str] = STRICT, soft: Iterable[str] = SOFT) -> Column:
    """struct(strict, soft): distinct terms of either kind in a column of lower-case text."""
    strict, soft = tuple(strict), tuple(soft)

    @pandas_udf("strict int, soft int")
    def hits(texts: pd.Series) -> pd.DataFrame:
        rows = [term_hits(t, strict, soft) if t else (0, 0) for t in texts]
        return pd.DataFrame(rows, columns=["strict", "soft"], dtype="int32")

    return hits(text)


def judge_urls(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, min_soft: int = MIN_SOFT) -> DataFrame:
    """``pages`` with host, path, rule, hits (distinct strict and soft terms) and verdict."""
    url = F.coalesce("url", F.lit(""))
    pages = pages.withColumns({"host": host_of(url), "path": path_of(url)})
    name, said = rule_columns(F.col("host"), F.col("path"), rules)
    pages = pages.withColumns({"rule": name, "hits": vocabulary_hits(F.translate(url, UPPER, LOWER), strict, soft)})
    by_terms = F.when((F.col("hits.strict") >= 1) | (F.col("hits.soft") >= min_soft), "block").otherwise("allow")
    return pages.withColumn("verdict", F.coalesce(said, by_terms))


def oracle(rules=RULES, strict=STRICT, soft=SOFT, min_soft: int = MIN_SOFT) -> str:
    """The same over ``pages`` in DuckDB SQL, with a pattern per term in place of the automaton."""
    def listed(terms):
        return "[" + ", ".join(f"'{t}'" for t in terms) + "]"

    def found(terms):
        return (f"len(list_filter({listed(terms)}, lambda t: regexp_matches(low, "
                "'(^|[^a-z0-9])' || t || '([^a-z0-9]|$)')))")

    order = sorted(rules, key=lambda r: (len(r[1] + r[2]), r), reverse=True)
    when = {k: " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{out}'"
        for said, h, p in order for out in [h + p if k == "rule" else said]) for k in ("rule", "verdict")}
    low = f"translate(coalesce(url, ''), '{UPPER}', '{LOWER}')"
    return f"""
WITH cut AS (
  SELECT page_id, {low} AS low,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut)
SELECT page_id, host, path, CASE {when['rule']} END AS rule,
       CASE {when['verdict']} WHEN {found(strict)} >= 1 OR {found(soft)} >= {min_soft} THEN 'block'
            ELSE 'allow' END AS verdict
FROM parts"""
