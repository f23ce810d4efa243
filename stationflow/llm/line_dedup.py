"""Repeated and nearly repeated lines, by a join of deletion neighbourhoods. DataFrame functions only.

Lines are compared by their words (cut at ASCII white space, A-Z in lower case); the edit distance
counts words put in, left out or replaced, and the bound is one. A line is removed if an earlier line
(by doc_id, digest of the text, line number) is equal, or has a distance of one and both lines have
``min_words`` words or more (five: one edit in five words leaves a similarity of 0.8).

* Equal lines meet by digest. Everything below works on one row per distinct line.
* Two lines one edit apart share their first or their last half, to the word. Lines whose halves occur
  nowhere else have no partner and emit nothing. This drops no pair.
* The others emit their deletion neighbourhood as hashed keys: the line without word i, for each i in
  the half that may differ. Two lines that agree without their i-th words differ by a replacement; a
  line that agrees with another one less a word differs by an insertion. A key is built from running
  exclusive ors of hashes of (word, place), so a line of any length costs a few numbers per word.
* Each key knows its earliest line, and each line takes the earliest that its keys know: no pair of a
  group is ever listed. Words of the line and of its choice are then compared, so that no line is
  removed for a collision of hashes.

Minima are combined before every shuffle, and a digest or key is one row after it; where the minima go back to the
lines, a line that very many documents hold is split. The largest group of rows that meets is the words of one line.

Defined cases: null and empty texts have no lines, and blank lines are never removed; rows equal in
doc_id and text count as one document; a null doc_id ranks first; "earlier" counts lines that are
removed themselves; an empty table gives an empty result. ``removed_lines`` reads doc_id and text
only; ``deduplicated`` keeps all columns (``n_chars``, where present, follows the new text; null
texts stay null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stationflow.lineage import staged
from stationflow.llm.spread import join_spread

MIN_WORDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = "\t\x0b\x0c\r"  # beside the space; lines end at the line feed
LINE = ["h1", "h2"]  # 128 bits that stand for a distinct line
SWAP, LESS, WHOLE = 0, 1, 2  # kinds of keys: less a word at its place, less a word, the line itself
# Up to so many digests (16 bytes each) of lines that share a half go to all tasks, so that the text of
# all other lines stays where it is; beyond it both sides are shuffled.
BROADCAST_LINES = 400_000


def _text_lines(docs: DataFrame) -> DataFrame:
    lines = docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("low", F.translate("line", UPPER + WHITE, LOWER + " " * len(WHITE)))
    # explode keeps filters on the words from splitting again
    return lines.select("doc_id", "text_hash", "line_no", "low", F.explode(F.array(_words(F.col("low")))).alias("words")).where(
        F.size("words") > 0)


def _words(low: Column) -> Column:
    """One character to split at is much cheaper than a pattern."""
    return F.array_remove(F.split(low, " "), "")


def _digests(words: Column) -> list[Column]:
    return [F.xxhash64(F.lit(k), words).alias(h) for k, h in enumerate(LINE)]


def _halves() -> Column:
    """Hashes of the first and last n/2 words, and of as many as a line of one word less would have."""
    def ends(take: Column) -> list[Column]:
        return [
            F.xxhash64(F.lit("first"), take, F.slice("words", 1, take)),
            F.xxhash64(F.lit("last"), take, F.slice("words", F.col("n") - take + 1, take)),
        ]

    half, less = F.floor(F.col("n") / 2).cast("int"), F.floor((F.col("n") - 1) / 2).cast("int")
    # a line of an odd number of words has one size of half
    return F.when(F.col("n") % 2 == 1, F.array(*ends(half))).otherwise(F.array(*ends(half), *ends(less)))


def _partners(distinct: DataFrame) -> DataFrame:
    """h1, h2, head, tail of lines that share a half with another line; head: a first half is shared."""
    halves = distinct.select(*LINE, F.posexplode("halves").alias("place", "half"))
    halves = halves.select(*LINE, "half", (F.col("place") % 2 == 0).alias("is_first"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high")
    found = halves.join(shared.select("half"), "half")
    return found.groupBy(*LINE).agg(F.max("is_first").alias("head"), F.max(~F.col("is_first")).alias("tail"))


def _keys(lines: DataFrame) -> DataFrame:
    """line (h1, h2), kind and key of the deletion neighbourhoods of lines (h1, h2, words, head, tail)."""
    words = lines.select(
        *LINE, F.size("words").alias("n"), (F.col("head").cast("int") + 2 * F.col("tail").cast("int")).alias("sides"),
        F.posexplode("words").alias("i", "word"))
    words = words.select(
        *LINE, "n", "sides", "i", F.xxhash64("word", "i").alias("here"), F.xxhash64("word", F.col("i") - 1).alias("moved"))
    whole = Window.partitionBy(*LINE).orderBy("i")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    until = whole.rowsBetween(Window.unboundedPreceding, 0)
    full = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.coalesce(F.bit_xor("here").over(before), F.lit(0))
    right = F.bit_xor("moved").over(full).bitwiseXOR(F.bit_xor("moved").over(until))
    less = words.select(
        *LINE, "n", "sides", "i", left.bitwiseXOR(right).alias("less"), F.bit_xor("here").over(full).alias("all"))
    half = F.floor(F.col("n") / 2)
    # behind a shared first half, or before a shared last half; one word of slack for lines of one word less
    open_ = (F.col("sides").bitwiseAND(F.lit(1)) > 0) & (F.col("i") >= half - 1)
    open_ = open_ | ((F.col("sides") >= 2) & (F.col("i") <= F.col("n") - half))
    size, fewer = F.col("n"), F.col("n") - 1

    def entry(kind: int, key: Column) -> Column:
        return F.struct(F.lit(kind).cast("byte").alias("kind"), key.alias("key"))

    made = F.array(
        F.when(open_, entry(SWAP, F.xxhash64(F.lit("swap"), size, "i", "less"))),
        F.when(open_, entry(LESS, F.xxhash64(F.lit("whole"), fewer, "less"))),
        F.when(F.col("i") == 0, entry(WHOLE, F.xxhash64(F.lit("whole"), size, "all"))),
    )
    return less.select(*LINE, F.explode(F.array_compact(made)).alias("m")).select(*LINE, "m.*")


def _within_one(a: Column, b: Column) -> Column:
    """Two arrays of words are at most one edit apart (equal arrays too): what follows the first
    difference is equal, less the word that differs."""
    short = F.least(F.size(a), F.size(b))
    differ = F.array_position(F.zip_with(F.slice(a, 1, short), F.slice(b, 1, short), lambda x, y: x == y), False)
    at = F.when(differ > 0, differ).otherwise(short + 1).cast("int")

    def rest(words: Column, skip: Column) -> Column:
        return F.slice(words, at + skip, F.greatest(F.size(words), F.lit(1)))

    more_a, more_b = (F.size(a) >= F.size(b)).cast("int"), (F.size(b) >= F.size(a)).cast("int")
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (rest(a, more_a) == rest(b, more_b))


def _near(distinct: DataFrame, all_lines: DataFrame, min_words: int) -> DataFrame:
    """h1, h2, near: the earliest line one edit away, for lines that have one earlier than themselves."""
    partners = staged(_partners(distinct.where(F.col("n") >= min_words)))
    text = all_lines.where("low IS NOT NULL").select(*LINE, "low")
    few = partners.count() <= BROADCAST_LINES
    text = text.join(F.broadcast(partners) if few else partners, LINE).dropDuplicates(LINE)
    text = text.select(*LINE, _words(F.col("low")).alias("words"), "head", "tail")
    lines = staged(text.join(distinct.select(*LINE, "first"), LINE))
    keys = staged(_keys(lines))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1").select("key")
    # only keys that lines share are worth the place of their lines
    met = staged(keys.join(shared, "key").join(lines.select(*LINE, "first"), LINE))
    early = met.groupBy("key").agg(
        F.min(F.when(F.col("kind") != LESS, F.col("first"))).alias("level"),
        F.min(F.when(F.col("kind") == LESS, F.col("first"))).alias("above"))
    partner = F.when(F.col("kind") == WHOLE, F.col("above")).otherwise(F.col("level"))
    met = met.join(early, "key").withColumn("near", partner).where(F.col("near") < F.col("first"))
    best = met.groupBy(*LINE).agg(F.min("near").alias("near"))
    mine = lines.select(*LINE, "words").join(best, LINE)
    theirs = lines.select(F.col("first").alias("near"), F.col("words").alias("other"))
    return mine.join(theirs, "near").where(_within_one(F.col("words"), F.col("other"))).select(*LINE, "near")


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, line_no, first_doc_id, first_line_no, exact for every line that goes.

    ``first_*`` name the earliest line that is equal (exact) or one edit away.
    """
    docs = docs.select("doc_id", "text")
    words = F.col("words")
    lines = _text_lines(docs).withColumn("n", F.size("words"))
    lines = staged(lines.select(
        "doc_id", "text_hash", "line_no", *_digests(words), "n", F.when(F.col("n") >= min_words, _halves()).alias("halves"),
        F.when(F.col("n") >= min_words, F.col("low")).alias("low")))
    rank = F.struct("doc_id", "text_hash", "line_no")
    distinct = staged(lines.groupBy(*LINE).agg(
        F.min(rank).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("halves").alias("halves")))
    near = _near(distinct, lines, min_words)
    early = staged(distinct.select(*LINE, "first", "copies").join(near, LINE, "left").where("copies > 1 OR near IS NOT NULL"))
    found = join_spread(lines.select("doc_id", "text_hash", "line_no", *LINE), early, LINE, F.col("copies"),
                        F.xxhash64("doc_id", "line_no"))
    best = F.least("first", F.coalesce("near", "first"))
    found = found.withColumns({"best": best, "exact": F.col("near").isNull()}).where(rank > F.col("best"))
    return found.select(
        "doc_id", "text_hash", "line_no", F.col("best.doc_id").alias("first_doc_id"),
        F.col("best.line_no").alias("first_line_no"), "exact").distinct()


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the lines of ``removed_lines``; every row stays."""
    gone = removed_lines(docs, min_words).groupBy(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_list("line_no").alias("__gone"))
    found = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left")
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.element_at(lines, i + 1)), "\n"))
    found = found.withColumn("text", text).drop("__id", "__hash", "__gone")
    return found.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else found


def oracle(min_words: int = MIN_WORDS) -> str:
    """``removed_lines`` over ``documents`` in DuckDB SQL (doc_id is unique there)."""
    return rf"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents),
lines AS (
  SELECT doc_id, line_no, list_filter(
    string_split_regex(translate(line, '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM cut),
kept AS (SELECT doc_id, line_no, words, len(words) AS n, doc_id * 1000000 + line_no AS place FROM lines WHERE len(words) > 0),
diff AS (SELECT words, any_value(n) AS n, min(place) AS first FROM kept GROUP BY words),
less AS (
  SELECT first, n, i, list_concat(words[1:i - 1], words[i + 1:n]) AS rest
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM diff WHERE n >= {min_words})),
pairs AS (
  SELECT a.first, b.first AS near
  FROM less a JOIN (SELECT n, i, rest, min(first) AS first FROM less GROUP BY ALL) b USING (n, i, rest) WHERE b.first < a.first
  UNION ALL SELECT a.first, b.first FROM less a JOIN diff b ON a.rest = b.words WHERE b.n >= {min_words} AND b.first < a.first
  UNION ALL SELECT a.first, b.first FROM diff a JOIN less b ON b.rest = a.words WHERE a.n >= {min_words} AND b.first < a.first),
near AS (SELECT first, min(near) AS near FROM pairs GROUP BY first),
found AS (
  SELECT k.doc_id, k.line_no, k.place, least(d.first, coalesce(p.near, d.first)) AS best, p.near IS NULL AS exact
  FROM kept k JOIN diff d USING (words) LEFT JOIN near p ON p.first = d.first)
SELECT doc_id, line_no::INTEGER AS line_no, best // 1000000 AS first_doc_id, (best % 1000000)::INTEGER AS first_line_no, exact
FROM found WHERE place > best"""
