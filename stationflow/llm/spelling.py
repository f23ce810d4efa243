"""Spelling variant grouping: words one edit apart, found by a frontier of states that walks a trie by joins.

The trie is a distributed edge table: a node is the hash of a prefix, an edge carries the next
characters, and the edge that ends a word carries the word itself. A state is (word, position, node,
edits). Level by level, all states at that depth are joined with the edges of that depth by node.
A state without edits follows its own word, and where an edge differs by one replaced character, or
by one character that the word has and the edge has not, a state with one edit goes on to the child.
A state with one edit goes on only where the edge says what the word says. A state with one edit that
meets the end of a word has found a neighbour. Replacements are looked for upwards in character order and
insertions as deletions from the longer word; the pairs hold in both directions.

Words go down two tries, as they are and reversed. An edit stands in the second half of one of the two, so
a state starts at the node of its own first half, below the crowded top of the trie. An edge also says, as
64 bits, which next characters and lengths there are below its child; a state whose rest is not among
them is not sent there. Edges of words of up to 16 characters carry one character; up to 32 two, up to 64 four, and so on, so there are 17 levels
at most, however long the words. A word at a border of two such classes goes into both. Prefix hashes may
collide, which only adds pairs; every pair is held against the words at the end.

A node that many words pass is split: its words are dealt to several parts by their hash, and its few edges
are repeated for each part.

Defined cases: a null text has no runs; a null doc_id counts as the empty string; an empty text, or one
without a run of seven, gives nothing; repeated rows count as often as they stand; very long texts are
read run by run; very long runs are words like others. Ties go to the smallest word in code-point order.
An empty table gives an empty result. Names of other columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.lineage import settle, staged
from stationflow.llm.batches import in_small_batches

LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
DAMAGED = 31  # runs whose hash this divides lose a character
HELD = 50_000  # words a task counts before it hands them on
LONG_TEXT = 1 << 20
SINGLE = 16  # words of up to so many characters have edges of one character
HOT, MOST_HOT = 10_000, 5_000  # words through a node before it is split; nodes that can be split

_LETTERS = "A-Za-zÀ-ÿ"  # fixed value: what a run is made of
_LOWER = {c: c + 32 for c in range(65, 91)}


def word_of(doc_id: str, run: str) -> str:
    """What a run counts as: its letters A-Z lower-cased, and one character less if the hash says so."""
    word = run.lower() if run.isascii() else run.translate(_LOWER)
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % DAMAGED:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: words of at least that many characters with at least so many occurrences."""
    find = re.compile(f"[{_LETTERS}]{{{least_length},}}")

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                if not text:
                    continue
                runs = find.findall(text) if len(text) < LONG_TEXT else (m.group() for m in find.finditer(text))
                for run, n in Counter(runs).items():
                    word = word_of(doc_id, run)
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held.clear()
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    texts = in_small_batches(docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text"))
    counts = texts.where("text IS NOT NULL").mapInPandas(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least_count)


# --- the two tries ---------------------------------------------------------------------------------

def _block(length: Column) -> Column:
    """Characters that an edge carries, for words of this length: 1, 2, 4, ..."""
    return F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(length / F.lit(SINGLE))))).cast("int")


def _walks(words: DataFrame) -> DataFrame:
    """Each word, as it is and reversed, in each class of edges it belongs to, with its levels."""
    length = F.length("word")
    blocks = F.explode(F.array_distinct(F.array(_block(length), _block(length + 1)))).alias("block")
    both = words.select("word", "n", F.lit(False).alias("back")).unionByName(
        words.select(F.reverse("word").alias("word"), "n", F.lit(True).alias("back")))
    return both.select("*", blocks).withColumns({
        # the two halves make up the word: reversed, the longer one counts as the first
        "first_level": F.floor(F.floor((length + F.col("back").cast("int")) / 2) / F.col("block")).cast("int"),
        "last_level": F.floor(length / F.col("block")).cast("int")})


def _node(depth: Column) -> Column:
    return F.xxhash64("back", "block", F.substring("word", F.lit(1), depth))


def _below(at: Column) -> Column:
    """The bit of what a word still holds from a place on: its next characters, and how many there are."""
    rest = F.xxhash64(F.substring("word", at + 1, F.col("block")), F.length("word") - at)
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(rest, F.lit(64)).cast("int"))


def _at_level(walks: DataFrame, level: int) -> DataFrame:
    """The words that pass this level without an edit, with their node and the place they have reached."""
    depth = F.lit(level) * F.col("block")
    rows = walks.where(F.lit(level).between(F.col("first_level"), F.col("last_level")))
    return rows.select("word", "n", "back", "block", _node(depth).alias("node"), depth.cast("int").alias("at"),
                       (F.col("last_level") == level).alias("ends"))


def _edges(passing: DataFrame) -> DataFrame:
    """node, edges: label, child and below; the edge that ends a word has no child and names the word and its count.

    Edges of one character come as one array per node, bounded by the alphabet; longer ones each in a row of their own.
    """
    after = F.col("at") + F.col("block")
    goes_on = ~F.col("ends")
    rows = passing.select(
        "node", "block", F.substring("word", F.col("at") + 1, F.col("block")).alias("label"),
        F.when(goes_on, _node(after)).alias("child"), F.when(F.col("ends"), F.col("word")).alias("other"),
        F.when(F.col("ends"), F.col("n")).alias("other_n"), F.when(goes_on, _below(after)).alias("bit"))
    rows = rows.groupBy("node", "block", "label", "child", "other", "other_n").agg(F.bit_or("bit").alias("below"))
    apart = F.when(F.col("block") > 1, F.xxhash64("label", "other")).alias("apart")
    return rows.groupBy("node", apart).agg(
        F.collect_list(F.struct("label", "child", "other", "other_n", "below")).alias("edges")).drop("apart")


def _hot_nodes(walks: DataFrame) -> DataFrame | None:
    """node, parts for the nodes that many words pass, or None; MOST_HOT rows at most."""
    levels = F.explode(F.sequence("first_level", "last_level")).alias("level")
    passed = walks.select("word", "back", "block", levels).select(_node(F.col("level") * F.col("block")).alias("node"))
    counts = staged(passed.groupBy("node").count().where(F.col("count") > HOT))
    total = counts.agg(F.sum("count")).first()[0]
    if total is None:
        return None
    limit = max(HOT, total // MOST_HOT)  # fewer than total / limit nodes can have more than limit
    return counts.where(F.col("count") > limit).select("node", F.ceil(F.col("count") / limit).cast("int").alias("parts"))


def _met(states: DataFrame, edges: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Every state with the edges of its node."""
    if hot is None:
        return states.join(edges, "node")
    parts = F.coalesce("parts", F.lit(1))
    hot = F.broadcast(hot)  # MOST_HOT rows at most
    states = states.join(hot, "node", "left").withColumn("part", F.pmod(F.xxhash64("word"), parts)).drop("parts")
    edges = edges.join(hot, "node", "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long")))).drop("parts")
    return states.join(edges, ["node", "part"]).drop("part")


def _step(met: DataFrame) -> DataFrame:
    """States after their edge: with the child as node, or, with ``other`` set, at the end of a word."""
    at, block, edited = F.col("at"), F.col("block"), F.col("edits") == 1
    # what the word says from here on, once for all edges; a node with one edge has nothing but the word's own
    said = met.where(edited | (block > 1) | (F.size("edges") > 1)).select(
        "word", "n", "back", "block", "at", "edits", (F.length("word") - at).alias("left"),
        F.substring("word", at + 1, block).alias("own"), F.substring("word", at + 1, block + 1).alias("longer"),
        F.substring("word", at + 2, F.lit(1)).alias("second"), _below(at + block).alias("after_own"),
        _below(at + block + 1).alias("after_longer"), "edges")
    rows = said.select("*", F.explode("edges").alias("e")).drop("edges")
    label, own, longer, left = F.col("e.label"), F.col("own"), F.col("longer"), F.col("left")
    ends, size = F.col("e.other").isNotNull(), F.length("e.label")

    def reaching(bit: str) -> Column:
        return F.col(bit).bitwiseAND(F.col("e.below")) != 0

    single = block == 1
    # an edge that goes on has as many characters as all edges of its class
    kept = (left >= block) & (label == own) & reaching("after_own")
    replaced = (left >= block) & (label > own) & reaching("after_own") & (single | (F.levenshtein(label, own, 1) == 1))
    dropped = (left > block) & (label != own) & reaching("after_longer") & F.when(
        single, label == F.col("second")).otherwise(F.levenshtein(label, longer, 1) == 1)
    # an edge that ends a word has fewer, and must hold all the rest of the state's word
    kept_end = (left == size) & (label == longer)
    replaced_end = (left == size) & (label > longer) & (F.levenshtein(label, longer, 1) == 1)
    dropped_end = (left == size + 1) & (F.levenshtein(label, longer, 1) == 1)
    stays = F.when(edited, F.when(ends, kept_end).otherwise(kept)).otherwise(F.when(ends, replaced_end | dropped_end).otherwise(replaced))
    skips = ~edited & ~ends & dropped
    # few pairs of a state and an edge lead on: only those are given arrays
    moved = rows.where(stays | skips).withColumn("moves", F.array_compact(F.array(
        F.when(stays, at + size), F.when(skips, at + size + 1))))
    return moved.select("word", "n", "back", "block", F.col("e.child").alias("node"), F.explode("moves").alias("at"),
                        F.lit(1).alias("edits"), F.col("e.other").alias("other"), F.col("e.other_n").alias("other_n"))


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: every pair of words that differ by one edit, once in each direction.

    ``words`` (word, n) are distinct and best staged; they are read once a level.
    """
    walks = staged(_walks(words))
    low, high = walks.agg(F.min("first_level"), F.max("last_level")).first()
    hot = _hot_nodes(walks)
    frontier, found = None, None
    for level in range(low, high + 1) if low is not None else ():
        passing = _at_level(walks, level)
        states = passing.select("word", "n", "back", "block", "node", "at", F.lit(0).alias("edits"))
        if frontier is not None:
            states = states.unionByName(frontier.where("other IS NULL").drop("other", "other_n"))
        frontier = staged(_step(_met(states, _edges(passing), hot)))
        ended = frontier.where("other IS NOT NULL").select("word", "n", "other", "other_n", "back")
        found = ended if found is None else found.unionByName(ended)
    if found is None:
        return words.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n")).limit(0)
    right_way = found.select(*[
        F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c)).alias(c) for c in ("word", "other")], "n", "other_n")
    pairs = staged(right_way.where(F.levenshtein("word", "other", 1) == 1))
    turned = pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"),
                          F.col("word").alias("other"), F.col("n").alias("other_n"))
    return pairs.unionByName(turned.select(*pairs.columns)).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root from forms (word, form): forms followed to the last, twice as far in every round.

    Counts grow at least tenfold from a word to its form, so a chain is short and never closes.
    """
    reached = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = settle(reached.join(further, "root", "left"))
        reached = moved.select("word", F.coalesce("next", "root").alias("root"))
        if moved.where("next IS NOT NULL").isEmpty():
            return reached


def spelling_groups(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the texts."""
    words = staged(word_counts(docs))
    near = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus_n"), "other")).alias("best"))
    best_n = -F.col("best.minus_n")
    rows = staged(words.join(near, "word", "left").withColumn("common", best_n >= F.col("n") * times).select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("common"), F.col("best.other")).alias("form"), F.when(F.col("common"), best_n).alias("form_n")))
    last = roots(rows.where("form IS NOT NULL"))
    return rows.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle(times: int = TIMES) -> str:
    """The same over ``documents`` in DuckDB SQL, with pairs from words that lack a character."""
    return f"""
WITH RECURSIVE crc(b, k, v) AS (
    SELECT b, 0, b FROM range(256) AS bytes(b)
    UNION ALL
    SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc WHERE k < 8
),
crc_table AS (SELECT list(v ORDER BY b) AS entries FROM crc WHERE k = 8),
runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[{_LETTERS}]+')) AS run FROM documents)
),
counted AS (
    SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS digits
    FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL
),
hashed AS (
    SELECT run, n, xor(list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(digits) // 2), lambda i:
            (strpos('0123456789ABCDEF', digits[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', digits[2 * i + 2]) - 1)),
        lambda crc, byte: xor(crc >> 8, entries[xor(crc & 255, byte) + 1])), 4294967295) AS h
    FROM counted, crc_table
),
words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT n, CASE WHEN h % {DAMAGED} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
        FROM hashed)
    WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
),
shorter AS (
    SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
),
pairs AS (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word
),
near AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n
    FROM pairs GROUP BY word
),
formed AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {times} * n THEN other END AS form,
           CASE WHEN other_n >= {times} * n THEN other_n END AS form_n
    FROM words LEFT JOIN near USING (word)
),
chain(word, reached, form) AS (
    SELECT word, word, form FROM formed
    UNION ALL
    SELECT chain.word, formed.word, formed.form FROM chain JOIN formed ON formed.word = chain.form
)
SELECT formed.word, formed.form, reached AS root, n, n_near, form_n
FROM formed JOIN chain ON chain.word = formed.word AND chain.form IS NULL"""
