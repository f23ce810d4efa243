"""Crowds of vectors counted exactly, and repeated passages, against brute force."""

import random

import numpy as np
import pytest

from stationflow.llm import crowds, nn_descent, substring_dedup
from stationflow.llm.spread import join_spread
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int"


def _frame(spark, x):
    return spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], SCHEMA)


def _expected(x):
    unit = x.astype("float32").astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    links = unit @ unit.T >= 0.9
    label = np.arange(len(unit))
    while True:
        least = np.array([label[row].min() for row in links])
        if (least == label).all():
            return links.sum(axis=1) - 1, label
        label = least


def _crowd(rng, centre, n, spread):
    return centre / np.linalg.norm(centre) + rng.normal(size=(n, len(centre))) * spread / np.sqrt(len(centre))


def _two_crowds(rng, cosine, n, spread, dim=32):
    a = rng.normal(size=dim)
    a /= np.linalg.norm(a)
    b = rng.normal(size=dim)
    b -= (a @ b) * a
    b /= np.linalg.norm(b)
    return np.vstack([_crowd(rng, a, n, spread), _crowd(rng, cosine * a + np.sqrt(1 - cosine ** 2) * b, n, spread)])


@pytest.mark.parametrize("case", ["adjoining", "wide", "tight beside tight", "chain"])
def test_links_between_adjoining_crowds_are_all_found(spark, monkeypatch, case):
    monkeypatch.setattr(nn_descent, "PAIR_BLOCK", 30)
    monkeypatch.setattr(crowds, "BALLS_AT_ONCE", 5)
    monkeypatch.setattr(crowds, "FAN", 4)
    rng = np.random.default_rng(12)
    x = {
        "adjoining": lambda: _two_crowds(rng, 0.92, 80, 0.2), "wide": lambda: _crowd(rng, rng.normal(size=32), 220, 0.42),
        "tight beside tight": lambda: _two_crowds(rng, 0.895, 90, 0.06),
        "chain": lambda: np.vstack([_crowd(rng, np.cos(t) * np.eye(32)[0] + np.sin(t) * np.eye(32)[1], 60, 0.1) for t in np.arange(0, 1.6, 0.4)]),
    }[case]()
    x = np.vstack([x, rng.normal(size=(150, 32)), x[:3]]).astype("float32")  # others, and three exact copies
    n_links, component = _expected(x)
    got = {r["vec_id"]: r for r in nn_descent.near_duplicates(_frame(spark, x)).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == n_links.tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == component.tolist()


def test_all_are_counted_exactly_where_the_audit_is_never_passed(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "MOST_TRIES", 1)
    monkeypatch.setattr(nn_descent, "_audit", lambda *a: 0.5)
    rng = np.random.default_rng(13)
    x = np.vstack([_two_crowds(rng, 0.93, 25, 0.2, 16), rng.normal(size=(40, 16))]).astype("float32")
    n_links, component = _expected(x)
    got = {r["vec_id"]: r for r in nn_descent.near_duplicates(_frame(spark, x)).collect()}
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(len(x))] == list(zip(n_links.tolist(), component.tolist()))


def test_unit_vectors_of_extreme_sizes():
    rows = np.array([[3e200, 4e200], [3e-200, 4e-200], [3.0, 4.0]])
    assert np.allclose(crowds.unit([r.tobytes() for r in rows], 8), [[0.6, 0.8]] * 3)


# --- passages --------------------------------------------------------------------------------------

def _shared(pairs, size=51):
    """Documents that hold ``size`` words in a row which a document of lower id holds too; and all that share any."""
    held = {}
    for i, text in pairs:
        words = (text or "").lower().split()
        for k in range(len(words) - size + 1):
            held.setdefault(tuple(words[k:k + size]), set()).add(i)
    groups = [g for g in held.values() if len(g) > 1]
    return {i for g in groups for i in g if i != min(g)}, {i for g in groups for i in g}


def test_passages_are_found_wherever_they_begin_and_end(spark, docs_of):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(900)]

    def text(n, stop=0.08):
        return " ".join(rng.choice(words) + ("." if rng.random() < stop else "") + ("\n" if rng.random() < 0.02 else "") for _ in range(n))

    pairs = []
    for i in range(120):
        body = text(rng.randint(5, 160), rng.choice([0.0, 0.08, 0.9]))
        pairs.append((i, body))
    for k in range(45):  # a stretch of another text, of at least 51 words, within sentences of its own
        source = pairs[k][1].split(" ")
        if len(source) >= 60:
            size = rng.randint(51, min(len(source), 75))
            at = rng.randint(0, len(source) - size)
            pairs.append((200 + k, f"{text(9)} {' '.join(source[at:at + size])} {text(11)}"))
    for k in range(30):  # shorter ones stay
        source = pairs[k][1].split(" ")[:25]
        pairs.append((400 + k, f"{text(12)} {' '.join(source)} {text(12)}"))
    pairs.append((500, "ha " * 300 + text(20)))  # repeats within one text stay
    wanted, sharing = _shared(pairs)
    found = {r["doc_id"] for r in substring_dedup.repeated_spans(docs_of(pairs)).collect()}
    assert len(wanted) > 15 and wanted <= found and not found - sharing


def test_repeats_of_ties_copies_and_missing_ids(spark, docs_of):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(80))
    other = " ".join(rng.choice(words) for _ in range(80))
    pairs = [(3, passage), (3, passage), (3, f"{passage} {passage}"), (8, passage), (8, passage), (None, other), (9, other), (10, None), (11, "")]
    got = substring_dedup.repeated_spans(docs_of(pairs)).collect()
    assert {(r["doc_id"], r["first_doc_id"]) for r in got} == {(8, 3), (9, None)} and len(got) == 2
    for r in got:
        text = dict(pairs)[r["doc_id"]]
        assert r["n_words"] == 80 and text[r["start"]:r["end"]] == text


@pytest.mark.parametrize("many", [20_000, 3])
def test_join_spread_is_a_join(spark, many):
    rows = spark.range(200).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    rows = rows.unionByName(spark.range(200, 260).select(F.lit(3).cast("long").alias("k"), F.col("id").alias("v")))
    few = rows.groupBy("k").count().where("k <> 5").withColumn("name", F.concat(F.lit("n"), "k"))
    got = join_spread(rows, few, "k", F.col("count"), F.xxhash64("v"), many)
    assert sorted(map(tuple, got.select("k", "v", "name").collect())) == sorted(map(tuple, rows.join(few, "k").select("k", "v", "name").collect()))


# --- personal data on documents --------------------------------------------------------------------

def test_added_spans_of_documents_are_what_they_say(spark):
    import re

    from stationflow.llm import pii

    field, texts = pii.trained(), [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    added = []
    for text in filter(None, texts):
        base = pii.base_spans(text)
        added += [(kind, re.sub("[^0-9]", "", text[s:e]), text[s:e]) for s, e, kind in pii.all_spans(text, field, base) if (s, e, kind) not in base]
    right = [kind == "secret" and len(said) >= 16 or kind == "card" and pii.luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15
             or kind == "ip" and said.count(".") == 3 or kind == "email" and "@" in said or kind == "email" and "at" in said
             for kind, digits, said in added]
    assert len(added) >= 10 and sum(right) / len(right) >= 0.95


# --- the multi-index -------------------------------------------------------------------------------

def test_few_of_many_clustered_vectors_are_visited(spark):
    from stationflow.llm import multi_index

    rng = np.random.default_rng(3)
    n, dim, clusters = 100_000, 16, 300
    centres = rng.normal(size=(clusters, dim))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = (centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim)) * 0.06).astype("float32")
    import pyarrow as pa

    rows = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": list(x)}))
    report: dict = {}
    got = multi_index.nearest(rows, lambda i: i % 500 == 0, k=10, report=report).toPandas()
    hits, asked = 0, range(0, n, 500)
    for q, own in got.groupby("query_id"):
        scores = (x.astype(float) * x[q].astype(float)).sum(axis=1)
        scores[q] = -np.inf
        hits += len(set(np.argpartition(-scores, 10)[:10].tolist()) & set(own["vec_id"]))
        assert own.sort_values("rank")["score"].to_numpy() == pytest.approx(np.sort(scores[own["vec_id"]])[::-1], abs=1e-12)
    print("visited", report)
    assert hits / (10 * len(asked)) >= 0.9 and report["share"] < 0.3 and len(got) == 10 * len(asked)


# --- lines: far sides of plan choices ---------------------------------------------------------------

def test_removed_lines_do_not_depend_on_how_joins_are_made(spark, docs_of, monkeypatch):
    from stationflow.llm import line_dedup, spread

    rng = random.Random(6)
    lines = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randint(3, 9))) for _ in range(15)]
    pairs = [(i, "\n".join([*(rng.choice(lines) for _ in range(6)), "the same line in all of them"])) for i in range(40)]
    expected = sorted(map(tuple, line_dedup.removed_lines(docs_of(pairs)).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    monkeypatch.setattr(line_dedup, "join_spread", lambda *a: spread.join_spread(*a, many=5))
    assert sorted(map(tuple, line_dedup.removed_lines(docs_of(pairs)).collect())) == expected and len(expected) > 100


def test_passages_of_equal_words_and_of_other_lines_are_found(spark, docs_of):
    """runs of one word that differ in length, and lines broken elsewhere, hid passages of more than fifty words."""
    rng = random.Random(17)

    def text(n):
        return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(4, 9))) for _ in range(n))

    pairs, tails = [], [text(9) for _ in range(12)]
    for k, tail in enumerate(tails):  # 45 equal words and nine others are shared
        pairs.append((k, f"{text(5)} {'ha%d ' % k * 100}{tail} {text(5)}"))
        pairs.append((100 + k, f"{text(5)} {'ha%d ' % k * 45}{tail} {text(5)}"))
    for k in range(12):  # the same words, in lines of six and of five words, with short sentences before and after
        words = text(51).split()
        pairs.append((200 + k, f"{text(2)}. " + "\n".join(" ".join(words[i:i + 6]) for i in range(0, 51, 6)) + f" {text(1)}. {text(7)}"))
        pairs.append((300 + k, f"{text(9)} " + "\n".join(" ".join(words[i:i + 5]) for i in range(0, 51, 5)) + f" {text(6)}"))
    pairs += [(400, text(3) + " ho" * 30 + " " + text(3)), (401, text(3) + " ho" * 200)]  # thirty words are too few
    wanted, sharing = _shared(pairs)
    got = substring_dedup.repeated_spans(docs_of(pairs)).collect()
    found = {r["doc_id"] for r in got}
    assert len(wanted) == 24 and wanted <= found and not found - sharing and min(r["n_words"] for r in got) >= 36
