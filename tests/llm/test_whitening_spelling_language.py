"""Operators 11 to 13 against plain versions on small tables."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest

from stationflow.llm import byte_cnn, spelling, whitening

VECTORS = "vec_id long, embedding array<double>, component int, n long, x int, part int, value int"
ODD = [(900, None), (901, []), (902, [float("nan")] * 6), (903, [None] * 6), (904, [float("inf")] + [1.0] * 5), (905, [1.0, 2.0]),
       (906, [1e300] * 6)]


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0, 0, 0, 0) for i, v in rows], VECTORS)


@pytest.mark.parametrize("case", ["random", "few rows", "multiples", "clustered", "zero", "one"])
def test_polar_splits_give_eigenvectors(case):
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    v = {
        "random": lambda: np.cov(rng.standard_normal((200, 24)).T), "few rows": lambda: np.cov(rng.standard_normal((9, 24)).T),
        "multiples": lambda: turn @ np.diag([5.0] * 7 + [2.0] * 17) @ turn.T,
        "clustered": lambda: turn @ np.diag(1 + 1e-10 * np.arange(24)) @ turn.T,
        "zero": lambda: np.zeros((24, 24)), "one": lambda: np.array([[3.0]]),
    }[case]()
    v = (v + v.T) / 2
    values, vectors = whitening.eigenvectors(v)
    size = max(np.linalg.norm(v), 1e-300)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], atol=1e-13 * size)
    assert np.abs(vectors.T @ vectors - np.eye(len(v))).max() < 1e-13
    assert np.linalg.norm(v @ vectors - vectors * values) < 1e-13 * size


def test_polar_factor_is_the_sign_of_a_symmetric_matrix():
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.standard_normal((10, 10)))[0]
    values = np.array([3, 1, 1e-6, 2, 1e-10, -1, -2, -1e-7, -5, -0.5])
    got = whitening.polar_factor(turn @ np.diag(values) @ turn.T)
    assert np.abs(got - turn @ np.diag(np.sign(values)) @ turn.T).max() < 1e-5  # eps over the least eigenvalue


def test_whitening_equals_a_dense_version(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)  # several levels of the tree of sums
    monkeypatch.setattr(whitening, "ROWS_AT_A_TIME", 7)
    rng = np.random.default_rng(6)
    c = rng.standard_normal((120, 6)) * [3, 1, 0.5, 2, 1, 0]
    rows = [(i, v.tolist()) for i, v in enumerate(c)] + [(5, c[5].tolist()), (None, c[6].tolist()), (200, [0.0] * 6)] + ODD
    got = whitening.whitened(_vectors(spark, rows).repartition(9), components=32).toPandas()
    kept = [(i, v) for i, v in rows if v and len(v) == 6 and all(a is not None and abs(a) < 1e15 for a in v)]
    x = np.floor(64 * np.array([v for _, v in kept])).astype(int) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    d = (x - total / n).astype(float)
    values, vectors = np.linalg.eigh(d.T @ d / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == n * 6 and set(got["n"]) == {n} and set(got["component"]) == set(range(1, 7))
    for (i, _), row in zip(kept, x):
        own = got[got["vec_id"].isna() if i is None else got["vec_id"] == i]
        assert set(own["deviation"]) == {int(((n * row - total) ** 2).sum())}
    first = got[(got["vec_id"] == 3)].sort_values("component")
    assert np.allclose(first["explained"], values / values.sum(), rtol=1e-10, atol=1e-15)
    expected = d[3] @ vectors[:, :5] / np.sqrt(values[:5])
    assert np.allclose(np.abs(first["whitened"].to_numpy()[:5]), np.abs(expected), rtol=1e-8)
    assert first["whitened"].isna().tolist() == [False] * 5 + [True]  # the last dimension is constant
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-10


def test_whitening_of_odd_tables(spark):
    one = whitening.whitened(_vectors(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0])])).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in one)
    assert whitening.whitened(_vectors(spark, ODD[:5])).count() == 0
    assert whitening.whitened(_vectors(spark, [])).columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    big = whitening.whitened(_vectors(spark, [(1, [4e13, 0.0]), (2, [-4e13, 1.0])])).collect()  # (n x - S)^2 is beyond a long
    assert {r["deviation"] for r in big} == {None} and big[0]["identity_error"] < 1e-6


# --- spelling ------------------------------------------------------------------------------------

def _plain_groups(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            counts[word if h % 31 else word[:h % len(word)] + word[h % len(word) + 1:]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: set() for w in words}
    for a, b in combinations(sorted(words, key=len), 2):
        if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or len(b) == len(a) + 1 and any(
                a == b[:i] + b[i + 1:] for i in range(len(b))):
            near[a].add(b)
            near[b].add(a)
    best = {w: min(others, key=lambda o: (-words[o], o)) for w, others in near.items() if others}
    form = {w: b for w, b in best.items() if words[b] >= 10 * words[w]}

    def root(word):
        return root(form[word]) if word in form else word

    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def _corpus():
    rng = random.Random(9)
    stems = ["".join(rng.choice("abé") for _ in range(rng.choice([7, 8, 9, 15, 16, 17, 31, 32, 33, 34, 64, 65, 66]))) for _ in range(60)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(60):
            word = rng.choice(stems[: rng.choice([3, 20, 60])])
            if rng.random() < 0.4:
                k, c = rng.randrange(len(word)), rng.choice("abcéÀZ")
                word = rng.choice([word[:k] + word[k + 1:], word[:k] + c + word[k + 1:], word[:k] + c + word[k:]])
            words.append(rng.choice([word, word.capitalize()]))
        rows.append((i, " ".join(words)))
    long = "ab" * 300
    common = " ".join(["commonest"] * 400 + ["commonesta"] * 40 + ["commonestab"] * 4)  # a chain of two forms
    return rows + [(1000, None), (1001, ""), (None, "idlessword " * 3), (1002, f"{long} {long}"), (1003, f"{long}c {long}c"),
                   (1004, common), (1005, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa aaaaaaab aaaaaaab"), (1005, "aaaaaaa"), (7, rows[7][1])]


@pytest.mark.parametrize("hot", [10_000, 3])
def test_spelling_groups_equal_plain_comparison(spark, docs_of, monkeypatch, hot):
    monkeypatch.setattr(spelling, "HOT", hot)  # nodes that more words pass are split
    rows = _corpus()
    got = spelling.spelling_groups(docs_of(rows)).collect()
    expected = _plain_groups(rows)
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    assert any(r["root"] != r["form"] and r["form"] for r in got)  # a chain of more than one form


def test_spelling_groups_equal_sql(spark, docs_of):
    rows = [r for r in _corpus() if r[0] != 1005]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    expected = con.execute(spelling.oracle()).fetchall()
    got = spelling.spelling_groups(docs_of(rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {tuple(r) for r in got} == set(expected)


def test_spelling_groups_of_odd_texts(spark, docs_of, odd_texts, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 2)
    monkeypatch.setattr(spelling, "LONG_TEXT", 10)
    got = spelling.spelling_groups(docs_of(odd_texts)).collect()
    assert {tuple(r) for r in got} == _plain_groups(odd_texts)
    assert spelling.spelling_groups(docs_of([])).count() == 0


# --- language ------------------------------------------------------------------------------------

SYLLABLES = {"xx": "the ing tion ed er", "yy": "ão ções não que os", "zz": "ung sch keit ß ein"}


def _languages(n=240):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        parts = SYLLABLES[lang].split()
        text = " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.choice([4, 60, 400])))
        rows.append((i, text, lang))
    return rows


def _tagged(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, 2, 3) for r in rows],
                                 "doc_id long, text string, lang string, source string, n long, windows int, place int")


def test_byte_network_learns_on_the_other_folds_and_predicts_held_out_rows(spark):
    rows = _languages()
    hidden = [(i, t, lang if zlib.crc32(str(i).encode()) % 4 != 2 else "never learnt") for i, t, lang in rows]
    got = {r["doc_id"]: r for r in byte_cnn.predicted_languages(_tagged(spark, hidden)).collect()}
    assert len(got) == len(rows)
    right = [got[i]["lang_pred"] == lang for i, _, lang in rows if got[i]["held_out"]]
    assert len(right) > 30 and sum(right) / len(right) >= 0.97
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i]["score"] <= 1 for i, _, _ in rows)


def test_languages_of_odd_rows(spark, odd_texts):
    rows = _languages(60) + [(10_000 + i, t, None) for i, (_, t) in enumerate(odd_texts)] + [(None, "the thing", "only here"), (3, "12 34", "xx")]
    got = byte_cnn.predicted_languages(_tagged(spark, rows)).collect()
    assert len(got) == len(rows)
    learnt = {lang for i, t, lang in rows if i is not None and lang and zlib.crc32(str(i).encode()) % 4 != 2}
    by_id = {r["doc_id"]: r for r in got}
    for i, (_, text) in enumerate(odd_texts):
        r = by_id[10_000 + i]
        heard = bool(text) and any(c.isalpha() for c in text)
        assert (r["lang_pred"] in learnt) if heard else (r["lang_pred"] == "und" and r["score"] == 0)
    assert by_id[None]["held_out"] is False and by_id[None]["lang_pred"] in learnt and "only here" not in learnt
    nothing = byte_cnn.predicted_languages(_tagged(spark, [(1, "some text", None), (2, None, "xx")])).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}
    assert byte_cnn.predicted_languages(_tagged(spark, [])).count() == 0


def test_a_bounded_sample_takes_the_least_hashes(spark):
    net = byte_cnn.fit(_tagged(spark, _languages()), docs_per_language=5)
    assert net.languages == sorted(SYLLABLES) and np.exp(net.shares).sum() == pytest.approx(1)


def test_windows_cover_every_byte_and_every_filter_place():
    for size in (0, 1, 4, 127, 128, 129, 252, 253, 5_000):
        data = bytes(1 + k % 250 for k in range(size)).decode("latin-1").encode("utf-8")
        windows = byte_cnn.windows_of(data.decode())
        step = byte_cnn.WINDOW - byte_cnn.OVERLAP
        glued = b"".join(w[:step].tobytes() for w in windows[:-1]) + windows[-1].tobytes()
        assert glued.rstrip(b"\0") == data.rstrip(b"\0") and windows.shape[1] == byte_cnn.WINDOW


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    net = byte_cnn.Network.start(["a", "b", "c"], np.zeros(3), rng)
    windows, labels = rng.integers(0, 256, (6, byte_cnn.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    for name in ("embedding", "filters", "bias", "weights", "offset"):
        setattr(net, name, getattr(net, name).astype(float))
    loss = lambda: -net.log_probabilities(windows)[np.arange(6), labels].mean()
    for p, g in zip(net.parameters, net.gradients(windows, labels)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, slope = p[at], g[at]
        p[at] = kept + 1e-6
        up = loss()
        p[at] = kept - 1e-6
        down = loss()
        p[at] = kept
        assert (up - down) / 2e-6 == pytest.approx(slope, rel=1e-3)
