import random

import numpy as np
import pytest

from stationflow.llm import multi_index, nn_descent

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, node int"
ODD = [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15), (9004, [None] + [1.0] * 15),
       (9005, [float("inf")] + [1.0] * 15), (9006, [1.0, 2.0]), (None, [1.0] * 16)]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(700, 16)).astype("float32")
    near = rows[:60].repeat(3, axis=0) + rng.normal(scale=0.05, size=(180, 16)).astype("float32")
    crowd = rows[100] + rng.normal(scale=0.02, size=(120, 16)).astype("float32")
    copies = rows[200][None].repeat(40, axis=0)
    return np.vstack([rows, near, crowd, copies]).astype("float32")


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA)


def _rows(vectors):
    return [(i, v.tolist()) for i, v in enumerate(vectors)]


def test_multi_index_recall_scores_and_odd_rows(spark, vectors, monkeypatch):
    monkeypatch.setattr(multi_index, "SHARD_ROWS", 100)  # one vector's copies fill a cell over several shards
    monkeypatch.setattr(multi_index, "BATCH_QUERIES", 20)
    rows = _rows(vectors) + ODD + [(3, vectors[3].tolist())]
    got = multi_index.nearest(_frame(spark, rows), lambda i: i % 20 == 0, k=20).collect()
    x, hit = vectors.astype(float), 0
    asked = range(0, len(x), 20)
    assert {r["query_id"] for r in got} == set(asked) and len(got) == 20 * len(asked)
    for q in asked:
        scores = (x * x[q]).sum(axis=1)
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert all(r["score"] == pytest.approx(scores[r["vec_id"]], abs=1e-12) for r in own)
        assert own == sorted(own, key=lambda r: (-r["score"], r["vec_id"]))
        scores[q] = -np.inf
        hit += len({r["vec_id"] for r in own} & set(np.lexsort((np.arange(len(x)), -scores))[:20].tolist()))
    assert hit / len(got) >= 0.9
    assert multi_index.nearest(_frame(spark, ODD), lambda i: i % 20 == 0).count() == 0
    few = multi_index.nearest(_frame(spark, _rows(vectors[:3])), lambda i: i % 20 == 0).collect()
    assert len(few) == 2  # all candidates, if there are fewer than k


def test_traversal_visits_pairs_by_their_sum():
    rng = np.random.default_rng(1)
    books = multi_index.Codebooks(rng.normal(size=(7, 4)), rng.normal(size=(5, 4)))
    q = rng.normal(size=8)
    sums = ((books.first @ q[:4])[:, None] + (books.second @ q[4:])[None, :]).ravel()
    assert books.traverse(q, np.ones(35, int), np.inf) == np.argsort(-sums).tolist()


def test_nn_descent_equals_brute_force(spark, vectors, monkeypatch):
    monkeypatch.setattr(nn_descent, "PAIR_BLOCK", 50)  # the crowd is counted in several blocks
    rows = _rows(vectors) + ODD + [(5, vectors[5].tolist())]
    got = {r["vec_id"]: r for r in nn_descent.near_duplicates(_frame(spark, rows)).collect()}
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
    links = unit @ unit.T >= 0.9
    label = np.arange(len(unit))
    while True:
        least = np.array([label[row].min() for row in links])
        if (least == label).all():
            break
        label = least
    assert len(got) == len(unit) + len(ODD)
    for i in range(len(unit)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (links[i].sum() - 1, label[i], label[i] == i)
    for i, _ in ODD[:-1]:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[None]["n_links"] == 0 and got[None]["component_id"] is None


def test_nn_descent_small_tables(spark, vectors):
    assert nn_descent.near_duplicates(_frame(spark, [])).count() == 0
    one = nn_descent.near_duplicates(_frame(spark, _rows(vectors[:1]))).collect()
    assert [tuple(r) for r in one] == [(0, 0, 0, True)]


# --- pipeline -------------------------------------------------------------------------------------

def test_stages_on_odd_rows_and_an_empty_table(spark, docs_of, odd_texts, tmp_path):
    import corpus_pipeline as C

    rng = random.Random(2)
    words = ["".join(rng.choice("aeioutnsr") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    plain = [(100 + i, " ".join(rng.choice(words) for _ in range(40)).capitalize() + ".") for i in range(60)]
    junk = [(300 + i, " ".join(rng.choice(words).upper() + "!!" for _ in range(40))) for i in range(30)]
    labels = [(i, 1, 0) for i, _ in plain] + [(i, 0, 0) for i, _ in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (plain + junk + odd_texts, []):
        docs = docs_of(rows)
        docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        for k, (_, stage) in enumerate(C.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            if k < len(C.STAGES) - 1:
                assert docs.columns == docs_of(rows).columns
                docs.write.mode("overwrite").parquet(f"{tmp_path}/{k}.parquet")
                docs = spark.read.parquet(f"{tmp_path}/{k}.parquet")
                if k == 0 and rows:
                    left = {r["doc_id"] for r in docs.collect()}
                    assert {i for i, _ in plain} <= left and not {i for i, _ in junk} & left
        ran = C.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32")
        assert sorted(map(str, ran.collect())) == sorted(map(str, docs.select(ran.columns).collect()))
        assert (docs.count() > 0) == bool(rows)
