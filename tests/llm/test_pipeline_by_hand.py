"""The pipeline against the same five steps done one document at a time, and the statistics against a naive twin."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from test_text_operators import _components, _plain_removed

import public_tokenizers as P
from stationflow.llm import pii, quality, url_filter

JSON = P.path("byte_bpe_50k.json")


def plain_statistics(text):
    """What the classifier reads, counted by hand."""
    data = (text or "").encode("utf-8", "replace")
    words, n = data.split(), len(data.split())
    if not n:
        return [0.0] * 14
    count = lambda keep: sum(1 for b in data if keep(b))
    root = lambda k, of: math.sqrt(min(1.0, k / of))
    upper, lower = count(lambda b: 65 <= b <= 90), count(lambda b: 97 <= b <= 122)
    size, few = len(data), 30
    frequent = max(Counter(words).values())
    return [
        math.log(1 + n), math.log((size - n + 5 * few) / (n + few)), root(upper, max(1, upper + lower)),
        root(count(lambda b: 48 <= b <= 57), size), root(count(lambda b: b in b"#$%&*+/<=>@[\\]^_`{}~"), size),
        root(data.count(b"|"), size), root(data.count(b"!") + data.count(b"?"), size), root(data.count(b"."), n + few),
        root(data.count(b","), n + few), root(count(lambda b: b > 127), size), math.log(len(set(words)) + few) / math.log(n + few),
        root(sum(words[k] == words[k + 1] for k in range(n - 1)), n + few), root(frequent - 1, n + few),
        math.log(n / (1 + data.count(b"\n"))),
    ]


def test_statistics_equal_a_naive_count(odd_texts):
    rng = random.Random(7)
    texts = [t for _, t in odd_texts] + ["".join(rng.choice("aA1 .,!?|#é\n") for _ in range(rng.randrange(400))) for _ in range(200)]
    for text in texts:
        assert quality.statistics_of(text) == pytest.approx(plain_statistics(text), abs=1e-12)


def plain_accepted(docs, labels):
    stats = {i: np.array(plain_statistics(t)) for i, t in docs}
    rows = {c: np.array([stats[i] for i, y in labels if y == c and i in stats and zlib.crc32(str(i).encode()) % 4 != 2]) for c in (0, 1)}
    cov = {c: np.cov(v.T, bias=True) for c, v in rows.items()}
    pooled = sum(len(rows[c]) * cov[c] for c in (0, 1)) / sum(map(len, rows.values()))
    density = []
    for c in (0, 1):
        weight = max(quality.TO_POOLED, 14 / (14 + len(rows[c])))
        s = (1 - weight) * cov[c] + weight * pooled
        s = (1 - quality.TO_DIAGONAL) * s + quality.TO_DIAGONAL * np.diag(np.diag(s)) + quality.FLOOR * np.eye(14)
        mean, inverse, det = rows[c].mean(axis=0), np.linalg.inv(s), np.linalg.slogdet(s)[1]
        density.append({i: -0.5 * (x - mean) @ inverse @ (x - mean) - 0.5 * det + math.log(len(rows[c])) for i, x in stats.items()})
    return [(i, t) for i, t in docs if 1 / (1 + math.exp(min(500, density[0][i] - density[1][i]))) >= quality.THRESHOLD]


def plain_fingerprint(text):
    words = [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_best_fit(lengths, size=2048):
    room = []
    for length in sorted(lengths, reverse=True):
        fits = [(left, k) for k, left in enumerate(room) if left >= length]
        if fits:
            room[min(fits)[1]] -= length
        else:
            room.append(size - length)
    return len(room)


def test_the_pipeline_equals_its_steps_by_hand(spark, docs_of, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline as C

    rng = random.Random(21)
    words = ["".join(rng.choice("aeioutnsr") for _ in range(rng.randint(2, 8))) for _ in range(400)]

    def line(n):
        return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."

    common = [line(8) for _ in range(3)]
    docs = [(i, "\n".join([line(rng.randint(6, 12)) for _ in range(rng.randint(3, 9))] + [rng.choice(common)])) for i in range(120)]
    docs += [(200 + i, " ".join(rng.choice(words).upper() + "!!" for _ in range(60))) for i in range(60)]
    docs += [(300 + i, docs[i][1].replace(".\n", ",\n", 1)) for i in range(12)]  # near copies
    docs += [(400 + i, f"{line(30)} mail jo{i}@x.org or +1 (456) 555-21{i:02}\n{line(20)}") for i in range(10)]
    docs += [(500, "\n".join(line(20) for _ in range(400)))]  # longer than a sequence
    labels = [(i, 0 if 200 <= i < 300 else 1) for i, _ in docs if i % 3]
    spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs_of(docs, extra=False).write.parquet(f"{tmp_path}/documents.parquet")

    kept = plain_accepted(docs, labels)
    assert 0 < len(docs) - len(kept) <= 62
    gone = defaultdict(set)
    for (i, n) in _plain_removed(kept):
        gone[i].add(n)
    lines = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i])) for i, t in kept]
    prints = {i: plain_fingerprint(t) for i, t in lines}
    least = _components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    single = [(i, t) for i, t in lines if least[i] == i]
    assert len(single) < len(lines)
    clean = [(i, pii.redact(t, pii.all_spans(t, pii.trained()))) for i, t in single]
    assert sum("<EMAIL>" in t for _, t in clean) >= 8
    tokenizer, pieces = Tokenizer.from_file(JSON), Counter()
    for i, t in clean:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        pieces.update((i, k, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    rows = C.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows) == pieces
    assert len({r["sequence_id"] for r in rows}) == plain_best_fit([n for _, _, n, _ in pieces])


# --- a vocabulary of one's own ----------------------------------------------------------------------

def test_a_vocabulary_from_a_table(spark):
    table = spark.createDataFrame([("Bad", 1.0), ("poor", 0.5), ("weak", 0.5), ("meh", 0.2), (None, 1.0), ("nil", None), ("zero", 0.0), ("bad", 0.1)],
                                  "term string, weight double")
    strict, soft = url_filter.vocabulary_of(table)
    assert strict == ("bad",) and soft == ("meh", "poor", "weak")
    pages = spark.createDataFrame([(1, "http://a.net/BAD"), (2, "http://a.net/poor-weak"), (3, "http://a.net/poor"), (4, "http://a.net/badly"),
                                   (5, "http://a.net/" + "x-" * 200_000 + "\nbad")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, strict=strict, soft=soft).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block"}
    with pytest.raises(ValueError, match="more than 2 terms"):
        url_filter.vocabulary_of(table, most=2)
