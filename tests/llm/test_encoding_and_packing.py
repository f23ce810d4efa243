import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from stationflow.llm import bpe, packing
from stationflow.llm.cutting import Recent, spaced_parts

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


def _random_texts(n):
    rng = random.Random(1)
    letters = list("ab cdeXYZ 0129'\n\t  \r\x0b\x1c\x1f\x85\xa0\u2003\u3000 éßñ漢字😀²½-_.,!'s're") + ["<|endoftext|>"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def test_ids_equal_the_library_and_decode_back(library):
    own = bpe.load(RANKS, P.PATTERN)
    for text in _random_texts(3000) + ["a" * 5000, "ab" * 4000, " " * 999, "\n" * 500 + "x", "ththe" * 900]:
        packed = own.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
        assert own.decode(packed) == text.encode()


def test_packing_ids_equal_the_tokenizers_library(tokenizer):
    own = packing.load(JSON, P.PATTERN)
    for text in _random_texts(3000):
        assert np.frombuffer(own.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_rank_queue_gives_lowest_rank_then_leftmost():
    rng, queue, held = random.Random(5), bpe.RankQueue(50_000), []
    for _ in range(3000):
        if held and rng.random() < 0.5:
            assert queue.pop() == min(held)
            held.remove(min(held))
        else:
            entry = (rng.randrange(50_000) if rng.random() < 0.5 else rng.randrange(3), rng.randrange(1000))
            if entry not in held:
                held.append(entry)
                queue.push(*entry)
    assert bool(queue.top) == bool(held)


def test_parts_join_back_and_the_table_stays_bounded():
    for text in _random_texts(500) + ["", " ", "  a", "a  b", "a \n b "]:
        assert " ".join(spaced_parts(text)) == text
    made = Recent(lambda k: k.encode(), 10)
    assert [made[str(i % 37)] for i in range(500)] == [str(i % 37).encode() for i in range(500)]
    assert len(made) <= 10 and len(made.older) <= 10


def test_lone_surrogates_follow_the_library(library):
    own = bpe.load(RANKS, P.PATTERN)
    assert np.frombuffer(own.encode("a\ud800b"), "<u4").tolist() == library.encode_ordinary("a\ufffdb")


def test_digests_on_odd_rows(spark, docs_of, odd_texts, library):
    got = bpe.digests(docs_of(odd_texts), RANKS, P.PATTERN).collect()
    assert len(got) == len(odd_texts)
    want = Counter()
    for i, t in odd_texts:
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        want[(i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == want
    assert bpe.digests(docs_of([]), RANKS, P.PATTERN).count() == 0


def _check_sequences(rows, size):
    placed = defaultdict(list)
    for r in rows:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in placed.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(placed)


def test_plan_uses_as_many_sequences_as_plain_best_fit():
    rng = random.Random(3)
    for _ in range(80):
        size = rng.choice([8, 20, 64])
        counts = {n: rng.randrange(1, 30) for n in range(1, size + 1) if rng.random() < 0.6}
        rows = []
        for length, first, end, sequence, each, base in packing.plan(counts, size):
            rows += [{"sequence_id": sequence + (r - first) // each, "offset": base + (r - first) % each * length, "length": length}
                     for r in range(first, end)]
        assert Counter(r["length"] for r in rows) == Counter(counts)
        room = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fits = [(left, k) for k, left in enumerate(room) if left >= length]
                if fits:
                    room[min(fits)[1]] -= length
                else:
                    room.append(size - length)
        assert _check_sequences(rows, size) == len(room)


def test_packed_pieces_on_odd_rows(spark, docs_of, odd_texts, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_BUCKET", 2)  # several buckets of ranks
    rows = packing.packed(docs_of(odd_texts), JSON, P.PATTERN, size=64).collect()
    _check_sequences(rows, 64)
    want = Counter()
    for i, t in odd_texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 64 or 64, len(ids), 64), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    bare = packing.packed(docs_of(odd_texts), JSON, P.PATTERN, size=64, with_ids=False)
    assert "ids" not in bare.columns and Counter(r["ids_crc32"] for r in bare.collect()) == Counter(r["ids_crc32"] for r in rows)
    assert packing.packed(docs_of([]), JSON, P.PATTERN).count() == 0
