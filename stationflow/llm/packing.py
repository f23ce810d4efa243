"""Best-fit packing of token pieces into sequences of fixed size, planned over a length histogram.

Documents become pieces of at most ``size`` tokens (only longer documents are cut; the first piece
takes what is left over). The plan is made over counts: lengths are taken from the longest to the
shortest, and each goes into the fullest sequences that still have room, a whole group of equally
full sequences at a time. It sees at most ``size`` counts and its own groups, never a document. A
planned slot is a run of ranks within a length; a piece finds its slot by its rank among the pieces
of its length.

Ranks are counted within (length, bucket), with as many buckets as rows ask for, and shifted by the
counts of the buckets before; so a length that a third of all pieces have is ranked by many tasks.

Defined cases: a null text counts as empty and gives a piece that holds the end token alone;
repeated rows are packed one by one; pieces with equal keys and equal digests are interchangeable;
an empty table gives an empty result. Names of other columns don't matter: ``tokenised`` and ``cut``
return columns of their own only.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from stationflow.lineage import staged
from stationflow.llm.batches import in_small_batches
from stationflow.llm.cutting import well_formed

SIZE = 2048
END_ID = 0
ROWS_PER_BUCKET = 200_000


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, if it is
    printable and no space; else the next one from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class LibraryTokenizer:
    """Packed ids of whole texts by a byte-level ``tokenizers`` file.

    The file's merges must stand in the order of the ids they make, as they do in vocabularies trained that way; then
    a merge's rank is the id it makes, and the tiktoken library, which works by such ranks and keeps no table of
    words seen, gives the same ids several times faster.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        model = json.loads(Tokenizer.from_file(path).to_str())["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab[a + b] for a, b in merges]
        if made != sorted(made) or len(vocab) != len(merges) + len(set("".join(vocab))):
            raise ValueError(f"{path}: merges don't stand in the order of their ids")
        byte_of = {letter: byte for byte, letter in byte_letters().items()}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
        self.encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        return self.encoding.encode_to_numpy(well_formed(text), disallowed_special=()).astype("<u4").tobytes()


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> LibraryTokenizer:
    return LibraryTokenizer(path, pattern)


def cut_ids(packed: bytes, size: int) -> list[tuple[int, int, bytes]]:
    """(piece, start, ids) of a document's packed ids: full pieces, after what is left over."""
    total = len(packed) // 4
    first = total % size or size
    places = [0, *range(first, total, size)]
    return [(k, a, packed[4 * a:4 * b]) for k, (a, b) in enumerate(zip(places, [*places[1:], total]))]


def pieces(text: Column, path: str, pattern: str, size: int = SIZE, end_id: int = END_ID) -> Column:
    """array<struct<piece, start, ids>>: the ids of a text and the end token, in pieces; ids are packed
    as little-endian unsigned 32-bit integers."""
    end = int(end_id).to_bytes(4, "little")

    @pandas_udf("array<struct<piece:int,start:long,ids:binary>>")
    def tokenised(texts: pd.Series) -> pd.Series:
        tokenizer = load(path, pattern)
        return pd.Series([
            [{"piece": k, "start": a, "ids": ids} for k, a, ids in cut_ids(tokenizer.ids(t) + end, size)]
            for t in texts
        ], dtype=object)

    return tokenised(text)


def cut(docs: DataFrame, path: str, pattern: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids per piece."""
    rows = in_small_batches(docs).select("doc_id", F.explode(pieces(F.col("text"), path, pattern, size, end_id)).alias("p"))
    return rows.select("doc_id", "p.piece", "p.start", (F.octet_length("p.ids") / 4).cast("long").alias("length"), "p.ids")


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, end rank, first sequence, pieces in each sequence, offset there).

    Best fit, longest first, over counts: a group is a run of sequences that are equally full.
    """
    groups: dict[int, list[list[int]]] = {}  # room left -> [first sequence, number of sequences]
    slots, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def put(first: int, number: int, room: int) -> None:
            """``number`` sequences with ``room``, filled one after the other; notes slots and new groups."""
            nonlocal left, rank
            each = room // length
            full, rest = divmod(min(left, number * each), each)
            for start, many, k in ((first, full, each), (first + full, 1 if rest else 0, rest)):
                if many:
                    slots.append((length, rank, rank + many * k, start, k, size - room))
                    rank, left = rank + many * k, left - many * k
                    groups.setdefault(room - k * length, []).append([start, many])
            used = full + (1 if rest else 0)
            if used < number:
                groups.setdefault(room, []).append([first + used, number - used])

        for room in sorted(r for r in groups if r >= length):
            waiting = groups.pop(room)
            while waiting and left:
                put(*waiting.pop(), room)
            if waiting:
                groups.setdefault(room, []).extend(waiting)
            if not left:
                break
        if left:
            opened = -(-left // (size // length))
            put(sequences, opened, size)
            sequences += opened
    return slots


def _ranked(rows: DataFrame, order: list[str]) -> tuple[DataFrame, dict[int, int]]:
    """``rows`` with ``rank`` (from 0) among the rows of a length, and the count of each length."""
    spark = rows.sparkSession
    total = rows.groupBy("length").count().collect()  # at most ``size`` rows
    counts = {r["length"]: r["count"] for r in total}
    buckets = max(1, -(-max(counts.values(), default=0) // ROWS_PER_BUCKET))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    own = Window.partitionBy("length", "bucket").orderBy(*order)
    rows = rows.withColumn("own_rank", F.row_number().over(own) - 1)
    if buckets == 1:
        return rows.withColumnRenamed("own_rank", "rank").drop("bucket"), counts
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("length", "bucket").count()
    shift = sizes.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    rows = rows.join(shift, ["length", "bucket"])
    return rows.withColumn("rank", F.col("own_rank") + F.col("shift")).drop("bucket", "own_rank", "shift"), counts


def place(rows: DataFrame, size: int = SIZE, order: tuple[str, ...] = ("doc_id", "piece", "start", "ids_crc32")) -> DataFrame:
    """``rows`` (with a column length of 1 to ``size``) with sequence_id and offset.

    ``order`` names the columns that tell rows apart.
    """
    ranked, counts = _ranked(rows, list(order))
    slots = plan(counts, size)
    # a slot or two for each length and each group that it meets: bounded by ``size``, not by the rows
    table = rows.sparkSession.createDataFrame(
        slots, "length long, first_rank long, end_rank long, first_sequence long, each long, base long")
    found = ranked.join(F.broadcast(table), "length").where("rank >= first_rank AND rank < end_rank")
    within = F.col("rank") - F.col("first_rank")
    return found.withColumns({
        "sequence_id": F.col("first_sequence") + F.floor(within / F.col("each")),
        "offset": F.col("base") + within % F.col("each") * F.col("length"),
    }).drop("rank", "first_rank", "end_rank", "first_sequence", "each", "base")


def packed(docs: DataFrame, path: str, pattern: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces with their digest, place and, if wanted, ids (packed little-endian unsigned 32-bit integers).

    Ranks are counted over rows without their ids; the ids, dealt evenly by row, meet their place at the end.
    """
    rows = cut(docs, path, pattern, size, end_id).withColumn("ids_crc32", F.crc32("ids"))
    if not with_ids:
        return place(staged(rows.drop("ids")), size)
    rows = staged(rows.withColumn("__row", F.monotonically_increasing_id()))
    places = place(rows.drop("ids"), size).select("__row", "sequence_id", "offset")
    return rows.join(places, "__row").drop("__row")
