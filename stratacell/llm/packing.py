"""Best-fit packing by exact-complement hashing.

Documents become ids (a tokenizer's, then an end id) and pieces of at most the
capacity; only longer documents are cut. How to pack is decided on the counts of
pieces by length, of which there are at most as many as the capacity, whatever
the corpus: from the longest length down, a gap is looked up among the lengths,
then the sums of two, then of three; combinations that fill it exactly are
consumed as often as the counts allow, and what is left is best-fit. The plan is
a list of patterns with multiplicities; a piece finds its place by its rank
among the pieces of its length, which is counted by blocks of bounded size.

Defined cases: a null text counts as empty and makes one piece of the end id; a
null doc_id stays null; repeated rows are packed each; pieces of equal length
change places freely, so which of them gets which place is decided by doc_id,
piece and ids, and among rows equal in all of them by chance; an empty table gives an empty result; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratacell.llm import blocks as B
from stratacell.llm.common import cut

CAPACITY, END = 4096, 1

#: Deals, within which pieces are ranked, for each shuffle partition at least, and pieces of one length in a deal at most, on average.
DEALS, RANKED = 4, 200_000

#: The tokenizer sees no difference between a text and its words one by one, cut before these after an ASCII letter.
STOPS = np.zeros(256, bool)
STOPS[list(b".,!?")] = True

#: Words are encoded many at a time, set apart by this special token.
APART = "<|endoftext|>"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_open: dict[str, object] = {}


def tokenizer(path: str):
    """One for each Python worker."""
    if path not in _open:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _open[path] = Tokenizer.from_file(path)
    return _open[path]


def encode_words(path: str, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each word, and all ids."""
    t = tokenizer(path)
    apart = t.token_to_id(APART)
    plain = [i for i, w in enumerate(found) if "<|" not in w]
    ids: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(found)
    for at in range(0, len(plain), 2000):
        some = plain[at : at + 2000]
        got = np.array(t.encode(f" {APART} ".join(found[i] for i in some), add_special_tokens=False).ids, np.uint32)
        parts = np.split(got, np.flatnonzero(got == apart))
        for i, x in zip(some, [parts[0], *(p[1:] for p in parts[1:])], strict=True):
            ids[i] = x
    for i in sorted(set(range(len(found))) - set(plain)):
        ids[i] = np.array(t.encode(found[i], add_special_tokens=False).ids, np.uint32)
    return np.fromiter(map(len, ids), np.int64, len(ids)), np.concatenate([np.zeros(0, np.uint32), *ids])


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every row of docs."""
    n = B.partitions(docs)
    shards = B.shards(docs)

    def make(t: pa.Table) -> tuple[bytes, bytes]:
        offsets, data = B.buffers(t.column("text"))
        special = bool(((data[:-1] == ord("<")) & (data[1:] == ord("|"))).any())  # such texts may hold special tokens: nothing is cut or changed
        found = B.words(offsets, data) if special else B.words(offsets, B.LOWERED[data], STOPS)
        return B.pack(*B._plain(found.distinct)), B.pack(t.column("doc_id").combine_chunks(), found.index, found.offsets)

    def dictionary(packed: tuple) -> pa.Array:
        return B.strings(np.frombuffer(packed[1], np.uint8), np.concatenate([[0], np.cumsum(packed[0], dtype=np.int64)]))

    def solve(of: list[int], lists: list[tuple]) -> Iterator[tuple[int, bytes]]:
        numbers, distinct = B.merged(lists)
        counts, ids = encode_words(path, distinct.to_pylist())
        starts = np.cumsum(counts) - counts
        for block, x in zip(of, numbers, strict=True):
            yield block, B.pack(B.tight(counts[x]), B.tight(ids[B.ragged(starts[x], counts[x])]))

    def finish(packed: tuple, body: tuple, by: dict[int, tuple]) -> pa.Table:
        doc_id, index, offsets = body
        starts, counts = B.rows_by_word(dictionary(packed), shards, by)
        every = np.concatenate([np.zeros(0, np.uint32), *(by[s][1].astype(np.uint32) for s in sorted(by))])
        rows: list[tuple] = []
        for d, lo, hi in zip(doc_id.to_pylist(), offsets[:-1], offsets[1:], strict=True):
            x = index[lo:hi]
            ids = np.append(every[B.ragged(starts[x], counts[x])], np.uint32(end)).astype("<u4")
            for k, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at : at + capacity]
                rows.append((d, k, at, len(part), zlib.crc32(part.tobytes()), *([part.tobytes()] if with_ids else [])))
        names = ("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=list(names))

    found = B.mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ("doc_id", "text"), make, n)
    asks = B.asked(found, lambda packed, k: B.word_lists(dictionary(packed), k), shards, n)
    return B.finished(found, B.answered(asks, solve), finish, PIECES + ", ids binary" * with_ids)


class Sums:
    """Which single lengths, pairs and triples add up to a total, under counts of what is left.

    A hash index by total holds where its search goes on: the counts only fall,
    so a combination that once wasn't there is never looked at again.
    """

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.left = [0] * (capacity + 1)
        for length, n in counts.items():
            self.left[length] = n
        self.up, self.down = list(range(capacity + 2)), list(range(capacity + 1))  # links over lengths that are used up
        self.pairs: dict[int, int] = {}  # total: the least part of the first pair that may be left
        self.triples: dict[int, int] = {}  # total: the greatest part of the first triple that may be left
        self.none: set[int] = set()  # totals that no pair has

    def above(self, k: int) -> int:
        """The least length from k up that is left, or one beyond all."""
        while k < len(self.left) and not self.left[k]:
            self.up[k] = max(self.up[k], self.up[min(k + 1, len(self.left))])
            k = max(self.up[k], k + 1)
        return k

    def below(self, k: int) -> int:
        """The greatest length from k down that is left, or 0."""
        while k > 0 and not self.left[k]:
            self.down[k] = min(self.down[k], self.down[k - 1])
            k = min(self.down[k], k - 1)
        return k

    def has(self, *parts: int) -> bool:
        return all(self.left[x] >= parts.count(x) for x in parts)

    def pair(self, total: int, *held: int) -> tuple[int, int] | None:
        """The most unequal pair with that sum that is left beside what is held."""
        if total in self.none:
            return None
        k = self.above(self.pairs.get(total, 1))
        while 2 * k <= total and not self.left[total - k]:
            k = self.above(k + 1)
        self.pairs[total] = k
        if 2 * k > total:
            self.none.add(total)
        while 2 * k <= total:
            if self.left[total - k] and self.has(total - k, k, *held):
                return total - k, k
            k = self.above(k + 1)
        return None

    def fill(self, gap: int, held: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill a gap beside a piece that is held; none for the gap 0."""
        if gap == 0:
            return ()
        if self.left[gap] and self.has(gap, held):
            return (gap,)
        if two := self.pair(gap, held):
            return two
        k = self.below(self.triples.get(gap, gap - 2)) if gap > 2 else 0
        while k > 0:
            if two := self.pair(gap - k, k, held):
                self.triples[gap] = k
                return tuple(sorted((k, *two), reverse=True))
            k = self.below(k - 1)
        self.triples[gap] = 0
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, each with the number of sequences that have it; every length is used as often as it is counted."""
    sums = Sums(counts, capacity)
    left = sums.left
    out: list[tuple[tuple[int, ...], int]] = []
    residual: list[tuple[int, tuple[int, ...], int]] = []
    for length in range(capacity, 0, -1):
        while left[length] and (rest := sums.fill(capacity - length, length)) is not None:
            pattern = (length, *rest)
            used = {x: pattern.count(x) for x in pattern}
            times = min(left[x] // n for x, n in used.items())
            for x, n in used.items():
                left[x] -= n * times
            out.append((pattern, times))
        if left[length]:
            residual.append((length, (length,), left[length]))
            left[length] = 0
    return out + _best_fit(residual, capacity)


def _best_fit(residual: list[tuple[int, tuple[int, ...], int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over groups of equal pieces: each goes where it leaves the least room."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length, _, n in residual:
        while n:
            fit = min((r for r in room if r >= length), default=None)
            if fit is None:
                each = capacity // length
                pattern, times = ((length,) * each, n // each) if n >= each else ((length,) * n, 1)
                r, n = capacity - sum(pattern), n - len(pattern) * times
            else:
                old, have = room[fit].pop()
                each = fit // length
                if n < each:
                    each, times = n, 1
                else:
                    times = min(have, n // each)
                if have > times:
                    room[fit].append((old, have - times))
                if not room[fit]:
                    del room[fit]
                pattern = old + (length,) * each
                r, n = fit - length * each, n - each * times
            room.setdefault(r, []).append((pattern, times))
    return [x for same in room.values() for x in same]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: the first rank of each run of ranks, the sequence of that rank, and the offset there."""
    taken: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            at = taken.get(length, 0)
            rows.setdefault(length, []).append((at, sequence, offset))
            taken[length] = at + times
            offset += length
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in rows.items()}


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = docs.sparkSession
    cutted = cut(pieces(docs, path, capacity, end))
    counts = {r[0]: r[1] for r in cutted.groupBy("length").count().collect()}  # at most capacity rows
    if not counts:
        return cutted.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    found = places(plan(counts, capacity))
    blocks = max(DEALS * B.partitions(docs), -(-max(counts.values()) // RANKED))
    dealt = cutted.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    each = dealt.groupBy("length", "deal").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = each.select("length", "deal", before.alias("base"))
    # Ranks are counted within the pieces of one length and one deal; the deals follow the most frequent length.
    within = Window.partitionBy("length", "deal").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(base, ["length", "deal"]).withColumn("rank", F.col("rank") + F.col("base"))
    held = spark.sparkContext.broadcast(found)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for value, part in B.split_by_shard(length):
                first, seq, at = held.value[value]
                k = np.searchsorted(first, rank[part], side="right") - 1
                sequence[part], offset[part] = seq[k] + rank[part] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
