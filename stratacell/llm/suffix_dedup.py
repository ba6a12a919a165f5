"""Dedup of repeated byte strings by suffix arrays of a difference cover.

A window is a run of bytes. All windows with one least hash among their shorter
runs are kept together: neighbouring windows share it, and equal windows have
equal ones. A first exchange (see blocks.py) settles the windows whose least
hash no other document has, which are not sorted at all. The rest, as stretches
of text, go to the shard of their hash, equal stretches once. Each shard sorts
the suffixes of those that share a window's hash with a different one, in parts
of whole least hashes, by the difference cover of modulo three: triples
at two of three positions are sorted and named, names are sorted by recursion,
the third kind is sorted by its first byte and its neighbour's rank, and the two
are merged. Adjacent suffixes are compared byte by byte over a window; equal
ones form a group, and its smallest doc_id returns to the blocks. A hash that
very many different stretches have (a common passage that goes on differently
in each) is dealt out window by window, so that no shard holds it alone.

Defined cases: a null text counts as empty; a text shorter than a window keeps
all; a null doc_id ranks after all others; rows with the same doc_id don't
remove each other's bytes; an empty table gives an empty result; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacell.llm import blocks as B
from stratacell.llm.substring_dedup import LATEST, SENT_BITS, _answers, keys_asked, kinds_answered, least, mixed, starts_within, which_recur

#: Bytes of a window, and of the shorter runs whose least hash stands for it.
WINDOW, RUN = 50, 24

#: Bytes of text in a block; arrays over positions take many times as much.
BLOCK = 2 << 20

#: Values that are hashed at once.
PIECE = 1 << 14

#: Bytes of stretches that are sorted together; more if so many share one least hash.
PART = 1 << 18


@cache
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo two to the 64."""
    out = np.ones((2, n), np.uint64)
    for row, x in zip(out, (base, pow(base, -1, 2**64)), strict=True):
        row[1:] = np.cumprod(np.full(n - 1, x, np.uint64))
    return out[0], out[1]


def rolled(x: np.ndarray, length: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of every run of that many values, from differences of running sums; by pieces that stay in the cache."""
    n = max(len(x) - length + 1, 0)
    out = np.empty(n, np.uint64)
    power, inverse = _powers(base % 2**64, PIECE + length)
    for lo in range(0, n, PIECE):
        part = x[lo : lo + PIECE + length - 1].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=sums[1:])
        h = sums[length:] - sums[:-length]
        out[lo : lo + PIECE] = mixed(h * inverse[: len(h)])
    return out


def leasts(h: np.ndarray, width: int) -> np.ndarray:
    """The least value of every run of that many values, by pieces."""
    out = np.empty(max(len(h) - width + 1, 0), h.dtype)
    for lo in range(0, len(out), PIECE):
        out[lo : lo + PIECE] = least(h[lo : lo + PIECE + width - 1], width)
    return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a sequence of positive numbers, in order."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    sample = np.arange(n + (n % 3 == 1))
    sample = sample[sample % 3 != 0]
    one, two = sample[sample % 3 == 1], sample[sample % 3 == 2]
    sample = np.concatenate([one, two])
    top = int(t.max()) + 1
    if top**3 < 2**62:
        triple = (t[sample] * top + t[sample + 1]) * top + t[np.minimum(sample + 2, n + 2)]
    else:
        pair = np.unique(t[sample] * top + t[sample + 1], return_inverse=True)[1].astype(np.int64)
        triple = pair * top + t[np.minimum(sample + 2, n + 2)]
    order = np.argsort(triple)
    new = np.append(True, np.diff(triple[order]) != 0)
    if not new.all():
        name = np.empty(len(sample), np.int64)
        name[order] = np.cumsum(new)
        order = suffix_array(name)
    sorted_sample = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[sorted_sample] = np.arange(1, len(sample) + 1)
    rank[n + 1 :] = 0
    rest = np.arange(0, n, 3)
    ones, twos = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    if n % 3 == 1:
        ones, sorted_sample = ones[ones != n], sorted_sample[sorted_sample != n]
    many = len(sample) + 2
    key = t[rest] * many + rank[rest + 1]
    order = np.argsort(key)  # all differ
    first, second = rest[order], np.concatenate([rest[order], twos])
    pair = t[second] * top + t[second + 1]
    if top**2 * many >= 2**62:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    far = pair * many + rank[second + 2]
    before = np.searchsorted(t[ones] * many + rank[ones + 1], key[order]) + np.searchsorted(far[len(rest) :], far[: len(rest)])
    out = np.full(n, -1, np.int64)
    out[np.arange(len(rest)) + before] = first
    out[out < 0] = sorted_sample
    return out


def groups(stretches: pa.Array, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct stretches with their smallest documents: for every window, in order, the smallest document that has it; and where each stretch's windows begin."""
    offsets, data = B.buffers(stretches)
    size = np.diff(offsets)
    at = offsets[:-1] + np.arange(len(size))  # a separator after each
    text = np.ones(len(data) + len(size), np.int64)
    text[B.ragged(at, size)] = data.astype(np.int64) + 2
    n = size - window + 1
    begin = np.cumsum(n) - n
    start = B.ragged(at, n)
    number = np.full(len(text), -1, np.int64)
    number[start] = np.arange(len(start))
    order = suffix_array(text)
    order = order[number[order] >= 0]
    raw = (text - 2).astype(np.uint8)
    new = np.zeros(len(order), bool)
    new[:1] = True
    wide = min(window, 8)  # bytes that are compared at once
    words = np.lib.stride_tricks.sliding_window_view(raw, wide).view(f"V{wide}")[:, 0] if wide < 8 else np.ndarray(max(len(raw) - 7, 0), np.uint64, raw, strides=(1,))
    for k in (*range(0, window - wide, wide), window - wide) if len(order) else ():
        part = words[order + k]
        new[1:] |= part[1:] != part[:-1]
    heads = np.flatnonzero(new)
    doc = np.repeat(first, n)[number[order]]
    smallest = np.minimum.reduceat(doc, heads) if len(heads) else doc
    out = np.empty(len(start), np.int64)
    out[number[order]] = smallest[np.cumsum(new) - 1]
    return out, begin


class Stretches:
    """The windows of a block's texts, neighbours with one least hash together: start, number of windows, text, key."""

    def __init__(self, table: pa.Table, window: int, run: int) -> None:
        self.window = window
        self.offsets, self.data = B.buffers(table.column("text"))
        self.first = pc.fill_null(pc.cast(table.column("doc_id"), pa.int64()), LATEST).to_numpy()
        size = np.diff(self.offsets)
        n = np.maximum(size - window + 1, 0)
        if not n.any():
            self.start, self.n, self.text, self.keys, self.key = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return
        self.runs, self.run = rolled(self.data, run), run
        small = leasts(self.runs, window - run + 1)
        new = np.ones(len(small), bool)
        new[1:] = small[1:] != small[:-1]
        new[self.offsets[:-1][n > 0]] = True
        none = B.ragged(self.offsets[:-1] + n, size - n)  # a window that starts here would leave its text
        new[none[none < len(new)]] = False
        self.start = np.flatnonzero(new)
        ends = np.append(self.start[1:], 0)
        bound = np.searchsorted(self.start, self.offsets)
        ends[bound[1:][n > 0] - 1] = (self.offsets[:-1] + n)[n > 0]
        self.n, self.text = ends - self.start, np.repeat(np.arange(len(n)), np.diff(bound))
        self.keys, self.key = np.unique(small[self.start] >> np.uint64(64 - SENT_BITS), return_inverse=True)

    def asked(self, shards: int) -> Iterator[tuple[int, bytes]]:
        content = np.zeros(len(self.key), np.uint64)
        if len(self.key):
            reach = self.window - self.run
            for begin in (self.start, self.start + self.n - 1):  # the first and the last window, from runs that cover them
                for k in (*range(0, reach, self.run), reach):
                    content = mixed(content ^ self.runs[begin + k]) + np.uint64(1)
        return keys_asked(self.keys, self.key, self.first, self.text, content, shards)

    def kinds(self, by: dict[int, tuple], shards: int) -> np.ndarray:
        return kinds_answered(self.keys, self.key, by, shards)


class Questions:
    """The block's distinct stretches (or single windows, of common hashes) that may recur, and where each window's answer is."""

    def __init__(self, own: Stretches, by: dict[int, tuple], shards: int, homes: int) -> None:
        kind = own.kinds(by, shards)
        some, common = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
        start = np.append(own.start[some], B.ragged(own.start[common], own.n[common]))
        n = np.append(own.n[some], np.ones(len(start) - len(some), np.int64))
        of = np.append(some, np.repeat(common, own.n[common]))
        self.start, self.n, self.text, single = start, n, own.text[of], kind[of] == 2
        size = n + own.window - 1
        bytes_ = own.data[B.ragged(start, size)]
        found = B.strings(bytes_, np.concatenate([[0], np.cumsum(size)])).cast(pa.large_binary(), safe=False).dictionary_encode() if len(size) else None
        self.index = found.indices.to_numpy().astype(np.int64) if found else np.zeros(0, np.int64)
        self.distinct = found.dictionary if found else pa.array([], pa.large_binary())
        m = len(self.distinct)
        self.first, self.count, home = np.full(m, LATEST), np.zeros(m, np.int64), np.zeros(m, np.uint64)
        np.minimum.at(self.first, self.index, own.first[self.text])
        self.count[self.index] = self.n
        home[self.index] = mixed(own.keys[own.key[of]])
        if single.any():
            hot = np.unique(self.index[single])
            home[hot] = B.hashes(self.distinct.take(pa.array(hot)))
        self.shard = B.shard_of(home, homes)

    def asked(self) -> Iterator[tuple[int, bytes]]:
        for s, part in B.split_by_shard(self.shard):
            size, data = B._plain(self.distinct.take(pa.array(part)).cast(pa.large_string(), safe=False))
            yield s, B.pack(size, data, self.first[part], level=3)

    def removed(self, own: Stretches, by: dict[int, tuple]) -> np.ndarray:
        """A mask of the block's bytes: those in a window that starts in an earlier document."""
        covered = np.zeros(len(own.data) + 1, np.int64)
        if len(self.index):
            at, values, base = np.zeros(len(self.count), np.int64), [], 0
            for s, part in B.split_by_shard(self.shard):
                at[part] = base + np.cumsum(self.count[part]) - self.count[part]
                values.append(by[s][0])
                base += len(values[-1])
            doc = np.concatenate(values)[B.ragged(at[self.index], self.n)]
            later = doc < np.repeat(own.first[self.text], self.n)
            start = B.ragged(self.start, self.n)[later]
            np.add.at(covered, start, 1)
            np.add.at(covered, start + own.window, -1)
        return np.cumsum(covered)[:-1] > 0


def shared(hashed: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Which of n stretches have a window whose hash another one has too; of is each window's stretch."""
    order = np.argsort(hashed)
    equal = hashed[order[1:]] == hashed[order[:-1]]
    # Of a run of equal hashes all count or none does: those whose windows are all of one stretch don't.
    start = np.flatnonzero(np.append(True, ~equal)[: len(order)])
    least_of, most_of = (f.reduceat(of[order], start) if len(start) else start for f in (np.minimum, np.maximum))
    mixed_run = np.repeat(least_of != most_of, np.diff(np.append(start, len(order))))
    found = np.zeros(n, bool)
    found[of[order[mixed_run]]] = True
    return np.flatnonzero(found)


def smallest_of(window: int, run: int) -> Callable[[list[int], list[tuple]], Iterator[tuple[int, bytes]]]:
    def solve(of: list[int], lists: list[tuple]) -> Iterator[tuple[int, bytes]]:
        size = np.concatenate([x[0] for x in lists]).astype(np.int64)
        found = B.strings(np.frombuffer(b"".join(x[1] for x in lists), np.uint8), np.concatenate([[0], np.cumsum(size)])).cast(pa.large_binary(), safe=False).dictionary_encode()
        index, distinct = found.indices.to_numpy().astype(np.int64), found.dictionary
        first = np.full(len(distinct), LATEST)
        np.minimum.at(first, index, np.concatenate([x[2] for x in lists]))
        offsets, data = B.buffers(distinct.cast(pa.large_string(), safe=False))
        n = np.diff(offsets) - window + 1
        begin = np.cumsum(n) - n
        doc = np.repeat(first, n)
        # A stretch that shares no window's hash with another one needs no sorting. The rest are sorted by parts of whole least hashes, as equal windows have one.
        hashed = rolled(data, window)
        at, within = starts_within(offsets, window)
        some = shared(hashed[at], within, len(n))
        if len(some):
            edges = np.stack([offsets[:-1], offsets[:-1] + window - run + 1], axis=1)[some].ravel()  # of each stretch's first window
            inner = np.minimum.reduceat(np.append(rolled(data, run), np.uint64(0)), edges)[::2]
            some, inner = some[np.argsort(inner)], np.sort(inner)
            size = np.diff(offsets)[some]
            last = np.append(inner[1:] != inner[:-1], True)
            filled = np.cumsum(size)
            ends, lo = np.flatnonzero(last) + 1, 0
            while lo < len(some):
                hi = int(ends[min(np.searchsorted(filled[ends - 1], (filled[lo - 1] if lo else 0) + PART), len(ends) - 1)])
                part, lo = some[lo:hi], hi
                doc[B.ragged(begin[part], n[part])] = groups(distinct.take(pa.array(part)).cast(pa.large_string(), safe=False), first[part], window)[0]
        for block, part in zip(of, np.split(index, np.cumsum([len(x[0]) for x in lists])[:-1]), strict=True):
            yield block, B.pack(doc[B.ragged(begin[part], n[part])])

    return solve


def suffix_dedup(docs: DataFrame, finish: Callable[[pa.Table, list[bytes], list[np.ndarray]], pa.Table], schema: str, window: int = WINDOW, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """What finish makes of a block's rows, kept bytes and masks of removed bytes."""
    n = B.partitions(docs)
    shards = homes = B.shards(docs)
    found = B.mapped(docs, ("doc_id", "text"), lambda t: (b"", B.pack(t, level=3)), n, block)
    answers = B.answered(B.asked(found, lambda body, k: Stretches(body[0], window, run).asked(k), shards, n, with_body=True), which_recur)

    def confirm(left: pa.Table, right: pa.Table) -> pa.Table:
        by = _answers(right)
        rows: list[tuple[int, int, bytes]] = []
        for number, body in zip(left.column("block").to_pylist(), left.column("body").to_pylist(), strict=True):
            rows += [(s, number, a) for s, a in Questions(Stretches(B.unpack(body)[0], window, run), by, shards, homes).asked()]
        B.release()
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.int64()), "asked": pa.array([r[2] for r in rows], pa.binary())})

    asked = found.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(confirm, B.ASK_SCHEMA)
    second = B.answered(asked, smallest_of(window, run)).withColumn("shard", (F.col("shard") + shards).cast("int"))

    def end(left: pa.Table, right: pa.Table) -> pa.Table:
        by = _answers(right)
        out = []
        for body in left.column("body").to_pylist():
            table = B.unpack(body)[0]
            own = Stretches(table, window, run)
            gone = Questions(own, by, shards, homes).removed(own, {s - shards: x for s, x in by.items() if s >= shards})
            masks = [gone[lo:hi] for lo, hi in zip(own.offsets[:-1].tolist(), own.offsets[1:].tolist(), strict=True)]
            kept = [own.data[lo:hi][~m].tobytes() for lo, hi, m in zip(own.offsets[:-1].tolist(), own.offsets[1:].tolist(), masks, strict=True)]
            out.append(finish(table, kept, masks))
        B.release()
        return pa.concat_tables(out)

    return found.groupBy("block").cogroup(answers.unionByName(second).groupBy("block")).applyInArrow(end, schema)


def spans(mask: np.ndarray) -> np.ndarray:
    """Starts and ends of the maximal runs of a mask."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edges.reshape(-1, 2)


def kept_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, kept bytes, and the removed spans of every row of docs."""

    def finish(table: pa.Table, kept: list[bytes], masks: list[np.ndarray]) -> pa.Table:
        found = [[{"start": int(a), "end": int(b)} for a, b in spans(m)] for m in masks]
        return pa.table({"doc_id": pc.cast(table.column("doc_id"), pa.int64()), "kept": pa.array(kept, pa.binary()), "spans": pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    return suffix_dedup(docs, finish, "doc_id long, kept binary, spans array<struct<start: long, end: long>>")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(table: pa.Table, kept: list[bytes], masks: list[np.ndarray]) -> pa.Table:
        return pa.table(
            {
                "doc_id": pc.cast(table.column("doc_id"), pa.int64()),
                "n_bytes": pa.array([len(m) for m in masks], pa.int64()),
                "n_removed": pa.array([int(m.sum()) for m in masks], pa.int64()),
                "n_spans": pa.array([len(spans(m)) for m in masks], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            }
        )

    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
