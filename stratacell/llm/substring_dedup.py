"""Substring dedup by repeated-phrase automata.

A window is a run of consecutive words. All windows with one least hash among
their shorter runs of words are kept together: neighbours share it, and equal
windows have equal ones. A first exchange between blocks of documents and key
shards (see blocks.py) confirms which of these keys several documents have; a
window of another key is settled. The stretches of words that are left go to the
shard of their key, equal ones of a block once. Each shard compiles its
recurring windows to an Aho-Corasick automaton over word numbers and streams all
stretches, of all documents, through it. Hashes only decide what meets: it is
what the automaton locates that counts, and its smallest document that returns
to the blocks, where windows of later documents are removed. A key that very
many different stretches have (the end of a common passage, which goes on differently in
each) is dealt out window by window, so that no shard holds it alone.

Defined cases: a null text has no words; a text shorter than a window keeps all;
a null doc_id ranks after all others; rows with the same doc_id don't remove
each other's words; an empty table gives an empty result; columns other than
doc_id and text are carried through or ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratacell.llm import blocks as B

#: Words of a window, and of the shorter runs whose least hash stands for it.
WINDOW, RUN = 13, 6

#: Different stretches with one least hash from which on its windows are dealt out one by one.
COMMON = 256

#: Least hashes whose stretches share an automaton.
TOGETHER = 16

#: Stands for a null doc_id.
LATEST = np.iinfo(np.int64).max

#: Bits of a least hash that are sent; a false match costs a second question, nothing else.
SENT_BITS = 48


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(h: np.ndarray, length: int, base: int) -> np.ndarray:
    """A hash of every run of that many values."""
    n = max(len(h) - length + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * np.uint64(base) + h[k : k + n]
    return mixed(out)


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The least value of every run of that many values."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def starts_within(offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window of one text starts, and the text of each."""
    n = np.maximum(np.diff(offsets) - window + 1, 0)
    return B.ragged(offsets[:-1], n), np.repeat(np.arange(len(n)), n)


def packed_keys(keys: np.ndarray, bits: int = 64) -> bytes:
    """Sorted keys as differences, byte by byte, so that leading zeros take no room."""
    d = np.diff(keys, prepend=np.zeros(1, np.uint64)).astype("<u8")
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


class Windows:
    """The windows of a block's texts, neighbours with one least hash together as stretches: start, number of windows, text, key."""

    def __init__(self, table: pa.Table, window: int, run: int) -> None:
        self.window = window
        self.found = B.words(*B.buffers(table.column("text")))
        self.first = pc.fill_null(pc.cast(table.column("doc_id"), pa.int64()), LATEST).to_numpy()
        at, text = starts_within(self.found.offsets, window)
        if not len(at):
            self.start, self.n, self.text, self.keys, self.key = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return
        self.h = B.hashes(self.found.distinct)[self.found.index]
        small = least(runs(self.h, run, 0x9E3779B97F4A7C15), window - run + 1)[at]
        new = np.ones(len(at), bool)
        new[1:] = (small[1:] != small[:-1]) | (text[1:] != text[:-1])
        head = np.flatnonzero(new)
        self.start, self.text, self.n = at[head], text[head], np.diff(np.append(head, len(at)))
        self.keys, self.key = np.unique(small[head] >> np.uint64(64 - SENT_BITS), return_inverse=True)

    def asked(self, shards: int) -> Iterator[tuple[int, bytes]]:
        whole = runs(self.h, self.window, 0xD6E8FEB86659FD93) if len(self.key) else np.zeros(0, np.uint64)
        return keys_asked(self.keys, self.key, self.first, self.text, whole[self.start] ^ mixed(whole[self.start + self.n - 1]), shards)

    def kinds(self, by: dict[int, tuple], shards: int) -> np.ndarray:
        return kinds_answered(self.keys, self.key, by, shards)

    def spelled(self, start: np.ndarray, size: np.ndarray) -> pa.Array:
        """Runs of words as text, a space after each word."""
        offsets, data = B.buffers(self.found.distinct)
        n = np.diff(offsets)
        spaced = np.full(len(data) + len(n), 32, np.uint8)
        spaced[B.ragged(offsets[:-1] + np.arange(len(n)), n)] = data
        word = self.found.index[B.ragged(start, size)]
        ends = np.concatenate([[0], np.cumsum(n[word] + 1)])
        return B.strings(spaced[B.ragged((offsets[:-1] + np.arange(len(n)))[word], n[word] + 1)], ends[np.concatenate([[0], np.cumsum(size)])])


def keys_asked(keys: np.ndarray, key: np.ndarray, first: np.ndarray, text: np.ndarray, content: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """A block's keys by shard, with the numbers (255 at most) of its documents and of its different stretches that have each; key, text and content are those of its stretches, first of its texts."""
    n = len(keys)
    distinct, document = np.unique(first, return_inverse=True)
    width = np.uint64(max(n - 1, 1).bit_length())
    apart = (key * len(distinct) + document[text], key.astype(np.uint64) << (np.uint64(64) - width) | content >> width)
    several = [np.minimum(np.bincount(k, minlength=n), 255).astype(np.uint8) for k in (_distinct(apart[0]) // max(len(distinct), 1), (_distinct(apart[1]) >> (np.uint64(64) - width)).astype(np.int64))]
    for s, part in B.split_by_shard((keys % np.uint64(shards)).astype(np.int32)):
        yield s, B.pack(packed_keys(keys[part]), several[0][part], several[1][part])


def _distinct(x: np.ndarray) -> np.ndarray:
    """np.unique, which since NumPy 2.3 may hash and not sort."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def kinds_answered(keys: np.ndarray, key: np.ndarray, by: dict[int, tuple], shards: int) -> np.ndarray:
    """0 for stretches whose key no other document has, 1 for those that may recur, 2 for those of a common key."""
    out = np.zeros(len(keys), np.uint8)
    for s, part in B.split_by_shard((keys % np.uint64(shards)).astype(np.int32)):
        out[part] = by[s][0]
    return out[key] if len(keys) else out


def which_recur(of: list[int], lists: list[tuple]) -> Iterator[tuple[int, bytes]]:
    keys = [unpacked_keys(x[0]) for x in lists]
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    documents, different = (np.bincount(at, weights=np.concatenate([x[k] for x in lists])) for k in (1, 2))
    common = (different >= COMMON) & (different >= 2 * np.bincount(at))  # copies of one stretch are one question a block, and so not many
    kind = (1 * (documents > 1) + 1 * common).astype(np.uint8)
    for block, part in zip(of, np.split(kind[at], np.cumsum([len(k) for k in keys])[:-1]), strict=True):
        yield block, B.pack(part)


class Questions:
    """The block's distinct stretches (or single windows, of common keys) that may recur, and where each window's answer is."""

    def __init__(self, own: Windows, kind: np.ndarray, shards: int) -> None:
        some, common = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
        self.start = np.append(own.start[some], B.ragged(own.start[common], own.n[common]))
        self.n = np.append(own.n[some], np.ones(len(self.start) - len(some), np.int64))
        of = np.append(some, np.repeat(common, own.n[common]))
        self.text, single = own.text[of], kind[of] == 2
        found = own.spelled(self.start, self.n + own.window - 1).dictionary_encode()
        self.index, self.distinct = found.indices.to_numpy().astype(np.int64), found.dictionary
        m = len(self.distinct)
        self.first, self.last, self.count, home = np.full(m, LATEST), np.full(m, np.iinfo(np.int64).min), np.zeros(m, np.int64), np.zeros(m, np.uint64)
        np.minimum.at(self.first, self.index, own.first[self.text])
        np.maximum.at(self.last, self.index, own.first[self.text])
        self.count[self.index] = self.n
        home[self.index] = mixed(own.keys[own.key[of]])
        if single.any():
            hot = np.unique(self.index[single])
            home[hot] = B.hashes(self.distinct.take(pa.array(hot)))
        self.shard = B.shard_of(home, shards)

    def asked(self) -> Iterator[tuple[int, bytes]]:
        for s, part in B.split_by_shard(self.shard):
            size, data = B._plain(self.distinct.take(pa.array(part)))
            yield s, B.pack(size, data, self.first[part], np.packbits(self.first[part] != self.last[part]), level=3)

    def removed(self, own: Windows, by: dict[int, tuple]) -> np.ndarray:
        """A mask of the block's words: those in a window that starts in an earlier document."""
        covered = np.zeros(len(own.found.index) + 1, np.int64)
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


def located(stretches: pa.Array, first: np.ndarray, several: np.ndarray, window: int, run: int) -> np.ndarray:
    """For every window of distinct stretches, in order, the smallest document that has it; LATEST if it recurs in none.

    Windows that hashes propose as recurring (in two stretches, or in one that
    several documents have) are the phrases of Aho-Corasick automata over word
    numbers. All stretches stream through the one of their least hash; what it
    locates, and nothing else, counts as an occurrence. An automaton holds
    stretches of few least hashes only, as each of its steps at the root goes
    through all words that a phrase begins with.
    """
    found = B.words(*B.buffers(stretches))
    at, of = starts_within(found.offsets, window)
    out = np.full(len(at), LATEST)
    if not len(at):
        return out
    name = runs(mixed(found.index.astype(np.uint64) + np.uint64(1)), window, 0xD6E8FEB86659FD93)[at]
    _, one, number, times = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
    shared = times > 1
    shared[number[several[of]]] = True
    same = np.ones(len(at), bool)
    for k in range(window):
        same &= found.index[at + k] == found.index[at[one][number] + k]
    phrase_at = np.append(one[shared], np.flatnonzero(shared[number] & ~same))  # one of each hash, and what shares a hash but not its words
    if not len(phrase_at):
        return out
    # Equal windows have one least hash, and all windows of a stretch have it.
    small = runs(B.hashes(found.distinct)[found.index], run, 0x9E3779B97F4A7C15)
    begins = found.offsets[:-1]
    small = np.minimum.reduce([small[np.minimum(begins + k, len(small) - 1)] for k in range(window - run + 1)])
    part = np.unique(small, return_inverse=True)[1] // TOGETHER
    recur = np.flatnonzero(np.bincount(of, weights=shared[number], minlength=len(first)) > 0)
    recur = recur[np.argsort(part[recur], kind="stable")]
    phrase_at = phrase_at[np.argsort(part[of[phrase_at]], kind="stable")]
    ends = np.flatnonzero(np.diff(part[recur], append=-1)) + 1
    phrase_ends = np.searchsorted(part[of[phrase_at]], part[recur][ends - 1], side="right").tolist()
    index, words_at = found.index.tolist(), at[phrase_at].tolist()
    spans = list(zip(begins[recur].tolist(), found.offsets[1:][recur].tolist(), strict=True))
    where: list[int] = []
    which: list[int] = []
    phrases = lo_phrase = lo_span = 0
    for hi_span, hi_phrase in zip(ends.tolist(), phrase_ends, strict=True):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for i in words_at[lo_phrase:hi_phrase]:
            key = tuple(index[i : i + window])
            if key not in automaton:
                automaton.add_word(key, phrases)
                phrases += 1
        automaton.make_automaton()
        for lo, hi in spans[lo_span:hi_span]:
            for end, phrase in automaton.iter(tuple(index[lo:hi])):
                where.append(lo + end)
                which.append(phrase)
        lo_span, lo_phrase = hi_span, hi_phrase
    place = np.full(len(found.index), -1, np.int64)
    place[at] = np.arange(len(at))
    hit, phrase = place[np.array(where, np.int64) - window + 1], np.array(which, np.int64)
    smallest = np.full(phrases, LATEST)
    np.minimum.at(smallest, phrase, first[of[hit]])
    out[hit] = smallest[phrase]
    return out


def smallest_of(window: int, run: int) -> Callable[[list[int], list[tuple]], Iterator[tuple[int, bytes]]]:
    def solve(of: list[int], lists: list[tuple]) -> Iterator[tuple[int, bytes]]:
        size = np.concatenate([x[0] for x in lists]).astype(np.int64)
        found = B.strings(np.frombuffer(b"".join(x[1] for x in lists), np.uint8), np.concatenate([[0], np.cumsum(size)])).dictionary_encode()
        index, distinct = found.indices.to_numpy().astype(np.int64), found.dictionary
        first = np.full(len(distinct), LATEST)
        np.minimum.at(first, index, np.concatenate([x[2] for x in lists]))
        several = np.bincount(index, minlength=len(distinct)) > 1
        several[index[np.concatenate([np.unpackbits(x[3], count=len(x[0])) for x in lists]).astype(bool)]] = True
        doc = located(distinct, first, several, window, run)
        n = np.diff(B.words(*B.buffers(distinct)).offsets) - window + 1
        begin = np.cumsum(n) - n
        for block, part in zip(of, np.split(index, np.cumsum([len(x[0]) for x in lists])[:-1]), strict=True):
            yield block, B.pack(doc[B.ragged(begin[part], n[part])])

    return solve


def substring_dedup(docs: DataFrame, finish: Callable[[pa.Table, list[bytes], np.ndarray, np.ndarray], pa.Table], schema: str | T.StructType, carry: tuple[str, ...] = (), window: int = WINDOW, run: int = RUN) -> DataFrame:
    """What finish makes of a block's rows (doc_id, text and carry), kept words joined by a space, numbers of words, and numbers removed."""
    n = B.partitions(docs)
    shards = B.shards(docs)
    make = lambda t: (b"", B.pack(t, level=3))
    found = B.mapped(docs, ("doc_id", "text", *carry), make, n)

    def ask(body: tuple, k: int) -> Iterator[tuple[int, bytes]]:
        return Windows(body[0], window, run).asked(k)

    answers = B.answered(B.asked(found, ask, shards, n, with_body=True), which_recur)

    def questions(table: pa.Table, by: dict[int, tuple]) -> tuple[Windows, Questions]:
        own = Windows(table, window, run)
        return own, Questions(own, own.kinds(by, shards), shards)

    def confirm(left: pa.Table, right: pa.Table) -> pa.Table:
        by = _answers(right)
        rows: list[tuple[int, int, bytes]] = []
        for block, body in zip(left.column("block").to_pylist(), left.column("body").to_pylist(), strict=True):
            rows += [(s, block, a) for s, a in questions(B.unpack(body)[0], by)[1].asked()]
        B.release()
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.int64()), "asked": pa.array([r[2] for r in rows], pa.binary())})

    asked = found.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(confirm, B.ASK_SCHEMA)
    second = B.answered(asked, smallest_of(window, run)).withColumn("shard", (F.col("shard") + shards).cast("int"))

    def end(left: pa.Table, right: pa.Table) -> pa.Table:
        by = _answers(right)
        out = []
        for body in left.column("body").to_pylist():
            table = B.unpack(body)[0]
            w, asked_ = questions(table, by)
            gone = asked_.removed(w, {s - shards: x for s, x in by.items() if s >= shards})
            distinct = B.raw(w.found.distinct)
            kept, sizes, removed = [], np.diff(w.found.offsets), np.zeros(len(w.found.offsets) - 1, np.int64)
            for i, (lo, hi) in enumerate(zip(w.found.offsets[:-1].tolist(), w.found.offsets[1:].tolist(), strict=True)):
                removed[i] = int(gone[lo:hi].sum())
                kept.append(b" ".join([distinct[k] for k in w.found.index[lo:hi][~gone[lo:hi]].tolist()]))
            out.append(finish(table, kept, sizes, removed))
        B.release()
        return pa.concat_tables(out)

    every = answers.unionByName(second)
    return found.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(end, schema)


def _answers(t: pa.Table) -> dict[int, tuple]:
    return {s: B.unpack(a) for s, a in zip(t.column("shard").to_pylist(), t.column("answer").to_pylist(), strict=True)}


def kept_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row of docs."""

    def finish(table: pa.Table, kept: list[bytes], sizes: np.ndarray, removed: np.ndarray) -> pa.Table:
        return pa.table({"doc_id": pc.cast(table.column("doc_id"), pa.int64()), "n_words": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    return substring_dedup(docs, finish, "doc_id long, n_words long, n_removed long, kept_text string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(table: pa.Table, kept: list[bytes], sizes: np.ndarray, removed: np.ndarray) -> pa.Table:
        return pa.table(
            {"doc_id": pc.cast(table.column("doc_id"), pa.int64()), "n_words": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
        )

    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(doc_id, 9223372036854775807) AS place, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT row, place, i, min(place) OVER (PARTITION BY md5(array_to_string(list_slice(w, i, i + 12), ' '))) AS first
  FROM (SELECT row, place, w, unnest(range(1, len(w) - 11)) AS i FROM d)
), gone AS (
  SELECT DISTINCT row, unnest(range(i, i + 13)) AS p FROM starts WHERE first < place
), each AS (
  SELECT row, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT row, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM each ANTI JOIN gone USING (row, p) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (row)
"""
