"""Documents in blocks, and exchanges between blocks and key shards.

A map task gathers documents into blocks of bounded bytes and reduces each to
arrays: a dictionary of its distinct words (or chunks) and the documents as
indices into it. Blocks are dealt out once. Each block asks the shards that own
its keys, in packed arrays and not a row a key; a shard sees each key once a
block at most, so a frequent key is no hot key, and no group of copies meets in
one task. Answers return to the block and are joined there by position.

A block's id is the task's partition with a running number, so the documents
must come from a scan that gives the same rows to the same partition when a lost
task is run again (files do); the blocks themselves are read from one shuffle by
all later steps.
"""

from __future__ import annotations

import ctypes
import pickle
import time
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Bytes of text in a block; a single longer document is a block of its own.
BLOCK_BYTES = 4 << 20

#: Shards for each shuffle partition at least, and bytes of scanned files for each shard at most.
SHARDS, SHARD_BYTES = 3, 64 << 20

#: Seconds between two times that a worker gives memory back.
RELEASE_S = 0.5

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32

BLOCK_SCHEMA = "block long, dictionary binary, body binary"
ASK_SCHEMA = "shard int, block long, asked binary"
ANSWER_SCHEMA = "block long, shard int, answer binary"


_released = [0.0]


def release(after: float = RELEASE_S) -> None:
    """Give freed memory back to the system, as workers that wait for their next task keep it else."""
    now = time.monotonic()
    if now - _released[0] >= after:
        pa.default_memory_pool().release_unused()
        if hasattr(ctypes.pythonapi, "malloc_trim"):
            ctypes.pythonapi.malloc_trim(0)
        _released[0] = now


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with memory given back at times and at the end."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch
            release()
        release(0)

    return out


class Written(NamedTuple):
    """A table as an Arrow stream, which holds a slice's rows only; pickle would write all that it is a slice of."""

    data: bytes


def pack(*parts: Any, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps([_written(p) if isinstance(p, pa.Table) else p for p in parts], protocol=5))


def _written(t: pa.Table) -> Written:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as out:
        out.write_table(t)
    return Written(sink.getvalue().to_pybytes())


def unpack(data: bytes) -> tuple:
    parts = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
    return tuple(pa.ipc.open_stream(p.data).read_all() if isinstance(p, Written) else p for p in parts)


def tight(a: np.ndarray) -> np.ndarray:
    """Numbers from 0 up, in as few bytes as the largest needs."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def text_blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Rows of batches, gathered or cut into tables of about that many bytes of text."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < len(lengths):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size - n, side="right")))
            held.append(batch.slice(at, to - at))
            n += int(ends[to - 1] - before)
            at = to
            if n >= size or at < len(lengths):
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


class Words(NamedTuple):
    """Words of the texts of a block: each word's number in distinct, and where each text's words begin."""

    index: np.ndarray
    offsets: np.ndarray
    distinct: pa.Array

    @property
    def of_text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def encoded(array: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = array.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int32), found.dictionary


def words(offsets: np.ndarray, data: np.ndarray, stops: np.ndarray | None = None) -> Words:
    """Runs of bytes other than space and 9 to 13. stops: a mask of bytes; a run is cut before one that follows an ASCII letter."""
    solid = ~SPACE[data]
    first = np.flatnonzero(np.diff(offsets)).astype(np.int64)  # texts that have bytes
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    start[offsets[first]] = solid[offsets[first]]
    if stops is not None:
        start[1:] |= stops[data[1:]] & LETTER[data[:-1]]
    at = np.flatnonzero(start)
    solid_before = np.concatenate([[0], np.cumsum(solid)])
    cuts = np.append(solid_before[at], solid_before[-1])
    index, distinct = encoded(strings(data[solid], cuts))
    return Words(index, np.searchsorted(at, offsets), distinct)


def chunks(offsets: np.ndarray, data: np.ndarray, stops: np.ndarray | None = None) -> Words:
    """The texts cut before each run of ASCII white space, and before a byte of stops that follows an ASCII letter; nothing is left out."""
    space = SPACE[data]
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[offsets[np.flatnonzero(np.diff(offsets))]] = True
    if stops is not None:
        start[1:] |= stops[data[1:]] & LETTER[data[:-1]]
    at = np.flatnonzero(start)
    index, distinct = encoded(strings(data, np.append(at, len(data))))
    return Words(index, np.searchsorted(at, offsets), distinct)


def hashes(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string."""
    return np.fromiter((xxhash.xxh3_64_intdigest(x, seed) for x in raw(distinct)), np.uint64, len(distinct))


def raw(distinct: pa.Array) -> list[bytes]:
    """The strings' bytes, cut from one buffer; to_pylist makes a scalar of each first."""
    if not len(distinct):
        return []
    plain = distinct.cast(pa.large_binary())
    at = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
    data = plain.buffers()[2]
    data, at = data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes() if data is not None else b"", (at - at[0]).tolist()
    return [data[lo:hi] for lo, hi in zip(at, at[1:], strict=False)]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def mapped(df: DataFrame, columns: tuple[str, ...], make: Callable[[pa.Table], tuple[bytes, bytes]], n: int | None, size: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of df's rows, dealt over n partitions (left where they are if that is None); make gives a block's dictionary and body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, t in enumerate(text_blocks(batches, size)):
            dictionary, body = make(t)
            yield pa.RecordBatch.from_pydict({"block": pa.array([part << 32 | k], pa.int64()), "dictionary": [dictionary], "body": [body]}, schema=_schema(("block", pa.int64()), ("dictionary", pa.binary()), ("body", pa.binary())))

    made = df.select(*columns).mapInArrow(releasing(run), BLOCK_SCHEMA)
    return made if n is None else made.repartition(n, "block")


def _schema(*fields: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(fields))


def asked(blocks: DataFrame, ask: Callable[[tuple, int], Iterator[tuple[int, bytes]]], shards: int, n: int, with_body: bool = False) -> DataFrame:
    """What the blocks ask: ask gets a block's unpacked dictionary (or body) and the number of shards and gives shards and packed keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("body" if with_body else "dictionary"), strict=True):
                got = list(ask(unpack(data.as_py()), shards))
                yield pa.RecordBatch.from_pydict(
                    {"shard": [s for s, _ in got], "block": [block] * len(got), "asked": [a for _, a in got]}, schema=_schema(("shard", pa.int32()), ("block", pa.int64()), ("asked", pa.binary()))
                )

    return blocks.mapInArrow(releasing(run), ASK_SCHEMA)  # of all columns, so that the blocks' shuffle is the same one for all steps


def answered(asks: DataFrame, solve: Callable[[list[int], list[tuple]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """The shards' answers: solve gets the blocks and their unpacked keys and gives blocks and packed answers."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        order = np.argsort(t.column("block").to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        blocks = t.column("block").to_pylist()
        got = list(solve(blocks, [unpack(x) for x in t.column("asked").to_pylist()]))
        release()
        return pa.Table.from_pydict({"block": [b for b, _ in got], "shard": [shard] * len(got), "answer": [a for _, a in got]}, schema=_schema(("block", pa.int64()), ("shard", pa.int32()), ("answer", pa.binary())))

    return asks.groupBy("shard").applyInArrow(run, ANSWER_SCHEMA)


def finished(blocks: DataFrame, answers: DataFrame, finish: Callable[[tuple, tuple, dict[int, tuple]], pa.Table], schema: str) -> DataFrame:
    """What finish makes of each block's dictionary, body and answers by shard."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        by = {s: unpack(a) for s, a in zip(right.column("shard").to_pylist(), right.column("answer").to_pylist(), strict=True)}
        out = [finish(unpack(d) if d else (), unpack(b), by) for d, b in zip(left.column("dictionary").to_pylist(), left.column("body").to_pylist(), strict=True)]
        release()
        return pa.concat_tables(out)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(shards)).astype(np.int32)


def split_by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard with the positions it owns, in order."""
    if not len(shard):
        return
    order = np.argsort(tight(shard), kind="stable")  # numbers of two bytes at most are sorted by radix
    owned, at = np.unique(shard[order], return_index=True)
    for s, part in zip(owned.tolist(), np.split(order, at[1:]), strict=True):
        yield s, part


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shards(df: DataFrame) -> int:
    """How many shards the keys of a table are dealt to: by the bytes of its files, as the plan knows them, and not fewer than the partitions need."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(SHARDS * partitions(df), min(size, 1 << 50) // SHARD_BYTES if size < 1 << 60 else 0)


def word_lists(distinct: pa.Array, shards: int) -> Iterator[tuple[int, bytes]]:
    """A dictionary's strings, packed by the shard that owns them."""
    for s, part in split_by_shard(shard_of(hashes(distinct), shards)) if len(distinct) else ():
        yield s, pack(*_plain(distinct.take(pa.array(part))), level=3)


def _plain(array: pa.Array) -> tuple[np.ndarray, bytes]:
    offsets, data = buffers(array)
    return tight(np.diff(offsets)), data.tobytes()


def merged(lists: list[tuple]) -> tuple[list[np.ndarray], pa.Array]:
    """Of the lists that word_lists packed: each list as numbers, and the distinct strings."""
    lengths = [x[0] for x in lists]
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths), dtype=np.int64)])
    index, distinct = encoded(strings(np.frombuffer(b"".join(x[1] for x in lists), np.uint8), offsets))
    return np.split(index, np.cumsum([len(x) for x in lengths])[:-1]), distinct


def rows_by_word(distinct: pa.Array, shards: int, by: dict[int, tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Answers (lengths, values, ...) of all shards, as one ragged array in the dictionary's order: starts and lengths into the values in order of shard."""
    starts, lengths = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    base = 0
    for s, part in split_by_shard(shard_of(hashes(distinct), shards)) if len(distinct) else ():
        n = by[s][0].astype(np.int64)
        lengths[part], starts[part] = n, base + np.cumsum(n) - n
        base += int(n.sum())
    return starts, lengths
