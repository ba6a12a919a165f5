"""Quality classifier: perplexity under a modified Kneser-Ney model of trusted text.

The model is over runs of five bytes of UTF-8, interpolated down to single bytes,
so any script is modelled without folding its characters. It counts the trusted
documents, but for a fifth that is held back. Blocks of documents (see
blocks.py) send their distinct runs with counts to shards; a run's shard is that
of the two bytes before its last one, so a shard holds all that the orders from
three up need, and what is gathered grows with the corpus. Counts of counts, and
the orders one and two (257 times 257 numbers at most), are summed over the
shards. To score, every block of all documents asks the shards for its distinct
runs, which join the shard's counts; log probabilities return to the block,
where each document's perplexity is summed. A language's threshold comes from
the quartiles of the perplexities of the trusted documents that were held back,
kept as counts of thousandths of a nat, which merge; a language with few of them
takes those of all.

Defined cases: a null text counts as empty; an empty text has null perplexity and
is not kept; without trusted text every perplexity is that of equally likely
bytes, and all texts that aren't empty are kept, as without a trusted document
held back; null languages are a group; labels with null doc_id are left out;
repeated rows repeat; an empty table gives an empty result; columns other than
doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratacell.llm import blocks as B
from stratacell.llm.common import cut
from stratacell.llm.substring_dedup import mixed, packed_keys, unpacked_keys

#: Bytes of a run, bits of a symbol, symbols: 256 bytes and the start mark.
ORDER, BITS, SYMBOLS = 5, 9, 257
START = 256

#: Bytes of text in a block; arrays over positions take many times as much.
BLOCK = 3 << 20

#: Least discount, so that no context leaves nothing for what it wasn't seen with.
LEAST_DISCOUNT = 0.1

#: Trusted documents whose ids are broadcast at most; with more, documents and labels are dealt out by id.
BROADCAST_IDS = 2_000_000

#: One trusted document of so many is held back from the counts, for the thresholds.
HELD = 5

#: Trusted documents held back of a language with a threshold of its own; a threshold is the upper quartile plus REACH times the quartiles' distance, and LEAST nats at least.
LANGUAGE, REACH, LEAST = 100, 3, 0.25

COUNTS = "shard int, runs binary"
PARTS = "level int, key long, n long"


def grams(offsets: np.ndarray, data: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The run that ends with each byte; before a text stand start marks."""
    n = np.diff(offsets)
    padded = np.full(len(data) + (order - 1) * len(n), START, np.uint64)
    at = np.arange(len(data)) + (order - 1) * np.repeat(np.arange(len(n)), n)
    padded[at + order - 1] = data
    out = np.zeros(len(data), np.uint64)
    for k in range(order):
        out = out << np.uint64(BITS) | padded[at + k]
    return out


def tail(g: np.ndarray, order: int) -> np.ndarray:
    return g & np.uint64((1 << BITS * order) - 1)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """id, held of the trusted documents."""
    ids = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id")).distinct()
    return cut(ids.select("id", held_back(F.col("id")).alias("held")))


def held_back(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD == 0


def _side(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _runs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where texts begin, the distinct runs in order, and each byte's run by number."""
    offsets, data = B.buffers(table.column("text"))
    at, found = pd.factorize(grams(offsets, data))  # by a hash table: runs are many, different ones few
    order = np.argsort(found)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    return offsets, found[order], place[at]


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the two symbols before the last one."""
    return B.shard_of(mixed(tail(keys, 3) >> np.uint64(BITS)), shards)


def counted(docs: DataFrame, ids: DataFrame, shards: int) -> DataFrame:
    """shard and the packed runs with their counts in the trusted documents that aren't held back."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(_side(ids.filter("NOT held")), F.col("doc_id") == F.col("id"), "left_semi")

    def ask(packed: tuple, k: int) -> Iterator[tuple[int, bytes]]:
        _, keys, at = _runs(packed[0])
        counts = np.bincount(at, minlength=len(keys))
        for s, part in B.split_by_shard(_shard(keys, k)):
            yield s, B.pack(packed_keys(keys[part]), B.tight(counts[part]))

    def total(key: tuple, t: pa.Table) -> pa.Table:
        got = [B.unpack(x) for x in t.column("asked").to_pylist()]
        keys, at = np.unique(np.concatenate([unpacked_keys(k) for k, _ in got]), return_inverse=True)
        c = np.bincount(at, weights=np.concatenate([c for _, c in got]), minlength=len(keys)).astype(np.int64)
        B.release()
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "runs": pa.array([B.pack(packed_keys(keys), B.tight(c))], pa.binary())})

    # Sums of counts are the same however the rows fall into blocks, so these needn't be a scan's.
    asks = B.asked(B.mapped(own, ("text",), lambda t: (b"", B.pack(t, level=-1)), None, BLOCK), ask, shards, 0, with_body=True)
    return cut(asks.groupBy("shard").applyInArrow(total, COUNTS))


def shorter(keys: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs one symbol shorter, and how many different symbols stand before each."""
    return np.unique(tail(keys, order - 1), return_counts=True)


def orders(keys: np.ndarray, counts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of a shard's runs: the runs of each order from three up, with their counts."""
    out = {ORDER: (keys, counts)}
    for k in range(ORDER - 1, 2, -1):
        out[k] = shorter(out[k + 1][0], k + 1)
    return out


def unpacked(runs: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = B.unpack(runs)
    return unpacked_keys(keys), counts.astype(np.int64)


class Model:
    """What all shards share: discounts by order, and the probabilities of the order two, for every pair of symbols."""

    def __init__(self, parts: list[tuple[int, int, int]]) -> None:
        of_counts = {k: np.zeros(5) for k in range(1, ORDER + 1)}
        two = np.zeros((SYMBOLS, SYMBOLS), np.int64)
        for level, key, n in parts:
            if level == 2:
                two[key >> BITS, key & (1 << BITS) - 1] = n
            else:
                of_counts[level][key] = n
        one = (two > 0).sum(axis=0)
        for k, c in ((2, two), (1, one)):
            of_counts[k][1:] = [(c == j).sum() for j in (1, 2, 3, 4)]
        self.taken = {k: discounts(n) for k, n in of_counts.items()}
        p = np.full(SYMBOLS, 1 / SYMBOLS)
        for k, c in ((1, one[None, :]), (2, two)):
            total, less = c.sum(axis=1, keepdims=True), self.less(k, c)
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(total > 0, (c - less) / total + less.sum(axis=1, keepdims=True) / total * p, p)
            p = p[0] if k == 1 else p
        self.two = p

    def less(self, order: int, counts: np.ndarray) -> np.ndarray:
        """What is taken from counts."""
        return np.minimum(self.taken[order][np.minimum(counts, 3)], counts)

    def probabilities(self, keys: np.ndarray, seen: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of runs that are all of one shard, given its counts."""
        pair = tail(keys, 2).astype(np.int64)
        p = self.two[pair >> BITS, pair & (1 << BITS) - 1]
        for k in range(3, ORDER + 1):
            runs, counts = seen[k]
            if not len(runs):
                break
            less = self.less(k, counts)
            contexts, at = np.unique(runs >> np.uint64(BITS), return_inverse=True)
            total, freed = np.bincount(at, weights=counts), np.bincount(at, weights=less)
            own = tail(keys, k)
            i = np.minimum(np.searchsorted(runs, own), len(runs) - 1)
            direct = np.where(runs[i] == own, counts[i] - less[i], 0.0)
            c = np.minimum(np.searchsorted(contexts, own >> np.uint64(BITS)), len(contexts) - 1)
            p = np.where(contexts[c] == own >> np.uint64(BITS), (direct + freed[c] * p) / total[c], p)
        return p


def discounts(n: np.ndarray) -> np.ndarray:
    """What is taken from counts of none, one, two, and three or more, given how many runs have each count."""
    y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.0
    raw = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k * 0.5 for k in (1, 2, 3)]
    return np.array([0.0, *(max(LEAST_DISCOUNT, min(float(k), d)) for k, d in enumerate(raw, 1))])


def model(counts: DataFrame) -> Model:
    """From counts of counts and the pairs of symbols, summed over the shards: at most 257 times 257 rows and a few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for runs in batch.column("runs").to_pylist():
                seen = orders(*unpacked(runs))
                rows = [(k, j, int((c == j).sum())) for k, (_, c) in seen.items() for j in (1, 2, 3, 4)]
                pairs, n = shorter(seen[3][0], 3)
                levels = np.concatenate([[r[0] for r in rows], np.full(len(pairs), 2)])
                yield pa.RecordBatch.from_arrays([pa.array(levels, pa.int32()), pa.array(np.concatenate([[r[1] for r in rows], pairs.astype(np.int64)]), pa.int64()), pa.array(np.concatenate([[r[2] for r in rows], n]), pa.int64())], names=["level", "key", "n"])

    parts = counts.select("runs").mapInArrow(B.releasing(run), PARTS).groupBy("level", "key").agg(F.sum("n").alias("n"))
    return Model([tuple(r) for r in parts.collect()])


def perplexities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_bytes, nats (mean negative log probability of a byte) of every row of docs, and whether it is trusted and held back."""
    n, shards = B.partitions(docs), B.shards(docs)
    ids = trusted_ids(labels)
    counts = counted(docs, ids, shards)
    held = docs.sparkSession.sparkContext.broadcast(model(counts))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    found = B.mapped(own, ("doc_id", "text", "lang"), lambda t: (b"", B.pack(t, level=3)), n, BLOCK)

    def ask(packed: tuple, k: int) -> Iterator[tuple[int, bytes]]:
        keys = _runs(packed[0])[1]
        for s, part in B.split_by_shard(_shard(keys, k)):
            yield s, B.pack(packed_keys(keys[part]))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = [unpacked_keys(B.unpack(x)[0]) for x in left.column("asked").to_pylist()]
        if not lists:
            return pa.table({"block": left.column("block"), "shard": left.column("shard"), "answer": pa.array([], pa.binary())})
        seen = orders(*(unpacked(right.column("runs")[0].as_py()) if right.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))))
        keys, at = np.unique(np.concatenate(lists), return_inverse=True)
        logp = np.log(held.value.probabilities(keys, seen)).astype(np.float32)[at]
        B.release()
        return pa.table({"block": left.column("block"), "shard": left.column("shard"), "answer": pa.array([B.pack(x) for x in np.split(logp, np.cumsum([len(k) for k in lists])[:-1])], pa.binary())})

    asks = B.asked(found, ask, shards, n, with_body=True)
    answers = asks.groupBy("shard").cogroup(counts.groupBy("shard")).applyInArrow(answer, B.ANSWER_SCHEMA)

    def finish(_: tuple, body: tuple, by: dict[int, tuple]) -> pa.Table:
        table = body[0]
        offsets, keys, at = _runs(table)
        logp = np.zeros(len(keys))
        for s, part in B.split_by_shard(_shard(keys, shards)):
            logp[part] = by[s][0]
        total = np.concatenate([[0.0], np.cumsum(logp[at])])
        size = np.diff(offsets)
        with np.errstate(divide="ignore", invalid="ignore"):
            nats = -(total[offsets[1:]] - total[offsets[:-1]]) / size
        return pa.table({"doc_id": table.column("doc_id"), "lang": table.column("lang"), "n_bytes": pa.array(size, pa.int64()), "nats": pa.array(nats, mask=size == 0)})

    scored = cut(B.finished(found, answers, finish, "doc_id long, lang string, n_bytes long, nats double"))
    return scored.join(_side(ids.filter("held").select("id", "held")), F.col("doc_id") == F.col("id"), "left").select("doc_id", "lang", "n_bytes", "nats", F.coalesce("held", F.lit(False)).alias("held"))


def thresholds(scored: DataFrame) -> DataFrame:
    """lang, threshold in nats, from counts of thousandths of a nat of the trusted documents that were held back."""
    sketch = cut(scored.filter("held AND nats IS NOT NULL").groupBy("lang", F.floor(F.col("nats") * 1000).alias("b")).agg(F.count(F.lit(1)).alias("n")))
    every = sketch.select(F.lit(1).alias("level"), "lang", "b", "n").unionByName(sketch.groupBy("b").agg(F.sum("n").alias("n")).select(F.lit(0).alias("level"), F.lit(None).cast("string").alias("lang"), "b", "n"))
    of = Window.partitionBy("level", "lang")
    ranked = every.withColumns({"below": F.sum("n").over(of.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(of)})
    quartile = lambda k: F.min(F.when(F.col("below") * 4 >= F.col("total") * k, F.col("b"))) / 1000
    q = ranked.groupBy("level", "lang").agg(quartile(1).alias("q1"), quartile(3).alias("q3"), F.max("total").alias("total"))
    q = cut(q.select("level", "lang", "total", (F.col("q3") + F.greatest(REACH * (F.col("q3") - F.col("q1")), F.lit(LEAST))).alias("threshold")))
    return q


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_bytes, perplexity (of a byte), threshold (a perplexity) and kept of every row of docs."""
    scored = perplexities(docs, labels)
    q = thresholds(scored)
    # As many rows as languages with enough trusted documents, so a bounded number; at most one a LANGUAGE documents.
    own = q.filter((F.col("level") == 1) & (F.col("total") >= LANGUAGE)).select(F.col("lang").alias("l"), F.col("threshold").alias("t1"))
    every = q.filter("level = 0").select(F.col("threshold").alias("t0")).groupBy().agg(F.max("t0").alias("t0"))
    joined = scored.join(F.broadcast(own), F.col("lang").eqNullSafe(F.col("l")), "left").join(F.broadcast(every))
    limit = F.coalesce("t1", "t0")
    kept = F.when(F.col("nats").isNull(), F.lit(False)).otherwise(F.coalesce(F.col("nats") <= limit, F.lit(True)))
    return joined.select("doc_id", "n_bytes", F.exp("nats").alias("perplexity"), F.exp(limit).alias("threshold"), kept.alias("kept"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
