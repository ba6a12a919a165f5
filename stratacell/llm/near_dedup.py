"""Near-duplicates by Order MinHash, verified by banded alignment.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. Texts
with one sequence of words are one node, whatever the number of documents. A
node's shingles of five words are labelled with their occurrence; each of
several hashes picks the two least, and the pair in the order of the text is a
sketch value, so that it depends on order as an alignment does. Nodes that share
a value are a bucket. Candidates never are each with each of a large bucket:
first every node and the leader it meets in most buckets, which makes one
component of most groups; then all pairs of different components in small
buckets, and in large ones each node and a leader of another component; last,
all pairs of different components in the large buckets in which components still
meet. These are no rows: a bucket's texts come to one task, or in blocks of
which each two come to one, and of the pairs that have enough words in common
for an alignment each is aligned in one of its buckets, unless both are in one
component by then. So no pair of similar texts is left out there. Candidates are verified by alignment of
the whole texts in a band as wide as the similarity allows. Verified links make
components by repeated least labels, a class each.

Defined cases: a null text has no words, and texts without words are one node;
texts of fewer than five words match only equal ones; a null doc_id ranks after
all others; rows that share doc_id and words are one document and share the
verdict; an empty table gives an empty result; columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from stratacell.llm import blocks as B
from stratacell.llm.common import cut
from stratacell.llm.substring_dedup import LATEST, mixed, runs

#: Words of a shingle, sketch values, least similarity.
SHINGLE, VALUES, SIMILAR = 5, 32, 0.8

#: Nodes of a bucket, or of a word, of which all pairs are candidates.
FEW = 32

#: The first eight bytes of a digest as a number, high byte first (reverse() takes bytes for text, and so loses some).
SHORT = "cast(conv(hex(substring(node, 1, 8)), 16, -10) as long)"

#: Texts of a frequent word that meet all of its texts in one group.
SPREAD = 1024

#: Texts, and words of theirs, of a bucket that come to one task; of larger buckets each two blocks of so many.
TILE, TILE_WORDS = 512, 1 << 20

#: Texts of a value up to which its pairs are listed to count what texts have in common, and cells of a matrix for the others.
LISTED, CELLS = 16, 1 << 23

#: Nodes up to which those with links are broadcast to the texts; beyond that the texts are dealt out by node.
BROADCAST_NODES = 1_000_000

SKETCHES = "doc_id long, node binary, n_words int, sketch array<long>"
TEXTS = "node binary, words binary"


def digests(h: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A 128-bit digest of each text's sequence of word hashes."""
    import xxhash

    raw = h.astype("<u8").tobytes()
    return [xxhash.xxh3_128_digest(raw[8 * lo : 8 * hi]) for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def sketched(h: np.ndarray, offsets: np.ndarray, values: int = VALUES, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sketch values of each text; none if it has fewer words than a shingle."""
    size = np.maximum(np.diff(offsets) - shingle + 1, 0)
    out = [np.zeros(0, np.int64)] * len(size)
    docs = np.flatnonzero(size)
    if not len(docs):
        return out
    n = size[docs]
    at = B.ragged(offsets[:-1][docs], n)
    g = runs(h, shingle, 0x9E3779B97F4A7C15)[at]
    of = np.repeat(np.arange(len(docs)), n)
    # The occurrence of a shingle in its text: its rank among equal ones.
    order = np.lexsort((g, of))
    new = np.ones(len(order), bool)
    new[1:] = (g[order][1:] != g[order][:-1]) | (of[order][1:] != of[order][:-1])
    first = np.flatnonzero(new)
    occurrence = np.empty(len(order), np.uint64)
    occurrence[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    x = mixed(g + occurrence * np.uint64(0xA24BAED4963EE407))
    starts = np.cumsum(n) - n
    most = np.uint64(np.iinfo(np.uint64).max)
    found = np.empty((len(docs), values), np.uint64)
    for k in range(values):
        y = (x ^ np.uint64(0x9FB21C651E98DF25 * (k + 1) % 2**64)) * np.uint64((0xD6E8FEB86659FD93 * (2 * k + 1)) % 2**64 | 1)
        y ^= y >> np.uint64(32)
        a = _least(y, starts, of)
        y[a] = most
        b = np.where(n > 1, _least(y, starts, of), a)
        low, high = np.minimum(a, b), np.maximum(a, b)
        found[:, k] = mixed(mixed(x[low] + np.uint64(k)) * np.uint64(3) + x[high])
    for i, d in enumerate(docs):
        out[d] = found[i].view(np.int64)
    return out


def _least(y: np.ndarray, starts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The position of the least value of each run, the first of equals."""
    least = np.minimum.reduceat(y, starts)
    at = np.flatnonzero(y == least[of])
    return at[np.searchsorted(of[at], np.arange(len(starts)))]


def similar(a: list[int], b: list[int], least: float = SIMILAR) -> bool:
    """Whether an alignment of two sequences needs at most (1 - least) times the longer one's length in edits."""
    n, m = len(a), len(b)
    most = int((1 - least) * max(n, m) + 1e-9)
    if abs(n - m) > most:
        return False
    lo = 0
    while lo < min(n, m) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(n, m) - lo and a[n - 1 - hi] == b[m - 1 - hi]:
        hi += 1
    a, b = a[lo : n - hi], b[lo : m - hi]
    return max(len(a), len(b)) <= most or banded(a, b, most) <= most


def banded(a: list[int], b: list[int], most: int) -> int:
    """The edit distance if it is at most that, else more: bit vectors of a band of diagonals, a row of the alignment a step."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    if not n:
        return m
    at: dict[int, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    if n <= most:  # the band would reach past the sequence: all of it
        return _whole(at, n, b)
    width = 2 * most + 2
    full = (1 << width) - 1
    up, down = full ^ ((1 << (width - most - 1)) - 1), 0
    distance, shift = most, most + 1 - width
    top = 1 << (width - 1)
    edge = top >> 1
    for i in range(m):
        same = at.get(b[i], 0)
        same = (same >> shift if shift >= 0 else same << -shift) & full
        zero = ((((same & up) + up) ^ up) | same | down) & full
        right = down | full ^ (zero | up)
        left = zero & up
        if i < n - most:
            distance += not zero & top
            if distance > 2 * most + m - n:
                return most + 1
        else:
            distance += bool(right & edge) - bool(left & edge)
            edge >>= 1
        up = (left | full ^ (zero >> 1 | right)) & full
        down = zero >> 1 & right
        shift += 1
    return distance


def _whole(at: dict[int, int], n: int, b: list[int]) -> int:
    """The edit distance, all diagonals in the bit vectors."""
    full = (1 << n) - 1
    up, down, distance, last = full, 0, n, 1 << (n - 1)
    for c in b:
        same = at.get(c, 0)
        zero = ((((same & up) + up) ^ up) | same | down) & full
        right, left = down | full ^ (zero | up), zero & up
        distance += bool(right & last) - bool(left & last)
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = left | full ^ (zero | right), zero & right
    return distance


def enough_in_common(x: np.ndarray, y: np.ndarray, least: float = SIMILAR) -> bool:
    """Whether two sequences have as many values in common as any similar ones must; far cheaper than an alignment."""
    longer = max(len(x), len(y))
    most = int((1 - least) * longer + 1e-9)
    if abs(len(x) - len(y)) > most:
        return False
    if not longer:
        return True
    at = np.unique(np.concatenate([x, y]), return_inverse=True)[1]
    n = int(at.max()) + 1
    return int(np.minimum(np.bincount(at[: len(x)], minlength=n), np.bincount(at[len(x) :], minlength=n)).sum()) >= longer - most


def _words(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    offsets, data = B.buffers(t.column("text"))
    found = B.words(offsets, B.LOWERED[data])
    h = B.hashes(found.distinct)[found.index] if len(found.distinct) else np.zeros(0, np.uint64)
    return h, found.offsets


def sketches(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in B.text_blocks(batches, B.BLOCK_BYTES):
            h, offsets = _words(t)
            ids = pc.fill_null(pc.cast(t.column("doc_id"), pa.int64()), LATEST).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [ids if isinstance(ids, pa.Array) else ids.chunk(0), pa.array(digests(h, offsets), pa.binary()), pa.array(np.diff(offsets), pa.int32()), pa.array(sketched(h, offsets), pa.list_(pa.int64()))],
                names=["doc_id", "node", "n_words", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(B.releasing(run), SKETCHES)


def with_node(docs: DataFrame, name: str) -> DataFrame:
    """docs with the digest of each text's words in a column of that name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in B.text_blocks(batches, B.BLOCK_BYTES):
            yield from t.append_column(name, pa.array(digests(*_words(t)), pa.binary())).to_batches()

    return docs.mapInArrow(B.releasing(run), StructType([*docs.schema.fields, StructField(name, BinaryType())]))


def word_lists(docs: DataFrame) -> DataFrame:
    """Each text's node and the 32-bit hashes of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in B.text_blocks(batches, B.BLOCK_BYTES):
            h, offsets = _words(t)
            small = (h >> np.uint64(32)).astype("<u4")
            lists = [small[lo:hi].tobytes() for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(digests(h, offsets), pa.binary()), pa.array(lists, pa.binary())], names=["node", "words"])

    return docs.select("doc_id", "text").mapInArrow(B.releasing(run), TEXTS)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar; the words of both are brought to each pair, and hot leaders are split by adaptive execution."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                both = [(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) for x, y in zip(part.column("wa").to_pylist(), part.column("wb").to_pylist(), strict=True)]
                keep = [enough_in_common(x, y) and similar(x.tolist(), y.tolist()) for x, y in both]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(keep, pa.bool_())], names=["a", "b", "similar"])

    one = texts.select(F.col("node").alias("na"), F.col("words").alias("wa"))
    two = texts.select(F.col("node").alias("nb"), F.col("words").alias("wb"))
    both = pairs.join(two, F.col("b") == F.col("nb")).select("a", "b", "wb").join(one, F.col("a") == F.col("na")).select("a", "b", "wa", "wb")
    return both.mapInArrow(B.releasing(run), "a binary, b binary, similar boolean")


def components(links: DataFrame) -> DataFrame:
    """node, label of every node that has a link: the least node that it is connected with. Each step takes the least label of the neighbours, then the label's own label."""
    both = cut(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("label")))
    while True:
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("near"))
        step = cut(labels.join(near, F.col("node") == F.col("x")).select("node", "label", F.least("label", "near").alias("new")))
        jump = step.select(F.col("node").alias("by"), F.col("new").alias("to"))
        after = cut(step.join(jump, F.col("new") == F.col("by"), "left").select("node", "label", F.least("new", F.coalesce("to", "new")).alias("new")))
        labels = after.select("node", F.col("new").alias("label"))
        if after.filter("new <> label").isEmpty():
            return labels


def joined_up(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: only the components that a link touches are nodes of the graph that is searched."""
    of = lambda c: labels.select(F.col("node").alias(f"n{c}"), F.col("label").alias(f"l{c}"))
    ends = links.join(of("a"), F.col("a") == F.col("na"), "left").join(of("b"), F.col("b") == F.col("nb"), "left")
    ends = cut(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a <> b").distinct())
    new = components(ends)
    moved = new.select(F.col("node").alias("old"), F.col("label").alias("to"))
    known = labels.join(moved, F.col("label") == F.col("old"), "left").select("node", F.coalesce("to", "label").alias("label"))
    return cut(known.union(new.join(labels.select(F.col("node").alias("had")), F.col("node") == F.col("had"), "left_anti").select("node", "label")))


def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows of nodes with the label of each node's component; a node without links is a component of its own."""
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(labels.select(F.col("node").alias("known"), "label"), F.col("node") == F.col("known"), "left").drop("known").withColumn("label", F.coalesce("label", "node"))


def voted(rows: DataFrame, leaders: DataFrame) -> DataFrame:
    """For each node the leader of another component that it meets in most buckets: one link a node, however large its buckets are."""
    met = rows.join(leaders, F.col("bucket") == F.col("own")).filter("label <> leader_label").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("votes"))
    best = met.groupBy("node").agg(F.max_by("leader", F.struct("votes", "leader")).alias("leader"))
    return best.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))


def within(rows: DataFrame, key: str) -> DataFrame:
    """All pairs of nodes of different components and fitting lengths that share a key; for keys of few nodes only."""
    fits = lambda x, y: F.abs(x["n"] - y["n"]) <= F.floor(F.greatest(x["n"], y["n"]) * (1 - SIMILAR) + 1e-9)
    lists = rows.groupBy(key).agg(F.collect_set(F.struct("node", "label", F.col("n_words").alias("n"))).alias("own"))
    other = lambda x: F.filter("own", lambda y: (x["node"] < y["node"]) & (x["label"] != y["label"]) & fits(x, y))
    pairs = F.flatten(F.transform("own", lambda x: F.transform(other(x), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    return lists.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def short(digest: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The first eight bytes of digests as numbers."""
    return np.array([int.from_bytes(x[:8], "big", signed=True) for x in digest.to_pylist()], np.int64)


def tokens(texts: DataFrame) -> DataFrame:
    """A row for every word of the texts (node, label, n_words, words), of numbers only; a word's second occurrence is another token than its first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                w = [np.frombuffer(x, "<u4") for x in part.column("words").to_pylist()]
                size = np.fromiter(map(len, w), np.int64, len(w))
                flat, of = np.concatenate([np.zeros(0, np.uint64), *(x.astype(np.uint64) for x in w)]), np.repeat(np.arange(len(w)), size)
                order = np.lexsort((flat, of))
                new = np.ones(len(order), bool)
                new[1:] = (flat[order][1:] != flat[order][:-1]) | (of[order][1:] != of[order][:-1])
                first = np.flatnonzero(new)
                nth = np.empty(len(order), np.uint64)
                nth[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
                token = mixed(nth << np.uint64(32) | flat).view(np.int64)
                columns = [token, short(part.column("node"))[of], short(part.column("label"))[of], size[of].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "id", "group", "n"])

    return texts.select("node", "label", "words").mapInArrow(B.releasing(run), "token long, id long, group long, n int")


def sharing_rare_words(texts: DataFrame, few: int = FEW) -> DataFrame:
    """Pairs of short digests (x, y), of different components and fitting lengths, that share a token which at most few texts have. Sorted rows stream by; of a longer run of one token no more than few rows are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("token", "id", "group", "n")], axis=1))
            rows = np.concatenate(held)
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # where the last run begins, which may go on
            held = [rows[max(last, len(rows) - few - 1) :]]
            if last:
                yield met(rows[:last])
        if held:
            yield met(held[0])

    def met(rows: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
        size = np.diff(np.append(start, len(rows)))
        pairs = [np.zeros((0, 2), np.int64)]
        for k in range(1, few):  # each row with the one k places on in its run
            left = B.ragged(start, np.where(size <= few, np.maximum(size - k, 0), 0))
            a, b = rows[left], rows[left + k]
            most = np.floor(np.maximum(a[:, 3], b[:, 3]) * (1 - SIMILAR) + 1e-9)
            fits = (a[:, 2] != b[:, 2]) & (np.abs(a[:, 3] - b[:, 3]) <= most)
            pairs.append(np.sort(np.stack([a[fits, 1], b[fits, 1]], axis=1), axis=1))
        found = np.unique(np.concatenate(pairs), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["x", "y"])

    dealt = tokens(texts).repartition(B.partitions(texts), "token").sortWithinPartitions("token")
    return dealt.mapInArrow(B.releasing(run), "x long, y long").distinct()


def sharing_frequent_words(texts: DataFrame, few: int = FEW) -> DataFrame:
    """Pairs of short digests (x, y), of different components and fitting lengths, that may be similar though no token that they share is rare.

    Of a text of n tokens a similar one lacks at most n / 5. So, in the order
    from rare tokens to frequent ones, both have a token among their first
    n / 5 + 1 in common; where as many are rare, a rare one. Texts with fewer
    rare tokens meet at the frequent ones among these first. A token's texts are
    dealt over groups of SPREAD, so that no task has all pairs of a large one.
    """
    every = tokens(texts)
    counts = cut(every.groupBy("token").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") > few).withColumnRenamed("token", "own"))
    side = F.broadcast(counts) if counts.count() <= BROADCAST_NODES else counts
    lists = every.join(side, F.col("token") == F.col("own")).groupBy("id", "group", "n").agg(F.array_sort(F.collect_list(F.struct("texts", "token"))).alias("frequent"))
    lacks = F.floor(F.col("n") * (1 - SIMILAR) + 1e-9)
    first = lists.withColumn("more", (lacks + 1 - F.col("n") + F.size("frequent")).cast("int")).filter("more > 0").select("id", "group", "n", F.explode(F.slice("frequent", F.lit(1), F.col("more"))["token"]).alias("token"))
    first = cut(first)
    deals = first.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("deals")).filter(F.col("deals") > 0).withColumnRenamed("token", "own")
    dealt = cut(first.join(deals, F.col("token") == F.col("own")).drop("own"))
    a = dealt.select(*[F.col(c).alias(f"{c}_a") for c in ("token", "id", "group", "n")], F.pmod(F.xxhash64("id"), F.col("deals")).cast("int").alias("deal_a"))
    b = dealt.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    most = F.floor(F.greatest("n_a", "n") * (1 - SIMILAR) + 1e-9)
    fits = (F.col("id_a") < F.col("id")) & (F.col("group_a") != F.col("group")) & (F.abs(F.col("n_a") - F.col("n")) <= most)
    met = a.join(b, (F.col("token_a") == F.col("token")) & (F.col("deal_a") == F.col("deal")) & fits)
    return met.select(F.col("id_a").alias("x"), F.col("id").alias("y")).distinct()


def overlaps(w: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sequences have in common, repeats counted: by lists of the sequences for values that few have, by products of 0/1 matrices for the others."""
    s = len(w)
    size = np.fromiter(map(len, w), np.int64, s)
    flat, of = np.concatenate([np.zeros(0, np.int64), *w]).astype(np.int64), np.repeat(np.arange(s), size)
    order = np.lexsort((of, flat))
    flat, of = flat[order], of[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])
    head = np.flatnonzero(new)
    nth = np.arange(len(flat)) - np.repeat(head, np.diff(np.append(head, len(flat))))
    order = np.lexsort((of, nth, flat))  # a second occurrence is another value than the first
    flat, of, nth = flat[order], of[order], nth[order]
    start = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (nth[1:] != nth[:-1])])) if len(flat) else np.zeros(0, np.int64)
    n = np.diff(np.append(start, len(flat)))
    out = np.zeros(s * s, np.float32)
    some, many = (n > 1) & (n <= LISTED), np.flatnonzero(n > LISTED)
    for k in range(1, LISTED):
        left = B.ragged(start, np.where(some, np.maximum(n - k, 0), 0))
        if len(left):
            out += np.bincount(of[left] * s + of[left + k], minlength=s * s)
    out = out.reshape(s, s)
    out += out.T
    width = max(1, CELLS // max(s, 1))
    for at in range(0, len(many), width):
        part = many[at : at + width]
        has = np.zeros((s, len(part)), np.float32)
        has[of[B.ragged(start[part], n[part])], np.repeat(np.arange(len(part)), n[part])] = 1
        out += has @ has.T
    return out


def linked_in(node: list[bytes], label: list[bytes], w: list[np.ndarray], buckets: list[set[int]], own: int, side: np.ndarray | None = None) -> list[tuple[bytes, bytes]]:
    """Similar pairs of different components among the texts of one bucket, in pairs of sides if there are two: as many as join all that are similar. A pair that shares a lesser bucket is left to that one."""
    n = np.fromiter(map(len, w), np.int64, len(w))
    names = {x: i for i, x in enumerate(dict.fromkeys(label))}
    group = np.fromiter((names[x] for x in label), np.int64, len(label))
    longer = np.maximum(n[:, None], n)
    most = np.floor(longer * (1 - SIMILAR) + 1e-9).astype(np.int64)
    common = overlaps(w)
    fits = (np.abs(n[:, None] - n) <= most) & (group[:, None] != group) & (common >= longer - most)
    if side is not None:
        fits &= side[:, None] != side
    a, b = np.nonzero(np.triu(fits, 1))
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    lists: dict[int, list[int]] = {}
    order = np.argsort(-common[a, b] / np.maximum(longer[a, b], 1), kind="stable")  # the likeliest first, as what they join needs no further link
    for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
        x, y = root(int(group[i])), root(int(group[j]))
        if x == y or min(buckets[i] & buckets[j]) != own:
            continue
        for k in (i, j):
            if k not in lists:
                lists[k] = w[k].tolist()
        if similar(lists[i], lists[j]):
            parent[x] = y
            out.append((min(node[i], node[j]), max(node[i], node[j])))
    return out


def linked_within(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join all similar texts of different components that share one of the buckets of rows (node, n_words, bucket, label).

    No pair is a row: a bucket's texts come to one task, or, if they are many, as
    blocks of which each two come to one, and are compared there.
    """
    tiles = rows.groupBy("bucket").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n_words") / TILE_WORDS)).cast("int").alias("deals")).select(F.col("bucket").alias("of"), "deals")
    dealt = rows.join(tiles, F.col("bucket") == F.col("of")).withColumn("deal", F.pmod(F.xxhash64("node"), F.col("deals")).cast("int"))
    held = dealt.groupBy("node").agg(F.min("label").alias("label"), F.collect_list(F.struct("bucket", "deal", "deals")).alias("places"))
    held = held.join(texts.select(F.col("node").alias("own"), "words"), F.col("node") == F.col("own")).select("node", "label", "words", F.transform("places", lambda p: p["bucket"]).alias("buckets"), F.explode("places").alias("place"))
    met = held.select("node", "label", "words", "buckets", F.col("place.bucket").alias("bucket"), F.col("place.deal").alias("deal"), F.explode(F.sequence(F.lit(0), F.col("place.deals") - 1)).alias("other"))
    met = met.withColumn("low", F.least("deal", "other")).withColumn("high", F.greatest("deal", "other")).drop("other")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        w = [np.frombuffer(x, "<u4") for x in t.column("words").to_pylist()]
        side = t.column("deal").to_numpy() == key[1].as_py() if key[1] != key[2] else None
        found = linked_in(t.column("node").to_pylist(), t.column("label").to_pylist(), w, [set(x) for x in t.column("buckets").to_pylist()], key[0].as_py(), side)
        B.release()
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([x for _, x in found], pa.binary())})

    return met.groupBy("bucket", "low", "high").applyInArrow(run, "a binary, b binary")


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, node, class_id (the smallest doc_id of the class), class_size and kept of every row of docs."""
    every = cut(sketches(docs))
    nodes = cut(every.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"), F.max("n_words").alias("n_words"), F.max("sketch").alias("sketch")))
    at = nodes.select("node", "n_words", F.posexplode("sketch").alias("k", "v")).select("node", "n_words", F.xxhash64("k", "v").alias("bucket")).distinct()
    # Only buckets with two nodes or more go on.
    shared = at.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("leader")).filter("size > 1")
    shared = cut(shared.withColumnRenamed("bucket", "own"))
    at = cut(at.join(shared.select("own", "size"), F.col("bucket") == F.col("own")).select("node", "n_words", "bucket", "size"))
    ends = cut(at.select(F.col("node").alias("end")).distinct())
    need = F.broadcast(ends) if ends.count() <= BROADCAST_NODES else ends
    # One row of each node carries its words, for all steps.
    texts = cut(word_lists(docs).join(need, F.col("node") == F.col("end"), "left_semi").groupBy("node").agg(F.first("words").alias("words")))

    def linked(labels: DataFrame | None, pairs: DataFrame) -> DataFrame:
        found = cut(verified(cut(pairs.distinct()), texts)).filter("similar").select("a", "b")
        return components(found) if labels is None else joined_up(labels, found)

    def mixed_buckets(labels: DataFrame) -> DataFrame:
        """The rows of buckets in which two components meet."""
        rows = cut(labelled(at, labels))
        several = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select(F.col("bucket").alias("mix"))
        return cut(rows.join(several, F.col("bucket") == F.col("mix"), "left_semi"))

    # First each node and one leader, which makes one component of most groups, however large.
    labels = linked(None, voted(labelled(at, None), shared.select("own", "leader", F.col("leader").alias("leader_label"))))
    rows = mixed_buckets(labels)
    large = rows.filter(F.col("size") > FEW)
    rank = F.struct(F.xxhash64("label"), "label", "node")
    ends_of = large.groupBy("bucket").agg(F.min(rank).alias("low"), F.max(rank).alias("high"))
    leaders = cut(ends_of.select(F.col("bucket").alias("own"), F.explode(F.array("low", "high")).alias("end")).select("own", F.col("end.node").alias("leader"), F.col("end.label").alias("leader_label")))
    labels = linked(labels, voted(large, leaders).unionByName(within(rows.filter(F.col("size") <= FEW), "bucket")))
    # What large buckets still hold of several components: all pairs in them, compared where a bucket's texts meet.
    large = cut(mixed_buckets(labels).filter(F.col("size") > FEW).select("node", "n_words", "bucket", "label"))
    if not large.isEmpty():
        labels = joined_up(labels, cut(linked_within(large, texts)))
    joined = nodes.select("node", "first", "n").join(labels.select(F.col("node").alias("known"), "label"), F.col("node") == F.col("known"), "left").select("node", "first", "n", F.coalesce("label", "node").alias("label"))
    joined = cut(joined)
    classes = cut(joined.groupBy("label").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size")))
    of_node = cut(joined.join(classes.select(F.col("label").alias("own"), "class_id", "class_size"), F.col("label") == F.col("own")).select(F.col("node").alias("same"), "first", "class_id", "class_size"))
    out = every.select("doc_id", "node").join(of_node, F.col("node") == F.col("same"))
    known = lambda c: F.when(F.col(c) != LATEST, F.col(c)).alias(c)
    return out.select(known("doc_id"), "node", known("class_id"), "class_size", ((F.col("doc_id") == F.col("class_id")) & (F.col("first") == F.col("class_id"))).alias("kept"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("node")
