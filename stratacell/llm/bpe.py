"""Byte-level BPE, encoding and decoding, as recursive queries in DuckDB.

Documents go through blocks (see blocks.py): a shard gets each distinct chunk of
text (white space with the word after it) once, cuts it into the pattern's
matches, and encodes the distinct matches. A match is a set of rows (word,
position, end, token), first one a byte. Each step joins the rows that touch
with the merge table and contracts each word's pair of least rank from the left
on: where it occurs several times all that don't overlap, up to the first whose
new token could take part in a merge of less rank. The recursion
keeps a row a position, in its last state, so its memory grows with the words'
bytes and not with the steps; words without a pair leave it. Ids return to the
blocks and are joined there in the order of the text. Decoding is an ordered
aggregation of the tokens' bytes.

Defined cases: a null text counts as empty; an empty text has no tokens, and the
digests of no bytes; a null doc_id stays null; repeated rows repeat; an empty table gives an empty result;
columns other than doc_id and text are ignored. No text has special tokens.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from stratacell.llm import blocks as B

#: White space as the tiktoken library's pattern engine has it (Unicode's White_Space).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: A match always begins at such a byte if an ASCII letter stands before it; a chunk can be cut there.
STOPS = np.zeros(256, bool)
STOPS[list(b".,!?;:|#$%&*")] = True

#: Distinct matches that one recursive query encodes, and their bytes; a longer match is alone.
WORDS_A_QUERY, BYTES_A_QUERY = 20_000, 400_000

#: Bytes of text in a block.
BLOCK = 8 << 20

SCHEMA = "doc_id long, ids binary, decoded binary"

ENCODE = """
WITH RECURSIVE state(w, p, e, t) USING KEY (w, p) AS (
  SELECT w, p, e, t FROM start
  UNION
  (WITH live AS (
     SELECT w, p, e, t FROM recurring.state WHERE e > 0 AND w IN (SELECT w FROM state)
   ), pairs AS (
     SELECT a.w, a.p, a.e, b.e AS f, m.rank, m.alone FROM live a JOIN live b ON a.w = b.w AND a.e = b.p JOIN merges m ON m.pair = a.t::BIGINT * 65536 + b.t
   ), least AS (
     SELECT *, lag(e) OVER (PARTITION BY w ORDER BY p) AS before FROM (SELECT *, min(rank) OVER (PARTITION BY w) AS low FROM pairs) WHERE rank = low
   ), runs AS (
     SELECT *, sum((before IS DISTINCT FROM p)::INT) OVER (PARTITION BY w ORDER BY p) AS run FROM least
   ), free AS (
     SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY p) AS nth FROM runs) WHERE nth % 2 = 1
   ), made AS (
     SELECT f.w, f.p, f.rank, unnest([x.t::BIGINT * 65536 + f.rank, f.rank::BIGINT * 65536 + f.rank, f.rank::BIGINT * 65536 + y.t]) AS pair
     FROM free f LEFT JOIN live x ON f.w = x.w AND f.p = x.e LEFT JOIN live y ON f.w = y.w AND f.f = y.p WHERE f.alone
   ), last AS (
     SELECT m.w, min(m.p) AS p FROM made m JOIN lesser l ON m.pair = l.pair AND l.rank < m.rank GROUP BY m.w
   ), chosen AS (
     SELECT f.w, f.p, f.e, f.f, f.rank FROM free f LEFT JOIN last ON f.w = last.w WHERE last.p IS NULL OR f.p <= last.p
   )
   SELECT w, p, f, rank FROM chosen UNION ALL SELECT w, e, 0, 0 FROM chosen)
)
SELECT w, t FROM state WHERE e > 0 ORDER BY w, p
"""

DECODE = "SELECT w, unhex(string_agg(v.hex, '' ORDER BY p)) AS bytes FROM tokens JOIN vocabulary v USING (t) GROUP BY w ORDER BY w"


class Codec:
    """A vocabulary of ranks (in a file of base64 tokens and ranks) and the pattern that cuts texts."""

    _open: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        white = pattern.replace(r"[^\s", "[^" + WHITE).replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
        self.pattern = regex.compile(white)
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(a * 65536 + b, r) for token, r in self.ranks.items() for i in range(1, len(token)) if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        below = {part for p, r in pairs for part in (p >> 16, p & 65535) if r < part}  # tokens that a merge of less rank has as a part
        merges = pa.table({"pair": pa.array([p for p, _ in pairs], pa.int64()), "rank": pa.array([r for _, r in pairs], pa.int32()), "alone": [r in below for _, r in pairs]})
        lesser = pa.table({"pair": pa.array([p for p, r in pairs if r < max(p >> 16, p & 65535)], pa.int64()), "rank": pa.array([r for p, r in pairs if r < max(p >> 16, p & 65535)], pa.int32())})
        vocabulary = pa.table({"t": pa.array(list(self.ranks.values()), pa.int32()), "hex": [k.hex() for k in self.ranks]})
        for name, rows in (("merges", merges), ("lesser", lesser), ("vocabulary", vocabulary)):
            self.db.register("rows", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")
            self.db.unregister("rows")

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        """One for each Python worker."""
        if (path, pattern) not in cls._open:
            cls._open[path, pattern] = cls(path, pattern)
        return cls._open[path, pattern]

    def encode_words(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each of some matches of the pattern, and all ids."""
        size = np.fromiter(map(len, found), np.int64, len(found))
        whole = np.fromiter((self.ranks.get(x, -1) for x in found), np.int64, len(found))  # a match that is a token is that token
        counts = (whole >= 0).astype(np.int64)
        rest = np.flatnonzero(whole < 0)
        rest = rest[np.argsort(size[rest], kind="stable")]  # words of like length need as many steps
        got: list[np.ndarray] = []
        at = 0
        while at < len(rest):
            fits = np.searchsorted(np.cumsum(size[rest[at : at + WORDS_A_QUERY]]), BYTES_A_QUERY, side="right")
            part = rest[at : at + max(1, int(fits))]
            n = size[part]
            data = self.of_byte[np.frombuffer(b"".join([found[i] for i in part.tolist()]), np.uint8)]
            p = (np.arange(len(data)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            start = pa.table({"w": np.repeat(np.arange(len(part), dtype=np.int32), n), "p": p, "e": p + 1, "t": data})
            self.db.register("start", start)
            rows = self.db.sql(ENCODE).to_arrow_table()
            self.db.unregister("start")
            counts[part] = np.bincount(rows.column("w").to_numpy(), minlength=len(part))
            got.append(rows.column("t").to_numpy())
            at += len(part)
        starts = np.cumsum(counts) - counts
        ids = np.zeros(int(counts.sum()), np.uint32)
        ids[starts[whole >= 0]] = whole[whole >= 0]
        ids[B.ragged(starts[rest], counts[rest])] = np.concatenate([np.zeros(0, np.int32), *got])
        return counts, ids

    def decode_words(self, counts: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """The bytes of lists of ids, each list's tokens joined in order."""
        out: list[bytes] = []
        ends = np.cumsum(counts)
        for at in range(0, len(counts), WORDS_A_QUERY):
            n = counts[at : at + WORDS_A_QUERY]
            lo = int(ends[at] - n[0])
            t = ids[lo : lo + int(n.sum())].astype(np.int32)
            self.db.register("tokens", pa.table({"w": np.repeat(np.arange(len(n), dtype=np.int32), n), "p": np.arange(len(t), dtype=np.int32), "t": t}))
            got = self.db.sql(DECODE).fetchall()
            self.db.unregister("tokens")
            by = dict(got)
            out += [bytes(by.get(k, b"")) for k in range(len(n))]
        return out

    def encode_chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids; equal matches are encoded once."""
        number: dict[str, int] = {}
        matches, counts = [], []
        for x in texts:
            found = self.pattern.findall(x)
            counts.append(len(found))
            matches += [number.setdefault(m, len(number)) for m in found]
        n, ids = self.encode_words([m.encode() for m in number])
        index = np.array(matches, np.int64)
        starts = np.cumsum(n) - n
        each = n[index]
        of_text = np.repeat(np.arange(len(texts)), counts)
        return np.bincount(of_text, weights=each, minlength=len(texts)).astype(np.int64), ids[B.ragged(starts[index], each)]


def text_chunks(offsets: np.ndarray, data: np.ndarray) -> B.Words:
    """Chunks that the pattern cuts independently. One never begins within a run of white space, be part of it outside ASCII."""
    if not (data >= 0x80).any():
        return B.chunks(offsets, data, STOPS)
    d = np.concatenate([np.zeros(3, np.uint8), data])
    a, b, c = d[:-3], d[1:-2], d[2:-1]  # the three bytes before each
    wide = (b == 0xC2) & ((c == 0x85) | (c == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F)
    wide |= (a == 0xE2) & (b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    space = B.SPACE[data]
    start = space.copy()
    start[1:] &= ~space[:-1]
    start &= ~wide
    start[offsets[np.flatnonzero(np.diff(offsets))]] = True
    start[1:] |= STOPS[data[1:]] & B.LETTER[data[:-1]]
    at = np.flatnonzero(start)
    index, distinct = B.encoded(B.strings(data, np.append(at, len(data))))
    return B.Words(index, np.searchsorted(at, offsets), distinct)


def bpe(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and decoded bytes of every row of docs."""
    return _run(docs, path, pattern, SCHEMA, lambda ids, decoded: {"ids": pa.array([x.tobytes() for x in ids], pa.binary()), "decoded": pa.array(decoded, pa.binary())})


def _run(docs: DataFrame, path: str, pattern: str, schema: str, columns) -> DataFrame:
    n = B.partitions(docs)
    shards = B.shards(docs)

    def ask(body: tuple, k: int) -> Iterator[tuple[int, bytes]]:
        return B.word_lists(text_chunks(*B.buffers(body[0].column("text"))).distinct, k)

    def solve(of: list[int], lists: list[tuple]) -> Iterator[tuple[int, bytes]]:
        numbers, distinct = B.merged(lists)
        counts, ids = Codec.of(path, pattern).encode_chunks(distinct.to_pylist())
        starts = np.cumsum(counts) - counts
        for block, x in zip(of, numbers, strict=True):
            yield block, B.pack(B.tight(counts[x]), B.tight(ids[B.ragged(starts[x], counts[x])]), level=3)

    def finish(_: tuple, body: tuple, by: dict[int, tuple]) -> pa.Table:
        doc_id = body[0].column("doc_id")
        distinct, index, offsets = (lambda w: (w.distinct, w.index, w.offsets))(text_chunks(*B.buffers(body[0].column("text"))))
        starts, counts = B.rows_by_word(distinct, shards, by)
        every = np.concatenate([np.zeros(0, np.uint32), *(by[s][1].astype(np.uint32) for s in sorted(by))])
        # Of each distinct chunk, the bytes that its ids stand for.
        parts = Codec.of(path, pattern).decode_words(counts, every[B.ragged(starts, counts)])
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        at, flat = np.cumsum(size) - size, np.frombuffer(b"".join(parts), np.uint8)
        ids, decoded = [], []
        for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
            x = index[lo:hi]
            ids.append(every[B.ragged(starts[x], counts[x])].astype("<u4"))
            decoded.append(flat[B.ragged(at[x], size[x])].tobytes())
        return pa.table({"doc_id": pc.cast(doc_id, pa.int64()), **columns(ids, decoded)})

    found = B.mapped(docs, ("doc_id", "text"), lambda t: (b"", B.pack(t, level=3)), n, BLOCK)
    return B.finished(found, B.answered(B.asked(found, ask, shards, n, with_body=True), solve), finish, schema)


def digests(ids: list[np.ndarray], decoded: list[bytes]) -> dict[str, pa.Array]:
    return {
        "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
        "ids_sha256": pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
        "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
    }


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests are made where the ids are, so that ids needn't be moved again."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _run(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digests)
