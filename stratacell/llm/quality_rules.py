"""Quality rules with thresholds that adapt to each language and source.

One scan counts what the rules need in every whole text. The measures (shares in
thousandths, word length in hundredths) go into mergeable quantile sketches:
counts of logarithmic buckets with 32 steps an octave, so exact below 64 and
within 1/32 above, whatever the number of rows, and merged by adding counts.
Sketches of a language and source merge into those of the language and of all;
a group with few documents takes the thresholds of the next larger one. A fence
is the upper quartile plus three times the quartiles' distance (a margin at
least); documents are then joined with their group's fences.

Defined cases: a null text counts as empty; a text without words fails the base
rules and enters no sketch; null language and source are groups like others;
repeated rows repeat, and count each; an empty table gives an empty result;
columns other than doc_id, text, lang and source are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratacell.llm import blocks as B
from stratacell.llm.common import cut

WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Least documents of a group with thresholds of its own.
GROUP = 200

#: Measures: dividend, factor, divisor, least distance of a fence from its quartile, whether there is a lower fence too.
MEASURES = {
    "symbols": ("n_symbols", 1000, "word_chars", 100, False),
    "word_length": ("word_chars", 100, "n_words", 150, True),
    "repeats": ("n_repeat_words", 1000, "n_words", 200, False),
    "dup_lines": ("n_dup_lines", 1000, "n_lines", 300, False),
}

#: Groups up to which the thresholds are broadcast; beyond that they are joined by salted keys.
BROADCAST_GROUPS = 100_000
SALTS = 64

COUNTS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each run."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeat_words(found: B.Words, window: int = WINDOW) -> np.ndarray:
    """Words of each text in windows that the text has twice or more; window is a power of two. Windows get exact names by doubling."""
    name, of_text = found.index.astype(np.int64), found.of_text
    step = 1
    while step < window and len(name) > step:
        a, b = name[:-step], name[step:]
        pair = a * (int(b.max()) + 1) + b
        name = np.unique(pair, return_inverse=True)[1]
        step *= 2
    covered = np.zeros(len(of_text) + 1, np.int64)
    if step == window and len(name):
        last = np.arange(len(name)) + window - 1
        whole = of_text[: len(name)] == of_text[last]
        at = np.flatnonzero(whole)
        key = of_text[at] * (int(name.max()) + 1) + name[at]
        _, number, times = np.unique(key, return_inverse=True, return_counts=True)
        at = at[times[number] > 1]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + window, -1)
    return sums(np.cumsum(covered)[:-1] > 0, found.offsets)


def counted(docs: DataFrame) -> DataFrame:
    """The counts of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in B.text_blocks(batches, B.BLOCK_BYTES):
            offsets, data = B.buffers(t.column("text"))
            found = B.words(offsets, data)
            lead = (data & 0xC0) != 0x80
            lines, dups = [], []
            raw = data.tobytes()
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = [x for x in raw[lo:hi].split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
                lines.append(len(own))
                dups.append(len(own) - len(set(own)))
            n = t.num_rows
            columns = [pc.cast(t.column("doc_id"), pa.int64()).combine_chunks(), t.column("lang").combine_chunks(), t.column("source").combine_chunks(), np.diff(found.offsets), sums(lead & ~B.SPACE[data], offsets), sums(SYMBOLS[data], offsets), dups, repeat_words(found), lines]
            columns[3:] = [pa.array(c, pa.int64()) for c in columns[3:]]
            if n:
                yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=[f.split()[0] for f in COUNTS.split(", ")])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    return chosen.mapInArrow(B.releasing(run), COUNTS)


def bucket(v: Column) -> Column:
    e = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.when(v < 64, v).otherwise(e * 32 + F.floor(v / F.pow(F.lit(2.0), e))).cast("long")


def bucket_top(b: Column) -> Column:
    """The greatest value of a bucket."""
    e = F.floor(b / 32) - 1
    return F.when(b < 64, b).otherwise((b - e * 32 + 1) * F.pow(F.lit(2.0), e).cast("long") - 1).cast("long")


def fences(counts: DataFrame) -> DataFrame:
    """lang, source, and the fences of each measure, of every group."""
    parts = [F.struct(F.lit(m).alias("measure"), F.floor(F.col(a) * k / F.col(b)).cast("long").alias("v")) for m, (a, k, b, _, _) in MEASURES.items()]
    values = counts.filter("n_words > 0").select("lang", "source", F.explode(F.array(*parts)).alias("x"))
    sketch = cut(values.select("lang", "source", "x.measure", bucket(F.col("x.v")).alias("b")).groupBy("lang", "source", "measure", "b").agg(F.count(F.lit(1)).alias("n")))
    # Merging sketches is adding counts.
    level = lambda k, *by: sketch.groupBy("measure", "b", *by).agg(F.sum("n").alias("n")).select(F.lit(k).alias("level"), *[F.col(c) if c in by else F.lit(None).cast("string").alias(c) for c in ("lang", "source")], "measure", "b", "n")
    every = level(2, "lang", "source").unionByName(level(1, "lang")).unionByName(level(0))
    of = Window.partitionBy("level", "lang", "source", "measure")
    below = F.sum("n").over(of.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    ranked = every.withColumns({"below": below, "total": F.sum("n").over(of)})
    quartile = lambda k: bucket_top(F.min(F.when(F.col("below") * 4 >= F.col("total") * k, F.col("b"))))
    q = ranked.groupBy("level", "lang", "source", "measure").agg(quartile(1).alias("q1"), quartile(3).alias("q3"), F.max("total").alias("total"))
    margin = F.element_at(F.create_map(*[F.lit(x) for m, v in MEASURES.items() for x in (m, v[3])]), F.col("measure"))
    reach = F.greatest(3 * (F.col("q3") - F.col("q1")), margin)
    q = cut(q.select("level", "lang", "source", "measure", "total", (F.col("q3") + reach).alias("high"), (F.col("q1") - reach).alias("low")))
    groups = q.filter("level = 2")
    by_lang = q.filter("level = 1").select(F.col("lang").alias("lang_1"), F.col("measure").alias("measure_1"), F.struct("total", "high", "low").alias("x1"))
    by_all = q.filter("level = 0").select(F.col("measure").alias("measure_0"), F.struct("total", "high", "low").alias("x0"))
    merged = groups.join(by_lang, F.col("lang").eqNullSafe(F.col("lang_1")) & (F.col("measure") == F.col("measure_1"))).join(F.broadcast(by_all), F.col("measure") == F.col("measure_0"))
    chosen = F.when(F.col("total") >= GROUP, F.struct("total", "high", "low")).when(F.col("x1.total") >= GROUP, F.col("x1")).otherwise(F.col("x0"))
    merged = merged.select("lang", "source", "measure", chosen.alias("x"))
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(f"x.{c}"))).alias(f"{m}_{c}")
    return merged.groupBy("lang", "source").agg(*[pick(m, c) for m in MEASURES for c in ("high", "low")])


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row of docs."""
    counts = cut(counted(docs))
    limits = cut(fences(counts).withColumnsRenamed({"lang": "lang_0", "source": "source_0"}))
    same = F.col("lang").eqNullSafe(F.col("lang_0")) & F.col("source").eqNullSafe(F.col("source_0"))
    if limits.count() <= BROADCAST_GROUPS:
        joined = counts.join(F.broadcast(limits), same, "left")
    else:
        salted = limits.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_0"))
        joined = counts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("salt") == F.col("salt_0")), "left")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    fine = F.lit(True)
    for m, (a, k, b, _, two) in MEASURES.items():
        v = F.floor(F.col(a) * k / F.col(b)).cast("long")
        fine = fine & (v <= F.col(f"{m}_high")) & ((v >= F.col(f"{m}_low")) if two else F.lit(True))
    kept = F.when(failed, F.lit(False)).otherwise(F.coalesce(fine, F.lit(False)))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "n_lines")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, list_slice(w, i, i + 7)) AS times
  FROM (SELECT row, w, unnest(range(1, len(w) - 6)) AS i FROM d)
), repeats AS (
  SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + 8)) AS p FROM starts WHERE times > 1) GROUP BY row
), lines AS (
  SELECT row, count(*) AS n, count(DISTINCT line) AS n_distinct
  FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row
), c AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n - lines.n_distinct, 0) AS n_dup_lines,
         coalesce(repeats.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines
  FROM d LEFT JOIN repeats USING (row) LEFT JOIN lines USING (row)
), m AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         CASE WHEN n_words > 0 THEN 1000 * n_symbols // word_chars END AS symbols, CASE WHEN n_words > 0 THEN 100 * word_chars // n_words END AS word_length,
         CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words END AS repeats, CASE WHEN n_words > 0 THEN 1000 * n_dup_lines // n_lines END AS dup_lines
  FROM c
), v AS (
  SELECT lang, source, measure, v FROM m UNPIVOT (v FOR measure IN (symbols, word_length, repeats, dup_lines))
), b AS (
  SELECT lang, source, measure, CASE WHEN v < 64 THEN v ELSE (length(bin(v)) - 6) * 32 + (v >> (length(bin(v)) - 6)) END AS b, count(*) AS n FROM v GROUP BY ALL
), levels AS (
  SELECT 2 AS level, lang, source, measure, b, n FROM b
  UNION ALL SELECT 1, lang, NULL, measure, b, sum(n) FROM b GROUP BY lang, measure, b
  UNION ALL SELECT 0, NULL, NULL, measure, b, sum(n) FROM b GROUP BY measure, b
), ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY b) AS below, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM levels
), q AS (
  SELECT level, lang, source, measure, max(total) AS total, min(b) FILTER (4 * below >= total) AS b1, min(b) FILTER (4 * below >= 3 * total) AS b3 FROM ranked GROUP BY ALL
), qv AS (
  SELECT level, lang, source, measure, total,
         CASE WHEN b1 < 64 THEN b1 ELSE (b1 - (b1 // 32 - 1) * 32 + 1) * (1::BIGINT << (b1 // 32 - 1)) - 1 END AS q1,
         CASE WHEN b3 < 64 THEN b3 ELSE (b3 - (b3 // 32 - 1) * 32 + 1) * (1::BIGINT << (b3 // 32 - 1)) - 1 END AS q3,
         CASE measure WHEN 'symbols' THEN 100 WHEN 'word_length' THEN 150 WHEN 'repeats' THEN 200 ELSE 300 END AS margin
  FROM q
), f AS (
  SELECT level, lang, source, measure, total, q3 + greatest(3 * (q3 - q1), margin) AS high, q1 - greatest(3 * (q3 - q1), margin) AS low FROM qv
), chosen AS (
  SELECT g.lang, g.source, g.measure,
         CASE WHEN g.total >= 200 THEN g.high WHEN l.total >= 200 THEN l.high ELSE a.high END AS high,
         CASE WHEN g.total >= 200 THEN g.low WHEN l.total >= 200 THEN l.low ELSE a.low END AS low
  FROM f g JOIN f l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM g.lang AND l.measure = g.measure JOIN f a ON a.level = 0 AND a.measure = g.measure
  WHERE g.level = 2
), wide AS (
  SELECT lang, source, max(high) FILTER (measure = 'symbols') AS symbols_high, max(high) FILTER (measure = 'word_length') AS word_length_high,
         max(low) FILTER (measure = 'word_length') AS word_length_low, max(high) FILTER (measure = 'repeats') AS repeats_high, max(high) FILTER (measure = 'dup_lines') AS dup_lines_high
  FROM chosen GROUP BY lang, source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce(symbols <= symbols_high AND word_length BETWEEN word_length_low AND word_length_high AND repeats <= repeats_high AND dup_lines <= dup_lines_high, false) AS kept,
       n_lines
FROM m LEFT JOIN wide ON m.lang IS NOT DISTINCT FROM wide.lang AND m.source IS NOT DISTINCT FROM wide.source
"""
