"""Each query against brute force or its SQL, and on nulls, repeats, clashing columns and empty tables."""

import base64
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from stratacell.llm.queries import QUERIES, SQL

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def words(text):
    return [w.decode() for w in WORD.findall((text or "").encode())]


def sql_rows(name, folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    got = con.sql(SQL[name])
    return [dict(zip(got.columns, r, strict=True)) for r in got.fetchall()]


def same(a, b):
    key = lambda r: repr(sorted(r.items()))
    assert sorted(map(key, a)) == sorted(map(key, b))


@pytest.fixture(scope="module", params=["plain", "odd"])
def corpus(request):
    """The folder and rows of either fixture: distinct ids, or nulls, repeated rows, ties and clashing columns."""
    return request.getfixturevalue(request.param)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, corpus, name):
    same(rows_of(QUERIES[name](spark, corpus[0])), sql_rows(name, corpus[0]))


def rank(doc_id):
    """A null doc_id ranks after all others."""
    return float("inf") if doc_id is None else doc_id


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_table(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_bpe_is_tiktokens(spark, corpus):
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    codec = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in corpus[1]:
        ids = codec.encode_ordinary(r["text"] or "")
        want.append({"doc_id": r["doc_id"], "n_tokens": len(ids), "ids_sha256": hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256((r["text"] or "").encode()).hexdigest()})
    same(rows_of(QUERIES["op2_bpe"](spark, corpus[0])), want)


def test_suffix_dedup_is_brute_force(spark, corpus):
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in corpus[1]]
    seen, want = {}, []
    for i, b in texts:
        for k in range(len(b) - 49):
            seen[b[k : k + 50]] = min(seen.get(b[k : k + 50], float("inf")), rank(i))
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < rank(i):
                gone[k : k + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want.append({"doc_id": i, "n_bytes": len(b), "n_removed": int(gone.sum()), "n_spans": int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), "kept_sha256": hashlib.sha256(kept).hexdigest()})
    assert sum(r["n_removed"] for r in want) > 1000
    same(rows_of(QUERIES["op3_suffix_dedup"](spark, corpus[0])), want)


def distance(a, b):
    """Edits between two lists, by the plain table."""
    row = np.arange(len(b) + 1)
    names = {w: i for i, w in enumerate(dict.fromkeys(a + b))}
    y = np.array([names[w] for w in b], np.int64)
    at = np.arange(len(b) + 1)
    for i, w in enumerate(a, 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[1:] + 1, row[:-1] + (y != names[w]))
        row = np.minimum.accumulate(best - at) + at
    return int(row[-1])


def test_near_dedup_is_brute_force(spark, corpus):
    lists = [re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (r["text"] or "").encode())) for r in corpus[1]]
    label = list(range(len(lists)))
    for i, a in enumerate(lists):
        for j, b in enumerate(lists[:i]):
            if label[i] != label[j] and (a == b or min(len(a), len(b)) >= 20 and abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and distance(a, b) <= 0.2 * max(len(a), len(b))):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if v == old else v for v in label]
    least, size = defaultdict(lambda: float("inf")), Counter(label)
    for r, v in zip(corpus[1], label, strict=True):
        least[v] = min(least[v], rank(r["doc_id"]))
    want = [{"doc_id": r["doc_id"], "class_id": None if least[v] == float("inf") else least[v], "class_size": size[v], "kept": rank(r["doc_id"]) == least[v]} for r, v in zip(corpus[1], label, strict=True)]
    assert max(size.values()) >= 3
    same(rows_of(QUERIES["op8_near_dedup"](spark, corpus[0])), want)


def test_packing(spark, corpus):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    for r in corpus[1]:
        ids = np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[r["doc_id"], k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())] += 1
    got = rows_of(QUERIES["op10_packing"](spark, corpus[0]))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    placed = defaultdict(list)
    for r in got:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in placed.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(placed) <= -(-sum(r["length"] for r in got) // 4096) + 1


def test_toxicity_contract(spark, corpus):
    got = rows_of(QUERIES["op4_toxicity"](spark, corpus[0]))
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in corpus[1])
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["score"])
    texts = defaultdict(set)
    for r in corpus[1]:
        texts[r["doc_id"]].add(r["text"])
    assert all(len(by[i]) <= len(texts[i]) for i in by)  # equal texts, equal scores


def test_toxicity_on_held_out_documents(spark):
    """Labels of rows that it never learned from, on a given table; measured: 83 of 97 toxic ones, 1 false alarm of 728 (84 and 4 with six whole passes)."""
    folder = "/root/testdata/sf0.1"
    got = spark.createDataFrame([(r["doc_id"], r["predicted"]) for r in rows_of(QUERIES["op4_toxicity"](spark, folder)) if r["held_out"]], "doc_id long, predicted int")
    n = got.join(spark.read.parquet(f"{folder}/labels.parquet").filter("toxic IS NOT NULL"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in n}
    assert n.get((1, 1), 0) >= 0.8 * (n.get((1, 1), 0) + n.get((1, 0), 0)) > 0
    assert n.get((0, 0), 0) >= 0.98 * (n.get((0, 0), 0) + n.get((0, 1), 0)) > 0


def test_perplexity_is_brute_force(spark, plain):
    """Modified Kneser-Ney over bytes, by dictionaries; thresholds and verdicts from those perplexities."""
    import pyarrow.parquet as pq

    from stratacell.llm.perplexity import HELD, LEAST, LEAST_DISCOUNT, ORDER, REACH, START, SYMBOLS

    trusted = {r["doc_id"] for r in pq.read_table(f"{plain[0]}/labels.parquet").to_pylist() if r["quality"] == 1}
    held = {i for i in trusted if zlib.crc32(str(i).encode()) % HELD == 0}
    runs = lambda text: [tuple(([START] * (ORDER - 1) + list(text.encode()))[k : k + ORDER]) for k in range(len(text.encode()))]
    tables = {ORDER: Counter(g for r in plain[1] if r["doc_id"] in trusted - held for g in runs(r["text"] or ""))}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    taken, contexts = {}, {}
    for k, t in tables.items():
        n = Counter(t.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0
        d = [max(LEAST_DISCOUNT, min(j, j - (j + 1) * y * n[j + 1] / n[j])) if n[j] else j * 0.5 for j in (1, 2, 3)]
        taken[k] = lambda c, d=d: min(c, d[min(c, 3) - 1])
        contexts[k] = defaultdict(lambda: [0, 0.0])
        for g, c in t.items():
            contexts[k][g[:-1]][0] += c
            contexts[k][g[:-1]][1] += taken[k](c)
    known: dict = {}

    def p(g):
        if not g:
            return 1 / SYMBOLS
        if g not in known:
            total, freed = contexts[len(g)].get(g[:-1], (0, 0.0))
            c = tables[len(g)][g]
            known[g] = ((c - taken[len(g)](c) if c else 0) / total + freed / total * p(g[1:])) if total else p(g[1:])
        return known[g]

    got = {r["doc_id"]: r for r in rows_of(QUERIES["op7_quality_classifier"](spark, plain[0]))}
    nats = {r["doc_id"]: -np.mean([np.log(p(g)) for g in runs(r["text"])]) if r["text"] else None for r in plain[1]}
    sketch = sorted(int(np.floor(nats[i] * 1000)) for i in held if nats[i] is not None)
    quartile = lambda k: sketch[-(-len(sketch) * k // 4) - 1] / 1000
    limit = quartile(3) + max(REACH * (quartile(3) - quartile(1)), LEAST)  # no language has enough for its own
    for i, want in nats.items():
        assert got[i]["threshold"] == pytest.approx(np.exp(limit), rel=2e-3)
        if want is None:
            assert got[i]["perplexity"] is None and not got[i]["kept"]
        else:
            assert got[i]["perplexity"] == pytest.approx(np.exp(want), rel=1e-4)
            assert got[i]["kept"] == (got[i]["perplexity"] <= got[i]["threshold"])
    assert len({r["kept"] for r in got.values()}) == 2


def test_rules_of_large_and_small_groups(spark, many, monkeypatch):
    """Thresholds of a source, of a language, and of all; the salted join gives the same rows as the broadcast."""
    from stratacell.llm import quality_rules

    want = sql_rows("op1_quality_rules", many[0])
    assert len({r["kept"] for r in want if not r["base_failed"]}) == 2
    same(rows_of(QUERIES["op1_quality_rules"](spark, many[0])), want)
    monkeypatch.setattr(quality_rules, "BROADCAST_GROUPS", 0)
    same(rows_of(QUERIES["op1_quality_rules"](spark, many[0])), want)


def test_thresholds_of_large_and_small_languages(spark, many, monkeypatch):
    """A language with enough trusted documents held back has its own threshold, others that of all; ids that aren't broadcast give the same rows."""
    from stratacell.llm import perplexity as P

    got = {r["doc_id"]: r for r in rows_of(QUERIES["op7_quality_classifier"](spark, many[0]))}
    held = [r for r in many[1] if zlib.crc32(str(r["doc_id"]).encode()) % P.HELD == 0]
    assert sum(r["lang"] == "en" for r in held) >= P.LANGUAGE > sum(r["lang"] == "de" for r in held)

    def limit(rows):
        sketch = sorted(int(np.floor(np.log(got[r["doc_id"]]["perplexity"]) * 1000 + 1e-9)) for r in rows)
        quartile = lambda k: sketch[-(-len(sketch) * k // 4) - 1] / 1000
        return np.exp(quartile(3) + max(P.REACH * (quartile(3) - quartile(1)), P.LEAST))

    own, every = limit([r for r in held if r["lang"] == "en"]), limit(held)
    assert own != every
    for r in many[1]:
        x = got[r["doc_id"]]
        assert x["threshold"] == pytest.approx(own if r["lang"] == "en" else every, rel=2e-3) and x["kept"] == (x["perplexity"] <= x["threshold"])
    monkeypatch.setattr(P, "BROADCAST_IDS", 0)
    same(rows_of(QUERIES["op7_quality_classifier"](spark, many[0])), list(got.values()))


def test_near_dedup_without_broadcast(spark, plain, monkeypatch):
    from stratacell.llm import near_dedup

    want = rows_of(QUERIES["op8_near_dedup"](spark, plain[0]))
    monkeypatch.setattr(near_dedup, "BROADCAST_NODES", 0)
    same(rows_of(QUERIES["op8_near_dedup"](spark, plain[0])), want)
