"""The pipeline's stages on a small corpus, each against brute force on its own input."""

import re
from collections import Counter

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def stages(spark, odd, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{odd[0]}/documents.parquet")
    out = [docs]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, out[-1], odd[0]).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def key(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def test_columns_stay(stages):
    for s in stages[1:5]:
        assert s.dtypes == stages[0].dtypes
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(stages[5].columns)


def test_exact_stage(stages):
    rows = stages[1].collect()
    keep: dict = {}
    for r in rows:
        k = key(r["text"])
        keep[k] = max(keep.get(k, -1), -1 if r["doc_id"] is None else r["doc_id"])
    want = Counter((r["doc_id"], r["text"]) for r in rows if (-1 if r["doc_id"] is None else r["doc_id"]) == keep[key(r["text"])])
    assert Counter((r["doc_id"], r["text"]) for r in stages[2].collect()) == want


def test_toxicity_stage_drops_what_it_predicts(stages, odd, spark):
    from stratacell.llm.toxicity import toxicity

    toxic = Counter((r["doc_id"], r["predicted"]) for r in toxicity(stages[0], spark.read.parquet(f"{odd[0]}/labels.parquet")).collect())
    want = Counter({i: n for (i, p), n in toxic.items() if not p})
    assert Counter(r["doc_id"] for r in stages[1].collect()) == want


def test_near_stage_keeps_the_first_of_each_class(stages):
    from tests.llm.test_queries import distance

    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    lists = [re.findall(rb"[^\x20\x09-\x0d]+", key(t).encode()) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(lists):
        for j, b in enumerate(lists[:i]):
            if label[i] != label[j] and (a == b or min(len(a), len(b)) >= 20 and abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and distance(a, b) <= 0.2 * max(len(a), len(b))):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if v == old else v for v in label]
    place = lambda i: float("inf") if i is None else i
    least: dict = {}
    for (i, _), v in zip(rows, label, strict=True):
        least[v] = min(least.get(v, float("inf")), place(i))
    want = Counter(r for r, v in zip(rows, label, strict=True) if place(r[0]) == least[v])
    assert Counter((r["doc_id"], r["text"]) for r in stages[3].collect()) == want and sum(want.values()) < len(rows)


def test_substring_stage(stages):
    before, after = ({r["doc_id"]: r["text"] for r in s.collect()} for s in (stages[3], stages[4]))
    seen: dict = {}
    split = lambda t: [w.decode() for w in re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())]
    order = sorted(before, key=lambda i: (i is None, i))
    for i in order:
        w = split(before[i])
        for k in range(len(w) - 12):
            seen.setdefault(tuple(w[k : k + 13]), i)
    for i in order:
        w = split(before[i])
        gone = set()
        for k in range(len(w) - 12):
            if seen[tuple(w[k : k + 13])] != i:
                gone |= set(range(k, k + 13))
        assert after[i] == (" ".join(x for k, x in enumerate(w) if k not in gone) if gone else before[i])


def test_packing_stage(stages):
    import zlib

    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    for r in stages[4].collect():
        ids = np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[r["doc_id"], k, zlib.crc32(ids[at : at + 4096].tobytes())] += 1
    got = stages[5].collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got) == want
    ends: dict = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096


def test_run(spark, plain):
    got = corpus_pipeline.run(spark, plain[0]).collect()
    assert got and all(r["offset"] + r["length"] <= 4096 for r in got)


def test_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []
