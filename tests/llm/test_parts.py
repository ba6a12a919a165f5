"""Parts of the operators on their own."""

import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratacell.llm import blocks as B
from stratacell.llm.near_dedup import banded, similar
from stratacell.llm.packing import plan, places
from stratacell.llm.suffix_dedup import groups, rolled, suffix_array


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=40), st.integers(0, 20))
def test_banded_alignment(a, b, most):
    want = distance(a, b)
    got = banded(a, b, most)
    assert got == want if want <= most else got > most


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=30), st.lists(st.tuples(st.integers(0, 30), st.integers(0, 3)), max_size=6))
def test_similar(a, edits):
    b = list(a)
    for at, x in edits:
        b[at % len(b)] = x
    assert similar(a, b) == (distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(s):
    assert suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_groups_of_equal_windows():
    r = random.Random(2)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(6, 30))) for _ in range(40)]
    texts = list(dict.fromkeys(texts))
    first = np.array([r.randint(0, 9) for _ in texts])
    doc, begin = groups(pa.array(texts, pa.large_string()), first, window=5)
    least: dict[str, int] = {}
    for t, f in zip(texts, first, strict=True):
        for k in range(len(t) - 4):
            least[t[k : k + 5]] = min(least.get(t[k : k + 5], 99), int(f))
    for t, at in zip(texts, begin, strict=True):
        assert [least[t[k : k + 5]] for k in range(len(t) - 4)] == doc[at : at + len(t) - 4].tolist()


@pytest.mark.parametrize("length", [1, 2, 3, 24, 50])
def test_rolled_hash_depends_on_the_run_alone(length):
    x = np.random.default_rng(1).integers(0, 256, 300).astype(np.uint8)
    y = np.concatenate([x[100 : 100 + length], x[:20], x[100 : 100 + length]])
    assert rolled(y, length)[0] == rolled(x, length)[100] == rolled(y, length)[-1]
    assert len(np.unique(rolled(x, length))) == len({x[k : k + length].tobytes() for k in range(300 - length + 1)})


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_uses_every_piece_once(counts):
    patterns = plan(counts, 64)
    used: dict[int, int] = {}
    for p, n in patterns:
        assert sum(p) <= 64
        for x in p:
            used[x] = used.get(x, 0) + n
    assert used == counts
    bins = sum(n for _, n in patterns)
    assert bins <= 1 + 2 * sum(k * n for k, n in counts.items()) // 64
    for length, (first, _, _) in places(patterns).items():
        assert first[0] == 0 and (np.diff(first) > 0).all() and first[-1] < counts[length]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té.\xa0 ", max_size=30), max_size=6))
def test_words_and_chunks(texts):
    offsets, data = B.buffers(pa.array(texts, pa.string()))
    found = B.words(offsets, data)
    all_words = found.distinct.to_pylist()
    for t, lo, hi in zip(texts, found.offsets[:-1], found.offsets[1:], strict=True):
        assert [all_words[k].encode() for k in found.index[lo:hi]] == t.encode().split()
    found = B.chunks(offsets, data)
    parts = found.distinct.to_pylist()
    for t, lo, hi in zip(texts, found.offsets[:-1], found.offsets[1:], strict=True):
        assert "".join(parts[k] for k in found.index[lo:hi]) == t


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aBc .,!'<|>s\n\xa0 \x1c🙂9", max_size=40), max_size=5))
def test_bpe_chunks_are_encoded_as_whole_texts(texts):
    import base64

    import public_tokenizers as P
    import tiktoken

    from stratacell.llm.bpe import Codec, text_chunks

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    global _whole
    _whole = globals().get("_whole") or tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = Codec.of(path, P.PATTERN)
    found = text_chunks(*B.buffers(pa.array(texts, pa.string())))
    parts = found.distinct.to_pylist()
    n, ids = codec.encode_chunks(parts)
    at = np.cumsum(n) - n
    for t, lo, hi in zip(texts, found.offsets[:-1], found.offsets[1:], strict=True):
        assert [int(x) for k in found.index[lo:hi] for x in ids[at[k] : at[k] + n[k]]] == _whole.encode_ordinary(t)
    assert codec.decode_words(n, ids) == [p.encode() for p in parts]


def test_weak_chunk_hashes_are_told_apart(spark, plain):
    from stratacell.llm.exact_dedup import exact_dedup

    docs = spark.read.parquet(f"{plain[0]}/documents.parquet")
    strong = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup(docs, 8, 40).collect()}
    weak = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup(docs, 8, 40, lambda c: F.pmod(F.xxhash64(c), F.lit(3))).collect()}
    assert strong == weak


def test_network_learns_a_word_in_a_long_text():
    from stratacell.llm.toxicity import scores, train

    r = random.Random(3)
    make = lambda bad: " ".join(["poison" if bad and k in (17, 61) else r.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) for k in range(r.randint(70, 130))])
    labels = [k % 2 for k in range(200)]
    net = train([make(k) for k in labels], labels)
    fresh = [k % 2 for k in range(60)]
    got = scores(net, pa.array([make(k) for k in fresh] + ["", None]))
    assert np.mean((got[:60] >= 0.5) == np.array(fresh, bool)) > 0.95
    assert (got[60:] == net.prior).all()


def test_components_of_a_chain(spark):
    from stratacell.llm.near_dedup import components

    n = 30
    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(n) if i != 15], "a binary, b binary")
    got = {r["node"][0]: r["label"][0] for r in components(links).collect()}
    assert got == {i: 0 if i <= 15 else 16 for i in range(n + 1)}


def test_labels_after_more_links(spark):
    from stratacell.llm.near_dedup import components, joined_up

    links = lambda pairs: spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in pairs], "a binary, b binary")
    first, second = [(0, 1), (1, 2), (5, 6), (8, 9)], [(2, 6), (9, 12), (3, 12), (20, 21)]
    got = {r["node"][0]: r["label"][0] for r in joined_up(components(links(first)), links(second)).collect()}
    assert got == {r["node"][0]: r["label"][0] for r in components(links(first + second)).collect()}


def test_pairs_that_share_a_rare_word(spark):
    from collections import Counter

    from stratacell.llm.near_dedup import sharing_rare_words

    r = random.Random(4)
    few, texts = 4, []
    for k in range(60):
        w = [r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randint(0, 3)) for _ in range(r.randint(8, 14))]
        texts.append((bytes([k, 7]) + bytes(14), bytes([k % 20]) + bytes(15), [ord(x[0]) * 16 + int(x[1:]) for x in w]))
    lists = {n: Counter(w) for n, _, w in texts}
    named = {n: {(x, i) for x, c in lists[n].items() for i in range(c)} for n in lists}
    df = Counter(t for s in named.values() for t in s)
    want = set()
    for n, g, w in texts:
        for m, h, v in texts:
            if n < m and g != h and abs(len(w) - len(v)) <= 0.2 * max(len(w), len(v)) and any(df[t] <= few for t in named[n] & named[m]):
                want.add(frozenset((n, m)))
    rows = spark.createDataFrame([(n, g, np.array(w, "<u4").tobytes()) for n, g, w in texts], "node binary, label binary, words binary")
    by = {int.from_bytes(n[:8], "little", signed=True): n for n, _, _ in texts}
    got = [frozenset((by[p["x"]], by[p["y"]])) for p in sharing_rare_words(rows, few).collect()]
    assert set(got) == want and len(got) == len(want) > 20


@pytest.mark.parametrize("text", ["a" * 100_000, "7" * 100_000, "#" * 100_000, " " * 100_000, "\n" * 100_000, "=-" * 50_000, "e" * 9_999 + "s", "漢字仮名交文" * 2_000])
def test_long_matches_are_encoded(text):
    import public_tokenizers as P
    import tiktoken

    from stratacell.llm.bpe import Codec

    codec = Codec.of(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={}).encode_ordinary(text)
    n, ids = codec.encode_chunks([text])
    assert n.tolist() == [len(want)] and ids.tolist() == want
    assert codec.decode_words(n, ids) == [text.encode()]


def test_long_random_letters_are_encoded():
    """A match of letters in which hardly a pair repeats: as many steps as tokens that it makes, in bounded memory."""
    import public_tokenizers as P
    import tiktoken

    from stratacell.llm.bpe import Codec

    r = random.Random(8)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9_000))
    codec = Codec.of(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert codec.encode_chunks([text])[1].tolist() == tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={}).encode_ordinary(text)


def test_gradient_is_the_slope_of_the_loss():
    from stratacell.llm.toxicity import Network, inputs, laid_out, read, windows

    found = read(pa.array(["one two three four, five", "six seven one!", " ".join(f"w{k}" for k in range(60))]))
    x = inputs(found.distinct)
    start, length, of = windows(found.offsets)
    index, mask = laid_out(start, length, found.index)
    net = Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    label = np.array([1.0, 0.0, 1.0])
    loss = lambda: net.gradient(x, index, mask, of, label)[0]
    g = net.gradient(x, index, mask, of, label)[1]
    for name, p in net.p.items():
        dense = np.zeros_like(p)
        if isinstance(g[name], tuple):
            np.add.at(dense, *g[name])
        else:
            dense += g[name]
        for at in (np.unravel_index(k, p.shape) for k in np.argsort(-np.abs(dense), axis=None)[:3]):
            old, step = p[at], 3e-3
            p[at] = old + step
            up = loss()
            p[at] = old - step
            slope = (up - loss()) / (2 * step)
            p[at] = old
            assert slope == pytest.approx(dense[at], rel=3e-2, abs=1e-4), name  # states are of single precision


def test_states_are_those_of_a_plain_loop():
    from stratacell.llm.toxicity import UNIT, Network, sigmoid

    net, r = Network(2), np.random.default_rng(2)
    v, index = r.standard_normal((5, 16)).astype(np.float32), np.array([[0, 3, 1], [2, 4, 0]])
    mask = np.array([[True, True, True], [True, True, False]])
    got = net.states(v, index, mask, "b", None)
    for n in range(2):
        h = np.zeros(UNIT)
        for t in (2, 1, 0):
            if mask[n, t]:
                x, u = v[index[n, t]] @ net.p["xb"] + net.p["bb"], h @ net.p["ub"]
                z, k = sigmoid(x[:UNIT] + u[:UNIT]), sigmoid(x[UNIT : 2 * UNIT] + u[UNIT : 2 * UNIT])
                h = (1 - z) * np.tanh(x[2 * UNIT :] + k * u[2 * UNIT :]) + z * h
            assert np.allclose(got[t, n], h, atol=1e-5)


def test_packing_of_very_many_lengths_is_quick():
    import time

    r = np.random.default_rng(3)
    u, c = np.unique(np.clip(r.lognormal(6, 1.2, 200_000).astype(int) + 1, 1, 4096), return_counts=True)
    counts = dict(zip(u.tolist(), c.tolist(), strict=True))
    began = time.process_time()
    patterns = plan(counts)
    assert time.process_time() - began < 10
    used: dict[int, int] = {}
    for p, n in patterns:
        for x in p:
            used[x] = used.get(x, 0) + n
    assert used == counts
    assert sum(n for _, n in patterns) <= 1.002 * sum(k * n for k, n in counts.items()) / 4096


def test_automata_hold_few_least_hashes(monkeypatch):
    """Of many repeated phrases no automaton holds more than a few, whose first words each step at its root goes through; all are located."""
    import ahocorasick

    from stratacell.llm import substring_dedup as S

    made = []

    def automaton(*kinds):
        made.append(ahocorasick.Automaton(*kinds))
        return made[-1]

    monkeypatch.setattr(S, "ahocorasick", type("A", (), {"Automaton": staticmethod(automaton), "STORE_ANY": ahocorasick.STORE_ANY, "KEY_SEQUENCE": ahocorasick.KEY_SEQUENCE}))
    texts = [" ".join(f"w{k}x{j}" for j in range(13)) for k in range(500)]
    first = np.arange(500)
    args = (np.ones(500, bool), 13, 6)[: S.located.__code__.co_argcount - 2]
    got = S.located(pa.array(texts, pa.large_string()), first, *args)
    assert got.tolist() == first.tolist()
    assert max(len(a) for a in made) <= 32 and sum(len(a) for a in made) == 500


def test_similar_texts_of_frequent_words_meet(spark):
    """Texts made of words that more of them have than a list may hold: all similar pairs are candidates, as by brute force."""
    from stratacell.llm import near_dedup as N

    r = random.Random(3)
    lists = [[r.randrange(12) for _ in range(r.randrange(5, 40))] for _ in range(60)]
    for x in lists[:40]:
        y = list(x)
        for _ in range(r.randrange(1, 1 + max(1, len(x) // 5))):
            y[r.randrange(len(y))] = r.randrange(12)
        lists.append(y)
    lists = [list(x) for x in {tuple(x) for x in lists}]
    rows = [(k.to_bytes(8, "big") * 2, k.to_bytes(8, "big") * 2, np.array(x, "<u4").tobytes()) for k, x in enumerate(lists)]
    texts = spark.createDataFrame(rows, "node binary, label binary, words binary")
    want = {(i, j) for i in range(len(lists)) for j in range(i + 1, len(lists)) if similar(lists[i], lists[j])}
    assert len(want) >= 30
    rare, frequent = ({(p["x"], p["y"]) for p in f(texts, 2).collect()} for f in (N.sharing_rare_words, N.sharing_frequent_words))
    assert not want <= rare
    assert want <= rare | frequent


def test_a_hidden_pair_of_large_buckets_is_joined(spark, monkeypatch):
    """No leader and no rare word joins a pair; the classes have it all the same."""
    from stratacell.llm import near_dedup as N

    monkeypatch.setattr(N, "voted", lambda rows, leaders: rows.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    monkeypatch.setattr(N, "sharing_rare_words", lambda texts, few=N.FEW: spark.createDataFrame([], "x long, y long"))
    monkeypatch.setattr(N, "FEW", 1)
    x = [f"w{k % 11}" for k in range(60)]
    docs = [(k, " ".join(x if k % 2 else x[:-1] + [f"v{k}"])) for k in range(1, 120)]
    got = N.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {g["class_id"] for g in got} == {1}


def test_what_texts_have_in_common_is_counted(monkeypatch):
    from stratacell.llm import near_dedup as N

    r = random.Random(8)
    w = [np.array([r.randrange(40) if r.random() < 0.6 else r.randrange(3000) for _ in range(r.randrange(0, 90))], "<u4") for _ in range(40)]
    for listed in (2, 16):
        monkeypatch.setattr(N, "LISTED", listed)
        got = N.overlaps(w)
        for i in range(40):
            for j in range(i):
                assert got[i, j] == got[j, i] == sum((Counter(w[i].tolist()) & Counter(w[j].tolist())).values())


@pytest.mark.parametrize("tile", [512, 7])
def test_pairs_of_a_large_group_are_no_rows(spark, monkeypatch, tile):
    """Texts with one long passage, of which few are similar: classes as by brute force, and no more pairs as rows than nodes times a constant."""
    from stratacell.llm import near_dedup as N

    r = random.Random(9)
    word = lambda: f"w{r.randrange(60)}"
    passage = [word() for _ in range(60)]
    lists = [passage + [word() for _ in range(22)] for _ in range(90)]
    lists += [x[:64] + [word() for _ in range(k % 7 + 3)] + x[64 + k % 7 + 3 :] for k, x in enumerate(lists[:30])]
    label = list(range(len(lists)))
    for i in range(len(lists)):
        for j in range(i):
            if label[i] != label[j] and similar(lists[i], lists[j]):
                label = [min(label[i], label[j]) if v in (label[i], label[j]) else v for v in label]
    made = []
    verified = N.verified

    def counted(pairs, texts):
        made.append(pairs.count())
        return verified(pairs, texts)

    monkeypatch.setattr(N, "verified", counted)
    monkeypatch.setattr(N, "FEW", 4)
    monkeypatch.setattr(N, "TILE", tile)
    got = N.near_classes(spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(lists)], "doc_id long, text string")).collect()
    assert {g["doc_id"]: g["class_id"] for g in got} == dict(enumerate(label))
    assert 60 < len(set(label)) < len(lists) and sum(made) < 8 * len(lists), made


def test_training_is_not_on_the_driver(spark, plain, monkeypatch):
    from stratacell.llm import toxicity as X

    docs, labels = (spark.read.parquet(f"{plain[0]}/{t}.parquet") for t in ("documents", "labels"))
    want = X.learned(docs, labels)
    train, driver = X.train, os.getpid()
    monkeypatch.setattr(X, "train", lambda *a: train(*a) if os.getpid() != driver else pytest.fail("trained on the driver"))
    got = X.learned(docs, labels)
    assert got.prior == want.prior > 0 and got.p.keys() == want.p.keys() and all((got.p[k] == want.p[k]).all() for k in got.p)


def test_a_block_without_questions_asks_no_shard():
    assert list(B.split_by_shard(np.zeros(0, np.int32))) == []
    assert [(s, part.tolist()) for s, part in B.split_by_shard(np.array([3, 1, 3], np.int32))] == [(1, [1]), (3, [0, 2])]


def test_stretches_are_the_windows_by_least_hash(monkeypatch):
    """Whatever the pieces that are hashed at once: every window of every text is in one stretch, with its neighbours of the same least hash."""
    from stratacell.llm import suffix_dedup as S

    r = random.Random(3)
    texts = ["", None, "x" * 49, "y" * 50, "ab" * 60] + ["".join(r.choice("abcd ") for _ in range(r.randint(0, 300))) for _ in range(30)] + [""]
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    found = []
    for piece in (7, 64, 1 << 14):
        monkeypatch.setattr(S, "PIECE", piece, raising=False)
        own = S.Stretches(table, 50, 24)
        hashed = rolled(own.data, 24)
        windows = [(t, at) for t, lo, hi in zip(range(len(texts)), own.offsets[:-1].tolist(), own.offsets[1:].tolist(), strict=True) for at in range(lo, hi - 49)]
        least = {w: int(hashed[w[1] : w[1] + 27].min()) for w in windows}
        assert [(t, at + k) for t, at, n in zip(own.text.tolist(), own.start.tolist(), own.n.tolist(), strict=True) for k in range(n)] == windows
        heads = {(t, at) for t, at in zip(own.text.tolist(), own.start.tolist(), strict=True)}
        assert heads == {w for i, w in enumerate(windows) if not i or windows[i - 1][0] != w[0] or least[windows[i - 1]] != least[w]}
        found.append((own.start.tolist(), own.keys[own.key].tolist()))
    assert found[0] == found[1] == found[2]


def test_suffixes_are_sorted_by_bounded_parts(monkeypatch):
    """A shard doesn't sort all that it has at once, which outgrows the cache and the memory, nor a stretch that shares only its least hash with others."""
    from stratacell.llm import suffix_dedup as S

    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    passages, phrase = [word(90) for _ in range(60)], word(24)
    texts = [word(30) + p + word(30) for p in passages for _ in range(3)] + [word(26) + phrase + word(26) for _ in range(200)]
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    own = S.Stretches(table, 50, 24)
    parts = [own.data[a : a + n + 49].tobytes() for a, n in zip(own.start.tolist(), own.n.tolist(), strict=True)]
    first = own.first[own.text]
    sizes, whole = [], S.groups

    def groups(stretches, *rest):
        sizes.append(sum(map(len, stretches.to_pylist())))
        return whole(stretches, *rest)

    monkeypatch.setattr(S, "groups", groups)
    monkeypatch.setattr(S, "PART", 2000, raising=False)
    ((_, answer),) = S.smallest_of(50, 24)([0], [(np.array([len(p) for p in parts]), b"".join(parts), first)])
    smallest: dict[bytes, int] = {}
    for p, f in zip(parts, first.tolist(), strict=True):
        for k in range(len(p) - 49):
            smallest[p[k : k + 50]] = min(smallest.get(p[k : k + 50], f), f)
    assert B.unpack(answer)[0].tolist() == [smallest[p[k : k + 50]] for p in parts for k in range(len(p) - 49)]
    assert len(sizes) > 3 and max(sizes) < 2000 + 1500
    assert sum(sizes) < 0.6 * sum(map(len, parts))


def test_a_text_scores_the_same_beside_any_others():
    from stratacell.llm import toxicity as X

    r = random.Random(6)
    some = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(n))
    net = X.Network()
    texts = [some(r.randint(1, 130)) for _ in range(60)]
    alone = [X.scores(net, pa.array([t], pa.string()))[0] for t in texts]
    for n in (1, 2, 5, 7, 150):
        others = [some(r.randint(1, 200)) for _ in range(n)]
        assert X.scores(net, pa.array(others + texts, pa.string()))[n:].tolist() == alone
        assert X.scores(net, pa.array(texts[:n] + others, pa.string()))[: min(n, 60)].tolist() == alone[:n]
