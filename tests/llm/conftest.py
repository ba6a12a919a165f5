import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

CLASHING = ["block", "shard", "node", "score", "kept", "h", "id", "toxic", "trusted", "rank", "bucket", "label", "n_words", "piece", "deal", "recipe", "body"]


def passage(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choice("abcdeéstß") for _ in range(r.randint(1, 7))) + r.choice(["", "", "", ",", "."]) for _ in range(n)]


def corpus() -> list[dict]:
    """Copies, near copies, shared passages, ties, empty, null and long texts, odd white space."""
    r = random.Random(7)
    shared = passage(r, 60)
    texts: list[str | None] = []
    for _ in range(12):
        words = passage(r, r.randint(30, 120))
        texts.append(" ".join(words))
        near = list(words)
        near[len(near) // 2] = "changed"
        texts.append(" ".join(near))
        texts.append(" ".join(words).upper() if r.random() < 0.5 else " ".join(words))
        at = r.randint(0, len(words))
        texts.append("\n".join([" ".join(words[:at]), " ".join(shared), " ".join(passage(r, 20))]))
    long = passage(r, 9000)
    texts += [None, "", "", " \t\n", "one", "a b c d", "x " * 200, "line\nline\nline\n\nother", " ".join(long), " ".join(long[:4000] + shared + long[4000:]), "a\xa0b  c　\n d \x1c e\x85f", "İstanbul ẞ Éclair DÉJÀ", "it's they'll <|endoftext|> end.", "🙂 🙂🙂 x́ ́y", "###$$$ %%% &&& |||", "idiot trash " * 20]
    rows = [{"doc_id": i, "text": t, "lang": ["en", "fr", None][i % 3], "source": None if i % 7 == 0 else f"s{i % 2}", "n_chars": len(t or "")} for i, t in enumerate(texts)]
    return rows


def table(rows: list[dict], clashing: bool = False) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    t = pa.Table.from_pylist(rows, schema)
    for c in CLASHING if clashing else ():
        t = t.append_column(c, pa.array(["?"] * len(rows), pa.string()))
    return t


def labels(rows: list[dict]) -> pa.Table:
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    marked = [{"doc_id": i, "quality": None if i % 11 == 0 else int(i % 4 != 0), "toxic": int(i % 9 == 0)} for i in ids[: len(ids) * 2 // 3]]
    marked.append({"doc_id": None, "quality": 1, "toxic": 1})
    return pa.Table.from_pylist(marked, pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]))


URLS = [
    "http://a.example.net/en/1?x=1", "https://EXAMPLE.net/de/2#top", "http://net/", "http://net", "https://x.org/fr/1", "https://org/fr", "http://b.c.example.com/de/1/", "http://example.com/DE/1", "ftp://q/://r.net/", "nothing", "", None,
    "://net/", "http://example.net?q=/en/", "http://sub.example.net/en/", "http://badexample.net/en/", "http://notnet/", "http://.net/", "http://example.net./en/",
]


def write(folder, rows: list[dict], clashing: bool = False) -> str:
    pq.write_table(table(rows, clashing), f"{folder}/documents.parquet")
    pq.write_table(labels(rows), f"{folder}/labels.parquet")
    pages = pa.table({"page_id": pa.array([*range(len(URLS)), 0, None], pa.int64()) if rows else pa.array([], pa.int64()), "url": pa.array([*URLS, URLS[0], URLS[1]] if rows else [], pa.string())})
    if clashing:
        for c in ("host", "path", "rule", "key", "kind", "part"):
            pages = pages.append_column(c, pa.array(["?"] * len(pages), pa.string()))
    pq.write_table(pages, f"{folder}/pages.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def plain(tmp_path_factory):
    """Distinct doc_ids."""
    rows = corpus()
    return write(tmp_path_factory.mktemp("plain"), rows), rows


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    """Nulls in every column, repeated rows, and extra columns whose names the operators use."""
    rows = corpus()[:20] + corpus()[-16:]
    rows = rows + rows[:3] + [{"doc_id": None, "text": None, "lang": None, "source": None, "n_chars": None}, {"doc_id": None, "text": rows[0]["text"], "lang": "en", "source": "s0", "n_chars": None}]
    return write(tmp_path_factory.mktemp("odd"), rows, clashing=True), rows


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), [])


@pytest.fixture(scope="session")
def many(tmp_path_factory):
    """Groups on both sides of the least sizes of thresholds: a large language and source, a language that is large over two sources only, and small ones."""
    r = random.Random(11)
    vocabulary = passage(r, 80)
    rows = []
    for lang, source, n in (("en", "s0", 620), ("de", "s1", 130), ("de", "s2", 130), ("fr", "s3", 40), (None, None, 20)):
        for _ in range(n):
            words = [r.choice(vocabulary) for _ in range(r.randint(15, 45))]
            text = " ".join(words)
            if r.random() < 0.05:
                text = r.choice(["### %% " * 12 + text, "\n".join([text[:20]] * 9), "qxzj" * 40 + " " + text, " ".join(words[:8] * 4)])
            rows.append({"doc_id": len(rows), "text": text, "lang": lang, "source": source, "n_chars": len(text)})
    folder = tmp_path_factory.mktemp("many")
    pq.write_table(table(rows), f"{folder}/documents.parquet")
    marked = [{"doc_id": r["doc_id"], "quality": 1, "toxic": 0} for r in rows]
    pq.write_table(pa.Table.from_pylist(marked, pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])), f"{folder}/labels.parquet")
    return str(folder), rows
