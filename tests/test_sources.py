"""Readers, writers, parsers and paged sources on small fixtures."""

import json
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from stratacell.loader import Survey
from stratacell.sources import bibliography as Bib
from stratacell.sources import documents as D
from stratacell.sources import manual as M
from stratacell.sources import paged as P
from stratacell.sources import tables as S
from stratacell.streaming import events as E


def test_entities_and_cells(spark, tmp_path):
    records = [
        {"id": "a", "name": "A", "coding": {"x": {"value": "1", "evidence": "q"}, "z": {"value": ["u", "v"]}}, "urls": {"repo": "r"}},
        {"id": "b", "name": "B", "coding": {"x": {"not_reported": True}}},
    ]
    (tmp_path / "e.json").write_text(json.dumps(records))
    dims = spark.createDataFrame([("x", 0), ("y", 1)], "key string, ord int")
    e = S.read_entities(spark, str(tmp_path / "e.json"))
    cells = {(r["id"], r["key"]): r for r in S.exploded_cells(e, dims).collect()}
    assert len(cells) == 4 and cells["a", "x"]["value"] == "1" and cells["b", "x"]["not_reported"] and cells["a", "y"]["value"] is None
    assert [(r["id"], r["key"]) for r in S.unknown_dimensions(e, dims).collect()] == [("a", "z")]
    back = {r["id"]: r["coding"] for r in S.nested(S.exploded_cells(e, dims)).collect()}
    assert set(back["a"]) == {"x"} and back["b"]["x"]["not_reported"]


def test_csv_and_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text('\ufeffid,n,flag\n1,2.5,yes\n"a,b",,\n3,x,No\n', encoding="utf-8")
    df = S.read_csv_text(spark, str(tmp_path / "t.csv"), ("id",))
    assert [tuple(r) for r in df.collect()] == [("1", "2.5", "yes"), ("a,b", "", ""), ("3", "x", "No")]
    assert [r["n"] for r in S.typed(df, {"n": "double"}).collect()] == [2.5, None, None]
    with pytest.raises(ValueError):
        S.read_csv_text(spark, str(tmp_path / "t.csv"), ("nothing",))
    with pytest.raises(ValueError):
        S.write_csv(df, str(tmp_path / "o"), ["id"])
    S.write_typed(df, str(tmp_path / "p"), {"n": "double"})
    assert spark.read.parquet(str(tmp_path / "p")).schema["n"].dataType.typeName() == "double"


def test_logs(spark, tmp_path):
    log = spark.createDataFrame([("a", 1, "ok"), ("a", 2, "error"), ("b", 3, "ok")], "k string, o int, s string")
    assert {r["k"]: r["s"] for r in S.last_lines(log, "k", "o").collect()} == {"a": "error", "b": "ok"}
    assert {r["k"]: r["o"] for r in S.last_lines(log, "k", "o", F.col("s") == "ok").collect()} == {"a": 1, "b": 3}
    path = str(tmp_path / "log")
    S.append_new(log, path, "k")
    S.append_new(spark.createDataFrame([("b", 9, "x"), ("c", 4, "y")], "k string, o int, s string"), path, "k", spark.read.json(path))
    assert sorted(r["k"] for r in spark.read.json(path).collect()) == ["a", "b", "c"]
    assert S.fingerprint(log) == S.fingerprint(log.orderBy(F.desc("o")))
    assert S.rewrite_without(log, spark.createDataFrame([("a",)], "k string"), "k", str(tmp_path / "rest")).count() == 1
    kinds = spark.createDataFrame([('["a","b"]', "multi"), ("a|b", "multi"), ("a|b", "single")], "t string, k string")
    assert [r[0] for r in kinds.select(S.parsed_value(F.col("t"), F.col("k"))).collect()] == [["a", "b"], ["a", "b"], ["a|b"]]


def test_parsers():
    assert D.page_text("<title>T &amp; t</title><script>x</script><p>a<b>b</b> c</p>") == ("T & t", "a b c")
    got = list(Bib.entries('@string{me = {Me}} @article{k1, title = {A {B} c}, year = 2024, note = "x, {"y}" # me} junk @misc(k2, url={u\\_v}) @misc{k3, a = {broken'))
    assert got == [("article", "k1", {"title": "A {B} c", "year": "2024", "note": 'x, {"y}Me'}), ("misc", "k2", {"url": "u_v"}), ("misc", "k3", {"a": "broken"})]
    assert D.streamed_payload('x.push([1,"a\\"b"]) y.push([0]) x.push([1, "c"])') == 'a"bc'
    assert list(D.list_items("# A\n## B\n- [n](http://u) text\n# C\n* [m](v)")) == [("A/B", "n", "http://u"), ("C", "m", "v")]
    assert list(D.embedded_objects('x={"a":{"k":1}} y={"k":{"z":2}} {bad', "k")) == [{"k": 1}, {"k": {"z": 2}}]


def count(since: date, until: date) -> int:
    return (until - since).days + 1


def fetch(since: date, until: date):
    for k in range((until - since).days + 1):
        yield (f"r{(since + timedelta(days=k)).isoformat()}", "t", (since + timedelta(days=k)).isoformat())


def pages(cursor: int):
    return [(f"p{cursor}", "t")] if cursor < 3 else [], min(cursor + 1, 3)


def test_slices():
    got = P.bisected(date(2024, 1, 1), date(2024, 1, 31), count, 10)
    assert got[0][0] == date(2024, 1, 1) and got[-1][1] == date(2024, 1, 31)
    assert all(count(*s) <= 10 for s in got) and all(b[0] - a[1] == timedelta(days=1) for a, b in zip(got[:-1], got[1:], strict=True))


def test_sliced_source(spark):
    spark.dataSource.register(P.SlicedSource)
    o = {"since": "2024-01-01", "until": "2024-02-29", "most": "7", "count": "tests.test_sources:count", "fetch": "tests.test_sources:fetch"}
    df = spark.read.format("sliced").options(**o).load()
    assert df.count() == 60 and df.select("id").distinct().count() == 60


def test_cursor_pages():
    r = P.PagedReader({"fetch": "tests.test_sources:pages"})
    rows, cursor = r.read(r.initialOffset())
    assert list(rows) == [("p0", "t")] and cursor == {"cursor": 1}
    assert list(r.readBetweenOffsets({"cursor": 0}, {"cursor": 3})) == [("p0", "t"), ("p1", "t"), ("p2", "t")]


def test_late_rows_are_dropped_and_runs_go_on(spark, tmp_path):
    """Two runs over a growing folder: a checkpoint makes the second take new files only."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    schema = "k string, at timestamp"
    write = lambda n, rows: spark.createDataFrame(rows, "k string, t string").select("k", F.to_timestamp("t").alias("at")).coalesce(1).write.parquet(f"{folder}/{n}")

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(folder)).withWatermark("at", "10 minutes").dropDuplicatesWithinWatermark(["k"])
        E.each_batch(stream, lambda df, _: df.write.mode("append").parquet(out), str(tmp_path / "log"))

    write(1, [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 02:00:00")])
    run()
    write(2, [("late", "2024-01-01 00:05:00"), ("c", "2024-01-01 02:01:00")])
    run()
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_survey(spark, tmp_path):
    rows = [("a", "Alpha", {"x": ("1", None, None), "y": (None, True, None)}), ("b", "Beta", {"x": ("3", None, None)})]
    cell = lambda c: (c[0], c[1], c[2], "q", None)
    e = spark.createDataFrame([(i, n, {k: cell(c) for k, c in d.items()}) for i, n, d in rows], "id string, name string, coding map<string, struct<value: string, not_reported: boolean, unresolved: boolean, evidence: string, note: string>>")
    s = Survey.of(e, spark.createDataFrame([("x", 0, "one"), ("y", 1, "two")], "key string, ord int, layer string"))
    assert s.summary().first().asDict() == {"entities": 2, "dimensions": 2, "coded": 2, "not_reported": 1, "unresolved": 0, "missing": 1}
    assert {r["layer"]: r["rate"] for r in s.not_reported("layer").collect()} == {"one": 0.0, "two": 1.0}
    assert {(r["state"], r["value"]): r["n"] for r in s.dimension("x").collect()} == {("coded", "1"): 1, ("coded", "3"): 1}
    assert s.evidence("a", "x").first()["evidence"] == "q" and {r["key"]: r["differs"] for r in s.compare(["a", "b"]).collect()} == {"x": True, "y": False}
    once, again = s.release(str(tmp_path / "one")), s.release(str(tmp_path / "two"))
    assert once == again and set(once) == {"entities", "cells", "rates", "summary"} and spark.read.parquet(str(tmp_path / "one" / "cells")).count() == 4
    assert s.compare(["a"]).columns == ["error"] and s.suggest("bet", 1).first()["id"] == "b" and [r["value"] for r in s.spread("x").collect()] == [1.0, 1.5, 2.0, 2.5, 3.0]


def test_located_and_packaged(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("STRATACELL_DATA", raising=False)
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "entities.json").write_text("[]")
    (tmp_path / "t.csv").write_text("id,n\n1,2\n")
    (tmp_path / "deep").mkdir()
    assert M.located("p").how == "given" and M.located(start=str(tmp_path / "deep")).path == str(tmp_path / "data")
    with pytest.raises(FileNotFoundError):
        M.located(marker="no such file", start=str(tmp_path))
    monkeypatch.setenv("STRATACELL_DATA", "/d")
    assert M.located().path == "/d"
    got = M.packaged(spark, {"resources": [{"name": "t", "path": "t.csv", "schema": {"fields": [{"name": "n", "type": "integer"}]}}]}, str(tmp_path))
    assert got["t"].dtypes == [("id", "string"), ("n", "bigint")]
    with pytest.raises(ValueError):
        S.read_table(spark, "x.odd")


def test_waits():
    answers, slept = iter([(503, {}, None), (429, {"Retry-After": "7"}, None), (200, {}, "body")]), []
    assert P.patient(lambda: next(answers), slept.append) == "body" and slept == [1.0, 7.0]
    with pytest.raises(OSError):
        P.patient(lambda: (404, {}, None), slept.append)
    with pytest.raises(OSError):
        P.patient(lambda: (500, {}, None), slept.append, tries=3)
    clock, pauses = iter([0.0, 0.0, 0.25, 1.0, 5.0, 5.0]), []
    p = P.Paced(1.0, lambda: next(clock), pauses.append)
    for h in ("a", "a", "b"):
        p.wait(h)
    assert pauses == [0.75]
