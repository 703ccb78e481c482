"""Files in and out, claims, streams."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from marlstone.sources import claims, files, sinks
from marlstone.streaming import ingest


def test_encodings(spark, tmp_path):
    text = "SELECT 'é' FROM t\n"
    for name, raw in {"a": text.encode(), "b": b"\xef\xbb\xbf" + text.encode(), "c": text.encode("utf-16"), "d": text.encode("utf-16-le"), "e": text.encode("utf-16-be"), "f": b"\xff\xfe"}.items():
        (tmp_path / f"{name}.sql").write_bytes(raw)
    (tmp_path / "other.txt").write_text("x")
    got = {r["object_id"]: r["code"] for r in files.read_objects(spark, str(tmp_path)).collect()}
    assert got == {k: text for k in "abcde"} | {"f": ""}


def test_knowledge_and_manifest(spark, tmp_path):
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "one.md").write_text("a" * 500 + "\n\n" + "b" * 500)
    (tmp_path / "k" / "two.txt").write_text("short")
    got = {r["id"]: r["text"] for r in files.read_knowledge(spark, str(tmp_path / "k")).collect()}
    assert got["two_0"] == "short" and got["one_1"] == "a" * 100 + "\n" + "b" * 500
    (tmp_path / "m.json").write_text('{"cases": [{"id": "x"}, {"id": "y"}]}')
    assert sorted(r["id"] for r in files.read_manifest(spark, str(tmp_path / "m.json")).collect()) == ["x", "y"]
    assert spark.range(1).select(files.rendered("n is {n}, {m}.", n=F.col("id"), m=F.lit(None))).first()[0] == "n is 0, ."


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", [(1, "x|y"), (2, "z")]), ("b", [])], "object_id string, rules array<struct<n:int,t:string>>")
    made = sinks.reports(rows, "object_id", F.col("object_id"), {"Rules": sinks.table(F.col("rules"), {"n": "No", "t": "Text"}, most=1)})
    got = {r[0]: r[1] for r in made.collect()}
    assert got["b"] == "# b" and got["a"].count("| No | Text |") == 2 and "| 1 | x y |" in got["a"]
    sinks.write_reports(made, "object_id", str(tmp_path / "out"))
    assert {r["object_id"] for r in spark.read.text(str(tmp_path / "out")).collect()} == {"a", "b"}
    assert zipfile.ZipFile(io.BytesIO(sinks.archive(made, "object_id"))).namelist() == ["a.md", "b.md"]
    items = spark.createDataFrame([(1, "a", "ok"), (2, "b", "ok"), (3, "c", "error")], "pos int, object_id string, status string")
    sinks.write_manifest(sinks.manifest(items, "s", "e"), str(tmp_path / "manifest"))
    head, *rest = [json.loads(line) for f in sorted((tmp_path / "manifest").glob("part-*")) for line in f.read_text().splitlines()]
    assert (head["total"], head["ok"], head["failed"], [i["object_id"] for i in rest]) == (3, 2, 1, ["a", "b", "c"])
    checked = sinks.verification(items, "object_id", {"rows": F.lit(3)}, {"status is ok": F.col("status") == "ok"}, F.array(F.lit("one"), F.lit("two"))).collect()
    assert "| status is ok | failed |" in checked[2]["markdown"] and "- one\n- two" in checked[0]["markdown"]
    edges = spark.createDataFrame([("b", "a")], "caller string, callee string")
    assert [r["object_id"] for r in sinks.index(items, edges).collect()] == ["b", "a", "c"]


def test_vector_store(spark, tmp_path):
    chunk = lambda text: spark.createDataFrame([("a", "s", text, [1.0])], "id string, source string, text string, embedding array<double>")
    sinks.add_vectors(chunk("old"), str(tmp_path / "v"))
    sinks.add_vectors(chunk("new"), str(tmp_path / "v"))
    assert [tuple(r)[:3] for r in sinks.stored_vectors(spark.read.parquet(str(tmp_path / "v"))).collect()] == [("a", "s", "new")]


def test_command_line(spark, tmp_path):
    from marlstone.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.sql").write_text("CREATE PROCEDURE dbo.p @a INT\nAS\nIF @a = 1\n UPDATE t SET x = 1\nELSE\n UPDATE t SET x = 2")
    main(["extract", str(tmp_path / "in"), "--out", str(tmp_path / "out")], spark)
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name)).collect()
    assert [r["name"] for r in read("objects")] == ["p"] and len(read("ladders")) == 2 and {r["operation"] for r in read("operations")} == {"UPDATE", "READ"} and read("parameters")[0]["name"] == "a"
    main(["query", "s_dpd_bucket_summary", "/root/testdata/sf0.001", "--out", str(tmp_path / "q")], spark)
    assert spark.read.parquet(str(tmp_path / "q")).count() > 0


def test_claims(spark):
    cut = '{"rules": [{"a": 1}, {"a": {"b": 2}}, {"a": '
    assert claims.salvage(cut, "rules") == [{"a": 1}, {"a": {"b": 2}}] and claims.salvage("no", "rules") == []
    prompts = spark.createDataFrame([("k1", "good"), ("k1", "good"), ("k2", "bad")], "cache_key string, prompt string")

    def model(prompt):
        if prompt == "bad":
            raise ValueError("refused")
        return prompt.upper()

    got = {r[0]: (r[1], r[2]) for r in claims.call(prompts, model).collect()}
    assert got == {"k1": ("GOOD", None), "k2": (None, "refused")}
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise claims.Transient
        return "ok"

    assert claims.with_retries(flaky, sleep=lambda s: None) == "ok"


def test_streams(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.unionByName(events).repartition(3).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = ingest.once(ingest.new_rows(spark, str(tmp_path / "in"), events), ["event_id"], late="365 days")
    ingest.into(stream, lambda batch, n: seen.append(batch.count()), str(tmp_path / "state")).awaitTermination()
    assert sum(seen) == events.count()
    parts = []
    counts = ingest.windowed(ingest.new_rows(spark, str(tmp_path / "in"), events), "event_type")
    ingest.into(counts, lambda batch, n: parts.extend(batch.collect()), str(tmp_path / "state2")).awaitTermination()
    assert all(r["n"] > 0 for r in parts)
