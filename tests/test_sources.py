"""File sources, sinks, streams and the entry module."""

import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from larkspur.sources import files, sinks
from larkspur.streaming import live

ROOT = Path(__file__).resolve().parent.parent


def test_jsonl(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"text": " one ", "etc": ["x", " "], "tables": ["t"]}\n\n{broken\n{"text": "", "chunk_text": "two"}\n{"text": " "}\n')
    (tmp_path / "a.jsonl").write_text('{"text": "zero"}\n')
    got = files.chunk_jsonl(spark, str(tmp_path))
    assert sorted(r.body for r in got.collect()) == ["one\n\nx\n\nt", "two", "zero"]
    assert [(r.label, r.text.split("\n")[0]) for r in files.insert_units(spark, str(tmp_path)).collect()] == [("a.jsonl[0]", "zero"), ("b.jsonl[0]", "one"), ("b.jsonl[1]", "two")]


def test_markdown_numbers_run_on(spark, tmp_path):
    for name, n in (("a.md", 2), ("b.md", 1)):
        (tmp_path / name).write_text("\n".join(f"## {name} {i}\n" + "x" * 90 for i in range(n)))
    got = files.markdown_chunks(spark, str(tmp_path)).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.section) for r in got] == [(0, "a.md 0"), (1, "a.md 1"), (2, "b.md 0")]
    assert files.text_documents(spark, str(tmp_path)).count() == 2


GRAPH = """<?xml version="1.0"?><graphml><key id="d0" for="node" attr.name="entity_type"/><key id="d1" for="edge" attr.name="weight"/>
<graph><node id="a"><data key="d0"> T </data></node><node id="b"/><edge source="a" target="b"><data key="d1">2.0</data><data key="zz">k</data></edge></graph></graphml>"""


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(GRAPH)
    path = files.newest(spark, str(tmp_path))
    v, e = files.graphml(spark, path)
    assert {r.id: r.attributes for r in v.collect()} == {"a": {"entity_type": "T"}, "b": {}}
    assert e.first().attributes == {"weight": "2.0", "zz": "k"}
    lines = [r.value for r in sinks.graphml_lines(v, e).orderBy("pos").collect()]
    assert '<node id="a"><data key="entity_type">T</data></node>' in lines


def test_key_value_json(spark, tmp_path):
    (tmp_path / "chunks.json").write_text('{"c1": {"content": "x"}, "c2": {"text": "y"}, "c3": "plain", "c4": {"content": ""}}')
    assert sorted((r.chunk_id, r.content) for r in files.kv_chunks(spark, str(tmp_path / "chunks.json")).collect()) == [("c1", "x"), ("c2", "y"), ("c3", "plain")]
    (tmp_path / "status.json").write_text('{"d1": {"chunks_count": 2, "created_at": "2024-01-02T03:04:05+00:00"}}')
    r = files.doc_status(spark, str(tmp_path / "status.json")).first()
    assert (r.status, r.chunks_count) == ("processed", 2) and r.created_at is not None
    (tmp_path / "e.json").write_text('{"d1": {"entity_names": ["A", "B"]}}')
    assert files.full_entities(spark, str(tmp_path / "e.json")).count() == 2
    (tmp_path / "s.json").write_text('{"f": [{"header": "References", "level": 2, "content": "x"}, {"header": "H", "level": 2, "content": "body"}, {"header": "Top", "level": 1, "content": ""}]}')
    assert [r.text for r in files.parsed_sections(spark, str(tmp_path / "s.json")).collect()] == ["## H\nbody"]


def test_wiki_log_and_queries(spark, tmp_path):
    (tmp_path / "p.md").write_text("---\nsources: [a, b]\nbrief: short: text\n---\nsee [[Other]] and [[Third|shown]] and [[Other]]")
    pages, edges = files.wiki_pages(spark, str(tmp_path / "p.md"))
    assert pages.first().front["brief"] == "short: text" and sorted(r.dst for r in edges.collect()) == ["Other", "Third"]
    (tmp_path / "log.md").write_text("## [2024-01-01] ingest | doc one\ntext\n")
    assert files.operation_log(spark, str(tmp_path / "log.md")).first().asDict() == {"ts": "2024-01-01", "op": "ingest", "subject": "doc one"}
    (tmp_path / "q.txt").write_text("# no\n  ask \n\n #yes\n")
    assert sorted(r.query for r in files.query_lines(spark, str(tmp_path / "q.txt")).collect()) == ["#yes", "ask"]


def test_parser_failures_are_rows(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "b.bin").write_bytes(b"\xff")
    got = {r.is_pdf: (r.text, r.error is None) for r in files.parsed_documents(spark, str(tmp_path), lambda b: b.decode("ascii")).collect()}
    assert got == {True: ("%PDF-1.4", True), False: (None, False)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, " a ", [1.0]), (2, "b", [])], "id int, t string, vector array<double>")
    good, bad = sinks.with_rejects(df)
    assert [r.t for r in good.collect()] == ["a"] and bad.count() == 1
    path = str(tmp_path / "table")
    assert sinks.ingest_once(spark, path, lambda: df).count() == 2
    assert sinks.ingest_once(spark, path, lambda: df.limit(0)).count() == 2
    sinks.create(df.limit(1), path)
    assert spark.read.parquet(path).count() == 2
    sinks.create(df.limit(1), path, reset=True)
    assert spark.read.parquet(path).count() == 1
    assert sinks.versioned(df, str(tmp_path / "v"), "1").endswith("version=1")


def test_streams(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:10:00", p, 5) for h in range(6) for p in ("a", "b")]
    spark.createDataFrame(rows, "t string, phase string, tokens long").withColumn("ts", F.to_timestamp("t")).drop("t").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("phase string, tokens long, ts timestamp").parquet(str(tmp_path / "in"))
    q = live.usage_rollup(stream).writeStream.format("memory").queryName("usage").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("usage").agg(F.sum("tokens")).first()[0] in (30, 40)  # windows behind the watermark only


def test_entry_without_training_data_operators(tmp_path):
    for name in ("larkspur", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "larkspur/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
