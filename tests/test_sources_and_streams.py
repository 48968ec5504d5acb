"""Journals, commit logs, observation streams, and the driver contract."""

import json
import os
import shutil
import subprocess
import sys

from pyspark.sql import functions as F

from silt.sources import journals
from silt.streaming import observe

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_journal(spark, tmp_path):
    lines = [
        {"record": "meta", "session": "s1", "cwd": "/w", "started": 5},
        {"record": "entry", "cursor": 0, "entry": {"type": "user", "text": "hi"}},
        {"record": "entry", "cursor": 1, "entry": {"type": "tool", "name": "shell", "args": {"command": "make"}, "result": {"output": "ok", "is_error": False, "duration_ms": 7}}},
        {"record": "entry", "cursor": 2, "entry": {"type": "tool", "name": "shell", "args": {"command": "x"}}},
        {"record": "entry", "cursor": 3, "entry": {"type": "summary", "summary": "so far"}},
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    got = {r["cursor"]: r for r in journals.journal(spark, str(tmp_path / "*.jsonl")).collect()}
    assert set(got) == {0, 1, 3} and got[1]["command"] == "make" and got[1]["ok"] and got[3]["text"] == "so far" and got[3]["role"] == "other"


def test_commits(spark, tmp_path):
    log = "h1\x1f100\x1fswap it\ndiff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@ f\n-old\n+new\n@@ -5,2 +5,0 @@\n-a\n-b\n\x1eh2\x1f200\x1fempty\n\x1e"
    (tmp_path / "log").write_text(log)
    got = {r["hash"]: r for r in journals.commits(spark, str(tmp_path / "log")).collect()}
    assert set(got) == {"h1", "h2"} and got["h1"]["subject"] == "swap it" and got["h1"]["removed"] == ["old", "a", "b"]
    assert [(s["removed"], s["added"]) for s in got["h1"]["swaps"]] == [("old", "new")] and got["h2"]["swaps"] == []


def test_watermarks(spark):
    turns = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "session long, cursor long")
    stamps = spark.createDataFrame([(1, 0, 3)], "session long, through long, version int")
    assert sorted(map(tuple, journals.since(turns, stamps).collect())) == [(1, 1), (2, 0)]
    assert {r["session"] for r in journals.unread(turns, stamps, 4).collect()} == {1, 2}


def test_observe_stream(spark, tmp_path):
    schema = "session long, cursor long, role string, text string"
    rows = [[(1, 0, "user", "a"), (1, 1, "user", "b")], [(1, 0, "user", "a"), (1, 1, "user", "changed")]]
    for n, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / f"in/part={n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    run = observe.observe_stream(stream).writeStream.format("memory").queryName("verdicts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination()
    got = sorted((r["cursor"], r["verdict"]) for r in spark.table("verdicts").collect())
    assert got == [(0, "kept"), (0, "repeated"), (1, "kept"), (1, "refused")]


def test_outbox_lands_once(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "id long").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        observe.outbox(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_entry_without_the_optional_part(tmp_path):
    """The catalogue imports and keeps its queries where the optional subpackage is gone."""
    shutil.copytree(os.path.join(ROOT, "silt"), tmp_path / "silt", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and len(q) > 50; assert not any(n.startswith('op') and n[2].isdigit() for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).filter(F.col("confidence").between(0, 1)).count() > 0
