"""The driver's contract, the streamed answers and the index table."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry
from pyspark.sql import functions as F

from quarry.functions import streams
from quarry.plans.config import ChunkConfig
from quarry.sources import files, index

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_alone(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(q) == set(e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, check=True, timeout=120)
    (copy / "quarry" / "llm" / "__pycache__").mkdir(parents=True)
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, check=True, timeout=120)


def test_streamed_answers(spark):
    sse = 'data: {"choices":[{"delta":{"content":"a"}}]}\r\n\r\ndata: {bad\n: ping\ndata: {"choices":[{"delta":{}}]}\ndata: {"choices":[{"delta":{"content":" b"}}]}\ndata: [DONE]'
    lines = '{"response": "x"}\n\n{"done": true}\n{"response": "y"}'
    df = spark.createDataFrame([(sse, lines), (None, None), ("", "")], "s string, n string")
    rows = df.select(streams.answer(streams.sse_pieces(F.col("s"))).alias("s"), streams.ndjson_pieces(F.col("n")).alias("n")).collect()
    assert (rows[0].s, rows[0].n) == ("a b", ["x", "y"]) and rows[1].n is None and rows[2].n == []


def test_index_partitions_are_replaced(spark, tmp_path):
    docs, path = files.sample_documents(spark), str(tmp_path / "index")
    index.write_index(docs, path, 0, ChunkConfig("sentence", 20, 0, 0))
    index.write_index(docs, path, 1, ChunkConfig("paragraph", 40, 0, 0))
    first = index.read_index(spark, path, 0).count()
    index.write_index(docs, path, 1, ChunkConfig("fixed", 400, 0, 0))
    assert index.read_index(spark, path, 0).count() == first and index.read_index(spark, path, 1).count() == 1
    plan = index.read_index(spark, path, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "config_id" in plan
