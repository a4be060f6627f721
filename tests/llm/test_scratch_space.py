"""What the pipeline's stages write and move beside their result: no copies of the texts."""

import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, simhash

TEXT = "doc_id long, text string, lang string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(f"{r.getrandbits(40):010x}" for _ in range(n))


@pytest.fixture()
def unsent(spark):
    """Tables are not broadcast for being small, as in a large corpus."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def moved(spark) -> int:
    """Bytes of shuffle written by all the stages so far."""
    sc, jvm = spark.sparkContext, spark._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.Collections.emptyList())
    return sum(s.shuffleWriteBytes() for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages))


def test_no_id_is_missed_by_its_mark(unsent):
    rows = unsent.range(0, 200_000, 1, 4).withColumnRenamed("id", "doc_id").withColumn("x y", F.lit(1))
    rows = rows.unionByName(unsent.createDataFrame([(None, 1)], "doc_id long, `x y` int"))
    ids = unsent.range(-500, 200_000, 7).select(F.col("id").cast("int").alias("n"))
    marked = common.with_mark(rows, "doc_id", ids)
    assert marked.columns == ["doc_id", "x y", "__in"] and marked.count() == 200_001
    wanted = {n for n in range(-500, 200_000, 7) if n >= 0}
    found = {r.doc_id for r in common.among(rows, "doc_id", ids).collect()}
    assert wanted <= found and len(found - wanted) < 1000  # 28,643 of 2**24 slots are taken
    assert common.among(rows, "doc_id", ids.where("n is null")).count() == 0
    before = moved(unsent)
    among = common.among(rows.withColumn("text", F.repeat(F.sha2(F.col("doc_id").cast("string"), 256), 9)), "doc_id", ids.where("n < 300"))
    assert among.agg(F.count("text")).first()[0] < 500 and moved(unsent) - before < 1_000_000  # the texts have 115 MB


def test_near_dedup_moves_no_texts_that_stay(unsent):
    texts = [(k, prose(k, 2000), "en") for k in range(200)]
    texts += [(1000 + k, texts[k][1] + " end", "en") for k in range(3)] + [(2000, texts[9][1], "en"), (None, prose(9, 2000), None)]
    docs = common.written(unsent.createDataFrame(texts, TEXT), "docs")
    before = moved(unsent)
    kept = simhash.keep_one(docs).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept) == [-1, *range(200)]
    assert {r.doc_id: r.text for r in kept if r.doc_id is not None} == {k: t for k, t, _ in texts[:200]}
    assert moved(unsent) - before < 1_500_000  # the texts have 4.5 MB


_WORKER = """
import random, re, sys
import pyarrow as pa
from tidemark.llm import simhash
anon = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024
r = random.Random(1)
text = " ".join(f"{r.getrandbits(40):010x}" for _ in range(2000))
batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([text] * 2000)], names=["doc_id", "text"])
before = anon()
rows = sum(x.num_rows for x in simhash._band_keys(iter([batch])))
print(rows, anon() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/status").exists(), reason="reads /proc")
def test_a_worker_keeps_no_memory_of_a_batch():
    got = subprocess.run([sys.executable, "-c", _WORKER], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    rows, mb = map(int, got.stdout.split())
    assert rows == 2000 and mb < 20  # the batch has 44 MB
