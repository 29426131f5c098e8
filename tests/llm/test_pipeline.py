"""The pipeline against its stages done plainly, and on odd rows."""

import base64
import hashlib
import os
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import public_tokenizers as vocab
import pyspark
from pyspark.sql import functions as F

import corpus_pipeline
from kinfold.durable import durable
from tests.llm.test_documents import brute_classes, brute_quality

SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    import tiktoken

    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    kept = [r for r in rows if not brute_quality(r.text)[-1] and any(c.isalpha() for c in r.text)]
    classes = brute_classes([(r.doc_id, r.text) for r in kept])
    with open(vocab.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for r in kept:
        if classes[r.doc_id] == r.doc_id:
            ids = np.array(library.encode_ordinary(r.text), "<u4").tobytes()
            want.add((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {tuple(r)[:4] for r in got} == want and len({(r.mix_slot, r.mix_pos) for r in got}) == len(got)
    at = durable(spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id").isin([r.doc_id for r in got])), "test-kept")
    mixed = [r.doc_id for r in corpus_pipeline.source_mixing(spark, at, SF).collect()]
    assert mixed == [r.doc_id for r in sorted(got, key=lambda r: (r.mix_slot, r.mix_pos))]  # the places are those of the mixing stage


def test_stages_on_odd_rows(spark):
    good = " ".join(f"palabra{i} casa" for i in range(60))
    rows = [(1, good, "es", "a", 1), (1, good, "es", "a", 1), (2, good + " más", None, None, None), (3, None, "en", "a", 1), (4, "", None, None, 0), (None, good, "es", "b", 1), (5, " ".join(f"{i} !" for i in range(90)), "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_tokens", F.lit("clash")).withColumn("a.b", F.lit(1)).withColumn("__kf_text", F.lit(None).cast("int")).withColumn("c0", F.array(F.lit(1)))
    for table in (docs, docs.limit(0)):
        at = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = durable(stage(spark, at, SF), f"test-{name}")
            assert at.columns == docs.columns
        got = sorted((r.doc_id or -1 for r in corpus_pipeline.STAGES[-1][1](spark, at, SF).collect()))
        assert got == ([-1, 1] if table is docs else [])


def test_mixing_stage_orders_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = corpus_pipeline.source_mixing(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in mixed) == sorted(r.doc_id for r in docs.collect())
    assert [r.doc_id for r in mixed] != sorted(r.doc_id for r in mixed)


def test_stages_start_on_small_executor_heaps(tmp_path):
    """An executor of its own JVM fills its heap; the stage that follows makes it give the heap back."""
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)  # executors work in Spark's home
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    code = f"""
from pyspark.sql import SparkSession, functions as F
import corpus_pipeline
conf = {{"spark.master": "local-cluster[1,1,1400]", "spark.executor.memory": "1000m", "spark.executor.extraJavaOptions": "-Xlog:gc:file={tmp_path}/gc.log", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.warehouse.dir": "{tmp_path}/warehouse"}}
spark = SparkSession.builder.config(map=conf).getOrCreate()
spark.range(0, 40, 1, 4).select(F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(700_000)), lambda x: x + F.col("id")))).alias("n")).agg(F.sum("n")).collect()
print("FILLED", len(open("{tmp_path}/gc.log").readlines()))
corpus_pipeline.source_mixing(spark, spark.createDataFrame([(1, "a b", "en", "s")], "doc_id long, text string, lang string, source string"), "")
"""
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": str(Path(corpus_pipeline.__file__).parent)}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert not done.returncode, done.stderr[-2000:]
    filled = int(done.stdout.rpartition("FILLED")[2])
    lines = (tmp_path / "gc.log").read_text().splitlines()
    size = lambda part: [int(m) for x in part for m in re.findall(r"\((\d+)M\)", x)]  # noqa: E731  of the heap, MB
    full = [x for x in lines[filled:] if "Pause Full (System.gc())" in x]
    assert full and size(full)[0] < max(size(lines[:filled])) / 2
