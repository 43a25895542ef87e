"""What Python workers are sent at once, and what they keep after a task."""

import os
import subprocess
import sys

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from quireflow.llm import common

#: A process of its own, so that its one worker has run nothing else; prints the MB that are left after each operator.
KEPT = """
import re
import pyarrow as pa
from pyspark.sql import SparkSession
from quireflow.llm import fingerprints, neardup, pieces

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
words = "array_join(transform(sequence(1, 400), i -> concat('word', pmod(xxhash64(id, i), 20000))), ' ') AS text"
docs = spark.range(0, 8000, 1, 1).selectExpr("id AS doc_id", "id AS th", words)


def held(batches):
    for _ in batches:
        found = re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read())
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(int, found)) // 1024])], ["mb"])


for made in (neardup.sketch(docs), fingerprints.stretches(docs), pieces.digests(docs)):
    made.write.format("noop").mode("overwrite").save()
    print("KEPT", spark.range(0, 1, 1, 1).mapInArrow(held, "mb long").first()[0])
"""


def test_workers_give_back_what_a_task_took():
    done = subprocess.run([sys.executable, "-c", KEPT], capture_output=True, text=True, timeout=120, env=os.environ)
    kept = [int(line.split()[1]) for line in done.stdout.splitlines() if line.startswith("KEPT")]
    assert len(kept) == 3, done.stderr[-2000:]
    assert max(kept) < 120, kept


def test_rows_go_to_python_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    was = spark.conf.get(common._BATCH)
    texts = spark.range(0, 4000, 1, 1).select(F.when(F.col("id") == 3000, F.repeat(F.lit("x"), 3 * common.BATCH_BYTES)).otherwise(F.repeat(F.lit("y"), 2000)).alias("text"))
    found = common.cut_lean(texts.mapInArrow(sizes, "n long, size long"), "sizes").collect()
    assert sum(r.n for r in found) == 4000
    # a batch ends with the row that reaches the bound: only the long text goes beyond it
    assert sorted(r["size"] for r in found)[-2] <= common.BATCH_BYTES + 10_000 and max(r["size"] for r in found) <= 4 * common.BATCH_BYTES + 10_000
    assert spark.conf.get(common._BATCH) == was


def test_groups_stay_whole_in_small_batches(spark):
    def count(pdf):
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "n": [len(pdf)]})

    rows = spark.range(0, 9000, 1, 2).select((F.col("id") % 3).alias("k"), F.repeat(F.lit("y"), 2000).alias("text"))
    found = common.cut_lean(rows.groupBy("k").applyInPandas(count, "k long, n long"), "groups").collect()
    assert sorted(map(tuple, found)) == [(0, 3000), (1, 3000), (2, 3000)]
