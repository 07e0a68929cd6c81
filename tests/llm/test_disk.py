"""What near duplicates leave on disk and move."""

import time
from random import Random

import numpy as np
from pyspark.sql import functions as F

from clipweave.llm import jaccard
from clipweave.llm.common import saved


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.length()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.length()))


def test_a_saved_table_leaves_no_shuffle_files(spark):
    conf, name = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    old = shuffle_files(spark)
    rows = spark.range(100_000).repartition(4, "id").groupBy((F.col("id") % 1000).alias("k")).count()
    for _ in range(2):  # a frame can be used again
        assert sum(r["count"] for r in saved(rows, "counts").collect()) == 100_000
    for _ in range(50):  # files go soon after
        if not (left := shuffle_files(spark) - old):
            break
        time.sleep(0.1)
    assert not left and conf.get(name, None) == before


def test_texts_of_documents_in_no_cluster_do_not_move(spark):
    rng = Random(3)
    word = lambda: rng.randbytes(500).hex()
    texts = [" ".join(word() for _ in range(20)) for _ in range(400)]
    texts += [f"{t} more" for t in texts[:5]]
    docs = saved(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), "docs")
    before, limit = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with very many members
    try:
        got = {tuple(r) for r in jaccard.near_duplicates(docs).select("doc_id", "component_id").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {(k, k - 400 if k >= 400 else k) for k in range(405)}
    assert shuffled(spark) - before < sum(map(len, texts)) // 4


def test_few_keys_are_in_a_bitmap_by_chance(spark):
    rng = np.random.default_rng(8)
    some, other = (rng.integers(-(1 << 63), 1 << 63, n) for n in (100_000, 2_000_000))
    bits = jaccard._bitmap(spark.createDataFrame(some[:, None].tolist(), "key long"))
    assert jaccard._marked(bits, some.view(np.uint64)).all()
    assert jaccard._marked(bits, other.view(np.uint64)).mean() < 1e-4
