"""Where scratch tables go."""

import pytest

from matchloom.llm import _common


class Session:
    def __init__(self, master, named=None, own=None):
        self.sparkContext, self.conf, self.master, self.named, self.own = self, self, master, named, own

    def get(self, key, other):
        return self.named or other

    def getCheckpointDir(self):
        return self.own

    def setCheckpointDir(self, path):
        self.own = f"file:{path}"


def test_scratch_folder_is_the_shared_one():
    assert _common.scratch_root(Session("spark://x", "hdfs://a/b/")) == "hdfs://a/b"
    assert _common.scratch_root(Session("yarn", own="hdfs://c")) == "hdfs://c"
    assert _common.scratch_root(Session("local[4]")).startswith("file:/")
    for master in ("yarn", "spark://x", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            _common.scratch_root(Session(master))


def test_shuffles_go_with_their_query(spark):
    import time

    from matchloom.llm._common import materialise, shuffles_freed

    kept = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    told, before = spark.conf.get(name, None), kept()
    with shuffles_freed(spark):
        assert materialise(spark.range(1000).repartition(3, "id"), "freed").count() == 1000
    end = time.time() + 10
    while kept() > before and time.time() < end:
        time.sleep(0.2)
    assert kept() <= before  # files of the shuffle stayed before
    assert spark.conf.get(name, None) == told


def test_small_tables_are_written_in_few_parts(spark):
    """A round's table of some hundred rows was a file for each shuffle partition."""
    from matchloom.llm import meet
    from matchloom.llm.components import components

    names = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        roots = components(spark.range(300).selectExpr("2 * id as a", "2 * id + 1 as b"))
        met = spark.range(600).selectExpr("id div 20 as bucket", "id as node", "20L as n")
        grouped = meet.groups(met)
        assert roots.count() == 600 and grouped.count() == 600 and grouped.select("bucket").distinct().count() == 30
        assert max(len(roots.inputFiles()), len(grouped.inputFiles())) <= _common.LEAST_PARTS
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert _common.materialise(spark.range(100_000, numPartitions=30), "many", 100_000).rdd.getNumPartitions() > 1
