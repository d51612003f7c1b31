import contextlib
import io

import pytest

from shelfsight.plans import execution as X


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_materialize_writes_once_and_reads_back(spark):
    df = spark.range(0, 100).selectExpr("id", "id * 2 AS twice")
    m = X.materialize(df)
    assert "Scan parquet" in plan(m)
    assert sorted(r["twice"] for r in m.collect()) == [2 * i for i in range(100)]
    odd = spark.range(0, 3).withColumnRenamed("id", "a b")        # parquet cannot hold the name
    assert X.materialize(odd).count() == 3


def test_checkpoint_dir_comes_from_the_session(spark):
    d = X.ensure_checkpoint_dir(spark)
    conf = spark.conf.get("spark.checkpoint.dir", None)
    assert d and (conf is None or d == conf)


def test_checkpoint_dir_of_the_context_is_used(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def __init__(self, path):
            self.path = path

        def getCheckpointDir(self):
            return self.path

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

        def __init__(self, path):
            self.sparkContext = Context(path)
    assert X.ensure_checkpoint_dir(Session("hdfs://shared/ckpt")) == "hdfs://shared/ckpt"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        X.ensure_checkpoint_dir(Session(None))


def test_a_job_deletes_its_own_tables_only(spark):
    """Two jobs at once: each ends without touching the other's tables, also
    after an error."""
    import os
    import threading
    inside, done = threading.Event(), threading.Event()
    seen = {}

    def other():
        with X.owned_tables(spark) as mine:
            seen["rows"] = X.materialize(spark.range(0, 10))
            inside.set()
            done.wait(60)
            seen["count"] = seen["rows"].count()
            seen["paths"] = list(mine)
    t = threading.Thread(target=other)
    t.start()
    assert inside.wait(60)
    with pytest.raises(ValueError):
        with X.owned_tables(spark) as paths:
            X.materialize(spark.range(0, 5))
            assert os.path.isdir(paths[0].replace("file:", ""))
            raise ValueError
    assert not os.path.exists(paths[0].replace("file:", ""))
    done.set()
    t.join(60)
    assert seen["count"] == 10 and not os.path.exists(seen["paths"][0].replace("file:", ""))


def test_cluster_settings_scale_with_shuffle_bytes():
    tb = 1024 ** 4
    big = X.cluster_settings(100 * tb, total_cores=4000)
    assert int(big["spark.sql.shuffle.partitions"]) == int(100 * tb * 0.05 // (256 * 1024 ** 2)) + 1   # 20,481
    assert big["spark.sql.files.maxPartitionBytes"] == str(256 * 1024 ** 2)
    small = X.cluster_settings(10 * 1024 ** 2, total_cores=8)
    assert int(small["spark.sql.shuffle.partitions"]) == 24                                 # 3 waves
    assert small["spark.sql.adaptive.enabled"] == "true"
