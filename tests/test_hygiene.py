"""Library code never brings data to the driver and never cuts lineage locally."""

import pathlib
import re

LIB = pathlib.Path(__file__).resolve().parent.parent / "quire"


def sources():
    # The training-data subpackage has its own rules and tests.
    return [(p, p.read_text()) for p in LIB.rglob("*.py") if "llm" not in p.parts]


def test_no_driver_collection_in_library():
    for path, text in sources():
        assert not re.search(r"\.(collect|toPandas|toLocalIterator)\(", text), path


def test_no_local_checkpoint_or_row_udfs():
    for path, text in sources():
        assert "localCheckpoint" not in text, path
        assert not re.search(r"F\.udf\(|@udf\b|\.rdd\.", text), path


def test_no_round_robin_repartition_before_python_stages():
    # Retried tasks must see the same rows: Python stages are fed by hash repartitioning on keys.
    for path, text in sources():
        for m in re.finditer(r"\.repartition\(([^)]*)\)", text):
            assert "," in m.group(1) or '"' in m.group(1), (path, m.group(0))


def test_cluster_sizing():
    from quire.session import cluster_conf

    conf = cluster_conf(100 * 2**40, executors=1000)
    assert conf["spark.sql.shuffle.partitions"] == "100000"  # capped
    assert conf["spark.sql.files.maxPartitionBytes"] == str(256 << 20)
    assert int(conf["spark.sql.execution.arrow.maxRecordsPerBatch"]) <= 1000
    small = cluster_conf(10 * 2**30, executors=10)
    assert small["spark.sql.shuffle.partitions"] == "120"  # 3x the 40 cores beats 40 partitions of 256 MiB


def test_sessions_on_a_cluster_are_sized_and_need_a_shared_folder(monkeypatch):
    import pytest

    from quire import session

    with pytest.raises(ValueError, match="input_bytes"):
        session.build_session("spark://host:7077")

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Cluster:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster())


def test_unsized_frames_are_not_hinted_and_cost_no_job(spark):
    from quire.plans.joins import checked_broadcast

    df = spark.range(5)
    assert checked_broadcast(df, 10) is df and checked_broadcast(df, 10, known_rows=11) is df
    assert "hint" in checked_broadcast(df, 10, known_rows=5)._jdf.queryExecution().logical().toString().lower()
