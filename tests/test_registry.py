import pytest

import __spark_entry__ as entry
from skywatch.session import checkpoint_root, scratch_path
from skywatch.schema import summary_schema


def test_every_query_has_an_oracle():
    from skywatch.registry import QUERIES

    assert set(QUERIES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {f.name for f in summary_schema("year")}
    assert df.count() > 0


def test_checkpoint_root_reads_session(spark):
    root = checkpoint_root(spark)
    assert root
    assert scratch_path(spark, "x").startswith(root + "/")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_checkpoint_fallback_is_under_warehouse(spark, monkeypatch):
    from skywatch import session

    class Conf:
        def __init__(self, real):
            self.real = real

        def get(self, key, default=None):
            if key == session.CHECKPOINT_CONF:
                return None
            return self.real.get(key, default) if default is not None else self.real.get(key)

    class FakeContext:
        master = "local[2]"

        def getCheckpointDir(self):
            return None

        def setCheckpointDir(self, d):
            self.dir = d

    class FakeSession:
        conf = Conf(spark.conf)
        sparkContext = FakeContext()

    root = session.checkpoint_root(FakeSession())
    assert root.startswith(spark.conf.get("spark.sql.warehouse.dir").rstrip("/"))
    assert FakeSession.sparkContext.dir.rstrip("/") == root

    # On a cluster such a folder may be local to each machine.
    FakeContext.master = "spark://driver:7077"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_root(FakeSession())


@pytest.mark.parametrize(
    "named, master, fine",
    [
        ("/scratch", "yarn", False),
        ("file:///shared/scratch", "yarn", True),
        ("hdfs://store/scratch", "yarn", True),
        ("/scratch", "local[4]", True),
    ],
)
def test_scratch_folder_on_a_cluster(named, master, fine):
    from skywatch import session

    class Fake:
        class conf:
            get = staticmethod(lambda key, default=None: named)

        class sparkContext:
            pass

    Fake.sparkContext.master = master
    if fine:
        session._refuse_local_on_cluster(Fake, named)
    else:
        with pytest.raises(ValueError):
            session._refuse_local_on_cluster(Fake, named)
