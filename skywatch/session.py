"""Where jobs put intermediate and scratch output.

Library code never builds a session: the caller passes one. Anything a job
has to materialise (summary copies, stream checkpoints, scratch tables of
the registered queries) goes under the shared folder the cluster names in
``spark.checkpoint.dir``. Only when that setting is absent is a folder
chosen, and then under the session's warehouse directory (shared storage
on a cluster, a local folder in a local test session), never under a
machine-local temporary folder; it is registered as the session's
checkpoint directory so ``DataFrame.checkpoint`` uses it too. Whether a
folder without a scheme is shared can't be told from its name: on a
cluster a small job tries it out.
"""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
WAREHOUSE_CONF = "spark.sql.warehouse.dir"
FALLBACK_SUBDIR = "_skywatch_checkpoints"

#: Tasks that try a folder out, at least; on a cluster of more cores, one for each.
PROBE_TASKS = 32
#: (application, folder) of those that were found to be shared.
_SHARED: set[tuple[str, str]] = set()


def checkpoint_root(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, choosing one only if unset."""
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        sc = _spark_context(spark)
        current = sc.getCheckpointDir() if sc is not None else None
        if current:
            # The context checkpoints into <root>/<uuid>; reuse its root.
            return current.rstrip("/").rsplit("/", 1)[0]
        root = spark.conf.get(WAREHOUSE_CONF).rstrip("/") + "/" + FALLBACK_SUBDIR
    _refuse_local_on_cluster(spark, root)
    _register_checkpoint_dir(spark, root)
    return root.rstrip("/")


def _scheme(path: str) -> str:
    head = path.split("/", 1)[0]
    return head.split(":", 1)[0] if ":" in head else ""


def _refuse_local_on_cluster(spark: SparkSession, root: str) -> None:
    """A folder without a scheme, or that was only fallen back on, must be shared when there are other machines.

    A folder that the cluster names itself in ``spark.checkpoint.dir`` is taken at its word, with
    a scheme: it may be a mount that all machines share. One without a scheme (it may be such a mount,
    or lie in ``fs.defaultFS``) and the fallback are tried out. The executors of a ``local-cluster``
    are processes on the driver's machine, each in a working folder of its own: they share every
    absolute path.
    """
    sc = _spark_context(spark)
    master = sc.master if sc is not None else "connect"
    scheme = _scheme(root)
    if master.startswith("local-cluster"):
        if scheme or root.startswith("/"):
            return
    elif master.startswith("local"):
        return
    named = bool(spark.conf.get(CHECKPOINT_CONF, None))
    if scheme and (scheme != "file" or named):
        return
    try:
        if not scheme and not root.startswith("/"):
            raise ValueError("it is relative to the working folder of each process")
        _try_out(spark, root)
    except Exception as reason:
        raise ValueError(
            f"{root} may be local to each machine of the cluster ({master}); set {CHECKPOINT_CONF} to a shared folder, with its scheme"
        ) from reason


def _try_out(spark: SparkSession, root: str) -> None:
    """Fail unless rows that tasks of all executors write to the folder come back whole; once per application.

    The driver lists what the tasks have left, and tasks read it, as in every step of a job. Executors
    that join later are not covered.
    """
    sc = _spark_context(spark)
    known = (sc.applicationId if sc is not None else spark.session_id, root)
    if known in _SHARED:
        return
    tasks = max(PROBE_TASKS, sc.defaultParallelism if sc is not None else 0)
    path = f"{root.rstrip('/')}/skywatch/probe-{uuid.uuid4().hex[:12]}"
    try:
        spark.range(0, tasks, 1, tasks).write.parquet(path)
        found = spark.read.schema("id long").parquet(path).count()
    finally:
        remove_path(spark, path)
    if found != tasks:
        raise OSError(f"{found} of {tasks} rows came back from {root}")
    _SHARED.add(known)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new, unique folder path under the checkpoint root (not created)."""
    return f"{checkpoint_root(spark)}/skywatch/{tag}-{uuid.uuid4().hex[:12]}"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) objects of Spark's own file access; None where the session has no JVM at hand."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:  # Spark Connect
        return None
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder of this library; False where the session has no way to (Spark Connect)."""
    found = hadoop_path(spark, path)
    if found is None:
        return False
    system, where = found
    system.delete(where, True)
    return True


class Scratch:
    """The scratch folders of one job, removed when it ends, also when it fails.

    A job keeps its intermediate tables here until its results are durable. Frames that read a folder
    must not be used after the block. A run that is killed leaves its folders behind; each has a name
    of its own, so no later run reads them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def path(self, tag: str) -> str:
        self.paths.append(scratch_path(self.spark, tag))
        return self.paths[-1]

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        while self.paths:
            remove_path(self.spark, self.paths.pop())


def unique_name(prefix: str) -> str:
    """A catalog-safe unique identifier (lower case, no dashes)."""
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


def _spark_context(spark: SparkSession):
    try:
        return spark.sparkContext
    except PySparkException:  # Spark Connect sessions have no SparkContext
        return None


def _register_checkpoint_dir(spark: SparkSession, root: str) -> None:
    sc = _spark_context(spark)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(root)  # creates it, in the file system it lies in
