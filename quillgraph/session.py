"""Session helpers: table access and tables in the shared folder, which cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables of ``stored`` that are still there: path, and a weak reference to what every plan that reads it holds.
_TABLES: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the session runs in UTC so zone-less timestamps keep their wall time."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees.

    A cluster names it in ``spark.checkpoint.dir``, without which nothing runs there: a
    folder of one machine would lose rows. Only a session in one process (tests, a laptop)
    may use one, which is deleted at its end.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    one_process(spark.sparkContext.master)
    own = tempfile.mkdtemp(prefix="quillgraph-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir("file://" + own)
    return "file://" + own


def one_process(master: str) -> None:
    """Raise unless the driver is the only executor."""
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back (compressed, prunable).

    Short plans, few partitions and no lineage: what iterative operators use for each round.
    The table is deleted once no plan can read it any more (see ``sweep``), or by ``discard``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return _held(spark, path, df.schema)


def _held(spark: SparkSession, path: str, schema) -> DataFrame:
    back = spark.read.schema(schema).parquet(path)
    back._quillgraph_path = path
    sweep(spark)
    if not _TABLES:
        atexit.register(_clear, spark)
    # the file index is one object, which every plan made from this table keeps
    index = back._jdf.queryExecution().analyzed().relation().location()
    _TABLES[path] = spark._jvm.java.lang.ref.WeakReference(index)
    return back


def observed(df: DataFrame, label: str, **counts) -> tuple[DataFrame, dict]:
    """``stored``, and aggregates of its rows taken while they are written, without another pass."""
    from pyspark.sql import Observation

    seen = Observation()
    path = scratch_path(df.sparkSession, label)
    df.observe(seen, *[c.alias(k) for k, c in counts.items()]).write.parquet(path)
    return _held(df.sparkSession, path, df.schema), seen.get


def _delete(spark: SparkSession, path: str) -> None:
    jvm, context = spark._jvm, spark.sparkContext._jsc
    at = jvm.org.apache.hadoop.fs.Path(path)
    # a stopped session has no settings of its own any more
    at.getFileSystem(context.hadoopConfiguration() if context is not None else jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Delete the tables whose last plan the driver's garbage collection has taken."""
    for path in [p for p, held in _TABLES.items() if held.get() is None]:
        _TABLES.pop(path)
        _delete(spark, path)


def _clear(spark: SparkSession) -> None:
    """At the end of the driver nothing can be read any more."""
    try:
        for path in list(_TABLES):
            _TABLES.pop(path)
            _delete(spark, path)
    except Exception:  # noqa: BLE001 - the JVM may be gone already
        _TABLES.clear()


def discard(df: DataFrame) -> None:
    """Delete a table made by ``stored`` that nothing reads any more."""
    path = getattr(df, "_quillgraph_path", None)
    if path:
        _TABLES.pop(path, None)
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let the shuffle files and tables of plans that are no longer reachable be deleted now, not some time."""
    spark.sparkContext._jvm.System.gc()
    sweep(spark)
