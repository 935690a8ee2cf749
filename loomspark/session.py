"""Session settings and written tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that the operators expect; sizes of partitions are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
_RUNS: dict[str, str] = {}


def session(name: str = "loomspark", **settings: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``).  Where the session names none, a temporary one in
    local mode (tests); on a cluster each machine would have its own, so that is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        at = "file://" + tempfile.mkdtemp(prefix="loomspark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """One folder in the shared one for all tables of this application; it goes when the program ends, or by ``clear``."""
    app = spark.sparkContext.applicationId
    if app not in _RUNS:
        _RUNS[app] = f"{shared_dir(spark)}/loomspark-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, app)
    return _RUNS[app]


def _remove(spark: SparkSession, app: str) -> None:
    at = _RUNS.pop(app, None)
    if at:
        with contextlib.suppress(Exception):  # the JVM may be gone by now; then the folder stays
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete the written tables of this application.  Results that have not been read or saved yet need them."""
    _remove(spark, spark.sparkContext.applicationId)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt out by ``keys`` over as many tasks as a shuffle has: short rows of which much is made (texts, trees) come in few
    files, of which Spark makes few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder: the loss of an executor costs no step that is done, and Spark can
    drop the shuffle files of the query that made it."""
    at = f"{run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
