"""Session defaults and the way Python workers find this package."""

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)


def get_session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings that the operators are written for, and others by their names."""
    b = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers of this session import the package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: By application: the local folder where spark.checkpoint.dir is unset, as in tests.
LOCAL: dict[str, str] = {}


#: By application: the folders that were given out.
GIVEN: dict[str, list[str]] = {}
#: Those of them that a scratch block leaves.
FINAL: set[str] = set()


def forget(spark: SparkSession) -> None:
    """Delete all folders that this application's operators have written, once no result is needed any more."""
    for path in GIVEN.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what was written inside, but for what `final` has named: for tables that only lead to another written one."""
    app = spark.sparkContext.applicationId
    before = len(GIVEN.get(app, []))
    done = False
    try:
        yield
        done = True
    finally:
        made = GIVEN.get(app, [])[before:]
        kept = [p for p in made if p in FINAL]
        for p in made:
            if not done or p not in kept:  # after a failure nothing of it is needed
                _delete(spark, p)
                GIVEN[app].remove(p)
        FINAL.difference_update(kept)


def final(df: DataFrame) -> DataFrame:
    """written(df), which an enclosing scratch leaves there."""
    out = written(df)
    FINAL.add(GIVEN[df.sparkSession.sparkContext.applicationId][-1])
    return out


def shared_dir(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which driver and executors share. Where that is unset, a local session gets a local
    folder; on a cluster, whose executors would not see it, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        app = spark.sparkContext.applicationId
        if app not in LOCAL:
            LOCAL[app] = tempfile.mkdtemp(prefix="spark-")
        base = LOCAL[app]
    path = f"{base.rstrip('/')}/sparkvec-{uuid.uuid4().hex}"
    GIVEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: A side is broadcast up to this many bytes, counted first; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20


def bounded(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, marked for broadcast if its counted rows, of this size at most, stay below the limit."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def written(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
