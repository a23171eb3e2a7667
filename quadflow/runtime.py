"""What every operator shares: the cluster's shared folder, written intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast once its size has been counted.
BROADCAST_ROWS = 100_000

_made: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their Python workers can import it wherever
    the driver has it from."""
    app, root = spark.sparkContext.applicationId, os.path.dirname(os.path.abspath(__file__))
    if app in _shipped or not os.path.isdir(root):
        return
    _shipped.add(app)
    folder = tempfile.mkdtemp(prefix="quadflow-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/quadflow-{app}.zip", "w") as z:
        for at, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(at, n), os.path.join("quadflow", os.path.relpath(os.path.join(at, n), root)))
    spark.sparkContext.addPyFile(f"{folder}/quadflow-{app}.zip")  # read on the driver alone, served to the executors


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, in local mode only, a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:  # in full, so that no reader takes a path of the default file system for one of its own disk
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = tempfile.mkdtemp(prefix="quadflow-")
        atexit.register(shutil.rmtree, _made[app], ignore_errors=True)
    return "file://" + _made[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    ship(spark)
    path = f"{shared_dir(spark)}/quadflow/{name}-{uuid.uuid4().hex}"
    if path.startswith("file:"):
        local = "/" + path[5:].lstrip("/")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        os.makedirs(os.path.dirname(local), exist_ok=True)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """written() and the number of rows, observed while they are written."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcast if it has at most so many rows, counted; else leaves the join to the optimizer."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def state(spark: SparkSession, paths: list[str]) -> tuple:
    """The files below some paths with their sizes and times: as long as it is equal, so are the tables."""
    jvm, out = spark.sparkContext._jvm, []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = files.listStatus(path)
        out += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found]
    return tuple(sorted(out))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
