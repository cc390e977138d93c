"""Session helpers: test sessions, table reading and durable intermediate results."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
}


def local_session(cores: int = 8, shuffle_partitions: int = 8, name: str = "siltstone", memory: str = "8g") -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE, last-wins map keys)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory, "spark.ui.showConsoleProgress": "false"}
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folder of a local session that names none, made once per process (tests and the benchmark on one machine).
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a session on one machine gets a folder of its own, which goes
    when the process ends; on a cluster a missing setting is an error, as executors
    don't see each other's disks.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="spark-siltstone-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
    return "file://" + _LOCAL["dir"]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; its files are deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back.

    Cuts the lineage so that later stages survive the loss of executors, and so
    that a result that is read more than once is computed once. Parquet keeps it
    far smaller than an RDD checkpoint.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drawn(df: DataFrame, rows: int, total: int, seed: int) -> DataFrame:
    """At most ``rows`` distinct rows of df, which has ``total``: those with the smallest hashes of seed and all columns.

    The choice is spread over the whole table and the same in every partitioning and
    order. Repeated rows count once, so a table of mostly repeated rows may give
    fewer. Rows whose hash is far too large are left out before anything moves.
    Columns must not be maps.
    """
    hashed = df.withColumn("_order", F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns]))
    share = 1.5 * rows / max(1, total)
    if share < 1:
        hashed = hashed.where(F.col("_order") < F.lit(int(share * 2.0**64) - 2**63))
    return hashed.dropDuplicates(["_order"]).orderBy("_order").limit(rows).drop("_order")
