"""Session settings the jobs assume, and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on. All can be changed by the cluster.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Lets the runtime split a hot join key even if the join feeds an aggregate.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

STREAM_STATE_CONF = {
    # State on local disk with changelog upload, so it may exceed executor memory.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app: str = "postmill", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {**RUNTIME_CONF, **STREAM_STATE_CONF, "spark.ui.enabled": "false",
                "spark.ui.showConsoleProgress": "false"}
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    """Put the settings on a session somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder named by ``spark.checkpoint.dir``.

    Only on one machine (a local master) that names none a temporary folder is chosen and recorded in the
    session, so later calls agree on it. On a cluster that is an error: machines do not see each other's folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("postmill.local.scratch", None)
    if not root and not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    if not root:
        root = tempfile.mkdtemp(prefix="postmill-")
        spark.conf.set("postmill.local.scratch", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table written to the shared folder and read back.

    Used where a narrow intermediate is needed several times and its source is costly to read;
    it outlives the loss of any executor.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unsized(df: DataFrame) -> DataFrame:
    """The frame as a side of a join that is sorted and merged, whatever size Spark takes it for.

    Used where a table grows with the input and its size is guessed too low: an explode counts as one row for each of its
    input, a written table as its compressed files. What is broadcast passes through the driver.
    """
    return df.hint("merge")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
