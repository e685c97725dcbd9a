"""Session helpers: the conf the engine relies on, and lineage cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Confs the engine expects.  AQE is on so that joins against small per-window
# tables become broadcasts only after their real size is known at runtime, and
# skewed join partitions (hot tags) are split.  Static (estimate-based)
# broadcasts are off: size estimates do not follow the 16x copies of the hop
# expansion, so only AQE's measured sizes decide, with sort-merge join (and
# skew splitting) beyond the threshold.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the cluster's builder."""
    b = (
        SparkSession.builder.master(master)
        .appName("hashtrend")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in {**ENGINE_CONF, **extra}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_engine_conf(spark: SparkSession) -> None:
    """Apply the SQL confs (time zone above all) to a session we did not build."""
    for k, v in ENGINE_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; there is no
    machine-local fallback."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(configured)
    return configured


def spread_input(df: DataFrame) -> DataFrame:
    """Round-robin the input over ``hashtrend.input.partitions`` partitions.

    Off unless that conf is set: it helps when the input is a single small row
    group, which one task would read and expand (the bench's tables).
    """
    partitions = df.sparkSession.conf.get("hashtrend.input.partitions", None)
    return df.repartition(int(partitions)) if partitions else df


ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DEFAULT_PROVIDER = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Streaming state in RocksDB (off-heap, spills to local disk, checkpointed), unless the session already names a
    state store provider."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key, _DEFAULT_PROVIDER) == _DEFAULT_PROVIDER:
        spark.conf.set(key, ROCKSDB_PROVIDER)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint dir (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
