"""Session set-up and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "texelmill") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # colour rows are few bytes but much arithmetic: keep all cores busy on small tables
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder before running this operator")
        folder = tempfile.mkdtemp(prefix="texelmill-")
        sc.setCheckpointDir(folder)
    return folder


#: Set, Spark removes an execution's shuffle files at its end. Otherwise they stay until the driver's garbage collector comes upon them, on large inputs too late.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate result once as a table in the shared folder and go on from that table.

    A frame used several times further down is then computed once, survives lost executors, and is planned with its
    real size, so joins against it choose broadcast or shuffle by what was written. The write's shuffle files go with its end.
    """
    spark = df.sparkSession
    target = f"{checkpoint_folder(spark)}/texelmill/{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(target)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    table = spark.read.schema(df.schema).parquet(target)
    table._written_to = target
    return table


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables that :func:`cut_lineage` has returned and that no frame still in use reads."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(vars(table)["_written_to"])
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
