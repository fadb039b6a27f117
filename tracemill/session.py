"""Session settings and the scratch folder that written intermediate tables go to."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the bench; on a cluster the caller brings the session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tracemill")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A path for a new folder that all executors can reach; it is deleted when the session's JVM ends.

    It lies under ``spark.checkpoint.dir``. Where that is unset, a temporary folder of this
    machine serves, but only for a local master: on a cluster its files would be lost.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        parent = f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    elif spark.sparkContext.master.startswith("local"):
        parent = tempfile.mkdtemp(prefix=f"{label}-")
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    path = spark._jvm.org.apache.hadoop.fs.Path(parent)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{parent}/data"
