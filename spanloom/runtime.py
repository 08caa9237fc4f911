"""Session settings, table loading and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WORK: dict[str, str] = {}


def session(app: str = "spanloom", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the library expects."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. A
    temporary folder of this machine is taken only where the setting is missing
    and the session is a plain local one."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "tmp" not in _WORK:
        _WORK["tmp"] = tempfile.mkdtemp(prefix="spanloom-")
        atexit.register(shutil.rmtree, _WORK["tmp"], True)
    return f"file://{_WORK['tmp']}"


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the process ends."""
    path = f"{shared_dir(spark)}/spanloom/{label}-{uuid.uuid4().hex}"
    atexit.register(_forget, path)
    return path


def _forget(path: str) -> None:
    """At the end of the process: by the session's file system while there is one."""
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None:
            drop_path(spark, path)
            return
    except Exception:  # the session is going down
        pass
    local = path.removeprefix("file://").removeprefix("file:")
    if local.startswith("/"):
        shutil.rmtree(local, ignore_errors=True)


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = _file(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file(spark, path)
    return fs.exists(p)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: what
    follows depends on replicated files, not on blocks of one executor."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


