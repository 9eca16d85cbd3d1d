"""Session settings and shipping the package to executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


#: The JVM doesn't compile methods of more bytecode than this. Spark's own limit is far above it, and beyond the JVM's a generated stage runs interpreted.
HUGE_METHOD = ("spark.sql.codegen.hugeMethodLimit", "8000")


def tuned(spark: SparkSession) -> SparkSession:
    """Lets stages with very many expressions run by operator, in methods that the JVM compiles. A limit set by the user stays."""
    if spark.conf.get(HUGE_METHOD[0], None) in (None, "65535"):
        spark.conf.set(*HUGE_METHOD)
    return spark


def get_session(app: str = "tallystone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution. Memory, cores and shuffle partitions are left to the cluster."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return tuned(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = Path(__file__).parent
        with tempfile.TemporaryDirectory() as tmp:
            top = Path(tmp) / "top"
            shutil.copytree(here, top / here.name, ignore=shutil.ignore_patterns("__pycache__"))
            made = shutil.make_archive(f"{tempfile.mkdtemp()}/{here.name}", "zip", top)
        spark.sparkContext.addPyFile(made)
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or what setCheckpointDir() was given.

    Where neither is set, as in tests, a local session gets a folder of its own; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="tallystone-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: what several steps use is made once, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
