"""Session helpers: shared storage, lineage cuts, table access."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a session without that setting (a test on one machine) gets a folder of its own.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="kgloom-")
        spark.conf.set(CHECKPOINT_KEY, named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/kgloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "step", path: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kgloom_path = path
    return out


def materialize_counted(df: DataFrame, label: str = "step", **metrics: Column) -> tuple[DataFrame, dict]:
    """``materialize`` with aggregates of the rows (``count_if`` and the like), gathered while they are written: no job
    of their own."""
    seen = Observation()
    out = materialize(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), label)
    return out, seen.get


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def remove_path(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on any file system Spark knows, replaced in one rename."""
    jvm = spark._jvm
    fs, p = _path(spark, path)
    tmp = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(tmp, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(context.makeQualified(tmp), context.makeQualified(p), rename)


def discard(*frames: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote for frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_kgloom_path", None)
        if path:
            remove_path(df.sparkSession, path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_kgloom_shipped", False):
        return
    here = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="kgloom-")) / "kgloom_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(str(path))
    sc._kgloom_shipped = True


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def optional_table(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    """A table that may be absent: then an empty frame of the declared schema."""
    return table(spark, root, name) if path_exists(spark, f"{root}/{name}.parquet") else spark.createDataFrame([], schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """The session of tests and benchmarks; a cluster brings its own."""
    os.environ.setdefault("PYTHONDONTWRITEBYTECODE", "1")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("kgloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
