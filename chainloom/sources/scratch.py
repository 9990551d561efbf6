"""Files that queries write from the supplied tables and read back, on the store that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local session that names none gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='chainloom-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder; results are lazy and may read it, so it goes when the driver's Python ends."""
    root = f"{shared_dir(spark)}/chainloom-{name}-{uuid.uuid4().hex[:12]}"

    def remove() -> None:
        try:
            at, store = _path(spark, root)
            store.delete(at, True)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            return

    atexit.register(remove)
    return root


def one_file(df: DataFrame, path: str, sep: str = "\t", first_line: str = "") -> str:
    """Rows as one delimited file of this name, in their order, after a line that isn't the header if one is given."""
    spark, parts = df.sparkSession, f"{path}.parts"
    df.coalesce(1).write.mode("overwrite").options(sep=sep, header=True, quote='"', escape='"', emptyValue="").csv(parts)
    at, store = _path(spark, path)
    out = store.create(at, True)
    try:
        if first_line:
            out.write(bytearray(first_line.encode() + b"\n"))
        for status in sorted(store.listStatus(_path(spark, parts)[0]), key=lambda s: s.getPath().getName()):
            if status.getPath().getName().startswith("part-"):
                source = store.open(status.getPath())
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
                source.close()
    finally:
        out.close()
    store.delete(_path(spark, parts)[0], True)
    return path
