"""Cut lineage by writing a table into the folder that all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only where that
setting is absent (local tests) a folder of this process is used instead.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session; a temporary one only on a local master without the setting."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="porelith-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and return the table read back; survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/staged-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _written.append((spark, path.rpartition("/")[0]))
    out = spark.read.schema(df.schema).parquet(path)
    out._porelith_path = path.rpartition("/")[0]
    return out


def dropped(df: DataFrame | None) -> None:
    """Delete a staged table that nothing will read again."""
    path = getattr(df, "_porelith_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    """Delete what this process staged; without a session only what lies in a local folder."""
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            try:
                _delete(spark, path)
                continue
            except Exception:  # the gateway may have gone first
                pass
        if "://" not in path or path.startswith("file:"):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
