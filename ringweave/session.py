"""Session helpers: the shared work folder, tables written there, and the package on executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of the file system that Spark takes it for."""
    if "://" in path:
        return path
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return re.sub("^file:/(?!/)", "file:///", full)


def work_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that setting is absent, a non-local master gets a folder beside the warehouse (which is
    shared as well) and a local master, as in tests, a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return qualified(spark, named.rstrip("/"))
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="ringweave-")
        else:
            _OWN[app] = qualified(spark, spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_ringweave_work")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else uses, in a folder of this application's own."""
    return f"{_own_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/ringweave/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder. Results that read it must be done with."""
    _delete(spark, _own_dir(spark))


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts the lineage: losing an executor later costs a re-read, not a re-computation.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that a later one has replaced; nothing may read it any more."""
    if path := getattr(df, "_stored_at", None):
        _delete(df.sparkSession, path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt to several tasks for each core, by ``keys``: for small rows that make much work, of which one task
    would read many millions."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


#: Bytes of an Arrow batch. Texts are long, and a worker and its task hold a batch in several forms at once.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def _bytes(text: str) -> int:
    """A size as Spark writes it: 64m, 1g, 100b, 100."""
    m = re.fullmatch(r"(\d+)([kmgt]?)b?", text.strip().lower())
    return int(m[1]) << 10 * " kmgt".index(m[2] or " ") if m else 0


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers can import it.

    Also holds Arrow batches to ``BATCH``, where the session has larger ones: that setting of the session is changed,
    as plans read it when they run, which may be after the operator has returned.
    """
    if _bytes(spark.conf.get(BATCH[0])) > BATCH[1]:
        spark.conf.set(*map(str, BATCH))
    app = "shipped:" + spark.sparkContext.applicationId
    if app in _OWN:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ringweave-zip-"), "ringweave.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.join("ringweave", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(path)
    _OWN[app] = path
