"""Session helper, table loader and the place for checkpoints."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tracewright", master: str | None = None, **conf) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer switched on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors share.

    It is ``spark.checkpoint.dir`` where the session sets it.  Where it is unset, a
    temporary folder is used on a local master, whose tasks all share this machine;
    on a cluster that would lose rows, so it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "tracewright-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Folders written by this process, deleted at its end.
_STAGED: list[tuple[SparkSession, str]] = []


def _drop_staged() -> None:
    for spark, path in _STAGED:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have gone first; the folder is then the cleaner's
            pass
    _STAGED.clear()


#: Of a table whose rows are megabytes: at most so many rows, or bytes, in a row group.  A reader holds one
#: row group of each column in memory; the writer counts bytes every 100 rows only, if not told otherwise.
WIDE_ROWS, WIDE_BYTES = 4, 8 << 20
_WIDE = {"parquet.block.row.count.limit": WIDE_ROWS, "parquet.block.size": WIDE_BYTES, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def stage_table(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut at a
    place that survives the loss of any executor.  ``wide``: its rows are
    megabytes, so only a few are written and read at a time.  The folder is
    deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**_WIDE if wide else {}).parquet(path)
    if not _STAGED:
        atexit.register(_drop_staged)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)
