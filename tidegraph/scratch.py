"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset and Spark runs in one process."""
    global _own
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="tidegraph-")
        atexit.register(shutil.rmtree, _own, True)
    return f"file://{_own}"


_steps: list[tuple[SparkSession, str]] = []
#: Rows of a step that come to the driver rather than to the shared folder; a step that has more is written.
MOST_HELD = 10_000


@atexit.register
def _sweep() -> None:
    for spark, path in _steps:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended by now
            pass


def kept(df: DataFrame) -> DataFrame:
    """df, written and read back: an iteration's lineage ends here. The table goes at exit."""
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    _steps.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """Ends the lineage of each step of an iteration: at most MOST_HELD rows through the driver, more through the shared folder.

    After a step with more rows the next one is written without a look at the driver first, so large steps run once.
    """

    def __init__(self):
        self.small = True
        #: Rows of the step held last, and how many of them have the flag.
        self.rows = self.flagged = 0

    def hold(self, df: DataFrame, flag: str | None = None) -> DataFrame:
        if self.small:
            rows = df.limit(MOST_HELD + 1).toArrow()
            if rows.num_rows <= MOST_HELD:
                self.rows = rows.num_rows
                self.flagged = sum(map(bool, rows.column(flag).to_pylist())) if flag else 0
                return df.sparkSession.createDataFrame(rows, schema=df.schema)
        out = kept(df)
        self.rows, self.flagged = out.agg(F.count(F.lit(1)), F.count_if(F.col(flag)) if flag else F.lit(0)).first()
        self.small = self.rows <= MOST_HELD
        return out
