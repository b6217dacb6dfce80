"""Tables written in the shared folder, which cut lineage and outlive executors.

The folder is the one the session names in ``spark.checkpoint.dir``. Only where that is unset and all
work is done on this machine (tests, a laptop) one is made and set; on a cluster that is an error.

Reading a plan's estimated size and deleting paths go through the session's JVM gateway, as the public
API has no call for them.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 512
#: Spark partitions of an exchange at most; the groups that are worked on one at a time aren't limited.
PARTITIONS = 1 << 17
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, so that a worker holds a few MB of text at a time.

    Results may be computed after the call, so the session keeps the setting; a caller's own value stays.
    """
    if spark.conf.get(_ROWS_SETTING) == "10000":  # Spark's default
        spark.conf.set(_ROWS_SETTING, str(ARROW_ROWS))


def size_hint(df: DataFrame) -> int:
    """Bytes that the optimizer expects of a frame; where it can't tell, those of its texts and binaries, counted."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if n < 1 << 60:
        return n
    wide = [F.octet_length(F.col(f"`{f.name}`")) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    size = F.lit(8 * len(df.columns)).cast("long")
    for c in wide:
        size = size + F.coalesce(c, F.lit(0))
    return int(df.agg(F.sum(size)).first()[0] or 0)


def groups(df: DataFrame, mb: float = 8.0) -> int:
    """How many groups keep each at about ``mb`` MB of a frame's stored bytes, however many that are."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size_hint(df) / (mb * 1e6)) + 1)


def parts(n: int) -> int:
    """Spark partitions for ``n`` groups, each of which is worked on alone."""
    return min(n, PARTITIONS)


def fresh(taken: list[str], name: str) -> str:
    """``name``, or a longer one that no column has."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_left: list[tuple[SparkSession, str]] = []


@atexit.register
def _clear_left() -> None:
    for spark, path in _left:
        try:
            delete(spark, path)
        except Exception:
            pass


class Scratch:
    """The written tables of one operator call. ``done`` drops all but the one that is returned."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.schemas = spark, {}, {}
        bound_batches(spark)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/corvane-{uuid.uuid4().hex}-{name}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        self.paths[name], self.schemas[name] = path, schema
        self.free()
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        """A saved table, as a frame that can be joined with others of the same table."""
        return self.spark.read.schema(self.schemas[name]).parquet(self.paths[name])

    def free(self) -> None:
        """Shuffle files of plans that are no longer referenced go when the driver's JVM collects them."""
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                delete(self.spark, path)

    def keep(self, name: str) -> None:
        """The table stays until the driver ends."""
        _left.append((self.spark, self.paths.pop(name)))

    def done(self, df: DataFrame, name: str = "result") -> DataFrame:
        out = self.save(df, name)
        self.drop(*[n for n in self.paths if n != name])
        self.keep(name)
        return out
