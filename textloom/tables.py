"""Tables in the folder that all executors share, and global positions over them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Where that is unset, as in tests, a local session,
    whose executors are threads of this machine, gets a temporary folder; any other raises."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir is unset: set it to a folder that all executors share, when the session is made")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="textloom-")
    return _own[context.applicationId]


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as tasks run at once: a small file, of one row group, would be one task's. A table of
    more partitions than that, as any large one is, stays as it is and isn't shuffled."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


#: Bytes of file for a task of a query whose Python takes seconds for each of them.
TASK_BYTES = 1 << 19


def tasks(df: DataFrame) -> int:
    """How many tasks work in Python that costs much a byte is dealt to: by the size of the files that df reads, as their row
    groups may be of any size and number, so that no task is long, and one a core at least."""
    cores, size = df.sparkSession.sparkContext.defaultParallelism, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(cores, min(64 * cores, -(-size // TASK_BYTES)))


def dealt(df: DataFrame, *keys: Column | str, like: DataFrame | None = None) -> DataFrame:
    """df in tasks(like or df) partitions, by keys if there are any. The number is fixed, so that partitions of few bytes aren't
    joined again."""
    return df.repartition(tasks(like or df), *keys)


BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def bounded(spark: SparkSession) -> None:
    """Keeps the Arrow batches of the session's Python stages small, unless they are smaller already. It stays so for the
    session, as the setting is read when a result is computed, which is after the operator has returned."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("b")  # with its default, where it is unset
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def scratch(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_dir(spark)}/textloom/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, which outlives any executor."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, order: list[Column | str], name: str) -> tuple[DataFrame, int]:
    """(df with each row's place in the order, from 0; number of rows). The rows are parted by ranges of the order, so no
    task sorts them all, and only the sizes of the parts come to the driver."""
    sort = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # monotonically_increasing_id is the partition's number above 33 bits and the row's place in it below
    sort = written(sort.withColumn(name, F.monotonically_increasing_id()), "numbered")
    sizes = sorted(sort.groupBy(F.shiftright(F.col(name), 33).alias("part")).count().collect())
    offsets, total = {}, 0
    for part, n in sizes:
        offsets[part] = total
        total += n
    if not offsets:
        return sort, 0
    before = F.create_map(*(F.lit(x) for p in offsets.items() for x in p))
    at = F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + before[F.shiftright(F.col(name), 33)]
    return sort.withColumn(name, at.cast("long")), total
