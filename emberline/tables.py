"""Tables in shared storage: written intermediate results, appends, overwrites."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: One list of paths for each ``scratch`` that is open, the innermost last.
_scratch: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set: a temporary one in local mode, an error on a cluster."""
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir"):
        return folder
    if (held := sc._jsc.sc().getCheckpointDir()).isDefined():
        return held.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="emberline-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _hadoop(spark: SparkSession, path: str):
    """(path, file system) of a path."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession) -> str:
    """A path for an intermediate table that nothing lies at yet."""
    return f"{shared_folder(spark)}/emberline-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Take away an intermediate table before the application ends."""
    own, fs = _hadoop(spark, path)
    fs.delete(own, True)
    fs.cancelDeleteOnExit(own)


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a written table, computed once and safe from lost executors.

    It goes at the end of the innermost ``scratch``, or with the application; ``remove`` takes one at a given
    ``path`` (of ``fresh_path``) sooner.
    """
    path = path or fresh_path(df.sparkSession)
    df.write.parquet(path)
    own, fs = _hadoop(df.sparkSession, path)
    fs.deleteOnExit(own)
    if _scratch:
        _scratch[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """The tables materialized inside are removed at the end: for what runs again and again in one application."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(spark, path)


def _settle(spark: SparkSession, path: str) -> bool:
    """Whether the table exists; one that a broken ``replace`` left aside is put back first."""
    target, fs = _hadoop(spark, path)
    if fs.exists(target):
        return True
    aside, _ = _hadoop(spark, f"{path}.replaced")
    return bool(fs.exists(aside) and fs.rename(aside, target))


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table with its columns in the schema's order, wherever they are partition columns."""
    return spark.read.schema(schema).parquet(path).select(schema.names) if _settle(spark, path) else spark.createDataFrame([], schema)


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    """Add rows; by names a column that the table is partitioned by, each value in few files."""
    _settle(df.sparkSession, path)
    if by is None:
        df.write.mode("append").parquet(path)
    else:
        df.hint("rebalance", by).write.mode("append").partitionBy(by).parquet(path)


def replace(df: DataFrame, path: str, by: str | None = None) -> None:
    """Overwrite a table with rows that may be computed from it: written beside it, then moved.

    At every moment the old rows lie at the path or aside, where ``_settle`` finds them.
    """
    spark = df.sparkSession
    fresh = f"{path}.new-{uuid.uuid4().hex}"
    append(df, fresh, by)
    had = _settle(spark, path)
    target, fs = _hadoop(spark, path)
    aside, _ = _hadoop(spark, f"{path}.replaced")
    if had:
        fs.delete(aside, True)
        fs.rename(target, aside)
    fs.rename(_hadoop(spark, fresh)[0], target)
    fs.delete(aside, True)
    spark.catalog.refreshByPath(path)


def swap(spark: SparkSession, folder: str, by: str, values: list, tables: list[tuple[DataFrame, str]]) -> None:
    """Replace some partitions of tables under a folder, of all of them as one step; other partitions are not touched.

    Each (rows, path) has all rows of the partitions with these values; one without rows goes. The new partitions are written
    beside the tables first. Then a plan of moves is put down, by one rename: from there on the step counts as done, and
    whoever writes next ends it with ``finish_swaps``, wherever it broke off.
    """
    moves: list[list[str | None]] = []
    named = {f"{by}={value}" for value in values}
    for rows, path in tables:
        _settle(spark, path)
        fresh = f"{path}.fresh-{uuid.uuid4().hex}"
        append(rows, fresh, by)
        own, fs = _hadoop(spark, fresh)
        written = {x.getPath().getName() for x in fs.listStatus(own) if x.isDirectory()}
        if not written <= named:
            raise ValueError(f"rows outside the partitions that are replaced: {sorted(written - named)}")
        moves += [[f"{path}/{name}", f"{fresh}/{name}" if name in written else None] for name in sorted(named)]
    plan, fs = _hadoop(spark, f"{folder}/_swaps/{uuid.uuid4().hex}.json")
    draft, _ = _hadoop(spark, f"{folder}/_drafts/{plan.getName()}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(moves), "utf-8"))
    out.close()
    fs.mkdirs(plan.getParent())
    fs.rename(draft, plan)
    finish_swaps(spark, folder)


def finish_swaps(spark: SparkSession, folder: str) -> int:
    """End the swaps under a folder that have a plan; how many there were. Doing a move again changes nothing."""
    where, fs = _hadoop(spark, f"{folder}/_swaps")
    plans = sorted(str(x.getPath()) for x in fs.listStatus(where)) if fs.exists(where) else []
    for plan in plans:
        moves = json.loads(spark.read.text(plan, wholetext=True).first()[0])
        for target, fresh in moves:
            _move(spark, target, fresh)
        fs.delete(_hadoop(spark, plan)[0], True)
        for fresh in {fresh.rpartition("/")[0] for _, fresh in moves if fresh}:
            fs.delete(_hadoop(spark, fresh)[0], True)
        for path in {target.rpartition("/")[0] for target, _ in moves}:
            spark.catalog.refreshByPath(path)
    return len(plans)


def _move(spark: SparkSession, target: str, fresh: str | None) -> None:
    """Put a partition in the place of another, or take it away; one that was moved already is left alone."""
    to, fs = _hadoop(spark, target)
    if fresh is None:
        fs.delete(to, True)
    elif fs.exists(_hadoop(spark, fresh)[0]):
        fs.delete(to, True)
        fs.mkdirs(to.getParent())
        fs.rename(_hadoop(spark, fresh)[0], to)


def file_counts(spark: SparkSession, path: str) -> dict[str, int]:
    """How many data files each partition of a table has, by the partition's folder name; those beside partitions count for ""."""
    own, fs = _hadoop(spark, path)
    if not fs.exists(own):
        return {}
    data = lambda files: sum(not x.getPath().getName().startswith(("_", ".")) and not x.isDirectory() for x in files)
    listed = list(fs.listStatus(own))
    found = {x.getPath().getName(): data(fs.listStatus(x.getPath())) for x in listed if x.isDirectory() and "=" in x.getPath().getName()}
    return found | ({"": n} if (n := data(listed)) else {})
