"""Tables that writes replace as a whole: unique keys, columns that are only added, versions.

A table is a folder of numbered versions, each a Parquet folder. A write is staged beside
them and becomes the next version by one rename, so a killed write leaves the version before
it; what it staged is ignored and removed by a later one. A version remembers the batch that
made it, so a batch that is run again is not applied twice. One writer at a time: a second
one that renames to the same number fails. (On stores where a rename copies, point the folder
at one that can rename.)

Cases: a table that does not exist reads as None; a null key is a key like any other; of rows
of one key in a batch the last by ``order``, then by a hash of the row, stays; columns that a
batch lacks keep their old values, columns that are new are null in old rows; an empty batch
makes a version of its own, so that it counts as done.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_VERSION = re.compile(r"^v(\d{10})$")
_BATCH = re.compile(r"^_batch-(-?\d+)$")


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _names(fs, at) -> list[str]:
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def versions(spark: SparkSession, path: str) -> list[tuple[int, int | None]]:
    """(number, batch) of the committed versions, oldest first."""
    fs, of = _fs(spark, path)
    out = []
    for name in _names(fs, of(path)):
        if m := _VERSION.match(name):
            batches = [int(b[1]) for x in _names(fs, of(f"{path}/{name}")) if (b := _BATCH.match(x))]
            out.append((int(m[1]), max(batches, default=None)))
    return sorted(out)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a table."""
    known = versions(spark, path)
    return spark.read.parquet(f"{path}/v{known[-1][0]:010d}") if known else None


def commit(df: DataFrame, path: str, batch: int | None = None, keep: int = 2) -> int:
    """Makes ``df`` the next version and removes those before the last ``keep``, and what killed writes staged."""
    spark = df.sparkSession
    fs, of = _fs(spark, path)
    known = versions(spark, path)
    number = known[-1][0] + 1 if known else 1
    last = batch if batch is not None else known[-1][1] if known else None
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    if last is not None:
        fs.create(of(f"{staged}/_batch-{last}")).close()
    final = of(f"{path}/v{number:010d}")
    if fs.exists(final) or not fs.rename(of(staged), final):
        fs.delete(of(staged), True)
        raise RuntimeError(f"another writer made version {number} of {path}")
    for name in _names(fs, of(path)):
        old = _VERSION.match(name)
        if name.startswith("_staged-") or (old and int(old[1]) <= number - keep):
            fs.delete(of(f"{path}/{name}"), True)
    return number


def changed(spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame], batch: int | None = None) -> bool:
    """Commits what ``change`` makes of the current version, unless its batch has been applied before."""
    known = versions(spark, path)
    if batch is not None and known and known[-1][1] is not None and known[-1][1] >= batch:
        return False
    commit(change(current(spark, path)), path, batch)
    return True


def merged(old: DataFrame | None, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` by ``keys``, in one shuffle; the columns of both."""
    newer = new.withColumn("_new", F.lit(1))
    both = newer if old is None else old.withColumn("_new", F.lit(0)).unionByName(newer, allowMissingColumns=True)
    kept = [] if old is None else [c for c in old.columns if c not in new.columns]
    own = [c for c in new.columns if c not in keys]
    plain = [c for c, kind in new.dtypes if "map<" not in kind and "variant" not in kind]
    last = F.struct(F.col("_new"), *[F.col(c) for c in order or []], F.xxhash64(*plain))
    # aggregates of structs, so that a null in the last row stays a null
    rows = both.groupBy(*keys).agg(
        F.max_by(F.struct(*own, F.lit(1).alias("_one")), last).alias("_own"),
        F.max_by(F.struct(*kept, F.lit(1).alias("_one")), F.when(F.col("_new") == 0, 0)).alias("_kept"),
    )
    columns = (old.columns if old is not None else []) + [c for c in new.columns if old is None or c not in old.columns]
    at = lambda c: F.col(c) if c in keys else F.col("_own")[c].alias(c) if c in own else F.col("_kept")[c].alias(c)
    return rows.select(*map(at, columns))


def upsert(rows: DataFrame, path: str, keys: list[str], order: list[str] | None = None, batch: int | None = None) -> bool:
    """Inserts rows or replaces those of the same keys."""
    return changed(rows.sparkSession, path, lambda old: merged(old, rows, keys, order), batch)


def insert(rows: DataFrame, path: str, keys: list[str], batch: int | None = None) -> bool:
    """Inserts the rows whose keys the table does not have; a repeated write adds nothing."""

    def change(old: DataFrame | None) -> DataFrame:
        single = merged(None, rows, keys)
        if old is None:
            return single
        same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
        fresh = single.alias("n").join(old.select(*keys).alias("o"), same, "left_anti").select("n.*")
        return old.unionByName(fresh, allowMissingColumns=True)

    return changed(rows.sparkSession, path, change, batch)


def created(spark: SparkSession, path: str, schema: str) -> bool:
    """Makes sure that a table exists with these columns; missing ones are added, none is
    dropped or changed. Running it again changes nothing."""
    empty, old = spark.createDataFrame([], schema), current(spark, path)
    if old is not None and set(empty.columns) <= set(old.columns):
        return False
    commit(empty if old is None else old.unionByName(empty, allowMissingColumns=True), path)
    return True


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that more than one row has, with their number."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def detached(rows: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """``rows`` with a reference set to null where its parent is gone."""
    there = parents.select(F.col(key).alias("_parent")).where("_parent is not null").distinct()
    return rows.join(there, F.col(column) == F.col("_parent"), "left").withColumn(column, F.col("_parent")).select(*rows.columns)
