"""Session-level helpers shared by all operators: table access, lineage cuts, checked broadcasts, salted joins."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast after it has been counted.
BROADCAST_ROWS = 200_000
#: Rows of one key beyond which the key is spread over several tasks.
HOT_ROWS = 100_000


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerlens_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="ledgerlens-"), "ledgerlens.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, files in os.walk(here):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(here)))
    sc.addPyFile(target)
    sc._ledgerlens_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` (a file or a folder of files) under ``sf_dir``."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent and everything runs in one JVM, as in tests, a temporary folder is used; on a
    cluster without the setting this is an error, since executors would write to different disks.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), "ledgerlens-checkpoints")
    sc.setCheckpointDir(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder; later reads survive the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint when the counted ``rows`` are within ``limit``; else the planner shuffles."""
    return F.broadcast(df) if rows <= limit else df


def salted_join(rows: DataFrame, stats: DataFrame, on: list[str], salt_by: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """Join one ``stats`` row per key to many ``rows`` without gathering a hot key in one task.

    Each row is given one of ``salts`` numbers by the hash of ``salt_by``; each stats row is repeated once per
    number. A key with a third of all rows is thus spread over ``salts`` tasks.
    """
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(F.col(salt_by)), F.lit(salts)).cast("int"))
    right = stats.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def hot_keys(rows: DataFrame, on: list[str], most: int = HOT_ROWS) -> DataFrame | None:
    """``on`` and ``__parts`` of the keys that have more than ``most`` rows, ready to be joined; None where there is none.

    Counting combines on the map side. There are at most rows / most such keys, and they are broadcast only after they
    have been counted.
    """
    hot = cut_lineage(rows.groupBy(*on).count().where(F.col("count") > most).select(*on, F.ceil(F.col("count") / F.lit(most)).cast("int").alias("__parts")))
    many = hot.count()
    return broadcast_if_small(hot, many) if many else None


def salted(rows: DataFrame, hot: DataFrame | None, on: list[str], salt_by: str) -> DataFrame:
    """``rows`` with ``__salt``: 0, or for a hot key a part by the hash of ``salt_by``."""
    if hot is None:
        return rows.withColumn("__salt", F.lit(0))
    parts = rows.join(hot, on, "left")
    return parts.withColumn("__salt", F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64(salt_by), F.col("__parts"))).otherwise(0).cast("int")).drop("__parts")


def repeated(stats: DataFrame, hot: DataFrame | None, on: list[str]) -> DataFrame:
    """``stats`` with ``__salt``: one row per key, for a hot key one per part."""
    if hot is None:
        return stats.withColumn("__salt", F.lit(0))
    parts = stats.join(hot, on, "left")
    return parts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")


def spread_join(rows: DataFrame, stats: DataFrame, on: list[str], salt_by: str, how: str = "inner", most: int = HOT_ROWS) -> DataFrame:
    """Join few ``stats`` rows per key to many ``rows``; keys with more than ``most`` rows are spread over as many tasks as their count asks for."""
    hot = hot_keys(rows, on, most)
    if hot is None:
        return rows.join(stats, on, how)
    return salted(rows, hot, on, salt_by).join(repeated(stats, hot, on), [*on, "__salt"], how).drop("__salt")
