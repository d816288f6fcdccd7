"""Session helpers shared by all operators: settled tables, worker code, exact column picking."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where that is unset.

    Only a local session may have one of its own; on a cluster executors would each write to their own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = getattr(spark.sparkContext, "_linkweave_root", None)
        if root is None:
            root = "file://" + tempfile.mkdtemp(prefix="linkweave-")
            spark.sparkContext._linkweave_root = root
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/linkweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession) -> None:
    """Delete what this session has settled or written below the shared folder.

    Results are read from it lazily, so it's the caller who knows when: once results are written elsewhere, or at the end.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/linkweave/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there and a lost executor loses nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """A side of a join that's never broadcast.

    Spark guesses the size of arrays and texts made of a file from that file, so that it may send gigabytes through the driver.
    """
    return df.hint("merge")


def ship(spark: SparkSession) -> None:
    """Give executors this package, whatever their Python path is (once per session)."""
    context = spark.sparkContext
    if getattr(context, "_linkweave_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="linkweave-code-"), "linkweave_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(PACKAGE.parent).as_posix())
    context.addPyFile(archive)
    context._linkweave_shipped = True


def by_value(module: str) -> None:
    """Send a module's functions to executors whole, so that column functions work where the package isn't installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select columns by exact name (the first of several), so that others whose names clash don't matter.

    ``pick(df, id="doc_id")`` returns column ``id``.
    """
    names = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_{names.index(source)}").alias(target) for target, source in columns.items()])


def beside(df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with columns renamed by position, and where each exact name went; ``toDF(*df.columns)`` undoes it."""
    names = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    return plain, {name: F.col(f"_{names.index(name)}") for name in names}


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that ``body`` can use it often and it's computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
