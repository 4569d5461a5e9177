"""Scratch tables, names that clash with none of a table's, and the code that Python workers need."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

from sparkloom.scratch import discard, new_path, saved, shared_dir

__all__ = ["discard", "free_name", "hash_limit", "new_path", "saved", "shared_dir", "ship"]


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have, in any case of letters."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def hash_limit(share: float) -> int:
    """The 64-bit hash that the share of all hashes lies at or below."""
    return max(-(1 << 63), min(int(share * (1 << 64)) - (1 << 63), (1 << 63) - 1))


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, whatever their working folder is."""
    sc = spark.sparkContext
    if getattr(sc, "_sparkloom_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="sparkloom-py-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "sparkloom_py.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(target)
    sc._sparkloom_shipped = True
