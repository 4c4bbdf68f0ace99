"""Session helpers."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in the executors' Python workers, where it need not be installed. Once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    fd, path = tempfile.mkstemp(prefix="lodestone-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shipped(queries: dict[str, Callable[[SparkSession, str], DataFrame]]) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The same queries, each of which first sees to it that the workers have the package."""

    def wrap(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {k: wrap(f) for k, f in queries.items()}
