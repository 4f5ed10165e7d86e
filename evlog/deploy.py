"""Getting this package to the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application's Python files, once: functions that run on executors import it there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="evlog-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    to = Path(folder) / f"{here.name}.zip"
    with zipfile.ZipFile(to, "w") as out:
        for source in sorted(here.rglob("*.py")):
            out.write(source, source.relative_to(here.parent))
    context.addPyFile(str(to))
    _shipped.add(context.applicationId)
