"""rankweave: retrieval, ranking and corpus preparation as lazy Spark plans."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, as spark-submit --py-files would."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="rankweave-")) / "rankweave.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as bundle:
        for source in sorted(here.rglob("*.py")):
            bundle.write(source, f"rankweave/{source.relative_to(here)}")
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
