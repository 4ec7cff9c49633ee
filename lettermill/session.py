"""A session with the settings this library is tuned for; any of them can be overridden."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",  # small data that is heavy on CPU keeps its tasks
    "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("lettermill")
    if master:
        builder = builder.master(master)
    return builder.config(map=DEFAULTS | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once a session, so that their Python finds it wherever it runs."""
    if getattr(spark, "_lettermill_shipped", False):
        return
    spark._lettermill_shipped = True
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # already imported from an archive that was sent
        return
    archive = Path(tempfile.mkdtemp(prefix="lettermill-code-")) / "lettermill_code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
