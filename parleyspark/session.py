"""Session defaults. Every operator also works in a session that someone else has set up."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: AQE splits skewed shuffle partitions of materialised inputs and coalesces small ones.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def ship(spark: SparkSession) -> None:
    """Give the package to workers that don't have it installed: as a zip, once a session."""
    import shutil
    import tempfile
    from pathlib import Path

    package = Path(__file__).resolve().parent
    if not any(x.endswith(f"/{package.name}.zip") for x in spark.sparkContext.listFiles):
        made = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(made)


def build_session(master: str | None = None, app: str = "parleyspark", **conf: str) -> SparkSession:
    """A session with the engine's defaults, whose workers know the package; ``conf`` overrides single settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    spark = builder.config(map=DEFAULTS | conf).getOrCreate()
    ship(spark)
    return spark
