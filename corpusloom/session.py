"""Session set-up for local runs; a cluster passes its own session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", name: str = "corpusloom") -> SparkSession:
    """A local session with the settings that the queries are tested under."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark application.

    Workers that Spark runs beside the driver, for streams and their sources, find it by their path."""
    import os
    import tempfile
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_corpusloom_shipped", False):
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="corpusloom-")) / "corpusloom.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    context.addPyFile(str(path))
    context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [context.environment.get("PYTHONPATH"), str(path)]))
    context._corpusloom_shipped = True
