"""Session helpers: a local session for tests and benches, and shipping the package to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent


def local_session(cpus: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once a context; they need no path of the driver's."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    out = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(_ROOT.rglob("*.py")):
            z.write(f, Path(_ROOT.name) / f.relative_to(_ROOT))
    sc.addPyFile(str(out))
    sc._tidemark_shipped = True
