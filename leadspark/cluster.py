"""Getting this package to the executors, where it need not be installed."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Once a SparkContext: send the package's sources along with the job, before a Python function is made of them."""
    sc = spark.sparkContext
    if getattr(sc, "_leadspark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="leadspark-")) / "leadspark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._leadspark_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the folder of spark.checkpoint.dir. Where that is unset, a temporary one on a local master; on
    any other, executors would each write to a disk of their own, so that is an error."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            path = f"file://{tempfile.mkdtemp(prefix='leadspark-')}"
        sc.setCheckpointDir(path)
    return df.checkpoint()
