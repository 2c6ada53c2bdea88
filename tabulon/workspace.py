"""Intermediate tables in the folder that all executors share.

Iterative operators write each round as a parquet table below ``spark.checkpoint.dir`` and read it back:
this cuts the lineage, survives lost executors and lets adaptive execution plan each round on real sizes.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a local session without one gets a temporary folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tabulon-")
    _made.append(folder)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


@atexit.register
def _remove_own_folders() -> None:
    for folder in _made:
        shutil.rmtree(folder, ignore_errors=True)


class Workspace:
    """Staged tables of one operator run.

    ``stage`` writes and reads back, ``drop`` deletes tables that are no longer read. What a returned plan still
    reads stays in the shared folder until the folder itself is cleared.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tabulon-{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.paths: dict[int, str] = {}

    def stage(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:04d}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        back._staged_at = path  # keeps the id alive together with the frame
        return back

    def drop(self, *frames: DataFrame) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for frame in frames:
            path = getattr(frame, "_staged_at", None)
            if path:
                where = hadoop.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
