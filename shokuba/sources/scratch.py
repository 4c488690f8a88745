"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of `df` in spark.checkpoint.dir, so iterative plans stay small and survive lost executors.

    Where the setting is missing, a local session gets a temporary folder; a cluster without it is refused.
    """
    _checkpoint_dir(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As cut_lineage, for large tables of narrow rows: written as Parquet, which packs columns and is read by column."""
    path = f"{_checkpoint_dir(df)}/table-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _checkpoint_dir(df: DataFrame) -> str:
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()
