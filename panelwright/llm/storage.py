"""Tables written once in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from panelwright.plans.session import checkpoint


def shared_folder(spark: SparkSession) -> str | None:
    """The session's ``spark.checkpoint.dir``; None where a local session has none."""
    return spark.conf.get("spark.checkpoint.dir", None)


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back.

    Later stages read the table, so a lost executor never repeats what went before,
    and rows keep the values they were written with.  A local session without the
    setting uses a reliable checkpoint in its own folder.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder is None:
        return checkpoint(df)
    path = f"{folder.rstrip('/')}/panelwright-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str = "found") -> str:
    """``name``, with underscores as long as ``df`` has such a column (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
