"""Tables written to the folder all executors share, to cut lineage and to learn sizes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, the warehouse folder."""
    root = (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getCheckpointDir()
        or spark.conf.get("spark.sql.warehouse.dir")
    )
    return root.rstrip("/")


# Arrow batches to Python tasks: rows and bytes at most.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch sizes to what tasks over whole texts need.

    The default of 10,000 rows says nothing of their length. Lower settings stay.
    """
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    ):
        now = spark.conf.get(key).removesuffix("b")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/llm-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    A lost executor costs no more than the stage it was in, and the planner knows
    the table's true size, so it broadcasts it only when it is under the session's
    threshold.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
