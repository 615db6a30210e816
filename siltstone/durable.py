"""What must outlive a lost executor: tables written to the shared folder, and sums along an order without one task for all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, named by the cluster in spark.checkpoint.dir; where that is unset a temporary one, on a single machine only."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None) or getattr(sc, "_siltstone_dir", None)
    if where is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = sc._siltstone_dir = tempfile.mkdtemp(prefix="siltstone-")
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """df cut off from its lineage: as Parquet in the shared folder, read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_missing(e: AnalysisException) -> bool:
    """Whether a read failed because there is nothing at its path, and for no other reason."""
    return (e.getCondition() or "").startswith("PATH_NOT_FOUND")


def sums_before(rows: DataFrame, order: list[str], **costs) -> DataFrame:
    """rows with, for each cost, the sum over all rows before in the order (0 for the first; order must tell rows apart).

    Rows are dealt by ranges of the order; the driver sees one sum a range."""
    named = rows.select("*", *[F.coalesce(c, F.lit(0)).alias(f"_{k}") for k, c in costs.items()])
    dealt = written(named.repartitionByRange(*order).withColumn("_block", F.spark_partition_id()), "ordered")
    total = dealt.groupBy("_block").agg(*[F.sum(f"_{k}").alias(k) for k in costs]).orderBy("_block").collect()
    at, before = dict.fromkeys(costs, 0), []
    for r in total:
        before.append((r["_block"], *[at[k] for k in costs]))
        at = {k: v + r[k] for k, v in at.items()}
    types = {f.name: f.dataType.simpleString() for f in dealt.select(*[F.sum(f"_{k}").alias(k) for k in costs]).schema}
    of = rows.sparkSession.createDataFrame(before, ", ".join(["_block int", *[f"_at_{k} {types[k]}" for k in costs]]))
    inside = Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = {k: F.col(f"_at_{k}") + F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)) for k in costs}
    return dealt.join(F.broadcast(of), "_block").select(*rows.columns, *[v.alias(k) for k, v in sums.items()])
