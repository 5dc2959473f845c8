"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(c, UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a private one is set only in local mode and where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def id_type(docs: DataFrame) -> str:
    """The type of docs' doc_id, for the schemas of operators that pass it on."""
    return docs.schema["doc_id"].dataType.simpleString()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it back: lineage ends here and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df with a number for each row, written once so that the numbers stay, and the new column's name, which no other column has."""
    column = "row_number"
    while column in {c.lower() for c in df.columns}:
        column += "_"
    return materialise(df.withColumn(column, F.monotonically_increasing_id()), name), column


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Each round takes the least label over a node's neighbours (pre-aggregated before
    the shuffle) and then jumps to the label's own label, so long chains shrink by
    doubling. Every round is a written table; joins see plain exchanges on both
    sides, which lets adaptive execution split a hot node's rows.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = materialise(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "cc-labels"
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("a"), "component"), "a")
            .groupBy(F.col("b").alias("node"))
            .agg(F.min("component").alias("seen"))
        )
        seen = materialise(
            labels.join(near, "node").select("node", F.least("component", "seen").alias("component"), F.col("component").alias("was")),
            "cc-seen",
        )
        up = seen.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = materialise(
            seen.join(up, "component").select("node", F.least("component", "above").alias("component"), (F.col("above") != F.col("was")).alias("moved")),
            "cc-labels",
        )
        moved = jumped.filter("moved").limit(1).count()
        discard(seen)
        discard(labels)
        labels = jumped.select("node", "component")
        if not moved:
            discard(both)
            return labels
