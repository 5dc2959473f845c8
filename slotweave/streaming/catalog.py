"""The image catalog as a file stream: new and changed rows are merged into the latest per path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a catalog, by hash of path: a batch rewrites those it touches.
BUCKETS = 256
#: Versions of a bucket that stay: the newest and its backup.
KEEP = 2


def latest_per_path(rows: DataFrame) -> DataFrame:
    """One row per path: the highest version."""
    return rows.groupBy("path").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "path"]), "version").alias("r")).select("path", "r.*")


def bucket_of(path: str) -> F.Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def run_catalog_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> None:
    """Reads Parquet rows(path, version, ...) under source as they come and keeps the merged catalog under target.

    A batch reads and writes only the buckets of its paths, as target/v=<batch>/bucket=<n>;
    what stands in no bucket of its own stays where an earlier batch put it. A version
    counts once it is whole, and a batch that is run again after a failure begins from the
    versions below its own, so it gives the same table. The checkpoint remembers what was read.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("bucket", bucket_of("path"))
        touched = {r.bucket for r in rows.select("bucket").distinct().collect()}  # at most BUCKETS
        before = read_catalog(spark, target, number, touched)
        merged = batch if before is None else before.unionByName(batch)
        latest_per_path(merged).withColumn("bucket", bucket_of("path")).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{target}/v={number}")
        for bucket, versions in places(spark, target, None).items():
            for old in sorted(versions)[:-KEEP]:
                files, path = file_system(spark, f"{target}/v={old}/bucket={bucket}")
                files.delete(path, True)

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def file_system(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def places(spark: SparkSession, target: str, before: int | None) -> dict[int, list[int]]:
    """bucket -> the whole versions (below `before`) that hold it."""
    found: dict[int, list[int]] = {}
    files, root = file_system(spark, target)
    if not files.exists(root):
        return found
    for version in files.listStatus(root):
        name = version.getPath().getName()
        if not name.startswith("v=") or before is not None and int(name[2:]) >= before:
            continue
        inside = [s.getPath().getName() for s in files.listStatus(version.getPath())]
        for bucket in inside if "_SUCCESS" in inside else []:
            if bucket.startswith("bucket="):
                found.setdefault(int(bucket[7:]), []).append(int(name[2:]))
    return found


def read_catalog(spark: SparkSession, target: str, before: int | None = None, buckets: set[int] | None = None) -> DataFrame | None:
    """The newest version (below `before`) of every bucket, or of some; None if there is none."""
    newest = {b: max(versions) for b, versions in places(spark, target, before).items() if buckets is None or b in buckets}
    return spark.read.parquet(*[f"{target}/v={v}/bucket={b}" for b, v in sorted(newest.items())]) if newest else None
