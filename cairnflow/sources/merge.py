"""Tables that rows are merged into by key, and tables laid out for searches by box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a new merged table; later merges keep those that it has.
BUCKETS = 64


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def merge_rows(rows: DataFrame, path: str, keys: list[str], *, order: str, buckets: int = BUCKETS) -> None:
    """Merge rows into the table at ``path``: of each key the row of the highest ``order`` stays, whichever came first.

    Rows live in buckets by the hash of their key, a file each. Only buckets that the new
    rows fall into are read and written again; the others keep their files. Equal orders go
    by the rest of the row, so a merge that is run again, or again after it stopped between
    two buckets, leaves the same table. Null keys are keys. A row that marks its key as
    deleted is kept as a row, and :func:`merged` leaves it out.
    """
    spark = rows.sparkSession
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("_bucket", T.IntegerType())])
    if _there(spark, f"{path}/_buckets"):
        buckets = spark.read.parquet(f"{path}/_buckets").first().n
    else:
        spark.range(1).select(F.lit(buckets).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/_buckets")
    new = rows.withColumn("_bucket", _bucket(keys, buckets))
    every = new
    if _there(spark, f"{path}/rows"):
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # at most one number a bucket
        stored = spark.read.schema(schema).parquet(f"{path}/rows")
        every = stored.filter(F.col("_bucket").isin(touched)).select(*names, "_bucket").unionByName(new)
    rest = [c for c in names if c not in (*keys, order)]
    tie = F.to_json(F.struct(*rest)) if rest else F.lit("")  # orders rows of any type
    newest = F.max_by(F.struct(order, *rest), F.struct(F.col(order).alias("a"), tie.alias("b")))
    own = every.groupBy("_bucket", *keys).agg(newest.alias("_r")).select(*keys, "_r.*", "_bucket").select(*names, "_bucket")
    dealt = own.repartition("_bucket").sortWithinPartitions("_bucket", *keys)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{path}/rows")


def merged(spark: SparkSession, path: str, *, deleted: str | None = None) -> DataFrame:
    """The rows of a merged table, without those that are marked as deleted."""
    rows = spark.read.parquet(f"{path}/rows").drop("_bucket")
    return rows if deleted is None else rows.filter(~F.coalesce(F.col(deleted), F.lit(False)))


def _spread(x: Column) -> Column:
    """The 16 lower bits of a number, a zero between each two."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = (x.bitwiseOR(F.shiftleft(x, shift))).bitwiseAND(F.lit(mask).cast("long"))
    return x


def curve_place(latitude: Column, longitude: Column) -> Column:
    """The place of a position on a Z-shaped curve over the globe, 16 bits for each axis; out of range or null is at the rim."""
    step = lambda c, low, width: F.coalesce(F.least(F.greatest(F.floor((c - low) / width * 65536), F.lit(0)), F.lit(65535)).cast("long"), F.lit(0).cast("long"))
    return F.shiftleft(_spread(step(latitude, -90.0, 180.0)), 1).bitwiseOR(_spread(step(longitude, -180.0, 360.0)))


def write_positions(rows: DataFrame, path: str, *, files: int) -> None:
    """Write positions along the curve, so that a file covers a small area, and beside them each file's bounds."""
    spark = rows.sparkSession
    order = ["_place", "latitude", "longitude"]
    rows.withColumn("_place", curve_place(F.col("latitude"), F.col("longitude"))).repartitionByRange(files, *order).sortWithinPartitions(*order).drop("_place").write.mode("overwrite").parquet(f"{path}/rows")
    edges = [f(c).alias(f"{n}_{c}") for c in ("latitude", "longitude") for n, f in (("min", F.min), ("max", F.max))]
    stored = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), *edges).coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")


def box_files(spark: SparkSession, path: str, south: float, west: float, north: float, east: float) -> list[str]:
    """Files that may hold a position of the box, rims included."""
    meets = F.col("max_latitude").between(south, 1e9) & (F.col("min_latitude") <= north) & (F.col("max_longitude") >= west) & (F.col("min_longitude") <= east)
    return [r.file for r in spark.read.parquet(f"{path}/bounds").filter(meets).orderBy("file").select("file").collect()]  # a row a file


def read_box(spark: SparkSession, path: str, south: float, west: float, north: float, east: float) -> DataFrame:
    """Positions of a box, from the files that may hold some; row groups are pruned by the same conditions."""
    from ..operators.fleet import in_box

    schema = spark.read.parquet(f"{path}/rows").schema
    files = box_files(spark, path, south, west, north, east)
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return in_box(rows, south, west, north, east)
