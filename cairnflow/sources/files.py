"""File sources and sinks: texts, JSON with a schema, validated records and idempotent appends."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def allowed(path: str, roots: list[str]) -> bool:
    """Whether a path lies under one of the roots, by its components and without any that lead up."""
    parts = PurePosixPath(path).parts
    return ".." not in parts and any(parts[: len(r)] == r for r in (PurePosixPath(x).parts for x in roots))


def read_texts(spark: SparkSession, path: str, roots: list[str]) -> DataFrame:
    """(file_name, text) of whole UTF-8 files under an allowed folder."""
    if not allowed(path, roots):
        raise PermissionError(f"{path} is outside the allowed folders")
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"[^/]+$", 0).alias("file_name"), F.col("value").alias("text"))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON array, with a declared schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def split_valid(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) rows; a rejected one names the rules that it breaks. A rule that is null is broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items())))
    judged = rows.withColumn("reject_reasons", broken)
    return judged.filter(F.size("reject_reasons") == 0).drop("reject_reasons"), judged.filter(F.size("reject_reasons") > 0)


def new_rows(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append so that a key is inserted once: those whose key is not there, each key once."""
    return rows.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def corpus_findings(docs: DataFrame, *, domains: dict[str, list[str]], least: int = 200, most: int = 3000) -> DataFrame:
    """(doc_id, level, message) of a corpus: missing fields, unknown values, clearance, lengths and repeated ids."""
    size = F.length("text")
    rules = [("error", F.col(c).isNull(), f"{c} is missing") for c in docs.columns]
    rules += [("error", ~F.col(c).isin(values), f"{c} is not known") for c, values in domains.items()]
    rules += [("warning", size < least, "text is short"), ("warning", size > most, "text is long")]
    if "clearance_level" in docs.columns:
        rules.append(("error", ~F.col("clearance_level").between(1, 4), "clearance is not 1 to 4"))
    found = F.array_compact(F.array(*(F.when(hit, F.struct(F.lit(level).alias("level"), F.lit(text).alias("message"))) for level, hit, text in rules)))
    single = docs.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.level", "f.message")
    repeated = docs.groupBy("doc_id").count().filter("count > 1").select("doc_id", F.lit("error").alias("level"), F.lit("doc_id is repeated").alias("message"))
    return single.unionByName(repeated)


def with_manifest(texts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents of a manifest (file_name, document_id, department_id, clearance_level, title) with their texts; files that are not there are left out."""
    return manifest.join(texts, "file_name").withColumnRenamed("file_name", "source_file")


def corpus_profile(docs: DataFrame, *, kind: str) -> DataFrame:
    """Documents of each type and, without one, of all, with least, mean and greatest length."""
    size = F.length(F.coalesce("text", F.lit("")))
    return docs.rollup(kind).agg(F.count("*").alias("n"), F.min(size).alias("min_chars"), F.round(F.avg(size), 4).alias("mean_chars"), F.max(size).alias("max_chars"))


def append_returning(rows: DataFrame, path: str, *, now: Column, id_col: str = "id") -> DataFrame:
    """Append rows with an id and a time that they lack, and return what was written.

    The rows of one call are a folder of their own, so the answer is read back from the
    files: what a caller gets is what is stored.
    """
    import uuid

    filled = rows
    if id_col not in rows.columns:
        filled = filled.withColumn(id_col, F.expr("uuid()"))
    if "created_at" not in rows.columns:
        filled = filled.withColumn("created_at", now)
    own = f"{path}/batch={uuid.uuid4().hex}"
    filled.write.parquet(own)
    return rows.sparkSession.read.schema(filled.schema).parquet(own)


def upsert_rows(rows: DataFrame, path: str, keys: list[str], *, order: str) -> None:
    """Add rows as another version; :func:`current_rows` reads the last of each key."""
    rows.dropDuplicates(keys).write.mode("append").option("mergeSchema", "true").partitionBy(order).parquet(path)


def current_rows(spark: SparkSession, path: str, keys: list[str], *, order: str) -> DataFrame:
    stored = spark.read.parquet(path)
    rest = [c for c in stored.columns if c not in (*keys, order)]
    return stored.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def create_table(spark: SparkSession, name: str, schema: str, *, partition_by: tuple[str, ...] = ()) -> None:
    """A Parquet table of that schema, if there is none of that name."""
    parts = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet{parts}")


def write_with_marker(parts: dict[str, DataFrame], path: str) -> str:
    """Write several frames as one: all of them into a new folder, then a marker that :func:`last_written` looks for.

    Readers see all of a write or nothing of it, as the marker comes last. Writes are
    numbered from what is there, so clocks don't matter; of two at once the greater name counts.
    """
    import uuid

    own = uuid.uuid4().hex
    for name, rows in parts.items():
        rows.write.parquet(f"{path}/{own}/{name}")
    spark = next(iter(parts.values())).sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits")
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    number = (spark.read.parquet(f"{path}/_commits").agg(F.max("number")).first()[0] or 0) + 1 if there else 1
    spark.range(1).select(F.lit(own).alias("write"), F.lit(number).cast("long").alias("number")).coalesce(1).write.mode("append").parquet(f"{path}/_commits")
    return own


def last_written(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A frame of the last write that was completed."""
    own = spark.read.parquet(f"{path}/_commits").agg(F.max_by("write", F.struct("number", "write"))).first()[0]
    return spark.read.parquet(f"{path}/{own}/{name}")


def sampled(rows: DataFrame, n: int, *, key: str, seed: int = 0, names: dict[str, str] | None = None) -> DataFrame:
    """At most ``n`` rows by the hash of their key and a seed, with columns renamed: one cycle of a polled source."""
    picked = rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)
    return picked.withColumnsRenamed(names or {})


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table, such as warehouses, users or contracts."""
    return spark.createDataFrame(rows, schema)
