"""Audit log analytics: period reports, fairness checks, hash chains, lineage and the personal-data vault."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ranges_of

FULL_ACCESS = ("admin", "compliance_officer")
#: Entries of a chain that a task sorts and walks at once.
WALKED = 400_000


def may_report(role: str) -> None:
    """Raises unless the role may see compliance reports."""
    if role not in FULL_ACCESS:
        raise PermissionError(f"role {role!r} may not see compliance reports")


def visible_entries(entries: DataFrame, *, viewer: str, role: str, department: str | None = None) -> DataFrame:
    """Entries that a viewer may see: their own; all with a full-access role; a manager's department's."""
    if role in FULL_ACCESS:
        return entries
    own = F.col("user_id") == viewer
    return entries.filter(own | (F.col("department") == department) if role == "manager" and department else own)


def period_stats(entries: DataFrame) -> DataFrame:
    """One row: entries, degraded ones, distinct models and users, in one scan."""
    return entries.agg(
        F.count("*").alias("total_entries"),
        F.count_if("is_degraded").alias("degraded_count"),
        F.countDistinct("model_version").alias("distinct_models"),
        F.countDistinct("user_id").alias("distinct_users"),
    )


def entries_by_level(entries: DataFrame) -> DataFrame:
    return entries.groupBy("log_level").agg(F.count("*").alias("n"))


def iso_utc(ts: Column) -> Column:
    """ISO-8601 with offset; microseconds only where there are any."""
    whole = F.unix_micros(ts) % 1_000_000 == 0
    return F.when(whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))


def prefixed_sha256(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def compliance_report(entries: DataFrame, start: Column, end: Column, *, chains: DataFrame | None = None) -> DataFrame:
    """The report of a period: counts, models, users, approvals, cost, degraded entries and a completeness hash.

    Entries are first added up by level, model and user, which bounds what the last
    step sees by their number. With ``chains``, the result of :func:`verify_chains`, it
    also tells whether all of them are whole.
    """
    zero = F.lit(0).cast("decimal(18,6)")
    cost = F.col("total_cost_eur").cast("decimal(18,6)") if "total_cost_eur" in entries.columns else zero
    per = entries.filter(F.col("created_at").between(start, end)).groupBy("log_level", "model_version", "user_id").agg(F.count("*").alias("n"), F.count("hitl_approver_id").alias("approved"), F.count_if("is_degraded").alias("degraded"), F.sum(cost).alias("cost"))
    add = lambda c: F.coalesce(F.sum(c), F.lit(0))
    stamp = prefixed_sha256(F.concat_ws(":", add("n").cast("string"), iso_utc(start), iso_utc(end)))
    out = per.agg(
        add("n").alias("total_entries"),
        F.array_sort(F.collect_set("model_version")).alias("models_used"),
        F.countDistinct("user_id").alias("unique_users"),
        add("approved").alias("hitl_approvals"),
        F.coalesce(F.sum("cost"), zero).alias("total_cost"),
        add("degraded").alias("degraded_count"),
        *(add(F.when(F.col("log_level") == level, F.col("n"))).alias(level) for level in ("full_trace", "summary", "metadata_only")),
        stamp.alias("entry_count_hash"),
    )
    return out if chains is None else out.crossJoin(chains.agg(F.coalesce(F.bool_and("valid"), F.lit(True)).alias("chain_valid")))  # one row each


def proportion_bias(counts: DataFrame, *, min_entries: int = 30, times: float = 2.0) -> DataFrame:
    """Flags groups (group, n) whose share is over ``times`` an even one; below ``min_entries`` in all the data are insufficient.

    ``max_possible`` tells whether the flag can fire at all with that many groups.
    """
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("groups"))
    rows = counts.join(sums).withColumn("share", F.col("n") / F.col("total")).withColumn("limit", F.lit(times) / F.col("groups"))
    enough = F.col("total") >= min_entries
    return rows.select(
        "group",
        "n",
        F.round("share", 6).alias("share"),
        F.when(enough, F.when(F.col("share") > F.col("limit"), "biased").otherwise("clean")).otherwise("insufficient").alias("result"),
        (F.col("limit") < 1).alias("max_possible"),
    )


def group_counts(entries: DataFrame, key: str) -> DataFrame:
    """(group, n) by a column, null as unknown."""
    return entries.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias("group")).agg(F.count("*").alias("n"))


def fairness_report(entries: DataFrame) -> DataFrame:
    """Proportion bias of departments, of models, and of departments among degraded entries."""
    checks = {
        "routing": group_counts(entries, "department"),
        "model_preference": group_counts(entries, "model_version"),
        "degraded": group_counts(entries.filter("is_degraded"), "department"),
    }
    parts = [proportion_bias(c).withColumn("check", F.lit(name)) for name, c in checks.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _link(previous: Column) -> Column:
    content = F.concat_ws("||", F.coalesce(previous, F.lit("")), iso_utc(F.col("created_at")), F.col("user_id"), F.col("query_hash"), F.col("response_hash"), F.col("model_version"))
    return prefixed_sha256(content)


def hashed_entries(entries: DataFrame) -> DataFrame:
    """Entries with the hashes of their texts."""
    return entries.withColumn("query_hash", F.sha2("query_text", 256)).withColumn("response_hash", F.sha2("response_text", 256))


def build_chains(entries: DataFrame, *, chain: str = "chain_id", walked: int = WALKED) -> DataFrame:
    """Adds prev_entry_hash and entry_hash: each entry's hash covers the one before it in its chain.

    A chain is sequential by nature; different chains run in parallel. Entries of a chain are
    sorted by time and id in Spark, and a task walks its rows in order with one hash in hand.
    Chains of over ``walked`` entries are cut into ranges of about so many, which are written
    and then walked one after another: a range hands on its last hash, so what a task sorts
    doesn't grow with its chain.
    """
    from ..session import scratch

    content = F.concat_ws("||", iso_utc(F.col("created_at")), F.col("user_id"), F.col("query_hash"), F.col("response_hash"), F.col("model_version"))
    rows = hashed_entries(entries).withColumn("_content", content)
    longest = entries.groupBy(chain).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    if longest <= walked:
        return _walked(rows, chain, {}).drop("_n")
    spark = rows.sparkSession
    time = F.coalesce(F.unix_micros("created_at"), F.lit(-(1 << 63)))
    cut, out = scratch(spark, "chain-ranges"), scratch(spark, "chain-built")
    part = ranges_of(entries, chain, [time, F.col("id")], -(-longest // walked))
    rows.withColumn("_range", part).repartition("_range", chain).write.partitionBy("_range").parquet(cut)
    cut_rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, _range int").parquet(cut)
    numbers = sorted(r[0] for r in cut_rows.select("_range").distinct().collect())
    long_keys = [r[0] for r in cut_rows.filter("_range > 0").select(chain).distinct().collect()]  # as few as there are large chains
    handed: dict = {}
    for number in numbers:
        _walked(cut_rows.filter(F.col("_range") == number).drop("_range"), chain, handed).write.parquet(f"{out}/step={number}")
        own = spark.read.parquet(f"{out}/step={number}")
        own = own.filter(F.coalesce(F.col(chain).isin([k for k in long_keys if k is not None]), F.lit(None in long_keys)))
        handed |= {r[0]: r.h for r in own.groupBy(chain).agg(F.max_by("entry_hash", "_n").alias("h")).collect()}
    return spark.read.schema(_walked(rows, chain, {}).schema).parquet(*(f"{out}/step={number}" for number in numbers)).drop("_n")


def _walked(rows: DataFrame, chain: str, handed: dict) -> DataFrame:
    """Rows with their hashes and their number ``_n`` in the task, each chain from its hash in ``handed`` on."""
    import hashlib

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_content") + ", prev_entry_hash string, entry_hash string, _n long"

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, last, n, begun = None, None, 0, False
        for frame in frames:
            before, after = [], []
            for key, text in zip(frame[chain], frame["_content"], strict=True):
                key = None if key != key else key
                if key != own or not begun:
                    own, last, begun = key, handed.get(key), True
                before.append(last)
                last = "sha256:" + hashlib.sha256(f"{last or ''}||{text}".encode()).hexdigest()
                after.append(last)
            yield frame.drop(columns="_content").assign(prev_entry_hash=before, entry_hash=after, _n=range(n, n + len(frame)))
            n += len(frame)

    return rows.repartition(chain).sortWithinPartitions(chain, "created_at", "id").mapInPandas(walk, schema)


def verify_chains(entries: DataFrame, *, chain: str = "chain_id", ranges: int | None = None) -> DataFrame:
    """(chain, valid, broken_at, n): the first position whose link or hash is wrong, null in a whole chain.

    Each row is judged by its stored predecessor alone; up to the first break that is the
    same as walking. A long chain is cut into ranges of time, each judged by a task of its
    own: what a range hands on is its size and its last row's hash, one row a range, from
    which its neighbour's first row gets a position and a predecessor.
    """
    time, number = F.coalesce(F.unix_micros("created_at"), F.lit(-(1 << 63))), F.col("id")
    rows = entries.withColumn("_range", ranges_of(entries, chain, [time, number], ranges))
    inside = Window.partitionBy(chain, "_range").orderBy("created_at", "id")
    rows = rows.withColumn("_at", F.row_number().over(inside) - 1).withColumn("_prev", F.lag("entry_hash").over(inside))
    ends = rows.groupBy(chain, "_range").agg(F.count("*").alias("_n"), F.max_by("entry_hash", F.struct("created_at", "id")).alias("_last"))
    before = Window.partitionBy(chain).orderBy("_range")
    handed = ends.select(F.col(chain).alias("_chain"), F.col("_range").alias("_own"), F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.lag("_last").over(before).alias("_handed"))
    met = rows.join(handed, F.col(chain).eqNullSafe(F.col("_chain")) & (F.col("_range") == F.col("_own")), "left")
    met = met.withColumn("_prev", F.when(F.col("_at") == 0, F.col("_handed")).otherwise(F.col("_prev"))).withColumn("_at", F.col("_at") + F.col("_base"))
    good = F.col("prev_entry_hash").eqNullSafe(F.col("_prev")) & F.col("entry_hash").eqNullSafe(_link(F.col("_prev")))
    per = met.groupBy(chain).agg(F.min(F.when(~good, F.col("_at"))).alias("broken_at"), F.count("*").alias("n"))
    return per.select(chain, F.col("broken_at").isNull().alias("valid"), "broken_at", "n")


def last_entries(entries: DataFrame, *, chain: str = "chain_id") -> DataFrame:
    return entries.groupBy(chain).agg(F.max_by("entry_hash", F.struct("created_at", "id")).alias("entry_hash"))


def document_versions(docs: DataFrame) -> DataFrame:
    """Versions by repeated content: (document_id, version, source_hash, doc_id); a document is a distinct text."""
    keyed = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("source_hash"))
    order = Window.partitionBy("source_hash").orderBy("doc_id")
    first = F.min("doc_id").over(Window.partitionBy("source_hash"))
    return keyed.withColumn("document_id", first).withColumn("version", F.row_number().over(order)).select("document_id", "version", "source_hash", "doc_id")


def lineage(versions: DataFrame, chunks: DataFrame, *, document_id: int | str | None = None) -> DataFrame:
    """Chunk versions beside their document versions by version_id, of one document if given, in the order of version and chunk."""
    own = versions if document_id is None else versions.filter(F.col("document_id") == document_id)
    joined = own.join(chunks, "version_id")
    return joined if document_id is None else joined.orderBy("version", "chunk_index")


def full_lineage(versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, versions, chunks): all versions of a document and all its chunks, each list in order.

    A list holds the versions and chunks of one document, not of the corpus.
    """
    own = versions.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("version", "version_id", "source_hash"))).alias("versions"))
    per = lineage(versions, chunks).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("version", "chunk_index", "content_hash"))).alias("chunks"))
    return own.join(per, "document_id", "left").select("document_id", "versions", F.coalesce("chunks", F.array().cast(per.schema["chunks"].dataType)).alias("chunks"))


def verified_sources(claims: DataFrame, versions: DataFrame) -> DataFrame:
    """Claims (document_id, version, expected_hash) with ``verified``; an unknown version is not."""
    joined = claims.join(versions.select("document_id", "version", "source_hash"), ["document_id", "version"], "left")
    return joined.select("document_id", "version", F.coalesce(F.col("source_hash") == F.col("expected_hash"), F.lit(False)).alias("verified"))


def snapshot_mismatches(entries: DataFrame, traces: DataFrame, *, fields: tuple[str, ...]) -> DataFrame:
    """(trace_id, verified, mismatches): fields of an audit entry that differ from its trace, null with null equal."""
    right = traces.select("trace_id", *(F.col(f).alias(f"_{f}") for f in fields))
    wrong = F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), f) for f in fields)))
    return entries.join(right, "trace_id").select("trace_id", (F.size(wrong) == 0).alias("verified"), wrong.alias("mismatches"))


def retention_date(day: Column, years: int = 10) -> Column:
    """The same day some years on; 29 February falls on the 28th where there is none."""
    return F.add_months(day, 12 * years)


def vault_store(rows: DataFrame, key: Column, *, key_id: str, years: int = 10) -> DataFrame:
    """Vault rows (audit_entry_id, encrypted, key_id, retention_until, created_at, deleted_at), texts under AES-GCM."""
    sealed = F.aes_encrypt(F.col("query_text").cast("binary"), key, F.lit("GCM"))
    return rows.select("audit_entry_id", sealed.alias("query_text_encrypted"), F.lit(key_id).alias("encryption_key_id"), retention_date(F.col("created_at"), years).alias("retention_until"), "created_at", F.lit(None).cast("timestamp").alias("deleted_at"))


def vault_read(vault: DataFrame, key: Column) -> DataFrame:
    """Texts of entries that are not deleted."""
    return vault.filter("deleted_at IS NULL").select("audit_entry_id", F.aes_decrypt("query_text_encrypted", key, F.lit("GCM")).cast("string").alias("query_text"))


def vault_delete(vault: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """The vault with ``deleted_at`` set, once, for the ids (audit_entry_id)."""
    gone = ids.select("audit_entry_id").distinct().withColumn("_gone", F.lit(True))
    return vault.join(gone, "audit_entry_id", "left").withColumn("deleted_at", F.coalesce("deleted_at", F.when(F.col("_gone"), now))).drop("_gone")


def output_hash(payload: Column) -> Column:
    """A hash of the ``output`` of a trace's JSON, written with sorted keys, so that their order doesn't matter; null counts as null."""
    import hashlib
    import json

    @F.pandas_udf("string")
    def hashed(texts: pd.Series) -> pd.Series:
        own = (json.dumps(json.loads(t or "{}").get("output"), sort_keys=True, default=str) for t in texts)
        return pd.Series(["sha256:" + hashlib.sha256(x.encode()).hexdigest() for x in own], dtype=object)

    return hashed(payload)


def snapshots(traces: DataFrame, *, payload: str = "payload") -> DataFrame:
    """Audit fields of traces given as JSON: tokens and cost (0 where missing), model (null) and a hash of the output."""
    text = F.col(payload)
    number = lambda path, kind: F.coalesce(F.get_json_object(text, path).try_cast(kind), F.lit(0).cast(kind))
    return traces.select(
        "trace_id",
        number("$.usage.prompt_tokens", "long").alias("prompt_tokens"),
        number("$.usage.completion_tokens", "long").alias("completion_tokens"),
        number("$.cost", "decimal(18,6)").alias("total_cost_eur"),
        F.get_json_object(text, "$.model").alias("model_version"),
        output_hash(text).alias("response_hash"),
    )


def metadata_field(metadata: Column, name: str) -> Column:
    """A field of metadata kept as JSON text."""
    return F.get_json_object(metadata, f"$.{name}")


def legal_findings(found: DataFrame, *, contract_id: str, parent_clearance: int | None = None) -> DataFrame:
    """What a search under a raised clearance found for a contract, cut back to the asker's own; a missing level counts as 1."""
    from .retrieval import cleared

    level = F.when(F.coalesce("clearance_level", F.lit(0)) == 0, 1).otherwise(F.col("clearance_level"))
    own = found.withColumn("clearance_level", level).withColumn("contract_id", F.lit(contract_id))
    return own if parent_clearance is None else cleared(own, parent_clearance)


def entry(entries: DataFrame, entry_id: int | str, *, key: str = "id") -> DataFrame:
    """The row of a key, none if there is no such."""
    return entries.filter(F.col(key) == entry_id).limit(1)
