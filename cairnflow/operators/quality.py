"""Quality of retrieval, judges and providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import elements_at, with_before


def retrieval_metrics(queries: DataFrame, retrieved: DataFrame, relevant: DataFrame, k: int, *, id_col: str = "doc_id") -> DataFrame:
    """precision, recall and reciprocal_rank of each query over its distinct documents; 0 where there is nothing.

    ``retrieved`` has (query_id, id, rank from 1), ``relevant`` (query_id, id). Precision
    divides by k, however many came back.
    """
    best = retrieved.groupBy("query_id", id_col).agg(F.min("rank").alias("rank"))
    hits = best.join(relevant.select("query_id", id_col).distinct(), ["query_id", id_col])
    per = hits.groupBy("query_id").agg(F.count_if(F.col("rank") <= k).alias("hits"), F.min("rank").alias("first"))
    wanted = relevant.groupBy("query_id").agg(F.countDistinct(id_col).alias("wanted"))
    return _shares(queries.join(per, "query_id", "left").join(wanted, "query_id", "left"), k)


def _shares(rows: DataFrame, k: int) -> DataFrame:
    rows = rows.fillna(0, ["hits", "wanted"])
    recall = F.when(F.col("wanted") > 0, F.col("hits") / F.col("wanted")).otherwise(0.0)
    return rows.withColumn("precision", F.col("hits") / F.lit(float(k))).withColumn("recall", recall).withColumn("reciprocal_rank", F.coalesce(1.0 / F.col("first"), F.lit(0.0))).drop("hits", "wanted", "first")


def shared_metrics(queries: DataFrame, retrieved: DataFrame, documents: DataFrame, k: int, *, on: str, id_col: str = "doc_id") -> DataFrame:
    """:func:`retrieval_metrics` where the relevant documents of a query are all of the same ``on``; a query has one, and null is like none.

    These are counted by ``on`` and looked up for what came back, so no row is made for each
    pair of a query and a relevant document, whose number grows with the square of a group.
    """
    best = retrieved.groupBy("query_id", id_col).agg(F.min("rank").alias("rank"))
    own = documents.select(id_col, on).filter(F.col(on).isNotNull()).distinct()
    hits = best.join(queries.select("query_id", on).distinct(), "query_id").join(own, [id_col, on], "left_semi")
    per = hits.groupBy("query_id").agg(F.count_if(F.col("rank") <= k).alias("hits"), F.min("rank").alias("first"))
    wanted = own.groupBy(on).agg(F.count("*").alias("wanted"))
    return _shares(queries.join(per, "query_id", "left").join(wanted, on, "left"), k)


def metrics_by(metrics: DataFrame, key: str) -> DataFrame:
    """Means by category and, in the row without one, over all queries: one pass."""
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return metrics.rollup(key).agg(F.count("*").alias("n"), mean("precision"), mean("recall"), mean("reciprocal_rank"))


def hit_details(queries: DataFrame, retrieved: DataFrame, relevant: DataFrame, k: int, *, id_col: str = "doc_id") -> DataFrame:
    """(query_id, hit, hit_rank) of each query: its first relevant document among the first k, null without one; latency_ms passes through."""
    first = retrieved.filter(F.col("rank") <= k).join(relevant.select("query_id", id_col).distinct(), ["query_id", id_col], "left_semi").groupBy("query_id").agg(F.min("rank").alias("hit_rank"))
    more = ["latency_ms"] if "latency_ms" in queries.columns else []
    return queries.join(first, "query_id", "left").select("query_id", F.col("hit_rank").isNotNull().alias("hit"), "hit_rank", *more)


def hit_rate(queries: DataFrame, retrieved: DataFrame, relevant: DataFrame, k: int, *, id_col: str = "doc_id") -> DataFrame:
    """Share of queries with a relevant document among the first k; one that expects none is hit by an empty answer."""
    top = retrieved.filter(F.col("rank") <= k)
    hits = top.join(relevant, ["query_id", id_col], "left_semi").select("query_id").distinct().withColumn("_hit", F.lit(True))
    expects = relevant.select("query_id").distinct().withColumn("_wants", F.lit(True))
    answered = top.select("query_id").distinct().withColumn("_some", F.lit(True))
    rows = queries.join(hits, "query_id", "left").join(expects, "query_id", "left").join(answered, "query_id", "left")
    hit = F.when(F.col("_wants").isNull(), F.col("_some").isNull()).otherwise(F.col("_hit").isNotNull())
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg(hit.cast("int")), 6).alias("hit_rate"))


def average_ranks(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Ranks from 1 of a numeric column, ties sharing their mean rank, from counts of each value."""
    per = with_before(rows.groupBy(column).agg(F.count("*").alias("_c")), column, "_c")
    return rows.join(per.select(column, (F.col("before") + (F.col("_c") + 1) / 2.0).alias(out)), column)


def spearman(rows: DataFrame, x: str, y: str, *, minimum: float = 0.85, least: int = 5) -> DataFrame:
    """One row (n, correlation, calibrated) of two score columns; 0 without variance, null below ``least`` rows."""
    ranked = average_ranks(average_ranks(rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), x, "_rx"), y, "_ry")
    found = F.coalesce(F.nanvl(F.corr("_rx", "_ry"), F.lit(0.0)), F.lit(0.0))
    out = ranked.agg(F.count("*").alias("n"), F.round(found, 6).alias("c"))
    return out.select("n", F.when(F.col("n") >= least, F.col("c")).alias("correlation"), F.coalesce((F.col("n") >= least) & (F.col("c") >= minimum), F.lit(False)).alias("calibrated"))


def judge_bias(verdicts: DataFrame, *, ratio: float = 1.5) -> DataFrame:
    """One row of position, verbosity and self-preference rates.

    ``verdicts`` has (a, b, first, swapped, same_family): two answers, the verdict A, B or
    TIE on them and on their swap, and whether only the first is of the judge's family.
    """
    back = F.when(F.col("swapped") == "A", "B").when(F.col("swapped") == "B", "A").otherwise(F.col("swapped"))
    la, lb = F.length("a"), F.length("b")
    eligible = (la > 0) & (lb > 0) & (F.greatest(la, lb) / F.least(la, lb) >= ratio)
    longer = ((lb > la) & (F.col("first") == "B")) | ((la > lb) & (F.col("first") == "A"))
    decisive = F.col("same_family") & (F.col("first") != "TIE")
    own = F.avg(F.when(decisive, (F.col("first") == "A").cast("double")))
    rate = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return verdicts.agg(
        F.count("*").alias("comparisons"),
        rate(F.avg((F.col("first") != back).cast("double"))).alias("position_bias"),
        rate(F.avg(F.when(eligible, longer.cast("double")))).alias("verbosity_bias"),
        rate(F.greatest((own - 0.5) / 0.5, F.lit(0.0))).alias("self_preference"),
    )


def bias_report(bias: DataFrame, calibration: DataFrame, *, position: float = 0.1, verbosity: float = 0.15, own: float = 0.1) -> DataFrame:
    """Rates beside the calibration, ``trusted`` when all four keep their limits."""
    ok = (F.col("position_bias") <= position) & (F.col("verbosity_bias") <= verbosity) & (F.col("self_preference") <= own) & F.col("calibrated")
    return bias.join(calibration.select("correlation", "calibrated")).withColumn("trusted", ok)


def passes_gate(*scores: Column, threshold: float = 0.8) -> Column:
    """All scores are strictly over the threshold."""
    out = F.lit(True)
    for s in scores:
        out = out & (s > threshold)
    return out


#: Counts of a Poisson distribution of mean 1: a draw from 0 to DRAWS - 1 counts once for each of these that it reaches.
DRAWS = 2147483647
POISSON_STEPS = tuple(int(p * DRAWS) for p in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119))


def bootstrap_ci(scores: DataFrame, *, key: str = "doc_id", column: str = "score", resamples: int = 1000, level: float = 0.95, seed: int = 7) -> DataFrame:
    """One row (n, mean, lower, upper): a Poisson bootstrap, in which a score counts k times in a resample with P(k) of mean 1.

    Each row draws its counts from its integer ``key`` and the resample's number, by rounds
    of squaring modulo a prime. A task adds up all resamples of its rows in arrays, so a row
    for each task and resample is shuffled, whatever the number of scores. Resamples that
    draw nobody are left out; bounds are the means at the shares of the others. Null scores
    don't count. Under 3 scores are an error.
    """
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    rows = scores.select(F.pmod(F.col(key).cast("long"), F.lit(DRAWS)).alias("key"), F.col(column).cast("double").alias("s")).filter("s IS NOT NULL AND key IS NOT NULL")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(resamples, dtype=np.int64)[None, :]
        total, weight = np.zeros(resamples), np.zeros(resamples, np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                own, s = (batch.column(i).slice(low, 1024).to_numpy() for i in range(2))
                x = (own[:, None] * 48271 + number * 16807 + seed) % DRAWS
                for _ in range(3):
                    x = (x * x + own[:, None] + number) % DRAWS
                k = sum((x >= step).astype(np.int64) for step in POISSON_STEPS)
                total += s @ k
                weight += k.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(number[0]), pa.array(total), pa.array(weight)], names=["r", "t", "w"])

    means = rows.mapInArrow(draw, "r long, t double, w long").groupBy("r").agg(F.try_divide(F.sum("t"), F.sum("w")).alias("m"))
    ordered = means.agg(F.array_sort(F.collect_list("m")).alias("m"))  # a number for each resample
    size = F.size("m")
    low, high = (F.floor(size * F.lit(x)).cast("int") for x in ((1 - level) / 2, (1 + level) / 2))
    bounds = ordered.select(F.get("m", low).alias("lower"), F.get("m", F.least(size - 1, high)).alias("upper"))
    facts = rows.agg(F.count("*").alias("n"), F.avg("s").alias("mean"))
    few = F.raise_error(F.concat(F.lit("a bootstrap needs 3 scores, not "), F.col("n").cast("string"))).cast("long")
    return facts.crossJoin(bounds).select(F.when(F.col("n") < 3, few).otherwise(F.col("n")).alias("n"), "mean", "lower", "upper")  # one row each


#: Parts that the draws of an exact bootstrap are split over by the driver, and rows that a task draws for at once.
DRAW_PARTS, DRAW_ROWS = 1024, 256


def bootstrap_draws(scores: DataFrame, *, key: str = "doc_id", column: str = "score", resamples: int = 1000, seed: int = 7) -> DataFrame:
    """(r, total, draws): for each resample of n draws with replacement the sum of what it draws and n.

    The draws of a resample are split over parts of the rows by a multinomial, part by part
    as binomials of what is left; a task goes on in the same way over pieces of its rows, so
    nobody holds a part whole. Parts go by the hash of ``key`` and rows by key and score, so
    the draws don't depend on the partitioning. Null scores don't count.
    """
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    rows = scores.select(F.col(key).cast("string").alias("k"), F.col(column).cast("double").alias("s")).filter("s IS NOT NULL")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(DRAW_PARTS)).cast("int"))
    sizes = {r.part: r["count"] for r in rows.groupBy("part").count().collect()}  # a number for each of DRAW_PARTS
    left, total, rng = np.full(resamples, sum(sizes.values())), sum(sizes.values()), np.random.default_rng(seed)
    given = {}
    for part in sorted(sizes):
        given[part] = rng.binomial(left, sizes[part] / total)
        left, total = left - given[part], total - sizes[part]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(resamples), np.zeros(resamples, np.int64)
        own, open_draws, open_rows, piece = None, None, 0, []

        def finish() -> None:
            nonlocal open_draws, open_rows, sums, counts
            if piece:
                s, rng = np.array(piece), np.random.default_rng([seed, own, open_rows])
                drawn = rng.binomial(open_draws, len(s) / open_rows)
                hits = rng.multinomial(drawn, np.full(len(s), 1 / len(s)))
                sums += hits @ s
                counts += hits.sum(axis=1)
                open_draws, open_rows = open_draws - drawn, open_rows - len(s)
                piece.clear()

        for batch in batches:
            for part, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != own:
                    finish()
                    own, open_draws, open_rows = part, given[part], sizes[part]
                piece.append(s)
                if len(piece) == DRAW_ROWS:
                    finish()
        finish()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(sums), pa.array(counts)], names=["r", "t", "w"])

    dealt = rows.repartition("part").sortWithinPartitions("part", "k", "s").select("part", "s")
    return dealt.mapInArrow(draw, "r long, t double, w long").groupBy("r").agg(F.sum("t").alias("total"), F.sum("w").alias("draws"))


def bootstrap_interval(scores: DataFrame, *, column: str = "score", level: float = 0.95, resamples: int = 1000, **how) -> DataFrame:
    """One row (n, mean, lower, upper, least_draws, most_draws) of an exact bootstrap: bounds are the resamples' means at int(share * resamples). Under 3 scores are an error."""
    drawn = bootstrap_draws(scores, column=column, resamples=resamples, **how)
    means = drawn.agg(F.array_sort(F.collect_list(F.col("total") / F.col("draws"))).alias("m"), F.min("draws").alias("least_draws"), F.max("draws").alias("most_draws"))  # a number for each resample
    low, high = max(0, int((1 - level) / 2 * resamples)), min(resamples - 1, int((1 - (1 - level) / 2) * resamples))
    facts = scores.agg(F.count(column).alias("n"), F.avg(F.col(column).cast("double")).alias("mean"))
    few = F.raise_error(F.concat(F.lit("a bootstrap needs 3 scores, not "), F.col("n").cast("string"))).cast("long")
    return facts.crossJoin(means).select(F.when(F.col("n") < 3, few).otherwise(F.col("n")).alias("n"), "mean", F.get("m", F.lit(low)).alias("lower"), F.get("m", F.lit(high)).alias("upper"), "least_draws", "most_draws")  # one row each


def provider_benchmark(results: DataFrame) -> DataFrame:
    """Accuracy over all rows, p50 (the median), p95 (the element at int(0.95 n)), mean latency, tokens a second and mean cost of successes of each provider.

    A result without ``correct`` counts as wrong. The two quantiles come from counts of the latencies.
    """
    places = {"_a": "(n - 1) div 2", "_b": "n div 2", "p95_ms": "CAST(floor(n * 0.95D) AS BIGINT)"}
    found = elements_at(results, "latency_ms", "provider", places)
    seconds = F.sum("latency_ms") / 1000
    cost = F.avg(F.when(F.col("success"), F.col("cost"))) if {"success", "cost"} <= set(results.columns) else F.lit(None).cast("double")
    per = results.groupBy("provider").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.coalesce(F.col("correct"), F.lit(False)).cast("double")), 6).alias("accuracy"),
        F.round(F.avg("latency_ms"), 4).alias("mean_ms"),
        F.round(F.when(seconds > 0, F.sum("completion_tokens") / seconds).otherwise(0.0), 4).alias("tokens_per_s"),
        F.round(cost, 6).alias("success_cost"),
    )
    out = per.join(found, "provider", "left").withColumn("p50_ms", F.round((F.col("_a") + F.col("_b")) / 2, 4))
    return out.select("provider", "n", "accuracy", "p50_ms", "p95_ms", "mean_ms", "tokens_per_s", "success_cost")


def category_accuracy(results: DataFrame) -> DataFrame:
    """(provider, category, n, accuracy) of a benchmark; unanswered numbers (null) are left out of both."""
    return results.filter(F.col("correct").isNotNull()).groupBy("provider", "category").agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"))


def category_matrix(results: DataFrame, models: list[str], *, base: str) -> DataFrame:
    """A row for each category and, without one, for all: a model's mean score, its difference from the base model's, and its mean latency."""
    mean = lambda m, c: F.avg(F.when(F.col("model") == m, F.col(c)))
    columns = [F.round(mean(m, "score"), 6).alias(m) for m in models]
    columns += [F.round(mean(m, "score") - mean(base, "score"), 6).alias(f"{m}_delta") for m in models if m != base]
    columns += [F.round(mean(m, "latency_ms"), 4).alias(f"{m}_ms") for m in models]
    return results.rollup("category").agg(F.count("*").alias("n"), *columns)


def outage_phases(responses: DataFrame) -> DataFrame:
    """Responses of each phase of an outage: how many, how many degraded, and whether all are."""
    return responses.groupBy("phase").agg(F.count("*").alias("n"), F.count_if("degraded").alias("degraded"), F.bool_and("degraded").alias("all_degraded"))


def tier_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("tier").agg(F.count("*").alias("n"))


def eval_means(pairs: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """One row: mean heuristic scores of (question, context, answer) and whether all pass the gate."""
    from ..functions import text as X

    q, c, a = (F.col(x) for x in ("question", "context", "answer"))
    scored = pairs.select(X.context_precision(q, c, a).alias("precision"), X.faithfulness(q, c, a).alias("faithfulness"), X.answer_relevancy(q, a).alias("relevancy"))
    means = scored.agg(F.count("*").alias("n"), *(F.round(F.avg(x), 6).alias(x) for x in ("precision", "faithfulness", "relevancy")))
    return means.withColumn("passes", passes_gate(*(F.col(x) for x in ("precision", "faithfulness", "relevancy")), threshold=threshold))


def paired_comparison(metrics: DataFrame, *, arm: str = "arm", base: str = "base", treated: str = "treated") -> DataFrame:
    """Mean metric of two arms by category, their difference and percentage (0 when the base is 0)."""
    mean = lambda a: F.avg(F.when(F.col(arm) == a, F.col("value")))
    out = metrics.groupBy("category").agg(mean(base).alias("base"), mean(treated).alias("treated"))
    return out.withColumn("delta", F.col("treated") - F.col("base")).withColumn("percent", F.when(F.col("base") > 0, F.col("delta") / F.col("base") * 100).otherwise(0.0))


def chunk_stats(chunks: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Number of chunks, mean a document, and mean, least, greatest and deviation of their sizes."""
    size = F.length("content")
    return chunks.agg(F.count("*").alias("chunks"), (F.count("*") / F.countDistinct(id_col)).alias("per_doc"), F.avg(size).alias("mean_size"), F.min(size).alias("min_size"), F.max(size).alias("max_size"), F.stddev_samp(size).alias("sd_size"))


#: Bytes of clauses that a task searches for at once.
CLAUSE_BYTES = 16 << 20


def texts_with(clauses: DataFrame, texts: DataFrame, column: str) -> DataFrame:
    """Different clauses (text) that lie in any of the texts, as plain substrings.

    Every text is scanned once for each block of clauses, all of them together, so nothing
    is paired; a block holds ``CLAUSE_BYTES`` or so, and one usually holds all.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    wanted = clauses.select("text").filter("text <> ''").distinct()
    total = wanted.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // CLAUSE_BYTES))

    def scan(own: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            search, seen = ahocorasick.Automaton(), set()
            for clause in own:
                search.add_word(clause, clause)
            search.make_automaton()
            for batch in batches:
                new = {c for x in batch.column(0) if x.is_valid for _, c in search.iter(x.as_py())} - seen
                seen |= new
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.string())], names=["text"])

        return run

    out = None
    for block in range(blocks):
        own = [r.text for r in wanted.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()]
        found = texts.select(column).mapInArrow(scan(own), "text string") if own else wanted.filter("false")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def clause_integrity(clauses: DataFrame, chunks: DataFrame, corpus: DataFrame) -> DataFrame:
    """Clauses (item_id, text) that lie in a text of the corpus, with ``whole``: some chunk (content) holds all of one."""
    there = texts_with(clauses, corpus, "text")
    whole = texts_with(clauses, chunks, "content").withColumn("_whole", F.lit(True))
    return clauses.join(there, "text", "left_semi").join(whole, "text", "left").select("item_id", F.coalesce("_whole", F.lit(False)).alias("whole"))


def integrity_rate(found: DataFrame) -> DataFrame:
    """One row of :func:`clause_integrity`: clauses, whole ones and their share (0 without any)."""
    return found.agg(F.count("*").alias("total"), F.count_if("whole").alias("intact"), F.round(F.coalesce(F.avg(F.col("whole").cast("double")), F.lit(0.0)), 6).alias("rate"))
