"""Counts, coverage, evaluation metrics and latency diagnostics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fragmentation(files: int, rows: int, bytes_: int, target_bytes: int) -> float:
    """Share of files beyond what the bytes need at a target size: the columnar store's analogue of free blocks."""
    need = max(1, -(-bytes_ // target_bytes))
    return max(0.0, files / need - 1) if rows else 0.0


def row_waste(groups: DataFrame) -> DataFrame:
    """table, wasted rows and free ratio from (table, row_group, column, count, capacity): the largest column of each row group, summed."""
    per = groups.groupBy("table", "row_group").agg(F.max("count").alias("used"), F.max("capacity").alias("capacity"))
    total = per.groupBy("table").agg(F.sum("used").alias("used"), F.sum("capacity").alias("capacity"))
    return total.select("table", (F.col("capacity") - F.col("used")).alias("wasted"), F.when(F.col("capacity") > 0, 1 - F.col("used") / F.col("capacity")).otherwise(0.0).alias("free_ratio"))


def query_metrics(ranked: DataFrame, relevant: DataFrame, ks: list[int]) -> DataFrame:
    """query_id, first_relevant_rank and for each k recall, precision and hits.

    ``ranked``: query_id, rank (from 1), path; ``relevant``: query_id, path.
    Precision divides by the results there are, k at most; paths count once.
    """
    hit = ranked.join(relevant.withColumn("hit", F.lit(1)), ["query_id", "path"], "left")
    wanted = relevant.groupBy("query_id").agg(F.countDistinct("path").alias("n"))
    parts = [F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first_relevant_rank"), F.max("rank").alias("results")]
    for k in ks:
        parts.append(F.countDistinct(F.when((F.col("rank") <= k) & (F.col("hit") == 1), F.col("path"))).alias(f"hits_{k}"))
    got = wanted.join(hit.groupBy("query_id").agg(*parts), "query_id", "left")
    out = got
    for k in ks:
        hits = F.coalesce(f"hits_{k}", F.lit(0))
        out = out.withColumn(f"recall_{k}", hits / F.col("n")).withColumn(f"precision_{k}", F.when(F.col("results") > 0, hits / F.least(F.lit(k), F.col("results"))).otherwise(0.0)).withColumn(f"hits_{k}", hits)
    return out.drop("n", "results")


def aggregate_metrics(per_query: DataFrame, ks: list[int]) -> DataFrame:
    """One row: means of recall, precision, hit rate and nDCG for each k, and of reciprocal ranks over queries with a hit (mrr_hits) and all (mrr)."""
    rank = F.col("first_relevant_rank")
    out = [F.coalesce(F.avg(1 / rank), F.lit(0.0)).alias("mrr_hits"), F.avg(F.coalesce(1 / rank, F.lit(0.0))).alias("mrr")]
    for k in ks:
        gain = F.when(rank <= k, 1 / F.log2(rank + 1)).otherwise(0.0)
        out += [F.avg(f"recall_{k}").alias(f"recall_{k}"), F.avg(f"precision_{k}").alias(f"precision_{k}"), F.avg((F.col(f"hits_{k}") > 0).cast("double")).alias(f"hit_rate_{k}"), F.avg(gain).alias(f"ndcg_{k}")]
    return per_query.agg(*out)


def latency_stats(rows: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """mean, p50, p95 (the element at int(0.95 * (n - 1)) of the sorted values) and max.

    The element is found by rank within the group, not in a collected array.
    """
    own = Window.partitionBy(*by)
    ranked = rows.withColumns({"_i": F.row_number().over(own.orderBy(column)) - 1, "_n": F.count("*").over(own)})
    at = F.floor((F.col("_n") - 1) * 0.95)
    return ranked.groupBy(*by).agg(F.avg(column).alias("mean"), F.percentile(column, 0.5).alias("p50"), F.max(F.when(F.col("_i") == at, F.col(column))).alias("p95"), F.max(column).alias("max"))


def cluster_quality(points: DataFrame) -> DataFrame:
    """ARI, NMI, homogeneity, completeness, V and mean purity of (truth, predicted), from their contingency table."""
    cells = points.groupBy("truth", "predicted").agg(F.count("*").cast("double").alias("n"))
    # the table of cells is small: classes times clusters that occur
    a, b, all_ = Window.partitionBy("truth"), Window.partitionBy("predicted"), Window.partitionBy()
    cells = cells.withColumns({"a": F.sum("n").over(a), "b": F.sum("n").over(b), "t": F.sum("n").over(all_), "best": F.max("n").over(b), "cells_a": F.count("*").over(a), "cells_b": F.count("*").over(b)})
    pairs = lambda c: c * (c - 1) / 2
    s = cells.agg(
        F.max("t").alias("t"), F.sum(pairs(F.col("n"))).alias("nij"), F.sum(pairs(F.col("a")) / F.col("cells_a")).alias("ai"), F.sum(pairs(F.col("b")) / F.col("cells_b")).alias("bj"),
        F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"),
        F.sum(-(F.col("a") / F.col("t") * F.log(F.col("a") / F.col("t"))) / F.col("cells_a")).alias("ht"), F.sum(-(F.col("b") / F.col("t") * F.log(F.col("b") / F.col("t"))) / F.col("cells_b")).alias("hp"),
        (F.sum(F.col("best") / F.col("b") / F.col("cells_b")) / F.countDistinct("predicted")).alias("mean_purity"),
    )
    expected = F.col("ai") * F.col("bj") / pairs(F.col("t"))
    top = (F.col("ai") + F.col("bj")) / 2
    h = F.when(F.col("ht") > 1e-12, F.col("mi") / F.col("ht")).otherwise(1.0)
    c = F.when(F.col("hp") > 1e-12, F.col("mi") / F.col("hp")).otherwise(1.0)
    mean = (F.col("ht") + F.col("hp")) / 2
    return s.select(
        F.when(F.abs(top - expected) > 1e-12, (F.col("nij") - expected) / (top - expected)).otherwise(1.0).alias("ari"), F.when(mean > 1e-12, F.col("mi") / mean).otherwise(1.0).alias("nmi"),
        h.alias("homogeneity"), c.alias("completeness"), F.when(h + c > 1e-12, 2 * h * c / (h + c)).otherwise(0.0).alias("v_measure"), "mean_purity",
    )


def regression(rows: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """n, mean, std, slope, intercept, r_squared and stderr of y over x."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r_squared"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"))
    return out.withColumn("stderr", F.when(F.col("n") > 2, F.sqrt(F.greatest(F.lit(0.0), (1 - F.col("r_squared")) * F.col("syy") / (F.col("n") - 2) / F.col("sxx"))))).drop("sxx", "syy")


def t_test_p(slope: float, stderr: float, n: int) -> float:
    """Two-sided p of slope / stderr with n - 2 degrees of freedom, by the incomplete beta function's continued fraction."""
    df = n - 2
    if df <= 0 or stderr == 0:
        return 0.0 if stderr == 0 and df > 0 else float("nan")
    t = slope / stderr
    return _beta(df / (df + t * t), df / 2, 0.5)


def _beta(x: float, a: float, b: float) -> float:
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    # Lentz's method
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d)
            c = 1 + k / c
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f / a


def diagnose(batches: DataFrame, *, least: int = 5) -> dict:
    """Latency diagnostics of (batch_index, latency_ms, chunk_count): summary, regression, and whether it degrades."""
    row = regression(batches, "batch_index", "latency_ms").first()
    if row is None or row["n"] < least:
        return {"total_batches": 0 if row is None else row["n"], "regression": None, "degradation_detected": False}
    p = t_test_p(row["slope"], row["stderr"], row["n"])
    return {"total_batches": row["n"], "mean": row["mean"], "std": row["std"], "regression": {k: row[k] for k in ("slope", "intercept", "r_squared", "stderr")} | {"p_value": p}, "degradation_detected": row["slope"] > 0.05 and row["r_squared"] > 0.8 and p < 0.05}


def outliers(rows: DataFrame, column: str, by: list[str], sigma: float = 2.0) -> DataFrame:
    """Rows over ``sigma`` standard deviations from their group's mean, with z_score and reason."""
    stats = rows.groupBy(*by).agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    z = (F.col(column) - F.col("_m")) / F.col("_s")
    found = rows.join(stats, by).where("_s > 0").withColumn("z_score", z).where(F.abs("z_score") > sigma)
    return found.withColumn("reason", F.when(F.col("z_score") > 0, "high latency").otherwise("unusually fast")).drop("_m", "_s")


def synthesis_input_tokens(chunks: Column) -> Column:
    """Input budget by estimated lines (20 a chunk)."""
    loc = chunks * 20
    return F.when(loc < 10_000, 30_000).when(loc < 100_000, 50_000).when(loc < 1_000_000, 80_000).otherwise(150_000)


#: Budgets at depth 0 and at the largest depth.
BUDGETS = {"file_content_tokens": (10_000, 50_000), "llm_input_tokens": (15_000, 60_000), "leaf_answer_tokens": (18_000, 21_000), "internal_answer_tokens": (11_000, 19_000)}


def adaptive_budgets(depth: Column, max_depth: Column) -> list[Column]:
    ratio = depth / F.greatest(max_depth, F.lit(1))
    return [F.floor(F.lit(a) + F.lit(b - a) * ratio).cast("int").alias(n) for n, (a, b) in BUDGETS.items()]


def gap_scores(gaps: DataFrame) -> DataFrame:
    """cluster_id, votes, score: votes * mean confidence * (1 + 0.3 / (1 + smallest shard))."""
    g = gaps.groupBy("cluster_id").agg(F.count("*").alias("votes"), F.avg("confidence").alias("c"), F.min("shard").alias("s"))
    return g.select("cluster_id", "votes", (F.col("votes") * F.col("c") * (1 + 0.3 / (1 + F.col("s")))).alias("score"))


def insert_batch_size(rows: DataFrame, column: str, budget_bytes: int = 4 << 20) -> DataFrame:
    """Rows of an insert for a budget of bytes, 1,000 to 20,000."""
    return rows.agg(F.greatest(F.lit(1000), F.least(F.lit(20_000), F.floor(F.lit(budget_bytes) / F.greatest(F.lit(1.0), F.avg(F.octet_length(column)))))).cast("int").alias("batch_size"))


def score_changes(rounds: DataFrame) -> DataFrame:
    """chunk_id, round and the score's change since the round before; rows (chunk_id, round, score) without one are left out."""
    before = rounds.select("chunk_id", (F.col("round") + 1).alias("round"), F.col("score").alias("_before"))
    return rounds.join(before, ["chunk_id", "round"]).select("chunk_id", "round", (F.col("score") - F.col("_before")).alias("change"))
