"""Mixing sources to target weights by hash thresholds.

A document's place in its source's order is a 60-bit hash of its id. Word counts
are summed by source and by the leading hash bits; the running sums show in
which bucket the source's budget runs out, and only that bucket is split by the
next bits, until it holds one hash. Documents below the threshold are taken, so
nothing is sorted, and a smaller budget takes a subset of what a larger one does.

Sources are rows of a table from beginning to end, so there may be any number of
them; the driver sees sums and a number for each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karstwell.llm.shared import aside, cut
from karstwell.operators.search import numbered

BITS, STEP = 60, 12
#: A table with a row for each source is broadcast if it has at most so many rows (a few MB).
BROADCAST_SOURCES = 50_000

_SOURCE = ["none", "source"]


def targets(sources: DataFrame, cycle: tuple[int, ...], cap: int) -> DataFrame:
    """Adds target to none, source, n (words): shares of the sum of n by weight, none over ``cap`` * n.

    Sources weigh ``cycle`` again and again in the order of their code points,
    null last. What a full source leaves is shared again by weight. A source is
    full if n / weight is below a level that only rises, so each round is one
    aggregation, and there are as many rounds as levels.
    """
    big = "decimal(38,0)"
    weights = F.array(*[F.lit(w) for w in cycle])
    placed = numbered(sources, [F.col("none"), F.col("source")], "place")
    placed = cut(placed.withColumn("w", F.element_at(weights, (F.col("place") % len(cycle) + 1).cast("int")).cast("long")))
    total = int(placed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    level = (0, 1)  # left words and left weight
    full = F.lit(False)
    while True:
        sums = placed.where(full).agg(F.coalesce(F.sum(F.col("n").cast(big)), F.lit(0)), F.count("*")).first()
        weight = int(placed.where(~full).agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0])
        left = total - cap * int(sums[0])
        if not weight or level == (left, weight):
            break
        level = left, weight
        # left / weight * w > cap * n, in whole numbers
        full = F.lit(left).cast(big) * F.col("w").cast("decimal(9,0)") > F.col("n").cast("decimal(20,0)") * F.lit(cap * weight).cast("decimal(18,0)")
    shares = {w: left * w / weight if weight else 0.0 for w in set(cycle)}
    share = F.coalesce(*[F.when(F.col("w") == w, F.lit(float(x))) for w, x in shares.items()])
    return placed.select(*_SOURCE, "n", F.when(full, (F.col("n") * cap).cast("double")).otherwise(share).alias("target"))


def mix_sources(documents: DataFrame, *, cycle: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Which documents a mix takes, and how often.

    ``documents``: doc_id, text, source; other columns are passed through,
    whatever their names, but for those that are added. Sources in the order
    of their code points, null last, weigh ``cycle`` again and again and share
    the number of all words; a source's target is at most ``cap`` times its own
    words. Each whole multiple of the source's words repeats all its documents;
    the rest takes the documents of the smallest hashes, as many as come nearest
    to the target.

    Adds size (words, long), source_size (long), target (double), repeats (int)
    and taken (size * repeats, long).

    Null or empty text: size 0. Null source: a source of its own. Rows with the
    same doc_id (also null) have the same hash and are taken or left together.
    An empty table gives an empty result. Any number of sources.
    """
    added = ["size", "source_size", "target", "repeats", "taken"]
    kept = [c for c in documents.columns if c.lower() not in added]
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    identity = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    place = F.conv(F.substring(F.md5(identity), 1, BITS // 4), 16, 10).cast("long")
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = aside(documents, none=F.col("source").isNull(), source=source, hash=place, size=size)
    narrow = cut(rows.select(*_SOURCE, "hash", "size"))
    sources = cut(narrow.groupBy(*_SOURCE).agg(F.sum("size").alias("n")))
    small = sources.count() <= BROADCAST_SOURCES
    goal = targets(sources, cycle, cap)
    whole = F.when(F.col("n") > 0, F.least(F.lit(cap), F.floor(F.col("target") / F.col("n")))).otherwise(0).cast("int")
    goal = goal.withColumn("whole", whole).withColumn("rest", F.when(F.col("n") > 0, F.col("target") - F.col("whole") * F.col("n")).otherwise(F.lit(0.0)))
    goal = cut(_thresholds(narrow, goal, small))
    out = _joined(rows, goal.select(*_SOURCE, F.col("n").alias("source_size"), "target", "whole", "threshold"), small)
    repeats = (F.col("whole") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)).cast("int")
    out = out.withColumn("repeats", repeats).withColumn("taken", F.col("size") * F.col("repeats"))
    return out.select(*[F.col("row")[c].alias(c) for c in kept], *added)


def _joined(rows: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    """Rows with those of their source. Larger tables meet in a sort-merge join, whose hot sources AQE can split."""
    return rows.join(F.broadcast(sources) if small else sources.hint("merge"), _SOURCE)


def _running(value: Column) -> Column:
    return F.sum(value).over(Window.partitionBy(*_SOURCE).orderBy("bucket"))  # at most 2**STEP rows a source


def _thresholds(narrow: DataFrame, goal: DataFrame, small: bool) -> DataFrame:
    """Adds to each source the first hash that is not taken.

    State of a source: prefix (the boundary bucket's leading bits), base (words
    before it), inside (words in it); prefix is null once the whole source is
    taken, but for rounding.
    """
    state = goal.withColumns({"prefix": F.lit(0).cast("long"), "base": F.lit(0).cast("long"), "inside": F.col("n")})
    rows = narrow
    for level in range(BITS // STEP):
        low = BITS - STEP * (level + 1)
        open_ = state.where("rest > 0 and prefix is not null").select(*_SOURCE, "prefix", "base", "rest")
        rows = _joined(rows.select(*_SOURCE, "hash", "size"), open_, small).where(F.shiftright("hash", low + STEP) == F.col("prefix"))
        if level == 1:
            rows = cut(rows)  # of each source a bucket of 4,096; the rest of the table isn't read again
        sums = rows.groupBy(*_SOURCE, "base", "rest", F.shiftright("hash", low).alias("bucket")).agg(F.sum("size").alias("inside"))
        reached = sums.withColumn("behind", F.col("base") + _running(F.col("inside"))).where("behind >= rest")
        first = reached.groupBy(*_SOURCE).agg(F.min(F.struct("bucket", "behind", "inside")).alias("at"))
        state = state.join(F.broadcast(first) if small else first.hint("merge"), _SOURCE, "left")
        state = state.withColumns({"prefix": F.col("at.bucket"), "base": F.col("at.behind") - F.col("at.inside"), "inside": F.col("at.inside")}).drop("at")
        state = cut(state)
    # The boundary is one hash now; it is taken if that comes nearer to the budget.
    nearer = F.when(2 * F.col("base") + F.col("inside") < 2 * F.col("rest"), 1).otherwise(0)
    threshold = F.when(F.col("rest") <= 0, F.lit(0).cast("long")).otherwise(F.coalesce(F.col("prefix") + nearer, F.lit(1 << BITS)))
    return state.withColumn("threshold", threshold)
