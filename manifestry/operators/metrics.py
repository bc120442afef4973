"""Metrics, diagnostics and deterministic samples over labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed


def running(rows: DataFrame, by: list[str], order: list[str], *columns: str) -> DataFrame:
    """rows with ``before_c`` for each of the columns: its sum over the rows before, in the order within each ``by`` (which may be
    empty: over all); the order tells rows of a group apart.

    No group is put in order in one task: the rows are parted by range, summed up within their part, and begin where the
    parts before end.  The parts are written once, so that both steps see the same ones.
    """
    parts = checkpointed(rows.repartitionByRange(*by, *order).withColumn("part", F.spark_partition_id()))
    # one row for each group and part
    totals = parts.groupBy(*by, "part").agg(*(F.sum(c).alias(c) for c in columns))
    upto = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(F.col(c).alias(f"of_{c}") for c in (*by, "part")), *(F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"offset_{c}") for c in columns))
    own = Window.partitionBy(*by, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = parts.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(own), F.lit(0)) for c in columns})
    same = F.lit(True)
    for c in (*by, "part"):
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    met = inner.join(offsets, same)
    return met.withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"offset_{c}") for c in columns}).select(*rows.columns, *(f"before_{c}" for c in columns))


def history_rates(rows: DataFrame, by: str, outcome: str) -> DataFrame:
    """Mean outcome and count for each value of ``by``."""
    return rows.groupBy(by).agg(F.round(F.avg(outcome), 6).alias("rate"), F.count("*").alias("n"))


def with_history(rows: DataFrame, rates: DataFrame, by: str) -> DataFrame:
    """Rows with their entity's rate (null if it is new) and count (0 if it is new)."""
    return rows.join(rates, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def confusion(rows: DataFrame, y: Column, hit: Column) -> DataFrame:
    """One row: counts, precision, recall, F1 and accuracy; 0 where a denominator is."""
    n = lambda c: F.count(F.when(c, 1))
    counts = rows.agg(n((y == 1) & hit).alias("tp"), n((y == 0) & hit).alias("fp"), n((y == 0) & ~hit).alias("tn"), n((y == 1) & ~hit).alias("fn"))
    share = lambda a, b: F.coalesce(F.try_divide(F.expr(a).cast("double"), F.expr(b)), F.lit(0.0))
    return counts.select(
        "tp", "fp", "tn", "fn", F.round(share("tp", "tp + fp"), 6).alias("precision"), F.round(share("tp", "tp + fn"), 6).alias("recall"),
        F.round(share("2 * tp", "2 * tp + fp + fn"), 6).alias("f1"), F.round(share("tp + tn", "tp + fp + tn + fn"), 6).alias("accuracy"),
    )


def rank_auc(rows: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the ROC curve by rank sums, ties sharing their mean rank.

    Rows are counted by score first; only the distinct scores, one partial row each, are put in order, in range
    partitions whose offsets are added, so no single task sorts all rows.
    """
    per = rows.groupBy(F.col(score).alias("v")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count("*").alias("n"))
    part = per.repartitionByRange("v").withColumn("part", F.spark_partition_id())
    sums = part.groupBy("part").agg(F.sum("n").alias("in_part"))
    offsets = sums.withColumn("before", F.coalesce(F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = part.withColumn("inside", inside).join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("inside") + (F.col("n") + 1) / 2)
    total = ranked.agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("t"))
    return total.select(F.round(F.coalesce(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, (F.col("p") * (F.col("t") - F.col("p"))).cast("double")), F.lit(0.5)), 6).alias("auc"), F.col("p").alias("n_positive"), F.col("t").alias("n"))


def reliability(rows: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Bins of equal width, closed on the right; the first holds 0 as well."""
    place = F.greatest(F.lit(1), F.ceil(F.col(p) * bins)).cast("long")
    return rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(F.col(y).cast("double")), 6).alias("rate"))


def brier(rows: DataFrame, y: str, p: str) -> DataFrame:
    return rows.agg(F.round(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))), 6).alias("brier"))


def best_threshold(rows: DataFrame, y: str, p: str, steps: int = 99) -> DataFrame:
    """Threshold of the best F1: 0.5 unless one of the steps is strictly better, the first of equals.

    Rows are counted by step (at most steps + 1 counts); each threshold's counts are sums of them.
    """
    counts = rows.groupBy(F.floor(F.col(p) * (steps + 1)).alias("step")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count("*").alias("n"))
    grid = rows.sparkSession.range(1, steps + 1).select(F.col("id").alias("t"))
    at = counts.join(F.broadcast(grid), F.col("step") >= F.col("t")).groupBy("t").agg(F.sum("pos").alias("tp"), F.sum("n").alias("flagged"))
    every = counts.agg(F.sum("pos").alias("all_pos"))
    scored = at.join(F.broadcast(every)).select("t", F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("flagged") + F.col("all_pos")), F.lit(0.0)).alias("f1"))
    best = scored.agg(F.max(F.struct(F.round("f1", 9).alias("f1"), (F.col("t") == (steps + 1) // 2).alias("half"), (-F.col("t")).alias("first"))).alias("b"))
    return best.select(F.round(-F.col("b.first") / (steps + 1), 4).alias("threshold"), F.round("b.f1", 6).alias("f1"))


def order_key(seed: str, key: str) -> Column:
    """A fixed pseudo-random order that any engine can compute."""
    return F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))


def _ranked(rows: DataFrame, key: str, by: str, seed: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their rank r in the fixed order of their class, and (by, n) of the classes.

    Classes are few and large, so ranks are taken within slices of the order and offset by the slices before.
    """
    keyed = rows.withColumn("o", order_key(seed, key)).withColumn("slice", F.substring("o", 1, 2))
    per = keyed.groupBy(by, "slice").agg(F.count("*").alias("n"))
    before = per.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(by, "slice", "before")
    ranked = keyed.join(before, [by, "slice"]).withColumn("r", F.col("before") + F.row_number().over(Window.partitionBy(by, "slice").orderBy("o", key)))
    return ranked, per.groupBy(by).agg(F.sum("n").alias("n"))


def stratified(rows: DataFrame, key: str, by: str, n: int, seed: str = "s") -> DataFrame:
    """n rows, shared out by the sizes of the strata (rounded half to even; the last stratum takes what is left), the
    first of each in the fixed order; all rows if there are no more than n. Rows without a stratum only count in the total."""
    ranked, strata = _ranked(rows, key, by, seed)
    every = strata.agg(F.sum("n").alias("total"), F.max(by).alias("last"))
    share = strata.where(F.col(by).isNotNull()).crossJoin(F.broadcast(every)).withColumn("k", F.bround(n * F.col("n") / F.col("total")).cast("long"))
    others = share.agg(F.coalesce(F.sum(F.when(F.col(by) != F.col("last"), F.col("k"))), F.lit(0)).alias("others"))
    k = F.when(F.col("total") <= n, F.col("n")).when(F.col(by) == F.col("last"), n - F.col("others")).otherwise(F.col("k"))
    wanted = share.crossJoin(F.broadcast(others)).select(F.col(by).alias("stratum"), F.greatest(F.lit(0), F.least(k, F.col("n"))).alias("take"))
    return ranked.join(wanted, F.col(by) == F.col("stratum")).where(F.col("r") <= F.col("take")).select(key, by)


def balanced(rows: DataFrame, key: str, y: str, seed: str = "b") -> DataFrame:
    """As many of each class as the smallest has, in the fixed order."""
    ranked, classes = _ranked(rows, key, y, seed)
    return ranked.join(F.broadcast(classes.agg(F.min("n").alias("least")))).where(F.col("r") <= F.col("least")).select(key, y)


def group_split(rows: DataFrame, group: str, seed: str = "g") -> DataFrame:
    """train, validation or test (60, 20, 20 in a hundred), the same for all rows of a group."""
    place = F.conv(F.substring(order_key(seed, group), 1, 8), 16, 10).cast("long") % 100
    return rows.withColumn("split", F.when(place < 60, "train").when(place < 80, "validation").otherwise("test"))


def latest(rows: DataFrame, by: str, when: str, tie: str, *columns: str) -> DataFrame:
    """The latest row of each ``by``: a map-side combined maximum, no window."""
    return rows.groupBy(by).agg(F.max(F.struct(when, tie, *columns)).alias("m")).select(by, "m.*")


#: Equal parts of a group's range of values, of which only those that hold a quantile are put in order.
SLICES = 1024


def quantiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """p50 (the mean of both middle values), p95 (the value at the place nearest to 0.95 of the way), maximum and
    number of each group's values; null ones don't count.

    A group is never put in order as a whole: its values are counted in equal slices of its range, and only the
    slices that hold one of the three places are ranked.
    """
    known = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).cast("double").alias("v"), F.col(value).alias("own"))
    per = known.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max("own").alias("most"), F.count("*").alias("n"))
    part = F.coalesce(F.least(F.lit(SLICES - 1), F.floor(F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low")) * SLICES)), F.lit(0))
    cut = known.join(per.select(F.col("g").alias("of"), "low", "high"), F.col("g").eqNullSafe(F.col("of"))).select("g", "v", part.alias("slice"))
    upto = Window.partitionBy("g").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = cut.groupBy("g", "slice").agg(F.count("*").alias("here")).withColumn("before", F.coalesce(F.sum("here").over(upto), F.lit(0)))
    places = F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2), F.bround(0.95 * (F.col("n") - 1)).cast("long"))
    wanted = per.select(F.col("g").alias("of"), places.alias("places"))
    held = slices.join(wanted, F.col("g").eqNullSafe(F.col("of"))).where(F.exists("places", lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("here"))))
    held = held.select(F.col("g").alias("of"), F.col("slice").alias("in"), "before", "places")
    ranked = cut.join(held, F.col("g").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("in"))).withColumn("at", F.col("before") + F.row_number().over(Window.partitionBy("g", "slice").orderBy("v")) - 1)
    at = lambda i: F.max(F.when(F.col("at") == F.get("places", F.lit(i)), F.col("v")))
    found = ranked.groupBy("g").agg(F.round((at(0) + at(1)) / 2, 6).alias("p50"), F.round(at(2), 6).alias("p95"))
    return found.join(per.select(F.col("g").alias("of"), "most", "n"), F.col("g").eqNullSafe(F.col("of"))).select(F.col("g").alias(by), "p50", "p95", "most", "n")


def islands(rows: DataFrame, by: str, place: str, tie: str, gap: float) -> DataFrame:
    """Lines of a page, sessions of a user: a new one where the step from the row before exceeds ``gap``."""
    w = Window.partitionBy(by).orderBy(place, tie)
    new = F.when(F.col(place) - F.lag(place).over(w) <= gap, 0).otherwise(1)
    return rows.withColumn("new", new).withColumn("line", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("new")
