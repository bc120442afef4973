"""Outcomes: verdicts summed up for a screen, quality gates of a rule set, calibration, edits and glossary merges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from . import checks, verdict
from .catalog import RULES

SEVERITIES = ("critical", "warning", "info")
#: Share of clean shipments that may have a critical violation, and the least recall of any critical rule.
FALSE_ALARMS, LEAST_RECALL = 0.05, 0.95
REATTACH_AT = 0.8
# The defects whose recall has to be measured and high, and the rules that look for them.
CRITICAL_KINDS = {"D002": "late_shipment", "D003": "port_mismatch", "D004": "port_mismatch", "D005B": "consignee_mismatch", "D008": "expired"}


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def summary(judged: DataFrame) -> DataFrame:
    """For each shipment: violated rules by severity, held ones apart (they are no violations yet), and the worst severity."""
    n = judged.schema["outcomes"].metadata["rules"]
    of = lambda v: verdict.number(lambda r: verdict.is_bad(r) & (r["severity"] == v), n).alias(v)
    counts = judged.select("shipment_id", *map(of, SEVERITIES), verdict.number(lambda r: r["status"] == verdict.HELD, n).alias("deferred"))
    worst = F.coalesce(*(F.when(F.col(v) > 0, v) for v in SEVERITIES))
    return counts.withColumn("total", sum((F.col(v) for v in SEVERITIES), F.col("deferred"))).withColumn("worst", worst)


def passed_rules(judged: DataFrame) -> DataFrame:
    """Ids of the rules that each shipment passed, in order; a rule that was not evaluated has not passed."""
    ids = F.array_sort(F.transform(F.filter("outcomes", lambda r: r["status"] == checks.PASS), lambda r: r["rule_id"]))
    return judged.select("shipment_id", F.array_join(ids, ",").alias("passed"))


def with_fired(judged: DataFrame) -> DataFrame:
    """Further column ``fired``: 1 if any critical rule is violated."""
    return judged.withColumn("fired", (verdict.number(lambda r: verdict.is_bad(r) & (r["severity"] == "critical"), judged.schema["outcomes"].metadata["rules"]) > 0).cast("int"))


def fired(judged: DataFrame) -> DataFrame:
    """(shipment_id, fired)."""
    return with_fired(judged).select("shipment_id", "fired")


def rule_recalls(rows: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(rule_id, recall, n): of the shipments in which each rule is violated, the share that has a critical violation at all.

    Both are known within the shipment's row (``with_fired``), so the catalog is evaluated once and nothing is joined.
    """
    counts = verdict.rule_counts(rows, rules, n=verdict.is_bad, caught=lambda r: verdict.is_bad(r) & (F.col("fired") == 1))
    return counts.where("n > 0").select("rule_id", F.round(F.col("caught") / F.col("n"), 4).alias("recall"), "n")


def false_alarms(rows: DataFrame) -> DataFrame:
    """Of the clean shipments (y = 0), how many are flagged, and the share; 0 where none is clean."""
    n, wrong = _count(F.col("y") == 0), _count((F.col("y") == 0) & (F.col("fired") == 1))
    return rows.agg(n.alias("n_clean"), wrong.alias("n_flagged"), F.round(F.coalesce(F.try_divide(wrong.cast("double"), n), F.lit(0.0)), 6).alias("rate"))


def leakage(rows: DataFrame) -> DataFrame:
    """Does the outcome y merely repeat the rules? Correlation, defects among silent shipments, sound ones among fired."""
    silent, hot = F.col("fired") == 0, F.col("fired") == 1
    return rows.agg(
        F.round(F.corr("y", "fired"), 6).alias("phi"), F.round(F.avg(F.when(silent, F.col("y"))), 6).alias("defects_if_silent"), F.round(F.avg(F.when(hot, 1 - F.col("y"))), 6).alias("sound_if_fired"),
        _count(silent).alias("n_silent"), _count(hot).alias("n_fired"), F.round(F.avg("y"), 6).alias("defect_rate"),
    )


def binary_metrics(rows: DataFrame) -> DataFrame:
    """A 0/1 verdict taken as a score: F1, AUC (mean of both classes' recalls), Brier, rows and share of positives."""
    y, hit = F.col("y") == 1, F.col("fired") == 1
    share = lambda a, b: F.try_divide(a.cast("double"), b)
    tp, fp, fn, tn = _count(y & hit), _count(~y & hit), _count(y & ~hit), _count(~y & ~hit)
    return rows.agg(
        F.round(F.coalesce(share(2 * tp, 2 * tp + fp + fn), F.lit(0.0)), 6).alias("f1"), F.round((share(tp, tp + fn) + share(tn, tn + fp)) / 2, 6).alias("auc"),
        F.round(share(fp + fn, tp + fp + fn + tn), 6).alias("brier"), F.count("*").alias("n"), F.round(share(tp + fn, tp + fp + fn + tn), 6).alias("positive_rate"),
    )


def critical_recalls(recalls: DataFrame) -> DataFrame:
    """The least recall (of rule_id, recall) for each kind of critical defect that was measured."""
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in CRITICAL_KINDS.items() for x in pair)), F.col("rule_id"))
    return recalls.where(F.col("rule_id").isin(*CRITICAL_KINDS)).groupBy(kind.alias("kind")).agg(F.min("recall").alias("recall"))


def gate(metrics: DataFrame, alarms: DataFrame, recalls: DataFrame, target_f1: float, least_kinds: int = 1) -> DataFrame:
    """All three targets have to be met; with fewer than ``least_kinds`` recalls measured the gate stays shut. Each input is one row or one row for each kind."""
    worst = recalls.agg(F.when(F.count("recall") >= least_kinds, F.min("recall")).alias("worst_recall"))
    parts = [metrics.select((F.col("f1") >= target_f1).alias("meets_f1")), alarms.select((F.col("rate") <= FALSE_ALARMS).alias("meets_false_alarms")), worst.select(F.coalesce(F.col("worst_recall") >= LEAST_RECALL, F.lit(False)).alias("meets_recall"))]
    tagged = [p.withColumn("k", F.lit(1)) for p in parts]
    return tagged[0].join(tagged[1], "k").join(tagged[2], "k").drop("k").withColumn("passes", F.col("meets_f1") & F.col("meets_false_alarms") & F.col("meets_recall"))


def bootstrap_f1(rows: DataFrame, key: str, y: Column, hit: Column, draws: int = 1000) -> DataFrame:
    """F1 and its 95 % interval by Poisson resampling: a row's weight in a draw follows from a hash of its key and the draw.

    No row is drawn again or moved: each counts itself in every draw on the map side, and only draws x 3 sums shuffle.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    steps, total = [], 0.0
    for k in range(6):
        total += math.exp(-1) / math.factorial(k)
        steps.append(round(total, 9))
    weighed = rows.select(key, y.cast("int").alias("y"), hit.cast("int").alias("hit"), F.explode(F.sequence(F.lit(0), F.lit(draws))).alias("draw"))
    weight = F.when(F.col("draw") == 0, 1).otherwise(sum(((u >= t).cast("int") for t in steps), F.lit(0)))
    sums = weighed.withColumn("w", weight).groupBy("draw").agg(F.sum(F.expr("w * y * hit")).alias("tp"), F.sum(F.expr("w * (y + hit)")).alias("both"))
    f1 = sums.select("draw", F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("both")), F.lit(0.0)).alias("f1"))
    drawn = F.when(F.col("draw") > 0, F.col("f1"))
    return f1.agg(F.round(F.max(F.when(F.col("draw") == 0, F.col("f1"))), 6).alias("point"), F.round(F.percentile(drawn, 0.025), 6).alias("low"), F.round(F.percentile(drawn, 0.975), 6).alias("high"))


def platt(rows: DataFrame, y: str, score: str, l2: float = 1.0, steps: int = 12) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (score, y), ridge on the slope.

    A Newton step needs five sums over the rows, one map-side combined aggregate each; the driver sees those alone.
    """
    a = b = 0.0
    for _ in range(steps):
        p = 1 / (1 + F.exp(-(F.col(score) * a + b)))
        w, x = p * (1 - p), F.col(score)
        ga, gb, haa, hab, hbb = rows.agg(F.sum((p - F.col(y)) * x), F.sum(p - F.col(y)), F.sum(w * x * x), F.sum(w * x), F.sum(w)).first()
        if ga is None:  # no rows
            return 0.0, 0.0
        ga, haa = ga + l2 * a, haa + l2
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if max(abs(da), abs(db)) < 1e-10:
            break
    return a, b


def effective_grade(value: Column, grade: Column, edit: Column) -> Column:
    """An edit that changes the value confirms it; a null edit is none."""
    return F.when(edit.isNotNull() & ~edit.eqNullSafe(value), "confirmed").otherwise(grade)


def settle(fields: DataFrame, chosen: Column) -> DataFrame:
    """Fields in conflict (value, confidence, conflict, candidates) with the chosen candidate's value and its own confidence.

    A choice that is no candidate changes nothing; choosing doesn't raise the confidence.
    """
    found = F.try_element_at(F.filter("candidates", lambda c: c["value"] == chosen), F.lit(1))
    hit = found.isNotNull()
    return fields.select(
        *(c for c in fields.columns if c not in ("value", "confidence", "conflict", "candidates")),
        F.when(hit, found["value"]).otherwise(F.col("value")).alias("value"), F.when(hit, found["confidence"]).otherwise(F.col("confidence")).alias("confidence"), (F.col("conflict") & ~hit).alias("conflict"),
    )


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Glossary terms by key: the new row's canonical form and aliases replace the old ones; blank aliases are dropped, each kept once in order."""
    clean = F.array_sort(F.array_distinct(F.filter(F.transform("n.aliases", lambda a: F.trim(a)), lambda a: a != "")))
    both = old.alias("o").join(new.alias("n"), "key", "full")
    is_new = F.col("n.canonical").isNotNull()
    return both.select(
        "key", F.when(is_new, F.col("n.canonical")).otherwise(F.col("o.canonical")).alias("canonical"), F.array_join(F.when(is_new, clean).otherwise(F.col("o.aliases")), "|").alias("aliases"),
        F.when(~is_new, "kept").when(F.col("o.canonical").isNull(), "added").otherwise("updated").alias("change"),
    )


def same_values(shipments: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(shipment_id, field, others): the other fields of the shipment that say the same, by loose key, in order.

    A shipment's fields stand in its row and are compared there; nothing is shuffled or joined.
    """
    keyed = shipments.select("shipment_id", *(s.loose_key(F.col(f)).alias(f) for f in fields))
    others = lambda f: F.concat_ws(",", *(F.when((F.col(f) != "") & (F.col(f) == F.col(o)), F.lit(o)) for o in sorted(fields) if o != f))
    each = keyed.select("shipment_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), others(f).alias("others")) for f in fields))).alias("x"))
    return each.select("shipment_id", "x.*").where("others <> ''")


def render(shipments: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Each shipment's document as lines ``LABEL: value`` of the fields that have one."""
    lines = [F.concat(F.lit(f.upper().replace("_", " ") + ": "), s.present(F.col(f))) for f in fields]
    return shipments.select("shipment_id", F.concat_ws("\n", *lines).alias("text"))


def readiness(grades: DataFrame, by: str, critical: tuple[str, ...]) -> DataFrame:
    """For each draft (by; field, grade): filled share, share that has to be confirmed, and whether it may be verified.

    It may not while a critical field is empty or any field has to be confirmed.
    """
    filled, must = F.col("grade") != "undetected", F.col("grade") == "required"
    return grades.groupBy(by).agg(
        F.round(_count(filled) / F.count("*"), 4).alias("completeness"), F.round(_count(must) / F.count("*"), 4).alias("hold_ratio"),
        ((_count(must) == 0) & (_count(~filled & F.col("field").isin(*critical)) == 0)).alias("ready"),
    )


def reattach(rows: DataFrame, words: str, value: str, theta: float = REATTACH_AT) -> DataFrame:
    """Where among a document's words a value without a place comes from: the run of words most like it by trigrams.

    Runs have one word up to one more than the value; the earliest and shortest of equals is taken, and none below
    theta.  All is done within the row, so nothing shuffles.  Adds start, end (not included) and sim; null if none.
    """
    plain = lambda c: F.lower(F.regexp_replace(F.upper(c), "[^0-9A-Z가-힣]", ""))
    size = F.size(F.split(F.trim(value), r"\s+"))
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))

    def runs(i: Column) -> Column:
        lengths = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(size + 1, F.size(words) - i)))
        like = lambda n: F.round(s.trigram_similarity(plain(F.array_join(F.slice(words, i + 1, n), "")), plain(F.col(value))), 9)
        return F.transform(lengths, lambda n: F.struct(like(n).alias("sim"), (-i).alias("start"), (-n).alias("n")))

    best = F.array_max(F.flatten(F.transform(starts, runs)))
    return rows.withColumn("best", F.transform(F.array(best), lambda b: F.when(b["sim"] >= theta, b)).getItem(0)).select(
        *rows.columns, (-F.col("best.start")).alias("start"), (-F.col("best.start") - F.col("best.n")).alias("end"), F.col("best.sim").alias("sim")
    )
