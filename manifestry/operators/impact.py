"""Impact graph: which other field a change of one field exposes, at depth one.

A node is a document's field, an edge a rule that compares two fields for equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import verdict
from .catalog import CROSS_RULES, EQUALITY_CHECKS, RULES, Rule

EDGE = ("doc", "field", "to_doc", "to_field", "rule_id")


def pairs() -> list[tuple[str, str, str, str, str]]:
    """Edges of the catalogs, each in both directions, without loops."""
    one_way = [("bl", f, "credit", r.credit, r.id) for r in RULES if r.check in EQUALITY_CHECKS and r.credit for f in r.fields]
    one_way += [(*r.left, *r.right, r.id) for r in CROSS_RULES if r.check in EQUALITY_CHECKS]
    both = one_way + [(c, d, a, b, i) for a, b, c, d, i in one_way]
    return sorted({e for e in both if e[:2] != e[2:4]})


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(pairs(), ", ".join(f"{c} string" for c in EDGE))


def edges_sql() -> str:
    rows = ", ".join("(" + ", ".join(f"'{x}'" for x in e) + ")" for e in pairs())
    return f"SELECT * FROM (VALUES {rows}) AS e(doc, field, to_doc, to_field, rule_id)"


def impacted(graph: DataFrame, changed: DataFrame) -> DataFrame:
    """(doc, field, further columns such as the shipment) of ``changed`` to the fields next to them; each rule once.

    The graph, a row for each pair of fields that a catalog's rule ties together, goes to every task: by field, of which
    there are few, a shuffle would bring all shipments to a few tasks.
    """
    return changed.join(F.broadcast(graph), ["doc", "field"]).dropDuplicates([*changed.columns, "to_doc", "to_field", "rule_id"])


def exposed(judged: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each edge of the rules, how many shipments its rule finds at odds; none without shipments. Outcomes are counted at their
    places, and the edges, of which there are few, are read off that one row."""
    of = {r.id: i for i, r in enumerate(rules)}
    each = [F.struct(*(F.lit(x).alias(n) for x, n in zip(e, EDGE)), F.col(f"n_violated_{of[e[4]]}").alias("n_violated")) for e in pairs() if e[4] in of]
    return verdict.counted(judged, rules, n_violated=verdict.is_bad).select(F.inline(F.when(F.col("n_rows") > 0, F.array(*each))))
