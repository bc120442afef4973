"""Review of extracted values: payloads, reasons, conflicts, gates, and the integrity of what is written about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s

# Words that mark a credit's condition as one that documents show, or as one that they can't.
VERIFIABLE = ["BILL OF LADING", "INVOICE", "CERTIFICATE", "PACKING LIST", "MARKED", "STATED", "SHOW", "EVIDENCE"]
UNVERIFIABLE = ["NOTIFY", "CONFIRM", "ARRANGE", "INFORM", "ADVISE", "BY EMAIL", "BY FAX", "APPLICANT"]
TIMING = "WITHIN.*DAYS OF"
# States of a shipment whose bill of lading has been issued.
ISSUED = ["SUBMITTED", "MONITORING", "CLOSED"]


def payload(values: DataFrame) -> DataFrame:
    """(shipment_id, doc, fields): one value for each field, a representative one before others, then the lowest id.

    The choice is a grouped minimum, so no field's values are sorted.
    """
    text = F.coalesce(s.present(F.col("normalized")), s.present(F.col("value")))
    best = values.where(text.isNotNull()).groupBy("shipment_id", "doc", "field").agg(F.min(F.struct(~F.col("representative"), F.col("value_id"), text.alias("text"))).alias("b"))
    return best.groupBy("shipment_id", "doc").agg(F.array_sort(F.collect_list(F.concat_ws("=", "field", "b.text"))).alias("f")).select("shipment_id", "doc", F.array_join("f", ";").alias("fields"))


def review_reason(value: Column, confidence: Column, source: Column, critical: Column, label: Column) -> Column:
    """First reason that holds: missing and critical, echo of the form's label, uncalibrated source, anchor, low confidence."""
    v = s.present(value)
    echo = F.contains(F.upper(v), F.upper(label)) | F.contains(F.upper(label), F.upper(v))
    return (
        F.when(v.isNull() & critical, "missing").when(echo, "label_echo").when(source == "uncalibrated", "uncalibrated").when(source == "anchor", "anchor")
        .when(confidence < s.GRADE_REQUIRED_BELOW, "low_confidence")
    )


def status_gate(n_required: Column, n_critical: Column) -> Column:
    """Struct (allowed, overridable, blockers): open only without fields to be reviewed and critical violations.

    A shut gate can always be overridden with a reason; each of the two counts is one blocker.
    """
    blockers = (n_required > 0).cast("long") + (n_critical > 0).cast("long")
    return F.struct((blockers == 0).alias("allowed"), F.lit(True).alias("overridable"), blockers.alias("blockers"))


def reissue_path(doc: Column, status: Column) -> Column:
    """An edited bill of lading that has been issued is issued again; anything else is an edit of a draft."""
    return F.when((doc == "bill_of_lading") & status.isin(ISSUED), "REISSUE").otherwise("DRAFT_EDIT")


def needs_amendment(status: Column, touches_credit: Column) -> Column:
    """Once issued, changing a field that is tied to the credit means changing its terms."""
    return status.isin(ISSUED) & touches_credit


def conditions_of(text: Column) -> Column:
    """The conditions of a semicolon list, blank ones apart."""
    return F.filter(F.split(text, ";"), lambda c: F.trim(c) != "")


def classify_conditions(text: Column) -> Column:
    """Struct (verifiable_ratio, n_unverifiable) of a semicolon list's conditions; both null without any.

    A condition counts words of both kinds, a time limit as one more that documents can't show; a tie is unverifiable.
    """

    def beyond(c: Column) -> Column:
        marks = lambda ws: F.size(F.filter(s.words(ws), lambda w: F.contains(c, w)))
        return marks(UNVERIFIABLE) + c.rlike(TIMING).cast("int") >= marks(VERIFIABLE)

    n, bad = F.size(conditions_of(text)), F.size(F.filter(F.transform(conditions_of(text), F.upper), beyond))
    some = F.when(n > 0, bad)
    return F.struct(F.round((n - some) / n, 6).alias("verifiable_ratio"), some.cast("long").alias("n_unverifiable"))


def unsupported(prose: Column, allowed: Column, pattern: str) -> Column:
    """What the prose states (by the pattern) and the report doesn't hold, each once, in order."""
    return F.array_sort(F.array_except(F.regexp_extract_all(prose, F.lit(pattern), 0), allowed))


def any_of(probabilities: Column) -> Column:
    """1 - product of (1 - p): at least one of independent findings."""
    return 1 - F.aggregate(probabilities, F.lit(1.0), lambda a, p: a * (1 - p))
