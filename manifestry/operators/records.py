"""Small operators on records: what is sent, shown, rendered, matched, summed up and kept as it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from . import metrics

# Words in a value that try to instruct a model, how long a value may be, and the day for texts without dates.
INJECTION_MARKERS = ["ignore previous", "disregard", "system:", "assistant:", "무시하", "당신은 이제", "```", "<|", "\u202e"]
MAX_VALUE_CHARS = 200
FALLBACK_AS_OF = "2013-07-01"


def plausible_date(c: Column) -> Column:
    """May the text be a date? ISO dates by the range of their parts; two numbers and a year if one of them may be the
    month; whatever has another form is left to the parser."""
    t = F.upper(F.trim(c))
    iso, pair = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$", r"^([0-9]{2})[-/]([0-9]{2})[-/]([0-9]{4})$"
    n = lambda p, i: F.nullif(F.regexp_extract(t, p, i), F.lit("")).cast("int")
    year = lambda y: y.between(1900, 2099)
    a, b = n(pair, 1), n(pair, 2)
    return (
        F.when(t.rlike(iso), year(n(iso, 1)) & n(iso, 2).between(1, 12) & n(iso, 3).between(1, 31))
        .when(t.rlike(pair), year(n(pair, 3)) & (a <= 31) & (b <= 31) & ((a <= 12) | (b <= 12))).otherwise(t.isNotNull())
    )


def shown_grade(value: Column, boxed: Column, confidence: Column, conflict: Column) -> Column:
    """The grade on screen: without a value or a box nothing was found; a conflict has to be settled."""
    return (
        F.when(value.isNull() | ~boxed, "NOT_FOUND").when(conflict | (confidence < s.GRADE_REQUIRED_BELOW), "REQUIRED")
        .when(confidence < s.GRADE_RECOMMENDED_BELOW, "ADVISORY").otherwise("CONFIRMED")
    )


def demoted(value: Column, boxed: Column, grade: Column) -> Column:
    """Struct (value, grade): a value without a box is none."""
    return F.struct(F.when(boxed, value).alias("value"), F.when(boxed, grade).otherwise("NOT_FOUND").alias("grade"))


def wire_payload(fields: Column) -> Column:
    """Of an array of (name, value) those with a value that isn't blank, as they are written."""
    return F.filter(fields, lambda f: F.trim(f["value"]) != "")


def coded(fields: DataFrame, mapping: DataFrame) -> DataFrame:
    """fields (doc, name, ...) with the code that the mapping (doc, name, code) has for them; unknown ones are dropped."""
    return fields.join(mapping, ["doc", "name"])


def owned(rows: DataFrame, tenant: Column) -> DataFrame:
    """The tenant's own rows; those of others, and of none, are as if they weren't there."""
    return rows.where(F.col("tenant_id") == tenant)


def render(template: Column, document: Column, credit: Column, detail: Column) -> Column:
    """The message with its placeholders filled: ``?`` for an empty value, nothing for an empty detail; a template that
    holds other placeholders is given as it is."""
    known = F.regexp_replace(template, r"\{(?:bl|lc|detail)\}", "")
    value = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("?"))
    parts = F.split(template, r"(?<=\})|(?=\{)")
    filled = F.transform(parts, lambda p: F.when(p == "{bl}", value(document)).when(p == "{lc}", value(credit)).when(p == "{detail}", F.coalesce(detail, F.lit(""))).otherwise(p))
    return F.when(known.rlike(r"\{[^}]*\}"), template).otherwise(F.array_join(filled, ""))


def as_of(first: Column, second: Column, days: int) -> Column:
    """Struct (as_of, dated): ``days`` after the first of both texts that is there, if it reads as a date; else a fixed day."""
    read = s.parse_date(s.first_present(first, second))
    return s.bound(read, lambda d: F.struct(F.coalesce(F.date_add(d, days), F.lit(FALLBACK_AS_OF).cast("date")).alias("as_of"), d.isNotNull().alias("dated")))


def without_rivals(kinds: Column, pairs: list[tuple[str, str]]) -> Column:
    """The kinds in order, without those that are rivals of one kept before."""
    rivals: dict = {}
    for a, b in pairs:
        rivals.setdefault(a, []).append(b)
        rivals.setdefault(b, []).append(a)
    table = F.create_map(*(x for k, v in rivals.items() for x in (F.lit(k), s.words(v))))
    none = F.array().cast("array<string>")
    return F.aggregate(kinds, none, lambda kept, k: F.when(F.arrays_overlap(F.coalesce(F.try_element_at(table, k), none), kept), kept).otherwise(F.concat(kept, F.array(k))))


def logit(p: Column, eps: float = 1e-6) -> Column:
    return s.bound(F.greatest(F.lit(eps), F.least(p, F.lit(1 - eps))), lambda x: F.log(x / (1 - x)))


def sigmoid(x: Column) -> Column:
    """Without overflow on either side."""
    return s.bound(F.exp(-F.abs(x)), lambda z: F.when(x >= 0, 1 / (1 + z)).otherwise(z / (1 + z)))


def lerp(at_full: Column, at_zero: Column, confidence: Column) -> Column:
    return at_zero + (at_full - at_zero) * F.greatest(F.lit(0.0), F.least(confidence, F.lit(1.0)))


def sanitized(value: Column) -> Column:
    """At most MAX_VALUE_CHARS of a value, without the marks that part a prompt's sections."""
    return F.replace(F.replace(F.substring(value, 1, MAX_VALUE_CHARS), F.lit("<<<"), F.lit("")), F.lit(">>>"), F.lit(""))


def has_marker(text: Column) -> Column:
    return F.exists(s.words(INJECTION_MARKERS), lambda m: F.contains(F.lower(text), m))


def section(text: Column, header: str) -> Column:
    """The text below ``=== header ===`` up to the next header; null without it."""
    mark = "=== " + header + " ==="
    body = F.regexp_extract(F.concat(F.lit("\n"), text), r"(?s)\n=== \Q" + header + r"\E ===(.*?)(?=\n=== [^\n]* ===|\z)", 1)
    return F.when(F.contains(text, F.lit(mark)), body)


def labelled_value(text: Column, label: str) -> Column:
    """The value on the line ``label: value``; null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?m)^\Q" + label + r"\E: (.*)$", 1)), F.lit(""))


def noisy_object(text: Column) -> Column:
    """From the first brace of a text to its last one, if that reads as a JSON object; else null."""
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return s.bound(F.nullif(inner, F.lit("")), lambda t: F.when(F.json_object_keys(t).isNotNull(), t))


def unchanged_but(old: Column, new: Column, *may: str) -> Column:
    """Are two structs the same in all but the named fields?"""
    rest = lambda x: F.to_json(x.dropFields(*may), {"ignoreNullFields": "false"})
    return rest(old) == rest(new)


def split_source(source: Column) -> Column:
    """Struct (article, reading): what is cited, and what stands behind the first dash of the kind looked for first."""
    def cut(dash: str) -> Column:
        at = F.instr(source, dash)
        return F.when(at > 0, F.struct(F.trim(F.substr(source, F.lit(1), at - 1)).alias("article"), F.trim(F.substr(source, at + len(dash))).alias("reading")))

    return F.coalesce(*(cut(d) for d in (" — ", " - ", " – ")), F.struct(F.trim(source).alias("article"), F.lit("").alias("reading")))


def by_article(rules: DataFrame) -> DataFrame:
    """(article, n, worst, place) of rules (source, rank of severity, how many of them): the worst first, then the larger, then by name.

    A catalog's articles are few, so the places are given in one task.
    """
    article = F.coalesce(F.nullif(split_source(F.coalesce("source", F.lit("")))["article"], F.lit("")), F.lit("(none)"))
    per = rules.groupBy(article.alias("article")).agg(F.sum("n").alias("n"), F.min("rank").alias("worst"))
    return per.withColumn("place", F.row_number().over(Window.orderBy("worst", F.desc("n"), "article")).cast("long"))


def unverified(rules: DataFrame) -> DataFrame:
    """Only rules that are marked as verified are; the default is not."""
    return rules.where(~F.col("verified").eqNullSafe(F.lit(True)))


def glossary_match(values: DataFrame, names: DataFrame) -> DataFrame:
    """The values (value_key, span_key, tenant, ...) of which some other name of their term stands in the span.

    ``names`` has (key, term_id, scope, tenant, active).  A value meets the names of its own terms by two equi-joins on key
    and term; the spans are only searched for those.
    """
    own = names.where("active").select(F.col("key").alias("value_key"), "term_id", "scope", F.col("tenant").alias("owner"))
    others = names.where("key <> ''").select(F.col("key").alias("other"), "term_id").distinct()
    pairs = own.join(others, "term_id").select("value_key", "scope", "owner", "other")
    seen = (F.col("v.value_key") == F.col("p.value_key")) & ((F.col("p.scope") == "STANDARD") | (F.col("p.owner") == F.col("v.tenant"))) & F.contains(F.col("v.span_key"), F.col("p.other"))
    return values.alias("v").join(pairs.alias("p"), seen, "left_semi")


def spans_in_boxes(values: DataFrame, tokens: DataFrame) -> DataFrame:
    """(value_id, start, end): from the first to behind the last token whose middle lies in the value's box on its page."""
    x, y = (F.col("t.x_min") + F.col("t.x_max")) / 2, (F.col("t.y_min") + F.col("t.y_max")) / 2
    inside = (F.col("v.document_id") == F.col("t.document_id")) & (F.col("v.page") == F.col("t.page")) & x.between(F.col("v.x1"), F.col("v.x2")) & y.between(F.col("v.y1"), F.col("v.y2"))
    return values.alias("v").join(tokens.alias("t"), inside).groupBy("v.value_id").agg(F.min("t.idx").alias("start"), (F.max("t.idx") + 1).alias("end"))


def explanation_metrics(rows: DataFrame) -> DataFrame:
    """One row from (outcome, integrity_ok, seconds): counts, shares that passed, the middle and the longest duration."""
    n = lambda c: F.count(F.when(c, 1))
    first, retry = n(F.col("outcome") == "llm_first"), n(F.col("outcome") == "llm_retry")
    share = lambda a: F.round(F.coalesce(F.try_divide(a.cast("double"), F.count("*")), F.lit(0.0)), 6)
    counts = rows.agg(F.count("*").alias("n"), first.alias("llm_first"), retry.alias("llm_retry"), n(F.col("outcome") == "template").alias("template"), share(n(F.col("integrity_ok"))).alias("integrity_rate"), share(first + retry).alias("llm_rate"), F.coalesce(F.max("seconds"), F.lit(0.0)).alias("longest"))
    # the value at place n // 2 in order, by the numbers of rows of each duration
    per = metrics.running(rows.groupBy(F.round("seconds", 6).alias("seconds")).agg(F.count("*").alias("here")), [], ["seconds"], "here")
    middle = per.crossJoin(F.broadcast(counts.select("n"))).where(F.col("before_here") + F.col("here") > F.floor(F.col("n") / 2)).agg(F.min("seconds").alias("p50"))
    return counts.crossJoin(F.broadcast(middle)).withColumn("p50", F.coalesce("p50", F.lit(0.0)))


def separability(rows: DataFrame, key: str, y: str, features: list[str], least: int = 5) -> DataFrame:
    """One row: the feature that tells y = 1 from y = 0 best, its area under the curve (whichever way it points), and
    whether both classes' ranges of it overlap.  Null features with fewer than ``least`` known rows of a class don't take part.

    Ranks follow from the numbers of rows of each value, summed up part by part, as a feature may have as many values as rows.
    """
    long = rows.select(F.col(y).alias("y"), F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features))).alias("x")).select("y", "x.*").where("v IS NOT NULL")
    per = long.groupBy("feature", "v").agg(F.sum((F.col("y") == 1).cast("long")).alias("pos"), F.sum((F.col("y") == 0).cast("long")).alias("neg"))
    ranked = metrics.running(per, ["feature"], ["v"], "neg").withColumn("won", F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    edge = lambda f, c: f(F.when(F.col(c) > 0, F.col("v")))
    each = ranked.groupBy("feature").agg(F.sum("won").alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.count("*").alias("kinds"), edge(F.min, "pos").alias("pl"), edge(F.max, "pos").alias("ph"), edge(F.min, "neg").alias("nl"), edge(F.max, "neg").alias("nh"))
    auc = F.col("won") / (F.col("p") * F.col("n"))
    scored = each.where((F.col("p") >= least) & (F.col("n") >= least) & (F.col("kinds") > 1)).withColumn("auc", F.round(F.greatest(auc, 1 - auc), 6))
    best = scored.agg(F.max_by(F.struct("feature", "auc", (~((F.col("pl") > F.col("nh")) | (F.col("nl") > F.col("ph")))).alias("overlap")), F.struct("auc", (-F.element_at(F.create_map(*(x for i, f in enumerate(features) for x in (F.lit(f), F.lit(i)))), F.col("feature"))).alias("first"))).alias("b"))
    return best.select("b.*")


def unevaluated(rows: DataFrame) -> DataFrame:
    """(stage, n) of what was left undecided, each field and reason counted once."""
    return rows.dropDuplicates(["field", "reason"]).groupBy("stage").agg(F.count("*").alias("n"))
