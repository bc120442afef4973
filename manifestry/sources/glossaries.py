"""Glossaries by version: written and read by partition, chosen by the day they take effect, checked as a whole.

A version is a partition of the table, so a look-up reads only the versions it needs. Which version holds on a day is the
one that took effect last up to then; the list of versions is small and its size is checked before it goes to every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import cascade

TERMS = (
    "version string, effective_date date, tier string, class string, term_id string, canonical string, form string, lang string, authority string, source string, aliases array<string>, country string, deprecated_by string"
)
# What every entry has to say, and the languages.
REQUIRED = ("term_id", "class", "canonical", "lang", "authority", "version", "effective_date")
LANGUAGES = ["ko", "en", "code"]
#: Classes that have no terms of their own.
WITHOUT_TERMS = cascade.FORMAT_ONLY
#: Versions of a glossary at most, as their list goes to every task.
MOST_VERSIONS = 10_000


def write(terms: DataFrame, path: str) -> None:
    """Adds a version; one that is there already is refused."""
    spark = terms.sparkSession
    for r in terms.select("version").distinct().limit(MOST_VERSIONS).collect():
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={r['version']}")
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            raise ValueError(f"version {r['version']} is there already")
    terms.write.mode("append").partitionBy("version").parquet(path)


def read(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The terms of all versions, or of one: then only its partition is read. Versions are texts, whatever they look like."""
    terms = spark.read.schema(TERMS).parquet(path)
    return terms if version is None else terms.where(F.col("version") == version)


def versions(terms: DataFrame) -> DataFrame:
    """(version, effective_date) of each version; names that begin with an underscore are samples and don't count."""
    return terms.where(~F.col("version").startswith("_")).groupBy("version").agg(F.max("effective_date").alias("effective_date"))


def _listed(of: DataFrame) -> list:
    rows = of.select("version", "effective_date").limit(MOST_VERSIONS + 1).collect()
    if len(rows) > MOST_VERSIONS:
        raise ValueError(f"more than {MOST_VERSIONS} versions")
    return sorted(rows, key=lambda r: (r["effective_date"] is not None, r["effective_date"], r["version"]))


def latest(of: DataFrame) -> str | None:
    """The version that took effect last; of the same day the last name; one without a day only if no other has one."""
    rows = _listed(of)
    return rows[-1]["version"] if rows else None


def held_on(day: Column, of: DataFrame) -> Column:
    """The version that held on the day; null before the first."""
    known = [r for r in _listed(of) if r["effective_date"] is not None]
    if not known:
        return F.lit(None).cast("string")
    listed = F.array(*(F.struct(F.lit(r["effective_date"]).cast("date").alias("day"), F.lit(r["version"]).alias("version")) for r in known))
    return F.array_max(F.filter(listed, lambda v: v["day"] <= day))["version"]


def names(terms: DataFrame) -> DataFrame:
    """(version, tier, class, key, name, is_alias, term_id, form, country): a row for each name of each term, blank keys left
    out. Ports take the form that documents use, null without one; other terms their own name."""
    form = F.when(F.col("class") == "port", F.col("form")).otherwise(F.col("canonical"))
    own = F.array(F.struct(F.col("canonical").alias("name"), F.lit(False).alias("is_alias")))
    other = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(a.alias("name"), F.lit(True).alias("is_alias")))
    each = terms.select("version", "tier", "class", "term_id", form.alias("form"), "country", F.explode(F.concat(own, other)).alias("n"))
    return each.select("version", "tier", "class", s.normalize_key(F.col("n.name")).alias("key"), "n.name", "n.is_alias", "term_id", "form", "country").where("key <> ''").distinct()


def looked_up(rows: DataFrame, day: str, terms: DataFrame) -> DataFrame:
    """rows (class, value, ...) with ``version`` (the one that held on the row's day) and ``hits``: term_id and form of the terms of
    that name in the most specific tier that has one, canonical names before others."""
    named = names(terms)
    place = F.array_position(F.array(*map(F.lit, cascade.terms.TIERS)), F.col("tier"))
    each = named.groupBy("version", "class", "key", "is_alias", "term_id").agg(F.min(F.struct(place.alias("rank"), "form")).alias("t"))
    hit = F.struct(F.col("is_alias"), F.col("t.rank").alias("rank"), "term_id", F.col("t.form").alias("form"))
    per = each.groupBy("version", "class", "key").agg(F.array_sort(F.collect_list(hit)).alias("all"))
    first = per.withColumn("hits", F.transform(F.filter("all", lambda h: (h["is_alias"] == F.get("all", F.lit(0))["is_alias"]) & (h["rank"] == F.get("all", F.lit(0))["rank"])), lambda h: F.struct(h["term_id"].alias("term_id"), h["form"].alias("form")))).drop("all")
    keyed = rows.withColumn("version", held_on(F.col(day), versions(terms))).withColumn("key", s.normalize_key(F.col("value")))
    return keyed.join(first, ["version", "class", "key"], "left").drop("key")


def problems(terms: DataFrame, whole: bool = True) -> DataFrame:
    """(version, term_id, problem, detail): all that is wrong with each version at once; ``whole`` asks for terms of every class that needs some.

    Entries are checked as they were given, then the terms against each other: ids and keys, that no name hides
    another term. Only ports may share a name, and then each has to have a country.
    """
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    told = lambda df, problem, detail: df.select("version", "term_id", F.lit(problem).alias("problem"), detail.cast("string").alias("detail"))
    lacking = terms.select("version", "term_id", F.explode(F.array_compact(F.array(*(F.when(~has(c), F.lit(c)) for c in REQUIRED)))).alias("c"))
    known = F.col("class").isin(list(cascade.ALLOWED))
    found = [
        told(lacking, "missing", F.col("c")), told(terms.where(has("lang") & ~F.col("lang").isin(LANGUAGES)), "language", F.col("lang")), told(terms.where((F.col("class") == "port") & ~has("country")), "no_country", F.lit(None)),
        told(terms.groupBy("version", "term_id").count().where("count > 1 AND term_id IS NOT NULL"), "repeated_id", F.lit(None)), told(terms.where(has("class") & ~known), "unknown_class", F.col("class")),
    ]
    ids = terms.select("version", F.col("term_id").alias("deprecated_by")).distinct()
    found.append(told(terms.where(known & has("deprecated_by")).join(ids, ["version", "deprecated_by"], "left_anti"), "unknown_successor", F.col("deprecated_by")))
    keyed = terms.where(known).select("version", "class", "term_id", "country", s.normalize_key(F.col("canonical")).alias("own"), F.posexplode(F.coalesce("aliases", F.array().cast("array<string>"))).alias("i", "alias")).withColumn("key", s.normalize_key(F.col("alias")))
    found.append(told(keyed.where("key = own"), "alias_is_the_name", F.col("alias")))
    again = keyed.groupBy("version", "term_id", "key").agg(F.count("*").alias("n"), F.min(F.struct("i", "alias")).alias("first")).where("n > 1")
    found.append(told(again, "repeated_alias", F.col("key")))
    every = terms.where(known).select("version", "class", "term_id", "country", s.normalize_key(F.col("canonical")).alias("key")).unionByName(keyed.select("version", "class", "term_id", "country", "key")).distinct()
    shared = every.groupBy("version", "class", "key").agg(F.countDistinct("term_id").alias("n"), F.min("term_id").alias("term_id"), F.count(F.when(~has("country"), 1)).alias("without")).where("n > 1")
    found.append(told(shared.where("class <> 'port'"), "shared_name", F.col("key")))
    found.append(told(shared.where("class = 'port' AND without > 0"), "shared_name_without_country", F.col("key")))
    if whole:
        wanted = [c for c in cascade.ALLOWED if c not in WITHOUT_TERMS]
        there = terms.where(F.col("version").isNotNull()).groupBy("version").agg(F.collect_set("class").alias("there"))
        empty = there.select("version", F.lit(None).cast("string").alias("term_id"), F.explode(F.array_except(F.array(*map(F.lit, wanted)), F.col("there"))).alias("c"))
        found.append(told(empty, "no_terms", F.col("c")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
