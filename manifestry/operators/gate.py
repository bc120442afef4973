"""What a model may say: only about vectors of its own schema, only a range where too much is open; and which model says it.

The registry is a table of events that is only appended to, so its state is the latest of each model's events. A new
event names the event it follows: of two that follow the same one the second is refused, as its file is there already.
"""

from __future__ import annotations

import datetime
import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of fields left open above which only a range is said.
MOST_OPEN = 0.20
EVENT = "seq bigint, kind string, version string, schema_version string, fingerprint string, f1 double, roc_auc double, brier double, labels bigint, previous string, note string, at timestamp"


class Refused(ValueError):
    """A model that may not be activated, an event that came too late, or vectors of another schema."""


def version_name(schema_version: str, trained_on: datetime.date, fingerprint: str) -> str:
    """A model's name: the schema, the day and a salt that follows from both what it is and what it was trained on."""
    salt = hashlib.sha256(json.dumps({"feature_schema_version": schema_version, "fingerprint": fingerprint}, sort_keys=True).encode()).hexdigest()[:6]
    return f"{schema_version}-{trained_on:%Y%m%d}-{salt}"


def events(spark: SparkSession, path: str) -> DataFrame:
    """All events of the registry; none if there is none yet."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.createDataFrame([], EVENT)
    return spark.read.schema(EVENT).option("recursiveFileLookup", "true").parquet(path)


def models(log: DataFrame) -> DataFrame:
    """(version, schema_version, fingerprint, f1, roc_auc, brier, labels, active, rolled_back_from, note): the state of each model.

    The one of the last event that activates is the active one; ``rolled_back_from`` is what its last rollback replaced.
    """
    made = log.where("kind = 'registered'").select("version", "schema_version", "fingerprint", "f1", "roc_auc", "brier", "labels")
    last = log.where("kind IN ('activated', 'rolled_back')").agg(F.max_by("version", "seq").alias("active_version"))
    noted = log.groupBy("version").agg(F.max_by(F.when(F.col("kind") == "rolled_back", F.col("previous")), F.when(F.col("kind") == "rolled_back", F.col("seq"))).alias("rolled_back_from"), F.max_by("note", "seq").alias("note"))
    # one row of the last activation, beside each model
    return made.join(noted, "version", "left").join(F.broadcast(last), F.col("version") == F.col("active_version"), "left").withColumn("active", F.col("active_version").isNotNull()).drop("active_version")


def may_activate(new_f1: float | None, active_f1: float | None) -> bool:
    """The first model always; then one whose F1 is known and no lower than the active one's."""
    return active_f1 is None or (new_f1 is not None and new_f1 >= active_f1)


def _append(spark: SparkSession, path: str, after: int, **event) -> int:
    """Writes the event that follows event ``after``; refused if another one does already."""
    row = {"seq": after + 1, "at": event.pop("at")} | event
    frame = spark.createDataFrame([tuple(row.get(f.strip().split()[0]) for f in EVENT.split(","))], EVENT)
    try:
        frame.coalesce(1).write.mode("errorifexists").parquet(f"{path}/{after + 1:012d}")
    except Exception as late:
        if "PATH_ALREADY_EXISTS" in str(late) or "already exists" in str(late):
            raise Refused(f"event {after + 1} is there already: read the registry again") from late
        raise
    return after + 1


def _state(spark: SparkSession, path: str) -> tuple[int, dict, dict | None]:
    log = events(spark, path)
    seq = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("n")).first()["n"]
    known = {r["version"]: r.asDict() for r in models(log).collect()}  # a row for each model
    return seq, known, next((m for m in known.values() if m["active"]), None)


def register(spark: SparkSession, path: str, version: str, schema_version: str, fingerprint: str, at: datetime.datetime, f1=None, roc_auc=None, brier=None, labels=0, note=None, after: int | None = None) -> int:
    """Adds a model, which is not active yet; the number of its event."""
    seq, known, _ = _state(spark, path)
    if version in known:
        raise Refused(f"model {version} is registered")
    return _append(spark, path, seq if after is None else after, kind="registered", version=version, schema_version=schema_version, fingerprint=fingerprint, at=at, f1=f1, roc_auc=roc_auc, brier=brier, labels=labels, note=note)


def activate(spark: SparkSession, path: str, version: str, at: datetime.datetime, after: int | None = None) -> int:
    """Makes a registered model the active one, unless it is worse than the one that is."""
    seq, known, active = _state(spark, path)
    if version not in known:
        raise Refused(f"model {version} is not registered")
    if active and not may_activate(known[version]["f1"], active["f1"]):
        raise Refused(f"F1 of {version} is {known[version]['f1']}, of the active {active['version']} {active['f1']}")
    return _append(spark, path, seq if after is None else after, kind="activated", version=version, previous=active and active["version"], at=at)


def roll_back(spark: SparkSession, path: str, version: str, reason: str, at: datetime.datetime, after: int | None = None) -> int:
    """Makes an earlier model the active one again, whatever its F1, and notes which one it replaces and why."""
    seq, known, active = _state(spark, path)
    if version not in known:
        raise Refused(f"model {version} is not registered")
    return _append(spark, path, seq if after is None else after, kind="rolled_back", version=version, previous=active and active["version"], note=reason, at=at)


def same_schema(vectors: DataFrame, model: dict) -> DataFrame:
    """The vectors, if they are all of the model's schema; otherwise an error that names another one. One look at their fingerprints."""
    other = vectors.where(~F.col("fingerprint").eqNullSafe(F.lit(model["fingerprint"]))).select("fingerprint").limit(1).collect()
    if other:
        raise Refused(f"model {model['version']} has schema {model['fingerprint']}, a vector has {other[0]['fingerprint']}")
    return vectors


def gated(rows: DataFrame, probability: Column) -> DataFrame:
    """shipment_id, probability, open_fields, range_only and credit_absent: above MOST_OPEN of the checked fields missing or without
    evidence only a range may be said.  ``rows``: missing_fields, no_evidence_fields (arrays), checked_fields and credit."""
    checked = F.when(F.coalesce("checked_fields", F.lit(0)) > 0, F.col("checked_fields")).otherwise(1)
    left = F.size("missing_fields") + F.size("no_evidence_fields")
    return rows.select("shipment_id", probability.alias("probability"), left.cast("long").alias("open_fields"), (left / checked > MOST_OPEN).alias("range_only"), F.col("credit").isNull().alias("credit_absent"))


def settled(old: DataFrame, new: DataFrame, key: str, *may: str) -> DataFrame:
    """(key, change): what writing ``new`` over ``old`` would do: ``added``, ``kept`` (nothing but the columns ``may`` differs) or
    ``refused``, with the names of the ``columns`` that differ.  A report that is there never changes."""
    fixed = [c for c in old.columns if c != key and c not in may]
    differ = F.array_compact(F.array(*(F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in fixed)))
    met = new.alias("n").join(old.alias("o").withColumn("there", F.lit(True)), key, "left")
    change = F.when(F.col("there").isNull(), "added").when(F.size("columns") > 0, "refused").otherwise("kept")
    return met.withColumn("columns", F.when(F.col("there"), differ).otherwise(F.array().cast("array<string>"))).select(key, change.alias("change"), "columns")


def write_reports(spark: SparkSession, path: str, new: DataFrame, key: str, *may: str) -> None:
    """Adds the new reports to those of the path; a changed one is refused and named, and then nothing is written.

    Reports that are there already, in all but the columns ``may``, are not written again.
    """
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        new.write.mode("errorifexists").parquet(path)
        return
    changes = settled(spark.read.parquet(path), new, key, *may)
    bad = changes.where("change = 'refused'").orderBy(key).limit(10).collect()
    if bad:
        raise Refused("reports never change: " + "; ".join(f"{r[key]} ({', '.join(r['columns'])})" for r in bad))
    new.join(changes.where("change = 'added'").select(key), key, "left_semi").write.mode("append").parquet(path)
