"""Rule catalogs and glossaries from files: read on the driver (they are small and versioned), checked as a whole."""

from __future__ import annotations

import json
import re
import unicodedata
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.catalog import Rule, problems
from ..operators.checks import REGISTRY

GLOSSARY = "version string, tier string, class string, key string, term string, country string"


def _load(path: str) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def read_rules(path: str) -> tuple[Rule, ...]:
    """Rules of a YAML or JSON file ({rules: [...]}); all that is wrong with them is said at once."""
    listed = _load(path)["rules"]
    lacking = [f"{r.get('id', '?')}: no {k}" for r in listed for k in ("id", "check", "severity", "weight") if k not in r]
    if lacking:
        raise ValueError("; ".join(lacking))
    rules = tuple(
        Rule(r["id"], r["check"], r["severity"], float(r["weight"]), tuple(r.get("fields") or ()), r.get("credit") or r.get("lc_field") or r.get("lc_flag") or "", r.get("unit") or "", tuple(r.get("keywords") or ()), tuple(r.get("unless") or r.get("unless_keywords") or ()))
        for r in listed
    )
    if wrong := problems(rules, set(REGISTRY)):
        raise ValueError("; ".join(wrong))
    return rules


def normalized(name: str | None) -> str:
    """The key of one name: the same as ``scalars.normalize_key`` gives in a query."""
    text = re.sub("[^A-Z0-9가-힣.]", " ", unicodedata.normalize("NFKC", name or "").upper())
    return re.sub(" +", " ", text).strip()


def read_glossary(spark: SparkSession, path: str, tier: str = "standard") -> DataFrame:
    """(version, tier, class, key, term, country): a row for each name and alias, keys as ``scalars.normalize_key`` makes them, blank ones dropped."""
    data = _load(path)
    rows = []
    for t in data["terms"]:
        keys = {key for k in [t["term"], *(t.get("aliases") or [])] if (key := normalized(k))}
        rows += [(str(data.get("version", "")), tier, t.get("class", ""), k, t["term"], t.get("country")) for k in sorted(keys)]
    return spark.createDataFrame(rows, GLOSSARY)
