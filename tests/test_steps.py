"""The steps that the rules share: what they mean on odd texts, and that a row is not rewritten or taken apart for them."""

import re

from manifestry.functions import scalars as s
from manifestry.operators import features, outcomes, verdict
from manifestry.plans import catalog, rule_queries
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "\t\n", "x", " x", "x\x0b", "\x01a", "é", " é ", "BUSAN, CO", "CO BUSANCO LTD", "pusan busan", "1BUSAN2", "12 A1 PKG PKGS2 STEEL 7", "AND machine, PARTS", "INCHON-LTD.", "LTD, PUSAN"]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_projection_for_common_expressions(spark):
    assert "_common_expr" not in plan(rule_queries.view(spark, DATA))
    assert "_common_expr" not in plan(features.rule_pivot(verdict.judged(rule_queries.view(spark, DATA))))


def test_counted_in_the_row(spark):
    for name in ("status_pivot", "check_groups", "merged_verdict"):
        text = plan(catalog.queries()[name](spark, DATA))
        assert "explode(" not in text and "Union" not in text, name
    assert "exists(" not in plan(outcomes.fired(verdict.judged(rule_queries.view(spark, DATA))))


def test_texts_and_tokens(spark):
    pairs = [(i, a, b) for i, a in enumerate(TEXTS) for b in TEXTS]
    rows = spark.createDataFrame(pairs, "i int, a string, b string").select(
        "a", "b", s.present(F.col("a")).alias("present"), s.significant_tokens(F.col("a")).alias("names"), s.goods_tokens(F.col("a")).alias("goods"), s.vague_goods(F.col("a")).alias("vague"), s.places_match(F.col("a"), F.col("b")).alias("match")
    )
    once = lambda found, without: list(dict.fromkeys(t for t in found if t not in without))
    names = lambda t: once(re.findall("[A-Z]+", t.upper()), s.LEGAL_SUFFIXES)
    for r in rows.collect():
        if r.a is None:
            assert (r.present, r.names, r.goods, r.vague) == (None,) * 4
            continue
        goods = once((t for t in re.findall("[A-Z0-9]{2,}", r.a.upper()) if not t.isdigit()), s.GOODS_STOPWORDS)
        assert (r.present, r.names, r.goods, r.vague) == (r.a.strip(" \t\n\r\f\x0b") or None, names(r.a), goods, not set(goods) - set(s.GENERIC_GOODS)), r.a
        if r.b is not None:
            wanted = names(r.b.split(",")[0]) or names(r.b)
            told = set(names(r.a)) | {n for group in s.PORT_SYNONYMS if set(group) & set(names(r.a)) for n in group}
            assert r.match == (len(told & set(wanted)) >= s.MATCH_SHARE * len(wanted)), (r.a, r.b)
