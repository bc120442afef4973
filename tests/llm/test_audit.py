"""The interaction of filters against plain Python and SQL, on odd rows and on the smallest tables."""

import itertools
import re

import duckdb
import numpy as np
import pytest

from manifestry.llm import audit, queries
from manifestry.llm.common import read

DATA = "/root/testdata/sf0.001"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    by_part = {}
    for i, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {c for c, bad in (("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 2 * len(t)), ("D", re.search("[#$%&*|]", t))) if bad}
        if i is not None and any(o is not None and o < i and (x or "") == t for o, x, _ in docs):
            fails.add("E")
        by_part.setdefault(source or "", []).append((fails, i in good, i in toxic))
    out = []
    for part, rows in by_part.items():
        shapley, mine = dict.fromkeys("ABCDE", 0), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(rows)
            for step, c in enumerate(order, 1):
                gone = [r for r in left if c in r[0]]
                left = [r for r in left if c not in r[0]]
                shapley[c] += len(gone)
                failing = sum(c in r[0] for r in rows)
                mine.append([part, order, step, len(left), len(gone), failing - len(gone), sum(r[0] == {c} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)])
        out += [tuple(m) + (shapley[m[1][m[2] - 1]],) for m in mine]
    return sorted(out)


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


LONG = " ".join(f"w{i}" for i in range(300))
DOCS = [
    (0, None, "a"), (1, "", "a"), (2, LONG, "a"), (3, LONG, "b"), (3, LONG, "b"), (4, LONG + " #", "a"), (5, LONG.upper(), None), (6, " \t\n", ""), (7, "x " * 400, "b"), (8, "x " * 400, "c"),
    (None, LONG, "a"), (None, "x " * 400, "c"), (9, LONG, "a"), (9, "ONE", "a"), (10, LONG * 60, "b"), (11, "é ñ 日本  x" * 90, "d"), (2, LONG, "a"),
]
LABELS = [(2, 1, 0), (2, 0, 1), (3, 1, None), (4, None, 1), (8, 1, 1), (None, 1, 1), (99, 1, 1)]


@pytest.fixture
def odd(spark):
    docs = [(i, t, s, -1, "x", 7) for i, t, s in DOCS]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, source string, mask int, digest string, n int").repartition(3)
    return frame, spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")


def test_odd_rows_against_brute_force(odd):
    assert rows_of(audit.interactions(*odd)) == brute(DOCS, LABELS)


def test_few_parts_held_at_once(odd, monkeypatch):
    monkeypatch.setattr(audit, "MOST_PARTS", 2)
    monkeypatch.setattr(audit, "ROWS", 3)
    sums = {}
    for rows in (audit.masks(*odd).toArrow(),):
        for batch in audit._partials(iter(rows.to_batches())):
            assert batch.num_rows == len(audit.ORDERS)
            for r in batch.to_pylist():
                key = r["part"], r["filter_order"]
                sums[key] = sums.get(key, 0) + np.array([r[f"removed_{s}"] for s in range(1, 6)])
    assert {(p, o, s): int(sums[p, o][s - 1]) for p, o in sums for s in range(1, 6)} == {(x[0], x[1], x[2]): x[4] for x in brute(DOCS, LABELS)}


def test_no_rows_no_labels_and_text_ids(spark, odd):
    docs, labels = odd
    assert audit.interactions(docs.where("false"), labels).count() == 0
    assert rows_of(audit.interactions(docs, labels.where("false"))) == brute(DOCS, [])
    named = docs.selectExpr("lpad(doc_id, 3, '0') AS doc_id", "text", "source")
    assert rows_of(audit.interactions(named, labels.selectExpr("lpad(doc_id, 3, '0') AS doc_id", "quality", "toxic"))) == brute(DOCS, LABELS)


def test_table_is_the_first_failure():
    table = audit.first_failures()
    assert table.shape == (32, 120)
    for mask in range(32):
        for i, order in enumerate(audit.ORDERS):
            assert table[mask, i] == next((s for s, c in enumerate(order) if mask >> "ABCDE".index(c) & 1), 5)


def test_query_against_sql_and_brute_force(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rel = con.sql(queries.oracle_sql()["op13_filter_interactions"])
    assert rel.columns == COLUMNS
    got = rows_of(queries.op13_filter_interactions(spark, DATA))
    assert got == sorted(rel.fetchall())
    docs = [tuple(r) for r in read(spark, DATA, "documents").select("doc_id", "text", "source").collect()]
    assert got == brute(docs, [tuple(r) for r in read(spark, DATA, "labels").select("doc_id", "quality", "toxic").collect()])
