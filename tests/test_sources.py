"""Sources, sinks and streams on files written by the test."""

import json

import pytest

from manifestry.operators import layout
from manifestry.sources import catalogs, labels, mail, mt700, tables
from manifestry.streaming import verify


def test_label_files(spark, tmp_path):
    page = {"Images": {"identifier": "p1", "width": 1654, "height": 2340, "form_type": "bl"}, "bbox": [{"data": "HG1", "x": [900, 1000], "y": [400, 420]}, {"data": " ", "x": [1, 2], "y": [1, 2]}, {"data": "one", "x": [1], "y": [1]}]}
    (tmp_path / "a.json").write_text(json.dumps(page))
    (tmp_path / "b.json").write_text("not json")
    tokens = labels.read(spark, str(tmp_path))
    assert [(r.text, r.x_min, r.y_max) for r in tokens.collect()] == [("HG1", 900, 420)]
    assert {(r.region, r.text) for r in layout.region_texts(tokens).collect()} == {("bl_no", "HG1")}


def test_mail(spark, tmp_path):
    (tmp_path / "m.eml").write_bytes(b"Subject: S\nContent-Type: text/plain\n\nVessel: MSC BIANCA\njust text\n\nEmpty:\n")
    row = mail.read(spark, str(tmp_path)).first()
    assert row.attachment is None and [(x.label, x.value) for x in row.lines] == [("Vessel", "MSC BIANCA"), (None, "just text"), (None, "Empty:")]


def test_messages(spark):
    text = "{1:X}{4:\n:20:LC1\n:31D:261231SEOUL\n:32B:USD 123,456.78\n:39A:10/05\n:43P:NOT ALLOWED\n:44C:260631\n:44E:BUSAN\n:44E:OTHER\n:45A:+A\n+B\n-}"
    r = mt700.parse(spark.createDataFrame([(text,), ("nothing",), (None,)], "message string")).collect()
    assert (r[0].lc_no, str(r[0].expiry_date), r[0].amount, r[0].tolerance_pct, r[0].partial_shipment, r[0].latest_shipment_date, r[0].port_of_loading, r[0].description_of_goods) == ("LC1", "2026-12-31", 123456.78, 5.0, "PROHIBITED", None, "BUSAN", "A B")
    assert r[1].lc_no is None and r[2].lc_no is None


def test_cache_and_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "3", 1)], "key string, value string, version bigint")
    tables.append_cache(rows, str(tmp_path / "c"))
    cache = tables.read_cache(spark, str(tmp_path / "c"))
    assert {(r.key, r.value) for r in cache.collect()} == {("a", "2"), ("b", "3")}
    assert [r.key for r in tables.missing(spark.createDataFrame([("a",), ("z",)], "key string"), cache).collect()] == ["z"]
    tables.write_parquet(rows, str(tmp_path / "t"), by="key")
    assert tables.read_parquet(spark, str(tmp_path / "t")).where("key = 'a'").count() == 2


def test_catalog_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"rules": [{"id": "A", "check": "required", "severity": "info", "weight": 0.1, "fields": ["bl_no"]}]}))
    assert catalogs.read_rules(str(tmp_path / "r.json"))[0].fields == ("bl_no",)
    (tmp_path / "w.json").write_text(json.dumps({"rules": [{"id": "A", "check": "no such", "severity": "info", "weight": 3}]}))
    with pytest.raises(ValueError, match="unknown check.*weight"):
        catalogs.read_rules(str(tmp_path / "w.json"))
    (tmp_path / "g.json").write_text(json.dumps({"version": "1", "terms": [{"term": "Busan", "class": "port", "aliases": ["Pusan", " "]}]}))
    assert catalogs.read_glossary(spark, str(tmp_path / "g.json")).count() == 2


def test_streams(spark, tmp_path):
    from manifestry.plans.shipments import shipments, with_as_of

    d = "/root/testdata/sf0.001"
    with_as_of(shipments(spark, d)).where("shipment_id < 200").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    verify.verify_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(str(tmp_path / "in")).count()
    events = spark.read.parquet(f"{d}/events.parquet")
    events.select("event_id", "ts", "event_type", "value").write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "ev")).schema).parquet(str(tmp_path / "ev"))
    q = verify.event_windows(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("windows").agg({"n": "sum"}).first()[0] == events.count()
