"""The pipeline's stages against plain Python, each on what its predecessor kept."""

import hashlib

import brute
import corpus_pipeline as cp
from manifestry.llm import bpe, mixing, queries
from manifestry.llm.common import read

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = read(spark, DATA, "documents")
    kept = {}
    for name, stage in cp.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "tokens":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = (docs.collect(), out.collect())
        docs = out
    before, after = kept["quality"]
    labels = {r.doc_id: r.quality for r in read(spark, DATA, "labels").collect()}
    ids = {r.doc_id for r in after}
    assert {r.doc_id for r in before} > ids and sum((labels[i] == 1) == (i in ids) for i in labels) > 0.9 * len(labels)
    before, after = kept["near_duplicates"]
    parts = brute.components({r.doc_id: brute.fingerprint(r.text) for r in before})
    assert sorted(r.doc_id for r in after) == sorted(set(parts.values()))
    before, after = kept["personal_data"]
    old = {r.doc_id: r.text for r in before}
    assert len(before) == len(after) and any(r.text != old[r.doc_id] for r in after) and all(len(r.text) == len(old[r.doc_id]) or "." in r.text for r in after)
    before, after = kept["mixing"]
    n = {r.doc_id: r.copies for r in mixing.mix(spark.read.parquet(str(tmp_path / "personal_data"))).collect()}
    assert sorted(r.doc_id for r in after) == sorted(i for i, k in n.items() for _ in range(k))
    before, after = kept["tokens"]
    enc = bpe.encoding(*queries.rank_file())
    wanted = sorted((r.doc_id, len(ids := enc.encode_ordinary(r.text)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) for r in before)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in after) == wanted
    assert cp.run(spark, DATA).count() == len(after)


def test_registered():
    names = "quality_rules simhash_dedup byte_bpe media_columns quality_classifier html_extraction source_mixing pii_pseudonyms language_id lm_scoring centroid_clusters minhash_fingerprints filter_interactions"
    assert sorted(queries.queries()) == sorted([*(f"op{i}_{n}" for i, n in enumerate(names.split(), 1)), "pipeline"])
