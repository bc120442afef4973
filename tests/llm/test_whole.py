"""Inputs on which an operator once did less than the whole job."""

import collections
import datetime
import math
import random
import struct
import zlib

import numpy as np
import pytest

from manifestry.llm import components, html_crf, langid, media, mixing, ppm, pseudonym, simhash
from manifestry.llm.common import read


@pytest.fixture
def docs_small(spark):
    return read(spark, "/root/testdata/sf0.001", "documents")


# -- 6 ----------------------------------------------------------------------------------------------------

@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<p>one</p><svg-icon></svg-icon><p>two</p><p>three</p>", ["one", "two", "three"]),
        ("<p>one</p><template-card>two</template-card><p>three</p>", ["one", "two", "three"]),
        ('<p>one</p><svg width="1" d="a=b/>" /><p>two</p>', ["one", "two"]),
        ("<p>one</p><SVG/><p>two</p><svg><p>not</p></svg><p>three</p>", ["one", "two", "three"]),
        ("<p>one<!-->two<!--->three</p><!-- > not --><p>four</p><!-- not -->", ["onetwothree", "four"]),
        # these are not closed by />: the slash is the value's, and only svg closes itself
        ("<p>one</p><svg width=5/><p>not</p></svg><p>two</p>", ["one", "two"]),
        ("<p>one</p><script/><p>not</p></script><p>two</p>", ["one", "two"]),
    ],
)
def test_op6_text_after_what_has_no_closing_tag(page, wanted):
    assert [b.text for b in html_crf.blocks(page)] == wanted


# -- 10 ---------------------------------------------------------------------------------------------------

def test_op10_many_buckets_and_copies_give_the_same(spark, monkeypatch):
    """Nearly all words share their first four bytes; with bounds of a few keys for a bucket and a group, the scores are the same."""
    rng = random.Random(7)
    word = lambda: "http" + "".join(rng.choice("abcdefgh/.") for _ in range(rng.randint(3, 12)))
    rows = [(i, " ".join(word() if rng.random() < 0.9 else "and" for _ in range(40)), "ab"[i % 2]) for i in range(300)] + [(300, None, "a"), (301, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    before = {r.doc_id: r for r in ppm.score_documents(docs).collect()}
    monkeypatch.setattr(ppm, "BUCKET_KEYS", 2_000)
    monkeypatch.setattr(ppm, "GROUP_KEYS", 1_000)
    after = {r.doc_id: r for r in ppm.score_documents(docs).collect()}
    assert before.keys() == after.keys() and len(after) == 302
    for i, r in before.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (after[i].held_out, after[i].n_tokens, after[i].n_known, after[i].train_tokens)
        assert math.isclose(r.score, after[i].score, rel_tol=1e-6) and math.isclose(r.base_score, after[i].base_score, rel_tol=1e-9)


def test_op10_score_sees_the_order_of_words(spark, docs_small):
    text = next(r.text for r in docs_small.collect() if len(r.text or "") > 2000)
    mixed = " ".join(sorted(text.split()))
    rows = [(10**6, text, "en"), (10**6 + 1, mixed, "en")]
    both = docs_small.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    got = {r.doc_id: r for r in ppm.score_documents(both).where("doc_id >= 1000000").collect()}
    assert got[10**6].n_tokens == got[10**6 + 1].n_tokens and math.isclose(got[10**6].base_score, got[10**6 + 1].base_score, rel_tol=1e-9)
    assert abs(got[10**6].score - got[10**6 + 1].score) > 1


def test_op10_pieces_of_a_long_text(monkeypatch):
    texts = [b"", b" \n", b"One two  three\tfour", b"ab " * 50 + b"x" * 300 + b"  end ", b" " * 200 + b"late"]
    whole = {t: list(ppm.pieces_of(t)) for t in texts}
    assert all(len(p) == 1 and p[0][0] == ppm.START for p in whole.values())
    monkeypatch.setattr(ppm, "PIECE_BYTES", 20)
    for t in texts:
        cut = list(ppm.pieces_of(t))
        assert b"".join(s for _, s in cut) == whole[t][0][1] and all(s for _, s in cut)
        assert ppm.grams_of(cut).tolist() == ppm.grams_of(whole[t]).tolist()
        assert [w for _, s in cut for w in ppm.words_of(s)] == ppm.words_of(whole[t][0][1])


# -- 2 ----------------------------------------------------------------------------------------------------

def test_op2_rows_that_share_an_id_keep_their_texts(spark):
    a, b = "one text with quite some words in it for a start", "another text that nothing else in the table holds at all"
    rows = [(5, a, 1), (5, b, 1), (9, a, 1), (7, b + " x", 1), (5, b, 1), (None, a, 1)]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string, row int").repartition(2))
    assert kept.columns == ["doc_id", "text", "row"]
    got = sorted(((r.doc_id is None, r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got.count((False, 5, a)) == 1 and got.count((False, 5, b)) == 1 and (False, 9, a) not in got and (True, None, a) in got
    assert simhash.deduplicate(kept.where("false")).count() == 0


def test_components_say_so_if_they_are_cut_short(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a bigint, b bigint")
    with pytest.raises(RuntimeError):
        components.connected_components(chain, max_rounds=2)
    assert {r.component for r in components.connected_components(chain).collect()} == {0}


def test_components_of_a_hub(spark, monkeypatch):
    """A hub is joined where its links lie; the answer is the same."""
    monkeypatch.setattr(components, "HUBS", 1)
    real = components._with_least
    monkeypatch.setattr(components, "_with_least", lambda edges, least, links: real(edges, least, 0))
    star = [(1000, i) for i in range(1, 60)] + [(2000, 2001), (2001, 2002)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(star, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 60)}, 1000: 1, 2000: 2000, 2001: 2000, 2002: 2000}


# -- 4 ----------------------------------------------------------------------------------------------------

def box(kind, *content):
    body = b"".join(content)
    return struct.pack(">I", len(body) + 8) + kind + body


def u32(*values):
    return struct.pack(f">{len(values)}I", *values)


def movie(*more, track=7):
    """A file put together here, not by the writer under test: five samples in three chunks of two, two and one."""
    data = bytes(range(1, 101))
    stbl = lambda first: box(
        b"stbl", box(b"stsd", u32(0, 1), box(b"avc1", bytes(8))), box(b"stsc", u32(0, 2, 1, 2, 1, 3, 1, 1)), box(b"stsz", u32(0, 0, 5, 10, 20, 5, 15, 50)),
        box(b"stco", u32(0, 3, first + 60, first, first + 50)), box(b"stss", u32(0, 2, 1, 4)),
    )
    moov = lambda first: box(b"moov", box(b"trak", box(b"tkhd", u32(0, 0, 0, track), bytes(68)), box(b"mdia", box(b"mdhd", u32(0, 0, 0, 600, 3000, 0)), box(b"minf", stbl(first)))), *more)
    head = box(b"ftyp", b"isom", u32(0))
    first = len(head) + len(moov(0)) + 8
    return head + moov(first) + box(b"mdat", data), first


def test_op4_a_file_by_hand():
    file, first = movie()
    (t,) = media.tracks(file)
    assert (t.codec, t.timescale, t.duration) == ("avc1", 600, 3000)
    assert [(o - first, s) for o, s in zip(t.offsets.tolist(), t.sizes.tolist())] == [(60, 10), (70, 20), (0, 5), (5, 15), (50, 50)]
    assert [(o - first, s) for o, s in media.keyframe_ranges(t)] == [(60, 10), (5, 15)]
    assert media.payload_of(file, t)[:10] == bytes(range(61, 71))


def test_op4_fragments_by_hand():
    start, first = movie(box(b"mvex", box(b"trex", u32(0, 7, 1, 0, 4, 0x10000))))
    moof = lambda at: box(b"moof", box(b"mfhd", u32(0, 1)), box(b"traf", box(b"tfhd", u32(0x20000, 7)), box(b"trun", u32(0x000205, 2, at, 0, 6, 3))), box(b"traf", box(b"tfhd", u32(0x20000, 8)), box(b"trun", u32(0x000201, 1, at, 9))))
    file = start + moof(len(moof(0)) + 8) + box(b"mdat", b"keyframeX")
    (t,) = media.tracks(file)
    assert t.sizes.tolist()[5:] == [6, 3] and t.keys.tolist() == [0, 3, 5]
    assert [file[o : o + s] for o, s in zip(t.offsets.tolist()[5:], t.sizes.tolist()[5:])] == [b"keyfra", b"meX"]


def test_op4_damaged_files(spark):
    rng = random.Random(4)
    whole = media.wrap(media.pad(bytes(rng.randrange(256) for _ in range(9000))))
    hand, _ = movie(box(b"mvex", box(b"trex", u32(0, 7, 1, 0, 4, 0))))
    for good, head in ((whole, len(whole) - 9000), (hand, len(hand) - 100)):
        for _ in range(1500):
            bad = bytearray(good)
            bad[rng.randrange(head)] = rng.randrange(256)
            for t in media.tracks(bytes(bad)):
                assert len(media.payload_of(bytes(bad), t)) <= len(bad) and all(0 <= a and a + s <= len(bad) for a, s in media.keyframe_ranges(t))
    deep = b""
    for _ in range(3000):
        deep = media.box(b"moov", deep)
    assert media.tracks(deep) == []
    rows = media.describe(spark.createDataFrame([(1, 3, deep[:20_000]), (1, 3, deep[:20_000]), (2, 0, None), (None, 5, b"no media")], "doc_id bigint, n_bytes bigint, media binary")).collect()
    assert len(rows) == 4 and all(r.codec == "" and r.keyframes == [] and r.payload_bytes == 0 for r in rows)


# -- 7 ----------------------------------------------------------------------------------------------------

def test_op7_nearest_sum_of_all():
    rng = random.Random(11)
    for _ in range(400):
        lengths = np.array(sorted(rng.sample(range(0, 30), rng.randint(1, 6))))
        counts = np.array([rng.randint(1, 4) for _ in lengths])
        budget = rng.randint(0, int((lengths * counts).sum()) + 3)
        sums = {0}
        for n, k in zip(lengths.tolist(), counts.tolist()):
            sums = {s + i * n for s in sums for i in range(k + 1)}
        take = mixing.choose_counts(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and int((lengths * take).sum()) == max(s for s in sums if s <= budget)


def test_op7_each_row_has_its_own_decision(spark):
    rows = [(None if i % 2 else i % 5, " ".join(["w"] * (1 + i % 7)), f"s{i % 3}", "x" * (i % 4)) for i in range(120)] + [(1, "w w w", "s1", "x")] * 9 + [(2, None, None, ""), (3, "", "s0", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, mixed_n string").repartition(3)
    plan, out = mixing.mix(docs).collect(), mixing.mixed(docs)
    assert out.columns == docs.columns and len(plan) == len(rows)
    words = lambda rs, size: {s: sum(size(r) for r in rs if r.source == s) for s in ("s0", "s1", "s2", None)}
    wanted = words(plan, lambda r: r.taken)
    assert words(out.collect(), lambda r: len((r.text or "").split())) == wanted
    for s, n in wanted.items():
        goal = next(r.target for r in plan if r.source == s)
        assert abs(n - goal) <= 1
    assert mixing.mixed(docs.where("false")).count() == 0


def test_op7_targets_of_many_sources(spark):
    """Every source a row of its own: places by code point, weights, and the limit of twice a source's size."""
    rng = random.Random(6)
    sizes = {f"host{i}.example" if i % 3 else chr(0x10000 + i) + "é": rng.choice([1, 1, 2, 50, 900]) for i in range(60)}
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(sizes.items())]
    got = {r.source: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)).collect()}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    budget, free, wanted = 1.5 * sum(sizes.values()), set(sizes), {}
    while free:
        level = budget / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 2 * sizes[s]}
        wanted |= {s: 2.0 * sizes[s] for s in full} if full else {s: weight[s] * level for s in free}
        budget, free = budget - sum(2 * sizes[s] for s in full), free - full if full else set()
    assert all(math.isclose(got[s].target, wanted[s], rel_tol=1e-9) and got[s].source_size == sizes[s] for s in sizes)


# -- 8 ----------------------------------------------------------------------------------------------------

def test_op8_dates_with_slashes_stay_apart(spark):
    day, values = datetime.date(1999, 12, 20), set()
    for i in range(800):
        d = day + datetime.timedelta(days=i)
        values |= {d.strftime(f) for f in ("%m/%d/%Y", "%d/%m/%Y", "%d.%m.%Y", "%Y-%m-%d")}
    values = sorted(values)
    rows = pseudonym.pseudonymize(spark.createDataFrame([(v,) for v in values], "text string"), key="k").collect()
    new = [r.text for r in rows]
    assert len(set(new)) == len(values) and sum(a == b for a, b in zip(sorted(values), new)) < 20


@pytest.mark.parametrize("key", ["k"])
def test_op8_forms_that_once_leaked(spark, key):
    cases = {
        "GB82 WEST 1234 5698 7654 32 IS ok": "GB82 WEST 1234 5698 7654 32", "to 用户名@example.com now": "用户名", "émilie.müller@x.org": "émilie", "at 2024-05-17T10:00:00Z": "2024-05-17",
        "fe80::1ff:fe23:4567:890a up": "fe80::1ff:fe23:4567:890a", "2001:0db8:85a3:0000:0000:8a2e:0370:7334": "2001:0db8", "pay 4111.1111.1111.1111": "4111.1111.1111.1111", "иван@mail.org": "иван",
    }
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(cases)], "i int, text string, __hits int, found_values int")
    out = pseudonym.pseudonymize(df, key=key, found="n")
    assert out.columns == [*df.columns, "n"]
    for r in out.collect():
        old, secret = list(cases.items())[r.i]
        assert secret not in r.text and r.n == 1 and len(r.text) == len(old) and (r["__hits"], r.found_values) == (1, 2), (old, r.text)
    left = ["666-12-3456", "000-12-3456", "123-00-4567", "901-12-3456", "std::abc 10:20:30", "13/13/2020", "DE00 3704 0044 0532 0130 00"]
    kept = pseudonym.pseudonymize(spark.createDataFrame([(t,) for t in left], "text string"), key=key).collect()
    assert [r.text for r in kept] == left


def test_op8_needs_a_key(spark):
    spark.conf.unset(pseudonym.KEY_SETTING)
    with pytest.raises(ValueError):
        pseudonym.pseudonymize(spark.createDataFrame([("x",)], "text string"))


# -- 9 ----------------------------------------------------------------------------------------------------

def test_op9_learns_languages_of_long_texts(spark):
    rng = random.Random(9)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(5))
    rows = [(i, " ".join(word("abcde") for _ in range(40)), "en", 1) for i in range(60)] + [(100 + i, " ".join(word("xyzäü") for _ in range(9000)), "de", 1) for i in range(12)] + [(200, "ддд жжж", "ru", 1), (201, "ддд", None, 1), (None, "жжж", "ru", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int").repartition(3)
    model = langid.fit(docs)
    assert model.languages == sorted({r[2] for r in rows if r[2] and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5})
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert all(got[r[0]] == r[2] for r in rows if r[2] in ("en", "de"))
    assert langid.fit(docs, max_total=5_000).languages == model.languages


def test_op9_probabilities_are_those_of_kneser_ney():
    """Every n-gram's probability against dictionaries; those of one context, with its back-off, sum to one or less."""
    words = collections.Counter({"abc": 3, "abd": 2, "ba": 1, "c": 4, "abab": 2})
    model = langid.fit_model(words)
    grams = [collections.Counter() for _ in range(langid.ORDER + 1)]
    for w, n in words.items():
        s = f" {w} "
        for order in range(1, langid.ORDER + 1):
            for i in range(max(order - 1, 1), len(s)):
                grams[order][s[i - order + 1 : i + 1]] += n
    left = [collections.defaultdict(set) for _ in range(langid.ORDER + 1)]
    for w in words:
        s = f" {w} "
        for order in range(1, langid.ORDER):
            for i in range(max(order - 1, 1), len(s)):
                left[order][s[i - order + 1 : i + 1]].add(s[i - order] if i >= order else None)

    def p(g):
        order = len(g)
        count = grams[order] if order == langid.ORDER else {k: len(v) for k, v in left[order].items()}
        same = {k: v for k, v in count.items() if k[:-1] == g[:-1]}
        total = sum(same.values())
        below = p(g[1:]) if order > 1 else 1e-4
        return max(count[g] - langid.DISCOUNT, 0) / total + langid.DISCOUNT * len(same) / total * below

    for order in range(1, langid.ORDER + 1):
        wanted = sorted(math.log(p(g)) for g in grams[order])
        assert np.allclose(sorted(model.grams[order - 1][1].tolist()), wanted)
