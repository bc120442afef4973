"""Fragments of several tracks, dates at both ends of the calendar, linked phone numbers, text ids, shared ids, wide windows."""

import calendar
import datetime
import hashlib
import itertools
import random
import struct
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from manifestry.llm import langid, media, mixing, pairwise, pseudonym, quality_rules
from test_whole import box, movie, u32

KEY = "a key of the tests"


# -- 4: by the standard, in boxes put together here -----------------------------------------------------------

def second_track(first):
    """A track of its own in the same file: three samples of 4 bits' sizes in one chunk."""
    stbl = box(b"stbl", box(b"stsd", u32(0, 1), box(b"mp4a", bytes(8))), box(b"stsc", u32(0, 1, 1, 3, 1)), box(b"stz2", u32(0, 4, 3), bytes([0x35, 0x70])), box(b"stco", u32(0, 1, first)))
    return box(b"trak", box(b"tkhd", u32(0, 0, 0, 8), bytes(68)), box(b"mdia", box(b"mdhd", u32(0, 0, 0, 1000, 30, 0)), box(b"minf", stbl)))


def trex(track, length, size, flags):
    return box(b"trex", u32(0, track, 1, length, size, flags))


def fragmented(tfhd_flags, *tfhd_more):
    """Two tracks, then a moof with a run of each: the first says where its data is, the second goes on behind it."""
    mvex = box(b"mvex", trex(7, 40, 4, 0x10000), trex(8, 11, 2, 0))
    _, first = movie(second_track(0), mvex)
    start, first = movie(second_track(first), mvex)
    runs = lambda at: box(
        b"moof", box(b"mfhd", u32(0, 1)),
        box(b"traf", box(b"tfhd", u32(tfhd_flags, 7, *tfhd_more)), box(b"trun", u32(0x000305, 2, at, 0, 100, 6, 101, 3))),
        box(b"traf", box(b"tfhd", u32(0, 8)), box(b"trun", u32(0x000000, 2))),
        box(b"traf", box(b"tfhd", u32(0x8, 7, 9)), box(b"trun", u32(0x000000, 1))),
    )
    return start + runs(len(runs(0)) + 8) + box(b"mdat", b"keyframeXabcdLAST"), first


@pytest.mark.parametrize("flags", [0, 0x20000])
def test_op4_runs_of_two_tracks_follow_each_other(flags):
    file, first = fragmented(flags)
    a, b = media.tracks(file)
    cut = lambda t, n: [file[o : o + s] for o, s in zip(t.offsets.tolist()[n:], t.sizes.tolist()[n:])]
    assert (a.codec, b.codec) == ("avc1", "mp4a") and b.sizes.tolist()[:3] == [3, 5, 7] and (b.offsets[:3] - first).tolist() == [0, 3, 8]
    assert cut(a, 5) == [b"keyfra", b"meX", b"LAST"] and cut(b, 3) == [b"ab", b"cd"]
    assert a.duration == 3000 + 100 + 101 + 9 and b.duration == 30 + 2 * 11
    assert a.keys.tolist() == [0, 3, 5] and b.keys.tolist() == [0, 1, 2, 3, 4]


def test_op4_a_base_of_its_own_and_damage_before(spark):
    file, _ = fragmented(0x1, 0, 5)  # 8 bytes: the data counts from byte 5 of the file
    a, b = media.tracks(file)
    assert file[file.index(b"moof") - 4 + a.offsets[5] - 5 :][:6] == b"keyfra" and b.offsets[3] == a.offsets[6] + 3
    good, _ = fragmented(0)
    bad = good.replace(box(b"tfhd", u32(0, 7)), box(b"tfhd", u32(8, 7)))  # it says that a length follows, which does not fit
    assert media.tracks(bad) == []  # where the others' data lies is not known either
    rows = media.describe(spark.createDataFrame([(1, 3, good), (2, 0, None)], "doc_id bigint, n_bytes bigint, media binary")).collect()
    assert [(t.codec, t.samples, t.duration, len(t.keyframes)) for t in rows[0].tracks] == [("avc1", 8, 3210, 3), ("mp4a", 5, 52, 5)] and rows[1].tracks == []


@pytest.mark.parametrize("bits", [4, 8, 16])
def test_op4_compact_sizes(bits):
    sizes = [1, 15, 0, 7, 9]
    packed = bytes([0x1F, 0x07, 0x90]) if bits == 4 else struct.pack(f">5{'B' if bits == 8 else 'H'}", *sizes)
    content = u32(0, bits, 5) + packed
    of = {b"stz2": media._Box(content, (0, len(content)))}
    assert media._sizes(content, of).tolist() == sizes


# -- 8: the same networks in plain Python ----------------------------------------------------------------------

def keyed(*parts):
    return int(hashlib.sha256(":".join([KEY, *map(str, parts)]).encode()).hexdigest()[:12], 16)


def network(a, b, m, n, *tweak):
    for i in range(8):
        if i % 2 == 0:
            a = (a + keyed(*tweak, i, b)) % m
        else:
            b = (b + keyed(*tweak, i, a)) % n
    return a, b


def permute(digits, tweak):
    out = ""
    for i, at in enumerate(range(0, len(digits), 24)):
        s = digits[at : at + 24]
        half = len(s) // 2
        a, b = network(int(s[:half] or 0), int(s[half:]), 10**half, 10 ** (len(s) - half), tweak, len(s), i)
        out += f"{a:0{half}d}"[:half] + f"{b:0{len(s) - half}d}"
    return out


def day_number(y, m, d):
    """Days from the first of year 0, which is a leap year."""
    before = 365 * y + (y + 3) // 4 - (y + 99) // 100 + (y + 399) // 400
    return before + sum(calendar.monthrange(2000 if y % 4 == 0 and (y % 100 or y % 400 == 0) else 2001, k)[1] for k in range(1, m)) + d - 1


def cycled(number, kind):
    while True:
        a, b = network(number % 146_097 // 5411, number % 146_097 % 5411, 27, 5411, kind)
        number = number - number % 146_097 + a * 5411 + b
        if number >= 366:
            return number


def changed(spark, values):
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id int, text string")
    return [r.text for r in pseudonym.pseudonymize(docs, key=KEY).orderBy("doc_id").collect()]


def test_op8_dates_stay_within_four_digits(spark):
    rng = random.Random(8)
    days = [datetime.date(9999, 1, 1), datetime.date(9999, 12, 31), datetime.date(1, 1, 1), datetime.date(400, 2, 29), datetime.date(2024, 5, 17)]
    days += [datetime.date.fromordinal(rng.choice([rng.randrange(1, 146_000), rng.randrange(3_500_000, 3_652_059), rng.randrange(1, 3_652_059)])) for _ in range(300)]
    iso = [f"{d.year:04d}-{d.month:02d}-{d.day:02d}" for d in days]
    got = changed(spark, iso)
    assert all(len(g) == 10 and datetime.date.fromisoformat(g) for g in got) and len(set(got)) == len(set(iso))
    assert [day_number(*map(int, g.split("-"))) for g in got] == [cycled(day_number(d.year, d.month, d.day), "date") for d in days]
    dots = changed(spark, [f"{d.day:02d}.{d.month:02d}.{d.year:04d}" for d in days])
    assert [x[6:] + "-" + x[3:5] + "-" + x[:2] for x in dots] == got
    slashes = changed(spark, [f"{d.month:02d}/{d.day:02d}/{d.year:04d}" for d in days] + ["12/31/9999", "31/12/9999"])
    assert all(len(x) == 10 for x in slashes)


def test_op8_numbers_against_plain_python(spark):
    phones = ["+1 415 555 0100", "+14155550100", "+1 (415) 555 0100", "(415) 555-0100", "415-555-0100", "+44 20 7946 0958", "+442079460958", "+82 10 1234 5678", "+358 40 123 4567"]
    got = changed(spark, phones)
    plain = lambda x: "".join(c for c in x if c.isdigit())
    for old, new in zip(phones, got):
        digits, code = plain(old), {"+1": "1", "+4": "44", "+8": "82", "+3": "358"}.get(old[:2], "")
        assert plain(new) == code + permute(digits[len(code) :], "phone" + (code or "1")) and [c for c in new if not c.isdigit()] == [c for c in old if not c.isdigit()]
    assert len({plain(x)[-10:] for x in got[:5]}) == 1 and plain(got[5]) == plain(got[6])
    cards = ["4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004"]
    for old, new in zip(cards, changed(spark, cards)):
        body = permute(plain(old)[:-1], "card")
        double = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(body)))
        assert plain(new) == body + str(-double % 10)


# -- 1 and 5: ids that are no numbers ------------------------------------------------------------------------

def test_op1_op5_text_ids_give_the_same_models(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    named = lambda t: t.withColumn("doc_id", F.concat(F.lit("doc "), "doc_id"))
    rows = quality_rules.quality_rules(named(docs), quality_rules.fit(named(docs), named(labels)))
    assert rows.count() == docs.count() and rows.schema["doc_id"].dataType.simpleString() == "string"
    scores = pairwise.score_documents(named(docs), pairwise.fit(named(docs), named(labels)))
    right = scores.join(named(labels), "doc_id").where("held_out AND quality IS NOT NULL").selectExpr("avg(CAST(predicted = quality AS INT)) AS share").first().share
    assert scores.count() == docs.count() and right > 0.9


# -- 9: rows that share an id -----------------------------------------------------------------------------------

@pytest.mark.parametrize("shared", [7, 32])
def test_op9_rows_that_share_an_id_are_sampled_one_by_one(spark, shared, monkeypatch):
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    de = [(shared, " ".join(word("aeinrstdhu") for _ in range(30)), "de") for _ in range(3000)]
    en = [(10_000 + i, " ".join(word("ovwkypgmbf") for _ in range(30)), "en") for i in range(500)]
    docs = spark.createDataFrame(de + en + [(2, "equal rows of a language", "xx")] * 3000, "doc_id bigint, text string, lang string")
    seen = []
    real = langid.fit_model
    monkeypatch.setattr(langid, "fit_model", lambda counts: seen.append(sum(counts.values())) or real(counts))
    found = langid.fit(docs)
    assert found.languages == ["de", "en", "xx"]
    per_text = 30 * 5
    assert seen[0] < 700 * per_text and seen[2] < 100  # some 400 texts of the first, one of the last


# -- 7: the steps that reach a sum --------------------------------------------------------------------------------

def test_op7_knapsack_against_every_sum():
    rng = random.Random(7)
    for _ in range(200):
        lengths = np.array(sorted(rng.sample(range(1, 40), rng.randint(1, 6))))
        counts = np.array([rng.randint(0, 4) for _ in lengths])
        rest = rng.randint(0, int((lengths * counts).sum()))
        sums = {sum(n * x for n, x in zip(c, lengths)) for c in itertools.product(*(range(n + 1) for n in counts))}
        take = mixing._knapsack(lengths, counts, rest)
        assert (take <= counts).all() and (take >= 0).all() and (take * lengths).sum() == max(s for s in sums if s <= rest)


def test_op7_a_wide_window_is_held_once():
    rng = np.random.default_rng(7)
    lengths = np.unique(rng.integers(500, 20_000, 601)) * 2  # an odd budget is never met, so all steps are taken
    counts = np.full(len(lengths), 8)
    tracemalloc.start()
    take = mixing._knapsack(lengths, counts, 2_000_001)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (take * lengths).sum() == 2_000_000 and peak < 150e6
