"""Inputs on which an operator once had more in one group than it needs."""

import random
from collections import Counter

from manifestry.operators import terms


def test_span_overlap_cuts_a_large_group_where_spans_do_not_touch(spark, monkeypatch):
    monkeypatch.setattr(terms, "MOST_SPANS", 16)
    rng = random.Random(2)
    spans = [(g, a, a + rng.randint(-1, 6)) for g in (1, None) for a in (rng.randrange(3000) for _ in range(500))] * 3
    frame = spark.createDataFrame(spans, "group bigint, start bigint, end bigint").repartition(3)
    cut = terms.runs(frame).collect()
    assert {(r.group, r.start, r.end) for r in cut} == {x for x in spans if x[1] < x[2]} and len(cut) == len(set(cut))
    assert max(Counter((r.group, r.run) for r in cut).values()) < 48
    for r in cut:
        assert all(r.end <= o.start or r.start >= o.end for o in cut if o.group == r.group and o.run != r.run)
    wanted = []
    for g in (1, None):
        taken = []
        for a, b in sorted({(a, b) for k, a, b in spans if k == g and a < b}, key=lambda x: (x[0] - x[1], x)):
            if all(b <= c or a >= d for c, d in taken):
                taken.append((a, b))
        wanted += [(g, a, b) for a, b in taken]
    assert Counter(map(tuple, terms.resolve_overlaps(frame).collect())) == Counter(wanted)
