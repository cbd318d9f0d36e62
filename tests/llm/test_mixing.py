import random

import numpy as np
import pytest

from ledgerlens.llm.mixing import Mixture, flight
from ledgerlens.llm.tokens import counter


def test_flight_keeps_sums_and_probabilities():
    rng = random.Random(3)
    tokens = np.array([rng.randint(1, 900) for _ in range(400)], float)
    hits, runs = np.zeros(400), 300
    for k in range(runs):
        p = flight(np.full(400, 0.3), tokens, random.Random(k))
        assert ((p > 0) & (p < 1)).sum() <= 2
        assert abs(p.sum() - 120) < 1e-6 and abs(p @ tokens - 0.3 * tokens.sum()) < 1e-3
        done = flight(np.full(400, 0.3), tokens, random.Random(k), land=True)
        assert set(np.unique(done)) <= {0.0, 1.0} and abs(done.sum() - 120) < 1 + 1e-6 and abs(done @ tokens - 0.3 * tokens.sum()) <= 2 * 900
        hits += done
    assert abs(hits.mean() / runs - 0.3) < 0.005 and abs(hits / runs - 0.3).max() < 0.12


@pytest.mark.parametrize("group_rows", [8192, 40])
def test_shares(spark, group_rows):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    targets = spark.read.parquet("/root/testdata/sf0.01/source_targets.parquet")
    mix = Mixture(docs, targets, group_rows=group_rows)
    size, records = {}, {}
    longest = 0
    for r in docs.collect():
        n = counter()(r.text) if r.text else 0
        longest = max(longest, n)
        size[r.source] = size.get(r.source, 0) + n
        records[r.source] = records.get(r.source, 0) + 1
    t = {r.source: r for r in targets.collect()}
    total = sum(size.get(s, 0) for s in t)
    rep = {r.source: r for r in mix.report().collect()}
    assert set(rep) == set(t)
    for s, r in rep.items():
        want = t[s].target_share * total
        assert r.short == (size.get(s, 0) * t[s].max_repeats < want)
        assert r["size"] == size.get(s, 0) and r.records == records.get(s, 0) and r.most <= t[s].max_repeats
        if r.short:
            assert r.mixed == size.get(s, 0) * t[s].max_repeats
        else:
            assert abs(r.mixed - want) <= 2 * longest
    used = mix.records.collect()
    assert len({r.doc_id for r in used}) == len(used) and sum(r.copies * r.tokens for r in used) == sum(r.mixed for r in rep.values())


def test_nulls_empty_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1), (1, "a b", "x", 1), (2, None, "x", 1), (3, "", "y", 1), (4, "q", None, 1), (None, "c d e", "z", 1)], "doc_id long, text string, source string, tokens int")
    targets = spark.createDataFrame([("x", 0.5, 2), ("y", 0.25, 3), ("z", 0.25, None), ("gone", 0.0, 1), (None, 1.0, 1), ("x", 0.1, 1)], "source string, target_share double, max_repeats int")
    mix = Mixture(docs, targets)
    rep = {r.source: r for r in mix.report().collect()}
    assert set(rep) == {"x", "y", "z", "gone"} and rep["y"].short and rep["z"].short and not rep["gone"].short and not rep["x"].short
    nothing = Mixture(docs.limit(0), targets)
    assert nothing.records.count() == 0 and {r.source: r.short for r in nothing.report().collect()} == {"x": False, "y": False, "z": False, "gone": False}
