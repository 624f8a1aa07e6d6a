import random

import numpy as np

from twinsift.operators import similarity, store


def _runs(t, k=3):
    return {tuple(t[a : a + k]) for a in range(max(1, len(t) - k + 1))} if t else set()


def test_pairs_over_many_chunks_copies_and_short_units(spark, monkeypatch):
    from twinsift.operators import setjoin

    monkeypatch.setattr(setjoin, "SHARD", 64)
    rng = random.Random(5)
    base = [[rng.choice("abcdefgh") + str(rng.randrange(4)) for _ in range(rng.randrange(0, 30))] for _ in range(25)]
    texts = base + [list(b) for b in base[:8]] + [[*b[:-1], "new"] for b in base if b]
    units = spark.createDataFrame([(f"k{n:02d}", t) for n, t in enumerate(texts)], "id string, tokens array<string>").repartition(5)
    want = {}
    for i, a in enumerate(texts):
        for j in range(i + 1, len(texts)):
            b = texts[j]
            x, y = _runs(a), _runs(b)
            if x & y and max(len(a), len(b)) <= 2.5 * min(len(a), len(b)) and 2 * min(len(a), len(b)) >= 0.5 * (len(a) + len(b)) and len(x & y) / len(x | y) >= 0.5:
                want[f"k{i:02d}", f"k{j:02d}"] = (len(x & y), len(x), len(y))
    got = similarity.jaccard_pairs(units, 0.5).collect()
    assert {(r.i, r.j): (r.inter, r.n1, r.n2) for r in got} == want and len(got) == len(want) > 20


def test_units_that_no_pair_can_hold_are_not_stored(spark, monkeypatch):
    """They were shuffled and stored with all of their items before."""
    sizes = {}
    whole = store.stored

    def counted(df, name, **options):
        out = whole(df, name, **options)
        if "by" not in options:
            sizes[name] = out.count()
        return out

    for module in ("twinsift.operators.similarity", "twinsift.operators.setjoin"):
        monkeypatch.setattr(f"{module}.stored", counted)
    rows = [(n, [f"w{n}_{k}" for k in range(40)] + ["x", "y", "z"]) for n in range(50)] + [(n, [f"c{k}" for k in range(40)]) for n in (50, 51)]
    found = similarity.jaccard_pairs(spark.createDataFrame(rows, "id int, tokens array<string>"), 0.7).collect()
    assert [(r.i, r.j, r.sim) for r in found] == [(50, 51, 1.0)]
    assert sizes["pair-sets"] == 2 and sizes["pair-candidates"] == 0


def test_packed_numbers_come_back():
    from twinsift.operators import setjoin

    for a in (np.zeros(0, np.uint64), np.array([1, 7, 2**64 - 1], np.uint64), np.array([3, 300, 2], np.uint16)):
        assert (setjoin._unpacked(setjoin._packed(a)) == a).all() and (setjoin._unpacked(setjoin._packed(a, steps=True), steps=True) == a).all()


def test_greedy_linkage_of_a_large_family_takes_seconds():
    import time

    from twinsift.operators import families

    rng = random.Random(3)
    edges = [(a, b, rng.uniform(0.55, 1)) for a in range(500) for b in range(a + 1, 500)]
    for linkage in ("complete", "quasi_complete", "average", "medoid"):
        began = time.process_time()
        found = families.greedy_clusters(edges, linkage, 0.6, 0.05 if linkage == "quasi_complete" else 0.0)
        assert time.process_time() - began < 8, linkage  # every pair of members was looked at for every edge
        assert len(found) == 500 and all(found[c] == c for c in found.values())
    tied = [(0, 1, 0.9), (0, 2, 0.55), (1, 2, 0.65)]
    assert set(families.greedy_clusters(tied, "average", 0.6).values()) == {0}
