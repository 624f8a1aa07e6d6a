"""Pairs of groups larger than any fixed postings cap."""

import itertools
import math
from collections import Counter

import pytest

from twinsift.operators import similarity
from twinsift.plans import registry

GROUP, OTHERS = 205, 640


def own(d, n=20):
    return [f"w{d}x{k}" for k in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """205 equal documents and two near copies of them among 640 that share nothing; the first copy shares no rarer shingle."""
    path = str(tmp_path_factory.mktemp("caps"))
    base = own("g")
    texts = [base] * GROUP + [base[:-1] + ["odd"], base[:-1] + ["even"]] + [own(d) for d in range(OTHERS)]
    spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, 1)], "doc_id bigint, quality int").write.parquet(f"{path}/labels.parquet")
    return path


PAIRS = (GROUP + 2) * (GROUP + 1) // 2


def test_large_group_keeps_its_jaccard_pairs(spark, folder):
    assert registry.queries()["shingle_jaccard_pairs"](spark, folder).count() == PAIRS
    assert registry.queries()["families_single"](spark, folder).groupBy("component").count().collect()[0]["count"] == GROUP + 2
    assert registry.queries()["candidate_diff_restricted"](spark, folder).count() == GROUP + 1


def test_large_group_keeps_its_tfidf_pairs(spark, folder):
    assert registry.queries()["tfidf_jaccard_pairs"](spark, folder).count() == PAIRS


def test_group_above_the_share_is_not_indexed(spark):
    units = spark.createDataFrame([(k, own("g") if k < 11 else own(k)) for k in range(40)], "id bigint, tokens array<string>")
    assert similarity.postings_cap(40) == 10
    assert similarity.tfidf_pairs(units, 0.7, cap=10).count() == similarity.jaccard_pairs(units, 0.7, cap=10).count() == 0
    assert similarity.tfidf_pairs(units, 0.7).count() == 55


def mixed(n):
    """Units of few words, so that many share some and their scores spread over the threshold."""
    return {k: [f"v{(k * 7 + p * p * (1 + k % 3)) % 11}" for p in range(8 + k % 5)] for k in range(n)}


@pytest.mark.parametrize(("threshold", "cap"), [(0.3, None), (0.5, 6), (0.7, 12)])
def test_tfidf_pairs_match_brute_force(spark, threshold, cap):
    units = mixed(60)
    sets = {k: {tuple(t[p : p + 3]) for p in range(len(t) - 2)} for k, t in units.items()}
    df = Counter(g for s in sets.values() for g in s)
    w = {g: math.log((1 + len(units)) / (1 + c)) + 1 for g, c in df.items()}
    want = set()
    for i, j in itertools.combinations(units, 2):
        n = (len(units[i]), len(units[j]))
        common = sets[i] & sets[j]
        sim = sum(w[g] for g in common) / sum(w[g] for g in sets[i] | sets[j])
        if sim >= threshold and any(cap is None or df[g] <= cap for g in common) and max(n) <= 2.5 * min(n) and 2 * min(n) >= threshold * sum(n):
            want.add((i, j))
    assert want
    frame = spark.createDataFrame(list(units.items()), "id bigint, tokens array<string>")
    assert {(r.i, r.j) for r in similarity.tfidf_pairs(frame, threshold, cap=cap).collect()} == want


def test_large_group_keeps_its_multiset_and_alignment_pairs(spark, folder):
    assert registry.queries()["multiset_jaccard_pairs"](spark, folder).count() == PAIRS
    assert registry.queries()["lcs_pairs"](spark, folder).count() == PAIRS


@pytest.mark.parametrize(("threshold", "cap"), [(0.3, None), (0.5, 50), (0.7, 30)])
def test_multiset_pairs_match_brute_force(spark, threshold, cap):
    units = mixed(60)
    df = Counter(x for t in units.values() for x in set(t))
    want, lcs = set(), set()
    for i, j in itertools.combinations(units, 2):
        n = (len(units[i]), len(units[j]))
        low = (Counter(units[i]) & Counter(units[j])).total()
        if max(n) > 2.5 * min(n) or not any(cap is None or df[x] <= cap for x in set(units[i]) & set(units[j])):
            continue
        if low / (sum(n) - low) >= threshold:
            want.add((i, j))
        if 2 * similarity.lcs_length(units[i], units[j]) / sum(n) >= threshold:
            lcs.add((i, j))
    assert want and lcs
    frame = spark.createDataFrame(list(units.items()), "id bigint, tokens array<string>")
    assert {(r.i, r.j) for r in similarity.multiset_pairs(frame, threshold, cap).collect()} == want
    assert {(r.i, r.j) for r in similarity.alignment_pairs(frame, threshold, cap).collect()} == lcs


@pytest.mark.parametrize("align", [False, True])
def test_bags_over_many_blocks_are_met_once(spark, monkeypatch, align):
    """Equal lengths over several blocks, and nothing is written for each candidate."""
    from twinsift.operators import bagjoin

    for name, least in (("BLOCK", 300), ("CHUNK", 200), ("AGAINST", 2)):
        monkeypatch.setattr(bagjoin, name, least)
    names, whole = [], bagjoin.stored
    monkeypatch.setattr(bagjoin, "stored", lambda df, name, **o: names.append(name) or whole(df, name, **o))
    units = {k: t if k % 3 else [*t[::-1], *t] for k, t in mixed(60).items()}
    want = {}
    for i, j in itertools.combinations(units, 2):
        a, b = units[i], units[j]
        low, n = (Counter(a) & Counter(b)).total(), len(a) + len(b)
        sim = 2.0 * similarity.lcs_length(a, b) / n if align else low / (n - low)
        if sim >= 0.6 and max(len(a), len(b)) <= 2.5 * min(len(a), len(b)):
            want[i, j] = sim
    frame = spark.createDataFrame(list(units.items()), "id bigint, tokens array<string>").repartition(3)
    got = (similarity.alignment_pairs if align else similarity.multiset_pairs)(frame, 0.6).collect()
    assert {(r.i, r.j): r.sim for r in got} == want and len(got) == len(want) > 20
    assert not {"pair-candidates", "pair-bound", "pair-texts"} & set(names)


def test_meetings_in_small_parts(monkeypatch):
    import numpy as np

    from twinsift.operators import bagjoin
    from twinsift.operators.setjoin import _packed

    monkeypatch.setattr(bagjoin, "MEETINGS", 3)
    monkeypatch.setattr(bagjoin, "COMPARED", 2)
    units = [sorted({(k * 7 + p * p * (1 + k % 3)) % 23 + 1 for p in range(8 + k % 5)}) for k in range(40)]
    size = np.array([len(x) for x in units])
    steps = np.concatenate([np.diff(x, prepend=0) for x in units])
    rows = {"t": [_packed(size)], "n": [_packed(size)], "items": [_packed(steps)], "w": [size.tolist()], "known": [None], "free": [None], "tokens": [None]}
    block = bagjoin.Block(rows, None, 0.6, None)
    got = [(int(i), int(j), int(c)) for part in bagjoin._met(block, block, 0.6, 0.6) for i, j, c in zip(*part, strict=True)]
    reach = lambda a, b, c: c / (len(a) + len(b) - c) >= 0.6
    want = {(i, j, len({*units[i]} & {*units[j]})) for i, j in itertools.combinations(range(40), 2)}
    want = {x for x in want if reach(units[x[0]], units[x[1]], x[2])}
    assert {x for x in got if reach(units[x[0]], units[x[1]], x[2])} == want and len(got) == len({*got}) and len(want) > 10


@pytest.mark.parametrize("name", ["multiset_jaccard_pairs", "tfidf_multiset_pairs"])
def test_pairs_that_share_only_frequent_tokens_are_kept(spark, tmp_path, name):
    """Every token stands in more than a quarter of the units; a cap dropped all pairs."""
    texts = [f"a b c d e f g h i j k l m n o {'p' if k % 2 else 'q'}" for k in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.queries()[name](spark, str(tmp_path)).count() == 40 * 39 // 2
