"""Methods, keys of other types, clashing columns, hot keys and brute-force models."""

import collections
import hashlib
import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsift.llm import decontaminate, exact_dedup, language_id, near_dup, ngram_lm, packing, phrase_dedup, queries, token_files, toxicity, url_filters
from twinsift.llm.common import FOLD, Words, join_hot
from twinsift.llm.tokens import default_tokenizer

ODD = ["letters", "raw", "keep", "sha", "stay", "id", "row", "n", "h", "words", "key", "_letters", "_keep", "_stay", "_text", "Text_"]


def odd_frame(spark, rows, key_type="string"):
    """Rows (key, text) with extra columns of names that operators might use inside."""
    base = spark.createDataFrame(rows, f"doc_id {key_type}, text string")
    return base.select("doc_id", *(F.lit(c).alias(c) for c in ODD[:8]), "text", *(F.lit(c).alias(c) for c in ODD[8:]), F.lit("en").alias("lang"))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    words = [f"word{k}" for k in range(200)]
    one, two = (" ".join(rng.choices(words, k=60)) for _ in range(2))
    return [("b", one), ("a", one + " tail"), ("c", two), ("d", one), (None, two), (None, None), ("e", ""), ("f", " "), ("c", two), ("g", "x" * 50_000 + " " + two)]


def test_words_are_runs_without_white_space():
    rng = random.Random(2)
    for _ in range(200):
        raw = [bytes(rng.choice(b"ab \t\n\x00\xc3") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 6))]
        w, plain = Words(raw), [t.split() for t in raw]
        assert w.sizes.tolist() == list(map(len, plain)) and w.line == b"".join(x + b" " for t in plain for x in t)
        names = collections.defaultdict(set)
        for x, h in zip((x for t in plain for x in t), w.hashes.tolist(), strict=True):
            names[h].add(x)
        assert all(len(v) == 1 for v in names.values()) and len(names) == len({x for t in plain for x in t})
    long = [b"a" * 700_000 + b" b", b"b " + b"a" * 700_000]
    assert Words(long).hashes[0] == Words(long).hashes[3] and Words(long).hashes[1] == Words(long).hashes[2]


def test_hot_keys_join_as_others(spark):
    left = spark.range(3000).select((F.col("id") % F.when(F.col("id") < 2500, 2).otherwise(400)).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k <> 7")
    got = join_hot(left, right, "k", 300_000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").collect()))


def test_string_and_null_keys_and_clashing_columns(spark, texts):
    docs = odd_frame(spark, texts)
    groups = {(r.doc_id, r.keep, r.group_size) for r in exact_dedup.exact_groups(docs).collect()}
    assert ("d", "b", 2) in groups and (None, "c", 3) in groups
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or "", (r.text or "")[:5]) for r in kept.collect()) == sorted((k or "", (t or "")[:5]) for k, t in {"b": texts[0][1], "a": texts[1][1], "c": texts[2][1], "e": "", "f": " ", "g": "xxxxx"}.items())
    near = collections.Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in near_dup.near_duplicates(docs).collect())
    assert near[("a", "a", 1, 1)] == near[("b", "a", 1, 2)] == near[("d", "a", 1, 2)] == 1 and near[("c", "c", 1, 3)] == 2 and near[(None, "c", 1, 3)] == 1
    some = near_dup.drop_near_duplicates(docs)
    assert some.columns == docs.columns and sorted(r.doc_id or "" for r in some.collect()) == ["", "a", "c", "e", "f"]
    cut = {(r.doc_id, r.n_words): r.n_removed for r in phrase_dedup.remove_repeats(docs).collect()}
    assert cut[("a", 61)] == 0 and cut[("b", 60)] == cut[("d", 60)] == 60 and cut[("c", 60)] == 0 and cut[(None, 60)] == 60 and cut[("g", 61)] == 60
    packed = packing.pack_documents(docs, default_tokenizer("byte_bpe_50k.json"))
    assert packed.schema["doc_id"].dataType.simpleString() == "string" and packed.where("piece = 0").count() == len(texts)
    files = token_files.write_token_files(docs, default_tokenizer("word_bpe_49k.json"))
    assert token_files.read_token_files(files).count() == len(texts)
    model = language_id.train_language_codes(docs)
    identified = language_id.keep_identified(docs, model)
    assert identified.columns == docs.columns and {r["letters"] for r in identified.collect()} == {"letters"} and identified.count() == 7
    assert language_id.identify(docs, model, keep=("doc_id", "raw")).count() == len(texts)
    bench = spark.createDataFrame([("i", texts[2][1])], "item_id string, text string")
    found = {r.doc_id: r.n_hit for r in decontaminate.contamination(docs.where("doc_id is not null"), bench, automaton_bytes=100).collect()}
    assert found["c"] == 60 and found["a"] == 0 and found["g"] == 60
    assert decontaminate.contamination(docs.where("false"), bench).count() == 0
    assert ngram_lm.score(docs, ngram_lm.train(docs), keep=("doc_id", "row")).count() == len(texts)


def test_occurrences_come_from_the_automaton(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choices(words, k=40))
    rows = [(k, " ".join([*rng.choices(words, k=rng.randint(0, 30)), passage, *rng.choices(words, k=rng.randint(0, 30))])) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").coalesce(1)
    found = docs.sparkSession.createDataFrame(phrase_dedup.remove_repeats(docs).collect())
    assert {r.doc_id: r.n_removed >= 40 for r in found.collect()} == {k: k > 0 for k in range(30)}
    segments = [passage.encode(), f"{passage} w1".encode(), b"w3 " + passage.encode()]
    passages = phrase_dedup.confirmed_passages(segments, np.array([5, 1, 7]), np.array([9, 1, 7]))
    assert passages and min(passages.values()) == 1
    place, ids = np.array([0, 0, 1, 2]), np.array([5, 9, 1, 7])
    row, a, b = phrase_dedup.removed_ranges(list(passages), np.array(list(passages.values())), segments, place, ids)
    assert list(zip(row.tolist(), a.tolist(), b.tolist(), strict=True)) == [(0, 0, 40), (1, 0, 40), (3, 1, 41)]
    row, _, _ = phrase_dedup.removed_ranges([], np.zeros(0, np.int64), segments, place, ids)
    assert not len(row)


@pytest.mark.parametrize("hot", [2000, 2])
def test_phrases_against_brute_force_with_hot_minimizers(spark, monkeypatch, hot):
    monkeypatch.setattr(phrase_dedup, "HOT_TEXTS", hot)
    monkeypatch.setattr(phrase_dedup, "SHARD_ROWS", 50)
    monkeypatch.setattr(phrase_dedup, "SPLIT_ROWS", 20)
    rng = random.Random(6)
    words = [f"w{k}" for k in range(30)]
    passages = [rng.choices(words, k=n) for n in (13, 14, 20, 50)]
    rows = []
    for k in range(120):
        parts = [x for _ in range(rng.randint(0, 4)) for x in (rng.choices(words, k=rng.randint(0, 15)), rng.choice(passages)[rng.randint(0, 3) :])]
        rows.append((k * 3 % 121, [w for p in parts for w in p]))
    first = {}
    for k, w in rows:
        for i in range(len(w) - 12):
            first[tuple(w[i : i + 13])] = min(k, first.get(tuple(w[i : i + 13]), k))
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id bigint, text string")
    got = {r.doc_id: r for r in phrase_dedup.remove_repeats(docs).collect()}
    for k, w in rows:
        gone = {i + x for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < k for x in range(13)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (got[k].n_removed, got[k].kept_sha256) == (len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_forest_recall_and_depths(spark, monkeypatch):
    assert [near_dup.query_depth(n) for n in (1, 3, 4, 6, 7, 100)] == [0, 0, 5, 6, 7, 5]
    assert near_dup.least_similarity(7) == 6 / 7 and near_dup.least_similarity(3) is None
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", 7)
    monkeypatch.setattr(near_dup, "FEW_PAIRS", 3)
    rng = random.Random(8)
    rows = []
    for g in range(40):
        base = [f"g{g}w{k}" for k in range(rng.choice([9, 11, 60, 150]))]
        for _ in range(rng.choice([2, 3, 20])):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    sets = {}
    for k, t in rows:
        w = t.encode().translate(FOLD).split()
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    got = {r.doc_id: r.n_links for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    different = set(sets.values())
    true = {k: sum(1 for o in different if o != s and len(o & s) >= 0.8 * len(o | s)) for k, s in sets.items()}
    assert all(got[k] <= n for k, n in true.items()) and sum(got.values()) >= 0.99 * sum(true.values()) > 100


def test_trigram_model_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = ["a", "b", "C", "dog", "the", "x,"]
    train = [" ".join(rng.choices(words, [9, 4, 3, 2, 2, 1], k=rng.randint(0, 30))) for _ in range(60)] + [None, ""]
    test = [" ".join(rng.choices([*words, "new"], k=rng.randint(0, 9))) for _ in range(20)] + [None, ""]

    def tokens(text):
        return ["<", "<", *(text or "").lower().split(), ">"]

    three = collections.Counter(tuple(x[k - 2 : k + 1]) for x in map(tokens, train) for k in range(2, len(x)))
    plain, two = collections.Counter(), collections.Counter()
    for (_, v, w), c in three.items():
        plain[w] += c
        two[v, w] += c if v == "<" else 1
    one = collections.Counter(w for _, w in two)
    n, v_size = sum(plain.values()), len(plain)
    discounts = [ngram_lm._discounts(np.array([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)])) for c in (one, two, three)]
    discounts[2] = (1.0, *discounts[2][1:])

    def level(c, context, d, low):
        off = lambda x: d[min(x, 3) - 1] if x else 0
        return (max(c - off(c), 0) + sum(map(off, context)) * low) / sum(context) if context else low

    def p(u, v, w):
        low = level(one[w], list(one.values()), discounts[0], 1 / (v_size + 1))
        low = level(two[v, w], [c for (a, _), c in two.items() if a == v], discounts[1], low)
        return level(three[u, v, w], [c for (a, b, _), c in three.items() if (a, b) == (u, v)], discounts[2], low)

    frame = spark.createDataFrame([(t,) for t in train], "text string").repartition(3)
    asked = spark.createDataFrame(list(enumerate(test)), "i int, text string")
    for common in (1, 256):
        monkeypatch.setattr(ngram_lm, "COMMON_WORDS", common)
        got = ngram_lm.score(asked, ngram_lm.train(frame, shards=5), keep=("i",)).orderBy("i").collect()
        for r, text in zip(got, test, strict=True):
            x = tokens(text)
            assert (r.n_tokens, r.n_known) == (len(x) - 2, sum(plain[w] > 0 for w in x[2:]))
            assert abs(r.base_score - sum(math.log10((plain[w] + 0.5) / (n + 0.5 * (v_size + 1))) for w in x[2:])) < 1e-9
            assert abs(r.score - sum(math.log10(p(*x[k - 2 : k + 1])) for k in range(2, len(x)))) < 1e-9


def test_language_query_keeps_trigrams_seen_once(spark, tmp_path):
    """Scores of the query are those of the whole modified Kneser-Ney model, with its own discount for trigrams seen once."""
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices(["a", "b", "c", "d", "e"], [6, 4, 3, 2, 2], k=rng.randint(0, 12)))) for k in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tokens = {k: ["<", "<", *t.split(), ">"] for k, t in rows}
    three, two, plain = (collections.Counter() for _ in range(3))
    for k, x in tokens.items():
        if zlib.crc32(str(k).encode()) % 5 != 1:
            three.update(zip(x, x[1:], x[2:], strict=False))
            plain.update(x[2:])
    for (_, v, w), c in three.items():
        two[v, w] += c if v == "<" else 1
    one = collections.Counter(w for _, w in two)
    d1, d2, d3 = (ngram_lm._discounts(np.array([list(c.values()).count(k) for k in (1, 2, 3, 4)])) for c in (one, two, three))
    assert d3[0] < 1 and list(three.values()).count(1) > 20

    def level(c, context, d, low):
        off = lambda x: d[min(x, 3) - 1] if x else 0
        return (max(c - off(c), 0) + sum(map(off, context)) * low) / sum(context) if context else low

    def p(u, v, w):
        low = level(one[w], list(one.values()), d1, 1 / (len(plain) + 1))
        low = level(two[v, w], [c for (a, _), c in two.items() if a == v], d2, low)
        return level(three[u, v, w], [c for (a, b, _), c in three.items() if (a, b) == (u, v)], d3, low)

    got = {r.doc_id: r.score for r in queries.op4_ngram_lm(spark, str(tmp_path)).collect()}
    for k, x in tokens.items():
        assert abs(got[k] - sum(math.log10(p(*g)) for g in zip(x, x[1:], x[2:], strict=False))) < 1e-9


def test_sequences_are_few(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for held in (400_000, 40):
        monkeypatch.setattr(packing, "HELD", held)
        out = packing.pack_documents(docs.repartition(6), default_tokenizer("byte_bpe_50k.json"))
        ids, sequences = out.agg(F.sum("length"), F.count_distinct("sequence_id")).first()
        assert sequences <= 1.02 * -(-ids // packing.CAPACITY) + 2


def test_codes_against_a_plain_decoder(spark):
    """Scores are those of decoding each text by itself, over all codewords."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.train_language_codes(docs)
    got = {r.doc_id: r for r in language_id.identify(docs, model, keep=("doc_id",)).collect()}
    for r in docs.collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        names, p, _ = model.decode(language_id.features(r.text.encode())[None])
        assert got[r.doc_id].lang_pred == names[0] and abs(got[r.doc_id].score - p[0]) < 1e-6


def test_ratios_against_plain_counts(spark, monkeypatch):
    rows = [(k, ("you awful rotten fool " if k % 3 == 0 else "what a lovely garden ") * (1 + k % 2)) for k in range(90)] + [(90, None), (91, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    labels = spark.createDataFrame([*((k, int(k % 3 == 0)) for k in range(90)), (3, None), (0, 0), (91, 0)], "doc_id int, toxic int")
    plain = toxicity.train_toxicity(docs, labels)
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 1)
    joined = toxicity.train_toxicity(docs, labels)
    seen = collections.Counter()
    for k, t in rows[:90]:
        for f in set(toxicity.ngram_ids(t.encode()).tolist()):
            seen[f, k % 3 == 0] += 1
    ids = np.flatnonzero(plain.kept)
    for f in ids.tolist():
        ratio = math.log((seen[f, True] + 1) / 32) - math.log((seen[f, False] + 1) / 63)
        assert plain.value[f] * ratio >= 0 and seen[f, True] + seen[f, False] > 2
    for model in (plain, joined):
        got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model, keep=("doc_id",)).collect()}
        assert all((got[k] >= 0.5) == (k % 3 == 0) for k in range(90)) and got[90] == got[91]


def test_url_rules_tied_empty_and_salted(spark, monkeypatch):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(["http://a.b.c/d/e"] * 20 + [None, "", "http://c/"])], "page_id int, url string, _host string")
    rules = spark.createDataFrame([("c", "/", "allow"), ("c", "/", "block"), ("b.c", "/d", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    want = url_filters.filter_urls(pages, rules).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in want] == [("b.c/d", "allow")] * 20 + [(None, "allow")] * 2 + [("c/", "block")]
    monkeypatch.setattr(url_filters, "BROADCAST_RULES", 1)
    assert url_filters.filter_urls(pages, rules).orderBy("page_id").collect() == want
    assert url_filters.filter_urls(pages.where("false"), rules).count() == 0
    assert {r.verdict for r in url_filters.filter_urls(pages, rules.where("false")).collect()} == {"allow"}


def test_packed_counts_are_whole(tmp_path):
    rng = np.random.default_rng(5)
    for size, rows in ((0, 1), (1, 4), (5000, 1), (5000, 4)):
        keys = np.unique(rng.integers(0, 1 << 64, size, np.uint64))
        keys[: size // 50] = keys[0] + np.arange(size // 50, dtype=np.uint64) if size else keys[:0]  # one full bucket
        keys = np.unique(keys)
        counts = rng.geometric(0.3, (rows, len(keys))).astype(np.int64) - (rows > 1)
        counts[0, ::100] = 1 << 40
        ngram_lm._put_packed(str(tmp_path), f"x{size}-{rows}-000000", keys, counts)
        mapped = ngram_lm.MappedModel({"uri": str(tmp_path), "shards": 1})
        ask = np.concatenate([keys, keys + np.uint64(1), rng.integers(0, 1 << 64, 99, np.uint64)])
        known = dict(zip(keys.tolist(), counts.T.tolist(), strict=True))
        found = mapped.packed(f"x{size}-{rows}", np.zeros(len(ask), np.int64), ask, rows)
        assert found.T.tolist() == [known.get(k, [0] * rows) for k in ask.tolist()]


def test_model_files_are_small(spark):
    rng = np.random.default_rng(6)
    texts = [(" ".join(map(str, rng.integers(0, 5000, 1000))),) for _ in range(300)]
    model = ngram_lm.train(spark.createDataFrame(texts, "text string"), shards=1, prune=False)
    top = Path(model["uri"].removeprefix("file://"))
    # as many contexts and pairs as trigrams, nearly: 34 bytes a trigram with whole keys and counts
    assert sum(f.stat().st_size for f in top.iterdir() if not f.name.startswith((".", "words"))) < 24 * 300_000
