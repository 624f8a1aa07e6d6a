"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from twinsift.llm import decontaminate, exact_dedup, language_id, near_dup, ngram_lm, packing, phrase_dedup, token_files, toxicity, url_filters
from twinsift.llm.common import FOLD, Words
from twinsift.llm.components import components
from twinsift.llm.tokens import default_tokenizer

SCHEMA = "doc_id bigint, text string, lang string, n bigint, bin string, row string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"w{k}é" if k % 7 == 0 else f"W{k}" for k in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (30, 60, 200, 40, 12, 3, 3000)]
    texts = [*base, base[0] + "\t \n", base[1] + " tail", base[1] + " other end", base[2][:300] + " x " + base[0], None, "", " ", "... --", base[3], "Zß, zoé."]
    return [(k, t, "en" if k % 2 else "fr", k, "b", "r") for k, t in enumerate(texts)] + [(3, base[3], "en", 1, "b", "r")]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_exact(spark, rows):
    got = exact_dedup.exact_groups(frame(spark, rows), block=16).collect()
    norm = {}
    for k, t, *_ in rows:
        norm.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(k)
    assert sorted((r.doc_id, r.keep, r.group_size, r.sha256) for r in got) == sorted((k, min(g), len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in norm.items() for k in g)
    assert sum(r.kept for r in got) == len(norm)
    assert exact_dedup.drop_exact_duplicates(frame(spark, rows)).count() == len(norm)
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def test_exact_with_clashing_keys(spark, rows):
    from pyspark.sql import functions as F

    weak = lambda b: F.length(b).cast("bigint")
    a = {(r.doc_id, r.keep, r.group_size) for r in exact_dedup.exact_groups(frame(spark, rows), block=16, block_key=weak).collect()}
    assert a == {(r.doc_id, r.keep, r.group_size) for r in exact_dedup.exact_groups(frame(spark, rows)).collect()}


def test_near(spark, rows):
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    sets = {}
    for k, t, *_ in rows:
        w = (t or "").encode().translate(FOLD).split()
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    for k, s in sets.items():
        others = {o for o in sets.values() if s and o and o != s and len(o & s) / len(o | s) >= 0.8}
        assert got[k][1] == len(others)
    assert got[8][0] == got[1][0] == 1 and got[7][0] == 0 and got[11][0] == 11
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(40) if k != 20] + [(100, 101)]
    got = components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.label, set()).add(r.node)
    assert sorted(map(len, groups.values())) == [2, 20, 21]


def test_phrases(spark, rows):
    rows = [r for r in rows if r[0] != 3] + [rows[3]]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrase_dedup.remove_repeats(frame(spark, rows)).collect()}
    words = {k: (t or "").encode().split() for k, t, *_ in rows}
    first = {}
    for k, w in words.items():
        for i in range(len(w) - 12):
            first[tuple(w[i : i + 13])] = min(k, first.get(tuple(w[i : i + 13]), k))
    for k, w in words.items():
        gone = {i + x for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < k for x in range(13)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        assert got[k] == (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    assert phrase_dedup.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("automaton_bytes", [4_000_000, 60])
def test_contamination(spark, rows, automaton_bytes):
    items = [(1, rows[0][1]), (2, "zß"), (3, None), (4, "..."), (5, "nowhere to be found"), (1, rows[0][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(frame(spark, rows), bench, automaton_bytes=automaton_bytes).collect()}
    wins = {}
    for i, t in items:
        w = (t or "").encode().translate(FOLD).split()
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    for k, t, *_ in rows:
        w = (t or "").encode().translate(FOLD).split()
        hit, names = set(), set()
        for p, who in wins.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    names |= who
        assert got[k] == (len(w), len(hit), sorted(names))
    clean = decontaminate.drop_contaminated(frame(spark, rows), bench, automaton_bytes=automaton_bytes)
    assert sorted(map(tuple, clean.collect()), key=str) == sorted((r for r in rows if not got[r[0]][1]), key=str)
    assert clean.columns == frame(spark, rows).columns
    assert decontaminate.drop_contaminated(frame(spark, []), bench).count() == 0
    assert decontaminate.drop_contaminated(frame(spark, rows), bench.where("false")).count() == len(rows)


def test_packing_and_token_files(spark, rows):
    from tokenizers import Tokenizer

    path = default_tokenizer("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = [r for r in rows if r[0] != 3] + [rows[3]]
    ids = {k: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for k, t, *_ in rows}
    got = packing.pack_documents(frame(spark, rows), path).collect()
    bins = {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(frame(spark, []), path).count() == 0
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(token_files.write_token_files(frame(spark, rows), path, end_id=0)).collect()}
    at = 0
    for k in sorted(ids):
        assert found[k] == (at, len(ids[k]), zlib.crc32(np.array(ids[k], "<u4").tobytes()))
        at += len(ids[k])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_as_whole_texts(name):
    from tokenizers import Tokenizer

    from twinsift.llm.tokens import PieceEncoder

    rng = random.Random(11)
    letters, odd = "abcdefghijklmnopqrstuvwxyzABCDÀÉßñöøÿ", ["don't", "x2", "Ġ", "</w>", "<|endoftext|>", "é", "co-op", "ﬁ", "İ", "a,", "x<|endoftext|>y", "<|ENDOFTEXT|>", "<|startoftext|>", "B.", "日本", "1,5", ",", "."]
    word = lambda: rng.choice(odd) if rng.random() < 0.2 else "".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) + rng.choice(["", "", ",", "."])
    texts = ["", " ", "a  b", "x\ty", *(rng.choice([" ", "\n", ""]) + rng.choice([" ", "\n"]).join(word() for _ in range(rng.randint(1, 400))) for _ in range(300))]
    tok = Tokenizer.from_file(default_tokenizer(name))
    want = [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    for bound in (10, 100_000):
        enc = PieceEncoder(default_tokenizer(name), bound)
        assert enc.edge is not None and enc.encode(texts) == want and enc.encode(texts[::-1]) == want[::-1]


def test_patched_blocks():
    rng = np.random.default_rng(1)
    for top in (1, 2, 300, 2**31, 2**63):
        v = rng.integers(0, top, 5000, dtype=np.uint64)
        v[::97] = np.uint64(2**64 - 1)
        body, starts = token_files.pack_stream(v, 512)
        assert (np.concatenate([token_files.unpack_block(body[a:b]) for a, b in itertools.pairwise(starts)]) == v).all()


def test_language_model(spark, rows):
    docs = frame(spark, rows)
    model = ngram_lm.train(docs)
    got = ngram_lm.score(docs, model, keep=("doc_id",)).collect()
    assert model["n"] == sum(len((t or "").split()) + 1 for _, t, *_ in rows)
    assert all(r.n_known == r.n_tokens and r.score > r.base_score for r in got if r.n_tokens > 20)
    mapped = ngram_lm.MappedModel(model)
    # all words of the vocabulary and an unknown one, after two given words, sum to one
    vocab = {w.lower() if w.isascii() else w.encode().lower().decode() for _, t, *_ in rows for w in (t or "").split()}
    first = rows[0][1].encode().lower().split()[:2]
    hashes = Words([b" ".join([*first, *(v.encode() for v in sorted(vocab)), b"never-seen"])]).hashes
    total = sum(10 ** mapped.log10(np.array([*hashes[:2], n], np.uint64))[2][2] for n in (*hashes[2:], ngram_lm.END))
    assert abs(total - 1) < 1e-6
    empty = ngram_lm.train(docs.where("false"))
    assert all(r.score == 0 for r in ngram_lm.score(docs, empty, keep=("doc_id",)).collect())


def test_language_and_toxicity(spark, rows):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language_id.train_language_codes(docs.where(~held))
    found = language_id.identify(docs.where(held), model, keep=("doc_id", "lang"))
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()
    odd = {r.doc_id: r.lang_pred for r in language_id.identify(frame(spark, rows), model, keep=("doc_id",)).collect()}
    assert odd[11] == odd[12] == odd[14] == "und" and odd[0] != "und"
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    toxic = toxicity.train_toxicity(docs, labels)
    scored = toxicity.score_toxicity(docs, toxic, keep=("doc_id",)).join(labels, "doc_id").collect()
    assert sum((r.score >= 0.5) == (r.toxic == 1) for r in scored) >= 0.97 * len(scored)
    none = toxicity.train_toxicity(docs, labels.where("false"))
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(frame(spark, rows), none, keep=("doc_id",)).collect())


def test_urls(spark):
    urls = ["http://A.net/x", "https://net/", "https://b.example.net/en/1?q", "ftp://example.com/de/2#f", "x.org/fr/", None, "http://q.org/fr/", "http://z.net", "http://q.org/fr/"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id bigint, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(pages, url_filters.rules_frame(spark)).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1][2] == "net/" and got[2][2:] == ("example.net/en/", "allow")
    assert got[3][2:] == ("example.com/de/", "block") and got[4] == got[5] == ("", "", None, "allow")
    assert got[6][2:] == got[8][2:] == ("org/fr/", "allow") and got[7] == ("z.net", "", None, "allow")
