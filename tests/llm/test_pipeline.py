"""The pipeline against a brute-force version of its stages on the smallest tables."""

import re
import zlib

import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.001"
FOLDED = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return FOLDED.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def one_of_each_near_group(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    top = {k: k for k in sets}

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {k: t for k, t in texts.items() if root(k) == k}


def expected():
    """Texts of the documents that the first four stages keep."""
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    texts = {int(k): t for k, t in zip(docs["doc_id"], docs["text"], strict=True) if t is not None and any(c.isalpha() for c in t)}
    equal = {}
    for k in sorted(texts):
        equal.setdefault(re.sub("[\x20\x09-\x0d]+", " ", texts[k]), k)
    texts = one_of_each_near_group({k: texts[k] for k in equal.values()})
    windows = {tuple(w[i : i + 10]) for w in map(words, pd.read_parquet(f"{SF}/benchmark.parquet")["text"].dropna()) if w for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}

    def clean(text):
        w = words(text)
        return not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    return {k: t for k, t in texts.items() if clean(t)}


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from twinsift.llm.tokens import default_tokenizer

    tok = Tokenizer.from_file(default_tokenizer("byte_bpe_50k.json"))
    ids = {k: [*tok.encode(t, add_special_tokens=False).ids, 0] for k, t in expected().items()}
    got, bins = corpus_pipeline.run(spark, SF).collect(), {}
    assert {r.doc_id for r in got} == set(ids)
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_stages_keep_columns_and_stand_empty_tables(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
