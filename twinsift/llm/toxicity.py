"""Toxicity by a linear classifier over character n-grams scaled with naive Bayes log-count ratios.

Counts of n-grams by class are taken over all labelled rows, in Spark. The n-grams that tell the classes apart
best (chi-squared) are kept; a text is the set of its kept n-grams, each with its log-count ratio as value. A
logistic regression over these is fitted on a bounded number of rows of each class, weighted back to the true
class shares.

Null and empty texts have no n-grams and get the score of the intercept. Very long texts count whole. Labels are
0 or 1; rows with a null label are not learned from; of several labels of one key the largest counts. Rows that
repeat a key are learned from and scored each. Ties in chi-squared go to the smaller n-gram number. Without
labels of both classes every score is the intercept's; an empty table gives no rows. Other columns are not read,
so their names do not matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, bytes_of, fresh_names, written

BITS, KEPT = 18, 20_000
ROWS_PER_CLASS = 1500
#: N-grams below this chi-squared value (about one in 100,000 by chance) say nothing of the class.
LEAST_CHI = 20.0
#: Labels up to this many rows (16 bytes each) are broadcast to their texts; more are joined in a shuffle.
BROADCAST_LABELS = 1_000_000


def ngram_ids(raw: bytes) -> np.ndarray:
    """Hashed character 4-, 5- and 6-grams of the folded text, repeats included."""
    b = np.frombuffer(b" " + b" ".join(raw.translate(FOLD).split()) + b" ", np.uint8).astype(np.uint64)
    out, h = [], b * np.uint64(0x100000001B3)
    for n in range(2, 7):
        h = (h[:-1] ^ b[n - 1 :]) * np.uint64(0x100000001B3) if len(h) else h
        if n >= 4:
            out.append((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))
    return np.concatenate(out).astype(np.int64)


class RatioClassifier:
    def __init__(self, ids: np.ndarray, ratios: np.ndarray, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, steps: int = 200, l2: float = 0.05):
        """ids, ratios: the kept n-grams; rows: kept positions of each training row; weight: of each row."""
        self.kept = np.zeros(1 << BITS, bool)
        self.kept[ids] = True
        self.value = np.zeros(1 << BITS, np.float32)
        self.bias = 0.0
        if len(rows) and 0 < y.mean() < 1:
            sizes = np.array([len(r) for r in rows])
            flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
            weight = weight / weight.sum()
            prior = float((weight * y).sum())
            w, bias = np.zeros(len(ids)), np.log(prior / (1 - prior))
            m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
            value = ratios.astype(np.float32)[flat]
            for t in range(1, steps + 1):
                z = np.bincount(owner, value * w[flat], len(rows)) + bias
                err = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
                g = np.bincount(flat, value * err[owner], len(ids)) + l2 / len(rows) * w
                gb = err.sum()
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
                w -= 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
                bias -= 0.02 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
            self.value[ids] = w * ratios
            self.bias = float(bias)
        elif len(rows):
            self.bias = 5.0 if y.mean() == 1 else -5.0
        else:
            self.bias = -5.0

    def score(self, raw: bytes) -> float:
        at = ngram_ids(raw)
        at = np.unique(at[self.kept[at]])
        return float(1 / (1 + np.exp(-np.clip(self.value[at].sum() + self.bias, -30, 30))))


def train_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", label_key: str = "doc_id", rows_per_class: int = ROWS_PER_CLASS) -> RatioClassifier:
    """Learn from the rows of docs that have a label."""
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(label_key).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    if labels.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    known = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text")).join(marks, F.col("_key") == F.col("_id")).select("_key", "text", "y")

    def count(batches):
        import pyarrow as pa

        n, counts = [0, 0], np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for raw, y in zip(bytes_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                y = int(y > 0)
                counts[y][np.unique(ngram_ids(raw))] += 1
                n[y] += 1
        at = np.flatnonzero(counts.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[1][at], n[1])), pa.array(np.append(counts[0][at], n[0]))], names=["f", "pos", "neg"])

    counted = written(known.select("text", "y").mapInArrow(count, "f bigint, pos bigint, neg bigint").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "toxic-counts")
    total = counted.where("f = -1").select("pos", "neg").first()
    n_pos, n_neg = (total["pos"], total["neg"]) if total else (0, 0)
    if not n_pos or not n_neg:
        return RatioClassifier(np.zeros(0, np.int64), np.zeros(0), [np.zeros(0, np.int64)] * bool(n_pos + n_neg), np.array([float(n_pos > 0)] * bool(n_pos + n_neg)), np.ones(int(bool(n_pos + n_neg))))
    ratio = F.log((F.col("pos") + 1) / F.lit(n_pos + 2.0)) - F.log((F.col("neg") + 1) / F.lit(n_neg + 2.0))
    both = F.col("pos") + F.col("neg")
    expected = both * F.lit(n_pos / (n_pos + n_neg))
    chi = F.pow(F.col("pos") - expected, 2) / expected
    # at most KEPT rows of three numbers
    best = counted.where("f >= 0 and pos + neg > 2").select("f", ratio.alias("r"), chi.alias("chi")).where(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "f").limit(KEPT).collect()
    ids = np.array(sorted(r["f"] for r in best), np.int64)
    by_id = {r["f"]: r["r"] for r in best}
    ratios = np.array([by_id[i] for i in ids.tolist()])
    place = np.full(1 << BITS, -1, np.int32)
    place[ids] = np.arange(len(ids))
    shared = docs.sparkSession.sparkContext.broadcast(place)
    draw = F.pmod(F.xxhash64(F.lit("draw"), "_key"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    shares = (min(1.0, rows_per_class / n_neg), min(1.0, rows_per_class / n_pos))
    drawn = known.where(draw < F.when(F.col("y") > 0, F.lit(shares[1])).otherwise(F.lit(shares[0])))

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            x = [(p := np.unique(shared.value[ngram_ids(raw)]))[p >= 0].astype(np.int32).tobytes() for raw in bytes_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1)], names=["x", "y"])

    # about rows_per_class rows of each class, of at most KEPT positions
    train = drawn.select("text", "y").mapInArrow(rows, "x binary, y int").orderBy("y", "x").collect()
    y = np.array([float(r["y"] > 0) for r in train])
    weight = np.where(y > 0, 1 / shares[1], 1 / shares[0])
    return RatioClassifier(ids, ratios, [np.frombuffer(r["x"], np.int32) for r in train], y, weight)


def score_toxicity(docs: DataFrame, model: RatioClassifier, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns keep, and score (0 to 1), of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), "score double"])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            scores = [shared.value.score(raw) for raw in bytes_of(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(scores, pa.float64())], names=[*keep, "score"])

    return written(docs.select(*keep, F.col(text).cast("string").alias(fresh_names(docs, "raw")[0])).mapInArrow(run, schema), "toxicity")
