"""Language identification by error-correcting output codes.

Every language has a codeword; one binary linear classifier over hashed byte n-grams learns each bit. A text's
margins are decoded by loss: the codeword with the least weighted logistic loss wins, each bit weighted by how
well it separates the training rows. A small lead over the next codeword is flagged as ambiguous.

Training rows are bounded: about rows_per_language of each language, chosen by a hash of the key; their whole
texts count. Texts that are null, empty or have no letter are ``und`` with score 0. Very long texts count whole.
Ties between languages go to the first by name, and are flagged. Repeated rows are judged alike. With nothing to
learn from, every text is ``und``; an empty table gives no rows. Other columns are kept or not read, so their
names do not matter.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, bytes_of, fresh_names, frugal, slices, written

FEATURES = 1 << 13
ROWS_PER_LANGUAGE = 400
#: Lead in score under which a decision counts as ambiguous.
AMBIGUOUS = 0.1
_LETTER = r"\p{L}"


def features(raw: bytes) -> np.ndarray:
    """Square roots of hashed counts of byte bigrams and trigrams of the folded text, with length 1."""
    b = np.frombuffer(b" " + b" ".join(raw.translate(FOLD).split()) + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(256) + b[1:]
    three = two[:-1] * np.uint32(256) + b[2:]
    at = np.concatenate([two * np.uint32(2654435761) >> np.uint32(19), three * np.uint32(2246822519) >> np.uint32(19)])
    x = np.sqrt(np.bincount(at, minlength=FEATURES).astype(np.float32))
    return x / max(float(np.linalg.norm(x)), 1e-9)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 / -1: all different splits for few languages, else columns drawn until rows are far apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([[1 if bit else -1 for bit in col] for col in itertools.product((0, 1), repeat=n) if col[0] and not all(col)]).T
    rng, best = np.random.default_rng(7), None
    size = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = rng.choice((-1, 1), (n, size))
        gap = min((code[a] != code[b]).sum() for a, b in itertools.combinations(range(n), 2)) if n < 200 else 0
        if np.abs(code.sum(0)).max() < n and (best is None or gap > best[0]):
            best = (gap, code)
    return best[1]


class LanguageCodes:
    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray, steps: int = 150):
        """x: rows of features; y: index of the language of each row."""
        self.languages = languages
        self.code = codewords(len(languages)).astype(np.float32)
        target = self.code[y] if len(y) else np.zeros((0, self.code.shape[1]), np.float32)
        self.w = np.zeros((FEATURES, self.code.shape[1]), np.float32)
        self.b = np.zeros(self.code.shape[1], np.float32)
        speed, speed_b = np.zeros_like(self.w), np.zeros_like(self.b)
        for _ in range(steps if len(y) else 0):
            g = -target / (1 + np.exp(np.clip(target * (x @ self.w + self.b), -30, 30)))
            speed = 0.9 * speed - 20.0 * (x.T @ g / len(y) + 1e-5 * self.w)
            speed_b = 0.9 * speed_b - 0.5 * g.mean(0)
            self.w += speed
            self.b += speed_b
        right = (np.sign(x @ self.w + self.b) == target).mean(0) if len(y) else np.ones(self.code.shape[1])
        self.weight = np.clip(2 * right - 1, 0.05, 1).astype(np.float32)

    def decode(self, x: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, lead over the next) of each row."""
        margin = np.clip(x @ self.w + self.b, -30, 30)
        loss = (np.log1p(np.exp(-margin[:, None, :] * self.code[None])) * self.weight).sum(2)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        order = np.argsort(-p, 1, kind="stable")
        top = np.take_along_axis(p, order[:, :2], 1)
        return [self.languages[k] for k in order[:, 0]], top[:, 0], top[:, 0] - (top[:, 1] if p.shape[1] > 1 else 0)


def train_language_codes(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageCodes:
    """Learn from rows with a language and a text. Languages: as many as the column holds (a small closed set)."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(text).rlike(_LETTER))
    counts = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageCodes([], np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64))
    share = F.element_at(F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, rows_per_language / counts[k]))]), F.col(lang))
    drawn = known.where(F.pmod(F.xxhash64(F.lit("draw"), F.col(key)), F.lit(1_000_003)) < share * 1_000_003)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = [features(raw).astype(np.float16).tobytes() for raw in bytes_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["lang", "x"])

    # about rows_per_language rows of 16 KB for each language
    rows = drawn.select(F.col(lang).cast("string"), F.col(text).cast("string")).mapInArrow(frugal(run), "lang string, x binary").orderBy("lang", "x").collect()
    x = np.array([np.frombuffer(r["x"], np.float16) for r in rows], np.float32).reshape(-1, FEATURES)
    return LanguageCodes(languages, x, np.array([languages.index(r["lang"]) for r in rows], np.int64))


def identify(docs: DataFrame, model: LanguageCodes, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns keep, and lang_pred, score, lead, ambiguous, of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[k] for k in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string, score double, lead double, ambiguous boolean"])
    letters, raw_text = fresh_names(docs, "letters", "raw")
    chosen = docs.select(*keep, F.coalesce(F.col(text).rlike(_LETTER), F.lit(False)).alias(letters), F.col(text).cast("string").alias(raw_text))

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            n = len(keep)
            real = batch.column(n).to_pylist()
            preds, scores, leads = ["und"] * len(real), np.zeros(len(real)), np.zeros(len(real))
            at = [k for k, r in enumerate(real) if r and m.languages]
            raws = bytes_of(batch.column(n + 1))
            for a in range(0, len(at), 256):
                some = at[a : a + 256]
                names, p, lead = m.decode(np.array([features(raws[k]) for k in some]))
                for k, name in zip(some, names, strict=True):
                    preds[k] = name
                scores[some], leads[some] = p, lead
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(n)), pa.array(preds, pa.string()), pa.array(scores), pa.array(leads), pa.array(leads < AMBIGUOUS)],
                names=[*keep, "lang_pred", "score", "lead", "ambiguous"],
            )

    return written(chosen.mapInArrow(run, schema), "language")


def keep_identified(docs: DataFrame, model: LanguageCodes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows whose text is in a learned language, with all their columns; what has no letters goes. Decided row by row, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    (name,) = fresh_names(docs, "letters")
    letters = docs.select(*(F.col(f"`{c}`") for c in docs.columns), F.coalesce(F.col(text).rlike(_LETTER), F.lit(False)).alias(name))

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            real = batch.column(batch.num_columns - 1).to_pylist()
            stays = [False] * len(real)
            found = [k for k, r in enumerate(real) if r and m.languages]
            for a in range(0, len(found), 256):
                some = found[a : a + 256]
                names, _, _ = m.decode(np.array([features(raw) for raw in bytes_of(batch.column(at).take(pa.array(some)))]))
                for k, language in zip(some, names, strict=True):
                    stays[k] = language != "und"
            rest, row = pa.RecordBatch.from_arrays([batch.column(k) for k in range(batch.num_columns - 1)], schema=pa.schema([f for f in batch.schema][:-1])), 0
            for part in slices(rest, at):
                yield part.filter(pa.array(stays[row : row + part.num_rows], pa.bool_()))
                row += part.num_rows

    return letters.mapInArrow(frugal(run), docs.schema)
