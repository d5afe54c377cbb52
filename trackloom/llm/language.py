"""Language identification with error-correcting output codes over hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.words import CHUNK_BYTES, SEED, mixed, text_bytes

# Rows of labelled text that the classifiers are fitted on, and characters read of each row:
# bounds of the training sample only, every document is read whole when predicted.
TRAINING_ROWS = 2000
TRAINING_CHARS = 4000
BUCKETS = 1 << 13
GRAMS = (2, 3)
UNDETERMINED = "und"


def codewords(classes: int) -> np.ndarray:
    """One row of -1 / +1 bits per class.

    Up to five classes: every split of the classes in two parts is one bit, so any two
    rows differ in half of the bits or more. Beyond: the best of some random codes by
    the least distance of two rows. One class has one bit that says nothing.
    """
    if classes < 2:
        return np.ones((classes, 1), np.int8)
    if classes <= 5:
        splits = np.arange(1, 1 << (classes - 1))
        return np.stack([np.where(splits >> k & 1, -1, 1) for k in range(classes)]).astype(np.int8)
    length = int(np.ceil(10 * np.log2(classes)))
    generator, best, most = np.random.default_rng(SEED), None, -1
    for _ in range(200):
        code = generator.choice(np.array([-1, 1], np.int8), (classes, length)).astype(np.int64)
        apart = (length - code @ code.T) // 2
        least = (apart + length * np.eye(classes, dtype=np.int64)).min()
        if least > most and (np.abs(code.sum(0)) < classes).all():
            best, most = code.astype(np.int8), least
    return best


def _grams(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: buckets of all n-grams inside a text, and their texts."""
    wide = data.astype(np.uint64)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    code = wide
    for n in range(2, max(GRAMS) + 1):
        code = code[:-1] * np.uint64(256) + wide[n - 1:]
        if n in GRAMS:
            inside = owner[: len(code)] == owner[n - 1:]
            bucket = (mixed(code + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int64)
            yield bucket[inside], owner[: len(code)][inside]


def _shares(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The share of each bucket in the n-grams of each text, some texts at a time."""
    texts = len(bounds) - 1
    out = np.zeros((texts, BUCKETS), np.float32)
    for low in range(0, texts, 100):
        part = bounds[low:low + 101]
        rows = out[low:low + 100]
        for bucket, owner in _grams(data[part[0]:part[-1]], part - part[0]):
            counts = np.bincount(owner * BUCKETS + bucket, minlength=rows.size)
            rows += counts.reshape(rows.shape).astype(np.float32)
        rows /= np.maximum(rows.sum(1, keepdims=True), 1)
    return out


class Model:
    """Binary linear classifiers of n-gram shares, one per bit of the codewords."""

    def __init__(self, labels: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.labels, self.code, self.weights, self.bias = labels, code, weights, bias

    def margins(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The value of every bit's classifier for each text, a mean over its n-grams."""
        texts = len(bounds) - 1
        total, count = np.zeros((texts, len(self.bias))), np.zeros(texts)
        for bucket, owner in _grams(data, bounds):
            count += np.bincount(owner, minlength=texts)
            for bit in range(len(self.bias)):
                total[:, bit] += np.bincount(owner, self.weights[bit][bucket], texts)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Loss-weighted decoding: the codeword of least loss, and its share of belief.

        The loss of a codeword is the sum of log(1 + exp(-bit * margin)) over its bits.
        """
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]).sum(2)
        belief = np.exp(loss.min(1, keepdims=True) - loss)
        best = loss.argmin(1)
        return best, belief[np.arange(len(best)), best] / belief.sum(1)


def fit(texts: list[str], langs: list[str], rounds: int = 60) -> Model | None:
    """Fit one logistic classifier per bit on lower-case texts. None without samples."""
    labels = sorted(set(langs))
    if not labels:
        return None
    code = codewords(len(labels))
    x = _shares(*text_bytes(pa.array(texts, pa.string())))
    scale = np.float32(1 / max(np.sqrt(np.einsum("ij,ij->i", x, x).mean()), 1e-9))
    kind = np.array([labels.index(lang) for lang in langs])
    share = np.bincount(kind, minlength=len(labels))
    each = (len(kind) / (len(labels) * share))[kind].astype(np.float32)
    y = code[kind].astype(np.float32)
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    # Full gradient steps with a momentum; classes weigh the same.
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        margin = scale * (x @ w) + b
        pull = each[:, None] * y / (1 + np.exp(np.clip(y * margin, -30, 30))) / len(kind)
        vw, vb = 0.9 * vw + scale * (x.T @ pull), 0.9 * vb + pull.sum(0)
        w += 4 * vw
        b += vb
    return Model(labels, code, np.ascontiguousarray((scale * w).T, np.float64), b.astype(np.float64))


def labelled_sample(docs: DataFrame, id_column: str, text_column: str, lang_column: str,
                    rows: int = TRAINING_ROWS) -> tuple[list[str], list[str]]:
    """At most ``rows`` labelled rows, the same number of each language at most.

    They are those of smallest digest, so reruns agree. A language's rows are found by
    partial aggregates of (digest, id), never by a sort of all rows.
    """
    with_lang = docs.filter(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    # A first cut of digests far above what is needed keeps the next step small.
    total = with_lang.groupBy(lang_column).count().collect()
    if not total:
        return [], []
    each = max(1, rows // len(total))
    digest = F.pmod(F.xxhash64(id_column, F.lit(SEED)), F.lit(1 << 40))
    bound = F.coalesce(*[
        F.when(F.col(lang_column) == F.lit(r[0]), F.lit(int((1 << 40) * min(1.0, (each + 20) * 1.5 / r[1]))))
        for r in total])
    picked = with_lang.withColumn("digest", digest).filter(F.col("digest") < bound)
    start = F.substring(F.col(text_column), 1, TRAINING_CHARS)
    got = picked.select(F.col(lang_column).alias("lang"), "digest", F.lower(start).alias("text")).collect()
    got.sort(key=lambda r: (r["lang"], r["digest"], r["text"]))
    texts, langs, seen = [], [], {}
    for row in got:
        seen[row["lang"]] = seen.get(row["lang"], 0) + 1
        if seen[row["lang"]] <= each:
            texts.append(row["text"])
            langs.append(row["lang"])
    return texts, langs


def _predictor(model: Model | None, ambiguous: float):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(batch.num_columns - 2))
            lettered = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            rows = batch.num_rows
            best, score = np.zeros(rows, int), np.zeros(rows)
            row = 0
            while row < rows and model:
                end = int(np.searchsorted(bounds, bounds[row] + CHUNK_BYTES, "right")) - 1
                end = min(max(end, row + 1), rows)
                part = model.margins(data[bounds[row]:bounds[end]], bounds[row:end + 1] - bounds[row])
                best[row:end], score[row:end] = model.decode(part)
                row = end
            known = lettered & bool(model)
            names = [model.labels[k] if ok else UNDETERMINED for k, ok in zip(best, known)]
            score = np.where(known, score, 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(names, pa.string()), pa.array(score),
                 pa.array(~known | (score < ambiguous))],
                names=[*batch.schema.names[:-2], "lang_pred", "score", "ambiguous"])

    return predict


def held_out(id_column: str = "doc_id") -> Column:
    """Rows that no classifier may learn from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify_language(
    docs: DataFrame, training: DataFrame | None = None, id_column: str = "doc_id",
    text_column: str = "text", lang_column: str = "lang", ambiguous: float = 0.5,
    rows: int = TRAINING_ROWS, keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """One row (id, lang_pred, score, ambiguous) for each row of ``docs``.

    ``keep`` names columns that stand in place of the id.

    Binary classifiers of character n-grams predict the bits of a codeword; the language
    whose codeword has the least loss wins. ``score`` is its share of belief among all
    languages, and ``ambiguous`` marks a share below the parameter of that name. The
    classifiers learn from ``rows`` labelled rows of ``training`` at most (default: the
    rows of ``docs``), evenly over languages; all of them are fitted before the
    prediction and travel with it, a few hundred kilobytes whatever the corpus.

    A null text, a text without a letter, and every text if there is no labelled row, is
    ``und`` with score 0. An empty table gives an empty result; a null id stays null;
    other columns are ignored.
    """
    model = fit(*labelled_sample(docs if training is None else training, id_column, text_column, lang_column, rows))
    plain = docs.select(*(keep or (id_column,)), F.lower(text_column).alias("__text"),
                        F.coalesce(F.col(text_column).rlike(r"\p{L}"), F.lit(False)).alias("__lettered"))
    fields = ", ".join(f"`{name}` {kind}" for name, kind in plain.dtypes[:-2])
    return plain.mapInArrow(
        _predictor(model, ambiguous), f"{fields}, lang_pred string, score double, ambiguous boolean")
