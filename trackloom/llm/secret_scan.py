"""Secrets in texts: patterns, and strings that look random to character Markov models."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.samples import sample_texts
from trackloom.llm.words import SEED

# The patterns of the base kinds, as given, and the least length of what they match.
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")
ASSIGN_CHARS, ACCESS_CHARS = 12, 18
# Candidates of the models are runs of these letters, and a run is random if its
# log-likelihood ratio is at least RATIO.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
RATIO = 12.0
# Bounds of the sample of labelled strings that the models are fitted on.
TRAINING_ROWS, TRAINING_CHARS, DRAWN = 2000, 4000, 400
# Words of the sample that compounds are made of, evenly from all its texts.
COMPOUND_WORDS = 8000
SETS = {
    "hex": "0123456789abcdef", "upper": ALPHABET[:26] + "0123456789",
    "alphanumeric": ALPHABET[:62], "base64": ALPHABET}
SPAN = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns, by start and then by kind as listed."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _codes(string: str) -> np.ndarray:
    return np.array([ALPHABET.index(c) for c in string])


def _transitions(strings: list[str], letters: str) -> np.ndarray:
    """Log probabilities of a letter after a letter; the last row is for the first one."""
    n = len(ALPHABET)
    counts = np.zeros((n + 1, n))
    counts[:, _codes(letters)] = 0.5
    for string in strings:
        codes = _codes(string)
        np.add.at(counts, (np.append(n, codes[:-1]), codes), 1)
    with np.errstate(divide="ignore"):
        return np.log(counts / counts.sum(1, keepdims=True))


class SecretModel:
    """One table of log-likelihood ratios per alphabet of random strings."""

    def __init__(self, random: list[str], ordinary: list[str]):
        plain = _transitions(ordinary, ALPHABET)
        self.tables = []
        for letters in SETS.values():
            own = [s for s in random if set(s) <= set(letters)]
            self.tables.append(_transitions(own, letters) - plain)

    def ratio(self, string: str) -> float:
        """The log-likelihood ratio of the best alphabet against ordinary identifiers."""
        codes = _codes(string)
        before = np.append(len(ALPHABET), codes[:-1])
        return float(max(table[before, codes].sum() for table in self.tables)) - float(np.log(len(self.tables)))


def fit(texts: list[str]) -> SecretModel:
    """Fit on labelled strings: what the patterns match and drawn random strings against
    the other words of the texts, alone and joined as identifiers are."""
    generator = np.random.default_rng(SEED)
    random, ordinary = [], []
    for text in texts:
        spans = base_spans(text)
        for kind, start, end in spans:
            value = ASSIGN.match(text[start:end])[2] if kind == "assign" else text[start:end]
            random.append(value.replace(".", ""))
        for m in re.finditer(r"[A-Za-z]{3,}[A-Za-z0-9+/_=-]*", text):
            if not any(start < m.end() and m.start() < end for _, start, end in spans):
                ordinary.append(m[0])
    words = ordinary[::-(-len(ordinary) // COMPOUND_WORDS) or 1]
    for k in range(0, len(words) - 2, 2):
        number = str(generator.integers(0, 1000))
        ordinary += ["_".join(words[k:k + 3]), words[k] + words[k + 1].capitalize() + number,
                     "/".join(words[k:k + 3]), "-".join((words[k], words[k + 1], number))]
    # Frequent words count a few times only, so rare ones have their say.
    seen: dict[str, int] = {}
    limited = [w for w in ordinary if seen.setdefault(w, 0) < 3 and not seen.update({w: seen[w] + 1})]
    for letters in SETS.values():
        drawn = generator.choice(list(letters), (DRAWN, 32))
        random += ["".join(row) for row in drawn]
    return SecretModel([s for s in random if s], limited)


def _scanner(model: SecretModel):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                                    ("end", pa.int64()), ("base", pa.bool_())]))
        ratios: dict[str, bool] = {}
        for batch in batches:
            rows = []
            for scalar in batch.column(batch.num_columns - 1):
                text = scalar.as_py() or ""
                base = base_spans(text)
                found = [dict(kind=k, start=s, end=e, base=True) for k, s, e in base]
                for m in CANDIDATE.finditer(text):
                    if any(s < m.end() and m.start() < e for _, s, e in base):
                        continue
                    if len(ratios) > 100_000:
                        ratios.clear()
                    if m[0] not in ratios:
                        ratios[m[0]] = model.ratio(m[0]) >= RATIO
                    if ratios[m[0]]:
                        found.append(dict(kind="random", start=m.start(), end=m.end(), base=False))
                rows.append(sorted(found, key=lambda s: (s["start"], KINDS.index(s["kind"]))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(rows, kinds)], names=[*batch.schema.names[:-1], "spans"])

    return scan


def secret_model(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> SecretModel:
    """The models, fitted on a bounded sample of the texts (about TRAINING_ROWS of them)."""
    return fit(sample_texts(docs, id_column, text_column, TRAINING_ROWS, TRAINING_CHARS))


def find_secrets(
    docs: DataFrame, model: SecretModel | None = None, id_column: str = "doc_id", text_column: str = "text",
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """One row (id, spans) for each row of ``docs``; ``keep`` names columns instead of the id.

    ``spans`` are structs (kind, start, end, base) in code points, end exclusive, by start
    and then kind. Kinds assign, access and hex are matches of patterns (base is true). To
    these the models add runs of 16 letters and more that overlap none of them and are
    more likely as random strings than as ordinary identifiers, kind ``random``.

    Null and empty texts have no spans; a null id stays null; an empty table gives an
    empty result; other columns are ignored.
    """
    model = model or secret_model(docs, id_column, text_column)
    rows = docs.select(*(keep or (id_column,)), F.col(text_column).alias("__text"))
    fields = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes[:-1])
    return rows.mapInArrow(_scanner(model), f"{fields}, spans {SPAN}")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by ``[SECRET]``, overlapping spans together."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        gap = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        return F.struct(
            F.when(fresh, F.concat(state["out"], gap, F.lit("[SECRET]"))).otherwise(state["out"]).alias("out"),
            F.greatest(state["at"], span["end"]).alias("at"))

    done = F.aggregate(spans, start, step)
    rest = F.substring(text, done["at"] + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(done["out"], rest)).otherwise(text)
