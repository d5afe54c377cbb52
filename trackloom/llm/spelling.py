"""Spelling variants of a corpus, found with bit-sliced position indexes.

A block of the vocabulary has one bitset per (position, letter): the words with that
letter there. Reading a query letter by letter, a set of words without an error (Z) and
sets of words with one (a replaced letter in S, one the word lacks in D) follow by a few
operations on whole bitsets, those of D on the bitsets of the position before.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from trackloom.llm.components import saved

MIN_LENGTH, MIN_COUNT = 5, 3
# One run in DELETE_EVERY loses a letter.
DELETE_EVERY = 97
# A form is at least so many times as frequent as its variant.
RATIO = 2
# Words that a task counts before it hands them on; words and letters of a block of groups;
# queries that are read together.
HELD_WORDS, BLOCK_WORDS, BLOCK_LETTERS, QUERIES = 1 << 17, 1024, 1 << 17, 256
COUNTS = pa.schema({"word": pa.string(), "n": pa.int64()})
FOUND = pa.schema({"word": pa.string(), "near": pa.int64(), "form": pa.string(), "form_n": pa.int64()})


def _counter(min_length: int):
    # Runs are letters up to U+00FF, so a byte is a letter once others are replaced.
    runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % min_length)

    def batch(total: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in total], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(total.values(), pa.int64())], schema=COUNTS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for rows in batches:
            for key, text in zip(rows.column(0), rows.column(1)):
                body = (text.as_py() or "").encode("latin-1", "replace").lower()
                seed = crc32(f"{key.as_py() if key.is_valid else ''}:".encode())
                for run, n in Counter(runs.findall(body)).items():
                    h = crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
                    if h % DELETE_EVERY == 0:
                        cut = h % len(run)
                        run = run[:cut] + run[cut + 1:]
                        if len(run) < min_length:
                            continue
                    total[run] += n
                if len(total) >= HELD_WORDS:
                    yield batch(total)
                    total = Counter()
        if total:
            yield batch(total)

    return counted


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all words that occur ``min_count`` times; some runs of letters lose one, drawn
    by a check sum of doc_id and run. Tasks count before words are shuffled."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(_counter(min_length), from_arrow_schema(COUNTS))
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class PositionIndex:
    """The bitsets of a sorted block of words of ``longest`` letters at most."""

    def __init__(self, words: list[str], longest: int):
        self.count, self.longest = len(words), longest
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        known, codes = np.unique(letters, return_inverse=True)
        self.letters = len(known) + 1
        # 0 stands beyond the end of a word.
        self.codes = np.zeros((len(words), longest), np.int32)
        self.codes[np.arange(longest) < self.lengths[:, None]] = codes + 1

    def bits(self, member: np.ndarray) -> np.ndarray:
        """Rows of booleans about the words as bitsets."""
        wide = np.zeros((*member.shape[:-1], -(-self.count // 64) * 64), bool)
        wide[..., :self.count] = member
        return np.packbits(wide, axis=-1, bitorder="little").view(np.uint64)

    def position(self, i: int) -> np.ndarray:
        """Bitsets of the words by their letter at position i."""
        return self.bits(self.codes[:, i] == np.arange(self.letters)[:, None])

    def near(self, queries: np.ndarray, among: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray]:
        """For queries (word numbers) of full length: bitsets of the words of ``among`` that differ in
        one letter, and of those that are the query without one letter; with ``shared``, words
        with as many first letters in common are left out."""
        zero = among.copy()
        replaced, dropped, left_out = np.zeros_like(zero), np.zeros_like(zero), np.zeros_like(zero)
        before = None
        for i in range(self.longest):
            here = self.position(i)
            letter = self.codes[queries, i]
            same = here[letter]
            replaced = (replaced & same) | (zero & ~same)
            dropped = zero if before is None else (dropped & before[letter]) | zero
            zero = zero & same
            before = here
            if i + 1 == shared:
                left_out = zero
        full = self.bits(self.lengths == self.longest)
        short = self.bits(self.lengths == self.longest - 1)
        return replaced & full & ~left_out, dropped & short & ~left_out


def near_pairs(
    words: list[str], longest: int, groups: np.ndarray, parts: np.ndarray, crossed: np.ndarray, shared: int,
) -> np.ndarray:
    """Ordered pairs of numbers of near words of a group, one of ``longest`` letters at least. In crossed
    groups, where two parts meet, pairs of one part are left out: another block has them."""
    index = PositionIndex(words, longest)
    found = []
    whole = np.flatnonzero(index.lengths == longest)
    for begin in range(0, len(whole), QUERIES):
        queries = whole[begin:begin + QUERIES]
        among = groups[queries][:, None] == groups
        if crossed.any():
            among &= ~crossed[queries][:, None] | (parts[queries][:, None] != parts)
        for k, bits in enumerate(index.near(queries, index.bits(among), shared)):
            some = np.flatnonzero(bits.any(axis=1))
            row, word = np.nonzero(np.unpackbits(bits[some].view(np.uint8), axis=1, bitorder="little")[:, :index.count])
            pair = np.stack([queries[some[row]], word])
            found.append(pair)
            if k:
                found.append(pair[::-1])
    return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (side, longest, key, unit, part, word, n) sorted by the first four: for each word
    how many near ones its groups have, and the most frequent of them."""

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[5])
        side, longest = rows[0][:2]
        numbers: dict[tuple, int] = {}
        groups = np.fromiter((numbers.setdefault(r[2:4], len(numbers)) for r in rows), np.int64, len(rows))
        parts = np.fromiter((r[4] for r in rows), np.int64, len(rows))
        crossed = np.fromiter((r[3] >> 31 != r[3] % (1 << 31) for r in rows), bool, len(rows))
        words, n = [r[5] for r in rows], np.fromiter((r[6] for r in rows), np.int64, len(rows))
        # What shares the first half, too, is found there.
        one, other = near_pairs(words, longest, groups, parts, crossed, longest // 2 if side else 0)
        order = np.lexsort((other, -n[other], one))
        one, other = one[order], other[order]
        first = np.flatnonzero(np.diff(one, prepend=-1))
        near = np.diff(first, append=len(one))
        return pa.RecordBatch.from_arrays([
            pa.array([words[i] for i in one[first]], pa.string()), pa.array(near, pa.int64()),
            pa.array([words[i] for i in other[first]], pa.string()), pa.array(n[other[first]], pa.int64())], schema=FOUND)

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            full = len(held) >= BLOCK_WORDS or len(held) * row[1] >= BLOCK_LETTERS
            if held and (row[:2] != held[-1][:2] or (full and row[2:4] != held[-1][2:4])):
                yield solved(held)
                held = []
            held.append(row)
    if held:
        yield solved(held)


def near_words(words: DataFrame, part_words: int = 1 << 13) -> DataFrame:
    """(word, near, form, form_n) of the words of (word, n) with a near word: how many they have and the
    one of largest n, first in code-point order.

    Near words, the longer of m letters, share the first m // 2 letters or the last
    m - m // 2: at most one letter of one half differs. So each word is in four groups. A group of more
    than ``part_words`` words (fewer where words are long) is cut in parts, and every two parts meet in
    a unit of their own, in any task.
    """
    length = F.length("word")
    halves = []
    for more in (0, 1):
        m = length + more
        head = F.floor(m / 2).cast("int")
        halves += [F.struct(F.lit(0).alias("side"), m.alias("longest"), F.left("word", head).alias("key")),
                   F.struct(F.lit(1).alias("side"), m.alias("longest"), F.right("word", m - head).alias("key"))]
    group = ("side", "longest", "key")
    dealt = words.select("word", "n", F.explode(F.array(*halves)).alias("g")).select("g.*", "word", "n")
    size = F.greatest(F.lit(64), F.least(F.lit(part_words), F.floor(F.lit(1 << 18) / F.col("longest"))))
    hot = dealt.groupBy(*group).count().filter(F.col("count") > size).select(
        *group, F.ceil(F.col("count") / size).cast("int").alias("parts"))
    cut = dealt.join(hot, list(group), "left")
    part = F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int")
    cut = cut.withColumn("part", part).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    unit = F.least("part", "other").cast("long") * F.lit(1 << 31) + F.greatest("part", "other")
    units = cut.select(*group, unit.alias("unit"), "part", "word", "n")
    sorted_units = units.repartition(*group, "unit").sortWithinPartitions(*group, "unit")
    found = sorted_units.mapInArrow(_variants, from_arrow_schema(FOUND))
    best = found.groupBy("word").agg(
        F.sum("near").alias("near"), F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("best"))
    return best.select("word", "near", F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last. A form is twice as frequent as its variant, so there
    is no circle, and as steps double, a few rounds do."""
    links = saved(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not links.filter("moved").isEmpty():
        up = links.select(F.col("word").alias("root"), F.col("root").alias("above"))
        links = saved(links.join(up, "root", "left").select(
            "word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
    return links.select("word", "root")


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one for each word of the vocabulary of ``docs``.

    ``form`` is the near word of largest n, if that is RATIO times the word's n, else
    null; ``root`` is the last form of a chain, the word itself without one. Null and
    empty texts have no words; a null id is written as nothing; repeated rows count
    again; a run of any length is one word; an empty table gives an empty result; other
    columns are ignored.
    """
    words = saved(vocabulary(docs, min_length, min_count))
    known = saved(words.join(near_words(words), "word", "left"))
    far = F.col("form_n") >= RATIO * F.col("n")
    formed = known.select("word", "n", F.coalesce("near", F.lit(0)).alias("n_near"), F.when(far, F.col("form")).alias("form"),
                          F.when(far, F.col("form_n")).alias("form_n"))
    roots = _roots(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
