"""Passages that repeat across documents, located by Aho-Corasick automata.

Documents are dealt into blocks of a bounded size. Of every window of ``window`` words
one phrase is chosen by its content (the least hash), so equal windows choose equal
phrases. Phrases that more than one document holds are confirmed by their text, and each
block compiles automata of just the confirmed phrases that occur in it and streams its
documents through them. Only windows around an occurrence are compared across blocks.
"""

from __future__ import annotations

from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.words import Rolling, WordHasher, Words

# Bytes of text per block and phrases per automaton: both bound the memory of a task.
BLOCK_BYTES = 2 << 20
SHARD_PHRASES = 20_000
PHRASE_WORDS = 8


class _Windows:
    """Windows of the words of some documents: which are whole, and their hashes."""

    def __init__(self, window: int):
        self.window = window
        self.rolling = (Rolling(0xA24BAED4963EE407), Rolling(0x9FB21C651E98DF25))
        self.phrase = Rolling(0x8CB92BA72F3D8DD7)

    def whole(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows that lie in one document, and their documents."""
        counts = np.maximum(np.diff(words.first) - self.window + 1, 0)
        doc = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        return words.first[doc] + at, doc

    def hashes(self, words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of each window: 64 in the first array and 32 in the second."""
        h1, h2 = (r.ranges(r.prefix(h), at, at + self.window).view(np.int64)
                  for r, h in zip(self.rolling, (words.h1, words.h2)))
        return h1, h2 >> 32

    def chosen(self, words: Words, at: np.ndarray) -> np.ndarray:
        """The first word of the phrase that each window chooses, the leftmost least hash."""
        n = len(words.h1) - PHRASE_WORDS + 1
        begin = np.arange(max(n, 0))
        value = self.phrase.ranges(self.phrase.prefix(words.h1), begin, begin + PHRASE_WORDS)
        # Minima over 2 ** k phrases by doubling; two of them cover a window's phrases.
        span, place = 1, begin
        width = self.window - PHRASE_WORDS + 1
        while span * 2 <= width:
            left, right = place[:len(place) - span], place[span:]
            place = np.where(value[right] < value[left], right, left)
            span *= 2
        left, right = place[at], place[at + width - span]
        return np.where(value[right] < value[left], right, left)


def _text(words: Words, begin: int, end: int) -> str:
    return b" ".join(words.data[words.starts[begin]:words.ends[end - 1]].tobytes().split()).decode()


def _phrases(window: int):
    """A block's documents to its distinct chosen phrases, with the least and largest id."""

    def phrases(docs: pa.Table) -> pa.Table:
        hasher, windows = WordHasher(), _Windows(window)
        number = docs["block"][0].as_py()
        docs = docs.filter(pc.is_valid(docs["node"]))
        found, owner = [], []
        for begin, end, words in hasher.chunks(docs["text"].combine_chunks()):
            at, doc = windows.whole(words)
            if not len(at):
                continue
            place, first = np.unique(windows.chosen(words, at), return_index=True)
            found += [_text(words, p, p + PHRASE_WORDS) for p in place]
            owner.append(docs["node"].to_numpy()[begin:end][doc[first]])
        owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        table = pa.table({"phrase": pa.array(found, pa.string()), "node": pa.array(owner, pa.int64())})
        table = table.group_by("phrase").aggregate([("node", "min"), ("node", "max")])
        block = pa.array(np.full(table.num_rows, number), pa.int64())
        return pa.table({"phrase": table["phrase"], "block": block,
                         "low": table["node_min"], "high": table["node_max"]})

    return phrases


def _occurrences(shards: list, words: Words, doc: int, located: np.ndarray) -> None:
    """Mark the first word of every occurrence of a phrase in one document."""
    begin, end = words.first[doc], words.first[doc + 1]
    if end - begin < PHRASE_WORDS:
        return
    text = f" {_text(words, begin, end)} "
    last = np.fromiter((e for shard in shards for e, _ in shard.iter(text)), np.int64)
    if len(last):
        blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
        located[begin + np.searchsorted(blanks, last) - PHRASE_WORDS] = True


def _recurring(window: int):
    """A block and its confirmed phrases to the distinct windows around occurrences."""

    def recurring(docs: pa.Table, confirmed: pa.Table) -> pa.Table:
        hasher, windows = WordHasher(), _Windows(window)
        number = docs["block"][0].as_py() if docs.num_rows else 0
        docs = docs.filter(pc.is_valid(docs["node"]))
        patterns = confirmed["phrase"].to_pylist() if docs.num_rows else []
        shards = []
        for begin in range(0, len(patterns), SHARD_PHRASES):
            shard = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for phrase in patterns[begin:begin + SHARD_PHRASES]:
                shard.add_word(f" {phrase} ")
            shard.make_automaton()
            shards.append(shard)
        parts = [np.zeros((3, 0), np.int64)]
        for begin, end, words in hasher.chunks(docs["text"].combine_chunks()) if shards else ():
            at, doc = windows.whole(words)
            if not len(at):
                continue
            located = np.zeros(len(words.h1) + 1, bool)
            for d in np.unique(doc):
                _occurrences(shards, words, d, located)
            near = located[windows.chosen(words, at)]
            at, doc = at[near], doc[near]
            node = docs["node"].to_numpy()[begin:end][doc]
            parts.append(np.stack([*windows.hashes(words, at), node]))
        h1, h2, node = np.concatenate(parts, 1)
        order = np.lexsort((node, h2, h1))
        h1, h2, node = h1[order], h2[order], node[order]
        new = np.concatenate([[True], (np.diff(h1) != 0) | (np.diff(h2) != 0)])[:len(h1)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(h1)) - 1 if len(h1) else first
        return pa.table({"h1": h1[first], "h2": h2[first].astype(np.int32), "block": np.full(len(first), number),
                         "low": node[first], "high": node[last]})

    return recurring


def _stripper(window: int):
    """A block and its recurring windows (h1, h2, first document) to the words that stay."""

    def strip(docs: pa.Table, seen: pa.Table) -> pa.Table:
        hasher, windows = WordHasher(), _Windows(window)
        order = np.argsort(seen["h1"].to_numpy())
        k1, k2, low = (seen[c].to_numpy()[order] for c in ("h1", "h2", "low"))
        n_words, n_removed, texts, spans = [], [], [], []
        for begin, end, words in hasher.chunks(docs["text"].combine_chunks()):
            removed = np.zeros(len(words.h1) + 1, np.int64)
            at, doc = windows.whole(words)
            ids = docs["node"].slice(begin, end - begin).combine_chunks()
            if len(at) and len(k1):
                h1, h2 = windows.hashes(words, at)
                place = np.minimum(np.searchsorted(k1, h1), len(k1) - 1)
                node = ids.fill_null(np.iinfo(np.int64).min).to_numpy()[doc]
                hit = (k1[place] == h1) & (k2[place] == h2) & (low[place] < node)
                np.add.at(removed, at[hit], 1)
                np.add.at(removed, at[hit] + window, -1)
            gone = np.cumsum(removed)[:-1] > 0
            for row in range(end - begin):
                first, last = words.first[row], words.first[row + 1]
                kept = words.data[words.starts[first]:words.ends[last - 1]].tobytes().split() if last > first else []
                mine = gone[first:last]
                count = int(mine.sum())
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
                n_words.append(last - first)
                n_removed.append(count)
                spans.append(edges)
                texts.append(b" ".join(compress(kept, ~mine) if count else kept))
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int32)
        flat = np.concatenate(spans).astype(np.int64) if spans else np.zeros(0, np.int64)
        return pa.table({
            "node": docs["node"], "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
            "removed": pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))})

    return strip


def remove_repeats(
    docs: DataFrame, window: int = 50, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row (id, n_words, n_removed, kept_text, removed) for each row of ``docs``.

    Words are runs of other than white space. A word is removed if a window of ``window``
    consecutive words covers it whose word sequence also starts in a document with a
    smaller id; windows are judged on the input. ``kept_text`` has the other words joined
    by one space, ``removed`` the first and end word of each removed range in turn.

    Null and empty texts have no words. Rows that share an id are no repeats of each
    other. Rows with a null id lose nothing and count for nothing. An empty table gives an
    empty result; other columns are ignored. ``window`` must be at least 8.
    """
    if window < PHRASE_WORDS:
        raise ValueError(f"window must be at least {PHRASE_WORDS} words")
    total = docs.select(F.sum(F.octet_length(text_column))).first()[0] or 0
    blocks = max(1, total // BLOCK_BYTES)
    node = F.col(id_column).cast("long")
    # All three passes read this one shuffle. The text is part of the key, so rows of one id,
    # or of none, spread as well.
    dealt = docs.select(F.pmod(F.xxhash64(node, F.col(text_column)), F.lit(blocks)).alias("block"), node.alias("node"),
                        F.col(text_column).alias("text")).repartition("block")
    phrases = dealt.groupBy("block").applyInArrow(
        _phrases(window), "phrase string, block long, low long, high long")
    # At most one row of a phrase, and later of a window, for each block.
    same = Window.partitionBy("phrase")
    patterns = phrases.withColumns({"a": F.min("low").over(same), "b": F.max("high").over(same)}).filter(
        "a < b").select("block", "phrase")
    near = dealt.groupBy("block").cogroup(patterns.groupBy("block")).applyInArrow(
        _recurring(window), "h1 long, h2 int, block long, low long, high long")
    same = Window.partitionBy("h1", "h2")
    seen = near.withColumn("least", F.min("low").over(same)).filter("least < high").select(
        "block", "h1", "h2", F.col("least").alias("low"))
    out = dealt.groupBy("block").cogroup(seen.groupBy("block")).applyInArrow(
        _stripper(window),
        "node long, n_words long, n_removed long, kept_text string, removed array<long>")
    return out.withColumnRenamed("node", id_column)
