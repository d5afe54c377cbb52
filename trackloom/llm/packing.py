"""Cost-balanced packing of tokenized documents into sequences of a fixed capacity."""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
# Tokens that are packed together, and entries of a worker's cache of tokenized words.
SHARD_TOKENS = 1 << 20
CACHE_WORDS = 400_000
# Attention cost of a document of n tokens in a sequence: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY
PUNCTUATION = b".,;:!?*%&$#"


class WordIds(dict):
    """Ids of lower-case words, as bytes of 32-bit numbers; a missing word is tokenized.

    The tokenizer drops white space and splits between letters, digits and other signs,
    so the ids of a text are those of its words, and those of a word that ends in a letter
    and punctuation are those of both parts.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        # How the tokenizer writes bytes as letters: printable ones as themselves.
        self.letters = {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(rest)}}

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(PUNCTUATION)
        if core and len(core) < len(word) and core.decode()[-1].isalpha():
            ids = self[core] + self[word[len(core):]]
        elif not word.strip(PUNCTUATION) or word.decode().isalpha():
            # All letters or all punctuation: one piece, with nothing left to split.
            ids = _packed(t.id for t in self.model.tokenize("".join(map(self.letters.get, word))))
        else:
            ids = _packed(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        # Beyond Latin letters lower-casing and composition are left to the tokenizer, as
        # is all that could be the name of a special token.
        if "<|" in text or (not text.isascii() and max(text) > "\xff"):
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.__getitem__, text.lower().encode().split()))


def _packed(ids) -> bytes:
    return np.fromiter(ids, np.dtype("<u4")).tobytes()


def _word_ids(tokenizer: str) -> WordIds:
    """The cache of this worker process; it outlives a task, as workers are reused."""
    kept = sys.modules.setdefault("_trackloom_worker", types.ModuleType("_trackloom_worker"))
    known = kept.__dict__.setdefault("word_ids", {})
    if tokenizer not in known:
        from tokenizers import Tokenizer

        path = tokenizer
        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        known[tokenizer] = WordIds(Tokenizer.from_file(path))
    return known[tokenizer]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths.

    There are as many sequences as the tokens need at least. Whole sequences are cut off
    long documents; then the rests go, longest first, to the sequence of lowest cost that
    has room. A rest that fits nowhere fills the sequence with most room, and what is left
    of it goes on. So all sequences together are short of fewer than ``capacity`` tokens.
    """
    pieces, rests = [], []
    sequence = 0
    for document, length in enumerate(lengths):
        start = 0
        while length - start >= capacity:
            pieces.append((document, start, capacity, sequence, 0))
            sequence += 1
            start += capacity
        if start < length:
            rests.append((length - start, document, start))
    count = -(-sum(r[0] for r in rests) // capacity)
    used, cost = np.zeros(count, np.int64), np.zeros(count)
    for length, document, start in sorted(rests, key=lambda r: (-r[0], r[1])):
        while length:
            room = capacity - used
            open_ = room >= length
            if open_.any():
                place, part = int(np.where(open_, cost, np.inf).argmin()), length
            else:
                place = int(room.argmax())
                part = int(room[place])
            pieces.append((document, start, part, sequence + place, int(used[place])))
            used[place] += part
            cost[place] += LINEAR * part + QUADRATIC * part * part
            start, length = start + part, length - part
    return pieces


def _packer(tokenizer: str, capacity: int, end_id: int):
    schema = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids", pa.binary()), ("doc_tokens", pa.int64()),
                        ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = _word_ids(tokenizer)
        end = _packed([end_id])
        # Partition and count make the numbers of sequences unique without a shuffle.
        number = TaskContext.get().partitionId() << 36
        keys, ids, tokens = [], [], 0

        def shard() -> pa.RecordBatch:
            nonlocal number
            lengths = [len(i) // 4 for i in ids]
            pieces = sorted(pack(lengths, capacity), key=lambda p: (p[3], p[4]))
            columns = list(zip(*(
                (keys[d], s, n, ids[d][4 * s:4 * (s + n)], lengths[d], number + q, o)
                for d, s, n, q, o in pieces)))
            number += pieces[-1][3] + 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(key)
                ids.append(words.encode(text.as_py() or "") + end)
                tokens += len(ids[-1]) // 4
                if tokens >= SHARD_TOKENS:
                    yield shard()
                    keys, ids, tokens = [], [], 0
        if keys:
            yield shard()

    return packed


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Pieces (id, start, length, ids, doc_tokens, sequence_id, offset) of all documents.

    A document is the ids of its text without special tokens, and ``end_id``. Its pieces
    follow each other without gaps from ``start`` 0; ``ids`` are little-endian unsigned
    32-bit numbers. Sequences hold ``capacity`` tokens at most. Documents of one input
    partition are packed together, SHARD_TOKENS at a time, so nothing is shuffled, a task
    holds a bounded number of tokens beside one text, and a task that runs again gives the
    same rows.

    ``tokenizer`` is a path, or the name of a public tokenizer's file. Null and empty texts
    are the end id alone; a null id stays null; rows that share an id are packed apart;
    an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("key"), F.col(text_column).alias("text"))
    found = rows.mapInArrow(
        _packer(tokenizer, capacity, end_id),
        "key long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return found.withColumnRenamed("key", id_column)
