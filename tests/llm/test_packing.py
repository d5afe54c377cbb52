import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trackloom.llm import packing
from trackloom.llm.packing import pack, pack_documents
from trackloom.llm.queries import pieces_with_checks
from tests.llm import rows

TOKENIZER = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
WORDS = packing.WordIds(TOKENIZER)


@settings(max_examples=300, deadline=None)
@given(st.one_of(
    st.text(max_size=40), st.text("abZÉßñ.,;:!?*%&$#'\"- \n\t0129<|>\xa0\x85\x1c×÷ªµ", max_size=40),
    st.sampled_from(["it's", "<|endoftext|>", "<|ENDOFTEXT|> x", "İstanbul ΣΑΣ", "é é", "don't,", "''", "a<|b"])))
def test_ids_are_those_of_the_tokenizer(text):
    wanted = np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert WORDS.encode(text) == wanted


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_pack_is_complete_and_tight(lengths):
    pieces = pack(lengths, 64)
    covered = {d: [] for d in range(len(lengths))}
    used = {}
    for d, start, length, sequence, offset in pieces:
        covered[d].append((start, length))
        used.setdefault(sequence, []).append((offset, length))
    for d, parts in covered.items():
        ends = 0
        for start, length in sorted(parts):
            assert start == ends and length > 0
            ends += length
        assert ends == lengths[d]
    for parts in used.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 64
    assert len(used) == -(-sum(lengths) // 64)


def test_costs_are_balanced():
    lengths = [900] * 4 + [100] * 36 + [300] * 12
    cost = {}
    for _, _, n, sequence, _ in pack(lengths, 2048):
        cost[sequence] = cost.get(sequence, 0) + n + n * n / 2048
    first_fit = 2 * (900 + 900**2 / 2048) + 2 * (100 + 100**2 / 2048)
    assert max(cost.values()) < 1.3 * min(cost.values()) and max(cost.values()) < first_fit + 300


@pytest.mark.parametrize("shard", [1, 3000, 1 << 20])
def test_documents(spark, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD_TOKENS", shard)
    frame = rows.documents(spark)
    got = pieces_with_checks(pack_documents(frame)).collect()
    texts = [(r.doc_id, TOKENIZER.encode(r.text or "", add_special_tokens=False).ids + [1])
             for r in frame.select("doc_id", "text").collect()]
    assert sum(r.length for r in got) == sum(len(ids) for _, ids in texts)
    by_id = {i: ids for i, ids in texts if i not in (None, 14, 15)}
    for r in got:
        if r.doc_id in by_id:
            ids = np.array(by_id[r.doc_id], "<u4")[r.start:r.start + r.length]
            assert zlib.crc32(ids.tobytes()) == r.ids_crc32 and r.doc_tokens == len(by_id[r.doc_id])
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
    assert pack_documents(rows.empty(spark)).collect() == []
