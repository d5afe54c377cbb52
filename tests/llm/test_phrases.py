import random

import pytest
from pyspark.sql import functions as F

from trackloom.llm import phrases
from trackloom.llm.phrases import remove_repeats
from tests.llm import rows


def check(frame, window):
    given = sorted((r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect() if r.doc_id is not None)
    first = {}
    for i, text in given:
        words = text.encode().split()
        for k in range(len(words) - window + 1):
            first.setdefault(tuple(words[k:k + window]), i)
    wanted = []
    for i, text in given:
        words = text.encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if first[tuple(words[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g).decode()
        wanted.append((i, len(words), sum(gone), kept))
    got = remove_repeats(frame, window).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got if r.doc_id is not None) == sorted(wanted)
    for r in got:
        assert sum(b - a for a, b in zip(r.removed[::2], r.removed[1::2])) == r.n_removed
        assert r.doc_id is not None or r.n_removed == 0


@pytest.mark.parametrize("block", [1 << 12, 1 << 21])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    dice = random.Random(block)
    passages = [[f"p{k}w{dice.randrange(60)}" for _ in range(dice.randrange(45, 90))] for k in range(6)]
    texts = []
    for k in range(60):
        words = [f"x{dice.randrange(3000)}" for _ in range(dice.randrange(0, 80))]
        for passage in dice.sample(passages, 2):
            cut = dice.randrange(0, 12)
            words += passage[cut:] + [f"y{k}"]
        texts.append(dice.choice([" ", "\n", " \t"]).join(words))
    texts += [texts[3], texts[3], "a " * 300, "a " * 200]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    check(frame, 50)
    check(frame, 12)


@pytest.mark.parametrize("shared", ["NULL", "7L"])
def test_rows_of_one_id_are_dealt_to_many_blocks(spark, monkeypatch, shared):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 1 << 12)
    text = "concat_ws(' ', transform(sequence(0, 99), k -> hash(id % 300, k, id = 299)))"
    frame = spark.range(400).selectExpr(f"CASE WHEN id < 300 THEN {shared} ELSE id END AS doc_id", f"{text} AS text")
    check(frame.cache(), 50)
    out = remove_repeats(frame)
    parts = out.filter(f"doc_id <=> {shared}").select(F.spark_partition_id()).distinct()
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        assert parts.count() > 1
    finally:
        spark.conf.set(coalesce, before)


def test_cases(spark):
    check(rows.documents(spark), 50)
    assert remove_repeats(rows.empty(spark)).collect() == []
    with pytest.raises(ValueError):
        remove_repeats(rows.empty(spark), window=5)
