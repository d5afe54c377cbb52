import os
import random
import time

from trackloom.llm.components import SHUFFLE_CLEANUP, connected_components, saved
from trackloom.llm.minhash_join import LONG, _tile_pairs, near_duplicates
from tests.llm import rows


def shingles(text, n):
    words = (text or "").encode().lower().split()
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(n))))


def smallest(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def check(frame, n, percent, **more):
    given = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    sets = [(i, shingles(t, n)) for i, t in given if i is not None]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k]
             if x and 100 * len(x & y) >= percent * len(x | y)]
    label = smallest({i for i, _ in sets}, links)
    got = near_duplicates(frame, shingle=n, percent=percent, **more).collect()
    assert len(got) == len(given)
    for r in got:
        assert r.component_id == (label[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is None or r.component_id == r.doc_id)
    assert sorted((r.doc_id or 0, r.n_shingles) for r in got) == sorted(
        (i or 0, len(shingles(t, n))) for i, t in given)


def test_cases(spark):
    check(rows.documents(spark), 5, 80)
    assert near_duplicates(rows.empty(spark)).collect() == []


def test_random_edits_and_hot_group(spark):
    dice = random.Random(3)
    base = [f"w{dice.randrange(400)}" for _ in range(120)]
    texts = []
    for k in range(LONG * 3):
        words = list(base)
        for _ in range(dice.randrange(0, 8)):
            words[dice.randrange(len(words))] = f"e{dice.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"u{dice.randrange(10**6)}" for _ in range(60)) for _ in range(50)]
    texts += [texts[0].upper()] * 40
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    check(frame, 3, 85)
    check(frame, 5, 80)


def test_components(spark):
    dice = random.Random(5)
    links = [(dice.randrange(300), dice.randrange(300)) for _ in range(200)]
    links += [(k, k + 1) for k in range(400, 460)] + [(999, k) for k in range(500, 560)]
    frame = spark.createDataFrame(links + [(None, 4), (5, None)], "a long, b long")
    label = smallest({n for link in links for n in link}, links)
    got = {r.node: r.component for r in connected_components(frame).collect()}
    assert got == {n: label[n] for a, b in links if a != b for n in (a, b)}
    assert connected_components(frame.limit(0)).collect() == []


def test_lost_check_sums_do_not_lose_a_pair():
    import numpy as np
    import pyarrow as pa

    # 1000 shingles each, 890 common: above 80 %. Ten of the common ones lost their check sums.
    sets = [np.arange(990), np.concatenate([np.arange(880), np.arange(2000, 2110)])]
    table = pa.table({
        "key": [1, 1], "i": [0, 0], "j": [0, 0], "side": [0, 0], "node": [5, 6], "component": [5, 6],
        "n_shingles": [1000, 1000], "sketch": [b"\1" * 256] * 2,
        "members": [s.astype(np.uint32).tobytes() for s in sets], "keys": [[1], [1]]})
    assert _tile_pairs(80)(table).to_pylist() == [{"a": 6, "b": 5}]


def test_shared_ids_with_unlike_texts(spark):
    dice = random.Random(11)
    a, b = ([f"{x}{dice.randrange(10**6)}" for _ in range(80)] for x in "ab")
    texts = [(1, a), (1, b), (1, b), (2, [*a, "more"]), (3, [*b, "more"]), (9, ["alone"]), (9, []), (None, a),
             (0, [*b, "other"]), (8, ["far", *map(str, range(40))])]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string").repartition(3)
    check(frame, 3, 85)
    got = {r.doc_id: r.component_id for r in near_duplicates(frame, shingle=3, percent=85).collect()}
    assert got == {None: None, 0: 0, 1: 0, 2: 0, 3: 0, 8: 8, 9: 9}


def test_recall_at_the_threshold(spark):
    # 37 shingles each, 34 of 40 common: exactly 85 percent.
    dice = random.Random(13)
    rows = []
    for k in range(5000):
        words = [f"w{dice.randrange(10**9)}" for _ in range(39)]
        rows.append((2 * k, " ".join(words)))
        rows.append((2 * k + 1, " ".join([*words[:36], *(f"e{dice.randrange(10**9)}" for _ in range(3))])))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_duplicates(frame, shingle=3, percent=85).collect()
    linked = sum(r.doc_id % 2 == 1 and r.component_id == r.doc_id - 1 for r in got)
    assert linked >= 4995 and all(r.component_id == r.doc_id for r in got if r.doc_id % 2 == 0)


def shuffled(spark):
    """Numbers of the shuffles that have files."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    names = [n for top in folders for _, _, found in os.walk(top) for n in found]
    return {int(n.split("_")[1]) for n in names if n.startswith("shuffle_")}


def left_of(spark, before, most):
    """New shuffles with files; as removal is not waited for, after up to 20 seconds."""
    for _ in range(100):
        if len(left := shuffled(spark) - before) <= most:
            break
        time.sleep(0.2)
    return left


def test_saved_rows_leave_no_shuffle_files(spark):
    was, before = spark.conf.get(SHUFFLE_CLEANUP), shuffled(spark)
    frame = spark.range(1000).selectExpr("id % 7 AS k", "id").groupBy("k").count()
    out = saved(frame)
    assert not left_of(spark, before, 0)
    assert spark.conf.get(SHUFFLE_CLEANUP) == was
    expected = sorted((k, 143 - (k == 6)) for k in range(7))
    for _ in range(2):
        assert sorted(map(tuple, frame.collect())) == sorted(map(tuple, out.collect())) == expected
    assert sorted(map(tuple, saved(frame.unionAll(frame)).collect())) == sorted(expected * 2)


def test_steps_do_not_add_up_on_disk(spark):
    """What stays are the two sums that number the bundles and what the last step reads."""
    before = shuffled(spark)
    got = near_duplicates(rows.documents(spark), shingle=5, percent=80)
    assert len(left_of(spark, before, 4)) <= 4
    assert got.count() == rows.documents(spark).count()
