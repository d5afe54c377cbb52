import math

from tests.compare import connect, difference
from trackloom.llm.pareto import pareto_mix
from trackloom.llm.queries import QUERIES, SQL
from tests.llm import rows


def test_against_sql(spark, folder):
    assert difference(QUERIES["op7_pareto_mix"](spark, folder), connect(folder), SQL["op7_pareto_mix"]) is None


def test_targets_and_sizes(spark):
    frame = rows.documents(spark, [(1000 + k, "w " * (k % 7 + 1), None, f"s{k % 5}", 1) for k in range(400)])
    got = pareto_mix(frame).collect()
    assert len(got) == frame.count()
    sizes, taken, target = {}, {}, {}
    for r in got:
        assert r.size == len((r.text or "").encode().split()) and r.taken in (0, r.size, 2 * r.size)
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    whole, want, free = 1.5 * sum(sizes.values()), {}, set(order)
    while True:  # share by weight, cap, share the excess again
        level = (whole - sum(want.values())) / max(1e-9, sum(weight[s] for s in free))
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        want.update({s: 2.0 * sizes[s] for s in full})
        free -= full
    want.update({s: level * weight[s] for s in free})
    for s in order:
        assert math.isclose(target[s], want[s], rel_tol=1e-9, abs_tol=1e-6)
        largest = max(r.size for r in got if r.source == s)
        assert abs(taken[s] - target[s]) <= largest


def test_reruns_weights_and_cases(spark):
    frame = rows.documents(spark)
    runs = [sorted((str(r.doc_id), r.size, r.taken) for r in pareto_mix(f).collect()) for f in (frame, frame.repartition(7))]
    assert runs[0] == runs[1]
    assert pareto_mix(rows.empty(spark)).collect() == []
    many = [(k, "a b c", None, "s", k % 2) for k in range(2000)]
    got = pareto_mix(spark.createDataFrame(many, rows.DOCUMENTS), share=0.4, weights=(1,), weight_column="n_chars").collect()
    light = sum(r.copies for r in got if not r.n_chars)
    assert abs(sum(r.taken for r in got) - 0.4 * 6000) <= 3 and light == 0
