import random
import re
from collections import Counter
from zlib import crc32

from pyspark.sql import functions as F

from tests.compare import connect, difference
from tests.llm import rows
from trackloom.llm.queries import QUERIES, SQL
from trackloom.llm.spelling import near_words, spelling_variants, vocabulary


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def words_of(table):
    total = Counter()
    for doc_id, text, *_ in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        if found:
            best = min(found, key=lambda v: (-words[v], v))
            if words[best] >= 2 * words[w]:
                form[w] = best
    out = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out[w] = (f, root, words[w], len(near[w]), words.get(f))
    return out


def got(frame):
    found = frame.collect()
    assert len({r.word for r in found}) == len(found)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found}


def test_against_sql(spark, folder):
    assert difference(QUERIES["op13_bit_sliced_variants"](spark, folder), connect(folder), SQL["op13_bit_sliced_variants"]) is None


def test_against_brute_force(spark):
    generator, table = random.Random(3), []
    base = ["".join(generator.choice("abcdéÿ") for _ in range(generator.randint(5, 9))) for _ in range(60)]
    for doc in range(150):
        picked = []
        for _ in range(60):
            w = generator.choice(base[:30] if generator.random() < .7 else base)
            i = generator.randrange(len(w))
            w = generator.choice((w, w, w[:i] + w[i + 1:], w[:i] + "b" + w[i + 1:], w[:i] + "e" + w[i:], w.upper()))
            picked.append(w)
        table.append((doc if doc % 10 else None, generator.choice((" ", ", ", "1", "Ā")).join(picked), None, None, None))
    table += rows.rows() * 3 + [(9000 + k, "y" * 20_000 + " " + "y" * (20_000 - k % 3), None, None, None) for k in range(12)]
    frame = spark.createDataFrame(table, rows.DOCUMENTS).withColumns({c: F.lit("x") for c in ("word", "n", "key", "side", "form")})
    want = words_of(table)
    assert {r.word: r.n for r in vocabulary(frame.repartition(4)).collect()} == want
    found = got(spelling_variants(frame.repartition(7)))
    assert found == variants(want)
    assert sum(f[0] is not None for f in found.values()) > 20 and any(f[0] != f[1] for f in found.values() if f[0])


def test_hot_group_is_cut_in_parts(spark):
    generator = random.Random(4)
    words = {"pre" * 4 + "".join(generator.choice("abc") for _ in range(generator.randint(5, 7))): generator.randint(3, 99)
             for _ in range(1500)}
    words |= {"".join(generator.choice("ab") for _ in range(7)) + "suffixsuffix": 5 for _ in range(100)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    expected = {w: [v for v in words if one_edit(w, v)] for w in words}
    expected = {w: (len(f), min(f, key=lambda v: (-words[v], v))) for w, f in expected.items() if f}
    for size in (64, 300, 8192):
        assert {r.word: (r.near, r.form) for r in near_words(frame, size).collect()} == expected


def test_empty_table(spark):
    assert got(spelling_variants(rows.empty(spark))) == {}
