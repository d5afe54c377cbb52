import re
from collections import Counter
from math import log
from zlib import crc32

from pyspark.sql import functions as F

from tests.compare import connect, difference
from tests.llm import rows
from trackloom.llm import quality_ratio
from trackloom.llm.quality_ratio import filter_quality, score_threshold, with_word_counts
from trackloom.llm.queries import QUERIES, SQL

LABELS = "doc_id long, quality int, toxic int"
WHITE = " \t\n\v\f\r"


def counts(text):
    text = text or ""
    words = [w for w in re.split(f"[{WHITE}]+", text) if w]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(words) < 10 or 100 * len(covered) > 20 * len(words))


def grams(text, buckets):
    tokens = re.findall("[a-z0-9_\x80-￿]+|[^ \t-\ra-z0-9_\x80-￿]+", (text or "").lower())
    h = [crc32(t.encode()) for t in tokens]
    return [a % buckets for a in h] + [(a * 1_000_003 + b) % buckets for a, b in zip(h, h[1:])]


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_against_sql(spark, folder):
    assert difference(QUERIES["op12_ngram_ratio"](spark, folder), connect(folder), SQL["op12_ngram_ratio"]) is None


def test_counts_on_hard_texts(spark):
    texts = [r[1] for r in rows.rows()] + [
        "a b c d e " * 3, "a a a a a a a", "a a a a a", "x\n\nx\n x\nx\r\n", "#*$%&|<> é ü 😀 #", "one two three four",
        "1 2 3 4 5 6 1 2 3 4 5 7 2 3 4 5 6 1", "w " * 30_000, "\n".join(f"line {k % 50}" for k in range(5000)),
        " ".join(f"u{k}" for k in range(20_000)), "  \x1c\x85 word\x00"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    found = {r.k: tuple(r[c] for c in NAMES) for r in with_word_counts(frame).collect()}
    for k, text in enumerate(texts):
        assert found[k] == counts(text), k


def test_against_brute_force(spark):
    good = [rows.PROSE + f"and number {k} of them went home" for k in range(80)]
    poor = [" ".join(w + "***" for w in rows.PROSE.split()[k % 7:]) + f" {k} $$$" for k in range(40)]
    table = [(k, t, None, None, 1) for k, t in enumerate(good + poor)] + rows.rows()
    labels = [(k, 1, 0) for k in range(60)] + [(k, 0, None) for k in range(80, 110)] + [(3, 1, 1), (None, 1, 0), (5, None, 0), (999, 1, 0)]
    frame = spark.createDataFrame(table, rows.DOCUMENTS)
    frame = frame.withColumns({c: F.lit("clash") for c in ("kind", "score", "words", "bucket", "row_key", "quality", "label_id")})
    labelled = spark.createDataFrame(labels, LABELS).withColumn("text", F.lit("clash"))
    buckets = 512
    found = filter_quality(frame.repartition(5), labelled.repartition(3), buckets=buckets).collect()
    assert len(found) == len(table)

    worst = {}
    for i, q, t in labels:
        if i is not None:
            before = worst.get(i, (None, 0))
            worst[i] = (min((x for x in (before[0], q) if x is not None), default=None), max(before[1], t or 0))
    kind = {i: "poor" if q == 0 else None if (q, t) != (1, 0) else "fit" if crc32(str(i).encode()) % 4 else "good"
            for i, (q, t) in worst.items()}
    raw, target = Counter(), Counter()
    for i, text, *_ in table:
        raw.update(grams(text, buckets))
        if kind.get(i) == "fit":
            target.update(grams(text, buckets))
    weight = [log((target[b] + 1) / (sum(target.values()) + buckets)) - log((raw[b] + 1) / (sum(raw.values()) + buckets))
              for b in range(buckets)]
    want = []
    for i, text, *_ in table:
        g = grams(text, buckets)
        want.append((i, *counts(text), sum(weight[b] for b in g) / len(g) if g else 0.0))
    key = lambda r: (str(r[0]), r[1:7], round(r[7], 6))
    assert sorted(map(key, want)) == sorted(map(key, ((r.doc_id, *(r[c] for c in NAMES), r.score) for r in found)))
    # Trusted texts stay and junk goes, also where there is no label.
    for r in found:
        if r.doc_id is not None and 20 < r.doc_id < 120:
            assert r.kept == (r.doc_id < 80)
        assert not (r.kept and r.base_failed)


def test_threshold(spark):
    made = lambda good, poor: spark.createDataFrame(
        [("good", s / 256) for s in good] + [("poor", s / 256) for s in poor], "kind string, score double")
    cut = lambda good, poor: score_threshold(made(good, poor)).first().step
    assert cut([10, 11, 12], [0, 1]) == 6 and cut([10], []) is None and cut([], [1]) is None
    assert cut([5, 5, 5, -9], [5, 0, 0]) == 3 and cut([0], [5]) == 0


def test_no_labels_and_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    found = filter_quality(rows.documents(spark), none).collect()
    assert found and all(r.kept != r.base_failed for r in found)
    assert filter_quality(rows.empty(spark), none).collect() == []


def test_samples_are_bounded(spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(4000)], LABELS)
    kinds = Counter(r.kind for r in quality_ratio._labelled(labels, 100, 30).collect())
    assert kinds == {"fit": 100, "good": 30, "poor": 30}


def test_plan_has_no_python(spark, folder):
    plan = QUERIES["op12_ngram_ratio"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_all_labelled_rows_count(spark):
    """No bound on the rows that fit, and the same scores whether their ids are broadcast or shuffled."""
    labels = spark.range(40_000).selectExpr("id AS doc_id", "CAST(id % 8 > 0 AS int) AS quality", "0 AS toxic")
    kinds = Counter(r.kind for r in quality_ratio._labelled(labels).select("kind").collect())
    assert kinds["fit"] > 20_000 and kinds["good"] > 5_000 and kinds["poor"] == 5_000 and sum(kinds.values()) == 40_000
    trusted = [crc32(str(k).encode()) % 4 > 0 for k in range(40_000)]
    texts = spark.range(40_000).selectExpr("id AS doc_id", "IF(id % 8 > 0, 'good', 'poor') AS text").unionByName(
        spark.createDataFrame([(None, "none")] * 3, "doc_id long, text string"))
    found = []
    for most in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            found.append(quality_ratio.bucket_weights(texts, quality_ratio._labelled(labels), "text", 64, 1.0).first()[0])
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    n = sum(trusted[k] for k in range(40_000) if k % 8)
    assert found[0] == found[1] and kinds["fit"] == n
    good, none = (crc32(w) % 64 for w in (b"good", b"none"))
    assert abs(found[0][good] - (log((n + 1) / (n + 64)) - log(35_001 / (40_003 + 64)))) < 1e-9
    assert abs(found[0][none] - (log(1 / (n + 64)) - log(4 / (40_003 + 64)))) < 1e-9


def test_only_texts_with_a_trusted_label_are_shuffled(spark):
    """Of 4,000 texts, with copies of ids and null ids, about the 30 that are trusted meet the labels."""
    kinds = spark.range(0, 4000, 200).selectExpr("id AS label_id", "'fit' AS kind").unionByName(
        spark.range(1, 4000, 200).selectExpr("id AS label_id", "'poor' AS kind"))
    texts = spark.range(4000).selectExpr("id AS doc_id", "CAST(id AS string) AS text").unionByName(
        spark.range(10).selectExpr("0L AS doc_id", "'again' AS text")).unionByName(
        spark.range(10).selectExpr("CAST(null AS long) AS doc_id", "'none' AS text"))
    marked = quality_ratio._with_trust(texts, "text", kinds)
    found = Counter((r.text, r.trusted) for r in marked.collect())
    wanted = Counter((str(k), "fit" if k % 200 == 0 else None) for k in range(4000))
    assert found == wanted + Counter({("again", "fit"): 10, ("none", None): 10})
    bits = quality_ratio._id_bits(kinds.filter("kind = 'fit'")).first()[0]
    assert len(bits) == quality_ratio.FILTER_BITS // 64 and 10 < sum((b & (1 << 64) - 1).bit_count() for b in bits) <= 20
