"""Quality of texts as a log-likelihood ratio of hashed n-grams, in Spark expressions only.

Tokens are runs of letters, digits and signs beyond ASCII, and runs of the other ASCII
signs, in lower case. Tokens
and pairs of neighbours are hashed to a fixed number of buckets. A bucket's weight is
the log of its share among trusted texts over its share in the whole corpus; a text's
score is the mean weight of its n-grams, and texts below a threshold go.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.components import saved
from trackloom.llm.words import SPACES

BUCKETS = 1 << 14
SMOOTHING = 1.0
# Scores are compared with the threshold in steps of 1 / STEPS, within these bounds.
STEPS, FARTHEST = 256, 8192
# Bits of the array that tells ids without a trusted label: 1 MB, whatever their number.
FILTER_BITS = 1 << 23
MIN_WORDS, MAX_REPEATED = 10, 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
TOKEN = r"[a-z0-9_\x80-\x{FFFF}]+|[^\x20\x09-\x0Da-z0-9_\x80-\x{FFFF}]+"
WHITE = SPACES.decode()


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated(words: Column) -> Column:
    """How many words lie in windows of WINDOW words that occur twice or more.

    Check sums of windows tell texts without a repeat; the others compare the windows.
    ``words`` has to be a variable of a lambda, so that it is computed once.
    """
    places = F.sequence(F.lit(0), F.size(words) - WINDOW)
    sums = F.transform(places, lambda i: F.xxhash64(*[words[i + k] for k in range(WINDOW)]))

    def covered(windows: Column) -> Column:
        # Sorted by content, then place: a repeat stands beside its like.
        like = lambda i, j: F.get(windows, i)["window"] == F.get(windows, j)["window"]
        found = F.filter(F.sequence(F.lit(0), F.size(windows) - 1), lambda i: (
            F.coalesce(like(i, i - 1), F.lit(False)) | F.coalesce(like(i, i + 1), F.lit(False))))
        sorted_places = F.sort_array(F.transform(found, lambda i: windows[i]["place"]))
        begin = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(sorted_places, begin, lambda a, p: F.struct(
            p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")))["n"]

    windows = F.sort_array(F.transform(places, lambda i: F.struct(
        F.concat_ws(" ", *[words[i + k] for k in range(WINDOW)]).alias("window"), i.alias("place"))))
    some = _let(sums, lambda s: F.size(F.array_distinct(s)) < F.size(s))
    return F.when((F.size(words) < WINDOW) | ~some, 0).otherwise(_let(windows, covered)).cast("long")


def with_word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed beside those
    of ``docs``. A null text is empty. Every count is of the whole text."""
    body = F.coalesce(F.col(text), F.lit(""))
    whole = docs.withColumn("words", F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.ltrim(x, F.lit(WHITE)) != "")
    symbols = [F.length(body) - F.length(F.replace(body, F.lit(s), F.lit(""))) for s in SYMBOLS]
    counted = whole.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": reduce(add, symbols).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _let(F.col("words"), _repeated)}).drop("words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _grams(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """One row for each token: the bucket of the token and of its pair with the next, which
    the last token has not. Texts without a token have one row of nulls."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))
    listed = docs.withColumn("tokens", tokens).withColumn(
        "place", F.explode_outer(F.when(F.size("tokens") > 0, F.sequence(F.lit(0), F.size("tokens") - 1))))
    here, following = (F.crc32(F.get("tokens", F.col("place") + k).cast("binary")) for k in (0, 1))
    return listed.withColumns({
        "single": F.pmod(here, F.lit(buckets)),
        "pair": F.pmod(here * 1_000_003 + following, F.lit(buckets))}).drop("tokens", "place")


def _labelled(labels: DataFrame, fit_rows: int | None = None, threshold_rows: int | None = None) -> DataFrame:
    """(label_id, kind) of all labelled ids, or of as many as asked for, told apart by the check sum of the
    id: ``fit`` and ``good`` rows are trusted, ``poor`` ones are not. An id with several labels has the
    worst of them."""
    worst = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(
        F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    draw = F.crc32(F.col("label_id").cast("string").cast("binary"))
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    kind = F.when(F.col("quality") == 0, "poor").when(good & (draw % 4 == 0), "good").when(good, "fit")
    told = worst.select("label_id", draw.alias("draw"), kind.alias("kind")).filter("kind IS NOT NULL")
    if fit_rows is None and threshold_rows is None:
        return saved(told.select("label_id", "kind"))
    found = []
    for one, rows in (("fit", fit_rows), ("good", threshold_rows), ("poor", threshold_rows)):
        chosen = told.filter(F.col("kind") == one)
        found.append(chosen if rows is None else chosen.orderBy("draw", "label_id").limit(rows))
    return saved(reduce(DataFrame.unionByName, found).select("label_id", "kind"))


def _id_bits(ids: DataFrame) -> DataFrame:
    """One row (bits): an array of FILTER_BITS bits, those of the check sums of all ids being set."""
    place = F.pmod(F.xxhash64("label_id"), F.lit(FILTER_BITS))
    words = ids.select(F.shiftright(place, 6).alias("slot"), F.call_function(
        "shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    words = words.groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    whole = ids.sparkSession.range(FILTER_BITS >> 6).withColumnRenamed("id", "slot").join(words, "slot", "left")
    row = whole.agg(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("all"))
    return row.select(F.col("all.bits").alias("bits"))


def _with_trust(rows: DataFrame, text: str, kinds: DataFrame) -> DataFrame:
    """The texts of ``rows`` and ``trusted``, which is null unless the id has the kind ``fit``.

    Only rows whose id may have it, by a bit array of bounded size, are shuffled to the kinds;
    the others, and rows without an id, stay where they are read.
    """
    fit = kinds.filter("kind = 'fit'")
    table = saved(_id_bits(fit)).scalar()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    word = F.call_function("shiftright", F.get(table, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int"))
    maybe = F.col("doc_id").isNotNull() & (word.bitwiseAND(F.lit(1)) != 0)
    asked = rows.filter(maybe).select("doc_id", text).join(
        fit.withColumnsRenamed({"label_id": "doc_id"}).hint("merge"), "doc_id", "left")
    spared = rows.filter(~maybe).select(text, F.lit(None).cast("string").alias("trusted"))
    return asked.select(text, F.col("kind").alias("trusted")).unionByName(spared)


def bucket_weights(docs: DataFrame, kinds: DataFrame, text: str, buckets: int, smoothing: float) -> DataFrame:
    """One row with an array of the weights of all buckets."""
    marked = _with_trust(docs, text, kinds)
    grams = _grams(marked, text, buckets)
    each = grams.select("trusted", F.explode(F.array("single", "pair")).alias("bucket")).filter("bucket IS NOT NULL")
    counts = each.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
    whole = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(counts, "bucket", "left")
    # As many rows as buckets: the array and the sums are bounded.
    row = whole.agg(F.array_sort(F.collect_list(F.struct(
        "bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")))).alias("all"),
        F.coalesce(F.sum("raw"), F.lit(0)).alias("raws"), F.coalesce(F.sum("target"), F.lit(0)).alias("targets"))
    rest = smoothing * buckets
    return row.select(F.transform("all", lambda x: (
        F.log((x["target"] + smoothing) / (F.col("targets") + rest))
        - F.log((x["raw"] + smoothing) / (F.col("raws") + rest)))).alias("weights"))


def _scored(docs: DataFrame, weights: DataFrame, text: str, buckets: int) -> DataFrame:
    """The columns of ``docs`` but for the text, and score, the mean weight of the n-grams. A
    row is a group of its own: its tokens are summed where they are read."""
    known = [c for c in docs.columns if c != text]
    grams = _grams(docs.withColumn("row_key", F.monotonically_increasing_id()), text, buckets)
    table = weights.scalar()
    weight = lambda c: F.coalesce(F.get(table, F.col(c)), F.lit(0.0))
    scored = grams.groupBy("row_key", *known).agg(
        F.sum(weight("single") + weight("pair")).alias("whole"), (F.count("single") + F.count("pair")).alias("grams"))
    score = F.when(F.col("grams") > 0, F.col("whole") / F.col("grams")).otherwise(0.0)
    return scored.select(*known, score.alias("score"))


def score_threshold(scores: DataFrame) -> DataFrame:
    """One row (step): the step of scores that parts ``good`` from ``poor`` rows best, the middle
    one where several do; null if either kind is missing."""
    step = F.greatest(F.least(F.floor(F.col("score") * STEPS), F.lit(FARTHEST)), F.lit(-FARTHEST))
    counts = scores.groupBy(step.alias("step")).agg(
        F.count(F.when(F.col("kind") == "good", 1)).alias("good"), F.count(F.when(F.col("kind") == "poor", 1)).alias("poor"))
    # At most 2 * FARTHEST + 1 rows, so one array.
    row = counts.filter("good + poor > 0").agg(F.array_sort(F.collect_list(F.struct("step", "good", "poor"))).alias("all"),
                     F.sum("good").alias("goods"), F.sum("poor").alias("poors"))
    begin = F.struct(F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("poor"),
                     F.lit(-1).cast("long").alias("most"), F.lit(0).cast("long").alias("low"),
                     F.lit(0).cast("long").alias("high"), F.lit(False).alias("open"))

    def put(a: Column, x: Column) -> Column:
        # Cuts right before x: those from the step after the last one on.
        value = (F.col("goods") - a["good"]) * F.col("poors") + a["poor"] * F.col("goods")
        better = value > a["most"]
        return F.struct((a["good"] + x["good"]).alias("good"), (a["poor"] + x["poor"]).alias("poor"),
                        F.greatest(a["most"], value).alias("most"),
                        F.when(better, F.coalesce(x["before"] + 1, x["step"])).otherwise(a["low"]).alias("low"),
                        F.when(better, x["step"]).otherwise(a["high"]).alias("high"), F.lit(True).alias("open"))

    listed = F.transform("all", lambda x, i: F.struct(
        x["step"].alias("step"), x["good"].alias("good"), x["poor"].alias("poor"),
        F.get("all", i - 1)["step"].alias("before")))
    best = row.select(F.aggregate(listed, begin, put).alias("best"), "goods", "poors")
    return best.select(F.when((F.col("goods") > 0) & (F.col("poors") > 0), F.floor(
        (F.col("best.low") + F.col("best.high")) / 2)).alias("step"))


def filter_quality(
    docs: DataFrame, labels: DataFrame, text: str = "text", buckets: int = BUCKETS, fit_rows: int | None = None,
    threshold_rows: int | None = None, smoothing: float = SMOOTHING,
) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score,
    kept), one for each row of ``docs``.

    ``labels`` has (doc_id, quality, toxic); trusted texts have quality 1 and are not
    toxic. Three quarters of them, told by check sums of ids, make the target; the others
    and those of quality 0 set the threshold. All labelled rows are used unless
    ``fit_rows`` and ``threshold_rows`` (of each kind) ask for fewer. Counts of the corpus
    are those of all rows. ``kept`` is false if base_failed or the score is below the
    threshold; without labels of both kinds there is no threshold.

    A null or empty text has no words and fails; a null id has no label; rows that share
    an id share its label and are judged apart; an empty table gives an empty result;
    other columns are ignored. Counts of buckets and one row for each document are
    shuffled, and the texts with a trusted label once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    kinds = _labelled(labels.select("doc_id", "quality", "toxic"), fit_rows, threshold_rows)
    weights = saved(bucket_weights(rows, kinds, "text", buckets, smoothing))
    # Every document is scored once, and the threshold is found among the scores.
    scored = saved(_scored(with_word_counts(rows), weights, "text", buckets))
    judged = scored.filter("NOT base_failed AND doc_id IS NOT NULL").select("doc_id", "score")
    judged = judged.join(kinds.filter("kind <> 'fit'").withColumnsRenamed({"label_id": "doc_id"}), "doc_id")
    limit = saved(score_threshold(judged))
    good = F.coalesce(F.col("score") >= limit.scalar() / STEPS, F.lit(True))
    return scored.withColumn("kept", ~F.col("base_failed") & good)
