"""Order MinHash fingerprints of documents, in DataFrame functions only.

The symbols of a text are its words. Every k-mer of words is numbered by its occurrence,
and an occurrence-numbered k-mer has a hash. The hash picks one of BINS bins; of each
bin the TUPLE least hashes are selected, put back in the order of the text, and hashed
as a tuple. Texts with the same words in another order agree in fewer tuples, so the
share of agreeing tuples follows the edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KMER = 2
TUPLE = 2
BIN_BITS = 6
# Low bits of a hash give way to the position of the k-mer in the text.
POSITION_BITS = 26
MASK = (1 << POSITION_BITS) - 1
BLANK = " \t\n\x0b\x0c\r"
MOST_TILES = 1 << 16


def _hash(x: Column) -> Column:
    return F.shiftright(x, POSITION_BITS)


def _at(hashed: Column, position: Column) -> Column:
    return F.shiftleft(F.shiftright(hashed, POSITION_BITS), POSITION_BITS).bitwiseOR(
        position.cast("long").bitwiseAND(F.lit(MASK)))


def _bin(x: Column) -> Column:
    return F.shiftright(x, 64 - BIN_BITS)


def _least(name: str) -> Column:
    """Of a sorted array of hashes, the TUPLE least of each bin."""
    array = F.col(name)
    return F.filter(array, lambda x, i: (i < TUPLE) | (_bin(x) != _bin(F.get(array, i - TUPLE))))


def with_signature(frame: DataFrame, text: str, out: str) -> DataFrame:
    """Add the signature of a text column: one number per bin in use, bin in the top bits.

    Each step reads the array of the step before several times, so the steps stay
    separate projections. A text without words has an empty signature.
    """
    w, s, a, r, b, v = (f"__{out}_{c}" for c in "wsarbv")
    words, sort, repeat, starts, small = (F.col(c) for c in (w, s, r, b, v))
    frame = frame.withColumn(w, F.split(F.btrim(F.col(text), F.lit(BLANK)), r"[\x20\x09-\x0D]+"))
    kmer = (lambda word, i: F.xxhash64(word, *[F.get(words, i + n) for n in range(1, KMER)]))
    frame = frame.withColumn(s, F.when(
        F.btrim(F.col(text), F.lit(BLANK)) == "", F.array().cast("array<bigint>")).otherwise(
        F.sort_array(F.transform(words, lambda word, i: _at(kmer(word, i), i))))).drop(w)
    again = (lambda x, i: (i > 0) & (_hash(x) == _hash(F.get(sort, i - 1))))
    frame = frame.withColumns({
        a: F.filter(sort, lambda x, i: ~again(x, i)),
        r: F.filter(sort, again)}).drop(s)
    frame = frame.withColumns({a: _least(a), b: F.when(F.size(repeat) > 0, F.filter(
        F.sequence(F.lit(0), F.size(repeat) - 1),
        lambda i: (i == 0) | (_hash(F.get(repeat, i)) != _hash(F.get(repeat, i - 1)))))})
    numbered = F.flatten(F.transform(starts, lambda p, j: F.transform(
        F.sequence(p, F.coalesce(F.get(starts, j + 1), F.size(repeat)) - 1),
        lambda q: _at(F.xxhash64(_hash(F.get(repeat, p)), q - p + 1), F.get(repeat, q)))))
    frame = frame.withColumn(v, F.sort_array(F.concat(
        F.col(a), F.coalesce(numbered, F.array().cast("array<bigint>"))))).drop(a, r, b)
    frame = frame.withColumn(v, _least(v))

    def tuple_at(x: Column, i: Column) -> Column:
        own = [x, *[F.when(_bin(F.get(small, i + n)) == _bin(x), F.get(small, i + n)) for n in range(1, TUPLE)]]
        placed = [F.struct(y.bitwiseAND(F.lit(MASK)).alias("p"), _hash(y).alias("h")) for y in own]
        order = F.array_sort(F.filter(F.array(*placed), lambda y: y["p"].isNotNull()))
        code = F.aggregate(order, F.lit(0).cast("long"), lambda h, y: F.xxhash64(h, y["h"]))
        return F.shiftleft(_bin(x), 64 - BIN_BITS).bitwiseOR(F.shiftrightunsigned(code, BIN_BITS))

    first = (lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(small, i - 1))))
    tuples = F.transform(small, lambda x, i: F.when(first(x, i), tuple_at(x, i)))
    return frame.withColumn(out, F.filter(tuples, lambda x: x.isNotNull())).drop(v)


def likeness(a: str, b: str) -> Column:
    """The share of bins in use by either text whose tuples agree; two empty texts are alike."""
    bins = F.size(F.array_union(F.transform(a, _bin), F.transform(b, _bin)))
    return F.when(bins == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / bins)


def fingerprint(signature: str) -> Column:
    """The signature as text: 16 hexadecimal digits per bin in use."""
    return F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def with_next(docs: DataFrame, key: str, columns: list[str], tiles: int, derive) -> DataFrame:
    """``derive(docs)`` with columns ``next_*`` of the row with the next smaller key, cyclically.

    Rows are dealt into tiles by quantiles of the key and follow each other inside a
    tile; the last row of a tile is followed by the first of the next tile that has rows.
    Equal keys follow each other by the first of ``columns``.
    """
    steps = max(tiles, 2).bit_length()
    points = [k / (1 << steps) for k in range(1, 1 << steps)]
    bounds = docs.select(F.percentile_approx(key, points, 20 << steps)).first()[0]
    if not bounds:
        return derive(docs).select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    array = F.array(*[F.lit(x).cast("long") for x in bounds])

    def place(number: Column) -> Column:
        # The number is part of the state: the optimizer loses columns used in the step only.
        start = F.struct(F.lit(0).alias("low"), number.alias("number"))
        return F.aggregate(
            F.array(*[F.lit(1 << s) for s in range(steps - 1, -1, -1)]), start,
            lambda state, s: F.struct(
                F.when(F.get(array, state["low"] + s - 1) < state["number"], state["low"] + s).otherwise(
                    state["low"]).alias("low"), state["number"].alias("number")),
            lambda state: state["low"])

    order = [F.col(key).desc(), F.col(columns[0])]
    tiled = derive(docs).withColumn("tile", place(F.col(key)))
    inside = Window.partitionBy("tile").orderBy(*order)
    lead = {f"next_{c}": F.lead(c).over(inside) for c in columns}
    rows = tiled.withColumns({**lead, "more": F.lead(F.lit(True)).over(inside)})
    # One row per tile: its first document, and the tile whose last row it follows.
    keys = docs.select(F.col(key).alias("number"))
    heads = keys.groupBy(place(F.col("number")).alias("t")).agg(F.max("number").alias("number"))
    chain = Window.orderBy(F.col("t").desc())
    heads = heads.select("t", F.coalesce(
        F.lead("number").over(chain), F.first("number").over(chain)).alias("number"))
    # There are MOST_TILES heads at most, so they can go to every task.
    firsts = derive(docs.join(F.broadcast(heads.withColumnRenamed("number", key)), key))
    firsts = firsts.groupBy("t").agg(F.min(F.struct(*columns)).alias("first"))
    rows = rows.join(firsts, rows["tile"] == firsts["t"], "left")
    after = {f"next_{c}": F.when(F.col("more"), F.col(f"next_{c}")).otherwise(F.col(f"first.{c}")) for c in columns}
    return rows.withColumns(after).drop("tile", "more", "t", "first")


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, one row per row of ``docs``.

    The edited text ends in the first characters of the next document in descending
    order of ids (after the last: the first) in place of its own last floor(n / 2).
    Columns: id, n_chars, edited_text, signature, edited_signature, next_signature.

    Null texts are empty; empty texts have empty signatures. Rows that share an id follow
    each other by text. Null ids come last. A table of one row is its own next document;
    an empty table gives an empty result; other columns are ignored.
    """
    tiles = min(MOST_TILES, 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63))).alias("key"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = with_next(rows, "key", ["text", "signature"], tiles,
                     lambda frame: with_signature(frame, "text", "signature"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half),
                      F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select(F.col("id").alias(id_column), n.cast("long").alias("n_chars"), "signature",
                       "next_signature", edited.alias("edited_text"))
    return with_signature(rows, "edited_text", "edited_signature")
