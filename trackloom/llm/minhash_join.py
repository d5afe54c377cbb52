"""Near-duplicate documents by an inverted join on MinHash coordinates.

Every distinct shingle set is posted under its rarest coordinate-value pairs. Two
signatures that agree on at least ``t`` of ``k`` coordinates share one of the rarest
``k - t + 1`` of each, so those prefixes bring every candidate pair together. A hot posting
list (thousands of near copies) is not expanded into pairs: its documents are compared
with the most central of them first, what is linked is merged, and only documents of
different components are looked at again, tile by tile.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.llm.components import connected_components, saved
from trackloom.llm.words import SEED, WordHasher, mixed

COORDINATES = 48
# Bins of the byte sketch that candidates of long lists are compared by.
BIN_BITS = 8
BINS = 1 << BIN_BITS
# Posts in a list from which pairs are checked on whole sets before they leave the task,
# and rows of one tile of a list.
LONG = 64
TILE = 1024
# Rows (after repeating them for their tiles) that are compared in one call.
BUNDLE = 4000


def _signer(shingle: int, coordinates: int):
    """Batches of (id, digest, text) to (id, digest, n_shingles, s1, s2, signature, sketch)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        generator = np.random.default_rng(SEED + 1)
        flips = generator.integers(0, 1 << 63, coordinates, np.uint64)
        factors = generator.integers(0, 1 << 63, coordinates, np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            for row, end, words in hasher.chunks(batch.column(2)):
                counts = np.diff(words.first)
                # A document of fewer words than a shingle is one shingle of all its words.
                sizes = np.where(counts >= shingle, counts - shingle + 1, (counts > 0).astype(int))
                doc = np.repeat(np.arange(len(counts)), sizes)
                at = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                at += words.first[doc]
                hashes = np.full(len(doc), 1, np.uint64)
                last = words.first[doc + 1]
                for i in range(shingle):
                    inside = at + i < last
                    part = words.h1[np.minimum(at + i, len(words.h1) - 1)] if len(at) else hashes
                    hashes = np.where(inside, mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + part), hashes)
                order = np.lexsort((hashes, doc))
                doc, hashes = doc[order], hashes[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
                doc, hashes = doc[new], hashes[new]
                n = np.bincount(doc, minlength=len(counts)).astype(np.int64)
                full = np.flatnonzero(n)
                signature = np.zeros((len(counts), coordinates), np.uint32)
                s1, s2 = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
                if len(full):
                    begin = (np.cumsum(n) - n)[full]
                    s1[full] = np.add.reduceat(hashes, begin)
                    s2[full] = np.add.reduceat(mixed(hashes), begin)
                    for k in range(coordinates):
                        value = np.minimum.reduceat((hashes ^ flips[k]) * factors[k], begin)
                        signature[full, k] = value >> np.uint64(32)
                # Sketch: the least hash of each of BINS ranges, one byte each, 0 where none.
                sketch = np.zeros((len(counts), BINS), np.uint8)
                bins = (hashes >> np.uint64(64 - BIN_BITS)).astype(np.int64)
                least = np.ones(len(doc), bool)
                least[1:] = (doc[1:] != doc[:-1]) | (bins[1:] != bins[:-1])
                sketch[doc[least], bins[least]] = 1 + hashes[least] % np.uint64(255)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(counts) + 1, dtype=np.int32) * coordinates),
                    pa.array(signature.ravel().view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), pa.array(n),
                     pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lists,
                     pa.array([r.tobytes() for r in sketch], pa.binary())],
                    names=["id", "digest", "n_shingles", "s1", "s2", "signature", "sketch"])

    return sign


def _set_of(text: str | None, shingle: int) -> set:
    words = (text or "").encode().lower().split()
    if len(words) < shingle:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(shingle))))


def _confirmer(shingle: int, percent: int):
    """Pairs with both texts to the pairs whose full shingle sets are similar enough."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep, last, of_a = [], None, set()
            texts = zip(batch.column(2), batch.column(3))
            for i, (left, right) in enumerate(texts):
                if last is None or b[i] != last:
                    last, of_a = b[i], _set_of(right.as_py(), shingle)
                other = _set_of(left.as_py(), shingle)
                common = len(of_a & other)
                if common and 100 * common >= percent * (len(of_a) + len(other) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())],
                names=["a", "b"])

    return confirm


def _members(shingle: int):
    """(node, text) to (node, n_shingles, crc32 of every shingle of its set)."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                found = {zlib.crc32(b" ".join(s)) for s in _set_of(text.as_py(), shingle)}
                rows.append(np.fromiter(found, np.uint32, len(found)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.binary())], names=["node", "members"])

    return members


def _tile_pairs(percent: int):
    """Cross-component pairs that may reach the threshold, of a bundle of tiles.

    Of the bins that either set fills, about the similarity's share hold the same value;
    a pair at the threshold is 5 deviations above the bound used here. Tiles of long
    lists bring the whole sets, and only pairs that these link leave the task. They also
    bring the keys of a document's lists: a pair is checked in the first list it shares.
    """
    share = percent / 100

    def pairs(table: pa.Table) -> pa.Table:
        tile = np.stack([table[c].to_numpy().astype(np.int64) for c in ("key", "i", "j", "side")])
        order = np.lexsort(tile[::-1])
        key, i, j, side = tile[:, order]
        node = table["node"].to_numpy()[order]
        component = table["component"].to_numpy()[order]
        size = table["n_shingles"].to_numpy()[order]
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)[order]
        members = table["members"].to_pylist() if "members" in table.column_names else None
        lists = table["keys"].to_pylist() if members else None
        new = (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
        begins = np.append(np.flatnonzero(np.concatenate([[True], new])), len(key))
        found = [np.zeros((2, 0), np.int64)]
        for begin, end in zip(begins[:-1], begins[1:]):
            middle = end if i[begin] == j[begin] else begin + int(np.sum(side[begin:end] == 0))
            if members:
                sets = [frozenset(np.frombuffer(members[order[r]], np.uint32).tolist()) for r in range(begin, end)]
                shared = [frozenset(lists[order[r]]) for r in range(begin, end)]
            for row in range(begin, middle):
                low = row + 1 if middle == end else middle
                rest = low + np.flatnonzero(
                    (component[low:end] != component[row]) & (100 * size[low:end] >= percent * size[row])
                    & (100 * size[row] >= percent * size[low:end]))
                theirs, own = sketch[rest], sketch[row]
                either = ((theirs | own) > 0).sum(1)
                same = ((theirs == own) & (own > 0)).sum(1)
                hits = rest[same >= share * either - 5 * np.sqrt(either * share * (1 - share))]
                if members and len(hits):
                    own, here = shared[row - begin], key[begin]
                    hits = np.array([h for h in hits if min(own & shared[h - begin]) == here], np.int64)
                if members and len(hits):
                    # Shingles of one check sum count once, so as many as were lost may be common
                    # too; equal check sums can add a little. A margin goes to the full check.
                    mine = sets[row - begin]
                    margin = 2 + max(0, int(size[row]) - len(mine))
                    common = np.array([len(mine & sets[h - begin]) + margin for h in hits])
                    hits = hits[100 * common >= percent * (size[row] + size[hits] - common)]
                if len(hits):
                    mine = np.full(len(hits), node[row])
                    found.append(np.stack([np.maximum(node[hits], mine), np.minimum(node[hits], mine)]))
        a, b = np.unique(np.concatenate(found, 1), axis=1)
        return pa.table({"a": a, "b": b})

    return pairs


def _tiled(lists: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of posting lists (key, node, component, n), tile by tile."""
    slices = F.ceil(F.col("n") / TILE).cast("int")
    bundles = lists.select(F.sum(slices)).first()[0] or 0
    cut = lists.join(sketches, "node").withColumn("mine", F.pmod(F.xxhash64("node"), slices).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), slices - 1)))
    cut = cut.withColumns({
        "i": F.least("mine", "other"), "j": F.greatest("mine", "other"),
        "side": (F.col("mine") > F.col("other")).cast("int"),
        "bundle": F.pmod(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")),
                         F.lit(max(1, bundles // BUNDLE)))})
    cut = cut.select("key", "node", "component", "i", "j", "side", "bundle", *sketches.columns[1:])
    return cut.groupBy("bundle").applyInArrow(_tile_pairs(percent), "a long, b long")


def _unmerged(posts: DataFrame) -> DataFrame:
    """Posts of the lists that hold more than one component, with the lists' sizes."""
    lists = posts.groupBy("key").agg(
        F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    return posts.join(lists.filter("low < high").select("key", "n"), "key")


def _confirmed(pairs: DataFrame, texts: DataFrame, confirm) -> DataFrame:
    """Links among pairs (a, b): texts come by two shuffled joins, only those in a pair."""
    node = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(confirm, node)


def _equal_coordinates() -> Column:
    return F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")),
                       F.lit(0), lambda n, x: n + x)


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5,
    percent: int = 80, coordinates: int = COORDINATES, matches: int | None = None,
) -> DataFrame:
    """One row (id, n_shingles, component_id, kept) for each row of ``docs``.

    Texts are lower-cased (A-Z) and cut at white space. A document's set is its distinct
    shingles of ``shingle`` words, or all words as one shingle if it has fewer. Documents
    are linked when ``100 * common >= percent * union`` on the full sets, and
    ``component_id`` is the smallest id reachable; ``kept`` marks that document.

    ``matches``: least number of equal coordinates of a candidate; the default is 5
    deviations below what is expected at the threshold. Null or empty texts have no
    shingles and link with nothing. Rows that share an id are in one component, and each of
    their texts is compared. Rows with a null id link with nothing: component_id is null and
    kept true. An empty table gives an empty result; other columns are ignored.
    """
    if matches is None:
        share = percent / 100
        spread = (coordinates * share * (1 - share)) ** 0.5
        matches = max(1, int(coordinates * share - 5 * spread))
    prefix = coordinates - matches + 1
    # A row is known by its id and a digest of its text.
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text_column).alias("digest"),
                         F.col(text_column).alias("text"))
    schema = "id long, digest long, n_shingles long, s1 long, s2 long, signature array<int>, sketch binary"
    signed = saved(source.mapInArrow(_signer(shingle, coordinates), schema))

    # Documents with one shingle set are one class, a node with a number of its own. Only the
    # text of one row of it is looked at again.
    same_set = ["s1", "s2", "n_shingles"]
    kinds = signed.filter("n_shingles > 0 AND id IS NOT NULL")
    classes = saved(kinds.groupBy(*same_set).agg(
        F.min(F.struct("id", "digest")).alias("row"), F.first("signature").alias("signature"),
        F.first("sketch").alias("sketch")).select(
        F.monotonically_increasing_id().alias("node"), *same_set, "row.*", "signature", "sketch"))
    nodes = classes.select("node", "signature")

    # Prefix: a document's rarest coordinate-value pairs, so a line that many documents
    # share brings none of them together. Pairs of one document only come first of all.
    tokens = nodes.select("node", F.explode(F.transform(
        "signature", lambda value, i: F.xxhash64(i, value))).alias("key"))
    counts = tokens.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = tokens.join(counts, "key").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("n", "key"))).alias("shared"))
    spare = F.lit(prefix - coordinates) + F.size("shared")
    posts = saved(shared.filter(spare > 0).select("node", F.explode(
        F.slice("shared", F.lit(1), spare)).alias("post")).select("node", "post.key", "post.n"))
    # The most central document has its coordinates in common with the most others.
    weight = posts.groupBy("node").agg(F.sum("n").alias("weight"))
    ranked = posts.join(weight, "node").withColumn(
        "rank", F.struct("weight", (-F.col("node")).alias("back")))
    leaders = ranked.groupBy("key").agg(F.max("rank").alias("top"))
    stars = posts.join(leaders, "key").select(
        F.col("node").alias("a"), (-F.col("top.back")).alias("b")).filter("a != b").distinct()
    # Of all texts only those of documents in a list are looked at again.
    wanted = classes.select("node", "id", "digest").join(posts.select("node").distinct(), "node", "left_semi")
    texts = saved(source.join(wanted, ["id", "digest"]).groupBy("id", "digest", "node").agg(
        F.first("text").alias("text")).select("node", "text"))
    confirm = _confirmer(shingle, percent)
    others = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sig_b"))
    signatures = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sig_a"))
    stars = saved(stars.join(signatures, "a").join(others, "b").filter(
        _equal_coordinates() >= matches).select("a", "b"))
    near = saved(_confirmed(stars, texts, confirm))
    merged = connected_components(near)

    # What remains: pairs in one list whose documents are not connected yet.
    open_lists = saved(_unmerged(posts.drop("n").join(merged, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))))
    sketches = classes.select("node", "n_shingles", "sketch")
    long_lists = open_lists.filter(F.col("n") > LONG)
    whole = texts.join(long_lists.select("node").distinct(), "node", "left_semi").mapInArrow(
        _members(shingle), "node long, members binary")
    rest = _tiled(open_lists.filter(F.col("n") <= LONG), sketches, percent).unionByName(
        _tiled(long_lists, sketches.join(whole, "node").join(
            posts.groupBy("node").agg(F.collect_list("key").alias("keys")), "node"), percent)).distinct()
    tried = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    rest = rest.join(tried, ["a", "b"], "left_anti")
    more = saved(_confirmed(rest, texts, confirm))
    # Every row with its class; classes that share an id are one component.
    first = classes.select(*same_set, "node", F.col("id").alias("low"))
    found = saved(signed.select("id", *same_set).join(first, same_set, "left").withColumn(
        "node", F.when(F.col("id").isNotNull(), F.col("node"))).select("id", "n_shingles", "node", "low"))
    several = found.filter("node IS NOT NULL").groupBy("id").agg(
        F.min("node").alias("b"), F.max("node").alias("high")).filter("b < high").select("id", "b")
    shared_ids = found.join(several, "id").select(F.col("node").alias("a"), "b").distinct()
    merged = connected_components(near.unionByName(more).unionByName(shared_ids))
    label = merged.join(classes.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("least"))
    found = found.join(merged.join(label, "component").select("node", "least"), "node", "left")
    component = F.when(F.col("node").isNotNull(), F.coalesce("least", "low")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(id_column), "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True)))
