"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations.

A hash function flips signs at random and applies a Hadamard transform three times; the
largest coordinate and its sign name the nearest corner of the cross-polytope. A table
joins some functions in a bucket, and a vector also probes the buckets that its least
certain functions nearly chose. Pairs that share a bucket are checked by their cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.components import connected_components, saved
from trackloom.llm.words import SEED, mixed

# Chance to miss a pair at the threshold, rows of one tile of a bucket, rows of one call.
MISS = 1e-7
TILE = 1024
BUNDLE = 8000
FLIPS = 3


def _transform(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of every row, in n log n steps."""
    rows, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(rows, -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(rows, width)
        step *= 2
    return x / np.sqrt(width)


class CrossPolytope:
    """Buckets of vectors in several tables: for each the own one, then the probes."""

    def __init__(self, width: int, tables: int, functions: int, probes: int):
        self.width, self.tables, self.functions, self.probes = width, tables, functions, min(probes, functions)
        generator = np.random.default_rng(SEED + 2)
        self.signs = generator.choice([-1.0, 1.0], (tables, functions, FLIPS, width))

    def _codes(self, x: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        for sign in signs:
            x = _transform(x * sign)
        size = np.abs(x)
        rows = np.arange(len(x))
        first = size.argmax(1)
        top = size[rows, first]
        size[rows, first] = -1
        second = size.argmax(1)
        code = 2 * first + (x[rows, first] < 0)
        return code, 2 * second + (x[rows, second] < 0), top - size[rows, second]

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """Numbers of buckets, shape (rows, tables, 1 + probes)."""
        x = np.zeros((len(vectors), self.width))
        x[:, :vectors.shape[1]] = vectors
        out = np.zeros((len(x), self.tables, 1 + self.probes), np.uint64)
        rows = np.arange(len(x))
        for t in range(self.tables):
            code, second, gap = (np.stack(part, 1) for part in zip(*(self._codes(x, s) for s in self.signs[t])))
            unsure = np.argsort(gap, 1)
            for p in range(1 + self.probes):
                chosen = code.copy()
                if p:
                    chosen[rows, unsure[:, p - 1]] = second[rows, unsure[:, p - 1]]
                number = np.full(len(x), t + 1, np.uint64)
                for k in range(self.functions):
                    number = mixed(number * np.uint64(0x9E3779B97F4A7C15) + chosen[:, k].astype(np.uint64))
                out[:, t, p] = number
        return out


def planned(dimensions: int, rows: int, cosine: float, probes: int = 1) -> CrossPolytope:
    """Functions per table so that a bucket of unlike vectors stays small, and tables so
    that a pair at the threshold is missed with probability MISS: by trial on drawn pairs."""
    width = 1
    while width < max(dimensions, 2):
        width *= 2
    functions = max(1, ceil(log(max(rows, 2)) / log(2 * width)) - 1)
    generator = np.random.default_rng(SEED + 3)
    a, b = generator.normal(size=(2, 2000, max(dimensions, 2)))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    trial = CrossPolytope(width, 4, functions, probes)
    meet = _meet(trial.buckets(a), trial.buckets(b)).mean()
    tables = ceil(log(MISS) / log(1 - min(max(meet, 0.02), 0.98)))
    return CrossPolytope(width, tables, functions, probes)


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In which tables two vectors share a bucket that is the own one of either."""
    return (a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)


def _vectors(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.asarray(v.values, np.float64) for v in column]


def _hasher(polytope: CrossPolytope):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.zeros((batch.num_rows, polytope.width))
            for row, vector in enumerate(_vectors(batch.column(2))):
                x[row, :len(vector)] = vector / np.linalg.norm(vector)
            salt = batch.column(1).to_numpy().view(np.uint64)
            keys = mixed(polytope.buckets(x) ^ salt[:, None, None])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([k.tobytes() for k in keys], pa.binary())], names=["node", "keys"])

    return hashed


def _spread(polytope: CrossPolytope):
    """(node, keys) to one row (key, slot, node) per bucket; slot 0 of a table is its own."""
    slots = polytope.tables * (1 + polytope.probes)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(np.tile(np.arange(slots), batch.num_rows)),
                 pa.array(np.repeat(batch.column(0).to_numpy(), slots))], names=["key", "slot", "node"])

    return spread


def _tile_links(cosine: float, tables: int, probes: int):
    """Links within a bundle of tiles: how many a node has, and the least node it reaches."""

    def counted(keys: np.ndarray, table: int, key: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether this bucket is the first that both vectors of a pair meet in."""
        a, b = keys[i], keys[j]
        first = _meet(a, b).argmax(1) == table
        a, b = a[:, table], b[:, table]
        most = np.iinfo(np.int64).max
        own = np.minimum(np.where((a[:, :1] == b).any(1), a[:, 0], most),
                         np.where((b[:, :1] == a).any(1), b[:, 0], most))
        return first & (own == key)

    def links(table: pa.Table) -> pa.Table:
        columns = {c: table[c].to_numpy() for c in ("key", "i", "j", "side", "slot", "node", "weight", "salt")}
        order = np.lexsort((columns["side"], columns["j"], columns["i"], columns["key"]))
        columns = {c: v[order] for c, v in columns.items()}
        vectors = _vectors(table["vector"].combine_chunks().take(pa.array(order)))
        keys = np.frombuffer(b"".join(table["keys"].take(pa.array(order)).to_pylist()), np.int64)
        keys = keys.reshape(-1, tables, 1 + probes)
        change = [np.diff(columns[c]) != 0 for c in ("key", "i", "j")]
        begins = np.flatnonzero(np.concatenate([[True], change[0] | change[1] | change[2]]))
        out = [np.zeros((3, 0), np.int64)]
        for begin, end in zip(begins, np.append(begins[1:], len(order))):
            part = {c: v[begin:end] for c, v in columns.items()}
            x = np.zeros((end - begin, max(len(v) for v in vectors[begin:end])))
            for row, vector in enumerate(vectors[begin:end]):
                x[row, :len(vector)] = vector / np.linalg.norm(vector)
            own = part["slot"] % (1 + probes) == 0
            near = (x @ x.T >= cosine) & (part["salt"][:, None] == part["salt"]) & (own[:, None] | own)
            if part["i"][0] != part["j"][0]:
                near &= part["side"][:, None] != part["side"]
            np.fill_diagonal(near, False)
            i, j = np.nonzero(near)
            if not len(i):
                continue
            # The least node that each one reaches inside the tile.
            root = part["node"].copy()
            while True:
                lower = root.copy()
                np.minimum.at(lower, i, root[j])
                if (lower == root).all():
                    break
                root = lower
            count = np.zeros(end - begin, np.int64)
            slot = int(part["slot"][0]) // (1 + probes)
            for low in range(0, len(i), 100_000):
                a, b = i[low:low + 100_000], j[low:low + 100_000]
                here = counted(keys[begin:end], slot, part["key"][0], a, b)
                np.add.at(count, a[here], part["weight"][b[here]])
            some = np.unique(i)
            out.append(np.stack([part["node"][some], count[some], root[some]]))
        node, count, root = np.concatenate(out, 1)
        return pa.table({"node": node, "links": count, "root": root})

    return links


def _usable(vector: Column, label: Column, node: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(node.isNotNull() & label.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def link_vectors(
    vectors: DataFrame, cosine: float = 0.98, probes: int = 1, id_column: str = "vec_id",
    vector_column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """One row (id, n_links, component_id, kept) for each row of ``vectors``.

    Two vectors of equal label and dimension are linked if their cosine in double
    precision is at least ``cosine``. ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest id reachable, ``kept`` marks that row.

    Equal vectors are one node with a weight. Pairs are counted inside the tasks, in the
    first bucket that both are in; only sums and a spanning forest leave a task, so hot
    groups give no pair rows. A bucket of any size is cut into tiles. Null labels, null,
    zero and empty vectors and such with null or non-finite parts link with nothing, as do
    rows with a null id (component_id null, kept true). Rows that share an id are in one
    component; each counts its own links. An empty table gives an empty result; other columns
    are ignored.
    """
    source = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"),
        F.col(label_column).alias("label"))
    source = source.withColumn("usable", _usable(F.col("vector"), F.col("label"), F.col("id")))
    size = F.when(F.col("usable"), F.size("vector"))
    source = source.withColumns({
        "salt": F.xxhash64("label", size), "h1": F.xxhash64("vector"), "h2": F.hash("vector")})
    used = source.filter("usable")
    # A class has a number of its own: one id may stand in several classes.
    classes = saved(used.groupBy("salt", "h1", "h2").agg(
        F.min("id").alias("low"), F.count("*").alias("weight"), F.first("vector").alias("vector")).withColumn(
        "node", F.monotonically_increasing_id()))
    stats = classes.agg(F.max(F.size("vector")).alias("d"), F.count("*").alias("n")).first()
    polytope = planned(stats["d"] or 1, stats["n"], cosine, probes)
    hashed = saved(classes.select("node", "salt", "vector").mapInArrow(
        _hasher(polytope), "node long, keys binary"))
    posts = hashed.mapInArrow(_spread(polytope), "key long, slot long, node long")
    own = F.col("slot") % (1 + polytope.probes) == 0
    shared = posts.groupBy("key").agg(F.count("*").alias("n"), F.max(own).alias("own")).filter("n > 1 AND own")
    posts = saved(posts.join(shared.select("key", "n"), "key"))
    slices = F.ceil(F.col("n") / TILE).cast("int")
    rows = posts.select(F.sum(slices)).first()[0] or 0
    nodes = classes.select("node", "salt", "weight", "vector").join(hashed, "node")
    cut = posts.join(nodes, "node").withColumn("mine", F.pmod(F.xxhash64("node"), slices).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), slices - 1)))
    i, j = F.least("mine", "other"), F.greatest("mine", "other")
    cut = cut.withColumns({
        "i": i, "j": j, "side": (F.col("mine") > F.col("other")).cast("int"),
        "bundle": F.pmod(F.xxhash64("key", i, j), F.lit(max(1, rows // BUNDLE)))})
    cut = cut.select("bundle", "key", "i", "j", "side", "slot", "node", "weight", "salt", "vector", "keys")
    found = saved(cut.groupBy("bundle").applyInArrow(
        _tile_links(cosine, polytope.tables, polytope.probes), "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    rep = classes.select("salt", "h1", "h2", "node", "low", "weight")
    rows = saved(source.select("id", "usable", "salt", "h1", "h2").join(rep, ["salt", "h1", "h2"], "left").select(
        "id", "usable", *[F.when(F.col("usable"), F.col(c)).alias(c) for c in ("node", "low", "weight")]))
    several = rows.filter("usable").groupBy("id").agg(
        F.min("node").alias("root"), F.max("node").alias("high")).filter("root < high").select("id", "root")
    shared_ids = rows.join(several, "id").filter("usable").select("node", "root").distinct()
    merged = connected_components(found.select("node", "root").unionByName(shared_ids), "node", "root")
    label = merged.join(classes.select("node", "low"), "node").groupBy("component").agg(F.min("low").alias("least"))
    out = rows.join(links, "node", "left").join(
        merged.join(label, "component").select("node", "least"), "node", "left")
    ok = F.col("usable")
    count = F.when(ok, F.coalesce("links", F.lit(0)) + F.col("weight") - 1).otherwise(F.lit(0))
    component = F.when(ok, F.coalesce("least", "low")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_column), count.cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
