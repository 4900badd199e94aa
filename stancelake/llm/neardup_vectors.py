"""Near-duplicate embeddings by a subspace pigeonhole join.

Vectors of cosine c are, scaled to length 1, at squared distance 2 - 2c.  They
are rotated (random signs and a Walsh-Hadamard transform: entries mix, distances
stay) and split into blocks of coordinates.  If the whole squared distance is
within the budget, some block's is within its share of it; so it is enough to
range-join each block under its share, and to verify the union of candidates.

The range join of a block: vectors fall into cells by their leading coordinate,
half a block radius wide, so partners lie at most two cells apart.  Cells are
dealt into chunks of bounded size, chunks that may hold partners are joined, and
a task compares two chunks by matrix products.  A pair is counted only by the
first block whose share it meets, so no pair is shuffled: tasks return link counts and a
spanning forest of their links, at most one row per vector.

Equal vectors are one class first, so a crowd of copies costs one vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finite_vector, staged
from .components import components

BLOCKS = 4
CHUNK = 8_192
TILE = 512
SLACK = 1e-9                    # on shares, far above the rounding of doubles
SLACK32 = 1e-4                  # on shares of single-precision distances
REACH = 2                       # cells per radius


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; column by column, so a row's result doesn't depend on the others."""
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(top > 0, top, 1)
    return x / np.sqrt(summed(x * x))[:, None]


def summed(x: np.ndarray) -> np.ndarray:
    s = np.zeros(len(x))
    for c in x.T:
        s = s + c
    return s


def rotated(u: np.ndarray) -> np.ndarray:
    """Random signs, then the Walsh-Hadamard transform over the next power of two; additions only, entry by entry."""
    n, dims = u.shape
    width = 1 << max(0, math.ceil(math.log2(max(1, dims))))
    a = np.zeros((n, width))
    a[:, :dims] = u * np.random.default_rng(7).choice([-1.0, 1.0], dims)
    step = 1
    while step < width:
        b = a.reshape(n, width // (2 * step), 2, step)
        a = np.stack([b[:, :, 0] + b[:, :, 1], b[:, :, 0] - b[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return a / math.sqrt(width)


def block_edges(width: int, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """Coordinates of each block: equal parts, as many as there are coordinates at most."""
    blocks = min(blocks, width)
    return [(width * j // blocks, width * (j + 1) // blocks) for j in range(blocks)]


def shares(width: int, budget: float, blocks: int = BLOCKS) -> list[float]:
    """Squared-distance share of each block, in proportion to its coordinates."""
    return [budget * (hi - lo) / width for lo, hi in block_edges(width, blocks)]


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows."""
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1)


def _cells(budget: float):
    """(node, size, dims, vector, block, cell) for every block of a vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.asarray(b.column("dims"))
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                r = rotated(unit(matrix(part.column("vector")).astype(np.float64)))
                for j, ((lo, _), share) in enumerate(zip(block_edges(r.shape[1]), shares(r.shape[1], budget))):
                    width = math.sqrt(share + SLACK) * (1 + SLACK) / REACH
                    cell = pa.array(np.floor(r[:, lo] / width).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(cell), j, np.int32)), cell],
                                                     names=[*part.schema.names, "block", "cell"])
    return run


def _pack_chunk(key, t):
    """One row per chunk."""
    order = np.argsort(np.asarray(t.column("node")))
    t = t.take(pa.array(order))
    whole = matrix(t.column("vector").combine_chunks()).tobytes()
    return pa.table({"dims": t.column("dims")[:1], "block": t.column("block")[:1], "cell": t.column("cell")[:1], "chunk": t.column("chunk")[:1],
                     "n": pa.array([len(order)], pa.int32()), "reps": pa.array([np.asarray(t.column("node")).tobytes()], pa.binary()),
                     "sizes": pa.array([np.asarray(t.column("size")).tobytes()], pa.binary()), "vectors": pa.array([whole], pa.binary())})


PACKED = "dims int, block int, cell int, chunk int, n int, reps binary, sizes binary, vectors binary"


def _links(a: np.ndarray, b: np.ndarray, same: bool, block: int, budget: float, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) with cosine >= least whose first block within its share is ``block``."""
    ua, ub = unit(a), unit(b)
    ra, rb = rotated(ua), rotated(ub)
    edges, share = block_edges(ra.shape[1]), shares(ra.shape[1], budget)
    lo, hi = edges[block]
    x, y = ra[:, lo:hi].astype(np.float32), rb[:, lo:hi].astype(np.float32)
    y2 = (y * y).sum(axis=1)
    for first in range(0, len(x), TILE):
        t = x[first:first + TILE]
        d = y2[None, :] - 2 * (t @ y.T)
        d += (t * t).sum(axis=1)[:, None]
        i, j = np.nonzero(d <= share[block] + SLACK32)
        i = i + first
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 17):
            p, q = i[k:k + (1 << 17)], j[k:k + (1 << 17)]
            for e, (s, (l, h)) in enumerate(zip(share[:block + 1], edges)):     # double precision from here on
                diff = ra[p, l:h] - rb[q, l:h]
                within = summed(diff * diff) <= s + SLACK
                keep = within if e == block else ~within
                p, q = p[keep], q[keep]
            yes = cosine(a[p], b[q]) >= least
            yield p[yes], q[yes]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows in double precision."""
    a = a / np.abs(a).max(axis=1, keepdims=True, initial=np.finfo(float).tiny)
    b = b / np.abs(b).max(axis=1, keepdims=True, initial=np.finfo(float).tiny)
    return summed(a * b) / (np.sqrt(summed(a * a)) * np.sqrt(summed(b * b)))


RESULT = "node long, links long, near long"


def _compare(budget: float, least: float, kind: type):
    """For two chunks: (node, links found, a vector of its component) of every vector with a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                same = (r["cell"], r["chunk"]) == (r["cell2"], r["chunk2"])
                ids = [np.frombuffer(r[c], np.int64) for c in ("reps", "reps2")]
                sizes = [np.frombuffer(r[c], np.int64) for c in ("sizes", "sizes2")]
                a, b = (np.frombuffer(r[c], kind).reshape(len(i), -1).astype(np.float64) for c, i in zip(("vectors", "vectors2"), ids))
                off = 0 if same else len(ids[0])
                total = len(ids[0]) if same else off + len(ids[1])
                links, root = np.zeros(total, dtype=np.int64), np.arange(total)
                for p, q in _links(a, b, same, r["block"], budget, least):
                    np.add.at(links, p, sizes[1][q])
                    np.add.at(links, q + off, sizes[0][p])
                    root = _hook(root, p, q + off)
                nodes = ids[0] if same else np.concatenate(ids)
                low = np.full(total, np.iinfo(np.int64).max)
                np.minimum.at(low, root, nodes)
                linked = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(links[linked]), pa.array(low[root[linked]])],
                                                 names=["node", "links", "near"])
    return run


def _hook(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Join the trees of all pairs: larger roots hang on smaller ones until none is apart."""
    while len(p):
        a, b = root[p], root[q]
        apart = a != b
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def near_duplicates(rows: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per vector: vec_id, n_links (other vectors with cosine >= least), component_id (smallest id reachable), kept.

    Vectors that are null, empty, zero, or hold null or non-finite components,
    and vectors of different lengths, link with nothing.  A row with a null id
    keeps its row, with 0 links, a null component and kept true.  Every row is
    a vector of its own: an id given more than once links with itself where its
    rows' vectors do.  An empty table gives an empty result; other columns
    are ignored.  ``least`` must be above 0.
    """
    budget = 2 - 2 * least
    single = dict(rows.dtypes)[vector_col] == "array<float>"
    kind = "array<float>" if single else "array<double>"
    good = finite_vector(F.col("vector")) & F.exists("vector", lambda x: x != 0) & F.col("vec_id").isNotNull()
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"))
    live, rest = rows.filter(good), rows.filter(~F.coalesce(good, F.lit(False)))
    # classes of equal vectors
    live = staged(live.withColumn("h", F.xxhash64("vector")), "vectors-live")
    classes = staged(live.groupBy("h", "vector").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("size"))
                     .withColumn("node", F.monotonically_increasing_id()), "vectors-classes")
    cells = classes.select("node", "size", F.size("vector").alias("dims"), "vector").mapInArrow(
        _cells(budget), f"node long, size long, dims int, vector {kind}, block int, cell int")
    cells = staged(cells, "vectors-cells")
    place = ["dims", "block", "cell"]
    # coordinates lie in -1..1, so a block has a bounded number of cells
    chunks = staged(cells.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")), "vectors-chunks")
    dealt = cells.join(chunks, place).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    packed = staged(dealt.select("node", "size", "vector", *place, "chunk").groupBy(*place, "chunk").applyInArrow(_pack_chunk, PACKED), "vectors-packed")
    # jobs: chunks of the same cell and of cells up to REACH apart
    other = chunks.select("dims", "block", F.col("cell").alias("cell2"), F.col("chunks").alias("chunks2"))
    grid = (chunks.withColumn("cell2", F.explode(F.sequence(F.col("cell"), F.col("cell") + REACH))).join(other, ["dims", "block", "cell2"])
            .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .withColumn("chunk2", F.explode(F.sequence(F.lit(0), F.col("chunks2") - 1)))
            .filter((F.col("cell") < F.col("cell2")) | (F.col("chunk") <= F.col("chunk2")))
            .select(*place, "chunk", "cell2", "chunk2"))
    second = packed.select("dims", "block", F.col("cell").alias("cell2"), F.col("chunk").alias("chunk2"), F.col("reps").alias("reps2"),
                           F.col("sizes").alias("sizes2"), F.col("vectors").alias("vectors2"))
    jobs = packed.join(grid, [*place, "chunk"]).drop("n").join(second, ["dims", "block", "cell2", "chunk2"])
    found = staged(jobs.mapInArrow(_compare(budget, least, np.float32 if single else np.float64), RESULT), "vectors-links")

    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("near").alias("b")), "vectors-components")
    known = (classes.select("h", "vector", "low", "size", "node").join(counted, "node", "left").join(joined, "node", "left")
             .withColumn("component", F.coalesce("component", "node")))
    known = staged(known, "vectors-known")
    lowest = known.groupBy("component").agg(F.min("low").alias("component_id"))
    known = known.join(lowest, "component").select("h", "vector", "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    out = live.join(known, ["h", "vector"]).select("vec_id", "n_links", "component_id")
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
