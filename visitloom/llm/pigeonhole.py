"""Near-duplicate vectors by an exact similarity join over low-dimensional blocks.

Unit vectors with cosine c are sqrt(2 - 2c) apart, so pairs with cosine >= t have a squared distance of at most
T = 2 - 2t. Vectors are rotated to their principal axes, which are dealt to blocks so that blocks hold like
variance. If every block were further apart than its share of T (in proportion to its variance), the whole would
be further apart than T; so a close pair is close in some block, within that block's budget. Each block is
range-joined on its own: a k-d tree of bounded size, split at medians of a sample, lays its space out in
cells; a vector goes to its cell and to those a vector in budget may lie in; cells of many vectors are split into
tiles by hash, so a task compares two tiles of bounded size, whatever the data. Pairs within a block's budget
are verified on all components in double precision, inside the task. A pair that several blocks find is counted
by the first of them. Tasks return, per vector, how many links they found and one link towards its
task-local component, so pairs are never rows. Equal vectors are joined once, with their number.

The rotation, shares and cells come from a bounded sample; they decide the speed, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.llm.components import components
from visitloom.session import store

SAMPLE = 4096                  # distinct vectors that shape rotation and cells
WIDTH = 16                     # axes in a block
TILE = 16384                   # vectors of a tile: what one task holds of either side
DEPTH = 10                     # splits of a block's tree: at most 2 ** DEPTH cells
CHUNK = 256                    # rows compared at once
SLACK = 1e-5                   # added to the squared distance for the rounding of single-precision axes
NO_ID = 1 << 62                # ids from here on stand for vectors without an id


@dataclass(frozen=True)
class Cells:
    """A k-d tree over one block: each split halves all cells at their medians, along one axis per level and cell."""

    axes: np.ndarray           # by node, breadth first
    cuts: np.ndarray
    depth: int

    def home(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axes[node]] > self.cuts[node])
        return node - ((1 << self.depth) - 1)

    def boxes(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.full((1, width), -np.inf), np.full((1, width), np.inf)
        first = 0
        for level in range(self.depth):
            n = 1 << level
            axes, cuts = self.axes[first: first + n], self.cuts[first: first + n]
            low, high = np.repeat(low, 2, 0), np.repeat(high, 2, 0)
            left, right = np.arange(0, 2 * n, 2), np.arange(1, 2 * n, 2)
            high[left, axes] = np.minimum(high[left, axes], cuts)
            low[right, axes] = np.maximum(low[right, axes], cuts)
            first += n
        return low, high

    def near(self, budget: float, width: int) -> list[np.ndarray]:
        """For each cell, the cells from its own number on that hold points within the budget of it."""
        low, high = self.boxes(width)
        out = []
        for i in range(len(low)):
            gap = np.maximum(0, np.maximum(low[i:] - high[i], low[i] - high[i:]))
            out.append(i + np.flatnonzero((gap ** 2).sum(1) <= budget))
        return out


@dataclass(frozen=True)
class Layout:
    axes: np.ndarray           # rotation: components by axes, block after block
    blocks: tuple[tuple[int, int], ...]
    budgets: tuple[float, ...]
    cells: tuple[Cells, ...]


def _plant(x: np.ndarray, depth: int) -> Cells:
    axes, cuts = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    members = [np.arange(len(x))]
    node = 0
    for _ in range(depth):
        after = []
        for m in members:
            if len(m):
                axes[node] = int(np.argmax(x[m].var(0)))
                cuts[node] = float(np.median(x[m, axes[node]]))
            side = x[m, axes[node]] > cuts[node]
            after += [m[~side], m[side]]
            node += 1
        members = after
    return Cells(axes, cuts, depth)


def fit_layout(sample: np.ndarray, threshold: float, n: int, tile: int = TILE, width: int = WIDTH) -> Layout:
    """Rotation, blocks, budgets and cells for ``n`` vectors like the unit vectors of ``sample``."""
    dims = sample.shape[1]
    cov = np.cov(sample, rowvar=False).reshape(dims, dims) if len(sample) > 1 else np.eye(dims)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0) + 1e-9, vectors[:, ::-1]
    m = max(1, dims // width)
    deal = [[] for _ in range(m)]
    for i in range(dims):                      # there and back, so that blocks get like variance
        deal[i % m if i // m % 2 == 0 else m - 1 - i % m].append(i)
    order = [i for d in deal for i in d]
    ends = np.cumsum([len(d) for d in deal])
    blocks = tuple((int(e - len(d)), int(e)) for e, d in zip(ends, deal))
    total = 2 - 2 * threshold + SLACK
    budgets = tuple(float(total * values[d].sum() / values.sum()) for d in deal)
    depth = min(DEPTH, max(0, math.ceil(math.log2(max(1, n) / tile))), int(math.log2(max(1, len(sample)))))
    axes = vectors[:, order]
    turned = (sample @ axes).astype(np.float32).astype(np.float64)
    return Layout(axes, blocks, budgets, tuple(_plant(turned[:, a:b], depth) for a, b in blocks))


def _units(components_: int) -> Callable:
    """Arrow batches (row values, embedding) to (raw bytes of double components, or null for a vector that links with nothing)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(0).to_pylist():
                x = None
                if v is not None and len(v) and None not in v:
                    x = np.zeros(components_)
                    x[: len(v)] = v
                    if not (np.isfinite(x).all() and x.any()):
                        x = None
                out.append(None if x is None else (x + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.binary())], names=["_id", "v"])
    return run


def _dealer(layout: Layout, tiles: list[np.ndarray], dims: int) -> Callable:
    """Rows (id, v, times) to one row per pair of tiles that the vector takes part in, for each block."""
    near = [c.near(t, b - a) for c, t, (a, b) in zip(layout.cells, layout.budgets, layout.blocks)]
    around = []                                # (smaller cell, larger cell) pairs by cell
    for cells in near:
        by = [[] for _ in cells]
        for i, js in enumerate(cells):
            for j in js:
                by[i].append((i, int(j)))
                if j != i:
                    by[int(j)].append((i, int(j)))
        around.append(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, dims)
            turned = _turn(x, layout.axes)
            salt = np.array(batch.column(3).to_pylist(), np.int64)
            for k, (a, b) in enumerate(layout.blocks):
                home = layout.cells[k].home(turned[:, a:b].astype(np.float64))
                rows, keys, sides = [], [], []
                for i, (cell, s) in enumerate(zip(home.tolist(), salt.tolist())):
                    own = s % int(tiles[k][cell])
                    for low, high in around[k][cell]:
                        if low == high:
                            for other in range(int(tiles[k][cell])):
                                rows.append(i)
                                keys.append(f"{k}/{low}.{min(own, other)}/{low}.{max(own, other)}")
                                sides.append(0 if own <= other else 1)
                        else:
                            at_low = cell == low
                            for other in range(int(tiles[k][high if at_low else low])):
                                rows.append(i)
                                keys.append(f"{k}/{low}.{own if at_low else other}/{high}.{other if at_low else own}")
                                sides.append(0 if at_low else 1)
                for at in range(0, len(rows), 4096):
                    part = pa.array(rows[at: at + 4096])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[at: at + 4096]), pa.array(sides[at: at + 4096], pa.int32()), *[batch.column(c).take(part) for c in range(4)]],
                        names=["pair", "side", "id", "v", "times", "salt"])
    return run


def _turn(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Rotated unit vectors in single precision: each row on its own, so that every task gets the same bits."""
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    return np.stack([np.add.reduce(row[:, None] * axes, 0) for row in unit]).astype(np.float32) if len(x) else np.zeros((0, axes.shape[1]), np.float32)


def _links(x: np.ndarray, y: np.ndarray | None, layout: Layout, k: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (in x, in y) of the linked pairs that block k counts. Without y, pairs within x, once each."""
    a, b = layout.blocks[k]
    budgets = np.array(layout.budgets)
    tx = _turn(x, layout.axes)
    ty = tx if y is None else _turn(y, layout.axes)
    yy = x if y is None else y
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((yy * yy).sum(1))
    bx, by = tx[:, a:b], ty[:, a:b]
    sx, sy = (bx ** 2).sum(1), (by ** 2).sum(1)
    # 2 x.y >= |x|^2 + |y|^2 - budget; a little lower, as this is in single precision
    bar_x, bar_y = (sx - np.float32(budgets[k] + 1e-4)) / 2, sy / 2
    for at in range(0, len(x), CHUNK):
        first = at if y is None else 0
        close = bx[at: at + CHUNK] @ by[first:].T
        close -= bar_y[first:]
        hit = np.flatnonzero(close >= bar_x[at: at + CHUNK, None])
        i, j = hit // close.shape[1] + at, hit % close.shape[1] + first
        if y is None:
            i, j = i[i < j], j[i < j]
        for cut in range(0, len(i), 1 << 16):
            p, q = i[cut: cut + (1 << 16)], j[cut: cut + (1 << 16)]
            square = (tx[p].astype(np.float64) - ty[q]) ** 2
            within = np.stack([square[:, u:v].sum(1) for u, v in layout.blocks], 1) <= budgets
            own = within[:, k] & ~within[:, :k].any(1)
            p, q = p[own], q[own]
            link = (x[p] * yy[q]).sum(1) / (nx[p] * ny[q]) >= threshold
            yield p[link], q[link]


def _roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest row of each row's component, by repeated hooking and jumping over all pairs."""
    root = np.arange(n)
    if pairs:
        u, v = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        while True:
            low = np.minimum(root[u], root[v])
            before = root.copy()
            np.minimum.at(root, root[u], low)
            np.minimum.at(root, root[v], low)
            while (root[root] != root).any():
                root = root[root]
            if (root == before).all():
                return root
    return root


def _comparer(layout: Layout, threshold: float, dims: int) -> Callable:
    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        k = int(key[0].split("/", 1)[0])
        rows = rows.sort_values(["side", "id", "salt"], kind="stable", ignore_index=True)
        x = np.frombuffer(b"".join(rows["v"]), np.float64).reshape(-1, dims)
        cut = int((rows["side"] == 0).sum())
        within = len(set(key[0].split("/")[1:])) == 1
        times = rows["times"].to_numpy(np.int64)
        n_links, root = np.zeros(len(x), np.int64), np.arange(len(x))
        for p, q in _links(x, None, layout, k, threshold) if within else _links(x[:cut], x[cut:], layout, k, threshold):
            q = q if within else q + cut
            n_links += np.bincount(p, times[q], len(x)).astype(np.int64) + np.bincount(q, times[p], len(x)).astype(np.int64)
            some = root[p] != root[q]          # links within a known component say nothing new
            if some.any():
                root = _roots(len(x), [(np.arange(len(x)), root), (p[some], q[some])])
        on = n_links > 0
        ids = rows["id"].to_numpy(np.int64)
        least = np.full(len(x), np.iinfo(np.int64).max)
        np.minimum.at(least, root, ids)
        return pd.DataFrame({"id": ids[on], "salt": rows["salt"].to_numpy(np.int64)[on], "n_links": n_links[on], "towards": least[root][on]})
    return compare


def link_vectors(vectors: DataFrame, threshold: float = 0.9, tile: int = TILE, width: int = WIDTH) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding).

    Two vectors are linked if their cosine, computed in double precision, is at least ``threshold``. Null, empty and
    zero vectors and those with a null or non-finite component link with nothing. Shorter vectors count as filled
    up with zeros. Rows count, not ids: a repeated row is another vector, linked with its repetition; rows of one id
    form one component, whatever their vectors. A row without an id takes part; its component is named by the
    smallest id in it, null if it has none, and it is kept if that is null. Ids must lie below 2^62. An empty
    table gives an empty one; other columns are left out.
    """
    vectors = vectors.select("vec_id", "embedding")
    dims = vectors.agg(F.max(F.size("embedding"))).first()[0]
    if not dims or dims < 0:
        return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    raw = vectors.select("embedding", F.col("vec_id").cast("long").alias("_id")).mapInArrow(_units(dims), "_id long, v binary")
    raw = raw.withColumn("salt", F.xxhash64("v"))
    known = F.coalesce("_id", F.lit(NO_ID) + F.abs(F.col("salt") % (1 << 60)))
    rows = store(raw.withColumn("id", known))
    equal = store(rows.filter("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("times"), F.first("salt").alias("salt"))
                  .select("id", "v", "times", F.abs(F.col("salt") % (1 << 60)).alias("salt")))
    n = equal.count()
    sample = [r.v for r in equal.select("salt", "v").orderBy("salt", "v").limit(SAMPLE).collect()]
    x = np.frombuffer(b"".join(sample), np.float64).reshape(-1, dims)
    x = x / np.sqrt((x * x).sum(1))[:, None] if len(x) else np.zeros((0, dims))
    layout = fit_layout(x, threshold, n, tile, width)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turned = _turn(np.frombuffer(b"".join(b.column(0).to_pylist()), np.float64).reshape(-1, dims), layout.axes)
            for k, (lo, hi) in enumerate(layout.blocks):
                cell, many = np.unique(layout.cells[k].home(turned[:, lo:hi].astype(np.float64)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(cell), pa.int32()), pa.array(cell, pa.int32()), pa.array(many, pa.int64())], names=["k", "cell", "n"])
    # at most 2 ** DEPTH cells a block
    tiles = [np.ones(1 << layout.cells[0].depth, np.int64) for _ in layout.blocks]
    for r in equal.select("v").mapInArrow(homes, "k int, cell int, n long").groupBy("k", "cell").agg(F.sum("n").alias("n")).collect():
        tiles[r.k][r.cell] = max(1, -(-r.n // tile))
    dealt = equal.select("id", "v", "times", "salt").mapInArrow(_dealer(layout, tiles, dims), "pair string, side int, id long, v binary, times long, salt long")
    found = store(dealt.groupBy("pair").applyInPandas(_comparer(layout, threshold, dims), "id long, salt long, n_links long, towards long"))

    counts = found.groupBy("id", "salt").agg(F.sum("n_links").alias("_others"))
    roots = components(found.select(F.col("id").alias("u"), F.col("towards").alias("v")).unionByName(
        rows.filter("v IS NOT NULL").groupBy("v", "id").count().select("id", "v").join(equal.filter("times > 1").select(F.col("v").alias("_v"), F.col("id").alias("_first")), F.col("v") == F.col("_v"))
        .filter("id <> _first").select(F.col("id").alias("u"), F.col("_first").alias("v"))))
    marks = equal.select(F.col("v").alias("_v"), F.col("id").alias("_first"), "times", "salt").join(counts.withColumnRenamed("id", "_first"), ["_first", "salt"], "left")
    marks = marks.select("_v", (F.col("times") - 1 + F.coalesce("_others", F.lit(0))).alias("_links"))
    full = rows.select("_id", "id", "v").join(marks, F.col("v") == F.col("_v"), "left").drop("v", "_v")
    full = full.join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    name = F.coalesce("root", "id")
    name = F.when(name < NO_ID, name)
    return full.select(F.col("_id").alias("vec_id"), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), name.alias("component_id"),
                       F.col("_id").eqNullSafe(name).alias("kept"))
