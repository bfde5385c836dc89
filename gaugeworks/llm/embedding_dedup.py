"""Exact threshold pairs of embeddings by dual traversal of cover trees.

Equal vectors become one point with a multiplicity. A bounded sample of points serves as coarse centres;
each point goes to its nearest, and cells are cut into blocks of at most `block` points. Every block holds
a cover tree: nested levels whose radii halve, each node with its true covering radius. Two blocks meet
only if their centres' distance is at most the radii plus the threshold; then a dual traversal from the
two roots drops node pairs that lie too far apart for any of their points, and compares what is left in
double precision. Vectors have norm 1, so cosine >= t is Euclidean distance <= sqrt(2 - 2 t).

Nodes meet as matrix products in slices of bounded size; a task holds two blocks. Links are counted with
multiplicities per point, and each block pair's links shrink to a set's label before the components.

Cost. In high dimension unrelated vectors are nearly orthogonal and no metric bound keeps their blocks
apart; the traversal then compares tight nodes (near-copies of one vector), so the work falls with the
square of the copies per node but still grows as the square of the number of distinct directions.

Defined results. Null, empty, zero and non-finite vectors link with nothing (n_links 0, a component of their
own). Vectors of different lengths have no cosine and do not link; those of each length are compared with one
another. Repeated rows with different ids link with each other; a vec_id that occurs twice gets one row per
occurrence, and a null one is kept. No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, join_hot, local_rows, relieved, table, written
from .graph import components

COSINE, BLOCK, CENTRES, LEAF = 0.9, 8192, 128, 32
_NUMBERS, _SMALL = 1 << 22, 32 << 20  # of a block; bytes of all trees up to which they are broadcast
_SHARE = 500  # a vector of more than one in so many rows is a hot one
_SLACK = 1e-6  # the bounds are wider than any rounding; the last comparison is exact


def units(x: np.ndarray) -> np.ndarray:
    """Of norm 1, or zero where a vector links with nothing. Scaled first, so that squares stay finite."""
    x = np.asarray(x, np.float64)
    with np.errstate(all="ignore"):
        top = np.abs(x).max(axis=1, initial=0, keepdims=True)
        y = x / top
        y = y / np.linalg.norm(y, axis=1, keepdims=True)
    return np.where(np.isfinite(y).all(axis=1, keepdims=True) & (top > 0), y, 0.0)


def net(points: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
    """A greedy net: centres farther than half from one another, the first point among them, and for each point the number of a centre within half."""
    limit, n = 1 - half * half / 2, len(points)
    centres, belongs, at = np.zeros(0, np.int64), np.zeros(n, np.int64), points[:0]
    for k in range(0, n, 256):
        chunk = np.arange(k, min(k + 256, n))
        if len(centres):
            dots = points[chunk] @ at.T
            best = dots.argmax(1)
            near = dots[np.arange(len(chunk)), best] >= limit
            belongs[chunk[near]] = best[near]
            chunk = chunk[~near]
        dots = points[chunk] @ points[chunk].T
        free, own = np.ones(len(chunk), bool), []
        for i in range(len(chunk)):
            if free[i]:
                mine = free & (dots[i] >= limit)
                mine[i] = True
                belongs[chunk[mine]] = len(centres) + len(own)
                free &= ~mine
                own.append(chunk[i])
        if own:
            centres = np.concatenate([centres, np.array(own, np.int64)])
            at = points[centres]
    return centres, belongs


def build(points: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """A cover tree as arrays: node -> centre (a point), covering radius, slice of children, slice of `order`.

    A node of radius r takes as children a greedy net of radius r / 2 over its points; the first is its own
    centre again (nesting). Nodes of at most `leaf` points, or of hardly any radius, are leaves.
    """
    n = len(points)
    order = np.arange(n)
    root = float(np.sqrt(np.maximum(0, 2 - 2 * (points @ points[0])).max())) if n else 0.0
    centre, radius, first, last, begin, end = ([x] if n else [] for x in (0, root, 0, 0, 0, n))
    todo = [0] if n else []
    while todo:
        v = todo.pop()
        lo, hi = begin[v], end[v]
        if hi - lo <= leaf or radius[v] <= _SLACK:
            continue
        own = order[lo:hi].copy()
        p = points[own]
        groups, belongs = net(p, radius[v] / 2)
        if len(groups) < 2:
            continue
        member = np.ones(hi - lo, bool)
        member[groups] = False  # a child's centre leads its slice
        position = np.lexsort((member, belongs))
        order[lo:hi] = own[position]
        sizes = np.bincount(belongs, minlength=len(groups))
        starts = np.cumsum(sizes) - sizes
        far = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", p, p[groups[belongs]])))[position]
        first[v] = len(centre)
        centre += own[groups].tolist()
        radius += np.maximum.reduceat(far, starts).tolist()
        begin += (lo + starts).tolist()
        end += (lo + starts + sizes).tolist()
        first += [0] * len(groups)
        last += [0] * len(groups)
        last[v] = len(centre)
        todo += range(first[v], last[v])
    kinds = {"centre": (centre, np.int64), "radius": (radius, np.float64), "first": (first, np.int64), "last": (last, np.int64), "begin": (begin, np.int64), "end": (end, np.int64)}
    return {k: np.array(v, t) for k, (v, t) in kinds.items()} | {"order": order, "points": points}


def _spread(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For slices [a, b): the index of the slice and the element, for all elements."""
    n = b - a
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)


def _grouped(key: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    keys, at = np.unique(key[order], return_index=True)
    yield from zip(keys.tolist(), np.split(of[order], at[1:]), strict=True)


def dual(x: dict, y: dict, cosine: float, same: bool, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Exact pairs (i, j) of points with cosine at or over the threshold, slice by slice; if same, both (i, j) and (j, i), without i = j.

    What is left to do is sets of nodes against sets of nodes. Of two nodes too near to drop the larger one
    opens: its children meet all nodes that are left of the other side, as one matrix product in slices of
    at most about `most` numbers.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + _SLACK
    if not len(x["centre"]) or not len(y["centre"]):
        return
    stack = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        a, b = stack.pop()
        step = max(1, most // len(b))
        if len(a) > step:
            stack += [(a[k : k + step], b) for k in range(0, len(a), step)]
            continue
        if len(b) > most:
            stack += [(a, b[k : k + most]) for k in range(0, len(b), most)]
            continue
        ra, rb = x["radius"][a], y["radius"][b]
        dots = x["points"][x["centre"][a]] @ y["points"][y["centre"][b]].T
        widest = min(2.0, float(ra.max() + rb.max()) + reach)
        i, j = np.nonzero(dots >= 1 - widest * widest / 2 - _SLACK)
        keep = np.sqrt(np.maximum(0, 2 - 2 * dots[i, j])) <= ra[i] + rb[j] + reach
        i, j = a[i[keep]], b[j[keep]]
        del dots
        leaf_i, leaf_j = x["last"][i] == 0, y["last"][j] == 0
        done = leaf_i & leaf_j
        yield from _compared(x, y, i[done], j[done], cosine, same, most)
        i, j, leaf_i, leaf_j = i[~done], j[~done], leaf_i[~done], leaf_j[~done]
        opens = ~leaf_i & (leaf_j | (x["radius"][i] >= y["radius"][j]))
        stack += [(np.arange(x["first"][v], x["last"][v]), others) for v, others in _grouped(i[opens], j[opens])]
        stack += [(others, np.arange(y["first"][v], y["last"][v])) for v, others in _grouped(j[~opens], i[~opens])]


def _compared(x: dict, y: dict, a: np.ndarray, b: np.ndarray, cosine: float, same: bool, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of points of leaf pairs (a, b): a matrix product for a leaf with much to meet, else pair by pair."""

    def apart(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (i[i != j], j[i != j]) if same else (i, j)

    size_a, size_b = x["end"][a] - x["begin"][a], y["end"][b] - y["begin"][b]
    work = np.bincount(a, size_a * size_b, len(x["centre"])) if len(a) else np.zeros(len(x["centre"]))
    big = work[a] >= 4096
    for v, others in _grouped(a[big], b[big]):
        i = x["order"][x["begin"][v] : x["end"][v]]
        every = y["order"][_spread(y["begin"][others], y["end"][others])[1]]
        step = max(1, most // len(i))
        for k in range(0, len(every), step):
            j = every[k : k + step]
            m, n = np.nonzero(x["points"][i] @ y["points"][j].T >= cosine)
            yield apart(i[m], j[n])
    a, b = a[~big], b[~big]
    cost = np.cumsum((size_a * size_b)[~big])
    slices = max(1, most // (4 * x["points"].shape[1]))
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + slices, "right")))
        w, i = _spread(x["begin"][a[at:to]], x["end"][a[at:to]])
        v, j = _spread(y["begin"][b[at:to]][w], y["end"][b[at:to]][w])
        i, j = apart(x["order"][i[v]], y["order"][j])
        hit = np.einsum("ij,ij->i", x["points"][i], y["points"][j]) >= cosine
        yield i[hit], j[hit]
        at = to


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (the smallest index of a set) after joining i with j."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        up = np.arange(len(label))
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
        label = up[label]


def _pack(tree: dict[str, np.ndarray], raw: np.ndarray, p: np.ndarray, m: np.ndarray) -> bytes:
    """With the vectors as they came, as 32-bit numbers where that loses nothing."""
    out, short = io.BytesIO(), raw.astype(np.float32)
    np.savez(out, raw=short if np.array_equal(short, raw) else raw, p=p, m=m, **{k: v for k, v in tree.items() if k != "points"})
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as f:
        tree = {k: f[k] for k in f.files}
    return tree | {"points": units(tree.pop("raw"))}


def near_copies(embeddings: DataFrame, cosine: float = COSINE, block: int = BLOCK, centres: int = CENTRES) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    spark = embeddings.sparkSession
    e = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    fit = F.coalesce(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0), F.lit(False))
    e = e.withColumn("v", F.when(fit, F.transform("v", lambda c: c + 0.0)))
    points = e.where("v is not null and vec_id is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"))
    # p numbers the points: a vec_id may stand for several vectors
    points = written(points.select("*", F.size("v").cast("long").alias("width"), F.monotonically_increasing_id().alias("p")))
    # centres for each length that fills more than one block: a vector for each block in all
    plan = {r.width: (max(2, min(block, _NUMBERS // r.width)), r["count"]) for r in points.groupBy("width").count().collect()}
    coarse = {}
    for w, (most, n) in plan.items():
        if n > most:
            coarse[w] = units(np.array([r.v for r in points.where(F.col("width") == w).orderBy(F.xxhash64("least"), "least", "p").limit(min(centres, -(-n // most))).collect()]))
    if not plan:
        return embeddings.select(F.col("vec_id").cast("long"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width, cell, vectors = b.column("width").to_numpy(), np.zeros(len(b), np.int64), b.column("v")
            for w in np.unique(width).tolist():
                if w in coarse:
                    at = np.flatnonzero(width == w)
                    u = units(np.array(vectors.take(pa.array(at)).flatten()).reshape(len(at), -1))
                    cell[at] = np.argmax(u @ coarse[w].T, axis=1)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("p", "m", "v", "width")] + [pa.array(cell)], ["p", "m", "v", "width", "cell"])

    points_in = written(points.select("p", "m", "v", "width").mapInArrow(relieved(nearest), "p long, m long, v array<double>, width long, cell long"))
    sizes = points_in.groupBy("width", "cell").count().collect()  # at most `centres` rows a length
    rows, base = [], 0
    for r in sorted(sizes):
        parts = -(-r["count"] // plan[r.width][0])
        rows.append((r.width, r.cell, base, parts))
        base += parts
    cut = local_rows(spark, rows, "width long, cell long, base long, parts long")
    blocked = points_in.join(F.broadcast(cut), ["width", "cell"]).withColumn("block", F.col("base") + F.pmod(F.xxhash64("p"), "parts"))

    def plant(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("p")
        raw = np.stack(df["v"].to_numpy())
        u = units(raw)
        mid = u.mean(0)
        radius = float(np.sqrt(((u - mid) ** 2).sum(1)).max())
        return pd.DataFrame({"width": [int(key[0])], "block": [int(key[1])], "mid": [mid.tolist()], "radius": [radius], "tree": [_pack(build(u), raw, df["p"].to_numpy(), df["m"].to_numpy())]})

    trees = written(blocked.select("width", "block", "p", "m", "v").groupBy("width", "block").applyInPandas(plant, "width long, block long, mid array<double>, radius double, tree binary"))
    # the top of the traversal: which blocks can hold a pair; a row per block, not per point
    by_width: dict[int, list] = {}
    for t in trees.select("width", "block", "mid", "radius").orderBy("block").collect():
        by_width.setdefault(t.width, []).append(t)
    tops = {w: (np.array([t.block for t in ts]), np.array([t.mid for t in ts]), np.array([t.radius for t in ts])) for w, ts in by_width.items()}
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + _SLACK

    def partners(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w, one in zip(b.column("width").to_pylist(), b.column("block").to_pylist(), strict=True):
                ids, mids, radii = tops[w]
                k = int(np.searchsorted(ids, one))
                d = np.sqrt(((mids - mids[k]) ** 2).sum(1))
                mine = ids[(d <= radii + radii[k] + reach) & (np.arange(len(ids)) >= k)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), one)), pa.array(mine)], ["a", "b"])

    meets = written(trees.select("width", "block").mapInArrow(partners, "a long, b long"))
    left = trees.select(F.col("block").alias("a"), F.col("tree").alias("ta"))
    right = trees.select(F.col("block").alias("b"), F.col("tree").alias("tb"))
    shares = max(spark.sparkContext.defaultParallelism, min(meets.count(), 20_000))
    if trees.agg(F.sum(F.length("tree"))).first()[0] <= _SMALL:
        tasks = meets.repartition(shares).join(F.broadcast(left), "a").join(F.broadcast(right), "b")
    else:
        tasks = meets.join(left, "a").join(right, "b").repartition(shares, "a", "b")

    def links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x, same = _unpack(r["ta"]), r["a"] == r["b"]
                y = x if same else _unpack(r["tb"])
                p = x["p"] if same else np.concatenate([x["p"], y["p"]])
                n, at, label = np.zeros(len(p), np.int64), 0 if same else len(x["p"]), np.arange(len(p))
                for i, j in dual(x, y, cosine, same):
                    np.add.at(n, i, y["m"][j])
                    if not same:
                        np.add.at(n, j + at, x["m"][i])
                    label = merged(label, i, j + at)
                least = np.full(len(p), np.iinfo(np.int64).max)
                np.minimum.at(least, label, p)
                some = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(p[some], pa.int64()), pa.array(n[some], pa.int64()), pa.array(least[label[some]], pa.int64())], ["p", "n", "up"])

    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # a row holds two blocks
    try:
        found = written(tasks.select("a", "b", "ta", "tb").mapInArrow(relieved(links), "p long, n long, up long"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
    comp = components(found.select(F.col("p").alias("a"), F.col("up").alias("b")))
    counts = found.groupBy("p").agg(F.sum("n").alias("n"))
    own = points.select("v", "p", "m", "least").join(broadcast_if_small(counts), "p", "left").join(broadcast_if_small(comp.withColumnRenamed("node", "p")), "p", "left")
    own = written(own.select("v", "m", "least", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "p").alias("component")))
    own = written(join_hot(own, own.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("v", "m", "n_links", "component_id"))
    # the few vectors that many rows share are broadcast, those of no vector meet nothing: no key is one task's burden
    often = F.col("m") > max(64, own.agg(F.sum("m")).first()[0] // _SHARE)
    hot, cold = own.where(often).drop("m"), own.where(~often).drop("m")
    none = e.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    some = e.where("v is not null").join(F.broadcast(hot.select(F.col("v").alias("w"), F.col("n_links").alias("hn"), F.col("component_id").alias("hc"))), F.col("v") == F.col("w"), "left")
    found = some.where("w is not null").select("vec_id", F.col("hn").alias("n_links"), F.col("hc").alias("component_id"))
    rest = some.where("w is null").select("vec_id", "v").join(cold, "v", "left").select("vec_id", "n_links", "component_id")
    out = none.union(found).union(rest)
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op7_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "embeddings"))
