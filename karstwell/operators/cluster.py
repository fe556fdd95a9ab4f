"""Clustering of embeddings."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from karstwell.sources.storage import cut


def _features(points: DataFrame) -> DataFrame:
    return points.withColumn("_features", array_to_vector(F.col("embedding").cast("array<double>")))


def kmeans(points: DataFrame, clusters: int, *, seed: int = 42, starts: int = 10) -> DataFrame:
    """Adds cluster_id; the best of ``starts`` fits by cost. No more clusters than points, and no points is an error."""
    n = points.count()
    if not n:
        raise ValueError("no points")
    k = max(1, min(clusters, n))
    if k == 1:
        return points.withColumn("cluster_id", F.lit(0))
    ready = _features(points).persist()
    fits = (KMeans(k=k, seed=seed + i, featuresCol="_features", predictionCol="cluster_id", maxIter=20).fit(ready) for i in range(starts))
    best = min(fits, key=lambda m: m.summary.trainingCost)
    ready.unpersist()
    return best.transform(_features(points)).drop("_features")


def token_kmeans(points: DataFrame, budget: int = 50_000) -> DataFrame:
    """K-means with a cluster for each ``budget`` tokens."""
    tokens = points.agg(F.sum("tokens")).first()[0] or 0
    return kmeans(points, max(1, -(-tokens // budget)))


def centroids(points: DataFrame, by: str) -> DataFrame:
    """Element-wise means; partial sums are made before the shuffle."""
    long = points.select(by, F.posexplode("embedding").alias("_i", "_x")).groupBy(by, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    return long.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("centroid"))


def reassign_outliers(points: DataFrame, id_: str, *, max_clusters: int = 10_000) -> DataFrame:
    """Points with label -1 get the label of the nearest centroid; if there is none, all get 0.

    The centroids are broadcast: one row for each cluster, ``max_clusters`` at most.
    """
    known = centroids(points.where("label >= 0"), "label").limit(max_clusters + 1).collect()
    if len(known) > max_clusters:
        raise ValueError(f"more than {max_clusters} clusters")
    if not known:
        return points.withColumn("label", F.lit(0))
    table = F.broadcast(points.sparkSession.createDataFrame([([(int(r["label"]), [float(x) for x in r["centroid"]]) for r in sorted(known, key=lambda r: r["label"])],)], "cs array<struct<label:int,centroid:array<double>>>"))
    square = lambda c: F.aggregate(F.zip_with(c["centroid"], F.col("embedding"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    nearest = F.array_min(F.transform("cs", lambda c: F.struct(square(c).alias("d"), c["label"].alias("label"))))["label"]
    return points.crossJoin(table).withColumn("label", F.when(F.col("label") < 0, nearest).otherwise(F.col("label"))).drop("cs")


#: Points of a density clustering at most: it compares all pairs, and its tree is built in one place.
MOST_POINTS = 200_000
#: Points of a cell, and edges that one task thins out together, about.
CELL, EDGES = 512, 1 << 20


def _spanning(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (a, b, distance) of a minimum spanning tree of the rows."""
    n = len(x)
    near, by = np.full(n, np.inf), np.zeros(n, np.int64)
    out = np.zeros(n, bool)
    at, a, b, w = 0, [], [], []
    for _ in range(n - 1):
        out[at] = True
        d = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        closer = (d < near) & ~out
        near[closer], by[closer] = d[closer], at
        at = int(np.argmin(np.where(out, np.inf, near)))
        a.append(by[at])
        b.append(at)
        w.append(near[at])
    return np.array(a, np.int64), np.array(b, np.int64), np.array(w, float)


class _Sets:
    """Union-find."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        path = []
        while (up := self.root.setdefault(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            self.root[p] = x
        return x


def _thinned(table: pa.Table) -> pa.Table:
    """The edges of a minimum spanning forest of some edges."""
    sets, keep = _Sets(), []
    a, b, w = (table.column(c).to_numpy() for c in ("a", "b", "w"))
    for i in np.lexsort((b, a, w)).tolist():
        x, y = sets.find(int(a[i])), sets.find(int(b[i]))
        if x != y:
            sets.root[x] = y
            keep.append(i)
    return table.select(["a", "b", "w"]).take(pa.array(keep, pa.int64()))


def stable_clusters(edges: list[tuple[float, int, int]], ids: list[int], least: int) -> dict[int, int]:
    """The label (smallest id) of each point in a cluster of most excess of mass; ``edges``: a spanning tree by distance.

    Merging along the edges makes a binary tree. Read from its top, a part of
    under ``least`` points falls out of its cluster, and two larger ones are new
    clusters. A cluster's mass is the sum over its points of how far past its own
    birth they stay, in inverse distances; it is taken unless the clusters below
    it have more together. The whole set is no cluster. Other points have no label.
    """
    sets = _Sets()
    size = {i: 1 for i in ids}
    node = {i: i for i in ids}
    below: dict[int, tuple[int, int, float]] = {}
    top, fresh = None, max(ids, default=0) + 1
    for w, a, b in sorted(edges):
        x, y = sets.find(a), sets.find(b)
        below[fresh] = node[x], node[y], w
        size[fresh] = size[node[x]] + size[node[y]]
        sets.root[x] = y
        node[y] = top = fresh
        fresh += 1

    def points(n: int) -> list[int]:
        out, todo = [], [n]
        while todo:
            n = todo.pop()
            if n in below:
                todo += below[n][:2]
            else:
                out.append(n)
        return out

    if top is None:
        return {}
    # clusters: birth, mass, members, clusters below
    births, mass, members, children = {0: 0.0}, {0: 0.0}, {0: []}, {0: []}
    todo = [(top, 0)]
    while todo:
        n, c = todo.pop()
        if n not in below:
            members[c].append(n)
            continue
        left, right, w = below[n]
        density = 1 / w if w > 0 else 1e300
        big = [x for x in (left, right) if size[x] >= least]
        if len(big) == 2:
            for x in big:
                new = len(births)
                births[new], mass[new], members[new], children[new] = density, 0.0, [], []
                children[c].append(new)
                mass[c] += size[x] * (density - births[c])
                todo.append((x, new))
        else:
            for x in (left, right):
                if x in big:
                    todo.append((x, c))
                else:
                    mass[c] += size[x] * (density - births[c])
                    members[c] += points(x)
    best, taken = dict(mass), set()
    for c in sorted(births, reverse=True):
        under = sum(best[k] for k in children[c])
        if c and (not children[c] or mass[c] >= under):
            taken.add(c)
        else:
            best[c] = under
    label = {}
    todo = [(0, None)]
    while todo:
        c, of = todo.pop()
        of = c if of is None and c in taken else of
        if of is not None:
            label.setdefault(of, []).extend(members[c])
        todo += [(k, of) for k in children[c]]
    return {p: min(own) for own in label.values() for p in own}


def density_clusters(points: DataFrame, id_: str, *, min_cluster_size: int, most: int = MOST_POINTS) -> DataFrame:
    """Adds label: hierarchical density clusters by excess of mass (the smallest id of each), -1 for noise.

    Distances are Euclidean, and a point's own density counts from itself, so
    that the tree is that of a minimum spanning tree. Trees of all pairs of
    blocks are made where the points are; their edges hold the whole tree, and
    are thinned out in tasks of bounded size until at most some times the number
    of points are left, from which the clusters are read on the driver. Over
    ``most`` points: ValueError. Null and empty vectors are noise.
    """
    least = max(2, min_cluster_size)
    rows = points.select(F.col(id_).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where(F.size("v") > 0)
    n = rows.count()
    if n > most:
        raise ValueError(f"more than {most} points")
    blocks = max(1, -(-n // CELL))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    # a lone block meets itself
    other = F.sequence(F.lit(0), F.lit(blocks - 1)) if blocks == 1 else F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: o != F.col("own"))
    rows = rows.withColumn("other", F.explode(other)).select("id", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def trees(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids)
        a, b, w = _spanning(np.array(table.column("v").to_pylist(), float)[order])
        return pa.table({"a": pa.array(ids[order][a], pa.int64()), "b": pa.array(ids[order][b], pa.int64()), "w": pa.array(w, pa.float64())})

    edges = cut(rows.groupBy("i", "j").applyInArrow(trees, "a long, b long, w double"))
    while (count := edges.count()) > EDGES:
        groups = -(-count // EDGES)
        thinner = edges.groupBy(F.pmod(F.xxhash64("a", "b", "w"), F.lit(groups)).alias("g")).applyInArrow(_thinned, "a long, b long, w double")
        edges = cut(thinner)
        if groups > 1 and edges.count() > 0.9 * count:
            break
    found = _thinned(edges.toArrow())
    tree = list(zip(found.column("w").to_pylist(), found.column("a").to_pylist(), found.column("b").to_pylist(), strict=True))
    ids = sorted({x for _, a, b in tree for x in (a, b)})
    labels = points.sparkSession.createDataFrame(list(stable_clusters(tree, ids, least).items()), "_point long, label long")
    return points.drop("label").join(labels, F.col(id_) == F.col("_point"), "left").withColumn("label", F.coalesce("label", F.lit(-1).cast("long"))).drop("_point")


#: Components of the vectors of a cluster that one task divides, about; larger clusters are halved where their rows are.
HELD = 1 << 19
#: Rounds that move the centres of two halves, at most.
MOVES = 20
#: A half with under this share of the rows is not cut off alone, where another plane divides them more evenly.
LEAST_HALF = 1 / 64


def _matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as the rows of a matrix."""
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def _plane(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """The plane midway between two centres: ``b`` is where x @ normal is over the bias."""
    return b - a, float((b @ b - a @ a) / 2)


def _halves(x: np.ndarray, rng: np.random.Generator) -> np.ndarray | None:
    """Which rows are in the second of two clusters of 2-means; None if all rows are the same."""
    wide = np.ptp(x, axis=0)
    if not wide.max() > 0:
        return None
    x = x - x.mean(axis=0)
    along = x @ rng.normal(size=x.shape[1])
    second = along > 0
    if second.all() or not second.any():
        axis = x[:, int(np.argmax(wide))]
        second = axis > axis.min()
    for _ in range(MOVES):
        normal, bias = _plane(x[~second].mean(axis=0), x[second].mean(axis=0))
        moved = x @ normal > bias
        if moved.all() or not moved.any() or (moved == second).all():
            break
        second = moved
    share = lambda side: min(side.mean(), 1 - side.mean())
    even = along > np.median(along)
    return even if share(second) < LEAST_HALF <= share(even) else second


def _bins(tokens: np.ndarray, most: int) -> np.ndarray:
    """Bins of at most ``most`` tokens: descending, each to the emptiest one with room, or to a new one."""
    out = np.zeros(len(tokens), np.int64)
    heap = [(0, b) for b in range(max(1, int(-(-tokens.sum() // most))))]
    for i in np.argsort(-tokens, kind="stable").tolist():
        load, b = heap[0]
        if load and load + tokens[i] > most:
            b = len(heap)
            heapq.heappush(heap, (tokens[i], b))
        else:
            heapq.heapreplace(heap, (load + tokens[i], b))
        out[i] = b
    return out


def _divided(id_: str, most: int, seed: int) -> Callable[[pa.Table], pa.Table]:
    """Appends _part: the rows of one cluster, halved until a part has at most ``most`` tokens; copies are dealt out."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(id_, "ascending")]))
        x, tokens = _matrix(table.column("embedding")), table.column("_t").to_numpy()
        rng, part, fresh = np.random.default_rng(seed), np.zeros(len(x), np.int32), 0
        todo = [np.arange(len(x))]
        while todo:
            own = todo.pop()
            if tokens[own].sum() <= most or len(own) == 1:
                part[own], fresh = fresh, fresh + 1
            elif (second := _halves(x[own], rng)) is None:
                bins = _bins(tokens[own], most)
                part[own], fresh = fresh + bins, fresh + int(bins.max()) + 1
            else:
                todo += [own[~second], own[second]]
        return table.append_column("_part", pa.array(part))

    return run


def _side_sums(rows: DataFrame, planes: dict[int, tuple[np.ndarray, float]]) -> dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By cluster with a plane and side of it: rows, sum, least and largest of each component. Each task sums its rows first."""
    ids = np.array(sorted(planes), np.int64)
    normals, biases = np.stack([planes[c][0] for c in ids.tolist()]), np.array([planes[c][1] for c in ids.tolist()])
    schema = "side long, n long, total array<double>, low array<double>, high array<double>"
    folds = (("total", np.add), ("low", np.minimum), ("high", np.maximum))

    def summed(side: np.ndarray, n: np.ndarray, of: list[np.ndarray]) -> pa.RecordBatch:
        order = np.argsort(side, kind="stable")
        keys, starts = np.unique(side[order], return_index=True)
        columns = [pa.array(keys), pa.array(np.add.reduceat(n[order], starts))]
        for x, (_, f) in zip(of, folds, strict=True):
            x = f.reduceat(x[order], starts, axis=0)
            columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())))
        return pa.RecordBatch.from_arrays(columns, names=["side", "n", *(c for c, _ in folds)])

    def again(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        return summed(t.column("side").to_numpy(), t.column("n").to_numpy(), [_matrix(t.column(c)) for c, _ in folds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            x, at = _matrix(b.column("embedding")), np.searchsorted(ids, b.column("_c").to_numpy())
            second = np.einsum("ij,ij->i", x, normals[at]) > biases[at]
            new = summed(2 * at + second, np.ones(len(x), np.int64), [x, x, x])
            held = new if held is None else again([held, new])
        if held is not None:
            yield held

    found = rows.where(F.col("_c").isin(ids.tolist())).select("_c", "embedding").mapInArrow(run, schema)
    found = found.groupBy("side").applyInArrow(lambda t: pa.Table.from_batches([again(t.to_batches())]), schema)
    out = {}
    for r in found.collect():
        out[int(ids[r["side"] // 2]), r["side"] % 2] = (r["n"], *(np.array(r[c]) for c, _ in folds))
    return out


def _halving_planes(rows: DataFrame, large: list[int], dim: int, seed: int) -> dict[int, tuple[np.ndarray, float] | None]:
    """The plane between the two clusters of 2-means of each large cluster, all of them at once; None where its rows are the same."""
    rng = np.random.default_rng(seed)
    planes: dict[int, tuple[np.ndarray, float] | None] = {}
    across: dict[int, tuple[np.ndarray, float]] = {}
    for (c, _), (n, total, low, high) in sorted(_side_sums(rows, {c: (np.zeros(dim), 0.0) for c in large}).items(), key=lambda e: e[0]):
        normal, widest = rng.normal(size=dim), int(np.argmax(high - low))
        across[c] = np.eye(dim)[widest], float(low[widest])
        planes[c] = (normal, float(normal @ total) / n) if high[widest] > low[widest] else None
    first, moving, even = dict(planes), {c: p for c, p in planes.items() if p is not None}, {}
    for turn in range(MOVES + 1):
        if not moving:
            break
        sums, still = _side_sums(rows, moving), {}
        for c, plane in moving.items():
            if (c, 0) not in sums or (c, 1) not in sums:
                # rounding at the first plane; later ones go back to the plane before
                planes[c] = planes[c] if turn else across[c]
                continue
            (n, total, *_), (m, other, *_) = sums[c, 0], sums[c, 1]
            share = min(n, m) / (n + m)
            if even.setdefault(c, share) >= LEAST_HALF > share:
                planes[c] = first[c]
                continue
            planes[c] = plane
            new = _plane(total / n, other / m)
            size = np.linalg.norm(new[0])
            if not turn or np.linalg.norm(new[0] - plane[0]) > 1e-2 * size or abs(new[1] - plane[1]) > 1e-2 * size * size:
                still[c] = new
        moving = still
    return planes


def _halved(rows: DataFrame, large: dict[int, int], dim: int, fresh: int, held: int, seed: int) -> DataFrame:
    """``rows`` of large clusters (by number of rows) in about two new ones each, or, if all are the same, in as many as tasks can hold."""
    planes = _halving_planes(rows, sorted(large), dim, seed)
    to, normals, biases = {}, {}, {}
    for c in sorted(large):
        to[c] = fresh, (2 if planes[c] is not None else 2 * -(-large[c] // held))
        normals[c], biases[c] = planes[c] if planes[c] is not None else (np.zeros(dim), 0.0)
        fresh += to[c][1]
    ids = np.array(sorted(large), np.int64)
    first, count = (np.array([to[c][i] for c in ids.tolist()]) for i in (0, 1))
    same = np.array([planes[c] is None for c in ids.tolist()])
    normal, bias = np.stack([normals[c] for c in ids.tolist()]), np.array([biases[c] for c in ids.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, at = _matrix(b.column("embedding")), np.searchsorted(ids, b.column("_c").to_numpy())
                second = np.einsum("ij,ij->i", x, normal[at]) > bias[at]
                own = first[at] + np.where(same[at], b.column("_hash").to_numpy() % count[at], second)
                yield b.set_column(b.schema.get_field_index("_c"), "_c", pa.array(own, pa.int64()))

    dealt = rows.withColumn("_hash", F.xxhash64(F.lit(fresh), "_row").bitwiseAND(F.lit((1 << 62) - 1)))
    return dealt.mapInArrow(run, dealt.schema).drop("_hash")


def _totals(rows: DataFrame) -> dict[int, tuple[int, int]]:
    return {r["_c"]: (r["t"], r["n"]) for r in rows.groupBy("_c").agg(F.sum("_t").alias("t"), F.count("*").alias("n")).collect()}


def _small_to_nearest(sizes: dict[int, int], centre: dict[int, np.ndarray], least: int, most: int) -> dict[int, int]:
    """Where clusters of under ``least`` tokens go: smallest first, to the nearest centroid that has room."""
    ids = np.array(sorted(sizes), np.int64)
    size, at = np.array([sizes[c] for c in ids.tolist()]), np.stack([centre[c] for c in ids.tolist()])
    stays, goes = np.ones(len(ids), bool), {}
    for i in np.lexsort((ids, size)).tolist():
        room = stays & (size + size[i] <= most)
        room[i] = False
        if size[i] < least and room.any():
            far = np.where(room, ((at - at[i]) ** 2).sum(axis=1), np.inf)
            to = int(np.argmin(far))
            stays[i], goes[i] = False, to
            size[to] += size[i]
    for i in goes:
        while goes[i] in goes:
            goes[i] = goes[goes[i]]
    return {int(ids[i]): int(ids[j]) for i, j in goes.items()}


def bounded_clusters(points: DataFrame, id_: str, least: int, most: int, *, seed: int = 42) -> DataFrame:
    """Clusters whose tokens are about ``least`` to ``most``: too large ones are bisected, small ones go to the nearest.

    Clusters of more rows than a task holds (``HELD``) are halved by 2-means all
    at once, in jobs over all their rows, whose sums come to the driver; a
    smaller one is halved on in a task of its own. A cluster that bisecting does
    not divide (copies of one vector) is dealt out by descending tokens. The
    number of jobs grows with the logarithm of the number of points; sizes and
    centroids of the clusters, of which there are about all tokens by ``most``,
    are on the driver. A single point may have more tokens than ``most``. Null
    tokens count as none; vectors that are null, empty, of different lengths or
    not finite are an error.
    """
    v = F.col("embedding")
    rows = points.drop("cluster_id")
    columns = rows.columns
    rows = rows.withColumn("_t", F.coalesce("tokens", F.lit(0)).cast("long")).withColumn("_c", F.lit(0).cast("long")).withColumn("_row", F.monotonically_increasing_id())
    fine = F.coalesce(F.size(v) > 0, F.lit(False)) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = cut(rows)
    low, high, good, n = rows.agg(F.min(F.size(v)), F.max(F.size(v)), F.sum(F.coalesce(fine, F.lit(False)).cast("long")), F.count("*")).first()
    if not n:
        return points.withColumn("cluster_id", F.lit(0))
    if good < n or low != high:
        raise ValueError("vectors of one length with finite components are needed")
    held = max(2, HELD // low)
    parts, turn = [], 0
    sizes = _totals(rows)
    fresh = 1
    while large := {c: k for c, (t, k) in sizes.items() if t > most and k > held}:
        big = F.col("_c").isin(list(large))
        parts.append(rows.where(~big))
        rows = cut(_halved(rows.where(big), large, low, fresh, held, seed + turn))
        fresh, turn = fresh + sum(max(2, 2 * -(-k // held)) for k in large.values()), turn + 1
        sizes = _totals(rows)
    parts.append(rows)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # clusters with room are not gathered
    totals = _totals(out)
    over = F.broadcast(points.sparkSession.createDataFrame([(c, t > most) for c, (t, _) in totals.items()], "_c long, _over boolean"))
    out = out.join(over, "_c")
    split = out.where("_over").drop("_over")
    split = split.groupBy("_c").applyInArrow(_divided(id_, most, seed), StructType([*split.schema, StructField("_part", IntegerType())]))
    out = cut(split.unionByName(out.where("not _over").drop("_over").withColumn("_part", F.lit(0))))
    found = sorted((r["_c"], r["_part"], r["t"]) for r in out.groupBy("_c", "_part").agg(F.sum("_t").alias("t")).collect())
    goes, sizes = {}, {i: t for i, (_, _, t) in enumerate(found)}
    number = lambda to: F.broadcast(points.sparkSession.createDataFrame([(c, p, to.get(i, i)) for i, (c, p, _) in enumerate(found)], "_c long, _part int, cluster_id int"))
    if len(sizes) > 1 and any(t < least for t in sizes.values()):
        own = centroids(out.join(number({}), ["_c", "_part"]), "cluster_id").collect()
        goes = _small_to_nearest(sizes, {r["cluster_id"]: np.array(r["centroid"]) for r in own}, least, most)
    return out.join(number(goes), ["_c", "_part"]).select(*columns, "cluster_id")


#: Members of a group whose average linkage is computed at most: a task holds their distances.
MOST_LINKED = 4096


def average_linkage(points: DataFrame, by: str, id_: str, cut: float, *, most: int = MOST_LINKED) -> DataFrame:
    """Agglomerative clusters of each group: average cosine distance, merged below ``cut``. Adds cluster_id (the smallest id).

    Chains of nearest neighbours find the merges in time quadratic in a group.
    A group of over ``most`` members is an error: it holds what one report asks.
    """

    def run(table: pa.Table) -> pa.Table:
        ids = table.column(id_).to_numpy()
        if len(ids) > most:
            raise ValueError(f"a group has more than {most} members")
        order = np.argsort(ids)
        x = np.array(table.column("embedding").to_pylist(), float)[order]
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        d = 1 - x @ x.T
        np.fill_diagonal(d, np.inf)
        size, open_ = np.ones(len(ids)), np.ones(len(ids), bool)
        merges, chain = [], []
        while open_.sum() > 1:
            if not chain:
                chain.append(int(np.argmax(open_)))
            at = chain[-1]
            to = int(np.argmin(d[at]))
            if len(chain) > 1 and d[at, chain[-2]] <= d[at, to]:
                to = chain[-2]  # two that are each other's nearest
                chain = chain[:-2]
                i, j = min(at, to), max(at, to)
                merges.append((d[i, j], i, j))
                d[i] = d[:, i] = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
                d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
                size[i] += size[j]
                open_[j] = False
            else:
                chain.append(to)
        root = _Sets()
        for w, i, j in merges:
            if w < cut:
                a, b = sorted((root.find(i), root.find(j)))
                root.root[b] = a
        of = np.array([root.find(i) for i in range(len(ids))], np.int64)
        return pa.table({id_: pa.array(ids[order], pa.int64()), "cluster_id": pa.array(ids[order][of], pa.int64())})

    return points.select(by, id_, "embedding").groupBy(by).applyInArrow(run, f"{id_} long, cluster_id long")
