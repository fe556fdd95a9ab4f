"""Nearest-neighbour and exact top-k search of stated queries against all vectors.

Queries and vectors meet in cells of bounded size: a chunk of rows and a block
of queries. A cell returns a few entries for each of its queries; a window
keeps the best of them (Spark cuts each task's entries to the limit before they
are shuffled). A vector's own entry is found by id and value, so it is left out
once even if rows repeat.
"""

from __future__ import annotations

import heapq
import math
import operator
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karstwell.llm.forest import Forest
from karstwell.llm.shared import cut, tidy

#: Rows and queries of a cell, about.
ROWS, BLOCK = 1024, 1024
#: Groups of dimensions whose partial scores are the lists of the uniform threshold.
SEGMENTS = 2
#: Entries of a chunk's local list that phase 1 sends for each query, at least.
HEAD = 48
#: Sums of products under this number are exact in double precision.
EXACT = 2.0**53

_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _valid(vectors: DataFrame, nonzero: bool) -> DataFrame:
    v = F.col("embedding")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if nonzero:
        ok = ok & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(v.isNotNull() & ok)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as the rows of a matrix."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    n = len(lists)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _best(score: np.ndarray, row: np.ndarray, ids: np.ndarray, queries: int, keep: int) -> np.ndarray:
    """Indexes of the ``keep`` best entries of each query: score descending, then id (row: query of the entry)."""
    order = np.lexsort((ids, -score, row))
    first = np.searchsorted(row[order], np.arange(queries))
    rank = np.arange(len(order)) - first[row[order]]
    return order[rank < keep]


def _ids(table: pa.Table, name: str) -> np.ndarray:
    """Ids; a null id counts as the largest."""
    return table.column(name).combine_chunks().fill_null(_HIGH).to_numpy()


def _ranked(entries: DataFrame, k: int, order: list[Column], score: Column) -> DataFrame:
    """The ``k`` best entries of each query without its own."""
    best = Window.partitionBy("qkey").orderBy(*order, "vec_id")
    top = entries.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    own = F.row_number().over(Window.partitionBy("qkey", "own").orderBy("rank"))
    left = top.withColumn("nth", own).where(~F.col("own") | (F.col("nth") > 1))
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("qkey").orderBy("rank"))).where(F.col("rank") <= k)
    null = F.when(F.col("vec_id") < _HIGH, F.col("vec_id"))
    return left.select("query_id", F.col("rank").cast("int").alias("rank"), null.alias("vec_id"), score.alias("score"))


def _query_rows(valid: DataFrame, where: Column) -> DataFrame:
    """Distinct query rows with a key that covers id and vector."""
    chosen = valid.where(where & F.col("vec_id").isNotNull()).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return chosen.select(F.xxhash64("query_id", "query").alias("qkey"), "query_id", "query").dropDuplicates(["qkey"])


def _parts(n: int, size: int) -> int:
    return max(1, -(-n // size))


# -- exact top-k: three-phase uniform threshold ------------------------------------------------------------------------

_ENTRY = pa.schema([("qkey", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("own", pa.bool_()), ("score", pa.int64()), ("beyond", pa.binary())])
_ENTRY_SQL = "qkey long, query_id long, vec_id long, own boolean, score long, beyond binary"
_CELL = ["dim", "segment", "chunk", "block"]
_LIST = pa.schema([("qkey", pa.int64()), *((c, pa.int32()) for c in _CELL), ("rids", pa.list_(pa.int64())), ("parts", pa.list_(pa.float64())), ("whole", pa.bool_())])
_LIST_SQL = "qkey long, dim int, segment int, chunk int, block int, rids array<long>, parts array<double>, whole boolean"


def _segment(column: str) -> Column:
    """The components of one segment; segments share the dimensions evenly."""
    edge = lambda s: F.floor(F.col("dim") * s / SEGMENTS).cast("int")
    first = edge(F.col("segment"))
    return F.slice(column, first + 1, edge(F.col("segment") + 1) - first)


def _lists(keep: int | None) -> Callable:
    """A chunk's local list for each query: its ``keep`` best entries (phase 1), or those with the cutoff's share (phase 2)."""

    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        nq, n = queries.num_rows, rows.num_rows
        if not nq or not n:
            return _LIST.empty_table()
        part = _matrix(queries.column("q")) @ _matrix(rows.column("v")).T
        rid = rows.column("rid").to_numpy()
        if keep is not None:
            m = min(keep, n)
            qi, ri = np.repeat(np.arange(nq), m), np.argpartition(-part, m - 1, axis=1)[:, :m].ravel()
        else:
            qi, ri = np.nonzero(part * SEGMENTS >= queries.column("tau").to_numpy()[:, None])
        value = part[qi, ri]
        order = np.lexsort((-value, qi))
        at = pa.array(np.searchsorted(qi, np.arange(nq + 1)), pa.int32())
        columns = [pa.array(queries.column("qkey").to_numpy()), *(pa.array(np.full(nq, k.as_py()), pa.int32()) for k in key)]
        columns += [pa.ListArray.from_arrays(at, pa.array(rid[ri][order])), pa.ListArray.from_arrays(at, pa.array(value[order]))]
        return pa.table([*columns, pa.array(np.full(nq, keep is None or n <= keep))], schema=_LIST)

    return run


def _resolved(keep: int) -> Callable:
    """Phase 3: the other parts of the entries that were sent, and each query's best of the chunk."""

    def run(rows: pa.Table, sent: pa.Table) -> pa.Table:
        if not rows.num_rows or not sent.num_rows:
            return _ENTRY.empty_table()
        x, rid = _matrix(rows.column("embedding")), rows.column("rid").to_numpy()
        order = np.argsort(rid)
        keys, first, code = np.unique(sent.column("qkey").to_numpy(), return_index=True, return_inverse=True)
        q = _matrix(sent.column("query").take(pa.array(first)))
        segments, lists, parts = (sent.column(c).combine_chunks() for c in ("segment", "rids", "parts"))
        segments, size = segments.to_numpy(), np.diff(lists.offsets.to_numpy())
        place = order[np.searchsorted(rid[order], lists.flatten().to_numpy())]
        pair = np.repeat(code, size) * np.int64(len(x)) + place
        segment, part = np.repeat(segments, size), parts.flatten().to_numpy()
        pairs = np.unique(pair)
        qi, ri = pairs // len(x), pairs % len(x)
        score = np.zeros(len(pairs))
        for s in range(SEGMENTS):
            a, b = x.shape[1] * s // SEGMENTS, x.shape[1] * (s + 1) // SEGMENTS
            value, have = np.zeros(len(pairs)), np.zeros(len(pairs), bool)
            own = segment == s
            at = np.searchsorted(pairs, pair[own])
            value[at], have[at] = part[own], True
            miss = np.flatnonzero(~have)
            for i in range(0, len(miss), 1 << 18):
                m = miss[i : i + (1 << 18)]
                value[m] = np.einsum("ij,ij->i", q[qi[m], a:b], x[ri[m], a:b])
            score += value
        ids, qids = _ids(rows, "vec_id"), sent.column("query_id").to_numpy()[first]
        best = _best(score, qi, ids[ri], len(q), keep)
        qi, ri, score = qi[best], ri[best], score[best].astype(np.int64)
        own = (ids[ri] == qids[qi]) & (rows.column("qkey").to_numpy()[ri] == keys[qi])
        beyond = pa.array([b""] * len(qi), pa.binary())
        return pa.table([pa.array(keys[qi]), pa.array(qids[qi]), pa.array(ids[ri]), pa.array(own), pa.array(score), beyond], schema=_ENTRY)

    return run


def _beyond(value: int) -> bytes:
    """Bytes that order numbers beyond 64 bits among those that are clamped to the same long."""
    if _LOW < value <= _HIGH:
        return b""
    size = (abs(value).bit_length() + 7) // 8
    raw = size.to_bytes(4, "big") + abs(value).to_bytes(size, "big")
    return raw if value > 0 else bytes(255 - b for b in raw) if value < _LOW else b"\xff" * 5


def _whole(scale: float, keep: int) -> Callable:
    """Exact scores of all pairs of a cell, one of which is far, in whole numbers of any size."""

    def integer(x: float) -> int:
        y = x * scale
        return math.floor(y) if math.isfinite(y) else math.floor(Fraction(x) * Fraction(scale))

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return _ENTRY.empty_table()
        x, q = ([[integer(v) for v in r] for r in t.column(c).to_pylist()] for t, c in ((rows, "embedding"), (queries, "query")))
        ids, keys = _ids(rows, "vec_id").tolist(), rows.column("qkey").to_pylist()
        out = []
        for own, qkey, query_id in zip(q, queries.column("qkey").to_pylist(), queries.column("query_id").to_pylist(), strict=True):
            scored = [(sum(map(operator.mul, own, r)), vec_id, key) for r, vec_id, key in zip(x, ids, keys, strict=True)]
            for score, vec_id, key in heapq.nsmallest(keep, scored, key=lambda e: (-e[0], e[1])):
                out.append((qkey, query_id, vec_id, vec_id == query_id and key == qkey, max(_LOW, min(_HIGH, score)), _beyond(score)))
        return pa.table([pa.array([r[c] for r in out], kind.type) for c, kind in enumerate(_ENTRY)], schema=_ENTRY)

    return run


def exact_topk(vectors: DataFrame, queries: Column, *, k: int = 5, scale: float = 256.0) -> DataFrame:
    """The ``k`` rows of largest integer inner product for each query, exactly.

    ``vectors``: vec_id, embedding (array of numbers) and other columns
    (ignored). ``queries``: condition on vec_id that marks the query rows.
    Components become floor(``scale`` * x). The dimensions are dealt to
    ``SEGMENTS`` segments; the partial scores of one segment for a query are a
    local list, kept in chunks of rows in partitions of their own.

    Phase 1 gathers the ``HEAD`` best entries of each chunk of each list. The
    whole scores of the first k + 1 of each list give the query a cutoff that at
    least k + 1 rows reach. Phase 2 collects every entry with a part of at least
    the cutoff's share (cutoff / ``SEGMENTS``); a row with no such part stays
    below the cutoff. Most have been sent in phase 1; only chunks whose last
    entry sent is not below the share are asked again. Phase 3 looks up the parts
    that were not sent, by row, and ranks the whole scores.

    Returns query_id, rank (from 1), vec_id, score (long), ties to the smaller
    vec_id. Vectors that are null or hold null or non-finite components take no
    part. Only vectors of the same length are compared. Null vec_id: a candidate
    (last among ties), never a query. Repeated rows are candidates of their own;
    a query leaves out itself once. Repeated query rows give one result. No
    queries: an empty result. Far rows and queries, with components too large for
    exact sums in doubles, have no cutoff: they meet all others in whole numbers
    of any size. Scores beyond 64 bits are ranked before they become the nearest
    long.
    """
    valid = _valid(vectors, nonzero=False)
    size = F.coalesce(F.array_max(F.transform("embedding", lambda x: F.abs(x * scale))), F.lit(0.0)) + 1
    far = size * size * F.greatest(F.size("embedding"), F.lit(1)) >= EXACT
    keyed = valid.select("vec_id", "embedding", F.xxhash64("vec_id", "embedding").alias("qkey"), F.size("embedding").alias("dim"), far.alias("far"))
    keyed = cut(keyed.withColumn("rid", F.monotonically_increasing_id()))
    asked = keyed.where(queries & F.col("vec_id").isNotNull()).dropDuplicates(["qkey"])
    asked = asked.select("qkey", F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.size("embedding").alias("dim"), F.col("far").alias("far"))
    sent, rows = threshold_lists(keyed, asked, k, scale)
    entries = sent.groupBy("dim", "chunk", "block").cogroup(rows.groupBy("dim", "chunk", "block"))
    entries = entries.applyInArrow(lambda s, r: _resolved(k + 1)(r, s), _ENTRY_SQL)
    if not keyed.where("far").isEmpty():
        for r, q in ((keyed.where("far"), asked), (keyed.where("not far"), asked.where("far"))):
            entries = entries.unionByName(_met(r, q, _whole(scale, k + 1)))
    return _ranked(entries, k, [F.col("score").desc(), F.col("beyond").desc()], F.col("score"))


def _met(rows: DataFrame, asked: DataFrame, run: Callable) -> DataFrame:
    """Chunks of rows and blocks of queries of the same length in cells."""
    chunks, blocks = _parts(rows.count(), ROWS // 16), _parts(asked.count(), BLOCK // 16)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("rid"), F.lit(chunks)).cast("int")).withColumn("block", _each(blocks))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("qkey"), F.lit(blocks)).cast("int")).withColumn("chunk", _each(chunks))
    cell = ["dim", "chunk", "block"]
    return rows.groupBy(cell).cogroup(asked.groupBy(cell)).applyInArrow(run, _ENTRY_SQL)


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def threshold_lists(keyed: DataFrame, asked: DataFrame, k: int, scale: float) -> tuple[DataFrame, DataFrame]:
    """Phases 1 and 2: the entries that were collected, with their queries, and the rows in the chunks they are from."""
    y = lambda x: F.floor(x * scale).cast("double")
    asked = asked.where("not far").withColumn("query", F.transform("query", y)).drop("far")
    rows = keyed.where("not far").withColumn("embedding", F.transform("embedding", y)).drop("far")
    chunks, blocks = _parts(rows.count(), ROWS), _parts(asked.count(), BLOCK)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("rid"), F.lit(chunks)).cast("int"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("qkey"), F.lit(blocks)).cast("int"))
    pieces = rows.withColumn("block", _each(blocks)).withColumn("segment", _each(SEGMENTS)).select(*_CELL, "rid", _segment("embedding").alias("v"))
    spread = asked.withColumn("chunk", _each(chunks)).withColumn("segment", _each(SEGMENTS)).select(*_CELL, "qkey", _segment("query").alias("q"))
    first = cut(pieces.groupBy(_CELL).cogroup(spread.groupBy(_CELL)).applyInArrow(_lists(max(HEAD, k + 1)), _LIST_SQL))

    # the cutoff: the (k + 1)th whole score among the first k + 1 rows of each list; null with fewer rows
    heads = first.select("qkey", "segment", F.explode(F.slice(F.arrays_zip("parts", "rids"), 1, k + 1)).alias("e"))
    nth = F.row_number().over(Window.partitionBy("qkey", "segment").orderBy(F.col("e.parts").desc(), "e.rids"))
    heads = heads.withColumn("nth", nth).where(F.col("nth") <= k + 1).select("qkey", F.col("e.rids").alias("rid")).distinct()
    whole = F.aggregate(F.zip_with("embedding", "query", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scored = heads.join(rows.select("rid", "embedding"), "rid").join(asked.select("qkey", "query"), "qkey").select("qkey", whole.alias("score"))
    place = F.row_number().over(Window.partitionBy("qkey").orderBy(F.col("score").desc()))
    low = scored.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("qkey").agg(F.min("score").alias("low"), F.count("*").alias("n"))
    asked = cut(asked.join(low.select("qkey", F.when(F.col("n") > k, F.col("low")).alias("tau")), "qkey", "left"))

    # to all lists goes the cutoff; a chunk of at most k rows has been sent whole
    tau = F.coalesce("tau", F.lit(-float("inf")))
    known = first.join(asked.select("qkey", "query_id", "query", tau.alias("tau")), "qkey")
    short = ~F.col("whole") & (F.element_at("parts", -1) * SEGMENTS >= F.col("tau"))
    reached = F.filter(F.arrays_zip("rids", "parts"), lambda e: e["parts"] * SEGMENTS >= F.col("tau"))
    sent = known.where(~short).withColumn("e", reached).where(F.size("e") > 0)
    sent = sent.select("qkey", "query_id", "query", *_CELL, F.col("e.rids").alias("rids"), F.col("e.parts").alias("parts"))
    again = cut(known.where(short).select(*_CELL, "qkey", "tau"))
    if not again.isEmpty():
        wanted = spread.join(again, [*_CELL, "qkey"])
        cells = pieces.join(again.select(*_CELL).distinct(), _CELL, "left_semi")
        more = cells.groupBy(_CELL).cogroup(wanted.groupBy(_CELL)).applyInArrow(_lists(None), _LIST_SQL)
        more = more.join(asked.select("qkey", "query_id", "query"), "qkey")
        sent = sent.unionByName(more.select(*sent.columns))
    return sent, rows.withColumn("block", _each(blocks))


# -- approximate search: forest with a shared queue --------------------------------------------------------------------


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows; the same pair gives the same double in any cell."""
    size_a, size_b = np.abs(a).max(axis=1, keepdims=True), np.abs(b).max(axis=1, keepdims=True)
    big = ((size_a > 1e100) | (size_a < 1e-100) | (size_b > 1e100) | (size_b < 1e-100)).ravel()
    if big.any():
        a, b = a.copy(), b.copy()
        a[big] /= size_a[big]
        b[big] /= size_b[big]
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


_NEAR = pa.schema([("qkey", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("rid", pa.int64()), ("own", pa.bool_()), ("score", pa.float64())])
_NEAR_SQL = "qkey long, query_id long, vec_id long, rid long, own boolean, score double"


def _leaf_cell(keep: int) -> Callable:
    """Each query's ``keep`` best rows of a cell, of those that reach its ``kth`` (the last score that it still needs)."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        nq, nr = queries.num_rows, rows.num_rows
        if not nq or not nr:
            return _NEAR.empty_table()
        x, q, kth = _matrix(rows.column("embedding")), _matrix(queries.column("query")), queries.column("kth").to_numpy()
        ids, qids = _ids(rows, "vec_id"), queries.column("query_id").to_numpy()
        rough = _unit(q) @ _unit(x).T
        n = min(keep, nr)
        limit = np.maximum(-np.partition(-rough, n - 1, axis=1)[:, n - 1 : n], kth[:, None]) - 1e-9
        qi, ri = np.nonzero(rough >= limit)
        score = _cosines(q[qi], x[ri])
        needed = score >= kth[qi]
        qi, ri, score = qi[needed], ri[needed], score[needed]
        best = _best(score, qi, ids[ri], nq, keep)
        qi, ri, score = qi[best], ri[best], score[best]
        own = (ids[ri] == qids[qi]) & (x[ri] == q[qi]).all(axis=1)
        columns = [queries.column("qkey").to_numpy()[qi], qids[qi], ids[ri], rows.column("rid").to_numpy()[ri], own, score]
        return pa.table([pa.array(c) for c in columns], schema=_NEAR)

    return run


class _Index:
    """A forest for each length of vectors. Leaves are numbered through all of them."""

    def __init__(self, points: dict[int, np.ndarray], trees: int, leaf: int):
        self.trees, self.leaves = trees, 0
        self.forests: dict[int, tuple[Forest, int]] = {}
        for dim, own in sorted(points.items()):
            forest = Forest(own, trees=trees, leaf=leaf)
            self.forests[dim] = forest, self.leaves
            self.leaves += forest.leaves

    def assign(self, batches):
        """The leaf of each row in each tree."""
        for b in batches:
            sizes = np.asarray(pc.list_value_length(b.column("embedding")))
            for dim in np.unique(sizes).tolist():
                own = b.filter(pa.array(sizes == dim))
                forest, first = self.forests[dim]
                found = forest.assign(_unit(_matrix(own.column("embedding")))) + first
                at = pa.array(np.arange(own.num_rows + 1) * self.trees, pa.int32())
                yield own.append_column("leaves", pa.ListArray.from_arrays(at, pa.array(found.T.ravel(), pa.int64())))

    def probe(self, sizes: np.ndarray, first_cell: np.ndarray, keep: int, z: float | None) -> Callable:
        """The cells that a query opens: at first those of its own leaves, then all others within reach, in waves.

        A leaf's cells are numbered from ``first_cell``. Waves are in the order
        of the queue; each brings at most ``WAVE`` times the rows before it.
        """
        kind = pa.list_(pa.list_(pa.int64()))

        def run(batches):
            for b in batches:
                lengths = np.asarray(pc.list_value_length(b.column("query"))).tolist()
                kth = b.column("kth").to_numpy(zero_copy_only=False) if z is not None else None
                known = b.select(["qkey", "query_id", "query"])
                waves, held, since = [], 0, 0
                for i, dim in enumerate(lengths):
                    forest, first = self.forests[dim]
                    point = _unit(_matrix(b.column("query").slice(i, 1)))[0]
                    own = sizes[first : first + forest.leaves]
                    opened = forest.search(point, own, keep, 0.0)
                    order = [opened]
                    if z is not None:
                        # distance of the kth row found, on the unit sphere; the share of it along a plane's normal is about 1 / sqrt(dimensions)
                        reach = z * math.sqrt(max(0.0, 2 - 2 * kth[i])) / math.sqrt(forest.spread)
                        seen = set(opened)
                        order = _waves(float(own[opened].sum()), [leaf for leaf in forest.search(point, own, keep, reach) if leaf not in seen], own)
                    waves.append([[c for leaf in w for c in range(first_cell[leaf + first], first_cell[leaf + first + 1])] for w in order])
                    held += sum(map(len, waves[-1]))
                    if held > 200_000:
                        yield known.slice(since, len(waves)).append_column("waves", pa.array(waves, kind))
                        waves, held, since = [], 0, i + 1
                yield known.slice(since, len(waves)).append_column("waves", pa.array(waves, kind))

        return run


#: Rows of a wave of leaves, as a multiple of the rows that were met before it.
WAVE = 10


def _waves(before: float, leaves: list[int], sizes: np.ndarray) -> list[list[int]]:
    """``leaves`` in order, cut into the fewest waves that grow by a factor of at most about ``WAVE``, the same for all."""
    if not leaves:
        return []
    before = max(1.0, before)
    met = before + np.cumsum(sizes[leaves])
    n = max(1, math.ceil(math.log(max(1.0, met[-1] / before)) / math.log(WAVE)))
    ends = [int(np.searchsorted(met, before * (met[-1] / before) ** (w / n))) + 1 for w in range(1, n)]
    return [w for a, b in zip([0, *ends], [*ends, len(leaves)], strict=True) if (w := leaves[a:b])]


def forest_search(vectors: DataFrame, queries: Column, *, k: int = 5, trees: int = 4, leaf: int = 256, sample: int = 32_768, z: float = 1.0) -> DataFrame:
    """Nearest rows by cosine for each query, through a forest of random-projection trees.

    ``vectors``: vec_id, embedding and other columns (ignored). ``queries``:
    condition on vec_id that marks the query rows. The trees are fitted on about
    ``sample`` vectors chosen by hash, down to leaves of about ``leaf`` rows of
    the whole table (or four vectors of the sample), and every row is put in a
    leaf of each tree. A query first opens its own leaf of each tree. The
    distance of the k-th row found there is how far the search may have to go:
    one priority queue of all trees opens further leaves, by the largest margin
    on the way to them, up to ``z`` standard deviations of such a distance along
    a plane's normal. So the work follows the data: few leaves where vectors
    form clusters, most of them where directions are uniform in many dimensions.
    What the leaves hold is ranked by exact cosine. The further leaves are opened
    in waves, nearest first; a wave returns only rows that reach the k + 1 best
    so far, so that the entries of a query grow with the logarithm of the rows
    it meets. Leaves are cut into chunks of about ``ROWS`` rows, so that a leaf
    full of copies meets in no single task.

    Returns query_id, rank, vec_id, score (double), ties to the smaller vec_id:
    always ``k`` rows if there are so many candidates (one tree's leaves are
    opened until they hold them). Vectors that are null, zero or hold null or
    non-finite components take no part. Only vectors of the same length are
    compared; each length has trees of its own. Null vec_id: a candidate (last
    among ties), never a query. Repeated rows are candidates of their own; a
    query leaves out itself once. Repeated query rows give one result. No
    queries: an empty result.
    """
    valid = _valid(vectors, nonzero=True)
    spark = vectors.sparkSession
    counts = {r["dim"]: r["count"] for r in valid.groupBy(F.size("embedding").alias("dim")).count().collect()}
    n = sum(counts.values())
    share = min(1.0, sample / max(1, n))
    chosen = F.pmod(F.xxhash64(F.lit(5), "vec_id", "embedding"), F.lit(1 << 30)) < int(share * (1 << 30))
    picked = valid.where(chosen).select("embedding").toArrow().column("embedding").combine_chunks()
    lengths = np.asarray(pc.list_value_length(picked))
    points = {}
    for dim in counts:
        own = picked.filter(pa.array(lengths == dim))
        own = _unit(_matrix(own)) if len(own) else np.zeros((0, dim))
        points[dim] = own[np.lexsort(own.T)]  # the same trees in whatever order the sample comes
    index = _Index(points, trees, max(4, int(leaf * share)))

    indexed = valid.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(index.assign, "vec_id long, embedding array<double>, rid long, leaves array<long>")
    indexed = cut(indexed)
    rows = indexed.select("vec_id", "embedding", "rid", F.explode("leaves").alias("leaf"))
    sizes = np.zeros(index.leaves)
    for r in rows.groupBy("leaf").count().collect():  # at most trees * sample / 2 leaves
        sizes[r["leaf"]] = r["count"]
    chunks = np.maximum(1, np.ceil(sizes / ROWS)).astype(np.int64)
    first_cell = np.concatenate([[0], np.cumsum(chunks)])
    table = F.broadcast(spark.createDataFrame([(i, int(a), int(c)) for i, (a, c) in enumerate(zip(first_cell, chunks, strict=False))], "leaf long, first long, chunks long"))
    placed = rows.join(table, "leaf").withColumn("cell", F.col("first") + F.pmod(F.xxhash64("rid"), "chunks")).drop("leaf", "first", "chunks")
    asked = cut(_query_rows(valid, queries).repartition(spark.sparkContext.defaultParallelism * 2, "qkey"))
    best = Window.partitionBy("qkey").orderBy(F.col("score").desc(), "vec_id", "rid")
    opens = "qkey long, query_id long, query array<double>, waves array<array<long>>"

    def met(cells: DataFrame) -> DataFrame:
        """Each query's best entries of some cells."""
        return placed.groupBy("cell").cogroup(cells.groupBy("cell")).applyInArrow(_leaf_cell(k + 1), _NEAR_SQL)

    def ahead(entries: DataFrame) -> DataFrame:
        """The best rows; the same one comes from several trees, at most ``trees`` times."""
        some = entries.withColumn("n", F.row_number().over(best)).where(F.col("n") <= 2 * trees * (k + 1)).drop("n").dropDuplicates(["qkey", "rid"])
        return cut(some.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n"))

    def wave(opened: DataFrame, w: int) -> DataFrame:
        return opened.select("qkey", "query_id", "query", "kth", F.explode(F.get("waves", F.lit(w))).alias("cell"))

    everything = F.lit(-float("inf"))
    near = ahead(met(wave(asked.mapInArrow(index.probe(sizes, first_cell, k + 1, None), opens).withColumn("kth", everything), 0)))
    opened = cut(asked.join(near.groupBy("qkey").agg(F.min("score").alias("kth")), "qkey").mapInArrow(index.probe(sizes, first_cell, k + 1, z), opens))
    for w in range(opened.agg(F.max(F.size("waves"))).first()[0] or 0):
        # a row below the last of k + 1 that are known is not among the best, wherever it lies
        kth = near.groupBy("qkey").agg(F.when(F.count("*") > k, F.min("score")).otherwise(everything).alias("kth"))
        near = ahead(near.unionByName(met(wave(opened.join(kth, "qkey"), w))))
        tidy(spark)
    return _ranked(near, k, [F.col("score").desc()], F.col("score"))
