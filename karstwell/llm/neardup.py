"""Near-duplicate detection by min-max hashing.

Each permutation of the hashed shingles keeps its minimum and its maximum, so
half as many evaluations fill a signature; a band holds the two extremes of two
permutations (four rows). Documents that agree in a band are candidates, and a
link is made only after the exact Jaccard similarity of the full sets.

No bucket is expanded into pairs. Equal sets become one node first. In a bucket
every member is compared with one leader, the member whose own buckets are the
largest; what that joins is one component. Only members that are still in
another component than the bucket's largest one are compared further, in blocks
of bounded size. A block first sees the members' sketches (one byte of each
extreme); full sets travel only for members that have a likely partner there,
once for the same group of members whatever number of bands brings it about. A
bucket with too many such members (boilerplate: sets that share a band and are
not similar) is split again by wide bands of twelve rows.

Sizes and sketches rule pairs out before sets travel: sizes exactly, sketches
with the same probability of a miss as the bands have.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karstwell.llm.shared import Bitmap, aside, components, cut, small_batches, texts_of, tidy
from karstwell.llm.words import Words, bounded, mix, shingles, slices

#: Members of a bucket that meet in one task have at most about twice this number.
BLOCK = 256
#: Blocks of members outside a bucket's largest component; a bucket with more is split by wide bands.
BLOCKS = 4
#: Extremes in a band, and in a wide band.
ROWS, WIDE = 4, 12
#: Probability with which a pair at the threshold is missed by the bands, and by the sketches.
MISS = 1e-9

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def bands_for(threshold: float, rows: int = ROWS) -> int:
    """Bands of ``rows`` rows with which a pair at ``threshold`` is missed with probability ``MISS``."""
    return max(8, math.ceil(math.log(MISS) / math.log1p(-(threshold**rows))))


def least_agreement(rows: int, threshold: float) -> int:
    """Rows of ``rows`` in which a pair at ``threshold`` agrees at least, but for a probability of ``MISS``."""
    total = 0.0
    for n in range(rows + 1):
        total += math.comb(rows, n) * threshold**n * (1 - threshold) ** (rows - n)
        if total > MISS:
            return n
    return rows


def _signature(sets: np.ndarray, sizes: np.ndarray, bands: int, rows: int = ROWS, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of each row with a set the key of each band and one byte of each extreme; rows without one have zeros.

    ``first``: the number of the first permutation.
    """
    keys, sketch = np.zeros((len(sizes), bands), np.uint64), np.zeros((len(sizes), bands * rows), np.uint8)
    full = np.flatnonzero(sizes)
    if not len(full):
        return keys, sketch
    at = (np.cumsum(sizes) - sizes)[full]
    half = rows // 2
    with np.errstate(over="ignore"):
        seeds = mix(np.arange(2 * first + 1, 2 * (first + half * bands) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for band in range(bands):
            key = np.full(len(full), band + 1 + first, np.uint64)
            for p in range(half * band, half * (band + 1)):
                turned = (sets ^ seeds[2 * p]) * (seeds[2 * p + 1] | np.uint64(1))
                for side, extreme in enumerate((np.minimum, np.maximum)):
                    value = extreme.reduceat(turned, at)
                    sketch[full, 2 * p + side] = value.astype(np.uint8)
                    key = mix(key * np.uint64(0xD6E8FEB86659FD93) + value)
            keys[full, band] = key
    return keys, sketch


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.ravel().view(np.int64)))


def _signed(width: int, bands: int) -> Callable:
    @bounded
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in slices(batch, limit=1 << 20):
                words = Words(text, _LOWER)
                values, offsets = shingles(words.hashes(), words.row_start, width)
                sizes = np.diff(offsets)
                keys, sketch = _signature(values, sizes, bands)
                digests = [_digest(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                columns = [part.column("doc_id"), part.column("rk"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())]
                columns += [_lists(keys, np.arange(len(sizes) + 1) * bands), pa.array([s.tobytes() for s in sketch], pa.binary())]
                yield pa.record_batch(columns, ["doc_id", "rk", "n_shingles", "digest", "keys", "sketch"])

    return run


def _full(width: int, wanted, bands: int | None = None) -> Callable:
    """Digest and set (with ``bands``: keys of wide bands) of texts whose mark is wanted; each set once a task."""

    @bounded
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            batch = batch.filter(pa.array(wanted.value.has(batch.column("mark").to_numpy().view(np.uint64))))
            for _, text in slices(batch, limit=1 << 20):
                words = Words(text, _LOWER)
                values, offsets = shingles(words.hashes(), words.row_start, width)
                digests = [_digest(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                new = np.array([d not in seen and not seen.add(d) for d in digests], bool)
                out = pa.record_batch([pa.array(digests, pa.binary()), _lists(values, offsets)], ["digest", "shingles"])
                if bands is not None:
                    keys, _ = _signature(values, np.diff(offsets), bands, WIDE, 1 << 20)
                    out = pa.record_batch([out.column(0), _lists(keys, np.arange(len(text) + 1) * bands)], ["digest", "keys"])
                yield out.filter(pa.array(new))

    return run


def _fits(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _sketches(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, -1) if n else np.zeros((0, 0), np.uint8)


def _alike(least: int) -> Callable:
    """Pairs whose sketches agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_sketches(batch.column("ka")) == _sketches(batch.column("kb"))).sum(axis=1)
            yield batch.select(["a", "b", "da", "db"]).filter(pa.array(same >= least))

    return run


def _likely(percent: int, least: int) -> Callable:
    """Groups of members of a block that are chained by likely links between different components."""

    def run(table: pa.Table) -> pa.Table:
        nodes, comps, sizes = (table.column(c).to_numpy() for c in ("node", "component", "n_shingles"))
        sketch = _sketches(table.column("sketch"))
        n = len(nodes)
        near = np.zeros((n, n), bool)
        for i in range(n):  # at most about 2 * BLOCK
            near[i] = ((sketch == sketch[i]).sum(axis=1) >= least) & (comps != comps[i])
        near &= 100 * np.minimum(sizes[:, None], sizes[None, :]) >= percent * np.maximum(sizes[:, None], sizes[None, :])
        rows, names = [], []
        left = near.any(axis=1)
        while left.any():
            group = np.zeros(n, bool)
            edge = np.zeros(n, bool)
            edge[np.argmax(left)] = True
            while edge.any():
                group |= edge
                edge = near[edge].any(axis=0) & ~group
            left &= ~group
            own = np.flatnonzero(group)
            rows += own.tolist()
            name = hashlib.blake2b(np.sort(nodes[own]).tobytes(), digest_size=16).digest()
            names += [name] * len(own)
        out = table.select(["node", "digest", "component"]).take(pa.array(rows, pa.int64()))
        return out.append_column("block", pa.array(names, pa.binary()))

    return run


def _links_in_block(percent: int) -> Callable:
    """Links between members of different components that meet in one block."""

    def run(table: pa.Table) -> pa.Table:
        ids, comps = table.column("node").to_numpy(), table.column("component").to_numpy()
        lists = table.column("shingles").combine_chunks()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy()[offsets[0] : offsets[-1]]
        sizes = np.diff(offsets)
        rows = np.repeat(np.arange(len(ids)), sizes)
        common = np.zeros((len(ids), len(ids)), np.float64)
        order = np.argsort(values, kind="stable")
        values, rows = values[order], rows[order]
        column = np.cumsum(np.concatenate([[0], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
        width = 4096
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):  # bounded memory for any set size
            a, b = np.searchsorted(column, [low, low + width])
            has = np.zeros((len(ids), width), np.float32)
            has[rows[a:b], column[a:b] - low] = 1
            common += has @ has.T
        either = sizes[:, None] + sizes[None, :] - common
        i, j = np.nonzero(np.triu((100 * common >= percent * either) & (comps[:, None] != comps[None, :]) & (common > 0), 1))
        return pa.table({"a": pa.array(ids[i], pa.int64()), "b": pa.array(ids[j], pa.int64())})

    return run


class _Search:
    """Links between the nodes (distinct sets) of one table."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, shingle: int, percent: int, block: int, rows: int):
        self.texts, self.nodes, self.shingle, self.percent, self.block = texts, nodes, shingle, percent, block
        self.least, self.count = least_agreement(rows, percent / 100), nodes.count()

    def sets(self, digests: DataFrame, bands: int | None = None) -> DataFrame:
        """digest and shingles (or keys of wide bands) of the nodes with these digests, and of a few others."""
        marks = self.nodes.join(digests.distinct(), "digest").select("mark")
        wanted = self.texts.sparkSession.sparkContext.broadcast(Bitmap(marks, self.count))
        kind = "digest binary, shingles array<long>" if bands is None else "digest binary, keys array<long>"
        return self.texts.select(F.xxhash64("doc_id").alias("mark"), "text").mapInArrow(_full(self.shingle, wanted, bands), kind)

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Those of some pairs of nodes (a, b) that sizes and sketches don't rule out, with their digests."""
        of = lambda x: self.nodes.select(
            F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("digest").alias(f"d{x}"), F.col("sketch").alias(f"k{x}")
        )
        both = pairs.join(of("a"), "a").join(of("b"), "b").where(_fits(F.col("na"), F.col("nb"), self.percent))
        return cut(both.mapInArrow(_alike(self.least), "a long, b long, da binary, db binary"))

    def links(self, likely: DataFrame, full: DataFrame) -> DataFrame:
        """The likely pairs whose sets are similar enough."""
        left, right = (full.select(F.col("digest").alias(f"d{x}"), F.col("shingles").alias(f"s{x}")) for x in "ab")
        both = likely.join(left, "da").join(right, "db").withColumn("common", F.size(F.array_intersect("sa", "sb")))
        similar = 100 * F.col("common") >= self.percent * (F.size("sa") + F.size("sb") - F.col("common"))
        return both.where(similar).select("a", "b").distinct()

    def led(self, members: DataFrame) -> DataFrame:
        """Links between each bucket's members and its leader. ``members``: key, node, members."""
        score = members.groupBy("node").agg(F.sum("members").alias("score"))
        scored = members.join(score, "node")
        leader = scored.groupBy("key").agg(F.max(F.struct("score", (-F.col("node")).alias("rank"))).alias("top"))
        leader = leader.select("key", (-F.col("top.rank")).alias("leader"))
        pairs = members.join(leader, "key").where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
        likely = self.likely(pairs.distinct())
        return self.links(likely, self.sets(_digests(likely)))

    def others(self, members: DataFrame, joined: DataFrame, *, wide: bool = False) -> DataFrame:
        """Links that no leader has: members outside the largest component of their bucket against the whole bucket."""
        now = members.select("key", "node").join(joined, members.node == joined.id, "left")
        now = cut(now.select("key", "node", F.coalesce("component", "node").alias("component")))
        parts = now.groupBy("key", "component").agg(F.count("*").alias("n"))
        mixed = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("top"))
        number = lambda n: F.ceil(n / self.block).cast("int")
        mixed = mixed.where("parts > 1").select(
            "key", F.col("top.component").alias("main"), number(F.col("top.n")).alias("g"), number(F.col("all") - F.col("top.n")).alias("r")
        )
        mixed = cut(mixed)
        links = None
        if not wide:
            large = mixed.where(F.col("r") > BLOCKS).select("key")
            if not large.isEmpty():
                links = self.split(now.join(large, "key", "left_semi").select("node").distinct(), joined)
                mixed = mixed.where(F.col("r") <= BLOCKS)
        main = F.col("component") == F.col("main")
        own = F.when(main, F.pmod(F.xxhash64("node"), "g")).otherwise(F.col("g") + F.pmod(F.xxhash64("node"), "r")).cast("int")
        last = F.col("g") + F.col("r") - 1
        other = F.when(main, F.sequence("g", last)).otherwise(F.sequence(F.lit(0), last))
        placed = now.join(mixed, "key").withColumn("own", own).withColumn("other", F.explode(other))
        placed = placed.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "node", "component")
        # A cell of two nodes is the common case: a pair is tested once, whatever number of bands brings it about.
        cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b"))
        pairs = self.likely(cells.where("n = 2 and a <> b").select("a", "b").distinct())
        seen = placed.join(cells.where("n > 2").select("cell"), "cell").join(self.nodes.select("node", "n_shingles", "digest", "sketch"), "node")
        likely = seen.groupBy("cell").applyInArrow(_likely(self.percent, self.least), "node long, digest binary, component long, block binary")
        likely = cut(likely.dropDuplicates(["block", "node"]))
        full = self.sets(_digests(pairs).union(likely.select("digest")))
        blocks = likely.join(full, "digest").groupBy("block")  # a set that comes from two tasks does no harm
        found = self.links(pairs, full).unionByName(blocks.applyInArrow(_links_in_block(self.percent), "a long, b long"))
        return found if links is None else found.unionByName(links)

    def split(self, nodes: DataFrame, joined: DataFrame) -> DataFrame:
        """Links between some nodes by wide bands, which sets that are not similar rarely share."""
        digests = cut(self.nodes.join(nodes, "node", "left_semi").select("node", "digest"))
        keys = self.sets(digests.select("digest"), bands_for(self.percent / 100, WIDE))
        spread = cut(digests.join(keys, "digest").select("node", F.explode("keys").alias("key")).distinct())
        members = buckets(spread)
        # what is in one component already needs no leader
        apart = members.join(joined, members.node == joined.id, "left").groupBy("key")
        apart = apart.agg(F.countDistinct(F.coalesce("component", "node")).alias("n")).where("n > 1")
        members = cut(members.join(apart.select("key"), "key"))
        links = cut(self.led(members))
        return links.unionByName(self.others(members, components(links.unionByName(_as_links(joined))), wide=True))


def _digests(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("da", "db")).alias("digest"))


def _as_links(joined: DataFrame) -> DataFrame:
    return joined.select(F.col("id").alias("a"), F.col("component").alias("b"))


def buckets(spread: DataFrame) -> DataFrame:
    """Members of keys that several nodes have: key, node, members."""
    shared = spread.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    return cut(spread.join(shared, "key").select("key", "node", "members"))


def _decided(documents: DataFrame, shingle: int, percent: int, block: int) -> DataFrame:
    """doc_id, rk (a hash of id and text), n_shingles and top (doc_id and rk of the first row of its component) of each row."""
    bands = bands_for(percent / 100)
    texts = texts_of(documents)
    kind = "doc_id long, rk long, n_shingles long, digest binary, keys array<long>, sketch binary"
    with small_batches(documents.sparkSession):
        signed = cut(texts.withColumn("rk", F.xxhash64("doc_id", "text")).mapInArrow(_signed(shingle, bands), kind))
    with_set = signed.where("doc_id is not null and n_shingles > 0")
    first = with_set.groupBy("digest").agg(F.min(F.struct("doc_id", "rk", "n_shingles", "keys", "sketch")).alias("f"))
    mark = F.xxhash64("f.doc_id").alias("mark")
    nodes = cut(first.select(F.monotonically_increasing_id().alias("node"), "digest", "f.*", mark))

    search = _Search(texts, nodes, shingle, percent, block, ROWS * bands)
    members = buckets(nodes.select("node", F.explode("keys").alias("key")))
    tidy(documents.sparkSession)
    near = cut(search.led(members))
    tidy(documents.sparkSession)
    joined = components(near)
    tidy(documents.sparkSession)
    late = cut(search.others(members, joined))
    tidy(documents.sparkSession)
    found = components(near.unionByName(late)) if not late.isEmpty() else joined

    # Copies follow the first row of their set, sets the first set of their component.
    least = nodes.select("node", "digest", F.struct("doc_id", "rk").alias("least"))
    linked = found.join(least, found.id == least.node)
    top = linked.groupBy("component").agg(F.min("least").alias("top"))
    moved = linked.join(top, "component").select("digest", "top").where("top <> least")
    # a table of its own, so that AQE can split the rows of a hot set in the join with it
    own = cut(least.join(moved, "digest", "left").select("digest", F.coalesce("top", "least").alias("top")))
    has_set = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return signed.select("doc_id", "rk", "n_shingles", F.when(has_set, F.col("digest")).alias("digest")).join(own, "digest", "left")


def near_duplicates(documents: DataFrame, *, shingle: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """Components of documents whose word shingle sets are similar.

    ``documents``: doc_id, text and any other columns (ignored, whatever their
    names). A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``. Two documents
    are linked if 100 * intersection >= ``percent`` * union of their sets of
    ``shingle``-word shingles (64-bit hashes).

    Returns one row for each input row: doc_id, n_shingles (long), component_id
    (the smallest doc_id reachable through links), kept (doc_id = component_id).

    Null or empty text, or text without words: n_shingles 0, its own component.
    Fewer words than ``shingle``: the whole sequence is the one shingle. Null
    doc_id: component_id null, kept true, linked with nothing. Every row is a
    document of its own: rows with one doc_id and different texts are linked
    only if the texts are, and may be in different components. Ties have no
    influence. An empty table gives an empty result.
    """
    rows = _decided(documents, shingle, percent, block)
    component = F.coalesce("top.doc_id", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(documents: DataFrame, *, shingle: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """The first row of each component of ``near_duplicates``, and every row without words; all columns, unchanged.

    The first row has the smallest doc_id, then the smallest hash of its text.
    Of rows with equal doc_id and text one stays, whatever their other columns
    hold. Rows with one doc_id and texts that are not linked all stay. Rows with
    null doc_id stay.
    """
    rows = _decided(documents, shingle, percent, block).where("top is not null")
    stays = (F.col("doc_id") == F.col("top.doc_id")) & (F.col("rk") == F.col("top.rk"))
    few = rows.groupBy("doc_id", "rk").agg(F.bool_and(stays).alias("stays"), F.count("*").alias("n")).where("not stays or n > 1")
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    docs = aside(documents, doc_id=doc_id, rk=F.xxhash64(doc_id, text))
    left = docs.join(few.hint("merge"), ["doc_id", "rk"], "left").where("stays is null or stays").withColumn("place", F.monotonically_increasing_id())
    left = left.withColumn("single", F.when(F.col("n") > 1, F.lit(-1)).otherwise(F.col("place")))
    nth = F.row_number().over(Window.partitionBy("doc_id", "rk", "single").orderBy("place"))
    return left.withColumn("nth", nth).where("nth = 1").select("row.*")
