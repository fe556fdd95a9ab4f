"""Removal of word windows that an earlier document has, by super-k-mer partitioning.

The minimiser of a window is the least hash of its runs of ``MINIMISER`` words.
Consecutive windows of a document with the same minimiser are one super-k-mer:
one packed string that travels to the bucket of its minimiser, where all windows
are sorted and compared word by word. Two documents can share a window only if
they share its minimiser, so minimisers are counted first, and a bitmap of
bounded size (a Bloom filter) tells which of them several documents have; only
super-k-mers that pass it travel. What passes by mistake costs a journey and
changes nothing; a bitmap that is too full lets all of them travel.

Buckets are measured in windows. A minimiser with more than a bucket's (huge
groups of copies, very common passages) would overfill one. Its super-k-mers
travel as 128-bit digests: equal ones become one before the shuffle, only
distinct ones are cut into windows, whose smallest doc_id is aggregated before
the shuffle again, and each super-k-mer gets its windows' results back as one
array, in a join that AQE can split.

Whole texts are never shuffled but for documents that lose words: a second
bitmap tells the others apart, which are finished where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karstwell.llm.shared import Bitmap, cut, texts_of
from karstwell.llm.words import Words, bounded, mix, slices

MINIMISER = 12
#: Windows of a minimiser that are sorted together at most, and of a bucket, about (3 MB of keys of 50 words).
HOT = BUCKET = 16_384
#: Windows of a super-k-mer at most.
RUN = 255

_K = np.uint64(0xD6E8FEB86659FD93)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n, size = len(values) - width + 1, 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:n], values[rest : rest + n])


def super_kmers(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, minimiser, first window (word of the row) and number of windows of each super-k-mer."""
    counts = words.counts()
    hashes = words.hashes()
    empty = np.zeros(0, np.int64)
    m = min(MINIMISER, window)
    if len(hashes) < window:
        return empty, empty.astype(np.uint64), empty, empty
    with np.errstate(over="ignore"):
        n = len(hashes) - m + 1
        grams = np.zeros(n, np.uint64)
        for j in range(m):
            grams = (grams + hashes[j : j + n]) * _K
        least = _sliding_min(mix(grams), window - m + 1)
    row = np.repeat(np.arange(len(counts)), counts)
    inner = np.arange(len(hashes)) - words.row_start[row]
    ok = np.flatnonzero((inner + window <= counts[row])[: len(least)])
    if not len(ok):
        return empty, empty.astype(np.uint64), empty, empty
    value, r, p = least[ok], row[ok], inner[ok]
    new = np.ones(len(ok), bool)
    new[1:] = (value[1:] != value[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(ok)))
    if size.max() > RUN:  # long runs are cut; the parts go to the same bucket
        parts = -(-size // RUN)
        base = np.repeat(first, parts)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = base + nth * RUN
        size = np.minimum(RUN, np.repeat(size, parts) - nth * RUN)
    return r[first], value[first], p[first], size


def _minimisers(window: int):
    @bounded
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in slices(batch):
                row, value, _, size = super_kmers(Words(text), window)
                columns = [pa.array(value.view(np.int64)), part.column("doc_id").take(pa.array(row)), pa.array(size, pa.int64())]
                yield pa.record_batch(columns, ["minimiser", "doc_id", "windows"])

    return run


def _pack(window: int, shared, hot):
    """The packed strings (words joined by spaces) of super-k-mers in ``shared``; of those in ``hot``, also a digest."""

    @bounded
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in slices(batch):
                words = Words(text)
                row, value, start, size = super_kmers(words, window)
                chosen = shared.value.has(value)
                is_hot = np.zeros(len(value), bool)
                if hot is not None:
                    is_hot = hot.value.has(value) & chosen
                pick = np.flatnonzero(chosen)
                # one run of single spaces between words, whatever stood in the text
                lengths = np.zeros(len(words) + 1, np.int64)
                np.cumsum(words.end - words.start + 1, out=lengths[1:])
                joined = np.full(int(lengths[-1]), 0x20, np.uint8)
                inside = np.ones(len(joined), bool)
                inside[lengths[1:] - 1] = False
                joined[inside] = words.data[words.solid]
                joined = joined.tobytes()
                first = words.row_start[row[pick]] + start[pick]
                begin, end = lengths[first], lengths[first + size[pick] + window - 1] - 1
                packed = [joined[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
                kmer = [hashlib.blake2b(p, digest_size=16).digest() if h else None for p, h in zip(packed, is_hot[pick].tolist(), strict=True)]
                take = pa.array(row[pick])
                yield pa.RecordBatch.from_arrays([pa.array(value[pick].view(np.int64)), part.column("doc_id").take(take), part.column("rk").take(take), pa.array(start[pick]), pa.array(packed, pa.binary()), pa.array(kmer, pa.binary())], ["minimiser", "doc_id", "rk", "start", "packed", "kmer"])

    return run


def _count(window: int):
    """Ranges of words covered by windows that a smaller document of the bucket has."""

    def run(table: pa.Table) -> pa.Table:
        packed = table.column("packed").cast(pa.large_binary()).combine_chunks()
        if isinstance(packed, pa.ChunkedArray):
            packed = pa.concat_arrays(packed.chunks)
        words = Words(packed.view(pa.large_string()))
        _, codes = words.coded()
        counts = words.counts()
        n = counts - window + 1
        row = np.repeat(np.arange(len(n)), n)
        pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = words.row_start[row] + pos
        # big-endian, so that bytes sort as numbers do
        view = np.lib.stride_tricks.sliding_window_view(codes.astype(">u4"), window)
        keys = np.ascontiguousarray(view[at]).view(f"V{4 * window}").ravel()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        group = np.cumsum(np.append(False, keys[1:] != keys[:-1]))
        ids = table.column("doc_id").to_numpy()
        own = ids[row]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        least = np.minimum.reduceat(own[order], first)[group]
        covered = np.zeros(len(row), bool)
        covered[order] = least < own[order]
        hit = np.flatnonzero(covered)
        new = np.ones(len(hit), bool)
        new[1:] = (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])
        a = hit[np.flatnonzero(new)]
        b = hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)] if len(hit) else hit
        start = table.column("start").to_numpy()
        keys_ = table.column("rk").to_numpy()
        return pa.table({"doc_id": pa.array(own[a], pa.int64()), "rk": pa.array(keys_[row[a]], pa.int64()), "a": pa.array(start[row[a]] + pos[a], pa.int64()), "b": pa.array(start[row[a]] + pos[b] + window, pa.int64())})

    return run


def _windows(window: int):
    """Digests of the distinct windows of packed strings, with their places (a string may repeat itself)."""

    @bounded
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for kmer, doc, packed in zip(*(batch.column(c).to_pylist() for c in ("kmer", "doc_id", "packed")), strict=True):
                words = packed.split(b" ")
                places: dict[bytes, list[int]] = {}
                for j in range(len(words) - window + 1):
                    places.setdefault(hashlib.blake2b(b" ".join(words[j : j + window]), digest_size=16).digest(), []).append(j)
                out += [(kmer, digest, doc, at) for digest, at in places.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64())))], ["kmer", "digest", "doc_id", "places"])

    return run


@bounded
def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each text without those in its ranges (no such column: all words)."""
    for batch in batches:
        for part, text in slices(batch):
            words = Words(text)
            counts, size = words.counts(), words.end - words.start
            keep = np.ones(len(words), bool)
            if "ranges" in part.schema.names:
                for first, ranges in zip(words.row_start[:-1].tolist(), part.column("ranges").to_pylist(), strict=True):
                    for r in ranges or ():
                        keep[first + r["a"] : first + r["b"]] = False
            row = words.rows()[keep]
            inner = np.append(row[1:] == row[:-1], False)[: len(row)]  # a space follows
            own = size[keep] + inner
            ends = np.cumsum(own)
            joined = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
            solid = np.ones(len(joined), bool)
            solid[ends[inner] - 1] = False
            joined[solid] = words.data[words.solid][np.repeat(keep, size)]
            offsets = np.zeros(len(text) + 1, np.int64)
            np.cumsum(np.bincount(row, own, len(text)).astype(np.int64), out=offsets[1:])
            kept = pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(offsets), pa.py_buffer(joined)).cast(pa.string())
            removed = counts - np.bincount(row, minlength=len(text))
            yield pa.record_batch([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), kept], ["doc_id", "n_words", "n_removed", "kept"])


def _hot_ranges(packed: DataFrame, window: int) -> DataFrame:
    """Covered ranges of super-k-mers of hot minimisers, as an array for each."""
    distinct = packed.groupBy("kmer").agg(F.min("doc_id").alias("doc_id"), F.first("packed").alias("packed"))
    single = distinct.mapInArrow(_windows(window), "kmer binary, digest binary, doc_id long, places array<long>")
    least = single.groupBy("digest").agg(F.min("doc_id").alias("least"))
    windows = single.join(least, "digest").groupBy("kmer").agg(F.collect_list(F.struct("places", "least")).alias("windows"))  # RUN places at most
    late = F.filter("windows", lambda w: w["least"] < F.col("doc_id"))
    late = F.transform(F.flatten(F.transform(late, lambda w: w["places"])), lambda p: F.struct((F.col("start") + p).alias("a"), (F.col("start") + p + window).alias("b")))
    return packed.select("kmer", "doc_id", "rk", "start").join(windows, "kmer").select("doc_id", "rk", late.alias("ranges")).where(F.size("ranges") > 0)


def remove_repeats(documents: DataFrame, *, window: int = 50) -> DataFrame:
    """Removes words covered by a ``window``-word sequence that also starts in a document with a smaller doc_id.

    ``documents``: doc_id, text and any other columns (ignored). Words are
    ``[^\\x20\\x09-\\x0D]+``, compared unchanged; windows are judged on the input.

    Returns one row for each input row: doc_id, n_words, n_removed, kept (the
    words left, joined by one space).

    Null or empty text: no words, kept empty. Fewer words than a window: nothing
    goes. Null doc_id: nothing goes, and no other document loses words for it.
    Rows with the same doc_id never remove words from each other. An empty table
    gives an empty result.
    """
    texts = texts_of(documents).fillna("", ["text"])
    known = texts.where("doc_id is not null").withColumn("rk", F.xxhash64("doc_id", "text"))
    sc = documents.sparkSession.sparkContext
    counted = known.mapInArrow(_minimisers(window), "minimiser long, doc_id long, windows long").groupBy("minimiser")
    counted = counted.agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), F.sum("windows").alias("n"))
    shared = cut(counted.where("x < y").select("minimiser", "n"))
    hot = F.col("n") > HOT
    keys, hot_keys, windows = shared.agg(F.count("*"), F.count_if(hot), F.coalesce(F.sum(F.when(~hot, F.col("n"))), F.lit(0))).first()
    in_shared = sc.broadcast(Bitmap(shared.select("minimiser"), keys))
    in_hot = sc.broadcast(Bitmap(shared.where(hot).select("minimiser"), hot_keys)) if hot_keys else None
    packed = known.mapInArrow(_pack(window, in_shared, in_hot), "minimiser long, doc_id long, rk long, start long, packed binary, kmer binary")
    cold = packed.where("kmer is null").drop("kmer")
    bucket = F.pmod(F.xxhash64("minimiser"), F.lit(_parts(windows))).alias("bucket")
    ranges = cold.groupBy(bucket).applyInArrow(_count(window), "doc_id long, rk long, a long, b long")
    found = ranges.select("doc_id", "rk", F.array(F.struct("a", "b")).alias("ranges"))
    if hot_keys:
        found = found.unionByName(_hot_ranges(packed.where("kmer is not null"), window))
    gone = cut(found.groupBy("doc_id", "rk").agg(F.flatten(F.collect_list("ranges")).alias("ranges")))
    lossy = sc.broadcast(Bitmap(gone.select("rk"), gone.count()))
    result = "doc_id long, n_words long, n_removed long, kept string"
    nothing = texts.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("rk"), "text")
    whole = nothing.unionByName(known.select("doc_id", "rk", "text")).mapInArrow(lambda batches: _cut_out(_chosen(lossy, False)(batches)), result)
    less = known.mapInArrow(_chosen(lossy, True), known.schema).join(gone, ["doc_id", "rk"], "left")
    return whole.unionByName(less.select("doc_id", "text", "ranges").mapInArrow(_cut_out, result))


def _parts(windows: int) -> int:
    return max(1, -(-windows // BUCKET))


def _chosen(lossy, wanted: bool):
    """Rows whose key is, or isn't, in a bitmap; a null key isn't."""

    @bounded
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rk = batch.column("rk")
            has = lossy.value.has(rk.fill_null(0).to_numpy().view(np.uint64)) & rk.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(has == wanted))

    return run
