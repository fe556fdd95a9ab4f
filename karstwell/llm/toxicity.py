"""Toxicity classification with counterfactual regularisation.

A sparse logistic model over the words of a text and their leading letters. For
training sentences that name an identity, the terms are swapped for others of
their group; differences between a sentence's score and those of its swaps are
penalised, so that naming a group alone does not raise the score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karstwell.llm.shared import texts_of
from karstwell.llm.words import Words, bounded, slices

#: Groups of identity terms; a term is swapped for the next ones of its group.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants", "sikhs"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual", "homosexual"),
    ("man", "woman"),
    ("men", "women"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab"),
    ("american", "mexican", "chinese", "indian", "russian", "german", "french", "turkish", "nigerian"),
    ("deaf", "blind", "disabled", "autistic", "paralyzed"),
    ("old", "young", "elderly", "teenage"),
)
SWAPS = 2
#: Feature hashes; leading letters of a word that are features besides the word.
BITS, PREFIXES = 22, (4, 5, 6)
CACHE_WORDS = 400_000

# ASCII letters in lower case; other ASCII bytes end a word.
_TABLE = np.array([ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256)], np.uint8)
_SWAP = {t.encode(): [g[(i + k) % len(g)].encode() for k in range(1, min(SWAPS, len(g) - 1) + 1)] for g in IDENTITY_TERMS for i, t in enumerate(g)}


def features(raw: bytes) -> list[int]:
    """Feature hashes of a word: itself, and its first letters if it has more."""
    word = raw.decode("utf-8", "replace").lower()
    mask = (1 << BITS) - 1
    return [zlib.crc32(b"=" + word.encode()) & mask] + [zlib.crc32(word[:n].encode()) & mask for n in PREFIXES if len(word) > n]


@bounded
def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct features of each labelled text and of its swaps (which follow it, with the same id)."""
    known: dict[bytes, list[int]] = {}
    for batch in batches:
        for part, text in slices(batch, limit=1 << 20):
            words = Words(text, _TABLE)
            distinct, codes = words.coded()
            distinct = distinct.to_pylist()
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in distinct:
                if w not in known:
                    known[w] = features(w)
            identity = {i for i, w in enumerate(distinct) if w in _SWAP}
            rows, sets = [], []
            for i in range(len(text)):
                own = np.unique(codes[words.row_start[i] : words.row_start[i + 1]]).tolist()
                variants = [[known[distinct[c]] for c in own]]
                if identity and any(c in identity for c in own):
                    for k in range(SWAPS):
                        swapped = [_SWAP[distinct[c]][k % len(_SWAP[distinct[c]])] if c in identity else distinct[c] for c in own]
                        variants.append([features(w) if c in identity else known[w] for c, w in zip(own, swapped, strict=True)])
                for v in variants:
                    rows.append(i)
                    sets.append(sorted({f for x in v for f in x}))
            take = pa.array(rows, pa.int64())
            yield pa.record_batch([part.column("row").take(take), part.column("toxic").take(take), part.column("weight").take(take), pa.array(sets, pa.list_(pa.int32()))], ["row", "toxic", "weight", "features"])


@dataclass
class ToxicityModel:
    bias: float
    weights: dict[int, float]
    trained_on: int

    def predict(self, documents: DataFrame) -> DataFrame:
        """doc_id and score for each row of ``documents`` (doc_id, text)."""
        shared = documents.sparkSession.sparkContext.broadcast(self)  # at most the features that were kept

        @bounded
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            score = _Scorer(shared.value)
            for batch in batches:
                for part, text in slices(batch):
                    yield pa.record_batch([part.column("doc_id"), pa.array(score(text))], ["doc_id", "score"])

        texts = texts_of(documents)
        return texts.mapInArrow(run, "doc_id long, score double")

    def clean(self, documents: DataFrame, threshold: float) -> DataFrame:
        """The rows of ``documents`` that score below ``threshold``, with all their columns."""
        shared = documents.sparkSession.sparkContext.broadcast(self)

        @bounded
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            score = _Scorer(shared.value)
            for batch in batches:
                for part, text in slices(batch):
                    yield part.filter(pa.array(score(text) < threshold))

        return documents.mapInArrow(run, documents.schema)


class _Scorer:
    """Scores texts; remembers which words have a feature with a weight."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.ids = {f: i for i, f in enumerate(model.weights)}
        self.w = np.array(list(model.weights.values()))
        self.seen: dict[bytes, tuple[int, ...]] = {}

    def __call__(self, text: pa.Array) -> np.ndarray:
        words = Words(text, _TABLE)
        distinct, codes = words.coded()
        distinct = distinct.to_pylist()
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        seen, ids = self.seen, self.ids
        each = []
        for w in distinct:
            found = seen.get(w)
            if found is None:
                found = seen[w] = tuple([ids[f] for f in features(w) if f in ids])
            each.append(found)
        active = np.fromiter((len(x) for x in each), np.int64, len(each))
        z = np.full(len(text), self.model.bias)
        hit = np.flatnonzero(active[codes]) if len(codes) else ()
        if len(hit):
            # distinct (row, word), then distinct (row, feature): a feature counts once
            pair = np.unique(words.rows()[hit] * np.int64(len(each)) + codes[hit])
            row, code = pair // len(each), pair % len(each)
            row = np.repeat(row, active[code])
            feature = np.concatenate([each[c] for c in code])
            both = np.unique(row * np.int64(len(self.w)) + feature)
            z += np.bincount(both // len(self.w), self.w[both % len(self.w)], len(text))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _train(sets: list[np.ndarray], y: np.ndarray, weight: np.ndarray, group: np.ndarray, *, kept: int, l1: float, fairness: float, rounds: int) -> tuple[float, dict[int, float]]:
    """Proximal gradient with momentum. ``group``: rows of one sentence; its first row is the labelled one."""
    labelled = np.append(True, group[1:] != group[:-1])
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets), dtype=np.int32), size)
    cols = np.concatenate(sets)
    n1, n0 = max(1, (y[labelled] == 1).sum()), max(1, (y[labelled] == 0).sum())
    width, bad = 1 << BITS, y[row] == 1
    first = labelled[row]
    d1 = np.bincount(cols[first & bad], minlength=width)
    d0 = np.bincount(cols[first & ~bad], minlength=width)
    often = np.flatnonzero(d1 + d0 >= 3)
    d1, d0 = d1[often] / n1, d0[often] / n0
    strength = np.abs(d1 - d0) / np.sqrt(d1 + d0)
    order = np.lexsort((often, -strength))[:kept]
    used = often[order[strength[order] > 0]]
    place = np.full(width, -1, np.int32)
    place[used] = np.arange(len(used))
    col = place[cols]
    row, col = row[col >= 0], col[col >= 0]
    m = len(used)
    total = weight[labelled].sum()
    own = weight * labelled / total
    anchor = np.flatnonzero(labelled)[np.cumsum(labelled) - 1]
    swap = ~labelled
    swaps = max(1, swap.sum())
    w, b = np.zeros(m), float(np.log((own * (y == 1)).sum() + 1e-6) - np.log((own * (y == 0)).sum() + 1e-6))
    v, u, t = w.copy(), b, 1.0
    density = np.bincount(row, minlength=len(sets)).max(initial=1) + 1
    step = 1.0 / (0.25 * min(density, 64) + fairness * swap.any() * 8)
    for _ in range(rounds):
        z = np.bincount(row, v[col], len(sets)) + u
        g = own * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        if swap.any():
            gap = np.where(swap, z - z[anchor], 0) * (2 * fairness / swaps)
            g = g + gap - np.bincount(anchor, gap, len(sets))
        new = v - step * np.bincount(col, g[row], m)
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_b = u - step * g.sum()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, u = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new, new_b, new_t
    return b, {int(used[i]): float(w[i]) for i in np.flatnonzero(w)}


def fit_toxicity(documents: DataFrame, labels: DataFrame, *, learn: Column | None = None, positives: int = 4000, negatives: int = 6000, kept: int = 8192, l1: float = 0.01, fairness: float = 1.0, rounds: int = 250) -> ToxicityModel:
    """Fits the classifier on about ``positives`` and ``negatives`` labelled rows, chosen by a hash of their id.

    ``documents``: doc_id, text; ``labels``: doc_id, toxic (0 or 1; other values
    and nulls are left out; the larger counts if an id has both). ``learn`` is a
    further condition on doc_id. Classes are weighted back to their true shares.
    The penalty of a weight's size is ``l1`` over the root of the number of rows;
    ``fairness`` weighs the squared differences between swapped sentences.
    Without rows of both classes the model has no weights, and its score is the
    logistic of 4 (only toxic rows) or of -4.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    if learn is not None:
        marks = marks.where(learn)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    share = {k: min(1.0, limit / n[k]) for k, limit in ((1, positives), (0, negatives)) if k in n}
    if len(share) < 2:
        return ToxicityModel(4.0 if 1 in n else -4.0, {}, 0)
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < F.when(F.col("toxic") == 1, int(share[1] * (1 << 30))).otherwise(int(share[0] * (1 << 30)))
    sample = marks.where(chosen).withColumn("weight", F.when(F.col("toxic") == 1, 1 / share[1]).otherwise(1 / share[0]).cast("double"))
    # the sample has about positives + negatives rows whatever the table's size
    texts = texts_of(documents).join(F.broadcast(sample), "doc_id")
    made = texts.select(F.xxhash64("doc_id", "text").alias("row"), "text", "toxic", "weight").mapInArrow(_training_rows, "row long, toxic int, weight double, features array<int>").toArrow()
    ids = made["row"].to_numpy()
    order = np.argsort(ids, kind="stable")  # the same fit in whatever order the rows come
    lists = made["features"].combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    sets = [values[offsets[i] : offsets[i + 1]] for i in order]
    if not sets:
        return ToxicityModel(-4.0, {}, 0)
    y = made["toxic"].to_numpy()[order].astype(float)
    bias, weights = _train(sets, y, made["weight"].to_numpy()[order], ids[order], kept=kept, l1=l1 / np.sqrt(len(sets)), fairness=fairness, rounds=rounds)
    return ToxicityModel(bias, weights, len(sets))


def score_toxicity(documents: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """Fits on ``labels`` and the texts of ``documents`` (doc_id, text; other columns ignored), and scores each row.

    Returns doc_id, score (0 to 1), predicted (1 if score >= ``threshold``).
    ``options``: those of ``fit_toxicity``.

    Null or empty text has no features and gets the score of the bias. Null
    doc_id and repeated rows are scored like any other; equal texts get equal
    scores. Whole texts are scored, in time linear in their length. No labels:
    every score is below the threshold. An empty table gives an empty result.
    """
    scored = fit_toxicity(documents, labels, **options).predict(documents)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(documents: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``documents`` that ``score_toxicity`` scores below ``threshold``, unchanged and with all columns."""
    return fit_toxicity(documents, labels, **options).clean(documents, threshold)
