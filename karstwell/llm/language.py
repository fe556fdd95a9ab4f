"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary
(fitted by expectation maximisation on a bounded sample). A word's probability
is the sum over all its segmentations into pieces, by the forward algorithm; a
text's is the product over its words. All sums are kept as logarithms, so that
words of any length and script keep their evidence.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karstwell.llm.shared import texts_of
from karstwell.llm.words import Words, bounded, mix, slices

#: Letters of a piece at most.
PIECE_LETTERS = 8
#: Probability of a letter that is no piece, in every language.
UNKNOWN = 1e-7
CACHE_WORDS = 400_000
#: Words whose lattices are built together.
LATTICE_WORDS = 20_000
MAX_LANGUAGES = 1000

_MARK = "▁"
_R = np.uint64(0x9E3779B97F4A7C15)
# ASCII letters in lower case; other ASCII bytes end a word.
_TABLE = np.array([ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else b if b >= 128 else 32 for b in range(256)], np.uint8)


def vocabulary(path: str) -> list[str]:
    """Lower-case letter pieces of a sentencepiece model, also such with the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        letters = piece.removeprefix(_MARK)
        if letters.isalpha() and letters == letters.lower() and len(letters) <= PIECE_LETTERS:
            out.append(piece)
    return out


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Pieces:
    """Hashes of pieces, by their number of letters and whether they bind to the start of a run of letters."""

    def __init__(self, names: list[str]):
        self.count = len(names)
        own = defaultdict(list)
        for i, name in enumerate(names):
            letters = name.removeprefix(_MARK)
            own[name != letters, len(letters)].append((letters, i))
        self.tables = {}
        for key, rows in own.items():
            width = key[1]
            cells = _letters("".join(x for x, _ in rows)).reshape(-1, width)
            hashes = np.zeros(len(rows), np.uint64)
            with np.errstate(over="ignore"):
                for j in range(width):
                    hashes = hashes * _R + cells[:, j]
            hashes = mix(hashes)
            order = np.argsort(hashes)
            self.tables[key] = hashes[order], np.array([i for _, i in rows], np.int32)[order]

    def find(self, marked: bool, width: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some hashes are pieces, and those pieces' numbers."""
        known, numbers = self.tables.get((marked, width), (np.zeros(0, np.uint64), np.zeros(0, np.int32)))
        if not len(known):
            return np.zeros(0, np.int64), numbers
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hit = np.flatnonzero(known[at] == hashes)
        return hit, numbers[at[hit]]


class Lattice:
    """All pieces at all places of some words.

    Node ``base[w] + i`` is the place before letter i of word w. A node that no
    piece spans is a cut: every segmentation passes it, so the sum over a word's
    segmentations is the product of the sums between its cuts.
    """

    def __init__(self, words: list[str], pieces: Pieces):
        size = np.fromiter(map(len, words), np.int64, len(words))
        letters = _letters("".join(words))
        n = len(letters)
        word = np.repeat(np.arange(len(words)), size)
        begin = np.cumsum(size) - size
        self.base = begin + np.arange(len(words))
        node = np.arange(n) + word
        left = (begin + size)[word] - np.arange(n)
        start, width, piece = [], [], []
        single = np.zeros(n, bool)
        hashes = np.zeros(n, np.uint64)
        for k in range(1, min(PIECE_LETTERS, n) + 1):
            with np.errstate(over="ignore"):
                hashes = hashes[: n - k + 1] * _R + letters[k - 1 :]
            for marked, at in ((False, np.flatnonzero(left[: n - k + 1] >= k)), (True, begin[size >= k])):
                hit, number = pieces.find(marked, k, mix(hashes[at]))
                at = at[hit]
                start.append(node[at])
                width.append(np.full(len(at), k))
                piece.append(number)
                if k == 1:
                    single[at] = True
        unknown = np.flatnonzero(~single)
        start.append(node[unknown])
        width.append(np.ones(len(unknown), np.int64))
        piece.append(np.full(len(unknown), pieces.count, np.int32))
        start, piece = np.concatenate(start), np.concatenate(piece)
        end = start + np.concatenate(width)

        self.nodes = nodes = n + len(words)
        spans = np.bincount(start + 1, minlength=nodes + 2)[: nodes + 1] - np.bincount(end, minlength=nodes + 1)[: nodes + 1]
        self.cut = np.cumsum(spans)[:nodes] == 0
        place = np.arange(nodes)
        before = np.maximum.accumulate(np.where(self.cut, place, -1))
        #: the cut at or behind each node
        self.after = np.minimum.accumulate(np.where(self.cut, place, nodes)[::-1])[::-1]
        depth = end - before[end - 1]
        order = np.lexsort((end, depth))
        self.start, self.end, self.piece = start[order], end[order], piece[order]
        self.levels = _steps(depth[order])
        # for the way back: by distance from the cut before the start
        depth = self.start - before[self.start]
        self.back = np.lexsort((self.start, -depth))
        self.back_levels = _steps(depth[self.back])
        self.word = np.repeat(np.arange(len(words)), size + 1)

    def _forward(self, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log sums over the ways from the cut before: for nodes as starts (0 at a cut), and for cuts as ends."""
        inside, total = np.zeros((self.nodes, log.shape[1])), np.zeros((self.nodes, log.shape[1]))
        for a, b in zip(self.levels[:-1], self.levels[1:], strict=True):
            ends, value = _log_sums(self.end[a:b], inside[self.start[a:b]] + log[self.piece[a:b]])
            cut = self.cut[ends]
            total[ends[cut]] = value[cut]
            inside[ends[~cut]] = value[~cut]
        return inside, total

    def forward(self, log: np.ndarray) -> np.ndarray:
        """Log of the sum over all segmentations of each word; ``log``: log probabilities, pieces x languages."""
        _, total = self._forward(log)
        return np.add.reduceat(total, self.base, axis=0) if len(self.base) else np.zeros((0, log.shape[1]))

    def expected(self, log: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece; ``weight``: words x languages."""
        inside, total = self._forward(log)
        rest = np.zeros_like(inside)  # log sums over the ways to the cut behind
        for a, b in zip(self.back_levels[:-1], self.back_levels[1:], strict=True):
            own = self.back[a:b]
            starts, value = _log_sums(self.start[own], rest[self.end[own]] + log[self.piece[own]])
            inner = ~self.cut[starts]
            rest[starts[inner]] = value[inner]
        use = inside[self.start] + log[self.piece] + rest[self.end] - total[self.after[self.end]]
        use = np.exp(use) * weight[self.word[self.start]]
        return np.stack([np.bincount(self.piece, use[:, k], len(log)) for k in range(log.shape[1])], axis=1)


def _steps(level: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin, and the end."""
    return np.append(np.flatnonzero(np.append(True, level[1:] != level[:-1])), len(level)) if len(level) else np.zeros(1, np.int64)


def _log_sums(keys: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``keys`` (equal ones lie together), and log(sum(exp(value))) of the rows of each."""
    first = _steps(keys)[:-1]
    if len(first) == len(keys):
        return keys, value
    most = np.maximum.reduceat(value, first, axis=0)
    value = np.exp(value - np.repeat(most, np.diff(np.append(first, len(keys))), axis=0))
    return keys[first], most + np.log(np.add.reduceat(value, first, axis=0))


def _split(raw: bytes) -> list[str]:
    """Runs of letters of a word, in lower case."""
    word = raw.decode("utf-8", "replace").lower()
    return [word] if word.isalpha() else ["".join(own) for letter, own in groupby(word, str.isalpha) if letter]


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: Pieces
    log_prior: np.ndarray
    log: np.ndarray  # log probabilities: pieces and the unknown letter x languages

    def scorer(self) -> _Scorer:
        """A worker process keeps its scorer, and the words that it knows, from one task to the next."""
        if not hasattr(self, "_scorer"):
            self._scorer = _Scorer(self)
        return self._scorer

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_scorer"}

    def predict(self, documents: DataFrame) -> DataFrame:
        """doc_id, lang_pred, score for each row of ``documents`` (doc_id, text)."""
        shared = documents.sparkSession.sparkContext.broadcast(self)  # bounded by the vocabulary and MAX_LANGUAGES

        @bounded
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = shared.value.scorer()
            for batch in batches:
                for part, text in slices(batch):
                    lang, score = scorer(text)
                    yield pa.record_batch([part.column("doc_id"), lang, score], ["doc_id", "lang_pred", "score"])

        texts = texts_of(documents)
        return texts.mapInArrow(run, "doc_id long, lang_pred string, score double")


class _Scorer:
    def __init__(self, model: LanguageModel):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.at: dict[bytes, int] = {}
        self.rows = np.zeros((1024, len(self.model.languages) + 1), np.float32)
        self.used = 0

    def _learn(self, new: list[bytes]) -> None:
        runs = [_split(w) for w in new]
        flat = [r for x in runs for r in x]
        count = np.array([len(x) for x in runs], np.int64)
        if flat:
            log = Lattice(flat, self.model.pieces).forward(self.model.log)
        need = self.used + len(new)
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(need, 2 * len(self.rows)) - len(self.rows), self.rows.shape[1]), np.float32)])
        block = self.rows[self.used : need]
        block[:] = 0
        full = np.flatnonzero(count)
        if len(full):
            block[full, :-1] = np.add.reduceat(log, (np.cumsum(count) - count)[full], axis=0)
            block[full, -1] = 1
        self.at.update(zip(new, range(self.used, need), strict=True))
        self.used = need

    def __call__(self, text: pa.Array) -> tuple[pa.Array, pa.Array]:
        words = Words(text, _TABLE)
        distinct, codes = words.coded()
        distinct = distinct.to_pylist()
        if self.used > CACHE_WORDS:
            self._reset()
        new = [w for w in distinct if w not in self.at]
        for s in range(0, len(new), LATTICE_WORDS):
            self._learn(new[s : s + LATTICE_WORDS])
        rows = self.rows[np.fromiter((self.at[w] for w in distinct), np.int64, len(distinct))]
        total = np.zeros((len(text), rows.shape[1]))
        counts = words.counts()
        full = np.flatnonzero(counts)
        if len(full):
            for k in range(rows.shape[1]):
                total[full, k] = np.add.reduceat(rows[codes, k].astype(np.float64), words.row_start[full])
        lettered = total[:, -1] > 0
        logs = total[:, :-1] + self.model.log_prior
        if not logs.shape[1]:
            return pa.array(["und"] * len(text)), pa.array(np.zeros(len(text)))
        best = logs.argmax(axis=1)
        score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        names = pa.array([*self.model.languages, "und"])
        return names.take(pa.array(np.where(lettered, best, len(self.model.languages)))), pa.array(np.where(lettered, score, 0.0))


def fit_languages(documents: DataFrame, *, learn: Column | None = None, vocabulary_file: str | None = None, letters: int = 400_000, rounds: int = 4) -> LanguageModel:
    """Fits piece probabilities on about ``letters`` characters of each language.

    ``documents``: doc_id, text, lang. Rows with a null lang or text are left
    out; ``learn`` is a further condition. The sample is chosen by a hash of
    doc_id and text, at a rate for each language. No row to learn from: a model
    that answers ``und``. More than ``MAX_LANGUAGES`` languages: ValueError.
    """
    if vocabulary_file is None:
        import public_tokenizers

        vocabulary_file = public_tokenizers.path("piece_bpe_32k.model")
    pieces = Pieces(vocabulary(vocabulary_file))
    rows = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if learn is not None:
        rows = rows.where(learn)
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("_h"))
    sizes = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n"), F.count("*").alias("docs")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    sizes = sorted(sizes, key=lambda r: r["lang"])
    languages = [r["lang"] for r in sizes]
    if not languages:
        return LanguageModel([], pieces, np.zeros(0), np.zeros((pieces.count + 1, 0)))
    share = {r["lang"]: int((1 << 30) * min(1.0, letters / max(1, r["n"]))) for r in sizes}
    limit = documents.sparkSession.createDataFrame(list(share.items()), "lang string, _limit long")
    sample = rows.join(F.broadcast(limit), "lang").where("_h < _limit").select("lang", "text")
    counts = sample.mapInArrow(_word_counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()

    index = {x: i for i, x in enumerate(languages)}
    words: dict[str, int] = {}
    entries: list[tuple[int, int, int]] = []
    for lang, raw, n in zip(counts["lang"].to_pylist(), counts["word"].to_pylist(), counts["n"].to_pylist(), strict=True):
        for run in _split(raw):
            entries.append((words.setdefault(run, len(words)), index[lang], n))
    weight = np.zeros((len(words), len(languages)))
    for w, k, n in entries:
        weight[w, k] += n
    names = list(words)
    parts = [slice(i, i + LATTICE_WORDS) for i in range(0, len(names), LATTICE_WORDS)]
    lattices = [Lattice(names[p], pieces) for p in parts]
    log = np.full((pieces.count + 1, len(languages)), -np.log(pieces.count))
    for _ in range(rounds):
        log[-1] = np.log(UNKNOWN)
        uses = sum((x.expected(log, weight[p]) for x, p in zip(lattices, parts, strict=True)), np.zeros_like(log))[:-1] + 0.02
        log[:-1] = np.log(uses / uses.sum(axis=0))
    log[-1] = np.log(UNKNOWN)
    docs = np.array([r["docs"] for r in sizes], float)
    return LanguageModel(languages, pieces, np.log(docs / docs.sum()), log)


@bounded
def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, text in slices(batch):
            words = Words(text, _TABLE)
            distinct, codes = words.coded()
            langs = part.column("lang").dictionary_encode()
            both = langs.indices.to_numpy()[words.rows()].astype(np.int64) * max(1, len(distinct)) + codes
            value, n = np.unique(both, return_counts=True)
            yield pa.record_batch([langs.dictionary.take(pa.array(value // max(1, len(distinct)))), pc.cast(distinct.take(pa.array(value % max(1, len(distinct)))), pa.binary()), pa.array(n, pa.int64())], ["lang", "word", "n"])


def identify_languages(documents: DataFrame, **options) -> DataFrame:
    """Fits on ``documents`` (doc_id, text, lang; other columns are ignored) and predicts each of its rows.

    ``options``: those of ``fit_languages``. Returns doc_id, lang_pred, score
    (the posterior probability of lang_pred, 0 to 1).

    Null text, and text without a letter (empty, digits, punctuation): ``und``
    and 0. Null doc_id and repeated rows are rows like any other; rows with
    equal texts get equal predictions. Characters that are no letters (digits,
    also raised ones, marks) end a run of letters; runs are segmented whole,
    whatever their length. Ties go to the language that sorts first. An empty
    table gives an empty result.
    """
    return fit_languages(documents, **options).predict(documents)
