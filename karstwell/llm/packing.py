"""Cost-balanced packing of documents into sequences of bounded length.

A piece of n tokens costs ``LINEAR * n + n * n`` (attention does not cross
documents). Pieces are assigned in descending length to the sequence of lowest
cost that has room. Text is tokenised and packed in windows of bounded size
inside each task, so nothing is shuffled and no task holds more than a window.
"""

from __future__ import annotations

import string
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karstwell.llm.shared import cut, small_batches, texts_of
from karstwell.llm.words import Words, bounded, slices

#: Token ids that are packed together at most, if no single document has more.
WINDOW_TOKENS = 2 << 20
#: Words whose ids a worker keeps.
CACHE_WORDS = 150_000
#: Cost of a token besides attention, in units of one query-key product.
LINEAR = 6 * 768
#: Share of the tokens that may be padding, so that few documents have to be cut.
SLACK = 0.005

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _byte_letters() -> dict[int, int]:
    """The usual stand-ins of byte-level vocabularies: printable Latin-1 bytes for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


class Tokenizer:
    """Token ids of whole texts by a word-level tokenizer file, with a bounded cache of words.

    The tokenizer drops white space and never merges across it, so a text's ids
    are those of its words, one after the other. A word of letters, or of
    letters and then ASCII punctuation, is one or two units of its vocabulary's
    own splitting and goes straight to the merge model; all other words go
    through the whole tokenizer. ``tests/llm`` compares both with encoding whole
    texts. Only ASCII white space is cut at; what the tokenizer does with other
    white space stays inside a "word".
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Base

        self.base = Base.from_file(path)
        self.model = self.base.model
        self.known: dict[bytes, int] = {}
        self.units: dict[str, list[int]] = {}
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def _unit(self, unit: str) -> list[int]:
        letters = unit if unit.isascii() else unit.encode().decode("latin-1").translate(_LETTERS)
        ids = [t.id for t in self.model.tokenize(letters)]
        if len(self.units) < CACHE_WORDS:
            self.units[unit] = ids
        return ids

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each word, and all ids."""
        units, marks = self.units.get, string.punctuation
        ids: list[list[int]] = []
        other: list[int] = []
        for i, raw in enumerate(words):
            word = raw.decode("utf-8", "replace")
            if word.isascii():
                word = word.lower()
            else:
                word = unicodedata.normalize("NFC", word)
                # each letter by itself: no rule for a final sigma
                word = "".join(map(str.lower, word)) if "\u03a3" in word else word.lower()
            stem = word.rstrip(marks)
            if not stem.isalpha():
                other.append(i)
                ids.append([])
            elif len(stem) == len(word):
                ids.append(units(stem) or self._unit(stem))
            else:
                tail = word[len(stem) :]
                ids.append((units(stem) or self._unit(stem)) + (units(tail) or self._unit(tail)))
        if other:
            found = self.base.encode_batch_fast([words[i].decode("utf-8", "replace") for i in other], add_special_tokens=False)
            for i, e in zip(other, found, strict=True):
                ids[i] = e.ids
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return size, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))

    def ids(self, text: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids, each row's followed by ``end``, and the rows' offsets.

        The first ``CACHE_WORDS`` words stay known (the frequent ones come
        early); the ids of others last for this slice.
        """
        words = Words(text)
        distinct, codes = words.coded()
        distinct = distinct.to_pylist()
        found = list(map(self.known.get, distinct))
        size, first, flat = self.kept
        if missing := [i for i, at in enumerate(found) if at is None]:
            new = [distinct[i] for i in missing]
            more, ids = self._learn(new)
            n = len(size)
            for k, i in enumerate(missing, n):
                found[i] = k
            size = np.concatenate([size, more])
            first = np.concatenate([first, len(flat) + np.cumsum(more) - more])
            flat = np.concatenate([flat, ids])
            if room := max(0, min(len(new), CACHE_WORDS - n)):
                self.known.update(zip(new[:room], range(n, n + room), strict=True))
                used = int(first[n + room - 1] + size[n + room - 1])
                self.kept = size[: n + room].copy(), first[: n + room].copy(), flat[:used].copy()
        at = np.fromiter(found, np.int64, len(found))[codes] if found else np.zeros(0, np.int64)
        n = size[at]
        # word i's ids go behind those of the words before it and the end ids of the rows before its own
        total = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        row_end = total[words.row_start[1:]] + np.arange(1, len(text) + 1)
        out = np.full(int(row_end[-1]) if len(row_end) else 0, end, np.uint32)
        keep = np.ones(len(out), bool)
        keep[row_end - 1] = False
        out[keep] = flat[np.repeat(first[at] - total[:-1], n) + np.arange(int(total[-1]))]
        return out, np.concatenate([[0], row_end])


#: Tokenizers by path; a worker process keeps its words from one task to the next.
_tokenizers: dict[str, Tokenizer] = {}


def pack(lengths: np.ndarray, capacity: int, slack: float = SLACK) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of the given lengths.

    A document longer than ``capacity`` fills sequences of its own with all but
    its last piece. The others share as many sequences as their tokens and at
    most ``slack`` times as many of padding fill. What has no room in any is cut
    to the largest room. Where the slack is less than a sequence's rest, the
    rest is cut into powers of two instead, so that nothing is padded.
    """
    out, rest, sequence = [], [], 0
    for doc, n in enumerate(lengths.tolist()):
        start = 0
        while n - start >= capacity:
            out.append((doc, start, capacity, sequence, 0))
            start += capacity
            sequence += 1
        if n > start:
            rest.append((n - start, doc, start))
    total = sum(r[0] for r in rest)
    if not total:
        return out
    count = int(total * (1 + slack)) // capacity
    room = [capacity] * count
    if count * capacity < total:
        tail = total - count * capacity
        room += [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if tail >> b & 1]
    room_a = np.array(room, np.int64)
    used = np.zeros(len(room), np.int64)
    cost = np.zeros(len(room), np.float64)
    rest.sort(key=lambda r: (-r[0], r[1]))
    for n, doc, start in rest:
        while n:
            free = room_a - used
            open_ = np.flatnonzero(free >= n)
            if len(open_):
                at = int(open_[np.argmin(cost[open_])])
                take = n
            else:
                at = int(np.argmax(free))
                take = int(free[at])
            out.append((doc, start, take, sequence + at, int(used[at])))
            used[at] += take
            cost[at] += LINEAR * take + float(take) * take
            start += take
            n -= take
    return out


def _run(path: str, capacity: int, end: int):
    @bounded
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizers.get(path) or _tokenizers.setdefault(path, Tokenizer(path))
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 40
        docs: list = []
        ids: list[np.ndarray] = []
        held = 0

        def flush():
            nonlocal docs, ids, held, sequence
            flat = np.concatenate(ids)
            lengths = np.concatenate([np.diff(o) for o in (x[1] for x in docs)])
            names = pa.chunked_array([x[0] for x in docs]).combine_chunks()
            first = np.cumsum(lengths) - lengths
            pieces = np.array(pack(lengths, capacity), np.int64)
            doc, start, length, seq, offset = pieces.T
            begin = first[doc] + start
            crc = [zlib.crc32(flat[b : b + n].tobytes()) for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
            columns = [names.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(lengths[doc]), pa.array(seq + sequence), pa.array(offset)]
            sequence += int(seq.max()) + 1
            docs, ids, held = [], [], 0
            return pa.record_batch(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for part, text in slices(batch, limit=4 << 20):
                flat, offsets = tokenizer.ids(text, end)
                docs.append((part.column("doc_id").cast(pa.int64()), offsets))
                ids.append(flat)
                held += len(flat)
                if held >= WINDOW_TOKENS:
                    yield flush()
        if docs:
            yield flush()

    return run


def pack_documents(documents: DataFrame, *, tokenizer: str | None = None, capacity: int = 2048, end: int = 1) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``capacity`` tokens.

    ``documents``: doc_id, text and any other columns (ignored). ``tokenizer``:
    path of a tokenizers file (default: the public word_bpe_49k.json).
    A document's ids are its text's ids (no special tokens), then ``end``.

    Returns one row for each piece: doc_id, start (the document's ids before
    it), length, ids_crc32 (of its ids as little-endian unsigned 32-bit
    numbers), doc_tokens, sequence_id, offset (its place in the sequence).
    Sequences have at most ``capacity`` tokens; padding to it, but for those with
    a power of two, takes at most ``SLACK`` of all. Ids are unique, not dense.

    Null or empty text: one piece of length 1, the end id. Null doc_id and rows
    with the same doc_id: packed as documents of their own. Ties in length go in
    the order of the input; a window is what a task reads together, so a table
    that is split otherwise is packed otherwise. A very long text is a window of
    its own. An empty table gives an empty result.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    texts = texts_of(documents)
    # the pieces are narrow; they are computed here, so that texts are read in small batches
    with small_batches(documents.sparkSession):
        return cut(texts.mapInArrow(_run(tokenizer, capacity, end), SCHEMA))
