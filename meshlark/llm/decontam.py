"""Benchmark decontamination by CGK embeddings, bit-sampling LSH and exact edit distances.

Texts and items are sequences of words (A-Z lower-cased, punctuation dropped).  Steps:

1. Item-sized windows.  An item of w words has w - q + 1 q-grams and an edit changes q of them at most, so a part of a
   text within e edits keeps w - q + 1 - q e of them, on diagonals (place in the text less place in the item) that
   differ by e at most.  Windows start on the diagonals of texts and items that share so many (one at least).  With e
   a quarter of the words (0 for items under SHORT words) and q of 3, 2 for items of 8 words or fewer and 1 for single
   words, that is never less than 1, so no part within the limit is left without a window.
2. CGK.  A random walk that repeats or leaves each word by a coin of word and step maps edits to few differing places:
   windows and items near in edit distance agree in many places of their walks.
3. LSH.  A repetition samples one place of one of several walks, and a window stays if it agrees with its item in any.
   How many repetitions a length needs is measured on simulated parts at the edit limit (left out, changed or put in
   words, and all of these): agreement falls with length, and no fixed number serves all.
4. The edit distance of the part of the text around a window that is nearest to the item decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._shared import Tables, bounded_batches

MAX_EDIT = 0.25
#: Items of fewer words have to be there word for word: with an edit, common phrases would do.
SHORT = 6
WALKS = 16
#: Simulated parts at the edit limit for the repetitions of a length, and how many times as many repetitions are made
#: as the one of them took that was found last.
TRIALS, SPARE = 96, 4
#: Items sent to all tasks at once; more are searched in blocks of so many.
BLOCK_ITEMS = 20_000
#: Words of items that are verified at once.
BLOCK_CELLS = 400_000

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[48:58] = _WORD_BYTE[65:91] = _WORD_BYTE[97:123] = True
_WORD_BYTE[0x80:] = True


def plain_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and hashes of the words that are compared."""
    lowered = X.LOWER[buf]
    blanked = np.where(_WORD_BYTE[lowered], lowered, np.uint8(32))
    starts, ends, rows = X.word_spans(blanked, offsets)
    return starts, ends, rows, X.hash_spans(X.prefix_hash(lowered), starts, ends)


def nearest_part(item: np.ndarray, size: np.ndarray, text: np.ndarray, length: np.ndarray, anchored: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(distance, end) of the part of each text row that is nearest to the item row, the first end on ties.

    Parts start anywhere, or at 0 if anchored.
    """
    n, w = text.shape
    steps = np.arange(w + 1)
    beyond = steps[None, :] > length[:, None]
    row = np.broadcast_to(steps if anchored else np.zeros(w + 1, np.int64), (n, w + 1)).astype(np.int64).copy()
    distance, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(int(size.max()) if n else 0):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (item[:, i : i + 1] != text))
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        done = np.flatnonzero(size == i + 1)
        if len(done):
            held = np.where(beyond[done], 1 << 40, row[done])
            end[done] = held.argmin(1)
            distance[done] = held[np.arange(len(done)), end[done]]
    return distance, end


def most_edits(size: np.ndarray, max_edit: float) -> np.ndarray:
    return np.where(size < SHORT, 0, (max_edit * size).astype(np.int64))


def gram_width(size: int) -> int:
    return 3 if size > 8 else 2 if size > 1 else 1


def walk(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, steps: int, salt: int) -> np.ndarray:
    """(windows, steps): the CGK walk over words[lo:hi] of each window; 0 beyond its end."""
    at, out = lo.copy(), np.zeros((len(lo), steps), np.uint64)
    last = max(len(words) - 1, 0)
    for j in range(steps):
        word = words[np.minimum(at, last)] if len(words) else np.zeros(len(at), np.uint64)
        inside = at < hi
        out[:, j] = np.where(inside, word, np.uint64(0))
        coin = X.mix64(word + np.uint64((salt * 1_000_003 + j) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(63)
        at += np.where(inside, coin.astype(np.int64), 0)
    return out


def length_class(size: int) -> int:
    """The longest length that is sampled as this one is: lengths in steps of a quarter."""
    top = SHORT
    while top < size:
        top = max(top + 1, top * 5 // 4)
    return top


@lru_cache(maxsize=None)
def samples(size: int, max_edit: float) -> tuple[np.ndarray, np.ndarray]:
    """(walks, places) of the repetitions for a length class, from parts of simulated texts at the edit limit."""
    rng = np.random.default_rng(size)
    n, steps = int(most_edits(np.array([size]), max_edit)[0]), 2 * size
    fresh = lambda k: X.mix64(rng.integers(1, 2**62, k).astype(np.uint64))
    items, texts = [], []
    for trial in range(TRIALS):
        item = fresh(size)
        kinds = rng.integers(0, 3, n) if trial % 4 == 3 else np.full(n, trial % 4)  # left out, changed, put in, or each
        part = [[w] for w in item]
        for at, kind in zip(rng.choice(size, n, replace=False), kinds, strict=True):
            part[at] = [[], [fresh(1)[0]], [item[at], fresh(1)[0]]][kind]
        items.append(item)
        texts.append(np.concatenate([fresh(size), np.array([w for x in part for w in x], np.uint64), fresh(2 * size)]))
    words, ends = np.concatenate(texts), np.cumsum([len(t) for t in texts])
    rows = np.repeat(np.arange(TRIALS), np.diff(ends, prepend=0))
    found = Items(list(range(TRIALS)), items, max_edit, sampled=False).diagonals(words, rows, max_edit)
    row, _, start = found[found[:, 0] == found[:, 1]].T
    lo = np.maximum(start, ends[row] - np.diff(ends, prepend=0)[row])
    hi, heads = np.minimum(lo + size + n, ends[row]), np.arange(TRIALS) * size
    order = rng.permutation(WALKS * steps)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    first = np.full(TRIALS, len(order))  # the repetition that finds the part
    for k in range(WALKS):
        own = walk(np.concatenate(items), heads, heads + size, steps, k)[row]
        agree = (walk(words, lo, hi, steps, k) == own) & (own != 0)
        np.minimum.at(first, row, np.where(agree, rank[k * steps : (k + 1) * steps], len(order)).min(1))
    reps = min(SPARE * (int(first.max()) + 1), len(order))
    return order[:reps] // steps, order[:reps] % steps


class Items:
    """The lookup tables of a block of items (word hashes each)."""

    def __init__(self, ids: list[int], words: list[np.ndarray], max_edit: float = MAX_EDIT, sampled: bool = True):
        held = [k for k, w in enumerate(words) if len(w)]
        self.ids = np.array([ids[k] for k in held], np.int64)
        self.size = np.array([len(words[k]) for k in held], np.int64)
        self.width = int(self.size.max()) if held else 0
        self.words = np.zeros((len(held), self.width), np.uint64)
        for row, k in enumerate(held):
            self.words[row, : len(words[k])] = words[k]
        self.grams: dict[int, tuple[np.ndarray, ...]] = {}
        for q in (1, 2, 3):
            grams, owners, places = [], [], []
            for row in np.flatnonzero([gram_width(n) == q for n in self.size.tolist()]).tolist():
                g = X.window_hash(self.words[row, : self.size[row]], q)
                grams.append(g)
                owners.append(np.full(len(g), row))
                places.append(np.arange(len(g)))
            if grams:
                gram, owner, place = (np.concatenate(x) for x in (grams, owners, places))
                order = np.argsort(gram, kind="stable")
                maybe = np.zeros(1 << 20, bool)
                maybe[(gram >> np.uint64(44)).astype(np.int64)] = True
                self.grams[q] = gram[order], owner[order], place[order], maybe
        #: class -> (walks, places, words of each item of the class at those places)
        self.probes: dict[int, tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]] = {}
        for row, n in enumerate(self.size.tolist() if sampled else ()):
            if n >= SHORT:
                c = length_class(n)
                if c not in self.probes:
                    self.probes[c] = (*samples(c, max_edit), {})
                walks, places, of = self.probes[c]
                own = np.stack([walk(self.words[row, :n], np.zeros(1, np.int64), np.array([n]), 2 * c, k)[0] for k in range(WALKS)])
                of[row] = own[walks, places]

    @staticmethod
    def of_texts(ids: list[int], texts: list[str], max_edit: float = MAX_EDIT) -> Items:
        words: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
        for i, j, buf, offsets in X.text_chunks(pa.array(texts, pa.string())):
            _, _, rows, found = plain_words(buf, offsets)
            cuts = np.searchsorted(rows, np.arange(j - i + 1))
            for r in range(j - i):
                words[i + r] = found[cuts[r] : cuts[r + 1]]
        return Items(ids, words, max_edit)

    def diagonals(self, words: np.ndarray, rows: np.ndarray, max_edit: float) -> np.ndarray:
        """Distinct (row, item, diagonal) of the grams of texts and items that share enough on near diagonals."""
        out = [np.zeros((0, 3), np.int64)]
        for q, (gram, owner, place, maybe) in self.grams.items():
            grams = X.window_hash(words, q)
            if not len(grams):
                continue
            near = np.flatnonzero(maybe[(grams >> np.uint64(44)).astype(np.int64)] & (rows[: len(grams)] == rows[q - 1 :]))
            lo, hi = np.searchsorted(gram, grams[near], "left"), np.searchsorted(gram, grams[near], "right")
            count = hi - lo
            at, row = np.repeat(near, count), np.repeat(rows[near], count)
            which = np.arange(count.sum()) + np.repeat(lo - (np.cumsum(count) - count), count)
            item = owner[which]
            diagonal = at - place[which]
            order = np.lexsort((diagonal, item, row))
            row, item, diagonal = row[order], item[order], diagonal[order]
            size = self.size[item]
            most = most_edits(size, max_edit)
            least = np.maximum(size - (q - 1) - q * most, 1)
            last = np.arange(len(row)) + least - 1
            held = np.minimum(last, max(len(row) - 1, 0))
            enough = (last < len(row)) & (row[held] == row) & (item[held] == item) & (diagonal[held] - diagonal <= most)
            # all that lie in a window of places which begins at one that has enough
            inside = np.zeros(len(row) + 1, np.int64)
            np.add.at(inside, np.flatnonzero(enough), 1)
            np.add.at(inside, last[enough] + 1, -1)
            kept = np.cumsum(inside[:-1]) > 0
            out.append(np.unique(np.stack([row[kept], item[kept], diagonal[kept]], 1), axis=0))
        return np.concatenate(out)

    def alike(self, words: np.ndarray, bounds: np.ndarray, spans: np.ndarray, max_edit: float) -> np.ndarray:
        """Which windows agree with their item in a sampled place of a walk; windows of short items all do."""
        row, item, start = spans.T
        keep = self.size[item] < SHORT
        classes = np.array([length_class(n) for n in self.size.tolist()], np.int64)[item] if len(item) else item
        for c, (walks, places, of) in self.probes.items():
            at = np.flatnonzero((classes == c) & ~keep)
            for k in range(0, len(at), 4096):
                part = at[k : k + 4096]
                lo = np.maximum(start[part], bounds[row[part]])
                hi = np.minimum(start[part] + self.size[item[part]] + most_edits(self.size[item[part]], max_edit), bounds[row[part] + 1])
                own = np.stack([of[i] for i in item[part].tolist()])
                hit = np.zeros(len(part), bool)
                for w in range(WALKS):
                    used = walks == w
                    if used.any():
                        seen = walk(words, lo, hi, int(places[used].max()) + 1, w)[:, places[used]]
                        hit |= ((seen == own[:, used]) & (seen != 0)).any(1)
                keep[part] = hit
        return keep

    def windows(self, words: np.ndarray, rows: np.ndarray, bounds: np.ndarray, max_edit: float) -> np.ndarray:
        """Distinct (row, item, first word, words) of the windows to verify.

        Diagonals are rounded down to multiples of the item's edits and windows are longer by as much.
        """
        spans = self.diagonals(words, rows, max_edit)
        row, item, diagonal = spans[self.alike(words, bounds, spans, max_edit)].T
        step = np.maximum(most_edits(self.size[item], max_edit), 1)
        return np.unique(np.stack([row, item, diagonal // step * step, self.size[item] + step], 1), axis=0)

    def _nearest(self, words: np.ndarray, row: np.ndarray, start: np.ndarray, length: np.ndarray, item: np.ndarray, bounds: np.ndarray, max_edit: float) -> np.ndarray:
        """Exact verification: the part of the window and its surroundings that is nearest to the item, if near enough."""
        most = most_edits(self.size[item], max_edit)
        lo, hi = np.maximum(start - most, bounds[row]), np.minimum(start + length + most, bounds[row + 1])
        cols = np.arange(int((hi - lo).max()) if len(lo) else 0)

        def part(a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
            at = np.where(back, (b - 1)[:, None] - cols, a[:, None] + cols)
            inside = cols < (b - a)[:, None]
            return np.where(inside, words[np.clip(at, 0, len(words) - 1)], np.uint64(0))

        distance, end = nearest_part(self.words[item], self.size[item], part(lo, hi, False), hi - lo)
        end = lo + end
        turned = np.where(np.arange(self.width) < self.size[item][:, None], self.words[item[:, None], np.maximum(self.size[item][:, None] - 1 - np.arange(self.width), 0)], np.uint64(0))
        _, back = nearest_part(turned, self.size[item], part(lo, end, True), end - lo, anchored=True)
        ok = (distance <= most) & (back > 0)
        return np.stack([row, item, distance, end - back, back], 1)[ok]

    def match(self, words: np.ndarray, rows: np.ndarray, n_rows: int, max_edit: float) -> np.ndarray:
        """(row, item, distance, first word, words) of the best window per row and item within max_edit."""
        bounds = np.searchsorted(rows, np.arange(n_rows + 1))
        spans = self.windows(words, rows, bounds, max_edit)
        out = []
        block = max(1, BLOCK_CELLS // max(self.width, 1))
        for k in range(0, len(spans), block):
            row, item, start, length = spans[k : k + block].T
            out.append(self._nearest(words, row, start, length, item, bounds, max_edit))
        found = np.concatenate(out) if out else np.zeros((0, 5), np.int64)
        found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
        first = np.ones(len(found), bool)
        first[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
        return found[first]


def _find(items: Items, max_edit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts_of, ends_of, rows_of, words_of = [], [], [], []
            for i, _, buf, offsets in X.text_chunks(batch.column("_text")):
                starts, ends, rows, words = plain_words(buf, offsets)
                starts_of.append((starts - offsets[rows]).astype(np.int32))
                ends_of.append((ends - offsets[rows]).astype(np.int32))
                rows_of.append(rows + i)
                words_of.append(words)
            if not rows_of:
                continue
            starts, ends, rows, words = (np.concatenate(x) for x in (starts_of, ends_of, rows_of, words_of))
            if not len(words):
                continue
            found = items.match(words, rows, batch.num_rows, max_edit)
            row, item, distance, first, length = found.T
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(pa.array(row)), pa.array(items.ids[item]), pa.array(distance), pa.array(items.size[item]), pa.array(starts[first].astype(np.int64)), pa.array(ends[first + length - 1].astype(np.int64))],
                ["_id", "item_id", "distance", "n_words", "start", "end"],
            )

    return run


def find_passages(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, distance long, n_words long, start long, end long): documents with a window within max_edit
    of an item's words, a row per document and item, with the nearest window's bytes.

    Items of fewer than SHORT words count word for word only; null texts and items without words have no matches; rows
    that repeat are reported each, null ids as null.  Items go to the tasks in blocks of BLOCK_ITEMS, a scan of the
    documents each, so their number is not bounded; no items give no rows.
    """
    bounded_batches(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, item_id long, distance long, n_words long, start long, end long"
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    listed = benchmark.where("text is not null").select("item_id", "text")
    blocks = max(1, math.ceil(listed.count() / BLOCK_ITEMS))
    out = None
    for k in range(blocks):
        block = listed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id").collect()
        items = Items.of_texts([r.item_id for r in block], [r.text for r in block], max_edit)
        found = rows.mapInArrow(_find(items, max_edit), schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("_id", id_col)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT) -> DataFrame:
    """docs without the documents that hold a passage of the benchmark; columns stay.

    The search writes the ids of those documents, and an anti-join by doc_id leaves them out: rows of one id go
    together, and rows with a null id stay.
    """
    found = Tables(docs.sparkSession).save(find_passages(docs, benchmark, max_edit).select("doc_id").distinct())
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
