"""Bulk encoding with a given tokenizer file.

BPE works on one pre-token at a time, so a text is cut at places that every
pre-tokenisation of the file's kind cuts too, each distinct piece is encoded once by
the tokenizers library, and the ids are put together with array operations.  Two
kinds are known: "byte" (byte-level BPE, a blank belongs to the word after it) and
"word" (white space is dropped).  Special tokens' strings are ordinary text.
"""

from __future__ import annotations

from itertools import chain

import numpy as np

from . import _text as X

#: Distinct pieces kept between chunks in one Python worker, about 40 bytes each.
CACHE_PIECES = 1_000_000
#: Bytes of text that are encoded together.
CHUNK = 1 << 20

_SOLID = np.zeros(256, bool)  # bytes that surely begin a character that isn't white space
_SOLID[0x21:0x7F] = True
_SOLID[0xC3:0xE0] = True
_SOLID[0xE4:0xF5] = True
_ASCII_SOLID = np.zeros(256, bool)
_ASCII_SOLID[0x21:0x7F] = True


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[0x21:0x7F] = True
_MARK[0x30:0x3A] = _MARK[65:91] = _MARK[97:123] = False
#: Bytes that make a letter of U+00C0 to U+00FF behind 0xC3.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
#: Marks behind a word that are looked at.
MARKS = 8


def _marks_apart(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ASCII marks at the end of a piece, behind a Latin letter, become a piece of their own, as in any pre-tokenisation."""
    marked = np.flatnonzero((ends - starts > 1) & _MARK[buf[ends - 1]])
    first = ends[marked] - 1
    more = np.arange(len(marked))
    for _ in range(MARKS):
        more = more[_MARK[buf[first[more] - 1]] & (first[more] - 1 > starts[marked[more]])]
        if not len(more):
            break
        first[more] -= 1
    before = buf[first - 1]
    letter = _LETTER[before] | (_LATIN[before] & (first - 2 >= starts[marked]) & (buf[np.maximum(first - 2, 0)] == 0xC3))
    marked, first = marked[letter], first[letter]
    if not len(marked):
        return starts, ends, rows
    at = marked + np.arange(1, len(marked) + 1)  # places of the marks among all pieces
    n = len(starts) + len(marked)
    word = np.ones(n, bool)
    word[at] = False
    out = np.empty((3, n), np.int64)
    out[:, word] = starts, ends, rows
    out[:, at] = first, ends[marked], rows[marked]
    out[1, at - 1] = first
    return out[0], out[1], out[2]


def word_pieces(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _marks_apart(buf, *X.word_spans(buf, offsets))


def byte_pieces(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts before a blank that precedes a solid byte, and around a line end between solid bytes."""
    n = len(buf)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    cut = np.zeros(n + 1, bool)
    solid_next = np.zeros(n, bool)
    solid_next[:-1] = _SOLID[buf[1:]]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    solid_next &= ~border[1:]  # the next byte is another text's
    cut[:n] = (buf == 0x20) & solid_next
    line = (buf == 0x0A) & solid_next
    line[0] = False
    line[1:] &= _ASCII_SOLID[buf[:-1]] & ~border[1:n]
    cut[:n] |= line
    cut[1:] |= line
    cut[offsets] = True
    starts = np.flatnonzero(cut[:n])
    ends = np.append(starts[1:], n)
    return _marks_apart(buf, starts, ends, X.rows_of(starts, offsets))


def _byte_names() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next free one."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)]


BYTE_NAMES = np.array([ord(c) for c in _byte_names()], "<u4")
PIECES = {"byte": byte_pieces, "word": word_pieces}


class Encoder:
    """encode(buf, offsets) -> (ids uint32 of all rows, bounds): row r has ids[bounds[r]:bounds[r+1]].

    Pieces are known by 64-bit hashes; the ids of known ones are looked up by array operations.
    """

    def __init__(self, path: str, kind: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.pieces, self.byte = PIECES[kind], kind == "byte"
        self._forget()

    def _forget(self) -> None:
        self.keys, self.heads, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _forms(self, missing: list[bytes]) -> tuple[np.ndarray, list[str]]:
        """Which pieces are a word of Latin letters, one pre-token each, and what the library's BPE model takes for them."""
        buf = np.frombuffer(b"".join(missing), np.uint8)
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, missing), np.int64, len(missing)))])
        first = bounds[:-1]
        second = np.zeros(len(buf), bool)  # of the two bytes of a Latin letter
        second[1:] = (buf[:-1] == 0xC3) & _LATIN[buf[1:]]
        fits = _LETTER[buf] | second
        fits[:-1] |= second[1:]
        if self.byte:
            fits[first] |= (buf[first] == 0x20) & (np.diff(bounds) > 1)
        else:
            buf = X.LOWER[buf] + 0x20 * (second & (buf < 0x9F)).view(np.uint8)
        simple = np.logical_and.reduceat(fits, first)
        text = BYTE_NAMES[buf].tobytes().decode("utf-32-le")
        return simple, [text[a:b] for a, b in zip(first[simple].tolist(), bounds[1:][simple].tolist(), strict=True)]

    def _learn(self, keys: np.ndarray, missing: list[bytes]) -> None:
        """Most pieces are a word of Latin letters, which goes to the library's BPE model directly.  Any other piece goes
        through the whole tokenizer."""
        tokenize = self.tokenizer.model.tokenize
        simple, forms = self._forms(missing)
        found = [[t.id for t in tokenize(form)] for form in forms]
        if rest := np.flatnonzero(~simple).tolist():
            found += [one.ids for one in self.tokenizer.encode_batch_fast([missing[k].decode("utf-8", "replace") for k in rest], add_special_tokens=False)]
        placed = np.concatenate([np.flatnonzero(simple), np.array(rest, np.int64)])
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        new = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        sizes, heads = np.empty(len(missing), np.int64), np.empty(len(missing), np.int64)
        sizes[placed], heads[placed] = lengths, self.used + np.cumsum(lengths) - lengths
        if self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * len(new), np.uint32)])
        self.flat[self.used : self.used + len(new)] = new
        self.used += len(new)
        all_keys = np.concatenate([self.keys, keys])
        order = np.argsort(all_keys, kind="stable")
        self.keys, self.heads, self.sizes = all_keys[order], np.concatenate([self.heads, heads])[order], np.concatenate([self.sizes, sizes.astype(np.int32)])[order]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, rows = self.pieces(buf, offsets)
        n_rows = len(offsets) - 1
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n_rows + 1, np.int64)
        keys, first, inverse = np.unique(X.hash_spans(X.prefix_hash(buf), starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_PIECES:
            self._forget()
        at = self._find(keys)
        missing = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(missing):
            data = buf.tobytes()
            self._learn(keys[missing], [data[s:e] for s, e in zip(starts[first[missing]].tolist(), ends[first[missing]].tolist(), strict=True)])
            at = self._find(keys)
        lengths = self.sizes[at][inverse].astype(np.int64)
        stops = np.cumsum(lengths)
        ids = self.flat[np.arange(stops[-1]) + np.repeat(self.heads[at][inverse] - (stops - lengths), lengths)]
        per_row = np.bincount(rows, weights=lengths, minlength=n_rows).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_row)])


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One encoder per worker process and file."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]
