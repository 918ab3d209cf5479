"""Token-id files: an adaptive context-mixing range coder over blocks that are coded side by side.

Model.  For each id, order-2 and order-1 contexts each name the id that last followed
them and how often in a row they were right.  Those trusts choose counters whose mix with
the totals gives the odds of "order 2 right", "order 1 right" and "neither"; in the last
case the id is drawn from the file's order-0 table.  The nested choices narrow one range.
Contexts are a block's own and learn from every id; the counters are those of all blocks
side by side and follow at the end of short periods.

Speed.  Blocks move one id ahead together, by array operations.  The range has 48 bits, so
all its arithmetic is exact in 64-bit floats.  What the contexts of a block name depends on
its ids alone, so the encoder finds it for all ids at once, by sorting them by context.

File.  magic | block_tokens u32, table_bits u32, n_docs u64, n_tokens u64, n_blocks u32,
index_bytes u32, index_crc u32, table_bytes u32, table_crc u32 | index: zlib of doc ids i64, lengths i64 and
bits of null ids | order-0 table: zlib of ids u32 and shares u32 | per block: words u32, crc32 u32 | words u16.
All little-endian.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as X
from ._shared import Tables, bounded_batches, filesystem, partitions
from .tokens import CHUNK, encoder

MAGIC = b"MLKTOK2\n"
HEAD = struct.Struct("<IIQQIIIII")
BLOCK_TOKENS = 2048
#: Blocks that are coded side by side.
LANES = 4096
FILE_TOKENS = BLOCK_TOKENS * LANES
SLOTS = 1024
#: Parts whose files are numbered together.
NUMBERED = 1024
#: Trust in either guess (0 to 3) and whether they agree.
CONTEXTS = 32
#: Steps between two makings of the mixed odds.
PERIOD = 64
UNIT = 1 << 10
#: Blocks whose guesses the encoder finds together.
GUESSED = 64
U32 = np.uint32
_SLOT_SHIFT = U32(32 - 10)
#: A guess is trust << 20 | id, and ids are below 1 << 17: shifts of it give its trust times 8 or 2.
_ID, _ONE, _TOP, _TIMES_8, _TIMES_2 = U32((1 << 20) - 1), U32(1 << 20), U32(3 << 20), U32(17), U32(19)
_FIRST, _SECOND = U32(0x9E3779B1), U32(0x85EBCA6B)
#: The range lies between these after each id; a word has 16 bits.
_LEAST, _WHOLE, _WORD = float(1 << 32), float(1 << 48), float(1 << 16)


class _Odds:
    """Shares of UNIT for each context and outcome, from its own counts and, with less weight, those of all."""

    def __init__(self):
        self.counts = np.ones((CONTEXTS, 3), np.int64)
        self._mix()

    def _mix(self) -> None:
        weight = self.counts * 4 + self.counts.sum(0) // 16 + 1
        total = weight.sum(1)
        f2 = 1 + weight[:, 0] * (UNIT - 3) // total
        f1 = 1 + weight[:, 1] * (UNIT - 3) // total
        share = np.stack([f2, f1, UNIT - f2 - f1], 1)
        self.share, self.start = share.reshape(-1).astype(float), (np.cumsum(share, 1) - share).reshape(-1).astype(float)

    def learn(self, choices: np.ndarray) -> None:
        """choices: context * 3 + outcome of a period."""
        self.counts = (self.counts >> 1) + np.bincount(choices.reshape(-1), minlength=CONTEXTS * 3).reshape(CONTEXTS, 3)
        self._mix()


def _periods(steps: int) -> list[tuple[int, int]]:
    ends = [e for e in (8, 16, 32) if e < steps] + [*range(PERIOD, steps, PERIOD), steps]
    return list(zip([0, *ends[:-1]], ends, strict=True))


class Table:
    """Order-0 shares of 1 << bits for the ids that occur; the last number stands for an id that a context named."""

    def __init__(self, ids: np.ndarray, share: np.ndarray, bits: int):
        self.ids, self.share, self.bits = ids.astype(U32), share, bits
        self.starts = np.append(np.cumsum(share) - share, 0).astype(float)
        self.shares = np.append(share, 1 << bits).astype(float)

    @staticmethod
    def of(tokens: np.ndarray) -> Table:
        top = int(tokens.max(initial=0)) + 1
        seen = sum((np.bincount(tokens[k : k + (1 << 20)], minlength=top) for k in range(0, len(tokens), 1 << 20)), np.zeros(top, np.int64))
        ids = np.flatnonzero(seen)
        bits = max(16, len(ids).bit_length() + 2)
        share = 1 + seen[ids] * ((1 << bits) - len(ids)) // max(len(tokens), 1)
        if len(ids):
            share[seen[ids].argmax()] += (1 << bits) - share.sum()
        return Table(ids, share, bits)

    def pack(self) -> bytes:
        return zlib.compress(self.ids.astype("<u4").tobytes() + self.share.astype("<u4").tobytes(), 6)

    @staticmethod
    def unpack(data: bytes, bits: int) -> Table:
        both = np.frombuffer(zlib.decompress(data), "<u4").reshape(2, -1)
        return Table(both[0], both[1].astype(np.int64), bits)


def _named(slots: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """trust << 20 | id that a context (by its slot) names at each place of each row, as the decoder will have it."""
    rows, steps = ids.shape
    order = np.argsort(slots, 1, kind="stable")
    order += (np.arange(rows) * steps)[:, None]
    order = order.reshape(-1)
    slot, after = slots.reshape(-1)[order], ids.reshape(-1)[order]
    same = np.zeros(len(slot), bool)
    np.equal(slot[1:], slot[:-1], out=same[1:])
    same[::steps] = False
    guess = np.zeros(len(slot), U32)
    np.multiply(after[:-1], same[1:], out=guess[1:])
    right = guess == after
    one = same.copy()
    one[1:] &= right[:-1]
    two, three = one.copy(), one.copy()
    two[1:] &= one[:-1]
    three[1:] &= two[:-1]
    trust = one.view(np.uint8) + two.view(np.uint8) + three.view(np.uint8)
    guess |= trust.astype(U32) << U32(20)
    out = np.empty(len(slot), U32)
    out[order] = guess
    return out.reshape(rows, steps)


def _choices(tokens: np.ndarray, names: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """By step and block: context * 3 + outcome, and the number of the id in the order-0 table (none: not drawn)."""
    n, steps = tokens.shape
    choice, number = np.empty((steps, n), np.uint8), np.empty((steps, n), names.dtype)
    for k in range(0, n, GUESSED):
        ids = tokens[k : k + GUESSED]
        before = np.zeros((2, *ids.shape), U32)
        before[0, :, 1:], before[1, :, 2:] = ids[:, :-1], ids[:, :-2]
        mixed = before[0] * _FIRST
        a = _named(((mixed ^ (before[1] * _SECOND)) >> _SLOT_SHIFT).astype(np.uint16), ids)
        b = _named((mixed >> _SLOT_SHIFT).astype(np.uint16), ids)
        g2, g1 = a & _ID, b & _ID
        context = ((a >> _TIMES_8) + (b >> _TIMES_2)).astype(np.uint8) + (g2 == g1)
        right2, right1 = g2 == ids, g1 == ids
        either = right2 | right1
        choice[:, k : k + GUESSED] = (context * np.uint8(3) + np.uint8(2) - right2 - either).T
        number[:, k : k + GUESSED] = np.where(either, names.dtype.type(none), names[ids]).T
    return choice, number


def encode_blocks(tokens: np.ndarray, table: Table) -> list[bytes]:
    """tokens (n_blocks, block_tokens) uint32 -> the words of each block."""
    n, steps = tokens.shape
    none = len(table.ids)
    names = np.zeros(int(table.ids[-1]) + 1, np.uint16 if none < 1 << 16 else U32)
    names[table.ids] = np.arange(none)
    choice, number = _choices(tokens, names, none)
    odds, unit_of, drawn = _Odds(), 1.0 / (UNIT << table.bits), float(1 << table.bits)
    low, span, unit, step = np.zeros(n), np.full(n, _WHOLE), np.empty(n), np.empty(n)
    width = 2 * steps + 8
    out, filled = np.zeros(n * width, U32), np.arange(n) * width
    for a, b in _periods(steps):
        chosen, drawn_as = choice[a:b], number[a:b]
        scale = odds.share[chosen]
        size = scale * table.shares[drawn_as]
        start = odds.start[chosen] * drawn + scale * table.starts[drawn_as]
        for t in range(b - a):
            np.floor(np.multiply(span, unit_of, out=unit), out=unit)
            low += np.multiply(start[t], unit, out=step)
            np.multiply(size[t], unit, out=span)
            short = np.flatnonzero(span < _LEAST)
            while len(short):
                l, s, at = low[short], span[short] * _WORD, filled[short]
                word = np.floor(l * (1 / _LEAST))
                out[at] = word  # with the carry into the word before, if any
                filled[short] = at + 1
                low[short], span[short] = (l - word * _LEAST) * _WORD, s
                short = short[s < _LEAST]
        odds.learn(chosen)
    for _ in range(3):
        word = np.floor(low * (1 / _LEAST))
        out[filled] = word
        filled += 1
        low = (low - word * _LEAST) * _WORD
    sizes = filled - np.arange(n) * width
    words = out.reshape(n, width)[:, : sizes.max()]
    while (carry := words >> U32(16)).any():
        words &= U32(0xFFFF)
        words[:, :-1] += carry[:, 1:]
    return [w[:k].astype("<u2").tobytes() for w, k in zip(words, sizes.tolist(), strict=True)]


def decode_blocks(blocks: list[bytes], steps: int, table: Table) -> np.ndarray:
    """The inverse of encode_blocks: (n_blocks, steps) uint32."""
    n, none = len(blocks), len(table.ids)
    width = max(len(b) for b in blocks) // 2 + 3
    words = np.zeros((n, width), "<u2")
    for k, b in enumerate(blocks):
        words[k, : len(b) // 2] = np.frombuffer(b, "<u2")
    flat, at = words.reshape(-1), np.arange(n) * width
    number_of = np.repeat(np.arange(none, dtype=np.uint16 if none < 1 << 16 else U32), table.share)
    ids_of = np.append(table.ids, U32(0))
    odds, unit_of, drawn = _Odds(), 1.0 / (UNIT << table.bits), float(1 << table.bits)
    code, span, unit = np.zeros(n), np.full(n, _WHOLE), np.empty(n)
    for _ in range(3):
        code = code * _WORD + flat[at]
        at += 1
    base = (np.arange(n) * SLOTS).astype(U32)
    seen2, seen1 = np.zeros(n * SLOTS, U32), np.zeros(n * SLOTS, U32)
    slot2 = slot1 = base.astype(np.int64)
    prev, out = np.zeros(n, U32), np.empty((steps, n), U32)
    for first, end in _periods(steps):
        log = np.empty((end - first, n), np.int64)
        in_first, in_both = odds.start[1::3] * drawn, odds.start[2::3] * drawn
        starts = odds.start * drawn
        for t in range(first, end):
            a, b = seen2.take(slot2), seen1.take(slot1)
            g2, g1 = a & _ID, b & _ID
            context = ((a >> _TIMES_8) + (b >> _TIMES_2) + (g2 == g1)).astype(np.int64)
            np.floor(np.multiply(span, unit_of, out=unit), out=unit)
            value = np.floor(code / unit)
            right2, either = value < in_first.take(context), value < in_both.take(context)
            choice = log[t - first]
            np.multiply(context, 3, out=choice)
            choice += 2
            choice -= right2
            choice -= either
            begin, scale = starts.take(choice), odds.share.take(choice)
            value -= begin
            value /= scale
            number = number_of.take(value.astype(np.int64), mode="clip")
            number[either] = none
            ids = ids_of.take(number)
            np.copyto(ids, g1, where=either)
            np.copyto(ids, g2, where=right2)
            begin += scale * table.starts.take(number)
            begin *= unit
            code -= begin
            scale *= table.shares.take(number)
            np.multiply(scale, unit, out=span)
            short = np.flatnonzero(span < _LEAST)
            while len(short):
                s, place = span[short] * _WORD, at[short]
                code[short] = code[short] * _WORD + flat.take(place)
                span[short], at[short] = s, place + 1
                short = short[s < _LEAST]
            out[t] = ids
            top = ids | _TOP
            seen2[slot2] = np.where(g2 == ids, np.minimum(a + _ONE, top), ids)
            seen1[slot1] = np.where(g1 == ids, np.minimum(b + _ONE, top), ids)
            mixed = ids * _FIRST
            slot2, slot1 = (((mixed ^ prev) >> _SLOT_SHIFT) + base).astype(np.int64), ((mixed >> _SLOT_SHIFT) + base).astype(np.int64)
            prev = ids * _SECOND
        odds.learn(log)
    return np.ascontiguousarray(out.T)


def _groups(n_blocks: int) -> list[tuple[int, int]]:
    """Blocks that are coded side by side: as few groups as LANES allows, of one size."""
    groups = -(-n_blocks // LANES)
    return [(n_blocks * k // groups, n_blocks * (k + 1) // groups) for k in range(groups)]


def to_bytes(doc_ids: np.ndarray, lengths: np.ndarray, tokens: np.ndarray, vocabulary: int, null: np.ndarray | None = None) -> bytes:
    """One file.  vocabulary: ids are below it; 131,072 at most.  null: where doc ids are null."""
    if vocabulary > 1 << 17 or (len(tokens) and int(tokens.max()) >= vocabulary):
        raise ValueError("ids must be below the vocabulary, and that at most 131,072")
    n_blocks = -(-len(tokens) // BLOCK_TOKENS)
    padded = np.zeros(n_blocks * BLOCK_TOKENS, U32)
    padded[: len(tokens)] = tokens
    grid, blocks = padded.reshape(n_blocks, BLOCK_TOKENS), []
    if n_blocks == 1:
        grid = grid[:, : len(tokens)]
    table = Table.of(grid.reshape(-1))
    for a, b in _groups(n_blocks):
        blocks += encode_blocks(grid[a:b], table)
    bits = np.packbits(np.zeros(len(doc_ids), bool) if null is None else null)
    index = zlib.compress(doc_ids.astype("<i8").tobytes() + lengths.astype("<i8").tobytes() + bits.tobytes(), 6)
    shares = table.pack()
    head = HEAD.pack(BLOCK_TOKENS, table.bits, len(doc_ids), len(tokens), n_blocks, len(index), zlib.crc32(index), len(shares), zlib.crc32(shares))
    sizes = b"".join(struct.pack("<II", len(b) >> 1, zlib.crc32(b)) for b in blocks)
    return MAGIC + head + index + shares + sizes + b"".join(blocks)


def from_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, lengths, ids of all documents); raises ValueError on a wrong checksum or magic."""
    return parse(data)[:3]


def parse(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same, and where doc ids are null."""
    if data[:8] != MAGIC:
        raise ValueError("not a token-id file")
    block_tokens, bits, n_docs, n_tokens, n_blocks, n_index, crc, n_shares, shares_crc = HEAD.unpack_from(data, 8)
    at = 8 + HEAD.size
    index = data[at : at + n_index]
    if zlib.crc32(index) != crc:
        raise ValueError("the document index is damaged")
    raw = zlib.decompress(index)
    both, null = np.frombuffer(raw[: 16 * n_docs], "<i8"), np.unpackbits(np.frombuffer(raw[16 * n_docs :], np.uint8), count=n_docs).astype(bool)
    at += n_index
    shares = data[at : at + n_shares]
    if zlib.crc32(shares) != shares_crc:
        raise ValueError("the order-0 table is damaged")
    at += n_shares
    sizes = [struct.unpack_from("<II", data, at + 8 * k) for k in range(n_blocks)]
    at += 8 * n_blocks
    blocks = []
    for k, (words, crc) in enumerate(sizes):
        b = data[at : at + 2 * words]
        if len(b) != 2 * words or zlib.crc32(b) != crc:
            raise ValueError(f"block {k} is damaged")
        blocks.append(b)
        at += 2 * words
    steps = n_tokens if n_blocks == 1 else block_tokens
    table = Table.unpack(shares, bits)
    parts = [decode_blocks(blocks[a:b], steps, table).reshape(-1) for a, b in _groups(n_blocks)]
    tokens = np.concatenate(parts)[:n_tokens] if parts else np.zeros(0, U32)
    return both[:n_docs], both[n_docs:], tokens, null


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, kind: str, end_id: int, vocabulary: int, tables: Tables) -> DataFrame:
    """Writes files in ascending doc_id order; returns (part int, file int, path, n_docs, n_tokens), one row each.

    Null ids come first and stay null; rows of one id are in the order of their texts.  Null or empty text is end_id
    alone.  Extra columns are left out; no rows make no files.  A file holds FILE_TOKENS ids at most and a few texts more; its name is
    unique to the attempt that wrote it, so a task that runs twice leaves a stray file and no wrong one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer, kind), TaskContext.get().partitionId()
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        ids: list[np.ndarray] = []
        nulls: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        tokens: list[np.ndarray] = []
        n = made = 0

        def flush() -> pa.RecordBatch:
            nonlocal n, made
            name = f"part-{part:06d}-{made:04d}-{uuid.uuid4().hex[:12]}.mlk"
            doc_ids, sizes, flat = np.concatenate(ids), np.concatenate(lengths), np.concatenate(tokens)
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(to_bytes(doc_ids, sizes, flat, vocabulary, np.concatenate(nulls)))
            row = [part], [made], [f"{folder}/{name}"], [len(doc_ids)], [len(flat)]
            for x in (ids, nulls, lengths, tokens):
                x.clear()
            n, made = 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "file", "path", "n_docs", "n_tokens"])

        for batch in batches:
            for i, j, buf, offsets in X.text_chunks(batch.column("text"), CHUNK):
                found, bounds = enc.encode(buf, offsets)
                sizes = np.diff(bounds)
                ended = np.insert(found, bounds[1:], U32(end_id))
                names = batch.column("doc_id")[i:j]
                nulls.append(names.is_null().to_numpy(zero_copy_only=False))
                ids.append(names.fill_null(0).to_numpy(zero_copy_only=False))
                lengths.append(sizes + 1)
                tokens.append(ended)
                n += len(ended)
                if n >= FILE_TOKENS:
                    yield flush()
        if ids:
            yield flush()

    ranged = docs.select("doc_id", "text").repartitionByRange(partitions(bounded_batches(docs)), "doc_id").sortWithinPartitions("doc_id", "text")
    return tables.save(ranged.mapInArrow(run, "part int, file int, path string, n_docs long, n_tokens long"))


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids binary) of every document in the files, which are read in order.

    The driver gets a number for every NUMBERED parts, to know the first id of each; the rest is summed by window.
    """
    spark = files.sparkSession
    group = F.floor(F.col("part") / NUMBERED).alias("group")
    sums = sorted(tuple(r) for r in files.groupBy(group).agg(F.sum("n_tokens"), F.count("*")).collect())
    starts, start = [], 0
    for k, n, _ in sums:
        starts.append((k, start))
        start += n
    before = Window.partitionBy("group").orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    base = F.broadcast(spark.createDataFrame(starts, "group long, base long"))
    listed = files.withColumn("group", group).join(base, "group").select("path", (F.col("base") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    doc_ids, lengths, tokens, null = parse(f.read())
                stops = np.cumsum(lengths)
                data = tokens.astype("<u4").tobytes()
                for k in range(0, len(doc_ids), 2048):
                    part = slice(k, k + 2048)
                    blobs = [data[4 * a : 4 * b] for a, b in zip((stops - lengths)[part].tolist(), stops[part].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[part], pa.int64(), mask=null[part]), pa.array((stops - lengths)[part] + first, pa.int64()), pa.array(lengths[part], pa.int64()), pa.array([zlib.crc32(b) for b in blobs], pa.int64()), pa.array(blobs, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    frame = listed.repartition(max(1, sum(r[2] for r in sums)))
    return frame.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
