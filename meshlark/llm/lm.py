"""Bigram language model with deleted interpolation, trained and applied in one exchange of counts.

    P(w|v) = a(b) c(v,w)/c(v) + (1-a(b)) P(w),   P(w) = u c(w)/N + (1-u)/(V+1)

b is the frequency bucket of the context v (log2 of its count).  The weights come from
expectation-maximisation on held-out counts: a chunk of texts is held against the corpus
counts without its own.

Exchange.  A chunk asks for its distinct n-grams once, whatever their number in it; the
keys go to buckets by hash together with the chunk's training counts, a bucket adds the
counts of all chunks and answers each.  A frequent word is one key per chunk, so no key
is hot.  A chunk is known by a hash of its rows, so answers meet the texts of the same
chunk in a second pass; if passes differ, that is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._shared import Tables, bounded_batches, partitions

CHUNK = 2 << 20
SHARD_BYTES = 64 << 20  # of text, whose n-grams a shard holds
BUCKETS = 48  # of context frequency
COUNTS = 512  # bins of counts
RATIOS = 512  # bins of log10(bigram estimate / lower estimate), over LOW..-LOW
LOW = -9.0
_END = np.uint64(0x6A09E667F3BCC909)
_START = np.uint64(0xBB67AE8584CAA73B)


class _Chunk:
    """Tokens of whole texts: distinct words and word pairs with the place of each token among them."""

    def __init__(self, batch: pa.RecordBatch, i: int, j: int, buf: np.ndarray, offsets: np.ndarray):
        n = j - i
        starts, ends, rows = X.word_spans(buf, offsets)
        words = X.hash_spans(X.prefix_hash(X.LOWER[buf]), starts, ends)
        counts = np.bincount(rows, minlength=n)
        self.tokens = counts + 1
        stops = np.cumsum(self.tokens)
        seq = np.empty(stops[-1], np.uint64)
        last = np.zeros(len(seq), bool)
        last[stops - 1] = True
        seq[last], seq[~last] = _END, words
        before = np.empty_like(seq)
        before[1:] = seq[:-1]
        before[stops - self.tokens] = _START
        self.rows = np.repeat(np.arange(n), self.tokens)
        self.word, self.word_at = np.unique(seq, return_inverse=True)
        pairs = X.mix64(before * np.uint64(0x9E3779B97F4A7C15) + seq)
        self.pair, first, self.pair_at = np.unique(pairs, return_index=True, return_inverse=True)
        self.pair_word = self.word_at[first]
        context = before[first]
        self.pair_context = np.minimum(np.searchsorted(self.word, context), len(self.word) - 1)
        self.pair_context[context == _START] = -1
        self.ids = batch.column("_id").slice(i, n)
        self.train = batch.column("train").slice(i, n).to_numpy(zero_copy_only=False)
        trained = self.train[self.rows]
        self.word_count = np.bincount(self.word_at[trained], minlength=len(self.word))
        self.pair_count = np.bincount(self.pair_at[trained], minlength=len(self.pair))


def _chunk_key(batch: pa.RecordBatch, i: int, j: int) -> int:
    """A hash of the chunk's rows in their order."""
    keys = batch.column("key").slice(i, j - i).to_numpy(zero_copy_only=False).view(np.uint64)
    hashed = X.mix64(keys + np.arange(j - i, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return int(hashed.sum(dtype=np.uint64).view(np.int64))


def _cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Bounds of each shard among ascending keys; a shard is a range of the top bits."""
    edges = (np.arange(1, shards, dtype=object) * (1 << 64)) // shards
    return np.concatenate([[0], np.searchsorted(keys, np.array([int(e) for e in edges], np.uint64)), [len(keys)]])


#: Bytes of a key that are sent; the shard adds the bits of its number. Seven and eight shards or more leave 59 bits.
_KEY_BYTES = {1: 8, 2: 7}


def _ask(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in X.text_chunks(batch.column("text"), CHUNK):
                c, key, rows = _Chunk(batch, i, j, buf, offsets), _chunk_key(batch, i, j), []
                for kind, keys, counts in ((1, c.word, c.word_count), (2, c.pair, c.pair_count)):
                    cuts = _cuts(keys, shards)
                    short = np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, : _KEY_BYTES[kind]])
                    small = np.minimum(counts, 255).astype(np.uint8)
                    for s in range(shards):
                        part = slice(cuts[s], cuts[s + 1])
                        if part.start < part.stop:
                            over = counts[part][counts[part] >= 255]
                            rows.append((kind, s, key, short[part].tobytes(), small[part].tobytes(), over.astype("<i8").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["kind", "shard", "chunk", "keys", "counts", "over"])

    return run


def _unpack(keys: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(keys) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(keys, np.uint8).reshape(-1, width)
    return wide.view(np.uint64).reshape(-1)


def _answer(table: pa.Table) -> pa.Table:
    """One shard of one kind: the corpus count of every key asked for, per chunk; and totals in a row without chunk."""
    if not table.num_rows:
        return table.schema.empty_table()
    kind, shard = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
    keys = [_unpack(k, _KEY_BYTES[kind]) for k in table.column("keys").to_pylist()]
    counts = []
    for small, over in zip(table.column("counts").to_pylist(), table.column("over").to_pylist(), strict=True):
        c = np.frombuffer(small, np.uint8).astype(np.int64)
        c[c == 255] = np.frombuffer(over, "<i8")
        counts.append(c)
    sizes = [len(k) for k in keys]
    known, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(known)).astype(np.int64)
    out, k, held = [], 0, np.zeros(COUNTS)
    for n, own in zip(sizes, counts, strict=True):
        found = total[at[k : k + n]]
        out.append(_packed(found.astype("<u4" if total.max() < 2**32 else "<u8").tobytes()))
        held += np.bincount(_count_bins(found - own), weights=own, minlength=COUNTS)
        k += n
    n_rows = len(out) + 1
    return pa.table({
        "kind": pa.array([kind] * n_rows, pa.int32()), "shard": pa.array([shard] * n_rows, pa.int32()), "chunk": pa.array([*table.column("chunk").to_pylist(), None], pa.int64()),
        "totals": pa.array([*out, None], pa.binary()), "tokens": pa.array([None] * len(out) + [int(total.sum())], pa.int64()), "types": pa.array([None] * len(out) + [int((total > 0).sum())], pa.int64()),
        "held": pa.array([None] * len(out) + [held.tolist()], pa.list_(pa.float64())),
    })


def _count_bins(count: np.ndarray) -> np.ndarray:
    return np.minimum((np.log2(count + 1) * 8).astype(np.int64), COUNTS - 1)


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a chunk, compressed."""
    for batch in batches:
        for i, j, _, _ in X.text_chunks(batch.column("text"), CHUNK):
            rows, sink = batch.select(["_id", "text", "train"]).slice(i, j - i), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
                w.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([_chunk_key(batch, i, j)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "body"])


def _meet(key, bodies: pa.Table, answers: pa.Table) -> pa.Table:
    """Bodies and answers of one chunk; equal chunks (copied rows) may be there more than once."""
    if not bodies.num_rows or not answers.num_rows:
        raise ValueError("the documents changed between two passes: texts and counts don't belong together")
    joined: dict[int, list[bytes]] = {1: [], 2: []}
    seen = set()
    for kind, shard, totals in sorted(zip(answers.column("kind").to_pylist(), answers.column("shard").to_pylist(), answers.column("totals").to_pylist(), strict=True), key=lambda x: x[:2]):
        if (kind, shard) not in seen:
            seen.add((kind, shard))
            joined[kind].append(_unpacked(totals))
    n = bodies.num_rows
    return pa.table({"body": bodies.column("body"), **{name: pa.array([_packed(b"".join(joined[k]))] * n, pa.binary()) for k, name in ((1, "words"), (2, "pairs"))}})


class _Counts:
    """Counts of a chunk's words and pairs in the corpus (all) and without the chunk (own)."""

    def __init__(self, row: dict, docs: int):
        batch = pa.ipc.open_stream(row["body"]).read_next_batch()
        _, n, buf, offsets = next(X.text_chunks(batch.column("text"), 1 << 62))
        c = self.chunk = _Chunk(batch, 0, n, buf, offsets)
        self.word, self.pair = self._wide(row["words"], len(c.word)), self._wide(row["pairs"], len(c.pair))
        own = int(c.train.sum())
        self.context = np.where(c.pair_context < 0, docs, self.word[c.pair_context])
        self.context_own = np.where(c.pair_context < 0, own, c.word_count[c.pair_context])

    @staticmethod
    def _wide(data: bytes, n: int) -> np.ndarray:
        raw = _unpacked(data)
        return np.frombuffer(raw, "<u4" if len(raw) == 4 * n else "<u8").astype(np.int64)


def _bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64) + (count > 0), BUCKETS - 1)


def em_weight(mass: np.ndarray, ratio: np.ndarray, rounds: int = 100) -> float:
    """The weight a that maximises sum(mass * log(a*ratio + 1-a)); 0.5 without mass."""
    if not mass.sum():
        return 0.5
    a = 0.5
    for _ in range(rounds):
        new = float((mass * (a * ratio) / (a * ratio + 1 - a)).sum() / mass.sum())
        new = min(max(new, 1e-6), 1 - 1e-6)
        if abs(new - a) < 1e-9:
            return new
        a = new
    return a


def _lower(count: np.ndarray, total: int, types: int, u: float) -> np.ndarray:
    return u * count / max(total, 1) + (1 - u) / (types + 1)


def _bins(ratio: np.ndarray) -> np.ndarray:
    """0: none; else by log10."""
    with np.errstate(divide="ignore"):
        at = np.floor((np.log10(np.maximum(ratio, 1e-300)) - LOW) / (-2 * LOW) * (RATIOS - 1)).astype(np.int64)
    return np.where(ratio > 0, 1 + np.clip(at, 0, RATIOS - 2), 0)


def bin_ratios() -> np.ndarray:
    mid = 10 ** (LOW + (np.arange(RATIOS - 1) + 0.5) * (-2 * LOW) / (RATIOS - 1))
    return np.concatenate([[0.0], mid])


def _statistics(totals: dict, u: float):
    """Histogram of held-out tokens by context bucket and ratio of the estimates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros((BUCKETS, RATIOS))
        for batch in batches:
            for row in batch.to_pylist():
                k = _Counts(row, totals["docs"])
                c, context = k.chunk, k.context - k.context_own
                n_rest = max(totals["tokens"] - int(c.word_count.sum()), 1)
                lower = _lower((k.word - c.word_count)[c.pair_word], n_rest, totals["types"], u)
                ratio = (k.pair - c.pair_count) / np.maximum(context, 1) / lower
                flat = _bucket(context) * RATIOS + _bins(ratio)
                bins += np.bincount(flat, weights=c.pair_count, minlength=BUCKETS * RATIOS).reshape(BUCKETS, RATIOS)
        b, r = np.nonzero(bins)
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(r, pa.int32()), pa.array(bins[b, r], pa.float64())], ["bucket", "bin", "mass"])

    return run


def _scores(totals: dict, u: float, a: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = totals["tokens"], totals["types"]
        for batch in batches:
            for row in batch.to_pylist():
                k = _Counts(row, totals["docs"])
                c = k.chunk
                weight = np.where(k.context > 0, a[_bucket(k.context)], 0.0)
                p = weight * k.pair / np.maximum(k.context, 1) + (1 - weight) * _lower(k.word[c.pair_word], n, v, u)
                base = np.log10((k.word + 1) / (n + v + 1))
                sums = [np.bincount(c.rows, weights=x, minlength=len(c.tokens)) for x in (base[c.word_at], np.log10(p)[c.pair_at], (k.word > 0)[c.word_at])]
                yield pa.RecordBatch.from_arrays(
                    [c.ids, pa.array(~c.train), pa.array(c.tokens, pa.int64()), pa.array(sums[2].astype(np.int64)), pa.array(np.full(len(c.tokens), n), pa.int64()), pa.array(sums[0]), pa.array(sums[1])],
                    ["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


@dataclass(frozen=True)
class Model:
    """Training tokens, types and documents; the unigram weight u and the weights a of the context buckets; and the
    texts with the corpus counts of their n-grams, by chunk."""

    tokens: int
    types: int
    docs: int
    unigram: float
    weights: np.ndarray
    met: DataFrame


def fit(docs: DataFrame, held_out: Column, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of the rows where held_out is false."""
    spark = bounded_batches(docs)
    tables = Tables(spark)
    train = F.coalesce(~held_out, F.lit(False)).alias("train")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), train, F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"))
    size = docs.agg(F.count(F.when(F.coalesce(~held_out, F.lit(False)), 1)).alias("train"), F.sum(F.octet_length(text_col)).alias("bytes")).first()
    shards = shards or max(8, partitions(spark), math.ceil((size.bytes or 0) / SHARD_BYTES))
    asked = rows.mapInArrow(_ask(shards), "kind int, shard int, chunk long, keys binary, counts binary, over binary")
    answers = tables.save(asked.groupBy("kind", "shard").applyInArrow(_answer, "kind int, shard int, chunk long, totals binary, tokens long, types long, held array<double>"))
    del asked
    tables.release()
    about = answers.where("chunk is null and kind = 1")
    summed = about.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    totals = {"tokens": summed.tokens or 0, "types": summed.types or 0, "docs": size.train}
    replies = answers.where("chunk is not null").select("chunk", "kind", "shard", "totals")
    bodies = rows.mapInArrow(_body, "chunk long, body binary")
    met = tables.save(bodies.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_meet, "body binary, words binary, pairs binary"))

    held = np.zeros(COUNTS)
    for r in about.select(F.posexplode("held").alias("bin", "mass")).groupBy("bin").agg(F.sum("mass").alias("mass")).collect():  # COUNTS rows
        held[r.bin] = r.mass
    count = 2 ** (np.arange(COUNTS) / 8) - 1
    u = em_weight(held, count / max(totals["tokens"], 1) * (totals["types"] + 1))
    bins = np.zeros((BUCKETS, RATIOS))
    for r in met.mapInArrow(_statistics(totals, u), "bucket int, bin int, mass double").groupBy("bucket", "bin").agg(F.sum("mass").alias("mass")).collect():  # BUCKETS x RATIOS rows at most
        bins[r.bucket, r.bin] = r.mass
    a = np.array([em_weight(m, bin_ratios()) for m in bins])
    a[0] = 0.0
    return Model(**totals, unigram=u, weights=a, met=met)


def score(docs: DataFrame, held_out: Column, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trains on the rows where held_out is false and scores all; one row per document:
    id, held_out, n_tokens, n_known, train_tokens (N), base_score (add-one words), score (log10 of the model).

    Null or empty text is the end token alone; a null held_out counts as held out.  Without training rows every
    token is unknown and the uniform part decides.  Repeated rows are counted and scored each, as are rows of one id
    with different texts; no rows give none.  docs must give the same rows in the same order twice, as files do.
    """
    model = fit(docs, held_out, shards, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    totals = {"tokens": model.tokens, "types": model.types, "docs": model.docs}
    found = model.met.mapInArrow(_scores(totals, model.unigram, model.weights), f"_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return found.withColumnRenamed("_id", id_col)


def perplexity(scored: DataFrame) -> float:
    """Of the held-out documents, per token."""
    r = scored.where("held_out").agg(F.sum("score").alias("s"), F.sum("n_tokens").alias("n")).first()
    return 10 ** (-r.s / r.n) if r.n else math.nan
