"""Repeated passages by suffix arrays and longest-previous-factor arrays.

A string of min_len bytes that occurs twice has the same lowest-hashed k-gram at the same
place both times.  So the start positions of a text fall into runs with one such anchor,
and only runs whose anchors meet elsewhere, with an equal half of what surrounds them,
have to be compared.  Runs with wholly equal bytes are known at once.  For the others the
bytes are put together per anchor, a suffix array is built, and previous and next smaller
positions in suffix order give each position's longest earlier (and later) match.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._shared import Tables, bounded_batches, partitions

MIN_LEN = 400
CHUNK = 1 << 19
ANCHOR = 128
#: Bytes of which one suffix array is built.
ARRAY_BYTES = 1 << 19
#: Bytes of runs in a bucket, and about how many of them a byte of text has.
BUCKET_BYTES = 4 << 20
RUN_SHARE = 0.4


def _ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def suffix_order(data: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, lcp) by prefix doubling to depth bytes or more.

    Suffixes are ordered by group first, and only suffixes of one group have a common prefix.  lcp[i] belongs to
    places i-1 and i; values from depth - 1 on may be given as less, but not below depth, and values below half the
    last doubling (7 * 2**k >= depth) as 0.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    word = np.zeros(n, np.uint64)
    for k in range(7):  # 7 symbols of 9 bits
        word = (word << np.uint64(9)) | padded[k : k + n]
    rank = _ranks(_ranks(word) + _ranks(group) * np.int64(n))
    levels, size = [(7, rank)], 7
    while size < depth:
        ahead = np.zeros(n, np.int64)
        ahead[: max(n - size, 0)] = rank[size:] + 1
        rank = _ranks(rank * np.int64(n + 1) + ahead)
        size *= 2
        levels.append((size, rank))
    order = np.argsort(rank, kind="stable")
    lcp = np.zeros(n, np.int64)
    size, half = levels[-2] if len(levels) > 1 else levels[-1]
    pair = np.flatnonzero(half[order[1:]] == half[order[:-1]]) + 1
    i, j = order[pair - 1].copy(), order[pair].copy()
    length = np.zeros(len(pair), np.int64)
    for size, level in reversed(levels):
        inside = (i < n) & (j < n)
        same = np.zeros(len(pair), bool)
        same[inside] = level[i[inside]] == level[j[inside]]
        for x in (i, j, length):
            x[same] += size
    for _ in range(6):
        inside = (i < n) & (j < n)
        same = np.zeros(len(pair), bool)
        same[inside] = (data[i[inside]] == data[j[inside]]) & (group[i[inside]] == group[j[inside]])
        for x in (i, j, length):
            x[same] += 1
    lcp[pair] = length
    return order, lcp


def previous_factors(order: np.ndarray, lcp: np.ndarray, least: int, later: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(lpf, source) by position: the longest match of least bytes or more that starts earlier (later: later).

    The nearest smaller positions before and after a suffix in suffix order hold its longest earlier match; the
    match with each is the least lcp on the way, so a way ends where that falls below least.  All suffixes look for
    theirs at once: one that is larger passes on how far it has come itself.  0 and -1: none.
    """
    n = len(order)
    key = -order if later else order
    best, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    reach = np.concatenate([lcp[1:], [0]]) if n else lcp  # lcp with the suffix after
    for turned in (False, True):
        k, low = (key[::-1], reach[::-1].copy()) if turned else (key, lcp.copy())
        to = np.arange(n) - 1  # nearest smaller one so far looked for; all between it and the suffix are larger
        at = np.flatnonzero((to >= 0) & (low >= least))
        while len(at):
            at = at[k[to[at]] > k[at]]
            ahead = to[at]
            match = np.minimum(low[at], low[ahead])
            far = to[ahead]
            open_ = (far >= 0) & (match >= least)
            low[at], to[at] = match, np.where(open_, far, -1)
            at = at[open_]
        found = np.flatnonzero((to >= 0) & (low >= least))
        there, match = to[found], low[found]
        if turned:
            found, there = n - 1 - found, n - 1 - there
        p = order[found]
        better = match > best[p]
        best[p[better]], source[p[better]] = match[better], order[there][better]
    return best, source


def anchor_runs(buf: np.ndarray, offsets: np.ndarray, min_len: int, k: int) -> dict[str, np.ndarray]:
    """Runs of start positions with one anchor: row, lo and hi (first and last start), at (the anchor), in the
    chunk's bytes; hashes of the anchor, of the run's bytes, and of the half to the left and right (0: no half)."""
    width, n = min_len - k + 1, len(buf)
    sizes = np.diff(offsets)
    names = ("row", "lo", "hi", "at", "anchor", "whole", "left", "right")
    if n < min_len or sizes.max() < min_len:
        return {x: np.zeros(0, np.int64) for x in names}
    prefix = X.prefix_hash(buf)
    power, inverse = X._power_tables(n + 1)
    m = n - k + 1
    grams = X.mix64((prefix[k:] - prefix[:m]) * inverse[:m])
    bits = max(20, n.bit_length())
    ranked = (grams >> np.uint64(bits) << np.uint64(bits)) | np.arange(m, dtype=np.uint64)
    blocks = -(-m // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max)
    padded[:m] = ranked
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, 1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
    starts = m - width + 1
    at = (np.minimum(back[:starts], ahead[width - 1 : width - 1 + starts]) & np.uint64((1 << bits) - 1)).astype(np.int64)
    valid = np.zeros(starts + 1, np.int64)
    for_rows = np.flatnonzero(sizes >= min_len)
    np.add.at(valid, offsets[for_rows], 1)
    np.add.at(valid, np.minimum(offsets[for_rows + 1] - min_len + 1, starts), -1)
    p = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    a = at[p]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(fresh)
    lo, hi, at = p[first], p[np.append(first[1:], len(p)) - 1], a[first]
    row = np.searchsorted(offsets, lo, "right") - 1
    half = (min_len - k) // 2
    span = lambda s, e: X.hash_spans(prefix, s, e).view(np.int64)
    has_left, has_right = at - lo >= half, hi + min_len - at - k >= half
    left = np.where(has_left, span(np.maximum(at - half, 0), at) | 1, 0)
    right = np.where(has_right, span(np.minimum(at + k, n), np.minimum(at + k + half, n)) | 1, 0)
    whole = X.mix64((X.hash_spans(prefix, lo, hi + min_len) + (at - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)
    return {"row": row, "lo": lo, "hi": hi, "at": at, "anchor": grams[at].view(np.int64), "whole": whole, "left": left, "right": right}


_RUN = np.dtype([("anchor", "<i8"), ("whole", "<i8"), ("left", "<i8"), ("right", "<i8"), ("doc", "<i8"), ("lo", "<i4"), ("n", "<i4"), ("at", "<i4"), ("many", "<i4")])


def _spans(doc: np.ndarray, lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans of each document, put together where they touch."""
    if not len(doc):
        return doc, lo, end
    order = np.lexsort((lo, doc))
    doc, lo, end = doc[order], lo[order], end[order]
    group = np.cumsum(np.concatenate([[True], doc[1:] != doc[:-1]]))
    reach = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)
    fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] > reach[:-1])])
    first = np.flatnonzero(fresh)
    return doc[first], lo[first], reach[np.append(first[1:], len(doc)) - 1]


def _distinct(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs sorted by their bytes and then place; places of the first of each kind, and how many there are."""
    runs = runs[np.lexsort((runs["lo"], runs["doc"], runs["whole"], runs["anchor"]))]
    first = np.flatnonzero(np.concatenate([[True], (runs["anchor"][1:] != runs["anchor"][:-1]) | (runs["whole"][1:] != runs["whole"][:-1])]))
    return runs, first, np.diff(np.append(first, len(runs)))


def _covered(runs: np.ndarray, which: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _spans(runs["doc"][which], runs["lo"][which].astype(np.int64), (runs["lo"] + runs["n"])[which].astype(np.int64) + min_len)


def _runs(min_len: int, k: int, buckets: int):
    """Rows (bucket, runs) for comparison, and (doc, lo, end) of later copies within the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column("doc_id").to_numpy(zero_copy_only=False), []
            for i, _, buf, offsets in X.text_chunks(batch.column("text"), CHUNK):
                r = anchor_runs(buf, offsets, min_len, k)
                one = np.zeros(len(r["row"]), _RUN)
                for name in ("anchor", "whole", "left", "right"):
                    one[name] = r[name]
                one["doc"], one["lo"], one["n"], one["at"] = ids[i + r["row"]], r["lo"] - offsets[r["row"]], r["hi"] - r["lo"], r["at"] - r["lo"]
                parts.append(one)
            runs = np.concatenate(parts) if parts else np.zeros(0, _RUN)
            if not len(runs):
                continue
            runs, first, copies = _distinct(runs)
            later = np.ones(len(runs), bool)
            later[first] = False
            doc, lo, end = _covered(runs, later, min_len)
            sent = runs[first]
            sent["many"] = copies > 1
            # anchors are the lowest hashes around, so only mixed anew do they spread over the buckets
            place = (X.mix64(sent["anchor"].view(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(40)).astype(np.int64) * buckets >> 24
            cuts = np.searchsorted(place[np.argsort(place, kind="stable")], np.arange(buckets + 1))
            sent = sent[np.argsort(place, kind="stable")]
            used = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
            blobs = [sent[cuts[b] : cuts[b + 1]].tobytes() for b in used]
            n = len(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used + [None] * n, pa.int32()), pa.array(blobs + [None] * n, pa.binary())]
                + [pa.concat_arrays([pa.nulls(len(used), pa.int64()), pa.array(x.astype(np.int64))]) for x in (doc, lo, end)],
                ["bucket", "runs", "doc", "lo", "end"],
            )

    return run


def _meet(min_len: int, keep_first: bool):
    """One bucket: spans of runs with wholly equal bytes, and runs to compare by the half they share."""

    def run(table: pa.Table) -> pa.Table:
        runs, first, copies = _distinct(np.concatenate([np.frombuffer(x, _RUN) for x in table.column("runs").to_pylist()]))
        kinds = runs[first].copy()
        kinds["many"] |= copies > 1
        gone = np.ones(len(runs), bool)
        gone[first] = False if keep_first else kinds["many"] > 0
        doc, lo, end = _covered(runs, gone, min_len)
        groups, members = [], []
        for side, salt in (("left", 0x5851F42D4C957F2D), ("right", 0x14057B7EF767814F)):
            has = np.flatnonzero(kinds[side] != 0)
            key = X.mix64(X.mix64(kinds["anchor"][has].view(np.uint64) ^ np.uint64(salt)) + kinds[side][has].view(np.uint64))
            order = np.argsort(key, kind="stable")
            key, has = key[order], has[order]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.append(start, len(key)))
            lone = np.add.reduceat((kinds["many"][has] == 0).astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
            keep = np.repeat((size > 1) & (keep_first | (lone > 0)), size)
            groups.append(key[keep])
            members.append(has[keep])
        group, m = np.concatenate(groups).view(np.int64), kinds[np.concatenate(members)]
        a, b = len(doc), len(group)
        ints = lambda x, y: pa.array(np.concatenate([x.astype(np.int64), y.astype(np.int64)]))
        return pa.table({
            "doc": ints(doc, m["doc"]), "lo": ints(lo, m["lo"]), "end": ints(end, m["lo"].astype(np.int64) + m["n"] + min_len),
            "group": pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(group)]), "many": pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(m["many"].astype(np.int64))]),
        })

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each run to compare."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        size = 0
        for doc, text, runs in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "asked")], strict=True):
            data = text.encode()
            for r in runs:
                for c, v in zip(out, (r["group"], r["many"], doc, r["lo"], data[r["lo"] : r["end"]]), strict=True):
                    c.append(v)
                size += r["end"] - r["lo"]
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:4]], pa.array(out[4], pa.binary())], ["group", "many", "doc", "lo", "bytes"])
                out, size = [[], [], [], [], []], 0
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:4]], pa.array(out[4], pa.binary())], ["group", "many", "doc", "lo", "bytes"])


def compare(pieces: list[bytes], group: np.ndarray, min_len: int, keep_first: bool, rank: np.ndarray | None = None) -> list[np.ndarray]:
    """For each piece its ascending start positions of min_len bytes that occur elsewhere in its group.

    keep_first: only those with an earlier occurrence, in the order of rank (default: as given).
    """
    order = np.argsort(rank, kind="stable") if rank is not None else np.arange(len(pieces))
    sizes = np.array([len(pieces[k]) for k in order])
    data = np.frombuffer(b"".join(pieces[k] for k in order), np.uint8)
    owner = np.repeat(np.arange(len(order)), sizes)
    sa, lcp = suffix_order(data, group[order][owner], min_len + 1)
    # a match may not run past its piece
    stop = np.cumsum(sizes)
    fits = (stop[owner] - np.arange(len(data)) >= min_len)[sa]
    sa, lcp = _restrict(sa, lcp, fits)
    hit = np.zeros(len(data), bool)
    hit[sa] = _by_place(sa, lcp, min_len, False) | (False if keep_first else _by_place(sa, lcp, min_len, True))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
    for k, (a, b) in enumerate(zip(stop - sizes, stop, strict=True)):
        out[order[k]] = np.flatnonzero(hit[a:b])
    return out


def _restrict(order: np.ndarray, lcp: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order without some suffixes; the lcp of new neighbours is the least between them."""
    at = np.flatnonzero(keep)
    if not len(at):
        return order[:0], lcp[:0]
    low = np.minimum.reduceat(lcp[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
    low[0] = 0
    return order[at], low


def _by_place(order: np.ndarray, lcp: np.ndarray, least: int, later: bool) -> np.ndarray:
    """By place in suffix order: whether there is an earlier (later) match."""
    dense = np.empty(len(order), np.int64)
    dense[np.argsort(order, kind="stable")] = np.arange(len(order))
    found, _ = previous_factors(dense, lcp, least, later)
    return found[dense] >= least


def _compare(min_len: int, keep_first: bool):
    """Groups of one task, many at a time: spans of starts that match within their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            found = compare([r[4] for r in rows], np.array([r[0] for r in rows]), min_len, keep_first, np.lexsort(([r[3] for r in rows], [r[2] for r in rows])).argsort())
            docs, los, ends = [], [], []
            for r, p in zip(rows, found, strict=True):
                if len(p) and (keep_first or not r[1]):
                    cut = np.flatnonzero(np.diff(p) > min_len)
                    a, b = p[np.concatenate([[0], cut + 1])], p[np.append(cut, len(p) - 1)]
                    docs.append(np.full(len(a), r[2]))
                    los.append(a + r[3])
                    ends.append(b + r[3] + min_len)
            cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, los, ends)]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["doc", "lo", "end"])

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("group", "many", "doc", "lo", "bytes")], strict=True):
                if size > ARRAY_BYTES and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield flush(held)

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data = (text or "").encode()
            merged: list[list[int]] = []
            for s in sorted((x["lo"], x["end"]) for x in spans or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            kept, at = [], 0
            for a, b in merged:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            rest = b"".join(kept)
            rows.append((len(data), len(data) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), [{"start": a, "end": b} for a, b in merged], rest))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"])


def remove_repeats(docs: DataFrame, min_len: int = MIN_LEN, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes every byte covered by a min_len-byte string that also starts elsewhere, in any document or the same:
    with keep_first at an earlier place (by id, then position), else at any other.

    (id, n_bytes, n_removed, n_spans long, kept_sha256 string, removed array<struct<start,end>>, kept binary), a row
    per row.  Strings are judged on the input and may overlap; none runs over a document's end.
    Null and empty texts have 0 bytes.  Ids are whole numbers; rows of one id are one document, so repeated rows
    are copies of each other and each loses what any of them does.  Other columns are not carried.
    """
    if min_len < 64:
        raise ValueError("min_len must be 64 or more")
    spark = bounded_batches(docs)
    k = min(ANCHOR, min_len // 2)
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first().n or 0
    tables, buckets = Tables(spark), max(partitions(spark), math.ceil(size * RUN_SHARE / BUCKET_BYTES))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.where("doc_id is not null").mapInArrow(_runs(min_len, k, buckets), "bucket int, runs binary, doc long, lo long, end long")
    found = tables.save(found)
    met = found.where("runs is not null").select("bucket", "runs").groupBy("bucket").applyInArrow(_meet(min_len, keep_first), "doc long, lo long, end long, group long, many long")
    met = tables.save(met)
    asked = met.where("group is not null").groupBy("doc").agg(F.collect_list(F.struct("group", "many", "lo", "end")).alias("asked"))
    texts = rows.join(tables.save(asked.withColumnRenamed("doc", "doc_id")), "doc_id")
    cut = texts.mapInArrow(_cut, "group long, many long, doc long, lo long, bytes binary")
    sorted_ = cut.repartition(partitions(spark), "group").sortWithinPartitions("group")
    matched = sorted_.mapInArrow(_compare(min_len, keep_first), "doc long, lo long, end long")
    spans = found.where("runs is null").select("doc", "lo", "end").unionByName(met.where("group is null").select("doc", "lo", "end")).unionByName(matched)
    per_doc = tables.save(spans.groupBy("doc").agg(F.collect_set(F.struct("lo", "end")).alias("spans")).withColumnRenamed("doc", "doc_id"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.join(per_doc, "doc_id", "left").mapInArrow(
        _remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>, kept binary"
    )
    return out.withColumnRenamed("doc_id", id_col)
