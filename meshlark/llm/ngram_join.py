"""N-gram Jaccard self-join by T-occurrence search (DivideSkip).

Two sets with Jaccard similarity of at least t share T = t/(1+t) (|a|+|b|) shingles.  As
many as T-1 of a set's inverted lists, its longest, can be put aside: a partner must be
on one of the short lists left.  Steps:

1. Each document's distinct shingles are hashed; equal sets form a class, known by a hash
   of the set, and one document stands for it.
2. Shingles are ordered by rarity (a bounded table of frequent ones, then the hash); the
   short lists of a set are those of its first |a| - ceil(t |a|) + 1 shingles.
3. Buckets of shingles, of bounded bytes each, merge short lists and keep those with two
   sets or more; lists of very frequent shingles need no merging and skip that.
4. The first set of each list is offered to the others on it, one pair per set and list.
   For each first set with a block of its partners, the lists of all its shingles over the
   block are searched by DivideSkip: short ones are heap-merged with skips, long ones
   probed by binary search, and those that reach the required overlap are linked.
5. Linked sets form components.  A set outside the component of a list's first set is a
   query: it gets the entries of other components on its short lists.  They are counted
   over all lists of the query in one place, before any pair is written; those on enough
   lists together are searched as in 4.  Pairs within one component need no look, so every
   pair that could be linked is either searched or already connected.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._shared import Tables, bounded_batches, components, partitions

#: Shingles in the table of frequent ones, at most; it only orders shingles, so any table gives the same links.
HOT_SHINGLES = 1_000_000
HOT_COUNT = 32
#: Sets in the table of copied ones, at most: of these one row enters the lists, of others one of each batch.
DUP_SETS = 1_000_000
#: Shingles of this rank (1 + log2 of their number) are not merged in a bucket: their lists have sets enough.
DIRECT_RANK = 18
BUCKET_BYTES = 8 << 20
#: Entries of a list that are looked at together.
LIST = 100_000
#: Up to so many sets, a list of those whose texts are wanted (8 bytes each) is sent to all tasks; beyond it, texts are joined.
BROADCAST_NODES = 2_000_000
CHUNK = 1 << 20
BLOCK = 64


def least_overlap(a: int | np.ndarray, b: int | np.ndarray, percent: int) -> int | np.ndarray:
    """The smallest intersection that reaches percent of the union of sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def divide_skip(lists: Sequence[Sequence[int]], threshold: int) -> dict[int, int]:
    """{id: number of lists with it} for the ids on threshold lists or more; every list ascends without repeats.

    The longest lists are put aside and probed by binary search for the few ids that a heap merge of the others
    leaves; the merge jumps over ids that can't be on enough lists.
    """
    if threshold < 1:
        raise ValueError("threshold must be 1 or more")
    lists = sorted((x for x in lists if x), key=len, reverse=True)
    if len(lists) < threshold:
        return {}
    n_long = min(threshold - 1, int(threshold / (0.01 * np.log2(max(len(lists[0]), 2)) + 1)))
    long, short = lists[:n_long], lists[n_long:]
    need = threshold - n_long
    heap = [(x[0], k, 0) for k, x in enumerate(short)]
    heapq.heapify(heap)
    found: dict[int, int] = {}
    while len(heap) >= need:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= need:
            count = len(popped)
            for x in long:
                at = bisect_left(x, top)
                count += at < len(x) and x[at] == top
            if count >= threshold:
                found[top] = count
            for _, k, at in popped:
                if at + 1 < len(short[k]):
                    heapq.heappush(heap, (short[k][at + 1], k, at + 1))
        else:  # need-1 lists are out: only ids from the new top on can be on enough lists
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            bar = heap[0][0]
            for _, k, at in popped:
                to = bisect_left(short[k], bar, at)
                if to < len(short[k]):
                    heapq.heappush(heap, (short[k][to], k, to))
    return found


def _class_keys(bounds: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row's set."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(X.mix64(tokens ^ np.uint64(salt)), out=total[1:])
        out.append(X.mix64(total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def _sets(width: int):
    """(doc_id, n, k1, k2) per row, and (shingle, copies) of shingles that several distinct sets of a batch share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens_of, n_of, keys = [], [], ([], [])
            for _, _, buf, offsets in X.text_chunks(batch.column("text"), CHUNK):
                bounds, tokens = X.shingle_sets(buf, offsets, width)
                k1, k2 = _class_keys(bounds, tokens)
                _, first = np.unique(k1, return_index=True)
                mask = np.zeros(len(k1), bool)
                mask[first] = True
                tokens_of.append(tokens[np.repeat(mask, np.diff(bounds))])
                n_of.append(np.diff(bounds))
                keys[0].append(k1)
                keys[1].append(k2)
            if not n_of:
                continue
            ranked = np.sort(np.concatenate(tokens_of))
            edge = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
            copies = np.diff(np.append(edge, len(ranked)))
            shared = copies > 1
            n, m = batch.num_rows, int(shared.sum())
            none = pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([x, none]) for x in (batch.column("doc_id"), pa.array(np.concatenate(n_of)), pa.array(np.concatenate(keys[0])), pa.array(np.concatenate(keys[1])))]
                + [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(x)]) for x in (ranked[edge[shared]].view(np.int64), copies[shared])],
                ["doc_id", "n", "k1", "k2", "shingle", "copies"],
            )

    return run


def _frequent(counted: DataFrame, room: int) -> dict[str, np.ndarray]:
    """The columns of the rows (key long, n long, ...) with the largest n, room rows at most, by ascending key."""
    sizes = counted.groupBy(F.floor(F.log2("n")).alias("b")).count().collect()  # 64 rows at most
    floor = 64
    for r in sorted(sizes, key=lambda r: -r.b):
        if r["count"] > room:
            break
        room -= r["count"]
        floor = r.b
    found = counted.where(F.col("n") >= float(2**floor)).toArrow()
    columns = {c: found.column(c).to_numpy() for c in found.column_names}
    order = np.argsort(columns["key"].view(np.uint64) if "id" not in columns else columns["key"])
    return {c: v[order] for c, v in columns.items()}


def _standing(ids: np.ndarray, key: np.ndarray, known: np.ndarray, dup_key: np.ndarray, dup_id: np.ndarray) -> np.ndarray:
    """Rows that stand for their set: the first of the batch, and of a set in the table of copied ones only that with its id."""
    _, first = np.unique(key, return_index=True)
    fresh = np.zeros(len(key), bool)
    if len(dup_key):
        at = np.minimum(np.searchsorted(dup_key, key), len(dup_key) - 1)
        out = (dup_key[at] == key) & (dup_id[at] != ids)
        own = np.flatnonzero(~out)
        first = own[np.unique(key[own], return_index=True)[1]]
    fresh[first] = True
    return fresh & ~np.isin(key, known)


_SHORT = "token long, node long, size int, pos int"


def _postings(width: int, percent: int, buckets: int, direct_rank: int, hot: np.ndarray, rank: np.ndarray, dup_key: np.ndarray, dup_id: np.ndarray):
    """Short lists' entries: by bucket of shingles, or for shingles of rank direct_rank and more as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            known = np.zeros(0, np.int64)
            for i, j, buf, offsets in X.text_chunks(batch.column("text"), CHUNK):
                bounds, tokens = X.shingle_sets(buf, offsets, width)
                n = np.diff(bounds)
                key, _ = _class_keys(bounds, tokens)
                fresh = _standing(ids[i:j], key, known, dup_key, dup_id) & (n > 0)
                known = np.concatenate([known, key[fresh]])
                rows = np.repeat(np.arange(len(n)), n)
                weight = np.zeros(len(tokens), np.uint8)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
                    weight = np.where(hot[at] == tokens, rank[at], 0)
                order = np.lexsort((tokens, weight, rows))
                place = np.arange(len(tokens)) - np.repeat(bounds[:-1], n)
                keep = fresh[rows] & (place < (n - -(-percent * n // 100) + 1)[rows])
                token, row, pos, weight = tokens[order][keep], rows[keep], place[keep].astype("<u4"), weight[order][keep]
                direct = weight >= direct_rank
                token_d, row_d, pos_d = token[direct].view(np.int64), row[direct], pos[direct].astype(np.int32)
                token, row, pos = token[~direct], row[~direct], pos[~direct]
                order = np.argsort(token, kind="stable")
                token, row, pos = token[order], row[order].astype("<u4"), pos[order]
                edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
                cuts = np.concatenate([[0], np.searchsorted(token, edges), [len(token)]])
                used = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
                columns: list[list] = [[], [], [], [], []]
                for b in used:
                    part = slice(cuts[b], cuts[b + 1])
                    held, local = np.unique(row[part], return_inverse=True)
                    for c, v in zip(columns, (token[part].tobytes(), local.astype("<u2").tobytes() if len(held) < 1 << 16 else local.astype("<u4").tobytes(), pos[part].tobytes(), key[held].astype("<i8").tobytes(), n[held].astype("<u4").tobytes()), strict=True):
                        c.append(v)
                m, d = len(used), len(token_d)
                if m + d:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([*used, *[None] * d], pa.int32()), *[pa.array(c + [None] * d, pa.binary()) for c in columns]]
                        + [pa.concat_arrays([pa.nulls(m, t), pa.array(x, t)]) for x, t in ((token_d, pa.int64()), (key[row_d], pa.int64()), (n[row_d].astype(np.int32), pa.int32()), (pos_d, pa.int32()))],
                        ["bucket", "tokens", "rows", "places", "ids", "sizes", "token", "node", "size", "pos"],
                    )

    return run


def _merge(table: pa.Table) -> pa.Table:
    """One bucket: the entries of its lists with two sets or more."""
    parts = []
    for t, r, p, i, s in zip(*[table.column(c).to_pylist() for c in ("tokens", "rows", "places", "ids", "sizes")], strict=True):
        at = np.frombuffer(r, "<u2" if 4 * len(r) == len(t) else "<u4")
        parts.append((np.frombuffer(t, "<u8"), np.frombuffer(i, "<i8")[at], np.frombuffer(s, "<u4")[at], np.frombuffer(p, "<u4")))
    token, node, size, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    order = np.argsort(token, kind="stable")
    ranked = token[order]
    same = ranked[1:] == ranked[:-1]
    shared = np.zeros(len(token), bool)
    shared[1:] |= same
    shared[:-1] |= same
    order = order[shared]
    token, node, size, pos = token[order], node[order], size[order], pos[order]
    order = np.lexsort((node, token))
    token, node, size, pos = token[order], node[order], size[order], pos[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, node, size, pos = token[fresh], node[fresh], size[fresh], pos[fresh]
    _, at, counts = np.unique(token, return_inverse=True, return_counts=True)
    many = counts[at] > 1
    return pa.table({"token": token[many].view(np.int64), "node": node[many], "size": size[many].astype(np.int32), "pos": pos[many].astype(np.int32)})


def _reach(size_a: np.ndarray, pos_a: np.ndarray, size_b: np.ndarray, pos_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets with one shingle at these places can overlap enough: what is before and from there on in both."""
    return np.minimum(pos_a, pos_b) + np.minimum(size_a - pos_a, size_b - pos_b) >= least_overlap(size_a, size_b, percent)


def _offered(percent: int) -> str:
    """The same for an entry and the first entry of its list, as SQL."""
    return f"node <> l.node AND least(pos, l.pos) + least(size - pos, l.size - l.pos) >= ({percent} * (size + l.size) + {99 + percent}) DIV {100 + percent}"


def _queries(percent: int):
    """Rows sorted by (token, part): for each query the entries of other components on the list, added up over the
    lists of a batch: (q, q_size, nodes, sizes, times)."""

    def add_up(found: list[tuple]) -> tuple:
        q, e, qs, es, times = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((e, q))
        q, e, qs, es, times = q[order], e[order], qs[order], es[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (e[1:] != e[:-1])]))
        return q[first], e[first], qs[first], es[first], np.add.reduceat(times, first)

    def rows_of(found: list[tuple]) -> pa.RecordBatch:
        q, e, qs, es, times = add_up(found)
        cut = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        ends = np.append(cut[1:], len(q))
        blobs = [[x[a:b].tobytes() for a, b in zip(cut.tolist(), ends.tolist(), strict=True)] for x in (e.astype("<i8"), es.astype("<u4"), times.astype("<u4"))]
        return pa.RecordBatch.from_arrays([pa.array(q[cut]), pa.array(qs[cut].astype(np.int64)), *[pa.array(b, pa.binary()) for b in blobs]], ["q", "q_size", "nodes", "sizes", "times"])

    def pairs(one: dict[str, np.ndarray]) -> Iterator[tuple]:
        queries = np.flatnonzero(one["query"])
        home = np.flatnonzero(one["home"])
        step = max(1, 1_000_000 // max(len(home), 1))
        for k in range(0, len(queries), step):
            qi = np.repeat(queries[k : k + step], len(home))
            ei = np.tile(home, len(queries[k : k + step]))
            ok = (one["root"][qi] != one["root"][ei]) & (~one["query"][ei] | (one["node"][ei] < one["node"][qi]))
            qi, ei = qi[ok], ei[ok]
            ok = _reach(one["size"][qi], one["pos"][qi], one["size"][ei], one["pos"][ei], percent)
            qi, ei = qi[ok], ei[ok]
            if len(qi):
                yield one["node"][qi], one["node"][ei], one["size"][qi], one["size"][ei], np.ones(len(qi), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("token", "part", "node", "size", "pos", "root", "query", "home")
        left: dict[str, np.ndarray] | None = None
        found: list[tuple] = []
        held = 0
        for batch in _then_none(batches):
            new = None if batch is None else {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            if new is not None and not len(new["token"]):
                continue
            cols = left if new is None else new if left is None else {c: np.concatenate([left[c], new[c]]) for c in names}
            if cols is None:
                break
            start = np.flatnonzero(np.concatenate([[True], (cols["token"][1:] != cols["token"][:-1]) | (cols["part"][1:] != cols["part"][:-1])]))
            stop = np.append(start[1:], len(cols["token"]))
            last = len(start) if new is None else len(start) - 1  # the last list may go on in the next batch
            some = np.add.reduceat(cols["query"].astype(np.int64), start)
            for k in np.flatnonzero(some[:last]).tolist():
                for p in pairs({c: cols[c][start[k] : stop[k]] for c in names}):
                    found.append(p)
                    held += len(p[0])
                    if held > 2_000_000:
                        found = [add_up(found)]
                        if len(found[0][0]) > 1_000_000:
                            yield rows_of(found)
                            found = []
                        held = len(found[0][0]) if found else 0
            left = None if new is None else {c: cols[c][start[-1] :] for c in names}
        if found:
            yield rows_of(found)

    return run


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _enough(percent: int):
    """Rows sorted by q: the pairs (a, b) of a query and a set that share as many short lists as a linked pair has to:
    of its overlap, what the rest of the larger set can't hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, size = None, 0
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            node, sizes, times = (np.concatenate(x) for x in zip(*held, strict=True))
            known, first, at = np.unique(node, return_index=True, return_inverse=True)
            total, sizes = np.bincount(at, weights=times, minlength=len(known)), sizes[first].astype(np.int64)
            hit = known[total >= least_overlap(size, sizes, percent) - (-(-percent * np.maximum(size, sizes) // 100)) + 1]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), current, np.int64)), pa.array(hit)], ["a", "b"])

        for batch in batches:
            for q, s, *blobs in zip(*[batch.column(c).to_pylist() for c in ("q", "q_size", "nodes", "sizes", "times")], strict=True):
                if q != current:
                    if held:
                        yield flush()
                    current, size, held = q, s, []
                held.append(tuple(np.frombuffer(b, t) for b, t in zip(blobs, ("<i8", "<u4", "<u4"), strict=True)))
        if held:
            yield flush()

    return run


def search_block(query: np.ndarray, members: list[np.ndarray], percent: int) -> list[int]:
    """Places of the members that reach percent of the union with query; all are ascending arrays of shingles."""
    sizes = np.array([len(m) for m in members])
    needed = least_overlap(len(query), sizes, percent)
    token = np.concatenate(members)
    owner = np.repeat(np.arange(len(members)), sizes)
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    lo, hi = np.searchsorted(token, query, "left"), np.searchsorted(token, query, "right")
    places = owner.tolist()
    lists = [places[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if a < b]
    counts = divide_skip(lists, int(needed.min()))
    return [k for k, n in counts.items() if n >= needed[k]]


def _search(width: int, percent: int):
    """Rows sorted by (a, block, role): the query's text, then its block of texts; yields linked (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, query = None, None
        names: list[int] = []
        sets: list[np.ndarray] = []
        out: list[tuple[int, int]] = []

        def flush() -> None:
            if sets and query is not None:
                out.extend((current[0], names[k]) for k in search_block(query, sets, percent))
            names.clear()
            sets.clear()

        for batch in batches:
            a, block, role, b = (batch.column(c).to_pylist() for c in ("a", "block", "role", "b"))
            for i, j, buf, offsets in X.text_chunks(batch.column("text"), CHUNK):
                bounds, tokens = X.shingle_sets(buf, offsets, width)
                for r in range(i, j):
                    own = tokens[bounds[r - i] : bounds[r - i + 1]]
                    if (a[r], block[r]) != current:
                        flush()
                        current, query = (a[r], block[r]), None
                    if role[r] == 0:
                        query = own
                    elif len(own):
                        names.append(b[r])
                        sets.append(own)
                        if len(sets) >= 2 * BLOCK:
                            flush()
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
                out.clear()
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return run


def _texts(width: int, nodes: np.ndarray | None, dup_key: np.ndarray, dup_id: np.ndarray):
    """(node, text) of the rows that stand for a set; with nodes, ascending, only for sets among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, known = batch.column("doc_id").to_numpy(zero_copy_only=False), np.zeros(0, np.int64)
            for i, j, buf, offsets in X.text_chunks(batch.column("text"), CHUNK):
                bounds, tokens = X.shingle_sets(buf, offsets, width)
                key, _ = _class_keys(bounds, tokens)
                fresh = _standing(ids[i:j], key, known, dup_key, dup_id) & (np.diff(bounds) > 0)
                known = np.concatenate([known, key[fresh]])
                if nodes is not None:
                    fresh &= nodes[np.minimum(np.searchsorted(nodes, key), len(nodes) - 1)] == key
                at = np.flatnonzero(fresh)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(key[at]), batch.column("text").take(pa.array(at + i))], ["node", "text"])

    return run


class _Search:
    """Searches pairs of sets by their texts."""

    def __init__(self, rows: DataFrame, width: int, percent: int, dup: tuple[np.ndarray, np.ndarray], tables: Tables):
        self.rows, self.width, self.percent, self.dup, self.tables = rows, width, percent, dup, tables

    def texts(self, nodes: DataFrame) -> DataFrame:
        """The texts of the sets (node): the scan leaves out all others where the list of nodes is short, else a join does."""
        if nodes.count() <= BROADCAST_NODES:
            listed = np.sort(nodes.toArrow().column("node").to_numpy())
            if not len(listed):
                return self.rows.sparkSession.createDataFrame([], "node long, text string")
            return self.rows.mapInArrow(_texts(self.width, listed, *self.dup), "node long, text string")
        return self.rows.mapInArrow(_texts(self.width, None, *self.dup), "node long, text string").join(nodes.hint("merge"), "node", "left_semi")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are linked."""
        tables, n = self.tables, partitions(self.rows.sparkSession)
        pairs = tables.save(pairs)
        sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        blocked = tables.save(pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block")))
        queries = blocked.select("a", "block").distinct().select("a", "block", F.lit(0).alias("role"), F.col("a").alias("node"))
        wanted = tables.save(queries.unionByName(blocked.select("a", "block", F.lit(1).alias("role"), F.col("b").alias("node"))))
        texts = self.texts(tables.save(wanted.select("node").distinct()))
        rows = wanted.hint("merge").join(texts, "node").select("a", "block", "role", F.col("node").alias("b"), "text")
        return tables.save(rows.repartition(n, "a", "block").sortWithinPartitions("a", "block", "role").mapInArrow(_search(self.width, self.percent), "a long, b long"))


def _short_lists(rows: DataFrame, total: int, width: int, percent: int, hot: tuple, dup: tuple, tables: Tables) -> DataFrame:
    """The saved entries (token, node, size, pos) of short lists with two sets or more; total: shingles of all sets."""
    buckets = max(partitions(rows.sparkSession), math.ceil(total * (100 - percent) / 100 * 16 / BUCKET_BYTES))
    entries = rows.mapInArrow(_postings(width, percent, buckets, DIRECT_RANK, *hot, *dup), f"bucket int, tokens binary, rows binary, places binary, ids binary, sizes binary, {_SHORT}")
    merged = entries.where("bucket is not null").select("bucket", "tokens", "rows", "places", "ids", "sizes").groupBy("bucket").applyInArrow(_merge, _SHORT)
    if not (hot[1] >= DIRECT_RANK).any():
        return tables.save(merged)
    direct = entries.where("token is not null").select("token", "node", "size", "pos")
    return tables.save(merged.unionByName(direct.distinct()))


def _candidates(short: DataFrame, first: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(a, b): sets of different components that share enough short lists.

    A list of more than LIST entries is dealt over parts, and its queries go to each.
    """
    n = partitions(short.sparkSession)
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    heads = first.hint("merge").join(roots.select(F.col("node").alias("head"), F.col("root").alias("head_root")), first["l.node"] == F.col("head"), "left")
    heads = heads.select("token", F.coalesce("head_root", "l.node").alias("head_root"), F.ceil(F.col("n") / LIST).alias("parts"))
    located = short.join(roots.hint("merge"), "node", "left").select("token", "node", "size", "pos", F.coalesce("root", "node").alias("root"))
    marked = located.hint("merge").join(heads, "token").withColumn("query", F.col("root") != F.col("head_root"))
    dealt = marked.withColumn("part", F.explode(F.when(F.col("query"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(part))))
    lists = dealt.select("token", "part", "node", "size", "pos", "root", "query", (F.col("part") == part).alias("home"))
    found = lists.repartition(n, "token", "part").sortWithinPartitions("token", "part").mapInArrow(_queries(percent), "q long, q_size long, nodes binary, sizes binary, times binary")
    return found.repartition(n, "q").sortWithinPartitions("q").mapInArrow(_enough(percent), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles long, component_id long), a row per row of docs.

    Two documents link when 100 * |intersection| >= percent * |union| of their distinct shingles of width words
    (A-Z lower-cased); component_id is the smallest id that links reach.  Fewer words make one shingle; null, empty
    and blank texts have none and are alone.  Ids are whole numbers.  Rows of one id are one document with several
    sets: each row has the size of its own, and the document links with whatever any of them links with.  A row with
    a null id links nothing; it gets the component of its set if a row with an id has the same, else null.  Other
    columns are left out.  Shingles and sets are known by 64-bit hashes.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    spark = bounded_batches(docs)
    tables = Tables(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seen = tables.save(rows.mapInArrow(_sets(width), "doc_id long, n long, k1 long, k2 long, shingle long, copies long"))
    sets = seen.where("n is not null").select("doc_id", "n", F.col("k1").alias("node"))
    hot = _frequent(seen.where("shingle is not null").groupBy(F.col("shingle").alias("key")).agg(F.sum("copies").alias("n")).where(F.col("n") >= HOT_COUNT), HOT_SHINGLES)
    classes = tables.save(sets.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.max("n").alias("size")))
    dup = _frequent(classes.where("copies > 1").select(F.col("node").alias("key"), F.col("copies").alias("n"), "id"), DUP_SETS)
    total = classes.agg(F.sum("size").alias("n")).first().n or 0
    known = rows.where("doc_id is not null")
    ranks = (1 + np.log2(hot["n"])).astype(np.uint8) if len(hot["n"]) else np.zeros(0, np.uint8)
    short = _short_lists(known, total, width, percent, (hot["key"].view(np.uint64), ranks), (dup["key"], dup["id"]), tables)
    tables.release()
    first = tables.save(short.groupBy("token").agg(F.min(F.struct("pos", "size", "node")).alias("l"), F.count("*").alias("n")))
    met = short.hint("merge").join(first, "token").where(_offered(percent)).groupBy("node", F.col("l.node").alias("first")).count()
    best = met.groupBy("node").agg(F.max(F.struct("count", (-F.col("first")).alias("first"))).alias("top")).select((-F.col("top.first")).alias("a"), F.col("node").alias("b"))
    search = _Search(known, width, percent, (dup["key"], dup["id"]), tables)
    links = search.linked(best)
    tables.release()
    roots = components(links, tables)
    later = search.linked(_candidates(short, first, roots, percent))
    tables.release()

    several = sets.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("top")).where("a <> top")
    same_id = sets.join(several, "doc_id").where("n > 0 and node <> a").select("a", F.col("node").alias("b"))
    edges = links.unionByName(later).unionByName(same_id)
    joined = classes.join(tables.save(components(edges, tables)), "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("id").alias("component"))
    of_class = tables.save(joined.join(lowest, "root").select("node", "component"))
    full = sets.where("n > 0").join(of_class, "node", "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    out = full.unionByName(sets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component")))
    kept = Tables(spark).save(out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")))
    tables.drop()
    return kept


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text, ...) with one document of each component, that with the smallest id; columns stay.

    Rows of one id stay or go together, so repeated rows of the kept one stay; rows with a null id stay.
    """
    found = near_duplicates(docs, width, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(Tables(docs.sparkSession).save(found), "doc_id", "left_anti").select(*docs.columns)
