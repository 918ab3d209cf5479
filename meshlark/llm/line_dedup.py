"""Cross-site boilerplate removal by the spread of lines over sites.

A HyperLogLog sketch of sites per line hash is built by aggregation, so a line on any
number of pages costs one sketch per task.  Lines whose estimate is near the threshold
get an exact distinct count.  A document that is found word for word on two sites or
more, and most of whose bytes are spread lines, is a copied document rather than a page
with boilerplate; its lines are spread by its own copies, so it is left whole, for the
near-duplicate operators to judge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._shared import Tables, bounded_batches

LG_K = 10
#: Estimates within this share of the threshold are counted exactly; over six standard errors (1.04/sqrt(2**10)).
NEAR = 0.2
#: Up to so many spread lines their hashes (8 bytes each) are sent to all tasks; beyond it they are joined.
BROADCAST_LINES = 2_000_000


def _hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """lo, hi, row, hash and has-a-word of every line."""
    lo, hi, rows = X.line_spans(buf, offsets)
    solid = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(~X.BLANK[buf], out=solid[1:])
    return lo, hi, rows, X.hash_spans(X.prefix_hash(buf), lo, hi).view(np.int64), solid[hi] > solid[lo]


def _line_sites(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (line, site) of each batch."""
    for batch in batches:
        sites = batch.column("site").to_numpy(zero_copy_only=False).astype(np.int64)
        found = []
        for i, _, buf, offsets in X.text_chunks(batch.column("text")):
            _, _, rows, lines, has = _hashes(buf, offsets)
            found.append(np.stack([lines[has], sites[i + rows[has]]], 1))
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["line", "site"])


def spread_lines(docs: DataFrame, min_sites: int, tables: Tables, site_col: str = "source", text_col: str = "text") -> DataFrame:
    """(line long) hashes of lines with a word that are on min_sites distinct sites or more.  A null site is a site."""
    rows = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(site_col).cast("string"), F.lit("\x00"))).alias("site"))
    pairs = tables.save(rows.mapInArrow(_line_sites, "line long, site long"))
    sketched = pairs.groupBy("line").agg(F.count("*").alias("most"), F.hll_sketch_agg("site", LG_K).alias("sketch")).where(F.col("most") >= min_sites)
    estimated = tables.save(sketched.select("line", F.hll_sketch_estimate("sketch").alias("sites")))
    lo, hi = int(min_sites * (1 - NEAR)) - 1, int(min_sites * (1 + NEAR)) + 1
    clear = estimated.where(F.col("sites") > hi).select("line")
    near = estimated.where(F.col("sites").between(lo, hi)).select("line")
    exact = pairs.join(near, "line", "left_semi").groupBy("line").agg(F.countDistinct("site").alias("n")).where(F.col("n") >= min_sites)
    return tables.save(clear.unionByName(exact.select("line")))


def _strip(text: bytes, spans: list[tuple[int, int]], bad: list[bool]) -> tuple[bytes, int]:
    return b"\n".join(text[lo:hi] for (lo, hi), b in zip(spans, bad, strict=True) if not b), sum(bad)


def _remover(known: np.ndarray | None, max_share: float):
    """mapInArrow function on (_row, text) or, without known hashes, (_row, text, bad array<long>).

    Texts with more than max_share of spread lines are marked as over; those that a column copied (boolean) names
    stay whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines_of, removed = batch.column("text").to_pylist(), [], []
            bad_column = None if known is not None else batch.column("bad")
            copied = batch.column("copied").to_pylist() if "copied" in batch.schema.names else [True] * batch.num_rows
            over_of = []
            for i, j, buf, offsets in X.text_chunks(batch.column("text")):
                lo, hi, rows, lines, has = _hashes(buf, offsets)
                if known is not None:
                    at = np.minimum(np.searchsorted(known, lines), max(len(known) - 1, 0))
                    bad = has & (known[at] == lines) if len(known) else np.zeros(len(lines), bool)
                else:
                    bad = np.zeros(len(lines), bool)
                    for r in range(j - i):
                        own = bad_column[i + r].as_py()
                        if own:
                            mine = rows == r
                            bad[mine] = has[mine] & np.isin(lines[mine], own)
                cuts = np.searchsorted(rows, np.arange(j - i + 1))
                touched = np.unique(rows[bad])
                lines_of.append(np.diff(cuts))
                count, over = np.zeros(j - i, np.int64), np.zeros(j - i, bool)
                for r in touched.tolist():
                    part = slice(cuts[r], cuts[r + 1])
                    spans = list(zip((lo[part] - offsets[r]).tolist(), (hi[part] - offsets[r]).tolist(), strict=True))
                    text = texts[i + r].encode()
                    over[r] = (hi[part] - lo[part])[bad[part]].sum() > max_share * len(text)
                    if not over[r] or not copied[i + r]:
                        text, count[r] = _strip(text, spans, bad[part].tolist())
                        texts[i + r] = text.decode()
                removed.append(count)
                over_of.append(over)
            if lines_of:
                columns = [batch.column("_row"), pa.array(texts, pa.string()), pa.array(np.concatenate(lines_of), pa.int64()), pa.array(np.concatenate(removed), pa.int64()), pa.array(np.concatenate(over_of))]
                yield pa.RecordBatch.from_arrays(columns, ["_row", "text", "n_lines", "n_removed", "over"])

    return run


def remove_spread_lines(docs: DataFrame, min_sites: int = 10, max_share: float = 0.5, site_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with the text rid of spread lines, and n_lines, n_removed (long) after the other columns.

    A line is spread if it has a word and is on min_sites distinct sites or more.  Texts of which spread lines are
    more than max_share of the bytes and that equal a text of another site stay whole (n_removed 0), as do null
    texts; an empty text has one empty line.  Repeated rows are treated each; ids are not looked at.  Extra columns
    are kept; ones named n_lines or n_removed are replaced.
    """
    spark = bounded_batches(docs)
    tables = Tables(spark)
    lines = spread_lines(docs, min_sites, tables, site_col, text_col)
    keep = [c for c in docs.columns if c not in (text_col, "n_lines", "n_removed")]
    held = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col(text_col).alias("text"))
    kind = held.schema["_row"].dataType.simpleString()
    known = np.sort(lines.toPandas()["line"].to_numpy(np.int64)) if lines.count() <= BROADCAST_LINES else None

    def strip(rows: DataFrame, kind: str) -> DataFrame:
        out = f"_row {kind}, text string, n_lines long, n_removed long, over boolean"
        return _joined(rows, lines, max_share, out) if known is None else rows.mapInArrow(_remover(known, max_share), out)

    # a first pass lists the texts above max_share by hash, a second one strips those that no other site has
    asked = docs.select(F.struct(F.xxhash64(text_col).alias("key"), F.xxhash64(F.coalesce(F.col(site_col).cast("string"), F.lit("\x00"))).alias("site")).alias("_row"), F.col(text_col).alias("text"))
    over = strip(asked, asked.schema["_row"].dataType.simpleString()).where("over").select("_row.key", "_row.site")
    copies = tables.save(over.groupBy("key").agg(F.min("site").alias("a"), F.max("site").alias("b")).where("a <> b").select(F.col("key").alias("_key"), F.lit(True).alias("_copied")))
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_LINES else copies
    marked = held.join(copies, F.xxhash64(held["text"]) == copies["_key"], "left")
    held = marked.select("_row", "text", F.coalesce("_copied", F.lit(False)).alias("copied"))
    clean = strip(held, kind)
    order = [F.col(f"_row.`{c}`") if c in keep else F.col("text").alias(text_col) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return clean.select(*order, "n_lines", "n_removed")


def _joined(held: DataFrame, lines: DataFrame, max_share: float, out: str) -> DataFrame:
    """The way beyond BROADCAST_LINES: the spread lines of each distinct text are joined to it by a hash of the text."""

    def own_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for i, _, buf, offsets in X.text_chunks(batch.column("text")):
                _, _, rows, hashes, has = _hashes(buf, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(keys[i + rows[has]]), pa.array(hashes[has])], ["key", "line"])

    keyed = held.withColumn("key", F.xxhash64("text"))
    pairs = keyed.select("key", "text").mapInArrow(own_lines, "key long, line long").distinct()
    bad = pairs.join(lines, "line", "left_semi").groupBy("key").agg(F.collect_set("line").alias("bad"))
    return keyed.join(bad, "key", "left").drop("key").mapInArrow(_remover(None, max_share), out)
