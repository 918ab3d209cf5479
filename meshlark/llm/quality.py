"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the failure bits and the
measurements; policies (a version and a set of rules) are applied to the stored bits
later, and ablations are bitwise aggregates over the ledger, so no text is read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._shared import Tables, bounded_batches

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_distinct_words")
REPEAT_WINDOW = 3


def _per_mille(part: str, most: int, whole: str) -> Column:
    return F.col(part) * 1000 > F.col(whole) * most


#: Rule name -> failure condition over the measurements; the bit of a rule is its place. Append only.
RULES: dict[str, Column | None] = dict.fromkeys(
    ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words", "few_letters", "few_distinct_words", "many_symbols")
)


def rule_columns() -> dict[str, Column]:
    """Failure conditions; integers only, so they are exact."""
    out = {
        "few_words": F.col("n_words") < 50,
        "repeated_windows": F.col("n_repeat_words") * 100 > F.col("n_words") * 50,
        "symbols": _per_mille("n_symbols", 800, "n_words"),
        "duplicate_lines": _per_mille("n_dup_lines", 500, "n_lines"),
        "short_words": F.col("word_chars") < F.col("n_words") * 2,
        "long_words": F.col("word_chars") > F.col("n_words") * 20,
        "few_letters": F.col("n_letters") * 10 < F.col("word_chars") * 6,
        "few_distinct_words": F.col("n_distinct_words") * 20 < F.least(F.col("n_words"), F.lit(2000)),
        "many_symbols": _per_mille("n_symbols", 100, "n_words"),
    }
    assert list(out) == list(RULES)
    return out


@dataclass(frozen=True)
class Policy:
    """A named version: a document is rejected if any of its rules failed."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
STRICT = Policy("strict-1", tuple(RULES)[:8])
#: Texts with more than 0.1 symbols a word, such as rows of words split by |, are rejected as well.
STRICT_2 = Policy("strict-2", tuple(RULES))


def measure_chunk(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """MEASURES of each text of a chunk."""
    n = len(offsets) - 1
    starts, ends, rows = X.word_spans(buf, offsets)
    prefix = X.prefix_hash(buf)
    words = X.hash_spans(prefix, starts, ends)
    out = {"n_words": np.bincount(rows, minlength=n)}
    lead = (buf & 0xC0) != 0x80
    out["word_chars"] = X.segment_sums(lead & ~X.BLANK[buf], offsets)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    out["n_symbols"] = X.segment_sums(symbol[buf], offsets)
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = True
    letter[0xC0:] = True  # the first byte of a longer character
    out["n_letters"] = X.segment_sums(letter[buf], offsets)
    per_row = rows.astype(X.U64) * X.U64(0x9E3779B97F4A7C15)
    ordered = np.lexsort((words, rows))
    fresh = np.ones(len(words), bool)
    w, r = words[ordered], rows[ordered]
    fresh[1:] = (w[1:] != w[:-1]) | (r[1:] != r[:-1])
    out["n_distinct_words"] = np.bincount(r[fresh], minlength=n)
    windows = X.window_hash(words, REPEAT_WINDOW)
    covered = np.zeros(len(words), bool)
    if len(windows):
        inside = rows[: len(windows)] == rows[REPEAT_WINDOW - 1 :]
        keys = X.mix64(windows + per_row[: len(windows)])
        ranked = np.sort(keys[inside])
        twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        if len(twice):
            at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
            hit = inside & (twice[at] == keys)
            for k in range(REPEAT_WINDOW):
                covered[k : k + len(windows)] |= hit
    out["n_repeat_words"] = np.bincount(rows[covered], minlength=n)
    lo, hi, line_rows = X.line_spans(buf, offsets)
    first_word = np.searchsorted(starts, lo, "left")
    has = (first_word < len(starts)) & (np.append(starts, len(buf) + 1)[first_word] < hi)
    lo, hi, line_rows = lo[has], hi[has], line_rows[has]
    lines = X.hash_spans(prefix, lo, hi)
    order = np.lexsort((lines, line_rows))
    h, r = lines[order], line_rows[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    out["n_dup_lines"] = np.bincount(r[again], minlength=n)
    out["n_lines"] = np.bincount(line_rows, minlength=n)
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [measure_chunk(buf, offsets) for _, _, buf, offsets in X.text_chunks(batch.column("_text"))]
        columns = [batch.column("_id")] + [
            pa.array(np.concatenate([p[m] for p in parts]) if parts else np.zeros(0), pa.int64()) for m in MEASURES
        ]
        yield pa.RecordBatch.from_arrays(columns, ["_id", *MEASURES])


def fail_bits() -> Column:
    """The bits of the failed rules, from the measurements."""
    bits = [F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(rule_columns().values())]
    return reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tables: Tables | None = None) -> DataFrame:
    """One row per document: the id, fail_bits long and MEASURES (long).

    With tables the ledger is written there, so that policies and ablations read it and no text again; without, it is
    a plan, for a caller that uses it once.  Null or empty text measures 0 everywhere; repeated rows each get a row;
    other columns are not carried.
    """
    bounded_batches(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    measured = rows.mapInArrow(_measure, f"_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    book = measured.select(F.col("_id").alias(id_col), fail_bits().alias("fail_bits"), *MEASURES)
    return book if tables is None else tables.save(book)


def apply_policy(book: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with policy string and kept boolean."""
    return book.withColumns(
        {"policy": F.lit(policy.version), "kept": F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0}
    )


def ablation(book: DataFrame, policy: Policy) -> DataFrame:
    """(rule, failed, only_this, rejected_without): one aggregate pass over the bits.

    rejected_without counts the rejected documents once the rule is taken out of the policy.
    An empty ledger gives zeros.
    """
    mask = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    sums = [F.count(F.when(mask != 0, 1)).alias("rejected")]
    for r in policy.rules:
        bit = 1 << list(RULES).index(r)
        sums.append(
            F.struct(
                F.lit(r).alias("rule"),
                F.count(F.when(mask.bitwiseAND(F.lit(bit)) != 0, 1)).alias("failed"),
                F.count(F.when(mask == bit, 1)).alias("only_this"),
            ).alias(r)
        )
    one = book.agg(*sums)
    return one.select("rejected", F.explode(F.array(*policy.rules)).alias("x")).select(
        "x.rule", "x.failed", "x.only_this", (F.col("rejected") - F.col("x.only_this")).alias("rejected_without")
    )


def filter_documents(docs: DataFrame, policy: Policy = STRICT_2) -> DataFrame:
    """The documents that the policy keeps, with all their columns, and no shuffle.

    Each row travels with its own ledger entry: the rules are evaluated once into fail_bits, and the policy is
    applied to the bits.  Null and empty texts have no words and are judged as such; repeated rows are judged each;
    rows with a null id are kept or not like any other; columns of any name stay as they are.
    """
    bounded_batches(docs)
    held = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))
    kind = held.schema["_row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure_chunk(buf, offsets) for _, _, buf, offsets in X.text_chunks(batch.column("_text"))]
            columns = [batch.column("_row")] + [pa.array(np.concatenate([p[m] for p in parts]), pa.int64()) for m in MEASURES] if parts else []
            if columns:
                yield pa.RecordBatch.from_arrays(columns, ["_row", *MEASURES])

    measured = held.mapInArrow(run, f"_row {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    book = measured.select("_row", fail_bits().alias("fail_bits"))
    return apply_policy(book, policy).where("kept").select(*[F.col(f"_row.`{c}`") for c in docs.columns])
