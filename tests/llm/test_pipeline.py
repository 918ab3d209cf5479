import inspect
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from test_operators import brute_components, brute_measures, words

from meshlark.llm import packing
from meshlark.llm.queries import tokenizer_file

from support import DATA  # isort: skip


def test_stages_keep_columns_and_order(spark, docs):
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, DATA)
        assert out.columns == docs.columns, name
        before, after = {r[0] for r in frame.select("doc_id").collect()}, {r[0] for r in out.select("doc_id").collect()}
        assert after <= before, name
        frame = out
    packed = corpus_pipeline.run(spark, DATA)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == after


@pytest.mark.parametrize("k", range(5))
def test_empty_tables(spark, no_docs, k):
    assert corpus_pipeline.STAGES[k][1](spark, no_docs, DATA).count() == 0


def test_stages_take_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows, ties and columns whose names clash."""
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    rows = [(1, text, "en", "s1", 10), (1, text, "en", "s1", 10), (2, text + " more", None, None, None), (None, text, None, "s2", None), (None, None, None, None, None), (3, "", "en", "s1", 0), (4, None, "en", "s1", None), (5, (text[::-1] + " ") * 3000, "en", "s3", 1)]
    names = ("_row", "_text", "_id", "n_removed", "component_id", "fail_bits")
    frame = spark.createDataFrame([(*r, *range(6)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, DATA)
        assert out.columns == frame.columns, name
        kept[name] = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
    usual = [(False, 1), (False, 1), (False, 2)]
    assert kept["quality_rules"] == [*usual, (True, 0)]  # the long text repeats itself
    assert kept["line_dedup"] == kept["decontamination"] == [*usual, (False, 3), (False, 4), (False, 5), (True, 0), (True, 0)]
    assert kept["ngram_join"] == [(False, 1), (False, 1), (False, 3), (False, 4), (False, 5), (True, 0), (True, 0)]
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, DATA).collect()
    assert sum(r.piece == 0 for r in packed) == len(rows) and len({r.ids_crc32 for r in packed if r.doc_id == 1}) == 1


def brute_quality(text):
    w = words(text)
    chars, letters = sum(map(len, w)), sum(bool(re.match("[A-Za-z]", c)) or ord(c) > 127 for c in text or "")
    n, _, symbols, dup_lines, repeats = brute_measures(text)
    lines = sum(bool(words(x)) for x in (text or "").split("\n"))
    bad = n < 50, 2 * repeats > n, 10 * symbols > n, 2 * dup_lines > lines, chars < 2 * n, chars > 20 * n, 10 * letters < 6 * chars, 20 * len(set(w)) < min(n, 2000)
    return not any(bad)


def brute_lines(rows):
    sites, texts = {}, {}
    for _, t, s in rows:
        texts.setdefault(t, set()).add(s)
        for x in (t or "").split("\n"):
            if words(x):
                sites.setdefault(x, set()).add(s)
    out = []
    for i, t, s in rows:
        lines = t.split("\n")
        gone = [x for x in lines if len(sites.get(x, ())) >= 10]
        if not (2 * sum(len(x.encode()) for x in gone) > len(t.encode()) and len(texts[t]) > 1):
            t = "\n".join(x for x in lines if len(sites.get(x, ())) < 10)
        out.append((i, t, s))
    return out


def brute_holds(text, item):
    """Whether a part of the text is within a quarter of the item's words."""
    a, b = ([x for x in re.split("[^a-z0-9]+", t.lower()) if x] for t in (item, text))
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return len(a) >= 6 and min(row) <= len(a) // 4


def test_run_equals_plain_python(spark, tmp_path):
    import tokenizers

    rng = random.Random(12)
    pick = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n)]
    items = [" ".join(pick(n)) for n in (12, 20, 40)]
    body = [pick(rng.randint(60, 140)) for _ in range(90)]
    rows = []
    for i, w in enumerate(body):
        if i % 9 == 1:
            w = [x + " |" if k % 3 == 0 else x for k, x in enumerate(w)]  # symbols
        elif i % 9 == 2:
            w = w[:20]  # short
        elif i % 9 == 3:
            w = list(body[i - 3])  # near copy of a document that stays
            w[7] = "changed"
        elif i % 9 == 4:
            own = items[i % 3].split()
            for k in rng.sample(range(len(own)), len(own) // 4):
                own[k] = rng.choice(["", "Other,"])
            w = w[:30] + own + w[30:]  # leak at the limit
        text = " ".join(w)
        rows.append((i, text + ("\naccept all of our cookies here" if i % 2 else ""), f"s{i % 20}"))
    rows.append((200, " ".join(pick(4)) + "\n" + "\n".join(" ".join(x) for x in [pick(60)]), "s1"))
    spread = " ".join(pick(60))
    rows += [(300 + k, f"{' '.join(pick(52))}\n{spread}", f"s{k}") for k in range(12)]
    rows.append((400, f"{' '.join(pick(9))}\n{spread}", "s1"))  # mostly a spread line, no copy
    copied = f"{' '.join(pick(9))}\n{spread}"
    rows += [(401, copied, "s1"), (402, copied, "s2")]
    frame = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [r for r in rows if brute_quality(r[1])]
    assert 0 < len(left) < len(rows)
    left = brute_lines(left)
    groups = brute_components([(i, t) for i, t, _ in left])
    single = [r for r in left if groups[r[0]][1] == r[0]]
    clean = [r for r in single if not any(brute_holds(r[1], x) for x in items)]
    assert len(left) > len(single) > len(clean)
    tokenizer = tokenizers.Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    size, want = inspect.signature(packing.pack).parameters["capacity"].default, []
    for i, t, _ in clean:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, size * k, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(ids[at : at + size] for at in range(0, len(ids), size))]
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(want)
