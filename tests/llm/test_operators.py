"""Each operator against a brute-force version, and on edge cases."""

import datetime
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from meshlark.llm import decontam, line_dedup, lm, ngram_join, packing, pii, quality, suffix_dedup, token_codec, warc
from meshlark.llm import _text as X
from meshlark.llm._shared import Tables, components
from meshlark.llm.queries import OP7_SQL, OP10_SQL, queries, tokenizer_file
from meshlark.llm.tokens import Encoder

from support import DATA, same_rows  # isort: skip

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def collect(df):
    return [tuple(r) for r in df.collect()]


# components


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500, 500 + k) for k in range(1, 80)] + [(k, k + 1) for k in range(700, 760)]
    up = {v: v for e in edges for v in e}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = dict(collect(components(spark.createDataFrame(edges, "a long, b long"), Tables(spark))))
    assert got == {v: find(v) for a, b in edges if a != b for v in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long"), Tables(spark)).count() == 0


# 1


def brute_components(rows, percent=80):
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(LOW))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    lists, up = {}, {i: i for i in sets}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for i in sorted(sets):
        shared = Counter(o for x in sets[i] for o in lists.get(x, ()))
        for o, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[o]) - n):
                a, b = sorted((find(i), find(o)))
                up[b] = a
        for x in sets[i]:
            lists.setdefault(x, []).append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(rng):
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[rng.choice(vocabulary)], [], [w[k], rng.choice(vocabulary)]])
                w = w or ["w0"]
            if rng.random() < 0.3:
                w += passage
            rows.append((rng.randrange(10**9), " ".join(w).title()))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    rows = near_copies(random.Random(seed))
    got = {i: (n, c) for i, n, c in collect(ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))}
    assert got == brute_components(rows)


def test_join_edges(spark, edge_docs, no_docs):
    rows = collect(edge_docs.select("doc_id", "text").distinct())
    got = collect(ngram_join.near_duplicates(edge_docs))
    assert len(got) == edge_docs.count() and {i: (n, c) for i, n, c in got} == brute_components(rows)
    assert ngram_join.near_duplicates(no_docs).count() == 0
    assert ngram_join.keep_first(edge_docs).columns == edge_docs.columns


@pytest.mark.parametrize("limits", [{"BROADCAST_NODES": 0, "LIST": 3, "BLOCK": 2}, {"DIRECT_RANK": 1, "HOT_COUNT": 2, "DUP_SETS": 0, "BUCKET_BYTES": 64}])
def test_join_gives_the_same_at_any_limits(spark, monkeypatch, limits):
    rows = near_copies(random.Random(3))
    rows += [(10**9 + k, t) for k, (_, t) in enumerate(rows[:40])]
    for name, value in limits.items():
        monkeypatch.setattr(ngram_join, name, value)
    got = {i: (n, c) for i, n, c in collect(ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))}
    assert got == brute_components(rows)


def test_join_of_rows_with_one_id_and_without(spark):
    w, v, x = (" ".join(f"{c}{k}" for k in range(30)) for c in "wvx")
    rows = [(1, w), (1, v), (2, w + " end"), (3, v + " end"), (None, v), (None, x), (5, ""), (None, ""), (6, x + " y"), (6, x + " y")]
    got = sorted(collect(ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))), key=str)
    assert got == sorted([(1, 26, 1), (1, 26, 1), (2, 27, 1), (3, 27, 1), (None, 26, 1), (None, 26, None), (5, 0, 5), (None, 0, None), (6, 27, 6), (6, 27, 6)], key=str)


def test_divide_skip():
    rng = random.Random(1)
    for _ in range(500):
        lists = [sorted(rng.sample(range(20), rng.randint(0, 15))) for _ in range(rng.randint(1, 12))]
        t, count = rng.randint(1, 8), Counter(x for one in lists for x in one)
        assert ngram_join.divide_skip(lists, t) == {x: n for x, n in count.items() if n >= t}


# 2 and 9


@pytest.fixture(scope="module")
def tokenizers():
    from tokenizers import Tokenizer

    out = {}
    for kind, name in (("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")):
        t = Tokenizer.from_file(tokenizer_file(name))
        t.encode_special_tokens = True
        out[kind] = t
    return out


ODD = [" a  b\n\nc \n d  e f\né x\n", "don't  stop<|endoftext|> x's\r\n\ty", " é\n“q” 　z", "é ́x AİB", "\x1fa \x85b", "naïve—café … ’s", "﻿x  \n", "a\x00b\x7fc d"]


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_encoder_equals_the_library(tokenizers, kind, docs):
    enc = Encoder(tokenizer_file({"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}[kind]), kind)
    texts = ODD + ["", *[r.text for r in docs.select("text").collect()]]
    for i, j, buf, offsets in X.text_chunks(pa.array(texts)):
        ids, bounds = enc.encode(buf, offsets)
        for r in range(i, j):
            assert ids[bounds[r - i] : bounds[r - i + 1]].tolist() == tokenizers[kind].encode(texts[r], add_special_tokens=False).ids, texts[r][:80]


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_encoder_equals_the_library_on_words_with_marks(tokenizers, kind):
    rng = random.Random(10)
    enc = Encoder(tokenizer_file({"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}[kind]), kind)
    parts = ["a", "Word", "\u00e9", "\u00c8", "\u00dfa", "\u00d7", "\u00f7", "\u00ff", "\u00b5", "\u00c3", "\u0130", "1", "'", "'s", "!", "###", "%%", "_", "<|", "=", "\u0338", "\u0301", " ", " ", " ", "\n", "\t", "\u4e1c"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(6000)] + ["end" + "!" * n for n in range(1, 30)] + ["!" * n for n in range(1, 12)]
    for i, j, buf, offsets in X.text_chunks(pa.array(texts)):
        ids, bounds = enc.encode(buf, offsets)
        for r in range(i, j):
            assert ids[bounds[r - i] : bounds[r - i + 1]].tolist() == tokenizers[kind].encode(texts[r], add_special_tokens=False).ids, texts[r]
    one = Encoder(tokenizer_file("byte_bpe_50k.json"), "byte")
    text = "".join(f" {w}{m}" for w in ("onreti", "desion", "thhe") for m in ("###", "!!", "%%%")).encode()
    one.encode(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert len(one.keys) == 6  # a word is encoded once, whatever marks are behind


def test_codec_of_wide_vocabularies_and_many_groups(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(token_codec, "LANES", 3)
    for tokens in (rng.integers(0, 1 << 17, 40_000), np.arange(1 << 17), np.full(9000, (1 << 17) - 1), np.tile([0, 0, 1], 5000), rng.zipf(1.1, 30_000).clip(0, (1 << 17) - 1)):
        data = token_codec.to_bytes(np.array([1]), np.array([len(tokens)]), tokens.astype(np.uint32), 1 << 17)
        assert (token_codec.from_bytes(data)[2] == tokens).all()
    tokens = rng.choice(rng.integers(0, 50257, 4000), 60_000).astype(np.uint32)  # 12 bits an id, and 8 KB for which these are
    assert len(token_codec.to_bytes(np.array([1]), np.array([60_000]), tokens, 50257)) < 60_000 * 12.5 / 8 + 10_000


def test_codec_round_trip_and_damage():
    rng = np.random.default_rng(3)
    cases = [np.zeros(0, np.uint32), np.array([0], np.uint32), rng.integers(0, 50257, 9000).astype(np.uint32), np.tile(rng.integers(0, 300, 77), 200).astype(np.uint32), np.full(12289, 50256, np.uint32), rng.zipf(1.3, 20000).clip(0, 50256).astype(np.uint32)]
    for tokens in cases:
        ids, lengths = np.array([-5, 7]), np.array([len(tokens) // 2, len(tokens) - len(tokens) // 2])
        data = token_codec.to_bytes(ids, lengths, tokens, 50257)
        a, b, c = token_codec.from_bytes(data)
        assert a.tolist() == ids.tolist() and b.tolist() == lengths.tolist() and (c == tokens).all()
        if len(tokens) > 1000:
            with pytest.raises(ValueError):
                token_codec.from_bytes(data[:-5] + bytes([data[-5] ^ 1]) + data[-4:])
    data = token_codec.to_bytes(np.array([0, 3, 0]), np.array([1, 1, 1]), np.array([7, 8, 9], np.uint32), 50257, np.array([True, False, False]))
    assert token_codec.parse(data)[3].tolist() == [True, False, False]
    assert len(token_codec.to_bytes(np.array([1]), np.array([15400]), cases[3], 50257)) < 15400 // 2
    with pytest.raises(ValueError):
        token_codec.to_bytes(np.array([1]), np.array([1]), np.array([50257], np.uint32), 50257)


def test_token_files_equal_brute_force(spark, tokenizers, docs, edge_docs, no_docs):
    for frame in (docs, edge_docs, no_docs):
        tables = Tables(spark)
        files = token_codec.write_token_files(frame, f"{tables.root}/t", tokenizer_file("byte_bpe_50k.json"), "byte", 2, 50257, tables)
        got = sorted(collect(token_codec.read_token_files(files).drop("ids")))
        want, start = [], 0
        for i, t in sorted(collect(frame.select("doc_id", F.coalesce("text", F.lit(""))))):
            ids = [*tokenizers["byte"].encode(t, add_special_tokens=False).ids, 2]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert got == want


def test_token_files_of_null_and_repeated_ids(spark, tokenizers, monkeypatch):
    rows = [(None, "b c"), (7, "z"), (7, "a a"), (None, None), (2, "x" * 9000), (-4, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash"))
    monkeypatch.setattr(token_codec, "NUMBERED", 1)
    tables = Tables(spark)
    files = token_codec.write_token_files(frame, f"{tables.root}/t", tokenizer_file("byte_bpe_50k.json"), "byte", 2, 50257, tables)
    got = sorted(((r.start, r.doc_id, r.n_tokens) for r in token_codec.read_token_files(files).collect()))
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        n = len(tokenizers["byte"].encode(t or "", add_special_tokens=False).ids) + 1
        want.append((start, i, n))
        start += n
    assert got == want


def test_open_bins_of_many_partitions_are_packed_together(spark, no_docs):
    frame = spark.range(64).select(F.col("id").alias("doc_id"), F.lit("seven words are in this short text").alias("text")).repartition(64)
    got = packing.pack(frame, tokenizer_file("word_bpe_49k.json"), "word", 0, with_ids=True).collect()
    total = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) == -(-total // 2048) and sorted(r.offset for r in got) == [k * got[0].length for k in range(64)]
    assert len({r.ids for r in got}) == 1 and len(got[0].ids) == 4 * got[0].length


def test_packing_equals_brute_force(spark, tokenizers, docs, edge_docs, no_docs):
    for frame in (docs, edge_docs):
        got = collect(packing.pack(frame, tokenizer_file("word_bpe_49k.json"), "word", 0, capacity=512))
        want = []
        for i, t in collect(frame.select("doc_id", F.coalesce("text", F.lit("")))):
            ids = np.array([*tokenizers["word"].encode(t, add_special_tokens=False).ids, 0], "<u4")
            want += [(i, k, 512 * k, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(ids[at : at + 512] for at in range(0, len(ids), 512))]
        assert sorted(r[:5] for r in got) == sorted(want)
        bins = {}
        for r in got:
            bins.setdefault(r[5], []).append((r[6], r[3]))
        for pieces in bins.values():
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            assert at <= 512
        assert len(bins) <= 1.15 * sum(r[3] for r in got) / 512 + 8
    assert packing.pack(no_docs, tokenizer_file("word_bpe_49k.json"), "word", 0).count() == 0


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 3, 5, 4, 5)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6), (2, 5)]
    fit = packing.BestFit(10, 2)
    assert [fit.place(n)[0] for n in (6, 7, 8, 2, 3)] == [0, 1, 2, 2, 0] and fit.n_open <= 2
    with pytest.raises(ValueError):
        fit.place(11)


# 3


def test_pseudonyms(spark):
    texts = ["x bosbt.42@mail8.example.com y bosbt.42@mail8.example.com", "+1 (988) 555-2485 a 4041894974608795 b 4041-8949-7460-8795 1234567812345678", "42.144.35.254, 300.1.1.1 1.2.3.4.5", "2020-02-29 2020-02-30 29.02.2020", "123-45-6789 000-12-1234", None, "", "no numbers", "A@b.co"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = {r.doc_id: r for r in pii.pseudonymise(frame, "k").collect()}
    other = {r.doc_id: r for r in pii.pseudonymise(frame, "another").collect()}
    a, b = out[0].text.split()[1], out[0].text.split()[3]
    assert a == b != "bosbt.42@mail8.example.com" and re.fullmatch(r"[a-z0-9]{5}\.[a-z0-9]{2}@mail8\.example\.com", a)
    phone, cards = re.match(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", out[1].text)[0], re.findall(r"4\d{15}|4\d{3}-\d{4}-\d{4}-\d{4}", out[1].text)
    assert phone != "+1 (988) 555-2485" and cards[0] == cards[1].replace("-", "") != "4041894974608795" and out[1].text.endswith("1234567812345678")
    digits = [int(c) for c in cards[0]]
    assert sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0
    ip = out[2].text.split(",")[0]
    assert ip != "42.144.35.254" and all(0 <= int(x) < 256 for x in ip.split(".")) and out[2].text.endswith("300.1.1.1 1.2.3.4.5")
    iso, bad, de = out[3].text.split()
    assert bad == "2020-02-30" and iso.split("-") == de.split(".")[::-1] and iso != "2020-02-29"
    assert out[4].text.endswith("000-12-1234") and not out[4].text.startswith("123-45-6789")
    assert out[5].text is None and out[5].found == [] and out[6].text == "" and out[7].text == "no numbers"
    assert [f.kind for f in out[1].found] == ["phone", "card", "card"] and other[1].text != out[1].text
    assert pii.pseudonymise(frame.limit(0), "k").count() == 0


def test_numbers_and_dates_beyond_the_usual_range_are_masked(spark):
    rng = random.Random(3)
    phones = [f"+1 ({a}) {e}-{n}" for a, e, n in (("068", "555", "2748"), ("168", "155", "0000"), ("988", "055", "2485"), ("000", "000", "0000"), ("234", "567", "8901"))]
    dates = ["1899-12-31", "0001-01-01", "9999-12-31", "2099-08-06", "31.12.1850", "05/06/1750", "12/31/1999", "02/29/2024", "02/29/1600", "02/29/2400", "01/13/0001", "12/31/9999", "10/31/1850"]
    many = [f"{rng.randint(1, 12):02}/{rng.randint(13, 28)}/{rng.randint(1, 9999):04}" for _ in range(300)] + [f"02/29/{y}" for y in range(1904, 2100, 4)] + [f"({rng.randint(0, 199):03}) {rng.randint(0, 999):03}-{rng.randint(0, 9999):04}" for _ in range(300)]
    values = phones + dates + sorted(set(many))
    stay = ["13/13/1999", "02/29/2023", "02/30/2024", "12/31/0000"]
    frame = spark.createDataFrame(list(enumerate(values + stay)), "doc_id int, text string")
    out = {r.doc_id: r.text for r in pii.pseudonymise(frame, "k").collect()}
    new = [out[k] for k in range(len(values))]
    assert [out[len(values) + k] for k in range(len(stay))] == stay
    assert sum(a == b for a, b in zip(values, new, strict=True)) <= 3  # a permutation may have fixed points, 29 February of 49 years
    assert all(a != b for a, b in zip(phones + dates, new, strict=False)) and len(set(new)) == len(set(values))
    assert all(re.sub("[0-9]", "9", a) == re.sub("[0-9]", "9", b) for a, b in zip(values, new, strict=True))
    for old, b in zip(values, new, strict=True):
        if re.fullmatch(r"\d\d/(1[3-9]|[23]\d)/\d{4}", old):
            month, day, year = map(int, b.split("/"))
            assert day > 12 and datetime.date(year, month, day) and (1900 <= year <= 2099) == (1900 <= int(old[6:]) <= 2099)
        elif "-" in old[4:5] or "." in old[2:3]:
            datetime.date(*(map(int, b.split("-") if "-" in b else reversed(b.split(".")))))


def plain_feistel(a, b, size_a, size_b, tweak, key):
    for i in range(pii.ROUNDS):
        half = b if i % 2 == 0 else a
        n = int(hashlib.sha256(f"{key}|{tweak}|{i}|{half}".encode()).hexdigest()[:15], 16)
        a, b = ((a + n % size_a) % size_a, b) if i % 2 == 0 else (a, (b + n % size_b) % size_b)
    return a, b


def plain_digits(d, tweak, key):
    u = len(d) // 2
    a, b = plain_feistel(int(d[:u]), int(d[u:]), 10**u, 10 ** (len(d) - u), f"{tweak}{len(d)}", key)
    return f"{a:0{u}}{b:0{len(d) - u}}"


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d)))


def plain_pseudonym(kind, old, key):
    """None where the match is not valid and stays."""
    d = re.sub("[^0-9]", "", old)
    new = None
    if kind == "card" and luhn(d) % 10 == 0:
        body = d[0] + plain_digits(d[1:-1], "card", key)
        new = body + str(-luhn(body + "0") % 10)
    elif kind == "phone":
        area, rest = int(d[-10:-7]), int(d[-7:])
        la, sa, lb, sb = (0, 200, 0, 10**7) if area < 200 else (200, 800, 0, 2 * 10**6) if rest < 2 * 10**6 else (200, 800, 2 * 10**6, 8 * 10**6)
        a, b = plain_feistel(area - la, rest - lb, sa, sb, "phone", key)
        new = f"{d[:-10]}{a + la:03}{b + lb:07}"
    elif kind == "dialled" and 8 <= len(d) <= 15:
        new = d[:2] + plain_digits(d[2:], "dialled", key)
    elif kind == "ssn" and 0 < int(d[:3]) < 900 and int(d[:3]) != 666 and int(d[3:5]) and int(d[5:]):
        area = int(d[:3])
        a, b = plain_feistel(area - (2 if area > 666 else 1), (int(d[3:5]) - 1) * 9999 + int(d[5:]) - 1, 898, 99 * 9999, "ssn", key)
        new = f"{a + (2 if a >= 665 else 1):03}{b // 9999 + 1:02}{b % 9999 + 1:04}"
    elif kind == "ip" and all(int(x) < 256 for x in old.split(".")):
        o = [int(x) for x in old.split(".")]
        a, b = plain_feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip", key)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if new is None:
        return old
    it = iter(new)
    return "".join(next(it) if c in "0123456789" else c for c in old)


def test_pseudonyms_equal_plain_python(spark, docs):
    rng = random.Random(5)
    made = [f"+1 ({rng.randint(0, 999):03}) {rng.randint(0, 999):03}-{rng.randint(0, 9999):04} and {rng.randint(0, 999):03}-{rng.randint(0, 99):02}-{rng.randint(0, 9999):04} {'.'.join(str(rng.randint(0, 300)) for _ in range(4))} {rng.randint(10**12, 10**19 - 1)} +{rng.randint(10, 99)} {rng.randint(100, 999)} {rng.randint(100, 9999)} {rng.randint(10, 9999)} a.b{rng.randint(0, 99)}@c.org 2001-02-{rng.randint(10, 28)}" for _ in range(200)]
    rows = [(i, t) for i, t in collect(docs.select("doc_id", "text"))] + [(10**6 + k, t) for k, t in enumerate(made)]
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    any_, skipped = re.compile(pii.ANY), ("email", "date")  # these two are held to their own formats below
    seen = Counter()
    for i, t in rows:
        if t is None:
            assert got[i] is None
            continue
        places, end, out = [], 0, []
        for m in any_.finditer(t):
            kind = next(k for k in pii.KINDS if re.fullmatch(pii.PATTERNS[k], m[0]))
            places.append((kind, m[0]))
            out += [re.escape(t[end : m.start()]), "(.{%d})" % len(m[0]) if kind in skipped else "(" + re.escape(plain_pseudonym(kind, m[0], "k")) + ")"]
            end = m.end()
            seen[kind] += 1
        found = re.fullmatch("".join(out) + re.escape(t[end:]), got[i], re.DOTALL)
        assert found, (t[:200], got[i][:200])
        for (kind, old), new in zip(places, found.groups(), strict=True):
            if kind in skipped:
                shape = lambda x: re.sub("[0-9]", "9", x) if kind == "date" else (re.sub("[A-Za-z0-9]", "a", x.split("@")[0]), x.split("@")[1])
                assert shape(old) == shape(new)
    assert all(seen[k] for k in pii.KINDS)


@pytest.mark.parametrize("kind,values", [
    ("ssn", [f"{a:03}-{b:02}-{c:04}" for a in (1, 665, 667, 899) for b in (1, 50, 99) for c in range(1, 9999, 400)]),
    ("phone", [f"({a:03}) {r // 10000:03}-{r % 10000:04}" for a in (0, 199, 200, 999) for r in range(0, 10**7, 99991)]),
    ("date", [f"{1900 + k // 12}-{k % 12 + 1:02}-17" for k in range(2400)]),
    ("email", [f"{x}{y}.{z}@a.org" for x in "abz09" for y in "acx7" for z in "bq3"]),
    ("ip", [f"{a}.{b}.{c}.7" for a in (0, 9, 255) for b in (0, 99, 255) for c in range(256)]),
])
def test_every_kind_is_one_to_one(spark, kind, values):
    frame = spark.createDataFrame(list(enumerate(values)), "doc_id int, text string")
    out = pii.pseudonymise(frame, "k").collect()
    assert len({r.text for r in out}) == len(set(values)) and {f.kind for r in out for f in r.found} == {kind}


def test_pseudonyms_of_odd_rows(spark):
    long = "call (988) 555-2485 now " * 20000
    frame = spark.createDataFrame([(1, long, "x", 1), (1, long, "x", 1), (None, "a@b.co (988) 555-2485", None, 2)], "doc_id long, text string, found string, _all int")
    out = pii.pseudonymise(frame, "k").collect()
    assert len(out) == 3 and out[0] == out[1] and len(out[0].found) == 20000 and len(set(f.pseudonym for f in out[0].found)) == 1
    assert out[2].doc_id is None and [f.kind for f in out[2].found] == ["email", "phone"] and out[2].found[1] == out[0].found[0]


def test_feistel_is_a_permutation(spark):
    pairs = spark.range(77).select(pii.feistel(F.floor(F.col("id") / 11), F.col("id") % 11, F.lit(7), F.lit(11), F.lit("t"), "k").alias("p"))
    assert pairs.select(F.col("p.a") * 11 + F.col("p.b")).distinct().count() == 77


# 4


def brute_measures(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    again = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_ledger_equals_brute_force(spark, docs, edge_docs, no_docs):
    for frame in (docs, edge_docs):
        got = sorted(tuple(r) for r in quality.ledger(frame).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
        assert got == sorted((i, *brute_measures(t)) for i, t in collect(frame.select("doc_id", "text")))
    assert quality.ledger(no_docs).count() == 0


def test_policies_and_ablation(spark, docs):
    book = quality.ledger(docs).cache()
    for policy in (quality.BASE, quality.STRICT):
        kept = {r.doc_id for r in quality.apply_policy(book, policy).where("kept").collect()}
        assert kept == {r.doc_id for r in quality.filter_documents(docs, policy).collect()}
        rows = {r.rule: r for r in quality.ablation(book, policy).collect()}
        for drop in policy.rules:
            less = quality.Policy("x", tuple(r for r in policy.rules if r != drop))
            assert rows[drop].rejected_without == quality.apply_policy(book, less).where("not kept").count()
    assert quality.filter_documents(docs).columns == docs.columns


def test_rows_of_symbols_are_rejected(spark):
    rng = random.Random(2)
    line = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(100)]
    split = " ".join(w + (" |" if k % 2 else "") for k, w in enumerate(line))  # 1 symbol to 3 words of the text
    few = " ".join(line[:90]) + " | | |"
    frame = spark.createDataFrame([(1, split), (2, few), (3, " ".join(line))], "doc_id long, text string")
    assert {r.doc_id for r in quality.filter_documents(frame).collect()} == {2, 3}
    assert {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, frame, DATA).collect()} == {2, 3}


def test_saved_ledger_serves_policies(spark, docs):
    book = quality.ledger(docs, tables=Tables(spark))
    got = {r.doc_id: r for r in queries()["op4_quality_ledger"](spark, DATA).collect()}
    kept = {r.doc_id for r in quality.apply_policy(book, quality.STRICT_2).where("kept").collect()}
    assert kept == {i for i, r in got.items() if r.kept}
    for r in got.values():
        assert bool(r.fail_bits & 256) == (r.n_symbols * 1000 > r.n_words * 100)
    assert any(r.fail_bits == 256 for r in got.values())


def test_filter_keeps_rows_of_any_columns(spark, edge_docs):
    wide = spark.createDataFrame([(None, "w " * 60 + " ".join(f"word{k}" for k in range(90)), 1, 2), (1, None, 1, 2), (1, None, 1, 2), (2, " ".join(f"word{k}" for k in range(90)), 3, 4)], "doc_id long, text string, _row int, fail_bits int")
    out = quality.filter_documents(wide)
    assert out.columns == wide.columns and sorted(tuple(r[2:]) for r in out.collect()) == [(1, 2), (3, 4)]
    assert quality.filter_documents(edge_docs).columns == edge_docs.columns


# 5


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_passages_are_found_and_clean_texts_left(spark, no_docs):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    pick = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, pick(rng.randint(9, 50))) for k in range(30)]
    rows, planted = [], {}
    for d in range(160):
        text = pick(rng.randint(0, 150))
        if d % 2:
            item, own = rng.choice(items)
            own, most = list(own), rng.randint(0, len(own) // 4)
            for _ in range(most):
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice([["zz"], [], [own[k], "yy"]])
            at = rng.randint(0, len(text))
            text[at:at] = [x.upper() + "," for x in own]
            planted[d] = item
        rows.append((d, " ".join(text)))
    rows += [(900, None), (901, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(99, "too short"), (98, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.find_passages(frame, bench).collect()}
    found = sum((d, i) in got for d, i in planted.items())
    assert found >= 0.98 * len(planted) and {d for d, _ in got} <= set(planted)
    by_id, words_of = dict(rows), dict(items)
    for (d, i), r in got.items():
        window = re.sub("[^a-z0-9 ]", " ", by_id[d].encode()[r.start : r.end].decode().lower()).split()
        assert edits(window, words_of[i]) == r.distance <= len(words_of[i]) // 4
    assert decontam.find_passages(no_docs, bench).count() == 0 and decontam.find_passages(frame, bench.limit(0)).count() == 0
    clean = {r.doc_id for r in decontam.remove_contaminated(frame, bench).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _ in got}


@pytest.mark.parametrize("kind", ["deletions", "substitutions", "insertions", "mixed"])
def test_no_passage_at_the_edit_limit_is_missed(kind):
    rng = random.Random(6)
    pick = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    sizes = [4, 6, 7, 8, 9, 13, 20, 50, 60, 80, 120, 200, 400]
    items = [pick(n) for n in sizes for _ in range(10)]
    texts = []
    for own in items:
        new = {"deletions": lambda w: [], "substitutions": lambda w: ["zz"], "insertions": lambda w: [w, "yy"]}
        hit = set(rng.sample(range(len(own)), len(own) // 4 if len(own) >= decontam.SHORT else 0))
        edited = [x for k, w in enumerate(own) for x in (new[kind if kind != "mixed" else rng.choice(list(new))](w) if k in hit else [w])]
        texts.append(" ".join(pick(rng.randint(0, 60)) + edited + pick(rng.randint(0, 60))))
    block = decontam.Items.of_texts(list(range(len(items))), [" ".join(x) for x in items])
    (_, _, buf, offsets), = X.text_chunks(pa.array(texts))
    _, _, rows, words_of = decontam.plain_words(buf, offsets)
    found = block.match(words_of, rows, len(texts), decontam.MAX_EDIT)
    hits = Counter(len(items[r[1]]) for r in found.tolist() if r[0] == r[1])
    assert sum(hits.values()) >= 0.98 * len(items) and all(hits[n] >= 9 for n in sizes)
    assert all(r[2] <= len(items[r[1]]) // 4 for r in found.tolist())


def test_nearest_part_equals_brute_force():
    rng = np.random.default_rng(9)
    item, text = rng.integers(1, 4, (40, 6)).astype(np.uint64), rng.integers(1, 4, (40, 10)).astype(np.uint64)
    size, length = rng.integers(1, 7, 40), rng.integers(0, 11, 40)
    distance, end = decontam.nearest_part(item, size, text, length)
    for k in range(40):
        a, b = item[k, : size[k]].tolist(), text[k, : length[k]].tolist()
        best = min((edits(a, b[i:j]), j) for j in range(len(b) + 1) for i in range(j + 1))
        assert (distance[k], end[k]) == best


# 6


def test_model_scores(spark, docs, edge_docs, no_docs):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    for frame in (docs, edge_docs):
        rows = [(i, [*words((t or "").translate(LOW)), "\n"]) for i, t in collect(frame.select("doc_id", "text"))]
        count = Counter(w for i, ws in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
        n, v = sum(count.values()), len(count)
        want = {i: (zlib.crc32(str(i).encode()) % 7 == 2, len(ws), sum(w in count for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in rows}
        scored = lm.score(frame, held).cache()
        assert scored.count() == len(rows)
        for r in scored.collect():
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
            assert abs(r.base_score - want[r.doc_id][4]) < 1e-6 * abs(want[r.doc_id][4]) + 1e-9 and r.score < 0
    scored = lm.score(docs, held)
    r = scored.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1] and lm.perplexity(scored) < 50_000
    assert lm.score(no_docs, held).count() == 0


def test_model_equals_brute_force(spark, docs):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    model = lm.fit(docs, held)
    texts = [(i, zlib.crc32(str(i).encode()) % 7 == 2, [*words((t or "").translate(LOW)), "\n"]) for i, t in collect(docs.select("doc_id", "text"))]
    train = [ws for _, h, ws in texts if not h]
    count, pair = Counter(w for ws in train for w in ws), Counter(p for ws in train for p in zip(["\r", *ws], ws))
    context = Counter({**count, "\r": len(train)})
    n, v = sum(count.values()), len(count)
    assert (model.tokens, model.types, model.docs) == (n, v, len(train))
    want = {}
    for i, _, ws in texts:
        total = 0.0
        for a, b in zip(["\r", *ws], ws):
            weight = model.weights[int(math.log2(context[a])) + 1] if context[a] else 0.0
            total += math.log10(weight * pair[a, b] / max(context[a], 1) + (1 - weight) * (model.unigram * count[b] / n + (1 - model.unigram) / (v + 1)))
        want[i] = total
    got = {r.doc_id: r.score for r in lm.score(docs, held).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 * abs(want[i]) + 1e-9 for i in want)
    assert 0 < model.unigram < 1 and model.weights[0] == 0 and ((model.weights >= 0) & (model.weights < 1)).all()


def test_chunks_of_equal_ids_and_lengths_are_told_apart(spark, tmp_path):
    for k, text in enumerate(("aa bb", "cc cc")):
        spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/{k}")
    frame = spark.read.parquet(f"{tmp_path}/0", f"{tmp_path}/1")
    got = sorted((r.n_tokens, r.n_known) for r in lm.score(frame, F.lit(False)).collect())
    assert got == [(3, 3), (3, 3)]


def test_pairs_that_differ_above_40_bits_are_counted_apart():
    keys = np.array([5, 5 + (1 << 41), 5 + (1 << 55)], np.uint64)
    width = lm._KEY_BYTES[2]
    sent = np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
    row = {"kind": [2], "shard": [0], "chunk": [1], "keys": [sent], "counts": [bytes([1, 2, 3])], "over": [b""]}
    totals = lm._answer(pa.table(row)).column("totals")[0].as_py()
    assert np.frombuffer(lm._unpacked(totals), "<u4").tolist() == [1, 2, 3]


def test_em_finds_the_best_weight():
    rng = np.random.default_rng(6)
    ratio, mass = np.exp(rng.normal(0, 2, 50)), rng.random(50)
    a = lm.em_weight(mass, ratio, 5000)
    gain = lambda x: (mass * np.log(x * ratio + 1 - x)).sum()
    assert all(gain(a) >= gain(x) - 1e-6 for x in np.linspace(0.001, 0.999, 200)) and lm.em_weight(np.zeros(2), np.ones(2)) == 0.5


# 7


def test_archives(spark, duck):
    same_rows(queries()["op7_warc_index"](spark, DATA), duck.sql(OP7_SQL))
    pages = spark.createDataFrame([(1, "http://a/b c\n", "x" * 1500), (5, None, "x" * 1500), (5, None, "x" * 1500), (-3, "u", None), (4, "u", "é" * 500), (2, "u", "é" * 500), (9, "u", "small"), (8, "u", "small")], "page_id long, url string, html string")
    tables = Tables(spark)
    index = warc.write(pages, f"{tables.root}/w", tables)
    got = {r.page_id: r for r in warc.read(index).collect()}
    assert got[1].refers_to == 5 and got[1].payload is None and got[1].payload_bytes == 1500 and got[5].payload == b"x" * 1500
    assert got[2].refers_to == 4 and got[8].refers_to is None and got[-3].payload_bytes == 0 and got[1].url == "http://a/b%20c%0A"
    assert {r.page_id for r in warc.read(index.where("page_id in (9, -3)")).collect()} == {9, -3}
    assert warc.read(index.limit(0)).count() == 0
    none = spark.createDataFrame([(None, "u", "y" * 2000), (3, "u", "y" * 2000), (1, "u", "y" * 2000), (None, None, None), (None, "u", "q" * 1200), (None, "u", "q" * 1200)], "page_id long, url string, html string")
    back = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(warc.write(none, f"{tables.root}/n", tables)).collect()), key=str)
    assert back == sorted([(None, 2000, "response", None), (3, 2000, "response", None), (1, 2000, "revisit", 3), (None, 0, "response", None), (None, 1200, "response", None), (None, 1200, "response", None)], key=str)
    assert warc.read(warc.write(pages.limit(0), f"{tables.root}/e", tables)).count() == 0
    assert [(a, b, len(g)) for a, b, g in warc._ranges([(0, 10, 0), (10, 5, 1), (10**6, 7, 2)])] == [(0, 15, 2), (10**6, 10**6 + 7, 1)]


# 8


def brute_repeats(rows, least, first):
    seen, out = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - least + 1):
            seen.setdefault(b[p : p + least], []).append((i, p))
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - least + 1):
            places = seen[b[p : p + least]]
            if places[0] != (i, p) if first else len(places) > 1:
                gone[p : p + least] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("first", [False, True])
def test_repeats_equal_brute_force(spark, first):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(50, 900))) for _ in range(12)]
    rows = [(i, "".join(rng.choice([rng.choice(base), rng.choice(base)[100:700], "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 120)))]) for _ in range(rng.randint(0, 4)))) for i in range(50)]
    rows += [(50, "ab" * 300), (51, "ab" * 201), (52, None), (53, "")]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 400, first)
    assert {r[0]: tuple(r[1:5]) for r in got.collect()} == brute_repeats(rows, 400, first)


def test_runs_spread_over_the_buckets():
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 6000))) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    out = pa.Table.from_batches(suffix_dedup._runs(400, 128, 16)([batch])).filter(pc.field("runs").is_valid())
    held = {b: len(x) for b, x in zip(out["bucket"].to_pylist(), out["runs"].to_pylist(), strict=True)}
    assert len(held) == 16 and max(held.values()) < 2 * sum(held.values()) / 16


def test_previous_factors_equal_brute_force(no_docs):
    rng = random.Random(8)
    for _ in range(100):
        d = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60)))
        order, lcp = suffix_dedup.suffix_order(np.frombuffer(d, np.uint8), np.zeros(len(d), np.int64), 9)
        assert [d[k:][:9] for k in order] == sorted(d[k:][:9] for k in range(len(d)))
        got, source = suffix_dedup.previous_factors(order, lcp, 8)
        for i in range(len(d)):
            best = max((next((k for k in range(len(d) - i) if d[i + k] != d[j + k]), len(d) - i) for j in range(i)), default=0)
            assert min(got[i], 14) == (min(best, 14) if best >= 8 else 0)
            assert source[i] == -1 or d[source[i] :][:8] == d[i:][:8]
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


# 10


def test_lines(spark, duck, docs, edge_docs, no_docs, monkeypatch):
    same_rows(queries()["op10_line_dedup"](spark, DATA), duck.sql(OP10_SQL))
    rows = [(i, f"s{i % 7}", f"own text number {i} is long enough\nspread line\n\nnear {i % 7}") for i in range(40)] + [(99, "s1", "spread line"), (98, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = {i: t and t.replace("\nspread line", "") for i, _, t in rows} | {99: ""}
    one = {r.doc_id: r.text for r in line_dedup.remove_spread_lines(frame, 7).collect()}
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    joined = {r.doc_id: r.text for r in line_dedup.remove_spread_lines(frame, 7).collect()}
    assert one == joined == want
    out = line_dedup.remove_spread_lines(edge_docs, 2)
    assert out.count() == edge_docs.count() and out.columns == ["doc_id", "text", "source", "_id", "n_lines", "n_removed"]
    assert line_dedup.remove_spread_lines(no_docs).count() == 0


def test_mostly_spread_texts_lose_their_lines_unless_copied(spark, edge_docs, no_docs, monkeypatch):
    rows = [(i, f"s{i}", f"own text number {i} is long enough\nspread line") for i in range(10)]
    rows += [(20, "s1", "short\nspread line"), (21, "s1", "spread line"), (22, "s1", "copy\nspread line"), (23, "s2", "copy\nspread line"), (24, "s3", "twice here\nspread line\nspread line"), (25, "s3", "twice here\nspread line\nspread line"), (26, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = {i: t and t.replace("\nspread line", "") for i, _, t in rows} | {21: "", 22: rows[12][2], 23: rows[13][2]}
    assert {r.doc_id: r.text for r in line_dedup.remove_spread_lines(frame, 7).collect()} == want
    staged = {r.doc_id: r.text for r in corpus_pipeline.STAGES[1][1](spark, frame.withColumn("n_chars", F.length("text").cast("long")), DATA).collect()}
    assert staged == want
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    assert {r.doc_id: r.text for r in line_dedup.remove_spread_lines(frame, 7).collect()} == want
    out = line_dedup.remove_spread_lines(edge_docs, 2)
    assert out.count() == edge_docs.count() and out.columns == ["doc_id", "text", "source", "_id", "n_lines", "n_removed"]
    assert line_dedup.remove_spread_lines(no_docs).count() == 0
