"""The filter audit, the search for benchmark passages and the resampling against brute force on small tables."""

import math
import random
import re
import time
import zlib
from collections import Counter
from hashlib import sha256
from itertools import permutations

import numpy as np
import pytest

from tarnlake.llm import decontamination, filter_audit, html_blocks, packing, resampling, simhash_dedup
from tarnlake.llm.words import pieces, words_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_pieces_cut_no_word():
    rng = random.Random(1)
    for _ in range(300):
        text = bytes(rng.choice(b"ab  \n\t") for _ in range(rng.randrange(60)))
        cut = list(pieces(text, rng.randrange(1, 9)))
        assert b"".join(cut) == text and [w for p in cut for w in p.split()] == text.split()


# --- filter audit --------------------------------------------------------------------------------------------


def _fails(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)))


def audit(docs, labels):
    """Rows of op11 by going through every order document by document."""
    rows = []
    for key, text, source in docs:
        text = text or ""
        copy = any((o or "") == text and k is not None and (key is None or k < key) for k, o, _ in docs)
        own = [(q, t) for k, q, t in labels if k == key and key is not None]
        rows.append((source or "", [*_fails(text), copy], any(q == 1 for q, _ in own), any(t == 1 for _, t in own)))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = Counter()
        for order in permutations(range(5)):
            name = "".join("ABCDE"[f] for f in order)
            for step, f in enumerate(order, 1):
                here, reached = order[: step - 1], [r for r in rows if r[0] == part]
                left = [r for r in reached if not any(r[1][g] for g in here)]
                gone = [r for r in left if r[1][f]]
                redundant = sum(r[1][f] and any(r[1][g] for g in here) for r in reached)
                unique = sum(r[1][f] and sum(r[1]) == 1 for r in reached)
                shapley[f] += len(gone)
                out[part, name, step] = [len(left) - len(gone), len(gone), redundant, unique, sum(r[2] for r in gone), sum(r[3] for r in gone), f]
        for k, v in out.items():
            if k[0] == part:
                v[6] = shapley[v[6]]
    return out


def test_filter_audit(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice(["alpha", "Beta", "GAMMA", "d$lta", "x", "y%", *map(str, range(80))]) for _ in range(rng.choice([3, 49, 50, 51, 90]))) for _ in range(12)]
    docs = [(rng.choice([*range(25), None]), rng.choice([*base, None, "", "ÄÖÜ é" * 30]), rng.choice(["a", "b", "", None])) for _ in range(70)]
    labels = [(rng.choice([*range(25), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(40)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    got = filter_audit.op11(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = audit(docs, labels)
    assert len(got) == len(want) == 600 * len({s or "" for _, _, s in docs})
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == want[r.part, r.filter_order, r.step]


def test_failed_reads_whole_texts():
    long = b"word " * (1 << 19) + " ".join(f"w{i}" for i in range(3000)).encode()
    assert filter_audit.failed(long) == 0b0010
    assert filter_audit.failed(long + b" #") == 0b1010
    assert filter_audit.failed("É".encode() * 19 + b"A") == 0b0001 and filter_audit.failed("É".encode() * 18 + b"A") == 0b0101


# --- benchmark passages --------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_fm_index(seed):
    rng = np.random.default_rng(seed)
    n, size = int(rng.integers(2, 400)), int(rng.choice([2, 3, 9, 300]))
    text = rng.integers(0, size - 1, n)
    if seed % 2:
        text = np.tile(text[: max(1, n // 7)], 9)[:n]
    sequence = np.concatenate((text, [size - 1]))
    want = sorted(range(len(sequence)), key=lambda i: tuple(sequence[i:]))
    assert decontamination._suffixes(sequence).tolist() == want
    fm = decontamination.FmIndex.of(sequence, size)
    phrases = [text[i : i + k] for i, k in zip(rng.integers(0, n, 60), rng.integers(1, 6, 60), strict=True)] + [rng.integers(0, size - 1, 3) for _ in range(20)]
    rows = np.zeros((len(phrases), 6), np.int64)
    for r, p in zip(rows, phrases, strict=True):
        r[6 - len(p) :] = p
    low, high = fm.intervals(rows, np.array(list(map(len, phrases))))
    for p, a, b in zip(phrases, low, high, strict=True):
        assert sorted(fm.locate(np.arange(a, b)).tolist()) == [i for i in range(n - len(p) + 1) if (text[i : i + len(p)] == p).all()]


def leaks(docs, items):
    windows = {}
    for key, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(key)
    sizes = {len(w) for w in windows}
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        found = sorted(str(x) for x in found if x is not None)
        out.append((key, len(w), len(hit), len(found), sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return out


def _leak_tables():
    rng = random.Random(9)
    some = ["le", "été", "x1", "über", "go", "Ω", "z"]
    text = lambda n, sep=" ": sep.join(rng.choice(some) for _ in range(n))
    items = [(i, text(rng.choice([11, 14, 30]), rng.choice([" ", ", ", "\n"]))) for i in range(25)] + [(25, "Go X1 z"), (26, "z z z z"), (27, None), (28, "!?"), (3, text(12)), (None, text(10)), (101, text(40))]
    docs = [(i, text(rng.randrange(0, 80), rng.choice([" ", "-", "\x00"]))) for i in range(60)]
    docs += [(100 + i, f"{text(6)} other {it.upper() if i % 2 else it}; OTHER {text(5)}") for i, (_, it) in enumerate(items) if it] + [(None, None), (7, ""), (7, items[0][1] * 3)]
    return docs, items


@pytest.mark.parametrize("sizes", [None, (40, 30, 8)])
def test_decontamination(spark, monkeypatch, sizes):
    docs, items = _leak_tables()
    if sizes:  # several blocks of items, items in parts, several shards a text
        for name, n in zip(("SHARD", "BLOCK", "PART"), sizes, strict=True):
            monkeypatch.setattr(decontamination, name, n)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(repr, map(tuple, decontamination.op12(d, i).collect()))) == sorted(map(repr, leaks(docs, items)))


def test_shards_of_small_pieces():
    """Shards within one text, cut every few words, find what a search of the whole text finds."""
    docs, items = _leak_tables()
    p = decontamination.Phrases.of([(str(k), [w.encode() for w in words(t)]) for k, t in items])
    texts = [(t or "").encode() for _, t in docs]
    whole = lambda: sorted({(int(a), int(b), int(c)) for w, t, s, _ in decontamination._found(texts, p) for a, b, c in zip(w, t, s, strict=True)})
    want = whole()
    old = decontamination.SHARD, decontamination.pieces
    try:
        decontamination.SHARD = 3
        decontamination.pieces = lambda t: pieces(t, 20)
        assert whole() == want and want
    finally:
        decontamination.SHARD, decontamination.pieces = old


def test_decontaminate_cuts_spans_out(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Before, {item.upper()} after.", "k"), (2, "clean text", "k"), (3, None, None), (4, item, "k"), (5, item[4:-7] + " short", "k")]
    d = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = {r.doc_id: (r.text, r.spans) for r in decontamination.decontaminate(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert out == {1: ("Before,  after.", "k"), 2: ("clean text", "k"), 3: (None, None), 4: ("", "k"), 5: (item[4:-7] + " short", "k")}


# --- resampling ----------------------------------------------------------------------------------------------


def features(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resample(docs, target):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x))
    for x in target:
        t.update(features(x))
    a, b = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (a + 10000) / ((s[k] + 1) * (b + 10000))))
    rows = []
    for key, x in docs:
        f = features(x)
        h = int(sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    full = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    for i, r in enumerate(full[: 5 * len(full) // 100], 1):
        r[4] = i
    return [tuple(r[:5]) for r in rows]


def test_resampling(spark):
    rng = random.Random(3)
    some = ["le", "été", "x1", "über", "go", "Ω" * 40, "z" * 65, "q" * 200, "AbC"]
    text = lambda n: "".join(rng.choice(some) + rng.choice([" ", ", ", "\n\n"]) for _ in range(n))
    docs = [(i, text(rng.randrange(60))) for i in range(150)] + [(5, text(30)), (None, text(40)), (None, None), (9, ""), (-4, "w"), (-5, "one two"), (200, text(5000))]
    docs += [(17, docs[17][1] or "x")] * 20
    target = [text(25), None, "été"]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = resampling.op13(d, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, resample(docs, target)))


def test_features_of_pieces():
    """A text read in small pieces has the features of the whole text."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "bb", "c" * 70]) for _ in range(n)).encode() for n in (0, 1, 2, 3, 50, 400)]
    old = resampling.pieces, resampling.CHUNK
    try:
        resampling.pieces, resampling.CHUNK = lambda t: pieces(t, 7), 40
        got, n = Counter(), Counter()
        for i, w, (of, bucket) in resampling.features_of(texts):
            got.update(zip(of.tolist(), bucket.tolist(), strict=True))
            for k, x in zip(i.tolist(), w.tolist(), strict=True):
                n[k] += x
    finally:
        resampling.pieces, resampling.CHUNK = old
    assert got == Counter((i, f) for i, t in enumerate(texts) for f in features(t.decode()))
    assert [n[i] for i in range(6)] == [0, 1, 2, 3, 50, 400]


@pytest.mark.parametrize("seed", range(4))
def test_selection(spark, seed):
    rng = random.Random(seed)
    scores = [(-5, 5), (0, 0), (-(1 << 45), 1 << 45), (-3, 70000)][seed]
    ids = [(0, 50), (-(1 << 62), 1 << 62), (-9, 9), (0, 1 << 40)][seed]
    rows = [(rng.choice([None, rng.randint(*ids)]), rng.randrange(3), rng.randint(*scores)) for _ in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, n_features long, score long").repartition(3)
    for k in (0, 1, 7, 120, 200):
        order = sorted(rows, key=lambda r: (-r[2], r[0] is None, r[0], r[1]))
        got = sorted(((r.rank, r.doc_id, r.score) for r in resampling.ranked(df, df.doc_id.isNull() | (df.score > -10**18), k).collect() if r.rank), key=lambda r: r[0])
        assert got == [(i, r[0], r[2]) for i, r in enumerate(order[:k], 1)]


# --- words of one hash, and pages that lose text -------------------------------------------------------------


def _twins():
    """Two words of 1,024 letters that sums of powers modulo 2^64 cannot tell apart, whatever the base: a Thue-Morse word and its opposite."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_long_words_have_hashes_of_their_own(spark):
    one, other = _twins()
    h, _ = words_of([f"{one} {other} {one}".encode()])
    assert h[0] == h[2] != h[1]
    tok = packing.Tokenized("/opt/tokenizers/word_bpe_49k.json")
    ids = [tok.ids([f"{w} x {w}".encode()])[0].tolist() for w in (one, other)]
    both = tok.ids([f"{one} {other}".encode()])[0].tolist()
    want = [tok.tokenizer.encode(w, add_special_tokens=False).ids for w in (one, other)]
    assert both == [*want[0], *want[1], 1] and want[0] != want[1] and ids[1][: len(want[1])] == want[1]
    docs = spark.createDataFrame([(1, " ".join([one] * 9)), (2, " ".join([other] * 9))], "doc_id long, text string")
    assert {r.doc_id for r in simhash_dedup.deduplicate(docs).collect()} == {1, 2}


def test_pages_that_lost_text():
    texts = lambda page: [b.text for b in html_blocks.blocks(page)]
    assert texts("<!--><p>shown</p>") == texts("<!---><p>shown</p>") == texts("<!-- a --!><p>shown</p>") == texts("<!----><p>shown</p>") == ["shown"]
    assert texts("<title>no text</title><p>shown</p>") == ["shown"] and texts("<!-- <p>hidden</p> --><p>shown</p>") == ["shown"]
    began = time.perf_counter()
    assert texts("<head><noscript><p>" * 50_000) == [] and time.perf_counter() - began < 3
