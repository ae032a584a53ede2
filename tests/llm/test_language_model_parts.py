"""op10_pitman_yor: what moves between its parts, and its cells and scores against plain counting."""

import collections
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from tarnlake.llm import pitman_yor
from tarnlake.llm.words import words_of

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def _held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _rows_shuffled(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_no_row_moves_for_each_token(spark):
    before = _rows_shuffled(spark)
    tokens = pitman_yor.op10(spark.read.parquet(f"{SF}/documents.parquet")).agg(F.sum("n_tokens")).first()[0]
    assert 0 < _rows_shuffled(spark) - before < tokens / 20


def test_packed_arrays():
    r = np.random.default_rng(1)
    for x in (np.zeros(0, np.int64), r.integers(-5, 1 << 40, 1000), r.integers(0, 9, 7).astype(np.uint32), r.random(50)):
        assert (pitman_yor.unpack(pitman_yor.pack(x), x.dtype) == x).all()
    x = np.sort(r.integers(0, 1 << 63, 1000).astype(np.uint64) << np.uint64(1))
    assert (pitman_yor.unpack_sorted(pitman_yor.pack_sorted(x)) == x).all()
    x = r.choice(np.float32([0.5, 1e-7, 3.25]), 100)
    assert (pitman_yor.unpack_few(pitman_yor.pack_few(x)) == x).all() and len(pitman_yor.unpack_few(pitman_yor.pack_few(x[:0]))) == 0


def test_cells_and_scores_by_counting(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "FREQUENT", 4)
    monkeypatch.setattr(pitman_yor, "TOP", 4)
    r = np.random.default_rng(7)
    texts = [" ".join(f"w{int(x)}" for x in r.zipf(1.4, r.integers(0, 40)) % 300) for _ in range(120)]
    rows = [*enumerate(texts), (None, "w1 w2 onlyhere"), (500, None), (501, ""), (501, "w1 W2")]
    # a held-out text that begins with a pair of training, seen once, and a pair of words that training has once
    out = next(i for i in range(600, 700) if _held(i))
    rows += [(next(i for i in range(700, 800) if not _held(i)), "once0 once1 w1"), (out, "once0 once1 w1 never")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    m = pitman_yor.Model(df.withColumn("held_out", pitman_yor.held_out(F.col("doc_id"))))
    signed = lambda h: h.astype(np.uint64).view(np.int64).tolist()
    begin, end = signed(np.array([pitman_yor.BEGIN, pitman_yor.END]))
    tokens = [[*signed(words_of([(t or "").encode()])[0]), end] for _, t in rows]
    pairs = [list(zip([begin, *t], t, strict=False)) for t in tokens]
    c = collections.Counter(p for (d, _), own in zip(rows, pairs, strict=True) if not _held(d) for p in own)
    asked = {p for (d, _), own in zip(rows, pairs, strict=True) if _held(d) for p in own}
    cells = {(x.u, x.w): x for x in m.cells.collect()}
    assert {k: x.c for k, x in cells.items()} == {p: n for p, n in c.items() if n > 1 or p in asked}
    assert (begin, tokens[-1][0]) in cells and cells[tokens[-1][0], tokens[-1][1]].c == 1
    words = {x.h: x for x in m.words.collect()}
    n = collections.Counter(w for (d, _), own in zip(rows, tokens, strict=True) if not _held(d) for w in own)
    assert {h: x.c for h, x in words.items() if h != begin} == n and m.tokens == sum(n.values()) and m.types == len(n)
    want = collections.Counter()
    for (d, _), own in zip(rows, pairs, strict=True):
        s = 0.0
        for u, w in own:
            p = words[w].P if w in words else m.unknown
            b, div = (words[u].B, words[u].D) if u in words else (1.0, 1.0)
            s += cells[u, w].said if (u, w) in cells else math.log10(((0 if _held(d) else 1 - m.discount) + b * p) / div)
        want[d, round(s, 4), len(own), sum(n[w] > 0 for _, w in own)] += 1
    got = pitman_yor.op10(df).collect()
    assert collections.Counter((x.doc_id, x.n_tokens, x.n_known) for x in got) == collections.Counter((d, k, j) for d, _, k, j in want.elements())
    rank = lambda x: ([(-1 if d is None else d), s] for d, s in x)
    for (d, s), (e, t) in zip(sorted(rank((d, s) for d, s, _, _ in want.elements())), sorted(rank((x.doc_id, x.score) for x in got)), strict=True):
        assert d == e and abs(s - t) < 1e-3
    # every context's tables and customers: what a cell seen once leaves is what its context hands on
    for h, x in words.items():
        own = [p for p in c if p[0] == h]
        assert x.D == pitman_yor.STRENGTH + sum(c[p] for p in own) and x.B <= pitman_yor.STRENGTH + m.discount * x.D


def test_without_training_and_without_rows(spark):
    out = [i for i in range(60) if _held(i)][:2]
    got = pitman_yor.op10(spark.createDataFrame([(out[0], "a b a"), (out[1], None)], SCHEMA)).collect()
    assert [(x.n_tokens, x.n_known, x.train_tokens, x.base_score, x.score) for x in sorted(got, key=lambda x: -x.n_tokens)] == [(4, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]
    assert pitman_yor.op10(spark.createDataFrame([], SCHEMA)).count() == 0
