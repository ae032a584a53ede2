"""Drawing documents that look like a target: importance weights from hashed features, and the top scores by radix selection.

Runs of one to three words are hashed into buckets; a bucket's gain is how much more frequent it is in the target than in
the documents, and a document weighs the sum of its features' gains. Batches of texts are scored as arrays. With Gumbel noise
of the id alone the highest scores are a draw without replacement. The last score drawn is found exactly: passes over
(score, doc_id) count one digit of the key after another, each among the rows that share the digits found before. Only rows
up to that key are then sorted by range and ranked; no row is compared with all others, and no task holds more than counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.shared import raw, stage
from tarnlake.llm.words import CHUNK, LETTERS, pieces

BUCKETS = 10_000
LONGEST_RUN = 3
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Bits of the key that one pass of the selection finds: it counts so many digits at most.
DIGIT = 14
#: Words of up to so many bytes are hashed together, longer ones one by one.
_short = 64
_space = 32


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of one byte, and what k zero bytes do to each byte of a checksum, for k up to _short."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(0xEDB88320), c >> 1)
    zeros = np.zeros((_short + 1, 4, 256), np.uint32)
    zeros[0] = np.arange(256, dtype=np.uint32)[None] << np.array([[0], [8], [16], [24]], np.uint32)
    for k in range(_short):
        zeros[k + 1] = c[zeros[k] & 0xFF] ^ zeros[k] >> 8
    return c, zeros


def _shifted(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums after n more zero bytes each."""
    zeros = _tables()[1]
    step = lambda s, k: zeros[k, 0, s & 0xFF] ^ zeros[k, 1, s >> 8 & 0xFF] ^ zeros[k, 2, s >> 16 & 0xFF] ^ zeros[k, 3, s >> 24]
    out = step(sums, np.minimum(n, _short))
    left = np.maximum(n - _short, 0)
    # a word of over _short bytes is rare: its rest is shifted by powers of two
    for i in np.flatnonzero(left):
        c, k, power = out[i : i + 1], int(left[i]), zeros[1]
        while k:
            through = lambda s, t: t[0, s & 0xFF] ^ t[1, s >> 8 & 0xFF] ^ t[2, s >> 16 & 0xFF] ^ t[3, s >> 24]
            if k & 1:
                c = through(c, power)
            power, k = through(power, power), k >> 1
        out[i] = c[0]
    return out


def _word_sums(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of every word, all words of one length or more a byte at a time."""
    table = _tables()[0]
    order = np.argsort(-np.minimum(size, _short + 1), kind="stable")
    at, left = start[order], size[order]
    n_long = int(np.count_nonzero(left > _short))
    c = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(min(int(left.max(initial=0)), _short)):
        n = int(np.searchsorted(-np.minimum(left, _short + 1), -k, "left"))
        c[:n] = table[(c[:n] ^ data[at[:n] + k]) & 0xFF] ^ c[:n] >> 8
    c = ~c
    for i in range(n_long):
        c[i] = crc32(data[at[i] : at[i] + left[i]])
    out = np.empty_like(c)
    out[order] = c
    return out


def _runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every word of bytes in which all else is a space, and buckets of the runs that end with it: a row for one, two and three words."""
    inside = np.concatenate(([False], data != _space, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, size = edge[::2], edge[1::2] - edge[::2]
    table = _tables()[0]
    one = _word_sums(data, start, size)
    sums = [one]
    for _ in range(1, LONGEST_RUN):
        last = sums[-1]
        spaced = ~(table[(~last ^ np.uint32(_space)) & 0xFF] ^ ~last >> 8)
        nxt = one.copy()
        nxt[1:] = _shifted(spaced[:-1], size[1:]) ^ one[1:]
        sums.append(nxt)
    return start, np.stack(sums) % np.uint32(BUCKETS)


def features_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features of texts, about CHUNK bytes at a time: (texts' numbers, their words, (text, bucket) of features).

    A long text comes in pieces; each brings along the last words of the one before, whose own features were told there.
    """
    parts: list[tuple[int, int, bytes]] = []
    held = 0

    def told() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        joined = b" ".join(p for _, _, p in parts)
        start, buckets = _runs(np.frombuffer(joined, np.uint8))
        begins = np.cumsum([0, *(len(p) + 1 for _, _, p in parts)])
        words = np.diff(np.searchsorted(start, begins))
        first = np.repeat(np.cumsum(words) - words, words)
        place = np.arange(len(start)) - first
        fresh = place >= np.repeat([c for _, c, _ in parts], words)
        whole = fresh[None] & (place[None] >= np.arange(LONGEST_RUN)[:, None])
        number = np.repeat([i for i, _, _ in parts], words)
        of = np.broadcast_to(number, whole.shape)
        return np.array([i for i, _, _ in parts]), words - np.minimum(words, [c for _, c, _ in parts]), np.stack((of[whole], buckets[whole].astype(np.int64)))

    for i, text in enumerate(texts):
        before: list[bytes] = []
        for p in pieces(text.translate(LETTERS)):
            parts.append((i, len(before), b" ".join([*before, p])))
            held += len(p)
            before = [*before, *p.rsplit(None, LONGEST_RUN - 1)][1 - LONGEST_RUN :]
            if held >= CHUNK:
                yield told()
                parts, held = [], 0
    if parts:
        yield told()


def feature_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket. Each task counts its texts; the driver gets BUCKETS numbers."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, _, f in features_of([t or b"" for t in raw(b.column(0))]):
                n += np.bincount(f[1], minlength=BUCKETS)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(n[held])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandfold logarithm of how much more frequent each bucket is in the target, rounded down."""
    s, t = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([floor(1000 * log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(key: int | None) -> int:
    """Gumbel noise of an id, in thousandths, rounded down; a null id has that of the empty string."""
    h = int(sha256(f"{SEED}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return floor(-1000 * log(-log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in raw(b.column(1))]
            words, n, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
            for i, w, (of, bucket) in features_of(texts):
                np.add.at(words, i, w)
                low = int(i[0])
                many = np.bincount(of - low) if len(of) else np.zeros(0, np.int64)
                n[low : low + len(many)] += many
                # sums of whole numbers below 2^53 are exact in doubles
                weight[low : low + len(many)] += np.bincount(of - low, gain[bucket]).astype(np.int64) if len(of) else 0
            drawn = weight + np.array([noise(k) for k in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (words, n, weight, drawn))], ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


def _digits(rows: DataFrame, value: Column, width: int, k: int) -> tuple[int, int, int]:
    """The k-th smallest of values from 0 to width, how many rows are below it, and how many have it."""
    prefix, below, here = 0, 0, 0
    for shift in reversed(range(0, max(width.bit_length(), 1), DIGIT)):
        same = rows.where(F.shiftright(value, shift + DIGIT) == prefix) if shift + DIGIT < 64 else rows
        found = same.groupBy(F.shiftright(value, shift).bitwiseAND((1 << DIGIT) - 1).alias("digit")).count().collect()
        for digit, here in sorted((r["digit"], r["count"]) for r in found):
            if below + here >= k:
                break
            below += here
        prefix = prefix << DIGIT | digit
    return prefix, below, here


def selected(rows: DataFrame, k: int) -> Column:
    """Whether a row of (score, doc_id) is among the k (at least one) first by score downwards and doc_id upwards; null ids are last.

    Rows equal in both to the k-th are all true. Each pass gives the driver at most 2^DIGIT counts.
    """
    key = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    ends = rows.agg(F.min("score"), F.max("score")).first()
    from_top = F.lit(ends[1]) - F.col("score")
    cut, below, here = _digits(rows, from_top, ends[1] - ends[0], k)
    if below + here == k:
        return from_top <= cut
    ties = rows.where(from_top == cut)
    least, most = ties.agg(F.min(key), F.max(key)).first()
    # the offset of an id from the smallest one fits into 64 bits without a sign, of which 63 are looked at if ids are not negative
    if most - least < 1 << 63:
        last, _, _ = _digits(ties, key - F.lit(least), most - least, k - below)
        return (from_top < cut) | ((from_top == cut) & (key <= F.lit(least + last)))
    n_negative = ties.where(key < 0).count()
    half = ties.where(key < 0) if k - below <= n_negative else ties.where(key >= 0)
    base = -(1 << 63) if k - below <= n_negative else 0
    last, _, _ = _digits(half, key - F.lit(base), (1 << 63) - 1, k - below - (0 if base else n_negative))
    return (from_top < cut) | ((from_top == cut) & (key <= F.lit(base + last)))


def ranked(rows: DataFrame, among: Column, k: int) -> DataFrame:
    """rows (doc_id, n_features, weight, score) with `rank`, from 1, of the k first by score downwards and doc_id upwards among those that `among` holds for; null of all others.

    Repeated rows are ranked one after another.
    """
    if k <= 0:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    chosen = F.coalesce(among, F.lit(False)) & selected(rows.where(among), k)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    # a sort by range: the upper bits of the number are the partition's, the others the row's place in it
    numbered = rows.where(chosen).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    numbered = stage(numbered, "chosen")
    counts = sorted((r["p"], r["count"]) for r in numbered.groupBy(F.shiftright("at", 33).alias("p")).count().collect())
    offset, so_far = [], 0
    for p, n in counts:
        offset.append((p, so_far))
        so_far += n
    offsets = rows.sparkSession.createDataFrame(offset, "p long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    with_rank = numbered.join(F.broadcast(offsets), F.shiftright("at", 33) == F.col("p")).select(*rows.columns, F.when(rank <= k, rank).alias("rank"))
    return rows.where(~chosen).withColumn("rank", F.lit(None).cast("long")).unionByName(with_rank)


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs: percent of those with enough words are drawn, and have a rank.

    A null text has no words. A null id is ranked after equal scores. Repeated rows have equal scores and are drawn one by
    one. Without target texts all gains but those of unequal totals are zero or less. An empty table gives an empty table.
    """
    gain = gains(feature_counts(docs), feature_counts(target))
    rows = stage(scored(docs, gain), "scored")
    enough = F.col("n_words") >= least_words
    return ranked(rows, enough, percent * rows.where(enough).count() // 100)


def op13(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_features, weight, score, rank."""
    return resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


def _oracle() -> str:
    nibble = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        nibble.append(c)
    step = lambda x: f"xor({x} >> 4, ({nibble})[({x} & 15) + 1])"
    run = lambda n: f"SELECT id, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS f FROM x"
    return rf"""WITH x AS (SELECT 'd' AS kind, row_number() OVER () AS id, doc_id, text FROM documents UNION ALL SELECT 'b', -row_number() OVER (), NULL, text FROM benchmark),
 y AS (SELECT id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
 f AS (SELECT id, f, count(*) AS n FROM ({" UNION ALL ".join(run(n).replace("FROM x", "FROM y") for n in (1, 2, 3))}) GROUP BY id, f),
 c AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(f) + 1), lambda i: ('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::BIGINT)),
   lambda c, b: list_transform(list_transform([xor(c, b)], lambda x: {step("x")}), lambda x: {step("x")})[1])) % {BUCKETS} AS bucket FROM (SELECT DISTINCT f FROM f)),
 h AS (SELECT id, bucket, sum(n) AS n FROM f JOIN c USING (f) GROUP BY id, bucket),
 s AS (SELECT bucket, sum(n) FILTER (id > 0) AS s, sum(n) FILTER (id < 0) AS t FROM h GROUP BY bucket),
 g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + {BUCKETS})::DOUBLE)))::BIGINT AS gain
   FROM s, (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM s)),
 k AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM h JOIN g USING (bucket) GROUP BY id),
 v AS (SELECT id, doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
   coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
   FROM y LEFT JOIN k USING (id) WHERE id > 0),
 r AS (SELECT id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank FROM v WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT {PERCENT} * count(*) // 100 FROM r) THEN rank END AS rank FROM v LEFT JOIN r USING (id)"""


ORACLE_SQL = _oracle()
