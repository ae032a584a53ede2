"""Improbable-feature digests: rare byte windows in chained Bloom filters, compared by normalised bit overlap.

Every window of WINDOW bytes has the Shannon entropy of its bytes. Windows are ranked by how rare such an entropy
is in prose (far from its usual level first; nearly constant windows last). In each run of NEIGHBOURS windows the
rarest one scores a point, and windows of at least POINTS points are the features; if there is none, those of the most
points are. A feature sets HASHES bits of a
filter of FILTER_BITS bits; after PER_FILTER features a new filter is begun.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.shared import mix, raw

WINDOW = 64
NEIGHBOURS = 64
POINTS = 16
FILTER_BITS = 2048
PER_FILTER = 160
HASHES = 5
#: Usual entropy of a window of prose and its spread, in bits; below FLAT bits a window says little.
USUAL, SPREAD, FLAT = 3.7, 0.35, 1.5
_UNIT = 1 << 16
_plog = np.concatenate(([0], np.round(np.arange(1, WINDOW + 1) * np.log2(np.arange(1, WINDOW + 1)) * _UNIT))).astype(np.int32)
_power = mix(np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
CHUNK = 1 << 18
ROWS = 5000
MOST_PARTS = 20_000


def window_entropy(b: np.ndarray) -> np.ndarray:
    """Entropy in 1/65536 bit of each window of b (at least WINDOW bytes): how often a byte stands among the WINDOW - 1 before and after it gives the change from window to window."""
    n = len(b)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for lag in range(1, WINDOW):
        same = (b[lag:] == b[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    first = int(_plog[np.bincount(b[:WINDOW], minlength=256)].sum())
    leaves, enters = after[: n - WINDOW].astype(np.int64), before[WINDOW:].astype(np.int64)
    change = (_plog[leaves] - _plog[leaves + 1] + _plog[enters + 1] - _plog[enters]).astype(np.int64)
    total = np.concatenate(([first], first + np.cumsum(change)))
    return 6 * _UNIT - total // WINDOW


def _ranks(entropy: np.ndarray) -> np.ndarray:
    """Smaller is rarer."""
    off = np.minimum(np.abs(entropy / _UNIT - USUAL) / SPREAD, 12.0)
    rank = ((12.0 - off) * 1000).astype(np.int64)
    rank[entropy < FLAT * _UNIT] = 1 << 20
    return rank


def features(texts: list[bytes]) -> list[np.ndarray]:
    """The 64-bit hashes of each text's features, in order. A text shorter than a window is one feature; an empty one has none."""
    long = [t for t in texts if len(t) >= WINDOW]
    found: list[np.ndarray] = []
    if long:
        data = np.frombuffer(b"".join(long), np.uint8)
        entropy = window_entropy(data)
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in long])))
        view = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
        for a, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            n = e - a - WINDOW + 1
            key = (_ranks(entropy[a : a + n]) << 32) | np.arange(n)
            least, width = key, 1
            while width < min(NEIGHBOURS, n):
                step = min(width, min(NEIGHBOURS, n) - width)
                least = np.minimum(least[: len(least) - step], least[step:])
                width += step
            points = np.bincount(least & 0xFFFFFFFF, minlength=n)
            # in flat and periodic text no window may have POINTS points: then those with the most are taken
            at = a + np.flatnonzero(points >= min(POINTS, points.max()))
            own = []
            for k in range(0, len(at), CHUNK):
                words = np.ascontiguousarray(view[at[k : k + CHUNK]]).view("<u8").astype(np.uint64)
                own.append(mix((mix(words) * _power).sum(1, dtype=np.uint64)))
            found.append(np.concatenate(own))
    rest = iter(found)
    return [next(rest) if len(t) >= WINDOW else np.frombuffer(sha256(t).digest()[:8], "<u8").astype(np.uint64) if t else np.zeros(0, np.uint64) for t in texts]


def filters(feature: np.ndarray) -> np.ndarray:
    """The chained filters (rows of FILTER_BITS / 8 bytes) of a text's features."""
    _, first = np.unique(feature, return_index=True)
    own = feature[np.sort(first)]
    n = -(-len(own) // PER_FILTER)
    bits = np.zeros((n, FILTER_BITS), np.uint8)
    row = np.arange(len(own)) // PER_FILTER
    for k in range(HASHES):
        bits[row, (own >> np.uint64(11 * k)).astype(np.int64) & (FILTER_BITS - 1)] = 1
    return np.packbits(bits, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: for each filter of the text with fewer, its best overlap with one of the other's, beyond what chance gives, averaged. Equal fingerprints: 1; one empty: 0."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0.0
    x, y = a.view("<u8"), b.view("<u8")
    nx, ny = np.bitwise_count(x).sum(1, dtype=np.int64), np.bitwise_count(y).sum(1, dtype=np.int64)
    best = []
    for i in range(len(x)):
        both = np.bitwise_count(y & x[i]).sum(1, dtype=np.int64)
        chance = nx[i] * ny / FILTER_BITS
        fewer = np.minimum(nx[i], ny)
        best.append(np.clip((both - chance) / np.maximum(fewer - chance, 1.0), 0.0, 1.0).max())
    return float(np.mean(best))


def fingerprint(f: np.ndarray) -> str:
    """The filters in hexadecimal, colons between them."""
    return ":".join(row.tobytes().hex() for row in f)


def _key(column: pa.Array) -> np.ndarray:
    """doc_id with null as the least value."""
    return column.fill_null(-(2**63)).to_numpy(zero_copy_only=False)


def _least_of_part(bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = _key(b.column(0))
            part = np.searchsorted(bounds, key, side="right")
            own, at = np.unique(part, return_inverse=True)
            least = np.full(len(own), 2**63 - 1, np.int64)
            np.minimum.at(least, at, key)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(least)], ["part", "least"])

    return run


def _deal(bounds: np.ndarray, first: dict[int, int]):
    """Rows to their part by doc_id; the rows of a part's least doc_id go to the part before as well, as its tail."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = _key(b.column(0))
            part = np.searchsorted(bounds, key, side="right").astype(np.int32)
            tail = np.flatnonzero(np.fromiter((k in first for k in key.tolist()), bool, len(key)))
            for rows, to, is_tail in ((np.arange(len(key)), part, False), (tail, np.array([first[k] for k in key[tail].tolist()], np.int32), True)):
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.full(len(rows), is_tail)), *(b.column(i).take(pa.array(rows)) for i in (0, 1))], ["part", "tail", "doc_id", "text"])

    return run


def _digest_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each text, its edited text and the next one, in order of (part, tail, doc_id)."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    open_ = None  # the last row, until the one after it is known: part, doc_id, text
    waiting: list[tuple[int | None, bytes, bytes]] = []
    size = 0

    def edited(text: bytes, after: bytes) -> tuple[int, bytes]:
        t = text.decode()
        half = len(t) // 2
        # of the next text no more bytes are decoded than `half` code points can have
        return len(t), (t[: len(t) - half] + after[: 4 * half].decode(errors="ignore")[:half]).encode()

    def emit() -> pa.RecordBatch:
        pairs = [edited(t, a) for _, t, a in waiting]
        own = [filters(f) for f in features([t for _, t, _ in waiting])]
        other = [filters(f) for f in features([e for _, e in pairs])]
        # most texts are followed by the next one waiting; only the last one's successor is digested for itself
        after = [own[i + 1] if i + 1 < len(own) and waiting[i][2] is waiting[i + 1][1] else filters(features([waiting[i][2]])[0]) for i in range(len(own))]
        rows = [
            (d, n, sha256(e).hexdigest(), fingerprint(f), fingerprint(g), likeness(f, g), likeness(f, h))
            for (d, _, _), (n, e), f, g, h in zip(waiting, pairs, own, other, after, strict=True)
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for b in batches:
        for part, tail, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), raw(b.column(3)), strict=True):
            text = text or b""
            if open_ is not None and open_[0] == part:
                waiting.append((open_[1], open_[2], text))
                size += len(open_[2])
                if size >= CHUNK:
                    yield emit()
                    waiting, size = [], 0
            open_ = None if tail else (part, doc_id, text)
    if waiting:
        yield emit()


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of docs.

    The next document is the one after it by doc_id, then by text for rows of one id; null ids come first; after the last
    comes the first. A table of one row is followed by itself. A null text is an empty one; an empty text has an
    empty fingerprint, equal to another empty one only. Other columns are ignored; an empty table gives an empty one.

    Texts move once, to ranges of doc_id; a range's least rows are also sent to the range before it, so every row
    finds its successor in its own task, which streams over its rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ids = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("k"))
    n = ids.count()
    parts = max(1, min(MOST_PARTS, -(-n // ROWS)))
    cuts = ids.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("q")).first()["q"] if n and parts > 1 else []
    bounds = np.array(sorted(set(cuts or [])), np.int64)
    least = {r["part"]: r["least"] for r in docs.select("doc_id").mapInArrow(_least_of_part(bounds), "part int, least long").groupBy("part").agg(F.min("least").alias("least")).collect()}
    order = sorted(least)
    first = {least[p]: order[i - 1] for i, p in enumerate(order)}
    dealt = docs.mapInArrow(_deal(bounds, first), "part int, tail boolean, doc_id long, text string")
    moved = dealt.repartitionById(max(1, len(bounds) + 1), F.col("part")).sortWithinPartitions("part", "tail", "doc_id", "text")
    return moved.mapInArrow(_digest_pairs, schema)


op5 = digests
