"""SimHash near-duplicates found with pivot distance tables.

Every distinct fingerprint is described by its Hamming distances to reference fingerprints (pivots), kept for
each of six segments of its 64 bits. By the triangle inequality two fingerprints at most r bits apart differ by
at most r in every coordinate; that is the filter. To reach partners without comparing all pairs, note that r = 4
differing bits leave at least two of the six segments untouched, and an untouched segment has equal pivot
coordinates: fingerprints meet in a bucket per pair of segments with equal coordinates. In a bucket, rows are
sorted by one coordinate, pairs whose coordinates differ by more than r are discarded, and survivors are verified
by XOR. Buckets of many fingerprints are cut into blocks and every pair of blocks is a group of its own, so no
task holds an unbounded bucket and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.llm.components import connected_components
from tarnlake.llm.shared import LOWER, mix, neutral, raw, stage, unstage
from tarnlake.llm.words import runs_of

SEED = 42
MAX_BITS = 4
#: Bits of the six segments; four differing bits leave two of them equal.
SEGMENTS = (11, 11, 11, 11, 10, 10)
PIVOTS = 24
BLOCK = 1024
#: deduplicate(): words of a shingle, least similarity as a fraction, and 64-bit words of a set's parity bits, at least.
SHINGLE, SIMILAR, PARITY = 5, (4, 5), 8
#: Bits in which first candidates may differ, closest first; they are verified, so the filter may be wide.
WIDE_BITS = (2, MAX_BITS, 8, 14)
#: Shingles found so often among a task's HELD distinct ones are put last in the order of shingles, at most COMMON of them;
#: those found HOT times have their entries dealt to SPREAD partitions.
OFTEN, HELD, COMMON, HOT, SPREAD = 3, 1 << 20, 1 << 19, 512, 256
#: Bits of the filter of classes whose sets are kept.
LIVE = 1 << 26
#: Candidates that a task holds before it hands them on.
PAIRS = 1 << 17

_shift = np.cumsum([0, *SEGMENTS[:-1]]).astype(np.uint64)
_mask = np.array([(1 << n) - 1 for n in SEGMENTS], np.uint64) << _shift
_pivot = mix(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_weight = mix(np.arange(1, PIVOTS * 6 + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).reshape(PIVOTS, 6) | np.uint64(1)
_pairs = list(combinations(range(6), 2))


def shingles(text: bytes, words: int) -> list[bytes]:
    """Space-joined runs of so many words, repeats included; the whole sequence if there are fewer; none without a word."""
    found = text.translate(LOWER).split()
    if not found:
        return []
    flat = b" ".join(found)
    if len(found) <= words:
        return [flat]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [flat[a:b] for a, b in zip(starts[: 1 - words or None].tolist(), ends[words - 1 :].tolist(), strict=True)]


def hashes(items: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_xxh64, items), np.uint64, len(items))


def _xxh64(item: bytes, digest=xxhash.xxh64_intdigest) -> int:
    return digest(item, SEED)


def simhash(h: np.ndarray) -> int:
    """The fingerprint whose bits are set in over half of the hashes; zero for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        counts += np.unpackbits(h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h)).tobytes(), "big")


def coordinates(fp: np.ndarray) -> np.ndarray:
    """Hamming distances to each pivot within each segment: (rows, pivots, segments)."""
    return np.bitwise_count((fp[:, None, None] ^ _pivot[None, :, None]) & _mask[None, None, :])


def bucket_keys(table: np.ndarray) -> np.ndarray:
    """A key for every pair of segments from their pivot coordinates: (rows, 15)."""
    per_segment = (table * _weight[None]).sum(1, dtype=np.uint64)
    return np.stack([mix(per_segment[:, i] + mix(per_segment[:, j] + np.uint64(n))) for n, (i, j) in enumerate(_pairs)], 1)


def link_bucket_rows(bucket: np.ndarray, fp: np.ndarray, tiers: tuple[int, ...] = (MAX_BITS,)) -> list[tuple[int, int]]:
    """Positions of linked rows that span the links within each bucket; rows must be sorted by bucket.

    Links are at most tiers[-1] bits long; those of an earlier tier come first, so that closer rows are linked rather
    than farther ones. Bounded by the sum over buckets of rows times those with a first coordinate within reach.
    """
    table = coordinates(fp).sum(2, dtype=np.int16)
    order = np.lexsort((table[:, 0], bucket))
    bucket, fp, table = bucket[order], fp[order], table[order]
    root = list(range(len(fp)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for bits in tiers:
        for step in range(1, len(fp)):
            near = np.flatnonzero((bucket[step:] == bucket[:-step]) & (table[step:, 0] - table[:-step, 0] <= bits))
            if not len(near):
                break
            for p in range(1, PIVOTS):
                near = near[np.abs(table[near + step, p] - table[near, p]) <= bits]
            near = near[np.bitwise_count(fp[near + step] ^ fp[near]) <= bits]
            for i in near.tolist():
                a, b = find(i), find(i + step)
                if a != b:
                    root[b] = a
                    out.append((int(order[i]), int(order[i + step])))
    return out


def _fingerprint_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [simhash(hashes(shingles(t or b"", words))) for t in raw(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprint(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) of every row; a null text is an empty one."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprint_batches(words), "doc_id long, fp long")


def _band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rep, fp = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
        for at in range(0, len(fp), 4096):
            keys = bucket_keys(coordinates(fp[at : at + 4096]))
            n = keys.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(rep[at : at + 4096], n)), pa.array(np.repeat(fp[at : at + 4096], n).view(np.int64))],
                ["key", "rep", "fp"],
            )


def _link(tiers: tuple[int, ...]):
    """Links within groups (key, lo, hi) of a sorted partition; a group may go over several batches."""
    def emit(group: np.ndarray, rep: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        found = np.array(link_bucket_rows(group, fp.view(np.uint64), tiers), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(rep[found[:, 0]]), pa.array(rep[found[:, 1]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            rows = np.stack([b.column(i).to_numpy() for i in range(5)], 1)
            if not len(rows):
                continue
            held.append(rows)
            rows = np.concatenate(held)
            group = np.concatenate(([0], np.cumsum((rows[1:, :3] != rows[:-1, :3]).any(1))))
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield emit(group[:cut], rows[:cut, 3], np.ascontiguousarray(rows[:cut, 4]))
            held = [rows[cut:]]
        if held:
            rows = held[0]
            yield emit(np.zeros(len(rows), np.int64), rows[:, 3], np.ascontiguousarray(rows[:, 4]))

    return run


def links(reps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that span all pairs of (rep, fp) rows at most four bits apart. Distinct fingerprints are expected.

    Buckets of one row are dropped at once; larger ones than `block` are dealt out as pairs of blocks.
    """
    return linked(reps.select("rep", "fp").mapInArrow(_band, "key long, rep long, fp long"), block)


def linked(bands: DataFrame, block: int = BLOCK, tiers: tuple[int, ...] = (MAX_BITS,)) -> DataFrame:
    """Links within the buckets of (key, rep, fp) rows; for more than MAX_BITS bits those that share a bucket."""
    sizes = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / F.lit(block)).cast("long")
    own = F.pmod(F.xxhash64("rep"), parts)
    dealt = (
        bands.join(sizes, "key")
        .select("key", "rep", "fp", own.alias("own"), parts.alias("parts"))
        .select("key", "rep", "fp", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "rep", "fp")
    )
    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_link(tiers), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp, component_id, n_links) of every row of docs.

    Rows with the same fingerprint are one class; classes link at MAX_BITS or fewer differing bits, transitively.
    component_id is the smallest doc_id reachable, n_links the number of spanning links of the row's class.
    Null or empty texts have fingerprint zero and link like any other; rows with a null doc_id belong to their
    class but never name it (a class of such rows only has a null component_id); repeated doc_ids each get a row.
    Other columns of docs are ignored. An empty table gives an empty table.
    """
    marks = stage(fingerprint(docs, words), "fingerprints")
    reps = marks.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null")
    found = stage(links(reps).distinct(), "pairs")
    groups = connected_components(found)
    degree = found.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    classes = (
        reps.join(groups, reps.rep == groups.id, "left").drop("id").join(degree, F.col("rep") == degree.id, "left")
        .select(F.col("fp").alias("class_fp"), F.coalesce("component", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    return marks.join(classes, F.col("fp").eqNullSafe(F.col("class_fp")), "left").drop("class_fp")


def op1(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, fingerprint (16 hex digits), component_id, and n_links."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def _classes(h: np.ndarray, counts: np.ndarray) -> list[int]:
    """A hash of each text's word sequence."""
    ends = np.cumsum(counts)
    place = np.arange(len(h)) - np.repeat(ends - counts, counts)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * (mix((place + 1).astype(np.uint64)) | np.uint64(1)), dtype=np.uint64)))
    return mix(sums[ends] - sums[ends - counts]).tolist()


class _Seen:
    """Classes that a task has met, the last so many of them: copies need not be looked at again."""

    def __init__(self, most: int = 1 << 20) -> None:
        self.most, self.met = most, set()

    def fresh(self, cls: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cls), bool)
        for i, c in enumerate(cls.tolist()):
            if c not in self.met:
                out[i] = True
                if len(self.met) >= self.most:
                    self.met.clear()
                self.met.add(c)
        return out


def _shingle_set(w: np.ndarray) -> np.ndarray:
    """The sorted hashes of all shingles of a text of the word hashes w."""
    run = w[: max(1, len(w) - SHINGLE + 1)].copy()
    for i in range(1, min(SHINGLE, len(w))):
        run = mix(run) + w[i : i + len(run)]
    return np.unique(mix(run))


def _set_runs(texts: list[bytes | None], keep=None) -> Iterator[tuple[int, np.ndarray, list[int], list[np.ndarray]]]:
    """Runs of texts of bounded size: the place of the first, the classes of all, and places and shingle sets of those that keep(classes) lets through."""
    for first, h, counts in runs_of(texts):
        cls = np.array(_classes(h, counts), np.uint64)
        at = np.concatenate(([0], np.cumsum(counts)))
        kept = range(len(cls)) if keep is None else np.flatnonzero(keep(cls)).tolist()
        yield first, cls, list(kept), [_shingle_set(h[at[k] : at[k + 1]]) for k in kept]


def parity(shingles: np.ndarray) -> bytes:
    """A bit for each remainder of a division: whether an odd number of shingles has it. Two sets differ in at least as many shingles as their bits do.

    There are PARITY * 64 bits, or more by a power of two for a large set; folded() brings them down again.
    """
    n = PARITY * 64
    while n < 2 * len(shingles):
        n *= 2
    at = (shingles % np.uint64(n)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=n) & 1).astype(np.uint8)).tobytes()


def folded(bits: bytes, size: int = PARITY * 8) -> np.ndarray:
    """The parity bits of fewer remainders, in bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size), axis=0)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: a hash of its word sequence, the fingerprint of its distinct words, and size and parity bits of its shingle set."""
    for b in batches:
        for first, h, counts in runs_of(raw(b.column(1))):
            at = np.concatenate(([0], np.cumsum(counts)))
            spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            fps = [simhash(mix(np.unique(h[lo:hi]))) for lo, hi in spans]
            cls = np.array(_classes(h, counts), np.uint64).view(np.int64)
            sets = [_shingle_set(h[lo:hi]) for lo, hi in spans]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(first, len(counts)), pa.array(cls), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array([len(x) for x in sets], pa.int64()), pa.array([parity(x) for x in sets], pa.binary())],
                ["doc_id", "cls", "fp", "n", "bits"],
            )


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles found OFTEN in a task's texts of about HELD distinct shingles, and how often."""
    held, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def often() -> pa.RecordBatch:
        kept = counts >= OFTEN
        return pa.RecordBatch.from_arrays([pa.array(held[kept].view(np.int64)), pa.array(counts[kept])], ["h", "n"])

    for b in batches:
        for *_, sets in _set_runs(raw(b.column(0))):
            own, n = np.unique(np.concatenate(sets), return_counts=True)
            held, at = np.unique(np.concatenate([held, own]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(held)).astype(np.int64)
            if len(held) > HELD:
                yield often()
                held, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    yield often()


def _prefixes(common: np.ndarray, times: np.ndarray):
    """(key, rep, n, at, part): the first shingles of each set in the order of (how common, hash), and their places; part spreads the keys found HOT times.

    Two sets of n shingles or more and a similarity of SIMILAR share one of their first n - ceil(SIMILAR * n) + 1, whatever the order is.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for b in batches:
            for _, cls, kept, sets in _set_runs(raw(b.column(0)), seen.fresh):
                if not kept:
                    continue
                h, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
                row = np.repeat(np.arange(len(sizes)), sizes)
                often = np.zeros(len(h), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    often = np.where(common[at] == h, times[at], 0)
                order = np.lexsort((h, often, row))
                place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                first = place < (sizes - -(-sizes * SIMILAR[0] // SIMILAR[1]) + 1)[row]
                chosen, of = order[first], row[first]
                rep = cls[kept][of]
                part = np.where(often[chosen] >= HOT, 1 + (rep % np.uint64(SPREAD)).astype(np.int64), 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[chosen].view(np.int64)), pa.array(rep.view(np.int64)), pa.array(sizes[of].astype(np.int32)), pa.array(place[first].astype(np.int32)), pa.array(part.astype(np.int32))],
                    ["key", "rep", "n", "at", "part"],
                )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by (key, rep) those once whose key has another rep, and all of HOT keys; one row is held, whatever the size of a group."""
    last, told = np.zeros((0, 5), np.int64), False
    for b in batches:
        rows = np.concatenate([last, np.stack([b.column(k).to_numpy() for k in range(5)], 1)])
        rows = rows[np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(1)))] if len(rows) else rows
        if not len(rows):
            continue
        same = rows[1:, 0] == rows[:-1, 0]
        shared = np.concatenate(([False], same)) | np.concatenate((same, [False])) | (rows[:, 4] > 0)
        now = shared.copy()
        if len(last):
            now[0] &= not told
            told = bool(shared[-1]) if len(rows) > 1 else told or bool(shared[0])
        else:
            told = bool(shared[-1])
        last, out = rows[-1:], rows[now]
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(out[:, 2].astype(np.int32)), pa.array(out[:, 3].astype(np.int32))], ["key", "rep", "n", "at"])


def _sets(live: np.ndarray):
    """(cls, shingles): the sorted hashes of all shingles of each text whose class's bit is set in live."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        wanted = lambda cls: (live[(cls & np.uint64(LIVE - 1)) >> np.uint64(6)] >> (cls & np.uint64(63)) & np.uint64(1)).astype(bool) & seen.fresh(cls)
        for b in batches:
            for _, cls, kept, sets in _set_runs(raw(b.column(0)), wanted):
                yield pa.RecordBatch.from_arrays([pa.array(cls[kept].view(np.int64)), pa.array([x.tobytes() for x in sets], pa.binary())], ["cls", "shingles"])

    return run


def _enough(shared: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether so many shared shingles make sets of x and y shingles similar: SIMILAR or more of the union."""
    return shared * (SIMILAR[0] + SIMILAR[1]) >= SIMILAR[0] * (x + y)


def bucket_candidates(group: np.ndarray, n: np.ndarray, at: np.ndarray, component: np.ndarray, own: np.ndarray, single: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within a group that may be similar and are of different components, in runs of bounded size.

    Left out are only pairs whose sizes, places of the shared shingle (of their first one, if similar), or parity bits rule it out;
    in a group of two blocks, those within one block, which has a group of its own.
    """
    order = np.lexsort((n, group))
    group, n, at, component, own, single, bits = (x[order] for x in (group, n, at, component, own, single, bits))
    left, right, held = [], [], 0
    for step in range(1, len(n)):
        i = np.flatnonzero((group[step:] == group[:-step]) & (n[:-step] * SIMILAR[1] >= n[step:] * SIMILAR[0]))
        if not len(i):
            break
        j = i + step
        ok = (component[i] != component[j]) & (single[i] | (own[i] != own[j]))
        ok &= _enough(1 + np.minimum(n[i] - at[i] - 1, n[j] - at[j] - 1), n[i], n[j])
        i, j = i[ok], j[ok]
        apart = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
        ok = _enough((n[i] + n[j] - apart) // 2, n[i], n[j])
        left.append(order[i[ok]])
        right.append(order[j[ok]])
        held += len(left[-1])
        if held > PAIRS:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (a, b) of groups (key, lo, hi) of a sorted partition; a group may go over several batches."""
    def emit(rows: np.ndarray, bits: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i, j in bucket_candidates(group, rows[:, 4], rows[:, 5], rows[:, 6], rows[:, 7], rows[:, 1] == rows[:, 2], bits):
            a, b = rows[i, 3], rows[j, 3]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    held, held_bits = np.zeros((0, 8), np.int64), np.zeros((0, PARITY), np.uint64)
    for b in batches:
        if not b.num_rows:
            continue
        rows = np.concatenate([held, np.stack([b.column(k).to_numpy() for k in range(8)], 1)])
        bits = np.concatenate([held_bits, np.frombuffer(b"".join(b.column(8).to_pylist()), np.uint64).reshape(-1, PARITY)])
        group = np.concatenate(([0], np.cumsum((rows[1:, :3] != rows[:-1, :3]).any(1))))
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield from emit(rows[:cut], bits[:cut], group[:cut])
        held, held_bits = rows[cut:], bits[cut:]
    if len(held):
        yield from emit(held, held_bits, np.zeros(len(held), np.int64))


def resemblance(a: bytes, b: bytes, kind: type = np.uint32) -> float:
    """Jaccard similarity of two shingle sets."""
    x, y = np.frombuffer(a, kind), np.frombuffer(b, kind)
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / max(1, len(x) + len(y) - shared)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [resemblance(x, y, np.uint64) * SIMILAR[1] >= SIMILAR[0] for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, m = b.column(2).to_numpy(), b.column(3).to_numpy()
        apart = np.zeros(len(n), np.int64)
        for i, (x, y) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
            size = min(len(x), len(y))
            apart[i] = np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(dtype=np.int64)
        yield b.select(["a", "b"]).filter(pa.array(_enough((n + m - apart) // 2, n, m)))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [resemblance(x, y, np.uint64) * SIMILAR[1] >= SIMILAR[0] for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of classes whose whole shingle sets are similar, staged.

    Sizes and parity bits, which rule out nothing else than pairs surely below SIMILAR, go first; sets are made of the classes left.
    """
    spark = docs.sparkSession
    side = lambda df, name, *columns: df.select(F.col("cls").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])
    small = pairs.join(side(reps, "a", "n", "bits"), "a").join(side(reps, "b", "n", "bits"), "b")
    left = stage(small.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_plausible, "a long, b long"), "plausible")
    live = _live(left.select(F.explode(F.array("a", "b")).alias("rep")))
    sets = stage(docs.select("text").mapInArrow(_sets(live), "cls long, shingles binary").dropDuplicates(["cls"]), "sets")
    whole = left.join(side(sets, "a", "shingles"), "a").join(side(sets, "b", "shingles"), "b").select("a", "b", "shingles_a", "shingles_b")
    out = stage(whole.mapInArrow(_similar, "a long, b long"), "verified")
    unstage(spark, sets)
    unstage(spark, left)
    return out


def shared_shingles(docs: DataFrame) -> DataFrame:
    """(key, rep, n, at, m): the first shingles of the docs' sets that more than one class has, m classes; all similar classes share one."""
    spark, text = docs.sparkSession, docs.select("text")
    common = stage(text.mapInArrow(_common, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "common")
    level = F.floor(F.log2("n") * 64).cast("int")
    least, room = 1 << 20, COMMON
    for r in sorted(common.groupBy(level.alias("level")).agg(F.count("*").alias("m")).collect(), reverse=True):
        if r["m"] > room:
            break
        least, room = r["level"], room - r["m"]
    top = common.where(level >= least).toPandas()
    unstage(spark, common)
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    entries = text.mapInArrow(_prefixes(h[order], top["n"].to_numpy(np.int64)[order]), "key long, rep long, n int, at int, part int")
    met = stage(entries.repartition("key", "part").sortWithinPartitions("key", "rep").mapInArrow(_shared, "key long, rep long, n int, at int"), "entries")
    # the copies of a class from several partitions of a hot key are one row here
    sizes = met.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("key", "m")
    out = stage(met.join(sizes, "key"), "buckets")
    unstage(spark, met)
    return out


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([folded(x).tobytes() for x in b.column(1).to_pylist()], pa.binary())], ["rep", "bits"])


def exact_candidates(buckets: DataFrame, reps: DataFrame, component: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of shared_shingles() that hold all similar ones of different components: prefix, length, positional and parity filters."""
    parts = F.ceil(F.col("m") / F.lit(block)).cast("long")
    known = reps.select("cls", "bits").mapInArrow(_narrow, "rep long, bits binary").join(component.withColumnRenamed("id", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"), "bits")
    dealt = (
        buckets.withColumns({"own": F.pmod(F.xxhash64("rep"), parts), "other": F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))})
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "rep", F.col("n").cast("long"), F.col("at").cast("long"), "own")
        .join(known, "rep").select("key", "lo", "hi", "rep", "n", "at", "component", "own", "bits")
    )
    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_candidates, "a long, b long").distinct()


def _live(buckets: DataFrame) -> np.ndarray:
    """LIVE bits, those of the classes in the buckets set: a filter of bounded size."""
    out = np.zeros(LIVE >> 6, np.uint64)
    low = F.col("rep").bitwiseAND(F.lit(LIVE - 1))
    bit = F.expr("shiftleft(1L, cast(rep & 63 as int))")
    for r in buckets.groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toLocalIterator():
        out[r["word"]] = np.int64(r["bits"]).view(np.uint64)
    return out


def keepers(docs: DataFrame) -> DataFrame:
    """(keep_id, keep_cls, repeated): of each group of near-duplicates the row that stays, the one of the least doc_id (null last), and whether several rows have that id and class.

    Texts are linked if the sets of their five-word shingles have a Jaccard similarity of SIMILAR or more, which is decided on
    the whole sets. Close fingerprints are verified first; what they leave in different groups is then looked for among
    exact_candidates(), so that no link between groups is missed. Texts of the same words are one class. Whole sets are made
    only of classes in a pair that sizes and parity bits leave open.
    """
    spark = docs.sparkSession
    marks = stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_marks, "doc_id long, cls long, fp long, n long, bits binary"), "marks")
    reps = stage(marks.groupBy("cls").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("fp", "n", "bits")]), "reps")
    close = linked(reps.select(F.col("cls").alias("rep"), "fp").mapInArrow(_band, "key long, rep long, fp long"), tiers=WIDE_BITS).distinct()
    found = verified(close, reps, docs)
    buckets = shared_shingles(docs)
    more = verified(exact_candidates(buckets, reps, connected_components(found)), reps, docs)
    unstage(spark, buckets)
    component = connected_components(found.unionByName(more))
    named = reps.select("cls", "least").join(component, F.col("cls") == F.col("id"), "left")
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "cls")).alias("x")
    kept = named.groupBy(F.coalesce("component", "cls").alias("group")).agg(first).select(F.col("x.least").alias("keep_id"), F.col("x.cls").alias("keep_cls"))
    several = marks.groupBy("doc_id", "cls").agg(F.count("*").alias("times")).where("times > 1")
    out = stage(kept.join(several, F.col("keep_id").eqNullSafe(F.col("doc_id")) & (F.col("keep_cls") == F.col("cls")), "left").select("keep_id", "keep_cls", F.col("times").isNotNull().alias("repeated")), "keepers")
    for df in (marks, reps, found, more):
        unstage(spark, df)
    return out


def _with_class(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls = np.array([c for _, h, counts in runs_of(raw(b.column(at))) for c in _classes(h, counts)], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cls.view(np.int64))], [*b.schema.names, "__cls"])

    return run


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, with the columns of docs.

    It is the row of the least doc_id; of repeated rows of that id and those words the one of the least text stays, of equal
    texts the one whose other columns come first as JSON. Null and empty texts have the same (no) words and are one group;
    rows without an id stay only if their whole group has none. An empty table gives an empty table. Texts move once at most,
    by doc_id and class; where the ids that stay are few, not at all.
    """
    d = neutral(docs, "doc_id", "text")
    schema = T.StructType([*d.schema.fields, T.StructField("__cls", T.LongType())])
    marked = d.mapInArrow(_with_class(d.columns.index("text")), schema)
    kept = keepers(d)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("keep_id")) & (F.col("__cls") == F.col("keep_cls"))
    out = marked.join(kept.where("not repeated"), same, "left_semi").select(*d.columns)
    if kept.where("repeated").head(1):
        row = F.struct(*d.columns)
        order = F.struct("text", F.to_json(F.struct(*[c for c in d.columns if c != "text"])))
        one = marked.join(kept.where("repeated"), same, "left_semi").groupBy(F.col("doc_id").cast("long").alias("i"), "__cls").agg(F.min_by(row, order).alias("row"))
        out = out.unionByName(one.select("row.*"))
    return out.toDF(*docs.columns)
