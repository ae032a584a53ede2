"""Benchmark passages in training texts: an FM-index of every shard of documents, searched backwards with all test phrases at once.

Words of the documents become numbers of the benchmark's words; any other word ends a run, and so does a text. Runs long enough
to hold a phrase make up a shard's sequence, of which the suffix array, the Burrows-Wheeler transform and its wavelet tree are
built as arrays. A phrase is looked up from its last word to its first, narrowing an interval of suffixes by two ranks a word, for
all phrases side by side. Suffixes in the intervals left are located by walking to the next sampled position. Places in the
texts are merged into spans. Shards are made where texts lie: nothing is shuffled, and phrases go to the texts in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.shared import neutral, raw
from tarnlake.llm.words import LETTERS, pieces

WINDOW = 10
#: Words of a shard's sequence, about, and every how many positions of it are kept in the samples.
SHARD, SAMPLE = 1 << 20, 8
#: Words of the items that are searched for together, about.
BLOCK = 1 << 21
#: Words of an item between two cuts: longer items come in parts that overlap by a window.
PART = 1 << 16

SPANS = "array<struct<start:bigint,end:bigint>>"


@dataclass
class FmIndex:
    """The Burrows-Wheeler transform of a sequence of numbers from 0, in a wavelet tree by levels, and its sampled suffix positions."""

    zeros: list[np.ndarray]
    splits: list[int]
    starts: np.ndarray
    sampled: np.ndarray
    positions: np.ndarray

    @classmethod
    def of(cls, sequence: np.ndarray, size: int) -> FmIndex:
        """The index of a sequence of numbers below `size`; it goes around, so its last number should stand nowhere else."""
        order = _suffixes(sequence)
        last = sequence[order - 1]
        bits = max(int(size - 1).bit_length(), 1)
        zeros, splits, level = [], [], last
        for b in reversed(range(bits)):
            off = (level >> b & 1) == 0
            zeros.append(np.concatenate(([0], np.cumsum(off, dtype=np.int32))).astype(np.int32))
            splits.append(int(zeros[-1][-1]))
            level = np.concatenate((level[off], level[~off]))
        starts = np.concatenate(([0], np.cumsum(np.bincount(sequence, minlength=size))))
        kept = order % SAMPLE == 0
        return cls(zeros, splits, starts, np.concatenate(([0], np.cumsum(kept, dtype=np.int32))).astype(np.int32), order[kept])

    def rank(self, number: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each number stands in the transform before each place."""
        low = np.zeros_like(at)
        for zeros, split, b in zip(self.zeros, self.splits, reversed(range(len(self.zeros))), strict=True):
            one = (number >> b & 1).astype(bool)
            zl, za = zeros[low], zeros[at]
            low, at = np.where(one, split + low - zl, zl), np.where(one, split + at - za, za)
        return at - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number at each place of the transform, and its rank there."""
        number, low = np.zeros_like(at), np.zeros_like(at)
        for zeros, split in zip(self.zeros, self.splits, strict=True):
            za, zl = zeros[at], zeros[low]
            one = zeros[at + 1] == za
            number = number << 1 | one
            at, low = np.where(one, split + at - za, za), np.where(one, split + low - zl, zl)
        return number, at - low

    def intervals(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that begin with each phrase, from and to; phrases end at the right of their row."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.sampled) - 1, np.int64)
        for k in range(1, phrases.shape[1] + 1):
            go = np.flatnonzero((sizes >= k) & (low < high))
            if not len(go):
                break
            c = phrases[go, -k]
            low[go], high[go] = self.starts[c] + self.rank(c, low[go]), self.starts[c] + self.rank(c, high[go])
        return low, np.maximum(high, low)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """The places in the sequence of suffixes."""
        out, walked, open_ = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.arange(len(at))
        at = at.copy()
        while len(open_):
            here = at[open_]
            done = self.sampled[here + 1] > self.sampled[here]
            out[open_[done]] = self.positions[self.sampled[here[done]]] + walked[open_[done]]
            open_, here = open_[~done], here[~done]
            number, rank = self.access(here)
            at[open_] = self.starts[number] + rank
            walked[open_] += 1
        return out


def _suffixes(sequence: np.ndarray) -> np.ndarray:
    """The suffix array by doubling: of each pass only suffixes that are not yet alone in their place go on."""
    n = len(sequence)
    order = np.argsort(sequence, kind="stable")
    ranks = np.empty(n, np.int64)

    def settle(at: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Gives suffixes at the places `at` of the order their ranks; where `new` holds another group begins. What shares a rank is returned."""
        group = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        ranks[order[at]] = group
        alone = new & np.concatenate((new[1:], [True]))
        return at[~alone]

    s = sequence[order]
    left, step = settle(np.arange(n), np.concatenate(([True], s[1:] != s[:-1]))), 1
    while len(left):
        who = order[left]
        first, second = ranks[who], ranks[np.minimum(who + step, n - 1)]
        by = np.argsort(first * n + second, kind="stable")
        order[left], first, second = who[by], first[by], second[by]
        left, step = settle(left, np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))), step * 2
    return order


@dataclass
class Phrases:
    """Distinct windows of a block of items: numbers of words (from 1; 0 is none), a row per window, right-aligned, and the items that have it."""

    words: dict[bytes, int]
    windows: np.ndarray
    sizes: np.ndarray
    #: Window w is of the items from[w]:from[w+1] of `items`, which are numbers of `names`.
    begins: np.ndarray
    items: np.ndarray
    names: list[str | None]

    @classmethod
    def of(cls, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> Phrases:
        words: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        names: dict[str | None, int] = {}
        for name, text in items:
            numbers = [words.setdefault(w, len(words) + 1) for w in text]
            at = names.setdefault(name, len(names))
            for i in range(max(1, len(numbers) - window + 1)):
                if numbers:
                    found.setdefault(tuple(numbers[i : i + window]), set()).add(at)
        rows = np.zeros((len(found), window), np.int64)
        for row, w in zip(rows, found, strict=True):
            row[window - len(w) :] = w
        sizes = np.array([len(w) for w in found], np.int64)
        begins = np.cumsum([0, *map(len, found.values())])
        return cls(words, rows, sizes, begins, np.array([x for v in found.values() for x in sorted(v)], np.int64), list(names))


class _Shard:
    """Runs of words of several texts, to be searched together."""

    def __init__(self) -> None:
        self.runs: list[np.ndarray] = []
        self.text: list[int] = []
        self.at: list[int] = []
        self.size = 0

    def add(self, text: int, at: int, numbers: np.ndarray, least: int) -> None:
        """Adds the runs of known words of a text that are long enough; its first word is number `at`."""
        ended = np.concatenate((numbers, [0]))
        known = np.concatenate(([False], ended > 0))
        edge = np.flatnonzero(known[1:] != known[:-1])
        start, end = edge[::2], edge[1::2]
        for i in np.flatnonzero(end - start >= least).tolist():
            a, b = int(start[i]), int(end[i]) + 1
            self.runs.append(ended[a:b])
            self.text.append(text)
            self.at.append(at + a)
            self.size += b - a

    def search(self, p: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(window, text, from, to) of every place of every window."""
        # a run ends in 0, the sequence in a number of its own
        end = len(p.words) + 1
        sequence = np.concatenate(self.runs)
        sequence[-1] = end
        fm = FmIndex.of(sequence, end + 1)
        low, high = fm.intervals(p.windows, p.sizes)
        n = high - low
        window = np.repeat(np.arange(len(n)), n)
        rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + low[window]
        # equal windows have equal suffixes: places are found a bounded number at a time
        place = np.concatenate([np.zeros(0, np.int64), *(fm.locate(rows[i : i + SHARD]) for i in range(0, len(rows), SHARD))])
        begins = np.cumsum([0, *map(len, self.runs[:-1])])
        run = np.searchsorted(begins, place, "right") - 1
        start = np.array(self.at)[run] + place - begins[run]
        return window, np.array(self.text)[run], start, start + p.sizes[window]


def _found(texts: list[bytes], p: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(window, text, from, to) of every place of the windows in texts, a shard at a time; long texts lie in several shards, cut with an overlap."""
    least = int(p.sizes.min(initial=WINDOW))
    overlap = int(p.sizes.max(initial=1)) - 1
    shard = _Shard()
    for i, text in enumerate(texts):
        at, before = 0, np.zeros(0, np.int64)
        for piece in pieces(text.translate(LETTERS)):
            w = piece.split()
            numbers = np.concatenate((before, np.fromiter(map(p.words.get, w, repeat(0)), np.int64, len(w))))
            shard.add(i, at - len(before), numbers, least)
            at, before = at + len(w), numbers[len(numbers) - min(overlap, len(numbers)) :]
            if shard.size >= SHARD:
                yield shard.search(p)
                shard = _Shard()
    if shard.runs:
        yield shard.search(p)


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order, those that touch or overlap as one."""
    by = np.argsort(start, kind="stable")
    start, reach = start[by], np.maximum.accumulate(end[by])
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    return start[new], reach[np.concatenate((new[1:], [True]))]


def _search(p: Phrases, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds what a block of phrases finds to the columns `spans` and `items`; `at` is the place of the text, the two come last."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in raw(b.column(at))]
            spans: list[list[tuple[int, int]]] = [[(s["start"], s["end"]) for s in x] for x in b.column(b.num_columns - 2).to_pylist()]
            items: list[set[str]] = [set(x) for x in b.column(b.num_columns - 1).to_pylist()]
            for window, text, start, end in _found(texts, p):
                by = np.argsort(text, kind="stable")
                cut = np.flatnonzero(np.concatenate(([True], np.diff(text[by]) != 0, [True]))) if len(by) else []
                for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                    here, i = by[lo:hi], int(text[by[lo]])
                    old = np.array(spans[i], np.int64).reshape(-1, 2)
                    s, e = _merged(np.concatenate((old[:, 0], start[here])), np.concatenate((old[:, 1], end[here])))
                    spans[i] = list(zip(s.tolist(), e.tolist(), strict=True))
                    w = np.unique(window[here])
                    own = np.unique(np.concatenate([p.items[p.begins[x] : p.begins[x + 1]] for x in w]))
                    items[i].update(p.names[x] for x in own if p.names[x] is not None)
            told = [pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], span), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *told], b.schema.names)

    return run


def _words(text: bytes) -> list[bytes]:
    return [w for p in pieces(text.translate(LETTERS)) for w in p.split()]


def _parts(items: DataFrame, window: int) -> DataFrame:
    """(item, n, part, words): items in parts of PART words, each with the last window - 1 words of the one before; items without words are absent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, text in zip(b.column(0).to_pylist(), raw(b.column(1)), strict=True):
                w = _words(text or b"")
                for k in range(0, max(len(w) - window + 1, min(len(w), 1)), PART):
                    part = w[k : k + PART + window - 1]
                    rows.append((name, len(part), b" ".join(part).decode()))
            names, sizes, words = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(words, pa.string())], ["item", "n", "words"])

    return items.select(F.col("item_id").cast("string"), "text").mapInArrow(run, "item string, n long, words string")


def _blocks(items: DataFrame, window: int) -> Iterator[Phrases]:
    """The phrases of all items in blocks of about BLOCK words; the driver holds one block at a time."""
    # items go out in order of a hash, so that parts can be read one partition after another, and equal ones lie together
    parts = _parts(items, window)
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n = max(1, -(-total // BLOCK))
    held: list[tuple[str | None, list[bytes]]] = []
    size = 0
    for r in parts.repartition(n, F.xxhash64("words")).toLocalIterator():
        held.append((r["item"], r["words"].encode().split()))
        size += r["n"]
        if size >= BLOCK:
            yield Phrases.of(held, window)
            held, size = [], 0
    if held:
        yield Phrases.of(held, window)


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (text, ...) with `spans`, the words of the text (from 0, end exclusive) that stand in some window of an item (item_id, text), and `items`, the ids of those items in order.

    A window is `window` consecutive words of an item, or all of a shorter one. Spans that touch are one. A null or empty text
    has none, and neither has an item without words. Items of one id are one item; those of a null id count for spans and are
    not named. Rows are judged one by one, other columns stay as they are.
    """
    d = neutral(docs, "text")
    out = d.select("*", F.expr(f"cast(array() as {SPANS})").alias("__spans"), F.expr("cast(array() as array<string>)").alias("__items"))
    for p in _blocks(items, window):
        out = out.mapInArrow(_search(p, d.columns.index("text")), out.schema)
    return out.toDF(*docs.columns, "spans", "items")


_word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _without(text: str, spans: list[dict[str, int]]) -> str:
    """A text without its spans of words; what stands between the last word before and the first word after a span goes with it, but for one space."""
    places = [m.span() for m in _word.finditer(text)]
    out, at = [], 0
    for s in spans:
        out.append(text[at : places[s["start"]][0]])
        at = places[s["end"] - 1][1]
    return "".join(out) + text[at:]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the columns of docs, the words of all spans cut out of the texts; nulls stay null, and texts without a span stay as they are."""
    plain = neutral(docs, "text")
    found, at = contaminated(plain, items, window), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if not s else _without(t, s) for t, s in zip(b.column(at).to_pylist(), b.column(b.num_columns - 2).to_pylist(), strict=True)]
            columns = list(b.columns[:-2])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-2])

    return found.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op12(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; of every row."""
    found = contaminated(docs.select("doc_id", "text"), items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [sum(len(p.split()) for p in pieces((t or b"").translate(LETTERS))) for t in raw(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), b.column(2), b.column(3)], ["doc_id", "n_words", "spans", "items"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    x = found.mapInArrow(count, f"doc_id {id_type}, n_words long, spans {SPANS}, items array<string>")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return x.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


ORACLE_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 p AS (SELECT DISTINCT item_id, n, array_to_string(w[pos:pos + n - 1], ' ') AS f FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS pos FROM i WHERE len(w) > 0)),
 q AS (SELECT r, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS f FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
 h AS (SELECT r, pos, n, item_id FROM q JOIN p USING (n, f)),
 k AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS x FROM (SELECT DISTINCT r, pos, n FROM h)) GROUP BY r),
 l AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN k USING (r) LEFT JOIN l USING (r)"""
