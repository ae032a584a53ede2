"""Language-model scoring with a hierarchical Pitman-Yor model, seated by Gibbs sampling.

Every word of the training texts, and the beginning of a text, is a context with a restaurant of its own; the dishes are the
words that follow. All these restaurants share one parent, whose customers are their tables and whose base is uniform over
the words and one unknown word. There is no class of words and no cap on contexts or cells (context, word, count).

A sweep seats every cell's customers anew by the Chinese-restaurant rule, given all other cells' tables of the sweep before,
then the parent's customers. A cell seen once has one table in any sweep: it needs no seating, and the numbers of such cells
of a context or a word follow from its count. Random numbers depend on the cell and the sweep alone, so that neither
partitions nor batches change a draw. After BURN_IN sweeps, tables and the parent's predictive probabilities are averaged
over SAMPLES sweeps, and p(w | u) = (c - discount * tables + (strength + discount * tables of u) * parent(w)) / (strength + customers of u).

Texts are held in chunks of some million tokens, words in parts by their hash, cells in parts by that of their key; the numbers
of parts grow with the tokens. What one of them has to tell another is a row of arrays: a chunk tells its distinct words to the
parts of words and is told their numbers and counts, then its distinct pairs to the parts of cells; in a sweep, parts of cells
tell those of words the tables of contexts and words, and are told the sums; at last chunks are told the probabilities of their
words and of their pairs. Nothing is looked up in a table of all words or cells, and nothing but sums goes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.shared import give_back, mix, raw, release, stage, unstage
from tarnlake.llm.words import runs_of

#: A part of words is for 16 * FREQUENT tokens, a part of cells for 4 * TOP.
FREQUENT, TOP = 1 << 19, 1 << 19
BURN_IN, SAMPLES = 2, 3
STRENGTH = 1.0
#: Tokens of a chunk.
HELD = 3 << 19
END, BEGIN = np.uint64(0x454E44), np.uint64(0x424547494E)
_B = np.uint64(0xD1342543DE82EF95)
_HALF, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)

#: A row that tells `target` something: what it is, who tells it, two numbers, and arrays.
ROW = "kind string, target long, source long, n long, m long, p binary, q binary, r binary, s binary, t binary"
_ROW = pa.schema([("kind", pa.string()), *[(k, pa.int64()) for k in ("target", "source", "n", "m")], *[(k, pa.binary()) for k in "pqrst"]])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is 2 modulo 7; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def pack(x: np.ndarray) -> bytes:
    """An array as bytes: the first bytes of all values, then the second ones and so on, compressed."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T) if len(x) else b""
    return len(x).to_bytes(8, "little") + (pa.compress(pa.py_buffer(planes), codec="zstd", asbytes=True) if len(x) else b"")


def unpack(b: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(memoryview(b)[8:], decompressed_size=n * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x.astype(np.uint64), prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def pack_few(x: np.ndarray) -> bytes:
    """An array of few different numbers in single precision: these, and their places."""
    values, at = np.unique(x.astype(np.float32), return_inverse=True)
    values = pack(values)
    return len(values).to_bytes(8, "little") + values + pack(at.astype(np.uint32))


def unpack_few(b: bytes) -> np.ndarray:
    end = 8 + int.from_bytes(b[:8], "little")
    return unpack(b[8:end], np.float32)[unpack(b[end:], np.uint32)].astype(float)


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_ROW)


def _told(table: pa.Table) -> dict[str, list[dict]]:
    """The rows of a group by kind, in the order of their sources and numbers."""
    out: dict[str, list[dict]] = {}
    for r in sorted(table.to_pylist(), key=lambda r: (r["source"] or 0, r["n"] or 0)):
        out.setdefault(r["kind"], []).append(r)
    return out


def _each(df: DataFrame, f: Callable[[dict], list[dict]]) -> DataFrame:
    """What f makes of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from _table(f(b.slice(i, 1).to_pylist()[0])).to_batches()

    return df.mapInArrow(run, ROW)


def _meet(f: Callable[[dict[str, list[dict]]], list[dict]], *told: DataFrame) -> DataFrame:
    """What f makes of all rows for a target."""
    def run(table: pa.Table) -> pa.Table:
        out = _table(f(_told(table)))
        give_back()
        return out

    return reduce(DataFrame.unionByName, told).groupBy("target").applyInArrow(run, ROW)


def _sum_at(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers x by their places."""
    return np.bincount(at, weights=x, minlength=n).astype(np.int64)


def _slices(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each part and where it stands among sorted ones."""
    edge = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
    for a, b in zip(edge, edge[1:], strict=False):
        yield int(part[a]), slice(a, b)


def _parts(tokens: int, each: int) -> int:
    """A power of two; it depends on the texts alone, not on how they are dealt out."""
    return 1 << max(3, (tokens // each).bit_length())


def _by_count(c: np.ndarray) -> np.ndarray:
    """Places of counts, the largest first."""
    return np.argsort(-c, kind="stable")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of texts, their counts with whether the id is null and held out, their tokens as places by frequency, and the sorted distinct words with their training counts."""
    hs, ns, ids, outs, held, made = [], [], [], [], 0, 0

    def chunk() -> dict:
        nonlocal held, made
        counts, out, doc_id = np.concatenate(ns), np.concatenate(outs), pa.concat_arrays(ids)
        w = np.empty(held + 1, np.uint64)
        is_end = np.zeros(held + 1, bool)
        is_end[np.cumsum(counts + 1) - 1] = True
        # the beginning is a word of every chunk, and stands last
        w[is_end], w[-1] = END, BEGIN
        is_end[-1] = True
        w[~is_end] = np.concatenate(hs)
        words, at = np.unique(w, return_inverse=True)
        at, of_held = at[:-1].astype(np.int32), np.repeat(out, counts + 1)
        c, asked = (np.bincount(at[x], minlength=len(words)) for x in (~of_held, of_held))
        begin = int(np.searchsorted(words, BEGIN))
        asked[begin] = 1
        # written as places in order of frequency, which are small numbers mostly
        order, place = _by_count(c), np.empty(len(words), np.int32)
        place[order] = np.arange(len(words), dtype=np.int32)
        for x in (hs, ns, ids, outs):
            x.clear()
        row = {
            "kind": "chunk", "target": TaskContext.get().partitionId() << 32 | made, "source": begin, "n": len(at), "m": int((~of_held).sum()),
            "p": pack(doc_id.fill_null(0).to_numpy(zero_copy_only=False)), "q": pack(counts.astype(np.int64) << 2 | doc_id.is_null().to_numpy(zero_copy_only=False) << 1 | out), "r": pack(place[at]), "s": pack(c << 1 | (asked > 0)), "t": pack_sorted(words),
        }
        held, made = 0, made + 1
        return row

    for b in batches:
        out = np.array(b.column(1).to_pylist(), bool)
        for at, h, counts in runs_of(raw(b.column(2))):
            hs.append(h), ns.append(counts), ids.append(b.column(0).slice(at, len(counts))), outs.append(out[at : at + len(counts)])
            held += len(h) + len(counts)
            if held > HELD:
                yield from _table([chunk()]).to_batches()
                give_back()
    if ns:
        yield from _table([chunk()]).to_batches()
        give_back()


def uniform(cell: np.ndarray, sweep: int, step: int) -> np.ndarray:
    """A number in [0, 1) for each cell, the same wherever and whenever it is drawn."""
    return (mix(cell + np.uint64(int(_B) * (sweep * 65536 + step + 1) % 2**64)) >> np.uint64(11)).astype(float) * 2.0**-53


def _normal_quantile(u: np.ndarray) -> np.ndarray:
    """By a rational approximation, off by 5e-4 at most."""
    tail = np.clip(np.minimum(u, 1 - u), 1e-16, 0.5)
    t = np.sqrt(-2 * np.log(tail))
    z = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    return np.where(u < 0.5, -z, z)


def binomial(u: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The u-quantile of a binomial distribution: by its sums, or by a normal one where its variance is over 30."""
    out = (u < p).astype(np.int64)
    wide = (n > 1) & (n * p * (1 - p) > 30)
    mean = n[wide] * p[wide]
    out[wide] = np.clip(np.rint(mean + _normal_quantile(u[wide]) * np.sqrt(mean * (1 - p[wide]))), 0, n[wide])
    left = np.flatnonzero((n > 1) & ~wide)
    # counted from the likelier side, so that the first term is no underflow
    m, q, v = n[left], np.minimum(p[left], 1 - p[left]), np.where(p[left] > 0.5, 1 - u[left], u[left])
    term = np.exp(m * np.log1p(-q))
    total, k = term.copy(), np.zeros(len(left), np.int64)
    on = np.flatnonzero((total < v) & (k < m))
    while len(on):
        term[on] *= (m[on] - k[on]) / (k[on] + 1) * (q[on] / (1 - q[on]))
        k[on] += 1
        total[on] += term[on]
        on = on[(total[on] < v[on]) & (k[on] < m[on])]
    out[left] = np.where(p[left] > 0.5, m - k, k)
    return out


def seat(c: np.ndarray, weight: np.ndarray, discount: float, cell: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of each cell after its c customers are seated one after another, the other cells' tables given.

    A customer opens a table with odds weight = (strength + discount * tables) * base to (seated - discount * own tables).
    The first 16 customers sit down singly, later ones in blocks of an eighth of those seated, whose new tables are
    drawn binomially: the number of steps grows with the logarithm of the largest count.
    """
    t = (c > 0).astype(np.int64)
    seated, step = 1, 0
    live = np.flatnonzero(c > 1)
    while len(live):
        block = 1 if seated < 16 else seated // 8
        n = np.minimum(block, c[live] - seated)
        p = weight[live] / (weight[live] + np.maximum(seated + (n - 1) / 2 - discount * t[live], 1e-9))
        t[live] += binomial(uniform(cell[live], sweep, step), n, p)
        seated, step = seated + block, step + 1
        live = live[c[live] > seated]
    return t


def _discount(once: int, twice: int) -> float:
    """From the numbers of dishes seen once and twice."""
    return float(np.clip(once / (once + 2 * twice), 0.1, 0.95)) if once else 0.5


def _ask_words(parts: int) -> Callable[[dict], list[dict]]:
    """A chunk's distinct words, to the parts of words: these are ranges of hashes."""
    def run(row: dict) -> list[dict]:
        h, c = unpack_sorted(row["t"]), unpack(row["s"], np.int64)
        part = (h >> np.uint64(65 - parts.bit_length())).astype(np.int64)
        return [{"kind": "ask", "target": k, "source": row["target"], "p": pack_sorted(h[at]), "q": pack(c[at])} for k, at in _slices(part)]

    return run


def _number_words(parts: int) -> Callable[[dict[str, list[dict]]], list[dict]]:
    """The vocabulary of a part, frequent words first, and to each chunk the numbers of its words (0: not in training) with their counts and whether held-out texts have them."""
    def run(told: dict[str, list[dict]]) -> list[dict]:
        part = told["ask"][0]["target"]
        hs = [unpack_sorted(r["p"]) for r in told["ask"]]
        h, at = np.unique(np.concatenate(hs), return_inverse=True)
        c = np.concatenate([unpack(r["q"], np.int64) for r in told["ask"]])
        c, asked = _sum_at(at, c >> 1, len(h)), _sum_at(at, c & 1, len(h)) > 0
        known = np.flatnonzero((c > 0) | (h == BEGIN))
        known = known[np.lexsort((h[known], -c[known]))]
        number = np.zeros(len(h), np.uint32)
        number[known] = np.arange(len(known), dtype=np.uint32) * np.uint32(parts) + np.uint32(part + 1)
        if len(known) * parts + part >= 1 << 32:
            raise ValueError("over 2^32 words")
        out = [{"kind": "words", "target": part, "n": int(c.sum()), "m": int((c > 0).sum()), "p": pack(h[known]), "q": pack(c[known])}]
        for r, a, n in zip(told["ask"], np.cumsum([0, *map(len, hs)]).tolist(), map(len, hs), strict=False):
            own = at[a : a + n]
            out.append({"kind": "numbers", "target": r["source"], "source": part, "p": pack(number[own]), "q": pack(c[own] << 1 | asked[own])})
        return out

    return run


class Chunk:
    """A chunk of texts that has been told its words' numbers: its distinct pairs, and those that cells are asked for, by part of cells."""

    def __init__(self, row: dict, numbers: list[dict], parts: int) -> None:
        x = unpack(row["q"], np.int64)
        self.counts, self.null, self.out = x >> 2, (x & 2).astype(bool), (x & 1).astype(bool)
        self.token = _by_count(unpack(row["s"], np.int64) >> 1)[unpack(row["r"], np.int32)]
        self.text = np.repeat(np.arange(len(self.counts)), self.counts + 1)
        self.begin = row["source"]
        self.number = np.concatenate([unpack(r["p"], np.uint32) for r in numbers]).astype(np.uint64)
        c = np.concatenate([unpack(r["q"], np.int64) for r in numbers])
        self.c, asked = c >> 1, (c & 1).astype(bool)
        context = np.roll(self.token, 1)
        context[np.cumsum(self.counts + 1) - self.counts - 1] = self.begin
        pair, self.pair_of = np.unique(context.astype(np.uint64) << _HALF | self.token.astype(np.uint64), return_inverse=True)
        self.u, self.w = (pair >> _HALF).astype(np.int64), (pair & _LOW).astype(np.int64)
        # a pair with a word that training has once is no cell to seat, and no held-out text asks for it unless such texts have both words
        ok = (self.number > 0) & (self.c != 1)
        may = ok[self.u] & ok[self.w] | (asked & (self.number > 0))[self.u] & asked[self.w] & (self.number[self.w] > 0)
        self.sent = np.flatnonzero(may)
        key = (self.number[self.u[self.sent]] - np.uint64(1)) << _HALF | (self.number[self.w[self.sent]] - np.uint64(1))
        part = (mix(key) & np.uint64(parts - 1)).astype(np.int64)
        order = np.lexsort((key, part))
        self.sent, self.key, self.part = self.sent[order], key[order], part[order]


def _ask_cells(parts: int) -> Callable[[dict[str, list[dict]]], list[dict]]:
    """A chunk's distinct pairs with their training counts and whether held-out texts have them, to the parts of cells."""
    def run(told: dict[str, list[dict]]) -> list[dict]:
        k = Chunk(told["chunk"][0], told["numbers"], parts)
        of_held = k.out[k.text]
        n, asked = (np.bincount(k.pair_of[x], minlength=len(k.u))[k.sent] for x in (~of_held, of_held))
        n = n << 1 | (asked > 0)
        return [{"kind": "ask", "target": p, "source": told["chunk"][0]["target"], "p": pack_sorted(k.key[at]), "q": pack(n[at])} for p, at in _slices(k.part)]

    return run


def _count_cells(told: dict[str, list[dict]]) -> list[dict]:
    """The cells of a part that training has twice or more, or once while a held-out text asks for them; and of each chunk, which of its pairs are among them, and where."""
    part, keys = told["ask"][0]["target"], [unpack_sorted(r["p"]) for r in told["ask"]]
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    c = np.concatenate([unpack(r["q"], np.int64) for r in told["ask"]])
    c, asked = _sum_at(at, c >> 1, len(key)), _sum_at(at, c & 1, len(key)) > 0
    kept = (c > 1) | (c == 1) & asked
    place = np.cumsum(kept) - 1
    out = [{"kind": "cells", "target": part, "n": int(c[c > 1].sum()), "m": int((c == 2).sum()), "p": pack_sorted(key[kept]), "q": pack(c[kept])}]
    for r, a, n in zip(told["ask"], np.cumsum([0, *map(len, keys)]).tolist(), map(len, keys), strict=False):
        own = at[a : a + n]
        out.append({"kind": "pairs", "target": part, "source": r["source"], "n": n, "p": pack(np.packbits(kept[own])), "q": pack_sorted(place[own[kept[own]]])})
    return out


class Cells:
    """A part of cells, and the words in them by part of words."""

    def __init__(self, row: dict, word_parts: int) -> None:
        key, self.c = unpack_sorted(row["p"]), unpack(row["q"], np.int64)
        self.key, n = key, len(key)
        words, at = np.unique(np.concatenate((key >> _HALF, key & _LOW)), return_inverse=True)
        part = (words % np.uint64(word_parts)).astype(np.int64)
        order, place = np.lexsort((words, part)), np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        self.part, self.rank = part[order], words[order] // np.uint64(word_parts)
        self.u, self.w = place[at[:n]], place[at[n:]]

    def tell(self, me: int, *sums: np.ndarray, kind: str, number: int = 0) -> list[dict]:
        """Numbers of its words, to their parts."""
        return [
            {"kind": kind, "target": k, "source": me, "n": number, "p": pack_sorted(self.rank[at]), **{name: pack(x[at]) for name, x in zip("qrst", sums, strict=False)}}
            for k, at in _slices(self.part)
        ]


def _begin(word_parts: int) -> Callable[[dict], list[dict]]:
    """Tables (one for each cell to seat) and customers of contexts and words in the cells to seat."""
    def run(row: dict) -> list[dict]:
        k = Cells(row, word_parts)
        live, n = (k.c > 1).astype(np.int64), len(k.rank)
        c = k.c * live
        return k.tell(row["target"], _sum_at(k.u, live, n), _sum_at(k.w, live, n), _sum_at(k.u, c, n), _sum_at(k.w, c, n), kind="up", number=-1)

    return run


def _settle(told: dict[str, list[dict]]) -> list[dict]:
    """The words of a part with their counts and customers, and how many of both are of cells seen once."""
    words = told["words"][0]
    h, c = unpack(words["p"], np.uint64), unpack(words["q"], np.int64)
    customers = np.where(h == END, 0, c)
    # every word but the end is followed by a token; each text begins once
    customers[h == BEGIN] = c[h == END].sum()
    of_u, of_w = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    for r in told.get("up", []):
        at = unpack_sorted(r["p"]).astype(np.int64)
        of_u[at] += unpack(r["s"], np.int64)
        of_w[at] += unpack(r["t"], np.int64)
    return [{"kind": "words", "target": words["target"], "p": words["p"], "q": words["q"], "r": pack(customers), "s": pack(customers - of_u), "t": pack(c - of_w)}]


def _seat_words(number: int, tables: int, types: int, discount: float) -> Callable[[dict[str, list[dict]]], list[dict]]:
    """Seats the parent's customers: a part's state, with sums, and to each part of cells tables (T), customers at the parent (K) and tables there (t0) of its words."""
    def run(told: dict[str, list[dict]]) -> list[dict]:
        words = told["words"][0]
        h, t, k = unpack(words["p"], np.uint64), unpack(words["s"], np.int64), unpack(words["t"], np.int64)
        lists = [(r["source"], r["p"], unpack_sorted(r["p"]).astype(np.int64)) for r in told.get("up", [])]
        for r, (_, _, at) in zip(told.get("up", []), lists, strict=True):
            t[at] += unpack(r["q"], np.int64)
            k[at] += unpack(r["r"], np.int64)
        t0 = seat(k, np.full(len(h), (STRENGTH + discount * tables) / (types + 1)), discount, mix(h), number)
        sums = np.array([k.sum(), t0.sum(), (k == 1).sum(), (k == 2).sum()], np.int64)
        out = [{"kind": "state", "target": words["target"], "n": number, "p": sums.tobytes(), "q": pack(k), "r": pack(t0)}]
        return out + [{"kind": "down", "target": source, "source": words["target"], "n": number, "p": pack(t[at]), "q": pack(k[at]), "r": pack(t0[at])} for source, _, at in lists]

    return run


class Sweep:
    """What a sweep has at the parent: its customers, tables and discount, and what is left for an unknown word."""

    def __init__(self, number: int, sums: np.ndarray, types: int) -> None:
        self.number, (self.customers, self.tables, once, twice) = number, sums.tolist()
        self.discount = _discount(once, twice)
        self.unknown = (STRENGTH + self.discount * self.tables) / (types + 1) / (STRENGTH + self.customers)

    def probability(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The parent's, of words with so many customers and tables there."""
        return (customers - self.discount * tables) / (STRENGTH + self.customers) + self.unknown


def _seat_cells(sweep: Sweep, discount: float, word_parts: int) -> Callable[[dict[str, list[dict]]], list[dict]]:
    """Seats the cells of a part: their tables, and to each part of words the tables of its contexts and words."""
    def run(told: dict[str, list[dict]]) -> list[dict]:
        row = told["cells"][0]
        k = Cells(row, word_parts)
        tables, customers, t0 = (np.concatenate([unpack(r[x], np.int64) for r in told.get("down", [])] or [np.zeros(0, np.int64)]) for x in "pqr")
        parent = sweep.probability(customers, t0)
        live = np.flatnonzero(k.c > 1)
        t = np.ones(len(k.c), np.int64)
        u, w = k.u[live], k.w[live]
        t[live] = seat(k.c[live], (STRENGTH + discount * tables[u]) * parent[w], discount, mix(k.key[live]), sweep.number)
        n = len(k.rank)
        out = [{"kind": "tables", "target": row["target"], "n": sweep.number, "p": pack(t)}]
        return out + k.tell(row["target"], _sum_at(u, t[live], n), _sum_at(w, t[live], n), kind="up", number=sweep.number)

    return run


def _mean_words(sweeps: list[Sweep], discount: float) -> Callable[[dict[str, list[dict]]], list[dict]]:
    """Of a part's words what they hand their parent as contexts (B), what they divide by (D) and the parent's probability of them (P): to parts of cells, and to chunks B and P."""
    def run(told: dict[str, list[dict]]) -> list[dict]:
        words = told["words"][0]
        single, p = unpack(words["s"], np.int64), 0.0
        for r, s in zip(told["state"], sweeps, strict=True):
            p = p + s.probability(unpack(r["q"], np.int64), unpack(r["r"], np.int64))
        p, tables, lists = p / len(sweeps), np.zeros(len(single), np.int64), {}
        for r in told.get("up", []):
            at = lists.setdefault(r["source"], unpack_sorted(r["p"]).astype(np.int64))
            tables[at] += unpack(r["q"], np.int64)
        # a context hands on what the tables of its own cells leave, so that its probabilities add up to one
        b = STRENGTH + discount * (single + tables / len(sweeps))
        d = STRENGTH + unpack(words["r"], np.int64)
        out = [{"kind": "words", "target": words["target"], "p": words["p"], "q": words["q"], "r": pack(b), "s": pack(d), "t": pack(p)}]
        out += [{"kind": "down", "target": source, "source": words["target"], "p": pack(b[at]), "q": pack(d[at]), "r": pack(p[at])} for source, at in lists.items()]
        for r in told["numbers"]:
            number = unpack(r["p"], np.uint32).astype(np.int64)
            known, at = number > 0, (number - 1) // r["m"]
            # a word that training has not hands everything to the parent as a context
            told_b, told_p = (np.where(known, x[np.maximum(at, 0)] if len(x) else 0.0, other) for x, other in ((b, 1.0), (p, np.mean([s.unknown for s in sweeps]))))
            out.append({"kind": "numbers", "target": r["source"], "source": words["target"], "p": r["p"], "q": r["q"], "r": pack_few(told_b), "s": pack_few(told_p)})
        return out

    return run


def _say(discount: float, word_parts: int) -> Callable[[dict[str, list[dict]]], list[dict]]:
    """The decimal logarithm of p(w | u) of the cells of a part, and to each chunk those of its pairs."""
    def run(told: dict[str, list[dict]]) -> list[dict]:
        row = told["cells"][0]
        k = Cells(row, word_parts)
        b, d, p = (np.concatenate([unpack(r[x], np.float64) for r in told.get("down", [])] or [np.zeros(0)]) for x in "pqr")
        t = sum(unpack(r["p"], np.int64) for r in told["tables"]) / len(told["tables"])
        said = np.log10((k.c - discount * t + b[k.u] * p[k.w]) / d[k.u])
        out = [{"kind": "cells", "target": row["target"], "p": row["p"], "q": row["q"], "r": pack(said)}]
        for r in told["pairs"]:
            out.append({"kind": "said", "target": r["source"], "source": row["target"], "n": r["n"], "p": r["p"], "q": pack(said[unpack_sorted(r["q"]).astype(np.int64)].astype(np.float32))})
        return out

    return run


class Model:
    """The seated model of training texts (columns text, held_out, and doc_id if it is to score them): see the module's text."""

    def __init__(self, docs: DataFrame) -> None:
        spark = docs.sparkSession
        doc_id = F.col("doc_id").cast("long") if "doc_id" in docs.columns else F.lit(None).cast("long")
        self.chunks = stage(docs.select(doc_id.alias("doc_id"), "held_out", "text").mapInArrow(_chunks, ROW), "chunks")
        all_tokens = self.chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.word_parts, self.cell_parts = _parts(all_tokens, 16 * FREQUENT), _parts(all_tokens, 4 * TOP)
        vocabulary = stage(_meet(_number_words(self.word_parts), _each(self.chunks, _ask_words(self.word_parts))), "vocabulary")
        release(spark)
        self.tokens, self.types = vocabulary.where("kind = 'words'").agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in "nm"]).first()
        self.numbers = vocabulary.where("kind = 'numbers'")
        # once they are numbered, a chunk's words are no longer handed on
        self.texts = self.chunks.withColumn("t", F.lit(None).cast("binary"))
        counted = stage(_meet(_count_cells, _meet(_ask_cells(self.cell_parts), self.texts, self.numbers)), "cells")
        release(spark)
        cells = counted.where("kind = 'cells'")
        of_active, two = cells.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in "nm"]).first()
        self.discount = _discount(self.tokens - of_active, two)
        up = stage(_each(cells, _begin(self.word_parts)), "up")
        words = stage(_meet(_settle, vocabulary.where("kind = 'words'"), up), "words")
        tables, discount, sweeps, kept, old = self.types, 0.5, [], [], []
        for number in range(BURN_IN + SAMPLES):
            state = stage(_meet(_seat_words(number, tables, self.types, discount), words, up.where("kind = 'up'")), "state")
            sums = sum((np.frombuffer(r["p"], np.int64) for r in state.where("kind = 'state'").select("p").collect()), np.zeros(4, np.int64))
            sweep = Sweep(number, sums, self.types)
            tables, discount = sweep.tables, sweep.discount
            last, up = up, stage(_meet(_seat_cells(sweep, self.discount, self.word_parts), cells, state.where("kind = 'down'")), "up")
            if number >= BURN_IN:
                sweeps.append(sweep)
                kept += [state, up]
            if number <= BURN_IN:
                old.append(last)
            if number < BURN_IN:
                old.append(state)
            while old:
                unstage(spark, old.pop())
            release(spark)
        every = reduce(DataFrame.unionByName, kept)
        self.unknown = float(np.mean([s.unknown for s in sweeps]))
        # to parts of words, which tell the chunks: the numbers that they told them before
        again = self.numbers.select("kind", F.col("source").alias("target"), F.col("target").alias("source"), "n", F.lit(self.word_parts).cast("long").alias("m"), *"pqrst")
        self._words = stage(_meet(_mean_words(sweeps, self.discount), words, every.where("kind in ('state', 'up')"), again), "model_words")
        self._cells = stage(_meet(_say(self.discount, self.word_parts), counted, every.where("kind = 'tables'"), self._words.where("kind = 'down'")), "model_cells")
        for df in (vocabulary, counted, words, *kept):
            unstage(spark, df)
        release(spark)

    @property
    def words(self) -> DataFrame:
        """Of each word: its number, hash, count, what it hands its parent as a context, what it divides by, and the parent's probability of it."""
        parts = self.word_parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    h = unpack(r["p"], np.int64)
                    number = np.arange(len(h)) * parts + r["target"]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (number, h, unpack(r["q"], np.int64), *(unpack(r[k], np.float64) for k in "rst"))], ["number", "h", "c", "B", "D", "P"])

        return self._words.where("kind = 'words'").mapInArrow(run, "number long, h long, c long, B double, D double, P double")

    @property
    def cells(self) -> DataFrame:
        """(u, w, c, said): the decimal logarithm of p(w | u) of cells seen twice or more, and of those seen once that a held-out text has."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    key = unpack_sorted(r["p"])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in ((key >> _HALF).view(np.int64), (key & _LOW).view(np.int64), unpack(r["q"], np.int64), unpack(r["r"], np.float64))], ["i", "j", "c", "said"])

        name = lambda number, h: self.words.select(F.col("number").alias(number), F.col("h").alias(h))
        got = self._cells.where("kind = 'cells'").mapInArrow(run, "i long, j long, c long, said double")
        return got.join(name("i", "u"), "i").join(name("j", "w"), "j").select("u", "w", "c", "said")

    def scores(self) -> DataFrame:
        """(doc_id, held_out, n_tokens, n_known, base_score, score) of the model's texts."""
        discount, norm, parts = self.discount, self.tokens + self.types + 1, self.cell_parts

        def run(table: pa.Table) -> pa.Table:
            told = _told(table)
            row = told["chunk"][0]
            k = Chunk(row, told["numbers"], parts)
            b, p = (np.concatenate([unpack_few(r[x]) for r in told["numbers"]]) for x in "rs")
            # a text's end stands last, and as often as training texts begin
            d = STRENGTH + k.c
            d[k.begin] = STRENGTH + k.c[k.token[-1]]
            handed, d = b[k.u] * p[k.w], d[k.u]
            of_held = np.log10(handed / d)
            said = np.log10((1 - discount + handed) / d)
            found, at = np.zeros(len(k.sent), bool), 0
            values = []
            for r in told.get("said", []):
                found[at : at + r["n"]] = np.unpackbits(unpack(r["p"], np.uint8), count=r["n"])
                values.append(unpack(r["q"], np.float32))
                at += r["n"]
            where = k.sent[found]
            said[where] = of_held[where] = np.concatenate([np.zeros(0), *values])
            score = np.where(k.out[k.text], of_held[k.pair_of], said[k.pair_of])
            c = k.c[k.token]
            sums = lambda x: np.bincount(k.text, weights=x, minlength=len(k.counts))
            out = pa.table({
                "doc_id": pa.array(unpack(row["p"], np.int64), mask=k.null), "held_out": k.out, "n_tokens": k.counts + 1, "n_known": sums(c > 0).astype(np.int64),
                "base_score": sums(np.log10((c + 1) / norm)), "score": sums(score),
            })
            give_back()
            return out

        schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
        told = self._words.where("kind = 'numbers'").unionByName(self._cells.where("kind = 'said'"))
        return self.texts.unionByName(told).groupBy("target").applyInArrow(run, schema)


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    A null or empty text is one end token. A null doc_id is not held out; repeated rows count and score one by one.
    Without a training text every token is unknown: both scores are of uniform chance. An empty table gives an
    empty table; other columns are ignored. Scores are rounded to nine decimals, as sums come in any order.
    """
    m = Model(docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id").cast("long")).alias("held_out"), "text"))
    return m.scores().select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(m.tokens).cast("long").alias("train_tokens"), F.round("base_score", 9).alias("base_score"), F.round("score", 9).alias("score")
    )


op10 = scored
