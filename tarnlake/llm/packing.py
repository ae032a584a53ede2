"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups.

Documents are tokenized where they are read; only piece descriptions (place, length, checksum) move. A document's
ids are cut at multiples of the sequence length: full pieces are sequences of their own, and the rests are dealt
at random into groups of about GROUP pieces that are packed independently of each other.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.shared import LOWER, raw, stage

LENGTH = 2048
END = 1
#: Pieces of a group, about.
GROUP = 8192
#: Words whose ids a worker remembers: the first so many, the frequent ones among them. Others are encoded where they stand.
REMEMBER = 1 << 20
CHUNK = 1 << 21
_BETWEEN, _JOINED = "\x01", 2000


class Tokenized:
    """Ids of whole texts. White space always ends a token of this tokenizer and letters become small, so a word's ids
    don't depend on its neighbours or on A-Z, and are remembered under the bytes of the lower-cased word.

    The tokenizer's own special tokens count where they stand in a text, in whatever word and in just their spelling: a
    text that has one, in any letters, is encoded as a whole."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, special)) or b"(?!)")
        self.between = self.tokenizer.encode(_BETWEEN, add_special_tokens=False).ids[0]
        self.index: dict[bytes, int] = {}
        self.n_flat, self.flat = 0, np.zeros(1 << 16, np.uint32)
        self.n_known, self.start, self.length = 0, np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and each one's number of ids.

        Many words are encoded as one text, with a word of a control character between them, whose one id tells them apart.
        """
        if len(words) == 1:
            parts = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *parts]), np.fromiter(map(len, parts), np.int64, len(parts))
        joined = [f" {_BETWEEN} ".join(words[at : at + _JOINED]) + f" {_BETWEEN}" for at in range(0, len(words), _JOINED)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        between = ids == self.between
        ends = np.flatnonzero(between)
        assert len(ends) == len(words)
        return ids[~between], np.diff(ends, prepend=-1) - 1

    def _learn(self, words: list[str]) -> None:
        # a word that has the control character itself is encoded alone, and so, to keep their order, are the others new with it
        for part in [[w] for w in words] if any(_BETWEEN in w for w in words) else [words]:
            ids, sizes = self._encoded(part)
            self.flat = self._put(self.flat, self.n_flat, ids)
            self.start = self._put(self.start, self.n_known, self.n_flat + np.cumsum(sizes) - sizes)
            self.length = self._put(self.length, self.n_known, sizes)
            self.n_flat, self.n_known = self.n_flat + len(ids), self.n_known + len(sizes)

    @staticmethod
    def _put(to: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
        """values written from `at` on, in an array twice as long if need be."""
        if at + len(values) > len(to):
            to = np.concatenate([to, np.zeros(max(len(to), len(values)), to.dtype)])
        to[at : at + len(values)] = values
        return to

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, END last."""
        whole = [k for k, t in enumerate(texts) if self.special.search(t.translate(LOWER))]
        if not whole:
            return self._by_word(texts)
        plain = list(texts)
        for k in whole:
            plain[k] = b""
        out = self._by_word(plain)
        for k in whole:
            out[k] = np.array([*self.tokenizer.encode(texts[k].decode("utf-8", "replace"), add_special_tokens=False).ids, END], np.uint32)
        return out

    def _by_word(self, texts: list[bytes]) -> list[np.ndarray]:
        full, known = len(self.index) >= REMEMBER, (self.n_flat, self.n_known)
        words: list[bytes] = []
        counts = []
        for t in texts:
            own = t.translate(LOWER).split()
            words += own
            counts.append(len(own))
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh: dict[bytes, int] = {}
            at[new] = [fresh.setdefault(words[i], self.n_known + len(fresh)) for i in new.tolist()]
            if not full:
                self.index.update(fresh)
            self._learn([w.decode("utf-8", "replace") for w in fresh])
        sizes = self.length[at].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.repeat(self.start[at] - (ends - sizes), sizes) + np.arange(total)]
        if full:
            self.n_flat, self.n_known = known
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return [np.append(flat[a:b], np.uint32(END)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


_loaded: dict[str, Tokenized] = {}


def _cut(tokenizer: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = _loaded.get(tokenizer) or _loaded.setdefault(tokenizer, Tokenized(tokenizer))
        for b in batches:
            doc_ids, texts = b.column(0), raw(b.column(1))
            rows: list[tuple[int, int, int, int, int]] = []
            at = 0
            while at < len(texts):
                chunk, size = [], 0
                while at + len(chunk) < len(texts) and (not chunk or size < CHUNK):
                    chunk.append(texts[at + len(chunk)] or b"")
                    size += len(chunk[-1])
                for k, ids in enumerate(tok.ids(chunk), at):
                    n, data = len(ids), ids.astype("<u4").tobytes()
                    rows += [(k, s, min(length, n - s), zlib.crc32(data[4 * s : 4 * (s + length)]), n) for s in range(0, n, length)]
                at += len(chunk)
            k, start, size_, crc, n = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(k)), *map(pa.array, (start, size_, crc, n))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece; a null text has the end id alone."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _cut(tokenizer, length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


def first_fit_decreasing(sizes: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item of `sizes`, which must be in descending order.

    The tree's leaves are the bins' free capacities and an inner node has the larger of its two; the first bin
    that fits is found from the root by going left whenever the left child's capacity is enough.
    """
    width = 1 << max(0, int(len(sizes) - 1).bit_length())
    tree = [capacity] * (2 * width)
    bins, offsets = [], []
    for size in sizes.tolist():
        node = 1
        while node < width:
            node *= 2
            if tree[node] < size:
                node += 1
        bins.append(node - width)
        offsets.append(capacity - tree[node])
        tree[node] -= size
        node //= 2
        while node:
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
            node //= 2
    return np.array(bins, np.int64), np.array(offsets, np.int64)


def _pack_group(length: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), length)
        rows["sequence_id"] = (rows.pop("group").to_numpy() * (1 << 24) + bins) * 2
        rows["offset"] = offsets
        return rows

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every row.

    Full pieces get odd sequence ids, packed ones even ids. A null or empty text is a piece of the end id alone;
    repeated rows are packed one by one; a null doc_id stays null; an empty table gives an empty table; other
    columns are ignored. Ids within a group are deterministic for the same table of pieces.
    """
    cut = stage(pieces(docs, tokenizer, length), "pieces").withColumn("row", F.monotonically_increasing_id())
    full = cut.where(F.col("length") == length).select("*", (F.col("row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).drop("row")
    rest = cut.where(F.col("length") < length)
    groups = max(1, -(-rest.count() // group))
    dealt = rest.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups))).drop("row")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return full.unionByName(dealt.groupBy("group").applyInPandas(_pack_group(length), schema))


def op7(docs: DataFrame) -> DataFrame:
    """The contract's columns, with the public 49k word tokenizer."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
