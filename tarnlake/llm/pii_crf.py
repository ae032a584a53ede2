"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The field is trained by gradient ascent of the conditional log-likelihood on a small labelled table (tokens and
labels; a table made by rule is the default) and decoded by Viterbi in numpy batches. It reads segments: every
token with a digit or an at-sign together with CONTEXT tokens on either side, overlapping ones joined. Other
tokens of a text are plain words, of which the field has no label but O. What it finds and the patterns don't, in
particular phone numbers without a plus sign, spelt-out mail addresses, and IPv6 or defanged internet addresses, is
added after a plain check of its form.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from ipaddress import ip_address

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.llm.shared import give_back

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["O", *(f"{x}-{k}" for k in KINDS for x in "BI")]
CONTEXT = 4
#: Rows of the labelled table that are used for training, at most.
MOST_ROWS = 50_000
#: Characters of texts that are decoded together, about.
PART = 1 << 20
STEPS, RATE, PENALTY = 120, 0.15, 1e-3
BATCH = 512

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_any = re.compile(r"[0-9@]|::")
_defanged = re.compile(r"[0-9]{1,3}(?:(?:\.|[(\[]\.[)\]]|[(\[]dot[)\]])[0-9]{1,3}){3}", re.IGNORECASE)
_at = re.compile(r"[(\[]at[)\]]", re.IGNORECASE)
#: Words that announce personal data.
CUES = {"email": "email", "e-mail": "email", "mail": "email", "contact": "email", "ip": "ip", "host": "ip", "address": "ip", "card": "card", "visa": "card", "credit": "card",
        "phone": "phone", "tel": "phone", "telephone": "phone", "call": "phone", "fax": "phone", "mobile": "phone", "cell": "phone", "dial": "phone"}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by the patterns, by kind and start; each kind in time linear in the text."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        # the name before an at-sign goes back as far as its characters do, but not into the match before
        start = at
        while start > last and (text[start - 1] in "._%+-" or (text[start - 1].isascii() and text[start - 1].isalnum())):
            start -= 1
        if start < at and (m := _domain.match(text, at)):
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", at + 1)
    if not re.search("[0-9]", text):
        return out
    out += [(1, m.start(), m.end()) for m in _ip.finditer(text) if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m[0].split("."))]
    for m in _card.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _phone.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def shape(token: str) -> str:
    """Letters as X or x, runs of them once; runs of digits as d and their number; other characters as they are."""
    return _kept_shape(token) if len(token) <= 64 else _shape(token)


def _shape(token: str) -> str:
    s = re.sub(r"[0-9]+", lambda m: f"\0{min(len(m[0]), 9)}", token)
    s = re.sub(r"[^\W\d_]+", lambda m: "X" if m[0][0].isupper() else "x", s)
    return s.replace("\0", "d").rstrip(".,;:!?")


#: Shapes of tokens of usual length are remembered.
_kept_shape = lru_cache(1 << 16)(_shape)


def token_features(tokens: list[str]) -> list[list[str]]:
    """The names of each token's features: its own shape and number of digits, its neighbours' shapes, and cues before it."""
    shapes = ["^", *map(shape, tokens), "$"]
    cues = ["", "", *(CUES.get(t.lower().strip(".,;:!?()"), "") for t in tokens)]
    out = []
    for i, t in enumerate(tokens):
        digits = sum(c.isdigit() for c in t)
        out.append([
            f"s={shapes[i + 1]}", f"p={shapes[i]}|{shapes[i + 1]}", f"n={shapes[i + 1]}|{shapes[i + 2]}", f"d={min(digits, 20)}",
            f"k={''.join(sorted(set(re.sub('[Xxd0-9]', '', shapes[i + 1]))))}|{digits > 0}", f"c1={cues[i + 1]}|{digits > 0}", f"c2={cues[i]}|{digits > 0}", "b",
        ])
    return out


FEATURES = 8


def labelled_table(n: int = 1000, seed: int = 11) -> list[tuple[int, int, str, str]]:
    """(sequence, position, token, label): the default small labelled table, made by rule."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["an", "the", "ou", "er", "ti", "la", "ch", "és"]) for _ in range(r.randint(1, 4)))
    cue = {k: [w for w, x in CUES.items() if x == k] for k in KINDS}

    def found(kind: str) -> list[str]:
        if kind == "email":
            name, host = r.choice([word(), f"{word()}.{d(2)}", f"{word()}_{word()}"]), f"{word()}{r.choice(['', d(1)])}.{r.choice(['com', 'org', 'example.net'])}"
            return r.choice([[f"{name}@{host}"]] * 3 + [[name, r.choice(["(at)", "[at]"]), host]])
        if kind == "ip":
            four, group = [str(r.randint(0, 255)) for _ in range(4)], lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4)))
            short = ":".join(group() for _ in range(r.randint(1, 4))) + "::" + ":".join(group() for _ in range(r.randint(0, 3)))
            return [r.choice([".".join(four), r.choice(["[.]", "(.)", "[dot]"]).join(four), ":".join(group() for _ in range(8)), short])]
        if kind == "card":
            return r.choice([[d(16)], [d(4), d(4), d(4), d(4)], ["-".join(d(4) for _ in range(4))], [d(4), d(6), d(5)]])
        return r.choice([["+" + d(1), f"({d(3)})", f"{d(3)}-{d(4)}"], [f"({d(3)})", f"{d(3)}-{d(4)}"], [f"{d(3)}-{d(3)}-{d(4)}"], [f"{d(3)}.{d(3)}.{d(4)}"], ["+" + d(2), d(3), d(4), d(4)], [f"+{d(11)}"]])

    other = [lambda: [d(r.randint(1, 3))], lambda: ["19" + d(2)], lambda: [f"{d(2)}.{d(2)}"], lambda: [f"{d(1)}.{d(1)}.{d(1)}"], lambda: [f"20{d(2)}-{d(2)}-{d(2)}"], lambda: [f"{d(2)}:{d(2)}"],
             lambda: ["token", "=", '"' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"'], lambda: [f"${d(2)}.{d(2)}"], lambda: [d(5), d(2)], lambda: [f"{d(2)}%"], lambda: [f"@{word()}"], lambda: [f"{word()}{d(2)}"], lambda: [f"{d(3)},{d(3)}"], lambda: [f"{d(3)}-{d(3)}"], lambda: [f"{word()}::{word()}"], lambda: [f"{d(2)}:{d(2)}:{d(2)}"]]
    rows = []
    for s in range(n):
        seq: list[tuple[str, str]] = []
        for _ in range(r.randint(1, 3)):
            seq += [(word() + r.choice(["", "", ",", "."]), "O") for _ in range(r.randint(0, CONTEXT))]
            if r.random() < 0.55:
                kind = r.choice(KINDS)
                if r.random() < 0.4:
                    seq.append((r.choice(cue[kind]) + r.choice(["", ":"]), "O"))
                parts = found(kind)
                parts[-1] += r.choice(["", "", ".", ","])
                seq += [(p, f"{'BI'[i > 0]}-{kind}") for i, p in enumerate(parts)]
            else:
                seq += [(p, "O") for p in r.choice(other)()]
        seq += [(word(), "O") for _ in range(r.randint(0, CONTEXT))]
        rows += [(s, i, t, y) for i, (t, y) in enumerate(seq)]
    return rows


class Field:
    """A linear-chain conditional random field: `index` numbers the known features from 1; row 0 of `emit` is zero."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, step: np.ndarray) -> None:
        self.index, self.emit, self.step = index, emit, step

    def _padded(self, seqs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(s) for s in seqs])
        x = np.zeros((len(seqs), sizes.max(), FEATURES), np.int64)
        for k, s in enumerate(seqs):
            x[k, : len(s)] = [[self.index.get(f, 0) for f in fs] for fs in token_features(s)]
        return x, sizes

    @classmethod
    def fit(cls, rows: list[tuple[int, int, str, str]]) -> Field:
        """Maximises the penalised log-likelihood with Adam over all sequences at once."""
        seqs: dict[int, list[tuple[str, str]]] = {}
        for s, _, t, y in sorted(rows):
            seqs.setdefault(s, []).append((t, y))
        words = [[t for t, _ in s] for s in seqs.values()]
        seen: dict[str, int] = {}
        for w in words:
            for fs in token_features(w):
                for f in fs:
                    seen[f] = seen.get(f, 0) + 1
        index = {f: i + 1 for i, f in enumerate(sorted(seen))}
        k = len(LABELS)
        field = cls(index, np.zeros((len(index) + 1, k)), np.zeros((k, k)))
        x, sizes = field._padded(words)
        n, length = x.shape[:2]
        y = np.zeros((n, length), np.int64)
        for i, s in enumerate(seqs.values()):
            y[i, : len(s)] = [LABELS.index(label) for _, label in s]
        on = np.arange(length)[None] < sizes[:, None]
        gold = np.zeros_like(field.emit)
        np.add.at(gold, x[on], np.eye(k)[y[on]][:, None, :])
        both = on[:, 1:]
        gold_step = np.zeros((k, k))
        np.add.at(gold_step, (y[:, :-1][both], y[:, 1:][both]), 1)
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (field.emit, field.step)]
        for it in range(1, STEPS + 1):
            node, edge = field._expected(x, on)
            grad = gold.copy()
            np.subtract.at(grad, x[on], node[on][:, None, :])
            for p, g, (m, v) in zip((field.emit, field.step), (grad, gold_step - edge), moments, strict=True):
                g = g / n - PENALTY * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += RATE * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-8)
            field.emit[0] = 0
        return field

    def _expected(self, x: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of labels and expected counts of label pairs, by forward and backward sums scaled at each step."""
        e = self.emit[x].sum(2)
        e = np.exp(e - e.max(2, keepdims=True))
        step = np.exp(self.step)
        n, length, k = e.shape
        a, b = np.zeros_like(e), np.ones_like(e)
        a[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for t in range(1, length):
            nxt = (a[:, t - 1] @ step) * e[:, t]
            a[:, t] = np.where(on[:, t, None], nxt / nxt.sum(1, keepdims=True), a[:, t - 1])
        for t in range(length - 2, -1, -1):
            prev = (b[:, t + 1] * e[:, t + 1]) @ step.T
            b[:, t] = np.where(on[:, t + 1, None], prev / prev.sum(1, keepdims=True), 1.0)
        node = a * b
        node /= node.sum(2, keepdims=True)
        edge = np.zeros((k, k))
        for t in range(1, length):
            pair = a[:, t - 1, :, None] * step[None] * (b[:, t] * e[:, t])[:, None, :]
            edge += (pair / pair.sum((1, 2), keepdims=True))[on[:, t]].sum(0)
        return node, edge

    def decode(self, seqs: list[list[str]]) -> list[list[int]]:
        """The likeliest labels of each token sequence: Viterbi over padded batches of sequences of like length."""
        order = sorted(range(len(seqs)), key=lambda i: len(seqs[i]))
        out: list[list[int]] = [[] for _ in seqs]
        at = 0
        while at < len(order):
            # a batch holds BATCH sequences, or fewer long ones: its cells are bounded
            size = max(1, min(BATCH, 200_000 // max(1, len(seqs[order[min(at + BATCH, len(order)) - 1]]))))
            part = order[at : at + size]
            at += size
            x, sizes = self._padded([seqs[i] for i in part])
            e = self.emit[x].sum(2)
            n, length, k = e.shape
            best, back = e[:, 0], np.zeros((n, length, k), np.int8)
            for t in range(1, length):
                scores = best[:, :, None] + self.step[None]
                back[:, t] = scores.argmax(1)
                best = np.where((t < sizes)[:, None], scores.max(1) + e[:, t], best)
            label = best.argmax(1)
            rows = np.arange(n)
            path = np.zeros((n, length), np.int64)
            for t in range(length - 1, -1, -1):
                path[:, t] = label
                label = np.where(t < sizes, back[rows, t, label], label) if t else label
            for i, p, s in zip(part, path, sizes.tolist(), strict=True):
                out[i] = p[:s].tolist()
        return out


def segments(text: str) -> list[list[tuple[int, int]]]:
    """Places of the tokens of each segment: tokens with a digit or at-sign, and CONTEXT tokens around them."""
    places = [m.span() for m in TOKEN.finditer(text)]
    near: list[list[int]] = []
    for i, (a, b) in enumerate(places):
        if _any.search(text, a, b) or _at.fullmatch(text, a, b):
            lo, hi = max(0, i - CONTEXT), min(len(places), i + CONTEXT + 1)
            if near and lo <= near[-1][1]:
                near[-1][1] = hi
            else:
                near.append([lo, hi])
    return [places[lo:hi] for lo, hi in near]


def _holds(kind: int, found: str) -> bool:
    """A plain check of what the field found: enough digits of the kind, or the form of an address."""
    digits = "".join(c for c in found if "0" <= c <= "9")
    if kind == 1:
        return _is_address(found)
    if kind == 0:
        return re.fullmatch(r"[^@\s]+(?:@|\s*[(\[]at[)\]]\s*)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", found, re.IGNORECASE) is not None
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == 3 and 7 <= len(digits) <= 15 and re.fullmatch(r"\+?[0-9().\x20-]+", found) is not None


def _is_address(found: str) -> bool:
    """Four numbers of at most 255, defanged or not, or an IPv6 address."""
    if _defanged.fullmatch(found):
        return all(int(x) <= 255 for x in re.findall("[0-9]+", found))
    try:
        return len(found) <= 45 and found.count(":") > 1 and ip_address(found).version == 6
    except ValueError:
        return False


def all_spans(texts: list[str], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, all spans) of each text, by kind and start; the field's spans don't overlap a base one or each other."""
    base = [base_spans(t) if _any.search(t) else [] for t in texts]
    cut = [(i, s) for i, t in enumerate(texts) if _any.search(t) or "at)" in t or "at]" in t for s in segments(t)]
    labels = field.decode([[texts[i][a:b] for a, b in s] for i, s in cut]) if cut else []
    added: dict[int, list[tuple[int, int, int]]] = {}
    for (i, s), path in zip(cut, labels, strict=True):
        text, at = texts[i], 0
        while at < len(path):
            y, end = path[at], at + 1
            if y:
                kind = (y - 1) // 2
                while end < len(path) and path[end] == 2 + 2 * kind:
                    end += 1
                a, b = s[at][0], s[end - 1][1]
                while a < b and (text[a] in "\"'<[{,;" or (text[a] == ":" and text[a : a + 2] != "::")):
                    a += 1
                while b > a and text[b - 1] in "\"'>]}.,;:!?*$%&#|" and text[b - 2 : b] != "::":
                    b -= 1
                if _holds(kind, text[a:b]):
                    added.setdefault(i, []).append((kind, a, b))
            at = end
    out = []
    for i, own in enumerate(base):
        extra = []
        if i in added:
            taken = sorted((a, b) for _, a, b in own)
            starts = np.array([a for a, _ in taken])
            reach = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0)
            for k, a, b in added[i]:
                j = int(np.searchsorted(starts, b)) if taken else 0
                if not j or reach[j - 1] <= a:
                    extra.append((k, a, b))
        out.append((own, sorted(own + extra)))
    return out


def _spans(texts: list[str], field: Field) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """all_spans() of the texts of a batch, about PART characters at a time."""
    at = 0
    while at < len(texts):
        part: list[str] = []
        size = 0
        while at + len(part) < len(texts) and (not part or size < PART):
            part.append(texts[at + len(part)])
            size += len(part[-1])
        yield from all_spans(part, field)
        at += len(part)
    give_back()


_field: Field | None = None


def trained(table: DataFrame | None = None) -> Field:
    """The field trained on a labelled table (sequence, position, token, label), of which MOST_ROWS are used; on the default one without."""
    global _field
    if table is not None:
        return Field.fit([tuple(r) for r in table.select("sequence", "position", "token", "label").orderBy("sequence", "position").limit(MOST_ROWS).collect()])
    if _field is None:
        _field = Field.fit(labelled_table())
    return _field


def _scan(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
        said = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
        for b in batches:
            found = list(_spans([t or "" for t in b.column(1).to_pylist()], field))
            counts = [pa.array([sum(s[0] == k for s in own) for own, _ in found], pa.int64()) for k in range(4)]
            digest = pa.array([sha256(said(own).encode()).hexdigest() for own, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, pa.array([said(every) for _, every in found], pa.string())], names)

    return run


def op3(docs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """The contract's columns: doc_id, n_email, n_ip, n_card, n_phone (of base spans), base_sha256, spans; of every row.

    A null or empty text has no span (the hash is that of an empty string). Repeated rows get equal results, a null
    doc_id stays null, an empty table gives an empty table, other columns are ignored. No shuffle.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan(trained(table)), schema)


def _redact(field: Field, at: int, chars: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            out = []
            for text, (_, spans) in zip(texts, _spans([t or "" for t in texts], field), strict=True):
                parts, last = [], 0
                for a, e, k in sorted((a, e, k) for k, a, e in spans):
                    if e > last:
                        parts += [text[last:a] if a > last else "", f"[{KINDS[k].upper()}]" if a >= last else ""]
                        last = e
                out.append(text if not spans else "".join(parts) + text[last:])
            columns = list(b.columns)
            columns[at] = pa.array(out, pa.string())
            if chars is not None:
                columns[chars] = pa.array([None if t is None else len(t) for t in out], pa.int64()).cast(b.schema.field(chars).type, safe=False)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return run


def redact(docs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """docs with every span in `text` replaced by its kind in brackets, and `n_chars` counted anew.

    n_chars is counted where there is such a column of numbers or strings (a narrower number wraps around); one of another
    type is left as it is. A null text stays null and has a null n_chars; an empty one stays empty; a null doc_id, repeated
    rows and all other columns stay as they are, row by row; an empty table gives an empty table. No shuffle.
    """
    names = docs.columns
    counted = "n_chars" in names and isinstance(docs.schema["n_chars"].dataType, (T.NumericType, T.StringType)) and not isinstance(docs.schema["n_chars"].dataType, T.DecimalType)
    return docs.mapInArrow(_redact(trained(table), names.index("text"), names.index("n_chars") if counted else None), docs.schema)
