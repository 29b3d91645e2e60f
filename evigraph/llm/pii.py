"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns find e-mail addresses, IPv4 addresses, card and phone numbers; the
field, trained from the small labelled table of `labelled_table`, adds what they
miss: credentials, addresses with (at), numbers in other notations. Features are
those of a word's shape and its neighbours' shapes, hashed to rows of a weight
table. Decoding is Viterbi over batches of runs in numpy. A word whose lead for
O exceeds what any transitions could make up is O on the best path, whatever
its neighbours are (`Field.certain`); so only the runs between such words are
decoded, with the same result as decoding the whole text.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone", "secret")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
ROWS = 1 << 14

# ------------------------------------------------------------------ patterns

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the whole pattern would find them, but linear: every match holds one @, and its local part begins as far left as it can."""
    end = 0
    at = text.find("@")
    while at >= 0:
        s = at
        while s > end and text[s - 1] in _LOCAL_CHARS:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            yield s, m.end()
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the pattern matches that hold, in order."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# ---------------------------------------------------------------- word shapes

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58] = ord("0")
_CLASS[65:91] = ord("A")
_CLASS[97:123] = ord("a")
_CLASS[128:] = ord("a")
_EDGES = b".,;:!?\"'()[]{}<>"


def _identity(words: C.Words) -> np.ndarray:
    fold = C.Words.__new__(C.Words)
    fold.buf, fold.starts, fold.ends, fold.first = C._LOWER[words.buf], words.starts, words.ends, words.first
    return fold.hashes()


def features(words: C.Words, known: np.ndarray) -> np.ndarray:
    """Rows of the weight table for every word: shape, size, mixture, identity, and the neighbours' shapes."""
    n = len(words)
    if not n:
        return np.empty((0, 11), np.int32)
    kind = _CLASS[words.buf]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[words.starts] = True
    inside = np.zeros(len(kind) + 1, np.int32)
    inside[words.starts] += 1
    np.add.at(inside, words.ends, -1)
    new &= np.cumsum(inside[:-1]) > 0
    place = np.append(0, np.cumsum(new))
    short = C.Words.__new__(C.Words)
    short.buf, short.starts, short.ends, short.first = kind[new], place[words.starts], place[words.ends], words.first
    shape = short.hashes()
    size = words.ends - words.starts
    log = np.minimum(np.ceil(np.log2(size + 1)).astype(np.int64), 8)
    total = lambda mask: np.diff(np.append(0, np.cumsum(mask))[np.stack([words.starts, words.ends])], axis=0)[0]
    digit, upper = total(kind == 48), total(kind == 65)
    lower = total(kind == 97)
    other = size - digit - upper - lower
    mixture = (digit > 0) * 1 + (upper > 0) * 2 + (lower > 0) * 4 + np.minimum(other, 3) * 8
    some = np.minimum(digit, 20)
    identity = _identity(words)
    if len(known):
        identity[known[np.minimum(np.searchsorted(known, identity), len(known) - 1)] != identity] = 0
    first = np.zeros(n, bool)
    first[words.first[:-1][words.counts > 0]] = True
    last = np.zeros(n, bool)
    last[words.first[1:][words.counts > 0] - 1] = True

    def beside(x: np.ndarray, step: int, edge: np.ndarray) -> np.ndarray:
        y = np.roll(x, step)
        y[edge] = 0
        return y

    mixed = (mixture + 64 * log).astype(C.U)
    columns = [
        shape,
        mixed,
        (some + 32 * log).astype(C.U),
        identity,
        beside(shape, 1, first),
        beside(shape, -1, last),
        beside(identity, 1, first),
        beside(mixed, 1, first) + C.U(4096) * beside(mixed, -1, last),
        C.mix(shape + log.astype(C.U)),
        np.minimum(mixture, 31).astype(C.U),
        (digit > 0).astype(C.U) * C.U(2) + beside((digit > 0).astype(C.U), 1, first),
    ]
    return np.stack([(C.mix(x + C.U(i << 40)) % C.U(ROWS)).astype(np.int32) for i, x in enumerate(columns)], 1)


# ----------------------------------------------------------------------- field


@dataclass
class Field:
    """Weights of the features (ROWS by tags) and of the transitions; begin and end follow O."""

    weight: np.ndarray
    move: np.ndarray
    known: np.ndarray  # hashes of the words that count as themselves

    def emissions(self, feature: np.ndarray) -> np.ndarray:
        out = self.weight[feature[:, 0]]
        for i in range(1, feature.shape[1]):
            out = out + self.weight[feature[:, i]]
        return out

    def certain(self, e: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Words (last: ends of rows) that are O on the best path whatever the others are.

        Put O on such a word of any other path, and B on the next word where it
        had I: what the transitions and that word lose is less than what the
        word gains, so the path was not the best.
        """
        m = self.move.astype(np.float64)
        ok = m > -1e5
        most = lambda x, where: float(x[where].max())
        b, i = np.arange(1, len(TAGS), 2), np.arange(2, len(TAGS), 2)
        other, no_i = np.ones_like(ok), np.ones_like(ok)
        other[:, 0], no_i[:, i] = False, False
        into = most(m, ok & other) - m[:, 0].min()
        out = most(m[1:], (ok & no_i)[1:]) - m[0, [0, *b]].min()
        change = most(m[i] - m[b], ok[i] & ok[b])
        out_i = most(m[:, i], ok[:, i]) - m[0, b].min() + change
        slack = np.append((e[1:, i] - e[1:, b]).max(1), 0.0)
        slack[last] = -np.inf
        return e[:, 0] - e[:, 1:].max(1) > into + np.maximum(out, out_i + slack) + 1e-3


def _mask() -> np.ndarray:
    """Transitions that make no sense: into I-x from anything but B-x and I-x."""
    m = np.zeros((len(TAGS), len(TAGS)), np.float32)
    for j, t in enumerate(TAGS):
        if t[0] == "I":
            m[:, j] = -1e6
            m[TAGS.index("B" + t[1:]), j] = m[j, j] = 0
    return m


def viterbi(emission: np.ndarray, move: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Best tags of a batch (runs by steps by tags), each run between two O."""
    b, t, k = emission.shape
    back = np.zeros((b, t, k), np.int8)
    score = emission[:, 0] + move[0]
    final = np.zeros((b, k), emission.dtype)
    done = length == 1
    final[done] = score[done]
    for i in range(1, t):
        way = score[:, :, None] + move[None]
        back[:, i] = way.argmax(1)
        score = way.max(1) + emission[:, i]
        done = length == i + 1
        final[done] = score[done]
    tag = (final + move[:, 0]).argmax(1)
    out = np.zeros((b, t), np.int8)
    rows = np.arange(b)
    for i in range(t - 1, -1, -1):
        here = i < length
        out[here, i] = tag[here]
        tag = np.where(here, back[rows, i, tag], tag) if i else tag
    return out


def decode(field: Field, words: C.Words) -> np.ndarray:
    """The best path's tag of every word; rows are sequences."""
    n = len(words)
    out = np.zeros(n, np.int8)
    if not n:
        return out
    e = field.emissions(features(words, field.known))
    at = np.flatnonzero(~field.certain(e, words.first[1:][words.counts > 0] - 1))
    if not len(at):
        return out
    row = np.searchsorted(words.first, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at)))
    order = np.argsort(size, kind="stable")
    i = 0
    while i < len(order):
        top = 1 << int(size[order[i]] - 1).bit_length()
        j = min(int(np.searchsorted(size[order], top, "right")), i + max(1, 2_000_000 // (top * len(TAGS))))
        some = order[i:j]
        steps = int(size[some].max())
        where = np.minimum(begin[some][:, None] + np.arange(steps), len(at) - 1)
        got = viterbi(e[at[where]], field.move, size[some])
        inside = np.arange(steps) < size[some][:, None]
        out[at[where[inside]]] = got[inside]
        i = j
    return out


def fit(rows: list[tuple[str, list[str]]], steps: int = 120, rate: float = 0.5, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by adaptive gradient steps over all of (text, tag of each word); scaled forward and backward sums in batches."""
    k = len(TAGS)
    (words,) = [w for _, _, w in C.pieces(pa.array([t for t, _ in rows], pa.string()))]
    names, often = np.unique(_identity(words), return_counts=True)
    known = names[often >= 3]
    f = features(words, known)
    length, n = words.counts, len(rows)
    t = int(length.max())
    pad = np.arange(t) < length[:, None]
    gold = np.zeros((n, t), np.int64)
    gold[pad] = [TAGS.index(x) for _, tags in rows for x in tags]
    row, count = np.unique(f, return_counts=True)
    used = row[count >= 3]  # what was seen once or twice keeps a weight of zero
    place = np.full(ROWS, len(used))
    place[used] = np.arange(len(used))
    at = place[f]
    by = np.argsort(at.ravel(), kind="stable")
    word, edge = by // f.shape[1], np.searchsorted(at.ravel()[by], np.arange(len(used)))
    word = word[: int((at < len(used)).sum())]
    mask = _mask().astype(np.float64)
    weight, move = np.zeros((len(used), k)), np.zeros((k, k))
    gw, gm = np.full_like(weight, 1e-6), np.full_like(move, 1e-6)
    end = np.arange(n), length - 1
    for _ in range(steps):
        m = np.exp(move + mask)
        e = np.zeros((n, t, k))
        e[pad] = np.vstack([weight, np.zeros((1, k))])[at].sum(1)
        x = np.exp(e - e.max(2, keepdims=True))
        alpha, beta = np.zeros_like(e), np.ones_like(e)
        alpha[:, 0] = m[0] * x[:, 0]
        for i in range(t):
            if i:
                alpha[:, i] = (alpha[:, i - 1] @ m) * x[:, i]
            alpha[:, i] /= alpha[:, i].sum(1, keepdims=True)
        for i in range(t - 1, -1, -1):
            ahead = (x[:, i + 1] * beta[:, i + 1]) @ m.T if i + 1 < t else beta[:, i]
            beta[:, i] = np.where((length == i + 1)[:, None], m[:, 0], ahead)
            beta[:, i] /= beta[:, i].sum(1, keepdims=True)
        node = alpha * beta
        node /= node.sum(2, keepdims=True)
        diff = -node
        diff[~pad] = 0
        diff[pad, gold[pad]] += 1
        g_move = np.zeros_like(move)
        for i in range(1, t):
            live = pad[:, i]
            pair = alpha[live, i - 1][:, :, None] * m * (x[live, i] * beta[live, i])[:, None]
            g_move -= (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            np.add.at(g_move, (gold[live, i - 1], gold[live, i]), 1)
        g_move[0] += diff[:, 0].sum(0)
        g_move[:, 0] += diff[end].sum(0)
        g_weight = np.add.reduceat(diff[pad][word], edge, axis=0)
        for v, g, acc in ((weight, g_weight - ridge * weight, gw), (move, np.where(mask < 0, 0, g_move) - ridge * move, gm)):
            acc += g * g
            v += rate * g / np.sqrt(acc)
    table = np.zeros((ROWS, k), np.float32)
    table[used] = weight
    return Field(table, (move + mask).astype(np.float32), known)


# -------------------------------------------------------------- labelled table


def labelled_table(rows: int = 500, seed: int = 17) -> list[tuple[str, list[str]]]:
    """Sentences of made-up words with tagged words, from a rule: the small labelled table of the field."""
    r = random.Random(seed)
    hexa, upper, low = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    digits = lambda n: some("0123456789", n)

    def prose() -> str:
        w = some(low + "éüñß" * 2, r.randint(1, 11))
        w = r.choice([w, w, w, w.capitalize(), w + r.choice(".,;:!?"), w.upper() + r.choice(["", "!!"]), w + r.choice(["", ".", ","]) + r.choice(["%%%", "***", "###", "&&&", "$$$"])])
        return r.choice([w] * 14 + [digits(r.randint(1, 4)), digits(4) + ".", f"{r.randint(1, 9)}.{r.randint(0, 9)}", "|", "-", f"({w})", f"{w}-{w}", "=", f"v{r.randint(1, 9)}.0", "4.0.", "BY-NC", f'"{w}"', f"{digits(2)}%", f"{digits(2)}:{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}"])

    def one(kind: str) -> list[str]:
        name, host = some(low, r.randint(3, 8)), some(low, r.randint(3, 8))
        if kind == "email":
            return r.choice([[f"{name}.{digits(2)}@{host}.example.com"], [f"{name}@{host}.org"], [f"{name}[at]{host}.net"], [f"{name}(at){host}(dot)com"], [f"<{name}@{host}>"]])
        if kind == "ip":
            return r.choice([[".".join(str(r.randint(0, 255)) for _ in range(4))], [":".join(some(hexa, 4) for _ in range(8))], [f"{some(hexa, 4)}:{some(hexa, 3)}::{some(hexa, 2)}"], [f"fe80::{some(hexa, 4)}:{some(hexa, 4)}"]])
        if kind == "card":
            return r.choice([[digits(16)], [digits(4) for _ in range(4)], ["-".join(digits(4) for _ in range(4))], [".".join(digits(4) for _ in range(4))]])
        if kind == "phone":
            return r.choice([[f"+{digits(1)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"{digits(3)}-{digits(3)}-{digits(4)}"], [f"+{digits(2)}", digits(3), digits(3), digits(4)], [f"00{digits(11)}"], [f"{digits(3)}.{digits(3)}.{digits(4)}"]])
        key = r.choice([some(hexa, r.randint(16, 40)), some(upper + low + "0123456789", r.randint(16, 40)), some(low + "0123456789", 18)])
        return r.choice(
            [
                ["AKIA" + some(upper + "0123456789", 16)],
                [some(upper + "0123456789", 20)],
                ["password=" + some(hexa, 18)],
                ["token", "=", f'"{some(hexa, 40)}"'],
                [f"{r.choice(['secret', 'passwd', 'api_key', 'pwd', 'password', 'token'])}{r.choice('=:')}{key}"],
                [r.choice(["password", "token", "secret", "api_key"]) + r.choice(["", ":"]), r.choice("=:"), key],
                [r.choice(["password:", "secret:", "key:", "token:"]), key],
                ["ghp_" + some(upper + low + "0123456789", 36)],
                ["sk-" + some(upper + low + "0123456789", 32)],
            ]
        )

    out = []
    for _ in range(rows):
        words, tags = [], []
        for _ in range(r.choice([0, 1, 1, 2])):
            before = [prose() for _ in range(r.randint(0, 9))]
            kind = r.choice(KINDS)
            found = one(kind)
            if r.random() < 0.2:
                found[-1] += r.choice(".,;)")
            words += before + found
            tags += ["O"] * len(before) + ["B-" + kind] + ["I-" + kind] * (len(found) - 1)
        after = [prose() for _ in range(r.randint(1, 12))]
        out.append((" ".join(words + after), tags + ["O"] * len(after)))
    return out


@lru_cache(1)
def default_field() -> Field:
    return fit(labelled_table())


# -------------------------------------------------------------------- operator


def _found(words: C.Words, tags: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row, first byte, kind, end byte) of the tagged runs, without the punctuation around."""
    at = np.flatnonzero(tags)
    if not len(at):
        return
    row = np.searchsorted(words.first, at, "right") - 1
    group: list[list[int]] = []
    for i, r, t in zip(at.tolist(), row.tolist(), tags[at].tolist(), strict=True):
        kind = (t - 1) // 2
        if t % 2 == 0 and group and group[-1][1] == i - 1 and group[-1][2] == kind and group[-1][3] == r:
            group[-1][1] = i
        else:
            group.append([i, i, kind, r])
    for a, b, kind, r in group:
        s, e = int(words.starts[a]), int(words.ends[b])
        raw = words.buf[s:e].tobytes()
        left = len(raw) - len(raw.lstrip(_EDGES))
        right = len(raw) - len(raw.rstrip(_EDGES))
        if raw[left:left + 1] and raw[max(0, left - 1):left] == b"(" and kind == 3:
            left -= 1
        if left + right < len(raw):
            yield r, s + left, kind, e - right


def spans_of(texts: list[str], column: pa.Array, field: Field) -> tuple[list[list], list[list]]:
    """For every text: the patterns' spans, and these with the field's that don't touch one of them, as (start, kind, end)."""
    base = [base_spans(t) for t in texts]
    more: list[list] = [[] for _ in texts]
    for lo, hi, words in C.pieces(column):
        found = list(_found(words, decode(field, words)))
        if not found:
            continue
        size = np.array([len(t.encode()) if not t.isascii() else len(t) for t in texts[lo:hi]])
        begin = np.cumsum(size) - size
        for r, s, kind, e in found:
            t = texts[lo + r]
            s, e = s - int(begin[r]), e - int(begin[r])
            if not t.isascii():
                raw = t.encode()
                s, e = len(raw[:s].decode()), len(raw[:e].decode())
            if not any(s < b and a < e for a, _, b in base[lo + r]):
                more[lo + r].append((s, kind, e))
    return base, [sorted(b + m) for b, m in zip(base, more, strict=True)]


def _line(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _scan(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = model.value
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            texts = [t or "" for t in column.to_pylist()]
            base, spans = spans_of(texts, column, field)
            counts = [pa.array([sum(k == i for _, k, _ in b) for b in base], pa.int64()) for i in range(4)]
            digest = pa.array([hashlib.sha256(_line(b).encode()).hexdigest() for b in base])
            names = [*batch.schema.names[:-1], "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *counts, digest, pa.array([_line(s) for s in spans], pa.string())], names)

    return run


def find(docs: DataFrame, *keep: str, field: Field | None = None) -> DataFrame:
    """The columns `keep` of docs (text), with counts per kind, base_sha256 and spans, for every row.

    spans lists kind:start:end in code points, by start and then kind; those of
    the patterns, and those of the field that overlap none of them. A null or
    empty text has none. Repeated rows are kept, other columns ignored; a kept
    column that is named like a result is replaced by it.
    """
    C.small_batches(docs.sparkSession)
    d = C.scanned(docs, keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in d.drop("_scanned").schema] + [_FOUND])
    out = d.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(field or default_field())), schema)
    return C.renamed(out, keep, ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"))


def _mask_texts(model, at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = model.value
        for batch in batches:
            column = batch.column(at)
            texts = column.to_pylist()
            _, spans = spans_of([t or "" for t in texts], column, field)
            out = []
            for t, found in zip(texts, spans, strict=True):
                if found:
                    parts, end = [], 0
                    for s, k, e in found:
                        if s >= end:
                            parts += [t[end:s], f"[{KINDS[k].upper()}]"]
                        end = max(end, e)
                    t = "".join([*parts, t[end:]])
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return run


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with every span of `find` in text replaced by its kind in brackets.

    All columns and rows stay as they are, repeated ones too; of spans that
    overlap the first is replaced. A null text stays null.
    """
    C.small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(field or default_field())
    return docs.mapInArrow(_mask_texts(model, docs.columns.index("text")), docs.schema)
