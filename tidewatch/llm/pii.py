"""Personal information inside free text: found by a character BiLSTM with CRF transitions, replaced by placeholders.

Texts are cut into overlapping windows of characters, windows of similar length run through the network together (numpy
only), and each window's best tag path is decoded. A span belongs to the window in whose inner part it starts, so every
span is decided where it has context on both sides; what windows leave overlapping is reconciled over the whole text.
An exact check of the kind's shape follows and trims what isn't part of the passage. The weights lie beside this module
and come from ``pii_train``; they are a few hundred kilobytes and travel with the code.

Defined cases: null and empty texts have no spans and stay as they are; texts of any length are read whole, in bounded
memory; a passage that occurs several times in a text is one row of the found spans.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

KINDS = ("email", "phone", "id_number", "street_address", "name")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
WEIGHTS = Path(__file__).with_name("pii_weights.npz")
#: Characters of a window, of its outer parts on each side, and windows that run together.
WINDOW, MARGIN, BATCH = 640, 60, 192
#: Characters that a worker takes from a batch of rows at once.
CHARS_AT_ONCE = 1_500_000


@lru_cache
def _classes() -> np.ndarray:
    """Class of each character of the basic plane: printable ASCII by itself, others by base letter or category."""
    table = np.full(0x10000, 103, dtype=np.uint8)
    for code in range(0x10000):
        base = unicodedata.normalize("NFKD", chr(code))[0] if not 0xD800 <= code < 0xE000 else "\ufffd"
        category = unicodedata.category(chr(code))
        if code == 10 or code == 13:
            table[code] = 96
        elif category == "Cf" or category == "Mn":
            table[code] = 97
        elif code == 0xA0:
            table[code] = 98
        elif 32 <= ord(base) < 127:
            table[code] = ord(base) - 31
        elif category == "Lu":
            table[code] = 99
        elif category[0] == "L":
            table[code] = 100
        elif category[0] == "N":
            table[code] = 101
        elif category[0] in "ZC":
            table[code] = 102
    return table


CLASSES = 104


def char_classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _classes()[np.minimum(codes, 0xFFFF)]


def lstm(table: np.ndarray, recurrent: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Hidden states (T, B, H) over classes x (T, B); the gates' order is input, forget, output, candidate.

    ``table`` holds each class's input projection with bias; the first three gates are pre-scaled for sigmoid by tanh.
    """
    steps, batch = x.shape
    h_size = recurrent.shape[0]
    h = np.zeros((batch, h_size), np.float32)
    c = np.zeros((batch, h_size), np.float32)
    out = np.empty((steps, batch, h_size), np.float32)
    for t in range(steps):
        g = h @ recurrent
        g += table[x[t]]
        np.tanh(g, out=g)
        g[:, : 3 * h_size] *= 0.5
        g[:, : 3 * h_size] += 0.5
        c *= g[:, h_size : 2 * h_size]
        c += g[:, :h_size] * g[:, 3 * h_size :]
        h = g[:, 2 * h_size : 3 * h_size] * np.tanh(c)
        out[t] = h
    return out


@lru_cache(maxsize=1)
def _model() -> dict[str, np.ndarray]:
    with np.load(WEIGHTS) as stored:
        p = {k: stored[k].astype(np.float32) for k in stored.files}
    return prepare(p)


def prepare(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Inference form of trained parameters: halves the sigmoid gates' inputs and forbids broken tag sequences."""
    h = p["rec_f"].shape[0]
    scale = np.r_[np.full(3 * h, 0.5), np.ones(h)].astype(np.float32)
    out = {f"{k}_{d}": p[f"{k}_{d}"] * scale for k in ("tab", "rec") for d in "fb"}
    trans = p["trans"].copy()
    start = np.zeros(len(TAGS), np.float32)
    for j, tag in enumerate(TAGS):
        if tag[0] == "I":
            start[j] = -1e4
            for i, before in enumerate(TAGS):
                if before[1:] != tag[1:]:
                    trans[i, j] = -1e4
    return out | {"out": p["out"], "bias": p["bias"], "trans": trans, "start": start}


def emissions(m: dict[str, np.ndarray], x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Tag scores (T, B, K). Columns are padded behind; the backward pass reads each one reversed within its length."""
    steps, batch = x.shape
    back = np.arange(steps)[:, None]
    back = np.where(back < lengths, lengths - 1 - back, back)
    columns = np.arange(batch)[None, :]
    fwd = lstm(m["tab_f"], m["rec_f"], x)
    bwd = lstm(m["tab_b"], m["rec_b"], x[back, columns])[back, columns]
    h = fwd.shape[2]
    return fwd @ m["out"][:h] + bwd @ m["out"][h:] + m["bias"]


def best_paths(m: dict[str, np.ndarray], scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Viterbi over a batch (T, B, K); tags behind a column's length are O."""
    steps, batch, k = scores.shape
    from_ = np.zeros((steps, batch, k), np.int8)
    best = scores[0] + m["start"]
    identity = np.arange(k, dtype=np.int8)
    for t in range(1, steps):
        reach = best[:, :, None] + m["trans"]
        arg = reach.argmax(1)
        inside = (t < lengths)[:, None]
        from_[t] = np.where(inside, arg, identity)
        best = np.where(inside, np.take_along_axis(reach, arg[:, None, :], 1)[:, 0] + scores[t], best)
    tags = np.zeros((steps, batch), np.int8)
    at = best.argmax(1)
    rows = np.arange(batch)
    for t in range(steps - 1, -1, -1):
        tags[t] = at
        at = from_[t, rows, at]
    tags[np.arange(steps)[:, None] >= lengths] = 0
    return tags


def _spans(tags: np.ndarray) -> list[tuple[int, int, str]]:
    out, begin, kind = [], None, ""
    for i in np.flatnonzero(tags):
        tag = TAGS[tags[i]]
        if tag[0] == "B" or kind != tag[2:] or begin is None or i != end:  # noqa: F821
            if begin is not None:
                out.append((begin, end, kind))  # noqa: F821
            begin, kind = int(i), tag[2:]
        end = int(i) + 1
    if begin is not None:
        out.append((begin, end, kind))
    return out


def raw_spans(texts: list[str], model: dict[str, np.ndarray] | None = None) -> list[list[tuple[int, int, str]]]:
    """Spans that the network finds in each text, windows reconciled, before the exact check."""
    m = model or _model()
    windows = []  # (length, text index, offset, classes)
    for i, text in enumerate(texts):
        classes = char_classes(text)
        n = len(classes)
        step = WINDOW - 2 * MARGIN
        for at in range(0, max(n - 2 * MARGIN, 1), step):
            part = classes[at : at + WINDOW]
            if len(part):
                windows.append((len(part), i, at, at == 0, at + WINDOW >= n, part))
    windows.sort(key=lambda w: w[0])
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for at in range(0, len(windows), BATCH):
        group = windows[at : at + BATCH]
        lengths = np.array([w[0] for w in group])
        x = np.zeros((lengths.max(), len(group)), np.uint8)
        for j, w in enumerate(group):
            x[: w[0], j] = w[5]
        tags = best_paths(m, emissions(m, x, lengths), lengths)
        for j, (n, i, offset, first, last, _) in enumerate(group):
            low, high = (0 if first else MARGIN), (n if last else n - MARGIN)
            found[i] += [(offset + a, offset + b, k) for a, b, k in _spans(tags[:n, j]) if low <= a < high]
    return [_reconciled(spans) for spans in found]


def _reconciled(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for a, b, k in sorted(set(spans), key=lambda s: (s[0], -s[1])):
        if out and a < out[-1][1]:
            if b - a > out[-1][1] - out[-1][0]:
                out[-1] = (a, b, k)
        else:
            out.append((a, b, k))
    return out


_SP = r"[ \u00a0]"
_AT = rf"(?:{_SP}?[@\uff20]{_SP}?|{_SP}?[\[(]{_SP}?at{_SP}?[\])]{_SP}?|{_SP}at{_SP})"
_DOT = rf"(?:\.|{_SP}?[\[(]{_SP}?dot{_SP}?[\])]{_SP}?|{_SP}dot{_SP})"
_SHAPES = {
    "email": re.compile(rf"[\w.+%-]*\w{_AT}[\w-]+(?:{_DOT}[\w-]+)*", re.I),
    "phone": re.compile(r"[+(]?\d[\d \u00a0().,/\u2010-\u2015-]{3,}\d"),
    "id_number": re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9 \u00a0.\u2010-\u2015-]*[A-Za-z0-9])?"),
    "street_address": re.compile(r"\w.*(?:\w|\bAve\.|\bRd\.|\bSt\.|[A-Z]\.)", re.S),
    "name": re.compile(r"[^\W\d_]['\u2019.\w-]*(?:,?[ \u00a0][^\W\d_]['\u2019.\w-]*)*"),
}


def checked(text: str, begin: int, end: int, kind: str) -> tuple[int, int] | None:
    """The exact passage of a found span, or None where its shape can't be of that kind."""
    # a span never ends inside a word
    while begin > 0 and text[begin - 1].isalnum() and text[begin].isalnum() and kind != "name":
        begin -= 1
    while end < len(text) and text[end].isalnum() and text[end - 1].isalnum():
        end += 1
    m = _SHAPES[kind].search(text, begin, end)
    if not m:
        return None
    passage = m[0]
    if kind == "email" and not re.search(r"[@\uff20]|at", passage, re.I):
        return None
    if kind in ("phone", "id_number", "street_address") and not any(c.isdigit() for c in passage) or kind == "name" and any(c.isdigit() for c in passage):
        return None
    a, b = m.span()
    if kind == "email" and (more := _SHAPES["email"].match(text, a)) and more.end() > b:
        b = more.end()
    if kind == "phone" and (more := _PAIRS.match(text, a)) and more.end() > b:
        b = more.end()
    if kind == "name":
        return _name(text, a, b)
    if kind == "street_address" and text[b : b + 1] == "." and re.search(r"\bAve$", text[a:b]):
        b += 1
    return a, b


#: The French national number: sex, year, month, department, commune, order, key. No phone number has this form.
_INSEE = re.compile(r"[12](?:[ \u00a0]\d\d){3}[ \u00a0]\d{3}[ \u00a0]\d{3}[ \u00a0]\d\d")
#: A number written in pairs of digits goes on to its last pair.
_PAIRS = re.compile(r"(?:\+33|0033|0\d)(?:[ \u00a0.-]\d{1,2}){4,5}(?!\d)")
_TOKEN = re.compile(r"[A-Z]\.|[^\W\d_](?:[^\W\d_]|['\u2019-](?=\w))*")
# Titles and words that introduce a name and are no part of it.
_LEAD = {"dr", "mr", "mrs", "ms", "m", "mme", "herr", "frau", "sr", "sra", "selon", "según", "laut", "according", "to", "by", "la", "le", "el", "the", "signed", "contact", "person", "with"}


# Small words inside a capitalised name.
_PARTICLES = {
    "af", "al", "auf", "av", "bin", "bint", "da", "dal", "das", "de", "degli", "dei", "del", "della", "dem", "den", "der", "des", "di", "do", "dos", "du",
    "e", "el", "ibn", "la", "las", "le", "les", "los", "ten", "ter", "und", "van", "vom", "von", "y", "zu", "zum", "zur",
}


def _name(text: str, begin: int, end: int) -> tuple[int, int] | None:
    """The longest run of name words in a found span: capitalised words and initials, with particles between them, or small
    words throughout."""
    while begin > 0 and text[begin - 1].isalpha() and text[begin].isalpha():
        begin -= 1
    tokens = [m.span() for m in _TOKEN.finditer(text, begin, end)]
    while tokens and text[slice(*tokens[0])].lower().strip(".") in _LEAD:
        tokens.pop(0)
    runs: list[list[tuple[int, int]]] = []
    for t in tokens:
        big = text[t[0]].isupper()
        joined = runs and re.fullmatch(r",?[ \u00a0]", text[runs[-1][-1][1] : t[0]])
        if joined and text[runs[-1][0][0]].isupper() == big:
            runs[-1].append(t)
        elif joined and big and len(runs) > 1 and all(text[slice(*x)] in _PARTICLES for x in runs[-1]) and re.fullmatch(r"[ \u00a0]", text[runs[-2][-1][1] : runs[-1][0][0]]):
            runs[-2:] = [[*runs[-2], *runs[-1], t]]  # a capitalised run, particles, and now a capitalised word
        else:
            runs.append([t])
    if not runs:
        return None
    run = max(runs, key=lambda r: r[-1][1] - r[0][0])
    a, b = run[0][0], run[-1][1]
    # a first name or initial right before, left out by the network
    if before := re.search(r"(?<!\w)(?:[A-Z]\.|[A-Z][a-zà-ÿ]+(?:-[A-Z][a-zà-ÿ]+)?)[ \u00a0]$", text[max(0, a - 24) : a]):
        word = before[0][:-1]
        if word.lower().strip(".") not in _LEAD and (word.endswith(".") or text[a : a + 2].endswith(".")):
            a -= len(before[0])
    return a, b


def spans_of(texts: list[str], model: dict[str, np.ndarray] | None = None) -> list[list[tuple[int, int, str]]]:
    out = []
    for text, spans in zip(texts, raw_spans(texts, model)):
        spans = [(a, b, "id_number" if k == "phone" and _INSEE.fullmatch(text, a, b) else k) for a, b, k in spans]
        good = [(*ab, k) for a, b, k in spans if (ab := checked(text, a, b, k))]
        out.append(_reconciled(good))
    return out


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _portions(ids, texts) -> Iterator[tuple[list, list[str]]]:
    keys, part, chars = [], [], 0
    for key, text in zip(ids, texts):
        if text:
            keys.append(key)
            part.append(text)
            chars += len(text)
        if chars >= CHARS_AT_ONCE:
            yield keys, part
            keys, part, chars = [], [], 0
    if part:
        yield keys, part


def spread(documents: DataFrame, doc_id: str) -> DataFrame:
    """The network reads the input's splits where they are. Only an input of fewer splits than the cluster's cores could take
    four times over is moved, so that every core gets its share; its size is then a few splits a core."""
    wanted = 4 * documents.sparkSession.sparkContext.defaultParallelism
    return documents if documents.rdd.getNumPartitions() >= wanted else documents.repartition(wanted, doc_id)


def find(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct (doc_id, kind, passage)."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, part in _portions(batch[doc_id], batch[text]):
                rows = sorted({(d, k, t[a:b]) for d, t, spans in zip(keys, part, spans_of(part)) for a, b, k in spans})
                yield pd.DataFrame(rows, columns=[doc_id, "kind", "passage"])

    schema = f"{doc_id} {dict(documents.dtypes)[doc_id]}, kind string, passage string"
    return spread(documents.select(doc_id, text), doc_id).mapInPandas(scan, schema)


def redact(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with typed placeholders; null and empty texts as they are."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done: dict = {}
            for keys, part in _portions(range(len(batch)), batch[text]):
                done |= {i: redacted(t, s) for i, t, s in zip(keys, part, spans_of(part))}
            out = [done.get(i, t) for i, t in enumerate(batch[text])]
            yield pd.DataFrame({doc_id: batch[doc_id], text: pd.Series(out, dtype="object", index=batch.index)})

    schema = f"{doc_id} {dict(documents.dtypes)[doc_id]}, {text} string"
    return spread(documents.select(doc_id, text), doc_id).mapInPandas(scan, schema)
