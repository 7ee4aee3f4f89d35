"""Evaluation texts leaking into training text.

Held-out items are cut into n-grams of normalised words; their hashes are a broadcast set while the items stay under a
stated size. Each document is scanned once, without a shuffle: windows of n words are hashed, a hit is verified word by
word against the items that have the hash, and overlapping hits merge into spans that can be removed. Items beyond the
size go through a join instead: a bit map of fixed size of the items' hashes is broadcast, only windows whose bit is set
leave the scan, and they meet the items' n-grams on the hash, verified by the words. Both ways find and remove the same.

Normalised words are runs of letters or digits after compatibility decomposition, removal of accents and of invisible
format characters, case folding and mapping of look-alike letters of other scripts to Latin ones. Every step works letter
by letter, so that words keep their places in the original text.

Defined cases: null and empty texts hold nothing; items with fewer than n words can't leak; items that repeat each
other are all reported; a document or item of any length is taken whole; no items or no documents give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N = 12
#: Words of all items together up to which their n-grams are broadcast (about 100 bytes a word in a Python worker).
BROADCAST_WORDS = 1_000_000
#: Bits of the map of hashes that is broadcast for larger items (8 MB), and the tasks that fill parts of it.
BITS, BIT_TASKS = 1 << 26, 16

# Cyrillic and Greek letters that look like the Latin letter below them (lower case).
LOOK_ALIKES = "авекмнорстухіјѕԁԛԝһᴄοανικρτυχ", "abekmhopctyxijsdqwhcoavikptux"
_TABLE = str.maketrans(*LOOK_ALIKES)
_WORD = re.compile(r"[^\W_]+")
# Invisible format characters, which never end a word.
_INVISIBLE = "­͏؜᠎​-‏‪-‮⁠-⁤﻿︀-️"
_HIDDEN = re.compile(f"[{_INVISIBLE}]")


@lru_cache(maxsize=70_000)
def _fold_letter(letter: str) -> str:
    plain = "".join([c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c) and not _HIDDEN.match(c)])
    return plain.casefold().translate(_TABLE)


def _fold(text: str) -> str:
    """All letters at once, which is faster; equal to the folded letters in a row, as no step looks at neighbours except the
    order of marks, and marks are dropped."""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKD", text))
        text = "".join([c for c in text if not unicodedata.combining(c)]) if not text.isascii() else text
    text = text.casefold()
    return text if text.isascii() else text.translate(_TABLE)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(_fold(text)) if text else []


def words_with_places(text: str | None) -> list[tuple[str, int, int]]:
    """(word, start, end) in the original text of the words of ``words_of``; marks that follow the last letter of a word belong
    to it."""
    if not text:
        return []
    if text.isascii():
        return [(m[0], m.start(), m.end()) for m in _WORD.finditer(text.casefold())]
    parts = [_fold_letter(c) for c in text]
    places = [i for i, part in enumerate(parts) for _ in part]
    found = []
    for m in _WORD.finditer("".join(parts)):
        end = places[m.end() - 1] + 1
        while end < len(text) and not parts[end] and unicodedata.combining(text[end]):
            end += 1
        found.append((m[0], places[m.start()], end))
    return found


def _key(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words))


class Index:
    """The n-grams of the items: hash -> [(item, position)], the items' words, and their vocabulary."""

    def __init__(self, items: list[tuple[int, str | None]], n: int = N):
        self.n = n
        self.words = {i: w for i, t in items if len(w := words_of(t)) >= n}
        self.vocabulary = {w for ws in self.words.values() for w in ws}
        self.grams: dict[int, list[tuple[int, int]]] = {}
        for item, ws in self.words.items():
            for k in range(len(ws) - n + 1):
                self.grams.setdefault(_key(ws[k : k + n]), []).append((item, k))

    def hits(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """(position, item) of every verified window. A window is hashed only if all its words occur in some item."""
        n, run = self.n, 0
        for at, word in enumerate(words):
            run = run + 1 if word in self.vocabulary else 0
            if run >= n:
                window = words[at - n + 1 : at + 1]
                for item, k in self.grams.get(_key(window), ()):
                    if self.words[item][k : k + n] == window:
                        yield at - n + 1, item


def _small_enough(items: DataFrame, text: str) -> bool:
    counted = items.agg(F.sum(F.length(text))).first()[0] or 0
    return counted <= 4 * BROADCAST_WORDS


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str = "text", n: int = N) -> DataFrame:
    """Distinct (doc_id, item_id): the document holds at least n consecutive words of the item."""
    spark = documents.sparkSession
    schema = f"{doc_id} {dict(documents.dtypes)[doc_id]}, {item_id} {dict(items.dtypes)[item_id]}"
    docs = documents.select(doc_id, text).where(F.length(text) > 0)
    if _small_enough(items, text):
        index = spark.sparkContext.broadcast(Index([tuple(r) for r in items.select(item_id, text).distinct().collect()], n))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(d, i) for d, t in zip(batch[doc_id], batch[text]) for i in sorted({i for _, i in index.value.hits(words_of(t))})]
                yield pd.DataFrame(rows, columns=[doc_id, item_id])

        return docs.mapInPandas(scan, schema).distinct()

    return _joined_hits(docs, items, doc_id, item_id, text, n).select(doc_id, item_id).distinct()


def _windows(words: list[str], n: int) -> dict[str, int]:
    """The n-grams of a text with the first place of each."""
    out: dict[str, int] = {}
    for j in range(len(words) - n + 1):
        out.setdefault(" ".join(words[j : j + n]), j)
    return out


def _bit_map(items: DataFrame, text: str, n: int) -> np.ndarray:
    """One bit for every hash of an n-gram of the items: a few tasks fill maps of fixed size, which are united."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(BITS // 8, dtype=np.uint8)
        for batch in batches:
            for t in batch[text]:
                at = np.array([xxhash.xxh64_intdigest(g) % BITS for g in _windows(words_of(t), n)], dtype=np.int64)
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pd.DataFrame({"bits": [bits.tobytes()]})

    whole = np.zeros(BITS // 8, dtype=np.uint8)
    for row in items.select(text).repartition(BIT_TASKS).mapInPandas(fill, "bits binary").toLocalIterator():
        whole |= np.frombuffer(row["bits"], dtype=np.uint8)
    return whole


def _joined_hits(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str, n: int) -> DataFrame:
    """(doc_id, item_id, gram) of every n-gram that a document shares with an item."""
    bits = docs.sparkSession.sparkContext.broadcast(_bit_map(items, text, n))

    def grams(key: str, filtered: bool):
        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for k, t in zip(batch[key], batch[text]):
                    rows = [(k, xxhash.xxh64_intdigest(g) - (1 << 63), g) for g in _windows(words_of(t), n)]
                    if filtered:
                        rows = [r for r in rows if bits.value[(h := (r[1] + (1 << 63)) % BITS) >> 3] >> (h & 7) & 1]
                    for at in range(0, len(rows), 10_000):
                        yield pd.DataFrame(rows[at : at + 10_000], columns=[key, "h", "gram"])

        return cut

    schema = lambda key, frame: f"{key} {dict(frame.dtypes)[key]}, h long, gram string"
    left = docs.mapInPandas(grams(doc_id, True), schema(doc_id, docs))
    right = items.select(item_id, text).mapInPandas(grams(item_id, False), schema(item_id, items))
    return left.join(right, ["h", "gram"]).select(doc_id, item_id, "gram")


def _without(text: str, grams: set[str] | None, hits, n: int) -> tuple[int, str] | None:
    """(number of spans, text without them), or None. ``hits(words)`` gives the places of leaked windows."""
    placed = words_with_places(text)
    words = [w for w, _, _ in placed]
    places = hits(words) if grams is None else {j for j in range(len(words) - n + 1) if " ".join(words[j : j + n]) in grams}
    spans: list[list[int]] = []
    for at in sorted(places):
        if spans and at <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], at + n)
        else:
            spans.append([at, at + n])
    if not spans:
        return None
    out, end = [], 0
    for a, b in spans:
        out.append(text[end : placed[a][1]])
        end = placed[b - 1][2]
    return len(spans), "".join([*out, text[end:]])


def remove_leaks(documents: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str = "text", n: int = N) -> DataFrame:
    """(doc_id, n_spans, clean_text) of the documents with leaked spans, the spans cut out."""
    spark = documents.sparkSession
    docs = documents.select(doc_id, text).where(F.length(text) > 0)
    schema = f"{doc_id} {dict(documents.dtypes)[doc_id]}, n_spans int, clean_text string"
    if _small_enough(items, text):
        index = spark.sparkContext.broadcast(Index([tuple(r) for r in items.select(item_id, text).distinct().collect()], n))

        def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                done = [(d, _without(t, None, lambda words: {p for p, _ in index.value.hits(words)}, n)) for d, t in zip(batch[doc_id], batch[text])]
                yield pd.DataFrame([(d, *x) for d, x in done if x], columns=[doc_id, "n_spans", "clean_text"])

        return docs.mapInPandas(clean, schema)

    # the leaked n-grams of a document are bounded by its own words
    leaked = _joined_hits(docs, items, doc_id, item_id, text, n).groupBy(doc_id).agg(F.collect_set("gram").alias("_grams"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [(d, _without(t, set(g), None, n)) for d, t, g in zip(batch[doc_id], batch[text], batch["_grams"])]
            yield pd.DataFrame([(d, *x) for d, x in done if x], columns=[doc_id, "n_spans", "clean_text"])

    return docs.join(leaked, doc_id).mapInPandas(cut, schema)
