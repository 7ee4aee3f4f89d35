"""Quantities recorded in different units: unit strings are segmented by dynamic programming over tries.

A unit string is folded to lower case and split by a search over three tries - prefixes (numbers, multiplier words, SI
prefixes), roots (units with their dimension and exact size) and exponents - with separators and stop words in
between. Every full decomposition has a cost; the dimension the row's quantity should have is a prior on it, so ``t``
is a tonne in a production row and ``an`` an animal in a stock row. Sizes are exact decimals and the conversion is done
in decimal arithmetic, rounded half up.

Defined cases: a null, NaN or negative value is missing; a unit that is null, a filler or a pointer ("see note") is
looked for in the element label and then in the note; where nothing can be told, or the dimension contradicts the
quantity, the unit is null and so is the converted value. Zero is a value. Repeated rows give the same answer.
"""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np
import pandas as pd

# The common unit of each quantity, and the element labels that name the quantity.
COMMON = {"count": "head", "mass": "kg", "mass/count": "g", "area": "m2"}
QUANTITIES = {
    "stock": "count", "slaughtered": "count", "producing animals": "count", "production": "mass",
    "yield": "mass/count", "carcass weight": "mass/count", "area": "area",
}

# Multipliers, units with dimension and size in the base units head, kg and m2, and exponents.
PREFIXES = {
    "k": "1000", "kilo": "1000", "h": "100", "hecto": "100", "da": "10", "c": "0.01", "centi": "0.01", "m": "0.001",
    "milli": "0.001", "mega": "1000000", "hundred": "100", "hundreds": "100", "thousand": "1000",
    "thousands": "1000", "million": "1000000", "millions": "1000000", "mio": "1000000", "mn": "1000000",
    "billion": "1000000000", "dozen": "12", "'000": "1000", "000": "1000", "000s": "1000",
}
ROOTS = {
    "head": ("count", "1"), "heads": ("count", "1"), "hd": ("count", "1"), "an": ("count", "1"),
    "animal": ("count", "1"), "animals": ("count", "1"), "no": ("count", "1"), "number": ("count", "1"),
    "g": ("mass", "0.001"), "gr": ("mass", "0.001"), "gram": ("mass", "0.001"), "grams": ("mass", "0.001"),
    "kg": ("mass", "1"), "kgs": ("mass", "1"), "kilogram": ("mass", "1"), "kilograms": ("mass", "1"),
    "q": ("mass", "100"), "quintal": ("mass", "100"), "quintals": ("mass", "100"),
    "t": ("mass", "1000"), "tonne": ("mass", "1000"), "tonnes": ("mass", "1000"), "mt": ("mass", "1000"),
    "metric ton": ("mass", "1000"), "metric tons": ("mass", "1000"), "metric tonne": ("mass", "1000"),
    "metric tonnes": ("mass", "1000"), "ton": ("mass", "1000"), "tons": ("mass", "1000"),
    "short ton": ("mass", "907.18474"), "short tons": ("mass", "907.18474"),
    "long ton": ("mass", "1016.0469088"), "long tons": ("mass", "1016.0469088"),
    "lb": ("mass", "0.45359237"), "lbs": ("mass", "0.45359237"), "pound": ("mass", "0.45359237"),
    "pounds": ("mass", "0.45359237"), "oz": ("mass", "0.028349523125"), "ounce": ("mass", "0.028349523125"),
    "ounces": ("mass", "0.028349523125"), "cwt": ("mass", "45.359237"), "stone": ("mass", "6.35029318"),
    "m": ("length", "1"), "metre": ("length", "1"), "metres": ("length", "1"), "meter": ("length", "1"),
    "meters": ("length", "1"), "km": ("length", "1000"), "kilometre": ("length", "1000"),
    "kilometres": ("length", "1000"), "kilometer": ("length", "1000"), "kilometers": ("length", "1000"),
    "mile": ("length", "1609.344"), "miles": ("length", "1609.344"), "ft": ("length", "0.3048"),
    "ha": ("area", "10000"), "hectare": ("area", "10000"), "hectares": ("area", "10000"),
    "acre": ("area", "4046.8564224"), "acres": ("area", "4046.8564224"), "ac": ("area", "4046.8564224"),
}
EXPONENTS = {"2": 2, "^2": 2, "²": 2, "**2": 2, "squared": 2}
SQUARE = ("sq", "square")
STOP = (
    "in", "of", "single", "live", "figures", "given", "expressed", "weight", "weights", "all", "amounts", "carcass",
    "count", "surface", "area", "grazing", "land", "meat", "estimate", "official", "figure", "nb", "number",
)
PER = ("/", "per")
MISSING_UNIT = {"", "-", "--", "?", "n/a", "na", "none", "null", "nan", "unknown", "unk", "see note", "see notes", "see element"}


def _trie(words) -> dict:
    root: dict = {}
    for word in words:
        node = root
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = word
    return root


_TRIES = {
    "prefix": _trie(PREFIXES), "root": _trie(ROOTS), "exponent": _trie(EXPONENTS), "square": _trie(SQUARE),
    "stop": _trie(STOP), "per": _trie(PER),
}
_NUMBER = re.compile(r"10\^(\d+)|\d{1,3}(?:[ ,]000)+(?!\d)|\d+(?:\.\d+)?")


def _matches(kind: str, text: str, at: int):
    node = _TRIES[kind]
    while True:
        if "" in node:
            yield node[""], at
        if at >= len(text) or text[at] not in node:
            return
        node = node[text[at]]
        at += 1


def _boundary(text: str, at: int) -> bool:
    return at in (0, len(text)) or not (text[at - 1].isalpha() and text[at].isalpha())


#: Cost of each part of a decomposition: an SI prefix glued to a root is dearer than the root that spells both.
_COST = {"root": 1.0, "word prefix": 0.5, "si prefix": 1.6, "number": 0.4, "exponent": 0.2, "square": 0.3, "stop": 0.6, "per": 0.1, "gap": 0.0}
_WRONG_DIMENSION = 50.0


def segment(text: str, expected: str | None = None) -> tuple[str, Decimal] | None:
    """(dimension, size in base units) of the cheapest full decomposition of a folded unit string, or None.

    States are (position, dimension so far, numerator or denominator, pending square, seen root); each keeps its
    cheapest (cost, factor). A decomposition whose dimension differs from the expected one pays for it.
    """
    text = text.lower().strip().strip(".;")
    states: list[dict] = [{} for _ in range(len(text) + 1)]
    states[0][("", False, False, False)] = (0.0, Decimal(1))

    def put(at: int, state: tuple, cost: float, factor: Decimal) -> None:
        if state not in states[at] or cost < states[at][state][0]:
            states[at][state] = (cost, factor)

    for i in range(len(text)):
        for (dim, below, square, fresh), (cost, factor) in list(states[i].items()):
            if text[i] in " ()[].,;:-" and not fresh:
                put(i + 1, (dim, below, square, False), cost + _COST["gap"], factor)
            if fresh is False and _boundary(text, i):
                if m := _NUMBER.match(text, i):
                    size = Decimal(10) ** int(m[1]) if m[1] else Decimal(re.sub("[ ,]", "", m[0]))
                    if size > 0 and not below:
                        put(m.end(), (dim, below, square, False), cost + _COST["number"], factor * size)
                for word, j in _matches("stop", text, i):
                    if _boundary(text, j):
                        put(j, (dim, below, square, False), cost + _COST["stop"], factor)
                for word, j in _matches("square", text, i):
                    if _boundary(text, j):
                        put(j, (dim, below, True, False), cost + _COST["square"], factor)
                for word, j in _matches("per", text, i):
                    if dim and not below and (word == "/" or _boundary(text, j)):
                        put(j, (dim, True, square, False), cost + _COST["per"], factor)
            for word, j in _matches("prefix", text, i):
                if not fresh and (_boundary(text, i) or not word[0].isalpha()) and not below:
                    whole = _boundary(text, j)
                    put(j, (dim, below, square, not whole), cost + _COST["word prefix" if whole else "si prefix"], factor * Decimal(PREFIXES[word]))
            for word, j in _matches("root", text, i):
                if not (fresh or _boundary(text, i)):
                    continue
                kind, size = ROOTS[word]
                ends = [(j, 1, 0.0)] + [(e, EXPONENTS[x], _COST["exponent"]) for x, e in _matches("exponent", text, j)]
                for e, power, extra in ends:
                    if not _boundary(text, e):
                        continue
                    power = 2 if square and power == 1 else power
                    name = {("length", 2): "area"}.get((kind, power), kind if power == 1 else f"{kind}^{power}")
                    worth = Decimal(size) ** power
                    if below:
                        full, made = f"{dim}/{name}", factor / worth
                    elif dim:
                        if dim != "count" or name != "count":  # "heads of live animals" is still one count
                            continue
                        full, made = dim, factor * worth
                    else:
                        full, made = name, factor * worth
                    if full.count("/") < 2:
                        put(e, (full, False, False, False), cost + _COST["root"] + extra, made)
    ends = [(c + (_WRONG_DIMENSION if expected and d != expected else 0), d, f) for (d, below, sq, fresh), (c, f) in states[-1].items() if d and not below and not fresh and not sq]
    if not ends:
        return None
    cost, dim, factor = min(ends, key=lambda x: x[0])
    return dim, factor


def quantity_of(element: str | None) -> str | None:
    """The dimension a row's element label calls for; the part before the unit decides, the earliest label wins."""
    label = re.sub(r"\s+", " ", (element or "").lower())
    found = [(label.find(word), dim) for word, dim in QUANTITIES.items() if word in label]
    return min(found)[1] if found else None


def _candidates(unit: str | None, element: str | None, note: str | None):
    plain = (unit or "").strip().strip("()[]. ").lower()
    if plain not in MISSING_UNIT:
        yield unit
        return
    label = (element or "").strip()
    if m := re.search(r"[,(\[](.*)$", label):
        yield m[1]
    for piece in [note or "", *re.split(r"[;,]", note or "")]:
        if piece.strip():
            yield piece


@lru_cache(maxsize=100_000)
def unit_of(unit: str | None, element: str | None, note: str | None) -> tuple[str, Decimal] | None:
    """(common unit, factor to it) of a row, or None where the unit can't be told."""
    expected = quantity_of(element)
    if expected is None:
        return None
    for text in _candidates(unit, element, note):
        text = re.sub(r"^\s*nb\s+", "", text.lower())
        parsed = segment(text, expected)
        if parsed and parsed[0] == expected:
            return COMMON[expected], parsed[1] * (1000 if expected == "mass/count" else 1)
    return None


def convert(value: float | None, factor: Decimal) -> int:
    return int((Decimal(repr(float(value))) * factor).quantize(Decimal(1), ROUND_HALF_UP))


def _rounded(values: np.ndarray, factors: np.ndarray, exact: list[Decimal | None]) -> np.ndarray:
    """values * factors rounded half up. Doubles decide wherever their error can't reach the nearest half; the few products
    near a half, and those beyond the exact integers, are done in decimals."""
    product = values * factors
    near = (np.abs(product - np.floor(product) - 0.5) <= np.abs(product) * 8e-15 + 1e-12) | (product >= 2.0**51)
    out = np.floor(product + 0.5)
    whole = out.astype(object)
    for i in np.flatnonzero(near):
        whole[i] = convert(values[i], exact[i])
    whole[~near] = out[~near].astype(np.int64)
    return whole


def to_common(unit: pd.Series, element: pd.Series, note: pd.Series, value: pd.Series) -> pd.DataFrame:
    """One Arrow batch: each distinct (unit, element, note) is segmented once, values are converted as arrays."""
    keys = pd.MultiIndex.from_arrays([unit.astype(object), element.astype(object), note.astype(object)])
    codes, distinct = pd.factorize(keys)
    told = [unit_of(*(None if x is None or x != x else x for x in key)) for key in distinct]
    amounts = value.to_numpy(dtype=float)
    with np.errstate(invalid="ignore"):
        good = np.isfinite(amounts) & (amounts >= 0) & np.array([told[c] is not None for c in codes], dtype=bool)
    names = np.full(len(codes), None, dtype=object)
    values = np.full(len(codes), None, dtype=object)
    at = np.flatnonzero(good)
    if len(at):
        names[at] = [told[c][0] for c in codes[at]]
        factors = [told[c][1] for c in codes[at]]
        values[at] = _rounded(amounts[at], np.array([float(f) for f in factors]), factors)
    return pd.DataFrame({"common_unit": pd.Series(names, dtype="object"), "common_value": pd.array(values, dtype="Int64")})
