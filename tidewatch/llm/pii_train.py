"""Trains the weights of ``pii``: python -m tidewatch.llm.pii_train DOCUMENTS.parquet

Two thirds of the windows come from made-up sentences (``pii_frames``), the rest from a bounded sample of documents
(``SAMPLE`` rows, chosen by a hash of their id, whole texts), labelled by the sentence frames that hold personal data and by
the shapes of numbers, e-mail and street addresses, and used with their passages exchanged for made-up ones. Steps, rate
and seed are fixed, so that a run can be repeated. Loss: negative log-likelihood of a linear-chain CRF; optimiser: Adam;
all in numpy; the gradients of a step are the mean over WORKERS processes.
"""

from __future__ import annotations

import hashlib
import multiprocessing
import random
import re
import sys
import time

import numpy as np

from tidewatch.llm import pii_frames
from tidewatch.llm.pii import CLASSES, KINDS, TAGS, WEIGHTS, char_classes, emissions, prepare, spans_of

#: Bound on the labelled documents, the network's size, characters of a window.
SAMPLE, HIDDEN, LENGTH = 10_000, 40, 192
#: Steps, processes, windows of each process and step, and the seed.
STEPS, WORKERS, WINDOWS, SEED = 4800, 8, 64, 11
#: The first steps, mostly on made-up sentences; the rest on documents for the larger part, from stored (rounded) weights.
FIRST, MADE_FIRST, MADE_REST = 3000, 0.7, 0.35

_W = r"[^\W\d_](?:[^\W\d_]|['’-])+"
_N = rf"(?:{_W}|[A-Z]\.)(?:,?[ \u00a0](?:{_W}|[A-Z]\.)){{0,2}}"
#: Frames of the sample's sentences around a name (before, after).
NAME_FRAMES = (
    ("According to ", " the feed was changed"), ("Reported by Dr ", " on site"), ("Interview with Ms ", ", keeper"),
    ("holding belongs to ", r"\."), ("Betrieb gehört ", r"\."), ("exploitation appartient à ", r"\."), ("Signalé par le Dr ", r"\."),
    ("granja es de ", r"\."), ("Gemeldet von Frau ", r"\."), ("contact person - ", r" -| \||;|\n|$"), ("Según ", ", cambió el pienso"),
    ("Selon ", ", l'aliment avait"), ("Avisó la Sra. ", r"\."), ("Signed: ", r" -| \||;|\n|$"), ("Laut ", " wurde das Futter"),
    ("", " first saw the sick"),
)
_D = r"[ \u00a0.\u2011-]"
PHONES = (
    rf"\+44{_D}?\(0\)\d\d{_D}\d{{4}}{_D}\d{{4}}", rf"\+44{_D}?\d{{4}}{_D}?\d{{6}}", rf"\+1{_D}\d{{3}}{_D}\d{{3}}{_D}\d{{4}}",
    rf"\+49{_D}\d\d{_D}\d{{5}}{_D}\d{{3}}", rf"\(\d{{3}}\){_D}\d{{3}}{_D}\d{{4}}", rf"(?:\+33|0033){_D}\d(?:{_D}\d\d){{4}}",
    r"1\.\d{3}\.\d{3}\.\d{4}", rf"030[ \u00a0]/[ \u00a0]\d{{5}}{_D}\d{{3}}", r"(?<![\d.-])[2-9]\d{9}(?!\d)", rf"(?<!\d{_D})(?<!\d)0\d(?:{_D}\d\d){{4}}(?!{_D}?\d)",
    rf"07\d{{3}}{_D}\d{{6}}", rf"(?<!\d-)(?<!\d)\d{{3}}[\u2011-]\d{{3}}[\u2011-]\d{{4}}(?!\d)",
)
IDS = (
    r"ZZ-\d{4}-\d{5}", r"XX\d{7}", r"QQ ?\d\d ?\d\d ?\d\d ?[A-D]\b", r"\d{3}\.\d{3}\.\d{3}-\d\d", r"(?<!\d)\d{8}-[A-Z]\b",
    r"(?<!\d )(?<!\d)[12] \d\d \d\d \d\d \d{3} \d{3} \d\d(?! ?\d)", r"(?<![\d-])9\d\d-\d\d-\d{4}(?!\d)",
)
_STREET = r"(?:Street|St|Road|Rd|Lane|Close|Avenue|Ave\.|Drive|Court)"
ADDRESSES = (
    rf"(?:Flat \d+, )?\d+[A-Z]? (?:[A-Z][a-z]+ ){{1,2}}{_STREET}(?![a-z])",
    r"\d+(?: bis| ter)?,? (?:rue|chemin|avenue|impasse|place|allée|quai|route|boulevard) (?:d[eu]s? |du |de la |de l')?[A-ZÉ][\w-]+(?: [A-ZÉ][\w-]+)?",
    r"(?:Calle|Camino|Plaza|Avenida|Avda\.|Paseo) (?:de(?:l| los| las| la)? )?[A-Z][\w-]+(?: [A-Z][\w-]+)? (?:n\.º )?\d+",
    r"(?:Obere |Untere |Alte |Neue )?[A-ZÄÖÜ][\wäöüß-]*(?:straße|str\.|weg|gasse|platz|allee|ring|damm|kamp|gasse) \d+[a-z]?\b|(?:Am|An der|Zum|Im|Auf dem) [A-ZÄÖÜ][\wäöüß-]+(?: [A-ZÄÖÜ][\wäöüß-]+)? \d+[a-z]?\b",
)
_AT = r"(?: ?[@\uff20] ?| ?[\[(]at[\])] ?| at )"
_DOT = r"(?:\.| ?[\[(]dot[\])] ?| dot )"
EMAILS = (rf"[\w+-]+(?:\.[\w+-]+)*{_AT}[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[a-zA-Z]{{2,}}",)


def label(text: str) -> list[tuple[int, int, str]]:
    """Spans of a document by frames and shapes."""
    spans: list[tuple[int, int, str]] = []
    for kind, patterns in (("email", EMAILS), ("phone", PHONES), ("id_number", IDS), ("street_address", ADDRESSES)):
        for p in patterns:
            spans += [(*m.span(), kind) for m in re.finditer(p, text)]
    for before, after in NAME_FRAMES:
        spans += [(*m.span(1), "name") for m in re.finditer(rf"(?<!\w){re.escape(before)}({_N})(?={after})", text, re.M)]
    out: list[tuple[int, int, str]] = []
    for a, b, k in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b, k))
    return out


def exchange(text: str, spans: list[tuple[int, int, str]], r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with its passages replaced by others of the same kind and shape."""
    out, at, moved = "", 0, []
    for a, b, k in spans:
        passage = text[a:b]
        if k == "name":
            passage = pii_frames.name(r)
        elif k != "email":
            passage = re.sub(r"\d", lambda m: m[0] if r.random() < 0.3 else str(r.randrange(10)), passage)
        elif r.random() < 0.3:
            passage = passage.swapcase() if r.random() < 0.3 else pii_frames.word(r).lower() + passage[r.randrange(0, 3) :]
        out += text[at:a]
        moved.append((len(out), len(out) + len(passage), k))
        out += passage
        at = b
    return out + text[at:], moved


def windows(text: str, spans: list[tuple[int, int, str]], r: random.Random, empty: int, at: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows around each span, and ``empty`` anywhere; or those that start ``at`` given places."""
    tags = np.zeros(len(text), np.int8)
    for a, b, k in spans:
        tags[a] = 1 + 2 * KINDS.index(k)
        tags[a + 1 : b] = 2 + 2 * KINDS.index(k)
    x = char_classes(text)
    starts = at if at is not None else [max(0, a - r.randrange(30, LENGTH - 40)) for a, _, _ in spans] + [r.randrange(0, max(1, len(text) - LENGTH)) for _ in range(empty)]
    out = []
    for s in starts:
        t = tags[s : s + LENGTH].copy()
        # a span cut at the front can't be told; its rest is kept as B, I, ...
        if len(t) and t[0] and t[0] % 2 == 0:
            t[0] -= 1
        if len(t) > 8:
            out.append((x[s : s + LENGTH], t))
    return out


class Net:
    """Parameters, loss and gradients."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        h, k = HIDDEN, len(TAGS)
        self.p = {}
        for d in "fb":
            self.p[f"tab_{d}"] = g.normal(0, 0.3, (CLASSES, 4 * h)).astype(np.float32)
            self.p[f"tab_{d}"][:, h : 2 * h] += 1.0
            self.p[f"rec_{d}"] = (g.normal(0, 1, (h, 4 * h)) / np.sqrt(h)).astype(np.float32)
        self.p |= {"out": g.normal(0, 0.1, (2 * h, k)).astype(np.float32), "bias": np.zeros(k, np.float32), "trans": np.zeros((k, k), np.float32)}
        self.p["bias"][0] = 2.0
        self.m = {n: np.zeros_like(v) for n, v in self.p.items()}
        self.v = {n: np.zeros_like(v) for n, v in self.p.items()}
        self.t = 0

    def _forward(self, d: str, x: np.ndarray):
        steps, batch = x.shape
        h_size = HIDDEN
        h, c = np.zeros((batch, h_size), np.float32), np.zeros((batch, h_size), np.float32)
        hs, cs, gs = [h], [c], []
        for t in range(steps):
            g = h @ self.p[f"rec_{d}"] + self.p[f"tab_{d}"][x[t]]
            g[:, : 3 * h_size] = 0.5 * np.tanh(0.5 * g[:, : 3 * h_size]) + 0.5
            g[:, 3 * h_size :] = np.tanh(g[:, 3 * h_size :])
            c = g[:, h_size : 2 * h_size] * c + g[:, :h_size] * g[:, 3 * h_size :]
            h = g[:, 2 * h_size : 3 * h_size] * np.tanh(c)
            hs.append(h)
            cs.append(c)
            gs.append(g)
        return hs, cs, gs

    def _backward(self, d: str, x: np.ndarray, state, dh_out: np.ndarray, grads: dict) -> None:
        hs, cs, gs = state
        h_size = HIDDEN
        dtab, drec = np.zeros_like(self.p[f"tab_{d}"]), np.zeros_like(self.p[f"rec_{d}"])
        dh, dc = np.zeros_like(hs[0]), np.zeros_like(cs[0])
        rec_t = self.p[f"rec_{d}"].T.copy()
        one_hot = np.eye(CLASSES, dtype=np.float32)
        for t in range(len(gs) - 1, -1, -1):
            g = gs[t]
            i, f, o, n = (g[:, j * h_size : (j + 1) * h_size] for j in range(4))
            th = np.tanh(cs[t + 1])
            dh = dh + dh_out[t]
            dc = dc + dh * o * (1 - th * th)
            dg = np.concatenate([dc * n * i * (1 - i), dc * cs[t] * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - n * n)], 1)
            dtab += one_hot[x[t]].T @ dg
            drec += hs[t].T @ dg
            dh = dg @ rec_t
            dc = dc * f
        grads[f"tab_{d}"], grads[f"rec_{d}"] = dtab, drec

    def gradients(self, x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> tuple[dict, float]:
        """(gradients, loss of 100 characters)."""
        steps, batch = x.shape
        back = np.arange(steps)[:, None]
        back = np.where(back < lengths, lengths - 1 - back, back)
        cols = np.arange(batch)[None, :]
        xb = x[back, cols]
        sf, sb = self._forward("f", x), self._forward("b", xb)
        hf, hb = np.stack(sf[0][1:]), np.stack(sb[0][1:])[back, cols]
        both = np.concatenate([hf, hb], 2)
        e = both @ self.p["out"] + self.p["bias"]
        inside = np.arange(steps)[:, None] < lengths
        # CRF: forward and backward in log space
        tr = self.p["trans"]
        alpha = [e[0]]
        for t in range(1, steps):
            s = alpha[-1][:, :, None] + tr
            top = s.max(1)
            nxt = top + np.log(np.exp(s - top[:, None]).sum(1)) + e[t]
            alpha.append(np.where(inside[t][:, None], nxt, alpha[-1]))
        top = alpha[-1].max(1)
        z = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(1))
        beta = np.zeros((batch, e.shape[2]), np.float32)
        de, dtr = np.zeros_like(e), np.zeros_like(tr)
        rows = np.arange(batch)
        gold = np.zeros(batch, np.float32)
        for t in range(steps - 1, -1, -1):
            if t < steps - 1:
                live = inside[t + 1]
                s = tr[None] + (e[t + 1] + beta)[:, None, :]
                top = s.max(2)
                pair = np.exp(alpha[t][:, :, None] + s - z[:, None, None])
                dtr += (pair * live[:, None, None]).sum(0)
                beta = np.where(live[:, None], top + np.log(np.exp(s - top[:, :, None]).sum(2)), beta)
                np.add.at(dtr, (y[t][live], y[t + 1][live]), -1.0)
                gold += np.where(live, tr[y[t], y[t + 1]], 0)
            marg = np.exp(alpha[t] + beta - z[:, None])
            marg[rows, y[t]] -= 1.0
            de[t] = marg * inside[t][:, None]
            gold += np.where(inside[t], e[t][rows, y[t]], 0)
        n = float(lengths.sum())
        de /= n / 100
        grads = {"trans": dtr / (n / 100), "out": both.reshape(-1, both.shape[2]).T @ de.reshape(-1, de.shape[2]), "bias": de.sum((0, 1))}
        dboth = de @ self.p["out"].T
        self._backward("f", x, sf, dboth[:, :, :HIDDEN], grads)
        self._backward("b", xb, sb, dboth[:, :, HIDDEN:][back, cols], grads)
        return grads, float((z - gold).sum() / n * 100)

    def update(self, grads: dict, rate: float) -> None:
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip = min(1.0, 5.0 / (norm + 1e-6))
        self.t += 1
        for k, g in grads.items():
            g = g * clip
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.99 * self.v[k] + 0.01 * g * g
            self.p[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-6)


def batch_of(rows: list[tuple[np.ndarray, np.ndarray]]):
    lengths = np.array([len(x) for x, _ in rows])
    x = np.zeros((lengths.max(), len(rows)), np.int64)
    y = np.zeros((lengths.max(), len(rows)), np.int64)
    for j, (a, b) in enumerate(rows):
        x[: len(a), j], y[: len(b), j] = a, b
    return x, y, lengths


def score(texts: list[str], truth: list[list[tuple[int, int, str]]], model) -> dict[str, tuple[float, float, int]]:
    """(precision, recall, cases) of each kind on exact passages."""
    hit = dict.fromkeys(KINDS, 0)
    made, real = dict(hit), dict(hit)
    for t, want, got in zip(texts, truth, spans_of(texts, model)):
        w, g = {(t[a:b], k) for a, b, k in want}, {(t[a:b], k) for a, b, k in got}
        for k in KINDS:
            made[k] += sum(x[1] == k for x in g)
            real[k] += sum(x[1] == k for x in w)
            hit[k] += sum(x[1] == k for x in w & g)
    return {k: (round(hit[k] / max(made[k], 1), 4), round(hit[k] / max(real[k], 1), 4), real[k]) for k in KINDS}


def sample(path: str, salt: str = "train") -> list[str]:
    """At most SAMPLE texts, those with the smallest hashes of their ids."""
    import pyarrow.parquet as pq

    rows = pq.read_table(path, columns=["doc_id", "text"]).to_pylist()
    rows.sort(key=lambda row: hashlib.sha1(f"{salt}{row['doc_id']}".encode()).digest())
    return [row["text"] for row in rows[:SAMPLE] if row["text"]]


class _Worker:
    """Makes windows and their gradients; windows depend on seed, step and number of the process alone."""

    def __init__(self, real: list, background: list[str]):
        self.real, self.background, self.net = real, background, Net()

    def __call__(self, task: tuple[int, int, dict]) -> tuple[dict, float]:
        step, number, self.net.p = task
        r = random.Random((SEED * 1_000_003 + step) * 101 + number)
        rows: list = []
        while len(rows) < WINDOWS:
            if r.random() < (MADE_FIRST if step < FIRST else MADE_REST):
                text, spans = pii_frames.text(r, self.background, LENGTH + r.randrange(120))
                at = r.randrange(0, max(1, len(text) - LENGTH))
                rows += windows(text, spans, r, 0, [at])
            else:
                text, spans = r.choice(self.real)
                if spans and r.random() < 0.8:
                    text, spans = exchange(text, spans, r)
                rows += r.sample(found, min(len(found), 2)) if (found := windows(text, spans, r, 1)) else []
        return self.net.gradients(*batch_of(rows[:WINDOWS]))


_worker: _Worker | None = None


def _call(task):
    return _worker(task)


def _stored(net: Net) -> None:
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in net.p.items()})


def main(path: str, start: int = 0) -> None:
    """``start``: FIRST goes on from the stored weights of the first steps."""
    global _worker
    texts = sample(path)
    held, used = texts[::10], [t for i, t in enumerate(texts) if i % 10]
    real = [(t, label(t)) for t in used]
    r = random.Random(SEED)
    # sentences of real texts in which the labelling found nothing, as surroundings
    background = [x for t, spans in real if not spans for x in re.split(r"(?<=[.!?])\s+", t) if 20 < len(x) < 160]
    background = r.sample(background, min(len(background), 4000))
    _worker = _Worker(real, background)
    net, began = Net(), time.time()
    if start:
        with np.load(WEIGHTS) as stored:
            net.p = {k: stored[k].astype(np.float32) for k in stored.files}
    with multiprocessing.get_context("fork").Pool(WORKERS) as pool:
        for step in range(start, STEPS):
            if step == FIRST and not start:
                _stored(net)
                net = Net()
                with np.load(WEIGHTS) as stored:
                    net.p = {k: stored[k].astype(np.float32) for k in stored.files}
            found = pool.map(_call, [(step, i, net.p) for i in range(WORKERS)], chunksize=1)
            mean = {k: sum(g[k] for g, _ in found) / WORKERS for k in found[0][0]}
            net.update(mean, 0.0002 + (0.008 * (1 - step / FIRST) if step < FIRST else 0.005 * (1 - (step - FIRST) / (STEPS - FIRST))))
            if step % 50 == 0:
                print(step, round(time.time() - began), round(sum(x for _, x in found) / WORKERS, 4), flush=True)
    _stored(net)
    model = prepare({k: v.astype(np.float16).astype(np.float32) for k, v in net.p.items()})
    print("documents", score(held, [label(t) for t in held], model))
    made = [pii_frames.text(random.Random(10_000 + i), background, 400) for i in range(1500)]
    print("frames", score([t for t, _ in made], [s for _, s in made], model))


if __name__ == "__main__":
    main(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 0)
