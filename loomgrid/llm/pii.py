"""Personal data: fixed patterns, and spans added by a character-level bidirectional LSTM with a CRF.

The patterns find e-mail addresses, IP addresses, card numbers and phone numbers in whole texts. The
tagger finds what they cannot: addresses and numbers in other spellings (jane at example dot com,
10[.]0[.]0[.]1, 4111.1111.1111.1111, (389) 555-5010). It is trained in numpy on windows of a bounded sample
with labelled spans: those of the patterns where they are, those of the patterns written in other
spellings, and spans put into windows that have none, so each kind is learned from any corpus; windows
with other numbers, as they occur and as they are put in, teach it what is no such span. It reads
overlapping windows of every text, all of them, and again wider ones where a window's edge cuts a span.
Decoded spans are moved to places in the text, merged over windows, and kept by posterior if they are
clear of all pattern spans and of better ones and can be of the kind, however they are written: by the number
of digits, a card's check digit, four numbers up to 255, or an address's at and dot in some spelling. Pattern spans always stay.

Where the path without spans has more than half of a window's probability, it is the best path for certain,
and the window is not decoded any further.

Places count code points and the end is exclusive. Defined cases: a null or empty text has no spans;
rows repeated get the same spans; very long texts are read whole, in pieces, and no pattern backtracks over
a long run; of spans with equal posterior the first stays; without any text to sample nothing is added;
an empty table gives an empty result. Results are columns of expressions, so other columns of a table
cannot clash with them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import send, tidy

#: In the order in which spans with the same start are listed.
KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, and from one window to the next; windows read at once.
LENGTH, STRIDE, AT_ONCE = 256, 224, 512
#: Distinct texts, windows of each, and windows in all that the tagger is trained on, at most, and their length.
SAMPLE_TEXTS, PER_TEXT, SAMPLE_WINDOWS, TRAIN_LENGTH = 1500, 3, 3600, 96
SYMBOLS, EMBED, HIDDEN, TAGS = 130, 12, 16, 1 + 2 * len(KINDS)
EPOCHS, BATCH, RATE, LARGEST_STEP = 10, 30, 0.02, 1.0
#: Least posterior, the lowest over its characters, of an added span.
CONFIDENT = 0.6
#: Most blanks of a spelt-out address.
ADDRESS_GAPS = 8
#: Characters of texts held at once.
HELD = 1 << 20

# possessive repeats give the same matches as greedy ones here and never go back over a long run
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _good(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    n = _digits(text)
    return 12 <= len(n) <= 19 and luhn(n) if kind == "card" else 9 <= len(n) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the whole run of local characters before an @ that a domain follows."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            free = match.end()
            yield start, free
            at = text.find("@", free)
        else:
            # the run before a failed @ is not read again: the next one starts after the @
            free = at + 1
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, leftmost and non-overlapping per kind, those that fail their check dropped."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        if kind == "phone" and "+" not in text:
            continue
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _good(kind, m[0])]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# --- training spans --------------------------------------------------------------------------------

#: Spellings of the signs in an address, ends of domains, and gaps in numbers, that the patterns do not know.
AT = (" at ", " (at) ", " [at] ", "(at)", "[at]", " @ ", "{at}", " AT ")
DOT = (" dot ", " (dot) ", "[dot]", "(dot)", " . ", ".")
ENDS = ("com", "org", "net", "de", "fr", "es", "io", "edu", "info")
IP_GAPS = ("[.]", "(.)", " . ", " dot ", "[dot]")
CARD_GAPS = (".", "/", "_", " - ", "  ", " / ")
PHONE_FORMS = ("({a}) {b}-{c}", "({a}) {b} {c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "{a} {b} {c}", "00{n} {a} {b} {c}", "00{n}-{a}-{b}-{c}", "{n}-{a}-{b}-{c}", "{a}/{b}/{c}", "+{n}/{a}/{b}/{c}")
#: Numbers that are no such span; 9 stands for a digit.
OTHER_NUMBERS = ("9999-99-99", "99.99.9999", "99/99/9999", "99:99:99", "9,999.99", "9.99", "v9.99.9", "9.9.9", "#999999", "99999999", "999-99-9999", "999-999", "9999 9999", "9.999.999", "9999999999999999", "99%", "9999-9999", "ISBN 999-9-99-999999-9", "§ 99.9.9")


def _number(rng: np.random.Generator, count: int) -> str:
    return "".join(map(str, rng.integers(0, 10, count)))


def _filled(rng: np.random.Generator, shape: str) -> str:
    return "".join(str(rng.integers(0, 10)) if c == "9" else c for c in shape)


def _pick(rng: np.random.Generator, options: tuple[str, ...] | list[str]) -> str:
    return options[int(rng.integers(0, len(options)))]


def made_span(rng: np.random.Generator, kind: str, words: list[str], plain: bool) -> str:
    """A span of a kind, as the patterns know it or in another spelling; words go into addresses."""
    if kind == "email":
        word = lambda: _pick(rng, words)
        local = word() + (_pick(rng, (".", "_", "-")) + word() if rng.random() < 0.5 else "") + (_number(rng, int(rng.integers(1, 4))) if rng.random() < 0.3 else "")
        parts = [word(), *([word()] if rng.random() < 0.2 else []), _pick(rng, ENDS)]
        text = f"{local}@{'.'.join(parts)}"
        return text if plain else respelled(rng, kind, text)
    if kind == "ip":
        text = ".".join(str(x) for x in rng.integers(0, 256, 4))
    elif kind == "card":
        digits = _number(rng, int(_pick(rng, ["15", "16", "16", "16"])) - 1)
        digits = next(digits + str(d) for d in range(10) if luhn(digits + str(d)))
        text = _pick(rng, (" ", "-", "")).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    else:
        text = f"+{rng.integers(1, 99)} ({_number(rng, 3)}) {_number(rng, 3)}-{_number(rng, 4)}"
    return text if plain else respelled(rng, kind, text)


def respelled(rng: np.random.Generator, kind: str, text: str) -> str:
    """A span of the patterns in a spelling that they do not know."""
    if kind == "email":
        local, domain = text.rsplit("@", 1)
        at, dot = _pick(rng, AT), _pick(rng, DOT)
        if rng.random() < 0.15:
            letter = _pick(rng, "éäöüñçß")
            return f"{local}@{letter}{domain}" if rng.random() < 0.5 else f"{local[:1]}{letter}{local[1:]}@{domain[:1]}{letter}{domain[1:]}"
        return local + at + dot.join(domain.split("."))
    digits = _digits(text)
    if kind == "ip":
        return _pick(rng, IP_GAPS).join(text.split("."))
    if kind == "card":
        return _pick(rng, CARD_GAPS).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return _pick(rng, PHONE_FORMS).format(n=digits[:-10] or "1", a=digits[-10:-7], b=digits[-7:-4], c=digits[-4:])


def _unlike_span(rng: np.random.Generator, words: list[str]) -> str:
    """What is no span but shares signs with some: other numbers, words around an at or a dot, words repeated."""
    draw = rng.random()
    if draw < 0.6:
        return _filled(rng, _pick(rng, OTHER_NUMBERS))
    if draw < 0.85:
        return _pick(rng, ("{} at {}", "{} at at {}", "at {}", "{} at {}. {}", "{} dot {}", "{} {}. {}")).format(*(_pick(rng, words) for _ in range(3)))
    return " ".join([_pick(rng, words)] * 12)


def training_window(rng: np.random.Generator, text: str, words: list[str]) -> tuple[str, list[Span]]:
    """A window's text with its spans; those of the patterns may be respelled, and other spans or numbers be put in."""
    pieces: list[tuple[str, str | None]] = []
    at = 0
    for kind, a, b in base_spans(text):
        if a >= at:
            pieces += [(text[at:a], None), (respelled(rng, kind, text[a:b]) if rng.random() < 0.6 else text[a:b], kind)]
            at = b
    pieces.append((text[at:], None))
    draw = rng.random()
    if len(pieces) == 1 and draw < 0.85:
        gaps = [m.end() for m in re.finditer(" ", text)] or [0]
        place = gaps[int(rng.integers(0, len(gaps)))]
        # addresses have the most spellings
        kind = _pick(rng, ("email", *KINDS)) if draw < 0.6 else None
        put = made_span(rng, kind, words, rng.random() < 0.25) if kind else _unlike_span(rng, words)
        pieces = [(text[:place], None), (put, kind), (_pick(rng, (" ", " ", ", ", ". ")) + text[place:], None)]
    out, spans = "", []
    for piece, kind in pieces:
        if kind:
            spans.append((kind, len(out), len(out) + len(piece)))
        out += piece
    return out, spans


def _tags(spans: list[Span], length: int) -> np.ndarray:
    row = np.zeros(length, dtype=np.int64)
    for kind, a, b in spans:
        # of a span that the window cuts, the part inside
        a, b, k = a, min(length, b), KINDS.index(kind)
        if a < b:
            row[a] = 1 + 2 * k
            row[a + 1 : b] = 2 + 2 * k
    return row


# --- tagger --------------------------------------------------------------------------------------


def _codes(text: str) -> np.ndarray:
    """ASCII as it is, 128 for all else."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), 128).astype(np.uint8)


def symbols(texts: list[str], length: int = LENGTH) -> np.ndarray:
    """One row of length symbols per window: ASCII as it is, 128 for all else, 129 behind the end."""
    out = np.full((len(texts), length), 129, dtype=np.uint8)
    for i, t in enumerate(texts):
        codes = _codes(t[:length])
        out[i, : len(codes)] = codes
    return out


class Tagger:
    """Embeddings, an LSTM in each direction, a linear layer and CRF transitions; tag 0 is none, 1 + 2k begins kind k, 2 + 2k continues it.

    Arrays of both directions lie side by side (the second reads the window from its end). Gates stand in the
    order in, forget, out, new; the sigmoid is written as a hyperbolic tangent."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        bias = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))
        self.p = {
            "e": rng.normal(0, 0.3, (SYMBOLS, EMBED)), "o": rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), "c": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS)),
            "x": rng.normal(0, 0.25, (2, EMBED, 4 * HIDDEN)), "h": rng.normal(0, 0.25, (2, HIDDEN, 4 * HIDDEN)), "b": np.stack((bias, bias)),
        }
        # a kind continues only after its own beginning or continuation, and no window begins within a span
        self.allowed = np.array([[j == 0 or j % 2 == 1 or i in (j, j - 1) for j in range(TAGS)] for i in range(TAGS)])
        self.start = np.array([float(j == 0 or j % 2 == 1) for j in range(TAGS)])

    def states(self, w: np.ndarray, keep: list) -> np.ndarray:
        """Hidden states (place, window, both directions) of windows; keep takes what the gradient needs."""
        n, steps = w.shape
        half = np.where(np.arange(4 * HIDDEN) < 3 * HIDDEN, 0.5, 1.0)
        table = (self.p["e"] @ self.p["x"] + self.p["b"][:, None, :]) * half
        h, c, out = np.zeros((2, n, HIDDEN)), np.zeros((2, n, HIDDEN)), np.empty((steps, n, 2 * HIDDEN))
        for s in range(steps):
            z = np.tanh(h @ (self.p["h"] * half) + np.stack((table[0][w[:, s]], table[1][w[:, steps - 1 - s]])))
            gate = z[:, :, : 3 * HIDDEN] * 0.5 + 0.5
            i, f, o, g = gate[:, :, :HIDDEN], gate[:, :, HIDDEN : 2 * HIDDEN], gate[:, :, 2 * HIDDEN :], z[:, :, 3 * HIDDEN :]
            old_c, old_h = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[s, :, :HIDDEN], out[steps - 1 - s, :, HIDDEN:] = h[0], h[1]
            keep.append((i, f, o, g, old_c, old_h, tc))
        return out

    def emissions(self, w: np.ndarray, kind: type = np.float32) -> np.ndarray:
        """Scores (window, place, tag), a view of an array that has windows along its rows.

        The same network as states(), laid out for reading: states and symbols stand above each other, so that
        one product gives all gates, and each operation runs along the windows."""
        n, steps = w.shape
        half = np.where(np.arange(4 * HIDDEN) < 3 * HIDDEN, 0.5, 1.0)
        weight = np.concatenate((self.p["h"], self.p["x"], self.p["b"][:, None, :]), axis=1) * half
        weight = np.ascontiguousarray(weight.transpose(0, 2, 1)).astype(kind)
        shown = self.p["e"].T.astype(kind)[:, w.T.ravel()].reshape(EMBED, steps, n)
        below = np.ones((2, HIDDEN + EMBED + 1, n), kind)
        h, put = below[:, :HIDDEN], below[:, HIDDEN : HIDDEN + EMBED]
        h[:] = 0
        c, tc, z, out = np.zeros((2, HIDDEN, n), kind), np.empty((2, HIDDEN, n), kind), np.empty((2, 4 * HIDDEN, n), kind), np.empty((steps, 2 * HIDDEN, n), kind)
        gate, i, f, o, g = z[:, : 3 * HIDDEN], z[:, :HIDDEN], z[:, HIDDEN : 2 * HIDDEN], z[:, 2 * HIDDEN : 3 * HIDDEN], z[:, 3 * HIDDEN :]
        for s in range(steps):
            put[0], put[1] = shown[:, s], shown[:, steps - 1 - s]
            np.matmul(weight, below, out=z)
            np.tanh(z, out=z)
            gate *= kind(0.5)
            gate += kind(0.5)
            np.multiply(c, f, out=c)
            np.multiply(i, g, out=tc)
            c += tc
            np.tanh(c, out=tc)
            np.multiply(o, tc, out=h)
            out[s, :HIDDEN], out[steps - 1 - s, HIDDEN:] = h[0], h[1]
        em = self.p["o"].T.astype(kind) @ out + self.p["c"].astype(kind)[:, None]
        return em.transpose(2, 0, 1)

    def marginals(self, em: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Posterior of each tag at each place, expected transitions summed over places, and the log of the sum over all paths."""
        n, steps = em.shape[:2]
        step = np.where(self.allowed, np.exp(self.p["t"]), 0.0)
        top = em.max(axis=2)
        e = np.exp(em - top[:, :, None])
        a, b, scale = np.empty_like(e), np.empty_like(e), np.empty((n, steps))
        for s in range(steps):
            x = (a[:, s - 1] @ step if s else self.start) * e[:, s]
            scale[:, s] = x.sum(axis=1)
            a[:, s] = x / scale[:, s, None]
        b[:, -1] = 1
        for s in range(steps - 2, -1, -1):
            b[:, s] = (e[:, s + 1] * b[:, s + 1]) @ step.T / scale[:, s + 1, None]
        after = e[:, 1:] * b[:, 1:] / scale[:, 1:, None]
        pairs = step * np.einsum("nsi,nsj->ij", a[:, :-1], after, optimize=True)
        return a * b, pairs, np.log(scale).sum(axis=1) + top.sum(axis=1)

    def viterbi(self, em: np.ndarray) -> np.ndarray:
        t = np.where(self.allowed, self.p["t"], -1e4)
        n, steps = em.shape[:2]
        score = em[:, 0] + np.where(self.start > 0, 0.0, -1e4)
        back = np.empty((n, steps, TAGS), dtype=np.int64)
        for s in range(1, steps):
            step = score[:, :, None] + t
            back[:, s] = step.argmax(axis=1)
            score = step.max(axis=1) + em[:, s]
        out = np.empty((n, steps), dtype=np.int64)
        out[:, -1] = score.argmax(axis=1)
        for s in range(steps - 1, 0, -1):
            out[:, s - 1] = back[np.arange(n), s, out[:, s]]
        return out

    def loud(self, em: np.ndarray) -> np.ndarray:
        """Windows whose best path may hold a span: the path without any has a probability of no more than a half.

        Where it has more, no other path can be better, so nothing is left to decode."""
        n, steps = em.shape[:2]
        step = np.ascontiguousarray(np.where(self.allowed, np.exp(self.p["t"]), 0.0).T)
        e = np.ascontiguousarray(em.transpose(1, 2, 0))
        e = np.exp(np.minimum(e - e[:, :1], 80))  # of each place over no span
        a, total = self.start[:, None] * e[0], np.zeros(n)
        for s in range(1, steps):
            a = (step @ a) * e[s]
            if s % 4 == 0:
                scale = a.sum(axis=0)
                a /= scale
                total += np.log(scale)
        total += np.log(a.sum(axis=0))
        return total - (steps - 1) * self.p["t"][0, 0] >= np.log(2) - 1e-3

    def gradient(self, w: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood of tag sequences, and its gradient."""
        n, steps = w.shape
        keep: list[tuple] = []
        h = self.states(w, keep)
        em = (h @ self.p["o"] + self.p["c"]).transpose(1, 0, 2)
        grad, pairs, total = self.marginals(em)
        gold = np.take_along_axis(em, y[:, :, None], 2).sum() + self.p["t"][y[:, :-1], y[:, 1:]].sum()
        np.put_along_axis(grad, y[:, :, None], np.take_along_axis(grad, y[:, :, None], 2) - 1, 2)
        np.add.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        grad = np.ascontiguousarray(grad.transpose(1, 0, 2))
        g = {"t": np.where(self.allowed, pairs, 0), "o": h.reshape(-1, 2 * HIDDEN).T @ grad.reshape(-1, TAGS), "c": grad.sum(axis=(0, 1))}
        dh_all = grad @ self.p["o"].T
        dz = np.empty((steps, 2, n, 4 * HIDDEN))
        dh, dc, wh = np.zeros((2, n, HIDDEN)), np.zeros((2, n, HIDDEN)), self.p["h"].transpose(0, 2, 1)
        g["h"] = np.zeros_like(self.p["h"])
        for s in range(steps - 1, -1, -1):
            i, f, o, new, old_c, old_h, tc = keep[s]
            dh = dh + np.stack((dh_all[s, :, :HIDDEN], dh_all[steps - 1 - s, :, HIDDEN:]))
            dc = dc + dh * o * (1 - tc * tc)
            z = dz[s]
            z[:, :, :HIDDEN], z[:, :, HIDDEN : 2 * HIDDEN] = dc * new * i * (1 - i), dc * old_c * f * (1 - f)
            z[:, :, 2 * HIDDEN : 3 * HIDDEN], z[:, :, 3 * HIDDEN :] = dh * tc * o * (1 - o), dc * i * (1 - new * new)
            g["h"] += old_h.transpose(0, 2, 1) @ z
            dh, dc = z @ wh, dc * f
        # gradients of the table of symbols, then of what it is a product of
        table = np.zeros((2, SYMBOLS, 4 * HIDDEN))
        for d, places in ((0, w.T), (1, w.T[::-1])):
            np.add.at(table[d], places.ravel(), dz[:, d].reshape(-1, 4 * HIDDEN))
        g["x"], g["b"] = self.p["e"].T @ table, table.sum(axis=1)
        g["e"] = (table @ self.p["x"].transpose(0, 2, 1)).sum(axis=0)
        return float(total.sum() - gold), g

    def fit(self, w: np.ndarray, y: np.ndarray, seed: int = 5) -> Tagger:
        """Adam on the negative log-likelihood of the tag sequences; long gradients are shortened, and the rate falls to zero."""
        rng = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        steps = EPOCHS * -(-len(w) // BATCH)
        for _ in range(EPOCHS):
            order = rng.permutation(len(w))
            for i in range(0, len(w), BATCH):
                part = order[i : i + BATCH]
                _, g = self.gradient(w[part], y[part])
                step += 1
                rate = RATE * (1 - (step - 1) / steps)
                norm = float(np.sqrt(sum((x * x).sum() for x in g.values()))) / len(part)
                shrink = min(1.0, LARGEST_STEP / max(norm, 1e-12)) / len(part)
                for k, q in self.p.items():
                    d = g[k] * shrink
                    m[k] += 0.1 * (d - m[k])
                    v[k] += 0.001 * (d * d - v[k])
                    q -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def spans(self, w: np.ndarray) -> list[list[tuple[str, int, int, float]]]:
        """Kind, start, end and least posterior of the decoded spans of each window."""
        out: list[list[tuple[str, int, int, float]]] = [[] for _ in w]
        length = w.shape[1]
        rows = max(1, AT_ONCE * LENGTH // length)
        for i in range(0, len(w), rows):
            em = self.emissions(w[i : i + rows])
            chosen = np.flatnonzero(self.loud(em))
            if not len(chosen):
                continue
            em = em[chosen].astype(np.float64)
            tags, post = self.viterbi(em), self.marginals(em)[0]
            sure = np.take_along_axis(post, tags[:, :, None], 2)[:, :, 0]
            for at, row, p in zip((chosen + i).tolist(), tags, sure, strict=True):
                for a in np.flatnonzero(row % 2 == 1).tolist():
                    b = a + 1
                    while b < length and row[b] == row[a] + 1:
                        b += 1
                    out[at].append((KINDS[row[a] // 2], a, b, float(p[a:b].min())))
        return out


def window_starts(size: int) -> list[int]:
    """Starts, STRIDE apart, of the windows that cover a text of so many characters."""
    return list(range(0, STRIDE * max(0, -(-(size - LENGTH) // STRIDE)) + 1, STRIDE)) if size else []


def _plausible(kind: str, text: str) -> bool:
    """Whether a span can be of a kind, by its digits and however it is written."""
    if kind == "email":
        signs = re.search("@|at", text, re.IGNORECASE) and re.search(r"\.|dot", text, re.IGNORECASE)
        return bool(signs) and text[0].isalnum() and text[-1].isalnum() and "\n" not in text and text.count(" ") <= ADDRESS_GAPS
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return _good(kind, text)


Decoded = list[tuple[str, int, int, float]]


def _is_cut(text: str, start: int, length: int, a: int, b: int) -> bool:
    return (a == 0 and start > 0) or (b == length and start + length < len(text))


def _to_widen(text: str, base: list[Span], windows: list[tuple[int, int]], decoded: list[Decoded]) -> list[tuple[int, int]]:
    """Start and length of wider windows around the spans that a window's edge cuts and that no window has whole.

    Those that touch a pattern span are left, as nothing is added there. Windows that overlap are read as one,
    which keeps a round linear in the text; lengths are powers of two."""
    cuts, whole = [], []
    for (start, length), spans in zip(windows, decoded, strict=True):
        for _, a, b, _ in spans:
            (cuts if _is_cut(text, start, length, a, b) else whole).append((start + a, start + b, length))
    out: list[list[int]] = []
    for a, b, length in sorted(cuts):
        if any(a < y and b > x for _, x, y in base) or any(x <= a and b <= y for x, y, _ in whole):
            continue
        a, b = max(0, a - length // 2), min(len(text), b + length // 2)
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, 1 << (b - a - 1).bit_length()) for a, b in out]


def _windows(codes: list[np.ndarray]) -> Iterator[tuple[int, list[tuple[int, int]], np.ndarray]]:
    """(length, (text, start) of each window, symbols) of the windows of all texts; short texts have shorter ones."""
    by_length: dict[int, list[tuple[int, int]]] = {}
    for i, own in enumerate(codes):
        for start in window_starts(len(own)):
            by_length.setdefault(min(LENGTH, -(-(len(own) - start) // 32) * 32), []).append((i, start))
    whole = np.concatenate([*codes, np.full(1, 129, dtype=np.uint8)])
    base = np.concatenate(([0], np.cumsum([len(c) for c in codes])))
    for length, places in by_length.items():
        for j in range(0, len(places), 4 * AT_ONCE):
            part = places[j : j + 4 * AT_ONCE]
            text, start = np.array(part).T
            at = (base[text] + start)[:, None] + np.arange(length)
            yield length, part, whole[np.where(at < base[text + 1][:, None], at, len(whole) - 1)]


def added_spans(tagger: Tagger | None, items: list[tuple[str, list[Span]]]) -> list[list[Span]]:
    """The spans of texts, given with their pattern spans; spans cut by a window's edge are read again in wider windows."""
    if not tagger:
        return [list(base) for _, base in items]
    windows: list[list[tuple[int, int]]] = [[] for _ in items]
    decoded: list[list[Decoded]] = [[] for _ in items]
    waiting: list[list[tuple[int, int]]] = [[] for _ in items]
    first: list[tuple[int, int, int, Decoded]] = []
    for length, places, w in _windows([_codes(text) for text, _ in items]):
        first += [(i, start, length, spans) for (i, start), spans in zip(places, tagger.spans(w), strict=True) if spans]
    for i, start, length, spans in first:
        windows[i].append((start, length))
        decoded[i].append(spans)
    for i in {i for i, *_ in first}:
        waiting[i] = _to_widen(items[i][0], items[i][1], windows[i], decoded[i])
    while any(waiting):
        by_length: dict[int, list[tuple[int, int]]] = {}
        for i, own in enumerate(waiting):
            for start, length in own:
                by_length.setdefault(length, []).append((i, start))
        new: list[tuple[list[tuple[int, int]], list[Decoded]]] = [([], []) for _ in items]
        for length, places in by_length.items():
            for (i, start), spans in zip(places, tagger.spans(symbols([items[i][0][s : s + length] for i, s in places], length)), strict=True):
                new[i][0].append((start, length))
                new[i][1].append(spans)
        waiting = [_to_widen(text, base, *own) for (text, base), own in zip(items, new, strict=True)]
        for i, (w, d) in enumerate(new):
            windows[i] += w
            decoded[i] += d
    return [reconcile(text, base, own, d) for (text, base), own, d in zip(items, windows, decoded, strict=True)]


def reconcile(text: str, base: list[Span], windows: list[tuple[int, int]], decoded: list[Decoded]) -> list[Span]:
    """Pattern spans and the added ones, over the whole text; windows: their starts and lengths."""
    best: dict[Span, float] = {}
    for (start, length), spans in zip(windows, decoded, strict=True):
        for kind, a, b, p in spans:
            # a span cut by the window's edge is whole in another window, if need be a wider one
            if _is_cut(text, start, length, a, b) or start + b > len(text):
                continue
            key = (kind, start + a, start + b)
            best[key] = max(best.get(key, 0.0), p)
    taken = [(a, b) for _, a, b in base]
    out = list(base)
    for (kind, a, b), p in sorted(best.items(), key=lambda x: (-x[1], x[0][1], KINDS.index(x[0][0]))):
        if p >= CONFIDENT and all(b <= x or a >= y for x, y in taken) and _plausible(kind, text[a:b]):
            taken.append((a, b))
            out.append((kind, a, b))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to PER_TEXT windows of each text, first those with digits or an @, which may hold spans or look like them."""
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            own = [text[i : i + TRAIN_LENGTH] for i in range(0, len(text), TRAIN_LENGTH)]
            telling = [w for w in own if re.search("[0-9@]", w)]
            step = max(1, len(own) // PER_TEXT)
            out += (telling[: PER_TEXT - 1] + own[::step])[:PER_TEXT]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["w"])


def train_tagger(docs: DataFrame, text_col: str = "text") -> Tagger | None:
    """A tagger trained on windows of a bounded sample of distinct texts, those with the smallest hashes; None if there is no text."""
    send(docs, None)
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null and text != ''").select("text", F.xxhash64("text").alias("h"))
    # copies share a hash: behind the threshold they are cut to one in each task
    distinct = max(1, texts.agg(F.approx_count_distinct("h").alias("n")).first()["n"])
    share = (F.col("h").cast("double") + 2.0**63) / 2.0**64
    held = texts.where(share < (2 * SAMPLE_TEXTS + 200) / distinct).dropDuplicates(["h"]).orderBy("h").limit(SAMPLE_TEXTS).select("text")
    windows = [r["w"] for r in held.mapInArrow(_sampled, "w string").distinct().orderBy(F.xxhash64("w"), "w").limit(SAMPLE_WINDOWS).collect()]
    return trained(windows) if windows else None


def trained(windows: list[str], seed: int = 1) -> Tagger:
    """A tagger trained on windows of plain text."""
    rng = np.random.default_rng(seed)
    words = sorted({w.lower() for text in windows for w in re.findall("[A-Za-z]{2,12}", text)}) or ["name"]
    # a small sample is used several times, with other spans put in
    rows = [training_window(rng, text, words) for _ in range(-(-SAMPLE_WINDOWS // len(windows))) for text in windows][:SAMPLE_WINDOWS]
    return Tagger().fit(symbols([text for text, _ in rows], TRAIN_LENGTH), np.array([_tags(spans, TRAIN_LENGTH) for _, spans in rows]))


def personal_data(text: str, df: DataFrame, tagger: Tagger | None) -> Column:
    """A column struct<base, spans>, both array<struct<kind, start, end>>, of one text column of df."""
    held = send(df, tagger)

    @F.arrow_udf("base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = held.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            base, every = [[] for _ in range(len(batch))], [[] for _ in range(len(batch))]
            waiting: list[tuple[int, str]] = []

            def flush() -> None:
                for (i, _), spans in zip(waiting, added_spans(tagger, [(text, base[i]) for i, text in waiting]), strict=True):
                    every[i] = spans
                waiting.clear()

            size = 0
            for i, x in enumerate(batch):
                text = x.as_py()
                if text:
                    base[i] = base_spans(text)
                    waiting.append((i, text))
                    size += len(text)
                    if size >= HELD:
                        flush()
                        size = 0
            flush()
            rows = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in r] for r in x], kind) for x in (base, every)]
            yield pa.StructArray.from_arrays(rows, ["base", "spans"])
        tidy()

    return find(F.col(text))
