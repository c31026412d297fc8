"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions trained in numpy.

Patterns find e-mails, IP addresses, cards and phone numbers in their strict forms; their spans always stay. The tagger
learns begin/inside/outside tags from labelled spans in short windows, of the same four kinds in whatever form people
write them (national and spaced numbers, (at) and [dot], odd separators) and of secrets, which have no pattern. Every text
is laid out in overlapping windows from its first character to its last; each window is decoded by Viterbi, and every
character takes its tag from the window in which it lies deepest. Spans that can be of their kind (as many digits as a
phone number has, a card's check digit) and touch no pattern span are added.

Such a span has a digit, an @ or the word dot and at most LONGEST characters. Windows farther than that from all of them
cannot touch a span that would be added, so they need not be decoded: the result is that of decoding all.

Defined results: null or empty text has no spans; repeated rows are read one by one; an empty table gives an empty
result; a null id stays null; only the id and text columns are read, and redact passes the others through whatever
their names.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of the patterns, in order; the tagger knows one more.
KINDS = ("email", "ip", "card", "phone")
TAGGED = (*KINDS, "secret")
#: Window length and stride, and the longest span that the tagger may add.
WINDOW, STRIDE, LONGEST = 96, 48, 80
#: Labelled windows that the tagger is trained on, and their seed: the documented bound of its sample.
TRAINING_WINDOWS, SEED = 6000, 11

# --- patterns -----------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def valid(kind: str, s: str) -> bool:
    """A kind's exact check of a span."""
    if kind == "email":
        at = s.find("@")
        return at > 0 and all(c in _LOCAL for c in s[:at]) and bool(_DOMAIN.fullmatch(s, at + 1))
    if kind == "ip":
        return bool(_IP.fullmatch(s)) and all(map(_small, s.split(".")))
    n = _digits(s)
    if kind == "card":
        return 12 <= len(n) <= 19 and bool(_CARD.fullmatch(s)) and luhn(n)
    return 9 <= len(n) <= 15 and bool(_PHONE.fullmatch(s))


_WORD = re.compile(r"[a-z]+", re.I)
_TOUCH = re.compile(r"[0-9@]|dot", re.I)


def plausible(kind: str, s: str) -> bool:
    """Whether a span that the tagger proposes can be of its kind, in whatever form it is written."""
    if not 6 <= len(s) <= LONGEST or not _TOUCH.search(s):
        return False
    n, words = _digits(s), {w.lower() for w in _WORD.findall(s)}
    if kind == "email":
        return ("@" in s or "at" in words) and ("." in s or "dot" in words) and len(words - {"at", "dot"}) > 1
    if kind == "secret":
        return len(s) >= 16 and bool(n) and bool(words) and not any(c.isspace() for c in s)
    if words:
        return False
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(map(_small, parts))
    if kind == "card":
        return 12 <= len(n) <= 19 and luhn(n)
    return 7 <= len(n) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns, in order; code points, end exclusive."""
    if not _TRIGGER.search(text):
        return []
    out = [(s, 0, e) for s, e in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m.groups()))]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() > 11 and valid("card", m.group())]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out)


# --- tagger -------------------------------------------------------------------------------------------------------

TAGS = 1 + 2 * len(TAGGED)
_CLASSES = 48
_CODES = np.full(256, 1, np.int64)
for _k in range(10):
    _CODES[48 + _k] = 2
for _k in range(26):
    _CODES[65 + _k], _CODES[97 + _k] = 3, 4
for _k, _c in enumerate("@.+-()_% \t\n\r,;:/#\"'<>[]{}=|*&$!?\\^`~"):
    _CODES[ord(_c)] = 5 + _k


def encode_chars(text: str) -> np.ndarray:
    """Character classes: 0 padding, 1 other, then digits, letters and single marks."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, _CODES[np.minimum(points, 127)], np.where(points >= 0xC0, 4, 1))


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _logsum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Embeddings, an LSTM in each direction, a projection to tags, and a CRF."""

    def __init__(self, hidden: int = 20, size: int = 12, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        p = {"emb": rng.normal(0, 0.3, (_CLASSES, size)), "out": rng.normal(0, 0.2, (2 * hidden, TAGS)), "bias": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS)}
        for d in ("f", "b"):
            p["w" + d] = rng.normal(0, 0.25, (size + hidden, 4 * hidden))
            p["c" + d] = np.concatenate((np.ones(hidden), np.zeros(3 * hidden)))
        self.p = {k: v.astype(np.float32) for k, v in p.items()}
        # An inside tag follows only its own begin or inside tag.
        self.forbid = np.zeros((TAGS, TAGS), np.float32)
        for k in range(len(TAGGED)):
            self.forbid[:, 2 + 2 * k] = -1e4
            self.forbid[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
        self.forbid_first = np.array([0] + [0, -1e4] * len(TAGGED), np.float32)

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        """x: time, batch, size. Hidden states, and what the backward pass needs."""
        h_n, w, c0 = self.hidden, self.p["w" + d], self.p["c" + d]
        size = x.shape[2]
        steps, batch = x.shape[:2]
        h, c = np.zeros((batch, h_n), np.float32), np.zeros((batch, h_n), np.float32)
        out, memo = np.empty((steps, batch, h_n), np.float32), []
        fed = x @ w[:size] + c0
        for t in range(steps):
            z = fed[t] + h @ w[size:]
            g = _sigmoid(z[:, : 3 * h_n])
            f, i, o = g[:, :h_n], g[:, h_n : 2 * h_n], g[:, 2 * h_n :]
            u = np.tanh(z[:, 3 * h_n :])
            c_new = f * c + i * u
            tc = np.tanh(c_new)
            if keep:
                memo.append((h, c, f, i, o, u, tc))
            h, c = o * tc, c_new
            out[t] = h
        return out, memo

    def _lstm_back(self, x, d, memo, dout, grad):
        h_n, w = self.hidden, self.p["w" + d]
        size = x.shape[2]
        dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
        dx, dw, db = np.empty_like(x), np.zeros_like(w), np.zeros(4 * h_n, np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, c, f, i, o, u, tc = memo[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate((dc * c * f * (1 - f), dc * u * i * (1 - i), dh * tc * o * (1 - o), dc * i * (1 - u * u)), 1)
            dw[:size] += x[t].T @ dz
            dw[size:] += h.T @ dz
            db += dz.sum(0)
            dx[t] = dz @ w[:size].T
            dh, dc = dz @ w[size:].T, dc * f
        grad["w" + d], grad["c" + d] = dw, db
        return dx

    def emissions(self, chars: np.ndarray, keep: bool = False):
        """chars: batch, time. Scores of tags: time, batch, tags."""
        x = self.p["emb"][chars.T]
        forward, mf = self._lstm(x, "f", keep)
        backward, mb = self._lstm(x[::-1], "b", keep)
        states = np.concatenate((forward, backward[::-1]), 2)
        return states @ self.p["out"] + self.p["bias"], (x, mf, mb, states)

    def decode(self, chars: np.ndarray) -> np.ndarray:
        """Best tags of windows, batch by time."""
        e, _ = self.emissions(chars)
        trans = self.p["trans"] + self.forbid
        score, back = e[0] + self.p["first"] + self.forbid_first, []
        for t in range(1, len(e)):
            step = score[:, :, None] + trans
            back.append(step.argmax(1))
            score = step.max(1) + e[t]
        best = [score.argmax(1)]
        for b in reversed(back):
            best.append(b[np.arange(len(b)), best[-1]])
        return np.stack(best[::-1], 1)

    def _step(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Negative log likelihood of a batch and its gradients, by forward-backward over the CRF."""
        e, (x, mf, mb, states) = self.emissions(chars, keep=True)
        steps, batch, _ = e.shape
        trans, first = self.p["trans"] + self.forbid, self.p["first"] + self.forbid_first
        gold, each = tags.T, np.arange(batch)
        alpha = np.empty_like(e)
        alpha[0] = e[0] + first
        for t in range(1, steps):
            alpha[t] = _logsum(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        z = _logsum(alpha[-1], 1)
        beta, d_trans, d_e = np.zeros_like(e[0]), np.zeros_like(trans), np.empty_like(e)
        d_e[-1] = np.exp(alpha[-1] - z[:, None])
        for t in range(steps - 1, 0, -1):
            joint = np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta)[:, None, :] - z[:, None, None])
            d_trans += joint.sum(0)
            d_e[t - 1] = joint.sum(2)
            beta = _logsum(trans + (e[t] + beta)[:, None, :], 2)
        path = e[np.arange(steps)[:, None], each, gold].sum() + first[gold[0]].sum() + trans[gold[:-1], gold[1:]].sum()
        loss = float(z.sum() - path) / batch
        np.subtract.at(d_trans, (gold[:-1], gold[1:]), 1)
        d_first = d_e[0].sum(0) - np.bincount(gold[0], minlength=TAGS)
        d_e[np.arange(steps)[:, None], each, gold] -= 1
        grad = {"trans": d_trans, "first": d_first, "bias": d_e.sum((0, 1)), "out": np.tensordot(states, d_e, ((0, 1), (0, 1)))}
        d_states = d_e @ self.p["out"].T
        dx = self._lstm_back(x, "f", mf, d_states[:, :, : self.hidden], grad)
        dx = dx + self._lstm_back(x[::-1], "b", mb, d_states[::-1, :, self.hidden :], grad)[::-1]
        grad["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(grad["emb"], chars.T, dx)
        return loss, {k: (g / batch).astype(np.float32) for k, g in grad.items()}

    def fit(self, chars: np.ndarray, tags: np.ndarray, epochs: int = 6, batch: int = 48, rate: float = 0.012, seed: int = SEED) -> list[float]:
        rng = np.random.default_rng(seed)
        m, v, losses, n = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, [], 0
        steps = epochs * (-(-len(chars) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(chars))
            for s in range(0, len(order), batch):
                part = order[s : s + batch]
                loss, grad = self._step(chars[part], tags[part])
                n += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                pace = rate * (1 - n / (steps + 1))
                for k, g in grad.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= pace * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)
                losses.append(loss)
        return losses


def labelled_windows(count: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows of text with the spans in them: personal data and secrets in many forms, and lookalikes."""
    rng = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgkéèüñß"
    pick, chance = rng.choice, rng.random
    word = lambda: "".join(pick(letters) for _ in range(rng.randrange(1, 10)))
    number = lambda n: "".join(pick("0123456789") for _ in range(n))
    name = lambda: "".join(pick("abcdefghijklmnoprstuw") for _ in range(rng.randrange(2, 9)))
    code = lambda n, of="0123456789abcdef": "".join(pick(of) for _ in range(n))

    def email():
        user = f"{name()}{pick(['.', '_', '-', '', '+'])}{pick([name(), number(2), ''])}x"
        domain = [f"{name()}{pick(['', number(1)])}", *pick([["example", "com"], ["org"], ["net"], [name(), "com"], ["co", "uk"]])]
        if chance() < 0.65:
            return f"{user}@{'.'.join(domain)}"
        at, dot = pick([(" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" @ ", " . "), (" AT ", " DOT "), ("(at)", ".")])
        return user + at + dot.join(domain)

    def ip():
        parts = [str(rng.randrange(256)) for _ in range(4)]
        return pick([".", ".", ".", " . ", "[.]", ". "]).join(parts)

    def card():
        n = number(pick([13, 14, 15, 15, 16, 16, 16, 16, 19]) - 1)
        full = next(n + str(d) for d in range(10) if luhn(n + str(d)))
        if len(full) == 16 and chance() < 0.6:
            full = pick(" -./_").join(full[k : k + 4] for k in range(0, 16, 4))
        return full

    def phone():
        forms = ["+1 (333) 333-4444", "+22 333 7777777", "+55555555555", "+22-333-333-333", "+1.333.333.4444"]
        forms += ["(333) 333-4444", "333-333-4444", "333.333.4444", "0333 7777777", "0333/7777777", "0049 33 7777777", "(0333) 666666", "333 333 4444"]
        return re.sub(r"([1-9])\1*", lambda m: number(len(m[0])), pick(forms))

    def secret():
        key = pick(["token", "api_key", "apikey", "secret", "password", "access_token", "auth_token", "client_secret", "key"])
        value = pick([code(40), code(32), code(40), code(24, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), code(20, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")])
        before = key + pick([" = ", " = ", "=", ": ", ":"]) + pick(['"', '"', "'", ""])
        if chance() < 0.15:
            before, value = before.upper(), value.upper()
        return before, value

    others = (
        lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: number(rng.randrange(1, 9)), lambda: f"{number(2)}.{number(2)}", lambda: f"v{number(1)}.{number(1)}.{number(1)}",
        lambda: f"{pick(['commit', 'sha256', 'md5', 'hash', 'id', ''])} {code(pick([8, 12, 32, 40]))}", lambda: f"{number(1)},{number(3)},{number(3)}", lambda: f"@{name()}",
        lambda: f"{number(2)}:{number(2)}:{number(2)}", lambda: f"{number(4)}-{number(4)}", lambda: f"{pick(['ORD', 'No', 'ref'])}-{number(6)}", lambda: f"ISBN 978-{number(1)}-{number(2)}-{number(6)}-{number(1)}",
        lambda: f"{number(16)}", lambda: f"at {name()} dot {name()}", lambda: f"{number(2)}/{number(2)}/{number(4)}", lambda: f"{number(4)}-{number(2)}-{number(2)} {number(2)}:{number(2)}", lambda: "dot " + name(),
        lambda: f"{number(3)} {number(3)}", lambda: f"{number(2)} x {number(2)} = {number(4)}", lambda: f"token {name()}", lambda: code(rng.randrange(12, 90), pick(["x", "a", "=", "-", "abcdefghij", "_."])), lambda: f"{number(1)}.{number(1)}.", lambda: f"{number(3)}, {number(3)}, {number(4)}",
    )
    out = []
    for _ in range(count):
        text, spans = "", []
        while len(text) < WINDOW:
            x = chance()
            if x < 0.24:
                for k in range(pick([1, 1, 1, 2, 2, 3])):
                    kind = rng.randrange(len(TAGGED))
                    if k:
                        text += pick([" ", " ", ", ", "; "])
                    if kind == 4:
                        before, s = secret()
                        after = before[-1] if before[-1] in "'\"" else ""
                    else:
                        before, s, after = "", (email, ip, card, phone)[kind](), ""
                    text += before
                    spans.append((len(text), kind, len(text) + len(s)))
                    text += s + after
            elif x < 0.4:
                text += pick(others)()
            else:
                text += word().upper() if chance() < 0.08 else word().capitalize() if chance() < 0.15 else word()
            text += pick([" ", " ", " ", " ", ", ", ". ", "\n", ": ", " | ", "!! ", "### "])
        cut = rng.randrange(0, max(1, len(text) - WINDOW + 1))
        inside = [(max(0, s - cut), k, min(WINDOW, e - cut)) for s, k, e in spans if s < cut + WINDOW and e > cut]
        out.append((text[cut : cut + WINDOW], inside))
    return out


def as_arrays(windows: list[tuple[str, list[tuple[int, int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    chars, tags = np.zeros((len(windows), WINDOW), np.int64), np.zeros((len(windows), WINDOW), np.int64)
    for row, (text, spans) in enumerate(windows):
        chars[row, : len(text)] = encode_chars(text)
        for s, k, e in spans:
            tags[row, s:e] = 2 + 2 * k
            tags[row, s] = 1 + 2 * k
    return chars, tags


def train(windows: list | None = None) -> Tagger:
    """A tagger of labelled windows (default: TRAINING_WINDOWS generated ones); the same on every run."""
    tagger = Tagger()
    tagger.fit(*as_arrays(windows or labelled_windows(TRAINING_WINDOWS, SEED)))
    return tagger


@cache
def trained() -> Tagger:
    """The tagger of train(), trained once in a session."""
    return train()


def window_starts(text: str, every: bool = False) -> np.ndarray:
    """Starts of the windows of a text that are decoded; every: of all."""
    starts = np.arange(0, max(1, len(text) - WINDOW + STRIDE), STRIDE) if text else np.zeros(0, np.int64)
    if every or not len(starts):
        return starts
    at = np.array([m.start() for m in _TOUCH.finditer(text)], np.int64)
    # A window is needed if any such place is nearer than a span may reach, beginnings of the word dot included.
    low, high = np.searchsorted(at, starts - LONGEST - 4), np.searchsorted(at, starts + WINDOW + LONGEST + 4)
    return starts[high > low]


def tag_texts(tagger: Tagger, texts: list[str], windows_at_once: int = 1024, every: bool = False) -> list[list[tuple[int, int, int]]]:
    """Decoded spans (start, kind, end) of texts: overlapping windows, reconciled by depth."""
    where: list[tuple[int, int, int]] = []
    codes = {}
    for k, text in enumerate(texts):
        starts = window_starts(text, every).tolist()
        if starts:
            codes[k] = encode_chars(text)
        where += [(k, a, min(len(text), a + WINDOW)) for a in starts]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    tags, depth = {k: np.zeros(len(c), np.int8) for k, c in codes.items()}, {k: np.zeros(len(c), np.int16) for k, c in codes.items()}
    for first in range(0, len(where), windows_at_once):
        part = where[first : first + windows_at_once]
        rows = np.zeros((len(part), WINDOW), np.int64)
        for r, (k, a, b) in enumerate(part):
            rows[r, : b - a] = codes[k][a:b]
        best = tagger.decode(rows)
        for r, (k, a, b) in enumerate(part):
            n = b - a
            deep = np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1))
            better = deep > depth[k][a:b]
            tags[k][a:b][better], depth[k][a:b][better] = best[r, :n][better], deep[better]
    for k, t in tags.items():
        at, n = 0, len(t)
        hot = np.flatnonzero(t)
        for i in hot.tolist():
            if i < at:
                continue
            kind, at = (int(t[i]) - 1) // 2, i + 1
            while at < n and t[at] == 2 + 2 * kind:
                at += 1
            out[k].append((i, kind, at))
    return out


def all_spans(tagger: Tagger, texts: list[str], every: bool = False) -> tuple[list, list]:
    """Pattern spans, and those with the tagger's added, of each text. every: decode windows that cannot matter, too."""
    base = [base_spans(t) for t in texts]
    whole = []
    for text, own, found in zip(texts, base, tag_texts(tagger, texts, every=every), strict=True):
        taken = np.zeros(len(text), bool) if found else None
        for s, _, e in own if found else ():
            taken[s:e] = True
        added = []
        for s, kind, e in found:
            if e - s > LONGEST:
                continue
            while s < e and text[s].isspace():
                s += 1
            while s < e and (text[e - 1].isspace() or text[e - 1] in ",;:"):
                e -= 1
            if s < e and plausible(TAGGED[kind], text[s:e]) and not taken[s:e].any():
                taken[s:e] = True
                added.append((s, kind, e))
        whole.append(sorted(own + added))
    return base, whole


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_SCHEMA = "base array<struct<kind: string, start: long, end: long>>, spans array<struct<kind: string, start: long, end: long>>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end, by start then kind) of every row."""
    model = tagger or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        show = lambda spans: [{"kind": TAGGED[k], "start": s, "end": e} for s, k, e in spans]
        for batch in batches:
            base, whole = all_spans(model, [t.as_py() or "" for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(show, base), pa.list_(_SPAN)), pa.array(map(show, whole), pa.list_(_SPAN))], names=["doc_id", "base", "spans"]
            )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id long, {_SCHEMA}")


def redact(docs: DataFrame, text_col: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """docs with every span in the text replaced by its kind in brackets; null text stays null."""
    model = tagger or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            texts = batch.column(place).to_pylist()
            _, whole = all_spans(model, [t or "" for t in texts])
            for k, spans in enumerate(whole):
                parts, at = [], 0
                for s, kind, e in spans:
                    if s >= at:
                        parts.append(texts[k][at:s] + f"[{TAGGED[kind].upper()}]")
                    at = max(at, e)
                if spans:
                    texts[k] = "".join(parts) + texts[k][at:]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)
