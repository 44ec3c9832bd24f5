"""Personal data by a character-level bidirectional LSTM with CRF transitions, beside fixed patterns.

The base patterns give spans of four kinds; they stay. The model adds what they can't see: written variants of the four
kinds (spelled or bracketed addresses, numbers without a plus, other separators) and secrets (keys, tokens, passwords).
It is trained in numpy on labelled spans: those of the base patterns, secrets that are assigned to a name that says so,
in a bounded sample of rows, and written variants put into windows of their texts. Texts are read in overlapping
windows; each window is tagged by Viterbi decoding over the CRF; a position's tag is taken from the window in which it
is farthest from an edge, so a text has one tagging, whatever its length. A tagged span is added if it overlaps no base
span, is of whole words and numbers, and has its kind's form (numbers of digits, Luhn's check, parts of an address).

Every form has an anchor: a digit, `@`, or a spelled `dot` or bracketed `at`. So a window without one can't add a span
whatever the network says, and isn't evaluated.

Edge cases: a null text is empty and has no spans; no rows or no base spans to learn from leave the model on its
written variants; ties in decoding go to the outside tag; repeated rows are read each; very long texts are read
whole, in time in proportion; an empty table gives no rows; extra columns are ignored by `personal_data` and kept by
`redacted`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelframe.llm.common import map_in_arrow, portions, small_batches

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
#: An address from the first character of its run, so that no run is read from each of its characters anew.
_MAIL, _MAIL_HERE = re.compile(rf"(?<!{_LOCAL}){_LOCAL}++@{_DOMAIN}"), re.compile(rf"{_LOCAL}++@{_DOMAIN}")
_PATTERNS = (
    None,
    re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+"),
    re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)
#: What the network may add, beyond the four kinds.
SECRET = len(KINDS)
NAMES = (*KINDS, "secret")
#: Forms of what is added.
_AT, _DOT_SAID = r"(?:\s?@\s?|\s?[\[(]\s?at\s?[\])]\s?| at )", r"\s?[\[(]\s?dot\s?[\])]\s?| dot "
_DOT = rf"(?:\s?\.\s?|{_DOT_SAID})"
_FORMS = (
    re.compile(rf"[\w%+-]+(?:(?:\.|{_DOT_SAID})[\w%+-]+)*{_AT}[\w-]+(?:{_DOT}[\w-]+)+", re.I),
    re.compile(r"[0-9]{1,3}(?:\s?[\[(]?\.[\])]?\s?[0-9]{1,3}){3}"),
    re.compile(r"[0-9]+(?:[ ./_\u2013-]{1,3}[0-9]+)*"),
    re.compile(r"[+(]{0,2}[0-9]+(?:[() ./-]{1,3}[0-9]+)+"),
    re.compile(r"(?=(?:[^0-9]*[0-9]){2})(?=.*[A-Za-z])[A-Za-z0-9_/+=-]{16,}"),
)
_ANCHOR = re.compile(r"[0-9@]|[\[(]\s?(?:at|dot)\s?[\])]| dot ", re.I)
#: The same for Spark's regular expressions.
ANCHOR_SQL = r"(?i)[0-9@]|[\[(]\s?(at|dot)\s?[\])]| dot "
#: Assignments that label secrets for training.
_ASSIGNED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|(?:api|access)[ _-]?key)\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_/+=-]{16,200})")
_DIGIT = re.compile("[0-9]")
#: Characters of a window, and how far the next one starts.
WINDOW, STRIDE = 128, 64
#: Hidden units each way, size of a character's vector, tags (outside and one a kind).
HIDDEN, EMBED, TAGS = 16, 12, len(NAMES) + 1
#: Rows that teach at most, windows each gives, windows in all, of these with written variants, passes over them.
TEACHERS, WINDOWS, LESSONS, VARIANTS, PASSES = 2000, 3, 1600, 1800, 6
_SEED = 20260


def _digits(s: str) -> list[int]:
    return [ord(c) - 48 for c in s if "0" <= c <= "9"]


def luhn(s: str) -> bool:
    d = _digits(s)[::-1]
    return (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def valid(kind: int, s: str) -> bool:
    """The check of a kind beyond its pattern."""
    if kind == 1:
        return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in s.split("."))
    if kind == 2:
        return 13 <= len(_digits(s)) <= 19 and luhn(s)
    if kind == 3:
        return 9 <= len(_digits(s)) <= 15
    return True


def _mails(text: str) -> Iterator[tuple[int, int]]:
    m = _MAIL.search(text)
    while m:
        yield m.span()
        # what follows may begin in the middle of a run, where the last one ended
        m = _MAIL_HERE.match(text, m.end()) or _MAIL.search(text, m.end())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), leftmost non-overlapping within each kind, failing matches dropped."""
    found = []
    if "@" in text:
        found += [(0, a, b) for a, b in _mails(text)]
    if _DIGIT.search(text):
        for kind in (1, 2, 3):
            found += [(kind, m.start(), m.end()) for m in _PATTERNS[kind].finditer(text) if valid(kind, m[0])]
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{NAMES[k]}:{a}:{b}" for k, a, b in sorted(spans))


# characters -> 98 classes: printable ASCII each, line feed and other controls, letters beyond, all else
def _class(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.where(points < 128, np.maximum(points, 31) - 31, 97)
    return np.where((points >= 0xC0) & (points < 0x250), 98, out).astype(np.int64)


CLASSES = 99


class Tagger:
    """Bidirectional LSTM, linear emissions, CRF; float32."""

    def __init__(self, seed: int = _SEED):
        r = np.random.Generator(np.random.PCG64(seed))
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": g(CLASSES, EMBED), "O": g(2 * HIDDEN, TAGS), "ob": np.zeros(TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32)}
        for way in "fb":
            self.p[f"W{way}"], self.p[f"U{way}"] = g(EMBED, 4 * HIDDEN), g(HIDDEN, 4 * HIDDEN)
            self.p[f"b{way}"] = np.zeros(4 * HIDDEN, np.float32)
            self.p[f"b{way}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first

    def _lstm(self, x: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, batch, HIDDEN) of classes (batch, time)."""
        p, h_ = self.p, HIDDEN
        table = p["E"] @ p[f"W{way}"] + p[f"b{way}"]
        u, (n, steps) = p[f"U{way}"], x.shape
        h, c = np.zeros((n, h_), np.float32), np.zeros((n, h_), np.float32)
        out = np.empty((steps, n, h_), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = table[x[:, t]] + h @ u
            s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h_], -30, 30)))
            g = np.tanh(z[:, 3 * h_ :])
            c0, h0 = c, h
            c = s[:, h_ : 2 * h_] * c + s[:, :h_] * g
            tc = np.tanh(c)
            h = s[:, 2 * h_ :] * tc
            out[t] = h
            if keep is not None:
                keep.append((t, s, g, c0, tc, h0))
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(time, batch, TAGS)."""
        return np.concatenate([self._lstm(x, "f"), self._lstm(x, "b")], axis=2) @ self.p["O"] + self.p["ob"]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi tags (batch, time)."""
        e, trans = self.emissions(x), self.p["T"]
        steps, n, _ = e.shape
        score, back = e[0], np.empty((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            step = score[:, :, None] + trans
            back[t] = step.argmax(axis=1)
            score = step.max(axis=1) + e[t]
        tags = np.empty((n, steps), np.int8)
        tags[:, -1] = score.argmax(axis=1)
        rows = np.arange(n)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t, rows, tags[:, t]]
        return tags

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tags y under the CRF and its gradients."""
        p, h_, (n, steps) = self.p, HIDDEN, x.shape
        kept: dict[str, list] = {"f": [], "b": []}
        hidden = np.concatenate([self._lstm(x, w, kept[w]) for w in "fb"], axis=2)
        e, trans = (hidden @ p["O"] + p["ob"]).astype(np.float64), p["T"].astype(np.float64)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        d = np.exp(alpha + beta - z[:, None])
        d_trans, rows = np.zeros_like(trans), np.arange(n)
        loss = z.sum()
        for t in range(steps):
            loss -= e[t, rows, y[:, t]].sum()
            d[t, rows, y[:, t]] -= 1
            if t:
                both = np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None])
                d_trans += both.sum(axis=0)
                np.add.at(d_trans, (y[:, t - 1], y[:, t]), -1)
                loss -= trans[y[:, t - 1], y[:, t]].sum()
        d = (d / (n * steps)).astype(np.float32)
        grads = {"T": (d_trans / (n * steps)).astype(np.float32), "O": np.einsum("tnh,tnk->hk", hidden, d), "ob": d.sum(axis=(0, 1)), "E": np.zeros_like(p["E"])}
        d_hidden = d @ p["O"].T
        for w, part in (("f", slice(0, h_)), ("b", slice(h_, 2 * h_))):
            gw, gu, gb = np.zeros_like(p[f"W{w}"]), np.zeros_like(p[f"U{w}"]), np.zeros_like(p[f"b{w}"])
            dh, dc = np.zeros((n, h_), np.float32), np.zeros((n, h_), np.float32)
            for t, s, g, c0, tc, h0 in reversed(kept[w]):
                dh = dh + d_hidden[t][:, part]
                i, f, o = s[:, :h_], s[:, h_ : 2 * h_], s[:, 2 * h_ :]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                dc = dc * f
                dh = dz @ p[f"U{w}"].T
                v = p["E"][x[:, t]]
                gw += v.T @ dz
                gu += h0.T @ dz
                gb += dz.sum(axis=0)
                np.add.at(grads["E"], x[:, t], dz @ p[f"W{w}"].T)
            grads |= {f"W{w}": gw, f"U{w}": gu, f"b{w}": gb}
        return float(loss) / (n * steps), grads

    def fit(self, x: np.ndarray, y: np.ndarray, passes: int = PASSES, batch: int = 48, rate: float = 0.02) -> Tagger:
        """Adam."""
        r = np.random.Generator(np.random.PCG64(_SEED + 1))
        m, v, step = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        for k in range(passes):
            order = r.permutation(len(x))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                _, g = self.gradients(x[own], y[own])
                step += 1
                norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                for name, a in g.items():
                    a = a / max(1.0, norm)
                    m[name] += 0.1 * (a - m[name])
                    v[name] += 0.01 * (a * a - v[name])
                    move = rate * 0.6**k * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)
                    self.p[name] = (self.p[name] - move).astype(np.float32)
        return self


def _starts(size: int) -> list[int]:
    """Where windows begin, so that they cover the text and overlap."""
    return [0] if size <= WINDOW else [*range(0, size - WINDOW, STRIDE), size - WINDOW]


class _Writer:
    """Written variants of the kinds, as the base patterns miss them, and what only looks like them, for training."""

    def __init__(self, seed: int):
        self.rng = np.random.Generator(np.random.PCG64(seed))

    def any(self, *of):
        """One of these."""
        return of[int(self.rng.integers(0, len(of)))]

    def word(self, least: int = 2, most: int = 8) -> str:
        return "".join(self.rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(self.rng.integers(least, most))))

    def digits(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def mail(self) -> str:
        at, dot = self.any(("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."), (" @ ", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "))
        name = self.any(self.word(), f"{self.word()}.{self.word()}", f"{self.word()}{self.digits(2)}", f"{self.word()}{dot}{self.word()}")
        return f"{name}{at}{self.word(3, 9)}{self.any('', self.digits(1))}{dot}{self.any('com', 'org', 'net', 'example' + dot + 'com', 'co' + dot + 'uk', 'de')}"

    def ip(self) -> str:
        return self.any(".", ".", "[.]", " . ", "(.)").join(map(str, self.rng.integers(0, 256, 4)))

    def card(self) -> str:
        d = self.any("4", "5", "3") + self.digits(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return d if self.rng.random() < 0.2 else self.any(".", "/", "_", " - ", " . ", "\u2013", " ").join(d[i : i + 4] for i in range(0, 16, 4))

    def phone(self) -> str:
        a, b, c = self.digits(3), self.digits(3), self.digits(4)
        return self.any(
            f"+{self.digits(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{self.digits(2)} {a} {b}{c}",
            f"00{self.digits(2)} {a} {b} {c}", f"0{a}/{b}{c}", f"({a}) {b} {c}",
        )

    def secret(self) -> str:
        n = int(self.rng.integers(20, 48))
        return "".join(self.rng.choice(list(self.any("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")), n - 4)) + self.digits(4)

    def variant(self) -> tuple[str, int, int, int]:
        """A text, its kind (-1: none), and where in it the span begins and ends."""
        kind = self.any(-1, 0, 0, *range(len(NAMES)))
        if kind == -1:  # dates, versions, prices, plain numbers
            s = self.any(f"{self.digits(4)}-{self.digits(2)}-{self.digits(2)}", f"v{self.digits(1)}.{self.digits(1)}", f"{self.digits(3)},{self.digits(3)}.{self.digits(2)}", self.digits(int(self.rng.integers(1, 13))), f"look at {self.word()}", f"{self.digits(2)}:{self.digits(2)}", f"a dot {self.word()}")
            return s, -1, 0, 0
        s = (self.mail, self.ip, self.card, self.phone, self.secret)[kind]()
        before = self.any("token = \"", "api_key: ", "secret=", "password: \"", "ACCESS_KEY='") if kind == SECRET else ""
        if kind != SECRET and self.rng.random() < 0.3:
            before = self.any("call ", "tel ", "mail ", "card ", "ip ", "contact: ", "(", "at ")
        after = {'"': '"', "'": "'"}.get(before[-1:], "") if kind == SECRET else ""
        return before + s + after, kind, len(before), len(before) + len(s)


def labelled(text: str) -> list[tuple[int, int, int]]:
    """Base spans, and secrets that are assigned to a name that says so."""
    found = base_spans(text)
    return found + [(SECRET, *m.span(1)) for m in _ASSIGNED.finditer(text) if _FORMS[SECRET].fullmatch(m[1])]


def teaching_windows(text: str, seed: int, most: int = WINDOWS) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """At most so many windows from anywhere in a text, with the spans in them: around spans, numbers and plain ones."""
    rng = np.random.Generator(np.random.PCG64(seed))
    spans = labelled(text)
    # numbers that fail a check look like those that pass: neither teaches
    unsure = [m.span() for m in _PATTERNS[2].finditer(text) if not valid(2, m[0]) and len(_digits(m[0])) >= 9 and not any(a <= m.start() < b for _, a, b in spans)]
    picks = [a for _, a, _ in spans]
    at = [int(picks[k]) - int(rng.integers(0, WINDOW * 3 // 4)) for k in rng.permutation(len(picks))[: most - 1]]
    found = []
    for a in [*at, *rng.integers(0, max(1, len(text) - WINDOW), most - len(at)).tolist()]:
        a = max(0, min(a, len(text) - WINDOW))
        if not any(x < a + WINDOW and y > a for x, y in unsure):
            found.append((text[a : a + WINDOW], [(k, max(0, x - a), min(WINDOW, y - a)) for k, x, y in spans if x < a + WINDOW and y > a]))
    return found


def lessons(windows: list[tuple[str, list[tuple[int, int, int]]]], most: int = LESSONS, variants: int = VARIANTS) -> tuple[np.ndarray, np.ndarray]:
    """Windows (classes) and their tags: those given, and some of them with written variants put in."""
    writer = _Writer(_SEED + 2)
    rng = writer.rng
    given = [windows[k] for k in sorted(rng.permutation(len(windows))[:most].tolist())]
    plain = [w for w, spans in windows if not spans and " " in w] or ["the page says that and no more than this " * 3]
    for _ in range(variants):
        text, (s, kind, a, b) = plain[int(rng.integers(0, len(plain)))], writer.variant()
        cut = int(rng.integers(0, max(1, len(text) - 30)))
        cut = text.find(" ", cut) + 1
        put = f"{text[:cut]}{s}{writer.any(' ', ' ', ', ', '. ', ')')}{text[cut:]}"[:WINDOW]
        given.append((put, [(kind, cut + a, min(WINDOW, cut + b))] if kind >= 0 and cut + a < WINDOW else []))
    x, y = np.zeros((len(given), WINDOW), np.int64), np.zeros((len(given), WINDOW), np.int64)
    for k, (text, spans) in enumerate(given):
        x[k, : len(text)] = _class(text)
        for kind, a, b in spans:
            y[k, a:b] = kind + 1
    return x, y


def trained(docs: DataFrame, teachers: int = TEACHERS, windows: int = WINDOWS, most: int = LESSONS, variants: int = VARIANTS) -> Tagger:
    """Learns from at most `windows` windows of at most `teachers` rows each, dealt by a hash of id and text, among rows with an anchor."""
    rows = docs.where(F.col("text").rlike(ANCHOR_SQL)).select("text", F.xxhash64("doc_id", "text").alias("h"))
    # as many by chance as are wanted and a half more, so that tasks send the driver no more than that in all
    whole = 1 << 30
    part = min(whole, whole * teachers * 3 // (2 * max(1, rows.count())) + 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in portions(b)):
            given = zip(batch.column("text").to_pylist(), batch.column("h").to_pylist())
            found = [(h, w, spans) for t, h in given for w, spans in teaching_windows(t, h & 0xFFFFFFFF, windows)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([h for h, _, _ in found], pa.int64()),
                    pa.array([w for _, w, _ in found], pa.string()),
                    pa.array([[x for s in spans for x in s] for _, _, spans in found], pa.list_(pa.int32())),
                ],
                ["h", "text", "spans"],
            )

    sample = (
        map_in_arrow(rows.where(F.pmod("h", F.lit(whole)) < part), cut, "h long, text string, spans array<int>")
        .orderBy("h", "text")
        .limit(teachers * windows)
        .collect()
    )
    return Tagger().fit(*lessons([(r["text"], list(zip(*[iter(r["spans"])] * 3))) for r in sample], most, variants))


class Finder:
    def __init__(self, tagger: Tagger, all_windows: bool = False):
        self.tagger, self.all_windows = tagger, all_windows

    def spans(self, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
        """Base spans and added spans of each text."""
        base, windows = [], []
        for n, text in enumerate(texts):
            base.append(base_spans(text))
            if self.all_windows or _ANCHOR.search(text):
                windows += [(n, a) for a in _starts(len(text)) if self.all_windows or _ANCHOR.search(text, a, a + WINDOW)]
        decoded: dict[int, dict[int, np.ndarray]] = {}
        for at in range(0, len(windows), 512):
            part = windows[at : at + 512]
            x = np.zeros((len(part), WINDOW), np.int64)
            for k, (n, a) in enumerate(part):
                own = _class(texts[n][a : a + WINDOW])
                x[k, : len(own)] = own
            for (n, a), found in zip(part, self.tagger.decode(x)):
                if _ANCHOR.search(texts[n], a, a + WINDOW):
                    decoded.setdefault(n, {})[a] = found
        tags = {n: self._reconciled(len(texts[n]), own) for n, own in decoded.items()}
        return [(own, self._added(texts[n], tags[n], own) if n in tags else []) for n, own in enumerate(base)]

    @staticmethod
    def _reconciled(size: int, decoded: dict[int, np.ndarray]) -> np.ndarray:
        """One tag for each position, from the window in which it lies deepest, the first of several."""
        tag, depth = np.zeros(size, np.int8), np.full(size, -1, np.int16)
        starts = _starts(size)
        # windows that stay outside throughout count too where they reach into others
        near = {k for a in decoded for at in (len(starts) - 1 if a == starts[-1] else a // STRIDE,) for k in range(at - 2, at + 3)}
        for k in sorted(k for k in near if 0 <= k < len(starts)):
            a = starts[k]
            end = min(a + WINDOW, size)
            i = np.arange(a, end)
            # how far inside the window; the text's own ends are no edges
            inside = np.minimum(i - a if a else np.full(len(i), WINDOW), end - 1 - i if end < size else WINDOW)
            better = inside > depth[a:end]
            tag[a:end][better] = decoded[a][: end - a][better] if a in decoded else 0
            depth[a:end][better] = inside[better]
        return tag

    @staticmethod
    def _added(text: str, tag: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        taken = np.zeros(len(text) + 1, bool)
        for _, a, b in base:
            taken[a:b] = True
        edges = np.flatnonzero(np.diff(tag)) + 1
        out = []
        for a, b in zip([0, *edges], [*edges, len(tag)]):
            if not tag[a]:
                continue
            kind, a, b = int(tag[a]) - 1, int(a), int(b)
            # to the ends of the words it begins and ends in, without marks around
            while a > 0 and text[a].isalnum() and text[a - 1].isalnum():
                a -= 1
            while b < len(text) and text[b].isalnum() and text[b - 1].isalnum():
                b += 1
            while b > a and not text[b - 1].isalnum():
                b -= 1
            while a < b and not (text[a].isalnum() or kind == 3 and text[a] in "+("):
                a += 1
            while kind == 3 and text[a : a + 1] == "(" and text.count("(", a, b) > text.count(")", a, b):
                a += 1
            if kind == 0 and b - a <= LONGEST[0] and not _FORMS[0].fullmatch(text, a, b):
                # the tags say where an address is, its form where it ends, if at least half of it is tagged
                for m in _FORMS[0].finditer(text, max(0, a - BESIDE), b + BESIDE):
                    if 2 * (min(b, m.end()) - max(a, m.start())) >= m.end() - m.start():
                        a, b = m.span()
                        break
            s = text[a:b]
            if len(s) <= LONGEST[kind] and _FORMS[kind].fullmatch(s) and whole(kind, s) and not taken[a:b].any():
                out.append((kind, a, b))
        return out


#: Characters of a span that is added, at most.
LONGEST = (254, 40, 60, 40, 512)
#: Characters beside a tagged part of an address in which the rest is looked for.
BESIDE = 48


def whole(kind: int, s: str) -> bool:
    """The check on a form's numbers, as for base spans."""
    if kind == 1:
        return all(int(p) <= 255 for p in re.findall("[0-9]+", s))
    return valid(kind, s)


def personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_secret, secrets), one for each row of docs.

    The counts and the digest are of base spans; spans are all of the four kinds, n_added those of them that the network
    added; secrets are its spans of that kind. Positions are code points.
    """
    finder = Finder(tagger or trained(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in portions(b)):
            found = finder.spans([t or "" for t in batch.column("text").to_pylist()])
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *counts,
                    pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()),
                    pa.array([joined(base + [s for s in added if s[0] != SECRET]) for base, added in found], pa.string()),
                    pa.array([sum(s[0] != SECRET for s in added) for _, added in found], pa.int64()),
                    pa.array([sum(s[0] == SECRET for s in added) for _, added in found], pa.int64()),
                    pa.array([joined([s for s in added if s[0] == SECRET]) for _, added in found], pa.string()),
                ],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_secret", "secrets"],
            )

    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    given = docs.select(F.col("doc_id").cast("long"), "text")
    return map_in_arrow(given, run, f"doc_id long, {kinds}, base_sha256 string, spans string, n_added long, n_secret long, secrets string")


def redacted(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """docs with each span of personal data in text replaced by its kind in angle brackets; n_chars follows if there is one."""
    finder = Finder(tagger or trained(docs))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text, (base, added) in zip(texts, finder.spans([t or "" for t in texts])):
            end, parts = 0, []
            for kind, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
                if b <= end:
                    continue
                if a >= end:  # one that overlaps the last only lengthens it
                    parts += [text[end:a], f"<{NAMES[kind].upper()}>"]
                end = b
            out.append("".join([*parts, text[end:]]) if parts else text)
        return pd.Series(out, dtype=object)

    small_batches(docs.sparkSession)
    changed = {"text": run(F.col("text"))}
    done = docs.withColumns(changed)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done
