"""Personal data: fixed rules, and a character-level bidirectional LSTM with CRF transitions that adds what they miss.

The network is trained here, in numpy, from labelled spans (by default spans that `examples` composes). A text is read in windows
of WINDOW characters that overlap by half. Every span must hold a trigger (a digit, an at sign or a spelled-out one, in
any case, with a dot in either form after a bare word), so windows farther than a window from all triggers can't hold part of a span and aren't run; this loses no span of these forms. Each character takes the tag of the window in whose
middle it lies best, spans are read from the tags of the whole text, checked, and added where no rule's span is.

Nulls and edge cases: a null or empty text has no spans. Long texts are read window by window, in bounded blocks. Repeated
rows give repeated results; a null id is kept; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_arrow

KINDS = ("email", "ip", "card", "phone")
WINDOW = 128
STEP = WINDOW // 2
HIDDEN = 16
EMBED = 12
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
CHARS = 129  # ASCII, and one for all others
BLOCK = 512

SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"

# --- the rules ---


_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[\[(][Aa][Tt][\])]| [Aa][Tt] \S+(?: [\[(]?[Dd][Oo][Tt][\])]? |\.[A-Za-z])")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, in time linear in the text: each at sign is extended to both sides once."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        else:
            end = at + 1 if start == at else max(end, at + 1)
        at = text.find("@", max(end, at + 1))
    return out


def rules(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[-3:] or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# --- labelled spans ---


def examples(n: int, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Composed texts with the spans of personal data in them, and with numbers that aren't personal."""
    rng = random.Random(seed)
    syllables = ["an", "re", "tion", "ou", "st", "er", "la", "que", "en", "ber", "ció", "do", "the", "in", "mi", "ra", "é", "un", "che", "of"]

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))

    def number(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def card(sep: str) -> str:
        body = rng.choice("3456") + number(14)
        return sep.join((body + next(d for d in "0123456789" if luhn(body + d)))[i : i + 4] for i in range(0, 16, 4))

    def domain() -> list[str]:
        return [word() + number(rng.randint(0, 1)), rng.choice(("com", "org", "net", "de", "fr", "es"))]

    def email() -> str:
        name = word() + rng.choice(("", ".", "_", "-")) + rng.choice((word(), number(2)))
        d = domain()
        style = rng.random()
        if style < 0.5:
            return f"{name}@{'.'.join(d)}"
        at, dot = ("at", "dot") if style < 0.75 else (rng.choice(("[at]", "(at)")), rng.choice(("[dot]", "(dot)")))
        form = rng.random()
        if form < 0.25:
            at, dot = at.upper(), dot.upper()
        return f"{name} {at} {d[0]}.{d[1]}" if form > 0.7 else f"{name} {at} {d[0]} {dot} {d[1]}"

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return rng.choice((f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"00{rng.randint(1, 99)} {a} {b}{c}"))

    made = (email, lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), lambda: card(rng.choice(("", " ", "-", "."))), phone)
    decoys = (
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}",
        lambda: number(rng.randint(1, 12)), lambda: f"{rng.randint(1, 9999)}.{number(2)}", lambda: "key=" + "".join(rng.choice("0123456789abcdef") for _ in range(24)),
        lambda: f"{rng.randint(0, 23)}:{number(2)}", lambda: f"{number(3)}-{number(2)}", lambda: f"@{word()}", lambda: f"{number(4)}/{number(2)}", lambda: f"at {word()}",
    )
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(4, 14)):
            draw = rng.random()
            if draw < 0.22:
                k = rng.randrange(4)
                piece = made[k]()
                spans.append((k, len(text), len(text) + len(piece)))
                text += piece
            elif draw < 0.42:
                text += rng.choice(decoys)()
            else:
                text += word().capitalize() if rng.random() < 0.2 else word()
            text += rng.choice((" ", " ", " ", ", ", ". ", "\n"))
        out.append((text, spans))
    return out


# --- the network ---


@dataclass
class Network:
    embed: np.ndarray  # CHARS, EMBED
    wx: np.ndarray  # 2, EMBED, 4 HIDDEN
    wh: np.ndarray  # 2, HIDDEN, 4 HIDDEN
    b: np.ndarray  # 2, 1, 4 HIDDEN
    wo: np.ndarray  # 2 HIDDEN, TAGS
    bo: np.ndarray  # TAGS
    trans: np.ndarray  # TAGS, TAGS
    start: np.ndarray  # TAGS

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.wx, self.wh, self.b, self.wo, self.bo, self.trans, self.start]


#: Transitions that break a span: I of a kind only follows B or I of that kind.
_ALLOWED = np.array([[j == 0 or j % 2 == 1 or i in (j, j - 1) for j in range(TAGS)] for i in range(TAGS)])
_MAY_START = np.array([j == 0 or j % 2 == 1 for j in range(TAGS)])


def coded(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(x < 128, x, 128).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(net: Network, chars: np.ndarray, keep: bool):
    """Hidden states (T, 2, N, HIDDEN) of both directions, the backward one in its own time, and what training needs."""
    n, t = chars.shape
    both = np.stack([chars, chars[:, ::-1]])  # 2, N, T
    table = net.embed @ net.wx + net.b  # 2, CHARS, 4 HIDDEN: the input's share of all gates
    h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
    hs, saved = np.empty((t, 2, n, HIDDEN), np.float32), []
    for k in range(t):
        z = h @ net.wh
        z[0] += table[0][both[0, :, k]]
        z[1] += table[1][both[1, :, k]]
        s = _sigmoid(z[..., : 3 * HIDDEN])
        i, f, o, g = s[..., :HIDDEN], s[..., HIDDEN : 2 * HIDDEN], s[..., 2 * HIDDEN :], np.tanh(z[..., 3 * HIDDEN :])
        before, past = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        hs[k] = h
        if keep:
            saved.append((i, f, o, g, before, past, tc))
    return both, hs, saved


def _emissions(net: Network, hs: np.ndarray) -> np.ndarray:
    return hs[:, 0] @ net.wo[:HIDDEN] + hs[::-1, 1] @ net.wo[HIDDEN:] + net.bo  # T, N, TAGS


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def _crf(net: Network, e: np.ndarray, tags: np.ndarray):
    """Mean negative log-likelihood and its gradients by e, trans and start. tags: N, T."""
    t, n, _ = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0] + net.start
    for k in range(1, t):
        alpha[k] = _logsum(alpha[k - 1][:, :, None] + net.trans, 1) + e[k]
    for k in range(t - 2, -1, -1):
        beta[k] = _logsum(net.trans + (e[k + 1] + beta[k + 1])[:, None, :], 2)
    z = _logsum(alpha[-1], 1)
    de = np.exp(alpha + beta - z[:, None])
    pair = np.exp(alpha[:-1, :, :, None] + net.trans + (e[1:] + beta[1:])[:, :, None, :] - z[:, None, None]).sum((0, 1))
    d_start = de[0].sum(0)
    rows, y = np.arange(n), tags.T
    score = e[np.arange(t)[:, None], rows, y].sum(0) + net.start[y[0]] + net.trans[y[:-1], y[1:]].sum(0)
    np.subtract.at(de, (np.arange(t)[:, None], rows, y), 1)
    np.subtract.at(pair, (y[:-1], y[1:]), 1)
    np.subtract.at(d_start, y[0], 1)
    return float((z - score).mean()), de / n, pair / n, d_start / n


def _gradients(net: Network, chars: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    both, hs, saved = _lstm(net, chars, True)
    loss, de, d_trans, d_start = _crf(net, _emissions(net, hs).astype(np.float64), tags)
    de = de.astype(np.float32)
    d_wo = np.concatenate([np.einsum("tnh,tnk->hk", hs[:, 0], de), np.einsum("tnh,tnk->hk", hs[::-1, 1], de)])
    d_hs = np.stack([de @ net.wo[:HIDDEN].T, (de @ net.wo[HIDDEN:].T)[::-1]], 1)  # T, 2, N, HIDDEN
    d_wh, d_table = np.zeros_like(net.wh), np.zeros((2, CHARS, 4 * HIDDEN), np.float32)
    dh, dc = np.zeros_like(hs[0]), np.zeros_like(hs[0])
    for k in range(len(saved) - 1, -1, -1):
        i, f, o, g, before, past, tc = saved[k]
        dh = dh + d_hs[k]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], -1)
        d_wh += past.transpose(0, 2, 1) @ dz
        for way in range(2):
            np.add.at(d_table[way], both[way, :, k], dz[way])
        dh, dc = dz @ net.wh.transpose(0, 2, 1), dc * f
    d_embed = sum(d_table[w] @ net.wx[w].T for w in range(2))
    d_wx = np.stack([net.embed.T @ d_table[w] for w in range(2)])
    return loss, [d_embed, d_wx, d_wh, d_table.sum(1, keepdims=True), d_wo, de.sum((0, 1)), d_trans, d_start]


def train(labelled: list[tuple[str, list[tuple[int, int, int]]]], steps: int = 260, batch: int = 48, length: int = 96, seed: int = 1) -> Network:
    """Adam on random stretches of the labelled texts."""
    rng = np.random.default_rng(seed)
    rows = []
    for text, spans in labelled:
        x, y = coded(text), np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            y[a:b] = 2 + 2 * kind
            y[a] = 1 + 2 * kind
        rows.append((x, y))
    x, y = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    small = lambda *s: (rng.standard_normal(s) * 0.2).astype(np.float32)
    net = Network(small(CHARS, EMBED), small(2, EMBED, 4 * HIDDEN), small(2, HIDDEN, 4 * HIDDEN), np.zeros((2, 1, 4 * HIDDEN), np.float32), small(2 * HIDDEN, TAGS), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS)), np.zeros(TAGS))
    net.b[..., HIDDEN : 2 * HIDDEN] = 1
    m, v = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    for step in range(1, steps + 1):
        at = rng.integers(0, len(x) - length, batch)
        where = at[:, None] + np.arange(length)
        _, grads = _gradients(net, x[where], y[where])
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads))) / 5)
        for k, (p, g) in enumerate(zip(net.parts(), grads)):
            g = g / norm
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)
    net.trans = np.where(_ALLOWED, net.trans, -1e4)
    net.start = np.zeros(TAGS)  # a window may begin anywhere in a text
    return net


@functools.lru_cache(maxsize=2)
def trained(n: int = 4000, seed: int = 7) -> Network:
    return train(examples(n, seed))


def tagged(net: Network, chars: np.ndarray) -> np.ndarray:
    """The best tags (N, T) of windows (N, T)."""
    e = _emissions(net, _lstm(net, chars, False)[1])
    t, n, _ = e.shape
    trans = net.trans.astype(np.float32)
    score, back = e[0] + net.start.astype(np.float32), np.empty((t, n, TAGS), np.int8)
    for k in range(1, t):
        step = score[:, :, None] + trans
        back[k] = step.argmax(1)
        score = np.take_along_axis(step, back[k][:, None, :].astype(np.int64), 1)[:, 0] + e[k]
    out = np.empty((n, t), np.int8)
    out[:, -1] = score.argmax(1)
    for k in range(t - 1, 0, -1):
        out[:, k - 1] = np.take_along_axis(back[k], out[:, k][:, None].astype(np.int64), 1)[:, 0]
    return out


def _window_numbers(text: str) -> np.ndarray:
    """Windows on the grid that hold part of a trigger, or are next to one that does."""
    at = np.array([m.span() for m in _TRIGGER.finditer(text)], np.int64).reshape(-1, 2)
    last = max(0, -(-(len(text) - WINDOW) // STEP))
    first, end = at[:, 0] // STEP, (at[:, 1] - 1) // STEP
    long = [np.arange(a, b) for a, b in zip(first[end > first + 3].tolist(), end[end > first + 3].tolist())]
    k = np.unique(np.concatenate([first, end, *long]))
    k = np.unique(np.concatenate([k - 2, k - 1, k, k + 1]))
    return k[(k >= 0) & (k <= last)]


def _reconciled(tags: np.ndarray, numbers: np.ndarray, rows: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Spans of one text from the tags of its windows: every character belongs to the window in whose middle half it lies."""
    quarter = WINDOW // 4
    spans: list[list[int]] = []
    last = int(numbers[-1])
    for k, row in zip(numbers.tolist(), rows.tolist()):
        a = 0 if k == 0 else quarter
        b = WINDOW if k == last and k * STEP + WINDOW >= size else WINDOW - quarter
        own = tags[row, a : min(b, size - k * STEP)]
        base = k * STEP + a
        for i in np.flatnonzero(own).tolist():
            tag, c = int(own[i]), base + i
            kind = (tag - 1) // 2
            if tag % 2 == 0 and spans and spans[-1][0] == kind and spans[-1][2] == c:
                spans[-1][2] = c + 1
            else:
                spans.append([kind, c, c + 1])
    return [tuple(s) for s in spans]


_AT = re.compile(r"\S[ ]*(?:@|[\[(]at[\])]| at )[ ]*(?=\S)", re.I)
_DOT = re.compile(r"[a-z0-9-]\.[a-z]{2}", re.I)
_HEX = re.compile(r"[A-Za-z_=\"']")


def plausible(kind: int, found: str) -> bool:
    d = _digits(found)
    if kind == 0:
        at = _AT.search(found)
        return bool(at) and ("." in found.partition("@")[2] or "dot" in found.lower() or bool(_DOT.search(found, at.end()))) and "\n" not in found
    if _HEX.search(found) or "\n" in found:
        return False
    if kind == 1:
        return bool(re.fullmatch(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", found)) and all(int(p) <= 255 for p in found.split("."))
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 and len(re.findall("[0-9]+", found)) >= 2


def added(net: Network, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """The network's spans of each text that are plausible and touch no base span."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    plan = [(i, k) for i, t in enumerate(texts) if (k := _window_numbers(t)).size]
    jobs, held = [], 0

    def flush() -> None:
        nonlocal jobs, held
        if not jobs:
            return
        grid = np.full((held, WINDOW), 10, np.int64)  # past the end: line ends
        row = 0
        for i, numbers in jobs:
            x = coded(texts[i])
            for k in numbers.tolist():
                part = x[k * STEP : k * STEP + WINDOW]
                grid[row, : len(part)] = part
                row += 1
        tags = np.concatenate([tagged(net, grid[a : a + BLOCK]) for a in range(0, held, BLOCK)])
        row = 0
        for i, numbers in jobs:
            spans = _reconciled(tags, numbers, np.arange(row, row + len(numbers)), len(texts[i]))
            row += len(numbers)
            for kind, a, b in spans:
                while a < b and texts[i][a] in " .,;:\n":
                    a += 1
                while b > a and texts[i][b - 1] in " .,;:\n":
                    b -= 1
                found = texts[i][a:b]
                if found and _TRIGGER.search(found) and plausible(kind, found) and all(b <= x or a >= y for _, x, y in base[i]):
                    out[i].append((kind, a, b))
        jobs, held = [], 0

    for i, numbers in plan:
        jobs.append((i, numbers))
        held += len(numbers)
        if held >= 4 * BLOCK:
            flush()
    flush()
    return out


def find(net: Network, texts: list[str | None]) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    texts = [t or "" for t in texts]
    base = [rules(t) for t in texts]
    return list(zip(base, added(net, texts, base)))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def personal_data(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """One row for each document: counts and digest of the base spans, and all spans."""
    spark = docs.sparkSession
    bounded_arrow(spark)
    shared = spark.sparkContext.broadcast(net or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find(shared.value, batch.column(1).to_pylist())
            cols = [batch.column(0)] + [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
            cols += [pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()), pa.array([joined(base + more) for base, more in found], pa.string())]
            cols.append(pa.array([len(more) for _, more in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA)


def masked(docs: DataFrame, net: Network | None = None, text_col: str = "text") -> DataFrame:
    """docs with [EMAIL], [IP], [CARD] and [PHONE] in place of the spans; overlapping spans give one mark, of the first."""
    spark = docs.sparkSession
    bounded_arrow(spark)
    shared, at = spark.sparkContext.broadcast(net or trained()), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, (base, more) in enumerate(find(shared.value, texts)):
                if base or more:
                    texts[i] = mask(texts[i], base + more)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[0])):
        if a >= end:
            out += [text[end:a], f"[{KINDS[kind].upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]
