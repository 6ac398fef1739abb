"""Personal data: fixed rules, and a character-level bidirectional LSTM with a CRF on top.

The rules find emails, IP addresses, payment cards and phone numbers that are written
plainly.  The model, trained here in numpy on labelled spans, adds what they don't
match (phones without +, cards with dots, ``name [at] host [dot] tld`` ...).  Texts are
cut into overlapping windows of ``WINDOW`` characters every ``STRIDE``; each window is
decoded by Viterbi, and a document's windows are reconciled globally: pieces of one kind
that are cut at a window's edge are joined, and of spans that overlap the set with the
highest total score stays.  A span that the model adds must pass its kind's exact check
(digits, Luhn, parts at most 255) and touch no span of the rules.

Every kind needs a digit, ``@``, ``[`` or ``(``, and every accepted span lies in a stretch
of text around such characters: the tokens that hold one, the token before and after, and
tokens that follow with a dot between.  All windows that meet such a stretch are decoded, so
an accepted span is seen whole; what other windows could decode wouldn't pass the check.

Defined results: a null or empty text has no spans; positions are code points, ends are
exclusive; repeated rows are judged alike; an empty table gives no rows; other columns
pass ``redact`` unchanged.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Span = tuple[str, int, int]
KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
WINDOW, STRIDE, HIDDEN = 64, 32, 12
#: Texts that are looked at together, and windows that are decoded at once.
TEXTS, MOST_ROWS = 128, 1024

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@\[(]")
_PLAIN = r"[^\s0-9@\[(]"
#: A token with an anchor, the one before it, the one after it, and those that follow with a dot between, one space apart.
_STRETCH = re.compile(rf"(?<!\S)(?:{_PLAIN}++ )?{_PLAIN}*+[0-9@\[(]\S*+(?: {_PLAIN}++(?!\S))?(?: (?:(?<=\. )|(?=\.)){_PLAIN}++(?!\S))*+")
_NO_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local@domain in linear time: a match's local part ends at an @ that a domain follows."""
    last = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        floor = max(last, text.rfind("@", last, start) + 1)
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            last = m.end()
            yield "email", start, last


def base_spans(text: str | None) -> list[Span]:
    """The rules' spans, by kind and then start; matches that fail their check are dropped without another try."""
    if not text or not _ANCHOR.search(text):
        return []
    found = list(_emails(text)) if "@" in text else []
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 and not x[:-3].strip("0") for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return found


_MODEL_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]+(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]+)+")
_MODEL_IP = re.compile(r"[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}")
_MODEL_CARD = re.compile(r"[0-9](?:[ ./-]{0,2}[0-9])+")
_MODEL_PHONE = re.compile(r"(?:\+|00|\()?[0-9](?:[ ()./-]{0,2}[0-9])+")


def plausible(kind: str, piece: str) -> bool:
    """The exact check of a span that the model adds."""
    digits = _NO_DIGIT.sub("", piece)
    if kind == "email":
        return _MODEL_EMAIL.fullmatch(piece) is not None
    if kind == "ip":
        return _MODEL_IP.fullmatch(piece) is not None and all(int(x) <= 255 for x in re.findall("[0-9]+", piece))
    if kind == "card":
        return _MODEL_CARD.fullmatch(piece) is not None and 13 <= len(digits) <= 19 and luhn(digits)
    return _MODEL_PHONE.fullmatch(piece) is not None and 9 <= len(digits) <= 15 and piece != digits


# ---- characters -------------------------------------------------------------------------------

_KNOWN = "0123456789abcdefghijklmnopqrstuvwxyz@.[]()+-_%/:,#= \n"
CLASSES = len(_KNOWN) + 2  # any other character, and the padding after a text's end
_CLASS = np.zeros(128, np.uint8)
for _i, _c in enumerate(_KNOWN):
    _CLASS[ord(_c)] = _CLASS[ord(_c.upper())] = _i + 1
PAD = CLASSES - 1


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CLASS[np.minimum(points, 127)], 0).astype(np.uint8)


# ---- model ------------------------------------------------------------------------------------

Params = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (rows, time, HIDDEN) for classes (rows, time)."""
    rows, time = x.shape
    h = np.zeros((rows, HIDDEN), np.float32)
    c = np.zeros_like(h)
    out = np.empty((rows, time, HIDDEN), np.float32)
    for t in range(time):
        z = wx[x[:, t]] + h @ wh
        gates, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        before, h_before = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[:, t] = h
        if keep is not None:
            keep.append((i, f, o, g, before, tc, h_before))
    return out


def _lstm_back(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, keep: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d_z = np.empty((*x.shape, 4 * HIDDEN), np.float32)
    d_wh = np.zeros_like(wh)
    dh = np.zeros_like(d_out[:, 0])
    dc = np.zeros_like(dh)
    for t in range(x.shape[1] - 1, -1, -1):
        i, f, o, g, before, tc, h_before = keep[t]
        dh = dh + d_out[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        d_z[:, t] = dz
        d_wh += h_before.T @ dz
        dh, dc = dz @ wh.T, dc * f
    one_hot = np.zeros((x.size, len(wx)), np.float32)
    one_hot[np.arange(x.size), x.reshape(-1)] = 1
    return one_hot.T @ d_z.reshape(x.size, -1), d_wh


def emissions(p: Params, x: np.ndarray) -> np.ndarray:
    hidden = np.concatenate([_lstm(x, p["wx_f"], p["wh_f"]), _lstm(x[:, ::-1], p["wx_b"], p["wh_b"])[:, ::-1]], 2)
    return hidden @ p["wo"] + p["bo"]


def _allowed() -> np.ndarray:
    """Which tag may follow which: inside only after begin or inside of its kind."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        ok[:, inside] = False
        ok[[inside - 1, inside], inside] = True
    return ok


ALLOWED = _allowed()


def _transitions(p: Params) -> np.ndarray:
    return np.where(ALLOWED, p["a"], -1e4).astype(np.float32)


def _sum_log(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def _crf_gradient(e: np.ndarray, a: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(mean negative log-likelihood, its gradients by emissions and transitions)."""
    rows, time, _ = e.shape
    forward, backward = np.empty_like(e), np.zeros_like(e)
    forward[:, 0] = e[:, 0]
    for t in range(1, time):
        forward[:, t] = e[:, t] + _sum_log(forward[:, t - 1, :, None] + a, 1)
    for t in range(time - 2, -1, -1):
        backward[:, t] = _sum_log(a + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
    whole = _sum_log(forward[:, -1], 1)
    d_e = np.exp(forward + backward - whole[:, None, None])
    d_a = np.zeros_like(a)
    for t in range(1, time):
        d_a += np.exp(forward[:, t - 1, :, None] + a + (e[:, t] + backward[:, t])[:, None, :] - whole[:, None, None]).sum(0)
    r = np.arange(rows)[:, None]
    gold = e[r, np.arange(time), y].sum() + a[y[:, :-1], y[:, 1:]].sum()
    d_e[r, np.arange(time), y] -= 1
    np.add.at(d_a, (y[:, :-1], y[:, 1:]), -1)
    return float(whole.sum() - gold) / rows, d_e / rows, d_a / rows


def train(x: np.ndarray, y: np.ndarray, steps: int = 360, batch: int = 96, rate: float = 0.02, seed: int = 7) -> Params:
    """Fit to labelled windows (classes, tags) with Adam."""
    rng = np.random.default_rng(seed)
    scale = lambda *s: (rng.standard_normal(s) * 0.25).astype(np.float32)
    p: Params = {"wx_f": scale(CLASSES, 4 * HIDDEN), "wh_f": scale(HIDDEN, 4 * HIDDEN), "wx_b": scale(CLASSES, 4 * HIDDEN), "wh_b": scale(HIDDEN, 4 * HIDDEN)}
    p |= {"wo": scale(2 * HIDDEN, TAGS), "bo": np.zeros(TAGS, np.float32), "a": np.zeros((TAGS, TAGS), np.float32)}
    m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        own = rng.integers(0, len(x), batch)
        xs, ys = x[own], y[own]
        kept_f: list = []
        kept_b: list = []
        hidden = np.concatenate([_lstm(xs, p["wx_f"], p["wh_f"], kept_f), _lstm(xs[:, ::-1], p["wx_b"], p["wh_b"], kept_b)[:, ::-1]], 2)
        _, d_e, d_a = _crf_gradient(hidden @ p["wo"] + p["bo"], _transitions(p), ys)
        flat = d_e.reshape(-1, TAGS)
        d_hidden = d_e @ p["wo"].T
        g = {"wo": hidden.reshape(-1, 2 * HIDDEN).T @ flat, "bo": flat.sum(0), "a": np.where(ALLOWED, d_a, 0)}
        g["wx_f"], g["wh_f"] = _lstm_back(xs, p["wx_f"], p["wh_f"], kept_f, d_hidden[:, :, :HIDDEN])
        g["wx_b"], g["wh_b"] = _lstm_back(xs[:, ::-1], p["wx_b"], p["wh_b"], kept_b, d_hidden[:, ::-1, HIDDEN:])
        size = max(1.0, float(np.sqrt(sum((w * w).sum() for w in g.values()))) / 5)
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k] / size
            v[k] = 0.99 * v[k] + 0.01 * (g[k] / size) ** 2
            p[k] = (p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p


def viterbi(e: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Best tags of each window."""
    rows, time, _ = e.shape
    best = e[:, 0].copy()
    came = np.empty((rows, time, TAGS), np.int8)
    for t in range(1, time):
        score = best[:, :, None] + a
        came[:, t] = score.argmax(1)
        best = score.max(1) + e[:, t]
    tags = np.empty((rows, time), np.int8)
    tags[:, -1] = best.argmax(1)
    r = np.arange(rows)
    for t in range(time - 1, 0, -1):
        tags[:, t - 1] = came[r, t, tags[:, t]]
    return tags


# ---- labelled spans ---------------------------------------------------------------------------

def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, start, end in spans:
        out[start:end] = 2 + 2 * KINDS.index(kind)
        out[start] -= 1
    return out


def windows_of(labelled: list[tuple[str, list[Span]]]) -> tuple[np.ndarray, np.ndarray]:
    """Training windows of labelled texts; those cut inside a span keep the part they see."""
    xs, ys = [], []
    for text, spans in labelled:
        classes, tags = classes_of(text), tags_of(len(text), spans)
        for s in range(0, max(1, len(text) - STRIDE), STRIDE):
            x, y = np.full(WINDOW, PAD, np.uint8), np.zeros(WINDOW, np.int64)
            part = tags[s : s + WINDOW].copy()
            if len(part) and part[0] and part[0] % 2 == 0:
                part[0] -= 1
            x[: len(part)], y[: len(part)] = classes[s : s + WINDOW], part
            xs.append(x)
            ys.append(y)
    return np.array(xs), np.array(ys)


def make_labelled(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Texts with labelled spans in plain and disguised forms, among words, prices, dates, versions and numbers that are no personal data."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    syllables = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "sch", "ung", "le", "ou", "ción", "é", "ü")
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))
    name = lambda: "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(int(rng.integers(2, 9)))) + pick(("", "", digits(2)))

    def email() -> str:
        at, dot = pick((("@", "."), ("@", "."), (" [at] ", " [dot] "), ("[at]", "."), (" (at) ", " (dot) "), (" (at) ", ".")))
        return name() + pick(("", "." + name(), "_" + name(), "+" + name())) + at + name() + dot + pick(("com", "org", "net", "example", "de", "co"))

    def ip() -> str:
        return pick((".", ".", "[.]")).join(str(x) for x in rng.integers(0, 256, 4))

    def card() -> str:
        body = pick("3456") + digits(14)
        number = next(body + d for d in "0123456789" if luhn(body + d))
        return pick(("", " ", "-", ".", " - ")).join(number[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick((f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits(2)} {a} {b}{c}", f"+1-{a}-{b}-{c}", f"0{a}/{b}{c}"))

    def decoy() -> str:
        return pick((
            f"{digits(2)}.{digits(2)}.20{digits(2)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(3)},{digits(3)}", f"${digits(2)}.{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(2)}", digits(int(rng.integers(1, 9))),
            f"(see {digits(1)})", f"[{digits(2)}]", f"{digits(2)}:{digits(2)}", f"#{digits(6)}", f"{digits(2)}%", f"({word()} {word()})", f"@{name()}", f"{digits(3)}-{digits(2)}", f'= "{name()}{digits(9)}{name()}"', digits(12), f"{digits(4)}-{digits(4)}",
        ))

    makers = dict(zip(KINDS, (email, ip, card, phone), strict=True))
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(int(rng.integers(10, 24))):
            text += pick((" ", " ", " ", " ", "\n", ": ", ", ")) if text else ""
            roll = rng.random()
            if roll < 0.12:
                kind = pick(KINDS)
                piece = makers[kind]()
                spans.append((kind, len(text), len(text) + len(piece)))
                text += piece
            else:
                text += decoy() if roll < 0.24 else pick((word(), word(), word().capitalize(), word() + "."))
        out.append((text, spans))
    return out


@lru_cache(maxsize=2)
def default_model(seed: int = 7) -> Params:
    return train(*windows_of(make_labelled(1200, seed)))


# ---- whole texts ------------------------------------------------------------------------------

def _starts(text: str) -> list[int]:
    """Where the windows begin that meet a stretch around a character that every kind needs."""
    found: set[int] = set()
    for m in _STRETCH.finditer(text):
        found.update(range(max(0, m.start() // STRIDE - 1), (m.end() - 1) // STRIDE + 1))
    return [k * STRIDE for k in sorted(found)]


def _pieces(tags: np.ndarray, e: np.ndarray, origin: int, length: int) -> list[tuple[float, int, int, int, bool]]:
    """(score, kind, start, end, cut at an inner edge) of one window's spans."""
    out, t, time = [], 0, min(WINDOW, length - origin)
    while t < time:
        if tags[t] == 0:
            t += 1
            continue
        kind, start = (int(tags[t]) - 1) // 2, t
        t += 1
        while t < time and tags[t] == 2 + 2 * kind:
            t += 1
        own = e[start:t]
        score = float((own[:, [1 + 2 * kind, 2 + 2 * kind]].max(1) - own[:, 0]).sum())
        out.append((score, kind, origin + start, origin + t, (start == 0 and origin > 0) or (t == time and origin + t < length)))
    return out


def reconcile(pieces: list[tuple[float, int, int, int, bool]]) -> list[tuple[int, int, int]]:
    """(kind, start, end): cut pieces of one kind that overlap are joined; then the non-overlapping set with the highest total score."""
    joined: list[list] = []
    for score, kind, start, end, cut in sorted(pieces, key=lambda x: (x[1], x[2], x[3])):
        last = joined[-1] if joined else None
        if last and last[1] == kind and start < last[3] and (cut or last[4]):
            last[0], last[3], last[4] = max(last[0], score), max(last[3], end), last[4] and cut
        else:
            joined.append([score, kind, start, end, cut])
    spans = sorted({(k, s, e): c for c, k, s, e, _ in joined}.items(), key=lambda x: (x[0][2], x[0][1], x[0][0]))
    ends = [s[0][2] for s in spans]
    best: list[tuple[float, int, bool]] = [(0.0, -1, False)]
    for i, ((_, start, _), score) in enumerate(spans):
        before = bisect_right(ends, start, 0, i)
        taken = best[before][0] + max(score, 0.0)
        best.append((taken, before, True) if taken > best[i][0] else (best[i][0], i, False))
    out, i = [], len(spans)
    while i > 0:
        _, before, taken = best[i]
        if taken:
            out.append(spans[i - 1][0])
        i = before
    return out[::-1]


def find_spans(texts: list[str | None], model: Params) -> list[tuple[list[Span], list[Span]]]:
    """(spans of the rules, all spans) of each text, ordered by kind and start."""
    base = [base_spans(t) for t in texts]
    jobs = [(i, s) for i, t in enumerate(texts) if t for s in _starts(t)]
    pieces: dict[int, list] = {}
    a = _transitions(model)
    classes: dict[int, np.ndarray] = {}
    for first in range(0, len(jobs), MOST_ROWS):
        part = jobs[first : first + MOST_ROWS]
        x = np.full((len(part), WINDOW), PAD, np.uint8)
        for r, (i, s) in enumerate(part):
            if i not in classes:
                classes = {i: classes_of(texts[i])}
            own = classes[i][s : s + WINDOW]
            x[r, : len(own)] = own
        e = emissions(model, x)
        tags = viterbi(e, a)
        for r in np.flatnonzero(tags.any(1)):
            i, s = part[r]
            pieces.setdefault(i, []).extend(_pieces(tags[r], e[r], s, len(texts[i])))
    out = []
    for i, text in enumerate(texts):
        added: list[Span] = []
        for k, start, end in reconcile(pieces.get(i, [])):
            while start < end and text[start] in " \n,:;.-/":
                start += 1
            while end > start and text[end - 1] in " \n,:;.-/":
                end -= 1
            if plausible(KINDS[k], text[start:end]) and not any(s < end and start < e for _, s, e in base[i]):
                added.append((KINDS[k], start, end))
        out.append((base[i], sorted(base[i] + added, key=lambda s: (KINDS.index(s[0]), s[1]))))
    return out


def told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def detect(docs: DataFrame, model: Params | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the rules), base_sha256, spans, n_added."""
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, TEXTS) for i in range(0, batch.num_rows, TEXTS)):
                found = find_spans(part.column(1).to_pylist(), shared.value)
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                digests = pa.array([hashlib.sha256(told(base).encode()).hexdigest() for base, _ in found], pa.string())
                added = pa.array([len(spans) - len(base) for base, spans in found], pa.int64())
                yield pa.record_batch([part.column(0), *counts, digests, pa.array([told(x) for _, x in found], pa.string()), added], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {kinds}, base_sha256 string, spans string, n_added long")


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with [EMAIL], [IP], [CARD] or [PHONE] for each span; overlapping spans become one of the first's kind."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Params | None = None) -> DataFrame:
    """``docs`` with masked spans in text."""
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())

    @F.arrow_udf("string")
    def mask(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = []
            for i in range(0, len(batch), TEXTS):
                texts = batch.slice(i, TEXTS).to_pylist()
                parts.append(pa.array([masked(t, spans) if spans else t for t, (_, spans) in zip(texts, find_spans(texts, shared.value), strict=True)], pa.string()))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return docs.withColumn("text", mask("text"))
