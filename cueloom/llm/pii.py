"""Personal data in texts (operator 8).

Base spans come from fixed rules for e-mail and IP addresses, card and phone numbers; failing matches are dropped without
another try. A character-level BiLSTM-CRF adds spans in forms that the rules don't cover, such as phone numbers without a
country code, spelled-out addresses and cards grouped with dots. It is trained in numpy on generated snippets whose spans
are known, with a fixed seed, once in a driver process. The whole text is tagged in overlapping windows, whatever is in
it. Each window's spans are candidates; of all candidates of a text those that overlap neither each other nor a base span
and weigh most together are kept, if they have the form or enough digits of their kind and start and end between words.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Overlapping base spans of different kinds all
stay. ``redact`` replaces spans, overlapping ones together under the first one's kind.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .char_crf import Tagger
from .common import documents, per_text

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, BATCH = 320, 256, 512
TRAIN_ROWS, TRAIN_STEPS, TRAIN_LENGTH = 2500, 600, 72

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@+]")
_ADDRESS = re.compile(r"[^\s@()\[\]]+(?:(?:@|\s?\(at\)\s?|\s?\[at\]\s?)[^\W_][\w-]*(?:\.[\w-]+)+|\sat\s[^\W_][\w-]*(?:\.[\w-]+)*(?:\sdot\s[a-z]{2,6})+)", re.IGNORECASE)
_DIGITS = re.compile(r"[^0-9]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The rules' spans, by kind and start."""
    if not _MARK.search(text):
        return []
    out: list[Span] = []
    at = done = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((0, start, m.end()))
            at = done = m.end()
        else:
            at += 1
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _DIGITS.sub("", m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15]
    return out


# --- The model ------------------------------------------------------------------------------------------------------

_PUNCTUATION = "@.-+_%()[]:,/='\"\n"
_CLASSES = 7 + len(_PUNCTUATION)


def _class_table() -> np.ndarray:
    """Class of each code point below 128: 1 space, 2 and 3 small and capital letters, 4 digits, 5 others, 6 the letters of
    "at" and "dot", from 7 on single characters. Others are 2, as letters of any script are."""
    out = np.full(128, 5, dtype=np.int64)
    out[32] = 1
    out[97:123], out[65:91], out[48:58] = 2, 3, 4
    for c in "atdo":
        out[ord(c)] = 6
    for i, c in enumerate(_PUNCTUATION):
        out[ord(c)] = 7 + i
    return out


_TABLE = _class_table()


def char_classes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(c < 128, _TABLE[np.minimum(c, 127)], 2)


def _snippets(rows: int, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Generated snippets as classes, and their tags: 0 outside, 1 + 2k first and 2 + 2k further characters of kind k. Some
    are cut out of longer text, some begin it and some end it. A column stands before a snippet, with the character before it,
    or filling where a text begins, and one of filling after it."""
    r = np.random.default_rng(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    pick = lambda s: s[int(r.integers(len(s)))]
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    word = lambda: (lambda w: w.capitalize() if r.random() < 0.15 else w)("".join(letters[i] for i in r.integers(0, 26, int(r.integers(1, 11)))))

    def email() -> str:
        name = pick([word().lower(), f"{word().lower()}.{digits(2)}", f"{word().lower()}{digits(2)}", f"{word().lower()}_{word().lower()}", f"{word().lower()}.{word().lower()}"])
        host, top = pick([word().lower(), word().lower(), f"mail{digits(1)}.{word().lower()}"]), pick(["com", "org", "net", "de"])
        at = pick(["@", " (at) ", "(at)", "[at]", " [at] ", " at ", " at ", " at "])
        return f"{name} at {host} dot {top}" if at == " at " else f"{name}{at}{host}.{top}"

    def ip() -> str:
        return ".".join(str(int(r.integers(0, 256))) for _ in range(4))

    def card() -> str:
        return pick(["", " ", "-", ".", "."]).join(digits(4) for _ in range(4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"])

    def other() -> str:
        hexes = "".join(pick("0123456789abcdef") for _ in range(int(r.integers(8, 40))))
        return pick([f'token = "{hexes}"', f"password={hexes[:18]}", "AKIA" + "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), digits(int(r.integers(1, 9))), f"{digits(1)}.{digits(1)}", f"version {digits(1)}.{digits(1)}.{digits(1)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"({digits(4)})", f"CC-{digits(1)}.{digits(1)}", f"{digits(3)},{digits(3)}", f"{word()} at {word()}"])

    kinds = (email, ip, card, phone)
    x, y = np.zeros((rows, length + 2), dtype=np.int64), np.zeros((rows, length + 2), dtype=np.int64)
    for i in range(rows):
        text, tags, over, ends = "", [], 0, r.random() < 0.4
        most = int(r.integers(length // 2, length)) if ends else length + 30
        while len(text) < most:
            u = r.random()
            k = pick((0, 0, 0, 1, 2, 3, 3, 3)) if u < 0.16 else -1
            piece = kinds[k]() if k >= 0 else other() if u < 0.25 else word()
            gap = pick([" ", " ", " ", " ", ", ", ". ", "\n"])
            if len(text) + len(piece) >= most and ends:  # the last of a text is as often personal data as not
                if r.random() < 0.5:
                    k = pick((0, 0, 0, 1, 2, 3, 3, 3))
                    piece = kinds[k]()
                gap = pick(["", "", ".", "\n"])
                over, most = max(0, len(text) + len(piece) + len(gap) - length), 0
            text += piece + gap
            tags += ([0] * len(piece) if k < 0 else [1 + 2 * k] + [2 + 2 * k] * (len(piece) - 1)) + [0] * len(gap)
        at = over if ends else int(r.integers(1, 30)) if r.random() < 0.6 else 0
        text, tags = (text[at - 1 : at + length], tags[at - 1 : at + length]) if at else (" " + text[:length], [0, *tags[:length]])
        x[i, : len(text)], y[i, : len(text)] = char_classes(text), tags
        if not at:
            x[i, 0] = 0
        elif tags[0]:  # a span that the window's start cut begins there
            y[i, 0] = tags[0] - 1 + tags[0] % 2
    return x, y


_trained: dict[int, Tagger] = {}


def trained(seed: int = 11) -> Tagger:
    """The tagger, trained once in a process."""
    if seed not in _trained:
        model = Tagger(_CLASSES, 1 + 2 * len(KINDS))
        model.fit(*_snippets(TRAIN_ROWS, TRAIN_LENGTH, seed), TRAIN_STEPS)
        _trained[seed] = model
    return _trained[seed]


def window_starts(text: str) -> list[int]:
    """Starts of overlapping windows that cover the text."""
    return list(range(0, max(1, len(text) - WINDOW + STRIDE), STRIDE))


def _window_spans(row: np.ndarray, start: int, n: int) -> list[Span]:
    """Spans of one window's tags, but for those that the window's ends may have cut; the text has ``n`` characters."""
    spans: list[Span] = []
    for j in np.flatnonzero(row).tolist():
        k, more = divmod(int(row[j]) - 1, 2)
        if not more:
            spans.append((k, start + j, start + j + 1))
        elif spans and spans[-1][0] == k and spans[-1][2] == start + j:
            spans[-1] = k, spans[-1][1], start + j + 1
    return [s for s in spans if (s[1] > start or not start) and (s[2] < start + WINDOW or s[2] == n) and s[2] <= n]


def reconciled(spans: dict[Span, float]) -> list[Span]:
    """Of spans with weights, those without overlap that weigh most together."""
    order = sorted(spans, key=lambda s: (s[2], s[1], s[0]))
    ends, best, chosen = [s[2] for s in order], [0.0], []
    for s in order:
        before = bisect_right(ends, s[1])
        weight = best[before] + spans[s]
        chosen.append((weight > best[-1], before))
        best.append(max(best[-1], weight))
    out, i = [], len(order)
    while i:
        taken, before = chosen[i - 1]
        if taken:
            out.append(order[i - 1])
        i = before if taken else i - 1
    return out[::-1]


def model_spans(texts: list[str], model: Tagger, base: list[list[Span]]) -> list[list[Span]]:
    """The tagger's spans of each text. All windows of the whole texts are decoded; a span weighs one for each window that
    gives it, and more the further it is from that window's ends, and the spans that weigh most together stand. Base spans
    stand before all others."""
    places = [(i, s) for i, t in enumerate(texts) for s in (window_starts(t) if t else ())]
    places.sort(key=lambda p: min(len(texts[p[0]]) - p[1], WINDOW))  # windows of a block are of like length
    classes = [char_classes(t) for t in texts]
    found: dict[int, dict[Span, float]] = {}
    for a in range(0, len(places), BATCH):
        block = places[a : a + BATCH]
        i, s = block[-1]
        x = np.zeros((len(block), min(len(texts[i]) - s, WINDOW) + 2), dtype=np.int64)
        for k, (i, s) in enumerate(block):
            c = classes[i][max(s - 1, 0) : s + WINDOW]
            x[k, not s : len(c) + (not s)] = c
        tags = model.decode(x)[:, 1:]
        for k in np.flatnonzero(tags.any(axis=1)).tolist():
            i, s = block[k]
            mine = found.setdefault(i, {})
            for span in _window_spans(tags[k], s, len(texts[i])):
                weight = 1 + min(span[1] - s, s + WINDOW - span[2], WINDOW - STRIDE) / WINDOW
                span = _trimmed(texts[i], span)
                if _plausible(texts[i], span):
                    mine[span] = mine.get(span, 0.0) + weight
    out: list[list[Span]] = [[] for _ in texts]
    for i, mine in found.items():
        own = sorted((b[1], b[2]) for b in base[i])
        starts, upto = [b[0] for b in own], list(accumulate((b[1] for b in own), max, initial=0))
        out[i] = reconciled({s: w for s, w in mine.items() if upto[bisect_left(starts, s[2])] <= s[1]})
    return out


def _trimmed(text: str, span: Span) -> Span:
    """An address without what the model took along around it."""
    k, start, end = span
    m = _ADDRESS.search(text, start, end) if k == 0 else None
    return (k, *m.span()) if m else span


def _plausible(text: str, span: Span) -> bool:
    k, start, end = span
    body = text[start:end]
    if (start and text[start - 1].isalnum() and body[0].isalnum()) or (end < len(text) and text[end].isalnum()) or body != body.strip():
        return False
    n = len(_DIGITS.sub("", body))
    letters = any(c.isalpha() for c in body)
    if k == 0:
        return bool(_ADDRESS.fullmatch(body)) and letters
    if letters:
        return False
    return body.count(".") == 3 and n >= 4 if k == 1 else 13 <= n <= 19 and luhn(_DIGITS.sub("", body)) if k == 2 else 9 <= n <= 15


def find_spans(texts: list[str], model: Tagger) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans, and base spans with the model's, of each text, by kind and start."""
    base = [base_spans(t) for t in texts]
    every = []
    for own, more in zip(base, model_spans(texts, model, base), strict=True):
        every.append(sorted(own + more))
    return base, every


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _with_spans(df: DataFrame, outputs: str, made: Callable[[list[str], list, list], dict], text: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(trained())

    def run(texts: list) -> dict:
        return made(texts, *find_spans([t or "" for t in texts], shared.value))

    return per_text(df, lambda: run, outputs, text, raw=False)


def personal_data(df: DataFrame, text: str = "text") -> DataFrame:
    """Appends the number of base spans of each kind, their digest, and all spans as text."""

    def made(texts: list[str], base: list, every: list) -> dict:
        counts = {f"n_{kind}": [sum(s[0] == k for s in b) for b in base] for k, kind in enumerate(KINDS)}
        return counts | {"base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b in base], "spans": [joined(s) for s in every]}

    return _with_spans(df, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", made, text)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces each span in the text by its kind in brackets; a null text stays null."""
    out = _with_spans(df, f"{text} string", lambda texts, base, every: {text: [None if t is None else redacted(t, s) for t, s in zip(texts, every, strict=True)]}, text)
    return out.select(*df.columns)


def op8_pii(spark, sf_dir):
    return personal_data(documents(spark, sf_dir, "doc_id", "text")).drop("text")
