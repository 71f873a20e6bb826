"""Language identification by hierarchical discrimination (operator 10).

First a linear support vector machine for each language family says which family a text belongs to, then one-versus-one
machines separate the languages within it; the most votes win, ties by the sum of margins. Features are hashed counts of
one to three bytes of the lower-cased text, everything but letters taken as a space, damped by a square root and scaled
to unit length. The machines minimise the squared hinge loss by accelerated gradient steps in numpy.

Learning uses at most about ``per_language`` rows a language, drawn by a hash of the id over the whole table, so the
model's size and the driver's share don't grow with the input. A language that the family table doesn't name is a family
of its own. A text that is null or has no letter is ``und`` with score 0, as is every text if there is nothing to learn
from. Equal texts have equal predictions. Null ids count as held out.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, per_text

PER_LANGUAGE = 500
DIMENSIONS = 4096

#: Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky",
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
_LETTER = regex.compile(r"\p{L}")


def _byte_classes() -> np.ndarray:
    out = np.zeros(256, dtype=np.uint32)
    for b in range(256):
        c = b + 32 if 65 <= b <= 90 else b
        out[b] = c if c >= 128 or 97 <= c <= 122 else 32
    return out


_CLASS = _byte_classes()


def features(texts: list[bytes], dims: int = DIMENSIONS) -> np.ndarray:
    """A row of unit length for each text (float32)."""
    n = len(texts)
    out = np.zeros((n, dims), dtype=np.float32)
    joined = b"   ".join(texts) + b"   "
    c = _CLASS[np.frombuffer(joined, dtype=np.uint8)]
    ends = np.cumsum([len(t) + 3 for t in texts])
    shift = np.uint32(32 - dims.bit_length() + 1)
    two = c[:-2] * np.uint32(257) + c[1:-1]
    codes = [c[:-2] * np.uint32(0x9E3779B1), two * np.uint32(0x85EBCA77) + np.uint32(1), (two * np.uint32(263) + c[2:]) * np.uint32(0xC2B2AE3D) + np.uint32(2)]
    for code in codes:
        code >>= shift
    start = 0
    for i, end in enumerate(ends.tolist()):
        stop = min(end - 3, len(c) - 2)
        row = np.zeros(dims, dtype=np.int64)
        for code in codes:
            row += np.bincount(code[start:stop], minlength=dims)
        out[i] = np.sqrt(row)
        start = end
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-9)


def _largest_singular(x: np.ndarray, weight: np.ndarray, rounds: int = 30) -> float:
    """About the largest singular value of the weighted rows, by power iteration."""
    v = np.ones(x.shape[1], dtype=np.float32)
    for _ in range(rounds):
        v = x.T @ (weight * (x @ v))
        norm = float(np.linalg.norm(v))
        v /= norm or 1.0
    return norm**0.5


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> np.ndarray:
    """Weights and, last, the bias of a linear machine with squared hinge loss; y is +1 or -1. Classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    y = y.astype(np.float32)
    weight = (np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c * len(y) / 100).astype(np.float32)
    w = v = np.zeros(x.shape[1], dtype=np.float32)
    rate = np.float32(1 / (1 + 2.1 * _largest_singular(x, weight) ** 2))
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        after = v - rate * (v - 2 * (x.T @ (weight * y * slack)))
        v = after + np.float32(k / (k + 3)) * (after - w)
        w = after
    return w


class Hierarchy:
    """Families first, languages of the family next."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.languages = sorted(set(langs))
        y = np.array(langs)
        family = np.array([_FAMILY.get(z, f"own:{z}") for z in langs])
        self.families = sorted(set(family))
        self.members = {f: sorted(set(y[family == f])) for f in self.families}
        self.top = np.array([fit_svm(x, np.where(family == f, 1.0, -1.0)) for f in self.families], dtype=np.float32) if len(self.families) > 1 else None
        self.pairs = {}
        for f, members in self.members.items():
            for i, a in enumerate(members):
                for b in members[i + 1 :]:
                    rows = (y == a) | (y == b)
                    self.pairs[f, a, b] = fit_svm(x[rows], np.where(y[rows] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[list[str], list[float]]:
        if self.top is None:
            family, sure = np.zeros(len(x), dtype=int), np.full(len(x), 4.0)
        else:
            margins = (x @ self.top[:, :-1].T + self.top[:, -1]).astype(np.float64)
            family = margins.argmax(axis=1)
            ranked = np.sort(margins, axis=1)
            sure = ranked[:, -1] - ranked[:, -2]
        langs = np.empty(len(x), dtype=object)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(family == k)
            members = self.members[f]
            votes, total = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for i, a in enumerate(members):
                for j in range(i + 1, len(members)):
                    w = self.pairs[f, a, members[j]]
                    m = x[rows] @ w[:-1] + w[-1]
                    votes[:, i] += m >= 0
                    votes[:, j] += m < 0
                    total[:, i] += m
                    total[:, j] -= m
            best = (votes * 1e6 + total).argmax(axis=1)
            langs[rows] = np.array(members, dtype=object)[best]
            if len(members) > 1:
                sure[rows] = np.minimum(sure[rows], 2 * total[np.arange(len(rows)), best] / (len(members) - 1))
        return langs.tolist(), (1 / (1 + np.exp(-2 * sure))).round(6).tolist()


def has_letter(text: str) -> bool:
    return bool(_LETTER.search(text))


def learn(rows: DataFrame, per_language: int = PER_LANGUAGE, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Hierarchy | None:
    """A model from the rows that have a language and an id. One pass counts all languages, one computes the features of the
    drawn rows on the executors; the driver gets at most about ``per_language`` feature rows a language."""
    rows = rows.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(doc_id, lang, text)
    whole = 1 << 30
    place = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(whole))
    counts = rows.groupBy(F.col(lang).alias("_lang")).agg(F.count("*").alias("_n"))
    drawn = rows.join(F.broadcast(counts), F.col(lang) == F.col("_lang")).where(place < F.expr(f"{whole * per_language}L div _n")).select(doc_id, lang, text)
    drawn = per_text(drawn, lambda: lambda texts: {"x": [r.tobytes() for r in features(texts)], "ok": [has_letter(t.decode("utf-8", "replace")) for t in texts]}, "x binary, ok boolean", text, drop_text=True)
    got = sorted((r[0], r[1], bytes(r[2])) for r in drawn.where("ok").select(doc_id, lang, "x").collect())
    if not got:
        return None
    return Hierarchy(np.frombuffer(b"".join(r[2] for r in got), dtype=np.float32).reshape(len(got), -1), [r[1] for r in got])


def identify(df: DataFrame, model: Hierarchy | None, text: str = "text", lang_pred: str = "lang_pred", score: str = "score", letter: str | None = None) -> DataFrame:
    """Appends the predicted language and its score, and if ``letter`` names a column, whether the text has a letter: ``und``
    is also what texts get without a model, and can be a language's label. Columns of these names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> dict:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and has_letter(t)]
        if rows and shared.value is not None:
            got = shared.value.predict(features([texts[i].encode() for i in rows]))
            for i, a, s in zip(rows, *got, strict=True):
                langs[i], scores[i] = a, s
        found = set(rows)
        return {lang_pred: langs, score: scores} | ({letter: [i in found for i in range(len(texts))]} if letter else {})

    return per_text(df, lambda: run, f"`{lang_pred}` string, `{score}` double" + (f", `{letter}` boolean" if letter else ""), text, raw=False)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def op10_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = learn(docs.where(~held_out()))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
