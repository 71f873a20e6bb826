"""Toxicity by compression distance (operator 6).

Two zstandard dictionaries are trained on labelled text: one on windows of ordinary texts, one on what toxic texts share, that
is on the words, once a text, that at least ``SHARED_BY`` toxic texts and no ordinary text of the sample have. (On
whole toxic windows the trainer picks ordinary wording, which is most of a toxic text, too.) A text is cut into windows of
whole words. A window's distance is its compressed length with the ordinary dictionary less that with both together, so
ordinary wording costs the same on either side and only toxic wording is shorter.

Two thresholds are calibrated on labelled texts kept apart from the dictionaries: a window counts from a distance of ``near``
on, and a text's statistic is the number of such windows over the root of the number of all plus ``PRIOR``; from ``limit`` on
the text is toxic. The pair that gets most labels right stands, both classes weighing as among the labels; the score is a
logistic function of the statistic that is 0.5 at ``limit``, its slope fitted on the same texts.

The method finds wording, not meaning. Null and empty texts score as one empty window. With fewer than four labelled rows of
either class every score is the share of toxic labels, or 0 without labels; so it is if no word is shared. Equal texts have
equal scores, repeated rows too; very long texts are scored whole. Null ids count as held out.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, per_text

#: Labelled rows that are learned from at most, by class. Of a longer text, so many characters of it are learned from, in
#: ``SAMPLE_PARTS`` parts at even distances; and so many windows of ordinary texts, at even distances too.
TOXIC_ROWS, ORDINARY_ROWS, SAMPLE_CHARS, SAMPLE_PARTS, SAMPLE_WINDOWS = 2000, 5000, 20_000, 10, 300_000
WINDOW, ORDINARY_BYTES, TOXIC_BYTES = 32, 60_000, 2048
LEVEL, SHARED_BY, PRIOR, SEGMENT = 3, 4, 4, 100
#: Distances that are tried as a window's threshold.
NEAR = range(1, 11)

_WINDOWS = re.compile(rb"(?s).{1,%d}(?=\s|$)|.{1,%d}" % (WINDOW, WINDOW))
_WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]{3,}")


def windows(text: str) -> list[bytes]:
    """Consecutive windows of the lower-cased text that end at white space where they can."""
    return _WINDOWS.findall(text.lower().encode()) or [b""]


class Distances:
    """Compression distances of windows; compressors are made anew in each process."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.contents = ordinary, ordinary + toxic
        self.memory: tuple | None = None

    def __getstate__(self):
        return {"contents": self.contents, "memory": None}

    def compressors(self):
        if self.memory is None:
            made = []
            for content in self.contents:
                d = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                p = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(content), source_size=2 * WINDOW, write_content_size=0, write_dict_id=0, write_checksum=0, min_match=4)
                d.precompute_compress(compression_params=p)
                made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress)
            self.memory = tuple(made)
        return self.memory

    def of(self, text: str) -> np.ndarray:
        ordinary, toxic = self.compressors()
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)])


def trained(samples: list[bytes], size: int, k: int) -> bytes:
    """The content of a dictionary that zstandard trains; of too few samples to train on, their own content."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def statistic(distances: np.ndarray, near: int) -> float:
    return float((distances >= near).sum() / np.sqrt(len(distances) + PRIOR))


class Model:
    def __init__(self, rows: list[tuple[str, int]]):
        toxic, ordinary = [t for t, y in rows if y], [t for t, y in rows if not y]
        self.share = len(toxic) / len(rows) if rows else 0.0
        self.slope = None
        if len(toxic) < 4 or len(ordinary) < 4:
            return
        cut_t, cut_o = len(toxic) * 3 // 5, len(ordinary) * 3 // 5
        seen = set()
        for t in ordinary[:cut_o]:
            seen.update(_WORD.findall(t.lower().encode()))
        words = [[w for w in dict.fromkeys(_WORD.findall(t.lower().encode())) if w not in seen] for t in toxic[:cut_t]]
        shared = Counter(w for found in words for w in found)
        least = min(SHARED_BY, max(2, cut_t // 50))
        wording = [b" " + w + b" " for found in words for w in found if shared[w] >= least]
        if not wording:
            return
        plain = [w for t in ordinary[:cut_o] for w in windows(t)]
        plain = plain[:: -(-len(plain) // SAMPLE_WINDOWS)]
        self.distances = Distances(trained(plain, ORDINARY_BYTES, 32), trained(wording, TOXIC_BYTES, SEGMENT))
        self._calibrate([*map(self.distances.of, toxic[cut_t:])], [*map(self.distances.of, ordinary[cut_o : cut_o + 2 * len(toxic)])])

    def _calibrate(self, toxic: list[np.ndarray], ordinary: list[np.ndarray]) -> None:
        y = np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
        weight = np.where(y > 0, self.share / len(toxic), (1 - self.share) / max(1, len(ordinary)))
        best = (-1.0,)
        for near in NEAR:
            s = np.array([statistic(g, near) for g in (*toxic, *ordinary)])
            steps = np.unique(s)
            for low, high in zip(steps[:-1], steps[1:]):
                right = float(weight[(s >= high) == (y > 0)].sum())
                best = max(best, (round(right, 9), high - low, -near, float(low + high) / 2))
        if len(best) == 1:  # all texts look alike
            return
        self.near, self.limit = -best[2], best[3]
        x = np.array([statistic(g, self.near) for g in (*toxic, *ordinary)]) - self.limit
        slope = 1.0
        for _ in range(50):  # Newton steps with a slight prior that keeps separable classes finite
            p = 1 / (1 + np.exp(-np.clip(slope * x, -30, 30)))
            slope += ((weight * (y - p) * x).sum() - 1e-3 * slope) / ((weight * p * (1 - p) * x * x).sum() + 1e-3)
            slope = min(max(slope, 0.1), 100.0)
        self.slope = float(slope)

    def score(self, text: str) -> float:
        if self.slope is None:
            return self.share
        x = self.slope * (statistic(self.distances.of(text), self.near) - self.limit)
        return round(float(1 / (1 + np.exp(-np.clip(x, -30, 30)))), 6)


def sampled(text: Column, most: int = SAMPLE_CHARS, parts: int = SAMPLE_PARTS) -> Column:
    """The text, or of a longer one so many characters in parts at even distances."""
    size = most // parts
    starts = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: (1 + i * F.floor((F.length(text) - size) / (parts - 1))).cast("int"))
    return F.when(F.length(text) > most, F.array_join(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))), " ")).otherwise(text)


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Model:
    """A model from a bounded sample of the labelled rows, drawn by a hash of the id."""
    labels = labels.select(doc_id, F.col(label).cast("int").alias("_y")).where(F.col(doc_id).isNotNull() & F.col("_y").isin(0, 1))
    rank = F.xxhash64(F.col(doc_id), F.lit(6))
    ids = [labels.where(F.col("_y") == y).orderBy(rank, doc_id).limit(n) for y, n in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS))]
    rows = docs.where(F.col(text).isNotNull()).select(doc_id, sampled(F.col(text)).alias("_text")).join(F.broadcast(ids[0].union(ids[1])), doc_id)
    got = sorted(((r[0], r[1], r[2]) for r in rows.select(rank, "_text", "_y").collect()), key=lambda r: (r[0], r[1], r[2]))
    return Model([(r[1], r[2]) for r in got])


def toxicity(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Appends ``score`` and ``predicted``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> dict:
        scores = [shared.value.score(t or "") for t in texts]
        return {"score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    return per_text(df, lambda: run, "score double, predicted int", text, raw=False)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op6_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out())
    return toxicity(docs, learn(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
