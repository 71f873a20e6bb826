"""Translators, and the recovery around them.

A translator maps a list of texts to a list of texts. It must give the same answer when asked again, as Spark may run a
task twice. It may fail or answer with another number of rows: failures are retried with growing waits, a wrong number is
met by halving the batch, and a single row's answer is joined to one text. ``settings`` are those of ``plans.settings``.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import size_batches

Translator = Callable[[list[str]], list[str]]

RETRIES, WAIT_S, QUEUE_OVER, CONCURRENCY = 3, 0.5, 24, 6
#: Signs besides letters and digits that percent-encoding leaves as they are.
UNRESERVED = "-_.!~*'()"


def stand_in(texts: list[str]) -> list[str]:
    """Upper-cases; a translator for tests and examples without a network."""
    return [t.upper() for t in texts]


def decoded_answer(body: str) -> list[str]:
    """Rows of a service's JSON answer: a nested array, a flat array, or an object with sentences."""
    answer = json.loads(body)
    if isinstance(answer, dict) and isinstance(answer.get("sentences"), list):
        whole = "".join((s or {}).get("trans") or "" for s in answer["sentences"])
    elif isinstance(answer, list) and answer and isinstance(answer[0], list):
        whole = "".join((s[0] if s else None) or "" for s in answer[0])
    elif isinstance(answer, list):
        whole = "".join(str(s) for s in answer if s is not None)
    else:
        raise ValueError("an answer of unknown form")
    return whole.split("\r")


def with_retries(translate: Translator, texts: list[str], retries: int = RETRIES, wait: float = WAIT_S, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    for left in range(retries, -1, -1):
        try:
            return translate(texts)
        except Exception:
            if not left:
                raise
            sleep(wait)
            wait *= 2
    raise AssertionError


def recovered(translate: Translator, texts: list[str], **options) -> list[str]:
    """As many rows as were given."""
    got = with_retries(translate, texts, **options)
    if len(got) == len(texts):
        return got
    if len(texts) <= 1:
        return ["".join(got)] * len(texts)
    half = -(-len(texts) // 2)
    return recovered(translate, texts[:half], **options) + recovered(translate, texts[half:], **options)


def scheduled(jobs: list[Callable[[], list[str]]], most: int | None) -> list[list[str]]:
    """Results of all jobs in their order, at most ``most`` running at once, or all together."""
    if len(jobs) <= 1 or most == 1:
        return [job() for job in jobs]
    with ThreadPoolExecutor(max_workers=min(most or len(jobs), len(jobs))) as pool:
        return list(pool.map(lambda job: job(), jobs))


def batches_of(mode: str, texts: list[str], settings) -> list[list[str]]:
    """Consecutive texts by encoded size for automatic captions, by number for others."""
    if mode != "automatic":
        return [texts[i : i + settings.batch_rows] for i in range(0, len(texts), settings.batch_rows)]
    step = size_batches(settings.max_encoded_length, len(quote("\r")))
    out: list[list[str]] = []
    for t in texts:
        if step(len(quote(t, safe=UNRESERVED, errors="surrogatepass"))) == len(out):
            out.append([])
        out[-1].append(t)
    return out


def translated_track(mode: str, texts: list[str], translate: Translator, settings, **options) -> list[str]:
    """A translation for each text of a track, an empty one where there is none. Batches beyond ``queue_over`` wait for one
    another, fewer go together. If the batches' answers don't make up the track, each text is sent on its own."""
    options = {"retries": settings.retries, "wait": settings.wait_s} | options
    bound = lambda n: in_flight(n, settings.queue_over, settings.concurrency)
    rows = [[t] for t in texts]
    parts = rows if settings.method == "Row" else batches_of(mode, texts, settings)
    got = [x for part in scheduled([partial(recovered, translate, p, **options) for p in parts], bound(len(parts))) for x in part]
    if len(got) != len(texts):
        got = [x[0] for x in scheduled([partial(recovered, translate, p, **options) for p in rows], bound(len(rows)))]
    return [t or "" for t in got]


def translated_texts(mode: Column, texts: Column, translate: Translator, settings) -> Column:
    """Translations of an array of a track's texts; null texts have none, and a track has none whose translator still fails
    after all retries. A track's batches meet in one task, the way its cues do; tracks run in as many tasks as Spark gives
    them. The function counts as nondeterministic, so that no optimisation asks a translator twice."""

    def run(modes: pa.Array, rows: pa.Array) -> pa.Array:
        out = []
        for m, x in zip(modes.to_pylist(), rows.to_pylist(), strict=True):
            if x is not None:
                try:
                    answers = iter(translated_track(m, [t for t in x if t is not None], translate, settings))
                    x = [None if t is None else next(answers) for t in x]
                except Exception:  # whatever a translator raises: its track stays as it is, others go on
                    x = None
            out.append(x)
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>").asNondeterministic()(mode, texts)


def translate_batches(batches: DataFrame, translate: Translator, texts: str = "texts", output: str = "translations", concurrency: int | None = None, by_row: bool = False) -> DataFrame:
    """Appends the translations of an array column, a batch a row. ``concurrency`` bounds the requests in flight by the number
    of partitions; ``by_row`` sends each text on its own."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            made = [None if x is None else [y for t in x for y in recovered(translate, [t])] if by_row else recovered(translate, x) for x in b.column(texts).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.string()))], names=[*b.schema.names, output])

    if concurrency:
        batches = batches.repartition(concurrency)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batches.schema.fields)
    return batches.mapInArrow(run, f"{fields}, {output} array<string>")


def in_flight(n_batches: int, threshold: int = QUEUE_OVER, most: int = CONCURRENCY) -> int | None:
    """Concurrency bound: none up to the threshold, then ``most``."""
    return most if n_batches > threshold else None
