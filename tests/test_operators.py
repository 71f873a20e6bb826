"""Caption operators against literal fixtures and plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from cueloom.functions.text import BLANK
from cueloom.operators import merging, ordered, segmentation, state
from cueloom.sources.translators import decoded_answer, in_flight, recovered, with_retries

CUES = "track_id string, pos int, start_ms long, dur_ms long, text string"


def width(s):
    return sum(2 if segmentation._WIDE.match(c) else 1 for c in s)


def test_split_golden():
    assert segmentation.split_text("This is a very long automatic caption, and it should be divided at a natural boundary before it overlaps.") == ["This is a very long automatic caption,", "and it should be divided at a natural", "boundary before it overlaps."]
    assert [width(p) for p in segmentation.split_text("가" * 24)] == [40, 8]
    assert segmentation.split_text("  ") == [] and segmentation.split_text(None) == [] and segmentation.split_text(BLANK) == [BLANK]


def test_split_invariants():
    r = random.Random(1)
    for _ in range(400):
        s = "".join(r.choice("ab ,.가😀　-") for _ in range(r.randint(0, 200)))
        parts = segmentation.split_text(s)
        squeeze = lambda x: "".join(c for c in x if c not in segmentation._SPACES)
        assert squeeze("".join(parts)) == squeeze(s)
        assert all(0 < width(p) <= 40 for p in parts)


@pytest.mark.parametrize("seed", range(3))
def test_next_start_in_document_order(spark, seed):
    r = random.Random(seed)
    rows = [(f"t{k}", i, r.choice([None, r.randint(0, 20)]), 5, "x") for k in range(4) for i in range(30)]
    want = {}
    for t, i, s, *_ in rows:
        later = [x[2] for x in rows if x[0] == t and x[1] > i and x[2] is not None and (s is None or x[2] > s)]
        want[t, i] = later[0] if later else None
    got = {(x.track_id, x.pos): x.next_ms for x in ordered.next_start(spark.createDataFrame(rows, CUES)).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_next_start_of_shared_positions(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(12)]), r.choice([None, *range(20)]), 5, "x") for _ in range(90)]
    want = {}
    for t, i in {x[:2] for x in rows}:
        here = min((x[2] for x in rows if x[:2] == (t, i) and x[2] is not None), default=99)
        later = [(x[1], -x[2]) for x in rows if None not in x[:3] and i is not None and x[0] == t and x[1] > i and x[2] > here]
        want[t, i] = -min(later)[1] if later else None
    got = ordered.next_start_by_position(spark.createDataFrame(rows, CUES)).collect()
    assert {(x.track_id, x.pos): x.next_ms for x in got} == want and len(got) == len(want)


def test_split_cues_golden(spark):
    rows = [("a", 0, 1000, 9000, "This is a very long automatic caption, and it should be divided at a natural boundary before it overlaps."), ("a", 1, 8500, 2000, "Next caption."), ("b", 0, None, None, "x" * 100), ("c", 0, 0, 2, "word " * 20)]
    parts = segmentation.split_cues(spark.createDataFrame(rows, CUES))
    got = sorted((x.track_id, x.pos, x.part_no, x.start_ms, x.dur_ms) for x in parts.where("track_id <> 'b'").collect())
    assert got[:4] == [("a", 0, 0, 1000, 2767), ("a", 0, 1, 3767, 2694), ("a", 0, 2, 6461, 2039), ("a", 1, 0, 8500, 2000)]
    assert all(x[4] >= 1 for x in got if x[0] == "c")
    counts = {x.track_id: tuple(x)[1:] for x in segmentation.split_counters(parts).collect()}
    assert counts["a"] == (2, 4, 1, 1) and counts["b"] == (1, 1, 0, 0)


def test_batches(spark):
    rows = [("a", i, 0, 0, "x" * n) for i, n in enumerate([10, 5, 30, 3, 3, 3])]
    df = ordered.size_bounded_batches(spark.createDataFrame(rows, CUES), F.length("text").cast("long"), limit=20)
    assert [x.batch_no for x in df.orderBy("pos").collect()] == [0, 0, 1, 2, 2, 2]
    fixed = ordered.fixed_batches(spark.createDataFrame([("a", i, 0, 0, "") for i in range(121)], CUES))
    assert {x.batch_no: x["count"] for x in fixed.groupBy("batch_no").count().collect()} == {0: 120, 1: 1}


def test_merging(spark):
    df = spark.createDataFrame([("A & B", "x<y"), ("a", " "), (BLANK, "b"), ("", "b"), (None, "b"), ("a", None)], "o string, t string")
    one = lambda **k: [r[0] for r in df.select(merging.bilingual(F.col("o"), F.col("t"), **k)).collect()]
    assert one() == ["A &amp; B&#x000A;x&lt;y", "a", None, None, None, "a"]
    assert one(position="Reverse")[0] == "x&lt;y&#x000A;A &amp; B"
    assert one(translation_only=True)[:2] == ["x&lt;y", "a"]


def test_translator_recovery():
    calls = []

    def drops(texts):
        calls.append(len(texts))
        return [t.upper() for t in texts][len(texts) > 3 :]

    assert recovered(drops, list("abcdefghij")) == list("ABCDEFGHIJ")
    assert calls[0] == 10
    assert recovered(lambda t: ["x", "y"], ["a"]) == ["xy"]
    waits, left = [], [2]

    def flaky(texts):
        if left[0]:
            left[0] -= 1
            raise OSError
        return texts

    assert with_retries(flaky, ["a"], sleep=waits.append) == ["a"] and waits == [0.5, 1.0]
    with pytest.raises(OSError):
        with_retries(lambda t: (_ for _ in ()).throw(OSError()), ["a"], sleep=waits.append)
    assert waits[2:] == [0.5, 1.0, 2.0]
    assert decoded_answer('[[["a\\r","s"],["b","s"]],null,"ko"]') == ["a", "b"] == decoded_answer('["a\\r","b"]') == decoded_answer('{"sentences":[{"trans":"a\\rb"}]}')
    assert in_flight(24) is None and in_flight(25) == 6


def test_state(spark):
    df = spark.createDataFrame([(i, f"k{i % 4}", f"v{i}" if i % 3 else None) for i in range(10)], "i int, k string, v string")
    assert [(x.k, x.first_seen) for x in state.bounded_cache(df, "k", "v", "i", 2).collect()] == [("k3", 3), ("k2", 2)]
    want = [None, "v1", "v2", "v2", "v4", "v5", "v5", "v7", "v8", "v8"]
    assert [x[1] for x in df.select("i", state.sticky("v", "i", F.lit(1))).orderBy("i").collect()] == want
    for ranges in (1, 3, 200):
        got = state.sticky_over_all(df.repartition(3), "v", "i", "last", ranges).orderBy("i").collect()
        assert [x["last"] for x in got] == want and got[0].asDict().keys() == {"i", "k", "v", "last"}
