"""Licence scans by the Dice coefficient of word bigrams (operator 7). Only DataFrame functions run.

A text is normalised (lower case, all but a-z and 0-9 taken as one space) to a sequence of words, and windows of it are
compared with licence templates: notices, headers, short licences and the openings of long ones. A window is as long as its
template, shorter at a text's end, and may start at any word, so a notice is found inside a line, across lines and in a text's
middle, whichever of its words are missing.

Bounds that lose no window prune first. A window that reaches the threshold shares at least ``least`` bigrams with its template
(two thirds of them for 0.8), so it has one of some words that occur in more bigrams than may be missing; a text with none of
these words isn't normalised. A text is compared with a template if it has so many of its bigrams, at the starts from which a
window reaches so many.

The score is ``2 |A & B| / (|A| + |B|)`` of the sets of bigrams. A template's key words are its ``KEYS`` longest words of at
least ``KEY_LENGTH`` letters; a window is keyed if one of them stands in it where it does in the template. Matching keyed windows
that overlap, directly or through others, are one place, of which the best score counts, then the longer template, the licence's
name, the earlier start. Other matching windows that touch no keyed one, or hold a whole one, are taken in that order, best first, unless they
overlap one taken before; those that touch none are places of their own. A result row is a document and a licence with the number of its places and the best
score. ``scan`` reports keyed places unless told to look ``everywhere``, as the query does; the query's SQL knows keyed ones only.

Templates travel in the plan. A text's windows are made inside its row; what is shuffled are matches. A run of overlapping
windows that aren't keyed is one row, and picking from it takes time by its windows times its places. Null and empty texts have
none. Rows of one id are reported together, equal ones once; null ids are one id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents
from .license_texts import TEXTS

THRESHOLD, KEYS, KEY_LENGTH = 0.8, 3, 6

#: Words that many texts have. The first filter takes others where it can; results don't depend on it.
COMMON = frozenset("a an and any are as at be by can for from has if in is it may more most must not of on or other out see shall such that the this to under was will with work you your".split())

#: A template: its licence, words and distinct bigrams.
Template = tuple[str, list[str], list[str]]


def words_of(text: str) -> list[str]:
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()


def templates_of(texts: dict[str, tuple[str, ...]]) -> list[Template]:
    made = [(name, words_of(t)) for name in sorted(texts) for t in texts[name]]
    return [(name, words, sorted({f"{a} {b}" for a, b in zip(words, words[1:])})) for name, words in made]


def key_words(words: list[str]) -> list[str]:
    return sorted({w for w in words if len(w) >= KEY_LENGTH}, key=lambda w: (-len(w), w))[:KEYS]


def anchors_of(templates: list[Template]) -> dict[str, list[tuple[int, int]]]:
    """For each key word the templates that have it, by their place in the list, and where."""
    out: dict[str, list[tuple[int, int]]] = {}
    for i, (_, words, _) in enumerate(templates):
        for key in key_words(words):
            out.setdefault(key, []).extend((i, at) for at, w in enumerate(words) if w == key)
    return dict(sorted(out.items()))


def least_shared(size: int, threshold: float) -> int:
    """How many bigrams a window must share with a template of ``size`` bigrams to reach the threshold: it has these at least."""
    return next(x for x in range(1, size + 1) if 2.0 * x / (x + size) >= threshold)


def covering_words(template: Template, threshold: float) -> list[str]:
    """Words of which every window that reaches the threshold has one: without them, too few bigrams are left."""
    _, words, grams = template
    least, left, out = least_shared(len(grams), threshold), [set(g.split()) for g in grams], []
    for word in sorted(set(words), key=lambda w: (w in COMMON, -len(w), w)):
        if len(left) < least:
            break
        out.append(word)
        left = [g for g in left if word not in g]
    return out


def word_pattern(words: set[str]) -> str:
    """One of the words, by first letter."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(words):
        by_first.setdefault(w[0], []).append(w[1:])
    return f"(?<![a-z0-9])(?:{'|'.join(f'{c}(?:{"|".join(rest)})' for c, rest in by_first.items())})(?![a-z0-9])"


def bigrams(words: Column) -> Column:
    """Bigrams of an array of words in order."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def _once(df: DataFrame, value: Column, name: str, *kept: str) -> DataFrame:
    """A generator's output is computed once, however often it is used after."""
    return df.select(*kept, F.explode(F.array(value)).alias(name))


def _matches(df: DataFrame, threshold: float, templates: list[Template], text: str, doc_id: str) -> DataFrame:
    """All windows that reach the threshold: (doc_id, mark, start, end, score, license, size, keyed)."""
    templates = [t for t in templates if t[2]]
    keys = "array<struct<at:int,word:string>>"
    about = F.array(
        *(
            F.struct(
                F.lit(name).alias("license"),
                F.lit(len(words)).alias("n"),
                F.lit(len(grams)).alias("size"),
                F.lit(least_shared(len(grams), threshold)).alias("least"),
                F.array(*map(F.lit, grams)).alias("grams"),
                F.array(*(F.struct(F.lit(at).alias("at"), F.lit(w).alias("word")) for at, w in enumerate(words) if w in key_words(words))).cast(keys).alias("keys"),
            )
            for name, words, grams in templates
        )
    )
    vocabulary = sorted({g for _, _, grams in templates for g in grams})
    filtering = word_pattern({w for t in templates for w in covering_words(t, threshold)})

    docs = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"), F.lower(F.col(text)).alias("text"))
    docs = docs.where(F.col("text").rlike(filtering))
    docs = _once(docs, F.split(F.trim(F.regexp_replace("text", "[^a-z0-9]+", " ")), " "), "words", "doc_id", "mark")
    docs = _once(docs, bigrams(F.col("words")), "grams", "doc_id", "mark", "words")
    hits = F.filter(F.transform("grams", lambda g, i: F.when(g.isin(vocabulary), F.struct(i.alias("i"), g.alias("gram")))), lambda h: h.isNotNull())
    docs = _once(docs, hits, "hits", "doc_id", "mark", "words", "grams")
    docs = _once(docs, F.array_distinct("hits.gram"), "known", "doc_id", "mark", "words", "grams", "hits")
    near = F.filter(about, lambda t: F.size(F.array_intersect(F.col("known"), t["grams"])) >= t["least"])
    found = docs.select("doc_id", "mark", "words", "grams", "hits", F.explode(near).alias("t"))
    at = F.transform(F.filter("hits", lambda h: F.array_contains(F.col("t.grams"), h["gram"])), lambda h: h["i"])
    found = _once(found, at, "at", "doc_id", "mark", "words", "grams", "t")

    def starts(j: Column) -> Column:
        """Starts of windows whose first shared bigram is the j-th and that reach ``least`` of them."""
        low = F.greatest(F.lit(0), F.coalesce(F.get("at", j - 1) + 1, F.lit(0)), F.get("at", j + F.col("t.least") - 1) - F.col("t.n") + 2)
        high = F.get("at", j)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    def scored(start: Column) -> Column:
        grams = F.slice("grams", start + 1, F.col("t.n") - 1)
        score = 2.0 * F.size(F.array_intersect(grams, F.col("t.grams"))) / (F.size(F.array_distinct(grams)) + F.col("t.size"))
        return F.struct(start.alias("start"), score.alias("score"))

    def described(w: Column) -> Column:
        keyed = F.exists("t.keys", lambda k: F.coalesce(F.get("words", w["start"] + k["at"]) == k["word"], F.lit(False)))
        return F.struct(w["start"].alias("start"), F.least(w["start"] + F.col("t.n"), F.size("words")).alias("end"), w["score"].alias("score"), keyed.alias("keyed"))

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("t.least")), starts))
    windows = F.transform(F.filter(F.transform(every, scored), lambda w: w["score"] >= threshold), described)
    found = found.select("doc_id", "mark", "t.license", "t.size", F.explode(windows).alias("w"))
    return found.select("doc_id", "mark", "w.start", "w.end", "w.score", "license", "size", "w.keyed").distinct()


def _picked(windows: Column) -> Column:
    """Of windows in order, best first, those that overlap none taken before."""
    nothing = F.slice(windows, 1, 0)
    return F.aggregate(windows, nothing, lambda taken, w: F.when(F.exists(taken, lambda t: (t["start"] < w["end"]) & (t["end"] > w["start"])), taken).otherwise(F.concat(taken, F.array(w))))


def scan(df: DataFrame, threshold: float = THRESHOLD, texts: dict[str, tuple[str, ...]] | None = None, text: str = "text", doc_id: str = "doc_id", everywhere: bool = False) -> DataFrame:
    """(doc_id, license, n_units, best_score) of all texts with a match, at key words or ``everywhere``."""
    found = _matches(df, threshold, templates_of(texts or TEXTS), text, doc_id)
    keyed = lambda c: F.when(F.col("keyed"), F.col(c))
    if everywhere:
        by_start = W.partitionBy("doc_id", "mark").orderBy("start")
        up_to, from_here = by_start.rangeBetween(W.unboundedPreceding, W.currentRow), by_start.rangeBetween(W.currentRow, W.unboundedFollowing)
        touches = (F.max(keyed("end")).over(up_to) > F.col("start")) | (F.min(keyed("start")).over(from_here) < F.col("end"))
        holds = F.min(keyed("end")).over(from_here) <= F.col("end")
        found = found.withColumns({"free": ~F.coalesce(touches, F.lit(False)), "holds": F.coalesce(holds, F.lit(False))}).where("keyed OR free OR holds")
    else:
        found = found.where("keyed").withColumn("free", F.lit(False))
    # runs of windows that overlap, keyed ones and others apart
    order = W.partitionBy("doc_id", "mark", "keyed").orderBy("start", "end")
    fresh = F.col("start") >= F.coalesce(F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = found.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(order.rangeBetween(W.unboundedPreceding, W.currentRow)))
    window = F.struct((-F.col("score")).alias("score"), (-F.col("size")).alias("size"), "license", "start", "end", "free")
    runs = placed.groupBy("doc_id", "mark", "keyed", "run").agg(F.min(window).alias("best"), F.sort_array(F.collect_list(F.when(~F.col("keyed"), window))).alias("others"))
    places = F.when(F.col("keyed"), F.array("best")).otherwise(F.filter(_picked(F.col("others")), lambda w: w["free"]))
    best = runs.select("doc_id", F.explode(places).alias("best"))
    return best.groupBy("doc_id", F.col("best.license").alias("license")).agg(F.count("*").alias("n_units"), F.round(F.max(-F.col("best.score")), 6).alias("best_score"))


def op7_license_scan(spark, sf_dir):
    return scan(documents(spark, sf_dir, "doc_id", "text"), everywhere=True)


def _oracle() -> str:
    templates = templates_of(TEXTS)
    rows = ", ".join("({}, '{}', {}, [{}])".format(i, name, len(words), ", ".join(f"'{g}'" for g in grams)) for i, (name, words, grams) in enumerate(templates))
    keys = ", ".join(f"('{key}', {i}, {at})" for key, found in anchors_of(templates).items() for i, at in found)
    return f"""
WITH t(t, license, n, tg) AS (VALUES {rows}), k(word, t, offs) AS (VALUES {keys}),
d AS (SELECT row_number() OVER () AS u, doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM (SELECT DISTINCT doc_id, text FROM documents) WHERE regexp_matches(lower(text), '{"|".join(anchors_of(templates))}')),
p AS (SELECT u, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM d),
s AS (SELECT DISTINCT u, t, i - offs AS start FROM p JOIN k USING (word) WHERE i >= offs),
w AS (SELECT s.*, doc_id, license, len(tg) AS size, tg, list_slice(words, start + 1, start + n) AS ws FROM s JOIN d USING (u) JOIN t USING (t)),
g AS (SELECT *, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS grams, start + len(ws) AS stop FROM w WHERE len(ws) > 1),
c AS (SELECT DISTINCT u, doc_id, license, size, start, stop, 2.0 * len(list_intersect(grams, tg)) / (len(grams) + size) AS score FROM g WHERE len(grams) >= size * {THRESHOLD} / (2 - {THRESHOLD}) AND len(grams) <= size * (2 - {THRESHOLD}) / {THRESHOLD}),
m AS (SELECT *, CASE WHEN start >= coalesce(max(stop) OVER (PARTITION BY u ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 1 ELSE 0 END AS fresh FROM c WHERE score >= {THRESHOLD}),
q AS (SELECT *, sum(fresh) OVER (PARTITION BY u ORDER BY start, stop RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place FROM m),
b AS (SELECT *, row_number() OVER (PARTITION BY u, place ORDER BY score DESC, size DESC, license, start) AS r FROM q)
SELECT doc_id, license, count(*) AS n_units, round(max(score), 6) AS best_score FROM b WHERE r = 1 GROUP BY doc_id, license"""


ORACLE = _oracle()
