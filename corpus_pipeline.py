"""A corpus pipeline of five stages; each works on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the shared folder and read
again as the next one's ``docs``. All but the last return the columns of ``documents``, with whatever columns ``docs`` has
besides. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cueloom.llm import bpe, language_id, mixing, ngram_join, pii
from cueloom.llm.common import fresh, stored

#: A label is replaced where the prediction differs and its score is at least this.
RELABEL = 0.98
#: Parts of a class of near duplicates, where there are too many classes to broadcast a line each.
SALTS = 64


def quoted(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects, and sets ``lang`` by it: where it is null, to the prediction, and
    where it says otherwise with a score of at least ``RELABEL``, too.

    Rejected are null texts and texts without a letter, empty ones among them. Without labels to learn from, nothing else is
    rejected and ``lang`` stays. Very long texts are read whole. Repeated rows get the same prediction and all stay; an
    empty table stays empty. Further columns pass on, whatever their names; ties are those of ``language_id``."""
    model = language_id.learn(docs.where(~language_id.held_out()))
    pred, score, letter = (fresh(docs.columns, n) for n in ("_pred", "_score", "_letter"))
    out = language_id.identify(docs, model, lang_pred=pred, score=score, letter=letter).where(F.col(letter))
    known = F.lit(model is not None) & (F.col("lang").isNull() | (F.col(score) >= RELABEL))
    return out.withColumn("lang", F.when(known, F.col(pred)).otherwise(F.col("lang"))).select(*quoted(docs))


def _with_class(pairs: DataFrame, best: DataFrame) -> DataFrame:
    """Joins a class's one line to its pairs. A class may hold a third of all pairs, and so may those without one: up to a
    fixed number the lines are broadcast, beyond it they are repeated for each of ``SALTS`` parts of a class."""
    if best.count() <= ngram_join.BROADCAST_SETS:
        return pairs.join(F.broadcast(best), "class_id", "left")
    salted = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    some = pairs.where("class_id is not null").withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SALTS)).cast("int"))
    some = some.join(salted, ["class_id", "salt"], "left").drop("salt")
    return some.unionByName(pairs.where("class_id is null"), allowMissingColumns=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates: that of least id, and of different texts with one id, that with
    the least hash of the text. Of rows repeated with one id and text, one stays, whatever their other columns.

    Null and empty texts and texts without words are in no class with others and stay, but for repeated rows. Null ids come
    after all others. Different texts with one id that aren't near duplicates all stay. Very long texts count whole; an
    empty table stays empty. Further columns pass on, whatever their names. Only ids that go or repeat are joined to the
    documents. Up to a fixed number they are broadcast, so no text is shuffled; beyond it, the join shuffles."""
    mark = F.xxhash64("text")
    found = stored(ngram_join.near_duplicates(docs, mark=mark, details=True), "classes")
    pairs = found.groupBy("doc_id", "mark").agg(F.count("*").alias("rows"), F.max("class_id").alias("class_id"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    best = pairs.where("class_id is not null").groupBy("class_id").agg(F.count("*").alias("pairs"), F.min(order).alias("best")).where("pairs > 1")
    judged = _with_class(pairs, stored(best.select("class_id", "best"), "best")).withColumn("kept", F.col("best").isNull() | order.eqNullSafe(F.col("best")))
    ids = stored(judged.where("not kept or rows > 1").select("doc_id", "mark", "kept"), "ids")
    near = F.broadcast if ids.count() <= ngram_join.BROADCAST_SETS else lambda x: x
    key, other, kept, place = (fresh(docs.columns, n) for n in ("_mark", "_id", "_kept", "_place"))
    marked = docs.withColumn(key, mark)
    ids = ids.select(F.col("doc_id").alias(other), F.col("mark").alias(f"{key}2"), F.col("kept").alias(kept))
    same = F.col("doc_id").eqNullSafe(F.col(other)) & (F.col(key) == F.col(f"{key}2"))
    once = marked.join(near(ids.where(F.col(kept))), same, "left_semi")
    once = once.withColumn(place, F.row_number().over(W.partitionBy("doc_id", key).orderBy("text"))).where(F.col(place) == 1)
    return marked.join(near(ids), same, "left_anti").select(*quoted(docs)).unionByName(once.select(*quoted(docs)))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind, and brings ``n_chars`` up to date.

    All rows stay, repeated ones alike. A null text stays null and keeps its ``n_chars``; an empty one stays empty. Very long
    texts are read whole. Overlapping spans go together under the kind of the first. An empty table stays empty; further
    columns pass on, whatever their names."""
    length = F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return pii.redact(docs).withColumn("n_chars", length).select(*quoted(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats rows so that sources reach their weights; every source comes once as a whole, none more than 1.5 times.

    Null sources are one source. Null and empty texts have no tokens and come along with the passes that cover them; very
    long ones are taken or left whole. Rows of one id, and null ids, are taken or left together; ties in the order of rows
    are broken by the id. An empty table stays empty; further columns pass on, whatever their names."""
    return mixing.mix(docs, details=False)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their decoding, as digests, a row for each row of ``docs``.

    Null texts count as empty and have no tokens; very long ones are encoded whole. Repeated rows have equal digests; ties
    between merges go to the leftmost pair. An empty table gives none; columns other than the id, source and text are left
    out, so none can clash."""
    return bpe.round_trip(docs.select("doc_id", "source", "text")).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("encoding", encoding)]

#: Learned models and tokenisation have no SQL form; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
