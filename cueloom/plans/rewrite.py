"""The flagship plan: caption documents in, bilingual caption documents out.

A document is one row from scan to sink, so the plan has no shuffle, no join and needs no ids: rows with null or repeated ids
are documents of their own. Parsing, merging and writing are built-in expressions; timing and cutting, which need all cues of
a document in order, and translation are one Arrow function each. A document that isn't timed text comes out unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import tracks, urls
from ..operators import merging
from ..operators.pacing import paced_cues
from ..sources import srv3
from ..sources.translators import Translator, stand_in, translated_texts
from .settings import Settings

#: What the response says about itself.
VERSION, ORIGIN, UNCHANGED = "23", "standalone", "unchanged"
AUTOMATIC_MODE, BROADCAST_MODE = "fixed-two-lines-split-long-cues", "fixed-two-lines-no-roll-up"


def parsed(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds ``_gaps`` and ``_cues`` (null if the body isn't timed text) and ``_mode`` to (url, body)."""
    df = documents.withColumn("_clean", srv3.cleaned(F.col("body")))
    df = df.withColumn("_cues", srv3.cues(F.col("_clean")))
    roll_up = tracks.has_roll_up(srv3.has_window(F.col("_clean")), F.col("_cues"), lambda c: srv3.has_attribute(c, "w") | srv3.has_attribute(c, "a"))
    broadcast = tracks.is_broadcast_name(urls.query_value(F.col("url"), "name")) | roll_up
    df = df.withColumn("_mode", tracks.caption_mode(urls.is_automatic(F.col("url")), broadcast))
    clean = srv3.with_positions(F.col("_clean"), settings.least_rows)
    return df.withColumn("_gaps", srv3.gaps(F.when(F.col("_mode") == "official", clean).otherwise(srv3.without_windows(clean)))).drop("_clean")


def paced_parts(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds ``_parts``, the document's cues after the rules of its mode."""
    starts = F.transform("_cues", lambda c: X.leading_integer(srv3.attribute(c, "t"), True))
    durations = F.transform("_cues", lambda c: X.leading_integer(srv3.attribute(c, "d")))
    return df.withColumn("_parts", paced_cues(F.col("_mode"), starts, durations, F.col("_cues.text"), settings.max_width))


def headers(mode: Column, original: Column, modified: Column, prefix: str = "X-Captions") -> Column:
    """The seven response headers as a map."""
    values = {
        "Version": F.lit(VERSION),
        "Settings": F.lit(ORIGIN),
        "ASR-Mode": F.when(mode == "automatic", AUTOMATIC_MODE).otherwise(UNCHANGED),
        "Broadcast-Mode": F.when(mode == "broadcast", BROADCAST_MODE).otherwise(UNCHANGED),
        "Caption-Mode": mode,
        "XML-Original-Length": original.cast("string"),
        "XML-Modified-Length": modified.cast("string"),
    }
    return F.when(mode.isNotNull(), F.create_map(*(x for k, v in values.items() for x in (F.lit(f"{prefix}-{k}"), v))))


def rewrite(documents: DataFrame, translate: Translator = stand_in, settings: Settings = Settings()) -> DataFrame:
    """(track_id, url, body) to (track_id, url, body, caption_mode, original_len, modified_len, cues, headers)."""
    df = paced_parts(parsed(documents, settings), settings)
    df = df.withColumn("_translations", translated_texts(F.col("_mode"), F.col("_parts.text"), translate, settings))
    rolled = F.col("_mode") != "official"
    dropped = F.when(rolled, F.array(F.lit("w"), F.lit("a"))).otherwise(F.array().cast("array<string>"))

    def element(x: Column) -> Column:
        part, cue = x["part"], F.get("_cues", x["part"]["pos"])
        both = merging.bilingual(part["text"], x["translation"], settings.position, settings.translation_only)
        content = F.when(cue["segmented"], F.concat(F.lit("<s>"), both, F.lit("</s>"))).otherwise(both)
        content = F.coalesce(F.concat(content, cue["others"]), cue["raw"])  # a cue without text stays as it is
        times = {"t": (part["start_ms"], X.leading_integer(srv3.attribute(cue, "t"), True)), "d": (part["dur_ms"], X.leading_integer(srv3.attribute(cue, "d")))}
        changed = {k: F.when(~new.eqNullSafe(old), new.cast("string")) for k, (new, old) in times.items()}
        made = F.when(part["text"].isNull(), cue["raw"]).otherwise(srv3.cue_element(cue, changed, dropped, content))
        return F.concat(F.when(part["part_no"] == 0, F.get("_gaps", part["pos"])).otherwise(""), made)

    pairs = F.arrays_zip(F.col("_parts").alias("part"), F.col("_translations").alias("translation"))
    body = srv3.written(F.concat(F.array_join(F.transform(pairs, element), ""), F.element_at("_gaps", -1)))
    out = df.withColumn("_made", body).withColumn("caption_mode", F.when(F.col("_made").isNotNull(), F.col("_mode")))
    modified = F.coalesce("_made", "body")
    out = out.select("track_id", "url", modified.alias("body"), "caption_mode", X.utf16_length(F.col("body")).alias("original_len"), X.utf16_length(modified).alias("modified_len"), F.coalesce(F.size(F.filter("_parts", lambda p: p["text"].isNotNull())), F.lit(0)).cast("long").alias("cues"))
    return out.withColumn("headers", headers(F.col("caption_mode"), F.col("original_len"), F.col("modified_len")))
