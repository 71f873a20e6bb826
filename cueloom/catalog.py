"""The registered queries of the caption operators over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import document_queries
from .functions import text as X
from .functions import tracks, urls
from .operators import merging, ordered, segmentation, state
from .sources.translators import translate_batches

# --- Tables as captions ---------------------------------------------------------------------------------------------


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def cues_conv(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation as cues that may overlap."""
    return _read(spark, d, "conversations").select(F.col("conv_id").alias("track_id"), F.col("turn").alias("pos"), (F.col("turn") * 2000).alias("start_ms"), (F.length("text") * 20).cast("long").alias("dur_ms"), "text")


def cues_events(spark: SparkSession, d: str, shuffled: bool = False) -> DataFrame:
    """Events of a user as cues, in order of time or not."""
    e = _read(spark, d, "events")
    pos = (F.col("event_id") * 7919) % 100003 if shuffled else F.col("event_id")
    return e.select(F.col("user_id").alias("track_id"), pos.alias("pos"), F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 1000").alias("start_ms"), F.floor(F.col("value") * 1000).cast("long").alias("dur_ms"))


CONV = "cues AS (SELECT conv_id AS track_id, turn AS pos, CAST(turn * 2000 AS BIGINT) AS start_ms, CAST(length(text) * 20 AS BIGINT) AS dur_ms, text FROM conversations)"
EVENTS = "cues AS (SELECT user_id AS track_id, {pos} AS pos, epoch_us(ts) // 1000 AS start_ms, CAST(floor(value * 1000) AS BIGINT) AS dur_ms FROM events)"


def _width(x: str) -> str:
    return f"(length({x}) + length(regexp_replace({x}, '[^{X.WIDE}]', '', 'g')))"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{X.SPACE}]+|[{X.SPACE}]+$', '', 'g')"


_NEXT = "min(start_ms) OVER (PARTITION BY track_id ORDER BY start_ms RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"

#: The greedy cut as a recursion over what is left of each text; needs ``cues``.
PARTS = f"""steps AS (
  SELECT track_id, pos, CAST(-1 AS BIGINT) AS part_no, CAST(NULL AS VARCHAR) AS part, {_trim("text")} AS rest, false AS done FROM cues
  UNION ALL
  SELECT track_id, pos, part_no + 1, {_trim("left(rest, cut)")}, regexp_replace(substr(rest, cut + 1), '^[{X.SPACE}]+', ''), cut >= length(rest) FROM (
    SELECT *, CASE WHEN k >= length(rest) THEN k WHEN nb > 0 AND {_width("left(rest, nb)")} >= 22 THEN nb ELSE k END AS cut FROM (
      SELECT *, length(regexp_extract(left(rest, k), '^(.*[{X.SPACE}{X.BREAK_MARKS}])', 1, 's')) AS nb FROM (
        SELECT *, CASE WHEN {_width("rest")} <= 40 THEN length(rest) ELSE list_max(list_filter(range(1, 41), lambda i: i = 1 OR {_width("left(rest, CAST(i AS BIGINT))")} <= 40)) END AS k
        FROM steps WHERE NOT done AND rest <> '')))),
parts AS (SELECT track_id, pos, part, row_number() OVER (PARTITION BY track_id, pos ORDER BY part_no) - 1 AS part_no FROM steps WHERE part <> '')"""

#: Timed parts as ``split_cues`` gives them.
SLICES = f"""{PARTS},
timed AS (SELECT *, {_NEXT} AS next_ms FROM cues),
lasting AS (SELECT *, CASE WHEN next_ms - start_ms > 0 AND (dur_ms IS NULL OR dur_ms > next_ms - start_ms) THEN next_ms - start_ms ELSE dur_ms END AS d FROM timed),
counted AS (SELECT l.*, (SELECT count(*) FROM parts p WHERE p.track_id = l.track_id AND p.pos = l.pos) AS n FROM lasting l),
weighed AS (SELECT p.*, greatest(1, {_width("part")}) AS w, c.start_ms AS s, c.d, coalesce(c.dur_ms > c.d, false) AS shortened FROM parts p JOIN counted c USING (track_id, pos) WHERE c.n > 1 AND c.d > 0),
summed AS (SELECT *, sum(w) OVER (PARTITION BY track_id, pos ORDER BY part_no ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY track_id, pos) AS total, max(part_no) OVER (PARTITION BY track_id, pos) AS last FROM weighed),
edged AS (SELECT *, CAST(floor(d * (upto - w) / total + 0.5) AS BIGINT) AS a, CASE WHEN part_no = last THEN d ELSE CAST(floor(d * upto / total + 0.5) AS BIGINT) END AS b FROM summed),
slices AS (
  SELECT track_id, pos, part_no, part AS text, s + a AS start_ms, greatest(1, b - a) AS dur_ms, true AS was_split, shortened FROM edged
  UNION ALL
  SELECT track_id, pos, 0, text, start_ms, CASE WHEN d > 0 THEN d ELSE dur_ms END, false, coalesce(dur_ms > d, false) FROM counted WHERE NOT (n > 1 AND d > 0))"""


def _escape(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


# --- Queries --------------------------------------------------------------------------------------------------------


def _split(spark, d):
    return segmentation.split_cues(cues_conv(spark, d))


def split_to_width(spark, d):
    c = cues_conv(spark, d)
    return c.select("track_id", "pos", F.posexplode(segmentation.pieces(F.col("text"))).alias("part_no", "p")).select("track_id", "pos", F.col("part_no").cast("long").alias("part_no"), F.col("p.text").alias("part"))


def cue_time_slices(spark, d):
    out = ordered.renumbered(_split(spark, d))
    return out.select("track_id", "pos", F.col("part_no").cast("long").alias("part_no"), "start_ms", "dur_ms", F.col("out_pos").cast("long").alias("out_pos"))


def caption_parts(spark, d):
    merged = merging.bilingual(F.col("text"), F.concat(F.lit("T: "), F.col("text")))
    return _split(spark, d).select("track_id", "pos", F.col("part_no").cast("long").alias("part_no"), "start_ms", "dur_ms", merged.alias("text"))


def trim_overlaps(spark, d):
    c = ordered.next_start(cues_events(spark, d))
    return c.select("track_id", "pos", ordered.trimmed_duration(F.col("start_ms"), F.col("dur_ms"), F.col("next_ms"), F.lit(True)).alias("dur_ms"))


def size_bounded_batches(spark, d):
    return ordered.size_bounded_batches(cues_conv(spark, d), X.percent_encoded_length(F.col("text"))).select("track_id", "pos", "batch_no")


def _bilingual(**options):
    def query(spark, d):
        c = _read(spark, d, "conversations")
        return c.select("conv_id", "turn", merging.bilingual(F.col("text"), F.concat(F.lit("T: "), F.col("text")), **options).alias("merged"))

    return query


def recovering_batch_map(spark, d):
    """A translator that loses a row of every batch of more than two."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "text")))
    batches = ordered.fixed_batches(cues_conv(spark, d), 5).groupBy("track_id", "batch_no").agg(rows.alias("rows")).withColumn("texts", F.col("rows.text"))
    answers = translate_batches(batches, lambda texts: ["T: " + t for t in texts][len(texts) > 2 :])
    return answers.select("track_id", F.explode(F.arrays_zip(F.col("rows.pos").alias("pos"), F.col("translations").alias("translation"))).alias("x")).select("track_id", "x.pos", "x.translation")


TRACK_NAMES = ["CC1", "CC4", "CC5", "DTVCC1", "DTVCC63", "DTVCC64", "SERVICE1", "Service 63", "SERVICE0", "CEA-608", "EIA 708", "Embedded 608/708", "Line 21", "XCC1", "English"]
PAGE_ROUTES = [("tracked", r"[?&]utm_"), ("page", r"/[a-z]+/"), ("root", r"^https?://")]


def rows_floor(spark, d):
    n = _read(spark, d, "nation")
    wp = lambda ident, rc: F.struct(ident.alias("_id"), rc.alias("_rc"))
    positions = F.array(wp(F.lit("0"), F.lit("1")), wp(F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")), wp(F.lit("7"), F.lit("x")))
    return n.select("n_nationkey", F.array_join(F.transform(merging.floor_rows(positions), lambda p: p["_rc"]), ",").alias("rows"))


def queries() -> dict:
    docs = lambda s, d: _read(s, d, "documents")
    conv = lambda s, d: _read(s, d, "conversations")
    pages = lambda s, d: _read(s, d, "pages")
    events = lambda s, d: _read(s, d, "events")
    return {
        "caption_parts": caption_parts,
        "text_display_width": lambda s, d: docs(s, d).select("doc_id", X.display_width(F.col("text")).alias("width")),
        "percent_encoded_length": lambda s, d: docs(s, d).select("doc_id", X.percent_encoded_length(F.col("text")).alias("encoded_len")),
        "utf16_length": lambda s, d: docs(s, d).select("doc_id", X.utf16_length(F.col("text")).alias("units")),
        "xml_escape": lambda s, d: docs(s, d).select("doc_id", X.escape_xml(F.col("text")).alias("escaped")),
        "natural_breaks": lambda s, d: docs(s, d).select("doc_id", F.regexp_count(F.col("text"), F.lit(f"[{X.SPACE}{X.BREAK_MARKS}]")).cast("long").alias("breaks")),
        "trimmed_lines": lambda s, d: docs(s, d).select("doc_id", F.posexplode(F.split(F.col("text"), "\n")).alias("line_no", "line")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), X.trimmed(F.concat(F.lit(" \t"), F.col("line"), F.lit("\r "))).alias("line")),
        "leading_integer": lambda s, d: events(s, d).select("event_id", X.leading_integer(F.concat(F.lit(" "), (F.col("event_id") - 5).cast("string"), F.lit("ms")), True).alias("n")),
        "split_to_width": split_to_width,
        "split_counters": lambda s, d: segmentation.split_counters(_split(s, d)),
        "cue_time_slices": cue_time_slices,
        "next_greater_start_sorted": lambda s, d: cues_conv(s, d).select("track_id", "pos", ordered.next_start_sorted().alias("next_ms")),
        "next_greater_start_unsorted": lambda s, d: ordered.next_start_by_position(cues_events(s, d, True)),
        "trim_overlaps": trim_overlaps,
        "fixed_batches": lambda s, d: ordered.fixed_batches(docs(s, d).select("doc_id", "lang"), 120, "lang", "doc_id").select("doc_id", "batch_no"),
        "size_bounded_batches": size_bounded_batches,
        "ordered_text_concat": lambda s, d: conv(s, d).groupBy("conv_id").agg(ordered.concatenated("text", "turn", "\r").alias("joined")),
        "cue_counts": lambda s, d: conv(s, d).groupBy("conv_id").agg(F.count("*").alias("cues"), F.count_if(F.col("role") == "user").alias("marked"), F.sum(X.display_width(F.col("text"))).alias("width")),
        "bilingual_merge": _bilingual(),
        "bilingual_reverse": _bilingual(position="Reverse"),
        "bilingual_translation_only": _bilingual(translation_only=True),
        "singleton_text_or_blank": lambda s, d: docs(s, d).select("doc_id", merging.cue_text(F.lit(None).cast("string"), F.split(F.col("text"), "\n")).alias("cue_text")),
        "url_route": lambda s, d: pages(s, d).select("page_id", urls.route(F.col("url"), PAGE_ROUTES).alias("route")),
        "url_query_params": lambda s, d: pages(s, d).select("page_id", urls.query_value(F.col("url"), "page").alias("page"), urls.has_query(F.col("url"), "utm_source").alias("tracked")),
        "url_add_marker": lambda s, d: pages(s, d).select("page_id", urls.marked(F.col("url"), F.lit(True)).alias("url")),
        "url_drop_param": lambda s, d: pages(s, d).select("page_id", urls.delete_query(F.col("url"), "utm_source").alias("url")),
        "track_name_class": lambda s, d: _read(s, d, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, TRACK_NAMES))).alias("name")).select("n_nationkey", "name", tracks.is_broadcast_name(F.concat_ws(" ", "name", F.lit("track"))).alias("broadcast")),
        "language_match": lambda s, d: docs(s, d).select("doc_id", urls.same_language(F.concat("lang", F.lit("-X")), F.lit("en_US")).alias("same")),
        "content_type_route": lambda s, d: _read(s, d, "nation").select("n_nationkey", urls.body_kind(F.element_at(F.array(*map(F.lit, ["application/json; charset=UTF-8", "application/x-protobuf", "text/html"])), F.col("n_nationkey") % 3 + 1)).alias("kind")),
        "argument_map": lambda s, d: events(s, d).select("event_id", F.element_at(urls.arguments(F.concat(F.lit('type="'), F.col("event_type"), F.lit('"&id='), F.col("event_id").cast("string"))), "type").alias("type")),
        "rows_floor": rows_floor,
        "json_path_get": lambda s, d: events(s, d).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")),
        "bounded_cache": lambda s, d: state.bounded_cache(events(s, d), "user_id", "event_type", "event_id").select("user_id", "first_seen", "value"),
        "sticky_language": lambda s, d: docs(s, d).select("doc_id", "source", F.when(F.col("doc_id") % 5 == 0, F.col("lang")).alias("tlang")).select("doc_id", state.sticky("tlang", "doc_id", "source").alias("tlang")),
        "sticky_over_all": lambda s, d: state.sticky_over_all(docs(s, d).select("doc_id", F.when(F.col("doc_id") % 7 == 3, F.col("lang")).alias("seen")), "seen", "doc_id", "tlang").select("doc_id", "tlang"),
        "recovering_batch_map": recovering_batch_map,
    } | document_queries.queries()


def oracle_sql() -> dict[str, str]:
    unreserved = X.UNRESERVED.replace("'", "''")
    merged = {k: f"SELECT conv_id, turn, CASE WHEN text IS NULL OR text IN ('', chr(8203)) THEN NULL ELSE {v} END AS merged FROM conversations" for k, v in {"bilingual_merge": f"{_escape('text')} || '&#x000A;' || {_escape(chr(39) + 'T: ' + chr(39) + ' || text')}", "bilingual_reverse": f"{_escape(chr(39) + 'T: ' + chr(39) + ' || text')} || '&#x000A;' || {_escape('text')}", "bilingual_translation_only": _escape("'T: ' || text")}.items()}
    names = ", ".join(f"'{n}'" for n in TRACK_NAMES)
    broadcast = " OR ".join(f"regexp_matches(upper(name || ' track'), '{p}')" for p in tracks.BROADCAST_NAMES)
    routes = " ".join(f"WHEN regexp_matches(url, '{p}') THEN '{n}'" for n, p in PAGE_ROUTES)
    has = r"regexp_matches(split_part(url, '#', 1), '[?&]{}(=|&|$)')"
    marker = "split_part(url, '#', 1) || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'subtype=Translate' || substr(url, length(split_part(url, '#', 1)) + 1)"
    kept = "list_aggregate(list_filter(string_split(regexp_extract(split_part(url, '#', 1), '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^utm_source(=|$)')), 'string_agg', '&')"
    return merged | document_queries.oracle_sql(SLICES, _escape) | {
        "caption_parts": f"WITH RECURSIVE {CONV}, {SLICES} SELECT track_id, pos, part_no, start_ms, dur_ms, {_escape('text')} || '&#x000A;' || {_escape(chr(39) + 'T: ' + chr(39) + ' || text')} AS text FROM slices",
        "text_display_width": f"SELECT doc_id, CAST({_width('text')} AS BIGINT) AS width FROM documents",
        "percent_encoded_length": f"SELECT doc_id, CAST(3 * strlen(text) - 2 * length(regexp_replace(text, '[^{unreserved}]', '', 'g')) AS BIGINT) AS encoded_len FROM documents",
        "utf16_length": r"SELECT doc_id, CAST(length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS BIGINT) AS units FROM documents",
        "xml_escape": f"SELECT doc_id, {_escape('text')} AS escaped FROM documents",
        "natural_breaks": f"SELECT doc_id, CAST(len(regexp_extract_all(text, '[{X.SPACE}{X.BREAK_MARKS}]')) AS BIGINT) AS breaks FROM documents",
        "trimmed_lines": f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents) SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, {_trim('line')} AS line FROM l",
        "leading_integer": "SELECT event_id, CASE WHEN event_id - 5 >= 0 THEN event_id - 5 END AS n FROM events",
        "split_to_width": f"WITH RECURSIVE {CONV}, {PARTS} SELECT track_id, pos, part_no, part FROM parts",
        "split_counters": f"WITH RECURSIVE {CONV}, {SLICES} SELECT track_id, count(*) FILTER (part_no = 0) AS cues_in, count(*) AS cues_out, count(*) FILTER (part_no = 0 AND was_split) AS split, count(*) FILTER (part_no = 0 AND shortened) AS shortened FROM slices GROUP BY track_id",
        "cue_time_slices": f"WITH RECURSIVE {CONV}, {SLICES} SELECT track_id, pos, part_no, start_ms, dur_ms, row_number() OVER (PARTITION BY track_id ORDER BY pos, part_no) - 1 AS out_pos FROM slices",
        "next_greater_start_sorted": f"WITH {CONV} SELECT track_id, pos, {_NEXT} AS next_ms FROM cues",
        "next_greater_start_unsorted": f"WITH {EVENTS.format(pos='(event_id * 7919) % 100003')} SELECT a.track_id, a.pos, arg_min(b.start_ms, b.pos) AS next_ms FROM cues a LEFT JOIN cues b ON a.track_id = b.track_id AND b.pos > a.pos AND b.start_ms > a.start_ms GROUP BY a.track_id, a.pos",
        "trim_overlaps": f"WITH {EVENTS.format(pos='event_id')}, n AS (SELECT *, {_NEXT} - start_ms AS room FROM cues) SELECT track_id, pos, CASE WHEN room > 0 AND dur_ms > room THEN room ELSE dur_ms END AS dur_ms FROM n",
        "fixed_batches": "SELECT doc_id, CAST((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 120 AS BIGINT) AS batch_no FROM documents",
        "size_bounded_batches": f"""WITH RECURSIVE c AS (SELECT conv_id AS track_id, turn AS pos, 3 * strlen(text) - 2 * length(regexp_replace(text, '[^{unreserved}]', '', 'g')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
b AS (SELECT track_id, pos, r, n AS size, CAST(0 AS BIGINT) AS batch_no FROM c WHERE r = 1
  UNION ALL SELECT c.track_id, c.pos, c.r, CASE WHEN b.size + 3 + c.n > 2400 THEN c.n ELSE b.size + 3 + c.n END, b.batch_no + CASE WHEN b.size + 3 + c.n > 2400 THEN 1 ELSE 0 END FROM b JOIN c ON c.track_id = b.track_id AND c.r = b.r + 1)
SELECT track_id, pos, batch_no FROM b""",
        "ordered_text_concat": "SELECT conv_id, string_agg(text, chr(13) ORDER BY turn) AS joined FROM conversations GROUP BY conv_id",
        "cue_counts": f"SELECT conv_id, count(*) AS cues, count(*) FILTER (role = 'user') AS marked, CAST(sum({_width('text')}) AS BIGINT) AS width FROM conversations GROUP BY conv_id",
        "singleton_text_or_blank": "SELECT doc_id, coalesce(nullif(replace(text, chr(10), ''), ''), chr(8203)) AS cue_text FROM documents",
        "url_route": f"SELECT page_id, CASE {routes} END AS route FROM pages",
        "url_query_params": rf"SELECT page_id, nullif(regexp_extract(split_part(url, '#', 1), '[?&]page=([^&]*)', 1), '') AS page, {has.format('utm_source')} AS tracked FROM pages",
        "url_add_marker": f"SELECT page_id, CASE WHEN {has.format('subtype')} THEN url ELSE {marker} END AS url FROM pages",
        "url_drop_param": f"SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) || coalesce('?' || {kept}, '') || substr(url, length(split_part(url, '#', 1)) + 1) AS url FROM pages",
        "track_name_class": f"SELECT n_nationkey, name, ({broadcast}) AS broadcast FROM (SELECT n_nationkey, unnest([{names}]) AS name FROM nation)",
        "language_match": "SELECT doc_id, lang = 'en' AS same FROM documents",
        "content_type_route": "SELECT n_nationkey, ['json', 'protobuf', NULL][n_nationkey % 3 + 1] AS kind FROM nation",
        "argument_map": "SELECT event_id, event_type AS type FROM events",
        "rows_floor": "SELECT n_nationkey, '1,' || greatest(n_nationkey, 2) || ',x' AS rows FROM nation",
        "json_path_get": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
        "bounded_cache": "SELECT user_id, min(event_id) AS first_seen, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id ORDER BY first_seen DESC, user_id DESC LIMIT 50",
        "sticky_language": "SELECT doc_id, last_value(CASE WHEN doc_id % 5 = 0 THEN lang END IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS tlang FROM documents",
        "sticky_over_all": "SELECT doc_id, last_value(CASE WHEN doc_id % 7 = 3 THEN lang END IGNORE NULLS) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS tlang FROM documents",
        "recovering_batch_map": "SELECT conv_id AS track_id, turn AS pos, 'T: ' || text AS translation FROM conversations",
    }
