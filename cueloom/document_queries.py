"""Registered queries over whole documents and bodies: the rewrite, routes, player metadata, XML, property lists. ``catalog``
has those over cues and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .functions import urls
from .functions.members import with_path, without_path
from .operators import merging, ordered
from .plans import settings, tracklist
from .plans.rewrite import parsed, rewrite
from .plans.settings import Settings
from .sources import protobuf, store, xml_tree
from .sources.translators import translated_texts

REQUESTS = [
    "https://www.youtube.com/youtubei/v1/player",
    "https://tv.youtube.com/youtubei/v1/player?key=1",
    "https://youtubei.googleapis.com/youtubei/v1/player",
    "https://www.googleapis.com/youtubei/v1/player",
    "https://youtubei.googleapis.com/youtubei/v1/get_watch?x=2",
    "https://m.youtube.com/youtubei/v1/get_watch",
    "http://m.youtube.com/api/timedtext?v=3",
    "https://www.youtube.com/api/timedtext?v=3&subtype=Translate",
    "https://www.youtube.com/api/timedtext",
    "https://www.youtube.com/api/timedtexts?v=1",
    "https://www.youtube.com/youtubei/v1/player?",
    "https://music.youtube.com/youtubei/v1/player",
]


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _literals(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _json(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


# --- Routes and requests --------------------------------------------------------------------------------------------


def route_rules(spark, d):
    """The service's own routes over requests and responses."""
    named = _read(spark, d, "nation").select("n_nationkey", F.explode(_literals(REQUESTS)).alias("url"))
    open_query = F.col("url").contains("?") & ~F.col("url").endswith("?")
    named = named.withColumn("url", F.concat("url", F.when(open_query, F.concat(F.lit("&n="), F.col("n_nationkey"))).otherwise("")))
    request, response = (urls.route(F.col("url"), urls.routes_of(x)) for x in (urls.REQUEST_ROUTES, urls.RESPONSE_ROUTES))
    return named.select("url", "n_nationkey", request.alias("request"), response.alias("response"))


def subtype_requests(spark, d):
    docs = _read(spark, d, "documents").where("lang is not null")
    url = _json("https://www.youtube.com/api/timedtext?v=", F.col("doc_id").cast("string"), "&lang=", F.col("lang"), "-X&tlang=zh")
    kind = F.element_at(_literals(["Translate", "External", "AutoCC", "Official"]), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs.select("doc_id", urls.caption_subtype(url, kind, F.lit("en-GB")).alias("url"))


def browse_pages(spark, d):
    ident = F.regexp_replace(F.concat(F.lit("MPLYt"), F.col("url")), "https?:/", "_")
    return _read(spark, d, "pages").select("page_id", urls.is_lyrics_page(ident).alias("lyrics"), (~urls.is_lyrics_page(F.lit(None).cast("string"))).alias("absent"))


# --- Player metadata ------------------------------------------------------------------------------------------------


def _nation_tracks(spark, d):
    """Track lists where the player has them, with members that no schema names; every fifth body has none."""
    n = _read(spark, d, "nation")
    key = F.col("n_nationkey").cast("string")
    index = F.when(F.col("n_nationkey") % 2 == 0, _json(',"defaultCaptionTrackIndex":', key)).otherwise("")
    tracks = _json('{"captionTracks":[{"languageCode":"en","isTranslatable":false,"trackName":"a"},{"languageCode":"', F.col("n_name"), '"}],"audioTracks":[{"visibility":', F.col("n_regionkey").cast("string"), ',"other":{"x":[1,2.5,null]}}]', index, ',"further":"', key, '"}')
    player = _json('{"videoDetails":{"videoId":"', key, '"},"captions":{"playerCaptionsTracklistRenderer":', tracks, "}}")
    watch = F.col("n_regionkey") == 4
    body = F.when(F.col("n_nationkey") % 5 == 3, _json('{"videoDetails": {"videoId": "', key, '"}}')).when(watch, _json('{"contents":[{"playerResponse":', player, '},{"rest":', key, "}]}")).otherwise(player)
    path = F.when(watch, tracklist.WATCH_PATH).otherwise("/youtubei/v1/player")
    return n.select("n_nationkey", body.alias("body"), path.alias("path"), F.when(F.col("n_regionkey") == 0, "m.youtube.com").otherwise("www.youtube.com").alias("host"))


def _at(name: str, path: str, kind: str = "string") -> Column:
    return F.get_json_object(name, f"$.{path}").cast(kind)


def tracklist_flags(spark, d):
    out = tracklist.rewritten(_nation_tracks(spark, d), path="path")
    whole = F.coalesce(F.get_json_object("body", "$.contents[0].playerResponse"), F.col("body"))
    out = out.select("n_nationkey", F.get_json_object(whole, "$.videoDetails.videoId").alias("video"), F.get_json_object(whole, "$.captions.playerCaptionsTracklistRenderer").alias("t"), F.get_json_object("body", "$.contents[1].rest").alias("rest"))
    name = "translationLanguages[0].languageName"
    return out.select(
        "n_nationkey",
        "video",
        (_at("t", "captionTracks[0].isTranslatable", "boolean") & _at("t", "captionTracks[1].isTranslatable", "boolean")).alias("translatable"),
        _at("t", "captionTracks[0].trackName").alias("track_name"),
        _at("t", "captionTracks[1].languageCode").alias("language"),
        _at("t", "audioTracks[0].visibility", "int").alias("visibility"),
        _at("t", "audioTracks[0].captionsInitialState", "int").alias("initial_state"),
        _at("t", "audioTracks[0].other.x[1]", "double").alias("other"),
        _at("t", "defaultCaptionTrackIndex", "int").alias("default_index"),
        _at("t", "further").alias("further"),
        F.coalesce(_at("t", f"{name}.simpleText"), F.concat(F.lit("runs:"), _at("t", f"{name}.runs[0].text"))).alias("first_language"),
        F.json_array_length(_at("t", "translationLanguages")).alias("languages"),
        "rest",
    )


def tracklist_binary(spark, d):
    """Protobuf bodies with a field that the schema doesn't name, rewritten on the wire."""
    n = _read(spark, d, "nation")
    value = _json('{"captions":{"playerCaptionsTracklistRenderer":{"captionTracks":[{"languageCode":"', F.col("n_name"), '"}],"audioTracks":[{"visibility":7,"captionTrackIndices":[1,300]}],"defaultCaptionTrackIndex":', F.col("n_nationkey").cast("string"), "}}}")
    tag = F.lpad(F.col("n_nationkey").cast("string"), 3, "0")
    body = F.concat(protobuf.encoded(value, protobuf.PLAYER_RESPONSE), F.unhex(F.lit("4A03")), tag.cast("binary"))
    df = n.select("n_nationkey", body.alias("body"), F.when(F.col("n_regionkey") == 0, "m.youtube.com").otherwise("tv.youtube.com").alias("host"))
    out = tracklist.binary_rewritten(df).select("n_nationkey", "body", F.get_json_object(protobuf.decoded(F.col("body"), protobuf.PLAYER_RESPONSE), "$.captions.playerCaptionsTracklistRenderer").alias("t"))
    kept = F.contains(F.hex("body"), F.concat(F.lit("4A03"), F.hex(tag)))
    return out.select("n_nationkey", _at("t", "captionTracks[0].languageCode").alias("language"), _at("t", "captionTracks[0].isTranslatable", "boolean").alias("translatable"), _at("t", "audioTracks[0].visibility", "int").alias("visibility"), _at("t", "audioTracks[0].captionTrackIndices[1]", "int").alias("second"), _at("t", "defaultCaptionTrackIndex", "int").alias("default_index"), F.json_array_length(_at("t", "translationLanguages")).alias("languages"), kept.alias("unknown_kept"))


def request_flags(spark, d):
    """Player requests in both forms, a third of them without a playback context."""
    n = _read(spark, d, "nation")
    has = F.col("n_nationkey") % 3 != 0
    body = _json('{"videoId":"', F.col("n_name"), '"', F.when(has, _json(',"playbackContext":{"contentPlaybackContext":{"vis":', F.col("n_nationkey").cast("string"), "}}")).otherwise(""), "}")
    wire = protobuf.encoded(_json('{"videoId":"', F.col("n_name"), '"', F.when(has, ',"playbackContext":{"contentPlaybackContext":{"id6":5}}').otherwise(""), "}"), protobuf.PLAYER_REQUEST)
    out = n.select("n_nationkey", tracklist.requests_with_captions(body).alias("j"), protobuf.decoded(tracklist.binary_requests_with_captions(wire), protobuf.PLAYER_REQUEST).alias("p"))
    context = "playbackContext.contentPlaybackContext"
    return out.select("n_nationkey", _at("j", "videoId").alias("video"), _at("j", f"{context}.autoCaptionsDefaultOn").alias("auto_on"), _at("j", f"{context}.vis").alias("vis"), _at("p", "videoId").alias("binary_video"), F.concat_ws(",", *(_at("p", f"{context}.id{k}") for k in (4, 6, 8, 9))).alias("flags"))


# --- XML and property lists -----------------------------------------------------------------------------------------


def xml_tree_values(spark, d):
    """Values of customers written as XML in loose forms, read as a tree, written and read again."""
    c = _read(spark, d, "customer")
    text = _json(F.col("c_name"), " & <co> ", F.col("c_mktsegment"))
    doc = _json('<?xml version="1.0"?>\n<!-- n --><Row Key="', F.col("c_custkey").cast("string"), "\" bare seg='", F.col("c_mktsegment"), "' nation=", F.col("c_nationkey").cast("string"), ">\n  <name>", X.escape_xml(text), "</NAME>\n  <tag>a</tag><tag>b&#33;</tag><br/><open>", F.col("c_nationkey").cast("string"), "</row>")
    first = c.select("c_custkey", xml_tree.xml_to_json(doc).alias("a"))
    out = first.select("c_custkey", "a", xml_tree.xml_to_json(xml_tree.json_to_xml(F.regexp_replace("a", " & <co> ", " and "))).alias("b"))
    return out.select("c_custkey", _at("a", "Row['@Key']").alias("key"), _at("a", "Row['@seg']").alias("segment"), _at("a", "Row['@nation']").alias("nation"), _at("a", "Row.name['#']").alias("name"), _at("a", "Row.tag[1]['#']").alias("second_tag"), _at("a", "Row.open['#']").alias("unclosed"), _at("b", "Row.name['#']").alias("again"))


def property_lists(spark, d):
    e = _read(spark, d, "events")
    return e.select("event_id", F.get_json_object(store.plist_to_json(store.json_to_plist("props")), "$.k").cast("long").alias("k"))


def stored_paths(spark, d):
    """Objects of a store with a path set, one taken out, and read back."""
    e = _read(spark, d, "events").select("event_id", F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("key"), F.col("props").alias("value"))
    value = without_path(with_path(F.col("value"), ["a", "b"], '"5"'), ["k"])
    out = e.select("event_id", F.col("value").alias("before"), value.alias("value"))
    return out.select("event_id", F.get_json_object("value", "$.a.b").alias("b"), F.get_json_object("value", "$.k").alias("k"), F.get_json_object("before", "$.k").alias("before"))


def service_codes(spark, d):
    codes = ["zh-TW", "EN", "en-us sdh", "NO", "zh-Hans", "pt-br", "xx", "ZH-HK"]
    return _read(spark, d, "nation").select("n_nationkey", F.explode(_literals(codes)).alias("code")).select("n_nationkey", "code", tracklist.service_code(F.col("code")).alias("service"))


def layered_settings(spark, d):
    """Settings of each nation: defaults, arguments and stored ones in layers, strings coerced."""
    made = []
    for key, name in sorted(tuple(r) for r in _read(spark, d, "nation").select("n_nationkey", "n_name").collect()):
        stored = {"Types": "Official,Translate"} if key % 2 else {}
        got = settings.layered({"Type": "Official", "Show": "false", "Size": "50"}, settings.argument_map(f'Type="{name}"&Size={key}'), stored, {"Show": "true"} if key % 3 == 0 else {})
        made.append((key, str(got["Type"]), int(got["Size"]), bool(got["Show"]), list(got.get("Types", []))))
    return spark.createDataFrame(made, "n_nationkey long, type string, size long, show boolean, types array<string>").select("n_nationkey", "type", "size", "show", F.array_join("types", "|").alias("types"))


# --- Captions -------------------------------------------------------------------------------------------------------


def _window_docs(spark, d):
    """Documents with a window, with cues that refer to one, with both or with neither, in turn."""
    c = _read(spark, d, "conversations")
    p = _json('<p t="', F.col("turn").cast("string"), '"', F.when((F.col("conv_id") % 4 >= 2) & (F.col("turn") == 1), " a='1'").otherwise(""), ">x</p>")
    body = _json('<timedtext><head><ws id="0"/></head><body>', F.when(F.col("conv_id") % 2 == 1, '<w t="0" id="1"/>').otherwise(""), F.array_join(F.array_sort(F.collect_list("p")), ""), "</body></timedtext>")
    name = F.when(F.col("conv_id") % 7 == 0, "English%20%EF%BC%A3%EF%BC%A3%EF%BC%91").otherwise("English")
    url = _json("https://www.youtube.com/api/timedtext?name=", name, F.when(F.col("conv_id") % 5 == 0, "&kind=asr").when(F.col("conv_id") % 5 == 1, "&kind=asr2&a=kind%3Dasr").otherwise(""))
    return c.select("conv_id", p.alias("p")).groupBy("conv_id").agg(body.alias("body")).withColumn("url", url)


def caption_modes(spark, d):
    return parsed(_window_docs(spark, d)).select("conv_id", "body", "url", F.col("_mode").alias("mode"), urls.is_automatic(F.col("url")).alias("automatic"))


def roll_up_removed(spark, d):
    """Cues as arrays, absent ones as none, without references to a window."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("turn").alias("pos"), F.col("role").alias("_w"), F.lit("1").alias("_a"))))
    c = _read(spark, d, "conversations").groupBy("conv_id").agg(rows.alias("p"))
    kind = c.schema["p"].dataType.elementType.simpleString()
    cues = merging.without_roll_up(merging.as_array(F.when(F.col("conv_id") % 3 > 0, F.col("p")), kind))
    return c.select("conv_id", F.size(cues).cast("long").alias("cues"), F.exists(cues, lambda x: x["_w"].isNotNull() | x["_a"].isNotNull()).alias("refers"), F.aggregate(cues, F.lit(0).cast("long"), lambda a, x: a + x["pos"]).alias("positions"))


def translated_rows(spark, d):
    """Each text on its own, with a translator that fails at first; a track's texts are an array."""
    failed: set[str] = set()

    def flaky(texts: list[str]) -> list[str]:
        if len(texts) != 1 or texts[0] not in failed:
            failed.update(texts)
            raise OSError("try again")
        return [f"T: {texts[0]}"]

    c = _read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("rows"))
    out = c.withColumn("t", translated_texts(F.lit("official"), F.col("rows.text"), flaky, Settings(method="Row", wait_s=0.0, concurrency=4)))
    return out.select("conv_id", F.explode(F.arrays_zip(F.col("rows.turn").alias("turn"), F.col("t").alias("translation"))).alias("x")).select("conv_id", "x.turn", "x.translation")


def bodies_passed_through(spark, d):
    """Pages aren't timed text: they come out as they went in, without a mode."""
    pages = _read(spark, d, "pages").select(F.col("page_id").cast("string").alias("track_id"), "url", F.col("html").alias("body"))
    return rewrite(pages).select("track_id", "body", "caption_mode", F.col("headers").isNull().alias("bare"), "cues")


def caption_rewrite(spark, d):
    """Conversations as timed-text documents, rewritten; every second one has automatic captions."""
    p = _json('<p t="', (F.col("turn") * 2000).cast("string"), '" d="', (F.length("text") * 20).cast("string"), '" x="', F.col("role"), '">', X.escape_xml(F.col("text")), "</p>")
    rows = _read(spark, d, "conversations").select("conv_id", "turn", p.alias("p"))
    body = _json('<timedtext format="3"><head><pen id="1"/><wp id="1" rc="1"/></head><body>', ordered.concatenated("p", "turn"), "</body></timedtext>")
    docs = rows.groupBy("conv_id").agg(body.alias("body"))
    url = _json("https://www.youtube.com/api/timedtext?v=", F.col("conv_id").cast("string"), F.when(F.col("conv_id") % 2 == 0, "&kind=asr").otherwise(""))
    out = rewrite(docs.select(F.col("conv_id").cast("string").alias("track_id"), url.alias("url"), "body"), lambda texts: [f"T: {t}" for t in texts])
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return out.withColumn("headers", shown)


def queries() -> dict:
    return {f.__name__: f for f in (route_rules, subtype_requests, browse_pages, tracklist_flags, tracklist_binary, request_flags, xml_tree_values, property_lists, caption_modes, roll_up_removed, translated_rows, stored_paths, service_codes, layered_settings, bodies_passed_through, caption_rewrite)}


# --- The same in SQL ------------------------------------------------------------------------------------------------


def _route_cases(names: tuple[str, ...]) -> str:
    return " ".join(f"WHEN regexp_matches(url, '{p}') THEN '{n}'" for n, p in urls.routes_of(names))


def _rewrite_sql(slices: str, escape) -> str:
    """A cue's text loses indentation and outer line ends, a document all tabs and line ends."""
    both = f"{escape('text')} || '&#x000A;' || {escape(chr(39) + 'T: ' + chr(39) + ' || text')}"
    cue = """'<p t="' || t || '" d="' || d || '" x="' || role || '">'"""
    head = """'<timedtext format="3"><head><pen id="1"/><wp id="1" rc="{}"/></head><body>'"""
    return rf"""WITH RECURSIVE texts AS (SELECT conv_id, turn, role, CAST(turn * 2000 AS BIGINT) AS t, CAST(length(text) * 20 AS BIGINT) AS d, regexp_replace(regexp_replace(text, '(^|\n)[ \t]+', '\1', 'g'), '^[\r\n\t]+|[\r\n\t]+$', '', 'g') AS text, {escape("text")} AS raw FROM conversations),
cues AS (SELECT conv_id AS track_id, turn AS pos, t AS start_ms, d AS dur_ms, text FROM texts WHERE conv_id % 2 = 0), {slices},
lines AS (
  SELECT conv_id, turn AS pos, 0 AS part_no, t, d, role, text FROM texts WHERE conv_id % 2 = 1
  UNION ALL SELECT track_id, pos, part_no, start_ms, s.dur_ms, role, s.text FROM slices s JOIN texts ON conv_id = track_id AND turn = pos),
made AS (SELECT conv_id, count(*) AS cues, {head.format(2)} || string_agg({cue} || {both} || '</p>', '' ORDER BY pos, part_no) || '</body></timedtext>' AS body FROM lines GROUP BY conv_id),
given AS (SELECT conv_id, {head.format(1)} || string_agg({cue} || raw || '</p>', '' ORDER BY turn) || '</body></timedtext>' AS body FROM texts GROUP BY conv_id),
out AS (SELECT CAST(conv_id AS VARCHAR) AS track_id, 'https://www.youtube.com/api/timedtext?v=' || conv_id || CASE WHEN conv_id % 2 = 0 THEN '&kind=asr' ELSE '' END AS url, replace(replace(m.body, chr(9), ''), chr(10), '') AS body, CASE WHEN conv_id % 2 = 0 THEN 'automatic' ELSE 'official' END AS caption_mode, CAST(length(g.body) AS BIGINT) AS original_len, m.cues FROM made m JOIN given g USING (conv_id))
SELECT track_id, url, body, caption_mode, original_len, CAST(length(body) AS BIGINT) AS modified_len, cues, 'X-Captions-ASR-Mode=' || CASE WHEN caption_mode = 'automatic' THEN 'fixed-two-lines-split-long-cues' ELSE 'unchanged' END || ';X-Captions-Broadcast-Mode=unchanged;X-Captions-Caption-Mode=' || caption_mode || ';X-Captions-Settings=standalone;X-Captions-Version=23;X-Captions-XML-Modified-Length=' || length(body) || ';X-Captions-XML-Original-Length=' || original_len AS headers FROM out"""


def oracle_sql(slices: str, escape) -> dict[str, str]:
    """``slices`` are the timed parts of a table ``cues``, ``escape`` makes XML text of an expression."""
    listed = ", ".join(f"'{u}'" for u in REQUESTS)
    return {
        "route_rules": f"""WITH u AS (SELECT n_nationkey, u || CASE WHEN contains(u, '?') AND NOT ends_with(u, '?') THEN '&n=' || n_nationkey ELSE '' END AS url FROM nation, (SELECT unnest([{listed}]) AS u))
SELECT url, n_nationkey, CASE {_route_cases(urls.REQUEST_ROUTES)} END AS request, CASE {_route_cases(urls.RESPONSE_ROUTES)} END AS response FROM u""",
        "subtype_requests": "SELECT doc_id, 'https://www.youtube.com/api/timedtext?v=' || doc_id || '&lang=' || lang || '-X' || CASE doc_id % 4 WHEN 0 THEN '&subtype=Translate' WHEN 1 THEN '&subtype=External' WHEN 2 THEN CASE WHEN lang = 'en' THEN '&tlang=zh' ELSE '&tlang=en-GB' END ELSE '&tlang=zh' END AS url FROM documents WHERE lang IS NOT NULL",
        "browse_pages": "SELECT page_id, regexp_matches(url, '^https?:/') AS lyrics, true AS absent FROM pages",
        "tracklist_flags": """WITH n AS (SELECT *, n_nationkey % 5 <> 3 AS has FROM nation)
SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS video, CASE WHEN has THEN true END AS translatable, CASE WHEN has THEN 'a' END AS track_name, CASE WHEN has THEN n_name END AS language, CASE WHEN has THEN 2::INTEGER END AS visibility, CASE WHEN has THEN 3::INTEGER END AS initial_state, CASE WHEN has THEN 2.5::DOUBLE END AS other, CASE WHEN has THEN CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE 0 END AS INTEGER) END AS default_index, CASE WHEN has THEN CAST(n_nationkey AS VARCHAR) END AS further, CASE WHEN has THEN CASE WHEN n_regionkey = 0 THEN 'runs:' ELSE '' END || 'Shqip - 阿尔巴尼亚语' END AS first_language, CASE WHEN has THEN 126::INTEGER END AS languages, CASE WHEN has AND n_regionkey = 4 THEN CAST(n_nationkey AS VARCHAR) END AS rest FROM n""",
        "tracklist_binary": "SELECT n_nationkey, n_name AS language, true AS translatable, 2::INTEGER AS visibility, 300::INTEGER AS second, CAST(n_nationkey AS INTEGER) AS default_index, 126::INTEGER AS languages, true AS unknown_kept FROM nation",
        "request_flags": "SELECT n_nationkey, n_name AS video, CASE WHEN n_nationkey % 3 <> 0 THEN 'true' END AS auto_on, CASE WHEN n_nationkey % 3 <> 0 THEN CAST(n_nationkey AS VARCHAR) END AS vis, n_name AS binary_video, CASE WHEN n_nationkey % 3 <> 0 THEN '1,1,1,1' ELSE '' END AS flags FROM nation",
        "xml_tree_values": "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation, c_name || ' & <co> ' || c_mktsegment AS name, 'b!' AS second_tag, CAST(c_nationkey AS VARCHAR) AS unclosed, c_name || ' and ' || c_mktsegment AS again FROM customer",
        "property_lists": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
        "caption_modes": """WITH d AS (SELECT conv_id, '<timedtext><head><ws id="0"/></head><body>' || CASE WHEN conv_id % 2 = 1 THEN '<w t="0" id="1"/>' ELSE '' END || string_agg(p, '' ORDER BY encode(p)) || '</body></timedtext>' AS body FROM (SELECT conv_id, '<p t="' || turn || '"' || CASE WHEN conv_id % 4 >= 2 AND turn = 1 THEN ' a=''1''' ELSE '' END || '>x</p>' AS p FROM conversations) GROUP BY conv_id),
u AS (SELECT *, 'https://www.youtube.com/api/timedtext?name=' || CASE WHEN conv_id % 7 = 0 THEN 'English%20%EF%BC%A3%EF%BC%A3%EF%BC%91' ELSE 'English' END || CASE conv_id % 5 WHEN 0 THEN '&kind=asr' WHEN 1 THEN '&kind=asr2&a=kind%3Dasr' ELSE '' END AS url FROM d)
SELECT conv_id, body, url, regexp_matches(url, '[?&]kind=asr(&|$)') AS automatic, CASE WHEN regexp_matches(url, '[?&]kind=asr(&|$)') THEN 'automatic' WHEN contains(url, '%EF%BC%91') OR (contains(body, '<w ') AND regexp_matches(body, '<p[^>]* [wa]=')) THEN 'broadcast' ELSE 'official' END AS mode FROM u""",
        "roll_up_removed": "SELECT conv_id, CASE WHEN conv_id % 3 > 0 THEN count(*) ELSE 0 END AS cues, false AS refers, CASE WHEN conv_id % 3 > 0 THEN CAST(sum(turn) AS BIGINT) ELSE 0 END AS positions FROM conversations GROUP BY conv_id",
        "stored_paths": "SELECT event_id, '5' AS b, CAST(NULL AS VARCHAR) AS k, json_extract_string(props, '$.k') AS before FROM events",
        "service_codes": "SELECT n_nationkey, code, service FROM nation, (VALUES ('zh-TW', 'zh-TW'), ('EN', 'en'), ('en-us sdh', 'en-US SDH'), ('NO', 'nb-NO'), ('zh-Hans', 'zh-Hans'), ('pt-br', 'pt-BR'), ('xx', 'xx'), ('ZH-HK', 'zh-Hant-HK')) AS t(code, service)",
        "layered_settings": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name AS type, CAST(n_nationkey AS BIGINT) AS size, n_nationkey % 3 = 0 AS show, CASE WHEN n_nationkey % 2 = 1 THEN 'Official|Translate' ELSE '' END AS types FROM nation",
        "bodies_passed_through": "SELECT CAST(page_id AS VARCHAR) AS track_id, html AS body, CAST(NULL AS VARCHAR) AS caption_mode, true AS bare, CAST(0 AS BIGINT) AS cues FROM pages",
        "translated_rows": "SELECT conv_id, turn, 'T: ' || text AS translation FROM conversations",
        "caption_rewrite": _rewrite_sql(slices, escape),
    }
