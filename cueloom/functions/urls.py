"""Column functions on request URLs, content types and arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts and paths of the caption and player endpoints.
CAPTION_HOSTS = ("www.youtube.com", "m.youtube.com")
CAPTION_PATH = "/api/timedtext"
MARKER = ("subtype", "Translate")

#: Routes by URL pattern, by direction and by kind of body; the first that matches counts.
ROUTES = [
    ("player_json", r"^https?://(www|m|tv)\.youtube\.com/youtubei/v1/player(\?.+)?$"),
    ("player_proto", r"^https?://youtubei\.googleapis\.com/youtubei/v1/player(\?.+)?$"),
    ("watch_proto", r"^https?://youtubei\.googleapis\.com/youtubei/v1/get_watch(\?.+)?$"),
    ("translated_captions", r"^https?://(www|m)\.youtube\.com/api/timedtext\?.*subtype=Translate.*$"),
    ("captions", r"^https?://(www|m)\.youtube\.com/api/timedtext(\?.+)?$"),
]
#: Which routes a request takes, and which a response.
REQUEST_ROUTES, RESPONSE_ROUTES = ("player_json", "player_proto", "captions"), ("player_json", "player_proto", "watch_proto", "translated_captions")


def routes_of(names: tuple[str, ...]) -> list[tuple[str, str]]:
    return [r for r in ROUTES if r[0] in names]


def route(url: Column, routes: list[tuple[str, str]] = ROUTES) -> Column:
    """Name of the first route whose pattern the URL matches, else null."""
    return F.coalesce(*(F.when(url.rlike(pattern), F.lit(name)) for name, pattern in routes))


def query_value(url: Column, name: str) -> Column:
    """Decoded value of a query parameter, null if it is absent."""
    return F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)))


def has_query(url: Column, name: str) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("QUERY")).rlike(rf"(?:^|&){name}(?:=|&|$)"), F.lit(False))


def _parts(url: Column) -> tuple[Column, Column]:
    """The URL before its fragment, and the fragment with its mark."""
    bare = F.substring_index(url, "#", 1)
    return bare, F.substring(url, F.length(bare) + 1, F.length(url))


def set_query(url: Column, name: str, value: str) -> Column:
    """Appends a parameter, or replaces its first occurrence; the others and their order stay."""
    bare, fragment = _parts(url)
    appended = F.concat(bare, F.when(bare.contains("?"), F.when(bare.endswith("?") | bare.endswith("&"), "").otherwise("&")).otherwise("?"), F.lit(f"{name}={value}"), fragment)
    replaced = F.regexp_replace(url, rf"([?&]){name}(?:=[^&#]*)?(?=[&#]|$)", rf"$1{name}={value}")
    return F.when(has_query(url, name), replaced).otherwise(appended)


def delete_query(url: Column, name: str) -> Column:
    bare, fragment = _parts(url)
    head, query = F.substring_index(bare, "?", 1), F.regexp_extract(bare, r"\?(.*)$", 1)
    rest = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike(rf"^{name}(?:=|$)") & (p != "")), "&")
    return F.concat(head, F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise(""), fragment)


def is_caption_request(url: Column, hosts: tuple[str, ...] = CAPTION_HOSTS, path: str = CAPTION_PATH) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")).isin(*hosts) & (F.try_parse_url(url, F.lit("PATH")) == path), F.lit(False))


def marked(url: Column, applies: Column | None = None, marker: tuple[str, str] = MARKER) -> Column:
    """Adds the marker to URLs that it applies to (by default caption requests) and that don't have it."""
    applies = is_caption_request(url) if applies is None else applies
    return F.when(applies & ~has_query(url, marker[0]), set_query(url, *marker)).otherwise(url)


def is_automatic(url: Column) -> Column:
    return F.coalesce(query_value(url, "kind") == "asr", F.lit(False))


def body_kind(content_type: Column) -> Column:
    """json, protobuf or null, by the part before parameters."""
    t = F.lower(F.trim(F.split(content_type, ";")[0]))
    return F.when(t.isin("application/json", "text/json"), "json").when(t.isin("application/x-protobuf", "application/protobuf", "application/octet-stream", "application/vnd.google.protobuf"), "protobuf")


def is_lyrics_page(browse_id: Column) -> Column:
    return F.coalesce(browse_id.startswith("MPLYt_"), F.lit(False))


def same_language(a: Column, b: Column) -> Column:
    """Whether two language tags have the same primary part."""
    return F.split(a, "[-_]")[0] == F.split(b, "[-_]")[0]


def caption_subtype(url: Column, wanted: Column, cached: Column) -> Column:
    """The request URL for a wanted subtype: Translate and External drop ``tlang``; AutoCC brings the cached language if it
    differs from the track's; Official (the default) stays."""
    lang = query_value(url, "lang")
    kind = F.coalesce(wanted, F.lit("Official"))
    plain = set_query(delete_query(url, "tlang"), "subtype", "_")
    external = F.replace(plain, F.lit("subtype=_"), F.concat(F.lit("subtype="), kind))
    auto = F.concat(delete_query(url, "tlang"), F.lit("&tlang="), cached)
    return F.when(kind.isin("Translate", "External"), external).when((kind == "AutoCC") & cached.isNotNull() & ~F.coalesce(same_language(lang, cached), F.lit(False)), auto).otherwise(url)


def arguments(x: Column) -> Column:
    """Map of ``a=b&c=d`` without quotes; keys aren't decoded."""
    return F.str_to_map(F.replace(x, F.lit('"'), F.lit("")), F.lit("&"), F.lit("="))
