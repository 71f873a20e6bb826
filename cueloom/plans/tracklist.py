"""Player metadata: caption tracks, audio tracks and translation languages, in JSON and protobuf bodies.

JSON members are read as variants and put back where they were, so what isn't named here stays. All JSON rewrites are built-in
expressions; each level of a body is parsed once.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.members import at_path, constant, with_elements, with_members
from ..sources import protobuf
from .languages import CODES, DESKTOP, MOBILE

#: Hosts of mobile players, whose language names come as runs.
MOBILE_HOSTS = ("m.youtube.com", "youtubei.googleapis.com")
#: Where a track list is in the bodies of the player endpoint, and of the one that answers several requests.
PLAYER, WATCH = ("captions", "playerCaptionsTracklistRenderer"), ("contents", 0, "playerResponse", "captions", "playerCaptionsTracklistRenderer")
WATCH_PATH = "/youtubei/v1/get_watch"

def language_names(host: str) -> list[dict]:
    """The language table as the host's player reads it."""
    if host in MOBILE_HOSTS:
        return [{"languageCode": k, "languageName": {"runs": [{"text": v}]}} for k, v in MOBILE.items()]
    return [{"languageCode": k, "languageName": {"simpleText": v}} for k, v in DESKTOP.items()]


def is_mobile(host: Column) -> Column:
    return F.coalesce(host.isin(*MOBILE_HOSTS), F.lit(False))


def with_all_captions(track_list: Column, host: Column) -> Column:
    """A track list's JSON text: every track translatable, every audio track with visible captions on, the host's languages,
    and a default track."""
    dump = lambda h: F.lit(json.dumps(language_names(h), ensure_ascii=False))
    audio = {"visibility": constant("2"), "hasDefaultTrack": constant("true"), "captionsInitialState": constant("3")}
    return with_members(
        track_list,
        {
            "captionTracks": lambda x: with_elements(x, lambda t: with_members(t, {"isTranslatable": constant("true")})),
            "audioTracks": lambda x: with_elements(x, lambda t: with_members(t, audio)),
            "translationLanguages": lambda x: F.when(is_mobile(host), dump(MOBILE_HOSTS[0])).otherwise(dump("")),
            "defaultCaptionTrackIndex": lambda x: F.when(x.isNull() | x.isin("null", "0", '""', "false"), "0"),
        },
    )


def rewritten(df: DataFrame, body: str = "body", host: str = "host", path: str | None = None) -> DataFrame:
    """The JSON bodies with captions turned on; a body without a track list stays as it is. ``path`` names a column with the
    URL's path; without it, bodies are those of the player endpoint."""
    change = lambda x: with_all_captions(x, F.col(host))
    made = at_path(PLAYER, change)(F.col(body))
    there = F.get_json_object(body, "$." + ".".join(PLAYER)).isNotNull()
    if path is not None:
        watch = F.coalesce(F.col(path) == WATCH_PATH, F.lit(False))
        made = F.when(watch, at_path(WATCH, change)(F.col(body))).otherwise(made)
        there = F.when(watch, F.get_json_object(body, "$.contents[0].playerResponse.captions.playerCaptionsTracklistRenderer").isNotNull()).otherwise(there)
    return df.withColumn(body, F.when(there, F.coalesce(made, F.col(body))).otherwise(F.col(body)))


def _track_list(fields: list, host: str | None) -> list:
    """The same for the fields of a protobuf track list; other fields stay."""
    out = []
    for number, wire, value in fields:
        if number == 1:
            value = protobuf.write(protobuf.with_int(protobuf.read(value), 7, 1))
        elif number == 2:
            track = protobuf.read(value)
            for field, to in ((5, 2), (6, 1), (11, 3)):
                track = protobuf.with_int(track, field, to)
            value = protobuf.write(track)
        if number != 3:
            out.append((number, wire, value))
    names = MOBILE if host in MOBILE_HOSTS else DESKTOP
    out += [(3, protobuf.BYTES, protobuf.from_dict({"languageCode": k, "languageName": {"runs": [{"text": v}]}}, protobuf.LANGUAGE)) for k, v in names.items()]
    return out if any(n == 6 and v for n, _, v in out) else protobuf.with_int(out, 6, 0)


def binary_rewritten(df: DataFrame, body: str = "body", host: str = "host", watch: bool = False) -> DataFrame:
    """The same for protobuf bodies of the player endpoint, or of the one that answers several requests."""
    path = [10, 51621377]
    return df.withColumn(body, protobuf.changed(F.col(body), [1, 2, *path] if watch else path, _track_list, F.col(host)))


def requests_with_captions(body: Column) -> Column:
    """A request's JSON text with captions on by default where it has a playback context; else as it is."""
    change = lambda x: with_members(x, {"autoCaptionsDefaultOn": constant("true")})
    return F.coalesce(at_path(("playbackContext", "contentPlaybackContext"), change)(body), body)


def _flags(fields: list) -> list:
    for number in (4, 6, 8, 9):
        fields = protobuf.with_int(fields, number, 1)
    return fields


def binary_requests_with_captions(body: Column) -> Column:
    """The same for protobuf requests, which number their flags."""
    return protobuf.changed(body, [4, 1], _flags)


def service_code(code: Column) -> Column:
    table = F.create_map(*(x for k, v in CODES.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(table, F.upper(code)), code)
