"""Classes of caption tracks."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of broadcast tracks, after compatibility normalisation and upper-casing.
BROADCAST_NAMES = [
    r"(?:^|[^A-Z0-9])CC[1-4](?:$|[^0-9])",
    r"(?:^|[^A-Z0-9])(?:DTVCC|SERVICE)[\s._#:-]*(?:[1-9]|[1-5]\d|6[0-3])(?:$|[^0-9])",
    r"(?:CEA|EIA)[\s._/-]*(?:608|708)",
    r"(?:EMBEDDED[\s._-]*(?:608(?:\s*[/+&]\s*708)?|708)|(?:608(?:\s*[/+&]\s*708)?|708)[\s._-]*EMBEDDED|LINE[\s._-]*21)",
]


@F.pandas_udf(T.StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Unicode compatibility normalisation, which neither Spark nor SQL has; only needed where a text isn't ASCII."""
    return x.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def is_broadcast_name(name: Column, ascii_only: bool = False) -> Column:
    """Whether a track's name is that of a broadcast caption service."""
    name = F.coalesce(name, F.lit(""))
    upper = F.upper(name if ascii_only else nfkc(name))
    out = F.lit(False)
    for pattern in BROADCAST_NAMES:
        out = out | upper.rlike(pattern)
    return out


def has_roll_up(has_window: Column, cues: Column, refers: Callable[[Column], Column]) -> Column:
    """Whether a body has a window and a cue that refers to one."""
    return F.coalesce(has_window & F.exists(cues, refers), F.lit(False))


def caption_mode(automatic: Column, broadcast: Column) -> Column:
    return F.when(automatic, "automatic").when(broadcast, "broadcast").otherwise("official")
