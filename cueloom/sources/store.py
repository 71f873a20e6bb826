"""A key-value table of JSON values, and property lists as JSON."""

from __future__ import annotations

import json
import plistlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.members import with_path, without_path


def _path(key: str) -> tuple[str, list[str]]:
    name, _, path = key.removeprefix("@").partition(".") if key.startswith("@") else (key, "", "")
    return name, path.split(".") if path else []


def get_item(store: DataFrame, key: str) -> Column:
    """Expression over (key, value): the value of ``key``, or of a path in it for ``@key.path``."""
    name, path = _path(key)
    return F.when(F.col("key") == name, F.get_json_object("value", "$." + ".".join(path)) if path else F.col("value"))


def _changed(store: DataFrame, key: str, change: Callable[[Column], Column]) -> DataFrame:
    one = store.sparkSession.createDataFrame([(key,)], "key string").join(store, "key", "left")
    return store.where(F.col("key") != key).unionByName(one.select("key", change(F.col("value")).alias("value")))


def set_item(store: DataFrame, key: str, value: str) -> DataFrame:
    """The table with one value put in, for ``@key.path`` as a string at that path of the key's object."""
    name, path = _path(key)
    return _changed(store, name, lambda old: with_path(F.coalesce(old, F.lit("{}")), path, json.dumps(value)) if path else F.lit(value))


def remove_item(store: DataFrame, key: str) -> DataFrame:
    """The table without a key, or for ``@key.path`` with that path taken out of the key's object."""
    name, path = _path(key)
    return _changed(store, name, lambda old: without_path(F.coalesce(old, F.lit("{}")), path)) if path else store.where(F.col("key") != name)


def clear(store: DataFrame) -> DataFrame:
    return store.limit(0)


@F.pandas_udf(T.StringType())
def plist_to_json(x: pd.Series) -> pd.Series:
    """An XML property list as JSON; null if it isn't one. Dates become ISO strings, data base64."""

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(w) for k, w in v.items()}
        if isinstance(v, list):
            return [plain(w) for w in v]
        if isinstance(v, bytes):
            import base64

            return base64.b64encode(v).decode()
        return v.isoformat() if hasattr(v, "isoformat") else v

    def one(s):
        try:
            return json.dumps(plain(plistlib.loads(s.encode())), ensure_ascii=False)
        except Exception:  # any malformed list is a null, as with from_xml
            return None

    return x.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def json_to_plist(x: pd.Series) -> pd.Series:
    """JSON as an XML property list."""
    return x.map(lambda s: plistlib.dumps(json.loads(s), sort_keys=False).decode(), na_action="ignore")
