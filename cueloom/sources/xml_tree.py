"""XML of any form as JSON and back, for documents whose elements aren't known beforehand.

An element is an object: ``@name`` holds an attribute, ``#`` its text, and a child stands under its tag, several of one tag as
an array. An empty element has a null text, a bare attribute is null, an element without attributes and content that closes
itself is ``{tag: null}`` and stands with the sibling before it, which keeps inline breaks in place. Comments, CDATA sections,
declarations and processing instructions are strings under ``!--``, ``!CDATA``, ``!DOCTYPE`` and ``?name``. The order of
siblings with different tags is that in which a tag first came.

Reading is tolerant: closing tags match in any case, one that doesn't match its element closes elements up to the one that it
matches, and what is open at the end is closed. ``link`` never has content. Indentation goes, as do tabs and line ends around
text. Writing drops tabs and line ends and escapes nothing, so that texts that are markup already stay so.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .entities import decoded

_MARK = re.compile(
    r"""<!--(?P<note>.*?)-->
      | <!\[CDATA\[(?P<data>.*?)\]\]>
      | <!(?P<kind>[A-Za-z]+)\s*(?P<said>[^\[<>]*(?:\[[^\]]*\])?[^<>]*)>
      | <\?(?P<target>[^\s?]*)(?P<order>.*?)\?>
      | </(?P<close>[^\s>]*)[^>]*>
      | <(?P<open>[^\s<>/'"=!?]+)(?P<inside>(?:[^<>'"]|'[^']*'|"[^"]*")*)>""",
    re.VERBOSE | re.DOTALL,
)
_PAIR = re.compile(r"""([^\s='"]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s'"]*)))?""")
_INDENT = re.compile(r"(?m)^[ \t]+")
VOID = {"link"}


def _put(into: dict, key: str, value, beside: str | None = None) -> None:
    """A further value of a key goes to an array; nothing and an empty text give way to it."""
    beside = beside or key
    held = into.get(beside)
    if isinstance(held, list):
        held.append(value)
    elif held is None or held == "":
        into[key] = value
    else:
        into[beside] = [held, value]


class _Open:
    """An element being read: its object, and the tag of its last child."""

    def __init__(self, tag: str, inside: str):
        self.tag, self.last, self.empty = tag, None, True
        self.object: dict = {}
        for m in _PAIR.finditer(inside):
            given = next((g for g in m.groups()[1:] if g is not None), None)
            _put(self.object, f"@{m[1]}", None if given is None else decoded(given))

    def text(self, raw: str) -> None:
        if raw := raw.strip("\r\n\t"):
            _put(self.object, "#", decoded(raw))
            self.last, self.empty = None, False

    def child(self, tag: str, value) -> None:
        alone = isinstance(value, dict) and value == {tag: None}
        _put(self.object, tag, value, self.last if alone else None)
        self.last, self.empty = tag, False

    def done(self) -> dict:
        if self.empty:
            _put(self.object, "#", None)
        return self.object


def parse(text: str) -> dict:
    text = _INDENT.sub("", text)
    stack, at = [_Open("", "")], 0
    for m in _MARK.finditer(text):
        top = stack[-1]
        top.text(text[at : m.start()])
        at = m.end()
        if m["open"]:
            closes, inside = m["inside"].endswith("/"), m["inside"].rstrip().removesuffix("/")
            made = _Open(m["open"], inside)
            if closes or made.tag in VOID:
                top.child(made.tag, made.object or {made.tag: None})
            else:
                stack.append(made)
        elif m["close"] is not None:
            tag = m["close"].lower()
            if any(x.tag.lower() == tag for x in stack[1:]):
                while len(stack) > 1:
                    ended = stack.pop()
                    stack[-1].child(ended.tag, ended.done())
                    if ended.tag.lower() == tag:
                        break
        elif m["note"] is not None:
            top.child("!--", m["note"])
        elif m["data"] is not None:
            top.child("!CDATA", m["data"])
        elif m["target"] is not None:
            top.child(f"?{m['target']}", m["order"].strip())
        else:
            top.child(f"!{m['kind']}", m["said"].strip())
    stack[-1].text(text[at:])
    while len(stack) > 1:
        ended = stack.pop()
        stack[-1].child(ended.tag, ended.done())
    return stack[0].object


def _written(tag: str, value) -> str:
    if isinstance(value, list):
        return "".join(_written(tag, v) for v in value)
    if tag == "#":
        return "" if value is None else str(value)
    if isinstance(value, dict):
        if len(value) == 1 and next(iter(value.values())) is None and next(iter(value))[0] not in "@#":
            return f"<{next(iter(value))}/>"
        head = "".join(f' {k[1:]}="{v}"' if v is not None else f" {k[1:]}" for k, v in value.items() if k[0] == "@")
        inner = [(k, v) for k, v in value.items() if k[0] != "@"]
        if not inner:
            return f"<{tag}{head}>" if tag in VOID else f"<{tag}{head}/>"
        return f"<{tag}{head}>{''.join(_written(k, v) for k, v in inner)}</{tag}>"
    if tag == "!--":
        return f"<!--{value}-->"
    if tag == "!CDATA":
        return f"<![CDATA[{value}]]>"
    if tag[0] == "?":
        return f"<{tag} {value}?>"
    if tag[0] == "!":
        return f"<{tag} {value}>"
    return f"<{tag}/>" if value is None else f"<{tag}>{value}</{tag}>"


def stringify(tree: dict) -> str:
    return "".join(_written(k, v) for k, v in tree.items()).translate({9: None, 10: None})


def xml_to_json(body: Column) -> Column:
    """The document as JSON, which ``parse_json`` and ``get_json_object`` read; null stays null."""

    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if t is None else json.dumps(parse(t), ensure_ascii=False) for t in x.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(body)


def json_to_xml(tree: Column) -> Column:
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if t is None else stringify(json.loads(t)) for t in x.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(tree)
