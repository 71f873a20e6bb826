"""Character entities of XML."""

from __future__ import annotations

import re

#: Named entities.
NAMED = {"lt": "<", "gt": ">", "apos": "'", "quot": '"', "amp": "&"}
_ENTITY = re.compile(r"&(?:(lt|gt|apos|quot|amp)|#([0-9]{1,6})|#x([0-9A-Fa-f]{1,5}));")


def decoded(text: str) -> str:
    """Five named entities and numeric ones, each once, so that an escaped ampersand doesn't make a new entity. A number that
    is no character stays as it is."""

    def one(m: re.Match) -> str:
        if m[1]:
            return NAMED[m[1]]
        code = int(m[2]) if m[2] else int(m[3], 16)
        return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m[0]

    return _ENTITY.sub(one, text)
