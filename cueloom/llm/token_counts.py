"""Token counts of whole texts under a public byte-level vocabulary (operator 2).

``count_tokens`` encodes in Arrow functions and returns lengths only. A text is first cut at safe boundaries, places
where the vocabulary's pre-tokenizer always starts a new word: before a space between two characters that aren't white
space, and, for pieces not met before, also between a letter and a full stop or comma and around a single line end.
No token and no special string reaches across such a place, so the counts of the pieces add up to the count of the text.
Pieces met before are looked up; new ones go to ``encode_batch_fast`` in batches of about ``batch_bytes`` bytes, so one
long text costs as much as short ones of the same total length.

Null and empty texts have 0 tokens. A text without a safe boundary is one piece, however long. Special strings inside a
text are taken as the library's default has it (one token). Repeated rows are counted each.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, per_text

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Pieces that a Python worker remembers before it starts anew, and their greatest length.
MEMORY_PIECES, MEMORY_CHARS = 1_500_000, 64

_BESIDE_SPACE = re.compile(r"[\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] | [\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CUT = regex.compile(r"(?<=\S)(?= \S)", regex.V1)
_LINE_CUT = re.compile(r"(?<=\S)(?=\n)|(?<=\S\n)(?=\S)")


def fine_pieces(piece: str) -> list[str]:
    """A piece cut further: before closing punctuation that follows a letter, and around single line ends."""
    if "\n" in piece:
        return [y for x in _LINE_CUT.split(piece) for y in fine_pieces(x)] if "\n" != piece.strip(" ") and _LINE_CUT.search(piece) else [piece]
    core = piece.rstrip(".,")
    return [core, piece[len(core) :]] if core and len(core) < len(piece) and core[-1].isalpha() else [piece]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def safe_pieces(text: str) -> list[str]:
    """The text cut before each single space between two characters that aren't white space."""
    if "  " not in text and text[:1] != " " != text[-1:] and (text.isascii() and "\n " not in text and " \n" not in text and "\t" not in text and "\r" not in text or not _BESIDE_SPACE.search(text)):  # every space is a place to cut
        head, *rest = text.split(" ")
        return [head, *(" " + x for x in rest)]
    return _CUT.split(text)


def balanced(pieces: Iterable[str], limit: int) -> Iterable[list[str]]:
    """Batches of pieces with about as many bytes each."""
    batch: list[str] = []
    size = 0
    for x in pieces:
        n = len(x.encode("utf-8", "surrogatepass"))
        if batch and size + n > limit:
            yield batch
            batch, size = [], 0
        batch.append(x)
        size += n
    if batch:
        yield batch


_known: dict[str, tuple[dict[str, int], dict[str, int]]] = {}
_loaded: dict[str, object] = {}


def counter(path: str, batch_bytes: int) -> Callable[[list[str | None]], list[int]]:
    """A function from texts to token counts; the library is loaded once in a Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if path not in _loaded:
        _loaded[path] = Tokenizer.from_file(path)
    encode = _loaded[path].encode_batch_fast
    known, fine = _known.setdefault(path, ({}, {}))

    def count(texts: list[str | None]) -> list[int]:
        if len(known) + len(fine) > MEMORY_PIECES:
            known.clear()
            fine.clear()
        cut = [safe_pieces(t) if t else [] for t in texts]
        new = set().union(*cut).difference(known)
        parts = {x: fine_pieces(x) for x in new}
        for batch in balanced(set().union(*parts.values()).difference(fine), batch_bytes):
            fine.update(zip(batch, map(len, encode(batch, add_special_tokens=False)), strict=True))
        known.update((x, sum(map(fine.__getitem__, p))) for x, p in parts.items())
        out = [sum(map(known.__getitem__, pieces)) for pieces in cut]
        for x, p in parts.items():  # long pieces aren't kept
            if len(x) > MEMORY_CHARS:
                del known[x]
                for y in p:
                    if len(y) > MEMORY_CHARS:
                        fine.pop(y, None)
        return out

    return count


def count_tokens(df: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT, text: str = "text", batch_bytes: int = 256 << 10) -> DataFrame:
    """Appends ``n_bytes``, ``n_tokens`` and ``over_limit`` to the rows of ``df``; columns of these names are replaced."""
    path = tokenizer_path(tokenizer)

    def make():
        count = counter(path, batch_bytes)

        def run(texts: list[bytes]) -> dict:
            n = count([t.decode("utf-8", "replace") for t in texts])
            return {"n_bytes": [len(t) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return run

    return per_text(df, make, "n_bytes long, n_tokens long, over_limit boolean", text)


def op2_token_counts(spark, sf_dir):
    return count_tokens(documents(spark, sf_dir, "doc_id", "text")).drop("text").select("doc_id", "n_bytes", "n_tokens", F.coalesce("over_limit", F.lit(False)).alias("over_limit"))
