"""Byte-level BPE encoding and decoding (operator 9).

The merges of a word are found with a segment tree over the ranks of its adjacent pairs. A leaf holds
``rank * size + position`` of the pair that starts there, or ``NONE`` where no merge applies, and an inner node the least
of its two children, so the root yields the leftmost pair of lowest rank. A merge changes at most three leaves, each in a
logarithmic number of point updates, and the word is done when the root is ``NONE``. Words of about the same length are
merged in lockstep, one tree a row of a numpy array; few or very long ones go through the same tree one by one.

Texts are cut at safe boundaries (see ``token_counts``), so a Python worker merges each piece it meets only once as long
as it remembers it. Special strings in a text give their own id, as the library does by default. Null and empty texts have
no ids. Decoding joins the tokens' bytes; bytes that aren't UTF-8 become U+FFFD. Ids outside the vocabulary are an error.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import documents, per_text
from .token_counts import safe_pieces, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
#: Pieces that a Python worker remembers before it starts anew, and their greatest length.
MEMORY_PIECES, MEMORY_CHARS = 200_000, 64
#: Symbols in a lockstep block, and the number of words from which lockstep pays.
BLOCK_SYMBOLS, LOCKSTEP_WORDS = 1 << 20, 24

#: Fixed value: the pre-tokenizer's pattern of this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file: itself where it is a visible Latin-1
    character, else the next one from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


class Bpe:
    """Vocabulary, merges and both directions."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.of_byte = np.array([vocab[c] for c in symbols], dtype=np.int64)
        value = {c: b for b, c in enumerate(symbols)}
        self.size = 1 + max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])])
        self.token_bytes: list[bytes | None] = [None] * self.size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(value[c] for c in token)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.digits = [str(i) for i in range(self.size)]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(pairs)), strict=True))
        self.none = len(pairs)
        self.words = regex.compile(PATTERN)
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pieces: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def merge_many(self, words: list[bytes], size: int) -> list[bytes]:
        """Merges words of at most ``size`` bytes in lockstep; ``size`` is a power of two. Ids come as four bytes each."""
        n, none = len(words), self.none * size
        lengths = np.array([len(w) for w in words])
        inside = np.arange(size) < lengths[:, None]
        sym = np.zeros((n, size + 1), dtype=np.int64)
        sym[:, :size][inside] = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        after = np.broadcast_to(np.arange(1, size + 2), (n, size + 1)).copy()
        before = np.broadcast_to(np.arange(-1, size), (n, size + 1)).copy()
        tree = np.full((n, 2 * size), none, dtype=np.int64)
        pair = np.arange(size) < lengths[:, None] - 1
        leaf = tree[:, size:]
        leaf[pair] = (self.rank(sym[:, :size], sym[:, 1:]) * size + np.arange(size))[pair]
        leaf[leaf >= none] = none
        width = size
        while width > 1:
            level = tree[:, width : 2 * width]
            width //= 2
            np.minimum(level[:, 0::2], level[:, 1::2], out=tree[:, width : 2 * width])
        live = np.flatnonzero(tree[:, 1] < none)
        sym1, after1, before1, tree1 = sym.ravel(), after.ravel(), before.ravel(), tree.ravel()
        while len(live):
            root = tree1[live * (2 * size) + 1]
            at = root % size
            row, base = live * (size + 1), live * (2 * size) + size
            right = after1[row + at]
            beyond = after1[row + right]
            left = before1[row + at]
            made = self.merged[root // size]
            sym1[row + at] = made
            after1[row + at] = beyond
            before1[row + np.minimum(beyond, size)] = at
            has_next = beyond < lengths[live]
            rank = np.full(len(live), none, dtype=np.int64)
            if has_next.any():
                rank[has_next] = self.rank(made[has_next], sym1[(row + np.minimum(beyond, size))[has_next]]) * size + at[has_next]
            tree1[base + at] = np.minimum(rank, none)
            tree1[base + right] = none
            has_left = left >= 0
            rank = self.rank(sym1[(row + left)[has_left]], made[has_left]) * size + left[has_left]
            tree1[(base + left)[has_left]] = np.minimum(rank, none)
            # three point updates, level by level
            node = np.concatenate([at, right, left[has_left]]) + size
            own = np.concatenate([live, live, live[has_left]]) * (2 * size)
            while node[0] > 1:
                node >>= 1
                child = own + 2 * node
                tree1[own + node] = np.minimum(tree1[child], tree1[child + 1])
            live = live[tree1[live * (2 * size) + 1] < none]
        alive = np.zeros((n, size + 1), dtype=bool)
        at = np.zeros(n, dtype=np.int64)
        rows = np.arange(n)
        while len(rows):
            alive[rows, at] = True
            at = after[rows, at]
            more = at < lengths[rows]
            rows, at = rows[more], at[more]
        flat = sym[alive].astype("<i4").tobytes()
        ends = (4 * np.cumsum(alive.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merge_one(self, word: bytes) -> bytes:
        """The same tree for one word."""
        n = len(word)
        size = 1 << max(1, (n - 1).bit_length())
        none = self.none * size
        sym = [int(self.of_byte[b]) for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of = self.rank_of
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = rank_of.get(sym[i] << 20 | sym[i + 1])
            if r is not None:
                tree[size + i] = r * size + i
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = size + i
            tree[node] = value
            node >>= 1
            while node:
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    return
                tree[node] = least
                node >>= 1

        while tree[1] < none:
            r, i = divmod(tree[1], size)
            j = after[i]
            sym[i] = made = int(self.merged[r])
            k = after[i] = after[j]
            put(j, none)
            if k < n:
                before[k] = i
                r = rank_of.get(made << 20 | sym[k])
                put(i, none if r is None else r * size + i)
            else:
                put(i, none)
            h = before[i]
            if h >= 0:
                r = rank_of.get(sym[h] << 20 | made)
                put(h, none if r is None else r * size + h)
        out, i = [], 0
        while i < n:
            out.append(sym[i])
            i = after[i]
        return np.array(out, dtype="<i4").tobytes()

    def merge(self, words: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            b = w.encode()
            by_size.setdefault(1 << max(2, (len(b) - 1).bit_length()), []).append((w, b))
        for size, group in by_size.items():
            step = max(1, BLOCK_SYMBOLS // size)
            for a in range(0, len(group), step):
                block = group[a : a + step]
                if len(block) < LOCKSTEP_WORDS:
                    out.update((w, self.merge_one(b)) for w, b in block)
                else:
                    out.update(zip((w for w, _ in block), self.merge_many([b for _, b in block], size), strict=True))
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        if len(self.pieces) + len(self.known) > MEMORY_PIECES:
            self.pieces.clear()
            self.known.clear()
        pieces, known = self.pieces, self.known
        cut = [safe_pieces(t) if t else [] for t in texts]
        new: dict[str, list[str]] = {}
        for x in set().union(*cut).difference(pieces):
            if self.split_special and any(s in x for s in self.special):
                new[x] = [w for i, y in enumerate(self.split_special.split(x)) for w in ([y] if i % 2 else self.words.findall(y))]
            else:
                new[x] = self.words.findall(x)
        known.update((s, i.to_bytes(4, "little")) for s, i in self.special.items())
        made = self.merge([w for w in set().union(*new.values()).difference(known) if w not in pieces])
        for x, words in new.items():
            pieces[x] = made.get(x) or known.get(x) or b"".join(made.get(w) or known.get(w) or pieces[w] for w in words)
        known.update((w, ids) for w, ids in made.items() if w not in pieces)
        out = [np.frombuffer(b"".join(map(pieces.__getitem__, x)), dtype="<i4").tolist() for x in cut]
        for x, words in new.items():  # long ones aren't kept
            if len(x) > MEMORY_CHARS:
                del pieces[x]
                for w in words:
                    if len(w) > MEMORY_CHARS:
                        known.pop(w, None)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary at ``path``, read once in a Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode_texts(df: DataFrame, tokenizer: str = TOKENIZER, text: str = "text") -> DataFrame:
    """Appends ``ids array<int>``."""
    path = tokenizer_path(tokenizer)

    def make():
        bpe = load(path)
        return lambda texts: {"ids": bpe.encode([t.decode() for t in texts])}

    return per_text(df, make, "ids array<int>", text)


def round_trip(df: DataFrame, tokenizer: str = TOKENIZER, text: str = "text") -> DataFrame:
    """Encodes, decodes the ids again, and appends ``n_tokens``, ``ids_sha256`` (decimal ids joined by commas) and
    ``decoded_sha256``; ids and decoded texts don't leave the function."""
    path = tokenizer_path(tokenizer)

    def make():
        bpe = load(path)
        digits = bpe.digits

        def run(texts: list[bytes]) -> dict:
            ids = bpe.encode([t.decode() for t in texts])
            return {
                "n_tokens": [len(x) for x in ids],
                "ids_sha256": [hashlib.sha256(",".join(map(digits.__getitem__, x)).encode()).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids],
            }

        return run

    return per_text(df, make, "n_tokens long, ids_sha256 string, decoded_sha256 string", text)


def op9_bpe_round_trip(spark, sf_dir):
    return round_trip(documents(spark, sf_dir, "doc_id", "text")).drop("text")
