"""Byte-level BPE encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged across, so
every such pair marks a certain cut. A text is cut into special tokens, then into
pieces by the pre-tokenizer, then at the forced boundaries; each fragment is merged
on its own and the ids are concatenated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain
from typing import Any

import pyarrow as pa
import regex
from pyspark.sql import Column, functions as F

# White space of the Unicode White_Space property, and the public
# pre-tokenizer pattern and byte alphabet of byte-level BPE.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 1 << 18
NONE = 1 << 62
LOW = (1 << 32) - 1
WIDE = 20
HEAP_FROM = 200


def byte_alphabet() -> list[str]:
    """Printable stand-in of every byte: itself where visible, else the next free code point from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else free))
        free += b not in shown
    return out


class Recent:
    """Cache of bounded memory: when the young half is full, it becomes the old one."""

    def __init__(self, size: int = CACHE) -> None:
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def keep(self, key: str, make: Callable) -> Any:
        value = self.young.get(key) or self.old.get(key) or make()
        if len(key) <= 64:
            if len(self.young) >= self.size:
                self.young, self.old = {}, self.young
            self.young[key] = value
        return value


class ByteBpe:
    """Encoder and decoder of one public ``tokenizers`` file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        to_byte = {c: b for b, c in enumerate(alphabet)}
        self.byte_ids = [vocab[c] for c in alphabet]
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[a] << WIDE | vocab[b], rank << 32 | vocab[a + b])
        self.token_bytes = {i: bytes(to_byte[c] for c in token) for token, i in vocab.items()}
        inside = bytearray(1 << 16)
        for token in self.token_bytes.values():
            for a, b in zip(token, token[1:]):
                inside[a << 8 | b] = 1
        self.inside = bytes(inside)
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = specials
        self.token_bytes.update((i, s.encode()) for s, i in specials.items())
        longest_first = sorted(specials, key=len, reverse=True)
        self.special_cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if specials else None
        self.pieces = regex.compile(PIECES)
        self.ints = list(range(max(self.token_bytes) + 1))
        self.bare, self.spaced, self.known = Recent(1 << 14), Recent(2 * CACHE), Recent()

    def forced_fragments(self, piece: bytes) -> list[bytes]:
        """Cut between two bytes that no token holds side by side."""
        inside = self.inside
        cuts = [k for k, (a, b) in enumerate(zip(piece, piece[1:]), 1) if not inside[a << 8 | b]]
        return [piece[a:b] for a, b in zip([0, *cuts], [*cuts, len(piece)])] if cuts else [piece]

    def merged(self, fragment: bytes) -> list[int]:
        """Ids by the rule itself: the pair of lowest rank merges first, the leftmost of equals."""
        ids = [self.byte_ids[b] for b in fragment]
        get = self.merges.get
        ranks = [get(a << WIDE | b, NONE) for a, b in zip(ids, ids[1:])]
        if len(ids) >= HEAP_FROM:
            return self._merged_by_heap(ids)
        while ranks and (best := min(ranks)) != NONE:
            k = ranks.index(best)
            ids[k] = best & LOW
            del ids[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = get(ids[k] << WIDE | ids[k + 1], NONE)
            if k:
                ranks[k - 1] = get(ids[k - 1] << WIDE | ids[k], NONE)
        return ids

    def _piece(self, piece: bytes) -> list[int]:
        """Ids of a pre-tokenizer piece: those of its fragments, one after the other."""
        return [i for f in self.forced_fragments(piece) for i in self.merged(f)]

    def _merged_by_heap(self, ids: list[int]) -> list[int]:
        """Same merges for long fragments in O(n log n): lowest rank first, then leftmost."""
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        get = self.merges.get
        heap = [(r, k) for k in range(n - 1) if (r := get(ids[k] << WIDE | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] < 0 or nxt < 0 or get(ids[k] << WIDE | ids[nxt]) != rank:
                continue
            ids[k], ids[nxt] = rank & LOW, -1
            after[k] = after[nxt]
            if after[k] >= 0:
                before[after[k]] = k
                if (r := get(ids[k] << WIDE | ids[after[k]])) is not None:
                    heapq.heappush(heap, (r, k))
            if before[k] >= 0 and (r := get(ids[before[k]] << WIDE | ids[k])) is not None:
                heapq.heappush(heap, (r, before[k]))
        return [i for i in ids if i >= 0]

    def _pieces(self, chunk: str) -> list[str]:
        """What the pre-tokenizer's pattern finds; letters after at most one space are one piece."""
        if chunk.isalpha() or chunk[:1] == " " and chunk[1:].isalpha():
            return [chunk]
        if chunk[-1] in ",.;:!?" and (chunk[:-1].isalpha() or chunk[:1] == " " and chunk[1:-1].isalpha()):
            return [chunk[:-1], chunk[-1]]
        return self.pieces.findall(chunk)

    def _chunk(self, chunk: str) -> tuple[str, tuple[int, ...]]:
        ids, get, shared = [], self.known.young.get, self.ints  # one object per id keeps cached tuples small
        for piece in self._pieces(chunk):
            found = get(piece) or self.known.keep(piece, lambda: tuple([shared[i] for i in self._piece(piece.encode())]))
            ids += found
        return ",".join(map(str, ids)), tuple(ids)

    def _plain(self, text: str) -> list[tuple[str, tuple[int, ...]]]:
        """Text without special tokens, as (decimal ids, ids) of consecutive chunks.

        A single space always starts a new piece, so the text may be cut before
        every space, unless a space is followed by more white space.
        """
        if not text:
            return []
        if any(f" {c}" in text for c in (WHITE[:6] if text.isascii() else WHITE)):
            return [self._chunk(text)]
        head, *rest = text.split(" ")
        out = [self.bare.keep(head, lambda: self._chunk(head))] if head else []
        get, keep = self.spaced.young.get, self.spaced.keep
        for w in rest:
            if (found := get(w)) is None:
                found = keep(w, lambda: self._chunk(" " + w))
                get = self.spaced.young.get
            out.append(found)
        return out

    def chunks(self, text: str) -> list[tuple[str, tuple[int, ...]]]:
        if self.special_cut is None or not any(s in text for s in self.specials):
            return self._plain(text)
        out = []
        for part in self.special_cut.split(text):
            i = self.specials.get(part)
            out += self._plain(part) if i is None else [(str(i), (i,))]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for _, ids in self.chunks(text) for i in ids]

    def decode(self, ids: list[int]) -> str:
        """Ids outside the vocabulary are left out; bytes that are not UTF-8 become U+FFFD."""
        return b"".join([self.token_bytes.get(i, b"") for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def loaded(path: str) -> ByteBpe:
    return ByteBpe(path)


def encoded(text: Column, path: str) -> Column:
    """``array<int>`` ids of a text; null stays null."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        bpe = loaded(path)
        return pa.array([None if t is None else bpe.encode(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return ids(text)


def decoded(ids: Column, path: str) -> Column:
    """Text of an id array; null stays null."""

    @F.arrow_udf("string")
    def texts(rows: pa.Array) -> pa.Array:
        bpe = loaded(path)
        return pa.array([None if r is None else bpe.decode(r) for r in rows.to_pylist()], pa.string())

    return texts(ids)


def round_trip(text: Column, path: str) -> Column:
    """Encode, then decode the ids: struct of ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    Only digests leave the worker. Null is encoded as the empty text, which has no
    ids. Row order, repeated rows and further columns do not matter.
    """

    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def digests(texts: pa.Array) -> pa.Array:
        bpe = loaded(path)
        counts, of_ids, of_text = [], [], []
        for text in texts:
            chunks = bpe.chunks(text.as_py() or "")
            ids = list(chain.from_iterable([part for _, part in chunks]))
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(",".join([s for s, _ in chunks]).encode()).hexdigest())
            of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        columns = [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
        return pa.StructArray.from_arrays(columns, ["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests(text)
