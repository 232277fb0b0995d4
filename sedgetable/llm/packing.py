"""Packing of documents into fixed windows by lexical retrieval.

Documents are tokenised once; windows that a long document fills alone are cut off
at once, and the rest, shorter than a window, is dealt to shards of bounded size. In
each shard a BM25 inverted index over token ids, with document frequencies of the
whole corpus, returns the unused neighbours of a seed, best first. They fill the
seed's window greedily; the one that does not fit is cut, and what is left of it
seeds the next window. So only the last window of a shard is padded.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import tokenizers
from pyspark.sql import DataFrame, functions as F

from sedgetable.llm.bpe import WHITE, Recent, byte_alphabet
from sedgetable.llm.words import LEFT, LOWER, SPACES, Words, handed_back, joined, kept_in_worker, portions, stored, words_of

SHARD_TOKENS = 1 << 20
FEW = 32  # neighbours that mostly fill a window
PORTION = 2 << 20  # text whose words are held as arrays at once
K1, B = 1.2, 0.75
KEPT, KEPT_BYTES = 1 << 20, 16 << 20  # pieces and their bytes that are remembered
AT_ONCE = 1 << 17  # bytes of pieces that the model gets in one call
SHORT = 16  # pieces up to here are compared as two numbers
# Bytes of words that go to the library whole; letters, digits and other signs of the rest.
# Of two-byte characters those from U+00C0 to U+017F are letters that are composed and fold alone, but for three.
LEADS = np.zeros(256, bool)
LEADS[0xC3:0xC6] = True
ODD = np.ones(256, bool)
ODD[33:127], ODD[SPACES], ODD[0x80:0xC0], ODD[LEADS] = False, False, False, False
ODD[[ord("'"), ord("<")]] = True
ODD_PAIRS = np.array([0xC397, 0xC3B7, 0xC4B0])
DIGIT = 2
SORTS = np.where(SPACES, 0, 3).astype(np.uint8)
SORTS[[*range(65, 91), *range(97, 123)]], SORTS[48:58], SORTS[0x80:] = 1, DIGIT, 1
PAIRS = np.arange(1 << 16, dtype=np.uint16)  # two-byte characters, folded
for _c in map(chr, range(0xC0, 0x180)):
    if len(_c.lower().encode()) == 2:
        PAIRS[int.from_bytes(_c.encode())] = int.from_bytes(_c.lower().encode())
LATIN = "\u024f"
ODD_SPACES = ("\x1c", "\x1d", "\x1e", "\x1f")
SPELT = np.array([ord(c) for c in byte_alphabet()], "<u4")
SPELT[ord(" ")] = ord(" ")  # stands between pieces, never in one


class Numbered:
    """Numbers of pieces in a table of open addresses; a piece is two numbers that hold all its bytes."""

    def __init__(self, most: int):
        self.held, self.mask = 0, (1 << (2 * most - 1).bit_length()) - 1
        self.low, self.high = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.uint64)
        self.number = np.full(self.mask + 1, -1, np.int32)

    def _found(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each piece, -1 if it has none, and the slot where it is or would be."""
        slot = (joined(low, high) & np.uint64(self.mask)).astype(np.int64)
        number = self.number[slot]
        left = np.flatnonzero((number >= 0) & ((self.low[slot] != low) | (self.high[slot] != high)))
        while len(left):
            slot[left] = at = (slot[left] + 1) & self.mask
            number[left] = n = self.number[at]
            left = left[(n >= 0) & ((self.low[at] != low[left]) | (self.high[at] != high[left]))]
        return number, slot

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self._found(low, high)[0]

    def add(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> None:
        """Different pieces that have no number yet; the table grows before it is three quarters full."""
        if 4 * (self.held + len(low)) > 3 * self.mask:
            old = np.flatnonzero(self.number >= 0)
            low, high, number = (np.concatenate(x) for x in ((self.low[old], low), (self.high[old], high), (self.number[old], number)))
            self.__init__(len(low))
        self.held += len(low)
        slot, left = self._found(low, high)[1], np.arange(len(low))
        while len(left):
            at = slot[left]
            free = self.number[at] < 0
            self.number[at[free]] = number[left[free]]
            won = self.number[at] == number[left]
            self.low[at[won]], self.high[at[won]] = low[left[won]], high[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & self.mask


class WordIds:
    """Ids of a ``tokenizers`` file whose pieces never cross white space and end in a suffix, as little-endian unsigned bytes.

    Each different piece goes to the library's own model once and is remembered by its
    bytes until the memory is full; then all are forgotten. A piece has a number ``p``;
    its ids are ``flat[begin[p]:begin[p + 1]]``.
    """

    def __init__(self, path: str):
        self.whole = tokenizers.Tokenizer.from_file(path)
        self.runs, self.words = Recent(), Recent()
        self.size = self.whole.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.not_white = regex.compile(f"[^{WHITE}]+")
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.alphabet = byte_alphabet()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.bare = tokenizers.Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = tokenizers.pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.size, bool)  # every piece's last token, and no other, has the suffix
        self.ends[[i for token, i in vocabulary.items() if token.endswith(self.whole.model.end_of_word_suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.short, self.long, self.long_bytes = Numbered(KEPT), {}, 0
        self.begin, self.flat = np.zeros(1, np.int64), np.zeros(0, self.kind)

    def _word(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() and piece.isprintable() else "".join([self.alphabet[b] for b in piece.encode()])  # visible ASCII stands for itself
        return array(self.code, [t.id for t in self.whole.model.tokenize(mapped)]).tobytes()

    def _run(self, run: str) -> bytes:
        """Latin text up to U+024F is composed already and folds letter by letter; anything else goes through the library's own steps."""
        if max(run) > LATIN or "<|" in run:
            return np.array(self.whole.encode(run, add_special_tokens=False).ids, self.kind).tobytes()
        run = run.lower()
        pieces = [run] if run.isalpha() else [run[:-1], run[-1]] if run[-1] in ",.;:!?" and run[:-1].isalpha() else self.pieces.findall(run)
        get, keep = self.words.young.get, self.words.keep
        return b"".join([get(piece) or keep(piece, lambda: self._word(piece)) for piece in pieces])

    def _kept(self, run: str) -> bytes:
        return self.runs.keep(run, lambda: self._run(run))

    def encode(self, text: str) -> bytes:
        odd = any(c in text for c in ODD_SPACES)
        get, kept = self.runs.young.get, self._kept
        return b"".join([get(run) or kept(run) for run in (self.not_white.findall(text) if odd else text.split())])

    def _remember(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, ids])

    def _spell(self, words: Words, at: np.ndarray) -> None:
        """Remembers the ids of the pieces at these places, through the model by itself and many at once."""
        size = words.end[at] - words.start[at]
        after = np.cumsum(size + 1)
        sizes, made, lo = [], [], 0
        while lo < len(at):
            done = after[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(after, done + AT_ONCE, "right")))
            places = np.repeat(words.start[at[lo:hi]] - after[lo:hi] + size[lo:hi] + 1, size[lo:hi] + 1) + np.arange(done, after[hi - 1])
            spelt = SPELT[words.data[np.minimum(places, len(words.data) - 1)]]
            spelt[after[lo:hi] - 1 - done] = ord(" ")
            text = spelt[:-1].tobytes().decode("utf-32-le")
            ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            sizes.append(np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))
            made.append(ids)
            lo = hi
        if made:
            self._remember(np.concatenate(sizes), np.concatenate(made))

    def _numbers(self, words: Words, whole: np.ndarray) -> np.ndarray:
        """Number of each piece; those without one get theirs."""
        size = words.end - words.start
        padded = np.concatenate([words.data, np.zeros(SHORT, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        low = eight[words.start] & LEFT[np.minimum(size, 8)]
        high = np.zeros(len(size), np.uint64)
        some = np.flatnonzero(size > 8)
        high[some] = eight[words.start[some] + 8] & LEFT[np.minimum(size[some] - 8, 8)]
        number = self.short.find(low, high)
        odd = whole | (size > SHORT)
        fresh = np.flatnonzero((number < 0) & ~odd)
        fresh = fresh[np.lexsort((high[fresh], low[fresh]))]
        first = np.ones(len(fresh), bool)
        first[1:] = (low[fresh[1:]] != low[fresh[:-1]]) | (high[fresh[1:]] != high[fresh[:-1]])
        made = len(self.begin) - 1 + np.cumsum(first) - 1
        number[fresh] = made
        new = fresh[first]
        self._spell(words, new)
        self.short.add(low[new], high[new], made[first])

        rest = np.flatnonzero(odd)
        spelt = [words.data[s:e].tobytes() for s, e in zip(words.start[rest].tolist(), words.end[rest].tolist())]
        own = len(self.begin) - 1
        keys = list(zip(spelt, whole[rest].tolist()))
        first_at = {key: at for key, at in zip(keys, rest.tolist()) if key not in self.long}
        plain, others = ([key for key in first_at if key[1] == w] for w in (False, True))
        self._spell(words, np.array([first_at[key] for key in plain], np.int64))
        blobs = [self.encode(w.decode()) for w, _ in others]
        self._remember(np.array([len(b) // self.kind.itemsize for b in blobs], np.int64), np.frombuffer(b"".join(blobs), self.kind))
        self.long.update(zip([*plain, *others], range(own, len(self.begin) - 1)))
        self.long_bytes += sum(len(w) for w, _ in first_at)
        number[rest] = [self.long[key] for key in keys]
        return number

    def encode_all(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with ``end`` after its own, and where each text's begin; the last bound is the end of all.

        Each different piece is encoded once; ids are then gathered for all pieces together.
        """
        if len(self.begin) > KEPT or len(self.flat) > KEPT_BYTES or self.long_bytes > KEPT_BYTES:
            self.forget()
        words, whole = _pieces(texts)
        number = self._numbers(words, whole)
        begin = self.begin[number]
        count = self.begin[number + 1] - begin
        after = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(begin - after[:-1], count) + np.arange(after[-1])]
        cuts = after[words.first]
        return np.insert(ids, cuts[1:], end), cuts + np.arange(len(cuts))


def _pieces(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Pieces of the texts, and which of them are whole words for the library's own steps.

    A word of printable ASCII and Latin letters up to U+017F, without an apostrophe or
    ``<``, is folded and falls into runs of letters, single digits and runs of other
    signs. Any other one stays whole.
    """
    words = words_of(texts)
    raw = words.data
    data, sort = LOWER[raw], SORTS[raw]
    pair = np.flatnonzero(LEADS[raw])
    second = np.minimum(pair + 1, len(raw) - 1)
    code = raw[pair].astype(np.uint16) << 8 | raw[second]
    lone = np.flatnonzero((raw >= 0x80) & (raw < 0xC0))
    lone = lone[~LEADS[raw[np.maximum(lone - 1, 0)]]]
    odd = np.zeros(len(words.start), bool)
    for signs in (np.flatnonzero(ODD[raw]), pair[np.isin(code, ODD_PAIRS) | (code & 0xC0 != 0x80)], lone):
        odd[np.searchsorted(words.start, signs, "right") - 1] = True
    data[pair], data[second] = PAIRS[code] >> 8, PAIRS[code] & 255
    begins = sort > 0
    begins[1:] &= (sort[1:] != sort[:-1]) | (sort[1:] == DIGIT)
    start, size = words.start[odd], (words.end - words.start)[odd]
    inside = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    data[inside], begins[inside] = raw[inside], False
    first_of_word = np.zeros(len(data), bool)
    first_of_word[words.start] = True
    start = np.flatnonzero(begins | first_of_word)
    leads = np.flatnonzero(first_of_word[start])  # the first piece of each word
    end = np.append(start[1:], 0)[: len(start)]
    last = np.append(leads[1:], len(start))[: len(leads)] - 1
    end[last] = words.end
    of_word = np.repeat(odd, np.diff(np.append(leads, len(start))))
    return Words(data, start, end, np.append(leads, len(start))[words.first]), of_word


@lru_cache(maxsize=1)
def loaded(path: str) -> WordIds:
    return WordIds(path)


def _holders(ids: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """How many of the runs ``ids[begin:end]`` hold each id below ``size``."""
    count = end - begin
    kind = np.uint32 if size * len(count) < 1 << 32 else np.uint64
    pairs = np.repeat(np.arange(len(count), dtype=kind) * kind(size), count)
    pairs += ids[np.repeat(begin - np.cumsum(count) + count, count) + np.arange(len(pairs))]
    pairs.sort()
    first = np.ones(len(pairs), bool)
    first[1:] = pairs[1:] != pairs[:-1]
    return np.bincount((pairs[first] % kind(size)).astype(np.int64), minlength=size)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenised(path: str, end: int, window: int):
    """Rows for the shards: whole windows as they are (no ids), the rest with its ids; then document frequencies."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = loaded(path)
        kept_in_worker["packing"] = loaded.cache_clear
        frequency = np.zeros(max(words.size, end + 1), np.int64)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "token", "df"]
        kinds = [pa.int64()] * 5 + [pa.binary(), pa.int64(), pa.int64()]
        for batch in batches:
            out: list[tuple] = []
            keys = iter(batch.column(0).to_pylist())
            for part in portions(batch.column(1), PORTION):
                every, cuts = words.encode_all(part, end)
                wide = every.astype("<u4")
                for lo, hi in zip(cuts.tolist(), cuts[1:].tolist()):
                    key, n = next(keys), hi - lo
                    rest = hi - n % window
                    out += [(key, s - lo, window, zlib.crc32(wide[s : s + window]), n, None) for s in range(lo, rest, window)]
                    if rest < hi:
                        out.append((key, rest - lo, hi - rest, zlib.crc32(wide[rest:hi]), n, every[rest:hi].tobytes()))
                frequency += _holders(every, cuts[1:] - np.diff(cuts) % window, cuts[1:], len(frequency))
            if out:
                cols = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(out), kinds[6]), pa.nulls(len(out), kinds[7])], names)
        words.runs = Recent()  # the worker lives on; later tasks need its memory
        handed_back()
        seen = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(seen), k) for k in kinds[:6]] + [pa.array(seen), pa.array(frequency[seen])], names)

    return rows


class Index:
    """BM25 inverted index of one shard; postings carry finished weights."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        n = len(docs)
        sizes = np.array([len(d) for d in docs])
        kind = np.uint32 if len(idf) * n < 1 << 32 else np.uint64
        pairs = np.concatenate(docs).astype(kind) * kind(n) + np.repeat(np.arange(n, dtype=kind), sizes)
        pairs, tf = np.unique(pairs, return_counts=True)
        pairs = pairs.astype(np.int64)
        term, self.doc = pairs // n, pairs % n
        useful = idf[term] > 0
        term, self.doc, tf = term[useful], self.doc[useful], tf[useful]
        norm = K1 * (1 - B + B * sizes / max(mean_length, 1e-9))
        self.weight = idf[term] * tf * (K1 + 1) / (tf + norm[self.doc])
        self.terms, self.begin, self.count = np.unique(term, return_index=True, return_counts=True)
        order = np.argsort(self.doc, kind="stable")
        self.of_doc = np.split(np.searchsorted(self.terms, term)[order], np.searchsorted(self.doc[order], np.arange(1, n)))
        self.n, self.steps = n, np.arange(len(self.doc))

    def drop(self, used: np.ndarray) -> None:
        """Leaves the postings of used documents out; no score of another one changes."""
        keep = ~used[self.doc]
        kept = np.concatenate([[0], np.cumsum(keep)])
        self.count = kept[self.begin + self.count] - kept[self.begin]
        self.begin = kept[self.begin]
        self.doc, self.weight = self.doc[keep], self.weight[keep]

    def neighbours(self, seed: int, used: np.ndarray, most: int | None = None) -> np.ndarray:
        """Unused documents that share a weighted term with the seed, best first, ties by position.

        With ``most``, only so many and the ties of the last.
        """
        at = self.of_doc[seed]
        if not len(at):
            return at
        count = self.count[at]
        rows = np.repeat(self.begin[at] - np.cumsum(count) + count, count)
        rows += self.steps[: len(rows)]
        score = np.bincount(self.doc[rows], self.weight[rows], self.n)
        score[used] = 0
        found = np.flatnonzero(score)
        worth = -score[found]
        if most is not None and most < len(found):
            some = worth <= np.partition(worth, most - 1)[most - 1]
            found, worth = found[some], worth[some]
        return found[np.argsort(worth, kind="stable")]


def _ranked(index: Index, seed: int, used: np.ndarray) -> Iterator[int]:
    """The seed, then its unused neighbours: the best few, and all others only if more are asked for."""
    yield seed
    yield from index.neighbours(seed, used, FEW).tolist()
    yield from index.neighbours(seed, used).tolist()


def _placed(lengths: np.ndarray, index: Index, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces as (document, start in it, length, window, offset)."""
    used = np.zeros(len(lengths), bool)
    out, number, room, first, unused = [], 0, window, 0, len(lengths)
    seed, done = -1, 0
    while True:
        if seed < 0:
            while first < len(lengths) and used[first]:
                first += 1
            if first == len(lengths):
                return out
            seed = first
            used[seed] = True
        still = len(used) - np.count_nonzero(used)
        if still < 0.8 * unused:
            index.drop(used)
            unused = still
        ranked = _ranked(index, seed, used)
        seed = -1
        for doc in ranked:
            used[doc] = True
            left = int(lengths[doc]) - done
            take = min(left, room)
            out.append((int(doc), done, take, number, window - room))
            room -= take
            done = done + take if take < left else 0
            if not room:
                number, room = number + 1, window
                seed = int(doc) if done else -1
                break


def packed(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = 1, window: int = 2048) -> DataFrame:
    """One row per piece: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every id of a document, with ``end`` after its own, lies in exactly one piece.
    Null texts pack as empty ones: just the end id. Repeated rows are packed each.
    Other columns are not read. Sequence ids are unique, not consecutive.
    """
    names = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary, token bigint, df bigint"
    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = stored(source.mapInArrow(_tokenised(path, end, window), names), "tokens")
    pieces = rows.filter("token is null").drop("token", "df")
    counts = pieces.agg(F.count("ids").alias("n"), F.coalesce(F.sum(F.when(F.col("ids").isNotNull(), F.col("length"))), F.lit(0)).alias("t"), F.count("*").alias("rows")).first()
    frequencies = rows.filter("token is not null").groupBy("token").agg(F.sum("df").alias("df")).collect()  # at most one row per vocabulary entry
    idf = np.zeros(max([end, *(r["token"] for r in frequencies)]) + 1, np.float32)
    for r in frequencies:
        idf[r["token"]] = max(0.0, np.log((counts["n"] - r["df"] + 0.5) / (r["df"] + 0.5)))
    mean = counts["t"] / max(1, counts["n"])
    shards = max(1, -(-counts["t"] // SHARD_TOKENS), -(-counts["rows"] // SHARD_TOKENS))

    def pack(table: pa.Table) -> pa.Table:
        handed_back()
        kind = loaded(path).kind
        shard = table["shard"][0].as_py()
        whole = table.filter(pa.compute.is_null(table["ids"]))
        rest = table.filter(pa.compute.is_valid(table["ids"])).sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        out = [pa.table({**{c: whole[c] for c in columns}, "sequence_id": pa.array((shard << 32) + np.arange(len(whole))), "offset": pa.array(np.zeros(len(whole), np.int64))})]
        if len(rest):
            ids = [np.frombuffer(b.as_buffer(), kind) for b in rest["ids"]]
            made = _placed(np.array([len(i) for i in ids]), Index(ids, idf, mean), window)
            doc, start, length, number, offset = np.array(made, np.int64).T
            crcs = [_crc(ids[d][s : s + n]) for d, s, n in zip(doc, start, length)]
            some = rest.take(pa.array(doc))
            out.append(pa.table({"doc_id": some["doc_id"], "start": pa.array(some["start"].to_numpy() + start), "length": pa.array(length), "ids_crc32": pa.array(crcs, pa.int64()), "doc_tokens": some["doc_tokens"], "sequence_id": pa.array((shard << 32) + len(whole) + number), "offset": pa.array(offset)}))
        return pa.concat_tables(out)

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "ids_crc32", "start"), F.lit(shards)).cast("bigint"))
    made = dealt.groupBy("shard").applyInArrow(pack, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return made.withColumnRenamed("doc_id", key)
