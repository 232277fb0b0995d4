import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tokenizers

from sedgetable.llm import bpe, packing
from pyspark.sql import functions as F

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [*"abAÉ  \n\t'sé中1²½\x1c\x85\xa0 …!İſΣ🙂̂,.;", "<|endoftext|>", "<|startoftext|>", "  ", "'ll", "The "]


def texts(count, seed=3):
    rnd = random.Random(seed)
    made = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(0, 30))) for _ in range(count)]
    return [*made, "", " ", "  x  ", "abcdeft" * 300, "word " * 3000]


def test_byte_ids_equal_the_library():
    mine, library = bpe.ByteBpe(BYTE), tokenizers.Tokenizer.from_file(BYTE)
    for t in texts(1500):
        ids = library.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == ids
        assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False) == t


def test_cut_ids_decode_like_the_library():
    mine, library = bpe.ByteBpe(BYTE), tokenizers.Tokenizer.from_file(BYTE)
    for t in ("é中🙂", "a🙂b"):
        ids = mine.encode(t)
        for k in range(len(ids)):
            assert mine.decode(ids[k:]) == library.decode(ids[k:], skip_special_tokens=False)


def test_fragments_never_split_a_token():
    mine = bpe.ByteBpe(BYTE)
    piece = "thinoré中!!qxz".encode()
    assert b"".join(mine.forced_fragments(piece)) == piece
    assert all(mine.forced_fragments(t) == [t] for t in list(mine.token_bytes.values())[:5000])


def test_long_fragments_merge_alike(monkeypatch):
    mine = bpe.ByteBpe(BYTE)
    rnd = random.Random(5)
    words = ["".join(rnd.choice("thionre") for _ in range(150)).encode() for _ in range(40)]
    short = [mine.merged(w) for w in words]
    monkeypatch.setattr(bpe, "HEAP_FROM", 2)
    assert [mine.merged(w) for w in words] == short


def test_caches_stay_bounded():
    cache = bpe.Recent(10)
    for k in range(1000):
        assert cache.keep(str(k), lambda: k) == k
    assert len(cache.young) + len(cache.old) <= 20


def test_round_trip_rows(spark):
    rows = [(1, "Hello, world"), (2, None), (3, ""), (3, ""), (None, "x <|endoftext|> y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids_sha256", F.lit("clash"))
    out = df.select("doc_id", "text", bpe.round_trip(F.col("text"), BYTE).alias("r")).collect()
    library = tokenizers.Tokenizer.from_file(BYTE)
    assert len(out) == 5
    for r in out:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["r"]["n_tokens"] == len(ids)
        assert r["r"]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["r"]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    ids = df.select(bpe.encoded(F.col("text"), BYTE).alias("i")).select("i", bpe.decoded(F.col("i"), BYTE).alias("t")).collect()
    assert sorted(str(r["t"]) for r in ids) == sorted(str(t) for _, t in rows)
    assert df.limit(0).select(bpe.round_trip(F.col("text"), BYTE)).count() == 0


def test_word_ids_equal_the_library():
    mine = packing.WordIds(WORD)
    for t in texts(1500, 4):
        assert np.frombuffer(mine.encode(t), mine.kind).tolist() == mine.whole.encode(t, add_special_tokens=False).ids


def test_ids_of_many_texts_equal_the_library():
    mine = packing.WordIds(WORD)
    odd = [None, "", " ", "A1b22,c", "it's IT'S <|ENDOFTEXT|> <|endoftext|>x", "\x00a \x1cB\x7f", "Ünï-code 1\u0662", "x" * 300, "a\u00a0b", "'S-9'", "end", "No.", "e\u0301 12.5%"]
    batch = [*odd, *texts(1500, 5), *odd]
    ids, cuts = mine.encode_all(pa.array(batch, pa.string()), 1)
    for k, t in enumerate(batch):
        assert ids[cuts[k] : cuts[k + 1]].tolist() == [*mine.whole.encode(t or "", add_special_tokens=False).ids, 1], t
    assert cuts[-1] == len(ids) and len(mine.encode_all(pa.array([], pa.string()), 1)[0]) == 0


def test_neighbours_are_bm25_best():
    docs = [np.array(d) for d in ([1, 2, 3], [1, 2, 9], [4, 5], [3, 3, 1], [7])]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    idf = np.zeros(10)
    for t in range(10):
        df = sum(t in d for d in docs)
        idf[t] = max(0, np.log((n - df + 0.5) / (df + 0.5)))
    index = packing.Index(docs, idf, mean)
    used = np.array([True, False, False, False, False])

    def score(a, b):
        return sum(idf[t] * (list(b).count(t) * 2.2) / (list(b).count(t) + 1.2 * (0.25 + 0.75 * len(b) / mean)) for t in set(a))

    best = sorted((k for k in range(1, 5) if score(docs[0], docs[k]) > 0), key=lambda k: (-score(docs[0], docs[k]), k))
    assert index.neighbours(0, used).tolist() == best


def holds(rows, source, window, end=1):
    library = tokenizers.Tokenizer.from_file(WORD)
    wanted = [np.array([*library.encode(t or "", add_special_tokens=False).ids, end], "<u4") for _, t in source]
    assert sum(r["length"] for r in rows) == sum(map(len, wanted))
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window
    return wanted


@pytest.mark.parametrize("shard_tokens", [1 << 20, 200])
def test_packed_covers_every_id_once(spark, monkeypatch, shard_tokens):
    monkeypatch.setattr(packing, "SHARD_TOKENS", shard_tokens)
    rnd = random.Random(2)
    words = "river mountain the of stone bread light house green paper".split()
    source = [(k, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 3, 20, 200])))) for k in range(60)] + [(60, None)]
    df = spark.createDataFrame(source, "doc_id long, text string").withColumn("offset", F.lit("clash"))
    rows = packing.packed(df, WORD, window=64).collect()
    wanted = dict(zip([k for k, _ in source], holds(rows, source, 64)))
    for k, ids in wanted.items():
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    if shard_tokens > 1000:
        sizes = {}
        for r in rows:
            sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
        assert sum(s < 64 for s in sizes.values()) <= 1


def test_packed_edges(spark):
    rows = [(1, "same text"), (1, "same text"), (None, "no id"), (None, None)]
    out = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), WORD).collect()
    holds(out, rows, 2048)
    assert sorted(str(r["doc_id"]) for r in out) == ["1", "1", "None", "None"]
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), WORD).count() == 0


def ids_equal(mine, batch):
    ids, cuts = mine.encode_all(pa.array(batch, pa.string()), 1)
    for k, t in enumerate(batch):
        assert ids[cuts[k] : cuts[k + 1]].tolist() == [*mine.whole.encode(t or "", add_special_tokens=False).ids, 1], t


def test_pieces_are_told_apart_by_their_bytes(monkeypatch):
    """pieces whose hashes are equal keep their own ids."""
    monkeypatch.setattr(packing.Words, "hashes", lambda self: np.zeros(len(self.start), np.uint64))
    monkeypatch.setattr(packing, "joined", lambda low, high: np.zeros(len(low), np.uint64), raising=False)
    ids_equal(packing.WordIds(WORD), ["one two three", "sixteenletterslo sixteenletterslonger one", "seventeenlettersx"])


def test_latin_letters_are_cut_by_arrays():
    """accented words no longer go to the library one by one; only the three odd characters do."""
    batch = [f"{a}{c}B,{c}1 {c}" for c in map(chr, range(0xA0, 0x250)) for a in ("", "x")] + ["e\u0301t\u00e9", "\u00c9t\u00e9 \u0178\u0178 STRA\u00dfE"]
    ids_equal(packing.WordIds(WORD), batch)
    words, whole = packing._pieces(pa.array(["\u00c9t\u00e9, \u0178x \u0130 a\u00d7b c\u00f7 \u017fo"]))
    spelt = [words.data[s:e].tobytes().decode() for s, e in zip(words.start, words.end)]
    assert spelt == ["\u00e9t\u00e9", ",", "\u00ffx", "\u0130", "a\u00d7b", "c\u00f7", "\u017fo"]
    assert whole.tolist() == [False, False, False, True, True, True, False]


def test_known_pieces_are_spelt_once_and_memory_is_bounded(monkeypatch):
    """what one portion has spelt serves the next ones, until it is forgotten."""
    mine, batch = packing.WordIds(WORD), texts(300, 6)
    ids_equal(mine, batch)
    kept = len(mine.begin)
    ids_equal(mine, batch[::-1])
    assert len(mine.begin) == kept
    monkeypatch.setattr(packing, "KEPT", 4)
    monkeypatch.setattr(packing, "AT_ONCE", 5)
    mine = packing.WordIds(WORD)
    for seed in range(5):
        ids_equal(mine, texts(30, seed))
        assert len(mine.short.number) > mine.short.held
    mine.encode_all(pa.array([""]), 1)
    assert len(mine.begin) == 1


def test_frequencies_count_runs():
    ids = np.array([3, 3, 5, 7, 3, 5, 5, 1], np.uint16)
    held = packing._holders(ids, np.array([0, 3, 4, 4]), np.array([3, 4, 4, 8]), 9)
    assert held.tolist() == [0, 1, 0, 2, 0, 2, 0, 1, 0]
    assert packing._holders(ids[:0], np.zeros(0, np.int64), np.zeros(0, np.int64), 9).tolist() == [0] * 9


def test_dropped_postings_and_few_neighbours_change_no_order():
    rnd = np.random.default_rng(7)
    docs = [rnd.integers(0, 40, rnd.integers(1, 30)) for _ in range(80)]
    idf, used = rnd.random(40), rnd.random(80) < 0.6
    docs[10] = docs[11] = docs[12]  # ties
    index = packing.Index(docs, idf, 15.0)
    every = [index.neighbours(k, used).tolist() for k in range(80)]
    some = [index.neighbours(k, used, 3).tolist() for k in range(80)]
    index.drop(used)
    assert [index.neighbours(k, used).tolist() for k in range(80)] == every
    assert all(e[: len(s)] == s and len(s) >= min(3, len(e)) for e, s in zip(every, some))
