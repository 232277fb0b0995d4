"""Phrase collocations by direct-address tiling.

Words that occur often enough are numbered by falling frequency within their
language. Two numbers in a row address a cell in a square table of pairs, which is
cut into tiles of ``2**bits`` by ``2**bits`` cells. Because frequent words have low
numbers, pairs crowd into the tiles at the head of the table, and these are counted
by a dense ``bincount``; the thin tiles beyond are counted as sorted coordinates. The
pairs that are frequent over all blocks are numbered by falling frequency again and
become the symbols of the next level: two overlapping pairs address a phrase of three
words, two overlapping phrases of three one of four. A phrase cannot be more frequent
than its parts, so nothing frequent is missed.

No vocabulary is held in one place. Blocks keep their texts as numbers; their counts
go to tiles, and a tile answers each block with the numbers of the block's own
frequent cells. A head tile that many blocks fill is cut into ranges of its cells; the
thin tiles are dealt to as many groups as their cells ask for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from sedgetable.llm.ranks import SHORT_ROWS, numbered
from sedgetable.llm.words import SPACES, handed_back, joined, pack, portions, stored, unpack, words_of
from sedgetable.scale import top_rows

# Text of a block, and block cells that meet in one group.
BLOCK_BYTES, GROUP_CELLS = 8 << 20, 1 << 20
# Text that is coded at a time: arrays per byte and per word are that long at most.
PORTION_BYTES = 1 << 20

# Characters that end a piece; words of a piece are parted by blanks and tabs.
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
BETWEEN = SPACES | ENDS

@dataclass(frozen=True)
class Grid:
    """A square of ``head`` by ``head`` tiles of ``2**bits`` by ``2**bits`` cells, and thin tiles beyond it."""

    bits: int = 10
    head: int = 8

    @property
    def cells(self) -> int:
        return 1 << 2 * self.bits

    @property
    def low(self) -> int:
        return (1 << self.bits) - 1

    def cell(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return (u & self.low) << self.bits | (v & self.low)

    def pair(self, tile: int, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (tile // self.head << self.bits) + (cell >> self.bits), (tile % self.head << self.bits) + (cell & self.low)

    def counted(self, cell: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cells of one tile, ascending, and their sums: dense where the tile is full enough, else by sorted coordinates.

        Sums of given counts are exact up to 2**53.
        """
        if len(cell) >= self.cells // 32:
            full = np.bincount(cell, n, self.cells)
            some = np.flatnonzero(full)
            return some, full[some].astype(np.int64)
        some, at, sums = summed(cell, n)
        return cell[at], sums

    def split(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions whose pair lies in the head, by tile; their cells; the tiles, and where each begins; positions of thin pairs."""
        if state.max(initial=-1) < 2**31:
            state = state.astype(np.int32)
        at = np.flatnonzero((state[:-1] >= 0) & (state[1:] >= 0)).astype(np.int32)
        head = np.maximum(state[at], state[at + 1]) < self.head << self.bits
        thin, at = at[~head], at[head]
        u, v = state[at], state[at + 1]
        tile = ((u >> self.bits) * self.head + (v >> self.bits)).astype(np.min_scalar_type(self.head**2))
        order = np.argsort(tile, kind="stable")
        tiles, begin = np.unique(tile[order], return_index=True)
        return at[order], self.cell(u, v).astype(np.uint32)[order], tiles, begin, thin

    def region(self, u: np.ndarray, v: np.ndarray, regions: int) -> np.ndarray:
        """Which of ``regions`` groups each thin pair's tile is dealt to."""
        tile = joined((u >> self.bits).astype(np.uint64), (v >> self.bits).astype(np.uint64))
        return (tile % np.uint64(regions)).astype(np.int64)


def summed(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, ascending; where each stands first; and the sum of its ``n``, or how often it stands."""
    if n is None:
        return np.unique(keys, return_index=True, return_counts=True)
    order = np.argsort(keys, kind="stable")
    some, begin = np.unique(keys[order], return_index=True)
    return some, order[begin], np.add.reduceat(n[order], begin) if len(some) else n[:0]


def pair_keys(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A number for each pair, the same for equal pairs of this call, ascending with u, then v."""
    if max(u.max(initial=0), v.max(initial=0)) >> 32:
        u, v = (np.unique(x, return_inverse=True)[1] for x in (u, v))
    return u.astype(np.uint64) << np.uint64(32) | v.astype(np.uint64)


BLOCKS = "lang string, block bigint, state binary, word string, code bigint, n bigint"
TILES = "lang string, block bigint, state binary, tile bigint, m bigint, us binary, vs binary, counts binary"
# The tile number of all thin tiles.
THIN = -1


@dataclass
class Coded:
    """A stretch of texts: its distinct words by ascending hash, how often each occurs, and their codes in sequence, -1 between pieces."""

    hashes: np.ndarray
    names: pa.Array
    n: np.ndarray
    state: np.ndarray


def _coded(texts: pa.Array) -> Coded:
    words = words_of(texts, lower=True, spaces=BETWEEN)
    hashes, first, code, n = np.unique(words.hashes(), return_index=True, return_inverse=True, return_counts=True)
    names = [words.data[s:e].tobytes().decode() for s, e in zip(words.start[first].tolist(), words.end[first].tolist())]
    piece = np.cumsum(ENDS[words.data], dtype=np.int32)[words.start]
    opens = np.zeros(len(code), np.int64)
    opens[1:] = (np.diff(piece) != 0) | (np.diff(words.text) != 0)
    out = np.full(len(code) + opens.sum(), -1, np.int32)
    out[np.arange(len(code)) + np.cumsum(opens)] = code
    return Coded(hashes, pa.array(names, pa.string()), n, out)


def _merged(parts: list[Coded]) -> Coded:
    """Stretches one after the other, as if they had been coded at once."""
    if len(parts) == 1:
        return parts[0]
    hashes, first, place = np.unique(np.concatenate([p.hashes for p in parts]), return_index=True, return_inverse=True)
    n = np.zeros(len(hashes), np.int64)
    np.add.at(n, place, np.concatenate([p.n for p in parts]))
    out = []
    for p, codes in zip(parts, np.split(place.astype(np.int32), np.cumsum([len(p.hashes) for p in parts[:-1]]))):
        if len(p.state):  # code -1 takes the last entry, which stays -1
            out += [np.full(1, -1, np.int32)] * bool(out) + [np.append(codes, np.int32(-1))[p.state]]
    state = np.concatenate(out) if out else np.zeros(0, np.int32)
    return Coded(hashes, pa.concat_arrays([p.names for p in parts]).take(pa.array(first)), n, state)


def _bytes(texts: pa.LargeStringArray) -> int:
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    return int(at[-1] - at[0])


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Blocks of about ``block_bytes`` of one language: a row with the codes, and a row for each distinct word.

    Texts are coded as they come, a portion at a time, and held as codes.
    """
    task, made = TaskContext.get().partitionId(), 0
    held: dict[str, tuple[list[Coded], int]] = {}

    def flushed(lang: str) -> pa.RecordBatch:
        nonlocal made
        coded = _merged(held.pop(lang)[0])
        block, k = (task << 32) + made, len(coded.names)
        made += 1
        cols = [pa.array([lang] * (k + 1)), pa.array([block] * (k + 1), pa.int64()), pa.array([pack(coded.state)] + [None] * k, pa.binary())]
        return pa.RecordBatch.from_arrays([*cols, pa.concat_arrays([pa.nulls(1, pa.string()), coded.names]), pa.array([None, *range(k)], pa.int64()), pa.array([None, *coded.n.tolist()], pa.int64())], ["lang", "block", "state", "word", "code", "n"])

    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            for part in portions(batch.column(1).filter(pa.array(langs.indices.to_numpy() == i)), block_bytes):
                coded, size = held.get(lang, ([], 0))
                held[lang] = ([*coded, *map(_coded, portions(part, PORTION_BYTES))], size + _bytes(part))
                if held[lang][1] >= block_bytes:
                    yield flushed(lang)
        while sum(size for _, size in held.values()) > 4 * block_bytes:  # many languages at once
            yield flushed(max(held, key=lambda x: held[x][1]))
    for lang in list(held):
        yield flushed(lang)
    handed_back()


def _trimmed(made: pa.Table) -> pa.Table:
    """What was made for a group, once the worker has handed back what making it took."""
    handed_back()
    return made


def _emitted(grid: Grid, lang: str, block: int, state: np.ndarray) -> pa.Table:
    """The block's state, a row for each of its head tiles, and one for all its thin tiles."""
    _, cell, tiles, begin, thin = grid.split(state)
    rows = [(pack(state), None, None, None, None, None)]
    for tile, part in zip(tiles.tolist(), np.split(cell, begin[1:])):
        cells, n = grid.counted(part)
        rows.append((None, tile, len(cells), pack(cells.astype(np.uint32)), None, pack(n.astype(np.uint32))))
    if len(thin):
        u, v = state[thin], state[thin + 1]
        _, at, n = summed(pair_keys(u, v))
        rows.append((None, THIN, len(at), pack(u[at]), pack(v[at]), pack(n.astype(np.uint32))))
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    return pa.table([pa.array([lang] * len(rows), pa.string()), pa.array([block] * len(rows), pa.int64()), *cols], ["lang", "block", "state", "tile", "m", "us", "vs", "counts"])


def _all(tables: list[pa.Table], grid: Grid) -> pa.Table:
    return pa.concat_tables(tables) if tables else _emitted(grid, "", 0, np.zeros(0, np.int64)).slice(0, 0)


def _from_words(grid: Grid, blocks: pa.Table, told: pa.Table) -> pa.Table:
    """A block's first state: its codes become numbers of frequent words, all others -1."""
    out = []
    for lang, block, state in zip(*(blocks[c].to_pylist() for c in ("lang", "block", "state"))):
        codes = unpack(state, np.int32)
        number = np.full(codes.max(initial=-1) + 2, -1)
        number[told["code"].to_numpy()] = told["index"].to_numpy()
        out.append(_emitted(grid, lang, block, number[codes]))  # code -1 takes the last entry, which stays -1
    return _all(out, grid)


def _looked_up(u: np.ndarray, v: np.ndarray, known_u: np.ndarray, known_v: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Number of each pair among known ones, else -1."""
    keys = pair_keys(np.concatenate([u, known_u]), np.concatenate([v, known_v]))
    asked, known = keys[: len(u)], keys[len(u) :]
    if not len(known):
        return np.full(len(u), -1)
    order = np.argsort(known)
    known, index = known[order], index[order]
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[at] == asked, index[at], -1)


def _after(grid: Grid, state: np.ndarray, answers: dict[int, list[tuple[bytes, bytes, bytes]]]) -> np.ndarray:
    """The number of the frequent pair at each position, else -1."""
    at, cell, tiles, begin, thin = grid.split(state)
    after, number = np.full(len(state), -1), np.full(grid.cells, -1)
    for tile, lo, hi in zip(tiles.tolist(), begin.tolist(), [*begin[1:].tolist(), len(at)]):
        own = [(unpack(cells, np.uint32), unpack(ids, np.int64)) for cells, _, ids in answers.get(tile, [])]
        for cells, ids in own:
            number[cells] = ids
        after[at[lo:hi]] = number[cell[lo:hi]]
        for cells, _ in own:
            number[cells] = -1
    known = [np.concatenate([np.zeros(0, np.int64), *[unpack(x[k], np.int64) for x in answers.get(THIN, [])]]) for k in range(3)]
    after[thin] = _looked_up(state[thin], state[thin + 1], *known)
    return after


def _from_pairs(grid: Grid, blocks: pa.Table, told: pa.Table) -> pa.Table:
    """A block's next state: the number of the frequent pair at each position."""
    answers: dict[int, list[tuple[bytes, bytes, bytes]]] = {}
    for tile, *blobs in zip(*(told[c].to_pylist() for c in ("tile", "us", "vs", "ids"))):
        answers.setdefault(tile, []).append(blobs)
    out = []
    for lang, block, blob in zip(*(blocks[c].to_pylist() for c in ("lang", "block", "state"))):
        out.append(_emitted(grid, lang, block, _after(grid, unpack(blob, np.int64), answers)))
    return _all(out, grid)


def _ranges(grid: Grid, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows cut into ``subs`` parts: head tiles by ranges of cells, thin ones by regions."""
    names, kinds = ["lang", "block", "tile", "sub", "us", "vs", "counts"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    for batch in batches:
        for lang, block, tile, us, vs, counts, subs in zip(*(batch.column(c) for c in ("lang", "block", "tile", "us", "vs", "counts", "subs"))):
            subs, thin = subs.as_py(), vs.is_valid
            u, n = unpack(us.as_py(), np.int64 if thin else np.uint32), unpack(counts.as_py(), np.uint32)
            v = unpack(vs.as_py(), np.int64) if thin else None
            sub = grid.region(u, v, subs) if thin else u.astype(np.int64) * subs // grid.cells
            order = np.argsort(sub, kind="stable")
            some, begin = np.unique(sub[order], return_index=True)
            parts = [[pack(x) for x in np.split(a[order], begin[1:])] if a is not None else [None] * len(some) for a in (u, v, n)]
            rows = [[lang.as_py()] * len(some), [block.as_py()] * len(some), [tile.as_py()] * len(some), some, *parts]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names)
    handed_back()


def _by_tile(grid: Grid, tiles: DataFrame, group_cells: int) -> DataFrame:
    """Rows of tiles with ``sub``: what blocks fill with more than ``group_cells`` cells in all is cut into parts."""
    sizes = tiles.groupBy("lang", "tile").agg(F.sum("m").alias("m")).filter(F.col("m") > group_cells)
    hot = stored(sizes.select("lang", "tile", F.ceil(F.col("m") / group_cells).cast("bigint").alias("subs")), "hot")
    found = hot.count()
    kept = tiles.select("lang", "block", "tile", "us", "vs", "counts")
    if not found:
        return kept.withColumn("sub", F.lit(0).cast("bigint"))
    hot = F.broadcast(hot) if found <= SHORT_ROWS else hot
    cut = kept.join(hot, ["lang", "tile"]).mapInArrow(lambda b: _ranges(grid, b), "lang string, block bigint, tile bigint, sub bigint, us binary, vs binary, counts binary")
    return kept.join(hot, ["lang", "tile"], "left_anti").withColumn("sub", F.lit(0).cast("bigint")).unionByName(cut)


GROUP = ["lang", "tile", "sub"]


def _joined(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.concatenate([unpack(b.as_buffer(), kind) for b in table[column]]).astype(np.int64)


def _frequent(grid: Grid, tiles: DataFrame, least: int) -> DataFrame:
    """``lang, tile, sub, u, v, f`` of the pairs of symbols that occur at least ``least`` times."""

    def merge(table: pa.Table) -> pa.Table:
        lang, tile, sub = (table[c][0].as_py() for c in GROUP)
        n = _joined(table, "counts", np.uint32)
        if tile == THIN:
            u, v = _joined(table, "us", np.int64), _joined(table, "vs", np.int64)
            _, at, f = summed(pair_keys(u, v), n)
            u, v = u[at], v[at]
        else:
            cell, f = grid.counted(_joined(table, "us", np.uint32), n)
            u, v = grid.pair(tile, cell)
        some = f >= least
        k = int(some.sum())
        return pa.table({"lang": pa.array([lang] * k, pa.string()), "tile": pa.array([tile] * k, pa.int64()), "sub": pa.array([sub] * k, pa.int64()), "u": u[some], "v": v[some], "f": f[some]})

    return tiles.groupBy(*GROUP).applyInArrow(lambda table: _trimmed(merge(table)), "lang string, tile bigint, sub bigint, u bigint, v bigint, f bigint")


def _told(grid: Grid, tiles: DataFrame, ranked: DataFrame) -> DataFrame:
    """For each block and tile the pairs that are frequent, with their numbers."""

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        rows = []
        if len(known) and len(asked):
            tile = known["tile"][0].as_py()
            u, v, index = (known[c].to_numpy() for c in ("u", "v", "index"))
            if tile == THIN:
                us, vs = _joined(asked, "us", np.int64), _joined(asked, "vs", np.int64)
                sizes = [len(unpack(b.as_buffer(), np.uint32)) for b in asked["counts"]]
                found = _looked_up(us, vs, u, v, index)
                ends = np.cumsum(sizes)[:-1]
                for block, *part in zip(asked["block"].to_pylist(), *(np.split(x, ends) for x in (us, vs, found))):
                    hit = part[2] >= 0
                    if hit.any():
                        rows.append((block, tile, *[pack(x[hit]) for x in part]))
            else:
                number = np.full(grid.cells, -1)
                number[grid.cell(u, v)] = index
                for block, blob in zip(asked["block"].to_pylist(), asked["us"]):
                    cells = unpack(blob.as_buffer(), np.uint32)
                    cells = cells[number[cells] >= 0]
                    if len(cells):
                        rows.append((block, tile, pack(cells), None, pack(number[cells])))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["block", "tile", "us", "vs", "ids"])

    asked = tiles.select(*[F.col(c).alias(c) for c in GROUP], "block", "us", "vs", "counts")
    known = ranked.select(*GROUP, "u", "v", "index")
    return asked.groupBy(*GROUP).cogroup(known.groupBy(*GROUP)).applyInArrow(lambda asked, known: _trimmed(answer(asked, known)), "block bigint, tile bigint, us binary, vs binary, ids binary")


def _score(a: str, left: str, right: str) -> Column:
    """floor(scale * a / (left + right)) in whole numbers of 38 digits."""
    return F.expr(f"(2000000 * cast({a} as decimal(25, 0))) div cast({left} + {right} as decimal(20, 0))")


def phrases(docs: DataFrame, text: str = "text", group: str = "lang", least: int = 30, percent: int = 80, longest: int = 4, bits: int = 10, head: int = 8, block_bytes: int = BLOCK_BYTES, group_cells: int = GROUP_CELLS) -> DataFrame:
    """Candidate phrases: ``lang, phrase, a, l, r, n, score, kept``.

    ``kept`` is false where a candidate of one word more holds the phrase and has at
    least ``percent`` in 100 of its occurrences; a still longer one need not be asked,
    since it is not more frequent than the one between.
    """
    if not 2 <= longest <= 4:
        raise ValueError("phrases have two to four words")
    grid = Grid(bits, head)
    source = docs.select(F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    coded = stored(source.mapInArrow(lambda b: _blocks(b, block_bytes), BLOCKS), "blocks")
    words = coded.filter("word is not null")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    common = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    level = numbered(common, ["lang"], [F.desc("f"), F.col("word")])
    told = words.join(level, ["lang", "word"]).select(F.col("block").alias("block"), "code", "index")
    states = coded.filter("state is not null").select("lang", "block", "state")
    step = lambda blocks, told: _trimmed(_from_words(grid, blocks, told))
    levels = [level.select("lang", "index", F.col("word").alias("phrase"), "f")]
    for size in range(2, longest + 1):
        made = stored(states.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(step, TILES), "states")
        tiles = _by_tile(grid, made.filter("tile is not null"), group_cells)
        level = numbered(_frequent(grid, tiles, least), ["lang"], [F.desc("f"), F.col("u"), F.col("v")])
        levels.append(level.select("lang", "index", "u", "v", "f"))
        if size < longest:
            told, states = _told(grid, tiles, level), made.filter("state is not null").select("lang", "block", "state")
            step = lambda blocks, told: _trimmed(_from_pairs(grid, blocks, told))
    return _cut(levels, totals, percent)


def _cut(levels: list[DataFrame], totals: DataFrame, percent: int) -> DataFrame:
    """Scores over all cuts and the verdict on held phrases, level by level.

    A phrase of m words is a left and a right part of m - 1 words that overlap, so the
    counts of its beginnings and endings are those of its parts, and one more of each.
    """
    known = levels[0].select("lang", "index", "phrase", F.array("f").alias("heads"), F.array("f").alias("tails"))
    out = None
    for size, level in enumerate(levels[1:], 2):
        side = lambda at, name: known.select("lang", F.col("index").alias(at), F.struct("phrase", "heads", "tails").alias(name))
        both = level.join(side("u", "p"), ["lang", "u"]).join(side("v", "q"), ["lang", "v"])
        last = F.element_at(F.split("q.phrase", " "), -1)
        # heads[k - 1] is the count of the first k words, tails[k - 1] that of the last k.
        heads, tails = F.concat("p.heads", F.array("f")), F.concat("q.tails", F.array("f"))
        named = both.select("lang", "index", "u", "v", "f", F.concat_ws(" ", "p.phrase", last).alias("phrase"), heads.alias("heads"), tails.alias("tails"))
        cuts = [F.struct(_score("f", f"heads[{k - 1}]", f"tails[{size - k - 1}]").alias("score"), F.lit(k).alias("k"), F.expr(f"heads[{k - 1}]").alias("l"), F.expr(f"tails[{size - k - 1}]").alias("r")) for k in range(1, size)]
        best = F.array_min(F.array(*cuts)).alias("cut")
        named = stored(named.select("*", best), "phrases")
        if size < len(levels):
            above = levels[size].select("lang", F.explode(F.array_distinct(F.array("u", "v"))).alias("index"), F.col("f").alias("longer"))
            held = above.groupBy("lang", "index").agg(F.max("longer").alias("longer"))
            judged = named.join(held, ["lang", "index"], "left")
        else:
            judged = named.withColumn("longer", F.lit(None).cast("bigint"))
        drop = F.coalesce(100 * F.col("longer") >= percent * F.col("f"), F.lit(False))
        rows = judged.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score", (~drop).alias("kept"))
        out = rows if out is None else out.unionByName(rows)
        known = named.select("lang", "index", "phrase", "heads", "tails")
    return out.join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score", "kept")


def collocations(docs: DataFrame, text: str = "text", group: str = "lang", least: int = 30, percent: int = 80, longest: int = 4, top: int = 2000, **sizes: int) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    A-Z are folded. Texts are cut into pieces at ``.,;:!?`` and line ends, pieces into
    words at blanks and tabs; a phrase lies within a piece. A null language is
    ``und``, together with rows that say so; an empty one is a language of its own.
    Null, empty and blank texts hold no words. Repeated rows count each. Candidates
    occur at least ``least`` times; the score of a phrase is that of its lowest cut,
    ties to the earliest. Ties of score go to the higher count, then to the lower
    bytes of the phrase. Other columns are not read. ``sizes`` go to :func:`phrases`.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = top_rows(phrases(docs, text, group, least, percent, longest, **sizes).filter("kept"), ["lang"], order, top)
    return best.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
