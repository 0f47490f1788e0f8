"""Splitting oversized texts at natural boundaries with overlap (problem 8), by ranges.

A text, or a file of any size, is taken in ranges with a halo of context: each range yields its table of
boundaries (place, strength, tokens up to there) on its own, prefix sums over the ranges' lengths
stitch the tables, pieces are planned over blocks of ``BLOCK`` tables and emitted by offset from the ranges
that hold them.  No task holds a whole file, and no block more than ``BLOCK`` ranges and the one before.

Ranges begin and end where the tokenizer's pattern always splits, so the tokens of a piece between two such
places are the difference of two sums, exactly, and are not counted again; a piece with another end is counted
on its own and ends earlier if it is over the limit.

Pieces end at the strongest boundary in their last part (heading, paragraph, line,
sentence, clause); only stretches without any are cut between characters.  Each piece
but the first repeats about ``overlap`` tokens of the one before; without these the
pieces join to the text exactly.  Null and short texts, and rows without a
key, yield no pieces; a repeated row yields its pieces again.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .store import written

LIMIT, OVERLAP, RANGE, BLOCK, HALO = 512, 64, 4_096, 64, 64
HEADING, PARAGRAPH, LINE, SENTENCE, CLAUSE, NONE = 5, 4, 3, 2, 1, 0
_EDGE = re.compile(
    r"(?P<p>\n[ \t\r　]*\n\s*)|(?P<l>\r?\n)|(?P<s>[。！？｡]+[”\"'」』）)\]】»’]*|[.!?…]+[”\"'」』）)\]】»’]*(?=\s|$))|(?P<c>[，、；：]|[,;:](?=\s))"
)
_SIGN = re.compile("[\n\r。！？｡.!?…，、；：,;:]")
_HEAD = re.compile(r"[ \t　]*(?:#{1,6}\s|【|第[一二三四五六七八九十\d]+[章节]|[一二三四五六七八九十]+、|STEP\s?\d|\d+[.、]\s?\S{1,20}(?:\n|$))")
PIECES = "id bigint, piece int, begin bigint, end bigint, tokens int, overlap int, text string"
_RANGES = "row bigint, id bigint, range int, block int, last boolean, own string, total int, bounds binary"


@lru_cache(1 << 16)
def _kind(c: str) -> int:
    """Letter, number, white space or other: the classes of the tokenizer's pattern."""
    return 1 if c.isalpha() else 2 if c.isnumeric() else 3 if c.isspace() else 4


def splits(text: str, p: int) -> bool:
    """Whether the tokenizer's pattern splits at ``p`` whatever stands on either side further away."""
    a, b = text[p - 1], text[p]
    if a in "' \x1c\x1d\x1e\x1f" or b in "\x1c\x1d\x1e\x1f":
        return False
    return _kind(a) != _kind(b)


def edge(text: str, p: int) -> int:
    """The first place from ``p`` on, within the halo, at which the pattern splits after no white space; else ``p``."""
    for q in range(max(p, 1), min(p + HALO, len(text))):
        if splits(text, q) and not text[q - 1].isspace():
            return q
    return min(p, len(text))


@lru_cache(4096)
def _blank(white: str, folder: str, file: str) -> int:
    return tokens.count(white, folder, file)


def boundaries(text: str, lo: int, hi: int, step: int, folder: str, file: str, ids: list[int] | None = None) -> tuple[np.ndarray, int]:
    """Table of the range text[lo:hi], and how many tokens it has (``ids``, where they are known).

    Columns: places in (lo, hi], relative to lo; their strengths; tokens up to there; tokens up to there if the text ended there; whether
    the pattern splits there.  Boundaries are never further apart than about ``step`` tokens.
    """
    place, level, p = [], [], max(0, lo - HALO)  # an edge may begin in the halo
    while (sign := _SIGN.search(text, p)) is not None:
        p = sign.end()
        if (m := _EDGE.match(text, p - 1)) is None:
            continue
        p = m.end()
        if p <= lo:
            continue
        if p > hi:
            break
        kind = m.lastgroup
        if kind in "pl":
            strength = HEADING if _HEAD.match(text, p) else PARAGRAPH if kind == "p" else LINE
        else:
            strength = SENTENCE if kind == "s" else CLAUSE
        place.append(p)
        level.append(strength)
    if not place or place[-1] != hi:
        place.append(hi)
        level.append(NONE)
    own = text[lo:hi]
    codes = np.frombuffer(own.encode("utf-32-le", "surrogatepass"), "<u4")
    width = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])
    encoder, size = tokens.encoding(folder, file)
    ends = np.cumsum(size[encoder.encode_ordinary(own) if ids is None else ids])
    upto = lambda p: np.searchsorted(ends, width[p - lo], "left") + (p > lo)
    place, level = np.array(place, np.int64), np.array(level, np.int64)
    count = upto(place)
    gaps = np.flatnonzero(np.diff(count, prepend=0) > step)
    if len(gaps):
        more = []
        for g in gaps:  # stretches without boundaries: between words where there are any
            a, b = (lo if g == 0 else int(place[g - 1])), int(place[g])
            for t in range((0 if g == 0 else int(count[g - 1])) + step // 2, int(count[g]) - step // 4, step // 2):
                p = lo + int(np.searchsorted(width, ends[min(t, len(ends) - 1)], "right")) - 1
                blank = text.rfind(" ", max(a, p - 24), p)
                p = blank if blank > a else p
                if a < p < b:
                    more.append(p)
        extra = np.setdiff1d(np.array(more, np.int64), place)
        order = np.argsort(np.concatenate([place, extra]), kind="stable")
        place, level = np.concatenate([place, extra])[order], np.concatenate([level, np.zeros(len(extra), np.int64)])[order]
        count = upto(place)
    white = [(i, p) for i, p in enumerate(place.tolist()) if text[p - 1].isspace()]
    starts = []
    for _, p in white:  # white space at the end of a text is one piece of the pattern
        while p > lo and text[p - 1].isspace():
            p -= 1
        starts.append(p)
    closed = count.copy()
    if white:
        closed[[i for i, _ in white]] = upto(np.array(starts, np.int64)) + [_blank(text[q:p], folder, file) for q, (_, p) in zip(starts, white)]
    safe = np.array([p == len(text) or splits(text, p) for p in place.tolist()], np.int64)
    return np.stack([place - lo, level, count, closed, safe]).astype(np.int32), len(ends)


def cuts(bounds: np.ndarray, limit: int, overlap: int, start: int, last: int, resumed: bool, recount) -> Iterator[tuple[int, int, int]]:
    """Pieces (boundary before, boundary after, tokens) over the boundaries from ``start`` to ``last``.

    ``bounds``: places, strengths, tokens, tokens if ended there, whether the pattern splits; a plan that is ``resumed`` repeats what stands
    before ``start``.  ``recount`` tells the tokens between two boundaries, where their difference is not exact.
    """
    _, level, count, closed, safe = bounds.tolist()
    rank = [2 * a + b for a, b in zip(level, safe)]
    at, before = start, -1
    furthest = lambda begin, at: max(at + 1, min(last, bisect_right(count, count[begin] + limit + 8) - 1))
    size_of = lambda a, b: closed[b] - count[a] if safe[a] and safe[b] else recount(a, b)
    while at < last:
        begin = at
        if before >= 0 or resumed:  # back by about the overlap, but never to the begin of the piece before
            wanted = count[at] - overlap
            near = range(max(before + 1, bisect_left(count, wanted - overlap // 4)), at)
            begin = min(near, key=lambda i: abs(count[i] - wanted) + overlap * (1 - safe[i]), default=at)  # noqa: B023
        most = furthest(begin, at)
        while True:
            size = size_of(begin, most)
            if size <= limit:
                if most == last:
                    break
                least = max(at + 1, bisect_left(count, count[begin] + int(0.6 * limit)))
                end = max(range(least, most + 1), key=lambda i: (rank[i], i), default=most)
                if (own := size_of(begin, end)) <= limit:
                    most, size = end, own
                    break
            if most > at + 1:
                most -= 1
            elif begin < at:  # rather less overlap
                begin += 1
                most = furthest(begin, at)
            else:
                raise ValueError("two boundaries further apart than the limit")
        yield begin, most, size
        at, before = most, begin


def _tables(limit: int, overlap: int, size: int, block: int, folder: str, file: str):
    """Ranges of whole texts over the limit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokens.encoding(folder, file)[0]
        for rows in batches:
            out: list[tuple] = []
            for row, i, text in zip(rows["row"], rows["id"], rows["text"]):
                edges = sorted({0, *(edge(text, p) for p in range(size, len(text), size)), len(text)})
                own = [encoder.encode_ordinary(text[lo:hi]) for lo, hi in zip(edges, edges[1:])]
                if sum(map(len, own)) <= limit:
                    continue
                for n, (lo, hi, ids) in enumerate(zip(edges, edges[1:], own)):
                    around = max(0, lo - HALO)
                    bounds, total = boundaries(text[around : hi + HALO], lo - around, hi - around, overlap // 2, folder, file, ids)
                    out.append((row, i, n, n // block, hi == len(text), text[lo:hi], total, bounds.tobytes()))
            yield pd.DataFrame(out, columns=["row", "id", "range", "block", "last", "own", "total", "bounds"])

    return run


def _strongest(bounds: np.ndarray) -> int:
    """Where a block ends and the next one begins: the last of the strongest boundaries in the second half of the block's last range."""
    level = bounds[1][len(bounds[1]) // 2 :] * 2 + bounds[4][len(bounds[1]) // 2 :]
    return len(bounds[1]) - 1 - int(np.argmax(level[::-1]))


def _emit(limit: int, overlap: int, size: int, folder: str, file: str, text: bool):
    def planned(rows: dict[str, list]) -> Iterator[tuple]:
        chars0 = number = 0
        if rows["range"][0] < 0:  # the sums before the block
            chars0, number = int(rows["total"][0]), int(rows["chars"][0])
            rows = {k: v[1:] for k, v in rows.items()}
        block, own = rows["block"][0], rows["own"]
        tables = [np.frombuffer(b, np.int32).reshape(5, -1) for b in rows["bounds"]]
        begins = np.cumsum([0, *map(len, own)]).tolist()
        totals = np.cumsum([0, *rows["total"]]).tolist()
        parts = [t + np.array([[c], [0], [n], [n], [0]]) for t, c, n in zip(tables, begins, totals)]
        bounds = np.concatenate([np.array([[0], [0], [0], [0], [1]]), *parts], axis=1)
        halo = rows["range"][0] < block * size
        start = 1 + _strongest(tables[0]) if halo else 0
        last = bounds.shape[1] - 1
        if not rows["last"][-1]:  # the next block goes on at the same boundary
            last -= tables[-1].shape[1] - 1 - _strongest(tables[-1])
        place, count, joined = bounds[0].tolist(), bounds[2].tolist(), "".join(own)
        first = chars0 - (begins[1] if halo else 0)
        recount = lambda a, b: tokens.count(joined[place[a] : place[b]], folder, file)
        done = start
        for k, (a, b, n) in enumerate(cuts(bounds, limit, overlap, start, last, halo, recount)):
            p, q = place[a], place[b]
            yield rows["row"][0], rows["id"][0], block, number + k, first + p, first + q, n, count[done] - count[a], joined[p:q] if text else None
            done = b

    def out(rows: pd.DataFrame) -> pd.DataFrame:
        ids, blocks = rows["row"].to_numpy(), rows["block"].to_numpy()
        at = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (blocks[1:] != blocks[:-1])) + 1).tolist(), len(rows)]
        columns = {c: rows[c].tolist() for c in rows.columns}
        pieces = [x for a, b in zip(at, at[1:]) for x in planned({c: v[a:b] for c, v in columns.items()})]
        return pd.DataFrame(pieces, columns=["row", "id", "block", "piece", "begin", "end", "tokens", "overlap", "text"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks lie one after the other, their ranges in order; one may go on in the next batch."""
        held = None
        for rows in batches:
            if not len(rows):
                continue
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            last = (rows["row"] == rows["row"].iloc[-1]) & (rows["block"] == rows["block"].iloc[-1])
            held = rows[last]
            if not last.all():
                yield out(rows[~last])
        if held is not None:
            yield out(held)

    return run


def _pieces(ranges: DataFrame, limit: int, overlap: int, size: int, folder: str, file: str) -> DataFrame:
    """Pieces of the texts given as a written table of ranges, ``row`` telling texts apart.

    The sums before a block travel as a row of their own with the block's ranges, so the text is shuffled once, by row and block.
    """
    ranges = ranges.withColumn("chars", F.lit(0).cast("bigint"))
    halo = ranges.where(~F.col("last") & (F.col("range") % size == size - 1)).withColumn("block", F.col("block") + 1)
    earlier = Window.partitionBy("row").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    order = lambda rows: rows.repartition("row", "block").sortWithinPartitions("row", "block", "range")
    emit = lambda rows, text: order(rows).mapInPandas(_emit(limit, overlap, size, folder, file, text), "row bigint, id bigint, block int, piece int, begin bigint, end bigint, tokens int, overlap int, text string")
    every = ranges.unionByName(halo).withColumn("total", F.col("total").cast("bigint"))
    long = ranges.where("block > 0").select("row").distinct()
    if not long.isEmpty():  # texts of several blocks need the characters and pieces before each
        several = ranges.join(long, "row", "left_semi")
        counts = emit(every.join(long, "row", "left_semi"), False).groupBy("row", "block").agg(F.count("*").alias("n"))
        sums = several.groupBy("row", "block").agg(F.sum(F.length("own")).alias("c")).join(counts, ["row", "block"], "left")
        before = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))).over(earlier), F.lit(0))
        head = sums.select("row", F.lit(0).cast("bigint").alias("id"), F.lit(-1).alias("range"), "block", F.lit(False).alias("last"), F.lit("").alias("own"), before(F.col("c")).alias("total"), F.lit(None).cast("binary").alias("bounds"), before(F.col("n")).alias("chars"))
        every = every.unionByName(head)
    return emit(every, True).select("id", "piece", "begin", "end", "tokens", "overlap", "text")


def split(df: DataFrame, key: str, text: str, *, limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE, folder: str = tokens.FOLDER, file: str = tokens.FILE) -> DataFrame:
    """(id, piece, begin, end, tokens, overlap, text) of the texts of more than ``limit`` tokens; begin and end in characters."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & (F.octet_length("text") > limit))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    return _pieces(written(rows.mapInPandas(_tables(limit, overlap, range_chars, BLOCK, folder, file), _RANGES), "ranges"), limit, overlap, BLOCK, folder, file)


def _read(limit: int, overlap: int, block: int, folder: str, file: str):
    """Ranges of files: each reads its bytes with a halo on both sides through the file system of the path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        open_systems: dict[str, tuple] = {}
        for rows in batches:
            out = []
            for i, path, length, n, a, b in zip(rows["id"], rows["path"], rows["length"], rows["range"], rows["a"], rows["b"]):
                if path not in open_systems:
                    open_systems = {path: fs.FileSystem.from_uri(path)}
                system, place = open_systems[path]
                with system.open_input_file(place) as f:
                    first = max(0, a - 8 * HALO)
                    raw = f.read_at(min(length, b + 8 * HALO) - first, first)
                cut = lambda p: next((q for q in range(p, min(p + 4, len(raw))) if raw[q] & 0xC0 != 0x80), len(raw)) if p < len(raw) else len(raw)  # noqa: B023, E731
                before, own, after = raw[: cut(a - first)].decode("utf-8", "ignore")[-HALO:] if a else "", raw[cut(a - first) : cut(b - first)].decode("utf-8", "replace"), raw[cut(b - first) :].decode("utf-8", "replace")[: 2 * HALO] if b < length else ""
                text = before + own + after
                lo = edge(text, len(before)) if a else 0
                hi = edge(text, len(before) + len(own)) if b < length else len(text)
                bounds, total = boundaries(text[: hi + HALO], lo, hi, overlap // 2, folder, file)
                out.append((i, i, n, n // block, b >= length, text[lo:hi], total, bounds.tobytes()))
            yield pd.DataFrame(out, columns=["row", "id", "range", "block", "last", "own", "total", "bounds"])

    return run


def split_files(spark: SparkSession, folder: str, *, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = 4 * RANGE, tokenizer_folder: str = tokens.FOLDER, tokenizer: str = tokens.FILE) -> DataFrame:
    """Pieces of the UTF-8 files of a shared folder, read by byte ranges; id is the hash of the path.  Ranges have at least 1,024 bytes."""
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "length").where("length > 0")
    step = max(1024, range_bytes)
    n = F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / step).cast("int"))).alias("range")
    ranges = files.select(F.xxhash64("path").alias("id"), "path", "length", n).withColumn("a", F.col("range").cast("bigint") * step).withColumn("b", F.least(F.col("length"), F.col("a") + step))
    # ranges of a file over all tasks
    tables = written(ranges.repartition("id", "range").mapInPandas(_read(limit, overlap, BLOCK, tokenizer_folder, tokenizer), _RANGES), "ranges")
    large = tables.groupBy("row").agg(F.sum("total").alias("all")).where(F.col("all") > limit).select("row")
    return _pieces(tables.join(large, "row", "left_semi"), limit, overlap, BLOCK, tokenizer_folder, tokenizer)
