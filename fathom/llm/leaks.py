"""Evaluation texts leaking into a corpus (problem 7): latent semantic retrieval, then exact checks.

The stated query set (evaluation references) is taken in blocks of bounded size, and each
stage is one scan of the corpus for all blocks of a pass.  Passages are windows of letters
and digits; their features are the runs of ``GRAM`` letters that a block's references
hold, weighted by TF-IDF with frequencies over the whole corpus and hashed to ``COLUMNS``
columns.  A distributed randomised SVD gives the latent space: A'AΩ is summed over
partitions in two levels, and its Nyström form yields singular vectors and values of the
passages A from that one scan; the ``RANK`` leading ones of ``SKETCH`` are kept.  In that space each
passage is compared with every passage of the references by cosine.  The candidates are
checked on the text: for a shared run of letters and digits, exactly (``leaked``), or for rewordings, by the
longest common subsequence of the passages and the answers that stand next to it (``reworded``).

A passage goes into the search if it holds ``least`` reference runs, in any order and place: for
exact leaks as many as the shortest reportable run has, so nothing is lost by that.

Null or empty texts leak nothing; a null or empty reference is never found; repeated
documents count each; rows without a key are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .covering import hash_runs

GRAM, WINDOW, COLUMNS, RANK, SKETCH = 5, 48, 8192, 64, 80
#: Cases of a block, and blocks that the tasks hold at a time.
BLOCK, PASS = 2_000, 8
#: Letters and digits of an answer that tells by itself; shorter ones stand in any text.
TELLING = 4
#: Of rewordings: least reference runs of a passage, cosine, share of the passage in common, answers beside it.
REWORDED = {"grams": 8, "cosine": 0.4, "share": 0.6, "answers": 2}
_OTHER = re.compile(r"[\W_]+")
_BITS = 22


def letters(text: str | None) -> str:
    return _OTHER.sub("", text.lower()) if text else ""


def run_hashes(text: str, sizes: list[int]) -> dict[int, np.ndarray]:
    """Of each size, 64-bit hashes of all runs of that many letters, by doubling."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(0x9E37)
    power, level = {1: codes}, 1
    base = 0x9E3779B97F4A7C15
    while 2 * level <= max(sizes, default=1):
        p, b = power[level], np.uint64(pow(base, level, 1 << 64))
        power[2 * level] = p[:-level] * b + p[level:] if len(p) > level else p[:0]
        level *= 2
    out = {}
    for k in sizes:
        n, done, h = max(0, len(codes) - k + 1), 0, None
        for part in sorted((s for s in power if k & s), reverse=True):
            own = power[part][done : done + n]
            h = own.copy() if h is None else h * np.uint64(pow(base, part, 1 << 64)) + own
            done += part
        h = h if h is not None else np.zeros(0, np.uint64)
        h ^= h >> np.uint64(31)
        out[k] = h * np.uint64(0xBF58476D1CE4E5B9)
    return out


class Block:
    """The passages of one block of references: bounded by the block's size, so it may be sent to every task."""

    def __init__(self, cases: list[tuple[int, str | None, str, list[str] | None]], short: int, long: int, grams: int | None = None):
        texts = [(c, short if lang == "zh" else long, letters(t), sorted({letters(a) for a in answers or ()})) for c, lang, t, answers in cases]
        self.cases = [x for x in texts if len(x[2]) >= x[1]]
        self.telling = [[a for a in own if len(a) >= TELLING] for _, _, _, own in self.cases]
        self.sizes = sorted({k for _, k, _, _ in self.cases})
        self.windows = [(n, s[i : i + 2 * k]) for n, (_, k, s, _) in enumerate(self.cases) for i in range(0, max(1, len(s) - k), k // 2)]
        self.least = grams or min(short, long) - GRAM + 1
        self.vocabulary = np.unique(hash_runs([w for _, w in self.windows], GRAM)[0]) if self.windows else np.zeros(0, np.uint32)
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[self.vocabulary >> (32 - _BITS)] = True
        self.column = (self.vocabulary * np.uint32(2654435761) >> np.uint32(19)).astype(np.int64)
        self.weight = np.ones(len(self.vocabulary), np.float32)
        self.basis = np.zeros((0, COLUMNS))
        self._known: dict[int, np.ndarray] = {}
        self.runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in self.sizes:
            own = [(n, run_hashes(s, [k])[k]) for n, (_, size, s, _) in enumerate(self.cases) if size == k]
            h, n = np.concatenate([x for _, x in own]), np.concatenate([np.full(len(x), i, np.int64) for i, x in own])
            order = np.lexsort((n, h))
            self.runs[k] = h[order], n[order]

    def features(self, texts: list[str], h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions, over all texts in a row, and vocabulary numbers of the runs that references hold; ``h``: the hashes of all runs, where known."""
        none = np.zeros(0, np.int64)
        if sum(map(len, texts)) < GRAM or not len(self.vocabulary):
            return none, none
        h = hash_runs(texts, GRAM)[0] if h is None else h
        at = np.flatnonzero(self.filter[h >> (32 - _BITS)])
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        end = np.cumsum(size)
        at = at[end[np.searchsorted(end, at, "right")] - at >= GRAM]  # runs across two texts are none
        n = np.searchsorted(self.vocabulary, h[at])
        n[n == len(self.vocabulary)] = 0
        ok = self.vocabulary[n] == h[at]
        return at[ok], n[ok]

    def vectors(self, n: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weighted, normalised passages (slices of the features n) as rows, columns, values."""
        size = end - begin
        rows = np.repeat(np.arange(len(size)), size)
        each = n[np.arange(len(rows)) + np.repeat(begin - np.cumsum(size) + size, size)]
        values = self.weight[each].astype(np.float64)
        norm = np.sqrt(np.bincount(rows, values**2, len(size)))
        return rows, self.column[each], values / np.maximum(norm, 1e-9)[rows]

    def known(self, k: int) -> np.ndarray:
        """Of run hashes of size ``k``, by their leading bits, whether a reference has one."""
        if k not in self._known:
            self._known[k] = np.zeros(1 << _BITS, bool)
            self._known[k][self.runs[k][0] >> np.uint64(64 - _BITS)] = True
        return self._known[k]

    @cached_property
    def table(self) -> np.ndarray:
        """Of each run of the vocabulary, its weighted place in the latent space."""
        return np.ascontiguousarray(self.basis.T.astype(np.float32)[self.column] * self.weight[:, None])

    def latent(self, n: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Passages (slices of the features n, one after the other) in the latent space, of unit length: passages x rank."""
        own = self.table
        total = np.zeros((len(begin), own.shape[1]), np.float32)
        for first in range(0, len(begin), 4096):
            part = slice(first, first + 4096)
            a, b = begin[part], end[part]
            x = own[n[a.min() : b.max()]]
            edges = np.stack([a, b], 1).ravel() - a.min()
            total[part] = np.add.reduceat(np.vstack([x, np.zeros((1, x.shape[1]), np.float32)]), edges)[::2]
        return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)

    def queries(self) -> np.ndarray:
        """The references' passages in the latent space."""
        at, n = self.features([w for _, w in self.windows])
        edges = np.searchsorted(at, np.cumsum([0, *(len(w) for _, w in self.windows)]))
        return self.latent(n, edges[:-1], edges[1:])


def _passages(block: Block, texts: list[str], h: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Half overlapping windows with at least ``block.least`` reference runs: text number and place, slice of the features; the features."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin, half = np.cumsum(size) - size, WINDOW // 2
    at, n = block.features(texts, h)
    text = np.searchsorted(np.cumsum(size), at, "right")
    first = np.cumsum(size // half + 2) - size // half - 2  # numbers of the half windows; each text has one to spare
    cell = first[text] + (at - begin[text]) // half if len(at) else at
    total = int(size.sum() // half + 2 * len(texts)) + 2
    count = np.bincount(cell, minlength=total)
    start = np.concatenate([[0], np.cumsum(count)])
    w = np.flatnonzero(count[:-1] + count[1:] >= block.least)
    a, b = start[w], start[w + 2]
    owner = text[a] if len(w) else w
    same = text[b - 1] == owner if len(w) else np.zeros(0, bool)
    w, a, b, owner = w[same], a[same], b[same], owner[same]
    return owner, (w - first[owner]) * half if len(w) else w, a, b, n


def _groups(rows: pd.DataFrame) -> Iterator[tuple[list[int], list[str], np.ndarray]]:
    """Ids, letters and run hashes of about a megabyte of texts at a time, whole texts each."""
    ids, texts, size = [], [], 0
    for i, t in zip(rows["id"] if "id" in rows else range(len(rows)), rows["text"]):
        if t and len(s := letters(t)) >= GRAM:
            ids.append(i)
            texts.append(s)
            size += len(s)
            if size > 500_000:
                yield ids, texts, hash_runs(texts, GRAM)[0]
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts, hash_runs(texts, GRAM)[0]


def _counts(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = shared.value
        total = [np.zeros(len(b.vocabulary), np.int64) for b in blocks]
        for rows in batches:
            for _, texts, h in _groups(rows):
                for b, t in zip(blocks, total):
                    t += np.bincount(b.features(texts, h)[1], minlength=len(t))
        for k, t in enumerate(total):
            seen = np.flatnonzero(t)
            yield pd.DataFrame({"block": k, "n": seen, "count": t[seen]})

    return run


def _sketch(shared, omega: np.ndarray, pieces: int):
    """Per partition and block: A'AΩ over its passages, in row pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        blocks = shared.value
        total = [np.zeros((COLUMNS, SKETCH), np.float32) for _ in blocks]
        thin = omega.astype(np.float32)
        for rows in batches:
            for _, texts, h in _groups(rows):
                for block, t in zip(blocks, total):
                    _, _, begin, end, n = _passages(block, texts, h)
                    for first in range(0, len(begin), 4096):
                        r, c, v = block.vectors(n, begin[first : first + 4096], end[first : first + 4096])
                        v = v.astype(np.float32)[:, None]
                        starts = np.flatnonzero(np.diff(r, prepend=-1))
                        y = np.add.reduceat(thin[c] * v, starts)
                        order = np.argsort(c, kind="stable")
                        own = c[order]
                        edge = np.flatnonzero(np.diff(own, prepend=-1))
                        t[own[edge]] += np.add.reduceat((y[r] * v)[order], edge)
        salt, step = TaskContext.get().partitionId() % 32, COLUMNS // pieces
        for k, t in enumerate(total):
            yield pd.DataFrame({"block": k, "piece": range(pieces), "salt": salt, "sums": [t[i * step : (i + 1) * step].tobytes() for i in range(pieces)]})

    return run


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(b, np.float32) for b in rows["sums"])
    return rows.iloc[:1].assign(sums=[total.tobytes()])


def singular(y: np.ndarray, omega: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors (rank x columns) and singular values of A, from Y = A'AΩ: the Nyström form of A'A."""
    shift = 1e-6 * max(float(np.linalg.norm(y)), 1e-12)  # keeps the small matrix positive
    moved = y + shift * omega
    small = omega.T @ moved
    root = np.linalg.cholesky((small + small.T) / 2 + 1e-9 * np.trace(small) / len(small) * np.eye(len(small)))
    u, s, _ = np.linalg.svd(np.linalg.solve(root, moved.T).T, full_matrices=False)
    return np.ascontiguousarray(u[:, :rank].T), np.sqrt(np.maximum(s[:rank] ** 2 - shift, 0))


def candidates(block: Block, queries: np.ndarray, begin: np.ndarray, end: np.ndarray, n: np.ndarray, least_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(passage, reference window) pairs of at least the cosine, in the order of the passages."""
    passages, windows = [], []
    for first in range(0, len(begin), 2048):
        close = np.flatnonzero(block.latent(n, begin[first : first + 2048], end[first : first + 2048]) @ queries.T >= least_cosine)
        passages.append(close // len(queries) + first)
        windows.append(close % len(queries))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *passages]), np.concatenate([none, *windows])


def _exact(block: Block, texts: list[str], owner: np.ndarray, place: np.ndarray, passage: np.ndarray, case: np.ndarray) -> set[tuple[int, int]]:
    """(text number, case number) of candidates whose text shares a long enough run with the case, around the passage."""
    found: set[tuple[int, int]] = set()
    size, half = np.fromiter(map(len, texts), np.int64, len(texts)), WINDOW // 2
    end = np.cumsum(size)
    starts = (end - size)[owner] + place  # of all passages, ascending
    edges = np.searchsorted(passage, np.arange(len(owner) + 1))
    own = starts[np.diff(edges) > 0]
    joined = "".join(texts)
    hashes = run_hashes(joined, block.sizes)
    for k in block.sizes:
        n = len(joined) + WINDOW + 2
        near = np.bincount(np.maximum(own - k + half, 0), minlength=n) - np.bincount(own + WINDOW - half + 1, minlength=n)
        h, (of_cases, numbers) = hashes[k], block.runs[k]
        at = np.flatnonzero(np.cumsum(near)[: len(h)])
        at = at[block.known(k)[h[at] >> np.uint64(64 - _BITS)]]
        i = np.searchsorted(of_cases, h[at])
        i[i == len(of_cases)] = 0
        same = of_cases[i] == h[at]
        at, i = at[same], i[same]
        text = np.searchsorted(end, at, "right")
        first, last = edges[np.searchsorted(starts, np.maximum(at - WINDOW + 1, (end - size)[text]))], edges[np.searchsorted(starts, at + k)]
        whole = at + k <= end[text]  # a run across two texts is none
        for p, t, j, a, b in zip(at[whole].tolist(), text[whole].tolist(), i[whole].tolist(), first[whole].tolist(), last[whole].tolist()):
            while j < len(of_cases) and of_cases[j] == h[p]:
                c = int(numbers[j])
                if (t, c) not in found and (case[a:b] == c).any() and joined[p : p + k] in block.cases[c][2]:
                    found.add((t, c))
                j += 1
    return found


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rest = full
    for c in b:
        if hits := place.get(c):
            u = rest & hits
            rest = (rest + u | rest - u) & full
    return len(a) - rest.bit_count()


def _answered(block: Block, words, texts: list[str], answers: int) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """(text number, case number) → places and numbers of the case's answers, where the text holds enough of them; a number counts only as a whole."""
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for t, s in enumerate(texts):
        for last, (n, uses) in words.iter(s) if len(words) else ():
            p = last - n + 1
            if (s[p].isdigit() and s[p - 1 : p].isdigit()) or (s[last].isdigit() and s[last + 1 : last + 2].isdigit()):
                continue
            for c, number in uses:
                found.setdefault((t, c), []).append((p, number))
    return {k: v for k, v in found.items() if len({n for _, n in v}) >= min(answers, len(block.telling[k[1]]))}


def _short(text: str, answers: list[str], least: int) -> bool:
    """Whether ``least`` of the answers too short to tell (or all, if fewer) stand in the text, numbers as whole ones."""
    short = [a for a in answers if 0 < len(a) < TELLING]
    return sum(re.search(rf"(?<!\d){a}(?!\d)", text) is not None for a in short) >= min(least, len(short))


def _words(block: Block):
    """Automaton over the telling answers of all cases."""
    import ahocorasick

    words, uses = ahocorasick.Automaton(), {}
    for c, own in enumerate(block.telling):
        for number, w in enumerate(own):
            uses.setdefault(w, []).append((c, number))
    for w, v in uses.items():
        words.add_word(w, (len(w), v))
    if uses:
        words.make_automaton()
    return words


def _reworded(block: Block, words, texts: list[str], owner: np.ndarray, place: np.ndarray, passage: np.ndarray, window: np.ndarray, case: np.ndarray, share: float, answers: int) -> set[tuple[int, int]]:
    """(text number, case number) of candidates that say the reference in other words: its answers beside the passage, and enough of its passage in order."""
    found: set[tuple[int, int]] = set()
    held = _answered(block, words, texts, answers)
    able = np.array(sorted(t << 20 | c for t, c in held), np.int64)
    silent = np.array([not own for own in block.telling])
    keep = np.isin(owner[passage] << 20 | case, able) | silent[case]
    for p, w in zip(passage[keep].tolist(), window[keep].tolist()):
        t, at, (c, wanted) = int(owner[p]), int(place[p]), block.windows[w]
        if (t, c) in found:
            continue
        beside = {n for q, n in held.get((t, c), ()) if at - 2 * WINDOW <= q < at + 3 * WINDOW}
        own = block.telling[c]
        if len(beside) < min(answers, len(own)) or len(own) < answers and not _short(texts[t][max(0, at - 2 * WINDOW) : at + 3 * WINDOW], block.cases[c][3], answers - len(own)):
            continue
        more = max(0, len(wanted) - WINDOW) // 2 + WINDOW // 4
        if common(wanted, texts[t][max(0, at - more) : at + WINDOW + more]) >= share * len(wanted):
            found.add((t, c))
    return found


def _search(shared, least_cosine: float, share: float | None, answers: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = shared.value
        queries = [b.queries() for b in blocks]
        words = [_words(b) if share is not None else None for b in blocks]
        for rows in batches:
            leaks: set[tuple[int, int]] = set()
            for ids, texts, h in _groups(rows):
                for block, q, w in zip(blocks, queries, words):
                    owner, place, begin, end, n = _passages(block, texts, h)
                    passage, window = candidates(block, q, begin, end, n, least_cosine)
                    if not len(passage):
                        continue
                    case = np.array([c for c, _ in block.windows])[window]
                    found = _exact(block, texts, owner, place, passage, case)
                    if share is not None:
                        found = _reworded(block, w, texts, owner, place, passage, window, case, share, answers) - found
                    leaks |= {(ids[t], block.cases[c][0]) for t, c in found}
            yield pd.DataFrame(sorted(leaks), columns=["id", "case_id"])

    return run


def _blocks(cases: DataFrame, short: int, long: int, block_size: int, grams: int | None) -> Iterator[list[Block]]:
    """The blocks of the query set, some at a time: a case has its block by the hash of its id."""
    stated = cases.where(F.col("case_id").isNotNull() & F.col("reference").isNotNull())
    answers = F.col("expect_any") if "expect_any" in cases.columns else F.array().cast("array<string>")
    stated = stated.select(F.col("case_id").cast("bigint").alias("case_id"), "lang", "reference", answers.alias("answers"))
    n = max(1, -(-stated.count() // block_size))
    number = F.pmod(F.xxhash64("case_id"), F.lit(n))
    for first in range(0, n, PASS):
        own = stated.withColumn("block", number).where(F.col("block").between(first, first + PASS - 1)).orderBy("case_id").collect()
        blocks = [Block([tuple(r)[:4] for r in own if r["block"] == b], short, long, grams) for b in range(first, first + PASS)]
        if blocks := [b for b in blocks if b.windows]:
            yield blocks


def _leaks(documents: DataFrame, key: str, text: str, cases: DataFrame, *, short: int, long: int, least_cosine: float, block_size: int, grams: int | None = None, share: float | None = None, answers: int = 0) -> DataFrame:
    docs = documents.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull() & F.col("id").isNotNull())
    spark, out = documents.sparkSession, None
    for blocks in _blocks(cases, short, long, block_size, grams):
        found = _pass(docs, blocks, least_cosine, share, answers)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "id bigint, case_id bigint") if out is None else out.distinct()


def _pass(docs: DataFrame, blocks: list[Block], least_cosine: float, share: float | None, answers: int) -> DataFrame:
    only, context = docs.select("text"), docs.sparkSession.sparkContext
    shared = context.broadcast(blocks)
    counts = only.mapInPandas(_counts(shared), "block int, n bigint, count bigint").groupBy("block", "n").agg(F.sum("count").alias("count")).toPandas()
    for k, block in enumerate(blocks):
        own, total = counts[counts["block"] == k], np.zeros(len(block.vocabulary))
        total[own["n"]] = own["count"]
        block.weight = np.log((total.sum() + 1) / (total + 1)).astype(np.float32)
    shared = context.broadcast(blocks)
    omega = np.random.default_rng(7).standard_normal((COLUMNS, SKETCH))
    sums = only.mapInPandas(_sketch(shared, omega, 32), "block int, piece int, salt int, sums binary")
    sums = sums.groupBy("block", "piece", "salt").applyInPandas(_add, "block int, piece int, salt int, sums binary").groupBy("block", "piece").applyInPandas(_add, "block int, piece int, salt int, sums binary")
    done = sums.toPandas().sort_values(["block", "piece"])
    for k, block in enumerate(blocks):
        own = done.loc[done["block"] == k, "sums"] if len(done) else ()
        if len(own):
            y = np.frombuffer(b"".join(own), np.float32).reshape(COLUMNS, SKETCH).astype(np.float64)
            block.basis = singular(y, omega, RANK)[0]
    if not len(done):  # no documents
        return docs.where("false").select("id", F.lit(0).cast("bigint").alias("case_id"))
    return docs.mapInPandas(_search(context.broadcast(blocks), least_cosine, share, answers), "id bigint, case_id bigint")


def leaked(documents: DataFrame, key: str, text: str, cases: DataFrame, *, short: int = 24, long: int = 60, least_cosine: float = 0.3, block_size: int = BLOCK) -> DataFrame:
    """(id, case_id): documents whose text shares a run of letters and digits of ``short`` (zh) or ``long`` (else) with a reference.

    ``cases`` has case_id, lang, reference; it is the query set and goes through in blocks of about ``block_size``.
    """
    return _leaks(documents, key, text, cases, short=short, long=long, least_cosine=least_cosine, block_size=block_size)


def reworded(documents: DataFrame, key: str, text: str, cases: DataFrame, *, short: int = 24, long: int = 60, least_cosine: float = REWORDED["cosine"], share: float = REWORDED["share"], answers: int = REWORDED["answers"], grams: int = REWORDED["grams"], block_size: int = BLOCK) -> DataFrame:
    """(id, case_id): documents that say a passage of a reference in other words, without a run that ``leaked`` reports.

    A passage of at least ``least_cosine`` has, in the order of the reference's passage, ``share`` of its letters, and near
    it stand ``answers`` of the case's ``expect_any`` (all where it has fewer), those of at least ``TELLING`` letters first.
    """
    return _leaks(documents, key, text, cases, short=short, long=long, least_cosine=least_cosine, block_size=block_size, grams=grams, share=share, answers=answers)
