"""Operator 12, maximal periodic runs of words by longest common extensions over a difference cover.

A run is a stretch of words with smallest period q, at least ``MIN_REPEATS`` periods and ``MIN_WORDS`` words long, that no
neighbouring word extends. A run of period q and r periods holds a multiple of (r - 1) q at least q words before its end, so
per period only that harmonic grid of pairs (i, i + q) is looked at. How far a pair agrees forwards and backwards gives
the whole run. For that, only suffixes at positions of a difference cover are sorted: two positions reach a common
sample within a few words, which are compared one by one; from there the minimum over common prefixes of neighbours in
the order of suffixes (a sparse table) tells the rest.

Null text: no words, no run, empty ``collapsed``. Null or repeated ids: a row each. Empty table: no rows. Any length of
text; a batch is cut by words, and only a text above the bound is held alone. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch, id_and_text, let, words_of

MIN_REPEATS, MIN_WORDS = 4, 6
#: A perfect difference set; every distance modulo 13 is the difference of two of its members.
MODULUS, COVER = 13, (0, 1, 3, 9)
#: Words searched together, and pairs compared together.
WORDS, PAIRS = 200_000, 1_000_000

RUN = "struct<start: bigint, length: bigint, period: bigint>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _meeting() -> np.ndarray:
    """``[i % v, j % v]`` to the fewest words after which both are in the cover."""
    steps = np.zeros((MODULUS, MODULUS), np.int64)
    for i in range(MODULUS):
        for j in range(MODULUS):
            steps[i, j] = next(d for d in range(MODULUS) if (i + d) % MODULUS in COVER and (j + d) % MODULUS in COVER)
    return steps


_MEETING = _meeting()
_RANK_IN_COVER = np.full(MODULUS, -1)
_RANK_IN_COVER[list(COVER)] = np.arange(len(COVER))


def _ranked(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1]


class Extensions:
    """Longest common extensions to the right in one array of numbers from 1; each text ends with a number of its own."""

    def __init__(self, words: np.ndarray):
        blocks = -(-len(words) // MODULUS) + 1
        room = (blocks + 1) * MODULUS - len(words)  # filled with further numbers of their own
        self.words = np.concatenate([words, int(words.max()) + 1 + np.arange(room)])
        at = (np.arange(blocks)[:, None] * MODULUS + np.array(COVER)).ravel()
        self.levels = self._levels(at)
        self._sort(at)

    def _levels(self, at: np.ndarray) -> list[np.ndarray]:
        """Ranks of the samples by their first v, 2 v, 4 v .. words, until no two are equal."""
        room = int(self.words.max()) + 1
        rank = self.words[at]
        for k in range(1, MODULUS):
            rank = _ranked(rank * room + self.words[at + k])
        levels, step = [rank], len(COVER)
        while step < len(at) and int(rank.max()) + 1 < len(at):
            later = np.zeros(len(at), np.int64)
            later[:-step] = rank[step:] + 1
            rank = _ranked(rank * (len(at) + 1) + later)
            levels.append(rank)
            step *= 2
        return levels

    def _sort(self, at: np.ndarray) -> None:
        """Order of the samples and the sparse table of common prefixes of neighbours, in words."""
        order = np.argsort(self.levels[-1], kind="stable")
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        left, right = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(left), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            step = len(COVER) << k
            same = (left < len(order)) & (right < len(order))
            same[same] = self.levels[k][left[same]] == self.levels[k][right[same]]
            common[same] += MODULUS << k
            left[same] += step
            right[same] += step
        inside = np.flatnonzero((left < len(order)) & (right < len(order)))
        a, b = at[left[inside]], at[right[inside]]
        for _ in range(MODULUS):
            same = self.words[a] == self.words[b]
            inside, a, b = inside[same], a[same] + 1, b[same] + 1
            common[inside] += 1
        self.table = [common]
        width = 1
        while 2 * width <= len(common):
            before = self.table[-1]
            self.table.append(np.minimum(before[:-width], before[width:]))
            width *= 2

    def _between(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common words from samples at i and j, i <> j."""
        x, y = (self.place[p // MODULUS * len(COVER) + _RANK_IN_COVER[p % MODULUS]] for p in (i, j))
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            some, row = level == k, self.table[k]
            out[some] = np.minimum(row[low[some]], row[high[some] - (1 << int(k))])
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from i and j on, i <> j."""
        out = np.zeros(len(i), np.int64)
        meet = _MEETING[i % MODULUS, j % MODULUS]
        going = np.arange(len(i))
        for d in range(MODULUS):
            there = meet[going] == d
            out[going[there]] += self._between(i[going[there]] + d, j[going[there]] + d)
            going = going[~there]
            going = going[self.words[i[going] + d] == self.words[j[going] + d]]
            out[going] += 1
        return out


def _grid(n: int, longest: int, repeats: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs ``i, q`` with i a multiple of (repeats - 1) q and i + q < n, for q up to ``longest``; some at a time."""
    q = 1
    while q <= longest:
        some = np.arange(q, min(longest, q + max(1, PAIRS * q * (repeats - 1) // n)) + 1)
        many = -(-(n - some) // (some * (repeats - 1)))
        periods = np.repeat(some, many)
        nth = np.arange(len(periods)) - np.repeat(np.cumsum(many) - many, many)
        yield nth * periods * (repeats - 1), periods
        q = int(some[-1]) + 1


def runs_of(words: np.ndarray, ends: np.ndarray, repeats: int = MIN_REPEATS, least: int = MIN_WORDS) -> np.ndarray:
    """Rows ``start, end, period`` by start and period; ``words`` are numbers from 1, with one of its own at every end of a text."""
    n = len(words)
    longest = int(np.diff(np.r_[-1, ends]).max() - 1) // repeats if len(ends) else 0
    found = [np.zeros((0, 3), np.int64)]
    if longest:
        ahead = Extensions(words)
        back = Extensions(words[::-1])
        for i, q in _grid(n, longest, repeats):
            same = words[i] == words[i + q]
            i, q = i[same], q[same]
            start = i - back.common(n - 1 - i, n - 1 - i - q) + 1
            end = i + q + ahead.common(i, i + q)
            some = end - start >= np.maximum(least, repeats * q)
            found.append(np.unique(np.stack([start, end, q], axis=1)[some], axis=0))
    every = np.unique(np.concatenate(found), axis=0)
    if len(every):  # the smallest period of a stretch: others found for it are its multiples
        every = every[np.r_[True, (every[1:, :2] != every[:-1, :2]).any(axis=1)]]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) + 1
        return number


def _search(texts: list[list[bytes]], repeats: int, least: int) -> tuple[list[list[dict]], list[str]]:
    """Runs and collapsed text of each list of words."""
    numbers = _Numbers()
    parts = [np.fromiter(map(numbers.__getitem__, t), np.int64, len(t)) for t in texts]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    words = np.empty(int(ends[-1]) + 1, np.int64)
    for k, (part, end) in enumerate(zip(parts, ends)):
        words[end - len(part) : end] = part
        words[end] = len(numbers) + 1 + k
    found = runs_of(words, ends, repeats, least)
    owner = np.searchsorted(ends, found[:, 0])
    runs: list[list[dict]] = [[] for _ in texts]
    gone: dict[int, np.ndarray] = {}
    for k, (start, end, period) in zip(owner.tolist(), found.tolist()):
        first = int(ends[k]) - len(texts[k])
        runs[k].append({"start": start - first, "length": end - start, "period": period})
        drop = gone.setdefault(k, np.zeros(len(texts[k]), bool))
        drop[start - first + period : end - first] = True
    left = [t if k not in gone else [w for w, d in zip(t, gone[k].tolist()) if not d] for k, t in enumerate(texts)]
    return runs, [b" ".join(t).decode() for t in left]


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repeats: int = MIN_REPEATS, least: int = MIN_WORDS) -> DataFrame:
    """``doc_id, runs, collapsed`` for every row: all runs by start and period, and the text without what they repeat.

    A word goes if a run holds it after that run's first period; the others are joined by one blank. ``repeats`` is 2 or more.
    """
    if repeats < 2:
        raise ValueError("a run has at least two periods")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin, texts, held = 0, [], 0
            for k, value in enumerate(b.column("text")):
                texts.append(value.as_py().encode().split())  # bytes: only ASCII white space
                held += len(texts[-1])
                if held >= WORDS or k + 1 == b.num_rows:
                    runs, left = _search(texts, repeats, least)
                    yield batch(doc_id=b.column("doc_id").slice(begin, len(texts)), runs=pa.array(runs, _RUNS), collapsed=left)
                    begin, texts, held = k + 1, [], 0

    return id_and_text(docs, doc_id, text).mapInArrow(search, f"doc_id long, runs array<{RUN}>, collapsed string")


def longest_run(runs: Column) -> Column:
    """The run of greatest length, then smallest start, then period; null without runs."""
    key = F.transform(runs, lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(key)
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), (-best["shorter"]).alias("length"), best["period"].alias("period")))


def run_lines(runs: Column) -> Column:
    """``start,length,period`` and a line feed per run."""
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return F.array_join(lines, "")


def plant_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with every tenth document (by the CRC-32 of its id) made periodic from some word on.

    With g = floor(crc / 10) and n words: word i >= a becomes word a + (i - a) % p, a = g % n, p = 1 + floor((n - a) / (3 + g % 8)).
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def repeated(words: Column) -> Column:
        n, g = F.size(words), F.floor(crc / 10)
        first = F.pmod(g, n).cast("int")
        period = (F.floor((n - first) / (g % 8 + 3)) + 1).cast("int")
        plan = F.struct(words.alias("words"), first.alias("a"), period.alias("p"))
        return let(plan, lambda v: F.array_join(
            F.transform(v["words"], lambda w, i: F.when(i < v["a"], w).otherwise(F.get(v["words"], v["a"] + (i - v["a"]) % v["p"]))), " "
        ))

    chosen = (crc % 10 == 0) & (F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     ")) != "")
    return id_and_text(docs).select("doc_id", F.when(chosen, let(words_of(F.col("text")), repeated)).otherwise(F.col("text")).alias("text"))
