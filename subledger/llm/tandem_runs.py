"""Runs (maximal periodic stretches of words) by the linear tandem-repeat method of Gusfield and Stoye.

1. The text is cut into Lempel-Ziv blocks. The second half of a square touches at most two blocks, so the squares that are centred in a block are found by common extensions to both sides of
   its borders; they cover all squares: each kind of square is, in its leftmost place, one of them or follows one by single steps to the right.
2. From each of them a walk goes over suffix links: from the square ``a b`` at i (a is its first word) to ``b a``, as far as its own place carries on, then at any other place where ``b`` is followed by ``a``. That completes the vocabulary of squares.
3. The places of each square are the suffixes under its locus in the suffix tree. Places in a row with one period are a run.

The suffix tree is held as sorted suffixes with common prefixes. All texts of a batch share one tree, parted by words that occur once. Steps are numpy operations over all blocks, walks and places of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from subledger.llm.words import groups, split_all

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
#: Bytes of text that share one suffix tree, which takes some hundred times as many where all of it repeats.
TREE_BYTES = 256 << 10


def _lowest(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: at level j the least of 2**j values from each place on."""
    levels = [values]
    while len(levels[-1]) > 1 << (len(levels) - 1):
        step, last = 1 << (len(levels) - 1), levels[-1]
        if len(last) <= step:
            break
        levels.append(np.minimum(last[:-step], last[step:]))
    return levels


def _leftwards(levels: list[np.ndarray], at: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The first place p <= at + 1 from which on all values up to ``at`` are >= bound."""
    p = at + 1
    for j in range(len(levels) - 1, -1, -1):
        q = p - (1 << j)
        p = np.where((q >= 0) & (levels[j][np.clip(q, 0, len(levels[j]) - 1)] >= bound), q, p)
    return p


def _rightwards(levels: list[np.ndarray], at: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The place after the last p >= at - 1 up to which all values from ``at`` on are >= bound."""
    p, n = at, len(levels[0])
    for j in range(len(levels) - 1, -1, -1):
        p = np.where((p + (1 << j) <= n) & (levels[j][np.clip(p, 0, len(levels[j]) - 1)] >= bound), p + (1 << j), p)
    return p


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each span, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class Suffixes:
    """Sorted suffixes of a row of symbols whose first and last occur once.

    ``names[j]`` numbers the stretches of 2**j symbols from each place on, equal ones alike, in order.
    """

    def __init__(self, symbols: np.ndarray):
        n = self.n = len(symbols)
        name = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        self.names, step = [], 1
        while True:
            self.names.append(name.astype(np.int32))
            if int(name.max()) == n - 1:
                break
            after = np.zeros(n, np.int64)
            after[:-step] = name[step:] + 1
            name = np.unique(name * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
            step *= 2
        self.rank = (self.names.pop() if len(self.names) > 1 else self.names[0]).astype(np.int64)
        self.order = np.empty(n, np.int64)
        self.order[self.rank] = np.arange(n)
        common = self.forward(self.order[:-1], self.order[1:])
        self.common = _lowest(common)  # common[r]: of the suffixes of rank r and r + 1

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols are equal from the places ``a`` and ``b`` (different ones) on."""
        far = np.zeros(len(a), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            far += (self.names[j][a + far] == self.names[j][b + far]).astype(np.int64) << j
        return far

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols are equal from the places ``a`` and ``b`` on, these included, to the left."""
        far = np.zeros(len(a), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            x, y = a - far - (1 << j) + 1, b - far - (1 << j) + 1
            inside = (x >= 0) & (y >= 0)
            far += (inside & (self.names[j][np.maximum(x, 0)] == self.names[j][np.maximum(y, 0)])).astype(np.int64) << j
        return far

    def under(self, rank: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First rank and rank after the last of the suffixes that share ``depth`` symbols with that of ``rank``."""
        return _leftwards(self.common, rank - 1, depth), _rightwards(self.common, rank, depth) + 1

    def blocks(self) -> np.ndarray:
        """Starts of the Lempel-Ziv blocks: each is the longest that occurs further left too (it may reach into itself), or one symbol."""
        lowest, ranks = _lowest(self.order), np.arange(self.n)
        # The nearest suffixes in order, on either side, that start further left.
        sides = _leftwards(lowest, ranks - 1, self.order) - 1, _rightwards(lowest, ranks + 1, self.order)
        longest = np.zeros(self.n, np.int64)
        for side in sides:
            some = np.flatnonzero((side >= 0) & (side < self.n))
            at = self.order[some]
            longest[at] = np.maximum(longest[at], self.forward(at, self.order[side[some]]))
        starts, at, steps = [], 0, np.maximum(longest, 1).tolist()
        while at < self.n:
            starts.append(at)
            at += steps[at]
        return np.array(starts)


def covering_squares(text: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares, among them for each kind of square one from which steps to the right lead to its leftmost place."""
    starts = text.blocks()
    lengths = np.diff(starts, append=text.n)
    after = starts + lengths
    symbol = text.names[0]
    # Squares across a block's right border that are centred in the block.
    block = np.repeat(np.arange(len(starts)), lengths)
    k = _spans(np.ones(len(starts), np.int64), lengths)
    right = after[block]
    some = right < text.n
    some[some] = symbol[right[some]] == symbol[right[some] - k[some]]
    k, right = k[some], right[some]
    q = right - k
    ahead, back = text.forward(right, q), np.where(q > 0, text.backward(right - 1, np.maximum(q - 1, 0)), 0)
    found = ahead + back >= k
    first = [np.maximum(q - back, q - k + 1)[found]], [k[found]]
    # Squares across its left border that are centred in it.
    reach = lengths + np.append(lengths[1:], 0)
    block = np.repeat(np.arange(len(starts)), reach)
    k = _spans(np.ones(len(starts), np.int64), reach)
    left = starts[block]
    some = (left > 0) & (left + k < text.n)
    some[some] = (symbol[left[some]] == symbol[left[some] + k[some]]) & (symbol[left[some] - 1] == symbol[left[some] + k[some] - 1])
    k, left, end = k[some], left[some], after[block[some]]
    ahead, back = text.forward(left, left + k), text.backward(left - 1, left + k - 1)
    start = np.maximum(left - back, left - k + 1)
    found = (ahead + back >= k) & (start + k <= end)
    both = np.concatenate([*first[0], start[found]]), np.concatenate([*first[1], k[found]])
    return tuple(np.unique(np.stack(both, 1), axis=0).T)


def _primitive(text: Suffixes, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether a square's half is no repetition itself."""
    kinds, which = np.unique(period, return_inverse=True)
    parts = []
    for k in kinds.tolist():
        primes, rest, p = [], k, 2
        while p * p <= rest:
            if rest % p == 0:
                primes.append(k // p)
                while rest % p == 0:
                    rest //= p
            p += 1
        parts.append([*primes, k // rest] if rest > 1 else primes)
    counts = np.array([len(p) for p in parts], np.int64)
    flat = np.array([d for p in parts for d in p], np.int64)
    owner = np.repeat(np.arange(len(start)), counts[which])
    part = flat[_spans((np.cumsum(counts) - counts)[which], counts[which])]
    repeats = text.forward(start[owner], start[owner] + part) >= 2 * period[owner] - part
    return np.bincount(owner[repeats], minlength=len(start)) == 0


def vocabulary(text: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of one place of each kind of square with a primitive half; some kinds come more than once."""
    start, period = covering_squares(text)
    some = _primitive(text, start, period)
    start, period = start[some], period[some]
    need, found, seen = period.copy(), [], np.zeros((0, 2), np.int64)
    while len(start):
        carried = np.minimum(text.forward(start, start + period) - period + 1, need)
        found.append((_spans(start, carried), np.repeat(period, carried)))
        more = carried < need
        last, period = (start + carried - 1)[more], period[more]
        # Over the suffix link: another place of what follows the first word, there followed by that word.
        depth, word = 2 * period - 1, text.names[0][last]
        low, high = text.under(text.rank[last + 1], depth)
        end = high
        while (open_ := low < high).any():
            middle = (low + high) // 2
            less = open_ & (text.names[0][np.minimum(text.order[np.minimum(middle, text.n - 1)] + depth, text.n - 1)] < word)
            low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
        there = low < end
        there[there] = text.names[0][text.order[low[there]] + depth[there]] == word[there]
        # A walk that comes to a locus where another has been stops: that one has gone on, or come round.
        loci = np.stack([low[there], period[there]], 1)
        known = len(seen)
        both, first = np.unique(np.concatenate([seen, loci]), axis=0, return_index=True)
        new = np.sort(first[first >= known]) - known
        seen = both
        start, period = text.order[low[there]][new], period[there][new]
        need = period.copy()
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def all_runs(symbols: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run of exponent 2 or more, in order of period and start; the first and the last symbol occur once."""
    text = Suffixes(symbols)
    start, period = vocabulary(text)
    low, high = text.under(text.rank[start], 2 * period)
    kinds = np.unique(np.stack([low, high, period], 1), axis=0)
    count = kinds[:, 1] - kinds[:, 0]
    places = np.unique(np.stack([np.repeat(kinds[:, 2], count), text.order[_spans(kinds[:, 0], count)]], 1), axis=0)
    if not len(places):
        return np.zeros((0, 3), np.int64)
    cut = np.flatnonzero(np.any(np.diff(places, axis=0) != [0, 1], axis=1)) + 1
    begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(places)]]) - 1
    return np.stack([places[begin, 1], places[end, 1] - places[begin, 1] + 2 * places[begin, 0], places[begin, 0]], 1)


def window(least_length: int, least_exponent: int) -> int:
    """Any stretch of so many words in a run occurs at least twice there: a run is longer than its period by this much, and by a period more at exponent 3."""
    return max(1, min(max(least_length, least_exponent * q) - q for q in (max(1, least_length // least_exponent), least_length // least_exponent + 1)))


def runs_of(words: np.ndarray, starts: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """(text, start, length, period) of the runs of all texts, in that order but period before length; ``words`` are numbers, ``starts`` says where each text's begin.

    Words that no repeated window covers lie in no such run, and only the others are put into the tree; windows are compared by hash, so that an equal hash of different ones costs time only.
    """
    n, size = len(words), window(least_length, least_exponent)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    covered = np.zeros(n + 1, np.int64)
    if n >= size:
        mixed = np.zeros(n - size + 1, np.uint64)
        for j in range(size):
            mixed = (mixed ^ words[j : n - size + 1 + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        mixed = (mixed ^ owner[: len(mixed)].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = np.where(owner[: len(mixed)] == owner[size - 1 :], mixed, np.arange(len(mixed), dtype=np.uint64))
        order = np.argsort(mixed)
        alike = mixed[order[1:]] == mixed[order[:-1]]
        again = np.zeros(len(mixed), bool)
        again[order[1:][alike]] = again[order[:-1][alike]] = True
        again &= owner[: len(mixed)] == owner[size - 1 :]
        at = np.flatnonzero(again)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + size, -1)
    kept = np.cumsum(covered)[:n] > 0
    edges = np.diff(np.concatenate([[0], kept.astype(np.int8), [0]]))
    edges[starts[(starts > 0) & (starts < n)]] = np.where(kept[starts[(starts > 0) & (starts < n)] - 1] & kept[starts[(starts > 0) & (starts < n)]], 2, edges[starts[(starts > 0) & (starts < n)]])
    begin, end = np.flatnonzero(edges > 0), np.flatnonzero((edges < 0) | (edges == 2))
    long = end - begin >= least_length
    begin, end = begin[long], end[long]
    if not len(begin):
        return np.zeros((0, 4), np.int64)
    # Each stretch with a word of its own before it, and one at the end of all.
    sizes = end - begin + 1
    place = _spans(begin - 1, sizes)
    heads = np.cumsum(sizes) - sizes
    symbols = words[np.maximum(place, 0)].astype(np.int64)
    symbols[heads] = -1 - np.arange(len(heads))
    found = all_runs(np.append(symbols, -1 - len(heads)))
    found = found[(found[:, 1] >= least_length) & (found[:, 1] >= least_exponent * found[:, 2])]
    at = place[found[:, 0]]
    rows = np.stack([owner[at], at - starts[owner[at]], found[:, 1], found[:, 2]], 1)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _collapsed(words: list[bytes], runs: np.ndarray) -> str:
    if len(runs):
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
        np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
    return b" ".join(words).decode("utf-8", "replace")


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _tandem(batches: Iterator[pa.RecordBatch], carry: list[str], least_length: int, least_exponent: int) -> Iterator[pa.RecordBatch]:
    for batch in groups(batches, most_bytes=TREE_BYTES):
        words, starts = split_all(batch.column("text").to_pylist())
        number = {w: i for i, w in enumerate(set(words))}
        found = runs_of(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), starts, least_length, least_exponent)
        cuts = np.searchsorted(found[:, 0], np.arange(batch.num_rows + 1))
        texts = [_collapsed(words[starts[i] : starts[i + 1]], found[cuts[i] : cuts[i + 1], 1:]) for i in range(batch.num_rows)]
        struct = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in (1, 2, 3)], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), struct)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(np.diff(starts)), lists, pa.array(texts, pa.string())], [*carry, "n_words", "runs", "collapsed"])


def tandem_runs(docs: DataFrame, carry: list[str], text_col: str = "text", least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """One row for each row of ``docs``: the columns ``carry``, n_words, runs (start, length, period in words; in order of start, then period) and collapsed.

    Words are what ASCII white space parts. A run is a maximal stretch with smallest period q, of ``least_length`` words and ``least_exponent`` (3 at least) times q or more. ``collapsed`` has the words, joined by one space, that no run contains after its first q.
    A null or empty text has no words, no runs and an empty ``collapsed``. Rows that repeat are rows of their own; nulls in other columns are carried; no column can clash but the three that are made. Each text is searched whole, whatever its length: a task holds the tree of one batch of texts, TREE_BYTES of them or one text.
    """
    if least_exponent < 3 or least_length < 2 * least_exponent - 2:
        raise ValueError("a run has an exponent of 3 at least and twice as many words, less 2")
    integer, run = LongType(), StructType().add("start", LongType()).add("length", LongType()).add("period", LongType())
    rows = docs.select(*(F.col(c) for c in carry if c != text_col), F.col(text_col).cast("string").alias("text"))
    schema = StructType([f for f in rows.schema.fields if f.name in carry]).add("n_words", integer).add("runs", ArrayType(run)).add("collapsed", StringType())
    return rows.mapInArrow(partial(_tandem, carry=[c for c in rows.columns if c in carry], least_length=least_length, least_exponent=least_exponent), schema)
