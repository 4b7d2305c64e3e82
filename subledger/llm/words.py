"""Arrow-batch helpers for operators that look at every word: a bounded memory of words already seen, and groups of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are taken apart at once.
GROUP_BYTES = 2 << 20
GROUP_ROWS = 32_000


class WordTable:
    """Numbers words and remembers one row (or a run) of numbers for each; forgets all when it holds too much.

    Subclasses say in ``compute`` what a list of new words has: an array with one row for each word.
    """

    def __init__(self, most_words: int = 500_000, most_bytes: int = 32 << 20):
        self.most_words, self.most_bytes = most_words, most_bytes
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.bytes, self.parts, self.rows = 0, [], None

    def compute(self, words: list[bytes]) -> np.ndarray:
        raise NotImplementedError

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(row number of each word, rows)."""
        if len(self.number) > self.most_words or self.bytes > self.most_bytes:
            self._forget()
        new = list(set(words) - self.number.keys())
        if new:
            at = len(self.number)
            self.number.update(zip(new, range(at, at + len(new)), strict=True))
            self.bytes += sum(map(len, new))
            self.add(self.compute(new))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)), self.all_rows()

    def add(self, rows: np.ndarray) -> None:
        self.parts.append(rows)

    def all_rows(self) -> np.ndarray:
        if len(self.parts) > 1:
            self.parts = [np.concatenate(self.parts)]
        return self.parts[0] if self.parts else self.compute([])


def groups(batches: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each has about ``most_bytes`` of text and GROUP_ROWS at most, or one row."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + most_bytes, "right")))
            to = min(to, at + GROUP_ROWS)
            yield batch.slice(at, to - at)
            at = to


def split_all(texts: list[str | None], lower: bool = False) -> tuple[list[bytes], np.ndarray]:
    """The words (what ASCII white space parts, in UTF-8) of all texts, and where each text's words begin; the last entry is their number.

    ``lower`` lower-cases A to Z only.
    """
    words, starts = [], np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        if t:
            raw = t.encode("utf-8", "surrogatepass")
            words += (raw.lower() if lower else raw).split()
        starts[i + 1] = len(words)
    return words, starts


def sums_by(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at ``starts`` (the last entry is the end); an empty run sums to 0."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]))
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        columns = np.ascontiguousarray(values.reshape(len(values), -1).T)
        out[full] = np.stack([np.add.reduceat(c, starts[full], dtype=np.float64) for c in columns], 1).reshape(len(full), *values.shape[1:])
    return out
