"""SentencePiece encoding by forward-filtering backward-sampling over the piece lattice, and lossless decoding.

A text, with a space put before it, is cut where a space follows what is no space; no piece of the vocabulary crosses such a cut. Each cut-out word has a lattice: an edge for every vocabulary piece in it, and for each
character that is no piece an edge of its UTF-8 byte pieces. A very long word falls into parts at the places that no edge crosses, so that a long text without spaces takes no more memory or time than another. The forward pass sums edge weights over all paths to a position; the backward pass draws an edge into the end, then into where that began, and so on,
each by its share of the sum. So a segmentation has the probability that its pieces' weights give it. The draws are hashes of the seed, the row key, the word's place in the text and the step: a row's sample
never depends on other rows. A literal U+2581, which stands for a space in pieces, is always spelt in bytes, so that decoding gives back the text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subledger.llm.words import WordTable, groups

#: Stands for a space in the vocabulary.
MARK = "▁"
#: Weight of a piece is its rank among pieces of text, plus RANK_SHIFT, to the power -SMOOTH: common pieces, which are merged early, weigh most. The larger SMOOTH, the fewer pieces a sample has.
SMOOTH, RANK_SHIFT = 0.6, 50.0
#: Longest piece in characters that the lattice looks for; a vocabulary with a longer one is refused.
LONGEST = 16
#: A word of more than LONG bytes is taken apart where no piece can cross, into parts of PART characters if the cuts allow it. What can't be cut and has over WHOLE characters is sampled by itself,
#: WINDOW characters at a time.
LONG, PART, WHOLE, WINDOW = 1024, 256, 2048, 1 << 16
#: First bits of a key by which a vocabulary's entries are found.
BUCKET_BITS = 18
#: Words, and bytes of them, whose lattices a task remembers; beyond that it forgets them all and begins anew.
MOST_WORDS, MOST_BYTES = 150_000, 3 << 20
#: Bytes of words that are sampled at once; bytes of ids that are decoded at once.
SLICE_BYTES, DECODE_BYTES = 1 << 20, 8 << 20
_WORD = re.compile(rb" *[^ ]+| +")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Vocabulary:
    """Pieces of a SentencePiece model by a hash of their characters, and every piece's bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(count)]
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.bytes = [b"" if model.is_control(i) or model.is_unknown(i) else bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        longest = max((len(n) for i, n in enumerate(names) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))), default=0)
        if longest > LONGEST:
            raise ValueError(f"a piece of {longest} characters is longer than LONGEST")
        plain = [i for i, n in enumerate(names) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and (MARK not in n.lstrip(MARK))]
        scores = np.array([model.get_score(i) for i in plain])
        rank = np.empty(len(plain))
        rank[np.argsort(-scores, kind="stable")] = np.arange(len(plain))
        weight = -SMOOTH * np.log(rank + RANK_SHIFT) - 1.0
        self.byte_weight = float(weight.min()) - 1.0
        keys = np.array([self.key(names[i]) for i in plain], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids, self.weights = keys[order], np.array(plain, np.int32)[order], weight[order].astype(np.float32)
        # Beginnings of pieces, whole ones among them, by their keys: the piece (-1: none), its weight, and whether a longer piece begins so. The last entry stands for what begins no piece.
        begins, goes_on, single = {}, set(), {}
        for place, i in enumerate(plain):
            h, text = 0, names[i].replace(MARK, " ")
            for k, c in enumerate(text):
                h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                begins.setdefault(h, -1)
                if k == 0:
                    single[ord(c)] = h
                if k + 1 < len(text):
                    goes_on.add(h)
            begins[h] = place
        hashes = mix(np.array(list(begins), np.uint64))
        order, place, end = np.argsort(hashes), np.array(list(begins.values())), len(begins)
        self.hashes = np.append(hashes[order], np.uint64(2**64 - 1))
        self.piece = np.append(np.where(place >= 0, np.array(plain, np.int32)[place], -1)[order], -1).astype(np.int32)
        self.piece_weight = np.append(np.where(place >= 0, weight[place], 0.0)[order], 0.0).astype(np.float32)
        self.goes_on = np.append(np.fromiter((h in goes_on for h in begins), bool, end)[order], False)
        # Where the entries with given first bits of the key start, and the entry of a single character.
        self.bucket = np.searchsorted(self.hashes[:-1] >> np.uint64(64 - BUCKET_BITS), np.arange(1 << BUCKET_BITS, dtype=np.uint64)).astype(np.int32)
        self.of_char = np.full(0x110000, end, np.int32)
        self.of_char[list(single)] = np.searchsorted(self.hashes, mix(np.array(list(single.values()), np.uint64)))
        lengths = np.array([len(b) for b in self.bytes])
        self.start, self.length, self.flat = np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(self.bytes), np.uint8)

    def entries(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, or one with another hash where none has it."""
        entry = self.bucket[hashes >> np.uint64(64 - BUCKET_BITS)]
        behind = np.flatnonzero(self.hashes[entry] < hashes)
        while len(behind):
            entry[behind] += 1
            behind = behind[self.hashes[entry[behind]] < hashes[behind]]
        return entry

    def hits(self, chars: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length in characters, from 1 on, the edges of that length: (first character, weight, piece). Character i's word has ``left[i]`` characters from there on.

        A character that is no piece has the edge of its bytes, whose piece is -1 less its code.
        """
        codes = chars.astype(np.uint64) + np.uint64(1)
        at, h, entry = np.arange(len(chars), dtype=np.int32), codes, self.of_char[chars]
        weight, piece = self.piece_weight[entry], self.piece[entry]
        bare = np.flatnonzero(piece < 0)
        own = chars[bare]
        weight[bare], piece[bare] = self.byte_weight * (1 + (own >= 0x80) + (own >= 0x800) + (own >= 0x10000)), -1 - own.astype(np.int32)
        yield at, weight, piece
        for k in range(1, LONGEST):
            more = np.flatnonzero(self.goes_on[entry] & (left[at] > k))
            if not len(more):
                return
            at = at[more]
            h = h[more] * _BASE + codes[at + k]
            own = mix(h)
            entry = self.entries(own)
            known = np.flatnonzero(self.hashes[entry] == own)
            at, h, entry = at[known], h[known], entry[known]
            whole = np.flatnonzero(self.piece[entry] >= 0)
            yield at[whole], self.piece_weight[entry[whole]], self.piece[entry[whole]]

    def edges(self, chars: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(weight, piece, longest): weight[k, i] and piece[k, i] are those of the edge of k + 1 characters that begins at character i, whose word has ``left[i]`` characters from there on.

        Where there is no edge, the weight is minus infinity; a character that is no piece has the edge of its bytes, -2.
        """
        weight, piece, longest = np.full((LONGEST, len(chars)), -np.inf, np.float32), np.full((LONGEST, len(chars)), -1, np.int32), 0
        for k, (at, weights, pieces) in enumerate(self.hits(chars, left)):
            weight[k, at], piece[k, at], longest = weights, np.where(pieces < 0, -2, pieces), k + 1
        return weight, piece, longest

    def parts(self, word: bytes) -> list[bytes]:
        """``word`` cut where no edge crosses, into parts of PART characters or as near to that as the cuts allow."""
        text = word.decode("utf-8")
        found, whole = [], 0
        for a in range(0, len(text), WINDOW):
            # Edges into the next window begin in this one's last characters; those that begin before it were seen with it.
            b = min(len(text), a + WINDOW)
            chars = np.frombuffer(text[max(0, a - LONGEST) : min(len(text), b + LONGEST)].encode("utf-32-le"), np.uint32)
            _, piece, longest = self.edges(chars, np.arange(len(chars), 0, -1))
            crossed = np.zeros(len(chars) + 1, bool)
            for k in range(1, longest):
                starts = np.flatnonzero(piece[k] >= 0)
                for j in range(1, k + 1):
                    crossed[starts + j] = True
            free = np.flatnonzero(~crossed) + max(0, a - LONGEST)
            found.append(free[(free > a) & (free <= b) & (free < len(text))])
        free = np.append(np.concatenate(found), len(text))
        # Of the cuts in each run of PART characters the first.
        ends = free[np.unique(free // PART, return_index=True)[1]]
        ends = ends if ends[-1] == len(text) else np.append(ends, len(text))
        out = []
        for end in ends:
            out.append(text[whole:end].encode("utf-8"))
            whole = end
        return out

    def long_sample(self, word: bytes, dice: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """(ids, characters) of a sample of one word that can't be cut, with its lattice in memory for WINDOW characters at a time; the id of a character that is no piece is -2."""
        chars = np.frombuffer(word.decode("utf-8").encode("utf-32-le"), np.uint32)
        n = len(chars)
        total = np.empty(n)

        def into(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
            """(weight, piece) of the edges that end at characters a to b: [k, i] is of the edge of k + 1 characters into a + i."""
            lo, hi = max(0, a - LONGEST + 1), min(n, b + LONGEST)
            weight, piece, _ = self.edges(chars[lo:hi], np.arange(hi - lo, 0, -1))
            ends = np.arange(a, b)
            w, p = np.full((LONGEST, b - a), -np.inf), np.full((LONGEST, b - a), -1, np.int32)
            for k in range(LONGEST):
                some = ends - k >= lo
                w[k, some], p[k, some] = weight[k, ends[some] - k - lo], piece[k, ends[some] - k - lo]
            return w, p

        # Forward, in plain numbers that are scaled down when they grow and up when they shrink; recent[k] is the sum k + 1 characters back.
        recent, offset = [1.0] + [0.0] * (LONGEST - 1), 0.0
        for a in range(0, n, WINDOW):
            b = min(n, a + WINDOW)
            w, _ = into(a, b)
            end, k = np.nonzero(w.T > -np.inf)
            edges, sums = iter(zip(end.tolist(), k.tolist(), np.exp(w[k, end]).tolist(), strict=True)), []
            edge = next(edges, None)
            for i in range(b - a):
                f = 0.0
                while edge is not None and edge[0] == i:
                    f += edge[2] * recent[edge[1]]
                    edge = next(edges, None)
                recent = [f, *recent[:-1]]
                if not 1e-100 < f < 1e100:
                    offset += math.log(f)
                    recent = [x / f for x in recent]
                    f = 1.0
                sums.append(math.log(f) + offset)
            total[a:b] = sums
        ids, codes, at, step, a, b = [], [], n - 1, 0, n, n
        while at >= 0:
            if step % WINDOW == 0:
                draws = ((mix(np.arange(step + 1, step + WINDOW + 1, dtype=np.uint64) * _BASE + dice) >> np.uint64(11)).astype(np.float64) * 2.0**-53).tolist()
            if at < a:
                a, b = max(0, at + 1 - WINDOW), at + 1
                w, p = into(a, b)
                before = np.concatenate([np.full(LONGEST, -np.inf), [0.0], total])[np.arange(a, b) - np.arange(1, LONGEST + 1)[:, None] + 1 + LONGEST]
                shares, p = np.cumsum(np.exp(w + before - total[a:b]), 0).T.tolist(), p.T.tolist()
            own = shares[at - a]
            draw = draws[step % WINDOW] * own[-1]
            edge = next(k for k, x in enumerate(own) if x > draw)
            ids.append(p[at - a][edge])
            codes.append(int(chars[at]))
            at -= edge + 1
            step += 1
        return np.array(ids[::-1], np.int64), np.array(codes[::-1], np.int64)

    @staticmethod
    def key(piece: str) -> int:
        h = 0
        for c in piece.replace(MARK, " "):
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return int(mix(np.array([h], np.uint64))[0])

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text of ids as ``encode`` makes them."""
        length = self.length[ids]
        within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        return self.flat[np.repeat(self.start[ids], length) + within].tobytes()[1:]


class Lattices(WordTable):
    """Lattice nodes of words, one for each place where a character ends. A node's edges lie side by side, short ones first: each has the cumulative share of the edges up to it, its piece, and the node that it comes from (-1: the word's beginning).

    A word's row is its last node.
    """

    def __init__(self, vocabulary: Vocabulary, most_words: int = MOST_WORDS, most_bytes: int = MOST_BYTES):
        self.vocabulary = vocabulary
        super().__init__(most_words, most_bytes)

    def _forget(self) -> None:
        super()._forget()
        self.nodes = self.edges = 0
        if not hasattr(self, "first"):
            self.first, self.shares, self.pieces, self.back = np.empty(0, np.int32), np.empty(0, np.float32), np.empty(0, np.int32), np.empty(0, np.int32)

    def _room(self, name: str, used: int, more: int) -> np.ndarray:
        """The part of the array ``name`` after the first ``used`` entries, for ``more`` entries."""
        old = getattr(self, name)
        if used + more > len(old):
            new = np.empty(max(len(old) * 5 // 4, used + more), old.dtype)
            new[:used] = old[:used]
            setattr(self, name, new)
        return getattr(self, name)[used : used + more]

    def compute(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.int64)
        raw = b"".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        length = np.add.reduceat((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, np.cumsum(size) - size, dtype=np.int64)
        chars = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        n, begin = len(chars), np.cumsum(length) - length
        place = np.arange(n) - np.repeat(begin, length)
        # Nodes are numbered by place, then by word, longest first: those of a place are one stretch.
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-length, kind="stable")] = np.arange(len(words))
        bounds = np.append(0, np.cumsum(np.bincount(place)))
        node = (bounds[place] + np.repeat(rank, length)).astype(np.int32)
        before = np.append(np.int32(-1), node[:-1])
        before[begin] = -1
        # Edges come by length, so each node's are counted up in the order in which they lie; at most one of a length ends in a node.
        degree, found = np.zeros(n, np.int32), []
        for k, (at, weight, piece) in enumerate(self.vocabulary.hits(chars, np.repeat(length, length) - place)):
            to = node[at + k]
            found.append((to, degree[to], before[at], weight, piece))
            degree[to] += 1
        first = np.append(0, np.cumsum(degree))
        m = int(first[-1])
        if self.edges + m >= 2**31:
            raise ValueError("a table of lattices holds at most 2^31 edges")
        self._room("first", self.nodes, n)[:] = first[:-1] + self.edges
        shares, pieces, back = (self._room(name, self.edges, m) for name in ("shares", "pieces", "back"))
        column, row = np.empty(m, np.int32), np.empty(m, np.int32)
        for to, nth, source, weight, piece in found:
            edge = first[to] + nth
            column[edge], row[edge], back[edge], shares[edge], pieces[edge] = to, nth, source, weight, piece
        # Forward: total[i] is the log of the summed weights of all paths to node i; the last entry, which -1 finds, is of the word's beginning.
        total = np.zeros(n + 1, np.float32)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            lo, hi = first[a], first[b]
            to, nth = column[lo:hi] - a, row[lo:hi]
            path = shares[lo:hi] + total[back[lo:hi]]
            top = np.maximum.reduceat(path, first[a:b] - lo)
            each = np.zeros((int(nth.max()) + 1, b - a), np.float32)
            each[nth, to] = np.exp(path - top[to])
            # Summed one after another whatever the number of words, so that rounding doesn't depend on other words.
            whole = np.cumsum(each, 0)[-1]
            total[a:b] = top + np.log(whole)
            # Rounding must not leave a draw above the last edge that has any share: it ends past any draw.
            last = len(each) - 1 - np.argmax((each > 0)[::-1], 0)
            share = np.cumsum(each / whole, 0)
            share[last, np.arange(b - a)] = 2.0
            shares[lo:hi] = share[nth, to]
        back[back >= 0] += self.nodes
        rows = self.nodes + bounds[length - 1] + rank
        self.nodes, self.edges = self.nodes + n, self.edges + m
        return rows


def words_of(texts: list[str | None], vocabulary: Vocabulary) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts, long ones in parts, and where each text's begin; the last entry is their number."""
    words, starts = [], np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        if t:
            own = _WORD.findall(b" " + t.encode("utf-8"))
            words += own if max(map(len, own)) <= LONG else [x for w in own for x in ([w] if len(w) <= LONG else vocabulary.parts(w))]
        starts[i + 1] = len(words)
    return words, starts


def _sample(words: list[bytes], dice: np.ndarray, table: Lattices) -> tuple[np.ndarray, np.ndarray]:
    """(ids, their number in each word): a sample of each word's lattice."""
    number, rows = table.look_up(words)
    first, shares, pieces, back = table.first, table.shares, table.pieces, table.back
    count, drawn = np.empty(len(words), np.int64), []
    alive, node, step = np.arange(len(words)), rows[number], 0
    while len(alive):
        draw = (mix(dice[alive] + np.uint64((step + 1) * int(_BASE) % 2**64)) >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
        # The first edge whose cumulative share is above the draw.
        edge = first[node]
        on = np.flatnonzero(shares[edge] <= draw)
        while len(on):
            edge[on] += 1
            on = on[shares[edge[on]] <= draw[on]]
        drawn.append((alive, pieces[edge]))
        node, step = back[edge], step + 1
        count[alive[node < 0]] = step
        alive, node = alive[node >= 0], node[node >= 0]
    # The pieces were drawn last to first.
    ends, ids = np.cumsum(count), np.empty(int(count.sum()), np.int32)
    for k, (who, piece) in enumerate(drawn):
        ids[ends[who] - 1 - k] = piece
    return _spelt(ids, -1 - ids, count, table.vocabulary)


def _spelt(ids: np.ndarray, code: np.ndarray, count: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids, and their number in each word, with the byte pieces of each character that is no piece: its id is negative, ``code`` has its code."""
    bare = np.flatnonzero(ids < 0)
    if len(bare):
        spelt = [chr(c).encode("utf-8") for c in code[bare].tolist()]
        times = np.ones(len(ids), np.int64)
        times[bare] = [len(x) for x in spelt]
        first = np.cumsum(times) - times
        into = np.repeat(first[bare], times[bare]) + np.arange(int(times[bare].sum())) - np.repeat(np.cumsum(times[bare]) - times[bare], times[bare])
        count = np.add.reduceat(times, np.cumsum(count) - count)
        ids = np.repeat(ids, times)
        ids[into] = vocabulary.byte_ids[np.frombuffer(b"".join(spelt), np.uint8)]
    return ids.astype(np.int32), count


def encode_all(texts: list[str | None], keys: np.ndarray, table: Lattices, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of all texts, where each text's begin)."""
    words, starts = words_of(texts, table.vocabulary)
    if not words:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    place = np.arange(len(words)) - np.repeat(starts[:-1], np.diff(starts))
    dice = mix(mix(np.repeat(keys.astype(np.int64).view(np.uint64), np.diff(starts)) + np.uint64(seed * int(_BASE) % 2**64)) + place.astype(np.uint64) * _BASE)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    # Slices of about SLICE_BYTES; a word that is too long for a lattice in memory is one of its own.
    alone = lengths > 4 * WHOLE
    number = np.cumsum(lengths) // SLICE_BYTES + np.cumsum(alone) + np.cumsum(np.append(False, alone[:-1]))
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1), len(words)]
    found = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if alone[a]:
            ids, code = table.vocabulary.long_sample(words[a], dice[a])
            found.append(_spelt(ids, code, np.array([len(ids)]), table.vocabulary))
        else:
            found.append(_sample(words[a:b], dice[a:b], table))
    return np.concatenate([x for x, _ in found]), np.append(0, np.cumsum(np.concatenate([x for _, x in found])))[starts]


_vocabularies: dict[str, Vocabulary] = {}


def _vocabulary_of(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _encode(batches: Iterator[pa.RecordBatch], path: str, seed: int) -> Iterator[pa.RecordBatch]:
    table = Lattices(_vocabulary_of(path))
    for batch in groups(batches):
        keys = batch.column("row").fill_null(0).to_numpy()
        ids, begin = encode_all(batch.column("text").to_pylist(), keys, table, seed)
        data = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((begin * 4).astype(np.int32)), pa.py_buffer(ids.astype("<i4"))])
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.diff(begin)), data], ["row", "n_pieces", "ids"])


def encode(docs: DataFrame, model_path: str, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids) for each row of ``docs``; ids are little-endian 32-bit numbers.

    A null or empty text has no pieces. The sample depends on the text, the seed and the row's id alone (a null id counts as 0), so rows that repeat both get the same. No rows give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: _encode(batches, model_path, seed), "row long, n_pieces long, ids binary").withColumnRenamed("row", "doc_id")


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    vocabulary = _vocabulary_of(path)
    for batch in groups(batches, "ids", DECODE_BYTES):
        texts = [vocabulary.decode(np.frombuffer(x, "<i4")) for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.drop_columns(["ids"]).columns, pa.array(texts, pa.binary()).cast(pa.string())], [*batch.drop_columns(["ids"]).schema.names, "text"])


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` with the column ``text`` in place of ``ids``; no ids decode to the empty text."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name not in ("ids", "text"))
    return encoded.select(*(c for c in encoded.columns if c not in ("ids", "text")), "ids").mapInArrow(lambda batches: _decode(batches, model_path), f"{fields}, text string")
