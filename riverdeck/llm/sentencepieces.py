"""SentencePiece encoding and decoding with a suffix array.

A batch's distinct segments (a run of blanks with the word that follows, or a line feed: no piece reaches across
their ends) are joined into one text.  Its suffixes are sorted as far as the longest piece is long; every piece of the vocabulary
is searched for in the suffix array by bisection, and its range gives the places where it stands.  These edges (place, length, piece) are sorted
by place and relaxed: for a unigram model by the best path, for a BPE model by merging, again and again, the
best-scored edge that spans two neighbouring pieces.  Characters in no edge fall back to byte pieces.

The vocabulary file is a parameter; it is read on the driver, its kind (unigram or BPE) and its blank before the text with it, and its table is broadcast (a fixed size).
Models that change the text otherwise (by rules of normalisation, or by taking blanks away) are refused.

Memory: a task keeps encoded segments up to ``keep`` bytes and indexes ``CHUNK`` bytes at once; a single longer segment takes some 200 bytes for each of its characters.

Defined cases: a null or empty text has no pieces; repeated rows are encoded alike; texts of any length are encoded whole
(segments over ``LONG`` characters are relaxed one by one with a heap); a run of characters in no piece is one unknown piece if the model has no byte pieces; an empty table gives an empty result; extra columns are carried
and never read, but for those named like a result, which are replaced.  Decoding gives the text back, with U+2581 turned to a blank as the model does.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import Numbering, add_columns, texts

#: The model's sign for a blank.
BLANK = "▁".encode()
#: Bytes of distinct segments indexed together.
CHUNK = 1 << 18
LONG = 256
_FAR = np.int64(1) << np.int64(62)


@dataclass(frozen=True)
class Pieces:
    """pieces: the bytes each id decodes to (a blank for U+2581).  usable: ids that may be matched in a text.  bytes_: the 256 byte pieces' ids, or the unknown id.
    unigram: best path, else BPE merges.  prefix: a blank is put before the text.  fallback: there are byte pieces.
    """

    pieces: list[bytes] = field(repr=False)
    scores: np.ndarray = field(repr=False)
    usable: np.ndarray = field(repr=False)
    bytes_: np.ndarray = field(repr=False)
    unigram: bool = False
    prefix: bool = True
    fallback: bool = True


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message: whole numbers and bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        size = {1: 8, 5: 4}.get(tag & 7)
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        if size is None:
            size = varint()
        yield tag >> 3, data[at : at + size]
        at += size


def _settings(path: str) -> tuple[bool, bool]:
    """Whether the model is a unigram one, and whether a blank goes before the text."""
    with open(path, "rb") as f:
        model = list(_fields(f.read()))
    trainer = dict(_fields(b"".join(v for k, v in model if k == 2)))
    normalizer = dict(_fields(b"".join(v for k, v in model if k == 3)))
    kind = trainer.get(3, 1)  # 1: unigram, 2: BPE, 3: words, 4: characters
    if kind not in (1, 2):
        raise ValueError(f"{path}: only unigram and BPE models are encoded")
    if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24):
        raise ValueError(f"{path}: the model normalises texts, takes blanks away or puts them behind words")
    return kind == 1, bool(normalizer.get(3, 1))


def load(path: str) -> Pieces:
    """The table of a model file."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    names = [p.id_to_piece(i) for i in range(n)]
    special = np.array([p.is_control(i) or p.is_unknown(i) or p.is_unused(i) or p.is_byte(i) for i in range(n)])
    bytes_ = np.full(256, p.unk_id(), np.int32)
    out = []
    for i, name in enumerate(names):
        if p.is_byte(i):
            bytes_[int(name[3:5], 16)] = i
            out.append(bytes([int(name[3:5], 16)]))
        else:
            out.append(b"" if special[i] else name.replace("▁", " ").encode())
    unigram, prefix = _settings(path)
    return Pieces(out, np.array([p.get_score(i) for i in range(n)]), np.flatnonzero(~special), bytes_, unigram, prefix, any(map(p.is_byte, range(n))))


class SuffixArray:
    """Suffixes of ``text`` in order, as far as ``depth`` bytes, with the 8-byte keys to search them by."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for k in range(8):
            key = (key << np.uint64(8)) | padded[k : k + n]
        self.key = np.concatenate([key, np.zeros(depth + 8, np.uint64)])
        self.array = np.argsort(key, kind="stable")
        span = 8
        rank = self._ranks(key)
        while span < depth:  # prefix doubling
            after = np.zeros(n, np.int64)
            after[: max(0, n - span)] = rank[span:] + 1
            joint = rank * np.int64(n + 2) + after
            self.array = np.argsort(joint, kind="stable")
            rank = self._ranks(joint)
            span *= 2

    def _ranks(self, key):
        ordered = key[self.array]
        steps = np.zeros(len(key), np.int64)
        steps[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(len(key), np.int64)
        rank[self.array] = np.cumsum(steps)
        return rank

    def ranges(self, low: np.ndarray, high: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bisection for many patterns at once; low and high: their 8-byte words (rows), the last one filled up with 0 and with 255."""
        lo, hi = np.zeros(len(sizes), np.int64), np.full(len(sizes), len(self.array), np.int64)
        for word in range(low.shape[1]):
            on = np.flatnonzero((sizes > 8 * word) & (lo < hi))
            if not len(on):
                break
            a = self._bisect(lo[on], hi[on], low[on, word], 8 * word, strict=False)
            b = self._bisect(a, hi[on], high[on, word], 8 * word, strict=True)
            lo[on], hi[on] = a, b
        return lo, hi

    def _bisect(self, lo, hi, key, shift, strict):
        lo, hi = lo.copy(), hi.copy()
        on = np.flatnonzero(lo < hi)
        while len(on):
            mid = (lo[on] + hi[on]) >> 1
            have = self.key[self.array[mid] + shift]
            up = have <= key[on] if strict else have < key[on]
            lo[on] = np.where(up, mid + 1, lo[on])
            hi[on] = np.where(up, hi[on], mid)
            on = on[lo[on] < hi[on]]
        return lo


class Encoder:
    """Encodes texts of one task; segments once encoded are kept until they take about ``keep`` bytes."""

    def __init__(self, table: Pieces, keep: int = 96 << 20):
        self.table, self.keep = table, keep
        used = [table.pieces[i] for i in table.usable]
        self.sizes = np.array([len(x) for x in used])
        self.depth = int(self.sizes.max())
        width = -(-self.depth // 8)
        low = np.frombuffer(b"".join(x.ljust(8 * width, b"\0") for x in used), ">u8").reshape(-1, width)
        high = np.frombuffer(b"".join(x.ljust(8 * width, b"\xff") for x in used), ">u8").reshape(-1, width)
        self.low, self.high = low.astype(np.uint64), high.astype(np.uint64)
        self.chars = np.array([len(x.decode()) for x in used])
        self.max_chars = int(self.chars.max())
        scores = table.scores[table.usable]
        self.order = np.unique(-scores, return_inverse=True)[1]  # 0: the best score
        rank = np.full(len(table.pieces), -1, np.int64)
        rank[table.usable] = self.order
        self.rank = rank
        # A line feed is a segment of its own if no longer piece has one; blanks stand only before a word.
        longer = [x for x in used if len(x) > 1]
        self.cut = re.compile(rb"\n| *[^ \n]+| +" if not any(b"\n" in x for x in longer) else rb" *[^ ]+| +")
        if any(b" " in x.lstrip(b" ") for x in used):
            self.cut = re.compile(rb".+", re.DOTALL)  # pieces reach across words: whole texts
        self._clear()

    def _clear(self):
        self.seen = Numbering()
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.held = 0

    def __call__(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than there are texts) and piece ids."""
        if self.held > self.keep:
            self._clear()
        prefix = b" " if self.table.prefix else b""
        parts = [self.cut.findall(prefix + x.replace(BLANK, b" ")) if x else [] for x in docs]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        ids = np.fromiter((i for p in parts for i in map(self.seen.__getitem__, p)), np.int64, int(counts.sum()))
        if len(self.seen) > len(self.first):
            self._learn(list(self.seen)[len(self.first) :])
        n = self.count[ids]
        ends = np.cumsum(n)
        out = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[ids] - (ends - n), n)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        if not self.table.fallback:  # a run of unknown characters is one piece
            unknown = out == self.table.bytes_[0]
            again = np.append(False, unknown[1:] & unknown[:-1])[: len(out)]
            again[bounds[:-1][bounds[:-1] < len(out)]] = False
            bounds = np.concatenate([[0], np.cumsum(~again)])[bounds]
            out = out[~again]
        return bounds, out

    def _learn(self, new: list[bytes]):
        firsts, counts, flats, size = [self.first], [self.count], [self.flat], len(self.flat)
        sizes = np.fromiter(map(len, new), np.int64, len(new)) + 1
        ends = np.cumsum(sizes)
        self.held += int(sizes.sum()) + 160 * len(new)  # the text, and what a key and its entries take besides
        at = 0
        while at < len(new):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
            n, flat = self._encode(new[at:to])
            counts.append(n)
            firsts.append(size + np.cumsum(n) - n)
            flats.append(flat)
            size += len(flat)
            at = to
        self.first, self.count, self.flat = map(np.concatenate, (firsts, counts, flats))

    def _encode(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        text = np.frombuffer(b"\0".join([*segments, b""]), np.uint8)
        lead = np.flatnonzero((text & 0xC0) != 0x80)  # characters, the separators included
        char_at = np.full(len(text) + 1, -1, np.int64)
        char_at[lead] = np.arange(len(lead))
        suffixes = SuffixArray(text, self.depth)
        lo, hi = suffixes.ranges(self.low, self.high, self.sizes)
        found = np.flatnonzero(hi > lo)
        n = hi[found] - lo[found]
        which = np.repeat(found, n)
        ends = np.cumsum(n)
        place = suffixes.array[np.arange(len(which)) + np.repeat(lo[found] - (ends - n), n)]
        # One key holds place, length in characters and piece, so that a plain sort puts the edges in order of place.
        low = len(self.table.usable).bit_length()
        high = low + self.max_chars.bit_length()
        edges = np.sort((char_at[place] << np.int64(high)) | (self.chars[which] << np.int64(low)) | which)
        spot, length, piece = edges >> high, (edges >> low) & ((1 << (high - low)) - 1), edges & ((1 << low) - 1)
        grid = np.full((len(lead), self.max_chars + 1), -1, np.int32)
        grid[spot, length] = piece
        sizes = np.fromiter(map(len, segments), np.int64, len(segments)) + 1
        starts = char_at[np.cumsum(sizes) - sizes]
        chars = np.append(starts[1:], len(lead)) - starts - 1
        relax = self._best_path if self.table.unigram else self._merge
        alive, token = relax(grid, starts, chars, lead, text)
        # Tokens in order; characters in no piece become bytes.
        at = np.flatnonzero(alive)
        ids = token[at]
        known = ids >= 0
        width = np.append(lead[1:], len(text))[at] - lead[at]
        if not self.table.fallback:
            width[:] = 1
        n = np.where(known, 1, width)
        ends = np.cumsum(n)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        out[(ends - n)[known]] = self.table.usable[ids[known]]
        for k in range(4):
            more = np.flatnonzero(~known & (width > k))
            out[(ends - n)[more] + k] = self.table.bytes_[text[lead[at[more]] + k]]
        bounds = np.concatenate([[0], ends])
        first = np.searchsorted(at, starts)
        last = np.searchsorted(at, starts + chars)
        return bounds[last] - bounds[first], out

    def _merge(self, grid, starts, chars, lead, text):
        """BPE: in every segment at once, the best-scored edge over two neighbouring pieces is merged, until none is left."""
        n = len(grid)
        alive = np.ones(n, bool)
        alive[starts + chars] = False  # separators
        after = np.arange(1, n + 1)  # where the token that starts here ends
        before = np.arange(-1, n - 1)
        token = grid[:, 1].copy()
        stop = np.repeat(starts + chars, chars + 1)
        own = np.repeat(starts, chars + 1)
        spot = np.arange(n) - own
        cost = np.full(n, _FAR)

        def price(p):
            """The key of merging the tokens at p and after it: score first, then place."""
            q = after[p]
            p = p[q < stop[p]]
            q = after[p]
            length = after[q] - p
            fits = length <= self.max_chars
            p, length = p[fits], length[fits]
            piece = grid[p, length]
            good = piece >= 0
            p, piece = p[good], piece[good]
            cost[p] = (self.order[piece] << np.int64(32)) | spot[p]

        price(np.flatnonzero(alive))
        for s in np.flatnonzero(chars > LONG):
            self._merge_long(grid, starts[s], chars[s], alive, token)
            cost[starts[s] : starts[s] + chars[s]] = _FAR
        on = np.flatnonzero((chars > 1) & (chars <= LONG))
        cols = cuts = None
        while len(on):
            if cols is None or 2 * len(on) < len(cuts):
                n_on = chars[on]
                cuts = np.cumsum(n_on) - n_on
                cols = np.arange(int(n_on.sum())) + np.repeat(starts[on] - cuts, n_on)
                held = on
            best = np.minimum.reduceat(cost[cols], cuts)
            go = best < _FAR
            p = starts[held[go]] + (best[go] & np.int64(0xFFFFFFFF))
            q = after[p]
            token[p] = grid[p, after[q] - p]
            alive[q] = False
            cost[q] = _FAR
            after[p] = after[q]
            inside = after[p] < stop[p]
            before[after[p][inside]] = p[inside]
            cost[p] = _FAR
            left = before[p]
            has = left >= own[p]
            cost[left[has]] = _FAR
            price(p)
            price(left[has])
            on = held[go]
        return alive, token

    def _merge_long(self, grid, start, chars, alive, token):
        """The same for one long segment, with a heap."""
        stop = start + chars
        after, before = {}, {}
        for i in range(start, stop):
            after[i], before[i] = i + 1, i - 1
        heap: list[tuple[int, int, int]] = []

        def offer(p):
            if p >= start and after[p] < stop:
                end = after[after[p]]
                if end - p <= self.max_chars and (piece := grid[p, end - p]) >= 0:
                    heapq.heappush(heap, (int(self.order[piece]), p, end))

        for i in range(start, stop):
            offer(i)
        while heap:
            _, p, end = heapq.heappop(heap)
            if not alive[p] or after[p] >= stop or after.get(after[p]) != end or not alive[after[p]]:
                continue
            q = after[p]
            alive[q] = False
            after[p] = end
            if end < stop:
                before[end] = p
            token[p] = grid[p, end - p]
            offer(p)
            offer(before[p])

    def _best_path(self, grid, starts, chars, lead, text):
        """Unigram: the path of the highest sum of scores; a character in no piece costs 10 more than the worst piece."""
        scores = self.table.scores[self.table.usable]
        unknown = float(scores.min()) - 10
        n = len(grid)
        alive, token = np.zeros(n, bool), np.full(n, -1, np.int64)
        for s, size in zip(starts.tolist(), chars.tolist()):
            best = [0.0] + [-np.inf] * size
            back = [(0, -1)] * (size + 1)
            for i in range(size):
                row = grid[s + i, 1 : min(self.max_chars, size - i) + 1]
                options = [(int(k) + 1, int(row[k]), float(scores[row[k]])) for k in np.flatnonzero(row >= 0)]
                if row[0] < 0:
                    options.append((1, -1, unknown))
                for k, piece, value in options:
                    if best[i] + value > best[i + k]:
                        best[i + k], back[i + k] = best[i] + value, (i, piece)
            i = size
            while i > 0:
                j, piece = back[i]
                alive[s + j], token[s + j] = True, piece
                i = j
        return alive, token


def decode(table: Pieces, ids: list[int]) -> bytes:
    out = b"".join(map(table.pieces.__getitem__, ids))
    return out[1:] if table.prefix and out[:1] == b" " else out


def encode(docs: DataFrame, table: Pieces, text: str = "text", keep: int = 96 << 20) -> DataFrame:
    """``docs`` with n_pieces, ids, and round_trip: whether decoding the ids gives the text back.  A task keeps encoded segments up to ``keep`` bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    fields = [T.StructField("n_pieces", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]

    def make():
        encoder = Encoder(shared.value, keep)

        def work(batch):
            raw = texts(batch, text)
            bounds, ids = encoder(raw)
            whole = ids.tolist()
            same = [decode(encoder.table, whole[a:b]) == x.replace(BLANK, b" ") for a, b, x in zip(bounds[:-1].tolist(), bounds[1:].tolist(), raw)]
            made = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            return [np.diff(bounds), made, same]

        return work

    return add_columns(docs, make, fields, text)


def decode_column(df: DataFrame, table: Pieces, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with the text that a column of piece ids stands for."""
    shared = df.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            made = pa.array([None if x is None else decode(shared.value, x).decode("utf-8", "replace") for x in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, to])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(to, T.StringType())]))
