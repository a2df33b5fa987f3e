"""Token-id files: an adaptive context-mixing range coder over independent, checksummed blocks.

File format. A store is a table of segments, written by Spark's Parquet writer (so that a lost
executor's tasks are simply run again): ``part`` and ``seg`` give the order, ``docs``, ``known``
(a bit each: whether the id isn't null) and ``lens`` the documents (little-endian int64, bits,
uint32) with their crc32 in ``meta_crc``, ``tokens`` the ids in all, ``blocks`` the coded ids, in
blocks of BLOCK ids and a shorter last one. A block is ``TKB4``, then as uint32: ids, steps, lanes,
symbols, bytes of the symbol table, crc32 of the ids as little-endian uint32; then the symbol table
(the ids in ascending order as differences, by zlib; absent where symbols are the ids themselves);
then each lane's number of 16-bit words (uint16), and the words.

Method. A block is cut into lanes, which are coded in lockstep, one array element each, so numpy
does a step of all lanes at once; the lanes share one model, which begins empty in each block. It
holds counts of ids (order 0), of ids after an id (order 1) and of ids after a pair of ids (order 2,
which predicts the commonest, for pairs seen twice or more). An id's probability is the mixture of the three,

    F2 = (32 - a2) F1 + a2 Q2,   F1 = (32 - a1) F0 + a1 Q1,

with F0, Q1, Q2 the orders' own distributions in whole numbers, and the weights a1, a2 out of 32
those of the context's class (how often it was seen, and how sure its successor is). The mixture
drives a range coder of 48 bits. Counts are taken over, and weights adapted by expectation-
maximisation, whenever the ids coded have doubled (from EARLY ids on, grown to GROWTH times as many):
in between nothing changes, so the encoder works out many steps at once and the decoder finds an id
by a table of places for each context.

Defined results: a null or empty text is its end id alone; rows that repeat a doc_id are stored as
often, in order of their text; null ids come first and stay null; an empty table gives an empty
store; other columns are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import runtime
from tidemark.llm.bpe import coder

MAGIC = b"TKB4"
#: Ids of a block, lanes of a block, and ids of a lane at least.
BLOCK = 1 << 22
LANES = 8192
LEAST = 256
#: Ids of a segment: it ends with the slice of texts that reaches them, so most segments are one block.
SEGMENT = BLOCK - (1 << 19)
#: Ids up to which counts are taken over whenever they have doubled, and the growth from take-over to take-over beyond.
EARLY = 1 << 17
GROWTH = 6
#: Steps that the encoder works out at a time.
STEPS = 64
#: Ids that the encoder looks up at a time, and of a stretch from which on every fourth tells the weights.
PIECE = 1 << 14
MANY = 1 << 16
#: Parts of a weight.
PARTS = 32
#: Symbols up to which ids are their own symbols.
DIRECT = 1 << 17
FIRST = np.uint64(1 << 32)
U = np.uint64
W16, W32, LOW32 = np.uint64(16), np.uint64(32), np.uint64(0xFFFFFFFF)


def _length(n: np.ndarray) -> np.ndarray:
    """Bits of whole numbers."""
    return np.frexp(n.astype(np.float64))[1].astype(np.int64)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, counts) of sorted keys."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


class Lookup:
    """Places of distinct keys by tables of one key a slot: those that lose their slot in the first are in a second, and few in none."""

    def __init__(self, keys: np.ndarray) -> None:
        self.n = len(keys)
        self.keys = np.append(keys, ~keys.dtype.type(0))  # no key has all bits set
        self.bits = U(64 - max(4, int(2 * len(keys)).bit_length()))
        self.slots = []
        at = np.arange(len(keys), dtype=np.int32)
        for turn in range(2):
            slot = np.full(1 << (64 - int(self.bits)), len(keys), np.int32)
            place = self._hash(keys[at], turn)
            slot[place] = at
            self.slots.append(slot)
            at = at[slot[place] != at]

    def _hash(self, keys: np.ndarray, turn: int) -> np.ndarray:
        h = keys.astype(np.uint64)
        h *= U((0x9E3779B97F4A7C15, 0xD1342543DE82EF95)[turn])
        h >>= self.bits
        return h.view(np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or n where none is found."""
        at = self.slots[0].take(self._hash(keys, 0))
        rest = np.flatnonzero(self.keys.take(at) != keys)
        if len(rest):
            own = keys.take(rest)
            more = self.slots[1].take(self._hash(own, 1))
            more[self.keys.take(more) != own] = self.n
            at[rest] = more
        return at


def _rows(*columns: np.ndarray) -> np.ndarray:
    """Four columns of whole numbers below 2**32 as items of 16 bytes, so that one look-up takes them all."""
    return np.ascontiguousarray(np.stack(columns, 1).astype(np.uint32)).view(np.complex128).ravel()


def _columns(rows: np.ndarray, first: int = 0, stop: int = 4) -> np.ndarray:
    """The four columns, or those from first to stop, as whole numbers."""
    return rows.view(np.uint32).reshape(-1, 4)[:, first:stop].T.astype(np.int64, order="C")


class Model:
    """Counts of a block so far, and the distributions made of them at the last take-over."""

    def __init__(self, symbols: int, decodes: bool) -> None:
        self.v, self.decodes = symbols, decodes
        self.t0 = max(17, int(symbols - 1).bit_length() + 1)
        self.t1, self.t2 = self.t0 + 5, self.t0 + 10
        self.narrow = np.uint32 if (symbols + 1) * symbols < 1 << 32 else np.int64
        self.counts = np.zeros(symbols, np.int64)
        self.total = 0
        self.seen1, self.seen2 = np.zeros(0, self.narrow), np.zeros(0, np.int64)
        self.weight1 = np.full(80, 20.0)
        self.weight2 = np.full(96, 4.0)
        self.take_over()

    def note(self, x: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        """Counts ids and what stood before them; a symbol of v stands for the start of a lane."""
        self.counts += np.bincount(x, minlength=self.v)
        self.total += len(x)
        self.seen1 = np.sort(np.concatenate([self.seen1, (one * self.v + x).astype(self.narrow)]))
        self.seen2 = np.sort(np.concatenate([self.seen2, (one * (self.v + 1) + two) * self.v + x]))

    def take_over(self) -> None:
        self._order0()
        self._order1()
        self._order2()

    def _order0(self) -> None:
        """Unseen ids share what the ids seen once leave to them; no id has less than 1."""
        seen = self.counts > 0
        kinds = int(seen.sum())
        rest = self.v - kinds
        new = (float((self.counts == 1).sum()) + 1) / (self.total + 2) if rest else 0.0
        share = np.where(seen, self.counts * ((1 - new) / max(1, self.total)), new / max(1, rest))
        self.freq0 = 1 + (share * ((1 << self.t0) - self.v)).astype(np.int64)
        self.cum0 = np.concatenate([[0], np.cumsum(self.freq0)])
        self.inverse0 = np.repeat(np.arange(self.v, dtype=np.int32), self.freq0)

    def _order1(self) -> None:
        """Entries in order of context and id. Row of an entry: low, width, order 1's mass up to and with it, id. Row of a
        context: first entry, weight, first place and shift of its table of places."""
        keys, n = _runs(self.seen1)
        wide = keys.astype(np.int64)
        context = wide // self.v
        y = wide - context * self.v
        kinds = np.bincount(context, minlength=self.v + 1)
        start = np.cumsum(kinds) - kinds
        upto = np.concatenate([[0], np.cumsum(n)])
        size = upto[start + kinds] - upto[start]
        self.class1 = np.minimum(_length(size), 19) * 4 + np.minimum(3, kinds * 4 // np.maximum(size, 1))
        weight = np.where(size > 0, np.rint(self.weight1).astype(np.int64)[self.class1], 0)
        base, own, a = upto[start].take(context), np.maximum(size, 1).take(context), weight.take(context)
        scale = np.ldexp(1.0, self.t0) / own
        share = lambda c: np.minimum((c * scale).astype(np.int64), 1 << self.t0)
        low, high = share(upto[:-1] - base), share(upto[1:] - base)
        self.q1 = np.append(high - low, 0)
        floor = (PARTS - a) * self.cum0.take(y) + a * low
        self.entry1 = _rows(*(np.append(c, 0) for c in (floor, (PARTS - a) * self.freq0.take(y) + a * (high - low), a * high, y)))
        self.below1 = np.append(a * high, 0)
        self.keys1, self.find1 = keys, Lookup(keys)
        bits = np.where(kinds > 0, _length(np.maximum(kinds, 1)), 0)
        places = 1 << bits
        first = np.cumsum(places) - places
        self.context1 = _rows(start, weight, first, self.t1 - bits)
        if self.decodes:
            # Where the search for a goal in each of a context's equal parts begins: its last entry that begins at or below the part.
            of = np.repeat(np.arange(self.v + 1), places)
            part = (np.arange(len(of)) - first[of]) << (self.t1 - bits[of])
            self.goal1 = np.append((context << self.t1) + floor, np.int64(1) << 62)
            self.guide1 = (np.searchsorted(self.goal1[:-1], (of << self.t1) + part, "right") - 1).astype(np.int32)

    def _order2(self) -> None:
        """Row of a pair seen twice or more: low and high end of its commonest successor (the smallest of equals), its id, and the weight."""
        keys, n = _runs(self.seen2)
        pairs, kinds = _runs(keys // self.v)
        first = np.cumsum(kinds) - kinds
        size = np.add.reduceat(n, first) if len(pairs) else n
        best = np.maximum.reduceat((n << 32) - np.arange(len(n)), first) if len(pairs) else n
        often = np.flatnonzero(size > 1)
        self.keys2, size, best = pairs[often], size[often], best[often]
        held = -(-best >> 32)
        at = (held << 32) - best
        one = self.keys2 // (self.v + 1)
        y = keys[at] - self.keys2 * self.v
        self.entry2 = np.append(np.searchsorted(self.keys1, (one * self.v + y).astype(self.narrow)), len(self.keys1))
        self.class2 = np.append(np.minimum(_length(size), 15) * 6 + np.minimum(5, held * 6 // np.maximum(size, 1)), 0)
        a = np.rint(self.weight2).astype(np.int64)[self.class2]
        a[-1] = 0
        low, wide = _columns(self.entry1.take(self.entry2), 0, 2)
        low *= PARTS - a
        # Without a candidate the interval is out of reach, and no id is the candidate.
        low[-1] = (1 << 32) - 1
        self.pair2 = _rows(low, np.minimum(low + (PARTS - a) * wide + (a << self.t1), (1 << 32) - 1), np.append(y, (1 << 32) - 1), a)
        self.find2 = Lookup(self.keys2)

    def _pairs(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The place of each pair among those seen, or one past the end."""
        return self.find2.places(one * (self.v + 1) + two)

    def intervals(self, x: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
        """(low, width) of each id in the mixture of 2**t2, its entry, the pair before it and whether order 2 named it."""
        if len(x) > PIECE:
            parts = [self.intervals(x[i : i + PIECE], one[i : i + PIECE], two[i : i + PIECE]) for i in range(0, len(x), PIECE)]
            return tuple(np.concatenate(c) for c in zip(*parts, strict=True))
        key = (one * self.v + x).astype(self.narrow)
        entry = self.find1.places(key)
        gone = np.flatnonzero(entry == len(self.keys1))
        if len(gone):
            k = np.searchsorted(self.keys1, key[gone])
            there = k < len(self.keys1)
            there[there] = self.keys1[k[there]] == key[gone[there]]
            entry[gone[there]] = k[there]
            gone, k = gone[~there], k[~there]
        low, wide = _columns(self.entry1.take(entry), 0, 2)
        if len(gone):
            own = x[gone]
            start, a = _columns(self.context1.take(one[gone]), 0, 2)
            low[gone] = (PARTS - a) * self.cum0.take(own) + np.where(k > start, self.below1.take(k - 1), 0)
            wide[gone] = (PARTS - a) * self.freq0.take(own)
        pair = self._pairs(one, two)
        y, a = _columns(self.pair2.take(pair), 2, 4)
        named = y == x
        own = a << self.t1
        rest = PARTS - a
        low *= rest
        low += own * (y < x)
        wide *= rest
        wide += own * named
        return low, wide, entry, pair, named

    def symbols(self, goal: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
        """(id, low, width, entry, pair, named) of the ids whose intervals hold the goals."""
        pair = self._pairs(one, two)
        low2, high2, y2, a2 = _columns(self.pair2.take(pair))
        above = high2 <= goal
        below = (a2 << self.t1) * above
        rest = PARTS - a2
        named = (low2 <= goal) & ~above
        f = ((goal - below) / rest).astype(np.int64)  # both are small, so the quotient is exact enough
        f[named] = 0
        start, a, table, shift = _columns(self.context1.take(one))
        entry = self.guide1.take(table + (f >> shift)).astype(np.int64)
        goal1 = (one << self.t1) + f
        on = np.flatnonzero(self.goal1.take(entry + 1) <= goal1)
        while len(on):
            k = entry[on] + 1
            entry[on] = k
            on = on[self.goal1.take(k + 1) <= goal1[on]]
        before = entry < start
        entry[before] = len(self.keys1)
        low, wide, under, x = _columns(self.entry1.take(entry))
        out = np.flatnonzero((f >= low + wide) & ~named)
        if len(out):
            left, sum1 = PARTS - a[out], under[out]
            free = self.inverse0.take((f[out] - sum1) // left, mode="clip")  # damaged data may ask for any place
            x[out], low[out], wide[out] = free, left * self.cum0.take(free) + sum1, left * self.freq0.take(free)
            entry[out] = len(self.keys1)
        low, wide = low * rest + below, wide * rest
        on = np.flatnonzero(named)
        if len(on):
            x[on], low[on], wide[on], entry[on] = y2[on], low2[on], high2[on] - low2[on], self.entry2.take(pair[on])
        return x, low, wide, entry, pair, named

    def adapt(self, x: np.ndarray, one: np.ndarray, entry: np.ndarray, pair: np.ndarray, named: np.ndarray) -> None:
        """Moves the weights to what would have suited the ids of the last stretch."""
        if len(x) >= 4 * MANY:
            x, one, entry, pair, named = (c[::4] for c in (x, one, entry, pair, named))
        p0, p1 = self.freq0.take(x).astype(np.float64), self.q1.take(entry).astype(np.float64)
        kind = self.class1.take(one)
        a = np.rint(self.weight1).take(kind)
        self.weight1 = _suited(self.weight1, kind, p0, p1, kind >= 4)
        p01 = np.where(kind >= 4, (PARTS - a) * p0 + a * p1, PARTS * p0)
        self.weight2 = _suited(self.weight2, self.class2.take(pair), p01, np.ldexp(named.astype(np.float64), self.t1), pair < len(self.keys2))


def _suited(weight: np.ndarray, kind: np.ndarray, other: np.ndarray, own: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Expectation-maximisation for the mixture of ``own`` (of so much weight out of PARTS) and ``other``, by class: more rounds over few ids."""
    if not on.all():
        kind, other, own = kind[on], other[on], own[on]
    few = len(kind) < MANY
    n = np.bincount(kind, minlength=len(weight))
    for _ in range(4 if few else 1):
        w = weight.take(kind)
        part = w * own
        sure = np.bincount(kind, part / (part + (PARTS - w) * other), len(weight))
        weight = np.clip((PARTS * sure + 8 * weight) / (n + 8), 1, PARTS - 1)
    return weight


def _shape(n: int) -> tuple[int, int]:
    """(ids of a lane, lanes) for n ids."""
    steps = max(LEAST, -(-n // LANES))
    return steps, -(-n // steps)


def _stretches(steps: int, lanes: int) -> Iterator[tuple[int, int]]:
    """Steps between take-overs."""
    a, b = 0, 1
    while a < steps:
        yield a, min(b, steps)
        a, b = b, b * (2 if b * lanes < EARLY else GROWTH)


def _before(grid: np.ndarray, a: int, b: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids one and two steps before steps a to b, as (steps, lanes)."""
    lanes = grid.shape[1]
    pad = np.vstack([np.full((2, lanes), start, np.int64), grid[max(0, a - 2) : b]]) if a < 2 else grid[a - 2 : b]
    pad = pad[-(b - a + 2) :]
    return pad[1:-1], pad[:-2]


def compress(ids: np.ndarray) -> bytes:
    """The coded form of at most BLOCK ids (below 2**32)."""
    ids = np.asarray(ids, np.uint32)
    n = len(ids)
    table = b""
    if n and int(ids.max()) >= DIRECT:
        kinds, dense = np.unique(ids, return_inverse=True)
        symbols = len(kinds)
        table = zlib.compress(np.diff(kinds.astype(np.int64), prepend=0).astype("<u4").tobytes())
    else:
        dense, symbols = ids, int(ids.max()) + 1 if n else 0
    steps, lanes = _shape(n)
    head = lambda *more: b"".join([MAGIC, struct.pack("<6I", n, steps, lanes, symbols, len(table), zlib.crc32(ids.astype("<u4").tobytes())), table, *more])
    if not n:
        return head()
    padded = np.zeros(lanes * steps, np.int64)
    padded[:n] = dense
    grid = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    last = n - (lanes - 1) * steps  # ids of the last lane; the others are full
    model = Model(symbols, False)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 48) - 1, np.uint64)
    out = np.zeros((64, lanes), np.uint32)
    used = np.zeros(lanes, np.int64)
    shift = U(model.t2)
    for a, b in _stretches(steps, lanes):
        notes: list[tuple[np.ndarray, ...]] = []
        for c in range(a, b, STEPS):
            d = min(b, c + STEPS)
            x = grid[c:d].ravel()
            one, two = (k.ravel() for k in _before(grid, c, d, symbols))
            *ends, entry, pair, named = model.intervals(x, one, two)
            bottoms, widths = (k.view(np.uint64).reshape(d - c, lanes) for k in ends)
            need = int(used.max()) + 2 * (d - c) + 8
            if need > len(out):
                out = np.vstack([out, np.zeros((max(need - len(out), len(out)), lanes), np.uint32)])
            for t in range(d - c):
                m = lanes if c + t < last else lanes - 1
                wide = span[:m]
                unit = wide >> shift
                np.multiply(unit, widths[t, :m], out=wide)
                unit *= bottoms[t, :m]
                low[:m] += unit
                short = np.flatnonzero(wide < FIRST)
                while len(short):
                    rest = low[short]
                    out[used[short], short] = rest >> W32
                    used[short] += 1
                    low[short] = (rest & LOW32) << W16
                    narrow = span[short] << W16
                    span[short] = narrow
                    short = short[narrow < FIRST]
            if b < steps:
                full = np.ones((d - c, lanes), bool)
                full[max(0, last - c) :, -1] = False
                on = full.ravel()
                notes.append(tuple(k[on] for k in (x, one, two, entry, pair, named)))
        if notes:
            x, one, two, *own = (np.concatenate(k) for k in zip(*notes, strict=True))
            model.adapt(x, one, *own)
            model.note(x, one, two)
            model.take_over()
    # One word ends a lane: the decoder takes what follows for zeros, and that number is still in the interval.
    out[used, np.arange(lanes)] = ((low + LOW32) >> W32).astype(np.uint32)
    used += 1
    for j in range(int(used.max()) - 1, 0, -1):
        out[j - 1] += out[j] >> 16
        out[j] &= 0xFFFF
    out[0] &= 0xFFFF
    columns = np.ascontiguousarray(out[: used.max()].T.astype("<u2"))
    return head(used.astype("<u2").tobytes(), columns[np.arange(columns.shape[1]) < used[:, None]].tobytes())


def decompress(data: bytes) -> np.ndarray:
    """The ids of a block. A wrong magic or checksum raises ValueError."""
    if data[:4] != MAGIC or len(data) < 28:
        raise ValueError("not a block of token ids")
    n, steps, lanes, symbols, packed, crc = struct.unpack_from("<6I", data, 4)
    ids = _decoded_ids(data, n, steps, lanes, symbols, packed) if n else np.zeros(0, "<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("wrong checksum")
    return ids


def _decoded_ids(data: bytes, n: int, steps: int, lanes: int, symbols: int, packed: int) -> np.ndarray:
    at = 28 + packed
    try:
        kinds = np.cumsum(np.frombuffer(zlib.decompress(data[28:at]), "<u4").astype(np.int64)) if packed else None
    except zlib.error as e:
        raise ValueError("damaged symbol table") from e
    words = np.frombuffer(data, "<u2", lanes, at).astype(np.int64)
    text = np.concatenate([np.frombuffer(data, "<u2", int(words.sum()), at + 2 * lanes), np.zeros(4, np.uint16)])
    at = np.cumsum(words) - words
    end = at + words
    model = Model(symbols, True)
    word = lambda i, stop: (text.take(i) * (i < stop)).astype(np.uint64)
    code = (word(at, end) << W32) | (word(at + 1, end) << W16) | word(at + 2, end)
    at = at + 3
    span = np.full(lanes, (1 << 48) - 1, np.uint64)
    shift, most = U(model.t2), float((1 << model.t2) - 1)
    grid = np.zeros((steps, lanes), np.int64)
    last = n - (lanes - 1) * steps
    one = two = np.full(lanes, symbols, np.int64)
    for a, b in _stretches(steps, lanes):
        notes = np.zeros((3, b - a if b < steps else 0, lanes), np.int64)
        for t in range(a, b):
            m = lanes if t < last else lanes - 1
            unit = span[:m] >> shift
            goal = np.minimum(code[:m] / unit, most).astype(np.int64)  # exact: numbers of 48 bits
            x, low, wide, *own = model.symbols(goal, one[:m], two[:m])
            code[:m] -= unit * low.view(np.uint64)
            span[:m] = unit * wide.view(np.uint64)
            short = np.flatnonzero(span[:m] < FIRST)
            while len(short):
                i = at[short]
                stop = end[short]
                code[short] = (code[short] << W16) | word(np.minimum(i, stop), stop)
                at[short] = i + 1
                narrow = span[short] << W16
                span[short] = narrow
                short = short[narrow < FIRST]
            grid[t, :m] = x
            if b < steps:
                for k, v in enumerate(own):
                    notes[k, t - a, :m] = v
            two, one = one, grid[t]
        if b < steps:
            full = np.ones((b - a, lanes), bool)
            full[max(0, last - a) :, -1] = False
            on = full.ravel()
            before, earlier = (c.ravel()[on] for c in _before(grid, a, b, symbols))
            x = grid[a:b].ravel()[on]
            entry, pair, named = (v.ravel()[on] for v in notes)
            model.adapt(x, before, entry, pair, named > 0)
            model.note(x, before, earlier)
            model.take_over()
    ids = grid.T.ravel()[:n]
    return (ids if kinds is None else kinds[ids]).astype("<u4")


def blocks_of(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    return [compress(ids[i : i + block]) for i in range(0, len(ids), block)]


# --- tables -------------------------------------------------------------------------------------

SCHEMA = "part int, seg int, docs binary, known binary, lens binary, meta_crc bigint, tokens bigint, blocks array<binary>"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT, block: int = BLOCK) -> None:
    """Encodes the documents, in ascending order of their ids, into a store at ``path``."""
    n = runtime.partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(n, "doc").sortWithinPartitions("doc", "text")
    rows = rows.select("doc", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)
        parts: list[pa.Array] = []
        ids: list[np.ndarray] = []
        lens: list[np.ndarray] = []
        held, seg, part = 0, 0, 0
        names = ["part", "seg", "docs", "known", "lens", "meta_crc", "tokens", "blocks"]

        def row() -> pa.RecordBatch:
            own = pa.concat_arrays(parts)
            meta = [own.fill_null(0).to_numpy().astype("<i8").tobytes(), np.packbits(own.is_valid().to_numpy(zero_copy_only=False)).tobytes(), np.concatenate(lens).astype("<u4").tobytes()]
            values = [[part], [seg], *[[m] for m in meta], [zlib.crc32(b"".join(meta))], [held], [blocks_of(np.concatenate(ids), block)]]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

        for b in runtime.slices(batches, "text"):
            part = b.column(2)[0].as_py()
            off, found = c.encode([t or "" for t in b.column(1).to_pylist()])
            size = np.diff(off) + 1
            flat = np.full(len(found) + len(size), end_id, np.uint32)
            place = np.ones(len(flat), bool)
            place[np.cumsum(size) - 1] = False
            flat[place] = found
            parts.append(b.column(0))
            lens.append(size)
            ids.append(flat)
            held += len(flat)
            if held >= segment:
                yield row()
                parts, ids, lens, held, seg = [], [], [], 0, seg + 1
        if held:
            yield row()

    rows.mapInArrow(run, SCHEMA).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<bigint>) of the documents of a store; start counts the ids of all documents before."""
    return _decoded(spark, path, lambda ids, off: [pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int64)))], [("ids", "array<bigint>")])


def checksums(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents of a store, from its decoded ids."""

    def crc(ids: np.ndarray, off: np.ndarray) -> list[pa.Array]:
        raw = ids.astype("<u4").tobytes()
        cut = (4 * off).tolist()
        return [pa.array([zlib.crc32(raw[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.int64())]

    return _decoded(spark, path, crc, [("ids_crc32", "bigint")])


def _segments(spark, path: str) -> DataFrame:
    """The segments with ``first``, the number of ids before each."""
    store = spark.read.schema(SCHEMA).parquet(path)
    totals = store.groupBy("part").agg(F.sum("tokens").alias("n"))  # one row a partition of the writing job
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("tokens").over(Window.partitionBy("part").orderBy("seg")) - F.col("tokens")
    starts = store.select("part", "seg", within.alias("within"), "tokens").join(before, "part").select("part", "seg", (F.col("within") + F.col("before")).alias("first"))
    return store.join(starts, ["part", "seg"])


def span(spark, path: str, start: int, count: int, block: int = BLOCK) -> np.ndarray:
    """The ids at start, start + 1, ... of a store: only the blocks that hold them are read and decoded. block: as written."""
    rows = _segments(spark, path).where((F.col("first") < start + count) & (F.col("first") + F.col("tokens") > start))
    here = F.greatest(F.lit(start) - F.col("first"), F.lit(0))
    stop = F.least(F.lit(start + count) - F.col("first"), F.col("tokens"))
    k = F.floor(here / block).cast("int")
    rows = rows.select("first", k.alias("k"), F.slice("blocks", k + 1, F.ceil(stop / block).cast("int") - k).alias("blocks"))
    out = [np.zeros(0, "<u4")]
    for r in rows.orderBy("first").toLocalIterator():
        ids = np.concatenate([decompress(bytes(b)) for b in r["blocks"]])
        at = r["first"] + r["k"] * block
        out.append(ids[max(0, start - at) : start + count - at])
    return np.concatenate(out)


def _decoded(spark, path: str, make, more: list[tuple[str, str]]) -> DataFrame:
    rows = _segments(spark, path).select("first", "docs", "known", "lens", "meta_crc", "blocks").repartition(runtime.partitions(spark), "first")
    names = ["doc_id", "start", "n_tokens", *[n for n, _ in more]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                first, docs, known, lens, crc, blocks = (b.column(k)[i].as_py() for k in range(6))
                if zlib.crc32(docs + known + lens) != crc:
                    raise ValueError("wrong checksum of a segment's documents")
                docs, lens = np.frombuffer(docs, "<i8"), np.frombuffer(lens, "<u4").astype(np.int64)
                null = np.unpackbits(np.frombuffer(known, np.uint8), count=len(docs)) == 0
                ids = np.concatenate([decompress(x) for x in blocks])
                off = np.concatenate([[0], np.cumsum(lens)])
                for k in range(0, len(docs), 1000):
                    part = off[k : k + 1001]
                    doc = pa.array(docs[k : k + 1000], pa.int64(), mask=null[k : k + 1000])
                    yield pa.RecordBatch.from_arrays([doc, pa.array(first + part[:-1]), pa.array(np.diff(part)), *make(ids[part[0] : part[-1]], part - part[0])], names)

    return rows.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, " + ", ".join(f"{n} {t}" for n, t in more))
