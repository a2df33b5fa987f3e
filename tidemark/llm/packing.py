"""Best-fit packing of documents into sequences of a fixed number of tokens.

Method. Documents become pieces of at most ``size`` tokens (stored once, as rows of a few numbers).
Only the histogram of piece lengths reaches the driver: at most ``size`` numbers, whatever the
input. Over it the configuration linear program (cover each length as often as it occurs by as few
fillings of a sequence as possible) is solved by multiplicative weights: each length has a weight
that falls as it gets covered, and each round adds the filling of largest total weight, priced by
dynamic programming over the capacity (a knapsack). The solution is rounded down to whole
fillings; what is left is filled best-fit: the longest piece left, topped up with the set of
lengths that fills the sequence most (subset sums as bits of one integer), as often as it can be
repeated.

Pieces of one length are interchangeable, so a piece's place follows from its number among the
pieces of its length. A length is dealt to one part for each PART of its pieces, whose counts are
summed first; numbers are given by a window in each part, so a length of a third of all pieces is
spread over as many tasks as it needs.

Defined results: a null or empty text is one piece of one token; repeated rows and rows without an
id are packed as often as they occur; pieces of equal rows may change places; an empty table gives
an empty table; other input columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import runtime
from tidemark.llm.bpe import coder

SIZE = 2048
ROUNDS = 120
#: Pieces of one length that a task numbers.
PART = 200_000
ETA = 0.7


def pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each document's pieces; the first may be the short one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in runtime.slices(batches, text_col):
            off, ids = c.encode([t or "" for t in b.column(1).to_pylist()])
            n = np.diff(off) + 1
            flat = np.full(len(ids) + len(n), end_id, "<u4")
            end = np.cumsum(n)
            place = np.ones(len(flat), bool)
            place[end - 1] = False
            flat[place] = ids
            many = -(-n // size)
            doc = np.repeat(np.arange(len(n)), many)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            head = n - (many - 1) * size
            start = np.where(k > 0, head[doc] + (k - 1) * size, 0)
            length = np.where(k > 0, size, head[doc])
            at = (end - n)[doc] + start
            raw = flat.tobytes()
            crc = [zlib.crc32(raw[4 * i : 4 * (i + m)]) for i, m in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(k.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), pa.array(crc, pa.int64())], [id_col, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def knapsack(weights: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """How often each item is taken in a filling of largest value (items repeat)."""
    best, choice = np.zeros(size + 1), np.full(size + 1, -1)
    order = np.argsort(weights)
    w, v = weights[order], values[order]
    upto = np.searchsorted(w, np.arange(size + 1), "right")
    for c in range(1, size + 1):
        best[c], choice[c] = best[c - 1], -1
        k = upto[c]
        if k:
            gain = best[c - w[:k]] + v[:k]
            i = int(gain.argmax())
            if gain[i] > best[c]:
                best[c], choice[c] = gain[i], i
    out, c = np.zeros(len(w), np.int64), size
    while c > 0:
        i = choice[c]
        if i < 0:
            c -= 1
        else:
            out[order[i]] += 1
            c -= w[i]
    return out


def fractional(lengths: np.ndarray, counts: np.ndarray, size: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Fillings and how often each is used in the linear program's approximate solution.

    Weight of length i: exp(-ETA * share of i covered so far), in proportion to its size; a round uses its filling until the
    scarcest of its lengths is covered once more in the share of one step.
    """
    covered = np.zeros(len(lengths))
    used: list[tuple[np.ndarray, float]] = []
    for _ in range(rounds):
        share = covered / counts
        values = lengths / size * np.exp(-ETA * share)
        a = knapsack(lengths, values, size)
        on = a > 0
        step = float((counts[on] / a[on]).min())
        if step <= 0:
            break
        covered[on] += step * a[on]
        used.append((a, step))
    return used


def fill(room: int, lengths: list[int], left: list[int]) -> list[int]:
    """The multiset of lengths (indices, longest first tried) with the largest sum that fits, by subset sums in one integer."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for i in range(len(lengths) - 1, -1, -1):
        w = lengths[i]
        if w > room or not left[i]:
            continue
        for _ in range(min(left[i], room // w)):
            more = (reach | reach << w) & mask
            if more == reach:
                break
            steps.append((i, reach))
            reach = more
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for i, before in reversed(steps):
        if not before >> at & 1:
            out.append(i)
            at -= lengths[i]
    return out


def plan(histogram: dict[int, int], size: int = SIZE, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """(lengths and how often each, repetitions): fillings that hold exactly the pieces of the histogram."""
    out: list[tuple[dict[int, int], int]] = []
    if histogram.get(size):
        out.append(({size: 1}, histogram[size]))
    items = sorted((w, n) for w, n in histogram.items() if n and w < size)
    if not items:
        return out
    lengths, counts = np.array([w for w, _ in items]), np.array([n for _, n in items])
    left = counts.copy()
    used = fractional(lengths, counts.astype(float), size, rounds)
    total: dict[bytes, float] = {}
    for a, x in used:
        total[a.tobytes()] = total.get(a.tobytes(), 0.0) + x
    covered = sum((np.frombuffer(k, np.int64) * x for k, x in total.items()), np.zeros(len(lengths)))
    scale = 1.0 / max(1.0, float((covered / counts).max()))
    for k, x in sorted(total.items(), key=lambda e: (-e[1], e[0])):
        a = np.frombuffer(k, np.int64)
        on = a > 0
        if int(a @ lengths) < size - size // 256:
            continue
        n = int(min(x * scale, float((left[on] // a[on]).min())))
        if n:
            out.append(({int(w): int(m) for w, m in zip(lengths[on], a[on], strict=True)}, n))
            left -= n * a
    w, rest = lengths.tolist(), left.tolist()
    while any(rest):
        top = max(i for i, n in enumerate(rest) if n)
        rest[top] -= 1
        chosen = [top, *fill(size - w[top], w, rest)]
        rest[top] += 1
        a = {}
        for i in chosen:
            a[i] = a.get(i, 0) + 1
        n = min(rest[i] // m for i, m in a.items())
        for i, m in a.items():
            rest[i] -= n * m
        out.append(({w[i]: m for i, m in a.items()}, n))
    return out


def places(fillings: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """By length and number of a piece: runs of numbers, and the sequences and offsets that they take."""
    rows, next_of, sequence = [], {}, 0
    for a, n in fillings:
        offset = 0
        for w in sorted(a, reverse=True):
            first = next_of.get(w, 0)
            rows.append((w, first, sequence, a[w], offset))
            next_of[w] = first + n * a[w]
            offset += w * a[w]
        sequence += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {k: table[:, i].copy() for i, k in enumerate(("length", "first", "sequence", "times", "offset"))}


def lower_bound(histogram: dict[int, int], size: int = SIZE) -> int:
    """Sequences that any packing needs."""
    return max(-(-sum(w * n for w, n in histogram.items()) // size), sum(n for w, n in histogram.items() if 2 * w > size))


def pack(found: DataFrame, size: int = SIZE, rounds: int = ROUNDS, part: int = PART) -> DataFrame:
    """The rows of ``found`` (a stored table with a column length of 1 to size) with sequence_id and offset."""
    spark = found.sparkSession
    names = found.columns
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most size rows
    table = places(plan(histogram, size, rounds))
    parts = spark.createDataFrame([(w, -(-n // part)) for w, n in sorted(histogram.items())], "length bigint, _parts bigint")
    own = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.col("_parts"))
    dealt = found.join(F.broadcast(parts), "length").select(*names, own.alias("_part"))
    counts = dealt.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n")).orderBy("length", "_part").toArrow()  # a row for each part
    length, at, n = (counts[c].to_numpy() for c in ("length", "_part", "_n"))
    first = np.zeros(size + 2, np.int64)  # by length, the place of its parts in base
    first[1:] = np.cumsum([-(-histogram.get(w, 0) // part) for w in range(size + 1)])
    base = np.zeros(int(first[-1]), np.int64)
    base[first[length] + at] = n
    base = np.cumsum(base) - base
    for w in range(size + 1):
        base[first[w] : first[w + 1]] -= base[first[w]] if first[w] < first[w + 1] else 0
    shared = spark.sparkContext.broadcast((first, base, table))  # numbers for each length and part of PART pieces
    order = Window.partitionBy("length", "_part").orderBy(*[F.col(f"`{c}`") for c in names])
    numbered = dealt.withColumn("_number", F.row_number().over(order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, base, t = shared.value
        for b in batches:
            length = b.column(names.index("length")).to_numpy()
            number = base[first[length] + b.column(len(names)).to_numpy()] + b.column(len(names) + 1).to_numpy() - 1
            wide = np.int64(1) << 40
            row = np.searchsorted(t["length"] * wide + t["first"], length * wide + number, "right") - 1
            within = number - t["first"][row]
            sequence = t["sequence"][row] + within // t["times"][row]
            offset = t["offset"][row] + within % t["times"][row] * length
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return numbered.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(runtime.store(pieces(docs, path, size, end_id, id_col, text_col), "pieces"), size)
