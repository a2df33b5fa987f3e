"""Line dedup with sharded cuckoo filters over exact reference counts; insertions and deletions.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased, as a 128-bit hash.
A key of at least ``min_chars`` code points found in at least ``min_docs`` documents is *shared*: its
lines go everywhere but in the document with the largest id that holds it.

Method. The reference table holds one signed row per (key, document): insert() appends +1, delete()
appends -1, and the exact count of a key is the sum. Nothing is overwritten, so every change is
reversible. After a change only the keys that it touches are counted again; counting adds up
within each task before the shuffle. Shared keys are dealt to shards by hash. A shard is one row:
the exact table of its shared keys and a cuckoo filter of them, which takes up keys that became
shared, drops keys that no longer are, and is rebuilt at twice the size from the shard's own table
when it overflows; an index that outgrows its shards deals all keys to more.

Documents travel in slices of bounded size. A slice asks each shard once for the keys that it
holds, so a line of a third of all documents is one question a slice. In the shard's task the
filter passes on what may be shared, the exact table next to it answers, and the answers meet the
slice again. There is one way for every size: nothing of the table is collected or broadcast.
Shards that are fewer than the tasks are copied, each copy for its part of the slices.

Defined results: a null or empty text is one empty line; rows that repeat a doc_id count as
documents of their own, and all of them keep a line that the id keeps; a null id is smaller than
any other; an empty table gives an empty table; apply() leaves out other columns and
rewrite() keeps them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import runtime
from tidemark.llm.hashing import IntMap, mix

MIN_CHARS = 40
MIN_DOCS = 5
#: Shared keys a shard is planned for, at about 50 bytes each.
SHARD_KEYS = 100_000
#: Text that a slice holds.
SLICE_BYTES = 2 << 20
NO_ID = -(2**63)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(9, 14)]] = True


class Cuckoo:
    """A cuckoo filter: buckets of four 16-bit fingerprints, filled, read and emptied by arrays."""

    def __init__(self, capacity: int, table: np.ndarray | None = None) -> None:
        n = 1 << max(2, int(capacity / 3).bit_length())
        self.table = np.zeros((n, 4), np.uint16) if table is None else table
        self.spin = 0

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = (hi & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        return mark, (lo & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ (mix(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, at = self._places(hi, lo)
        same = lambda i: (self.table[i] == mark[:, None]).any(1)
        return same(at) | same(self._other(mark, at))

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Raises OverflowError when the keys find no place, which leaves some of them out."""
        mark, at = self._places(hi, lo)
        rounds = 0
        while len(mark):
            rounds += 1
            if rounds > 500:
                raise OverflowError("the filter is too small")
            _, first = np.unique(at, return_index=True)
            turn = np.zeros(len(mark), bool)
            turn[first] = True
            m, a = mark[turn], at[turn]
            free = self.table[a] == 0
            direct = free.any(1)
            self.table[a[direct], free[direct].argmax(1)] = m[direct]
            m, a = m[~direct], a[~direct]
            self.spin += 1
            slot = (np.arange(len(a)) + self.spin) % 4
            out = self.table[a, slot].copy()
            self.table[a, slot] = m
            mark = np.concatenate([mark[~turn], out])
            at = np.concatenate([at[~turn], self._other(out, a)])

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        mark, at = self._places(hi, lo)
        other = self._other(mark, at)
        for m, a, b in zip(mark.tolist(), at.tolist(), other.tolist(), strict=True):
            for i in (a, b):
                hit = np.flatnonzero(self.table[i] == m)
                if len(hit):
                    self.table[i, hit[0]] = 0
                    break


def filled(hi: np.ndarray, lo: np.ndarray, capacity: int) -> Cuckoo:
    """A filter of these keys; it doubles until all have a place."""
    while True:
        out = Cuckoo(capacity)
        try:
            out.insert(hi, lo)
            return out
        except OverflowError:
            capacity *= 2


class Lines:
    """The lines of a column of texts."""

    def __init__(self, column: pa.Array, min_chars: int) -> None:
        offsets, data = runtime.utf8(column)
        self.offsets, self.data = offsets, data
        newline = np.flatnonzero(data == 0x0A)
        self.start = np.sort(np.concatenate([offsets[:-1], newline + 1]), kind="stable")
        self.end = np.sort(np.concatenate([newline, offsets[1:]]), kind="stable")
        per = np.searchsorted(newline, offsets)
        self.count = np.diff(per) + 1
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        solid = np.flatnonzero(~_BLANK[data])
        a, b = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        full = np.flatnonzero(b > a)
        lo, hi = solid[a[full]], solid[b[full] - 1] + 1
        long = points[hi] - points[lo] >= min_chars
        self.line, lo, hi = full[long], lo[long], hi[long]
        lowered = _LOWER[data].tobytes()
        digest = xxhash.xxh3_128_digest
        raw = b"".join([digest(lowered[i:j]) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)])
        keys = np.frombuffer(raw, "<u8").reshape(-1, 2)
        self.hi, self.lo = keys[:, 0].astype(np.uint64), keys[:, 1].astype(np.uint64)
        self.doc = np.searchsorted(self.first, self.line, "right") - 1

    def without(self, gone: np.ndarray) -> pa.Array:
        """The texts without the lines where gone is True."""
        data = self.data.tobytes()
        out: list[bytes] = []
        for i, hit in enumerate(self.dropped(gone).tolist()):
            if not hit:
                out.append(data[self.offsets[i] : self.offsets[i + 1]])
            else:
                rows = np.arange(self.first[i], self.first[i + 1])
                rows = rows[~gone[rows]]
                out.append(b"\n".join([data[a:b] for a, b in zip(self.start[rows].tolist(), self.end[rows].tolist(), strict=True)]))
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in out], dtype=np.int64)])
        return runtime.strings(offsets, b"".join(out))

    def dropped(self, gone: np.ndarray) -> np.ndarray:
        return np.add.reduceat(gone, self.first[:-1], dtype=np.int64) if len(self.count) else np.zeros(0, np.int64)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _u64(column) -> np.ndarray:
    return np.ascontiguousarray(column.to_numpy()).view(np.uint64)


def references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(hi, lo, doc) once for each row of docs and key in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runtime.slices(batches, text_col):
            x = Lines(b.column(1), min_chars)
            order = np.lexsort((x.doc, x.lo, x.hi))
            hi, lo, doc = x.hi[order], x.lo[order], x.doc[order]
            new = np.ones(len(order), bool)
            new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]) | (doc[1:] != doc[:-1])
            yield pa.RecordBatch.from_arrays([_signed(hi[new]), _signed(lo[new]), pa.array(_ids(b.column(0))[doc[new]])], ["hi", "lo", "doc"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, "hi bigint, lo bigint, doc bigint")


def counted(refs: DataFrame) -> DataFrame:
    """(hi, lo, docs, last) of the keys that signed references (hi, lo, doc, delta) leave in any document."""
    held = refs.groupBy("hi", "lo", "doc").agg(F.sum("delta").alias("delta")).where("delta > 0")
    return held.groupBy("hi", "lo").agg(F.sum("delta").alias("docs"), F.max("doc").alias("last"))


SHARD = "shard int, n bigint, filter binary, hi binary, lo binary, docs binary, last binary"
_SHARD_NAMES = ["shard", "n", "filter", "hi", "lo", "docs", "last"]


def _shard_row(shard: int, f: Cuckoo, hi: np.ndarray, lo: np.ndarray, docs: np.ndarray, last: np.ndarray) -> pa.Table:
    cells = [[shard], [len(hi)], [f.table.tobytes()], *[[np.ascontiguousarray(c).tobytes()] for c in (hi, lo, docs, last)]]
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
    return pa.table([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=_SHARD_NAMES)


def _exact(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(hi, lo, docs, last) of a shard's rows."""
    hi, lo = (runtime.joined(table[c].to_pylist(), np.uint64) for c in ("hi", "lo"))
    docs, last = (runtime.joined(table[c].to_pylist(), np.int64) for c in ("docs", "last"))
    return hi, lo, docs, last


def _one(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    key = mix(hi) ^ lo
    key[key == 0] = 1
    return key


class Exact:
    """Places of 128-bit keys."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray) -> None:
        self.hi, self.lo = hi, lo
        self.map = IntMap(max(16, len(hi)))
        self.map.add(_one(hi, lo), np.arange(len(hi)))

    def places(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        at = self.map.get(_one(hi, lo))
        if len(self.hi):
            at[(at >= 0) & ((self.hi[at] != hi) | (self.lo[at] != lo))] = -1
        return at


def _shard_of(shards: int):
    return F.pmod(F.col("lo"), F.lit(shards)).cast("int")


def refresh(state: DataFrame | None, changed: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """The shards after a change: ``changed`` has the new (hi, lo, docs, last) of each key touched, with docs 0 for those gone."""

    def run(key, old, new):
        hi, lo = _u64(new["hi"]), _u64(new["lo"])
        docs, last = new["docs"].to_numpy(), new["last"].to_numpy()
        shared = docs >= min_docs
        if not old.num_rows:
            parts = hi[shared], lo[shared], docs[shared], last[shared]
            return _shard_row(key[0].as_py(), filled(parts[0], parts[1], len(parts[0]) + 16), *parts)
        before = _exact(old)
        table = Exact(before[0], before[1])
        at = table.places(hi, lo)
        gone, fresh = (at >= 0) & ~shared, (at < 0) & shared
        stay = np.ones(len(before[0]), bool)
        stay[at[at >= 0]] = False
        parts = tuple(np.concatenate([b[stay], c[shared]]) for b, c in zip(before, (hi, lo, docs, last), strict=True))
        f = Cuckoo(0, np.frombuffer(old["filter"][0].as_py(), np.uint16).reshape(-1, 4).copy())
        f.delete(hi[gone], lo[gone])
        try:
            f.insert(hi[fresh], lo[fresh])
        except OverflowError:
            f = filled(parts[0], parts[1], max(3 * len(f.table), len(parts[0]) + 16))
        return _shard_row(key[0].as_py(), f, *parts)

    if state is None:
        state = changed.sparkSession.createDataFrame([], SHARD)
    rows = changed.select(_shard_of(shards).alias("shard"), "hi", "lo", "docs", "last")
    return state.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(run, SHARD)


def shared_keys(state: DataFrame) -> DataFrame:
    """(hi, lo, docs, last) of all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hi, lo, docs, last = _exact(pa.Table.from_batches([b]))
            yield pa.RecordBatch.from_arrays([_signed(hi), _signed(lo), pa.array(docs), pa.array(last)], ["hi", "lo", "docs", "last"])

    return state.mapInArrow(run, "hi bigint, lo bigint, docs bigint, last bigint")


def _answers(rows: DataFrame, state: DataFrame, shards: int, text_col: str, min_chars: int) -> DataFrame:
    """(slice, hi, lo, last), packed: what the shards know of the keys in each slice."""
    copies = max(1, -(-runtime.partitions(rows.sparkSession) // shards))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            number = whole.column(1).to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]])) if len(number) else np.zeros(1, int)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                x = Lines(whole.column(0).slice(a, b - a), min_chars)
                order = np.lexsort((x.lo, x.hi))
                hi, lo = x.hi[order], x.lo[order]
                new = np.ones(len(hi), bool)
                new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
                hi, lo = hi[new], lo[new]
                shard = np.mod(lo.view(np.int64), shards)
                found = [(k, int(number[a] % copies), int(number[a]), hi[at].tobytes(), lo[at].tobytes()) for k, at in runtime.dealt(lo, shard, shards)]
                if found:
                    cells = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "copy", "slice", "hi", "lo"])

    def answer(key, questions, shard):
        schema = pa.schema([("slice", pa.int64()), ("hi", pa.binary()), ("lo", pa.binary()), ("last", pa.binary())])
        if not shard.num_rows or not questions.num_rows:
            return schema.empty_table()
        hi, lo, _, last = _exact(shard)
        table, f = Exact(hi, lo), Cuckoo(0, np.frombuffer(shard["filter"][0].as_py(), np.uint16).reshape(-1, 4))
        out: dict[str, list] = {n: [] for n in schema.names}
        for number, h, l in zip(*[questions[c].to_pylist() for c in ("slice", "hi", "lo")], strict=True):
            h, l = np.frombuffer(h, np.uint64), np.frombuffer(l, np.uint64)
            maybe = f.contains(h, l)
            h, l = h[maybe], l[maybe]
            at = table.places(h, l)
            on = at >= 0
            if on.any():
                for n, v in zip(out, (number, h[on].tobytes(), l[on].tobytes(), last[at[on]].tobytes()), strict=True):
                    out[n].append(v)
        return pa.table([pa.array(v, t.type) for v, t in zip(out.values(), schema, strict=True)], schema=schema)

    asked = rows.select(F.col(text_col), runtime.SLICE).mapInArrow(ask, "shard int, copy int, slice bigint, hi binary, lo binary")
    told = state.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return asked.groupBy("shard", "copy").cogroup(told.groupBy("shard", "copy")).applyInArrow(answer, "slice bigint, hi binary, lo binary, last binary")


class LineIndex:
    """Reference counts that grow and shrink with the documents they stand for.

    The state is an append-only table of signed references below ``path`` (by default a folder that goes
    with the session) and the shards of the last change. insert() and delete() take the documents that come or go; since deletion appends the
    references of the same texts with -1, an insertion can be undone exactly, and the reverse.
    """

    def __init__(self, spark, path: str | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int = 4) -> None:
        self.spark, self.path = spark, path or runtime.passing_path(spark, "line-index")
        self.min_chars, self.min_docs, self.shards = min_chars, min_docs, shards
        self.state: DataFrame | None = None

    def _append(self, docs: DataFrame, delta: int, id_col: str, text_col: str) -> None:
        """The new references join the table once the shards hold them, so that a failed call leaves the index as it was."""
        new = runtime.store(references(docs, id_col, text_col, self.min_chars).withColumn("delta", F.lit(delta).cast("bigint")), "line-index-new")
        changed = None
        try:
            state, shards = self.state, self.shards
            if self._there():
                touched = new.select("hi", "lo").distinct()
                counts = counted(self.references().join(touched, ["hi", "lo"], "left_semi").unionByName(new))
                changed = touched.join(counts, ["hi", "lo"], "left").select("hi", "lo", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("last", F.lit(NO_ID)).alias("last"))
            else:
                changed = counted(new)
            if state is None:
                changed = changed.where(F.col("docs") >= self.min_docs)
            changed = runtime.store(changed, "line-index-changed")
            if state is None:
                shards = max(shards, -(-changed.count() // SHARD_KEYS))
            state = runtime.store(refresh(state, changed, shards, self.min_docs), "line-index-shards")
            held = state.agg(F.sum("n")).first()[0] or 0
            if held > 2 * SHARD_KEYS * shards:
                shards = -(-held // SHARD_KEYS) * 2
                small, state = state, runtime.store(refresh(None, shared_keys(state), shards, self.min_docs), "line-index-shards")
                runtime.discard(small)
            self._take(new)
        except Exception:
            runtime.discard(new)
            raise
        finally:
            if changed is not None:
                runtime.discard(changed)
        if self.state is not None:
            runtime.discard(self.state)
        self.state, self.shards = state, shards

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _there(self) -> bool:
        fs, refs = self._at(f"{self.path}/refs")
        return fs.exists(refs)

    def _take(self, new: DataFrame) -> None:
        """Moves the stored references into the table, in one step."""
        fs, refs = self._at(f"{self.path}/refs")
        fs.mkdirs(refs)
        if not fs.rename(self._at(new.stored_at)[1], self._at(f"{self.path}/refs/{new.stored_at.rsplit('/', 1)[1]}")[1]):
            raise OSError(f"cannot move {new.stored_at} to {self.path}/refs")

    def references(self) -> DataFrame:
        return self.spark.read.schema("hi bigint, lo bigint, doc bigint, delta bigint").option("recursiveFileLookup", "true").parquet(f"{self.path}/refs")

    def shared(self) -> DataFrame:
        """(hi, lo, docs, last) of the shared keys."""
        return shared_keys(self.state)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        self._append(docs, 1, id_col, text_col)

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        self._append(docs, -1, id_col, text_col)

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, n_lines, n_dropped, kept_text) of each row."""
        kind = docs.schema[id_col].dataType.simpleString()
        return self._run(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col, f"`{id_col}` {kind}, n_lines bigint, n_dropped bigint, kept_text string", False)

    def rewrite(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The rows with their texts replaced, and all their columns."""
        return self._run(docs, id_col, text_col, docs.schema, True)

    def _run(self, docs: DataFrame, id_col: str, text_col: str, schema, whole: bool) -> DataFrame:
        rows = runtime.sliced(docs, text_col, SLICE_BYTES, "line-slices")
        names, min_chars = docs.columns, self.min_chars
        at_id, at_text = names.index(id_col), names.index(text_col)
        answers = _answers(rows, self.state, self.shards, text_col, min_chars)

        def run(key, docs, told):
            hi, lo = (runtime.joined(told[c].to_pylist(), np.uint64) for c in ("hi", "lo"))
            last = runtime.joined(told["last"].to_pylist(), np.int64)
            _, once = np.unique(np.column_stack([hi, lo]), axis=0, return_index=True) if len(hi) else (None, np.zeros(0, np.int64))
            table, last = Exact(hi[once], lo[once]), last[once]
            x = Lines(docs.column(at_text), min_chars)
            place = table.places(x.hi, x.lo)
            gone = np.zeros(len(x.start), bool)
            if len(last):
                gone[x.line[(place >= 0) & (last[place] != _ids(docs.column(at_id).combine_chunks())[x.doc])]] = True
            text = x.without(gone)
            if whole:
                columns = list(docs.columns[: len(names)])
                columns[at_text] = text
                return pa.table(columns, names=names)
            return pa.table([docs.column(at_id), pa.array(x.count.astype(np.int64)), pa.array(x.dropped(gone)), text], names=[names[at_id], "n_lines", "n_dropped", "kept_text"])

        return rows.groupBy(runtime.SLICE).cogroup(answers.groupBy("slice")).applyInArrow(run, schema)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, whole_rows: bool = False) -> DataFrame:
    """Per row: id, n_lines, n_dropped, kept_text; or, with whole_rows, the row with its text replaced. The index is made of the rows themselves."""
    index = LineIndex(docs.sparkSession, min_chars=min_chars, min_docs=min_docs)
    index.insert(docs, id_col, text_col)
    return index.rewrite(docs, id_col, text_col) if whole_rows else index.apply(docs, id_col, text_col)
