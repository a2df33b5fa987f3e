"""N-gram Jaccard join by prefix trees.

Two documents link when 100 * |A & B| >= 80 * |A | B| for their sets of word 5-grams (64-bit
hashes). The result is each document's set size, its component under links, and on request the
links themselves between representatives of equal sets.

Method.
1. Documents of equal sets are one class; its smallest doc_id represents it.
2. Representatives travel in slices of bounded size. A slice asks once for each distinct n-gram and
   says how many of its sets hold it; the n-gram's hash bucket sums this up and answers how common it
   is among all representatives. An n-gram of a third of all documents is one question a slice.
   (32-bit remainders name the n-grams in a bucket; two that meet only add candidates.)
3. All sets have one global order, rarest n-gram first, then by hash. Sets that reach the threshold
   share one of their first n - ceil(0.8 n) + 1 n-grams, so only these join (ties at the cut are kept).
4. All representatives that share such an n-gram meet in the bag of the smallest of them. A bag is
   stored as a trie of its sets in one order; each set walks the trie once, sharing the partial
   overlaps along common paths, and leaves a subtree when the overlap so far and the remaining
   lengths can't reach the threshold, when sizes differ too much, or when the whole subtree is
   already in its component. Only links that join two components are emitted, so a bag of n sets
   gives at most n - 1 rows.
5. A bag of over BAG sets is split by hash, its leading set L copied to each part. Bags whose parts
   don't end in one component ("open") are joined again by what their sets hold beyond L: a set x
   that links with another must share at least r = ceil(0.8 |x|) - |x & L| n-grams outside L with it,
   so (for r >= 1) one of its first |x - L| - r + 1 n-grams there. These make smaller bags. Sets with
   r < 1 lie in L to four fifths and use all n-grams outside L; those of one bag, and smaller bags
   that are open again, are joined part by part. That makes the result exact.

Defined results: without words a set is empty, linked with nothing; rows that share a doc_id are
one document for links (their texts, if they differ, are linked) and each get a row; rows without
an id link with nothing and have a null component; among equal sets the smallest id counts; an
empty table gives an empty table; other input columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import runtime
from tidemark.llm.components import components
from tidemark.llm.hashing import Hasher, IntMap, mix

WORDS = 5
#: Per cent of the union that two sets must share.
SHARE = 80
#: Sets that one task joins at a time.
BAG = 400
#: Rows (bag, part, document) up to which they are broadcast, at about 30 bytes each; a shuffled join beyond.
BROADCAST_ROWS = 2_000_000
#: Text of a slice.
SLICE_BYTES = 2 << 20
U = np.uint64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SOLID = np.ones(256, bool)
_SOLID[[0x20, *range(9, 14)]] = False
HASHER = Hasher(256, 77)


def word_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of the words of concatenated texts."""
    n = len(data)
    solid = _SOLID[data]
    new = np.zeros(n + 1, bool)
    new[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | new[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | new[1:n]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    offsets, data = runtime.utf8(column)
    n = len(offsets) - 1
    start, end, _ = word_spans(offsets, data)
    h = HASHER.spans(_LOWER[data], start, end)
    border = np.searchsorted(start, offsets).tolist()
    turn = [U(pow(0xD1342543DE82EF95, j + 1, 1 << 64)) for j in range(words)]
    m = max(0, len(h) - words + 1)
    grams = np.zeros(m, np.uint64)
    for j in range(words):
        grams += h[j : j + m] * turn[j]
    grams = mix(grams)
    out = []
    for a, b in zip(border[:-1], border[1:], strict=True):
        k = b - a
        if k >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif k:
            out.append(mix((h[a:b] * np.array(turn[:k])).sum(keepdims=True) + U(k)))
        else:
            out.append(np.zeros(0, np.uint64))
    assert len(out) == n
    return out


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _prints(sets: list[np.ndarray]) -> np.ndarray:
    """A 128-bit fingerprint of each set, as two columns."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(s.tobytes()) for s in sets]), "<i8").reshape(-1, 2)


def set_sizes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, n_shingles, f1, f2): the size and the fingerprint of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runtime.slices(batches, text_col):
            sets = shingle_sets(b.column(1))
            f = _prints(sets)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy())], ["doc", "n_shingles", "f1", "f2"])

    return docs.select(F.col(id_col).alias("doc"), F.col(text_col)).mapInArrow(run, "doc bigint, n_shingles bigint, f1 bigint, f2 bigint")


def _names(grams: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket (high half) and remainder of each n-gram, as one number."""
    return ((grams >> U(32)) * U(buckets) & ~U(0xFFFFFFFF)) | (grams & U(0xFFFFFFFF))


def _questions(slices: DataFrame, buckets: int) -> DataFrame:
    """(bucket, slice, rests, counts): the distinct n-grams of each slice's sets, and how many of them hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            number = whole.column(1).to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]])) if len(number) else np.zeros(1, int)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                names, n = np.unique(_names(np.concatenate(shingle_sets(whole.column(0).slice(a, b - a))), buckets), return_counts=True)
                bucket, rest = (names >> U(32)).astype(np.int64), (names & U(0xFFFFFFFF)).astype("<u4")
                ends = np.searchsorted(bucket, np.arange(buckets + 1))
                rows = [(k, int(number[a]), runtime.planes(rest[i:j]), np.minimum(n[i:j], 255).astype(np.uint8).tobytes()) for k, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if j > i]
                if rows:
                    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "slice", "rests", "counts"])

    return slices.select("text", runtime.SLICE).mapInArrow(run, "bucket int, slice bigint, rests binary, counts binary")


def _ranks(asked: DataFrame) -> DataFrame:
    """(slice, bucket, rests, ranks): of the n-grams that more than one set holds, how common they are (1 to 255, by the logarithm)."""

    def run(key, table):
        schema = pa.schema([("slice", pa.int64()), ("bucket", pa.int32()), ("rests", pa.binary()), ("ranks", pa.binary())])
        rests = [runtime.numbers(x, "<u4") for x in table["rests"].to_pylist()]
        own, at = np.unique(np.concatenate(rests), return_inverse=True)
        n = np.bincount(at, runtime.joined(table["counts"].to_pylist(), np.uint8))
        rank = np.where(n > 1, np.minimum(255, 8 * np.log2(np.maximum(n, 1))), 0).astype(np.uint8)[at]
        out: dict[str, list] = {c: [] for c in schema.names}
        cut = np.cumsum([0, *map(len, rests)]).tolist()
        for number, rest, a, b in zip(table["slice"].to_pylist(), rests, cut[:-1], cut[1:], strict=True):
            own = rank[a:b]
            on = own > 0
            if on.any():
                for c, v in zip(out, (number, key[0].as_py(), runtime.planes(rest[on]), own[on].tobytes()), strict=True):
                    out[c].append(v)
        return pa.table([pa.array(v, f.type) for v, f in zip(out.values(), schema, strict=True)], schema=schema)

    return asked.groupBy("bucket").applyInArrow(run, "slice bigint, bucket int, rests binary, ranks binary")


def _prefixes(slices: DataFrame, ranks: DataFrame, buckets: int, share: int) -> DataFrame:
    """(gram, set): the n-grams of each set's prefix that another set holds too; sets go by the first half of their fingerprint."""

    def run(key, docs, told):
        schema = pa.schema([("gram", pa.int64()), ("set", pa.int64())])
        if not docs.num_rows or not told.num_rows:
            return schema.empty_table()
        rests = [runtime.numbers(x, "<u4") for x in told["rests"].to_pylist()]
        known = np.concatenate([(U(k) << U(32)) | r for k, r in zip(told["bucket"].to_pylist(), rests, strict=True)])
        known, first = np.unique(known, return_index=True)
        rank_of = runtime.joined(told["ranks"].to_pylist(), np.uint8)[first]
        places = IntMap(max(16, len(known)))
        places.add(known + U(1), np.arange(len(known)))
        sets = shingle_sets(docs["text"])
        mark = _prints(sets)[:, 0]
        size = np.array([len(s) for s in sets], np.int64)
        slot = np.repeat(np.arange(len(sets)), size)
        gram = _names(np.concatenate(sets), buckets)
        at = places.get(gram + U(1))
        slot, gram, rank = slot[at >= 0], gram[at >= 0], rank_of[at[at >= 0]]
        # N-grams of this set alone come first in the order, and join nothing.
        alone = size - np.bincount(slot, minlength=len(sets))
        length = size - -(-share * size // 100) + 1 - alone
        live = (length > 0)[slot]
        gram, rank, slot = gram[live], rank[live], slot[live]
        order = np.lexsort((gram, rank, slot))
        gram, rank, slot = gram[order], rank[order], slot[order]
        first = np.searchsorted(slot, slot)
        keep = np.arange(len(slot)) - first < length[slot]
        if len(slot):
            last = np.minimum(first + length[slot] - 1, len(slot) - 1)
            keep |= (gram == gram[last]) & (rank == rank[last]) & (slot == slot[last])
        return pa.table([_signed(gram[keep]), pa.array(mark[slot[keep]].astype(np.int64))], schema=schema)

    return slices.groupBy(runtime.SLICE).cogroup(ranks.groupBy("slice")).applyInArrow(run, "gram bigint, `set` bigint")


class Trie:
    """Sets as paths of one compressed tree.

    Sets are rows of ranks in one order, sorted as strings. A node is an edge: the ranks from depth
    ``a`` to ``b`` of row ``row``, the rows lo..hi below it, and the smallest and largest of their sizes.
    """

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.rows = rows
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.root = self._build(0, len(rows), 0)

    def _build(self, lo: int, hi: int, depth: int) -> list:
        """[(a, b, lo, hi, least, most, children)] below a path of ``depth``. Work list instead of recursion: tries can be deep."""
        top: list = []
        work = [(lo, hi, depth, top)]
        while work:
            lo, hi, depth, into = work.pop()
            while lo < hi:
                row = self.rows[lo]
                if len(row) == depth:
                    into.append((depth, depth, lo, lo + 1, depth, depth, []))
                    lo += 1
                    continue
                end = lo + 1
                while end < hi and len(self.rows[end]) > depth and self.rows[end][depth] == row[depth]:
                    end += 1
                stop = len(row)
                if end - lo > 1:
                    last = self.rows[end - 1]
                    m = min(len(row), len(last))
                    differ = np.flatnonzero(row[depth:m] != last[depth:m])
                    stop = depth + int(differ[0]) if len(differ) else m
                children: list = []
                s = self.sizes[lo:end]
                into.append((depth, stop, lo, end, int(s.min()), int(s.max()), children))
                if end - lo > 1 or stop < len(row):
                    work.append((lo, end, stop, children))
                lo = end
        return top


def bag_links(sets: list[np.ndarray], label: np.ndarray, share: int = SHARE, across: np.ndarray | None = None, every: bool = False) -> list[tuple[int, int]]:
    """Links (i, j) among sets that join two components of ``label`` (changed here); with ``every``, all links.

    across: only pairs of different values count.
    """
    kinds, back, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((kinds, -often))
    rank = np.empty(len(kinds), np.int64)
    rank[order] = np.arange(len(kinds))
    ranks = np.split(rank[back], np.cumsum([len(s) for s in sets])[:-1])
    ranks = [np.sort(r) for r in ranks]
    by = sorted(range(len(sets)), key=lambda i: ranks[i].astype(">u4").tobytes())
    trie = Trie([ranks[i] for i in by])
    name = np.array(by)
    label = label[name]
    side = None if across is None else across[name]
    mark = np.zeros(len(kinds), bool)
    out = []
    for x in range(len(by)):
        own = trie.rows[x]
        nx = len(own)
        mark[own] = True
        stack = [(e, 0) for e in reversed(trie.root)]
        while stack:
            (a, b, lo, hi, least, most, children), o = stack.pop()
            if hi <= x + 1:
                continue
            if 100 * most < share * nx or 100 * nx < share * least:
                continue
            if not every and (label[max(lo, x + 1) : hi] == label[x]).all():
                continue
            if b > a:
                edge = trie.rows[lo][a:b]
                o += int(mark[edge].sum())
                left = nx - int(np.searchsorted(own, edge[-1], "right"))
            else:
                left = 0
            need = -(-share * (nx + least) // (100 + share))
            if o + min(most - b, left) < need:
                continue
            if not children:
                s = int(trie.sizes[lo])
                for y in range(max(lo, x + 1), hi):
                    if (every or label[y] != label[x]) and (side is None or side[x] != side[y]) and 100 * o >= share * (nx + s - o):
                        out.append((by[x], by[y]))
                        if label[y] != label[x]:
                            label[label == label[y]] = label[x]
            else:
                stack.extend((c, o) for c in reversed(children))
        mark[own] = False
    return out


def _joined(bags: DataFrame, share: int, across: bool) -> DataFrame:
    """Links (a, b) in the parts of bags: rows (bag, part, doc, label, side, text), dealt by bag and part; across: between different sides only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def done() -> pa.RecordBatch | None:
            if len(rows) < 2:
                return None
            docs = np.array([r[0] for r in rows], np.int64)
            sets = shingle_sets(pa.array([r[3] for r in rows], pa.string()))
            _, label = np.unique(np.array([r[1] for r in rows], np.int64), return_inverse=True)
            side = np.array([r[2] for r in rows], np.int64) if across else None
            found = bag_links(sets, label.copy(), share, side)
            if not found:
                return None
            pairs = docs[np.array(found)]
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(6)]
            for bag, part, doc, label, side, text in zip(*columns, strict=True):
                if now != (bag, part):
                    if (links := done()) is not None:
                        yield links
                    now, rows = (bag, part), []
                rows.append((doc, label, side, text))
        if (links := done()) is not None:
            yield links

    n = runtime.partitions(bags.sparkSession)
    dealt = bags.select("bag", "part", "doc", "label", "side", "text").repartition(n, "bag", "part").sortWithinPartitions("bag", "part")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _residuals(rows: DataFrame, share: int) -> DataFrame:
    """(bag, gram, doc) by what sets hold beyond their bag's leading set, and (bag, null, doc) for sets that lie in it to the share.

    rows: (bag, part, doc, lead, text), dealt by bag and part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            sets = shingle_sets(pa.array([r[2] for r in rows], pa.string()))
            lead = min((s for r, s in zip(rows, sets, strict=True) if r[1]), key=lambda s: s.tobytes())  # the same in each part
            for (doc, _, _), s in zip(rows, sets, strict=True):
                rest = np.setdiff1d(s, lead, assume_unique=True)
                least = -(-share * len(s) // 100) - (len(s) - len(rest))
                grams = pa.array(rest[: max(0, len(rest) - max(least, 1) + 1)].view(np.int64))
                if least < 1:
                    grams = pa.concat_arrays([grams, pa.nulls(1, pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array([now[0]] * len(grams), pa.int64()), grams, pa.array([doc] * len(grams), pa.int64())], ["bag", "gram", "doc"])

        for b in batches:
            for bag, part, doc, lead, text in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                if now != (bag, part):
                    yield from done()
                    now, rows = (bag, part), []
                rows.append((doc, lead, text))
        yield from done()

    n = runtime.partitions(rows.sparkSession)
    dealt = rows.select("bag", "part", "doc", "lead", "text").repartition(n, "bag", "part").sortWithinPartitions("bag", "part")
    return dealt.mapInArrow(run, "bag bigint, gram bigint, doc bigint")


def _with_text(named: DataFrame, texts: DataFrame) -> DataFrame:
    """A stored table's rows with their documents' texts. Few documents are in a bag: while their ids can be broadcast, no other text is shuffled."""
    return texts.join(F.broadcast(named) if named.count() <= BROADCAST_ROWS else named, "doc")


def _dealt(members: DataFrame, bag: int) -> DataFrame:
    """members (bag, doc, lead) with the part of each, of ``parts``; leading sets go to every part."""
    size = members.groupBy("bag").agg(F.count(F.lit(1)).alias("n")).select("bag", F.ceil(F.col("n") / F.lit(bag)).cast("int").alias("parts"))
    dealt = members.join(size, "bag")
    lead = dealt.where("lead").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.where("not lead").withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")).unionByName(lead)


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with ``label``, the component of their document so far."""
    return rows.join(found.select(F.col("id").alias("doc"), "component"), "doc", "left").withColumn("label", F.coalesce("component", "doc")).drop("component")


def _open(wide: DataFrame) -> DataFrame:
    """The labelled rows of bags that hold more than one component."""
    bags = wide.groupBy("bag").agg(F.min("label").alias("_x"), F.max("label").alias("_y")).where("_x < _y").select("bag")
    return wide.join(bags, "bag", "left_semi")


def link_components(slices: DataFrame, reps: DataFrame, known: DataFrame, share: int = SHARE, bag: int = BAG) -> DataFrame:
    """(id, component) of the documents that have a link. slices: (doc, text, slice) of distinct sets; reps: (set, doc) of each; known: links (a, b) given."""
    buckets = runtime.partitions(slices.sparkSession)
    ranks = _ranks(_questions(slices, buckets))
    grams = runtime.store(_prefixes(slices, ranks, buckets, share), "prefixes")
    leaders = grams.groupBy("gram").agg(F.min("set").alias("bag"), F.max("set").alias("_last")).where("bag < _last").select("gram", "bag")
    members = grams.join(leaders, "gram").select("bag", "set").distinct().join(reps, "set").select("bag", "doc", (F.col("bag") == F.col("set")).alias("lead"))
    texts = slices.select("doc", "text")

    dealt = runtime.store(_dealt(members, bag), "parts")
    zero = F.lit(0).cast("bigint").alias("side")
    links = runtime.store(_joined(_with_text(dealt, texts).select("bag", "part", "doc", F.col("doc").alias("label"), zero, "text"), share, False).unionByName(known), "links")
    found = runtime.store(components(links), "components")

    wide = runtime.store(_open(_labelled(dealt.where("parts > 1"), found)), "open-bags")
    if not wide.limit(1).count():
        return found
    # Smaller bags by what the sets of open bags hold beyond the leading set.
    rest = runtime.store(_residuals(_with_text(wide, texts), share).distinct(), "residuals")
    leaders = rest.where("gram is not null").groupBy("bag", "gram").agg(F.min("doc").alias("first"), F.max("doc").alias("_last")).where("first < _last").drop("_last")
    small = rest.join(leaders, ["bag", "gram"]).select(F.xxhash64("bag", "first").alias("bag"), "doc", (F.col("doc") == F.col("first")).alias("lead")).distinct()
    dealt = runtime.store(_labelled(_dealt(small, bag), found), "small-parts")
    links = runtime.store(_joined(_with_text(dealt, texts).select("bag", "part", "doc", "label", zero, "text"), share, False).unionByName(links), "links")
    found = runtime.store(components(links), "components")
    # What is still open, part by part: small bags of several parts, and the sets that lie in their leading set.
    core = rest.where("gram is null").select("bag", "doc", F.lit(False).alias("lead"))
    left = dealt.where("parts > 1 and not lead").drop("label").unionByName(_dealt(core, bag).drop("lead").withColumn("lead", F.lit(False)))
    left = runtime.store(_open(_labelled(left, found)), "open-bags")
    if not left.limit(1).count():
        return found
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    pairs = left.select("bag", "doc", "label", "part", "parts", other).where("part <> other or parts = 1")
    low, high = F.least("part", "other"), F.greatest("part", "other")
    side = F.when(F.col("parts") == 1, F.col("doc")).otherwise(F.col("part").cast("bigint")).alias("side")
    pairs = pairs.select("bag", (low * F.col("parts") + high).alias("part"), "doc", "label", side)
    # A core's parts of their own were joined only with their leading set.
    own = left.select("bag", "part", "doc", "label", zero)
    across = _joined(_with_text(runtime.store(pairs, "pairs"), texts), share, True)
    links = runtime.store(across.unionByName(_joined(_with_text(runtime.store(own, "pairs"), texts), share, False)).unionByName(links), "links")
    return runtime.store(components(links), "components")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE, bag: int = BAG) -> DataFrame:
    """(id, n_shingles, component_id) of each row."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    sized = runtime.store(set_sizes(rows, "doc", "text"), "sets")
    full = sized.where("n_shingles > 0 and doc is not null")
    with runtime.scope() as stay:
        reps = runtime.store(full.groupBy("f1", "f2").agg(F.min("doc").alias("doc")), "representatives")
        stay.append(reps)
        # Rows that share a doc_id are one document: the representatives of their sets are linked.
        twice = full.groupBy("doc").agg(F.min("f1").alias("_x"), F.max("f1").alias("_y")).where("_x < _y").select("doc")
        sets_of = full.join(twice, "doc", "left_semi").select("doc", "f1", "f2").distinct().join(reps.withColumnRenamed("doc", "rep"), ["f1", "f2"])
        least = sets_of.groupBy("doc").agg(F.min("rep").alias("a"))
        known = sets_of.join(least, "doc").where("a < rep").select("a", F.col("rep").alias("b"))
        texts = rows.join(reps.select("doc").distinct().hint("shuffle_hash"), "doc", "left_semi")
        slices = runtime.sliced(texts, "text", SLICE_BYTES, "set-slices")
        found = link_components(slices, reps.select(F.col("f1").alias("set"), "doc"), known, share, bag)
        stay.append(found)
    named = reps.join(found.withColumnRenamed("id", "doc"), "doc", "left").select("f1", "f2", F.coalesce("component", "doc").alias("component"))
    out = sized.join(named, ["f1", "f2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.when(F.col("doc").isNotNull(), F.col("component"))).otherwise(F.col("doc"))
    return out.select(F.col("doc").cast(kind).alias(id_col), "n_shingles", own.cast(kind).alias("component_id"))
