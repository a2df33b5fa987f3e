"""Language-model scoring by context-tree weighting over bytes, beside a unigram score.

Method. A byte is eight binary decisions, each with its own context tree over the DEPTH bytes
before it. A node estimates its bit by Krichevsky-Trofimov (KT) from the zeros and ones seen there;
its weighted probability is half its own estimate, half the product of its children's. A bit's
probability is the mixture along the path from the root: at each node its own KT estimate, and for
the rest the node one byte deeper. A context never seen has no counts, so its KT estimate is one
half. A text is DEPTH starts, its bytes, and one end (byte 255, which UTF-8 doesn't use).

Everything but the top of the trees stays in tables. Documents travel in slices of bounded size. A
slice asks once for each distinct (DEPTH+1)-gram and word that it holds, and says how often its
training rows hold it, packed by bucket: grams are dealt by the two bytes before the last, so a
bucket has all subtrees below such a pair. The buckets' counts are the sums of what the slices
say. The subtrees' products meet at depth 1 (at most 255 * 256 sums) and at the root, which are
all that reaches the driver. Then each bucket answers its slices: the log probability of each gram
asked, seen or not, and the count of each word. Answers meet their slice, and each row is scored
there by itself. A pair of bytes holds at most 2**24 grams, whatever the corpus; buckets that are
fewer than the tasks are copied, each copy for its part of the slices, so a frequent pair or word is
one question a slice and spread over copies.

Defined results: a null or empty text is one end and scores as such; rows that repeat a doc_id, and
rows without one, are scored each (a null id's fold is that of the empty text); an empty table
gives an empty table; without training text every bit has probability one half; other input
columns are left out.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import runtime
from tidemark.llm.hashing import Hasher, IntMap, mix
from tidemark.llm.ngram_join import _LOWER, word_spans

DEPTH = 4
END = 255
#: Text of a slice, and text that is worked on at a time.
SLICE = 8 << 20
CHUNK = 1 << 20
#: Buckets of grams and of words, at most (and at most one a task).
GRAM_BUCKETS = 256
WORD_BUCKETS = 2048
U = np.uint64


def held_out(id_col: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "utf-8")), F.lit(folds)) == fold


def is_held_out(doc_id: int | None, folds: int = 7, fold: int = 2) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == fold


# --- what a slice holds -------------------------------------------------------------------------


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the (DEPTH+1)-gram ending at each byte and end of each text, offsets of the texts in it)."""
    offsets, data = runtime.utf8(column)
    n = np.diff(offsets)
    wide = n + DEPTH + 1
    first = np.cumsum(wide) - wide
    buffer = np.full(int(wide.sum()), END, np.uint64)
    place = np.arange(len(data)) + np.repeat(first + DEPTH - offsets[:-1], n)
    buffer[place] = data
    code = np.zeros(len(buffer), np.uint64)
    for k in range(DEPTH + 1):
        code[DEPTH:] |= buffer[DEPTH - k : len(buffer) - k] << U(8 * k)
    keep = np.ones(len(buffer), bool)
    for k in range(DEPTH):
        keep[first + k] = False
    return code[keep], np.concatenate([[0], np.cumsum(n + 1)])


def word_hashes(column: pa.Array, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, document of each) of lower-cased words."""
    offsets, data = runtime.utf8(column)
    start, end, doc = word_spans(offsets, data)
    return hasher.spans(_LOWER[data], start, end), doc


def _gram_bucket(g: np.ndarray, buckets: int) -> np.ndarray:
    return (mix((g >> U(8)) & U(0xFFFF)) % U(buckets)).astype(np.int64)


def _word_bucket(w: np.ndarray, buckets: int) -> np.ndarray:
    return (w % U(buckets)).astype(np.int64)


_ASKED = "bucket int, copy int, slice bigint, keys binary, counts binary"


def questions(rows: DataFrame, hasher: Hasher, gram_buckets: int, word_buckets: int) -> DataFrame:
    """(bucket, copy, slice, keys, counts): the distinct grams and words of each slice and how often its training rows hold them.

    rows: text, _train, _slice. Buckets of words come after those of grams.
    """
    tasks = runtime.partitions(rows.sparkSession)
    copies = max(1, -(-tasks // gram_buckets)), max(1, -(-tasks // word_buckets))

    def counted(column: pa.Array, train: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(distinct keys, how often training rows hold them) of grams and of words. Two sorts of plain numbers are cheaper than one with the places."""
        g, offsets = grams(column)
        w, doc = word_hashes(column, hasher)
        out = []
        for keys, on in ((g, np.repeat(train, np.diff(offsets))), (w, train[doc])):
            own = np.unique(keys)
            seen, n = np.unique(keys[on], return_counts=True)
            count = np.zeros(len(own), np.int64)
            count[np.searchsorted(own, seen)] = n
            out.append((own, count))
        return out

    def asked(number: int, parts: list) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for (part, bucket_of, buckets, base, many) in zip(zip(*parts, strict=True), (_gram_bucket, _word_bucket), (gram_buckets, word_buckets), (0, gram_buckets), copies, strict=True):
            keys, count = _merged(*(np.concatenate(c) for c in zip(*part, strict=True)))
            for k, at in runtime.dealt(keys, bucket_of(keys, buckets), buckets):
                found.append((base + k, number % many, number, runtime.planes(keys[at]), runtime.planes(count[at])))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], ["bucket", "copy", "slice", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for chunk in runtime.slices(batches, "text", CHUNK):
            number = chunk.column(2).to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]]))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if parts and now != int(number[a]):
                    yield from asked(now, parts)
                    parts = []
                now = int(number[a])
                parts.append(counted(chunk.column(0).slice(a, b - a), chunk.column(1).slice(a, b - a).to_numpy(zero_copy_only=False)))
        if parts:
            yield from asked(now, parts)

    return rows.select("text", "_train", runtime.SLICE).mapInArrow(run, _ASKED)


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sums of their counts)."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The same of packed keys and counts, without those that sum to nothing."""
    keys, counts = runtime.all_numbers(table["keys"].to_pylist(), np.uint64), runtime.all_numbers(table["counts"].to_pylist(), np.int64)
    return _merged(keys[counts > 0], counts[counts > 0])


def counts(asked: DataFrame) -> DataFrame:
    """(bucket, distinct, total, keys, counts): the training counts of each bucket, summed by copy and then by bucket."""

    def part(key, table):
        keys, n = _summed(table)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([runtime.planes(keys)], pa.binary()), "counts": pa.array([runtime.planes(n)], pa.binary())})

    def whole(key, table):
        keys, n = _summed(table)
        cells = [key[0].as_py()], [len(keys)], [int(n.sum())], [runtime.planes(keys)], [runtime.planes(n)]
        kinds = pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()
        return pa.table([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["bucket", "distinct", "total", "keys", "counts"])

    parts = asked.groupBy("bucket", "copy").applyInArrow(part, "bucket int, keys binary, counts binary")
    return parts.groupBy("bucket").applyInArrow(whole, "bucket int, distinct bigint, total bigint, keys binary, counts binary")


# --- weighting ----------------------------------------------------------------------------------


def _stirling(x: np.ndarray) -> np.ndarray:
    """log Gamma(x) by Stirling's series, shifted up by 8."""
    shift = np.zeros_like(x)
    for _ in range(8):
        shift += np.log(x)
        x = x + 1
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    zeros, ones = np.asarray(zeros, np.float64), np.asarray(ones, np.float64)
    return _stirling(zeros + 0.5) + _stirling(ones + 0.5) - math.log(math.pi) - _stirling(zeros + ones + 1)


def _weighted(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, children) - math.log(2)


def _mixed(log_beta: np.ndarray, own: np.ndarray, below: np.ndarray) -> np.ndarray:
    share = 1 / (1 + np.exp(-np.clip(log_beta, -700, 700)))
    return share * own + (1 - share) * below


def _nodes(gram: np.ndarray, bit: int, depth: int) -> np.ndarray:
    """Keys of the nodes at a depth that decide a bit of each gram's last byte: the context, and the byte's bits before."""
    node = (1 << bit) | ((gram & 0xFF) >> (8 - bit))
    return ((gram >> 8) & ((1 << 8 * depth) - 1)) << 8 | node


class Subtrees:
    """The nodes of depths 2 to DEPTH over the grams of a bucket, for one bit position."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, bit: int) -> None:
        one = (gram >> (7 - bit)) & 1
        self.keys: dict[int, np.ndarray] = {}
        self.zeros: dict[int, np.ndarray] = {}
        self.ones: dict[int, np.ndarray] = {}
        self.beta: dict[int, np.ndarray] = {}
        keys, at = np.unique(_nodes(gram, bit, DEPTH), return_inverse=True)
        ones = np.bincount(at, n * one, len(keys))
        zeros = np.bincount(at, n, len(keys)) - ones
        weighted = None
        for depth in range(DEPTH, 1, -1):
            own = log_kt(zeros, ones)
            children = np.zeros(len(keys)) if weighted is None else below
            self.keys[depth], self.zeros[depth], self.ones[depth], self.beta[depth] = keys, zeros, ones, own - children
            weighted = own if weighted is None else _weighted(own, children)
            if depth > 2:
                up, at = np.unique((keys >> 8 & ((1 << 8 * (depth - 1)) - 1)) << 8 | (keys & 0xFF), return_inverse=True)
                zeros, ones, below = (np.bincount(at, c, len(up)) for c in (zeros, ones, weighted))
                keys = up
        self.top = keys, zeros, ones, weighted

    def bit_probability(self, gram: np.ndarray, bit: int) -> np.ndarray:
        """Of a one, by the subtree below the two last bytes of each gram's context: whether it was seen, and the probability."""
        p = np.full(len(gram), 0.5)
        for depth in range(DEPTH, 1, -1):
            keys = self.keys[depth]
            wanted = _nodes(gram, bit, depth)
            at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
            on = np.flatnonzero(keys[at] == wanted) if len(keys) else np.zeros(0, np.int64)
            at = at[on]
            own = (self.ones[depth][at] + 0.5) / (self.zeros[depth][at] + self.ones[depth][at] + 1)
            q = np.full(len(gram), 0.5)
            q[on] = own if depth == DEPTH else _mixed(self.beta[depth][at], own, p[on])
            p = q
        return p


def _of_bucket(cells: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return runtime.all_numbers(cells["keys"].to_pylist(), np.uint64).astype(np.int64), runtime.all_numbers(cells["counts"].to_pylist(), np.int64).astype(np.float64)


def tops(model: DataFrame) -> dict[str, np.ndarray]:
    """By last byte of the context and binary node, and at the root by node: zeros, ones and log odds of the node's own estimate."""

    def run(key, table):
        gram, n = _of_bucket(table)
        rows = []
        for bit in range(8):
            keys, *values = Subtrees(gram, n, bit).top
            up, at = np.unique((keys >> 8 & 0xFF) << 8 | (keys & 0xFF), return_inverse=True)
            rows.append([up, *[np.bincount(at, v, len(up)) for v in values]])
        merged = [np.concatenate(c) for c in zip(*rows, strict=True)]
        return pa.table([pa.array(merged[0], pa.int64()), *[pa.array(c, pa.float64()) for c in merged[1:]]], names=["node", "zeros", "ones", "weighted"])

    found = model.groupBy("bucket").applyInArrow(run, "node bigint, zeros double, ones double, weighted double")
    got = found.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")]).toArrow()  # at most 256 * 255 rows
    node = got["node"].to_numpy()
    order = np.argsort(node)
    node, zeros, ones, below = node[order], *[got[c].to_numpy()[order] for c in ("zeros", "ones", "weighted")]
    full = {k: np.zeros(1 << 16) for k in ("zeros", "ones", "beta")}
    own = log_kt(zeros, ones)
    full["zeros"][node], full["ones"][node], full["beta"][node] = zeros, ones, own - below
    root = {k: np.bincount(node & 0xFF, v, 256) for k, v in (("zeros", zeros), ("ones", ones), ("below", _weighted(own, below)))}
    beta = log_kt(root["zeros"], root["ones"]) - root["below"]
    return {**full, "root_zeros": root["zeros"], "root_ones": root["ones"], "root_beta": beta}


def log_probabilities(asked: np.ndarray, gram: np.ndarray, n: np.ndarray, top: dict[str, np.ndarray]) -> np.ndarray:
    """Natural log probability of the last byte of each gram asked, given the bytes before it; gram, n: the bucket's counts."""
    asked = asked.astype(np.int64)
    out = np.zeros(len(asked))
    for bit in range(8):
        p = Subtrees(gram, n, bit).bit_probability(asked, bit)
        node = (1 << bit) | ((asked & 0xFF) >> (8 - bit))
        last = (asked >> 8 & 0xFF) << 8 | node
        zeros, ones = top["zeros"][last], top["ones"][last]
        p = np.where(zeros + ones > 0, _mixed(top["beta"][last], (ones + 0.5) / (zeros + ones + 1), p), 0.5)
        zeros, ones = top["root_zeros"][node], top["root_ones"][node]
        p = np.where(zeros + ones > 0, _mixed(top["root_beta"][node], (ones + 0.5) / (zeros + ones + 1), p), 0.5)
        out += np.log(np.where((asked >> (7 - bit)) & 1, p, 1 - p))
    return out


def answers(asked: DataFrame, model: DataFrame, top: dict[str, np.ndarray], gram_buckets: int, word_buckets: int) -> DataFrame:
    """(slice, kind, keys, values): log probabilities of grams (kind 0) and counts of known words (kind 1), for each slice and bucket."""
    shared = asked.sparkSession.sparkContext.broadcast(top)  # 3 * 2**16 numbers
    tasks = runtime.partitions(asked.sparkSession)
    copies = F.when(F.col("bucket") < gram_buckets, max(1, -(-tasks // gram_buckets))).otherwise(max(1, -(-tasks // word_buckets)))
    schema = pa.schema([("slice", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("values", pa.binary())])

    def run(key, questions, bucket):
        if not questions.num_rows:
            return schema.empty_table()
        keys = [runtime.numbers(k, np.uint64) for k in questions["keys"].to_pylist()]
        wanted, at = np.unique(np.concatenate(keys), return_inverse=True)
        parts = np.split(at, np.cumsum([len(k) for k in keys])[:-1])
        if key[0].as_py() < gram_buckets:
            kind, found = 0, log_probabilities(wanted, *_of_bucket(bucket), shared.value).astype(np.float32)
            told = [(runtime.planes(k), runtime.planes(found[p])) for k, p in zip(keys, parts, strict=True)]
        else:
            words, n = runtime.all_numbers(bucket["keys"].to_pylist(), np.uint64), runtime.all_numbers(bucket["counts"].to_pylist(), np.int64)
            if not len(words):
                return schema.empty_table()
            where = np.minimum(np.searchsorted(words, wanted), len(words) - 1)
            kind, found = 1, np.where(words[where] == wanted, n[where], 0)
            told = [(runtime.planes(k[found[p] > 0]), runtime.planes(found[p][found[p] > 0])) for k, p in zip(keys, parts, strict=True)]
        cells = questions["slice"].combine_chunks(), pa.array([kind] * len(keys), pa.int32()), *[pa.array(c, pa.binary()) for c in zip(*told, strict=True)]
        return pa.table(list(cells), schema=schema)

    told = model.select("bucket", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"), "keys", "counts")
    return asked.groupBy("bucket", "copy").cogroup(told.groupBy("bucket", "copy")).applyInArrow(run, "slice bigint, kind int, keys binary, values binary")


class Told:
    """The answers to a slice, by key."""

    def __init__(self, table: pa.Table, kind: int) -> None:
        on = (table["kind"].to_numpy() == kind).tolist()
        keys, values = ([c for c, ok in zip(table[n].to_pylist(), on, strict=True) if ok] for n in ("keys", "values"))
        keys, first = np.unique(runtime.all_numbers(keys, np.uint64), return_index=True)
        self.values = np.append(runtime.all_numbers(values, np.int64 if kind else np.float32)[first].astype(np.float64), 0.0)
        self.map = IntMap(max(16, 2 * len(keys)))
        self.map.add(keys + U(kind == 0), np.arange(len(keys)))  # a gram may be 0

    def grams(self, keys: np.ndarray) -> np.ndarray:
        return self.values.take(self.map.get(keys + U(1)))

    def words(self, keys: np.ndarray) -> np.ndarray:
        """Their counts, 0 for those that aren't known."""
        return self.values.take(self.map.get(keys))


# --- scores -------------------------------------------------------------------------------------


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, slice_bytes: int = SLICE) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each row; the rows of the held-out fold aren't learned from."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (~held_out(F.col(id_col), folds, fold)).alias("_train"))
    rows = runtime.sliced(rows, "text", slice_bytes, "ctw-slices")
    tasks = runtime.partitions(spark)
    gram_buckets, word_buckets = min(tasks, GRAM_BUCKETS), min(tasks, WORD_BUCKETS)
    seed = int.from_bytes(os.urandom(8), "big")
    asked = runtime.store(questions(rows, Hasher(256, seed), gram_buckets, word_buckets), "ctw-questions")
    model = runtime.store(counts(asked), "ctw-counts")
    n_train = rows.where("_train").count()
    sums = model.where(F.col("bucket") >= gram_buckets).agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).first()
    n, v = (sums["n"] or 0) + n_train, (sums["v"] or 0) + (1 if n_train else 0)
    top = tops(model.where(F.col("bucket") < gram_buckets))
    told = answers(asked, model, top, gram_buckets, word_buckets)
    per, end_log, known_end = math.log10(n + v + 1), math.log10(n_train + 1), int(n_train > 0)

    def run(key, docs, told):
        gram_of, word_of = Told(told, 0), Told(told, 1)
        hasher = runtime.once(f"words {seed}", lambda: Hasher(256, seed))
        out = []
        for b in runtime.slices(docs.select([0, 1]).combine_chunks().to_batches(), "text", CHUNK):
            g, offsets = grams(b.column(1))
            logp = np.concatenate([[0.0], np.cumsum(gram_of.grams(g))])
            total = (logp[offsets[1:]] - logp[offsets[:-1]]) / math.log(10)
            h, doc = word_hashes(b.column(1), hasher)
            c = word_of.words(h)
            m = b.num_rows
            tokens = np.bincount(doc, minlength=m) + 1
            n_known = np.bincount(doc, c > 0, m).astype(np.int64) + known_end
            base = np.bincount(doc, np.log10(c + 1), m) + end_log - tokens * per
            out.append(pa.table([b.column(0), pa.array(tokens.astype(np.int64)), pa.array(n_known), pa.array(base), pa.array(total), pa.array(-total * math.log2(10) / np.diff(offsets))], names=["id", "n_tokens", "n_known", "base", "score", "bits_per_byte"]))
        return pa.concat_tables(out)

    schema = f"id {kind.simpleString()}, n_tokens bigint, n_known bigint, base double, score double, bits_per_byte double"
    scored = rows.groupBy(runtime.SLICE).cogroup(told.groupBy("slice")).applyInArrow(run, schema)
    return scored.select(
        F.col("id").alias(id_col),
        held_out(F.col("id"), folds, fold).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("bigint").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
        "bits_per_byte",
    )
