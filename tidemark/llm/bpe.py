"""BPE encoding and decoding with a contiguous rank array per word.

Method. A word is held as a row of part ids beside a row of the ranks of adjacent parts. Each
round scans the rank row for its minimum (the leftmost, if tied), deletes the boundary between
these two parts and refreshes the one or two ranks beside it, until no adjacent pair has a rank.
Words of one length are rows of one matrix, so a round runs for all of them at once; a word of
over LONG bytes is merged with a heap over a linked list instead, which gives the same parts
without a scan for each merge. Each distinct word is merged once for each worker process; the
cache of words is bounded and rebuilt when full.

Text never becomes one Python object a word: code points are classed by a table, word borders
follow from the classes, and words are looked up by a 64-bit hash of their span. The hash is made
from numbers that each worker draws for itself, so no two words can be made to share one.

Results equal those of the tokenizers library for the file that ``path`` names, special-token
strings within a text included. (Its lower-casing knows letters of newer Unicode versions than
Python's: a text with a code point that Python has no category for is given to the library.)

Defined results: a null or empty text gives no ids; ids decode to the same text; invalid UTF-8
that ids may give when decoded becomes U+FFFD; an empty table gives an empty table; input columns
besides the id and text columns are left out, so their names can't clash.
"""

from __future__ import annotations

import heapq
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import runtime
from tidemark.llm.hashing import Hasher, IntMap, ragged

#: Bytes from which on a word is merged by the heap.
LONG = 48
#: Distinct words that a worker keeps, at most; beyond it those go that were looked up once only.
CACHE_WORDS = 800_000
#: Longest word of each matrix that is merged at once; shorter words of it are padded.
WIDTHS = (2, 4, 6, 8, 10, 12, 16, 24, 32, LONG)
NONE = np.int32(2**31 - 1)
PAD = 2**31 - 2
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3

_tables: dict = {}
_coders: dict = {}


def classes() -> np.ndarray:
    """The class of each code point."""
    if "cls" not in _tables:
        kinds = np.array(list(map(unicodedata.category, map(chr, range(0x110000)))))
        first = kinds.astype("U1")
        cls = np.full(0x110000, OTHER, np.uint8)
        cls[first == "L"], cls[first == "N"] = LETTER, NUMBER
        _tables["unknown"] = kinds == "Cn"
        white = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
        cls[white] = SPACE
        _tables["cls"] = cls
        _tables["hasher"] = Hasher(0x110000, int.from_bytes(os.urandom(8), "big"))
    return _tables["cls"]


def byte_letters() -> dict[int, str]:
    """The printable stand-in for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


class Coder:
    """A byte-level BPE tokenizer file, ready to encode and decode."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int32)
        self.words_end = bool(suffix)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.uint64)
        right = np.array([vocab[b] for _, b in pairs], np.uint64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.pairs = IntMap(2 * len(pairs))
        self.pairs.add(self._key(left, right), np.arange(len(pairs)))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in letters.items()}
        size = 1 + max([*vocab.values(), *self.special.values()])
        pieces = [b""] * size
        for word, i in vocab.items():
            body = word[: -len(suffix)] if suffix and word.endswith(suffix) else word
            pieces[i] = bytes(back[c] for c in body)
        for word, i in self.special.items():
            pieces[i] = word.encode()
        self.pieces = pieces
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_off = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self._forget()

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(32)) + b.astype(np.uint64) + np.uint64(1)

    def _forget(self) -> None:
        self.words = IntMap(1 << 14)
        self.n_words = 0
        self.w_key = np.zeros(1 << 14, np.uint64)
        self.w_off = np.zeros(1 << 14, np.int64)
        self.w_len = np.zeros(1 << 14, np.int32)
        self.w_again = np.zeros(1 << 14, bool)
        self.ids = np.zeros(1 << 16, np.int32)
        self.n_ids = 0

    def _thin(self) -> None:
        """Keeps the words that were looked up again, unless they are most."""
        at = np.flatnonzero(self.w_again[: self.n_words])
        key, size = self.w_key[at], self.w_len[at]
        ids = self.ids[ragged(self.w_off[at], size)]
        self._forget()
        if len(at) <= CACHE_WORDS // 2:
            self._learn(key, size, ids)

    # --- merging -----------------------------------------------------------------------------

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = self.pairs.get(self._key(a.ravel(), b.ravel())).reshape(a.shape)
        return np.where(r < 0, NONE, r)

    def _rows(self, parts: np.ndarray, size: np.ndarray, index: np.ndarray, out: list) -> None:
        """Merges the rows of ``parts``, words of ``size`` bytes each with pads behind; (index, sizes, ids) of finished words go to ``out``."""
        rank = self.ranks(parts[:, :-1], parts[:, 1:])
        while len(parts):
            n, width = parts.shape
            if width == 1:
                out.append((index, size, parts[:, 0]))
                return
            rows = np.arange(n)
            at = rank.argmin(1)
            low = rank[rows, at]
            over = low == NONE
            if over.any():
                done = parts[over]
                out.append((index[over], size[over], done[np.arange(width) < size[over][:, None]]))
                live = ~over
                parts, rank, size, index, at, low = parts[live], rank[live], size[live], index[live], at[live], low[live]
                n = len(parts)
                rows = np.arange(n)
            parts[rows, at] = self.made[low]
            size = size - 1
            keep = np.ones((n, width), bool)
            keep[rows, at + 1] = False
            parts = parts[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), bool)
            keep[rows, at] = False
            rank = rank[keep].reshape(n, width - 2)
            left = np.flatnonzero(at > 0)
            right = np.flatnonzero(at < size - 1)
            a, b = at[left] - 1, at[right]
            fresh = self.ranks(np.concatenate([parts[left, a], parts[right, b]]), np.concatenate([parts[left, a + 1], parts[right, b + 1]]))
            rank[left, a], rank[right, b] = fresh[: len(left)], fresh[len(left) :]

    def _heap(self, parts: list[int]) -> list[int]:
        """Merges one long word."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = lambda i, j: int(self.pairs.get(self._key(np.array([parts[i]]), np.array([parts[j]])))[0])
        a = np.array(parts)
        first = self.pairs.get(self._key(a[:-1], a[1:])).tolist()
        heap = [(r, i, parts[i], parts[i + 1]) for i, r in enumerate(first) if r >= 0]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i]
            if parts[i] != x or j >= n or parts[j] != y:
                continue
            parts[i], parts[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (s := pair(p, q)) >= 0:
                    heapq.heappush(heap, (s, p, parts[p], parts[q]))
        return [p for p in parts if p >= 0]

    def merge_words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each word, all ids) of the words at these spans of bytes."""
        lengths = end - start
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        least = 0
        for width in WIDTHS:
            index = np.flatnonzero((lengths > least) & (lengths <= width))
            least = width
            if len(index):
                size = lengths[index]
                parts = np.full((len(index), width), PAD, np.int32)
                parts[np.arange(width) < size[:, None]] = self.first[data[ragged(start[index], size)]]
                parts[np.arange(len(index)), size - 1] = self.last[data[end[index] - 1]]
                self._rows(parts, size, index, done)
        for i in np.flatnonzero(lengths > LONG).tolist():
            raw = data[start[i] : end[i]]
            ids = self.first[raw]
            ids[-1] = self.last[raw[-1]]
            ids = np.array(self._heap(ids.tolist()), np.int32)
            done.append((np.array([i]), np.array([len(ids)]), ids))
        count = np.zeros(len(lengths), np.int64)
        for index, size, _ in done:
            count[index] = size
        offset = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.int32)
        for index, size, ids in done:
            flat[ragged(offset[index], size)] = ids
        return count, flat

    # --- words -------------------------------------------------------------------------------

    def _starts(self, cp: np.ndarray, cls: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Where a word or a run of white space begins. new: True at the first character of each text."""
        n = len(cp)
        begin = new.copy()
        begin[1:] |= cls[1:] != cls[:-1]
        start = begin.copy()
        gap = np.flatnonzero(begin & ~new & (cls != SPACE))
        gap = gap[cls[gap - 1] == SPACE] if len(gap) else gap
        if self.words_end:
            start |= cls == NUMBER
        else:
            start[gap - 1] = True
            start[gap[cp[gap - 1] == 0x20]] = False
        p = np.flatnonzero((cp[: n - 1] == 0x27) & start[: n - 1] & begin[1:] & ~new[1:])
        p = p[cls[p + 1] == LETTER] if len(p) else p
        if len(p):
            one = cp[p + 1]
            has = p + 2 < n
            two = np.where(has, cp[np.minimum(p + 2, n - 1)], 0)
            two[has & new[np.minimum(p + 2, n - 1)]] = 0
            short = np.isin(one, [ord(c) for c in "stmd"])
            wide = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            ok = short | wide
            p, size = p[ok], np.where(short[ok], 1, 2)
            start[p + 1] = False
            end = p + 1 + size
            start[end[end < n]] = True
        return np.flatnonzero(start)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) over all texts."""
        if self.words_end:
            odd = {i: t for i, t in enumerate(texts) if not t.isascii() and newer(t)}
            if odd:
                return self._by_library(texts, odd)
            texts = [normal(t) if not any(s in t for s in self.special) else t for t in texts]
        odd = {i: t for i, t in enumerate(texts) if "<|" in t and any(s in t for s in self.special)}
        if odd:
            return self._with_special(texts, odd)
        return self._plain(texts)

    def _by_library(self, texts: list[str], odd: dict[int, str]) -> tuple[np.ndarray, np.ndarray]:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.path)
        off, ids = self.encode([t for i, t in enumerate(texts) if i not in odd])
        plain = iter(np.split(ids, off[1:-1]) if len(off) > 1 else [])
        rows = [np.array(library.encode(t, add_special_tokens=False).ids, np.int32) if i in odd else next(plain) for i, t in enumerate(texts)]
        return np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows)

    def _with_special(self, texts: list[str], odd: dict[int, str]) -> tuple[np.ndarray, np.ndarray]:
        parts: list[str] = []
        owner: list[tuple[int, int]] = []  # the text, and the special id that follows the part
        for i, t in enumerate(texts):
            if i not in odd:
                parts.append(t)
                owner.append((i, -1))
                continue
            while True:
                where = [(t.find(s), s) for s in self.special if s in t]
                at, s = min(where, default=(len(t), ""))
                parts.append(normal(t[:at]) if self.words_end else t[:at])
                owner.append((i, self.special.get(s, -1)))
                if not s:
                    break
                t = t[at + len(s) :]
        off, ids = self._plain(parts)
        rows: list[list] = [[] for _ in texts]
        for k, (i, after) in enumerate(owner):
            rows[i].append(ids[off[k] : off[k + 1]])
            if after >= 0:
                rows[i].append(np.array([after], np.int32))
        joined = [np.concatenate(r) for r in rows]
        lengths = np.array([len(r) for r in joined], np.int64)
        return np.concatenate([[0], np.cumsum(lengths)]), np.concatenate(joined)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cls_of = classes()
        whole = "".join(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        border = np.concatenate([[0], np.cumsum(lengths)])
        n = len(whole)
        if not n:
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32)
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        new = np.zeros(n, bool)
        new[border[:-1][lengths > 0]] = True
        cls = cls_of[cp]
        start = self._starts(cp, cls, new)
        end = np.append(start[1:], n)
        if self.words_end:
            keep = cls[start] != SPACE
            start, end = start[keep], end[keep]
        keys = _tables["hasher"].spans(cp, start, end)
        if self.n_words > CACHE_WORDS:
            self._thin()
        at = self.words.get(keys)
        miss = np.flatnonzero(at < 0)
        self.w_again[at[at >= 0]] = True
        if len(miss):
            fresh, first = np.unique(keys[miss], return_index=True)
            first = miss[first]
            data = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
            place = np.arange(n + 1) if len(data) == n else np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
            self._learn(fresh, *self.merge_words(data, place[start[first]], place[end[first]]))
            at[miss] = self.words.get(keys[miss])
        size = self.w_len[at].astype(np.int64)
        ids = self.ids[ragged(self.w_off[at], size)]
        upto = np.concatenate([[0], np.cumsum(size)])
        return upto[np.searchsorted(start, border)], ids

    def _learn(self, keys: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        k, m = self.n_words, self.n_ids
        for name, need in (("w_key", k + len(keys)), ("w_off", k + len(keys)), ("w_len", k + len(keys)), ("w_again", k + len(keys)), ("ids", m + len(flat))):
            a = getattr(self, name)
            if need > len(a):
                setattr(self, name, np.concatenate([a, np.zeros(max(len(a), need - len(a)), a.dtype)]))
        new = slice(k, k + len(keys))
        self.w_key[new], self.w_len[new], self.w_again[new] = keys, size, False
        self.w_off[new] = m + np.cumsum(size) - size
        self.ids[m : m + len(flat)] = flat
        self.words.add(keys, np.arange(k, k + len(keys)))
        self.n_words, self.n_ids = k + len(keys), m + len(flat)

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """The text of each run of ids; an id outside the vocabulary gives nothing."""
        ids = ids.astype(np.int64)
        known = (ids >= 0) & (ids < len(self.piece_len))
        safe = np.where(known, ids, 0)
        size = np.where(known, self.piece_len[safe], 0)
        data = self.piece_bytes[ragged(self.piece_off[safe], size)].tobytes()
        upto = np.concatenate([[0], np.cumsum(size)])[offsets].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(upto[:-1], upto[1:], strict=True)]


def normal(text: str) -> str:
    """Lower case without the rule for a final sigma, in composed form."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()


def newer(text: str) -> bool:
    """Whether Python's Unicode tables lack one of its code points."""
    classes()
    return bool(_tables["unknown"][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())


def coder(path: str) -> Coder:
    """The worker's coder for a file."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) for each row."""
    docs = df.select(F.col(id_col), F.col(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in runtime.slices(batches, text_col):
            texts = b.column(1).to_pylist()
            off, ids = c.encode([t or "" for t in texts])
            yield pa.RecordBatch.from_arrays([b.column(0), runtime.list_array(off, ids, pa.int32())], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with the column ``decoded``, the text that their ids stand for. A null list decodes to an empty text."""
    names = [c for c in df.columns if c != "decoded"]
    kept = df.select(*names)
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                lists = b.column(at)
                size = np.array(lists.value_lengths().fill_null(0)).astype(np.int64)
                texts = c.decode(np.concatenate([[0], np.cumsum(size)]), np.array(lists.flatten().fill_null(-1)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, decoded string")
