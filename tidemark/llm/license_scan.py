"""License scans: fuzzy search for short notices.

Method. A notice of m characters may differ by k = m // EDIT_STEP edits. It is cut into k + 1
pieces; by the pigeonhole principle every match within k edits holds one piece unchanged, so exact
occurrences of the pieces are the only candidates. They are found with one Aho-Corasick pass over
the normal form of the text (its words, joined by single blanks). Around each candidate the regex
library searches ``(?b)(?:notice){e<=k}`` in a window that a match cannot leave, which verifies the
edits and gives the span. Windows of one notice that touch are searched as one, and again before
and after each match, since the first one found is the best and not the leftmost.

The base phrases are found exactly, on word borders, besides. Spans are in words.

Defined results: a null or empty text has no words, no labels and score 0; overlapping places of a
phrase all count; very long texts are searched whole; repeated rows give repeated rows; an empty
table gives an empty table; other input columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import runtime

#: Phrases found exactly (fixed by the contract), and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short notices found within edits, and their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "general public license": "gpl",
    "creative commons attribution": "cc-by",
    "this work is in the public domain": "public-domain",
    "eclipse public license": "epl",
    "spdx license identifier": "spdx",
    "all rights reserved": "reserved",
    "released under the mit license": "mit",
    "released under cc by": "cc-by",
}

#: Characters of a notice for each edit allowed.
EDIT_STEP = 9

#: Bytes of words: digits, a to z, and all of UTF-8 beyond ASCII.
_WORD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


class Scanner:
    def __init__(self, notices: dict[str, str], step: int) -> None:
        self.notices = list(notices.items())
        self.edits = [len(n) // step for n, _ in self.notices]
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n, literal_spaces=True)}){{e<={k}}}") for (n, _), k in zip(self.notices, self.edits, strict=True)]
        self.seeds = ahocorasick.Automaton()
        for i, ((n, _), k) in enumerate(zip(self.notices, self.edits, strict=True)):
            cuts = [len(n) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                known = self.seeds.get(n[a:b], [])
                self.seeds.add_word(n[a:b], [*known, (i, a, b)])
        self.seeds.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) of the matches in a normal form."""
        wide: dict[int, list[tuple[int, int]]] = {}
        for end, seeds in self.seeds.iter(text):
            for i, a, b in seeds:
                start = end + 1 - (b - a)
                k, m = self.edits[i], len(self.notices[i][0])
                lo, hi = max(0, start - a - k), min(len(text), start - a + m + k)
                runs = wide.setdefault(i, [])
                while runs and lo <= runs[-1][1]:
                    before = runs.pop()
                    lo, hi = min(lo, before[0]), max(hi, before[1])
                runs.append((lo, hi))
        out = []
        for i, runs in wide.items():
            while runs:
                lo, hi = runs.pop()
                if m := self.patterns[i].search(text, lo, hi):
                    out.append((i, m.start(), m.end(), sum(m.fuzzy_counts)))
                    runs += (lo, m.start()), (m.end(), hi)
        return sorted(out, key=lambda x: (x[1], x[0]))


def words_of(text: str) -> tuple[int, str]:
    """The number of words, and the words joined by blanks."""
    words = text.encode("utf-8", "surrogatepass").translate(_WORD).split(b" ")
    words = [w for w in words if w]
    return len(words), b" ".join(words).decode("utf-8", "surrogatepass")


def word_places(normal: str, at: list[int]) -> list[int]:
    """The number of the word that stands at each place of a normal form."""
    if not at:
        return []
    blanks = np.flatnonzero(np.frombuffer(normal.encode("utf-32-le", "surrogatepass"), np.uint32) == 0x20)
    return np.searchsorted(blanks, at).tolist()


def base_places(normal: str, phrases: dict[str, str]) -> list[tuple[int, int, str]]:
    """(word, words, label) for each place where a phrase's words stand."""
    padded = f" {normal} "
    found = []
    for phrase, label in phrases.items():
        at = padded.find(f" {phrase} ")
        while at >= 0:
            found.append((at, phrase.count(" ") + 1, label))
            at = padded.find(f" {phrase} ", at + 1)
    return [(word, k, label) for word, (_, k, label) in zip(word_places(normal, [at for at, _, _ in found]), found, strict=True)]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, notices: dict[str, str] | None = None, edit_step: int = EDIT_STEP) -> DataFrame:
    """Per row: the id, n_words, base (array of word, words, label) and spans (array of label, word, n_words, edits, matched text, similarity)."""
    base = BASE if base is None else base
    notices = NOTICES if notices is None else notices
    docs = df.select(F.col(id_col), F.col(text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    base_t = pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("label", pa.string())]))
    span_t = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64()), ("edits", pa.int64()), ("matched", pa.string()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, edit_step)
        for b in runtime.slices(batches, text_col):
            n_words, bases, spans = [], [], []
            for text in b.column(1).to_pylist():
                n, normal = words_of(text or "")
                n_words.append(n)
                bases.append([{"word": w, "words": k, "label": label} for w, k, label in base_places(normal, base)])
                rows = []
                found = scanner.spans(normal)
                for (i, lo, hi, edits), word in zip(found, word_places(normal, [x[1] for x in found]), strict=True):
                    notice, label = scanner.notices[i]
                    rows.append({"label": label, "word": word, "words": normal.count(" ", lo, hi) + 1, "edits": edits, "matched": normal[lo:hi], "similarity": 1 - edits / len(notice)})
                spans.append(rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(bases, base_t), pa.array(spans, span_t)], [id_col, "n_words", "base", "spans"])

    schema = f"`{id_col}` {kind}, n_words bigint, base array<struct<word:bigint,words:bigint,label:string>>, spans array<struct<label:string,word:bigint,words:bigint,edits:bigint,matched:string,similarity:double>>"
    return docs.mapInArrow(run, schema)
