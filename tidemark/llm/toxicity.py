"""Toxicity by weak supervision.

Method. Many voters look at a text: one for each insult of a lexicon (whole words, A-Z lower-cased),
the same lexicon after undoing digit-for-letter spelling, patterns (masked words, shouting,
exclamations, direct address), and word stems in any language: prefixes that take up a share of a
text's words. The labels of the training rows choose the voters (stems greedily by what they add,
and of all voters those that vote on CHOSEN rows of label 1 at least, and on thrice as many as of
label 0) and give the share of class 1; they take no part in the label model itself.

The label model is generative: a text has a hidden class; a voter that fires has an accuracy, the
share of class 1 where it does, and otherwise abstains, which says nothing; texts without any vote
have a share of class 1 of their own. Votes are correlated within a class: the model estimates the
matrix of correlations R of what the classes leave unexplained, and weighs the voters' evidence by
R^-1 1, as for correlated measurements. All this is fitted by expectation-maximisation from the
votes, beginning with "any vote" as class. Its posterior labels train a linear classifier
(logistic, L2) on the counts of the voters and on hashed words, so words that keep company with
insults add to the score. Scores use the text alone.

The model is fitted on at most MAX_TRAIN labelled rows of the training folds, the smallest by a
hash of their id; everything is scored.

Defined results: a null or empty text scores what no words and no votes give; rows that repeat a
doc_id are scored each and learned from each (MAX_TRAIN rows in all, however often an id repeats);
without usable labels the lexicon alone scores; an empty table gives an empty table; other input
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import runtime
from tidemark.llm.ctw import held_out
from tidemark.llm.hashing import Hasher, IntMap

MAX_TRAIN = 12_000
BINS = 1 << 14
THRESHOLD = 0.3
#: Bytes of a stem; the share of a text's words from which it votes; the gain that a mined stem must bring; stems at most.
STEMS = (4, 5, 6, 7, 8)
DENSITY = 0.006
GAIN = 8
MAX_STEMS = 200
#: Rows of label 1 that a voter of the label model must vote on.
CHOSEN = 8
#: Accuracy that voters are taken to have before anything is known, and the votes that this counts for.
ACCURACY, STRENGTH = 0.85, 4.0
FOLDS, FOLD = 4, 2

#: Common English insults.
LEXICON = (
    "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass fool fools foolish imbecile cretin dimwit halfwit "
    "loser losers clown clowns pathetic worthless useless disgusting disgusted scum scumbag trash garbage filth filthy vermin "
    "pig pigs rat rats coward cowards creep creeps freak freaks jerk jerks bastard bastards bitch asshole shit crap damn hell "
    "hate hated hateful ugly fat sick repulsive vile despicable contemptible wretch wretched degenerate parasite maggot"
).split()

PATTERNS = ("respelled", "masked", "shouting", "exclaiming", "addressing", "swearing signs")
VOTERS = len(LEXICON) + len(PATTERNS)

_WORD = np.zeros(256, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _WORD[_b] = _b
for _b in range(0x41, 0x5B):
    _WORD[_b] = _b + 32
_LEET = _WORD.copy()
for _a, _b in zip("013457@$!", "oieastasi", strict=True):
    _LEET[ord(_a)] = ord(_b)
HASHER = Hasher(256, 1234)


def _spans(chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the runs of nonzero bytes."""
    n = len(chars)
    solid = chars > 0
    new = np.zeros(n + 1, bool)
    new[offsets] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | new[1:n]
    end[:-1] &= ~solid[1:] | new[1:n]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def _words(chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the runs of nonzero bytes."""
    start, end, doc = _spans(chars, offsets)
    return HASHER.spans(chars, start, end), doc


def _stems(chars: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the first bytes of the words that have so many."""
    start, end, doc = _spans(chars, offsets)
    on = end - start >= size
    return HASHER.spans(chars, start[on], start[on] + size), doc[on]


def _hash_of(words: list[str]) -> np.ndarray:
    text = " ".join(words).encode()
    chars = _WORD[np.frombuffer(text, np.uint8)]
    return _words(chars, np.array([0, len(text)]))[0]


_lexicon: list[IntMap] = []


def lexicon() -> IntMap:
    if not _lexicon:
        found = IntMap(4 * len(LEXICON))
        found.add(_hash_of(LEXICON), np.arange(len(LEXICON)))
        _lexicon.append(found)
    return _lexicon[0]


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(votes as counts [docs, VOTERS], document and bin of each word, words of each document)."""
    offsets, data = runtime.utf8(column)
    m = len(offsets) - 1
    votes = np.zeros((m, VOTERS), np.float64)
    h, doc = _words(_WORD[data], offsets)
    at = lexicon().get(h)
    hit = at >= 0
    np.add.at(votes, (doc[hit], at[hit]), 1)
    words = np.bincount(doc, minlength=m)
    k = len(LEXICON)
    plain = np.bincount(doc[hit], minlength=m)
    leet = _LEET[data]
    if (leet != _WORD[data]).any():
        h2, doc2 = _words(leet, offsets)
        votes[:, k] = np.maximum(0, np.bincount(doc2[lexicon().get(h2) >= 0], minlength=m) - plain)
    per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    star = data == ord("*")
    masked = np.zeros(len(data), bool)
    if len(data) > 2:
        masked[1:-1] = star[1:-1] & star[2:] & (_WORD[data[:-2]] > 0)
    votes[:, k + 1] = per(masked)
    upper, lower = per((data >= 0x41) & (data <= 0x5A)), per((data >= 0x61) & (data <= 0x7A))
    votes[:, k + 2] = upper > np.maximum(20, lower)
    bang = data == ord("!")
    double = np.zeros(len(data), bool)
    if len(data) > 1:
        double[1:] = bang[1:] & bang[:-1]
    votes[:, k + 3] = per(double)
    you = np.isin(h, _hash_of(["you", "your", "youre"]))
    votes[:, k + 4] = np.bincount(doc[you], minlength=m)
    votes[:, k + 5] = per(np.isin(data, [ord(c) for c in "#@$%&"])) > np.maximum(10, words)
    return votes, doc, (h & np.uint64(BINS - 1)).astype(np.int64), words


def stem_counts(column: pa.Array, stems: dict[int, np.ndarray]) -> np.ndarray:
    """How many words of each document begin with each mined stem; stems: hashes by size."""
    offsets, data = runtime.utf8(column)
    chars, m = _WORD[data], len(offsets) - 1
    out = np.zeros((m, sum(len(v) for v in stems.values())))
    base = 0
    for size, known in sorted(stems.items()):
        if len(known):
            table = IntMap(4 * len(known))
            table.add(known, np.arange(len(known)))
            h, doc = _stems(chars, offsets, size)
            at = table.get(h)
            np.add.at(out, (doc[at >= 0], base + at[at >= 0]), 1)
        base += len(known)
    return out


def mine_stems(doc: np.ndarray, stem: np.ndarray, size: np.ndarray, label: np.ndarray) -> dict[int, np.ndarray]:
    """Stems chosen greedily: each covers GAIN more documents of label 1 than three times those of label 0, beyond the ones before."""
    keys, first, at = np.unique(stem, return_index=True, return_inverse=True)
    bad = np.bincount(at, label[doc] == 1, len(keys))
    good = np.bincount(at, label[doc] == 0, len(keys))
    able = np.flatnonzero(bad - 3 * good >= GAIN)
    order = np.argsort(at, kind="stable")
    cut = np.searchsorted(at[order], np.arange(len(keys) + 1))
    members = {k: doc[order[cut[k] : cut[k + 1]]] for k in able.tolist()}
    covered = np.zeros(len(label), bool)
    value = np.where(label == 1, 1, -3)
    chosen: list[int] = []
    while members and len(chosen) < MAX_STEMS:
        gain = {k: int(value[d[~covered[d]]].sum()) for k, d in members.items()}
        best = max(gain, key=lambda k: (gain[k], -k))
        if gain[best] < GAIN:
            break
        chosen.append(best)
        covered[members.pop(best)] = True
        members = {k: d for k, d in members.items() if gain[k] >= GAIN}
    return {n: keys[[k for k in chosen if size[first[k]] == n]].astype(np.uint64) for n in STEMS}


def measures(votes: np.ndarray, stems: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The classifier's dense inputs: log counts of voters and stems, and how much of a text all stems take up."""
    total = stems.sum(1)
    share = np.minimum(total / np.maximum(words, 1) * 30, 2)
    return np.column_stack([np.log1p(votes), np.log1p(stems), np.log1p(total), share, total >= 2, total >= 3])


# --- the label model ----------------------------------------------------------------------------


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


class LabelModel:
    """Each voter's accuracy, the voters' correlations within the classes and the weights that follow, the share of class 1 and that among texts without votes."""

    def __init__(self, accuracy: np.ndarray, correlation: np.ndarray, weight: np.ndarray, prior: float, silent: float) -> None:
        self.accuracy, self.correlation, self.weight, self.prior, self.silent = accuracy, correlation, weight, prior, silent

    def posterior(self, fires: np.ndarray) -> np.ndarray:
        base = _logit(np.array(self.prior))
        odds = base + fires @ (self.weight * (_logit(self.accuracy) - base))
        return np.where(fires.any(1), 1 / (1 + np.exp(-np.clip(odds, -30, 30))), self.silent)


def fit_label_model(fires: np.ndarray, prior: float, rounds: int = 40) -> LabelModel:
    """Expectation-maximisation from the votes alone, for a given share of class 1. Correlations are estimated again as the classes move."""
    fires = fires.astype(np.float64)
    voted = fires.any(1)
    rare = prior / 10
    q = np.where(voted, ACCURACY, rare)
    k = fires.shape[1]
    correlation, weight, model = np.eye(k), np.ones(k), None
    for step in range(rounds):
        accuracy = np.clip((fires.T @ q + STRENGTH * ACCURACY) / (fires.sum(0) + STRENGTH), 5e-3, 1 - 5e-3)
        silent = float((q[~voted].sum() + STRENGTH * rare) / ((~voted).sum() + STRENGTH))
        if step % 10 == 1:
            correlation = correlations(fires, q)
            weight = evidence_weights(correlation)
        model = LabelModel(accuracy, correlation, weight, prior, silent)
        after = model.posterior(fires)
        if np.abs(after - q).max() < 1e-6 and step > 1:
            break
        q = after
    return model


def correlations(fires: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of the voters, in what the classes leave unexplained."""
    rate = [(fires.T @ w + 0.1) / (w.sum() + 1) for w in (1 - q, q)]
    rest = fires - (q[:, None] * rate[1] + (1 - q[:, None]) * rate[0])
    scale = np.sqrt((rest**2).mean(0)) + 1e-9
    out = (rest.T @ rest) / max(1, len(q)) / np.outer(scale, scale)
    np.fill_diagonal(out, 1)
    return out


def evidence_weights(correlation: np.ndarray) -> np.ndarray:
    """R^-1 1, with R drawn a tenth towards independence, and no weight below a fifth or above one."""
    k = len(correlation)
    return np.clip(np.linalg.solve(0.9 * correlation + 0.1 * np.eye(k), np.ones(k)), 0.2, 1) if k else np.zeros(0)


def chosen_voters(fires: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Places of the voters that the label model hears."""
    bad, good = fires.T.astype(np.float64) @ (label == 1), fires.T.astype(np.float64) @ (label == 0)
    return np.flatnonzero((bad >= CHOSEN) & (bad >= 3 * good))


# --- the classifier -----------------------------------------------------------------------------


def fit_classifier(votes: np.ndarray, d: np.ndarray, b: np.ndarray, n: np.ndarray, words: np.ndarray, q: np.ndarray, steps: int = 150) -> dict[str, np.ndarray]:
    """Weights of the dense inputs ``votes`` and of the share of words in each bin (n words of document d in bin b), and a constant."""
    x = votes
    rows = len(q)
    value = n / np.maximum(words[d], 1) * 10
    often = np.bincount(b, minlength=BINS) >= 20
    on = often[b]
    d, b, value = d[on], b[on], value[on]
    wv, wb, c = np.zeros(votes.shape[1]), np.zeros(BINS), float(np.log(max(q.mean(), 1e-3) / (1 - min(q.mean(), 0.999))))
    state = [np.zeros(votes.shape[1] + BINS + 1) for _ in range(2)]
    for t in range(1, steps + 1):
        z = x @ wv + np.bincount(d, value * wb[b], rows) + c
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - q
        grad = np.concatenate([x.T @ err / rows + 1e-4 * wv, np.bincount(b, value * err[d], BINS) / rows + 3e-3 * wb, [err.mean()]])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        move = 0.1 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-8)
        wv, wb, c = wv - move[: len(wv)], wb - move[len(wv) : -1], c - move[-1]
    return {"votes": wv, "bins": wb, "bias": np.array(c)}


def classify(model: dict, column: pa.Array) -> np.ndarray:
    votes, doc, bins, words = features(column)
    x = measures(votes, stem_counts(column, model["stems"]), words)
    z = x @ model["votes"] + np.bincount(doc, model["bins"][bins], len(words)) * 10 / np.maximum(words, 1) + model["bias"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> dict:
    """The classifier's weights. Only rows of the training folds are read for labels."""
    given = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), FOLDS, FOLD)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    given = given.orderBy(F.xxhash64("_id"), "_id", "_label").limit(max_train)
    train = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(given), "_id").select("_label", "text")
    train = runtime.store(train, "labelled")
    if train.count() > max_train:  # ids repeat
        wide, train = train, runtime.store(train.orderBy(F.xxhash64("text"), "_label").limit(max_train), "labelled")
        runtime.discard(wide)

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runtime.slices(batches, "text"):
            offsets, data = runtime.utf8(b.column(1))
            chars = _WORD[data]
            words = np.bincount(_spans(chars, offsets)[2], minlength=b.num_rows)
            labels = b.column(0).to_numpy()
            rows = []
            for size in STEMS:
                h, doc = _stems(chars, offsets, size)
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])[: len(h)]
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(h)))
                often = n >= np.maximum(1, DENSITY * words[doc[at]])
                rows.append((h[at][often], doc[at][often], np.full(int(often.sum()), size)))
            h, doc, size = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.argsort(doc, kind="stable")
            cut = np.searchsorted(doc[order], np.arange(b.num_rows + 1))
            parts = [order[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(labels), pa.array([h[p].tobytes() for p in parts]), pa.array([size[p].astype(np.int8).tobytes() for p in parts])], ["label", "stems", "sizes"])

    got = train.mapInArrow(mine, "label int, stems binary, sizes binary").toArrow()
    label = got["label"].to_numpy()
    found = [np.frombuffer(v, np.uint64) for v in got["stems"].to_pylist()]
    if len(label):
        doc = np.repeat(np.arange(len(found)), [len(v) for v in found])
        stems = mine_stems(doc, np.concatenate(found), np.concatenate([np.frombuffer(v, np.int8) for v in got["sizes"].to_pylist()]), label)
    else:
        none = np.zeros(len(LEXICON) + len(PATTERNS) + 4)
        none[: len(LEXICON) + 1] = 2.0
        return {"votes": none, "bins": np.zeros(BINS), "bias": np.array(-2.0), "stems": {}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runtime.slices(batches, "text"):
            votes, doc, bins, words = features(b.column(1))
            own = stem_counts(b.column(1), stems)
            key, n = np.unique(doc * BINS + bins, return_counts=True)
            size = np.bincount(key // BINS, minlength=b.num_rows)
            off = np.concatenate([[0], np.cumsum(size)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(words.astype(np.int32)), pa.array([v.astype(np.int32).tobytes() for v in votes]), pa.array([v.astype(np.int32).tobytes() for v in own]), pa.array([(key[i:j] % BINS).astype(np.uint16).tobytes() for i, j in zip(off[:-1], off[1:], strict=True)]), pa.array([np.minimum(n[i:j], 65535).astype(np.uint16).tobytes() for i, j in zip(off[:-1], off[1:], strict=True)])],
                ["label", "words", "votes", "stems", "bins", "counts"],
            )

    got = train.mapInArrow(run, "label int, words int, votes binary, stems binary, bins binary, counts binary").toArrow()
    runtime.discard(train)
    label, words = got["label"].to_numpy(), got["words"].to_numpy().astype(np.int64)
    counts, own = (np.stack([np.frombuffer(v, np.int32) for v in got[c].to_pylist()]).astype(np.float64) for c in ("votes", "stems"))
    bins = [np.frombuffer(v, np.uint16) for v in got["bins"].to_pylist()]
    doc = np.repeat(np.arange(len(bins), dtype=np.int32), [len(b) for b in bins])
    bins, often = np.concatenate(bins).astype(np.int32), np.concatenate([np.frombuffer(v, np.uint16) for v in got["counts"].to_pylist()])
    fires = np.column_stack([counts > 0, own >= np.maximum(1, DENSITY * words[:, None])])
    prior = float(np.clip(label.mean(), 1e-3, 0.5))
    fires = fires[:, chosen_voters(fires, label)]
    q = fit_label_model(fires, prior).posterior(fires.astype(np.float64))
    fitted = fit_classifier(measures(counts, own, words), doc, bins, often, words, q)
    return fitted | {"stems": stems}


def score(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runtime.slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(classify(shared.value, b.column(1)))], [id_col, "score"])

    found = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double")
    return found.select(id_col, held_out(F.col(id_col), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runtime.slices(batches, text_col):
            yield b.filter(pa.array(classify(shared.value, b.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)
