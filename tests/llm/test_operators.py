"""Each operator against a plain version, over awkward tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, ctw, license_scan, line_dedup, mtree, ngram_join, packing, quality, token_store, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, score double, value string"
LONG = "Words that follow each other in a line of some length, again and again. "
TEXTS = {
    0: None,
    1: "",
    2: "   \n\n\t ",
    3: "It's they're 'tis  42 naïve ÉCOLE 漢字 🎉 <|endoftext|> x",
    4: LONG * 300,
    5: "x" * 5000,
    6: "one two three four five six seven eight nine ten\n" + LONG,
    7: "one two three four five six seven eight nine ten\n" + LONG,
    8: "one two three four five six seven eight nine TEN eleven\nreleased under CC-BY; all rights reserved\n" + LONG,
    9: "short",
    10: "short",
    11: LONG + "\nyou idiot moron",
    12: LONG + "\nGNU General Public Licence, version 3",
    13: "\n".join([LONG] * 3),
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), "clash", 1.0, "clash") for i, t in TEXTS.items()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def table(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- 1 ---


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab cAB 019'’\n\t éßΣ漢🎉<|endoftx>.,sv", max_size=30), min_size=1, max_size=4))
def test_bpe_equals_library(texts):
    for path in (BYTE, WORD):
        off, ids = bpe.coder(path).encode(texts)
        library = _library(path)
        for i, t in enumerate(texts):
            assert ids[off[i] : off[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


_libraries: dict = {}


def _library(path):
    if path not in _libraries:
        _libraries[path] = Tokenizer.from_file(path)
    return _libraries[path]


def test_bpe_tables(docs, none):
    got = table(bpe.decode(bpe.encode(docs, BYTE), BYTE))
    for i, t in TEXTS.items():
        assert got[i]["ids"] == _library(BYTE).encode(t or "", add_special_tokens=False).ids
        assert got[i]["decoded"] == (t or "")
    assert bpe.decode(bpe.encode(none, BYTE), BYTE).count() == 0


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(k).count("1") & 1] for k in range(n))


#: Words that a polynomial hash modulo 2**64 can't tell apart.
TWINS = [w for n in (512, 1024, 2048, 4096) for w in (thue_morse(n), thue_morse(n, "ba"))]


def test_bpe_tells_thue_morse_words_apart():
    for path in (BYTE, WORD):
        off, ids = bpe.coder(path).encode(TWINS)
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [_library(path).encode(t, add_special_tokens=False).ids for t in TWINS]


def test_hashes_tell_twins_apart():
    from tidemark.llm.hashing import Hasher

    data = np.frombuffer("".join(TWINS).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in TWINS])
    for seed in (1, 77, 1234):
        assert len(set(Hasher(256, seed).spans(data, ends - [len(w) for w in TWINS], ends).tolist())) == len(TWINS)


def test_bpe_cache_keeps_words_in_use(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    c = bpe.Coder(BYTE)
    for k in range(40):
        texts = [f"the common words w{k}x{j}" for j in range(20)]
        off, ids = c.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [_library(BYTE).encode(t, add_special_tokens=False).ids for t in texts]
    assert c.n_words < 200


# --- 2 ---


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 3), max_size=3000))
def test_coder_round_trip(ids):
    assert token_store.decompress(token_store.compress(np.array(ids, np.uint32))).tolist() == ids


@settings(max_examples=10, deadline=None)
@given(st.integers(1, 30_000), st.integers(1, 3000), st.integers(0, 2**31))
def test_coder_round_trip_of_many(n, symbols, seed):
    rng = np.random.default_rng(seed)
    ids = (rng.zipf(1.3, n) % symbols * (1 + seed % 3 * 70_000)).astype(np.uint32)
    assert token_store.decompress(token_store.compress(ids)).tolist() == ids.tolist()


def test_coder_detects_damage():
    """A flipped bit is told, or (in the last bits of a lane) changes no id."""
    ids = np.random.default_rng(0).integers(0, 50, 40_000)
    good, told = token_store.compress(ids), 0
    for at in range(0, len(good), 997):
        data = bytearray(good)
        data[at] ^= 1
        try:
            assert token_store.decompress(bytes(data)).tolist() == ids.tolist()
        except ValueError:
            told += 1
    assert told > 0.8 * len(range(0, len(good), 997))


def entropy(ids):
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    return -(p * np.log2(p)).sum()


def test_coder_uses_each_order():
    """Independent ids cost their entropy; ids that follow from the one or the two before cost far less."""
    rng = np.random.default_rng(0)
    bits = lambda ids: 8 * len(token_store.compress(ids)) / len(ids)
    alone = rng.zipf(1.5, 200_000) % 5000
    assert bits(alone) < 1.1 * entropy(alone)
    after = np.cumsum(rng.integers(0, 2, 200_000) * 7 + 3) % 500  # one of two successors
    assert entropy(after) > 8.9 and bits(after) < 1.7
    table, pair = rng.permuted(np.tile(np.arange(30), (30, 1)), axis=1), [1, 2]
    for _ in range(100_000):
        pair.append(int(table[pair[-2], pair[-1]]) if rng.random() < 0.95 else int(rng.integers(0, 30)))
    assert entropy(pair) > 4 and bits(np.array(pair)) < 1.6


def test_coder_takes_over_few_counts(monkeypatch):
    """The counts that all take-overs of a block work on are fewer than half of its ids; a take-over at every doubling makes that all of them."""
    ids, worked, plain = np.random.default_rng(3).zipf(1.5, 1 << 19) % 500, [], token_store.Model.take_over
    monkeypatch.setattr(token_store.Model, "take_over", lambda self: (worked.append(self.total), plain(self)))
    data = token_store.compress(ids)
    assert 0 < sum(worked) < len(ids) // 2
    worked.clear()
    assert token_store.decompress(data).tolist() == ids.tolist() and 0 < sum(worked) < len(ids) // 2


def test_blocks_stand_alone():
    ids = np.random.default_rng(1).integers(0, 300, 10_000)
    blocks = token_store.blocks_of(ids, 3000)
    assert len(blocks) == 4 and token_store.decompress(blocks[2]).tolist() == ids[6000:9000].tolist()


def test_token_store(spark, docs, none, tmp_path):
    rows = docs.union(spark.createDataFrame([(None, "no id", None, None, 0, "", 0.0, ""), (9, "again", None, None, 0, "", 0.0, ""), (-(2**63), "least", None, None, 0, "", 0.0, "")], SCHEMA))
    texts = [(None, "no id"), (-(2**63), "least"), *[(i, TEXTS[i]) for i in range(9)], (9, "again"), *[(i, TEXTS[i]) for i in range(9, 14)]]
    for segment, block in ((64, 50), (token_store.SEGMENT, token_store.BLOCK)):
        path = f"file://{tmp_path}/{segment}"
        token_store.write(rows, path, WORD, segment=segment, block=block)
        got, start, flat = token_store.read(spark, path).orderBy("start").collect(), 0, []
        assert len(got) == len(texts)
        for r, (i, t) in zip(got, texts, strict=True):
            want = [*_library(WORD).encode(t or "", add_special_tokens=False).ids, 2]
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (i, start, len(want), want)
            start += len(want)
            flat += want
        for a, n in ((0, 5), (60, 200), (len(flat) - 3, 50), (0, len(flat))):
            assert token_store.span(spark, path, a, n, block).tolist() == flat[a : a + n]
    token_store.write(none, f"file://{tmp_path}/none", WORD)
    assert token_store.checksums(spark, f"file://{tmp_path}/none").count() == 0


# --- 3 ---


def test_license_scan(docs, none):
    got = table(license_scan.scan(docs))
    for i, t in TEXTS.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        assert got[i]["n_words"] == len(words)
        want = sorted((k, label) for p, label in license_scan.BASE.items() for k in range(len(words)) if words[k : k + p.count(" ") + 1] == p.split())
        assert sorted((b["word"], b["label"]) for b in got[i]["base"]) == want
    assert {s["label"] for s in got[12]["spans"]} == {"gpl"}  # "licence" is an edit away
    assert license_scan.scan(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="general public license ", max_size=60))
def test_license_seeds_lose_nothing(text):
    notice, k = "general public license", len("general public license") // license_scan.EDIT_STEP
    scanner = license_scan.Scanner({notice: "gpl"}, license_scan.EDIT_STEP)
    assert bool(scanner.spans(text)) == within_edits(text, notice, k)


def within_edits(text, notice, k):
    """Whether a substring of text lies within k edits of the notice, by dynamic programming."""
    row = list(range(len(notice) + 1))
    best = row[-1]
    for c in text:
        prev, row = row, [0] * len(row)
        for j, d in enumerate(notice, 1):
            row[j] = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (c != d))
        best = min(best, row[-1])
    return best <= k


def test_license_query(spark, tmp_path):
    """first_word, last_word, labels and score, also of a text full of places, which takes no longer than its length."""
    import time

    from tidemark.llm.queries import op3_license_scan

    many = "cc by " * 200_000
    texts = {1: "All rights reserved. É CC-BY, all RIGHTS reserved", 2: "gnu lesser general public licence", 3: None, 4: many, 5: "nothing of the kind"}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    got = table(op3_license_scan(spark, str(tmp_path)))
    assert time.time() - began < 40
    row = lambda i: tuple(got[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels"))
    assert row(1) == (9, 3, 0, 6, "cc-by,reserved", "cc-by,reserved") and got[1]["score"] == 1.0
    assert row(2)[:5] == (5, 0, None, None, "") and "lgpl" in row(2)[5] and 0.9 < got[2]["score"] < 1
    assert row(3) == (0, 0, None, None, "", "") and got[3]["score"] == 0.0
    assert row(4)[:5] == (400_000, 200_000, 0, 399_998, "cc-by")
    assert row(5)[1:] == (0, None, None, "", "")


def test_license_windows_hold_all_matches():
    scanner = license_scan.Scanner(license_scan.NOTICES, license_scan.EDIT_STEP)
    labels = lambda text: [(scanner.notices[i][1], a, b) for i, a, b, _ in scanner.spans(text)]
    assert ("apache-2.0", 0, 45) in labels("licenscd undcr tne apacne license version 2 0")  # a later seed begins earlier
    worse, best = "creative comnons attribution", "creative commons attribution"
    for text in (f"{worse} {best}", f"{best} {worse}", f"{worse} {best} {worse}"):
        found = [x for x in labels(text) if x[0] == "cc-by"]
        assert len(found) == text.count("creative") and all(a[2] <= b[1] for a, b in zip(found, found[1:]))


# --- 4 ---


def test_toxicity(spark, docs, none):
    rows = [(i, LONG.replace("line", f"line{i % 7}") + (" what an idiot and loser, you moron" if i % 5 == 0 else ""), "en", "s", 0, "", 0.0, "") for i in range(200)]
    many = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0) ^ (i % 29 == 0)) for i in range(200)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(many, labels)
    got = table(toxicity.score(many, model))
    wrong = [i for i in range(200) if got[i]["predicted"] != (i % 5 == 0)]
    assert len(wrong) <= 2
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(200))
    assert toxicity.keep(many, model).count() in range(158, 163)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(none, model).count() == 0
    empty = toxicity.fit(none, labels)
    assert table(toxicity.score(docs, empty))[11]["score"] > table(toxicity.score(docs, empty))[9]["score"]


def test_label_model_equals_a_plain_one():
    """The same accuracies and posteriors as loops over rows give, without a label; doubled voters share their weight."""
    rng = np.random.default_rng(7)
    truth = rng.random(600) < 0.3
    fires = np.column_stack([(rng.random(600) < np.where(truth, p, r)) for p, r in ((0.5, 0.01), (0.4, 0.02), (0.6, 0.03))])
    fires = np.column_stack([fires, fires[:, 0]])
    model = toxicity.fit_label_model(fires, 0.3)
    assert model.weight[0] < 0.75 and model.weight[3] < 0.75 and model.weight[1] > 0.9 and abs(model.correlation[0, 3] - 1) < 1e-6
    q = model.posterior(fires.astype(float))
    base = np.log(0.3 / 0.7)
    for i in range(600):
        if not fires[i].any():
            assert q[i] == model.silent
            continue
        odds = base + sum(model.weight[j] * (np.log(model.accuracy[j] / (1 - model.accuracy[j])) - base) for j in range(4) if fires[i, j])
        assert abs(q[i] - 1 / (1 + np.exp(-odds))) < 1e-12
    for j in range(4):  # a fixed point of the estimate
        own = [q[i] for i in range(600) if fires[i, j]]
        want = (sum(own) + toxicity.STRENGTH * toxicity.ACCURACY) / (len(own) + toxicity.STRENGTH)
        assert abs(model.accuracy[j] - min(want, 0.995)) < 1e-4
    assert ((q >= 0.5) == truth)[fires.any(1)].mean() > 0.8


def test_toxicity_learns_a_bounded_number_of_rows(spark, monkeypatch):
    """However often an id repeats."""
    rows = [(1, LONG + f" idiot {i}") for i in range(60)] + [(i, LONG + f" {i}") for i in range(3, 60)]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(i, int(i == 1)) for i in range(60)], "doc_id bigint, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit_classifier", lambda votes, *a, f=toxicity.fit_classifier: (seen.append(len(votes)), f(votes, *a))[1])
    toxicity.fit(docs, labels, max_train=50)
    assert seen == [50]


def test_toxicity_stage_rejects_what_the_operator_rejects(spark):
    rows = [(i, " ".join(["plain"] * i), "en", "s", 0, "", 0.0, "") for i in range(1, 40)]
    some = spark.createDataFrame(rows, SCHEMA)
    weights = toxicity.fit(some.where("doc_id < 0"), spark.createDataFrame([], "doc_id bigint, toxic int"))
    weights["bias"] = np.array(-0.4)  # a score of 0.4 for a text without votes
    got = table(toxicity.score(some, weights))
    assert any(toxicity.THRESHOLD <= r["score"] < 0.5 for r in got.values())
    assert {r["doc_id"] for r in toxicity.keep(some, weights).collect()} == {i for i, r in got.items() if not r["predicted"]}


# --- 5 ---


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return {i: (len(sets[i]), root[i]) for i in texts}


def near_copies(n, seed=5):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(400)]
    bases = [" ".join(rng.choice(words, 60)) for _ in range(4)]
    out = {}
    for i in range(n):
        w = bases[i % 4].split()
        for k in rng.integers(0, 60, rng.integers(0, 4)):
            w[k] = str(rng.choice(words))
        out[i + 100] = " ".join(w)
    return out


@pytest.mark.parametrize("bag", [3, 400])
def test_ngram_join(spark, none, bag):
    texts = {**TEXTS, **near_copies(60)}
    df = spark.createDataFrame([(i, t, None, None, 0, "", 0.0, "") for i, t in texts.items()], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(df, bag=bag).collect()}
    assert got == brute_components(texts)


def test_ngram_join_edges(spark, docs, none):
    assert ngram_join.join(none).count() == 0
    twice = docs.union(docs).union(docs.sparkSession.createDataFrame([(None, LONG, None, None, 0, "", 0.0, "")], SCHEMA))
    got = ngram_join.join(twice).collect()
    assert len(got) == 2 * len(TEXTS) + 1
    want = brute_components(TEXTS)
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_ngram_join_of_repeated_ids(spark):
    """Different texts of one id are linked, by the longer one's own size and the shorter one's."""
    words = [f"w{k}" for k in range(300)]
    long, short = " ".join(words[:104]), " ".join(words[200:214])
    rows = [(5, long), (5, short), (2, long), (3, short), (9, " ".join(words[:103])), (8, " ".join(words[200:213])), (1, "alone in the whole of the table")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(1, 3, 1), (2, 100, 2), (3, 10, 2), (5, 10, 2), (5, 100, 2), (8, 9, 2), (9, 99, 2)]


def test_ngram_join_of_one_passage_in_all(spark):
    """A passage in every document, most of each, joins nothing by itself; copies with one more word do. No part of a bag meets each other part."""
    rng = np.random.default_rng(12)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = {i: passage + " " + " ".join(f"t{i}x{k}" for k in range(int(rng.integers(14, 22)))) for i in range(90)}
    texts |= {200 + i: texts[i] + " more" for i in range(0, 90, 9)}
    texts |= {300 + i: passage + " " + " ".join(f"u{i}x{k}" for k in range(12)) for i in range(12)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(df, bag=8).collect()} == brute_components(texts)


def test_components_of_hot_nodes(spark, monkeypatch):
    from tidemark.llm import components

    links = [(0, i) for i in range(1, 60)] + [(i, i + 100) for i in range(1, 60)] + [(300, 301), (301, 302), (302, 303)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    want = {i: 0 for i in [*range(60), *range(101, 160)]} | {i: 300 for i in range(300, 304)}
    for one, hot in ((components.ONE_TASK, components.HOT), (0, components.HOT), (0, 5)):
        monkeypatch.setattr(components, "ONE_TASK", one)
        monkeypatch.setattr(components, "HOT", hot)
        assert {r["id"]: r["component"] for r in components.components(df).collect()} == want


# --- 6 ---


def brute_lines(texts, least=5, size=40):
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= size:
                held[key(line)].add(i)
    last = {k: max(v) for k, v in held.items() if len(v) >= least}
    out = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if last.get(key(x), i) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(docs, none):
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.dedup(docs).collect()}
    assert got == brute_lines(TEXTS)
    whole = line_dedup.dedup(docs, whole_rows=True)
    assert whole.columns == docs.columns and {i: r["text"] for i, r in table(whole).items()} == {i: x[2] for i, x in brute_lines(TEXTS).items()}
    assert line_dedup.dedup(none).count() == 0


def test_line_dedup_of_repeated_rows_and_null_ids(spark):
    """Each row counts; a null id is the smallest; the largest id keeps the line in all its rows."""
    rows = [(None, LONG), (None, LONG), (3, LONG + "\nx"), (7, LONG), (7, LONG)]
    got = sorted(((r["doc_id"] or -1), r["n_dropped"], r["kept_text"]) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(-1, 1, ""), (-1, 1, ""), (3, 1, "x"), (7, 0, LONG), (7, 0, LONG)]


def test_line_index_is_reversible(spark, docs):
    index = line_dedup.LineIndex(spark)
    index.insert(docs.where("doc_id < 12"))
    first = {tuple(r) for r in index.shared().collect()}
    index.insert(docs.where("doc_id >= 12"))
    assert {r["doc_id"]: r["kept_text"] for r in index.apply(docs).collect()} == {i: x[2] for i, x in brute_lines(TEXTS).items()}
    index.delete(docs.where("doc_id >= 12"))
    assert {tuple(r) for r in index.shared().collect()} == first


def line_texts(first, n, lines):
    return {first + i: "\n".join(f"line {k} of the documents from {first} on, which all of them share" for k in range(lines)) for i in range(n)}


def marks(index):
    """How many fingerprints the filters of an index hold."""
    return sum(int((np.frombuffer(r["filter"], np.uint16) > 0).sum()) for r in index.state.collect())


def test_line_index_grows(spark, monkeypatch):
    """Filters that overflow are rebuilt, keys that outgrow the shards are dealt anew, deleted keys leave the filters, and apply() reads the kept ones."""
    frame = lambda t: spark.createDataFrame(list(t.items()), "doc_id bigint, text string")
    few, many = line_texts(0, 5, 1), line_texts(100, 6, 20_000)
    index = line_dedup.LineIndex(spark, shards=1)
    index.insert(frame(few))
    assert marks(index) == 1
    index.insert(frame(many))
    assert marks(index) == 20_001 and index.shards == 1
    index.delete(frame(many))
    assert marks(index) == 1 and index.shared().count() == 1
    index.insert(frame(many))
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 200)
    more = line_texts(200, 5, 3)
    index.insert(frame(more))
    assert index.shards > 1
    index.delete(frame(few))
    assert marks(index) == 20_003
    monkeypatch.setattr(line_dedup, "refresh", None)
    texts = many | more
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in index.apply(frame(texts)).collect()} == brute_lines(texts)


def test_line_index_counts_only_keys_touched(spark, docs, monkeypatch):
    index, seen = line_dedup.LineIndex(spark), []
    index.insert(docs)
    monkeypatch.setattr(line_dedup, "refresh", lambda state, changed, *a, f=line_dedup.refresh: (seen.append(changed.count()), f(state, changed, *a))[1])
    index.insert(spark.createDataFrame([(50, "one line of its own that no other document has, or will\n" + LONG)], "doc_id bigint, text string"))
    assert seen == [2]


def test_line_index_survives_a_failed_call(spark, docs, monkeypatch):
    index = line_dedup.LineIndex(spark)
    index.insert(docs.where("doc_id < 3"))
    with monkeypatch.context() as m:
        m.setattr(line_dedup, "refresh", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.insert(docs.where("doc_id >= 3"))
    index.insert(docs.where("doc_id >= 3"))
    fresh = line_dedup.LineIndex(spark)
    fresh.insert(docs)
    assert {tuple(r) for r in index.shared().collect()} == {tuple(r) for r in fresh.shared().collect()}


def test_line_query_goes_through_the_table(spark, tmp_path, monkeypatch):
    from tidemark.llm import queries

    made = []
    monkeypatch.setattr(line_dedup.LineIndex, "insert", lambda self, docs, f=line_dedup.LineIndex.insert: (made.append(self), f(self, docs))[1])
    spark.createDataFrame([(i, t) for i, t in TEXTS.items()], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op6_line_dedup(spark, str(tmp_path)).count() == len(TEXTS)
    assert made[0].references().select("doc").distinct().count() > 5


def test_cuckoo():
    rng = np.random.default_rng(1)
    hi, lo = (rng.integers(0, 2**63, 20_000).astype(np.uint64) for _ in range(2))
    f = line_dedup.filled(hi[:10_000], lo[:10_000], 10_000)
    assert f.contains(hi[:10_000], lo[:10_000]).all()
    assert f.contains(hi[10_000:], lo[10_000:]).mean() < 0.01
    f.delete(hi[:5000], lo[:5000])
    assert f.contains(hi[5000:10_000], lo[5000:10_000]).all()
    assert f.contains(hi[:5000], lo[:5000]).mean() < 0.01


# --- 7 ---


def words_of(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})), None]


def test_ctw(spark, docs, none):
    texts = TEXTS | {20: "\n".join(TWINS)}
    df = docs.union(spark.createDataFrame([(20, texts[20], None, None, 0, "", 0.0, "")], SCHEMA))
    got = table(ctw.score(df))
    tokens = {i: words_of(t) for i, t in texts.items()}
    train = Counter(w for i, t in tokens.items() if not ctw.is_held_out(i) for w in t)
    n, v = sum(train.values()), len(train)
    assert len(got) == len(texts)
    for i, t in tokens.items():
        r = got[i]
        want = sum(np.log10((train[w] + 1) / (n + v + 1)) for w in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (ctw.is_held_out(i), len(t), sum(train[w] > 0 for w in t), n)
        assert abs(r["base_score"] - want) < 1e-6 * max(1, abs(want)) and r["score"] < 0
    assert ctw.score(none).count() == 0


class Tree:
    """A context tree for one bit of a byte, written as the definition says."""

    def __init__(self):
        self.zeros = self.ones = 0
        self.children = {}

    def see(self, context, bit):
        self.zeros, self.ones = self.zeros + (not bit), self.ones + bit
        if context:
            self.children.setdefault(context[-1], Tree()).see(context[:-1], bit)

    def log_kt(self):
        out = 0.0
        for k in range(self.zeros):
            out += np.log((k + 0.5) / (k + 1))
        for k in range(self.ones):
            out += np.log((k + 0.5) / (self.zeros + k + 1))
        return out

    def log_weighted(self):
        if not self.children:
            return self.log_kt()
        return np.logaddexp(self.log_kt(), sum(c.log_weighted() for c in self.children.values())) - np.log(2)

    def one(self, context):
        own = (self.ones + 0.5) / (self.zeros + self.ones + 1)
        if not self.children or not context:
            return own
        share = 1 / (1 + np.exp(sum(c.log_weighted() for c in self.children.values()) - self.log_kt()))
        child = self.children.get(context[-1])
        return share * own + (1 - share) * (child.one(context[:-1]) if child else 0.5)


def test_ctw_equals_the_definition(spark):
    texts = {0: "abracadabra", 1: "abrac", 3: "é abra", 4: "", 5: "xyz abracadabra", 7: "abrax"}
    texts |= {i: "cabra" for i in range(10, 30) if ctw.is_held_out(i)}
    trees = defaultdict(Tree)

    def bytes_of(t):
        data = bytes([255] * 4) + t.encode() + b"\xff"
        return [(data[k - 4 : k], data[k]) for k in range(4, len(data))]

    for i, t in texts.items():
        if not ctw.is_held_out(i):
            for context, byte in bytes_of(t):
                for bit in range(8):
                    trees[(1 << bit) | byte >> (8 - bit)].see(context, byte >> (7 - bit) & 1)
    got = table(ctw.score(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")))
    assert any(r["held_out"] for r in got.values())
    for i, t in texts.items():
        want = 0.0
        for context, byte in bytes_of(t):
            for bit in range(8):
                p = trees[(1 << bit) | byte >> (8 - bit)].one(context)
                want += np.log10(p if byte >> (7 - bit) & 1 else 1 - p)
        assert abs(got[i]["score"] - want) < 1e-6 * abs(want)


def test_ctw_rows_are_scored_by_themselves(spark):
    """Null and repeated ids, also beside an id 0 of the same text, and small slices, change no row's score."""
    rows = [(0, "the same text here"), (None, "the same text here"), (0, "the same text here"), (0, "another"), (None, None), (5, "the same words again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    train = Counter(w for i, t in rows if not ctw.is_held_out(i) for w in words_of(t))
    n, v = sum(train.values()), len(train)
    want = sorted((str(i), len(words_of(t)), sum(train[w] > 0 for w in words_of(t)), round(sum(np.log10((train[w] + 1) / (n + v + 1)) for w in words_of(t)), 6)) for i, t in rows)
    scores = []
    for size in (ctw.SLICE, 1):
        got = ctw.score(df, slice_bytes=size).collect()
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
        scores.append(sorted(round(r["score"], 9) for r in got))
    assert scores[0] == scores[1] and scores[0].count(scores[0][scores[0].index(max(scores[0]))]) >= 1


def test_ctw_without_training_text(spark):
    held = next(i for i in range(100) if ctw.is_held_out(i))
    r = ctw.score(spark.createDataFrame([(held, "ab")], "doc_id bigint, text string")).first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and abs(r["score"] + 24 * np.log10(2)) < 1e-6


# --- 8 ---


def test_packing(docs, none):
    rows = packing.pack_documents(docs, BYTE).collect()
    got = {(r["doc_id"], r["piece"]): r for r in rows}
    for i, t in TEXTS.items():
        ids = [*_library(BYTE).encode(t or "", add_special_tokens=False).ids, 0]
        many = -(-len(ids) // 2048)
        head = len(ids) - (many - 1) * 2048
        for k in range(many):
            start, size = (0, head) if k == 0 else (head + (k - 1) * 2048, 2048)
            r = got.pop((i, k))
            assert (r["start"], r["length"]) == (start, size)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[start : start + size], "<u4").tobytes())
    assert not got
    at = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 2048
    assert packing.pack_documents(none, BYTE).count() == 0


@settings(max_examples=20, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_holds_every_piece_once(histogram):
    plan = packing.plan(histogram, 64, rounds=10)
    total = Counter()
    for a, n in plan:
        assert sum(w * m for w, m in a.items()) <= 64
        for w, m in a.items():
            total[w] += m * n
    assert total == Counter(histogram)
    assert sum(n for _, n in plan) <= 2 * -(-sum(w * n for w, n in histogram.items()) // 64) + 1


def best_fit_decreasing(histogram, size):
    rooms = []
    for w in sorted((w for w, n in histogram.items() for _ in range(n)), reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= w]
        if fits:
            at = min(fits, key=lambda i: rooms[i])
            rooms[at] -= w
        else:
            rooms.append(size - w)
    return len(rooms)


def fewest(histogram, size):
    """The least number of sequences, by search over what is left."""
    from functools import cache

    widths = sorted(histogram, reverse=True)

    @cache
    def need(left):
        if not any(left):
            return 0
        top = next(i for i, n in enumerate(left) if n)
        best = sum(left)

        def fillings(i, room, now):
            if i == len(widths):
                yield tuple(now)
                return
            for m in range(min(now[i], room // widths[i]), -1, -1):
                yield from fillings(i + 1, room - m * widths[i], now[:i] + [now[i] - m] + now[i + 1 :])

        start = list(left)
        start[top] -= 1
        for after in fillings(0, size - widths[top], start):
            best = min(best, 1 + need(after))
        return best

    return need(tuple(histogram[w] for w in widths))


def test_plan_beats_best_fit_and_meets_the_optimum():
    hard = {51: 6, 27: 6, 26: 6, 23: 12}
    count = lambda h, size: sum(n for _, n in packing.plan(h, size))
    assert (count(hard, 100), fewest(hard, 100), best_fit_decreasing(hard, 100)) == (9, 9, 11)
    rng = np.random.default_rng(8)
    over = 0
    for _ in range(40):
        h = {int(w): int(rng.integers(1, 3)) for w in rng.choice(np.arange(3, 20), 4, replace=False)}
        assert packing.lower_bound(h, 24) <= fewest(h, 24) <= count(h, 24) <= best_fit_decreasing(h, 24)
        over += count(h, 24) - fewest(h, 24)
    assert over <= 1


def test_packing_deals_long_lengths_to_parts(spark):
    """Pieces of one length are numbered in parts; repeated rows and null ids are placed once each."""
    from tidemark.llm import runtime

    rows = [(None if i % 7 == 0 else i // 2, 10 if i % 3 else 7) for i in range(500)]
    found = runtime.store(spark.createDataFrame(rows, "doc_id bigint, length bigint"), "pieces")
    got = packing.pack(found, 64, part=20).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in got) == sorted((str(a), b) for a, b in rows)
    at = defaultdict(int)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 64 and len(at) == -(-sum(b for _, b in rows) // 64)


# --- 9 ---


def test_quality(spark, docs, none):
    got = table(quality.verdicts(quality.measures(docs)))
    for i, t in TEXTS.items():
        t = t or ""
        words, windows = re.findall(r"[^\x20\x09-\x0D]+", t), defaultdict(list)
        for k in range(len(words) - 2):
            windows[tuple(words[k : k + 3])].append(k)
        covered = {k + j for v in windows.values() if len(v) > 1 for k in v for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[i][c] for c in quality.COUNTS) == want
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert quality.verdicts(quality.measures(none)).count() == 0


def test_quality_fence(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(3000)]
    rows = [(i, " ".join(rng.choice(words, 80)), "en", "a", 0, "", 0.0, "") for i in range(60)]
    rows.append((99, " ".join(f"{w} ### $$$" for w in rng.choice(words, 80)), "en", "a", 0, "", 0.0, ""))
    got = table(quality.verdicts(quality.measures(spark.createDataFrame(rows, SCHEMA))))
    assert not got[99]["base_failed"] and not got[99]["kept"] and all(got[i]["kept"] for i in range(60))


def test_quality_fences_decide(spark):
    """Each of the seven fences rejects a document that the fixed rules pass."""
    rng = np.random.default_rng(3)
    words = [f"w{k:03}" for k in range(900)]
    text = lambda n: " ".join(rng.permutation(words)[:n])
    clean = {i: text(int(rng.integers(190, 211))) for i in range(200)}
    odd = {
        1000: " ".join(f"{w}#" if k % 2 else w for k, w in enumerate(text(200).split())),  # symbols
        1001: "\n".join([*text(196).split(" "), *["x y"] * 40]),  # equal lines
        1002: text(150) + " again and again and again and again and again and again and again and again and again and again and again and again and again",
        1003: " ".join(w + "long" for w in text(200).split()),
        1004: " ".join(w[1:3] for w in text(200).split()),
        1005: text(900),
        1006: text(70),
    }
    rows = [(i, t, "en", "a", 0, "", 0.0, "") for i, t in (clean | odd).items()]
    measured = quality.measures(spark.createDataFrame(rows, SCHEMA))
    got = table(quality.verdicts(measured))
    assert all(got[i]["kept"] for i in clean)
    assert not any(got[i]["base_failed"] for i in odd) and not any(got[i]["kept"] for i in odd)
    fence, seen = quality.thresholds(measured).collect()[0].asDict(), table(measured)
    for i, m in zip(odd, ("symbol_share", "dup_line_share", "repeat_share", "mean_word", None, "log_words", None), strict=True):
        assert m is None or seen[i][m] > fence[f"{m}_most"]
    assert seen[1004]["mean_word"] < fence["mean_word_least"] and seen[1006]["log_words"] < fence["log_words_least"]
    assert 0 < fence["repeat_share_most"] < 0.5 and fence["log_words_least"] > np.log1p(50)


def test_quality_small_groups(spark):
    """Groups and languages of under MIN_GROUP documents are judged, too, by the next larger group that is large enough."""
    rng = np.random.default_rng(6)
    words = [f"w{k:03}" for k in range(900)]
    noisy = lambda: " ".join(f"{w}###" for w in rng.choice(words, 100))
    rows = [(i, " ".join(rng.choice(words, 100)), "en", f"s{i % 4}", 0, "", 0.0, "") for i in range(80)]
    rows += [(100, noisy(), "en", "s0", 0, "", 0.0, ""), (101, noisy(), None, "rare", 0, "", 0.0, ""), (102, " ".join(rng.choice(words, 100)), None, None, 0, "", 0.0, "")]
    got = table(quality.verdicts(quality.measures(spark.createDataFrame(rows, SCHEMA))))
    assert not any(r["base_failed"] for r in got.values())
    assert {i for i, r in got.items() if not r["kept"]} == {100, 101}
    few = table(quality.verdicts(quality.measures(spark.createDataFrame([r for r in rows if r[0] < 10 or r[0] == 100], SCHEMA))))
    assert {i for i, r in few.items() if not r["kept"]} == {100}


# --- 10 ---


def exact_top(rows, k=20, step=20):
    """(id, vector): for each distinct query, its best (score, id)."""
    width = max(len(v) for _, v in rows)
    rows = [(i, [int(np.floor(64 * x)) for x in v] + [0] * (width - len(v))) for i, v in rows]
    out = []
    for i, q in {(i, tuple(v)) for i, v in rows if i % step == 0}:
        best = sorted(((sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in rows if j != i), key=lambda e: (-e[0], e[1]))[:k]
        out += [(i, rank, j, max(-(2**63), min(2**63 - 1, s))) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(("tree_rows", "region_rows"), [(70, 10**6), (16_384, 10**6), (20, 40)])
def test_mtree(spark, tree_rows, region_rows):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 6)) * 40
    rows = [(i, [float(x) for x in rng.normal(size=6) + centres[i % 6]], "clash") for i in range(300)]
    rows += [(300, None, ""), (301, [float("nan")] * 6, ""), (302, [1.0, None], ""), (303, rows[7][1], ""), (304, rows[7][1], ""), (305, [0.5], ""), (320, [], "")]
    rows += [(40, rows[40][1], ""), (60, rows[5][1], ""), (None, rows[6][1], "")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score string")
    found = mtree.top_k(df, tree_rows=tree_rows, region_rows=region_rows)
    got = sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in found.collect())
    plain = [(i, v) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    assert got == exact_top(plain)
    if region_rows == 40:  # regions far from a query aren't searched
        assert found.agg({"n_compared": "avg"}).first()[0] < 0.9 * len(plain)
    assert mtree.top_k(df.where("vec_id < 0")).count() == 0


@pytest.mark.parametrize("size", [1e6, 1e12, 1e300])
def test_mtree_of_large_components(spark, size):
    """Ranks are exact whatever the size; components and scores beyond a long stand at its ends."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 3) * size]) for i in range(80)]
    edge = 9223372036854774784
    plain = [(i, [max(-edge, min(edge, 64 * x)) / 64 for x in v]) for i, v in rows]
    got = sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in mtree.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), tree_rows=30).collect())
    assert got == exact_top(plain)


# --- the queries' digests ---


def test_query_digests(spark, tmp_path):
    from tidemark.llm.queries import op1_bpe, op6_line_dedup

    rows = [(i, t, "en", "s", 0) for i, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op1_bpe(spark, str(tmp_path)).collect():
        t = TEXTS[r["doc_id"]] or ""
        ids = _library(BYTE).encode(t, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    want = brute_lines(TEXTS)
    for r in op6_line_dedup(spark, str(tmp_path)).collect():
        assert r["kept_sha256"] == hashlib.sha256(want[r["doc_id"]][2].encode()).hexdigest()


def test_arrow_slices_of_offset_batches():
    from tidemark.llm import runtime

    column = pa.array(["aa", None, "bbb", "c"]).slice(1)
    offsets, data = runtime.utf8(column)
    assert offsets.tolist() == [0, 0, 3, 4] and data.tobytes() == b"bbbc"
