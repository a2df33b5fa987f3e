"""The pipeline's stages, each against a plain version, over what the stage before kept."""

import re
from collections import defaultdict

import numpy as np

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BOILER = "This line stands in a great many of the documents at hand, word for word."


def corpus():
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(5000)]
    out, kind = {}, {}
    for i in range(120):
        text = " ".join(rng.choice(words, 90))
        kind[i] = "clean"
        if i % 6 == 1:
            text += " you idiot, moron and pathetic loser, stupid clown"
            kind[i] = "toxic"
        elif i % 6 == 2:
            text, kind[i] = " ".join(rng.choice(words, 20)), "short"
        elif i % 6 == 3:
            text, kind[i] = "spam and eggs " * 40, "repeated"
        elif i % 6 == 4:
            text += "\n" + BOILER
        elif i % 12 == 5:
            near = out[i - 5].split()
            near[40] = "changed"
            text, kind[i] = " ".join(near), "near"
        out[i] = text
    return out, kind


def test_stages(spark, tmp_path):
    texts, kind = corpus()
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(kind[i] == "toxic")) for i in texts], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality", "line_dedup", "near_duplicates", "packing"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")

    now = stages["toxicity"](spark, now, str(tmp_path))
    kept = {r["doc_id"] for r in now.collect()}
    assert now.columns == COLUMNS and kept == {i for i in texts if kind[i] != "toxic"}

    now = stages["quality"](spark, now, str(tmp_path))
    kept = {r["doc_id"] for r in now.collect()}
    assert now.columns == COLUMNS and kept == {i for i in texts if kind[i] in ("clean", "near")}

    now = stages["line_dedup"](spark, now, str(tmp_path))
    last = max(i for i in kept if BOILER in texts[i])
    want = {i: texts[i] if i == last else texts[i].replace("\n" + BOILER, "") for i in kept}
    rows = now.collect()
    assert now.columns == COLUMNS and {r["doc_id"]: r["text"] for r in rows} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows)

    now = stages["near_duplicates"](spark, now, str(tmp_path))
    shingles = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, re.split(r"\s+", t)) for i, t in want.items())}
    stays = {i for i in want if not any(j < i and 100 * len(shingles[i] & shingles[j]) >= 80 * len(shingles[i] | shingles[j]) for j in want)}
    assert now.columns == COLUMNS and {r["doc_id"] for r in now.collect()} == stays and stays < set(want)

    at = defaultdict(int)
    for r in sorted(stages["packing"](spark, now, str(tmp_path)).collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]] and r["doc_id"] in stays
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 2048
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == stays


def test_stages_over_awkward_tables(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows, an empty table and extra columns, in every stage."""
    words = [f"w{k}" for k in range(3000)]
    rng = np.random.default_rng(5)
    clean = [" ".join(rng.choice(words, 80)) for _ in range(12)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)]
    rows += [(0, clean[0], "en", "s", 1), (20, clean[3], None, None, None), (None, clean[4], "en", None, 3), (None, None, None, None, None), (21, None, "en", "s", 0), (22, "", "en", "s", 0)]
    rows += [(23, " ".join(rng.choice(words, 60_000)), "en", "s", 9), (24, "\n".join([clean[5], BOILER]), "en", "s", 5)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], schema + ", score string, _row double")
    none = docs.where("doc_id < -1")
    spark.createDataFrame([(0, 1, 0), (1, None, 1), (None, 1, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    key = lambda r: (r["doc_id"], r["text"])
    for name, stage in stages.items():
        got = stage(spark, docs, str(tmp_path))
        assert stage(spark, none, str(tmp_path)).count() == 0
        if name == "packing":
            assert got.select("doc_id").distinct().count() == len({r[0] for r in rows})
            continue
        assert got.columns == docs.columns
        kept = sorted(map(str, map(key, got.collect())))
        if name == "toxicity":
            assert kept == sorted(str((i, t)) for i, t, *_ in rows)
        if name == "quality":
            assert not any(k.endswith(", None)") or k.endswith(", '')") for k in kept) and len(kept) >= 14
        if name == "line_dedup":
            assert kept == sorted(str((i, t or "")) for i, t, *_ in rows)
        if name == "near_duplicates":
            want = [(i, t) for i, t, *_ in rows[:12]] + [(None, clean[4]), (None, None), (21, None), (22, ""), (23, rows[-2][1])]
            assert kept == sorted(map(str, want))
