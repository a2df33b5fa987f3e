"""Quality rules with thresholds that adapt to each language and source. DataFrame functions only.

Method. Five measures of each document (share of symbols, share of equal lines, share of words in
repeated 3-word windows, mean word length, length in words) go into mergeable KLL quantile
sketches, one for each (lang, source): partial sketches are made before the shuffle and merged
after it, so a source with a third of all rows costs each task one sketch. The thresholds are read
from the merged sketches, FENCE spreads (quartile to median, with a floor) beyond the quartiles on
the bad side, and joined back to the measures on (lang, source). Fixed rules (``base_failed``)
still reject; the method's verdict rejects what lies beyond its group's fence. A group of under
MIN_GROUP documents takes the fence of its language, and a language of under MIN_GROUP that of all
documents, both from the groups' sketches merged once more. The sketches hold K values a level and
are exact below K rows.

Defined results: a null or empty text has no words and fails the fixed rules; null languages and
sources are groups of their own; repeated rows count as often as they occur, and get one verdict each; an empty table gives
an empty table; other input columns are left out of measures() and kept by keep().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import runtime

#: Characters between words.
BLANK = "[\\x20\\x09-\\x0D]+"
#: Spreads beyond the quartile; six from quartile to median are Tukey's outer fence.
FENCE = 6.0
MIN_GROUP = 50
K = 400
#: Smallest spread of a measure, so that a group of equal documents rejects nothing by rounding. A group without
#: symbols or repeats tolerates FENCE floors: 6 % of symbols, 12 % of equal lines or repeated words.
FLOOR = {"symbol_share": 0.01, "dup_line_share": 0.02, "repeat_share": 0.02, "mean_word": 0.1, "log_words": 0.1}
#: Measures for which only large values are bad.
UPPER = ("symbol_share", "dup_line_share", "repeat_share")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def bind(value: Column, body) -> Column:
    """body(value) with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur at least twice.

    Windows whose hashes all differ have none. Else the hashes are sorted with their places; equal
    neighbours mark both places; the marked places, in order, cover three words each.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    placed = lambda hs: F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def marked(s: Column) -> Column:
        twins = F.zip_with(
            F.slice(s, F.lit(1), F.size(s) - 1),
            F.slice(s, F.lit(2), F.size(s) - 1),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
        )
        return F.array_sort(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("total"))
        return F.aggregate(places, start, lambda s, p: F.struct(p.alias("last"), (s["total"] + F.least(F.lit(3), p - s["last"])).alias("total")), lambda s: s["total"])

    none = F.lit(0).cast("bigint")
    count = lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), none).otherwise(bind(placed(hs), lambda s: covered(marked(s))))
    return F.when(n < 4, none).otherwise(bind(hashes, count))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: str | None = None) -> DataFrame:
    """The id, lang, source, the five counts and the measures of each document; under the name ``carry``, its whole row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    more = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(carry)] if carry else []
    kept = [carry] if carry else []
    base = docs.select(*more, F.col(id_col), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), text.alias("_t"))
    edges = F.lit(" \t\n\x0b\x0c\r")
    inner = F.btrim(F.col("_t"), edges)
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK))
    symbols = F.length("_t") - F.length(F.translate(F.col("_t"), "#*$%&|<>", ""))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.btrim(x, edges) != "")
    dup = bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    chars = F.length(F.translate(F.col("_t"), " \t\n\x0b\x0c\r", ""))

    counts = base.select(
        *kept,
        id_col,
        "lang",
        "source",
        bind(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeated_words(w).alias("r"))).alias("_w"),
        chars.cast("bigint").alias("word_chars"),
        symbols.cast("bigint").alias("n_symbols"),
        dup.cast("bigint").alias("n_dup_lines"),
        F.size(lines).alias("_lines"),
    )
    n = F.greatest(F.col("_w.n"), F.lit(1)).cast("double")
    return counts.select(
        *kept,
        id_col,
        "lang",
        "source",
        F.col("_w.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.col("_w.r").alias("n_repeat_words"),
        (F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))).alias("symbol_share"),
        (F.col("n_dup_lines") / F.greatest(F.col("_lines"), F.lit(1))).alias("dup_line_share"),
        (F.col("_w.r") / n).alias("repeat_share"),
        (F.col("word_chars") / n).alias("mean_word"),
        F.log1p(F.col("_w.n").cast("double")).alias("log_words"),
    )


def thresholds(measured: DataFrame) -> DataFrame:
    """Per (lang, source): the fence of each measure, from the merged sketches of the least of group, language and whole that has MIN_GROUP documents, or else of the whole."""
    sketches = measured.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("_n"), *[F.kll_sketch_agg_double(F.col(m), F.lit(K)).alias(m) for m in FLOOR])
    sketches = runtime.store(sketches, "quality-sketches")

    def merged(of: str) -> list[Column]:
        return [F.sum("_n").alias(f"_n_{of}"), *[F.kll_merge_agg_double(F.col(m), F.lit(K)).alias(f"{m}_{of}") for m in FLOOR]]

    by_lang = sketches.groupBy(F.col("lang").alias("_of")).agg(*merged("lang"))
    whole = sketches.agg(*merged("all"))
    wide = sketches.join(F.broadcast(by_lang), F.col("lang").eqNullSafe(F.col("_of"))).crossJoin(F.broadcast(whole))

    def chosen(m: str) -> Column:
        return F.when(F.col("_n") >= MIN_GROUP, F.col(m)).when(F.col("_n_lang") >= MIN_GROUP, F.col(f"{m}_lang")).otherwise(F.col(f"{m}_all"))

    sketches = wide.select("lang", "source", *[chosen(m).alias(m) for m in FLOOR])

    def q(m: str, p: float) -> Column:
        return F.kll_sketch_get_quantile_double(F.col(m), F.lit(p))

    out = [F.col("lang").alias("_lang"), F.col("source").alias("_source")]
    for m, floor in FLOOR.items():
        spread = lambda a, b, m=m, floor=floor: F.greatest(q(m, a) - q(m, b), F.lit(floor))
        out.append((q(m, 0.75) + FENCE * spread(0.75, 0.5)).alias(f"{m}_most"))
        if m not in UPPER:
            out.append((q(m, 0.25) - FENCE * spread(0.5, 0.25)).alias(f"{m}_least"))
    return sketches.select(*out)


def verdicts(measured: DataFrame) -> DataFrame:
    """measured with base_failed and kept. The measures are stored once, since two passes read them."""
    measured = runtime.store(measured, "quality")
    fences = thresholds(measured)
    joined = measured.join(fences, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    beyond = F.lit(False)
    for m in FLOOR:
        beyond = beyond | (F.col(m) > F.col(f"{m}_most"))
        if m not in UPPER:
            beyond = beyond | (F.col(m) < F.col(f"{m}_least"))
    return joined.select(*measured.columns, failed.alias("base_failed"), (~failed & ~beyond).alias("kept"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, which are stored beside the measures: no text is shuffled."""
    found = verdicts(measures(docs, id_col, text_col, lang_col, source_col, carry="_row"))
    return found.where("kept").select("_row.*")
