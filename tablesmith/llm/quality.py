"""Quality rules: base rules on counts, then divergence from language references.

A document's histogram of character classes and its histogram of the language's common
words are compared with the references of its language by the Jensen-Shannon distance
(square root of the divergence in bits, 0 to 1). References are counted over all
documents of a language: character classes from whole texts, and as common words the
`n_common` most frequent words of at most `common_letters` letters, so the table of counts
stays small; all other words are one more bin of that histogram, so a text without the
common words is far from its language. The limit of the word distance is a share of the
distance that such a text has, so languages with rarer common words have a lower one. A document without a language is compared with the reference of all
documents that have none. Documents under the length guards are not judged by distance;
for words the guard also asks that a text of that length be expected to hold a few common
words, so a language without common words of its own judges nobody by them.

Everything is a DataFrame expression; repeated three-word windows are found inside the
document's own arrays, by sorting 64-bit hashes of the windows, so no row leaves its
task. Only the references are joined, one row per language.

Defined results: a NULL text has no words and fails the base rules; ties between equally
frequent common words go by code point; equal rows are separate documents; an empty
table gives an empty result. Columns other than the three named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.llm.common import WORD, WS, stored, text_of, words_of

SYMBOLS = r"[#*$%&|<>]"
# classes counted in what is left without lower-case letters and white space: most texts' short rest
PLAIN = r"[\p{Ll}\x20\x09-\x0D]+"
CLASSES = (r"\p{Lu}", r"\p{Nd}", r"[.,;:!?'()-]", SYMBOLS)
FEW = 16  # repeated windows that are looked up one by one; more are found by sorting
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
N_COMMON = 24
COMMON_LETTERS = 4
MIN_CHARS = 200
MIN_DISTANCE_WORDS = 50
BROADCAST_LANGS = 5_000
MAX_CLASS_DISTANCE = 0.30
# Share of the distance that a text without any common word has from its own language's reference.
MAX_WORD_SHARE = 0.94
# A document is judged by its words if this many of them are common words in an average text of its length.
MIN_EXPECTED = 5
DIGITS = 9  # distances are rounded, so that their sums' order does not show


def base_counts(docs: DataFrame, doc_id: str, lang: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, ws (the words), keep."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(lang), F.lit("")).alias("_lang"),
                    text_of(text).alias("_t"), *keep)
    d = d.withColumn("ws", words_of(F.col("_t")))
    d = d.withColumn("n_words", F.size("ws").cast("long"))
    d = d.withColumn("word_chars", F.coalesce(F.length(F.array_join("ws", "")), F.lit(0)).cast("long"))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD))
    d = d.withColumn("_lines", lines)
    d = d.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    d = with_classes(d)
    d = d.withColumn("n_symbols", F.get("classes", F.lit(CLASSES.index(SYMBOLS))))
    return d.drop("_t", "_lines")


def with_classes(d: DataFrame) -> DataFrame:
    """Add classes from _t and word_chars: characters of each of CLASSES, lower-case letters, all others."""
    d = d.withColumn("_o", F.regexp_replace("_t", PLAIN, "")).withColumn("_no", F.length("_o").cast("long"))
    counts = [(F.col("_no") - F.length(F.regexp_replace("_o", c + "+", ""))).cast("long") for c in CLASSES]
    d = d.withColumn("_c", F.array(*counts))
    d = d.withColumn("classes", F.concat("_c", F.array(
        F.col("word_chars") - F.col("_no"),
        F.col("_no") - F.aggregate("_c", F.lit(0).cast("long"), lambda a, x: a + x))))
    return d.drop("_o", "_no", "_c")


def repeated_words(d: DataFrame) -> DataFrame:
    """Add n_repeat_words from ws: words in three-word windows found twice or more."""
    windows = F.when(F.col("n_words") >= 3, F.transform(
        F.sequence(F.lit(0), F.col("n_words").cast("int") - 3),
        lambda i: F.xxhash64(F.get("ws", i), F.get("ws", i + 1), F.get("ws", i + 2)))).otherwise(
        F.array().cast("array<bigint>"))
    d = d.withColumn("_h", windows).withColumn("_o", F.sort_array("_h"))
    d = d.withColumn("_q", F.array_distinct(F.filter("_o", lambda x, k: x == F.get("_o", k - 1)))).drop("_o")
    where = F.array_compact(F.transform("_h", lambda h, i: F.when(F.array_contains("_q", h), i)))
    sort = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_s", F.when(F.size("_q") > FEW, sort))
    twice = F.filter("_s", lambda x, k: x["h"].eqNullSafe(F.get("_s", k - 1)["h"]) | x["h"].eqNullSafe(F.get("_s", k + 1)["h"]))
    d = d.withColumn("_r", F.when(F.size("_q") == 0, F.array().cast("array<int>")).when(
        F.size("_q") <= FEW, where).otherwise(F.transform(twice, lambda x: x["i"])))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_r", lambda i: F.array(i, i + 1, i + 2)))))
    return d.withColumn("n_repeat_words", covered.cast("long")).drop("_h", "_q", "_s", "_r")


def references(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """One row per language: _lang, ref_classes, common (words), ref_words (their counts, then all other words), none_distance, common_share."""
    d = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("_lang"), text_of(text).alias("_t"))
    total = with_classes(d.withColumn("word_chars", F.length(F.regexp_replace("_t", WS, "")).cast("long")))
    n = len(CLASSES) + 2
    total = total.withColumn("_words", F.regexp_count("_t", F.lit(WORD)).cast("long"))
    total = total.groupBy("_lang").agg(*[F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(n)],
                                       F.sum("_words").alias("_words"))
    classes = total.select("_lang", "_words", F.array(*[F.col(f"c{i}") for i in range(n)]).alias("ref_classes"))
    short = rf"(?<![^\x20\x09-\x0D])\p{{L}}{{1,{COMMON_LETTERS}}}(?![^\x20\x09-\x0D])"
    w = d.select("_lang", F.explode(F.regexp_extract_all(F.lower("_t"), F.lit(short), F.lit(0))).alias("word"))
    w = w.groupBy("_lang", "word").agg(F.count("*").alias("n"))
    top = Window.partitionBy("_lang").orderBy(F.desc("n"), "word")
    w = w.withColumn("r", F.row_number().over(top)).where(F.col("r") <= N_COMMON)
    w = w.groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct("r", "word", "n"))).alias("t"))
    n = F.coalesce(F.col("t.n"), F.array().cast("array<bigint>"))
    other = F.col("_words") - F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)
    refs = classes.join(w, "_lang", "left").select(
        "_lang", "ref_classes", F.coalesce(F.col("t.word"), F.array().cast("array<string>")).alias("common"),
        F.concat(n, F.array(other)).alias("ref_words"))
    # a text without a common word: all its words are other words
    refs = refs.withColumn("_none", F.transform("ref_words", lambda x, i: (i == F.size("ref_words") - 1).cast("int")))
    share = F.try_divide(_total("ref_words") - F.element_at("ref_words", -1), _total("ref_words"))
    return with_distance(refs, "_none", "ref_words", "none_distance").withColumn("common_share", share).drop("_none")


def _total(a: str) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def js_distance(a: str, b: str) -> Column:
    """Jensen-Shannon distance of two histograms of one length; 0 where either is empty."""
    def term(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    pairs = F.zip_with(F.transform(a, lambda x: x / F.col("_na")), F.transform(b, lambda y: y / F.col("_nb")),
                       lambda x, y: (term(x, y) + term(y, x)) / 2)
    div = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
    return F.when((F.col("_na") > 0) & (F.col("_nb") > 0), F.sqrt(F.greatest(div, F.lit(0.0)))).otherwise(0.0)


def with_distance(d: DataFrame, a: str, b: str, out: str) -> DataFrame:
    d = d.withColumn("_na", _total(a)).withColumn("_nb", _total(b))
    return d.withColumn(out, F.round(js_distance(a, b), DIGITS)).drop("_na", "_nb")


def judge(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang", text: str = "text",
          keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, the counts, class_distance, word_distance, base_failed, kept, and `keep`."""
    refs = stored(references(docs, lang, text), "references")
    if refs.count() <= BROADCAST_LANGS:  # about 1 kB each
        refs = F.broadcast(refs)
    d = base_counts(docs, doc_id, lang, text, keep).join(refs, "_lang")
    d = repeated_words(d)
    low = F.filter(F.transform("ws", lambda x: F.when(F.length(x) <= COMMON_LETTERS, F.lower(x))),
                   lambda x: F.array_contains("common", x))
    d = d.withColumn("_w", low)
    d = d.withColumn("_cw", F.transform("common", lambda c: F.size("_w") - F.size(F.array_remove("_w", c))))
    d = d.withColumn("_cw", F.concat("_cw", F.array((F.col("n_words") - F.size("_w")).cast("int")))).drop("ws", "_w")
    d = with_distance(d, "classes", "ref_classes", "class_distance")
    d = with_distance(d, "_cw", "ref_words", "word_distance")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    d = d.withColumn("base_failed", failed)
    far = ((F.col("word_chars") >= MIN_CHARS) & (F.col("class_distance") > MAX_CLASS_DISTANCE)) | (
        (F.col("n_words") >= MIN_DISTANCE_WORDS) & (F.col("n_words") * F.coalesce("common_share", F.lit(0.0)) >= MIN_EXPECTED) & (F.col("word_distance") > MAX_WORD_SHARE * F.col("none_distance")))
    out = F.struct("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                   "class_distance", "word_distance", "base_failed", (~failed & ~far).alias("kept"), *keep)
    # a filter on the result must not be pushed below: it would repeat all the expressions above, many times over
    return d.select(F.explode_outer(F.array(out)).alias("out")).select("out.*")
