"""Quality rules (operator 8): distribution divergence, in DataFrame functions only.

Each text's character-class histogram and common-word histogram is compared
with the mean histograms of its language, by Jensen-Shannon distance. Short
texts have no reliable histogram and are guarded by minimum lengths. Counting
rules (repeated lines and windows, symbols) stand beside it.

Nothing is exploded: all counts are array expressions within a row, so there is
no shuffle but that of the language references (one row per language and task).

Contract: one row per document row; null texts have no words and fail; a null
language is compared with the documents that have none; repeated rows each give
a row; texts of any length are counted whole; other columns are ignored. Windows
are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.llm.text import stored

BLANK = r"[\x20\x09-\x0D]"
WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, German, French and Spanish prose.
COMMON_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "was",
    "der", "die", "und", "das", "den", "ist", "nicht",
    "de", "la", "le", "et", "les", "des", "un", "que",
    "el", "y", "los", "en", "se",
]
_FORMS = [f for w in COMMON_WORDS for f in dict.fromkeys((w, w.capitalize()))]

CLASSES = ["c_lower", "c_upper", "c_digit", "c_blank", "c_stop", "c_symbol", "c_other"]
WORDS = [f"w_{i}" for i in range(len(COMMON_WORDS))] + ["w_rest"]

#: Documents of more than so many languages are not expected; beyond, references are joined without a broadcast.
BROADCAST_LANGUAGES = 10_000


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _times(column: str, word: str) -> Column:
    """How often a word stands in a string of words between spaces, also with a capital."""
    bare = F.col(column)
    for form in dict.fromkeys((word, word.capitalize())):
        bare = F.replace(bare, F.lit(f" {form} "), F.lit(""))
    return ((F.octet_length(column) - F.octet_length(bare)) / (len(word.encode()) + 2)).cast("int")


def counted(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Per document: its id, language, word and line counts, and both histograms as counts."""
    lang = F.coalesce(F.col(lang_column).cast("string"), F.lit("")) if lang_column in docs.columns else F.lit("")
    df = docs.select(F.col(id_column).alias("doc_id"), lang.alias("lang"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    df = df.select(
        "doc_id", "lang", F.array_remove(F.split("text", BLANK + "+"), "").alias("words"), F.length("text").alias("n_chars"),
        # All other classes are counted on what is left without lower-case letters.
        F.regexp_replace("text", "[a-z]+", "").alias("rest"),
        F.filter(F.split("text", "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "").alias("lines"),
    )
    df = df.select(
        "doc_id", "lang", "words", "n_chars", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length("rest").alias("n_rest"), F.octet_length("rest").alias("rest_bytes"), F.octet_length(without(F.col("rest"), SYMBOLS)).alias("not_symbol"),
        F.octet_length(without(F.col("rest"), ".,;:!?")).alias("not_stop"), F.length(F.regexp_replace("rest", "[A-Z]+", "")).alias("not_upper"), F.length(F.regexp_replace("rest", "[0-9]+", "")).alias("not_digit"),
        # Each common word stands between two spaces, so its places can be counted by taking it out.
        F.concat(F.lit(" "), F.array_join(F.filter("words", lambda w: w.isin(_FORMS)), "  "), F.lit(" ")).alias("common"),
    )
    # Hashes of 2, 4, then 8 consecutive words.
    pair = lambda column, step: F.zip_with(column, F.slice(column, step + 1, F.greatest(F.size(column) - step, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("hashes", pair("words", 1)).withColumn("hashes", pair("hashes", 2)).withColumn("hashes", pair("hashes", 4))
    df = df.select(
        "doc_id", "lang", "n_words", "word_chars", (F.col("rest_bytes") - F.col("not_symbol")).cast("long").alias("n_symbols"), "n_dup_lines",
        F.slice("hashes", 1, F.greatest(F.size("hashes") - (WINDOW - 1), F.lit(0))).alias("hashes"),
        (F.col("n_chars") - F.col("n_rest")).alias("c_lower"), (F.col("n_rest") - F.col("not_upper")).alias("c_upper"), (F.col("n_rest") - F.col("not_digit")).alias("c_digit"),
        (F.col("n_chars") - F.col("word_chars")).alias("c_blank"), (F.col("rest_bytes") - F.col("not_stop")).alias("c_stop"), (F.col("rest_bytes") - F.col("not_symbol")).alias("c_symbol"), "n_chars",
        *[_times("common", w).alias(f"w_{i}") for i, w in enumerate(COMMON_WORDS)],
    )
    df = df.withColumn("c_other", F.col("n_chars") - sum(F.col(c) for c in CLASSES[:-1])).withColumn("w_rest", F.col("n_words") - sum(F.col(c) for c in WORDS[:-1]))
    # Only texts with a window twice are sorted.
    ranked = F.when(
        F.size(F.array_distinct("hashes")) < F.size("hashes"),
        F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    df = df.withColumn("ranked", ranked).drop("hashes", "n_chars")
    same = F.filter(
        F.transform("ranked", lambda x, k: F.when(
            (x["h"] == F.get("ranked", k - 1)["h"]) | (x["h"] == F.get("ranked", k + 1)["h"]), x["i"])),
        lambda i: i.isNotNull(),
    )
    df = df.withColumn("twice", F.sort_array(same)).drop("ranked")
    covered = F.aggregate(
        F.transform("twice", lambda i, k: F.least(F.lit(WINDOW), i - F.coalesce(F.get("twice", k - 1), i - WINDOW))),
        F.lit(0).cast("long"), lambda total, n: total + n,
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("twice")


def _parts(names: list[str]) -> list[Column]:
    total = sum(F.col(n) for n in names)
    return [F.coalesce(F.col(n) / F.when(total > 0, total), F.lit(0.0)) for n in names]


def references(counts: DataFrame, min_words: int) -> DataFrame:
    """Mean histograms of each language over its texts of at least `min_words` words."""
    shares = counts.filter(F.col("n_words") >= min_words).select("lang", *[p.alias(n) for names in (CLASSES, WORDS) for n, p in zip(names, _parts(names))])
    means = shares.groupBy("lang").agg(*[F.avg(n).alias(n) for n in CLASSES + WORDS])
    return means.select("lang", F.array(*CLASSES).alias("ref_classes"), F.array(*WORDS).alias("ref_words"))


def js_distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histogram columns that sum to one."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) / 2))


def apply_rules(
    docs: DataFrame, max_class_distance: float = 0.2, class_slack: float = 0.8, max_word_distance: float = 0.6, min_chars: int = 300, min_words: int = 100,
    max_symbol_distance: float = 0.13,
    id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
) -> DataFrame:
    """Per document: counts, base_failed, the distances, and kept.

    A text is kept if the counting rules pass and, where it is long enough for
    a histogram (`min_chars` characters in words, `min_words` words), no
    distance to its language is above its limit. Symbols are few in any prose,
    so the histogram of symbols against all else is compared on its own, too. A
    short text's histogram is noisier, so its class limits are wider by
    `class_slack` over the square root of its characters.
    """
    # Written once: the references and the verdicts both read it, without the texts.
    counts = stored(counted(docs, id_column, text_column, lang_column), "quality-counts")
    refs = references(counts, min_words)
    few = refs.limit(BROADCAST_LANGUAGES + 1).collect()
    small = len(few) <= BROADCAST_LANGUAGES
    refs = docs.sparkSession.createDataFrame(few, refs.schema) if small else refs
    joined = counts.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.array(*_parts(CLASSES)).alias("classes"), F.array(*_parts(WORDS)).alias("commons"),
    ).join(F.broadcast(refs) if small else refs, "lang", "left")
    symbols = lambda c: F.array(F.col(c)[CLASSES.index("c_symbol")], 1 - F.col(c)[CLASSES.index("c_symbol")])
    judged = joined.withColumns({"symbols": symbols("classes"), "ref_symbols": symbols("ref_classes")}).withColumns({
        "class_distance": js_distance("classes", "ref_classes"), "word_distance": js_distance("commons", "ref_words"),
        "symbol_distance": js_distance("symbols", "ref_symbols")})
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    slack = class_slack / F.sqrt(F.greatest("word_chars", F.lit(1)))
    classes_far = (F.col("class_distance") > max_class_distance + slack) | ((F.col("symbol_distance") > max_symbol_distance + slack / 4) & (F.col("classes")[CLASSES.index("c_symbol")] > F.col("ref_classes")[CLASSES.index("c_symbol")]))
    too_far = ((F.col("word_chars") >= min_chars) & classes_far) | ((F.col("n_words") >= min_words) & (F.col("word_distance") > max_word_distance))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        (~base_failed & ~F.coalesce(too_far, F.lit(False))).alias("kept"),
        "class_distance", "word_distance", "symbol_distance",
    )
