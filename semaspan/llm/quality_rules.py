"""Quality rules: counts of words, symbols and repeats, and the divergence from what a language looks like.

Each text gives two histograms, one of character classes and one of common words. They are compared with
references of the same language by Jensen-Shannon distance (base 2, so 0 to 1). A histogram takes part only
if it is long enough to mean something. Everything is a column expression over one row; the only shuffle is
the sum of the histograms by language, which is folded before it moves.

Defined results: a null text counts as empty, and an empty text has no words and fails the base rule. A row
without a language, or of one whose reference is too short, is compared with the reference over all
languages. Repeated rows give repeated results, an empty table an empty one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semaspan.session import stored

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[^#*$%&|<>]+"

# Character classes as patterns of what does not belong to them; what is left over is the last class.
CLASSES = {
    "upper": r"\P{Lu}+",
    "digit": r"\P{Nd}+",
    "ending": r"[^.,;:!?]+",
    "symbol": r"[^#*$%&|<>=+~^_\\@{}\[\]/-]+",
    "blank": r"[^\x20\x09-\x0D]+",
}

# Frequent function words of the languages that the histograms tell apart.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it"],
    "de": ["der", "die", "und", "den", "von", "zu", "mit", "ist"],
    "fr": ["le", "et", "les", "des", "un", "est", "dans", "pour"],
    "es": ["la", "que", "el", "en", "los", "del", "las", "por"],
}
VOCABULARY = [word for words in COMMON_WORDS.values() for word in words]

FEW_REPEATED = 500  # repeated windows of a text up to which they are looked up one by one
BASE_WORDS = 50  # base rule: fewer words fail
BASE_REPEATED = 50  # base rule: more than this percentage of words in repeated windows fails
LEAST_CHARS = 200  # shorter texts have no character verdict
LEAST_WORDS = 50  # texts with fewer words have no word verdict
LEAST_REFERENCE = 20_000  # characters that the reference of a language must hold
MOST_LANGUAGES = 1_000  # references up to which they are broadcast; of more, so many of the largest are salted
SALTS = 64
FAR_CLASSES = 0.18  # Jensen-Shannon distance of character classes above which a text goes
FAR_WORDS = 0.50  # the same for common words


def words_of(text: Column) -> Column:
    """Words of a text: runs of other characters than space, tab, newline, \\x0b, \\x0c and return."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def covered_by_repeats(sorted_windows: Column, width: int) -> Column:
    """Positions in windows that occur twice or more, from the (window, start) pairs of a text in order.

    Equal windows are neighbours; their starts, in order, each add what the next one does not cover.
    """
    size = F.size(sorted_windows)

    def repeated(pair: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(sorted_windows, i - 1)["w"] == pair["w"]).otherwise(False)
        after = F.when(i + 1 < size, F.get(sorted_windows, i + 1)["w"] == pair["w"]).otherwise(False)
        return before | after

    starts = F.array_sort(F.transform(F.filter(sorted_windows, repeated), lambda pair: pair["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.cast("int").alias("last"), (acc["n"] + F.least(F.lit(width), i - acc["last"])).cast("long").alias("n")),
    )
    return covered["n"]


def common_words(words: Column) -> Column:
    """The words of VOCABULARY among the words of a text, in any case, each between spaces of its own."""
    spaced = F.lower(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))
    found = F.regexp_extract_all(spaced, F.lit("(?<= )(" + "|".join(VOCABULARY) + ")(?= )"), F.lit(1))
    return F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" "))


def counted(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, lang, counts and histograms) of each text; one narrow pass. Column `doc` is carried along."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col(doc).alias("doc"), F.col("lang").alias("lang"), text.alias("text"), words_of(text).alias("words"))
    n = F.size("words")
    places = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(places, lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    length = F.length("text").cast("long")

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace("text", pattern, "")).cast("long")

    classes = {name: left(pattern) for name, pattern in CLASSES.items()}
    rows = rows.select(
        "doc",
        "lang",
        n.cast("long").alias("n_words"),
        length.alias("n_chars"),
        left(SYMBOLS).alias("n_symbols"),
        lines.alias("lines"),
        "words",
        hashes.alias("hashes"),
        F.array(*classes.values()).alias("classes"),
        common_words(F.col("words")).alias("common"),
    )
    # windows whose hash is alone in the text are alone themselves; only the others are compared word by word
    several = F.size(F.array_distinct("hashes")) < F.size("hashes")
    ordered = F.when(several, F.sort_array("hashes"))
    rows = rows.select("*", ordered.alias("ordered")).select(
        "*", F.array_distinct(F.filter("ordered", lambda h, i: (i > 0) & (h == F.get("ordered", i - 1)))).alias("repeated")
    )
    every = F.sequence(F.lit(0), F.size("hashes") - 1)
    few = F.filter(every, lambda i: F.array_contains("repeated", F.get("hashes", i)))
    starts = F.when(F.size("repeated") <= FEW_REPEATED, few).otherwise(every)  # a plan for long texts, the same result
    rows = rows.withColumn("starts", F.when(F.col("repeated").isNotNull(), starts))
    windows = F.transform(
        "starts",
        lambda i: F.struct(
            F.concat_ws(" ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("w"), i.alias("i")
        ),
    )
    rows = rows.withColumn("windows", F.sort_array(windows))
    blank = F.get("classes", list(CLASSES).index("blank"))

    def times(word: str) -> Column:
        rest = F.length(F.replace("common", F.lit(f" {word} "), F.lit("")))
        return F.floor((F.length("common") - rest) / (len(word) + 2)).cast("long")

    def with_rest(histogram: Column, of: str) -> Column:
        return F.concat(histogram, F.array(F.col(of) - F.aggregate(histogram, F.lit(0).cast("long"), lambda a, x: a + x)))

    rows = rows.select(
        "doc",
        "lang",
        "n_words",
        (F.col("n_chars") - blank).alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered_by_repeats(F.col("windows"), 3), F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_chars",
        "classes",
        F.array(*[times(word) for word in VOCABULARY]).alias("common"),
    )
    return rows.withColumns({"classes": with_rest(F.col("classes"), "n_chars"), "common": with_rest(F.col("common"), "n_words")})


def references(counts: DataFrame) -> DataFrame:
    """(lang, ref_chars, ref_classes, ref_common): the usual shares of a language, and of all texts under a null language.

    Character classes take the median share over texts, so that junk in the corpus does not bend them; common
    words take the share over all words. Every row takes part, one row a language comes out, and both kinds
    are folded before the shuffle.
    """
    n_classes, n_common = len(CLASSES) + 1, len(VOCABULARY) + 1
    long_enough = F.col("n_chars") >= LEAST_CHARS
    sums = [
        *[F.percentile_approx(F.when(long_enough, F.get("classes", i) / F.col("n_chars")), 0.5, 1000).alias(f"classes_{i}") for i in range(n_classes)],
        *[F.try_divide(F.sum(F.get("common", i)), F.sum("n_words")).alias(f"common_{i}") for i in range(n_common)],
    ]
    # the grouping sets give the row of each language and the one of all
    both = counts.rollup("lang").agg(F.grouping("lang").alias("all"), F.sum("n_chars").alias("ref_chars"), *sums)
    both = both.filter((F.col("all") == 1) | (F.col("lang").isNotNull() & (F.col("ref_chars") >= LEAST_REFERENCE)))
    medians = F.array(*[f"classes_{i}" for i in range(n_classes)])
    total = F.aggregate(medians, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return both.select("lang", "ref_chars", F.transform(medians, lambda x: F.try_divide(x, total)).alias("ref_classes"), F.array(*[f"common_{i}" for i in range(n_common)]).alias("ref_common"))


def jensen_shannon(counts: Column, total: Column, shares: Column) -> Column:
    """Jensen-Shannon distance, 0 to 1, of a histogram (counts with their sum) from reference shares; null if empty."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def term(n: Column, y: Column) -> Column:
        x = F.try_divide(n, total)
        return (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2

    divergence = F.aggregate(F.zip_with(counts, shares, term), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.sqrt(F.greatest(divergence, F.lit(0.0))))


def with_references(counts: DataFrame, known: DataFrame) -> DataFrame:
    """`counts` with the reference of its language, if that has one: broadcast if they are few, else joined."""
    if known.count() <= MOST_LANGUAGES:
        return counts.join(F.broadcast(known.drop("ref_chars")), "lang", "left")
    hot = known.orderBy(F.desc("ref_chars"), "lang").limit(MOST_LANGUAGES).select("lang", F.lit(True).alias("hot"))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = known.drop("ref_chars").join(F.broadcast(hot), "lang", "left").withColumn("salt", F.explode(salts)).drop("hot")
    # rows without a language have no reference, and are dealt by salt too
    salt = F.when(F.col("hot") | F.col("lang").isNull(), F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).otherwise(0)
    return counts.join(F.broadcast(hot), "lang", "left").withColumn("salt", salt).drop("hot").join(salted, ["lang", "salt"], "left").drop("salt")


def verdicts(counts: DataFrame, refs: DataFrame, far_classes: float = FAR_CLASSES, far_words: float = FAR_WORDS) -> DataFrame:
    """(doc, counts, base_failed, class_distance, word_distance, kept) of counted texts."""
    fallback = refs.filter("lang IS NULL").select(F.col("ref_classes").alias("all_classes"), F.col("ref_common").alias("all_common"))
    known = refs.filter("lang IS NOT NULL")
    rows = with_references(counts, known).join(F.broadcast(fallback), F.lit(True), "left")  # `fallback` is one row
    classes = jensen_shannon(F.col("classes"), F.col("n_chars"), F.coalesce("ref_classes", "all_classes"))
    words = jensen_shannon(F.col("common"), F.col("n_words"), F.coalesce("ref_common", "all_common"))
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATED * F.col("n_words"))
    judged = rows.select(
        "doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.when(F.col("n_chars") >= LEAST_CHARS, classes).alias("class_distance"),
        F.when(F.col("n_words") >= LEAST_WORDS, words).alias("word_distance"),
    )
    far = (F.coalesce("class_distance", F.lit(0.0)) > far_classes) | (F.coalesce("word_distance", F.lit(0.0)) > far_words)
    return judged.withColumn("kept", ~F.col("base_failed") & ~far)


def quality_rules(docs: DataFrame, far_classes: float = FAR_CLASSES, far_words: float = FAR_WORDS) -> DataFrame:
    """(doc_id, counts, base_failed, class_distance, word_distance, kept) for each row of `docs`.

    The counts are stored once, as they are read twice: for the references and for the verdicts.
    """
    counts = stored(counted(docs))
    return verdicts(counts, stored(references(counts)), far_classes, far_words).withColumnRenamed("doc", "doc_id")


def kept_documents(docs: DataFrame) -> DataFrame:
    """Rows of `docs` that the rules keep, with all their columns and without a shuffle of their texts.

    The references take a pass of their own, which counts only what they need. The judged rows are stored
    before they are filtered: Spark would push the filter below the counts and compute them for each element.
    """
    refs = stored(references(counted(docs)))
    whole = docs.select(F.struct(*docs.columns).alias("row"), "text", "lang")
    judged = stored(verdicts(counted(whole, "row"), refs).select("doc", "kept"))
    return judged.filter("kept").select("doc.*")
