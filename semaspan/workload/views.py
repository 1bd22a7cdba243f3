"""Corpora, annotations, ratings and scores derived from the given tables.

Each view is defined twice, here and as a named SQL query in `oracles`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from semaspan.operators.constructions import parsed_objects, parsed_verbs, sentence_hits
from semaspan.operators.cooccurrence import cooccurrences
from semaspan.operators.vocabulary import select_basis, target_words, token_frequencies
from semaspan.operators.weighting import ppmi
from semaspan.plans.scans import spread
from semaspan.session import settle, stored
from semaspan.workload.tagging import TAG_BY_LENGTH, TAGGED_WORDS, UNCLASSIFIED_FROM  # noqa: F401 (the SQL reads them here)
from semaspan.workload.tagging import annotated_udf, elements_udf, parsed_udf, tagged_places, tagged_udf, words_udf

FREQ_MIN = 10
EXCLUDE_FIRST = 10
DIMENSION = 250
WINDOW = 5
MIN_LENGTH = 5
VOCABULARY = 50_000
LIGHT_VERBS, NOMINALS, PLAIN_VERBS = 10, 40, 60
MAX_PAIRS = LIGHT_VERBS * NOMINALS

SENTENCE = ["doc_id", "line_no"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, source, lang, line_no, line) of all documents."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "source", "lang", "text"), "doc_id")
    split = docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split.withColumn("line_no", F.col("line_no").cast("long"))


def spelled(spark: SparkSession, sf: str, **columns: Column) -> DataFrame:
    """(doc_id, source, lang, line_no) and columns made from `line` in lower case."""
    keys = ["doc_id", "source", "lang", "line_no"]
    return lines(spark, sf).select(*keys, F.lower("line").alias("line")).select(*keys, *[c.alias(n) for n, c in columns.items()])


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, source, lang, line_no, words, ws): plain and tagged tokens of each line."""
    return spelled(spark, sf, words=words_udf("line"), ws=tagged_udf("line"))


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, source, lang, line_no, value): the corpus as prepared lines."""
    value = F.concat(F.array_join("ws", " "), F.lit(" "))
    return sentences(spark, sf).select("doc_id", "source", "lang", "line_no", value.alias("value"))


def xml_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, line_no, xml): the sentences as XML, some tokens marked as truncated."""
    opening = F.concat(F.lit('<s n="'), F.col("line_no"), F.lit('">'))
    xml = F.concat(opening, "body", F.lit('<c c5="PUN">.</c></s>'))
    return spelled(spark, sf, body=elements_udf("line")).select(*SENTENCE, xml.alias("xml"))


def annotated(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, line_no, id, lemma, upos, deprel, head) with objects up to three tokens after a verb."""
    read = spelled(spark, sf, annotated=annotated_udf("line", "line_no")).select(*SENTENCE, F.inline("annotated"))
    return read.select(*SENTENCE, F.col("id").cast("long"), "lemma", "upos", "deprel", F.col("head").cast("long"))


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, line_no, ws, annotated): the tokens of `annotated` as one array for each sentence."""
    made = spelled(spark, sf, ws=tagged_udf("line"), annotated=annotated_udf("line", "line_no"))
    return made.select(*SENTENCE, "ws", "annotated")


def parsed_whole(spark: SparkSession, sf: str) -> DataFrame:
    """`parsed` for readers of both its arrays: they are made together, so neither is left out where it is not read."""
    return spelled(spark, sf, parsed=parsed_udf("line", "line_no")).select(*SENTENCE, "parsed.ws", "parsed.annotated")


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """(pair, kind, row, score) from all events."""
    events = spread(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value"), "event_id")
    return events.select(
        F.concat_ws("_", "event_type", F.col("user_id") % 5).alias("pair"),
        F.when(F.col("event_id") % 2 == 1, "LVC").otherwise("FVC").alias("kind"),
        F.col("event_id").alias("row"),
        F.col("value").alias("score"),
    )


def paired(spark: SparkSession, sf: str) -> DataFrame:
    """(id, fvc, lvc): mean price of the accepted and the returned lines of each supplier."""
    price, flag = F.col("l_extendedprice"), F.col("l_returnflag")
    means = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(
        F.avg(F.when(flag == "A", price)).alias("fvc"), F.avg(F.when(flag == "R", price)).alias("lvc")
    )
    return means.filter("fvc IS NOT NULL AND lvc IS NOT NULL")


@dataclass(frozen=True)
class Space:
    """Vocabulary and vectors of the corpus; frequencies and counts are settled once."""

    spark: SparkSession
    sf: str

    @cached_property
    def sentences(self) -> DataFrame:
        return sentences(self.spark, self.sf)

    @cached_property
    def untagged(self) -> DataFrame:
        """(doc_id, source, lang, line_no, line): for operators that tag the words of a line and count them at once."""
        return spelled(self.spark, self.sf, line=F.col("line"))

    @cached_property
    def freqs(self) -> DataFrame:
        return settle(token_frequencies(self.untagged, "line", tokenise=tagged_places))

    @cached_property
    def basis(self) -> DataFrame:
        return select_basis(self.freqs, DIMENSION, EXCLUDE_FIRST)

    @cached_property
    def targets(self) -> DataFrame:
        return target_words(self.freqs, FREQ_MIN, VOCABULARY)

    def count(self, keys: tuple[str, ...] = ()) -> DataFrame:
        return cooccurrences(
            self.untagged, self.targets, self.basis, WINDOW, MIN_LENGTH, "line",
            keys=keys, max_targets=VOCABULARY, max_basis=DIMENSION, tokenise=tagged_places,
        )

    @cached_property
    def cells(self) -> DataFrame:
        return settle(self.count())

    @cached_property
    def ppmi(self) -> DataFrame:
        return ppmi(self.cells, DIMENSION)

    def _numbered(self, tag: str, n: int | None = None) -> DataFrame:
        """(i, lemma_pos) of one tag in rank order; the vocabulary bounds the rows of the window."""
        tagged = self.targets.filter(F.col("lemma_pos").endswith(f"_{tag}"))
        order = W.orderBy("voc_index")
        rows = tagged.select((F.row_number().over(order) - 1).cast("long").alias("i"), "lemma_pos")
        return rows if n is None else rows.filter(F.col("i") < n)

    @cached_property
    def nouns(self) -> DataFrame:
        return self._numbered("SUBST")

    @cached_property
    def pairs(self) -> DataFrame:
        """(lv_pos, nominal_pos, fvc_pos) for the first light verbs and nouns."""
        verbs = self._numbered("VERB", LIGHT_VERBS + PLAIN_VERBS)
        light = verbs.filter(F.col("i") < LIGHT_VERBS).select(F.col("i").alias("lv_i"), F.col("lemma_pos").alias("lv_pos"))
        plain = verbs.select(F.col("i").alias("fvc_i"), F.col("lemma_pos").alias("fvc_pos"))
        slots = self._numbered("SUBST", NOMINALS).select(
            F.col("lemma_pos").alias("nominal_pos"), F.col("i").alias("nom_i"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LIGHT_VERBS - 1).cast("long"))).alias("lv_i"),
        )
        listed = slots.withColumn("fvc_i", LIGHT_VERBS + (F.col("lv_i") * NOMINALS + F.col("nom_i")) % PLAIN_VERBS)
        return listed.join(light, "lv_i").join(plain, "fvc_i").select("lv_pos", "nominal_pos", "fvc_pos")

    @cached_property
    def seeds(self) -> DataFrame:
        """(lemma_pos, category): seven nouns for one end of the scale, six for the other."""
        return self._numbered("SUBST", 13).select("lemma_pos", F.when(F.col("i") < 7, 1).otherwise(2).alias("category"))

    @cached_property
    def ratings(self) -> DataFrame:
        """(word1, word2, human): each noun with the next one; some partners are unknown words."""
        partner = F.lead("lemma_pos").over(W.orderBy("i"))
        followed = self.nouns.withColumn("_next", partner).filter("_next IS NOT NULL")
        return followed.select(
            F.col("lemma_pos").alias("word1"),
            F.when(F.col("i") % 10 == 9, "zzz_SUBST").otherwise(F.col("_next")).alias("word2"),
            (F.col("i") * 7 % 50).cast("double").alias("human"),
        )

    @cached_property
    def objects(self) -> DataFrame:
        return parsed_objects(parsed(self.spark, self.sf), self.pairs, SENTENCE, MAX_PAIRS)

    @cached_property
    def verbs(self) -> DataFrame:
        return parsed_verbs(parsed(self.spark, self.sf), self.pairs, SENTENCE, MAX_PAIRS)

    @cached_property
    def hits(self) -> DataFrame:
        """(doc_id, line_no, ws, construction, kind): all occurrences with their sentences, from one pass, stored."""
        return stored(sentence_hits(parsed_whole(self.spark, self.sf), self.pairs, SENTENCE, "ws", MAX_PAIRS))

    @cached_property
    def groups(self) -> DataFrame:
        """(doc_id, line_no, construction, kind) of all occurrences, from one pass, stored without their sentences."""
        found = sentence_hits(parsed(self.spark, self.sf), self.pairs, SENTENCE, "ws", MAX_PAIRS)
        return stored(found.select(*SENTENCE, "construction", "kind"))

    @cached_property
    def grouped_sentences(self) -> DataFrame:
        """(construction, kind, doc_id, line_no, sentence)."""
        return self.hits.select("construction", "kind", *SENTENCE, F.array_join("ws", " ").alias("sentence"))


def with_second_verbs(pairs: DataFrame) -> DataFrame:
    """Pairs, and for each construction the next plain verb by name beside its own; a few dozen verbs are put in order."""
    following = pairs.select("fvc_pos").distinct().select("fvc_pos", F.lead("fvc_pos").over(W.orderBy("fvc_pos")).alias("_next"))
    second = pairs.join(following.filter("_next IS NOT NULL"), "fvc_pos").select("lv_pos", "nominal_pos", F.col("_next").alias("fvc_pos"))
    return pairs.unionByName(second).distinct()
