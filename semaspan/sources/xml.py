"""Tagged XML corpora in two dialects, read one sentence element per row.

The elements of a sentence are taken in document order from its text, in one pass over batches of rows:
no parser trees, no shuffle, and no attribute can slip to its neighbour when one is absent.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semaspan.sources.corpus import numbered


@dataclass(frozen=True)
class Dialect:
    """Names of the sentence element and of the attributes that hold tag and lemma."""

    sentence: str
    pos: str
    lemma: str
    punctuation_lemma: str | None  # marks `w` elements that are punctuation; None: `c` elements are


# The two dialects.
WRITTEN_AND_SPOKEN = Dialect("s", "pos", "hw", None)
SPOKEN_2014 = Dialect("u", "class", "lemma", "PUNC")

_ATTRIBUTES = r"""(?:\s+[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'))*"""
_CUT = " _cut='1'"
_IN_LINE = "[^\\n\\r\u0085\u2028\u2029]"  # what a dot stands for in Spark's expressions
# what Unicode counts as white space
_BLANKS = " \t\n\x0b\f\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_TOKEN = (
    T.StructType().add("kind", T.StringType()).add("pos", T.StringType()).add("lemma", T.StringType())
    .add("text", T.StringType()).add("truncated", T.BooleanType())
)
SENTENCES_AT_ONCE = 2_000  # whose elements a worker holds
REMEMBERED_ELEMENTS = 100_000  # of earlier sentences, about


def read_xml_sentences(spark: SparkSession, path: str | list[str], dialect: Dialect = WRITTEN_AND_SPOKEN) -> DataFrame:
    """(xml, file, line_no): one sentence element per row, numbered inside its file.

    The closing tag is the record separator, so large files are split over tasks.
    """
    tag = dialect.sentence
    records = numbered(spark.read.text(path, lineSep=f"</{tag}>"))
    opened = rf"(?s)^.*(<{tag}(?:\s[^>]*)?>.*)$"
    element = F.regexp_extract("value", opened, 1)
    return records.select(element.alias("xml"), "file", "line_no").filter("xml <> ''").withColumn(
        "xml", F.concat("xml", F.lit(f"</{tag}>"))
    )


def _unescaped(text: Column) -> Column:
    """Resolve character references; only text that has any goes through an XML parser."""
    parsed = F.xpath_string(F.concat(F.lit("<t>"), text, F.lit("</t>")), F.lit("/t"))
    return F.when(text.contains("&"), parsed).otherwise(text)


def _with(value: Column, use) -> Column:
    """use(value) with the value computed once, however often `use` mentions it."""
    return F.transform(F.array(value), use)[0]


def _attribute(name: str) -> re.Pattern:
    """Finds the value of an attribute by name in the text between a tag's name and its end."""
    return re.compile(rf"""\s{name}\s*=\s*(["'])({_IN_LINE}*?)\1""", re.ASCII)


class _Reader:
    """The elements of sentences of one dialect; each different element is read once, as long as it is remembered.

    A text is split at `<`. What follows one is an element if all of it matches, and no start of one if it does
    not begin with its name. Where something begins so and does not match, an attribute may hold a `<`, so the whole
    sentence is searched for elements instead.
    """

    NONE, UNCLEAR = -1, -2

    def __init__(self, dialect: Dialect):
        self.punctuation = dialect.punctuation_lemma
        if self.punctuation is None:
            word, names = r"<w(?=[\s/>])", "w|c"
        else:
            word = rf"""<w(?=[\s/>])(?![^>]*\s{dialect.lemma}\s*=\s*["']{self.punctuation}["'])"""
            names = "w"
        self.comment = re.compile(r"(?s)<!--.*?-->")
        self.cut = re.compile(rf"(?s)<trunc(?=[\s/>]).*?{word}", re.ASCII)
        self.search = re.compile(rf"<((?:{names}){_ATTRIBUTES}\s*/?>[^<]*)", re.ASCII)
        self.starts = re.compile(rf"(?:{names})[\s/>]", re.ASCII).match
        self.parts = re.compile(rf"({names})({_ATTRIBUTES})\s*/?>([^<]*)", re.ASCII).fullmatch
        self.pos, self.lemma = _attribute(dialect.pos), _attribute(dialect.lemma)
        self.known: dict[str, int] = {}
        self.read: list[tuple] = []

    def _learn(self, piece: str) -> int:
        if found := self.parts(piece):
            name, attributes, text = found.groups()
            pos, lemma = (m and m[2] for m in (self.pos.search(attributes), self.lemma.search(attributes)))
            mark = name == "c" if self.punctuation is None else lemma == self.punctuation
            code = len(self.read)
            self.read.append(("punctuation" if mark else "word", pos, lemma, text, attributes.startswith(_CUT)))
        else:
            code = self.UNCLEAR if self.starts(piece) else self.NONE
        self.known[piece] = code
        return code

    def _codes(self, pieces: list[str]) -> list[int]:
        found = list(map(self.known.get, pieces))
        if None in found:
            for i in [i for i, code in enumerate(found) if code is None]:
                code = self.known.get(pieces[i])
                found[i] = self._learn(pieces[i]) if code is None else code
        return found

    def located(self, xml: str) -> list[int]:
        """The places in `read` of a sentence's elements, and NONE for what is no element."""
        if "<!--" in xml:
            xml = self.comment.sub("<!>", xml)
        if "<trunc" in xml:
            xml = self.cut.sub(rf"\g<0>{_CUT}", xml)
        found = self._codes(xml.split("<")[1:])
        return self._codes(self.search.findall(xml)) if self.UNCLEAR in found else found

    def tokens(self, sentences: pa.Array) -> pa.ListArray:
        if len(self.known) > REMEMBERED_ELEMENTS:
            self.known, self.read = {}, []
        places, ends = array("i"), [0]
        for xml in sentences.to_pylist():
            if xml is not None:
                places.extend(self.located(xml))
            ends.append(len(places))
        codes = np.frombuffer(places, np.int32)
        kept = codes >= 0
        ends = np.concatenate([[0], np.cumsum(kept)])[ends]
        used, codes = np.unique(codes[kept], return_inverse=True)
        read = list(zip(*[self.read[i] for i in used.tolist()])) or [()] * len(_TOKEN)
        columns = [pa.array(c, pa.bool_() if f.dataType == T.BooleanType() else pa.string()) for c, f in zip(read, _TOKEN)]
        found = pa.StructArray.from_arrays(columns, _TOKEN.names).take(pa.array(codes))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found, mask=sentences.is_null() if sentences.null_count else None)


def sentence_tokens(xml: Column, dialect: Dialect = WRITTEN_AND_SPOKEN) -> Column:
    """array<struct<kind, pos, lemma, text, truncated>> of a sentence element, in document order.

    kind is "word" or "punctuation". The first word after the start of a `trunc` element is the
    truncated one. A null sentence has a null array.
    """

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = _Reader(dialect)
        for batch in batches:
            for i in range(0, len(batch), SENTENCES_AT_ONCE):
                yield reader.tokens(batch.slice(i, SENTENCES_AT_ONCE))

    def resolved(t: Column) -> Column:
        return F.struct(t["kind"], *[_unescaped(t[c]).alias(c) for c in ("pos", "lemma", "text")], t["truncated"])

    # as it does not count as deterministic, Spark evaluates it once and copies it into no filter
    tokens = F.arrow_udf(read, T.ArrayType(_TOKEN)).asNondeterministic()(xml)
    sentence = F.struct(tokens.alias("tokens"), xml.contains("&").alias("escaped"))
    return _with(sentence, lambda s: F.when(s["escaped"], F.transform(s["tokens"], resolved)).otherwise(s["tokens"]))


def kept_tokens(tokens: Column, punctuation: bool = False, unclassified: bool = False, truncated: bool = False,
                articles: bool = True, interjections: bool = True) -> Column:
    """Leave out the classes of tokens that are switched off."""

    def keep(t: Column) -> Column:
        word = F.lit(True) if truncated else ~t["truncated"]
        for wanted, tag in ((unclassified, "UNC"), (articles, "ART"), (interjections, "INTERJ")):
            if not wanted:
                word = word & ~t["pos"].eqNullSafe(F.lit(tag))
        return F.when(t["kind"] == "punctuation", F.lit(punctuation)).otherwise(word)

    return F.filter(tokens, keep)


def rendered_tokens(tokens: Column, lemmatise: bool = True, pos_tags: bool = True) -> Column:
    """array<string>: lemma or stripped form, with its tag if wanted; punctuation is tagged PUNC."""

    def render(t: Column) -> Column:
        form = t["lemma"] if lemmatise else F.btrim(t["text"], F.lit(_BLANKS))
        is_mark = t["kind"] == "punctuation"
        form = F.when(is_mark, t["text"]).otherwise(form)
        if not pos_tags:
            return form
        return F.concat(form, F.lit("_"), F.when(is_mark, "PUNC").otherwise(t["pos"]))

    return F.transform(tokens, render)


def prepare_corpus(sentences: DataFrame, dialect: Dialect = WRITTEN_AND_SPOKEN, lemmatise: bool = True,
                   pos_tags: bool = True, **kept: bool) -> DataFrame:
    """Replace the xml column by `value`: a prepared line, each token followed by a blank.

    Sentences left without a token are dropped; their numbers stay unused, so two renditions of one
    corpus can be aligned by number.
    """
    tokens = rendered_tokens(kept_tokens(sentence_tokens(F.col("xml"), dialect), **kept), lemmatise, pos_tags)
    # an exploded array of no or one line drops empty sentences; a filter would parse each of them again
    line = _with(tokens, lambda t: F.when(F.size(t) > 0, F.concat(F.array_join(t, " "), F.lit(" "))))
    rest = [c for c in sentences.columns if c != "xml"]
    return sentences.select(*rest, F.explode(F.array_compact(F.array(line))).alias("value"))
