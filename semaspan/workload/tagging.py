"""Words, tags and parses of lines, made for a batch of lines at once.

Each different word of a batch is tagged once; everything else works on whole columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tag of some words; others are tagged by their length.
TAGGED_WORDS = {
    "ART": ["the", "a", "an"],
    "PREP": ["of", "to", "in", "for", "on", "with", "by", "at", "as"],
    "PRON": ["it", "that", "they"],
    "CONJ": ["and", "or", "but"],
    "INTERJ": ["ha", "haha"],
}
TAG_BY_LENGTH = ["SUBST", "VERB", "ADJ", "ADV"]
UNCLASSIFIED_FROM = 16
TRUNCATED_EVERY = 50
HEAD_WITHIN = 3  # an object stands up to so many tokens after its verb

WORDS = T.ArrayType(T.StringType())
ANNOTATED = T.ArrayType(
    T.StructType().add("id", T.IntegerType()).add("lemma", T.StringType()).add("upos", T.StringType())
    .add("deprel", T.StringType()).add("head", T.IntegerType())
)
PARSED = T.StructType().add("ws", WORDS).add("annotated", ANNOTATED)

_TAG = {word: tag for tag, words in TAGGED_WORDS.items() for word in words}
_TAGS = [*TAG_BY_LENGTH, "ADJ", "UNC", *TAGGED_WORDS]  # tags by length come first, the other two are told apart by place
_NUMERAL, _UNCLASSIFIED = len(TAG_BY_LENGTH), len(TAG_BY_LENGTH) + 1
_LISTED, _LISTED_TAG = pa.array(list(_TAG)), np.array([_TAGS.index(t, _UNCLASSIFIED + 1) for t in _TAG.values()])
_UPOS = pa.array(["NUM", "NOUN", "VERB", "X"])
_DEPREL = pa.array(["dep", "obj"])

# what a byte is: nothing, part of a letter, a digit
_LETTER, _DIGIT = 1, 2
_ASCII = np.zeros(256, np.uint8)
_ASCII[[*range(65, 91), *range(97, 123)]] = _LETTER
_ASCII[48:58] = _DIGIT
_letters = np.zeros(0, bool)  # by code point, as far as they were met


def _is_letter(points: np.ndarray) -> np.ndarray:
    """Whether code points are letters, as the regular expressions of Arrow see them."""
    global _letters
    known, needed = len(_letters), int(points.max()) + 1
    if known < needed:
        needed = -(-needed // 4096) * 4096
        # surrogates are no characters
        more = pa.array(["" if 0xD800 <= p < 0xE000 else chr(p) for p in range(known, min(needed, 0x110000))])
        found = pc.match_substring_regex(more, r"\p{L}").to_numpy(zero_copy_only=False)
        _letters = np.concatenate([_letters, found])
    return _letters[points]


def _kinds(data: np.ndarray) -> np.ndarray:
    """What each byte of UTF-8 is."""
    kinds = _ASCII[data]
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        first = data[at]
        sizes = 2 + (first >= 0xE0) + (first >= 0xF0)
        points = (first & (0x7F >> sizes)).astype(np.int32)
        for n in (1, 2, 3):
            points = np.where(sizes > n, points << 6 | data[np.minimum(at + n, len(data) - 1)] & 0x3F, points)
        letter = _is_letter(points)
        at, sizes = at[letter], sizes[letter]
        for n in range(4):
            kinds[at[sizes > n] + n] = _LETTER
    return kinds


def words_of(lines: pa.Array) -> pa.ListArray:
    """The runs of letters and the runs of digits of each line; null for null."""
    texts = lines.cast(pa.string()).fill_null("")
    if not pc.any(pc.greater(pc.binary_length(texts), 0)).as_py():
        return _lists(pa.array([], pa.string()), np.zeros(len(lines), np.int64), lines)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kinds = _kinds(data)
    starts = np.empty(len(data), bool)
    starts[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=starts[1:])
    starts[ends[:-1][ends[:-1] < len(data)]] = True
    kept = kinds != 0
    starts = np.flatnonzero(starts & kept)
    # words stand one after the other once all else is left out
    offsets = np.append(np.cumsum(kept, dtype=np.int32)[starts] - 1, np.count_nonzero(kept)).astype(np.int32)
    flat = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[kept]))
    return _lists(flat, np.diff(np.searchsorted(starts, ends)), lines)


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(flat: pa.Array, sizes: np.ndarray, like: pa.Array) -> pa.ListArray:
    """Lists of these sizes, null where `like` is null."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    mask = pc.is_null(like) if like.null_count else None
    return pa.ListArray.from_arrays(offsets, flat, mask=mask)


def _tags_of(words: pa.StringArray) -> np.ndarray:
    """The place in `_TAGS` of the tag of each word: of numerals, then of listed words, then by length."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    tags = np.where(sizes >= UNCLASSIFIED_FROM, _UNCLASSIFIED, sizes % len(TAG_BY_LENGTH))
    listed = pc.fill_null(pc.index_in(words, _LISTED), -1).to_numpy(zero_copy_only=False)
    tags = np.where(listed >= 0, _LISTED_TAG[listed], tags)
    return np.where(pc.match_substring_regex(words, "^[0-9]").to_numpy(zero_copy_only=False), _NUMERAL, tags)


class _Tokens:
    """The words of a batch of lines as places in the list of its different words."""

    def __init__(self, lines: pa.Array):
        lists = words_of(lines)
        self.lines, self.sizes = lines, _sizes(lists)
        encoded = lists.flatten().dictionary_encode()
        self.codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = encoded.dictionary
        self.tags = _tags_of(self.words)

    def places(self) -> np.ndarray:
        """The place of each word in its line, from 0."""
        return np.arange(len(self.codes)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)

    def tag_names(self) -> pa.Array:
        return pa.array(_TAGS).take(pa.array(self.tags))

    def spelled(self, forms: pa.Array, codes: np.ndarray | None = None) -> pa.Array:
        return forms.take(pa.array(self.codes if codes is None else codes))

    def lists(self, flat: pa.Array) -> pa.ListArray:
        return _lists(flat, self.sizes, self.lines)


def words(lines: pa.Array) -> pa.Array:
    return words_of(lines)


def _tagged(t: _Tokens) -> pa.ListArray:
    return t.lists(t.spelled(pc.binary_join_element_wise(t.words, t.tag_names(), "_")))


def tagged(lines: pa.Array) -> pa.Array:
    """word_TAG of each word."""
    return _tagged(_Tokens(lines))


def tagged_places(lines: pa.Array) -> pa.Array:
    """What `tagged` gives, as places in the list of the different words of the batch."""
    t = _Tokens(lines)
    forms = pc.binary_join_element_wise(t.words, t.tag_names(), "_")
    return t.lists(pa.DictionaryArray.from_arrays(pa.array(t.codes.astype(np.int32)), forms))


def elements(lines: pa.Array) -> pa.Array:
    """The words as XML elements, some of them truncated."""
    t = _Tokens(lines)
    plain = pc.binary_join_element_wise('<w c5="X" hw="', t.words, '" pos="', t.tag_names(), '">', t.words, " </w>", "")
    forms = pa.concat_arrays([plain, pc.binary_join_element_wise("<trunc>", plain, "</trunc>", "")])
    cut = t.places() % TRUNCATED_EVERY == TRUNCATED_EVERY - 1
    return pc.binary_join(t.lists(t.spelled(forms, t.codes + cut * len(plain))), "")


def annotated(lines: pa.Array, numbers: pa.Array) -> pa.Array:
    """(id, lemma, upos, deprel, head) of each word; objects stand up to three tokens after a verb."""
    return _annotated(_Tokens(lines), numbers)


def parsed(lines: pa.Array, numbers: pa.Array) -> pa.Array:
    """(ws, annotated): what `tagged` and `annotated` give, with the words of a line taken once."""
    t = _Tokens(lines)
    return pa.StructArray.from_arrays([_tagged(t), _annotated(t, numbers)], PARSED.names)


def _annotated(t: _Tokens, numbers: pa.Array) -> pa.ListArray:
    kinds = np.array([{"SUBST": 1, "VERB": 2}.get(x, 3) for x in _TAGS], np.int8)
    tag = kinds[t.tags][t.codes]
    digits = (t.tags == _NUMERAL)[t.codes]
    on = pc.equal(t.words, "on").to_numpy(zero_copy_only=False)[t.codes]
    first = np.repeat(numbers.to_numpy(zero_copy_only=False) == 0, t.sizes)
    upos = np.where(digits | (on & first), 0, tag)
    place, head = t.places(), np.zeros(len(t.codes), np.int32)
    for back in range(HEAD_WITHIN, 0, -1):  # the nearest verb comes last and stays
        verb = np.zeros(len(tag), bool)
        verb[back:] = tag[:-back] == 2
        near = verb & (place >= back)
        head[near] = (place - back + 1)[near]
    head[upos != 1] = 0
    return t.lists(pa.StructArray.from_arrays(
        [
            pa.array((place + 1).astype(np.int32)), t.spelled(t.words), _UPOS.take(pa.array(upos.astype(np.int64))),
            _DEPREL.take(pa.array((head > 0).astype(np.int64))), pa.array(head),
        ],
        ["id", "lemma", "upos", "deprel", "head"],
    ))


# as they do not count as deterministic, Spark evaluates them once and copies them into no filter
words_udf = F.arrow_udf(words, WORDS).asNondeterministic()
tagged_udf = F.arrow_udf(tagged, WORDS).asNondeterministic()
elements_udf = F.arrow_udf(elements, T.StringType()).asNondeterministic()
annotated_udf = F.arrow_udf(annotated, ANNOTATED).asNondeterministic()
parsed_udf = F.arrow_udf(parsed, PARSED).asNondeterministic()
