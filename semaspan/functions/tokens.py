"""Token and sentence column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tag names of the two tag sets.
COARSE_TO_SHORT_TAG = {"ADJ": "JJ", "SUBST": "NN", "VERB": "VB", "ADV": "RB"}

ANON_NUMERAL = "--anonnumeral"


def line_tokens(line: Column) -> Column:
    """Tokens of a prepared line: trailing blanks dropped, split at single blanks."""
    return F.split(F.rtrim(line), " ")


def blank_separated(text: Column) -> Column:
    """Tokens between any runs of white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def counted_tokens(text: Column) -> Column:
    """Runs of non-blanks that white space follows, as the frequency count sees them."""
    return F.regexp_extract_all(text, F.lit(r"(\S+)\s"), 1)


def lemma_of(lemma_pos: Column) -> Column:
    return F.trim(F.substring_index(lemma_pos, "_", 1))


def has_digit(text: Column) -> Column:
    return text.rlike(r"\p{Nd}")


def short_tag(tag: Column) -> Column:
    """Short tag of a coarse tag, null for a tag without one."""
    mapped = F.lit(None).cast("string")
    for coarse, short in COARSE_TO_SHORT_TAG.items():
        mapped = F.when(tag == coarse, short).otherwise(mapped)
    return mapped


def with_short_tag(lemma_pos: Column) -> Column:
    """lemma_TAG with the short tag; null unless there are exactly two parts and a known tag."""
    parts = F.split(lemma_pos, "_")
    return F.when(F.size(parts) == 2, F.concat(parts[0], F.lit("_"), short_tag(parts[1])))


def repair_anonymised(tokens: Column) -> Column:
    """Join the first "--" with the token after it when that token is an anonymisation mark."""
    at = F.array_position(tokens, "--").cast("int")
    follower = F.lower(F.get(tokens, at))  # `at` is 1-based, so this is the token after the mark
    joined = F.concat(
        F.slice(tokens, F.lit(1), F.greatest(at - 1, F.lit(0))),
        F.array(F.concat(F.lit("--"), follower)),
        F.slice(tokens, at + 2, F.greatest(F.size(tokens) - at - 1, F.lit(0))),
    )
    return F.when((at > 0) & follower.contains("anon"), joined).otherwise(tokens)


def anonymise_numerals(tokens: Column, lexicon: Column | None = None) -> Column:
    """Replace lemma_TAG by the numeral mark when the lemma has a digit or is in `lexicon`."""

    def mark(token: Column) -> Column:
        parts = F.split(token, "_")
        numeral = has_digit(parts[0])
        if lexicon is not None:
            numeral = numeral | F.coalesce(F.array_contains(lexicon, parts[0]), F.lit(False))
        return F.when((F.size(parts) == 2) & numeral, F.concat(F.lit(ANON_NUMERAL + "_"), parts[1])).otherwise(token)

    return F.transform(tokens, mark)


def group_head(name: Column) -> Column:
    """First two parts of a group name: the verb."""
    return F.substring_index(name, "_", 2)


def group_tail(name: Column) -> Column:
    """What follows the second underscore: the noun of a construction, empty for a plain verb."""
    return F.substring(name, F.length(group_head(name)) + 2, F.length(name))


def sentence_length(text: Column) -> Column:
    return F.size(blank_separated(text))
