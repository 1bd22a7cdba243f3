"""Secret scans by assignment-aware lexing.

Three fixed kinds are found by pattern. On top of them a small lexer reads source and configuration syntax
into pairs of a name and what is assigned to it: quoted strings, bare words, names of earlier constants, and
sums of these. Constants are propagated to where they are used, and a literal is scored by how sensitive its
target name is and by how random it looks. A literal above the threshold adds a span of kind `literal`, at
the place where it is written, unless a span of a fixed kind holds it whole; where they only overlap, both stand, and
the mask hides both. Assignments are read with and without types, as entries of mappings, subscripts, elements of
markup, preprocessor definitions, and calls of a name with a string; values as bare words, strings with their prefixes,
in brackets and on the next line. Each value ends where the next assignment begins, so a text is read in linear time.

Spans are (kind, start, end) in code points, end exclusive, ordered by start and then by kind.

Defined results: null and empty texts have no spans. Repeated rows give repeated results, an empty table an
empty one. Texts are read whole; a constant is known from its line on, to the end of its text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "literal")
SPAN_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("name", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
)
_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("score", pa.float64())])
)

# The patterns of the base kinds and the least length of what they match.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
LEAST_ASSIGNED = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

# How much a part of a target name says that its value is secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "signingkey": 1.0, "auth": 0.8,
    "authorization": 0.8, "bearer": 0.9, "pass": 0.7, "key": 0.6, "salt": 0.6, "cookie": 0.6, "session": 0.5,
}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|changeme|change_me|example|placeholder|none|null|true|false|your.*|<.*>|\$\{.*\}|%.*%)$")
LEAST_LITERAL = 8
LONGEST_VALUE = 4096  # characters up to which a value is kept as text; of longer ones, counts of characters and both ends
MOST_COUNTED = 1e12  # counts of characters are scaled down beyond
THRESHOLD = 0.45

# A name and what parts it from its value: an assignment with or without a type, a mapping, the key of a subscript, a
# definition of the preprocessor, or the first argument of a call whose second one is a string.
_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]{0,79}"
_PAIR = re.compile(
    rf"""(?P<q>["']?)(?P<name>{_NAME})(?P=q)\]?[\x20\t]*"""
    r"""(?::[\x20\t]*[A-Za-z_][A-Za-z0-9_.\[\]|\x20]{0,79}?[\x20\t]*=(?![=>])|:=|=>|[:=])(?!=)[\x20\t]*"""
    rf"""|\#define[\x20\t]+(?P<defined>{_NAME})[\x20\t]+(?=["'])|\([\x20\t]*["'](?P<argument>{_NAME})["'][\x20\t]*,[\x20\t]*(?=["'`])"""
)
# What may stand before the value: a line break before a string, a bracket, a scheme, the prefix of a string.
_LEAD = re.compile(r"""(?:\\?\r?\n[\x20\t]*(?=[fFrRbBuU]{0,2}["'`]))?(?:\([\x20\t]*)?(?:(?:Bearer|Basic)[\x20\t]+)?(?:[fFrRbBuU]{1,2}(?=["'`]))?""")
# Strings of three quotes, of one, and bare words, in which `=` stands at the end only, as padding.
_ATOM = re.compile(
    r"""\"\"\"((?:[^"\\]|\\.|"(?!""))*)\"\"\"|\'\'\'((?:[^'\\]|\\.|'(?!''))*)\'\'\'|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`"""
    r"""|([A-Za-z0-9+/_.\-]+(?:={1,2}(?![A-Za-z0-9+/_.\-=]))?)"""
)
_BARE = 6
_TAG = re.compile(rf"<(?P<name>{_NAME})>(?P<value>[^<>\n]+)</(?P=name)>")
_PLUS = re.compile(r"[\x20\t]*[+][\x20\t]*")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z0-9]+")


def name_score(name: str) -> float:
    """0 to 1: the most sensitive part, or two neighbouring parts, of a name in any casing."""
    parts = [p.lower() for p in _NAME_PARTS.findall(name)]
    return max((SENSITIVE.get(p, 0.0) for p in [*parts, *map("".join, zip(parts, parts[1:]))]), default=0.0)


def literal_score(value: str) -> float:
    """0 to 1: long, mixed and unpredictable strings score high, words and placeholders low."""
    if len(value) < LEAST_LITERAL or " " in value or PLACEHOLDER.match(value):
        return 0.0
    return counts_score(Counter(value), len(value))


def counts_score(counts: dict[str, float], length: float) -> float:
    entropy = -sum(n / length * math.log2(n / length) for n in counts.values() if n / length)
    mixed = any(c.isdigit() for c in counts) + any(c.isupper() for c in counts) + any(c.islower() for c in counts)
    return min(1.0, entropy / 4.0) * (0.2 if mixed < 2 else 1.0)


class Value:
    """What is assigned: a sum of literals, each with its place, and of earlier values, which are not copied."""

    __slots__ = ("parts", "known", "marked")

    def __init__(self, parts: list[tuple[str, tuple[int, int]] | Value]):
        self.parts = parts
        self.known: tuple[str | None, Counter, float, str] | None = None  # text if it is short, counts, length, both ends
        self.marked = 0.0  # all places in it have this score at least

    def settle(self) -> None:
        """Make `known` of this value and of those it is made of."""
        todo = [self]
        while todo:
            value = todo[-1]
            open_ = [] if value.known else [p for p in value.parts if isinstance(p, Value) and not p.known]
            if open_:
                todo += open_
                continue
            todo.pop()
            if not value.known:
                value.known = value._summed()

    def _summed(self) -> tuple[str | None, Counter, float, str]:
        texts = [p.known[0] if isinstance(p, Value) else p[0] for p in self.parts]
        if None not in texts and sum(map(len, texts)) <= LONGEST_VALUE:
            return "".join(texts), Counter(), 0.0, ""
        counts, length, ends = Counter(), 0.0, ""
        for part, text in zip(self.parts, texts):
            if text is not None:
                counts.update(text)
                length, ends = length + len(text), ends + (text if len(text) <= 32 else text[:16] + text[-16:])
            else:
                counts.update(part.known[1])
                length, ends = length + part.known[2], ends + part.known[3]
            ends = ends if len(ends) <= 32 else ends[:16] + ends[-16:]
        if length > MOST_COUNTED:
            counts, length = Counter({c: n * LONGEST_VALUE / length for c, n in counts.items()}), float(LONGEST_VALUE)
        return None, counts, length, ends

    def score(self) -> float:
        self.settle()
        text, counts, length, ends = self.known
        if text is not None:
            return literal_score(text)
        # ends that are one run of x tell nothing of what lies between
        placeholder = PLACEHOLDER.match(ends) and len(set(ends)) > 1
        return 0.0 if " " in counts or placeholder else counts_score(counts, length)

    def places(self, score: float) -> Iterator[tuple[int, int]]:
        """The places whose score may be less; values that were given it before are passed by."""
        todo = [self]
        while todo:
            value = todo.pop()
            if value.marked < score:
                value.marked = score
                for part in value.parts:
                    if isinstance(part, Value):
                        todo.append(part)
                    else:
                        yield part[1]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each base kind; those that are too short are dropped."""
    spans = []
    if ":" in text or "=" in text:
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return spans


def assigned_literals(text: str) -> list[tuple[str, float, int, int]]:
    """(name, score, start, end) of literals that reach a sensitive name, directly or as a constant.

    What is assigned is a sum of atoms. A name among them stands for what it was last assigned above, and all
    literals of the sum get the score of the whole value.
    """
    found: dict[tuple[int, int], tuple[str, float]] = {}
    constants: dict[str, Value] = {}
    for pair in _PAIR.finditer(text):
        parts, at = [], _LEAD.match(text, pair.end()).end()
        target = pair["name"] or pair["defined"] or pair["argument"]
        while atom := _ATOM.match(text, at):
            word = atom[atom.lastindex]
            if atom.lastindex == _BARE and word in constants:
                parts.append(constants[word])
            else:
                parts.append((word, atom.span(atom.lastindex)))
            plus = _PLUS.match(text, atom.end())
            if not plus:
                break
            at = plus.end()
        if not parts:
            continue
        value = constants[target] = parts[0] if len(parts) == 1 and isinstance(parts[0], Value) else Value(parts)
        if sensitive := name_score(target):
            score = sensitive * value.score()
            if score >= THRESHOLD:
                for place in value.places(score):
                    if place not in found or found[place][1] < score:
                        found[place] = (target, score)
    for tag in _TAG.finditer(text) if "</" in text else ():
        score = name_score(tag["name"]) * Value([(tag["value"], tag.span("value"))]).score()
        if score >= THRESHOLD:
            found.setdefault(tag.span("value"), (tag["name"], score))
    return [(name, score, *place) for place, (name, score) in found.items()]


def find(text: str) -> list[dict]:
    """All spans of one text, in order."""
    spans = [{"kind": kind, "start": a, "end": b, "name": None, "score": 1.0} for kind, a, b in base_spans(text)]
    if ":" in text or "=" in text or "#define" in text or "</" in text or "(" in text:
        covered = sorted((s["start"], s["end"]) for s in spans)
        reach = list(accumulate((end for _, end in covered), max))  # how far the spans up to each one go
        for name, score, a, b in assigned_literals(text):
            before = bisect_right(covered, (a, len(text)))  # base spans that start at it or earlier
            if b > a and not (before and reach[before - 1] >= b):
                spans.append({"kind": "literal", "start": a, "end": b, "name": name, "score": score})
    return sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))


@F.arrow_udf(SPAN_TYPE)
def _scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([find(text.as_py() or "") for text in batch], _ARROW)


@F.arrow_udf(T.StringType())
def _mask(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, found in zip(texts, spans):
        text = text.as_py()
        if text is not None and found.is_valid and len(found):
            parts, at = [], 0
            for span in found.as_py():  # in order of start; what overlaps the part before is masked with it
                if span["end"] > at:
                    if span["start"] >= at:
                        parts += [text[at : span["start"]], "[SECRET]"]
                    at = span["end"]
            text = "".join([*parts, text[at:]])
        out.append(text)
    return pa.array(out, pa.string())


def with_secrets(docs: DataFrame, text: str = "text", secrets: str = "secrets") -> DataFrame:
    """`docs` with an array of spans; a column that already has that name is replaced."""
    return docs.withColumn(secrets, _scan(F.col(text)))


def masked(text: Column | str, secrets: Column | str) -> Column:
    """The text with each secret replaced by a mark; null stays null."""
    return _mask(text, secrets)


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
