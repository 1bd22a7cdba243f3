"""Verb-object constructions and plain verbs in annotated text, and their groups of sentences.

annotated: (file, line_no, id, lemma, upos, deprel, head), one row per token.
pairs: (lv_pos, nominal_pos, fvc_pos), light verb, noun and the plain verb they correspond to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semaspan.functions.tokens import anonymise_numerals, group_head, group_tail, has_digit, lemma_of
from semaspan.operators.sentences import all_known
from semaspan.plans.joins import lookup_join
from semaspan.session import stored


def object_constructions(annotated: DataFrame, pairs: DataFrame, sentence: Sequence[str] = ("file", "line_no"),
                         max_pairs: int | None = None) -> DataFrame:
    """(sentence, id, lv, nominal): nouns that are the object of a light verb they are listed for.

    Both sides are cut down to listed lemmas before the join on the head pointer.
    """
    listed = pairs.select(lemma_of(F.col("lv_pos")).alias("lv_lemma"), lemma_of(F.col("nominal_pos")).alias("noun_lemma")).distinct()
    objects = annotated.filter("upos = 'NOUN' AND deprel = 'obj'").select(
        *sentence, "id", F.col("lemma").alias("noun_lemma"), "head"
    )
    objects = lookup_join(objects, listed.select("noun_lemma").distinct(), "noun_lemma", "left_semi", max_pairs, 8)
    heads = annotated.select(*sentence, F.col("id").alias("head"), F.col("lemma").alias("lv_lemma"))
    heads = lookup_join(heads, listed.select("lv_lemma").distinct(), "lv_lemma", "left_semi", max_pairs, 8)
    found = objects.join(heads, [*sentence, "head"])
    return lookup_join(found, listed, ["lv_lemma", "noun_lemma"], "left_semi", max_pairs, 8).select(
        *sentence, "id",
        F.concat("lv_lemma", F.lit("_VERB")).alias("lv"),
        F.concat("noun_lemma", F.lit("_SUBST")).alias("nominal"),
    )


def plain_verbs(annotated: DataFrame, pairs: DataFrame, sentence: Sequence[str] = ("file", "line_no"),
                max_pairs: int | None = None) -> DataFrame:
    """(sentence, id, fvc): each occurrence of a listed plain verb."""
    listed = pairs.select(lemma_of(F.col("fvc_pos")).alias("lemma")).distinct()
    verbs = annotated.filter("upos = 'VERB'").select(*sentence, "id", "lemma")
    return lookup_join(verbs, listed, "lemma", "left_semi", max_pairs, 8).select(
        *sentence, "id", F.concat("lemma", F.lit("_VERB")).alias("fvc")
    )


def _head_of(token: Column) -> Column:
    """The lemma of a token's head in `annotated`: by place where ids number the tokens, else by its id."""
    placed = F.get("annotated", (token["head"] - 1).cast("int"))
    # no function of its own for each token: Spark compiles what has none
    named = F.get("annotated.lemma", F.array_position("annotated.id", token["head"]).cast("int") - 1)
    return F.when(placed["id"] == token["head"], placed["lemma"]).otherwise(named)


def _objects(tokens: str = "annotated") -> Column:
    return F.filter(tokens, lambda t: (t["upos"] == "NOUN") & (t["deprel"] == "obj"))


def parsed_objects(parsed: DataFrame, pairs: DataFrame, sentence: Sequence[str] = ("file", "line_no"),
                   max_pairs: int | None = None) -> DataFrame:
    """What `object_constructions` gives, from one row a sentence with the array `annotated` of its tokens.

    The head is found inside the row: the text is read once, and only listed constructions could move.
    """

    def hit(noun: Column) -> Column:
        return F.struct(noun["id"].cast("long").alias("id"), _head_of(noun).alias("lv_lemma"), noun["lemma"].alias("noun_lemma"))

    listed = pairs.select(lemma_of(F.col("lv_pos")).alias("lv_lemma"), lemma_of(F.col("nominal_pos")).alias("noun_lemma")).distinct()
    found = parsed.select(*sentence, F.explode(F.transform(_objects(), hit)).alias("_hit")).select(*sentence, "_hit.*")
    return lookup_join(found, listed, ["lv_lemma", "noun_lemma"], "left_semi", max_pairs, 8).select(
        *sentence, "id",
        F.concat("lv_lemma", F.lit("_VERB")).alias("lv"),
        F.concat("noun_lemma", F.lit("_SUBST")).alias("nominal"),
    )


def parsed_verbs(parsed: DataFrame, pairs: DataFrame, sentence: Sequence[str] = ("file", "line_no"),
                 max_pairs: int | None = None) -> DataFrame:
    """What `plain_verbs` gives, from one row a sentence with the array `annotated` of its tokens."""
    listed = pairs.select(lemma_of(F.col("fvc_pos")).alias("lemma")).distinct()
    verbs = F.filter("annotated", lambda t: t["upos"] == "VERB")
    hits = F.transform(verbs, lambda t: F.struct(t["id"].cast("long").alias("id"), t["lemma"].alias("lemma")))
    found = parsed.select(*sentence, F.explode(hits).alias("_hit")).select(*sentence, "_hit.*")
    return lookup_join(found, listed, "lemma", "left_semi", max_pairs, 8).select(
        *sentence, "id", F.concat("lemma", F.lit("_VERB")).alias("fvc")
    )


def numeral_lexicon(annotated: DataFrame, file: str = "file") -> DataFrame:
    """(file, lemma): lemmas tagged as numerals in each file."""
    return annotated.filter("upos = 'NUM'").select(file, "lemma").distinct()


def candidate_groups(objects: DataFrame, verbs: DataFrame, sentence: Sequence[str] = ("file", "line_no")) -> DataFrame:
    """(sentence, construction, kind) for the occurrences of both kinds, LVC and FVC."""
    lvc = objects.select(*sentence, F.concat_ws("_", "lv", "nominal").alias("construction"), F.lit("LVC").alias("kind"))
    fvc = verbs.select(*sentence, F.col("fvc").alias("construction"), F.lit("FVC").alias("kind"))
    return lvc.unionByName(fvc)


def align_renditions(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("file", "line_no")) -> DataFrame:
    """Lines of two renditions of a corpus side by side; numbers come from before any filter."""
    return left.join(right, list(keys))


def merge_groups(*groups: DataFrame) -> DataFrame:
    """Rows of several runs or files as one table of groups."""
    merged = groups[0]
    for g in groups[1:]:
        merged = merged.unionByName(g)
    return merged


def pair_maps(pairs: DataFrame) -> DataFrame:
    """(relation, key, member): the three lookups of the pair table in long form.

    noun_of_light_verb, verb_of_construction and construction_of_verb.
    """
    construction = F.concat_ws("_", lemma_of(F.col("lv_pos")), lemma_of(F.col("nominal_pos")))
    links = F.array(
        F.struct(F.lit("noun_of_light_verb").alias("relation"), lemma_of(F.col("lv_pos")).alias("key"), lemma_of(F.col("nominal_pos")).alias("member")),
        F.struct(F.lit("verb_of_construction").alias("relation"), construction.alias("key"), F.col("fvc_pos").alias("member")),
        F.struct(F.lit("construction_of_verb").alias("relation"), F.col("fvc_pos").alias("key"), F.concat_ws("_", "lv_pos", "nominal_pos").alias("member")),
    )
    return pairs.select(F.explode(links).alias("_l")).select("_l.*").distinct()


def parse_groups(groups: DataFrame, name: str = "construction") -> DataFrame:
    """Add verb, nominal and kind from the group name; no noun means a plain verb."""
    tail = group_tail(F.col(name))
    return groups.withColumns({
        "verb": group_head(F.col(name)),
        "nominal": tail,
        "kind": F.when(tail == "", "FVC").otherwise("LVC"),
    })


def _observed(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    parsed = parse_groups(groups.select("construction").distinct())
    lvc = parsed.filter("kind = 'LVC'").select(F.col("verb").alias("lv_pos"), F.col("nominal").alias("nominal_pos"))
    fvc = parsed.filter("kind = 'FVC'").select(F.col("verb").alias("fvc_pos"))
    return lvc, fvc


def corresponding_groups(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lv_pos, nominal_pos, fvc_pos, fvc_observed): the plain verbs of each observed construction."""
    lvc, fvc = _observed(groups)
    listed = lvc.join(pairs.select("lv_pos", "nominal_pos", "fvc_pos").distinct(), ["lv_pos", "nominal_pos"], "left")
    return listed.join(fvc.withColumn("_seen", F.lit(True)), "fvc_pos", "left").select(
        "lv_pos", "nominal_pos", "fvc_pos", F.col("_seen").isNotNull().alias("fvc_observed")
    )


def strict_pairs(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """(fvc_pos, lv_pos, nominal_pos) where both the construction and the plain verb were observed."""
    lvc, fvc = _observed(groups)
    listed = pairs.select("lv_pos", "nominal_pos", "fvc_pos").distinct()
    both = listed.join(lvc, ["lv_pos", "nominal_pos"], "left_semi").join(fvc, "fvc_pos", "left_semi")
    return both.select("fvc_pos", "lv_pos", "nominal_pos")


def sentence_hits(parsed: DataFrame, pairs: DataFrame, sentence: Sequence[str] = ("file", "line_no"), tokens: str = "ws",
                  max_pairs: int | None = None) -> DataFrame:
    """(sentence, tokens, construction, kind): each occurrence of both kinds with its sentence, in one pass.

    parsed: (sentence, tokens, annotated), where `annotated` is the array of (id, lemma, upos, deprel, head) of
    a sentence. Heads are found inside the row, so no token is joined with another.
    """

    token = F.col("_t")
    is_verb = token["upos"] == "VERB"
    fvc = F.concat(token["lemma"], F.lit("_VERB"))
    lvc = F.concat(_head_of(token), F.lit("_VERB_"), token["lemma"], F.lit("_SUBST"))
    # rows of tokens end in one compiled loop with the lookup, so sentences are copied for what is listed only
    rows = parsed.select(*sentence, tokens, "annotated", F.explode("annotated").alias("_t"))
    found = rows.filter(is_verb | ((token["upos"] == "NOUN") & (token["deprel"] == "obj"))).select(
        *sentence, tokens, F.when(is_verb, fvc).otherwise(lvc).alias("construction"), F.when(is_verb, "FVC").otherwise("LVC").alias("kind")
    )
    listed = pairs.select(F.concat_ws("_", "lv_pos", "nominal_pos").alias("construction"), F.lit("LVC").alias("kind")).unionByName(
        pairs.select(F.col("fvc_pos").alias("construction"), F.lit("FVC").alias("kind"))
    ).distinct()
    bound = None if max_pairs is None else 2 * max_pairs
    return lookup_join(found, listed, ["construction", "kind"], "left_semi", bound, 8)


def extract_sentences(parsed: DataFrame, pairs: DataFrame, words: DataFrame, sentence: Sequence[str] = ("file", "line_no"),
                      file: str = "file", tokens: str = "ws", max_pairs: int | None = None, max_words: int | None = None) -> DataFrame:
    """(construction, kind, sentence keys, sentence): the sentences of each group as they are used later.

    Numerals of a file are marked in its sentences, and a sentence stays if all its tokens are in `words` or
    marks. The corpus is read once for the occurrences and once for the numerals; only sentences with an occurrence
    move, and they are stored before they are compared with `words`.
    """
    hits = sentence_hits(parsed, pairs, sentence, tokens, max_pairs)
    numerals = parsed.select(file, F.explode(F.filter("annotated", lambda t: t["upos"] == "NUM")).alias("_t"))
    # a file's number words; what has a digit is marked without a list
    numerals = numerals.filter(~has_digit(F.col("_t.lemma"))).groupBy(file).agg(F.collect_set("_t.lemma").alias("_numerals"))
    marked = lookup_join(hits, numerals, file, "left", salts=8)
    marked = stored(marked.withColumn(tokens, anonymise_numerals(F.col(tokens), F.col("_numerals"))).drop("_numerals"))
    known = all_known(marked, words, list(sentence), tokens, max_words)
    return marked.join(known, list(sentence), "left_semi").select(
        "construction", "kind", *sentence, F.array_join(tokens, " ").alias("sentence")
    )


def score_table(corresponding: DataFrame, scores: DataFrame, score: str = "score", max_groups: int | None = None) -> DataFrame:
    """(pair, kind, other columns of `scores`): what the tests on pairs compare.

    corresponding: (lv_pos, nominal_pos, fvc_pos, fvc_observed); scores: (construction, kind, ..., score). A pair
    is a construction and one plain verb and is named by its three words, so a construction with several plain verbs is
    tested against each by itself. The scores of a construction serve all its pairs, those of a plain verb all that
    correspond to it.
    """
    seen = corresponding.filter("fvc_observed").withColumn("pair", F.concat_ws("_", "lv_pos", "nominal_pos", "fvc_pos"))
    roles = seen.select("pair", F.explode(F.array(
        F.struct(F.concat_ws("_", "lv_pos", "nominal_pos").alias("construction"), F.lit("LVC").alias("kind")),
        F.struct(F.col("fvc_pos").alias("construction"), F.lit("FVC").alias("kind")),
    )).alias("_r")).select("pair", "_r.*").distinct()
    bound = None if max_groups is None else 2 * max_groups
    rest = [c for c in scores.columns if c not in ("construction", "kind")]
    return lookup_join(scores.filter(F.col(score).isNotNull()), roles, ["construction", "kind"], "inner", bound, 8).select("pair", "kind", *rest)


def clean_groups(groups: DataFrame, sentence: str = "sentence", mode: str = "token") -> DataFrame:
    """Distinct (construction, sentence) whose sentence holds the words of the construction.

    mode "token" asks for the words as tokens, "compat" for their letters anywhere in the line.
    """
    head, tail = group_head(F.col("construction")), group_tail(F.col("construction"))
    if mode == "compat":
        # a plain verb has no second part, and every text contains the empty text
        holds = F.col(sentence).contains(head) & F.col(sentence).contains(tail)
    else:
        tokens = F.split(sentence, r"\s+")
        holds = F.array_contains(tokens, head) & ((tail == "") | F.array_contains(tokens, tail))
    return groups.select("construction", sentence).filter(holds).distinct()


def unprocessed(inputs: DataFrame, done: DataFrame, path: str = "path") -> DataFrame:
    """Input paths that no earlier run has processed."""
    return inputs.distinct().join(done.select(path).distinct(), path, "left_anti")
