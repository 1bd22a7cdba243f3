import base64
import random
import re

import corpus_pipeline as pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from semaspan.llm import mixing, secrets
from semaspan.session import stored

SF = "/root/testdata/sf0.01"


def by_stage(spark, docs):
    out = [docs]
    for _, stage in pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF)))
    return out


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start, good, single, masked, drawn, tokens = by_stage(spark, docs)
    rows = {name: {r.doc_id: r for r in df.collect()} for name, df in zip("gsmdt", (good, single, masked, drawn, tokens))}
    assert all(df.columns == docs.columns for df in (good, single, masked, drawn))
    texts = {r.doc_id: r.text for r in start.collect()}
    assert all(rows["g"][i].text == texts[i] and len(re.findall(r"[^\x20\x09-\x0D]+", texts[i])) >= 50 for i in rows["g"])
    # of equal texts one stays, the one with the smallest id
    first = {}
    for i in sorted(rows["g"]):
        first.setdefault(rows["g"][i].text, i)
    assert set(rows["s"]) <= set(first.values()) and len(rows["s"]) >= 0.9 * len(first)
    assert set(rows["m"]) == set(rows["s"])
    hidden = 0
    for i, r in rows["m"].items():
        spans = secrets.find(rows["s"][i].text)
        hidden += bool(spans)
        assert bool(spans) == (r.text != rows["s"][i].text) and r.n_chars == len(r.text) and not secrets.base_spans(r.text)
    assert hidden
    assert set(rows["d"]) <= set(rows["m"]) and 0.8 < len(rows["d"]) / len(rows["m"]) <= 1
    want = {r.doc_id for r in mixing.mixed(masked, budget=pipeline.MIX_BUDGET, temper=pipeline.MIX_TEMPER).filter("drawn").collect()}
    assert set(rows["d"]) == want == set(rows["t"])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in rows["t"].items():
        assert r.round_trip and r.token_ids == library.encode_ordinary(rows["d"][i].text) and r.n_tokens == len(r.token_ids)


def test_odd_rows(spark):
    rng = random.Random(8)
    text = ". ".join(" ".join("".join(rng.choices("aeinorst", k=rng.randint(2, 8))) for _ in range(12)) for _ in range(12))
    rows = [(1, text, "en", "s", 5, 1), (1, text, "en", "s", 5, 1), (2, text, "en", None, 5, 1), (None, None, None, None, None, 1), (3, "", "en", "s", 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row int")
    stages = by_stage(spark, docs)
    assert [df.count() for df in stages[1:4]] == [3, 1, 1] and stages[2].first().doc_id == 1
    assert [df.count() for df in by_stage(spark, docs.limit(0))] == [0] * 6
    assert stages[-1].count() <= 1


def test_run_gives_the_last_stage(spark):
    assert pipeline.run(spark, "/root/testdata/sf0.001").agg(F.count("*")).first()[0] > 50
