import random
import re
import time

from semaspan.llm import secrets

CODE = '''
seed = "kX9vQ2mZ7pLw"
db_password = seed
client = { "clientSecret": "Zm9vYmFyQmF6MTIz" }
note: password = changeme
SESSION_KEY=a1B2c3D4e5F6
title = "A long story of the well-known token"
half = "Ab12Cd34"
auth_token = half + "Ef56Gh78"
'''


def test_literals_reach_sensitive_names():
    found = {CODE[s["start"] : s["end"]]: s["name"] for s in secrets.find(CODE) if s["kind"] == "literal"}
    assert found["kX9vQ2mZ7pLw"] == "db_password"  # written under another name, used as a password
    assert found["a1B2c3D4e5F6"] == "SESSION_KEY"
    assert found["Ab12Cd34"] == found["Ef56Gh78"] == "auth_token"
    assert "changeme" not in found and not any("story" in f for f in found)


def test_constants_that_double_stay_small():
    assert secrets.find("x = 'abc'\n" + "x = x + x\n" * 200 + "password = x") == []


def brute(text):
    names = ["password", "passwd", "secret", "token", "apikey", "api_key"]
    spans = []
    at = 0
    while at < len(text):  # each start by hand
        name = next((n for n in names if text[at : at + len(n)].lower() == n and text[at : at + len(n)].isascii()), None)
        m = name and re.compile(r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""").match(text, at + len(name))
        if m:
            if len(m[1]) >= 12:
                spans.append(("assign", at, m.end()))
            at = m.end()
        else:
            at += 1
    for kind, pattern, least in (("access", "AKIA[A-Z0-9]+", 18), ("hex", "[0-9a-f]+", 16)):
        spans += [(kind, *m.span()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(spans)


def test_base_spans_against_brute_force(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += ["token=api_key: abcdefghijkl", "ſecret=abcdefghijklmnop", "TOKEN = 'abcdefghijkl'", "AKIA" + "A" * 13, "é" * 5 + "a" * 16]
    for text in texts:
        assert sorted(secrets.base_spans(text)) == brute(text)


def test_odd_rows_and_masks(spark):
    rows = [(1, None, 5), (2, "", 6), (2, "", 6), (3, "é token = abcdefghijkl0 and " + "ab12" * 5 + " end", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, secrets int")
    out = secrets.with_secrets(docs)
    got = {(r.doc_id, r.text): r for r in out.select("*", secrets.masked("text", "secrets").alias("m")).collect()}
    assert len(got) == 3 and got[1, None].m is None and got[1, None].secrets == []
    assert got[rows[3][:2]].m == "é [SECRET] and [SECRET] end"
    assert secrets.with_secrets(docs.limit(0)).count() == 0


def test_long_values_are_scored_and_masked(spark):
    rng = random.Random(6)
    key = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz0123456789", k=9000))
    pieces = [key[i : i + 1000] for i in range(0, 9000, 1000)]
    several = "".join(f'p{i} = "{p}"\n' for i, p in enumerate(pieces)) + "signing_key = " + " + ".join(f"p{i}" for i in range(9)) + "\n"
    for text, places in ((f'signing_key = "{key}"\n', 1), (f"a = '{key}'\ncredentials = a", 1), (several, 9)):
        spans = secrets.find(text)
        assert [s["kind"] for s in spans] == ["literal"] * places and "".join(text[s["start"] : s["end"]] for s in spans) == key
        row = secrets.with_secrets(spark.createDataFrame([(text,)], "text string")).select(secrets.masked("text", "secrets").alias("m")).first()
        assert key[:50] not in row.m and row.m.count("[SECRET]") == places
    assert not secrets.find(f"signing_key = '{'word ' * 2000}'") and not secrets.find(f"signing_key = '<{key}>'")
    grown = "x = 'aB3xY7kQ'\n" + "x = x + x\n" * 5000 + "signing_key = x\n"
    assert [grown[s["start"] : s["end"]] for s in secrets.find(grown)] == ["aB3xY7kQ"]


def test_forms_of_assignment():
    key = "Zx9Qw8Er7Ty6Ui5Op"
    forms = [
        'signing_key: str = "{}"', "signing_key: Optional[str] = '{}'", 'os.environ["SIGNING_KEY"] = "{}"', '#define SIGNING_KEY "{}"',
        'signing_key = ("{}")', 'signing_key = """{}"""', "signingKey = `{}`;", 'signing_key =\n    "{}"', "signing_key = \\\n  '{}'",
        "<signingKey>{}</signingKey>", 'cfg.set("signing_key", "{}")', "Authorization: Bearer {}", 'signing_key = f"{}"', "signing-key: {}", "SIGNING_KEY={}==",
        'a = "{}"\nsigning_key: str = a', "signing_key := '{}'", "'signing_key' => '{}'",
    ]
    for form in forms:
        text = "# é\n" + form.format(key) + "\nplain = 3\n"
        found = [text[s["start"] : s["end"]] for s in secrets.find(text) if s["kind"] == "literal"]
        assert [f.rstrip("=") for f in found] == [key], form
    typed = 'x: str = "Zx9Qw8Er7Ty6Ui5Op"\nsigning_key: str = "pppppppp"\n'  # the type is no constant
    assert secrets.find(typed) == []


def test_what_overlaps_a_base_span_is_masked_whole(spark):
    for text, rest in (
        ('password = "abcdefghijkl!Zq9#rest-of-it"', "rest-of-it"),
        ('signing_key = "Zx9Qw8Er7Ty6-0123456789abcdef0123-PqRsTuVwXy"', "PqRsTuVwXy"),
    ):
        row = secrets.with_secrets(spark.createDataFrame([(text,)], "text string")).select(secrets.masked("text", "secrets").alias("m")).first()
        assert rest not in row.m and "[SECRET]" in row.m


def test_long_texts_are_read_in_linear_time():
    began = time.perf_counter()
    for text in ("a=" * 500_000, "a='" * 300_000, 'a="""' * 200_000, "a+" * 400_000, "key: " * 200_000, "<a>" * 200_000, "x" * 300_000, "a: b " * 100_000):
        secrets.find(text)
    assert time.perf_counter() - began < 60
