from pyspark.sql import functions as F

from srcloom import rx
from srcloom.functions import citing, paths, questions, redact


def one(spark, value, col):
    return spark.createDataFrame([(value,)], "x string").select(col.alias("y")).first()["y"]


def test_word_edges_are_ascii(spark):
    assert one(spark, "éla la", F.size(rx.extract_all(F.col("x"), r"\bla\b", 0))) == 2


def test_end_is_the_very_end(spark):
    assert one(spark, "a\n", rx.test(F.col("x"), "a$")) is False


def test_sensitive_paths(spark):
    for path, want in [(".env.local", True), ("a/.ssh/x", True), ("src/index.ts", False), ("k/server.pem", True)]:
        assert one(spark, path, paths.is_sensitive(F.col("x"))) is want


def test_redaction(spark):
    text = 'API_KEY=abc\nurl = https://u:p@h/x\n"token": "abc",\nplain'
    got = one(spark, text, redact.redact_text(F.lit("src/a.ts"), F.col("x")))
    assert got == 'API_KEY=[REDACTED]\nurl = [REDACTED]\n"token": "[REDACTED]",\nplain'
    pem = "-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----"
    assert one(spark, pem, redact.redact_text(F.lit("a.txt"), F.col("x"))) == "[REDACTED SECRET BLOCK]"


def test_intents(spark):
    cases = {
        "Create a codebase onboarding overview for sales": "business_overview",
        "What depends on the store?": "dependency_explanation",
        "Explain src/db/store.ts": "file_explanation",
        "Explain the `run` function": "specific_symbol",
    }
    for q, want in cases.items():
        assert one(spark, q, questions.intent(F.col("x"))) == want


def test_citation_group(spark):
    got = one(spark, "a.ts:1-2, 5-6, b.ts:3", citing.expand_group(F.col("x")))
    assert got == ["a.ts:1-2", "a.ts:5-6", "b.ts:3"]


def test_links_are_no_citations(spark):
    assert one(spark, "see [a.ts:1](x)", citing.bracket_bodies(F.col("x"))) == []


def test_citations_and_claims_are_read_once(spark):
    from srcloom.operators import citations as cit

    answers = spark.createDataFrame([(1, "See a/b.ts:1-2 [src/a/b.ts:1-2] and [x.ts:3, 5-6]."), (2, "")], "answer_id long, answer string")
    plan = cit.extract(answers)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(answer") <= 2
    rows = cit.extract(answers).orderBy("pos").collect()
    assert [(r.answer_id, r.citation) for r in rows] == [(1, "src/a/b.ts:1-2"), (1, "x.ts:3"), (1, "x.ts:5-6")]
