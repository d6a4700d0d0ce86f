"""Clean rows stay in the pipeline, whatever their labels, ids and columns; dotted numbers are found."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from srcloom.llm import language_id, pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(("ka", "lo", "mi")) + str(r.randrange(400)) for _ in range(n))


@pytest.mark.parametrize("labels", [(None,), ("en",)])
def test_texts_stay_without_two_languages(spark, labels):
    rows = [(i, prose(30, i), labels[i % len(labels)], "s", 0) for i in range(8)] + [(9, "123 !", None, "s", 0), (10, None, None, "s", 0)]
    kept = corpus_pipeline.language(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(8))


def test_different_texts_of_one_id_stay(spark):
    shared = prose(80, 500)
    rows = [(1, prose(90, 1), "en", "s", 0), (1, prose(90, 2), "en", "s", 0), (2, prose(90, 3), "en", "s", 0), (2, prose(90, 3), "en", "s", 0),
            (3, prose(90, 2), "en", "s", 0), (None, prose(90, 1), "en", "s", 0), (4, shared + " x", "en", "s", 0), (5, "a " + shared, "en", "s", 0),
            (5, "b " + shared + " b", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id or 0), r.text) for r in kept.collect())
    # One of each class, and the row without an id. The second text of id 1 is a copy of 3 or the other way round.
    texts = [t for i, t in got if i]
    assert sorted(set(texts)) == sorted(texts) and prose(90, 1) in texts and prose(90, 2) in texts and texts.count(prose(90, 3)) == 1
    assert (0, prose(90, 1)) in got
    passages = corpus_pipeline.repeated_passages(spark, docs.where("doc_id >= 4"), "")
    cut = sorted((r.doc_id, r.text) for r in passages.collect())
    assert cut == [(4, shared + " x"), (5, "a "), (5, "b b")]


def test_columns_of_any_name(spark):
    names = ["_away", "_twice", "_id", "_md5", "_spans", "_key", "_own_id", "_one", "_least", "class", "n", "most", "a b"]
    rows = [(i, prose(60, i % 3), "en" if i % 2 else "fr", "s", 0, *range(len(names))) for i in range(6)]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", `{n}` long" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "")
        assert after.columns == docs.columns, name
        assert {tuple(r)[5:] for r in after.collect()} == {tuple(range(len(names)))}, name


@pytest.mark.parametrize(
    "text, span",
    [
        ("192[.]168[.]1[.]1", (0, 17)), ("192 dot 168 dot 1 dot 1", (0, 23)), ("at 10(dot)0.0[.]7, ok", (3, 17)), ("see 192.168.1[.]1 now", (4, 17)),
        ("300 dot 1 dot 1 dot 1", None), ("1 dot 2 dot 3", None), ("10.0.0.1", None),
    ],
)
def test_dotted_numbers(text, span):
    _, added = pii.find_spans(text)
    assert added["ip"] == ([span] if span else [])


def test_long_runs_of_signs_are_linear():
    local = "a" * 80
    assert pii.find_spans(f"{local} at host dot example dot com")[1]["email"] == [(0, 108)]
    for run in ("a dot ", "1 dot ", "a@", "a.b.", "a-"):
        pii.find_spans(run * 20000 + " dot ")


def test_the_least_right_score_is_taken_over_all_labelled_rows(spark):
    words = {"aa": ["alpha", "beta", "gamma", "delta"], "bb": ["xylo", "zumba", "quark", "wyvern"]}
    rows = [(i, " ".join(words[lang][(i * k) % 4] for k in range(1, 30)), lang) for i in range(40) for lang in words]
    r = random.Random(5)
    both = words["aa"] + words["bb"]
    mixed = [(1000 + i, " ".join("".join(r.sample(w, len(w) - 1)) for w in r.choices(both, k=8)), "aa") for i in range(600)]
    docs = spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string")
    model = language_id.fit(docs.where("doc_id < 1000"), F.lit(True))
    named = zip(mixed, *language_id.predict(model, [m[1] for m in mixed]))
    want = min(score for (_, _, lang), found, score in named if found == lang)
    held_out = docs.where("doc_id >= 1000")
    for shift in range(0, 50_000, 10_000):  # another id is another place in any choice by hash
        moved = held_out.withColumn("doc_id", F.col("doc_id") + shift)
        assert corpus_pipeline._least_right_score(moved, model, F.lit(True)) == pytest.approx(want, rel=1e-9)
