"""Greedy walks: the same rows as a plain loop, without a Python step per group."""

import random

from pyspark.sql import functions as F

from srcloom.operators import briefing, pack


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucket_choices_equal_a_plain_loop(spark):
    rng = random.Random(3)
    names = ["a.ts", "b.ts", "export-a.ts", "a.py", "c.go"]
    rows = [
        (p, f"u{i}", f"{rng.choice(['src', 'src/x', 'lib/y/z', 'app'])}/{rng.choice(names)}", "n", "module", i, i, False, b, rng.randint(0, 9))
        for p in range(3) for b in ("api_handlers", "tests", "overview_docs") for i in range(60)
    ]
    schema = (
        "project_id long, id string, file_path string, name string, kind string, start_line int, end_line int, is_vendored boolean, bucket string, score int"
    )
    scored = spark.createDataFrame(rows, schema)
    chosen = briefing.bucket_selection(scored)
    assert "InPandas" not in _plan(chosen)
    facts = scored.select(
        "*", briefing._directory_key(F.col("file_path")).alias("dir"), F.lower(F.regexp_replace(F.substring_index("file_path", "/", -1), r"\.[^.]+\z", "")).alias("flow"),
        F.coalesce(F.try_element_at(briefing.paths.lit_map(briefing.dims.BUCKET_BUDGETS), F.col("bucket")), F.lit(2)).alias("budget"),
    ).collect()
    want = set()
    for group in {(r.project_id, r.bucket) for r in facts}:
        dirs, flows, n = {}, {}, 0
        for r in sorted((r for r in facts if (r.project_id, r.bucket) == group), key=lambda r: (-r.score, r.file_path, r.start_line, r.id)):
            most = 4 if r.bucket in ("api_handlers", "data_model") else 2
            if n < r.budget and dirs.get(r.dir, 0) < most and flows.get(r.flow, 0) < (1 if r.flow.startswith("export-") else 2):
                dirs[r.dir], flows[r.flow], n = dirs.get(r.dir, 0) + 1, flows.get(r.flow, 0) + 1, n + 1
                want.add((*group, r.id, n))
    assert {(r.project_id, r.bucket, r.id, r.pos) for r in chosen.collect()} == want


def test_a_section_skips_what_does_not_fit(spark):
    units = spark.createDataFrame(
        [(1, f"u{i}", f"src/f{i}.ts", "x" * n, 1, 1) for i, n in enumerate([300, 3000, 30, 600])],
        "project_id long, id string, file_path string, code string, start_line int, end_line int",
    )
    asked = spark.createDataFrame([(1, "Top User Workflows", f"u{i}", i) for i in range(4)], "project_id long, section string, id string, ord int")
    out = briefing.select_context(asked, units, 150)
    assert "InPandas" not in _plan(out)
    got = {r["id"]: (r["tokens"], r["slot"]) for r in out.collect()}
    total, slot = 0, 0
    cut = briefing.tokens.with_cut(asked.join(units, ["project_id", "id"]), F.lit(18), F.array().cast("array<string>"))
    for r in cut.select("id", "ord", briefing.tokens.estimate(F.col("cut_code")).alias("tokens")).orderBy("ord").collect():
        if total + r["tokens"] <= 150:
            total, slot = total + r["tokens"], slot + 1
            assert got.pop(r["id"]) == (r["tokens"], slot)
    assert not got


def test_a_packed_question_has_no_python_step(spark):
    schema = (
        "query_id string, unit_id string, ord int, file_path string, pack_score double, tokens bigint, exact boolean,"
        " hit_rank int, start_line int, max_tokens int, max_per_file int"
    )
    rows = [("a", "u1", 1, "f", 2.0, 9, None, None, 1, 10, 1), ("a", "u2", 2, "g", 1.0, 2, True, None, 1, 10, 1), ("a", "u3", 3, "g", 0.0, 1, False, None, 1, 10, 1)]
    out = pack.pack(spark.createDataFrame(rows, schema))
    assert "InPandas" not in _plan(out)
    assert [r["unit_id"] for r in out.orderBy("slot").collect()] == ["u1", "u3"]


def test_the_rules_of_central_files_are_judged_once(spark):
    units = spark.createDataFrame(
        [(1, f"u{i}", p, "main", "module", 1, 9, False, ["a"], ["b"], ["c"], None, "start the server and run the workflow") for i, p in enumerate(["src/index.ts", "README.md", "test/a.test.ts"])],
        "project_id long, id string, file_path string, name string, kind string, start_line int, end_line int, is_vendored boolean,"
        " imports array<string>, exported_names array<string>, called_functions array<string>, docstring string, code string",
    )
    out = briefing.central_files(units)
    pattern = next(t[1] for _, _, cond in briefing.dims.CENTRAL_RULES for alt in cond for t in alt if t[0] == "wtext")
    optimized = out._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count(briefing.rx.java(pattern)) == sum(
        t[1] == pattern for _, _, cond in briefing.dims.CENTRAL_RULES for alt in cond for t in alt
    )
    assert {r["id"] for r in out.collect()} == {"u0", "u1"}


def test_session_sources_are_distinct_before_their_text_comes(spark):
    from srcloom.operators import followup

    units = spark.createDataFrame(
        [(1, "u1", "a.ts", "module", "A", "one\ntwo\nthree", 1, 3), (1, "u2", "b.ts", "class", "B", "x\ny", 1, 2)],
        "project_id long, id string, file_path string, kind string, name string, code string, start_line int, end_line int",
    )
    rows = [(9, 1, 0, "a.ts", "n", "2-2"), (9, 1, 1, "a.ts", "m", "2-2"), (9, 1, 2, "b.ts", "", "?"), (9, 1, 3, "b.ts", "", ""), (9, 1, 4, "no.ts", "", "1")]
    sources = spark.createDataFrame(rows, "session_id long, project_id long, pos int, file_path string, name string, lines string")
    out = followup.session_source_units(sources, units)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    window = next(line for line in plan.split("\n") if "Window" in line)
    assert "code" not in plan[plan.index(window):].split("Relation")[0].split("Join")[0]
    assert plan.index("Join") < plan.index("Window")
    got = {(r["pos"], r["id"], r["name"], r["code"]) for r in out.collect()}
    assert got == {(0, "session-source:a.ts:2-2", "n", "two"), (2, "session-source:u2", "B", "x\ny")}
