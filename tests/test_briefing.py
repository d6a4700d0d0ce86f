"""Refilled sections, graph updates, stored indexes, anchors, session sources and choices on hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from srcloom.functions import sections
from srcloom.operators import briefing, citations, followup, graph_update, ingest, refill, units
from srcloom.sources import store

CONTEXT = "context_id long, id string, file_path string, start_line int, end_line int, ord int, code string"
NODES = "context_id long, node_id string, type string, label string, summary string, ord long"
SOURCES = "context_id long, owner_id string, ord long, file_path string, start_line int, end_line int"
PRODUCT, WORKFLOWS, MAP = "Product In One Paragraph", "Top User Workflows", "Codebase Product Map"


def refilled(spark, text, wanted, context, nodes=(), sources=()):
    briefs = spark.createDataFrame([(1, 7, text, wanted)], "brief_id long, context_id long, text string, sections array<string>")
    ctx = spark.createDataFrame([(7, f"u{i}", p, a, b, i, code) for i, (p, a, b, code) in enumerate(context, 1)], CONTEXT)
    n = spark.createDataFrame([(7, *r, i) for i, r in enumerate(nodes)], NODES)
    s = spark.createDataFrame([(7, o, i, p, a, b) for i, (o, p, a, b) in enumerate(sources)], SOURCES)
    return refill.backfill_sections(briefs, ctx, n, s).first()["text"]


def test_empty_sections_take_cited_evidence(spark):
    text = f"## demo\n\n### {PRODUCT}\n\n### {WORKFLOWS}\nNot found in provided context.\n\n### Main Systems And Ownership Areas\n- **Content**: kept [server/memo_service.go:73-91]."
    context = [("cmd/main.go", 1, 36, None), ("web/components/index.tsx", 1, 21, None), ("server/memo_service.go", 73, 91, None)]
    out = refilled(spark, text, [PRODUCT, WORKFLOWS, "Main Systems And Ownership Areas"], context)
    assert f"### {PRODUCT}\n\nThe selected source evidence shows" in out
    assert f"### {WORKFLOWS}\n1. **Primary repository workflow**" in out
    assert "kept [server/memo_service.go:73-91]" in out and "[cmd/main.go:1-36]" in out
    assert "\n\n\n" not in out and out == out.strip()


def test_overview_documents_come_before_evidence(spark):
    readme = "# Tool\n\nTool is a small program for making plain command lines with very little code around them. More."
    out = refilled(spark, f"### {PRODUCT}\n\n### Who Uses It And Why\nNot found in provided context.", [PRODUCT, "Who Uses It And Why"],
                   [("README.md", 1, 8, readme), ("src/core.py", 1, 20, None)])
    sentence = "Tool is a small program for making plain command lines with very little code around them [README.md:1-8]."
    assert out.count(sentence) == 2 and "project overview: Tool is" in out


def test_sections_of_an_audience_have_notes(spark):
    names = ["Capabilities And Differentiators", "Proof Points From The Source"]
    out = refilled(spark, f"### {names[0]}\n\n### {names[1]}\n", names, [("src/index.ts", 1, 3, None)])
    assert "differentiating capabilities" in out and "proof points" in out and out.count("[src/index.ts:1-3]") == 2


def test_graph_nodes_come_first(spark):
    nodes = [("a", "workflow", "Build", "Builds sites Evidence: x.go:1-9."), ("b", "workflow", "Render", "Renders pages"), ("c", "risk", "Lost", "No source")]
    sources = [("a", "build.go", 1, 260), ("b", "tpl.go", 5, 6)]
    context = [("build.go", 10, 30, None), ("tpl.go", 4, 20, None)]
    out = refilled(spark, f"### {PRODUCT}\n\n### {MAP}\nThe areas include:\n\n### {WORKFLOWS}\nNone.", [PRODUCT, MAP, WORKFLOWS], context, nodes, sources)
    assert "shows Build, Render as central" in out
    # Only an overlap: the unit is cited; inside: the source itself.
    assert "- **Build**: Builds sites [build.go:10-30]." in out and "2. **Render**: Renders pages [tpl.go:5-6]." in out
    assert "Evidence:" not in out and "The areas include" not in out and "Lost" not in out


def test_nothing_changes_without_need_or_units(spark):
    good = f"### {PRODUCT}\nTool is a thing that people use to do their work without any further thought about it."
    assert refilled(spark, good, [PRODUCT], [("a.ts", 1, 2, None)]) == good
    assert refilled(spark, "### X\n\n\n\n### Y\n", ["X"], []) == "### X\n\n\n\n### Y\n"
    # Headings that nobody asked for, and a second heading of the same name, stay.
    out = refilled(spark, f"### Other\n\n### {MAP.upper()}\n\n### {MAP}\n", [MAP], [("a.ts", 1, 2, None)])
    assert out.count("[a.ts:1-2]") == 1 and out.startswith("### Other\n\n### CODEBASE")


def test_wanted_sections_of_a_cut_off_text(spark):
    text = "### One\nWhole line.\n- half [a.ts:1\n\n### two\n-\n"
    row = spark.createDataFrame([(text, ["Two", "One", "Three"])], "t string, w array<string>").select(sections.sanitize(F.col("t"), F.col("w"))).first()
    none = "Not found in provided context"
    assert row[0] == f"### Two\n{none}\n\n### One\nWhole line.\n\n### Three\n{none}"


def test_units_of_section_sets(spark):
    head = "project_id long, id string, file_path string, pos int"
    central = spark.createDataFrame([(1, f"c{i}", f"src/c{i}.ts", i) for i in range(1, 16)] + [(1, "c16", "src/auth/login.ts", 16)], head)
    life = spark.createDataFrame([(1, "l1", "src/l.ts", 1), (1, "c2", "src/c2.ts", 2)], head)
    flows = [(1, "access", "f1", "src/auth/login.ts", 1), (1, "send", "f2", "pages/api/send.ts", 1), (1, "send", "c1", "src/c1.ts", 2)]
    evidence = spark.createDataFrame(flows, "project_id long, workflow string, id string, file_path string, rank int")
    traces = spark.createDataFrame([(1, "access", 1), (1, "send", 2)], "project_id long, workflow string, rank int")
    asked = [("top", 1, [WORKFLOWS]), ("map", 1, [MAP]), ("plain", 1, ["Where To Start Reading"])]
    requests = spark.createDataFrame(asked, "request_id string, project_id long, sections array<string>")
    rows = briefing.section_workflow_units(requests, central, life, evidence, traces).orderBy("request_id", "pos").collect()
    got = {k: [r.id for r in rows if r.request_id == k] for k, _, _ in asked}
    # The life cycle, main workflows, the one about access, then six central units.
    assert got["top"] == ["l1", "c2", "f2", "c1", "f1", "c3", "c4", "c5", "c6"]
    assert got["map"] == [f"c{i}" for i in range(1, 13)] + ["f1", "f2"]
    assert got["plain"] == [f"c{i}" for i in range(1, 13)]


def graph(spark, nodes, edges, sources, inspected=(), warnings=(), summary=""):
    make = spark.createDataFrame
    return graph_update.Graph(
        make([(1, *n, i) for i, n in enumerate(nodes)], "project_id long, node_id string, type string, label string, summary string, confidence string, ord long"),
        make([(1, *e, i) for i, e in enumerate(edges)], "project_id long, edge_id string, type string, from_id string, to_id string, confidence string, ord long"),
        make([(1, o, 0, "src/main.c", a, b) for o, a, b in sources], "project_id long, owner_id string, ord long, file_path string, start_line int, end_line int"),
        make([(1, p, i) for i, p in enumerate(inspected)], "project_id long, file_path string, ord long"),
        make([(1, w, i) for i, w in enumerate(warnings)], "project_id long, warning string, ord long"),
        make([(1, summary)], "project_id long, summary string"),
    )


def test_a_graph_update_is_taken_as_far_as_it_is_sound(spark):
    base = graph(spark, [("main", "file", "Main", "Old", "low")], [], [("main", 1, 9)], ["a.c"], ["old"], "Base")
    nodes = [("main", "file", "Main", "New", "high"), ("svc", "service", "S", "Wrong type", "medium"), ("st", "state", "State", "Kept", "high"),
             ("st", "state", "State", "", "high")]
    edges = [("e1", "calls", "main", "gone", "medium"), ("e2", "calls", "main", "st", "medium"), ("e3", "calls", "st", "svc", "medium")]
    update = graph(spark, nodes, edges, [(o, 1, 12) for o in ("main", "svc", "st", "e1", "e2", "e3")], ["src/main.c", "a.c"], ["new", "old"], " ")
    merged = graph_update.merge_update(base, update)
    outcome = sorted((r.node_id, r.outcome, r.summary) for r in merged["nodes"].collect())
    assert outcome == [("main", "updated", "New"), ("st", "added", "Kept"), ("st", "rejected", ""), ("svc", "rejected", "Wrong type")]
    assert {(r.edge_id, r.outcome) for r in merged["edges"].collect()} == {("e1", "rejected"), ("e2", "added"), ("e3", "rejected")}
    assert {(r.owner_id, r.end_line) for r in merged["sources"].collect()} == {("main", 12), ("st", 12), ("e2", 12)}
    assert [r.file_path for r in merged["inspected"].orderBy("pos").collect()] == ["a.c", "src/main.c"]
    warnings = [r.warning for r in merged["warnings"].orderBy("pos").collect()]
    assert warnings[:2] == ["old", "new"] and "Rejected graph node svc: type is invalid" in warnings
    assert "Rejected graph edge e1: to must reference a known node" in warnings
    assert merged["summaries"].first().summary == "Base"
    # A sound update leaves no warning.
    clean = graph_update.merge_update(base, graph(spark, nodes[:1], [], [("main", 2, 3)], summary="Seen"))
    assert [r.warning for r in clean["warnings"].collect()] == ["old"] and clean["summaries"].first().summary == "Seen"


def test_byte_budget_equals_a_plain_walk(spark):
    rng = random.Random(4)
    rows = [(p, f"f{i:03}", rng.choice([1, 2, 3, 40, 90, 99, 100, 150, rng.randrange(120)])) for p in range(12) for i in range(rng.randrange(1, 60))]
    files = spark.createDataFrame(rows, "project_id long, file_path string, bytes long")
    capped = ingest.cap_files(files, 45)
    wanted = {}
    for p in range(12):
        total = 0
        for i, (_, path, size) in enumerate(sorted(r for r in rows if r[0] == p)):
            reason = "file_limit" if i >= 45 else "oversized" if size > 100 else "byte_budget" if total + size > 500 else None
            total += 0 if reason else size
            wanted[p, path] = reason
    assert {(r.project_id, r.file_path): r.skip_reason for r in ingest.apply_byte_budget(capped, 100, 500).collect()} == wanted


def test_only_named_projects_are_replaced(spark, tmp_path):
    folder = str(tmp_path / "index")
    rows = [(p, f"f{i}", f"code {p} {i}") for p in (1, 2, 3, 4) for i in range(3)]
    table = spark.createDataFrame(rows, "project_id long, file_path string, code string")
    edges = table.selectExpr("project_id", "file_path as source_file", "'x' as import_statement")
    named = lambda *ps: spark.createDataFrame([(p, r) for p, r in ps], "project_id long, repo_path string")
    store.replace_index(folder, named((1, "/a"), (2, "/b"), (3, "/c"), (4, "/d")), table, edges)
    untouched = {f.name for f in (tmp_path / "index/units/project_id=3").iterdir()}
    # One project anew, one empty, one under another id; a unit of a project that is not named changes nothing.
    fresh = spark.createDataFrame([(1, "new", "n"), (9, "moved", "m"), (3, "stray", "s")], table.schema)
    store.replace_index(folder, named((1, "/a"), (2, "/b"), (9, "/d")), fresh, edges.limit(0))
    now = store.read_index(spark, folder, table.schema, edges.schema)
    assert sorted((r.project_id, r.file_path) for r in now["units"].collect()) == [(1, "new"), (3, "f0"), (3, "f1"), (3, "f2"), (9, "moved")]
    assert sorted((r.project_id, r.unit_count) for r in now["projects"].collect()) == [(1, 1), (2, 0), (3, 3), (9, 1)]
    assert {f.name for f in (tmp_path / "index/units/project_id=3").iterdir()} == untouched


def test_units_are_read_field_by_field(spark, tmp_path):
    lines = ['{"id": "a", "filePath": "a.ts", "startLine": 3, "imports": ["x"], "isVendored": 1}', '{"id": "b", "filePath": "b.ts", "startLine": "no"',
             '{"id": "c", "startLine": "no", "imports": [1], "exportedNames": "[\\"y\\"]"}']
    (tmp_path / "u.jsonl").write_text("\n".join(lines))
    (tmp_path / "u.json").write_text("[" + ", ".join(lines[::2]) + "]")
    found = {r.id: r for r in store.load_units(spark, str(tmp_path / "u.jsonl")).collect()}
    assert (found["a"].start_line, found["a"].imports, found["a"].is_vendored, found["a"].problems) == (3, ["x"], True, [])
    assert found["c"].exported_names == ["y"] and found["c"].start_line is None
    assert found["c"].problems == ["filePath is missing", "startLine is not a number", "imports is not a list of strings"]
    assert found[None].problems == ["not a JSON object"]
    assert {r.id for r in store.load_units(spark, str(tmp_path / "u.json"), array_files=True).collect()} == {"a", "c"}


UNIT = (
    "project_id long, id string, file_path string, kind string, name string, code string, start_line int, end_line int, language string,"
    " imports array<string>, exported_names array<string>, called_functions array<string>, docstring string, is_vendored boolean"
)


def unit(id, path="src/orders.ts", kind="function", code="x", start=1, end=4, **more):
    given = {"imports": [f"i{id}", "i"], "exported": [id], "calls": ["db"], "doc": f"doc {id}", "vendored": False} | more
    return (1, id, path, kind, id, code, start, end, "typescript", given["imports"], given["exported"], given["calls"], given["doc"], given["vendored"])


def test_anchors_are_put_together_from_units(spark):
    rows = [unit("b", code="B", start=6, end=8), unit("a", code="A"), unit("m", "src/m.ts", "module"), unit("c", "src/c.ts", code="C", start=3, end=5)]
    files = spark.createDataFrame([(1, "src/c.ts", "l1\nl2\nC"), (1, "src/orders.ts", None)], "project_id long, file_path string, content string")
    found = {r.file_path: r for r in units.module_anchors(spark.createDataFrame(rows, UNIT), files).collect()}
    assert set(found) == {"src/orders.ts", "src/c.ts"}
    orders = found["src/orders.ts"]
    assert (orders.name, orders.code, orders.end_line, orders.docstring) == ("orders", "A\n\nB", 8, "doc a")
    assert (orders.imports, orders.exported_names, orders.called_functions) == (["i", "ia", "ib"], ["a", "b"], ["db"])
    assert (found["src/c.ts"].code, found["src/c.ts"].end_line) == ("l1\nl2\nC", 3)


def test_sources_of_sessions_become_excerpts(spark):
    code = "\n".join(f"line {i}" for i in range(1, 201))
    rows = [unit("m", "a.ts", "module", code, 1, 200), unit("f", "a.ts", "function", "\n".join(code.split("\n")[99:120]), 100, 120),
            unit("g", "b.ts", "function", "only", 50, 60)]
    refs = [("a.ts", "given", "101-103"), ("a.ts", "", ""), ("b.ts", "g2", "58-70"), ("b.ts", "", "all"), ("b.ts", "", "1-2"), ("a.ts", "again", "101-103")]
    sources = spark.createDataFrame([(5, 1, i, *r) for i, r in enumerate(refs)], "session_id long, project_id long, pos int, file_path string, name string, lines string")
    found = {r.pos: r for r in followup.session_source_units(sources, spark.createDataFrame(rows, UNIT)).collect()}
    # Repeats and ranges that meet nothing give no unit.
    assert sorted(found) == [0, 1, 2, 3]
    assert (found[0].unit_id, found[0].code, found[0].name, found[0].start_line) == ("m", "line 101\nline 102\nline 103", "given", 101)
    assert found[1].code == "\n".join(f"line {i}" for i in range(1, 41)) and found[1].id == "session-source:m"
    assert (found[2].unit_id, found[2].code, found[2].end_line) == ("g", "only", 70) and found[3].code == "only"


def test_replies_mean_a_tag(spark):
    tags = ["[a.ts:1-2]", "[b.ts:3-4]"]
    replies = [" [a.ts:1-2]\n", '{"choice": "[b.ts:3-4]"}', "I take [a.ts:1-2], not [b.ts:3-4].", "DROP", '{"choice": "DROP"}', "none", "[c.ts:1-1] [a.ts:1-2]", '{"choice": 5}']
    rows = spark.createDataFrame([(1, i, r) for i, r in enumerate(replies)], "answer_id long, pos int, reply string")
    allowed = spark.createDataFrame([(1, t) for t in tags], "answer_id long, choice string")
    got = [r.choice for r in citations.parse_choices(rows, allowed).orderBy("pos").collect()]
    assert got == [tags[0], tags[1], tags[0], "DROP", "DROP", None, None, None]


def test_deep_files_and_long_texts_stay(spark):
    deep = "/".join("abcdefghijklmnopqrstuvwxyz") + "/x.ts"
    files = spark.createDataFrame([(1, deep, 10), (1, "a.ts", 10)], "project_id long, file_path string, bytes long")
    assert {r.file_path: r.too_deep for r in ingest.scan(files).collect()} == {deep: True, "a.ts": False}


@pytest.mark.parametrize("most, n", [(None, 40), (20, 20)])
def test_terms_of_long_questions(spark, most, n):
    from srcloom.functions import questions

    text = " ".join(f"word{i}" for i in range(40))
    row = spark.createDataFrame([(text,)], "q string").select(questions.terms(F.col("q"), most).alias("t")).first()
    assert len(row.t) == n


def test_workflow_sections_take_overview_documents(spark):
    rows = [(1, "a", "README.md", 1, "overview_docs", 9)]
    scored = spark.createDataFrame(rows, "project_id long, id string, file_path string, start_line int, bucket string, score int")
    want = {"Product In One Paragraph", "Who Uses It And Why", "Codebase Product Map", "Top User Workflows"}
    assert want <= {r.section for r in briefing.product_overview(scored).collect()}
