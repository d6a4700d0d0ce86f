import random

from srcloom.operators import fuse, pack


def brute(rows):
    counts, total, kept = {}, 0, set()
    for r in sorted(rows, key=lambda r: (-r["pack_score"], r["ord"])):
        limit = max(r["max_per_file"], 5) if r["exact"] else r["max_per_file"]
        if counts.get(r["file_path"], 0) < limit and total + r["tokens"] <= r["max_tokens"]:
            counts[r["file_path"]] = counts.get(r["file_path"], 0) + 1
            total += r["tokens"]
            kept.add((r["query_id"], r["unit_id"]))
    return kept


def test_pack_equals_the_plain_walk_over_all_candidates(spark):
    rng = random.Random(7)
    rows = []
    for query in ("a", "b", "c"):
        for i in range(300):
            rows.append(
                {
                    "query_id": query, "unit_id": f"u{i}", "ord": i, "file_path": f"f{rng.randint(0, 6)}",
                    "pack_score": float(rng.randint(0, 40)), "tokens": rng.choice([5, 5, 10, 40]), "exact": rng.random() < 0.3,
                    "hit_rank": None, "start_line": 1, "max_tokens": 300, "max_per_file": 3,
                }
            )
    schema = (
        "query_id string, unit_id string, ord int, file_path string, pack_score double, tokens bigint, exact boolean,"
        " hit_rank int, start_line int, max_tokens int, max_per_file int"
    )
    got = {(r["query_id"], r["unit_id"]) for r in pack.pack(spark.createDataFrame(rows, schema)).collect()}
    want = set()
    for query in ("a", "b", "c"):
        want |= brute([r for r in rows if r["query_id"] == query])
    assert got == want


def test_sources_and_rerank_marks_need_no_code_behind_a_unit(spark):
    units = spark.createDataFrame(
        [("a", 1, "src/db/store.ts", "save", "function", "x = rank(1)", "typescript", None), ("b", 1, "test/a.test.ts", "t", "function", "x = 1", "typescript", None)],
        "id string, project_id long, file_path string, name string, kind string, code string, language string, docstring string",
    )
    marks = {r.id: r for r in fuse.with_marks(units).collect()}
    assert marks["a"].workflow_marks == [False, False, True, False, False, True, True, False] and not marks["a"].is_test
    assert marks["b"].is_test and not any(marks["b"].workflow_marks)
    packed = spark.createDataFrame(
        [("q", 1, "a", 1, "src/db/store.ts", 4, 9)],
        "query_id string, project_id long, unit_id string, slot int, file_path string, start_line int, end_line int",
    )
    rows = pack.source_list(pack.context_lines(packed, units.drop("code"))).collect()
    assert [(r.file_path, r.name, r.lines, r.ord) for r in rows] == [("src/db/store.ts", "save", "4-9", 1)]
