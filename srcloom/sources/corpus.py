"""Input tables of the engine, laid over the given parquet tables.

The engine expects repositories, questions, answers and survey graphs. These
views derive them from the tables at hand, so every row count follows the data.
All of them are row-local projections: nothing is shuffled to build a view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Layout of a small repository: one document per path.
SMALL_LAYOUT = [
    "README.md", "docs/architecture.md", "src/index.ts", "src/config/env.ts", "src/db/store.ts",
    "src/daily/pipeline.ts", "src/api/handler.py", "src/auth/session.go", "src/billing/plan.ts",
    "test/pipeline.test.ts", "lib/vendor/util.js", "package.json",
]

# Layout of a large repository that touches every path rule.
TREE_LAYOUT = [
    "README.md", "docs/overview.md", "docs/functions/calls.md", "docs/security/token.mdx", "src/index.ts",
    "src/app.tsx", "src/server/main.go", "src/core/engine.rs", "src/core/model.java", "src/util/text.py",
    "app/api/users/route.ts", "pages/dashboard/index.tsx", "pages/api/links.ts", "src/services/note_service.ts",
    "src/handlers/upload_handler.go", "ee/saml/login.ts", "lib/jobs/queue.rb", "src/ai/chat.ts",
    "prisma/schema/models.prisma", "prisma/migrations/001/migration.sql", "db/migrations/002_add.sql",
    "scripts/deploy.sh", "native/cache.c", "native/zig/alloc.zig", "test/app.test.ts", "src/__tests__/store_test.go",
    "package.json", "package-lock.json", "yarn.lock", "tsconfig.json", "docker-compose.yml", "config/settings.toml",
    ".env.local", "config/credentials.json", "keys/server.pem", ".ssh/id_rsa", ".gitmodules", "foundry.toml",
    "contracts/foundry.toml", "remappings.txt", "vendor/sub/lib.py", "vendor/sub/.git/HEAD", "lib/forge-std/src/Test.js",
    "contracts/lib/openzeppelin-contracts/token.js", "node_modules/left-pad/index.js", "dist/bundle.min.js",
    "assets/logo.svg", "proto/gen/api.pb.go", ".github/workflows/ci.yml", "CHANGELOG.md", "src/billing/plan.cs",
    "src/analytics/event_report.kt", "src/views/portal.swift", "src/share/link_share.php", "src/config/env.ts",
    "src/db/store.hpp", "packages/core/src/index.ts", "packages/core/README.md", "examples/demo.ts",
    "a/b/c/d/e/f/g/h/i/j/k/l/m/n/o/p/q/r/s/t/u/v/w/x/y/z/deep.ts", "src/UPPER.TS", "Makefile", "src/data.snap",
    "src/export-report.ts", "tools/run.lua", "docs/plans/next.md", "src/pipeline/sync.dart", "settings.gradle",
    "src/noext", "middleware.ts", "src/store/reducer.jsx", "lib/helpers/date_helper.rb",
]

#: Conversations and users that belong to one project, so that projects grow with them.
PER_PROJECT = 12
GOLDEN_QUESTIONS = [
    "Where is LLAMA_SERVER_URL configured and validated?",
    "How does the daily pipeline collect, classify, score, and save candidates?",
    "Create a codebase onboarding overview for sales",
    "Explain src/db/store.ts",
    "Explain the `runPipeline1` function",
    "What depends on the store? Which modules are imported by the pipeline?",
    "What risks and gaps should we worry about?",
    "What does this project do for customers?",
    'Why do I get "missing chat endpoint" with code 500?',
    "token secret password",
    "the and for",
    "Show me the test coverage for planLimit3 and app.listen",
]

CODE_HEADERS = {
    "ts": (
        'import { run } from "./daily/pipeline";\nimport "../db/store";\nexport { env } from "@/config/env";\n'
        "export interface StoreConfig {\n  url: string;\n}\nexport class Store {\n  load(id) {\n"
        "    return db.query(id);\n  }\n  async save(row) {\n    await db.write(row);\n  }\n}\n"
        "export function buildStore(config) {\n  return new Store(config);\n}\n"
        'const later = () => import("./lazy");\n'
    ),
    "py": (
        "import os\nfrom pathlib import Path\n\nclass Loader(Base):\n    def load(self, path):\n"
        "        return os.path.join(path)\n\n    async def store(self):\n        save(self)\n\n"
        "def main():\n    Loader().load(1)\n"
    ),
    "go": (
        'package worker\n\nimport "fmt"\n\ntype Queue struct {\n\titems []int\n}\n\n'
        'func (q *Queue) Push(i int) {\n\tfmt.Println(i)\n}\n\nfunc Run() {\n\tNewQueue().Push(1)\n}\n'
    ),
    "rs": "use std::fs;\n\npub struct Cache {\n    n: u32,\n}\n\nimpl Cache {\n    pub fn get(&self) -> u32 {\n        read(self.n)\n    }\n}\n\nfn main() {\n    fs::read();\n}\n",
    "java": "import java.util.List;\n\npublic class Plan {\n    public int limit(int n) {\n        return Math.max(n, 1);\n    }\n}\n",
}
CODE_HEADERS.update({k: CODE_HEADERS["ts"] for k in ("tsx", "js", "jsx", "TS")})
SPECIAL_CONTENT = {
    ".gitmodules": '[submodule "vendor/sub"]\n\tpath = vendor/sub\n\turl = https://host/x.git\n',
    "foundry.toml": 'remappings = [\n  "forge-std/=lib/forge-std/src/",\n]\n',
    "contracts/foundry.toml": 'remappings = ["@openzeppelin/=lib/openzeppelin-contracts/"]\n',
    "remappings.txt": "ds-test/=lib/ds-test/src/\n",
    "config/settings.toml": 'db_password = "hunter2"\nhome = https://user:pw@host/x\n"apiToken": "abc",\n',
    "keys/server.pem": "-----BEGIN PRIVATE KEY-----\nabcd\nefgh\n-----END PRIVATE KEY-----\n",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _project(key: str, size: int):
    return F.floor(F.col(key) / size).cast("bigint")


def files(spark: SparkSession, sf: str) -> DataFrame:
    n = len(SMALL_LAYOUT)
    slot = (F.col("doc_id") % n).cast("int")
    layout = F.array(*[F.lit(p) for p in SMALL_LAYOUT])
    return table(spark, sf, "documents").select(
        _project("doc_id", n).alias("project_id"),
        "doc_id",
        F.get(layout, slot).alias("file_path"),
        (slot == 10).alias("is_vendored"),
        F.octet_length("text").cast("bigint").alias("bytes"),
        F.col("text").alias("content"),
    )


def tree_files(spark: SparkSession, sf: str) -> DataFrame:
    n = len(TREE_LAYOUT)
    layout = F.array(*[F.lit(p) for p in TREE_LAYOUT])
    df = table(spark, sf, "documents").select(
        _project("doc_id", n).alias("project_id"),
        "doc_id",
        F.get(layout, (F.col("doc_id") % n).cast("int")).alias("file_path"),
        "text",
    )
    head = F.lit("")
    ext = F.regexp_extract("file_path", r"\.([A-Za-z]+)$", 1)
    for suffix, text in CODE_HEADERS.items():
        head = F.when(ext == suffix, F.lit(text)).otherwise(head)
    for path, text in SPECIAL_CONTENT.items():
        head = F.when(F.col("file_path") == path, F.lit(text)).otherwise(head)
    return (
        df.withColumn("content", F.concat(head, F.col("text")))
        .withColumn("bytes", F.octet_length("content").cast("bigint"))
        .drop("text")
    )


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).select(
        "project_id",
        "doc_id",
        "file_path",
        "is_vendored",
        F.posexplode(F.split("content", "\n", -1)).alias("pos", "line"),
    ).select("project_id", "doc_id", "file_path", "is_vendored", (F.col("pos") + 1).alias("line_no"), "line")


def _by_slot(values: dict, default):
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(F.col("slot") == k, v if not isinstance(v, str) else F.lit(v)).otherwise(out)
    return out


_NAMES = {
    0: "Readme", 1: "Architecture", 2: "startApp", 3: "loadEnv", 4: "saveStore", 5: "runPipeline",
    6: "handleRequest", 7: "openSession", 8: "planLimit", 9: "testPipeline", 10: "vendorUtil",
}
_LANGS = {0: "markdown", 1: "markdown", 6: "python", 7: "go", 10: "javascript", 11: "json"}
_IMPORTS = {
    2: ['import { run } from "./daily/pipeline";', 'import h from "./api/handler.js";'],
    5: ['import { env } from "../config/env";', 'export * from "../db/store";', 'import x from "left-pad";'],
    8: ['import { db } from "@/db/store";'],
    9: ['import { run } from "../src/daily/pipeline.js";'],
}
_CALLS = {2: ["runPipeline1", "app.listen", "listen"], 5: ["loadEnv1", "saveStore1"]}


def _strings(items):
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


def units(spark: SparkSession, sf: str) -> DataFrame:
    """Files cut into blocks of eight lines, one code unit per block."""
    blocks = files(spark, sf).select(
        "project_id",
        "doc_id",
        "file_path",
        "is_vendored",
        F.split("content", "\n", -1).alias("ls"),
    ).select(
        "project_id",
        "doc_id",
        "file_path",
        "is_vendored",
        (F.col("doc_id") % len(SMALL_LAYOUT)).alias("slot"),
        F.size("ls").alias("n_lines"),
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), ((F.size("ls") - 1) / 8).cast("int")),
                lambda b: F.array_join(F.slice(F.col("ls"), b * 8 + 1, 8), "\n"),
            )
        ).alias("unit_no", "code"),
    )
    no = F.col("unit_no").cast("string")
    return blocks.select(
        F.concat(F.lit("u"), F.col("doc_id").cast("string"), F.lit("-"), no).alias("id"),
        "project_id",
        "file_path",
        F.element_at(
            F.array(F.lit("module"), F.lit("function"), F.lit("class"), F.lit("method")), F.col("unit_no") % 4 + 1
        ).alias("kind"),
        F.concat(_by_slot(_NAMES, "package"), no).alias("name"),
        "code",
        (F.col("unit_no") * 8 + 1).alias("start_line"),
        F.least(F.col("unit_no") * 8 + 8, F.col("n_lines")).alias("end_line"),
        F.when(
            F.col("unit_no") % 4 == 3,
            F.concat(_by_slot({5: "runPipeline"}, "other"), (F.col("unit_no") - 1).cast("string")),
        ).alias("parent_name"),
        "is_vendored",
        _by_slot({k: _strings(v) for k, v in _IMPORTS.items()}, None).alias("imports"),
        F.when(
            (F.col("unit_no") % 4 == 1) & (F.col("doc_id") % 3 == 0),
            F.concat(F.lit("Loads and saves records for file "), F.col("doc_id").cast("string")),
        ).alias("docstring"),
        F.when(
            F.col("slot").isin(2, 3, 4, 5, 8),
            F.array(F.concat(F.lit("exported"), no), F.lit("LLAMA_SERVER_URL")),
        ).alias("exported_names"),
        _by_slot({k: _strings(v) for k, v in _CALLS.items()}, None).alias("called_functions"),
        _by_slot(_LANGS, "typescript").alias("language"),
    ).withColumns(
        {
            c: F.coalesce(F.col(c), F.array().cast("array<string>"))
            for c in ("imports", "exported_names", "called_functions")
        }
    )


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every project is asked the golden questions; user turns are questions too."""
    golden = F.array(
        *[F.struct(F.lit(i + 1).alias("k"), F.lit(q).alias("query")) for i, q in enumerate(GOLDEN_QUESTIONS)]
    )
    # README documents identify the projects: one per project, no shuffle needed.
    asked = (
        table(spark, sf, "documents")
        .filter(F.col("doc_id") % len(SMALL_LAYOUT) == 0)
        .select(_project("doc_id", len(SMALL_LAYOUT)).alias("project_id"), F.explode(golden).alias("g"))
        .select(
            F.concat(F.lit("g"), F.col("project_id").cast("string"), F.lit("-"), F.col("g.k").cast("string")).alias("query_id"),
            "project_id",
            "g.query",
        )
    )
    turns = table(spark, sf, "conversations").filter(F.col("role") == "user").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("query_id"),
        _project("conv_id", PER_PROJECT).alias("project_id"),
        F.col("text").alias("query"),
    )
    return asked.unionByName(turns)


ANSWER_TAILS = [
    " [src/config/env.ts:1-1].", " [store.ts:900-901].", " [src/daily/pipeline.ts].",
    " [src/config/env.ts:1, src/db/store.ts:1-1].", ".", " (see src/db/store.ts:1-2).",
    " [src/api/handler.py:1-1, 2-2].", " [package.json:1-1](x) and [1-1].",
]


def answers(spark: SparkSession, sf: str) -> DataFrame:
    n = len(ANSWER_TAILS)
    tail = F.get(F.array(*[F.lit(t) for t in ANSWER_TAILS]), ((F.col("conv_id") + F.col("turn")) % n).cast("int"))
    return table(spark, sf, "conversations").filter(F.col("role") == "assistant").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"),
        _project("conv_id", PER_PROJECT).alias("project_id"),
        F.concat(
            F.lit("### Product In One Paragraph\nThe stage loads settings and opens the store before it writes any record"),
            tail,
            F.lit("\n\n### Top User Workflows\n3. **Flow**: The team shares private access tokens and collects analytics data"),
            tail,
            F.lit("\n\n#### Empty\n\n### Risks Or Open Questions\n- "),
            F.col("text"),
        ).alias("answer"),
    )


#: Cited sources of a session: (file, name, kind, lines), where a lines text may be a range, a line or neither.
SESSION_SOURCES = [
    ("src/index.ts", "startApp", "function", "{a}-{b}"), ("README.md", "Readme", "module", ""), ("src/db/store.ts", "", "class", "{c}"),
    ("src/daily/pipeline.ts", "runPipeline", "method", "{b}-{c}"), ("gone.ts", "gone", "module", "1-2"),
]


def session_source_text(source: tuple) -> str:
    path, name, kind, lines = source
    return f'{{"filePath":"{path}","name":"{name}","kind":"{kind}","lines":"{lines}"}}'


def _session_sources(e):
    """Well-formed sources and one that is none; every ninth list is cut off."""
    text = F.lit("[" + ",".join(map(session_source_text, SESSION_SOURCES)) + ',{"filePath":"README.md","lines":3}]')
    for mark, number in (("{a}", e % 11 + 1), ("{b}", e % 11 + 1 + e % 5), ("{c}", e % 90 + 1)):
        text = F.replace(text, F.lit(mark), number.cast("string"))
    return F.when(e % 9 == 8, F.substring(text, 1, 40)).otherwise(text)


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        e.alias("session_id"),
        _project("user_id", PER_PROJECT).alias("project_id"),
        F.col("event_type").alias("audience"),
        F.when(e % 7 == 0, F.lit("   ")).otherwise(F.col("props")).alias("brief"),
        (F.col("event_type") == "error").alias("generation_truncated"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
        F.when(e % 5 == 0, '["src/index.ts", "README.md"]')
        .when(e % 5 == 1, '["src/index.ts", 7]')
        .when(e % 5 == 2, '[null, "README.md"]')
        .when(e % 5 == 3, "{bad")
        .otherwise("[]")
        .alias("source_files_json"),
        _session_sources(e).alias("sources_json"),
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("ord"), "role", F.col("text").alias("content")
    )


NODE_KINDS = ["repository", "area", "workflow", "boundary", "state", "risk", "file", "bogus"]


def kg_nodes(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf, "part").select(
        _project("p_partkey", 25).alias("project_id"),
        F.concat(F.lit("n"), p.cast("string")).alias("node_id"),
        F.get(F.array(*[F.lit(k) for k in NODE_KINDS]), (p % 8).cast("int")).alias("type"),
        F.col("p_name").alias("label"),
        F.concat(F.lit("Summary of "), F.col("p_name"), F.lit(" "), F.col("p_type")).alias("summary"),
        F.when(p % 4 == 0, "high").when(p % 4 == 1, "medium").when(p % 4 == 2, "low").alias("confidence"),
    )


def kg_edges(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        _project("c_custkey", 25).alias("project_id"),
        F.concat(F.lit("e"), c.cast("string")).alias("edge_id"),
        F.when(c % 3 == 0, "supports").when(c % 3 == 1, "calls").otherwise("depends_on").alias("type"),
        F.concat(F.lit("n"), c.cast("string")).alias("from_id"),
        F.concat(F.lit("n"), (c + 1 + F.col("c_nationkey") % 5).cast("string")).alias("to_id"),
        F.when(c % 2 == 0, "high").otherwise("low").alias("confidence"),
    )


def kg_sources(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        _project("o_custkey", 25).alias("project_id"),
        F.concat(F.when(o % 2 == 0, "n").otherwise("e"), F.col("o_custkey").cast("string")).alias("owner_id"),
        o.alias("ord"),
        F.when(o % 3 == 0, "src/index.ts").when(o % 3 == 1, "src/db/store.ts").otherwise("README.md").alias("file_path"),
        (o % 6 + 1).cast("int").alias("start_line"),
        (o % 6 + 1 + o % 5 - F.when(o % 11 == 0, 2).otherwise(0)).cast("int").alias("end_line"),
    )


def edge_list(spark: SparkSession, sf: str) -> DataFrame:
    """Bulk graph: suppliers point at parts of the same key space."""
    return (
        table(spark, sf, "lineitem")
        .select(F.col("l_suppkey").alias("source_id"), (F.col("l_partkey") + 1).alias("target_id"))
        .filter("source_id <> target_id")
        .distinct()
    )


def tree_units(spark: SparkSession, sf: str) -> DataFrame:
    """Two units per file of the large layout: its head and the rest."""
    ls = F.split("content", "\n", -1)
    halves = F.array(
        F.struct(F.lit(0).alias("no"), F.lit(1).alias("a"), F.least(F.size(ls), F.lit(10)).alias("b")),
        F.struct(F.lit(1).alias("no"), F.lit(11).alias("a"), F.size(ls).alias("b")),
    )
    rows = tree_files(spark, sf).select("*", ls.alias("ls"), F.explode(halves).alias("h")).filter("h.b >= h.a")
    d, no = F.col("doc_id"), F.col("h.no")
    none = F.array().cast("array<string>")
    return rows.select(
        F.concat(F.lit("t"), d.cast("string"), F.lit("-"), no.cast("string")).alias("id"),
        "project_id",
        "file_path",
        F.when(no == 0, "module").when(d % 2 == 0, "function").otherwise("class").alias("kind"),
        F.concat(F.regexp_replace(F.substring_index("file_path", "/", -1), r"\.[^.]*\z", ""), (d % 5).cast("string")).alias("name"),
        F.array_join(F.slice("ls", F.col("h.a"), F.col("h.b") - F.col("h.a") + 1), "\n").alias("code"),
        F.col("h.a").alias("start_line"),
        F.col("h.b").alias("end_line"),
        F.startswith("file_path", F.lit("vendor/")).alias("is_vendored"),
        F.when(d % 3 == 0, F.array(F.lit('import a from "./a"'), F.lit("import b"))).otherwise(none).alias("imports"),
        F.when(d % 4 == 1, F.array(F.lit("exportOne"), F.lit("shareLink"))).otherwise(none).alias("exported_names"),
        F.when(d % 5 == 2, F.array(F.lit("save"), F.lit("db.load"), F.lit("load"))).otherwise(none).alias("called_functions"),
        F.when(d % 6 == 3, F.lit("Keeps the record")).alias("docstring"),
    )
