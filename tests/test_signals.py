"""Source signals by the words of a text, next to the patterns they stand for."""

from pyspark.sql import functions as F

from srcloom import dims, rx
from srcloom.functions import paths, signals
from srcloom.operators import survey

TEXTS = [
    "", "select", "preselect", "SELECT*", "x_select", "flag.x", "flag. x", "process.argv", "a std::env::args()", "std::env::argsx", "System.Console",
    "readFileSync(", "unreadFile", "fs.x", "fs. ", "offs.x", "open(x", "open( x", "HTTP.get", "http.", "listen(a", "net/http", "net/httpx", "Result<T", "Result< T",
    "type  x", "type\u00a0x", "type \u00e9", "TYPE", "\u212a\u017felect", "\u00e9select\u00e9", "window.a", "window.\u00e9", "log.x", "catalog.x", "  import x", "x\nimport y",
]


def test_signals_are_those_of_the_patterns(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    rules = sorted(dims.SIGNAL_RULES, key=lambda r: (-r[1], r[0]))
    path = F.lit("src/a.ts")
    plain = F.array_compact(F.array(*[F.when(rx.test(path if on == "path" else F.col("text"), p, f), F.lit(k)) for k, _, _, on, p, f in rules]))
    got = rows.select("i", "text", plain.alias("plain"), signals.source_signals(path, F.col("text"))["kind"].alias("kinds")).collect()
    assert [(r.text, r.kinds) for r in got] == [(r.text, r.plain) for r in got]
    assert len({tuple(r.kinds) for r in got}) > 8


def test_plain_words_are_looked_up_once_per_text(spark):
    plan = spark.createDataFrame([("a", "b")], "p string, t string").select(signals.source_signals(F.col("p"), F.col("t")).alias("s"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("postgres") <= 1 and "|postgres" not in text


def test_scoring_of_files_is_spread_over_tasks(spark):
    files = spark.createDataFrame([(1, f"src/f{i}.ts", 3, "x=1") for i in range(40)], "project_id long, file_path string, bytes long, content string").coalesce(1)
    none = spark.createDataFrame([], "project_id long, prefix string")
    assert "RepartitionByExpression" in survey.inventory(files, none)._jdf.queryExecution().optimizedPlan().toString()
