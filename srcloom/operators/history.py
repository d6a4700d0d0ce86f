"""Sessions, messages, follow-up history and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom import dims, rx
from srcloom.functions import paths
from srcloom.sources import store


def is_completed() -> Column:
    return (F.trim("brief") != "") & ~F.col("generation_truncated")


def latest_completed(sessions: DataFrame) -> DataFrame:
    """Newest completed session of each project."""
    newest = F.struct("updated_at", "created_at", "session_id")
    row = F.struct(*sessions.columns)
    return sessions.filter(is_completed()).groupBy("project_id").agg(F.max_by(row, newest).alias("r")).select("r.*")


def briefing_rollup(projects: DataFrame, sessions: DataFrame) -> DataFrame:
    latest = sessions.filter(is_completed()).groupBy("project_id").agg(F.max("updated_at").alias("latest_briefing_at"))
    return projects.join(latest, "project_id", "left").withColumn(
        "has_completed_briefing", F.col("latest_briefing_at").isNotNull()
    )


def message_tail(messages: DataFrame, n: int = 12) -> DataFrame:
    """Last ``n`` messages of a session, numbered oldest first."""
    tail = store.latest_first(messages, ["session_id"], [F.desc("ord")], n)
    w = Window.partitionBy("session_id").orderBy("ord")
    return tail.drop("rn").withColumn("pos", F.row_number().over(w))


def question_answer_pairs(messages: DataFrame) -> DataFrame:
    """Question and the answer that directly follows it."""
    w = Window.partitionBy("session_id").orderBy("ord")
    paired = messages.select(
        "session_id",
        "ord",
        "role",
        F.col("content").alias("question"),
        F.lead("role").over(w).alias("next_role"),
        F.lead("content").over(w).alias("answer"),
    )
    return paired.filter("role = 'user' and next_role = 'assistant'").select("session_id", "ord", "question", "answer")


def trim_text(text: Column, limit: int) -> Column:
    """Cut a text at a natural break before ``limit`` characters and mark the cut."""
    head = F.substring(text, 1, limit)
    backwards = F.reverse(head)

    def last_index(sign: str) -> Column:
        at = F.instr(backwards, sign[::-1])
        return F.when(at > 0, F.length(head) - at - len(sign) + 1).otherwise(-1)

    stop = F.greatest(last_index("\n\n"), last_index("\n- "), last_index(". "))
    body = F.when(stop > limit * 0.5, F.substring(head, F.lit(1), stop + 1)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(rx.trim(body), F.lit("\n[Truncated]")))


def followup_history(messages: DataFrame) -> DataFrame:
    """Last six pairs of a session, cleaned; the last two also in prompt form."""
    recent = store.latest_first(question_answer_pairs(messages), ["session_id"], [F.desc("ord")], 6)
    cleaned = recent.withColumns({"question": rx.trim(F.col("question")), "answer": rx.trim(F.col("answer"))})
    valid = cleaned.filter("question <> '' and answer <> ''").withColumns(
        {"question": F.substring("question", 1, 1200), "answer": F.substring("answer", 1, 2400)}
    )
    w = Window.partitionBy("session_id").orderBy(F.desc("ord"))

    def squeezed(name):
        return rx.trim(rx.replace(F.col(name), r"\s+", " "))

    prompt = F.concat(
        F.lit("User: "), trim_text(squeezed("question"), 180), F.lit("\nAssistant: "), trim_text(squeezed("answer"), 240)
    )
    return valid.withColumn("age", F.row_number().over(w)).select(
        "session_id", "ord", "question", "answer", F.when(F.col("age") <= 2, prompt).alias("prompt_line")
    )


def session_source_files(sessions: DataFrame) -> DataFrame:
    files = store.lenient_string_array(F.col("source_files_json"))
    return sessions.select("session_id", F.slice(F.array_distinct(files), 1, dims.FUSED_TOP_K).alias("source_files"))


def markdown_report(sessions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Briefing, numbered sources and follow-ups of each session as markdown."""
    follow = (
        pairs.groupBy("session_id")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "question", "answer"))).alias("f"))
        .select("session_id", "f")
    )
    files = store.lenient_string_array(F.col("source_files_json"))
    source_lines = F.transform(
        files,
        lambda p, i: F.concat(
            (i + 1).cast("string"), F.lit(". "), p, F.lit(" (module "), F.substring_index(p, "/", -1), F.lit(", lines 1-1)")
        ),
    )
    no_sources = F.array(F.lit("No sources were returned for this briefing."))
    head = F.array(
        F.concat(F.lit("# project-"), F.col("project_id").cast("string"), F.lit(" - Codebase Briefing")),
        F.lit(""),
        F.concat(F.lit("Generated: "), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")),
        F.concat(F.lit("Project: project-"), F.col("project_id").cast("string")),
        F.lit(""), F.lit("## Briefing"), F.lit(""), rx.trim(F.col("brief")), F.lit(""), F.lit("## Sources"), F.lit(""),
    )
    turns = F.flatten(
        F.transform(
            "f",
            lambda x, i: F.array(
                F.concat(F.lit("### "), (i + 1).cast("string"), F.lit(". "), F.replace("audience", F.lit("_"), F.lit(" "))),
                F.lit(""),
                F.concat(F.lit("Question: "), rx.trim(x["question"])),
                F.lit(""),
                rx.trim(x["answer"]),
                F.lit(""),
            ),
        )
    )
    tail = F.when(
        F.size("f") > 0, F.concat(F.array(F.lit(""), F.lit("## Follow-up Questions"), F.lit("")), turns)
    ).otherwise(F.array().cast("array<string>"))
    body = F.concat(head, F.when(F.size(files) > 0, source_lines).otherwise(no_sources), tail)
    return sessions.join(follow, "session_id", "left").select(
        "session_id", F.concat(rx.trim(F.array_join(body, "\n")), F.lit("\n")).alias("report")
    )


def write_reports(reports: DataFrame, path: str) -> None:
    """One text row per report; the number of output files follows the data."""
    reports.select("report").write.mode("overwrite").option("lineSep", "\n").text(path)


# --- reading slices of files --------------------------------------------------------------------


def is_safe_reference(p: Column) -> Column:
    parts = F.split(paths.normalize(p), "/", -1)
    return (rx.trim(p) != "") & ~F.arrays_overlap(parts, F.array(F.lit(".."), F.lit("")))


def read_line_range(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Lines ``start_line``..``end_line`` of the referenced files."""
    code = F.array_join(
        F.slice(F.split("content", "\r?\n", -1), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1),
        "\n",
    )
    return (
        refs.filter(is_safe_reference(F.col("file_path")) & (F.col("end_line") >= F.col("start_line")))
        .join(files.select("project_id", "file_path", "content"), ["project_id", "file_path"])
        .withColumn("code", code)
        .drop("content")
    )


def read_excerpt(files: DataFrame) -> DataFrame:
    """Leading lines of a file for a survey, with a mark when something is left out."""
    ls = F.split("content", "\r?\n", -1)
    cut = (F.col("bytes") > dims.SURVEY_FILE_BYTES) | (F.size(ls) > dims.SURVEY_EXCERPT_LINES)
    kept = F.slice(ls, 1, dims.SURVEY_EXCERPT_LINES)
    marks = F.when(cut, F.array_append("signals", F.lit("excerpt_truncated"))).otherwise(F.col("signals"))
    return files.select(
        "project_id",
        "file_path",
        F.lit(1).alias("start_line"),
        F.greatest(F.lit(1), F.size(kept)).alias("end_line"),
        F.array_join(kept, "\n").alias("text"),
        marks.alias("signals"),
    )


def lookup_units(requests: DataFrame, heads: DataFrame) -> DataFrame:
    """Units asked for by id, file, name or class, as one batch.

    ``requests`` holds (request_id, project_id, by, key).
    """
    c = F.col
    keys = F.array(
        F.struct(F.lit("id").alias("by"), c("id").alias("key")),
        F.struct(F.lit("file").alias("by"), c("file_path").alias("key")),
        F.struct(F.lit("name").alias("by"), c("name").alias("key")),
        F.struct(F.lit("class").alias("by"), F.when(c("kind") == "method", c("parent_name")).alias("key")),
    )
    indexed = heads.select("project_id", "id", F.explode(keys).alias("k")).select("project_id", "id", "k.by", "k.key")
    return requests.join(indexed.filter("key is not null"), ["project_id", "by", "key"]).select(
        "request_id", "project_id", "by", "key", F.col("id").alias("unit_id")
    )
