"""Checking, repairing and cleaning the citations of answers against their context.

``answers``: (answer_id, project_id, answer). ``ctx``: (answer_id, id, file_path, name,
start_line, end_line, ord), the units an answer may cite. Range checks always carry
an equality key (answer, path), so they run as hash or sort-merge joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom import dims, rx
from srcloom.functions import citing, paths
from srcloom.functions.lists import rows_of

SYNTHESIS_SECTIONS = ["Product In One Paragraph", "What It Enables And Why It Matters"]


def extract(answers: DataFrame) -> DataFrame:
    """One row per distinct citation of an answer, parsed."""
    rows = rows_of(answers, ["answer_id"], citing.citations(F.col("answer")), "citation", "pos")
    return rows.withColumn("p", citing.parse(F.col("citation"))).select("answer_id", "pos", "citation", "p.*")


def citable_ranges(ctx: DataFrame) -> DataFrame:
    """Ranges an answer may cite, by full path and by basename when it is unique.

    A basename is unique when exactly one context unit carries it.
    """
    base = citing.normalize(paths.basename(F.col("file_path")))
    w = Window.partitionBy("answer_id", "base")
    rows = ctx.withColumns({"path": citing.normalize(F.col("file_path")), "base": base}).withColumn(
        "base_units", F.count("*").over(w)
    )
    keys = F.when(F.col("base_units") == 1, F.array_distinct(F.array("path", "base"))).otherwise(F.array("path"))
    return rows.withColumn("path", F.explode(keys)).drop("base", "base_units")


def source_keys(ctx: DataFrame) -> DataFrame:
    """Every accepted spelling of a citation per answer."""
    start, end = F.col("start_line").cast("string"), F.col("end_line").cast("string")
    span = F.concat(start, F.lit("-"), end)
    rows = citable_ranges(ctx)
    p, name = F.col("path"), F.col("name")
    spelled = F.array(
        p,
        F.concat_ws(":", p, name),
        F.concat_ws(":", p, start),
        F.concat_ws(":", p, span),
        F.concat_ws(":", p, name, span),
    )
    return rows.select("answer_id", F.explode(F.transform(spelled, citing.normalize)).alias("key")).distinct()


def judge(citations: DataFrame, ctx: DataFrame) -> DataFrame:
    """Add ``valid``: the cited lines lie inside a context unit of that path.

    A citation of lines only is valid when exactly one unit of the answer holds them.
    """
    by_path = citations.filter("not line_only and start_line is not null")
    ranges = citable_ranges(ctx).select(
        "answer_id", "path", F.col("start_line").alias("from_line"), F.col("end_line").alias("to_line")
    )
    inside = (F.col("start_line") >= F.col("from_line")) & (F.col("end_line") <= F.col("to_line"))
    path_ok = (
        by_path.join(ranges, ["answer_id", "path"]).filter(inside).select("answer_id", "citation").distinct()
    )
    lines = citations.filter("line_only").select("answer_id", "citation", "start_line", "end_line")
    units = ctx.select("answer_id", F.col("start_line").alias("from_line"), F.col("end_line").alias("to_line"))
    line_ok = (
        lines.join(units, "answer_id")
        .filter(inside)
        .groupBy("answer_id", "citation")
        .agg(F.count("*").alias("n"))
        .filter("n = 1")
        .select("answer_id", "citation")
    )
    ok = path_ok.unionByName(line_ok).withColumn("valid", F.lit(True))
    return citations.join(ok, ["answer_id", "citation"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def claims(answers: DataFrame, synthesis_sections: list[str] | None = None) -> DataFrame:
    """Claims of each answer with their citation and synthesis flags."""
    exempt = F.transform(
        citing.split_claims(citing.section_text(F.col("answer"), synthesis_sections or [])), citing.normalize_claim
    )
    rows = rows_of(answers, ["answer_id", exempt.alias("exempt")], citing.checked_claims(F.col("answer")), "claim", "pos")
    return rows.select(
        "answer_id",
        "pos",
        "claim",
        citing.has_citation(F.col("claim")).alias("cited"),
        F.array_contains("exempt", citing.normalize_claim(F.col("claim"))).alias("exempt"),
    )


def claim_status(claims_: DataFrame, judged: DataFrame, repaired: DataFrame | None = None) -> DataFrame:
    """verified / repaired / unverifiable / synthesis, with the citations of each claim."""
    c = judged.select("answer_id", "citation", "valid", F.col("pos").alias("cpos"))
    if repaired is None:
        c = c.withColumn("repaired", F.lit(False))
    else:
        fixed = repaired.select("answer_id", citing.normalize(F.col("citation")).alias("key")).distinct()
        c = c.withColumn("key", citing.normalize(F.col("citation"))).join(
            fixed.withColumn("repaired", F.lit(True)), ["answer_id", "key"], "left"
        ).fillna(False, ["repaired"])
    inside = F.contains("claim", F.col("citation"))
    found = (
        claims_.select("answer_id", "pos", "claim")
        .join(c, "answer_id")
        .filter(inside)
        .groupBy("answer_id", "pos")
        .agg(
            F.array_sort(F.collect_list(F.struct("cpos", "citation"))).alias("all"),
            F.count_if(~F.col("valid")).alias("n_invalid"),
            F.bool_or("repaired").alias("any_repaired"),
        )
    )
    joined = claims_.join(found, ["answer_id", "pos"], "left").fillna(0, ["n_invalid"])
    status = (
        F.when(F.col("n_invalid") > 0, "unverifiable")
        .when(~F.col("cited"), F.when(F.col("exempt"), "synthesis").otherwise("unverifiable"))
        .when(F.col("any_repaired"), "repaired")
        .otherwise("verified")
    )
    return joined.select(
        "answer_id", "pos", "claim", "cited", "exempt", status.alias("status"), "n_invalid",
        F.coalesce(F.col("all.citation"), F.array().cast("array<string>")).alias("citations"),
    )


def verify(answers: DataFrame, ctx: DataFrame, synthesis_sections: list[str] | None = None) -> DataFrame:
    """One row per answer: is it valid, and how many citations and claims fail."""
    judged = judge(extract(answers), ctx)
    c = judged.groupBy("answer_id").agg(F.count("*").alias("citations"), F.count_if(~F.col("valid")).alias("invalid"))
    u = claims(answers, synthesis_sections).groupBy("answer_id").agg(
        F.count("*").alias("claims"), F.count_if(~F.col("cited") & ~F.col("exempt")).alias("uncited")
    )
    out = answers.select("answer_id", "project_id").join(c, "answer_id", "left").join(u, "answer_id", "left")
    out = out.fillna(0, ["citations", "invalid", "claims", "uncited"])
    return out.withColumn("valid", (F.col("invalid") == 0) & (F.col("uncited") == 0))


def coverage(status: DataFrame, verified: DataFrame) -> DataFrame:
    """Counts per project over all answers."""
    counts = status.groupBy("answer_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("verified", "repaired", "unverifiable", "synthesis")]
    )
    rows = verified.join(counts, "answer_id", "left")
    sums = ["citations", "invalid", "claims", "uncited", "verified", "repaired", "unverifiable", "synthesis"]
    return rows.groupBy("project_id").agg(
        F.count("*").alias("answers"),
        F.count_if("valid").alias("valid_answers"),
        *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in sums],
    )


def repairs(judged: DataFrame, ctx: DataFrame) -> DataFrame:
    """For each invalid citation the unit of the same file that overlaps it most."""
    bad = judged.filter("not valid and not line_only").withColumns(
        {"want_start": F.coalesce("start_line", F.lit(1)), "want_end": F.coalesce("end_line", "start_line", F.lit(1))}
    )
    ranges = citable_ranges(ctx).select(
        "answer_id", "path", "file_path", F.col("start_line").alias("from_line"), F.col("end_line").alias("to_line"), "ord"
    )
    overlap = F.greatest(
        F.lit(0), F.least("to_line", "want_end") - F.greatest("from_line", "want_start") + 1
    )
    holds = (F.col("want_start") >= F.col("from_line")) & (F.col("want_start") <= F.col("to_line"))
    best = F.max_by(
        F.concat("file_path", F.lit(":"), F.col("from_line").cast("string"), F.lit("-"), F.col("to_line").cast("string")),
        F.struct((overlap * 10 + holds.cast("int")).alias("score"), -F.col("from_line"), -F.col("ord")),
    )
    return bad.join(ranges, ["answer_id", "path"]).groupBy("answer_id", "citation", "pos").agg(best.alias("replacement"))


def repair(answers: DataFrame, fixes: DataFrame) -> DataFrame:
    """Answers with the invalid citations replaced, in citation order."""
    per_answer = fixes.groupBy("answer_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "citation", "replacement"))).alias("fixes")
    )
    text = F.aggregate(
        F.coalesce("fixes", F.array().cast("array<struct<pos:int,citation:string,replacement:string>>")),
        F.col("answer"),
        lambda acc, f: F.replace(acc, f["citation"], f["replacement"]),
    )
    new = F.filter("fixes", lambda f: f["replacement"] != f["citation"])
    return answers.join(per_answer, "answer_id", "left").select(
        "answer_id",
        text.alias("answer"),
        F.array_distinct(F.coalesce(new["replacement"], F.array().cast("array<string>"))).alias("repaired"),
    )


def remove_uncited(answers: DataFrame, claims_: DataFrame) -> DataFrame:
    """Drop prose lines that hold an uncited claim; list items stay.

    A claim that spans no single line is cut out of the text itself.
    """
    per_answer = (
        claims_.filter("not cited and not exempt")
        .groupBy("answer_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "claim"))).alias("u"))
        .select("answer_id", F.col("u.claim").alias("uncited"))
    )

    def step(text, claim):
        ls = F.split(text, "\n", -1)
        hit = lambda line: F.contains(rx.trim(line), claim) & ~citing.is_list_item(line)
        in_list = F.exists(ls, lambda line: F.contains(line, claim) & citing.is_list_item(line))
        without = F.array_join(F.filter(ls, lambda line: ~hit(line)), "\n")
        at = F.instr(text, claim)
        cut = F.regexp_replace(
            F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(claim), F.length(text))),
            "[ \t]+\n",
            "\n",
        )
        return F.when(F.exists(ls, hit), without).when(in_list | (at == 0), text).otherwise(cut)

    cleaned = citing.squeeze(F.aggregate("uncited", F.col("answer"), step))
    return answers.join(per_answer, "answer_id", "left").select(
        "answer_id", F.when(F.col("uncited").isNull(), F.col("answer")).otherwise(cleaned).alias("answer")
    )


def remove_invalid(answers: DataFrame, judged: DataFrame) -> DataFrame:
    """Drop the lines that hold an invalid citation."""
    per_answer = judged.filter("not valid").groupBy("answer_id").agg(F.collect_set("citation").alias("bad"))
    kept = F.filter(
        F.split("answer", "\n", -1), lambda line: ~F.exists("bad", lambda c: F.contains(line, c))
    )
    return answers.join(per_answer, "answer_id", "left").select(
        "answer_id",
        F.when(F.col("bad").isNull(), F.col("answer")).otherwise(citing.squeeze(F.array_join(kept, "\n"))).alias("answer"),
    )


def weak_support_flags(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """Per line: does it claim more than its cited files can support?"""
    lines = answers.select("answer_id", F.posexplode(F.split("answer", "\n", -1)).alias("line_no", "line"))
    f = F.coalesce("path", citing.normalize(F.col("citation")))

    def any_path(pattern):
        return F.bool_or(rx.test(F.col("f"), pattern, "i"))

    cited = (
        lines.join(citations.select("answer_id", "citation", f.alias("f")), "answer_id")
        .filter(F.contains("line", F.col("citation")))
        .groupBy("answer_id", "line_no")
        .agg(
            any_path(dims.WEAK_SHARING_EVIDENCE).alias("e_sharing"),
            any_path(dims.WEAK_AI_EVIDENCE).alias("e_ai"),
            F.bool_and(rx.test(F.col("f"), dims.WEAK_AI_INTERNAL, "i")).alias("e_internal"),
            any_path(dims.WEAK_COLLAB_EVIDENCE).alias("e_collab"),
            any_path(dims.WEAK_AUTOMATION_EVIDENCE).alias("e_auto"),
            any_path(dims.WEAK_ACCESS_EVIDENCE).alias("e_access"),
            any_path(dims.WEAK_ACCESS_ONLY).alias("e_access_only"),
            any_path(dims.WEAK_PRIVACY_EVIDENCE).alias("e_privacy"),
        )
    )
    line, c = F.col("line"), F.col

    def says(pattern):
        return rx.test(line, pattern, "i")

    flags = {
        "weak_sharing": says(dims.WEAK_SHARING_LINE) & ~c("e_sharing") & says(dims.WEAK_SHARING_WORDS),
        "weak_usage": (says(dims.WEAK_COLLAB_LINE) & ~c("e_collab")) | (says(dims.WEAK_AUTOMATION_LINE) & ~c("e_auto")),
        "weak_ai": says(dims.WEAK_AI_LINE) & ~c("e_ai") & c("e_internal"),
        "weak_access": says(dims.WEAK_ACCESS_LINE) & ~c("e_access") & c("e_access_only"),
        "weak_privacy": says(dims.WEAK_PRIVACY_LINE) & ~c("e_privacy"),
    }
    joined = lines.join(cited, ["answer_id", "line_no"], "left")
    return joined.select(
        "answer_id", "line_no", "line", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in flags.items()]
    )


def remove_weak(answers: DataFrame, flagged: DataFrame) -> DataFrame:
    """Answers without the flagged lines; untouched when nothing is flagged."""
    weak = F.col("weak_sharing") | F.col("weak_usage") | F.col("weak_ai") | F.col("weak_access") | F.col("weak_privacy")
    doomed = flagged.filter(weak).groupBy("answer_id").agg(F.collect_set("line_no").alias("doomed"))
    kept = F.filter(
        F.transform(F.split("answer", "\n", -1), lambda line, i: F.when(~F.array_contains("doomed", i), line)),
        lambda line: line.isNotNull(),
    )
    return answers.join(doomed, "answer_id", "left").select(
        "answer_id",
        F.when(F.col("doomed").isNull(), F.col("answer")).otherwise(citing.squeeze(F.array_join(kept, "\n"))).alias("answer"),
    )


def accept_rewrite(old: DataFrame, new: DataFrame, problem: str, min_share: float) -> DataFrame:
    """Keep a rewrite only when it is long enough and has fewer problems.

    Both sides hold (answer_id, answer, ``problem``).
    """
    n = new.select("answer_id", F.col("answer").alias("new_answer"), F.col(problem).alias("new_problem"))
    better = (
        F.length("new_answer") >= F.greatest(F.lit(120.0), F.length("answer") * F.lit(min_share).cast("double"))
    ) & (F.col("new_problem") < F.col(problem))
    return old.join(n, "answer_id").select(
        "answer_id", better.alias("accepted"), F.when(better, F.col("new_answer")).otherwise(F.col("answer")).alias("answer")
    )


def citation_tag() -> Column:
    return F.concat(
        F.col("file_path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")
    )


def validate_evidence(items: DataFrame, ctx: DataFrame) -> DataFrame:
    """Facts whose citation is an allowed tag of the answer's context, without duplicates.

    ``items`` holds (answer_id, pos, fact, citation). A fact that carries citations of
    its own must have them all valid, and must not be an uncited claim.
    """
    allowed = ctx.select("answer_id", F.concat(F.lit("["), citation_tag(), F.lit("]")).alias("citation"), F.col("id").alias("unit_id"), "ord")
    # Two units may share a tag; the later one names the item.
    by_tag = allowed.groupBy("answer_id", "citation").agg(F.max_by("unit_id", "ord").alias("unit_id"))
    rows = (
        items.withColumns({"fact": rx.trim(F.col("fact")), "citation": rx.trim(F.col("citation"))})
        .filter("fact <> ''")
        .join(by_tag, ["answer_id", "citation"])
    )
    keyed = rows.withColumn("item_id", F.concat_ws("#", F.col("answer_id").cast("string"), F.col("pos").cast("string")))
    as_answers = keyed.select(
        F.col("item_id").alias("answer_id"), F.lit(0).cast("bigint").alias("project_id"), F.concat_ws(" ", "fact", "citation").alias("answer")
    )
    item_ctx = keyed.select("answer_id", "item_id").join(ctx, "answer_id").drop("answer_id").withColumnRenamed("item_id", "answer_id")
    good = verify(as_answers, item_ctx).filter("valid").select(F.col("answer_id").alias("item_id"))
    kept = keyed.join(good, "item_id", "left_semi")
    w = Window.partitionBy("answer_id", F.lower("fact"), "citation").orderBy("pos")
    return (
        kept.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("answer_id", "pos", "fact", "citation", "unit_id")
    )


def parse_choices(choices: DataFrame, allowed: DataFrame) -> DataFrame:
    """The tag or DROP that every model reply means: (answer_id, pos, choice), null where it means none.

    ``choices``: (answer_id, pos, reply); ``allowed``: (answer_id, choice). A reply may be the tag or DROP itself, a JSON object with
    a ``choice``, or a text whose first bracket is a tag; what holds first counts.
    """
    text = rx.trim(F.col("reply"))
    parsed = F.try_variant_get(F.try_parse_json(text), "$.choice", "string")
    bracket = F.nullif(rx.extract(text, r"(\[[^\]]+\])", 1), F.lit(""))
    read = choices.select("answer_id", "pos", F.posexplode(F.array(text, parsed, bracket)).alias("rank", "choice"))
    known = allowed.select("answer_id", "choice").distinct().withColumn("allowed", F.lit(True))
    rows = read.filter("choice is not null").join(known, ["answer_id", "choice"], "left")
    meant = F.col("allowed") | ((F.col("choice") == "DROP") & (F.col("rank") < 2))
    best = rows.filter(meant).groupBy("answer_id", "pos").agg(F.min_by("choice", "rank").alias("choice"))
    return choices.select("answer_id", "pos").join(best, ["answer_id", "pos"], "left")


def attach_choices(answers: DataFrame, claims_: DataFrame, choices: DataFrame, ctx: DataFrame) -> DataFrame:
    """Append the chosen tag to the first line that holds each uncited claim.

    ``choices`` holds (answer_id, pos, choice) with a tag or DROP. Only allowed tags
    count, so the tags themselves cannot be invalid; claims are taken in order, the
    first :data:`dims.CITATION_REPAIR_MAX_CALLS` of an answer. An answer that already
    has an invalid citation accepts nothing.
    """
    w = Window.partitionBy("answer_id").orderBy("pos")
    asked = (
        claims_.filter("not cited and not exempt")
        .withColumn("call", F.row_number().over(w))
        .filter(F.col("call") <= dims.CITATION_REPAIR_MAX_CALLS)
    )
    tags = ctx.select("answer_id", F.concat(F.lit("["), citation_tag(), F.lit("]")).alias("choice")).distinct()
    picked = (
        asked.join(choices, ["answer_id", "pos"], "left")
        .join(tags.withColumn("allowed", F.lit(True)), ["answer_id", "choice"], "left")
        .groupBy("answer_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "claim", F.when(F.col("allowed"), F.col("choice")).alias("tag")))).alias("picks"))
    )

    def step(acc, pick):
        claim, tag = pick["claim"], pick["tag"]
        ended = F.regexp_replace(claim, r"[ \t]*([.!?])[ \t]*\z", "")
        mark = F.regexp_extract(claim, r"([.!?])[ \t]*\z", 1)
        cited = F.concat(rx.trim(ended), F.lit(" "), tag, mark)
        ls = F.split(acc["text"], "\n", -1)
        first = F.array_position(F.transform(ls, lambda line: F.contains(line, claim)), True).cast("int")
        new = F.array_join(
            F.transform(
                ls,
                lambda line, i: F.when(
                    i + 1 == first,
                    F.concat(
                        F.substring(line, F.lit(1), F.instr(line, claim) - 1),
                        cited,
                        F.substring(line, F.instr(line, claim) + F.length(claim), F.length(line)),
                    ),
                ).otherwise(line),
            ),
            "\n",
        )
        done = tag.isNotNull() & (first > 0)
        return F.struct(
            F.when(done, new).otherwise(acc["text"]).alias("text"),
            (acc["attached"] + F.when(done, 1).otherwise(0)).alias("attached"),
        )

    invalid = judge(extract(answers), ctx).filter("not valid").select("answer_id").distinct()
    start = F.struct(F.col("answer").alias("text"), F.lit(0).alias("attached"))
    joined = answers.join(picked, "answer_id", "left").join(
        invalid.withColumn("broken", F.lit(True)), "answer_id", "left"
    )
    usable = F.when(F.col("broken").isNull(), F.col("picks"))
    folded = F.aggregate(usable, start, step)
    calls = F.coalesce(F.size(F.coalesce("picks", F.array().cast("array<struct<pos:int,claim:string,tag:string>>"))), F.lit(0))
    return joined.select(
        "answer_id",
        F.coalesce(folded["text"], F.col("answer")).alias("answer"),
        F.coalesce(folded["attached"], F.lit(0)).alias("attached"),
        calls.alias("calls"),
    ).withColumn("dropped", F.col("calls") - F.col("attached"))
