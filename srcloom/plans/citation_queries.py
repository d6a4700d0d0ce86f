"""Registered queries for citation checking, repair and answer cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcloom import dims
from srcloom.checks import sqlkit as q
from srcloom.checks import views
from srcloom.functions import citing
from srcloom.operators import citations as cit
from srcloom.registry import query
from srcloom.sources import corpus
from srcloom.staging import shared

A = "answer"

views.register(
    "v_ctx",
    """SELECT a.answer_id, u.id, u.file_path, u.name, u.start_line, u.end_line, row_number() OVER (PARTITION BY a.answer_id ORDER BY u.file_path, u.start_line, u.id) AS ord
      FROM answers a JOIN units u USING (project_id)""",
)


def context_units(spark, sf):
    """Units an answer may cite: ids, paths and lines only."""
    from pyspark.sql import Window

    heads = corpus.units(spark, sf).select("project_id", "id", "file_path", "name", "start_line", "end_line")
    w = Window.partitionBy("answer_id").orderBy("file_path", "start_line", "id")
    rows = corpus.answers(spark, sf).select("answer_id", "project_id").join(heads, "project_id")
    return rows.withColumn("ord", F.row_number().over(w)).drop("project_id")


# --- extraction -----------------------------------------------------------------------------------


def _brackets(x: str) -> str:
    """Bracket bodies; links are taken out first because RE2 cannot look ahead."""
    marked = f"replace({x}, '](', chr(2) || '(')"
    return f"list_transform({q.exall(marked, chr(92) + '[(' + dims.BRACKET_BODY + ')' + chr(92) + ']', 1)}, lambda b: {q.trim('b')})"


def _expand(body: str) -> str:
    parts = f"list_filter(list_transform(regexp_split_to_array({body}, ',' ), lambda p: {q.trim('p')}), lambda p: p <> '')"
    files = f"list_filter(list_transform(list_slice({parts}, 1, i - 1), lambda o: {q.ex('o', citing.WITH_FILE, 1)}), lambda o: o <> '')"
    return (
        f"CASE WHEN len({parts}) <= 1 THEN [{q.trim(body)}] ELSE list_transform({parts}, lambda p, i: CASE WHEN {q.ex('p', citing.WITH_FILE, 1)} = '' "
        f"AND {q.m('p', citing.RANGE)} AND len({files}) > 0 THEN concat({files}[-1], ':', p) ELSE p END) END"
    )


def citations_sql(source: str, key: str, text: str) -> str:
    """(key, citation, pos) of every row of ``source``."""
    return f"""SELECT {key}, cs[i] AS citation, i - 1 AS pos FROM (SELECT {key}, list_filter(al, lambda c, j: list_position(al, c) = j) AS cs FROM (
      SELECT {key}, br || list_filter(bare, lambda c: len(list_filter(br, lambda b: b = c OR ends_with(b, '/' || c))) = 0) AS al FROM (
        SELECT {key}, flatten(list_transform({_brackets(text)}, lambda body: {_expand('body')})) AS br, list_transform({q.exall(text, dims.BARE_CITATION, 1)}, lambda b: {q.trim('b')}) AS bare FROM {source}))), range(1, len(cs) + 1) r(i)"""


def norm_sql(x: str) -> str:
    return q.rep(f"lower({x})", r"\s+", "")


_CPAT = r"^(.+?)(?::(\d+)(?:-(\d+))?)?$"


def parsed_sql(source: str, key: str) -> str:
    c = q.trim("citation")
    return f"""SELECT {key}, pos, citation, CASE WHEN NOT lo THEN {norm_sql(q.ex(c, _CPAT, 1))} END AS path, s AS start_line, coalesce(e, s) AS end_line, lo AS line_only FROM (
      SELECT *, TRY_CAST(CASE WHEN lo THEN {q.ex(c, r'^(\d+)', 1)} ELSE {q.ex(c, _CPAT, 2)} END AS BIGINT) AS s,
        TRY_CAST(CASE WHEN lo THEN {q.ex(c, r'-(\d+)$', 1)} ELSE {q.ex(c, _CPAT, 3)} END AS BIGINT) AS e FROM (SELECT *, {q.m(c, citing.RANGE)} AS lo FROM ({source})))"""


views.register("v_cit", parsed_sql(citations_sql("answers", "answer_id", "answer"), "answer_id"))


@query("extract_citations", "SELECT answer_id, pos, citation FROM v_cit")
def _(spark, sf):
    return cit.extract(corpus.answers(spark, sf)).select("answer_id", "pos", "citation")


@query("parse_citation", "SELECT answer_id, citation, path, start_line, end_line, line_only FROM v_cit")
def _(spark, sf):
    return cit.extract(corpus.answers(spark, sf)).drop("pos")


@query(
    "expand_citation_group",
    f"""SELECT answer_id, body, array_to_string({_expand('body')}, '|') AS expanded FROM (SELECT DISTINCT answer_id, unnest({_brackets('answer')}) AS body FROM answers)""",
)
def _(spark, sf):
    rows = corpus.answers(spark, sf).select("answer_id", F.explode(citing.bracket_bodies(A)).alias("body")).distinct()
    return rows.withColumn("expanded", F.array_join(citing.expand_group(F.col("body")), "|"))


views.register(
    "v_ranges",
    f"""SELECT answer_id, id, file_path, name, start_line, end_line, ord, unnest(CASE WHEN n = 1 AND p <> b THEN [p, b] ELSE [p] END) AS path FROM (
      SELECT *, {norm_sql('file_path')} AS p, {norm_sql(q.basename('file_path'))} AS b, count(*) OVER (PARTITION BY answer_id, {norm_sql(q.basename('file_path'))}) AS n FROM v_ctx)""",
)


@query(
    "citation_keys",
    f"""SELECT DISTINCT answer_id, {norm_sql('k')} AS key FROM (SELECT answer_id, unnest([path, concat(path, ':', name), concat(path, ':', start_line), concat(path, ':', start_line, '-', end_line),
      concat(path, ':', name, ':', start_line, '-', end_line)]) AS k FROM v_ranges)""",
)
def _(spark, sf):
    return cit.source_keys(context_units(spark, sf))


views.register(
    "v_judged",
    """SELECT c.*, CASE WHEN line_only THEN (SELECT count(*) FROM v_ctx u WHERE u.answer_id = c.answer_id AND c.start_line >= u.start_line AND c.end_line <= u.end_line) = 1
      ELSE c.start_line IS NOT NULL AND EXISTS (SELECT 1 FROM v_ranges r WHERE r.answer_id = c.answer_id AND r.path = c.path AND c.start_line >= r.start_line AND c.end_line <= r.end_line) END AS valid FROM v_cit c""",
)


def judged(spark, sf):
    return shared(spark, sf, "judged", lambda: cit.judge(cit.extract(corpus.answers(spark, sf)), context_units(spark, sf)))


@query("invalid_citations", "SELECT answer_id, citation, pos, valid FROM v_judged")
def _(spark, sf):
    out = cit.judge(cit.extract(corpus.answers(spark, sf)), context_units(spark, sf))
    return out.select("answer_id", "citation", "pos", "valid")


# --- claims ------------------------------------------------------------------------------------------


def _claims_list(text: str) -> str:
    skip = " OR ".join(q.m("x", p, f) for p, f in dims.CLAIM_SKIP)
    sentences = f"flatten(list_transform(regexp_split_to_array({text}, chr(10) || '+'), lambda line: string_split({q.rep('line', r'([.!?])\s+', chr(92) + '1' + chr(10))}, chr(10))))"
    cleaned = f"list_transform({sentences}, lambda y: {q.trim(q.rep('y', r'^[-*]\s+', ''))})"
    return f"list_filter({cleaned}, lambda x: length(x) > 40 AND NOT ({skip}))"


def has_citation_sql(x: str) -> str:
    return f"(len({_brackets(x)}) > 0 OR {q.m(x, dims.BARE_CITATION)})"


def norm_claim_sql(x: str) -> str:
    return f"lower({q.trim(q.rep(f'''regexp_replace({x}, '[`*_~]', '', 'g')''', r'\s+', ' '))})"


@query("split_claims", f"SELECT answer_id, array_to_string({_claims_list('answer')}, chr(10)) AS claims FROM answers")
def _(spark, sf):
    return corpus.answers(spark, sf).select("answer_id", F.array_join(citing.split_claims(A), "\n").alias("claims"))


_TITLES = q.arr([t.lower() for t in cit.SYNTHESIS_SECTIONS])
_HEAD = r"^#{2,6}\s+(.*?)\s*$"
views.register(
    "v_section_text",
    f"""SELECT answer_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE heading IS NULL AND list_contains({_TITLES}, current)), '') AS body FROM (
      SELECT answer_id, i, line, heading, last_value(heading IGNORE NULLS) OVER (PARTITION BY answer_id ORDER BY i) AS current FROM (
        SELECT answer_id, i, ls[i] AS line, CASE WHEN {q.m('ls[i]', _HEAD)} THEN lower({q.trim(q.ex('ls[i]', _HEAD, 1))}) END AS heading
        FROM (SELECT answer_id, string_split(answer, chr(10)) AS ls FROM answers), range(1, len(ls) + 1) r(i))) GROUP BY answer_id""",
)


@query("section_claims", f"SELECT answer_id, array_to_string({_claims_list('body')}, chr(10)) AS claims FROM v_section_text")
def _(spark, sf):
    inside = citing.section_text(A, cit.SYNTHESIS_SECTIONS)
    return corpus.answers(spark, sf).select("answer_id", F.array_join(citing.split_claims(inside), "\n").alias("claims"))


views.register(
    "v_claims",
    f"""SELECT answer_id, i - 1 AS pos, cl[i] AS claim, {has_citation_sql('cl[i]')} AS cited, list_contains(ex, {norm_claim_sql('cl[i]')}) AS exempt FROM (
      SELECT a.answer_id, list_filter({_claims_list('answer')}, lambda c: NOT {q.m('c', dims.NAVIGATION_CLAIM, 'i')}) AS cl, list_transform({_claims_list('body')}, lambda e: {norm_claim_sql('e')}) AS ex
      FROM answers a JOIN v_section_text USING (answer_id)), range(1, len(cl) + 1) r(i)""",
)
views.register(
    "v_status",
    """SELECT c.answer_id, c.pos, c.claim, c.cited, c.exempt, coalesce(n_invalid, 0) AS n_invalid, coalesce(cs, '') AS citations,
      CASE WHEN coalesce(n_invalid, 0) > 0 THEN 'unverifiable' WHEN NOT c.cited THEN CASE WHEN c.exempt THEN 'synthesis' ELSE 'unverifiable' END
        WHEN coalesce(fixed, false) THEN 'repaired' ELSE 'verified' END AS status FROM v_claims c LEFT JOIN (
      SELECT c.answer_id, c.pos, count(*) FILTER (WHERE NOT valid) AS n_invalid, string_agg(citation, '|' ORDER BY j.pos) AS cs,
        bool_or(EXISTS (SELECT 1 FROM v_fixes f WHERE f.answer_id = j.answer_id AND f.replacement <> f.citation AND f.replacement = j.citation)) AS fixed
      FROM v_claims c JOIN v_judged j ON j.answer_id = c.answer_id AND contains(c.claim, j.citation) GROUP BY ALL) USING (answer_id, pos)""",
)
views.register(
    "v_fixes",
    """SELECT answer_id, citation, pos, arg_max(concat(file_path, ':', from_line, '-', to_line), (score, -from_line, -ord)) AS replacement FROM (
      SELECT c.answer_id, c.citation, c.pos, r.file_path, r.start_line AS from_line, r.end_line AS to_line, r.ord,
        greatest(0, least(r.end_line, coalesce(c.end_line, 1)) - greatest(r.start_line, coalesce(c.start_line, 1)) + 1) * 10
          + CASE WHEN coalesce(c.start_line, 1) BETWEEN r.start_line AND r.end_line THEN 1 ELSE 0 END AS score
      FROM v_judged c JOIN v_ranges r ON r.answer_id = c.answer_id AND r.path = c.path WHERE NOT c.valid AND NOT c.line_only) GROUP BY ALL""",
)


def _claims(spark, sf):
    return cit.claims(corpus.answers(spark, sf), cit.SYNTHESIS_SECTIONS)


def _fixes(spark, sf):
    return cit.repairs(judged(spark, sf), context_units(spark, sf))


@query("claim_status", "SELECT answer_id, pos, claim, cited, exempt, status, n_invalid, citations FROM v_status")
def _(spark, sf):
    fixed = _fixes(spark, sf).filter("replacement <> citation").select("answer_id", F.col("replacement").alias("citation"))
    out = cit.claim_status(_claims(spark, sf), judged(spark, sf), fixed)
    return out.withColumn("citations", F.array_join("citations", "|"))


views.register(
    "v_verified",
    """SELECT answer_id, project_id, citations, invalid, claims, uncited, invalid = 0 AND uncited = 0 AS valid FROM (
      SELECT answer_id, project_id, (SELECT count(*) FROM v_judged j WHERE j.answer_id = a.answer_id) AS citations, (SELECT count(*) FROM v_judged j WHERE j.answer_id = a.answer_id AND NOT valid) AS invalid,
        (SELECT count(*) FROM v_claims c WHERE c.answer_id = a.answer_id) AS claims, (SELECT count(*) FROM v_claims c WHERE c.answer_id = a.answer_id AND NOT cited AND NOT exempt) AS uncited FROM answers a)""",
)


@query("verify_answers", "SELECT * FROM v_verified")
def _(spark, sf):
    return cit.verify(corpus.answers(spark, sf), context_units(spark, sf), cit.SYNTHESIS_SECTIONS)


_S = ("verified", "repaired", "unverifiable", "synthesis")


@query(
    "citation_coverage",
    f"""SELECT project_id, count(*) AS answers, count(*) FILTER (WHERE valid) AS valid_answers, sum(citations)::BIGINT AS citations, sum(invalid)::BIGINT AS invalid, sum(claims)::BIGINT AS claims, sum(uncited)::BIGINT AS uncited,
      {', '.join(f"coalesce(sum({s}), 0)::BIGINT AS {s}" for s in _S)} FROM v_verified LEFT JOIN (
      SELECT answer_id, {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in _S)} FROM v_status GROUP BY answer_id) USING (answer_id) GROUP BY project_id""",
)
def _(spark, sf):
    fixed = _fixes(spark, sf).filter("replacement <> citation").select("answer_id", F.col("replacement").alias("citation"))
    status = cit.claim_status(_claims(spark, sf), judged(spark, sf), fixed)
    verified = cit.verify(corpus.answers(spark, sf), context_units(spark, sf), cit.SYNTHESIS_SECTIONS)
    return cit.coverage(status, verified)


# --- repair and cleaning ---------------------------------------------------------------------------------

views.register(
    "v_fix_seq",
    "SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY pos) AS n FROM v_fixes",
)


views.register(
    "v_repaired",
    """WITH RECURSIVE walk AS (SELECT answer_id, 0 AS n, answer FROM answers
        UNION ALL SELECT w.answer_id, f.n, replace(w.answer, f.citation, f.replacement) FROM walk w JOIN v_fix_seq f ON f.answer_id = w.answer_id AND f.n = w.n + 1)
      SELECT answer_id, arg_max(answer, n) AS answer FROM walk GROUP BY answer_id""",
)


@query(
    "repair_citations",
    """SELECT answer_id, answer, coalesce(repaired, '') AS repaired FROM v_repaired LEFT JOIN (SELECT answer_id, string_agg(replacement, '|' ORDER BY p) AS repaired FROM (
        SELECT answer_id, replacement, min(pos) AS p FROM v_fixes WHERE replacement <> citation GROUP BY answer_id, replacement) GROUP BY answer_id) USING (answer_id)""",
)
def _(spark, sf):
    out = cit.repair(corpus.answers(spark, sf), _fixes(spark, sf))
    return out.withColumn("repaired", F.array_join("repaired", "|"))


_SQUEEZE = "regexp_replace({0}, chr(10) || '{{3,}}', chr(10) || chr(10), 'g')"


def squeeze_sql(x: str) -> str:
    return q.trim(_SQUEEZE.format(x))


views.register("v_uncited", "SELECT answer_id, claim, row_number() OVER (PARTITION BY answer_id ORDER BY pos) AS n FROM v_claims WHERE NOT cited AND NOT exempt")
_LI = q.m("l", dims.LIST_ITEM)
views.register(
    "v_scrubbed",
    f"""WITH RECURSIVE walk AS (SELECT answer_id, 0 AS n, answer FROM answers
        UNION ALL SELECT w.answer_id, u.n, CASE
          WHEN len(list_filter(string_split(w.answer, chr(10)), lambda l: contains({q.trim('l')}, u.claim) AND NOT {_LI})) > 0
            THEN array_to_string(list_filter(string_split(w.answer, chr(10)), lambda l: NOT (contains({q.trim('l')}, u.claim) AND NOT {_LI})), chr(10))
          WHEN len(list_filter(string_split(w.answer, chr(10)), lambda l: contains(l, u.claim) AND {_LI})) > 0 OR NOT contains(w.answer, u.claim) THEN w.answer
          ELSE regexp_replace(concat(left(w.answer, position(u.claim IN w.answer) - 1), substr(w.answer, position(u.claim IN w.answer) + length(u.claim))), '[ \\t]+\\n', chr(10), 'g') END
        FROM walk w JOIN v_uncited u ON u.answer_id = w.answer_id AND u.n = w.n + 1)
      SELECT answer_id, CASE WHEN max(n) = 0 THEN arg_max(answer, n) ELSE {squeeze_sql('arg_max(answer, n)')} END AS answer FROM walk GROUP BY answer_id""",
)


@query("remove_uncited_claims", "SELECT * FROM v_scrubbed")
def _(spark, sf):
    return cit.remove_uncited(corpus.answers(spark, sf), _claims(spark, sf))


@query(
    "remove_invalid_claims",
    f"""SELECT answer_id, CASE WHEN bad IS NULL THEN answer ELSE {squeeze_sql("array_to_string(list_filter(string_split(answer, chr(10)), lambda l: len(list_filter(bad, lambda c: contains(l, c))) = 0), chr(10))")} END AS answer
      FROM answers LEFT JOIN (SELECT answer_id, list(citation) AS bad FROM v_judged WHERE NOT valid GROUP BY answer_id) USING (answer_id)""",
)
def _(spark, sf):
    return cit.remove_invalid(corpus.answers(spark, sf), judged(spark, sf))


def _i(x, p):
    return q.m(x, p, "i")


views.register(
    "v_weak",
    f"""SELECT answer_id, line_no, line,
      n > 0 AND {_i('line', dims.WEAK_SHARING_LINE)} AND NOT {'e_sharing'} AND {_i('line', dims.WEAK_SHARING_WORDS)} AS weak_sharing,
      n > 0 AND (({_i('line', dims.WEAK_COLLAB_LINE)} AND NOT e_collab) OR ({_i('line', dims.WEAK_AUTOMATION_LINE)} AND NOT e_auto)) AS weak_usage,
      n > 0 AND {_i('line', dims.WEAK_AI_LINE)} AND NOT e_ai AND e_internal AS weak_ai,
      n > 0 AND {_i('line', dims.WEAK_ACCESS_LINE)} AND NOT e_access AND e_only AS weak_access,
      n > 0 AND {_i('line', dims.WEAK_PRIVACY_LINE)} AND NOT e_privacy AS weak_privacy FROM (
      SELECT answer_id, line_no, line, count(f) AS n, coalesce(bool_or({_i('f', dims.WEAK_SHARING_EVIDENCE)}), false) AS e_sharing, coalesce(bool_or({_i('f', dims.WEAK_COLLAB_EVIDENCE)}), false) AS e_collab,
        coalesce(bool_or({_i('f', dims.WEAK_AUTOMATION_EVIDENCE)}), false) AS e_auto, coalesce(bool_or({_i('f', dims.WEAK_AI_EVIDENCE)}), false) AS e_ai, coalesce(bool_and({_i('f', dims.WEAK_AI_INTERNAL)}), false) AS e_internal,
        coalesce(bool_or({_i('f', dims.WEAK_ACCESS_EVIDENCE)}), false) AS e_access, coalesce(bool_or({_i('f', dims.WEAK_ACCESS_ONLY)}), false) AS e_only, coalesce(bool_or({_i('f', dims.WEAK_PRIVACY_EVIDENCE)}), false) AS e_privacy
      FROM (SELECT l.answer_id, l.line_no, l.line, coalesce(c.path, {norm_sql('c.citation')}) AS f FROM (SELECT answer_id, i - 1 AS line_no, ls[i] AS line
          FROM (SELECT answer_id, string_split(answer, chr(10)) AS ls FROM answers), range(1, len(ls) + 1) r(i)) l
        LEFT JOIN v_cit c ON c.answer_id = l.answer_id AND contains(l.line, c.citation)) GROUP BY ALL)""",
)


@query("weak_support_flags", "SELECT * FROM v_weak")
def _(spark, sf):
    answers = corpus.answers(spark, sf)
    return cit.weak_support_flags(answers, cit.extract(answers))


@query(
    "remove_weak_claims",
    f"""SELECT answer_id, CASE WHEN bool_or(weak) THEN {squeeze_sql("coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT weak), '')")} ELSE any_value(a.answer) END AS answer
      FROM (SELECT *, weak_sharing OR weak_usage OR weak_ai OR weak_access OR weak_privacy AS weak FROM v_weak) JOIN answers a USING (answer_id) GROUP BY answer_id""",
)
def _(spark, sf):
    answers = corpus.answers(spark, sf)
    return cit.remove_weak(answers, cit.weak_support_flags(answers, cit.extract(answers)))


@query(
    "accept_rewrite",
    f"""SELECT answer_id, ok AS accepted, CASE WHEN ok THEN new_answer ELSE answer END AS answer FROM (
      SELECT a.answer_id, a.answer, s.answer AS new_answer, length(s.answer) >= greatest(120.0, length(a.answer) * 0.35::DOUBLE)
        AND (SELECT count(*) FROM (SELECT unnest({_claims_list('s.answer')}) AS c) WHERE NOT {q.m('c', dims.NAVIGATION_CLAIM, 'i')} AND NOT {has_citation_sql('c')})
          < (SELECT count(*) FROM (SELECT unnest({_claims_list('a.answer')}) AS c) WHERE NOT {q.m('c', dims.NAVIGATION_CLAIM, 'i')} AND NOT {has_citation_sql('c')}) AS ok
      FROM answers a JOIN v_scrubbed s USING (answer_id))""",
)
def _(spark, sf):
    answers = corpus.answers(spark, sf)

    def with_uncited(df):
        counted = F.size(F.filter(citing.checked_claims(A), lambda c: ~citing.has_citation(c)))
        return df.select("answer_id", "answer", counted.alias("uncited"))

    scrubbed = cit.remove_uncited(answers, _claims(spark, sf))
    return cit.accept_rewrite(with_uncited(answers), with_uncited(scrubbed), "uncited", 0.35)


@query("normalize_claim_text", f"SELECT answer_id, {norm_claim_sql('answer')} AS text FROM answers")
def _(spark, sf):
    return corpus.answers(spark, sf).select("answer_id", citing.normalize_claim(A).alias("text"))


# Facts: each claim of an answer, with the tag of a context unit, a wrong tag or a repeat.
_TAG = "concat('[', file_path, ':', start_line, '-', end_line, ']')"


def _items(spark, sf):
    claims = _claims(spark, sf).select("answer_id", "pos", F.col("claim").alias("fact"))
    tagged = context_units(spark, sf).select(
        "answer_id", (F.col("ord") - 1).alias("pos"), F.concat(F.lit("["), cit.citation_tag(), F.lit("]")).alias("citation")
    )
    return claims.join(tagged, ["answer_id", "pos"])


views.register(
    "v_items",
    f"""SELECT concat(c.answer_id, '#', c.pos) AS item_id, c.answer_id, c.pos, {q.trim('c.claim')} AS fact, {_TAG} AS citation, concat({q.trim('c.claim')}, ' ', {_TAG}) AS text,
      (SELECT arg_max(o.id, o.ord) FROM v_ctx o WHERE o.answer_id = u.answer_id AND o.file_path = u.file_path AND o.start_line = u.start_line AND o.end_line = u.end_line) AS unit_id
      FROM v_claims c JOIN v_ctx u ON u.answer_id = c.answer_id AND u.ord = c.pos + 1""",
)
views.register("v_item_cit", parsed_sql(citations_sql("v_items", "item_id, answer_id", "text"), "item_id, answer_id"))


@query(
    "validate_evidence_items",
    f"""SELECT answer_id, pos, fact, citation, unit_id FROM (SELECT *, row_number() OVER (PARTITION BY answer_id, lower(fact), citation ORDER BY pos) AS rn FROM v_items
      WHERE len(list_filter({_claims_list('text')}, lambda z: NOT {q.m('z', dims.NAVIGATION_CLAIM, 'i')} AND NOT {has_citation_sql('z')})) = 0
        AND item_id NOT IN (SELECT item_id FROM v_item_cit c WHERE NOT CASE WHEN line_only THEN (SELECT count(*) FROM v_ctx u WHERE u.answer_id = c.answer_id AND c.start_line >= u.start_line AND c.end_line <= u.end_line) = 1
          ELSE c.start_line IS NOT NULL AND EXISTS (SELECT 1 FROM v_ranges r WHERE r.answer_id = c.answer_id AND r.path = c.path AND c.start_line >= r.start_line AND c.end_line <= r.end_line) END)) WHERE rn = 1""",
)
def _(spark, sf):
    return cit.validate_evidence(_items(spark, sf), context_units(spark, sf))


# Replies to the question for a tag: the tag, JSON, a sentence around it, or a refusal.
_REPLIES = "CASE pos % 5 WHEN 0 THEN concat(' ', citation, chr(10)) WHEN 1 THEN concat('{\"choice\": \"', citation, '\"}') WHEN 2 THEN concat('I take ', citation, ' here [x].') WHEN 3 THEN '{\"choice\": \"DROP\"}' ELSE '[no.ts:1-2]' END"
views.register("v_replies", f"SELECT answer_id, pos, {_REPLIES.replace('chr(10)', 'chr(10)')} AS reply, citation FROM v_items")
views.register(
    "v_choices",
    f"""SELECT answer_id, pos, CASE WHEN EXISTS (SELECT 1 FROM v_ctx u WHERE u.answer_id = r.answer_id AND {_TAG} = r.citation) AND pos % 5 < 3 THEN citation WHEN pos % 5 = 3 THEN 'DROP' END AS choice FROM v_replies r""",
)


@query("parse_citation_choices", "SELECT answer_id, pos, choice FROM v_choices")
def _(spark, sf):
    return cit.parse_choices(_replies(spark, sf), _allowed(spark, sf))


def _replies(spark, sf):
    return _items(spark, sf).select("answer_id", "pos", F.expr(_REPLIES).alias("reply"))


def _allowed(spark, sf):
    return context_units(spark, sf).select("answer_id", F.concat(F.lit("["), cit.citation_tag(), F.lit("]")).alias("choice"))


_ENDED = "regexp_replace(claim, '[ \\t]*([.!?])[ \\t]*\\z', '')"
_CITED = f"concat({q.trim(_ENDED)}, ' ', choice, regexp_extract(claim, '([.!?])[ \\t]*\\z', 1))"
views.register(
    "v_picks",
    f"""SELECT * FROM (SELECT c.answer_id, c.pos, c.claim, CASE WHEN h.choice <> 'DROP' THEN h.choice END AS choice, row_number() OVER (PARTITION BY c.answer_id ORDER BY c.pos) AS call
      FROM v_claims c LEFT JOIN v_choices h USING (answer_id, pos) WHERE NOT c.cited AND NOT c.exempt) WHERE call <= {dims.CITATION_REPAIR_MAX_CALLS}""",
)
views.register(
    "v_attach_walk",
    f"""WITH RECURSIVE walk AS (SELECT a.answer_id, a.answer AS text, 0 AS attached, 0 AS call FROM answers a WHERE a.answer_id NOT IN (SELECT answer_id FROM v_judged WHERE NOT valid)
      UNION ALL SELECT w.answer_id, CASE WHEN choice IS NOT NULL AND contains(w.text, claim) THEN concat(left(w.text, instr(w.text, claim) - 1), {_CITED}, substr(w.text, instr(w.text, claim) + length(claim))) ELSE w.text END,
        w.attached + CASE WHEN choice IS NOT NULL AND contains(w.text, claim) THEN 1 ELSE 0 END, w.call + 1 FROM walk w JOIN v_picks p ON p.answer_id = w.answer_id AND p.call = w.call + 1)
      SELECT answer_id, arg_max(text, call) AS text, max(attached) AS attached FROM walk GROUP BY answer_id""",
)


@query(
    "attach_selected_citations",
    """SELECT a.answer_id, coalesce(w.text, a.answer) AS answer, coalesce(w.attached, 0) AS attached, coalesce(n, 0) AS calls, coalesce(n, 0) - coalesce(w.attached, 0) AS dropped
      FROM answers a LEFT JOIN v_attach_walk w USING (answer_id) LEFT JOIN (SELECT answer_id, count(*) AS n FROM v_picks GROUP BY answer_id) USING (answer_id)""",
)
def _(spark, sf):
    choices = cit.parse_choices(_replies(spark, sf), _allowed(spark, sf))
    return cit.attach_choices(corpus.answers(spark, sf), _claims(spark, sf), choices, context_units(spark, sf))
