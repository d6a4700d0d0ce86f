"""Path and file-name columns. Everything here is row-local."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from srcloom import dims, rules, rx


def strings(items) -> Column:
    return F.array(*[F.lit(i) for i in items])


def lit_map(mapping: dict) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.create_map(*pairs)


def normalize(p: Column) -> Column:
    return F.translate(p, "\\", "/")


def basename(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def dirname(p: Column) -> Column:
    return F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, r"/[^/]*\z", "")).otherwise(".")


def extname(p: Column) -> Column:
    """Last dot onwards; a leading dot alone does not start an extension."""
    return F.regexp_extract(basename(p), r"(?s)^.+(\.[^.]*)\z", 1)


def stem(p: Column) -> Column:
    return F.regexp_replace(basename(p), r"(?s)^(.+)\.[^.]*\z", "$1")


def depth(p: Column) -> Column:
    return F.size(F.split(p, "/", -1)) - 1


def is_sensitive(p: Column) -> Column:
    low = F.lower(normalize(p))
    parts = F.filter(F.split(low, "/", -1), lambda x: x != "")
    base = F.element_at(F.concat(F.array(F.lit("")), parts), -1)
    return (
        F.arrays_overlap(parts, strings(dims.SENSITIVE_DIRS))
        | base.isin(dims.SENSITIVE_NAMES)
        | rx.test(base, r"^\.env[.-]")
        | rx.test(base, dims.SENSITIVE_CONFIG)
        | extname(base).isin(dims.SENSITIVE_EXTENSIONS)
    )


def is_test_file(p: Column) -> Column:
    return rx.test(p, dims.TEST_FILE)


def is_documentation(p: Column) -> Column:
    return rx.test(p, dims.DOC_FILE, "i")


def is_overview_doc(p: Column) -> Column:
    return rx.test(F.lower(p), dims.OVERVIEW_DOC)


def is_narrow_reference_doc(p: Column) -> Column:
    return is_documentation(p) & ~is_overview_doc(p) & rx.test(F.lower(p), dims.NARROW_DOC_DIR)


def is_noise(p: Column) -> Column:
    return rx.test(F.lower(p), dims.NOISE_FILE)


def is_package_boundary(p: Column) -> Column:
    return rx.test(p, dims.PACKAGE_BOUNDARY)


def is_usable(p: Column, is_vendored: Column) -> Column:
    return ~is_vendored & ~is_noise(p) & ~is_test_file(p)


def evidence_buckets(p: Column) -> Column:
    """Evidence classes of a path in rule order; documentation stops early."""
    cols = {"path_lower": F.lower(p)}

    def labels(table):
        return [F.when(rules.holds(cond, cols), F.lit(name)) for name, cond in table]

    doc = F.array_compact(F.array(*labels(dims.DOC_BUCKETS)))
    code = F.array_distinct(F.array_compact(F.array(*labels(dims.CODE_BUCKETS))))
    return F.when(is_documentation(p), doc).otherwise(code)


def language_label(ext: Column) -> Column:
    known = F.try_element_at(lit_map(dims.SURVEY_LABELS), ext)
    return F.coalesce(known, F.upper(F.regexp_replace(ext, r"^\.", "")))


def safe_file_name(text: Column, default: str = "briefing") -> Column:
    dashed = F.regexp_replace(rx.trim(text), "[^a-zA-Z0-9._-]+", "-")
    cut = F.substring(F.regexp_replace(dashed, r"^-+|-+\z", ""), 1, 80)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(default))


def _strip_end(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, rf"(?:{pattern})+\z", "")


def normalize_git_remote(url: Column) -> Column:
    return F.lower(_strip_end(_strip_end(_strip_end(rx.trim(url), "/"), r"\.git"), "/"))


def parse_repository(ref: Column) -> Column:
    """struct(owner, repo, url, ok) of a hosted repository reference."""
    value = _strip_end(rx.trim(ref), "/")
    value = F.regexp_replace(value, r"^(?:git@github\.com:|https://github\.com/|http://github\.com/|github\.com/)", "")
    value = _strip_end(_strip_end(F.regexp_extract(value, r"^[^?#]*", 0), r"\.git"), "/")
    parts = F.filter(F.split(value, "/", -1), lambda x: x != "")
    safe = F.forall(parts, lambda x: x.rlike(r"^[A-Za-z0-9._-]+\z") & ~x.isin(".", ".."))
    ok = (F.size(parts) == 2) & safe
    owner, repo = F.get(parts, 0), F.get(parts, 1)
    return F.struct(
        F.when(ok, owner).alias("owner"),
        F.when(ok, repo).alias("repo"),
        F.when(ok, F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo, F.lit(".git"))).alias("url"),
        ok.alias("ok"),
    )
