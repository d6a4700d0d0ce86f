"""Import graph: specifiers, resolution, traversal and directory views."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom import dims, rx
from srcloom.functions import paths


def import_specifiers(units: DataFrame) -> DataFrame:
    """Local specifiers per file and import statement, with the place they were first seen."""
    stated = (
        units.select("project_id", "file_path", "start_line", "id", F.posexplode("imports").alias("pos", "import"))
        .groupBy("project_id", F.col("file_path").alias("source_file"), F.col("import").alias("import_statement"))
        .agg(F.min(F.struct("start_line", "id", "pos")).alias("seen"))
    )
    text = F.col("import_statement")
    found = F.array_distinct(F.concat(*[rx.extract_all(text, p, 1, f) for p, f in dims.IMPORT_SPECIFIERS]))
    local = rx.test(F.col("specifier"), r"^(\.|@/|src/)")
    return (
        stated.select("*", F.posexplode(found).alias("spec_pos", "specifier"))
        .filter(local)
        .select(
            "project_id",
            "source_file",
            "import_statement",
            "specifier",
            F.struct("seen.start_line", "seen.id", "seen.pos", "spec_pos").alias("seen"),
        )
    )


def normalize_path(p: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; a trailing slash survives."""

    def step(stack, part):
        can_pop = (F.size(stack) > 0) & (F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit("..")) != "..")
        return (
            F.when((part == "") | (part == "."), stack)
            .when((part == "..") & can_pop, F.slice(stack, F.lit(1), F.size(stack) - 1))
            .otherwise(F.array_append(stack, part))
        )

    folded = F.array_join(F.aggregate(F.split(p, "/", -1), F.array().cast("array<string>"), step), "/")
    slash = F.when(F.endswith(p, F.lit("/")) & (folded != ""), F.lit("/")).otherwise("")
    return F.when(folded == "", F.lit(".")).otherwise(F.concat(folded, slash))


def _resolved(source: Column, specifier: Column) -> Column:
    relative = F.concat(paths.dirname(source), F.lit("/"), specifier)
    rooted = F.regexp_replace(specifier, "^@/", "src/")
    return normalize_path(F.when(F.startswith(specifier, F.lit(".")), relative).otherwise(rooted))


def _candidates(resolved: Column) -> Column:
    bare = F.regexp_replace(resolved, r"/\z", "")
    ext = paths.extname(bare)
    extless = F.when(ext == "", resolved).otherwise(paths_without_ext(bare))
    folder = F.regexp_replace(F.regexp_replace(extless, r"/\z", ""), r"^\.\z", "")
    suffixed = [
        F.regexp_replace(F.concat(folder, F.lit(s)), "^/", "") if s.startswith("/") else F.concat(extless, F.lit(s))
        for s in dims.RESOLVE_SUFFIXES
    ]
    return F.array_distinct(F.array(resolved, extless, *suffixed))


def paths_without_ext(p: Column) -> Column:
    return F.regexp_replace(p, r"(?s)^((?:.*/)?[^/]+)\.[^./]*\z", "$1")


def resolve_dependencies(specifiers: DataFrame, files: DataFrame) -> DataFrame:
    """Edges between existing files; the first candidate path that exists wins.

    What a specifier means depends only on its project and normalised path, so
    candidates are looked up once per distinct path, however many files import it.
    """
    wanted = specifiers.withColumn("resolved", _resolved(F.col("source_file"), F.col("specifier")))
    known = files.select("project_id", F.col("file_path").alias("candidate")).distinct()
    targets = (
        wanted.select("project_id", "resolved")
        .distinct()
        .select("project_id", "resolved", F.posexplode(_candidates(F.col("resolved"))).alias("pos", "candidate"))
        .join(known, ["project_id", "candidate"])
        .groupBy("project_id", "resolved")
        .agg(F.min_by("candidate", "pos").alias("target_file"))
    )
    return (
        wanted.join(targets, ["project_id", "resolved"])
        .groupBy("project_id", "source_file", "target_file")
        .agg(F.min_by("import_statement", "seen").alias("import_statement"))
        .withColumn("edge_type", F.lit("imports"))
    )


#: Lists that the neighbours of a node are dealt to, so that no query's nodes meet in one task.
_PARTS = 16


def _part(node: Column) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(_PARTS)).cast("int")


def _walk(seeds: DataFrame, edges: DataFrame, depth: int, keys: list[str], direction: str) -> DataFrame:
    """Lists of nodes reached from the seeds of each query, with the depth; a node may be in several lists."""
    near, far = ("source", "target") if direction == "upstream" else ("target", "source")
    group = [c for c in seeds.columns if c != "node"]
    hop = edges.groupBy(*keys, F.col(near).alias("node"), _part(F.col(far)).alias("part")).agg(F.collect_set(far).alias("nodes"))
    frontier = seen = seeds.distinct()
    out = frontier.select(*group, _part(F.col("node")).alias("part"), F.lit(0).alias("depth"), F.array("node").alias("nodes"))
    for level in range(1, depth + 1):
        reached = frontier.join(hop, [*keys, "node"]).select(*group, "part", F.lit(level).alias("depth"), "nodes")
        out = out.unionByName(reached)
        if level < depth:
            frontier = reached.select(*group, F.explode("nodes").alias("node")).distinct().join(seen, [*group, "node"], "left_anti")
            seen = seen.unionByName(frontier)
    return out.withColumn("down", F.lit(int(direction == "downstream")))


_NUMBERS = ("tinyint", "smallint", "int", "bigint")
#: Parts of the nodes and buckets of the queries whose product makes the cells of a walk over numbers, the queries that share
#: one entry of a node, and the nodes that are united at once.
_NODE_PARTS, _BUCKETS, _ASKERS, _AT_ONCE = 32, 2, 4096, 1 << 20
_NO_QUERY = -1


def _number_lists(seeds: DataFrame, edges: DataFrame, depth: int, direction: str) -> DataFrame:
    """(part, bucket, nodes, askers, bests): neighbours of a node in one part, beside the queries that walk on from the node.

    The neighbours are listed once for all queries of a bucket, so what is shuffled grows with the edges and with the steps
    before the last, not with the nodes that the last step reaches.
    """
    near, far = ("source", "target") if direction == "upstream" else ("target", "source")
    down = int(direction == "downstream")
    # Written out, the filter is the same for both directions and all steps, so the edges are shuffled once for them.
    whole = edges.filter(F.col("source").isNotNull() & F.col("target").isNotNull())
    links = whole.select(F.col(near).cast("bigint").alias("node"), F.col(far).cast("bigint").alias("far"))
    part = F.pmod(F.xxhash64("far"), F.lit(_NODE_PARTS)).cast("int")
    hop = links.repartition("node").groupBy("node", part.alias("part")).agg(F.collect_set("far").alias("nodes"))
    # Only nodes that lead somewhere are walked on from.
    inner = links.join(links.select(F.col("node").alias("far")).distinct(), "far", "left_semi")
    frontier = seen = seeds
    steps = [frontier.withColumn("best", F.lit(2 + down))]
    for level in range(1, depth):
        reached = frontier.join(inner, "node").select("bucket", "query", F.col("far").alias("node")).distinct()
        frontier = reached.join(seen, ["bucket", "query", "node"], "left_anti")
        seen = seen.unionByName(frontier)
        steps.append(frontier.withColumn("best", F.lit(2 * (level + 1) + down)))
    nth = F.row_number().over(Window.partitionBy("node", "bucket").orderBy("query", "best"))
    asked = (
        reduce(DataFrame.unionByName, steps)
        .repartition("node")
        .withColumn("block", F.floor((nth - 1) / _ASKERS))
        .groupBy("node", "bucket", "block")
        .agg(F.collect_list(F.struct("query", "best")).alias("asked"))
    )
    return asked.join(hop, "node").select("part", "bucket", "nodes", F.col("asked.query").alias("askers"), F.col("asked.best").alias("bests"))


def _flat(batches: list, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All items of a list column, and the lengths of its lists."""
    lists = [b.column(name) for b in batches]
    return np.concatenate([x.flatten().to_numpy() for x in lists]), np.concatenate([x.value_lengths().to_numpy() for x in lists])


def _united(batches: list):
    """(query, best, nodes) of one cell: each node once per query, with the least of its numbers."""
    nodes, n_nodes = _flat(batches, "nodes")
    askers, n_askers = _flat(batches, "askers")
    bests, _ = _flat(batches, "bests")
    names, nodes = np.unique(nodes, return_inverse=True)
    begin = np.cumsum(n_nodes, dtype=np.int64) - n_nodes
    order = np.argsort(askers, kind="stable")
    row = np.repeat(np.arange(len(n_askers)), n_askers)[order]
    askers, bests, sizes = askers[order], bests[order].astype(np.int64), n_nodes[row].astype(np.int64)
    most = int(bests.max()) + 1
    first = np.flatnonzero(np.concatenate([[True], askers[1:] != askers[:-1]]))
    upto = np.concatenate([[0], np.cumsum(sizes)])
    # Whole queries, so many that about _AT_ONCE nodes are united; a query may be more by itself.
    slot = upto[first] // _AT_ONCE
    cuts = first[np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))]
    for a, z in zip(cuts, [*cuts[1:], len(askers)]):
        size = sizes[a:z]
        ends = np.cumsum(size)
        at = np.repeat(begin[row[a:z]] - (ends - size), size) + np.arange(ends[-1])
        queries, query = np.unique(askers[a:z], return_inverse=True)
        key = np.repeat(query * (len(names) * most) + bests[a:z], size) + nodes[at] * most
        key.sort()
        pair, best = np.divmod(key, most)
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        pair, best = pair[new], best[new]
        for value in np.unique(best):
            query, node = np.divmod(pair[best == value], len(names))
            starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
            yield queries[query[starts]], int(value), np.append(starts, len(query)).astype(np.int32), names[node]


def _unite(batches):
    """Lists of nodes for every query and number, cell by cell."""
    held, cell = [], None

    def out():
        for queries, best, ends, nodes in _united(held) if held else ():
            # A list column ends at 2**31 items, and a batch need not be larger than a few lists.
            n = len(queries)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, cell, np.int32)), pa.array(queries, pa.int64()), pa.array(np.full(n, best, np.int32)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(nodes, pa.int64())),
                ],
                names=["cell", "query", "best", "nodes"],
            )

    for batch in batches:
        cells = batch.column("cell").to_numpy()
        edges = np.flatnonzero(cells[1:] != cells[:-1]) + 1
        for start, end in zip([0, *edges], [*edges, len(cells)]):
            if end > start:
                if cells[start] != cell:
                    yield from out()
                    held, cell = [], int(cells[start])
                held.append(batch.slice(start, end - start))
    yield from out()


def _traverse_numbers(seeds: DataFrame, edges: DataFrame, depth: int, modes: list[str]) -> DataFrame:
    """Traversal whose queries and nodes are whole numbers: the lists of a cell are united in one stream."""
    group = next(c for c in seeds.columns if c != "node")
    kinds = dict(seeds.dtypes)
    bucket = F.when(F.col(group).isNull(), _NO_QUERY).otherwise(F.pmod(F.xxhash64(group), F.lit(_BUCKETS))).cast("int")
    known = seeds.filter(F.col("node").isNotNull()).select(
        bucket.alias("bucket"), F.coalesce(F.col(group).cast("bigint"), F.lit(0)).alias("query"), F.col("node").cast("bigint").alias("node")
    ).distinct()
    own = known.select(
        F.pmod(F.xxhash64("node"), F.lit(_NODE_PARTS)).cast("int").alias("part"), "bucket", F.array("node").alias("nodes"),
        F.array("query").alias("askers"), F.array(F.lit(0)).alias("bests"),
    )
    lists = reduce(DataFrame.unionByName, [own, *(_number_lists(known, edges, depth, m) for m in modes if depth > 0)])
    wide = _BUCKETS + 1
    cells = lists.select((F.col("part") * wide + F.col("bucket") + 1).alias("cell"), "nodes", "askers", "bests")
    united = cells.repartition(_NODE_PARTS * _BUCKETS, "cell").sortWithinPartitions("cell").mapInArrow(
        _unite, "cell int, query bigint, best int, nodes array<bigint>"
    )
    query = F.when(F.col("cell") % wide != 0, F.col("query")).cast(kinds[group])
    found = united.select(query.alias(group), F.explode("nodes").alias("node"), "best").withColumn("node", F.col("node").cast(kinds["node"]))
    # A seed without a node is reached, and leads nowhere.
    nowhere = seeds.filter(F.col("node").isNull()).distinct().select(group, "node", F.lit(0).alias("best"))
    return found.unionByName(nowhere)


def traverse(seeds: DataFrame, edges: DataFrame, depth: int, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Breadth-first traversal for many queries at once.

    ``seeds`` holds the grouping columns and ``node``; ``edges`` holds ``source`` and
    ``target`` and the ``keys`` that both share. ``mode`` is ``upstream`` (what the
    seeds import), ``downstream`` (who imports them) or ``bidirectional``. What the last hop reaches
    is by far the most, so all hops are shuffled once, as lists, and become rows where they are merged.
    Where nodes and queries are whole numbers, the lists are not even repeated for each query.
    """
    keys = keys or []
    modes = ["upstream", "downstream"] if mode == "bidirectional" else [mode]
    group = [c for c in seeds.columns if c != "node"]
    kinds = [k for _, k in seeds.dtypes + edges.select("source", "target").dtypes]
    if not keys and len(group) == 1 and all(k in _NUMBERS for k in kinds):
        return _sides(_traverse_numbers(seeds, edges, depth, modes), group)
    walks = [_walk(seeds, edges, depth, keys, m) for m in modes]
    lists = walks[0] if len(walks) == 1 else walks[0].unionByName(walks[1])
    each = lists.repartition(*group, "part").select(*group, "part", F.explode("nodes").alias("node"), "depth", "down")
    # On equal depth the upstream record wins; seeds are identical on both sides.
    best = each.groupBy(*group, "part", "node").agg(F.min(F.col("depth") * 2 + F.col("down")).alias("best"))
    return _sides(best, group)


def _sides(best: DataFrame, group: list[str]) -> DataFrame:
    level = F.floor(F.col("best") / 2).cast("int")
    side = F.when(level == 0, "seed").when(F.col("best") % 2 == 1, "downstream").otherwise("upstream")
    return best.select(*group, "node", level.alias("depth"), side.alias("direction"))


def directory_edges(edges: DataFrame) -> DataFrame:
    return (
        edges.select(
            "project_id",
            paths.dirname(F.col("source_file")).alias("from_dir"),
            paths.dirname(F.col("target_file")).alias("to_dir"),
        )
        .filter("from_dir <> to_dir")
        .distinct()
    )


def entry_points(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that look like entries, or import others while nothing imports them."""
    known = files.select("project_id", "file_path").distinct()
    keys = ["project_id", "file_path"]
    named = known.filter(paths.basename(F.col("file_path")).isin(dims.ENTRY_BASENAMES))
    roots = (
        known.join(edges.select("project_id", F.col("source_file").alias("file_path")), keys, "left_semi")
        .join(edges.select("project_id", F.col("target_file").alias("file_path")), keys, "left_anti")
    )
    return named.union(roots).distinct()


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("project_id", "edge_type").agg(F.count("*").alias("n"))


def expand_by_graph(hits: DataFrame, nodes: DataFrame, units: DataFrame) -> DataFrame:
    """Hits first, then the units of files reached through imports.

    ``hits`` holds (query_id, project_id, unit_id, rank), ``nodes`` (query_id,
    project_id, node, depth) and ``units`` only ids, paths and order columns.
    """
    primary = hits.select(
        "query_id", "project_id", "unit_id", F.lit(0).alias("tier"), F.lit(1.0).alias("bonus"), F.lit("").alias("path"),
        F.col("rank").cast("bigint").alias("pos"), F.lit("").alias("uid"),
    )
    near = (
        nodes.filter("depth > 0")
        .join(
            units.select("project_id", F.col("file_path").alias("node"), "start_line", F.col("id").alias("unit_id")),
            ["project_id", "node"],
        )
        .join(hits.select("query_id", "unit_id"), ["query_id", "unit_id"], "left_anti")
        .select(
            "query_id",
            "project_id",
            "unit_id",
            F.lit(1).alias("tier"),
            F.when(F.col("depth") == 1, 0.3).otherwise(0.1).alias("bonus"),
            F.col("node").alias("path"),
            F.col("start_line").cast("bigint").alias("pos"),
            F.col("unit_id").alias("uid"),
        )
    )
    w = Window.partitionBy("query_id").orderBy("tier", F.desc("bonus"), "path", "pos", "uid")
    return primary.unionByName(near).select(
        "query_id", "project_id", "unit_id", "bonus", F.row_number().over(w).alias("ord")
    )
