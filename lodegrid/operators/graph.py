"""Graph operators over edge DataFrames partitioned by target.

Edges are cut once before a loop, so no round reads or parses the sources again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

#: Edges of a target that one task walks in memory; larger graphs go by frontier joins.
SMALL_GRAPH = 100_000


def walk_breadth(start: str, out: dict[str, list[str]], most: int) -> list[tuple[str, list[str]]]:
    """(node, path) within `most` calls: the shortest path, among equals the one through the smallest names."""
    seen, level, found = {start}, {start: [start]}, [(start, [start])]
    for _ in range(most):
        nxt: dict[str, list[str]] = {}
        for node, path in level.items():
            for d in out.get(node, ()):
                if d not in seen and (d not in nxt or path + [d] < nxt[d]):
                    nxt[d] = path + [d]
        seen.update(nxt)
        found += nxt.items()
        level = nxt
    return found


def walk_depth(start: str, out: dict[str, list[str]], most: int) -> list[tuple[str, list[str]]]:
    """(node, path of this walk) depth first, the largest name of a body first, with one set of seen nodes for the whole walk.

    A node that is first met at depth `most` is not walked from again, even where a shorter way to it comes later.
    """
    seen: set[str] = set()
    found, stack = [], [(start, [start])]
    while stack:
        node, path = stack.pop()
        if node in seen or len(path) - 1 > most:
            continue
        seen.add(node)
        found.append((node, path))
        stack += [(d, path + [d]) for d in out.get(node, ())]
    return found


def walks(starts: DataFrame, edges: DataFrame, max_depth: int = 8, walk: Callable = walk_breadth) -> DataFrame:
    """(target_id, start, node, visit_no, path): every start of a target walked through its call graph, in one exchange.

    The rows of a target meet in one task, sorted, and only one target's graph is held at a time. starts: (target_id, node).
    """
    k = starts.schema["target_id"].dataType
    rows = starts.select("target_id", F.col("node").alias("src"), F.lit(None).cast("string").alias("dst")).unionByName(edges.select("target_id", "src", "dst")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            out: dict[str, list[str]] = {}
            for _, s, d in held:
                if d is not None:
                    out.setdefault(s, []).append(d)
            for v in out.values():
                v.sort()
            found = [(held[0][0], s, n, i, p) for _, s, d in held if d is None for i, (n, p) in enumerate(walk(s, out, max_depth))]
            held.clear()
            for lo in range(0, len(found), 10_000):
                t, s, n, i, p = zip(*found[lo : lo + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(t, kind), pa.array(s), pa.array(n), pa.array(i, pa.int32()), pa.array(p, pa.list_(pa.string()))], ["target_id", "start", "node", "visit_no", "path"])

        for b in batches:
            kind = b.schema.field(0).type
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0][0] != row[0]:
                    yield from flush()
                held.append(row)
        if held:
            yield from flush()

    shape = T.StructType([T.StructField("target_id", k), T.StructField("start", T.StringType()), T.StructField("node", T.StringType()), T.StructField("visit_no", T.IntegerType()), T.StructField("path", T.ArrayType(T.StringType()))])
    # a fixed number of tasks: by their bytes alone the names would be brought together to a few, and walking takes far longer than reading
    n = int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "target_id").sortWithinPartitions("target_id").mapInArrow(run, shape)


def _small_and_large(starts: DataFrame, edges: DataFrame) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame] | None]:
    """Starts and edges of targets whose graph one task may hold, and of the others if there are any."""
    large = cut(edges.groupBy("target_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SMALL_GRAPH).select("target_id"))
    if large.isEmpty():
        return (starts, edges), None
    part = lambda how: (starts.join(large, "target_id", how), edges.join(large, "target_id", how))
    return part("left_anti"), part("left_semi")


def reach(starts: DataFrame, edges: DataFrame, max_depth: int = 8) -> DataFrame:
    """Nodes reachable within ``max_depth`` calls: (target_id, start, node, depth), shortest depth."""
    small, large = _small_and_large(starts, edges)
    found = walks(*small, max_depth).select("target_id", "start", "node", (F.size("path") - 1).alias("depth"))
    return found if large is None else found.unionByName(_reach_by_rounds(*large, max_depth))


def _reach_by_rounds(starts: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """Breadth-first by frontier joins: each round joins only the newly found pairs. The known pairs
    are removed by an anti-join, so no pair is expanded twice.
    """
    edges = cut(edges)
    seen = cut(starts.select("target_id", F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct())
    frontier = seen
    for d in range(1, max_depth + 1):
        nxt = (frontier.join(edges, (frontier.target_id == edges.target_id) & (frontier.node == edges.src))
               .select(frontier.target_id, "start", F.col("dst").alias("node")).distinct()
               .join(seen.select("target_id", "start", "node"), ["target_id", "start", "node"], "left_anti").withColumn("depth", F.lit(d)))
        nxt = cut(nxt)
        if nxt.isEmpty():
            break
        seen, frontier = seen.unionByName(nxt), nxt
    return seen


def shortest_paths(starts: DataFrame, edges: DataFrame, max_depth: int = 8) -> DataFrame:
    """Shortest call path per (start, node); among equals the one through the smallest names."""
    small, large = _small_and_large(starts, edges)
    found = walks(*small, max_depth).select("target_id", "start", "node", "path")
    return found if large is None else found.unionByName(_paths_by_rounds(*large, max_depth))


def _paths_by_rounds(starts: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """Shortest paths by frontier joins."""
    edges = cut(edges)
    seen = cut(starts.select("target_id", F.col("node").alias("start"), "node", F.array("node").alias("path")).distinct())
    frontier = seen
    for _ in range(max_depth):
        nxt = (frontier.join(edges, (frontier.target_id == edges.target_id) & (frontier.node == edges.src))
               .select(frontier.target_id, "start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
               .groupBy("target_id", "start", "node").agg(F.min("path").alias("path"))
               .join(seen.select("target_id", "start", "node"), ["target_id", "start", "node"], "left_anti"))
        nxt = cut(nxt)
        if nxt.isEmpty():
            break
        seen, frontier = seen.unionByName(nxt), nxt
    return seen


def backward_closure(seeds: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """All nodes that reach a seed, to the fixpoint: (target_id, node). Raises if ``max_rounds`` don't do."""
    edges = cut(edges)
    seen = cut(seeds.select("target_id", "node").distinct())
    frontier = seen
    for _ in range(max_rounds):
        nxt = (frontier.join(edges, (frontier.target_id == edges.target_id) & (frontier.node == edges.dst))
               .select(frontier.target_id, F.col("src").alias("node")).distinct().join(seen, ["target_id", "node"], "left_anti"))
        nxt = cut(nxt)
        if nxt.isEmpty():
            return seen
        seen, frontier = seen.unionByName(nxt), nxt
    raise RuntimeError("the closure did not settle; raise max_rounds")


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Connected components (id, component = smallest id) by alternating large-star / small-star.

    The two steps contract the graph in O(log n) rounds, and each round only compares a node with
    its neighbours' minimum: a hub with very many edges is reduced map-side by ``min``.
    """
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        m2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            m2.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small)
        last, state = state, e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
    else:
        raise RuntimeError("the components did not settle; raise max_rounds")
    roots = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return nodes.select("id").distinct().join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def group_targets(addresses: DataFrame, *edge_sets: DataFrame) -> DataFrame:
    """Protocol groups: (address, component, group_size), edges as (src, dst) address pairs."""
    e = None
    for s in edge_sets:
        s = s.select("src", "dst")
        e = s if e is None else e.unionByName(s)
    known = addresses.select(F.lower("address").alias("id")).distinct()
    e = e.select(F.lower("src").alias("src"), F.lower("dst").alias("dst"))
    e = e.join(known.select(F.col("id").alias("src")), "src", "left_semi").join(known.select(F.col("id").alias("dst")), "dst", "left_semi")
    comp = components(known, e)
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("group_size"))
    return comp.join(size, "component").select(F.col("id").alias("address"), "component", "group_size")


def deployer_edges(deployers: DataFrame) -> DataFrame:
    """Star edges from each address to its deployer's first address: linear, never all pairs."""
    first = deployers.groupBy("deployer").agg(F.min(F.lower("address")).alias("dst"))
    return deployers.join(first, "deployer").select(F.lower("address").alias("src"), "dst")


def mention_edges(sources: DataFrame, addresses: DataFrame) -> DataFrame:
    """Address a's text mentions address b: extracted and equi-joined, not an all-pairs containment test."""
    ex = sources.select(F.lower("address").alias("src"), F.explode(F.array_distinct(
        F.regexp_extract_all(F.lower("text"), F.lit("(0x[0-9a-f]{40})"), F.lit(1)))).alias("dst")).where("src <> dst").distinct()
    return ex.join(addresses.select(F.lower("address").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def context_slice(fns: DataFrame, edges: DataFrame, max_callees: int = 8, max_callers: int = 4, max_chars: int = 14000) -> DataFrame:
    """Per function: its text, then its callees and callers by name, cut at a character budget.

    The caps are the feature (a bounded review slice), applied by ranked windows before any text is gathered.
    """
    from .dedup import top_per_key

    text = F.concat(F.lit("function "), F.col("name"), F.lit("("), F.col("params"), F.lit(") "), F.col("tail"), F.lit(" "), F.col("body"))
    nodes = fns.select("target_id", F.col("name").alias("node"), text.alias("text"))
    callees = top_per_key(edges.select("target_id", F.col("src").alias("fn"), F.col("dst").alias("node")), ["target_id", "fn"], max_callees, F.col("node"))
    callers = top_per_key(edges.select("target_id", F.col("dst").alias("fn"), F.col("src").alias("node")), ["target_id", "fn"], max_callers, F.col("node"))
    me = nodes.select("target_id", F.col("node").alias("fn"), "node").withColumns({"grp": F.lit(0), "rank_no": F.lit(0)})
    parts = me.unionByName(callees.withColumn("grp", F.lit(1))).unionByName(callers.withColumn("grp", F.lit(2)))
    first = parts.groupBy("target_id", "fn", "node").agg(F.min(F.struct("grp", "rank_no")).alias("k"))
    out = first.join(nodes, ["target_id", "node"]).groupBy("target_id", "fn").agg(
        F.array_sort(F.collect_list(F.struct("k", "node", "text"))).alias("p"))
    return out.select("target_id", F.col("fn").alias("name"), F.size("p").alias("parts"),
                      F.left(F.array_join(F.transform("p", lambda x: x["text"]), "\n\n"), F.lit(max_chars)).alias("slice"))
