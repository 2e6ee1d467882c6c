"""Walks, chains, strongly connected components and cycles of edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.sources.scratch import discard, stored

#: Steps after which the tables of a walk are put into one.
PARTS = 8


def _plain(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src is not null and dst is not null").distinct()


def chains(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """walk() where a node has one successor at most: with jumps of 1, 2, 4, ... edges, so a chain of n nodes takes log2(n) rounds."""
    jump = _plain(edges).select(F.col("src").alias("node"), F.col("dst").alias("to"))
    known = starts.select("start", F.col("start").alias("node")).where("start is not null").distinct().withColumn("depth", F.lit(0))
    jump, size, n = stored(jump, "jump"), 1, -1
    while True:
        far = known.join(jump, "node").select("start", F.col("to").alias("node"), (F.col("depth") + size).alias("depth"))
        # a node that is met again, on a cycle, keeps its least depth
        both = stored(known.union(far).groupBy("start", "node").agg(F.min("depth").alias("depth")), "walk", counted=True)
        discard(known)
        known = both
        if known.rows == n:
            discard(jump)
            return known
        n = known.rows
        on = jump.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        longer = stored(jump.join(on, "to").select("node", F.col("beyond").alias("to")), "jump", counted=True)
        discard(jump)
        if not longer.rows:
            discard(longer)
            return known
        jump, size = longer, 2 * size


def walk(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, depth) of every node that a start reaches over edges (src, dst), itself at depth 0.

    A node counts at its least depth, so cycles end. Edges and starts with
    nulls are left out; repeated ones count once. Where no node has two
    successors, chains() does it; else a step joins the last step's nodes
    with the edges and leaves out what is known, as many steps as the
    longest shortest path has edges.
    """
    plain = _plain(edges)
    if plain.groupBy("src").count().where("count > 1").isEmpty():
        return chains(plain, starts)
    edges = stored(plain, "edges")
    now = stored(starts.select("start", F.col("start").alias("node")).where("start is not null").distinct().withColumn("depth", F.lit(0)), "walk")
    parts, known, depth = [now], now, 0
    while True:
        depth += 1
        step = now.join(edges, now["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct()
        now = stored(step.join(known.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "walk", counted=True)
        if not now.rows:
            discard(edges, now)
            return known
        parts.append(now)
        known = known.unionByName(now)
        if len(parts) > PARTS:
            whole = stored(known, "walk")
            discard(*parts[:-1])  # the last step is read once more
            parts, known = [whole], whole


def _through(edges: DataFrame) -> DataFrame:
    """Nodes with one edge in and one out, (node, prev, next)."""
    out = edges.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("next")).where("n = 1").select(F.col("src").alias("node"), "next")
    into = edges.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("prev")).where("n = 1").select(F.col("dst").alias("node"), "prev")
    return out.join(into, "node")


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges between the other nodes, chain nodes (node, from, to), nodes of cycles without others (node, low)).

    Runs of nodes with one edge in and one out are bridged by jumps that double, in both directions.
    """
    through = stored(_through(edges), "through", counted=True)
    size = through.rows
    jump = stored(through.select("node", F.col("prev").alias("a"), F.col("next").alias("b"), F.least("node", "next").alias("low")), "jump")
    reached = 1
    while reached <= 2 * size:
        # ends are no chain nodes and have no row: they stay
        near = jump.select(F.col("node").alias("b"), F.col("b").alias("bb"), F.col("low").alias("b_low"))
        back = jump.select(F.col("node").alias("a"), F.col("a").alias("aa"))
        step = jump.join(near, "b", "left").join(back, "a", "left")
        longer = stored(step.select("node", F.coalesce("aa", "a").alias("a"), F.coalesce("bb", "b").alias("b"), F.least("low", F.coalesce("b_low", "low")).alias("low"), F.coalesce("bb", "aa").isNotNull().alias("open")), "jump", counted=F.col("open"))
        discard(jump)
        jump, reached = longer, 2 * reached
        if not jump.rows:
            break
    names = through.select(F.col("node").alias("end"))
    chain = jump.join(names, jump["b"] == names["end"], "left_anti").select("node", F.col("a").alias("from"), F.col("b").alias("to"))
    circle = jump.join(names, jump["b"] == names["end"], "left_semi").select("node", "low")
    inner = edges.join(names, edges["src"] == names["end"], "left_anti").join(names, edges["dst"] == names["end"], "left_anti")
    out = inner.union(chain.select("from", "to")).distinct()
    chain, circle, out = stored(chain, "chain"), stored(circle, "circle"), stored(out.toDF("src", "dst"), "edges")
    discard(through, jump)
    return out, chain, circle


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those of nodes that have none in or none out (no cycle passes them), until nothing changes."""
    n = -1
    while True:
        src, dst = edges.select(F.col("src").alias("x")).distinct(), edges.select(F.col("dst").alias("x")).distinct()
        less = stored(edges.join(dst, edges["src"] == dst["x"], "left_semi").join(src, edges["dst"] == src["x"], "left_semi"), "edges", counted=True)
        discard(edges)
        edges = less
        if edges.rows in (n, 0):
            return edges
        n = edges.rows


def _colours(edges: DataFrame) -> DataFrame:
    """(node, f, b): the greatest nodes that reach each node and that it reaches, passed on edge by edge until nothing changes."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    now = nodes.select("node", F.col("node").alias("f"), F.col("node").alias("b"), F.lit(True).alias("new"))
    both = edges.select("src", "dst", F.lit(True).alias("on")).union(edges.select("dst", "src", F.lit(False)))
    while True:
        said = now.where("new").join(both, F.col("node") == F.col("src"))
        told = said.groupBy(F.col("dst").alias("node")).agg(F.max(F.when(F.col("on"), F.col("f"))).alias("tf"), F.max(F.when(~F.col("on"), F.col("b"))).alias("tb"))
        f, b = F.greatest("f", F.coalesce("tf", "f")), F.greatest("b", F.coalesce("tb", "b"))
        after = now.join(told, "node", "left").select("node", f.alias("f"), b.alias("b"), ((f > F.col("f")) | (b > F.col("b"))).alias("new"))
        after = stored(after, "colours", counted=F.col("new"))
        discard(now)
        now = after
        if not now.rows:
            return now


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node that lies on a cycle: component is the smallest node of its strongly connected component.

    A node with an edge to itself is on a cycle; nodes on none are left
    out. Chains of nodes with one edge in and one out are bridged first (in
    log2 of their length rounds) and nodes without edges in or out go. Then
    each node learns the greatest node that reaches it and the greatest that
    it reaches. Where both are one node, it is in that node's component;
    edges between nodes that differ in either lie on no cycle and go, and
    what is left goes round again. Rounds grow with the longest shortest
    path between nodes that have several edges. Edges with nulls are left
    out, repeated ones count once.
    """
    every = stored(_plain(edges), "edges")
    loops = every.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    rest, chain, circle = _contracted(stored(every.where("src <> dst"), "edges"))
    # a chain that leaves and enters one node is a cycle through it
    own = rest.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    out = loops.union(circle.select("node", F.col("low").alias("component"))).union(own)
    rest = _trimmed(rest.where("src <> dst"))
    while rest.rows:
        colours = _colours(rest)
        # a component of one node says nothing
        out = out.union(colours.where("f = b").select("node", F.col("f").alias("component")))
        one, two = colours.select(F.col("node").alias("src"), "f", "b"), colours.select(F.col("node").alias("dst"), F.col("f").alias("g"), F.col("b").alias("c"))
        less = rest.join(one, "src").join(two, "dst").where("f = g and b = c and f <> b").select("src", "dst")
        left = stored(less, "edges", counted=True)
        discard(rest)
        rest = left
    sized = out.where("node is not null").groupBy("component").agg(F.count_distinct("node").alias("n"))
    sure = loops.union(own).select(F.col("node").alias("component")).distinct()
    real = sized.where("n > 1").select("component").union(sure)
    ends = stored(_of_each_node(out.join(real.distinct(), "component", "left_semi")), "components")
    # chain nodes belong to the component of both their ends; names are the smallest members
    a, b = ends.toDF("from", "c"), ends.toDF("to", "d")
    inner = chain.join(a, "from").join(b, "to").where("c = d").select("node", F.col("c").alias("component"))
    members = _of_each_node(ends.union(inner))
    least = members.groupBy("component").agg(F.min("node").alias("least"))
    return members.join(least, "component").select("node", F.col("least").alias("component"))


def _of_each_node(found: DataFrame) -> DataFrame:
    """One row for each node: a component that is named otherwise, else its own."""
    other = F.max(F.when(F.col("component") != F.col("node"), F.col("component")))
    return found.groupBy("node").agg(other.alias("other")).select("node", F.coalesce("other", "node").alias("component"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves over one edge or more."""
    return strong_components(edges).select("node")


def cycles(edges: DataFrame, most: int) -> DataFrame:
    """Each cycle of at most `most` nodes once, as (cycle, length): its nodes in order from the smallest; no node comes twice.

    Paths start at their smallest node and stay inside its component, so
    each cycle has one path, and paths that can't close aren't followed.
    """
    plain = _plain(edges)
    parts = stored(strong_components(plain), "components")
    one, two = parts.toDF("src", "c"), parts.toDF("dst", "d")
    inner = stored(plain.join(one, "src").join(two, "dst").where("c = d").select("src", "dst"), "edges")
    paths = inner.select(F.array("src").alias("path"), F.col("dst").alias("last")).where("last >= path[0]")
    closed = paths.where("last = path[0]").select("path")
    for _ in range(most - 1):
        paths = stored(paths.where("last <> path[0] and not array_contains(path, last)"), "paths")
        if paths.isEmpty():
            break
        step = paths.join(inner, F.col("last") == F.col("src")).where("dst >= path[0]")
        paths = step.select(F.concat("path", F.array("last")).alias("path"), F.col("dst").alias("last"))
        closed = closed.union(paths.where("last = path[0]").select("path"))
    return closed.select(F.col("path").alias("cycle"), F.size("path").alias("length"))
