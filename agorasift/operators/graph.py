"""Components, degrees and filters of interaction networks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from agorasift.operators.durable import durable
from agorasift.operators.ranking import number_rows, pick_one


def multiplex_edges(edges: DataFrame) -> DataFrame:
    """One row per (src, dst): the weight in each layer and in all.

    One grouped pass in place of a chain of outer joins.
    """
    def layer(name: str):
        return F.sum(F.when(F.col("layer") == name, F.col("weight")).otherwise(F.lit(0).cast("long"))).alias(name)

    return edges.groupBy("src", "dst").agg(
        layer("retweet"), layer("quote"), layer("reply"), F.sum("weight").alias("weight")
    )


def edge_threshold(edges: DataFrame, min_weight: int) -> DataFrame:
    return edges.where(F.col("weight") >= min_weight)


def graph_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst"))).distinct()


def _point_low(pairs: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the smallest node around it."""
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = durable(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m")))
    moved = pairs.join(low, "v").select("u", F.col("m").alias("v"))
    return moved.where(F.col("u") != F.col("v")).distinct()


def _gather_low(pairs: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of these."""
    low = durable(pairs.groupBy("u").agg(F.min("v").alias("m")))
    moved = pairs.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where(F.col("u") != F.col("v")).union(low.select("u", F.col("m").alias("v"))).distinct()


def _all_stars(pairs: DataFrame) -> bool:
    """Every node has one parent and no parent has a parent."""
    several = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    if not several.isEmpty():
        return False
    return pairs.join(pairs.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def weak_components(edges: DataFrame) -> DataFrame:
    """``(node, component)``; a component is named after its smallest node.

    Alternates two local moves (Kiveris et al., 2014) until the graph is a set
    of stars, in a number of rounds that grows with the logarithm of its size.
    Each round is stored, and a hub is only ever the key of a minimum or of a
    join with one row per node, which adaptive execution splits.
    """
    pairs = durable(
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    )
    while not _all_stars(pairs):
        pairs = durable(_gather_low(_point_low(pairs)))
    parents = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return graph_nodes(edges).join(parents, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def _until_stable(state: DataFrame, step, measure) -> DataFrame:
    """Repeat a monotone step until its measure stops changing."""
    state = durable(state)
    before = measure(state)
    while True:
        state = durable(step(state))
        after = measure(state)
        if after == before:
            return state
        before = after


@dataclass(frozen=True)
class Fold:
    """Nodes with one way on, taken out of a graph, and how to judge them later."""

    nodes: DataFrame  # node
    links: DataFrame  # src, dst among the other nodes
    done: DataFrame  # node, component of folded nodes that never get back to the others
    chained: DataFrame  # node, root: the first node outside the fold on the way on
    entries: DataFrame  # outside, node, root: links from outside into the fold
    jumps: list[DataFrame]  # node, to: 1, 2, 4, ... steps on


def _fold(links: DataFrame, ahead: str, behind: str) -> Fold | None:
    """Folds chains, in rounds that follow the logarithm of their length.

    A node with a single link ``behind -> ahead`` has one way on.  Pointers
    along such ways are doubled until they leave the fold.  Those that never
    do lead into a ring without an exit: the ring is one component, and what
    leads into it is alone.  Other nodes take the links into a chain at its root.
    """
    ways = links.groupBy(F.col(behind).alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min(ahead).alias("to"))
    single = durable(ways.where(F.col("n") == 1).select("node", "to"))
    size = single.count()
    if size == 0:
        return None
    state = single.withColumn("least", F.col("node"))
    jumps, stride = [single], 1
    while stride < size:
        further = state.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least"))
        state = durable(state.join(further, "to", "left").select(
            "node", F.coalesce("_to", "to").alias("to"), F.least("least", "_least").alias("least"), F.col("_to").isNotNull().alias("moved")))
        if state.where("moved").isEmpty():
            break
        state = state.drop("moved")
        jumps.append(state.select("node", "to"))
        stride *= 2
    inner = single.select("node")
    targets = inner.withColumnRenamed("node", "to")
    endless = durable(state.join(targets, "to", "left_semi").select("node", "to", "least"))
    ring = durable(endless.select(F.col("to").alias("node")).distinct())
    done = durable(endless.join(ring, "node", "left_semi").select("node", F.col("least").alias("component")).unionByName(
        endless.join(ring, "node", "left_anti").select("node", F.col("node").alias("component"))))
    chained = durable(state.join(targets, "to", "left_anti").select("node", F.col("to").alias("root")))
    outside = durable(links.join(inner.withColumnRenamed("node", behind), behind, "left_anti").select(
        F.col(behind).alias("outside"), F.col(ahead).alias("node")))
    entries = durable(outside.join(chained, "node"))
    kept = outside.join(inner, "node", "left_anti").select("outside", "node")
    moved = kept.unionByName(entries.select("outside", F.col("root").alias("node"))).where(F.col("outside") != F.col("node"))
    rest = durable(moved.distinct().select(F.col("outside").alias(behind), F.col("node").alias(ahead)))
    return Fold(inner, rest.select("src", "dst"), done, chained, entries, jumps)


def _unfold(found: DataFrame, fold: Fold) -> DataFrame:
    """Components with those of the folded nodes.

    A folded node belongs to its root's component if a chain through it is
    entered from that component; such marks move on along the doubled
    pointers.  Else it is alone.
    """
    own = found.select(F.col("node").alias("outside"), F.col("component").alias("_from"))
    root = found.select(F.col("node").alias("root"), F.col("component").alias("_root"))
    marks = durable(fold.entries.join(own, "outside").join(root, "root").where(F.col("_from") == F.col("_root")).select("node").distinct())
    for jump in fold.jumps:
        onward = jump.join(marks, "node", "left_semi").select(F.col("to").alias("node")).join(fold.nodes, "node", "left_semi")
        marks = durable(marks.unionByName(onward).distinct())
    marked = marks.withColumn("_in", F.lit(True))
    judged = fold.chained.join(root, "root").join(marked, "node", "left").select(
        "node", F.when(F.col("_in"), F.col("_root")).otherwise(F.col("node")).alias("component"))
    return durable(found.unionByName(fold.done).unionByName(judged))


def strong_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of the directed graph, named after the smallest node.

    Chains are folded first, forwards and backwards, so long paths and rings
    take rounds in the logarithm of their length.  The rest is coloured: each
    node takes the largest node that reaches it; the nodes of a colour that
    reach its owner backwards are one component; they are taken out and the
    rest goes on.
    """
    nodes = durable(graph_nodes(edges))
    links = durable(edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    folds = []
    for ahead, behind in (("dst", "src"), ("src", "dst")):
        fold = _fold(links, ahead, behind)
        if fold is not None:
            folds.append(fold)
            links, nodes = fold.links, durable(nodes.join(fold.nodes, "node", "left_anti"))
    found = _coloured(nodes, links)
    for fold in reversed(folds):
        found = _unfold(found, fold)
    names = durable(found.groupBy("component").agg(F.min("node").alias("_name")))
    return durable(found.join(names, "component").select("node", F.col("_name").alias("component")))


def _coloured(nodes: DataFrame, links: DataFrame) -> DataFrame:
    done = None
    while True:
        # nodes without an edge in or out are components of their own
        inner = links.select(F.col("src").alias("node")).intersect(links.select(F.col("dst").alias("node")))
        single = nodes.join(inner, "node", "left_anti").select("node", F.col("node").alias("component"))
        done = durable(single if done is None else done.unionByName(single))
        nodes = durable(nodes.join(inner, "node", "left_semi"))
        kept = durable(_inside(links, nodes))
        shrunk = kept.count() < links.count()
        links = kept
        if shrunk:
            continue
        if nodes.isEmpty():
            return done

        def spread(colours: DataFrame) -> DataFrame:
            reached = links.join(colours.withColumnRenamed("node", "src"), "src").select(
                F.col("dst").alias("node"), "colour")
            return colours.unionByName(reached).groupBy("node").agg(F.max("colour").alias("colour"))

        colours = _until_stable(
            nodes.withColumn("colour", F.col("node")), spread,
            lambda d: d.agg(F.sum(F.col("colour").cast("decimal(38,0)"))).first()[0],
        )
        same = durable(
            links.join(colours.select(F.col("node").alias("src"), "colour"), "src")
            .join(colours.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"])
        )

        def back(members: DataFrame) -> DataFrame:
            found = same.join(members.withColumnRenamed("node", "dst"), ["dst", "colour"]).select(
                F.col("src").alias("node"), "colour")
            return members.unionByName(found).distinct()

        members = _until_stable(colours.where(F.col("node") == F.col("colour")), back, lambda d: d.count())
        names = members.groupBy("colour").agg(F.min("node").alias("component"))
        done = done.unionByName(members.join(names, "colour").select("node", "component"))
        nodes = durable(nodes.join(members.select("node"), "node", "left_anti"))
        # edges between colours cannot lie on a cycle
        links = durable(_inside(same.select("src", "dst"), nodes))


def _inside(links: DataFrame, nodes: DataFrame) -> DataFrame:
    ends = nodes.select("node")
    return links.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(
        ends.withColumnRenamed("node", "dst"), "dst", "left_semi"
    )


def largest_component(components: DataFrame) -> DataFrame:
    """Nodes of the largest component; the smaller name wins a tie."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    return components.join(best, "component", "left_semi").select("node")


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return _inside(edges, nodes)


def total_degree(edges: DataFrame) -> DataFrame:
    """Edge ends per node, both directions."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def discussion_nodes(edges: DataFrame, directed: bool = False, min_edge_weight: int = 1,
                     min_total_degree: int = 1) -> DataFrame:
    """Nodes of the largest component that have enough edges inside it."""
    heavy = edge_threshold(edges, min_edge_weight)
    components = strong_components(heavy) if directed else weak_components(heavy)
    members = largest_component(components)
    degrees = total_degree(induced_edges(heavy, members))
    return degrees.where(F.col("degree") >= min_total_degree).select("node")


def discussion_users(profiles: DataFrame, nodes: DataFrame, post_counts: DataFrame) -> DataFrame:
    """Latest profile of the users in the discussion, most active first."""
    latest = latest_profile(profiles)
    inside = latest.join(nodes.select(F.col("node").alias("user_id")), "user_id", "left_semi")
    return inside.join(post_counts.select("user_id", "dataset_posts"), "user_id").orderBy(
        F.desc("dataset_posts"), "user_id"
    )


def latest_profile(profiles: DataFrame) -> DataFrame:
    """Last profile row of each user."""
    return pick_one(profiles, ["user_id"], ["date"], last=True)


def element_ids(users: DataFrame) -> DataFrame:
    """Dense row id of each user, most active first."""
    return number_rows(users.select("user_id", "dataset_posts"), [F.desc("dataset_posts"), F.asc("user_id")]).select(
        "user_id", "row_id"
    )


def interactions_total(edges: DataFrame, by: tuple[str, ...] = ("layer",)) -> DataFrame:
    """Edge weights over all days."""
    return edges.groupBy(*by, "src", "dst").agg(F.sum("weight").alias("weight"))


def dataset_posts(daily_counts: DataFrame) -> DataFrame:
    """Posts of each user over all days."""
    return daily_counts.groupBy("user_id").agg(F.sum("posts").alias("dataset_posts"))


def node_components(edges: DataFrame, users: DataFrame, min_weight: int = 1) -> DataFrame:
    """Weak component of every node reached by edges of the given users."""
    own = edges.join(users.select(F.col("user_id").alias("src")), "src", "left_semi")
    return weak_components(edge_threshold(own, min_weight))
