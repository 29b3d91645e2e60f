"""Analyses of a code-like graph: nodes (id, path, language, lines) and edges (s, o, w), tests (s: tested, o: test), partition (node, c)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.session import settle

from .graph import bfs, confident, deal, degrees, reached, scopes

# Weights of the published scores.
COUPLING = {"cross_community": 0.45, "cross_language": 0.35, "periphery_to_hub": 0.20}
RISK = {"flow": 0.25, "callers": 0.25, "crossing": 0.20, "untested": 0.20, "security": 0.10}
LEVELS = (("low", 0.0), ("moderate", 0.5), ("elevated", 0.75), ("high", 0.9))
IMPACT = {"distance": 0.5, "confidence": 0.3, "size": 0.2}


def nearest_rank(p: float, column: str):
    return F.expr(f"percentile_disc({p}) within group (order by {column})")


def _sided(df: DataFrame, nodes: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    for end in ("s", "o"):
        df = df.join(nodes.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns]), end)
    return df


def coupling(nodes: DataFrame, edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(s, o, score) of edges on which a signal fires: other community, other language, periphery to hub.

    The degree bands are the 25th and 90th nearest-rank percentiles; a hub band
    no higher than the periphery's is raised to the next degree there is.
    """
    deg = degrees(edges).select("node", "degree")
    bands = deg.agg(nearest_rank(0.25, "degree").cast("long").alias("low"), nearest_rank(0.9, "degree").cast("long").alias("high"))
    above = deg.join(F.broadcast(bands)).where("degree > low").agg(F.min("degree").alias("above"))
    bands = bands.join(F.broadcast(above)).selectExpr("low", "if(high <= low, coalesce(above, high), high) as high")
    about = nodes.select("id", "language").join(partition.withColumnRenamed("node", "id"), "id").join(deg.withColumnRenamed("node", "id"), "id")
    e = _sided(edges.where("s <> o").select("s", "o"), about, ("language", "c", "degree")).join(F.broadcast(bands))
    hub = "high > low and ((s_degree <= low and o_degree >= high) or (o_degree <= low and s_degree >= high))"
    score = F.when(F.expr("s_c <> o_c"), COUPLING["cross_community"]).otherwise(0.0)
    score = score + F.when(F.expr("s_language <> '' and o_language <> '' and s_language <> o_language"), COUPLING["cross_language"]).otherwise(0.0)
    score = score + F.when(F.expr(hub), COUPLING["periphery_to_hub"]).otherwise(0.0)
    return e.select("s", "o", F.round(score, 6).alias("score")).where("score > 0")


def hotspots(nodes: DataFrame, edges: DataFrame, tests: DataFrame) -> DataFrame:
    """(id, callers): untested nodes whose callers reach the 75th percentile of all that have any."""
    fan = degrees(edges).where("fan_in > 0").selectExpr("node as id", "fan_in as callers")
    cut = fan.agg(F.greatest(nearest_rank(0.75, "callers").cast("long"), F.lit(1)).alias("cut"))
    untested = nodes.select("id").join(tests.select(F.col("s").alias("id")), "id", "left_anti")
    return fan.join(untested, "id").join(F.broadcast(cut)).where("callers >= cut").select("id", "callers")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): nodes without an edge to another node."""
    e = edges.where("s <> o")
    return nodes.select("id").join(e.selectExpr("s as id").unionAll(e.selectExpr("o")).distinct(), "id", "left_anti")


def community_summary(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(c, members, internal, external, density): internal and external are distinct unordered pairs; density of one member is 1."""
    p = lambda n: partition.select(F.col("node").alias(n), F.col("c").alias(f"c_{n}"))
    pair = edges.where("s <> o").select(F.least("s", "o").alias("s"), F.greatest("s", "o").alias("o")).distinct().join(p("s"), "s").join(p("o"), "o")
    inside = pair.where("c_s = c_o").groupBy(F.col("c_s").alias("c")).agg(F.count("*").alias("internal"))
    cross = pair.where("c_s <> c_o")
    outside = cross.selectExpr("c_s as c").unionAll(cross.selectExpr("c_o")).groupBy("c").agg(F.count("*").alias("external"))
    out = partition.groupBy("c").agg(F.count("*").alias("members")).join(inside, "c", "left").join(outside, "c", "left").na.fill(0)
    return out.withColumn("density", F.when(F.col("members") < 2, 1.0).otherwise(F.round(F.col("internal") / (F.col("members") * (F.col("members") - 1) / 2), 6)))


def thin_communities(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(c, members, internal, density) of communities of two and more at or below both medians."""
    c = community_summary(edges, partition).where("members >= 2")
    cut = c.agg(nearest_rank(0.5, "members").cast("long").alias("size_cut"), nearest_rank(0.5, "density").alias("density_cut"))
    return c.join(F.broadcast(cut)).where("members <= size_cut and density <= density_cut").select("c", "members", "internal", "density")


# Names that a runtime looks for by itself.
ENTRY_NAMES = ["main", "__main__"]


def dead(nodes: DataFrame, edges: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """(id, lines, outbound): nodes that nothing else refers to, but for entry points by name and for tests (o)."""
    e = edges.where("s <> o")
    out = e.groupBy(F.col("s").alias("id")).agg(F.count_distinct("o").alias("outbound"))
    n = nodes.where(~F.coalesce(F.lower("name").isin(ENTRY_NAMES), F.lit(False))) if "name" in nodes.columns else nodes
    if tests is not None:
        n = n.join(tests.select(F.col("o").alias("id")).distinct(), "id", "left_anti")
    return n.select("id", "lines").join(e.select(F.col("o").alias("id")).distinct(), "id", "left_anti").join(out, "id", "left").na.fill(0, ["outbound"])


def large(nodes: DataFrame, least: int) -> DataFrame:
    """(id, path, lines, rank): nodes of at least so many lines, and their share of nodes no longer than they."""
    n = nodes.groupBy("lines").agg(F.count("*").alias("c"))
    share = n.withColumn("upto", F.sum("c").over(Window.orderBy("lines"))).withColumn("all", F.sum("c").over(Window.partitionBy()))
    out = nodes.where(F.col("lines") >= least).join(F.broadcast(share.select("lines", F.round(F.col("upto") / F.col("all"), 6).alias("rank"))), "lines")
    return out.select("id", "path", F.col("lines").cast("long").alias("lines"), "rank")


def architecture(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, symbols, languages, internal, fan_in, fan_out) of components, which are paths."""
    e = _sided(edges.select("s", "o"), nodes, ("path",))
    inner = e.where("s_path = o_path").groupBy(F.col("s_path").alias("path")).agg(F.count("*").alias("internal"))
    cross = e.where("s_path <> o_path")
    fan_in, fan_out = (cross.groupBy(F.col(f"{c}_path").alias("path")).agg(F.count("*").alias(n)) for c, n in (("o", "fan_in"), ("s", "fan_out")))
    own = nodes.groupBy("path").agg(F.count("*").alias("symbols"), F.count_distinct("language").alias("languages"))
    return own.join(inner, "path", "left").join(fan_in, "path", "left").join(fan_out, "path", "left").na.fill(0)


def component_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, n, cross_language) between paths."""
    e = _sided(edges.select("s", "o"), nodes, ("path", "language")).where("s_path <> o_path")
    return e.groupBy(F.col("s_path").alias("source"), F.col("o_path").alias("target")).agg(F.count("*").alias("n"), F.sum(F.expr("cast(s_language <> o_language as long)")).alias("cross_language"))


def risk(nodes: DataFrame, edges: DataFrame, tests: DataFrame, partition: DataFrame, entries: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, score, level): five weighted factors, ranks among all nodes where a factor is a count.

    Reach is the number of entry points (root) that get to a node, within `depth` calls if given.
    The ranks are taken over counts, of which there are few: the counts of
    values are aggregated before they are put in order.
    """
    if depth is None:
        edges = deal(edges)
        reach = reached(edges, entries).selectExpr("node as id", "n as reach")
    else:
        reach = bfs(edges, entries, depth).where("distance > 0").groupBy(F.col("node").alias("id")).agg(F.count("*").alias("reach"))
    fan = degrees(edges).selectExpr("node as id", "fan_in as callers")
    p = lambda n: partition.select(F.col("node").alias(n), F.col("c").alias(f"c_{n}"))
    both = edges.select("s", "o").unionAll(edges.selectExpr("o", "s")).where("s <> o").join(p("s"), "s").join(p("o"), "o").where("c_s <> c_o")
    cross = both.groupBy(F.col("s").alias("id")).agg(F.count_distinct("c_o").alias("crossing"))
    tested = tests.selectExpr("s as id", "true as tested").distinct()
    x = nodes.select("id", "name", "path").join(reach, "id", "left").join(fan, "id", "left").join(cross, "id", "left").join(tested, "id", "left").na.fill(0, ["reach", "callers", "crossing"])
    for c in ("reach", "callers", "crossing"):
        counts = x.groupBy(c).agg(F.count("*").alias("k"))
        ranked = counts.withColumn("upto", F.sum("k").over(Window.orderBy(c))).withColumn("all", F.sum("k").over(Window.partitionBy())).withColumn("values", F.count("*").over(Window.partitionBy()))
        x = x.join(F.broadcast(ranked.select(c, F.when(F.col("values") == 1, 0.0).otherwise(F.round(F.col("upto") / F.col("all"), 6)).alias(f"{c}_rank"))), c)
    from evigraph.functions.text import security_sensitive

    part = lambda name, v: F.round(F.lit(RISK[name]) * v, 4)
    score = part("flow", F.col("reach_rank")) + part("callers", F.col("callers_rank")) + part("crossing", F.col("crossing_rank"))
    score = score + part("untested", F.when(F.col("tested"), 0.0).otherwise(1.0)) + part("security", F.when(security_sensitive(F.col("name"), F.col("path")), 1.0).otherwise(0.0))
    x = x.select("id", F.round(score, 4).alias("score"))
    cuts = x.agg(*[nearest_rank(q, "score").alias(n) for n, q in LEVELS if q])
    level = F.lit("low")
    for n, q in LEVELS:
        if q:
            level = F.when(F.col("score") >= F.col(n), n).otherwise(level)
    return x.join(F.broadcast(cuts)).select("id", "score", level.alias("level"))


def _upto(x: DataFrame, column: str) -> DataFrame:
    """(column, upto): the share of rows at or below each value; values are counted before they are put in order."""
    n = x.groupBy(column).agg(F.count("*").alias("k"))
    ranked = n.withColumn("upto", F.sum("k").over(Window.orderBy(column)) / F.sum("k").over(Window.partitionBy()))
    return ranked.select(column, "upto")


def impact(nodes: DataFrame, edges: DataFrame, seed: DataFrame, depth: int = 3) -> DataFrame:
    """(node, distance, score) of what depends on the seed (root): nearness, the confidence of the way there, and size by rank among the impacted.

    The weights of edges (s, o, w) are confidences up to 1.
    """
    hit = confident(edges, seed, depth, "in").where("distance > 0")
    x = hit.join(nodes.select(F.col("id").alias("node"), "lines"), "node")
    x = x.join(_upto(x, "lines"), "lines")
    part = lambda v: F.round(v, 4)
    score = part(IMPACT["distance"] / (1 + F.col("distance"))) + part(IMPACT["confidence"] * F.col("confidence")) + part(IMPACT["size"] * F.col("upto"))
    return x.select("node", "distance", F.round(score, 4).alias("score"))


def move_suggestions(edges: DataFrame, partition: DataFrame, least: int = 3) -> DataFrame:
    """(node, own, other, pull): nodes more than half of whose neighbours, three or more, are in one other community, with a pull of the 75th percentile or more."""
    p = lambda n: partition.select(F.col("node").alias(n), F.col("c").alias(f"c_{n}"))
    near = edges.select("s", "o").unionAll(edges.selectExpr("o", "s")).where("s <> o").distinct().join(p("s"), "s").join(p("o"), "o")
    by = near.groupBy("s", "c_s", "c_o").agg(F.count("*").alias("k"))
    per = by.groupBy("s", "c_s").agg(F.sum("k").alias("n"), F.max(F.when(F.col("c_o") != F.col("c_s"), F.struct("k", "c_o"))).alias("top")).where(f"n >= {least} and top is not null")
    per = per.select(F.col("s").alias("node"), F.col("c_s").alias("own"), F.col("top.c_o").alias("other"), F.round(F.col("top.k") / F.col("n"), 6).alias("pull"))
    cut = per.agg(nearest_rank(0.75, "pull").alias("cut"))
    return per.join(F.broadcast(cut)).where("pull > 0.5 and pull >= cut").drop("cut")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(s, o, change, old, new) of edges (s, o, w): added, removed or reweighted."""
    b, a = (d.groupBy("s", "o").agg(F.max("w").alias(n)) for d, n in ((before, "old"), (after, "new")))
    d = b.join(a, ["s", "o"], "full").where("old is null or new is null or old <> new")
    return d.select("s", "o", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("reweighted").alias("change"), "old", "new")


def cochange(commits: DataFrame, support: int = 2, most: int = 50) -> DataFrame:
    """(a, b, n): pairs of files that change together in at least `support` commits (commit, file) of at most `most` files."""
    sets = commits.distinct().groupBy("commit").agg(F.array_sort(F.collect_list("file")).alias("f")).where(f"size(f) between 2 and {most}")
    left = sets.select("f", F.posexplode("f").alias("i", "a"))
    return left.select("a", F.explode(F.slice("f", F.col("i") + 2, F.size("f"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= support)


def flow_catalogue(edges: DataFrame, entries: DataFrame, nodes: DataFrame, depth: int = 8) -> DataFrame:
    """(root, steps, paths, rank): what each entry point reaches; rank: half by steps, half by paths, of the largest."""
    f = settle(scopes(edges, entries, nodes.select(F.col("id").alias("node"), F.col("path").alias("group")), depth).toDF("root", "steps", "paths"))
    top = f.agg(F.max("steps").alias("s"), F.max("paths").alias("p"))
    return f.join(F.broadcast(top)).select("root", "steps", "paths", F.round(0.5 * F.col("steps") / F.col("s") + 0.5 * F.col("paths") / F.col("p"), 6).alias("rank"))


def manifest_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of manifests (path, sha)."""
    d = before.withColumnRenamed("sha", "x").join(after.withColumnRenamed("sha", "y"), "path", "full")
    return d.select("path", F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") == F.col("y"), "unchanged").otherwise("changed").alias("change"))


# ------------------------------------------------------------------- reports

# Shares of a flow's criticality, and the bonus of a flow that no test touches.
FLOW = {"depth": 0.25, "fan_in": 0.35, "files": 0.20, "confidence": 0.20}
UNTESTED = 0.15
# How much attention each category of review question deserves.
ATTENTION = {"chokepoint": 1.0, "untested_hotspot": 0.9, "unexpected_coupling": 0.8, "hub": 0.7, "bridge": 0.6, "thin_community": 0.4, "isolated": 0.3}


def flow_criticality(nodes: DataFrame, edges: DataFrame, tests: DataFrame, seed: DataFrame, depth: int = 6) -> DataFrame:
    """(path, depth, fan_in, files, tested, criticality) of the flows from the seed (root).

    A flow is a simple forward path that ends at `depth` calls or where nothing
    new is called. Depth, largest fan-in and files rank among the flows; weights
    of edges (s, o, w) are confidences up to 1.
    """
    now = seed.select(F.array("root").alias("p"), F.col("root").alias("node"), F.lit(0.0).alias("sum"))
    out = None
    for k in range(depth + 1):
        if k < depth:
            step = now.join(edges.select("s", "o", "w"), now.node == F.col("s"), "left").withColumn("on", F.coalesce(F.array_contains("p", F.col("o")), F.lit(True)))
            some = step.where("not on").select("p").distinct()
            done = now.join(some, "p", "left_anti")
        else:
            done = now
        done = done.select("p", "sum")
        out = done if out is None else out.unionAll(done)
        if k < depth:
            now = step.where("not on").select(F.concat("p", F.array("o")).alias("p"), F.col("o").alias("node"), (F.col("sum") + F.col("w")).alias("sum"))
    fan = degrees(edges).select(F.col("node").alias("id"), "fan_in")
    tested = tests.select(F.col("s").alias("id"), F.lit(1).alias("tested")).distinct()
    about = nodes.select("id", "path").join(fan, "id", "left").join(tested, "id", "left").na.fill(0, ["fan_in", "tested"]).withColumnRenamed("path", "file")
    steps = out.select("p", "sum", F.explode("p").alias("id")).join(about, "id")
    flows = steps.groupBy("p", "sum").agg(F.max("fan_in").alias("fan_in"), F.count_distinct("file").alias("files"), (F.max("tested") > 0).alias("tested"))
    flows = flows.withColumn("depth", (F.size("p") - 1).cast("long")).withColumn("sure", F.when(F.col("depth") > 0, F.col("sum") / F.col("depth")).otherwise(1.0))
    score = F.round(FLOW["confidence"] * F.col("sure"), 4) + F.when(F.col("tested"), 0.0).otherwise(UNTESTED)
    for c in ("depth", "fan_in", "files"):
        flows = flows.join(_upto(flows, c).withColumnRenamed("upto", f"{c}_upto"), c)
        score = score + F.round(FLOW[c] * F.col(f"{c}_upto"), 4)
    path = F.array_join(F.transform("p", lambda x: x.cast("string")), ">")
    return flows.select(path.alias("path"), "depth", F.col("fan_in").cast("long").alias("fan_in"), "files", "tested", F.round(score, 4).alias("criticality"))


def blast_radius_of_files(nodes: DataFrame, edges: DataFrame, files: DataFrame, depth: int = 10) -> DataFrame:
    """(path, node, distance): what depends on the symbols of each file (path), without the file's own."""
    own = nodes.join(files, "path").select("path", "id")
    hit = bfs(edges, own.select(F.col("id").alias("root")).distinct(), depth, "in")
    near = own.join(hit.withColumnRenamed("root", "id"), "id").groupBy("path", "node").agg(F.min("distance").alias("distance"))
    return near.join(own.select("path", F.col("id").alias("node")), ["path", "node"], "left_anti")


def affected_entries(edges: DataFrame, changed: DataFrame, entries: DataFrame, depth: int = 4) -> DataFrame:
    """(entry, node, distance): entry points (root) from which a changed node (root) is reached within `depth` calls."""
    hit = bfs(edges, changed, depth, "in")
    return hit.join(entries.select(F.col("root").alias("node")), "node").select(F.col("node").alias("entry"), F.col("root").alias("node"), "distance")


def agreement(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (hit, precision, recall, f1) of predicted pairs against true ones (a, b)."""
    p, t = predicted.select("a", "b").distinct(), truth.select("a", "b").distinct()
    n = p.withColumn("p", F.lit(1)).join(t.withColumn("t", F.lit(1)), ["a", "b"], "full").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(n) for x, n in ((F.col("p") * F.col("t"), "hit"), (F.col("p"), "np"), (F.col("t"), "nt"))])
    ratio = lambda x, y: F.when(F.col(y) > 0, F.round(F.col(x) / F.col(y), 6)).otherwise(0.0)
    n = n.select("hit", ratio("hit", "np").alias("precision"), ratio("hit", "nt").alias("recall"))
    both = F.col("precision") + F.col("recall")
    return n.withColumn("f1", F.when(both > 0, F.round(2 * F.col("precision") * F.col("recall") / both, 6)).otherwise(0.0))


def questions(signals: DataFrame, per_category: int = 5, limit: int = 20) -> DataFrame:
    """(id, category, subject, priority): review questions from signals (category, subject, strength from 0 to 1).

    The strongest of each category, then the first by weight times strength.
    """
    weight = F.lit(0.0)
    for c, w in ATTENTION.items():
        weight = F.when(F.col("category") == c, w).otherwise(weight)
    w = Window.partitionBy("category").orderBy(F.desc("strength"), "subject")
    q = signals.withColumn("strength", F.least(F.greatest("strength", F.lit(0.0)), F.lit(1.0))).withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_category)
    q = q.select(F.concat_ws(":", "category", "subject").alias("id"), "category", "subject", F.round(weight * F.col("strength"), 6).alias("priority"))
    return q.orderBy(F.desc("priority"), "id").limit(limit)


def cohesion(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, internal, outgoing, cohesion): the share of a component's edges that stay in it, 1 without edges."""
    e = _sided(edges.select("s", "o"), nodes, ("path",)).groupBy(F.col("s_path").alias("path")).agg(F.count_if(F.expr("s_path = o_path")).alias("internal"), F.count_if(F.expr("s_path <> o_path")).alias("outgoing"))
    out = nodes.select("path").distinct().join(e, "path", "left").na.fill(0, ["internal", "outgoing"])
    return out.withColumn("cohesion", F.when(F.col("internal") + F.col("outgoing") == 0, 1.0).otherwise(F.round(F.col("internal") / (F.col("internal") + F.col("outgoing")), 6)))


def slices(nodes: DataFrame, edges: DataFrame, seed: DataFrame, depth: int = 3, adjacent: float = 0.25) -> DataFrame:
    """(node, distance, score) of what the seed (root) touches, callers first: nearness times confidence, and a quarter more right next to it."""
    hit = confident(edges, seed, depth, "in").where("distance > 0")
    near = F.when(F.col("distance") == 1, 1.0 + adjacent).otherwise(1.0)
    return hit.join(nodes.select(F.col("id").alias("node")), "node").select("node", "distance", F.round(F.col("confidence") / (1 + F.col("distance")) * near, 6).alias("score"))


def within_tokens(ranked: DataFrame, budget: int) -> DataFrame:
    """ranked (node, distance, tokens) in breadth-first order as far as the tokens go, with truncated: whether anything is left out.

    Sums are taken by distance first, so that only the level that the budget ends in is put in order.
    """
    level = ranked.groupBy("distance").agg(F.sum("tokens").alias("t"))
    before = level.withColumn("before", F.coalesce(F.sum("t").over(Window.orderBy("distance").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    near = ranked.join(F.broadcast(before.where(F.col("before") <= budget)), "distance")
    run = F.sum("tokens").over(Window.partitionBy("distance").orderBy("node").rowsBetween(Window.unboundedPreceding, 0))
    kept = near.withColumn("upto", F.col("before") + run).where(F.col("upto") <= budget).select("node", "distance", "tokens", "upto")
    total = ranked.agg((F.sum("tokens") > budget).alias("truncated"))
    return kept.join(F.broadcast(total))
