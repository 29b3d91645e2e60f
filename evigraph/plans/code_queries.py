"""Queries over the code-like graph that build on several operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.operators import code, graph
from evigraph.plans import views as V
from evigraph.plans.registry import query
from evigraph.plans.sql import CHOSEN, EDGES, PART, SURE, walk


def sure_edges(s, d) -> DataFrame:
    """Edges whose weight is a confidence below 1, higher the more calls there are."""
    return V.edges(s, d).withColumn("w", F.round(1 - 1.0 / (1 + F.col("w")), 6))


def chosen_paths(s, d) -> DataFrame:
    """The first three paths by name."""
    return V.nodes(s, d).select("path").distinct().orderBy("path").limit(3)


# ---------------------------------------------------------------- traversal


@query("blast_radius_for_file", f"""with recursive {EDGES}, own as (select id, path from n where path in ({CHOSEN})), r(path, node, distance) as (select path, id, 0 from own union select r.path, e.s, r.distance + 1 from r join e on e.o = r.node where r.distance < 3)
select path, node, min(distance)::bigint as distance from r where (path, node) not in (select (path, id) from own) group by 1, 2""")
def blast_radius_for_file(s, d):
    return code.blast_radius_of_files(V.nodes(s, d), V.edges(s, d), chosen_paths(s, d), 3)


@query("affected_flows", f"""with recursive {EDGES}, r(root, node, distance) as (select id, id, 0 from n where path = (select min(path) from n) union select r.root, e.s, r.distance + 1 from r join e on e.o = r.node where r.distance < 4)
select node as entry, root as node, min(distance)::bigint as distance from r where node in (select root from entry) group by 1, 2""")
def affected_flows(s, d):
    n = V.nodes(s, d)
    changed = n.join(F.broadcast(n.agg(F.min("path").alias("path"))), "path").select(F.col("id").alias("root"))
    return code.affected_entries(V.edges(s, d), changed, V.entries(s, d))


@query("flow_criticality", f"""with recursive {EDGES}, r(p, node, total) as (select [s], s, 0.0::double from (select min(s) as s from e) union all select list_append(p, o), o, total + {SURE}::double from r join e on e.s = r.node where len(p) <= 3 and not list_contains(p, o)),
done as (select p, total from r where len(p) = 4 or not exists (select 1 from e where e.s = r.node and not list_contains(r.p, e.o))),
st as (select p, total, unnest(p) as id from done), x as (select p, total, n.path, coalesce(fan_in, 0) as fan_in, id in (select s from t) as tested from st join n using (id) left join deg on node = id),
f as (select p, total, len(p) - 1 as depth, max(fan_in) as fan_in, count(distinct path) as files, bool_or(tested) as tested from x group by p, total)
select array_to_string(p, '>') as path, depth::bigint as depth, fan_in::bigint as fan_in, files, tested,
 round(round(0.2 * case when depth > 0 then total / depth else 1 end, 4) + case when tested then 0 else 0.15 end + round(0.25 * cume_dist() over (order by depth), 4) + round(0.35 * cume_dist() over (order by fan_in), 4) + round(0.2 * cume_dist() over (order by files), 4), 4)::double as criticality from f""")
def flow_criticality(s, d):
    return code.flow_criticality(V.nodes(s, d), sure_edges(s, d), V.tests(s, d), V.first_caller(s, d), 3)


_SLICE = f"""r(node, distance, c) as (select min(o), 0, 1.0::double from e union select e.s, r.distance + 1, r.c * {SURE}::double from r join e on e.o = r.node where r.distance < 3),
b as (select node, min(distance)::bigint as distance, arg_min(c, (distance, -c)) as c from r group by node)"""


@query("answer_slices", f"with recursive {EDGES}, {_SLICE} select node, distance, round(c / (1 + distance) * case when distance = 1 then 1.25 else 1 end, 6)::double as score from b join n on id = node where distance > 0")
def answer_slices(s, d):
    return code.slices(V.nodes(s, d), sure_edges(s, d), V.first_callee(s, d))


@query("traverse_budget", f"""with recursive {EDGES}, {walk('in', 3, 'select min(o) as root from e')}, x as (select node, distance, len(regexp_extract_all(name || ' ' || path, '[A-Za-z]{{1,4}}|[0-9]|\\n|[^\\sA-Za-z0-9]'))::bigint as tokens from b join n on id = node),
y as (select *, sum(tokens) over (order by distance, node)::bigint as upto, sum(tokens) over () > 300 as truncated from x) select * from y where upto <= 300""")
def traverse_budget(s, d):
    hit = graph.bfs(V.edges(s, d), V.first_callee(s, d), 3, "in").select("node", "distance")
    n = V.nodes(s, d).select(F.col("id").alias("node"), T.estimate_tokens(F.concat_ws(" ", "name", "path")).alias("tokens"))
    return code.within_tokens(hit.join(n, "node"), 300)


@query("savings_record", f"""with recursive {EDGES}, {walk('in', 2, 'select min(o) as root from e')}, k as (select id, path, len(regexp_extract_all(name || ' ' || language, '[A-Za-z]{{1,4}}|[0-9]|\\n|[^\\sA-Za-z0-9]')) as tokens from n),
u as (select sum(tokens)::bigint as used from k join b on id = node), f as (select sum(tokens)::bigint as baseline from k where path in (select path from k join b on id = node))
select used, baseline, baseline - used as saved, round(1 - used / baseline, 6) as share from u, f""")
def savings_record(s, d):
    """Tokens of a slice against those of all symbols of the files it touches."""
    n = V.nodes(s, d).select(F.col("id").alias("node"), "path", T.estimate_tokens(F.concat_ws(" ", "name", "language")).alias("tokens"))
    hit = n.join(graph.bfs(V.edges(s, d), V.first_callee(s, d), 2, "in").select("node"), "node")
    used, base = hit.agg(F.sum("tokens").alias("used")), n.join(hit.select("path").distinct(), "path").agg(F.sum("tokens").alias("baseline"))
    both = used.join(F.broadcast(base))  # one row each
    return both.select("used", "baseline", (F.col("baseline") - F.col("used")).alias("saved"), F.round(1 - F.col("used") / F.col("baseline"), 6).alias("share"))


# ------------------------------------------------------------------ summaries


@query("degree_with_loops", "with x as (select l_partkey as s, l_suppkey as o from lineitem) select node, count(*) as degree from (select s as node from x union all select o from x where s <> o) group by 1")
def degree_with_loops(s, d):
    e = V.table(s, d, "lineitem").select(F.col("l_partkey").alias("s"), F.col("l_suppkey").alias("o"))
    return e.select(F.col("s").alias("node")).unionAll(e.where("s <> o").select("o")).groupBy("node").agg(F.count("*").alias("degree"))


@query("legend_groups", """with g as (select p_type as kind, count(*) as n, min(p_partkey) as least from part group by 1), r as (select *, row_number() over (order by n desc, least) as r from g)
select case when r <= 5 then kind else 'other' end as kind, sum(n)::bigint as n from r group by 1""")
def legend_groups(s, d):
    """Kinds by size and smallest id; the tail is folded."""
    g = V.table(s, d, "part").groupBy(F.col("p_type").alias("kind")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("least"))
    top = g.orderBy(F.desc("n"), "least").limit(5).select("kind", F.lit(True).alias("top"))
    return g.join(F.broadcast(top), "kind", "left").groupBy(F.when(F.col("top"), F.col("kind")).otherwise("other").alias("kind")).agg(F.sum("n").alias("n"))


@query("bounded_graph", f"""with {EDGES}, k as (select id from n order by id limit 500), f as (select (select count(*) from n) > 500 as truncated)
select s, o, w, truncated from e, f where s in (select id from k) and o in (select id from k)""")
def bounded_graph(s, d):
    n = V.nodes(s, d).select("id").orderBy("id").limit(501)
    kept = n.orderBy("id").limit(500)
    flag = n.agg((F.count("*") > 500).alias("truncated"))
    e = V.edges(s, d)
    return e.join(kept, e.s == kept.id, "left_semi").join(kept, F.col("o") == kept.id, "left_semi").join(F.broadcast(flag)).select("s", "o", "w", "truncated")


@query("symbols_by_prefix", f"with {EDGES} select id, path, lines from n where starts_with(path, 'Brand#1') and lines >= 20 and starts_with(language, 'STANDARD')")
def symbols_by_prefix(s, d):
    return V.nodes(s, d).where(F.col("path").startswith("Brand#1") & (F.col("lines") >= 20) & F.col("language").startswith("STANDARD")).select("id", "path", "lines")


@query("summary_by_kind", "select 'symbol' as side, p_type as kind, count(*) as n from part group by 2 union all select 'edge', l_returnflag || l_linestatus, count(*) from lineitem group by 2")
def summary_by_kind(s, d):
    n = V.table(s, d, "part").groupBy(F.col("p_type").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("symbol").alias("side"), "kind", "n")
    e = V.table(s, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("side"), "kind", "n")
    return n.unionAll(e)


@query("confidence_by_predicate", """with x as (select l_returnflag as predicate, case when l_discount * 10 >= 1 then 'extracted' when l_discount * 10 >= 0.61 then 'inferred' else 'ambiguous' end as tier from lineitem)
select predicate, count(*) filter (tier = 'extracted') as extracted, count(*) filter (tier = 'inferred') as inferred, count(*) filter (tier = 'ambiguous') as ambiguous from x group by 1""")
def confidence_by_predicate(s, d):
    x = V.table(s, d, "lineitem").select(F.col("l_returnflag").alias("predicate"), T.confidence_tier(F.col("l_discount") * 10).alias("tier"))
    return x.groupBy("predicate").agg(*[F.count_if(F.col("tier") == t).alias(t) for t in ("extracted", "inferred", "ambiguous")])


@query("component_cohesion", f"""with {EDGES}, x as (select a.path as p, count(*) filter (a.path = b.path) as i, count(*) filter (a.path <> b.path) as u from e join n a on s = a.id join n b on o = b.id group by 1)
select path, coalesce(i, 0) as internal, coalesce(u, 0) as outgoing, case when coalesce(i, 0) + coalesce(u, 0) = 0 then 1.0 else round(i / (i + u), 6) end::double as cohesion from (select distinct path from n) left join x on p = path""")
def component_cohesion(s, d):
    return code.cohesion(V.nodes(s, d), V.edges(s, d))


@query("graph_revision_digest", f"with {EDGES} select count(*) as edges, substr(sha256(count(*) || '|' || sum(w)::bigint || '|' || max(s) || '|' || max(o)), 1, 16) as revision from e")
def graph_revision_digest(s, d):
    e = V.edges(s, d).agg(F.count("*").alias("edges"), F.sum("w").alias("w"), F.max("s").alias("s"), F.max("o").alias("o"))
    return e.select("edges", F.substring(F.sha2(F.concat_ws("|", "edges", "w", "s", "o"), 256), 1, 16).alias("revision"))


@query("cochange_agreement", f"""with recursive {EDGES}, p as (select distinct a.path as a, b.path as b from e join n a on s = a.id join n b on o = b.id where a.path < b.path),
li as (select distinct l_orderkey as k, p_brand as f from lineitem join part on l_partkey = p_partkey), tr as (select x.f as a, y.f as b from li x join li y on x.k = y.k and x.f < y.f group by 1, 2 having count(*) >= 25),
c as (select (select count(*) from p join tr using (a, b)) as hit, (select count(*) from p) as np, (select count(*) from tr) as nt),
z as (select hit, case when np > 0 then round(hit / np, 6) else 0.0 end::double as precision, case when nt > 0 then round(hit / nt, 6) else 0.0 end::double as recall from c)
select hit, precision, recall, case when precision + recall > 0 then round(2 * precision * recall / (precision + recall), 6) else 0.0 end::double as f1 from z""")
def cochange_agreement(s, d):
    """How well calls between files tell which files change together."""
    e = code.component_edges(V.nodes(s, d), V.edges(s, d)).where("source < target").select(F.col("source").alias("a"), F.col("target").alias("b"))
    li = V.table(s, d, "lineitem").join(V.table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("commit"), F.col("p_brand").alias("file"))
    return code.agreement(e, code.cochange(li, 25))


# ---------------------------------------------------------------- communities


@query("community_parts", f"""with recursive {EDGES}, {PART}, se as (select s, o from e join pt a on a.node = s join pt b on b.node = o where a.c = b.c), u as (select s as x, o as y from se union select o, s from se),
r(x, y) as (select x, x from u union select r.x, u.y from r join u on r.y = u.x), c as (select x, min(y) as part from r group by 1) select node, c, coalesce(part, node) as part from pt left join c on x = node""")
def community_parts(s, d):
    return graph.connected_parts(V.edges(s, d), V.partition(s, d))


@query("community_labels", """with x as (select p_brand as c, unnest(regexp_extract_all(lower(p_type), '[a-z0-9]+')) as token from part), y as (select c, token, row_number() over (partition by c order by count(*) desc, token) as r from x group by 1, 2)
select c, string_agg(token, ' ' order by r) as label from y where r <= 3 group by 1""")
def community_labels(s, d):
    t = V.table(s, d, "part").select(F.col("p_partkey").alias("node"), F.explode(T.tokens(F.col("p_type"))).alias("token"))
    return graph.labels(V.partition(s, d), t)


@query("membership_changes", """with x as (select p_partkey as node, p_brand as b, p_type as a from part where p_partkey % 7 <> 0), m as (select b, a, count(*) as k from x group by 1, 2)
select node, gained, lost from (select x.node, ((select sum(k) from m where m.a = x.a) - k)::bigint as gained, ((select sum(k) from m where m.b = x.b) - k)::bigint as lost from x join m using (b, a)) where gained > 0 or lost > 0""")
def membership_changes(s, d):
    p = V.table(s, d, "part")
    return graph.membership_changes(p.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("c")), p.select(F.col("p_partkey").alias("node"), F.col("p_type").alias("c")))


@query("hub_scores")
def hub_scores(s, d):
    return graph.hubs(graph.deal(V.edges(s, d)), V.nodes(s, d).count())


@query("chokepoints")
def chokepoints(s, d):
    e = graph.deal(V.edges(s, d))
    return graph.chokepoints(graph.cuts(e), graph.hubs(e, V.nodes(s, d).count()))


@query("oversized_split")
def oversized_split(s, d):
    return graph.split_oversized(V.edges(s, d), V.table(s, d, "part").select(F.col("p_partkey").alias("node"), F.lit("all").alias("c")))


@query("review_questions")
def review_questions(s, d):
    n, e, p, t = V.nodes(s, d), graph.deal(V.edges(s, d)), V.partition(s, d), V.tests(s, d)
    hub, cut = graph.hubs(e, n.count()), graph.cuts(e)
    choke = graph.chokepoints(cut, hub)
    name = lambda c: F.col(c).cast("string").alias("subject")
    hot = code.hotspots(n, e, t).withColumn("strength", F.col("callers") / F.max("callers").over(Window.partitionBy()))
    signals = [
        choke.select(F.lit("chokepoint").alias("category"), name("node"), F.col("score").alias("strength")),
        hub.join(choke.select("node"), "node", "left_anti").select(F.lit("hub"), name("node"), "score"),
        cut.where("kind = 'bridge'").select(F.lit("bridge"), F.concat_ws("->", "a", "b"), F.lit(1.0)),
        code.coupling(n, e, p).select(F.lit("unexpected_coupling"), F.concat_ws("->", "s", "o"), "score"),
        hot.select(F.lit("untested_hotspot"), name("id"), "strength"),
        code.isolated(n, e).select(F.lit("isolated"), name("id"), F.lit(1.0)),
        code.thin_communities(e, p).select(F.lit("thin_community"), name("c"), 1 - F.col("density")),
    ]
    every = signals[0]
    for x in signals[1:]:
        every = every.unionAll(x)
    return code.questions(every)
