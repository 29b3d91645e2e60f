"""The queries of the library over the tables of a folder, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.operators import code, context, evidence, graph, ingest, search
from evigraph.plans import views as V
from evigraph.plans.sql import CHUNKS as _CHUNKS
from evigraph.plans.sql import CLAIMS as _CLAIM_SQL
from evigraph.plans.sql import EDGES as _EDGES
from evigraph.plans.sql import ENTITIES as _ENT_SQL
from evigraph.plans.sql import PART as _PART
from evigraph.plans.sql import SURE as _SURE
from evigraph.plans.sql import walk as _walk
from evigraph.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from evigraph.sources import export
from evigraph.streaming import watch

# shared pieces of the SQL
# words that documents hold, and an identifier
QUERY = "die est"


# ------------------------------------------------------------------- ingest


@query("chunk_slices", f"with {_CHUNKS} select doc_id, ord, text from ch")
def chunk_slices(s, d):
    return V.chunks(s, d).select("doc_id", "ord", "text")


def _claims(s, d):
    return ingest.claims(V.chunks(s, d))


@query("claims_rows", f"with {_CLAIM_SQL} select doc_id, ord, predicate, subject, object from claims")
def claims_rows(s, d):
    return _claims(s, d).select("doc_id", "ord", "predicate", F.lower("subject").alias("subject"), F.lower("object").alias("object"))


@query("claims_by_predicate", f"with {_CLAIM_SQL} select predicate, count(*) as n from claims group by 1")
def claims_by_predicate(s, d):
    return _claims(s, d).groupBy("predicate").agg(F.count("*").alias("n"))


@query("entities", f"with {_ENT_SQL} select * from ent")
def entities(s, d):
    return ingest.entities(V.chunks(s, d)).select("doc_id", "ord", "kind", "canonical")


@query("facet_entity_kind", f"with {_ENT_SQL} select kind, count(*) as n from ent group by 1")
def facet_entity_kind(s, d):
    return search.facet(ingest.entities(V.chunks(s, d)), F.col("kind"), "kind")


_URLS = ingest.URL.replace("'", "''")


@query("urls_from_pages", rf"""with u as (select page_id, unnest(regexp_extract_all(regexp_replace(url || ' ' || html, '[\pL\pN_](https?://)', '_\1', 'g'), '{_URLS}')) as u from pages)
select page_id, lower(trim(regexp_replace(u, '[.,);\]]+$', ''))) as url from u group by all""")
def urls_from_pages(s, d):
    p = V.table(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit(0).cast("long").alias("ord"), F.concat_ws(" ", "url", "html").alias("text"))
    return ingest.entities(p).where("kind = 'url'").select(F.col("doc_id").alias("page_id"), F.col("canonical").alias("url"))


@query("cooccurrence_pairs", f"""with {_ENT_SQL}, x as (select doc_id, ord, kind || ':' || canonical as en, count(*) over (partition by doc_id, ord) as k from ent)
select a.en as a, b.en as b, count(*) as chunks, min(a.doc_id) as first_doc from x a join x b on a.doc_id = b.doc_id and a.ord = b.ord and a.en < b.en where a.k between 2 and 32 group by 1, 2""")
def cooccurrence_pairs(s, d):
    return ingest.cooccurrence(ingest.entities(V.chunks(s, d)))


@query("content_ids", "select doc_id, 'doc_' || substr(sha256(source || chr(31) || coalesce(text, '') || chr(31)), 1, 24) as id from documents")
def content_ids(s, d):
    return V.table(s, d, "documents").select("doc_id", T.content_id("doc", F.col("source"), F.col("text")).alias("id"))


@query("exact_duplicates", "select sha256(text) as sha, min(doc_id) as first, count(*) as n from documents group by text having count(*) > 1")
def exact_duplicates(s, d):
    return V.table(s, d, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")


@query("doc_versions", "with f as (select source, min(doc_id) as doc_id from documents group by source, text) select source, doc_id, row_number() over w as version, lag(doc_id) over w as supersedes from f window w as (partition by source order by doc_id)")
def doc_versions(s, d):
    return ingest.versions(V.table(s, d, "documents"))


# ------------------------------------------------------------------- search

_TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_KEY = " and ".join(f"contains(lower(text), '{w}')" for w in search.query_tokens(QUERY, 8))
_KEYSCORE = " + ".join(f"contains(lower(substr(text, 1, 240)), '{w}')::int" for w in search.query_tokens(QUERY, 8))
_BM25 = f"""tk as (select doc_id as id, {_TOK} as t from documents), st as (select count(*) as n, avg(len(t)) as avgdl from tk),
tf as (select id, len(t) as dl, x, len(list_filter(t, lambda y: y = x)) as tf from tk, (select unnest({sorted(set(search.query_tokens(QUERY, 12)))}) as x)),
df as (select x, count(*) filter (tf > 0) as df from tf group by x),
bm as (select id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score from tf join df using (x), st where tf > 0 group by id)"""
_KW = f"kw as (select doc_id as id, round(({_KEYSCORE}) / {len(search.query_tokens(QUERY, 8))}, 6) as score from documents where {_KEY})"


@query("keyword_topk", f"with {_KW} select id, score from kw order by score desc, id limit 10")
def keyword_topk(s, d):
    return search.keyword_search(V.texts(s, d), QUERY)


@query("bm25_topk", f"with {_BM25} select id, score from bm order by score desc, id limit 10")
def bm25_topk(s, d):
    return search.bm25_search(V.texts(s, d), QUERY)


@query("hybrid_rrf", f"""with {_KW}, {_BM25}, k2 as (select *, row_number() over (order by score desc, id) - 1 as r from kw order by score desc, id limit 30),
b2 as (select *, row_number() over (order by score desc, id) - 1 as r from bm order by score desc, id limit 30),
u as (select id, 1 / (60.0 + r) as p, 'keyword' as arm from k2 union all select id, 1 / (60.0 + r), 'bm25' from b2)
select id, round(sum(p), 6) as score, string_agg(arm, ',' order by arm) as arms from u group by id order by score desc, id limit 10""")
def hybrid_rrf(s, d):
    return search.hybrid_search(V.texts(s, d), QUERY)


_HASH = f"""{_CHUNKS}, ck as (select doc_id || ':' || ord as id, text from ch),
tf as (select id, ('0x' || substr(sha256(x), 1, 8))::bigint % 256 as idx, count(*) as tf from (select id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as x from ck) group by all),
nm as (select id, sqrt(sum(tf * tf)) as norm from tf group by id), v as (select id, idx, tf / norm as w from tf join nm using (id))"""


def _chunk_texts(s, d):
    return V.chunks(s, d).select(F.concat_ws(":", "doc_id", "ord").alias("id"), "text")


@query("hashing_similarity", f"""with {_HASH}, q0 as (select ('0x' || substr(sha256(x), 1, 8))::bigint % 256 as idx, count(*) as tf from (select unnest({search.query_tokens(QUERY, 99)}) as x) group by 1),
q as (select idx, tf / (select sqrt(sum(tf * tf)) from q0) as qw from q0) select id, round(sum(w * qw), 6) as score from v join q using (idx) group by id order by score desc, id limit 10""")
def hashing_similarity(s, d):
    return search.similarity_search(_chunk_texts(s, d), QUERY)


@query("near_duplicate_chunks", f"with {_HASH} select a.id as a, b.id as b, round(sum(a.w * b.w), 6) as score from v a join v b on a.idx = b.idx and a.id < b.id group by 1, 2 having round(sum(a.w * b.w), 6) >= 0.9")
def near_duplicate_chunks(s, d):
    return search.similar_pairs(_chunk_texts(s, d), 0.9)


@query("dense_topk", """with q as (select embedding::double[] as e from embeddings where vec_id = (select min(vec_id) from embeddings))
select vec_id as id, round(list_cosine_similarity(embedding::double[], e), 6) as score from embeddings, q order by score desc, id limit 10""")
def dense_topk(s, d):
    v = V.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    first = v.orderBy("id").limit(1).collect()
    return search.dense_search(v, list(first[0].embedding) if first else [0.0])


@query("retrieval_metrics", """with x as (select l_orderkey as q, l_partkey as p, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_partkey, l_linenumber, l_suppkey) as rank, (l_returnflag = 'R')::int as rel from lineitem),
y as (select *, sum(rel) over (partition by q) as n from x),
z as (select q, max(case when rel = 1 then 1 / rank else 0.0 end) as rr, sum(case when rank <= 10 then rel else 0 end) as hit, sum(case when rank <= 10 and rel = 1 then 1 / log2(rank + 1) else 0.0 end) as dcg, max(n) as n from y group by q)
select count(*) as queries, round(avg(rr), 6) as mrr, round(avg(case when n > 0 then hit / n else 0.0 end), 6) as recall,
 round(avg(case when n > 0 then dcg / list_sum(list_transform(range(1, greatest(least(n, 10), 1)::bigint + 1), lambda i: 1 / log2(i + 1))) else 0.0 end), 6) as ndcg from z""")
def retrieval_metrics(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("query").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_linenumber", "l_suppkey")
    li = V.table(s, d, "lineitem").withColumn("query", F.col("l_orderkey")).withColumn("rank", F.row_number().over(w)).withColumn("relevant", (F.col("l_returnflag") == "R").cast("long"))
    return search.ranking_metrics(li.withColumn("n_relevant", F.sum("relevant").over(Window.partitionBy("query"))))


for _g, _f in (("day", "strftime(ts, '%Y-%m-%d')"), ("week", "strftime(ts, '%Y-W%W')"), ("month", "strftime(ts, '%Y-%m')"), ("year", "strftime(ts, '%Y')")):
    query(f"facet_{_g}", f"select {_f} as bucket, count(*) as n from events group by 1")(lambda s, d, g=_g: search.facet(V.table(s, d, "events"), T.date_bucket(F.col("ts"), g)))
for _c in ("source", "lang"):
    query(f"facet_{_c}", f"select {_c}, count(*) as n from documents group by 1")(lambda s, d, c=_c: search.facet(V.table(s, d, "documents"), F.col(c), c))


@query("identifier_search", """with p as (select p_partkey as id, list_filter(string_split_regex(lower(p_brand || '_' || p_type), '[^a-z0-9]+'), lambda x: x <> '') as parts from part)
select id, 1.0::double as score from p where len(list_filter(range(1, len(parts)), lambda i: parts[i] = 'brand' and parts[i + 1] = '11')) > 0""")
def identifier_search(s, d):
    parts = T.split_identifier(F.lower(F.concat_ws("_", "p_brand", "p_type")))
    p = V.table(s, d, "part").select(F.col("p_partkey").alias("id"), search.identifier_match(["brand_11"], parts).alias("score"))
    return p.where("score > 0")


# ----------------------------------------------------------------- evidence


@query("contradictions_same_subject", rf"""with {_CLAIM_SQL}, cc as (select distinct predicate, subject, object from claims),
pr as (select a.predicate, a.subject, a.object as a, b.object as b from cc a join cc b on a.predicate = b.predicate and a.subject = b.subject and a.object < b.object),
nn as (select *, regexp_extract(a, '[-+]?\d*\.?\d+') as na, regexp_extract(b, '[-+]?\d*\.?\d+') as nb, regexp_matches(a, '\b(no|not|never|none|without)\b') as xa, regexp_matches(b, '\b(no|not|never|none|without)\b') as xb from pr),
sc as (select predicate, subject, a, b, case when na <> '' and nb <> '' and try_cast(na as double) <> try_cast(nb as double) then 0.7 when xa <> xb then 0.5
 when len(list_filter([{", ".join(f"['{x}', '{y}']" for x, y in evidence.ANTONYMS)}], lambda p: (contains(a, p[1]) and contains(b, p[2])) or (contains(a, p[2]) and contains(b, p[1])))) > 0 then 0.8 else 0.0 end::double as score from nn)
select predicate, subject, a, b, score from sc where score >= 0.5""")
def contradictions_same_subject(s, d):
    c = _claims(s, d).select("predicate", "subject", F.lower("object").alias("object"))
    return evidence.same_subject(c)


@query("contradictions_paraphrase")
def contradictions_paraphrase(s, d):
    return evidence.paraphrases(_claims(s, d))


@query("confidence_score", """with x as (select l_partkey, count(*) filter (l_returnflag = 'A') as a, count(*) filter (l_returnflag = 'R') as r, datediff('day', max(l_shipdate)::date, date '1999-01-01') as days, avg(l_discount) * 10 as q from lineitem group by 1)
select l_partkey, round(least(greatest(0.4 * least(greatest(q, 0), 1) + 0.3 * (1 - exp(-a / 3.0)) + 0.2 * exp(-r / 3.0) + 0.1 * exp(-greatest(days, 0) / 365.0), 0), 1), 6) as score from x""")
def confidence_score(s, d):
    li = V.table(s, d, "lineitem").groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.datediff(F.lit("1999-01-01").cast("date"), F.max("l_shipdate")).alias("days"), (F.avg("l_discount") * 10).alias("q"))
    return li.select("l_partkey", F.round(evidence.confidence(F.col("q"), F.col("a"), F.col("r"), F.col("days")), 6).alias("score"))


def _redaction_sql(counts: bool) -> str:
    """Counts by rule and the digest of what is left, or what is left. Rule after rule on what the rules before have left; RE2 has no look-around, so the one rule that needs it counts its runs."""
    text, out = "coalesce(text, '')", []
    for name, pattern, to in T.REDACTIONS:
        p = pattern.replace("'", "''")
        if name == "aws_secret_key":
            run = "regexp_extract_all({t}, '[A-Za-z0-9/+=]+')"
            out.append(f"len(list_filter({run.format(t=text)}, lambda x: length(x) = 40))::bigint as {name}")
            text = f"regexp_replace(regexp_replace({text}, '(^|[^A-Za-z0-9/+=])[A-Za-z0-9/+=]{{40}}($|[^A-Za-z0-9/+=])', '\\1{to}\\2', 'g'), '(^|[^A-Za-z0-9/+=])[A-Za-z0-9/+=]{{40}}($|[^A-Za-z0-9/+=])', '\\1{to}\\2', 'g')"
            continue
        out.append(f"len(regexp_extract_all({text}, '{p}'))::bigint as {name}")
        text = f"regexp_replace({text}, '{p}', '{to.replace('$', chr(92))}', 'g')"
    return f"select doc_id, {', '.join(out)}, sha256({text}) as sha256 from documents" if counts else f"select doc_id, {text} as text from documents"


@query("redaction_counts", _redaction_sql(True))
def redaction_counts(s, d):
    """Matches of all eleven rules, and the digest of what is left."""
    t = F.coalesce("text", F.lit(""))
    return V.table(s, d, "documents").select("doc_id", *T.redaction_counts(t), F.sha2(T.redact(t), 256).alias("sha256"))


@query("redacted", _redaction_sql(False))
def redacted(s, d):
    return V.table(s, d, "documents").select("doc_id", T.redact(F.coalesce("text", F.lit(""))).alias("text"))


@query("security_review", "select conv_id, turn, " + " + ".join(f"(case when regexp_matches(text, '{p}') then {w} else 0 end)" for _, p, w in [(n, p.replace("[\\s\\S]{0,4000}", "[\\s\\S]*").replace("[\\s\\S]{0,2000}", "[\\s\\S]*"), w) for n, p, w in T.INJECTIONS]) + " as score from conversations")
def security_review(s, d):
    return V.table(s, d, "conversations").select("conv_id", "turn", T.injection_score(F.col("text")).alias("score"))


# -------------------------------------------------------------------- graph


for _n, _dir, _k, _root in (("neighbourhood", "both", 2, "select min(s) as root from e"), ("blast_radius", "in", 3, "select min(o) as root from e"), ("execution_flow", "out", 4, "select min(s) as root from e")):
    query(_n, f"with recursive {_EDGES}, {_walk(_dir, _k, _root)} select * from b")(lambda s, d, x=_dir, k=_k, n=_n: graph.bfs(V.edges(s, d), V.first_callee(s, d) if n == "blast_radius" else V.first_caller(s, d), k, x))


@query("flow_chains", f"with recursive {_EDGES}, r(root, path, node, length, c) as (select s, [s], s, 0, 1.0::double from (select min(s) as s from e) union all select root, list_append(path, o), o, length + 1, c * w from r join e on e.s = r.node where length < 3 and not list_contains(path, o)) select root, array_to_string(path, '>') as path, length::bigint as length, round(c, 6) as confidence from r where length > 0")
def flow_chains(s, d):
    return graph.chains(V.edges(s, d), V.first_caller(s, d), 3)


_REACH = "r(root, node) as (select root, root from entry union select r.root, e.o from r join e on e.s = r.node), b as (select root, node, (root <> node)::bigint as distance from r)"


@query("reach_counts", f"with recursive {_EDGES}, {_REACH} select node, count(*) as entry_points from b where distance > 0 group by 1")
def reach_counts(s, d):
    return graph.reached(V.edges(s, d), V.entries(s, d)).withColumnRenamed("n", "entry_points")


@query("components", f"with recursive {_EDGES}, u as (select s as x, o as y from e union select o, s from e), r(x, y) as (select x, x from u union select r.x, u.y from r join u on r.y = u.x) select x as node, min(y) as component from r group by 1")
def components(s, d):
    return graph.components(V.edges(s, d))


@query("strong_components", f"with recursive {_EDGES}, r(x, y) as (select s, s from e union select o, o from e union select r.x, e.o from r join e on e.s = r.y) select a.x as node, min(a.y) as scc from r a join r b on a.x = b.y and a.y = b.x group by 1")
def strong_components(s, d):
    return graph.strong_components(V.edges(s, d))


@query("degree_hubs", f"with {_EDGES} select node, fan_in, fan_out, degree from deg order by degree desc, node limit 20")
def degree_hubs(s, d):
    return graph.degrees(V.edges(s, d)).orderBy(F.desc("degree"), "node").limit(20)


@query("modularity_given", f"""with {_EDGES}, x as (select w, a.p_brand as c, b.p_brand as k from e join part a on s = a.p_partkey join part b on o = b.p_partkey), m as (select sum(w) as m from x),
tot as (select c, sum(w) as tot from (select c, w from x union all select k, w from x) group by c), ins as (select c, sum(w) as i from x where c = k group by c)
select count(*) as communities, round(sum(coalesce(i, 0) / m - (tot / (2.0 * m)) ** 2), 6) as modularity, round(sum(coalesce(i, 0)) / max(m), 6) as coverage from tot left join ins using (c), m""")
def modularity_given(s, d):
    return graph.quality(V.edges(s, d), V.partition(s, d))


for _n, _f in (("betweenness", graph.betweenness), ("cut_points", graph.cuts), ("communities", graph.communities), ("resolution_sweep", graph.sweep)):
    query(_n)(lambda s, d, f=_f: f(V.edges(s, d)))

# --------------------------------------------------------------------- code

@query("coupling_scores", f"""with {_EDGES}, b0 as (select quantile_disc(degree, 0.25) as low, quantile_disc(degree, 0.9) as high from deg), bd as (select low, case when high <= low then coalesce((select min(degree) from deg where degree > low), high) else high end as high from b0),
x as (select s, o, a.path as ca, b.path as cb, a.language as la, b.language as lb, da.degree as d1, db.degree as d2 from e join n a on s = a.id join n b on o = b.id join deg da on da.node = s join deg db on db.node = o)
select s, o, round((case when ca <> cb then 0.45 else 0 end) + (case when la <> lb then 0.35 else 0 end) + (case when high > low and ((d1 <= low and d2 >= high) or (d2 <= low and d1 >= high)) then 0.2 else 0 end), 6)::double as score from x, bd
where ca <> cb or la <> lb or (high > low and ((d1 <= low and d2 >= high) or (d2 <= low and d1 >= high)))""")
def coupling_scores(s, d):
    return code.coupling(V.nodes(s, d), V.edges(s, d), V.partition(s, d))


@query("untested_hotspots", f"with {_EDGES}, f as (select node as id, fan_in as callers from deg where fan_in > 0) select id, callers from f where id not in (select s from t) and callers >= greatest((select quantile_disc(callers, 0.75) from f), 1)")
def untested_hotspots(s, d):
    return code.hotspots(V.nodes(s, d), V.edges(s, d), V.tests(s, d))


@query("isolated_nodes", f"with {_EDGES} select id from n where id not in (select node from deg)")
def isolated_nodes(s, d):
    return code.isolated(V.nodes(s, d), V.edges(s, d))


_SUMMARY = f"""{_EDGES}, {_PART}, pr as (select distinct least(s, o) as s, greatest(s, o) as o from e), x as (select a.c as ca, b.c as cb from pr join pt a on a.node = s join pt b on b.node = o),
sm as (select c, count(*) as members, (select count(*) from x where ca = c and cb = c) as internal, (select count(*) from x where (ca = c) <> (cb = c)) as external from pt group by c),
cs as (select *, case when members < 2 then 1.0 else round(internal / (members * (members - 1) / 2), 6) end::double as density from sm)"""


@query("community_summaries", f"with {_SUMMARY} select * from cs")
def community_summaries(s, d):
    return code.community_summary(V.edges(s, d), V.partition(s, d))


@query("thin_communities", f"with {_SUMMARY} select c, members, internal, density from cs where members >= 2 and members <= (select quantile_disc(members, 0.5) from cs where members >= 2) and density <= (select quantile_disc(density, 0.5) from cs where members >= 2)")
def thin_communities(s, d):
    return code.thin_communities(V.edges(s, d), V.partition(s, d))


@query("dead_nodes", f"with {_EDGES} select id, lines, coalesce((select count(distinct o) from e where s = id), 0) as outbound from n where id not in (select o from e)")
def dead_nodes(s, d):
    return code.dead(V.nodes(s, d), V.edges(s, d))


@query("large_symbols", f"with {_EDGES}, r as (select id, path, lines, round(cume_dist() over (order by lines), 6) as rank from n) select * from r where lines >= 45")
def large_symbols(s, d):
    return code.large(V.nodes(s, d), 45)


@query("architecture_map", f"""with {_EDGES}, x as (select a.path as p, b.path as q from e join n a on s = a.id join n b on o = b.id)
select path, count(*) as symbols, count(distinct language) as languages, (select count(*) from x where p = path and q = path) as internal, (select count(*) from x where q = path and p <> path) as fan_in, (select count(*) from x where p = path and q <> path) as fan_out from n group by path""")
def architecture_map(s, d):
    return code.architecture(V.nodes(s, d), V.edges(s, d))


@query("component_edges", f"with {_EDGES} select a.path as source, b.path as target, count(*) as n, sum((a.language <> b.language)::int)::bigint as cross_language from e join n a on s = a.id join n b on o = b.id where a.path <> b.path group by 1, 2")
def component_edges(s, d):
    return code.component_edges(V.nodes(s, d), V.edges(s, d))


@query("risk_scores", f"""with recursive {_EDGES}, {_REACH}, rc as (select node as id, count(*) as reach from b where distance > 0 group by 1),
un as (select s, o from e union all select o, s from e), cr as (select s as id, count(distinct y.path) as crossing from un join n x on s = x.id join n y on o = y.id where x.path <> y.path group by 1),
f as (select n.id, n.name, n.path, coalesce(reach, 0) as reach, coalesce(fan_in, 0) as callers, coalesce(crossing, 0) as crossing, n.id in (select s from t) as tested from n left join rc using (id) left join deg on node = n.id left join cr on cr.id = n.id),
k as (select *, case when min(reach) over () = max(reach) over () then 0 else round(cume_dist() over (order by reach), 6) end as r1, case when min(callers) over () = max(callers) over () then 0 else round(cume_dist() over (order by callers), 6) end as r2, case when min(crossing) over () = max(crossing) over () then 0 else round(cume_dist() over (order by crossing), 6) end as r3 from f),
z as (select id, round(round(0.25 * r1, 4) + round(0.25 * r2, 4) + round(0.2 * r3, 4) + (case when tested then 0 else 0.2 end) + (case when regexp_matches(lower(name || ' ' || path), 'auth|credential|crypt|decrypt|encrypt|hash|login|passwd|password|permission|privilege|secret|session|sign|token|verify') then 0.1 else 0 end), 4)::double as score from k),
c as (select quantile_disc(score, 0.5) as m, quantile_disc(score, 0.75) as e, quantile_disc(score, 0.9) as h from z)
select id, score, case when score >= h then 'high' when score >= c.e then 'elevated' when score >= m then 'moderate' else 'low' end as level from z, c""")
def risk_scores(s, d):
    return code.risk(V.nodes(s, d), V.edges(s, d), V.tests(s, d), V.partition(s, d), V.entries(s, d))


@query("impact_radius", f"""with recursive {_EDGES}, r(node, distance, c) as (select min(o), 0, 1.0::double from e union select e.s, r.distance + 1, r.c * {_SURE}::double from r join e on e.o = r.node where r.distance < 3),
b as (select node, min(distance) as distance, arg_min(c, (distance, -c)) as c from r group by node), x as (select node, distance::bigint as distance, c, lines from b join n on id = node where distance > 0)
select node, distance, round(round(0.5 / (1 + distance), 4) + round(0.3 * c, 4) + round(0.2 * cume_dist() over (order by lines), 4), 4)::double as score from x""")
def impact_radius(s, d):
    return code.impact(V.nodes(s, d), V.edges(s, d).withColumn("w", F.round(1 - 1.0 / (1 + F.col("w")), 6)), V.first_callee(s, d))


@query("refactor_moves", f"""with {_EDGES}, {_PART}, un as (select s, o from e union select o, s from e), x as (select s, a.c as own, b.c as other, count(*) as k from un join pt a on a.node = s join pt b on b.node = o group by all),
y as (select s, own, sum(k) as n, max(case when other <> own then struct_pack(k := k, c := other) end) as top from x group by all),
z as (select s as node, own, top.c as other, round(top.k / n, 6) as pull from y where n >= 3 and top is not null) select * from z where pull > 0.5 and pull >= (select quantile_disc(pull, 0.75) from z)""")
def refactor_moves(s, d):
    return code.move_suggestions(V.edges(s, d), V.partition(s, d))


@query("snapshot_diff", """with x as (select a.l_partkey as s, b.l_partkey as o, count(*) filter (a.l_returnflag <> 'A') as b, count(*) filter (a.l_returnflag <> 'R') as f from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = 1 and b.l_linenumber = 2 and a.l_partkey <> b.l_partkey group by all)
select s, o, case when b = 0 then 'added' when f = 0 then 'removed' else 'reweighted' end as change, nullif(b, 0) as old, nullif(f, 0) as new from x where b <> f""")
def snapshot_diff(s, d):
    li = V.table(s, d, "lineitem")
    a = li.where("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("s"), "l_returnflag")
    b = li.where("l_linenumber = 2").select("l_orderkey", F.col("l_partkey").alias("o"))
    e = a.join(b, "l_orderkey").where("s <> o")
    side = lambda flag: e.where(F.col("l_returnflag") != flag).groupBy("s", "o").agg(F.count("*").alias("w"))
    return code.snapshot_diff(side("A"), side("R"))


_COMMITS = "cm as (select distinct user_id || '/' || strftime(ts, '%Y-%m-%d') as k, event_type as f from events)"


@query("cochange_pairs", f"with {_COMMITS} select a.f as a, b.f as b, count(*) as n from cm a join cm b on a.k = b.k and a.f < b.f group by 1, 2 having count(*) >= 2")
def cochange_pairs(s, d):
    return code.cochange(V.commits(s, d))


@query("file_churn", f"with {_COMMITS} select f as file, count(distinct k) as commits from cm group by 1")
def file_churn(s, d):
    return V.commits(s, d).groupBy("file").agg(F.count_distinct("commit").alias("commits"))


@query("flow_catalogue", f"with recursive {_EDGES}, {_walk('out', 8, 'select root from entry')}, x as (select root, count(*) as steps, count(distinct path) as paths from b join n on id = node group by 1) select root, steps, paths, round(0.5 * steps / max(steps) over () + 0.5 * paths / max(paths) over (), 6) as rank from x")
def flow_catalogue(s, d):
    return code.flow_catalogue(V.edges(s, d), V.entries(s, d), V.nodes(s, d), 8)


@query("confidence_tiers", f"with {_EDGES}, x as (select case when w / 2.0 >= 1 then 'extracted' when w / 2.0 >= 0.61 then 'inferred' else 'ambiguous' end as tier from e) select tier, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from x group by 1")
def confidence_tiers(s, d):
    from pyspark.sql import Window

    t = V.edges(s, d).groupBy(T.confidence_tier(F.col("w") / 2.0).alias("tier")).agg(F.count("*").alias("n"))
    return t.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("entry_points", f"with {_EDGES} select root from entry")
def entry_points(s, d):
    return V.entries(s, d)


@query("review_context", f"with {_EDGES}, x as (select min(o) as id from e) select 'caller' as relation, s as node from e, x where o = id union all select 'callee', o from e, x where s = id union all select 'test', t.o from t, x where t.s = id")
def review_context(s, d):
    e, x = V.edges(s, d), V.first_callee(s, d)
    one = lambda df, key, to, name: df.join(F.broadcast(x), F.col(key) == F.col("root")).select(F.lit(name).alias("relation"), F.col(to).alias("node"))
    return one(e, "o", "s", "caller").unionAll(one(e, "s", "o", "callee")).unionAll(one(V.tests(s, d), "s", "o", "test"))


@query("duplicate_entities", "select p_name, count(*) as n, min(p_partkey) as first from part group by 1 having count(*) > 1")
def duplicate_entities(s, d):
    return V.table(s, d, "part").groupBy("p_name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).where("n > 1")


@query("forget_path", f"with {_EDGES}, g as (select id from n where path = (select min(path) from n)) select s, o, w from e where s not in (select id from g) and o not in (select id from g)")
def forget_path(s, d):
    n = V.nodes(s, d)
    gone = n.join(F.broadcast(n.agg(F.min("path").alias("path"))), "path").select("id")
    e = V.edges(s, d)
    return e.join(gone, e.s == gone.id, "left_anti").join(gone, F.col("o") == gone.id, "left_anti").select("s", "o", "w")


@query("manifest_changes", "with a as (select url as path, min(sha256(html)) as sha from pages where page_id % 3 <> 0 group by 1), b as (select url as path, max(sha256(html)) as sha from pages where page_id % 5 <> 0 group by 1) select path, case when a.sha is null then 'added' when b.sha is null then 'removed' when a.sha = b.sha then 'unchanged' else 'changed' end as change from a full join b using (path)")
def manifest_changes(s, d):
    p = V.table(s, d, "pages").select(F.col("url").alias("path"), F.sha2("html", 256).alias("sha"), "page_id")
    return code.manifest_changes(p.where("page_id % 3 <> 0").groupBy("path").agg(F.min("sha").alias("sha")), p.where("page_id % 5 <> 0").groupBy("path").agg(F.max("sha").alias("sha")))


@query("export_cypher", f"with {_EDGES} select 'MERGE (n:Entity {{id: ''' || id || '''}}) SET n.name = ''' || name || ''';' as line from n union all select 'MATCH (a:Entity {{id: ''' || s || '''}}), (b:Entity {{id: ''' || o || '''}}) MERGE (a)-[:CALLS]->(b);' from e")
def export_cypher(s, d):
    return export.cypher(V.nodes(s, d), V.edges(s, d))


@query("export_dot", f"with {_EDGES} select '  \"' || s || '\" -> \"' || o || '\";' as line from e")
def export_dot(s, d):
    return export.dot(V.edges(s, d))


# ------------------------------------------------------ context, governance


@query("token_estimates", r"select doc_id, len(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '[A-Za-z]{1,4}|[0-9]|\n|[^\sA-Za-z0-9]'))::bigint as tokens from documents")
def token_estimates(s, d):
    return V.table(s, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("pack_budget")
def pack_budget(s, d):
    u = V.table(s, d, "documents").select(F.col("source").alias("pack"), F.col("doc_id").alias("key"), (-F.col("doc_id")).cast("double").alias("score"), T.estimate_tokens(F.col("text")).alias("tokens"), (F.col("doc_id") % 97 == 0).alias("required"))
    return context.pack(u, 20_000)


@query("session_suppress", "select conv_id as session, turn, role as key, case when lag(sha256(text)) over w is null then 'sent' when lag(sha256(text)) over w <> sha256(text) then 'resent' else 'suppressed' end as state from conversations window w as (partition by conv_id, role order by turn)")
def session_suppress(s, d):
    c = V.table(s, d, "conversations").select(F.col("conv_id").alias("session"), "turn", F.col("role").alias("key"), F.col("text").alias("content"))
    return context.suppress(c).drop("content")


@query("audit_chain")
def audit_chain(s, d):
    e = V.table(s, d, "events").select(F.col("user_id").alias("log"), F.col("event_id").alias("seq"), F.concat_ws("|", "event_type", "value").alias("payload"))
    return context.audit_chain(e)


@query("tenant_quota", "select c_nationkey as tenant, count(*) as n, 60::bigint as quota, count(*) > 60 as exceeded from customer group by 1")
def tenant_quota(s, d):
    return context.over_quota(V.table(s, d, "customer").select(F.col("c_nationkey").alias("tenant")), 60)


@query("policy_decisions", """select event_id, case when k = 'read' then 'allow' when k = 'network' and not net then 'deny: network off' when k in ('write', 'delete', 'network') and not con then 'deny: no consent' when not per then 'deny: not permitted' when k in ('write', 'delete', 'network', 'export') then 'allow' else 'deny: unknown' end as decision
from (select event_id, case event_type when 'view' then 'read' when 'click' then 'network' when 'purchase' then 'write' when 'signup' then 'export' else 'other' end as k, user_id % 2 = 0 as net, user_id % 3 = 0 as con, user_id % 5 <> 0 as per from events)""")
def policy_decisions(s, d):
    kind = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "click", "network").when(F.col("event_type") == "purchase", "write").when(F.col("event_type") == "signup", "export").otherwise("other")
    u = F.col("user_id")
    return V.table(s, d, "events").select("event_id", context.decide(kind, u % 2 == 0, u % 3 == 0, u % 5 != 0).alias("decision"))


@query("graph_revision", f"with {_EDGES} select count(*) as edges, sum(w)::bigint as weight, max(s) as top from e")
def graph_revision(s, d):
    return V.edges(s, d).agg(F.count("*").alias("edges"), F.sum("w").alias("weight"), F.max("s").alias("top"))


@query("status_counts", "select 'documents' as kind, count(*) as n from documents union all select 'pages', count(*) from pages union all select 'conversations', count(distinct conv_id) from conversations")
def status_counts(s, d):
    one = lambda t, c: V.table(s, d, t).agg(c.alias("n")).select(F.lit(t).alias("kind"), "n")
    return one("documents", F.count("*")).unionAll(one("pages", F.count("*"))).unionAll(one("conversations", F.count_distinct("conv_id")))


@query("html_titles", r"select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, len(regexp_extract_all(html, '<a href=')) as links from pages")
def html_titles(s, d):
    return V.table(s, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a href=")).cast("long").alias("links"))


@query("ext_tumbling_events", "select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def ext_tumbling_events(s, d):
    return watch.tumbling_counts(V.table(s, d, "events"))


# the rest of the catalogue registers itself
from evigraph.plans import code_queries, ledger_queries  # noqa: E402, F401
