"""Queries over the evidence ledger, search with its arms and filters, governance, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.operators import ledger, search
from evigraph.plans import views as V
from evigraph.plans.registry import query
from evigraph.plans.sql import CHUNKS, CLAIMS, EDGES, LEDGER, content_id
from evigraph.sources import export

WORDS = "die est"
_BM = f"""tk as (select chunk_id as id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from ck), st2 as (select count(*) as n, avg(len(t)) as avgdl from tk),
tfs as (select id, len(t) as dl, x, len(list_filter(t, lambda y: y = x)) as tf from tk, (select unnest({sorted(search.query_tokens(WORDS, 12))}) as x)),
dfs as (select x, count(*) filter (tf > 0) as df from tfs group by x),
bm as (select id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score from tfs join dfs using (x), st2 where tf > 0 group by id)"""


def the_ledger(s, d) -> ledger.Ledger:
    return ledger.ingest_documents(V.table(s, d, "documents"))


# ------------------------------------------------------------------- ledger

_TABLES = {"sources": "(select distinct source_id from known)", "documents": "known", "chunks": "ck", "entities": "enty", "mentions": "(select distinct chunk_id, entity_id from found)", "claims": "said", "citations": "cit", "provenance": "known"}


@query("ledger_status", f"with {LEDGER} " + " union all ".join(f"select '{n}' as kind, count(*) as n from {t}" for n, t in _TABLES.items()))
def ledger_status(s, d):
    x = the_ledger(s, d)
    out = None
    for n in _TABLES:
        one = getattr(x, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("kind"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@query("ledger_mentions", f"with {LEDGER} select distinct chunk_id, entity_id from found")
def ledger_mentions(s, d):
    return the_ledger(s, d).mentions


@query("ledger_claims", f"with {LEDGER} select claim_id, chunk_id, subject_id, predicate, object from said")
def ledger_claims(s, d):
    return the_ledger(s, d).claims.select("claim_id", "chunk_id", "subject_id", "predicate", F.lower("object").alias("object"))


@query("source_facet", f"with {LEDGER} select source as uri, count(distinct document_id) as documents, count(chunk_id) as chunks from known left join ck using (document_id) group by 1")
def source_facet(s, d):
    return ledger.source_facet(the_ledger(s, d))


@query("chunks_of_entity", f"with {LEDGER} select chunk_id from ck where chunk_id in (select chunk_id from found where kind = 'version')")
def chunks_of_entity(s, d):
    return ledger.chunks_of_entity(the_ledger(s, d), "version")


@query("claim_report", f"with {LEDGER} select claim_id, coalesce(display, subject_id, '(none)') as subject, predicate, object from said left join enty on entity_id = subject_id")
def claim_report(s, d):
    return ledger.claim_report(the_ledger(s, d)).withColumn("object", F.lower("object"))


@query("claim_evidence", f"""with {LEDGER} select claim_id, ck.chunk_id, ck.document_id, sha256(ck.text) as text_sha256, citation_id as citations, 'ingest' as activities from said join ck on ck.chunk_id = said.chunk_id join cit using (claim_id)""")
def claim_evidence(s, d):
    return ledger.claim_evidence(the_ledger(s, d))


@query("answer_packet", f"""with {LEDGER}, {_BM}, hit as (select id from bm order by score desc, id limit 10)
select ck.chunk_id, ck.document_id, coalesce(string_agg(citation_id, ',' order by citation_id), '') as citations from ck join hit on id = chunk_id left join cit on cit.chunk_id = ck.chunk_id group by 1, 2""")
def answer_packet(s, d):
    x = the_ledger(s, d)
    hits = search.bm25_search(x.chunks.select(F.col("chunk_id").alias("id"), "text"), WORDS)
    return ledger.answer_packet(x, hits.select(F.col("id").alias("chunk_id")))


@query("validate_claims", """with r as (select l_partkey as subject, count(*) filter (l_returnflag = 'A') as a, count(*) filter (l_returnflag = 'R') as b from lineitem group by 1)
select p_partkey as claim, coalesce(a, 0) as supporting, coalesce(b, 0) as contradicting, round(0.4 * 0.5 + 0.3 * (1 - exp(-coalesce(a, 0) / 3.0)) + 0.2 * exp(-coalesce(b, 0) / 3.0) + 0.1 * exp(-p_size / 365.0), 6) as score from part left join r on subject = p_partkey""")
def validate_claims(s, d):
    support = F.when(F.col("l_returnflag") == "A", "supports").when(F.col("l_returnflag") == "R", "contradicts").otherwise("neutral")
    r = V.table(s, d, "lineitem").select(F.col("l_partkey").alias("subject"), support.alias("support"))
    return ledger.validated(V.table(s, d, "part").select(F.col("p_partkey").alias("claim"), F.col("p_partkey").alias("subject"), F.col("p_size").alias("days")), r)


@query("contradiction_scan")
def contradiction_scan(s, d):
    from evigraph.operators import ingest

    return ledger.scan(ingest.claims(V.chunks(s, d)))


# ------------------------------------------------------------------- search


@query("keyword_in_source", f"with {CHUNKS} select ch.doc_id || ':' || ord as id, ((contains(lower(substr(ch.text, 1, 240)), 'die')::int + contains(lower(substr(ch.text, 1, 240)), 'est')::int) / 2.0)::double as score from ch join documents using (doc_id) where source = (select min(source) from documents) and contains(lower(ch.text), 'die') and contains(lower(ch.text), 'est') order by score desc, id limit 10")
def keyword_in_source(s, d):
    docs = V.table(s, d, "documents").select("doc_id", "source")
    own = docs.join(F.broadcast(docs.agg(F.min("source").alias("source"))), "source").select("doc_id")
    c = V.chunks(s, d).join(own, "doc_id", "left_semi").select(F.concat_ws(":", "doc_id", "ord").alias("id"), "text")
    return search.keyword_search(c, WORDS)


@query("hybrid_four_arms", """with v as (select vec_id as id, embedding::double[] as e from embeddings), q as (select e as qe from v order by id limit 1),
vec as (select id, row_number() over (order by round(list_cosine_similarity(e, qe), 6) desc, id) - 1 as r from v, q order by r limit 20),
tk as (select doc_id as id, lower(text) as low, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents),
kw as (select id, round((contains(substr(low, 1, 240), 'die')::int + contains(substr(low, 1, 240), 'est')::int) / 2, 6) as score from tk where contains(low, 'die') and contains(low, 'est')),
st as (select count(*) as n, avg(len(t)) as avgdl from tk), tf as (select id, len(t) as dl, x, len(list_filter(t, lambda y: y = x)) as tf from tk, (select unnest(['die', 'est']) as x)),
df as (select x, count(*) filter (tf > 0) as df from tf group by x),
bm as (select id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score from tf join df using (x), st where tf > 0 group by id),
idn as (select doc_id as id, 1.0 as score from documents where regexp_matches(lower(source), '(^|[^a-z0-9])0([^a-z0-9]|$)')),
u as (select id, 1 / (60.0 + r) as p, 'vector' as arm from vec
 union all select id, 1 / (60.0 + row_number() over (order by score desc, id) - 1), 'keyword' from (select * from kw order by score desc, id limit 20)
 union all select id, 1 / (60.0 + row_number() over (order by score desc, id) - 1), 'bm25' from (select * from bm order by score desc, id limit 20)
 union all select id, 1 / (60.0 + row_number() over (order by score desc, id) - 1), 'identifier' from (select * from idn order by score desc, id limit 20))
select id, round(sum(p), 6) as score, string_agg(arm, ',' order by arm) as arms from u group by id order by score desc, id limit 10""")
def hybrid_four_arms(s, d):
    """Keyword, BM25, vector and identifier arms; a document's vector is that of the same number, its identifiers are its source's."""
    docs, v = V.table(s, d, "documents"), V.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    first = v.orderBy("id").limit(1).collect()
    arms = {
        "keyword": search.keyword_search(V.texts(s, d), WORDS, 20),
        "bm25": search.bm25_search(V.texts(s, d), WORDS, 20),
        "vector": search.dense_search(v, list(first[0].embedding) if first else [0.0], 20),
        "identifier": search.identifier_arm(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("name")), ["0"], 20),
    }
    return search.fuse(arms)


@query("reranked", """with x as (select p_partkey as id, p_retailprice / 1000 as score, regexp_matches(lower(p_type), '(^| )steel( |$)')::int as hit from part), t as (select * from x order by score desc, id limit 30),
g as (select (max(score) - min(score)) / greatest(count(*) - 1, 1) as gap from t) select id, round(score + gap * hit, 6) as score from t, g order by score desc, id limit 10""")
def reranked(s, d):
    p = V.table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 1000).alias("score"), F.col("p_type").alias("name"))
    return search.boosted(p.orderBy(F.desc("score"), "id").limit(30), ["steel"], 10)


@query("code_search", f"with {EDGES} select id, name, path from n where contains(lower(name), '#1') or contains(lower(path), '#11')")
def code_search(s, d):
    return V.nodes(s, d).where(F.lower("name").contains("#1") | F.lower("path").contains("#11")).select("id", "name", "path")


@query("federated_search", """with a as (select 'first' as root, p_partkey as id, p_retailprice::double as score from part where p_partkey % 2 = 0 order by score desc, id limit 5), b as (select 'second' as root, p_partkey as id, p_retailprice::double as score from part where p_partkey % 2 = 1 order by score desc, id limit 5)
select * from (select * from a union all select * from b) order by score desc, root, id limit 5""")
def federated_search(s, d):
    p = V.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").cast("double").alias("score"))
    return search.federated({"first": p.where("id % 2 = 0"), "second": p.where("id % 2 = 1")}, 5)


# ------------------------------------------------------- sets, names, governance


@query("merged_mentions", "with e as (select c_custkey as id, c_mktsegment as name from customer), k as (select id, min(id) over (partition by lower(trim(name))) as keep from e) select distinct keep as id, o_orderdate::varchar as at from orders join k on id = o_custkey")
def merged_mentions(s, d):
    e = V.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"))
    m = V.table(s, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").cast("string").alias("at"))
    return ledger.merge_duplicates(e, m)[1]


@query("resolution_groups", "with x as (select case when p_partkey % 2 = 0 then upper(p_type) else p_type || '.' end as name from part) select lower(regexp_replace(name, '[.]+$', '')) as key, string_agg(distinct name, '|' order by name) as names from x group by 1 having count(distinct name) > 1")
def resolution_groups(s, d):
    n = V.table(s, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.concat("p_type", F.lit("."))).alias("name"))
    return ledger.resolution_groups(n).select("key", F.array_join("names", "|").alias("names"))


@query("upserted", "with a as (select p_partkey as k, p_size as z, p_brand as v, 0 as fresh from part where p_partkey % 3 <> 0 union all select p_partkey, p_size + p_partkey % 2, p_type, 1 from part where p_partkey % 5 <> 0) select k, max(z)::bigint as at, arg_max(v, z * 2 + fresh) as v from a group by 1")
def upserted(s, d):
    p = V.table(s, d, "part")
    old = p.where("p_partkey % 3 <> 0").selectExpr("p_partkey as k", "cast(p_size as long) as at", "p_brand as v")
    new = p.where("p_partkey % 5 <> 0").selectExpr("p_partkey as k", "cast(p_size + p_partkey % 2 as long) as at", "p_type as v")
    return ledger.upsert(old, new, "k", "at")


@query("added_new", "select count(*) as n, sum(v)::bigint as total from (select p_partkey as k, 1 as v from part where p_partkey % 3 = 0 union all select p_partkey, 100 from part where p_partkey % 3 <> 0)")
def added_new(s, d):
    p = V.table(s, d, "part")
    old, new = p.where("p_partkey % 3 = 0").selectExpr("p_partkey as k", "1 as v"), p.selectExpr("p_partkey as k", "100 as v")
    return ledger.add_new(old, new.unionAll(new), "k").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("forget_dry_run", "select x as prefix, (select count(*) from pages where url = x or starts_with(url, rtrim(x, '/') || '/')) as n from (select unnest([(select regexp_extract(min(url), '^https?://[^/]+') from pages), 'no/such']) as x)")
def forget_dry_run(s, d):
    p = V.table(s, d, "pages")
    first = p.agg(F.regexp_extract(F.min("url"), "^https?://[^/]+", 0)).first()[0] or ""
    return ledger.forget(p, "url", [first, "no/such"], dry_run=True)


@query("forgotten_pages", "select page_id from pages where not (url = (select regexp_extract(min(url), '^https?://[^/]+') from pages) or starts_with(url, (select regexp_extract(min(url), '^https?://[^/]+') from pages) || '/'))")
def forgotten_pages(s, d):
    p = V.table(s, d, "pages")
    return ledger.forget(p, "url", [p.agg(F.regexp_extract(F.min("url"), "^https?://[^/]+", 0)).first()[0] or ""]).select("page_id")


@query("tenant_rows", "select c_custkey as id, c_nationkey as tenant from customer where c_nationkey = 7")
def tenant_rows(s, d):
    return V.table(s, d, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("tenant"))


@query("tenant_dropped", "select o_orderkey as id from orders where o_custkey not in (select c_custkey from customer where c_nationkey = 7)")
def tenant_dropped(s, d):
    gone = V.table(s, d, "customer").where("c_nationkey = 7").select("c_custkey")
    o = V.table(s, d, "orders")
    return o.join(gone, o.o_custkey == gone.c_custkey, "left_anti").select(F.col("o_orderkey").alias("id"))


@query("answer_memory", "select substr(sha256(lower(trim(event_type || ' ' || user_id % 50))), 1, 16) as question_id, max(event_id) as at, arg_max(value, event_id) as answer from events group by 1")
def answer_memory(s, d):
    e = V.table(s, d, "events").select(F.concat_ws(" ", F.upper("event_type"), F.col("user_id") % 50).alias("question"), F.col("event_id").alias("at"), F.col("value").alias("answer"))
    return ledger.latest_answers(e)


_ASKED = """ask as (select id as q, name as symbol, case id % 5 when 0 then 'callers' when 1 then 'callees' when 2 then 'tests_for' when 3 then 'is_tested' else 'none' end as kind from n where id <= 60)"""


@query("exact_answers", f"""with {EDGES}, {_ASKED} select q, kind, symbol, e.s::varchar as answer from ask join e on e.o = q where kind = 'callers' union all select q, kind, symbol, e.o::varchar from ask join e on e.s = q where kind = 'callees'
union all select q, kind, symbol, t.o::varchar from ask join t on t.s = q where kind = 'tests_for' union all select q, kind, symbol, (q in (select s from t))::varchar from ask where kind = 'is_tested'""")
def exact_answers(s, d):
    n = V.nodes(s, d)
    form = F.when(F.col("id") % 5 == 0, F.concat(F.lit("Who calls "), "name", F.lit(" here?"))).when(F.col("id") % 5 == 1, F.concat(F.lit("what does "), "name", F.lit(" call")))
    form = form.when(F.col("id") % 5 == 2, F.concat(F.lit("tests for "), "name")).when(F.col("id") % 5 == 3, F.concat(F.lit("Is "), "name", F.lit(" tested"))).otherwise(F.concat(F.lit("why does it matter who calls "), "name"))
    return ledger.exact_answers(n.where("id <= 60").select(F.col("id").alias("q"), form.alias("question")), n, V.edges(s, d), V.tests(s, d))


@query("resolved_references", "with r as (select l_orderkey as ref, p_type as name from lineitem join part on p_partkey = l_partkey where l_linenumber = 1), k as (select p_type as name, count(*) as k from part group by 1) select ref, p_partkey as id, case when k = 1 then 0.9 else 0.6 end::double as confidence from r join k using (name) join part on p_type = name")
def resolved_references(s, d):
    p = V.table(s, d, "part")
    r = V.table(s, d, "lineitem").where("l_linenumber = 1").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("ref"), F.col("p_type").alias("name"))
    return ledger.resolve_references(r, p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name")))


_IP = "(event_id * 7919 % 260) || '.' || (event_id % 256) || '.' || (user_id % 256) || '.1'"


@query("address_classes", f"""with x as (select event_id, string_split({_IP}, '.')::bigint[] as p from events), y as (select event_id, p[1] as a, p[1] * 16777216 + p[2] * 65536 + p[3] * 256 + p[4] as n from x)
select event_id, case when a > 255 then 'invalid' {" ".join(f"when n between {ledger.number_of(lo)} and {ledger.number_of(hi)} then '{k}'" for k, lo, hi in ledger.BLOCKED)} else 'public' end as class from y""")
def address_classes(s, d):
    ip = F.concat_ws(".", F.col("event_id") * 7919 % 260, F.col("event_id") % 256, F.col("user_id") % 256, F.lit(1))
    return V.table(s, d, "events").select("event_id", ledger.address_class(ip).alias("class"))


@query("over_rate", "select user_id as principal, date_trunc('minute', ts) as minute, count(*) as n from events group by 1, 2 having count(*) > 1")
def over_rate(s, d):
    return ledger.over_rate(V.table(s, d, "events").select(F.col("user_id").alias("principal"), F.col("ts").alias("at")), 1)


# ------------------------------------------------------------- scalar functions


@query("path_parts", """with x as (select page_id, regexp_replace(url, '^https?://', '') as path from pages)
select page_id, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '(root)' end as component, replace(regexp_replace(path, '[.][A-Za-z0-9]+$', ''), '/', '.') as dotted from x""")
def path_parts(s, d):
    path = F.regexp_replace("url", "^https?://", "")
    return V.table(s, d, "pages").select("page_id", T.path_component(path).alias("component"), T.dotted_form(path).alias("dotted"))


@query("query_identifiers", r"""select event_id, 'user.name_' || (user_id % 9) || ',parseValue,' || event_type || '_x' as identifiers from events""")
def query_identifiers(s, d):
    q = F.concat(F.lit("how is user.name_"), F.col("user_id") % 9, F.lit(" set by parseValue and PARSEVALUE or "), F.col("event_type"), F.lit("_x in plain words"))
    return V.table(s, d, "events").select("event_id", F.array_join(T.query_identifiers(q), ",").alias("identifiers"))


@query("symbol_headers", f"with {EDGES} select id, 'path: ' || path || chr(10) || 'name: ' || name || chr(10) || 'kind: ' || language || chr(10) || lines as text, greatest(lines - id % 40 + 1, 0)::bigint as span from n")
def symbol_headers(s, d):
    n = V.nodes(s, d)
    return n.select("id", T.enriched(F.col("lines").cast("string"), path=F.col("path"), name=F.col("name"), kind=F.col("language")).alias("text"), T.line_count(F.col("id") % 40, F.col("lines")).alias("span"))


@query("token_costs", "select p_partkey as id, round(p_size * 1000 * case p_partkey % 3 when 0 then 0.25 when 1 then 3.0 else 15.0 end / 1e6, 6)::double as usd from part")
def token_costs(s, d):
    tier = F.when(F.col("p_partkey") % 3 == 0, "small").when(F.col("p_partkey") % 3 == 1, "medium").otherwise("large")
    return V.table(s, d, "part").select(F.col("p_partkey").alias("id"), T.cost_usd(F.col("p_size") * 1000, tier).alias("usd"))


@query("shingle_cosines", """with w as (select item_id as id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') as ws from benchmark),
g as (select id, list_aggregate(ws[i:i+2], 'string_agg', ' ') as g, count(*) as n from (select id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) as i from w where len(ws) > 0) group by all),
nm as (select id, sqrt(sum(n * n)) as norm from g group by id), first as (select min(id) as id from w),
dt as (select b.id, sum(a.n * b.n) as dot from g a join first on a.id = first.id join g b on a.g = b.g group by 1)
select w.id, round(coalesce(dot, 0) / (x.norm * y.norm), 6)::double as score from w join nm x on x.id = w.id left join dt on dt.id = w.id, first join nm y on y.id = first.id""")
def shingle_cosines(s, d):
    b = V.table(s, d, "benchmark").select(F.col("item_id").alias("id"), T.shingles(T.tokens(F.col("text")), 3).alias("g"))
    one = b.orderBy("id").limit(1).select(F.col("g").alias("h"))
    return b.join(F.broadcast(one)).select("id", F.round(T.cosine_counts(F.col("g"), F.col("h")), 6).alias("score"))


@query("metadata_paths", """select doc_id, json_extract_string('{"path": "' || source || '", "lines": [1, ' || doc_id || ']}', '$.path') as path, json_extract_string('{"path": "' || source || '", "lines": [1, ' || doc_id || ']}', '$.lines[1]')::bigint as last from documents""")
def metadata_paths(s, d):
    j = F.to_json(F.struct(F.col("source").alias("path"), F.array(F.lit(1).cast("long"), F.col("doc_id")).alias("lines")))
    return V.table(s, d, "documents").select("doc_id", F.get_json_object(j, "$.path").alias("path"), F.get_json_object(j, "$.lines[1]").cast("long").alias("last"))


# ------------------------------------------------------------------- exports


@query("export_markdown", f"""with {LEDGER} select 'claim' as part, '| ' || coalesce(display, subject_id, '(none)') || ' | ' || predicate || ' | ' || object || ' |' as line from said left join enty on entity_id = subject_id
union all select 'entity', '| ' || kind || ' | ' || canonical || ' | ' || display || ' |' from enty""")
def export_markdown(s, d):
    x = the_ledger(s, d)
    return export.markdown_rows(x.entities, ledger.claim_report(x).withColumn("object", F.lower("object")))


@query("export_vault", f"with {LEDGER} select kind || '/' || regexp_replace(canonical, '[^a-z0-9]+', '-', 'g') || '-' || substr(entity_id, 5, 6) || '.md' as path, '# ' || display || chr(10) || string_agg('- ' || chunk_id, chr(10) order by chunk_id) as note from enty join (select distinct chunk_id, entity_id from found) using (entity_id) group by kind, canonical, entity_id, display")
def export_vault(s, d):
    x = the_ledger(s, d)
    return export.vault(x.entities, x.mentions)


@query("wiki_pages", f"with {EDGES} select path as page, count(*) as symbols, sha256(string_agg(name, chr(10) order by id)) as digest from n group by 1")
def wiki_pages(s, d):
    return export.wiki(V.nodes(s, d)).select("page", "symbols", "digest")


@query("backup_manifest", "select 'region' as name, count(*) as n, sha256(string_agg(r_regionkey || '|' || r_name, chr(10) order by r_regionkey || '|' || r_name)) as digest from region union all select 'nation', count(*), sha256(string_agg(n_nationkey || '|' || n_name, chr(10) order by n_nationkey || '|' || n_name)) from nation")
def backup_manifest(s, d):
    return export.manifest({"region": V.table(s, d, "region").select("r_regionkey", "r_name"), "nation": V.table(s, d, "nation").select("n_nationkey", "n_name")})
