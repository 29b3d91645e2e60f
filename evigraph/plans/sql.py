"""Pieces of SQL that several queries share."""

from __future__ import annotations

from evigraph.operators import ingest

CHUNKS = r"""d as (select doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[ \t\f\v]+', ' ', 'g'), '^\s+|\s+$', '', 'g') as p from documents),
ch as (select doc_id, (i // 4096)::bigint as ord, substr(p, i + 1, 4096) as text from (select doc_id, p, unnest(range(0, length(p), 4096)) as i from d))"""
EDGES = """e as (select a.l_partkey as s, b.l_partkey as o, count(*) as w from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey
 and a.l_linenumber = 1 and b.l_linenumber = 2 and a.l_partkey <> b.l_partkey group by all),
n as (select p_partkey as id, 'Part#' || p_partkey as name, p_brand as path, p_type as language, p_size::bigint as lines from part),
t as (select distinct l_partkey as s, l_suppkey as o from lineitem where l_quantity >= 49),
entry as (select distinct s as root from e where s not in (select o from e)),
deg as (select node, sum(come)::bigint as fan_in, sum(go)::bigint as fan_out, count(*) as degree from
 (select node, other, max(go) as go, max(come) as come from (select s as node, o as other, 1 as go, 0 as come from e union all select o, s, 0, 1 from e) group by all) group by node)"""
PART = "pt as (select p_partkey as node, p_brand as c from part)"
#: An edge's confidence.
SURE = "round(1 - 1.0 / (1 + w), 6)"
CHOSEN = "select path from (select distinct path from n) order by path limit 3"


def walk(direction: str, depth: int, roots: str) -> str:
    step = {"out": "e.s = r.node", "in": "e.o = r.node", "both": "(e.s = r.node or e.o = r.node)"}[direction]
    to = {"out": "e.o", "in": "e.s", "both": "case when e.s = r.node then e.o else e.s end"}[direction]
    return f"r(root, node, distance) as (select root, root, 0 from ({roots}) union select r.root, {to}, r.distance + 1 from r join e on {step} where r.distance < {depth}), b as (select root, node, min(distance)::bigint as distance from r group by all)"


_SAID = "^([A-Z][A-Za-z0-9 .,''-]{{2,80}})\\s+{v}\\s+([a-zA-Z0-9][^.!?]{{2,200}})[.!?]?$"
_VERB_SQL = " union all ".join(
    f"select doc_id, ord, x, '{n}' as predicate, {i} as k, regexp_extract(x, '{_SAID.format(v=v)}', 1) as subject, regexp_extract(x, '{_SAID.format(v=v)}', 2) as object from st where length(x) <= 400 and contains(x, '{v.rstrip('s?')}')"
    for i, (n, v) in enumerate(ingest.VERBS)
)
_CLAIMS = rf"""
ln as (select doc_id, ord, i, line, sum(case when regexp_matches(line, '^ {{0,3}}(```|~~~)') then 1 else 0 end) over (partition by doc_id, ord order by i) % 2 as fenced
 from (select doc_id, ord, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as line from (select doc_id, ord, string_split(text, chr(10)) as ls from ch))),
q as (select doc_id, ord, i, regexp_replace(line, '^ {{0,3}}>+\s?', '') as line, fenced = 1 or regexp_matches(line, '^ {{0,3}}(```|~~~)') as gone from ln),
m as (select *, gone or trim(line, ' ' || chr(9)) = '' or regexp_matches(line, '^ {{0,3}}(=+|-{{2,}}|\*{{3,}}|_{{3,}})\s*$') as blank,
 regexp_matches(line, '^ {{0,3}}#{{1,6}}\s+') as head, regexp_matches(line, '^ {{0,3}}([-*+]|[0-9]{{1,3}}[.)])\s+') as item from q),
g as (select *, sum(case when blank or head or item or coalesce(ph, false) or coalesce(pb, false) then 1 else 0 end) over (partition by doc_id, ord order by i) as b
 from (select *, lag(head) over (partition by doc_id, ord order by i) as ph, lag(blank) over (partition by doc_id, ord order by i) as pb from m)),
bl as (select doc_id, ord, b, trim(regexp_replace(string_agg(regexp_replace(regexp_replace(
  regexp_replace(line, case when head then '^ {{0,3}}#{{1,6}}\s+' when item then '^ {{0,3}}([-*+]|[0-9]{{1,3}}[.)])\s+' else '^\b$' end, ''),
  '\[([^\]]*)\]\([^)\s]*\)', '\1', 'g'), '[*_`]{{1,3}}', '', 'g'), ' ' order by i), '\s+', ' ', 'g')) as x from g where not blank group by all),
st as (select doc_id, ord, trim(unnest(string_split(regexp_replace(regexp_replace(x, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)))) as x from bl where length(x) between 1 and 4000),
c as ({_VERB_SQL}),
f as (select doc_id, ord, x, arg_min(predicate, k) as predicate, trim(arg_min(subject, k), ' .,') as subject, trim(arg_min(object, k), ' .,') as object from c where subject <> '' group by all),
claims as (select distinct doc_id, ord, predicate, lower(subject) as subject, lower(object) as object from f)"""
CLAIMS = f"{CHUNKS},{_CLAIMS}"
_ENTITIES = rf"""pl as (select doc_id, ord, regexp_replace(regexp_replace(text, '[^\x00-\x7F\pP\pS\pZ\pC]', '_', 'g'), '[^\x00-\x7F]', chr(1), 'g') as text from ch),
ur as (select doc_id, ord, regexp_replace(text, '[\pL\pN_](https?://)', '_\1', 'g') as text from ch),
raw as (select doc_id, ord, 'person' as kind, unnest(regexp_extract_all(text, '{ingest.PERSON}')) as x from pl
 union all select doc_id, ord, 'version', unnest(regexp_extract_all(text, '{ingest.VERSION}')) from pl
 union all select doc_id, ord, 'organisation', unnest(regexp_extract_all(text, '{ingest.ORG}', 1)) from pl
 union all select doc_id, ord, 'url', regexp_replace(unnest(regexp_extract_all(text, '{ingest.URL.replace("'", "''")}')), '[.,);\]]+$', '') from ur),
ent as (select distinct doc_id, ord, kind, case kind when 'organisation' then regexp_replace(lower(regexp_replace(trim(x), '\s+', ' ', 'g')), '\.+$', '') else lower(trim(x)) end as canonical from raw
 where kind <> 'person' or not regexp_matches(x, '^({"|".join(ingest.STOP_TITLES)}) '))"""
ENTITIES = f"{CHUNKS}, {_ENTITIES}"


def content_id(prefix: str, *parts: str) -> str:
    return f"'{prefix}_' || substr(sha256(" + " || ".join(f"({p})::varchar || chr(31)" for p in parts) + "), 1, 24)"


#: The tables of the ledger: known (documents), ck (chunks), found (mentions with names), enty, said (claims).
LEDGER = rf"""k0 as (select coalesce(source, '') as source, sha256(coalesce(text, '')) as sha, min(doc_id) as doc_id, any_value(coalesce(text, '')) as text from documents group by 1, 2),
k1 as (select *, {content_id('src', "'text'", 'source')} as source_id from k0), known as (select *, {content_id('doc', 'source_id', 'sha')} as document_id from k1),
kp as (select document_id, regexp_replace(regexp_replace(text, '[ \t\f\v]+', ' ', 'g'), '^\s+|\s+$', '', 'g') as p from known),
kc as (select document_id, (i // 4096)::bigint as ord, substr(p, i + 1, 4096) as text from (select document_id, p, unnest(range(0, length(p), 4096)) as i from kp)),
ck as (select *, {content_id('chk', 'document_id', 'ord')} as chunk_id from kc), ch as (select chunk_id as doc_id, ord, text from ck),
{_ENTITIES}, found as (select doc_id as chunk_id, kind, canonical, {content_id('ent', 'kind', 'canonical')} as entity_id from ent),
names as (select kind, case kind when 'organisation' then regexp_replace(lower(regexp_replace(trim(x), '\s+', ' ', 'g')), '\.+$', '') else lower(trim(x)) end as canonical, min(trim(x)) as display from raw group by 1, 2),
enty as (select distinct entity_id, kind, canonical, display from found join names using (kind, canonical)),
{_CLAIMS}, nm as (select chunk_id, canonical, min(entity_id) as subject_id from found group by 1, 2),
said as (select {content_id('clm', 'claims.doc_id', 'predicate', 'subject', 'object')} as claim_id, claims.doc_id as chunk_id, subject_id, subject, predicate, object from claims left join nm on nm.chunk_id = claims.doc_id and nm.canonical = subject),
cit as (select {content_id('cit', 'claim_id', 'chunk_id')} as citation_id, claim_id, chunk_id from said)"""
