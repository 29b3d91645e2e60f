"""The evidence ledger: documents ingested into tables that refer to each other, and what is read from them.

All tables are DataFrames keyed by content ids, so ingesting the same rows again
gives the same rows, and keeping new ones is an anti join. Tables: sources,
documents, chunks, entities, mentions, claims, citations, provenance.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.operators import evidence, ingest
from evigraph.session import settle


@dataclass(frozen=True)
class Ledger:
    sources: DataFrame
    documents: DataFrame
    chunks: DataFrame
    entities: DataFrame
    mentions: DataFrame
    claims: DataFrame
    citations: DataFrame
    provenance: DataFrame


def ingest_documents(docs: DataFrame, kind: str = "text") -> Ledger:
    """docs (doc_id, text, source) as a ledger; texts repeated within a source are one document, the first by doc_id.

    A claim's subject is the entity of its chunk whose canonical name it is, if there is one.
    """
    d = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text")).withColumn("sha256", F.sha2("text", 256))
    first = d.groupBy("source", "sha256").agg(F.min(F.struct("doc_id", "text")).alias("x")).select("source", "sha256", "x.doc_id", "x.text")
    known = first.withColumn("source_id", T.content_id("src", F.lit(kind), F.col("source"))).withColumn("document_id", T.content_id("doc", F.col("source_id"), F.col("sha256")))
    sources = known.select("source_id", F.col("source").alias("uri"), F.lit(kind).alias("kind")).distinct()
    documents = known.select("document_id", "source_id", "doc_id", "sha256", F.octet_length("text").cast("long").alias("bytes"))
    cut = ingest.chunks(known.select(F.col("document_id").alias("doc_id"), "text")).withColumnRenamed("doc_id", "document_id")
    chunks = cut.withColumn("chunk_id", T.content_id("chk", F.col("document_id"), F.col("ord").cast("string")))
    found = ingest.entities(chunks.select(F.col("chunk_id").alias("doc_id"), "ord", "text"))
    found = found.select(F.col("doc_id").alias("chunk_id"), "kind", "canonical", "display").withColumn("entity_id", T.content_id("ent", F.col("kind"), F.col("canonical")))
    entities = found.groupBy("entity_id", "kind", "canonical").agg(F.min("display").alias("display"))
    mentions = found.select("chunk_id", "entity_id").distinct()
    said = ingest.claims(chunks.select(F.col("chunk_id").alias("doc_id"), "ord", "text")).withColumnRenamed("doc_id", "chunk_id")
    named = found.groupBy("chunk_id", F.col("canonical").alias("low")).agg(F.min("entity_id").alias("subject_id"))
    said = said.withColumn("low", F.lower("subject")).join(named, ["chunk_id", "low"], "left")
    claims = said.select(T.content_id("clm", F.col("chunk_id"), F.col("predicate"), F.col("low"), F.lower("object")).alias("claim_id"), "chunk_id", "subject_id", "subject", "predicate", "object", "confidence")
    citations = claims.select(T.content_id("cit", F.col("claim_id"), F.col("chunk_id")).alias("citation_id"), F.lit("claim").alias("target_kind"), F.col("claim_id").alias("target_id"), "chunk_id")
    provenance = documents.select(F.lit("document").alias("target_kind"), F.col("document_id").alias("target_id"), F.lit("ingest").alias("activity"), "source_id")
    return Ledger(sources, documents, chunks, entities, mentions, claims, citations, provenance)


def add_new(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with the rows whose key it does not hold yet; of rows that share a key one is kept."""
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti"))


def upsert(table: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """table with its rows replaced by those of rows with the same key; the largest `order` of a key wins, rows before the table's own at the same."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    value = F.struct(order, "_new", *[c for c in table.columns if c not in (key, order)])
    return both.groupBy(key).agg(F.max(value).alias("v")).select(*[key if c == key else F.col(f"v.{c}").alias(c) for c in table.columns])


def merge_duplicates(entities: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, mentions) with entities (id, name) of one canonical name as the one with the smallest id, and mentions (id, at) rewritten."""
    low = entities.groupBy(T.canonical_name(F.col("name")).alias("key")).agg(F.min("id").alias("keep"))
    to = entities.withColumn("key", T.canonical_name(F.col("name"))).join(low, "key").select("id", "keep")
    return entities.join(to.where("id = keep").select("id"), "id", "left_semi"), mentions.join(to, "id").select(F.col("keep").alias("id"), "at").distinct()


def resolution_groups(names: DataFrame) -> DataFrame:
    """(key, names): different spellings (name) of one canonical name."""
    return names.groupBy(T.canonical_name(F.col("name")).alias("key")).agg(F.array_sort(F.collect_set("name")).alias("names")).where("size(names) > 1")


def chunks_of_entity(ledger: Ledger, kind: str) -> DataFrame:
    """(chunk_id) that mention an entity of the kind: a semi join."""
    those = ledger.mentions.join(ledger.entities.where(F.col("kind") == kind), "entity_id", "left_semi")
    return ledger.chunks.join(those, "chunk_id", "left_semi").select("chunk_id")


def source_facet(ledger: Ledger) -> DataFrame:
    """(uri, documents, chunks): chunks and documents by source."""
    c = ledger.chunks.groupBy("document_id").agg(F.count("*").alias("k"))
    x = ledger.documents.join(c, "document_id", "left").join(ledger.sources, "source_id")
    return x.groupBy("uri").agg(F.count("*").alias("documents"), F.coalesce(F.sum("k"), F.lit(0)).alias("chunks"))


def claim_report(ledger: Ledger) -> DataFrame:
    """(claim_id, subject, predicate, object): a claim's subject by its entity's name, else its own id, else (none)."""
    e = ledger.entities.select(F.col("entity_id").alias("subject_id"), "display")
    return ledger.claims.drop("subject").join(e, "subject_id", "left").select("claim_id", F.coalesce("display", "subject_id", F.lit("(none)")).alias("subject"), "predicate", "object")


def claim_evidence(ledger: Ledger, claims: DataFrame | None = None) -> DataFrame:
    """(claim_id, chunk_id, document_id, text_sha256, citations, activities) of claims (claim_id), of all by default."""
    c = ledger.claims.join(claims.select("claim_id").distinct(), "claim_id", "left_semi") if claims is not None else ledger.claims
    cited = ledger.citations.groupBy(F.col("target_id").alias("claim_id")).agg(F.array_join(F.array_sort(F.collect_list("citation_id")), ",").alias("citations"))
    came = ledger.provenance.groupBy(F.col("target_id").alias("document_id")).agg(F.array_join(F.array_sort(F.collect_list("activity")), ",").alias("activities"))
    x = c.join(ledger.chunks.select("chunk_id", "document_id", "text"), "chunk_id").join(cited, "claim_id", "left").join(came, "document_id", "left")
    return x.select("claim_id", "chunk_id", "document_id", F.sha2("text", 256).alias("text_sha256"), "citations", "activities")


def answer_packet(ledger: Ledger, hits: DataFrame) -> DataFrame:
    """(chunk_id, document_id, citations) of the chunks hit (chunk_id); citations as a comma list."""
    c = ledger.citations.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_list("citation_id")), ",").alias("citations"))
    return ledger.chunks.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi").join(c, "chunk_id", "left").select("chunk_id", "document_id", F.coalesce("citations", F.lit("")).alias("citations"))


def validated(claims: DataFrame, relations: DataFrame, quality: float = 0.5) -> DataFrame:
    """(claim, supporting, contradicting, score) of claims (claim, subject, days) by relations (subject, support)."""
    r = relations.groupBy("subject").agg(F.count_if(F.col("support") == "supports").alias("supporting"), F.count_if(F.col("support") == "contradicts").alias("contradicting"))
    x = claims.join(r, "subject", "left").na.fill(0, ["supporting", "contradicting"])
    score = evidence.confidence(F.lit(quality), F.col("supporting"), F.col("contradicting"), F.col("days"))
    return x.select("claim", "supporting", "contradicting", F.round(score, 6).alias("score"))


def scan(claims: DataFrame, threshold: float = 0.5, budget: int = 2_000_000) -> DataFrame:
    """(route, subject, a, b, score, truncated): contradictions of one subject, then of paraphrases, by subject and objects.

    Groups of one predicate and subject are compared in their order as long as
    the pairs of all groups up to there stay in the budget; truncated tells, in
    every row, whether some were not.
    """
    c = settle(claims.select("predicate", F.lower("subject").alias("subject"), F.lower("object").alias("object")).distinct())
    size = c.groupBy("predicate", "subject").agg(F.count("*").alias("n")).where("n > 1").withColumn("pairs", F.expr("n * (n - 1) div 2"))
    # smaller groups first: their number is counted by size before sizes are put in order
    by = size.groupBy("pairs").agg(F.sum("pairs").alias("t"))
    fits = by.withColumn("upto", F.sum("t").over(Window.orderBy("pairs"))).where(F.col("upto") <= budget).agg(F.max("pairs").alias("most"))
    cut = size.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("all")).join(F.broadcast(fits)).select("most", (F.col("all") > budget).alias("truncated"))
    own = size.join(F.broadcast(cut)).where("pairs <= most").select("predicate", "subject", "truncated")
    same = evidence.same_subject(c.join(own, ["predicate", "subject"], "left_semi"), threshold).select(F.lit("same_subject").alias("route"), "subject", "a", "b", "score")
    other = evidence.paraphrases(c, threshold).select(F.lit("paraphrase"), F.concat_ws(" | ", "a_subject", "b_subject"), "a_object", "b_object", "score")
    return same.unionAll(other).join(F.broadcast(cut.select("truncated")))


def forget(table: DataFrame, column: str, prefixes: list[str], dry_run: bool = False) -> DataFrame:
    """table without the rows whose column begins with a prefix as a path; dry_run: (prefix, n), the rows that would go."""
    under = lambda p: (F.col(column) == p) | F.col(column).startswith(p.rstrip("/") + "/")
    if dry_run:
        return table.agg(*[F.count_if(under(p)).alias(f"n{i}") for i, p in enumerate(prefixes)]).select(F.explode(F.array(*[F.struct(F.lit(p).alias("prefix"), F.col(f"n{i}").alias("n")) for i, p in enumerate(prefixes)])).alias("x")).select("x.*")
    gone = F.lit(False)
    for p in prefixes:
        gone = gone | F.coalesce(under(p), F.lit(False))
    return table.where(~gone)


def latest_answers(said: DataFrame) -> DataFrame:
    """(question_id, at, answer) of said (question, at, answer): the last answer to each question, whatever its case and outer space."""
    key = F.substring(F.sha2(F.lower(F.trim("question")), 256), 1, 16)
    return said.groupBy(key.alias("question_id")).agg(F.max(F.struct("at", "answer")).alias("x")).select("question_id", "x.at", "x.answer")


# What a question of structure asks for, in order; and what asks for judgement instead.
_SYMBOL = r"([\w./:#\\-]+)"
QUESTIONS = [
    ("impact", rf"(?i)\b(?:blast[- ]radius|impact(?:ed)?(?: radius| set)?)\s+(?:of|for)\s+{_SYMBOL}"),
    ("impact", rf"(?i)\bwhat\s+(?:breaks|is\s+affected)\s+(?:if\s+)?(?:i\s+)?(?:change|modify)\s+{_SYMBOL}"),
    ("callers", rf"(?i)\b(?:who|what)\s+calls\s+{_SYMBOL}"),
    ("callers", rf"(?i)\bcallers?\s+(?:of|for)\s+{_SYMBOL}"),
    ("callees", rf"(?i)\bwhat\s+does\s+{_SYMBOL}\s+call\b"),
    ("tests_for", rf"(?i)\b(?:tests?|test coverage)\s+(?:for|of)\s+{_SYMBOL}"),
    ("is_tested", rf"(?i)\bis\s+{_SYMBOL}\s+tested\b"),
]
JUDGEMENT = r"(?i)\b(why|should|would|could|explain|justify|rationale|worth|better|best|enough|safe to|ok to|okay to|recommend|suggest|opinion|refactor|redesign|improve|review|too\s+(?:many|much|few|big|large|small))\b"


def asked(question: Column) -> Column:
    """struct<kind, symbol> of a question that the graph answers exactly, or null."""
    out = F.lit(None)
    for kind, p in reversed(QUESTIONS):
        out = F.when(question.rlike(p), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(question, p, 1).alias("symbol"))).otherwise(out)
    return F.when(~question.rlike(JUDGEMENT), out)


def exact_answers(questions: DataFrame, nodes: DataFrame, edges: DataFrame, tests: DataFrame) -> DataFrame:
    """(q, kind, symbol, answer) of questions (q, question): one row for each answer, by one step in the graph; is_tested answers true or false."""
    k = questions.withColumn("a", asked(F.col("question"))).where("a is not null").select("q", "a.kind", "a.symbol")
    k = k.join(nodes.select(F.col("name").alias("symbol"), "id"), "symbol")
    one = lambda kinds, df, x, y: k.where(F.col("kind").isin(kinds)).join(df.select(F.col(x).alias("id"), F.col(y).alias("answer")), "id").select("q", "kind", "symbol", F.col("answer").cast("string").alias("answer"))
    flag = k.where("kind = 'is_tested'").join(tests.select(F.col("s").alias("id"), F.lit(True).alias("t")).distinct(), "id", "left").select("q", "kind", "symbol", F.coalesce("t", F.lit(False)).cast("string").alias("answer"))
    return one(["callers", "impact"], edges, "o", "s").unionAll(one(["callees"], edges, "s", "o")).unionAll(one(["tests_for"], tests, "s", "o")).unionAll(flag)


# Names with more references than this are resolved in several tasks; so many symbols of a name are one row on the way.
NAME_REFS, NAME_SYMBOLS = 1024, 4096


def resolve_references(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref, id, confidence) of refs (ref, name) to symbols (id, name): 0.9 where the name is unique, 0.6 to each where it is not.

    References to a common name are dealt out, each with all its symbols as
    arrays, so no task has one name alone. The result has a row for each pair.
    """
    tasks = 8 * refs.sparkSession.sparkContext.defaultParallelism
    sure = lambda k: F.when(k == 1, 0.9).otherwise(0.6).alias("confidence")
    n = symbols.groupBy("name").agg(F.count("*").alias("k"))
    common = refs.groupBy("name").agg(F.count("*").alias("r")).where(F.col("r") > NAME_REFS)  # one for so many references at most
    common = settle(common.join(n, "name").select("name", "k", F.least(F.ceil(F.col("r") / NAME_REFS), F.lit(tasks)).cast("int").alias("turns")))
    rest = refs.join(F.broadcast(common.select("name")), "name", "left_anti").join(n, "name").join(symbols, "name").select("ref", "id", sure(F.col("k")))
    rows = symbols.join(F.broadcast(common), "name").groupBy("name", "k", "turns", F.pmod(F.xxhash64("id"), F.ceil(F.col("k") / NAME_SYMBOLS)).alias("block")).agg(F.collect_list("id").alias("ids"))
    rows = rows.select("name", "k", "ids", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn")).repartition(tasks, "name", "turn")
    dealt = refs.join(F.broadcast(common.select("name", "turns")), "name").select("ref", "name", F.pmod(F.xxhash64("ref"), F.col("turns")).cast("int").alias("turn")).repartition(tasks, "name", "turn")
    return rest.unionAll(dealt.join(rows, ["name", "turn"]).select("ref", F.explode("ids").alias("id"), sure(F.col("k"))))


# Address ranges that a fetch may not reach, as first and last numbers.
BLOCKED = [
    ("unspecified", "0.0.0.0", "0.255.255.255"), ("private", "10.0.0.0", "10.255.255.255"), ("shared", "100.64.0.0", "100.127.255.255"),
    ("loopback", "127.0.0.0", "127.255.255.255"), ("link_local", "169.254.0.0", "169.254.255.255"), ("private", "172.16.0.0", "172.31.255.255"),
    ("private", "192.168.0.0", "192.168.255.255"), ("multicast", "224.0.0.0", "239.255.255.255"), ("reserved", "240.0.0.0", "255.255.255.255"),
]


def number_of(ip: str) -> int:
    return sum(int(x) << (24 - 8 * i) for i, x in enumerate(ip.split(".")))


def address_class(ip: Column) -> Column:
    """The range that a dotted IPv4 address lies in, `public`, or `invalid`."""
    part = lambda i: F.split(ip, r"\.")[i].cast("long")
    n = part(0) * 2**24 + part(1) * 2**16 + part(2) * 2**8 + part(3)
    out = F.lit("public")
    for name, lo, hi in BLOCKED:
        out = F.when(n.between(number_of(lo), number_of(hi)), name).otherwise(out)
    sound = ip.rlike(r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$")
    return F.when(F.coalesce(sound, F.lit(False)), out).otherwise("invalid")


def over_rate(calls: DataFrame, limit: int) -> DataFrame:
    """(principal, minute, n) of calls (principal, at): minutes with more than `limit` calls."""
    m = calls.groupBy("principal", F.date_trunc("minute", F.col("at")).alias("minute")).agg(F.count("*").alias("n"))
    return m.where(F.col("n") > limit)
