"""Sinks: graphs as Cypher, DOT and GraphML lines, tables as JSON and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(c: Column) -> Column:
    """For Cypher strings."""
    return F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): a MERGE for every node (id, name, path) and edge (s, o, w)."""
    n = nodes.select(F.concat(F.lit("MERGE (n:Entity {id: '"), quoted(F.col("id")), F.lit("'}) SET n.name = '"), quoted(F.col("name")), F.lit("';")).alias("line"))
    e = edges.select(F.concat(F.lit("MATCH (a:Entity {id: '"), quoted(F.col("s")), F.lit("'}), (b:Entity {id: '"), quoted(F.col("o")), F.lit("'}) MERGE (a)-[:CALLS]->(b);")).alias("line"))
    return n.unionAll(e)


def dot(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat(F.lit('  "'), F.col("s").cast("string"), F.lit('" -> "'), F.col("o").cast("string"), F.lit('";')).alias("line"))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select(F.concat(F.lit('<node id="'), xml(F.col("id").cast("string")), F.lit('"><data key="name">'), xml(F.col("name")), F.lit("</data></node>")).alias("line"))
    return n.unionAll(edges.select(F.concat(F.lit('<edge source="'), F.col("s").cast("string"), F.lit('" target="'), F.col("o").cast("string"), F.lit('"/>')).alias("line")))


def write_tables(tables: dict[str, DataFrame], path: str, kind: str = "json") -> None:
    """Each table to path/name as JSON, CSV or Parquet, distributed."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.option("header", "true") if kind == "csv" else w).format(kind).save(f"{path}/{name}")


def markdown_rows(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """(part, line): the table rows of a report on entities (kind, canonical, display) and claims (subject, predicate, object)."""
    row = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *c), F.lit(" |")).alias("line")
    return claims.select(F.lit("claim").alias("part"), row("subject", "predicate", "object")).unionAll(entities.select(F.lit("entity"), row("kind", "canonical", "display")))


def vault(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(path, note): a note for each entity with the chunks that mention it."""
    name = F.concat_ws("-", F.regexp_replace("canonical", "[^a-z0-9]+", "-"), F.substring("entity_id", 5, 6))
    m = entities.join(mentions, "entity_id").groupBy("kind", "canonical", "entity_id", "display").agg(F.array_sort(F.collect_set("chunk_id")).alias("c"))
    note = F.concat(F.lit("# "), "display", F.lit("\n- "), F.array_join("c", "\n- "))
    return m.select(F.concat(F.col("kind"), F.lit("/"), name, F.lit(".md")).alias("path"), note.alias("note"))


def wiki(nodes: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(page, symbols, digest, rewrite): a page for each path with its symbols' names; rewrite unless before (page, digest) has the same digest."""
    p = nodes.groupBy(F.col("path").alias("page")).agg(F.count("*").alias("symbols"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "name"))), lambda x: x["name"]), "\n"), 256).alias("digest"))
    if before is None:
        return p.withColumn("rewrite", F.lit(True))
    old = before.select("page", F.col("digest").alias("old"))
    return p.join(old, "page", "left").withColumn("rewrite", ~F.coalesce(F.col("old") == F.col("digest"), F.lit(False))).drop("old")


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n, digest): rows and the SHA-256 of the sorted rows of small tables, for a backup to be checked by."""
    out = None
    for name, df in tables.items():
        rows = df.select(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("r"))
        one = rows.agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("r")), "\n"), 256).alias("digest")).select(F.lit(name).alias("name"), "n", "digest")
        out = one if out is None else out.unionAll(one)
    return out
