"""From documents to chunks, entities, claims and co-occurrence edges."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import text as T

MAX_CHARS = 4096
BLOCK_CHARS = 4000
SENTENCE_CHARS = 400

# Entity patterns. ASCII letters only; other letters count as word characters.
URL = r"\bhttps?://[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%\-]+"
VERSION = r"\bv?\d+\.\d+(?:\.\d+)?(?:[-.][A-Za-z0-9]+)?\b"
ORG = r"\b([A-Z][A-Za-z0-9&\- ]+ (?:Inc\.?|LLC|Ltd\.?|Corp\.?|Corporation|Foundation|Labs|Institute|Company|Co\.))"
PERSON = r"\b[A-Z][a-z]{1,20}(?:\s+[A-Z][a-z]{1,20}){1,2}\b"
STOP_TITLES = ["The", "And", "But", "For", "Or", "Not", "With", "This", "That", "These", "Those", "From", "Into", "About", "Also", "Note", "See", "Only"]

# Claim predicates and the verbs that state them, in order of trial.
VERBS = [
    ("is", "is"), ("are", "are"), ("was", "was"), ("were", "were"), ("reports", "reports?"), ("provides", "provides?"), ("supports", "supports?"),
    ("requires", "requires?"), ("has", "has"), ("uses", "uses?"), ("retains", "retains?"), ("stores", "stores?"), ("allows", "allows?"), ("returns", "returns?"),
]
_SUBJECT = r"^([A-Z][A-Za-z0-9 .,'-]{2,80})\s+"
CLAIMS = [(n, rf"{_SUBJECT}{v}\s+([a-zA-Z0-9][^.!?]{{2,200}})[.!?]?$") for n, v in VERBS]
CLAIMS.append(("count", rf"{_SUBJECT}(?:contains?|includes?|has)\s+(\d[\d,\.]{{0,20}}\s+[a-zA-Z][^.!?]{{0,120}})[.!?]?$"))


def chunks(docs: DataFrame, per_chunk: int = 4, max_chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, ord, text, start, end) of docs (doc_id, text): up to four paragraphs a chunk, long paragraphs sliced.

    A document of one paragraph takes built-in functions only; others are packed per batch.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("single", ~F.col("text").rlike(r"\n\s*\n"))
    one = d.where("single").select("doc_id", F.length("text").alias("size"), T.squeeze(F.col("text")).alias("p")).where("p <> ''")
    slices = F.transform(
        F.sequence(F.lit(0), F.length("p") - 1, F.lit(max_chars)),
        lambda i: F.struct((i / max_chars).cast("long").alias("ord"), F.substr("p", i + 1, F.lit(max_chars)).alias("text"), i.cast("long").alias("start")),
    )
    one = one.select("doc_id", "size", F.length("p").alias("n"), F.explode(slices).alias("c"))
    end = F.when(F.col("n") > max_chars, F.col("c.start") + F.length("c.text")).otherwise(F.col("size"))
    one = one.select("doc_id", "c.ord", "c.text", "c.start", end.cast("long").alias("end"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    many = d.where("not single").select("doc_id", "text").mapInArrow(_packer(per_chunk, max_chars), f"doc_id {kind}, ord long, text string, start long, end long")
    return one.unionByName(many)


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _bounds(sizes: np.ndarray, per_chunk: int, max_chars: int) -> list[int]:
    """Where chunks begin among paragraphs of these sizes, and their number at the end.

    For every paragraph we know at once where a chunk from it would stop: after
    per_chunk paragraphs, after the one that fills max_chars, or before the next
    oversized one, which is a chunk by itself. Chunks follow these jumps.
    """
    n = len(sizes)
    total = np.append(0, np.cumsum(sizes))
    over = np.flatnonzero(sizes > max_chars)
    ahead = np.append(over, n)[np.searchsorted(over, np.arange(n))]
    full = np.searchsorted(total, total[:-1] + max_chars)
    stop = np.minimum.reduce([np.arange(n) + per_chunk, np.maximum(full, np.arange(n) + 1), ahead, np.full(n, n)])
    stop[over] = over + 1
    out = [0]
    while out[-1] < n:
        out.append(int(stop[out[-1]]))
    return out


def _packer(per_chunk: int, max_chars: int):
    def pieces(text: str) -> Iterator[tuple[str, int, int]]:
        breaks = [m.span() for m in re.finditer(r"\n\s*\n+", text)]
        spans = zip([0, *(e for _, e in breaks)], [*(b for b, _ in breaks), len(text)], strict=True)
        kept = [(p, b, e) for b, e in spans if (p := re.sub(r"[ \t\f\v]+", " ", text[b:e]).strip())]
        edges = _bounds(np.array([len(p) for p, _, _ in kept], np.int64), per_chunk, max_chars)
        for i, j in zip(edges, edges[1:], strict=False):
            body, begin = "\n\n".join(p for p, _, _ in kept[i:j]), kept[i][1]
            if j == i + 1 and len(body) > max_chars:
                yield from ((body[k : k + max_chars], begin + k, begin + min(k + max_chars, len(body))) for k in range(0, len(body), max_chars))
            else:
                yield body, begin, kept[j - 1][2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, n, *c) for d, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for n, c in enumerate(pieces(t))]
            yield _batch(rows, [b.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64()], ["doc_id", "ord", "text", "start", "end"])

    return run


# what no word may touch on the left and right: letters and digits of any script
_LEFT, _RIGHT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def bounded(pattern: str) -> str:
    """The pattern with its word boundaries spelt out for all scripts."""
    out = _LEFT + pattern.removeprefix(r"\b")
    return out.removesuffix(r"\b") + _RIGHT if out.endswith(r"\b") else out


def entities(chunked: DataFrame) -> DataFrame:
    """(doc_id, ord, kind, canonical, display): each entity once per chunk."""
    t = F.col("text")
    trimmed = lambda a, p: F.transform(a, lambda x: F.regexp_replace(x, p, ""))
    every = lambda p, g=0: F.regexp_extract_all(t, F.lit(bounded(p)), F.lit(g))
    people = F.filter(every(PERSON), lambda x: ~x.rlike("^(" + "|".join(STOP_TITLES) + r") "))
    found = [("url", trimmed(every(URL), r"[.,);\]]+$")), ("organisation", every(ORG, 1)), ("person", people), ("version", every(VERSION))]
    named = lambda k, a: F.transform(a, lambda x: F.struct(F.lit(k).alias("kind"), F.trim(x).alias("display")))
    rows = F.flatten(F.array(*[named(k, a) for k, a in found]))
    e = chunked.select("doc_id", "ord", F.explode(rows).alias("e")).select("doc_id", "ord", "e.kind", "e.display")
    canonical = F.when(F.col("kind") == "organisation", F.lower(F.regexp_replace(F.regexp_replace("display", r"\s+", " "), r"\.+$", ""))).otherwise(F.lower("display"))
    return e.withColumn("canonical", canonical).groupBy("doc_id", "ord", "kind", "canonical").agg(F.min("display").alias("display"))


# What ends or begins a block of prose, as lines; each goes for an end of block.
_END = "\u0001"
_BLOCKS = [
    (r"(?ms)^ {0,3}(?:```|~~~)[^\n]*(?:\n.*?(?:^ {0,3}(?:```|~~~)[^\n]*|\z)|\z)", _END),  # fenced code
    (r"(?m)^ {0,3}>+[ \t]?", ""),  # quotes
    (r"(?m)^ {0,3}(?:=+|-{2,}|\*{3,}|_{3,})[ \t]*$", _END),  # rules and underlines
    (r"(?m)^ {0,3}#{1,6}[ \t]+([^\n]*)$", _END + "$1\u0002"),  # headings
    (r"(?m)^ {0,3}(?:[-*+]|\d{1,3}[.)])[ \t]+", _END),  # items
    (r"(?m)^[ \t]*$", _END),  # empty lines
    (r"\[([^\]\n]*)\]\([^)\s]*\)", "$1"),  # links
    (r"[*_`]{1,3}", ""),  # emphasis
    (r"[ #]*\x02", _END),  # what closes a heading
]


def prose_blocks(text: Column) -> Column:
    """Prose without block markers: headings and list items alone, fences dropped, wrapped lines joined, oversized blocks left out."""
    for pattern, to in _BLOCKS:
        text = F.regexp_replace(text, pattern, to)
    joined = F.transform(F.split(text, _END), lambda b: F.trim(F.regexp_replace(b, r"\s+", " ")))
    return F.filter(joined, lambda b: F.length(b).between(1, BLOCK_CHARS))


def sentences(text: Column) -> Column:
    """The sentences of a text's prose that are short enough to be read for claims."""
    parts = F.flatten(F.transform(prose_blocks(text), lambda b: F.split(b, r"(?<=[.!?])\s+(?=[A-Z])")))
    return F.filter(F.transform(parts, F.trim), lambda x: F.length(x).between(1, SENTENCE_CHARS))


def readings(sentence: Column) -> Column:
    """array<struct<key, predicate, subject, object>>: what each pattern in turn reads in a sentence."""
    strip = lambda x: F.regexp_replace(x, "^[ .,]+|[ .,]+$", "")

    def read(name: str, p: str) -> Column:
        subject, value = (strip(F.regexp_extract(sentence, p, g)) for g in (1, 2))
        key = F.concat_ws("\u0001", F.lit(name), F.lower(subject), F.lower(value))
        return F.when(sentence.rlike(p), F.struct(key.alias("key"), F.lit(name).alias("predicate"), subject.alias("subject"), value.alias("object")))

    return F.array_compact(F.array(*[read(name, p) for name, p in CLAIMS]))


def claims(chunked: DataFrame) -> DataFrame:
    """(doc_id, ord, n, predicate, subject, object, confidence): a sentence gives its first reading that its chunk has not given yet; n numbers a chunk's claims."""
    # one look at the verbs leaves few sentences for the patterns
    verb = r"^[A-Z].*\s(?:" + "|".join([v for _, v in VERBS] + ["contains?", "includes?"]) + r")\s+[a-zA-Z0-9]"
    said = F.transform(F.filter(sentences(F.col("text")), lambda x: x.rlike(verb)), readings)
    none = F.array().cast("array<struct<key:string,predicate:string,subject:string,object:string>>")

    def add(given: Column, new: Column) -> Column:
        fresh = F.filter(new, lambda r: ~F.exists(given, lambda g: g["key"] == r["key"]))
        return F.concat(given, F.slice(fresh, 1, 1))

    rows = chunked.select("doc_id", "ord", said.alias("said")).where("size(said) > 0")
    rows = rows.select("doc_id", "ord", F.posexplode(F.aggregate("said", none, add)).alias("n", "c"))
    return rows.select("doc_id", "ord", F.col("n").cast("long").alias("n"), "c.predicate", "c.subject", "c.object", F.lit(0.4).alias("confidence"))


def cooccurrence(found: DataFrame, least: int = 2, most: int = 32) -> DataFrame:
    """(a, b, chunks, first_doc): entities (kind:canonical) that share a chunk of `least` to `most` entities.

    A chunk has at most `most` entities, so the pairs of a chunk are bounded.
    """
    e = found.select("doc_id", "ord", F.concat_ws(":", "kind", "canonical").alias("e")).distinct()
    sets = e.groupBy("doc_id", "ord").agg(F.array_sort(F.collect_list("e")).alias("all")).where(f"size(all) between {least} and {most}")
    left = sets.select("doc_id", "ord", "all", F.posexplode("all").alias("i", "a"))
    pairs = left.select("doc_id", "ord", "a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("chunks"), F.min("doc_id").alias("first_doc"))


def versions(docs: DataFrame) -> DataFrame:
    """docs with version (1, 2, ... per source by doc_id) and supersedes, exact repeats within a source left out."""
    first = docs.withColumn("sha", F.sha2("text", 256)).groupBy("source", "sha").agg(F.min("doc_id").alias("doc_id"))
    w = Window.partitionBy("source").orderBy("doc_id")
    return first.select("source", "doc_id", F.row_number().over(w).cast("long").alias("version"), F.lag("doc_id").over(w).alias("supersedes"))
