"""Readers of files as (path, format, text): text, JSON, CSV, HTML, DOCX, subtitles, feeds."""

from __future__ import annotations

import csv
import html
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Formats by extension.
FORMATS = {"md": "markdown", "markdown": "markdown", "txt": "text", "json": "json", "csv": "csv", "tsv": "csv", "html": "html", "htm": "html", "docx": "docx", "srt": "subtitles", "vtt": "subtitles", "rss": "feed", "atom": "feed", "xml": "feed", "py": "code", "js": "code", "ts": "code", "go": "code", "java": "code", "rs": "code", "c": "code", "cpp": "code"}


def sniff(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv]), ext), F.lit("text"))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in ("script", "style", "noscript")

    def handle_endtag(self, tag: str) -> None:
        self.skip = max(0, self.skip - (tag in ("script", "style", "noscript")))

    def handle_data(self, data: str) -> None:
        if not self.skip and data.strip():
            self.parts.append(" ".join(data.split()))


def read_html(raw: str) -> str:
    p = _Text()
    p.feed(raw)
    p.close()
    return "\n".join(p.parts)


def read_docx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    return "\n\n".join(t for p in root.iter(f"{ns}p") if (t := "".join(x.text or "" for x in p.iter(f"{ns}t")).strip()))


def _seconds(stamp: str) -> float:
    out = 0.0
    for part in stamp.replace(",", ".").split(":"):
        out = out * 60 + float(part)
    return round(out, 3)


def read_cues(raw: str) -> list[tuple[float, float, str]]:
    """(start, end, text) of SRT or WebVTT."""
    out = []
    for block in re.split(r"\n\s*\n", raw.replace("\r\n", "\n").lstrip("﻿")):
        lines = block.strip().split("\n")
        for i, line in enumerate(lines):
            m = re.match(r"\s*([\d:.,]+)\s*-->\s*([\d:.,]+)", line)
            if m:
                text = re.sub(r"<[^>]+>", "", " ".join(x.strip() for x in lines[i + 1 :])).strip()
                if text:
                    out.append((_seconds(m[1]), _seconds(m[2]), text))
                break
    return out


def read_feed(raw: str, most: int = 200) -> list[tuple[str, str, str]]:
    """(title, link, summary) of RSS 2.0 or Atom; document types and entities are refused."""
    if re.search(r"<!(DOCTYPE|ENTITY)", raw, re.I):
        raise ValueError("a feed with a document type is refused")
    root = ET.fromstring(raw)
    plain = lambda e: e.tag.rpartition("}")[2]
    out = []
    for e in root.iter():
        if plain(e) in ("item", "entry"):
            got = {plain(c): (c.attrib.get("href") or c.text or "").strip() for c in e}
            out.append((got.get("title", ""), got.get("link", ""), html.unescape(re.sub(r"<[^>]+>", "", got.get("description") or got.get("summary") or ""))))
    return out[:most]


def read_bytes(kind: str, data: bytes) -> str:
    if kind == "docx":
        return read_docx(data)
    raw = data.decode("utf-8", "replace")
    if kind == "json":
        return json.dumps(json.loads(raw), indent=2, sort_keys=True, ensure_ascii=False)
    if kind == "csv":
        return "\n".join(" | ".join(r) for r in csv.reader(io.StringIO(raw), delimiter="\t" if "\t" in raw.split("\n", 1)[0] else ","))
    if kind == "html":
        return read_html(raw)
    if kind == "subtitles":
        return "\n".join(f"[{s:.3f}-{e:.3f}] {t}" for s, e, t in read_cues(raw))
    if kind == "feed":
        return "\n\n".join(f"# {t}\n\n{s}" for t, _, s in read_feed(raw))
    return raw


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, format, text, error) of all files below a path, read where they are; a file that can't be read has an error and no text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, k, c in zip(b.path, b.format, b.content, strict=True):
                try:
                    rows.append((p, k, read_bytes(k, c), None))
                except Exception as e:  # noqa: BLE001  one broken file is a row, not the end of the job
                    rows.append((p, k, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "format", "text", "error"])

    return raw.select("path", sniff(F.col("path")).alias("format"), "content").mapInPandas(run, "path string, format string, text string, error string")
