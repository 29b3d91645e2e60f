"""Packing to a token budget, session memory, audit chains, governance."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def pack(units: DataFrame, budget: int) -> DataFrame:
    """units (pack, key, score, tokens, required) with included: required first, then by score, skipping what does not fit."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["required", "score", "key"], ascending=[False, False, True])
        used, kept = 0, []
        for need, cost in zip(pdf.required, pdf.tokens, strict=True):
            take = bool(need) or used + cost <= budget
            used += cost if take else 0
            kept.append(take)
        return pdf.assign(included=kept)

    u = units.select("pack", "key", "score", "tokens", "required")
    return u.groupBy("pack").applyInPandas(kernel, StructType(list(u.schema.fields)).add("included", "boolean"))


def suppress(turns: DataFrame) -> DataFrame:
    """turns (session, turn, key, content) with state: sent the first time, resent if the content has changed since, else suppressed."""
    w = Window.partitionBy("session", "key").orderBy("turn")
    old = F.lag(F.sha2("content", 256)).over(w)
    return turns.withColumn("state", F.when(old.isNull(), "sent").when(old != F.sha2("content", 256), "resent").otherwise("suppressed"))


def audit_chain(rows: DataFrame) -> DataFrame:
    """rows (log, seq, payload) with prev and hash: each hash covers the one before. One log is one sequence, so one task's group."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        last, prev, hashes = "0" * 64, [], []
        pdf = pdf.sort_values("seq")
        for p in pdf.payload:
            prev.append(last)
            last = hashlib.sha256(f"{last}\x1f{p}".encode()).hexdigest()
            hashes.append(last)
        return pdf.assign(prev=prev, hash=hashes)

    r = rows.select("log", "seq", "payload")
    return r.groupBy("log").applyInPandas(kernel, StructType(list(r.schema.fields)).add("prev", "string").add("hash", "string"))


def audit_breaks(chain: DataFrame) -> DataFrame:
    """Rows of a chain whose hash, or whose link to the row before, does not hold."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy("log").orderBy("seq")), F.lit("0" * 64))
    return chain.withColumn("x", before).where((F.col("prev") != F.col("x")) | (F.col("hash") != F.sha2(F.concat_ws("\x1f", "prev", "payload"), 256))).drop("x")


def decide(kind: Column, network: Column, consent: Column, permitted: Column) -> Column:
    """A policy's verdict: reads pass, network needs its switch, side effects consent, the rest permission; unknown kinds are refused."""
    return (
        F.when(kind == "read", "allow")
        .when((kind == "network") & ~network, "deny: network off")
        .when(kind.isin("write", "delete", "network") & ~consent, "deny: no consent")
        .when(~permitted, "deny: not permitted")
        .when(kind.isin("write", "delete", "network", "export"), "allow")
        .otherwise("deny: unknown")
    )


def over_quota(owned: DataFrame, quota: int) -> DataFrame:
    """(tenant, n, quota, exceeded) of owned (tenant)."""
    return owned.groupBy("tenant").agg(F.count("*").alias("n")).select("tenant", "n", F.lit(quota).cast("long").alias("quota"), (F.col("n") > quota).alias("exceeded"))
