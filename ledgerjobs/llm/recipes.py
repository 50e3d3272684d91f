"""Exact dedup by content-defined chunk recipes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

SPACES = b" \t\n\x0b\x0c\r"
RECIPE = "doc_id string, n_cp long, text_sha256 string, recipe_key binary, recipe array<struct<fp:long,sha:binary,len:int>>"


def cut_points(data: bytes, bits: int = 10, least: int = 256, most: int = 8192) -> list[int]:
    """Ends of the chunks of ``data``: where a hash of the last eight bytes has ``bits`` zero bits.

    Cuts depend on nearby bytes only, so equal passages get equal chunks wherever they stand.
    """
    n = len(data)
    if n <= least:
        return [n] if n else []
    b = np.frombuffer(data, dtype=np.uint8)
    window = np.zeros(n - 7, dtype=np.uint64)
    for k in range(8):
        window |= b[k : n - 7 + k].astype(np.uint64) << np.uint64(8 * k)
    hashed = (window * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    ends, last = [], 0
    for end in (np.flatnonzero(hashed == 0) + 8).tolist():
        while end - last > most:
            last += most
            ends.append(last)
        if end - last >= least:
            last = end
            ends.append(last)
    while n - last > most:
        last += most
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def _recipes(bits: int, least: int, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                text = text or ""
                data = text.encode("utf-8", "replace").translate(None, SPACES)
                recipe, last = [], 0
                for end in cut_points(data, bits, least, most):
                    sha = hashlib.sha256(data[last:end]).digest()
                    recipe.append({"fp": int.from_bytes(sha[:8], "little", signed=True), "sha": sha, "len": end - last})
                    last = end
                key = hashlib.blake2b(b"".join(r["sha"] for r in recipe), digest_size=16).digest()
                rows.append((len(text), hashlib.sha256(data).hexdigest(), key, recipe))
            yield pd.DataFrame(rows, columns=["n_cp", "text_sha256", "recipe_key", "recipe"]).assign(doc_id=batch["doc_id"].to_numpy())[
                ["doc_id", "n_cp", "text_sha256", "recipe_key", "recipe"]
            ]

    return run


def exact_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bits: int = 10, least: int = 256, most: int = 8192) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    A text without its ASCII white space is cut into content-defined chunks; its recipe is the
    ordered list of them. Chunks are told apart by fingerprint and, within one fingerprint, by
    SHA-256 and length, and get identifiers so verified; texts are equal when their identifier
    lists are. Bytes of a text are read once and never shuffled; what moves is about 50 bytes
    a chunk (1 KB), and only once for a recipe that many rows share.

    Of equal texts the row with the most code points, then the smallest doc_id, stays. Null
    texts count as empty, and all empty ones are equal. Null ids come last in the choice;
    a group of null ids alone keeps null. A repeated row of the id that stays is kept, too:
    ``kept`` compares ids. Empty tables give empty results.
    """
    space = Workspace(docs.sparkSession)
    rows = space.stage(
        # ids travel as text: with nulls among them pandas would make them floats
        docs.select(F.col(doc_id).cast("long").cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
        .mapInPandas(_recipes(bits, least, most), RECIPE)
        .withColumn("doc_id", F.col("doc_id").cast("long")),
        "recipes",
    )
    # one recipe per key; keys that stand for several recipes are told apart by the list itself
    recipes = rows.select("recipe_key", F.transform("recipe", lambda c: F.struct(c.fp.alias("fp"), c.sha.alias("sha"), c.len.alias("len"))).alias("recipe")).distinct()
    steps = recipes.select("recipe_key", F.posexplode_outer("recipe").alias("pos", "c")).select("recipe_key", "pos", "c.*")
    chunks = steps.where("fp is not null").select("fp", "sha", "len").distinct()
    # verified identifier: the fingerprint, and the rank of this content among all with it (almost always 1)
    numbered = chunks.groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("sha", "len"))).alias("of")).select("fp", F.posexplode("of").alias("nth", "c")).select("fp", "nth", "c.*")
    listed = (
        steps.join(numbered, ["fp", "sha", "len"], "left")
        .groupBy("recipe_key")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fp", "nth"))), lambda c: F.struct(c.fp.alias("fp"), c.nth.alias("nth"))).alias("ids"))
    )
    canonical = space.stage(
        listed.groupBy("ids").agg(F.min("recipe_key").alias("group"), F.collect_list("recipe_key").alias("keys")).select("group", F.explode("keys").alias("recipe_key")), "groups"
    )
    slim = rows.select("doc_id", "n_cp", "text_sha256", "recipe_key")
    best = F.min(F.struct((-F.col("n_cp")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c")))
    winners = slim.groupBy("recipe_key").agg(best.alias("best"), F.count("*").alias("n")).join(canonical, "recipe_key")
    of_group = winners.groupBy("group").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
    keep = winners.select("recipe_key", "group").join(of_group, "group").select("recipe_key", F.col("best.c").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"))
    out = slim.join(keep, "recipe_key").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    out = space.stage(out, "result")
    space.drop(out)
    return out
