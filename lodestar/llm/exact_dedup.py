"""Exact deduplication of documents against an immutable snapshot.

A snapshot holds one row per distinct text digest (its exact buckets) and, for each shard of digests, a
static binary-fuse filter.  An incoming batch is digested, grouped by digest (so that a text repeated a
million times is one row before anything is joined; digests with very many ids are joined without a shuffle), and screened shard by shard: a digest that its filter
does not hold is new for certain; the others join the exact buckets.  Every text of a group of several is
then compared byte by byte with the text that stays.

Defined cases: a null text counts as empty and empty texts equal each other; a row without id takes part,
and stays only where its group has no id; of rows with the same id and text the first stays and the rest
are dropped; an empty table gives an empty result; further columns are carried by :func:`drop_copies` only, whatever
their names; a text of any length is digested and compared as a whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import binary_fuse
from ._scratch import fresh, join_hot, join_keys, written

#: Distinct digests in a shard; a shard and its filter fit easily in one task.
SHARD_KEYS = 500_000
#: Copies whose texts one row of the text that stays is compared with.
COPIES_PER_SALT = 500


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space replaced by one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, sha, n): one row per distinct id and digest, with the number of such rows."""
    return docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("sha")).groupBy("sha", "doc_id").agg(F.count("*").alias("n"))


def _by_digest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.sum("n").alias("copies"))


def _sharded(rows: DataFrame, shards: int) -> DataFrame:
    return rows.withColumn("key", F.xxhash64("sha")).withColumn("shard", F.pmod("key", F.lit(shards)))


@dataclass
class Snapshot:
    """Exact buckets (sha, first_id, copies, key, shard) and filters (shard, blob) of a set of documents."""

    buckets: DataFrame
    filters: DataFrame
    shards: int


def _fuse(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "blob": [binary_fuse.build(pdf["key"].to_numpy().view(np.uint64))]})


def build_snapshot(rows: DataFrame) -> Snapshot:
    """A snapshot of digest rows; shards grow with the number of distinct digests."""
    buckets = written(_by_digest(rows), "digests")
    shards = max(1, math.ceil(buckets.count() / SHARD_KEYS))
    buckets = _sharded(buckets, shards)
    filters = written(buckets.select("shard", "key").groupBy("shard").applyInPandas(_fuse, "shard long, blob binary"), "filters")
    return Snapshot(buckets, filters, shards)


def _screen(batch: pd.DataFrame, fuse: pd.DataFrame) -> pd.DataFrame:
    hit = np.zeros(len(batch), bool) if fuse.empty else binary_fuse.contains(fuse["blob"].iloc[0], batch["key"].to_numpy().view(np.uint64))
    return batch[["sha", "first_id", "copies"]].assign(hit=hit)


def screen(snapshot: Snapshot, rows: DataFrame) -> DataFrame:
    """The batch's digests (sha, first_id, copies, hit); those without ``hit`` are not in the snapshot."""
    batch = _sharded(_by_digest(rows), snapshot.shards)
    return batch.groupBy("shard").cogroup(snapshot.filters.groupBy("shard")).applyInPandas(_screen, "sha binary, first_id long, copies long, hit boolean")


def merged(snapshot: Snapshot, rows: DataFrame) -> DataFrame:
    """(sha, keep_id, group_size) over the snapshot and the batch together."""
    screened = written(screen(snapshot, rows), "screened")
    positive = screened.filter("hit").select("sha", F.col("first_id").alias("batch_id"), F.col("copies").alias("more"))
    known = snapshot.buckets.join(positive, "sha", "left").select("sha", F.least("first_id", "batch_id").alias("keep_id"), (F.col("copies") + F.coalesce("more", F.lit(0))).alias("group_size"))
    missed = screened.filter("hit").join(snapshot.buckets.select("sha"), "sha", "left_anti").drop("hit")  # the filter's false positives
    new = screened.filter("NOT hit").drop("hit").union(missed)
    return known.union(new.select("sha", F.col("first_id").alias("keep_id"), F.col("copies").alias("group_size")))


def _differing(docs: DataFrame, groups: DataFrame, rows: DataFrame) -> DataFrame:
    """Digests under which texts are not equal byte by byte (none, unless SHA-256 collides)."""
    several = written(groups.filter("group_size > 1"), "several")
    ids = join_hot(rows, several, ["sha"], "group_size").select("doc_id").distinct()
    wanted = docs.select("doc_id", normalised(F.col("text")).alias("body"))
    texts = join_keys(wanted.filter("doc_id IS NOT NULL"), written(ids, "ids"), "doc_id").unionByName(wanted.filter("doc_id IS NULL"))
    texts = written(texts.withColumn("sha", F.unhex(F.sha2("body", 256))), "copied")  # read several times below
    salts = F.ceil(F.col("group_size") / COPIES_PER_SALT).cast("int")
    named = join_hot(texts, several, ["sha"], "group_size")
    copies = named.withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts).cast("int"))
    stays = named.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).dropDuplicates(["sha"]).select("sha", F.col("body").alias("kept_body"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return written(copies.join(stays, ["sha", "salt"]).filter("body <> kept_body").select("sha").distinct(), "differing")


def grouped(docs: DataFrame, archived: Column | None = None) -> DataFrame:
    """(doc_id, sha, n, keep_id, group_size) by id and digest; ``archived`` as in :func:`assign`."""
    docs = docs.select("doc_id", "text")
    rows = written(digest_rows(docs), "rows")
    if archived is None:
        middle = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
        archived = F.col("doc_id") <= F.lit(middle) if middle is not None else F.lit(False)
    archived = F.coalesce(archived, F.lit(False))
    groups = written(merged(build_snapshot(rows.filter(archived)), rows.filter(~archived)), "groups")
    out = join_hot(rows, groups, ["sha"], "group_size")
    differing = _differing(docs, groups, rows)
    if not differing.isEmpty():
        out = out.join(differing, "sha", "left_anti").unionByName(_by_text(docs, differing))
    return out


def assign(docs: DataFrame, archived: Column | None = None) -> DataFrame:
    """One row per document: doc_id, sha, keep_id, group_size, kept.

    ``archived`` says which documents the snapshot holds (the others arrive as a batch); by default those
    up to the median id.  The result is the same for every such division.
    """
    return (
        grouped(docs, archived)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        .withColumn("kept", (F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .select("doc_id", "sha", "keep_id", "group_size", "kept")
    )


def _by_text(docs: DataFrame, differing: DataFrame) -> DataFrame:
    """Digest rows of colliding digests, grouped by the texts themselves."""
    body = docs.select("doc_id", normalised(F.col("text")).alias("body")).withColumn("sha", F.unhex(F.sha2("body", 256))).join(differing, "sha", "left_semi")
    groups = body.groupBy("sha", "body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    rows = body.groupBy("sha", "body", "doc_id").agg(F.count("*").alias("n"))
    return rows.join(groups, ["sha", "body"]).select("sha", "doc_id", "n", "keep_id", "group_size")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    found = written(grouped(docs), "grouped")
    own_id, own_sha, sha = fresh(docs, "_id"), fresh(docs, "_gone"), fresh(docs, "_sha")
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias(own_id), F.col("sha").alias(own_sha))
    total, ids = found.agg(F.sum("n"), F.count_distinct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).first()
    if total == ids:  # every id is one row, so that the id alone says which row
        return join_keys(docs, written(gone.select(own_id), "gone"), F.col("doc_id").eqNullSafe(F.col(own_id)), "left_anti")
    named = docs.withColumn(sha, F.unhex(F.sha2(normalised(F.col("text")), 256)))
    stays = join_keys(named, written(gone, "gone"), F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(sha) == F.col(own_sha)), "left_anti")
    return stays.dropDuplicates(["doc_id", sha]).drop(sha)
