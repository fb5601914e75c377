"""Near-duplicate embeddings by counting collisions on random one-dimensional projections.

Vectors are projected on random lines.  On each of ``PROBES`` lines a query has a window of ``WINDOW`` on both sides of
its own value; for a pair the windows that hold both are counted, and pairs with enough collisions are verified by the
cosine in double precision.  How many are enough follows from the chance that vectors exactly at the threshold collide.

Counting all pairs would be quadratic, so the work is partitioned first: the signs on a bundle of further lines deal the
vectors to cells, each bundle anew, and collisions are counted within cells.  The number of lines in a bundle grows with
the logarithm of the number of vectors, so that a cell stays small; the number of bundles follows from it so that a pair
exactly at the threshold is found with probability ``RECALL``, bundles and collisions together.  A pair belongs to the
first bundle whose cell it shares, so that every link is found once and can be counted where it is found: a task gives
for each vector the number of its links and one link to the smallest vector it is connected with there, never all pairs.

Equal vectors are one node that knows its number of copies.  A cell with more than ``CELL_ROWS`` nodes is dealt
out as pairs of blocks, so that no task holds it whole.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of different lengths never link; rows without id take part; repeated rows are copies of each other; ties of ids
are one row each; an empty table gives an empty result; further columns are not carried; a vector of any length is
projected as a whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._groups import by_group
from ._scratch import join_hot, small_enough, written
from ._text import mix

COSINE = 0.9
RECALL = 0.995
WINDOW = 1.0
PROBES = 24
#: Part of the recall that the count of collisions may cost; the rest is the bundles'.
COUNT_LOSS = 0.0005
#: Nodes that a cell has if vectors point everywhere alike.
CELL_NODES = 400
#: Nodes of a cell that are compared in one piece.
CELL_ROWS = 2048
#: Nodes of a cell from which on collisions are counted by tiles of queries, not by steps over all cells of a batch.
TILED = 48
_TILE = 256


def same_side(cosine: float) -> float:
    """The chance that two vectors lie on the same side of a random line's origin."""
    return 1 - math.acos(cosine) / math.pi


@dataclass(frozen=True)
class Plan:
    """How many bundles of how many lines, and how many collisions a candidate pair must have."""

    bundles: int
    width: int
    collisions: int

    @classmethod
    def calibrated(cls, nodes: int, cosine: float = COSINE, recall: float = RECALL) -> Plan:
        width = max(0, round(math.log2(max(nodes, 1) / CELL_NODES)))
        missed = 1 - same_side(cosine) ** width
        bundles = math.ceil(math.log(1 - recall / (1 - COUNT_LOSS)) / math.log(missed)) if missed > 0 else 1
        hit = math.erf(WINDOW / math.sqrt(2 - 2 * cosine) / math.sqrt(2))
        tail, asked = 0.0, PROBES + 1
        while tail < 1 - COUNT_LOSS and asked > 0:
            asked -= 1
            tail += math.comb(PROBES, asked) * hit**asked * (1 - hit) ** (PROBES - asked)
        return cls(bundles, width, asked)


def lines(dimension: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dimension, count]).standard_normal((dimension, count))


def rows_by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of valid vectors: the places of its rows, and the vectors as given."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    begin = np.cumsum(n) - n
    for size in np.unique(n[n > 0]):
        at = np.flatnonzero(n == size)
        vectors = flat[begin[at][:, None] + np.arange(size)]
        good = np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1)
        yield at[good], vectors[good]


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, a key of the vector's values (null where it is not valid), and the values."""
    for batch in batches:
        keys: list[bytes | None] = [None] * batch.num_rows
        for at, vectors in rows_by_length(batch.column(1)):
            vectors = vectors + 0.0  # one zero
            for i, v in zip(at.tolist(), vectors, strict=True):
                keys[i] = hashlib.blake2b(v.tobytes(), digest_size=16).digest()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(1).cast(pa.list_(pa.float64()))], ["vec_id", "node", "vector"])


def cells(unit: np.ndarray, plan: Plan) -> np.ndarray:
    """(n, bundles) keys of the cells that vectors of one length fall into."""
    size = unit.shape[1]
    side = unit @ lines(size, plan.bundles * plan.width, 1) > 0
    place = side.reshape(len(unit), plan.bundles, plan.width) @ (np.uint64(1) << np.arange(plan.width, dtype=np.uint64))
    return mix(place.astype(np.uint64) * np.uint64(plan.bundles) + np.arange(plan.bundles, dtype=np.uint64) + (np.uint64(size) << np.uint64(48)))


def _dealt(plan: Plan, kind: str):
    """id, copies, vector (numbers of ``kind``), and the keys of its cells in all bundles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, vectors in rows_by_length(batch.column(2)):
                key = cells(_unit(vectors), plan)
                packed = pa.array([v.tobytes() for v in vectors.astype(kind)], pa.binary())
                ends = pa.array(np.arange(len(key) + 1, dtype=np.int32) * plan.bundles)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(at)) for i in (0, 1)), packed, pa.ListArray.from_arrays(ends, pa.array(key.view(np.int64).ravel()))], ["id", "copies", "vector", "cells"])

    return run


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def collided(probe: np.ndarray, begin: int, end: int, asked: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of the rows begin to end - 1 that share at least ``asked`` windows; ``probe`` has a row per line."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for low in range(begin, end, _TILE):
        rows = slice(low, min(low + _TILE, end))
        hits = np.zeros((rows.stop - low, end - low), np.uint8)
        for line in probe:
            hits += np.abs(line[rows, None] - line[None, low:end]) <= WINDOW
        i, j = np.nonzero(hits >= asked)
        use = i < j
        found.append((i[use] + low, j[use] + low))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest that the links a, b connect it with."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        label = label[label]
        if (label == before).all():
            return label


def _linked(plan: Plan, cosine: float, kind: str):
    """What the groups' links say: (id, least, near) per linked node; rows come sorted by group.

    ``near`` is the number of vectors linked with it here, ``least`` the smallest node it is connected with here.
    """

    def solve(rows: pa.RecordBatch) -> pa.RecordBatch:
        column = {n: rows.column(i) for i, n in enumerate(rows.schema.names)}
        group, node, copies = (column[n].to_numpy() for n in ("group", "id", "copies"))
        block, diagonal, bundle = (column[n].to_numpy(zero_copy_only=False) for n in ("block", "diagonal", "bundle"))
        size = pc.binary_length(column["vector"]).to_numpy() // np.dtype(kind).itemsize
        links: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
        for s in np.unique(size):
            at = np.flatnonzero(size == s)
            unit = _unit(np.frombuffer(b"".join(column["vector"].take(pa.array(at)).to_pylist()), kind).reshape(len(at), s).astype(float))
            probe = np.ascontiguousarray((unit @ lines(s, PROBES, 2)).T.astype(np.float32))
            own = group[at]
            begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            end = np.append(begin[1:], len(own))

            def verified(i: np.ndarray, j: np.ndarray, at=at, unit=unit) -> None:
                use = diagonal[at[i]] | (block[at[i]] != block[at[j]])
                i, j = i[use], j[use]
                for low in range(0, len(i), 50_000):
                    x, y = i[low : low + 50_000], j[low : low + 50_000]
                    true = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
                    x, y = x[true], y[true]
                    if len(x):
                        members, place = np.unique(np.concatenate([x, y]), return_inverse=True)
                        code = cells(unit[members], plan)
                        first = (code[place[: len(x)]] == code[place[len(x) :]]).argmax(axis=1) == bundle[at[x]]
                        links.append((at[x[first]], at[y[first]]))

            for b, e in zip(begin, end, strict=True):
                if e - b >= TILED:
                    verified(*collided(probe, b, e, plan.collisions))
            few = np.repeat(end - begin < TILED, end - begin)
            last = np.repeat(end, end - begin)
            left, step = np.flatnonzero(few), 0
            while True:
                step += 1
                left = left[left + step < last[left]]
                if not len(left):
                    break
                hits = (np.abs(probe[:, left] - probe[:, left + step]) <= WINDOW).sum(axis=0)
                hit = left[hits >= plan.collisions]
                verified(hit, hit + step)
        a, b = (np.concatenate(x) for x in zip(*links, strict=True))
        member, place = np.unique(np.concatenate([node[a], node[b]]), return_inverse=True)
        x, y = place[: len(a)], place[len(a) :]
        near = np.bincount(x, copies[b], len(member)) + np.bincount(y, copies[a], len(member))
        least = member[_smallest(len(member), x, y)] if len(member) else member
        return pa.RecordBatch.from_arrays([pa.array(member), pa.array(least), pa.array(near.astype(np.int64))], ["id", "least", "near"])

    return by_group(solve)


def links(nodes: DataFrame, plan: Plan, cosine: float = COSINE, kind: str = "f8") -> DataFrame:
    """(id, least, near) of linked nodes (id, copies, vector), whose numbers ``kind`` holds exactly.

    A node has a row for each task that finds links of it: ``near`` adds up to the number of linked vectors, and the
    pairs (id, least) connect what links connect.
    """
    stored = written(nodes.select("id", "copies", "vector").mapInArrow(_dealt(plan, kind), "id long, copies long, vector binary, cells array<long>"), "cells")
    placed = stored.select("id", "copies", "vector", F.posexplode("cells").alias("bundle", "cell"))
    large = stored.select(F.explode("cells").alias("cell")).groupBy("cell").count().filter(f"count > {CELL_ROWS}")
    large = written(large.select("cell", F.ceil(F.col("count") / CELL_ROWS).cast("int").alias("blocks"), "count"), "large")
    if small_enough(large):
        placed = placed.join(F.broadcast(large.drop("count")), "cell", "left")
    else:
        placed = join_hot(placed, large, ["cell"], "count", "left", stored.count() * plan.bundles)
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    low, high = F.least("block", "with"), F.greatest("block", "with")
    grouped = dealt.select(F.when(blocks == 1, F.col("cell")).otherwise(F.xxhash64("cell", low, high)).alias("group"), "block", (F.col("block") == F.col("with")).alias("diagonal"), "bundle", "id", "copies", "vector")
    return grouped.repartition("group").sortWithinPartitions("group").mapInArrow(_linked(plan, cosine, kind), "id long, least long, near long")


def classes(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    named = written(vectors.select("vec_id", "embedding").mapInArrow(_named, "vec_id long, node binary, vector array<double>"), "named")
    nodes = named.filter("node IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    plan = Plan.calibrated(nodes.count(), cosine, recall)
    kind = "f4" if "float" in vectors.schema["embedding"].dataType.simpleString() else "f8"
    found = written(links(nodes, plan, cosine, kind), "links")
    near = found.groupBy("id").agg(F.sum("near").alias("near"))
    label = components(found.select(F.col("id").alias("a"), F.col("least").alias("b"))).select(F.col("node").alias("id"), "label")
    labelled = nodes.select("id", "node", "first_id", "copies").join(near, "id", "left").join(label, "id", "left")
    labelled = written(labelled.select("node", "first_id", "copies", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "id").alias("label")), "labelled")
    least = written(labelled.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count("*").alias("nodes")), "least")
    known = written(join_hot(labelled, least, ["label"], "nodes").select("node", "copies", "n_links", "component_id"), "known")
    out = join_hot(named.select("vec_id", "node"), known, ["node"], "copies", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
