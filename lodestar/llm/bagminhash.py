"""Near-duplicate documents by weighted minwise hashing of word-shingle multisets.

Each element (shingle) of weight w is a Poisson process over the weight axis, cut into the dyadic levels
[0, 1), [1, 2), [2, 4), ...; a level has its own seed, its points carry an arrival time, a signature slot and a
height, and a point counts where its height lies below the weight.  Levels above the weight are never
visited, and arrivals stop at the largest minimum that the signature still holds, so that a document of n
shingles costs about n + m log m points for m slots.  Two signatures agree in a slot with the probability of
the weighted Jaccard similarity.  Slots are banded; texts that share a band are candidates; candidates are
verified by the exact overlap of their multisets.

Copies (equal word sequences, by a 128-bit digest) are one node.  Within a band's bucket every member is first compared with one of
them, and then, across the classes that this leaves, with every other member of another class; members of one
class need no comparison, and every pair of different classes whose sizes allow the similarity is verified.

Defined cases: null text is empty; texts without words are copies of each other; a text of fewer words than a
shingle is one shingle; a text of any length is read as a whole; rows without id take part and get the class of their
text (null if no member has an id); repeated rows give repeated results, of which the first of equal ids is kept; an empty
table gives an empty result; :func:`classes` reads doc_id and text only, and :func:`keep_first` carries all columns,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._groups import by_group
from ._pieces import words
from ._scratch import fresh, join_hot, join_keys, written
from ._text import chunks, mix, sequence_keys, shingles

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 36, 7
#: Members of a bucket that are compared in one piece.
BLOCK_ROWS = 1024
#: Members of a bucket that share one copy of the first member's multiset.
STAR_ROWS = 500
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 52) - 1)


def multisets(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each text as (text, 52-bit element, weight), ordered by text and element."""
    keys = np.sort((text.astype(np.uint64) << np.uint64(52)) | (hashes & _LOW))
    if not len(keys):
        return np.zeros(0, np.int64), keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    weight = np.diff(np.append(first, len(keys)))
    return (keys[first] >> np.uint64(52)).astype(np.int64), keys[first] & _LOW, weight


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, slots: int) -> np.ndarray:
    """An (n, slots) array of minimal arrival times; infinite where a text has no element."""
    out = np.full(n * slots, np.inf)
    level = 0
    queue = []
    while True:
        low, width = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
        at = np.flatnonzero(weight > low)
        if not len(at):
            break
        seed = mix(element[at] * _GOLDEN + np.uint64(level + 1))
        share = (np.minimum(weight[at] - low, width) / width).astype(np.float32)
        queue.append((text[at], seed, share, np.full(len(at), float(width))))
        level += 1
    if not queue:
        return out.reshape(n, slots)
    text, seed, share, width = (np.concatenate(x) for x in zip(*queue, strict=True))
    time, largest = np.zeros(len(text)), np.zeros(n)
    done = 0
    while len(text):
        block = 1 if done < 2 else int(np.clip(100_000 // len(text), 1, 16))
        draw = mix(seed[:, None] + np.arange(done + 1, done + block + 1, dtype=np.uint64) * _GOLDEN)
        gaps = -np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * 2.0**-53) / width[:, None]
        gaps[:, 0] += time
        times = np.cumsum(gaps, axis=1)  # one addition after the other, so that blocks of any size agree
        more = mix(draw ^ np.uint64(0x5851F42D4C957F2D))
        counts = (more >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24) < share[:, None]
        slot = (((more & np.uint64(0xFFFFFFFF)) * np.uint64(slots)) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(out, (text[:, None] * slots + slot)[counts], times[counts])
        time = times[:, -1]
        here = np.flatnonzero(np.bincount(text, minlength=n))
        largest[here] = out.reshape(n, slots)[here].max(axis=1)
        alive = np.flatnonzero(time < largest[text])
        text, seed, share, width, time = text[alive], seed[alive], share[alive], width[alive], time[alive]
        done += block
    return out.reshape(n, slots)


def bands(signature: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """(n, bands) 64-bit keys, each of ``rows`` slots of the signature and the band's number."""
    bits = signature.view(np.uint64).reshape(len(signature), n_bands, rows)
    key = np.tile(mix(np.arange(1, n_bands + 1, dtype=np.uint64) * _GOLDEN), (len(signature), 1))
    for r in range(rows):
        key = mix(key * np.uint64(3) + bits[:, :, r])
    return key.view(np.int64)


def _sign(width: int, n_bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for part in chunks(batch.column(1)):
                hashes, begins = words(part)
                shingle, text = shingles(hashes, begins, width)
                size = np.bincount(text, minlength=len(part)).astype(np.int64)
                parts = multisets(shingle, text)
                signature = signatures(*parts, len(part), n_bands * rows)
                key = bands(signature, n_bands, rows)
                columns = [
                    ids.slice(part.first, len(part)),
                    pa.array(sequence_keys(hashes, begins), pa.binary()),
                    pa.array(size),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * n_bands), pa.array(key.ravel())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "size", "bands"])

    return run


def _replicas(width: int):
    """Per text its node and a sorted number for each element and occurrence, so that sets stand for multisets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.column(0)):
                hashes, begins = words(part)
                shingle, text = shingles(hashes, begins, width)
                at, element, weight = multisets(shingle, text)
                again = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
                items = mix(np.repeat(element, weight) + again.astype(np.uint64) * _GOLDEN).view(np.int64)
                owner = np.repeat(at, weight)
                items = items[np.lexsort((items, owner))]
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(part)))]).astype(np.int32)
                columns = [pa.array(sequence_keys(hashes, begins), pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(items))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "items"])

    return run


def _verified(star: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose multisets have a weighted Jaccard similarity of at least ``similarity``.

    ``star`` (a, b, block) has few rows for each a and block: a is fetched once for each block, so that a node which is
    compared with very many does not bring them into one task.
    """
    first = star.select("a", "block").distinct().join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    both = star.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b").join(first, ["a", "block"])
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(shared >= similarity * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b")


def classes(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its class), class_size, kept."""
    docs = docs.select("doc_id", "text")
    schema = "doc_id long, node binary, size long, bands array<long>"
    signed = written(docs.mapInArrow(_sign(width, n_bands, rows), schema), "signed")
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = written(nodes, "nodes")
    labels = _labels(docs, nodes, width, n_bands, similarity)
    named = nodes.select("node", "copies").join(labels, "node", "left").select("node", "copies", F.coalesce("label", "node").alias("label"))
    member = join_hot(signed.select("doc_id", "node"), written(named, "named"), ["node"], "copies").select("doc_id", "label")
    member = member.groupBy("label", "doc_id").agg(F.count("*").alias("n"))
    member = written(member, "member")
    total = written(member.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size")), "classes")
    return (
        join_hot(member, total, ["label"], "class_size")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        .select("doc_id", "class_id", "class_size", ((F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))
    )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sorted by bucket and node) whose bucket has another row, with the bucket's first node and a block number.

    Blocks cut a bucket into runs of at most ``STAR_ROWS`` rows.
    """
    names = ["bucket", "node", "size", "first", "block"]
    held: pa.RecordBatch | None = None  # the last row, until it is known whether another follows
    bucket_before, first = None, None
    seen = 0  # rows of the batches before
    for batch in _then_none(batches):
        rows = [held] if held is not None else []
        if batch is not None:
            if not batch.num_rows:
                continue
            rows.append(batch)
        if not rows:
            return
        all_ = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        keys = all_.column(0).to_numpy()
        begins = np.concatenate([[True], keys[1:] != keys[:-1]])
        start = np.flatnonzero(begins)
        node = all_.column(1)
        leader = node.take(pa.array(start[np.cumsum(begins) - 1]))
        lead_run = np.cumsum(begins) == 1
        carried = bucket_before is not None and keys[0] == bucket_before
        if carried:  # the first run goes on from rows that are gone
            leader = pa.array([first if r else v for r, v in zip(lead_run.tolist(), leader.to_pylist(), strict=True)], pa.binary())
        last = len(keys) if batch is None else len(keys) - 1
        several = ~begins | np.concatenate([keys[:-1] == keys[1:], [False]]) | (lead_run & carried)
        use = pa.array(np.flatnonzero(several[:last]))
        block = pa.array((seen + np.arange(len(keys))) // STAR_ROWS)
        yield pa.RecordBatch.from_arrays([all_.column(i).take(use) for i in range(3)] + [leader.take(use), block.take(use)], names)
        if batch is None:
            return
        seen += last
        held = all_.slice(last)
        if last:
            bucket_before, first = (keys[last], leader[last].as_py()) if keys[last] == keys[last - 1] else (None, None)


def _then_none(items: Iterator) -> Iterator:
    yield from items
    yield None


def _across(n_bands: int, similarity: float):
    """Links between different classes of a bucket: pairs whose sizes make the similarity possible, verified."""

    def solve(rows: pa.RecordBatch) -> pa.RecordBatch:
        column = {n: rows.column(i) for i, n in enumerate(rows.schema.names)}
        group, size, block = (column[n].to_numpy() for n in ("group", "size", "block"))
        diagonal = column["diagonal"].to_numpy(zero_copy_only=False)
        band = column["band"].to_numpy()
        _, label = np.unique(np.array(column["label"].to_pylist(), "S16"), return_inverse=True)
        node = column["node"].to_pylist()
        keys = column["bands"].flatten().to_numpy().reshape(len(node), n_bands)
        items = column["items"].flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(size)])
        leader = list(range(label.max() + 1))

        def find(x: int) -> int:
            while leader[x] != x:
                leader[x] = x = leader[leader[x]]
            return x

        def alike(i: int, j: int) -> bool:
            a, b = items[ends[i] : ends[i + 1]], items[ends[j] : ends[j + 1]]
            shared = (b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()
            return shared >= similarity * (len(a) + len(b) - shared) - 1e-9

        last = np.searchsorted(group, group, "right")
        left, step, found = np.arange(len(node)), 0, []
        while True:
            step += 1
            left = left[left + step < last[left]]
            if not len(left):
                break
            for part in np.array_split(left, max(1, len(left) // 20_000)):
                other = part + step
                use = (label[part] != label[other]) & (diagonal[part] | (block[part] != block[other]))
                use &= np.minimum(size[part], size[other]) >= (similarity - 1e-9) * np.maximum(size[part], size[other])
                part, other = part[use], other[use]
                once = (keys[part] == keys[other]).argmax(axis=1) == band[part]
                for i, j in zip(part[once].tolist(), other[once].tolist(), strict=True):
                    x, y = find(label[i]), find(label[j])
                    if x != y and alike(i, j):  # classes that links of this piece have joined need no more of them
                        leader[x] = y
                        found.append(tuple(sorted((node[i], node[j]))))
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], ["a", "b"])

    return by_group(solve)


def _labels(docs: DataFrame, nodes: DataFrame, width: int, n_bands: int, similarity: float) -> DataFrame:
    """(node, label) of the nodes that are linked to others.

    First every member of a bucket is compared with the bucket's first node.  Most near copies are in one class
    then; what is left are pairs of a bucket in different classes, which are all verified where their sizes
    allow it (large buckets as pairs of blocks).
    """
    rows = nodes.filter("size > 0").select("node", "size", F.explode("bands").alias("bucket")).select("bucket", "node", "size")
    sorted_ = rows.repartition("bucket").sortWithinPartitions("bucket", "node")
    members = written(sorted_.mapInArrow(_shared, "bucket long, node binary, size long, first binary, block long"), "members")
    own = members.select("node").distinct()
    ids = written(nodes.join(own, "node", "left_semi").select("first_id"), "ids")
    texts = join_keys(docs.filter("doc_id IS NOT NULL"), ids, F.col("doc_id") == F.col("first_id")).unionByName(docs.filter("doc_id IS NULL"))
    sets = texts.select("text").mapInArrow(_replicas(width), "node binary, items array<long>").dropDuplicates(["node"])
    sets = written(sets, "sets")
    star = members.filter("node <> first").groupBy(F.col("first").alias("a"), F.col("node").alias("b")).agg(F.min("block").alias("block"))
    star = written(star, "pairs")
    labels = _joined(None, written(_verified(star, sets, similarity), "links"))
    known = members.select("bucket", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = written(known, "known")
    open_ = known.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("rows")).filter("least <> most AND rows > 2")
    open_ = written(open_.select("bucket", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks"), "rows"), "open")
    if open_.isEmpty():
        return labels
    left = written(join_hot(known, open_, ["bucket"], "rows").drop("rows"), "left")
    detail = nodes.join(left.select("node").distinct(), "node").select("node", "size", "bands")
    left = left.join(detail.join(sets, "node"), "node").withColumn("band", F.array_position("bands", F.col("bucket")).cast("int") - 1)
    left = left.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("block", "with"), F.greatest("block", "with")))
    dealt = left.select(group.alias("group"), "block", (F.col("block") == F.col("with")).alias("diagonal"), "band", "node", "size", "label", "bands", "items")
    links = dealt.repartition("group").sortWithinPartitions("group").mapInArrow(_across(n_bands, similarity), "a binary, b binary")
    return _joined(labels, written(links.distinct(), "links"))


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after more links: the links between classes are solved as a smaller graph of their own."""
    if labels is None:
        return written(components(links), "labels")
    if links.isEmpty():
        return labels
    ends = links
    for side in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}")), side, "left")
    ends = written(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")), "ends")
    moved = components(ends).select(F.col("node").alias("label"), F.col("label").alias("to"))
    moved = written(moved.join(labels.groupBy("label").count(), "label", "left").na.fill(0, ["count"]), "moved")
    old = join_hot(labels, moved, ["label"], "count", "left").select("node", F.coalesce("to", "label").alias("label"))
    fresh = moved.join(labels, moved["label"] == labels["node"], "left_anti").select(F.col("label").alias("node"), F.col("to").alias("label"))
    return written(old.unionByName(fresh).distinct(), "labels")


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """One document of each class, with all its columns (rows without id stay: none can be named)."""
    own = fresh(docs, "_id")
    gone = classes(docs, **how).filter("NOT kept AND doc_id <> class_id").select(F.col("doc_id").alias(own)).distinct()
    return join_keys(docs, written(gone, "gone"), F.col("doc_id") == F.col(own), "left_anti")
