"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard similarity.

A document's set holds hashes of its runs of ``words`` words. Two permutations make every coordinate of a
signature: the first scatters the set over a circle of 2**32 places, the second, turned by k places, orders
them for coordinate k; the coordinate is the smallest. ``BANDS`` bands of ``ROWS`` coordinates put equal
sets into equal buckets and sets with similarity 0.8 into one bucket at least but for 3 pairs in a million.
Links are decided on the whole sets, of 64-bit hashes.

Documents with equal sets are one node. A bucket is worked off by centres: in each of ``CENTRES`` rounds the
node that meets most others is tested on the full sets against all nodes of its bucket that are not yet
connected to it, and is taken out. So a large group of near copies needs one test a node and not one a
pair. A bucket is done when the nodes left are connected. What is left of the others goes through an exact
join on rare hashes, which loses no pair either, and nothing is capped. Connected components come from
links by passing the smallest label and following labels, in written tables.

Cases: a null or empty text, or one without words, has an empty set and is linked with nothing; fewer
words than a shingle has make one shingle; a null doc_id takes no part, has no component and is kept; rows
that share a doc_id are judged by their own texts; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

WORDS, PERCENT = 5, 80
BANDS, ROWS = 24, 4
COORDINATES = BANDS * ROWS
#: Rounds with one centre for each bucket.
CENTRES = 3
#: A bucket with more nodes is dealt out to several tasks, each of which gets its centre.
SLOT_NODES = 256

_A = np.uint64(0x9E3779B97F4A7C15)
_SHIFTS = np.arange(COORDINATES, dtype=np.uint32)
_STEP = 1024


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _turned(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers (the finalizer of MurmurHash3), in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def shingles(text: str, words: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's runs of words, sorted."""
    from xxhash import xxh3_64_intdigest

    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * _A + h[k : len(h) - n + 1 + k]
    return np.unique(mix64(out))


def signature(found: np.ndarray) -> np.ndarray:
    """The circulant MinHash coordinates of a set that is not empty."""
    places = (mix64(found ^ _A) >> np.uint64(32)).astype(np.uint32)
    least = None
    for i in range(0, len(places), _STEP):
        part = _turned(places[i : i + _STEP, None] + _SHIFTS[None, :]).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    rows = coordinates.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix64(key * _A + rows[:, k])
    return key.view(np.int64)


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, node (a digest of the set, null if it is empty), bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, nodes, bands = [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), words)
                counts.append(len(found))
                nodes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                bands.append(band_keys(signature(found)) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n", "node", "bands"])

    return _docs(docs).mapInArrow(sign, "doc_id long, n long, node binary, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, found array<long>: the sets of the documents in ``wanted`` (doc_id, node)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), words) for t in batch.column(0)]
            nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            own = [i for i, node in enumerate(nodes) if node == batch.column(1)[i].as_py()]
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in own], pa.binary()), pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64()))], names=["node", "found"])

    rows = _docs(docs).join(wanted.select("doc_id", "node"), "doc_id").select("text", "node")
    return rows.mapInArrow(build, "node binary, found array<long>").dropDuplicates(["node"])


def components(edges: DataFrame, folder: str) -> DataFrame:
    """v, label: the smallest vertex that each vertex of ``edges`` (a, b) reaches.

    Each round a vertex takes the smallest label among its neighbours and then its label's label.
    """
    both = storage.written(edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u"))).distinct(), f"{folder}/edges")
    labels = storage.written(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("label")), f"{folder}/labels-0")
    n = 0
    while True:
        n += 1
        heard = both.join(labels.select(F.col("v").alias("u"), F.col("label").alias("of_u")), "u").groupBy("v").agg(F.min("of_u").alias("heard"))
        near = labels.join(heard, "v").select("v", "label", F.least("label", "heard").alias("near"))
        jump = labels.select(F.col("v").alias("near"), F.col("label").alias("far"))
        moved = near.join(jump, "near").select("v", "label", F.least("near", "far").alias("new"))
        moved = storage.written(moved.select("v", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("changed")), f"{folder}/labels-{n}")
        labels = moved.select("v", "label")
        if not moved.filter("changed").limit(1).count():
            return labels


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as ``percent``."""
    a, b = sets.select(F.col("node").alias("a"), F.col("found").alias("of_a")), sets.select(F.col("node").alias("b"), F.col("found").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    checked = pairs.join(a, "a").join(b, "b").select("a", "b", common.alias("common"), F.size("of_a").alias("n_a"), F.size("of_b").alias("n_b"))
    return checked.filter(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def rare_hash_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, n, label) with different labels, among them all that can be similar enough.

    Hashes are ordered by how many of these nodes have them, rare ones first. Two similar sets share a hash
    among the first few of each, and what follows the first shared one must be long enough for the overlap
    that the sizes ask for. In a group of near copies the first few are a copy's own changes, so copies that
    differ meet nowhere.
    """
    hashes = nodes.join(sets, "node").select("node", "n", "label", F.explode("found").alias("h"))
    common = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    listed = hashes.join(common, "h").groupBy("node", "n", "label").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("own"))
    placed = listed.select("node", "n", "label", (F.col("n") - F.size("own")).alias("before"), F.posexplode("own").alias("k", "e"))
    placed = placed.select("node", "n", "label", (F.col("before") + F.col("k")).alias("i"), F.col("e.h").alias("h")).filter(F.expr(f"i <= n - ceil({percent} * n / 100)"))
    x, y = placed, placed.select(F.col("node").alias("node_y"), F.col("n").alias("n_y"), F.col("label").alias("label_y"), F.col("i").alias("i_y"), "h")
    near = x.join(y, "h").filter(f"node < node_y AND label <> label_y AND 100 * least(n, n_y) >= {percent} * greatest(n, n_y) AND {100 + percent} * least(n - i, n_y - i_y) >= {percent} * (n + n_y)")
    return near.select(F.col("node").alias("a"), F.col("node_y").alias("b")).distinct()


def link_classes(members: DataFrame, sets: DataFrame, folder: str, percent: int) -> DataFrame | None:
    """node, label of the nodes in ``members`` (key, slot, slots, node, n, weight), linked ones with one label."""
    every_slot = F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot")
    labels: DataFrame | None = None
    links: DataFrame | None = None
    live = members
    tested: DataFrame | None = None
    for turn in range(CENTRES + 1):
        here = f"{folder}/round-{turn}"
        named = live.withColumn("label", F.col("node")) if labels is None else live.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        named = storage.written(named.select("key", "slot", "slots", "node", "n", "weight", "label"), f"{here}/named")
        spread = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("slots").alias("slots")).filter("low <> high").select("key", every_slot)
        open_members = storage.written(named.join(spread, ["key", "slot"]), f"{here}/open")
        if not open_members.limit(1).count():
            return labels
        if turn < CENTRES:
            centres = open_members.groupBy("key").agg(F.max(F.struct("weight", "node", "n", "label")).alias("c"), F.max("slots").alias("slots"))
            pairs = open_members.join(centres.select("key", "c", every_slot), ["key", "slot"]).filter(f"label <> c.label AND 100 * least(n, c.n) >= {percent} * greatest(n, c.n)").select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()
        else:
            pairs = rare_hash_pairs(open_members.select("node", "n", "label").distinct(), sets, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = storage.written(pairs, f"{here}/pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = verified(pairs, sets, percent)
        links = storage.written(found if links is None else links.unionByName(found), f"{here}/links")
        if links.limit(1).count():
            labels = components(links, f"{here}/components").withColumnRenamed("v", "node")
        if turn < CENTRES:
            live = open_members.select("key", "slot", "slots", "node", "n", "weight").join(centres.select("key", F.col("c.node").alias("node")), ["key", "node"], "left_anti")
    return labels


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    spark = docs.sparkSession
    folder = storage.work_dir(spark, "neardup")
    signed = storage.written(signatures(docs, words), f"{folder}/signed")
    with_set = signed.filter("node IS NOT NULL AND doc_id IS NOT NULL")
    classes = with_set.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = storage.written(classes, f"{folder}/classes")
    filed = classes.select(F.explode("bands").alias("key"), "node", "n")
    shared = filed.groupBy("key").agg(F.count(F.lit(1)).alias("nodes")).filter("nodes > 1")
    members = storage.written(filed.join(shared, "key").select("key", "node", "n", "nodes"), f"{folder}/filed")
    # how many nodes a node meets in all its buckets: the origin of a group of copies meets most
    weights = members.groupBy("node").agg(F.sum("nodes").alias("weight"))
    slots = F.ceil(F.col("nodes") / SLOT_NODES).cast("int")
    slot = F.pmod(F.xxhash64("node"), slots).cast("int").alias("slot")
    members = storage.written(members.join(weights, "node").select("key", slot, slots.alias("slots"), "node", "n", "weight"), f"{folder}/members")
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select(F.col("first_id").alias("doc_id"), "node")
    sets = storage.written(full_sets(docs, wanted, words), f"{folder}/sets")
    labels = link_classes(members, sets, folder, percent)
    # only classes with copies or links differ from their own document
    named = classes.select("node", "first_id", "copies")
    if labels is None:
        joined = named.filter("copies > 1").select("node", F.col("first_id").alias("component_id"))
    else:
        linked = labels.join(named, "node")
        least = linked.groupBy("label").agg(F.min("first_id").alias("component_id"))
        of_linked = linked.join(least, "label").select("node", "component_id")
        joined = of_linked.unionByName(named.filter("copies > 1").join(labels, "node", "left_anti").select("node", F.col("first_id").alias("component_id")))
    joined = storage.written(joined, f"{folder}/components")
    for name in ("classes", "filed", "members", "sets", *(f"round-{turn}" for turn in range(CENTRES + 1))):
        storage.drop_dir(spark, f"{folder}/{name}")
    out = signed.select("doc_id", "n", "node").join(joined, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents that are kept, with all their columns; a doc_id goes if none of its rows is kept."""
    verdict = near_duplicates(docs, words, percent).filter("doc_id IS NOT NULL")
    name = "gone"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    gone = verdict.groupBy("doc_id").agg(F.max("kept").alias("stays")).filter("NOT stays").select(F.col("doc_id").alias(name))
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")


#: DuckDB SQL for ``near_duplicates`` with four words.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
h AS (SELECT doc_id, n, hash(g) AS g FROM e),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edge AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT reach.v, edge.b FROM reach JOIN edge ON reach.r = edge.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT v, min(r) AS component_id FROM reach GROUP BY v) c ON c.v = s.doc_id
"""
