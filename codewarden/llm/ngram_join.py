"""N-gram Jaccard join on word shingles by chosen paths.

Documents with the same shingle set are one vertex.  In each run a set follows
paths of sampled tokens: at every level it enters the buckets of those of its
tokens whose hash lies below 1 / (threshold x size), so two sets above the
threshold are expected to share at least one bucket of the next level, while
unlike sets part.  A bucket is split while it is large, up to ``DEPTH`` levels;
then its members are compared with each other, in blocks.  Runs are repeated
until the target recall is met for pairs at the threshold in the deepest bucket.

Inside a bucket, size and a min-hash sketch (with a margin) choose candidates; a
pair belongs to the smallest bucket that both sets share, so it is decided once.
The sets of documents with candidates are then fetched, and similarities are
exact.  Tasks return one row per member with its number of links and the
smallest member it is connected to - never pairs - so a group of thousands of
near copies gives thousands of rows.  Counting all links of g different near
copies needs g * g / 2 comparisons, dealt out in blocks.

Classes alone (`classes`) need no counts: a comparison is skipped when both sets
are in one class by then.  A bucket's members are compared within their blocks
and with one member that is copied to all blocks; what is left are pairs of
members of a large bucket that are still in different classes, and one of the
two is outside the bucket's largest class.  A group of g near copies costs about
g comparisons.

* null text: empty; a text without words has no links and is its own class.
* texts of fewer than five words are one shingle of their words.
* ``class_id`` is the smallest id of the class, null if none of its rows has one.
* repeated rows are copies of each other and link like other equal texts.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_dir
from .common import decoded, keep_rows, row_key, runs, slices, steps, texts
from .graph import components
from .shingles import WORDS, mix, shingles

THRESHOLD = 0.8
RECALL = 0.99
DEPTH = 3
#: Buckets up to LIMIT members are not split; members are compared BLOCK by BLOCK.
LIMIT, BLOCK = 4096, 512
#: Shingles of all members of a block at most about this many; larger ones are cut further.
CELLS = 1 << 21
#: Members of a block where only classes are asked for: most pairs are settled by sizes, sketches and classes.
WIDE = 2048
#: Min-hash values of a sketch, and how far an estimate may fall below the threshold (over four deviations).
SKETCH, MARGIN = 48, 0.25

_LAST = (1 << 63) - 1
#: Low bits of a pick name its chooser (run x depth + level), the others are those of the token.
_CHOOSER = (1 << 16) - 1
VERTEX = "struct<id: long, node: binary>"


def runs_needed(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold is found with this probability.

    All paths of a run sample the same tokens at a level, and such a pair shares
    a Poisson number of them with mean 1 or more.  It meets in the deepest bucket
    if it shares one at every level; ``p`` is the chance of that in one run.
    """
    p = (1 - math.exp(-1)) ** depth
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def _odd(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


_SKETCHERS = _odd(SKETCH, 1)


def sketch(tokens: np.ndarray) -> bytes:
    """Low 16 bits of the min-hash values."""
    low = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(tokens), 2048):
        part = tokens[at : at + 2048, None] * _SKETCHERS
        np.minimum(low, part.min(axis=0), out=low)
    return mix(low).astype(np.uint16).tobytes()


def choose(tokens: np.ndarray, threshold: float, choosers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled tokens of all runs and levels: (number of the chooser, token)."""
    limit = np.uint64(min(1.0, 1 / (threshold * len(tokens))) * (2**32 - 1)) if len(tokens) else np.uint64(0)
    which, token = [], []
    for at in range(0, len(tokens), 2048):
        part = tokens[at : at + 2048]
        i, c = np.nonzero((part[:, None] * choosers) >> np.uint64(32) <= limit)
        which.append(c)
        token.append(part[i])
    return (np.concatenate(which), np.concatenate(token)) if which else (np.empty(0, np.int64), np.empty(0, np.uint64))


def _signatures(docs: DataFrame, threshold: float, n_runs: int, depth: int, words: int) -> DataFrame:
    choosers = _odd(n_runs * depth, 2)

    def run(batches):
        for batch in slices(batches):
            node, size, sketches, picks = [], [], [], []
            for (column,) in steps([batch.select(["_cw_text"])], 64):
                for raw in column:
                    tokens = shingles(decoded(raw), words)
                    which, token = choose(tokens, threshold, choosers)
                    node.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                    size.append(len(tokens))
                    sketches.append(sketch(tokens))
                    picks.append((token & ~np.uint64(_CHOOSER) | which.astype(np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(node, pa.binary()), pa.array(size, pa.int32()), pa.array(sketches, pa.binary()), pa.array(picks, pa.list_(pa.int64()))],
                ["doc_id", "key", "node", "size", "sketch", "picks"])

    return docs.mapInArrow(run, "doc_id long, key string, node binary, size int, sketch binary, picks array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for (column,) in steps([batch.select(["_cw_text"])], 64):
                sets = [shingles(decoded(raw), words) for raw in column]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "tokens"])

    return docs.select("_cw_text").mapInArrow(run, "node binary, tokens binary")


def leaves(nodes: DataFrame, depth: int = DEPTH, limit: int = LIMIT) -> DataFrame:
    """(leaf, members, node): the buckets whose members are compared, from ``picks`` of every node."""
    chooser = lambda p: p.bitwiseAND(F.lit(_CHOOSER)).cast("int")
    rows = (nodes.select("node", F.explode(F.filter("picks", lambda p: chooser(p) % depth == 0)).alias("p"))
            .select("node", F.xxhash64("p").alias("leaf"), F.floor(chooser(F.col("p")) / depth).cast("int").alias("run")))
    out = None
    for level in range(depth):
        # Buckets of one have nothing to compare; a written table of the others splits hot buckets in the join.
        shared = cut_lineage(rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"))
        rows = cut_lineage(rows.join(shared, "leaf"))
        last = level == depth - 1
        done = (rows if last else rows.filter(F.col("members") <= limit)).select("leaf", "members", "node")
        out = done if out is None else out.unionByName(done)
        if last or (large := rows.filter(F.col("members") > limit)).isEmpty():
            return out
        token = F.explode(F.filter("picks", lambda p: chooser(p) == F.col("run") * depth + level + 1))
        rows = (large.join(nodes.select("node", "picks"), "node").select("node", "leaf", "run", token.alias("p"))
                .select("node", F.xxhash64("leaf", "p").alias("leaf"), "run"))


BUCKET = ["leaf", "low", "high"]


def _parts(members: DataFrame, block: int, cells: int) -> DataFrame:
    """Buckets of several blocks: their number, and the bucket's first member."""
    load = members.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"), F.min("node").alias("pivot"))
    return cut_lineage(load.select("leaf", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("s") / cells)).cast("int").alias("parts"), "pivot").filter("parts > 1"))


def _part(of: str, seed: str) -> Column:
    return F.pmod(F.xxhash64("node", seed), F.col(of).cast("long")).cast("int")


def _blocks(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Copy each member to every pair of blocks that its own block is part of.

    ``part`` is its own block; a bucket within one block is a single group.
    """
    return (members.join(parts.drop("pivot"), "leaf", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", _part("parts", "leaf"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("parts", "other"))


def _diagonal(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Each member in its own block, and the bucket's first member in all of its blocks."""
    own = F.array(_part("parts", "leaf"))
    at = F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)
    return (members.join(parts, "leaf", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.explode(at))
            .withColumn("low", F.col("part")).withColumn("high", F.col("part")).drop("parts", "pivot"))


def _grouped(rows: DataFrame, function, schema: str) -> DataFrame:
    def run(batches):
        for group in runs(batches, BUCKET):
            if (out := function(group)) is not None:
                yield out

    return rows.repartition(*BUCKET).sortWithinPartitions(*BUCKET).mapInArrow(run, schema)


def _owned(group: pa.Table) -> np.ndarray:
    """Pairs (i, j) of a group that share no smaller bucket and meet in these blocks only."""
    leaf, low, high = (group[k][0].as_py() for k in BUCKET)
    m = group.num_rows
    part = group["part"].to_numpy()
    pairs = np.triu(np.ones((m, m), bool), 1)
    if "comp" in group.column_names:
        # Sides of a comparison between classes.
        comp = np.unique(group["comp"].to_numpy(), return_inverse=True)[1]
        pairs &= (part[:, None] != part[None, :]) & (comp[:, None] != comp[None, :])
    elif low != high:
        pairs &= part[:, None] != part[None, :]
    lists = group["leaves"].combine_chunks()
    flat = lists.flatten().to_numpy()
    owner = np.repeat(np.arange(m), np.diff(lists.offsets.to_numpy()))
    early = flat < leaf
    names, inverse, count = np.unique(flat[early], return_inverse=True, return_counts=True)
    if (count > 1).any():
        # Membership in the smaller buckets that at least two of the group share.
        column = np.cumsum(count > 1) - 1
        use = count[inverse] > 1
        member = np.zeros((m, int((count > 1).sum())), np.float32)
        member[owner[early][use], column[inverse[use]]] = 1
        pairs &= member @ member.T == 0
    return pairs


def _similar(size: np.ndarray, sketches: np.ndarray, threshold: float, margin: float) -> np.ndarray:
    """Pairs that size and sketch do not rule out."""
    good = np.empty((len(size), len(size)), bool)
    for at in range(0, len(size), 256):
        own = size[at : at + 256, None]
        part = np.minimum(own, size) >= threshold * np.maximum(own, size) - 1e-9
        same = np.zeros(part.shape, np.uint16)
        for k in range(sketches.shape[1]):
            same += sketches[at : at + 256, k, None] == sketches[None, :, k]
        good[at : at + 256] = part & (same >= (threshold - margin) * sketches.shape[1])
    return good


def _candidates(threshold: float, margin: float, across: bool = False):
    names = ["leaf", "low", "high", "part", "node", *(["comp"] if across else [])]
    schema = "leaf long, low int, high int, part int, node binary" + (", comp binary" if across else "")

    def function(group: pa.Table):
        size = group["size"].to_numpy().astype(np.float64)
        good = _similar(size, np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint16).reshape(len(size), -1), threshold, margin)
        np.fill_diagonal(good, False)
        if not good.any():
            return None
        good &= _owned(group)
        use = np.flatnonzero(good.any(axis=0) | good.any(axis=1))
        if not len(use):
            return None
        return group.select(names).take(pa.array(use)).combine_chunks().to_batches()[0]

    return function, schema


def _forest(threshold: float, margin: float):
    """Links that join classes: a pair is compared only while both sets are in different ones."""
    schema = "id long, node binary, low_id long, low_node binary"

    def function(group: pa.Table):
        m = group.num_rows
        sets = [np.frombuffer(t, np.uint64) for t in group["tokens"].to_pylist()]
        size = np.array([len(s) for s in sets], np.int64)
        pairs = _owned(group)
        pairs |= pairs.T
        pairs &= _similar(size, np.stack([np.frombuffer(sketch(s), np.uint16) for s in sets]), threshold, margin)
        own = group["comp"].to_numpy() if "comp" in group.column_names else np.array(group["node"].to_pylist(), object)
        comp = np.unique(own, return_inverse=True)[1]
        found: list[tuple[int, int]] = []
        for i in range(m):
            others = np.flatnonzero(pairs[i] & (comp != comp[i]))
            for at in range(0, len(others), 64):
                todo = others[at : at + 64]
                todo = todo[comp[todo] != comp[i]]
                if not len(todo):
                    continue
                cells = np.concatenate([sets[j] for j in todo])
                hit = sets[i][np.minimum(np.searchsorted(sets[i], cells), size[i] - 1)] == cells
                both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(size[todo])[:-1]]), dtype=np.int64)
                for j in todo[both >= threshold * (size[i] + size[todo] - both) - 1e-9].tolist():
                    if comp[j] != comp[i]:
                        found.append((i, j))
                        comp[comp == comp[j]] = comp[i]
        if not found:
            return None
        a, b = (pa.array([f[k] for f in found]) for k in (0, 1))
        t = group.select(["id", "node"])
        return pa.RecordBatch.from_arrays([x.combine_chunks() for side in (a, b) for x in t.take(side).columns], ["id", "node", "low_id", "low_node"])

    return function, schema


def _links(threshold: float):
    schema = "id long, node binary, links long, low_id long, low_node binary"

    def function(group: pa.Table):
        m = group.num_rows
        sets = [np.frombuffer(t, np.uint64) for t in group["tokens"].to_pylist()]
        size = np.array([len(s) for s in sets], np.int64)
        pairs = _owned(group)
        pairs &= np.minimum(size[:, None], size) >= threshold * np.maximum(size[:, None], size) - 1e-9
        names, cells = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        mark = np.zeros(len(names), np.int32)
        linked = np.zeros((m, m), bool)
        for i in np.flatnonzero(pairs.any(axis=1)):
            own = cells[starts[i] : starts[i] + size[i]]
            mark[own] = 1
            both = np.add.reduceat(mark[cells], starts)
            linked[i] = pairs[i] & (both >= threshold * (size[i] + size - both) - 1e-9)
            mark[own] = 0
        if not linked.any():
            return None
        linked |= linked.T
        copies = group["copies"].to_numpy()
        count = linked @ copies
        ids, nodes = group["id"].to_pylist(), group["node"].to_pylist()
        rank = sorted(range(m), key=lambda i: (ids[i], nodes[i]))
        low = np.full(m, -1)
        for i in rank:
            # Everything that can be reached from the smallest member not reached yet.
            front = np.array([i]) if low[i] < 0 else np.empty(0, np.int64)
            while len(front):
                low[front] = i
                front = np.flatnonzero(linked[front].any(axis=0) & (low < 0))
        use = np.flatnonzero(count > 0)
        return pa.RecordBatch.from_arrays(
            [pa.array([ids[i] for i in use], pa.int64()), pa.array([nodes[i] for i in use], pa.binary()), pa.array(count[use], pa.int64()),
             pa.array([ids[low[i]] for i in use], pa.int64()), pa.array([nodes[low[i]] for i in use], pa.binary())],
            ["id", "node", "links", "low_id", "low_node"])

    return function, schema


def _bucketed(docs: DataFrame, threshold: float, recall: float, words: int, depth: int, limit: int, id_col: str, text: str):
    """Texts; rows with their signatures; distinct sets; those in shared buckets; and the buckets' members."""
    d = docs.select(docs[id_col].try_cast("long").alias("doc_id"), row_key(id_col, text).alias("key"), texts(text).alias("_cw_text"))
    path = scratch_dir(docs.sparkSession, "signatures")
    _signatures(d, threshold, runs_needed(recall, depth), depth, words).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    copies = rows.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min(F.coalesce("doc_id", F.lit(_LAST))).alias("id"), F.max("size").alias("size"))
    copies = cut_lineage(copies)
    nodes = rows.filter("size > 0").select("node", "sketch", "picks").dropDuplicates(["node"])
    buckets = cut_lineage(leaves(nodes, depth, limit))

    lists = buckets.groupBy("node").agg(F.collect_list("leaf").alias("leaves"))
    known = cut_lineage(copies.join(lists, "node"))
    sketches = rows.select("node", "sketch").join(known.select("node"), "node", "left_semi").dropDuplicates(["node"])
    return d, rows, copies, known, buckets.join(known.select("node", "size", "leaves"), "node").join(sketches, "node")


def _full(d: DataFrame, known: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """Sets of documents with candidates only, found by one id of each."""
    wanted = cut_lineage(known.join(chosen.select("node").distinct(), "node", "left_semi"))
    ids = wanted.select(F.col("id").alias("_cw_id")).distinct()
    sets = _sets(d.withColumn("_cw_id", F.coalesce("doc_id", F.lit(_LAST))).join(ids, "_cw_id", "left_semi"), words).dropDuplicates(["node"])
    return wanted.join(sets, "node")


def _vertex(node_id: str, node: str) -> Column:
    return F.struct(F.col(node_id).alias("id"), F.col(node).alias("node"))


def _names(edges: DataFrame) -> DataFrame:
    """(node, low_id, low_node): the class of every set that has links."""
    named = components(edges.select(_vertex("id", "node").alias("a"), _vertex("low_id", "low_node").alias("b")))
    return named.select(F.col("v.node").alias("node"), F.col("component.id").alias("low_id"), F.col("component.node").alias("low_node"))


def _united(named: DataFrame, more: DataFrame) -> DataFrame:
    """Classes (node, low_id, low_node) after links between them; only the classes that are linked move."""
    of = lambda side: named.select(F.col("node").alias(side), F.col("low_id").alias(f"{side}_id"), F.col("low_node").alias(f"{side}_low"))
    both = more.join(of("_a"), F.col("node") == F.col("_a"), "left").join(of("_b"), F.col("low_node") == F.col("_b"), "left")
    top = _names(both.select(F.coalesce("_a_id", "id").alias("id"), F.coalesce("_a_low", "node").alias("node"),
                             F.coalesce("_b_id", "low_id").alias("low_id"), F.coalesce("_b_low", "low_node").alias("low_node")))
    top = cut_lineage(top.select(F.col("node").alias("_top"), F.col("low_id").alias("_id"), F.col("low_node").alias("_low")))
    moved = named.join(top, F.col("low_node") == F.col("_top"), "left").select("node", F.coalesce("_id", "low_id").alias("low_id"), F.coalesce("_low", "low_node").alias("low_node"))
    alone = top.join(named, F.col("_top") == F.col("node"), "left_anti")
    return moved.unionByName(alone.select(F.col("_top").alias("node"), F.col("_id").alias("low_id"), F.col("_low").alias("low_node")))


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS, depth: int = DEPTH, limit: int = LIMIT,
         block: int = BLOCK, margin: float = MARGIN, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (doc_id, class_id, n_links, copies, root, key).

    ``n_links`` counts the other documents whose shingle sets have at least this
    Jaccard similarity, ``copies`` the documents with the same set.  ``root``
    names the class also where it has no id, ``key`` the row by id and text.
    """
    d, rows, copies, known, members = _bucketed(docs, threshold, recall, words, depth, limit, id_col, text)
    chosen = cut_lineage(_grouped(_blocks(members, _parts(members, block, CELLS)), *_candidates(threshold, margin)))
    found = cut_lineage(_grouped(chosen.join(_full(d, known, chosen, words), "node"), *_links(threshold)))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = copies.join(links, "node", "left").join(_names(found), "node", "left")
    classes = cut_lineage(classes.select("node", "copies", F.nullif(F.coalesce("low_id", "id"), F.lit(_LAST)).alias("class_id"),
                                         F.coalesce("low_node", "node").alias("root"),
                                         F.when(F.col("size") > 0, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0).alias("n_links"),
                                         (F.col("size") > 0).alias("has_words")))
    # Texts without words are not alike.
    with_words = lambda a, b: F.when(F.col("has_words"), a).otherwise(b)
    return (rows.select("doc_id", "key", "node").join(classes, "node")
            .select("doc_id", with_words(F.col("class_id"), F.col("doc_id")).alias("class_id"), "n_links", with_words(F.col("copies"), F.lit(1)).alias("copies"),
                    with_words(F.hex("root"), F.col("key")).alias("root"), "key"))


def _between(members: DataFrame, parts: DataFrame, classes: DataFrame, block: int, cells: int) -> DataFrame | None:
    """Members of large buckets in pairs of blocks: those outside the bucket's largest class with all; None if there are none."""
    light = members.select("leaf", "node", "size").join(parts.drop("pivot"), "leaf").join(classes, "node", "left")
    light = cut_lineage(light.select("leaf", "node", "size", "parts", F.coalesce("low_node", "node").alias("comp")))
    lead = light.groupBy("leaf", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("leaf").agg(F.max(F.struct("n", "comp"))["comp"].alias("lead"))
    others = cut_lineage(light.join(lead, "leaf").filter("comp <> lead").drop("lead"))
    if others.isEmpty():
        return None
    load = others.groupBy("leaf").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / cells)).cast("int").alias("rest"))
    load = cut_lineage(load)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = others.join(load, "leaf").withColumn("part", F.lit(0)).withColumn("low", _part("rest", "leaf")).withColumn("high", every("parts"))
    two = light.join(load, "leaf").withColumn("part", F.lit(1)).withColumn("high", _part("parts", "leaf")).withColumn("low", every("rest"))
    return one.unionByName(two).drop("parts", "rest", "size")


def classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS, depth: int = DEPTH, limit: int = LIMIT,
            block: int = WIDE, margin: float = MARGIN, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, root, key) per document: the classes of `join`, without counting links."""
    d, rows, copies, known, members = _bucketed(docs, threshold, recall, words, depth, limit, id_col, text)
    parts = _parts(members, block, CELLS)
    chosen = cut_lineage(_grouped(_diagonal(members, parts), *_candidates(threshold, margin)))
    edges = cut_lineage(_grouped(chosen.join(_full(d, known, chosen, words), "node"), *_forest(threshold, margin)))
    named = _names(edges)
    if not parts.isEmpty() and (rest := _between(members, parts, named, block, CELLS)) is not None:
        whole = rest.join(members.select("node", "size", "leaves", "sketch").dropDuplicates(["node"]), "node")
        chosen = cut_lineage(_grouped(whole, *_candidates(threshold, margin, True)))
        more = cut_lineage(_grouped(chosen.join(_full(d, known, chosen, words), "node"), *_forest(threshold, margin)))
        if not more.isEmpty():
            named = _united(cut_lineage(named), more)
    roots = cut_lineage(copies.join(named, "node", "left").select("node", F.coalesce("low_node", "node").alias("root"), (F.col("size") > 0).alias("has_words")))
    return (rows.select("doc_id", "key", "node").join(roots, "node")
            .select("doc_id", F.when(F.col("has_words"), F.hex("root")).otherwise(F.col("key")).alias("root"), "key"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay when each class keeps its smallest id (null last), with all columns."""
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    found = classes(docs, id_col=id_col, text=text, **options)
    stay = found.groupBy("root").agg(best.alias("best")).select(F.col("best.key").alias("_cw_key"))
    return keep_rows(docs, stay, id_col, text)
