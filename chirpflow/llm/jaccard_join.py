"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

A text is the set of its five-word shingles; equal sets are one class. A class has a
signature of TREES x DEEPEST minhashes. A tree of the forest is the prefix trie of one
part of the signatures: two classes are under one node of depth d if the first d
minhashes agree. The matched prefix starts at the deepest and is shortened as the data
ask for it: classes that meet are verified exactly, the similarities of the links found
tell how many links of each similarity a prefix of that length misses (a link of
similarity s is met with probability 1 - (1 - s^d)^TREES), and the longest prefix whose
estimated recall reaches the target is searched next, until the estimate holds.

Only classes under one node are verified. A node whose members all lie under one node
of another tree as well is left to that one, and a pair that meets under several nodes
is counted under the first. A node with many members is dealt out as pairs of blocks of
similar set sizes (sizes of linked sets differ by at most 1/threshold). No pair list is
made: a block returns per class its number of links and a spanning tree.

Defined results: texts with equal shingle sets form one class (class_id: its smallest
doc_id); n_links counts the other documents at or above the threshold, copies
included; group_id is the smallest doc_id that links lead to. A text of one to four
words has one shingle, all its words; null, empty and blank texts have none, link to
nothing and are classes of their own. Repeated rows, rows that share a doc_id and rows
without one are documents like others (class_id and group_id are null only where no
document of the class or group has a doc_id). An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpflow.llm.common import SPACE_CHARS, bytes_list, give_back, rebatched
from chirpflow.llm.ledger import mixed
from chirpflow.session import read_table, scratch_path, written

SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
#: Longest and shortest prefix that is matched.
DEEPEST, SHORTEST = 8, 3
RECALL = 0.9995
#: Similarities of links are counted in so many bins between 0 and 1.
SIMILARITY_BINS = 400
#: Classes per side of a verified block, and shingle columns per matrix product.
BLOCK = 1500
COLUMNS = 4096
BATCH_BYTES = 8 << 20
KEY_ROWS = 8192


def met(similarity: np.ndarray, depth: int, trees: int) -> np.ndarray:
    """Chance that a pair agrees on the first ``depth`` minhashes of some tree."""
    return 1 - (1 - np.asarray(similarity, dtype=np.float64) ** depth) ** trees


def estimated_recall(found: np.ndarray, searched: int, depth: int, trees: int) -> float:
    """Share of the links that a search at ``depth`` meets, judged by the links that one at ``searched``
    found (``found``: their number per bin of similarity): each stands for 1 / its chance of being met."""
    middle = (np.arange(SIMILARITY_BINS) + 0.5) / SIMILARITY_BINS
    total = found / np.maximum(met(middle, searched, trees), 1e-12)
    return float((total * met(middle, depth, trees)).sum() / total.sum()) if total.sum() else 1.0


def next_depth(found: np.ndarray, searched: int, trees: int, recall: float) -> int:
    """The longest prefix that is estimated to reach the recall (``searched`` itself if it does)."""
    for depth in range(searched, SHORTEST, -1):
        if estimated_recall(found, searched, depth, trees) >= recall:
            return depth
    return SHORTEST


_ODD = np.random.RandomState(11).randint(1, 2**62, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - width + 1)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(min(width, len(h))):
        total += mixed(h[k : k + n]) * _ODD[k]
    return np.unique(mixed(total + np.uint64(min(width, len(h)))))


def signature(found: np.ndarray, trees: int = TREES, depth: int = DEEPEST) -> np.ndarray:
    """The trees x depth minhashes of a shingle set (the upper 32 bits of each)."""
    seeds = mixed(np.arange(1, trees * depth + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    least = np.full(trees * depth, np.uint64(2**64 - 1))
    for i in range(0, len(found), 2048):
        part = found[i : i + 2048]
        scrambled = part[None, :] * seeds[:, None]
        scrambled ^= scrambled >> np.uint64(32)
        scrambled *= np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, scrambled.min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def node_keys(signatures: np.ndarray, depth: int) -> np.ndarray:
    """Keys of the trie nodes at ``depth``: [classes, trees] from [classes, trees, minhashes]."""
    keys = np.arange(1, signatures.shape[1] + 1, dtype=np.uint64)[None, :].repeat(len(signatures), axis=0)
    for d in range(depth):
        keys = mixed(keys * _ODD[d] + signatures[:, :, d].astype(np.uint64))
    return keys.view(np.int64)


def _digest(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def signatures(docs: DataFrame, trees: int) -> DataFrame:
    """doc_id, digest of the shingle set (null if empty) and of the text, signature; written once."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, BATCH_BYTES, 1):
            digest, sigs, texts = [], [], []
            for t in bytes_list(batch.column(1)):
                s = shingles(t or b"")
                digest.append(_digest(s))
                sigs.append(signature(s, trees).tobytes() if len(s) else None)
                texts.append(None if t is None else hashlib.md5(t).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.binary()) for x in (digest, texts, sigs)]], ["doc_id", "digest", "text_md5", "sig"]
            )
        give_back()

    schema = f"doc_id {id_type}, digest binary, text_md5 binary, sig binary"
    return written(docs.select("doc_id", "text").mapInArrow(run, schema), "forest")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of edges (a, b): root is the smallest node.

    Each round every node points to the neighbour that comes first in a random (hashed)
    order, and the edges are contracted along the pointers; a constant share of the
    nodes goes each round, also on long chains. Rounds are cut by tables in the shared
    scratch folder.
    """
    spark = edges.sparkSession

    def saved(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "components")
        df.write.parquet(path)
        return spark.read.parquet(path)

    edges = saved(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min_by("b", F.xxhash64("b")).alias("b"))
        step = saved(
            first.select(
                F.col("a").alias("node"),
                F.when(F.xxhash64("b") < F.xxhash64("a"), F.col("b")).otherwise(F.col("a")).alias("to"),
            )
        )
        if labels is None:
            labels = step.select("node", F.col("to").alias("root"))
        else:
            hop = step.select(F.col("node").alias("root"), "to")
            labels = saved(labels.join(hop, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        sa, sb = (step.select(F.col("node").alias(c), F.col("to").alias(f"t{c}")) for c in "ab")
        edges = saved(
            edges.join(sa, "a").join(sb, "b").where(F.col("ta") != F.col("tb"))
            .select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct()
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    return labels.join(least, "root").select("node", F.col("least").alias("root"))


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """[left, right] sizes of the intersections of sorted distinct arrays."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    if len(left) * len(right) <= 4:
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                out[i, j] = len(np.intersect1d(x, y, assume_unique=True))
        return out
    lv, rv = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(lv, rv)
    li, ri = (np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right))
    lc, rc = np.searchsorted(shared, lv), np.searchsorted(shared, rv)
    lc[lc == len(shared)] = 0
    rc[rc == len(shared)] = 0
    lk, rk = shared[lc] == lv if len(shared) else np.zeros(len(lv), bool), shared[rc] == rv if len(shared) else np.zeros(len(rv), bool)
    li, lc, ri, rc = li[lk], lc[lk], ri[rk], rc[rk]
    for at in range(0, len(shared), COLUMNS):
        width = min(COLUMNS, len(shared) - at)
        m, n = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        a, b = (lc >= at) & (lc < at + width), (rc >= at) & (rc < at + width)
        m[li[a], lc[a] - at] = 1
        n[ri[b], rc[b] - at] = 1
        out += m @ n.T
    return out


def similarities(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarity of each pair."""
    common = common_counts(left, right).astype(np.float64)
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    return common / (sizes - common)


def _spanning(adjacent: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each row of a symmetric adjacency matrix."""
    root = np.arange(len(adjacent))
    while True:
        best = np.minimum(root, np.where(adjacent, root[None, :], len(root)).min(axis=1))
        best = best[best]
        if (best == root).all():
            return root
        root = best


def _under_one_node(a: np.ndarray, b: np.ndarray, trees: int) -> np.ndarray:
    """Whether classes share a node in one of the first ``trees`` trees (key 0: no node)."""
    out = np.zeros((len(a), len(b)), dtype=bool)
    for t in range(trees):
        out |= (a[:, t][:, None] == b[:, t][None, :]) & (a[:, t] != 0)[:, None]
    return out


def verify_block(
    sets: list[np.ndarray], side: np.ndarray, keys: np.ndarray, before: np.ndarray, tree: int, weight: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Verify the pairs of one block that meet here first (``side`` 2: pairs within, 0 and 1: pairs across).

    -> the classes with links, the documents linked to each, their roots in spanning trees (all as
    positions in the block), and the similarity of every linked pair."""
    within = bool((side == 2).all())
    a = np.arange(len(sets)) if within else np.flatnonzero(side == 0)
    b = a if within else np.flatnonzero(side == 1)
    new = ~_under_one_node(keys[a], keys[b], tree) & ~_under_one_node(before[a], before[b], before.shape[1])
    if within:
        new &= a[:, None] < b[None, :]
    rows, cols = np.flatnonzero(new.any(axis=1)), np.flatnonzero(new.any(axis=0))
    none = np.empty(0, dtype=np.int64)
    if not len(rows):
        return none, none, none, np.empty(0)
    near = similarities([sets[i] for i in a[rows]], [sets[i] for i in b[cols]])
    hit = new[np.ix_(rows, cols)] & (near >= threshold - 1e-9)
    if not hit.any():
        return none, none, none, np.empty(0)
    adjacent = np.zeros((len(sets), len(sets)), dtype=bool)
    adjacent[np.ix_(a[rows], b[cols])] = hit
    adjacent |= adjacent.T
    has = np.flatnonzero(adjacent.any(axis=1))
    return has, (adjacent @ weight)[has], _spanning(adjacent)[has], near[hit]


def _with_keys(classes: DataFrame, depth: int, last: int | None, trees: int) -> DataFrame:
    """digest, keys of the nodes at ``depth`` and, packed, at the depth that was searched last (0: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, KEY_ROWS):
                part = batch.slice(start, KEY_ROWS)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint32).reshape(part.num_rows, trees, -1)
                keys = node_keys(sig, depth)
                before = node_keys(sig, last) if last else np.zeros_like(keys)
                ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * trees)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(ends, pa.array(keys.ravel())), pa.array([x.tobytes() for x in before], pa.binary())],
                    ["digest", "keys", "before"],
                )

    return classes.select("digest", "sig").mapInArrow(run, "digest binary, keys array<long>, before binary")


def _nodes(keyed: DataFrame, trees: int) -> DataFrame:
    """digest, tree, key, n of all places under nodes that no node of another tree makes superfluous."""
    places = keyed.select("digest", "keys", F.posexplode("keys").alias("tree", "key"))
    shared = places.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    shared = written(shared, "forest-shared")
    inside = written(places.join(shared, ["tree", "key"]), "forest-places")
    # sizes of a class's nodes in all trees, by the class (0: alone)
    sizes = inside.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("tree", "n"))).alias("sizes"))
    each = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.coalesce(F.try_element_at("sizes", t), F.lit(0)))
    inside = inside.join(sizes.select("digest", each.alias("all")), "digest")
    # all members of the node lie under one node of tree t, which is larger, or as large and earlier
    alike = [F.min(F.col("keys")[t]).alias(f"lo{t}") for t in range(trees)] + [F.max(F.col("keys")[t]).alias(f"hi{t}") for t in range(trees)]
    facts = inside.groupBy("tree", "key").agg(F.first("n").alias("n"), F.first("all").alias("all"), *alike)
    covered = F.lit(False)
    for t in range(trees):
        larger = (F.col("all")[t] > F.col("n")) | ((F.col("all")[t] == F.col("n")) & (F.lit(t) < F.col("tree")))
        covered = covered | ((F.col(f"lo{t}") == F.col(f"hi{t}")) & larger & (F.col("tree") != t))
    kept = facts.where(~covered).select("tree", "key")
    return inside.join(kept, ["tree", "key"]).select("digest", "tree", "key", "n")


def _verified(keyed: DataFrame, sets: DataFrame, threshold: float, trees: int) -> DataFrame:
    """Links among the classes that meet under a node and met under none at the depth searched before."""
    nodes = written(_nodes(keyed, trees), "forest-nodes")
    mine = nodes.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("tree", "key"))).alias("mine"))
    own = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.coalesce(F.try_element_at("mine", t), F.lit(0).cast("long")))
    classes = mine.select("digest", own.alias("own")).join(keyed.select("digest", "before"), "digest").join(sets, "digest")
    # a node with many members is cut by size of set (a factor of 1 / threshold a step) and then by hash
    step = F.floor(F.log(F.length("shingles") / 8) / float(np.log(1 / threshold) + 1e-9)).cast("int")
    rows = nodes.join(classes.withColumn("step", step), "digest")
    hot = nodes.where(F.col("n") > BLOCK).join(classes.select("digest", step.alias("step")), "digest")
    hot = hot.groupBy("tree", "key", "step").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    hot = hot.groupBy("tree", "key").agg(F.map_from_entries(F.collect_list(F.struct("step", "parts"))).alias("parts"))
    rows = rows.join(F.broadcast(hot), ["tree", "key"], "left")  # at most classes x trees / BLOCK rows
    of = lambda s: F.coalesce(F.try_element_at("parts", s), F.lit(0))
    here = F.struct(F.col("step").alias("s"), F.pmod(F.xxhash64("digest"), F.greatest(of(F.col("step")), F.lit(1))).cast("int").alias("k"))
    around = F.flatten(
        F.transform(
            F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1),
            lambda s: F.transform(F.when(of(s) > 0, F.sequence(F.lit(0), of(s) - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(s.alias("s"), k.alias("k"))),
        )
    )
    meet = F.transform(
        "around",
        lambda o: F.struct(
            F.least(o, F.col("here")).alias("i"), F.greatest(o, F.col("here")).alias("j"),
            F.when(o == F.col("here"), 2).when(F.col("here") < o, 0).otherwise(1).alias("side"),
        ),
    )
    nowhere = F.struct(F.lit(0).alias("s"), F.lit(0).alias("k"))
    small = F.array(F.struct(nowhere.alias("i"), nowhere.alias("j"), F.lit(2).alias("side")))
    rows = rows.withColumns({"here": here, "around": around})
    rows = rows.withColumn("p", F.explode(F.when(F.col("parts").isNull(), small).otherwise(meet)))
    # small nodes share a group with others, a block pair of a large one is a group of its own
    several = 8 * int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    node = F.xxhash64("tree", "key", "p.i", "p.j")
    packed = rows.select(
        F.when(F.col("parts").isNull(), F.pmod(node, F.lit(several))).otherwise(node).alias("block"), node.alias("node"),
        "tree", "p.side", "digest", "weight", "own", "before", "shingles",
    )

    def check(batch: pa.Table) -> pa.Table:
        node = batch.column("node").to_numpy()
        digest = np.array(batch.column("digest").to_pylist(), dtype=object)
        order = np.lexsort((digest.astype("S16"), node))
        edges = np.flatnonzero(np.concatenate([[True], np.diff(node[order]) != 0, [True]]))
        sets = [np.frombuffer(x, dtype=np.uint64) for x in batch.column("shingles").to_pylist()]
        own = batch.column("own").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        before = np.frombuffer(b"".join(batch.column("before").to_pylist()), dtype=np.int64).reshape(len(node), -1)
        side, tree, weight = (batch.column(c).to_numpy() for c in ("side", "tree", "weight"))
        out: list[list] = [[], [], []]
        found = np.zeros(SIMILARITY_BINS, dtype=np.int64)
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            at = order[s:e]
            if e - s < 2:
                continue
            has, links, root, near = verify_block([sets[i] for i in at], side[at], own[at], before[at], int(tree[at[0]]), weight[at], threshold)
            out[0] += digest[at[has]].tolist()
            out[1] += links.tolist()
            out[2] += digest[at[root]].tolist()
            found += np.bincount(np.minimum((near * SIMILARITY_BINS).astype(np.int64), SIMILARITY_BINS - 1), minlength=SIMILARITY_BINS)
        bins = np.flatnonzero(found)
        return pa.table({
            "digest": pa.array(out[0] + [None] * len(bins), pa.binary()), "links": pa.array(out[1] + found[bins].tolist(), pa.int64()),
            "root": pa.array(out[2] + [None] * len(bins), pa.binary()), "bin": pa.array([-1] * len(out[0]) + bins.tolist(), pa.int32()),
        })

    checked = packed.groupBy("block").applyInArrow(check, "digest binary, links long, root binary, bin int")
    return written(checked, "forest-links")


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """digest, weight, shingles of the wanted classes (doc_id and text_md5 name a document of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, BATCH_BYTES, 0):
            found = [shingles(t or b"").tobytes() for t in bytes_list(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.binary())], ["digest", "weight", "shingles"])
        give_back()

    w = wanted.select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5"), "digest", "weight")
    md5 = F.unhex(F.md5(F.col("text").cast("binary")))
    found = docs.select("doc_id", "text").join(w, F.col("doc_id").eqNullSafe(F.col("_id")) & (md5 == F.col("_md5")))
    sets = found.select("text", "digest", "weight").mapInArrow(run, "digest binary, weight long, shingles binary")
    # a document whose row is repeated gives its set once
    return written(sets.dropDuplicates(["digest"]), "forest-sets")


def joined_rows(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """doc_id, text_md5, digest, class_id, n_links, group_id and group (digest of its first class) per row."""
    sigs = signatures(docs, trees)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_md5"))
    classes = written(
        sigs.where(F.col("digest").isNotNull()).groupBy("digest")
        .agg(first.alias("f"), F.count(F.lit(1)).alias("weight"), F.first("sig").alias("sig"))
        .select("digest", "f.doc_id", "f.text_md5", "weight", "sig"),
        "forest-classes",
    )
    # no other class is ever compared: those under a shared node at the shortest prefix
    shortest = _with_keys(classes, SHORTEST, None, trees).select("digest", F.posexplode("keys").alias("tree", "key"))
    crowded = shortest.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    some = shortest.join(crowded, ["tree", "key"], "left_semi").select("digest").distinct()
    near = written(classes.join(some, "digest"), "forest-near")
    sets = _shingle_sets(docs, near)
    rounds: list[DataFrame] = []
    found = np.zeros(SIMILARITY_BINS)
    depth, last = DEEPEST, None
    while True:
        keyed = written(_with_keys(near, depth, last, trees), "forest-keys")
        links = _verified(keyed, sets, threshold, trees)
        rounds.append(links.where("bin = -1"))
        for r in links.where("bin >= 0").groupBy("bin").agg(F.sum("links").alias("n")).collect():  # at most SIMILARITY_BINS
            found[r["bin"]] += r["n"]
        then = next_depth(found, depth, trees, recall)
        if then == depth:
            break
        depth, last = then, depth
    links = rounds[0]
    for more in rounds[1:]:
        links = links.unionByName(more)
    per = links.groupBy("digest").agg(F.sum("links").alias("links"))
    groups = components(links.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    table = (
        classes.select("digest", F.col("doc_id").alias("class_id"), "weight").join(per, "digest", "left")
        .join(groups.select(F.col("node").alias("digest"), F.col("root").alias("group")), "digest", "left")
        .withColumn("group", F.coalesce("group", "digest"))
    )
    table = written(table, "forest-table")
    heads = table.groupBy("group").agg(F.min("class_id").alias("group_id"))
    table = table.join(heads, "group")
    # a class of copies is one row, the copies may be a third of all: AQE splits that key
    out = sigs.select("doc_id", "text_md5", "digest").join(table, "digest", "left")
    alone = F.col("weight").isNull()
    return out.select(
        "doc_id", "text_md5", "digest", "group",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("weight") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"),
    )


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, group_id for every row of docs (doc_id, text)."""
    return joined_rows(docs, threshold, trees, recall).select("doc_id", "class_id", "n_links", "group_id")


def one_per_group(docs: DataFrame) -> DataFrame:
    """One document of each group, all columns: the smallest doc_id (without doc_id last), then the text's
    digest decide. Texts without a word are groups of their own and all stay."""
    blank = F.coalesce(F.btrim("text", F.lit(SPACE_CHARS)) == "", F.lit(True))
    rows = joined_rows(docs).where(F.col("digest").isNotNull())
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_md5")).alias("f")
    keep = rows.groupBy("group").agg(first).select(F.col("f.doc_id").alias("_id"), F.col("f.text_md5").alias("_md5"))
    md5 = F.unhex(F.md5(F.col("text").cast("binary")))
    names = docs.columns
    kept = docs.where(~blank).withColumn("_text_md5", md5).join(
        keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_md5") == F.col("_md5")), "left_semi"
    )
    # rows that repeat doc_id and text are one document
    return kept.dropDuplicates(["doc_id", "_text_md5"]).select(*names).unionByName(docs.where(blank))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_table(spark, sf_dir, "documents"))
