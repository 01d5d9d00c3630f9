"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by *membership pattern* (the set of sources they belong to).
Token capacity flows from patterns to the sources they are members of; a source takes
its quota. The first use of a pattern's tokens is free, the second costs 1 a token, the
third 2 (convex repetition costs), so the cheapest flow repeats as little as possible.
Documents are then selected in a seeded order until each pattern's flow is met.

Sources and patterns are tables, as many as there are: sizes, ranks, weights and the
rounds that share out the targets are Spark aggregates. A source that shares no
document with another one has a single arc, so its flow is its quota. Only patterns
that touch an overlap compete; their graph (patterns, not documents) is solved on the
driver, and more than MAX_PATTERNS of *them* raise an error.

Defined results: a null source is a source of its own, last in order; a null or blank
text has size 0 and is never taken; a document of no source is never taken; repeated
rows, rows that share a doc_id and rows without one are separate documents; an empty
table gives no rows; other columns are ignored. The same input and seed give the same
mix, whatever the partitioning.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from chirpflow.llm.common import word_array
from chirpflow.operators.joins import small_side_join
from chirpflow.operators.ranks import numbered
from chirpflow.session import read_table, written

MAX_USES = 3
SEED = 17
#: Documents of a pattern are dealt by hash into so many cells, twice over, to find
#: the place in the seeded order where a quota is met.
CELLS = 4096
#: Patterns that touch an overlap of sources: their flow is solved on the driver.
MAX_PATTERNS = 200_000
#: Patterns of a plan that is broadcast to the documents (about 100 bytes each); a larger one is joined by a shuffle.
BROADCAST_PATTERNS = 100_000
#: Copies of one row that a task makes at once.
COPIES_AT_ONCE = 1000


def source_targets(sizes: DataFrame, total: float, weights: dict | None = None, most: float = MAX_USES) -> DataFrame:
    """(tag, source_size, target) of every source of ``sizes`` (tag, size), sharing ``total`` words.

    Targets are in proportion to weights (by rank of the tag 1, 2, 3, repeating, unless
    ``weights`` names the source) and none is above ``most`` times its source's size; the excess
    is shared again by weight among the others until none is above. One aggregate a round."""
    ranked = numbered(sizes, [], [F.col("tag").asc()], "rank")
    weight = (1 + (F.col("rank") - 1) % 3).cast("double")
    for name, w in (weights or {}).items():
        weight = F.when(F.col("tag") == name, F.lit(float(w))).otherwise(weight)
    table = written(ranked.select("tag", "size", weight.alias("weight"), F.lit(False).alias("full")), "mix-sources")
    rest = float(total)
    while True:
        open_ = table.where("not full").agg(F.sum("weight")).first()[0]
        share = F.lit(rest) * F.col("weight") / F.lit(open_) if open_ else F.lit(0.0)
        above = ~F.col("full") & (share > most * F.col("size"))
        new = table.where(above).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).first()
        if not new["rows"]:
            break
        table = written(table.withColumn("full", F.col("full") | above), "mix-sources")
        rest = max(rest - most * float(new["n"]), 0.0)
    target = F.when(F.col("full"), most * F.col("size").cast("double")).otherwise(share)
    return written(table.select("tag", F.col("size").alias("source_size"), target.alias("target")), "mix-targets")


def min_cost_flow(patterns: dict[tuple, int], quotas: dict, uses: int = MAX_USES) -> dict[tuple, dict]:
    """Tokens each pattern sends to each of its sources: the cheapest flow that fills the
    quotas as far as possible.

    All costs stand on the arcs out of the origin and are the same at each level of
    repetition, so successive shortest paths exhaust level 1 before level 2 before
    level 3: each level adds its capacity and augments until no path is left.
    """
    flow: dict[tuple, dict] = {p: {} for p in patterns}
    left = dict(quotas)
    spare = {p: 0 for p in patterns}
    by_source: dict = {s: [] for s in quotas}
    for p in patterns:
        for s in p:
            by_source[s].append(p)
    for _ in range(uses):
        for p, n in patterns.items():
            spare[p] += n
        for p in patterns:  # direct paths first
            for s in p:
                x = min(spare[p], left[s])
                if x > 0:
                    flow[p][s] = flow[p].get(s, 0) + x
                    spare[p] -= x
                    left[s] -= x
        starts = deque(p for p in patterns if spare[p] > 0)
        while starts:  # paths that move flow of other patterns out of the way
            start = starts[0]
            if spare[start] <= 0 or not _augment(start, flow, spare, left, by_source):
                starts.popleft()
    return flow


def _augment(start: tuple, flow: dict, spare: dict, left: dict, by_source: dict) -> bool:
    """One shortest augmenting path pattern -> source -> pattern -> ... -> unfilled source."""
    came: dict = {}  # source -> pattern that reaches it
    path_from: dict = {}  # pattern -> source whose tokens it could give up
    seen = {start}
    queue = deque([start])
    while queue:
        p = queue.popleft()
        for s in p:
            if s in came:
                continue
            came[s] = p
            if left[s] > 0:
                path, at = [], s
                while True:
                    owner = came[at]
                    path.append((owner, at))
                    if owner == start:
                        break
                    at = path_from[owner]
                amount = min(spare[start], left[s], *[flow[o][path[i + 1][1]] for i, (o, _) in enumerate(path[:-1])])
                for i, (owner, to) in enumerate(path):
                    flow[owner][to] = flow[owner].get(to, 0) + amount
                    if i + 1 < len(path):
                        flow[owner][path[i + 1][1]] -= amount
                spare[start] -= amount
                left[s] -= amount
                return True
            for other in by_source[s]:
                if other not in seen and flow[other].get(s, 0) > 0:
                    seen.add(other)
                    path_from[other] = s
                    queue.append(other)
    return False


def _cells(rows: DataFrame, cell: Column) -> DataFrame:
    """Per pattern and cell: tokens in it (``in_cell``) and in earlier cells (``before``)."""
    cells = rows.groupBy("pattern", cell.alias("cell")).agg(F.sum("size").alias("in_cell"))
    order = Window.partitionBy("pattern").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("before", F.coalesce(F.sum("in_cell").over(order), F.lit(0)))


def select_documents(sized: DataFrame, remainders: DataFrame, seed: int = SEED) -> DataFrame:
    """Rows (key, pattern, size) of each pattern, in seeded order, until its remainder is met.

    ``remainders``: (pattern, rest) with rest < the pattern's size. Two levels of hash
    cells find the cell where the running total crosses the remainder; only the rows of
    that cell (one in CELLS^2 of a pattern) are put in order one by one, so a pattern
    with a third of all rows is no large group anywhere. The crossing document is taken
    if that comes nearer to the remainder. Returns the keys taken.
    """
    h = F.xxhash64(F.lit(seed), "key")
    rows = sized.where(F.col("size") > 0).join(remainders, "pattern").where(F.col("rest") > 0)
    rows = rows.select(
        "key", "pattern", "size", "rest", F.pmod(h, F.lit(CELLS)).alias("c1"),
        F.pmod(F.floor(h / CELLS), F.lit(CELLS)).alias("c2"), h.alias("h"),
    )
    taken = []
    for cell in ("c1", "c2"):
        totals = _cells(rows, F.col(cell)).withColumnRenamed("cell", cell)
        placed = rows.join(totals, ["pattern", cell])
        taken.append(placed.where(F.col("before") + F.col("in_cell") <= F.col("rest")).select("key"))
        rows = placed.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("in_cell") > F.col("rest")))
        rows = rows.withColumn("rest", F.col("rest") - F.col("before")).drop("before", "in_cell")
    order = Window.partitionBy("pattern").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    near = F.col("before") + F.col("size") / 2 <= F.col("rest")
    taken.append(rows.where((F.col("before") < F.col("rest")) & near).select("key"))
    return taken[0].unionByName(taken[1]).unionByName(taken[2])


def _sized(docs: DataFrame, members: Column) -> DataFrame:
    """key, doc_id, size, pattern of every row of docs, written once (texts are read once).

    The key tells rows apart: doc_id, digest of pattern and text, and for rows that are alike in both
    their number, which does not depend on the partitioning (they are interchangeable)."""
    pattern = F.to_json(F.array_sort(F.array_distinct(F.transform(members, _tag))))
    base = docs.select("doc_id", F.size(word_array(F.col("text"))).cast("long").alias("size"), pattern.alias("pattern"), _content(members).alias("content"))
    base = written(base, "mix-sizes")
    alike = base.groupBy("doc_id", "content").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    alike = written(alike, "mix-alike")
    same = base["doc_id"].eqNullSafe(alike["doc_id"]) & (base["content"] == alike["content"])
    one = base.join(alike, same, "left_anti").withColumn("copy", F.lit(1).cast("long"))
    many = numbered(base.join(alike, same, "left_semi"), ["doc_id", "content"], [F.col("size").asc()], "copy")
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "content", "copy")
    return written(one.unionByName(many).select(key.alias("key"), "doc_id", "size", "pattern", "content"), "mix-rows")


def _content(members: Column) -> Column:
    """Digest of a document's text and sources."""
    pattern = F.to_json(F.array_sort(F.array_distinct(F.transform(members, _tag))))
    return F.md5(F.concat(pattern, F.coalesce(F.concat(F.lit("t"), "text"), F.lit("n"))).cast("binary"))


def mix(docs: DataFrame, members: Column, seed: int = SEED, weights: dict | None = None) -> DataFrame:
    """Mix documents (doc_id, text) to target weights.

    ``members``: array of the sources a document belongs to (elements may be null).
    Without ``weights`` the sources, by code point with null last, weigh 1, 2, 3,
    repeating (names in ``weights`` are sources as text, or None). Returns key, doc_id,
    size, pattern, content, copies, taken, targets per source in ``target`` and sizes in
    ``source_size`` (of the pattern's first source).
    """
    rows = _sized(docs, members)
    tags = F.from_json("pattern", "array<string>")
    patterns = written(rows.groupBy("pattern").agg(F.sum("size").alias("size")).select("pattern", "size", tags.alias("tags")), "mix-patterns")
    by_tag = patterns.select("pattern", "size", F.size("tags").alias("members"), F.explode("tags").alias("tag"))
    named = {"t" if k is None else f"s{k}": w for k, w in (weights or {}).items()}
    total = patterns.agg(F.sum("size")).first()[0] or 0
    targets = source_targets(by_tag.groupBy("tag").agg(F.sum("size").alias("size")), total, named)
    # sources that share documents, and every pattern that takes part in their flow
    shared = written(by_tag.where("members > 1").select("tag").distinct(), "mix-shared")
    competing = by_tag.join(shared, "tag", "left_semi").select("pattern").distinct()
    graph = patterns.join(competing, "pattern", "left_semi").limit(MAX_PATTERNS + 1).collect()
    if len(graph) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns touch overlapping sources: their flow graph would not fit the driver")
    quota = targets.withColumn("quota", F.round("target").cast("long"))
    quotas = {r["tag"]: r["quota"] for r in quota.join(shared, "tag", "left_semi").collect()} if graph else {}
    flow = min_cost_flow({tuple(r["tags"]): int(r["size"]) for r in graph}, quotas)
    solved = docs.sparkSession.createDataFrame(
        [(r["pattern"], int(sum(flow[tuple(r["tags"])].values()))) for r in graph], "pattern string, sent long"
    )
    heads = patterns.where(F.size("tags") > 0).select("pattern", "size", F.col("tags")[0].alias("tag")).join(quota, "tag")
    sent = F.coalesce(F.col("sent"), F.least(F.col("quota"), MAX_USES * F.col("size")))
    whole = F.when(F.col("size") > 0, F.floor(F.col("sent") / F.col("size"))).otherwise(F.lit(0))
    plan = (
        heads.join(F.broadcast(solved), "pattern", "left").withColumn("sent", sent)  # at most MAX_PATTERNS rows
        .withColumn("whole", whole.cast("long"))
        .select("pattern", "whole", (F.col("sent") - F.col("whole") * F.col("size")).alias("rest"), "source_size", "target")
    )
    plan = written(plan, "mix-plan")
    picked = select_documents(rows.select("key", "pattern", "size"), plan.select("pattern", "rest"), seed)
    out = small_side_join(rows, plan, "pattern", "left", BROADCAST_PATTERNS).join(picked.withColumn("extra", F.lit(1)), "key", "left")
    copies = F.when(F.col("size") > 0, F.coalesce(F.col("whole"), F.lit(0)) + F.coalesce(F.col("extra"), F.lit(0))).otherwise(F.lit(0))
    return out.select(
        "key", "doc_id", "size", "pattern", "content", F.coalesce("source_size", F.lit(0)).alias("source_size"),
        F.coalesce("target", F.lit(0.0)).alias("target"), copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"),
    )


def _tag(source: Column) -> Column:
    """A source as text that sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def mixed_documents(docs: DataFrame, members: Column, seed: int = SEED) -> DataFrame:
    """The mix itself: each document of docs repeated as often as it is taken.

    Rows that are alike in doc_id, text and sources stand for each other: one of them is repeated as
    often as all of them are taken."""
    chosen = mix(docs, members, seed).where("copies > 0")
    chosen = written(chosen.groupBy("doc_id", "content").agg(F.sum("copies").alias("copies")), "mix-chosen")
    names = docs.columns
    marked = docs.select(*[F.col(c) for c in names], _content(members).alias("_content"))
    key = chosen.select(F.col("doc_id").alias("_id"), F.col("content").alias("_c"), F.col("copies").alias("_copies"))
    out = marked.join(key, marked["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_content") == F.col("_c")))
    out = out.dropDuplicates(["_id", "_content"])
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / COPIES_AT_ONCE)))
    out = out.withColumn("_chunk", chunks)
    if (chosen.agg(F.max("copies")).first()[0] or 0) > COPIES_AT_ONCE:
        out = out.hint("rebalance")  # a row taken very often is dealt out before its copies are made
    here = F.least(F.lit(COPIES_AT_ONCE), F.col("_copies") - F.col("_chunk") * COPIES_AT_ONCE)
    return out.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), here))).select(*names)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return mix(docs, F.array("source")).select("doc_id", "size", "source_size", "target", "taken")
