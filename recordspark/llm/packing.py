"""Filling fixed-capacity containers with items.

Method: bulk-synchronous best-fit. Documents and gaps (room left in open containers) are sorted by size, in SHARDS parts
of each size; a sweep from large to small matches every document with the tightest gap that takes it and no larger
document has taken: gaps open a level of a stack, documents close the level on top. Levels come from running sums over
the sorted sizes, so conflicts are settled by rank, and a document meets its gap by (limit, level) in a window that
holds at most one row per size and part. Gaps are updated and the sweep is repeated while it places anything; documents
that no gap takes open containers of their own. Sizes are worked off in classes from large to small, in which a wide
gap offers several slots at once. The driver sees counts by limit, nothing else.

Only a text longer than a container is split: into full containers and a rest that is packed like a document.

Defined results: null and empty texts have no tokens and come out with a null container; repeated doc_ids count
once, documents without a doc_id each for itself; ties are broken by a hash of doc_id, then doc_id; a null or
non-positive capacity is no limit and is left out; of two capacities for a limit_id the smaller counts; extra columns
are not read; no documents give an empty result. More than MAX_LIMITS limits are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordspark.llm.tokens import FOLDER, document_sizes
from recordspark.runtime import Cut

SHARDS = 64
MAX_LIMITS = 100
MAX_SINCE, MANY = 6, 1 << 20  # tables and rows placed since the last table of gaps
EACH = 3  # sweeps between two collections of the driver's garbage
OUT = "limit_id int, doc_id long, piece int, start_token long, n_tokens long, container_id string"


def class_bounds(capacity: int) -> list[int]:
    """Upper bounds of the size classes, from the capacity down: its halves and thirds, then two thirds of the bound before."""
    bounds, x = [capacity, capacity // 2, capacity // 3], 4.0
    while capacity // x >= 1:
        bounds.append(int(capacity // x))
        x *= 1.5
    return sorted({b for b in bounds if b >= 1}, reverse=True)


def pieces(sizes: DataFrame, limits: list[tuple[int, int]]) -> DataFrame:
    """limit_id, doc_id, piece, start, size, is_full: full containers of long texts, and the rest that is to be packed."""
    caps = F.explode(F.array(*[F.struct(F.lit(i).alias("limit_id"), F.lit(c).cast("long").alias("capacity")) for i, c in limits]))
    rows = sizes.withColumn("cap", caps).select("doc_id", "n_tokens", "cap.*")
    number = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("capacity"))).cast("int")
    cut = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), number - 1)))
    size = F.least(F.col("capacity"), F.col("n_tokens") - F.col("piece") * F.col("capacity"))
    return cut.select("limit_id", "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("start"), size.alias("size"), ((size == F.col("capacity")) & (size > 0)).alias("is_full"))


def _by_limit(values: dict[int, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("limit_id"))


def _shard(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SHARDS)).cast("int")


def sweep(items: DataFrame, gaps: DataFrame, lower: dict[int, int], upper: dict[int, int], per: dict[int, int] | None = None, first: dict[int, int] | None = None) -> DataFrame:
    """The items with `gap_id`, the tightest gap that takes each and no larger one has taken; null where there is none.

    items: limit_id, doc_id, piece, start, size; gaps: limit_id, gap_id, room. Items of a limit are over `lower` and at
    most `upper`; a gap of at least twice `upper` offers as many slots as it has room for such items. With `per` and
    `first`, the items of a limit of which no gap takes any open containers, numbered from `first`; `per` of them share
    one, in order of size.
    """
    k = F.greatest(F.lit(1), F.floor(F.col("room") / _by_limit(upper))).cast("int")
    slots = gaps.filter(F.col("room") > _by_limit(lower)).withColumn("k", k)  # no bound: not in work
    slots = slots.select("limit_id", F.floor(F.col("room") / F.col("k")).alias("size"), F.lit(0).alias("is_item"), _shard(F.col("gap_id")).alias("shard"), F.col("gap_id").alias("id"), F.explode(F.sequence(F.lit(1), F.col("k"))).alias("piece"), F.lit(None).cast("long").alias("start"))
    rows = slots.unionByName(items.select("limit_id", "size", F.lit(1).alias("is_item"), _shard(F.col("doc_id")).alias("shard"), F.col("doc_id").alias("id"), "piece", "start"))
    part = ["limit_id", "size", "is_item", "shard"]
    order = [F.col("size").desc(), F.col("is_item"), F.col("shard")]  # a gap of just the size comes before the item
    counts = rows.groupBy(*part).agg(F.count("*").alias("n"))
    w = Window.partitionBy("limit_id").orderBy(*order)  # a row per size and part: bounded by the capacity, not by the documents
    step = F.when(F.col("is_item") == 0, F.col("n")).otherwise(-F.col("n"))
    counts = counts.withColumn("after", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lowest = F.min("after").over(w.rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("failed", -F.least(F.lit(0), F.coalesce(lowest, F.lit(0))))  # items before that no gap takes
    counts = counts.select(*part, "failed", (F.col("after") - step + F.col("failed")).alias("depth"))
    if per:
        stuck = F.max(F.when(F.col("is_item") == 1, F.col("depth"))).over(Window.partitionBy("limit_id")) == 0
        counts = counts.withColumn("failed", F.when(stuck, F.col("failed")))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy(*part).orderBy("id", "piece"))).join(counts, part)
    level = F.when(F.col("is_item") == 0, F.col("depth") + F.col("r")).otherwise(F.col("depth") - F.col("r") + 1)
    stack = Window.partitionBy("limit_id", "level").orderBy(*order)  # each size and part touches a level once
    met = ranked.withColumn("level", level).withColumn("gap_id", F.lag(F.when(F.col("is_item") == 0, F.col("id"))).over(stack))
    gap = F.when(F.col("level") > 0, F.col("gap_id"))
    if per:
        gap = gap.when(F.col("failed").isNotNull(), F.floor((F.col("failed") + F.col("r") - 1) / _by_limit(per)).cast("long") + _by_limit(first))
    return met.filter("is_item = 1").select("limit_id", F.col("id").alias("doc_id"), "piece", "start", "size", gap.alias("gap_id"))


def _room_left(gaps: DataFrame, placed: DataFrame | None, caps: dict[int, int]) -> DataFrame:
    """The gaps after these items were placed; containers that are not among the gaps are new."""
    if placed is None:
        return gaps
    rows = gaps.withColumn("size", F.lit(None).cast("long")).unionByName(placed.filter("gap_id is not null").select("limit_id", "gap_id", F.lit(None).cast("long").alias("room"), "size"))
    left = rows.groupBy("limit_id", "gap_id").agg(F.max("room").alias("room"), F.sum("size").alias("used"))
    room = F.coalesce("room", _by_limit(caps)) - F.coalesce("used", F.lit(0))
    return left.select("limit_id", "gap_id", room.cast("long").alias("room")).filter("room > 0")


def best_fit(items: DataFrame, caps: dict[int, int], cut: Cut) -> DataFrame | None:
    """limit_id, doc_id, piece, start, size and gap_id of every item (none larger than its limit's capacity).

    A sweep is one query: the gaps are summed up where they are read, from the last table of gaps and what was placed
    since. The limits in work and their bounds are looked up in maps, which Spark passes to the code of a stage as data, so
    sweeps whose plans have the same shape share their compiled code. The driver holds threads, classes and plans by query.
    """
    classes = {i: class_bounds(c) for i, c in caps.items()}
    index = F.lit(0)
    for i, bounds in classes.items():
        for j, b in enumerate(bounds):
            index = F.when((F.col("limit_id") == i) & (F.col("size") <= b), j).otherwise(index)
    todo = cut.table(items.select("limit_id", "doc_id", "piece", "start", "size").withColumn("class", index))
    waiting: dict[int, dict[int, int]] = {}
    for r in todo.groupBy("limit_id", "class").agg(F.count("*").alias("n")).collect():
        waiting.setdefault(r["limit_id"], {})[r["class"]] = r["n"]
    at: dict[int, int] = {}  # the class that a limit works on
    next_id = dict.fromkeys(caps, 0)
    rest, done = None, []  # rest: items of the classes in work that found no gap so far
    gaps, since, n_since = cut.spark.createDataFrame([], "limit_id int, gap_id long, room long"), [], 0
    sweeps = 0

    def enter(i: int) -> bool:
        if not waiting.get(i):
            at.pop(i, None)
            return False
        at[i] = min(waiting[i])
        waiting[i].pop(at[i])
        return True

    own = lambda i, x: F.when(F.col("limit_id") == i, x)
    watched = [F.count(own(i, F.when(F.col("gap_id").isNull(), 1))).alias(f"left_{i}") for i in caps]
    watched += [F.max(own(i, F.col("gap_id"))).alias(f"last_{i}") for i in caps] + [F.count("gap_id").alias("placed")]
    fresh = [i for i in caps if enter(i)]
    while at:
        new = todo.filter(F.col("class") == _by_limit({i: at[i] for i in fresh})).drop("class") if fresh else None
        items = new if rest is None else rest if new is None else rest.unionByName(new)
        lower = {i: (classes[i][c + 1] if c + 1 < len(classes[i]) else 0) for i, c in at.items()}
        upper = {i: classes[i][c] for i, c in at.items()}
        per = {i: max(1, caps[i] // upper[i]) for i in at}
        room = _room_left(gaps, cut.together(since) if since else None, caps)
        if len(since) >= MAX_SINCE or n_since > MANY:
            before, gaps, since, n_since = gaps, cut.table(room), [], 0
            cut.drop(before)
            room = gaps
        sweeps += 1
        if sweeps % EACH == 0:
            cut.release()
        swept = cut.table(sweep(items, room, lower, upper, per, {i: next_id[i] for i in at}), seen=watched)
        if swept.seen["placed"]:
            done.append(swept)
            since.append(swept)
            n_since += swept.seen["placed"]
        for i in at:  # a limit whose sweep is complete has opened containers for what no gap takes
            next_id[i] = max(next_id[i], (-1 if swept.seen[f"last_{i}"] is None else swept.seen[f"last_{i}"]) + 1)
        finished = [i for i in at if not swept.seen[f"left_{i}"]]
        rest = swept.filter("gap_id is null").drop("gap_id") if len(finished) < len(at) else None
        fresh = [i for i in finished if enter(i)]
    return cut.together(done).filter("gap_id is not null") if done else None


def read_limits(limits: DataFrame) -> dict[int, int]:
    rows = limits.filter("limit_id is not null and capacity_tokens > 0").groupBy("limit_id").agg(F.min("capacity_tokens").alias("c")).orderBy("limit_id").limit(MAX_LIMITS + 1).collect()
    if len(rows) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} limits")
    return {r["limit_id"]: r["c"] for r in rows}


def pack(documents: DataFrame, limits: DataFrame, cut: Cut, folder: str = FOLDER) -> DataFrame:
    """limit_id, doc_id, piece, start_token, n_tokens and container_id of every piece of every document."""
    caps = read_limits(limits)
    if not caps:
        return documents.sparkSession.createDataFrame([], OUT)
    parts = pieces(cut.table(document_sizes(documents, folder)), list(caps.items()))
    shape = ["limit_id", "doc_id", "piece", F.col("start").alias("start_token"), F.col("size").alias("n_tokens")]
    whole = parts.filter("is_full or size = 0").withColumn("own", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("?"), F.monotonically_increasing_id())))
    alone = whole.select(*shape, F.when(F.col("is_full"), F.concat(F.lit("d"), "own", F.lit("-"), "piece")).alias("container_id"))
    placed = best_fit(parts.filter("not is_full and size > 0"), caps, cut)
    return alone if placed is None else placed.select(*shape, F.concat(F.lit("c"), "gap_id").alias("container_id")).unionByName(alone)


def fill_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """Per limit: containers, tokens and the share of room that is filled."""
    one = packed.filter("container_id is not null").groupBy("limit_id", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("items"))
    per = one.groupBy("limit_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.sum("items").alias("pieces"))
    return per.join(limits.select("limit_id", "capacity_tokens").distinct(), "limit_id").withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
