"""Bill-of-material hierarchy: tree levels, outline order, subtrees and cost roll-ups.

Everything is by pointer doubling: after k rounds every node knows its ancestor 2^k above it
(or the top, if that is nearer), and the sums over its descendants less than 2^k below it. A
round is one join on ids, and one grouped sum where sums are asked for, over a written table
(Parquet in the folder of ``spark.checkpoint.dir``), so a forest of depth d takes log2 d + 1
rounds, and a lost executor repeats tasks of one round at most. A round in which no node
reaches its top leaves only nodes on cycles and below them, and ends the loop: there is no
depth cap. Spark chooses each join from measured sizes; a hot parent is a skewed key that AQE
splits, and its children are summed in partial sums.

With the sizes known, a node's place in document order (pre-order, siblings by name) is the sum,
over the nodes from it to the root, of one plus the sizes of the siblings before them: a second
doubling. A subtree is then the interval of places [place, place + size), so nested seeds share
one set of places and nothing is walked.

Semantics kept from the source:
- tree: roots are items with a NULL parent; children are looked up inside the same
  asset; items whose parent is missing (orphans) and items on a cycle are never reached;
- subtree: descendants by parent link alone (any asset); a walk that returns to its seed
  (a cycle) stops there.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize, small_tasks

# Where a seed lies on a cycle its subtree is walked level by level (``_walk``): every
# CUT_EVERY-th level is written to the checkpoint folder (lineage cut); the levels between are
# cached (memory, spilling to disk) and counted in the same single job.
CUT_EVERY = 4
BLOCK = 4_096            # places of one key of the interval join


def _keep(df: DataFrame, depth: int, name: str) -> tuple[DataFrame, int]:
    if depth % CUT_EVERY == 0:
        return materialize(df, name)
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    return df, df.count()


def _written(df: DataFrame, rows: int, name: str) -> DataFrame:
    """``df`` as a written table, its shuffles of about ``rows`` rows in small tasks."""
    with small_tasks(df.sparkSession, rows):
        return materialize(df, name)[0]


def _finish(levels: list[DataFrame], name: str) -> DataFrame:
    """All levels as one written table; the cached levels are released."""
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    result, _ = materialize(out, name)
    for lv in levels:
        lv.unpersist()
    return result


def _double(nodes: DataFrame, down: dict[str, str] | None = None, up: dict[str, str] | None = None, rows: int = 0) -> tuple[DataFrame, int, int]:
    """Pointer doubling over ``nodes`` (id, up: the parent's id or NULL, and the columns named).

    ``rows``: about how many there are. ``down``: columns that are put together from the top to the node, "sum" or "concat"; ``up``:
    columns that are put together over a node's descendants and itself, "sum" or "height" (steps
    to the deepest one; starts at 0). Returns the nodes with depth and top, the number of those
    that no top is above (their ``up`` is not NULL), and the number of rounds.
    """
    down, up = down or {}, up or {}
    join_down = {"sum": lambda above, own: above + own, "concat": lambda above, own: F.concat(above, own)}
    with small_tasks(nodes.sparkSession, rows):
        state, _ = materialize(nodes.withColumns({"depth": F.col("up").isNotNull().cast("int"), "top": F.when(F.col("up").isNull(), F.col("id"))}), "doubling")
        keep = [c for c in nodes.columns if c not in ("id", "up", *down, *up)]
        left, rounds = state.where("up IS NOT NULL").count(), 0
        while left:
            reach = 2 ** rounds
            if up:
                parts = [(F.sum(c) if how == "sum" else F.max(F.col(c) + reach)).alias(f"_{c}") for c, how in up.items()]
                below = state.where("up IS NOT NULL").groupBy(F.col("up").alias("_b")).agg(*parts)
                total = {c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) if how == "sum" else F.greatest(c, F.coalesce(f"_{c}", F.lit(0))) for c, how in up.items()}
                summed = state.join(below, state["id"] == below["_b"], "left").select("id", "up", "depth", "top", *keep, *down, *[v.cast(dict(state.dtypes)[c]).alias(c) for c, v in total.items()])
            else:
                summed = state
            above = state.select(F.col("id").alias("_i"), F.col("up").alias("_u"), F.col("depth").alias("_d"), F.col("top").alias("_t"), *[F.col(c).alias(f"_{c}") for c in down])
            moved = summed.where("up IS NOT NULL").join(above, F.col("up") == F.col("_i")).select(
                "id", F.col("_u").alias("up"), (F.col("depth") + F.col("_d")).alias("depth"), F.col("_t").alias("top"), *keep,
                *[join_down[how](F.col(f"_{c}"), F.col(c)).alias(c) for c, how in down.items()], *up)
            state, _ = materialize(summed.where("up IS NULL").unionByName(moved), "doubling")
            before, left, rounds = left, state.where("up IS NOT NULL").count(), rounds + 1
            if left == before:
                break
    return state, left, rounds


def _forest(items: DataFrame, own: list[Column], same_asset: bool = True) -> DataFrame:
    """id, up (the parent's id where the parent is there), rooted (no parent is named) and ``own``."""
    parents = items.select(F.col("id").alias("_p"), F.col("asset_id").alias("_a"))
    found = F.col("parent_id") == F.col("_p")
    if same_asset:
        found = found & (F.col("asset_id") == F.col("_a"))
    return items.join(parents, found, "left").select("id", F.col("_p").alias("up"), F.col("parent_id").isNull().alias("rooted"), *own)


def _reached(items: DataFrame, state: DataFrame, columns: list) -> DataFrame:
    """The nodes whose top is a root, with their own columns from ``items``."""
    roots = state.where("up IS NULL AND rooted AND id = top").select(F.col("id").alias("_r"))
    there = state.where("up IS NULL").join(roots, F.col("top") == F.col("_r"), "left_semi").withColumnRenamed("id", "_i")
    return items.join(there.drop("asset_id", "parent_id", "name"), items["id"] == F.col("_i")).select(*columns)


def bom_tree(items: DataFrame, items_written: bool = False, paths: bool = True) -> DataFrame:
    """Every node reachable from a root, per asset.

    Columns: id, asset_id, parent_id, name, depth, root_id and, with ``paths``, path_ids
    ('/'-joined ids from the root), path_names (' / '-joined names) and sort_path (array of
    (name, id) from the root: ordering by (asset_id, sort_path) is the nested document's
    order, siblings by name). The item's remaining columns are left out (join back on id).
    ``items_written``: the items are already a written table (not re-derived per round),
    so they are not written again.
    """
    base = items.select("id", "asset_id", "parent_id", "name")
    base, rows = (base, base.count()) if items_written else materialize(base, "nodes")
    step = [F.array(F.struct(F.col("name").alias("n"), F.col("id").alias("i"))).alias("sort_path")] if paths else []
    state, _, _ = _double(_forest(base, step), {"sort_path": "concat"} if paths else {}, rows=rows)
    more = []
    if paths:
        more = [F.array_join(F.transform("sort_path", lambda x: x["i"].cast("string")), "/").alias("path_ids"),
                F.array_join(F.transform("sort_path", lambda x: x["n"]), " / ").alias("path_names"), "sort_path"]
    with small_tasks(items.sparkSession, rows):
        out, _ = materialize(_reached(base, state, ["id", "asset_id", "parent_id", "name", "depth", F.col("top").alias("root_id"), *more]), "tree")
    return out


def bom_places(items: DataFrame, sums: bool = True) -> DataFrame:
    """Every node reachable from a root with its place in its asset's document order (pre-order,
    siblings by name, then id; from 0) and its subtree's size and, with ``sums``, height and cost:
    a node's subtree is the places from ``place`` to ``place + size - 1`` of its asset.

    Columns: id, asset_id, parent_id, name, depth, root_id, place, size and, with ``sums``, height, cost.
    """
    value = [(F.col("quantity") * F.col("unit_cost_usd")).alias("_own")] if sums else []
    base, rows = materialize(items.select("id", "asset_id", "parent_id", "name", *value), "nodes")
    own, up = [F.lit(1).cast("bigint").alias("size")], {"size": "sum"}
    if sums:
        own += [F.lit(0).alias("height"), F.coalesce("_own", F.lit(0)).cast("decimal(38,5)").alias("cost")]
        up |= {"height": "height", "cost": "sum"}
    state, _, _ = _double(_forest(base, own), up=up, rows=rows)
    with small_tasks(items.sparkSession, rows):
        tree, _ = materialize(_reached(base, state, ["id", "asset_id", "parent_id", "name", "depth", F.col("top").alias("root_id"), *up]), "sized")
    siblings = Window.partitionBy("asset_id", "parent_id").orderBy("name", "id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(siblings), F.lit(0)) + F.col("parent_id").isNotNull().cast("bigint")
    placed, _, _ = _double(tree.select("id", F.col("parent_id").alias("up"), before.alias("place")), {"place": "sum"}, rows=rows)
    place = placed.select(F.col("id").alias("_i"), "place")
    return _written(tree.join(place, F.col("id") == F.col("_i")).drop("_i"), rows, "places")


def bom_outline(items: DataFrame) -> DataFrame:
    """I3 re-aimed: the nested tree document as flat rows with their place in it (pre-order,
    siblings by name) and depth, so an asset with a huge BOM never has to fit in one row or
    one task; ordering by (asset_id, place) is the document."""
    return bom_places(items, sums=False).select("asset_id", "place", "id", "name", "depth", "size")


def bom_tree_summary(items: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """I4: per asset over all its items (orphans included): total, serialized, bulk, on
    order, total cost; plus how many of them the tree reaches."""
    per = (items.groupBy("asset_id")
           .agg(F.count("*").alias("total"),
                F.count_if(F.col("item_type") == "Serialized").cast("bigint").alias("serialized"),
                F.count_if(F.col("item_type") == "Bulk").cast("bigint").alias("bulk"),
                F.count_if(F.col("status") == "On Order").cast("bigint").alias("on_order"),
                F.coalesce(F.sum(F.col("quantity") * F.col("unit_cost_usd")), F.lit(0))
                 .cast("decimal(38,2)").alias("total_cost")))
    t = tree if tree is not None else bom_tree(items, paths=False)
    reach = t.groupBy(F.col("asset_id").alias("_a")).agg(F.count("*").alias("in_tree"))
    return (per.join(reach, per["asset_id"] == reach["_a"], "left").drop("_a")
            .withColumn("in_tree", F.coalesce("in_tree", F.lit(0).cast("bigint"))))


def _by_link(items: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """The forest by parent link alone: nodes (id, top, depth, place, size, height) under a top, and
    the edges (id, parent_id) of the others (on cycles and below them) with their number; and the number of items."""
    base, rows = materialize(items.select("id", "asset_id", "parent_id"), "links")
    one = [F.lit(1).cast("bigint").alias("size"), F.lit(0).alias("height")]
    state, cyclic, _ = _double(_forest(base, one, same_asset=False), up={"size": "sum", "height": "height"}, rows=rows)
    parents = base.select(F.col("id").alias("_i"), "parent_id")
    linked = state.where("up IS NULL").join(parents, F.col("id") == F.col("_i")).drop("_i")
    up = F.when(F.col("id") != F.col("top"), F.col("parent_id"))
    siblings = Window.partitionBy("_up").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.when(F.col("_up").isNull(), F.lit(0)).otherwise(F.coalesce(F.sum("size").over(siblings), F.lit(0)) + 1)
    tops, inner = linked.where("id = top"), linked.where("id <> top")
    start = inner.withColumn("_up", up).withColumn("place", before).unionByName(tops.withColumn("_up", up).withColumn("place", F.lit(0).cast("bigint")))
    with small_tasks(items.sparkSession, rows):
        start, _ = materialize(start.select("id", F.col("_up").alias("up"), "size", "height", "place"), "offsets")
    placed, _, _ = _double(start, {"place": "sum"}, rows=rows)
    rest = base.join(state.where("up IS NOT NULL").select(F.col("id").alias("_c")), F.col("id") == F.col("_c"), "left_semi").select("id", "parent_id")
    return placed.select("id", "top", "depth", "place", "size", "height"), rest, cyclic, rows


def subtree(items: DataFrame, seeds: DataFrame, seed_col: str = "id") -> DataFrame:
    """Every descendant of each seed item (the seed itself at depth 0), following
    parent links across the whole table. Columns: seed_id, id, depth.

    A seed's subtree is an interval of places under its top, so pairs come from one join on
    (top, block of places): an interval is cut into its blocks, and a node lies in one. Seeds on
    cycles or below them, which no top is above, are walked level by level. Where only the set
    of items below is wanted, ``reachable`` does without the seed; for counts, ``subtree_sizes``.
    """
    nodes, rest, cyclic, rows = _by_link(items)
    wanted = seeds.select(F.col(seed_col).alias("seed_id")).dropDuplicates()
    cut = F.explode(F.sequence(F.floor(F.col("place") / BLOCK), F.floor((F.col("place") + F.col("size") - 1) / BLOCK)))
    own = nodes.join(wanted, F.col("id") == F.col("seed_id")).select(
        "seed_id", F.col("top").alias("_t"), F.col("place").alias("_from"), (F.col("place") + F.col("size")).alias("_to"), F.col("depth").alias("_d"), cut.alias("_b"))
    inside = (F.col("top") == F.col("_t")) & (F.col("block") == F.col("_b")) & (F.col("place") >= F.col("_from")) & (F.col("place") < F.col("_to"))
    found = nodes.withColumn("block", F.floor(F.col("place") / BLOCK)).join(own, inside).select("seed_id", "id", (F.col("depth") - F.col("_d")).alias("depth"))
    found = _written(found, rows, "below")
    return found.unionByName(_walk(rest, wanted)) if cyclic else found


def _walk(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed_id, id, depth) below seeds that no top is above, level by level over their edges alone.

    Every item has one parent, so a walk can only come back to a node it has seen by returning
    to its own seed (the seed lies on a cycle); that is the one stop needed.
    """
    edges, _ = materialize(edges, "edges")
    level, rows = materialize(seeds.join(edges.select("id"), F.col("seed_id") == F.col("id")).select("seed_id", "id", F.lit(0).alias("depth")), "seeds")
    levels = [level]
    while rows:
        f = level.select("seed_id", F.col("id").alias("_p"), "depth")
        nxt = (edges.join(f, edges["parent_id"] == f["_p"], "inner")
               .where(F.col("id") != F.col("seed_id"))
               .select("seed_id", "id", (F.col("depth") + 1).alias("depth")))
        level, rows = _keep(nxt, len(levels), "level")
        levels.append(level)
    return _finish(levels, "subtree")


def subtree_sizes(items: DataFrame, seeds: DataFrame, seed_col: str = "id") -> DataFrame:
    """Per seed: how many items a delete of the seed removes (itself + descendants) and how deep
    they go, from the doubled sums; no pair is made but for seeds on cycles or below them."""
    base, rows = materialize(items.select("id", "asset_id", "parent_id"), "links")
    one = [F.lit(1).cast("bigint").alias("size"), F.lit(0).alias("height")]
    state, cyclic, _ = _double(_forest(base, one, same_asset=False), up={"size": "sum", "height": "height"}, rows=rows)
    wanted = seeds.select(F.col(seed_col).alias("seed_id")).dropDuplicates()
    out = state.where("up IS NULL").join(wanted, F.col("id") == F.col("seed_id")).select("seed_id", F.col("size").alias("delete_count"), F.col("height").alias("max_depth"))
    out = _written(out, rows, "sizes")
    if not cyclic:
        return out
    rest = base.join(state.where("up IS NOT NULL").select(F.col("id").alias("_c")), F.col("id") == F.col("_c"), "left_semi").select("id", "parent_id")
    return out.unionByName(subtree_counts(_walk(rest, wanted)))


def reachable(items: DataFrame, seeds: DataFrame) -> DataFrame:
    """The ids of ``seeds`` (id) and of every item below one of them, each once: a frontier of
    ids less what has been seen, so nested seeds are walked once."""
    edges, _ = materialize(items.select("id", "parent_id").where(F.col("parent_id").isNotNull()), "edges")
    seen, rows = materialize(seeds.select("id").dropDuplicates(), "seen")
    level, levels = seen, 1
    while rows:
        below = edges.join(level.select(F.col("id").alias("_p")), F.col("parent_id") == F.col("_p")).select("id").dropDuplicates()
        level, rows = materialize(below.join(seen.select(F.col("id").alias("_s")), F.col("id") == F.col("_s"), "left_anti"), "level")
        seen = seen.unionByName(level)
        levels += 1
        if levels % CUT_EVERY == 0:
            seen, _ = materialize(seen, "seen")
    return seen


def subtree_counts(sub: DataFrame) -> DataFrame:
    """Per seed: how many items a delete of the seed removes (itself + descendants)."""
    return sub.groupBy("seed_id").agg(F.count("*").alias("delete_count"),
                                      F.max("depth").alias("max_depth"))


def subtree_cost(items: DataFrame) -> DataFrame:
    """For every node in the tree, the cost Σ quantity × unit cost of its subtree and the
    subtree's size, from the doubled sums."""
    base, rows = materialize(items.select("id", "asset_id", "parent_id", "name", (F.col("quantity") * F.col("unit_cost_usd")).alias("_own")), "nodes")
    own = [F.lit(1).cast("bigint").alias("subtree_size"), F.coalesce("_own", F.lit(0)).cast("decimal(38,5)").alias("subtree_cost")]
    state, _, _ = _double(_forest(base, own), up={"subtree_size": "sum", "subtree_cost": "sum"}, rows=rows)
    return _written(_reached(base, state, ["id", "asset_id", "depth", F.col("subtree_cost").cast("decimal(38,2)").alias("subtree_cost"), "subtree_size"]), rows, "costs")
