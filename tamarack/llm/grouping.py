"""Splits that keep related records together: connected components by random-mate contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import label, stripped
from ..plans.staging import BROADCAST_ROWS, broadcast_if_small, counted, stage
from .sampling import draw


def file_name_key(path: Column) -> Column:
    """A file path in one spelling: outer blanks, letter case, the kind of slash, ``.``, ``..`` and doubled slashes aside."""
    bare = F.lower(F.translate(stripped(path), "\\", "/"))
    steps = F.filter(F.split(bare, "/"), lambda x: ~x.isin("", "."))
    up = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda done, x: F.when(
            (x == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != ".."),
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
        ).otherwise(F.concat(done, F.array(x))),
    )
    joined = F.array_join(F.when(F.contains(bare, F.lit("..")), up).otherwise(steps), "/")
    root = F.when(F.startswith(bare, F.lit("/")), F.lit("/")).otherwise(F.lit(""))
    whole = F.when(joined != "", F.concat(root, joined))
    # Most paths have no step to resolve, which one look tells.
    return F.nullif(F.when(F.rlike(bare, F.lit(r"(^|/)\.{0,2}(/|$)")), whole).otherwise(bare), F.lit("unknown"))


def real_id(value: Column) -> Column:
    """An id that joins rows; null or blank ones join nothing."""
    return F.when(stripped(value) != "", value)


#: Edges of one vertex from which its moves are joined apart, and such vertices that may be broadcast (about 50 bytes each).
HUB, HUBS = 100_000, 200_000


def vertex_of(kind: str, value: Column) -> Column:
    """128 bits that name a shard, an id or a row; null for null."""
    return F.unhex(F.md5(F.concat(F.lit(f"{kind}\x00"), value.cast("string"))))


def coin(vertex: Column, turn: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(turn), vertex), F.lit(2)) == 0


def renamed_ends(edges: DataFrame, end: str, move: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """Edges with one end moved. Edges of hubs, which would all meet in one task, get their moves by a broadcast of the hubs."""
    def joined(part: DataFrame, table: DataFrame) -> DataFrame:
        part = part.join(table.select(F.col("vertex").alias(end), "into"), end, "left")
        return part.withColumn(end, F.coalesce("into", end)).select("a", "b")

    if hubs is None or hubs.isEmpty():
        return joined(edges, move)
    known = broadcast_if_small(hubs, HUBS)
    there = known.select(F.col("vertex").alias(end))
    return joined(edges.join(there, end, "left_semi"), known).unionByName(joined(edges.join(there, end, "left_anti"), move))


def contract(edges: DataFrame) -> DataFrame:
    """``vertex`` -> ``component`` for every vertex of the edges (``a``, ``b``).

    Each round a coin is thrown for every vertex; one that shows tails moves
    into its smallest neighbour that shows heads, and edges are renamed and made
    distinct. A constant share of the vertices vanishes each round, so the rounds
    are logarithmic. Moves are kept as a written table per round; at the end every
    vertex follows them. A vertex with very many edges is never gathered: its choice is a
    minimum combined on the map side.
    """
    moves, turn = [], 0
    edges, count = counted(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    vertices = edges.select(F.explode(F.array("a", "b")).alias("vertex")).distinct()
    while count:
        turn += 1
        both = edges.union(edges.select("b", "a"))
        move = both.where(~coin(F.col("a"), turn) & coin(F.col("b"), turn)).groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("into"))
        move, moved = counted(move, "moves")
        if not moved:
            continue
        hubs = None
        if moved <= BROADCAST_ROWS:
            move = F.broadcast(move)
        else:
            degree = both.groupBy(F.col("a").alias("vertex")).agg(F.count(F.lit(1)).alias("n"))
            hubs = stage(degree.where(F.col("n") > HUB).select("vertex").join(move, "vertex", "left"), "hubs")
        moves.append(move)
        renamed = renamed_ends(renamed_ends(edges, "a", move, hubs), "b", move, hubs).where("a <> b").toDF("x", "y")
        edges, count = counted(renamed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    labels = vertices.select("vertex", F.col("vertex").alias("component"))
    for number, move in enumerate(moves, 1):  # a vertex follows the moves in the order in which they were made
        step = move.select(F.col("vertex").alias("component"), "into")
        labels = labels.join(step, "component", "left").select("vertex", F.coalesce("into", "component").alias("component"))
        if number % 8 == 0:
            labels = stage(labels, "labels")
    return stage(labels, "labels")


def related_rows(df: DataFrame, key: str, shard: Column, ident: Column, carry: list[str]) -> DataFrame:
    """``key``, ``carry`` columns and ``component`` for each row; rows share one if a shard or an id links them.

    A row's vertex is its shard, else its id, else itself; only ids that stand at
    more than one vertex make edges, so the graph has as many vertices as there
    are shards, not rows. Null shards and ids join nothing; an empty table gives
    an empty result.
    """
    s, i = vertex_of("shard", shard), vertex_of("id", ident)
    vertex = F.coalesce(s, i, vertex_of("row", F.col(key)))
    rows = stage(df.select(F.col(key).alias("_key"), *carry, vertex.alias("vertex"), i.alias("_id")), "rows")
    spread = rows.where("_id IS NOT NULL").groupBy("_id").agg(F.min("vertex").alias("a"), F.max("vertex").alias("z")).where("a <> z")
    links = rows.where("_id IS NOT NULL").join(spread, "_id").where("vertex <> a").select("a", F.col("vertex").alias("b"))
    labels = contract(links)
    named = rows.join(broadcast_if_small(labels), "vertex", "left")
    return named.select(F.col("_key").alias(key), *carry, F.coalesce("component", "vertex").alias("component"))


def clip_components(manifest: DataFrame) -> DataFrame:
    return related_rows(
        manifest.withColumn("split", label("split")), "row_id", file_name_key(F.col("source_shard")), real_id(F.col("id")), ["split"]
    )


def broken_groups(components: DataFrame) -> DataFrame:
    """Groups whose rows carry two or more of the splits train, validation and test."""
    seen = [F.max((F.col("split") == s).cast("int")) for s in ("train", "validation", "test")]
    out = components.groupBy("component").agg(F.min("row_id").alias("group_row_id"), sum(seen[1:], seen[0]).alias("splits"))
    return out.where("splits >= 2").select("group_row_id")


def assign_splits(components: DataFrame, key: str, targets: DataFrame, seed: int = 5, bucket_rows: int = 50_000) -> DataFrame:
    """One split per component, in the proportions of ``targets`` (split, target_share).

    Components heavier than a tenth of the smallest target go to the largest
    split first; the others follow in a hashed order by cumulative weight over
    what each split still lacks. The running weight is taken in two levels, over
    buckets and inside them, so the number of components may be large. Targets
    that don't sum to 1 are scaled; null splits or shares are left out.
    """
    w = components.groupBy("component").agg(F.count(F.lit(1)).alias("weight"))
    w = stage(w.withColumn("draw", draw(F.col("component"), seed)), "weights")
    goal = {r["split"]: float(r["share"]) for r in targets.where("split IS NOT NULL AND target_share > 0").groupBy("split").agg(F.sum("target_share").alias("share")).orderBy("split").collect()}
    total, count = w.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.count(F.lit(1))).first()
    if not goal:
        raise ValueError("no split target")
    scale = sum(goal.values())
    names = sorted(goal, key=lambda s: (-goal[s], s))
    aim = {s: goal[s] / scale * total for s in names}
    heavy = max(min(aim.values()) / 10, 1)
    held = w.where(F.col("weight") > heavy).agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    left, light = dict(aim), total - held
    left[names[0]] = max(aim[names[0]] - held, 0)
    room = sum(left.values()) or 1
    edges, at = [], 0.0
    for s in names:
        at += left[s] / room * light
        edges.append((s, at))
    buckets = max(1, -(-count // bucket_rows))
    rest = w.where(F.col("weight") <= heavy).withColumn("_b", F.floor(F.col("draw") * buckets))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    base = rest.groupBy("_b").agg(F.sum("weight").alias("_w")).select("_b", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_b").orderBy("draw", "component").rowsBetween(Window.unboundedPreceding, -1)
    rest = rest.withColumn("_in", F.coalesce(F.sum("weight").over(inside), F.lit(0))).join(broadcast_if_small(base), "_b")
    middle = F.col("_base") + F.col("_in") + F.col("weight") / 2
    split = F.lit(edges[-1][0])
    for s, edge in reversed(edges[:-1]):
        split = F.when(middle < edge, F.lit(s)).otherwise(split)
    chosen = rest.select("component", split.alias("new_split")).unionByName(
        w.where(F.col("weight") > heavy).select("component", F.lit(names[0]).alias("new_split"))
    )
    return components.join(chosen, "component").select(key, F.hex("component").alias("component"), "new_split")


def split_report(components: DataFrame, key: str, targets: DataFrame) -> DataFrame:
    """Rows, groups and share of each split beside its target; splits without a row have none."""
    got = assign_splits(components, key, targets).groupBy(F.col("new_split").alias("split")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("component").alias("groups")
    )
    aims = targets.where("split IS NOT NULL AND target_share > 0").groupBy("split").agg(F.sum("target_share").alias("target_share"))
    out = aims.join(got, "split", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    whole = F.sum("n_rows").over(Window.partitionBy())  # a row for each split
    share = F.try_divide("n_rows", whole)
    return out.select("split", "target_share", "n_rows", F.coalesce("groups", F.lit(0)).alias("groups"), F.round(share, 6).alias("reached_share"))
