"""Balanced sharding by label propagation.

Documents with the same text are linked.  Links of a group go through the group itself (a hyperedge), never through pairs.
Documents start on the shard that their row's hash names.  In each round, every group counts its members by shard (with
map-side combine), and members outside the group's fullest shard wish to move there; between full shards as many move one
way as the other, and places that are free let more in; who does not fit stays and tries again.  In every second round
only shards with room can be wished for, so that a group larger than a shard fills shard after shard.

A move brings a group's members together: the sum of the squares of its parts grows with each, so the rounds end by
themselves.  Unlinked documents fill the places left, so that the law ``rows`` holds: counts are at most one apart.

Hot groups: counts are combined before they are shuffled; the few groups with many members come to the rows by a broadcast of
bounded size.  Places within a shard are numbered by counting in (shard, bucket) cells, so that no task sees a whole shard.

Defined cases: null and empty texts are one group (size 1 each); rows that share a ``doc_id`` are placed each by itself;
ties between shards go by a hash of group and shard; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import Scratch, split_join

SHARDS = 16
BUCKETS = 256  # cells of each shard; grows with the rows


def _numbered(df: DataFrame, keys: list[str], buckets: int, name: str = "slot") -> DataFrame:
    """Gapless numbers from 0 within each value of ``keys``: a cell's offset plus the row's place in the cell."""
    df = df.withColumn("_cell", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    cells = df.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_cell")
    offsets = cells.select(*keys, "_cell", (F.sum("_n").over(w) - F.col("_n")).alias("_before"))
    ranked = df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy("row")) - 1)
    joined = ranked.join(offsets, [*keys, "_cell"])
    return joined.withColumn(name, F.col("_before") + F.col("_at")).drop("_before", "_at", "_cell")


def _capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every document, under the law ``rows``."""
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = scratch.keep(
        docs.select("doc_id", F.monotonically_increasing_id().alias("row"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("group")), "rows"
    )
    total = rows.count()
    capacity, buckets = _capacities(total, shards), max(BUCKETS, total // 500_000)
    sizes = scratch.keep(rows.groupBy("group").agg(F.count("*").alias("members")).filter("members > 1"), "sizes")
    linked = split_join(rows.select("row", "group"), sizes, ["group"], "members", total)
    start = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    state = scratch.keep(linked.select("row", "group", start.alias("shard")), "state-0")
    state = propagate(_fit(state, capacity, scratch, buckets), capacity, scratch, buckets, total)
    filled = dict(state.groupBy("shard").count().collect())  # one row for each shard
    singles = rows.select("row").join(state.select("row"), "row", "left_anti").withColumn("_all", F.lit(0))
    free = [c - filled.get(s, 0) for s, c in enumerate(capacity)]
    place = _numbered(singles, ["_all"], buckets, "_p").select("row", _by_position("_p", free).alias("shard"))
    assigned = scratch.keep(state.select("row", "shard").union(place), "assigned")
    out = rows.join(_numbered(assigned, ["shard"], buckets), "row")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _by_position(position: str, free: list[int]):
    """The shard whose range of free places holds the position."""
    out, upto = F.lit(None).cast("int"), sum(free)
    for s in range(len(free) - 1, -1, -1):
        out = F.when(F.col(position) < upto, F.lit(s)).otherwise(out)
        upto -= free[s]
    return out


def _fit(state: DataFrame, capacity: list[int], scratch: Scratch, buckets: int) -> DataFrame:
    """Members beyond a shard's capacity go to the places that are free elsewhere."""
    limit = F.element_at(F.array(*map(F.lit, capacity)), F.col("shard") + 1)
    if all(n <= capacity[s] for s, n in state.groupBy("shard").count().collect()):
        return state
    placed = scratch.keep(_numbered(state, ["shard"], buckets, "_p").withColumn("_over", F.col("_p") >= limit), "placed")
    used = {r["shard"]: r["n"] for r in placed.filter("NOT _over").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    free = [c - used.get(s, 0) for s, c in enumerate(capacity)]
    over = placed.filter("_over").withColumn("_all", F.lit(0)).select("row", "group", "_all")
    moved = _numbered(over, ["_all"], buckets, "_q").select("row", "group", _by_position("_q", free).alias("shard"))
    return scratch.keep(placed.filter("NOT _over").select("row", "group", "shard").union(moved), "fitted")


def quotas(wishes: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of those who wish to go from one shard to another may: as many as come the other way, then what there is room for."""
    out = {(a, b): min(n, wishes.get((b, a), 0)) for (a, b), n in wishes.items()}
    left = list(room)
    for (a, b), n in sorted(wishes.items()):
        more = min(n - out[a, b], max(left[b], 0))
        out[a, b] += more
        left[b] -= more
    return {k: n for k, n in out.items() if n}


def propagate(state: DataFrame, capacity: list[int], scratch: Scratch, buckets: int, total: int) -> DataFrame:
    """Rounds of ``state(row, group, shard)`` until neither kind of round moves anyone."""
    i = still = 0
    while still < 2:
        i += 1
        state, moved = _round(state, capacity, scratch, buckets, total, i)
        still = 0 if moved else still + 1
    return state


def _round(state: DataFrame, capacity: list[int], scratch: Scratch, buckets: int, total: int, i: int) -> tuple[DataFrame, int]:
    """One step of propagation under quotas; the driver sees a count for each pair of shards."""
    held = state.groupBy("group", "shard").agg(F.count("*").alias("n"))
    used = dict(state.groupBy("shard").count().collect())
    room = [max(0, c - used.get(s, 0)) for s, c in enumerate(capacity)]
    wanted = F.struct("n", F.xxhash64("group", "shard").alias("tie"), F.col("shard").alias("to"))
    if i % 2 == 0:
        wanted = F.when(F.element_at(F.array(*(F.lit(r > 0) for r in room)), F.col("shard") + 1), wanted)
    best = held.groupBy("group").agg(F.max(wanted).alias("b"), F.count("*").alias("parts")).filter("parts > 1 AND b IS NOT NULL")
    behind = (F.col("n") < F.col("b.n")) | ((F.col("n") == F.col("b.n")) & (F.xxhash64("group", "shard") < F.col("b.tie")))
    wish = held.join(best, "group").filter((F.col("shard") != F.col("b.to")) & behind).select("group", "shard", F.col("b.to").alias("to"), "n")
    wish = scratch.keep(wish, f"wishes-{i}")
    allowed = quotas({(r["shard"], r["to"]): r["n"] for r in wish.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}, room)
    if not allowed:
        return state, 0
    let = F.create_map(*(F.lit(x) for (a, b), n in allowed.items() for x in (a * len(capacity) + b, n)))
    wish = wish.filter(F.coalesce(F.element_at(let, F.col("shard") * len(capacity) + F.col("to")), F.lit(0)) > 0)
    movers = split_join(state, wish, ["group", "shard"], "n", total).select("row", "shard", "to")
    let_in = _numbered(movers, ["shard", "to"], buckets, "_p").filter(F.col("_p") < F.element_at(let, F.col("shard") * len(capacity) + F.col("to"))).select("row", F.col("to").alias("new"))
    new = scratch.keep(state.join(let_in, "row", "left").select("row", "group", F.coalesce("new", "shard").alias("shard")), f"state-{i}")
    scratch.drop(f"wishes-{i}")
    scratch.drop(f"state-{i - 1}")
    return new, sum(allowed.values())


def cut_links(sharded: DataFrame) -> DataFrame:
    """How many links of (member, group's main shard) are cut, of how many: ``linked, cut``."""
    held = sharded.groupBy("text_crc32", "size", "shard").agg(F.count("*").alias("n"))
    by = held.groupBy("text_crc32", "size").agg(F.sum("n").alias("all"), F.max("n").alias("main")).filter("all > 1")
    return by.agg(F.sum("all").alias("linked"), F.sum(F.col("all") - F.col("main")).alias("cut"))
