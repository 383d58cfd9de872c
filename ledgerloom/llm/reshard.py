"""Minimum-cost-flow resharding: move the fewest bytes from an old layout of files to new shard capacities.

The old layout is a set of files; an expression on the file name says which old shard a file belongs to. Only sums per
shard reach the driver. They make a transportation problem, which is solved by successive shortest paths. Its solution
cuts each old shard, in the order of its files and rows, into one run per new shard; a row's place then follows by
arithmetic from its file and its row number, so no row is shuffled and no window holds more than one block of rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import materialize, scratch_path

#: Rows of a file whose sizes are added up together when a cut is looked for.
BLOCK_ROWS = 4096


def text_size(text: str) -> Column:
    """UTF-8 bytes of a text (null: none) plus one."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow from each source to each sink at least total cost; supplies and demands have equal sums.

    Successive shortest paths with potentials. The graph has one node per shard, whatever the data.
    """
    n, m = len(supply), len(demand)
    left, want = list(supply), list(demand)
    flow = [[0] * m for _ in range(n)]
    potential = [0] * (n + m)
    while any(left):
        dist: list[float] = [0 if i < n and left[i] else float("inf") for i in range(n + m)]
        before = [-1] * (n + m)
        queue = [(0, i) for i in range(n) if left[i]]
        while queue:
            d, u = heapq.heappop(queue)
            if d > dist[u]:
                continue
            if u < n:
                steps = [(n + j, cost[u][j]) for j in range(m)]
            else:
                steps = [(i, -cost[i][u - n]) for i in range(n) if flow[i][u - n]]
            for v, c in steps:
                reach = d + c + potential[u] - potential[v]
                if reach < dist[v]:
                    dist[v], before[v] = reach, u
                    heapq.heappush(queue, (reach, v))
        end = min((j for j in range(m) if want[j]), key=lambda j: dist[n + j] + potential[n + j])
        farthest = max(d for d in dist if d != float("inf"))
        potential = [p + min(d, farthest) for p, d in zip(potential, dist, strict=True)]
        path, node = [], n + end
        while before[node] >= 0:
            path.append((before[node], node))
            node = before[node]
        amount = min([left[node], want[end], *(flow[v][u - n] for u, v in path if u >= n)])
        for u, v in path:
            if u < n:
                flow[u][v - n] += amount
            else:
                flow[v][u - n] -= amount
        left[node] -= amount
        want[end] -= amount
    return flow


@dataclass
class Run:
    """Rows of an old shard from one position to another that go to one new shard; slots start at `slot`."""

    old: int
    new: int
    first: int
    last: int
    slot: int = 0


@dataclass
class Plan:
    """What moves: the runs of each old shard, the place of each file in its old shard, and the bytes that move."""

    runs: list[Run]
    files: DataFrame
    moved_bytes: int
    total_bytes: int


def plan_transfers(rows: DataFrame, old_shard: Column, text: str, capacities: list[float] | int) -> Plan:
    """Solve the transfers for a table of files.

    `rows` is read from files whose row numbers Spark knows (Parquet); `old_shard` is an expression on `__name`, the
    file name without its folder. `capacities` are the shares of the new shards (an integer: so many equal ones). New shard k keeps what old shard
    k has, as far as its capacity goes, for nothing; any other byte costs one. A row that a cut would split stays on the
    side that holds its middle, so a shard is off its share by less than one row per run.
    """
    shares = [1.0] * capacities if isinstance(capacities, int) else list(capacities)
    placed = _placed(rows, old_shard).withColumn("__size", text_size(text))
    blocks = materialize(
        placed.groupBy("__old", "__file", F.expr(f"__row div {BLOCK_ROWS}").alias("__block")).agg(
            F.count("*").alias("n"), F.sum("__size").alias("bytes")
        ),
        "reshard-blocks",
    )
    files = blocks.groupBy("__old", "__file").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    before = W.partitionBy("__old").orderBy("__file").rowsBetween(W.unboundedPreceding, -1)
    files = files.select(
        "__old", "__file", "n", "bytes",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start_row"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start_byte"),
    )
    olds = {r["__old"]: (r["n"], r["bytes"]) for r in files.groupBy("__old").agg(
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).collect()}
    names = sorted(olds)
    total = sum(b for _, b in olds.values())
    marks = [round(total * sum(shares[: k + 1]) / sum(shares)) for k in range(len(shares))]
    wanted = [b - a for a, b in zip([0, *marks], marks, strict=False)]
    cost = [[0 if old == new else 1 for new in range(len(shares))] for old in names]
    flow = min_cost_flow([olds[k][1] for k in names], wanted, cost)
    runs, cuts = [], []
    for old, sent in zip(names, flow, strict=True):
        at = 0
        order = sorted((new for new in range(len(shares)) if sent[new]), key=lambda new: (new != old, new))
        for new in order:
            runs.append(Run(old, new, 0, olds[old][0]))
            at += sent[new]
            if new != order[-1]:
                cuts.append((old, len(runs) - 1, at))
    for k, row in _cut_rows(placed, blocks, files, cuts).items():
        runs[k].last = runs[k + 1].first = row
    used = [0] * len(shares)
    for run in runs:
        run.slot = used[run.new]
        used[run.new] += run.last - run.first
    stayed = sum(sent[old] for old, sent in zip(names, flow, strict=True) if old < len(shares))
    return Plan(runs, files, total - stayed, total)


def _placed(rows: DataFrame, old_shard: Column) -> DataFrame:
    """`rows` with their file, their number in it and their old shard."""
    return rows.withColumns({
        "__file": F.col("_metadata.file_path"), "__name": F.col("_metadata.file_name"), "__row": F.col("_metadata.row_index"),
    }).withColumn("__old", old_shard.cast("int"))


def _cut_rows(placed: DataFrame, blocks: DataFrame, files: DataFrame, cuts: list[tuple[int, int, int]]) -> dict[int, int]:
    """For each cut (old shard, key, bytes before it), the first row of the old shard behind it.

    First the file is found, then the block of rows in it, then the row; each step looks at one file or block per cut.
    """
    if not cuts:
        return {}
    spark = placed.sparkSession
    table = spark.createDataFrame(cuts, "__old int, __key int, __at long")
    # One row per cut: at most as many as there are old and new shards together.
    in_file = F.broadcast(table).join(files, "__old").where(
        (F.col("__at") >= F.col("start_byte")) & (F.col("__at") < F.col("start_byte") + F.col("bytes"))
    ).select("__key", "__at", "__old", "__file", "start_row", "start_byte")
    before = W.partitionBy("__old", "__file").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    sums = blocks.select(
        "__old", "__file", "__block", "bytes", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("done")
    )
    found = sums.join(F.broadcast(in_file), ["__old", "__file"]).withColumn(
        "start_byte", F.col("start_byte") + F.col("done")
    ).where((F.col("__at") >= F.col("start_byte")) & (F.col("__at") < F.col("start_byte") + F.col("bytes"))).select(
        "__key", "__at", "__old", "__file", "__block", "start_row", "start_byte"
    ).collect()
    near = reduce(
        lambda a, b: a | b,
        [(F.col("__file") == r["__file"]) & (F.col("__old") == r["__old"]) & (F.col("__row") >= r["__block"] * BLOCK_ROWS)
         & (F.col("__row") < (r["__block"] + 1) * BLOCK_ROWS) for r in found],
    )
    side = F.broadcast(spark.createDataFrame(
        [tuple(r) for r in found],
        "__key int, __at long, __old int, __file string, __block long, start_row long, start_byte long",
    ))
    block = placed.where(near).select("__old", "__file", "__row", "__size").withColumn(
        "__block", F.expr(f"__row div {BLOCK_ROWS}")
    ).join(side, ["__old", "__file", "__block"])
    inside = W.partitionBy("__key").orderBy("__row").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = F.col("start_byte") + F.sum("__size").over(inside)
    middle = ends - F.col("__size") / 2
    behind = block.withColumn("__behind", middle > F.col("__at")).groupBy("__key", "start_row").agg(
        F.min(F.when(F.col("__behind"), F.col("__row"))).alias("row"), F.max("__row").alias("end")
    )
    return {r["__key"]: r["start_row"] + (r["end"] + 1 if r["row"] is None else r["row"]) for r in behind.collect()}


def assign(rows: DataFrame, old_shard: Column, plan: Plan) -> DataFrame:
    """`rows` with `shard`, `slot` (gapless from 0 in each shard) and `moved`; columns so named are replaced.

    Rows are counted by file, so the same rows in files of other names or cuts may go to other shards and slots.

    The runs are a few literals per old shard; the file offsets are one row per file and join as Catalyst sees fit.
    """
    placed = _placed(rows.drop("shard", "slot", "moved"), old_shard)
    start = plan.files.select(F.col("__file").alias("__path"), F.col("__old").alias("__of"), F.col("start_row").alias("__start"))
    placed = placed.join(start, (F.col("__file") == F.col("__path")) & (F.col("__old") == F.col("__of")), "left")
    at = F.col("__start") + F.col("__row")
    place = F.struct(F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"))
    for run in reversed(plan.runs):
        here = (F.col("__old") == run.old) & (at >= run.first) & (at < run.last)
        place = F.when(here, F.struct(
            F.lit(run.new).alias("shard"), (at - run.first + run.slot).cast("long").alias("slot")
        )).otherwise(place)
    placed = placed.withColumn("__place", place)
    return placed.select(
        *[F.col(c) for c in rows.columns if c.lower() not in ("shard", "slot", "moved")],
        F.col("__place.shard").alias("shard"), F.col("__place.slot").alias("slot"),
        (F.col("__place.shard") != F.col("__old")).alias("moved"), F.col("__file").alias("__source"),
    )


def reshard(rows: DataFrame, old_shard: Column, text: str, capacities: list[float] | int) -> tuple[DataFrame, Plan]:
    """Carry the plan out: rewrite the files that lose or gain rows, leave the others where they are.

    A file is affected when any of its rows moves. Affected files are written anew, split by shard, into the shared
    folder; the returned table reads these and the untouched files and has every column of `rows` besides `shard`, `slot`
    and `moved`. Null texts count one byte; an empty table gives an empty table; repeated rows are rows like any other.
    """
    plan = plan_transfers(rows, old_shard, text, capacities)
    placed = assign(rows, old_shard, plan)
    last = F.col("start_row") + F.col("n")
    whole = reduce(lambda a, b: a | b, [
        (F.col("__old") == r.old) & (F.col("start_row") >= r.first) & (last <= r.last) for r in plan.runs if r.old == r.new
    ], F.lit(False))
    untouched = plan.files.where(whole).select(F.col("__file").alias("__source"))
    untouched = materialize(untouched, "reshard-untouched")
    stay = placed.join(untouched, "__source", "left_semi").drop("__source")
    path = scratch_path(rows.sparkSession, "reshard")
    placed.join(untouched, "__source", "left_anti").drop("__source").write.partitionBy("shard").parquet(path)
    spark: SparkSession = rows.sparkSession
    written = spark.read.schema(stay.schema).parquet(path).select(*stay.columns)
    return stay.unionByName(written), plan
