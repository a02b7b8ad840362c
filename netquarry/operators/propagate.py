"""Signal probabilities through gate-level circuits.

gates(wire, kind, init, inputs array<string>): outputs of cells and the wires they follow from, as functions.cells makes them;
seeds(wire, p1): known wires.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from netquarry.functions import cells
from netquarry.operators.tables import mkdirs, release, settle, shared_folder

UNKNOWN = 0.5


def drivers(cells: DataFrame) -> DataFrame:
    """cells whose wire has one driver; wires with several are unknown (0.5), as undriven ones are, unless seeds have them."""
    many = cells.groupBy("wire").agg(F.count("*").alias("n")).where("n > 1").select("wire")
    return cells.join(many, "wire", "left_anti")


def propagate(gates: DataFrame, seeds: DataFrame) -> DataFrame:
    """(wire, p1, level) of all wires: level by level, each gate once, when its inputs are known.

    gates(wire, init, inputs[, kind]); without kind they are LUTs. Seeds win over gates. Inputs that nothing drives, or that
    several gates drive, are unknown (0.5), as is a null. Where gates are left that all wait for one another, wires that are
    smaller by name than every wire they are linked with among those on loops, or between loops, count as 0.5 for the gates
    that use them, and the levels go on; their own probability follows from their inputs like any other. A gate's level is one
    more than its inputs' highest; a wire that counts as 0.5 on a loop has the highest level known by then.

    A round gives the wires that the last one found to the inputs that wait for them, and looks at the gates that got some; the
    others are neither moved nor written again. A gate that waits for one input alone is a straight line in its probability:
    such lines are put together, so that a chain of gates is known in one round with the wire that it begins from.
    """
    spark = gates.sparkSession
    if "kind" not in gates.columns:
        gates = gates.withColumn("kind", F.lit("lut"))
    gates = settle(drivers(gates).join(seeds.select("wire"), "wire", "left_anti").select("wire", "kind", "init", "inputs"))
    seeds = seeds.select("wire", F.col("p1").cast("double").alias("p1"))
    used = gates.select(F.explode("inputs").alias("wire")).where(F.col("wire").isNotNull()).distinct()
    undriven = used.join(gates.select("wire"), "wire", "left_anti").join(seeds.select("wire"), "wire", "left_anti").select("wire", F.lit(UNKNOWN).alias("p1"))
    alone = F.size("inputs") == 0
    constant = gates.where(alone).select("wire", cells.output(F.col("kind"), F.col("init"), F.array().cast("array<double>")).alias("p1"), F.lit(1).alias("level"))
    done = [settle(seeds.unionByName(undriven).withColumn("level", F.lit(0)).unionByName(constant))]
    rows = settle(gates.where(~alone).select(F.col("wire").alias("gate"), "kind", "init", F.size("inputs").alias("need"), F.posexplode("inputs").alias("slot", "wire")))
    left, highest, broken = gates.where(~alone).count(), done[0].agg(F.max("level")).first()[0] or 0, None
    release(gates)
    while left:
        values = together(done)
        if broken is not None:
            values = broken.unionByName(values.join(broken.select("wire"), "wire", "left_anti"))
        waiting = opened(rows, values)
        fresh, every, rounds = None, LINES_EVERY, 0
        while True:
            seen = Observation()
            found = complete(waiting.got[0]) if fresh is None else evaluated(waiting, fresh)
            fresh = settle(found.observe(seen, F.count(F.lit(1)).alias("n"), F.max("level").alias("level")))
            waiting.fresh = n = seen.get["n"]
            highest, left = max(highest, seen.get["level"] or 0), left - n
            if n:
                done.append(fresh)
            if not left or not n:
                break
            rounds += 1
            if rounds == every:
                every, rounds = LINES_EVERY if put_together(waiting, fresh) > 2 * every else 2 * every, 0
        release(waiting.edges, waiting.lines, *waiting.got)
        if left:
            rest = settle(rows.join(together(done).select(F.col("wire").alias("gate")), "gate", "left_anti"))
            release(rows)
            rows, seen_wires = rest, together(done).select("wire")
            if broken is not None:
                seen_wires = seen_wires.unionByName(broken.select("wire"))
            new = smallest_on_loops(rows.where(F.col("wire").isNotNull()).join(seen_wires, "wire", "left_anti")).withColumn("level", F.lit(highest))
            broken = settle(new if broken is None else broken.unionByName(new))
    release(rows)
    return together(done)


#: What a waiting gate knows of the one input that it waits for: p1 is a + b times that of the wire, and the level at least
#: since and hops over the wire's.
LINE = "gate string, wire string, a double, b double, hops int, since int"
MOST_HOPS = 1 << 28
#: Rounds after which lines are put together again; twice as many after a time that found none longer than these.
LINES_EVERY = 4
#: Lines that one task puts together.
LINES_A_TASK = 1 << 17
#: Inputs are written again, without those that are known, once one in so many of them is found.
PART_FOUND = 8


@dataclass
class Waiting:
    """Gates that wait. edges(wire, gate, slot, kind, init, need): inputs of gates without a line, those of passed wires may be
    among them; got: tables of inputs with p1 and level; lines: of gates that are in edges no more."""

    edges: DataFrame
    n_edges: int
    got: list[DataFrame]
    lines: DataFrame | None = None
    passed: list[DataFrame] = field(default_factory=list)
    fresh: int = 0


def together(tables: list[DataFrame]) -> DataFrame:
    """Rows of settled tables of one kind, as one table of all their files."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[x.settled_at for x in tables])


GOT = ("gate", "slot", "kind", "init", "need", "p1", "level")


def split(edges: DataFrame, values: DataFrame, more: DataFrame | None = None) -> tuple[DataFrame, int, DataFrame]:
    """Edges whose wires have no value yet and how many, and the inputs that have one; more: inputs that go with these."""
    seen = Observation()
    rows = edges.join(values, "wire", "left")
    if more is not None:
        rows = rows.unionByName(more)
    rows = rows.withColumn("known", F.col("level").isNotNull()).observe(seen, F.count(F.when(F.col("level").isNull(), 1)).alias("n"))
    place = f"{shared_folder(edges.sparkSession).rstrip('/')}/inputs-{uuid.uuid4().hex}"
    rows.write.partitionBy("known").parquet(place)
    tables = []
    for known, columns in (("false", edges.columns), ("true", GOT)):
        schema, at = rows.select(*columns).schema, f"{place}/known={known}"
        mkdirs(edges.sparkSession, at)
        tables.append(edges.sparkSession.read.schema(schema).parquet(at))
        tables[-1].settled_at = at
    return tables[0], seen.get["n"], tables[1]


def opened(rows: DataFrame, values: DataFrame) -> Waiting:
    """All gates of rows, with the values that are known; inputs that are not connected are unknown."""
    open_inputs = rows.where(F.col("wire").isNull()).withColumns({"p1": F.lit(UNKNOWN), "level": F.lit(0)})
    edges, n, got = split(rows.where(F.col("wire").isNotNull()), values, open_inputs)
    return Waiting(edges, n, [got])


def outputs(*inputs: Column) -> Column:
    """A gate's output for each of some arrays of inputs, which are computed once, not at each place where the formula has them."""
    return F.transform(F.array(*inputs), lambda p: cells.output(F.col("kind"), F.col("init"), p))


def complete(got: DataFrame) -> DataFrame:
    """(wire, p1, level) of the gates that have all their inputs."""
    of = got.groupBy("gate").agg(F.first("kind").alias("kind"), F.first("init").alias("init"), F.first("need").alias("need"), F.max("level").alias("upto"), F.array_sort(F.collect_list(F.struct("slot", "p1"))).alias("got"))  # a gate's inputs
    p1 = F.get(outputs(F.col("got.p1")), F.lit(0))
    return of.where(F.size("got") == F.col("need")).select(F.col("gate").alias("wire"), p1.alias("p1"), (F.col("upto") + 1).cast("int").alias("level"))


def evaluated(waiting: Waiting, fresh: DataFrame) -> DataFrame:
    """(wire, p1, level) of the gates that the fresh wires make known."""
    waiting.passed.append(fresh)
    if waiting.fresh * PART_FOUND > waiting.n_edges:
        edges, waiting.n_edges, hits = split(waiting.edges, fresh)
        release(waiting.edges)
        waiting.edges = edges
    else:
        hits = settle(waiting.edges.join(fresh, "wire").select(*GOT))
    waiting.got.append(hits)
    found = complete(together(waiting.got).join(hits.select("gate").distinct(), "gate", "left_semi"))
    if waiting.lines is not None:
        on = waiting.lines.join(fresh, "wire")
        p1 = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("a") + F.col("b") * F.col("p1")))
        found = found.unionByName(on.select(F.col("gate").alias("wire"), p1.alias("p1"), F.greatest("since", F.col("hops") + F.col("level")).cast("int").alias("level")))
    return found


def put_together(waiting: Waiting, fresh: DataFrame) -> int:
    """Makes lines of the gates that wait for one input alone, all lines as long as they can be; returns how many gates the longest has.

    Gates may wait for fresh wires, which the next round gives them, but these have no line themselves any more.
    """
    edges = settle(waiting.edges.join(together(waiting.passed).select("wire"), "wire", "left_anti"))
    one = edges.groupBy("gate").agg(F.count(F.lit(1)).alias("open"), *[F.first(c).alias(c) for c in ("wire", "slot", "kind", "init", "need")]).where("open = 1").drop("open")
    known = together(waiting.got).groupBy("gate").agg(F.max("level").alias("upto"), F.collect_list(F.struct("slot", "p1")).alias("got"))  # a gate's inputs
    single = one.where("need = 1").withColumns({"upto": F.lit(0), "got": F.array().cast("array<struct<slot:int,p1:double>>")})
    rows = single.unionByName(one.where("need > 1").join(known, "gate"))
    at = lambda x: F.array_sort(F.concat("got", F.array(F.struct("slot", F.lit(x).alias("p1")))))["p1"]
    # a carry chain's two beginnings exclude one another, so that it has no line as long as one of them is open and the other may be 1
    other = F.filter("got", lambda x: (x["slot"] < 2) & (x["p1"] > 0))
    rows = rows.where(~(F.col("kind").isin("co", "sum") & (F.col("slot") < 2) & (F.size(other) > 0)))
    out = F.col("out")
    lines = rows.select("gate", "wire", outputs(at(0.0), at(1.0)).alias("out"), "upto").select("gate", "wire", out[0].alias("a"), (out[1] - out[0]).alias("b"), F.lit(1).alias("hops"), (F.col("upto") + 1).cast("int").alias("since"))
    if waiting.lines is not None:
        lines = lines.unionByName(waiting.lines.join(together([*waiting.passed, fresh]).select(F.col("wire").alias("gate")), "gate", "left_anti"))
    lines = settle(lines)
    n = lines.count()
    longest = 0
    if n:
        whole = contracted(lines, n, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        longest = whole.where(F.col("hops") <= n).agg(F.max("hops")).first()[0] or 0  # more than there are: on a loop
        rest = settle(edges.join(whole.select("gate"), "gate", "left_anti"))
        release(edges, waiting.lines)
        waiting.lines, edges = whole, rest
    release(waiting.edges)
    waiting.edges, waiting.n_edges = edges, edges.count()
    return longest


def contracted(lines: DataFrame, n: int, least: int = 1) -> DataFrame:
    """lines, each on the wire that its chain begins from; on a loop on some wire of it. Replaces the table.

    Names that are near one another are often linked: a task puts together what is linked within a range of names, and the
    lines that go over from range to range, if they are clearly fewer, are put together in the same way.
    """
    parts = max(least, -(-n // LINES_A_TASK))
    short = settle(lines.repartitionByRange(parts, "gate").mapInArrow(contracted_in_task, LINE) if parts > 1 else lines.coalesce(1).mapInArrow(contracted_in_task, LINE))
    release(lines)
    if parts == 1:
        return short
    heads = settle(short.join(short.select(F.col("wire").alias("gate")).distinct(), "gate", "left_semi"))
    m = heads.count()
    if not m:
        release(heads)
        return short
    ends = contracted(heads, m) if 2 * m <= n else doubled(heads, m)
    whole = settle(joined_lines(short, ends))
    release(short, ends)
    return whole


def joined_lines(lines: DataFrame, ends: DataFrame) -> DataFrame:
    """lines, those on a wire that has a line of its own in ends taken on to that one's wire."""
    next_ = ends.select(F.col("gate").alias("wire"), *[F.col(c).alias(f"_{c}") for c in ("wire", "a", "b", "hops", "since")])
    most = F.lit(MOST_HOPS)
    longer = {
        "wire": F.col("_wire"), "a": F.col("a") + F.col("b") * F.col("_a"), "b": F.col("b") * F.col("_b"), "hops": F.least(F.col("hops") + F.col("_hops"), most),
        "since": F.greatest("since", F.least(F.col("hops") + F.col("_since"), most))}
    return lines.join(next_, "wire", "left").select("gate", *[F.when(F.col("_wire").isNotNull(), x).otherwise(F.col(c)).alias(c) for c, x in longer.items()])


def doubled(lines: DataFrame, n: int) -> DataFrame:
    """As contracted(), link by link, each time twice as far."""
    for _ in range(n.bit_length()):
        new = settle(joined_lines(lines, lines))
        release(lines)
        lines = new
        if lines.join(lines.select(F.col("gate").alias("wire")), "wire", "left_semi").isEmpty():
            break
    return lines


def contracted_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a task, each taken along those of the task as far as they go, by doubling."""
    batches = list(batches)
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    wires = table["wire"].combine_chunks()
    at = pc.index_in(wires, value_set=table["gate"].combine_chunks()).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    a, b, hops, since = (table[c].to_numpy().copy() for c in ("a", "b", "hops", "since"))
    last = np.arange(len(at))  # the line whose wire this one is on
    for _ in range(len(at).bit_length() + 1):
        i = np.flatnonzero(at >= 0)
        if not len(i):
            break
        j = at[i]
        new = a[i] + b[i] * a[j], b[i] * b[j], np.maximum(since[i], np.minimum(hops[i] + since[j], MOST_HOPS)), np.minimum(hops[i] + hops[j], MOST_HOPS), last[j], at[j]
        a[i], b[i], since[i], hops[i], last[i], at[i] = new
    done = pa.table({"gate": table["gate"], "wire": wires.take(pa.array(last)), "a": a, "b": b, "hops": pa.array(hops, pa.int32()), "since": pa.array(since, pa.int32())})
    yield from done.to_batches(max_chunksize=1 << 14)


def smallest_on_loops(waiting: DataFrame) -> DataFrame:
    """(wire, p1): of the wires that lie on a loop or between loops, those smaller than all they are linked with, as unknown.

    waiting(wire, gate): all gates wait, so each has a predecessor that waits; wires from which no loop can be reached are taken away.
    """
    links = trimmed(waiting.select("wire", F.col("gate").alias("to")).distinct())
    both = links.select("wire", F.col("to").alias("other")).unionByName(links.select(F.col("to").alias("wire"), F.col("wire").alias("other")))
    return both.groupBy("wire").agg(F.min("other").alias("least")).where("wire <= least").select("wire", F.lit(UNKNOWN).alias("p1"))


#: Rounds that take away the ends of links one by one, before whole chains are followed to their ends.
SINGLE_ROUNDS = 3


def trimmed(links: DataFrame) -> DataFrame:
    """links(wire, to) without those that lead to no loop.

    After some rounds a wire with a single link is taken to the end of the chain of such wires, by doubling; if nothing goes on
    from there, the chain falls at once.
    """
    links, number = settle(links), 0
    n = links.count()
    while True:
        number += 1
        starts = links.select(F.col("wire").alias("to")).distinct()
        if number > SINGLE_ROUNDS and n:
            ends = chain_ends(links)
            dead = ends.join(starts.withColumnRenamed("to", "end"), "end", "left_anti").select(F.col("wire").alias("to"))
            starts = starts.join(dead, "to", "left_anti")
        inner = settle(links.join(starts, "to", "left_semi"))
        now = inner.count()
        release(links)
        links = inner
        if now == n:
            return links
        n = now


def chain_ends(links: DataFrame) -> DataFrame:
    """(wire, end): of the wires with a single link where the chain of such wires ends; on a loop of them some wire of it."""
    by = links.groupBy("wire").agg(F.count(F.lit(1)).alias("n"), F.min("to").alias("end"))
    pointers = settle(by.where("n = 1").select("wire", "end"))
    for _ in range(max(1, pointers.count()).bit_length()):
        further = pointers.select(F.col("wire").alias("end"), F.col("end").alias("next"))
        new = settle(pointers.join(further, "end", "left").select("wire", F.coalesce("next", "end").alias("end")))
        release(pointers)
        pointers = new
    return pointers
