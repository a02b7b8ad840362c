"""Hypergraph operators: pins(edge_id, node_id), assign(node_id, part), edges(edge_id, width, entropy), part 0 = A, 1 = B."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions import scores
from netquarry.operators.tables import release, settle


def distinct_pins(raw: DataFrame, min_degree: int = 2, max_degree: int | None = None) -> DataFrame:
    """Pins without repeats, of edges within the degree bounds.

    Repeats are dealt by edge and node, degrees are counted before the shuffle, and the join that keeps pins can be split by
    the planner: a clock net with a pin on every cell is in no one task.
    """
    pins = raw.select("edge_id", "node_id").where("edge_id IS NOT NULL AND node_id IS NOT NULL").distinct()
    degree = pins.groupBy("edge_id").agg(F.count("*").alias("_degree")).where(F.col("_degree") >= min_degree)
    return pins.join(degree.where(F.col("_degree") <= max_degree) if max_degree else degree, "edge_id").drop("_degree")


def supernodes(clusters: DataFrame) -> DataFrame:
    """(super_id): of clusters(node_id, super_id) those that hold more than one node."""
    return clusters.groupBy("super_id").agg(F.count("*").alias("n")).where("n > 1").select("super_id")


def degrees(pins: DataFrame) -> DataFrame:
    return pins.groupBy("edge_id").agg(F.count("*").alias("degree"))


def high_fanout(pins: DataFrame, limit: int = 200) -> DataFrame:
    """(edge_id, degree) of nets with more distinct nodes than the limit."""
    return pins.groupBy("edge_id").agg(F.count_distinct("node_id").alias("degree")).where(F.col("degree") > limit)


def dangling(pins: DataFrame) -> DataFrame:
    """(edge_id, node_id): the ports that nets with one node get."""
    return pins.groupBy("edge_id").agg(F.count_distinct("node_id").alias("n"), F.min("node_id").alias("node_id")).where("n < 2").select("edge_id", "node_id")


def strip_ports(pins: DataFrame, ports: DataFrame) -> DataFrame:
    """Pins without those of ports (node_id), then without nets of less than two pins."""
    return distinct_pins(pins.join(ports.select("node_id").distinct(), "node_id", "left_anti"))


def sides(pins: DataFrame, assign: DataFrame) -> DataFrame:
    """(edge_id, cnt_a, cnt_b)"""
    return pins.join(assign, "node_id").groupBy("edge_id").agg(F.count(F.when(F.col("part") == 0, 1)).alias("cnt_a"), F.count(F.when(F.col("part") == 1, 1)).alias("cnt_b"))


def crosses() -> Column:
    return (F.col("cnt_a") > 0) & (F.col("cnt_b") > 0)


def critical() -> Column:
    """Only nets with two pins or fewer on a side can change a gain."""
    return (F.col("cnt_a") <= 2) | (F.col("cnt_b") <= 2)


def edge_weight(use_entropy: bool) -> Column:
    return F.col("entropy") if use_entropy else F.col("width")


def cut_metrics(pins: DataFrame, assign: DataFrame, edges: DataFrame, use_entropy: bool = False) -> DataFrame:
    """One row: n_edges, n_cut, cut_cost, cut_span, cut_entropy."""
    cut = sides(pins, assign).join(edges, "edge_id").withColumn("cross", crosses())
    pick = lambda c: F.coalesce(F.sum(F.when(F.col("cross"), c)), F.lit(0))
    return cut.agg(
        F.count("*").alias("n_edges"), F.count(F.when(F.col("cross"), 1)).alias("n_cut"), pick(edge_weight(use_entropy)).cast("double").alias("cut_cost"), pick(F.col("width").cast("int")).cast("long").alias("cut_span"),
        F.round(pick(F.col("entropy")).cast("double"), 6).alias("cut_entropy"))


def cut_edges(pins: DataFrame, assign: DataFrame) -> DataFrame:
    return sides(pins, assign).where(crosses())


def gains(pins: DataFrame, assign: DataFrame, edges: DataFrame, use_entropy: bool = False) -> DataFrame:
    """(node_id, part, gain): what the cut loses if the node alone moves.

    Counts by side are summed before the shuffle and joined back to the pins, so that a net with very many is in no one task.
    """
    sided = pins.join(assign, "node_id")
    counts = sided.groupBy("edge_id").agg(F.count(F.when(F.col("part") == 0, 1)).alias("cnt_a"), F.count(F.when(F.col("part") == 1, 1)).alias("cnt_b"))
    rows = sided.join(counts.join(edges, "edge_id"), "edge_id")
    mine, other = F.when(F.col("part") == 0, F.col("cnt_a")).otherwise(F.col("cnt_b")), F.when(F.col("part") == 0, F.col("cnt_b")).otherwise(F.col("cnt_a"))
    return rows.groupBy("node_id", "part").agg(F.sum(scores.gain_part(mine, other, edge_weight(use_entropy))).alias("gain"))


def selected(nodes: DataFrame) -> DataFrame:
    """(node_id, weight): the weight vector of the chosen implementation of nodes(node_id, impls, sel)."""
    return nodes.select("node_id", F.get("impls", F.col("sel")).alias("weight"))


def balance(weights: DataFrame, assign: DataFrame) -> DataFrame:
    """(res_id, w_a, w_b, balance, total); sums by resource are made before the shuffle."""
    long = weights.join(assign, "node_id").select("part", F.posexplode("weight").alias("res_id", "w"))
    by = long.groupBy("res_id").agg(*[F.coalesce(F.sum(F.when(F.col("part") == p, F.col("w"))), F.lit(0)).cast("long").alias(n) for p, n in ((0, "w_a"), (1, "w_b"))])
    return by.withColumn("balance", F.col("w_a") - F.col("w_b")).withColumn("total", F.col("w_a") + F.col("w_b"))


def as_arrays(by_resource: DataFrame, **columns: str | Column) -> DataFrame:
    """One row with an array for each column, in order of res_id: as many elements as there are resources."""
    row = by_resource.agg(F.array_sort(F.collect_list(F.struct("res_id", *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]))).alias("rows"))

    def field(n: str) -> Column:
        return F.transform("rows", lambda r: r[n]).alias(n)

    return row.select(*[field(n) for n in columns])


def resource_report(by_resource: DataFrame, ratio: dict[int, int], share: float) -> DataFrame:
    """By resource: totals, allowance, imbalance and ratios of the graph and of both parts."""
    every = Window.partitionBy()  # one row for each resource
    s = lambda c: F.sum(c).over(every)
    frac = lambda a, b: F.round(F.when(b == 0, 0.0).otherwise(a / b), 9)
    allowed = scores.max_imbalance(F.col("total"), share)
    return by_resource.select(
        "res_id", "total", allowed.alias("max_imbalance"), frac(F.abs("balance"), F.col("total")).alias("imbalance"), frac(F.col("total"), s("total")).alias("graph_ratio"), frac(F.col("w_a"), s("w_a")).alias("ratio_a"),
        frac(F.col("w_b"), s("w_b")).alias("ratio_b"), (F.abs("balance") > allowed).alias("violated"))


def rms_deviation(by_resource: DataFrame, ratio: dict[int, int]) -> DataFrame:
    """One row: rms_a, rms_b, rms_avg, the root mean square over resources of each part's relative distance from the target ratios."""
    total = sum(ratio.values())
    target = F.create_map(*[x for r, n in ratio.items() for x in (F.lit(r), F.lit(n / total))])[F.col("res_id")]
    sums = by_resource.select("*", *[F.sum(w).over(Window.partitionBy()).alias(f"sum_{w}") for w in ("w_a", "w_b")])  # one row for each resource
    rms = lambda w: F.sqrt(F.avg(F.when(F.col(w) == 0, 0.0).otherwise(F.pow(F.abs(F.col(f"sum_{w}") * target - F.col(w)) / F.col(w), F.lit(2)))))
    return sums.agg(rms("w_a").alias("a"), rms("w_b").alias("b")).select(F.round("a", 9).alias("rms_a"), F.round("b", 9).alias("rms_b"), F.round((F.col("a") + F.col("b")) / 2, 9).alias("rms_avg"))


def neighbours(pins: DataFrame, max_degree: int = 50) -> DataFrame:
    """(node_id, neighbour_id), distinct, over nets below max_degree pins; larger ones would give the square of their degree."""
    small = distinct_pins(pins, 2, max_degree - 1)
    other = small.withColumnRenamed("node_id", "neighbour_id")
    return small.join(other, "edge_id").where("node_id <> neighbour_id").select("node_id", "neighbour_id").distinct()


def contract(pins: DataFrame, clusters: DataFrame) -> DataFrame:
    """Pins between clusters(node_id, super_id): nets inside one cluster vanish, the others keep one pin for each cluster."""
    return distinct_pins(pins.join(clusters, "node_id").select("edge_id", F.col("super_id").alias("node_id")))


def project(assign: DataFrame, clusters: DataFrame) -> DataFrame:
    """The clusters' parts, given back to their nodes."""
    return clusters.join(assign.withColumnRenamed("node_id", "super_id"), "super_id").select("node_id", "part")


def tops(parents: DataFrame) -> DataFrame:
    """(node_id, top, height): for every node of parents(node_id, super_id), a forest of any number of levels, its highest ancestor and how far up that is.

    By pointer doubling: rounds grow with the logarithm of the height, and each writes one table. A node that is its own
    ancestor is an error.
    """
    found = settle(parents.select("node_id", F.col("super_id").alias("top"), F.lit(1).cast("long").alias("height")))
    deepest = found.count()
    while True:
        up = found.select(F.col("node_id").alias("top"), F.col("top").alias("next"), F.col("height").alias("more"))
        joined = found.join(up, "top", "left")
        new = settle(joined.select("node_id", F.coalesce("next", "top").alias("top"), (F.col("height") + F.coalesce("more", F.lit(0))).alias("height"), F.col("next").isNotNull().alias("moved")))
        release(found)
        found = new.drop("moved")
        if new.where("moved").isEmpty():
            return found
        if not new.where(F.col("height") > deepest).isEmpty():
            raise ValueError("a supernode holds itself")


def hierarchy_balance(weights: DataFrame, parents: DataFrame, assign: DataFrame) -> DataFrame:
    """balance() of the leaves that the parts (node_id, part) of the highest supernodes hold, over all levels of parents(node_id, super_id)."""
    leaves = weights.join(tops(parents), "node_id").join(assign.withColumnRenamed("node_id", "top"), "top")
    return balance(weights, leaves.select("node_id", "part"))


def cluster_weights(weights: DataFrame, clusters: DataFrame) -> DataFrame:
    """(node_id, weight) of the clusters: sums of their nodes' vectors."""
    long = weights.join(clusters, "node_id").select("super_id", F.posexplode("weight").alias("res_id", "w"))
    sums = long.groupBy("super_id", "res_id").agg(F.sum("w").cast("int").alias("w"))
    return sums.groupBy("super_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("res_id", "w"))), lambda r: r["w"]).alias("weight")).withColumnRenamed("super_id", "node_id")


def boundary(pins: DataFrame, members: DataFrame) -> DataFrame:
    """(edge_id, internal) of the nets that touch the set of nodes: whether all their pins are in it."""
    marked = pins.join(members.select("node_id", F.lit(True).alias("inside")), "node_id", "left")
    by = marked.groupBy("edge_id").agg(F.count("inside").alias("n_in"), F.count("*").alias("n"))
    return by.where("n_in > 0").select("edge_id", (F.col("n_in") == F.col("n")).alias("internal"))


def internal_edges(pins: DataFrame, assign: DataFrame) -> DataFrame:
    """(edge_id, part): nets whose pins are all in one part; the others go when parts are divided further."""
    by = pins.join(assign, "node_id").groupBy("edge_id").agg(F.min("part").alias("part"), F.max("part").alias("last"))
    return by.where("part = last").select("edge_id", "part")


def same_partition(one: DataFrame, other: DataFrame) -> DataFrame:
    """One row, identical: whether two assignments are the same up to a swap of A and B."""
    both = one.withColumnRenamed("part", "p").join(other.withColumnRenamed("part", "q"), "node_id", "full_outer")
    n = both.agg(F.count("*").alias("n"), F.count(F.when(F.col("p") == F.col("q"), 1)).alias("equal"), F.count(F.when(F.col("p") != F.col("q"), 1)).alias("swapped"))
    return n.select(((F.col("equal") == F.col("n")) | (F.col("swapped") == F.col("n"))).alias("identical"))


def top_by_affinity(gained: DataFrame, weights: DataFrame, allowed: list[int], depth: int = 3) -> DataFrame:
    """(part, res_id, node_id, gain, rank): the best `depth` moves of each part and resource of affinity."""
    bound = F.array(*[F.lit(a) for a in allowed])
    rows = gained.join(weights, "node_id").withColumn("res_id", scores.affinity(F.col("weight"), bound))
    order = Window.partitionBy("part", "res_id").orderBy(F.desc("gain"), "node_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth).select("part", "res_id", "node_id", "gain", "rank")


def best_prefix(moves: DataFrame, start: float) -> DataFrame:
    """(run_id, best_step, best_cost) of move sequences (run_id, step, gain): the shortest prefix with the lowest cost."""
    cost = F.lit(start) - F.sum("gain").over(Window.partitionBy("run_id").orderBy("step"))
    best = moves.withColumn("cost", F.round(cost, 6)).groupBy("run_id").agg(F.min(F.struct("cost", "step")).alias("b"))
    keep = F.col("b.cost") < start
    return best.select("run_id", F.when(keep, F.col("b.step")).otherwise(0).alias("best_step"), F.when(keep, F.col("b.cost")).otherwise(F.lit(start)).alias("best_cost"))


def run_statistics(runs: DataFrame, metric: str) -> DataFrame:
    """One row over the runs: min, max, average, upper median, population standard deviation."""
    ordered = runs.select(F.row_number().over(Window.orderBy(metric)).alias("i"), metric)  # a row for each run of the partitioner
    n = runs.agg(F.count("*").alias("n"), *[f(metric).alias(a) for f, a in ((F.min, "min"), (F.max, "max"), (F.avg, "avg"), (F.stddev_pop, "sigma"))])
    upper = ordered.crossJoin(F.broadcast(n.select("n"))).where(F.col("i") == F.floor(F.col("n") / 2) + 1).select(F.col(metric).alias("median"))
    return n.crossJoin(upper).select("n", "min", "max", F.round("avg", 9).alias("avg"), "median", F.round("sigma", 9).alias("sigma"))


def run_histogram(runs: DataFrame, metric: str, cumulative: bool = False) -> DataFrame:
    """(bucket, low, high, n): ten, five or one buckets by the spread of the values."""
    runs = settle(runs.select(metric))  # a row for each run, which the bounds and the counts read
    low, high = runs.agg(F.min(metric), F.max(metric)).first()
    if low is None:
        return runs.select(F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("n")).where("false")
    buckets = 10 if (high - low) / 10 > 10 else 5 if (high - low) / 5 > 10 else 1
    width = int((high - low) / buckets + 1)
    at = F.least(F.lit(buckets - 1), F.floor((F.col(metric) - low) / width)).cast("int")
    counts = runs.groupBy(at.alias("bucket")).agg(F.count("*").alias("n"))
    spark = runs.sparkSession
    edges = spark.createDataFrame([(i, int(low) + i * width, int(low) + (i + 1) * width) for i in range(buckets)], "bucket int, low long, high long")
    out = edges.join(counts, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out.withColumn("n", F.sum("n").over(Window.orderBy("bucket"))) if cumulative else out


def kway_cumulative(levels: DataFrame) -> DataFrame:
    """(level, best_run, cumulative_cost): by level the run with the least cost summed over all levels so far."""
    total = F.sum("cost").over(Window.partitionBy("run_id").orderBy("level"))
    best = levels.withColumn("total", F.round(total, 6)).groupBy("level").agg(F.min(F.struct("total", "run_id")).alias("b"))
    return best.select("level", F.col("b.run_id").alias("best_run"), F.col("b.total").alias("cumulative_cost"))
