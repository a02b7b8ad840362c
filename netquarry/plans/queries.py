"""The registered queries over the benchmark tables, each an application of the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netquarry.functions import cells, names, probability, scores
from netquarry.operators import bisect, dwell, hypergraph, ilp, implementations, multilevel, propagate, tables
from netquarry.plans import domain as D
from netquarry.sources import graph_xml, text_formats, vcd, verilog
from netquarry.streaming import trace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# -- hypergraph ------------------------------------------------------------------


@query
def hg_pins(spark, d):
    return D.pins(spark, d)


@query
def hg_degree_hist(spark, d):
    return hypergraph.degrees(D.pins(spark, d)).groupBy("degree").agg(F.count("*").alias("n_edges"))


@query
def hg_cut_cost(spark, d):
    return hypergraph.cut_metrics(D.pins(spark, d), D.assign(spark, d), D.edges(spark, d))


@query
def hg_cut_entropy(spark, d):
    found = hypergraph.cut_metrics(D.pins(spark, d), D.assign(spark, d), D.edges(spark, d), use_entropy=True)
    return found.select("n_cut", F.round("cut_cost", 6).alias("cut_cost"))


@query
def hg_cut_edges(spark, d):
    return hypergraph.cut_edges(D.pins(spark, d), D.assign(spark, d))


@query
def hg_critical_edges(spark, d):
    return hypergraph.sides(D.pins(spark, d), D.assign(spark, d)).select("edge_id", hypergraph.critical().alias("critical"), hypergraph.crosses().alias("crosses"))


def _balance(spark, d):
    return hypergraph.balance(hypergraph.selected(D.nodes(spark, d)), D.assign(spark, d))


@query
def hg_balance(spark, d):
    return _balance(spark, d)


@query
def hg_resource_report(spark, d):
    return hypergraph.resource_report(_balance(spark, d), D.RATIO, D.SHARE)


@query
def hg_max_imbalance(spark, d):
    return _balance(spark, d).select("res_id", scores.max_imbalance(F.col("total"), D.SHARE).alias("max_imbalance"))


def _arrays(spark, d):
    return hypergraph.as_arrays(_balance(spark, d), balance="balance", total="total", allowed=scores.max_imbalance(F.col("total"), D.SHARE), ratio=F.create_map(*[F.lit(x).cast("long") for kv in D.RATIO.items() for x in kv])[F.col("res_id").cast("long")])


@query
def hg_imbalance_power(spark, d):
    b, m = F.col("balance"), F.col("allowed")
    return _arrays(spark, d).select(
        F.round(scores.imbalance_power(b, m), 6).alias("imbalance_power"), F.round(scores.near_violator_power(b, m), 6).alias("near_power"), F.round(scores.violator_power(b, m), 6).alias("violator_power"),
        scores.exceeds(b, m).alias("violated"))


@query
def hg_ratio_power(spark, d):
    return _arrays(spark, d).select(F.round(scores.ratio_power(F.col("total"), F.col("ratio")), 9).alias("ratio_power"))


@query
def hg_ratio_power_if_changed(spark, d):
    """For every node with a choice: the ratio power if it took its next implementation."""
    found = D.nodes(spark, d).where(F.size("impls") > 1).join(F.broadcast(_arrays(spark, d)))  # a single row
    after = F.get("impls", ((F.col("sel") + 1) % F.size("impls")).cast("int"))
    return found.select("node_id", F.round(scores.ratio_power_if_changed(F.col("total"), F.get("impls", F.col("sel")), after, F.col("ratio")), 9).alias("ratio_power"))


@query
def hg_rms_deviation(spark, d):
    return hypergraph.rms_deviation(_balance(spark, d), D.RATIO)


def _gains(spark, d):
    return hypergraph.gains(D.pins(spark, d), D.assign(spark, d), D.edges(spark, d))


@query
def hg_initial_gains(spark, d):
    return _gains(spark, d)


@query
def hg_move_scores(spark, d):
    """For every node: the imbalance power if it changes sides, and that less its gain."""
    found = _gains(spark, d).join(hypergraph.selected(D.nodes(spark, d)), "node_id").join(F.broadcast(_arrays(spark, d)))  # a single row
    power = scores.imbalance_power(scores.balance_if_moved(F.col("balance"), F.col("weight"), F.col("part") == 0), F.col("allowed"))
    return found.select("node_id", F.round(power, 6).alias("power_if_moved"), F.round(power - F.col("gain"), 6).alias("score"))


@query
def hg_adaptive_impl(spark, d):
    found = D.nodes(spark, d).where(F.size("impls") > 1).join(D.assign(spark, d), "node_id").join(F.broadcast(_arrays(spark, d)))  # a single row
    return found.select("node_id", implementations.adaptive(found, F.col("balance"), F.col("allowed"), F.col("part") == 0).alias("impl"))


@query
def hg_affinity(spark, d):
    bound = F.array(*[F.lit(x) for x in D.CAPACITY])
    return hypergraph.selected(D.nodes(spark, d)).select("node_id", scores.affinity(F.col("weight"), bound).alias("res_id"))


@query
def hg_topk_gain(spark, d):
    return hypergraph.top_by_affinity(_gains(spark, d), hypergraph.selected(D.nodes(spark, d)), D.CAPACITY)


@query
def hg_best_prefix(spark, d):
    moves = _gains(spark, d).select((F.col("node_id") % 16).alias("run_id"), F.col("node_id").alias("step"), F.col("gain"))
    return hypergraph.best_prefix(moves, 1000.0)


@query
def hg_universal_impl(spark, d):
    return implementations.universal(D.nodes(spark, d), 2).select("node_id", "sel")


@query
def hg_lowest_cost_impl(spark, d):
    return implementations.lowest_cost(D.nodes(spark, d), D.CAPACITY).select("node_id", "sel")


@query
def hg_random_impl(spark, d):
    return implementations.random_choice(D.nodes(spark, d), 7).select("node_id", "sel")


@query
def hg_mutation(spark, d):
    return implementations.mutate(D.nodes(spark, d), 30, 7).select("node_id", "sel")


@query
def hg_proportional_impl(spark, d):
    return implementations.proportional(D.nodes(spark, d), D.CAPACITY).select("node_id", "sel")


@query
def hg_flexible_capacity(spark, d):
    return implementations.flexible_capacity(D.nodes(spark, d), D.CAPACITY)


@query
def hg_capacity_percent(spark, d):
    cap = F.create_map(*[F.lit(x).cast("long") for kv in enumerate(D.CAPACITY) for x in kv])[F.col("res_id").cast("long")]
    return _balance(spark, d).select("res_id", F.floor(F.col("total") * 100 / cap).cast("int").alias("percent"))


@query
def hg_supernode_impls(spark, d):
    """Supernodes of four cells: the current choice, how many choices there are where all combinations are taken, and whether the cap holds."""
    members = D.nodes(spark, d).withColumn("super_id", F.floor(F.col("node_id") / 4))
    found = implementations.supernode_implementations(members)
    # exact: sums of logarithms would round
    all_of = members.groupBy("super_id").agg(F.aggregate(F.collect_list(F.size("impls")), F.lit(1), lambda a, n: a * n).alias("combinations"))
    return found.join(all_of, "super_id").select("super_id", F.when(F.col("combinations") <= 16, F.size("impls")).alias("n_impls"), (F.size("impls") <= 16).alias("within_cap"), F.get("impls", F.lit(0)).alias("current"))


@query
def hg_fanout_prune(spark, d):
    return hypergraph.high_fanout(D.customer_pins(spark, d), 40)


@query
def hg_dangling_ports(spark, d):
    return hypergraph.dangling(D.raw_pins(spark, d).distinct())


@query
def hg_strip_ports(spark, d):
    return hypergraph.strip_ports(D.raw_pins(spark, d), D.table(spark, d, "part").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("node_id")))


@query
def hg_neighbors(spark, d):
    return hypergraph.neighbours(D.raw_pins(spark, d)).groupBy("node_id").agg(F.count("*").alias("n_neighbors"))


def _clusters(spark, d):
    return D.table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.floor(F.col("p_partkey") / 4).alias("super_id"))


@query
def hg_supernodes(spark, d):
    return hypergraph.supernodes(_clusters(spark, d))


@query
def hg_contract(spark, d):
    # a net of two clusters has two pins, so that repeats and short nets fall away once, between the clusters
    return hypergraph.contract(D.raw_pins(spark, d), _clusters(spark, d)).groupBy("edge_id").agg(F.count("*").alias("degree"), F.sum("node_id").alias("super_sum"))


@query
def hg_coarse_cut(spark, d):
    """The cut of the clusters' parts, on the coarse graph and given back to the nodes: the same by construction."""
    clusters = _clusters(spark, d)
    coarse = clusters.select(F.col("super_id").alias("node_id"), (F.col("super_id") % 2).cast("int").alias("part")).distinct()
    raw = D.raw_pins(spark, d).where("edge_id IS NOT NULL")  # neither repeats nor nets of one pin change which nets are cut
    a = hypergraph.cut_metrics(hypergraph.contract(raw, clusters), coarse, D.edges(spark, d)).select(F.col("n_cut").alias("coarse_cut"))
    b = hypergraph.cut_metrics(raw, hypergraph.project(coarse, clusters), D.edges(spark, d)).select(F.col("n_cut").alias("fine_cut"))
    return a.crossJoin(b)  # two single rows


@query
def hg_expand_balance(spark, d):
    coarse = _clusters(spark, d).select(F.col("super_id").alias("node_id"), (F.col("super_id") % 2).cast("int").alias("part")).distinct()
    return hypergraph.balance(hypergraph.cluster_weights(hypergraph.selected(D.nodes(spark, d)), _clusters(spark, d)), coarse)


@query
def hg_boundary_edges(spark, d):
    return hypergraph.boundary(D.pins(spark, d), D.table(spark, d, "part").where("p_partkey % 3 <> 1").select(F.col("p_partkey").alias("node_id")))


@query
def hg_kway_internal_edges(spark, d):
    four = D.table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), (F.col("p_partkey") % 4).cast("int").alias("part"))
    return hypergraph.internal_edges(D.pins(spark, d), four)


@query
def hg_swap_identity(spark, d):
    one = D.assign(spark, d)
    return hypergraph.same_partition(one, one.select("node_id", (1 - F.col("part")).alias("part")))


#: Hashed bipartitions that results are held against; the bits of a mask.
RUNS = 32


def _run_costs(spark, d):
    """Cut sizes of 32 hashed bipartitions: a node's sides are the bits of a mask, and a net is cut in those runs whose bit some of its pins have and others have not."""
    at = F.col("node_id") * 1103515245 + F.lit(12345)
    side = [F.shiftright(at + F.lit(run * 7919), 16).bitwiseAND(F.lit(1)) for run in range(RUNS)]
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(x, run) for run, x in enumerate(side)])
    by = D.pins(spark, d).select("edge_id", mask.alias("mask")).groupBy("edge_id").agg(F.bit_or("mask").alias("some"), F.bit_and("mask").alias("every"))
    cut = by.select(F.col("some").bitwiseXOR(F.col("every")).alias("cut"))
    row = cut.agg(F.count("*").alias("n"), *[F.sum(F.getbit("cut", F.lit(run))).cast("double").alias(f"cost_{run}") for run in range(RUNS)]).where("n > 0")
    return row.select(F.posexplode(F.array(*[f"cost_{run}" for run in range(RUNS)])).alias("run_id", "cost"))


@query
def hg_run_costs(spark, d):
    return _run_costs(spark, d)


@query
def hg_run_stats(spark, d):
    return hypergraph.run_statistics(_run_costs(spark, d), "cost")


@query
def hg_run_listing(spark, d):
    """The runs' costs in order, as the report lists them."""
    return _run_costs(spark, d).select(F.row_number().over(Window.orderBy("cost", "run_id")).alias("place"), "run_id", "cost").orderBy("place")  # a row for each run


@query
def hg_run_cumulative(spark, d):
    return hypergraph.run_histogram(_run_costs(spark, d), "cost", cumulative=True)


@query
def hg_run_histogram(spark, d):
    return hypergraph.run_histogram(_run_costs(spark, d), "cost")


@query
def hg_kway_min_cost(spark, d):
    levels = _run_costs(spark, d).select((F.col("run_id") % 8).alias("run_id"), F.floor(F.col("run_id") / 8).cast("int").alias("level"), "cost")
    return hypergraph.kway_cumulative(levels)


@query
def hg_cut_union(spark, d):
    """Names of nets cut by either of two partitions, as the cut-set file has them."""
    other = D.table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.when(F.col("p_partkey") % 7 < 3, 0).otherwise(1).alias("part"))
    cuts = [hypergraph.cut_edges(D.pins(spark, d), a).select(F.concat(F.lit("net"), (F.floor(F.col("edge_id") / 2)).cast("string"), F.lit("_split_"), F.col("edge_id").cast("string")).alias("name")) for a in (D.assign(spark, d), other)]
    return text_formats.cut_set_lines(cuts[0].unionByName(cuts[1])).withColumnRenamed("value", "name")


@query
def hg_violations(spark, d):
    """Checks as counts of violations: nets of less than two pins, unequal vectors, choices out of range, nodes over twice the allowance."""
    pins, nodes = D.pins(spark, d), D.nodes(spark, d)
    a = hypergraph.degrees(pins).agg(F.count(F.when(F.col("degree") < 2, 1)).alias("short_nets"))
    b = nodes.agg(F.count(F.when(F.exists("impls", lambda v: F.size(v) != 3), 1)).alias("uneven_vectors"), F.count(F.when((F.col("sel") < 0) | (F.col("sel") >= F.size("impls")), 1)).alias("bad_choices"))
    heavy = hypergraph.selected(nodes).join(F.broadcast(_arrays(spark, d))).agg(F.count(F.when(F.exists(F.zip_with("weight", "allowed", lambda w, m: w >= 2 * m), lambda x: x), 1)).alias("heavy_nodes"))
    return a.crossJoin(b).crossJoin(heavy)  # single rows


# -- partitioner -------------------------------------------------------------------


def _whole(spark, d):
    """All cells and all nets, written once."""
    return tables.settle(hypergraph.selected(D.nodes(spark, d))), tables.settle(D.pins(spark, d)), tables.settle(D.edges(spark, d).select("edge_id", "width", "entropy"))


def _spanning(pins, assign):
    """One row, cut: how many nets have pins in several parts."""
    by = pins.join(assign, "node_id").groupBy("edge_id").agg(F.min("part").alias("a"), F.max("part").alias("b"))
    return by.agg(F.count(F.when(F.col("a") != F.col("b"), 1)).alias("cut"))


def _lost(weights, parts):
    """One row, lost: nodes that lack or come twice."""
    once = parts.groupBy("node_id").agg(F.count("*").alias("n")).where("n = 1")
    return weights.join(once, "node_id", "left_anti").agg(F.count("*").alias("lost"))


def _by_resource(state, weights, share):
    """(res_id, total, bound, balance) of a bipartition (node_id, side)."""
    return bisect.balances(state.join(weights, "node_id").select("side", F.posexplode("weight").alias("res_id", "w")), [], share)


#: What a round of moves has to gain, as a share of the cut, in the queries over whole tables; and the passes of the kernel's first starts.
WORTH, PASSES = 0.01, 3


def _halves(spark, d):
    """(weights, pins, the whole graph in two)."""
    weights, pins, edges = _whole(spark, d)
    o = replace(multilevel.options_for(weights), max_passes=PASSES)
    return weights, pins, tables.settle(multilevel.bisection(weights, pins, edges, n_runs=2, o=o, worth=WORTH))


def partition_quality(spark: SparkSession, d: str) -> dict[str, int]:
    """The whole graph in two: nodes, nodes that lack or come twice, by how much resources are over their bounds, nets cut, and nets cut by the best of 32 hashed splits."""
    weights, pins, state = _halves(spark, d)
    over = bisect.violations(state, weights).agg(F.sum("over")).first()[0] or 0
    random = _run_costs(spark, d).agg(F.min("cost")).first()[0] or 0
    cut = _spanning(pins, state.select("node_id", F.col("side").alias("part"))).first().cut
    return {"nodes": state.count(), "lost": _lost(weights, state).first().lost, "over": int(over), "cut": cut, "random": int(random)}


@query
def fm_partition(spark, d):
    """The whole graph in two, by resource: what there is of it in both parts together, the bound on its imbalance, whether it is kept; nodes lost, and whether the cut beats 32 hashed splits."""
    weights, pins, state = _halves(spark, d)
    by = _by_resource(state, weights, (bisect.SHARE,)).select("res_id", "total", "bound", (F.abs("balance") <= F.col("bound")).alias("within"))
    cut = _spanning(pins, state.select("node_id", F.col("side").alias("part")))
    random = _run_costs(spark, d).agg(F.min("cost").alias("random"))
    nets = pins.agg(F.count_distinct("edge_id").alias("nets"))
    found = by.crossJoin(_lost(weights, state)).crossJoin(nets).crossJoin(cut).crossJoin(random)  # single rows
    return found.select("res_id", "total", "bound", "within", "lost", "nets", ((F.col("cut") < F.col("random")) | (F.col("cut") == 0)).alias("better"))


@query
def fm_cost_check(spark, d):
    """By run: whether the reported cost is the cut that the DataFrame metrics count over all nets; nodes, and nodes lost; what the clusters weigh together."""
    weights, pins, edges = _whole(spark, d)
    weights = weights.withColumn("group_id", F.lit(0).cast("long"))
    clusters, level = multilevel.coarsen(weights, pins, edges)
    runs = tables.settle(multilevel.coarse_runs(clusters, level, pins, edges, 2, replace(multilevel.options_for(weights), rebalance=True, max_passes=1)))
    found = clusters.join(runs.select("run_id", F.col("node_id").alias("super_id"), "part"), "super_id")
    cut = pins.join(found.select("run_id", "node_id", "part"), "node_id").groupBy("run_id", "edge_id").agg(F.min("part").alias("a"), F.max("part").alias("b"))
    cost = cut.groupBy("run_id").agg(F.count(F.when(F.col("a") != F.col("b"), 1)).cast("double").alias("counted"))
    by = found.groupBy("run_id").agg(F.count_distinct("node_id").alias("nodes")).join(runs.groupBy("run_id").agg(F.max("cost").alias("cost")), "run_id").join(cost, "run_id", "left")
    heavy = level.agg(*[F.sum(F.get("weight", F.lit(r))).alias(f"total_{r}") for r in range(3)])
    sound = F.abs(F.col("cost") - F.coalesce("counted", F.lit(0.0))) < 1e-6
    return by.crossJoin(heavy).select("run_id", "nodes", sound.alias("same_cost"), "total_0", "total_1", "total_2")  # a single row


@query
def fm_kway(spark, d):
    """Four parts of the whole graph, by resource: what there is of it in all parts, parts, nodes lost, and whether fewer nets span parts than with hashed parts."""
    weights, pins, edges = _whole(spark, d)
    o = replace(multilevel.options_for(weights), max_passes=1)
    parts = tables.settle(multilevel.kway(weights, pins, edges, levels=2, n_runs=1, rounds=1, o=o))
    hashed = weights.select("node_id", F.pmod(F.xxhash64("node_id"), F.lit(4)).alias("part"))
    by = parts.join(weights, "node_id").select("part", F.posexplode("weight").alias("res_id", "w")).groupBy("res_id").agg(F.sum("w").cast("long").alias("total"), F.count_distinct("part").alias("parts"))
    found = by.crossJoin(_lost(weights, parts)).crossJoin(_spanning(pins, parts)).crossJoin(_spanning(pins, hashed).withColumnRenamed("cut", "of_hashed"))  # single rows
    return found.select("res_id", "total", "parts", "lost", (F.col("cut") < F.col("of_hashed")).alias("better"))


def _parity(spark, d):
    return D.assign(spark, d).select("node_id", F.lit(0).cast("long").alias("group_id"), F.col("part").alias("side"))


@query
def fm_bisect_check(spark, d):
    """Rounds of batch moves from even and odd nodes: the cut before, whether it is less after, excess over the bounds before, whether there is more after, nodes lost."""
    weights, pins, edges = _whole(spark, d)
    start = tables.settle(_parity(spark, d))
    end = bisect.refine(start, weights, pins, edges, rounds=2)
    over = lambda x, name: _by_resource(x.drop("group_id"), weights, (bisect.SHARE,)).agg(F.sum(bisect.over(F.col("balance"), F.col("bound"))).alias(name))
    cut = lambda x, name: _spanning(pins, x.select("node_id", F.col("side").alias("part"))).withColumnRenamed("cut", name)
    start = tables.settle(_parity(spark, d))
    found = cut(start, "start_cut").crossJoin(cut(end, "end_cut")).crossJoin(over(start, "start_over")).crossJoin(over(end, "end_over")).crossJoin(_lost(weights, end))  # single rows
    better = (F.col("end_cut") < F.col("start_cut")) | (F.col("end_over") < F.col("start_over"))
    return found.select("start_cut", better.alias("better"), "start_over", (F.col("end_over") > F.col("start_over")).alias("more_over"), "lost")


@query
def hg_prefix_curve(spark, d):
    """The cut after each of a batch of moves from even and odd nodes: all that lose nothing, the best of both sides by turns."""
    rows = tables.settle(bisect.sided(_parity(spark, d), D.pins(spark, d), D.edges(spark, d)))
    moves = tables.settle(bisect.ordered(bisect.gains(rows).where("gain >= 0")))
    start = _spanning(D.pins(spark, d), D.assign(spark, d))
    found = bisect.curve(bisect.effects(rows, moves)).crossJoin(start)  # a single row
    return found.select("place", "node_id", (F.col("cut") + F.col("so_far")).cast("long").alias("cut"))


@query
def hg_move_effects(spark, d):
    """What each of these moves does to the cut at its turn."""
    rows = tables.settle(bisect.sided(_parity(spark, d), D.pins(spark, d), D.edges(spark, d)))
    return bisect.effects(rows, tables.settle(bisect.ordered(bisect.gains(rows).where("gain >= 0")))).select("node_id", "place", "change")


@query
def fm_from_solution(spark, d):
    """The even and odd nodes as solution files in both forms, read back, and improved: the cut that was read, whether the improved one is higher, nodes lost, choices that came back changed."""
    weights, pins, edges = _whole(spark, d)
    nodes = D.nodes(spark, d)
    written = tables.settle(ilp.solution(nodes, pins, edges, D.assign(spark, d)))
    forms = [text_formats.scip_lines(written, dense=False), text_formats.mst_lines(written)]
    read = [tables.settle(ilp.assignment(nodes, text_formats.solution_values(x.select("value")))) for x in forms]
    found = multilevel.runs(nodes, pins, edges, 1, replace(multilevel.options_for(weights), max_passes=1), given=read[0], rounds=1)
    changed = read[1].join(nodes.select("node_id", F.col("sel").alias("was")), "node_id").agg(F.count(F.when((F.col("sel") != F.col("was")) | (F.col("part") != F.col("node_id") % 2), 1)).alias("changed"))
    after = _spanning(pins, found.select("node_id", "part")).withColumnRenamed("cut", "after")
    all_ = _spanning(pins, read[0].select("node_id", "part")).crossJoin(after).crossJoin(_lost(weights, found)).crossJoin(changed)  # single rows
    over = lambda x: _by_resource(x, weights, (bisect.SHARE,)).agg(F.sum(bisect.over(F.col("balance"), F.col("bound"))).alias("over"))
    more = over(found.select("node_id", F.col("part").alias("side"))).withColumnRenamed("over", "over_after").crossJoin(over(read[0].select("node_id", F.col("part").alias("side"))))
    all_ = all_.crossJoin(more)
    worse = (F.col("over_after") > F.col("over")) | (F.col("over_after") == F.col("over")) & (F.col("after") > F.col("cut"))
    return all_.select("cut", "over", worse.alias("worse"), "lost", "changed")


@query
def hg_hierarchy(spark, d):
    """Supernodes of four, sixteen and sixty-four cells: the balance of the leaves that the highest ones hold, by resource."""
    nodes, parents = D.nodes(spark, d), _levels(spark, d)
    top = parents.where(F.col("super_id") < -2_000_000_000).select(F.col("super_id").alias("node_id")).distinct()
    return hypergraph.hierarchy_balance(hypergraph.selected(nodes), parents, top.select("node_id", (-F.col("node_id") % 2).cast("int").alias("part")))


def _levels(spark, d):
    """(node_id, super_id) over three levels; a supernode's number is below zero, and says its level."""
    k = D.table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    number = lambda level, size: -(F.floor(F.col("k") / size) + 1_000_000_000 * level + 1).cast("long")
    one = k.select(F.col("k").cast("long").alias("node_id"), number(0, 4).alias("super_id"))
    two, three = (k.select(number(i, 4 ** (i + 1)).alias("node_id"), number(i + 1, 4 ** (i + 2)).alias("super_id")).distinct() for i in (0, 1))
    return one.unionByName(two).unionByName(three)


@query
def hg_tops(spark, d):
    """Every cell and supernode with its highest ancestor and how far up that is."""
    return hypergraph.tops(_levels(spark, d))


@query
def graph_xml_read(spark, d):
    """Parts and orders written as a graph in XML, and read again: nets with their weight and pins."""
    nodes = D.nodes(spark, d).select("node_id", F.concat(F.lit("p"), F.col("node_id").cast("string")).alias("name"), F.get("impls", F.col("sel")).alias("weight"))
    pins = D.pins(spark, d).select(F.concat(F.lit("n"), F.col("edge_id").cast("string")).alias("edge"), "node_id")
    edges = D.edges(spark, d).select(F.concat(F.lit("n"), F.col("edge_id").cast("string")).alias("name"), (F.col("edge_id") % 9 + 1).alias("width"))
    place = f"{tables.shared_folder(spark).rstrip('/')}/graph-{uuid.uuid4().hex}"
    graph_xml.lines(nodes, pins, edges).write.text(place)
    back, of, nets = graph_xml.read(spark, place)
    weight = back.select("node_id", F.aggregate(F.get("impls", F.lit(0)), F.lit(0), lambda a, x: a + x).alias("w"))
    return of.join(weight, "node_id").join(nets, "edge_id").groupBy("name", "width").agg(F.count("*").alias("n_pins"), F.sum("w").alias("weight"))


# -- traces --------------------------------------------------------------------------


@query
def ts_dwell(spark, d):
    return dwell.dwell(D.held(spark, d))


def _sliced(spark, d):
    return dwell.sliced(D.held(spark, d), D.DAY)


@query
def ts_dwell_sliced(spark, d):
    return _sliced(spark, d)


@query
def ts_min_entropy(spark, d):
    return dwell.entropies(dwell.dwell(D.held(spark, d)), "signal", "bit")


@query
def ts_slice_totals(spark, d):
    return dwell.slice_totals(_sliced(spark, d))


@query
def ts_biased_p1(spark, d):
    return dwell.dwell(D.held(spark, d)).select("signal", F.round(probability.biased_p1(F.col("n0"), F.col("n1"), F.col("nx"), F.col("nz")), 9).alias("p1"))


@query
def ts_probabilities(spark, d):
    total = F.col("n0") + F.col("n1") + F.col("nx") + F.col("nz")
    return dwell.dwell(D.held(spark, d)).select("signal", *[F.round(probability.share(F.col(f"n{s}"), total), 9).alias(f"p{s}") for s in dwell.STATES])


def _gold(spark, d):
    return dwell.entropies(dwell.dwell(D.held(spark, d)), "signal")


def _other(spark, d):
    """Even signals under their escaped names' plain form, and a threshold of its own."""
    return dwell.entropies(dwell.dwell(D.held(spark, d, 150)), "signal").where(F.col("signal").try_cast("long") % 5 != 0)


@query
def ts_compare(spark, d):
    gold = _gold(spark, d).withColumn("signal", F.when(F.col("signal").try_cast("long") % 2 == 0, names.escape(F.col("signal"))).otherwise(F.col("signal")))
    return dwell.compare(gold, _other(spark, d))


@query
def ts_unmatched(spark, d):
    return dwell.unmatched(_gold(spark, d).where(F.col("signal").try_cast("long") % 3 != 0), _other(spark, d))


@query
def ts_whitelist(spark, d):
    listed = D.table(spark, d, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").cast("string").alias("signal"))
    return dwell.whitelisted(_gold(spark, d), listed)


@query
def ts_whitelist_missing(spark, d):
    listed = D.table(spark, d, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").cast("string").alias("signal"))
    return listed.join(_gold(spark, d), "signal", "left_anti")


@query
def ts_entropy_bins(spark, d):
    return dwell.entropy_bins(_gold(spark, d))


@query
def ts_stream_dwell(spark, d):
    return trace.stream_dwell(spark, d)


@query
def ts_stream_windows(spark, d):
    return trace.stream_windows(spark, d)


#: Dumps that the events are written to.
DUMPS = 8


def _dumps(spark, d):
    """The events as value change dumps, one for each remainder of the users; the place they are at.

    Changes are scalars, or vectors whose code stands on the next line; every fifth event is followed by a comment over two
    lines that looks like changes. Each dump is one file, written by a task of its own.
    """
    found = tables.settle(D.changes(spark, d).withColumn("dump", F.col("signal").cast("long") % DUMPS))
    var = found.select("dump", "signal").distinct().select("dump", F.lit(1).alias("part"), F.lit(0).cast("long").alias("t"), F.col("signal").cast("long").alias("seq"), F.concat(F.lit("$var wire 1 @"), "signal", F.lit(" "), "signal", F.lit(" $end")).alias("value"))
    frame = [(0, 0, 0, "$scope module top $end"), (0, 0, 1, "$scope module dut $end"), (2, 0, 0, "$upscope $end"), (2, 0, 1, "$upscope $end"), (2, 0, 2, "$enddefinitions $end")]
    head = spark.createDataFrame(frame, "part int, t long, seq long, value string").crossJoin(found.select("dump").distinct())  # five rows for each dump
    change = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("b"), "v", F.lit("\n@"), "signal")).otherwise(F.concat("v", F.lit("@"), "signal"))
    comment = F.when(F.col("seq") % 5 == 0, F.lit("\n$comment #9\n1@1 b0 $end")).otherwise("")
    body = found.select("dump", F.lit(3).alias("part"), "t", "seq", F.concat(F.lit("#"), F.col("t").cast("string"), F.lit("\n"), change, comment).alias("value"))
    place = f"{tables.shared_folder(spark).rstrip('/')}/dumps-{uuid.uuid4().hex}"
    every = head.unionByName(var).unionByName(body)
    every.repartition(DUMPS, "dump").sortWithinPartitions("dump", "part", "t", "seq").select("dump", "value").write.partitionBy("dump").text(place)
    return f"{place}/dump=*"


@query
def ts_vcd_dwell(spark, d):
    """The events written as value change dumps, read again in splits, and dwell times of what was read."""
    changes = vcd.read(spark, _dumps(spark, d))
    return dwell.dwell(dwell.intervals(changes.select("signal", "bit", "t", "seq", "v"), D.trace_end(spark, d)))


@query
def ts_vcd_commands(spark, d):
    """Every command of these dumps."""
    found = vcd.commands(spark, _dumps(spark, d))
    return found.select(F.regexp_extract("file", "dump=(\\d+)", 1).cast("long").alias("dump"), "seq", "kind", "t", "word", "value")


@query
def ts_vcd_extend(spark, d):
    """Values of fewer digits than their variable has, at full width, lowest bit first."""
    digits = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("x"), F.bin("p_size"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("Z"), F.bin("p_size"))).otherwise(F.bin("p_size"))
    return D.table(spark, d, "part").select("p_partkey", vcd.extended(digits, F.lit(8)).alias("bits"))


# -- formats ----------------------------------------------------------------------------


@query
def fmt_ntl_roundtrip(spark, d):
    """Suppliers are modules, their parts the wires: written as text blocks, read back."""
    wires = D.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("w")).distinct()
    lists = wires.groupBy("s").agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: F.struct(w.alias("name"), (F.length(w) / 4).alias("entropy"))).alias("wires"))
    modules = D.table(spark, d, "supplier").join(lists, F.col("s_suppkey") == F.col("s")).select(F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("instance"), F.concat(F.lit("LUT"), (F.col("s_nationkey") % 6).cast("string")).alias("type"), "wires")
    back = text_formats.ntl_modules(text_formats.ntl_blocks(modules, with_entropy=True), with_entropy=True)
    return back.select("instance", "type", F.size("wires").cast("long").alias("n_wires"), F.get("wires", F.lit(0))["name"].alias("first"), F.round(F.aggregate("wires", F.lit(0.0), lambda a, w: a + w["entropy"]), 6).alias("entropy"))


@query
def fmt_ntl_hypergraph(spark, d):
    """Nets of modules over and under a fanout limit, with the entropy of the first module that names them."""
    rows = D.table(spark, d, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_orderkey").alias("s")).distinct()
    lists = rows.groupBy("p").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: F.struct(F.concat(F.lit("n"), s.cast("string")).alias("name"), ((s % 10) / 10.0).alias("entropy"))).alias("wires"))
    modules = lists.select(F.concat(F.lit("u"), F.col("p").cast("string")).alias("instance"), F.lit("LUT2").alias("type"), "wires")
    library = text_formats.implementation_library(spark.createDataFrame([(0, "LUT2 1 0 0 0 1 0"), (1, "LUT2 9 9 9")], "line_no int, value string"))
    _, pins, edges = text_formats.netlist_hypergraph(modules, library, 4)
    return pins.groupBy("net").agg(F.count("*").alias("n_pins")).join(edges, "net").select("net", "n_pins", "degree", "entropy")


@query
def fmt_ntl_nodes(spark, d):
    """Parts as modules of a type for each brand, joined with a library of implementations: the nodes with their vectors."""
    modules = D.table(spark, d, "part").select(F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("instance"), F.col("p_brand").alias("type"), F.array(F.struct(F.lit("n").alias("name"), F.lit(1.0).alias("entropy"))).alias("wires"))
    brands = D.table(spark, d, "part").groupBy("p_brand").agg(F.min("p_size").cast("string").alias("s"))
    lines = brands.select(F.lit(1).alias("line_no"), F.concat_ws(" ", "p_brand", "s", F.lit("0 0 0"), "s", F.lit("7")).alias("value"))
    nodes, _, _ = text_formats.netlist_hypergraph(modules, text_formats.implementation_library(lines))
    return nodes.select("instance", "type", F.size("impls").alias("n_impls"), F.get("impls", F.lit(0))[0].alias("first"), F.get("impls", F.lit(1))[1].alias("second"))


@query
def fmt_impl_library(spark, d):
    lines = D.table(spark, d, "part").select(F.col("p_partkey").alias("line_no"), F.concat_ws(" ", F.replace("p_type", F.lit(" "), F.lit("_")), *[F.col("p_size").cast("string")] * 2, F.lit("0"), F.lit("1"), F.lit("2"), F.col("p_size").cast("string")).alias("value"))
    found = text_formats.implementation_library(lines)
    return found.select("type", F.size("impls").alias("n_impls"), F.get("impls", F.lit(0))[0].alias("first"), F.get("impls", F.lit(1))[2].alias("last"))


@query
def fmt_chaco_roundtrip(spark, d):
    """Parts and their suppliers as a graph of weighted edges: node lines written and read again.

    A graph has one numbering for all of its nodes: suppliers have numbers above all parts, and get their own ones back.
    """
    rows = D.table(spark, d, "lineitem")
    n = F.broadcast(rows.agg(F.max("l_partkey").alias("n")))  # a single row
    edges = rows.select("l_partkey", "l_suppkey").distinct().crossJoin(n).select((F.col("l_partkey") + 1).alias("u"), (F.col("l_suppkey") + F.col("n") + 2).alias("v")).withColumn("weight", (F.col("u") % 9 + 1).cast("int"))
    nodes = edges.select(F.col("u").alias("node_id")).unionByName(edges.select(F.col("v").alias("node_id"))).distinct().withColumn("weight", (F.col("node_id") % 5).cast("int"))
    back = text_formats.chaco_edges(text_formats.chaco_lines(nodes, edges, 11), 11)
    return back.crossJoin(n).select("u", (F.col("v") - F.col("n") - 2 + 1000001).alias("v"), "weight")


@query
def fmt_weight_file(spark, d):
    back = text_formats.weight_vectors(text_formats.weight_lines(D.nodes(spark, d)), 3)
    return back.select("node_id", F.size("impls").alias("n_impls"), F.aggregate(F.flatten("impls"), F.lit(0), lambda a, x: a + x).alias("weight_sum"))


@query
def fmt_entropy_counts(spark, d):
    return text_formats.counts(text_formats.count_lines(_sliced(spark, d).withColumn("slice", F.dense_rank().over(Window.partitionBy("signal", "bit").orderBy("slice")) - 1)))


@query
def fmt_shannon(spark, d):
    return text_formats.shannon_values(text_formats.shannon_lines(_gold(spark, d).withColumnRenamed("signal", "name")))


@query
def fmt_seed_p1(spark, d):
    counted = text_formats.counts(text_formats.count_lines(dwell.dwell(D.held(spark, d)).withColumn("slice", F.lit(0))))
    n = F.col("c_custkey").cast("string")
    wires = D.table(spark, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.concat(n, F.lit("[0]"))).otherwise(F.concat(F.lit("\\"), n, F.lit(" [0]"))).alias("wire"))
    return text_formats.p1_from_counts(counted, wires).select("wire", F.round("p1", 9).alias("p1"))


@query
def fmt_tokens(spark, d):
    return text_formats.tokens(D.table(spark, d, "part").select(F.col("p_type").alias("value"))).groupBy("token").agg(F.count("*").alias("n"))


@query
def fmt_bit_range_expand(spark, d):
    name = F.concat(F.lit("bus"), F.col("p_partkey").cast("string"), F.lit("["), (F.col("p_size") % 7 - 2).cast("string"), F.lit(":"), (F.col("p_size") % 3).cast("string"), F.lit("]"))
    return D.table(spark, d, "part").select("p_partkey", F.explode(names.expand_range(name)).alias("bit_name"))


@query
def fmt_split_name_clean(spark, d):
    name = names.split_name(F.concat(F.lit("net"), (F.col("p_partkey") % 50).cast("string"), F.lit("_split_3")), F.col("p_partkey"))
    return D.table(spark, d, "part").select(name.alias("name")).groupBy(names.clean_split(F.col("name")).alias("base")).agg(F.count("*").alias("n"), F.max("name").alias("last"))


@query
def fmt_escape(spark, d):
    n = F.concat(F.lit("s"), F.col("p_partkey").cast("string"))
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(n, F.lit("["), F.col("p_size").cast("string"), F.lit("]"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("\\"), n, F.lit(" "))).otherwise(n)
    return D.table(spark, d, "part").select("p_partkey", names.escape(raw).alias("escaped"))


@query
def fmt_immediate(spark, d):
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("16'h"), F.hex(k))).when(k % 3 == 1, F.concat(F.lit("32'b"), F.bin(k))).otherwise(F.concat(F.lit("20'd"), k.cast("string")))
    return D.table(spark, d, "part").select("p_partkey", names.immediate(text).cast("long").alias("value"))


@query
def fmt_mps_name(spark, d):
    return D.table(spark, d, "orders").select("o_orderkey", names.compressed(F.col("o_orderkey")).alias("name"))


@query
def fmt_net_blacklist(spark, d):
    return _named_nets(spark, d).where(~text_formats.is_ignored(F.col("net")))


def _named_nets(spark, d):
    """Customers as nets, some of them global, unconnected or literals."""
    k = F.col("c_custkey")
    special = ["CLK_IBUF_BUFG", "RST_IBUF", "\\<const0> ", "GND_2", "VCC", "CLK", "RST", "clk", "CLK_IBUF_BUFG[0]", "\\<const1> [0]", "GND", "1'b0", "\\<const1>", "VCC_2[0]", "CLK_IBUF"]
    net = F.when(k % 40 < len(special), F.get(F.array(*[F.lit(x) for x in special]), (k % 40).cast("int"))).when(k % 40 == 20, F.concat(F.lit("u/UNCONNECTED"), k.cast("string"))).otherwise(F.concat(F.lit("n"), k.cast("string")))
    return D.table(spark, d, "customer").select("c_custkey", net.alias("net"))


@query
def fmt_wire_blacklist(spark, d):
    return _named_nets(spark, d).where(~text_formats.is_ignored_wire(F.col("net")))


@query
def fmt_code_lengths(spark, d):
    return text_formats.code_lengths(D.changes(spark, d).select(F.col("v").alias("symbol")))


@query
def fmt_testbench(spark, d):
    nets = D.table(spark, d, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("\\n"), F.col("p_partkey").cast("string"), F.lit(" ")).alias("net"))
    return text_formats.strobe_lines(nets)


@query
def verilog_parse(spark, d):
    """Every part as an instantiation: text through the tokenizer, connections back."""
    k = F.col("p_partkey").cast("string")
    line = F.concat(F.lit("LUT2 #(.INIT(4'h8)) \\u"), k, F.lit(" (.O(n"), k, F.lit("), .I0({a["), (F.col("p_partkey") % 4).cast("string"), F.lit("], 1'b0}), .I1(bus[1:0]))"))
    # a part is few bytes and many tokens: the rows are dealt before they grow
    lines = D.table(spark, d, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey").select(line.alias("value"))
    found = verilog.instances(lines).groupBy("type", "port")
    return found.agg(F.count("*").alias("n"), F.count_distinct("instance").alias("instances"), F.count_distinct("net").alias("nets"))


@query
def verilog_lateral(spark, d):
    """The same statements through the table function, in SQL."""
    k = F.col("p_partkey").cast("string")
    line = F.concat(F.lit("LUT2 #(.INIT(4'h8)) \\u"), k, F.lit(" (.O(n"), k, F.lit("), .I0({a["), (F.col("p_partkey") % 4).cast("string"), F.lit("], 1'b0}), .I1(bus[1:0]))"))
    verilog.register(spark)
    lines = D.table(spark, d, "part").select("p_partkey", line.alias("value"))
    return spark.sql("SELECT p_partkey, p.type, p.port, p.pos, p.net FROM {lines}, LATERAL connections(value) p", lines=lines)


@query
def verilog_file(spark, d):
    """Parts as a Verilog file of statements with comments between and inside them, read in splits: nets with their bounds."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("/* ; */ wire ["), (F.col("p_size") % 5).cast("string"), F.lit(":0]\n  w"), k, F.lit(", // c;\n  v"), k, F.lit(" ; (* a;\n b *) input i"), k, F.lit(";"))
    place = f"{tables.shared_folder(spark).rstrip('/')}/verilog-{uuid.uuid4().hex}"
    D.table(spark, d, "part").select(text.alias("value")).write.text(place)
    found = verilog.nets(verilog.statements(spark, place))
    return found.select("kind", F.trim("name").alias("name"), "high", "low")


@query
def verilog_buses(spark, d):
    """Pins that name whole buses, as their bits."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("b"), k.cast("string"))
    pins = D.table(spark, d, "part").select(F.lit("T").alias("type"), k.cast("string").alias("instance"), F.lit("A").alias("port"), F.lit(0).alias("pos"), name.alias("net"))
    declared = D.table(spark, d, "part").where(k % 2 == 0).select(name.alias("name"), (F.col("p_size") % 4 + 1).alias("high"), F.lit(-1).alias("low"))
    return verilog.expand_buses(pins, declared).select("instance", "pos", "net")


@query
def fmt_bit_names(spark, d):
    return D.table(spark, d, "part").select("p_partkey", F.explode(names.bit_names(F.lit("b"), F.col("p_size") % 3, F.col("p_size") % 7 - 3)).alias("bit_name"))


@query
def fmt_without_parameters(spark, d):
    k = F.col("p_partkey").cast("string")
    line = F.concat(F.lit("LUT2 #(.INIT(4'h"), F.hex(F.col("p_partkey") % 16), F.lit("), .A(1)) u"), k, F.lit(" (.O(n"), k, F.lit("))"))
    return D.table(spark, d, "part").select("p_partkey", names.without_parameters(line).alias("line"))


@query
def fmt_mst(spark, d):
    """Solutions as a starting point for a solver, read again."""
    nodes, pins, edges = _ilp(spark, d)
    lines = text_formats.mst_lines(ilp.solution(nodes, pins, edges, D.assign(spark, d)))
    return text_formats.solution_values(lines.select("value")).groupBy(F.substring("name", 1, 1).alias("kind")).agg(F.count("*").alias("n"), F.sum("value").alias("ones"))


@query
def fmt_dumpvars(spark, d):
    return vcd.dumpvars(D.table(spark, d, "customer").select(F.concat(F.lit("top.u"), F.col("c_custkey").cast("string")).alias("signal")))


@query
def fmt_chaco_header(spark, d):
    """A graph file of the parts and their suppliers with its header, written and read again in splits, checked against it."""
    edges = D.table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    n = D.table(spark, d, "part").agg(F.max("p_partkey").alias("n"))
    pairs = edges.crossJoin(n).select((F.col("l_partkey") + 1).alias("u"), (F.col("l_suppkey") + F.col("n") + 2).alias("v"), (F.col("l_partkey") % 9 + 1).cast("int").alias("weight"))  # a single row
    most = pairs.agg(F.max("v").alias("most"), F.count("*").alias("m"))
    parts, block = int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << 16
    blocks = most.select("most", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("most") / block))).alias("b")).repartition(parts, "b")
    numbers = F.sequence(F.greatest(F.lit(1), F.col("b") * block), F.least("most", F.col("b") * block + (block - 1)))
    nodes = blocks.select(F.explode(numbers).alias("node_id")).withColumn("weight", (F.col("node_id") % 5).cast("int"))
    place = f"{tables.shared_folder(spark).rstrip('/')}/chaco-{uuid.uuid4().hex}"
    head = most.select(F.lit(0).cast("long").alias("node_id"), F.concat_ws(" ", F.col("most").cast("string"), F.col("m").cast("string"), F.lit("11")).alias("value"))
    # a graph is one text in the order of its nodes: each file goes on where the one before it ends
    head.unionByName(text_formats.chaco_lines(nodes, pairs, 11)).repartitionByRange(parts, "node_id").sortWithinPartitions("node_id").select("value").write.text(place)
    lines = text_formats.numbered_lines(spark, place, as_one=True)
    n, m, mode = text_formats.chaco_header(lines.where("line_no = 0").first().value)
    back = text_formats.chaco_edges(lines.where("line_no > 0").select(F.col("line_no").alias("node_id"), "value"), mode)
    return back.groupBy("weight").agg(F.count("*").alias("n"), F.sum("u").alias("u")).select("weight", "n", "u", F.lit(n).cast("long").alias("of_nodes"), F.lit(m).cast("long").alias("of_edges"))


# -- simulation ----------------------------------------------------------------------------


def _ps(k):
    return [(F.pmod(k * i, F.lit(101)) / 100.0) for i in (37, 53, 71)]


@query
def sim_lut_prob(spark, d):
    k = F.col("p_partkey")
    a, b, _ = _ps(k)
    return D.table(spark, d, "part").select("p_partkey", F.round(probability.lut(F.array(a, b), (k % 16).cast("long")), 9).alias("p1"))


@query
def sim_mux_prob(spark, d):
    s, a, b = _ps(F.col("p_partkey"))
    return D.table(spark, d, "part").select("p_partkey", F.round(probability.mux(s, a, b), 9).alias("p1"), F.round(probability.entropy(probability.mux(s, a, b)), 9).alias("h"))


@query
def sim_carry(spark, d):
    c, x, s = _ps(F.col("p_partkey"))
    out = probability.carry_chain(c, F.array(x, s), F.array(s, c))
    return D.table(spark, d, "part").select("p_partkey", out.alias("o")).select("p_partkey", *[F.round(F.get("o", F.lit(i))[n], 9).alias(f"{n}{i}") for i in (0, 1) for n in ("co", "o")])


@query
def sim_cells(spark, d):
    """Parts as cells of one input and one output of several types; what no model covers is unknown."""
    k = F.col("p_partkey")
    cells_ = [("GND", None, "G"), ("VCC", None, "P"), ("FDRE", "D", "Q"), ("DSP48E1", "A", "P"), ("IBUF", "I", "O"), ("FIFO18E1", "DI", "DO"), ("LUT1", "I0", "O"), ("RAM128X1S", "D", "O"), ("FIFO36E1", "DI", "EMPTY"), ("SRLC32E", "D", "Q31"), ("FIFO36E1", "DIP", "DOP")]
    pick = lambda i: F.get(F.array(*[F.lit(x[i]) for x in cells_]), (k % len(cells_)).cast("int"))
    base = D.table(spark, d, "part").select(k.cast("string").alias("instance"), pick(0).alias("type"), F.create_map(F.lit("INIT"), F.lit("2'h1")).alias("params"), (k % 3).cast("int").alias("bit"), pick(1).alias("i"), pick(2).alias("o"), _ps(k)[0].alias("p"))
    pos = F.when(F.col("type").startswith("FIFO"), F.col("bit")).otherwise(0).alias("pos")
    ends = [base.select("type", "instance", "params", F.col(c).alias("port"), pos, F.concat(F.lit(c), "instance").alias("net")) for c in ("i", "o")]
    pins = ends[0].where("port IS NOT NULL").unionByName(ends[1])
    seeds = base.select(F.concat(F.lit("i"), "instance").alias("wire"), F.col("p").alias("p1"))
    found = propagate.propagate(cells.gates(pins), seeds)
    return base.select(F.col("instance").cast("long").alias("p_partkey"), F.concat(F.lit("o"), "instance").alias("wire")).join(found, "wire", "left").select("p_partkey", F.round(F.coalesce("p1", F.lit(0.5)), 9).alias("p1"))


@query
def sim_bus_entropy(spark, d):
    return D.table(spark, d, "part").select("p_partkey", F.round(probability.bus_entropy(F.array(*_ps(F.col("p_partkey")))), 9).alias("h"))


@query
def sim_propagate(spark, d):
    gates = D.gates(spark, d)
    found = propagate.propagate(gates, spark.createDataFrame([("0", 0.5), ("1", 0.5)], "wire string, p1 double"))
    return found.select("wire", F.round("p1", 9).alias("p1"), F.round(probability.entropy(F.col("p1")), 9).alias("h"))


@query
def sim_cells_propagate(spark, d):
    """Parts as cells of seven types, each over wires of smaller parts, and with every tenth part a loop of two gates."""
    k = F.col("p_partkey")
    name = lambda x: F.concat(F.lit("w"), x.cast("long").cast("string"))
    a, b, c = name(F.floor((k - 1) / 2)), name(F.floor((k - 2) / 3)), name(F.floor((k - 3) / 4))
    part = D.table(spark, d, "part").where("p_partkey >= 3").select(k, a.alias("a"), b.alias("b"), c.alias("c"), name(k).alias("o"))

    def cell(rows, kind, init, **ports):
        """Pins of one cell a row: port with bit -> column of the net."""
        listed = [F.struct(F.lit(p).alias("port"), F.lit(0).alias("pos"), (F.col(n) if isinstance(n, str) else n).alias("net")) for p, n in ports.items()]
        return rows.select(F.lit(kind).alias("type"), F.concat(F.lit(f"{kind}_"), F.col("o")).alias("instance"), F.create_map(F.lit("INIT"), init).alias("params"), F.explode(F.array(*listed)).alias("x")).select("type", "instance", "params", "x.*")

    none, low = F.lit(""), F.lit("low")
    loops = part.where(k % 10 == 0)
    half = lambda end: F.concat(F.lit("l"), k.cast("string"), F.lit(end))
    pins = cell(part.where(k % 7 == 0), "LUT2", F.concat(F.lit("4'd"), (k % 16).cast("string")), I0="a", I1="b", O="o")
    for more in (
        cell(part.where(k % 7 == 1), "LUT1", F.lit("2'h1"), I0="a", O="o"), cell(part.where(k % 7 == 2), "MUXF7", none, I0="a", I1="b", S="c", O="o"), cell(part.where(k % 7 == 3), "FDRE", none, D="a", C=F.lit("CLK"), Q="o"),
        cell(part.where(k % 7 == 4), "CARRY4", none, CI="a", CYINIT=low, DI="b", S="c", O="o"), cell(part.where(k % 7 == 5), "GND", none, G="o"), cell(part.where(k % 7 == 6), "VCC", none, P="o"),
        cell(loops.withColumn("o", half("a")), "LUT2", F.lit("4'h8"), I0=half("b"), I1="a", O="o"), cell(loops.withColumn("o", half("b")), "LUT2", F.lit("4'hE"), I0=half("a"), I1="b", O="o"),
    ):
        pins = pins.unionByName(more)
    seeds = spark.createDataFrame([("low", 0.0), ("w0", 0.25), ("w1", 0.5), ("w2", 0.75)], "wire string, p1 double")
    found = propagate.propagate(cells.gates(pins), seeds)
    return found.where("wire <> 'low' AND wire <> 'CLK'").select("wire", F.round("p1", 9).alias("p1"))


@query
def sim_chains(spark, d):
    """A chain through all parts, each a look-up table of the one before and of a constant, some of them inverters or registers: as deep as the table is long."""
    k = F.col("p_partkey")
    name = lambda x: F.concat(F.lit("w"), x.cast("string"))
    kind = F.when(k % 3 == 0, "pass").otherwise("lut")
    init = F.when(k % 3 == 1, 1).otherwise(14).cast("long")  # an inverter, or an or with a wire of 0.25
    inputs = F.when(k % 3 == 2, F.array(name(k - 1), F.lit("side"))).otherwise(F.array(name(k - 1)))
    gates = D.table(spark, d, "part").select(name(k).alias("wire"), kind.alias("kind"), init.alias("init"), inputs.alias("inputs"))
    least = D.table(spark, d, "part").agg(F.min("p_partkey").alias("k"))
    seeds = least.select(name(F.col("k") - 1).alias("wire"), F.lit(0.5).alias("p1")).unionByName(spark.createDataFrame([("side", 0.25)], "wire string, p1 double"))
    found = propagate.propagate(gates, seeds).where("wire <> 'side'")
    return found.select("wire", F.round("p1", 6).alias("p1"), "level")


@query
def sim_seeded(spark, d):
    """Probabilities from dwell times as seeds of wires, with the constant wires; wires that nothing names are unknown."""
    counted = text_formats.counts(text_formats.count_lines(dwell.dwell(D.held(spark, d)).withColumn("slice", F.lit(0))))
    n = F.col("c_custkey").cast("string")
    gates = D.table(spark, d, "customer").select(F.concat(F.lit("o"), n).alias("wire"), F.lit(8).cast("long").alias("init"), F.array(F.concat(n, F.lit("[0]")), F.when(F.col("c_custkey") % 3 == 0, "\\<const0> ").otherwise("\\<const1> ")).alias("inputs"))
    wires = gates.select(F.explode("inputs").alias("wire")).distinct()
    seeds = text_formats.p1_from_counts(counted, wires).unionByName(spark.createDataFrame([("\\<const0> ", 0.0), ("\\<const1> ", 1.0)], "wire string, p1 double"))
    found = propagate.propagate(gates, seeds)
    return found.where("wire LIKE 'o%'").select("wire", F.round("p1", 9).alias("p1"))


# -- integer program -------------------------------------------------------------------------


def _ilp(spark, d):
    pins = D.pins(spark, d)
    return D.nodes(spark, d), pins, D.edges(spark, d).join(pins.select("edge_id").distinct(), "edge_id", "left_semi")


@query
def ilp_vars(spark, d):
    nodes, _, edges = _ilp(spark, d)
    return ilp.variables(nodes, edges)


@query
def ilp_rows(spark, d):
    nodes, _, edges = _ilp(spark, d)
    return ilp.rows(nodes, edges, 3)


@query
def ilp_coef(spark, d):
    nodes, pins, edges = _ilp(spark, d)
    return ilp.coefficients(nodes, pins, edges, 0.01)


@query
def ilp_size(spark, d):
    nodes, pins, _ = _ilp(spark, d)
    return ilp.size(nodes, pins)


@query
def ilp_solution(spark, d):
    nodes, pins, edges = _ilp(spark, d)
    return text_formats.scip_lines(ilp.solution(nodes, pins, edges, D.assign(spark, d))).select("value")


@query
def ilp_feasible(spark, d):
    """Rows of the program that the parity partition breaks, by kind; the balance rows may be broken, the others not."""
    nodes, pins, edges = _ilp(spark, d)
    values = ilp.solution(nodes, pins, edges, D.assign(spark, d)).select("name", "value")
    left = ilp.left_sides(nodes, pins, edges, 0.01, values)
    ok = F.when(F.col("sense") == ">=", F.col("lhs") >= F.col("rhs") - 1e-6).when(F.col("sense") == "<=", F.col("lhs") <= F.col("rhs") + 1e-6).otherwise(F.abs(F.col("lhs") - F.col("rhs")) < 1e-6)
    return ilp.rows(nodes, edges, 3).join(left, "name").groupBy(F.substring("name", 1, 1).alias("kind")).agg(F.count("*").alias("n"), F.count(F.when(~ok, 1)).alias("broken"))
