"""Command line: python -m netquarry.cli <command> ...; every command reads and writes through Spark."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netquarry.functions import cells, names, probability
from netquarry.operators import dwell, hypergraph, ilp, implementations, multilevel, propagate, tables
from netquarry.sources import config, graph_xml, text_formats, vcd, verilog


def read_chaco(spark: SparkSession, path: str, weights: str | None, resources: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, pins, edges) of a CHACO graph and, for modes 20 and 21, its weight file; counts are checked against the header."""
    lines = text_formats.numbered_lines(spark, path)
    n, m, mode = text_formats.chaco_header(lines.where("line_no = 0").first().value)
    body = lines.where("line_no > 0").select(F.col("line_no").cast("long").alias("node_id"), "value")
    edges = text_formats.chaco_edges(body, mode).withColumn("edge_id", F.xxhash64("u", "v"))
    if body.count() != n or edges.count() != m:
        raise ValueError(f"{path}: the header says {n} nodes and {m} edges")
    if mode in (20, 21):
        if not weights:
            raise ValueError("this mode has its node weights in a file of its own")
        listed = text_formats.numbered_lines(spark, weights).where("line_no > 0").select(F.col("line_no").cast("long").alias("node_id"), "value")
        nodes = text_formats.weight_vectors(listed, resources)
    else:
        own = F.get(F.split(F.trim("value"), "\\s+"), F.lit(0)).cast("int") if text_formats.MODES[mode][0] else F.lit(1)
        nodes = body.select("node_id", F.array(F.array(own)).alias("impls"))
    pins = edges.select("edge_id", F.explode(F.array("u", "v")).alias("node_id"))
    return nodes.withColumn("sel", F.lit(0)), pins, edges.select("edge_id", F.col("weight").cast("double").alias("width"), F.lit(1.0).alias("entropy"))


def read_ntl(spark: SparkSession, path: str, library: str, with_entropy: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    modules = text_formats.ntl_modules(spark.read.text(path, lineSep="module_end"), with_entropy)
    cells = text_formats.implementation_library(text_formats.numbered_lines(spark, library))
    nodes, pins, edges = text_formats.netlist_hypergraph(modules, cells)
    node, edge = F.xxhash64("instance").alias("node_id"), F.xxhash64("net").alias("edge_id")
    return nodes.select(node, F.col("instance").alias("name"), "impls", F.lit(0).alias("sel")), hypergraph.distinct_pins(pins.select(edge, node)), edges.select(edge, F.lit(1.0).alias("width"), "entropy", F.col("net").alias("name"))


def read_netlist(spark: SparkSession, a: argparse.Namespace, resources: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, pins, edges) of whichever file the arguments name."""
    if a.chaco:
        return read_chaco(spark, a.chaco, a.weights, resources)
    if a.graph:
        nodes, pins, edges = graph_xml.read(spark, a.graph)
        return nodes, hypergraph.distinct_pins(pins), edges
    return read_ntl(spark, a.ntl or a.xntl, a.library, bool(a.xntl))


def preprocess(nodes: DataFrame, c: config.Config) -> DataFrame:
    if c.preprocessor == "universal":
        return implementations.universal(nodes, c.universal_resource)
    if c.preprocessor is None:
        return nodes
    room = [r.capacity for r in implementations.flexible_capacity(nodes, c.capacity).orderBy("res_id").collect()] if c.flexible_capacity else c.capacity
    if c.preprocessor == "proportional":
        return implementations.proportional(nodes, room)
    return implementations.lowest_cost(nodes, room) if c.preprocessor == "lowest_cost" else implementations.random_choice(nodes, c.seed)


def partition(spark: SparkSession, a: argparse.Namespace) -> None:
    """Bipartitions of a netlist of any size, or 2 to a power parts of it; every option of the configuration counts at every size."""
    with open(a.config) as f:
        c = config.read_config(f.read())
    nodes, pins, edges = read_netlist(spark, a, len(c.capacity))
    edges = edges.withColumn("width", hypergraph.edge_weight(a.use_entropy))
    nodes, given = tables.settle(preprocess(nodes, c)), None
    if a.initial_sol:
        given = tables.settle(ilp.assignment(nodes, text_formats.solution_values(spark.read.text(a.initial_sol))))
        nodes = tables.settle(nodes.drop("sel").join(given.select("node_id", "sel"), "node_id"))
    if a.export_initial_sol:
        untouched = replace(c.options, max_passes=0, rebalance=False, rebalance_at_end=False, rebalance_on_demand=False, mutation_rate=0, adaptive=False)
        start = multilevel.runs(nodes, pins, edges, 1, untouched, given, rounds=0)
        write_solution(a, a.export_initial_sol, nodes, pins, edges, start.select("node_id", "part"))
        if a.initial_sol_only:
            return
    if a.nways > 2:
        kway(spark, a, c, nodes, pins, edges)
        return
    found = multilevel.runs(nodes, pins, edges, a.nruns, c.options, given)
    if a.write_cutset_dir:
        write_cut_sets(a.write_cutset_dir, found, pins, edges)
    best = found.groupBy("run_id").agg(F.max("cost").alias("cost")).orderBy("cost", "run_id").first()
    assign = found.where(F.col("run_id") == best.run_id).select("node_id", "part", "impl")
    chosen = nodes.drop("sel").join(assign.select("node_id", F.col("impl").alias("sel")), "node_id")
    hypergraph.run_statistics(found.groupBy("run_id").agg(F.max("cost").alias("cost")), "cost").show(truncate=False)
    hypergraph.cut_metrics(pins, assign.select("node_id", "part"), edges).show(truncate=False)
    hypergraph.resource_report(hypergraph.balance(hypergraph.selected(chosen), assign.select("node_id", "part")), dict(enumerate(c.ratio)), max(c.share)).show(truncate=False)
    found.groupBy("run_id").agg(F.max("cost").alias("cost")).orderBy("cost", "run_id").show(truncate=False)
    if a.output:
        assign.orderBy("part", "node_id").write.mode("overwrite").parquet(f"{a.output}/assign")
        solution = ilp.solution(chosen, pins, edges, assign.select("node_id", "part"))
        text_formats.scip_lines(solution, not a.sparse).select("value").write.mode("overwrite").text(f"{a.output}/sol")
        text_formats.mst_lines(solution).select("value").write.mode("overwrite").text(f"{a.output}/mst")
        write_cut(a.output, pins, edges, assign.select("node_id", "part"))


def write_cut(place: str, pins: DataFrame, edges: DataFrame, parts: DataFrame) -> None:
    """The names of the nets that span parts, and a testbench that watches them, where nets have names."""
    if "name" in edges.columns:
        spans = pins.join(parts, "node_id").groupBy("edge_id").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b")
        cut = spans.join(edges, "edge_id")
        text_formats.cut_set_lines(cut).write.mode("overwrite").text(f"{place}/cutset")
        text_formats.testbench(cut.select(F.col("name").alias("net"))).orderBy("place", "value").select("value").write.mode("overwrite").text(f"{place}/testbench")


def run_costs(found: DataFrame, pins: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, cost, span, entropy) of the nets that the runs (run_id, node_id, part) cut."""
    by = pins.join(found.select("run_id", "node_id", "part"), "node_id").groupBy("run_id", "edge_id").agg(F.min("part").alias("a"), F.max("part").alias("b")).join(edges, "edge_id")
    cut = lambda c: F.coalesce(F.sum(F.when(F.col("a") != F.col("b"), c)), F.lit(0.0))
    return by.groupBy("run_id").agg(cut(F.col("width")).alias("cost"), cut(F.lit(1.0)).cast("long").alias("span"), F.round(cut(F.col("entropy")), 6).alias("entropy"))


def write_cut_sets(place: str, found: DataFrame, pins: DataFrame, edges: DataFrame) -> None:
    """A folder of net names for each run, and summary.csv with a line a run."""
    runs = tables.settle(run_costs(found, pins, edges))
    text_formats.summary_lines(runs).coalesce(1).orderBy("run_id").select("value").write.mode("overwrite").text(f"{place}/summary.csv")
    named = edges if "name" in edges.columns else edges.withColumn("name", F.col("edge_id").cast("string"))
    by = pins.join(found.select("run_id", "node_id", "part"), "node_id").groupBy("run_id", "edge_id").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b")
    label = F.concat_ws("_", *[F.col(c).cast("string") for c in ("cost", "run_id", "span", "entropy")], F.lit("cutset"))
    cut = by.join(named.select("edge_id", "name"), "edge_id").join(runs.select("run_id", label.alias("run")), "run_id").select("run", names.clean_split(F.col("name")).alias("value")).distinct()
    cut.write.mode("overwrite").partitionBy("run").text(f"{place}/cutsets")


def write_solution(a: argparse.Namespace, place: str, nodes: DataFrame, pins: DataFrame, edges: DataFrame, assign: DataFrame) -> None:
    solution = tables.settle(ilp.solution(nodes, pins, edges, assign))
    if a.sol_gurobi_format:
        text_formats.mst_lines(solution).select("value").write.mode("overwrite").text(f"{place}/mst")
    if a.sol_scip_format or not a.sol_gurobi_format:
        text_formats.scip_lines(solution).select("value").write.mode("overwrite").text(f"{place}/sol")


def kway(spark: SparkSession, a: argparse.Namespace, c: config.Config, nodes: DataFrame, pins: DataFrame, edges: DataFrame) -> None:
    """Parts by repeated bisection with all of the configuration's options; the number of parts is a power of two."""
    levels = a.nways.bit_length() - 1
    if a.nways != 1 << levels:
        raise ValueError("the number of ways is a power of two")
    found = tables.settle(multilevel.ways(nodes, pins, edges, levels, a.nruns, c.options))
    costs = run_costs(found, pins, edges)
    costs.orderBy("cost", "run_id").show()
    if a.write_cutset_dir:
        write_cut_sets(a.write_cutset_dir, found, pins, edges)
    best = costs.orderBy("cost", "run_id").first().run_id
    parts = found.where(F.col("run_id") == best).select("node_id", "part", "impl")
    weights = nodes.join(parts, "node_id").select("part", F.posexplode(F.get("impls", F.col("impl"))).alias("res_id", "w"))
    weights.groupBy("part", "res_id").agg(F.sum("w").alias("weight")).orderBy("part", "res_id").show()
    if a.output:
        parts.orderBy("part", "node_id").write.mode("overwrite").parquet(f"{a.output}/assign")
        write_cut(a.output, pins, edges, parts)


def trace(spark: SparkSession, path: str, width: int | None, max_mb: int | None) -> DataFrame:
    changes = tables.settle(vcd.read(spark, path, max_mb << 20 if max_mb else None))
    end = changes.agg(F.max("t")).first()[0] or 0
    held = dwell.intervals(changes, end)
    return dwell.sliced(held, width) if width else dwell.dwell(held).withColumn("slice", F.lit(0))


def vcd_command(spark: SparkSession, a: argparse.Namespace) -> None:
    text_formats.count_lines(trace(spark, a.vcd, a.width, a.max_mb)).select("value").write.mode("overwrite").text(a.entropy)
    if a.huffman:
        changes = vcd.read(spark, a.vcd, a.max_mb << 20 if a.max_mb else None)
        # a frame is the values of a signal's bits at a time, cut into symbols
        frames = changes.groupBy("signal", "t", "seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bit", "v"))), lambda x: x["v"]), "").alias("frame"))
        cut = F.explode(F.regexp_extract_all("frame", F.lit(f"(.{{1,{a.symbol_size}}})"), F.lit(1))).alias("symbol")
        counts = {r.symbol: r.n for r in frames.select(cut).groupBy("symbol").agg(F.count("*").alias("n")).collect()}  # four to the symbol's size at most
        bits = text_formats.huffman_bits(counts)
        total = sum(counts.values())
        print(f"{total} symbols, {sum(bits[s] * n for s, n in counts.items()) / max(1, total):.4f} bits a symbol")


def whitelist(spark: SparkSession, path: str | None) -> DataFrame | None:
    return spark.read.text(path).select(F.col("value").alias("signal")) if path else None


def track(spark: SparkSession, a: argparse.Namespace) -> None:
    """One line a signal with its entropy in each slice, then totals and means."""
    counts = dwell.whitelisted(text_formats.counts(spark.read.text(a.entropy)).withColumnRenamed("name", "signal"), whitelist(spark, a.whitelist))
    h = dwell.entropies(counts, "signal", "slice")
    lines = h.groupBy("signal").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slice", "h"))), lambda x: x["h"].cast("string")), ",").alias("v"))
    lines.select(F.concat_ws(",", "signal", "v").alias("value")).write.mode("overwrite").text(a.output)
    dwell.slice_totals(counts).orderBy("slice").show(truncate=False)


def compare(spark: SparkSession, a: argparse.Namespace) -> None:
    gold, other = (text_formats.shannon_values(spark.read.text(p)).where("slice = 0").select(F.col("name").alias("signal"), "h") for p in (a.gold, a.compare))
    other = dwell.whitelisted(other, whitelist(spark, a.whitelist))
    dwell.compare(gold, other).write.mode("overwrite").option("header", True).csv(a.output)
    dwell.unmatched(gold, other).show()


def compare_vcd(spark: SparkSession, a: argparse.Namespace) -> None:
    slices = [F.lit("@"), F.col("slice").cast("string")] if a.width else []  # each slice is compared with its own
    one, two = (dwell.entropies(trace(spark, p, a.width, None), "signal", "bit", "slice").select(F.concat("signal", F.lit("["), F.col("bit").cast("string"), F.lit("]"), *slices).alias("signal"), "h") for p in (a.gold, a.compare))
    dwell.compare(one, two).write.mode("overwrite").option("header", True).csv(a.output)
    dwell.unmatched(one, two).show()


def functional(spark: SparkSession, a: argparse.Namespace) -> None:
    """Probabilities and entropies of a netlist, optionally seeded from counts; writes Shannon values and XNTL."""
    rows = tables.settle(verilog.statements(spark, a.verilog))
    pins = tables.settle(verilog.expand_buses(verilog.parsed(verilog.instances(rows.where(verilog.statement_kind(F.col("value")) == "instance"))), verilog.nets(rows)))
    gates = cells.gates(pins)
    seeds = spark.createDataFrame([("\\<const0> ", 0.0), ("\\<const1> ", 1.0), ("1'b0", 0.0), ("1'b1", 1.0)], "wire string, p1 double")
    if a.entropy:
        seeds = seeds.unionByName(text_formats.p1_from_counts(text_formats.counts(spark.read.text(a.entropy)), pins.select(F.col("net").alias("wire")).distinct()))
    found = propagate.propagate(gates, seeds)
    h = found.select("wire", F.col("wire").alias("name"), F.round(probability.entropy(F.col("p1")), 9).alias("h"))
    text_formats.shannon_lines(h).select("value").write.mode("overwrite").text(f"{a.output}/shannon")
    wires = pins.where("net IS NOT NULL").where(~text_formats.is_ignored_wire(F.col("net"))).join(h, F.col("net") == F.col("wire"), "left")
    modules = wires.groupBy("instance", "type").agg(F.array_sort(F.collect_set(F.struct(F.col("net").alias("name"), F.coalesce("h", F.lit(1.0)).alias("entropy")))).alias("wires"))
    text_formats.ntl_blocks(modules, with_entropy=True).select("value").write.mode("overwrite").text(f"{a.output}/xntl")


def structural(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = verilog.statements(spark, a.verilog)
    pins = verilog.parsed(verilog.instances(rows.where(verilog.statement_kind(F.col("value")) == "instance"))).where("net IS NOT NULL").where(~text_formats.is_ignored(F.col("net")))
    modules = pins.groupBy("instance", "type").agg(F.transform(F.array_sort(F.collect_set("net")), lambda n: F.struct(n.alias("name"), F.lit(1.0).alias("entropy"))).alias("wires"))
    text_formats.ntl_blocks(modules).select("value").write.mode("overwrite").text(a.output)


def model(spark: SparkSession, a: argparse.Namespace) -> None:
    """The integer program of a netlist, or one read from MPS, written as MPS or LP."""
    if a.mps:
        parts = text_formats.mps_model(tables.settle(text_formats.read_mps(spark, a.mps)))
    else:
        nodes, pins, edges = read_netlist(spark, a, a.resources)
        edges = edges.withColumn("width", hypergraph.edge_weight(a.use_entropy))
        parts = ilp.coefficients(nodes, pins, edges, a.max_imbalance), ilp.variables(nodes, edges), ilp.rows(nodes, edges, a.resources)
    if a.write_lp:
        text_formats.lp_lines(*parts).orderBy("section", "row", "place", "value").select("value").write.mode("overwrite").text(a.write_lp)
    if a.output:
        text_formats.mps_file(text_formats.mps_lines(*parts)).orderBy("section", "place", "value").select("value").write.mode("overwrite").text(a.output)


def weights(spark: SparkSession, a: argparse.Namespace) -> None:
    """Logic, multiplier and memory cells in shares of 84, 9 and 7 percent, each with its range of weights."""
    nodes = spark.range(1, a.nodes + 1).select(F.col("id").alias("node_id"))
    made = config.synthetic_weights(nodes, [(0.84, 5, 15), (0.09, 170, 370), (0.07, 230, 630)], a.seed, a.binomial, a.cluster)
    text_formats.weight_lines(made).orderBy("node_id").select("value").write.mode("overwrite").text(a.output)


def words(spark: SparkSession, a: argparse.Namespace) -> None:
    text_formats.tokens(spark.read.text(a.input)).write.mode("overwrite").text(a.output)


def shannon_csv(spark: SparkSession, a: argparse.Namespace) -> None:
    found = text_formats.shannon_values(spark.read.text(a.shannon))
    found.withColumn("slice", F.row_number().over(Window.partitionBy("name").orderBy("slice")) - 1).write.mode("overwrite").option("header", True).csv(a.output)


COMMANDS = {
    "partition": (partition, ["--chaco", "--weights", "--graph", "--ntl", "--xntl", "--library", "--config!", "--nruns:int=1", "--nways:int=2", "--use-entropy?", "--export-initial-sol", "--initial-sol-only?", "--initial-sol", "--sparse?", "--sol-scip-format?", "--sol-gurobi-format?", "--write-cutset-dir", "--output"]),
    "vcd": (vcd_command, ["--vcd!", "--entropy!", "--width:int", "--max-mb:int", "--huffman?", "--symbol-size:int=8"]),
    "track": (track, ["--entropy!", "--whitelist", "--output!"]),
    "compare-entropy": (compare, ["--gold!", "--compare!", "--whitelist", "--output!"]),
    "compare-vcd": (compare_vcd, ["--gold!", "--compare!", "--width:int", "--output!"]),
    "functional": (functional, ["--verilog!", "--entropy", "--output!"]),
    "structural": (structural, ["--verilog!", "--output!"]),
    "ilp": (model, ["--chaco", "--weights", "--graph", "--ntl", "--xntl", "--mps", "--library", "--resources:int=1", "--max-imbalance:float=0.01", "--use-entropy?", "--write-lp", "--output"]),
    "weights": (weights, ["--nodes:int=45087", "--seed:int=1", "--binomial?", "--cluster:int=1", "--output!"]),
    "tokens": (words, ["--input!", "--output!"]),
    "shannon-csv": (shannon_csv, ["--shannon!", "--output!"]),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="netquarry", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name, (run, options) in COMMANDS.items():
        p = sub.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        for o in options:
            flag, _, default = o.partition("=")
            flag, _, kind = flag.partition(":")
            if flag.endswith("?"):
                p.add_argument(flag[:-1], action="store_true")
            else:
                kind = {"int": int, "float": float}.get(kind, str)
                p.add_argument(flag.rstrip("!"), required=flag.endswith("!"), type=kind, default=kind(default) if default else None)
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    COMMANDS[a.command][0](spark or SparkSession.builder.appName("netquarry").getOrCreate(), a)


if __name__ == "__main__":
    main()
