"""Line formats of graphs and netlists: readers and writers as DataFrame expressions.

Readers take a DataFrame of (file, line_no, value) from `numbered_lines`, writers return lines or blocks to write as text.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netquarry.functions import names, probability
from netquarry.sources.splits import numbered_lines


def tokens(lines: DataFrame) -> DataFrame:
    """(token): one row for each run of characters other than white space."""
    return lines.select(F.explode(F.split(F.trim("value"), "\\s+")).alias("token")).where("token <> ''")


# -- CHACO ---------------------------------------------------------------------

#: Mode -> (node weights on the line, edge weights on the line); 20 and 21 have node weights in a file of their own (fixed values).
MODES = {0: (False, False), 1: (False, True), 10: (True, False), 11: (True, True), 20: (False, False), 21: (False, True)}


def chaco_header(line: str) -> tuple[int, int, int]:
    parts = [int(x) for x in line.split()]
    if len(parts) not in (2, 3) or (parts[2] if len(parts) == 3 else 0) not in MODES:
        raise ValueError(f"no header of a CHACO graph: {line!r}")
    return parts[0], parts[1], parts[2] if len(parts) == 3 else 0


def chaco_edges(lines: DataFrame, mode: int) -> DataFrame:
    """(u, v, weight), u < v, of the node lines (node_id, value) of a CHACO graph; each edge stands on both its lines."""
    has_node, has_edge = MODES[mode]
    numbers = F.transform(F.filter(F.split(F.trim("value"), "\\s+"), lambda x: x != ""), lambda x: x.cast("long"))
    rest = F.slice(numbers, 2, F.greatest(F.size(numbers) - 1, F.lit(0))) if has_node else numbers
    step = 2 if has_edge else 1
    listed = lines.select(F.col("node_id").alias("u"), rest.alias("r")).where(F.size("r") > 0)
    places = F.sequence(F.lit(0), F.floor(F.size("r") / step).cast("int") - 1)
    one = listed.select("u", F.explode(F.transform(places, lambda i: F.struct(F.get("r", i * step).alias("v"), (F.get("r", i * step + 1) if has_edge else F.lit(1)).alias("weight")))).alias("e"))
    return one.select(F.col("u").cast("long").alias("u"), F.col("e.v").cast("long").alias("v"), F.col("e.weight").cast("int").alias("weight")).where("u < v").dropDuplicates(["u", "v"])


def chaco_lines(nodes: DataFrame, edges: DataFrame, mode: int = 0) -> DataFrame:
    """(node_id, value): the node lines, in the mode's form, of nodes(node_id, weight) and edges(u, v, weight)."""
    has_node, has_edge = MODES[mode]
    both = edges.select("u", "v", "weight").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))
    entry = F.concat_ws(" ", F.col("v").cast("string"), *[F.col("weight").cast("string")] * has_edge)
    by = both.groupBy(F.col("u").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("v", entry.alias("e")))), lambda x: x["e"]), " ").alias("list"))
    return nodes.join(by, "node_id", "left").select("node_id", F.concat_ws(" ", *[F.col("weight").cast("string")] * has_node, F.coalesce("list", F.lit(""))).alias("value"))


def weight_vectors(lines: DataFrame, resources: int) -> DataFrame:
    """(node_id, impls): lines (node_id, value) of a weight file hold one or more vectors of so many resources."""
    numbers = F.transform(F.split(F.trim("value"), "\\s+"), lambda x: x.cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.size("n") / resources).cast("int") - 1), lambda i: F.slice("n", i * resources + 1, F.lit(resources)))
    return lines.select("node_id", numbers.alias("n")).where(F.size("n") >= resources).select("node_id", cut.alias("impls"))


def weight_lines(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", F.array_join(F.transform(F.flatten("impls"), lambda x: x.cast("string")), " ").alias("value"))


# -- NTL -----------------------------------------------------------------------


def ntl_blocks(modules: DataFrame, with_entropy: bool = False) -> DataFrame:
    """(instance, value): a text block for each of modules(instance, type, wires array<struct<name, entropy>>)."""
    wires = F.transform("wires", lambda w: F.concat_ws("\n", w["name"], w["entropy"].cast("string")) if with_entropy else w["name"])
    return modules.select("instance", F.concat_ws("\n", F.lit("module_begin"), "type", "instance", F.array_join(wires, "\n"), F.lit("module_end")).alias("value"))


def ntl_modules(blocks: DataFrame, with_entropy: bool = False) -> DataFrame:
    """modules of text blocks (value), as `spark.read.text(lineSep="module_end")` gives them; blank lines don't count."""
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.regexp_replace(x, "[\\r\\n]", "")), lambda x: ~F.trim(x).isin("", "module_begin", "module_end"))
    rows = blocks.select(lines.alias("l")).where(F.size("l") >= 2)
    rest = F.slice("l", 3, F.greatest(F.size("l") - 2, F.lit(0)))
    if with_entropy:
        pairs = F.filter(F.transform("rest", lambda x, i: F.struct(x.alias("name"), F.get("rest", i + 1).try_cast("double").alias("entropy"), (i % 2).alias("odd"))), lambda x: x["odd"] == 0)
        wires = F.transform(pairs, lambda x: F.struct(x["name"].alias("name"), x["entropy"].alias("entropy")))
    else:
        wires = F.transform("rest", lambda x: F.struct(x.alias("name"), F.lit(1.0).alias("entropy")))
    return rows.select(F.get("l", F.lit(1)).alias("instance"), F.get("l", F.lit(0)).alias("type"), rest.alias("rest")).select("instance", "type", wires.alias("wires"))


def implementation_library(lines: DataFrame, resources: int = 3) -> DataFrame:
    """(type, impls) of lines (line_no, value) "TYPE a b c [a b c ...]"; of a type's lines the first counts."""
    parts = F.split(F.trim("value"), "\\s+")
    rows = lines.where(F.trim("value") != "").select("line_no", F.get(parts, F.lit(0)).alias("type"), F.array_join(F.slice(parts, 2, F.size(parts)), " ").alias("value"))
    first = rows.groupBy("type").agg(F.min_by("value", "line_no").alias("value"))
    return weight_vectors(first.withColumnRenamed("type", "node_id"), resources).withColumnRenamed("node_id", "type")


def netlist_hypergraph(modules: DataFrame, library: DataFrame, max_fanout: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, pins, edges) of modules: pins without repeats, nets over the fanout limit left out; a net's entropy is its first one.

    Types that the library lacks are an error, raised when the nodes are computed. The library is a file of cell types.
    """
    joined = modules.join(library, "type", "left")
    nodes = joined.select("instance", "type", F.when(F.col("impls").isNull(), F.raise_error(F.concat(F.lit("no implementation of "), F.col("type")))).otherwise(F.col("impls")).alias("impls"))
    wires = modules.select("instance", F.posexplode("wires").alias("pos", "w")).select("instance", "pos", F.col("w.name").alias("net"), F.col("w.entropy").alias("entropy"))
    edges = wires.groupBy("net").agg(F.count_distinct("instance").alias("degree"), F.min_by("entropy", F.struct("instance", "pos")).alias("entropy")).where(F.col("degree") <= max_fanout)
    pins = wires.select("instance", "net").distinct().join(edges.select("net"), "net", "left_semi")
    return nodes, pins, edges


# -- entropy files ---------------------------------------------------------------


def count_lines(slices: DataFrame) -> DataFrame:
    """(name, value): "name[bit] n0 n1 nx nz ..." with four counts for each slice, in order."""
    four = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("n0", "n1", "nx", "nz")])
    by = slices.groupBy("signal", "bit").agg(F.array_sort(F.collect_list(F.struct("slice", four.alias("c")))).alias("rows"))
    name = F.concat("signal", F.lit("["), F.col("bit").cast("string"), F.lit("]"))
    return by.select(name.alias("name"), F.concat_ws(" ", name, F.array_join(F.transform("rows", lambda r: r["c"]), " ")).alias("value"))


def counts(lines: DataFrame) -> DataFrame:
    """(name, slice, n0, n1, nx, nz) of such lines; names may be escaped and hold a space before their range."""
    name, numbers = F.regexp_extract("value", r"^(\\\S+ (?:\[[^\]]*\])?|\S+)\s", 1), F.regexp_extract("value", r"((?:\s+\d+)+)\s*$", 1)
    rows = lines.select(F.trim(name).alias("name"), F.split(F.trim(numbers), "\\s+").alias("n")).where(F.size("n") >= 4)
    at = F.explode(F.sequence(F.lit(0), F.floor(F.size("n") / 4).cast("int") - 1)).alias("slice")
    return rows.select("name", "n", at).select("name", "slice", *[F.get("n", F.col("slice") * 4 + i).cast("long").alias(c) for i, c in enumerate(("n0", "n1", "nx", "nz"))])


def shannon_lines(values: DataFrame) -> DataFrame:
    return values.select("name", F.concat_ws(" ", "name", F.col("h").cast("string")).alias("value"))


def shannon_values(lines: DataFrame) -> DataFrame:
    """(name, slice, h) of lines "name value ..."; exponents are plain casts."""
    name, numbers = F.regexp_extract("value", r"^(\\\S+ (?:\[[^\]]*\])?|\S+)\s", 1), F.regexp_extract("value", r"((?:\s+[-+0-9.eE]+)+)\s*$", 1)
    return lines.select(F.trim(name).alias("name"), F.posexplode(F.transform(F.split(F.trim(numbers), "\\s+"), lambda x: x.cast("double"))).alias("slice", "h"))


def p1_from_counts(found: DataFrame, wires: DataFrame) -> DataFrame:
    """(wire, p1) for the wires that the counts name, directly or escaped."""
    p1 = found.select("name", probability.biased_p1(F.col("n0"), F.col("n1"), F.col("nx"), F.col("nz")).alias("p1"))
    direct = wires.select("wire").join(p1, F.col("wire") == F.col("name"), "left").withColumnRenamed("p1", "d").drop("name")
    other = p1.select(names.escape(F.col("name")).alias("name"), F.col("p1").alias("e"))
    return direct.join(other, F.col("wire") == F.col("name"), "left").select("wire", F.coalesce("d", "e").alias("p1")).where("p1 IS NOT NULL")


# -- solutions and reports -------------------------------------------------------


def scip_lines(solution: DataFrame, dense: bool = True) -> DataFrame:
    """(name, value) lines of a SCIP solution; the sparse form has only variables that are not 0."""
    rows = solution if dense else solution.where("value <> 0")
    return rows.select("name", F.concat("name", F.lit(" "), F.col("value").cast("string"), F.lit("\t (obj:"), F.when(F.col("obj") == F.floor("obj"), F.floor("obj").cast("string")).otherwise(F.col("obj").cast("string")), F.lit(")")).alias("value"))


def mst_lines(solution: DataFrame) -> DataFrame:
    return solution.select("name", F.concat_ws(" ", "name", F.col("value").cast("string")).alias("value"))


def solution_values(lines: DataFrame) -> DataFrame:
    """(name, value) of the lines of a solution, in either form; comments and headings, which have no number behind a name, are passed over."""
    part = lambda i: F.regexp_extract("value", r"^\s*([^#\s]\S*)\s+([-+0-9.eE]+)(?:\s.*)?$", i)
    return lines.select(part(1).alias("name"), part(2).try_cast("double").alias("value")).where("name <> '' AND value IS NOT NULL")


def mps_lines(coefficients: DataFrame, variables: DataFrame, rows: DataFrame) -> DataFrame:
    """(section, value) lines of a free MPS file, to be written in order of section, then value."""
    sense = F.when(F.col("sense") == ">=", "G").when(F.col("sense") == "<=", "L").otherwise("E")
    line = lambda n, *c: F.concat_ws(" ", F.lit(""), *c).alias("value")
    objective = variables.sparkSession.createDataFrame([(1, " N OBJFN")], "section int, value string")
    out = objective.unionByName(rows.select(F.lit(1).alias("section"), line(1, sense, F.col("name"))))
    cells = coefficients.select(F.col("variable"), F.col("row"), F.col("val")).unionByName(variables.where("obj <> 0").select(F.col("name").alias("variable"), F.lit("OBJFN").alias("row"), F.col("obj").alias("val")))
    out = out.unionByName(cells.select(F.lit(2).alias("section"), line(2, F.col("variable"), F.col("row"), F.col("val").cast("string"))))
    out = out.unionByName(rows.where("rhs <> 0").select(F.lit(3).alias("section"), line(3, F.lit("RHS"), F.col("name"), F.col("rhs").cast("string"))))
    return out.unionByName(variables.select(F.lit(4).alias("section"), line(4, F.lit("BV BND"), F.col("name"))))


#: Keywords of an MPS file's sections, in order (fixed values).
MPS_SECTIONS = ("NAME", "ROWS", "COLUMNS", "RHS", "BOUNDS", "ENDATA")


def mps_file(lines: DataFrame, name: str = "PARTITION") -> DataFrame:
    """(section, place, value): mps_lines() with the keywords, to be written in order of section, place and value."""
    heads = [(i, 0, f"{k} {name}" if not i else k) for i, k in enumerate(MPS_SECTIONS)]
    return lines.sparkSession.createDataFrame(heads, "section int, place int, value string").unionByName(lines.select("section", F.lit(1).alias("place"), "value"))


def read_mps(spark: SparkSession, path: str) -> DataFrame:
    """(section, value) lines of MPS files: of ROWS, COLUMNS, RHS and BOUNDS. Files of any size are read in splits; a section's lines are those after its keyword."""
    word = F.get(F.split("value", "\\s+"), F.lit(0))
    rows = numbered_lines(spark, path).where(~F.col("value").startswith("*") & (F.trim("value") != ""))
    heads = rows.where(F.col("value").rlike("^\\S") & word.isin(*MPS_SECTIONS))
    # a row for each file, with the line of each keyword
    at = heads.groupBy(F.col("file").alias("of")).agg(*[F.min(F.when(word == k, F.col("line_no"))).alias(f"at_{i}") for i, k in enumerate(MPS_SECTIONS)])
    section = F.lit(0)
    for i in range(1, len(MPS_SECTIONS)):
        section = F.when(F.col("line_no") > F.col(f"at_{i}"), i).otherwise(section)
    found = rows.where(~F.col("value").rlike("^\\S")).join(at, F.col("file") == F.col("of")).withColumn("section", section)
    return found.where(F.col("section").between(1, 4)).select("section", "value")


def mps_model(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(coefficients (row, variable, val), variables (name, obj), rows (name, sense, rhs)) of such lines."""
    parts = F.split(F.trim("value"), "\\s+")
    at = lambda i: F.get(parts, F.lit(i))
    sense = F.when(at(0) == "G", ">=").when(at(0) == "L", "<=").otherwise("=")
    named = lines.where("section = 1").select(at(1).alias("name"), sense.alias("sense"), (at(0) == "N").alias("free"))
    of_column = lambda n: lines.where(f"section = {n}").select(at(0).alias("variable"), F.explode(F.filter(F.array(*[F.struct(at(i).alias("row"), at(i + 1).cast("double").alias("val")) for i in (1, 3)]), lambda x: x["row"].isNotNull())).alias("c")).select("variable", "c.row", "c.val")
    cells, right = of_column(2), of_column(3).select(F.col("row").alias("name"), F.col("val").alias("rhs"))
    objective = named.where("free").select(F.col("name").alias("row"))
    obj = cells.join(objective, "row", "left_semi").select(F.col("variable").alias("name"), F.col("val").alias("obj"))
    variables = cells.select(F.col("variable").alias("name")).distinct().join(obj, "name", "left").select("name", F.coalesce("obj", F.lit(0.0)).alias("obj"))
    rows = named.where("NOT free").join(right, "name", "left").select("name", "sense", F.coalesce("rhs", F.lit(0.0)).alias("rhs"))
    return cells.join(objective, "row", "left_anti").select("row", "variable", "val"), variables, rows


def lp_lines(coefficients: DataFrame, variables: DataFrame, rows: DataFrame) -> DataFrame:
    """(section, row, place, value) of an LP file, to be written in that order: the objective, rows a term a line, binary variables."""
    spark = variables.sparkSession
    frame = spark.createDataFrame([(0, "", 0, "min:"), (0, "", 2, ";"), (2, "", 0, "bin"), (2, "", 2, ";")], "section int, row string, place int, value string")
    term = lambda v, n: F.concat(F.when(v >= 0, "+").otherwise(""), v.cast("string"), F.lit(" "), n)
    objective = variables.where("obj <> 0").select(F.lit(0).alias("section"), F.lit("").alias("row"), F.lit(1).alias("place"), term(F.col("obj"), F.col("name")).alias("value"))
    first = rows.select(F.lit(1).alias("section"), F.col("name").alias("row"), F.lit(0).alias("place"), F.concat("name", F.lit(":")).alias("value"))
    terms = coefficients.select(F.lit(1).alias("section"), "row", F.lit(1).alias("place"), term(F.col("val"), F.col("variable")).alias("value"))
    last = rows.select(F.lit(1).alias("section"), F.col("name").alias("row"), F.lit(2).alias("place"), F.concat("sense", F.lit(" "), F.col("rhs").cast("string"), F.lit(";")).alias("value"))
    names_ = variables.select(F.lit(2).alias("section"), F.lit("").alias("row"), F.lit(1).alias("place"), F.concat(F.lit(","), "name").alias("value"))
    one = variables.agg(F.min("name").alias("least"))  # the first name has no comma before it
    names_ = names_.join(F.broadcast(one)).withColumn("value", F.when(F.col("value") == F.concat(F.lit(","), "least"), F.col("least")).otherwise(F.col("value"))).drop("least")
    out = frame
    for more in (objective, first, terms, last, names_):
        out = out.unionByName(more)
    return out


def strobe_lines(nets: DataFrame) -> DataFrame:
    """(net, value): a Verilog $strobe for each net, backslashes doubled inside the format."""
    return nets.select("net", F.concat(F.lit('initial $strobe("'), F.replace(F.col("net"), F.lit("\\"), F.lit("\\\\")), F.lit('=%b", '), "net", F.lit(");")).alias("value"))


def testbench(nets: DataFrame) -> DataFrame:
    """(place, value): the lines of a testbench module that watches the nets, in order of place, then value."""
    spark = nets.sparkSession
    head = ["module generated_testbench();", "reg clk;", "initial begin", "  clk = 1'b0;", "  forever #10 clk = ~clk;", "end"]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(head)] + [(len(head) + 1, "endmodule")], "place int, value string")
    return frame.unionByName(strobe_lines(nets).select(F.lit(len(head)).alias("place"), "value"))


def cut_set_lines(cut: DataFrame) -> DataFrame:
    """(value): names of cut nets, splits folded into the net they came from."""
    return cut.select(names.clean_split(F.col("name")).alias("value")).distinct()


def code_lengths(symbols: DataFrame) -> DataFrame:
    """(symbol, n, bits): ideal code lengths of the symbols of frames, and so a bound on any prefix code's size."""
    by = symbols.groupBy("symbol").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # a row for each symbol of the alphabet
    return by.withColumn("bits", F.round(-F.log2(F.col("n") / total), 9))


def huffman_bits(counts: dict[str, int]) -> dict[str, int]:
    """Code lengths of a Huffman code of the symbols, of which there are as many as a frame's size allows."""
    heap = [(n, i, [s]) for i, (s, n) in enumerate(sorted(counts.items()))]
    heapq.heapify(heap)
    bits = dict.fromkeys(counts, 0 if len(counts) > 1 else 1)
    while len(heap) > 1:
        (a, _, x), (b, i, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in (*x, *y):
            bits[s] += 1
        heapq.heappush(heap, (a + b, i, [*x, *y]))
    return bits


def summary_lines(runs: DataFrame) -> DataFrame:
    """(run_id, value): a line of the summary for each of runs(run_id, cost, span, entropy); -1 is the heading."""
    head = runs.sparkSession.createDataFrame([(-1, "TotalCost,RunNum,TotalSpan,TotalEntropy")], "run_id int, value string")
    return head.unionByName(runs.select(F.col("run_id").cast("int").alias("run_id"), F.concat_ws(",", *[F.col(c).cast("string") for c in ("cost", "run_id", "span", "entropy")]).alias("value")))


def is_ignored(net: Column) -> Column:
    """Nets that netlists leave out: global ones, literals, and those that a synthesis tool has named as unconnected."""
    return names.is_global(net) | names.is_literal(net) | net.contains("UNCONNECTED")


def is_ignored_wire(wire: Column) -> Column:
    return names.is_global_wire(wire) | names.is_literal(wire) | wire.contains("UNCONNECTED")
