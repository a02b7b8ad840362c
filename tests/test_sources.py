import contextlib
import random
import re

import plain_vcd
import pytest
from pyspark.sql import functions as F

from netquarry import cli
from netquarry.operators import dwell, ilp, tables
from netquarry.sources import config, graph_xml, text_formats, vcd, verilog

VCD = """$date today $end
$scope module top $end
$scope module dut $end
$var wire 1 ! a $end
$scope module u1 $end
$var reg 4 " b [3:0] $end
$upscope $end
$var real 64 # r $end
$upscope $end
$upscope $end
$enddefinitions $end
#0
$dumpvars
x!
bx "
r1.5 #
$end
#10
1!
b101 "
#20
0!
#1030
z!
#1040
"""
VERILOG = """// a comment
module top (a, y);
input [1:0] a; /* two
lines */ output y;
wire n1, \\esc[0] ; (* keep *) wire [3:0] bus;
LUT2 #(.INIT(4'h8)) u1 (.O(n1), .I0(a[0]),
  .I1(a[1]));
FDRE \\reg[1]  (.Q(y), .D(n1), .C(), .R({bus[2:1], 1'b0}));
endmodule
"""
CONFIG = """<partitioner_configuration><general_configuration>
<device_resource><resource_id>1</resource_id><resource_capacity>100</resource_capacity><max_imbalance>0.1</max_imbalance></device_resource>
<device_resource><resource_id>0</resource_id><resource_capacity>500</resource_capacity><resource_ratio_weight>3</resource_ratio_weight><max_imbalance>0.05</max_imbalance></device_resource></general_configuration>
<preprocessor_configuration><lowest_capacity_cost_strategy><use_flexible_capacity/></lowest_capacity_cost_strategy></preprocessor_configuration>
<klfm_configuration><gain_bucket_type><multi_resource_mixed_bucket><use_adaptive_implementations/><use_best_gain_imbalance_score_classic_selection_policy/></multi_resource_mixed_bucket></gain_bucket_type>
<node_implementation_options><mutation_options><mutation_rate>7</mutation_rate></mutation_options><rebalance_options><rebalance_on_start_of_pass/></rebalance_options></node_implementation_options></klfm_configuration></partitioner_configuration>"""


def lines(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "node_id long, value string")


def test_chaco(spark):
    assert text_formats.chaco_header("3 2") == (3, 2, 0) and text_formats.chaco_header("3 2 21 ") == (3, 2, 21)
    with pytest.raises(ValueError):
        text_formats.chaco_header("3 2 7")
    got = lambda mode, *t: sorted(tuple(r) for r in text_formats.chaco_edges(lines(spark, *t), mode).collect())
    assert got(0, "2", "1 3", "2") == [(1, 2, 1), (2, 3, 1)]
    assert got(1, "2 9", "1 9 3 4", "2 4") == [(1, 2, 9), (2, 3, 4)]
    assert got(10, "7 2", "7 1", "5") == [(1, 2, 1)]
    assert got(11, "7 2 3", "7 1 3", "5") == [(1, 2, 3)]
    vectors = text_formats.weight_vectors(lines(spark, "5 0 0", "0 9 0 12 0 0"), 3).collect()
    assert [[list(v) for v in r.impls] for r in vectors] == [[[5, 0, 0]], [[0, 9, 0], [12, 0, 0]]]


def test_chaco_file_and_cli(spark, tmp_path):
    (tmp_path / "g.graph").write_text("4 4 20\n2 4\n1 3\n2 4\n1 3")  # no newline at the end
    (tmp_path / "g.wt").write_text("4 2\n1 0\n0 1 1 0\n1 0\n0 1\n")
    (tmp_path / "c.xml").write_text(CONFIG)
    cli.main(["partition", "--chaco", str(tmp_path / "g.graph"), "--weights", str(tmp_path / "g.wt"), "--config", str(tmp_path / "c.xml"), "--nruns", "2", "--output", str(tmp_path / "out")], spark)
    assert spark.read.parquet(str(tmp_path / "out/assign")).count() == 4
    assert spark.read.text(str(tmp_path / "out/sol")).where("value LIKE 'X% 1%'").count() >= 2
    cli.main(["ilp", "--chaco", str(tmp_path / "g.graph"), "--weights", str(tmp_path / "g.wt"), "--resources", "2", "--output", str(tmp_path / "mps")], spark)
    assert spark.read.text(str(tmp_path / "mps")).count() > 40
    # MPS read again gives the same program, and LP has each row and variable
    first = text_formats.mps_model(text_formats.read_mps(spark, str(tmp_path / "mps")))
    cli.main(["ilp", "--mps", str(tmp_path / "mps"), "--write-lp", str(tmp_path / "lp"), "--output", str(tmp_path / "again")], spark)
    again = text_formats.mps_model(text_formats.read_mps(spark, str(tmp_path / "again")))
    nodes, pins, edges = cli.read_chaco(spark, str(tmp_path / "g.graph"), str(tmp_path / "g.wt"), 2)
    made = ilp.coefficients(nodes, pins, edges, 0.01), ilp.variables(nodes, edges), ilp.rows(nodes, edges, 2)
    for a, b, c in zip(first, again, made):
        assert sorted(map(tuple, a.select(*c.columns).collect())) == sorted(map(tuple, b.select(*c.columns).collect())) == sorted(map(tuple, c.collect()))
    lp = [r.value for r in spark.read.text(str(tmp_path / "lp")).collect()]
    assert sum(x.endswith(":") for x in lp) == made[2].count() + 1 and sum(x.startswith((">=", "<=", "=")) for x in lp) == made[2].count()
    place = ["partition", "--chaco", str(tmp_path / "g.graph"), "--weights", str(tmp_path / "g.wt"), "--config", str(tmp_path / "c.xml")]
    cli.main([*place, "--export-initial-sol", str(tmp_path / "start"), "--initial-sol-only", "--sol-gurobi-format", "--output", str(tmp_path / "none")], spark)
    assert spark.read.text(str(tmp_path / "start/mst")).count() == made[1].count() and not (tmp_path / "none").exists()
    cli.main([*place, "--nruns", "2", "--write-cutset-dir", str(tmp_path / "cuts")], spark)
    summary = [r.value.split(",") for r in spark.read.text(str(tmp_path / "cuts/summary.csv")).collect()]
    assert summary[0] == ["TotalCost", "RunNum", "TotalSpan", "TotalEntropy"] and [r[1] for r in summary[1:]] == ["0", "1"]
    names = [r.run for r in spark.read.text(str(tmp_path / "cuts/cutsets")).select("run").collect()]
    assert sum(n.split("_")[1] == "0" for n in names) == int(summary[1][2])
    cli.main([*place, "--nways", "4", "--output", str(tmp_path / "four")], spark)
    assert spark.read.parquet(str(tmp_path / "four/assign")).count() == 4
    with pytest.raises(ValueError, match="power of two"):
        cli.main([*place, "--nways", "3"], spark)
    (tmp_path / "bad.graph").write_text("4 9\n2\n1\n\n\n")
    with pytest.raises(ValueError):
        cli.read_chaco(spark, str(tmp_path / "bad.graph"), None, 1)


def test_ntl(spark, tmp_path):
    (tmp_path / "a.xntl").write_text("module_begin\nLUT2\nu1\na\n0.5\na\n0.25\ny\n0.811278\nmodule_end\n\nmodule_begin\nFD\nu2\ny\n0.1\nmodule_end\n")
    (tmp_path / "lib").write_text("LUT2 1 0 0 0 1 0\nFD 2 0 0\nLUT2 9 9 9\n")
    modules = text_formats.ntl_modules(spark.read.text(str(tmp_path / "a.xntl"), lineSep="module_end"), True)
    got = {r.instance: (r.type, [(w.name, w.entropy) for w in r.wires]) for r in modules.collect()}
    assert got == {"u1": ("LUT2", [("a", 0.5), ("a", 0.25), ("y", 0.811278)]), "u2": ("FD", [("y", 0.1)])}
    library = text_formats.implementation_library(text_formats.numbered_lines(spark, str(tmp_path / "lib")))
    nodes, pins, edges = text_formats.netlist_hypergraph(modules, library)
    assert {r.instance: [list(v) for v in r.impls] for r in nodes.collect()} == {"u1": [[1, 0, 0], [0, 1, 0]], "u2": [[2, 0, 0]]}
    assert {(r.net, r.degree, r.entropy) for r in edges.collect()} == {("a", 1, 0.5), ("y", 2, 0.811278)} and pins.count() == 3
    with pytest.raises(Exception, match="no implementation of"):
        text_formats.netlist_hypergraph(modules, library.where("type <> 'FD'"))[0].collect()
    back = text_formats.ntl_modules(text_formats.ntl_blocks(modules, True), True)
    assert sorted(map(str, back.collect())) == sorted(map(str, modules.collect()))


def test_vcd(spark, tmp_path):
    (tmp_path / "t.vcd").write_text(VCD)
    changes = vcd.read(spark, str(tmp_path / "t.vcd"))
    rows = {(r.signal, r.bit, r.t): r.v for r in changes.collect()}
    assert rows["a", 0, 10] == "1" and [rows["u1/b", i, 10] for i in range(4)] == ["1", "0", "1", "0"] and rows["u1/b", 3, 0] == "x" and not any(s == "r" for s, *_ in rows)
    assert plain_vcd.extend("z1", 4) == "1zzz" and plain_vcd.extend("1", 3) == "100"
    held = dwell.intervals(changes, 1040)
    got = {(r.signal, r.bit): (r.n0, r.n1, r.nx, r.nz) for r in dwell.dwell(held).collect()}
    assert got["a", 0] == (1010, 10, 10, 10) and got["u1/b", 0] == (0, 1030, 10, 0) and all(sum(v) == 1040 for v in got.values())
    by = {(r.signal, r.bit, r.slice): (r.n0, r.n1, r.nx, r.nz) for r in dwell.sliced(held, 500).collect()}
    assert by["a", 0, 0] == (480, 10, 10, 0) and by["a", 0, 1] == (500, 0, 0, 0) and by["a", 0, 2] == (30, 0, 0, 10)
    cli.main(["vcd", "--vcd", str(tmp_path / "t.vcd"), "--entropy", str(tmp_path / "e"), "--width", "500"], spark)
    cli.main(["track", "--entropy", str(tmp_path / "e"), "--output", str(tmp_path / "csv")], spark)
    assert spark.read.text(str(tmp_path / "csv")).count() == 5
    cli.main(["vcd", "--vcd", str(tmp_path / "t.vcd"), "--entropy", str(tmp_path / "e2"), "--huffman", "--symbol-size", "2"], spark)
    assert text_formats.huffman_bits({"a": 5, "b": 2, "c": 1, "d": 1}) == {"a": 1, "b": 2, "c": 3, "d": 3} and text_formats.huffman_bits({"a": 3}) == {"a": 1}
    cli.main(["compare-vcd", "--width", "500", "--gold", str(tmp_path / "t.vcd"), "--compare", str(tmp_path / "t.vcd"), "--output", str(tmp_path / "d2")], spark)
    assert spark.read.csv(str(tmp_path / "d2"), header=True).count() == 3 * 5
    cli.main(["compare-vcd", "--gold", str(tmp_path / "t.vcd"), "--compare", str(tmp_path / "t.vcd"), "--output", str(tmp_path / "d")], spark)
    assert spark.read.csv(str(tmp_path / "d"), header=True).where("CAST(abs_diff AS DOUBLE) > 0").count() == 0


def test_verilog(spark, tmp_path):
    (tmp_path / "n.v").write_text(VERILOG)
    rows = verilog.statements(spark, str(tmp_path / "n.v")).cache()
    assert [r.kind for r in rows.orderBy("number").select(verilog.statement_kind(F.col("value")).alias("kind")).collect()] == ["other", "net", "net", "net", "net", "instance", "instance"]
    nets = {(r.kind, r.name.strip(), r.high, r.low) for r in verilog.nets(rows).collect()}
    assert {("input", "a", 1, 0), ("output", "y", 0, 0), ("wire", "n1", 0, 0), ("wire", "bus", 3, 0), ("wire", "\\esc[0]", 0, 0)} == nets
    assert verilog.wires(verilog.nets(rows)).count() == 9
    pins = {(r.instance.strip(), r.port, r.pos): r.net for r in verilog.instances(rows.where(verilog.statement_kind(F.col("value")) == "instance")).collect()}
    assert pins["u1", "I1", 0] == "a[1]" and pins["\\reg[1]", "R", 0] == "1'b0" and pins["\\reg[1]", "R", 1] == "bus[1]" and pins["\\reg[1]", "R", 2] == "bus[2]" and pins["\\reg[1]", "C", None] is None
    assert verilog.parse("FD u2 (a, b[1:0])")[3] == [("0", ["a"]), ("1", ["b[1]", "b[0]"])]
    broken = verilog.instances(spark.createDataFrame([("FD u (",), (None,)], "value string")).collect()
    assert all(r.instance is None for r in broken) and len(broken) == 2
    cli.main(["functional", "--verilog", str(tmp_path / "n.v"), "--output", str(tmp_path / "o")], spark)
    values = {r.name: r.h for r in text_formats.shannon_values(spark.read.text(str(tmp_path / "o/shannon"))).collect()}
    assert values["n1"] == pytest.approx(0.811278, abs=1e-6) and values["a[0]"] == 1
    cli.main(["structural", "--verilog", str(tmp_path / "n.v"), "--output", str(tmp_path / "ntl")], spark)
    assert spark.read.text(str(tmp_path / "ntl")).where("value = 'module_begin'").count() == 2


def test_config():
    c = config.read_config(CONFIG)
    assert c.capacity == [500, 100] and c.ratio == [3, 1] and c.share == [0.05, 0.1] and c.preprocessor == "lowest_cost" and c.flexible_capacity
    o = c.options
    assert o.policy == "best_gain_imbalance_classic" and o.adaptive and o.rebalance and o.mutation_rate == 7
    with pytest.raises(ValueError):
        config.read_config(CONFIG.replace("500", "-5"))
    with pytest.raises(ValueError, match="use_magic"):
        config.read_config(CONFIG.replace("<use_adaptive_implementations/>", "<use_magic/>"))
    more = config.read_config(CONFIG.replace("<use_adaptive_implementations/>", "<use_ratio_in_score/>").replace("<rebalance_on_start_of_pass/>", "<rebalance_on_demand><rebalance_on_demand_cap_per_run>3</rebalance_on_demand_cap_per_run><rebalance_on_demand_cap_per_pass>2</rebalance_on_demand_cap_per_pass></rebalance_on_demand>").replace(
        "<mutation_options>", "<restrict_supernodes_to_default_implementation/><reuse_previous_run_implementations/><mutation_options>").replace("<general_configuration>", "<general_configuration><use_ratio_as_quality_metric/>")).options
    assert more.ratio_in_score and more.ratio_as_quality and more.rebalance_on_demand and (more.demand_per_run, more.demand_per_pass) == (3, 2) and more.reuse_implementations and more.supernode_cap == 1 and not more.adaptive


def test_entropy_files(spark):
    rows = spark.createDataFrame([("3",), ("a[0] 1 2 3 4 5 6 7 8",), ("\\b [1] 0 1 0 0",), ("c 1e-05",), ("\\d [2] 0.5",)], "value string")
    got = {(r.name, r.slice): (r.n0, r.nz) for r in text_formats.counts(rows).collect()}
    assert got == {("a[0]", 0): (1, 4), ("a[0]", 1): (5, 8), ("\\b [1]", 0): (0, 0)}
    assert {r.name: r.h for r in text_formats.shannon_values(rows.where("value LIKE 'c%' OR value LIKE '%d%'")).collect()} == {"c": 1e-05, "\\d [2]": 0.5}


def test_mps_and_weights(spark, tmp_path):
    cells = spark.createDataFrame([("R1", "V1", 2.0), ("R2", "V1", -1.0)], "row string, variable string, val double")
    lines_ = text_formats.mps_lines(cells, spark.createDataFrame([("V1", 3.0)], "name string, obj double"), spark.createDataFrame([("R1", ">=", 1.0), ("R2", "=", 0.0)], "name string, sense string, rhs double"))
    assert sorted(map(tuple, text_formats.mps_model(lines_)[0].collect())) == [("R1", "V1", 2.0), ("R2", "V1", -1.0)]
    made = config.synthetic_weights(spark.range(5000).withColumnRenamed("id", "node_id"), [(0.84, 5, 15), (0.09, 170, 370), (0.07, 230, 630)])
    kinds = {r.k: r.n for r in made.select(F.array_position(F.transform(F.get("impls", F.lit(0)), lambda x: x > 0), True).alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert abs(kinds[1] / 5000 - 0.84) < 0.02 and abs(kinds[3] / 5000 - 0.07) < 0.02
    made = config.synthetic_weights(spark.range(4000).withColumnRenamed("id", "node_id"), [(0.5, 10, 210), (0.5, 5, 15)], binomial=True, cluster=4)
    rows = {r.node_id: list(r.impls[0]) for r in made.collect()}
    one, two = [w[0] for w in rows.values() if w[0]], [w[1] for w in rows.values() if w[1]]
    assert all((rows[v][0] > 0) == (rows[v - v % 4][0] > 0) for v in rows) and len(one) + len(two) == 4000 and abs(len(one) - 2000) < 250
    mean, spread = sum(one) / len(one), (sum(x * x for x in one) / len(one) - (sum(one) / len(one)) ** 2) ** 0.5
    assert abs(mean - 110) < 1 and abs(spread - 50**0.5) < 0.6 and abs(sum(two) / len(two) - 10) < 0.2


def test_weights_command(spark, tmp_path):
    cli.main(["weights", "--nodes", "300", "--binomial", "--cluster", "5", "--output", str(tmp_path / "w")], spark)
    assert spark.read.text(str(tmp_path / "w")).count() == 300


def test_graph_xml(spark, tmp_path):
    weights = "<resource_weights><lut_factor>3</lut_factor><dsp_factor>0</dsp_factor><bram_factor>1</bram_factor></resource_weights>"
    (tmp_path / "g.xml").write_text(f"""<graph>
      <node><name>a</name>{weights}<source_edges><name>e1</name></source_edges><sink_edges><name>e2</name><name>e1</name></sink_edges></node>
      <node><name>b</name><source_edges><name>e2</name></source_edges><sink_edges><name>e3</name></sink_edges></node>
      <port><name>p</name><sink_edge>e3</sink_edge></port>
      <edge><name>e1</name><weight>2</weight></edge><edge><name>e2</name><weight>1</weight></edge><edge><name>e3</name><weight>4</weight></edge></graph>""")
    nodes, pins, edges = graph_xml.read(spark, str(tmp_path / "g.xml"))
    name, net = ({r[0]: r.name for r in x.collect()} for x in (nodes, edges))
    assert {(net[r.edge_id], name[r.node_id]) for r in pins.collect()} == {("e1", "a"), ("e2", "a"), ("e2", "b"), ("e3", "b"), ("e3", "p")} and pins.count() == 5
    assert {r.name: [list(v) for v in r.impls] for r in nodes.collect()} == {"a": [[3, 0, 1]], "b": [[0, 0, 0]], "p": [[0, 0, 0]]} and {r.name: r.width for r in edges.collect()}["e3"] == 4
    (tmp_path / "bad.xml").write_text("<graph><node><name>a</name><source_edges><name>no</name></source_edges><sink_edges><name>no</name></sink_edges></node><edge><name>e</name><weight>1</weight></edge></graph>")
    with pytest.raises(Exception, match="no such edge: no"):
        graph_xml.read(spark, str(tmp_path / "bad.xml"))[1].collect()


@contextlib.contextmanager
def small_splits(spark, size):
    """Files are read in splits of so many bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], size)
    spark.conf.set(keys[1], "8")
    try:
        yield
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)


def dump(rng, n, wrap):
    """A dump with comments, reals, untracked codes and, if wrapped, white space wherever the grammar allows it."""
    space = lambda: rng.choice([" ", "\n", "\r\n", "\n\n", "\t"]) if wrap else " "
    head = [
        "$date today $end", "$timescale 1ns $end", "$scope module top $end", "$scope module dut $end", "$scope module core $end", "$var wire 1 ! a $end", f"$var{space()}reg 6{space()}#{space()}bus [7:2] $end", "$upscope $end",
        f"$comment $var wire 1 ? not{space()}this $en $end", "$var wire 1 % b [3] $end", "$var wire 1 ! again $end", "$var real 64 ~ r $end", "$var tri 2 $x \\odd[1] [0:1] $end", "$upscope $end", "$upscope $end", "$enddefinitions $end"]
    body = []
    for t in range(n):
        body.append(f"#{10 * t}")
        vectors = [f"b{v}{space()}{c}" for v, c in (("101", "#"), ("z1", "#"), ("X", "#"), ("1", "$x"))]
        words = ["1!", "#77", "b1 #", "text", "$dumpvars", "#5", "0%"]
        comment = f"$comment {space().join(rng.choice(words) for _ in range(rng.randint(0, 40 if wrap else 6)))}{space()}$end"
        body += rng.sample(["1!", "0!", "x!", *vectors, "0%", "1%", f"r1.5{space()}~", "0?", comment, "what", "$dumpvars 1! $end"], 3)
    return "\n".join([*head, *body]) + rng.choice(["", "\n"])


@pytest.mark.parametrize("size", ["110", "400"])
def test_vcd_in_splits(spark, tmp_path, size):
    """Read in splits of a few dozen bytes, dumps give what one pass over their text gives: commands, places, times and changes."""
    rng = random.Random(4)
    texts = {f"{i}.vcd": dump(rng, n, wrap) for i, (n, wrap) in enumerate([(4, False), (20, True), (12, True), (1, True)])}
    texts["4.vcd"] = texts["3.vcd"] + " b10"  # ends before the code
    texts["5.vcd"] = texts["2.vcd"].replace("#110", "$comment\n" + "1! b0 #\n" * 30 + "#999999 $end\n#110")
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    with small_splits(spark, size):
        found = tables.settle(vcd.commands(spark, str(tmp_path / "*.vcd")))
        got, bits = found.collect(), vcd.changed(found).collect()
    for name, text in texts.items():
        mine = sorted((r.seq, r.kind, r.t, r.word, r.value) for r in got if r.file.endswith(f"/{name}"))
        assert mine == sorted(plain_vcd.commands(text)), name
        assert sorted((r.signal, r.bit, r.t, r.seq, r.v) for r in bits if r.file.endswith(f"/{name}")) == sorted(plain_vcd.changes(text)), name


@pytest.mark.parametrize("size", ["250"])
def test_vcd_up_to_a_place(spark, tmp_path, size):
    text = dump(random.Random(8), 25, True)
    (tmp_path / "t.vcd").write_bytes(text.encode())
    for most in (0, 700):
        with small_splits(spark, size):
            got = sorted((r.seq, r.kind, r.t, r.word, r.value) for r in vcd.commands(spark, str(tmp_path / "t.vcd"), most).where("kind IN ('time', 'unknown', 'simulation')").collect())
        begins = {}  # the place of the line of each token
        at = n = 0
        for line in text.split("\n"):
            for _ in line.split():
                begins[n] = at
                n += 1
            at += len(line.encode()) + 1
        assert got == sorted(c for c in plain_vcd.commands(text) if c[1] in ("time", "unknown", "simulation") and begins[c[0]] < most)


@pytest.mark.parametrize("size", ["90"])
def test_statements_and_lines_in_splits(spark, tmp_path, size):
    """Statements, their order and line numbers don't hang on the splits."""
    rng = random.Random(3)
    pieces = [
        "LUT2 #(.INIT(4'h8)) u{i} (.O(n{i}), .I0(a[0]),\n   .I1(b));", "wire w{i}; /* a comment; over\n\n lines */", "// all of; this line (* goes\n", "(* keep = \"x;y\" *)\nwire\n k{i}\n;", "FD \\f;{i} (.Q(q), .D(d));",
        "\r\nFD \"s;{i}\" \\/*no (.Q(q));\r\n", "(* a\n b;\n *) input [1:0]\n\n i{i};", ";;", "endmodule\n", "/* ; */ /* ; */ X y{i} (a); Y z{i} (b);"]
    text = "\n".join(rng.choice(pieces).replace("{i}", str(i)) for i in range(30)) + "\nlast words"
    (tmp_path / "n.v").write_bytes(text.encode())
    (tmp_path / "m.v").write_bytes(b"module m;\nwire a;\n")
    found = []
    for s in (size, "1m"):
        with small_splits(spark, s):
            found.append(sorted((r.file, r.number, r.value) for r in verilog.statements(spark, str(tmp_path / "*.v")).collect()))
            lines_ = sorted((r.file[-3:], r.line_no, r.value) for r in text_formats.numbered_lines(spark, str(tmp_path / "*.v")).collect())
    assert found[0] == found[1]
    want = [("m.v", i, x) for i, x in enumerate(["module m;", "wire a;"])] + [("n.v", i, x) for i, x in enumerate(text.split("\n"))]
    assert lines_ == sorted(want)
    # by hand: comments, then attributes, then semicolons outside of strings and escaped names
    values = [v for f, _, v in found[0] if f.endswith("n.v")]
    rest, plain = text, []
    token = re.compile(r'/\*.*?\*/|//[^\n]*|\(\*.*?\*\)|("[^"\n]*"|\\\S+)|(;)', re.S)
    at, now = 0, ""
    for m in token.finditer(rest):
        now += rest[at:m.start()] + (m[1] or " " if not m[2] else "")
        at = m.end()
        if m[2]:
            plain.append(now)
            now = ""
    plain.append(now + rest[at:])
    clean = lambda x: re.sub(r"\s+", " ", re.sub(r"\bendmodule\b", " ", x)).strip()
    assert [clean(v) for v in values] == [c for x in plain if (c := clean(x))]


def test_mps_in_splits(spark, tmp_path):
    cells = spark.createDataFrame([(f"R{i % 40}", f"V{i}", i + 1.0) for i in range(60)], "row string, variable string, val double")
    rows = spark.createDataFrame([(f"R{i}", ">=", float(i)) for i in range(40)], "name string, sense string, rhs double")
    variables = spark.createDataFrame([(f"V{i}", float(i % 3)) for i in range(60)], "name string, obj double")
    text_formats.mps_file(text_formats.mps_lines(cells, variables, rows)).orderBy("section", "place", "value").select("value").coalesce(1).write.text(str(tmp_path / "mps"))
    with small_splits(spark, "500"):
        back = text_formats.mps_model(text_formats.read_mps(spark, str(tmp_path / "mps")))
        for a, b in zip(back, (cells, variables, rows)):
            assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))
