"""Steps whose work or memory grew faster than the tables, and keys that only large tables have."""

import duckdb
import pytest
from pyspark.sql import functions as F

from netquarry.operators import hypergraph, ilp, implementations, propagate
from netquarry.plans import oracles, queries
from netquarry.sources import text_formats

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_chaco_roundtrip_of_large_keys(spark, tmp_path):
    """Part numbers beyond the suppliers' offset: u > v, u = v, and two edges between the same two numbers."""
    rows = [(1, 5, 3), (2, 1000004, 3), (3, 1000003, 3), (4, 1000010, 8), (5, 1000008, 10), (6, 1200000, 7), (7, 5, 3)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(tuple(r) for r in queries.QUERIES["fmt_chaco_roundtrip"](spark, str(tmp_path)).select("u", "v", "weight").collect())
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == sorted(duck.sql(f"SELECT u, v, weight FROM ({oracles.SQL['fmt_chaco_roundtrip']})").fetchall())


def test_numbered_lines_of_parts(spark, tmp_path):
    """The parts of one text: numbers go on from file to file, empty ones included."""
    (tmp_path / "text").mkdir()
    for name, value in {"part-0": "a\nb\n", "part-1": "", "part-2": "c\n", "part-3": "d\ne\n"}.items():
        (tmp_path / "text" / name).write_text(value)
    got = sorted((r.line_no, r.value) for r in text_formats.numbered_lines(spark, str(tmp_path / "text"), as_one=True).collect())
    assert got == list(enumerate("abcde"))


def test_histogram_reads_its_runs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def cost(x):
        seen.add(1)
        return float(x * x)

    found = hypergraph.run_histogram(spark.range(32).select(cost("id").alias("cost")), "cost", cumulative=True).collect()
    assert seen.value == 32 and max(r.n for r in found) == 32


@pytest.mark.parametrize("name", ["hg_run_costs", "hg_kway_min_cost"])
def test_runs_are_bits_of_a_mask(spark, name):
    """No pin is repeated for each run."""
    assert "Generate explode(" not in plan(queries.QUERIES[name](spark, SF))


@pytest.mark.parametrize("sparse", [False, True])
def test_left_sides_are_coefficients_times_values(spark, sparse):
    nodes = spark.createDataFrame([(i, [[i + 1, 0], [0, 2 * i + 1]][: 1 + i % 2], i % 2) for i in range(40)], "node_id long, impls array<array<int>>, sel int")
    pins = spark.createDataFrame([(e, (7 * e + 5 * i) % 40) for e in range(30) for i in range(2 + e % 3)], "edge_id long, node_id long")
    edges = spark.createDataFrame([(e, 1.0) for e in range(30)], "edge_id long, width double")
    values = ilp.solution(nodes, pins, edges, nodes.select("node_id", (F.col("node_id") % 3 % 2).cast("int").alias("part"))).select("name", "value")
    if sparse:
        values = values.where("value <> 0")
    rows = ilp.coefficients(nodes, pins, edges, 0.01).withColumnRenamed("variable", "of").join(values.withColumnRenamed("name", "of"), "of", "left")
    want = {r.row: r.lhs for r in rows.groupBy("row").agg(F.sum(F.col("val") * F.coalesce("value", F.lit(0))).alias("lhs")).collect()}
    got = {r.name: r.lhs for r in ilp.left_sides(nodes, pins, edges, 0.01, values).collect()}
    assert set(got) == set(want) and len(got) == 4 + 40 + 6 * 30
    assert got == pytest.approx(want)


def test_coefficients_count_a_net_by_its_pins(spark):
    """Not by its pins' variables in both parts."""
    nodes = spark.createDataFrame([(1, [[1], [2]], 0), (2, [[3]], 0)], "node_id long, impls array<array<int>>, sel int")
    pins, edges = spark.createDataFrame([(5, 1), (5, 2)], "edge_id long, node_id long"), spark.createDataFrame([(5, 1.0)], "edge_id long, width double")
    found = ilp.coefficients(nodes, pins, edges, 0.01)
    assert {(r.row, r.val) for r in found.where("variable LIKE 'C%' AND row LIKE 'T%'").collect()} == {("TA_5", 3.0), ("TB_5", 3.0)}
    grouped = [line for line in plan(found).splitlines() if "Aggregate [edge_id" in line]
    assert grouped and not any(", part" in line for line in grouped)


def test_verilog_lines_are_dealt_before_they_are_parsed(spark):
    lines = plan(queries.QUERIES["verilog_parse"](spark, SF)).splitlines()
    parse = next(i for i, line in enumerate(lines) if "MapInArrow" in line)
    assert any("RepartitionByExpression" in line for line in lines[parse:])


def test_supernodes_go_to_workers_in_batches(spark):
    members = spark.createDataFrame([(i // 4, i, [[i, 0], [0, 1]], i % 2) for i in range(16)], "super_id long, node_id long, impls array<array<int>>, sel int")
    found = implementations.supernode_implementations(members)
    assert "FlatMapGroupsInPandas" not in plan(found)
    assert {r.super_id: r.impls[0] for r in found.collect()}[1] == [4 + 6, 2]


@pytest.mark.parametrize(("name", "most"), [("hg_coarse_cut", 2), ("hg_contract", 2)])
def test_repeats_fall_away_once(spark, name, most):
    """Pins are made distinct between the clusters alone: one aggregation without sums for each, no other degree of the nets before."""
    text = plan(queries.QUERIES[name](spark, SF))
    assert text.count("_degree") > 0 and sum("Aggregate [edge_id" in line and "node_id" in line and "count" not in line and "sum" not in line for line in text.splitlines()) <= most


def test_a_chain_takes_rounds_whatever_its_length(spark, monkeypatch):
    """Lines are put together within ranges of names, over them, and link by link where names do not help."""
    n, written, before = 600, [], propagate.evaluated
    gates = [(f"w{i * 7 % n}" if i else "w0", "lut", 1, [f"w{(i - 1) * 7 % n}"]) for i in range(1, n)]
    monkeypatch.setattr(propagate, "evaluated", lambda w, f: (written.append(1), before(w, f))[1])
    monkeypatch.setattr(propagate, "LINES_A_TASK", 64)
    got = {r.wire: (r.p1, r.level) for r in propagate.propagate(spark.createDataFrame(gates, "wire string, kind string, init long, inputs array<string>"), spark.createDataFrame([("w0", 0.25)], "wire string, p1 double")).collect()}
    assert got == {f"w{i * 7 % n}": (0.75 if i % 2 else 0.25, i) for i in range(n)} and len(written) <= 6
