import pytest
from pyspark.sql import functions as F

from netquarry.functions import names, probability, scores


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def arr(*xs):
    return F.array(*[F.lit(x) for x in xs])


def test_scores(spark):
    b, m = arr(5, -90, 3), arr(10, 100, 0)
    power, near, bad, out = one(spark, scores.imbalance_power(b, m), scores.near_violator_power(b, m), scores.violator_power(b, m), scores.exceeds(b, m))
    assert power == pytest.approx(0.5**2 + (0.9 * 16) ** 2 + (3 * 16) ** 2)
    assert near == pytest.approx(0.81 + 9) and bad == pytest.approx(9) and out
    assert one(spark, scores.ratio_power(arr(20, 10), arr(1, 1)))[0] == pytest.approx(2 * (5 / 15) ** 2 / 10)
    assert one(spark, scores.ratio_power_if_changed(arr(20, 10), arr(5, 0), arr(0, 5), arr(1, 1)))[0] == 0
    assert one(spark, scores.balance_if_moved(arr(5, 0), arr(2, 1), F.lit(True)), scores.balance_if_moved(arr(5, 0), arr(2, 1), F.lit(False))) == ([1, -2], [9, 2])
    assert one(spark, scores.affinity(arr(5, 10), arr(100, 200)), scores.affinity(arr(0, 3), arr(100, 200)), scores.max_imbalance(F.lit(3), 0.05)) == (0, 1, 1)


def test_entropy_and_cells(spark):
    assert one(spark, probability.entropy(F.lit(0.25)), probability.entropy(F.lit(0.0)), probability.entropy(F.lit(1.0)), probability.entropy(F.lit(0.5))) == (pytest.approx(0.811278, abs=1e-6), 0, 0, 1)
    n = [F.lit(x) for x in (30, 50, 15, 5)]
    assert one(spark, probability.min_entropy(*n), probability.biased_p1(*n))[1] == pytest.approx(0.7)
    assert one(spark, probability.biased_p1(*[F.lit(x) for x in (50, 52, 10, 0)]))[0] == pytest.approx(52 / 112)
    assert one(spark, probability.min_entropy(*[F.lit(0)] * 4))[0] == 0
    assert one(spark, probability.lut(arr(0.5, 0.5), F.lit(8).cast("long")), probability.lut(arr(0.25, 0.5), F.lit(6).cast("long")))[0] == 0.25
    inputs = [0.1, 0.9, 0.3, 0.6, 0.2, 0.7]
    init = -0x123456789ABCDEF  # the highest bit is set
    want = 0.0
    for k in range(64):
        if init >> k & 1:
            p = 1.0
            for i, x in enumerate(inputs):
                p *= x if k >> i & 1 else 1 - x
            want += p
    assert one(spark, probability.lut(arr(*inputs), F.lit(init).cast("long")))[0] == pytest.approx(want)
    out = one(spark, probability.carry_chain(F.lit(0.2), arr(0.5, 0.1), arr(0.4, 0.9)))[0]
    c1 = 0.4 * 0.2 + 0.6 * 0.5
    assert out[0]["co"] == pytest.approx(c1) and out[1]["co"] == pytest.approx(0.9 * c1 + 0.1 * 0.1)
    assert out[0]["o"] == pytest.approx(0.4 * 0.8 + 0.2 * 0.6) and out[1]["o"] == pytest.approx(0.9 * (1 - c1) + c1 * 0.1)
    assert one(spark, probability.mux(F.lit(0.25), F.lit(0.4), F.lit(0.8)))[0] == pytest.approx(0.5)


def test_names(spark):
    rows = {"a[3]": "\\a [3]", "a": "\\a ", "\\x ": "\\x ", "m[1][2]": "\\m[1] [2]", "a[3]b": "\\a[3]b "}
    got = spark.createDataFrame([(k,) for k in rows], "n string").select("n", names.escape(F.col("n")).alias("e")).collect()
    assert {r.n: r.e for r in got} == rows
    assert one(spark, names.expand_range(F.lit("a[3:1]")), names.expand_range(F.lit("b[-1:1]")), names.expand_range(F.lit("c"))) == (["a[3]", "a[2]", "a[1]"], ["b[-1]", "b[0]", "b[1]"], ["c"])
    assert one(spark, names.bit_names(F.lit("a"), F.lit(1), F.lit(0)))[0] == ["a[0]", "a[1]"]
    assert one(spark, *[names.immediate(F.lit(x)) for x in ("8'hFF", "4'b1010", "3'd5", "64'hFFFFFFFFFFFFFFFF", "16'hA_b")]) == ("255", "10", "5", "18446744073709551615", "171")
    assert one(spark, *[names.compressed(F.lit(x)) for x in (0, 31, 33, 1024)]) == ("0", "v", "11", "001")
    assert one(spark, names.clean_split(F.lit("n_split_4")), names.split_name(F.lit("n_split_4"), F.lit(9)), names.first_token(F.lit("  wire a;")), names.without_parameters(F.lit("LUT2 #(.INIT(4'h8)) u (.O(a))"))) == ("n", "n_split_9", "wire", "LUT2 u (.O(a))")
