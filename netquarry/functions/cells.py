"""Cell models: which outputs of a cell type follow from which inputs, and by which formula.

A gate is one output wire: (wire, kind, init, inputs). Kinds: lut (init is the table), mux (inputs I0, I1, S), co and sum
(a carry chain's inputs, init is the bit), pass, zero and one. Outputs that no model names are unknown, as undriven wires are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions import names, probability

_carry = ("CI[0]", "CYINIT[0]", *[f"DI[{i}]" for i in range(4)], *[f"S[{i}]" for i in range(4)])
_buffer, _register = {"O": ("pass", ("I[0]",))}, {"Q": ("pass", ("D[0]",))}
_fifo = {"DO": ("pass", ("DI[*]",)), "DOP": ("pass", ("DIP[*]",))}
#: type -> output port -> (kind, inputs); * is the output's bit. Types and ports are fixed values of the device library.
CELLS: dict[str, dict[str, tuple[str, tuple[str, ...]]]] = {
    **{f"LUT{n}": {"O": ("lut", tuple(f"I{i}[0]" for i in range(n)))} for n in range(1, 7)},
    "MUXF7": {"O": ("mux", ("I0[0]", "I1[0]", "S[0]"))},
    "MUXF8": {"O": ("mux", ("I0[0]", "I1[0]", "S[0]"))},
    "CARRY4": {"CO": ("co", _carry), "O": ("sum", _carry)},
    "BUFG": _buffer, "IBUF": _buffer, "OBUF": _buffer,
    "FDCE": _register, "FDPE": _register, "FDRE": _register, "FDSE": _register, "LDCE": _register, "SRL16E": _register,
    "SRLC32E": {"Q": ("pass", ("D[0]",)), "Q31": ("pass", ("D[0]",))},
    "FIFO18E1": _fifo, "FIFO36E1": _fifo,
    "GND": {"G": ("zero", ())}, "VCC": {"P": ("one", ())},
    # what these hold or compute is not modelled: every output is unknown
    **dict.fromkeys(("DSP48E1", "MMCME2_ADV", "RAMB18E1", "RAMB36E1", "RAM32M", "RAM64M", "RAM64X1D", "RAM128X1S", "RAM256X1S", "epim_blackbox"), {}),
}


def register(kind: str, outputs: dict[str, tuple[str, tuple[str, ...]]]) -> None:
    """Adds a cell type, or replaces its model."""
    unknown = {k for k, _ in outputs.values()} - {"lut", "mux", "co", "sum", "pass", "zero", "one"}
    if unknown:
        raise ValueError(f"no formula for {sorted(unknown)}")
    CELLS[kind] = outputs


def unsigned(text: Column) -> Column:
    """A decimal string of up to 64 bits as the long of the same bits."""
    return F.conv(text, 10, -10).cast("long")


def gates(pins: DataFrame) -> DataFrame:
    """(wire, kind, init, inputs) of pins(type, instance, params, port, pos, net), a row for each connected bit.

    An input that is not connected is a null in inputs. Types without a model are an error, raised when rows are computed; a
    LUT without a table is one too. Pins of a cell are gathered: as many as its type has.
    """
    spark = pins.sparkSession
    rows = [(t, port, kind, list(ins)) for t, outputs in CELLS.items() for port, (kind, ins) in outputs.items()]
    model = F.broadcast(spark.createDataFrame(rows, "type string, port string, kind string, ins array<string>"))  # the table above
    known = F.when(F.col("type").isin(*CELLS), F.col("instance")).otherwise(F.raise_error(F.concat(F.lit("no model of the cell type "), F.col("type"))))
    rows = pins.withColumn("instance", known).where(F.col("net").isNotNull())
    key = F.concat("port", F.lit("["), F.col("pos").cast("string"), F.lit("]"))
    nets = rows.groupBy("instance").agg(F.map_from_entries(F.collect_set(F.struct(key.alias("k"), F.col("net").alias("v")))).alias("nets"))
    driven = rows.join(model, ["type", "port"]).join(nets, "instance")
    inputs = F.transform("ins", lambda i: F.try_element_at("nets", F.replace(i, F.lit("*"), F.col("pos").cast("string"))))
    table = unsigned(names.immediate(F.col("params")["INIT"]))
    init = F.when(F.col("kind") == "lut", F.coalesce(table, F.raise_error(F.concat(F.lit("no INIT of "), F.col("instance"))).cast("long"))).otherwise(F.col("pos").cast("long"))
    return driven.select(F.col("net").alias("wire"), "kind", init.alias("init"), inputs.alias("inputs"))


def output(kind: Column, init: Column, p: Column) -> Column:
    """Probability of 1 of a gate, given its inputs' probabilities; between 0 and 1 whatever rounding does.

    A carry chain starts from CYINIT where that can be 1, else from CI; both at once is an error.
    """
    at = lambda i: F.get(p, F.lit(i))
    both = F.raise_error(F.lit("a carry chain has both CI and CYINIT")).cast("double")
    carry = F.when((at(0) > 0) & (at(1) > 0), both).when(at(1) > 0, at(1)).otherwise(at(0))
    bits = lambda: F.get(probability.carry_chain(carry, F.slice(p, 3, 4), F.slice(p, 7, 4)), init.cast("int"))
    found = (
        F.when(kind == "lut", probability.lut(p, init)).when(kind == "mux", probability.mux(at(2), at(0), at(1))).when(kind == "co", bits()["co"]).when(kind == "sum", bits()["o"])
        .when(kind == "pass", at(0)).when(kind == "zero", 0.0).when(kind == "one", 1.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), found))
