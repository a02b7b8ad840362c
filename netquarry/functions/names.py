"""Net and signal names: ranges, escapes, split suffixes, literals, compressed variable names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nets of clocks, resets and supplies, which are no data (fixed values): as nets are named, and as single wires are.
GLOBAL_NETS = ("CLK_IBUF_BUFG", "RST_IBUF", "\\<const0>", "\\<const1>", "GND", "GND_2", "CLK_IBUF", "VCC", "VCC_2", "CLK")
GLOBAL_WIRES = ("CLK_IBUF_BUFG[0]", "RST_IBUF[0]", "\\<const0> [0]", "\\<const1> [0]", "GND[0]", "GND_2[0]", "CLK_IBUF[0]", "VCC[0]", "VCC_2[0]", "CLK[0]", "RST[0]")


def is_global(net: Column) -> Column:
    """Whether a net is a global one; an escaped name may have its final blank."""
    return F.rtrim(net).isin(*GLOBAL_NETS)


def is_global_wire(wire: Column) -> Column:
    """The same for wires: the one wire of a net without a range is called like the net or has [0] at its end."""
    return wire.isin(*GLOBAL_WIRES) | F.concat(wire, F.lit("[0]")).isin(*GLOBAL_WIRES)


def is_literal(net: Column) -> Column:
    return net.rlike(r"^\d*'[bBdDhHoO]")


def clean_split(name: Column) -> Column:
    """The name of the net that a split net came from."""
    return F.substring_index(name, "_split_", 1)


def split_name(name: Column, number: Column) -> Column:
    return F.concat(clean_split(name), F.lit("_split_"), number.cast("string"))


def escape(name: Column) -> Column:
    """a[3] as the escaped identifier \\\\a [3]; a name that is escaped stays as it is."""
    ranged = F.regexp_replace(name, r"^(.*)(\[[^\[]*\])$", r"\\$1 $2")
    return F.when(name.startswith("\\"), name).when(name.rlike(r"\[[^\[]*\]$"), ranged).otherwise(F.concat(F.lit("\\"), name, F.lit(" ")))


def bit_names(base: Column, high: Column, low: Column) -> Column:
    """The names of a bus's bits, lowest first; bounds in either order, negative ones too."""
    return F.transform(F.sequence(F.least(high, low), F.greatest(high, low)), lambda i: F.concat(base, F.lit("["), i.cast("string"), F.lit("]")))


def expand_range(name: Column) -> Column:
    """a[3:0] as an array of a[3] ... a[0], from the first bound to the last; other names as an array of one."""
    base, first, last = (F.regexp_extract(name, r"^(.*)\[(-?\d+):(-?\d+)\]$", i) for i in (1, 2, 3))
    is_range = name.rlike(r"\[-?\d+:-?\d+\]$")
    bits = F.sequence(F.when(is_range, first).otherwise("0").cast("int"), F.when(is_range, last).otherwise("0").cast("int"))
    return F.when(is_range, F.transform(bits, lambda i: F.concat(base, F.lit("["), i.cast("string"), F.lit("]")))).otherwise(F.array(name))


def immediate(text: Column) -> Column:
    """The value of a Verilog literal such as 8'hFF, 4'b1010 or 3'd5, as a decimal string (unsigned 64 bits)."""
    radix, digits = F.lower(F.regexp_extract(text, r"'([bBdDhH])", 1)), F.regexp_replace(F.regexp_extract(text, r"'[bBdDhH]([0-9a-fA-F_]+)", 1), "_", "")
    return F.when(radix == "b", F.conv(digits, 2, 10)).when(radix == "h", F.conv(digits, 16, 10)).when(radix == "d", F.conv(digits, 10, 10))


def compressed(number: Column) -> Column:
    """A number in base 32, lowest digit first, digits 0-9 and a-v."""
    return F.lower(F.reverse(F.conv(number.cast("string"), 10, 32)))


def without_parameters(line: Column) -> Column:
    """An instantiation without its #( ... ) parameter list."""
    return F.regexp_replace(line, r"#\s*\((?:[^()]|\([^()]*\))*\)\s*", "")


def first_token(line: Column) -> Column:
    return F.regexp_extract(line, r"^\s*(\S+)", 1)
