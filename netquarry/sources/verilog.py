"""Structural Verilog: statements out of files, net declarations, and instantiations through a tokenizer."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netquarry.functions import names
from netquarry.operators.tables import settle
from netquarry.sources import splits

#: First words of statements that are no instantiation (fixed values).
NET_KINDS = ("input", "output", "inout", "wire", "reg", "tri", "supply0", "supply1")
KEYWORDS = (*NET_KINDS, "module", "endmodule", "assign", "parameter", "localparam", "defparam", "specify", "endspecify")
_token = re.compile(r"\\\S+\s|\d*'[bBdDhHoO][0-9a-fA-FxXzZ_]+|[A-Za-z_$][\w$]*|\d+(?:\.\d+)?|\"[^\"]*\"|[()\[\]{},.:#;=~-]")


#: States of the lexer, and what ends those that aren't plain text (fixed values).
PLAIN, COMMENT, ATTRIBUTE = range(3)
CLOSED_BY = {COMMENT: "*/", ATTRIBUTE: "*)"}
_mark = re.compile(r'/\*|//|\(\*|;|"(?:[^"\\]|\\.)*"|\\\S+')
_ROW = [("file", pa.string()), ("block", pa.int64()), ("starts", pa.int32()), ("at", pa.int64()), ("open", pa.int64()), ("whole", pa.bool_()), ("value", pa.string()), ("units", pa.int64()), ("bytes", pa.int64()), ("ends", splits.END_TYPE)]


class Course:
    """The lexer's way through a split from each of the states in starts (a mask); open is the last semicolon that ended a statement."""

    __slots__ = ("starts", "state", "open", "parts")

    def __init__(self, state: int):
        self.starts, self.state, self.open, self.parts = 1 << state, state, -1, []

    def read(self, line: str, semicolons: int) -> Iterator[tuple[int, str]]:
        """(open, text) of the statements that end on the line; semicolons: how many the split has before it, of whatever kind."""
        at, kept, counted, n = len(line) - len(line.lstrip()), [], 0, semicolons
        while at < len(line):
            if self.state != PLAIN:
                end = line.find(CLOSED_BY[self.state], at)
                if end < 0:
                    break
                at, self.state = end + 2, PLAIN
                kept.append(" ")
                continue
            mark = _mark.search(line, at)
            if not mark:
                kept.append(line[at:])
                break
            kept.append(line[at:mark.start()])
            at = mark.end()
            if mark[0] == "//":
                break
            if mark[0] in ("/*", "(*"):
                self.state = COMMENT if mark[0] == "/*" else ATTRIBUTE
            elif mark[0] == ";":
                n += line.count(";", counted, at)
                counted = at
                yield self.open, " ".join([*self.parts, "".join(kept)])
                self.open, self.parts, kept = n - 1, [], []
            else:
                kept.append(mark[0])
        if text := "".join(kept).rstrip():
            self.parts.append(text)  # joined by a space, which ends an escaped name


def statements(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, value): statements up to their semicolon, without comments, attributes and endmodule.

    Files of any size are read in splits, once; number grows with a statement's place in its file and is the same whatever the
    splits are. Only statements that cross splits are put together by a shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, courses, n, at, size = None, [], 0, 0, 0

        def ended() -> None:
            ends: list[dict] = [{}] * 3
            for c in courses:
                if c.parts:
                    out.append((*key, c.starts, at, c.open, False, " ".join(c.parts), None, None, None))
                for s in range(3):
                    if c.starts >> s & 1:
                        ends[s] = {"state": c.state, "open": c.open, "held": None, "time": None}
            out.append((*key, 7, None, None, None, None, n, size, ends))

        for split, line in splits.in_splits(batches):
            if split != key:
                if key is not None:
                    ended()
                key, courses, n, at, size = split, [Course(s) for s in range(3)], 0, 0, 0
            for c in courses:
                out.extend((*key, c.starts, at, open_, open_ >= 0, text, None, None, None) for open_, text in c.read(line, n))
            if len(courses) > 1:
                courses = met(courses)
            n, at, size = n + line.count(";"), at + 1, size + len(line.encode()) + 1
            if len(out) >= 20_000:
                yield to_batch(out)
                out.clear()
        if key is not None:
            ended()
        yield to_batch(out)

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows) if rows else [[]] * len(_ROW), _ROW)], [name for name, _ in _ROW])

    schema = f"file string, block long, starts int, at long, open long, whole boolean, value string, units long, bytes long, ends {splits.ENDS}"
    found = settle(splits.lines(spark, path).mapInArrow(run, schema))
    begin = splits.starts(found.where("ends IS NOT NULL").select("file", "block", "units", "bytes", "ends"))
    real = splits.resolved(found.where("ends IS NULL"), begin)
    number = F.when(F.col("open") >= 0, F.col("units_before") + F.col("open")).otherwise(F.col("begin_open")) + 1
    real = real.select("file", number.alias("number"), "whole", "value", "bytes_before", "at")
    pieces = real.where("NOT whole").groupBy("file", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bytes_before", "at", "value"))), lambda x: x["value"]), " ").alias("value"))  # a statement
    every = real.where("whole").select("file", "number", "value").unionByName(pieces)
    clean = F.trim(F.regexp_replace(F.regexp_replace("value", r"\bendmodule\b", " "), r"[\t\r ]+$", " "))
    return every.withColumn("value", clean).where("value <> ''")


def met(courses: list[Course]) -> list[Course]:
    """The courses, those that are the same from now on as one."""
    out: list[Course] = []
    for c in courses:
        twin = next((x for x in out if (x.state, x.open) == (c.state, c.open) and x.parts == c.parts), None)
        if twin is None:
            out.append(c)
        else:
            twin.starts |= c.starts
    return out


def statement_kind(value: Column) -> Column:
    first = names.first_token(value)
    return F.when(first.isin(*NET_KINDS), "net").when(first.isin(*KEYWORDS), "other").otherwise("instance")


def nets(rows: DataFrame) -> DataFrame:
    """(kind, name, high, low) of net declarations (value); a net without a range has high = low = 0."""
    pattern = r"^\s*(\w+)\s+(?:(?:wire|reg)\s+)?(?:\[\s*(-?\d+)\s*:\s*(-?\d+)\s*\]\s*)?(.*)$"
    g = [F.regexp_extract("value", pattern, i) for i in (1, 2, 3, 4)]
    found = rows.where(statement_kind(F.col("value")) == "net").select(g[0].alias("kind"), *[F.coalesce(F.when(x != "", x).cast("int"), F.lit(0)).alias(n) for x, n in ((g[1], "high"), (g[2], "low"))], F.explode(F.split(g[3], ",")).alias("name"))
    return found.withColumn("name", F.ltrim("name")).where(F.trim("name") != "")


def wires(declared: DataFrame) -> DataFrame:
    """(wire, base, bit): one row for each bit; a net without a range is one wire of its own name."""
    one = (F.col("high") == 0) & (F.col("low") == 0)
    bits = F.sequence(F.least("high", "low"), F.greatest("high", "low"))
    return declared.select("name", one.alias("one"), F.explode(bits).alias("bit")).select(
        F.when(F.col("one"), F.col("name")).otherwise(F.concat("name", F.lit("["), F.col("bit").cast("string"), F.lit("]"))).alias("wire"), F.col("name").alias("base"), "bit")


class Reader:
    """A cursor over the tokens of one statement."""

    def __init__(self, text: str):
        self.tokens, self.at = _token.findall(text), 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, expected: str | None = None) -> str:
        token = self.peek()
        if not token or expected is not None and token != expected:
            raise ValueError(f"{expected or 'a token'} expected, not {token!r}")
        self.at += 1
        return token

    def element(self) -> list[str]:
        """Names of the bits of an expression, highest first: a name with or without a range, a literal, a concatenation."""
        if self.peek() in ("", ")", ","):
            return []
        if self.peek() == "{":
            self.take()
            out = self.element()
            while self.peek() == ",":
                self.take()
                out += self.element()
            self.take("}")
            return out
        name = self.take()
        out = [name]
        while self.peek() == "[":
            self.take()
            first = self.number()
            last = first
            if self.peek() == ":":
                self.take()
                last = self.number()
            self.take("]")
            step = 1 if last >= first else -1
            out = [f"{x}[{i}]" for x in out for i in range(first, last + step, step)]
        return out

    def number(self) -> int:
        sign = -1 if self.peek() == "-" and self.take() else 1
        return sign * int(self.take())

    def connections(self) -> Iterator[tuple[str, list[str]]]:
        """Named (.port(element)) or positional ones, in parentheses."""
        self.take("(")
        place = 0
        while self.peek() != ")":
            if not self.peek():
                raise ValueError("a parenthesis is not closed")
            if self.peek() == ".":
                self.take()
                port = self.take()
                self.take("(")
                yield port, self.element()
                self.take(")")
            else:
                yield str(place), self.element()
            place += 1
            if self.peek() != ")":
                self.take(",")
        self.take(")")


def parse(text: str) -> tuple[str, str, dict[str, str], list[tuple[str, list[str]]]]:
    """(type, instance, parameters, connections) of an instantiation."""
    r = Reader(text)
    kind, params = r.take(), {}
    if r.peek() == "#":
        r.take()
        params = {port: ",".join(value) for port, value in r.connections()}
    instance = r.take()
    return kind, instance, params, list(r.connections())


def connected_bits(text: str | None) -> list[tuple]:
    """(type, instance, params, port, pos, net) of an instantiation's connected bits, the lowest of a port first.

    An unconnected port has a row without a net; a statement that can't be parsed a single one, with its text as type.
    """
    try:
        kind, instance, params, connected = parse(text or "")
    except ValueError:
        return [(text, None, {}, None, None, None)]
    return [row for port, bits in connected for row in [(kind, instance, params, port, i, net) for i, net in enumerate(reversed(bits))] or [(kind, instance, params, port, None, None)]]


PINS = "type string, instance string, params map<string,string>, port string, pos int, net string"


@F.udtf(returnType=PINS)
class Connections:
    """connected_bits() as a table function, for lateral joins: `SELECT p.* FROM statements, LATERAL connections(value) p`."""

    def eval(self, value: str):
        yield from connected_bits(value)


def register(spark: SparkSession, name: str = "connections") -> None:
    """Makes the table function known to SQL."""
    spark.udtf.register(name, Connections)


def instances(rows: DataFrame) -> DataFrame:
    """(type, instance, params, port, pos, net) of instantiations (value): a row for each connected bit, lowest first.

    An unconnected port has a row with a null net; a statement that can't be parsed has its text as type and no instance.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(*row[:2], list(row[2].items()), *row[3:]) for text in batch.column("value").to_pylist() for row in connected_bits(text)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], ["type", "instance", "params", "port", "pos", "net"])

    kinds = [pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int32(), pa.string()]
    return rows.select("value").mapInArrow(run, PINS)


def parsed(found: DataFrame) -> DataFrame:
    """instances(), with an error, raised when rows are computed, for a statement that can't be parsed."""
    wrong = F.raise_error(F.concat(F.lit("not an instantiation: "), F.coalesce("type", F.lit(""))))
    return found.withColumn("instance", F.when(F.col("instance").isNull(), wrong).otherwise(F.col("instance")))


def expand_buses(pins: DataFrame, declared: DataFrame) -> DataFrame:
    """Pins that name a whole bus, as its bits, lowest first, and a port's bits numbered anew; declared is nets()."""
    bus = declared.where("high <> low").select(F.col("name").alias("net"), "high", "low")
    bits = F.posexplode(F.when(F.col("high").isNull(), F.array("net")).otherwise(names.bit_names(F.col("net"), F.col("high"), F.col("low")))).alias("_bit", "net")
    found = pins.join(bus, "net", "left").select(*[c for c in pins.columns if c != "net"], bits)
    place = F.row_number().over(Window.partitionBy("instance", "port").orderBy("pos", "_bit")) - 1  # a port's bits
    return found.withColumn("pos", F.when(F.col("net").isNotNull(), place)).drop("_bit").select(*pins.columns)
