"""Value change dumps of any size: commands, declarations and value changes, the same whatever the splits are."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netquarry.operators.tables import settle
from netquarry.sources import splits

#: Variable types whose changes are tracked, and those that are passed over (fixed values).
TRACKED = ("supply0", "supply1", "tri", "triand", "trior", "trireg", "tri0", "tri1", "wand", "wire", "wor", "reg")
IGNORED = ("event", "integer", "parameter", "real", "time")
#: Commands whose bodies are value changes; all other ones have text up to their $end (fixed values).
SIMULATION = ("$dumpall", "$dumpoff", "$dumpon", "$dumpvars")
#: States of the lexer: between commands, in the text of one, after a vector's or real's value that waits for its code.
PLAIN, TEXT, VALUE = range(3)
#: Words of a text that are kept together, and rows that a task holds.
WORDS, ROWS = 10_000, 50_000
_ROW = [
    ("file", pa.string()), ("block", pa.int64()), ("starts", pa.int32()), ("kind", pa.string()), ("at", pa.int64()), ("open", pa.int64()), ("line", pa.int64()), ("t", pa.int64()), ("word", pa.string()), ("value", pa.string()),
    ("units", pa.int64()), ("bytes", pa.int64()), ("ends", splits.END_TYPE)]


class Course:
    """The lexer's way through a split, from each of the states in starts (a mask)."""

    __slots__ = ("starts", "state", "time", "open", "held", "words")

    def __init__(self, state: int):
        self.starts, self.state, self.time, self.open, self.held, self.words = 1 << state, state, None, -1, None, []

    def same(self, other: Course) -> bool:
        return (self.state, self.time, self.open) == (other.state, other.time, other.open)

    def read(self, token: str, at: int) -> Iterator[tuple]:
        """(kind, open, word, value) of what the token ends. A text that was open before the split is left to texts()."""
        if self.state == TEXT:
            if token == "$end":
                yield from self.text()
                self.state, self.open, self.held = PLAIN, -1, None
            elif self.open >= 0:
                self.words.append(token)
                if len(self.words) == WORDS:
                    yield from self.text()
        elif self.state == VALUE:
            yield "change", self.open, token, self.held
            self.state, self.open, self.held = PLAIN, -1, None
        elif token[0] == "$":
            if token in SIMULATION:
                yield "simulation", at, token, None
            elif token != "$end":
                self.state, self.open, self.held = TEXT, at, token
        elif token[0] == "#" and token[1:].isdigit():
            self.time = int(token[1:])
            yield "time", at, None, None
        elif token[0] in "bBrR":
            self.state, self.open, self.held = VALUE, at, token
        elif token[0] in "01xXzZ" and len(token) > 1:
            yield "change", at, token[1:], token[0]
        else:
            yield "unknown", at, token, None

    def text(self) -> Iterator[tuple]:
        if self.state == TEXT and self.open >= 0 and (self.words or self.held):
            yield "text", self.open, self.held, " ".join(self.words)
            self.words, self.held = [], None  # the command's word goes with its first words


def scanned(rows: DataFrame) -> DataFrame:
    """What the splits of lines() say, in one pass and constant memory: a row for each command and state, and a summary of each split.

    at, open: numbers of tokens in the split; line: the bytes of the split before the line.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, courses, asleep, at, size = None, [], None, 0, 0

        def ended() -> None:
            by_state: list[dict] = [{}] * 3
            for c in [*courses, *([asleep] if asleep else [])]:
                out.extend((*key, c.starts, *row[:1], at, row[1], size, c.time, *row[2:], None, None, None) for row in c.text())
                for s in range(3):
                    if c.starts >> s & 1:
                        by_state[s] = {"state": c.state, "open": c.open, "held": c.held, "time": c.time}
            out.append((*key, 7, "split", None, None, None, None, None, None, at, size, by_state))

        for split, line in splits.in_splits(batches):
            if split != key:
                if key is not None:
                    ended()
                # a course that begins within a text wakes up at its $end
                key, courses, asleep, at, size = split, [Course(PLAIN), Course(VALUE)], Course(TEXT), 0, 0
            tokens = line.split()
            wakes = asleep is not None and "$end" in tokens
            for token in tokens:
                for c in courses:
                    for kind, open_, word, value in c.read(token, at):
                        out.append((*key, c.starts, kind, at, open_, size, c.time, word, value, None, None, None))
                if wakes and token == "$end":
                    asleep.state, wakes = PLAIN, False
                    courses.append(asleep)
                    asleep = None
                if len(courses) > 1:
                    courses = met(courses)
                at += 1
            size += len(line.encode()) + 1
            if len(out) >= ROWS:
                yield to_batch(out, _ROW)
                out.clear()
        if key is not None:
            ended()
        yield to_batch(out, _ROW)

    return rows.mapInArrow(run, f"file string, block long, starts int, kind string, at long, open long, line long, t long, word string, value string, units long, bytes long, ends {splits.ENDS}")


def met(courses: list[Course]) -> list[Course]:
    """The courses, those that are the same from now on as one."""
    out: list[Course] = []
    for c in courses:
        twin = next((x for x in out if x.same(c)), None)
        if twin is None:
            out.append(c)
        else:
            twin.starts |= c.starts
    return out


def to_batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], [n for n, _ in kinds])


def texts(rows: DataFrame, begin: DataFrame) -> DataFrame:
    """(file, open, block, at, value): of the splits that begin within a command's text what is left of it there, up to its $end; at numbers its lines."""
    inside = begin.where(F.col("state") == TEXT).select("file", "block", "open")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("file", pa.string()), ("open", pa.int64()), ("block", pa.int64()), ("at", pa.int64()), ("value", pa.string())]
        key, done, out = None, False, []
        for batch in batches:
            for file, block, value, open_ in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value", "open"))):
                if (file, block) != key:
                    key, done, n = (file, block), False, 0
                if not done:
                    words = (value or "").split()
                    done = "$end" in words
                    out.append((file, open_, block, n, " ".join(words[:words.index("$end")] if done else words)))
                    n += 1
            yield to_batch(out, kinds)
            out = []

    # splits are matched by a filter on the scan's side: the order of a split's lines stays
    return rows.join(F.broadcast(inside), ["file", "block"]).mapInArrow(run, "file string, open long, block long, at long, value string")


def commands(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """(file, seq, kind, t, word, value): every command of all dumps at a path.

    kind is declaration (word: the keyword, value: its text, with single spaces), simulation (word: the keyword), time, change
    (word: the code, value: with its letter, if it is a vector or a real) or unknown. seq is the number of the command's first token in the file, and so
    the same whatever the splits are; t the time that holds. With max_bytes commands on lines that begin so many bytes after
    the file's beginning are left out, and splits that lie there aren't lexed. The dump is scanned once; once more if splits
    begin within a declaration or comment, whose rest is then read. Comments and white space are free, also between a
    vector's value and its code.
    """
    rows = splits.lines(spark, path)
    if max_bytes is not None:
        rows = rows.where(F.col("block") < max_bytes)
    found = settle(scanned(rows))
    begin = splits.starts(found.where("kind = 'split'").select("file", "block", "units", "bytes", "ends"), time=0)
    real = splits.resolved(found.where("kind <> 'split'"), begin)
    if max_bytes is not None:
        real = real.where(F.col("line") + F.col("bytes_before") < max_bytes)
    seq = F.when(F.col("open") >= 0, F.col("units_before") + F.col("open")).otherwise(F.col("begin_open"))
    real = real.select("file", seq.alias("seq"), "kind", F.coalesce("t", "begin_time").alias("t"), "word", F.when((F.col("kind") == "change"), F.coalesce("value", "begin_held")).otherwise(F.col("value")).alias("value"), "block", "at")
    pieces = real.where("kind = 'text'")
    if not begin.where(F.col("state") == TEXT).isEmpty():
        rest = texts(rows, begin).select("file", F.col("open").alias("seq"), F.lit("text").alias("kind"), F.lit(None).cast("long").alias("t"), F.lit(None).cast("string").alias("word"), "value", "block", "at")
        pieces = pieces.unionByName(rest)
    whole = pieces.groupBy("file", "seq").agg(  # a command's text
        F.min("t").alias("t"), F.max("word").alias("word"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: F.nullif(x["value"], F.lit(""))), " ").alias("value"))
    declared = whole.where("word IS NOT NULL").select("file", "seq", F.lit("declaration").alias("kind"), "t", "word", "value")
    return real.where("kind <> 'text'").select(*declared.columns).unionByName(declared)


def headers(found: DataFrame) -> DataFrame:
    """(file, code, signal, width, low): the tracked variables of commands(); of several of one code the first counts.

    The two outermost scopes are left out of names, which are joined by "/". A dump's scopes are walked by one task, its
    variables are sorted by their place among them.
    """
    def scoped(rows: pa.Table) -> pa.Table:
        rows, path, out = rows.sort_by("seq").to_pylist(), [], []
        for row in rows:
            if row["word"] == "$scope":
                path.append((row["value"] or "").split()[-1])
            elif path:
                path.pop()
            out.append({"file": row["file"], "seq": row["seq"], "prefix": "".join(f"{p}/" for p in path[2:])})
        return pa.Table.from_pylist(out, schema=pa.schema([("file", pa.string()), ("seq", pa.int64()), ("prefix", pa.string())]))

    declared = found.where("kind = 'declaration'")
    scopes = declared.where(F.col("word").isin("$scope", "$upscope")).select("file", "seq", "word", "value").groupBy("file").applyInArrow(scoped, "file string, seq long, prefix string")
    part = lambda i: F.regexp_extract("value", r"^(\w+) (\d+) (\S+) (\\\S+|[^\s\[]+) ?(?:\[ ?(-?\d+) ?(?:: ?(-?\d+) ?)?\])?", i)
    number = lambda i: F.when(part(i) != "", part(i).cast("int"))
    variables = declared.where((F.col("word") == "$var") & part(1).isin(*TRACKED)).select(
        "file", "seq", F.lit(None).cast("string").alias("prefix"), part(3).alias("code"), part(4).alias("name"), part(2).cast("int").alias("width"), F.coalesce(F.least(number(5), number(6)), F.lit(0)).alias("low"))
    inside = F.coalesce(F.last("prefix", ignorenulls=True).over(Window.partitionBy("file").orderBy("seq")), F.lit(""))
    placed = variables.unionByName(scopes, allowMissingColumns=True).withColumn("signal", F.concat(inside, "name")).where("code IS NOT NULL")
    first = placed.groupBy("file", "code").agg(F.min_by(F.struct("signal", "width", "low"), "seq").alias("v"))
    return first.select("file", "code", "v.*")


def extended(digits: Column, width: Column) -> Column:
    """A vector's bits at full width, lowest first: x and z go on, other digits get zeros; digits beyond the width are cut."""
    value = F.lower(digits)
    first = F.substring(value, 1, 1)
    fill = F.when(first.isin("x", "z"), first).otherwise("0")
    return F.substring(F.reverse(F.concat(F.repeat(fill, F.greatest(width - F.length(value), F.lit(0))), value)), F.lit(1), width)


def changed(found: DataFrame) -> DataFrame:
    """(file, signal, bit, t, seq, v): the value changes of commands(), bit by bit; reals and untracked codes are passed over.

    A vector's value is made as wide as its variable: x and z go on, other digits get zeros.
    """
    digits = F.regexp_replace("value", "^[bB]", "")
    vectors = found.where((F.col("kind") == "change") & ~F.lower(F.substring("value", 1, 1)).isin("r")).select("file", "seq", "t", F.col("word").alias("code"), digits.alias("value"))
    known = vectors.join(headers(found), ["file", "code"])
    bits = F.posexplode(F.slice(F.split(extended(F.col("value"), F.col("width")), ""), 1, F.col("width"))).alias("at", "v")
    return known.select("file", "signal", "t", "seq", "low", bits).select("file", "signal", (F.col("low") + F.col("at")).alias("bit"), "t", "seq", "v")


def read(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """(file, signal, bit, t, seq, v) of all dumps at a path, read in splits; see commands() for max_bytes."""
    return changed(settle(commands(spark, path, max_bytes)))


def dumpvars(signals: DataFrame) -> DataFrame:
    """(value): a $dumpvars statement for each signal."""
    return signals.select(F.format_string("$dumpvars(0, %s);", "signal").alias("value"))
