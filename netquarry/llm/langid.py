"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams (1 to 3 characters, words padded by "_"). A document
gets the language whose profile is nearest to its own list by out-of-place distance: the sum, over the document's
n-grams, of how far apart the two ranks are, and a whole profile length for an n-gram that the profile lacks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.llm.common import bounded_batches, slices, strings

PROFILE = 400
#: Rows of each language that the profiles are learned from, about; the choice goes by a hash of the row.
TRAIN_ROWS = 2000
#: More languages than there are codes in ISO 639-3: such a column holds something else.
MAX_LANGUAGES = 8192
UNKNOWN = "und"
PAD = ord("_")


@cache
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as integers, ascending, how often each occurs): the code points of an n-gram in 21 bits each.

    Every run of letters stands between pads; n-grams don't go beyond them.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    is_letter = letters()[codes]
    if not is_letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    after = np.concatenate([[False], is_letter[:-1]])
    c = np.where(is_letter, codes, PAD)[is_letter | after]  # a pad after each run
    c = np.concatenate([[PAD], c, [PAD] if is_letter[-1] else []]).astype(np.int64)
    two = c[:-1] << 21 | c[1:]
    three = (two[:-1] << 21 | c[2:])[c[1:-1] != PAD]
    return np.unique(np.concatenate([c[c != PAD], two, three]), return_counts=True)


def ranked(text: str, most: int = PROFILE) -> np.ndarray:
    """The text's most frequent n-grams, most frequent first, ties by the integer."""
    key, n = gram_counts(text)
    return key[np.argsort(-n, kind="stable")[:most]]


def train(df: DataFrame, id_col: str, text_col: str, lang_col: str, learn: Column, rows: int = TRAIN_ROWS) -> dict[str, dict[int, int]]:
    """language -> {n-gram: rank}, learned from the rows where learn holds and text and language are not null.

    About `rows` rows a language are used, or all if there are fewer; the choice goes by a hash of id and text, so repeated
    rows are chosen together. N-grams that come equally often are ranked by their code points. The result has PROFILE
    entries a language, and is empty if no row can be learned from. More than MAX_LANGUAGES languages are an error.
    """
    bounded_batches(df)
    known = df.where(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = {r.lang: r.n for r in known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in {lang_col}")
    if not sizes:
        return {}
    size = F.create_map(*[x for lang, n in sorted(sizes.items()) for x in (F.lit(lang), F.lit(n))])
    u = F.pmod(F.xxhash64(F.lit("profile"), id_col, text_col), F.lit(1 << 30)) / (1 << 30)
    sample = (
        known.where(u * size[F.col(lang_col)] < rows)  # the texts stay where they are
        .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)

        def merge(found: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
            key, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            return [(key, np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64))]

        for part in slices(batches):
            for lang, text in zip(part.column("lang").to_pylist(), strings(part.column("text"))):
                total[lang].append(gram_counts(text))
                if len(total[lang]) >= 200:
                    total[lang] = merge(total[lang])
        for lang, found in total.items():
            key, n = merge(found)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key), pa.array(n)], ["lang", "gram", "n"])

    counts = sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    out: dict[str, dict[int, int]] = defaultdict(dict)
    for lang, gram, r in counts.withColumn("r", rank).where(F.col("r") < PROFILE).select("lang", "gram", "r").toLocalIterator():
        out[lang][gram] = r
    return dict(sorted(out.items()))


def distances(text: str, grams: np.ndarray, ranks: np.ndarray) -> np.ndarray | None:
    """The out-of-place distance to each profile as a share of the largest possible one; None if there is no letter.

    grams, ascending, are those of all profiles; ranks has a row for each and a column for each profile, -1 where it lacks.
    """
    found = ranked(text)
    if not len(found):
        return None
    at = np.minimum(np.searchsorted(grams, found), len(grams) - 1)
    table = np.where((grams[at] == found)[:, None], ranks[at], -1)
    away = np.abs(table - np.arange(len(found))[:, None])
    return np.minimum(np.where(table < 0, PROFILE, away), PROFILE).sum(0) / (PROFILE * len(found))


def predict(df: DataFrame, profiles: dict[str, dict[int, int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row; score is 1 less the distance to the nearest profile, as a share of the largest.

    A null text, one without a letter, or no profiles at all gives "und" and 0. The first language by name wins a tie.
    Rows are independent, so repeated rows and null ids come out as they came in; an empty table gives an empty one; other
    columns of df are not read. The profiles sent along have PROFILE entries a language.
    """
    bounded_batches(df)
    found = identify(profiles)(F.col(text_col))
    return df.select(F.col(id_col), found.alias("found")).select(id_col, "found.lang_pred", "found.score")


def identify(profiles: dict[str, dict[int, int]]):  # noqa: ANN201
    """A function from a text column to a column struct<lang_pred, score>, for use beside other columns; see predict()."""
    langs = list(profiles)
    grams = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
    table = np.array([[profiles[lang].get(g, -1) for lang in langs] for g in grams.tolist()], np.int64)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            pred, score = [], []
            for part in slices([pa.RecordBatch.from_arrays([column], ["text"])]):
                for text in strings(part.column("text")):
                    d = distances(text, grams, table) if langs else None
                    pred.append(UNKNOWN if d is None else langs[int(d.argmin())])
                    score.append(0.0 if d is None else 1 - float(d.min()))
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # else the optimiser copies it below a filter on its result, and every text is read twice
    return F.arrow_udf(run, "lang_pred string, score double").asNondeterministic()
