"""Very long texts, nulls, repeated rows, clashing column names and other id types, for operators and stages."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netquarry.llm import langid, line_dedup, mixing, quality, simhash, token_counts, warc, weighted_sampling
from netquarry.llm.common import cut_lineage

CLASHING = ["_found", "_copies", "_row", "_all", "k1", "k2", "ordinal", "file", "begin", "end", "damaged", "_place", "_bad", "size", "target", "blocks", "fp", "node", "component_id", "lang_pred", "found", "extra", "kept", "keep"]


def wide(spark, rows, schema):
    """The rows with columns that are called like those that operators add."""
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame(rows, schema).select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING if c not in names])


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    random.seed(14)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "schu") for b in ("na", "re", "ti", "vo", "lu")]
    rows = [(i, "\n".join(" ".join(random.choices(words, k=12)) for _ in range(4)), "aa", f"s{i % 3}", 1) for i in range(30)]
    rows.append((40, " ".join(random.choices(words, k=60_000)), "aa", "s1", 1))
    rows.append((41, "\n".join(random.choices(words, k=30_000)), "aa", "s2", 1))
    return [*rows, rows[3], rows[3], (None, rows[4][1] + " ka", None, None, None), (50, None, None, "s0", None), (51, "", "aa", "s0", 0)]


def test_stages_with_clashing_columns_and_long_texts(spark):
    plain, clashing = spark.createDataFrame(documents(), DOCS), wide(spark, documents(), DOCS)
    for name, stage in corpus_pipeline.STAGES:
        found = [sorted(map(repr, cut_lineage(stage(spark, df, "")).collect())) for df in (plain, clashing)]
        assert found[0] == found[1] and found[0], name
        if name != corpus_pipeline.STAGES[-1][0]:
            plain = cut_lineage(stage(spark, plain, ""))
            clashing = plain.select("*", *[F.lit(1).alias(c) for c in CLASHING])
    assert max(len(r.ids) for r in stage(spark, plain, "").select("ids").collect()) > 60_000


def test_operators_with_clashing_columns_and_long_texts(spark):
    plain, clashing = spark.createDataFrame(documents(), DOCS), wide(spark, documents(), DOCS)
    profiles = langid.train(plain, "doc_id", "text", "lang", F.lit(True))
    model, weights = quality.fit(clashing)
    for f in (
        lambda df: simhash.near_duplicates(df), lambda df: langid.predict(df, profiles), lambda df: mixing.mix(df), lambda df: quality.score(df, model, weights),
        lambda df: line_dedup.apply(df, line_dedup.bitmaps(df)).select("doc_id", "n_lines", "n_dropped", F.md5("kept")), lambda df: weighted_sampling.with_edits(df),
    ):
        rows = f(clashing).collect()
        assert sorted(map(repr, rows)) == sorted(map(repr, f(plain).collect())) and len(rows) == len(documents())


@pytest.mark.parametrize("kind", ["string", "int", "decimal(10,0)"])
def test_other_types_of_ids(spark, kind):
    df = spark.createDataFrame(documents(), DOCS).select(F.col("doc_id").cast(kind).alias("doc_id"), "text", "source")
    mixed = mixing.mix(df)
    assert mixed.schema["doc_id"].dataType == df.schema["doc_id"].dataType and mixed.count() == df.count()
    assert line_dedup.apply(df, line_dedup.bitmaps(df)).count() == df.count()
    if kind == "int":
        assert weighted_sampling.with_edits(df).count() == df.count()
    else:
        with pytest.raises(TypeError, match="integers"):
            weighted_sampling.with_edits(df)


def test_quality_of_patterns_that_were_not_fitted(spark):
    good = "the small house stands near a river where people walk along every calm morning and evening of the year"
    fitted = spark.createDataFrame([(i, f"{good} {i}") for i in range(8)], "doc_id long, text string")
    model, weights = quality.fit(fitted)
    rows = [(1, "!!! $$$ ### ??? !!! $$$ ### ??? !!! $$$ ### ???"), (2, None), (3, good), (4, "NO NO NO NO NO NO NO NO NO NO NO NO NO NO NO NO NO NO NO NO NO NO")]
    got = {r.doc_id: r for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), model, weights).collect()}
    assert all(0 <= r.posterior <= 1 and 0 <= r.score <= 1 for r in got.values()) and got[1].posterior < got[3].posterior
    empty, zero = quality.fit(fitted.where("false"))
    assert not zero.any() and quality.score(fitted, empty, zero).select("posterior").distinct().first()[0] == pytest.approx(0.5)


def test_audit_of_missing_and_extra_records(spark):
    rows = [(i, f"http://{i}", "x" * (i % 7)) for i in range(40)]
    pages = wide(spark, [(*r, "mine") for r in rows], "page_id long, url string, html string, damaged string")
    read = pages.select("page_id", "url", "damaged", "size", warc.record(F.col("url"), F.col("html")).alias("record"))
    listed = cut_lineage(warc.manifest(read, "record", "page_id"))
    replica = listed.select("ordinal", "sha256", (F.col("end") - F.col("begin")).alias("bytes"))
    same = warc.audit(listed, replica.unionByName(replica.limit(3)))  # repeated rows of a replica
    assert same.where("damaged").count() == 0 and same.count() == 40
    more = spark.createDataFrame([(40, "ab", 2), (300, "cd", 1), (None, "ef", 5)], "ordinal long, sha256 string, bytes long")
    changed = replica.where("ordinal <> 17").withColumn("sha256", F.when(F.col("ordinal") == 5, "00").otherwise(F.col("sha256"))).withColumn("bytes", F.col("bytes") + F.when(F.col("ordinal") == 9, 1).otherwise(0))
    got = warc.audit(listed, changed.unionByName(more)).collect()
    assert sorted(r.ordinal for r in got if r.damaged) == [5, 9, 17, 40, 300] and len(got) == 42
    assert {r.ordinal for r in got if r.page_id is None} == {40, 300}
    nothing = listed.where("false")
    assert warc.audit(nothing, replica.where("false")).count() == 0 and warc.audit(nothing, more).where("damaged").count() == 2
    assert warc.audit(listed, replica.where("false")).where("damaged").count() == 40
    long = spark.createDataFrame([(1, "u", "y" * 3_000_000), (2, None, None), (1, "u", "y" * 3_000_000)], "page_id long, url string, html string")
    kept = warc.manifest(long.select("page_id", warc.record(F.col("url"), F.col("html")).alias("record")), "record", "page_id").collect()
    assert sorted(r.ordinal for r in kept) == [0, 1, 2] and max(r.end for r in kept) > 6_000_000


def test_long_words_are_not_remembered():
    import public_tokenizers as P

    with open(P.path("word_bpe_49k.json"), "rb") as f:
        bpe = token_counts.WordBpe(f.read())
    assert bpe.count("a" * 4000) > 1 and bpe.count("word") >= 1
    assert max(map(len, bpe)) < 100 and max(map(len, bpe.written)) < 100


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Frame:
        class sparkSession:  # noqa: N801
            conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint.dir"):
        cut_lineage(Frame())
