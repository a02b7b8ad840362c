"""Every stage of the pipeline on its own input against a brute-force version, and the queries that have SQL."""

import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import public_tokenizers as P
import pytest
import sentencepiece

import corpus_pipeline
from netquarry.llm import queries
from netquarry.llm.common import cut_lineage

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return [tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()]


def sample(n=160):
    random.seed(12)
    sounds = {"aa": "ka lo mi nu pe".split(), "bb": "sch üb ing auf ver".split()}
    out = []
    for i in range(n):
        lang = "ab"[i % 2] * 2
        words = ["".join(random.choices(sounds[lang], k=random.randint(2, 5))) for _ in range(random.randint(30, 120))]
        text = "\n".join(" ".join(words[k:k + 20]) for k in range(0, len(words), 20)) + "\nfollow us on every page"
        out.append((i, text, lang if i % 9 else None, f"s{i % 3}", len(text)))
    copy = out[10][1].split("\n")
    out += [(1000 + k, out[4][1], "aa", "s1", 1) for k in range(3)]  # exact copies
    out += [(1100, "\n".join(["changed " + copy[0], *copy[1:]]), "aa", "s2", 1)]
    out += [(1200, None, "aa", "s0", None), (1201, "", None, None, 0), (1202, "123 !!!", "aa", "s0", 7), (1203, "漢字 かな", None, "s0", 5), (None, out[5][1] + " kalo", "bb", "s0", 1)]
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text))


def jaccard(a, b):
    a, b = ({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in map(words, (a, b)))
    return len(a & b) / len(a | b)


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(sample(), SCHEMA)
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == [name for name, _ in corpus_pipeline.STAGES] and len(stage) == 5
    run = lambda name, df: cut_lineage(stage[name](spark, df, str(tmp_path)))

    one = run("language ID", docs)
    gone = {r[0] for r in sample()} - {r[0] for r in rows_of(one)}
    assert gone == {1200, 1201, 1202, 1203}
    assert {r[0]: r[2] for r in rows_of(one)} == {r[0]: r[2] or ("aa" if r[0] % 2 == 0 else "bb") for r in sample() if r[0] not in gone}

    two = run("line dedup", one)
    held, first = defaultdict(set), set()
    for r in rows_of(one):
        for line in r[1].split("\n"):
            held[line.strip(" \t\n\v\f\r").lower()].add(r[0])
    common = {k for k, v in held.items() if k and len(v) >= 10}
    assert common == {"follow us on every page"}
    kept = {r[0]: r[1] for r in rows_of(two)}
    for i, text, *_ in rows_of(one):
        stay = "\n".join(x for x in text.split("\n") if x.lower() not in common)
        if kept[i] != stay:
            assert kept[i] == text
            first.add(i)
    assert len(first) == 1 and all(r[4] == len(r[1]) for r in rows_of(two))

    three = run("SimHash near-dedup", two)
    stayed = {r[0] for r in rows_of(three)}
    texts = {r[0]: r[1] for r in rows_of(two)}
    ids = sorted(texts, key=lambda i: (i is None, i or 0))
    parent = {i: i for i in ids}
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if jaccard(texts[i], texts[j]) >= 0.8 and parent[i] == i:
                parent[i] = parent[j]
    assert stayed == {i for i in ids if parent[i] == i} and {1000, 1001, 1002, 1100, None} & stayed == set()

    four = run("mixing sources to target weights", three)
    size = Counter()
    for r in rows_of(three):
        size[r[3]] += len(r[1].split())
    got, times = Counter(), Counter(r[0] for r in rows_of(four))
    for r in rows_of(four):
        got[r[3]] += len(r[1].split())
    assert max(times.values()) <= 2 and set(rows_of(four)) <= set(rows_of(three))
    share, target = 1.5 * sum(size.values()) / 6, {}
    for s, w in zip(sorted(size), (3, 1, 2)):
        target[s] = min(2 * size[s], w * share)
    over = 1.5 * sum(size.values()) - sum(target.values())
    free = [s for s in target if target[s] < 2 * size[s]]
    weight = dict(zip(sorted(size), (3, 1, 2)))
    for s in free:
        target[s] += over * weight[s] / sum(weight[x] for x in free)
    assert all(abs(got[s] - target[s]) <= 150 for s in size)

    five = run("SentencePiece encoding and decoding", four)
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = sorted((r[0], library.encode(r[1], add_eos=True)) for r in rows_of(four))
    assert sorted((r.doc_id, list(r.ids)) for r in five.collect()) == want


def test_encoding_gives_ends_and_decoded_text(spark):
    docs = spark.createDataFrame([(1, "Hello  world", "en", "s", 12), (2, "naïve café", "en", "s", 10), (3, None, None, "s", 0)], SCHEMA)
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for r in corpus_pipeline.encoding(spark, docs, "").collect():
        text = {1: "Hello  world", 2: "naïve café", 3: ""}[r.doc_id]
        assert r.decoded == library.decode(library.encode(text)) and len(r.ends) == len(r.begins) == r.n_tokens and r.ends[-1] == len(text.encode())


def test_empty_documents(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        df = cut_lineage(stage(spark, df, str(tmp_path)))
    assert df.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, tmp_path, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    queries.QUERIES[name](spark, SF).write.parquet(str(tmp_path / "out"))
    got, want = duck.sql(f"SELECT * FROM '{tmp_path}/out/*.parquet'"), duck.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert dict(zip(got.columns, map(str, got.types))) == dict(zip(want.columns, map(str, want.types)))
    rows = lambda r: sorted((tuple(row[r.columns.index(c)] for c in columns) for row in r.fetchall()), key=repr)
    assert rows(got) == rows(want)
