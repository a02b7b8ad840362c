"""Ops 11 to 13: against SQL, against plain versions, over odd rows, and their parts."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from netquarry.llm import bitsliced, manifest, mtree
from netquarry.llm.queries import QUERIES, SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, place string, hash string, _row string, rank string, score string"


def texts():
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("ka", "Lo", "mü", "schu") for b in ("na", "RE", "7", "漢", "lu")]
    out = [" ".join(rng.choices(words, weights=range(1, 21), k=rng.randint(0, 60))) for _ in range(400)]
    out += ["kana-kana_kana.kana", "Kİ  x", None, "", " ..,, ", "kana " * 3000, "x" * 20_000, "Kana,Lona;Müna\x00kana\x7fkana"]
    return out + [out[0]] * 150  # a group of copies, a third of all and more


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(6)
    langs = [None, "", "a", "ü", "b", "a", "a"]
    return [(i if i != 17 else None, t, rng.choice(langs), rng.choice([None, "s"]), i if i % 3 else None, *["x"] * 6) for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("search"))
    rng = random.Random(7)
    spark.createDataFrame([*docs, docs[3], docs[3]], DOCS).repartition(5).write.parquet(f"{place}/documents.parquet")
    items = [(i, " ".join(rng.choices(["kana", "LORE", "mü7", "schu漢", "kalu", "absent", "-"], k=rng.randint(1, 9)))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "absent, indeed"), (3, "schulu"), (None, "kana lore"), (23, "x" * 20_000), (0, items[0][1])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    vector = lambda: [rng.gauss(0, 0.1) for _ in range(9)]
    rows = [(i, vector()) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(400)]  # equal vectors
    rows += [(50, rows[2][1]), (50, rows[2][1]), (None, vector()), (2000, None), (2050, [0.1, None]), (2100, [float("nan")] * 9), (2150, [float("inf")]), (2200, []), (2250, [0.5, -0.25]), (2300, [0.0] * 9)]
    spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, _first string").repartition(3).write.parquet(f"{place}/embeddings.parquet")
    return place


def rows_of(relation, columns):
    return sorted((tuple(r[relation.columns.index(c)] for c in columns) for r in relation.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["op11_bitsliced_search", "op12_mtree_search", "op13_merkle_manifest"])
def test_against_sql(spark, folder, tmp_path, name, monkeypatch):
    monkeypatch.setattr(bitsliced, "DOCS_IN_BLOCK", 100)
    monkeypatch.setattr(mtree, "PAGE_ROWS", 64)
    monkeypatch.setattr(mtree, "PAGES_IN_CELL", 2)
    monkeypatch.setattr(mtree, "BLOCKS_IN_CELL", 3)
    QUERIES[name](spark, folder).write.parquet(str(tmp_path / "out"))
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = c.sql(f"SELECT * FROM '{tmp_path}/out/*.parquet'")
    sql = SQL[name]
    if name == "op12_mtree_search":  # shorter vectors count as filled up with zeros
        sql = sql.replace("list_transform(embedding, lambda x: floor(256 * x::DOUBLE))", "list_resize(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)), 9, 0)")
    want = c.sql(sql)
    assert dict(zip(got.columns, map(str, got.types))) == dict(zip(want.columns, map(str, want.types)))
    columns = sorted(got.columns)
    assert rows_of(got, columns) == rows_of(want, columns)


def test_terms_are_cut_alike_in_segments(monkeypatch):
    rng = random.Random(8)
    for _ in range(30):
        text = "".join(rng.choice("aB7 ,é漢\n-") for _ in range(rng.randint(0, 300)))
        whole = Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text)))
        monkeypatch.setattr(bitsliced, "SEGMENT", rng.choice([1, 7, 64, 1 << 20]))
        assert {t.decode(): n for t, n in bitsliced.term_counts(text.encode()).items()} == whole


def test_slices_add_up_and_give_the_best():
    rng = np.random.default_rng(9)
    for n in (1, 64, 130, 1000):
        words = -(-n // 64)
        numbers = []
        for _ in range(7):
            docs = np.flatnonzero(rng.random(n) < 0.4)
            numbers.append((docs, rng.integers(0, 50, len(docs)) * rng.integers(0, 2, len(docs))))
        total = np.zeros(n, np.int64)
        for docs, x in numbers:
            total[docs] += x
        sliced = [bitsliced.sliced(docs, x, words) for docs, x in numbers]
        summed = bitsliced.added([x for x in sliced if len(x)], 10, words)
        order = rng.permutation(n)
        for k in (1, 3, 50, n + 5):
            docs, scores = bitsliced.best(summed, k, order)
            want = sorted((-total[d], order[d]) for d in range(n) if total[d] > 0)[:k]
            assert sorted((-s, order[d]) for d, s in zip(docs, scores)) == want


def test_items_in_passes_give_the_same(spark, folder, monkeypatch):
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(tuple, bitsliced.rank(docs, items, 5).collect()), key=repr)
    monkeypatch.setattr(bitsliced, "PASS_BYTES", 60)
    dealt, n = bitsliced.passes(items.select("item_id", "text"))
    assert n > 1
    monkeypatch.setattr(bitsliced, "CACHE_BYTES", 1)
    assert sorted(map(tuple, bitsliced.rank(docs, items.where("item_id < 4 OR item_id IS NULL"), 5).collect()), key=repr) == [r for r in one if r[0] is None or r[0] < 4]


def test_mtree_prunes_and_keeps_ties(spark):
    """Distances that bounds rule out are not computed, and a bound that is met exactly is not passed over."""
    rng = np.random.default_rng(10)
    centres = rng.normal(0, 200, (8, 16))
    x = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(0, 4, (800, 16))).astype(int)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<long>")
    got = {}
    for r in mtree.top_k(df, "vec_id", "v", F.col("vec_id") % 7 == 0, 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    scores = x @ x.T
    for q in range(0, 800, 7):
        want = sorted(((-scores[q, j], j) for j in range(800) if j != q))[:4]
        assert sorted(got[q]) == [(i + 1, j, -s) for i, (s, j) in enumerate(want)]
    space = mtree.Space(16, int((x * x).sum(axis=1).max()), [x[0].tolist(), x[450].tolist()])
    chosen, node, near = mtree.routers(space, x.astype(float), 16)
    assert all(near[i] == pytest.approx(space.apart(x[i:i + 1].astype(float), x[chosen[node[i]]][None].astype(float))[0, 0], abs=1e-6) for i in range(0, 800, 37))
    far = space.apart(x.astype(float), space.pivots)[:, 0]
    page = mtree.Page(space, mtree.Page.build(space, 0, 0, np.arange(800), np.arange(800), far, x.astype(np.int32)))
    seen = []
    apart = space.apart
    space.apart = lambda a, b, queries=False: (seen.append(len(a) * len(b)), apart(a, b, queries))[1]
    q = mtree.Queries(space, np.array([0]), np.array([0]), x[:1], 4)
    q.search(page)
    assert q.worst[0] == np.sort(scores[0, 1:])[-4] and sum(seen) == 2 + len(page.radius)
    # with a bound that nothing meets, stored distances rule all nodes out, and only those to the pivots are computed
    seen.clear()
    bounded = mtree.Queries(space, np.array([0]), np.array([0]), x[:1], 1, [[(int(scores[0].max()) + 10**6, 0, 0)]])
    bounded.search(page)
    assert sum(seen) == 2 and not bounded.found[0]
    with pytest.raises(ValueError, match="squared norms"):
        mtree.top_k(spark.createDataFrame([(1, [1 << 26])], "vec_id long, v array<long>"), "vec_id", "v", F.lit(True)).collect()


@pytest.mark.parametrize("sizes", [[1], [1, 1, 1], [8, 9, 1], [4096, 4097, 70, 1, 5]])
def test_manifest_at_edges_of_blocks(spark, sizes):
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [(g, i, digest(f"{g} {i}")) for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, i int, leaf string").repartition(3)
    trees = []
    for g, n in enumerate(sizes):
        level = [x for h, _, x in rows if h == g]
        while len(level) > 1:
            level = [digest("".join(level[k:k + 8])) for k in range(0, len(level), 8)]
        trees.append(level[0])
    root = list(trees)
    while len(root) > 1:
        root = [digest("".join(root[k:k + 8])) for k in range(0, len(root), 8)]
    found = manifest.manifest(df, "g", "i").withColumn("folded", manifest.folded(F.col("leaf"), F.col("lefts"), F.col("rights"))).cache()
    assert found.count() == len(rows) and {(r.g, r.subroot) for r in found.select("g", "subroot").distinct().collect()} == set(enumerate(trees))
    assert {(r.root, r.folded) for r in found.select("root", "folded").distinct().collect()} == {(root[0], root[0])}
    height = math.ceil(math.log(len(sizes), 8)) + max(math.ceil(round(math.log(n, 8), 9)) for n in sizes)
    assert found.agg(F.max(F.size("lefts"))).first()[0] == height
