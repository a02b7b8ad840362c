import os
import random
import re

import numpy as np
import pytest

from netquarry.llm import near_copies as N

SCHEMA = "doc_id long, text string, node string, key string, set1 string"
SF = "/root/testdata/sf0.01/documents.parquet"


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def shingle_set(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """id -> smallest id reachable, all pairs compared."""
    sets = [shingle_set(text) for _, text in rows]
    name = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if name[i] != name[j] and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
                both = len(a & b)
                if 5 * both >= 4 * (len(a) + len(b) - both):
                    x, y = sorted((name[i], name[j]))
                    name = [x if n == y else n for n in name]
    low = {}
    for n, (i, _) in zip(name, rows):
        low[n] = min((x for x in (low.get(n), i) if x is not None), default=None)
    return [(i, low[n]) for n, (i, _) in zip(name, rows)]


def key(row):
    return tuple((x is not None, x or 0) for x in row)


def planted(n=60, seed=4):
    """Texts, copies of them with few and with many words changed, and groups of dense near copies."""
    random.seed(seed)
    vocabulary = [f"{a}{b}" for a in ("ka", "Lo", "mi", "nü", "pe") for b in range(90)]
    rows = []
    for _ in range(n):
        text = random.choices(vocabulary, k=random.randint(3, 260))
        rows.append(" ".join(text))
        for changes in (0, 1, 2, 5, 9):
            copy = list(text)
            for _ in range(changes):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            rows.append("\t".join(copy))
    dense = random.choices(vocabulary, k=150)
    for k in range(150):  # all near the first, hardly any as near to another
        copy = list(dense)
        for _ in range(k % 4):
            copy[random.randrange(len(copy))] = f"own{k}"
        rows.append(" ".join(copy))
    random.shuffle(rows)
    return list(enumerate(rows))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", None, "y") for i, t in rows], SCHEMA)


@pytest.mark.parametrize(("partitions", "block_rows", "block_shingles"), [(4, 4096, 1 << 20), (1, 16, 900), (64, 16, 2500), (64, 4096, 1 << 20)])
def test_against_brute_force(spark, partitions, block_rows, block_shingles):
    rows = planted()
    want = brute(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = N.near_copies(frame(spark, rows).repartition(3), block_rows=block_rows, block_shingles=block_shingles).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, got)) == want and 60 < len({c for _, c in want}) < len(rows) / 2


def test_odd_rows(spark):
    """Nulls, texts without words, of a few words and very long ones, repeated rows, null ids, and the same words in another order."""
    random.seed(8)
    vocabulary = [f"w{i}" for i in range(200)]
    orders = [" ".join(vocabulary + random.choices(vocabulary, k=900)) for _ in range(6)]
    long = " ".join(random.choices(vocabulary, k=30_000))
    rows = [(i, x) for i, x in enumerate(orders)]
    rows += [(10, None), (11, ""), (12, " \n\t"), (13, "One two"), (14, "one  TWO"), (15, "two one"), (16, "a b c d"), (17, "a b c d e"), (18, "É a"), (19, "é a")]
    rows += [(20, long), (21, long + " w1 w2"), (22, orders[3] + " w9"), (22, orders[3] + " w9"), (None, "one two"), (None, "only null ids have this"), (None, "only NULL ids have this")]
    assert sorted(map(tuple, N.near_copies(frame(spark, rows)).collect()), key=key) == sorted(brute(rows), key=key)
    kept = {r.doc_id for r in N.smallest(frame(spark, rows)).collect()}
    assert kept == {0, 1, 2, 3, 4, 5, 10, 13, 15, 16, 17, 18, 19, 20, None}
    assert N.near_copies(frame(spark, [])).count() == 0 and N.smallest(frame(spark, [])).count() == 0
    by_name = spark.createDataFrame([("b", "one two three"), ("a", "one two three"), ("c", None)], "name string, body string")
    assert sorted(map(tuple, N.near_copies(by_name, "name", "body").collect())) == [("a", "a"), ("b", "a"), ("c", "c")]


def test_shingles_and_sketches():
    text = b"The Quick brown fox\tJumps over the lazy dog the quick BROWN fox jumps over"
    assert len(N.shingles(text)) == len(shingle_set(text.decode())) < len(text.split()) - 4
    assert len(N.shingles(b" \n")) == 0 and len(N.shingles(b"a b")) == 1
    assert N.shingles(b"a b")[0] != N.shingles(b"b a")[0]
    h = N.shingles(b" ".join(b"w%d" % (i * i % 7919) for i in range(20_000)))
    bits = np.unpackbits(N.spread(h[:, None] + N._steps).view(np.uint8), axis=1, bitorder="little").sum(0)
    assert (np.unpackbits(N.sketch(h).view(np.uint8), bitorder="little") == (bits * 2 > len(h))).all()
    assert (N.buckets(h) == N.buckets(h[::-1])).all() and len(set(N.buckets(h).tolist())) == N.BANDS


def flip(x, k):
    return x ^ sum(1 << b for b in random.sample(range(256), k))


def joined(n, links):
    name = list(range(n))
    for u, v in links:
        a, b = sorted((name[u], name[v]))
        name = [a if x == b else x for x in name]
    return name


def test_sketches_are_compared_as_by_brute_force():
    random.seed(3)
    made = [flip(f, random.randint(0, 61)) for f in (random.getrandbits(256) for _ in range(40)) for _ in range(random.randint(1, 12))]
    sketches = np.array([[x >> 64 * i & (1 << 64) - 1 for i in range(4)] for x in made], np.uint64)
    near = [(i, j) for i in range(len(made)) for j in range(i) if (made[i] ^ made[j]).bit_count() <= N.RADIUS]
    want = joined(len(made), near)
    assert joined(len(made), N.large_links(sketches)) == want and 1 < len(set(want)) < len(made)
    sizes = np.array([5, 2, len(made) - 30, 23])
    starts = np.cumsum(sizes) - sizes
    group = np.repeat(np.arange(4), sizes)
    assert joined(len(made), N.small_links(sketches, starts, sizes)) == joined(len(made), [(i, j) for i, j in near if group[i] == group[j]])


def test_sets_are_compared_as_by_brute_force():
    random.seed(6)
    sets = []
    for _ in range(40):
        base = random.sample(range(4000), random.randint(1, 60))
        sets += [np.unique(np.array([x if random.random() > p else random.randrange(4000) for x in base], np.uint64)) for p in (0, 0, 0.03, 0.08, 0.2)]
    sets += [np.zeros(0, np.uint64), np.arange(10, dtype=np.uint64), np.arange(8, dtype=np.uint64), np.arange(7, dtype=np.uint64)]
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a) and 5 * (x := len({*a.tolist()} & {*b.tolist()})) >= 4 * (len(a) + len(b) - x)]
    assert joined(len(sets), N.jaccard_links(sets)) == joined(len(sets), near)
    assert N.jaccard_links(sets[-4:-3]) == [] and N.jaccard_links([sets[-4]] * 3) == [(0, 1), (0, 2)]


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_pairs_of_the_documents_table(spark):
    """On the test table every pair at 0.8 or more by brute force is found, and no other."""
    df = spark.read.parquet(SF)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").orderBy("doc_id").collect()]
    assert sorted(map(tuple, N.near_copies(df).collect())) == brute(rows)
