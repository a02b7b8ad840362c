import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from netquarry.llm import langid, line_dedup, mixing, quality, simhash, weighted_sampling
from netquarry.llm.common import cut_lineage

SCHEMA = "doc_id long, text string, lang string, source string, k1 string"


# -- weighted sampling ---------------------------------------------------------


def jaccard(a, b):
    a, b = weighted_sampling.weights(a), weighted_sampling.weights(b)
    keys = {*a, *b}
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


def test_collision_rate_is_generalised_jaccard():
    random.seed(5)
    words = [f"w{i}" * (1 + i % 3) for i in range(60)]
    texts = [" ".join(random.choices(words[:random.randint(5, 60)], k=random.randint(20, 300))) for _ in range(60)]
    s = weighted_sampling.signatures(texts)
    pairs = [(i, j) for i in range(60) for j in range(i)]
    error = [weighted_sampling.likeness(s[i], s[j]) - jaccard(texts[i], texts[j]) for i, j in pairs]
    assert abs(np.mean(error)) < 0.02 and np.sqrt(np.mean(np.square(error))) < 0.08


def test_edits_against_brute_force(spark):
    rows = [(i * 3, f"text {i} " * (i % 7), None, None, "c") for i in range(200)] + [(None, "null id", None, None, None), (9, "another nine", None, None, None), (30, None, None, None, None), (31, "", None, None, None)]
    got = weighted_sampling.with_edits(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1]))
    want = []
    for k, (i, text) in enumerate(order):
        n, after = len(text) // 2, order[(k + 1) % len(order)][1]
        want.append((i or -1, len(text), hashlib.sha256((text[:len(text) - n] + after[:n]).encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    alone = {r.doc_id: r.fingerprint for r in weighted_sampling.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    for r in got:
        if r.doc_id not in (9, 30):  # two texts each
            assert alone[r.doc_id] == r.fingerprint
    one = weighted_sampling.with_edits(spark.createDataFrame([(1, "abcd", None, None, None)], SCHEMA)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one[0].near_next == 1
    assert weighted_sampling.with_edits(spark.createDataFrame([], SCHEMA)).count() == 0


# -- line dedup ----------------------------------------------------------------


def brute_lines(rows, min_docs, keep_first):
    docs = defaultdict(set)
    for i, text, *_ in set(rows):
        for line in (text or "").split("\n"):
            if key := line.encode().strip(b" \t\n\v\f\r").lower():
                docs[key].add((i, text))
    order = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0, *key_of(r)))
    first = {}
    for r in order:
        for pos, line in enumerate((r[1] or "").split("\n")):
            first.setdefault(line.encode().strip(b" \t\n\v\f\r").lower(), (r, pos))
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        stay = []
        for pos, line in enumerate(lines):
            key = line.encode().strip(b" \t\n\v\f\r").lower()
            if not key or len(docs[key]) < min_docs or keep_first and first[key] == ((r[0], r[1]), pos):
                stay.append(line)
        out.append((r[0] if r[0] is not None else -1, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out)


KEYS = {}


def key_of(row):
    return KEYS[row[0], row[1]]


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("min_docs", [2, 10])
def test_lines_against_brute_force(spark, keep_first, min_docs):
    random.seed(min_docs)
    common = [" Very Common\t", "menu", "é", "", "   ", "copyright"]
    rows = [(i if i else None, "\n".join(random.choices([*common, *(f"line {random.randint(0, 60)}" for _ in range(6)), f"own {i}"], k=random.randint(1, 9))), "en", None, None) for i in range(150)]
    rows += [(200 + i, "very common\nvery common", None, None, None) for i in range(300)]
    rows += [rows[5], rows[5], (7, "another seven\nmenu", None, None, None), (8, None, None, None, None), (9, "\n\n", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    from netquarry.llm.common import row_key

    KEYS.update({(r.doc_id, r.text): (r.a, r.b) for r in row_key(df.drop("k1"), "doc_id", "text").select("doc_id", "text", F.col("k1").alias("a"), F.col("k2").alias("b")).collect()})
    got = line_dedup.apply(df, line_dedup.bitmaps(df, min_docs=min_docs, keep_first=keep_first))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept", "lang", "source"]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()) == brute_lines(rows, min_docs, keep_first)
    empty = df.where("false")
    assert line_dedup.apply(empty, line_dedup.bitmaps(empty)).count() == 0


@pytest.mark.parametrize("partitions", [1, 4])
def test_long_lines_have_a_threshold_of_their_own(spark, partitions):
    """Keys of over 50 words go from the second document on, whatever the partitions; shorter ones from ten documents on."""
    long, short, rare = " ".join(f"long{i}" for i in range(51)), " ".join(f"short{i}" for i in range(50)), " ".join(f"rare{i}" for i in range(60))
    rows = [(i, f"own {i}\n{long}\n{short if i < 9 else 'menu'}", None, None, None) for i in range(30)]
    rows += [(50, f"{rare}\n{rare}", None, None, None), (60, f"a\n{rare.upper()}\t\nb", None, None, None), (61, "alone " + long, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    kept = {r.doc_id: r.kept for r in line_dedup.apply(df, line_dedup.bitmaps(df, keep_first=True, long_docs=2)).collect()}
    want = {i: "\n".join([f"own {i}", *[long] * (i == 0), *([short] if i < 9 else ["menu"] * (i == 9))]) for i in range(30)}
    assert kept == want | {50: rare, 60: "a\nb", 61: "alone " + long}


def test_pipeline_drops_long_lines_of_two_documents(spark):
    import corpus_pipeline

    long = " ".join(f"long{i}" for i in range(60))
    docs = spark.createDataFrame([(1, "a\n" + long, "en", "s", 1), (2, long + "\nb", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()} == {1: "a\n" + long, 2: "b"}


# -- simhash -------------------------------------------------------------------


def brute_components(fps, reach):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= reach:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("block_rows", [16, 4096])
def test_links_against_brute_force(spark, block_rows):
    """Random, close and very dense fingerprints; with small blocks the dense ones go through several rounds."""
    random.seed(block_rows)
    fps = [random.getrandbits(64) for _ in range(300)]
    fps += [f ^ sum(1 << b for b in random.sample(range(64), k)) for f in fps[:60] for k in (1, 2, 3, 4)]
    base = random.getrandbits(64)
    fps += [base ^ sum(1 << (7 * b % 64) for b in range(9) if x >> b & 1) for x in range(200)]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    found = simhash.components(simhash.links(df, block_rows=block_rows)).collect()
    label = {r.node & simhash._all: r.root for r in found}
    want = brute_components(fps, 3)
    groups = defaultdict(set)
    for f, w in zip(fps, want):
        groups[w].add(label.get(f, ("alone", f)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_fingerprint_by_definition():
    text = b"The Quick brown fox\tJumps over the lazy dog the quick BROWN fox jumps"
    w = text.lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(len(w) - 2)]
    assert simhash.fingerprint(text, 3) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(b" \n", 3) == 0 and simhash.fingerprint(b"A b", 3) == xxhash.xxh64_intdigest(b"a b", 42)
    long = b" ".join(b"w%d" % (i % 777) for i in range(9000))
    h = simhash.shingle_hashes(long.split(), 3)
    assert (simhash.majority(h) == np.packbits(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0) * 2 > len(h), bitorder="little")).all()


def test_near_duplicates(spark):
    random.seed(2)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ri") for b in range(150)]
    base = [random.choices(words, k=300) for _ in range(20)]
    rows = []
    for w in base:
        for k in range(4):
            copy = list(w)
            for _ in range(k):
                copy[random.randrange(300)] = "changed"
            rows.append((len(rows), " ".join(copy), None, None, None))
    rows += [(500, None, None, None, None), (501, "", None, None, None), (502, " \n", None, None, None), (None, rows[0][1], None, None, None), (3, rows[3][1], None, None, None)]
    exact = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(exact) == len(rows)
    fps = sorted({(r.fp & simhash._all) for r in exact})
    want = dict(zip(fps, brute_components(fps, 3)))
    low = defaultdict(lambda: 10**9)
    for r in exact:
        if r.doc_id is not None:
            low[want[r.fp & simhash._all]] = min(low[want[r.fp & simhash._all]], r.doc_id)
    assert all(r.component_id == low[want[r.fp & simhash._all]] for r in exact)
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 200)] + [(7, 7), (300, 301), (301, 300), (301, 300)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 300)) and got[301] == got[300] == 300


# -- language ID, quality --------------------------------------------------------


def corpus(spark, n=120):
    random.seed(4)
    sounds = {"aa": "ka lo mi nu pe".split(), "bb": "sch üb ing auf ver".split(), "cc": "ção é lh nh ões".split()}
    rows = []
    for i in range(n):
        lang = list(sounds)[i % 3]
        rows.append((i, " ".join("".join(random.choices(sounds[lang], k=random.randint(1, 4))) for _ in range(random.randint(3, 60))).capitalize() + ".", lang, f"s{i % 4}", None))
    return rows


def test_language(spark):
    rows = corpus(spark)
    odd = [(900, None, "aa", None, None), (901, "", None, None, None), (902, "123 !?", "bb", None, None), (903, "漢字", None, None, None), (None, rows[0][1], None, None, None)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    profiles = langid.train(df, "doc_id", "text", "lang", F.coalesce(F.col("doc_id") % 4 != 2, F.lit(False)))
    assert list(profiles) == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in langid.predict(df, profiles).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, *_ in rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and got[903].score < 0.01 and got[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.train(df.where("false"), "doc_id", "text", "lang", F.lit(True)) == {}
    assert {r.lang_pred for r in langid.predict(df, {}).collect()} == {"und"} and langid.predict(df.where("false"), profiles).count() == 0


def brute_ranked(text):
    n = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        w = f"_{word}_"
        n.update([*word, *(w[i:i + 2] for i in range(len(w) - 1)), *(w[i:i + 3] for i in range(len(w) - 2))])
    return sorted(n, key=lambda g: (-n[g], sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))))


def test_distance_by_definition():
    number = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    for text in ("abc abc abd xyz", "a", "Élan, élan! 12 x_y", "\U0001d400b 漢字漢"):
        assert langid.ranked(text).tolist() == [number(g) for g in brute_ranked(text)][:langid.PROFILE]
    profile = {g: i for i, g in enumerate(brute_ranked("abc abc abd xyz"))}
    grams = np.array(sorted(map(number, profile)))
    ranks = np.array([[{number(g): i for g, i in profile.items()}[k]] for k in grams.tolist()])
    assert langid.distances("abc abc abd xyz", grams, ranks)[0] == 0 and langid.distances("12 !", grams, ranks) is None
    other = brute_ranked("abd qq")
    want = sum(abs(i - profile[g]) if g in profile else langid.PROFILE for i, g in enumerate(other)) / (langid.PROFILE * len(other))
    assert langid.distances("abd qq", grams, ranks)[0] == pytest.approx(want)


def test_quality_without_labels(spark):
    rows = corpus(spark, 600)
    bad = [(1000 + i, text.replace(" ", "### ") + "$$$", None, None, None) for i, (_, text, *_) in enumerate(rows[:40])]
    bad += [(2000 + i, ("spam " * 60).strip(), None, None, None) for i in range(20)] + [(3000 + i, text.upper().replace(" ", "!! ") + "!!", None, None, None) for i, (_, text, *_) in enumerate(rows[:20])]
    df = spark.createDataFrame(rows + bad + [(None, None, None, None, None), (5000, "", None, None, None)], SCHEMA)
    model, weights = quality.fit(df)
    got = quality.score(df, model, weights).collect()
    assert len(got) == len(rows) + len(bad) + 2
    right = [(r.score >= 0.5) == (r.doc_id < 1000) for r in got if r.doc_id is not None and r.doc_id < 5000]
    assert np.mean(right) > 0.97 and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)
    assert all(model.accuracies()[k] > 0.8 for k in ("decorated", "stutter", "top_word"))
    empty = quality.fit(df.where("false"))
    assert quality.score(df.where("false"), *empty).count() == 0


def test_label_model_finds_accuracies():
    """Votes drawn from known accuracies; the model sees the votes alone."""
    rng = np.random.default_rng(1)
    n, m = 20000, len(quality.LABELLERS)
    truth = rng.random(n) < 0.8
    accuracy = np.linspace(0.7, 0.95, m)
    right = rng.random((n, m)) < accuracy
    votes = np.where(right == truth[:, None], quality.GOOD, quality.BAD)
    votes[rng.random((n, m)) < 0.3] = quality.ABSTAIN
    counts = Counter((votes @ 3 ** np.arange(m - 1, -1, -1)).tolist())
    model = quality.LabelModel(counts)
    assert np.abs(np.array(list(model.accuracies().values())) - accuracy).max() < 0.03 and abs(model.prior - 0.8) < 0.02


# -- mixing ----------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, total = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        share = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * share >= 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * share for s in free}
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return target


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 8)  # so that the tree has several levels
    random.seed(8)
    sources = ["hot"] * 12 + ["a", "b", "é", "\U0001F600", None, "zz"]
    rows = [(i, "w " * random.randint(0, 40), None, random.choice(sources), None) for i in range(900)]
    rows += [(None, "a b", None, "a", None), (1, rows[1][1], None, rows[1][3], None), (1, rows[1][1], None, rows[1][3], None), (5000, None, None, "empty", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    target, taken = brute_targets(sizes), Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and 0 <= r.copies <= 2
        taken[r.source] += r.size * r.copies
    assert all(abs(taken[s] - target[s]) <= 40 for s in sizes)
    again = mixing.mix(df.repartition(7)).collect()
    name = lambda rs: sorted((r.doc_id or -1, r.source or "", r.size, r.copies) for r in rs)
    assert name(got) == name(again)
    applied = mixing.apply(df, cut_lineage(mixing.mix(df)))
    assert applied.columns == df.columns and applied.count() == sum(r.copies for r in got)
    assert mixing.mix(df.where("false")).count() == 0


def test_pivotal_keeps_expectations():
    probs, n = [0.3, 0.7, 0.5, 0.2, 0.9, 0.4], 4000
    sizes, seen = [5, 1, 9, 2, 2, 7], np.zeros(6)
    for seed in range(n):
        done = {row[2][1]: p for row, p in mixing.pivotal(((s, p, (seed, i)) for i, (s, p) in enumerate(zip(sizes, probs))), 0)}
        assert sum(p not in (0, 1) for p in done.values()) <= 1
        assert sum(sizes[i] * p for i, p in done.items()) == pytest.approx(sum(s * p for s, p in zip(sizes, probs)))
        seen += [done[i] for i in range(6)]
    assert np.abs(seen / n - probs).max() < 0.03
