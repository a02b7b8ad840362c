"""Every registered query without SQL, as registered, over a small folder of odd rows, against plain versions."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tokenizers
import xxhash
from pyspark.sql import functions as F

from netquarry.llm import media, quality
from netquarry.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, node string, found string"


def texts():
    random.seed(21)
    sounds = {"aa": "ka lo mi nu pe ri".split(), "bb": "sch üb ing auf ver ach".split(), "cc": "ção lho nha que dos".split()}
    out = []
    for i in range(66):
        lang = list(sounds)[i % 3]
        words = ["".join(random.choices(sounds[lang], k=random.randint(1, 4))) for _ in range(random.randint(1, 90))]
        if i % 5 == 0:
            words[0] = words[0].title() + ","
        out.append((" ".join(words) + ("\n  Share this PAGE \n" if i % 4 == 0 else "\n" if i % 7 == 0 else ""), lang))
    out += [(out[3][0], "aa"), (out[3][0].upper(), "aa"), (out[4][0] + " ka", "bb")]
    out += [(None, None), ("", "aa"), (" \n\t", "aa"), ("12 %% !!", None), ("漢字 <unk> </s> <s> ​­ é é", "cc"), ("a" * 5000, None), ("\n".join("x y z" for _ in range(40)), "aa")]
    out += [(" ".join(random.choices(sounds["bb"], k=25_000)), "bb"), ("AAA!! BBB?? $$$$ ---- #### !!!! ???? ,,,, ;;;; ::::", "aa"), ("no no no no no no no no no no no no no no no no no no no no no", "aa")]
    return out


@pytest.fixture(scope="module")
def rows():
    found = texts()
    return [(7 * i - 100, text, lang, [None, "s1", "ß", "S1", ""][i % 5], 0, 1, "x", None) for i, (text, lang) in enumerate(found)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{place}/documents.parquet")
    return place


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{place}/pages.parquet")
    return place


def result(spark, name, folder):
    out = {r.doc_id: r for r in QUERIES[name](spark, folder).collect()}
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]+", lambda m: m[0].lower(), text or ""))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_op1(spark, folder, rows):
    library = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = result(spark, "op1_token_counts", folder)
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert tuple(got[i])[:4] == (i, len((text or "").encode()), n, n > 2048)


def test_op3(spark, folder, rows):
    got = result(spark, "op3_iso_media", folder)
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        stored = media.pack(data)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and payload in stored
        units, first = len(payload) // 64, stored.index(b"mdat") + 4
        starts = range(first, first + len(payload), 64 * 16)
        ranges = ",".join(f"{a}-{a + 64}" for a in starts)
        assert r.feature == f"raw;{len(payload)}/8000;{len(starts)} of {units};{sha(ranges)}"
        assert stored[first:] == payload and struct.unpack(">I", stored[first - 8:first - 4])[0] == len(payload) + 8


def test_op4(spark, folder, rows):
    got = result(spark, "op4_weighted_sampling", folder)
    order = sorted(rows)
    places = lambda h: [h[k:k + 8] for k in range(0, len(h), 8)]
    alike = lambda a, b: float(np.mean([x == y for x, y in zip(places(a), places(b))]))
    by_text = {}
    for (i, text, *_), (after, following, *_) in zip(order, [*order[1:], order[0]]):
        text, following, r = text or "", following or "", got[i]
        n = len(text) // 2
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(text[:len(text) - n] + following[:n]))
        assert r.near_edited == alike(r.fingerprint, r.edited_fingerprint) and r.near_next == alike(r.fingerprint, got[after].fingerprint)
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint


def test_op6(spark, folder, rows):
    got = result(spark, "op6_simhash", folder)
    fps = {}
    for i, text, *_ in rows:
        w = words(text)
        h = [xxhash.xxh64_intdigest(" ".join(w[k:k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    name = {i: i for i in fps}
    for i in fps:
        for j in fps:
            if (fps[i] ^ fps[j]).bit_count() <= 3 and name[i] != name[j]:
                a, b = sorted((name[i], name[j]))
                name = {k: a if v == b else v for k, v in name.items()}
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fps[i]:016x}", name[i]) for i in fps}


def grams(text):
    n = Counter()
    for run in re.findall(r"[^\W\d_]+", (text or "").lower()):
        for size in (1, 2, 3):
            padded = f"_{run}_"
            n.update(g for k in range(len(padded) - size + 1) if (g := padded[k:k + size]) != "_")
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    return n, code


def test_op7(spark, folder, rows):
    got = result(spark, "op7_language_id", folder)
    counts, code = defaultdict(Counter), None
    for i, text, lang, *_ in rows:
        held = zlib.crc32(str(i).encode()) % 4 == 2
        assert got[i].held_out == held
        n, code = grams(text)
        if not held and lang and text is not None:
            counts[lang] += n
    rank = {lang: {g: r for r, (g, _) in enumerate(sorted(n.items(), key=lambda x: (-x[1], code(x[0])))[:400])} for lang, n in counts.items()}
    for i, text, *_ in rows:
        n, code = grams(text)
        if not any(c.isalpha() for c in text or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        mine = [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], code(x[0])))[:400]]
        away = {lang: sum(min(400, abs(p[g] - r)) if g in p else 400 for r, g in enumerate(mine)) / (400 * len(mine)) for lang, p in rank.items()}
        best = min(sorted(away), key=away.get)
        assert got[i].lang_pred == best and math.isclose(got[i].score, 1 - away[best])


def test_op8(spark, folder, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = result(spark, "op8_piece_encoding", folder)
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_eos=True)
        assert tuple(got[i])[:4] == (i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_op9(spark, folder, rows):
    size, of = {i: len(words(text)) for i, text, *_ in rows}, {i: r[3] for i, *r in [(r[0], *r) for r in rows]}
    total = Counter()
    for i, n in size.items():
        total[of[i]] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, [3, 1, 2] * len(order)))
    target, free = {}, set(order)
    while True:
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in order if s not in free)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * total[s]}
        target = {s: share[s] if s in free else 2 * total[s] for s in order}
        if not over:
            break
        free -= over
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = result(spark, "op9_mixing", folder)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    again = result(spark, "op9_mixing", folder)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {i: r.taken for i, r in got.items()} == {i: r.taken for i, r in again.items()} and len(got) == len(rows)
    taken = Counter()
    for i, r in got.items():
        assert (r.size, r.source_size) == (size[i], total[of[i]]) and math.isclose(r.target, target[of[i]])
        assert r.taken in (0, size[i], 2 * size[i])
        taken[of[i]] += r.taken
    largest = lambda s: max(n for i, n in size.items() if of[i] == s)
    assert all(abs(taken[s] - target[s]) <= largest(s) for s in order)


def plain_model(votes):
    """Expectation-maximisation over documents, one by one; each vote counts, abstentions don't."""
    good = [0.1 if 0 in v else 0.9 for v in votes]
    for _ in range(100):
        prior = (sum(good) + 1) / (len(votes) + 2)
        n = {(j, c, x): 1.0 for j in range(len(quality.LABELLERS)) for c in "bg" for x in (0, 2)}
        for v, g in zip(votes, good):
            for j, x in enumerate(v):
                if x != 1:
                    n[j, "g", x] += g
                    n[j, "b", x] += 1 - g
        p = {(j, c, x): n[j, c, x] / (n[j, c, 0] + n[j, c, 2]) for j, c, x in n}
        before, good = good, []
        for v in votes:
            g = prior * math.prod(p[j, "g", x] for j, x in enumerate(v) if x != 1)
            b = (1 - prior) * math.prod(p[j, "b", x] for j, x in enumerate(v) if x != 1)
            good.append(g / (g + b))
        if max(abs(a - b) for a, b in zip(before, good)) < 1e-9:
            break
    return good


def plain_features(text):
    def shape(w):
        return re.sub(rb"[0-9]+", b"0", re.sub(rb"[a-z\x80-\xff]+", b"a", re.sub(rb"[A-Z]+", b"A", w)))

    w, out = text.split(), []
    for x in w:
        out += [zlib.crc32(x.lower()) % quality.DIMENSIONS, zlib.crc32(b"shape " + re.sub(rb"a+", b"a", shape(x))) % quality.DIMENSIONS]
    return out + [zlib.crc32(b"same word again") % quality.DIMENSIONS] * (2 * sum(a == b for a, b in zip(w, w[1:])))


def test_op10(spark, folder, rows):
    got = result(spark, "op10_weak_quality", folder)
    data = [(r[1] or "").encode() for r in rows]
    votes = [[vote(quality.facts(x, x.split())) for vote in quality.LABELLERS.values()] for x in data]
    posterior = plain_model(votes)
    for r, want in zip(rows, posterior):
        assert math.isclose(got[r[0]].posterior, want, rel_tol=1e-6, abs_tol=1e-9)
    # the sample is all rows, as there are few
    u = dict(spark.createDataFrame(rows, SCHEMA).select("doc_id", F.pmod(F.xxhash64(F.lit("quality"), "doc_id", "text"), F.lit(1 << 40))).collect())
    sample = sorted((u[r[0]], y, np.array(plain_features(x), np.int32).tobytes()) for r, x, y in zip(rows, data, posterior))
    w, b, seen, seen_b = defaultdict(float), 0.0, defaultdict(lambda: 1e-3), 1e-3
    for _ in range(8):
        for _, y, x in sample:
            n = Counter(np.frombuffer(x, np.int32).tolist())
            size = max(1, sum(n.values()))
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(w[k] * c / size for k, c in n.items()) + b))))
            for k, c in n.items():
                g = (p - y) * c / size + 1e-6 * w[k]
                seen[k] += g * g
                w[k] -= 2 * g / math.sqrt(seen[k])
            seen_b += (p - y) ** 2
            b -= 0.1 * (p - y) / math.sqrt(seen_b)
    for r, x in zip(rows, data):
        f = plain_features(x)
        z = (sum(w[k] for k in f) / len(f) if f else 0) + b
        assert abs(got[r[0]].score - 1 / (1 + math.exp(-z))) < 1e-5 and got[r[0]].keep == (got[r[0]].score >= 0.5)
