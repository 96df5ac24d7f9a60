"""Target resampling, centroid clustering and the license scan against plain versions, with
nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairsieve.llm import centroids, licenses, target_sample

SCHEMA = "doc_id long, text string, row long, low long, rank int, start int, label string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    words = ["alpha", "Beta", "gamma", "the", "été", "ÉTÉ", "K", "42", "MIT", "license"]
    words += ["under", "rights", "all", "Reserved"]
    seps = [" ", "\n", " \t", "-", ", ", "\x7f", "_"]
    texts = [
        "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(1, 90)))
        for _ in range(120)
    ]
    texts += [None, "", " \n.", "word", "two words", "x" * 5000, " ".join(rng.choices(words, k=9000))]
    texts += [
        "Released UNDER the MIT\nlicense. Apache License, Version 2.0; cc by-nc cc by nc 4.0",
        "the mİt license, under the mit License under the mit license",
        "GNU\n" + "filler " * 40 + "General Public License",
        "GNU\n" + "filler " * 4000 + "General Public License",
        "gnu general\npublic -- license v3. All other rights are reserved.",
        "wor" + "K " * 30 + "the " * 30,
        "Permission is hereby granted, free of charge, to any one obtaining copies of this "
        "software and associated documentation files (the Software), to deal in it",
    ]
    out = [(i, t, 1, 2, 3, 4, "l") for i, t in enumerate(texts)]
    return [*out, out[3], out[3], out[121], (None, texts[5], 1, 2, 3, 4, "l")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_features(text):
    words = WORD.findall(lower(text))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


@pytest.mark.parametrize("piece", [7, 60, 1 << 20])
def test_buckets_of_runs(piece, rows, monkeypatch):
    monkeypatch.setattr(target_sample, "PIECE", piece)
    rng = random.Random(2)
    odd = ["".join(rng.choices("abZé9 -_", k=rng.choice([3, 90, 4000]))) for _ in range(60)]
    for text in [r[1] or "" for r in rows if len(r[1] or "") < 6000] + odd:
        n, found = 0, []
        for more, buckets in target_sample.run_buckets(text.encode()):
            n, found = n + more, found + buckets.tolist()
        expected = plain_features(text)
        assert (n, sorted(found)) == (expected[0], sorted(expected[1]))


def plain_sample(rows, targets, share=(5, 100)):
    raw, aim = Counter(), Counter()
    for r in rows:
        raw.update(plain_features(r[1])[1])
    for t in targets:
        aim.update(plain_features(t)[1])
    n_raw, n_aim = sum(raw.values()), sum(aim.values())
    out = []
    for r in rows:
        n, found = plain_features(r[1])
        weight = sum(
            math.floor(
                1000
                * math.log((aim[b] + 1) * (n_raw + 10000) / ((raw[b] + 1) * (n_aim + 10000)))
            )
            for b in found
        )
        digest = hashlib.sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()
        u = (int(digest[:8], 16) + 0.5) / 4294967296
        score = weight + math.floor(-1000 * math.log(-math.log(u)))
        out.append((n, (r[0], len(found), weight, score)))
    order = sorted(
        (row for n, row in out if n >= 20),
        key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]),
    )
    drawn = order[: share[0] * len(order) // share[1]]
    left = Counter(row for _, row in out) - Counter(drawn)
    return Counter([(*r, i) for i, r in enumerate(drawn, 1)]) + Counter(
        {(*r, None): n for r, n in left.items()}
    )


@pytest.mark.parametrize("few, share", [(10_000, (5, 100)), (1, (50, 100)), (3, (97, 100))])
def test_target_sample(spark, docs, rows, few, share):
    targets = ["alpha beta gamma the mit license", None, "", "rights rights été"]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "item_id int, text string")
    found = target_sample.resample(docs, target, share=share, few=few)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in found.dtypes} == {"bigint"}
    assert Counter(map(tuple, found.collect())) == plain_sample(rows, targets, share)


def test_target_sample_edges(spark, docs, rows, empty):
    assert target_sample.resample(empty, docs).count() == 0
    nothing = target_sample.resample(docs, empty)
    assert Counter(map(tuple, nothing.collect())) == plain_sample(rows, [])
    short = docs.filter("doc_id between 120 and 124")
    assert target_sample.draw(short, docs).count() == 0


def test_cutoff_is_exact_in_every_place(spark):
    rng = random.Random(4)
    keys = [(rng.randint(-3, 3), 0, rng.randint(0, 5), 7, i) for i in range(400)]
    frame = spark.createDataFrame(keys, ", ".join(f"{c} long" for c in target_sample.KEY))
    frame = frame.repartition(7).cache()
    ordered = sorted(keys)
    for k in (1, 2, 133, 399, 400):
        assert target_sample.cutoff_key(frame, k, few=1) == ordered[k - 1]


def test_median_of_medians_discards_a_quarter():
    rng = random.Random(6)
    for _ in range(300):
        parts = [
            sorted(rng.sample(range(10**6), rng.choice([1, 2, 9, 200])))
            for _ in range(rng.randint(1, 12))
        ]
        medians = [(p[(len(p) - 1) // 2], len(p)) for p in parts]
        pivot = target_sample.weighted_median(medians)
        every = [x for p in parts for x in p]
        assert sum(x <= pivot for x in every) >= len(every) / 4
        assert sum(x >= pivot for x in every) >= len(every) / 4


def plain_clusters(rows, k, rounds, dim):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    digest = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    starts = sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]
    centres = [v for _, v in starts]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        found = [near(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), c in zip(kept, found) if c == j]
            if mine:
                centres[j] = [sum(col) // len(mine) for col in zip(*mine)]
    last = [near(v) for _, v in kept]
    inertia = Counter()
    for d, j in last:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter(
        (i, j, d, inertia[j], sum(inertia.values()), sha[j]) for (i, _), (d, j) in zip(kept, last)
    )


@pytest.mark.parametrize("k", [1, 2, 16, 400])
def test_clusters(spark, k):
    rng = random.Random(8)
    vectors = [(i, [rng.gauss(rng.choice([-1, 2]), 1) for _ in range(8)]) for i in range(250)]
    vectors += [(300 + i, [float(rng.randint(0, 1)) for _ in range(8)]) for i in range(60)]
    vectors += [(400 + i, vectors[0][1]) for i in range(40)]  # a hot vector
    vectors += [(7, vectors[7][1]), (7, vectors[8][1]), (None, vectors[9][1])]
    vectors += [(500, None), (501, []), (502, [1.0] * 9), (503, [None] + [1.0] * 7)]
    vectors += [(504, [math.nan] * 8), (505, [math.inf] + [0.0] * 7), (506, [0.0] * 8)]
    rows = [(i, v, 1, "u", 2) for i, v in vectors]
    schema = "vec_id long, embedding array<float>, first int, upper string, cluster int"
    frame = spark.createDataFrame(rows, schema).repartition(4)
    found = centroids.report(*centroids.cluster(frame, k=k, dimensions=8))
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(found.columns) == sorted(columns)
    got = Counter(map(tuple, found.select(*columns).collect()))
    assert got == plain_clusters(vectors, k, 3, 8)


def test_clusters_of_nothing_and_of_too_much(spark):
    schema = "vec_id long, embedding array<double>"
    none = spark.createDataFrame([(1, None), (2, [1.0])], schema)
    found = centroids.report(*centroids.cluster(none))
    assert found.count() == 0 and "centroid_sha256" in found.columns
    huge = spark.createDataFrame([(1, [1e30])], schema)
    with pytest.raises(Exception, match="reaches"):
        centroids.cluster(huge, dimensions=1)


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(3)
    seen = total = 0
    for _ in range(60):
        k, n, dim = int(rng.integers(2, 12)), int(rng.integers(1, 200)), int(rng.integers(1, 6))
        points = rng.integers(-6, 6, (n, dim)) * int(rng.choice([1, 1000, 2**22]))
        centres, before = points[rng.integers(0, n, k)].astype(np.int64), None
        state = (np.zeros(n, np.int32), np.ones(n, np.int32), np.full(n, np.inf), np.zeros(n))
        for _ in range(5):
            ball = centroids.Ball(centres, before)
            plain, count = ball.squares, Counter()
            ball.squares = lambda p, w, f=plain, c=count: c.update(n=len(p)) or f(p, w)
            state = centroids.assign(ball, points, *state)
            d = ((points[:, None] - centres[None]) ** 2).sum(2)
            first = d.argmin(1)
            seen, total = seen + count["n"], total + d.size
            assert (state[0] == first).all()
            true = np.sqrt(d.astype(float))
            assert (state[2] >= true[np.arange(n), first]).all()
            true[np.arange(n), first] = np.inf
            assert (state[3] <= true.min(1)).all()
            before, centres = centres, centres.copy()
            for c in range(k):
                if (first == c).any():
                    centres[c] = [int(x) // int((first == c).sum()) for x in points[first == c].sum(0)]
    assert seen < 0.6 * total


def plain_licenses(rows, templates, phrases, threshold):
    sets = [(label, set(licenses.template_words(t))) for label, t in templates]
    span = max(len(licenses.template_words(t)) for _, t in templates)
    out, blocks = Counter(), set()
    for at, r in enumerate(rows):
        words = WORD.findall(lower(r[1]))
        places, base, found, best = [], set(), set(), 0.0
        for phrase, label in phrases.items():
            p = phrase.split()
            here = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += here
            base |= {label} if here else set()
        for start in range(0, len(words) + 1, span):
            block = set(words[start : start + 2 * span])
            for label, wanted in sets:
                share = Fraction(len(block & wanted), len(wanted))
                if share >= threshold:
                    found.add(label)
                    best = max(best, float(share))
                    blocks.add((at, start, label))
        out[
            r[0], len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if places else best,
        ] += 1
    return out, blocks


@pytest.mark.parametrize("threshold", [Fraction(4, 5), Fraction(1, 3), Fraction(1)])
def test_license_scan(docs, rows, threshold):
    found = licenses.scan_licenses(docs, threshold=threshold)
    expected, _ = plain_licenses(rows, licenses.TEMPLATES, licenses.PHRASES, threshold)
    assert Counter(map(tuple, found.collect())) == expected
    assert [t for _, t in found.dtypes[:5]] == ["bigint"] * 5


def test_license_join_equals_all_pairs(spark, rows):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    templates = [("t%d" % (i % 9), " ".join(rng.choices(words, k=rng.randint(1, 15)))) for i in range(30)]
    weights = [1 / (i + 1) for i in range(40)]
    made = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 80)))) for i in range(60)]
    docs = spark.createDataFrame(made, "doc_id long, text string").coalesce(1)
    threshold = Fraction(3, 4)
    scan = licenses.scanned(docs, templates, {}, threshold)
    found = licenses.matches(scan, templates, threshold)
    _, expected = plain_licenses(made, templates, {}, threshold)
    ids = dict(scan.select("row", "doc_id").collect())
    got = {(ids[r.row], r.start, r.label) for r in found.collect()}
    # The last block may be the end of the one before and is compared as well.
    assert got == expected and len(got) > 100


def test_license_scan_of_nothing(empty):
    assert licenses.scan_licenses(empty).count() == 0


def test_license_templates_are_bounded(spark, docs, monkeypatch):
    monkeypatch.setattr(licenses, "MOST_WORDS", 3)
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs)
    assert docs.filter(F.col("doc_id") < 0).count() == 0
