"""Windows of bytes and the join of large dictionaries that is keyed by them."""

import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from pairsieve.operators import dictionary, windows


def _texts(n=200, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice("abé \n") for _ in range(rng.randrange(0, 90))) for _ in range(n)]


def _hash(run):
    h = 0
    for byte in run:
        h = (h * windows._BASE + int(windows._BYTES[byte])) % (1 << 64)
    return h


@pytest.mark.parametrize("lengths", [[3], [1, 7, 32], list(windows.LENGTHS), []])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_windows_equal_brute_force(monkeypatch, lengths, kind):
    monkeypatch.setattr(windows, "_PASS", 50)  # texts go over the end of a pass
    column = pa.array(_texts(), kind).slice(3, 150)
    got = {x for r, k in windows.shown(column, lengths, None) for x in zip(r.tolist(), k.tolist())}
    assert got == {
        (row, _hash(text[i : i + n]))
        for row, text in enumerate(t.encode() for t in column.to_pylist())
        for n in lengths
        for i in range(len(text) - n + 1)
    }


def test_held_passes_all_of_its_own_and_few_others():
    keys = windows._mixed(np.arange(53_000, dtype=np.uint64))
    held = windows.Held.empty(3_000)
    held.add(keys[:3_000])
    passed = held.passed(keys).tolist()
    assert passed[:3_000] == list(range(3_000)) and len(passed) < 3_050


def _recorded(monkeypatch):
    """Stored tables by name."""
    stored, store = {}, dictionary.stored_table

    def kept(df, name):
        stored[name] = store(df, name)
        return stored[name]

    monkeypatch.setattr(dictionary, "stored_table", kept)
    return stored


def _hits_and_candidates(spark, monkeypatch, texts, patterns):
    stored = _recorded(monkeypatch)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    pats = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    got = sorted(map(tuple, dictionary.hits(df, "id", "text", pats, "join").collect()))
    assert got == sorted((i, p) for i, t in enumerate(texts) for p in set(patterns) if p in t)
    return got, stored["dictionary-candidates"]


def test_patterns_of_common_words_meet_few_texts(spark, monkeypatch):
    """Each word and run of six letters is in nearly all texts, no window is. The candidates
    that are stored hold no text."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(150)]
    got, candidates = _hits_and_candidates(spark, monkeypatch, texts, [t[:83] for t in texts])
    assert len(got) == 150
    assert candidates.count() <= 2 * len(got)
    assert set(dict(candidates.dtypes).values()) == {"bigint"}


def test_near_copies_do_not_all_meet_each_other(spark, monkeypatch):
    """Lines that differ in one word of a hundred, each in a text of its own."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(100)]
    lines = []
    for i in range(120):
        at = rng.randrange(5, 95)
        lines.append(" ".join(words[:at] + [f"own{i:03d}"] + words[at + 1 :]))
    got, candidates = _hits_and_candidates(
        spark, monkeypatch, [f"{line}\nrest" for line in lines], lines
    )
    assert len(got) == 120
    assert candidates.count() <= 2 * len(got)


def test_patterns_of_all_lengths_and_the_other_forms_dictionary(spark):
    texts = _texts(120, 7)
    patterns = {t[i : i + n] for n in range(1, 40) for i, t in enumerate(texts) if t[i : i + n]}
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    pats = spark.createDataFrame([(p,) for p in sorted(patterns)], "pattern string")
    expected = sorted((i, p) for i, t in enumerate(texts) for p in patterns if p in t)
    for keyed in (None, dictionary.windowed_dictionary(pats), dictionary.keyed_dictionary(pats)):
        found = dictionary.hits(df, "id", "text", pats, "join", keyed)
        assert sorted(map(tuple, found.collect())) == expected


def test_executors_need_not_have_this_package(tmp_path):
    held = windows.Held.empty(1)
    held.add(np.array([_hash(b"abc")], np.uint64))

    class Shared:
        value = {3: tuple(held)}

    work = windows.text_batches([3], Shared())
    (tmp_path / "work").write_bytes(cloudpickle.dumps(work))
    code = """import pickle, pyarrow as pa
work = pickle.loads(open("work", "rb").read())
batch = pa.RecordBatch.from_pydict({"_digest": [7, 8], "_text": ["xabc", "xab"]})
print([d for made in work(iter([batch])) for d in made.column("_digest").to_pylist()])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True
    )
    assert done.stdout.strip() == "[7]", done.stderr
