import random

import numpy as np
import pyarrow as pa
import pytest

from leafmill.llm import bloom, spans


def brute(rows, k):
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t or "")
    where = {}
    for i, ts in texts.items():
        for t in ts:
            for a in range(len(t) - k + 1):
                where.setdefault(t[a : a + k], set()).add(i)
    out = {}
    for i, ts in texts.items():
        cover = set()
        for t in ts:
            for a in range(len(t) - k + 1):
                if len(where[t[a : a + k]]) > 1:
                    cover.update(range(a, a + k))
        if cover and i is not None:
            out[i] = len(cover)
    return out


def run(spark, rows, k):
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, rec string")
    return {r.doc_id: r.shared_chars for r in spans.shared_chars(df, min_chars=k).collect()}


def test_against_every_window(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    hot = word(70)
    rows = []
    for i in range(60):
        t = word(rng.randint(0, 160))
        if i % 3 == 0:
            cut = rng.randint(0, 30)
            t += hot[cut : cut + rng.randint(20, 70)] + word(20)
        if i % 7 == 0 and rows:
            other = rng.choice(rows)[1]
            a = rng.randint(0, max(0, len(other) - 30))
            t = t[:40] + other[a : a + rng.randint(25, 60)] + t[40:]
        rows.append((i, t))
    rows += [(100, rows[6][1]), (101, "ab" * 60), (102, "x" + "ab" * 40), (103, "q" * 90), (104, "q" * 29), (105, None), (106, "")]
    for k in (30, 25, 2):
        assert run(spark, rows, k) == brute(rows, k)


def test_limits_of_length(spark):
    s = "".join(chr(97 + (i * i) % 23) for i in range(400))
    assert run(spark, [(1, "A" + s + "B"), (2, "C" + s + "D")], 400) == {1: 400, 2: 400}
    assert run(spark, [(1, "A" + s[:399] + "B"), (2, "C" + s[:399] + "D")], 400) == {}


def test_long_texts_are_taken_in_parts(spark, monkeypatch):
    rng = random.Random(2)
    a = "".join(rng.choice("abcdefgh ") for _ in range(spans.PIECE + 5000))
    assert run(spark, [(1, a), (2, a[:100] + "Z" + a[101:])], 400) == {1: len(a) - 101, 2: len(a) - 101}


def test_same_id_null_id_empty(spark):
    t = "abcdefghij" * 50
    assert run(spark, [(1, t), (1, t)], 400) == {}
    assert run(spark, [(None, t), (2, t)], 400) == {2: 500}
    assert run(spark, [], 400) == {}


def test_batches_keep_all_parts():
    b = pa.RecordBatch.from_pydict({"rec": ["a", "b"], "text": ["x" * 10, "y" * 10]})
    assert [p for _, _, ps in spans._batches(iter([b]), 4) for p in ps] == ["x" * 10, "y" * 10]


def _mixed(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    hot = word(90)
    return [(i if i % 5 else None, word(rng.randint(0, 90)) + (hot[rng.randint(0, 20) : rng.randint(50, 90)] if i % 3 == 0 else "") + word(30)) for i in range(45)]


@pytest.mark.parametrize("bits", [1 << 9, 1 << 5])
def test_an_index_larger_than_a_filter(spark, monkeypatch, bits):
    """In several ranges, and in more than are worth passes: the same result."""
    monkeypatch.setattr(bloom, "MOST_BITS", bits)
    rows = _mixed(4)
    blocks = sum(max(0, len(t)) // 15 for _, t in rows)
    assert (bloom.ranges_for(blocks) > spans.MOST_RANGES) == (bits == 1 << 5) and bloom.ranges_for(blocks) > 1
    assert run(spark, rows, 30) == brute(rows, 30)


def test_several_texts_of_one_record(spark):
    rows = [(1, "ab" * 40), (1, "xy" * 40), (None, "xy" * 30), (None, "ab" * 30), (None, "q" * 50), (2, "q" * 50), (2, "q" * 50)]
    got = run(spark, rows, 30)
    assert got == {1: 160, 2: 50}


def test_filter_lets_its_own_values_through(spark):
    values = [int(x) for x in np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 3000)]
    df = spark.createDataFrame([(v,) for v in values], "h long")
    got = bloom.build(df, len(values)).value
    assert len(bloom.passes(got, np.array(values).view(np.uint64))) == len(values)
    others = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 100_000).view(np.uint64)
    assert len(bloom.passes(got, others)) < 2500
    parts = [bloom.passes(got, np.array(values).view(np.uint64), r, 3) for r in range(3)]
    assert sorted(np.concatenate(parts).tolist()) == list(range(len(values)))
    for r in range(3):
        assert df.where(bloom.in_range(df.h, r, 3)).count() == len(parts[r])
