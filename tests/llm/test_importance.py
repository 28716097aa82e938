"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from glintscan.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, weight string, rank int, row bigint"


def _features(text, max_n):
    ws = WORD.findall((text or "").translate(LOW))
    return ws, [" ".join(ws[i : i + n]) for n in range(1, max_n + 1) for i in range(len(ws) - n + 1)]


def _bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


def _resampled(rows, target, max_n, buckets, percent, min_words):
    s = Counter(_bucket(f, buckets) for _, t in rows for f in _features(t, max_n)[1])
    t = Counter(_bucket(f, buckets) for x in target for f in _features(x, max_n)[1])
    n_s, n_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * n_s / ((s[b] + 1) * n_t))) for b in range(buckets)}
    out = []
    for i, text in rows:
        ws, features = _features(text, max_n)
        weight = sum(gain[_bucket(f, buckets)] for f in features)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(ws)))
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {}
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        ranks.setdefault(r[:4], []).append(k)
    return sorted(map(str, ((*r[:4], (ranks.get(r[:4]) or [None]).pop(0) if ranks.get(r[:4]) else None) for r in out)))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(6)
    voc = ["w%d" % i for i in range(150)] + ["the", "of", "Été", "日本", "x" * 90] * 9
    out = [(i, rnd.choice([" ", ", ", "-", "\n"]).join(rnd.choices(voc, k=rnd.randrange(0, 70)))) for i in range(150)]
    out += [(200, None), (201, ""), (None, " ".join(voc[:30])), (None, "w1 W2"), (202, "!?  . "), (203, "\x00a\x00b")]
    out += [(204, " ".join(rnd.choices(voc, k=9000)))]
    return out + [out[3]] * 30 + [out[5]] * 2


@pytest.mark.parametrize("max_n, buckets, words, pairs", [(1, 10_000, 40, 9), (2, 97, 25, 60), (3, 70_000, 1, 1), (1, 50, 0, 0)])
def test_resampled(spark, rows, max_n, buckets, words, pairs):
    target = ["The W1 of w2, w3", None, "", "été 日本 w5 w5 w6", "nowhere else"]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(5)
    bench = spark.createDataFrame([(t, "x") for t in target], "text string, buckets string")
    options = dict(max_n=max_n, buckets=buckets, percent=30, min_words=20)
    got = importance.resampled(docs, bench, head_words=words, head_pairs=pairs, **options).collect()
    assert sorted(str(tuple(r)) for r in got) == _resampled(rows, target, **options)


def test_odd_tables(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    none = spark.createDataFrame([], "text string")
    got = importance.resampled(docs, none).collect()
    assert sorted(str(tuple(r)) for r in got) == _resampled(rows, [], 1, 10_000, 10, 20)
    assert importance.resampled(docs.limit(0), none).count() == 0
    named = spark.createDataFrame([("b", "w " * 30), ("a", "w " * 30)], "doc_id string, text string")
    got = importance.resampled(named, none, percent=50).where("rank = 1").collect()
    assert len(got) == 1


def test_frequent_items_keep_a_count():
    rnd = random.Random(1)
    stream = ["hot%d" % (i % 5) for i in range(4000)] + ["cold%d" % rnd.randrange(10**9) for _ in range(6000)]
    rnd.shuffle(stream)
    held = importance.Frequent(10)
    for i in range(0, len(stream), 50):
        counts = Counter(stream[i : i + 50])
        held.add(list(counts), list(counts.values()))
        assert len(held.counts) <= 10 * importance.SUMMARY
    assert {w for w, _ in held.top()} >= {"hot%d" % i for i in range(5)}


def test_head_changes_nothing():
    texts = pa.array(["a b a b c", "b a", "", "c"])
    head = importance.Head(
        pa.array(["a", "b"]), importance.np.array([zlib.crc32(b"a"), zlib.crc32(b"b")], "u4"),
        importance.np.array([1]), importance.np.array([zlib.crc32(b"a b")], "u4"),
    )
    for given in (importance.NO_HEAD, head):
        levels = list(importance.feature_states(texts, 3, given))
        for n, (states, sizes) in enumerate(levels, 1):
            want = [" ".join(t.split()[i : i + n]) for t in texts.to_pylist() for i in range(len(t.split()) - n + 1)]
            assert states.tolist() == [zlib.crc32(w.encode()) for w in want] and sizes.sum() == len(want)


def test_most_frequent_takes_whole_bins_then_any(spark):
    counts = spark.createDataFrame([("a", 900), ("b", 900), ("c", 50), ("d", 50), ("e", 50), ("f", 1)], "word string, n bigint")
    for most, sure in ((0, ""), (1, ""), (2, "ab"), (4, "ab"), (5, "abcde"), (6, "abcdef"), (9, "abcdef")):
        got = importance.most_frequent(counts, "word", most)
        assert len(got) == min(most, 6) == len(set(got)) and set(sure) <= set(got)
