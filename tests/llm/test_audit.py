"""The filter audit against a plain version."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from glintscan.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string, counts string, fails int, quality int"


def _counts(text):
    ws = WORD.findall(text or "")
    text = text or ""
    return [len(ws), len(set(ws)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))]


def _texts():
    rnd = random.Random(4)
    voc = ["w%d" % i for i in range(60)] + ["Été", "ABC", "漢字" * 40, "x" * 8, "x" * 9, "x" * 16, "x" * 63, "x" * 64, "x" * 65]
    blanks = [" ", "\t", "\n", "  ", "\r\n", "\x0b", "\x0c"]
    out = ["".join(rnd.choice(voc) + rnd.choice(blanks) for _ in range(rnd.randrange(1, 130))) for _ in range(80)]
    out += ["", None, " ", "a", "A" * 60, "a\x00b a\x00", "50% off #1 " * 20, " lead", " x  y", "𝄞 𝄞 é"]
    out += [" ".join("t%d" % i for i in range(n)) for n in (49, 50, 51)]
    return out + out[:5] + out[3:6]


def test_counts(monkeypatch):
    texts = _texts()
    want = [_counts(t) for t in texts]
    assert filter_audit.measured(pa.array(texts, pa.string())).tolist() == want
    assert filter_audit.measured(pa.array(texts, pa.large_string())).tolist() == want
    assert filter_audit.measured(pa.array(texts, pa.string()).slice(7, 20)).tolist() == want[7:27]
    assert filter_audit.measured(pa.array([], pa.string())).tolist() == []
    whole = "".join(t or "" for t in texts)
    for block in (1, 2, 3, 7, 64, 1000):  # long texts in blocks, cut anywhere
        monkeypatch.setattr(filter_audit, "BLOCK", block)
        few = texts[:12] + texts[80:95] if block < 7 else [*texts, whole, whole + "x"]
        assert filter_audit.measured(pa.array(few, pa.string())).tolist() == [_counts(t) for t in few]


def test_hash_table_confirms_matches(monkeypatch):
    monkeypatch.setattr(filter_audit, "_mixed", lambda x: np.zeros_like(x))  # every word collides
    texts = ["a b a cc cc dddddddddd ddddddddde dddddddddd", "a b"]
    assert filter_audit.measured(pa.array(texts))[:, 1].tolist() == [5, 2]


def _audit(rows, labels):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    docs = defaultdict(list)
    for i, t, source, *_ in rows:
        n, distinct, capitals, chars, symbols = _counts(t)
        fails = [n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * chars, symbols > 0, i is not None and i > first[t or ""]]
        docs[source or ""].append(({f for f, x in zip("ABCDE", fails) if x}, i in good, i in toxic))
    out, shapley = [], Counter()
    for part, held in docs.items():
        for order in map("".join, permutations("ABCDE")):
            left = held
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                late = sum(f in d[0] for d in held) - len(gone)
                left = [d for d in left if f not in d[0]]
                alone = sum(d[0] == {f} for d in held)
                shapley[part, f] += len(gone)
                out.append((part, order, step, len(left), len(gone), late, alone, sum(d[1] for d in gone), sum(d[2] for d in gone)))
    return {(*r, shapley[r[0], r[1][r[2] - 1]]) for r in out}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    texts = _texts()
    out = [(i, t, rnd.choice(["s1", "s2", "", None]), "x", 1, 5) for i, t in enumerate(texts)]
    out += [(None, t, "s1", "x", 1, 5) for t in (texts[0], texts[0], "only here", None)]
    out += [(500 + i, texts[2], "s2", "x", 1, 5) for i in range(40)] + [out[0], out[0], out[9]]
    return out


def test_audit(spark, rows):
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 520, 3)]
    labels += [(3, 1, None), (3, None, 1), (6, 0, 0), (6, 0, 0), (None, 1, 1), (10**6, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id bigint, quality int, toxic int, source string")
    got = filter_audit.audit(docs, marks).collect()
    assert {tuple(r) for r in got} == _audit(rows, [r for r in labels if r[0] is not None])
    assert len(got) == 3 * 600
    empty = spark.createDataFrame([], SCHEMA)
    assert filter_audit.audit(empty, marks).count() == 0
    bare = {tuple(r) for r in filter_audit.audit(docs, marks.limit(0)).collect()}
    assert bare == _audit(rows, [])
    names = spark.createDataFrame([("b", "t", "s"), ("a", "t", "s"), (None, "t", "s")], "doc_id string, text string, source string")
    marked = spark.createDataFrame([("a", 1, 0)], "doc_id string, quality int, toxic int")
    first = filter_audit.audit(names, marked).where("filter_order = 'EABCD' AND step = 1").first()
    assert (first.kept, first.removed, first.good_lost) == (2, 1, 0)


def test_transducer_state_passes_on():
    raw = np.frombuffer(b"ab cd", np.uint8)
    ends = (np.array([0]), np.array([5]))
    first, last, counts, state = filter_audit.transduced(raw, *ends, state=1)
    assert first.tolist() == [3] and last.tolist() == [2, 5] and counts[0][0] >> 32 == 1 and state == 1
