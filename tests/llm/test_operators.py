"""Each pipeline operator against a plain version, on small tables with odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from glintscan.llm import (
    bpe_count,
    brown,
    chat,
    decontaminate,
    licences,
    mixing,
    packed_ids,
    quality,
    sharding,
    simhash,
)

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, word string, n bigint"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _texts():
    rnd = random.Random(5)
    vocabulary = ["the", "of", "Été", "straße", "x1", "a,b", "mit", "license", "under", "Zeile"]
    vocabulary += ["w%d" % i for i in range(200)]
    out = [" ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 120))) for _ in range(120)]
    out += [out[3], out[3] + " more", out[4].upper(), "", "   \t\n", None, "one", "one two"]
    out += ["same line here\n" * 30, "a b c d e f g h i j " * 12, "# $ % & | <x> " * 9]
    out += ["Under the MIT License. Apache License, Version 2.0; CC BY-NC 4.0, under the mit license"]
    out += ["GNU General Public License, version 3", "<|endoftext|> x <|endoftext|>", "   y  z"]
    out += [" ".join(rnd.choices(vocabulary, k=30_000))]
    return out


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    out = [(i, t, "en", "s%d" % (i % 5) if i % 9 else None, None, "x", 7) for i, t in enumerate(texts)]
    out[1] = (None, *out[1][1:])  # a null id
    return out + [out[2]] * 3 + [out[7]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(text, low=False):
    text = text or ""
    return WORD.findall(text.translate(LOW) if low else text)


def _key(x):
    return tuple((v is not None, v) for v in x)


def _same(got, want):
    assert sorted(map(_key, got)) == sorted(map(_key, want))


# ---- 10: quality rules


def _quality(text):
    text = text or ""
    ws = _words(text)

    def covered(n):
        grams = [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)]
        count = Counter(grams)
        return {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(n)}

    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, _words(line)))
            seen.add(line)
    chars, repeat = sum(map(len, ws)), len(covered(8))
    failed = len(ws) < 20 or 100 * repeat > 30 * len(ws)
    good = dup_chars <= quality.MAX_LINE_SHARE * chars and all(
        sum(len(ws[i]) for i in covered(n)) <= share * chars for n, share in quality.MAX_SHARE.items()
    )
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(ws), chars, symbols, dup, repeat, failed, not failed and good


def test_quality(docs, rows, empty):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = quality.repetition(docs).select(*columns, "base_failed", "kept").collect()
    _same(got, [(r[0], *_quality(r[1])) for r in rows])
    _same(quality.keep_good(docs).collect(), [r for r in rows if _quality(r[1])[-1]])
    assert quality.repetition(empty).count() == 0


def test_quality_hash_collision(monkeypatch):
    monkeypatch.setattr(quality, "_scrambled", lambda ids: np.zeros(len(ids), np.uint64))
    text = "a b c d e f g h i j k l m n o p a b c d e f g h i x"
    got = quality.measured(pa.array([text, "q " * 4]), (5, 8))
    assert got["n_repeat_words"].tolist() == [18, 0]
    assert got["dup_chars_5"].tolist() == [18, 0]


# ---- 4: SimHash


def _fingerprint(text):
    ws = [w.encode() for w in _words(text, low=True)]
    grams = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([b" ".join(ws)] if ws else [])
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(nodes, linked):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                up[top(a)] = top(b)
    return {n: top(n) for n in nodes}


def _groups(rows):
    fp = [_fingerprint(r[1]) for r in rows]
    label = _components(set(fp), lambda a, b: (a ^ b).bit_count() <= 3)
    first = {}
    for r, f in zip(rows, fp):
        if r[0] is not None:
            first[label[f]] = min(r[0], first.get(label[f], r[0]))
    return [(r[0], "%016x" % f, first.get(label[f])) for r, f in zip(rows, fp)]


def test_simhash(docs, rows, empty):
    _same(simhash.near_groups(docs).collect(), _groups(rows))
    assert simhash.near_groups(empty).count() == 0
    want = []
    for r, g in zip(rows, _groups(rows)):
        if g[0] == g[2] and r not in want:
            want.append(r)
    _same(simhash.keep_first(docs).collect(), want)


def test_simhash_groups_that_share_an_id(spark):
    rnd = random.Random(3)
    one, two, three, four, five = (" ".join("w%d" % rnd.randrange(10**6) for _ in range(80)) for _ in range(5))
    rows = [(None, one), (None, two), (None, two), (7, three), (7, four), (8, four), (9, five), (None, five)]
    want = [(None, one), (None, two), (7, three), (7, four), (9, five)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    _same(simhash.keep_first(table).collect(), want)


@pytest.mark.parametrize("dense", [1, 4, 10_000])
def test_simhash_links(spark, dense):
    rnd = random.Random(dense)
    centres = [rnd.getrandbits(64) for _ in range(3)]
    points = set(centres)
    for c in centres:
        for _ in range(60):
            p = c
            for _ in range(rnd.randrange(1, 6)):
                p ^= 1 << rnd.randrange(64)
            points.add(p)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in points}
    nodes = spark.createDataFrame([(s,) for s in signed.values()], "fp bigint")
    edges = {tuple(r) for r in simhash.links(nodes, dense_from=dense).collect()}
    want = _components(set(signed.values()), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    got = _components(set(signed.values()), lambda a, b: (a, b) in edges or (b, a) in edges)
    split = lambda label: {frozenset(n for n in label if label[n] == x) for x in label.values()}
    assert split(got) == split(want)


# ---- 2: decontamination


def _edits(item, words):
    """Fewest edits from the item to any run of the words."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination(spark, empty):
    rnd = random.Random(11)
    plain = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    voc = ["v%d" % i for i in range(300)] + ["the", "of", "é"] * 20
    items = [(i, " ".join(rnd.choices(voc, k=n))) for i, n in enumerate([14, 20, 36, 59, 8, 5, 40, 25])]
    items += [(20, "the of"), (21, ""), (22, None), (23, items[0][1])]
    docs = []
    for d in range(160):
        i = rnd.randrange(8)
        ws = items[i][1].split()
        for _ in range(rnd.choice([0, 0, int(0.2 * len(ws)), int(0.2 * len(ws)) + 4])):
            p, kind = rnd.randrange(len(ws)), rnd.randrange(3)
            ws[p : p + (kind != 2)] = ["new%d" % rnd.randrange(999)] * (kind != 1)
        text = rnd.choices(voc, k=rnd.randrange(30)) + ws + rnd.choices(voc, k=rnd.randrange(30))
        docs.append((d, rnd.choice([" ", ", ", "\n"]).join(text).title() if d % 3 else " ".join(text)))
    docs += [(None, None), (None, ""), (900, " ".join(rnd.choices(voc, k=40_000)) + " " + items[2][1]), docs[0]]
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, item_id string, edits bigint")
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id bigint, text string, doc_id bigint")
    want = Counter()
    for d, text in docs:
        ws = plain.findall((text or "").translate(LOW))
        for i, item in items:
            m = plain.findall((item or "").translate(LOW))
            if len(m) >= 5 and d != 900 or i == 2:
                if (e := _edits(m, ws)) <= int(0.2 * len(m) + 1e-9):
                    want[d, i, e] += 1
    got = Counter((r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminated(table, bench).collect())
    assert not got - want
    assert sum((got & want).values()) >= 0.97 * sum(want.values())
    blocks = decontaminate.contaminated(table, bench, block_words=20)
    assert Counter((r.doc_id, r.item_id, r.edits) for r in blocks.collect()) == got
    kept = Counter(r.doc_id for r in decontaminate.without_contaminated(table, bench).collect())
    assert kept == Counter(d for d, _ in docs if not any(d == g[0] for g in got))
    assert decontaminate.contaminated(empty.select("doc_id", "text"), bench).count() == 0
    assert decontaminate.contaminated(table, bench.limit(0)).count() == 0


def test_decontamination_of_items_cut_at_the_start(spark):
    words = ["v%d" % i for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    for cut in (1, 3, 8):
        table = spark.createDataFrame([(5, " ".join(words[cut:]))], "doc_id bigint, text string")
        got = [(r.doc_id, r.item_id, r.end_word, r.edits) for r in decontaminate.contaminated(table, bench).collect()]
        assert got == [(5, 1, 40 - cut, cut)]
        assert decontaminate.without_contaminated(table, bench).count() == 0


# ---- 1: mixing


def _targets(size, weights=(5, 2, 1), most=3):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(size.values()))
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * size[s]}
        if not over:
            return {**target, **{s: left * weight[s] / total for s in free}}
        for s in over:
            target[s] = float(most * size[s])
            left -= target[s]
        free -= over


@pytest.mark.parametrize("leaf, fan_in", [(4096, 1024), (8, 2)])
def test_mixing(docs, rows, empty, leaf, fan_in):
    size = Counter()
    for r in rows:
        size[r[3]] += len(_words(r[1]))
    target = _targets(size)
    narrow = docs.select(F.col("doc_id").alias("row_key"), "source", mixing.words(F.col("text")).alias("size"))
    plan = mixing.copies(narrow, leaf=leaf, fan_in=fan_in).collect()
    _same(plan, mixing.copies(narrow.repartition(3), leaf=leaf, fan_in=fan_in).collect())
    taken, largest = Counter(), Counter()
    for p in plan:
        assert 0 <= p.extra <= p.n and p["size"] * (p.whole + (p.extra > 0)) <= 3 * p["size"]
        assert math.isclose(p.target, target[p.source], rel_tol=1e-9) and p.source_size == size[p.source]
        taken[p.source] += p["size"] * (p.n * p.whole + p.extra)
        largest[p.source] = max(largest[p.source], p["size"])
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    got = mixing.mixed(docs)
    assert got.count() == len(rows) and mixing.mixed(empty).count() == 0
    times = Counter()
    for r in got.where("size > 0").collect():
        times[r.doc_id] += r.taken // r["size"]
    mixed = Counter(r.doc_id for r in mixing.mix(docs).collect() if _words(r.text))
    assert mixing.mix(docs).columns == docs.columns and sum(mixed.values()) > 0
    words = Counter()
    for r in mixing.mix(docs).collect():
        words[r.source] += len(_words(r.text))
    for s in size:
        assert abs(words[s] - target[s]) <= largest[s] / 2 + 1e-6


def test_pivot_keeps_shares_on_average():
    rnd = np.random.default_rng(1)
    size, share = rnd.integers(1, 40, 60), rnd.uniform(0.05, 0.95, 60)
    source = np.repeat([0, 1], 30)
    total = np.zeros(60)
    for _ in range(3000):
        total += mixing.pivot(source, size, share, rnd.integers(-(2**62), 2**62, 60), 0, False)
    assert np.abs(total / 3000 - share).max() < 0.05


# ---- 9: shards


def test_shards(docs, rows, empty):
    got = sharding.sharded(docs, slices=4).collect()
    want = [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows]
    _same([(r.doc_id, r["size"], r.text_crc32) for r in got], want)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 8) and r.law == "key" for r in got)
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert sharding.sharded(empty).count() == 0


def test_hash_tree_weights(spark):
    leaves = [("a", "r1", 0, 1.0), ("a", "r2", 1, 2.0), ("b", "r3", 2, 3.0), ("b", "r3", 3, 0.0), ("b", "r4", 4, 2.0)]
    ids = spark.range(40_000)
    share = {r["s"]: r["count"] / 40_000 for r in ids.groupBy(sharding.shard_of(["id"], leaves).alias("s")).count().collect()}
    assert 3 not in share
    for _, _, s, w in leaves:
        assert abs(share.get(s, 0) - w / 8) < 0.02
    # A heavier shard takes keys of its region from its neighbours, and of others only into its region.
    heavier = [(*x[:3], 4.0) if x[2] == 1 else x for x in leaves]
    moved = ids.select(sharding.shard_of(["id"], leaves).alias("o"), sharding.shard_of(["id"], heavier).alias("n"))
    pairs = {tuple(r) for r in moved.where("o <> n").distinct().collect()}
    assert all(n in (0, 1) for _, n in pairs) and (2, 4) not in pairs and (4, 2) not in pairs


# ---- 3: licences


def test_licences(docs, rows, empty):
    plain = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for r in rows:
        ws = plain.findall((r[1] or "").translate(LOW))
        at = [(i, label) for label, p in licences.BASE for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        labels = ",".join(sorted({x for _, x in at}))
        want.append((r[0], len(ws), len(at), min(places, default=None), max(places, default=None), labels))
    got = licences.scanned(docs).collect()
    _same([tuple(r)[:6] for r in got], want)
    by_text = {r.doc_id: (r.labels, r.score) for r in got}
    gpl = next(r[0] for r in rows if r[1] and r[1].startswith("GNU"))
    assert by_text[gpl] == ("gpl-3", 1.0)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert licences.scanned(empty).count() == 0


def test_licence_passages(spark):
    texts = [p for _, p, _ in licences.PASSAGES]
    texts += [texts[0].replace("hereby", "kindly"), texts[0].replace("software", "thing"), "mit " * 300]
    table = spark.createDataFrame([(i, "xx " * i + t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in licences.scanned(table).collect()}
    for i, (label, _, _) in enumerate(licences.PASSAGES):
        assert label in got[i].labels.split(","), (label, got[i])
    n = len(licences.PASSAGES)
    assert got[n].labels == "mit" and got[n + 1].labels == "" and got[n + 2].score == 0.0


# ---- 5: preference pairs


def test_preference_pairs(spark):
    turn = lambda r, t: {"role": r, "text": t}
    a = [turn("user", "q"), turn("assistant", "é1"), turn("user", None)]
    b = [turn("user", "q"), turn("assistant", "two"), turn(None, "x"), turn("assistant", "")]
    kind = "conv_id bigint, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string"
    table = spark.createDataFrame([(1, a, b, "p"), (2, a, a, "p"), (3, None, b, "p"), (None, [], None, "p")], kind)
    got = {r.conv_id: r for r in chat.preference_pairs(table).collect()}
    r = got[1]
    assert r.n_common == 1 and r.prompt == "<|im_start|>user\nq<|im_end|>\n"
    assert [(r.prompt + r.chosen)[s["from"] : s["to"]] for s in r.chosen_mask] == ["é1<|im_end|>\n"]
    assert [(r.prompt + r.rejected)[s["from"] : s["to"]] for s in r.rejected_mask] == ["two<|im_end|>\n", "<|im_end|>\n"]
    assert got[2].n_common == 3 and got[2].chosen == got[2].rejected == "" and got[2].chosen_mask == []
    assert got[3].prompt == "" and got[3].chosen == "" and len(got[3].rejected_mask) == 2
    assert got[None].prompt == got[None].rejected == ""
    assert chat.preference_pairs(table.limit(0)).count() == 0


def test_swapped_pairs(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b")]
    rows += [(2, 1, "assistant", "a"), (2, 0, "user", "q"), (3, 0, "user", "q"), (None, 0, "assistant", "a")]
    rows += [(4, None, None, None), (4, 1, "assistant", "a"), (4, 1, "assistant", "a")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: [[t.text for t in x] for x in (r.chosen, r.rejected)] for r in chat.swapped_pairs(table).collect()}
    assert got == {1: [["q", "a", "r", "b"], ["q", "b", "r", "a"]], 2: [["q", "a"], ["q"]], 4: [[None, "a", "a"]] * 2}


# ---- 6: class bigrams


def test_class_bigrams(docs, rows, empty):
    small = {"clustered": 40, "frequent": 90, "classes": 6, "endings": 8, "sweeps": 3}
    got = brown.scored(docs, **small)
    tokens = [[*_words(r[1], low=True), "\n"] for r in rows]
    held = [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 1 for r in rows]
    count = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(count.values()), len(count)
    want = [
        (r[0], h, len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6))
        for r, t, h in zip(rows, tokens, held)
    ]
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("b")]
    _same(got.select(*columns).collect(), want)
    assert brown.scored(empty).count() == 0
    only = brown.scored(docs.where("doc_id = 1 OR doc_id IS NULL AND false"), **small).collect()
    assert all(r.train_tokens >= 0 for r in only)


def test_class_model_is_a_distribution_and_beats_unigram(spark):
    rnd = random.Random(2)
    nouns, verbs = ["n%d" % i for i in range(30)], ["v%d" % i for i in range(30)]
    texts = [" ".join(w for _ in range(20) for w in (rnd.choice(nouns), rnd.choice(verbs))) for _ in range(200)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    total = brown.scored(table, classes=4, clustered=60, sweeps=6).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert total[0] > total[1] + 100  # half of the words are ruled out by the class before
    train = table.where(~brown.held_out(F.col("doc_id")))
    counts = brown.word_counts(train, "text").cache()
    m = brown.train_model(train, "text", counts, 60, 100, 4, 8, 6, 0.9)
    by = {r["word"]: r["n"] for r in counts.collect()}
    words = m.vocabulary.words.to_pylist()
    for before in set(m.classes.tolist()):
        p = sum(
            m.weight * m.transition[before, m.classes[i]] * (by[w] - brown.DISCOUNT) / m.class_tokens[m.classes[i]]
            + (1 - m.weight) * m.base(by[w]) for i, w in enumerate(words)
        )
        p += m.weight * m.transition[before, -1] + (1 - m.weight) * m.base(by["\n"])
        p += m.weight * m.unknown[before] + (1 - m.weight) * m.base(0)
        assert p == pytest.approx(1 - m.weight * m.transition[before][m.class_tokens == 0].sum(), abs=1e-9)


def test_exchange_move_is_the_best():
    rnd = np.random.default_rng(4)
    text = rnd.integers(0, 12, 600)
    classes = rnd.integers(0, 3, 12)

    def likelihood(cls):
        m = np.zeros((3, 3))
        np.add.at(m, (cls[text[:-1]], cls[text[1:]]), 1)
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(m) - f(m.sum(0)) - f(m.sum(1))

    m = np.zeros((3, 3))
    np.add.at(m, (classes[text[:-1]], classes[text[1:]]), 1)
    for w in range(12):
        after, before = np.zeros(3), np.zeros(3)
        for x, y in zip(text[:-1], text[1:]):
            after[classes[y]] += x == w and y != w
            before[classes[x]] += y == w and x != w
        alone = float(sum(x == y == w for x, y in zip(text[:-1], text[1:])))
        got = brown.best_class(m, classes[w], before, after, alone, 3)
        scores = []
        for c in range(3):
            moved = classes.copy()
            moved[w] = c
            scores.append(likelihood(moved))
        assert scores[got] == pytest.approx(max(scores))


# ---- 7 and 8: tokens


def _odd_texts(n):
    rnd = random.Random(3)
    pool = [chr(rnd.randrange(1, 0x3000)) for _ in range(200)] + list(" \n\t\u0085  'sdlleabcÀÉßİΣ.,;!$́")
    pool += ["<|endoftext|>", "<|ENDOFTEXT|>", " " * 5, "aaaa", "\U0001f600", "It's", "12", " ", " ", "\n"] * 5
    return ["".join(rnd.choices(pool, k=rnd.randrange(40))) for _ in range(n)] + ["ab" * 5000, "a" * 3000]


def test_token_counts(spark, docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = bpe_count.token_counts(docs, path).collect()
    n = {t: len(library.encode(t or "", add_special_tokens=False).ids) for t in {r[1] for r in rows}}
    _same(got, [(r[0], len((r[1] or "").encode()), n[r[1]], n[r[1]] > 512) for r in rows])
    table = bpe_count.merges(path)
    for t in _odd_texts(1500):
        assert table.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)
    assert bpe_count.token_counts(empty, path).count() == 0


def test_packed_ids(spark, docs, rows, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    out = str(tmp_path / "ids")
    packed_ids.write_ids(docs, out, path, block_ids=500)
    got = packed_ids.read_docs(spark, out).orderBy("start").collect()
    encoded = {t: [*library.encode(t or "", add_special_tokens=False).ids, 1] for t in {r[1] for r in rows}}
    crc = {t: zlib.crc32(np.array(e, "<u4").tobytes()) for t, e in encoded.items()}
    _same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], [(r[0], len(encoded[r[1]]), crc[r[1]]) for r in rows])
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    first = spark.read.parquet(out).where("block = 1").first()
    whole = packed_ids.unpack(bytes(first.packed), 16, 0, first.n_ids)
    assert packed_ids.read_range(spark, out, first.part, 1, 3, 9).tolist() == whole[3:9].tolist()
    packed_ids.write_ids(empty, str(tmp_path / "none"), path)
    assert packed_ids.read_docs(spark, str(tmp_path / "none")).count() == 0


def test_word_ids_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, texts = Tokenizer.from_file(path), _odd_texts(1500)
    ids, sizes = packed_ids.WordIds(path).encode(pa.array(texts), 1)
    for t, got in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
        assert got.tolist() == [*library.encode(t, add_special_tokens=False).ids, 1], repr(t)


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 20])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 70_001, dtype=np.uint32)
    packed = packed_ids.pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    for i, j in ((0, 70_001), (5, 5), (65_530, 65_560), (70_000, 70_001)):
        assert packed_ids.unpack(packed, bits, i, j).tolist() == ids[i:j].tolist()
