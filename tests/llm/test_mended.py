"""Cases that earlier versions of the operators lost."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from glintscan.llm import bpe_count, brown, common, decontaminate, mixing, sharding


def test_items_of_scripts_without_blanks(spark):
    rnd = random.Random(2)
    han = "".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(60))
    near = han[:20] + "缺" + han[21:40] + han[42:]
    thai = "".join(chr(rnd.randrange(0x0E01, 0x0E2F)) for _ in range(30))
    bench = spark.createDataFrame([("", han), ("t", thai), (None, "short 短")], "item_id string, text string")
    texts = ["前言" + han + "。后记", near, "x " + thai, han[:30], "plain words only", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(0, "", 0), (1, "", 3), (2, "t", 0)}
    kept = {r.doc_id for r in decontaminate.without_contaminated(docs, bench).collect()}
    assert kept == {3, 4, 5}


@pytest.mark.parametrize("block_words", [500_000, 2])
def test_short_items_match_whole(spark, block_words):
    items = [(1, "alpha"), (2, "beta gamma"), (3, "one two three four"), (4, ""), (5, "five words are enough here")]
    bench = spark.createDataFrame([(float(i), t) for i, t in items], "item_id double, text string")
    texts = ["Alpha, beta gamma", "beta x gamma", "zero one two three four five", "one two three", "five words are quite enough here", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = decontaminate.contaminated(docs, bench, min_words=1, block_words=block_words).collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in found} == {(0, 1.0, 0), (0, 2.0, 0), (2, 3.0, 0), (4, 5.0, 1)}
    usual = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, block_words=block_words).collect()}
    assert usual == {(4, 5.0)}
    kept = decontaminate.without_contaminated(docs, bench, min_words=1, block_words=block_words)
    assert {r.doc_id for r in kept.collect()} == {1, 3, 5}


def test_recall_by_length_and_edits(spark):
    rnd = random.Random(5)
    voc = ["v%d" % i for i in range(4000)]
    bench, docs, want = [], [], set()
    for size in (5, 6, 9, 14, 20, 40, 60):
        for edits in sorted({0, int(0.1 * size), int(0.2 * size + 1e-9)}):
            for _ in range(12):
                item = rnd.choices(voc, k=size)
                ws = list(item)
                for _ in range(edits):
                    p, kind = rnd.randrange(len(ws)), rnd.randrange(3)
                    ws[p : p + (kind != 2)] = ["new%d" % rnd.randrange(999)] * (kind != 1)
                n = len(bench)
                bench.append((n, " ".join(item)))
                docs.append((n, " ".join(rnd.choices(voc, k=30) + ws + rnd.choices(voc, k=30))))
                want.add((n, n))
    items = spark.createDataFrame(bench, "item_id int, text string")
    table = spark.createDataFrame(docs, "doc_id int, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table, items).collect()}
    assert len(got & want) >= 0.98 * len(want)


def test_exchange_never_lowers_the_likelihood(spark):
    rnd = random.Random(7)
    kinds = [["%s%d" % (k, i) for i in range(40)] for k in "abcd"]
    texts = [" ".join(rnd.choice(kinds[(i + rnd.randrange(2)) % 4]) for i in range(60)) for _ in range(150)]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = brown.word_counts(train, "text").cache()
    top = brown.frequent_words(counts, 200)
    vocabulary = brown.Vocabulary(brown.pa.array([r["word"] for r in top]), brown.np.array([r["n"] for r in top]), len(top), 6, 4)
    profiles = brown.bigram_profiles(train, "text", vocabulary).cache()
    start, _ = brown.exchange(profiles, vocabulary, 0)
    begin = brown.log_likelihood(brown.class_matrix(profiles, start, 11))
    seen: list[float] = []
    classes, matrix = brown.exchange(profiles, vocabulary, 3, seen)
    assert [begin, *seen] == sorted([begin, *seen]) and seen[-1] > begin + 100
    assert brown.log_likelihood(brown.class_matrix(profiles, classes, 11)) == pytest.approx(brown.log_likelihood(matrix))


def test_frequent_words_of_a_full_bin(spark):
    counts = spark.createDataFrame([("w%02d" % i, 5) for i in range(30)] + [("top", 50), ("\n", 90)], "word string, n bigint")
    assert [r["word"] for r in brown.frequent_words(counts, 4)] == ["top", "w00", "w01", "w02"]
    assert [r["word"] for r in brown.frequent_words(counts.where("n = 5"), 2)] == ["w00", "w01"]
    assert len(brown.frequent_words(counts, 100)) == 31


def test_best_classes_of_many_words():
    rnd = brown.np.random.default_rng(3)
    k, v = 7, 40
    text = rnd.integers(0, v, 3000)
    text[rnd.integers(1, 3000, 200)] = 0  # one word often, also after itself
    classes = rnd.integers(0, k - 1, v)
    m = brown.np.zeros((k, k))
    brown.np.add.at(m, (classes[text[:-1]], classes[text[1:]]), 1)
    near = brown.np.zeros((v, 2 * k + 1), int)
    for x, y in zip(text[:-1], text[1:]):
        for w, cell in [(x, 2 * k)] if x == y else [(y, classes[x]), (x, k + classes[y])]:
            near[w, cell] += 1
    want = [brown.best_class(m, classes[w], near[w, :k], near[w, k:-1], near[w, -1], k - 1) for w in range(v)]
    owner, cell = brown.np.nonzero(near)
    assert brown.best_classes(m, classes, owner, cell, near[owner, cell], k - 1).tolist() == want != classes.tolist()


def test_equal_profiles_are_weighed_once(monkeypatch):
    rnd = brown.np.random.default_rng(4)
    k, v = 7, 600
    m = rnd.integers(0, 50, (k, k)).astype(float)
    own = rnd.integers(0, k - 1, v)
    near = brown.np.zeros((v, 2 * k + 1), int)
    for w in range(v):  # the first words have more neighbours, all others one on each side
        for _ in range(1 + 9 * (w < 40)):
            near[w, rnd.integers(0, k)] += 1
            near[w, k + rnd.integers(0, k)] += 1
    near[50] = 0
    near[50, 2 * k], near[50, 0], near[50, 2 * k - 1] = 1, 1, 1
    near[51, :k] *= 2
    n = near[:, :k].sum(1) + near[:, -1]
    owner, cell = brown.np.nonzero(near)
    seen, plain = [], brown.best_classes
    monkeypatch.setattr(brown, "PORTIONS", 1)
    monkeypatch.setattr(brown, "best_classes", lambda matrix, own, *a: seen.append(len(own)) or plain(matrix, own, *a))
    got = brown.exchanged(m, own, n, owner, cell, near[owner, cell], 1.0)
    assert got.tolist() == plain(m, own, owner, cell, near[owner, cell], k - 1).tolist() != own.tolist()
    assert len(seen) == 1 and seen[0] <= 42 + (k - 1) * k * k < v - 100


def test_crcs_of_all_words_at_once():
    words = ["left out", "a", "", "é" * 20, "字" * 30, "x" * 64, "y" * 65, "z" * 3000, "ab", "ab"]
    array = brown.pa.array(words)
    for part in (slice(1, 10), slice(0, 10), slice(4, 5), slice(2, 3), slice(0, 0)):
        got = brown.crcs(array.slice(part.start, part.stop - part.start))
        assert got.tolist() == [zlib.crc32(w.encode()) for w in words[part]]


@pytest.mark.parametrize("most", [1 << 20, 5])
def test_bigrams_of_blocks(spark, most):
    rnd = random.Random(6)
    texts = [" ".join("Ww%d" % rnd.randrange(9) for _ in range(i % 30)) for i in range(60)] + [None, "  "]
    rows = spark.createDataFrame([(i, t, i % 4 > 0) for i, t in enumerate(texts)], "doc_id bigint, text string, train boolean")
    v = brown.Vocabulary(brown.pa.array(["ww3", "ww1"]), brown.np.array([9, 8]), 2, 2, 3)
    want = {}
    for t in (t for i, t in enumerate(texts) if i % 4):
        words = [*(t or "").lower().split(), "\n"]
        units = [{"ww3": 0, "ww1": 1, "\n": 5}.get(w, 2 + zlib.crc32(w[-2:].encode()) % 3) for w in words]
        for x, y in zip([5, *units], units):
            for key in ((y, 0, x), (x, 1, y)):
                want[key] = want.get(key, 0) + 1
    blocks = brown.text_blocks(rows.repartition(3), v, 2)
    got = brown.block_profiles(blocks, v, most).collect()
    assert len(got) == len({(r.unit, r.side) for r in got})
    found = {}
    for r in got:
        for x in r.near:
            found[r.unit, r.side, x.other] = found.get((r.unit, r.side, x.other), 0) + x.n
    assert found == want
    assert brown.block_profiles(brown.text_blocks(rows.limit(0), v, 2), v).count() == 0


def test_words_beyond_the_clustered_move_too(spark):
    rnd = random.Random(9)
    kinds = [["%s%dzz" % (k, i) for i in range(300)] for k in "ab"]  # all end alike
    texts = [" ".join(rnd.choice(kinds[i % 2]) for i in range(40)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = docs.withColumn("train", ~brown.held_out(F.col("doc_id")))
    counts = brown.word_counts(rows.where("train"), "text").cache()
    seen: list[float] = []
    model, words = brown.train(rows, counts, 4, 4, 2, 3, 3, 0.9, seen)
    assert seen == sorted(seen) and words.matrix.sum() == counts.agg(F.sum("n")).first()[0]
    assert words.types.sum() == counts.count() - 5 and (words.types > 0).sum() > 1
    # A plain count of the class bigrams, and of the scores, from the classes of all words.
    replies = words.replies.where("block >= 0").toArrow()
    classes, number = {}, {r.word: r.n for r in counts.collect()}
    for block in words.blocks.toArrow().to_batches(1):
        block = brown.pa.Table.from_batches([block])
        here = brown.Block.of(block, replies.filter(brown.pc.equal(replies["block"], block["block"][0])), model.vocabulary)
        of = here.classes(model.classes[:4], 5, words.level).tolist()
        classes.update(zip([*model.vocabulary.words.to_pylist(), "\n", *here.words.to_pylist()], of))
        assert here.n.tolist() == [number.get(w, 0) for w in here.words.to_pylist()]
    matrix = brown.np.zeros((6, 6))
    scores = {r.doc_id: r for r in brown.text_scores(words, model).collect()}
    for i, text in enumerate(texts):
        tokens, total = ["\n", *text.split(), "\n"], 0.0
        for before, word in zip(tokens, tokens[1:]):
            b, c, n = classes[before], classes[word], number.get(word, 0)
            matrix[b, c] += not zlib.crc32(b"%d" % i) % 5 == 1
            inside = model.transition[b, c] * (n - (word != "\n") * brown.DISCOUNT) / model.class_tokens[c] if n else model.unknown[b]
            total += math.log10(0.9 * inside + 0.1 * (n + 0.5) / (model.train_tokens + 0.5 * (model.types + 1)))
        assert scores[i].score == pytest.approx(total)
    assert (matrix == words.matrix).all()


def test_numbered(spark):
    df = spark.createDataFrame([("a", 3, 2), ("b", 0, 25), ("c", 7, 7)], "k string, f bigint, l bigint")
    got = sorted((r.k, r.x) for r in common.numbered(df, "f", "l", "x", step=10).collect())
    assert got == [("b", i) for i in range(26)] + [("c", 7)]


def test_very_many_equal_rows(spark):
    n = 3_000_000
    docs = spark.range(n).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"))
    slots = sharding.sharded(docs).agg(F.count("*"), F.countDistinct("slot"), F.max("slot"), F.countDistinct("shard")).first()
    assert tuple(slots) == (n, n, n - 1, 1)
    taken = mixing.mixed(docs).agg(F.count("*"), F.sum("taken")).first()
    assert tuple(taken) == (n, 2 * n)


def test_recent_keeps_what_is_used():
    held = bpe_count.Recent(3)
    for k in "abc":
        held[k] = k
    assert held.new("abcd") == ["d"] and dict(held) == {"a": "a", "b": "b", "c": "c"}
    held["d"] = "d"
    assert held.new("ae") == ["e"] and "a" in held and "b" not in held
