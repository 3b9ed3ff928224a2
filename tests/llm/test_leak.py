import random
import re

import numpy as np

from leafmill.llm import leak
from leafmill.llm.arrays import word_hashes

SAID = re.compile(r"[^\W_]+")


def brute(docs, items, n):
    out = set()
    for d, t in docs:
        w = SAID.findall((t or "").lower())
        have = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i, q in items:
            u = SAID.findall((q or "").lower())
            if any(tuple(u[a : a + n]) in have for a in range(len(u) - n + 1)):
                out.add((d, i))
    return out


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item string"), spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, doc string")


def test_suffix_array_sorts_suffixes():
    rng = np.random.default_rng(3)
    for n, depth in ((200, 12), (1000, 5), (7, 3), (1, 4)):
        x = rng.integers(1, 4, n)
        order = leak.suffix_array(x, depth)
        keys = [tuple(x[i : i + depth]) + (0,) * max(0, depth - (n - i)) for i in order]
        assert keys == sorted(keys) and sorted(order) == list(range(n))


def test_against_every_window(spark):
    rng = random.Random(1)
    vocab = ["Ab", "cd", "e9", "FG", "hé", "ij", "k"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.randint(5, 30))) for i in range(25)] + [(90, None), (91, ""), (92, "one two"), (None, say(20))]
    docs = []
    for i in range(80):
        t = say(rng.randint(0, 60))
        if i % 2:
            q = (rng.choice(items[:25])[1]).split()
            a = rng.randint(0, 6)
            t += ", " + "--".join(q[a : a + rng.randint(8, 20)]).upper() + "\n" + say(5)
        docs.append((i, t))
    docs += [(None, items[3][1]), (200, None), (201, ""), (202, "§§ … !"), (5, items[4][1])]
    d, q = frames(spark, docs, items)
    for n in (12, 4, 7):
        got = {(r.doc, r.item) for r in leak.leaked_pairs(d, q, min_words=n).collect()}
        assert got == brute(docs, items, n)
    one_by_one = {(r.doc, r.item) for r in leak.leaks(d, q, min_words=7, block_chars=1).collect()}
    assert one_by_one == brute(docs, items, 7)
    bad = {x for x, _ in brute(docs, items, 12)}
    assert sorted(str(r.doc_id) for r in leak.without_leaks(d, q).collect()) == sorted(str(i) for i, _ in docs if i not in bad)


def test_longest_match_and_place(spark):
    q = "a b c d e f g h i j k l m n o"
    docs, items = frames(spark, [(1, "zz. " + q.replace(" ", "; ") + "! yy")], [(7, "start " + q)])
    r = leak.leaks(docs, items).collect()
    assert [(x.doc, x.item, x.doc_word, x.item_word, x.n_words) for x in r] == [(1, 7, 1, 1, 15)]


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a b c")], [])
    assert leak.leaks(docs, items).count() == 0
    docs, items = frames(spark, [], [(1, "a b c")])
    assert leak.leaks(docs, items, min_words=2).count() == 0


def test_words():
    texts = ["", "Ab-cd_e ½ x²", "É9", "", "日本 z"]
    h, at = word_hashes(texts)
    assert np.diff(at).tolist() == [len(leak.words_of(t)) for t in texts] == [0, 4, 1, 0, 2]
    assert len(set(h.tolist())) == 7
    assert leak.words_of("ab½c x²") == ["ab", "c", "x"]


def test_documents_longer_than_a_shard(spark, monkeypatch):
    """The same matches, also those that reach over shards, from the first word to the last."""
    rng = random.Random(8)
    item = " ".join(f"w{rng.randint(0, 40)}" for _ in range(60))
    words = item.split()
    texts = [" ".join(words), " ".join(["x"] * 17 + words[5:50] + ["y"] * 3 + words[:30] + words[20:]), " ".join(words[:11]), "a b"]
    docs, items = frames(spark, list(enumerate(texts)), [(7, item), (8, " ".join(words[10:40]))])
    want = {tuple(r) for r in leak.leaks(docs, items).collect()}
    hashes, _ = word_hashes([texts[1]])
    asked, at = word_hashes([item])
    for most in (24, 25, 40):
        assert {x[2:] for x in leak.long_hits(hashes, asked, at, 12, most)} == {x[2:] for x in leak.shard_hits(hashes, np.array([0, len(hashes)]), asked, at, 12)}
    assert {(1, 7, 17, 5, 45), (0, 7, 0, 0, 60)} <= want
