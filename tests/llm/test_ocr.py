import random

import numpy as np
import pytest

from leafmill.llm import automaton, ocr


def distance(seen, word, edits):
    """Plain dynamic programming over both words."""
    big = 10**6
    d = np.full((len(seen) + 1, len(word) + 1), big)
    d[0, 0] = 0
    for i in range(len(seen) + 1):
        for j in range(len(word) + 1):
            best = d[i, j]
            if i and j and seen[i - 1] == word[j - 1]:
                best = min(best, d[i - 1, j - 1])
            for s, t in automaton.MISREADINGS:
                if seen[:i].endswith(s) and word[:j].endswith(t):
                    best = min(best, d[i - len(s), j - len(t)] + automaton.CONFUSED)
            if edits:
                e = automaton.EDITED
                if i and j:
                    best = min(best, d[i - 1, j - 1] + e)
                if i:
                    best = min(best, d[i - 1, j] + e)
                if j:
                    best = min(best, d[i, j - 1] + e)
            d[i, j] = best
    return d[-1, -1]


@pytest.mark.parametrize("edits", [True, False])
def test_all_candidates_are_found(edits):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("acdehilmnorstu") for _ in range(rng.randint(1, 7))) for _ in range(150)] + ["modern", "claim", "étude"]
    seen = ["rnoclern", "c1airn", "étude", "", "x", "m0dcm"] + ["".join(rng.choice("acdehilmn01!5rstu") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    trie = automaton.Trie.of(vocabulary)
    most = np.array([rng.randint(0, 4) for _ in seen])
    q, w, cost = automaton.candidates(seen, trie, most, edits)
    got = {(a, trie.words[b]): c for a, b, c in zip(q.tolist(), w.tolist(), cost.tolist())}
    want = {}
    for a, s in enumerate(seen):
        for v in trie.words:
            d = distance(s, v, edits)
            if d <= most[a]:
                want[a, v] = d
    assert got == want


def test_empty_vocabulary():
    assert len(automaton.candidates(["a"], automaton.Trie.of([]), np.array([2]))[0]) == 0
    assert len(automaton.candidates([], automaton.Trie.of(["a"]), np.array([], np.int64))[0]) == 0


BASE = (
    "The committee shall modernise the archive and the peer-reviewed register of each county. "
    "Every market must keep a clear notice, a long-term plan and a short summary in March 2034. "
)
DIGITAL = [(f"d{i}", "Open Plan for Water 2030", i + 1, BASE + "Some short- and long-term plans of the market stand.") for i in range(12)]
SCANNED = [
    ("s1", "Area Open Plan for Water 2030", 7, "Open Plan for Water | 7\n\nThe cornmittee shall mod-\nernise the archivc and the peer-\nreviewed register of short-\nand long-term plans in 2O34."),
    ("s2", "Area Open Plan for Water 2030", 8, "The county must keep a clear\n\n8 / 0pen PIan for Water\n- 8 -\n\nnotice of the mar¬ \nket. Every c0unty\nshall keep\n8 plans."),
    ("s3", None, None, "Page 3\nThe archive."),
    ("s4", "T", 1, ""),
    ("s5", "T", 1, None),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, t, p, x, "k") for i, t, p, x in DIGITAL + SCANNED], "id string, doc_title string, page int, text string, kind string")


def test_repairs(pages):
    got = {tuple(r) for r in ocr.repairs(pages).collect()}
    assert got == {
        ("s1", 0, "furniture", ""), ("s1", 2, "misread", "committee"), ("s1", 2, "broken", "modernise"), ("s1", 3, "misread", "archive"), ("s1", 5, "misread", "2034"),
        ("s2", 2, "furniture", ""), ("s2", 3, "furniture", ""), ("s2", 5, "broken", "market"), ("s2", 6, "misread", "county"),
    }


def test_repaired_text(pages):
    got = {r.id: r.text for r in ocr.repaired(pages).collect()}
    assert got["s1"] == "The committee shall modernise the archive and the peer- reviewed register of short- and long-term plans in 2034.".replace("peer- ", "peer-")
    assert got["s2"] == "The county must keep a clear notice of the market. Every county shall keep 8 plans."
    assert all(got[i] == x for i, _, _, x in DIGITAL) and got["s3"] == "Page 3\nThe archive." and got["s4"] == "" and got["s5"] is None


def test_empty_table(pages):
    assert ocr.repairs(pages.limit(0)).count() == 0 and ocr.repaired(pages.limit(0)).count() == 0


def test_neighbours_decide_between_candidates(spark):
    text = ("pay within ten days of clay. the clay pot is red. the day is long. " * 30,) * 2
    rows = [("a", "t", 1, text[0]), ("b", "t", 2, "the c1ay pot is red")]
    df = spark.createDataFrame(rows, "id string, doc_title string, page int, text string")
    v = ocr.learn(df)
    assert {"clay", "day"} <= ocr.mistakable(v.counts)
    assert [r.repaired for r in ocr.repairs(df, v).collect()] == ["clay"]


def test_put_right_keeps_case_and_marks():
    assert ocr.put_right("(Con5urner)", "consumer") == "(Consumer)" and ocr.put_right("C0UNTY,", "county") == "COUNTY," and ocr.put_right("c0unty", "county") == "county"


def test_one_rule_for_known_words_at_every_size(spark):
    rows = [(f"f{i}", "t", i, "the river " * 60_000) for i in range(20)] + [("a", "t", 1, "the lantern " * ocr.LEAST), ("b", "t", 2, "the lantcrn river")]
    df = spark.createDataFrame(rows, "id string, doc_title string, page int, text string")
    assert [tuple(r) for r in ocr.repairs(df).collect()] == [("b", 0, "misread", "lantern")]


def test_size_of_shards_and_hot_words_does_not_matter(spark, pages, monkeypatch):
    want = {tuple(r) for r in ocr.repairs(pages).collect()}
    monkeypatch.setattr(ocr, "SHARD", 7)
    monkeypatch.setattr(ocr, "QUERIES", 2)
    monkeypatch.setattr(ocr, "HOT", 3)
    assert {tuple(r) for r in ocr.repairs(pages).collect()} == want and len(want) == 9


def test_only_well_formed_roman_numbers_are_passed_over():
    assert all(ocr.is_roman(ocr.roman(n)) for n in range(1, 4000))
    assert not any(ocr.is_roman(w) for w in ("", "vvill", "clvil", "clid", "mlld", "iix", "x1"))
    assert ocr.doubted("vvill", {}) == ("vvill", False) and ocr.doubted("xviii", {}) is None


def test_all_edits_within_the_cost_are_looked_for(spark):
    known = spark.createDataFrame([("programme", 9), ("clan", 9), ("deal", 9)], "word string, n long")
    got = {(r.word, r.found): (r.cost, r.listed) for r in ocr.candidates(spark.createDataFrame([("pxogrzmme",), ("cian",), ("ctian",)], "word string"), known).collect()}
    assert got[("pxogrzmme", "programme")] == (4, False)  # two plain edits
    assert got[("cian", "clan")] == (1, True) and got[("ctian", "clan")] == (3, False)


def test_lines_that_repeat_in_a_document_are_furniture(spark):
    """Whatever they say, with page numbers and misreadings; on fewer pages, and in other documents, the same line is text."""
    head = lambda p: [f"Harbour Office Circular   {p}", f"Harbour 0ffice CircuIar  {p}", f"{p} – Harbour Office Circular"][p % 3]
    rows = [(f"a{p}", "a", None, p, f"{head(p)}\nThe gate number {p * 17} is open.\nSeldom said." if p < 3 else f"{head(p)}\nThe gate {p * 13} is shut.") for p in range(1, 12)]
    rows += [("b1", "b", None, 1, "Harbour Office Circular 1\nThe gate."), ("n1", None, None, 1, "Harbour Office Circular 1\nThe gate.")]
    df = spark.createDataFrame(rows, "id string, doc string, doc_title string, page int, text string")
    got = {(r.id, r.line_no) for r in ocr.repairs(df).where("kind = 'furniture'").collect()}
    assert got == {(f"a{p}", 0) for p in range(1, 12)}
    assert {r.text for r in ocr.repaired(df).where("id IN ('a1', 'b1')").collect()} == {"The gate number 17 is open. Seldom said.", "Harbour Office Circular 1\nThe gate."}
