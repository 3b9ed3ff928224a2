import math
import re

import pandas as pd
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import insights, retrieval, structure, telemetry, web


def one(spark, expr, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.orderBy("i").select(expr(F.col("t")).alias("x")).collect()]


def test_tokens(spark):
    assert one(spark, T.tokens, "The Office shall be a body of AI", None, "", "co-op 2nd éa État naïve x-", "ABC def") == [["office", "body"], [], [], ["co-op", "tat"], ["abc", "def"]]


def test_squash_and_excerpt(spark):
    assert one(spark, T.squash, " a \n b ", None) == ["a b", ""]
    assert one(spark, lambda c: T.excerpt(c, 6), "abcdef", "abcd efgh", None) == ["abcdef", "abcd…", ""]


def test_sentences(spark):
    assert one(spark, T.sentences, "One. Two is 3.5 million. Last", "No end", "A?! Yes it is! x", None, "...") == [
        ["One.", "5 million.", "Last"], ["No end"], ["A?!", "Yes it is!"], [], []]


def test_best_sentences_prefer_overlap_then_place(spark):
    q = F.array(F.lit("water"), F.lit("tariff"))
    got = one(spark, lambda c: T.best_sentences(q, c, 2), "The water is blue. Nothing here. Tariff on water rises. Water again water.")
    assert got == [["Tariff on water rises.", "The water is blue."]]


def test_urls(spark):
    urls = [" HTTP://WWW.Example.COM:80/a?b#c ", "https://u:P@Host.org", "javascript:alert(1)", "http:///x", None, "ftp://a.b/", "https://a.b/?q#f", "http://a.b#x"]
    assert one(spark, T.normalise_url, *urls) == ["http://www.example.com:80/a?b", "https://u:p@host.org/", None, None, None, None, "https://a.b/?q", "http://a.b/"]
    hosts = ["http://www.x.go.ke/", "http://www.kenyalaw.org/", "http://a.gov/", "http://x.gov.uk/", "http://gov.uk/", "http://data.europa.eu/", "http://who.int/", "http://m.ac.ke/", "http://notwikipedia.org/", "http://www.bbc.com/", "http://www.www.bbc.com/"]
    assert one(spark, lambda c: T.source_tier(T.url_host(c))["tier"], *hosts) == [1, 1, 2, 2, 6, 2, 2, 3, 4, 5, 5]


def test_web_ranking_counts_dropped_results(spark):
    rows = [("q", 0, 0, "a", "javascript:x"), ("q", 0, 1, "b", "http://z.org/"), ("q", 1, 0, "c", "http://Z.org#f"), ("q", 1, 0, "d", "http://y.org"), ("q", 1, 5, None, "http://a.gov/")]
    df = spark.createDataFrame([(*r, "") for r in rows], "query string, provider_no int, pos int, title string, url string, snippet string")
    assert [(r.rank, r.url, r.title) for r in web.ranked(df).orderBy("rank").collect()] == [(1, "http://a.gov/", "a.gov"), (2, "http://y.org/", "d"), (3, "http://z.org/", "b")]


def test_html(spark):
    assert one(spark, T.html_text(40), "<b>A &amp; B</b>\n &lt;i&gt;", None, "x" * 50) == ["A & B <i>", "", "x" * 39 + "…"]


def test_keys_and_traces(spark):
    import hashlib

    got = spark.range(1).select(T.cache_key(F.lit("a"), F.lit(None), F.lit(3)).alias("k"), T.request_fingerprint(F.lit("PUT"), F.lit("/x"), F.lit("{}")).alias("f")).first()
    assert got.k == hashlib.sha256(b"a\x1f\x1f3").hexdigest()[:40] and got.f == hashlib.sha256(b"PUT /x\n{}").hexdigest()
    good = "00-" + "a" * 32 + "-" + "b" * 16 + "-01"
    assert one(spark, lambda c: T.trace_parts(c)["span_id"], good, good.replace("a", "0"), good.replace("b", "0"), "x", None) == ["b" * 16, None, None, None, None]
    assert one(spark, T.citations, "see [Bill, p.4], [Road Map , p. 11], [Plan 2, p.3] and [Bill, p.12345]!", None) == [[("Bill", 4), ("Road Map", 11)], []]


def plain_bm25(docs, query):
    d = [t or ["_"] for t in docs]
    n, avg = len(d), sum(map(len, d)) / len(d)
    df = {}
    for t in d:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    return [sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query) for t in d]


def test_bm25_with_floor_and_repeated_words(spark):
    texts = ["water tariff water", "water budget", "water plan budget plan", "", "water school", None, "land", "water"]
    pages = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("score", F.lit("x"))
    asked = spark.createDataFrame([(1, "Water water plan"), (2, "nothing"), (3, ""), (4, "budget tariff")], "q int, t string")
    got = {(r.query, r.page): r.score for r in retrieval.scores(retrieval.build(pages, "id", "text"), retrieval.query_terms(asked, "q", "t")).collect()}
    docs = [[w for w in (t or "").split()] for t in texts]
    want = {}
    for q, words in ((1, ["water", "water", "plan"]), (4, ["budget", "tariff"])):
        want |= {(q, i): s for i, s in enumerate(plain_bm25(docs, words)) if s > 0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_definitions(spark):
    text = 'Intro “Water Board” means the   body; "tariff" includes fees and\nlevies; “WATER BOARD” means another body;'
    pages = spark.createDataFrame([("d", 2, "“tariff” means x y z w v;", "t"), ("d", 1, text, "t"), ("e", 1, None, "t")], "doc string, page int, text string, term string")
    got = {r.term: (r.definition, r.page) for r in insights.definitions(pages, ["doc", "page"]).collect()}
    assert got == {"Water Board": ("means the body", 1), "tariff": ("includes fees and levies", 1)}
    glossary = spark.createDataFrame([("Water Board", "x"), ("tariff", "y"), ("of", "z"), ("fees of levy", "w")], "term string, definition string")
    asked = spark.createDataFrame([(1, "The water   board sets TARIFFS"), (2, "levy and fees"), (3, ""), (4, None)], "k int, s string")
    assert {(r.k, r.term) for r in insights.matching_definitions(asked, "k", "s", glossary).collect()} == {(1, "Water Board"), (1, "tariff"), (2, "fees of levy")}


def test_key_points(spark):
    s = ["A person who commits the offence named here pays dearly.", "The council shall and must act on each of its petitions.", "Short shall.", "Costs rose by 5 per cent in the year for all of them.", "Everyone has a right to know what is done in the name.", "A minister may issue a rule at any time they want to act.", "Reports come not later than the end of the month each.", "The body shall establish a fund and pay a fine of 3 million."]
    pages = spark.createDataFrame([("p", " ".join(s)), ("q", None), ("r", "shall " * 200)], "id string, text string")
    got = [(r.pos, r.kind, r.score) for r in insights.key_points(pages, "id", "text").orderBy("pos").collect()]
    assert len(got) == 5 and (7, "penalty", 14) in got and (2, "obligation", 4) not in got


def test_structure():
    page = "13 / Some Plan\nPART II — RIGHTS: 1—One. 2—Two\nGENERAL\nPROVISIONS\nThe board shall keep a long register of all the things it holds now\nand decision-\nmaking.\nNext paragraph begins with a capital letter and it runs on quite far.\n(a) first item\ncontinues\n(iv) deep\n• bullet\nCLAUSE 4A — Water\nWater Supply And Demand\ntext follows here."
    got = structure.blocks(page)
    assert [(b["type"], b.get("num"), b.get("marker"), b.get("depth")) for b in got] == [
        ("sec", "Part II", None, None), ("p", None, None, None), ("sec", None, None, None), ("p", None, None, None), ("p", None, None, None),
        ("item", None, "(a)", 1), ("item", None, "(iv)", 2), ("item", None, "•", 1), ("sec", "Clause 4A", None, None), ("sub", None, None, None), ("p", None, None, None)]
    assert got[2]["text"] == "General Provisions" and "decision-making." in got[3]["text"] and got[5]["text"] == "first item continues"
    assert structure.blocks("Contents\nOne 1\nTwo 2")[0]["type"] == "toc" and structure.blocks("") == []
    assert structure.blocks("What is a levy?\nA fee.", True)[0]["type"] == "q"
    assert structure.title_case("OBLIGATIONS FOR HIGH-RISK AI SYSTEMS") == "Obligations for High-Risk AI Systems"
    assert structure.title_case("Mixed Case") == "Mixed Case" and structure.upper_median(pd.Series([4, 1, 2, 3, 9]), pd.Series([0, 0, 0, 0, 1])).to_dict() == {0: 3, 1: 9}


def test_structure_keeps_all_words(spark, data_dir):
    for r in spark.read.parquet(f"{data_dir}/chunks.parquet").select("text").collect():
        lines = [x for x in (r.text or "").split("\n") if not re.fullmatch(structure.FURNITURE, " ".join(x.split()))]
        words = sum(len(x.split()) for x in lines)
        kept = " ".join(f"{b.get('num', '')} {b.get('marker', '')} {b['text']}" for b in structure.blocks(r.text or ""))
        joined = sum(x.rstrip().endswith("-") for x in lines)
        assert len(kept.split()) >= words - joined - 3


def test_outline_and_sections(spark):
    h = lambda page, pos, kind, text: ("d", page, pos, kind, None, text)
    heads = spark.createDataFrame([h(1, 0, "sec", "Intro"), h(2, 0, "sec", "Intro"), h(2, 1, "sub", "Aims"), h(2, 2, "p", "x"), h(4, 0, "sec", "Rules"), h(5, 0, "sub", "Fees"), h(5, 1, "sec", "ab"), h(6, 0, "sub", "Last " * 30)], "doc string, page int, pos int, type string, num string, text string")
    out = structure.outline(heads)
    assert [(r.page, r.level, r.label[:5]) for r in out.orderBy("page", "pos").collect()] == [(1, 2, "Intro"), (2, 3, "Aims"), (4, 2, "Rules"), (5, 3, "Fees"), (6, 3, "Last ")]
    pages = spark.createDataFrame([("d", p) for p in range(7)] + [("e", 1)], "doc string, page int")
    got = {(r.doc, r.page): (r.section, r.subsection, (r.next_heading or "")[:5]) for r in structure.sections(pages, out).collect()}
    assert got == {("d", 0): (None, None, "Intro"), ("d", 1): ("Intro", None, "Rules"), ("d", 2): ("Intro", "Aims", "Rules"), ("d", 3): ("Intro", "Aims", "Rules"), ("d", 4): ("Rules", None, "Fees"), ("d", 5): ("Rules", "Fees", "Last "), ("d", 6): ("Rules", got["d", 6][1], ""), ("e", 1): (None, None, "")}


def test_quantile_from_buckets(spark):
    df = spark.createDataFrame([("a", 0.003), ("a", 0.2), ("a", 0.2), ("a", 0.4), ("b", 99.0), ("c", None)], "k string, v double")
    got = {r.k: r.value for r in telemetry.quantile(telemetry.bucket_counts(df, F.col("v"), ["k"]), 0.75, ["k"]).collect()}
    assert got == {"a": 0.25, "b": 60.0}


def test_reader_functions(spark):
    assert one(spark, T.reader_sentences, 'He said "no."  Then left. It is 3.5 million. end', "?!", "", None, "a.b") == [['He said "no."', "Then left.", "5 million.", "end"], ["?!"], [], [], ["b"]]
    assert one(spark, T.slug, " Über: Plan 2! ", None) == ["ber-plan-2", ""]
    day = 86_400_000
    ages = one(spark, lambda c: T.age_label(F.lit(20_000 * day), 20_000 * day - c.cast("long")), "59499", "59500", "90000", "5369000", "7200000", "86399000", str(2 * day))
    assert ages == ["just now", "1 min ago", "2 min ago", "1 h ago", "2 h ago", "24 h ago", "2024-10-02"]
    q = F.array(F.lit("water"), F.lit("tariff"), F.lit("water"))
    assert one(spark, lambda c: T.hits_query(c, q), "Water here", "The water tariff") == [False, True]
    sentence = F.lit("The Board  keeps a register of all and")
    assert one(spark, lambda c: T.marks_sentence(c, sentence), "board KEEPS", "The board keeps a register of all and more", "", "board kept it", None, "Keeps a register of all and then some more of it") == [True, True, True, False, False, False]
    assert one(spark, lambda c: T.marks_sentence(c, F.lit("ab")), "xaby") == [False]


def test_markdown(spark):
    cases = {
        "## Head\n- **b** <i> `x`\n- two\n1. one\n\n2) two\ntext": "<h3>Head</h3><ul><li><strong>b</strong> &lt;i&gt; <code>x</code></li><li>two</li></ul><ol><li>one</li></ol><ol><li>two</li></ol><p>text</p>",
        "[t_u](https://a.b/x_y_z?q=1) [u](javascript:x) _em_ *st*": '<p><a href="https://a.b/x_y_z?q=1" target="_blank" rel="noopener noreferrer" class="ext">t_u</a> [u](javascript:x) <em>em</em> <em>st</em></p>',
        "see [Bill, p.4] \"q\" it's": '<p>see <a href="#" class="ref" data-short="Bill" data-page="4">[Bill, p.4]</a> &quot;q&quot; it&#39;s</p>',
        "snake_case_word": "<p>snake_case_word</p>", "": "", "a & b  ": "<p>a &amp; b</p>",
    }
    assert one(spark, T.markdown_html, *cases, None) == [*cases.values(), ""]


def test_term_uses(spark):
    glossary = spark.createDataFrame([("Office", "b", 1), ("water board", "b", 2), ("board", "b", 2), ("of", "b", 1), ("Board", "a", 1)], "term string, doc string, page int")
    pages = spark.createDataFrame(
        [("p1", "d", 5, "An office, the Office. Water  board! water board boards BOARD."), ("p2", "b", 1, "Office and Water Board's"), ("p3", "d", 6, None), ("p4", "d", 7, "officer")],
        "id string, doc string, page int, text string",
    )
    got = {(r.id, r.term, r.use) for r in insights.term_uses(pages, "id", "doc", "page", "text", glossary).collect()}
    assert got == {("p1", "Office", "Office"), ("p1", "board", "board"), ("p1", "water board", "water board"), ("p2", "water board", "Water Board")}


def test_sections_done_and_resolved_references(spark):
    heads = spark.createDataFrame([("bill1", 1, 0, 2, "Clause 1 — A"), ("bill1", 1, 1, 3, "x"), ("bill1", 4, 0, 2, "Clause 4A"), ("bill2", 2, 0, 2, "Clause 4A — B"), ("bill2", 9, 0, 2, "Clause 12 — B")], "doc string, page int, pos int, level int, label string")
    seen = spark.createDataFrame([("s", "bill1", 3), ("t", "bill1", 2), ("s", "bill2", 99)], "session string, doc string, furthest int")
    assert {tuple(r) for r in structure.sections_done(heads, seen).collect()} == {("s", "bill1", 1, 0, "Clause 1 — A"), ("s", "bill1", 1, 1, "x"), ("s", "bill2", 2, 0, "Clause 4A — B")}
    refs = spark.createDataFrame([("a", "bill1", 4, "4A"), ("b", "digest", 4, "4A"), ("c", "bill1", 4, "12"), ("d", "bill1", 4, "1"), ("e", "bill1", 4, "99")], "id string, doc string, page int, number string")
    assert {(r.id, r.target_doc, r.target_page) for r in structure.resolved(refs, heads).collect()} == {("b", "bill1", 4), ("c", "bill2", 9), ("d", "bill1", 1)}


def test_extractive_answer(spark):
    from leafmill.operators import answers

    row = spark.createDataFrame(
        [("simplify", "water tariff", [("B", 3, "The water tariff rises. Nothing.")], [("Tariff", "means a fee", "B", 1)], [("T", "https://x.y/", "snip", "x.y", "News")]), ("ask", "zzz", [], [], [])],
        "m string, s string, p array<struct<doc_short:string,page:int,text:string>>, d array<struct<term:string,definition:string,doc_short:string,page:int>>, w array<struct<title:string,url:string,snippet:string,domain:string,tier_label:string>>",
    )
    got = [r.a for r in row.select(answers.answer(*[F.col(c) for c in "mspdw"], F.lit("off")).alias("a")).collect()]
    assert got[0].split("\n")[:6] == ["## Defined terms", "- **Tariff** means a fee [B, p.1]", "## Related wording elsewhere", "- The water tariff rises. [B, p.3]", "## Beyond the documents (web)", "- [T](https://x.y/) — snip _(x.y · News)_"]
    assert got[1].startswith("No closely related") and got[1].endswith("without a language model (off)._")
