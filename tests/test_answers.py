from leafmill.plans.notes import extracted


def test_answers_hold_terms_and_web(spark):
    pages = spark.createDataFrame([("p1", "d", "D", 1, "The harbour is dredged."), ("p2", "d", "D", 2, "\u201cHarbour\u201d means a sheltered place; it is dredged each year by the harbour office.")], "id string, doc string, doc_short string, page int, text string")
    asked = spark.createDataFrame([("r1", "simplify", "harbour dredged", "p1", True), ("r2", "simplify", "harbour dredged", "p1", False), ("r3", "simplify", None, "p2", None)], "request_id string, mode string, selection string, chunk_id string, web boolean")
    refs = ", ".join(f'{{"title": "t{i}", "url": "https://h{i}.example/"}}' for i in range(5))
    notes = spark.createDataFrame([("n1", " p1\t", f"[{refs}]"), ("n2", "p2", None)], "id string, chunk_id string, web string")
    got = {r.request_id: r.answer for r in extracted(asked, pages, notes).collect()}
    assert "## Defined terms\n- **Harbour** means a sheltered place [D, p.2]" in got["r1"]
    assert [f"[t{i}](https://h{i}.example/)" in got["r1"] for i in range(5)] == [True] * 4 + [False]
    assert "(web)" not in got["r2"] and "**Harbour**" in got["r2"] and "(web)" not in got["r3"] and len(got) == 3
