"""Extractive answers and research briefs as Markdown columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import best_sentences, excerpt, squash, tokens
from leafmill.operators import notebook
from leafmill.operators.running import running


# Headings and sentences of answers and briefs, and the label of each mode.
TERMS, RELATED, PASSAGES, WEB = "## Defined terms", "## Related wording elsewhere", "## What the documents say", "## Beyond the documents (web)"
NOTHING = "No closely related passages or defined terms were found in these documents."
PARTS = ["## Questions", "## Highlights and notes (in reading order)", "## Research notes", "## Sources beyond the documents", "## References"]
LABELS = {"research": "Research", "simplify": "Simplified"}


def answer(mode: Column, selection: Column, passages: Column, defined: Column, results: Column, reason: Column) -> Column:
    """An answer quoted from passages (doc_short, page, text), defined terms (term, definition, doc_short, page) and web results (title, url,
    snippet, domain, tier_label): at most six terms, four passages of two sentences and four results, in that order."""
    asked = tokens(selection)
    cite = lambda x: F.concat(F.lit(" ["), x["doc_short"], F.lit(", p."), x["page"].cast("string"), F.lit("]"))
    none = F.array().cast("array<string>")
    terms = F.transform(F.slice(defined, 1, 6), lambda d: F.concat(F.lit("- **"), d["term"], F.lit("** "), excerpt(d["definition"], 360), cite(d)))
    quoted = F.transform(F.slice(passages, 1, 4), lambda p: F.struct(F.array_join(best_sentences(asked, p["text"], 2), " ").alias("q"), p["doc_short"].alias("doc_short"), p["page"].alias("page")))
    quotes = F.transform(F.filter(quoted, lambda x: x["q"] != ""), lambda x: F.concat(F.lit("- "), excerpt(x["q"], 420), cite(x)))
    web = F.transform(F.slice(results, 1, 4), lambda w: F.concat(F.lit("- ["), w["title"], F.lit("]("), w["url"], F.lit(") — "), excerpt(w["snippet"], 220), F.lit(" _("), w["domain"], F.lit(" · "), w["tier_label"], F.lit(")_")))
    headed = lambda have, head, rows: F.when(F.size(have) > 0, F.concat(F.array(head), rows)).otherwise(none)
    empty = F.when((F.size(defined) == 0) & (F.size(passages) == 0), F.array(F.lit(NOTHING))).otherwise(none)
    about = F.when(mode == "simplify", F.lit(RELATED)).otherwise(F.lit(PASSAGES))
    footer = F.array(F.concat(F.lit("\n_Extractive note — quoted from the documents without a language model ("), reason, F.lit(")._")))
    return F.array_join(F.concat(headed(defined, F.lit(TERMS), terms), headed(passages, about, quotes), headed(results, F.lit(WEB), web), empty, footer), "\n")


def brief_lines(notes: DataFrame) -> DataFrame:
    """(session, doc_short, line_no, line): the finished notes of a session and document in reading order, a line of Markdown each. Written out in
    this order they are the session's brief; a long session is never one row or one task."""
    page = F.coalesce("page", F.lit(-1))
    line = F.concat(F.lit("- p."), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit(" "), excerpt(F.col("selection"), 200), F.when(F.coalesce("comment", F.lit("")) != "", F.concat(F.lit(" — "), excerpt(F.col("comment"), 200))).otherwise(""))
    rows = notes.where("session <> '' AND status = 'done'").select("session", "doc_short", page.alias("p"), F.coalesce("created_at", F.col("ts") * 1000).alias("t"), "id", line.alias("line"))
    counted = running(rows, ["session", "doc_short"], [F.col("p"), F.col("t"), F.col("id")], F.col("p"), F.lit(1).cast("long"), "sum", "n")
    return counted.select("session", "doc_short", (F.coalesce("n", F.lit(0)) + 1).alias("line_no"), "line")


def research_brief(notes: DataFrame, docs: DataFrame) -> DataFrame:
    """(session, part, line_no, line): the brief of every session in lines of Markdown: questions in order of time; highlights and notes, then
    research notes, in reading order; web sources, each URL once; and references, a line per page. `docs` is (doc, title, place) with null places last.

    Only finished notes count. Lines are numbered in each part by document, so a session that holds a third of all notes is no single task."""
    made = F.coalesce("created_at", F.col("ts") * 1000)
    done = notes.where("session <> '' AND status = 'done'").withColumns({"doc": F.regexp_replace("doc", r"(?U)^\s+|\s+$", ""), "t": made})
    done = done.join(docs, "doc", "left").withColumn("place", F.coalesce("place", F.lit(999)))
    quote = F.concat(F.lit("> "), squash(F.col("selection")))
    yours = F.when(F.coalesce("comment", F.lit("")) != "", F.concat(F.lit("\n\n**My note:** "), F.col("comment"))).otherwise("")
    nested = F.regexp_replace(F.coalesce("answer", F.lit("")), r"(?m)^#{1,4}\s+", "#### ")
    page = F.coalesce(F.col("page").cast("string"), F.lit("?"))
    title = F.coalesce("title", "doc_short", F.lit("?"))
    label = F.lit(LABELS["research"])
    for m, text in LABELS.items():
        label = F.when(F.col("mode") == m, text).otherwise(label)

    def part(n: int, rows: DataFrame, place: Column, name: Column, line: Column, p: Column = F.col("page"), t: Column = F.col("t"), id_: Column = F.col("id")) -> DataFrame:
        at = F.struct(place.cast("int").alias("place"), F.coalesce(name, F.lit("")).alias("name"))
        return rows.select("session", F.lit(n).alias("part"), at.alias("at"), F.coalesce(p, F.lit(-1)).cast("long").alias("p"), F.coalesce(t, F.lit(-1)).cast("long").alias("t"), id_.alias("id"), line.alias("line"))

    asks, own, studies = done.where("mode = 'ask'"), done.where("mode IN ('highlight', 'note')"), done.where("mode IN ('research', 'simplify')")
    day = F.format_string("%012d", F.floor(F.col("t") / 86_400_000))
    refs = F.coalesce(notebook.one_array(F.col("web"), "title STRING, url STRING, domain STRING, tier_label STRING"), F.array().cast("array<struct<title:string,url:string,domain:string,tier_label:string>>"))
    web = done.select("session", "t", "id", F.posexplode_outer(refs).alias("i", "r")).where("r.url IS NOT NULL")
    web = web.groupBy("session", F.col("r.url").alias("url")).agg(F.min(F.struct("t", "id", "i", "r")).alias("m"))
    source = F.concat(F.lit("- ["), F.coalesce("m.r.title", F.lit("")), F.lit("]("), F.col("url"), F.lit(") — "), F.coalesce("m.r.domain", F.lit("")), F.lit(" · "), F.coalesce("m.r.tier_label", F.lit("")))
    cited = done.where("mode <> 'web'").select("session", "doc", "page", "place", title.alias("title")).where("page IS NOT NULL").groupBy("session", "doc", "page", "place").agg(F.min("title").alias("title"))
    none = F.lit("")
    rows = [
        part(1, asks, F.lit(0), day, F.concat(F.lit("### "), F.coalesce("selection", none), F.lit("\n\n"), nested, yours), F.lit(0)),
        part(2, own.groupBy("session", "place", "doc").agg(F.min(title).alias("title")), F.col("place"), F.col("doc"), F.concat(F.lit("### "), F.col("title")), F.lit(-2), F.lit(-2), none),
        part(2, own, F.col("place"), F.col("doc"), F.concat(F.lit("**p."), page, F.lit("**\n\n"), quote, yours)),
        part(3, studies, F.col("place"), F.col("doc"), F.concat(F.lit("### "), label, F.lit(" — "), F.coalesce("doc_short", none), F.lit(", p."), page, F.lit("\n\n"), quote, F.lit("\n\n"), nested, yours)),
        part(4, web, F.lit(0), F.format_string("%012d", F.floor(F.col("m.t") / 86_400_000)), source, F.lit(0), F.col("m.t"), F.concat("m.id", F.format_string(" %06d", "m.i"))),
        part(5, cited, F.col("place"), F.col("doc"), F.concat(F.lit("- "), F.col("title"), F.lit(" — p. "), F.col("page").cast("string")), F.col("page"), F.lit(0), none),
    ]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    heads = every.select("session", "part").distinct()
    heads = heads.select(
        "session", "part", F.struct(F.lit(-1).alias("place"), none.alias("name")).alias("at"), F.lit(-9).cast("long").alias("p"), F.lit(-9).cast("long").alias("t"), none.alias("id"),
        F.get(F.array(*[F.lit(x) for x in PARTS]), F.col("part") - 1).alias("line"),
    )
    counted = running(every.unionByName(heads), ["session", "part"], [F.col("at"), F.col("p"), F.col("t"), F.col("id")], F.col("at"), F.lit(1).cast("long"), "sum", "n")
    return counted.select("session", "part", (F.coalesce("n", F.lit(0)) + 1).alias("line_no"), "line")
