"""What is worth noting on a page: rule-based key points, cross-references, definitions.

All rules work within a row: sentences and matches are arrays, picked by higher-order functions, so pages
are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions.text import sentences, squash, tokens

# Kind, pattern and weight of the rules for key points, in order.
KINDS = [
    ("penalty", r"\b(offence|fine[sd]?|imprison\w*|penalt\w*|liable|sanction\w*|revok\w*|suspen\w*)\b", 5),
    ("obligation", r"\b(shall|must|is required to|are required to|obliged to|ensure that)\b", 4),
    ("deadline", r"\b(within \w+ (days?|weeks?|months?|years?)|not later than|at least \w+ (days?|months?|years?)|by (20\d\d|the end of)|(19|20)\d\d\s*[-–]\s*(19|20)\d\d|annual(ly)?|every \w+ years?)\b", 3),
    ("figure", r"\b(KES|KSh|Ksh|shillings?|USD|US\$|\d+(\.\d+)?\s?(%|per ?cent|million|billion))\b", 3),
    ("right", r"\b(right to|rights of|consent|protect\w*|redress|appeal|complain\w*|human rights|non-discriminat\w*)\b", 3),
    ("power", r"\b(may (issue|make|prescribe|appoint|establish|delegate)|shall (establish|appoint|prescribe)|responsible for|functions? of)\b", 2),
]
# Fixed value: a reference to a section, clause or article.
XREF = r"(?i)(?<![A-Za-z0-9_])(?:section|clause|article)\s+\d{1,3}[A-Z]?"
# Fixed value: a quoted term, a defining verb and what follows, up to a semicolon.
DEFINITION = r"[“\"]([^”\"]{2,60})[”\"]\s+(means|has the meaning|includes)\s+([^;]{5,400})"


def spark_rule(rule: str) -> str:
    """Word boundaries count ASCII letters only, as in the rules' own dialect. All rules begin with a word character."""
    word = "[A-Za-z0-9_]"
    body = rule.removeprefix(r"\b").removesuffix(r"\b")
    return rf"(?i)(?<!{word}){body}(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"


def sql_rule(rule: str) -> str:
    return "(?i)" + rule


def key_points(pages: DataFrame, key: str, text: str, most: int = 5) -> DataFrame:
    """(key, pos, kind, score, sentence): sentences of 40 to 600 characters that a rule hits, at most `most` of a page: the best of each
    kind first, then the strongest. The kind is that of the heaviest rule that hits, the score the sum of all. Null and empty pages
    have none."""

    def judged(s: Column, i: Column) -> Column:
        hits = [s.rlike(spark_rule(r)) for _, r, _ in KINDS]
        score = sum((F.when(h, w).otherwise(0) for h, (_, _, w) in zip(hits, KINDS)), F.lit(0))
        kind = F.coalesce(*[F.when(h, F.lit(k)) for h, (k, _, w) in sorted(zip(hits, KINDS), key=lambda x: -x[1][2])])
        return F.struct((-score).alias("neg"), i.alias("pos"), kind.alias("kind"), s.alias("sentence"))

    found = F.filter(F.transform(sentences(F.col(text)), judged), lambda x: (x["neg"] < 0) & F.length(x["sentence"]).between(40, 600))
    ranked = pages.select(F.col(key), F.array_sort(found).alias("all"))
    # an element is the best of its kind if no earlier one has the kind
    first = F.filter("all", lambda x, i: (F.array_position(F.transform("all", lambda y: y["kind"]), x["kind"]) - 1) == i)
    rest = F.filter("all", lambda x, i: (F.array_position(F.transform("all", lambda y: y["kind"]), x["kind"]) - 1) != i)
    picked = ranked.select(key, F.explode_outer(F.slice(F.concat(first, rest), 1, most)).alias("p")).where("p IS NOT NULL")
    return picked.select(key, "p.pos", "p.kind", (-F.col("p.neg")).alias("score"), "p.sentence")


def cross_references(pages: DataFrame, key: str, text: str, most: int = 6) -> DataFrame:
    """(key, kind, number, rank): the first references of a page to sections, clauses and articles, each number once."""
    found = F.regexp_extract_all(F.col(text), F.lit(XREF), F.lit(0))
    parts = F.transform(found, lambda x: F.struct(F.lower(F.regexp_extract(x, "^[A-Za-z]+", 0)).alias("kind"), F.upper(F.regexp_extract(x, r"\d.*$", 0)).alias("number")))
    numbers = F.transform("x", lambda y: y["number"])
    once = F.filter("x", lambda y, i: F.array_position(numbers, y["number"]) - 1 == i)
    rows = pages.select(F.col(key), parts.alias("x")).select(key, F.posexplode_outer(F.slice(once, 1, most)).alias("i", "r")).where("i IS NOT NULL")
    return rows.select(key, "r.kind", "r.number", (F.col("i") + 1).alias("rank"))


def definitions(pages: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """(term, definition, and the columns of `order`): the first definition of each quoted term, regardless of case, in the order of
    `order` and then of the text."""
    group = lambda n: F.regexp_extract_all(F.col(text), F.lit(DEFINITION), F.lit(n))
    rows = pages.select(*order, F.posexplode_outer(F.arrays_zip(group(1).alias("t"), group(2).alias("v"), group(3).alias("b"))).alias("i", "d")).where("i IS NOT NULL")
    term = F.trim("d.t")
    first = rows.select(term.alias("term"), F.concat_ws(" ", F.col("d.v"), squash(F.col("d.b"))).alias("definition"), *order, "i")
    best = first.groupBy(F.lower("term").alias("k")).agg(F.min(F.struct(*order, "i", "term", "definition")).alias("m"))
    return best.select("m.term", "m.definition", *[f"m.{c}" for c in order])


def matching_definitions(selections: DataFrame, key: str, text: str, glossary: DataFrame, most: int = 6, order: tuple[str, ...] = ("term",)) -> DataFrame:
    """(key, term, definition, and other columns of `order`): glossary terms that stand in a selection, as text or with all their tokens; the
    first `most` of each in the order of `order`.

    Candidates meet on shared keys, not pair by pair: the first three characters of a term stand somewhere in a selection that contains
    it, and its first token is among the tokens of one that has them all."""
    low = F.lower("term")
    keys = F.array(F.concat(F.lit("c:"), F.substring(low, 1, 3)), F.concat(F.lit("t:"), F.get(tokens(F.col("term")), F.lit(0))))
    more = [c for c in order if c != "term"]
    terms = glossary.where("term <> ''").select("term", "definition", *more, low.alias("low"), tokens(F.col("term")).alias("tt"), F.explode(F.array_compact(keys)).alias("anchor"))
    said = F.lower(F.col(text))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(said), F.lit(1))), lambda i: F.concat(F.lit("c:"), F.substring(said, i, F.lit(n))))
    named = F.transform(tokens(F.col(text)), lambda t: F.concat(F.lit("t:"), t))
    # anchors that no term has go before the selections are laid beside them
    every = selections.select(F.col(key), F.explode(F.array_distinct(F.concat(grams(3), grams(2), named))).alias("anchor"))
    met = every.join(terms.select("anchor").distinct(), "anchor", "left_semi").groupBy(key).agg(F.collect_set("anchor").alias("anchors"))
    mine = selections.select(F.col(key), said.alias("sel"), tokens(F.col(text)).alias("st")).join(met, key).select(key, "sel", "st", F.explode("anchors").alias("anchor"))
    hit = mine.join(terms, "anchor").where(F.col("sel").contains(F.col("low")) | ((F.size("tt") > 0) & (F.size(F.array_except("tt", "st")) == 0)))
    once = hit.select(key, "term", "definition", *more).distinct()
    return once.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(*order, "term"))).where(F.col("r") <= most).drop("r")


#: Characters of a term at most; definitions have 60.
TERM_CHARS = 60


def term_uses(pages: DataFrame, key: str, doc: str, page: str, text: str, glossary: DataFrame) -> DataFrame:
    """(key, term, use, at): where each glossary term (term, doc, page) of four and more characters is first used on each page, at a word's
    beginning and end, without regard to case; of terms at one place the longest, and none within the one before. Terms that begin with a
    capital only match capitalised uses; no term is linked on the page that defines it. Of terms alike but for case the last in order of doc and page counts.

    Words of pages meet terms on the terms' first word; each carries the TERM_CHARS characters that follow."""
    border = r"(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])"
    first = lambda c: F.get(F.filter(F.split(c, border), lambda x: x != ""), F.lit(0))
    known = glossary.where(F.length("term").between(4, TERM_CHARS)).groupBy(F.lower("term").alias("low")).agg(F.max(F.struct("doc", "page", "term")).alias("m"))
    known = known.select("low", first(F.col("low")).alias("head"), F.col("m.doc").alias("_doc"), F.col("m.page").alias("_page"), F.col("m.term").alias("term"))

    def placed(parts: Column) -> Column:
        ahead = lambda i: F.substring(F.array_join(F.slice(parts, i + 1, TERM_CHARS + 1), ""), 1, TERM_CHARS + 1)
        words = F.filter(F.transform(parts, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda y: y["x"].rlike("[A-Za-z0-9_]"))
        return F.transform(words, lambda y: F.struct(y["i"].alias("at"), F.lower(y["x"]).alias("head"), ahead(y["i"]).alias("ahead")))

    parts = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), border), lambda x: x != "")
    words = F.get(F.transform(F.array(parts), placed), F.lit(0))
    each = pages.select(F.col(key), F.col(doc).alias("d"), F.col(page).alias("p"), F.explode_outer(words).alias("w")).where("w IS NOT NULL").select(key, "d", "p", "w.*")
    after, before = F.substring(F.col("ahead"), F.length("low") + 1, F.lit(1)), F.substring(F.col("low"), -1, 1)
    ends = (after == "") | (after.rlike("[A-Za-z0-9_]") != before.rlike("[A-Za-z0-9_]"))
    hits = each.join(known, "head").where(F.lower("ahead").startswith(F.col("low")) & ends)
    longest = hits.groupBy(key, "at").agg(F.max(F.struct(F.length("low").alias("n"), "low", "term", "_doc", "_page", "ahead", "d", "p")).alias("h"))
    size = lambda h: F.size(F.filter(F.split(h["low"], border), lambda x: x != ""))
    inside = longest.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", size(F.col("h")).alias("size"), "h"))).alias("hs"))  # at most a page's words
    start = F.struct(F.lit(-1).alias("end"), F.array().cast(inside.schema["hs"].dataType).alias("kept"))
    free = lambda acc, x: F.when(x["at"] >= acc["end"], F.struct((x["at"] + x["size"]).alias("end"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)
    kept = inside.select(key, F.explode_outer(F.aggregate("hs", start, free)["kept"]).alias("k")).where("k IS NOT NULL").select(key, "k.at", "k.h.*")
    use = F.substring(F.col("ahead"), F.lit(1), F.col("n"))
    capital = F.col("term").rlike("^[A-Z]") & ~use.rlike("^[A-Z]")
    here = (F.col("_doc") == F.col("d")) & (F.col("_page") == F.col("p"))
    best = kept.where(~capital & ~F.coalesce(here, F.lit(False))).groupBy(key, "term").agg(F.min(F.struct("at", use.alias("use"))).alias("m"))
    return best.select(key, "term", "m.use", "m.at")
