"""Text, URL and key functions as column expressions; all stay in the JVM."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning for retrieval.
STOPWORDS = (
    "the a an of to in on for and or is are was were be by with as at from this that "
    "shall which it its their they he she who whom will would may not no into within under over about "
    "such other any all each per than then also has have had if but so these those subsection section clause"
).split()



def _one_of(words: list[str]) -> str:
    """A pattern for exactly these words that decides letter by letter."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [h + (_one_of(tails) if any(tails) else "") for h, tails in sorted(heads.items()) if h]
    body = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
    return f"(?:{body})?" if "" in heads and parts else body


# Three and more letters or hyphens from the first letter of a run on, unless they are a stopword.
TOKEN = r"(?<![a-z\-])-*((?!" + _one_of([w for w in STOPWORDS if len(w) > 2]) + r"(?![a-z\-]))[a-z][a-z\-]{2,})"
# Fixed value: a sentence.
SENTENCE = r"[^.!?]+[.!?]+(?=\s|$)|[^.!?]+$"


def tokens(text: Column) -> Column:
    """Lower-case words of three and more ASCII letters (inner hyphens allowed) without stopwords, in order; null and
    empty texts have none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def index_tokens(text: Column) -> Column:
    """Tokens for the index: a page without any has the single token "_"."""
    t = tokens(text)
    return F.when(F.size(t) == 0, F.array(F.lit("_"))).otherwise(t)


def squash(text: Column) -> Column:
    """White space runs as one space, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def excerpt(text: Column, most: int) -> Column:
    """Squashed text of at most `most` characters, with an ellipsis if it was cut."""
    t = squash(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…")))


def sentences(text: Column) -> Column:
    """Sentences of more than two characters. The text before a full stop inside a word or number is no sentence and is dropped."""
    found = F.regexp_extract_all(squash(text), F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: F.length(s) > 2)


def best_sentences(query_tokens: Column, text: Column, n: int) -> Column:
    """The `n` sentences that share most distinct tokens with the query, earlier ones first among equals."""
    scored = F.transform(
        sentences(text), lambda s, i: F.struct((-F.size(F.array_intersect(tokens(s), query_tokens))).alias("o"), i.alias("i"), s.alias("s"))
    )
    return F.transform(F.slice(F.array_sort(F.filter(scored, lambda x: x["o"] < 0)), 1, n), lambda x: x["s"])


def snippet(query_tokens: Column, text: Column) -> Column:
    """Two best sentences, or the beginning of the text, within 320 characters."""
    best = F.array_join(best_sentences(query_tokens, text, 2), " ")
    return excerpt(F.when(best != "", best).otherwise(text), 320)


def clean_markup(text: Column) -> Column:
    """Text without tags, white space squashed. Entities are decoded by `html_text`."""
    return squash(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", ""))


def html_text(most: int):  # noqa: ANN201
    """A column function: tags removed, then entities decoded, squashed, cut to `most` characters."""
    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda t: html.unescape(t) if t and "&" in t else t)

    return lambda text: excerpt(decode(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", "")), most)


def normalise_url(url: Column) -> Column:
    """http(s) URL with host in lower case, at least the path /, no fragment; null for anything else."""
    u = F.regexp_replace(url, r"(?U)^\s+|\s+$", "")
    part = lambda g: F.regexp_extract(u, r"(?s)^(?i:(https?))://([^/?#]*)([^?#]*)(\?[^#]*)?", g)
    host = F.regexp_extract(part(2), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1)
    path = F.when(part(3) == "", "/").otherwise(part(3))
    query = F.when(part(4) == "?", "").otherwise(part(4))
    return F.when(host != "", F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), path, query))


def url_host(url: Column) -> Column:
    """Host of a normalised URL in lower case, without one leading "www."."""
    host = F.lower(F.regexp_extract(url, r"^https?://(?:[^/?#]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


# Source tiers in the order in which they are tried (tier, label, exact hosts, domains with subdomains, suffixes, infixes).
TIERS = [
    (1, "Official (Kenya)", ("kenyalaw.org", "new.kenyalaw.org"), (), (".go.ke",), ()),
    (2, "Government", (), ("europa.eu",), (".gov",), (".gov.",)),
    (2, "Intergovernmental", (), ("oecd.org", "oecd.ai", "unesco.org", "un.org", "itu.int", "au.int", "worldbank.org", "who.int", "wipo.int", "unep.org"), (), ()),
    (3, "Academic", (), ("arxiv.org", "doi.org", "ssrn.com", "nature.com", "sciencedirect.com", "springer.com", "jstor.org", "researchgate.net"), (".edu",), (".ac.",)),
    (4, "Reference — verify with a primary source", (), (), ("wikipedia.org",), ()),
    (5, "News", (), ("nation.africa", "standardmedia.co.ke", "the-star.co.ke", "kbc.co.ke", "citizen.digital", "techcabal.com", "bbc.co.uk", "bbc.com", "reuters.com", "apnews.com", "theguardian.com", "aljazeera.com"), (), ()),
]
OTHER_TIER = (6, "Other — check who publishes it")


def source_tier(host: Column) -> Column:
    """struct(tier, tier_label) of a host: the first tier that matches, else the last."""
    out = None
    for tier, label, exact, domains, suffixes, infixes in TIERS:
        tests = [host.isin(*exact)] if exact else []
        tests += [(host == d) | host.endswith("." + d) for d in domains]
        tests += [host.endswith(s) for s in suffixes] + [host.contains(s) for s in infixes]
        hit = tests[0]
        for t in tests[1:]:
            hit = hit | t
        value = F.struct(F.lit(tier).alias("tier"), F.lit(label).alias("tier_label"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.struct(F.lit(OTHER_TIER[0]).alias("tier"), F.lit(OTHER_TIER[1]).alias("tier_label")))


def cache_key(*parts: Column) -> Column:
    """40 hex digits over the parts; null counts as empty."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 40)


def request_fingerprint(method: Column, path: Column, body: Column) -> Column:
    return F.sha2(F.concat(method, F.lit(" "), path, F.lit("\n"), F.coalesce(body, F.lit(""))), 256)


def trace_parts(header: Column) -> Column:
    """struct(trace_id, span_id) of a valid trace header with ids that are not all zero, else null."""
    p = r"^[0-9a-f]{2}-([0-9a-f]{32})-([0-9a-f]{16})-[0-9a-f]{2}$"
    t, s = F.regexp_extract(header, p, 1), F.regexp_extract(header, p, 2)
    return F.when((t != "") & (t != "0" * 32) & (s != "0" * 16), F.struct(t.alias("trace_id"), s.alias("span_id")))


# Fixed value: a citation of a document's page.
CITATION = r"\[([A-Za-z][A-Za-z .]{0,30}), p\.\s?(\d{1,4})\]"


def citations(text: Column) -> Column:
    """The [Document, p.N] citations in a text as structs (doc_short, page), in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), F.lit(0))
    return F.transform(found, lambda c: F.struct(F.trim(F.regexp_extract(c, CITATION, 1)).alias("doc_short"), F.regexp_extract(c, CITATION, 2).cast("int").alias("page")))


def reading_minutes(words: Column) -> Column:
    """Whole minutes at 230 words a minute, at least one."""
    return F.greatest(F.lit(1), F.floor(words / 230 + 0.5)).cast("int")


# Fixed value: a sentence as the reader shows it.
READER_SENTENCE = r"[^.!?]+[.!?]+[\"”’)]?(?:(?U:\s)+|\z)|[^.!?]+\z"


def reader_sentences(text: Column) -> Column:
    """Sentences as a reader shows them: one closing quote stays with its sentence, white space at the ends goes. A text in which none is found is
    one sentence; null and blank texts have none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(READER_SENTENCE), F.lit(0))
    held = F.when(F.size(found) > 0, found).otherwise(F.array(F.coalesce(text, F.lit(""))))
    return F.filter(F.transform(held, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def hits_query(sentence: Column, query_tokens: Column) -> Column:
    """Whether a sentence has two of the query's distinct tokens, or its only one."""
    distinct = F.array_distinct(query_tokens)
    return (F.size(distinct) > 0) & (F.size(F.array_intersect(tokens(sentence), distinct)) >= F.least(F.lit(2), F.size(distinct)))


def marks_sentence(selection: Column, sentence: Column) -> Column:
    """Whether a selection marks a sentence, without regard to case and white space: one lies within the other, or, from 12 characters on, the
    sentence has the selection's first or last 30 characters. Sentences below three characters are never marked; an empty selection marks all others,
    a null one none."""
    a, b = F.lower(squash(selection)), F.lower(squash(sentence))
    ends = (F.length(a) >= 12) & (b.contains(F.substring(a, 1, 30)) | b.contains(F.substring(a, -30, 30)))
    return selection.isNotNull() & (F.length(b) >= 3) & (a.contains(b) | b.contains(a) | ends)


def slug(text: Column) -> Column:
    """Lower case, everything but letters and digits as single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def age_label(now_ms: Column, at_ms: Column) -> Column:
    """How long ago `at_ms` was, rounded: just now, minutes, hours; from a day on its date in UTC."""
    rounded = lambda x: F.floor(x + 0.5)
    seconds = rounded((now_ms - at_ms) / 1000)
    label = lambda d, unit: F.concat(rounded(seconds / d).cast("string"), F.lit(unit))
    day = F.date_format(F.date_from_unix_date(F.floor(at_ms / F.lit(86_400_000)).cast("int")), "yyyy-MM-dd")
    return F.when(seconds < 60, "just now").when(seconds < 3600, label(60, " min ago")).when(seconds < 86400, label(3600, " h ago")).otherwise(day)


# What is escaped, links out of the text, and inline marks with their HTML, in order.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
LINK = r"\[([^\]]{1,300})\]\((https?://[^\s)\"<>]{1,2000})\)"
INLINE = [
    (r"\*\*(.+?)\*\*", "<strong>$1</strong>"), (r"(^|[^*])\*(?!\s)(.+?)\*(?!\*)", "$1<em>$2</em>"), (r"(^|\W)_(?!\s)(.+?)_(?=\W|$)", "$1<em>$2</em>"), (r"`(.+?)`", "<code>$1</code>"),
    (r"\[([A-Za-z][A-Za-z .]{0,30}?) *, p\.\s?(\d{1,4})\]", '<a href="#" class="ref" data-short="$1" data-page="$2">[$1, p.$2]</a>'),
]


def _inline(line: Column) -> Column:
    """Inline marks of an escaped line. Links are set aside first, so that no mark in a URL counts."""

    def marked(links: Column) -> Column:
        hole = lambda i: F.concat(F.lit("\x00"), F.array_position(links, i).cast("string"), F.lit("\x00"))
        out = F.aggregate(links, line, lambda acc, x: F.replace(acc, x, hole(x)))
        for pattern, new in INLINE:
            out = F.regexp_replace(out, pattern, new)
        anchor = lambda x: F.concat(F.lit('<a href="'), F.regexp_extract(x, LINK, 2), F.lit('" target="_blank" rel="noopener noreferrer" class="ext">'), F.regexp_extract(x, LINK, 1), F.lit("</a>"))
        return F.aggregate(links, out, lambda acc, x: F.replace(acc, hole(x), anchor(x)))

    links = F.array_sort(F.array_distinct(F.regexp_extract_all(line, F.lit(LINK), F.lit(0))), lambda a, b: F.length(b) - F.length(a))
    return F.get(F.transform(F.array(links), marked), F.lit(0))


def markdown_html(text: Column) -> Column:
    """Markdown as HTML, escaped first: headings, bullet and numbered lists, paragraphs, bold, emphasis, code, http(s) links, citations as
    links into the book. A line decides by itself; lists open and close where the kind of the line before differs."""
    escaped = F.coalesce(text, F.lit(""))
    for a, b in ESCAPES:
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    shapes = [("h3", r"^#{1,6}\s+(.*)$"), ("ul", r"^\s*[-*•]\s+(.*)$"), ("ol", r"^\s*\d+[.)]\s+(.*)$")]

    def shaped(raw: Column) -> Column:
        line = F.regexp_replace(raw, r"(?U)\s+$", "")
        kinds = F.coalesce(*[F.when(line.rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract(line, p, 1).alias("body"))) for k, p in shapes], F.struct(F.when(line != "", "p").otherwise("").alias("kind"), line.alias("body")))
        return kinds

    def page(rows: Column) -> Column:
        listed = lambda i: F.when(F.get(rows, i)["kind"].isin("ul", "ol"), F.get(rows, i)["kind"]).otherwise("")

        def one(row: Column, i: Column) -> Column:
            before = F.when(i > 0, listed(i - 1)).otherwise("")
            mine = listed(i)
            close = F.when((before != "") & (before != mine), F.concat(F.lit("</"), before, F.lit(">"))).otherwise("")
            begin = F.when((mine != "") & (before != mine), F.concat(F.lit("<"), mine, F.lit(">"))).otherwise("")
            tag = F.when(mine != "", "li").otherwise(row["kind"])
            body = F.when(row["kind"] != "", F.concat(F.lit("<"), tag, F.lit(">"), _inline(row["body"]), F.lit("</"), tag, F.lit(">"))).otherwise("")
            return F.concat(close, begin, body)

        last = listed(F.size(rows) - 1)
        return F.concat(F.array_join(F.transform(rows, one), ""), F.when(last != "", F.concat(F.lit("</"), last, F.lit(">"))).otherwise(""))

    rows = F.transform(F.split(escaped, "\n"), shaped)
    return F.get(F.transform(F.array(rows), page), F.lit(0))
