"""Repair of text from scanned pages: page furniture, words broken over lines, misread characters.

1. One pass counts the words of all pages. Words seen LEAST times are known, at every size of the input, without those that are a
   misreading of a far more frequent one.
   Another counts, by document, the lines of its pages without page numbers, in a form that is the same for usual misreadings: those that stand
   on a good part of the pages are its running headers and footers, whatever they say.
2. A further pass takes each page as a whole. Lines that repeat in this way, hold the page number, or are the document's title or a run of its words
   are furniture. A word cut at a line's end and the next line of running text are a case, and so is every word that is
   not known.
3. Each distinct word of the cases is looked up once: the automaton of its misreadings is intersected with tries of the known words.
   A broken word is joined if the joined word, and not the compound with the hyphen, is known. Of several candidates for a misread word
   the one that best follows and precedes its neighbours stands, then the more frequent; only pairs that are asked for are counted.
4. What was found is reported line by line, or applied: furniture goes, broken words are joined, words are put right,
   and lines are reflowed into paragraphs. Pages in which nothing was found are left as they are.

Known words, cases and candidates are tables; words meet tries of at most about SHARD known words, in blocks of QUERIES words. Only the
most frequent HOT words go to all tasks, to keep certain cases out of the joins; what is rarer is joined, so nothing depends on them.
Pages are read again rather than shuffled, except to apply the repairs.

Cases: null and empty pages have no lines to repair; a null title, page number or document only switches off the
rules that need it; repeated pages are repaired alike, and reported once; very long pages are like others; an
empty table has an empty vocabulary and result; other columns pass through `repaired` unchanged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import automaton
from leafmill.session import materialise

#: The least count of a known word.
LEAST = 3
#: Known words of a trie, words looked up by a task, and words and pairs of words that tasks may hold to keep rows out of joins.
SHARD, QUERIES, HOT = 100_000, 20_000, 200_000
#: A word is taken for a misreading if its printed form is so many times as frequent; fewer if it has digits or signs in it.
RATIO, RATIO_ODD = 20, 2

#: A line repeats if it stands on so many pages of its document, and on such a share of them.
REPEATS, REPEAT_SHARE = 3, 0.2
#: Characters of a line with nothing but a page number and marks or words for "page" about it, at most.
NUMBER_LINE = 24

# Marks at which typesetting breaks words, and what may surround a word.
BREAKS = "-¬\xad‐"
AROUND = " \t.,;:?()[]{}\"'“”‘’«»…—–/\\*•·<>="
AFTER_SUSPENDED = {"and", "or", "to", "nor", "but", "et", "ou", "na", "au"}
_BROKEN = re.compile(rf"[{BREAKS}][^\S\n]*(?:\n|\Z)")  # "-" comes first in BREAKS
_INSIDE = re.compile(r"[;:,()\[\]{}\"/\\=<>]")
_PLAIN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_KNOWN = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
_DIGITS = str.maketrans("oOlI|i!sS$bBgqzZ", "0011111555689922")
_AS_DIGITS = re.compile(r"[0-9oOlI|i!sS$bBgqzZ]+")
_YEAR = re.compile(r"(?:19|20)\d\d")
_FOLDED = [("0", "o"), ("1", "i"), ("!", "i"), ("|", "i"), ("l", "i"), ("@", "a"), ("5", "s"), ("$", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("e", "c"), ("t", "f"), ("ﬁ", "fi"), ("ﬂ", "fi"), ("h", "ii"), ("u", "ii"), ("d", "ci"), ("vv", "w"), ("rn", "m"), ("ri", "n"), ("in", "m"), ("n", "m"), ("fi", "ci"), ("mm", "m")]




_ONE = [(a, b) for a, b in _FOLDED if len(a) == len(b) == 1 and a not in "n" and (a + b).isascii()]  # those before all others that yield one of them
_TABLE = bytes.maketrans("".join(a for a, _ in _ONE).encode(), "".join(b for _, b in _ONE).encode())
_REST = [x for x in _FOLDED if x not in _ONE]
_REST_ASCII = [x for x in _REST if x[0].isascii()]
_BLANKS = "".join(c for c in map(chr, range(128)) if c.isspace() and c != "\n").encode()
_WIDE_BLANK = re.compile(r"[^\S\x00-\x7f]")
_ROMAN_FOLDED = frozenset("mcixvwn")  # all letters of folded roman numbers


def folded_lines(text: str) -> list[str]:
    """`fold` of each line of a text, in one go: nothing is folded over the end of a line."""
    t = text.lower()
    if not t.isascii() and _WIDE_BLANK.search(t):
        t = "\n".join("".join(x.split()) for x in t.split("\n"))
    t = t.encode("utf-8", "surrogatepass").translate(_TABLE, _BLANKS).decode("utf-8", "surrogatepass")  # bytes of other letters stay
    for a, b in _REST if not t.isascii() else _REST_ASCII:
        t = t.replace(a, b)
    return t.split("\n")


def fold(text: str) -> str:
    """A form that is the same for a text and its usual misreadings."""
    return folded_lines(text.replace("\n", " "))[0]


_fold_word = lru_cache(1 << 18)(fold)


@lru_cache(1 << 18)
def _number_forms(word: str) -> tuple[str, str, str]:
    """A word that may be a page number, as it stands, as digits, and as a folded roman number; empty if it is none."""
    w = word.strip("-–—[]().|/ ").lower()
    digits, folded = w.translate(_DIGITS) if _AS_DIGITS.fullmatch(w) else "", _fold_word(w) if w.isalpha() else ""
    if not digits and not (folded and _ROMAN_FOLDED.issuperset(folded)):
        if len(_NO_NUMBER) > 500_000:
            _NO_NUMBER.clear()
        _NO_NUMBER.add(word)
    return w, digits, folded


_NO_NUMBER: set[str] = set()  # words met that are no page's number


def roman(n: int) -> str:
    out = ""
    for v, r in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= v:
            out, n = out + r, n - v
    return out


_DIGIT_OF = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def is_roman(word: str) -> bool:
    """Whether `word` is a well-formed roman number."""
    v = [_DIGIT_OF.get(c, 0) for c in word]
    return bool(v) and all(v) and len(v) < 20 and roman(sum(-a if a < b else a for a, b in zip(v, v[1:] + [0]))) == word


def year_of(word: str) -> str | None:
    """The year that `word` is a misreading of."""
    if len(word) == 4 and word[0] in "12lI|" and not word.isdigit() and sum(c.isdigit() for c in word) >= 2:
        y = word.translate(_DIGITS)
        if _YEAR.fullmatch(y):
            return y
    return None


@lru_cache(1 << 14)
def _page_forms(page: int) -> tuple[set[str], str]:
    """A page number as it is written, and folded as a roman one."""
    return {str(page), roman(page) or str(page)}, fold(roman(page))


@lru_cache(maxsize=4096)
def _title_forms(title: str) -> frozenset[str]:
    """Folded: a title, and all its runs of three and more words."""
    words = title.split()
    return frozenset([fold(title)] if title else []) | frozenset(fold(" ".join(words[a:b])) for a in range(len(words)) for b in range(a + 3, len(words) + 1))


class PageMarks:
    """Recognises the furniture lines of one page by its number, its document's title and the lines that repeat in its document."""

    def __init__(self, title: str | None, page: int | None, repeated: frozenset[int] = frozenset(), lengths: tuple[int, int] = (0, 0)) -> None:
        self.page = page
        self.numbers, self.roman = (set(), "") if page is None else _page_forms(page)
        self.titles = _title_forms(title or "")
        self.repeated = repeated
        self.shortest, self.longest = lengths
        self.most_words = len(title.split()) + 2 if title else 0

    def is_number(self, w: str) -> bool:
        plain, digits, folded = _number_forms(w)
        return plain in self.numbers or digits in self.numbers or folded != "" and folded == self.roman

    def forms(self, text: str) -> list[str]:
        """`form` of each line of a text."""
        out = folded_lines(text)
        for k, s in enumerate(text.split("\n")):
            if out[k]:
                first, last = s.split(None, 1)[0], s.rsplit(None, 1)[-1]
                if not (first in _NO_NUMBER and last in _NO_NUMBER) and (self.is_number(last) or self.is_number(first)):
                    out[k] = self.form(s)
        return out

    def split_number(self, s: str) -> tuple[str, bool]:
        """A line without the page number at its start or end."""
        words = s.split()
        if words and self.is_number(words[-1]):
            return s.rstrip()[: len(s.rstrip()) - len(words[-1])].rstrip(" |/–—-\t"), True
        if words and self.is_number(words[0]):
            return s.lstrip()[len(words[0]) :].lstrip(" |/–—-\t"), True
        return s.strip(), False

    def bare(self, s: str) -> str | None:
        """'sure' if a line is the page number with marks or words about it, 'maybe' if a lone number, None otherwise."""
        t = s.strip()
        if len(t) > NUMBER_LINE or self.page is None:
            return None
        if re.fullmatch(r"(?i)\W*(?:page|p\.?|pg\.?|seite|ukurasa)\s*(\S+?)(?:\s*(?:of|/|de|sur|ya)\s*\S+)?\W*", t):
            inner = re.fullmatch(r"(?i)\W*[a-z]+\.?\s*(\S+?)(?:\s*(?:of|/|de|sur|ya)\s*\S+)?\W*", t)
            return "sure" if inner and self.is_number(inner.group(1)) else None
        core = t.strip("-–—[]() ")
        if core != t and self.is_number(core) and not core.endswith("."):
            # a marker such as "(i)" opens an item; alone on its line it is the number
            return "sure"
        return "maybe" if self.is_number(t.rstrip(".")) and not t[0] in "[(" else None

    def form(self, s: str) -> str:
        """A line without the page number, folded."""
        return fold(self.split_number(s)[0])

    def may_run(self, s: str, n_words: int) -> bool:
        """Whether a line of `n_words` words needs to be looked at: only one as long as one that repeats, or of as few words as the title."""
        return n_words <= self.most_words or bool(self.repeated) and self.shortest <= len(s) <= self.longest

    def runs(self, form: str) -> bool:
        """Whether a line of this form is a running header or footer, with or without the number."""
        return bool(form) and (form in self.titles or bool(self.repeated) and xxhash.xxh64_intdigest(form) - 2**63 in self.repeated)


def furniture(lines: list[str], words: list[list[str]], marks: PageMarks) -> list[bool]:
    """Which lines are page furniture."""
    n = len(lines)
    out = [False] * n
    maybe, looked_at = [], []
    for k in range(n):
        if not words[k]:
            continue
        kind = marks.bare(lines[k])
        if kind is None and marks.may_run(lines[k], len(words[k])):
            looked_at.append(k)
        elif kind == "sure":
            out[k] = True
        elif kind == "maybe":
            maybe.append(k)
    for k, form in zip(looked_at, marks.forms("\n".join(lines[k] for k in looked_at))):
        out[k] = marks.runs(form)
    for k in maybe:
        before, after = lines[k - 1].strip() if k else "", lines[k + 1].strip() if k + 1 < n else ""
        above, below = k and (out[k - 1] or k - 1 in maybe), k + 1 < n and (out[k + 1] or k + 1 in maybe)
        apart = not before or above or below
        if lines[k].strip().endswith("."):  # not the end of a sentence that ran over
            out[k] = bool(apart or before[-1] in ".!?:;" or before[-1] in BREAKS)
        else:
            out[k] = bool(apart or not after)
    return out


def word_of(token: str) -> str:
    """A token as a word: without what surrounds it, in lower case; empty if it is none."""
    w = token.strip(AROUND).strip(BREAKS).strip(AROUND).lower()
    return "" if _INSIDE.search(w) or not any(c.isalpha() for c in w) else w


@dataclass
class Vocabulary:
    """The known words as a table (word, n)."""

    words: DataFrame

    @property
    def counts(self) -> dict[str, int]:
        """All of them on the driver: for small inputs."""
        return {r.word: r.n for r in self.words.toLocalIterator()}

    def hot(self) -> dict[str, int]:
        """The most frequent words, HOT at most; all others are rarer than each of them."""
        top = [(r.word, r.n) for r in self.words.orderBy(F.desc("n")).limit(HOT + 1).collect()]
        return {w: n for w, n in top if len(top) <= HOT or n > top[-1][1]}


def costs(words: list[str]) -> np.ndarray:
    """The cost up to which candidates of each word are looked for."""
    return np.array([1 if len(w) < 3 else 2 if len(w) < 5 else 3 if len(w) < 9 else 4 for w in words], np.int64)


def meet(asked: DataFrame, known: DataFrame, edits: bool, keep: Callable[[str, int, str, int], bool] | None = None) -> DataFrame:
    """(word, found, cost, n): the known words (word, n) within the cost of each of `asked` (word, m); `keep` judges (word, m, found, n). Both are read more than once."""
    shards = max(1, -(-known.count() // SHARD))
    blocks = max(-(-asked.count() // QUERIES), -(-3 * known.sparkSession.sparkContext.defaultParallelism // shards))

    def search(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(mine) and len(theirs):
            words, n = mine["word"].tolist(), dict(zip(theirs["found"], theirs["k"]))
            trie = automaton.Trie.of(list(n))
            q, w, cost = automaton.candidates(words, trie, costs(words), edits)
            listed = set(zip(*(x.tolist() for x in automaton.candidates(words, trie, costs(words), False)[:2]))) if edits else None
            m = mine["m"].tolist()
            for a, b, c in zip(q.tolist(), w.tolist(), cost.tolist()):
                x = trie.words[b]
                if keep is None or keep(words[a], m[a], x, n[x]):
                    rows.append((words[a], x, c, n[x], listed is None or (a, b) in listed))
        return pd.DataFrame(rows, columns=["word", "found", "cost", "n", "listed"])

    part = lambda k: F.pmod(F.xxhash64("word"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = asked.select("word", "m", part(blocks).alias("b"), every(shards).alias("s")).repartition(shards * blocks, "s", "b")
    right = known.select(F.col("word").alias("found"), F.col("n").alias("k"), part(shards).alias("s"), every(blocks).alias("b")).repartition(shards * blocks, "s", "b")
    return left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInPandas(search, "word string, found string, cost int, n long, listed boolean")


Repeated = tuple[frozenset[int], tuple[int, int]]
NONE: Repeated = (frozenset(), (0, 0))


def repeated_lines(pages: DataFrame) -> DataFrame:
    """(doc, repeated, shortest, longest): hashes of the folded lines that repeat on the pages (doc, text, page) of each document, at most as many as a page
    has lines, divided by REPEAT_SHARE; and the length of the shortest and longest of these lines as they stand."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, dict[int, list[int]]] = {}  # by document and form: pages, shortest and longest line, and the last page counted
        at = size = 0

        def flush() -> pd.DataFrame:
            n, lo, hi, _ = zip(*(x for forms in held.values() for x in forms.values())) if held else ((), (), (), ())
            docs, forms = [d for d, forms in held.items() for _ in forms], [f for forms in held.values() for f in forms]
            held.clear()
            return pd.DataFrame({"doc": pd.Series(docs, dtype=object), "form": pd.Series(forms, dtype="int64"), "n": pd.Series(n, dtype="int64"), "lo": pd.Series(lo, dtype="int32"), "hi": pd.Series(hi, dtype="int32")})

        for b in batches:
            for doc, page, text in zip(b["doc"].tolist(), b["page"].tolist(), b["text"].tolist()):
                forms = PageMarks(None, None if pd.isna(page) else int(page)).forms(text)
                mine = held.setdefault(doc, {})
                size -= len(mine)
                at += 1
                for line, f in zip(text.split("\n"), forms):
                    if f:
                        h, n = xxhash.xxh64_intdigest(f) - 2**63, len(line)
                        x = mine.get(h)
                        if x is None:
                            mine[h] = [1, n, n, at]
                            continue
                        if x[3] != at:
                            x[0], x[3] = x[0] + 1, at
                        if n < x[1]:
                            x[1] = n
                        elif n > x[2]:
                            x[2] = n
                size += len(mine)
                if not mine:
                    del held[doc]
            if size > 300_000:
                yield flush()
                size = 0
        yield flush()

    told = pages.where("doc IS NOT NULL AND text <> ''").select("doc", "page", "text")
    counted = told.mapInPandas(count, "doc string, form long, n long, lo int, hi int").groupBy("doc", "form").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    whole = told.groupBy("doc").agg(F.count("*").alias("n_pages"))
    often = counted.where(F.col("n") >= REPEATS).join(whole, "doc").where(F.col("n") >= REPEAT_SHARE * F.col("n_pages"))
    return often.groupBy("doc").agg(F.collect_set("form").alias("repeated"), F.min("lo").alias("shortest"), F.max("hi").alias("longest"))


def lines_of(text: str, title: str | None, page: int | None, repeated: Repeated = NONE) -> tuple[list[str], list[list[str]], list[bool], list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Lines, their tokens, furniture, pairs of lines with a word or compound broken between them, and (line, first, end) of the whole
    tokens of running text."""
    lines = text.split("\n")
    words = [x.split() for x in lines]
    out = furniture(lines, words, PageMarks(title, page, *repeated))
    running = [k for k in range(len(lines)) if words[k] and not out[k]]
    breaks = [(k, m) for k, m in zip(running, running[1:]) if words[k][-1][-1] in BREAKS and len(words[k][-1]) > 1]
    ended, begun = {k for k, _ in breaks}, {m for _, m in breaks}
    return lines, words, out, breaks, [(k, int(k in begun), len(words[k]) - (k in ended)) for k in running]


def neighbours(words: list[list[str]], k: int, j: int) -> tuple[str, str]:
    return (word_of(words[k][j - 1]) if j else ""), (word_of(words[k][j + 1]) if j + 1 < len(words[k]) else "")


def doubted(token: str, sure: dict[str, int]) -> tuple[str, bool] | None:
    """The word of a token that may need repair, and whether it is a year; None if it needs none."""
    w = word_of(token)
    if not w:
        bare = token.strip(AROUND)
        return (bare, True) if year_of(bare) else None
    if w in sure or w.rstrip("!|") in sure or w[0] == "|" and w.lstrip("!|") in sure:
        return None
    if year_of(w):
        return w, True
    return None if len(w) < 3 and w.isalpha() or is_roman(w) else (w, False)


def broken_case(left: str, right: str, mark: str, sure: dict[str, int]) -> tuple[str | None, tuple[str, str] | None]:
    """The whole word of two halves if it is certain; else the halves, if they can be one word."""
    a, b = left.strip(AROUND).lower(), right.strip(AROUND).rstrip(BREAKS).lower()
    if not a or not b or not a[-1].isalpha() or not b[0].isalpha():
        return None, None
    whole, made = sure.get(a + b, 0), sure.get(f"{a}-{b}", 0)
    if whole and whole >= made:
        return a + b, None
    return None, None if whole else (a, b)


_CASE = "line_no long, token int, kind string, word string, a string, b string, mark string, settled boolean"


def cases(pages: DataFrame, sure: dict[str, int]) -> DataFrame:
    """(who, and the columns of _CASE) of pages (who, text, title, page, repeated): what stands on a page for repair. Settled cases have their
    outcome in `word`. Others are halves `a` and `b` of a broken word with their mark, or a word that may be misread between
    its neighbours `a` and `b`."""
    known = pages.sparkSession.sparkContext.broadcast(sure)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sure = known.value
        seen: dict[str, tuple[str, bool]] = {}
        right: set[str] = set()
        for batch in batches:
            out: list[tuple] = []
            for who, (text, title, page, repeated) in zip(batch["who"].tolist(), _batches(batch)):
                if not text:
                    continue
                _, words, gone, breaks, running = lines_of(text, title, page, repeated)
                out += [(who, k, -2, "furniture", "", None, None, None, True) for k, g in enumerate(gone) if g]
                for k, m in breaks:
                    last = words[k][-1]
                    whole, halves = broken_case(last.rstrip(BREAKS), words[m][0], last[-1], sure)
                    if whole:
                        out.append((who, k, -1, "broken", whole, None, None, None, True))
                    elif halves:
                        out.append((who, k, -1, "broken", None, *halves, last[-1], False))
                for k, lo, hi in running:
                    ws = words[k]
                    if right.issuperset(ws):
                        continue
                    for j in range(lo, hi):
                        t = ws[j]
                        if t in right:
                            continue
                        got = seen.get(t) or doubted(t, sure)
                        if got is None:
                            right.add(t)
                            continue
                        seen[t] = got
                        w, year = got
                        out.append((who, k, j, "misread", year_of(w), None, None, None, True) if year else (who, k, j, "misread", w, *neighbours(words, k, j), None, False))
                if len(seen) + len(right) > 1_000_000:
                    seen.clear()
                    right.clear()
            cols = list(zip(*out)) or [()] * 9
            names = ("who", "line_no", "token", "kind", "word", "a", "b", "mark", "settled")
            kinds = {"line_no": "int64", "token": "int32", "settled": "bool"}
            yield pd.DataFrame({c: pd.Series(list(x), dtype=kinds.get(c, object)) for c, x in zip(names, cols)})

    return pages.mapInPandas(rows, f"who {pages.schema['who'].dataType.simpleString()}, {_CASE}")


def candidates(words: DataFrame, known: DataFrame) -> DataFrame:
    """(word, found, cost, n, listed): the known words that each of `words` (word) may stand for."""
    asked = materialise(words.distinct().withColumn("m", F.lit(0).cast("long")))
    return materialise(meet(asked, known, edits=True))


def _first(found: Column) -> Column:
    """The most frequent of candidates, then the first by letters."""
    return F.get(F.array_sort(F.transform(found, lambda x: F.struct((-x["n"]).alias("n"), x["found"].alias("found")))), F.lit(0))["found"]


def settled(found: DataFrame, known: DataFrame, pages: DataFrame) -> DataFrame:
    """(who, line_no, token, kind, word): the outcome of `found` cases of `pages` (text) that are repairs."""
    keys = ["who", "line_no", "token", "kind"]
    open_ = found.where("NOT settled")
    misread = open_.where("kind = 'misread'").select(*keys, "word", "a", "b")
    broken = open_.where("kind = 'broken'").select(*keys, "a", "b", "mark")
    # words that stand in the vocabulary, or do without signs read into them, are right
    plain = F.array(F.col("word"), F.regexp_replace("word", r"[!|]+$", ""), F.when(F.col("word").startswith("|"), F.regexp_replace("word", r"^[!|]+", "")))
    words = misread.select("word").distinct()
    right = words.select("word", F.explode(F.array_distinct(F.array_compact(plain))).alias("form")).join(known.select(F.col("word").alias("form")), "form", "left_semi")
    unknown = words.join(right.select("word").distinct(), "word", "left_anti")
    halves = broken.select("a", "b", "mark").distinct().select("*", F.concat("a", "b").alias("joined"), F.concat_ws("-", "a", "b").alias("compound"))
    for c in ("joined", "compound", "a", "b"):
        halves = halves.join(known.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}")), c, "left")
    halves = materialise(halves)
    new = halves.where("n_joined IS NULL AND n_compound IS NULL")
    got = candidates(unknown.unionByName(new.select(F.explode(F.array("joined", "compound")).alias("word"))), known)

    each = got.groupBy("word").agg(F.min("cost").alias("least"), F.collect_list(F.struct("cost", "found", "n", "listed")).alias("all"))
    least = F.filter("all", lambda x: x["cost"] == F.col("least"))
    # a dearer candidate is weighed only as a misreading: one plain edit leads to many words
    near = F.filter("all", lambda x: (x["cost"] == F.col("least")) | (x["cost"] == F.col("least") + 1) & x["listed"])
    each = each.select("word", "least", _first(least).alias("first"), F.when(F.size(least) > 1, least).otherwise(near).alias("pool"))
    each = materialise(each)

    one, two = each.select(F.col("word").alias("joined"), F.col("least").alias("one"), "first"), each.select(F.col("word").alias("compound"), F.col("least").alias("two"))
    whole, made = F.coalesce("n_joined", F.lit(0)), F.coalesce("n_compound", F.lit(0))
    suspended = (F.col("mark") == "-") & F.col("b").isin(*AFTER_SUSPENDED)
    word = (
        F.when((whole > 0) | (made > 0), F.when(whole >= made, F.col("joined"))).when(suspended, None)
        .when(F.col("one").isNotNull() | F.col("two").isNotNull(), F.when(F.coalesce("two", F.lit(99)) >= F.coalesce("one", F.lit(99)), F.col("first")))
        .when((F.col("mark") == "-") & F.col("n_a").isNotNull() & F.col("n_b").isNotNull(), None).otherwise(F.col("joined"))
    )
    halves = halves.join(one, "joined", "left").join(two, "compound", "left").select("a", "b", "mark", word.alias("word"))

    single, several = each.where(F.size("pool") == 1), each.where(F.size("pool") > 1)
    places = materialise(misread.select("word", "a", "b").distinct().join(several.select("word", "least", F.explode("pool").alias("p")), "word").select("word", "a", "b", "least", "p.*"))
    pairs = neighbour_counts(pages, places.select(F.explode(F.array(F.struct("a", F.col("found").alias("b")), F.struct(F.col("found").alias("a"), "b"))).alias("x")).select("x.*"))
    before, after = pairs.select("a", F.col("b").alias("found"), F.col("n").alias("n1")), pairs.select(F.col("a").alias("found"), "b", F.col("n").alias("n2"))
    fit = F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))
    value = F.when((F.col("cost") == F.col("least")) | (fit > 0), fit / (F.col("n") + 1)).otherwise(-1.0)
    ranked = places.join(before, ["a", "found"], "left").join(after, ["found", "b"], "left").select("word", "a", "b", F.struct((-value).alias("v"), (-F.col("n")).alias("n"), "cost", "found").alias("r"))
    best = ranked.groupBy("word", "a", "b").agg(F.min("r").alias("r")).select("word", "a", "b", F.col("r.found").alias("best"))

    return (
        found.where("settled").select(*keys, "word")
        .unionByName(broken.join(halves.where("word IS NOT NULL"), ["a", "b", "mark"]).select(*keys, "word"))
        .unionByName(misread.join(single.select("word", "first"), "word").select(*keys, F.col("first").alias("word")))
        .unionByName(misread.join(best, ["word", "a", "b"]).select(*keys, F.col("best").alias("word")))
    )


def put_right(token: str, word: str) -> str:
    """`token` with its word replaced, its surroundings and capitals kept."""
    core = token.strip(AROUND)
    a = token.find(core)
    new = word
    if len(core) > 1 and sum(c.isupper() for c in core) > len(core) / 2 and core[:2].isupper():
        new = word.upper()
    elif core[:1].isupper() or not core[:1].isalpha() and core[1:2].isupper():
        new = word[:1].upper() + word[1:]
    return token[:a] + new + token[a + len(core) :]


def reflowed(text: str, title: str | None, page: int | None, repairs: dict[tuple[int, int], str], repeated: Repeated = NONE) -> str:
    """The page as paragraphs separated by empty lines, with its `repairs` by line and token, -1 for a broken word."""
    lines, words, out, breaks, _ = lines_of(text, title, page, repeated)
    broken = {k: repairs[k, -1] for k, _ in breaks if (k, -1) in repairs}
    continued = {m: k for k, m in breaks if k in broken}
    glued = {m for k, m in breaks if k not in broken and words[m][0].strip(AROUND).lower() not in AFTER_SUSPENDED}
    right = {k: w for k, w in repairs.items() if k[1] >= 0}
    if not any(out) and not broken and not right:
        return text
    paragraphs: list[list[str]] = [[]]
    gap = False
    for k in range(len(lines)):
        if out[k]:
            continue
        if not words[k]:
            gap = True
            continue
        ws = [put_right(w, right[k, j]) if (k, j) in right else w for j, w in enumerate(words[k])]
        if k in continued:
            tail = words[k][0]
            ws = ws[1:]
            closing = tail[len(tail.rstrip(AROUND)) :]
            if paragraphs[-1]:
                paragraphs[-1][-1] += closing
            elif len(paragraphs) > 1:
                paragraphs[-2][-1] += closing
        elif gap and paragraphs[-1] and (paragraphs[-1][-1][-1] in ".!?:;”\"'’)]" or not words[k][0][0].islower()):
            paragraphs.append([])
        elif paragraphs[-1] and re.match(r"(?:\(?[a-z0-9]{1,4}[.)]|[•·*–-])$", words[k][0]):
            paragraphs.append([])
        if k in broken:
            last = words[k][-1]
            head = last[: len(last) - len(last.lstrip(AROUND))]
            core = last.strip(AROUND)
            whole = broken[k]
            if core[:2].isupper():
                whole = whole.upper()
            elif core[:1].isupper():
                whole = whole[:1].upper() + whole[1:]
            ws[-1] = head + whole
        if k in glued and paragraphs[-1]:
            paragraphs[-1][-1] += ws.pop(0)
        paragraphs[-1].extend(ws)
        gap = False
    return "\n\n".join(" ".join(p) for p in paragraphs if p)


def _running_words(text: str) -> Iterator[str]:
    """The tokens of a page that are whole words: not the halves at line breaks."""
    if not _BROKEN.search(text):
        yield from text.split()
        return
    skip = False
    for line in text.split("\n"):
        ws = line.split()
        if not ws:
            continue
        if skip:
            ws = ws[1:]
        skip = bool(ws) and ws[-1][-1] in BREAKS
        yield from ws[:-1] if skip else ws


def word_counts(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all pages."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens: Counter[str] = Counter()

        def flush() -> pd.DataFrame:
            words: Counter[str] = Counter()
            for t, n in tokens.items():
                w = word_of(t)
                if w:
                    words[w] += n
            tokens.clear()
            return pd.DataFrame({"word": pd.Series(list(words), dtype=object), "n": pd.Series(list(words.values()), dtype="int64")})

        for b in batches:
            for t in b["text"]:
                if t:
                    tokens.update(_running_words(t))
            if len(tokens) > 300_000:
                yield flush()
        yield flush()

    counted = pages.select(F.col(text_col).alias("text")).mapInPandas(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def learn(pages: DataFrame, text_col: str = "text") -> Vocabulary:
    """The vocabulary of all pages."""

    def valid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[bool(_KNOWN.fullmatch(w)) and year_of(w) is None for w in b["word"]]]

    def doubtful(mine: str, m: int, other: str, n: int) -> bool:
        return other != mine and _PLAIN.fullmatch(other) is not None and n >= (RATIO if _PLAIN.fullmatch(mine) else RATIO_ODD) * m

    counts = word_counts(pages, text_col).where((F.col("n") >= LEAST) & F.length("word").between(1, 60))
    seen = materialise(counts.mapInPandas(valid, "word string, n long"))
    misread = meet(seen.withColumnRenamed("n", "m"), seen, edits=False, keep=doubtful).select("word").distinct()
    return Vocabulary(materialise(seen.join(misread, "word", "left_anti")))


def mistakable(words: dict[str, int]) -> set[str]:
    """Words for which one misread form can stand for another word too; for small vocabularies."""
    trie = automaton.Trie.of(list(words))
    q, w, cost = automaton.candidates(trie.words, trie, costs(trie.words), edits=False)
    return {trie.words[x] for a, b in zip(q.tolist(), w.tolist()) if a != b for x in (a, b)}


def neighbour_counts(pages: DataFrame, wanted: DataFrame, text_col: str = "text") -> DataFrame:
    """(a, b, n): how often `b` follows `a`, for the `wanted` pairs (a, b); pairs seen once are left out."""
    wanted = materialise(wanted.where("a <> '' AND b <> ''").distinct())
    few = [(r.a, r.b) for r in wanted.limit(HOT + 1).collect()]
    mine = pages.sparkSession.sparkContext.broadcast(frozenset(few) if len(few) <= HOT else None)  # too many: all pairs meet in the join

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only = mine.value
        pairs: Counter[tuple[str, str]] = Counter()

        def flush() -> pd.DataFrame:
            got = pd.DataFrame({"a": pd.Series([a for a, _ in pairs], dtype=object), "b": pd.Series([b for _, b in pairs], dtype=object), "n": pd.Series(list(pairs.values()), dtype="int64")})
            pairs.clear()
            return got

        for b in batches:
            for t in b["text"]:
                ws = t.lower().split() if t else []
                pairs.update(p for p in zip(ws, ws[1:]) if only is None or p in only)
                if len(pairs) > 300_000:
                    yield flush()
        yield flush()

    got = pages.select(F.col(text_col).alias("text")).mapInPandas(count, "a string, b string, n long")
    return got.join(wanted, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 1")


def _batches(b: pd.DataFrame) -> list[tuple[str | None, str | None, int | None, Repeated]]:
    known: dict[bytes, frozenset[int]] = {}

    def held(r: np.ndarray | None, lo: float, hi: float) -> Repeated:
        if r is None or len(r) == 0:
            return NONE
        key = np.asarray(r).tobytes()
        if key not in known:
            known[key] = frozenset(int(x) for x in r)
        return known[key], (int(lo), int(hi))

    return [(t, s, None if pd.isna(p) else int(p), held(*r)) for t, s, p, *r in zip(*(b[c] for c in ("text", "title", "page", "repeated", "shortest", "longest")))]


def _doc(pages: DataFrame, doc_col: str) -> Column:
    """The document's key; null, so that nothing repeats, in tables without one."""
    return F.col(doc_col).cast("string") if doc_col in pages.columns else F.lit(None).cast("string")


def _marked(pages: DataFrame, columns: dict[str, str], **more: Column) -> DataFrame:
    """(text, title, page, doc, repeated, shortest, longest, and `more`) of pages, with the lines that repeat in their documents."""
    cols = pages.select(*[F.col(columns[c]).alias(c) for c in ("text", "title", "page")], _doc(pages, columns["doc"]).alias("doc"), *[v.alias(k) for k, v in more.items()])
    return cols.join(materialise(repeated_lines(cols)), "doc", "left")


def _found(pages: DataFrame, vocabulary: Vocabulary | None) -> DataFrame:
    """The outcome of all cases of pages (who, text, title, page, repeated)."""
    known = vocabulary or learn(pages)
    return settled(materialise(cases(pages, known.hot())), known.words, pages)


def _columns(text_col: str, title_col: str, page_col: str, doc_col: str) -> dict[str, str]:
    return {"text": text_col, "title": title_col, "page": page_col, "doc": doc_col}


def repairs(
    pages: DataFrame, vocabulary: Vocabulary | None = None, id_col: str = "id", text_col: str = "text", title_col: str = "doc_title", page_col: str = "page", doc_col: str = "doc"
) -> DataFrame:
    """(id, line_no, kind, repaired): every repair, once."""
    found = _found(_marked(pages, _columns(text_col, title_col, page_col, doc_col), who=F.col(id_col)), vocabulary)
    return found.select(F.col("who").alias("id"), "line_no", "kind", F.col("word").alias("repaired")).distinct()


def repaired(pages: DataFrame, vocabulary: Vocabulary | None = None, text_col: str = "text", title_col: str = "doc_title", page_col: str = "page", doc_col: str = "doc") -> DataFrame:
    """`pages` with the text of scanned pages repaired and reflowed."""
    same = [F.col(text_col), F.col(title_col), F.col(page_col), _doc(pages, doc_col)]
    who = F.concat_ws(" ", F.hex(F.xxhash64(*same)), F.hex(F.xxhash64(F.lit(1), *same)))  # pages that are alike are repaired alike
    marked = _marked(pages, _columns(text_col, title_col, page_col, doc_col), who=who)
    each = _found(marked, vocabulary).groupBy("who").agg(F.collect_set(F.struct("line_no", "token", "word")).alias("__repairs"))
    each = each.join(marked.select("who", F.struct("repeated", "shortest", "longest").alias("__repeated")).dropDuplicates(["who"]), "who")

    @F.pandas_udf("string")
    def fix(text: pd.Series, title: pd.Series, page: pd.Series, repeated: pd.Series, shortest: pd.Series, longest: pd.Series, repairs: pd.Series) -> pd.Series:
        b = pd.DataFrame({"text": text, "title": title, "page": page, "repeated": repeated, "shortest": shortest, "longest": longest})
        return pd.Series([t if r is None else reflowed(t, s, p, {(x["line_no"], x["token"]): x["word"] for x in r}, m) for (t, s, p, m), r in zip(_batches(b), repairs)], dtype=object)

    rows = pages.withColumn("who", who).join(each, "who", "left")
    fixed = fix(*same[:3], *[F.col(f"__repeated.{c}") for c in ("repeated", "shortest", "longest")], F.col("__repairs"))
    return rows.withColumn(text_col, F.when(F.col("__repairs").isNull(), F.col(text_col)).otherwise(fixed)).select(*pages.columns)
