import random
import time

import pytest

from leafmill.llm import ocr


def plain_fold(text):
    """Every replacement in turn, over one line."""
    t = "".join(text.lower().split())
    for a, b in ocr._ONE + ocr._REST:
        t = t.replace(a, b)
    return t


def plain_is_number(marks, w):
    w = w.strip("-–—[]().|/ ").lower()
    return bool(w) and (w in marks.numbers or ocr._AS_DIGITS.fullmatch(w) is not None and w.translate(ocr._DIGITS) in marks.numbers or w.isalpha() and plain_fold(w) == marks.roman)


def page(rng, n):
    letters = "rnmvwuhdcifle10! ivxlcm-" + rng.choice(["", "", "\xa0\u2009", "éﬁﬂİΣ\x85"]) + "\t"
    lines = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(n)]
    return "\n".join(rng.choice(["{}", "{} 17", "xvii | {}", "l7 {}", "{} XVI1", "- 17 -"]).format(x) for x in lines)


@pytest.mark.parametrize("number", [None, 0, 17, 101])
def test_lines_of_a_page_are_folded_as_each_alone(number):
    rng = random.Random(3)
    marks = ocr.PageMarks("t", number)
    for _ in range(300):
        text = page(rng, 12)
        lines = text.split("\n")
        assert ocr.folded_lines(text) == [plain_fold(x) for x in lines] == [ocr.fold(x) for x in lines]
        assert all(marks.is_number(w) == plain_is_number(marks, w) for w in text.split())
        assert marks.forms(text) == [plain_fold(marks.split_number(x)[0]) for x in lines]


def test_words_of_a_page_with_and_without_breaks():
    rng = random.Random(5)
    for _ in range(2000):
        text = "".join(rng.choices("ab- ¬\n\n \t\xa0", k=rng.randint(0, 14)))
        want, skip = [], False
        for ws in filter(None, (line.split() for line in text.split("\n"))):
            ws = ws[1:] if skip else ws
            skip = bool(ws) and ws[-1][-1] in ocr.BREAKS
            want += ws[:-1] if skip else ws
        assert list(ocr._running_words(text)) == want


def test_a_page_is_folded_at_once():
    """Line by line, the same page takes several times as long."""
    text = "\n".join(f"Reviewers in {x} noted that work in policing was slower than the reserve" for x in ("Nequi", "Sol", "Rida", "Oost") * 10)
    marks = ocr.PageMarks("t", 17)
    took = lambda f: min((lambda t: (f(), time.process_time() - t)[1])(time.process_time()) for _ in range(30))
    assert took(lambda: marks.forms(text)) < 0.7 * took(lambda: [marks.form(x) for x in text.split("\n")])
