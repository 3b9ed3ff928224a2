import random

import pytest
from pyspark.sql import functions as F

from leafmill.llm import split

TEXTS = {
    "prose": "One sentence here. Another, rather longer sentence follows it there! " * 40,
    "paragraphs": ("Alpha beta gamma.\n\n" + "delta epsilon zeta eta " * 3 + "\n") * 30,
    "no boundary": "x" * 777,
    "wide": "日本語のテキスト。これは長い文です。" * 40,
    "mixed": "é́ñ🎉 naïve\n" * 90,
    "marks": "á" * 300,
    "short": "fits",
    "exact": "y" * 100,
    "one over": "z" * 101,
    "empty": "",
    "null": None,
}


def make(spark, texts, most=100, overlap=20, range_bytes=64):
    rows = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "id string, text string, k string")
    over = split.oversized(rows, "t", "id", "text", F.lit(most), F.lit(overlap))
    return split.text_ranges(over, range_bytes)


def check(text, pieces, most, overlap):
    pieces = sorted(pieces, key=lambda p: p.piece_no)
    assert [p.piece_no for p in pieces] == list(range(1, len(pieces) + 1))
    assert all(p.text == text[p.start_char : p.end_char] and 0 < len(p.text) <= most for p in pieces)
    assert pieces[0].start_char == 0 and pieces[-1].end_char == len(text)
    assert all(b.start_char == max(0, a.end_char - overlap) and b.end_char > a.end_char for a, b in zip(pieces, pieces[1:]))
    assert pieces[0].text + "".join(p.text[overlap if i else 0 :] for i, p in enumerate(pieces[1:], 1)) == text


@pytest.mark.parametrize(("most", "overlap", "range_bytes"), [(100, 20, 64), (100, 0, 37), (60, 31, 1000), (100, 20, 7)])
def test_round_trip(spark, most, overlap, range_bytes):
    got = {}
    for p in split.pieces(make(spark, TEXTS, most, overlap, range_bytes)).collect():
        got.setdefault(p.item.item_id, []).append(p)
    over = {k for k, v in TEXTS.items() if v and len(v) > most}
    assert got.keys() == over and all(len(v) > 1 for v in got.values())
    for k, v in got.items():
        check(TEXTS[k], v, most, overlap)


def test_natural_places(spark):
    by = {}
    for p in split.pieces(make(spark, TEXTS)).collect():
        by.setdefault(p.item.item_id, set()).add(p.cut)
    assert by["paragraphs"] <= {"paragraph", "sentence", "line", "word", "end"} and "paragraph" in by["paragraphs"]
    assert by["no boundary"] == {"none", "end"}
    assert "sentence" in by["wide"]
    for p in split.pieces(make(spark, TEXTS)).collect():
        if p.item.item_id == "marks" and p.cut == "none":
            assert p.end_char % 2 == 0


def test_hard_cuts_only_where_no_boundary_is_in_reach(spark):
    """Brute force: a piece ends hard only if no boundary lies within the room after the cut before it, or in the reach of a run that is
    longer than a piece."""
    rng = random.Random(11)
    texts = {f"t{i}": "".join(rng.choice(["word " * rng.randint(1, 30), "x" * rng.randint(1, 75), "End. ", "y" * rng.randint(60, 200) + " "]) for _ in range(12)) for i in range(40)}
    texts["reach"] = "abcd " * 8 + "z" * 75 + " tail" * 30  # 80 is the room: the run of 75 needs no cut inside
    for most, overlap in ((100, 20), (101, 20)):
        got = {}
        for p in split.pieces(make(spark, texts, most, overlap, 64)).collect():
            got.setdefault(p.item.item_id, []).append(p)
        for k, v in got.items():
            check(texts[k], v, most, overlap)
            run = [len(r) for r in texts[k].split(" ")]
            for p in v:
                if p.cut == "none":
                    around = texts[k][: p.end_char].rsplit(" ", 1)[-1] + texts[k][p.end_char :].split(" ", 1)[0]
                    assert len(around) >= most - overlap - 2, (k, p, run)
        assert all(p.cut != "none" for p in got["reach"])


def test_items_within_the_limit_as_one_piece(spark):
    got = {(p.item.item_id, p.piece_no): p.text for p in split.pieces(make(spark, {"a": "é" * 90, "b": "q " * 80}), whole=True).collect()}
    assert got["a", 1] == "é" * 90 and ("a", 2) not in got and ("b", 2) in got


def test_repeated_rows_and_null_ids(spark):
    rows = spark.createDataFrame([("a", "p q " * 60), ("a", "p q " * 60), (None, "r s " * 60), ("a", "other " * 50)], "id string, text string")
    got = split.pieces(split.text_ranges(split.oversized(rows, "t", "id", "text", F.lit(100), F.lit(10)), 50)).collect()
    by = {}
    for p in got:
        by.setdefault((p.item.item_id, p.item.h), []).append(p)
    assert sorted(str(k[0]) for k in by) == ["None", "a", "a"]
    for v in by.values():
        pieces = sorted(v, key=lambda p: p.piece_no)
        assert len({p.piece_no for p in pieces}) == len(pieces)


def test_files(spark, tmp_path):
    text = "Grüße aus dem Süden. Noch ein Satz, länger als der erste.\n" * 200
    (tmp_path / "a.txt").write_text(text, encoding="utf-8")
    (tmp_path / "empty.txt").write_text("")
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.txt", "empty.txt")], "path string")
    got = split.pieces(split.file_ranges(spark, paths, 500, 50, 333)).collect()
    assert {p.item for p in got} == {str(tmp_path / "a.txt")}
    check(text, got, 500, 50)


def test_empty_table_and_bad_limit(spark):
    assert split.pieces(make(spark, {"a": None})).count() == 0
    bad = spark.createDataFrame([("f", 10, 10)], "field_name string, max_chars int, overlap_chars int")
    with pytest.raises(ValueError):
        split.limits(bad)
