from conftest import rows

from pagemill.llm import scan_repair
from pagemill.llm.scan_repair import broken_at, damaged_lines, line_key, page_number, repair_text, repaired, undone

BODY = "The council reported that the harbour measured several provisions of the agreement with better instruments before the winter."


def test_page_numbers():
    assert page_number("12") == (12, False) and page_number("p. 3") == (3, True) and page_number("[l0]") == (10, True)
    assert page_number("Page 4 of 13") == (4, True) and page_number("- lO -") == (10, True)
    assert page_number("(52)") is None and page_number("9.5") is None and page_number("") is None and page_number("so") is None


def test_line_keys_ignore_figures_and_misreading():
    assert line_key("12   FISHING LICENCE 2007") == line_key("FISHING LICENCE 2008   l3")
    assert line_key("Clinic register | Trust") == line_key("Clmic rcgisfer | Trusf")
    assert line_key("1.2 The register") == "" and line_key("ends here.") == "" and line_key("12") == ""


def test_undoing():
    assert "audit" in undone("auclit") and "whereas" in undone("vvhereas") and "across" in undone("acr0ss") and "third" in undone("tliird")


def test_broken_words():
    assert broken_at("one arr-\nangement two­\n three") == [(0, "arr", "-", "angement"), (1, "two", "­", "three")]
    assert broken_at("2001-\n2002 and Jean-\nPaul –\nx-\n") == []


def book(damage=True):
    pages = []
    for k in range(1, 9):
        body = f"{BODY}\nIn year {1990 + k} the high-volume harbour was shown by the provisions of the agreement."
        if k == 3 and damage:
            body = body.replace("provisions", "provi-\nsions", 1).replace("winter", "wintcr").replace("high-volume", "high-\nvolume")
        pages.append(("d", k, f"Harbour report {2000}\n{body}\n{k + 4}"))
    return pages


def test_damage_of_each_kind(spark):
    filler = [("e", k, f"{BODY} {BODY} Copy of the year{chr(97 + k)}.") for k in range(1, 16)]
    df = spark.createDataFrame(book() + book()[:2] + filler + [("x", 1, None), ("x", 2, ""), (None, 1, "a"), ("x", None, "a")], "doc_id string, page int, text string").selectExpr("*", "1 as line_no", "2 as n")
    got = rows(damaged_lines(df), "page", "line_no", "damage", "doc_id")
    assert {g[3] for g in got} == {"d"}
    assert [g[0] for g in got if g[2] == "header"] == list(range(1, 9))
    assert [g[0] for g in got if g[2] == "page_number"] == list(range(1, 9))
    assert [g[:2] for g in got if g[2] == "hyphen"] == [(3, 2)]
    assert [g[:2] for g in got if g[2] == "ocr_error"] == [(3, 3)]
    text = {r.page: r.text for r in repaired(df).filter("doc_id = 'd'").collect()}[3]
    assert "provisions" in text and "winter." in text and "high-volume" in text and "Harbour report" not in text and "\n\n7" not in text


def _header_pages(lines, pages=10):
    """Pages of one file whose running line, given per page, is the third line."""
    return [("h", k, f"Section {k} of the{'abcdefghij'[k]} year\nUnder review{k}x\n{lines[k % len(lines)]}\n{BODY}\n{BODY}") for k in range(pages)]


def test_headers_on_the_third_line_and_damaged_ones(spark):
    good = "Harbour Authority Annual Report"
    lines = [good, good, good, "Harbour Authorty Annual Report", "Harbour Authoiity Annual Report", "Harbour AuthorityAnnual Report", "Harbour Authority Annual Report."]
    df = spark.createDataFrame(_header_pages(lines, 14 // 2 + 3), "doc_id string, page int, text string")
    got = rows(damaged_lines(df).filter("damage = 'header' and line_no = 3"), "page")
    assert [g[0] for g in got] == list(range(10))


def test_a_chapter_header_in_a_long_file(spark):
    pages = [("l", k, (f"Harbour Chapter Title\n" if 30 <= k < 38 else f"Opening words number{chr(97 + k % 26)}{chr(97 + k // 26)} here\n") + BODY) for k in range(100)]
    df = spark.createDataFrame(pages, "doc_id string, page int, text string")
    assert [g[0] for g in rows(damaged_lines(df).filter("damage = 'header'"), "page")] == list(range(30, 38))


def test_copies_do_not_make_a_misread_word_right(spark):
    pages = [("c", k, f"{BODY} Page of the year{chr(97 + k)}.") for k in range(26)] + [("d", k, BODY.replace("winter", "wintcr")) for k in range(13)]
    df = spark.createDataFrame(pages, "doc_id string, page int, text string")
    got = rows(damaged_lines(df).filter("damage = 'ocr_error'"), "doc_id", "page")
    assert got == [("d", k) for k in range(13)]


def test_a_misread_word_broken_at_a_hyphen(spark):
    pages = [("c", k, f"{BODY} Page of the year{chr(97 + k)}.") for k in range(26)] + [("d", 1, BODY.replace("agreement", "agrec-\nment"))]
    df = spark.createDataFrame(pages, "doc_id string, page int, text string")
    got = rows(damaged_lines(df).filter("doc_id = 'd'"), "line_no", "damage")
    assert (1, "hyphen") in got and (1, "ocr_error") in got


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id string, page int, text string")
    assert damaged_lines(df).count() == 0 and repaired(df).count() == 0


def test_clean_text_is_kept():
    assert repair_text("", []) == ""
    assert repair_text("a line that goes on\nand ends here.\n\nNext one.", []) == "a line that goes on and ends here.\n\nNext one."


def test_word_before_a_break_is_looked_for_in_one_piece_of_the_line(monkeypatch):
    looked, own = [], scan_repair._BEFORE

    class Spy:
        @staticmethod
        def search(text):
            looked.append(text)
            return own.search(text)

    monkeypatch.setattr(scan_repair, "_BEFORE", Spy)
    text = "some words of a well-kn-\nown line and vv!ndow-\nsill, mark alone -\nbar, a line\n-\nbelow, open (bra-\ncket"
    assert scan_repair.broken_at(text) == [(0, "well-kn", "-", "own"), (1, "vv!ndow", "-", "sill"), (4, "line", "-", "below"), (5, "bra", "-", "cket")]
    assert looked[:2] == ["well-kn", "vv!ndow"] and looked[-1] == "(bra"
