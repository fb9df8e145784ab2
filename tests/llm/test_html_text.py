"""Pages without article tags, in languages without a stop word list, and a table of pages."""

import pytest

from opslens.llm import html_text

RU = "Сегодня утром жители города собрались на площади, чтобы обсудить новый проект парка, который городские власти обещают построить."
PL = "Mieszkańcy spotkali się wczoraj rano na placu, żeby omówić projekt nowego parku, który miasto obiecało wybudować przed końcem roku."
ZH = "今天早上市民聚集在广场上讨论新公园的计划市政府承诺在年底之前完成建设工作并且种植更多的树木让大家有一个休息的好地方" * 3
EN = "The people of the town met on the square to talk about the plan for a new park that the council had promised to build. " * 3


@pytest.mark.parametrize("text", [RU, PL, ZH])
def test_pages_of_other_languages_are_whole(text):
    page = f"<body><nav><a href=x>{text}</a></nav><div><a href=x>Home</a></div><p>{text}</p><p>{text} 2</p></body>"
    assert html_text.main_text(page) == f"{text}\n{text} 2"


def test_names_with_another_meaning_and_copyright_signs_stay():
    page = (f"<body><div class='related-work'><p>{EN}</p></div><div id=header-compression><p>{EN}</p></div><p>{EN}\xa9 1990</p>"
            f"<div class='sidebar-left'><p>{EN}</p></div><div class='siteNav top'><p>{EN}</p></div><p>\xa9 2020 The Town</p></body>")
    assert html_text.main_text(page) == "\n".join([EN.strip(), EN.strip(), f"{EN}\xa9 1990"])


def test_stop_words_decide_between_text_and_noise():
    noise = "lorem vex qua zut blim trof nask pleb grun dost " * 8
    page = f"<body><p>{EN}</p><p>{noise}</p><p>{EN}</p><p>Short one.</p><p>{EN}</p></body>"
    assert html_text.main_text(page) == "\n".join([EN.strip(), EN.strip(), "Short one.", EN.strip()])


def test_a_table_of_pages(spark):
    rows = [(1, "u", f"<p>{EN}</p>", "clash"), (1, "u", f"<p>{EN}</p>", "clash"), (None, None, None, None), (2, "v", "", "x"),
            (3, "w", "<p>" + EN * 500, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract(df).collect()), key=str)
    want = [(1, "u", EN.strip(), len(EN.strip()))] * 2 + [(None, None, "", 0), (2, "v", "", 0), (3, "w", (EN * 500).strip(), len((EN * 500).strip()))]
    assert got == sorted(want, key=str)
    assert html_text.extract(df.where("false")).count() == 0
