from datetime import date, datetime

import pytest
from hypothesis import given, settings as hyp, strategies as st, HealthCheck
from pyspark.sql import functions as F

from listforge.functions import dates, jsonx, text


URLS = {
    "https://WWW.Ex.com/a/?utm_source=z&b=2&a=1#f": "https://ex.com/a?a=1&b=2",
    "http://ex.com": "http://ex.com/",
    "N/A": "N/A",
    "": "",
    "//ex.com/x/": "https://ex.com/x",
    "https://ex.com/p?ProjectId=7&Codes=9": "https://ex.com/p?ProjectId=7",
    "https://ex.com/p?flag&x=": "https://ex.com/p?flag=&x=",
    "https://ex.com/p?q=a%20b": "https://ex.com/p?q=a+b",
    "https://ex.com/p?q=~*": "https://ex.com/p?q=~%2A",
    "  https://ex.com/p//  ": "https://ex.com/p",
    "https://ex.com/p?a=2&a=1": "https://ex.com/p?a=1&a=2",
    "https://ex.com/p?q=%C3%B8": "https://ex.com/p?q=%C3%B8",
    "HTTPS://ex.com/p": "https://ex.com/p",
    "mailto:x@y": "mailto:x@y",
    "https://ex.com/a b?x=1": "https://ex.com/a b?x=1",
    "https://ex.com/p?q=a%ZZ": "https://ex.com/p?q=a%25ZZ",
    "https://ex.com/p?=x&a=b=c": "https://ex.com/p?=x&a=b%3Dc",
}


def test_canonical_url(column):
    assert dict(zip(URLS, column(text.canonical_url(F.col("x")), list(URLS)), strict=True)) == URLS
    assert column(text.canonical_url(F.col("x")), [None]) == [""]


def test_canonical_url_is_stable(column):
    once = column(text.canonical_url(F.col("x")), list(URLS))
    assert column(text.canonical_url(F.col("x")), once) == once


def test_role_key(column):
    assert column(text.role_key(F.col("x"), F.lit("Data-Analyst (m/f)")), ["Novø A/S", "", None, "ÆØ"]) == ["novas|dataanalystmf", "", "", ""]


def test_slug_and_bullets(column):
    assert column(text.slug(F.col("x")), ["A/S Foo -_ Bar!", "", "___", None, "x" * 60, "Ærø é"]) == ["AS_Foo_Bar", "role", "role", "role", "x" * 50, "Ærø_é"]
    assert column(text.bullets(text.skills(F.col("x"))), ["a; b ;;c", "", None]) == ["- a\n- b\n- c", "_(none extracted)_", "_(none extracted)_"]


def test_bars_round_halves_to_even(spark):
    got = spark.createDataFrame([(5, 68), (3, 68), (1, 0), (34, 34)], "n long, m long").select(F.length(text.bar(F.col("n"), F.col("m"))).alias("b"), text.percent(F.col("n"), F.col("m")).alias("p")).collect()
    assert [r["b"] for r in got] == [2, 2, 0, 34]
    assert got[2]["p"] is None


def test_html_to_text(column):
    html = "<!-- a --><p>x&amp;lt;</p><script>no</script><p>y</p>\n\n\n\n<b>z</b>"
    assert column(text.html_to_text(F.col("x")), [html, None, "<p>" + "a" * 7000]) == ["x&lt;\n\ny\n\nz", "", "a" * 6000]


@given(st.lists(st.text(alphabet="ogertilå æø then ", max_size=60), min_size=1, max_size=20))
@hyp(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_danish_counts_like_python(column, texts):
    marks = F.get(text.danish_marks(F.col("x")), F.lit(0))
    da, en = marks["da"], marks["en"]
    want = []
    for t in texts:
        s = f" {t.strip().lower()} "
        want.append((sum(map(s.count, text.DANISH + text.DANISH_LETTERS)), sum(map(s.count, text.ENGLISH))))
    assert [tuple(r) for r in column(F.struct(da.alias("a"), en.alias("b")), texts)] == want


def test_looks_danish(column):
    rows = ["æ" * 39, "we are the team and you are great, or so they say there", "Vi søger en medarbejder med erfaring og lyst til arbejde", " the and you og " + "x" * 40]
    assert column(text.looks_danish(F.col("x")), rows) == [False, False, True, False]
    assert column(text.looks_danish(F.col("x"), F.lit("en")), rows[2:3]) == [False]
    assert column(text.confidently_danish(F.col("x")), ["x" * 80]) == [False]


DATES = ["2026-01-05", "2026-01-05T10:00", " 2026-01-05 ", "2026-1-5", "2026-02-30", "False", "", None, "\t2026-01-05\n", "2026-01-0x"]


def test_parse_date_like_strptime(column):
    def want(s):
        s = (s or "").strip()
        try:
            return datetime.strptime(s[:10], "%Y-%m-%d").date() if len(s) >= 10 else None
        except ValueError:
            return None

    assert column(dates.parse_date(F.col("x")), DATES) == [want(s) for s in DATES]


def test_open_status(spark):
    today = date(2026, 6, 15)
    rows = [("2026-06-15", "", True, 0), ("2026-06-14", "", False, -1), ("2026-06-18", "2001-01-01", True, 3), ("", "2026-05-25", True, None), ("", "2026-05-24", False, None), ("N/A", "x", True, None), ("", "2027-01-01", True, None)]
    df = spark.createDataFrame(rows, "d string, s string, o boolean, n int")
    assert df.where((dates.is_open(F.col("d"), F.col("s"), today, 21) != F.col("o")) | ~dates.days_left(F.col("d"), today).eqNullSafe(F.col("n"))).count() == 0


def test_deadline_passed(column):
    rows = {"Ansøgningsfrist: 1. januar 2020": True, "deadline 5/6-19": True, "Frist: 1. january 2020": False, "frist 31.02.2020": False, "frist 1.1.2099 og frist 1.1.2020": False, "Deadline: 15-6-2026": False, "ANSØGNINGSFRIST 1. MARTS 1997": True, "nothing": False}
    assert column(dates.deadline_passed(F.col("x"), date(2026, 6, 15)), list(rows)) == list(rows.values())


def test_parse_score(column):
    rows = ['{"score": 85, "track": "A", "matched_skills": ["sql", "x"]}', '{"score":"85"}', '{"score":85.7}', "{}", 'so ```{"score": 70}``` ok', '{"score": 70, "track": "A"', "no", None, '{"score":1,"danish_required":true}', '{"score": "x"}', "[1]"]
    got = column(jsonx.parse_score(F.col("x")), rows)
    assert [r and r["score"] for r in got] == [85, 85, 85, 0, 70, 70, None, None, 1, None, None]
    assert got[0]["matched_skills"] == ["sql", "x"] and got[5]["reasoning"] == "regex fallback" and got[8]["danish_level"] == "required" and got[3]["commute_ok"]


def test_listed(column):
    rows = ['{"docs":[{"id":1},{"id":2}]}', "[3]", '{"jobs":{"docs":[4]},"docs":[5]}', '{"hits":1,"items":[6]}', "{}", "junk", None]
    assert [len(x) for x in column(jsonx.listed(F.col("x")), rows)] == [2, 1, 1, 1, 0, 0, 0]


@pytest.mark.parametrize(("n", "full"), [(200, None), (201, "full")])
def test_a_body_must_be_over_200(column, n, full):
    row = '{"title":"t","id":"1","description":"' + "y" * n + '"}'
    assert column(jsonx.teaser_columns(F.col("x"), "u/")["source"], [row]) == [full]
