import datetime as dt
import re

import pytest

from tallyspark.llm import pii
from tallyspark.llm.pii import Permuter, replace

KEY = b"test"


def new(text, key=KEY):
    return replace(text, Permuter(key))[0]


@pytest.mark.parametrize("n", [2, 3, 10, 97, 1000])
def test_permutations_have_no_fixed_point(n):
    p = Permuter(KEY)
    values = [p.permute("x", n, k) for k in range(n)]
    assert sorted(values) == list(range(n))
    assert all(a != b for a, b in enumerate(values))


def luhn(s):
    return pii.luhn_digit(s[:-1]) == s[-1]


@pytest.mark.parametrize("text, form", [
    ("4111 1111 1111 1111", r"4\d{3}( \d{4}){3}"), ("378282246310005", r"3\d{14}"),
    ("116.75.34.232", r"\d+(\.\d+){3}"), ("+1 (017) 555-5036", r"\+1 \(\d{3}\) \d{3}-\d{4}"),
    ("+442071234567", r"\+44\d{10}"), ("123-45-6789", r"\d{3}-\d\d-\d{4}"),
    ("2024-02-29", r"\d{4}-\d\d-\d\d"), ("31/12/1999", r"\d\d/\d\d/\d{4}"),
    ("MARCH 3, 1987", r"[A-Z]+ \d+, \d{4}"), ("3 Mar 1987", r"\d+ [A-Z][a-z]{2} \d{4}"),
    ("joe.Bloggs+1@Mail9.example.com",
     r"[a-z]{3}\.[A-Z][a-z]{5}\+\d@[A-Z][a-z]{3}\d\.[a-z]{7}\.com"),
    ("GB82 WEST 1234 5698 7654 32", r"GB\d\d WEST \d{4} \d{4} \d{4} \d\d"),
    ("DE89370400440532013000", r"DE\d{20}")])
def test_formats(text, form):
    out = new(f"see {text}, {text}.")
    first, second = out[4:-1].split(", ") if ", " not in text else (
        out[4:4 + (len(out) - 7) // 2], out[-1 - (len(out) - 7) // 2:-1])
    assert first == second != text
    assert re.fullmatch(form, first)
    assert new(f"see {text}", b"other") != new(f"see {text}")
    assert new(f"see {text}") == f"see {first}"


def test_valid_stays_valid_and_linked():
    out = new("4111111111111111 and 4111-1111-1111-1111")
    a, b = out.split(" and ")
    assert luhn(a) and a == b.replace("-", "")
    day = new("2024-02-29|29/02/2024|29 February 2024|February 29, 2024").split("|")
    assert day[0].split("-")[::-1] == day[1].split("/")
    iban = new("DE89370400440532013000")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


@pytest.mark.parametrize("text", [
    None, "", "no values here", "8316107434564120", "476159897740", "999.1.1.1", "1.2.3.4.5",
    "2023-02-30", "99/99/2000", "000-12-3456", "666-12-3456", "GB82 WEST 1234 5698 7654 33", "a@b",
    "abe29cfcdae4f03e1e339fcaa4c5bb6c83baff71", "version 1.2.3", "page 12 of 300"])
def test_others_stay(text):
    assert replace(text, Permuter(KEY)) == (text, [])


def test_neighbours_are_told_apart():
    out = new("+1 (428) 555-5743 4111111111111111 10.0.0.1 a@b.co")
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} 4\d{15} \d+(\.\d+){3} [a-z]@[a-z]\.co", out)
    assert luhn(out.split()[3])


def test_tables(docs, clashing, prose):
    long = prose(1, 5000) + " mail me@home.org"
    table = clashing(docs(["card 4111111111111111", None, "", long, "card 4111111111111111"],
                          ids=[1, 2, 3, None, 1]))
    out = pii.pseudonymise(table, KEY, found_col="where")
    assert out.columns == [*table.columns, "where"]
    rows = {(r.doc_id, r.lang): r for r in out.collect()}
    assert rows[1, "en"].text == new("card 4111111111111111")
    assert [tuple(x) for x in rows[1, "en"]["where"]] == [("card", 5, 21)]
    assert rows[2, "en"].text is None and rows[3, "en"].text == ""
    assert rows[None, "en"].text.startswith(prose(1, 5000)) and "me@home" not in rows[
        None, "en"].text
    assert rows[1, "en"]._pii == "x" and rows[1, "en"].n_chars == 21
    assert out.count() == 5 and pii.pseudonymise(table.limit(0), KEY).count() == 0


@pytest.mark.parametrize("value, after", [
    ("BE68 5390 0754 7034", " BIC"), ("AT611904300234573201", " BIC"),
    ("ES91 2100 0418 4502 0005 1332", " IBAN"), ("BE68 5390 0754 7034", " KREDBEBB"),
    ("4111 1111 1111 1111", " 123"), ("4111-1111-1111-1111", "-123")])
def test_values_end_before_the_next_word(value, after):
    alone = new(f"see {value}.")[4:-1]
    assert alone != value and new(f"see {value}{after}.") == f"see {alone}{after}."


def test_a_number_before_a_card_hides_it_not():
    card = new("4111 1111 1111 1111")
    assert new("1234 4111 1111 1111 1111") == f"1234 {card}" != "1234 4111 1111 1111 1111"


@pytest.mark.parametrize("text, form", [
    ("2021-03-04T10:00:00Z", r"\d{4}-\d\d-\d\dT10:00:00Z"), ("2021/03/04", r"\d{4}/\d\d/\d\d"),
    ("04/03/85", r"\d\d/\d\d/\d\d"), ("5th March 2020", r"\d+(st|nd|rd|th) [A-Z][a-z]+ \d{4}"),
    ("5 Sept 2020", r"\d+ [A-Z][a-z]{2} \d{4}"), ("Jan. 5, 2020", r"[A-Z][a-z]{2}\. \d+, \d{4}"),
    ("12 May 1867", r"\d+ [A-Z][a-z]{2} 1\d{3}"), ("415-555-0123", r"\d{3}-\d{3}-\d{4}"),
    ("415.555.0123", r"\d{3}\.\d{3}\.\d{4}")])
def test_everyday_formats(text, form):
    out = new(f"see {text}.")[4:-1]
    assert out != text and re.fullmatch(form, out)


def test_everyday_formats_are_linked_and_checked():
    day = new("2021-03-04|2021-03-04T10:00:00Z|2021/03/04|04/03/21|4th March 2021").split("|")
    assert day[1] == day[0] + "T10:00:00Z" and day[2] == day[0].replace("-", "/")
    assert day[3].split("/") == [day[0][8:], day[0][5:7], day[0][2:4]]
    assert re.match(r"\d+", day[4]).group() == str(int(day[0][8:]))
    assert new("(415) 555-0123")[1:4] == new("415-555-0123")[:3]
    for text in ("31/02/85", "45/45/85", "31st February 2020", "1.2.34.5.6", "2021/13/14"):
        assert new(text) == text


def test_all_short_dates_map_one_to_one():
    days = [dt.date(1930, 1, 1) + dt.timedelta(n) for n in range(36525)]
    spelled = [f"{d.day:02d}/{d.month:02d}/{d.year % 100:02d}" for d in days]
    spelled += [f"{d.month:02d}/{d.day:02d}/{d.year % 100:02d}" for d in days if d.day > 12]
    permuter = Permuter(b"key")
    out = [replace(s, permuter)[0] for s in spelled]
    assert sorted(out) == sorted(spelled) and all(a != b for a, b in zip(out, spelled))
    for k in range(0, 36525, 997):  # short and long spellings are linked
        long = replace(days[k].isoformat(), permuter)[0]
        assert out[k].split("/") == [long[8:], long[5:7], long[2:4]]


def test_spellings_of_a_phone_are_linked():
    def bare(text):
        out = new(text)
        assert out != text
        return re.sub(r"\(0\)|[^0-9]", "", out)
    us = ["+12125551234", "+1 212 555 1234", "+1-212-555-1234", "+1 (212) 555-1234",
          "+1.212.555.1234"]
    assert len({bare(x) for x in us}) == 1 and bare(us[0])[0] == "1"
    assert {bare("(212) 555-1234"), bare("212-555-1234")} == {bare(us[0])[1:]}
    gb = ["+442079460018", "+44 20 7946 0018", "+44 (0)20 7946 0018", "+44-20-7946-0018"]
    assert len({bare(x) for x in gb}) == 1 and bare(gb[0]).startswith("44")
    far = ["+2348012345678", "+234 801 234 5678"]
    assert len({bare(x) for x in far}) == 1 and bare(far[0]).startswith("234")
