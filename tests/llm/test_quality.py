import collections
import re
import time

from tallyspark.llm import quality


def measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    marked = {p for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(marked))


def test_base_measures_equal_brute_force(docs, prose):
    texts = [None, "", " \n\t ", "one", prose(1, 12), prose(2, 4000), "a b c d e " * 3,
             "a b c d e f a b c d e", "x y\nx y\n\n \nx y", "é ü # ** $%&|<>\x0b\x0c\r z",
             (prose(3, 40) + "\n") * 2 + prose(4, 9), "a a a a a a", " wide space"]
    found = quality.assess(docs(texts)).collect()
    for row in found:
        assert (row.q_n_words, row.q_word_chars, row.q_n_symbols, row.q_n_dup_lines,
                row.q_n_repeat_words) == measures(texts[row.doc_id]), texts[row.doc_id]


def test_rules_cut_lines_and_reject_documents(docs, prose):
    good = prose(5, 60)
    texts = [good, good + "\nAll rights reserved.", good + "\nhome | about | help | login",
             "first line here\n" + " ".join(w + "***" for w in prose(6, 40).split()),
             "some words first\n" + " | ".join(prose(7, 40).split()),
             "Licensed under the MIT License\nAll rights reserved.\n" + prose(8, 22)]
    rows = {r.doc_id: r for r in quality.assess(docs(texts)).collect()}
    assert [rows[i].q_kept for i in range(6)] == [True, True, True, False, False, True]
    assert rows[0].q_text == texts[0]
    assert rows[1].q_text == good and rows[2].q_text == good
    assert rows[5].q_text == prose(8, 22)
    assert rows[3].q_lost_punctuation == 40 and rows[4].q_lost_navigation == 79


def test_clean_keeps_columns_and_null_ids(docs, clashing, prose):
    text = prose(9, 30)
    table = clashing(docs([text, text, None, text + "\nAll rights reserved."],
                          ids=[1, 1, 2, None]))
    out = quality.clean(table)
    assert out.columns == table.columns
    rows = out.collect()
    assert sorted((r.doc_id or 0, r.text, r.n_chars) for r in rows) == sorted(
        [(1, text, len(text))] * 2 + [(0, text, len(text))])
    assert all(r.q_words == "x" for r in rows)
    assert quality.clean(table.limit(0)).count() == 0


def test_main_path_has_no_python(docs):
    plan = quality.clean(docs(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_notices_count_for_the_verdict(docs, prose):
    notices = "Licensed under the MIT License\nAll rights reserved by us.\nPlease enable cookies"
    texts = [notices, notices + "\nand four words more", notices + "\n" + prose(8, 31),
             notices + "\n" + prose(8, 29), prose(9, 12)]
    found = {r.doc_id: r for r in quality.assess(docs(texts)).collect()}
    assert [found[i].q_lost_boilerplate for i in range(5)] == [13, 13, 13, 13, 0]
    assert [found[i].q_kept for i in range(5)] == [False, False, True, False, True]
    assert {r.doc_id: r.text for r in quality.clean(docs(texts)).collect()} == {
        2: prose(8, 31), 4: prose(9, 12)}


def test_clean_drops_what_cuts_leave_repeated(docs, prose):
    text = "a b c d e f " * 2 + prose(3, 60) + "\n" + prose(4, 20) + "\nhome | about | help"
    short = prose(5, 9) + "\na | b | c"
    rows = quality.clean(docs([text, short])).collect()
    assert [r.doc_id for r in rows] == [0]


MARKDOWN = """# A Heading

Some **bold words** and __more__ of them, with ~~old~~ text. Is it really so?!

Underlined
==========

> quoted > text here
>> and deeper | text

| name | value |
|------|-------|
| a    | b     |

***

## Second heading
Wow!!"""

CODE = """#!/bin/sh
/** A comment. */
def __init__(self, *args, **kwargs):
    if a == b and c != d && x || y:
        return a <= b >= c
template: vector<vector<int>> x = y->z << 3;
items.map(x => x === 1);
<!-- markup -->
<?php echo 1; ?>
// a path / that / is described in some words of a comment here"""


def test_markdown_and_code_pass_unchanged(docs):
    found = quality.assess(docs([MARKDOWN, CODE])).collect()
    assert all(r.q_kept for r in found)
    assert {r.doc_id: r.q_text for r in found} == {0: MARKDOWN, 1: CODE}


def test_shouts_and_symbol_junk_fail(docs, prose):
    junk = [" ".join(w + mark for w in prose(k, 30).split())
            for k, mark in enumerate(["!!", "***", "&&&", "###", "$$$", "%%%"])]
    assert not any(r.q_kept for r in quality.assess(docs(junk)).collect())


def test_long_cut_texts_are_split_once(docs, prose):
    """Time grows with the words of a cut text, not with their square."""
    table = docs([prose(10, 20_000) + "\nhome | about | help | login", prose(11, 30)])
    plan = quality.clean(table)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.split("\n") if "Filter " in line]
    assert filters and not any("split(" in line for line in filters)
    start = time.monotonic()
    rows = quality.clean(table).collect()
    assert time.monotonic() - start < 30
    assert {r.doc_id: r.text for r in rows} == {0: prose(10, 20_000), 1: prose(11, 30)}
