import random
from collections import Counter

import pytest
import regex
from helpers import DATA, against_sql

from scrutari.llm import licences
from scrutari.llm.licence_texts import TEMPLATES

from awkward_rows import LONG, table

WORD = regex.compile(r"(?V1)[\p{Han}\p{Hiragana}]|[[\p{L}\p{N}\p{M}]--[\p{Han}\p{Hiragana}]]+")


def grams(s):
    w = WORD.findall(s.replace("İ", "i").lower())
    return Counter(zip(w, w[1:]))


def mixed(seed):
    r = random.Random(seed)
    parts = []
    for _ in range(r.randrange(1, 7)):
        s = r.choice(list(TEMPLATES.values())).split()
        if r.random() < 0.5:
            for _ in range(max(1, len(s) // 15)):
                s[r.randrange(len(s))] = r.choice(["changed", "the", "of"])
        if r.random() < 0.3:
            s.insert(len(s) // 2, "\n")
        parts.append(" ".join(s))
        parts.append("Some other words that are no licence at all, and a few more of them.")
    r.shuffle(parts)
    return r.choice(["\n", "\n\n", "\n - \n"]).join(parts)


def every_window(text, templates, threshold):
    out = {}
    w = WORD.findall(text.replace("İ", "i").lower())
    a = list(zip(w, w[1:]))
    for k, t in templates.items():
        b = grams(t)
        size = sum(b.values())
        for i in range(len(a)):
            left, same = dict(b), 0
            for n, g in enumerate(a[i : i + 2 * size], 1):
                if left.get(g, 0):
                    left[g] -= 1
                    same += 1
                if (d := 2 * same / (n + size)) >= threshold:
                    out[k] = max(d, out.get(k, 0))
    return out


@pytest.mark.parametrize("threshold", [0.7, 0.8, 1.0])
def test_like_every_window(threshold):
    texts = [mixed(k) for k in range(25)] + ["", None, "word", "all rights", "All rights reserved. All rights", "reserved rights. All", "rights reserved", TEMPLATES["MIT/text"]]
    found = licences.Templates(TEMPLATES, threshold)
    got = {}
    for d, t, v in found.matches(texts):
        got.setdefault(d, {})[found.names[t]] = v
    for d, s in enumerate(texts):
        assert got.get(d, {}) == pytest.approx(every_window(s or "", TEMPLATES, threshold)), d


def test_statements_in_lines_and_notices_of_several_paragraphs(spark):
    gnu = TEMPLATES["GPL-3.0/notice"].replace(" This program is dist", "\n\nThis program is dist").replace(" You should", "\n\nYou should")
    rows = [
        (1, "The code is on our page and was released under the MIT License. Ask us for more by mail, or come by in person."),
        (2, "Some program, one line to say what it does.\n\n" + gnu + "\n\n" + "And then code of the program follows here. " * 20),
        (3, LONG + TEMPLATES["Apache-2.0/notice"].replace("License. You", "License.\n\n You") + LONG),
        (4, LONG),
    ]
    docs = table(spark, rows)
    got = {(r["doc_id"], r["licence"]): r["dice"] for r in licences.scan(docs).collect()}
    assert got[1, "MIT/statement"] == got[2, "GPL-3.0/notice"] == got[3, "Apache-2.0/notice"] == 1.0 and not any(d == 4 for d, _ in got)


def test_bounds():
    for bad in (0, 1.5):
        with pytest.raises(ValueError):
            licences.Templates(TEMPLATES, bad)
    assert licences.Templates({"x": "one", "y": ""}).matches(["one two"]) == []


def test_defined_results(spark, awkward, nothing):
    assert licences.scan(awkward).count() == 0 and licences.scan(nothing).count() == 0
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, LONG + "\n" + TEMPLATES["ISC/text"]), (2, "ALL RIGHTS RESERVED!")]
    got = sorted((str(r["doc_id"]), r["licence"], r["dice"]) for r in licences.scan(table(spark, rows)).collect())
    assert got.count(("1", "MIT/statement", 1.0)) == 2 and ("None", "ISC/text", 1.0) in got and ("2", "Reserved/statement", 1.0) in got


def test_query(spark):
    mine, theirs = against_sql(spark, licences.query, licences.SQL, f"{DATA}/sf0.001")
    assert mine and mine == theirs


def test_awkward_texts_like_the_sql(spark, tmp_path):
    texts = [*(mixed(k) for k in range(12)), *TEMPLATES.values(), "İ Released under the MIT License. İ", "版权 Released under the MIT License 版权", "all rights reserved " * 50, None, "", "MIT"]
    table(spark, [(k // 2, t) for k, t in enumerate(texts)]).select("doc_id", "text").coalesce(1).write.parquet(str(tmp_path / "d"))
    import glob
    import os

    os.rename(glob.glob(f"{tmp_path}/d/*.parquet")[0], tmp_path / "documents.parquet")
    mine, theirs = against_sql(spark, licences.query, licences.SQL, str(tmp_path))
    assert len(mine) > len(TEMPLATES) and mine == theirs
