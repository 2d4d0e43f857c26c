"""Spans of license notices: planted whole, wrapped, edited and cut, against a plain walk over windows."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("plumbline.llm")
from plumbline.llm import decontamination, language, licenses  # noqa: E402

SCHEMA = "doc_id long, text string"
COMMON = "the of and to a in is for on with license software copyright notice free".split()


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def walked(rows, notices, limit):
    """The spans by looking at every window of every text."""
    out = []
    for doc_id, text in rows:
        w = words(text)
        for name, notice in notices.items():
            v = words(notice)
            wanted = set(zip(v, v[1:]))
            if not wanted:
                continue
            spans = []
            for i in range(len(w) - 1):
                part = w[i : i + len(v)]
                pairs = set(zip(part, part[1:]))
                dice = 2 * len(pairs & wanted) / (len(pairs) + len(wanted))
                if (w[i], w[i + 1]) not in wanted or dice < limit:
                    continue
                if spans and i < spans[-1][1] + len(v):
                    spans[-1] = (spans[-1][0], i, max(spans[-1][2], dice))
                else:
                    spans.append((i, i, dice))
            out += [(doc_id, name, round(d, 9), a, min(b + len(v), len(w)) - a) for a, b, d in spans]
    return sorted(out)


def found(docs, notices, limit):
    rows = licenses.spans(docs, notices, limit).collect()
    return sorted((r.doc_id, r.license, round(r.dice, 9), r.first_word, r.n_words) for r in rows)


def wrapped(text: str, width: int, mark: str = "\n * ") -> str:
    w = text.split()
    return mark.join(" ".join(w[i : i + width]) for i in range(0, len(w), width))


@pytest.mark.parametrize("limit", [0.6, 0.8, 1.0])
def test_spans_equal_a_walk_over_all_windows(spark, limit):
    draw = random.Random(7)
    notices = dict(licenses.NOTICES) | {"short": "the of the of the", "pair": "free software", "one": "word", "none": "..."}
    rows = []
    for doc_id in range(60):
        text = []
        for _ in range(draw.randrange(4)):
            text += draw.choices(COMMON, k=draw.randrange(40))
            part = draw.choice(list(notices.values())).split()
            part = [x for x in part if draw.random() > 0.04]  # words lost
            part = [draw.choice(COMMON) if draw.random() < 0.04 else x for x in part]  # words changed
            text += part[: draw.randrange(len(part) + 1)] if draw.random() < 0.3 else part
        rows.append((doc_id, wrapped(" ".join(text), draw.randrange(1, 12))))
    assert found(spark.createDataFrame(rows, SCHEMA), notices, limit) == walked(rows, notices, limit)


def test_wrapped_headers_and_whole_licenses_are_found(spark):
    rows = []
    for doc_id, (name, notice) in enumerate(licenses.NOTICES.items()):
        rows.append((doc_id, "import x\n/* Copyright 2020 Foo\n * " + wrapped(notice, 9) + "\n */\n" + "int main ( ) ; " * 300))
    rows.append((99, "Copyright 2020 Foo. Released under the MIT License. See docs."))
    rows.append((100, "all clean words of the day and the night, to the end of the story " * 40))
    seen = {(r.doc_id, r.license) for r in licenses.spans(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {(i, name) for i, name in enumerate(licenses.NOTICES)} <= seen
    assert (99, "MIT") in seen and not any(d == 100 for d, _ in seen)


def test_odd_rows(spark):
    notice = licenses.NOTICES["MIT"]
    rows = [(1, None), (2, ""), (3, "word"), (4, notice), (4, notice), (None, notice), (5, (notice + " other words here. ") * 3000)]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("x").alias("license"), F.lit(1).alias("pairs"), F.lit(1).alias("a.b"))
    got = licenses.spans(docs).select("doc_id", "license", "n_words").collect()
    assert [(r.license, r.n_words) for r in got if r.doc_id == 4] == [("MIT", 5)] * 2
    assert [r.license for r in got if r.doc_id is None] == ["MIT"]
    assert len([r for r in got if r.doc_id == 5]) == 3000 and {r.doc_id for r in got} == {4, 5, None}
    assert licenses.spans(docs.where("false")).count() == 0
    assert licenses.spans(docs, {"one": "word"}).count() == 0


def test_passages_held_by_many_documents_and_items(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    other = " ".join(f"v{i}" for i in range(12))
    docs = spark.createDataFrame([(i, f"x{i} {passage} y{i}" + (f" {other}" if i % 2 else "")) for i in range(200)], SCHEMA)
    items = [(str(i), passage if i < 150 else other) for i in range(155)]
    got = decontamination.decontaminate(docs, spark.createDataFrame(items, "item_id string, text string")).collect()
    assert {(r.n_hit, r.n_items) for r in got if r.doc_id % 2 == 0} == {(30, 150)}
    assert {(r.n_hit, r.n_items) for r in got if r.doc_id % 2 == 1} == {(42, 155)}
    assert len({r.items_sha256 for r in got}) == 2


def test_long_words_are_learned_from(spark):
    long = {"aa": "lorem" * 20, "bb": "ipsum" * 400}
    rows = [(i, long[lang], lang) for i in range(40) for lang in ("aa", "bb")]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "bb"]
    assert abs(model.chance[:, 0] - model.chance[:, 1]).max() > 0.01
