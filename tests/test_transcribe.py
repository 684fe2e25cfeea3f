"""Completed stretches, pages and their documents on small fixtures."""

import json

from tallyfield.operators import text, transcribe
from tallyfield.kernels import align

MARK = "workflow_id int, subject_id long, task string, shape string, id long, item int, volunteer long, tool int, params array<double>, text string, variants array<string>"


def page(texts, y=30.0, first=0):
    return [(1, 9, "T", "text", first + n, 0, n, 0, [10.0, 200.0, y, y], t, ["owd", " ", None]) for n, t in enumerate(texts)]


def test_stretches_pages_and_documents(spark):
    rows = page(["the old barn", "the old barn", "the odd barn"]) + page(["by the mill"] * 3, 60.0, 50) + page(["seen twice"] * 2, 90.0, 80)
    rows += [(1, 9, "T", "text", 99, 0, 7, 0, [10.0, 12.0, 0.0, 300.0], "up the side", None), (1, 8, "T", "text", 98, 0, 7, 0, [1.0, 2.0, 3.0, 3.0], None, None), (1, 8, "T", "point", 97, 0, 7, 0, [1.0, 2.0], None, None)]
    marks = spark.createDataFrame(rows, MARK)
    lines = transcribe.page_lines(marks)
    assert {(r["line"], r["direction"]) for r in lines.collect()} == {(2, "horizontal"), (4, "horizontal"), (6, "horizontal"), (1, "vertical")}
    got = {r["line"]: r for r in transcribe.completed(lines).collect()}
    assert {k: r["text"] for k, r in got.items()} == {2: "the old barn", 4: "by the mill"} and got[4]["volunteers"] == 3 and got[2]["x2"] == 200.0
    one = transcribe.pages(transcribe.completed(lines)).collect()
    assert [(r["lines"], r["text"], r["accuracy"]) for r in one] == [(2, "the old barn\nby the mill", 1.0)]
    known = spark.createDataFrame([(0,), (1,)], "volunteer long")
    subjects = spark.createDataFrame([(9, '{"page": 3}')], "subject_id long, metadata string")
    doc = json.loads(transcribe.page_documents(transcribe.completed(lines), text.variants(marks, known, 2), subjects).first()["document"])
    assert doc["variants"] == ["owd"] and [t["rendered"] for t in doc["text"]] == ["the old barn", "by the mill"]
    nothing = transcribe.page_lines(marks.limit(0))
    assert transcribe.completed(nothing).collect() == [] and transcribe.own_agreements(nothing).collect() == []


def test_disagreement_is_spelled_out(spark):
    lines = transcribe.page_lines(spark.createDataFrame(page(["cat", "cot", "cut", "cit"]), MARK))
    r = transcribe.completed(lines).first()
    assert r["text"] == "c?t" and abs(r["agreement"] - 2 / 3) < 1e-9
    assert r["rendered"] == "c<disagreement><option>a</option><option>i</option><option>o</option><option>u</option></disagreement>t"
    own = transcribe.own_agreements(lines).collect()
    assert len(own) == 4 and all(abs(x["agreement"] - 2 / 3) < 1e-9 for x in own)


def test_only_covered_places_count():
    rows = [align.GAP * 2 + "cdef", "abcd" + align.GAP * 2, "abcdef"]
    assert align.blocks(rows) == [(2, 3)] and align.vote_inside(rows)[2:4] == "cd" and align.vote_inside(rows)[0] == align.FEW
    assert align.blocks(rows[:1], weights=[5]) == [(2, 5)] and align.own_agreement(rows, 0) == 1.0


def test_lines_with_very_many_texts_are_voted_on_in_chunks(spark):
    rows = [(1, 9, 2, f"the old barn {n}", 1) for n in range(30)] + [(1, 8, 2, "as it is", 4)]
    out = text.reduced_variants(spark.createDataFrame(rows, "workflow_id int, subject_id long, line int, text string, n long"), text.LINE, most=10).collect()
    assert sum(r["n"] for r in out) == 34 and len([r for r in out if r["subject_id"] == 9]) <= 3
