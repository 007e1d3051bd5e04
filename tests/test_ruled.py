"""Tables by drawn lines: spans, turned pages, broken lines, and pages without any."""

from __future__ import annotations

import pytest

from quillmark.plans import filed
from quillmark.plans.filed import ruled_pdf
from quillmark.plans.sources import simple_pdf
from quillmark.sources import pdf, ruled


@pytest.mark.parametrize("turned", [False, True])
def test_a_ruled_table_comes_back(turned):
    rows = [[f"a{i}", f"b {i}", str(i)] for i in range(5)]
    got = list(ruled.tables(ruled_pdf([("All of it", rows), ("More", rows[:2])], turned)))
    assert len(got) == 2
    assert got[0] == [(1, 1, 1, 3, "All of it"), *((i + 2, j + 1, 1, 1, x) for i, r in enumerate(rows) for j, x in enumerate(r))]
    assert got[1][0] == (1, 1, 1, 3, "More") and len(got[1]) == 7


def page(content):
    return f"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Count 1 /Kids [3 0 R] >>\nendobj\n3 0 obj\n<< /Type /Page /Contents 4 0 R >>\nendobj\n4 0 obj\n<< >>\nstream\n{content}\nendstream\nendobj\n".encode()


def test_spans_scales_boxes_and_two_tables():
    show = lambda x, y, t: f"BT 1 0 0 1 {x} {y} Tm ({t}) Tj ET"
    one = "q 2 0 0 2 0 0 cm 10 10 50 20 re S 10 20 m 60 20 l S 35 10 m 35 20 l S Q " + show(30, 45, "wide") + show(30, 25, "left") + show(75, 25, "right")
    two = "10 300 m 110 300 l S 10 280 m 60 280 l S 10 260 m 110 260 l S 10 260 m 10 300 l S 60 260 m 60 300 l S 110 260 m 110 300 l S " + show(12, 285, "up") + show(12, 265, "down") + show(70, 285, "tall") + show(70, 265, "cell") + show(300, 285, "outside")
    got = list(ruled.tables(page(one + " " + two)))
    assert got == [[(1, 1, 1, 1, "up"), (1, 2, 2, 1, "tall cell"), (2, 1, 1, 1, "down")], [(1, 1, 1, 2, "wide"), (2, 1, 1, 1, "left"), (2, 2, 1, 1, "right")]]


def test_open_fields_are_no_cells():
    # the right column has no line on its right
    lines = "0 0 m 0 40 l S 50 0 m 50 40 l S 0 0 m 90 0 l S 0 20 m 90 20 l S 0 40 m 90 40 l S 90 20 m 90 40 l S"
    cells = next(ruled.lattices(ruled.drawn(lines.encode(), {}, (1, 0, 0, 1, 0, 0))[1]))
    assert [(r, c) for *_, r, c, _, _ in cells] == [(1, 1), (1, 2), (2, 1)]
    assert list(ruled.lattices([(0, 0, 50, 0), (0, 10, 50, 10)])) == []


def test_pages_without_lines_go_by_gaps():
    data = simple_pdf([["Title", "Item\t2024", "Revenue\t120", "a note"], ["x\ty"]])
    assert list(ruled.table_cells(data)) == [("0", 1, 1, "Item"), ("0", 1, 2, "2024"), ("0", 2, 1, "Revenue"), ("0", 2, 2, "120")]
    assert list(ruled.table_cells(b"none")) == list(ruled.table_cells(None)) == []
    assert pdf.pages(data)[0].startswith("Title")


def test_pages_of_one_form_are_told_once_and_alike(monkeypatch):
    """What is kept of a form changes no table, whatever stands in its fields."""
    rules = "0 0 m 100 0 l S 0 20 m 100 20 l S 0 40 m 100 40 l S 0 0 m 0 40 l S 50 0 m 50 40 l S 100 0 m 100 40 l S\n"
    show = lambda x, y, t, font="F1": f"BT /{font} 9 Tf 1 0 0 1 {x} {y} Tm ({t}) Tj ET"
    fields = lambda *t: "\n".join(show(x, y, v) for (x, y), v in zip([(2, 25), (52, 25), (2, 5), (52, 5)], t))
    turned = [ruled_pdf([("T", [[str(i), "b", "c"]])], odd) for i in range(3) for odd in (False, True)]
    made = [
        *(rules + fields(f"a{i}", "b", "c", str(i)) for i in range(20)),
        rules + fields("a", "", " ", "d"),
        rules + fields("a", "\\(b\\)", "c", "d"),
        rules + fields("a", "b", "c", "d") + " 0 0 m 5 5 l S",
        rules + fields("a", "b", "c", "d") + "\n50 0 m 50 60 l S\n" + show(2, 50, "above"),
        rules + "\n".join([show(2, 25, "z"), show(2, 25, "a"), show(2.0, 25.04, "m"), show(30, 25, "n")]),
        rules + show("+2.", 25, "odd") + show("-.5", "25.50", "edge"),
        "q 2 0 0 2 0 0 cm " + rules + fields("a", "b", "c", "d"),
        "(BT /F1 9 Tf) " + rules + fields("a", "b", "c", "d"),
        rules + fields("a", "b", "c", "d").replace("Tj", "' "),
        show(2, 25, "x") + show(80, 25, "y") + show(2, 5, "z") + show(80, 5, "w"),
        fields("p", "q", "r", "s") + "\n" + rules,
    ]
    drawn, held = [], ruled._drawn if hasattr(ruled, "_drawn") else ruled.drawn
    monkeypatch.setattr(ruled, "_drawn", lambda *a: drawn.append(1) or held(*a), raising=False)
    fast = [list(ruled.tables(page(c))) for c in made[:20]]
    assert len(drawn) <= 1 and [t[0][0][4] for t in fast] == [f"a{i}" for i in range(20)]
    fast += [list(ruled.tables(d)) for d in [*map(page, made[20:]), *turned]]
    monkeypatch.setattr(ruled, "_filled", lambda *a: None)
    assert fast == [list(ruled.tables(d)) for d in [*map(page, made), *turned]]


def test_rows_are_the_cells_by_row():
    gaps = simple_pdf([["Item\t2024", "Revenue\t120"], ["Item\t2024", "Revenue\t120"]])
    spans = page("0 0 m 100 0 l S 0 20 m 50 20 l S 0 40 m 100 40 l S 0 0 m 0 40 l S 50 0 m 50 40 l S 100 0 m 100 40 l S BT 1 0 0 1 2 25 Tm (up) Tj ET BT 1 0 0 1 52 25 Tm (tall) Tj ET")
    late = page("0 0 m 100 0 l S 0 20 m 100 20 l S 0 40 m 100 40 l S 0 0 m 0 40 l S 50 0 m 50 40 l S 100 0 m 100 40 l S BT 1 0 0 1 2 25 Tm (a) Tj ET BT 1 0 0 1 52 5 Tm (d) Tj ET")
    assert list(ruled.table_rows(gaps)) == [("0", [1, 2], [["Item", "2024"], ["Revenue", "120"]])]
    assert list(ruled.table_rows(spans)) == [("0", [1], [["up", "tall"]])]
    assert list(ruled.table_rows(late)) == [("0", [1, 2], [["a"], [None, "d"]])]
    assert list(ruled.table_rows(None)) == []


def test_ruled_rows_cross_no_exchange(spark):
    """Rows are whole where they are read; their cells were brought together by an exchange before."""
    plan = filed.s42(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("MapInArrow") == 1
