"""Rows of documents in batches of bounded size, and work dealt over many tasks and files."""

from __future__ import annotations

import random
from html.parser import HTMLParser

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmark import tools
from quillmark.operators import chunking, sections
from quillmark.plans import filed
from quillmark.sources import ruled, shared
from quillmark.streaming import pushes

NAMES, KINDS = ["id", "n", "word"], [pa.int32(), pa.string()]


def batches(contents, size=1000):
    ids = list(range(len(contents)))
    return iter([pa.RecordBatch.from_arrays([pa.array(ids[k : k + size], pa.int64()), pa.array(contents[k : k + size], pa.string())], ["id", "content"]) for k in range(0, len(ids), size)])


def words(text):
    return enumerate(text.split())


def test_many_small_documents_are_one_batch_and_a_large_one_is_several():
    small = [None, "", *[f"a{i} b" for i in range(3000)]]
    out = list(shared.row_batches(batches(small), words, NAMES, KINDS))
    assert len(out) == 1
    want = [(i, n, w) for i, t in enumerate(small) for n, w in words(t or "")]
    assert list(zip(*(c.to_pylist() for c in out[0].columns))) == want
    large = list(shared.row_batches(batches(["x " * 35_000]), words, NAMES, KINDS))
    assert [b.num_rows for b in large] == [10_000, 10_000, 10_000, 5000]
    assert max(b.nbytes for b in shared.row_batches(batches(["y" * 3_000_000] * 5), words, NAMES, KINDS)) < 7_000_000


def test_tables_by_type_are_read_once_and_stay_whole(spark):
    """The type is told from all rows of a table, also where a word goes over two of them."""
    html = "<table><tr><td>Net</td><td>cash</td></tr><tr><td>flow</td><td>2</td></tr></table><table><tr><td>Assets</td><td>3</td></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, ""), (3, None), (4, "<p>none</p>")], "id int, html string")
    flow = tools.lf_extract_table(pages, "id", "html", "cashflow")
    plan = flow._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    assert flow.columns == ["id", "sheet", "row", "label", "indent", "bold", "total", "cells", "currency", "unit", "table_type"]
    assert [(r.id, r.sheet, r.row, r.label) for r in tools.lf_extract_table(pages, "id", "html").collect()] == [(1, 0, 1, "Net"), (1, 0, 2, "flow"), (1, 1, 1, "Assets")]
    assert [r.label for r in flow.collect()] == ["Net", "flow"]


def test_derived_pages_are_dealt_over_the_cores(spark):
    d = "/root/testdata/sf0.001"
    for q in (filed.z15, filed.s04, filed._tables):
        assert q(spark, d).rdd.getNumPartitions() >= 16


def test_ruled_pages_of_many_rows(spark):
    rows = [[f"k{i}", str(i), "1.00"] for i in range(400)]
    got = list(ruled.tables(filed.ruled_pdf([("All", rows)], False)))
    assert got == [[(1, 1, 1, 3, "All"), *((i + 2, j + 1, 1, 1, x) for i, r in enumerate(rows) for j, x in enumerate(r))]]


@pytest.fixture
def written(monkeypatch):
    made = []
    monkeypatch.setattr(filed, "put_files", lambda df, root: made.append({r.name: bytes(r.data) for r in df.collect()}) or 0)
    return made


def test_a_supplier_of_many_orders_has_few_books(spark, tmp_path, written, monkeypatch):
    """Orders far apart share a book; a book ends after so many lines."""
    monkeypatch.setattr(filed, "BOOK", 50)
    lines = spark.range(200).select((F.col("id") * 5000).alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(7).cast("bigint").alias("l_suppkey"), F.lit(2.5).alias("l_extendedprice"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    try:
        filed.s42(spark, str(tmp_path))
    except Exception:  # nothing lies in the folder
        pass
    assert sorted(written[0]) == [f"s7-{k}.pdf" for k in range(4)]
    assert sum(len(t) - 1 for x in written[0].values() for t in ruled.tables(x)) == 3 * 200
    assert all(b"(7)" not in x for x in written[0].values())


def test_a_nation_of_many_customers_has_volumes_of_one_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(filed, "VOLUME", 2)
    rows = spark.range(205).select(F.col("id").alias("c_custkey"), F.lit(3).alias("c_nationkey"), F.lit(1.5).alias("c_acctbal"), F.lit("AUTO").alias("c_mktsegment"))
    rows.write.parquet(f"{tmp_path}/customer.parquet")
    d = str(tmp_path)
    root = filed._pdfs(spark, d)
    assert spark.read.format("binaryFile").load(root).count() == 3
    assert sorted(tuple(r) for r in filed.s05(spark, d).collect()) == [(3, 1, 40), (3, 2, 40), (3, 3, 40), (3, 4, 40), (3, 5, 40), (3, 6, 5)]
    assert [tuple(r) for r in filed.s03(spark, d).collect()] == [(3, 205, 6, 205 * 102)]
    assert sorted(int(r.key) for r in filed.s17(spark, d).collect()) == list(range(205))
    assert sorted(int(r.metric) for r in filed.s18(spark, d).collect()) == list(range(205))


def test_a_brand_of_many_parts_has_files_of_one_size(spark, tmp_path, written):
    rows = spark.range(4).select((F.col("id") * 150_000).alias("p_partkey"), F.lit("tin").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit(5).alias("p_size"))
    rows.write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1,)], "n_nationkey int").write.parquet(f"{tmp_path}/nation.parquet")
    filed.s15(spark, str(tmp_path))
    assert sorted(written[0]) == ["long.csv", "wide-Brand1-0.csv", "wide-Brand1-1.csv", "wide-Brand1-2.csv"]


class Heard(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.got, self.fed = [], 0

    def feed(self, data):
        self.fed += 1
        super().feed(data)

    def handle_starttag(self, tag, attrs):
        self.got.append(("<", tag, attrs))

    def handle_endtag(self, tag):
        self.got.append((">", tag))

    def handle_data(self, data):
        before = self.got.pop()[1] if self.got and not self.got[-1][0] else ""
        self.got.append(("", before + data))


def test_plain_pages_are_told_as_the_parser_tells_them():
    r = random.Random(5)
    bits = ["<p>", "</p>", "<TD>", "</td>", "<br>", "a ", "\u00a0x\n", ">", "]]>", "<table>", "</h1>", "<tr>", "text", "<b1>"]
    odd = ["&amp;", "&", "<", "< p>", "<!-- c -->", "<p class='a'>", "<script>", "</script>", "<br/>", "<title>", "<?x?>", "</ p>", "<style>"]
    plain = 0
    for k in range(3000):
        html = "".join(r.choice(bits + odd * (k % 2)) for _ in range(r.randint(0, 12)))
        a, b = Heard(), Heard()
        sections.feed(a, html)
        HTMLParser.feed(b, html)
        b.close()
        assert a.got == b.got, html
        plain += not a.fed
    assert plain > 1000


def test_chunks_go_in_bounded_batches_and_keep_their_links(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name, None)
    spark.conf.set(name, str(1 << 30))
    try:
        text = "\n\n".join(f"paragraph {i}" for i in range(12_000))  # more rows than a batch holds
        made = chunking.chunk(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "one")], "id bigint, text string"), "id", "text", "FIX_SIZE", size=10)
        assert int(spark.conf.get(name)) <= 8 << 20  # texts of 10,000 rows were held together
        rows = sorted(made.collect(), key=lambda r: (r.id, r.chunk_index))
    finally:
        spark.conf.set(name, was) if was else spark.conf.unset(name)
    first = [r for r in rows if r.id == 1]
    assert [r.chunk_index for r in first] == list(range(12_000)) and [r.content for r in first] == text.split("\n\n")
    assert [r.prev_id for r in first] == [None, *(r.chunk_id for r in first[:-1])]
    assert [r.next_id for r in first] == [*(r.chunk_id for r in first[1:]), None]
    assert [(r.id, r.prev_id, r.next_id) for r in rows if r.id > 1] == [(4, None, None)]


def test_a_push_message_is_read_once_and_triggers_do_not_grow_with_files(spark, tmp_path, monkeypatch):
    book = '{"type":"ORDER_BOOK","code":"c%d","data":{"Bid":[{"price":1.5,"volume":2,"orders":1}],"Ask":[{"price":2.5,"volume":3,"orders":1},{"price":3.5,"volume":4,"orders":1}]}}'
    other = ['{"type":"BROKER","code":"x","data":{"Bid":[{"price":9}]}}', "not json", '{"type":"ORDER_BOOK","code":"e","data":{}}', '{"code":"n"}']
    messages = spark.createDataFrame([(v,) for v in [*(book % i for i in range(200)), *other]], "value string").repartition(40)
    plan = pushes.order_book(messages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    monkeypatch.setattr(filed, "shared_folder", lambda spark: f"file://{tmp_path}")
    got = filed._pushed(spark, None, messages, pushes.order_book).collect()
    want = [(f"c{i}", *x) for i in range(200) for x in (("bid", 0, 1.5, 2, 1), ("ask", 0, 2.5, 3, 1), ("ask", 1, 3.5, 4, 1))]
    assert sorted(map(tuple, got)) == sorted(want)
    assert 1 < len([p for p in (tmp_path / "out/state/commits").iterdir() if p.name.isdigit()]) <= filed.TRIGGERS
