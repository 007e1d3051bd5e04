"""Clashing column names, hot groups and long texts, across operators."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillmark.llm import chat, decontaminate, html, langid, neardup, packing, pii, quality, substrings, warc

CLASH = ["id", "label", "key", "u", "v", "n", "hub", "unit", "block", "bucket", "part", "cell", "rank", "uid", "component", "n_shingles", "kept", "row", "n_pii", "attempt", "held_out"]


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


def test_clashing_names_change_nothing(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice("alpha beta gamma delta eps zeta eta".split()) for _ in range(r.randint(0, 80)))) for i in range(40)]
    df = spark.createDataFrame(rows + [(100, rows[5][1]), (101, None)], "doc_id bigint, text string")
    wide = clashing(df)
    model = quality.fit([], __import__("numpy").zeros(0, "int64"))
    bench = spark.createDataFrame([(1, rows[9][1], "x")], "item_id bigint, text string, n string")
    for f in (
        neardup.near_duplicates,
        lambda d: substrings.find_spans(d).drop("spans"),
        lambda d: quality.score(d, model),
        lambda d: langid.predict(d, langid.fit([("alpha beta", "a"), ("zeta eta", "z")])),
        lambda d: decontaminate.scan(d, bench),
        lambda d: packing.pack(packing.pieces(d)).drop("sequence_id", "offset"),
    ):
        assert sorted(map(str, f(wide).collect())) == sorted(map(str, f(df).collect()))
    out = pii.anonymise(wide)
    assert [c for c in out.columns if c.endswith("n_pii")] == ["n_pii", "pii_n_pii"] and {x.n_pii for x in out.collect()} == {"clash"}


def test_clashing_names_in_pages_and_turns(spark):
    pages = spark.createDataFrame([(1, "http://a.b/", "<article>Some text here.</article>")], "page_id bigint, url string, html string")
    assert html.extract(clashing(pages)).collect() == html.extract(pages).collect()
    assert warc.decide(clashing(pages)).collect() == warc.decide(pages).collect()
    turns = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", "y")], "conv_id bigint, turn bigint, role string, text string")
    assert chat.digest(chat.format_all(clashing(turns))).collect() == chat.digest(chat.format_all(turns)).collect()


def test_hot_copies(spark):
    """One text in most rows: one class, one kept row, one source of its words."""
    text = " ".join(f"w{k}" for k in range(50))
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 8, text).otherwise(F.concat(F.lit("own "), F.col("id").cast("string"))).alias("text")).repartition(7)
    assert neardup.near_duplicates(df).where("kept").count() == 1 + 100
    got = substrings.find_spans(df, block_bytes=4000)
    assert got.where("n_words = 50 and n_removed = 0").count() == 1 and got.where("n_removed = 50").count() == 399


def test_very_long_text(spark):
    """Texts above the slice size, and one word of many bytes."""
    r = random.Random(6)
    long = " ".join(f"{r.randrange(10**6)}" for _ in range(500_000))
    df = spark.createDataFrame([(1, long), (2, "z" * 200_000), (3, long + " tail")], "doc_id bigint, text string")
    got = {x.doc_id: x for x in neardup.near_duplicates(df).collect()}
    assert (got[1].component_id, got[2].component_id, got[3].component_id) == (1, 2, 1)
    out = {x.doc_id: x for x in substrings.find_spans(df).collect()}
    assert (out[1].n_removed, out[2].n_words, out[3].kept_text) == (0, 1, "tail")


def test_pipeline_stages_on_edges(spark):
    """Rows equal in id and text come down to one, rows without an id stay, and an empty table gives no rows."""
    import corpus_pipeline as P

    text = " ".join(f"w{k}" for k in range(40))
    own = " ".join(f"v{k}" for k in range(40))
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", None), (None, own, None, None, None), (None, own, None, None, None), (5, None, None, None, None), (6, "", "en", "s", 0)]
    kept = P.near_dedup(spark, spark.createDataFrame(rows, kind), "")
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["1", "5", "6", "None", "None"]
    empty = spark.createDataFrame([], kind)
    for name, stage in P.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0, name


def test_scopes_drop_what_they_settled(spark):
    import os

    from quillmark.llm.tables import scope, settle

    where = lambda df: df.inputFiles()[0].removeprefix("file:").rpartition("/t/")[0]
    with scope(spark):
        a = settle(spark.range(5))
        b = settle(a.selectExpr("id + 1 AS id"), outer=True)
        inner, outer = where(a), where(b)
        assert os.path.isdir(inner) and os.path.isdir(outer)
    assert not os.path.exists(inner) and os.path.isdir(outer) and b.count() == 5


def test_language_training_takes_one_text_an_id(spark):
    """Repeated rows of an id neither weigh more nor pass the bound; null ids, texts and languages teach nothing."""
    import numpy as np

    r = random.Random(5)
    word = lambda k: "".join(r.choice("abcdef" if k % 2 else "uvwxyz") for _ in range(6))
    rows = [(k, " ".join(word(k) for _ in range(30)), "ab" if k % 2 else "uz") for k in range(60)]
    kind = "doc_id bigint, text string, lang string"
    plain = langid.train(spark.createDataFrame(rows, kind))
    more = rows + [rows[1]] * 300 + [rows[2]] * 50 + [(None, "zzz", "ab"), (70, None, "ab"), (71, "uvw xyz", None)]
    r.shuffle(more)
    again = langid.train(spark.createDataFrame(more, kind).repartition(5))
    assert plain.langs == again.langs == ["ab", "uz"] and np.array_equal(plain.matrix, again.matrix)
    got = langid.predict(spark.createDataFrame([(1, rows[1][1], "uz")] * 3 + [(None, rows[2][1], None), (5, "", "ab"), (6, "12 !", "ab")], kind), plain).collect()
    assert sorted((str(x.doc_id), x.lang_pred) for x in got) == [("1", "ab")] * 3 + [("5", "und"), ("6", "und"), ("None", "uz")]
    none = langid.train(spark.createDataFrame([], kind))
    assert none.langs == [] and langid.predict(spark.createDataFrame(rows[:2], kind), none).where("lang_pred = 'und'").count() == 2
    few = langid.train(spark.createDataFrame(rows, kind), per_lang=3)
    assert few.langs == ["ab", "uz"] or few.langs in (["ab"], ["uz"], [])


def test_packing_of_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "one two"), (None, "one two"), (3, None), (3, ""), (4, "a b c")], "doc_id bigint, text string")
    got = packing.pack(packing.pieces(df)).collect()
    assert len(got) == 5 and sum(x.length == 1 for x in got) == 2
    for seq in {x.sequence_id for x in got}:
        at = 0
        for x in sorted((x for x in got if x.sequence_id == seq), key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
    assert packing.pack(packing.pieces(df.limit(0))).count() == 0


def test_chat_of_an_empty_table_and_odd_rows(spark):
    kind = "conv_id bigint, turn bigint, role string, text string"
    empty = spark.createDataFrame([], kind)
    assert chat.format_all(empty, 4096).count() == 0 and chat.digest(chat.format_all(empty, 4096)).count() == 0
    rows = [(None, 0, "user", None), (None, None, None, "x"), (2, 1, "assistant", "y"), (2, 1, "assistant", "y"), (3, 0, "user", "")]
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digest(chat.format_all(spark.createDataFrame(rows, kind), 4096)).collect()}
    assert got == {None: (2, 0), 2: (2, 2), 3: (1, 0)}
    long = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", "word " * 3000) for k in range(6)], kind)
    made = chat.format_all(long, 4096).collect()
    assert len(made) > 3 and chat.digest(chat.format_all(long, 4096)).first().n_turns == 6


def test_substrings_of_null_ids(spark):
    """Rows without an id count as smaller than all others; equal rows keep their words once."""
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(5, text), (None, text), (None, text), (7, None), (8, " \n")], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substrings.find_spans(df).collect())
    assert got == [("5", 30, 30), ("7", 0, 0), ("8", 0, 0), ("None", 30, 0), ("None", 30, 30)]
    assert substrings.find_spans(df.limit(0)).count() == 0
