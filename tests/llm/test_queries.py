"""Registered queries against their SQL, and the pipeline stage by stage."""

import corpus_pipeline
import pytest

from ledgerline.llm.queries import ORACLES, QUERIES
from ledgerline.llm.settle import settled
from tests.conftest import rows

BIT = 1e-9


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_are_those_of_the_sql(spark, duck, folder, name):
    found = QUERIES[name](spark, folder)
    answer = duck.execute(ORACLES[name])
    names = [c[0] for c in answer.description]
    assert sorted(found.columns) == sorted(names)
    want = sorted((tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in answer.fetchall()), key=repr)
    assert rows(found) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_for_each_row(spark, folder, name):
    table, key = ("pages", "page_id") if name == "op11_html_extraction" else ("documents", "doc_id")
    rows = spark.read.parquet(f"{folder}/{table}.parquet")
    found = QUERIES[name](spark, folder)
    assert sorted(r[0] for r in found.select(key).collect()) == sorted(r[0] for r in rows.select(key).collect())


def test_held_out_rows(spark, folder):
    found = QUERIES["op2_language_id"](spark, folder)
    lang = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    held = found.join(lang, "doc_id").filter("held_out").collect()
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97


def test_stages_in_order(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "source_mix", "word_bpe"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = settled(stage(spark, docs, folder), f"test-{name}")
        assert after.columns == before and 0 < after.count()
        if name != "source_mix":
            assert after.count() <= docs.count()
            assert after.join(docs, "doc_id", "left_anti").count() == 0
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.count() == docs.count() and last.filter("n_tokens * 4 <> length(ids)").count() == 0


def test_stages_take_rows_of_any_kind(spark, folder, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    kind = ("doc_id long, text string, lang string, source string, n_chars long, score string, size string, copies int, "
            "component_id int, _is int, _of int, _time int, _cut int, toxicity int, kept_text int, mine int, of int, id string")
    more = ("", "", 1, 1, *[0] * 8, "")
    data = [(1, "a b c d e f", "x", "s", 11, *more), (1, "a b c d e f", "x", "s", 11, *more),
            (None, None, None, None, None, *more), (None, "", None, None, 0, *more),
            (2, "long " * 30_000, "x", None, 1, *more), (3, "A b c d e f\nnew line", "x", "t", 20, *more)]
    for some in (data, []):
        docs = spark.createDataFrame(some, kind)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = settled(stage(spark, docs, str(tmp_path)), f"odd-{name}")
            assert docs.columns == [c.split()[0] for c in kind.split(", ")]
            if some and name == "line_dedup":
                assert {(r["doc_id"], r["text"], r["n_chars"]) for r in docs.filter("doc_id = 3").collect()} == {(3, "new line", 8)}
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_near_dedup_loses_no_text(spark, folder):
    """Rows of one id are judged by their own texts; of rows alike in id and text one stays."""
    x, y = "a text of more than five words that two rows have", "another text, that no other row has at all, so it stays"
    stage = dict(corpus_pipeline.STAGES)["minhash_near_dedup"]
    kind = "doc_id long, text string, key string, alike int, gone string, n int, one int, body string"
    for rows_, want in (
        ([(1, x), (3, x), (3, y)], [(1, x), (3, y)]),
        ([(3, x), (3, x), (3, y)], [(3, x), (3, y)]),
        ([(None, x), (None, x), (None, y), (7, y), (2, None), (2, "")], [(None, x), (7, y), (2, None)]),
        ([(5, x), (9, x)], [(5, x)]),
    ):
        docs = spark.createDataFrame([(*r, "", 0, "", 0, 0, "") for r in rows_], kind).repartition(2)
        docs = settled(docs, "rows")
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns
        found = sorted(((r["doc_id"], r["text"] or "") for r in got.collect()), key=repr)
        assert found == sorted(((i, t or "") for i, t in want), key=repr)


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
