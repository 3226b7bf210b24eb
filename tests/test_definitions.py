"""Definition documents, paths and names on hand-written input."""

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text, timing
from ledgerline.functions.definition import register
from ledgerline.plans import ingest, migrate

DOCUMENTS = {
    "stripped": "<template><groupId> g-1 </groupId></template>",
    "root_group": '<flowController><rootGroup id="r-2"/></flowController>',
    "empty_first": '<template><groupId/><rootGroup id="r-5"/></template>',
    "blank": "<template><groupId>  </groupId><x><groupId>later</groupId></x></template>",
    "broken": "<template><groupId>x</template>",
    "other_root": "<a/>",
    "root_is_not_below_itself": "<groupId>self</groupId>",
    "notes": "<template><x/><comment>first</comment><description>second</description></template>",
    "entity": '<!DOCTYPE t [<!ENTITY e "v">]><template><groupId>&e;</groupId></template>',
    "entity_in_a_comment": "<!-- <!ENTITY e 'v'> --><template><groupId>fine</groupId><comment>&lt;!ENTITY</comment></template>",
    "entity_in_text": "<template><groupId>fine</groupId><comment><![CDATA[<!ENTITY e 'v'>]]></comment></template>",
    "processors": "<template><p><processor><id>1</id><name>a</name><class>x.GetFile</class>"
                  "</processor><processor><id>2</id><name/><class>y</class></processor>"
                  "<processor><id>3</id><name>c</name></processor></p></template>",
    "groups": '<template><processGroup id="a"><name>n</name><processGroup><name/></processGroup>'
              "</processGroup><processGroup/></template>",
}


@pytest.fixture(scope="module")
def files(spark):
    data = [(f"/v/defs/prod/{name}.xml", content) for name, content in DOCUMENTS.items()]
    data.append(("/v/defs/none.xml", None))
    return spark.createDataFrame(data, "path string, content string")


@pytest.fixture(scope="module")
def found(files):
    return {r["flow_name"]: r for r in ingest.catalogue(files, "defs").collect()}


@pytest.mark.parametrize("name,flow_id", [
    ("stripped", "g-1"), ("root_group", "r-2"), ("empty_first", "r-5"), ("blank", ""),
    ("broken", None), ("other_root", None), ("root_is_not_below_itself", None), ("entity", None),
    ("none", None), ("entity_in_a_comment", "fine"), ("entity_in_text", "fine")])
def test_flow_id(found, name, flow_id):
    assert found[name]["flow_id"] == flow_id
    assert (found[name]["error"] is None) == (flow_id is not None)


def test_validity(found):
    assert found["stripped"]["valid"] and found["root_group"]["valid"]
    assert found["other_root"]["message"] == "Not a valid definition XML file"
    assert found["broken"]["message"].startswith("Invalid XML: ")
    assert found["notes"]["description"] == "first"


def test_processors_need_three_elements(files):
    got = ingest.processors(files).collect()
    assert [(r["id"], r["name"], r["type"], r["intent"]) for r in got] == [
        ("1", "a", "x.GetFile", "ingestion"), ("2", None, "y", "other")]


def test_groups_at_any_depth(files):
    got = ingest.groups(files).filter("path LIKE '%/groups.xml'").orderBy("place").collect()
    assert [(r["group_id"], r["group_name"]) for r in got] == [
        ("a", "n"), ("flow_1", None), ("flow_2", "Flow 3")]
    whole = ingest.groups(files).filter("path LIKE '%/stripped.xml'").collect()
    assert [(r["group_id"], r["group_name"]) for r in whole] == [("main_flow", "Main Flow")]


def test_document_is_parsed_once(files):
    plan = ingest.catalogue(files, "defs")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_sql_users_can_parse(spark, files):
    register(spark)
    table_functions(spark)
    files.createOrReplaceTempView("definition_files")
    got = spark.sql("SELECT inline(parse_definition(content).processors) FROM definition_files")
    assert [r["id"] for r in got.collect()] == ["1", "2"]


def test_two_files_with_one_id(spark, files):
    flows = spark.createDataFrame([], "flow_id string, flow_name string, status string, "
                                  "current_run_id string, updated_ts timestamp, server string, "
                                  "source_path string, description string, priority string, "
                                  "owner string")
    twice = ingest.catalogue(files.unionByName(files.withColumn(
        "path", F.concat(F.lit("/v/defs/z"), F.col("path")))), "defs")
    with pytest.raises(Exception, match="several source rows"):
        ingest.ingest(flows, twice, F.lit(None).cast("timestamp")).collect()
    last = ingest.ingest(flows, twice, F.lit(None).cast("timestamp"), order=["source_path"])
    assert {r["source_path"][:9] for r in last.collect()} == {"/v/defs/z"}


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("path,server", [
    ("/v/defs/prod/f.xml", "prod"), ("/v/defs/f.xml", "default"), ("/other/f.xml", "default"),
    ("/v/defs/prod/sub/f.xml", "prod"), ("/v/defs", "default"), (None, "default")])
def test_server(spark, path, server):
    assert one(spark, text.server_of(F.lit(path).cast("string"), "defs"))[0] == server


@pytest.mark.parametrize("path,name", [("/a/a.xml.xml", "a"), ("/a/_f.xml", "_f"),
                                       ("/a/F.XML", "F.XML"), ("plain", "plain")])
def test_flow_name(spark, path, name):
    assert one(spark, text.flow_name_of(F.lit(path)))[0] == name


@pytest.mark.parametrize("seconds,shown", [(0, "N/A"), (None, "N/A"), (59, "0m 59s"),
                                           (60, "1m 0s"), (3725, "62m 5s")])
def test_duration_text(spark, seconds, shown):
    assert one(spark, timing.duration_text(F.lit(seconds).cast("long")))[0] == shown


def test_texts(spark):
    got = one(
        spark, text.split_list(F.lit(" a , ,b,\tc\n,")).alias("l"),
        timing.short_error(F.lit("")).alias("e"), timing.short_error(F.lit("x" * 60)).alias("x"),
        timing.from_millis(F.lit(0).cast("long")).alias("zero"),
        timing.span_seconds(F.lit(1000).cast("long"), F.lit(2999).cast("long")).alias("s"),
        timing.span_seconds(F.lit(1000).cast("long"), F.lit(0).cast("long")).alias("open"),
        text.preview(F.lit("\n".join("abc")), 2).alias("p"),
        text.preview(F.lit("a\nb"), 2).alias("short"),
        text.intent_of(F.lit("ConsumeKafka_2_0")).alias("i"),
        text.intent_of(F.lit(None).cast("string")).alias("none"),
        migrate.fallback_id(F.lit(""), F.lit("n")).alias("md5"))
    assert got["l"] == ["a", "b", "c"]
    assert (got["e"], got["x"]) == ("-", "x" * 50)
    assert got["zero"] is None and got["s"] == 1 and got["open"] is None
    assert got["p"] == "a\nb\n... (1 more lines)" and got["short"] == "a\nb"
    assert (got["i"], got["none"]) == ("ingestion", "other")
    assert got["md5"] == "7b8b965ad4bca0e41ab51de7b31363a1"


def test_json(spark):
    fallback = F.struct(F.lit(-1).alias("a"))
    texts = spark.createDataFrame([('{"a":1}',), ("prose",), ("",), (None,), ('{"b":2}',)],
                                  "t string")
    got = [r[0] for r in texts.select(
        text.parse_json(F.col("t"), "a int", fallback)["a"]).collect()]
    assert got == [1, -1, -1, -1, None]


def test_template_fields_are_filled_once(spark):
    made = one(spark, text.artifact_text(
        F.lit("{intent}"), F.lit("a-b c"), F.lit("T"), F.lit("i"),
        "{flow_name}|{function_name}|{processor_name}|{processor_type}|{intent}|{other}"))[0]
    assert made == "{intent}|a_b_c|a-b c|T|i|{other}"


def table_functions(spark):
    """Every document of the file's own examples, by table function and by array."""
    texts = ["<template><groupId> g </groupId><processor><id>1</id><name/><class>x.A</class></processor>"
             "<s><processor><id>2</id><name>n</name><class/></processor><processor><id>3</id></processor></s></template>",
             "<template><groupId>g</template>", None, "", "<flowController><rootGroup id='r'><processGroup id='p'>"
             "<name>N</name></processGroup><processGroup/></rootGroup></flowController>", "<template/>"]
    spark.createDataFrame(list(enumerate(texts)), "k int, content string").createOrReplaceTempView("some_files")
    got = spark.sql("SELECT k, p.* FROM some_files, LATERAL processors(content) p ORDER BY k, place").collect()
    assert [tuple(r) for r in got] == [(0, "g", 0, "1", None, "x.A"), (0, "g", 1, "2", "n", None)]
    got = spark.sql("SELECT k, g.* FROM some_files, LATERAL process_groups(content) g ORDER BY k, place").collect()
    assert [tuple(r) for r in got] == [
        (0, "g", 0, "main_flow", "Main Flow"), (4, "r", 0, "p", "N"), (4, "r", 1, "flow_1", "Flow 2"),
        (5, None, 0, "main_flow", "Main Flow")]
