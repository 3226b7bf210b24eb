"""Documents parsed piece by piece against the parse of the whole; polls as a stream."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.definition import read_document
from ledgerline.functions.records import Document
from ledgerline.plans import ingest, records
from ledgerline.session import new_dir
from ledgerline.sources import files, polls
from ledgerline.streaming import events as streams
from tests.conftest import rows
from tests.test_definitions import DOCUMENTS

TAGS = ["template", "p", "processor", "processor", "processGroup", "processGroup", "rootGroup", "groupId", "id", "name",
        "class", "comment", "description"]


def made(pick, depth=0):
    tag = pick.choice(TAGS)
    attributes = pick.choice(["", " id='a'", " id=''", " id='b&amp;c'", " xmlns='u'" if pick.random() < 0.1 else ""])
    inner = "".join(
        pick.choice(["t", " ", "&lt;", "<![CDATA[c<]]>", "<!--c-->", "é", "<?x y?>"]) if pick.random() < 0.5 or depth > 5
        else made(pick, depth + 1) for _ in range(pick.randrange(5)))
    return f"<{tag}{attributes}>{inner}</{tag}>"


def in_pieces(text, size):
    document, data = Document(), text.encode()
    try:
        for k in range(0, len(data), size):
            document.feed(data[k:k + size])
        document.feed(b"", True)
    except ValueError:
        return "error"
    return {"root": document.root, "flow_id": document.flow_id, "description": document.description,
            "groups": [{"id": g[1], "name": g[2]} for g in sorted(document.groups)],
            "processors": [dict(zip(("id", "name", "type"), p[1:])) for p in sorted(document.processors)]}


def test_pieces_give_the_facts_of_the_whole():
    pick = random.Random(6)
    texts = list(DOCUMENTS.values()) + [made(pick) for _ in range(4000)]
    for text in texts:
        if pick.random() < 0.05:
            text = text[:pick.randrange(len(text))]
        if pick.random() < 0.02:
            text = "<!DOCTYPE t [<!ENTITY e 'v'>]>" + text
        want = read_document(text)
        assert in_pieces(text, pick.choice([1, 7, 1000])) == ("error" if want.get("error") else want), text


@pytest.fixture(scope="module")
def folder(spark):
    base = new_dir(spark, "records").removeprefix("file:")
    for name, text in {**DOCUMENTS, "empty": "", "_hidden": "<template/>"}.items():
        os.makedirs(f"{base}/prod", exist_ok=True)
        with open(f"{base}/prod/{name}.xml", "w") as out:
            out.write(text)
    with open(f"{base}/prod/bytes.xml", "wb") as out:
        out.write(b"<template>\xff</template>")
    os.mkfifo(f"{base}/prod/pipe.xml")
    return base


def test_records_of_files_against_their_texts(spark, folder):
    found = records.records(spark, folder).cache()
    texts = files.scan_all(spark, folder).filter("state IN ('text', 'not text')").select("path", "content")
    assert rows(records.processors(found)) == rows(ingest.processors(texts))
    assert rows(records.groups(found)) == rows(ingest.groups(texts).drop("description"))
    columns = ["path", "flow_id", "flow_name", "server", "description", "valid"]
    pipe = F.col("path").endswith("pipe.xml")
    got = records.catalogue(found, folder.rsplit("/", 1)[1])
    assert rows(got.filter(~pipe).select(columns)) == rows(ingest.catalogue(texts, folder.rsplit("/", 1)[1]).select(columns))
    assert "unreadable" in got.filter(pipe).first()["error"]


def test_a_long_file_is_handed_on_in_parts():
    class Source:
        """Two million processors, never in memory at once."""
        left, begun = 2_000, False

        def read(self, size):
            if not self.begun:
                self.begun = True
                return b"<template><groupId>g</groupId>"
            self.left -= 1
            if self.left > 0:
                return b"<processor><id>1</id><name>n</name><class>c</class></processor>" * 1000
            return b"</template>" if self.left == 0 else b""

    seen = 0
    for row in records.parts_of("p", Source()):
        seen += row[1] == "processor"
        last = row
    assert seen == 1_999_000 and last[1:4] == ("document", 0, "g")


def test_polls_from_any_offset(spark):
    base = new_dir(spark, "polls")
    kind = "job_run_id string, life_cycle_state string, state_message string"
    made_ = [[(f"j{k}", f"S{poll}", None if k % 2 else "line\nbreak   é") for k in range(poll * 3)] for poll in range(5)]

    def run_to(checkpoint, first=0):
        stream = polls.poll_stream(spark, f"{base}/polls", first)
        streams.run_available(stream, streams.append_batches(f"{base}/{checkpoint}-rows"), f"{base}/{checkpoint}")
        try:
            seen = spark.read.parquet(f"{base}/{checkpoint}-rows")
        except Exception:
            return []
        return sorted((r["poll"], r["job_run_id"], r["life_cycle_state"], r["state_message"]) for r in seen.select(
            "poll", "job_run_id", "life_cycle_state", "state_message").na.fill("").collect())

    def want(upto, first=0):
        return sorted((poll, job, state, message or "") for poll in range(first, upto) for job, state, message in made_[poll])

    for poll in (0, 1):
        polls.write_poll(spark.createDataFrame(made_[poll], kind), f"{base}/polls", poll)
    assert run_to("a") == want(2)
    # a poll that is not complete, or that comes before another is there, waits
    polls.write_poll(spark.createDataFrame(made_[3], kind), f"{base}/polls", 3)
    assert run_to("a") == want(2)
    polls.write_poll(spark.createDataFrame(made_[2], kind), f"{base}/polls", 2)
    polls.write_poll(spark.createDataFrame(made_[4], kind), f"{base}/polls", 4)
    mark = f"{base}/polls/poll=4/_SUCCESS".removeprefix("file:")
    os.remove(mark)
    assert run_to("a") == want(4)
    open(mark, "w").close()
    assert run_to("a") == want(5) == run_to("a")
    assert run_to("b", first=3) == want(5, 3)
