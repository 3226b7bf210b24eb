"""Reading one definition document: the only Python in the hot path.

Spark's XPath functions end the job on a malformed document and its XML reader
takes fixed paths only, so a document is parsed once, in Arrow batches on the
executors. Everything after that (intents, counts, names) is built-in functions.
"""

from __future__ import annotations

import re
import sys
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.schemas import DEFINITION_ROOTS

# executors get the functions themselves, so they need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The one group of a document without any
MAIN_FLOW = ("main_flow", "Main Flow")

AT_ONCE = 32                 # documents

_TEXT = T.StringType()


def _texts(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TEXT) for name in names])


PARSED = T.StructType([
    *_texts("root", "error", "flow_id", "description").fields,
    T.StructField("groups", T.ArrayType(_texts("id", "name"))),
    T.StructField("processors", T.ArrayType(_texts("id", "name", "type"))),
])
_GROUP = pa.struct([("id", pa.string()), ("name", pa.string())])
_PROCESSOR = pa.struct([("id", pa.string()), ("name", pa.string()), ("type", pa.string())])
_PARSED_ARROW = pa.struct([
    ("root", pa.string()), ("error", pa.string()), ("flow_id", pa.string()),
    ("description", pa.string()), ("groups", pa.list_(_GROUP)),
    ("processors", pa.list_(_PROCESSOR)),
])


def read_document(text: str | None) -> dict:
    """Facts of one document. Entity declarations are refused, not expanded."""
    if text is None:
        return {"error": "not UTF-8 text"}
    if "<!ENTITY" in text and _declares_entities(text):
        return {"error": "entity declarations are not accepted"}
    try:
        root = ET.fromstring(text)
    except (ET.ParseError, ValueError) as problem:
        return {"error": str(problem)}
    notes = (child.text for child in root if child.tag in ("comment", "description"))
    processors = []
    for node in root.iterfind(".//processor"):
        parts = [node.find(tag) for tag in ("id", "name", "class")]
        if all(part is not None for part in parts):
            processors.append(dict(zip(("id", "name", "type"), (part.text for part in parts))))
    groups = [{"id": node.get("id", f"flow_{place}"),
               "name": node.findtext(".//name", f"Flow {place + 1}") or None}
              for place, node in enumerate(root.iterfind(".//processGroup"))]
    return {"root": root.tag, "flow_id": _identity(root), "description": next(notes, None),
            "groups": groups, "processors": processors}


def _declares_entities(text: str) -> bool:
    """Whether the part before the root element, comments left out, declares an entity."""
    bare = re.sub("<!--.*?-->", "", text, flags=re.DOTALL)
    root = re.search("<[A-Za-z_:]", bare)
    return "<!ENTITY" in (bare[:root.start()] if root else bare)


def _identity(root: ET.Element) -> str | None:
    """Text of the first groupId below the root, else the id of the first rootGroup."""
    stated = root.findtext(".//groupId")
    if stated:
        return stated.strip()
    holder = root.find(".//rootGroup")
    return (holder.get("id") or None) if holder is not None else None


@F.arrow_udf(PARSED)
def parse_definition(content: pa.Array) -> pa.Array:
    # a few documents at a time as Python objects, which take many times the room of a batch's rows
    parts = [pa.array([read_document(text.as_py()) for text in content.slice(at, AT_ONCE)], type=_PARSED_ARROW)
             for at in range(0, len(content), AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], type=_PARSED_ARROW)


def validity(parsed: Column, product: str = "definition") -> Column:
    """(valid, message): well formed and with a known root element."""
    broken, known = parsed["error"].isNotNull(), parsed["root"].isin(DEFINITION_ROOTS)
    return F.struct(
        (~broken & F.coalesce(known, F.lit(False))).alias("valid"),
        F.when(broken, F.concat(F.lit("Invalid XML: "), parsed["error"]))
        .when(known, F.lit(f"Valid {product} XML file"))
        .otherwise(F.lit(f"Not a valid {product} XML file")).alias("message"),
    )


def process_groups(parsed: Column) -> Column:
    """Groups at any depth; a document without any is one flow."""
    whole = F.array(F.struct(*(F.lit(v).alias(n) for v, n in zip(MAIN_FLOW, ("id", "name")))))
    return F.when(F.size(parsed["groups"]) > 0, parsed["groups"]).otherwise(whole)


@F.udtf(returnType="flow_id string, place int, id string, name string, type string", useArrow=True)
class Processors:
    """The processors of a document in its order; none where it cannot be read."""

    def eval(self, content: str):
        found = read_document(content)
        for place, each in enumerate(found.get("processors") or ()):
            yield found["flow_id"], place, each["id"], each["name"] or None, each["type"]


@F.udtf(returnType="flow_id string, place int, id string, name string", useArrow=True)
class ProcessGroups:
    """The process groups of a document that can be read; one without any is one flow."""

    def eval(self, content: str):
        found = read_document(content)
        if found.get("error") is None:
            for place, each in enumerate(found["groups"] or [{"id": MAIN_FLOW[0], "name": MAIN_FLOW[1]}]):
                yield found["flow_id"], place, each["id"], each["name"]


def register(spark: SparkSession) -> None:
    """Make the definition functions known to SQL.

    ``SELECT inline(parse_definition(content).processors) FROM files`` lists the processors of
    every document, as does ``SELECT f.path, p.* FROM files f, LATERAL processors(f.content) p``;
    ``process_groups(content)`` is the table function of its groups.
    """
    spark.udf.register("parse_definition", parse_definition)
    spark.udtf.register("processors", Processors)
    spark.udtf.register("process_groups", ProcessGroups)
