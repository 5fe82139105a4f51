"""Record sources: decoded messages, link previews, contacts."""

from __future__ import annotations

import plistlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.session import batch_function

#: A decoded message, one JSON object a line.
MESSAGE_RECORD = T.StructType([
    T.StructField("rowid", T.LongType(), False), T.StructField("guid", T.StringType(), False), T.StructField("chat_guid", T.StringType()), T.StructField("handle", T.StringType()),
    T.StructField("is_from_me", T.BooleanType(), False), T.StructField("date", T.StringType()), T.StructField("date_edited", T.StringType()), T.StructField("date_retracted", T.StringType()),
    T.StructField("service", T.StringType()), T.StructField("body_text", T.StringType()),
    T.StructField("edit_history", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("edited_at", T.StringType())]))),
    T.StructField("is_unsent", T.BooleanType()),
    T.StructField("tapback", T.StructType([T.StructField("kind", T.StringType()), T.StructField("emoji", T.StringType()), T.StructField("action", T.StringType()), T.StructField("target_guid", T.StringType())])),
    T.StructField("attachment_rowids", T.ArrayType(T.LongType())), T.StructField("reply_to_guid", T.StringType()),
])
REQUIRED = ("rowid", "guid", "is_from_me")
SERVICES = ("imessage", "sms", "rcs")
DEEPEST = 20
PREVIEW = "struct<url: string, title: string, summary: string, site_name: string>"


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Decoded messages from JSON lines. A malformed line, or one that lacks a required field, is an error."""
    rows = spark.read.schema(MESSAGE_RECORD).option("mode", "FAILFAST").json(path)
    checked = rows
    for name in REQUIRED:
        checked = checked.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"missing field {name}"))).otherwise(F.col(name)))
    return checked


def chat_kind(style: Column, participants: Column) -> Column:
    """Group or direct by the style code, else by the number of participants."""
    return F.when(style == 43, "group").when(style == 45, "dm").when(participants > 1, "group").otherwise("dm")


def service_name(raw: Column) -> Column:
    name = F.lower(F.trim(raw))
    return F.when(name.isin(*SERVICES), name).otherwise("unknown")


def _find_preview(root: object) -> dict[str, str] | None:
    """The first mapping with an http url, depth first from the archive's root; references are followed.

    Anything but an archive with a list of objects and a root has none, so what
    nothing refers to is never found.
    """
    if not isinstance(root, dict) or not isinstance(root.get("$objects"), list) or not isinstance(root.get("$top"), dict) or "root" not in root["$top"]:
        return None
    objects, root = root["$objects"], root["$top"]["root"]
    names = {"url": ("originalURL", "URL", "url"), "title": ("title",), "summary": ("summary",), "site_name": ("siteName", "site_name")}

    def resolve(x: object) -> object:
        for _ in range(DEEPEST):
            if isinstance(x, plistlib.UID) and x.data < len(objects):
                x = objects[x.data]
            else:
                break
        return x

    def text(x: object, depth: int = 0) -> str | None:
        x = resolve(x)
        if isinstance(x, str) and x != "$null":
            return x
        if isinstance(x, dict) and depth < DEEPEST:
            return next((t for v in x.values() if (t := text(v, depth + 1))), None)
        return None

    stack: list[tuple[object, int]] = [(root, 0)]
    while stack:
        node, depth = stack.pop()
        node = resolve(node)
        if depth > DEEPEST:
            continue
        if isinstance(node, dict):
            found = {k: next((t for n in keys if n in node and (t := text(node[n]))), None) for k, keys in names.items()}
            if found["url"] and found["url"].startswith(("http://", "https://")):
                return found
            stack += [(v, depth + 1) for v in reversed(list(node.values()))]
        elif isinstance(node, list):
            stack += [(v, depth + 1) for v in reversed(node)]
    return None


def link_preview(payload: Column) -> Column:
    """The link preview in a binary property list; null for anything else."""
    def one(data: bytes | None) -> dict[str, str] | None:
        if not data:
            return None
        try:
            return _find_preview(plistlib.loads(bytes(data)))
        except Exception:  # not a property list
            return None

    @batch_function(PREVIEW)
    def run(payloads: pa.Array) -> pa.Array:
        kind = pa.struct([(n, pa.string()) for n in ("url", "title", "summary", "site_name")])
        return pa.array([one(x) for x in payloads.to_pylist()], kind)

    return run(payload)


def contacts_frame(spark: SparkSession, contacts: Iterable[tuple[str, Iterable[str]]]) -> DataFrame:
    """``(contact, normalized_value)`` from (name, handles) pairs."""
    from colloquy.functions.text import normalize_handle

    raw = spark.createDataFrame([(name, h) for name, handles in contacts for h in handles], "contact string, raw string")
    return raw.select("contact", normalize_handle(F.col("raw"))[1].alias("normalized_value"))


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


# strict decoding

#: Fields of a record line; others are told as unknown.
FIELDS = tuple(f.name for f in MESSAGE_RECORD.fields)
ACTIONS = ("added", "removed")


def decode_lines(lines: DataFrame, line: str = "line", refuse_unknown: bool = False) -> DataFrame:
    """Adds the fields of a record line, ``problem`` (null for a good line) and ``unknown_fields``.

    A line is parsed once, without a schema, and every field's own type is looked
    at, so nothing is silently cast or dropped. Problems, of which the first of
    these is told: ``not_json``, ``not_object``, ``missing:`` a required field,
    ``type:`` a field of a wrong type (also inside of reactions, edits and
    attachment ids), ``tapback_action`` for one that is neither added nor removed,
    and, if they are refused, ``unknown:`` the first field that is not known. A
    line with a problem has no fields. Absent and null fields are null; the
    service is then unknown, an action added, edits and attachments empty.
    """
    whole = lines.withColumn("_v", F.try_parse_json(F.col(line)))
    whole = whole.withColumn("_m", F.when(F.expr("startswith(schema_of_variant(_v), 'OBJECT')"), F.expr("try_cast(_v AS MAP<STRING, VARIANT>)")))

    def kind(value: str) -> Column:
        return F.coalesce(F.regexp_extract(F.expr(f"schema_of_variant({value})"), "^[A-Z]+", 0), F.lit("VOID"))

    def wrong(value: str, *kinds: str) -> Column:
        return ~kind(value).isin(*kinds)

    optional = ("VOID", "STRING")
    objects = "try_cast(_m['edit_history'] AS ARRAY<VARIANT>)"
    ids = "try_cast(_m['attachment_rowids'] AS ARRAY<VARIANT>)"
    tapback = lambda name: f"try_variant_get(_m['tapback'], '$.{name}', 'variant')"
    in_list = lambda values, test: F.expr(f"exists({values}, x -> NOT coalesce({test}, false))")
    unknown = F.array_sort(F.array_except(F.map_keys("_m"), F.array(*map(F.lit, FIELDS))))
    problem = F.when(F.col("_v").isNull(), "not_json").when(F.col("_m").isNull(), "not_object")
    for name in ("rowid", "guid"):
        problem = problem.when(~F.map_contains_key("_m", F.lit(name)), f"missing:{name}")
    problem = problem.when(wrong("_m['rowid']", "BIGINT"), "type:rowid").when(wrong("_m['guid']", "STRING"), "type:guid")
    for name in ("chat_guid", "handle", "date", "date_edited", "date_retracted", "body_text", "reply_to_guid", "service"):
        problem = problem.when(wrong(f"_m['{name}']", *optional), f"type:{name}")
    for name in ("is_from_me", "is_unsent"):
        problem = problem.when(wrong(f"_m['{name}']", "VOID", "BOOLEAN"), f"type:{name}")
    problem = problem.when(wrong("_m['tapback']", "VOID", "OBJECT"), "type:tapback")
    there = kind("_m['tapback']") == "OBJECT"
    for name, kinds in (("kind", ("STRING",)), ("target_guid", ("STRING",)), ("emoji", optional)):
        problem = problem.when(there & wrong(tapback(name), *kinds), f"type:tapback.{name}")
    action = F.coalesce(F.expr(tapback("action").replace("'variant'", "'string'")), F.lit("added"))
    problem = problem.when(there & ~action.isin(*ACTIONS), "tapback_action")
    problem = problem.when(wrong("_m['edit_history']", "VOID", "ARRAY") | in_list(objects, "startswith(schema_of_variant(x), 'OBJECT')"), "type:edit_history")
    problem = problem.when(wrong("_m['attachment_rowids']", "VOID", "ARRAY") | in_list(ids, "schema_of_variant(x) = 'BIGINT'"), "type:attachment_rowids")
    if refuse_unknown:
        problem = problem.when(F.size(unknown) > 0, F.concat(F.lit("unknown:"), unknown[0]))
    told = whole.withColumns({"problem": problem, "unknown_fields": F.coalesce(unknown, F.array().cast("array<string>"))})
    good = F.col("problem").isNull()

    def field(name: str) -> Column:
        shape = MESSAGE_RECORD[name].dataType.simpleString()
        return F.expr(f"try_cast(_m['{name}'] AS {shape})")

    defaults = {"is_from_me": F.lit(False), "is_unsent": F.lit(False), "service": F.lit("unknown"), "attachment_rowids": F.array().cast("array<bigint>"), "edit_history": F.array().cast(MESSAGE_RECORD["edit_history"].dataType)}
    columns = [F.when(good, F.coalesce(field(n), defaults[n]) if n in defaults else field(n)).alias(n) for n in FIELDS if n != "tapback"]
    shape = MESSAGE_RECORD["tapback"].dataType
    reaction = F.struct(*[(action if f.name == "action" else F.expr(tapback(f.name).replace("'variant'", "'string'"))).alias(f.name) for f in shape.fields])
    return told.select(*lines.columns, *columns, F.when(good & there, reaction).alias("tapback"), "problem", "unknown_fields")


def quarantined(decoded: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """``(records, refused)`` of decoded lines: what goes on, and the lines that do not with their problems."""
    return decoded.where("problem is null").drop(line, "problem", "unknown_fields"), decoded.where("problem is not null").select(line, "problem", "unknown_fields")
