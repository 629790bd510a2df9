"""JSON helpers: payload build, field access, model-output clean-up and parse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import parse

SUMMARY_SCHEMA = ("struct<title:string,hypotheses:array<struct<rank:int,text:string,confidence:int>>,"
                  "evidence:array<struct<type:string,label:string,text:string>>,ai_summary:string>")


def to_json_keep_nulls(*cols: Column) -> Column:
    """``to_json(struct(...))`` writing ``null`` for missing fields instead of dropping them."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def strip_fences(text) -> Column:
    """Remove a leading ```` ```lang ```` line and a trailing ```` ``` ```` fence, then trim."""
    t = parse.strip_ws(text)
    t = F.regexp_replace(t, "^```[a-z]*\\n?", "")
    t = F.regexp_replace(t, "\\n?```$", "")
    return parse.strip_ws(t)


def parse_summary(text) -> Column:
    """Struct of the summary fields, NULL when the cleaned text is not valid JSON."""
    clean = strip_fences(text)
    return F.when(F.try_parse_json(clean).isNotNull(), F.from_json(clean, SUMMARY_SCHEMA))


def is_json(text) -> Column:
    """Whether the cleaned text is valid JSON (null: no)."""
    return F.coalesce(F.try_parse_json(strip_fences(text)).isNotNull(), F.lit(False))


def has_fields(text, fields) -> Column:
    """Whether the cleaned text is a JSON object with all the fields."""
    keys = F.json_object_keys(strip_fences(text))
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, fields)), keys)) == 0, F.lit(False))
