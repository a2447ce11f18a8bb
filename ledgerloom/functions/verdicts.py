"""Parsing a language model's verdict: text blocks, fenced JSON, required keys, coerced values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REQUIRED = ("typology", "confidence", "rationale", "evidence")
_SCHEMA = "typology string, confidence string, rationale string, evidence string"


def message_text(blocks: Column) -> Column:
    """The text of an array of blocks (struct with text), null texts left out."""
    return F.array_join(F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: t.isNotNull()), "")


def json_object(text: Column) -> Column:
    """From the first brace to the last: the object within a fence or prose; null without one."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def verdict(text: Column) -> Column:
    """struct(typology, confidence, rationale, evidence array); null if there is no object with all keys and a numeric confidence."""
    body = json_object(text)
    x = F.from_json(body, _SCHEMA)
    whole = F.lit(True)
    for key in REQUIRED:
        whole = whole & F.array_contains(F.coalesce(F.json_object_keys(body), F.array().cast("array<string>")), key)
    number = x["confidence"].try_cast("double")
    sure = F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)))
    listed = F.from_json(x["evidence"], "array<string>")
    evidence = F.when(x["evidence"].isNull(), F.array().cast("array<string>")).when(x["evidence"].startswith("["), listed).otherwise(F.array(x["evidence"]))
    out = F.struct(x["typology"].alias("typology"), sure.alias("confidence"), x["rationale"].alias("rationale"), evidence.alias("evidence"))
    return F.when(whole & sure.isNotNull() & ~F.isnan(sure), out)
