"""Normalising model responses kept in a run log."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from troughline import vocabulary as V
from troughline.functions.labels import measured, number

_STRICT = {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_bad"}
_BLANKS = " \t\r\n"
_FENCE = r"(?is)```(?:json)?\s*(.*?)\s*```"
_EMPTY = re.compile(r"\{\s*\}")


def _scan(text: str) -> str | None:
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            _, end = decoder.raw_decode(text, at)
            return text[at:end]
        except json.JSONDecodeError as e:
            if e.msg.startswith("Unterminated string"):  # no string ends from here on: only an empty object can follow
                found = _EMPTY.search(text, e.pos)
                return found.group() if found else None
        except RecursionError:  # deeper than any response: no object begins here
            pass
        at = text.find("{", at + 1)
    return None


@F.pandas_udf(T.StringType())
def first_object(texts: pd.Series) -> pd.Series:
    """The first substring that decodes as a JSON object. NULL in, NULL out; never fails."""
    return texts.map(lambda t: None if t is None else _scan(t), na_action="ignore").astype(object).where(texts.notna(), None)


def with_object(df: DataFrame, fields: Sequence[str], raw: str = "raw_response", out: str = "obj") -> DataFrame:
    """Add named fields of a response's JSON object as a struct of texts, NULL when there is no object.

    Of a repeated key the last value counts. Fences are cut and whole-text JSON is parsed in the JVM.
    Only the texts that fail are handed to the Arrow scan; every other row sends it a NULL.
    """
    layout = ", ".join(f"{f} string" for f in (*fields, "_bad"))
    parsed = lambda c: F.from_json(c, layout, _STRICT)
    text = F.btrim(F.col(raw), F.lit(_BLANKS))
    fenced = F.regexp_extract(text, _FENCE, 1)
    body = F.when(text.rlike(_FENCE), F.btrim(fenced, F.lit(_BLANKS))).otherwise(text)
    good = lambda c: F.when(F.col(f"{c}._bad").isNull(), F.col(c))
    return (
        df.withColumn("_body", body)
        .withColumn("_read", F.when(F.col("_body").startswith("{"), parsed("_body")))
        .withColumn("_whole", good("_read"))
        .withColumn("_found", parsed(first_object(F.when(F.col("_whole").isNull(), F.col("_body")))))
        .withColumn(out, F.coalesce("_whole", good("_found")))
        .drop("_body", "_read", "_whole", "_found")
    )


def _text(c: Column) -> Column:
    """Trimmed text; blank and null-like words become NULL."""
    t = F.btrim(c, F.lit(_BLANKS))
    return F.when(~F.lower(t).isin("", "null", "none"), t)


def _flag(c: Column) -> Column:
    low = F.lower(F.btrim(c, F.lit(_BLANKS)))
    return F.when(low.isin("true", "yes", "y", "1"), True).when(low.isin("false", "no", "n", "0"), False)


def _quoted(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("None"))


def _no_object(raw: str) -> Column:
    blank = F.coalesce(F.btrim(F.col(raw), F.lit(_BLANKS)), F.lit("")) == ""
    return F.when(blank, "empty response").otherwise("no JSON object found in response")


def parse_adjudications(df: DataFrame, raw: str = "raw_response") -> DataFrame:
    """Add `parsed_ok, schema_complete, observed, call, confidence, rationale, parse_error`.

    Never fails: a missing object, a legacy or unknown call, or an unusable confidence sets
    `parsed_ok` false and says why.
    """
    rows = with_object(df, ("call", "confidence", "observed", "rationale"), raw, "_obj")
    get = lambda k: F.col(f"_obj.{k}")
    given = get("call")
    call = F.lower(F.btrim(given, F.lit(_BLANKS)))
    value = number(get("confidence"))
    finite = measured(value) & (F.abs(value) != float("inf"))
    error = (
        F.when(F.col("_obj").isNull(), _no_object(raw))
        .when(call.isin(*V.LEGACY_CALLS), F.concat(F.lit("legacy_call_value: "), _quoted(call), F.lit(" indicates a stale prompt")))
        .when(call.isNull() | ~call.isin(*V.CALLS), F.concat(F.lit("invalid or missing call: "), _quoted(given)))
        .when(value.isNull(), F.concat(F.lit("non-numeric confidence: "), _quoted(get("confidence"))))
        .when(~finite, F.concat(F.lit("non-finite confidence: "), _quoted(get("confidence"))))
    )
    rows = rows.withColumn("parse_error", error)
    ok = F.col("parse_error").isNull()
    return rows.withColumns({
        "parsed_ok": ok,
        "observed": _text(get("observed")),
        "rationale": _text(get("rationale")),
        "call": F.when(call.isin(*V.CALLS), call),
        "confidence": F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))),
    }).withColumn(
        "schema_complete", ok & F.col("observed").isNotNull() & F.col("rationale").isNotNull()
    ).drop("_obj")


def parse_extractions(df: DataFrame, raw: str = "raw_response") -> DataFrame:
    """Add `parsed_ok, phenotype, vasopressor_use, shock_state, notes, parse_error`."""
    rows = with_object(df, ("phenotype", "vasopressor_use", "shock_state", "notes"), raw, "_obj")
    get = lambda k: F.col(f"_obj.{k}")
    return rows.withColumns({
        "parsed_ok": F.col("_obj").isNotNull(),
        "phenotype": _text(get("phenotype")),
        "vasopressor_use": _flag(get("vasopressor_use")),
        "shock_state": _text(get("shock_state")),
        "notes": _text(get("notes")),
        "parse_error": F.when(F.col("_obj").isNull(), _no_object(raw)),
    }).drop("_obj")
