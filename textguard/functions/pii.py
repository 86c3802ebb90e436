"""Personal data: spans and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard import rules
from textguard.functions.text import pattern

SPAN = "struct<type:string,text:string,start:int,end:int,confidence:double>"


def _may_contain(text: Column, kind: str) -> Column:
    """A cheap test that spares most texts the pattern: emails have an @ sign,
    everything else has a digit."""
    return text.contains("@") if kind == "email" else text.rlike(r"\p{Nd}")


def _regex(body: str) -> str:
    """The pattern, looking for its leading digit before it looks for a word
    edge, which costs more and is there or not at every place of a text."""
    return pattern(rf"(?=\d){body}" if body.startswith(r"\b\d") else body)


def _spans_of(text: Column, kind: str, body: str) -> Column:
    """Spans of one type.  The pieces between the matches give the offsets: a
    match starts after all pieces and matches before it."""
    regex = _regex(body)
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    pieces = F.split(text, regex, -1)
    steps = F.zip_with(
        found, F.slice(pieces, 1, F.size(found)),
        lambda match, piece: F.struct(match.alias("match"), F.length(piece).alias("gap")))
    empty = F.struct(F.array().cast(f"array<{SPAN}>").alias("spans"), F.lit(0).alias("at"))

    def add(acc: Column, step: Column) -> Column:
        start = acc["at"] + step["gap"]
        end = start + F.length(step["match"])
        span = F.struct(
            F.lit(kind).alias("type"), step["match"].alias("text"), start.alias("start"),
            end.alias("end"), F.lit(rules.PII_CONFIDENCE).alias("confidence"))
        return F.struct(F.concat(acc["spans"], F.array(span)).alias("spans"), end.alias("at"))

    spans = F.aggregate(steps, empty, add, lambda acc: acc["spans"])
    return F.when(_may_contain(text, kind), spans)


def pii_spans(text: Column) -> Column:
    """All spans as `ARRAY<STRUCT<type, text, start, end, confidence>>`, type by
    type, with code-point offsets; empty for null."""
    none = F.array().cast(f"array<{SPAN}>")
    return F.concat(*[
        F.coalesce(_spans_of(text, kind, body), none) for kind, body in rules.PII_PATTERNS.items()])


def span_rows(df: DataFrame, row_id: str, spans: Column) -> DataFrame:
    """Spans as rows: `row_id, type, text, start, end, confidence`.

    An outer explode: before a plain one Spark puts a filter for empty arrays,
    which would work out the spans a second time."""
    return (df.select(row_id, F.explode_outer(spans).alias("_s")).where("_s is not null")
            .select(row_id, "_s.*"))


def redact_pii(text: Column) -> Column:
    """Each span replaced by `[REDACTED-<type>]`, type by type.

    The markers hold neither digits nor @ signs, so no marker is matched again.
    """
    out = text
    for kind, body in rules.PII_PATTERNS.items():
        redacted = F.regexp_replace(out, _regex(body), f"[REDACTED-{kind}]")
        out = F.when(_may_contain(text, kind), redacted).otherwise(out)
    return out


def by_start_descending(spans: Column) -> Column:
    """Spans in the order in which they can be replaced without moving others."""
    return F.array_sort(spans, lambda a, b: b["start"] - a["start"])


def redact_spans(text: Column, spans: Column) -> Column:
    """Replace given spans from right to left, leaving out those that overlap a
    span further right."""
    start = F.struct(text.alias("text"), F.length(text).alias("floor"))

    def replace(acc: Column, span: Column) -> Column:
        kept = F.struct(
            F.concat(F.substring(acc["text"], F.lit(1), span["start"]), F.lit("[REDACTED-"), span["type"],
                     F.lit("]"), F.substring(acc["text"], span["end"] + 1, F.length(acc["text"]))).alias("text"),
            span["start"].alias("floor"))
        return F.when(span["end"] <= acc["floor"], kept).otherwise(acc)

    return F.aggregate(by_start_descending(spans), start, replace, lambda acc: acc["text"])
