"""Dictionary entities: names of a gazetteer found in texts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textguard import rules
from textguard.functions.pii import SPAN

MAX_NAMES = 100_000
_WORD = r"[^\W][\w#'.-]*\w|\w"


def _grams(words_per_name: int):
    """A function from a text to its word sequences of up to `words_per_name`
    words: (start, end), longest first at each place."""
    word = re.compile(_WORD)

    def grams(text: str) -> Iterator[tuple[int, int]]:
        places = [m.span() for m in word.finditer(text)]
        for i, (start, _) in enumerate(places):
            for j in range(min(i + words_per_name, len(places)) - 1, i - 1, -1):
                yield start, places[j][1]

    return grams


def _name_length(dictionary: DataFrame) -> int:
    return dictionary.agg(F.max(F.size(F.regexp_extract_all("name", F.lit(r"\S+"), F.lit(0))))).first()[0] or 1


_BITS = 1 << 26


def _name_bits(dictionary: DataFrame):
    """A function that is true for every name of the dictionary and for few other strings.

    Names fall into words of 64 bits; the words come to the driver, at most
    `_BITS` / 64 of them (8 MB), whatever the dictionary's size."""
    names = dictionary.agg(F.approx_count_distinct("name")).first()[0]
    bits = 1 << min(_BITS.bit_length() - 1, max(10, (16 * names).bit_length()))
    place = F.pmod(F.crc32(F.col("name")), F.lit(bits))
    words = dictionary.where("name is not null").select(F.shiftright(place, 6).cast("int").alias("word"), F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    table = bytearray(bits // 8)
    for word, bit in words.collect():
        table[8 * word: 8 * word + 8] = (bit & (2**64 - 1)).to_bytes(8, "little")
    table, crc = bytes(table), zlib.crc32

    def may(name: str) -> bool:
        place = crc(name.encode("utf-8", "surrogatepass")) & (bits - 1)
        return table[place >> 3] >> (place & 7) & 1

    return may


def entity_finder(dictionary: DataFrame, max_names: int = MAX_NAMES):
    """A column function from text to entity spans, for a dictionary (`name`,
    `type`) of at most `max_names` names; the names travel with the task.

    Names match whole words, case included; at a place the longest name wins, and
    of a name's types the first."""
    rows = dictionary.groupBy("name").agg(F.min("type").alias("type")).limit(max_names + 1).collect()
    if len(rows) > max_names:
        raise ValueError(f"more than {max_names} names: use dictionary_entities")
    types = {r["name"]: r["type"] for r in rows}
    grams = _grams(max((len(n.split()) for n in types), default=1))
    confidence = rules.ENTITY_CONFIDENCE
    spans = pa.list_(pa.struct([
        ("type", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
        ("confidence", pa.float64())]))

    def find(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            found, last = [], -1
            for start, end in grams(text or ""):
                if start > last and text[start:end] in types:
                    found.append({"type": types[text[start:end]], "text": text[start:end], "start": start,
                                  "end": end, "confidence": confidence})
                    last = start
            out.append(found)
        return pa.array(out, spans)

    return F.arrow_udf(find, f"array<{SPAN}>")


def dictionary_entities(df: DataFrame, row_id: str, text: str, dictionary: DataFrame) -> DataFrame:
    """Entity spans as rows, for a dictionary of any size:
    `row_id, type, text, start, end, confidence`.

    Word sequences meet the dictionary in an ordinary equi-join, one dictionary
    row each; frequent words are split by adaptive execution.  Only sequences that
    a bit table of the dictionary's hashed names lets pass are sent to the join:
    its size goes by the number of names up to `_BITS` bits, beyond which it lets
    more pass, but the join decides.  At a place the longest name wins, and a place
    is one row of one text."""
    grams = _grams(_name_length(dictionary))
    may = _name_bits(dictionary)
    kind = df.select(row_id).schema.add("name", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType())
    arrow = to_arrow_schema(kind)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, t[s:e], s, e) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    if t for s, e in grams(t) if may(t[s:e])]
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    names = dictionary.groupBy("name").agg(F.min("type").alias("type"))
    found = df.select(row_id, text).mapInArrow(emit, kind).join(names, "name")
    longest = found.groupBy(row_id, "start").agg(F.max_by(F.struct("type", "name", "end"), F.col("end")).alias("_s"))
    return longest.select(
        row_id, F.col("_s.type").alias("type"), F.col("_s.name").alias("text"), "start",
        F.col("_s.end").alias("end"), F.lit(rules.ENTITY_CONFIDENCE).alias("confidence"))
