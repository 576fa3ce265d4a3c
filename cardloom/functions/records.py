"""Reading of records of unlike shape: values of VARIANT columns by the first of several keys that has one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number at the beginning of a text.
NUMBER = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def lenient_json(text: Column) -> Column:
    """A text as VARIANT; where it is no JSON, what stands from its first brace or bracket to the last that closes it; else null."""
    brace, bracket = F.instr(text, F.lit("{")), F.instr(text, F.lit("["))
    begin = F.when((bracket == 0) | ((brace > 0) & (brace < bracket)), brace).otherwise(bracket)
    last = F.when(begin == brace, F.lit("}")).otherwise(F.lit("]"))
    end = F.length(text) - F.instr(F.reverse(text), last) + 1
    inner = F.when((begin > 0) & (end > begin) & F.contains(text, last), F.substring(text, begin, end - begin + 1))
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(inner))


def at(record: Column, *path: str) -> Column:
    """The value at a path of keys, as VARIANT; null where there is none."""
    return F.try_variant_get(record, "$" + "".join(f'["{k}"]' for k in path), "variant")


def is_record(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def records_of(value: Column) -> Column:
    """The records of an array, in order, or a record alone; an empty array for all else."""
    many = F.filter(F.try_variant_get(value, "$", "array<variant>"), is_record)
    return F.coalesce(many, F.when(is_record(value), F.array(value)), F.array().cast("array<variant>"))


def first_record(*values: Column) -> Column:
    return F.coalesce(*(F.when(is_record(v), v) for v in values))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_number(value: Column) -> Column:
    return _kind(value).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")


def text_at(record: Column, key: str) -> Column:
    """The text of a key, trimmed, or its number as text; null where it is blank, something else, or missing."""
    value = at(record, key)
    own = F.try_variant_get(value, "$", "string")
    return F.when(_kind(value) == "STRING", F.nullif(F.trim(own), F.lit(""))).when(is_number(value), own)


def number_of(value: Column) -> Column:
    """A number, or the number at the beginning of a text; null for all else."""
    text = F.try_variant_get(value, "$", "string")
    read = F.regexp_extract(text, NUMBER, 1).try_cast("double")
    return F.when(is_number(value), F.try_variant_get(value, "$", "double")).when(_kind(value) == "STRING", read)


def first_text(record: Column, *keys: str) -> Column:
    return F.coalesce(*(text_at(record, k) for k in keys))


def first_number(*values: Column) -> Column:
    return F.coalesce(*map(number_of, values))


def numeric_record(record: Column) -> Column:
    """The entries of a record that are numbers, or texts that begin with one."""
    every = F.transform_values(F.coalesce(F.try_variant_get(record, "$", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)")), lambda k, v: number_of(v))
    return F.map_filter(every, lambda k, v: v.isNotNull())
