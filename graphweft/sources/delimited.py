"""Delimited import lines: a permissive reader that keeps what fails, and the loader of the rest.

Every line is read under the explicit schema of its header (``import_columns``) and the dialect of its run (``import_runs``):
the reader always yields the fields it can make out and never drops a line. Lines that do not fit keep their raw text in
``_corrupt_record`` and are then classified by quoting, field count and casts. Everything is a JVM expression: a line without a quote is
split at its delimiter; for the others one regular expression finds the fields, and what it leaves over shows broken quoting. Values are checked by a
cast where a cast is as strict as the type, and by a pattern only where the cast would accept more. Spark's own CSV reader is not used for this: it
takes one fixed dialect per scan, ends a record at an unquoted line break and silently accepts text after a closing quote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.session import table

INT = r"\A[+-]?[0-9]+\z"
FLOAT = r"\A\s*+[+-]?(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][+-]?[0-9]++)?\s*+\z"
BOOL = r"\A\s*+(?:true|false)\s*+\z"


def _code_point(c: Column) -> Column:
    """A one-character string as a regular-expression escape that is safe inside and outside a class."""
    return F.concat(F.lit("\\x{"), F.hex(F.ascii(c).cast("long")), F.lit("}"))


def field_pattern(delimiter: Column, quote: Column) -> Column:
    """The pattern of a delimiter and the field after it, for lines that hold the quote."""
    d, q = _code_point(delimiter), _code_point(quote)
    return F.concat(
        F.lit("(?s)"), d, F.lit("("), q, F.lit("(?:[^"), q, F.lit("]++|"), q, q, F.lit(")*+"), q, F.lit("(?="), d, F.lit("|\\z)|(?!"), q, F.lit(")[^"), d, F.lit("]*+)")
    )


def split_line(line: Column, o: Column) -> Column:
    """Struct ``(fields, broken)``: the fields with their quotes taken off, and whether the quoting is broken.

    A field that starts with the quote ends at the next single quote, which must stand before a delimiter or the end; a doubled
    quote inside it is one quote. In all other fields a quote is ordinary text. An empty line is one empty field. ``o`` is the dialect with its
    patterns (:func:`headers`).
    """
    delimiter, quote = o["delimiter"], o["quote"]
    text = F.concat(delimiter, line)
    raw = F.regexp_extract_all(text, o["field"], F.lit(1))
    covered = F.aggregate(raw, F.lit(0).cast("int"), lambda n, f: n + F.length(f) + 1)
    twice = F.concat(quote, quote)
    # A quoted field has a quote at both ends; one quote alone is never matched.
    bare = F.transform(raw, lambda f: F.when(F.startswith(f, quote), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), twice, quote)).otherwise(f))
    quoted = F.struct(bare.alias("fields"), (covered != F.length(text)).alias("broken"))
    plain = F.struct(F.split(line, o["at"], -1).alias("fields"), F.lit(False).alias("broken"))
    return F.when(line.isNotNull() & ~F.contains(line, quote), plain).otherwise(quoted)


def _literal(c: Column) -> Column:
    """A pattern for one character that needs no compiling: itself, or a backslash and itself unless it is a letter or digit."""
    return F.when(c.rlike(r"\A[0-9A-Za-z]\z"), c).when(c.rlike(r"\A[\x00-\x7f]\z"), F.concat(F.lit("\\"), c)).otherwise(_code_point(c))


#: Types whose values are any text, and whole numbers, which are read as 64 bits whatever their width.
TEXT_TYPES = ("", "string", "char", "point", "date", "localtime", "time", "localdatetime", "datetime", "duration")
WHOLE_TYPES = ("byte", "short", "int", "long")


#: How a value is checked: not at all, as a key, or as one of the kinds of values; 9: as a type that is unknown.
NO_CHECK, KEY, WHOLE, REAL, TRUTH, VECTOR, ARRAY, UNKNOWN = 0, 1, 2, 3, 4, 5, 6, 9


def _check_of(type_name: Column) -> Column:
    return F.when(type_name.isin(*TEXT_TYPES), NO_CHECK).when(type_name.isin(*WHOLE_TYPES), WHOLE).when(type_name.isin("float", "double"), REAL).when(type_name == "boolean", TRUTH).otherwise(UNKNOWN)


def check_of(kind: Column, type_name: Column) -> tuple[Column, Column]:
    """How the values of a header's column are checked, and the elements of its arrays: worked out once a column, not once a value."""
    own = F.when(type_name == "vector", VECTOR).when(F.endswith(type_name, F.lit("[]")), ARRAY).otherwise(_check_of(type_name))
    return F.when(kind == "Id", KEY).when(kind.isin("Property", "NamedEmbedding"), own).otherwise(NO_CHECK), _check_of(F.regexp_replace(type_name, r"\[\]\z", ""))


def scalar_ok(value: Column, check: Column) -> Column:
    """Whether one value is valid: whole numbers within 64 bits, decimal notation (so neither ``inf`` nor ``nan``), ``true`` or ``false``, any
    text for ``TEXT_TYPES``. No value is valid as another type."""
    return (
        F.when(check == NO_CHECK, F.lit(True))
        .when(check == WHOLE, value.try_cast("bigint").isNotNull() & value.rlike(INT))
        .when(check == REAL, value.rlike(FLOAT))
        .when(check == TRUTH, value.isin("true", "false") | value.rlike(BOOL))
        .otherwise(F.lit(False))
    )


def value_ok(value: Column, h: Column, o: Column) -> Column:
    """Whether ``value`` is valid as its header's type: a scalar, ``T[]`` or ``vector``."""
    vector = F.split(value, o["vector_at"], -1)
    return (
        F.when(h["check"] == VECTOR, ((F.size(vector) == h["dims"]) | h["dims"].isNull()) & F.forall(vector, lambda x: x.rlike(FLOAT)))
        .when(h["check"] == ARRAY, (h["of"] == NO_CHECK) | F.forall(F.split(value, o["array_at"], -1), lambda x: scalar_ok(x, h["of"])))
        .otherwise(scalar_ok(value, h["check"]))
    )


def headers(columns: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per source: its header in column order and the dialect of its run.

    Copies of a column or run count once (for repeats that differ, the largest); null options take the defaults ``,`` ``"`` ``;``
    and false.
    """
    one = columns.groupBy("source_id", "col_index").agg(
        F.max(F.struct("run_id", "target", "name", "kind", F.lower(F.trim(F.coalesce("value_type", F.lit("")))).alias("value_type"), F.coalesce("vector_dimensions", F.get(F.map_values(F.map_filter("options", lambda k, v: k == "dimensions")), F.lit(0)).try_cast("int")).alias("dims"), "id_space")).alias("c")
    )
    check, of = check_of(F.col("c.kind"), F.col("c.value_type"))
    one = one.withColumn("c", F.struct("c.*", check.alias("check"), of.alias("of")))
    head = one.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("col_index", "c"))).alias("h"), F.max("c.run_id").alias("run_id"), F.max("c.target").alias("target"))
    dialect = runs.groupBy("run_id").agg(
        F.max(
            F.struct(
                "started_at",
                F.coalesce("delimiter", F.lit(",")).alias("delimiter"),
                F.coalesce("quote", F.lit('"')).alias("quote"),
                F.coalesce("array_delimiter", F.lit(";")).alias("array_delimiter"),
                F.coalesce("vector_delimiter", F.lit(";")).alias("vector_delimiter"),
                F.coalesce("empty_strings_as_null", F.lit(False)).alias("empty_strings_as_null"),
            )
        ).alias("o")
    )
    o = F.col("o")
    patterns = [field_pattern(o["delimiter"], o["quote"]).alias("field"), _literal(o["delimiter"]).alias("at"), _literal(o["array_delimiter"]).alias("array_at"), _literal(o["vector_delimiter"]).alias("vector_at")]
    dialect = dialect.withColumn("o", F.struct("o.*", *patterns))
    return head.join(dialect, "run_id", "left").select("source_id", "run_id", "target", F.transform("h", lambda x: x["c"]).alias("header"), "o")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with the column ``name``, computed once a row: a filter on it is not moved below, where it would be computed for every use."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def read_lines(rows: DataFrame, columns: DataFrame, runs: DataFrame) -> DataFrame:
    """``rows`` (``import_rows``) with their fields and, for those that fail, the reason and the raw text.

    Adds ``run_id, target, header, started_at, fields, reason, _corrupt_record``. Reasons, first that holds: ``no_header`` (the
    source or its run is unknown), ``no_line`` (null text), ``quoting``, ``field_count``, ``empty_id``, ``invalid_value``; null for a
    valid line. Copies stay as they are, other columns of ``rows`` are left out. Headers are one row per source; they join by
    broadcast below Spark's size threshold and by shuffle, split where skewed, beyond it.
    """
    r = rows.select("source_id", "row_number", "raw_line", "read_at")
    j = r.join(headers(columns, runs), "source_id", "left")
    line = F.when(F.endswith("raw_line", F.lit("\r")), F.substring("raw_line", F.lit(1), F.length("raw_line") - 1)).otherwise(F.col("raw_line"))
    o = F.col("o")
    j = once(j, "_s", split_line(line, o))
    j = once(j, "_p", F.arrays_zip(F.col("_s.fields").alias("v"), F.col("header").alias("h")))
    pairs = F.col("_p")
    empty_id = F.exists(pairs, lambda x: (x["h"]["check"] == KEY) & (x["v"] == ""))
    bad = F.exists(pairs, lambda x: (x["h"]["check"] > KEY) & ~((x["v"] == "") & o["empty_strings_as_null"]) & ~value_ok(x["v"], x["h"], o))
    reason = (
        F.when(F.col("header").isNull() | o.isNull(), "no_header")
        .when(F.col("raw_line").isNull(), "no_line")
        .when(F.col("_s.broken"), "quoting")
        .when(F.size("_s.fields") != F.size("header"), "field_count")
        .when(empty_id, "empty_id")
        .when(bad, "invalid_value")
    )
    j = once(j, "reason", reason)
    return j.select(
        "source_id", "row_number", "read_at", "run_id", "target", "header", o["started_at"].alias("started_at"), o["array_delimiter"].alias("array_delimiter"), o["vector_delimiter"].alias("vector_delimiter"),
        o["empty_strings_as_null"].alias("empty_strings_as_null"), F.col("_s.fields").alias("fields"), "reason", F.when(F.col("reason").isNotNull(), F.col("raw_line")).alias("_corrupt_record"),
    )


def failed_lines(lines: DataFrame) -> DataFrame:
    """Each failing line once: ``source_id, row_number, reason, raw_line``. Copies are merged; if copies differ, any failure counts."""
    bad = lines.filter(F.col("reason").isNotNull())
    return bad.groupBy("source_id", "row_number").agg(F.min("reason").alias("reason"), F.min("_corrupt_record").alias("raw_line"))


def _first(kind: str) -> Column:
    return F.get(F.filter(F.arrays_zip(F.col("fields").alias("v"), F.col("header").alias("h")), lambda x: x["h"]["kind"] == kind), F.lit(0))["v"]


def _null_if_empty(c: Column) -> Column:
    return F.when((c == "") & F.col("empty_strings_as_null"), F.lit(None)).otherwise(c)


def loaded_records(lines: DataFrame) -> DataFrame:
    """The valid lines as nodes and relationships, each ``(source_id, row_number)`` once (copies: the one read last).

    Columns ``source_id, row_number, target, id, labels, start_id, end_id, rel_type, properties, embeddings``: properties maps name to
    text (null values left out, ``Ignore`` columns too), embeddings maps name to floats. Columns without a name go by ``col_<index>``;
    of columns that share a name the last counts. What a relationship refers to is not checked here, whatever
    ``skip_bad_relationships`` says.
    """
    ok = lines.filter(F.col("reason").isNull())
    latest = ok.groupBy("source_id", "row_number").agg(F.max(F.struct("read_at", "target", "header", "fields", "array_delimiter", "vector_delimiter", "empty_strings_as_null")).alias("x")).select("source_id", "row_number", "x.*")
    named = F.transform(F.arrays_zip(F.col("fields").alias("v"), F.col("header").alias("h")), lambda x, i: F.struct(F.when(F.coalesce(x["h"]["name"], F.lit("")) == "", F.concat(F.lit("col_"), i.cast("string"))).otherwise(x["h"]["name"]).alias("k"), _null_if_empty(x["v"]).alias("v"), x["h"]["kind"].alias("kind")))

    def picked(kind: str, of) -> Column:
        mine = F.filter(named, lambda x: (x["kind"] == kind) & x["v"].isNotNull())
        last = F.filter(mine, lambda x, i: ~F.exists(F.slice(mine, i + 2, F.size(mine)), lambda y: y["k"] == x["k"]))
        return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], of(x["v"]))))

    labels = _first("Label")
    return latest.select(
        "source_id", "row_number", "target",
        _first("Id").alias("id"),
        F.when(labels.isNotNull(), F.filter(F.split(labels, _code_point(F.col("array_delimiter")), -1), lambda x: x != "")).alias("labels"),
        _null_if_empty(_first("StartId")).alias("start_id"),
        _null_if_empty(_first("EndId")).alias("end_id"),
        _null_if_empty(_first("Type")).alias("rel_type"),
        picked("Property", lambda v: v).alias("properties"),
        picked("NamedEmbedding", lambda v: F.transform(F.split(v, _code_point(F.col("vector_delimiter")), -1), lambda e: F.trim(e).cast("float"))).alias("embeddings"),
    )


def import_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_lines(table(spark, sf_dir, "import_rows"), table(spark, sf_dir, "import_columns"), table(spark, sf_dir, "import_runs"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failed_lines(import_lines(spark, sf_dir)).select("source_id", "row_number")


def p4_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing lines by source and reason."""
    return failed_lines(import_lines(spark, sf_dir)).groupBy("source_id", "reason").agg(F.count("*").alias("n"))


def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded_records(import_lines(spark, sf_dir))


def p4_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was loaded of each source: records, their labels, ends and types, named values and numbers of embeddings."""
    r = loaded_records(import_lines(spark, sf_dir))
    return r.groupBy("source_id", "target").agg(
        F.count("*").alias("records"), F.count("id").alias("ids"), F.coalesce(F.sum(F.size("labels")), F.lit(0)).cast("long").alias("labels"), F.count("start_id").alias("starts"), F.count("end_id").alias("ends"), F.count_distinct("rel_type").alias("types"),
        F.sum(F.size("properties")).cast("long").alias("named"), F.sum(F.aggregate(F.map_values("properties"), F.lit(0), lambda n, v: n + F.length(v))).cast("long").alias("characters"), F.sum(F.size(F.flatten(F.map_values("embeddings")))).cast("long").alias("numbers"),
    )
