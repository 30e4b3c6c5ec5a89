"""The permissive line reader against a character-by-character reader."""

import re

import pytest
from pyspark.sql import functions as F

from graphweft.sources import delimited


def brute_fields(line, d, q):
    """Fields and whether the quoting is broken, one character at a time."""
    out, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == q:
            i, field = i + 1, ""
            while True:
                if i >= n:
                    return out, True
                if line[i] == q:
                    if i + 1 < n and line[i + 1] == q:
                        field, i = field + q, i + 2
                        continue
                    i += 1
                    break
                field, i = field + line[i], i + 1
            if i < n and line[i] != d:
                return out, True
        else:
            j = line.find(d, i)
            j = n if j < 0 else j
            field, i = line[i:j], j
        out.append(field)
        if i >= n:
            return out, False
        i += 1


FLOAT = re.compile(r"\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*", re.A)


def brute_ok(v, t, dims, ad, vd):
    if t == "vector":
        parts = v.split(vd)
        return len(parts) == dims and all(FLOAT.fullmatch(x) for x in parts)
    if t.endswith("[]"):
        return all(brute_ok(x, t[:-2], dims, ad, vd) for x in v.split(ad))
    if t in ("byte", "short", "int", "long"):
        return bool(re.fullmatch(r"[+-]?[0-9]+", v)) and -(2**63) <= int(v) < 2**63
    if t in ("float", "double"):
        return bool(FLOAT.fullmatch(v))
    if t == "boolean":
        return v.strip() in ("true", "false")
    return t in ("", "string", "date", "char", "point", "duration")


def brute_reason(line, header, o):
    if line is None:
        return "no_line"
    if line.endswith("\r"):
        line = line[:-1]
    fields, broken = brute_fields(line, o["delimiter"], o["quote"])
    if broken:
        return "quoting"
    if len(fields) != len(header):
        return "field_count"
    if any(k == "Id" and v == "" for v, (k, _, _) in zip(fields, header)):
        return "empty_id"
    for v, (k, t, dims) in zip(fields, header):
        if k in ("Property", "NamedEmbedding") and not (v == "" and o["empty"]) and not brute_ok(v, t, dims, o["array"], o["vector"]):
            return "invalid_value"
    return None


def fixture(spark, lines, header, delimiter=",", quote='"', empty=True):
    rows = spark.createDataFrame([("r/s", i + 2, x, None, "clash") for i, x in enumerate(lines)], "source_id string, row_number long, raw_line string, read_at timestamp, header string")
    cols = spark.createDataFrame([("r/s", "r", "node", i, n, k, t, None, d, {}) for i, (n, k, t, d) in enumerate(header)], "source_id string, run_id string, target string, col_index int, name string, kind string, value_type string, id_space string, vector_dimensions int, options map<string,string>")
    runs = spark.createDataFrame([("r", None, delimiter, quote, ";", ":", empty)], "run_id string, started_at timestamp, delimiter string, quote string, array_delimiter string, vector_delimiter string, empty_strings_as_null boolean")
    return rows, cols, runs


HEADER = [("id", "Id", "", None), ("n", "Property", "long", None), ("f", "Property", "float[]", None), ("v", "Property", "vector", 2), ("s", "Property", "string", None)]
LINES = [
    "a,1,1;2,0.5:1,x", 'a,1,1;2,0.5:1,"x,y ""z"""', 'a,1,1,0.5:1,"x"y', 'a,1,1,0.5:1,"x', "a,1,1,0.5:1", "a,1,1,0.5:1,x,y", ",1,1,0.5:1,x", "a,1.0,1,0.5:1,x", "a,9223372036854775808,1,0.5:1,x", "a,-9223372036854775808,1e3; 2 ,0.5:1,x",
    "a,,,,", "a,+7,nan,0.5:1,x", "a,1,1,0.5,x", "a,1,1;,0.5:1,x", 'a,1,1,0.5:1,x "y" z', 'a,1,1,0.5:1,""', 'a,1,1,0.5:1,"""', 'a,1,1,0.5:1,""""', "a,1,1,0.5:1,x\r", "a,1,1,0.5:1,x\ny", 'a,1,1,0.5:1,"x\ny"', "a, 1,1,0.5:1,x", "", None,
    "a,1,1,0.5:1,$^\\E|.", '"a",1,1,0.5:1,x', '"",1,1,0.5:1,x', "a,1,.5;5.,1e-2:+1,x", "a,1,0x1,0.5:1,x", "a,00000000000000000000012,1,0.5:1,x", "a,1,1,0.5:1,ü\U0001d504",
]


@pytest.mark.parametrize("empty", [True, False])
@pytest.mark.parametrize(("d", "q"), [(",", '"'), ("|", "'"), ("\t", '"'), (";", "'")])
def test_reasons_against_brute_force(spark, d, q, empty):
    array = "/" if d == ";" else ";"
    lines = [None if x is None else x.replace(";", "\0").replace(",", d).replace('"', q).replace("\0", array) for x in LINES]
    rows, cols, runs = fixture(spark, lines, HEADER, d, q, empty)
    runs = runs.withColumn("array_delimiter", F.lit(array))
    got = {r.row_number: r.reason for r in delimited.read_lines(rows, cols, runs).collect()}
    o = {"delimiter": d, "quote": q, "array": array, "vector": ":", "empty": empty}
    header = [(k, t, dims) for _, k, t, dims in HEADER]
    assert got == {i + 2: brute_reason(x, header, o) for i, x in enumerate(lines)}


def test_every_type(spark):
    values = ["1", "-1", "abc", "300", "70000", "9223372036854775807", "9223372036854775808", "inf", "NaN", "1.5", " 1.5 ", "true", " true", "TRUE", "a b", "1;2", "1;x", "true;false", ";"]
    types = ["byte", "short", "int", "long", "float", "double", "boolean", "string", "char", "date", "point", "duration", "unknown", "byte[]", "short[]", "boolean[]", "string[]", "unknown[]", "float[]"]
    for t in types:
        header = [("x", "Property", t, None)]
        rows, cols, runs = fixture(spark, values, header, delimiter="|")
        got = [r.reason for r in delimited.read_lines(rows, cols, runs).orderBy("row_number").collect()]
        o = {"delimiter": "|", "quote": '"', "array": ";", "vector": ":", "empty": True}
        assert got == [brute_reason(v, [x[1:] for x in header], o) for v in values], t


def test_whole_table_against_brute_force(spark, sf):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    runs = {r.run_id: r for r in t("import_runs").collect()}
    heads = {}
    for r in t("import_columns").collect():
        heads.setdefault(r.source_id, {})[r.col_index] = (r.run_id, r.kind, (r.value_type or "").lower(), r.vector_dimensions)
    want = set()
    for r in t("import_rows").collect():
        h = [heads[r.source_id][i] for i in sorted(heads[r.source_id])]
        run = runs[h[0][0]]
        o = {"delimiter": run.delimiter, "quote": run.quote, "array": run.array_delimiter, "vector": run.vector_delimiter, "empty": run.empty_strings_as_null}
        if brute_reason(r.raw_line, [x[1:] for x in h], o):
            want.add((r.source_id, r.row_number))
    assert {tuple(x) for x in delimited.p4_found(spark, sf).collect()} == want


def test_valid_lines_load_and_failures_do_not(spark):
    rows, cols, runs = fixture(spark, [*LINES, LINES[0]], HEADER)
    lines = delimited.read_lines(rows.unionByName(rows), cols, runs)
    loaded = {r.row_number: r for r in delimited.loaded_records(lines).collect()}
    bad = {r.row_number: r for r in delimited.failed_lines(lines).collect()}
    assert not loaded.keys() & bad.keys() and len(loaded) + len(bad) == len(LINES) + 1
    assert loaded[3].id == "a" and loaded[3].properties["s"] == 'x,y "z"'
    assert loaded[12].properties == {} and bad[4].raw_line == LINES[2]


def test_empty_tables_and_unknown_source(spark):
    rows, cols, runs = fixture(spark, ["a"], HEADER)
    assert delimited.read_lines(rows.limit(0), cols, runs).count() == 0
    assert [r.reason for r in delimited.read_lines(rows, cols.limit(0), runs).collect()] == ["no_header"]


def test_very_long_lines(spark):
    long = "x" * 300_000
    lines = [f'a,1,1,0.5:1,"{long}""{long}"', f'a,1,1,0.5:1,"{long}', "a,1,1,0.5:1," + '""' * 50_000, 'a,1,1,0.5:1,"' + '""' * 50_000, "a" + ",1" * 50_000]
    rows, cols, runs = fixture(spark, lines, HEADER)
    got = [r.reason for r in delimited.read_lines(rows, cols, runs).orderBy("row_number").select("reason").collect()]
    o = {"delimiter": ",", "quote": '"', "array": ";", "vector": ":", "empty": True}
    assert got == [brute_reason(x, [(k, t, dims) for _, k, t, dims in HEADER], o) for x in lines] == [None, "quoting", None, "quoting", "field_count"]
