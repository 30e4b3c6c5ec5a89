"""Graph files: header CSV (plain, GZIP, ZIP) in and out, JSON in, snapshots."""

from __future__ import annotations

import io
import json
import os
import zipfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.plans.catalog import GraphCatalog
from graphweft.session import cut
from graphweft.sources.delimited import TEXT_TYPES, check_of, value_ok

#: Kinds by header word, Spark types by value type.
KINDS = {"ID": "Id", "LABEL": "Label", "IGNORE": "Ignore", "START_ID": "StartId", "END_ID": "EndId", "TYPE": "Type"}
SPARK = {"byte": "bigint", "short": "bigint", "int": "bigint", "long": "bigint", "float": "double", "double": "double", "boolean": "boolean"}


@dataclass(frozen=True)
class HeaderColumn:
    name: str
    kind: str
    value_type: str = "string"
    id_space: str | None = None
    dimensions: int | None = None


def parse_header(fields: list[str], target: str) -> list[HeaderColumn]:
    """``name:type{options}``, ``:ID(space)``, ``:LABEL`` ... of a ``node`` or ``relationship`` file; checks that the keys are there."""
    import re

    out = []
    for f in fields:
        name, _, kind = f.partition(":")
        m = re.fullmatch(r"([A-Za-z_]+)(?:\(([^)]*)\))?(\[\])?(?:\{([^}]*)\})?", kind.strip() or "string")
        if not m:
            raise ValueError(f"header field {f!r} cannot be read")
        word, space, many, options = m.groups()
        opts = dict(p.split(":", 1) for p in (options or "").replace(" ", "").split(",") if ":" in p)
        dims = int(opts["dimensions"]) if "dimensions" in opts else None
        if word.upper() in KINDS and word == word.upper():
            out.append(HeaderColumn(name.strip(), KINDS[word], "", space or None))
        else:
            if word.lower() not in (*TEXT_TYPES, *SPARK, "vector"):
                raise ValueError(f"header field {f!r} has an unknown type")
            out.append(HeaderColumn(name.strip(), "NamedEmbedding" if opts.get("embedding") == "true" else "Property", word.lower() + (many or ""), None, dims))
    kinds = [c.kind for c in out]
    need = ["Id"] if target == "node" else ["StartId", "EndId"]
    for k in need:
        if kinds.count(k) != 1:
            raise ValueError(f"a {target} header needs exactly one {k} column")
    return out


def read_text(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"') -> DataFrame:
    """The fields of a file or folder as strings ``_c0 ..``; ZIP members are unpacked on the executors, GZIP is read by Spark."""
    options = {"sep": delimiter, "quote": quote, "escape": quote, "multiLine": True, "nullValue": "\u0000"}
    if path.endswith(".zip"):

        def unpack(rows):
            for r in rows:
                with zipfile.ZipFile(io.BytesIO(r["content"])) as z:
                    for m in sorted(z.namelist()):
                        with z.open(m) as member:  # line by line: only the archive itself is held
                            yield from (line.rstrip("\r\n") for line in io.TextIOWrapper(member, "utf-8", newline="\n"))

        lines = spark.read.format("binaryFile").load(path).rdd.flatMap(lambda r: unpack([r]))
        return spark.read.options(**(options | {"multiLine": False})).csv(lines)
    return spark.read.options(**options).csv(path)


def typed(c: Column, h: HeaderColumn, array_delimiter: str = ";", vector_delimiter: str = ";") -> Column:
    if h.value_type == "vector":
        return F.transform(F.split(c, f"\\Q{vector_delimiter}\\E"), lambda x: F.trim(x).try_cast("float"))
    base = h.value_type.removesuffix("[]")
    to = SPARK.get(base, "string")
    if h.value_type.endswith("[]"):
        return F.transform(F.split(c, f"\\Q{array_delimiter}\\E"), lambda x: x.try_cast(to))
    return c.try_cast(to) if to != "string" else c


def _check_values(df: DataFrame, cols: list[HeaderColumn], path: str, empty_as_null: bool, array_delimiter: str, vector_delimiter: str) -> None:
    """Raise if a value is not valid as its header's type."""
    o = F.struct(F.lit(f"\\Q{array_delimiter}\\E").alias("array_at"), F.lit(f"\\Q{vector_delimiter}\\E").alias("vector_at"))
    bad = F.lit(False)
    for i, c in enumerate(cols):
        if c.kind in ("Property", "NamedEmbedding") and c.value_type.removesuffix("[]") not in TEXT_TYPES:
            check, of = check_of(F.lit(c.kind), F.lit(c.value_type))
            h = F.struct(check.alias("check"), of.alias("of"), F.lit(c.dimensions).cast("int").alias("dims"))
            v = _value(i, empty_as_null)
            bad = bad | (v.isNotNull() & ~value_ok(v, h, o))
    n = df.filter(bad).count()
    if n:
        raise ValueError(f"{n} rows of {path} have a value that is invalid as its type")


def import_graph(spark: SparkSession, node_files: list[str], rel_files: list[str], delimiter: str = ",", quote: str = '"', array_delimiter: str = ";", vector_delimiter: str = ";", empty_as_null: bool = False, skip_bad_relationships: bool = True, tolerance: int = 1000) -> tuple[GraphCatalog, dict]:
    """A graph from header CSV files, and a report of what was read and how many relationships had a missing end.

    The first line of each file is its header. Nodes with the same set of labels are one table, those without a label are ``Node``; more than 1,000
    sets, or types of relationships, in one file are an error. So are a value that is invalid as its type, a relationship without a type, and
    more relationships with a missing end than the tolerance, or any when they are not skipped.
    """
    cat = GraphCatalog.empty(spark)
    all_ids = None
    for path in node_files:
        raw = read_text(spark, path, delimiter, quote)
        head = [x or "" for x in raw.first()]
        cols = parse_header(head, "node")
        df = raw.filter(~_is_header(raw, head))
        id_at = next(i for i, c in enumerate(cols) if c.kind == "Id")
        space = cols[id_at].id_space or ""
        label_at = next((i for i, c in enumerate(cols) if c.kind == "Label"), None)
        out = [F.concat(F.lit(f"{space}/" if space else ""), F.col(f"_c{id_at}")).alias("_id")]
        out += [typed(_value(i, empty_as_null), c, array_delimiter, vector_delimiter).alias(c.name or f"col_{i}") for i, c in enumerate(cols) if c.kind in ("Property", "NamedEmbedding")]
        if cols[id_at].name:
            out.append(F.col(f"_c{id_at}").alias(cols[id_at].name))
        labels = F.filter(F.split(F.col(f"_c{label_at}"), f"\\Q{array_delimiter}\\E"), lambda x: x != "") if label_at is not None else F.array().cast("array<string>")
        _check_values(df, cols, path, empty_as_null, array_delimiter, vector_delimiter)
        df = df.select(*out, F.array_sort(F.array_distinct(F.coalesce(labels, F.array().cast("array<string>")))).alias("_set"))
        all_ids = df.select("_id") if all_ids is None else all_ids.unionByName(df.select("_id"))
        sets = [tuple(r[0]) for r in df.select("_set").distinct().limit(1001).collect()]
        if len(sets) > 1000:
            raise ValueError("more than 1,000 label sets in one file")
        for own in sorted(sets):
            cat.add_nodes(own or ("Node",), df.filter(F.col("_set") == F.array(*map(F.lit, own)).cast("array<string>")).drop("_set"))
    bad, read = 0, 0
    for path in rel_files:
        raw = read_text(spark, path, delimiter, quote)
        head = [x or "" for x in raw.first()]
        cols = parse_header(head, "relationship")
        df = raw.filter(~_is_header(raw, head))
        at = {k: next((i for i, c in enumerate(cols) if c.kind == k), None) for k in ("StartId", "EndId", "Type")}

        def end(k):
            space = cols[at[k]].id_space
            return F.concat(F.lit(f"{space}/" if space else ""), F.col(f"_c{at[k]}"))

        props = [typed(_value(i, empty_as_null), c, array_delimiter, vector_delimiter).alias(c.name or f"col_{i}") for i, c in enumerate(cols) if c.kind == "Property"]
        if at["Type"] is None:
            raise ValueError("a relationship header needs a Type column")
        _check_values(df, cols, path, empty_as_null, array_delimiter, vector_delimiter)
        kind = F.col(f"_c{at['Type']}")
        df = df.select(F.uuid().alias("_rid"), end("StartId").alias("_src"), end("EndId").alias("_dst"), kind.alias("_kind"), *props)
        df = cut(df)
        if not df.filter(F.coalesce(F.col("_kind"), F.lit("")) == "").isEmpty():
            raise ValueError(f"a relationship of {path} has no type")
        ids = all_ids.distinct()
        good = df.join(ids.withColumnRenamed("_id", "_src"), "_src", "left_semi").join(ids.withColumnRenamed("_id", "_dst"), "_dst", "left_semi")
        n, g = df.count(), good.count()
        read, bad = read + g, bad + n - g
        names = [r[0] for r in good.select("_kind").distinct().limit(1001).collect()]
        if len(names) > 1000:
            raise ValueError("more than 1,000 types in one file")
        for t in sorted(names):
            cat.add_rels(t, good.filter(F.col("_kind") == t).drop("_kind"), id="_rid")
    if bad and (not skip_bad_relationships or bad > tolerance):
        raise ValueError(f"{bad} relationships have a missing end")
    return cat, {"relationships_imported": read, "bad_relationships": bad}


def preflight(spark: SparkSession, files: list[tuple[str, str]], delimiter: str = ",", quote: str = '"') -> DataFrame:
    """``path, target, ok, columns, error`` of ``(path, target)`` files; reads their headers only."""
    rows = []
    for path, target in files:
        try:
            head = [x or "" for x in read_text(spark, path, delimiter, quote).first()]
            rows.append((path, target, True, len(parse_header(head, target)), None))
        except Exception as e:  # noqa: BLE001
            rows.append((path, target, False, 0, str(e).splitlines()[0][:200]))
    return spark.createDataFrame(rows, "path string, target string, ok boolean, columns int, error string")


def _value(i: int, empty_as_null: bool) -> Column:
    c = F.col(f"_c{i}")
    return F.when(c != "", c) if empty_as_null else c


def _is_header(raw: DataFrame, head: list[str]) -> Column:
    same = F.lit(True)
    for i, h in enumerate(head):
        same = same & F.coalesce(F.col(f"_c{i}"), F.lit("")).eqNullSafe(F.lit(h))
    return same


def export_graph(cat: GraphCatalog, folder: str, array_delimiter: str = ";") -> dict:
    """Header CSV of every table and ``schema.json``; arrays are joined by the delimiter. Gives the folder of each table."""
    done = {}

    def text(df: DataFrame, c: str) -> Column:
        kind = dict(df.dtypes)[c]
        return F.concat_ws(array_delimiter, F.transform(F.col(f"`{c}`"), lambda x: x.cast("string"))) if kind.startswith("array") else F.col(f"`{c}`").cast("string")

    def header(kind: str) -> str:
        base = {"bigint": "long", "int": "int", "double": "double", "float": "float", "boolean": "boolean"}
        return base.get(kind, base.get(kind[6:-1], "string") + "[]" if kind.startswith("array") else "string")

    for t in cat.nodes:
        props = [p for p in t.properties if p != t.id]
        kinds = dict(t.df.dtypes)
        out = t.df.select(F.col(t.id).cast("string").alias(":ID"), F.lit(array_delimiter.join(t.labels)).alias(":LABEL"), *[text(t.df, p).alias(f"{p}:{header(kinds[p])}") for p in props])
        done["nodes-" + "-".join(t.labels)] = out
    for k, r in enumerate(cat.rels):
        kinds = dict(r.df.dtypes)
        props = [p for p in r.properties if p not in (r.src, r.dst)]
        out = r.df.select(F.col(r.src).cast("string").alias(":START_ID"), F.col(r.dst).cast("string").alias(":END_ID"), F.lit(r.type).alias(":TYPE"), *[text(r.df, p).alias(f"{p}:{header(kinds[p])}") for p in props])
        done[f"rels-{k}-{r.type}"] = out
    paths = {}
    for name, df in done.items():
        paths[name] = os.path.join(folder, name)
        df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(paths[name])
    schema = {"nodes": [{"labels": t.labels, "properties": t.properties} for t in cat.nodes], "relationships": [{"type": r.type, "properties": r.properties} for r in cat.rels], "constraints": {k: str(v) for k, v in cat.constraints.items()}}
    cat.spark.createDataFrame([(json.dumps(schema),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(folder, "schema"))
    return paths


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """A root array as rows, an object as one row."""
    return spark.read.option("multiLine", True).json(path)


def import_json(spark: SparkSession, path: str) -> GraphCatalog:
    """``{nodes: [{id, labels, properties}], relationships: [{id, startNode, endNode, type, properties}]}``."""
    df = spark.read.option("multiLine", True).json(path)
    cat = GraphCatalog.empty(spark)
    nodes = df.select(F.explode("nodes").alias("n")).select("n.*")
    keys = nodes.select(F.array_sort("labels").alias("l")).distinct().limit(1001).collect()
    if len(keys) > 1000:
        raise ValueError("more than 1,000 label sets")
    for r in keys:
        mine = nodes.filter(F.array_sort("labels").eqNullSafe(F.array(*map(F.lit, r["l"])).cast("array<string>")))
        cat.add_nodes(tuple(r["l"]), mine.select(F.col("id").cast("string").alias("_id"), "properties.*"))
    rels = df.select(F.explode("relationships").alias("r")).select("r.*")
    types = rels.select("type").distinct().limit(1001).collect()
    if len(types) > 1000:
        raise ValueError("more than 1,000 relationship types")
    if any(r["type"] is None for r in types):
        raise ValueError("a relationship without type")
    for r in types:
        mine = rels.filter(F.col("type") == r["type"])
        props = ["properties.*"] if "properties" in mine.columns and mine.schema["properties"].dataType.typeName() == "struct" else []
        cat.add_rels(r["type"], mine.select(F.col("id").cast("string").alias("_rid"), F.col("startNode").cast("string").alias("_src"), F.col("endNode").cast("string").alias("_dst"), *props), id="_rid")
    return cat


def write_snapshot(cat: GraphCatalog, folder: str) -> None:
    """Every table as parquet, and a manifest."""
    man: dict = {"unique_ids": cat.unique_ids, "nodes": [], "rels": []}
    for k, t in enumerate(cat.nodes):
        t.df.write.mode("overwrite").parquet(f"{folder}/node-{k}")
        man["nodes"].append({"labels": t.labels, "id": t.id})
    for k, r in enumerate(cat.rels):
        r.df.write.mode("overwrite").parquet(f"{folder}/rel-{k}")
        man["rels"].append({"type": r.type, "src": r.src, "dst": r.dst, "src_labels": r.src_labels, "dst_labels": r.dst_labels, "id": r.id, "trusted": r.trusted})
    cat.spark.createDataFrame([(json.dumps(man),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def read_snapshot(spark: SparkSession, folder: str) -> GraphCatalog:
    man = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    cat = GraphCatalog(spark, unique_ids=man["unique_ids"])
    for k, t in enumerate(man["nodes"]):
        cat.add_nodes(tuple(t["labels"]), spark.read.parquet(f"{folder}/node-{k}"), t["id"])
    for k, r in enumerate(man["rels"]):
        cat.add_rels(r["type"], spark.read.parquet(f"{folder}/rel-{k}"), r["src"], r["dst"], r["src_labels"], r["dst_labels"], r["id"], r["trusted"])
    return cat
