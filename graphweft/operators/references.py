"""References to nodes that do not live at the time of the row.

The references of every table become one narrow frame ``(tbl, row_id, ref_column, key, t)``. They are pre-aggregated per key and
period; keys with more rows than one ten-thousandth of all references (so at most 10,000 keys, however large the tables) are heavy:
their lives are broadcast, if their number allows it, and their rows never shuffled. The remaining keys, none of them hot, are anti-joined by
shuffle, and both results are united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.session import BROADCAST_ROWS, checked_broadcast, cut, micros, month_of_micros, table
from graphweft.sources.delimited import import_lines

#: A key is heavy above this many rows and above ``1 / HEAVY_SHARE`` of all references.
HEAVY_ROWS, HEAVY_SHARE = 20_000, 10_000


def references(df: DataFrame, tbl: str, row_id: Column, t: Column, columns: dict[str, Column]) -> DataFrame:
    """The references of one table; null and empty keys and rows without a time are none. One pass over the table."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("ref_column"), c.alias("key")) for k, c in columns.items()]))
    out = df.select(row_id.alias("row_id"), t.alias("t"), each.alias("r"))
    return out.select(F.lit(tbl).alias("tbl"), "row_id", "r.ref_column", "r.key", "t").filter((F.col("key") != "") & F.col("t").isNotNull())


def lives(nodes: DataFrame) -> DataFrame:
    """One row per life ``[born, dead)`` of an id in microseconds; ``dead`` is null while it lives. Copies stay."""
    n = nodes.filter(F.col("id").isNotNull() & F.col("created_at_unix_ms").isNotNull())
    return n.select(F.col("id").alias("key"), (F.col("created_at_unix_ms") * 1000).alias("born"), (F.col("deleted_at_unix_ms") * 1000).alias("dead"))


def orphans(refs: DataFrame, nodes: DataFrame, total: int, heavy_rows: int = HEAVY_ROWS, most_lives: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``refs`` whose key has no life at ``t``: ``tbl, row_id, ref_column, key, t``; copies are kept.

    ``total`` is an upper bound of the references (table counts, which parquet holds in its footers). Lives of heavy keys are broadcast up to ``most_lives``
    rows; beyond that the heavy keys join by shuffle as well, where skewed partitions are split.
    """
    refs = refs.select("tbl", "row_id", "ref_column", "key", "t")
    at_least = max(heavy_rows, total // HEAVY_SHARE)
    per_period = refs.groupBy("key", month_of_micros(F.col("t")).alias("period")).agg(F.count("*").alias("n"))
    heavy = per_period.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > at_least).select("key")
    heavy = cut(heavy)  # at most HEAVY_SHARE keys
    lived = lives(nodes)

    def dead(r: DataFrame, of: DataFrame) -> DataFrame:
        of = of.withColumnRenamed("key", "own")
        alive = (F.col("born") <= F.col("t")) & (F.col("dead").isNull() | (F.col("t") < F.col("dead")))
        return r.join(of, (F.col("key") == F.col("own")) & alive, "left_anti").select("tbl", "row_id", "ref_column", "key", "t")

    if heavy.isEmpty():
        return dead(refs, lived)
    hot_lives = cut(lived.join(F.broadcast(heavy), "key", "left_semi").distinct())
    hot = dead(refs.join(F.broadcast(heavy), "key", "left_semi"), checked_broadcast(hot_lives, most_lives))
    return hot.unionByName(dead(refs.join(F.broadcast(heavy), "key", "left_anti"), lived))


def reasons(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """``found`` with ``why``: the key is ``missing`` altogether, its first life comes ``later``, or the one before ``t`` was ``deleted``."""
    first = lives(nodes).groupBy(F.col("key").alias("own")).agg(F.min("born").alias("born"))
    why = F.when(F.col("born").isNull(), "missing").when(F.col("born") > F.col("t"), "later").otherwise("deleted")
    return found.join(first, F.col("key") == F.col("own"), "left").withColumn("why", why).drop("own", "born")


def import_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of valid relationship lines, at the start of their run; the row is ``source_id#row_number``."""
    lines = import_lines(spark, sf_dir).filter(F.col("reason").isNull())
    zipped = F.arrays_zip(F.col("fields").alias("v"), F.col("header").alias("h"))
    ends = F.filter(zipped, lambda x: x["h"]["kind"].isin("StartId", "EndId"))
    out = lines.select(F.concat("source_id", F.lit("#"), F.col("row_number").cast("string")).alias("row_id"), micros(F.col("started_at")).alias("t"), F.explode(ends).alias("e"))
    kind = F.when(F.col("e.h.kind") == "StartId", "start_id").otherwise("end_id")
    out = out.select(F.lit("import_rows").alias("tbl"), "row_id", kind.alias("ref_column"), F.col("e.v").alias("key"), "t")
    return out.filter((F.col("key") != "") & F.col("t").isNotNull())


def table_references(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> tuple[DataFrame, int]:
    """The references of the named tables and an upper bound of their number."""
    parts: list[DataFrame] = []
    total = 0
    for name in names:
        df = table(spark, sf_dir, name)
        c = F.col
        if name == "edges":
            parts.append(references(df, name, c("id"), c("created_at_unix_ms") * 1000, {"start_node": c("start_node"), "end_node": c("end_node")}))
        elif name == "vector_entries":
            parts.append(references(df, name, c("entry_id"), micros(c("updated_at")), {"id": c("id")}))
        elif name == "edge_suggestions":
            parts.append(references(df, name, c("suggestion_id"), micros(c("suggested_at")), {"source_id": c("source_id"), "target_id": c("target_id")}))
        elif name == "import_rows":
            parts.append(cut(import_references(spark, sf_dir)))  # parsed once, read in every pass
        total += 2 * df.count()
    refs = parts[0]
    for p in parts[1:]:
        refs = refs.unionByName(p)
    return refs, total


ALL_TABLES = ("edges", "vector_entries", "edge_suggestions", "import_rows")


def orphan_references(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ALL_TABLES) -> DataFrame:
    """Each orphan reference once: ``tbl, row_id, ref_column, key, t``. Of copies with different times or keys the smallest stands."""
    refs, total = table_references(spark, sf_dir, names)
    found = orphans(refs, table(spark, sf_dir, "nodes"), total)
    return found.groupBy("tbl", "row_id", "ref_column").agg(F.min(F.struct("t", "key")).alias("x")).select("tbl", "row_id", "ref_column", "x.key", "x.t")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(spark, sf_dir).select("tbl", "row_id", "ref_column")


def p2_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, column and month."""
    return orphan_references(spark, sf_dir).groupBy("tbl", "ref_column", month_of_micros(F.col("t")).alias("month")).agg(F.count("*").alias("orphans"))


def p2_edges_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for edges and suggestions alone, which SQL can check."""
    return orphan_references(spark, sf_dir, ("edges", "edge_suggestions")).groupBy("tbl", "ref_column", month_of_micros(F.col("t")).alias("month")).agg(F.count("*").alias("orphans"))


def p2_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, month and why the node does not live: missing, later or deleted."""
    found = reasons(orphan_references(spark, sf_dir), table(spark, sf_dir, "nodes"))
    return found.groupBy("tbl", month_of_micros(F.col("t")).alias("month"), "why").agg(F.count("*").alias("orphans"))


def p2_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: relationship lines with an orphan end, the reported ``bad_relationships`` and whether the tolerance holds.

    Every run stands once (of copies the largest); runs without orphans count 0; without a tolerance none is exceeded.
    """
    found = orphan_references(spark, sf_dir, ("import_rows",))
    source = F.regexp_replace(F.col("row_id"), r"#[0-9]+\z", "")
    runs_of = table(spark, sf_dir, "import_columns").select("source_id", "run_id").distinct()
    per_run = found.select(source.alias("source_id"), "row_id").distinct().join(runs_of, "source_id").groupBy("run_id").agg(F.count("*").alias("n"))
    runs = table(spark, sf_dir, "import_runs").groupBy("run_id").agg(F.max(F.struct("started_at", "bad_relationships", "bad_relationship_tolerance")).alias("r"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return runs.join(per_run, "run_id", "left").select(
        "run_id", n.alias("orphan_lines"), F.col("r.bad_relationships").alias("reported"), F.col("r.bad_relationship_tolerance").alias("tolerance"),
        F.coalesce(n <= F.col("r.bad_relationship_tolerance"), F.lit(True)).alias("within"),
    )
