"""Table schemas as text cards."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "table string, ord int, name string, type string, nullable boolean, default string"
CONSTRAINTS = (
    "table string, kind string, columns array<string>, ref_table string, ref_columns array<string>"
)


def _joined(kind: str, line: Column) -> Column:
    """Lines of one kind of constraint, in a stable order."""
    return F.array_join(
        F.array_sort(F.collect_list(F.when(F.col("kind") == kind, line))), "\n"
    )


def table_cards(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    constraints: DataFrame | None = None,
    defaults: Mapping[tuple[str, str], str] | None = None,
    sample_rows: int = 0,
) -> DataFrame:
    """``(table, text)``: name, columns, keys and optional sample rows of each table.

    ``tables`` are frames of any source (``spark.read.jdbc``, parquet, ...); only their
    schemas and ``sample_rows`` rows of each are read.
    """
    defaults = defaults or {}
    fields = [
        (t, i, f.name, f.dataType.simpleString(), f.nullable, defaults.get((t, f.name)))
        for t, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    column = F.concat(
        F.lit("  - "),
        "name",
        F.lit(": "),
        "type",
        F.when(F.col("nullable"), " NULL").otherwise(" NOT NULL"),
        F.coalesce(F.concat(F.lit(" DEFAULT "), "default"), F.lit("")),
    )
    columns = (
        spark.createDataFrame(fields, COLUMNS)
        .groupBy("table")
        .agg(F.array_sort(F.collect_list(F.struct("ord", column.alias("line")))).alias("cols"))
        .withColumn("cols", F.array_join(F.transform("cols", lambda c: c["line"]), "\n"))
    )
    if constraints is None:
        constraints = spark.createDataFrame([], CONSTRAINTS)
    names = F.array_join("columns", ", ")
    foreign = F.concat(
        F.lit("  - ("), names, F.lit(") -> "), "ref_table",
        F.lit("("), F.array_join("ref_columns", ", "), F.lit(")"),
    )
    keys = constraints.groupBy("table").agg(
        _joined("primary", names).alias("pk"), _joined("foreign", foreign).alias("fks")
    )
    cards = columns.join(keys, "table", "left")
    if sample_rows > 0:
        shown = None
        for t, df in tables.items():
            rows = df.limit(sample_rows).select(
                F.lit(t).alias("table"), F.to_json(F.struct("*")).alias("row")
            )
            shown = rows if shown is None else shown.unionByName(rows)
        samples = shown.groupBy("table").agg(
            F.concat(
                F.lit("\nSample rows ("), F.count(F.lit(1)).cast("string"), F.lit("):\n  "),
                F.array_join(F.array_sort(F.collect_list("row")), "\n  "),
            ).alias("samples")
        )
        cards = cards.join(samples, "table", "left")
    else:
        cards = cards.withColumn("samples", F.lit(None).cast("string"))

    def block(head: str, body: str) -> Column:
        return F.when(F.length(body) > 0, F.concat(F.lit(head), body))

    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Table: "), "table"),
        F.lit(""),
        F.lit("Columns:"),
        "cols",
        block("\nPrimary Key: ", "pk"),
        block("\nForeign Keys:\n", "fks"),
        "samples",
    )
    return cards.select("table", text.alias("text"))
