"""Value frequencies, distinct counts, modes and whole-row duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import as_text, clean_value, ref, small_frame

# Fingerprints that may be collected and broadcast (8 bytes each).
BROADCAST_FINGERPRINTS = 250_000
FINGERPRINT = "__fingerprint"


def frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_index, column, value, n) for every distinct non-null value, as text.

    One scan feeds all columns; equal values are counted before the shuffle,
    so a value held by a third of the rows costs one row per task.
    """
    shape = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("column_index"),
                        F.lit(c).alias("column"),
                        as_text(df, c).alias("value"),
                    )
                    for i, c in enumerate(columns)
                ]
            )
        ).alias("cell")
    ).select("cell.*")
    return (
        shape.where(F.col("value").isNotNull())
        .groupBy("column_index", "column", "value")
        .agg(F.count("*").alias("n"))
    )


def distinct_counts(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """(column_index, column, unique_count); columns without values count 0."""
    names = small_frame(
        df.sparkSession, list(enumerate(columns)), "column_index int, column string"
    )
    if exact:
        # Values are told apart by 128 bits of hashes, so long texts never leave their task.
        cells = [
            F.struct(
                F.lit(i).alias("column_index"),
                F.xxhash64(as_text(df, c)).alias("h"),
                F.xxhash64(F.lit(1), as_text(df, c)).alias("g"),
                as_text(df, c).isNotNull().alias("present"),
            )
            for i, c in enumerate(columns)
        ]
        keys = df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*").where("present")
        counted = (
            keys.groupBy("column_index", "h", "g")
            .agg(F.count("*").alias("n"))
            .groupBy("column_index")
            .agg(F.count("*").alias("unique_count"))
        )
    else:
        wide = df.agg(
            *[
                F.approx_count_distinct(clean_value(df, c)).alias(f"d{i}")
                for i, c in enumerate(columns)
            ]
        )
        counted = wide.select(
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(i).alias("column_index"), F.col(f"d{i}").alias("unique_count")
                        )
                        for i in range(len(columns))
                    ]
                )
            ).alias("c")
        ).select("c.*")
    # Both sides hold one row per column.
    return names.join(counted, "column_index", "left").select(
        "column_index",
        "column",
        F.coalesce("unique_count", F.lit(0)).cast("bigint").alias("unique_count"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) per non-null value, in the column's own type."""
    return (
        df.select(clean_value(df, column).alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.count("*").alias("n"))
    )


def mode(df: DataFrame, column: str):
    """Most frequent value (smallest on ties), or None. Never buffers the values."""
    row = value_counts(df, column).orderBy(F.desc("n"), F.asc("value")).first()
    return None if row is None else row["value"]


def modes(df: DataFrame, columns: list[str]) -> dict:
    """Most frequent value of each column (smallest on ties), or None, in the column's own type.

    One scan and one count of (column, value) for all columns; what reaches the driver is one row
    per column. Columns of one type share a field of the counted key.
    """
    if not columns:
        return {}
    types = {df.schema[c].dataType.json(): df.schema[c].dataType for c in columns}
    field = {kind: f"v{k}" for k, kind in enumerate(types)}
    own = {c: field[df.schema[c].dataType.json()] for c in columns}
    cells = [
        F.struct(
            F.lit(i).alias("column_index"),
            *[
                (clean_value(df, c) if own[c] == field[kind] else F.lit(None)).cast(dtype).alias(field[kind])
                for kind, dtype in types.items()
            ],
        )
        for i, c in enumerate(columns)
    ]
    values = df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
    values = values.where(" OR ".join(f"{v} IS NOT NULL" for v in field.values()))
    counted = values.groupBy("column_index", *field.values()).agg(F.count("*").alias("n"))
    best = counted.groupBy("column_index").agg(
        F.min(F.struct((-F.col("n")).alias("rank"), *field.values())).alias("best")
    )
    found = {r["column_index"]: r["best"] for r in best.collect()}
    return {c: found[i][own[c]] if i in found else None for i, c in enumerate(columns)}


def _marked(df: DataFrame) -> DataFrame:
    """The rows with an 8-byte fingerprint of all their cells."""
    cells = [clean_value(df, c) for c in df.columns]
    return df.select(
        F.xxhash64(*cells).alias(FINGERPRINT), *[v.alias(c) for v, c in zip(cells, df.columns)]
    )


def _repeated(marked: DataFrame, limit: int) -> DataFrame | None:
    """Fingerprints of more than one row, as a local table; None beyond ``limit``.

    This is the only pass that looks at every row, and it shuffles the
    fingerprints alone. Rows whose fingerprint is unique cannot be duplicates.
    """
    found = (
        marked.groupBy(FINGERPRINT)
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select(FINGERPRINT)
        # ``take`` reads one partition after another and stops beyond the limit.
        .take(limit + 1)
    )
    if len(found) > limit:
        return None
    return small_frame(marked.sparkSession, found, f"{FINGERPRINT} bigint")


def _told_apart(value: Column, kind: T.DataType) -> Column:
    """The value with what Spark's hashes pass over: where nulls are, and where arrays end."""
    inner = [value]
    if isinstance(kind, T.StructType):
        inner = [_told_apart(value[f.name], f.dataType).alias(f"f{i}") for i, f in enumerate(kind)]
    elif isinstance(kind, T.ArrayType):
        inner = [F.size(value), F.transform(value, lambda x: _told_apart(x, kind.elementType))]
    return F.struct(value.isNull(), *inner)


def duplicate_count(df: DataFrame) -> int:
    """Rows that repeat an earlier row in every column (nulls equal).

    Rows are told apart by 128 bits of fingerprints; nothing else is shuffled, whatever the
    number of copies.
    """
    cells = [_told_apart(clean_value(df, c), df.schema[c].dataType) for c in df.columns]
    prints = df.select(F.xxhash64(*cells).alias("h"), F.xxhash64(F.lit(1), *cells).alias("g"))
    copies = prints.groupBy("h", "g").agg(F.count("*").alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).first()["n"]


def drop_duplicates(df: DataFrame, broadcast_limit: int = BROADCAST_FINGERPRINTS) -> DataFrame:
    """Distinct rows; copies are identical, so which one stays does not matter.

    Only rows that share a fingerprint are shuffled whole. Returns ``df``
    itself when no fingerprint repeats.
    """
    marked = _marked(df)
    repeated = _repeated(marked, broadcast_limit)
    if repeated is None:
        return df.dropDuplicates()
    if repeated.isEmpty():
        return df
    single = marked.join(F.broadcast(repeated), FINGERPRINT, "left_anti")
    shared = marked.join(F.broadcast(repeated), FINGERPRINT, "left_semi").dropDuplicates()
    return single.unionByName(shared).drop(FINGERPRINT)
