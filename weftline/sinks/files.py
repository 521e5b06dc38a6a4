"""DataFrames to files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import strip_markup
from weftline.operators.relational import nest


def _flags(df: DataFrame) -> DataFrame:
    """Flags as 1 and 0."""
    flags = [f.name for f in df.schema.fields if f.dataType.typeName() == "boolean"]
    return df.withColumns({c: F.col(c).cast("int") for c in flags}) if flags else df


def csv_report(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """One CSV file with a header, for people; ordered if asked for.  Flags are written as 1 and 0."""
    out = _flags(df)
    (out.orderBy(*order) if order else out).coalesce(1).write.mode("overwrite").csv(path, header=True)


def csv_parts(df: DataFrame, path: str) -> None:
    """As many CSV files as there are partitions: for data, not for people.  Flags are written as 1 and 0."""
    _flags(df).write.mode("overwrite").csv(path, header=True)


def json_document(df: DataFrame, path: str) -> None:
    """Every row as one JSON object in a text file."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def nested_export(parents: DataFrame, children: DataFrame, key: str, fields: Sequence[str], order: Sequence[str], name: str = "highlights") -> DataFrame:
    """``(id, json)``: each parent as a JSON object with the array of its children (empty if it has none)."""
    whole = nest(parents, children, key, fields, name, order)
    return whole.select(F.col(key).alias("id"), F.to_json(F.struct(*whole.columns), {"ignoreNullFields": "false"}).alias("json"))


def two_tables(parents: DataFrame, children: DataFrame, path: str, text_cols: Sequence[str] = ()) -> tuple[str, str]:
    """Parents and children as two CSV outputs, the second beside the first; markup is stripped from ``text_cols``."""
    clean = parents.withColumns({c: strip_markup(F.col(c)) for c in text_cols}) if text_cols else parents
    stem, dot, ext = path.rpartition(".")
    second = f"{stem}_highlights.{ext}" if dot and "/" not in ext else f"{path}_highlights"
    csv_parts(clean, path)
    csv_parts(children, second)
    return path, second


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def gzip_json(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Gzip-ed JSON; the committer renames finished files into place, so readers never see half a file."""
    w = df.write.mode("overwrite").option("compression", "gzip")
    (w.partitionBy(*by) if by else w).json(path)


def upsert_manifest(spark: SparkSession, path: str, fresh: DataFrame, key: Sequence[str]) -> DataFrame:
    """The manifest with rows of ``fresh`` in place of older ones of the same key; the caller writes it back."""
    old = spark.read.schema(fresh.schema).json(path)
    return old.join(fresh.select(*key), list(key), "left_anti").select(*fresh.columns).unionByName(fresh)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def display_text(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Every cell as text for a table on a slide: printf formats by column, nulls as empty texts."""
    return df.select(*[F.coalesce(F.format_string(formats[c], F.col(c)) if c in formats else F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def report_lines(df: DataFrame, order: str, formats: dict[str, str]) -> DataFrame:
    """``(pos, line)`` of a table for readers, in pipes: printf formats by column, nulls as blanks.  For reports, not for data."""
    cells = [F.coalesce(F.when(F.col(c).isNotNull(), F.format_string(f, F.col(c))), F.lit("")) for c, f in formats.items()]
    body = df.select((F.row_number().over(Window.orderBy(order)) + 1).alias("pos"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(formats) + " |"), (1, "|" + "-|" * len(formats))], "pos int, line string")
    return head.unionByName(body)
