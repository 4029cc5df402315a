"""Column helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ASCII white space: a word is a run of anything else.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of ``text`` as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, f"[{SPACE_CLASS}]+")
    )


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores in front as it takes to differ from
    all ``columns`` (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _has_map(kind.elementType))


def content_key(*cols: str) -> list[Column]:
    """Two 64-bit hashes that identify the values of ``cols``: rows with equal
    values share a key whatever their ids are, so ids may be null or repeat."""
    return _keys([F.col(f"`{c}`") for c in cols])


def _keys(values: list[Column]) -> list[Column]:
    parts = [x for v in values for x in (v, v.isNull())]
    return [F.xxhash64(*parts).alias("key_a"), F.xxhash64(F.lit(7), *reversed(parts)).alias("key_b")]


def keyed_rows(docs: DataFrame) -> DataFrame:
    """``docs`` as ``row`` (a struct of all columns) with the content key of the
    whole row, so that rows can be found again without a copy of the table."""
    whole = docs.select(F.struct("*").alias("row"))
    # maps have no hash of their own: their JSON form stands for them
    parts = [F.to_json(F.struct(c)) if _has_map(f.dataType) else c
             for f in docs.schema.fields for c in [F.col("row").getField(f.name)]]
    return whole.select("row", *_keys(parts))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (a null id counts as empty)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))
