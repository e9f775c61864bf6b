"""The canonical table form: one row per cell.

A table is a list of named sections whose columns may differ from example to example, so cells are kept long:
(ex_id, sec_idx, sec_name, row_idx, col_idx, col_name, is_key, entity, kind, num, is_int, str, text, n_sec_rows).
kind: 0 none, 1 number, 2 string; text: the cell as written; entity: the text of the row's key cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.numeric import number_text, parse_cell

CELL = "struct<kind:int,num:double,is_int:boolean,str:string>"
TABLE = f"array<struct<name:string,columns:array<string>,rows:array<array<{CELL}>>,key_column:int>>"
COLUMNS = ("ex_id", "sec_idx", "sec_name", "row_idx", "col_idx", "col_name", "is_key", "entity", "kind", "num", "is_int", "str", "text", "n_sec_rows")


def _text(kind, num, is_int, str_):
    return F.when(kind == 1, number_text(num, is_int, str_)).when(kind == 2, str_)


def finish(raw: DataFrame) -> DataFrame:
    """Add text, entity and n_sec_rows to (ex_id, sec_idx, sec_name, row_idx, col_idx, col_name, is_key, kind, num, is_int, str).

    Entity and n_sec_rows are taken as they are where the source knows them; else they follow from the section's cells.
    """
    out = raw.withColumn("text", _text(*map(F.col, ("kind", "num", "is_int", "str"))))
    if "n_sec_rows" not in raw.columns:
        out = out.withColumn("n_sec_rows", (F.max("row_idx").over(Window.partitionBy("ex_id", "sec_idx")) + 1).cast("int"))
    if "entity" not in raw.columns:
        out = out.withColumn("entity", F.max(F.when(F.col("is_key"), F.coalesce("text", F.lit("None")))).over(Window.partitionBy("ex_id", "sec_idx", "row_idx")))
    return out.select(*COLUMNS)


def from_nested(tables: DataFrame, id: str = "id", table: str = "table") -> DataFrame:
    """Cells of nested tables (type ``TABLE``); fails on a row whose width isn't that of its section."""
    sections = tables.select(F.col(id).alias("ex_id"), F.posexplode(table).alias("sec_idx", "sec"))
    rows = sections.select("ex_id", "sec_idx", "sec", F.posexplode("sec.rows").alias("row_idx", "row"))
    ok = F.size("row") == F.size("sec.columns")
    cells = F.when(ok, F.arrays_zip(F.col("sec.columns").alias("name"), F.col("row").alias("cell"))).otherwise(
        F.raise_error(F.concat(F.lit("row width differs from the columns of section "), F.col("sec.name"))).cast(f"array<struct<name:string,cell:{CELL}>>")
    )
    key = F.get("row", F.col("sec.key_column"))
    entity = F.when(key.isNotNull(), F.coalesce(_text(key["kind"], key["num"], key["is_int"], key["str"]), F.lit("None")))
    out = rows.select("ex_id", "sec_idx", F.col("sec.name").alias("sec_name"), "row_idx", F.col("sec.key_column").alias("k"), entity.alias("entity"), F.size("sec.rows").alias("n_sec_rows"), F.posexplode(cells).alias("col_idx", "c"))
    return finish(out.select("ex_id", "sec_idx", "sec_name", "row_idx", "col_idx", F.col("c.name").alias("col_name"), (F.col("col_idx") == F.col("k")).alias("is_key"), "entity", "n_sec_rows", "c.cell.*"))


def melt(rows: DataFrame, id: str, row_idx: str, section: str, sec_idx: int, columns: dict[str, str], key: str, n_rows: str | None = None) -> DataFrame:
    """Raw cells of a wide DataFrame: one section row per row. columns: cell column name to DataFrame column.

    n_rows: a column that holds how many rows the section has, where there is one.
    """
    entries = []
    kinds = dict(rows.dtypes)
    whole = lambda c: kinds[c] in ("int", "bigint", "smallint", "tinyint")
    for k, (name, c) in enumerate(columns.items()):
        numeric = kinds[c] != "string"
        value = F.col(c)
        entries.append(
            F.struct(
                F.lit(k).alias("col_idx"), F.lit(name).alias("col_name"), F.lit(name == key).alias("is_key"),
                F.when(value.isNull(), 0).otherwise(1 if numeric else 2).alias("kind"), (value.cast("double") if numeric else F.lit(None).cast("double")).alias("num"),
                (value.isNotNull() & F.lit(whole(c))).alias("is_int"), (F.lit(None).cast("string") if numeric else value).alias("str"),
            )
        )
    name = columns[key]
    entity = F.col(name) if kinds[name] == "string" else number_text(F.col(name).cast("double"), F.lit(whole(name)))
    known = [F.coalesce(entity, F.lit("None")).alias("entity")] + ([F.col(n_rows).cast("int").alias("n_sec_rows")] if n_rows else [])
    out = rows.select(F.col(id).alias("ex_id"), F.lit(sec_idx).alias("sec_idx"), F.lit(section).alias("sec_name"), F.col(row_idx).cast("int").alias("row_idx"), *known, F.explode(F.array(*entries)).alias("c"))
    return out.select(*[c for c in out.columns if c != "c"], "c.*")


def from_strings(raw: DataFrame) -> DataFrame:
    """Cells of (ex_id, sec_idx, sec_name, row_idx, col_idx, col_name, is_key, value STRING), values parsed; entity and n_sec_rows as of ``finish``."""
    known = [c for c in ("entity", "n_sec_rows") if c in raw.columns]
    return finish(raw.withColumn("p", parse_cell(F.col("value"))).select("ex_id", "sec_idx", "sec_name", "row_idx", "col_idx", "col_name", "is_key", *known, "p.*"))


def entity_of(value):
    """The entity of a row whose key cell is the raw string ``value``."""
    cell = parse_cell(value)
    return F.coalesce(_text(cell["kind"], cell["num"], cell["is_int"], cell["str"]), F.lit("None"))


def sections(cells: DataFrame) -> DataFrame:
    """(ex_id, sec_idx, sec_name, n_sec_rows, columns): one row per section, columns in order."""
    cols = F.transform(F.array_sort(F.collect_set(F.struct("col_idx", "col_name"))), lambda c: c["col_name"])
    return cells.groupBy("ex_id", "sec_idx", "sec_name", "n_sec_rows").agg(cols.alias("columns"))
