"""Tables from files: CSV sheets, workbooks, dataset TSVs, taxonomies, request lines; and run folders."""

from __future__ import annotations

import csv
import io
import itertools
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

DATASETS = {
    "title": {"key": "tconst", "names": ["primaryTitle", "originalTitle"], "ints": ["startYear", "endYear", "runtimeMinutes"], "lists": ["genres"]},
    "name": {"key": "nconst", "names": ["primaryName"], "ints": ["birthYear", "deathYear"], "lists": ["primaryProfession", "knownForTitles"]},
    "episode": {"key": "tconst", "names": [], "ints": ["seasonNumber", "episodeNumber"], "lists": []},
}
PREFERRED_VALUE_COLUMNS = ["imdb_id", "imdb id", "id", "title", "name", "primary title", "primary name", "person", "value"]


#: Encodings in which a sheet is tried to be read, in this order.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252")


def decoded_sheet(content: bytes, encodings: tuple[str, ...]) -> tuple[str, str]:
    """The encoding that fits first, strictly, and the text."""
    for encoding in encodings:
        try:
            return encoding, content.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise ValueError(f"the file could not be decoded as {', '.join(encodings)}")


def read_csv_rows(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """All rows of the CSV sheets in a folder: path, encoding, row_num (from 1), cells.

    Each file is read once, in the first of ``encodings`` that fits all of its bytes; a
    file that fits none is an error with its name.  Rows keep the cells they have, however
    many, and empty lines count.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    encoding, text = decoded_sheet(bytes(content), encodings)
                except ValueError as error:
                    raise ValueError(f"{name}: {error}") from None
                sheet = enumerate(csv.reader(io.StringIO(text, newline="")), 1)
                while part := list(itertools.islice(sheet, 10_000)):
                    yield pd.DataFrame([(name, encoding, n, cells) for n, cells in part], columns=["path", "encoding", "row_num", "cells"])

    return files.mapInPandas(rows, "path string, encoding string, row_num long, cells array<string>")


def read_sheet_csv(spark: SparkSession, path: str, encoding: str | None = None, header_row: int = 1) -> DataFrame:
    """CSV sheets as text columns plus ``row_num``, in file order.

    The header is that of the first file by path; every file must have the same one.
    Without an ``encoding`` each file is read in the first of ``ENCODINGS``
    that fits.  Short rows end in nulls, cells beyond the header are left out,
    empty cells are null, and a header without a name is ``column_N``; of equal names later ones get their number.
    """
    rows = read_csv_rows(spark, path, (encoding,) if encoding else ENCODINGS)
    heads = rows.filter(F.col("row_num") == header_row).select("path", "cells")
    if heads.select("cells").distinct().limit(2).count() > 1:
        raise ValueError(f"the sheets in {path} have different headers")
    first = heads.orderBy("path").first()
    names: list[str] = []
    for i, name in enumerate(first.cells if first else [], 1):
        name = name.strip() or f"column_{i}"
        names.append(f"{name}_{i}" if name.lower() in {n.lower() for n in [*names, "row_num"]} else name)
    cells = [F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]
    return rows.filter(F.col("row_num") > header_row).select(*cells, "row_num")


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """All cells of the workbooks in a folder: path, sheet, row_num, col_num, header, value.

    One workbook per task row; rows without a value are skipped.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def cells(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = list(workbook_cells(bytes(content)))
                yield pd.DataFrame([(name, *r) for r in rows], columns=["path", "sheet", "row_num", "col_num", "header", "value"])

    return files.mapInPandas(cells, "path string, sheet string, row_num long, col_num int, header string, value string")


def workbook_cells(content: bytes):
    """(sheet, row, column, header, value) of a workbook's filled cells below the first row."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{main}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{main}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{main}sheet"):
            part = targets[sheet.get(link)].lstrip("/")
            headers: dict[int, str] = {}
            for c in ElementTree.fromstring(book.read(part if part.startswith("xl/") else f"xl/{part}")).iter(f"{main}c"):
                letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                column = 0
                for x in letters:
                    column = column * 26 + ord(x) - 64
                value, kind = c.find(f"{main}v"), c.get("t")
                text = "".join(t.text or "" for t in c.iter(f"{main}t")) if kind == "inlineStr" else value.text if value is not None else None
                if text is not None and kind == "s":
                    text = shared[int(text)]
                if text is None:
                    continue
                if row == "1":
                    headers[column] = text.strip()
                else:
                    yield sheet.get("name"), int(row), column, headers.get(column, ""), text


def sheet_table(cells: DataFrame, headers: list[str]) -> DataFrame:
    """Cells of one sheet as a table with the given columns."""
    return cells.groupBy("path", "sheet", "row_num").pivot("header", headers).agg(F.first("value"))


def read_dataset_tsv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A title, name or episode dataset: typed, lists split, normalised names; the last row of a key stays.

    Gzip can't be split: write the result as Parquet once and read that.
    """
    spec = DATASETS[kind]
    raw = spark.read.csv(path, sep="\t", header=True, nullValue="\\N", quote="", escape="")
    out = raw.withColumn("__at", F.monotonically_increasing_id())
    for c in spec["ints"]:
        if c in raw.columns:
            out = out.withColumn(c, F.col(c).try_cast("int"))
    for c in spec["lists"]:
        if c in raw.columns:
            out = out.withColumn(c, F.split(c, ","))
    for c in spec["names"]:
        out = out.withColumn(f"{c}_norm", T.norm_lookup(F.col(c)))
    turn = F.row_number().over(Window.partitionBy(spec["key"]).orderBy(F.desc("__at")))
    return out.withColumn("__turn", turn).filter("__turn = 1").drop("__turn", "__at")


def write_lookup_table(df: DataFrame, name: str, key: str, *, buckets: int, path: str | None = None) -> DataFrame:
    """Save a reference table in buckets of a key, sorted within them, and read it back.

    Look-ups by that key then read the table where it lies: only the queries are
    shuffled, into as many partitions.  Write one table for each key that is looked up, such as
    a dataset's id and its normalised name.  ``path`` makes it an external table.
    """
    writer = df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def parse_query_lines(lines: DataFrame, fields: list[str], defaults: dict[str, str] | None = None, line: str = "value") -> DataFrame:
    """Lines of fields separated by | as a query table; blank lines dropped, missing fields by default."""
    parts = F.transform(F.split(line, r"\|"), lambda x: F.regexp_replace(x, T.EDGES, ""))
    cells = [F.coalesce(F.nullif(F.try_element_at("__p", F.lit(i + 1)), F.lit("")), F.lit((defaults or {}).get(f))).alias(f) for i, f in enumerate(fields)]
    return lines.withColumn("__p", parts).select(*cells).filter(F.coalesce(F.col(fields[0]), F.lit("")) != "")


def split_values(lines: DataFrame, line: str = "value") -> DataFrame:
    """Free text as one value per row, split at line ends, commas and semicolons."""
    return lines.select(F.explode(F.split(line, r"[\r\n,;]+")).alias("v")).select(F.regexp_replace("v", T.EDGES, "").alias("value")).filter("value <> ''")


def value_column(df: DataFrame, column: str | None = None) -> Column:
    """The column to look up: the one asked for, else a preferred name, else the first."""
    names = {c.casefold().strip(): c for c in df.columns}
    if column:
        if column.casefold().strip() not in names:
            raise ValueError(f"no column {column!r}")
        return F.col(names[column.casefold().strip()])
    return F.col(next((names[p] for p in PREFERRED_VALUE_COLUMNS if p in names), df.columns[0]))


def taxonomy_table(df: DataFrame, category: str, sub: str) -> DataFrame:
    """Sub-categories per category, blanks and "nan" dropped."""
    good = lambda c: ~F.lower(T.text(F.col(c))).isin("", "nan")
    return df.filter(good(category)).groupBy(T.text(F.col(category)).alias("category")).agg(F.array_sort(F.collect_set(F.when(good(sub), T.text(F.col(sub))))).alias("sub_categories"))


def roster_table(df: DataFrame, synonyms: dict[str, list[str]], order: str) -> DataFrame:
    """A roster with columns by any of their names; the last row of a name (any case) stays."""
    names = {c.casefold().strip(): c for c in df.columns}
    cells = [F.coalesce(*[F.nullif(T.text(F.col(f"`{names[s]}`")), F.lit("")) for s in options if s in names], F.lit(None)).alias(c) for c, options in synonyms.items()]
    first = next(iter(synonyms))
    keyed = df.select(*cells, F.col(order).alias("__at")).filter(F.col(first).isNotNull())
    turn = F.row_number().over(Window.partitionBy(F.lower(first)).orderBy(F.desc("__at")))
    return keyed.withColumn("__turn", turn).filter("__turn = 1").drop("__turn", "__at")


def write_run(df: DataFrame, folder: str, run_date: str, run_id: str) -> None:
    """A run's rows in their own dated partition."""
    df.withColumns({"run_date": F.lit(run_date), "run_id": F.lit(run_id)}).write.mode("append").partitionBy("run_date", "run_id").parquet(folder)
