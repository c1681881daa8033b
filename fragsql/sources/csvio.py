"""Delimited text: reading with quotes and headers, picking fields, and a writer whose null and '' differ."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fragsql.runtime import shared_dir
from fragsql.sources import embedded


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = "\t", quote: str = '"', header: bool = False, multi_line: bool = True) -> DataFrame:
    """Delimited text, tab by default. A quoted field may hold separators, line ends and doubled quotes.

    multi_line: records may run over lines, and a file is then read by one task; without it large files are split.
    With a header, names are the header's in upper case. Without schema every field is text. An empty unquoted field
    is null, "" is the empty text.
    """
    reader = spark.read.option("sep", sep).option("quote", quote).option("escape", quote).option("header", header).option("multiLine", multi_line)
    reader = reader.option("emptyValue", "").option("nullValue", None).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*[c.upper() for c in df.columns]) if header else df


def parse_line(line: str | Column, schema: str, sep: str = "\t", quote: str = '"') -> Column:
    """The fields of one record as a struct. A quote that isn't closed runs to the end of the line."""
    return F.from_csv(line, schema, {"sep": sep, "quote": quote, "escape": quote})


def pick_fields(df: DataFrame, line: str, indexes: Sequence[int], sep: str = "\t", quote: str = '"', out: str = "fields") -> DataFrame:
    """Fields by ascending places from 1, as an array of text; a place beyond the last field gives null."""
    if list(indexes) != sorted(set(indexes)) or not indexes or indexes[0] < 1:
        raise ValueError("places must be ascending, from 1")
    schema = ", ".join(f"f{i} string" for i in range(1, max(indexes) + 1))
    parsed = parse_line(line, schema, sep, quote)
    return df.withColumn(out, F.array(*[parsed[f"f{i}"] for i in indexes]))


def join_keys(columns: Sequence[str], order: Sequence[str], sep: str = "|") -> Column:
    """The parts of a key as one text, in the order of the table's columns."""
    place = {c: i for i, c in enumerate(order)}
    return F.concat_ws(sep, *[F.col(c).cast("string") for c in sorted(columns, key=place.__getitem__)])


def csv_lines(df: DataFrame, sep: str = ",", quote_all: bool = True) -> DataFrame:
    """df as text lines, one column `value`. Null is an empty field.

    quote_all: texts are quoted, quotes in them doubled, so "" is the empty text. Else only texts with the separator,
    a quote or a line end are quoted, and null and '' look the same.
    """
    fields = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`").cast("string")
        if kind == "string":
            quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
            special = F.contains(c, F.lit(sep)) | F.contains(c, F.lit("\n")) | F.contains(c, F.lit('"'))
            c = quoted if quote_all else F.when(special, quoted).otherwise(c)
        fields.append(F.coalesce(c, F.lit("")))
    # concat_ws would be shorter, but skips nothing here and fails on no columns
    return df.select(F.concat_ws(sep, *fields).alias("value"))


def write_csv(df: DataFrame, path: str, sep: str = ",", quote_all: bool = True) -> None:
    """A directory of text files, one for each partition."""
    csv_lines(df, sep, quote_all).write.text(path)


def write_csv_file(df: DataFrame, path: str, sep: str = ",", header: bool = False) -> str:
    """One file at a local or shared path, for results that are read by people; returns the path.

    Partitions are written side by side in the shared folder and then put together in order, so the rows never have
    to fit in one task.
    """
    spark = df.sparkSession
    parts = f"{shared_dir(spark)}/fragsql-csv-{uuid.uuid4().hex}"
    csv_lines(df, sep).write.text(parts)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hp = jvm.org.apache.hadoop.fs.Path
    source, target = hp(parts), hp(path)
    fs_in, fs_out = source.getFileSystem(conf), target.getFileSystem(conf)
    out = fs_out.create(target, True)
    try:
        if header:
            line = sep.join('"' + c.replace('"', '""') + '"' for c in df.columns) + "\n"
            out.write(bytearray(line.encode()))
        for name in sorted(s.getPath().toString() for s in fs_in.listStatus(source) if s.getPath().getName().startswith("part-")):
            part = fs_in.open(hp(name))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            part.close()
    finally:
        out.close()
    fs_in.delete(source, True)
    return path


def append_checked(df: DataFrame, table: str, expected: int | None = None) -> int:
    """Append to a table and return the rows added; if they aren't as many as expected, that is an error."""
    spark = df.sparkSession
    before = spark.table(table).count()
    df.write.insertInto(table)
    added = spark.table(table).count() - before
    if expected is not None and added != expected:
        raise ValueError(f"{added} rows came into {table}, {expected} were expected")
    return added


def read_points(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """features ARRAY<DOUBLE> of text files with numbers between blanks, one point a line, found recursively."""
    reader = spark.read.option("recursiveFileLookup", True)
    lines = (reader.option("pathGlobFilter", f"*{suffix}") if suffix else reader).text(path)
    words = F.filter(F.split(F.trim("value"), r"\s+"), lambda w: w != "")
    return lines.select(F.transform(words, lambda w: w.cast("double")).alias("features")).where(F.size("features") > 0)


def query_rows(spark: SparkSession, query: str, batch: int = 10_000) -> Iterator[pd.DataFrame]:
    """A forward-only cursor over a query's rows, a partition at a time; no more than one partition is on the driver."""
    rows = []
    df = spark.sql(query)
    for row in df.toLocalIterator(prefetchPartitions=False):
        rows.append(row)
        if len(rows) == batch:
            yield pd.DataFrame(rows, columns=df.columns)
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=df.columns)


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A database's query; give partitionColumn, lowerBound, upperBound and numPartitions to read it side by side.

    A database within the driver's process is read at once, through the driver, where tasks run in other processes.
    """
    kind = "dbtable" if "partitionColumn" in options else "query"
    value = f"({query}) q" if kind == "dbtable" else query
    df = spark.read.format("jdbc").option("url", url).option(kind, value).options(**options).load()
    return embedded.read(df, url, query, options) if embedded.out_of_reach(spark, url) else df


def write_jdbc(df: DataFrame, url: str, table: str, replace: bool = True, **options: str) -> None:
    """Rows into a database table; replace empties it first and keeps its definition."""
    away = embedded.out_of_reach(df.sparkSession, url)
    rows = df.sparkSession.createDataFrame([], df.schema) if away else df  # without rows no task writes, only the driver
    writer = rows.write.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    (writer.option("truncate", "true").mode("overwrite") if replace else writer.mode("append")).save()
    if away:
        embedded.append(df, url, table, options)
