"""Readers, encoding detection, literal replacement and report sinks.

All reads are Spark reads (splittable where the format allows), and paths are
looked up in the file system Spark uses for them. The encoding check is a
distributed count: of lines that are not valid UTF-8 bytes, and for other
encodings of lines holding U+FFFD, the replacement character a decoder emits
for bytes it cannot map.
"""

from __future__ import annotations

import os
import re
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: encodings tried in this order when none is given
ENCODINGS = ("utf8", "GB18030", "gbk", "big5")
SUFFIX_FORMATS = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "json", ".xml": "xml",
                  ".parquet": "parquet", ".txt": "csv"}
REPLACEMENT_CHAR = "\ufffd"
SINKS = ("parquet", "csv", "json")


def ensure_charsets(spark: SparkSession) -> None:
    """GB18030 / GBK / Big5 need Java's full charset list (a runtime SQL setting)."""
    if (spark.conf.get("spark.sql.legacy.javaCharsets", "false") or "false").lower() != "true":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def is_utf8(encoding: str) -> bool:
    return encoding.lower().replace("-", "") == "utf8"


def charset(spark: SparkSession, encoding: str) -> str:
    """The name Spark's readers take for an encoding: "utf8" is only known with Java's charset list, "UTF-8" always."""
    if is_utf8(encoding):
        return "UTF-8"
    ensure_charsets(spark)
    return encoding


def data_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files behind a path, folder or pattern, by Hadoop's file system; empty if there are none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = []
    for status in fs.globStatus(where) or []:
        if status.isDirectory():
            names += [x.getPath().getName() for x in fs.listStatus(status.getPath())]
        else:
            names.append(status.getPath().getName())
    return sorted(n for n in names if not n.startswith((".", "_")))


def format_of(path: str, names: Sequence[str] = ()) -> str:
    """The format by the suffix of the path, else of its first data file."""
    found = [os.path.splitext(n.rstrip("/"))[1].lower() for n in (path, *names[:1])]
    for ext in found:
        if ext in SUFFIX_FORMATS:
            return SUFFIX_FORMATS[ext]
    raise ValueError(f"unsupported file type {found[-1]!r} for {path!r}; expected one of {sorted(SUFFIX_FORMATS)}")


def decoded_lines(spark: SparkSession, path: str, encoding: str = "utf8") -> DataFrame:
    """``(value)``: every line, blank ones included.

    Line feeds are split on bytes, which is safe for UTF-8 and for encodings
    whose second bytes are never control characters (GB18030, GBK, Big5).
    """
    lines = spark.read.text(path)
    if is_utf8(encoding):
        return lines
    ensure_charsets(spark)
    return lines.withColumn("value", F.decode(F.col("value").cast("binary"), encoding))


def bad_lines(spark: SparkSession, path: str, encoding: str) -> int:
    """Lines that ``encoding`` does not decode (one distributed count)."""
    if is_utf8(encoding):
        return spark.read.text(path).filter(~F.is_valid_utf8(F.col("value"))).count()
    lines = (spark.read.option("encoding", charset(spark, encoding)).option("sep", "\u0001").option("quote", "\u0000")
             .option("header", "false").schema("_c0 string").csv(path))
    return lines.filter(F.instr(F.col("_c0"), REPLACEMENT_CHAR) > 0).count()


def detect_encoding(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> str:
    """The first encoding that decodes every line."""
    ensure_charsets(spark)
    known = spark._jvm.java.nio.charset.Charset
    for enc in encodings:
        if known.isSupported(enc) and bad_lines(spark, path, enc) == 0:
            return enc
    raise ValueError(f"none of the encodings {list(encodings)} decodes {path!r} cleanly")


def read_delimited(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf8",
                   infer_schema: bool = True, **options) -> DataFrame:
    """A1: CSV (comma) or TSV (tab) with a header line."""
    r = spark.read.option("header", "true").option("inferSchema", str(infer_schema).lower()) \
        .option("sep", sep).option("encoding", charset(spark, encoding))
    for k, v in options.items():
        r = r.option(k, v)
    return r.csv(path)


def whole_json_files(spark: SparkSession, path: str, encoding: str = "utf8") -> tuple[list[str], list[str]]:
    """Files of JSON Lines, and files that hold one JSON text over several lines, by one pass over all lines.

    A file is one text if its first line is not a record by itself and either
    an array spans the file or less than half of its lines are records; so bad
    lines, the first or the last one too, leave a file JSON Lines.
    """
    line = F.trim(F.regexp_replace("value", "^\ufeff", ""), F.lit(" \t\r"))
    lines = (decoded_lines(spark, path, encoding).select(line.alias("line"), F.col("_metadata.file_path").alias("file"), F.struct(
        F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at")).where("line <> ''"))
    record = (F.json_object_keys("line").isNotNull() | F.json_array_length("line").isNotNull()) & F.col("line").rlike(r"[}\]]$")
    files = lines.withColumn("record", record).groupBy("file").agg(
        F.min_by(F.struct("record", "line"), "at").alias("first"), F.max_by("line", "at").alias("last"),
        F.avg(F.col("record").cast("int")).alias("records"))
    spans = F.col("first.line").startswith("[") & F.col("last").endswith("]")
    found = files.select("file", (~F.col("first.record") & (spans | (F.col("records") < 0.5))).alias("whole")).collect()
    return [sorted(_escaped(r["file"]) for r in found if r["whole"] == w) for w in (False, True)]


def _escaped(file: str) -> str:
    """A file's path as a pattern that matches only it."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", unquote(file))


def read_json_table(spark: SparkSession, path: str, encoding: str = "utf8",
                    multi_line: bool | None = None) -> DataFrame:
    """A2: JSON Lines, or one array of records.

    ``multi_line=None`` looks: if some line is not a record by itself, each
    file is read by lines or whole (:func:`whole_json_files`). Bad lines
    become rows with a ``_corrupt_record``; all other records stay.
    """
    known = charset(spark, encoding)

    def read(whole: bool, files: str | list[str] = path, **options) -> DataFrame:
        r = spark.read.option("multiLine", str(whole).lower()).option("encoding", known).options(**options)
        return r.json(files) if whole else r.option("lineSep", "\n").json(files)
    if multi_line is None:
        df = read(False)
        if "_corrupt_record" not in df.columns:
            return df
        by_line, whole = whole_json_files(spark, path, encoding)
        if whole:
            # only a file that parses as one text is one
            texts = read(True, whole, columnNameOfCorruptRecord="_corrupt_record")
            if "_corrupt_record" in texts.columns:
                others = [c for c in texts.columns if c != "_corrupt_record"]
                # Spark wants a field beside the corrupt record to be read
                read_ = F.count(F.col("`" + others[0].replace("`", "``") + "`")) if others else F.lit(0)
                files = texts.select("*", F.col("_metadata.file_path").alias("__file")) if others else None
                broken = set(whole) if files is None else {
                    _escaped(r["__file"]) for r in files.groupBy("__file").agg(
                        F.count("_corrupt_record").alias("bad"), read_.alias("n")).collect() if r["bad"]}
                by_line, whole = sorted([*by_line, *broken]), [f for f in whole if f not in broken]
        if not whole:
            return df
        if by_line:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
            base = {"basePath": path} if fs.exists(where) and fs.getFileStatus(where).isDirectory() else {}
            return read(False, by_line, **base).unionByName(read(True, whole, **base), allowMissingColumns=True)
        multi_line = True
    df = read(multi_line)
    fields = df.schema.fields
    if fields and all(f.dataType.typeName() == "struct" for f in fields) and multi_line:
        n = df.limit(2).count()
        if n == 1:
            raise ValueError("column-oriented JSON ({column: {index: value}}) is not a table of records; "
                             "write it as an array of records or JSON lines")
    return df


def read_xml_table(spark: SparkSession, path: str, row_tag: str = "row", encoding: str = "utf8") -> DataFrame:
    """A3: XML with one element per row (Spark's built-in XML source)."""
    r = spark.read.format("xml").option("rowTag", row_tag)
    if not is_utf8(encoding):
        r = r.option("encoding", charset(spark, encoding)).option("useLegacyXMLParser", "true")
    return r.load(path)


def read_table(spark: SparkSession, path: str, encodings: Sequence[str] | None = None,
               row_tag: str = "row", fmt: str | None = None, **options) -> DataFrame:
    """A4: dispatch on the suffix (case-insensitive, or ``fmt`` = csv / tsv / json / xml /
    parquet); text formats try the encodings in order.

    Raises a ``ValueError`` for a missing path, an unknown suffix or when no
    encoding fits (instead of returning nothing).
    """
    names = data_files(spark, path)
    if not names:
        raise ValueError(f"no such file or folder, or no data files in it: {path!r}")
    fmt = fmt.lower() if fmt else format_of(path, names)
    if fmt == "parquet":
        return spark.read.parquet(path)
    ensure_charsets(spark)
    enc = encodings[0] if encodings and len(encodings) == 1 else \
        detect_encoding(spark, path, tuple(encodings or ENCODINGS))
    if fmt == "csv":
        return read_delimited(spark, path, ",", enc, **options)
    if fmt == "tsv":
        return read_delimited(spark, path, "\t", enc, **options)
    if fmt == "json":
        return read_json_table(spark, path, enc)
    return read_xml_table(spark, path, row_tag, enc)


def replace_literals(col: Column, mapping: Mapping[str, str]) -> Column:
    """A5 on a column: ordered literal replacements (no regular expressions)."""
    out = col
    for old, new in mapping.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def replace_in_text_file(spark: SparkSession, in_path: str, out_path: str, mapping: Mapping[str, str],
                         encoding: str = "utf8") -> DataFrame:
    """A5 on files: every line of ``in_path``, blank ones too, with the replacements applied, written as text."""
    out = decoded_lines(spark, in_path, encoding).select(replace_literals(F.col("value"), mapping).alias("value"))
    out.write.mode("overwrite").text(out_path)
    return spark.read.text(out_path)


def write_report_tables(tables: Mapping[str, DataFrame], out_dir: str, fmt: str = "parquet",
                        partition_by: Sequence[str] | None = None) -> dict[str, str]:
    """One dataset per report table (``{name: path}``); CSV gets arrays as ``[a, b]``."""
    if fmt not in SINKS:
        raise ValueError(f"unknown format {fmt!r}; expected one of {list(SINKS)}")
    paths = {}
    for name, df in tables.items():
        p = f"{out_dir.rstrip('/')}/{name}"
        if fmt == "csv":
            df = df.select(*[F.concat(F.lit("["), F.array_join(F.col(f"`{f.name}`").cast("array<string>"), ", ", "null"),
                                      F.lit("]")).alias(f.name) if isinstance(f.dataType, T.ArrayType)
                             else F.col(f"`{f.name}`") for f in df.schema.fields])
        w = df.write.mode("overwrite")
        if partition_by and all(c in df.columns for c in partition_by):
            w = w.partitionBy(*partition_by)
        if fmt == "csv":
            w.option("header", "true").csv(p)
        elif fmt == "json":
            w.json(p)
        else:
            w.parquet(p)
        paths[name] = p
    return paths
