"""Reading and writing resources: text tables, JSON, documents, manifests, exports."""

from __future__ import annotations

from collections.abc import Sequence
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File suffixes, their data and resource types and the size limit must equal the reference's.
DATA_TYPES = {
    ".csv": "csv", ".tsv": "tsv", ".xlsx": "excel", ".xls": "excel", ".parquet": "parquet", ".json": "json",
    ".jsonl": "jsonl", ".pdf": "pdf", ".txt": "txt", ".md": "markdown", ".markdown": "markdown", ".docx": "docx",
    ".html": "html", ".htm": "html",
}
RESOURCE_TYPES = {
    "csv": "structured", "tsv": "structured", "excel": "structured", "parquet": "structured", "json": "json",
    "jsonl": "json", "pdf": "unstructured", "txt": "unstructured", "markdown": "unstructured",
    "docx": "unstructured", "html": "unstructured",
}
MAX_FILE_BYTES = 500 * 1024 * 1024
BAD_RECORD = "_corrupt_record"


def read_table(
    spark: SparkSession, path: str | Sequence[str], kind: str, schema: T.StructType | None = None, view: str | None = None
) -> DataFrame:
    """CSV or TSV with header, Parquet, JSON document or JSON lines; ``view`` names a temporary view.

    Without a schema text formats are inferred, which reads the files once more.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind in ("csv", "tsv"):
        df = reader.csv(path, header=True, sep="\t" if kind == "tsv" else ",", inferSchema=schema is None,
                        timestampFormat="yyyy-MM-dd HH:mm:ss", multiLine=False)
    elif kind == "parquet":
        df = reader.parquet(path) if isinstance(path, str) else reader.parquet(*path)
    elif kind == "json":
        df = reader.json(path, multiLine=True)
    elif kind == "jsonl":
        df = reader.json(path)
    else:
        raise ValueError(f"no table reader for {kind}")
    if view:
        df.createOrReplaceTempView(view)
    return df


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Text and Markdown files, one document per row with its path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Schemaless JSON files as one variant per file."""
    return read_documents(spark, path).select("path", F.try_parse_json("text").alias("document"))


def read_many(
    spark: SparkSession, paths: Sequence[str], schema: T.StructType, file_pattern: str = r"([^/]+)$"
) -> tuple[DataFrame, DataFrame]:
    """(rows with their file, rejected lines): malformed lines never fail the other files.

    ``file_pattern`` picks the part of the path that names the source.
    """
    wide = T.StructType([*schema.fields, T.StructField(BAD_RECORD, T.StringType())])
    raw = spark.read.schema(wide).option("ignoreMissingFiles", True).csv(
        list(paths), header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD_RECORD,
    ).withColumn("source_file", F.regexp_extract(F.col("_metadata.file_path"), file_pattern, 1))
    # A line is only known to be malformed once its columns are parsed, so the test refers to them all.
    parsed = F.xxhash64(*[F.col(f"`{f.name}`") for f in schema.fields])
    bad = F.col(BAD_RECORD).isNotNull() & F.coalesce(parsed != F.lit(-1), F.lit(True))
    return raw.where(~bad).drop(BAD_RECORD), raw.where(bad).select("source_file", F.col(BAD_RECORD).alias("line"))


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def file_manifest(spark: SparkSession, path: str, recursive: bool = True, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Files with size, data type, resource type and validation status; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    types = F.create_map(*[F.lit(x) for item in DATA_TYPES.items() for x in item])
    resources = F.create_map(*[F.lit(x) for item in RESOURCE_TYPES.items() for x in item])
    listed = files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"),
                          types[_suffix(F.col("path"))].alias("data_type"))
    status = (
        F.when(F.col("data_type").isNull(), "unsupported").when(F.col("size_bytes") > max_bytes, "too_large")
        .when(F.col("size_bytes") == 0, "empty").otherwise("valid")
    )
    return listed.withColumns({"resource_type": resources[F.col("data_type")], "status": status})


def storage_by_area(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes per parent folder."""
    files = file_manifest(spark, path)
    area = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return files.groupBy(area.alias("area")).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


class _VisibleText(HTMLParser):
    """Collects text nodes outside script, style and template."""

    HIDDEN = {"script", "style", "template"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN

    def handle_endtag(self, tag):
        if tag in self.HIDDEN and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def visible_text(html: str) -> str:
    parser = _VisibleText()
    parser.feed(html)
    parser.close()
    return "".join(parser.parts)


def html_text(html: Column | str) -> Column:
    """Visible text of an HTML column: text nodes in order, tags dropped, entities decoded.

    Pages go to Python a hundred at a time, as ten thousand in an Arrow batch would take a worker's memory.
    """
    @F.udf("string", useArrow=False)
    def extract(page: str | None) -> str | None:
        return None if page is None else visible_text(page)

    return extract(html)


def export_table(df: DataFrame, path: str, kind: str) -> None:
    """Write a resource as csv (with header), json (records, one per line) or parquet."""
    if kind == "csv":
        df.write.csv(path, header=True, timestampFormat="yyyy-MM-dd HH:mm:ss")
    elif kind == "json":
        df.write.json(path, ignoreNullFields=False)
    elif kind == "parquet":
        df.write.parquet(path)
    else:
        raise ValueError(f"no export to {kind}")


def as_records(df: DataFrame, kind: str) -> DataFrame:
    """One text per row: JSON record or CSV line."""
    if kind == "json":
        return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
    if kind == "csv":
        return df.select(F.to_csv(F.struct("*")).alias("record"))
    raise ValueError(f"no record form {kind}")
