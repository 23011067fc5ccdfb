"""Sources and sinks: catalogue, parsed documents, records, files with their digests, keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CATALOGUE = "doc_id string, topic string, title string, issued string, page_url string, file_url string, size_kb string"
CHUNKS = (
    "chunk_id string, doc_id string, doc_title string, topic string, strategy string, text string, header string, chapter string, heading string, "
    "paras array<string>, page_start int, page_end int, n_tokens int, source_url string"
)
RECORDS = "id string, question string, answer string, kind string, qtype string, evidence array<struct<doc_id:string,quote:string,para:string,page:int>>, origin string, status string, note string"


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Header row, quoted fields, all strings."""
    return spark.read.schema(CATALOGUE).option("header", True).option("escape", '"').csv(path)


def listing(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "topic", "title", "issued", F.col("page_url").alias("url"))


def parsed_documents(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """One JSON object for each file, with the file's name to order by."""
    return spark.read.option("multiLine", True).option("pathGlobFilter", pattern).json(folder).withColumn("file", F.col("_metadata.file_name"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict: a line that does not fit the schema fails the read; blank lines are skipped, a missing path is empty."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def save_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_partition(rows: DataFrame, path: str, by: str) -> None:
    """Replaces only the partitions that ``rows`` has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, stem, size, sha256, kind, modified): kind is pdf, blocked (a bot check) or other, by content."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    body = F.decode(F.col("content"), "ISO-8859-1")
    kind = F.when(F.substring(F.col("content"), 1, 4) == F.encode(F.lit("%PDF"), "UTF-8"), "pdf").when(F.lower(body).contains("captcha") | body.contains("TSPD"), "blocked").otherwise("other")
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(F.lower(F.regexp_replace(name, r"\.[^.]*$", "")), r" \(.*$", "")
    return raw.select("path", name.alias("name"), stem.alias("stem"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), kind.alias("kind"), F.col("modificationTime").alias("modified"))


def newest(found: DataFrame) -> DataFrame:
    """Of files of one stem ("name", "Name (1)") the one changed last."""
    order = Window.partitionBy("stem").orderBy(F.desc("modified"), "path")
    return found.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def link_page(rows: DataFrame) -> Column:
    """A list item for each row (title, url), escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    return F.concat(F.lit('<li><a href="'), safe("url"), F.lit('">'), safe("title"), F.lit("</a></li>"))


def index_faults(chunks: DataFrame, vectors: DataFrame, chunk_key: str, vector_key: str) -> DataFrame:
    """(key, missing): chunks without a vector and vectors without a chunk; empty for a sound index."""
    a, b = chunks.select(F.col(chunk_key).alias("key")), vectors.select(F.col(vector_key).alias("key"))
    return a.join(b, "key", "left_anti").withColumn("missing", F.lit("vector")).unionByName(b.join(a, "key", "left_anti").withColumn("missing", F.lit("chunk")))
