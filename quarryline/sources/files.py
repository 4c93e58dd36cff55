"""Sources: file trees, registries, captured tool output; and versioned snapshots as sink."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions.paths import in_skipped_dir, language_of

#: Providers and quantisations by their names and aliases (fixed values).
PROVIDERS = {"usearch": "usearch", "qdrant": "qdrant", "pgvector": "pgvector", "postgres": "pgvector"}
QUANTISATIONS = {"f32": "f32", "float32": "f32", "i8": "i8", "int8": "i8"}


def file_listing(spark: SparkSession, repo: str, root: str) -> DataFrame:
    """repo, path, size, mtime of a tree without skipped directories; contents aren't read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/*", "/")
    full = F.regexp_replace("path", r"^file:/*", "/")
    path = F.substring(full, F.length(base) + 2, F.lit(1 << 20))
    return raw.select(F.lit(repo).alias("repo"), path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).filter(~in_skipped_dir("path"))


def read_files(spark: SparkSession, repo: str, root: str) -> DataFrame:
    """repo, path, lang, text of a tree; texts that are no UTF-8 have replacement characters."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/*", "/")
    full = F.regexp_replace("path", r"^file:/*", "/")
    out = raw.select(F.lit(repo).alias("repo"), F.substring(full, F.length(base) + 2, F.lit(1 << 20)).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return out.filter(~in_skipped_dir("path")).withColumn("lang", language_of("path"))


def registry(lines: DataFrame) -> DataFrame:
    """key, root from lines(line_no, line) of `key<TAB>root`; comments, blanks and malformed lines
    are skipped, the first of equal keys or roots stays."""
    parts = F.split("line", "\t", -1)
    rows = lines.filter(~F.trim("line").startswith("#")).select("line_no", F.trim(F.get(parts, 0)).alias("key"), F.trim(F.get(parts, 1)).alias("root")).filter("key <> '' AND root <> ''")
    for column in ("key", "root"):
        first = F.row_number().over(Window.partitionBy(column).orderBy("line_no"))
        rows = rows.withColumn("n", first).filter("n = 1").drop("n")
    return rows


def derive_keys(roots: DataFrame) -> DataFrame:
    """root, key: the base name, with the start of the root's hash where names collide."""
    name = F.element_at(F.split(F.regexp_replace("root", "/+$", ""), "/"), -1)
    size = F.count(F.lit(1)).over(Window.partitionBy("name"))
    rows = roots.withColumn("name", name).withColumn("n", size)
    return rows.select("root", F.when(F.col("n") > 1, F.concat("name", F.lit("-"), F.substring(F.sha2("root", 256), 1, 6))).otherwise(F.col("name")).alias("key"))


def provider(name: str) -> str:
    if name.lower() not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}")
    return PROVIDERS[name.lower()]


def quantisation(name: str) -> str:
    if name.lower() not in QUANTISATIONS:
        raise ValueError(f"unknown quantisation {name!r}")
    return QUANTISATIONS[name.lower()]


HIT_SCHEMA = "struct<result:array<struct<id:bigint,score:double>>>"


def parse_hits(answers: DataFrame) -> DataFrame:
    """query_id, id, score from JSON answers of a vector store (query_id, body)."""
    return answers.select("query_id", F.explode(F.from_json("body", HIT_SCHEMA)["result"]).alias("h")).select("query_id", "h.id", "h.score")


WEB_SCHEMA = "struct<results:array<struct<title:string,url:string,content:string>>>"


def web_results(answers: DataFrame, count: int = 10) -> DataFrame:
    """query_id, rank, title, url, content: the first `count` (10 at most) with a url."""
    trimmed = F.transform(F.from_json("body", WEB_SCHEMA)["results"], lambda r: F.struct(F.trim(r["title"]).alias("title"), F.trim(r["url"]).alias("url"), F.trim(r["content"]).alias("content")))
    kept = F.slice(F.filter(trimmed, lambda r: F.coalesce(r["url"], F.lit("")) != ""), 1, min(count, 10))
    return answers.select("query_id", F.posexplode(kept).alias("rank", "r")).select("query_id", "rank", "r.*")


#: Where tables that are saved together lie, how many of their versions stay, and what a pointer holds.
TOGETHER, KEPT, SET_SCHEMA = "together", 3, "n long, version string, done string, names array<string>"


class Snapshots:
    """Versions of named tables below a folder. A version is written whole, then one small pointer
    table names it; readers follow the last pointer, so a failed write is never seen."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def save(self, name: str, df: DataFrame, partition_by: str | None = None) -> str:
        version = uuid.uuid4().hex
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(f"{self.folder}/{name}/v={version}")
        number = self._last(name)[0] + 1
        self.spark.createDataFrame([(number, version)], "n long, version string").coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}/pointers")
        return version

    def _last(self, name: str) -> tuple[int, str | None]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/pointers")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return 0, None
        row = self.spark.read.option("recursiveFileLookup", True).schema("n long, version string").parquet(path.toString()).orderBy(F.desc("n"), "version").first()
        return (row["n"], row["version"]) if row else (0, None)

    def save_all(self, tables: dict[str, DataFrame], done: str = "") -> None:
        """Writes tables as one version: they are seen together or not at all. done names the step
        that they are the outcome of. Versions before the last KEPT are removed."""
        version = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.folder}/{TOGETHER}/v={version}/{name}")
        number = self._last_set()[0] + 1
        fs = self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.createNewFile(self._path(f"{TOGETHER}/numbers/{number:012}")):
            raise RuntimeError(f"another writer has taken version {number} of {self.folder}")
        rows = [(number, version, done, sorted(tables))]
        self.spark.createDataFrame(rows, SET_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/{TOGETHER}/pointers")
        for old in self._sets().filter(F.col("n") <= number - KEPT).select("version").collect():
            fs.delete(self._path(f"{TOGETHER}/v={old['version']}"), True)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _sets(self) -> DataFrame:
        path = self._path(f"{TOGETHER}/pointers")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], SET_SCHEMA)
        return self.spark.read.schema(SET_SCHEMA).parquet(path.toString())

    def _last_set(self) -> tuple[int, str, str, list[str]]:
        row = self._sets().orderBy(F.desc("n"), "version").first()
        return tuple(row) if row else (0, "", "", [])

    def load_all(self) -> tuple[dict[str, DataFrame], str]:
        """The tables of the last version and the step they are the outcome of; no tables for a cold
        start, and also where one of them can't be read: then all is built anew."""
        _, version, done, names = self._last_set()
        try:
            return {name: self.spark.read.parquet(f"{self.folder}/{TOGETHER}/v={version}/{name}") for name in names}, done
        except AnalysisException:
            return {}, ""

    def load(self, name: str) -> DataFrame | None:
        """The last whole version, or None for a cold start."""
        version = self._last(name)[1]
        if version is None:
            return self.load_all()[0].get(name)
        return self.spark.read.parquet(f"{self.folder}/{name}/v={version}")
