"""Readers of the corpora, record files and logs that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lmdata.functions.text import strip

# The fields that may hold a record's text, in the order they are tried.
TEXT_KEYS = ("text", "completion", "content", "sentence", "body", "raw")
MIN_CORPUS_LENGTH = 50


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def text_lines(spark: SparkSession, folder: str, longer_than: int = 0) -> DataFrame:
    """(path, pos, text): the stripped lines of a folder's .txt files that are longer; none if the folder isn't there.

    Rows are ordered by path and place; ``numbered`` turns that into one number.
    """
    if not exists(spark, folder):
        return spark.createDataFrame([], "path string, pos int, text string")
    files = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line")).select("path", "pos", strip(F.col("line")).alias("text"))
    return lines.filter(F.length("text") > longer_than)


def numbered(df: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """Adds the place of each row by (file, place): files are counted first, so only a file's rows are sorted together."""
    head, *rest = order
    counts = df.groupBy(head).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col(head).alias("_h"), F.coalesce(F.sum("_n").over(Window.orderBy(head).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rows = df.withColumn("_r", F.row_number().over(Window.partitionBy(head).orderBy(*rest)))
    return rows.join(before, F.col(head) == F.col("_h")).withColumn(name, F.col("_before") + F.col("_r") - 1).drop("_h", "_before", "_r")


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value): the records of a JSON array or of JSON lines, as text; what doesn't parse is skipped."""
    files = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    array = files.filter(F.col("v").startswith("[")).select(F.posexplode(F.from_json("v", "array<variant>")).alias("pos", "x")).select("pos", F.to_json("x").alias("value"))
    lines = files.filter(~F.col("v").startswith("[")).select(F.posexplode(F.split("v", "\r?\n")).alias("pos", "value"))
    return array.unionByName(lines.filter(F.trim("value") != "").filter(F.try_parse_json("value").isNotNull()))


def record_text(value: Column) -> Column:
    """The text of a record given as JSON: a string itself, else the first field that holds one, else title and text, else the longest string."""
    blank_free = lambda c: F.when(F.length(strip(c)) > 0, c)
    fields = F.from_json(value, "map<string,variant>")
    strings = F.map_filter(F.transform_values(fields, lambda _, v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))), lambda _, v: v.isNotNull())
    named = [blank_free(F.get_json_object(value, f"$.{k}")) for k in TEXT_KEYS]
    title = F.nullif(F.concat_ws("\n", blank_free(F.get_json_object(value, "$.title")), blank_free(F.get_json_object(value, "$.text"))), F.lit(""))
    values = F.map_values(strings)
    longest = F.get(F.filter(values, lambda v: F.length(v) == F.array_max(F.transform(values, F.length))), F.lit(0))
    return F.when(F.trim(value).startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).otherwise(F.coalesce(*named, title, longest, F.lit("")))


def collect_texts(records: DataFrame, most: int, min_length: int = MIN_CORPUS_LENGTH) -> DataFrame:
    """The first ``most`` texts that are longer, in order: the filter comes before the limit."""
    return records.select("pos", strip(record_text(F.col("value"))).alias("text")).filter(F.length("text") > min_length).orderBy("pos").limit(most)


def fill(parts: list[DataFrame], most: int) -> DataFrame:
    """Texts of several files in turn until there are enough."""
    out = None
    for i, p in enumerate(parts):
        one = p.select(F.lit(i).alias("file"), "pos", "text")
        out = one if out is None else out.unionByName(one)
    return out.orderBy("file", "pos").limit(most)


def corpus(spark: SparkSession, source: str, folder: str = "", rows: int = 200) -> tuple[DataFrame, DataFrame]:
    """The domain and the general texts of a source: synthetic or local."""
    if source == "synthetic":
        return template_texts(spark, rows, "domain"), template_texts(spark, rows, "general")
    if source == "local":
        domain, general = (text_lines(spark, f"{folder}/{k}", MIN_CORPUS_LENGTH) for k in ("domain", "general"))
        if domain.isEmpty():
            raise FileNotFoundError(f"no domain texts in {folder}")
        return domain, general
    raise ValueError(f"no such source: {source}")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a declared schema; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tolerant_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a declared schema, with the lines that don't parse in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document, or no row if there is no such file."""
    return spark.read.schema(schema).option("multiLine", True).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def training_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log with a header; blank cells are null."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run): the subfolders that hold a loss log."""
    if not exists(spark, f"{folder}/*/loss_log.csv"):
        return spark.createDataFrame([], "run string")
    files = spark.read.format("binaryFile").load(f"{folder}/*/loss_log.csv").select("path")
    return files.select(F.regexp_extract("path", r"([^/]+)/loss_log\.csv$", 1).alias("run")).orderBy("run")


def latest_scores(spark: SparkSession, folder: str) -> DataFrame:
    """(task, acc) of the newest scores file; an error if there is none."""
    if not exists(spark, f"{folder}/scores_*.json"):
        raise FileNotFoundError(f"no scores in {folder}")
    files = spark.read.option("pathGlobFilter", "scores_*.json").text(folder, wholetext=True)
    newest = files.select("value", F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("p")).agg(F.max_by("value", F.struct("t", "p")).alias("v"))
    return newest.select(F.explode(F.from_json("v", "map<string,double>")).alias("task", "acc"))


def subject_files(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Rows of one CSV file per subject, with the subject."""
    df = spark.read.option("header", True).csv(f"{folder}/{split}/*.csv")
    return df.withColumn("subject", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1))


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """Token ids as a table of arrays."""
    return spark.read.schema("seq bigint, ids array<int>").parquet(path)


# --- generated corpora


def dirty_texts(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(seq, text): half clean, 15 % with markup, 10 % too short, 10 % copies, 15 % near copies, by a seeded hash."""
    word = lambda i, salt: F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.pmod(F.xxhash64(i, F.lit(seed), salt), F.lit(len(WORDS))) + 1).cast("int"))
    band = F.pmod(F.xxhash64("seq", F.lit(seed)), F.lit(100))
    of = F.when(band >= 75, F.floor(F.col("seq") / 10) * 10).otherwise(F.col("seq"))
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: word(of, k)), " ")
    text = F.when(band < 50, body).when(band < 65, F.concat(F.lit("<p>"), body, F.lit("</p>\n\n\n\n"))).when(band < 75, F.substring(body, 1, 30)).when(band < 85, body).otherwise(F.concat(body, F.lit(" "), word(F.col("seq"), F.lit(0))))
    return spark.range(n).select(F.col("id").alias("seq")).select("seq", text.alias("text"))


# Words of the generated texts.
WORDS = ("patient", "dose", "symptom", "therapy", "blood", "heart", "clinical", "study", "market", "city", "river", "music", "history", "engine", "language", "garden")
TEMPLATES = {"domain": "The {0} of a {1} depends on the {2} and the {3}.", "general": "A {0} near the {1} has a {2} and a {3}."}


def template_texts(spark: SparkSession, n: int, kind: str, seed: int = 42) -> DataFrame:
    """(pos, text): a template of the kind with its places filled by a seeded hash."""
    half = WORDS[:8] if kind == "domain" else WORDS[8:]
    text = F.lit(TEMPLATES[kind])
    for i in range(4):
        text = F.replace(text, F.lit("{%d}" % i), F.element_at(F.array(*[F.lit(w) for w in half]), (F.pmod(F.xxhash64("id", F.lit(seed + i)), F.lit(len(half))) + 1).cast("int")))
    return spark.range(n).select(F.col("id").alias("pos"), text.alias("text"))
