"""Reading documents and evaluation sets, and writing reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpus_engine.functions.text import strip

# File types by extension.
TYPES = {"pdf": "pdf", "docx": "docx", "doc": "docx", "txt": "txt", "csv": "csv", "xlsx": "excel", "xls": "excel", "md": "markdown"}
TEXT_TYPES = ("txt", "markdown")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_type(path: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair]), extension(path))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    """One document a text or Markdown file, headings kept."""
    found = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("source"))
    return found.withColumns({"file_name": file_name(F.col("source")), "file_type": file_type(F.col("source"))})


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """One document a row: lines of `column: value`."""
    rows = spark.read.csv(path, header=True)
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in rows.columns]
    return rows.select(F.concat_ws("\n", *lines).alias("text"), F.col("_metadata.file_path").alias("source"))


def scan_directory(spark: SparkSession, path: str, glob: str = "*", exclude: tuple[str, ...] = ()) -> DataFrame:
    """Files of known types below a folder, without paths that hold an excluded part; text types decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    files = files.withColumn("file_type", file_type(F.col("path"))).where("file_type is not null")
    for part in exclude:
        files = files.where(~F.col("path").contains(part))
    return files.withColumn("text", F.when(F.col("file_type").isin(*TEXT_TYPES), F.decode("content", "UTF-8")))


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Name, path, size, type, support and time of every file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return files.select(
        file_name(F.col("path")).alias("name"), "path", F.col("length").alias("size"), extension(F.col("path")).alias("extension"),
        file_type(F.col("path")).alias("type"), file_type(F.col("path")).isNotNull().alias("supported"), F.col("modificationTime").alias("modified"),
    )


def stamp_source_metadata(files: DataFrame, run_ts: str) -> DataFrame:
    """files(path, content[, original_name]) with hash, size, time and an id that reruns agree on."""
    own = files.withColumns({"file_hash": F.sha2("content", 256), "file_size": F.length("content").cast("long"), "uploaded_at": F.lit(run_ts).cast("timestamp")})
    name = file_name(F.col("path"))
    named = F.coalesce(F.col("original_name"), name) if "original_name" in files.columns else name
    return own.withColumns({"doc_id": F.sha2(F.concat_ws("|", "path", "file_hash"), 256), "file_name": named})


def number_pages(pages: DataFrame) -> DataFrame:
    """pages(doc_id, position) with page_number from 1."""
    return pages.withColumn("page_number", F.row_number().over(Window.partitionBy("doc_id").orderBy("position")))


def normalise_reference(ref: Column) -> Column:
    """What follows the first colon, without quotes, commas and white space around it."""
    content = F.regexp_replace(ref, r"^[^:]*:", "")
    return strip(F.regexp_replace(strip(content), r"^\"+|\"+$|^[',]+|[',]+$", ""))


def unwrap(raw: DataFrame) -> DataFrame:
    """Rows of a JSON list, or of the list under data, samples, items or questions."""
    for key in ("data", "samples", "items", "questions"):
        if key in raw.columns and len(raw.columns) == 1:
            return raw.select(F.explode(key).alias("x")).select("x.*")
    return raw


# How multiple-choice answers and references to laws are written.
QUESTION = r"(?s)Question:\s*(.+?)(?:\n[A-D]\.|$)"
ANSWER = r"(?:正确答案[是为：:]+\s*|因此[，,]\s*正确答案是\s*|答案是\s*)([A-D])"
LAST_ANSWER = r"[是为]\s*([A-D])\s*[。.]?\s*$"
REFERENCE = r"《(.+?)》[^》]*?(第[零一二三四五六七八九十百千万\d]+条[之的]?[^\n。，,；;]*)"


def mcq_question(text: Column) -> Column:
    found = F.nullif(F.regexp_extract(text, QUESTION, 1), F.lit(""))
    cut = F.regexp_replace(F.regexp_extract(text, r"(?s)^(.*?)(?:\nA[.、 ]|$)", 1), r"(?i)^\s*question:", "")
    return strip(F.coalesce(found, cut))


def mcq_answer(output: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(output, ANSWER, 1), F.lit("")), F.nullif(F.regexp_extract(output, LAST_ANSWER, 1), F.lit("")))


def law_references(text: Column) -> Column:
    names, parts = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)), F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(2))
    return F.zip_with(names, parts, lambda n, p: F.concat(n, F.regexp_replace(F.trim(p), "[。，,；;、]+$", "")))


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    """QA (question, reference) or multiple choice (input, output) samples, told apart by their fields."""
    rows = unwrap(spark.read.json(path, multiLine=True))
    names = set(rows.columns)
    if {"question", "reference"} <= names:
        rows = rows.where(F.trim("question") != "")
        answer = F.nullif(F.trim("answer"), F.lit("")) if "answer" in names else F.lit(None).cast("string")
        return rows.select(
            strip(F.col("question")).alias("question"), F.transform("reference", normalise_reference).alias("ground_truth"), answer.alias("reference_answer"),
            F.lit("qa").alias("source_type"),
        )
    if {"input", "output"} <= names:
        return rows.where(F.trim("input") != "").select(
            mcq_question(F.col("input")).alias("question"), law_references(F.col("output")).alias("ground_truth"), mcq_answer(F.col("output")).alias("reference_answer"),
            F.lit("mcq").alias("source_type"),
        )
    return spark.createDataFrame([], "question string, ground_truth array<string>, reference_answer string, source_type string")


def limit_per_dataset(samples: DataFrame, n: int) -> DataFrame:
    """The first n samples of each dataset(dataset, position)."""
    place = F.row_number().over(Window.partitionBy("dataset").orderBy("position"))
    return samples.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def merge_datasets(parts: list[DataFrame]) -> DataFrame:
    """The samples of several sets one after the other, with `dataset`, the place of theirs; a fixed list of sets."""
    out = None
    for number, part in enumerate(parts):
        part = part.withColumn("dataset", F.lit(number))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def drop_samples_without_truth(samples: DataFrame) -> DataFrame:
    return samples.where(F.size("ground_truth") > 0)


def metrics_report(metrics: DataFrame, value: str = "recall", ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """stage by k: a matrix of one metric."""
    return metrics.groupBy("stage").pivot("k", list(ks)).agg(F.first(value)).toDF("stage", *[f"at_{k}" for k in ks])


def _markdown(rows: DataFrame, order: list[str]) -> str:
    """A table of a few rows as Markdown: fractions with four decimals, null as N/A."""
    shown = lambda v: "N/A" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(shown, r)) + " |" for r in rows.orderBy(*order).collect()])


def write_metrics_report(metrics: DataFrame, path: str, generation: DataFrame | None = None, ks: tuple[int, ...] = (1, 3, 5, 10)) -> str:
    """Write metrics (and generation, a row of means) as JSON lines; give them as Markdown tables.

    The tables: each stage and cut, recall by stage and cut, and the generation metrics if given. All have a few rows;
    stages and cuts that are missing show N/A.
    """
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    parts = {"Stages": _markdown(metrics, ["stage", "k"]), "Recall at k": _markdown(metrics_report(metrics, ks=ks), ["stage"])}
    if generation is not None:
        generation.coalesce(1).write.mode("overwrite").json(f"{path}/generation")
        parts["Generation"] = _markdown(generation, generation.columns)
    return "\n\n".join(f"## {name}\n\n{table}" for name, table in parts.items())
