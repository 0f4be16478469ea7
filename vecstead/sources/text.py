"""Text sources and sinks: embeddings, vocabularies, predictions, logs, result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecstead.schema import BY_NAME, EMBEDDING

_SPACE = r"[ \t\r\n\f]+"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line), lines counted from 0 in each file.

    Lines are counted in the splits that the scan makes of a file, a task each at most, and what stands in the splits
    before is added, so a large file isn't sorted as a whole.
    """
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    counts = rows.groupBy("path", "block").agg(F.count("*").alias("n"))
    before = counts.select("path", "block", (F.sum("n").over(_by("path", "block")) - F.col("n")).alias("before"))
    place = F.row_number().over(_by(["path", "block"], "at")) - 1
    numbered = rows.withColumn("place", place).join(before, ["path", "block"])
    return numbered.select("path", (F.col("place") + F.col("before")).cast("bigint").alias("line_no"), "line")


def _by(key: str | list[str], *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


def parse_embedding_lines(lines: DataFrame) -> DataFrame:
    """`lines` (line_no, line) as an embedding.

    Trailing space is stripped. A first line of exactly two tokens is a header and dropped. The dimension is the token
    count of the first data line less one; the last that many tokens of a line are the vector, and what stands before,
    spaces and all, is the word. Lines with fewer tokens than the dimension raise.
    """
    lines = lines.select("line_no", F.rtrim(F.regexp_replace("line", r"\s+$", "")).alias("line"))
    head = lines.orderBy("line_no").limit(2).collect()
    header = bool(head) and len(head[0].line.split()) == 2
    data = head[1:] if header else head
    if not data:
        return lines.sparkSession.createDataFrame([], EMBEDDING)
    dim = len(data[0].line.split()) - 1
    if header:
        lines = lines.where(F.col("line_no") != head[0].line_no)
    tokens = F.split("line", " ")
    enough = F.when(F.size(tokens) >= dim, tokens).otherwise(F.raise_error(F.concat(F.lit("too few numbers in: "), "line")).cast("array<string>"))
    parsed = lines.select("line_no", enough.alias("t"))
    word = F.when(F.size("t") > dim, F.array_join(F.slice("t", F.lit(1), F.greatest(F.size("t") - dim, F.lit(0))), " ")).otherwise(F.lit(""))
    return parsed.select((F.col("line_no") - int(header)).alias("rank"), word.alias("word"), F.slice("t", -dim, dim).cast("array<double>").alias("vec"))


def read_embedding(spark: SparkSession, path: str) -> DataFrame:
    return parse_embedding_lines(numbered_lines(spark, path).select("line_no", "line"))


def embedding_line(word: Column | str, vec: Column | str) -> Column:
    """A word and its vector as a line of text, six decimals each."""
    word, vec = (F.col(x) if isinstance(x, str) else x for x in (word, vec))
    return F.concat_ws(" ", word, F.array_join(F.transform(vec, lambda x: F.format_string("%.6f", x)), " "))


def write_embedding(emb: DataFrame, path: str, header: bool = False) -> None:
    """Replaces `path` by one ordered text file of `emb`, a header line `n d` first if asked for.

    The format is one file in order, so one task writes it; its rows stream through and are sorted with spilling.
    """
    rows = emb.select("rank", embedding_line("word", "vec").alias("value"))
    if header:
        n, d = emb.agg(F.count("*"), F.max(F.size("vec"))).first()
        rows = rows.unionByName(emb.sparkSession.createDataFrame([(-1, f"{n} {d or 0}")], "rank bigint, value string"))
    rows.repartitionByRange(1, "rank").sortWithinPartitions("rank").select("value").write.mode("overwrite").text(path)


def from_arrays(spark: SparkSession, vectors: list | None, vocab: list[str] | None) -> DataFrame:
    """An embedding from vectors and words, which come together or not at all."""
    if (vectors is None) != (vocab is None):
        raise ValueError("vectors and vocab must be provided together")
    rows = [(i, w, [float(x) for x in v]) for i, (w, v) in enumerate(zip(vocab or [], vectors or [], strict=True))]
    return spark.createDataFrame(rows, EMBEDDING)


def last_of_each_word(emb: DataFrame) -> DataFrame:
    """Of repeated words the last, as in a word-to-row map."""
    return emb.groupBy("word").agg(F.max_by(F.struct("rank", "vec"), "rank").alias("x")).select("x.rank", "word", "x.vec")


def parse_vocab_words(lines: DataFrame) -> DataFrame:
    """(line_no, word) of the lines with exactly two tokens; others are skipped."""
    tokens = F.split(F.trim("line"), _SPACE)
    return lines.select("line_no", tokens.alias("t")).where(F.size("t") == 2).select("line_no", F.col("t")[0].alias("word"))


def parse_vocab_counts(lines: DataFrame) -> DataFrame:
    """(word, cnt), the last line of a word winning; a malformed line raises."""
    tokens = F.split(F.trim("line"), _SPACE)
    good = F.when(F.size(tokens) == 2, tokens).otherwise(F.raise_error(F.concat(F.lit("not a word and a count: "), "line")).cast("array<string>"))
    rows = lines.select("line_no", good.alias("t")).select("line_no", F.col("t")[0].alias("word"), F.col("t")[1].cast("bigint").alias("cnt"))
    return rows.groupBy("word").agg(F.max_by("cnt", "line_no").alias("cnt"))


def parse_ner_lines(lines: DataFrame, fields: int = 4) -> DataFrame:
    """(line_no, token, gold, pred) of the lines with at least `fields` (three or more) fields between single spaces."""
    cut = F.split("line", " ")
    return lines.select("line_no", cut.alias("f")).where(F.size("f") >= max(3, fields)).select("line_no", F.col("f")[0].alias("token"), F.col("f")[1].alias("gold"), F.col("f")[2].alias("pred"))


def line_from_end(lines: DataFrame, place: int) -> DataFrame:
    """(path, line): of each path the `place`-th line from its end, counted from 1."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("line_no")))
    return lines.withColumn("at", at).where(F.col("at") == place).select("path", F.trim("line").alias("line"))


def read_predictions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(model_key, example_id, pred) from the first of `paths` that exists, as runs are named in more than one way."""
    for path in paths:
        if _exists(spark, path):
            return spark.read.parquet(path)
    raise FileNotFoundError(" or ".join(paths))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A result table from CSV, its measures under their canonical names; columns may have dots."""
    head = spark.read.option("header", True).csv(path)
    whole = {"seed", "dim", "bitrate", "space"}
    fields = [T.StructField(c, T.StringType() if c in ("algo", "compress_type") else T.IntegerType() if c in whole else T.DoubleType()) for c in head.columns]
    df = spark.read.schema(T.StructType(fields)).option("header", True).csv(path)
    return df.toDF(*[BY_NAME[c].name if c in BY_NAME else c for c in df.columns])


def write_results(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_summary(summary: DataFrame, metrics: list[str], tasks: list[str], path: str) -> None:
    """`summary` (metric, task, mean, max) as one CSV file of two blocks: a header and the means, a blank line, and the largest.

    A row for each of `metrics`, a column for each of `tasks`; a pair that `summary` lacks stands empty. The table is small.
    """
    found = {(r.metric, r.task): r for r in summary.where(F.col("metric").isin(metrics) & F.col("task").isin(tasks)).collect()}
    cell = lambda m, t, kind: repr(found[m, t][kind]) if (m, t) in found and found[m, t][kind] is not None else ""
    block = lambda kind: [",".join([m, *(cell(m, t, kind) for t in tasks)]) for m in metrics]
    lines = [",".join(["metric", *tasks]), *block("mean"), "", *block("max")]
    rows = summary.sparkSession.createDataFrame(list(enumerate(lines)), "n int, value string")
    rows.repartitionByRange(1, "n").sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """(metric, task, mean, max) of a file of two blocks."""
    lines = numbered_lines(spark, path)
    head = lines.where("line_no = 0").select(F.slice(F.split("line", ","), 2, 1 << 20).alias("tasks"))
    gap = lines.where("line_no > 0 and trim(line) = ''").select(F.col("line_no").alias("gap"))
    cells = F.split("line", ",")
    rows = lines.where("line_no > 0 and trim(line) <> ''").join(F.broadcast(head)).join(F.broadcast(gap))
    rows = rows.select((F.col("line_no") < F.col("gap")).alias("first"), cells[0].alias("metric"), F.inline(F.arrays_zip("tasks", F.slice(cells, 2, 1 << 20).alias("cell")))).toDF("first", "metric", "task", "cell")
    value = F.nullif(F.col("cell"), F.lit("")).cast("double")
    return rows.groupBy("metric", "task").agg(F.max(F.when(F.col("first"), value)).alias("mean"), F.max(F.when(~F.col("first"), value)).alias("max"))


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.select("example_id", "pred").write.mode("overwrite").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def prediction_paths(folder: str, name: str, validation: bool = False) -> list[str]:
    """Where a run's predictions may stand: with validation, its `.val` file, else the plain one; without, the plain one."""
    plain = f"{folder}/{name}.pred"
    return [f"{folder}/{name}.val.pred", plain] if validation else [plain]


def missing_artifacts(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of `paths` that don't exist; a sweep is complete without any."""
    return [x for x in paths if not _exists(spark, x)]


# The store of results: a folder for each (algo, metric), so that measures are computed and replaced one by one.

STORE_KEYS = ("seed", "dim", "lr", "bitrate", "compress_type", "space")


def store_result(values: DataFrame, folder: str, algo: str, metric: str) -> None:
    """Replaces one measure's values (STORE_KEYS, value) of one algorithm."""
    values.select(*STORE_KEYS, F.col("value").cast("double").alias("value")).write.mode("overwrite").parquet(f"{folder}/algo={algo}/metric={metric.replace('.', '%2E')}")


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """(algo, metric, STORE_KEYS, value) of all that is stored; only the asked-for algorithms and metrics are read."""
    rows = spark.read.option("basePath", folder).parquet(folder)
    return rows.select(F.col("algo").cast("string").alias("algo"), F.regexp_replace(F.col("metric").cast("string"), "%2E", ".").alias("metric"), *STORE_KEYS, "value")


def gather_store(spark: SparkSession, folder: str, metrics: list[str]) -> DataFrame:
    """A wide result table of the store, a column for each of `metrics`; cells that some metric lacks are left out."""
    rows = read_store(spark, folder).where(F.col("metric").isin(metrics))
    names = [f"m{i}" for i in range(len(metrics))]  # metrics may have dots
    wide = rows.groupBy("algo", *STORE_KEYS).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(n) for m, n in zip(metrics, names)])
    return wide.dropna(subset=names).toDF("algo", *STORE_KEYS, *metrics)


# The columns of the figures' series.
FIGURE = {"x": "Disagreement|x", "y": "Disagreement|y", "yerr": "Disagreement|y_std"}


def write_figure(series: DataFrame, path: str) -> None:
    """A pre-aggregated series (x, y, yerr) as CSV under the figures' names."""
    series.select(*[F.col(c).alias(name) for c, name in FIGURE.items()]).orderBy(*[F.col(f"`{x}`") for x in FIGURE.values()]).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_figure(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"`{name}` double" for name in FIGURE.values())
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.select(*[F.col(f"`{name}`").alias(c) for c, name in FIGURE.items()])
