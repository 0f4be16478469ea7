"""The experiment grid, the names that encode it, and the job table it expands to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecstead.schema import BITRATES, DIMS, DOWNSTREAM_LR, EMBEDDING_LR, END_TAG, SEEDS


def grid(spark: SparkSession, algos: tuple[str, ...] = ("mc",), seeds: tuple[int, ...] = SEEDS, dims: tuple[int, ...] = DIMS, bitrates: tuple[int, ...] = BITRATES) -> DataFrame:
    """(algo, seed, dim, bitrate, space), all combinations of the few values given."""
    one = spark.range(1)
    for name, values in (("algo", algos), ("seed", seeds), ("dim", dims), ("bitrate", bitrates)):
        one = one.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return one.select("algo", "seed", "dim", "bitrate", (F.col("dim") * F.col("bitrate")).alias("space"))


def cells_of(results: DataFrame) -> DataFrame:
    """(algo, seed, dim, bitrate, space): the cells that a result table has."""
    return results.select("algo", "seed", "dim", "bitrate", (F.col("dim") * F.col("bitrate")).alias("space")).distinct()


def _choice(column: Column, values: dict) -> Column:
    out = F.lit(None)
    for key, value in values.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def embedding_name(folder: str, year: int) -> Column:
    """The file name that encodes (algo, seed, dim)."""
    plain = F.format_string(f"{folder}/%s_wiki.en.txt_{year}_seed_%d_dim_%d", "algo", "seed", "dim")
    tagged = F.concat(plain, F.lit("_lr_"), _choice(F.col("algo"), {k: str(v) for k, v in EMBEDDING_LR.items()}), F.lit("."), _choice(F.col("algo"), END_TAG))
    return F.when(F.col("algo") == "ft_sg", F.concat(plain, F.lit(".vec"))).otherwise(tagged)


def compress_jobs(cells: DataFrame, folder1: str, folder2: str) -> DataFrame:
    """(algo, seed, dim, bitrate, year, source, base, target): two jobs for each cell, the newer one aligned to the older."""
    old, new = embedding_name(folder1, 2017), embedding_name(folder2, 2018)
    tag = F.concat(F.lit("_br_"), F.col("bitrate").cast("string"))
    jobs = F.array(
        F.struct(F.lit(2017).alias("year"), old.alias("source"), F.lit(None).cast("string").alias("base"), F.concat(old, tag).alias("target")),
        F.struct(F.lit(2018).alias("year"), new.alias("source"), old.alias("base"), F.concat(new, tag, F.lit("_same_range")).alias("target")),
    )
    return cells.select("algo", "seed", "dim", "bitrate", F.inline(jobs))


def parse_names(names: DataFrame, column: str = "name") -> DataFrame:
    """`names` with the seed and dim that each encodes, null where it doesn't."""
    base = F.element_at(F.split(F.col(column), "/"), -1)
    number = lambda key: F.nullif(F.regexp_extract(base, rf"(?:^|_){key}_(\d+)", 1), F.lit("")).cast("int")
    return names.withColumns({"seed": number("seed"), "dim": number("dim")})


def model_jobs(names: DataFrame, task: str, lr: float, model: str = "la", dataset: str | None = None, predict: bool = False, crf: bool = False, finetune: bool = False, model_seed: int | None = None, data_seed: int | None = None, seed_test: bool = False) -> DataFrame:
    """A training job for each embedding name: (name, seed, dim, task, arguments, result)."""
    jobs = parse_names(names)
    seed = F.col("seed").cast("string")
    base = F.element_at(F.split(F.col("name"), "/"), -1)
    parts = [F.lit(f"--task {task} --lr {lr} --seed "), seed]
    if task == "sentiment":
        if dataset is None:
            raise ValueError("a sentiment job needs a dataset")
        result = F.concat(base, F.lit(f"/{dataset}"))
        parts.append(F.lit(f" --model {model} --dataset {'sst' if dataset == 'sst2' else dataset} --no_normalize"))
        parts += [F.lit(" --finetune")] * finetune
        parts += [F.lit(f" --model_seed {model_seed}")] * (model_seed is not None) + [F.lit(f" --data_seed {data_seed}")] * (data_seed is not None)
        if seed_test:
            later = (F.col("seed") + 1000).cast("string")
            parts += [F.lit(" --model_seed "), later, F.lit(" --data_seed "), later]
    else:
        result = F.concat(base, F.lit(f"/ner_{'crf' if crf else 'no_crf'}_lr_{lr}"))
        parts += [F.lit(" --crf")] * crf
    parts += [F.lit(" --predict")] * predict
    return jobs.select("name", "seed", "dim", F.lit(task).alias("task"), F.concat(*parts).alias("arguments"), result.alias("result"))


def measure_tag(dist: str, model: str | None = None, task: str | None = None, exp: float | None = None, no_norm: bool = False, symmetric: bool = False, truncate: int = -1, random: bool = False, nquery: int = 1000, nneighbors: int = 10, tag: str | None = None, validation: bool = False, seed_test: bool = False) -> str:
    """The result column's name that a measure's options make."""
    parts = [dist if model is None else f"{model}_{task}" if dist == "pred" else f"{model}_{task}_quality"]
    parts += [str(exp)] if exp else []
    parts += ["no_norm"] * no_norm + ["sym"] * symmetric
    parts += [f"top_{truncate}"] if truncate > -1 else []
    parts += ["rand"] * random
    parts += [f"nquery_{nquery}_nn_{nneighbors}"] if dist == "knn" else []
    parts += [tag] if tag is not None else []
    return "_".join([*parts, *["val"] * validation, *["seed_test"] * seed_test])


def file_tag(column: str, dim: int | None = None, compress_type: str | None = None, lr: float | None = None, wiki: bool = False, no_align: bool = False) -> str:
    """The name of the file that holds a result column."""
    parts = [column, *([f"dim_{dim}"] if dim else []), *([compress_type] if compress_type else []), *([f"lr_{lr}"] if lr else []), *["wiki"] * wiki]
    return "_".join(parts) + "no_align" * no_align


def downstream_rates(spark: SparkSession) -> DataFrame:
    """(algo, task, lr) of the downstream models; a fixed table of a few rows. Validation columns share their task's rate."""
    rows = [(a, t + suffix, lr) for a, tasks in DOWNSTREAM_LR.items() for t, lr in tasks.items() for suffix in (("", "_val") if a in ("mc", "w2v_cbow") else ("",))]
    return spark.createDataFrame(rows, "algo string, task string, lr double")


def with_rates(jobs: DataFrame) -> DataFrame:
    """`jobs` (algo, task, ...) with lr; quality columns take their task's."""
    plain = jobs.withColumn("key", F.regexp_replace("task", "_quality", ""))
    rates = downstream_rates(jobs.sparkSession).withColumnRenamed("task", "key")
    return plain.join(F.broadcast(rates), ["algo", "key"], "left").drop("key")
