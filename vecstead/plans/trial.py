"""A result table derived from `lineitem`, so that SQL can rebuild it: sums of integers, and ratios of those."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecstead.schema import BITRATES, DIMS

MEASURES = ["eis", "knn", "sem_disp", "pip", "eigen_overlap"]
TASKS = ["la_sst", "la_mr", "la_subj", "la_mpqa", "rnn_no_crf_ner"]
KEYS = ["algo", "seed", "dim", "lr", "bitrate", "compress_type", "space"]


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """108 rows for each of two algorithms, like a real sweep's: keys, five measures, five tasks and their qualities."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pick = lambda values, key: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))
    rows = lines.select(
        F.when(F.col("l_linenumber") % 2 == 0, "mc").otherwise("w2v_cbow").alias("algo"),
        (F.col("l_orderkey") % 3 + 1234).cast("int").alias("seed"), pick(DIMS, "l_partkey").alias("dim"), pick(BITRATES, "l_suppkey").alias("bitrate"),
        F.col("l_quantity").cast("bigint").alias("q"), F.round(F.col("l_discount") * 100).cast("bigint").alias("d"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("c"),
    )
    sums = rows.groupBy("algo", "seed", "dim", "bitrate").agg(F.count("*").alias("n"), F.sum("q").alias("q"), F.sum("d").alias("d"), F.sum("c").alias("c"))
    of = lambda text: F.expr(text).cast("double")
    tasks = {"la_sst": "(c % 1013) / 10.0D", "la_mr": "(q % 701) / 8.0D", "la_subj": "(d % 503) / 5.0D", "la_mpqa": "(n % 53) / 2.0D", "rnn_no_crf_ner": "(c % 607) / 6.0D"}
    return sums.select(
        "algo", "seed", "dim", F.when(F.col("algo") == "mc", 0.2).otherwise(0.05).alias("lr"), "bitrate", F.lit("uniform").alias("compress_type"), (F.col("dim") * F.col("bitrate")).alias("space"),
        of("d / cast(n as double)").alias("eis"), of("(q % 97) / 97.0D").alias("knn"), of("q / cast(n as double)").alias("sem_disp"), of("(c % 1009) / cast(n as double)").alias("pip"), of("(d % 89) / 89.0D").alias("eigen_overlap"),
        *[of(text).alias(t) for t, text in tasks.items()], *[(100 - of(text)).alias(f"{t}_quality") for t, text in tasks.items()],
    )


SQL = """
trial as (
  select algo, seed, dim, case when algo = 'mc' then 0.2 else 0.05 end::double as lr, bitrate, 'uniform' as compress_type, dim * bitrate as space,
         d / n::double as eis, (q % 97) / 97.0::double as knn, q / n::double as sem_disp, (c % 1009) / n::double as pip, (d % 89) / 89.0::double as eigen_overlap,
         (c % 1013) / 10.0::double as la_sst, (q % 701) / 8.0::double as la_mr, (d % 503) / 5.0::double as la_subj, (n % 53) / 2.0::double as la_mpqa, (c % 607) / 6.0::double as rnn_no_crf_ner
  from (
    select case when l_linenumber % 2 = 0 then 'mc' else 'w2v_cbow' end as algo, (l_orderkey % 3 + 1234)::int as seed,
           ([25, 50, 100, 200, 400, 800])[(l_partkey % 6 + 1)::int] as dim, ([1, 2, 4, 8, 16, 32])[(l_suppkey % 6 + 1)::int] as bitrate,
           count(*) as n, sum(l_quantity::bigint)::bigint as q, sum(round(l_discount * 100)::bigint)::bigint as d, sum(round(l_extendedprice * 100)::bigint)::bigint as c
    from lineitem group by all)),
ranked as (select *, row_number() over (partition by algo, seed order by dim, bitrate) as rid from trial)
"""
