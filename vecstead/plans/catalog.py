"""The library's queries over the driver's tables, and their SQL.

Of `embeddings`, vec_id is both word and rank; version A is the first 32 entries of each vector, version B the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecstead.functions.shared import new_folder
from vecstead.functions.vectors import doubles, norm, quantized, section, total
from vecstead.operators import align, compress, downstream, measures, stats
from vecstead.plans import grid, sweep, trial
from vecstead.plans.trial import MEASURES, TASKS, trials
from vecstead.schema import higher_is_stable
from vecstead.sources import text
from vecstead.streaming import drift

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def embedding(spark: SparkSession, sf_dir: str, first: int = 1, size: int = 64) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("rank"), F.col("vec_id").cast("string").alias("word"), section(doubles("embedding"), first, size).alias("vec"))


def pair(spark: SparkSession, sf_dir: str, size: int = 32, second: int = 33, n: int = -1) -> DataFrame:
    return align.shared(embedding(spark, sf_dir, 1, size), embedding(spark, sf_dir, second, size), n)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounded columns, with no negative zero."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def one(spark: SparkSession, name: str, number: float) -> DataFrame:
    return rounded(measures.value(spark, name, number), name)


EMB = "emb as (select vec_id as rank, vec_id::varchar as word, embedding::double[] as v from embeddings)"
AB = f"{EMB}, p as (select rank, word, v[1:32] as x, v[33:64] as y from emb)"
DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i] * {1}[i]))"


def dot_sql(a: str, b: str) -> str:
    return DOT.format(a, b)


# Sources and sinks, lookups


@query("emb_text_roundtrip", f"""with {EMB} select rank, word, len(v) as dim, round(list_sum(list_transform(v, lambda x: printf('%.6f', x)::double)), 6) + 0.0 as total from emb""")
def emb_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = embedding(spark, sf_dir).select(F.col("rank").alias("line_no"), text.embedding_line("word", "vec").alias("line"))
    back = text.parse_embedding_lines(lines)
    return rounded(back.select("rank", "word", F.size("vec").cast("bigint").alias("dim"), total("vec").alias("total")), "total")


@query("emb_normalize", f"""with {AB} select rank, round(sqrt({dot_sql('x', 'x')}), 6) as norm, round(x[1] / sqrt({dot_sql('x', 'x')}), 6) + 0.0 as first from p""")
def emb_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = embedding(spark, sf_dir, 1, 32).withColumn("norm", norm("vec"))
    return rounded(align.normalize(emb).select("rank", "norm", F.col("vec")[0].alias("first")), "norm", "first")


WANTED = [7, 3, 11, 3, 250, 499, 0]


@query("emb_subembed", f"""with {EMB}, w as (select unnest({WANTED}) as word, unnest(range({len(WANTED)})) as pos)
select pos::bigint as pos, emb.word, round(list_sum(v), 6) + 0.0 as total from w join emb on emb.rank = w.word""")
def emb_subembed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.subembedding(embedding(spark, sf_dir), [str(w) for w in WANTED])
    return rounded(found.select("pos", "word", total("vec").alias("total")), "total")


@query("emb_represent_oov", f"""with {EMB}, w as (select (r * 37)::varchar as word from range(100) t(r))
select w.word, emb.word is null as oov, round(coalesce(list_sum(v), 0.0), 6) + 0.0 as total from w left join emb using (word)""")
def emb_represent_oov(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, emb = spark.range(100).select((F.col("id") * 37).cast("string").alias("word")), embedding(spark, sf_dir)
    oov = align.out_of_vocabulary(words, emb).withColumn("oov", F.lit(True)).unionByName(align.in_vocabulary(words, emb).withColumn("oov", F.lit(False)))
    return rounded(align.represent(oov, emb, 64).select("word", "oov", total("vec").alias("total")), "total")


@query("emb_shared_topn", f"""with {EMB} select a.rank, a.word, round(list_sum(a.v), 6) + 0.0 as sx, round(list_sum(b.v), 6) + 0.0 as sy
from emb a join emb b using (word) where a.v[1] > 0 and b.v[2] > 0 order by a.rank limit 50""")
def emb_shared_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two vocabularies that overlap in part: the words whose first, or second, entry is positive."""
    emb = embedding(spark, sf_dir)
    both = align.shared(emb.where(F.col("vec")[0] > 0), emb.where(F.col("vec")[1] > 0), 50)
    return rounded(both.select("rank", "word", total("x").alias("sx"), total("y").alias("sy")), "sx", "sy")


@query("emb_random_vocab", f"with {EMB} select rank, word from emb order by md5(word || '1234'), word limit 40")
def emb_random_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.shared(embedding(spark, sf_dir, 1, 32), embedding(spark, sf_dir, 33, 32), 40, random=True).select("rank", "word")


@query("emb_vocabulary", f"with {EMB} select rank, word from emb")
def emb_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.vocabulary(embedding(spark, sf_dir))


@query("anchor_bundle", f"""with {EMB} select rank, word, round(list_sum(v[1:16]), 6) + 0.0 as se, round(list_sum(v[17:32]), 6) + 0.0 as sf from emb order by rank limit 300""")
def anchor_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors on their 300 commonest shared words, stored and read again."""
    path = new_folder(spark, "anchors")
    align.write_anchors(align.anchor_bundle(embedding(spark, sf_dir, 1, 16), embedding(spark, sf_dir, 17, 16), 300), path)
    return rounded(align.read_anchors(spark, path).select("rank", "word", total("e").alias("se"), total("f").alias("sf")), "se", "sf")


@query("emb_file_roundtrip", f"""with {EMB} select rank, word, len(v) as dim, round(list_sum(list_transform(v, lambda x: printf('%.6f', x)::double)), 6) + 0.0 as total from emb""")
def emb_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An embedding written as a text file with a header, and read again."""
    path = new_folder(spark, "embedding")
    text.write_embedding(embedding(spark, sf_dir), path, header=True)
    back = text.read_embedding(spark, path)
    return rounded(back.select("rank", "word", F.size("vec").cast("bigint").alias("dim"), total("vec").alias("total")), "total")


@query("vocab_words", r"""with w as (select item_id, unnest(range(1, len(string_split(text, ' ')) + 1)) as pos, unnest(string_split(text, ' ')) as word from benchmark)
select item_id * 1000000 + pos as line_no, word from w where word <> '' and not regexp_matches(word, '\s')""")
def vocab_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.posexplode(F.split("text", " ")).alias("at", "w")).where(r"w <> '' and not w rlike '\\s'")
    lines = words.select((F.col("item_id") * 1_000_000 + F.col("at") + 1).alias("line_no"), "w")
    good, bad = lines.select("line_no", F.concat("w", F.lit(" 1")).alias("line")), lines.select("line_no", F.concat("w", F.lit(" a b")).alias("line"))
    return text.parse_vocab_words(good.unionByName(bad))


@query("vocab_counts", r"""select word, count(*) as cnt from (select unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) as word from benchmark) where word <> '' group by word""")
def vocab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("word")).where("word <> ''")
    lines = words.groupBy("word").count().select(F.concat_ws(" ", "word", "count").alias("line"), F.lit(0).alias("line_no"))
    return text.parse_vocab_counts(lines)


# Measures


@query("fro_norm", f"""with {AB} select round(sqrt(sum(list_sum(list_transform(range(1, 33), lambda i: (x[i] - y[i]) * (x[i] - y[i]))))), 6) as fro_norm from p""")
def fro_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measures.fro_norm(pair(spark, sf_dir)), "fro_norm")


PIP_SQL = f"""with {EMB}, p as (select rank, v[1:{{0}}] as x, v[33:64] as y from emb)
select round(sqrt(sum(pow(list_dot_product(a.x, b.x) - list_dot_product(a.y, b.y), 2))), 6) as pip from p a cross join p b"""


@query("pip_loss", PIP_SQL.format(32))
def pip_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one(spark, "pip", measures.pip_loss(pair(spark, sf_dir)))


@query("pip_loss_two_widths", PIP_SQL.format(16))
def pip_loss_two_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = align.shared(embedding(spark, sf_dir, 1, 16), embedding(spark, sf_dir, 33, 32))
    return one(spark, "pip", measures.pip_loss(pairs))


COS = f"1 - {dot_sql('x', 'y')} / (sqrt({dot_sql('x', 'x')}) * sqrt({dot_sql('y', 'y')}))"


@query("sem_disp_unaligned", f"with {AB} select round(avg({COS}), 6) as sem_disp from p")
def sem_disp_unaligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measures.sem_disp(pair(spark, sf_dir), aligned=False), "sem_disp")


@query("sem_disp_per_word", f"with {AB} select rank, word, round({COS}, 6) + 0.0 as distance from p")
def sem_disp_per_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measures.sem_disp_words(pair(spark, sf_dir), aligned=False), "distance")


ROTATED_2D = f"""with {EMB}, p as (select rank, v[1] as x1, v[2] as x2, v[3] as y1, v[4] as y2 from emb),
m as (select sum(x1 * y1) as a, sum(x1 * y2) as b, sum(x2 * y1) as c, sum(x2 * y2) as d from p),
r as (select case when a * d - b * c >= 0 then (a + d) / sqrt(pow(a + d, 2) + pow(b - c, 2)) else (a - d) / sqrt(pow(a - d, 2) + pow(b + c, 2)) end as r11,
             case when a * d - b * c >= 0 then (b - c) / sqrt(pow(a + d, 2) + pow(b - c, 2)) else (b + c) / sqrt(pow(a - d, 2) + pow(b + c, 2)) end as r12,
             a * d - b * c >= 0 as proper from m),
t as (select rank, y1, y2, x1 * r11 + x2 * (case when proper then -r12 else r12 end) as z1, x1 * r12 + x2 * (case when proper then r11 else -r11 end) as z2 from p cross join r)
"""


@query("procrustes_align_2d", ROTATED_2D + "select rank, round(z1, 6) + 0.0 as z1, round(z2, 6) + 0.0 as z2 from t")
def procrustes_align_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = measures.align_to(embedding(spark, sf_dir, 1, 2), embedding(spark, sf_dir, 3, 2))
    return rounded(moved.select("rank", F.col("vec")[0].alias("z1"), F.col("vec")[1].alias("z2")), "z1", "z2")


@query("sem_disp_aligned_2d", ROTATED_2D + "select round(avg(1 - (z1 * y1 + z2 * y2) / (sqrt(z1 * z1 + z2 * z2) * sqrt(y1 * y1 + y2 * y2))), 6) as sem_disp from t")
def sem_disp_aligned_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measures.sem_disp(pair(spark, sf_dir, 2, 3)), "sem_disp")


@query("sem_disp_aligned")
def sem_disp_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measures.sem_disp(pair(spark, sf_dir)), "sem_disp")


SIMILAR = f"""with {AB}, u as (select rank, list_transform(x, lambda a: a / sqrt({dot_sql('x', 'x')})) as x, list_transform(y, lambda a: a / sqrt({dot_sql('y', 'y')})) as y from p),
s as (select q.rank as query, c.rank, list_dot_product(q.x, c.x) as sx, list_dot_product(q.y, c.y) as sy from u q join u c on q.rank <> c.rank where q.rank % 100 = 0),
n as (select *, row_number() over (partition by query order by sx desc, rank) as px, row_number() over (partition by query order by sy desc, rank) as py from s)
"""


@query("nearest_neighbors", SIMILAR + "select query, rank, round(sx, 6) + 0.0 as similarity, px::int as place from n where px <= 5")
def nearest_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = embedding(spark, sf_dir, 1, 32)
    return rounded(measures.nearest(emb, emb.where("rank % 100 = 0"), 5), "similarity")


@query("knn_overlap", SIMILAR + """select round(avg(share), 6) as knn from (
select query, count(*) filter (px <= 5 and py <= 5) / 5.0::double as share from n group by query)""")
def knn_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pair(spark, sf_dir)
    return rounded(measures.knn(pairs, k=5, queries=pairs.where("rank % 100 = 0")), "knn")


DRAWN = SIMILAR.replace("where q.rank % 100 = 0", "where q.rank in (select rank from emb order by md5(rank::varchar || '1234'), rank limit 30)")


@query("knn_drawn_queries", DRAWN + """select round(avg(share), 6) as knn from (
select query, count(*) filter (px <= 5 and py <= 5) / 5.0::double as share from n group by query)""")
def knn_drawn_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measures.knn(pair(spark, sf_dir), nquery=30, k=5), "knn")


def _gram2(*names: str) -> str:
    """SQL: sums of products of 2-wide blocks; the n-th block's entries are v[2n - 1] and v[2n]."""
    sums = [f"sum({a}{i} * {b}{j}) as {a}{b}{i}{j}" for a in names for b in names for i in (1, 2) for j in (1, 2)]
    cols = ", ".join(f"v[{2 * k + i}] as {n}{i}" for k, n in enumerate(names) for i in (1, 2))
    return f"with {EMB}, p as (select {cols} from emb), g as (select {', '.join(sums)} from p)"


class M2:
    """A 2 x 2 matrix of SQL expressions."""

    def __init__(self, *cells: str) -> None:
        self.a, self.b, self.c, self.d = cells

    def __matmul__(self, o: M2) -> M2:
        return M2(f"({self.a}*{o.a}+{self.b}*{o.c})", f"({self.a}*{o.b}+{self.b}*{o.d})", f"({self.c}*{o.a}+{self.d}*{o.c})", f"({self.c}*{o.b}+{self.d}*{o.d})")

    @property
    def inv(self) -> M2:
        det = f"({self.a}*{self.d}-{self.b}*{self.c})"
        return M2(f"({self.d}/{det})", f"(-{self.b}/{det})", f"(-{self.c}/{det})", f"({self.a}/{det})")

    @property
    def trace(self) -> str:
        return f"({self.a}+{self.d})"


def _g(a: str, b: str) -> M2:
    return M2(*[f"{a}{b}{i}{j}" for i in (1, 2) for j in (1, 2)])


def _power(m: M2, n: int) -> M2:
    return M2("1.0", "0.0", "0.0", "1.0") if n == 0 else m if n == 1 else m @ _power(m, n - 1)


def _instability(anchor: str, exp: int) -> str:
    w = _power(_g(anchor, anchor), exp - 1)
    t1 = (_g("x", "x").inv @ _g("x", anchor) @ w @ _g(anchor, "x")).trace
    t2 = (_g("y", "y").inv @ _g("y", anchor) @ w @ _g(anchor, "y")).trace
    t3 = (_g("y", "y").inv @ _g("y", "x") @ _g("x", "x").inv @ _g("x", anchor) @ w @ _g(anchor, "y")).trace
    return f"({t1}+{t2}-2*{t3})"


@query("eigen_overlap_2d", f"{_gram2('x', 'y')} select round({(_g('x', 'x').inv @ _g('x', 'y') @ _g('y', 'y').inv @ _g('y', 'x')).trace} / 2, 6) as eigen_overlap from g")
def eigen_overlap_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one(spark, "eigen_overlap", measures.eigen_overlap(pair(spark, sf_dir, 2, 3)))


@query("eigen_overlap")
def eigen_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one(spark, "eigen_overlap", measures.eigen_overlap(pair(spark, sf_dir)))


def _weo(exp: int) -> str:
    w = _power(_g("y", "y"), exp - 1)
    return f"select {exp} as exp, round({(_g('x', 'x').inv @ _g('x', 'y') @ w @ _g('y', 'x')).trace} / {_power(_g('y', 'y'), exp).trace}, 6) as weighted from g"


@query("weighted_eigen_overlap_2d", f"{_gram2('x', 'y')} {_weo(1)} union all {_weo(2)}")
def weighted_eigen_overlap_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pair(spark, sf_dir, 2, 3)
    return rounded(spark.createDataFrame([(e, measures.weighted_eigen_overlap(pairs, e)) for e in (1, 2)], "exp int, weighted double"), "weighted")


def _quads(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    parts = [embedding(spark, sf_dir, 1 + k * size, size) for k in range(4)]
    return align.with_anchors(*parts)


@query("eis_2d", f"{_gram2('x', 'y', 'e', 'f')} select round(({_instability('e', 3)} + {_instability('f', 3)}) / ({_power(_g('e', 'e'), 3).trace} + {_power(_g('f', 'f'), 3).trace}), 6) as eis from g")
def eis_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one(spark, "eis", measures.eis(_quads(spark, sf_dir, 2)))


@query("eis")
def eis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one(spark, "eis", measures.eis(_quads(spark, sf_dir, 16)))


# Compression


def _levels(bits: str) -> str:
    return f"(floor((greatest(least(a, r), -r) + r) / (2 * r / ({bits} - 1)) + 0.5) * (2 * r / ({bits} - 1)) - r)"


BOUND = f"{AB}, b as (select max(list_max(list_transform(x, lambda a: abs(a)))) as r from p)"


@query("quantize_uniform", f"""with {BOUND} select bits, rank, round(list_sum(list_transform(x, lambda a: {_levels('pow(2, bits)')})), 6) + 0.0 as total
from p cross join b cross join (select unnest([1, 2, 4, 8]) as bits)""")
def quantize_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = embedding(spark, sf_dir, 1, 32)
    r = compress.largest(emb)
    out = emb.select("rank", F.inline(F.array(*[F.struct(F.lit(b).alias("bits"), total(quantized("vec", b, r)).alias("total")) for b in (1, 2, 4, 8)])))
    return rounded(out, "total")


@query("quantize_error_sweep", f"""with {EMB}, c as (select dim, v[1:dim] as x from emb cross join (select unnest([16, 32, 64]) as dim)),
b as (select dim, max(list_max(list_transform(x, lambda a: abs(a)))) as r from c group by dim)
select c.dim, bits, round(sum(list_sum(list_transform(x, lambda a: pow({_levels('pow(2, bits)')} - a, 2)))), 6) as squared_error
from c join b using (dim) cross join (select unnest([1, 2, 4, 8]) as bits) group by c.dim, bits""")
def quantize_error_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compress.squared_errors(embedding(spark, sf_dir), [16, 32, 64], [1, 2, 4, 8]), "squared_error")


def _adaptive_sql() -> str:
    grid = "select bits, i, {r} as r from b cross join (select unnest(range(1, 33)) as i)"
    errors = f"select bits, i, any_value(r) as r, sum(pow({_levels('pow(2, bits)')} - a, 2)) as e from entries cross join {{c}} group by bits, i"
    return f"""with {AB}, entries as (select unnest(x) as a from p), b as (select bits, (select max(abs(a)) from entries) as top from (select unnest([1, 2, 4, 8]) as bits)),
c1 as ({grid.format(r="top * i / 32.0::double")}), e1 as ({errors.format(c="c1")}), m1 as (select bits, arg_min(i, (e, i)) as best from e1 group by bits),
w as (select bits, case when best > 1 then top * (best - 1) / 32.0::double else top / 32.0::double / 32 end as lo, top * least(best + 1, 32) / 32.0::double as hi from m1 join b using (bits)),
c2 as (select bits, i, case i when 32 then hi else lo + (i - 1) * ((hi - lo) / 31.0::double) end as r from w cross join (select unnest(range(1, 33)) as i)), e2 as ({errors.format(c="c2")})
select bits, round(arg_min(r, (e, i)), 6) + 0.0 as bound, round(min(e), 6) + 0.0 as squared_error from e2 group by bits union all select 32, round((select any_value(top) from b), 6), 0.0"""


@query("quantize_adaptive", _adaptive_sql())
def quantize_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb, rows = embedding(spark, sf_dir, 1, 32), []
    for bits in (1, 2, 4, 8, 32):
        r = compress.best_bound(emb, bits)
        rows.append((bits, r, compress.squared_error(emb, bits, r).first().squared_error))
    return rounded(spark.createDataFrame(rows, "bits int, bound double, squared_error double"), "bound", "squared_error")


@query("quantized_store", f"""with {BOUND} select bitrate, rank, round(list_sum(list_transform(x, lambda a: {_levels('pow(2, bitrate)')})), 6) + 0.0 as total
from p cross join b cross join (select unnest([2, 8]) as bitrate)""")
def quantized_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of two bitrates on the largest entry's range, written a folder each and read again."""
    emb, path = embedding(spark, sf_dir, 1, 32), new_folder(spark, "quantized")
    compress.write_quantized(emb, [2, 8], path, bound=compress.largest(emb))
    return rounded(compress.read_quantized(spark, path).select("bitrate", "rank", total("vec").alias("total")), "total")


@query("compressed_sweep")
def compressed_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.compressed_sweep(embedding(spark, sf_dir, 1, 32), embedding(spark, sf_dir, 33, 32), [8, 32], [1, 4], n=-1)


@query("stability_table")
def stability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep's whole result table: distances, and the disagreement and quality of classifiers of the benchmark's items."""
    lines = _sentences(spark, sf_dir)
    second = F.crc32(F.col("example_id").cast("string")) % 2 == 0
    tasks = {"parity": (lines.where(~second), lines.where(second))}
    first, other = (_named_by_words(spark, sf_dir, k) for k in (1, 33))
    return sweep.compressed_sweep(first, other, [32], [1, 8], n=-1, tasks=tasks)


# Grid, names, jobs

# The grid is that of the trials, so jobs follow the table.
GRID_SQL = f"{trial.SQL.strip()}, g as (select distinct algo, seed, dim, bitrate, dim * bitrate as space from trial)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.cells_of(trials(spark, sf_dir))


@query("experiment_grid", f"with {GRID_SQL} select * from g")
def experiment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


NAMED = """n as (select *, algo || '_wiki.en.txt_' || year || '_seed_' || seed || '_dim_' || dim
  || case algo when 'mc' then '_lr_0.2.50.txt' else '_lr_0.05.50.w.txt' end as base from g cross join (select unnest([2017, 2018]) as year))"""


@query("compress_jobs", f"""with {GRID_SQL}, {NAMED} select algo, seed, dim, bitrate, year, case year when 2017 then 'old/' else 'new/' end || base as source,
case year when 2018 then 'old/' || replace(base, 'txt_2018', 'txt_2017') end as base, case year when 2017 then 'old/' || base || '_br_' || bitrate else 'new/' || base || '_br_' || bitrate || '_same_range' end as target from n""")
def compress_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.compress_jobs(_cells(spark, sf_dir), "old", "new")


@query("path_parse", f"with {GRID_SQL}, {NAMED} select distinct 'old/' || base as name, seed, dim from n where year = 2017 union all select 'no_numbers.txt', null, null")
def path_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = grid.compress_jobs(_cells(spark, sf_dir), "old", "new").where("year = 2017").select(F.col("source").alias("name")).distinct()
    return grid.parse_names(names.unionByName(spark.createDataFrame([("no_numbers.txt",)], "name string")))


@query("model_jobs", f"""with {GRID_SQL}, {NAMED}, u as (select distinct base, seed, dim from n where year = 2017)
select 'old/' || base as name, seed, dim, 'sentiment' as task, '--task sentiment --lr 0.001 --seed ' || seed || ' --model la --dataset sst --no_normalize --model_seed ' || (seed + 1000) || ' --data_seed ' || (seed + 1000) || ' --predict' as arguments, base || '/sst2' as result from u
union all select 'old/' || base, seed, dim, 'ner', '--task ner --lr 1.0 --seed ' || seed || ' --crf', base || '/ner_crf_lr_1.0' from u""")
def model_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = grid.compress_jobs(_cells(spark, sf_dir), "old", "new").where("year = 2017").select(F.col("source").alias("name")).distinct()
    return grid.model_jobs(names, "sentiment", 0.001, dataset="sst2", predict=True, seed_test=True).unionByName(grid.model_jobs(names, "ner", 1.0, crf=True))


@query("rate_lookup", f"""with {GRID_SQL}, t as (select distinct algo, unnest(['la_sst', 'la_sst_quality', 'la_mr', 'la_mpqa_val', 'rnn_no_crf_ner', 'unknown']) as task from g),
r(algo, task, lr) as (values ('mc', 'la_sst', 0.001), ('mc', 'la_mr', 0.1), ('mc', 'la_mpqa_val', 0.001), ('mc', 'rnn_no_crf_ner', 1.0), ('w2v_cbow', 'la_sst', 0.0001), ('w2v_cbow', 'la_mr', 0.001), ('w2v_cbow', 'la_mpqa_val', 0.001), ('w2v_cbow', 'rnn_no_crf_ner', 0.1))
select t.algo, t.task, lr::double as lr from t left join r on r.algo = t.algo and r.task = replace(t.task, '_quality', '')""")
def rate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(t) for t in ("la_sst", "la_sst_quality", "la_mr", "la_mpqa_val", "rnn_no_crf_ner", "unknown")])
    return grid.with_rates(_cells(spark, sf_dir).select("algo").distinct().select("algo", F.explode(names).alias("task")))


# Downstream


@query("pred_disagreement", "select round((1 - avg((quality = toxic)::int)) * 100, 6) as disagreement from labels")
def pred_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    models = [labels.select(F.col("doc_id").alias("example_id"), F.col(c).alias("pred")) for c in ("quality", "toxic")]
    return rounded(downstream.disagreement(*models), "disagreement")


def _tag_sql(size: str) -> str:
    return f"case {size} % 4 when 0 then 'O' when 1 then 'PER' when 2 then 'LOC' else 'ORG' end"


def _tag(size: Column) -> Column:
    return F.when(size % 4 == 0, "O").when(size % 4 == 1, "PER").when(size % 4 == 2, "LOC").otherwise("ORG")


@query("ner_disagreement", f"""with t as (select unnest(string_split(text, ' ')) as token from conversations)
select round(avg(({_tag_sql('length(token) // 2')} <> {_tag_sql('length(token) // 3')})::int) * 100, 6) as disagreement from t where {_tag_sql('length(token)')} <> 'O'""")
def ner_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both files' tags of each token stand side by side, so no row moves."""
    size = F.length("token")
    tokens = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.explode(F.split("text", " ")).alias("token"))
    tagged = tokens.select(_tag(size).alias("gold"), _tag(F.floor(size / 2)).alias("first"), _tag(F.floor(size / 3)).alias("second"))
    return rounded(downstream.tag_disagreement(tagged), "disagreement")


@query("ner_file_disagreement", f"""with t as (select unnest(string_split(text, ' ')) as token from benchmark)
select round(avg(({_tag_sql('length(token) // 2')} <> {_tag_sql('length(token) // 3')})::int) * 100, 6) as disagreement from t where {_tag_sql('length(token)')} <> 'O'""")
def ner_file_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two token files, parsed and paired by line."""
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.posexplode(F.split("text", " ")).alias("at", "token"))
    numbered = words.select((F.col("item_id") * 1_000_000 + F.col("at")).alias("line_no"), F.regexp_replace("token", r"\s", "_").alias("token"))
    size = F.length("token")
    files = [text.parse_ner_lines(numbered.select("line_no", F.concat_ws(" ", "token", _tag(size), _tag(F.floor(size / part)), F.lit("0.9")).alias("line"))) for part in (2, 3)]
    return rounded(downstream.ner_disagreement(*files), "disagreement")


@query("stored_predictions", "select round((1 - avg((quality = toxic)::int)) * 100, 6) as disagreement from labels")
def stored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of two runs, of which one has a validation file, written and found again by their names."""
    labels, folder = spark.read.parquet(f"{sf_dir}/labels.parquet"), new_folder(spark, "predictions")
    for name, column in (("first.val", "quality"), ("second", "toxic")):
        text.write_predictions(labels.select(F.col("doc_id").alias("example_id"), F.col(column).alias("pred")), text.prediction_paths(folder, name)[0])
    return rounded(downstream.disagreement(*(text.read_predictions(spark, text.prediction_paths(folder, name, validation=True)) for name in ("first", "second"))), "disagreement")


LOG_SQL = "with l as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id desc) as back from events)"


@query("log_quality", f"{LOG_SQL} select 'run_' || user_id as path, round((1 - round(value, 4)) * 100, 6) + 0.0 as quality from l where back = 2")
def log_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    lines = events.select(F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("line_no"), F.concat(F.lit("test error: "), F.round("value", 4).cast("string")).alias("line"))
    return rounded(downstream.sentiment_quality(lines), "quality")


@query("ner_log_quality", f"{LOG_SQL} select 'run_' || user_id as path, case when event_id % 2 = 0 then round(round(value, 4) * 100, 6) + 0.0 end as quality from l where back = 7")
def ner_log_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    head = F.when(F.col("event_id") % 2 == 0, F.lit("MICRO_AVG: f1-score ")).otherwise(F.lit("MACRO_AVG: f1-score "))
    lines = events.select(F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("line_no"), F.concat(head, F.round("value", 4).cast("string")).alias("line"))
    return rounded(downstream.ner_quality(lines), "quality")


@query("log_complete", f"{LOG_SQL} select 'run_' || user_id as path, event_id % 5 <> 0 as complete from l where back = 2")
def log_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.when(F.col("event_id") % 5 == 0, F.lit("stopped early")).otherwise(F.concat(F.lit("test error: "), F.round("value", 4).cast("string")))
    lines = events.select(F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("line_no"), line.alias("line"))
    return downstream.complete(downstream.sentiment_quality(lines))


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("example_id"), "text", (F.length("text") % 2).alias("label"))


def _named_by_words(spark: SparkSession, sf_dir: str, first: int) -> DataFrame:
    """An embedding of the benchmark's words: each takes a vector, over all of them, by its hash."""
    vectors = embedding(spark, sf_dir, first, 32).select("rank", "vec")
    words = _sentences(spark, sf_dir).select(F.explode(F.split(F.trim("text"), r"\s+")).alias("word")).distinct()
    places = stats.average_ranks(vectors.select(F.col("rank").alias("value")), "value").select(F.col("value").alias("rank"), (F.col("rank") - 1).cast("bigint").alias("place"))
    own = words.withColumn("place", F.pmod(F.crc32("word"), F.lit(vectors.count())))
    return own.join(places, "place").join(vectors, "rank").select(F.crc32("word").alias("rank"), "word", "vec")


@query("downstream_disagreement")
def downstream_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two classifiers on two versions of word vectors of the benchmark's words, compared on sentences they were not trained on."""
    lines = _sentences(spark, sf_dir)
    test = F.crc32(F.col("example_id").cast("string")) % 2 == 0
    models = [downstream.train_and_predict(lines.where(~test), lines.where(test), _named_by_words(spark, sf_dir, first)) for first in (1, 33)]
    return rounded(downstream.disagreement(*models), "disagreement")


WORD_PAIRS = "select a.rank as ra, b.rank as rb, ((a.rank * 7 + b.rank * 13) % 101)::double as score from emb a join emb b on b.rank = a.rank + 1"


@query("word_similarity", f"""with {EMB}, w as ({WORD_PAIRS}), c as (select score, {dot_sql('a.v', 'b.v')} / (sqrt({dot_sql('a.v', 'a.v')}) * sqrt({dot_sql('b.v', 'b.v')})) as cosine from w join emb a on a.rank = ra join emb b on b.rank = rb),
r as (select rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double as rx, rank() over (order by cosine) + (count(*) over (partition by cosine) - 1) / 2.0::double as ry from c)
select 'cosine' as metric, 'score' as task, round(corr(rx, ry), 6) + 0.0 as rho from r""")
def word_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = embedding(spark, sf_dir)
    follow = emb.select((F.col("rank") - 1).alias("rank"), F.col("word").alias("second"), F.col("rank").alias("rb"))
    pairs = emb.join(follow, "rank").select(F.col("word").alias("first"), "second", ((F.col("rank") * 7 + F.col("rb") * 13) % 101).cast("double").alias("score"))
    return rounded(downstream.word_similarity(pairs, emb), "rho")


# Statistics over result tables

T = f"with {trial.SQL}"
KEYS_SQL = ", ".join(trial.KEYS)


def _oriented(m: str) -> str:
    return f"(1 - {m})" if higher_is_stable(m) else m


@query("gather_results", f"{T} select {KEYS_SQL}, {', '.join(f'round({c}, 6) as {c}' for c in MEASURES + TASKS)} from trial")
def gather_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = trials(spark, sf_dir)
    wide = stats.gather({c: table.select(*trial.KEYS, F.col(c).alias("value")) for c in MEASURES + TASKS}, trial.KEYS)
    return rounded(wide, *MEASURES, *TASKS)


def _summary_sql(by: str) -> str:
    return f"{T} select {by}, {', '.join(f'round(avg({c}), 6) as {c}_mean, round(stddev_samp({c}), 6) as {c}_std' for c in MEASURES + TASKS)} from trial group by all"


def _summary(spark: SparkSession, sf_dir: str, by: list[str]) -> DataFrame:
    out = stats.summary(trials(spark, sf_dir), by, MEASURES + TASKS)
    return rounded(out, *[f"{c}_{s}" for c in MEASURES + TASKS for s in ("mean", "std")])


for _name, _by in (("result_summary", ["space", "bitrate", "dim"]), ("result_summary_by_bitrate", ["algo", "bitrate"]), ("result_summary_by_dim", ["algo", "dim"])):
    query(_name, _summary_sql(", ".join(_by)))(partial(_summary, by=_by))


@query("result_store", f"{T} select {KEYS_SQL}, {', '.join(f'round({c}, 6) as {c}' for c in (MEASURES[0], TASKS[0]))} from trial")
def result_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a measure and of a task stored by (algo, metric), and gathered again."""
    table, folder = trials(spark, sf_dir), new_folder(spark, "results")
    for algo in sorted(r.algo for r in table.select("algo").distinct().collect()):
        for metric in (MEASURES[0], TASKS[0]):
            text.store_result(table.where(F.col("algo") == algo).withColumn("value", F.col(metric)), folder, algo, metric)
    wide = text.gather_store(spark, folder, [MEASURES[0], TASKS[0]])
    return rounded(wide.select(*trial.KEYS, MEASURES[0], TASKS[0]), MEASURES[0], TASKS[0])


@query("result_file_roundtrip", f"{T} select {KEYS_SQL}, {', '.join(f'round({c}, 6) as {c}' for c in MEASURES + TASKS)} from trial")
def result_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result table as CSV under a file tag, read again with its schema."""
    path = f"{new_folder(spark, 'csv')}/{grid.file_tag('results', compress_type='uniform', wiki=True)}"
    text.write_results(trials(spark, sf_dir), path)
    return rounded(text.read_results(spark, path).select(*trial.KEYS, *MEASURES, *TASKS), *MEASURES, *TASKS)


@query("figure_series", f"{T} select round(1 - avg(knn), 6) as x, round(avg({TASKS[0]}), 6) as y, round(stddev_samp({TASKS[0]}), 6) as yerr from trial group by dim, bitrate")
def figure_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A figure's pre-aggregated series, written as CSV and read again."""
    path = new_folder(spark, "figure")
    text.write_figure(stats.plot_against(trials(spark, sf_dir), "bitrate", "knn", [TASKS[0]]), path)
    return rounded(text.read_figure(spark, path), "x", "y", "yerr")


@query("measure_tags", f"with {GRID_SQL} select distinct dim, bitrate, 'knn_top_' || (100 * dim) || '_nquery_1000_nn_' || bitrate as tag from g")
def measure_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column name of a neighbour measure for each (dim, bitrate) of the grid, a table of a few dozen rows."""
    rows = _cells(spark, sf_dir).select("dim", "bitrate").distinct().collect()
    tagged = [(r.dim, r.bitrate, grid.measure_tag("knn", truncate=100 * r.dim, nneighbors=r.bitrate)) for r in rows]
    return spark.createDataFrame(tagged, "dim int, bitrate int, tag string")


def _spearman_sql() -> str:
    cells = " union all ".join(f"select algo, '{m}' as metric, '{t}' as task, {_oriented(m)} as x, {t} as y from trial" for m in MEASURES for t in TASKS)
    tied = lambda c: f"rank() over (partition by algo, metric, task order by {c}) + (count(*) over (partition by algo, metric, task, {c}) - 1) / 2.0::double"
    return f"{T}, c as ({cells}), r as (select algo, metric, task, {tied('x')} as rx, {tied('y')} as ry from c) select algo, metric, task, round(corr(rx, ry), 6) + 0.0 as rho from r group by all"


@query("spearman_matrix", _spearman_sql())
def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.spearman(trials(spark, sf_dir), MEASURES, TASKS, ["algo"]), "rho")


def _selection_sql(where: str) -> str:
    parts = []
    for m in MEASURES:
        vote = f"b.{m} > a.{m}" if higher_is_stable(m) else f"b.{m} < a.{m}"
        for t in TASKS:
            parts.append(f"select a.algo, a.seed, '{m}' as metric, '{t}' as task, (({vote}) <> (b.{t} < a.{t})) as wrong, abs(a.{t} - b.{t}) as apart from ranked a join ranked b on a.algo = b.algo and a.seed = b.seed and a.rid < b.rid {where}")
    return f"""{T}, s as ({' union all '.join(parts)}),
e as (select algo, seed, metric, task, avg(wrong::int) as error, coalesce(max(apart) filter (wrong), 0) as robustness from s group by all)
select algo, metric, task, round(avg(error), 6) as error, round(max(robustness), 6) as robustness from e group by all"""


def _selection(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    found = stats.selection(trials(spark, sf_dir), MEASURES, TASKS, **options)
    return rounded(stats.selection_by_seed(found), "error", "robustness")


for _name, _options, _where in (
    ("selection_error", {}, ""),
    ("selection_error_same_space", {"same_space": True}, "and a.space = b.space"),
    ("selection_error_budget", {"budget": 800}, "and a.space <= 800 and b.space <= 800"),
):
    query(_name, _selection_sql(_where))(partial(_selection, **_options))


def _oracle_gap_sql() -> str:
    parts = []
    for m in [*MEASURES, "baseline_fp", "baseline_lp"]:
        column = "bitrate" if m.startswith("baseline") else m
        way = "desc" if m == "baseline_fp" or higher_is_stable(m) else "asc"
        for t in TASKS:
            parts.append(f"select algo, space, seed, '{m}' as metric, '{t}' as task, first({t} order by {column} {way}, rid) - min({t}) as gap from ranked group by algo, space, seed having count(*) > 1")
    return f"{T}, o as ({' union all '.join(parts)}) select algo, metric, task, round(avg(gap), 6) + 0.0 as mean, round(max(gap), 6) + 0.0 as max from o group by all"


@query("diff_to_oracle", _oracle_gap_sql())
def diff_to_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.diff_to_oracle(trials(spark, sf_dir), MEASURES, TASKS), "mean", "max")


def _trend_sql(over: str) -> str:
    level = {"space": "0", "bitrate": "dim", "dim": "bitrate"}[over]
    cells = " union all ".join(f"select algo, '{t}' as task, ({level})::int as level, log2({over}::double) as x, {t} as y from trial where space < 1000" for t in TASKS)
    return f"""{T}, c as ({cells}), m as (select algo, task, level, avg(x) as mx, avg(y) as my from c group by all),
s as (select sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) as slope from c join m using (algo, task, level))
select algo, task, level, round(slope, 6) + 0.0 as slope, round(my - slope * mx, 6) + 0.0 as intercept from m cross join s"""


def _trend(spark: SparkSession, sf_dir: str, over: str) -> DataFrame:
    return rounded(stats.fit_trend(trials(spark, sf_dir), TASKS, over), "slope", "intercept")


for _name, _over in (("fit_trend_memory", "space"), ("fit_trend_precision", "bitrate"), ("fit_trend_dimension", "dim")):
    query(_name, _trend_sql(_over))(partial(_trend, over=_over))


@query("trend_overlay", f"with f as ({_trend_sql('space').replace('round(slope, 6) + 0.0 as slope', 'slope').replace('round(my - slope * mx, 6) + 0.0 as intercept', 'my - slope * mx as intercept')}), w as (select distinct dim * bitrate as space from (select unnest([25, 50, 100, 200, 400, 800]) as dim) cross join (select unnest([1, 2, 4, 8, 16, 32]) as bitrate)) select algo, task, space, round(slope * log2(space::double) + intercept, 6) + 0.0 as y from f cross join w")
def trend_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaces = grid.grid(spark).select("space").distinct()
    return rounded(stats.trend_overlay(stats.fit_trend(trials(spark, sf_dir), TASKS), spaces), "y")


def _vote_sql() -> str:
    parts = []
    for m in MEASURES:
        way = ">" if higher_is_stable(m) else "<"
        parts.append(f"select '{m}' as metric, round(avg({m}) filter (dim = 25), 3) as first, round(avg({m}) filter (dim = 100), 3) as second, case when round(avg({m}) filter (dim = 100), 3) {way} round(avg({m}) filter (dim = 25), 3) then 'second' else 'first' end as vote from trial")
    return f"{T} {' union all '.join(parts)}"


@query("metric_vote", _vote_sql())
def metric_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.votes(trials(spark, sf_dir), MEASURES, F.col("dim") == 25, F.col("dim") == 100)


@query("plot_series", f"{T} select dim as series, bitrate as x, round(1 - avg(knn), 6) as y, round(stddev_samp(knn), 6) as yerr from trial group by all")
def plot_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.plot_series(trials(spark, sf_dir), "dim", "bitrate", "knn"), "y", "yerr")


@query("plot_against", f"{T} {' union all '.join(f'''select bitrate as series, dim, bitrate, '{t}' as task, round(1 - avg(knn), 6) as x, round(avg({t}), 6) as y, round(stddev_samp({t}), 6) as yerr from trial group by dim, bitrate''' for t in TASKS)}")
def plot_against(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.plot_against(trials(spark, sf_dir), "bitrate", "knn", TASKS), "x", "y", "yerr")


# Additions


MOMENTS = "select time_bucket(interval '1 hour', ts)::timestamp as start, event_type as key, count(*) as n, round(sum(value), 4) + 0.0 as total, round(sum(value * value), 4) + 0.0 as squares from events group by all"


@query("windowed_moments", MOMENTS)
def windowed_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rounded(drift.windowed_moments(events, "ts", "event_type", "value"), "total", "squares", digits=4)


@query("streamed_moments", MOMENTS)
def streamed_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return rounded(drift.run_to_end(drift.windowed_moments(stream, "ts", "event_type", "value"), ["start", "key"], new_folder(spark, "moments")), "total", "squares", digits=4)


