"""Near copies by the Jaccard similarity of word shingle sets; every pair at or above the threshold is found and verified.

Equal sets are merged first, so copies cost one row. Of each other set only a prefix in one global order of shingles is
joined: two sets of a similarity t share a shingle within their first n - ceil(t n) + 1 (prefix filter), so no pair is
missed at any number of rows. Common shingles come last in the order, which costs or saves time and never a pair. Parity
bits of the sets rule out most other candidates: the bits in which two sets' parities differ are no more than the shingles
in which the sets differ. First the SimHash operator's trie join links rows whose fingerprints are close, and those links are
verified. Then, of each shingle's rows, all are compared with the least one, and of those candidates each
row meets the least; then trees that share a shingle meet its last and first tree, a pair of rows each; and at last all rows
that are not yet linked meet, if their prefixes share as many shingles as similar sets must. Shingles that the same rows share
are one, with a weight, and of the shingles that two rows share only the first makes a pair, up to a few that lie far apart.
Texts move once for each comparison that is left.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecstead.llm.common import append_columns, as_bytes, batch_of, ddl, durable, give_back, release, remember, written
from vecstead.llm.components import connected_components
from vecstead.llm.simhash import exhaustive_tables, fingerprint, fingerprint_links, shingle_hashes

#: One text in so many has its shingles counted to find the common ones, so a shingle that isn't found is in few texts at any
#: size; the least count of a common one, and how many are sent out.
SAMPLED, OFTEN, MOST = 8, 3, 1 << 18
#: Bits of the mask of row numbers that keeps texts of other rows out of joins; of one size at every input.
MASK_BITS = 1 << 24
#: Words of 64 parity bits of a set; pairs that are broadcast at most (16 bytes each), else they are joined by a shuffle; and
#: rows that are compared with one text in a task.
PARITY, MOST_SENT, MEMBERS = 16, 400_000, 500
#: Times that the trees of a shingle meet its last and then its first tree before all pairs that are left meet, at most; none
#: where those pairs are no more than so many for each row, and no more once a meeting spares few. Either way all pairs left meet.
ROUNDS, CROWDED = 1, 4
#: How many of a row's shingles before one tell whether a pair that meets there has met before.
BEFORE = 4
#: Pairs of a row that are verified before its others, where the pairs left are more than CROWDED for each of their rows.
FIRST = 3
#: Bits of a fingerprint and in how many two of them differ at most, for the links that the trie join finds first.
PRINT, NEAR = 64, 4


def shingle_set(raw: bytes | None, words: int) -> np.ndarray:
    """The distinct shingle hashes, ascending; none for null and wordless texts."""
    return np.unique(shingle_hashes(raw, words))


def prefix_size(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def least_shared(p: Column, q: Column, similarity: float) -> Column:
    """How many shingles the prefixes of two sets of p and q shingles share at least if the sets are similar.

    Sets that share o have at most p - o, and q - o, others; of prefixes longer than that by l, at least l are shared.
    """
    both = F.ceil(similarity / (1 + similarity) * (p + q) - 1e-9)
    return 1 + both - F.ceil(similarity * F.greatest(p, q) - 1e-9)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sets is `similarity` or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _bit(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(MASK_BITS)).cast("int")


def _mask(ids: DataFrame) -> Broadcast:
    """A mask of the rows in `ids` (row)."""
    mask = np.zeros(MASK_BITS // 8, dtype=np.uint8)
    at = ids.select(_bit("row").alias("bit")).distinct().toArrow()["bit"].to_numpy()
    np.bitwise_or.at(mask, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return ids.sparkSession.sparkContext.broadcast(mask)


def _marked(rows: DataFrame, sent: Broadcast, name: str) -> DataFrame:
    """`rows` with `__hit`: false only where `name` is not among the rows of the mask `sent`, so those rows need no join."""

    def make() -> Callable:
        remember()

        def compute(bits):
            x = bits.to_numpy()
            return ((sent.value[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(bool),)

        return compute

    return append_columns(rows.withColumn("__bit", _bit(name)), ["__bit"], {"__hit": "boolean"}, make, drop=["__bit"])


def _without(rows: DataFrame, ids: DataFrame, sent: Broadcast, name: str = "__row") -> DataFrame:
    """`rows` whose `name` is not in `ids` (row), of which `sent` is the mask."""
    marked = _marked(rows, sent, name)
    maybe = marked.where("__hit").join(ids.select(F.col("row").alias(name)), name, "left_anti")
    return marked.where("not __hit").select(*rows.columns).unionByName(maybe.select(*rows.columns))


def _common(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a sample of `rows` (row, text), ascending, and the place of each by its count."""
    schema = {"token": "bigint"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember()
        for batch in batches:
            for lo in range(0, len(batch), 500):
                sets = [shingle_set(raw, words) for raw in as_bytes(batch.column(0).slice(lo, 500))]
                yield batch_of(schema, [pa.array(np.concatenate(sets).view(np.int64))])

    sample = rows.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLED)) == 0).select("text")
    found = sample.mapInArrow(run, ddl(schema)).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    tokens = found.orderBy(F.desc("n"), "token").limit(MOST).toArrow()["token"].to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], len(tokens) - order


def _prefixes(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """(token, row, size): the shingles of each set's prefix, and the set's size."""
    sent = rows.sparkSession.sparkContext.broadcast(_common(rows, words))
    schema = {"token": "bigint", "row": "bigint", "size": "int"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember()
        common, place = sent.value
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                tokens, sizes = [], []
                for raw in as_bytes(part.column(1)):
                    found = shingle_set(raw, words)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                        found = found[np.argsort(np.where(common[at] == found, place[at], 0), kind="stable")]
                    tokens.append(found[: prefix_size(len(found), similarity)])
                    sizes.append(len(found))
                times = list(map(len, tokens))
                yield batch_of(schema, [np.concatenate(tokens).view(np.int64), np.repeat(part.column(0).to_numpy(), times), np.repeat(np.array(sizes, dtype=np.int32), times)])
        give_back()

    return rows.select("row", "text").mapInArrow(run, ddl(schema))


def parity(shingles: np.ndarray) -> np.ndarray:
    """PARITY * 64 bits: of the shingles that fall on each, whether their number is odd."""
    bits = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _may_link(similarity: float, x: str, y: str) -> Column:
    """Whether two sets (columns x_size, x_bits, y_size, y_bits) can be similar: their difference is at least that of their parities."""
    apart = F.aggregate(F.zip_with(f"{x}_bits", f"{y}_bits", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, k: n + k)
    return apart <= (1 - similarity) / (1 + similarity) * (F.col(f"{x}_size") + F.col(f"{y}_size")) + 1e-9


def _sifted(pairs: DataFrame, marks: DataFrame, similarity: float, *others: str) -> DataFrame:
    """Those of the distinct `pairs` (a, b, others) that `marks` (row, size, bits) don't rule out."""
    for side in ("a", "b"):
        pairs = pairs.join(marks.select(F.col("row").alias(side), F.col("size").alias(f"{side}_size"), F.col("bits").alias(f"{side}_bits")), side)
    return pairs.where(_may_link(similarity, "a", "b")).select("a", "b", *others)


def _verified(pairs: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the distinct `pairs` (a, b) whose shingle sets are similar.

    The texts of b go to the text of a, and many of them to several tasks, each with a's text.
    """
    pairs = durable(pairs)
    sides = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("tasks"))
    members = pairs.join(sides, "a").select("a", F.pmod(F.xxhash64("b"), F.col("tasks")).cast("int").alias("task"), F.col("b").alias("row"))
    hubs = sides.select("a", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.col("a").alias("row"))
    asked = members.withColumn("member", F.lit(True)).unionByName(hubs.withColumn("member", F.lit(False)))
    asked = durable(asked)
    sent = F.broadcast(asked) if asked.count() <= MOST_SENT else asked
    texts = _marked(rows, _mask(asked), "row").where("__hit").drop("__hit")
    both = texts.join(sent, "row").select("a", "task", "member", "row", "text")
    schema = {"a": "bigint", "b": "bigint"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember()
        name = hub = None
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part, found = batch.slice(lo, 500), ([], [])
                for a, task, member, row, raw in zip(*(part.column(k).to_pylist() for k in range(4)), as_bytes(part.column(4))):
                    if not member:
                        name, hub = (a, task), shingle_set(raw, words)
                    elif (a, task) != name:
                        raise RuntimeError(f"no text for row {a}")
                    elif similar(hub, shingle_set(raw, words), similarity):
                        found[0].append(a)
                        found[1].append(row)
                yield batch_of(schema, found)
        give_back()

    return both.repartition("a", "task").sortWithinPartitions("a", "task", "member").mapInArrow(run, ddl(schema))


def simhash_pairs(prints: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) that connect rows of close fingerprints in `prints` (row, print), found by the trie join; a is less.

    Rows of one fingerprint meet its least row, and least rows meet along the trie join's forest.
    """
    least = durable(prints.groupBy("print").agg(F.min("row").alias("first")))
    own = prints.join(least, "print").where("row > first").select(F.col("first").alias("a"), F.col("row").alias("b"))
    links = fingerprint_links(least.select("print"), exhaustive_tables(PRINT, NEAR, least.count()))
    for side in ("a", "b"):
        links = links.join(least.select(F.col("print").alias(side), F.col("first").alias(f"{side}_row")), side)
    return own.unionByName(links.select(F.least("a_row", "b_row").alias("a"), F.greatest("a_row", "b_row").alias("b"))).distinct()


def _merged(prefixes: DataFrame) -> DataFrame:
    """(token, row, size, weight): of the shingles in `prefixes` (token, row, size) that several rows share, those of the same rows are one.

    The least stands for all of them and the weight is their number; sets of rows are told apart by 128 bits.
    """
    group = Window.partitionBy("token")  # spills where a shingle is common
    told = prefixes.withColumn("n", F.count("*").over(group))
    for name, of in (("left", ("row",)), ("right", ("row", F.lit(1)))):
        told = told.withColumn(name, F.bit_xor(F.xxhash64(*of)).over(group))
    told = told.where("n > 1").groupBy("left", "right", "row")
    return told.agg(F.min("token").alias("token"), F.min("size").alias("size"), F.count("*").cast("int").alias("weight")).select("token", "row", "size", "weight")


def _meeting(left: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """(a, b, least): pairs of rows of `left` (token, row, size, root) that share a shingle, are in different trees and that sizes and
    parities don't rule out, and how many shingles their prefixes must share.

    A pair that shares one of the few shingles before has met there, so nearly every pair is made once; what parities rule
    out never leaves the join.
    """
    own = Window.partitionBy("row").orderBy("token")
    held = left.select("token", "row", "size", "root", *[F.lag("token", i).over(own).alias(f"before{i}") for i in range(1, BEFORE + 1)]).join(marks.select("row", "bits"), "row")
    x, y = (held.select(*[F.col(c).alias(f"{side}_{c}") for c in held.columns]) for side in ("x", "y"))
    meet = (F.col("x_token") == F.col("y_token")) & (F.col("x_row") < F.col("y_row")) & (F.col("x_root") != F.col("y_root"))
    meet &= F.least("x_size", "y_size") >= similarity * F.greatest("x_size", "y_size") - 1e-9
    for i in range(1, BEFORE + 1):
        for j in range(1, BEFORE + 1):
            meet &= F.coalesce(F.col(f"x_before{i}") != F.col(f"y_before{j}"), F.lit(True))
    pairs = x.join(y, meet & _may_link(similarity, "x", "y"))
    return pairs.select(F.col("x_row").alias("a"), F.col("y_row").alias("b"), least_shared(F.col("x_size"), F.col("y_size"), similarity).alias("least")).distinct()


def _sharing(pairs: DataFrame, left: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b, least) whose rows share as many shingles of `left` (token, row, weight) as `least` says."""
    lists = left.groupBy("row").agg(F.collect_list(F.struct("token", "weight")).alias("x"))
    for side in ("a", "b"):
        own = lists.select(F.col("row").alias(side), F.col("x.token").alias(f"{side}_tokens"), F.col("x.weight").alias(f"{side}_weights"))
        pairs = pairs.join(own, side)
    schema = {"a": "bigint", "b": "bigint"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember()
        for batch in batches:
            keep = np.zeros(len(batch), dtype=bool)
            least, (xs, weights, ys) = batch.column(2).to_numpy(), (batch.column(k) for k in (3, 4, 5))
            for i in range(len(batch)):
                _, at, _ = np.intersect1d(xs[i].values.to_numpy(), ys[i].values.to_numpy(), assume_unique=True, return_indices=True)
                keep[i] = weights[i].values.to_numpy()[at].sum() >= least[i]
            yield batch_of(schema, [batch.column(k).filter(pa.array(keep)) for k in (0, 1)])
        give_back()

    return pairs.select("a", "b", "least", "a_tokens", "a_weights", "b_tokens").mapInArrow(run, ddl(schema))


def near_copy_roots(rows: DataFrame, marks: DataFrame, words: int, similarity: float) -> DataFrame:
    """(row, root) for each of `rows` (row, text; sets distinct) that has a near copy: the least row that links reach.

    `marks` has each row's size, parity bits and fingerprint.
    """
    alike = lambda x, y: F.least(x, y) >= similarity * F.greatest(x, y) - 1e-9
    met = durable(_sifted(simhash_pairs(marks.select("row", "print")), marks, similarity))
    near = durable(_verified(met, rows, words, similarity))
    group = Window.partitionBy("token")  # spills where a shingle is common
    shared = written(_merged(_prefixes(rows, words, similarity)))
    stars = shared.withColumn("first", F.min(F.struct("row", "size")).over(group)).where((F.col("row") > F.col("first.row")) & alike(F.col("size"), F.col("first.size")))
    stars = stars.select(F.col("first.row").alias("a"), F.col("row").alias("b")).distinct()
    stars = _sifted(stars, marks, similarity).join(met, ["a", "b"], "left_anti")
    stars = durable(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    # the trees of both kinds of links at once
    roots = durable(connected_components(near.unionByName(_verified(stars, rows, words, similarity)))).select(F.col("node").alias("row"), "root")
    stars = durable(stars.unionByName(met))

    def apart(shared: DataFrame, roots: DataFrame) -> DataFrame:
        """(token, row, size, weight, root, low, high) of the shingles whose rows have several roots; low and high are ends of (root, row, size).

        Trees only grow, so the next step needs no other shingle, and what it came from goes.
        """
        left = shared.select("token", "row", "size", "weight").join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
        place = F.struct("root", "row", "size")
        out = written(left.withColumn("low", F.min(place).over(group)).withColumn("high", F.max(place).over(group)).where("low.root < high.root"))
        release(shared)
        return out

    def sizes(left: DataFrame) -> tuple[float, float]:
        """The rows, and the pairs that shingles' rows make."""
        found = left.groupBy("token").agg(F.count("*").cast("double").alias("m")).agg(F.sum("m"), F.sum(F.col("m") * (F.col("m") - 1) / 2)).first()
        return found[0] or 0.0, found[1] or 0.0

    left, before = apart(shared, roots), math.inf
    # a shingle's rows also meet rows of its other trees, so that a dense group is one tree before all its pairs meet
    for end in ("high", "low") * ROUNDS:
        rows_left, pairs_left = sizes(left)
        if pairs_left <= CROWDED * rows_left or pairs_left > 0.75 * before:
            break
        before = pairs_left
        hubs = left.where((F.col("root") != F.col(f"{end}.root")) & alike(F.col("size"), F.col(f"{end}.size")))
        hubs = hubs.select(F.least(f"{end}.row", "row").alias("a"), F.greatest(f"{end}.row", "row").alias("b"), "root").distinct()
        # one meeting for each tree
        hubs = _sifted(hubs.join(stars, ["a", "b"], "left_anti"), marks, similarity, "root").groupBy("root").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b").distinct()
        found = durable(_verified(hubs, rows, words, similarity))
        if found.isEmpty():
            break
        stars = durable(stars.unionByName(hubs).distinct())
        roots = _joined(roots, found)
        left = apart(left, roots)

    # rows of a shingle that are still apart; pairs that failed are not compared again
    pairs = durable(_meeting(left, marks, similarity).join(stars, ["a", "b"], "left_anti"))
    found = pairs.agg(F.count("*"), F.count_distinct("b")).first()
    if found[0] > CROWDED * found[1]:
        # a few pairs of each row make a dense group nearly one tree, so of its pairs few are left to verify
        few = durable(_few(pairs))
        roots = _joined(roots, _verified(_sharing(few, left), rows, words, similarity))
        pairs = durable(_between(pairs, roots).join(few, ["a", "b"], "left_anti"))
    more = durable(_verified(_sharing(pairs, left), rows, words, similarity))
    release(left)
    return roots if more.isEmpty() else _joined(roots, more)


def _few(pairs: DataFrame) -> DataFrame:
    """At most FIRST of each b's distinct `pairs` (a, b, least), drawn by hashes."""
    drawn = pairs.groupBy("b").agg(F.array(*[F.min(F.struct(F.xxhash64("a", "b", F.lit(i)), "a", "least")) for i in range(FIRST)]).alias("drawn"))
    return drawn.select(F.explode(F.array_distinct(F.transform("drawn", lambda x: F.struct(x["a"], x["least"])))).alias("p"), "b").select("p.a", "b", "p.least")


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b, ...) whose rows are in different trees of `roots` (row, root)."""
    out = pairs
    for side in ("a", "b"):
        out = out.join(roots.select(F.col("row").alias(side), F.col("root").alias(f"{side}_root")), side, "left")
    return out.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select(*pairs.columns)


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """`roots` (row, root) once `links` (a, b) between their rows, or rows that have none yet, join trees."""
    edges = roots.select(F.col("row").alias("a"), F.col("root").alias("b")).unionByName(links.select("a", "b"))
    return durable(connected_components(edges)).select(F.col("node").alias("row"), "root")


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` with one row of each group of near copies: the smallest id, null ids last, and of repeated ids the first read.

    Two texts are near copies if the Jaccard similarity of their sets of `words`-word shingles is `similarity` or more;
    groups are what such links connect, and no link is missed. Texts without a word are copies of each other. An empty
    table gives an empty one; all columns come back as they were, whatever their names. Texts of any length are compared
    whole.
    """
    names = [f"__{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = {c.lower(): n for c, n in zip(docs.columns, names)}
    body, key = at[text.lower()], at[doc_id.lower()]

    def make() -> Callable:
        remember()

        def compute(texts: pa.Array):
            sets = [shingle_set(x, words) for x in as_bytes(texts)]
            return [xxhash.xxh3_128_digest(x.tobytes()) for x in sets], [len(x) for x in sets], [parity(x).tolist() for x in sets], [fingerprint(x, PRINT) for x in sets]

        return compute

    rows = written(append_columns(plain.withColumn("__row", F.monotonically_increasing_id()), [body], {"digest": "binary", "size": "int", "bits": "array<bigint>", "print": "binary"}, make))
    order = F.struct(F.col(key).isNull().alias("no"), F.col(key).alias("id"), F.col("__row").alias("row"))
    firsts = durable(rows.groupBy("digest").agg(F.min(order).alias("least")).select("least"))
    again = durable(rows.select(F.col("__row").alias("row")).join(firsts.select(F.col("least.row").alias("row")), "row", "left_anti"))
    sent = _mask(again)
    marks = _without(rows.select("__row", "size", "bits", "print"), again, sent).withColumnRenamed("__row", "row")
    single = _without(rows.select("__row", body), again, sent)
    roots = near_copy_roots(single.select(F.col("__row").alias("row"), F.col(body).alias("text")), durable(marks), words, similarity)
    linked = firsts.join(roots, F.col("least.row") == F.col("row"))
    keep = linked.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias("row"))
    gone = durable(again.unionByName(roots.select("row").join(keep, "row", "left_anti")))
    return _without(rows.select(*names, "__row"), gone, _mask(gone)).select(*names).toDF(*docs.columns)
