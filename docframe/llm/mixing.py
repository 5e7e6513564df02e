"""Mixing sources to target weights by pivotal dependent rounding, DataFrame functions only.

Every source gets a target share of all words (``source_targets``). A document of a source is
then due f = target / source size copies. It gets floor(f) copies outright; the rest of f is a
probability, and so a mass of p * size words between 0 and size. Pivotal rounding takes two
fractional documents of a source and moves mass from one to the other, in a random direction
whose odds keep both expectations, until one of them is at 0 or at its size. The sum of masses
never changes, so a source's words come within half a document of its target, or nearer.

The pairing runs as a reduction tree: documents are dealt by hash into groups of about FAN per
source, each group is folded in one task and leaves at most one fractional document, and these
residuals meet in the next level, until one is left per source; that one goes to its nearer
end, and one other document, of about the size of the difference, makes up for it. Within a
group long documents come first, so that short ones settle what is left of them. A hot source
is just more groups, and no group grows with the data.

Rows that agree in id, source and text are one row with a count from the start. Pairing n equal
rows of probability p with each other first leaves floor(n * p) of them taken, at most one
fractional and the others not taken, whatever the order; so that is what they become at once, and
the fractional one goes to the tree.

All random numbers are hashes of the rows' values, so reruns agree.

Defined results: null texts have size 0; documents of size 0 take nothing; a null source is a
source of its own, last in order; with no words at all every target is 0; repeated rows are
counted and shared out as above; ids may be null or repeat; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table, text_of

FAN = 128
WORD = r"[^\x20\x09-\x0D]+"
ITEM = "struct<less:bigint,h:bigint,doc_id:{id},digest:binary,size:bigint,whole:bigint,m:double>"
#: Equal rows that one task writes out.
CHUNK = 10_000


def source_targets(sizes: DataFrame, weights=(5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """source, source_size, documents, target from rows of (source, size, times).

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all
    sizes; no target is above max_repeats times its source, the excess goes to the others by
    weight. That fixed point is a water level: in order of cap / weight, the sources below the
    level are full and the level is what is left over the weights that are left. One row per
    source is all that meets here.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.count(F.lit(1)).alias("documents"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(every) - 1) % len(weights) + 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
    per = per.withColumn("cap", F.col("source_size") * float(max_repeats))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("weight").over(after))
    free = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))
    upto = by_level.rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("water", F.first(free, ignorenulls=True).over(upto))
    target = F.coalesce(F.least(F.col("water") * F.col("weight"), F.col("cap")), F.col("cap"))
    return per.select("source", F.col("source_size").cast("long").alias("source_size"), "documents", target.alias("target"))


def _fold(items: str, kind: str, level: int) -> F.Column:
    """One group's documents, at most one of them fractional.

    ``open`` holds no or one fractional document. The next one joins it; of the two, mass moves
    until one is integral.
    """
    odds = f"(shiftrightunsigned(xxhash64(p[0].h, p[1].h, {level}), 11) / {float(1 << 53)})"
    a, b = "least(p[0].size - p[0].m, p[1].m)", "least(p[0].m, p[1].size - p[1].m)"
    moved = f"IF({odds} < {b} / ({a} + {b}), {a}, -{b})"
    put = "named_struct('less', p[{0}].less, 'h', p[{0}].h, 'doc_id', p[{0}].doc_id, 'digest', p[{0}].digest, 'size', p[{0}].size, 'whole', p[{0}].whole, 'm', {1})"
    snapped = "CASE WHEN {0} <= 1e-9 * p[{1}].size THEN 0D WHEN {0} >= (1 - 1e-9) * p[{1}].size THEN double(p[{1}].size) ELSE {0} END"
    first, second = put.format(0, snapped.format("(p[0].m + q)", 0)), put.format(1, snapped.format("(p[1].m - q)", 1))
    pair = f"transform(array({moved}), q -> array({first}, {second}))[0]"
    step = f"transform(array(concat(acc.open, array(x))), p -> IF(size(p) < 2, p, {pair}))[0]"
    return F.expr(f"""aggregate({items}, named_struct('open', cast(array() as array<{kind}>), 'done', cast(array() as array<{kind}>)),
        (acc, x) -> transform(array({step}), p -> named_struct(
            'open', filter(p, d -> d.m > 0 AND d.m < d.size),
            'done', concat(acc.done, filter(p, d -> d.m <= 0 OR d.m >= d.size))))[0],
        acc -> concat(acc.open, acc.done))""")


def _of_source(rows: DataFrame, per: DataFrame) -> DataFrame:
    """rows with the columns of their source in per."""
    per = per.withColumnRenamed("source", "_source")
    return rows.join(per, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def _exchanged(done: DataFrame, most: int) -> DataFrame:
    """done with at most one document of each source taken once more or less.

    The last document of a source may be long, and leaves up to half of its words over or
    missing. The document whose size is nearest to that difference makes up for it, if the
    source so comes nearer its target.
    """
    over = F.sum(F.col("size") * F.col("copies") * F.col("times")) - F.first("target")
    off = done.groupBy("source").agg(over.alias("_over"))
    rows = _of_source(done, off)
    may = (F.col("size") > 0) & F.when(F.col("_over") > 0, F.col("copies") > 0).otherwise(F.col("copies") < most)
    left = F.abs(F.col("size") - F.abs("_over"))
    best = F.min(F.when(may & (left < F.abs("_over")), F.struct(left.alias("left"), F.col("h").alias("h"), F.col("slot").alias("slot"))))
    pick = rows.groupBy("source").agg(best.alias("_b"), F.first("_over").alias("_over")).where("_b is not null")
    pick = materialize(pick.select("source", F.col("_b.h").alias("_h"), F.col("_b.slot").alias("_slot"), F.when(F.col("_over") > 0, -1).otherwise(1).alias("_step")), "exchanged")
    out = _of_source(done, pick)
    chosen = F.coalesce((F.col("h") == F.col("_h")) & (F.col("slot") == F.col("_slot")), F.lit(False))
    same = F.struct(F.col("copies").alias("c"), (F.col("times") - chosen.cast("long")).alias("n"))
    one = F.struct((F.col("copies") + F.col("_step")).alias("c"), F.lit(1).cast("long").alias("n"))
    out = out.withColumn("_x", F.explode(F.filter(F.when(chosen, F.array(same, one)).otherwise(F.array(same)), lambda x: x["n"] > 0)))
    return out.withColumns({"copies": F.col("_x.c"), "times": F.col("_x.n")})


def with_key(docs: DataFrame) -> DataFrame:
    """docs with the digest of their texts, by which, with id and source, rows are equal."""
    return docs.withColumn("_mix_digest", F.unhex(F.md5(text_of(F.col("text")))))


def mix(docs: DataFrame, weights=(5, 2, 1), max_repeats: int = 3, seed: int = 17) -> DataFrame:
    """(doc_id, source, digest, size, source_size, target, copies, times): that so many of the
    rows with this id, source and text are each taken so often. docs needs doc_id, source, text."""
    size = F.regexp_count(text_of(F.col("text")), F.lit(WORD)).cast("long")
    base = with_key(docs.select("doc_id", "source", "text")).select("doc_id", "source", F.col("_mix_digest").alias("digest"), size.alias("size"))
    base = base.groupBy("doc_id", "source", "digest").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("times"))
    base = materialize(base.withColumn("h", F.xxhash64("doc_id", "source", "digest", F.lit(seed))), "sizes")
    per = materialize(source_targets(base, weights, max_repeats), "sources")
    kind = ITEM.format(id=base.schema["doc_id"].dataType.simpleString())
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = _of_source(base, per).withColumn("due", due).withColumn("whole", F.floor(F.col("due") + 1e-12).cast("long"))
    part = F.when(F.col("size") > 0, F.greatest(F.col("due") - F.col("whole"), F.lit(0.0))).otherwise(F.lit(0.0))
    rows = rows.withColumn("share", part * F.col("times")).withColumn("more", F.floor(F.col("share") + 1e-9).cast("long"))
    rows = rows.withColumn("m", F.when(F.col("share") - F.col("more") > 1e-9, (F.col("share") - F.col("more")) * F.col("size")).otherwise(F.lit(0.0)))
    left = F.col("times") - F.col("more") - (F.col("m") > 0).cast("long")
    slots = F.array(*[F.struct(F.lit(k).alias("slot"), c.alias("copies"), n.alias("times")) for k, (c, n) in enumerate([(F.col("whole") + 1, F.col("more")), (F.col("whole"), left)])])
    done = rows.select("source", "h", "doc_id", "digest", "size", F.inline(F.filter(slots, lambda x: x["times"] > 0)))
    rows = rows.where("m > 0").withColumn("groups", F.ceil(F.col("documents") / FAN))
    rows = rows.select("source", "groups", F.struct((-F.col("size")).alias("less"), "h", "doc_id", "digest", "size", "whole", "m").cast(kind).alias("d"))
    most, level = per.agg(F.max("documents")).first()[0] or 0, 0
    open_ = (F.col("d.m") > 0) & (F.col("d.m") < F.col("d.size"))
    full = ((F.col("d.size") > 0) & (F.col("d.m") >= F.col("d.size"))).cast("long")
    settled = lambda x: x.select("source", "d.h", "d.doc_id", "d.digest", "d.size", F.lit(2).alias("slot"), (F.col("d.whole") + full).alias("copies"), F.lit(1).cast("long").alias("times"))
    while most > 1:
        rows = rows.withColumn("_group", F.pmod(F.xxhash64("d.h", F.lit(level)), F.greatest(F.col("groups"), F.lit(1))))
        folded = rows.groupBy("source", "_group").agg(F.first("groups").alias("groups"), F.sort_array(F.collect_list("d")).alias("items"))
        folded = folded.select("source", F.ceil(F.col("groups") / FAN).alias("groups"), F.explode(_fold("items", kind, level)).alias("d"))
        folded = materialize(folded, f"level{level}")
        done = done.unionByName(settled(folded.where(~open_)))
        rows, level = folded.where(open_), level + 1
        most = -(-most // FAN) if most > FAN else 1
    last = F.when(F.col("d.m") * 2 >= F.col("d.size"), F.col("d.size").cast("double")).otherwise(F.lit(0.0))
    done = done.unionByName(settled(rows.withColumn("d", F.col("d").withField("m", last))))
    out = _exchanged(_of_source(done, per), max_repeats)
    return out.select("doc_id", "source", "digest", "size", "source_size", "target", "copies", "times")


def repeated(rows: DataFrame, times: str, *columns: str) -> DataFrame:
    """Each row of rows as often as its column ``times`` says; rows of many repeats are dealt out
    in chunks first, so that no task writes them all."""
    n = F.col(times)
    few = rows.where(n <= CHUNK).withColumn("_mix_i", F.explode(F.sequence(F.lit(1).cast("long"), n))).select(*columns)
    chunks = rows.where(n > CHUNK).withColumn("_mix_i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / CHUNK))))
    chunks = chunks.repartition("_mix_i")
    many = chunks.withColumn("_mix_j", F.explode(F.sequence(F.lit(1).cast("long"), F.least(n - F.col("_mix_i") * CHUNK, F.lit(CHUNK))))).select(*columns)
    return few.unionByName(many)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents")).withColumn("taken", F.col("size") * F.col("copies"))
    return repeated(out, "times", "doc_id", "size", "source_size", "target", "taken")


def mix_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, so 0 to 3 times; of equal rows
    one stands for all and takes the copies of all."""
    taken = mix(docs).groupBy("doc_id", "source", "digest").agg(F.sum(F.col("copies") * F.col("times")).alias("_mix_times")).where("_mix_times > 0")
    taken = taken.select(F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("digest").alias("_mix_d"), "_mix_times")
    once = with_key(docs).withColumn("_mix_h", F.xxhash64("doc_id", "source", "_mix_digest")).dropDuplicates(["_mix_h", "_mix_digest", "doc_id", "source"])
    taken = taken.withColumn("_mix_k", F.xxhash64("_mix_id", "_mix_source", "_mix_d"))
    same = (F.col("_mix_h") == F.col("_mix_k")) & (F.col("_mix_digest") == F.col("_mix_d")) & F.col("doc_id").eqNullSafe(F.col("_mix_id")) & F.col("source").eqNullSafe(F.col("_mix_source"))
    return repeated(once.join(taken, same), "_mix_times", *docs.columns)
