"""Queries of the training-data operators of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import materialise, table
from .bpe import Bpe
from .packing import DEFAULT_CAPACITY, fill_containers, token_counts
from .quantiles import HIGH, LOW, merge_sketches, percentiles, sketches
from .runs import collapse_runs, latest_version
from .sentences import block_ends, split_sentences

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# 5. Repeated consecutive events
def _runs(spark, d):
    rows = latest_version(table(spark, d, "step_elements"), "el_id", "loaded_at", ["sample_id", "chr", "start", "end", "val"])
    return collapse_runs(rows, ["sample_id", "chr"], "start", "end", "val", 0.05, "el_id")


_P5 = """
WITH u AS (SELECT * FROM step_elements QUALIFY el_id IS NULL OR row_number() OVER (PARTITION BY el_id ORDER BY loaded_at DESC) = 1),
o AS (SELECT *, lag("end") OVER w AS pe, lag(val) OVER w AS pv FROM u WHERE chr IS NOT NULL AND "start" IS NOT NULL AND "end" IS NOT NULL
  AND sample_id IS NOT NULL WINDOW w AS (PARTITION BY sample_id, chr ORDER BY "start", "end", el_id)),
g AS (SELECT *, sum(CASE WHEN pe = "start" AND NOT isnan(pv) AND NOT isnan(val) AND abs(val - pv) <= 0.05 THEN 0 ELSE 1 END)
  OVER (PARTITION BY sample_id, chr ORDER BY "start", "end", el_id ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT sample_id, chr, min("start") AS "start", max("end") AS "end", count(*) AS n_elements{more} FROM g
GROUP BY sample_id, chr, run HAVING count(*) >= 2"""


@query(_P5.format(more=""))
def p5_found(spark, d):
    return _runs(spark, d).drop("length")


@query(_P5.format(more=', CAST(sum("end" - "start") AS BIGINT) AS length'))
def p5_runs(spark, d):
    return _runs(spark, d)


# 7. Percentiles of very large numeric columns
HIGH_AT = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99, "p999": 0.999}
LOW_AT = {"p001": 0.001, "p01": 0.01, "p10": 0.1, "p25": 0.25, "p50": 0.5}


@query()
def p7_from_days(spark, d):
    """Per chr and day of loading from the summary of that day, and per chr over all days (day
    null) by joining the same summaries. With the high tail protected the rank error of a
    percentile q is at most one percent of (1 - q) * n."""
    rows = table(spark, d, "track_elements").withColumn("day", F.to_date("loaded_at"))
    daily = materialise(sketches(rows, ["chr", "day"], "val"))
    merged = merge_sketches(merge_sketches(daily, ["chr"], by_partition=16), ["chr"])
    whole = percentiles(merged, ["chr"], HIGH_AT).select("chr", F.lit(None).cast("date").alias("day"), "n", *HIGH_AT)
    return percentiles(daily, ["chr", "day"], HIGH_AT).unionByName(whole)


@query()
def p7_percentiles(spark, d):
    """Per chr; the rank error of a percentile q is at most one percent of (1 - q) * n."""
    return percentiles(sketches(table(spark, d, "track_elements"), ["chr"], "val"), ["chr"], HIGH_AT)


@query()
def p7_low_percentiles(spark, d):
    """Per chr, with the low tail protected; rank error at most one percent of q * n."""
    return percentiles(sketches(table(spark, d, "track_elements"), ["chr"], "val", tail=LOW), ["chr"], LOW_AT)


def _within(rows, merged, keys, at, tail):
    """(keys, name, n, within) of every percentile: whether its exact rank among all values keeps
    the stated bound of one percent of the distance to the protected tail, rounding apart."""
    answers = percentiles(merged, keys, at).select(*keys, "n", F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(q).alias("q"), F.col(name).alias("v")) for name, q in at.items()])).alias("a")).select(*keys, "n", "a.*")
    value = F.col("val")
    counted = rows.where(value.isNotNull() & ~F.isnan(value)).select(*[F.col(c).alias(f"__{c}") for c in keys], "val")
    # Values are counted per key and value before they meet the answers.
    counted = counted.groupBy(*[f"__{c}" for c in keys], "val").agg(F.count("*").alias("m"))
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    ranks = answers.join(counted, on).groupBy(*keys, "name", "q", "n").agg(
        F.sum(F.when(F.col("val") < F.col("v"), F.col("m")).otherwise(0)).alias("below"), F.sum(F.when(F.col("val") <= F.col("v"), F.col("m")).otherwise(0)).alias("upto"))
    far = 0.01 * ((1 - F.col("q")) if tail == HIGH else F.col("q")) * F.col("n") + 1
    target = F.ceil(F.col("q") * F.col("n"))
    return ranks.select(*keys, "name", "n", ((F.col("below") - far <= target) & (F.col("upto") + far >= target)).alias("within"))


_P7_BOUNDS = """SELECT {keys}, name, count(*) AS n, true AS within FROM (SELECT *, CAST(loaded_at AS DATE) AS day FROM track_elements),
 (SELECT unnest({names}) AS name) WHERE val IS NOT NULL AND val::VARCHAR <> 'nan' GROUP BY {keys}, name"""


@query(_P7_BOUNDS.format(keys="chr", names=list(HIGH_AT)))
def p7_high_bounds(spark, d):
    """Also from daily summaries that were joined: every percentile keeps its bound."""
    rows = table(spark, d, "track_elements").withColumn("day", F.to_date("loaded_at"))
    merged = merge_sketches(sketches(rows, ["chr", "day"], "val"), ["chr"])
    return _within(rows, merged, ["chr"], HIGH_AT, HIGH)


@query(_P7_BOUNDS.format(keys="chr", names=list(LOW_AT)))
def p7_low_bounds(spark, d):
    rows = table(spark, d, "track_elements")
    return _within(rows, sketches(rows, ["chr"], "val", tail=LOW), ["chr"], LOW_AT, LOW)


@query(_P7_BOUNDS.format(keys="chr, day", names=list(HIGH_AT)))
def p7_day_bounds(spark, d):
    rows = table(spark, d, "track_elements").withColumn("day", F.to_date("loaded_at"))
    return _within(rows, sketches(rows, ["chr", "day"], "val"), ["chr", "day"], HIGH_AT, HIGH)


@query(_P7_BOUNDS.format(keys="genome", names=list(HIGH_AT)))
def p7_genome_bounds(spark, d):
    """Over a few large groups, where every level of the sketch is in use."""
    rows = table(spark, d, "track_elements")
    return _within(rows, sketches(rows, ["genome"], "val"), ["genome"], HIGH_AT, HIGH)


# 8. Encoding of the whole corpus
@query()
def p8_ids(spark, d):
    return Bpe().encode(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "ids")


@query("SELECT lang, count(*) AS n_docs, count(*) AS n_equal FROM documents GROUP BY lang")
def p8_roundtrip(spark, d):
    bpe = Bpe()
    coded = bpe.encode(table(spark, d, "documents").select("lang", "text"), "text")
    equal = bpe.decode(F.col("ids")) == F.coalesce("text", F.lit(""))
    return coded.groupBy("lang").agg(F.count("*").alias("n_docs"), F.count(F.when(equal, 1)).alias("n_equal"))


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p8_decoded(spark, d):
    bpe = Bpe()
    coded = bpe.encode(table(spark, d, "documents").select("doc_id", "text"), "text")
    return coded.select("doc_id", bpe.decode(F.col("ids")).alias("text"))


@query("SELECT lang, count(*) AS n_docs, count(*) AS n_equal FROM documents GROUP BY lang")
def p8_lengths(spark, d):
    """The number of ids is that of a second encoder."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    other = token_counts(docs, "doc_id", "text")
    both = Bpe().encode(docs, "text").select("doc_id", "lang", F.size("ids").alias("n")).join(other, "doc_id")
    return both.groupBy("lang").agg(F.count("*").alias("n_docs"), F.count(F.when(F.col("n") == F.col("n_tokens"), 1)).alias("n_equal"))


# 9. Filling fixed-capacity containers
def _containers(spark, d):
    return fill_containers(token_counts(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "n_tokens")


@query()
def p9_containers(spark, d):
    return _containers(spark, d)


@query()
def p9_fill(spark, d):
    """One row: containers used, the least number that could do, tokens, and share of room used."""
    placed = _containers(spark, d).where("container_id is not null")
    return placed.groupBy("container_id").agg(F.sum("size").alias("used")).agg(
        F.count("*").alias("n_containers"), F.ceil(F.sum("used") / DEFAULT_CAPACITY).alias("least_possible"),
        F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"),
        (F.sum("used") / (F.count("*") * DEFAULT_CAPACITY)).alias("fill"))


@query("SELECT count(*) AS n_docs, 0::BIGINT AS n_changed, 0::BIGINT AS n_split_needlessly, true AS none_overfull, true AS two_large_at_most, true AS tight FROM documents")
def p9_invariants(spark, d):
    """Every document keeps all its tokens, only those above the capacity are split, no container
    is overfull or has more than two large items, and hardly any room is left over."""
    sizes = materialise(token_counts(table(spark, d, "documents"), "doc_id", "text"))
    placed = materialise(fill_containers(sizes, "doc_id", "n_tokens"))
    kept = placed.groupBy("doc_id").agg(F.sum("size").alias("kept"), F.count("*").alias("pieces")).join(sizes, "doc_id", "full")
    documents = kept.agg(F.count("*").alias("n_docs"), F.count(F.when(~F.col("kept").eqNullSafe(F.col("n_tokens")), 1)).alias("n_changed"),
                         F.count(F.when((F.col("pieces") > 1) & (F.col("n_tokens") <= DEFAULT_CAPACITY), 1)).alias("n_split_needlessly"))
    held = placed.where("container_id is not null").groupBy("container_id").agg(F.sum("size").alias("used"), F.count(F.when(F.col("size") * 3 > DEFAULT_CAPACITY, 1)).alias("large"))
    containers = held.agg((F.max("used") <= DEFAULT_CAPACITY).alias("none_overfull"), (F.max("large") <= 2).alias("two_large_at_most"),
                          # All but the last container are 99 percent full on the whole.
                          (F.sum("used") >= 0.99 * DEFAULT_CAPACITY * (F.count("*") - 1)).alias("tight"))
    return documents.withColumn("__j", F.lit(0)).join(containers.withColumn("__j", F.lit(0)), "__j").drop("__j")


# 10. Sentence boundaries
@query()
def p10_found(spark, d):
    return split_sentences(table(spark, d, "documents"), "doc_id", "text")


_LINES = """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM l),
o AS (SELECT doc_id, i, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS before,
 length(regexp_replace(line, '[\\s\\p{Z}]+$', '')) AS shown FROM u),
b AS (SELECT *, sum(CASE WHEN shown = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM o)"""


@query(_LINES + " SELECT doc_id, CAST(max(before + shown) AS INT) AS end_pos FROM b WHERE shown > 0 GROUP BY doc_id, block")
def p10_block_ends(spark, d):
    """The ends that hold without a model: those before empty lines and at the end of texts, as far
    as they are among the ends found."""
    docs = table(spark, d, "documents")
    return split_sentences(docs, "doc_id", "text").join(block_ends(docs, "doc_id", "text"), ["doc_id", "end_pos"], "left_semi")
