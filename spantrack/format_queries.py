"""Queries of readers, writers, checks and scalar functions: lines made of a table are parsed, or
elements of a table are written as lines, and held against SQL over the same table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import functions as X
from . import regions as R
from .catalog import Catalog
from .header_tools import standardise
from .operators import graph as GR
from .operators import overlap as O
from .operators import slicing as S
from .operators import user_bins as U
from .operators import validate as V
from .operators import windows as W
from .queries import query
from .session import ensure_checkpoint_dir, table
from .sinks import formats as SF
from .sinks import headed as SH
from .sources import formats as P
from .sources import headed as H
from .sources.lines import keep_valid
from .track_queries import _LATEST, GOOD, _as_lines, _bins, _BINS, _latest, _segments, _steps

_STRAND = "CASE WHEN strand = 1 THEN '+' WHEN strand = 0 THEN '-' ELSE '.' END"


def _linked(spark, d):
    return table(spark, d, "linked_elements").where(F.col("chr").isNotNull() & (F.col("end") > F.col("start"))).withColumnRenamed("chr", "seqid")


def _number(missing: str = "NaN"):
    return F.when(F.isnan("val"), missing).otherwise(F.col("val").cast("string"))


def _split_nan(name: str = "val"):
    return F.nanvl(name, F.lit(None).cast("double")).alias("val"), F.isnan(name).alias("missing")


# Readers
@query("""SELECT el_id, coalesce(loaded_at::VARCHAR, '') AS t, CASE WHEN "start" IS NULL OR "start" < 0 THEN 'start' WHEN "end" IS NULL OR "end" <= "start" THEN 'end' ELSE 'fine' END AS verdict
FROM track_elements WHERE chr IS NOT NULL""")
def bed_verdicts(spark, d):
    """The broken rule of every line, also of faulty ones."""
    t = table(spark, d, "track_elements").where("chr is not null")
    order = F.struct(F.lit(0).cast("long").alias("block"), F.col("el_id").alias("nth"))
    lines = t.select(F.coalesce(F.col("loaded_at").cast("string"), F.lit("")).alias("file"), order.alias("ord"), F.concat_ws(
        "\t", "chr", F.coalesce(F.col("start").cast("string"), F.lit("")), F.coalesce(F.col("end").cast("string"), F.lit(""))).alias("line"))
    return P.bed(lines).select(F.col("ord.nth").alias("el_id"), F.col("file").alias("t"), F.coalesce("error", F.lit("fine")).alias("verdict"))


@query(f"SELECT chr AS seqid, count(*) AS n FROM track_elements WHERE {GOOD} AND \"start\" >= 0 GROUP BY chr")
def permissive_read(spark, d):
    t = table(spark, d, "track_elements").where("chr is not null")
    lines = t.select(F.lit("f").alias("file"), F.struct(F.lit(0).cast("long").alias("block"), F.col("el_id").alias("nth")).alias("ord"), F.concat_ws(
        "\t", "chr", F.coalesce(F.col("start").cast("string"), F.lit("x")), F.coalesce(F.col("end").cast("string"), F.lit(""))).alias("line"))
    return keep_valid(P.bed(lines), "PERMISSIVE").groupBy("seqid").agg(F.count("*").alias("n"))


@query(f"""SELECT el_id, "start", CASE WHEN "end" = "start" + 1 THEN 'fine' ELSE 'point length' END AS verdict FROM
 (SELECT el_id, "start", CASE WHEN el_id % 3 = 0 THEN "end" ELSE "start" + 1 END AS "end" FROM track_elements WHERE {GOOD} AND "start" >= 0)""")
def point_bed_parse(spark, d):
    s = _segments(spark, d).where("start >= 0").withColumn("end", F.when(F.col("el_id") % 3 == 0, F.col("end")).otherwise(F.col("start") + 1))
    return P.point_bed(_as_lines(s, "seqid", "start", "end")).select(F.col("ord.nth").alias("el_id"), "start", F.coalesce("error", F.lit("fine")).alias("verdict"))


@query(f"""SELECT el_id, "start", "end", CASE WHEN val::VARCHAR <> 'nan' THEN val END AS val, val::VARCHAR = 'nan' AS missing,
 CAST(CASE WHEN strand = 1 THEN 1 WHEN strand = 0 THEN 0 ELSE -1 END AS TINYINT) AS strand FROM track_elements WHERE {GOOD} AND "start" >= 0 AND val IS NOT NULL""")
def valued_bed_parse(spark, d):
    s = _segments(spark, d).where("start >= 0 and val is not null")
    lines = _as_lines(s, "seqid", "start", "end", F.lit("n"), _number(), F.when(F.col("strand") == 1, "+").when(F.col("strand") == 0, "-").otherwise("."))
    parsed = P.valued_bed(lines).where("error is null")
    return parsed.select(F.col("ord.nth").alias("el_id"), "start", "end", *_split_nan(), "strand")


@query(f'SELECT el_id, chr AS seqid, "start", "end", val FROM linked_elements WHERE {GOOD} AND val IS NOT NULL AND "start" >= 0')
def category_bed_parse(spark, d):
    s = _linked(spark, d).where("val is not null and start >= 0")
    return P.category_bed(_as_lines(s, "seqid", "start", "end", "val")).where("error is null").select(F.col("ord.nth").alias("el_id"), "seqid", "start", "end", "val")


@query(f"""SELECT el_id, CAST(CASE WHEN strand IN (0, 1) THEN strand WHEN strand = -1 THEN -1 END AS TINYINT) AS val, CASE WHEN strand IS NULL THEN 'value' ELSE 'fine' END AS verdict
FROM track_elements WHERE {GOOD} AND "start" >= 0""")
def target_control_parse(spark, d):
    s = _segments(spark, d).where("start >= 0")
    value = F.when(F.col("strand") == -1, ".").when(F.col("strand").isNull(), "x").otherwise(F.col("strand").cast("string"))
    return P.target_control(_as_lines(s, "seqid", "start", "end", value)).select(F.col("ord.nth").alias("el_id"), "val", F.coalesce("error", F.lit("fine")).alias("verdict"))


@query(f"""SELECT el_id, "start" - 1 AS "start", "end", val, id, 'n ' || el_id AS name FROM linked_elements WHERE {GOOD} AND val IS NOT NULL AND "start" >= 1 AND id IS NOT NULL AND id <> ''""")
def category_gff_parse(spark, d):
    """Values and ids of any characters, URL-quoted."""
    s = _linked(spark, d).where("val is not null and start >= 1 and id is not null and id <> ''")
    attributes = F.concat(F.lit("ID="), X.escape(F.col("id")), F.lit(";Name=n%20"), F.col("el_id"))
    lines = _as_lines(s, "seqid", F.lit("src"), X.escape(F.col("val")), "start", "end", F.lit("5"), F.lit("+"), F.lit("."), attributes)
    return P.category_gff(lines).where("error is null").select(F.col("ord.nth").alias("el_id"), "start", "end", "val", "id", "name")


@query("""SELECT vec_id, CAST(i - 1 AS INT) AS i, CASE WHEN i % 2 = 1 THEN CAST(embedding[i] AS DOUBLE) END AS val, i % 2 = 0 AS missing
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""")
def microarray_parse(spark, d):
    """Scores of every second experiment; the others are missing."""
    e = table(spark, d, "embeddings")
    size = F.size("embedding")
    ids = F.filter(F.sequence(F.lit(0), size - 1), lambda i: i % 2 == 0)
    scores = F.transform(ids, lambda i: F.get("embedding", i).cast("double").cast("string"))
    names = F.concat(F.lit('track type="array" expScale=3.0 expStep=0.5 expNames="'), F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda i: i.cast("string")), ","), F.lit(',"'))
    line = F.concat_ws(" ", F.lit("c"), F.col("vec_id"), F.col("vec_id") + 1, F.lit("n"), F.lit("0"), F.lit("+"), *map(F.lit, ("0", "0", "0", "1", "1,", "0,")),
                       F.size(ids).cast("string"), F.concat(F.array_join(ids.cast("array<string>"), ","), F.lit(",")), F.concat(F.array_join(scores, ","), F.lit(",")))
    both = F.explode(F.array(F.struct(F.lit(0).cast("long").alias("n"), names.alias("x")), F.struct(F.lit(1).cast("long").alias("n"), line.alias("x"))))
    lines = e.select("vec_id", both.alias("r")).select(F.col("vec_id").cast("string").alias("file"), F.struct(F.col("vec_id").alias("block"), F.col("r.n").alias("nth")).alias("ord"), F.col("r.x").alias("line"))
    parsed = P.microarray(lines).where("error is null").select(F.col("start").cast("long").alias("vec_id"), F.posexplode("val").alias("i", "v"))
    return parsed.select("vec_id", "i", *_split_nan("v"))


@query("SELECT label::VARCHAR AS seqid, vec_id, CAST(vec_id * 1000 + i - 1 AS INT) AS \"start\", embedding[i] AS val FROM (SELECT label, vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def function_slice(spark, d):
    e = table(spark, d, "embeddings").select(F.concat_ws("|", F.col("label").cast("string"), F.col("vec_id").cast("string")).alias("seqid"), "vec_id", "embedding")
    out = P.function_slice(e.withColumn("first", F.col("vec_id") * 1000), "embedding", "seqid", F.col("first"))
    parts = F.split("seqid", r"\|")
    return out.select(F.get(parts, F.lit(0)).alias("seqid"), F.get(parts, F.lit(1)).cast("long").alias("vec_id"), "start", "val")


@query("SELECT 'chr21' AS seqid, 0 AS \"start\", 0.5::DOUBLE AS val")
def constant_function(spark, d):
    return P.constant_function(spark, value=0.5)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS bal, CASE WHEN c_custkey % 5 > 0 THEN 'fine' ELSE 'bal' END AS verdict FROM customer""")
def tabular_parse(spark, d):
    c = table(spark, d, "customer")
    line = F.concat_ws(";", F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal").cast("string")).otherwise("none"), "c_name")
    lines = c.select(F.lit("f").alias("file"), F.struct(F.lit(0).cast("long").alias("block"), F.col("c_custkey").alias("nth")).alias("ord"), line.alias("line"))
    return P.tabular(lines, {"key": "bigint", "bal": "double"}, ";").select(F.col("ord.nth").alias("c_custkey"), "bal", F.coalesce("error", F.lit("fine")).alias("verdict"))


@query(f"""SELECT el_id, CASE WHEN q.length IS NULL THEN 'seqid' WHEN "end" > q.length THEN 'beyond end' ELSE 'fine' END AS verdict
FROM linked_elements e LEFT JOIN genome_seq q ON q.genome = 'nv2' AND q.seqid = e.chr WHERE {GOOD} AND "start" >= 0""")
def sequence_verdicts(spark, d):
    parsed = P.bed(_as_lines(_linked(spark, d).where("start >= 0"), "seqid", "start", "end"))
    out = P.unknown_sequences(parsed, table(spark, d, "genome_seq"), "nv2")
    return out.select(F.col("ord.nth").alias("el_id"), F.coalesce("error", F.lit("fine")).alias("verdict"))


_WIG = "w AS (SELECT o_orderkey, 'c' || o_custkey AS seqid, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, CAST(o_totalprice AS DOUBLE) AS val FROM orders)"


@query("WITH " + _WIG + """ SELECT o_orderkey, seqid, n * 7 AS "start", n * 7 + 1 + o_custkey % 5 AS "end", val FROM w""")
def wig_variable_parse(spark, d):
    """variableStep blocks, one for each customer, with spans that differ."""
    return _wig_blocks(spark, d, lambda b: F.format_string("variableStep chrom=c%d span=%d", b, b % 5 + 1), lambda n, v: F.concat_ws(" ", (n * 7 + 1).cast("string"), v))


@query("WITH " + _WIG + """ SELECT o_orderkey, seqid, 4 + (n - 1) * (3 + o_custkey % 4) AS "start", 4 + (n - 1) * (3 + o_custkey % 4) + 2 AS "end", val FROM w""")
def wig_fixed_parse(spark, d):
    """fixedStep blocks with steps that differ."""
    return _wig_blocks(spark, d, lambda b: F.format_string("fixedStep chrom=c%d start=5 step=%d span=2", b, b % 4 + 3), lambda n, v: v)


def _wig_blocks(spark, d, head, body):
    o = W.ordered_values(table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("string").alias("v")), ["o_custkey"], ["o_orderkey"], {"n": (W.ROW, None)})
    ordered = lambda n: F.struct(F.col("o_custkey").alias("block"), n.cast("long").alias("nth")).alias("ord")
    lines = o.select(ordered(F.col("o_orderkey")), body(F.col("n"), F.col("v")).alias("line")).unionByName(
        o.select("o_custkey").distinct().select(ordered(F.lit(-1)), head(F.col("o_custkey")).alias("line")))
    parsed = P.wig(lines.select(F.lit("one file").alias("file"), "ord", "line")).where("error is null")
    return parsed.select(F.col("ord.nth").alias("o_orderkey"), "seqid", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "val")


# Writers
_TAB = " || chr(9) || "


@query(f"SELECT {_TAB.join(['chr', chr(34) + 'start' + chr(34), '(' + chr(34) + 'start' + chr(34) + ' + 1)'])} AS line FROM track_elements WHERE {GOOD}")
def point_bed_compose(spark, d):
    return SF.compose(_segments(spark, d).select("seqid", "start"), "point.bed").select("line")


@query(f"SELECT {_TAB.join(['chr', chr(34) + 'start' + chr(34), chr(34) + 'end' + chr(34), 'val'])} AS line FROM linked_elements WHERE {GOOD} AND val IS NOT NULL")
def category_bed_compose(spark, d):
    return SF.compose(_linked(spark, d).where("val is not null").select("seqid", "start", "end", "val"), "category.bed").select("line")


def _whole_values(spark, d):
    """Segments with values from 0 to 999, some of them missing."""
    value = F.when(F.col("el_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.pmod("start", F.lit(1000)).cast("double"))
    return _segments(spark, d).where("start >= 0").select("seqid", "start", "end", value.alias("val"), "strand", F.concat(F.lit("n"), F.col("el_id")).alias("name"), "el_id")


_SHOWN = "CASE WHEN el_id % 7 = 0 THEN '.' ELSE (\"start\" % 1000) || '.0' END"


@query(f"""SELECT chr || chr(9) || "start" || chr(9) || "end" || chr(9) || 'n' || el_id || chr(9) || {_SHOWN} || chr(9) || {_STRAND} AS line FROM track_elements WHERE {GOOD} AND "start" >= 0""")
def valued_bed_compose(spark, d):
    return SF.compose(_whole_values(spark, d).drop("el_id"), "valued.bed").select("line")


@query(f"""SELECT chr || chr(9) || "start" || chr(9) || "end" || chr(9) || {_SHOWN} AS line FROM track_elements WHERE {GOOD} AND "start" >= 0""")
def bedgraph_compose(spark, d):
    return SF.compose(_whole_values(spark, d).select("seqid", "start", "end", "val"), "bedgraph").select("line")


@query(f"""SELECT chr || chr(9) || "start" || chr(9) || "end" || chr(9) || CASE WHEN strand IN (0, 1) THEN strand::VARCHAR ELSE '.' END AS line FROM track_elements WHERE {GOOD}""")
def target_control_compose(spark, d):
    return SF.compose(_segments(spark, d).select("seqid", "start", "end", F.col("strand").alias("val")), "targetcontrol.bedgraph").select("line")


@query(f"""SELECT chr || chr(9) || '.' || chr(9) || 'region' || chr(9) || ("start" + 1) || chr(9) || "end" || chr(9) || {_SHOWN} || chr(9) || {_STRAND} || chr(9) || '.' || chr(9) || 'Name=n' || el_id AS line
FROM track_elements WHERE {GOOD} AND "start" >= 0""")
def gff_compose(spark, d):
    return SF.compose(_whole_values(spark, d).drop("el_id"), "gff").select("line")


_PRICES = "w AS (SELECT 'c' || o_custkey AS seqid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)"


def _spaced(spark, d, step: int):
    o = W.ordered_values(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], {"n": (W.ROW, None)})
    start = (F.col("n") * step).cast("int")
    return o.select(F.format_string("c%d", "o_custkey").alias("seqid"), start.alias("start"), (start + 5).alias("end"), F.col("n").cast("double").alias("val"))


@query("WITH " + _PRICES + """ SELECT (n * 8 + 1) || ' ' || n || '.0' AS line FROM w UNION ALL SELECT DISTINCT 'variableStep chrom=' || seqid || ' span=5' FROM w""")
def wig_variable_compose(spark, d):
    return SF.compose(_spaced(spark, d, 8), "wig").select("line")


@query("WITH " + _PRICES + """ SELECT n || '.0' AS line FROM w UNION ALL SELECT DISTINCT 'fixedStep chrom=' || seqid || ' start=6 step=5 span=5' FROM w""")
def wig_fixed_compose(spark, d):
    return SF.compose(_spaced(spark, d, 5), "wig").select("line")


@query("""WITH t AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND length(text) > 0)
SELECT '>d' || doc_id || ' 1-' || length(text) AS line FROM t
UNION ALL SELECT substr(text, CAST(s + 1 AS BIGINT), 60) FROM (SELECT text, unnest(range(0, length(text), 60)) AS s FROM t)""")
def fasta_compose(spark, d):
    """Every code point of every text as one position, written 60 to a line."""
    t = table(spark, d, "documents").where("text is not null").select(F.format_string("d%d", "doc_id").alias("seqid"), F.posexplode(F.split("text", "")).alias("start", "val")).where("val <> ''")
    return SF.compose(t, "fasta").select("line")


@query("""SELECT el_id, chr AS seqid, "start", "end", CASE WHEN val::VARCHAR <> 'nan' THEN val END AS val, val::VARCHAR = 'nan' AS missing,
 CAST(CASE WHEN strand IN (0, 1) THEN strand ELSE -1 END AS TINYINT) AS strand FROM track_elements WHERE """ + GOOD + """ AND "start" >= 0 AND val IS NOT NULL""")
def headed_values_round_trip(spark, d):
    """Values with missing ones, strands, 1-based inclusive positions."""
    t = _segments(spark, d).where("start >= 0 and val is not null").select("seqid", "start", "end", _number(".").alias("val"), "strand", F.col("el_id").cast("string").alias("n"))
    h = SH.header_for(t, value_type="number", **{"1-indexed": True, "end_inclusive": True})
    lines = SH.compose(t.withColumn("row_ord", F.col("n").cast("long")), h)
    lines = lines.select(F.lit("f").alias("file"), F.struct(F.lit(0).cast("long").alias("block"), F.col("k_row").alias("nth")).alias("ord"), "line")
    back = H.parse(lines, H.parse_header(SH.header_lines(h))).where("error is null")
    return back.select(F.col("n").cast("long").alias("el_id"), "seqid", "start", "end", *_split_nan(), "strand")


@query("""WITH e AS (SELECT source_id AS s, target_id AS t, max(weight) FILTER (WHERE weight::VARCHAR <> 'nan') AS w, count(*) FILTER (WHERE weight IS NULL OR weight::VARCHAR = 'nan') > 0 AS gap
 FROM link_rows WHERE source_id IS NOT NULL AND source_id <> '' AND target_id IS NOT NULL AND target_id <> '' GROUP BY ALL)
SELECT s AS id, t AS edge, w AS weight FROM e""")
def headed_edges_round_trip(spark, d):
    """The links of every node as one linked point with edges and weights, written and read back."""
    e = table(spark, d, "link_rows").where("source_id is not null and source_id <> '' and target_id is not null and target_id <> ''")
    e = e.groupBy("source_id", "target_id").agg(F.max(F.nanvl("weight", F.lit(None).cast("double"))).alias("w"))
    packed = e.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("target_id", "w"))).alias("x"))
    ids = W.ordered_values(packed, [], ["source_id"], {"start": (W.ROW, None)})
    t = ids.select(F.lit("c").alias("seqid"), F.col("start").cast("int").alias("start"), F.col("source_id").alias("id"), F.transform("x", lambda r: r["target_id"]).alias("edges"),
                   F.transform("x", lambda r: F.coalesce(r["w"].cast("string"), F.lit("."))).alias("weights"))
    h = SH.header_for(t, edge_weight_type="number")
    lines = SH.compose(t.withColumn("row_ord", F.col("start").cast("long")), h)
    lines = lines.select(F.lit("f").alias("file"), F.struct(F.lit(0).cast("long").alias("block"), F.col("k_row").alias("nth")).alias("ord"), "line")
    back = H.parse(lines, H.parse_header(SH.header_lines(h))).where("error is null")
    out = back.select("id", F.explode(F.arrays_zip("edges", "weights")).alias("e"))
    return out.select("id", F.col("e.edges").alias("edge"), F.nanvl("e.weights", F.lit(None).cast("double")).alias("weight"))


@query("""WITH w AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, CAST(o_totalprice AS DOUBLE) AS val FROM orders)
SELECT 'c' || o_custkey AS seqid, 1000 + (n - 1) * 10 AS "start", 1000 + n * 10 AS "end", val FROM w""")
def headed_regions_parse(spark, d):
    """A step function: only ends and values, in one region for each customer."""
    o = W.ordered_values(table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("string").alias("v")), ["o_custkey"], ["o_orderkey"], {"n": (W.ROW, None)})
    body = o.select(F.struct(F.col("o_custkey").alias("block"), F.col("n").alias("nth")).alias("ord"), F.concat_ws("\t", (F.col("n") * 10 + 1000).cast("string"), "v").alias("line"))
    heads = o.groupBy("o_custkey").agg(F.max("n").alias("m")).select(
        F.struct(F.col("o_custkey").alias("block"), F.lit(0).cast("long").alias("nth")).alias("ord"), F.format_string("####seqid=c%d; start=1000; end=%d", F.col("o_custkey"), F.col("m") * 10 + 1000).alias("line"))
    lines = body.unionByName(heads).select(F.lit("f").alias("file"), "ord", "line")
    back = H.parse(lines, H.parse_header(["##track type: step function", "###end\tvalue"])).where("error is null")
    return back.select("seqid", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "val")


# Checks
_STEPS_LATEST = f"WITH t AS ({_LATEST.format(table='step_elements')}), u AS (SELECT * FROM t WHERE {GOOD} AND el_id IS NOT NULL)"


def _good_steps(spark, d):
    t = _latest(table(spark, d, "step_elements")).where("el_id is not null")
    return t.where(F.col("chr").isNotNull() & (F.col("end") > F.col("start"))).withColumnRenamed("chr", "seqid")


@query(_STEPS_LATEST + """, o AS (SELECT chr, "start" AS s, "end" AS e, lag({'a': "start", 'b': "end"}) OVER (PARTITION BY chr ORDER BY el_id) AS p FROM u)
SELECT 'V20 sorted' AS rule, '{"seqid":"' || chr || '","start":' || s || ',"end":' || e || '}' AS detail FROM o WHERE p > {'a': s, 'b': e}""")
def unsorted_violations(spark, d):
    return V.unsorted(_good_steps(spark, d), ["seqid"], "el_id")


@query(_STEPS_LATEST + """, o AS (SELECT chr, "start" AS s, "end" AS e, max("end") OVER (PARTITION BY chr ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM u)
SELECT chr AS seqid, count(*) AS n FROM o WHERE s < m GROUP BY chr""")
def overlap_violations(spark, d):
    found = V.overlapping(_good_steps(spark, d), ["seqid"])
    return found.groupBy(F.get_json_object("detail", "$.seqid").alias("seqid")).agg(F.count("*").alias("n"))


@query("SELECT n, count(*) AS n_ids FROM (SELECT id, count(*) AS n FROM linked_nodes WHERE id IS NOT NULL AND id <> '' GROUP BY id HAVING count(*) > 1) GROUP BY n")
def repeated_id_violations(spark, d):
    found = V.repeated_ids(table(spark, d, "linked_nodes").where("id is not null and id <> ''"))
    return found.groupBy(F.get_json_object("detail", "$.n").cast("long").alias("n")).agg(F.count("*").alias("n_ids"))


@query(f"""SELECT '{{"seqid":"' || chr || '","start":' || "start" || ',"end":' || "end" || '}}' AS detail FROM linked_elements e LEFT JOIN genome_seq q ON q.genome = 'nv2' AND q.seqid = e.chr
WHERE e.genome = 'nv2' AND chr IS NOT NULL AND "start" IS NOT NULL AND "end" IS NOT NULL AND (q.length IS NULL OR "start" < 0 OR "end" <= "start" OR "end" > q.length)""")
def position_violations(spark, d):
    t = table(spark, d, "linked_elements").where("genome = 'nv2' and chr is not null and start is not null and end is not null").withColumnRenamed("chr", "seqid").drop("genome")
    return V.positions(t, table(spark, d, "genome_seq"), "nv2").select("detail")


@query(_STEPS_LATEST + """, o AS (SELECT sample_id, chr, lag(chr) OVER (PARTITION BY sample_id ORDER BY el_id) AS p FROM u),
r AS (SELECT sample_id, chr, count(*) FILTER (WHERE p IS NULL OR p <> chr) AS n FROM o GROUP BY ALL)
SELECT sample_id, chr AS seqid, n FROM r WHERE n > 1""")
def returning_sequences(spark, d):
    t = _good_steps(spark, d).withColumn("file", F.col("sample_id").cast("string"))
    found = V.split_sequences(t, "el_id").select(*[F.get_json_object("detail", f"$.{c}").alias(c) for c in ("file", "seqid", "n")])
    return found.select(F.col("file").cast("long").alias("sample_id"), "seqid", F.col("n").cast("long").alias("n"))


@query("WITH " + _BINS.format(n=3000000) + f""", p AS (SELECT t.*, bins."start" AS bs, bins."end" AS be FROM (SELECT * FROM step_elements WHERE {GOOD}) t
 LEFT JOIN bins ON bins.genome = t.genome AND bins.seqid = t.chr AND t."start" >= bins."start" AND t."start" < bins."end")
SELECT el_id, loaded_at, coalesce("end" <= be, false) AS inside FROM p""")
def elements_by_region(spark, d):
    regions = _bins(spark, d, 3_000_000).select("genome", "seqid", "start", "end")
    return O.with_region(_steps(spark, d), regions, ["genome", "seqid"]).select("el_id", "loaded_at", "inside")


@query("WITH " + _BINS.format(n=3000000) + f""", q AS (SELECT t.* FROM (SELECT * FROM step_elements WHERE {GOOD}) t JOIN bins ON bins.genome = t.genome AND bins.seqid = t.chr
 AND t."start" >= bins."start" AND t."end" <= bins."end")
SELECT bins.genome, bins.seqid, bins."start", bins."end", count(q.el_id) AS n FROM bins LEFT JOIN q ON bins.genome = q.genome AND bins.seqid = q.chr
 AND q."start" >= bins."start" AND q."end" <= bins."end" GROUP BY ALL""")
def contained_counts(spark, d):
    """Counts of those elements that lie in a region (others would make the read fail)."""
    regions = _bins(spark, d, 3_000_000).select("genome", "seqid", "start", "end")
    held = O.with_region(_steps(spark, d), regions, ["genome", "seqid"]).where("inside").drop("region_start", "region_end", "inside")
    return O.count_contained(held, regions, ["genome", "seqid"]).select("genome", "seqid", "start", "end", "n")


# Analysis regions and windows
@query(f"""SELECT DISTINCT e.genome, e.chr AS seqid, "start", "end" FROM linked_elements e JOIN genome_seq q ON q.genome = e.genome AND q.seqid = e.chr WHERE {GOOD}""")
def shared_regions(spark, d):
    """Whole sequences on one side: the regions of the other side are left."""
    g = table(spark, d, "genome_seq")
    whole = g.select("genome", "seqid", F.lit(0).alias("start"), F.col("length").alias("end"))
    return U.shared_regions(whole, _linked(spark, d).select("genome", "seqid", "start", "end").distinct(), g)


@query(f"""WITH w AS (SELECT CAST(s AS INT) AS ws, CAST(least(s + 1000000, 60000000) AS INT) AS we FROM (SELECT unnest(range(0, 59000001, 500000)) AS s))
SELECT ws AS "start", we AS "end", count(t.el_id) AS n FROM w LEFT JOIN (SELECT * FROM track_elements WHERE {GOOD} AND chr = 'chr1') t ON t."start" < we AND t."end" > ws GROUP BY ALL""")
def sliding_window_counts(spark, d):
    windows = S.sliding_windows(spark, "chr1", 0, 60_000_000, 1_000_000, 500_000)
    return O.count_per_region(_segments(spark, d).where("seqid = 'chr1'"), windows, ["seqid"], 1_000_000).select("start", "end", "n")


@query(f"""WITH p AS (SELECT CAST(unnest(range(20000000, 20200000)) AS INT) AS pos)
SELECT pos, count(t.el_id) AS n FROM p LEFT JOIN (SELECT * FROM track_elements WHERE {GOOD} AND chr = 'chr1') t ON t."start" = pos GROUP BY pos""")
def positions_with_elements(spark, d):
    return S.bp_iterate(_segments(spark, d).where("seqid = 'chr1'"), 20_000_000, 20_200_000).groupBy("pos").agg(F.count("el_id").alias("n"))


@query(_STEPS_LATEST + """, o AS (SELECT el_id, "start" AS s, "end" AS e, lag("start") OVER w AS ps, lag("end") OVER w AS pe FROM u WINDOW w AS (PARTITION BY sample_id, chr ORDER BY "start", "end", el_id))
SELECT el_id, false AS as_function, ps = s AND pe = e AS as_points, ps < e AND pe > s AS as_segments FROM o WHERE ps IS NOT NULL""")
def overlap_by_kind(spark, d):
    t = W.ordered_values(_good_steps(spark, d).select("sample_id", "seqid", "start", "end", "el_id"), ["sample_id", "seqid"], ["start", "end", "el_id"], {"ps": (W.LAG, "start"), "pe": (W.LAG, "end")})
    a = (F.col("ps"), F.col("pe"), F.col("start"), F.col("end"))
    return t.where("ps is not null").select("el_id", R.elements_overlap("function", *a).alias("as_function"), R.elements_overlap("points", *a).alias("as_points"), R.elements_overlap("segments", *a).alias("as_segments"))


# Whole-file tools
@query(_STEPS_LATEST + """ SELECT el_id, chr || '-' || (row_number() OVER (PARTITION BY chr ORDER BY el_id) - 1) AS id, -1::TINYINT AS strand, 0 AS n_edges FROM u""")
def standardised(spark, d):
    t = _good_steps(spark, d).select("seqid", "start", "end", "el_id")
    return standardise(t, ["el_id"]).select("el_id", "id", "strand", F.size("edges").alias("n_edges"))


@query("""WITH e AS (SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM link_rows WHERE source_id IS NOT NULL AND target_id IS NOT NULL)
SELECT a, b FROM e""")
def undirected_edge_keys(spark, d):
    links = table(spark, d, "link_rows").where("source_id is not null and target_id is not null").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "weight")
    return links.select(GR.edge_key(True).alias("k")).select("k.a", "k.b").distinct()


@query("SELECT DISTINCT source_id AS row_id, target_id AS col_id, 1 AS weight FROM link_rows WHERE source_id IS NOT NULL AND target_id IS NOT NULL")
def binary_matrix(spark, d):
    links = table(spark, d, "link_rows").where("source_id is not null and target_id is not null").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "weight")
    return GR.binary_matrix(links)


@query("""SELECT o_orderkey, string_split(o_orderpriority, '-')[1] AS first_part, regexp_replace(o_orderpriority, '[^A-Za-z0-9_.\\- ]', '_', 'g') AS safe,
 replace(format('{:,}', o_orderkey * 1234), ',', ' ') AS grouped, 'gz' AS suffix, true AS allowed, replace(replace(o_orderpriority, '-', '%2D'), ' ', ' ') AS kept, true AS back,
 CASE WHEN o_orderkey % 3 = 0 THEN '+' WHEN o_orderkey % 3 = 1 THEN '-' ELSE '.' END AS strand, CAST(CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE -1 END AS TINYINT) AS strand_number,
 CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END AS number, true AS equal FROM orders""")
def scalar_functions(spark, d):
    o = table(spark, d, "orders")
    key, name = F.col("o_orderkey"), F.col("o_orderpriority")
    plus = F.when(key % 3 == 0, 1).when(key % 3 == 1, 0).otherwise(-1).cast("tinyint")
    number = X.number_of(F.when(key % 4 > 0, F.col("o_totalprice").cast("string")).otherwise("n/a"))
    return o.select(
        "o_orderkey", F.get(X.split_name(F.replace(name, F.lit("-"), F.lit(":"))), F.lit(0)).alias("first_part"), X.safe_name(name).alias("safe"), X.thousands(key * 1234).alias("grouped"),
        X.file_suffix(F.concat(F.lit("/a.b/c."), name, F.lit(".GZ"))).alias("suffix"), X.allowed_characters(name).alias("allowed"), X.escape(name, "-").alias("kept"),
        (X.unquote(X.escape(F.concat(name, F.lit("+;=%")))) == F.concat(name, F.lit("+;=%"))).alias("back"), X.strand_text(plus).alias("strand"), X.strand_of(X.strand_text(plus)).alias("strand_number"),
        F.nanvl(number, F.lit(None).cast("double")).alias("number"), X.same(F.lit(float("nan")), number * 0 + F.lit(float("nan"))).alias("equal"))


# The catalogue
@query(f"""WITH s AS (SELECT * FROM linked_elements WHERE {GOOD}),
o AS (SELECT *, max("end") OVER (PARTITION BY genome, chr ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s)
SELECT genome, count(*) AS raw, count(*) FILTER (WHERE m IS NULL OR "start" >= m) AS clustered, count(DISTINCT val) AS n_categories, CAST(count(*) AS BIGINT) AS read_back FROM o GROUP BY genome""")
def catalog_counts(spark, d):
    """Stores the linked elements of each genome as a track and reads them back."""
    root = f"{ensure_checkpoint_dir(spark)}/catalog-{uuid.uuid4().hex}"
    cat = Catalog(spark, root)
    rows = []
    for r in table(spark, d, "genome_seq").select("genome").distinct().orderBy("genome").collect():  # a dimension
        genome = r["genome"]
        t = _linked(spark, d).where(F.col("genome") == genome).select("seqid", "start", "end", "val")
        if t.isEmpty():
            continue
        info = cat.store(t, genome, "linked")
        rows.append((genome, info.counts["raw"], info.counts["clustered"], info.n_categories, cat.track(genome, "linked").count()))
        cat.remove(genome, "linked")
    return spark.createDataFrame(rows, "genome string, raw long, clustered long, n_categories long, read_back long")
