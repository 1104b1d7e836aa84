"""Queries for the engine's own operators over the given tables.

Projections: elements of track_elements are segments on (genome, chr), those of linked_elements
valued linked segments, linked_nodes graph vertices, link_rows edges, orders a partition of days
per customer, events points in seconds, genome_seq the genome dimension.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import functions as X
from . import genome as G
from . import regions as R
from . import streaming
from .header_tools import infer_columns, infer_flags
from .operators import cluster as C
from .operators import coverage as V
from .operators import graph as GR
from .operators import overlap as O
from .operators import randomise as RND
from .operators import slicing as S
from .operators import stats as ST
from .operators import user_bins as U
from .operators import windows as W
from .operators.complement import complement
from .plans import track_view
from .queries import query
from .session import table
from .sinks import formats as SF
from .sinks import headed as SH
from .sources import formats as P
from .sources import headed as H
from .types import TrackFormatReq

GOOD = '"chr" IS NOT NULL AND "start" IS NOT NULL AND "end" > "start"'


def _segments(spark, d):
    """Valid segments as they are stored."""
    t = table(spark, d, "track_elements")
    return t.where(F.col("chr").isNotNull() & (F.col("end") > F.col("start"))).withColumnRenamed("chr", "seqid")


def _steps(spark, d):
    t = table(spark, d, "step_elements")
    return t.where(F.col("chr").isNotNull() & (F.col("end") > F.col("start"))).withColumnRenamed("chr", "seqid")


_ISLANDS = """
WITH s AS (SELECT * FROM {table} WHERE "chr" IS NOT NULL AND "start" IS NOT NULL AND "end" > "start"),
o AS (SELECT *, max("end") OVER (PARTITION BY genome, chr ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s),
g AS (SELECT *, sum(CASE WHEN m IS NULL OR "start" >= m THEN 1 ELSE 0 END) OVER (PARTITION BY genome, chr ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS isl FROM o)
"""


# Clustering
@query(_ISLANDS.format(table="track_elements") + """
SELECT genome, chr AS seqid, min("start") AS "start", max("end") AS "end", count(*) AS n_elements,
 CASE WHEN min(val) IS NOT DISTINCT FROM max(val) THEN min(val) ELSE 'NaN'::DOUBLE END AS val,
 CAST(CASE WHEN min(strand) IS NOT DISTINCT FROM max(strand) THEN min(strand) ELSE -1 END AS TINYINT) AS strand
FROM g GROUP BY genome, chr, isl""")
def cluster_segments(spark, d):
    return C.cluster(_segments(spark, d).select("genome", "seqid", "start", "end", "val", "strand"), ["genome", "seqid"])


@query("""SELECT genome, chr AS seqid, "start", count(*) AS n_elements, CASE WHEN min(val) IS NOT DISTINCT FROM max(val) THEN min(val) ELSE 'NaN'::DOUBLE END AS val
FROM track_elements WHERE chr IS NOT NULL AND "start" IS NOT NULL AND "end" > "start" GROUP BY ALL""")
def cluster_points(spark, d):
    return C.cluster(_segments(spark, d).select("genome", "seqid", "start", "end", "val"), ["genome", "seqid"], "points").drop("end")


@query(_ISLANDS.format(table="linked_elements") + """
, a AS (SELECT genome, chr AS seqid, isl, min("start") AS "start", max("end") AS "end", count(*) AS n_elements, min(val) AS lo, max(val) AS hi, count(val) AS nv,
 min(id) AS il, max(id) AS ih, count(id) AS ni, list_sort(list(val) FILTER (WHERE val IS NOT NULL)) AS vs,
 list(id ORDER BY "start", "end", el_id, id) FILTER (WHERE id IS NOT NULL) AS ids FROM g GROUP BY genome, chr, isl)
SELECT genome, seqid, "start", "end", n_elements,
 CASE WHEN lo IS NOT DISTINCT FROM hi THEN lo WHEN nv < 20 AND n_elements < 20 THEN array_to_string(vs, '|') ELSE lo || '|...' END AS val,
 CASE WHEN il IS NOT DISTINCT FROM ih THEN il WHEN ni < 20 AND n_elements < 20 THEN array_to_string(ids, '|') ELSE ids[1] || '|...' END AS id FROM a""")
def cluster_category_concat(spark, d):
    t = table(spark, d, "linked_elements").where(F.col("chr").isNotNull() & (F.col("end") > F.col("start"))).withColumnRenamed("chr", "seqid")
    return C.cluster(t.select("genome", "seqid", "start", "end", "val", "id", "el_id"), ["genome", "seqid"], row_ord="el_id")


# Slicing, views and conversions
@query("""SELECT el_id, "start", "end", greatest("start" - 20000000, 0) AS rel_start, least("end", 40000000) - 20000000 AS rel_end FROM track_elements
WHERE chr = 'chr1' AND "end" > "start" AND "end" > 20000000 AND "start" < 40000000""")
def region_slice_crop(spark, d):
    view = track_view(_segments(spark, d).select("seqid", "start", "end", "el_id"), "chr1", 20_000_000, 40_000_000)
    return view.select("el_id", "start", "end", "rel_start", "rel_end")


@query("""SELECT el_id, greatest("start" - 21000000, 0) AS rel_start, least("end", 39000000) - 21000000 AS rel_end FROM track_elements
WHERE chr = 'chr2' AND "end" > "start" AND "end" > 21000000 AND "start" < 39000000""")
def slice_relative(spark, d):
    a, b = S.sub_slice(20_000_000, 40_000_000, 1_000_000, -1_000_000)
    return S.crop(S.slice_region(_segments(spark, d), "chr2", a, b), a, b).select("el_id", "rel_start", "rel_end")


def _point(which: str, sql: str):
    @query(f"""SELECT el_id, loaded_at, CAST({sql} AS INT) AS "start" FROM track_elements WHERE {GOOD}""")
    def f(spark, d):
        return S.to_points(_segments(spark, d), which).select("el_id", "loaded_at", "start")

    return f


for _name, _which, _sql in (
    ("seg_to_start_point", "start", 'CASE WHEN coalesce(strand, -1) <> 0 THEN "start" ELSE "end" - 1 END'),
    ("seg_to_mid_point", "mid", '("start" + "end") // 2'),
    ("seg_to_end_point", "end", 'CASE WHEN coalesce(strand, -1) <> 0 THEN "end" - 1 ELSE "start" END'),
):
    from .queries import QUERIES, SQL

    _f = _point(_which, _sql)
    QUERIES[_name], SQL[_name] = QUERIES.pop("f"), SQL.pop("f")


@query("""SELECT el_id, CASE WHEN coalesce(strand, -1) <> 0 THEN "start" ELSE "end" - 1 END - 50000000 AS rel_start FROM track_elements
WHERE chr = 'chr3' AND "end" > "start" AND "end" > 50000000 AND "start" < 60000000
 AND CASE WHEN coalesce(strand, -1) <> 0 THEN "start" ELSE "end" - 1 END BETWEEN 50000000 AND 59999999""")
def view_as_points(spark, d):
    req = TrackFormatReq(interval=False, dense=False, converter="start")
    t = _segments(spark, d).select("seqid", "start", "end", "strand", "el_id")
    return track_view(t, "chr3", 50_000_000, 60_000_000, req).select("el_id", "rel_start")


_DAYS = "CAST(datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INT)"


@query(f"""SELECT o_orderkey, {_DAYS} AS "end", coalesce(lag({_DAYS}) OVER (PARTITION BY o_custkey ORDER BY {_DAYS}, o_orderkey), 0) AS "start" FROM orders""")
def partition_starts(spark, d):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.struct(day.alias("day"), "o_orderkey").alias("end"))
    out = S.partition_starts(o.withColumn("none", F.lit(None).cast(o.schema["end"].dataType)), ["o_custkey"], "none")
    return out.select("o_orderkey", F.col("end.day").alias("end"), F.coalesce("start.day", F.lit(0)).alias("start"))


@query(f"""SELECT sample_id, chr AS seqid, el_id, "start" - lag("end") OVER (PARTITION BY sample_id, chr ORDER BY "start", "end", el_id, loaded_at) AS gap
FROM step_elements WHERE {GOOD}""")
def inter_element_gaps(spark, d):
    g = S.inter_element_gaps(_steps(spark, d), ["sample_id", "seqid"], ["start", "end", "el_id", "loaded_at"])
    return g.select("sample_id", "seqid", "el_id", "gap")


@query("""WITH b AS (SELECT seqid, genome, unnest(range(0, length, 250000)) AS s FROM genome_seq),
g AS (SELECT *, s - lag(s + 250000) OVER (PARTITION BY genome, seqid ORDER BY s) AS gap FROM b)
SELECT 250000 AS fixed_length, CAST(CASE WHEN min(gap) = max(gap) THEN min(gap) END AS INT) AS fixed_gap FROM g""")
def fixed_length_detect(spark, d):
    g = table(spark, d, "genome_seq").select("genome", "seqid", F.lit(0).alias("start"), F.col("length").alias("end"))
    tiles = G.auto_bin(g, 250_000).withColumn("end", F.col("start") + 250_000)
    return S.fixed_length_and_gap(tiles, ["genome", "seqid"])


# Region predicates and algebra
def _bins(spark, d, size=5_000_000):
    g = table(spark, d, "genome_seq").select("genome", "seqid", F.lit(0).alias("start"), F.col("length").alias("end"))
    return G.auto_bin(g, size)


_BINS = """b AS (SELECT genome, seqid, CAST(unnest(range(0, length, {n})) AS INT) AS s, length FROM genome_seq),
bins AS (SELECT genome, seqid, s AS "start", CAST(least(s + {n}, length) AS INT) AS "end", CAST(s // {n} AS INT) AS bin_no FROM b)"""


@query("WITH " + _BINS.format(n=5000000) + """ SELECT genome, seqid, "start", "end", bin_no FROM bins""")
def auto_bin(spark, d):
    return _bins(spark, d)


@query("WITH " + _BINS.format(n=5000000) + f""" SELECT bins.genome, seqid, bins."start", bins."end", bins.bin_no, count(t.el_id) AS n FROM bins
LEFT JOIN (SELECT * FROM track_elements WHERE {GOOD}) t ON t.genome = bins.genome AND t.chr = seqid AND t."start" < bins."end" AND t."end" > bins."start" GROUP BY ALL""")
def count_per_bin(spark, d):
    return O.count_per_region(_segments(spark, d), _bins(spark, d), ["genome", "seqid"], 1_000_000)


@query(f"""WITH t AS (SELECT * FROM track_elements WHERE {GOOD}), u AS (SELECT * FROM linked_elements WHERE {GOOD})
SELECT t.genome, t.chr AS seqid, count(*) AS n_pairs, CAST(sum(least(t."end", u."end") - greatest(t."start", u."start")) AS BIGINT) AS overlap
FROM t JOIN u ON t.genome = u.genome AND t.chr = u.chr AND t."start" < u."end" AND t."end" > u."start" GROUP BY ALL""")
def overlap_join(spark, d):
    u = table(spark, d, "linked_elements").where(F.col("chr").isNotNull() & (F.col("end") > F.col("start"))).withColumnRenamed("chr", "seqid")
    a = _segments(spark, d).select("genome", "seqid", "start", "end")
    pairs = O.overlap_join(a, u.select("genome", "seqid", "start", "end"), ["genome", "seqid"], O.join_bin(a, "start", "end"))
    return pairs.groupBy("genome", "seqid").agg(F.count("*").alias("n_pairs"), F.sum(F.least("end", "end_r") - F.greatest("start", "start_r")).alias("overlap"))


@query("WITH " + _BINS.format(n=100000) + f""" SELECT el_id, loaded_at, t.genome, chr AS seqid FROM track_elements t WHERE {GOOD} AND EXISTS (SELECT 1 FROM bins
 WHERE bins.genome = t.genome AND bins.seqid = t.chr AND bins."start" <= t."start" AND bins."end" >= t."end" AND bins.bin_no % 3 = 0)""")
def contained_semi(spark, d):
    third = _bins(spark, d, 100_000).where("bin_no % 3 = 0").select("genome", "seqid", "start", "end")
    return O.contained_in(_segments(spark, d), third, ["genome", "seqid"], 100_000).select("el_id", "loaded_at", "genome", "seqid")


@query(f"""WITH t AS (SELECT el_id, chr AS seqid, "start", "end", lag("start") OVER w AS ps, lag("end") OVER w AS pe FROM step_elements WHERE {GOOD}
 WINDOW w AS (PARTITION BY sample_id, chr ORDER BY "start", "end", el_id, loaded_at))
SELECT el_id, coalesce("start" = pe OR ps = "end", false) AS touches, coalesce(ps < "end" AND pe > "start", false) AS overlaps,
 coalesce(ps <= "start" AND pe >= "end", false) AS contains, seqid || ':' || ("start" + 1) || '-' || "end" AS shown, "end" - "start" AS span FROM t""")
def region_predicates(spark, d):
    t = W.ordered_values(_steps(spark, d).select("sample_id", "seqid", "start", "end", "el_id", "loaded_at"), ["sample_id", "seqid"], ["start", "end", "el_id", "loaded_at"],
                         {"ps": (W.LAG, "start"), "pe": (W.LAG, "end")})
    a, b, s, e = F.col("ps"), F.col("pe"), F.col("start"), F.col("end")
    no = F.lit(False)
    return t.select("el_id", F.coalesce(R.touches(a, b, s, e), no).alias("touches"), F.coalesce(R.overlaps(a, b, s, e), no).alias("overlaps"),
                    F.coalesce(R.contains(a, b, s, e), no).alias("contains"), R.display(F.col("seqid"), s, e).alias("shown"), R.span(s, e).alias("span"))


@query(f"""WITH p AS (SELECT el_id, loaded_at, "start" AS s, "end" AS e, "start" + ("end" - "start") // 3 AS a, "end" - ("end" - "start") // 4 AS b FROM track_elements WHERE {GOOD})
SELECT el_id, loaded_at, s AS "start", CAST(CASE WHEN s < b AND e > a THEN a ELSE e END AS INT) AS "end" FROM p WHERE NOT (s < b AND e > a) OR a > s
UNION ALL SELECT el_id, loaded_at, CAST(b AS INT), e FROM p WHERE s < b AND e > a AND e > b""")
def exclude(spark, d):
    length = F.col("end") - F.col("start")
    t = _segments(spark, d).withColumns({"a": (F.col("start") + F.floor(length / 3)).cast("int"), "b": (F.col("end") - F.floor(length / 4)).cast("int")})
    pieces = R.exclude(F.col("start"), F.col("end"), F.col("a"), F.col("b"))
    return t.select("el_id", "loaded_at", F.explode(pieces).alias("p")).select("el_id", "loaded_at", F.col("p.start").alias("start"), F.col("p.end").alias("end"))


@query(f"""SELECT el_id, loaded_at, t."start" AS "start", CAST(least(t."end" + 100000, length) AS INT) AS "end", CAST(greatest(t."start" - 1000000, 0) AS INT) AS "start_back"
FROM track_elements t JOIN genome_seq q ON q.genome = t.genome AND q.seqid = t.chr WHERE {GOOD}""")
def extend_region(spark, d):
    g = table(spark, d, "genome_seq").select("genome", "seqid", "length")
    t = _segments(spark, d).join(g, ["genome", "seqid"])
    s, e = R.extend(F.col("start"), F.col("end"), 100_000, F.col("length"))
    back, _ = R.extend(F.col("start"), F.col("end"), -1_000_000, F.col("length"))
    return t.select("el_id", "loaded_at", s.alias("start"), e.alias("end"), back.alias("start_back"))


@query(f"""WITH a AS (SELECT DISTINCT genome, chr, "start" AS s, "end" AS e FROM linked_nodes WHERE {GOOD}), b AS (SELECT DISTINCT genome, chr, "start" AS s, "end" AS e FROM linked_elements WHERE {GOOD})
SELECT a.genome, a.chr AS seqid, greatest(a.s, b.s) AS "start", least(a.e, b.e) AS "end" FROM a JOIN b ON a.genome = b.genome AND a.chr = b.chr AND a.s < b.e AND a.e > b.s""")
def intersect_regions(spark, d):
    def of(name):
        t = table(spark, d, name).where(F.col("chr").isNotNull() & (F.col("end") > F.col("start"))).withColumnRenamed("chr", "seqid")
        return t.select("genome", "seqid", "start", "end").distinct()

    return O.intersect_regions(of("linked_nodes"), of("linked_elements"), ["genome", "seqid"])


@query(f"""SELECT genome, chr AS seqid, el_id, CAST("start" // 100000 AS INT) AS comp_bin, CAST("start" % 100000 AS INT) AS pos_in_bin FROM step_elements WHERE {GOOD}""")
def comp_bins(spark, d):
    return _steps(spark, d).select("genome", "seqid", "el_id", G.bin_number(F.col("start")).alias("comp_bin"), G.offset_in_bin(F.col("start")).alias("pos_in_bin"))


@query("WITH " + _BINS.format(n=3000000) + f""" SELECT el_id, t.genome, bins."start" AS region_start, bins."end" AS region_end FROM step_elements t
LEFT JOIN bins ON bins.genome = t.genome AND bins.seqid = t.chr AND t."start" >= bins."start" AND t."start" < bins."end" WHERE t.chr IS NOT NULL AND t."start" IS NOT NULL AND t."end" > t."start" """)
def region_of_position(spark, d):
    r = _bins(spark, d, 3_000_000).select("genome", "seqid", "start", "end")
    return O.region_of_position(_steps(spark, d), r, ["genome", "seqid"]).select("el_id", "genome", "region_start", "region_end")


# Coverage
_RUNS = f"""
WITH s AS (SELECT genome, chr, "start" AS s, "end" AS e, CASE WHEN isfinite(val) AND NOT isnan(val) THEN floor(val * 1000) ELSE 0 END AS v FROM track_elements WHERE {GOOD}),
ev AS (SELECT genome, chr, s AS pos, 1 AS d, coalesce(v, 0) AS v FROM s UNION ALL SELECT genome, chr, e, -1, -coalesce(v, 0) FROM s),
p AS (SELECT genome, chr, pos, sum(d) AS d, sum(v) AS v FROM ev GROUP BY ALL),
r AS (SELECT genome, chr AS seqid, pos AS "start", lead(pos) OVER w AS "end", CAST(sum(d) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth,
 sum(v) OVER (w ROWS UNBOUNDED PRECEDING) AS value FROM p WINDOW w AS (PARTITION BY genome, chr ORDER BY pos))
"""


@query(_RUNS + 'SELECT genome, seqid, "start", "end", depth FROM r WHERE "end" IS NOT NULL')
def coverage_runs(spark, d):
    return V.coverage_runs(_segments(spark, d), ["genome", "seqid"])


@query(_RUNS + 'SELECT genome, seqid, "start", "end", depth, CASE WHEN depth > 0 THEN value ELSE 0 END AS value FROM r WHERE "end" IS NOT NULL')
def value_runs(spark, d):
    milli = F.when(F.abs("val") < float("inf"), F.floor(F.col("val") * 1000).cast("double"))
    return V.coverage_runs(_segments(spark, d).withColumn("val", milli), ["genome", "seqid"], "val")


@query(_RUNS + 'SELECT genome, seqid, CAST(sum("end" - "start") AS BIGINT) AS covered FROM r WHERE "end" IS NOT NULL AND depth > 0 GROUP BY ALL')
def binary_span(spark, d):
    return V.binary_span(V.coverage_runs(_segments(spark, d), ["genome", "seqid"]), ["genome", "seqid"])


# Order
@query(f"""WITH t AS (SELECT genome, chr, "start" AS s, "end" AS e, max("end") OVER (PARTITION BY genome, chr ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
 FROM track_elements WHERE {GOOD}) SELECT genome, chr AS seqid, bool_or(coalesce(s < m, false)) AS has_overlap FROM t GROUP BY ALL""")
def has_overlap(spark, d):
    s = _segments(spark, d).select("genome", "seqid", "start", "end")
    t = W.ordered_values(s, ["genome", "seqid"], ["start", "end"], {"m": (W.MAX_BEFORE, "end")})
    return t.groupBy("genome", "seqid").agg(F.bool_or(F.coalesce(F.col("start") < F.col("m"), F.lit(False))).alias("has_overlap"))


@query(f"""SELECT el_id, "end" - "start" AS span, loaded_at FROM track_elements WHERE {GOOD} ORDER BY "end" - "start" DESC, el_id, loaded_at LIMIT 100""")
def topk_longest(spark, d):
    return _segments(spark, d).select("el_id", (F.col("end") - F.col("start")).alias("span"), "loaded_at").orderBy(F.desc("span"), "el_id", "loaded_at").limit(100)


@query(f"""SELECT el_id, genome, chr AS seqid, "start", "end", row_number() OVER (PARTITION BY genome, chr ORDER BY "start", "end", el_id) AS place
FROM (SELECT DISTINCT el_id, genome, chr, "start", "end" FROM step_elements WHERE {GOOD})""")
def sort_elements(spark, d):
    t = _steps(spark, d).select("el_id", "genome", "seqid", "start", "end").distinct()
    return W.ordered_values(t, ["genome", "seqid"], ["start", "end", "el_id"], {"place": (W.ROW, None)})


# Joins
@query("""WITH n AS (SELECT id, min(val) AS node_val, min(genome) AS node_genome FROM linked_nodes GROUP BY id)
SELECT link_id, source_id AS id, CASE WHEN n.id IS NOT NULL THEN node_val ELSE 'NaN'::DOUBLE END AS node_val, CASE WHEN n.id IS NOT NULL THEN node_genome ELSE '.' END AS node_genome
FROM link_rows LEFT JOIN n ON n.id = source_id""")
def complement_by_id(spark, d):
    nodes = table(spark, d, "linked_nodes").groupBy("id").agg(F.min("val").alias("node_val"), F.min("genome").alias("node_genome"))
    links = table(spark, d, "link_rows").select("link_id", F.col("source_id").alias("id"))
    return complement(links, nodes, "id", ["node_val", "node_genome"])


@query("""WITH n AS (SELECT genome, chr, "start", "end", min(id) AS node_id, count(*) AS n FROM linked_nodes GROUP BY ALL)
SELECT e.el_id, CASE WHEN n.n IS NOT NULL THEN n.node_id ELSE '.' END AS node_id FROM linked_elements e LEFT JOIN n ON n.genome IS NOT DISTINCT FROM e.genome
 AND n.chr IS NOT DISTINCT FROM e.chr AND n."start" IS NOT DISTINCT FROM e."start" AND n."end" IS NOT DISTINCT FROM e."end" """)
def complement_by_position(spark, d):
    nodes = table(spark, d, "linked_nodes").withColumnRenamed("chr", "seqid").groupBy("genome", "seqid", "start", "end").agg(F.min("id").alias("node_id"))
    return complement(table(spark, d, "linked_elements").withColumnRenamed("chr", "seqid"), nodes, "position", ["node_id"]).select("el_id", "node_id")


# Graphs: links as edges of their node set
def _links(spark, d):
    return table(spark, d, "link_rows").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "weight")


_NODES = "n AS (SELECT DISTINCT id FROM linked_nodes WHERE genome = 'nv2')"


@query("""WITH o AS (SELECT o_custkey, list(o_orderkey::VARCHAR ORDER BY o_orderkey) AS ks, list(o_totalprice ORDER BY o_orderkey) AS ws FROM orders GROUP BY o_custkey)
SELECT o_custkey::VARCHAR AS src, unnest(ks) AS dst, unnest(ws) AS weight FROM o""")
def edges_explode(spark, d):
    packed = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("x"))
    track = packed.select(F.col("o_custkey").cast("string").alias("id"), F.transform("x", lambda r: r["o_orderkey"].cast("string")).alias("edges"),
                          F.transform("x", lambda r: r["o_totalprice"]).alias("weights"))
    return GR.edge_list(track)


@query(f"WITH {_NODES} SELECT source_id AS src, target_id AS dst, weight FROM link_rows WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)")
def subgraph(spark, d):
    return GR.subgraph(table(spark, d, "linked_nodes"), _links(spark, d), F.col("genome") == "nv2")[1]


@query(f"""WITH {_NODES}, e AS (SELECT source_id AS a, target_id AS b, weight AS w FROM link_rows WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)),
u AS (SELECT * FROM e UNION ALL SELECT b, a, w FROM e WHERE a <> b) SELECT a AS id, count(*) AS degree FROM u GROUP BY a""")
def neighbour_degree(spark, d):
    nodes = table(spark, d, "linked_nodes").where("genome = 'nv2'")
    return GR.neighbours(_links(spark, d), nodes, True).groupBy("id").agg(F.count("*").alias("degree"))


@query("SELECT source_id AS row_id, target_id AS col_id, max(weight) AS weight FROM link_rows WHERE source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY ALL")
def edge_weight_matrix_long(spark, d):
    return GR.weight_matrix(_links(spark, d).dropna(subset=["src", "dst"]))


@query("""SELECT r.link_id FROM link_rows r WHERE source_id <> target_id AND NOT EXISTS (SELECT 1 FROM link_rows b WHERE b.source_id = r.target_id AND b.target_id = r.source_id
 AND b.weight IS NOT DISTINCT FROM r.weight)""")
def undirected_violations(spark, d):
    t = table(spark, d, "link_rows").select("link_id", F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "weight")
    return GR.asymmetric(t).select("link_id")


@query("SELECT link_id, target_id AS dst FROM link_rows WHERE target_id IS NULL OR target_id NOT IN (SELECT id FROM linked_nodes WHERE id IS NOT NULL)")
def dangling_edges(spark, d):
    t = table(spark, d, "link_rows").select("link_id", F.col("target_id").alias("dst"))
    return GR.dangling(t, table(spark, d, "linked_nodes"))


@query("""SELECT id, genome, g AS graph FROM (SELECT id, genome, g, row_number() OVER (PARTITION BY id ORDER BY g DESC) AS n FROM
 (SELECT id, min(genome) AS genome, 0 AS g FROM linked_nodes GROUP BY id UNION ALL SELECT id, min(genome), 1 FROM linked_elements WHERE id IS NOT NULL GROUP BY id)) WHERE n = 1""")
def merge_graphs(spark, d):
    a = table(spark, d, "linked_nodes").groupBy("id").agg(F.min("genome").alias("genome")).withColumn("graph", F.lit(0))
    b = table(spark, d, "linked_elements").where("id is not null").groupBy("id").agg(F.min("genome").alias("genome")).withColumn("graph", F.lit(1))
    return GR.merge_graphs(a, b)


# Statistics and catalogue
@query(f"""SELECT genome, chr AS seqid, count(*) AS n_elements, max("end" - "start") AS max_length FROM track_elements WHERE {GOOD} GROUP BY ALL""")
def track_stats(spark, d):
    return ST.track_stats(_segments(spark, d).select("genome", "seqid", "start", "end", "val"), ["genome", "seqid"])


@query("SELECT genome, count(DISTINCT val) AS n_categories FROM linked_elements WHERE val IS NOT NULL GROUP BY genome")
def category_sets(spark, d):
    return ST.n_categories(table(spark, d, "linked_elements"), "val", ["genome"])


@query("""WITH c AS (SELECT i.track_name, count(t.el_id) AS n FROM track_info i LEFT JOIN track_elements t USING (track_id) GROUP BY i.track_id, i.track_name),
p AS (SELECT string_split(track_name, ':') AS ps, n FROM c), x AS (SELECT array_to_string(ps[1:k], ':') AS name, n FROM (SELECT ps, n, unnest(range(1, len(ps) + 1)) AS k FROM p))
SELECT name, CAST(sum(n) AS BIGINT) AS n FROM x GROUP BY name""")
def sub_track_counts(spark, d):
    counts = table(spark, d, "track_elements").groupBy("track_id").agg(F.count("el_id").alias("n"))
    named = table(spark, d, "track_info").join(counts, "track_id", "left").select("track_name", F.coalesce("n", F.lit(0)).alias("n"))
    return ST.roll_up_names(named, "track_name", "n")


@query("""SELECT track_id, string_split(track_name, ':')[-1] AS short, lower(track_type) AS kind FROM track_info""")
def track_names(spark, d):
    return table(spark, d, "track_info").select("track_id", X.pretty_name(F.col("track_name")).alias("short"), F.lower("track_type").alias("kind"))


@query("""SELECT 'track' AS src, genome, chr, "start", "end" FROM track_elements UNION ALL SELECT 'step', genome, chr, "start", "end" FROM step_elements""")
def union_files(spark, d):
    def of(name, src):
        return table(spark, d, name).select(F.lit(src).alias("src"), "genome", "chr", "start", "end")

    return ST.multi_file(of("track_elements", "track"), of("step_elements", "step"))


@query("""WITH r AS (SELECT q.genome, q.seqid, q.length, CASE WHEN q.ord = m.last AND q.genome = m.first THEN 1 ELSE 0 END AS s FROM genome_seq q,
 (SELECT max(ord) AS last, min(genome) AS first FROM genome_seq WHERE genome = (SELECT min(genome) FROM genome_seq)) m)
SELECT genome, bool_and(s = 0) AS all_whole FROM r GROUP BY genome""")
def whole_regions(spark, d):
    """The last sequence of the first genome lacks its first position."""
    g = table(spark, d, "genome_seq")
    names = [r["genome"] for r in g.select("genome").distinct().orderBy("genome").collect()]  # a dimension
    last = g.where(F.col("genome") == names[0]).agg(F.max("ord")).first()[0]
    out = None
    for name in names:
        cut = F.when((F.col("ord") == last) & F.lit(name == names[0]), 1).otherwise(0)
        one = ST.all_whole(g.where(F.col("genome") == name).select("genome", "seqid", cut.alias("start"), F.col("length").alias("end")), g).withColumn("genome", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH c AS (SELECT genome, chr AS seqid, count(*) AS el_count FROM track_elements WHERE {GOOD} GROUP BY ALL)
SELECT genome, seqid, el_count, CAST(sum(el_count) OVER w - el_count AS BIGINT) AS start_idx, CAST(sum(el_count) OVER w AS BIGINT) AS end_idx FROM c
WINDOW w AS (PARTITION BY genome ORDER BY seqid ROWS UNBOUNDED PRECEDING)""")
def region_offsets(spark, d):
    c = _segments(spark, d).groupBy("genome", "seqid").agg(F.count("*").alias("el_count")).withColumn("start", F.lit(0))
    return ST.cumulative_offsets(c).drop("start")


# Header inference
@query(f"""WITH t AS (SELECT genome, chr, "start" AS s, "end" AS e, max("end") OVER (PARTITION BY sample_id, chr ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m,
 lag({{'a': "start", 'b': "end"}}) OVER (PARTITION BY sample_id, chr ORDER BY el_id, loaded_at) AS b FROM step_elements WHERE {GOOD})
SELECT bool_and(coalesce(b <= {{'a': s, 'b': e}}, true)) AS sorted, bool_and(coalesce(s >= m, true)) AS no_overlaps, bool_or(e <= s) AS circular FROM t""")
def header_flags(spark, d):
    return infer_flags(_steps(spark, d), ["sample_id", "seqid"], ["el_id", "loaded_at"])


@query("""SELECT 'l_quantity' AS "column", 'number' AS value_type, 'scalar' AS dimension, false AS all_missing UNION ALL SELECT 'l_returnflag', 'character', 'scalar', false
UNION ALL SELECT 'status', 'category', 'scalar', false UNION ALL SELECT 'pair', 'number', 'pair', false UNION ALL SELECT 'flags', 'binary', 'vector', false
UNION ALL SELECT 'none', 'number', 'scalar', true""")
def header_inference(spark, d):
    t = table(spark, d, "lineitem")
    cells = t.select(F.col("l_quantity").cast("string").alias("l_quantity"), F.trim("l_returnflag").alias("l_returnflag"), F.concat(F.trim("l_returnflag"), F.trim("l_linestatus")).alias("status"),
                     F.concat_ws(",", F.col("l_tax").cast("string"), F.lit(".")).alias("pair"),
                     F.concat(F.when(F.col("l_tax") > 0.04, "1").otherwise("0"), F.lit("."), F.lit("1")).alias("flags"), F.lit(".").alias("none"))
    return infer_columns(cells, cells.columns)


# Readers and writers: lines made of a table and parsed back
def _as_lines(df, *cells):
    order = F.struct(F.lit(0).cast("long").alias("block"), F.col("el_id").alias("nth"))
    return df.select(F.lit("f").alias("file"), order.alias("ord"), F.concat_ws("\t", *cells).alias("line"))


def _strand():
    return F.when(F.col("strand") == 1, "+").when(F.col("strand") == 0, "-").otherwise(".")


@query(f"""SELECT el_id, chr AS seqid, "start", "end", CAST(abs("start") % 1001 AS INT) AS val, CAST(CASE WHEN strand = 1 THEN 1 WHEN strand = 0 THEN 0 ELSE -1 END AS TINYINT) AS strand,
 'n' || el_id AS name FROM track_elements WHERE {GOOD} AND "start" >= 0""")
def bed_parse_lines(spark, d):
    s = _segments(spark, d).where("start >= 0")
    lines = _as_lines(s, "seqid", "start", "end", F.concat(F.lit("n"), F.col("el_id")), F.abs("start") % 1001, _strand())
    return P.bed(lines).where("error is null").select(F.col("ord.nth").alias("el_id"), "seqid", "start", "end", "val", "strand", "name")


@query(f"""SELECT el_id, chr AS seqid, "start", "end", CASE WHEN val::VARCHAR <> 'nan' THEN val END AS val, val::VARCHAR = 'nan' AS missing
FROM track_elements WHERE {GOOD} AND "start" >= 0 AND val IS NOT NULL""")
def bedgraph_parse_lines(spark, d):
    s = _segments(spark, d).where("start >= 0 and val is not null")
    value = F.when(F.isnan("val"), "NaN").otherwise(F.col("val").cast("string"))
    parsed = P.bedgraph(_as_lines(s, "seqid", "start", "end", value)).where("error is null")
    return parsed.select(F.col("ord.nth").alias("el_id"), "seqid", "start", "end", F.nanvl("val", F.lit(None).cast("double")).alias("val"), F.isnan("val").alias("missing"))


@query(f"""SELECT el_id, chr AS seqid, "start" - 1 AS "start", "end", 'e' || el_id AS id, 'a+b c' AS name FROM track_elements WHERE {GOOD} AND "start" >= 1""")
def gff_parse_lines(spark, d):
    s = _segments(spark, d).where("start >= 1")
    attributes = F.concat(F.lit("ID=e"), F.col("el_id"), F.lit(";Name=a+b%20c"))
    lines = _as_lines(s, "seqid", F.lit("src"), F.lit("site"), "start", "end", F.lit("."), _strand(), F.lit("."), attributes)
    return P.gff(lines).where("error is null").select(F.col("ord.nth").alias("el_id"), "seqid", "start", "end", "id", "name")


@query("""SELECT o_orderkey, 100 * (o_custkey % 1000) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS "start", CAST(o_totalprice AS DOUBLE) AS val, 'c' || o_custkey AS seqid
FROM orders""")
def wig_parse_lines(spark, d):
    o = table(spark, d, "orders")
    block = F.col("o_custkey").cast("long")
    data = o.select(F.struct(block.alias("block"), F.col("o_orderkey").cast("long").alias("nth")).alias("ord"), F.col("o_totalprice").cast("string").alias("line"))
    heads = o.select(block.alias("b")).distinct().select(F.struct(F.col("b").alias("block"), F.lit(-1).cast("long").alias("nth")).alias("ord"),
                                                         F.format_string("fixedStep chrom=c%d start=%d step=1", F.col("b"), F.col("b") % 1000 * 100 + 1).alias("line"))
    lines = heads.unionByName(data).withColumn("file", F.col("ord.block").cast("string")).select("file", "ord", "line")
    return P.wig(lines).where("error is null").select(F.col("ord.nth").alias("o_orderkey"), F.col("start").cast("long").alias("start"), "val", "seqid")


@query("""SELECT p_partkey AS seqid, CAST(i - 1 AS INT) AS "start", p_name[i] AS val FROM (SELECT p_partkey, replace(p_name, ' ', '') AS p_name, unnest(range(1, len(replace(p_name, ' ', '')) + 1)) AS i FROM part)""")
def fasta_parse_lines(spark, d):
    p = table(spark, d, "part")
    name = F.replace("p_name", F.lit(" "), F.lit(""))
    rows = F.explode(F.array(F.struct(F.lit(0).alias("n"), F.concat(F.lit(">"), F.col("p_partkey")).alias("x")), F.struct(F.lit(1).alias("n"), F.substring(name, 1, 7).alias("x")),
                             F.struct(F.lit(2).alias("n"), F.substring(name, F.lit(8), F.length(name)).alias("x"))))
    lines = p.select("p_partkey", rows.alias("r")).select(F.col("p_partkey").cast("string").alias("file"), F.struct(F.lit(0).cast("long").alias("block"), F.col("r.n").cast("long").alias("nth")).alias("ord"), F.col("r.x").alias("line"))
    return P.fasta(lines).select(F.col("seqid").cast(p.schema["p_partkey"].dataType).alias("seqid"), "start", "val")


@query(f"""SELECT el_id, chr AS seqid, "start", "end", CASE WHEN val IS NULL OR val = '.' THEN '' ELSE val END AS val, 'n' || el_id || '|b%2;=,' AS edges FROM linked_elements WHERE {GOOD}""")
def headed_round_trip(spark, d):
    """Missing values come back as empty ones; ids of edges may hold the signs of the format."""
    t = table(spark, d, "linked_elements").where(F.col("chr").isNotNull() & (F.col("end") > F.col("start")))
    edges = F.array(F.format_string("n%d", "el_id"), F.lit("b%2;=,"))
    t = t.withColumnRenamed("chr", "seqid").select("seqid", "start", "end", "val", F.col("el_id").cast("string").alias("id"), edges.alias("edges"))
    h = SH.header_for(t)
    out = SH.compose(t.withColumn("row_ord", F.col("id").cast("long")), h)
    lines = out.select(F.lit("f").alias("file"), F.struct(F.lit(0).cast("long").alias("block"), F.col("k_row").alias("nth")).alias("ord"), "line")
    back = H.parse(lines, H.parse_header(SH.header_lines(h)))
    return back.where("error is null").select(F.col("id").cast("long").alias("el_id"), "seqid", "start", "end", "val", F.array_join("edges", "|").alias("edges"))


@query(f"""SELECT chr || chr(9) || "start" || chr(9) || "end" || chr(9) || 'n' || el_id || chr(9) || 0 || chr(9) || CASE WHEN strand = 1 THEN '+' WHEN strand = 0 THEN '-' ELSE '.' END AS line
FROM track_elements WHERE {GOOD}""")
def bed_compose_lines(spark, d):
    s = _segments(spark, d).select("seqid", "start", "end", "strand", F.concat(F.lit("n"), F.col("el_id")).alias("name"))
    return SF.bed(s).select("line")


# Null models: what must stay the same
_LATEST = "SELECT * FROM {table} QUALIFY el_id IS NULL OR row_number() OVER (PARTITION BY el_id ORDER BY loaded_at DESC) = 1"


def _latest(df):
    """The version of every el_id that was loaded last; rows without one stay."""
    own = df.where("el_id is not null").groupBy("el_id").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), "loaded_at").alias("r"))
    return own.select("r.*").unionByName(df.where("el_id is null"))


def _marks(spark, d):
    t = _latest(table(spark, d, "step_elements"))
    return t.where(F.col("chr").isNotNull() & (F.col("end") > F.col("start")) & F.col("val").isNotNull()).withColumnRenamed("chr", "seqid")


@query(f"""WITH t AS ({_LATEST.format(table="step_elements")})
SELECT genome, chr AS seqid, CASE WHEN NOT isnan(val) THEN val END AS val, isnan(val) AS missing, count(*) AS n_elements
FROM t WHERE {GOOD} AND val IS NOT NULL GROUP BY ALL""")
def shuffled_marks_invariants(spark, d):
    """The multiset of values of every sequence stays what it was."""
    x = RND.shuffle_marks(_marks(spark, d), ["genome", "seqid"], "val", 7, ["el_id"])
    return x.groupBy("genome", "seqid", F.nanvl("val", F.lit(None).cast("double")).alias("val"), F.isnan("val").alias("missing")).agg(F.count("*").alias("n_elements"))


@query(f"""WITH t AS ({_LATEST.format(table="step_elements")})
SELECT el_id, genome, chr AS seqid, "start", "end", true AS most_moved FROM t WHERE {GOOD} AND val IS NOT NULL""")
def shuffled_marks_places(spark, d):
    """Every element keeps its place, and most of all elements get the value of another one."""
    x = RND.shuffle_marks(_marks(spark, d).withColumn("was", F.col("val")), ["genome", "seqid"], "val", 7, ["el_id"])
    moved = x.agg((F.avg((F.col("was") != F.col("val")).cast("int")) > 0.5).alias("most_moved")).first()[0]
    return x.select("el_id", "genome", "seqid", "start", "end", F.lit(moved).alias("most_moved"))


def _permuted(sampled):
    def f(spark, d):
        s = C.cluster(_segments(spark, d).select("genome", "seqid", "start", "end"), ["genome", "seqid"]).drop("n_elements")
        g = table(spark, d, "genome_seq").select("genome", "seqid", F.lit(0).alias("b0"), F.col("length").alias("b1"))
        s = s.join(g, ["genome", "seqid"]).where(F.col("end") <= F.col("b1"))
        p = RND.permute_segments(s, ["genome", "seqid"], "b0", "b1", 11, ["start"], sampled)
        p = W.ordered_values(p.select("genome", "seqid", "start", "end", "b1"), ["genome", "seqid"], ["start", "end"], {"before": (W.MAX_BEFORE, "end")})
        p = p.withColumn("clash", F.coalesce(F.col("before") > F.col("start"), F.lit(False)) | (F.col("start") < 0) | (F.col("end") > F.col("b1")))
        return p.groupBy("genome", "seqid").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("total"), F.count(F.when(F.col("clash"), 1)).alias("n_clashes"))

    return f


_PERMUTED = _ISLANDS.format(table="track_elements") + """, c AS (SELECT genome, chr AS seqid, isl, min("start") AS s, max("end") AS e FROM g GROUP BY ALL)
SELECT c.genome, c.seqid, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS total, 0::BIGINT AS n_clashes FROM c JOIN genome_seq q ON q.genome = c.genome AND q.seqid = c.seqid WHERE e <= length GROUP BY ALL"""
for _name, _sampled in (("permuted_segments_invariants", False), ("sampled_gaps_invariants", True)):
    QUERIES[_name], SQL[_name] = _permuted(_sampled), _PERMUTED


def _intensity(spark, d):
    e = table(spark, d, "embeddings")
    key, vec = e.columns[0], next(f.name for f in e.schema.fields if f.dataType.typeName() == "array")
    dense = e.select(F.col(key).alias("vec_id"), F.posexplode(vec).alias("start", "val"))
    # Intensities of 0 are never drawn.
    return dense.withColumn("val", F.greatest(F.col("val"), F.lit(0.0)))


_POSITIVE = "p AS (SELECT vec_id, count(*) FILTER (WHERE v > 0) AS k, count(*) AS dim FROM (SELECT {key} AS vec_id, unnest({vec}) AS v FROM embeddings) GROUP BY vec_id)"


@query("WITH " + _POSITIVE.format(key="vec_id", vec="embedding") + " SELECT vec_id, least(5 + vec_id % 60, k) AS n, 0::BIGINT AS repeated, 0::BIGINT AS not_positive FROM p WHERE k > 0")
def sampled_by_intensity_counts(spark, d):
    """As many points as wanted (or as there are positions of any intensity), all of them different."""
    dense = _intensity(spark, d)
    wanted = dense.select("vec_id").distinct().withColumn("n", 5 + F.col("vec_id") % 60)
    points = RND.sample_by_intensity(dense, ["vec_id"], wanted, 3)
    held = points.join(dense, ["vec_id", "start"])
    return held.groupBy("vec_id").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("start")).alias("repeated"), F.count(F.when(F.col("val") <= 0, 1)).alias("not_positive"))


# Windows in time (an extension)
@query("""SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS total
FROM events GROUP BY ALL""")
def events_per_hour(spark, d):
    """Counts, and sums in whole thousandths, which don't depend on the order of addition."""
    e = table(spark, d, "events").withColumn("value", F.floor(F.col("value") * 1000))
    return streaming.windowed_counts(e, "ts", "event_type", "value")


# Analysis regions
@query(_ISLANDS.format(table="linked_elements") + """, c AS (SELECT genome, chr AS seqid, isl, min("start") AS s, max("end") AS e FROM g GROUP BY ALL)
SELECT c.genome, c.seqid, s AS "start", e AS "end" FROM c JOIN genome_seq q ON q.genome = c.genome AND q.seqid = c.seqid WHERE s >= 0 AND e <= length""")
def track_envelope(spark, d):
    t = table(spark, d, "linked_elements").where(F.col("chr").isNotNull()).withColumnRenamed("chr", "seqid")
    return U.envelope(t, table(spark, d, "genome_seq"))


@query("SELECT el_id, val FROM linked_elements WHERE contains(val, 'oo') OR contains(val, 'em')")
def category_filter(spark, d):
    return U.category_filter(table(spark, d, "linked_elements"), ["oo", "em"], strict=False).select("el_id", "val")


@query("WITH " + _BINS.format(n=5000000) + f""" SELECT bins.genome, bins.seqid, bins."start", bins."end", CAST(max(t."end" - t."start") AS DOUBLE) AS val FROM bins
JOIN (SELECT * FROM linked_elements WHERE {GOOD}) t ON t.genome = bins.genome AND t.chr = bins.seqid AND t."start" < bins."end" AND t."end" > bins."start" GROUP BY ALL""")
def window_callback(spark, d):
    t = table(spark, d, "linked_elements").where(F.col("chr").isNotNull() & (F.col("end") > F.col("start"))).withColumnRenamed("chr", "seqid")
    return U.window_function(t.select("genome", "seqid", "start", "end"), _bins(spark, d), ["genome", "seqid"], lambda x: float((x["end"] - x["start"]).max()), size=1_000_000)
