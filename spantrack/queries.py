"""Queries over the given tables, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators.faults import parse_track_lines, split_valid
from .operators.heavy_keys import heavy_keys, per_key_summary
from .operators.intervals import covered_and_gaps
from .operators.orphans import orphan_references
from .operators.packed import unpack_lists
from .session import materialise, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# 1. Rows that fail to parse
_P1 = r"""
WITH d AS (SELECT DISTINCT line_id, genome, string_split(col_spec, ',') AS spec, regexp_replace(raw_line, '\r$', '') AS line
           FROM raw_track_lines),
e AS (SELECT * FROM d WHERE line IS NOT NULL AND regexp_matches(line, '\S') AND line[1] <> '#' AND line[1:6] <> 'track '),
m AS (SELECT *, CASE WHEN contains(line, '"') THEN regexp_extract_all(chr(9) || line, '\t("[^"]*(?:""[^"]*)*"|[^"\t]*)', 1)
                ELSE string_split(line, chr(9)) END AS cells,
  NOT regexp_full_match(line, '(?:"[^"]*(?:""[^"]*)*"|[^"\t]*)(?:\t(?:"[^"]*(?:""[^"]*)*"|[^"\t]*))*') AS bad_quotes FROM e),
c AS (SELECT line_id, genome, bad_quotes, len(cells) <> len(spec) AS bad_count,
  list_transform(['seqid','start','end','value'], lambda n: coalesce(CASE WHEN cells[list_position(spec, n)][1] = '"'
   THEN replace(cells[list_position(spec, n)][2:-2], '""', '"') ELSE cells[list_position(spec, n)] END, '')) AS v FROM m),
t AS (SELECT c.line_id, bad_quotes, bad_count, s.length AS len, v[1] AS seqid,
  CASE WHEN regexp_full_match(v[2], '[0-9]+') THEN try_cast(v[2] AS HUGEINT) END AS s,
  CASE WHEN regexp_full_match(v[3], '[0-9]+') THEN try_cast(v[3] AS HUGEINT) END AS e,
  lower(v[4]) IN ('.', 'na', 'nan', 'n/a', 'none') AS missing,
  CASE WHEN regexp_full_match(v[4], '[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?') AND isfinite(try_cast(v[4] AS DOUBLE)) THEN try_cast(v[4] AS DOUBLE) END AS x
  FROM c LEFT JOIN genome_seq s ON s.genome = c.genome AND s.seqid = v[1]),
r AS (SELECT *, CASE WHEN bad_quotes THEN 'quoting' WHEN bad_count THEN 'column_count' WHEN len IS NULL THEN 'seqid'
  WHEN s IS NULL OR s >= len THEN 'start' WHEN e IS NULL OR e <= s OR e > len THEN 'end'
  WHEN NOT missing AND x IS NULL THEN 'value' END AS reason FROM t)
"""


@query(_P1 + "SELECT line_id, reason FROM r WHERE reason IS NOT NULL")
def p1_found(spark, d):
    return split_valid(parse_track_lines(table(spark, d, "raw_track_lines"), table(spark, d, "genome_seq")))[1].select(
        "line_id", "reason")


@query(_P1 + """SELECT line_id, seqid, CAST(s AS INT) AS "start", CAST(e AS INT) AS "end", x AS value FROM r WHERE reason IS NULL""")
def p1_valid(spark, d):
    return split_valid(parse_track_lines(table(spark, d, "raw_track_lines"), table(spark, d, "genome_seq")))[0].drop("genome")


# 2. A few keys holding most records
@query("""SELECT chr FROM track_elements WHERE chr IS NOT NULL GROUP BY chr
HAVING count(*) * 100 >= 4 * (SELECT count(*) FROM track_elements)""")
def p2_found(spark, d):
    return heavy_keys(table(spark, d, "track_elements"), "chr", "start", "val", "el_id", 4).select(F.col("key").alias("chr"))


def _p2_sql(name: str) -> str:
    return f"""
WITH o AS (SELECT chr, "start" AS p, val, "start" - lag("start") OVER (PARTITION BY chr ORDER BY "start" NULLS FIRST) AS step FROM {name})
SELECT chr AS key, count(*) AS n_rows, count(DISTINCT p) AS n_starts, CAST(coalesce(max(step), 0) AS BIGINT) AS max_step,
 CAST(min(p) AS BIGINT) AS first_start, CAST(max(p) AS BIGINT) AS last_start,
 count(val) FILTER (WHERE NOT isnan(val)) AS n_val,
 CAST(coalesce(sum(CASE WHEN isfinite(val) THEN CAST(floor(val * 1000) AS BIGINT) END), 0) AS BIGINT) AS sum_milli,
 min(val) FILTER (WHERE NOT isnan(val)) AS min_val, max(val) FILTER (WHERE NOT isnan(val)) AS max_val
FROM o GROUP BY chr"""


def _narrow_sum(summary: DataFrame) -> DataFrame:
    """The sum as the BIGINT of the SQL; one that doesn't fit raises."""
    return summary.withColumn("sum_milli", F.col("sum_milli").cast("long"))


@query(_p2_sql("track_elements"))
def p2_summary_track(spark, d):
    return _narrow_sum(per_key_summary(table(spark, d, "track_elements"), "chr", "start", "val", "el_id"))


@query(_p2_sql("step_elements"))
def p2_summary_step(spark, d):
    return _narrow_sum(per_key_summary(table(spark, d, "step_elements"), "chr", "start", "val", "el_id"))


# 4. Overlapping and gapped intervals
@query("""
WITH s AS (SELECT DISTINCT sample_id, chr, "start" AS s, "end" AS e FROM track_elements WHERE chr IS NOT NULL AND "end" > "start"),
o AS (SELECT *, max(e) OVER (PARTITION BY sample_id, chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s),
g AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id, chr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM o),
p AS (SELECT sample_id, chr, isl, min(s) AS s, max(e) AS e FROM g GROUP BY ALL),
q AS (SELECT *, lead(s) OVER (PARTITION BY sample_id, chr ORDER BY isl) AS nx FROM p)
SELECT sample_id, chr, 'period' AS kind, s AS "start", e AS "end" FROM p
UNION ALL SELECT sample_id, chr, 'gap', e, nx FROM q WHERE nx IS NOT NULL""")
def p4_found(spark, d):
    rows = table(spark, d, "track_elements").where(F.col("chr").isNotNull())
    return covered_and_gaps(rows, ["sample_id", "chr"], "start", "end")


# 6. Several values packed in one field
_P6 = r"""
lists AS (SELECT DISTINCT el_id, field, trim(text, chr(9) || ' ') AS text, t FROM (
 SELECT el_id, 'edges' AS field, edges AS text, loaded_at AS t FROM linked_elements
 UNION ALL SELECT el_id, 'weights', weights, loaded_at FROM linked_elements)),
bare AS (SELECT el_id, field, t, CASE WHEN regexp_full_match(text, '(?s)(\[.*\]|\(.*\)|\{.*\}|<.*>)')
  THEN trim(text[2:-2], chr(9) || ' ') ELSE text END AS text FROM lists),
pieces AS (SELECT el_id, field, t, regexp_extract_all(text,
  '"[^"]*(?:""[^"]*)*"|''[^'']*(?:''''[^'']*)*''|[A-Za-z0-9_:.+\-]+|[ \t]*[^A-Za-z0-9_:.+\- \t"''][ \t]*|["'']|[ \t]+') AS p FROM bare),
placed AS (SELECT el_id, field, t, unnest(p) AS piece, unnest(list_transform(range(1, len(p) + 1), lambda i:
  len(list_filter(p[1:i], lambda x: NOT regexp_matches(x, '^[A-Za-z0-9_:.+\-]') AND (len(x) < 2 OR NOT x[1] IN ('"', chr(39))))))) AS pos
  FROM pieces),
items AS (SELECT el_id, field, t, CAST(pos AS INT) AS pos, CASE WHEN piece[1] = '"' THEN replace(piece[2:-2], '""', '"')
  WHEN piece[1] = chr(39) THEN replace(piece[2:-2], repeat(chr(39), 2), chr(39)) ELSE piece END AS item FROM placed
  WHERE piece <> '.' AND (regexp_matches(piece, '^[A-Za-z0-9_:.+\-]') OR (len(piece) > 1 AND piece[1] IN ('"', chr(39)))))
"""


@query("WITH " + _P6 + "SELECT DISTINCT el_id, field, pos, item FROM items")
def p6_found(spark, d):
    rows = table(spark, d, "linked_elements").select("el_id", "edges", "weights").distinct()
    return unpack_lists(rows, "el_id", ["edges", "weights"])


# 3. References to records that do not exist
def _references(spark, d):
    elements = table(spark, d, "linked_elements").select("el_id", "edges", "loaded_at").distinct()
    named = unpack_lists(elements, "el_id", ["edges"], ["loaded_at"]).select(
        F.lit("linked_elements").alias("ref_table"), F.col("el_id").alias("row_id"), F.col("item").alias("ref_id"),
        F.col("loaded_at").alias("ref_time"))
    links = table(spark, d, "link_rows").select(
        F.lit("link_rows").alias("ref_table"), F.col("link_id").alias("row_id"),
        F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("ref_id"), F.col("loaded_at").alias("ref_time"))
    # The sampling of range borders and the pass itself both read the references.
    return materialise(named).unionByName(links)


def _orphans(spark, d):
    return orphan_references(_references(spark, d), table(spark, d, "linked_nodes"), "id", "loaded_at", "removed_at").select(
        "ref_table", F.date_format("ref_time", "yyyy-MM").alias("period"), "row_id", "ref_id").distinct()


_P3 = "WITH " + _P6 + """,
refs AS (SELECT 'linked_elements' AS ref_table, el_id AS row_id, item AS ref_id, t FROM items WHERE field = 'edges'
 UNION SELECT 'link_rows', link_id, source_id, loaded_at FROM link_rows WHERE source_id IS NOT NULL
 UNION SELECT 'link_rows', link_id, target_id, loaded_at FROM link_rows WHERE target_id IS NOT NULL),
missing AS (SELECT DISTINCT ref_table, strftime(t, '%Y-%m') AS period, row_id, ref_id FROM refs r WHERE NOT EXISTS (
 SELECT 1 FROM linked_nodes n WHERE n.id = r.ref_id AND n.loaded_at <= r.t AND (n.removed_at IS NULL OR n.removed_at > r.t)))
"""


@query(_P3 + "SELECT * FROM missing")
def p3_found(spark, d):
    return _orphans(spark, d)


@query(_P3 + "SELECT ref_table, period, count(*) AS n_orphans, count(DISTINCT ref_id) AS n_ids FROM missing GROUP BY ALL")
def p3_by_period(spark, d):
    per_id = _orphans(spark, d).groupBy("ref_table", "period", "ref_id").agg(F.count("*").alias("n"))
    return per_id.groupBy("ref_table", "period").agg(F.sum("n").alias("n_orphans"), F.count("*").alias("n_ids"))
