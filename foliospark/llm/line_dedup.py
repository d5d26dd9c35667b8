"""Line dedup by distinct-site spread: lines that many sites share are boilerplate and stay only once.

Each line's key (64-bit hash of the trimmed line) carries a HyperLogLog sketch of its sites; sketches merge by
aggregation, so a line that a third of all documents hold is summed up map-side. Estimates clearly above or
below the threshold decide; lines near it get exact distinct counts. Of a boilerplate line the first
occurrence (smallest id, then position) stays, all others go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stage

#: Sites on which a line must be found to count as boilerplate.
MIN_SITES = 10
#: Shorter lines (trimmed, in characters) never count as boilerplate: they recur by chance.
MIN_CHARS = 15
LG_K = 12
_SPACE = " \t\r"


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_chars: int) -> DataFrame:
    """doc_id, key (128 bits of the text), site, pos, line (hash) of each line long enough."""
    row = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{site_col}`").cast("string"), F.lit("")).alias("site"))
    row = row.select("doc_id", "site", F.unhex(F.md5("text")).alias("key"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    row = row.withColumn("trimmed", F.btrim("raw", F.lit(_SPACE))).where(F.length("trimmed") >= min_chars)
    return row.select("key", "doc_id", "site", "pos", F.xxhash64("trimmed").alias("line"))


def line_spread(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """line, first (its first occurrence) of every line found on at least ``min_sites`` sites."""
    spread = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "pos")).alias("first"))
    margin = max(1.0, 4 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    spread = spread.where(F.col("n") >= min_sites).select("line", "first", F.hll_sketch_estimate("sketch").cast("double").alias("sites"))
    spread = stage(spread.where(F.col("sites") >= min_sites - margin), "line-spread")
    near = spread.where(F.col("sites") <= min_sites + margin).select("line", "first")
    exact = lines.join(near.select("line"), "line", "left_semi").groupBy("line").agg(F.countDistinct("site").alias("exact")).where(F.col("exact") >= min_sites)
    return spread.where(F.col("sites") > min_sites + margin).select("line", "first").unionByName(near.join(exact.select("line"), "line", "left_semi"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``docs`` with cleaned texts and two more columns: _n_lines, _n_removed (as longs).

    Every row stays, perhaps with an empty text; a null text stays null with 0 lines, an empty one has one. Texts of
    any length are taken whole. Null sites count as one site. Rows that repeat (id and text alike) are treated alike:
    all of them keep the first occurrence; of rows of one id that of the least MD5 of the text comes first, null ids
    come before all. An empty table gives an empty table. Other columns pass through, but for ones by the new names
    or that begin with _ld_, which are replaced.
    """
    lines = stage(_lines(docs, id_col, text_col, site_col, min_chars), "line-keys")
    # written first, so that the join's sides are plain shuffles and a hot line's partition can be split
    boilerplate = stage(line_spread(lines, min_sites), "boilerplate")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key")) & (F.col("pos") == F.col("first.pos"))
    hit = lines.join(boilerplate, "line").where(~is_first)
    hit = hit.groupBy(F.col("doc_id").alias("_ld_id"), F.col("key").alias("_ld_key")).agg(F.collect_set("pos").alias("_ld_bad"))
    docs = docs.drop("_n_lines", "_n_removed", "_ld_id", "_ld_key", "_ld_bad", "_ld_row", "_ld_parts", "_ld_kept")
    text = F.col(f"`{text_col}`")
    out = docs.withColumn("_ld_row", F.unhex(F.md5(text))).join(hit, F.col(f"`{id_col}`").eqNullSafe(F.col("_ld_id")) & (F.col("_ld_row") == F.col("_ld_key")), "left")
    parts = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_ld_bad"))
    rest = F.expr("transform(_ld_kept, i -> _ld_parts[i])")
    out = out.withColumn("_ld_parts", F.when(F.col("_ld_bad").isNotNull(), parts)).withColumn("_ld_kept", F.when(F.col("_ld_bad").isNotNull(), kept))
    cleaned = F.when(F.col("_ld_bad").isNull(), text).otherwise(F.array_join(rest, "\n"))
    n_lines = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    columns = [cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns, n_lines.alias("_n_lines"), F.coalesce(F.size("_ld_bad"), F.lit(0)).cast("long").alias("_n_removed"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.greatest("_n_removed", F.lit(0)).alias("n_removed"), F.sha2("text", 256).alias("text_sha256"))


ORACLE_SQL = {
    "op3_line_dedup": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS site, text, md5(text) AS h FROM documents),
 l AS (SELECT rid, doc_id, site, h, i - 1 AS pos, parts[i] AS raw FROM
        (SELECT *, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d)),
 t AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM l),
 s AS (SELECT line FROM t WHERE length(line) >= {MIN_CHARS} GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
 f AS (SELECT t.line, arg_min(struct_pack(i := doc_id, h := h, p := pos), struct_pack(z := doc_id IS NOT NULL, i := doc_id, h := h, p := pos)) AS one
       FROM t JOIN s ON t.line = s.line GROUP BY t.line),
 k AS (SELECT t.*, f.line IS NOT NULL AND NOT (t.doc_id IS NOT DISTINCT FROM f.one.i AND t.h = f.one.h AND t.pos = f.one.p) AS bad
       FROM t LEFT JOIN f ON t.line = f.line),
 g AS (SELECT rid, count(*) AS n, sum(CASE WHEN bad THEN 1 ELSE 0 END) AS gone,
         coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT bad), '') AS rest FROM k GROUP BY rid)
SELECT d.doc_id, coalesce(g.n, 0)::BIGINT AS n_lines, coalesce(g.gone, 0)::BIGINT AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN sha256(g.rest) END AS text_sha256 FROM d LEFT JOIN g ON g.rid = d.rid"""
}
