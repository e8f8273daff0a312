"""Line dedup by distinct-site spread, with DataFrame functions only.

A line's spread is the number of distinct sites (``source``) whose documents hold it. Lines that spread over
``min_sites`` sites or more are boilerplate: every occurrence but the first (smallest doc_id, then position) goes.

1. Lines (without outer spaces, tabs and carriage returns) are hashed in the scan; only hashes are shuffled.
   A line that occurs fewer than ``min_sites`` times cannot spread that far, so plain counts, combined on the
   map side, leave few lines for what follows. This bound is exact.
2. For those lines HyperLogLog sketches of the sites are made in each task and merged by aggregation.
   Estimates clear of the threshold decide; lines whose estimate is within ``band`` of it get an exact
   distinct count.
3. Documents are rebuilt without the marked positions.

Hot lines: counts and sketches are combined before the shuffle, and the joins on lines are plain equi-joins
that adaptive execution can split; nothing gathers the documents of a line. A document's own marked positions
are gathered (at most its number of lines).

Edge cases: a null text stays null (0 lines); an empty text has no line that counts; blank lines are kept and
never count; a null source is no site; null ids sort first; repeated rows with equal id and text are treated
alike (both keep a first occurrence); an empty table gives an empty result; other columns pass through.
Line identity is a 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import fresh, read, stash

MIN_SITES = 10
#: Relative distance from the threshold within which an estimate is not trusted; at least two sites.
BAND = 0.15
LG_K = 12
_STRIP = " \t\r"


def _lines(docs: DataFrame) -> DataFrame:
    """row, doc_id, source, pos and line (hash) of every line that isn't blank."""
    hashes = F.transform(F.split("text", "\n"), lambda x: F.when(F.btrim(x, F.lit(_STRIP)) != "", F.xxhash64(F.btrim(x, F.lit(_STRIP)))))
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "source", F.posexplode(hashes).alias("pos", "line"))
    return rows.where(F.col("line").isNotNull())


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> tuple[DataFrame, DataFrame]:
    """(lines, occurrences): the boilerplate lines with their spread, and all places of frequent lines."""
    lines = _lines(docs)
    frequent = stash(lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("line"), "frequent")
    places = stash(lines.join(frequent, "line"), "places")
    sketched = places.groupBy("line").agg(F.hll_sketch_agg("source", F.lit(LG_K)).alias("sketch")).select("line", F.hll_sketch_estimate("sketch").alias("spread"))
    sketched = stash(sketched, "sketched")
    near = F.abs(F.col("spread") - min_sites) <= F.lit(max(2.0, band * min_sites))
    exact = places.join(sketched.where(near).select("line"), "line").groupBy("line").agg(F.countDistinct("source").alias("spread"))
    spread = sketched.where(~near).select("line", "spread").unionByName(exact)
    return spread.where(F.col("spread") >= min_sites), places


def drop_lines(docs: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """The documents without boilerplate; text is replaced, n_lines and n_removed are added.

    If docs has columns of these names they pass through, and the added ones get other names (``n_lines_``).
    """
    n_lines, n_removed = fresh("n_lines", docs), fresh("n_removed", docs)
    found, places = boilerplate(docs, min_sites, band)
    hits = stash(places.join(found.select("line"), "line"), "hits")
    first = hits.groupBy("line").agg(F.min(F.struct("doc_id", "row", "pos")).alias("first"))
    gone = hits.join(first, "line").where(~F.struct("doc_id", "row", "pos").eqNullSafe(F.col("first")))
    row, away = fresh("row", docs), fresh("gone", docs)
    marked = gone.groupBy(F.col("row").alias(row)).agg(F.collect_set("pos").alias(away))
    cut = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), away)  # by hashing: in proportion to the lines
    kept = F.when(F.col(away).isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(cut, i)), "\n"))
    # a merge join at any size: marked positions grow with the corpus, so they are never sent whole to each task
    rows = docs.withColumn(row, F.xxhash64("doc_id", "text")).join(marked.hint("merge"), row, "left")
    counts = {
        n_lines: F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.filter(cut, lambda x: F.btrim(x, F.lit(_STRIP)) != ""))),
        n_removed: F.when(F.col(away).isNull(), F.lit(0)).otherwise(F.size(away)),
    }
    return rows.select(*(F.col(f"`{c}`") if c != "text" else kept.alias("text") for c in docs.columns), *(x.cast("bigint").alias(c) for c, x in counts.items()))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that spread over ten sites or more."""
    return drop_lines(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))


QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLE = {
    "op9_line_dedup": """
WITH cut AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (
    SELECT doc_id, source, unnest(lines) AS raw, unnest(range(len(lines))) AS pos FROM cut
),
t AS (SELECT doc_id, source, pos, raw, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM l),
spread AS (SELECT line FROM t WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
marked AS (
    SELECT t.*, s.line IS NOT NULL AND row_number() OVER (PARTITION BY t.line ORDER BY t.doc_id NULLS FIRST, t.pos) > 1 AS gone
    FROM t LEFT JOIN spread s ON t.line = s.line
),
kept AS (
    SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
           count(*) FILTER (WHERE line <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
    FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text, d.source,
       coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
""",
}
