"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A document's lines without blanks give a sequence of hashes; each GRAM of successive hashes gives a gram hash. Of
each WINDOW successive grams the one with the smallest hash is a fingerprint, so two runs of GRAM + WINDOW - 1
equal lines always share one. WINDOW is 1: every gram is a fingerprint and meets its own first place, so all lines of a
repeated run go, also where an inner part of it stands earlier elsewhere; with a larger window such a part hides the
rest. A line of PASSAGE_WORDS words or more is a fingerprint by itself. Equal
fingerprints join every place with the first one in (doc_id, row, line) order, the match is extended both ways
along the two line sequences, and the lines of the later run go.

Scale: the text is hashed where it lies; fingerprints are a few longs. The first place of a fingerprint is a
map-side combined minimum, which brings the hashes next to it along. Places are joined with it in an equi-join that
Spark splits when one line is in a third of all rows. The text itself is shuffled once, to meet the decisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, WORD, load, stash, text_or_empty, with_row_id

GRAM, WINDOW, PASSAGE_WORDS = 2, 1, 50


def line_hashes(rows: DataFrame) -> DataFrame:
    """rid, doc_id, and of the lines of rows(rid, doc_id, text) that aren't blank the hashes hs and whether they are passages, big."""
    trimmed = F.transform(F.split(text_or_empty(), "\n"), lambda x: F.trim(F.regexp_replace(x, SPACE, " ")))
    lines = F.filter(trimmed, lambda x: x != "")
    rows = rows.select("rid", "doc_id", lines.alias("lines"))
    hashes = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h"), (F.regexp_count(x, F.lit(WORD)) >= PASSAGE_WORDS).alias("big")))
    return rows.select("rid", "doc_id", hashes.alias("lines")).selectExpr("rid", "doc_id", "lines.h AS hs", "lines.big AS big")


def repeated_lines(lines: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """rid, gone: the sorted places of each row's lines that repeat an earlier run.

    A match is extended by up to `window` lines each way: in a run that two places share, the next fingerprint is
    no further off than that and brings its own match.
    """
    # place p holds the gram of lines p .. p+gram-1; of a window's grams the least is chosen
    grams = f"transform(sequence(0, size(hs) - {gram}), p -> struct(xxhash64(slice(hs, p + 1, {gram})) AS f, p AS p, {gram} AS n))"
    chosen = f"array_distinct(transform(sequence(0, greatest(0, size(grams) - {window})), w -> array_min(slice(grams, w + 1, {window}))))"
    passages = "transform(filter(transform(big, (b, p) -> struct(b AS b, p AS p)), x -> x.b), x -> struct(hs[x.p] AS f, x.p AS p, 1 AS n))"
    near = f"reverse(slice(hs, greatest(p - {window}, 0) + 1, least(p, {window}))) AS before", f"slice(hs, p + n + 1, {window}) AS after"
    places = (
        lines.selectExpr("*", f"CASE WHEN size(hs) >= {gram} THEN {grams} END AS grams")
        .selectExpr("rid", "doc_id", "hs", f"inline(concat(CASE WHEN grams IS NULL THEN array() ELSE {chosen} END, {passages}))")
        .selectExpr("rid", "f", "n", "p", *near, "struct(doc_id IS NULL AS none, doc_id, rid, p) AS key")
    )
    places = stash(places, "places")
    first = places.groupBy("f", "n").agg(F.min(F.struct("key", "before", "after")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    first = stash(first.selectExpr("f AS f0", "n AS n0", "first.key AS key0", "first.before AS before0", "first.after AS after0"), "first")

    equal = "coalesce(nullif(array_position(zip_with({x}, {x}0, (a, b) -> coalesce(a = b, false)), false), 0) - 1, size({x}))"
    later = places.join(first.hint("merge"), (F.col("f") == F.col("f0")) & (F.col("n") == F.col("n0"))).where("key > key0")
    runs = later.selectExpr("rid", f"p - {equal.format(x='before')} AS a", f"p + n + {equal.format(x='after')} AS b").groupBy("rid", "a").agg(F.max("b").alias("b"))
    done = F.coalesce(F.max("b").over(Window.partitionBy("rid").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = runs.withColumn("start", F.greatest("a", done)).where("b > start")
    return parts.groupBy("rid").agg(F.sort_array(F.flatten(F.collect_list(F.expr("sequence(CAST(start AS INT), CAST(b AS INT) - 1)")))).alias("gone"))


def dedup_lines(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, text without the later repeated runs, n_lines, n_removed.

    A run of gram lines or more that is equal (after trimming and turning white space into one space) to one
    earlier in the order of doc_id (nulls last), row and line goes; so does a single line of PASSAGE_WORDS words.
    Blank lines are no part of runs and stay. Null text gives an empty text with no lines. Of repeated rows the first
    keeps its lines. The first occurrence of anything always stays. Texts of any length are read whole; an empty table gives no
    rows. Other columns are ignored.
    """
    rows = with_row_id(docs.select("doc_id", "text")).select("rid", "doc_id", text_or_empty().alias("text"))
    gone = stash(repeated_lines(line_hashes(rows), gram, window), "gone")
    # the decisions grow with the corpus: the same join at every size
    joined = rows.join(gone.withColumnRenamed("rid", "r").hint("merge"), F.col("rid") == F.col("r"), "left")
    # `gone` counts the lines that aren't blank: find their places among all lines
    filled = r"transform(filter(transform(lines, (l, i) -> struct(l AS l, i AS i)), x -> NOT x.l RLIKE '^[\\x20\\x09-\\x0D]*$'), x -> x.i)"
    rest = "transform(array_except(sequence(0, size(lines) - 1), transform(gone, k -> filled[k])), i -> lines[i])"
    return (
        joined.selectExpr("doc_id", "text", "coalesce(gone, array()) AS gone", "split(text, '\n') AS lines")
        .selectExpr("*", f"{filled} AS filled")
        .selectExpr(
            "doc_id",
            f"CASE WHEN size(gone) = 0 THEN text ELSE array_join({rest}, '\n') END AS text",
            "CAST(size(filled) AS BIGINT) AS n_lines",
            "CAST(size(gone) AS BIGINT) AS n_removed",
        )
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(load(spark, sf_dir, "documents"))
