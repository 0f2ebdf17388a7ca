"""Line dedup by distinct-site spread, in DataFrame functions only.

Each line hash gets a HyperLogLog sketch of the sites it stands on; sketches merge by
aggregation. Clear cases follow the estimate, lines near the threshold an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import join_hot
from ..plans.staging import drop_staged, staged

#: Distinct sites from which a line is cross-site boilerplate.
MIN_SITES = 10
#: log2 of the registers of a sketch; its standard error is about 1.04 / 2**(LG_K / 2).
LG_K = 8
#: Estimates within this part of the threshold, about four standard errors, are counted exactly.
NEAR = 0.25


def _lines(docs: DataFrame) -> DataFrame:
    """One row for each line: 128 bits of hash over its trimmed text; blank lines have no hash."""
    line = F.trim("line")
    lines = docs.select("k1", "k2", "site", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select("k1", "k2", "site", "doc_id", "pos", F.when(line != "", F.xxhash64(line)).alias("h1"), F.when(line != "", F.xxhash64(F.lit(7), line)).alias("h2"))


def spread(lines: DataFrame, min_sites: int, lg_k: int = LG_K, near: float = NEAR) -> DataFrame:
    """Hashes of the lines on min_sites sites or more, with their first place (doc_id, pos).

    Only what the sketches let near the threshold is met with the lines again, and distinct sites
    are merged in each task first, so a line that stands on most rows is never one task's work.
    """
    lines = lines.where("h1 is not null and site is not null")
    sketched = lines.groupBy("h1", "h2").agg(
        F.count("*").alias("n"), F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min(F.struct("doc_id", "pos")).alias("first")
    )
    sketched = sketched.where(F.col("n") >= min_sites).select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    sketched = staged(sketched.where(F.col("sites") >= min_sites * (1 - near)))
    clear = sketched.where(F.col("sites") > min_sites * (1 + near)).select("h1", "h2", "first")
    close = sketched.where(F.col("sites") <= min_sites * (1 + near)).select("h1", "h2", "first")
    met = join_hot(lines.select("h1", "h2", "site", "k1", "pos"), close.select("h1", "h2"), ["h1", "h2"], F.struct("k1", "pos"), width=32)
    exact = met.select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    wide = staged(clear.unionByName(close.join(exact.select("h1", "h2"), ["h1", "h2"], "left_semi")))
    drop_staged(sketched)
    return wide


def dedup_lines(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, keep_first: bool = True
) -> DataFrame:
    """Cut cross-site boilerplate lines out of every text.

    A line is what stands between "\\n"; it is compared without spaces around it. Lines on
    min_sites distinct sites or more go from every text but, with keep_first, from the one with
    the smallest (doc_id, position). Returns all rows and columns of docs with the text cut, plus
    n_lines and n_removed. Null text stays null with no lines; blank lines are never removed;
    rows with a null site keep the right to lose lines but give no site; repeated rows are cut
    alike, each keeping a line whose first place is theirs; a text that loses every line that
    is not blank is left with its blank ones; columns named n_lines or n_removed are replaced;
    an empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    keyed = docs.select(row.alias("row"), F.col(text).alias("text"), F.col(site).alias("s"), F.col(doc_id).alias("doc_id"))
    keyed = keyed.select("*", F.xxhash64("s").alias("sh")).withColumn("site", F.when(F.col("s").isNotNull(), F.col("sh")))
    keyed = keyed.select("row", "text", "site", "doc_id", F.xxhash64("doc_id", "s", "text").alias("k1"), F.xxhash64(F.lit(5), "text", "s", "doc_id").alias("k2"))
    lines = _lines(keyed)
    wide = spread(lines, min_sites)
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos")) if keep_first else F.lit(False)
    marked = join_hot(lines.where("h1 is not null"), wide, ["h1", "h2"], F.struct("k1", "pos"), width=F.lit(64) + F.octet_length(F.coalesce(F.col("first.doc_id").cast("string"), F.lit(""))))
    marked = marked.where(~kept).select("k1", "k2", "pos").distinct()
    # A bitmap of 32 lines to a word keeps the lookup of each line constant.
    words = marked.groupBy("k1", "k2", F.shiftright("pos", 5).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("pos").bitwiseAND(31))).alias("bits"))
    gone = words.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("at", "bits"))).alias("words"))
    # Texts are told apart, so the build side holds one row for each cut text.
    joined = keyed.join(gone.hint("shuffle_hash"), ["k1", "k2"], "left")
    every = F.split("text", "\n", -1)
    dense = F.aggregate(
        "words", F.array().cast("array<int>"),
        lambda acc, w: F.concat(acc, F.array_repeat(F.lit(0), w["at"] - F.size(acc)), F.array(w["bits"])),
    )
    joined = joined.withColumn("dense", F.when(F.col("words").isNotNull(), dense))
    out = joined.withColumn("lines", every).withColumn(
        "left",
        F.when(F.col("dense").isNull(), F.col("lines")).otherwise(
            F.filter("lines", lambda _, i: F.coalesce(F.get("dense", F.shiftright(i, 5)), F.lit(0)).bitwiseAND(F.call_function("shiftleft", F.lit(1), i.bitwiseAND(31))) == 0)
        ),
    )
    columns = [F.array_join("left", "\n").alias(c) if c == text else F.col("row")[c].alias(c) for c in names]
    return out.select(*columns, F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"), F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines") - F.size("left")).cast("long").alias("n_removed"))
