"""Subtitle scripts and plot pages -> one document per movie.

A subtitle file, a page and a merged script are single documents, so one
row each is the natural unit; everything else (cleaning, tag stripping,
paragraph extraction) is column expressions on those rows.  Multi-CD files
of one movie are concatenated in file-name order (Q12).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# --- fixed values: the plot page's synopsis container -----------------------
SECTION_OPEN = '<div class="ad">'
SECTION_CLOSE = "</div>"
# ----------------------------------------------------------------------------


def srt_cue_texts(conversations: DataFrame) -> DataFrame:
    """Subtitle cues derived from conversation turns: even turns in italics,
    odd turns with an entity; ``cd`` splits long ones over several files."""
    flat = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    cue = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<i>"), flat, F.lit("</i>"))) \
        .otherwise(F.concat(flat, F.lit(" a &amp; b")))
    return conversations.select(
        F.col("conv_id").cast("string").alias("movie_id"), "turn", cue.alias("cue_text"),
        (F.floor(F.col("turn") / 4) + 1).cast("int").alias("cd"))


def srt_files(conversations: DataFrame) -> DataFrame:
    """SRT files (movie_id, file_name, text): number, timing, text, blank line."""
    c = srt_cue_texts(conversations)
    ts = F.lpad((F.col("turn") % 60).cast("string"), 2, "0")
    block = F.concat((F.col("turn") + 1).cast("string"), F.lit("\n"),
                     F.lit("00:00:"), ts, F.lit(",000 --> 00:00:"), ts, F.lit(",500\n"),
                     F.col("cue_text"), F.lit("\n\n"))
    return (c.groupBy("movie_id", "cd")
            .agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("cues"))
            .select("movie_id",
                    F.concat(F.lit("cd"), F.col("cd").cast("string"), F.lit(".srt")).alias("file_name"),
                    F.array_join(F.transform("cues", lambda x: x["b"]), "").alias("text")))


def srt_merge(files: DataFrame, mode: str = "reference") -> DataFrame:
    """2.10 / A10: clean every file, then concatenate a movie's files in
    file-name order.  Returns (movie_id, text, n_files)."""
    clean = files.select("movie_id", "file_name", tx.srt_clean(F.col("text"), mode).alias("clean"))
    return (clean.groupBy("movie_id")
            .agg(F.array_sort(F.collect_list(F.struct("file_name", "clean"))).alias("fs"),
                 F.count(F.lit(1)).cast("int").alias("n_files"))
            .select("movie_id", F.array_join(F.transform("fs", lambda x: x["clean"]), "").alias("text"),
                    "n_files"))


def plots(pages: DataFrame) -> DataFrame:
    """F12 + F14 + K10: plot paragraphs and the synopsis, newline-joined.

    Returns (movie_id, plots ARRAY, synopsis, text); a page with no
    paragraphs gives an empty array (Q9).
    """
    h = F.col("html")
    p = pages.select(F.col("page_id").cast("string").alias("movie_id"),
                     tx.paragraphs(h).alias("plots"),
                     tx.section_text(h, SECTION_OPEN, SECTION_CLOSE).alias("synopsis"))
    return p.withColumn("text", F.array_join(F.concat("plots", F.array("synopsis")), "\n"))


def movie_docs(script: DataFrame, plots_df: DataFrame, separator: str = "") -> DataFrame:
    """Script text followed by the plots text when present.

    The model joins them with no separator (Q14); ``separator`` opts out.
    """
    p = plots_df.select("movie_id", F.col("text").alias("plots_text"))
    j = script.select("movie_id", "text").join(p, "movie_id", "left")
    tail = F.when(F.col("plots_text").isNull(), F.lit("")) \
        .otherwise(F.concat(F.lit(separator), F.col("plots_text")))
    return j.select("movie_id", F.concat(F.col("text"), tail).alias("text"))
