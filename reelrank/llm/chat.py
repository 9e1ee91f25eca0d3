"""Chat formatting with column expressions only.

A conversation becomes one string.  Adjacent turns of one role are merged into
a block of several parts::

    ### role: text</part>text</turn>\\n

Control strings inside a text are replaced by two-character codes that start
with a backslash (and a backslash by ``\\b``), so no mark can occur in a text and
every text reads back exactly.  The loss mask lists the spans of the texts of
one role, without marks.

A conversation of more than ``SEGMENT_TURNS`` turns is built in segments of
turn ranges, each by its own group, so that a conversation with a large share of all rows
does not meet in one task while it is sorted, merged and escaped; its segments,
joined in order, are its string.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import fits_broadcast, hint
from . import common as C

SEGMENT_TURNS = 64
HEAD, SEP, PART, END = "### ", ": ", "</part>", "</turn>"
#: Control string -> its code inside a text.
CODES = {HEAD: "\\s", PART: "\\p", END: "\\e"}
#: A role ends at the first ``SEP``, so roles escape it too.
ROLE_CODES = CODES | {SEP: "\\c"}


def escape(text: Column, codes: dict[str, str] = CODES) -> Column:
    """``text`` without any control string; ``unescape`` gives it back."""
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), codes.items(), text)


def unescape(text: Column) -> Column:
    text = reduce(lambda t, kv: F.replace(t, F.lit(kv[1]), F.lit(kv[0])), ROLE_CODES.items(), text)
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def merged_runs(turns: Column) -> Column:
    """Adjacent turns of one role as ``array<struct<role, parts>>``, from sorted
    turn structs."""
    def add(acc: Column, t: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        grown = F.struct(last["role"].alias("role"), F.concat(last["parts"], F.array(t["text"])).alias("parts"))
        new = F.struct(t["role"].alias("role"), F.array(t["text"]).alias("parts"))
        return F.when(last["role"] == t["role"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))) \
            .otherwise(F.concat(acc, F.array(new)))

    empty = F.array().cast("array<struct<role:string,parts:array<string>>>")
    return F.aggregate(turns, empty, add)


def _pieces(runs: Column, loss_role: str, goes_on: Column, open_end: Column) -> Column:
    """The strings of a segment in order, each with its loss flag.  ``goes_on``:
    the first run continues the block before; ``open_end``: the last run's
    block continues in the next segment."""
    def piece(s: Column, loss: Column) -> Column:
        return F.struct(s.alias("s"), loss.alias("loss"))

    def block(run: Column, i: Column) -> Column:
        no = F.lit(False)
        head = F.when((i == 0) & goes_on, F.lit(PART)).otherwise(F.concat(F.lit(HEAD), escape(run["role"], ROLE_CODES), F.lit(SEP)))
        tail = F.when((i == F.size(runs) - 1) & open_end, F.lit("")).otherwise(F.lit(END + "\n"))
        parts = F.transform(run["parts"], lambda p, j: F.array(
            piece(F.when(j == 0, F.lit("")).otherwise(F.lit(PART)), no), piece(escape(p), run["role"] == loss_role)))
        return F.concat(F.array(piece(head, no)), F.flatten(parts), F.array(piece(tail, no)))

    return F.flatten(F.transform(runs, block))


def _spans(pieces: Column) -> Column:
    """Loss spans of a segment: code points (``start``, ``length``) and UTF-8 bytes."""
    kind = "array<struct<start:bigint,length:bigint,byte_start:bigint,byte_length:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("b"), F.array().cast(kind).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        n, m = F.char_length(p["s"]).cast("long"), F.octet_length(p["s"]).cast("long")
        span = F.struct(acc["c"].alias("start"), n.alias("length"), acc["b"].alias("byte_start"), m.alias("byte_length"))
        return F.struct((acc["c"] + n).alias("c"), (acc["b"] + m).alias("b"),
                        F.when(p["loss"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def _segments(grouped: DataFrame, loss_role: str) -> DataFrame:
    """Text and loss spans from ``_rr_turns``, ``_rr_goes_on`` and ``_rr_open``."""
    return (grouped.withColumn("_rr_runs", merged_runs(F.array_sort("_rr_turns")))
            .withColumn("_rr_pieces", _pieces(F.col("_rr_runs"), loss_role, F.col("_rr_goes_on"), F.col("_rr_open")))
            .select("conv_id", "segment", "n_segments",
                    F.array_join(F.transform("_rr_pieces", lambda p: p["s"]), "").alias("text"),
                    _spans(F.col("_rr_pieces")).alias("loss_spans")))


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """Formatted conversations: ``conv_id``, ``segment`` (from 0), ``n_segments``,
    ``text``, ``loss_spans`` (array of ``start``, ``length`` in code points and
    ``byte_start``, ``byte_length`` in UTF-8 bytes, each within its segment).

    A conversation's string is its segments' texts joined in order; one of at
    most ``SEGMENT_TURNS`` rows is one segment.  Rows go by turn, ties by role,
    then by text (code points); repeated rows are turns of their own.  A null
    text or role is empty, a null turn comes first, rows with a null conversation are
    one conversation.  Other columns are ignored, an empty table gives no row.
    A text may be as long as a string value.  Rows that share conversation and
    turn range of ``SEGMENT_TURNS`` numbers meet in one group.
    """
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                     F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    turns = F.collect_list(F.struct("turn", "role", "text")).alias("_rr_turns")
    long = C.materialize(rows.groupBy("conv_id").count().where(F.col("count") > SEGMENT_TURNS)
                         .select(F.col("conv_id").alias("_rr_long")))
    small = fits_broadcast(long)
    is_long = F.col("conv_id").eqNullSafe(F.col("_rr_long"))

    short = rows.join(hint(long, small), is_long, "left_anti").groupBy("conv_id").agg(turns).select(
        "*", F.lit(0).alias("segment"), F.lit(1).alias("n_segments"), F.lit(False).alias("_rr_goes_on"), F.lit(False).alias("_rr_open"))

    cut = (rows.join(hint(long, small), is_long, "left_semi")
           .withColumn("_rr_range", F.coalesce(F.floor(F.col("turn") / SEGMENT_TURNS), F.lit(-(1 << 62)))))
    # roles at the ends of every range say where a block runs over the cut
    ends = cut.groupBy("conv_id", "_rr_range").agg(
        F.min(F.struct("turn", "role"))["role"].alias("_rr_first"), F.max(F.struct("turn", "role"))["role"].alias("_rr_last"))
    w = Window.partitionBy("conv_id").orderBy("_rr_range")
    ends = ends.select(F.col("conv_id").alias("_rr_conv"), F.col("_rr_range").alias("_rr_r"),
                       (F.row_number().over(w) - 1).alias("segment"),
                       F.count(F.lit(1)).over(Window.partitionBy("conv_id")).cast("int").alias("n_segments"),
                       F.coalesce(F.lag("_rr_last").over(w) == F.col("_rr_first"), F.lit(False)).alias("_rr_goes_on"),
                       F.coalesce(F.lead("_rr_first").over(w) == F.col("_rr_last"), F.lit(False)).alias("_rr_open"))
    parts = (cut.groupBy("conv_id", "_rr_range").agg(turns)
             .join(ends, F.col("conv_id").eqNullSafe(F.col("_rr_conv")) & (F.col("_rr_range") == F.col("_rr_r"))))
    return _segments(short, loss_role).unionByName(_segments(parts, loss_role))


def _marked_turns(formatted: Column) -> Column:
    """Every turn of a formatted conversation as ``role\\ntext\\n``, unescaped."""
    blocks = F.split(formatted, END + "\n")

    def turns(block: Column) -> Column:
        head = F.substring_index(block, SEP, 1)
        who = unescape(F.substr(head, F.lit(len(HEAD) + 1)))
        body = F.substr(block, F.char_length(head) + len(SEP) + 1)
        return F.transform(F.split(body, PART), lambda p: F.concat(who, F.lit("\n"), unescape(p), F.lit("\n")))

    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns))


def read_back(segments: DataFrame) -> DataFrame:
    """What formatted conversations hold, read from their text and loss spans
    alone: ``conv_id``, ``formatted``, ``turns`` (``role\\ntext\\n`` each) and
    ``loss_text`` (all text under the mask, unescaped).

    Conversations of one segment need no shuffle.
    """
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(
        F.col("text").cast("binary"), (s["byte_start"] + 1).cast("int"), s["byte_length"].cast("int")).cast("string")))
    parts = segments.select("conv_id", "segment", "n_segments", "text", F.array_join(masked, "").alias("loss_text"))
    whole = parts.where("n_segments = 1").select("conv_id", F.col("text").alias("formatted"), "loss_text")
    joined = (parts.where("n_segments > 1").groupBy("conv_id")
              .agg(F.array_sort(F.collect_list(F.struct("segment", "text", "loss_text"))).alias("_rr_s"))
              .select("conv_id", F.array_join("_rr_s.text", "").alias("formatted"),
                      F.array_join("_rr_s.loss_text", "").alias("loss_text")))
    return whole.unionByName(joined).select("conv_id", "formatted", _marked_turns(F.col("formatted")).alias("turns"), "loss_text")
