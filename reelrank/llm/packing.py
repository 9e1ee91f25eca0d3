"""Mixture-controlled packing by deficit round-robin.

Sources are queues of tokens.  In every round a source earns its share of a
window, adds it to the deficit it carries, and sends as many whole quanta as
the deficit covers; a source that runs dry leaves the round.  The tokens sent, round
after round, form one tape that is cut into sequences, so all sequences but
the last are full and each holds the target proportions up to a quantum.

The deficit after ``r`` rounds is ``r * earned - sent``, with ``sent`` the
earned tokens rounded down to whole quanta.  So where a token goes depends on
its position in its source alone, and partitions carry the deficits across
their borders without talking to each other: a document's position comes from
per-(source, partition) sums, a piece's place on the tape from per-round-block sums.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

END_ID = 1
WINDOW = 2048
QUANTUM = 64
#: Rounds per block of the tape, blocks per group of blocks.
ROUNDS_PER_BLOCK = 64
BLOCKS_PER_GROUP = 4096
#: Tokens of a document whose pieces travel as one row.
PIECES_SPAN = 1 << 20


class ByteBpe:
    """Token ids of whole texts, equal to those of the ``tokenizers`` file at
    ``path`` with ``add_special_tokens=False``.  ``tiktoken`` does the merges.

    A text is cut at the file's added tokens first, which stand for their ids;
    what lies between them is encoded in one go.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        added = {t["content"]: t["id"] for t in model["added_tokens"]}
        if model.get("normalizer") or any(t.get(k) for t in model["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: a normalizer, or added tokens that don't stand for themselves alone")
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        of_char = {chr(b): b for b in shown}
        of_char.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))})
        ranks = {bytes(of_char[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in added}
        self.encode = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN,
                                        mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.added = {t: np.array([i], dtype="<u4").tobytes() for t, i in added.items()}
        # the longest of those that begin at one place
        self.cut = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def _plain(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        ids = np.frombuffer(array("I", self.encode(text)), dtype=np.uint32) if text else np.empty(0, np.uint32)
        return ids.astype("<u4", copy=False).tobytes()

    def __call__(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[at:m.start()]), self.added[m[0]]]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])


_encoders: dict[str, ByteBpe] = {}


def _encoder(path: str) -> ByteBpe:
    if path not in _encoders:
        _encoders[path] = ByteBpe(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def tokenize(df: DataFrame, id_col: str, text: str, source: str, tokenizer: str) -> DataFrame:
    """Written table: ``_rr_uid`` (row number, fixed once written), ``_rr_id``,
    ``_rr_src``, ``_rr_n`` (tokens with the end id) and ``_rr_ids``, of 16 bits each
    where all ids of the document fit, else of 32."""
    cols = df.select(F.monotonically_increasing_id().alias("_rr_uid"), F.col(id_col).alias("_rr_id"),
                     F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("~")).alias("_rr_src"),
                     F.col(text).cast("string").alias("_rr_text"))
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for big in batches:
            for at in range(0, big.num_rows, 64):
                b = big.slice(at, 64)
                ids = [np.frombuffer(encode(t.as_py()) + end, "<u4") for t in b.column(3)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), b.column(2), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([x.astype("<u2" if x.max() < 1 << 16 else "<u4").tobytes() for x in ids], pa.binary())], names=["_rr_uid", "_rr_id", "_rr_src", "_rr_n", "_rr_ids"])

    kind = dict(cols.dtypes)["_rr_id"]
    return C.materialize(cols.mapInArrow(
        run, f"_rr_uid long, _rr_id {kind}, _rr_src string, _rr_n long, _rr_ids binary"))


def _widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``ids`` of 32 bits each; ``length`` says how many a row has."""
    for b in batches:
        at = b.schema.get_field_index("ids")
        ids, n = b.column(at).cast(pa.binary()), b.column("length").to_numpy()
        offsets = np.frombuffer(ids.buffers()[1], "<i4")[ids.offset:ids.offset + len(ids) + 1]
        if len(ids) and (np.diff(offsets) == 2 * n).all():
            data = np.frombuffer(ids.buffers()[2], "<u2", int(n.sum()), int(offsets[0])).astype("<u4")
            ids = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((offsets - offsets[0]) * 2), pa.py_buffer(data)])
        else:
            ids = pa.array([x if len(x) == 4 * k else np.frombuffer(x, "<u2").astype("<u4").tobytes()
                            for x, k in zip(ids.to_pylist(), n, strict=True)], pa.binary())
        yield b.set_column(at, "ids", ids)


def _schedule(docs: DataFrame, weights: dict | None, window: int, quantum: int) -> DataFrame:
    """Pieces of documents by round: ``_rr_uid, _rr_src, _rr_r, _rr_pos``
    (place in the source), ``_rr_start``, ``_rr_len``."""
    docs = docs.withColumn("_rr_part", F.shiftright("_rr_uid", 33))
    starts = C.materialize(C.prefix_offsets(docs, ["_rr_src"], "_rr_part", F.col("_rr_n")))
    sources = starts.groupBy("_rr_src").agg(F.max("_rr_total").alias("_rr_size"))
    if weights is None:
        weight = F.col("_rr_size").cast("double")
    else:
        pairs = [F.lit(x) for k, v in weights.items() for x in ("~" if k is None else f"={k}", float(v))]
        weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("_rr_src")), F.lit(1.0))
    sources = C.materialize(sources.withColumn("_rr_w", weight))
    all_w = sources.agg(F.sum("_rr_w")).first()[0] or 1.0
    starts = starts.join(sources.select("_rr_src", (F.col("_rr_w") * F.lit(window / all_w)).alias("_rr_q")), "_rr_src")
    w = Window.partitionBy("_rr_src", "_rr_part").orderBy("_rr_uid").rowsBetween(Window.unboundedPreceding, -1)
    at = (docs.join(starts.withColumnRenamed("_rr_start", "_rr_base"), ["_rr_src", "_rr_part"])
          .withColumn("_rr_a", F.col("_rr_base") + F.coalesce(F.sum("_rr_n").over(w), F.lit(0))))

    total, q = F.col("_rr_total"), F.col("_rr_q")
    last = F.ceil(total / q)

    def sent(r):
        return F.when(r >= last, total).otherwise(
            F.least(total, F.lit(quantum) * F.floor(r * q / F.lit(float(quantum)))))

    # the rounds that can hold a piece, one wider at both ends; empty ones go
    lo = F.greatest(F.lit(0), F.floor(F.col("_rr_a") / q) - 1)
    hi = F.least(last, F.floor((F.col("_rr_a") + F.col("_rr_n") + F.lit(quantum)) / q) + 1)
    rounds = at.withColumn("_rr_r", F.explode(F.sequence(F.least(lo, hi), hi)))
    r = F.col("_rr_r")
    begin = F.greatest(F.col("_rr_a"), sent(r))
    end = F.least(F.col("_rr_a") + F.col("_rr_n"), sent(r + 1))
    return (rounds.withColumn("_rr_pos", begin).withColumn("_rr_len", end - F.col("_rr_pos")).where("_rr_len > 0")
            .select("_rr_uid", "_rr_src", "_rr_r", "_rr_pos", (F.col("_rr_pos") - F.col("_rr_a")).alias("_rr_start"),
                    "_rr_len"))


def _tape(pieces: DataFrame) -> DataFrame:
    """Add ``_rr_at``: the piece's place on the tape (rounds in order, sources
    in order within a round)."""
    pieces = pieces.withColumn("_rr_block", F.floor(F.col("_rr_r") / ROUNDS_PER_BLOCK))
    blocks = (pieces.groupBy("_rr_block").agg(F.sum("_rr_len").alias("_rr_sum"))
              .withColumn("_rr_group", F.floor(F.col("_rr_block") / BLOCKS_PER_GROUP)))
    blocks = C.materialize(blocks)
    before = lambda w: F.coalesce(F.sum("_rr_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = (blocks.groupBy("_rr_group").agg(F.sum("_rr_sum").alias("_rr_sum"))
              .select("_rr_group", before(Window.orderBy("_rr_group")).alias("_rr_g0")))
    blocks = (blocks.withColumn("_rr_b0", before(Window.partitionBy("_rr_group").orderBy("_rr_block")))
              .join(groups, "_rr_group").select("_rr_block", (F.col("_rr_b0") + F.col("_rr_g0")).alias("_rr_b0")))
    w = (Window.partitionBy("_rr_block").orderBy("_rr_r", "_rr_src", "_rr_pos")
         .rowsBetween(Window.unboundedPreceding, -1))
    return (pieces.join(blocks, "_rr_block")
            .withColumn("_rr_at", F.col("_rr_b0") + F.coalesce(F.sum("_rr_len").over(w), F.lit(0))))


def pack(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
         weights: dict | None = None, window: int = WINDOW, quantum: int = QUANTUM,
         tokenizer: str | None = None) -> DataFrame:
    """Pack all rows into sequences of ``window`` tokens.

    ``weights`` maps sources to target proportions (a source it doesn't name
    weighs 1); without it every window gets the corpus's own proportions.
    One row per piece: ``<id_col>``, ``source``, ``start``, ``length``,
    ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``,
    ``offset``.

    A null or empty text is one token, the end id; a null source is a queue
    of its own; repeated rows and null ids are documents of their own; very
    long texts are cut into as many pieces as they need; other columns are
    ignored; an empty table gives no piece.
    """
    tokens = tokenize(df, id_col, text, source, tokenizer or default_tokenizer())
    pieces = _tape(_schedule(tokens.select("_rr_uid", "_rr_src", "_rr_n"), weights, window, quantum))
    first, end = F.col("_rr_at"), F.col("_rr_at") + F.col("_rr_len")
    seq = F.col("sequence_id")
    # a document's pieces meet its ids once, as one row per block of them
    cut = (pieces.withColumn("sequence_id", F.explode(F.sequence(F.floor(first / window), F.floor((end - 1) / window))))
           .withColumn("_rr_from", F.greatest(first, seq * window))
           .withColumn("start", F.col("_rr_start") + F.col("_rr_from") - first)
           .groupBy("_rr_uid", F.floor(F.col("start") / PIECES_SPAN).alias("_rr_span"))
           .agg(F.collect_list(F.struct("sequence_id", "start", (F.least(end, (seq + 1) * window) - F.col("_rr_from")).alias("length"),
                                        (F.col("_rr_from") - seq * window).alias("offset"))).alias("_rr_cuts")))
    # the ids travel narrow, the slices are widened last
    width = F.floor(F.octet_length("_rr_ids") / F.col("_rr_n"))
    ids = F.substring(F.col("_rr_ids"), (F.col("start") * width + 1).cast("int"), (F.col("length") * width).cast("int"))
    out = (cut.join(tokens, "_rr_uid").select("_rr_id", "_rr_src", "_rr_n", "_rr_ids", F.inline("_rr_cuts"))
           .select(F.col("_rr_id").alias(id_col),
                   F.when(F.col("_rr_src") != "~", F.expr("substring(_rr_src, 2)")).alias("source"),
                   "start", "length", ids.alias("ids"), F.col("_rr_n").alias("doc_tokens"), "sequence_id", "offset"))
    return out.mapInArrow(_widen, out.schema)
