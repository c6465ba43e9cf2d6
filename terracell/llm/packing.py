"""Best-fit packing of documents into sequences of one length, in bulk-synchronous rounds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terracell.llm.common import ranked, written
from terracell.llm.tokens import encoder, merged, text_groups

SEQUENCE = 1024
#: Rows of a range-sorted partition that one task sweeps, about.
SWEEP = 1_000_000
#: Pieces that the encoder remembers in a generation, and bytes of text it takes at a time: packing leaves memory to
#: the stages that run before it in the same workers. Only speed and memory depend on these.
MEMO, GROUP = 400_000, 1 << 22


def cut(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of all pieces of documents with counts tokens: whole if they fit, else pieces
    of `most` tokens behind a first piece with the rest."""
    many = -(-counts // most)
    doc = np.repeat(np.arange(len(counts)), many)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    first = (counts - (many - 1) * most)[doc]
    return doc, piece, np.where(piece > 0, first + (piece - 1) * most, 0), np.where(piece > 0, most, first)


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, most: int = SEQUENCE, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of docs (doc_id, text); a null text is empty and has the end id only."""
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids binary" * keep_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, MEMO)
        for b in merged(batches, 1, GROUP):
            doc_ids, texts = b.column(0).cast(pa.int64()).combine_chunks(), b.column(1).to_pylist()
            for x, y in text_groups(texts, GROUP):
                flat, counts = own.flat(texts[x:y], end_id)
                doc, piece, start, length = cut(counts, most)
                raw, ends = memoryview(flat.tobytes()), np.cumsum(4 * length).tolist()
                parts = [raw[p:q] for p, q in zip([0, *ends], ends)]
                columns = [doc_ids.slice(x, y - x).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length, pa.int32()), pa.array(list(map(zlib.crc32, parts)), pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(map(bytes, parts), pa.binary())] * keep_ids], names)

    return docs.select("doc_id", "text").mapInArrow(split, schema)


def bands(most: int) -> list[tuple[int, int]]:
    """(lo, hi] of the lengths that are placed together, longest first, below those over half a sequence: to a third, to a quarter, then to a quarter of that each time."""
    ends = [most // 2, most // 3, most // 4]
    while ends[-1] > 16:
        ends.append(ends[-1] // 4)
    ends = sorted({*ends, 0}, reverse=True)
    return list(zip(ends[1:], ends))


def matched(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, places) that a sweep over places (kind 0) and pieces (kind 1), largest first, puts together.

    Each piece takes the last free place before it, the smallest that holds it: closing and opening brackets. The
    number of open brackets says which belong together: those that follow each other at one level.
    """
    level = np.cumsum(1 - 2 * kind) + kind
    order = np.lexsort((np.arange(len(kind)), level))
    k, at = kind[order], level[order]
    pair = np.flatnonzero((at[1:] == at[:-1]) & (k[1:] == 1) & (k[:-1] == 0))
    return order[pair + 1], order[pair]


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sweep over one range-sorted partition (id, size, kind, part): its pieces with the sequence and gap that they
    get here, if any, and what is left of pieces and places, numbered by rank (no)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    ids, size, kind, part = (t.column(k).to_numpy().astype(np.int64) for k in range(4))
    piece, place = matched(kind)
    seq, gap, free, no = np.zeros(len(ids), np.int64), np.full(len(ids), -1), np.ones(len(ids), bool), np.full(len(ids), -1)
    seq[piece], gap[piece] = ids[place], size[place]
    free[piece] = free[place] = False
    for k in (0, 1):
        left = np.flatnonzero(free & (kind == k))
        no[left] = np.arange(len(left))
    show = (kind == 1) | free
    none = gap[show] < 0
    columns = [*(pa.array(x[show]) for x in (ids, size, kind)), *(pa.array(x[show], mask=none) for x in (seq, gap)), *(pa.array(x[show]) for x in (part, no))]
    yield pa.RecordBatch.from_arrays(columns, ["id", "size", "kind", "seq", "gap", "part", "no"])


def swept(waiting: DataFrame, places: DataFrame, rows: int, name: str) -> tuple[DataFrame, int, int]:
    """(id, length, seq, gap): one sweep of pieces (id, length) over places (seq, gap); seq and gap are null for pieces without a place.
    With it, how many these are, and the longest one's length.

    Both are range-sorted by size, largest first, places before pieces. A task sweeps its own part; what is left
    in it is pieces that need an earlier part's places, then places for later parts. The parts' counts (one row for
    each) give each of these its bracket level over all parts, and those that follow each other at a level match.
    A level holds a few rows for each part, so no size, however common, is in one task.
    """
    events = waiting.select("id", F.col("length").alias("size"), F.lit(1).alias("kind")).unionByName(places.select(F.col("seq").alias("id"), F.col("gap").alias("size"), F.lit(0).alias("kind")))
    many = max(4, rows // SWEEP + 1)
    order = [F.col("size").desc(), F.col("kind"), F.col("id")]
    local = events.repartitionByRange(many, *order).sortWithinPartitions(*order).select("id", "size", "kind", F.spark_partition_id().alias("part"))
    local = written(local.mapInArrow(sweep, "id long, size long, kind long, seq long, gap long, part long, no long"), f"{name}-swept")
    left = local.where("no >= 0")
    counts = left.groupBy("part").agg(F.sum("kind").alias("u"), F.sum(1 - F.col("kind")).alias("v"))
    before = F.sum(F.col("v") - F.col("u")).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("part").alias("p"), "u", F.coalesce(before, F.lit(0)).alias("start"))
    level = F.when(F.col("kind") == 1, F.col("start") - F.col("no")).otherwise(F.col("start") - F.col("u") + F.col("no") + 1)
    prior = F.lag(F.struct("kind", "id", "size")).over(Window.partitionBy("level").orderBy("part", F.col("kind").desc()))
    across = left.join(F.broadcast(starts), F.col("part") == F.col("p")).withColumn("level", level).withColumn("prior", prior).where("kind = 1")
    got = F.when(F.col("prior.kind") == 0, F.col("prior"))
    across = across.select("id", F.col("size").alias("length"), got["id"].alias("seq"), got["size"].alias("gap"))
    every, seen = local.where("kind = 1 and no < 0").select("id", F.col("size").alias("length"), "seq", "gap").unionByName(across), Observation()
    left = F.col("seq").isNull()
    result = written(every.observe(seen, F.count_if(left).alias("n"), F.coalesce(F.max(F.when(left, F.col("length"))), F.lit(0)).alias("longest")), f"{name}-matched")
    return result, seen.get["n"], seen.get["longest"]


def packed(parts: DataFrame, most: int = SEQUENCE, name: str = "pack") -> DataFrame:
    """parts (doc_id, piece, length up to most, ...) with sequence_id and offset, in about as few sequences as can be.

    Pieces over half a sequence open one each. Then the others come in bands of length, longest first, each in
    rounds: pieces and gaps are range-sorted, a sweep gives each piece the smallest free gap that holds it (a gap of
    several times the band's length offers as many places), ranks decide where pieces want the same, gaps are
    updated, and the sweep is repeated until it places nothing. What no gap holds opens new sequences, as many to one
    as surely fit, by rank among those alike in that. The driver sees counts only; the number of rounds doesn't grow
    with the pieces. Repeated rows are pieces of their own. No piece gives no row.
    """
    parts = written(parts.withColumn("_id", F.monotonically_increasing_id()), f"{name}-pieces")
    slim = parts.select(F.col("_id").alias("id"), F.col("length").cast("long").alias("length"))
    inside = [(F.col("length") > lo) & (F.col("length") <= hi) for lo, hi in bands(most)]
    sizes = slim.agg(*[F.struct(F.count_if(x), F.coalesce(F.max(F.when(x, F.col("length"))), F.lit(0))) for x in inside]).first()
    large = slim.where(F.col("length") > most // 2)
    done = [large.select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]

    def kept(gaps: DataFrame) -> tuple[DataFrame, list[int]]:
        """gaps that are left, and how many of them each band can use."""
        seen = Observation()
        table = written(gaps.where("gap > 0").observe(seen, *[F.count_if(F.col("gap") > lo).alias(f"g{lo}") for lo, _ in bands(most)]), f"{name}-gaps")
        return table, [seen.get[f"g{lo}"] for lo, _ in bands(most)]

    gaps, usable = kept(large.select(F.col("id").alias("seq"), (most - F.col("length")).alias("gap")))
    for k, ((lo, _), own, (n, longest)) in enumerate(zip(bands(most), inside, sizes)):
        waiting = slim.where(own)
        while n and usable[k]:
            offered = F.greatest(F.lit(1), F.least(F.floor(F.col("gap") / longest), F.lit(-(-2 * n // usable[k])))).cast("int")
            before, n_places = n, usable[k] + 2 * n
            result, n, longest = swept(waiting, gaps.where(F.col("gap") > lo).withColumn("_k", F.explode(F.sequence(F.lit(1), offered))), n + n_places, name)
            if n == before:
                break
            placed = result.where("seq is not null")
            in_order = Window.partitionBy("seq").orderBy(F.col("length").desc(), "id").rowsBetween(Window.unboundedPreceding, -1)
            done.append(placed.select("id", F.col("seq").alias("sequence_id"), (most - F.col("gap") + F.coalesce(F.sum("length").over(in_order), F.lit(0))).alias("offset")))
            used = placed.groupBy("seq").agg(F.sum("length").alias("used"))
            gaps, usable = kept(gaps.join(used, "seq", "left").select("seq", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")))
            waiting = result.where("seq is null").select("id", "length")
        if n:
            each = F.floor(F.lit(most) / F.col("length")).cast("long")
            alike = ranked(waiting.withColumn("each", each).withColumn("less", -F.col("length")), ["each"], ["less", "id"], name)
            alike = written(alike.withColumn("sequence_id", -1 - (F.expr("rank div each") * (most + 1) + F.col("each"))), f"{name}-opened")
            in_order = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
            done.append(alike.select("id", "sequence_id", F.coalesce(F.sum("length").over(in_order), F.lit(0)).alias("offset")))
            gaps, usable = kept(gaps.unionByName(alike.groupBy(F.col("sequence_id").alias("seq")).agg((most - F.sum("length")).alias("gap"))))
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return parts.join(every, F.col("_id") == F.col("id")).select(*[c for c in parts.columns if c != "_id"], "sequence_id", "offset")
