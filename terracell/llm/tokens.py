"""Token ids, and a file format for them: frequency-ranked ids in byte-aligned variable-length coding.

A file holds documents in order: a header, the documents' ids and token counts, the table from ranks to
token ids, control bytes (two bits a token: bytes that it takes, less one; four tokens a byte), then the
data bytes (ranks, little-endian, 1 to 4 bytes each). The most frequent 256 tokens take one byte. Control
bytes stand apart from data, so numpy decodes a file with table lookups and no loop over tokens.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.llm.common import dropped, running_total, shared_dir, written

#: Distinct pieces that an encoder remembers in a generation, of which it keeps two. Only speed depends on it.
MEMO = 800_000
#: Characters of text that are encoded at a time (a longer text is taken alone).
GROUP = 1 << 23
TOKENS_PER_FILE = 4_000_000
MAGIC = b"RVBYTE01"
HEADER = struct.Struct("<8sqqqqq")
#: Rows are numbered by partition and place in it; a partition has at most so many.
PLACES = 1 << 33


#: Blanks other than the space and the line break.
ASCII_BLANKS = "\t\v\f\r\x1c\x1d\x1e\x1f"
BLANKS = ASCII_BLANKS + "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + length], one behind the other."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Token ids of whole texts with a tokenizers file, added tokens not added.

    The pre-tokenizer of byte-level BPE never joins what stands before a single space between two
    non-blanks with what follows. So a batch of texts is cut at such spaces, its distinct pieces are looked up
    in what the encoder remembers, the new ones are encoded together, and the texts' ids are gathered from the
    pieces' by array steps. Texts with other blanks around a space, texts that hold an added token's string,
    and other kinds of tokenizers take the plain path.
    """

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), memo
        spec, vocabulary = json.loads(self.tokenizer.to_str()), self.tokenizer.get_vocab()
        pre = spec.get("pre_tokenizer") or {}
        self.plain_only = spec.get("normalizer") is not None or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec.get("truncation") is not None or spec["model"].get("unk_token") is not None
        self.added = [a["content"] for a in spec.get("added_tokens", [])]
        self.odd = re.compile(r"\s | \s|\A\s|\s\Z")
        self.size = max(vocabulary.values()) + 1
        self.begins = np.zeros(self.size, bool)  # tokens that begin with a space, which byte-level BPE writes as U+0120
        self.begins[[k for t, k in vocabulary.items() if t.startswith("\u0120")]] = True
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def whole(self, text: str) -> bool:
        """Whether a text has to be encoded as one."""
        if not text or self.plain_only or any(a in text for a in self.added):
            return True
        if any(b in text for b in (ASCII_BLANKS if text.isascii() else BLANKS)):
            return self.odd.search(text) is not None
        return text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text

    def spaced(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces with a space before each: encoded as one text, and cut where a token begins with a space."""
        raw = self.plain(" " + " ".join(pieces))
        starts = (4 * np.flatnonzero(self.begins[np.frombuffer(raw, "<u4")])).tolist()
        if len(starts) != len(pieces):  # another vocabulary than byte-level BPE's
            return [self.plain(" " + p) for p in pieces]
        return [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)])]

    def known(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces with a space before each."""
        if len(self.memo) > self.most:
            self.memo, self.older = {}, self.memo
        found = list(map(self.memo.get, pieces))
        asked = [k for k, x in enumerate(found) if x is None]
        fresh = []
        for k in asked:
            old = self.older.get(pieces[k])
            if old is None:
                fresh.append(k)
            else:
                found[k] = self.memo[pieces[k]] = old
        for at in range(0, len(fresh), 1 << 14):
            some = fresh[at : at + (1 << 14)]
            for k, x in zip(some, self.spaced([pieces[k] for k in some])):
                found[k] = self.memo[pieces[k]] = x
        return found

    def headed(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that begin a text."""
        if len(self.heads) > self.most:
            self.heads = {}
        for p in set(pieces).difference(self.heads):
            self.heads[p] = self.plain(p)
        return [self.heads[p] for p in pieces]

    def pieced(self, texts: list[str], end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """flat() of texts that needn't be encoded as one; there is at least one."""
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        blobs = [*self.known(distinct), *self.headed([distinct[k] for k in coded.indices.to_numpy()[bounds[:-1]].tolist()]), end]
        at = coded.indices.to_numpy().astype(np.int64)
        at[bounds[:-1]] = np.arange(len(texts)) + len(distinct)
        at = np.insert(at, bounds[1:], len(blobs) - 1)
        lengths = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        own = lengths[at]
        counts = np.diff(np.concatenate(([0], np.cumsum(own)))[bounds + np.arange(len(bounds))])
        return gathered(np.frombuffer(b"".join(blobs), "<u4"), (np.cumsum(lengths) - lengths)[at], own), counts

    def flat(self, texts: list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other (each with the end id, if given), and how many each has."""
        end = b"" if end_id is None else end_id_bytes(end_id)
        whole = [k for k, t in enumerate(texts) if self.whole(t or "")]
        if not whole:
            return self.pieced(texts, end) if texts else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        for k in whole:
            out[k] = np.frombuffer((self.plain(texts[k]) if texts[k] else b"") + end, "<u4")
        rest = sorted(set(range(len(texts))).difference(whole))
        if rest:
            ids, counts = self.pieced([texts[k] for k in rest], end)
            for k, x in zip(rest, np.split(ids, np.cumsum(counts)[:-1])):
                out[k] = x
        return np.concatenate(out), np.array(list(map(len, out)), np.int64)

    def ids(self, text: str) -> bytes:
        return self.flat([text])[0].tobytes()


def text_groups(texts: list[str | None], least: int = GROUP) -> Iterator[tuple[int, int]]:
    """(start, stop) of groups of about `least` characters."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= least or k + 1 == len(texts):
            yield start, k + 1
            start, size = k + 1, 0


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, memo: int = MEMO) -> Encoder:
    """The worker's encoder for a file and a memo's size; it lives as long as the worker."""
    if (path, memo) not in _ENCODERS:
        _ENCODERS[path, memo] = Encoder(path, memo)
    return _ENCODERS[path, memo]


def end_id_bytes(end_id: int) -> bytes:
    return struct.pack("<I", end_id)


def narrow(size: int) -> str:
    """The narrowest little-endian type of ids below size."""
    return "<u2" if size <= 1 << 16 else "<u4"


def binary(flat: np.ndarray, counts: np.ndarray, dtype: str) -> pa.Array:
    """A binary array with counts[k] ids in each row."""
    data = np.ascontiguousarray(flat, dtype)
    bounds = np.concatenate(([0], np.cumsum(counts))) * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def merged(batches: Iterator[pa.RecordBatch], text: int, least: int = GROUP) -> Iterator[pa.Table]:
    """Batches put together until they hold about `least` bytes of text: the more texts, the fewer distinct pieces to look up for each."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.column(text).nbytes for x in held) >= least:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def encoded(docs: DataFrame, path: str, end_id: int, dtype: str = "<u4") -> DataFrame:
    """docs (text, ...) with ids in place of text: binary, each text's ids and the end id, of the given type; a null text has the end id only."""
    rest = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest), "ids binary"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for t in merged(batches, len(rest)):
            texts = t.column(len(rest)).to_pylist()
            for a, b in text_groups(texts):
                part = t.slice(a, b - a).select(range(len(rest))).append_column("ids", binary(*own.flat(texts[a:b], end_id), dtype))
                yield from part.combine_chunks().to_batches()

    return docs.select(*[F.col(f"`{c}`") for c in rest], "text").mapInArrow(encode, schema)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    four[: len(ranks)] = extra
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.tobytes(), data.tobytes()


#: Bytes of each of the four tokens that a control byte stands for.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    starts = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[starts].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        out[more] |= raw[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def to_file(first: int, doc_ids: list, counts: list[int], ids: np.ndarray, rank_of: np.ndarray, id_of: np.ndarray) -> bytes:
    """A file's bytes. first: the number of its first document, by which files are ordered. Null doc_ids are marked by a bit map behind the ids."""
    ranks = rank_of[ids]
    control, data = pack_ranks(ranks)
    used = id_of[: int(ranks.max()) + 1 if len(ranks) else 0].astype("<u4")
    known = np.array([d is not None for d in doc_ids], bool)
    return b"".join([
        HEADER.pack(MAGIC, first, len(doc_ids), len(ids), len(used), len(data)),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), np.packbits(known).tobytes(), np.array(counts, "<u4").tobytes(), used.tobytes(), control, data,
    ])


def totals(raw: bytes) -> tuple[int, int]:
    """Number of the first document and number of tokens, from a file's header."""
    _, first, _, tokens, _, _ = HEADER.unpack_from(raw)
    return first, tokens


def from_file(raw: bytes) -> tuple[int, list, np.ndarray, np.ndarray]:
    """Number of the first document, doc_ids, token counts and ids of a file's bytes."""
    magic, first, n, tokens, n_used, n_data = HEADER.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEADER.size

    def take(dtype: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, dtype, count, at)
        at += out.nbytes
        return out

    doc_ids, known, counts, used = take("<i8", n), take("u1", -(-n // 8)), take("<u4", n), take("<u4", n_used)
    control, data = take("u1", -(-tokens // 4)).tobytes(), take("u1", n_data).tobytes()
    ids = used[unpack_ranks(control, data, tokens)] if tokens else np.zeros(0, "<u4")
    return first, [d if k else None for d, k in zip(doc_ids.tolist(), np.unpackbits(known, count=n).astype(bool).tolist())], counts, ids


def frequency_order(coded: DataFrame, size: int, dtype: str) -> np.ndarray:
    """Token ids by falling frequency over all rows of coded (ids), then by id. The driver gets a row for a token id at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), dtype), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["token", "n"])

    counts = coded.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(size, np.int64)
    for r in counts:
        total[r.token] = r.n
    return np.lexsort((np.arange(size), -total))


def write_token_files(docs: DataFrame, directory: str, tokenizer: str, end_id: int = 2, tokens_per_file: int = TOKENS_PER_FILE) -> None:
    """Writes docs (doc_id, text) as token files below directory, in ascending order of doc_id (null first).

    Texts are encoded once, where they lie, and kept as a table of ids below spark.checkpoint.dir. Token
    frequencies are counted over all of it. Then the ids, a fraction of the texts' bytes, are range-sorted by doc_id
    and numbered by partition and place, and each task codes its rows into files of about tokens_per_file tokens.
    A file is named by its first row's number, and written under another name before it is moved, so a task that
    runs twice leaves one whole file. An empty table gives no file; rows of one doc_id are ordered by a hash of
    their text.
    """
    spark, size = docs.sparkSession, max(encoder(tokenizer).size, end_id + 1)
    dtype, raw = narrow(size), shared_dir(spark, "ids")
    encoded(docs.select("doc_id", F.xxhash64("text").alias("h"), "text"), tokenizer, end_id, dtype).write.option("compression", "zstd").parquet(raw)
    coded = spark.read.parquet(raw)
    id_of = frequency_order(coded, size, dtype)
    rank_of = np.empty(size, np.uint32)
    rank_of[id_of] = np.arange(size, dtype=np.uint32)
    table = spark.sparkContext.broadcast((rank_of, id_of.astype(np.uint32)))  # one entry for a token id of the vocabulary

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        rank_of, id_of = table.value
        system, root = fs.FileSystem.from_uri(directory)
        system.create_dir(root, recursive=True)
        doc_ids, blobs, held, first, next_row = [], [], 0, -1, -1

        def close() -> pa.RecordBatch:
            content = to_file(first, doc_ids, [len(b) // np.dtype(dtype).itemsize for b in blobs], np.frombuffer(b"".join(blobs), dtype), rank_of, id_of)
            temporary, final = f"{root}/_{uuid.uuid4().hex}", f"{root}/{first:020d}.tok"
            with system.open_output_stream(temporary) as f:
                f.write(content)
            system.move(temporary, final)
            return pa.RecordBatch.from_arrays([pa.array([first]), pa.array([len(doc_ids)]), pa.array([held])], ["first", "docs", "tokens"])

        for b in batches:
            for d, row, x in zip(*(b.column(k).to_pylist() for k in range(3))):
                if doc_ids and (row != next_row or held >= tokens_per_file):
                    yield close()
                    doc_ids, blobs, held = [], [], 0
                first = first if doc_ids else row
                next_row = row + 1
                doc_ids.append(d)
                blobs.append(x)
                held += len(x) // np.dtype(dtype).itemsize
        if doc_ids:
            yield close()

    ordered = coded.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", F.monotonically_increasing_id().alias("row"), "ids")
    written(ordered.mapInArrow(write, "first long, docs long, tokens long"), "manifest")
    dropped(spark, raw)


def read_token_files(spark: SparkSession, directory: str, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]): documents of the files below directory, ids as little-endian 32-bit binary.

    start: ids of all documents before it, from one running total over the files' headers. ids_crc32: unsigned
    crc32 of the ids, taken where they are decoded.
    """
    schema = "file long, doc_id long, own long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                first, doc_ids, counts, ids = from_file(content.as_py())
                ends = np.cumsum(counts, dtype=np.int64)
                raw, bounds = ids.astype("<u4").tobytes(), [0, *ends.tolist()]
                n = len(doc_ids)
                for k in range(0, n, 1000):
                    j = min(n, k + 1000)
                    own = [raw[4 * x : 4 * y] for x, y in zip(bounds[k:j], bounds[k + 1 : j + 1])]
                    columns = [pa.array([first] * (j - k)), pa.array(doc_ids[k:j], pa.int64()), pa.array(bounds[k:j]), pa.array(counts[k:j].astype(np.int64)), pa.array([zlib.crc32(x) for x in own]), *[pa.array(own, pa.binary())] * keep_ids]
                    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                first, tokens = totals(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([tokens])], ["file", "tokens"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(directory).select("content")
    starts = running_total(files.mapInArrow(head, "file long, tokens long"), "file", "tokens", "base", block=64 * PLACES).select("file", "base")
    return files.mapInArrow(read, schema).join(starts, "file").select("doc_id", (F.col("own") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids)


def token_digest(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """docs written as token files and read back, as (doc_id, start, n_tokens, ids_crc32)."""
    directory = shared_dir(spark, "tokens")
    write_token_files(docs, directory, tokenizer, end_id)
    return read_token_files(spark, directory, keep_ids=False)
