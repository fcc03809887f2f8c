"""Best-fit packing of tokenized documents into sequences of a fixed length."""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import cut, ship

LENGTH, END_ID = 4096, 1
#: Tokens and pieces that a packing task takes on average at most, and shards whose last bins meet again in one task.
SHARD_TOKENS, SHARD_PIECES, MERGED = 1 << 21, 1 << 18, 4096
#: Words whose ids each half of a worker's memory holds, and characters of a text that are split at a time.
REMEMBERED, SLICE_CHARS = 150_000, 1 << 20

# Letters and numbers of printable Latin text (to U+017F). In such text the tokenizer's own pattern is these classes alone.
_LATIN_CHARS = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x180))]
_LETTERS = "".join(c for c in _LATIN_CHARS if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in _LATIN_CHARS if unicodedata.category(c)[0] == "N")
_LATIN = re.compile(f"[{re.escape(''.join(_LATIN_CHARS))} \\t\\n\\r]*")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^ \\t\\n\\r{_LETTERS}{_NUMBERS}]+")
#: Bytes as the characters that byte-level vocabularies write them by: printable ones as they are, the others from 256 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def _packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Remembered(dict):
    """Results of ``find``. Once ``most`` are held, what was not asked for since the last time is forgotten; long keys are not kept."""

    def __init__(self, find: Callable[[str], bytes], most: int):
        self.find, self.most, self.older = find, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.find(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class _Ids:
    """Ids of texts, as little-endian unsigned 32-bit integers; what it remembers is bounded, whatever the corpus."""

    def __init__(self, path: str, most: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.words, self.chunks = _Remembered(self._word, most), _Remembered(self._chunk, most // 8)

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() else "".join(map(_BYTE.__getitem__, word.encode()))
        return _packed_ids([x.id for x in self.tokenize(shown)])

    def _chunk(self, chunk: str) -> bytes:
        if "<|" in chunk or not _LATIN.fullmatch(chunk):
            return _packed_ids(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        return b"".join(map(self.words.__getitem__, _PIECES.findall(chunk.lower())))

    def of(self, text: str) -> bytes:
        """The tokenizer lowers case, splits at white space and drops it, then splits by its pattern and merges within each word.

        Printable Latin text is done so word by word. Of other texts (other scripts, controls,
        special tokens) each chunk between blanks is, and what is not Latin goes to the tokenizer itself.
        """
        if "<|" not in text and _LATIN.fullmatch(text):
            return b"".join(map(self.words.__getitem__, _PIECES.findall(text.lower())))
        return b"".join(map(self.chunks.__getitem__, filter(None, text.replace("\n", " ").replace("\t", " ").split(" "))))


_tokenizers: dict[str, _Ids] = {}


def _slices(text: str, size: int) -> Iterator[str]:
    """Parts of a text of about ``size`` characters, cut at blanks; a longer stretch without any is one part."""
    at = 0
    while len(text) - at > size:
        stop = text.rfind(" ", at, at + size)
        if stop <= at:
            stop = text.find(" ", at + size)
        if stop < 0:
            break
        yield text[at:stop]
        at = stop + 1
    yield text[at:] if at else text


def token_ids(texts: Iterable[str | None], tokenizer_path: str) -> Iterator[bytes]:
    """Each text's ids, without the end id. Null counts as empty."""
    if tokenizer_path not in _tokenizers:
        _tokenizers[tokenizer_path] = _Ids(tokenizer_path)
    of = _tokenizers[tokenizer_path].of
    for text in texts:
        text = text or ""
        yield of(text) if len(text) <= SLICE_CHARS else b"".join(map(of, _slices(text, SLICE_CHARS)))


def _pieces(tokenizer_path: str, length: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()
    names, kinds = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            docs, texts = b.column(0).to_pylist(), (t.as_py() for t in b.column(1))
            for doc, ids in zip(docs, token_ids(texts, tokenizer_path), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    piece = ids[at : at + 4 * length]
                    rows.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece), piece if with_ids else None))
                if len(rows) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): documents as ids and an end id; longer ones cut every ``length`` ids. ids (little-endian unsigned 32-bit) only if asked for."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pieces(tokenizer_path, length, end_id, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: largest first, each into the open bin with the least room that holds it.

    Open bins are kept by remaining room: a stack for each room from 0 to ``capacity``, and over
    the rooms a segment tree that counts the bins below each node. The tightest bin for
    an item is the first non-empty leaf from its size on, found in log(capacity) steps up
    and down the tree, whatever the number of bins.
    """
    leaves = 1 << capacity.bit_length()
    tree, stacks = [0] * (2 * leaves), [[] for _ in range(leaves)]
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    opened = 0

    def count(room: int, by: int) -> None:
        at = room + leaves
        while at:
            tree[at] += by
            at >>= 1

    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        at = size + leaves
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            if at > 1:
                at += 1
                while at < leaves:
                    at = 2 * at if tree[2 * at] else 2 * at + 1
        if at > 1:
            room = at - leaves
            chosen = stacks[room].pop()
            count(room, -1)
        else:
            room, chosen = capacity, opened
            opened += 1
        bins[item], offsets[item] = chosen, capacity - room
        if room > size:
            stacks[room - size].append(chosen)
            count(room - size, 1)
    return bins, offsets


def _packed(capacity: int):
    """One shard's items (size) into bins: adds bin, offset."""

    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("size").to_numpy()
        order = np.lexsort((table.column("piece").to_numpy(), table.column("doc_id").fill_null(-(2**63)).to_numpy()))
        bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        bins[order], offsets[order] = best_fit_decreasing(sizes[order], capacity)
        return table.append_column("bin", pa.array(bins)).append_column("offset", pa.array(offsets)).select(["shard", "doc_id", "piece", "start", "size", "ids_crc32", "bin", "offset"])

    return run


def _remerged(capacity: int):
    """The least filled bins of many shards into fewer: adds to, by."""

    def run(table: pa.Table) -> pa.Table:
        bins, offsets = best_fit_decreasing(table.column("used").to_numpy(), capacity)
        return pa.table({"shard": table.column("shard"), "bin": table.column("bin"), "lot": table.column("lot"), "to": pa.array(bins), "by": pa.array(offsets)})

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Best-fit decreasing: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces are dealt by a hash to shards of about ``shard_tokens`` tokens, whose number follows the
    input; each shard packs its own lengths. Best fit leaves at most one bin of a shard
    half empty; such bins of up to 4096 shards are packed again, whole, so that sharding costs
    next to nothing. Full pieces are sequences already and are not dealt out.

    Null and empty texts are the end id alone. Null ids are kept. Repeated rows are packed as
    often as they come. Equal lengths are taken by (doc_id, piece). Other columns are ignored.
    No rows give no rows.
    """
    spark = docs.sparkSession
    pieces = cut(token_pieces(docs, tokenizer_path, id_col, text_col, length, end_id).drop("ids").withColumn("row", F.monotonically_increasing_id()))
    tokens, count = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    shards = 1 + max(tokens // shard_tokens, count // SHARD_PIECES)
    fields = ["doc_id", "piece", "start", F.col("length").alias("size"), "ids_crc32"]
    part = pieces.where(F.col("length") < length).select(F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(shards)).alias("shard"), *fields)
    packed = cut(part.groupBy("shard").applyInArrow(_packed(length), "shard long, doc_id long, piece int, start long, size long, ids_crc32 long, bin long, offset long"))
    half = packed.groupBy("shard", "bin").agg(F.sum("size").alias("used")).where(F.col("used") <= length // 2)
    moved = half.withColumn("lot", F.expr(f"shard div {MERGED}")).groupBy("lot").applyInArrow(_remerged(length), "shard long, bin long, lot long, to long, by long")
    # Sequences are named by (kind, shard or lot, bin) in one number: 2 bits, 30 bits, 31 bits.
    named = packed.join(moved, ["shard", "bin"], "left").select(
        "doc_id", "piece", "start", F.col("size").alias("length"), "ids_crc32",
        F.when(F.col("lot").isNull(), F.shiftleft("shard", 31) + F.col("bin")).otherwise(F.shiftleft(F.lit(1).cast("long"), 61) + F.shiftleft("lot", 31) + F.col("to")).alias("sequence_id"),
        (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"),
    )
    full = pieces.where(F.col("length") == length).select("doc_id", "piece", "start", "length", "ids_crc32", (F.shiftleft(F.lit(1).cast("long"), 62) + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return named.unionByName(full)
