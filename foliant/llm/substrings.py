"""Substring dedup by level-wise doubling of repeated word windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.windows import Words, anchors, blocks, mix
from foliant.session import ship, width

WINDOW = 13
_ROWS = "part int, kind int, data binary"
_WINDOWS, _ANSWERS = 0, 1


def _bytes(column: pa.Array) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["part", "kind", "data"])


def _shrunk(*columns: np.ndarray) -> bytes:
    """Columns of one length as compressed differences, one after the other."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.diff(x, prepend=x.dtype.type(0)).astype(x.dtype).tobytes() for x in columns))


def _grown(raw: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        out.append(np.cumsum(np.frombuffer(raw, kind, n, at), dtype=kind))
        at += n * np.dtype(kind).itemsize
    return out


def _pack(hashes: list[np.ndarray], doc: np.ndarray, row: np.ndarray, pos: np.ndarray, known: np.ndarray) -> bytes:
    """Windows in order of (row, pos): one hash or two as they are, the rest as compressed differences."""
    n = len(doc)
    return n.to_bytes(4, "little") + len(hashes).to_bytes(1, "little") + b"".join(h.tobytes() for h in hashes) + _shrunk(doc, row, pos.astype(np.int32), known.astype(np.uint8))


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    n, k = int.from_bytes(data[:4], "little"), data[4]
    rest = zstandard.ZstdDecompressor().decompress(data[5 + 8 * n * k :])
    doc, row, pos, known = _grown(rest, n, np.int64, np.int64, np.int32, np.uint8)
    return (np.frombuffer(data, np.uint64, n * k, 5).reshape(k, n), doc, row, pos, known.astype(bool))


def _runs(hashes: np.ndarray | list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order by all hashes, each place's group in it, and the groups' least and largest doc_id."""
    order = np.argsort(hashes[0], kind="stable") if len(hashes) == 1 else np.lexsort(hashes[::-1])
    new = np.zeros(len(doc), bool)
    new[0] = True
    for h in hashes:
        by_order = h[order]
        new[1:] |= by_order[1:] != by_order[:-1]
    starts, sorted_doc = np.flatnonzero(new), doc[order]
    return order, np.cumsum(new) - 1, np.minimum.reduceat(sorted_doc, starts), np.maximum.reduceat(sorted_doc, starts)


def _answers(doc: np.ndarray, row: np.ndarray, pos: np.ndarray, parts: int) -> list[tuple[int, int, bytes]]:
    """Places packed for each partition of rows, each once: what is sent grows with the places, not with rows times partitions."""
    if not len(doc):
        return []
    by = (mix((doc ^ row).view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((pos, row, doc, by))
    doc, row, pos, by = doc[order], row[order], pos[order].astype(np.int32), by[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (pos[1:] != pos[:-1])))
    doc, row, pos, by = doc[new], row[new], pos[new], by[new]
    cuts = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1])))
    return [(int(by[a]), _ANSWERS, (b - a).item().to_bytes(4, "little") + _shrunk(doc[a:b], row[a:b], pos[a:b])) for a, b in zip(cuts, np.append(cuts[1:], len(doc)), strict=True)]


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of each row of a partition."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        for x in b.column(2):
            data = x.as_py()
            held.append(_grown(zstandard.ZstdDecompressor().decompress(data[4:]), int.from_bytes(data[:4], "little"), np.int64, np.int64, np.int32))
    if not held:
        return
    doc, row, pos = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    order = np.lexsort((pos, row, doc))
    doc, row, pos = doc[order], row[order], pos[order]
    cuts = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]))))
    ends = np.concatenate((cuts[1:], [len(doc)]))
    for k in range(0, len(cuts), 2000):
        packed = [pos[a:b].tobytes() for a, b in zip(cuts[k : k + 2000], ends[k : k + 2000], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[cuts[k : k + 2000]]), pa.array(row[cuts[k : k + 2000]]), pa.array(packed, pa.binary())], names=["doc_id", "row", "places"])


def _level(n: int, parts: int, last: bool, wide: bool, places: Callable[[Words, list | None], np.ndarray]) -> Callable:
    """A map step: the windows of n words at ``places``, repeats within the block settled at once, the others packed by hash.

    Below the last level a window is answered if documents share it at all, at the last one
    if a document with a smaller id has it. Of windows that a block repeats, it sends on
    those of one document only, so a window in a third of all rows costs a row a block. ``wide``
    windows are told apart by two hashes of 64 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows, texts = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64), _bytes(b.column(2))
            given = b.column(3).to_pylist() if b.num_columns > 3 else None
            for lo, hi in blocks(texts):
                words = Words(texts[lo:hi])
                at = places(words, given and given[lo:hi])
                if not len(at):
                    continue
                hashes = [words.windows(n)[at]]
                if wide:
                    hashes.append(words.windows(n, {1: words.second()})[at])
                doc, row, pos = ids[lo:hi][words.doc[at]], rows[lo:hi][words.doc[at]], words.pos[at]
                order, group, least, most = _runs(hashes, doc)
                answer, send, known = np.zeros(len(doc), bool), np.zeros(len(doc), bool), np.zeros(len(doc), bool)
                first = doc[order] == least[group]
                if last:
                    answer[order], send[order] = ~first, first
                else:
                    shared = (least != most)[group]
                    answer[order], known[order] = shared, shared
                    send[order] = ~shared | np.concatenate(([True], group[1:] != group[:-1]))
                out = _answers(doc[answer], row[answer], pos[answer], parts)
                by = (hashes[0][send] >> np.uint64(20)) % np.uint64(parts)
                split = np.argsort(by, kind="stable")
                sent, fields = [h[send][split] for h in hashes], [x[send][split] for x in (doc, row, pos, known)]
                cuts = np.searchsorted(by[split], np.arange(parts + 1).astype(np.uint64))
                out += [(p, _WINDOWS, _pack([h[cuts[p] : cuts[p + 1]] for h in sent], *(x[cuts[p] : cuts[p + 1]] for x in fields))) for p in range(parts) if cuts[p] < cuts[p + 1]]
                yield _rows(out)

    return run


def _meet(parts: int, last: bool) -> Callable:
    """A reduce step over one partition of packed windows; its size is that of the input over the number of partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for part, kind, data in zip(*b.columns, strict=True):
                if kind.as_py() == _ANSWERS:
                    yield _rows([(part.as_py(), _ANSWERS, data.as_py())])
                else:
                    held.append(_unpack(data.as_py()))
        if not held:
            return
        hashes = np.concatenate([x[0] for x in held], axis=1)
        doc, row, pos, known = (np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
        held.clear()
        order, group, least, most = _runs(hashes, doc)
        if last:
            hit = order[doc[order] > least[group]]
        else:
            shared = (least != most) | (np.bincount(group, known[order]) > 0)
            hit = order[shared[group] & ~known[order]]
        if found := _answers(doc[hit], row[hit], pos[hit], parts):
            yield _rows(found)

    return run


_KEY = ["doc_id", "row"]
#: Stands for a null id: below all others.
_LOWEST = -(2**63)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, text): a row is its id and a hash of its text, so that places found in it are its own, whatever other rows have the id."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST).cast("long")).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row"), F.col(text_col).alias("text"))


def _answered(rows: DataFrame, n: int, parts: int, last: bool, wide: bool, places: Callable) -> DataFrame:
    """(doc_id, row, places) of the windows that a level answers; places: packed ints."""
    sent = rows.mapInArrow(_level(n, parts, last, wide, places), _ROWS).repartitionById(parts, F.col("part"))
    answers = sent.mapInArrow(_meet(parts, last), _ROWS).repartitionById(parts, F.col("part"))
    return answers.mapInArrow(_gather, "doc_id long, row long, places binary")


def _sampled(n: int) -> Callable:
    def places(words: Words, _: list | None) -> np.ndarray:
        at = anchors(words.windows((n + 1) // 2), n, (n + 1) // 2)
        return np.unique(at[words.valid(n)])

    return places


def _marks(words: Words, given: list | None) -> np.ndarray:
    marked = np.zeros(len(words.doc), bool)
    for k, packed in enumerate(given or []):
        if packed:
            marked[words.first[k] + np.frombuffer(packed, np.int32)] = True
    return marked


def _extended(n: int) -> Callable:
    def places(words: Words, given: list | None) -> np.ndarray:
        at = anchors(words.windows((n + 1) // 2), n, (n + 1) // 2)
        return np.flatnonzero(words.valid(n) & _marks(words, given)[at])

    return places


def _doubled(n: int) -> Callable:
    """Windows of n words of which both halves are among the places given."""
    half = (n + 1) // 2

    def places(words: Words, given: list | None) -> np.ndarray:
        marked, ok = _marks(words, given), words.valid(n)
        return np.flatnonzero(ok & marked[: len(ok)] & marked[n - half : n - half + len(ok)])

    return places


def _result(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, packed in zip(_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                words = text.split()
                spans: list[tuple[int, int]] = []
                if packed:
                    starts = np.unique(np.frombuffer(packed, np.int32)).astype(np.int64)
                    breaks = np.flatnonzero(np.diff(starts) > n)
                    spans = list(zip(starts[np.concatenate(([0], breaks + 1))].tolist(), (starts[np.concatenate((breaks, [len(starts) - 1]))] + n).tolist(), strict=True))
                kept, at = [], 0
                for s, e in spans:
                    kept += words[at:s]
                    at = e
                kept += words[at:]
                joined = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), sha256(joined).hexdigest(), [{"start": s, "end": e} for s, e in spans], joined.decode("utf-8", "surrogatepass")))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"])

    return run


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, parts: int | None = None) -> DataFrame:
    """Remove every word covered by ``window`` words that also stand in a document with a smaller id.

    Returns doc_id, n_words, n_removed, kept_sha256, spans (of words removed: start, end) and
    kept_text (words joined by one space).

    Levels: windows of about half the length (7 words for 13) that more than one document has;
    they alone are extended to the full length. A first-level window is looked at only where
    it is the least of those in a full window (by hash): equal full windows agree on that one,
    so none is lost and a quarter of the places is sent. Full windows meet by two independent hashes of 64
    bits, candidates by one; they are packed in blobs for ``parts`` partitions (the session's
    shuffle partitions unless given; a task holds its partition's blobs, about half the bytes of
    the texts over ``parts``). The text is shuffled once, by row, and both levels and the result read that shuffle.

    Null text has no words. A null id is smaller than any other; rows with a null id, and rows that repeat
    an id, are never copies of each other, but each is judged by its own text. Texts of fewer words stay
    whole. Other columns are ignored. No rows give no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = parts or width(spark)
    rows = _keyed(docs, id_col, text_col)
    found = _answered(rows, (window + 1) // 2, parts, False, False, _sampled(window))
    found = _answered(rows.join(found, _KEY, "left"), window, parts, True, True, _extended(window))
    kept = rows.join(found, _KEY, "left").select("doc_id", "text", "places").mapInArrow(_result(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept_text string")
    return kept.withColumn("doc_id", F.nullif("doc_id", F.lit(_LOWEST).cast("long")))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, parts: int | None = None) -> DataFrame:
    """(doc_id, start, end, words): word runs that another document has too, each as long as doubling can show.

    Starts from the windows that several documents share and doubles: windows of twice the
    length, both halves of which were repeated, are compared again, until none survives. Each
    level's survivors are merged into runs that no longer run covers already; ``words`` is
    the level's length. Null ids don't take part; rows that repeat an id are told apart by their texts.
    """
    from foliant.session import cut

    spark = docs.sparkSession
    ship(spark)
    parts = parts or width(spark)
    rows = _keyed(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    found = _answered(rows, (window + 1) // 2, parts, False, False, _sampled(window))
    found = cut(_answered(rows.join(found, _KEY, "left"), window, parts, False, True, _extended(window)))
    levels, n = [], window
    while not found.isEmpty():
        levels.append(found.withColumn("words", F.lit(n)))
        n *= 2
        found = cut(_answered(rows.join(found, _KEY, "left"), n, parts, False, True, _doubled(n)))
    if not levels:
        return spark.createDataFrame([], "doc_id long, start long, end long, words int")
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    return every.groupBy(*_KEY).agg(F.collect_list(F.struct("words", "places")).alias("levels")).select("doc_id", "levels").mapInArrow(_longest_runs, "doc_id long, start long, end long, words int")


def _longest_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for doc, levels in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            spans: list[tuple[int, int, int]] = []
            for level in sorted(levels, key=lambda x: -x["words"]):
                n, starts = level["words"], np.unique(np.frombuffer(level["places"], np.int32)).astype(int)
                breaks = np.flatnonzero(np.diff(starts) > 1)
                for s, e in zip(starts[np.concatenate(([0], breaks + 1))], starts[np.concatenate((breaks, [len(starts) - 1]))] + n, strict=True):
                    if not any(a <= s and e <= z for a, z, _ in spans):
                        spans.append((int(s), int(e), n))
            out += [(doc, *x) for x in sorted(spans)]
        cols = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["doc_id", "start", "end", "words"])
