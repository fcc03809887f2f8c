"""SimHash near-dedup: fingerprints, pigeonhole blocks, verified links, components."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.components import connected_components
from foliant.session import cut, ship

BLOCKS, MAX_BITS, SHINGLE, SEED, SALTS = 7, 4, 4, 42, 32
#: Fingerprints of one bucket that are compared in memory; larger buckets meet by midpoints.
BUCKET = 16384


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text: bit b is set if it is set in over half of the shingles' XXH64."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([digest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(words) - shingle + 1
        hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)
    bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        bits += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes)).view(np.uint64)[0])


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), b.column(2), b.column(3)], names=["doc_id", "fp", "text_hash", "tie"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, text_hash, tie): fp holds the 64 bits as a signed long, tie is a hash of the row's other columns. Null text has no words, so 0."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"), _tie(docs, id_col, text_col).alias("tie"))
    return rows.mapInArrow(_fingerprints(shingle, seed), "doc_id long, fp long, text_hash long, tie long")


def _tie(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A hash of what tells rows of one id and text apart: their other columns, as far as Spark hashes them."""
    others = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name not in (id_col, text_col) and not re.search("map<|variant", f.dataType.simpleString())]
    return F.xxhash64(*others) if others else F.lit(0).cast("long")


def block_masks(blocks: int = BLOCKS, max_bits: int = MAX_BITS) -> list[int]:
    """Masks of each choice of blocks - max_bits blocks, as signed longs: fingerprints that differ in max_bits bits agree on one."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    single = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(single[k] for k in chosen) for chosen in combinations(range(blocks), blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _linked(members: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that span the members' components, found by comparing each member with those not yet reached."""
    rest, out = members[1:], []
    todo = [members[0]]
    while len(rest):
        at = todo.pop() if todo else None
        if at is None:
            at, rest = rest[0], rest[1:]
        near = np.bitwise_count(rest ^ at) <= max_bits
        out += [(int(at), int(x)) for x in rest[near]]
        todo += list(rest[near])
        rest = rest[~near]
    return out


def _bucket_links(max_bits: int, bucket: int):
    """Over rows (c, k, fp) sorted by (c, k): links within buckets; members of larger buckets are passed on as hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of the bucket that is still open
        held_key, held_n, spilled = None, 0, False

        def out(links: list[tuple[np.ndarray, np.ndarray, bool]]):
            for a, b, hot in links:
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), hot))], names=["a", "b", "hot"])

        def close():
            nonlocal held, held_key, held_n, spilled
            group, was = np.concatenate(held) if held else np.zeros(0, np.uint64), spilled
            held, held_key, held_n, spilled = [], None, 0, False
            if was:
                return [(group, group, True)]
            if len(group) < 2:
                return []
            pairs = np.array(_linked(group, max_bits), np.uint64).reshape(-1, 2)
            return [(pairs[:, 0].copy(), pairs[:, 1].copy(), False)]

        for b in batches:
            if not b.num_rows:
                continue
            c, k, fp = (b.column(j).to_numpy(zero_copy_only=False) for j in range(3))
            fp = fp.astype(np.int64).view(np.uint64)
            cuts = np.flatnonzero((c[1:] != c[:-1]) | (k[1:] != k[:-1])) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fp)]))
            found: list[tuple[np.ndarray, np.ndarray, bool]] = []
            if held_key != (c[0], k[0]):
                found += close()
            inner = np.ones(len(starts), bool)
            inner[-1] = False
            if held_key is not None:
                inner[0] = False
            sizes = ends - starts
            two = starts[inner & (sizes == 2)]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits]
            found.append((fp[near], fp[near + 1], False))
            links: list[tuple[int, int]] = []
            for r in np.flatnonzero(inner & (sizes > 2)):
                group = fp[starts[r] : ends[r]]
                if len(group) > bucket:
                    found.append((group, group, True))
                else:
                    links += _linked(group, max_bits)
            if links:
                pairs = np.array(links, np.uint64)
                found.append((pairs[:, 0].copy(), pairs[:, 1].copy(), False))
            for r in dict.fromkeys((0, len(starts) - 1)):
                if inner[r]:
                    continue
                key = (c[starts[r]], k[starts[r]])
                if held_key is not None and held_key != key:
                    found += close()
                held_key = key
                held.append(fp[starts[r] : ends[r]])
                held_n += sizes[r]
                if held_n > bucket:
                    spilled = True
                    group = np.concatenate(held)
                    found.append((group, group, True))
                    held = []
            yield from out(found)
        yield from out(close())

    return run


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) at max_bits or fewer bits, enough of them to span each component.

    Pigeonhole: of ``blocks`` blocks at least blocks - max_bits agree, so each fingerprint is
    dealt out once for each choice of that many blocks and compared within such buckets.
    A bucket yields fewer links than it has members, never all its pairs. The members of
    a bucket beyond ``bucket`` are linked without comparing them with each other: two
    fingerprints are within max_bits bits if and only if some value is within half of
    that of both, so they meet at their midpoints, at most 2081 to a value for 4 bits.
    """
    ship(distinct.sparkSession)
    masks = block_masks(blocks, max_bits)
    keys = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for c, m in enumerate(masks)]))
    dealt = distinct.select("fp", keys.alias("key")).select("key.c", "key.k", "fp")
    found = cut(dealt.repartition("c", "k").sortWithinPartitions("c", "k").mapInArrow(_bucket_links(max_bits, bucket), "a long, b long, hot boolean"))
    plain = found.where(~F.col("hot")).select("a", "b")
    if found.where("hot").isEmpty():
        return plain
    return plain.unionByName(midpoint_links(found.where("hot").select(F.col("a").alias("fp")).distinct(), max_bits))


def midpoint_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """As near_links, by midpoints alone."""
    flips = [sum(1 << b for b in bits) for r in range((max_bits + 1) // 2 + 1) for bits in combinations(range(64), r)]
    flips = [m - (1 << 64) if m >> 63 else m for m in flips]
    reach = F.explode(F.transform(F.lit(flips).cast("array<long>"), lambda m: F.col("fp").bitwiseXOR(m)))
    met = distinct.select("fp", reach.alias("mid")).groupBy("mid").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    pairs = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits) if max_bits % 2 else pairs


def _classed(docs: DataFrame, id_col: str, text_col: str, max_bits: int = MAX_BITS, blocks: int = BLOCKS, shingle: int = SHINGLE, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """As near_duplicates, with text_hash, tie and ``stays``: the (id, text_hash, tie) of the component's row of least id, null ids last."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle, seed)).withColumn("place", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "tie"))
    dealt = fps.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    classes = cut(
        dealt.groupBy("fp", "salt").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
        .groupBy("fp").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts"))
    )
    roots = connected_components(near_links(classes.select("fp"), max_bits, blocks, bucket))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", "n", "salts", F.coalesce("root", "fp").alias("root"), F.pmod(F.xxhash64("fp"), F.lit(SALTS)).alias("lot"))
    named = (
        rooted.groupBy("root", "lot").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
        .groupBy("root").agg(F.min("first").alias("stays"), F.sum("n").alias("component_size"), F.collect_set("lot").alias("lots"))
        .select("root", "stays", "component_size", F.explode("lots").alias("lot"))
    )
    answers = rooted.join(named, ["root", "lot"]).select("fp", "stays", "component_size", F.explode("salts").alias("salt"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return dealt.join(answers, ["fp", "salt"]).select("doc_id", "text_hash", "tie", "stays", hexed.alias("fingerprint"), F.col("stays.doc_id").alias("component_id"), "component_size")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, blocks: int = BLOCKS, shingle: int = SHINGLE, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """SimHash classes: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable), component_size.

    Equal fingerprints are folded before any search, by (fingerprint, salt) first, so a
    hot fingerprint costs one row; a component's fingerprints get its id by (root, lot), so
    that a component holding a third of them is dealt to many tasks. Null and empty texts have fingerprint zero and are linked
    like any other. A null id never names a component unless the component has no other.
    Repeated rows are returned as often as they came; ties cannot arise. Other columns are
    ignored. No rows give no rows.
    """
    return _classed(docs, id_col, text_col, max_bits, blocks, shingle, seed, bucket).drop("text_hash", "tie", "stays")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: that of the smallest id.

    Rows of the smallest id are told apart by hashes of their text and then of their other columns, so near copies under
    one id, or under null ids (which come last), leave one row too; rows equal in all columns
    are one. Null and empty texts form a component like any other. Column names may be anything. No rows give no rows.
    """
    stay = _classed(docs, id_col, text_col, **how).select("stays.doc_id", "stays.text_hash", "stays.tie").distinct()
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), _tie(docs, id_col, text_col).alias("row_tie"))
    kept = keyed.join(stay, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")) & (F.col("row_tie") == F.col("tie")), "left_semi")
    return kept.dropDuplicates(["id", "hash", "row_tie"]).select("row.*")
