"""SimHash near-duplicates, found by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import connected_components

_H = xxhash.xxh64_intdigest
#: Fingerprints of one key beyond which its pairs aren't listed, and fingerprints that a task then compares at once.
DENSE, BLOCK_PRINTS = 64, 2048
#: Shingles hashed at a time, which bounds memory for very long texts.
BLOCK = 1 << 16


def fingerprint(text: bytes, words_each: int = 3) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, repeats included.

    Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased; shingles are joined by one space and
    hashed by XXH64, seed 42. A bit is set if it is set in over half the hashes. Fewer words than words_each: the whole
    sequence is the one shingle. No words: zero.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < words_each:
        return _H(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ones, total = np.zeros(64, np.int64), n - words_each + 1
    for at in range(0, total, BLOCK):
        to = min(at + BLOCK, total)
        hashed = np.array([_H(joined[s:e], 42) for s, e in zip(starts[at:to].tolist(), ends[at + words_each - 1 : to + words_each - 1].tolist())], "<u8")
        ones += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every row's whole text, as a signed long. Null text: as empty."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t.as_py(), words_each) for t in batch.column(1)], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return common.map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), common.utf8(text_col).alias("t")), each, "id long, fp long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF))


def fingerprint_links(classes: DataFrame, budget: int = 3) -> DataFrame:
    """(a, b): pairs of distinct fingerprints that differ in at most `budget` (0 to 3) bits; classes has fp and rep.

    Pigeonring over a ring of four 16-bit segments: of fingerprints that differ in at most 3 bits, some segment starts
    a chain in which the first l segments together differ in at most floor(l * 3 / 4) bits, for each l. So the first
    is equal, the first two differ in at most one bit, the first three in at most two. The first two conditions are the
    equi-join's key: one side gives its 32 bits, the other these with none or one bit of the second segment turned.
    The third drops candidates before the full Hamming distance is taken. Keys have 32 bits, so that the candidates
    per fingerprint grow with the number of fingerprints over 2^32. Keys that over DENSE fingerprints have, as in a ball
    of near copies, are taken out of the join: their fingerprints are cut into blocks, each pair of blocks is a task's
    share, and of the links found there a forest that joins the same fingerprints is kept, not all pairs.
    """
    if not 0 <= budget <= 3:
        raise ValueError("a ring of four segments covers budgets of 0 to 3 bits")
    fp = F.col("fp")
    starts = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(i).cast("long") * (1 << 32) + _segment(fp, i) * (1 << 16) + _segment(fp, i + 1)).alias("key")) for i in range(4)])
    index = classes.select("fp", F.explode(starts).alias("s")).select("fp", "s.i", "s.key")
    turns = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(16)])
    probe = index.select(F.col("fp").alias("a"), "i", "key", F.explode(turns).alias("turn")).select("a", "i", F.col("key").bitwiseXOR(F.col("turn")).alias("key"))
    diff = F.col("a").bitwiseXOR(fp)
    bits = [F.bit_count(_segment(diff, i)) for i in range(4)]
    chain = F.lit(False)
    for i in range(4):
        chain = chain | ((F.col("i") == i) & (bits[i] + bits[(i + 1) % 4] + bits[(i + 2) % 4] <= 2))
    dense, _ = common.written(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > DENSE).select(F.col("key").alias("dense")), "dense")
    n_dense = dense.count()
    few = F.broadcast(dense) if n_dense * 32 <= common.BROADCAST_BYTES else dense
    sparse = index.join(few, F.col("key") == F.col("dense"), "left_anti") if n_dense else index
    met = probe.join(sparse.select("fp", "key"), "key").where((F.col("a") < fp) & chain & (F.bit_count(diff) <= budget))
    out = met.select("a", fp.alias("b")).distinct()
    if not n_dense:
        return out
    members = probe.select(F.col("a").alias("fp"), "key").union(index.select("fp", "key")).join(few, F.col("key") == F.col("dense"), "left_semi").distinct()
    return out.union(_dense_links(members, budget))


def near_forest(prints: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """Links that join whatever pairs of fingerprints with at most `budget` different bits join: each one is compared
    with those not yet reached, so that there are fewer links than fingerprints."""
    bits, open_, out = prints.view(np.uint64), np.ones(len(prints), bool), []
    for seed in range(len(prints)):
        stack = [seed] if open_[seed] else []
        open_[seed] = False
        while stack and open_.any():
            at, left = stack.pop(), np.flatnonzero(open_)
            near = left[np.bitwise_count(bits[left] ^ bits[at]) <= budget]
            open_[near] = False
            out += [(int(prints[at]), int(prints[k])) for k in near]
            stack += near.tolist()
    return out


def _dense_links(members: DataFrame, budget: int) -> DataFrame:
    """(a, b): a forest of the links among the fingerprints of each key of members(fp, key)."""
    sizes = members.groupBy(F.col("key").alias("of")).agg(F.ceil(F.count(F.lit(1)) / BLOCK_PRINTS).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    shares = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct("key", F.least(own, o).alias("lo"), F.greatest(own, o).alias("hi")))
    dealt = members.join(sizes, F.col("key") == F.col("of")).select("fp", F.explode(shares).alias("s")).select("s.key", "s.lo", "s.hi", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(prints: list[int]) -> pa.RecordBatch:
            links = [(min(x), max(x)) for x in near_forest(np.array(prints, np.int64), budget)]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

        share, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != share:
                    if len(held) > 1:
                        yield out(held)
                    share, held = row[:3], []
                held.append(row[3])
        if len(held) > 1:
            yield out(held)

    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3, budget: int = 3) -> DataFrame:
    """(id_col, fingerprint, component_id) for each row: its fingerprint as 16 hex digits, and the smallest id that is
    reached over links between fingerprints of at most `budget` different bits.

    Equal fingerprints are one class, whose smallest id stands for it; links join classes only. Null text counts as
    empty, and texts without words are linked like any others. A null id belongs to its class, but names none: a class
    of null ids alone has a null component. Rows that repeat an id each give a row. An empty table gives no rows. Very
    long texts are hashed in blocks; other columns are not read, whatever their names.
    """
    common.prepare(docs.sparkSession)
    rows = fingerprints(docs, id_col, text_col, words_each).checkpoint()
    classes = rows.groupBy("fp").agg(F.min("id").alias("rep")).checkpoint()
    found = fingerprint_links(classes, budget)
    links = found.join(classes.select(F.col("fp").alias("a"), F.col("rep").alias("u")), "a").join(classes.select(F.col("fp").alias("b"), F.col("rep").alias("v")), "b")
    reached = connected_components(links, "u", "v")
    named = classes.join(reached, classes["rep"] == reached["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
