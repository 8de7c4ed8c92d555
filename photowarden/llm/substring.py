"""Exact removal of repeated word windows behind a count-min prefilter.

Documents are dealt to chunks by a hash of doc_id; every pass below reads the same exchange.

1. A chunk sketches its windows: for each of two rows, the sorted counters that its windows touch, saturated at two.
   A counter's block (its leading bits) is the unit of merging, so the sketch as a whole is in no one place and its
   width follows the input: eight counters a window and row.
2. A block's counters are added over all chunks. Every chunk gets one bit for each counter that it sent: whether the
   sum is two or more. Counters only overestimate, so no repeated window is lost.
3. A chunk sends each different window of which both counters say "repeated" once, with the smallest doc_id that has it
   in the chunk. A window is told by the 128-bit BLAKE2b digest of its words themselves, joined by one space; blocks of
   digests are grouped, and each chunk gets one bit a window: whether an earlier document elsewhere has it.
4. A window that occurs before in its own chunk, or whose first occurrence in the chunk got that bit, is a repeat; the
   words it covers are removed.

The sketch's own hash only chooses counters: where it collides, windows are estimated repeated that are not, and the
digests part them again.

A window repeated a million times is one entry a chunk, so no block is hot. What goes back and forth is about four
bytes a window for the sketch and sixteen a window that is estimated repeated.

Chunks and blocks grow with the input (up to CHUNK_BYTES_MOST and BLOCK_BITS_MOST), so that what a chunk sends to a block
stays far longer than the row that holds it.

Defined results: null text has no words; a text of fewer words than a window stays as it is; null ids come last in the
order, among themselves by a hash of the text and the text; rows that share a doc_id are ordered by text, and of equal
rows the first counts as earlier; an empty table gives no rows; extra columns are carried along unchanged unless their
names are n_words, n_removed or kept_sha256, which are replaced.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from photowarden.llm import common

WINDOW = 20
CHUNK_BYTES, CHUNK_BYTES_MOST = 4 << 20, 64 << 20
LEAST_CHUNKS = 64
COUNTERS_A_WINDOW = 8
#: Counters of a block at most: bounds the memory of a merging task.
BLOCK_BITS, BLOCK_BITS_MOST = 23, 26
_U = np.uint64
_NEW = ("n_words", "n_removed", "kept_sha256")


def _windows(texts: list[str | None], size: int):
    """A hash of every window, its document's row and its first word, in order of row and start; words by row, UTF-8."""
    raw = [common.utf8(t) for t in texts]
    (h,), counts = common.word_hashes(raw, (0,))
    first = np.cumsum(counts) - counts
    n = np.maximum(counts - size + 1, 0)
    start = np.repeat(first, n) + _ranges(n)
    w = common.window_hashes(h, size)[start] if len(start) else np.zeros(0, _U)
    return w, np.repeat(np.arange(len(raw)), n), start, counts, raw


def window_digests(data: bytes, starts: list[int], size: int) -> bytes:
    """16 bytes for each window: the digest of its words joined by one space; starts: their first words."""
    words = data.split()
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    at = np.array(starts)
    out, digest = bytearray(), hashlib.blake2b
    for a, b in zip(begins[at].tolist(), ends[at + size - 1].tolist(), strict=True):
        out += digest(joined[a:b], digest_size=16).digest()
    return bytes(out)


def _ranges(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ..."""
    total = int(n.sum())
    return np.arange(total) - np.repeat(np.cumsum(n) - n, n)


def _ordered(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table, sort_keys=[("__pw_late", "ascending"), ("__pw_order", "ascending"), ("text", "ascending")]))


def _counters(w0: np.ndarray, row: int, bits: int) -> np.ndarray:
    h = w0 if row == 0 else common.mix(w0 ^ _U(0x5851F42D4C957F2D))
    return (h >> _U(64 - bits)).astype(np.int64)


def _pack(values: np.ndarray) -> bytes:
    """Integers as differences from the least, of as few bytes as they all need."""
    least = int(values.min()) if len(values) else 0
    rest = (values - least).astype("<u8")
    wide = max(1, -(-int(rest.max()).bit_length() // 8)) if len(values) else 1
    return bytes([wide]) + least.to_bytes(8, "little", signed=True) + rest.view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    wide, least = data[0], int.from_bytes(data[1:9], "little", signed=True)
    part = np.frombuffer(data, np.uint8, offset=9).reshape(-1, wide)
    rest = np.zeros((len(part), 8), np.uint8)
    rest[:, :wide] = part
    return rest.view("<u8").ravel().astype(np.int64) + least


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=0))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data))


def _by_block(block: np.ndarray):
    """(block, slice) of sorted block numbers."""
    edges = np.flatnonzero(np.diff(block)) + 1
    for a, b in itertools.pairwise([0, *edges.tolist(), len(block)]):
        if b > a:
            yield int(block[a]), slice(a, b)


def _estimated(w: np.ndarray, masks: list[dict], bits: int, block_bits: int) -> np.ndarray:
    """Whether both counters of each window say that it is repeated."""
    both = np.ones(len(w), bool)
    for row in (0, 1):
        said = {m["block"]: m["bits"] for m in masks if m["sketch_row"] == row}
        values, inverse = np.unique(_counters(w, row, bits), return_inverse=True)
        flags = np.zeros(len(values), bool)
        for b, part in _by_block(values >> block_bits):
            flags[part] = np.unpackbits(np.frombuffer(said[b], np.uint8), count=part.stop - part.start).astype(bool)
        both &= flags[inverse]
    return both


def _candidates(both: np.ndarray, doc_row: np.ndarray, start: np.ndarray, counts: np.ndarray, raw: list[bytes], size: int):
    """Windows estimated repeated, in order of digest and then place: their indices, the halves of their digests, and
    which are the first with theirs."""
    at = np.flatnonzero(both)
    first = np.cumsum(counts) - counts
    digests = []
    for _, part in _by_block(doc_row[at]):
        row = int(doc_row[at[part.start]])
        digests.append(window_digests(raw[row], (start[at[part]] - first[row]).tolist(), size))
    key = np.frombuffer(b"".join(digests), ">u8").astype(_U).reshape(-1, 2)
    order = np.lexsort((at, key[:, 1], key[:, 0]))
    at, key = at[order], key[order]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]).any(1)
    return at, key, new


def dedup_windows(docs: DataFrame, size: int = WINDOW, chunk_bytes: int | None = None) -> DataFrame:
    """Adds n_words, n_removed and kept_sha256 (of the kept words joined by one space), and takes the repeated words out
    of text; what stays of a changed text keeps its own white space within each kept run."""
    spark = docs.sparkSession
    common.prepare(spark)
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    chunk_bytes = chunk_bytes or min(CHUNK_BYTES_MOST, max(CHUNK_BYTES, total >> 16))
    chunks = max(LEAST_CHUNKS, -(-total // chunk_bytes))
    bits = max(BLOCK_BITS - 3, int(COUNTERS_A_WINDOW * total / 6).bit_length())
    exact_log = min(bits, max(6, bits - BLOCK_BITS))
    block_bits = bits - min(bits, max(6, bits - min(BLOCK_BITS_MOST, max(BLOCK_BITS, bits // 2 + 5))))
    own = [c for c in docs.columns if c not in _NEW]
    late = F.col("doc_id").isNull()
    order = F.when(late, F.xxhash64(F.col("text"))).otherwise(F.col("doc_id").cast("long"))
    pair = docs.select(*(F.col(f"`{c}`") for c in own), late.alias("__pw_late"), order.alias("__pw_order")).withColumn("__pw_chunk", common.spread("__pw_order", chunks)).repartition("__pw_chunk")
    # all passes read all columns, so that they share one exchange
    carried = pair.select(*(F.col(f"`{c}`") for c in own if c != "text"), F.col("text").cast("string").alias("text"), "__pw_chunk", "__pw_late", "__pw_order")

    def sketch(table: pa.Table) -> pa.Table:
        w, *_ = _windows(table.column("text").to_pylist(), size)
        rows, chunk = [], table.column("__pw_chunk")[0].as_py() if table.num_rows else 0
        for row in (0, 1):
            values, n = np.unique(_counters(w, row, bits), return_counts=True)
            for b, part in _by_block(values >> block_bits):
                rows.append((row, b, chunk, _pack_sorted(values[part] - (b << block_bits)), np.packbits(n[part] > 1).tobytes()))
        return _table(rows, sketch_row=pa.int32(), block=pa.int64(), __pw_chunk=pa.int64(), counters=pa.binary(), twice=pa.binary())

    def merge(table: pa.Table) -> pa.Table:
        once, twice = np.zeros(1 << block_bits, bool), np.zeros(1 << block_bits, bool)
        for counters, more in zip(table.column("counters"), table.column("twice"), strict=True):
            at = _unpack_sorted(counters.as_py())
            twice[at] |= once[at] | np.unpackbits(np.frombuffer(more.as_py(), np.uint8), count=len(at)).astype(bool)
            once[at] = True
        said = [np.packbits(twice[_unpack_sorted(c.as_py())]).tobytes() for c in table.column("counters")]
        return pa.Table.from_arrays([table.column("__pw_chunk"), table.column("sketch_row"), table.column("block"), pa.array(said, pa.binary())], ["__pw_chunk", "sketch_row", "block", "bits"])

    def candidates(table: pa.Table, masks: pa.Table) -> pa.Table:
        rows = []
        if table.num_rows:
            table = _ordered(table)
            w, doc_row, start, counts, raw = _windows(table.column("text").to_pylist(), size)
            at, key, new = _candidates(_estimated(w, masks.to_pylist(), bits, block_bits), doc_row, start, counts, raw, size)
            first, key = doc_row[at[new]], key[new]  # of equal windows the first in order comes first
            doc, nulls, chunk = table.column("__pw_order").to_numpy(), table.column("__pw_late").to_numpy(), table.column("__pw_chunk")[0].as_py()
            for b, part in _by_block((key[:, 0] >> _U(64 - exact_log)).astype(np.int64)):
                last = nulls[first[part]]
                rows.append((b, chunk, key[part].tobytes(), _pack(doc[first[part]]), np.packbits(last).tobytes() if last.any() else b""))
        return _table(rows, block=pa.int64(), __pw_chunk=pa.int64(), keys=pa.binary(), docs=pa.binary(), late=pa.binary())

    def group(table: pa.Table) -> pa.Table:
        held = [_unpack(d) for d in table.column("docs").to_pylist()]
        sizes = [len(d) for d in held]
        key = np.frombuffer(b"".join(table.column("keys").to_pylist()), _U).reshape(-1, 2)
        doc = np.concatenate(held)
        last = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) if x else np.zeros(n, np.uint8) for x, n in zip(table.column("late").to_pylist(), sizes, strict=True)])
        order = np.lexsort((doc, last, key[:, 1], key[:, 0]))
        later = np.zeros(len(doc), bool)
        later[order[1:]] = (key[order[1:]] == key[order[:-1]]).all(1)
        ends = np.cumsum(sizes)
        said = [np.packbits(later[a:b]).tobytes() for a, b in zip(ends - sizes, ends, strict=True)]
        return pa.Table.from_arrays([table.column("__pw_chunk"), pa.array([2] * len(sizes), pa.int32()), table.column("block"), pa.array(said, pa.binary())], ["__pw_chunk", "sketch_row", "block", "bits"])

    def remove(table: pa.Table, masks: pa.Table) -> pa.Table:
        table = _ordered(table)
        texts = table.column("text").to_pylist()
        w, doc_row, start, counts, raw = _windows(texts, size)
        covered = np.zeros(int(counts.sum()) + 1, np.int64)
        if len(w):
            masks = masks.to_pylist()
            at, key, new = _candidates(_estimated(w, masks, bits, block_bits), doc_row, start, counts, raw, size)
            said = {m["block"]: m["bits"] for m in masks if m["sketch_row"] == 2}
            later = np.zeros(int(new.sum()), bool)
            for b, part in _by_block((key[new][:, 0] >> _U(64 - exact_log)).astype(np.int64)):
                later[part] = np.unpackbits(np.frombuffer(said[b], np.uint8), count=part.stop - part.start).astype(bool)
            gone = start[np.concatenate((at[~new], at[new][later]))]
            np.add.at(covered, gone, 1)
            np.add.at(covered, gone + size, -1)
        keep = np.cumsum(covered[:-1]) == 0
        ends = np.cumsum(counts)
        n_removed, shas, left = [], [], []
        for text, data, a, b in zip(texts, raw, (ends - counts).tolist(), ends.tolist(), strict=True):
            kept = keep[a:b]
            n = int(b - a - kept.sum())
            words = data.split()
            if n:
                left.append(_joined_runs(data, kept))
                words = itertools.compress(words, kept.tolist())
            else:
                left.append(text)
            n_removed.append(n)
            shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
        columns = [pa.array(left, pa.string()) if c == "text" else table.column(c) for c in own]
        return pa.Table.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string())], [*own, *_NEW]).cast(out_schema)

    sketches = carried.groupBy("__pw_chunk").applyInArrow(sketch, "sketch_row int, block long, __pw_chunk long, counters binary, twice binary")
    bits_schema = "__pw_chunk long, sketch_row int, block long, bits binary"
    estimated = sketches.groupBy("sketch_row", "block").applyInArrow(merge, bits_schema)
    found = carried.groupBy("__pw_chunk").cogroup(estimated.groupBy("__pw_chunk")).applyInArrow(candidates, "block long, __pw_chunk long, keys binary, docs binary, late binary")
    exact = found.groupBy("block").applyInArrow(group, bits_schema)
    kinds = dict(carried.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in own) + ", n_words long, n_removed long, kept_sha256 string"
    out_schema = to_arrow_schema(spark.createDataFrame([], schema).schema)
    return carried.groupBy("__pw_chunk").cogroup(estimated.unionByName(exact).groupBy("__pw_chunk")).applyInArrow(remove, schema)


def _table(rows: list[tuple], **kinds: pa.DataType) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


def _joined_runs(data: bytes, kept: np.ndarray) -> str:
    starts, ends = common.word_bounds(np.frombuffer(data, np.uint8))
    step = np.diff(np.concatenate(([0], kept.astype(np.int8), [0])))
    runs = zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)
    return b" ".join(data[starts[a] : ends[b - 1]] for a, b in runs).decode("utf-8", "surrogatepass")
