"""Phrase collocations: n-gram counts from word-id suffix arrays of shards, merged by key, and exact scores.

1. A task turns its documents into shards: the words' ids in a dictionary of the shard, pieces apart by id 0, languages
   apart in the dictionary. A shard is written once.
2. A shard's suffix array is sorted by prefix doubling (ranks of 1, 2, 4 and then 5 words) in numpy. The common prefix of
   neighbours follows from the same ranks. A run of suffixes with m words in common is an m-gram, its length the count.
3. Bigrams are sent first, as sorted 64-bit hashes with counts, to blocks of hashes. A block adds them up over all shards
   and tells each shard by one bit a bigram whether the sum reaches the least count. Where hashes collide too many are let
   through, never too few.
4. A phrase reaches the count only if all its bigrams do. A second pass sends the words and those phrases of two to five
   words, with their counts, as texts; they are added up by language and text. So every count is exact.
5. Cuts, containment and ranks are joins and windows over phrases that reach the count. Products are decimals of 38
   digits. A language's first phrases are chosen in lots by hash before they meet.

A word or phrase is sent once a shard, however often it occurs there, and shards are dealt by input order, so a hot
language or a hot phrase loads no task.

Defined results: a null text has no words; a null language is `und`; repeated rows count each; a document longer than a
shard is cut into several at ends of pieces, and only a piece longer than a shard is held whole; ids play no part; phrases
of equal score and count are ordered by their bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from photowarden.llm import common
from photowarden.llm.substring import _by_block, _pack, _pack_sorted, _table, _unpack, _unpack_sorted

MOST_WORDS, LEAST_COUNT, TOP = 5, 100, 2000
SHARD_BYTES = 4 << 20
#: Bigrams of a block: from here, with the root of the input, up to the second figure; there are at least 2^LEAST_BITS blocks.
BLOCK_KEYS, BLOCK_KEYS_MOST, LEAST_BITS = 1 << 18, 1 << 24, 8
#: Lots in which a language's phrases are ranked first.
LOTS = 64
_U = np.uint64
_SEPARATORS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.int8)
_KIND[list(_BLANKS)], _KIND[list(_SEPARATORS)] = 1, 2
_SHARD = "shard long, n_words long, langs array<string>, firsts array<int>, lang_words array<long>, ids binary, words binary, ends binary"


# ---- shards ----------------------------------------------------------------------------------------------------------


def _parts(text: bytes, most: int):
    """A text in parts of at least `most` bytes, cut at separators."""
    at = 0
    while len(text) - at > most:
        cut = min((c for c in (text.find(s, at + most) for s in (bytes([b]) for b in _SEPARATORS)) if c >= 0), default=-1)
        if cut < 0:
            break
        yield text[at : cut + 1]
        at = cut + 1
    yield text[at:]


def encode(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """Word ids from 1 on, 0 between pieces (and behind the last), and the different words; lower case of A-Z."""
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    kind = _KIND[data]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = kind == 0
    step = np.diff(inside)
    starts = np.flatnonzero(step == 1)
    ends = np.flatnonzero(step == -1) if len(starts) else starts
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.binary())
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    letters = data[kind == 0].tobytes()
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]  # the last byte before a word is never inside it
    new = np.flatnonzero(np.diff(piece)) + 1
    ids = np.insert(words.indices.to_numpy().astype(np.int64) + 1, new, 0)
    return np.append(ids, 0), words.dictionary.cast(pa.binary())


def _shard_row(number: int, held: dict[str, list[bytes]]) -> tuple:
    parts, words, langs, firsts, counts, first = [], [], [], [], [], 0
    for lang, texts in sorted(held.items()):
        ids, found = encode(texts)
        if len(found):
            langs.append(lang)
            firsts.append(first)
            counts.append(int((ids > 0).sum()))
            parts.append(np.where(ids > 0, ids + first, 0))
            words.append(found)
            first += len(found)
    words = pa.concat_arrays(words) if words else pa.array([], pa.binary())
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False)).astype("<u4")
    return number, sum(counts), langs, firsts, counts, ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : _width(first)].tobytes(), b"".join(words.to_pylist()), ends.tobytes()


def _width(most: int) -> int:
    """Bytes of an id."""
    return max(1, -(-int(most).bit_length() // 8))


def shards_of(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows of _SHARD: a shard's words in order, ids in as few bytes as its dictionary needs."""

    def build(batches):
        number, held, size = (TaskContext.get().partitionId() << 32), {}, 0

        def row():
            nonlocal number, size
            values = _shard_row(number, held)
            number, size = number + 1, 0
            held.clear()
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            names = [c.split()[0] for c in _SHARD.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in common.slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in _parts(common.utf8(text), shard_bytes):
                    held.setdefault(lang, []).append(part)
                    size += len(part) + 1
                    if size >= shard_bytes:
                        yield row()
        if held:
            yield row()

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.col("text").cast("string")).mapInArrow(build, _SHARD)


# ---- suffix arrays ---------------------------------------------------------------------------------------------------


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys and each one's dense rank from 1."""
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(len(key), bool)
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:])
    rank = np.empty(len(key), np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32)
    return order.astype(np.int32), rank


def _behind(rank: np.ndarray, k: int, room: np.ndarray) -> np.ndarray:
    """The rank k words on, 0 beyond the piece's end."""
    out = np.zeros(len(rank), np.int64)
    out[:-k] = rank[k:]
    out[room <= k] = 0
    return out


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of all words in the order of the five words from there on, how many of them each has in common with the
    position before it, and how many words its piece still has (five at most). `ids` ends with 0."""
    ends = np.flatnonzero(ids == 0)
    at = np.flatnonzero(ids)
    if not len(at):
        return at, at, at
    lengths = np.diff(ends, prepend=-1)  # of pieces with their end
    room = np.minimum(np.repeat(ends, lengths) - np.arange(len(ids)), MOST_WORDS).astype(np.int8)
    ranks = {1: ids}
    for k, more in ((1, 1), (2, 2), (4, 1)):
        key = _behind(ranks[more], k, room)
        key += ranks[k].astype(np.int64) * (int(ranks[more].max()) + 1)
        key[ids == 0] = 0
        order, ranks[k + more] = _dense(key)
    del key
    order = order[len(ids) - len(at) :]  # separators come first
    last, this = order[:-1], order[1:]
    third = _behind(ids, 2, room)
    same = np.zeros(len(order), np.int8)
    alike = [ids[this] == ids[last], ranks[2][this] == ranks[2][last]]
    alike += [alike[1] & (third[this] == third[last]), ranks[4][this] == ranks[4][last], ranks[5][this] == ranks[5][last]]
    same[1:] = np.minimum(sum(x.astype(np.int8) for x in alike), np.minimum(room[this], room[last]))
    return order, same, room[order]


def intervals(order: np.ndarray, same: np.ndarray, room: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """A position of each different m-gram and how often it occurs."""
    begin = np.flatnonzero(same < m)
    count = np.diff(np.append(begin, len(order)))
    there = room[begin] >= m
    return order[begin[there]], count[there]


class Shard:
    """A shard read back, with its suffix array."""

    def __init__(self, row: dict):
        ends = np.frombuffer(row["ends"], "<u4").astype(np.int64)
        self.words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(row["words"])])
        self.langs, self.firsts, self.number = row["langs"], np.array(row["firsts"], np.int64), row["shard"]
        wide = _width(len(ends))
        raw = np.zeros((len(row["ids"]) // wide, 4), np.uint8)
        raw[:, :wide] = np.frombuffer(row["ids"], np.uint8).reshape(-1, wide)
        self.ids = raw.view("<i4").ravel()
        self.order, self.same, self.room = suffix_array(self.ids)

    def lang_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, self.ids[at] - 1, side="right") - 1

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash (of language and both words), position and count of each different bigram, in order of hash."""
        at, count = intervals(self.order, self.same, self.room, 2)
        (h,), _ = common.word_hashes([b"\n".join(self.words.to_pylist())], (0,))
        lang = np.array([_text_hash(x) for x in self.langs], _U)[self.lang_of(at)] if len(at) else np.zeros(0, _U)
        key = common.mix(common.mix(h[self.ids[at] - 1] ^ lang) + h[self.ids[at + 1] - 1])
        by = np.argsort(key, kind="stable")
        return key[by], at[by], count[by]

    def phrases(self, good: np.ndarray) -> pa.Table:
        """lang, phrase, words and count of each different word, and of each phrase whose bigrams are good; good: one
        flag for each bigram in the order of bigrams()."""
        _, at, count = self.bigrams()
        flag = np.zeros(len(self.ids) + MOST_WORDS, bool)
        begin, sizes = intervals(self.order, self.same, self.room, 2)
        by_place = np.zeros(len(self.ids), bool)
        by_place[at] = good
        runs = self.order[(self.room >= 2)]
        flag[runs] = np.repeat(by_place[begin], sizes)
        columns: dict[str, list] = {"lang": [], "phrase": [], "words": [], "n": []}
        langs = pa.array(self.langs, pa.string())
        for m in range(1, MOST_WORDS + 1):
            at, count = intervals(self.order, self.same, self.room, m)
            keep = np.ones(len(at), bool)
            for k in range(m - 1):
                keep &= flag[at + k]
            at, count = at[keep], count[keep]
            parts = [self.words.take(pa.array(self.ids[at + k] - 1)) for k in range(m)]
            text = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if m > 1 else parts[0]
            columns["lang"].append(langs.take(pa.array(self.lang_of(at))))
            columns["phrase"].append(text.cast(pa.large_string()).cast(pa.string()))
            columns["words"].append(pa.array(np.full(len(at), m), pa.int32()))
            columns["n"].append(pa.array(count, pa.int64()))
        return pa.table({c: pa.chunked_array(v) for c, v in columns.items()})


def _text_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(common.utf8(text), digest_size=8).digest(), "little")


# ---- counts over all shards ------------------------------------------------------------------------------------------


def count_phrases(docs: DataFrame, least: int = LEAST_COUNT, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, words, f of all words and phrases of at most five words with f >= least; lang and n, all words."""
    spark = docs.sparkSession
    common.prepare(spark)
    scratch = common.Scratch(spark)
    shards = scratch.written(shards_of(docs, shard_bytes), "shards")
    total = shards.agg(F.sum("n_words")).first()[0] or 0
    keys = min(BLOCK_KEYS_MOST, max(BLOCK_KEYS, 32 * math.isqrt(total)))
    bits = max(LEAST_BITS, (total // keys).bit_length())

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                key, _, count = shard.bigrams()
                rows = [(b, shard.number, _pack_sorted((key[part] & _U((1 << 64 - bits) - 1)).astype(np.int64)), _pack(count[part])) for b, part in _by_block((key >> _U(64 - bits)).astype(np.int64))]
                yield from _table(rows, block=pa.int64(), shard=pa.int64(), keys=pa.binary(), counts=pa.binary()).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        held = [_unpack_sorted(k) for k in table.column("keys").to_pylist()]
        key, count = np.concatenate(held), np.concatenate([_unpack(c) for c in table.column("counts").to_pylist()])
        order = np.argsort(key, kind="stable")
        begin = np.flatnonzero(np.diff(key[order], prepend=-1))
        enough = np.empty(len(key), bool)
        enough[order] = np.repeat(np.add.reduceat(count[order], begin) >= least, np.diff(np.append(begin, len(key))))
        ends = np.cumsum([len(k) for k in held])
        said = [np.packbits(enough[a:b]).tobytes() for a, b in zip(ends - [len(k) for k in held], ends, strict=True)]
        return pa.Table.from_arrays([table.column("shard"), table.column("block"), pa.array(said, pa.binary())], ["shard", "block", "bits"])

    def answer(rows: pa.Table, masks: pa.Table) -> pa.Table:
        found = []
        said = dict(zip(masks.column("block").to_pylist(), masks.column("bits").to_pylist(), strict=True))
        for row in rows.to_pylist():
            shard = Shard(row)
            block = (shard.bigrams()[0] >> _U(64 - bits)).astype(np.int64)
            good = np.zeros(len(block), bool)
            for b, part in _by_block(block):
                good[part] = np.unpackbits(np.frombuffer(said[b], np.uint8), count=part.stop - part.start).astype(bool)
            found.append(shard.phrases(good))
        return pa.concat_tables(found) if found else pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())]).empty_table()

    sent = shards.mapInArrow(send, "block long, shard long, keys binary, counts binary")
    masks = sent.groupBy("block").applyInArrow(merge, "shard long, block long, bits binary")
    found = shards.groupBy("shard").cogroup(masks.groupBy("shard")).applyInArrow(answer, "lang string, phrase string, words int, n long")
    counts = found.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.sum("n").alias("f")).filter(F.col("f") >= least)
    counts = scratch.written(counts, "counts")
    by_lang = shards.select(F.explode(F.arrays_zip("langs", "lang_words")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.lang_words").alias("n"))
    by_lang = scratch.written(by_lang, "words-by-lang")
    scratch.keep("counts", "words-by-lang")
    return counts, by_lang


# ---- scores ----------------------------------------------------------------------------------------------------------


def _exact(name: str):
    return F.col(name).cast("decimal(19,0)")


def score_phrases(counts: DataFrame, by_lang: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases that no phrase of the same count contains."""
    longer = counts.filter("words > 2").withColumn("w", F.split("phrase", " ", -1))
    inner = longer.select("lang", "f", F.explode(F.array(F.array_join(F.slice("w", F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.col("words") - 1), " "))).alias("phrase"))
    # what a longer phrase of the same count contains is contained, as often, in one of one word more
    holder = inner.groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    kept = counts.filter("words > 1").join(holder, ["lang", "phrase"], "left").filter("_longer is null or _longer < f")
    w = F.split("phrase", " ", -1)
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), w.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("_first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("_rest"))
    first = counts.select("lang", F.col("phrase").alias("_first"), F.col("f").alias("l"))
    rest = counts.select("lang", F.col("phrase").alias("_rest"), F.col("f").alias("r"))
    met = cuts.join(first, ["lang", "_first"]).join(rest, ["lang", "_rest"]).join(by_lang, "lang")
    met = met.withColumns({c: _exact(c) for c in ("a", "l", "r", "n")}).withColumn("score", F.expr("(cast(1000 as decimal(4,0)) * a * n) div (l * r)"))
    best = met.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("n").alias("n"))
    return best.select("lang", "phrase", *(F.col(c).cast("long").alias(c) for c in ("a",)), F.col("cut.l").cast("long").alias("l"), F.col("cut.r").cast("long").alias("r"), F.col("n").cast("long").alias("n"), F.col("cut.score").alias("score"))


def mine_phrases(docs: DataFrame, least: int = LEAST_COUNT, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Each language's first phrases: lang, rank, phrase, a, l, r, n, score."""
    scored = score_phrases(*count_phrases(docs, least, shard_bytes)).withColumn("_lot", common.spread("phrase", LOTS))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = scored.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_lot").orderBy(*order))).filter(F.col("_rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
