"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

1. A document's set of word shingles gives a signature of `K` coordinates (fast similarity sketching: a coordinate of
   two signatures is equal with the probability of their Jaccard similarity, and one hash of each shingle fills most).
   Documents with equal sets are one class from here on, told by the digest of the set.
2. Classes are posted under their coordinate-value pairs. Two signatures with at least T equal coordinates share one of
   the K-T+1 rarest pairs of either, in one order of all pairs by frequency. So a class is posted only under those
   (prefix), pairs that nobody shares count towards the prefix but are not posted, and a class whose whole prefix is
   unshared is out: frequent pairs, as of boilerplate, are skipped unless a class has little else.
3. The lists are merged. First each list's most central member meets every other member, and collisions of the whole
   signatures are counted for those pairs: classes with at least T are tied. Then, in lists whose other members are not
   all tied together yet, these are compared across the groups of tied ones. What is tied makes families.
4. Families get their full shingle sets, and links are confirmed on them, from most collisions down, until each family
   is known to be whole or to fall apart.
5. The components of the confirmed links are the result.

Lists and families of more than a block are compared in tasks of two blocks. Of the groups that are tied or linked already
the greatest is never compared with itself, so its members are in one task for each block of the others, and copies are
made of the others only. All that leaves a task is a spanning forest, never all pairs of a group. A list of many classes
that are mostly unrelated costs the square of its length over the block's; the order of the prefix keeps such lists to
classes that have more than T still more frequent coordinates.

With `exact`, classes are posted under their shingles themselves: two sets that are similar enough share one of the rarest
shingles of either, as many as the threshold leaves room for. No link is missed; there are more and longer lists.

T follows from the threshold: it is the greatest number with which a link is missed with a probability under `MISS`.
A threshold so low that even one equal coordinate is missed more often is refused.

Defined results: null text, empty text and text without words have an empty set and are linked with nothing; fewer words
than a shingle are one shingle; very long texts are read whole; rows that share a doc_id are one document, which has all
their links and the size of the greatest set; a null doc_id has a null component and size, links nothing and is kept; an empty table gives no rows; extra columns are carried along unless they are named
n_shingles, component_id or kept, which are replaced.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photowarden.llm import common
from photowarden.llm.components import connected_components

SHINGLE = 4
PERCENT = 80
K = 64
MISS = 1e-5
#: Most members and bytes of a block, and of a bucket of tasks.
MOST, BLOCK_BYTES, BUCKET_BYTES = 2048, 8 << 20, 16 << 20
#: Members of families (40 bytes each) that are sent to all tasks; more of them meet their texts by an exchange of both.
BROADCAST_ROWS = 1 << 18
_U = np.uint64
_SHIFT = _U(58)
_EDGES = np.arange(K, dtype=_U) << _SHIFT


def collisions(percent: int) -> int:
    """T: so many equal coordinates are asked for, of pairs with at least this similarity."""
    p, missed = percent / 100, 0.0
    for t in range(K + 1):  # missed: the probability of fewer than t
        more = missed + math.comb(K, t) * p**t * (1 - p) ** (K - t)
        if more > MISS:
            break
        missed = more
    if not 0 < p <= 1 or t == 0:
        raise ValueError(f"percent = {percent}: {K} coordinates find similarities of 17 to 100 percent only")
    return t


T = collisions(PERCENT)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles of lower-cased words."""
    (words,), counts = common.word_hashes(texts, (0,), lower=True)
    all_runs = common.window_hashes(words, size)
    sets, at = [], 0
    for n in counts.tolist():
        if n >= size:
            sets.append(np.unique(all_runs[at : at + n - size + 1]))
        elif n:
            sets.append(common.window_hashes(words[at : at + n], n))
        else:
            sets.append(np.zeros(0, _U))
        at += n
    return sets


def signature(items: np.ndarray) -> np.ndarray:
    """K coordinate-value pairs of a non-empty sorted set, each hashed to 64 bits.

    Round r hashes every item to one of K bins, and a bin that is still empty takes the least value of the round; after
    K rounds a bin that is still empty takes the least value of a round of its own.
    """
    out = np.zeros(K, _U)
    empty = np.ones(K, bool)
    hashed = items
    for r in range(2 * K):
        if r:
            hashed = np.sort(common.mix(items ^ _U((r * 0x9E3779B97F4A7C15) & (2**64 - 1))))
        if r < K:
            at = np.searchsorted(hashed, _EDGES)
            got = hashed[np.minimum(at, len(hashed) - 1)]
            fill = empty & (at < len(hashed)) & ((got >> _SHIFT) == np.arange(K, dtype=_U))
        else:
            fill = empty & (np.arange(K) == r - K)
            got = np.full(K, hashed[0])
        out[fill] = common.mix(got[fill] + np.flatnonzero(fill).astype(_U) * _U(0xD1342543DE82EF95) + _U(r))
        empty &= ~fill
        if not empty.any():
            break
    return out


def _digest(items: np.ndarray) -> bytes | None:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None


def _short(pairs: np.ndarray) -> bytes:
    """A signature at 16 bits a coordinate: equal coordinates stay equal, so collisions are only overestimated."""
    return pairs.astype(np.uint16).tobytes()


def _signatures(docs: DataFrame, size: int, exact: bool) -> DataFrame:
    def run(batches):
        for batch in common.slices(batches):
            sets = shingle_sets([common.utf8(t) for t in batch.column(1).to_pylist()], size)
            pairs = [s if exact else signature(s) if len(s) else None for s in sets]
            columns = [
                batch.column(0), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([None if p is None else p.view(np.int64) for p in pairs], pa.list_(pa.int64())), pa.array([b"" if exact or p is None else _short(p) for p in pairs], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n", "pairs", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, key binary, n long, pairs array<long>, sig binary")


def overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with others."""
    sizes = np.array([len(o) for o in others])
    joined = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, joined), len(one) - 1)
    hits = np.concatenate(([0], np.cumsum(one[at] == joined)))
    ends = np.cumsum(sizes)
    return hits[ends] - hits[ends - sizes]


def _matrix(sigs: list[bytes]) -> np.ndarray:
    flat = np.frombuffer(b"".join(sigs), np.uint16)
    return flat.reshape(len(sigs), -1 if len(flat) else 0)


def able(sig: np.ndarray, size: np.ndarray, r: int, others: np.ndarray, least: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the others those that can be similar to r by collisions and sizes, from most collisions down, and those."""
    fits = 100 * np.minimum(size[r], size[others]) >= percent * np.maximum(size[r], size[others])
    others = others[fits]
    equal = (sig[others] == sig[r]).sum(1)
    hit = equal >= least
    order = np.argsort(-equal[hit], kind="stable")
    return others[hit][order], equal[hit][order]


def forest(label: np.ndarray, major: np.ndarray, across: bool, partners) -> list[tuple[int, int]]:
    """Pairs (of row numbers) that join the labels as far as `partners` allows.

    partners(r, others): of the others, all with other labels than r's, those that are its partners, in any order; it may
    stop after some, if it is told of them again. Rows of the greatest group come last and are met by the others only.
    across: only pairs of which one is of the greatest group.
    """
    label = np.unique(label, return_inverse=True)[1]
    links = []
    for r in np.flatnonzero(~major).tolist():
        others = major if across else (np.arange(len(label)) > r) | major
        todo = np.flatnonzero(others & (label != label[r]))
        for x in partners(r, todo, label):
            if label[x] != label[r]:
                label[label == label[x]] = label[r]
                links.append((r, x))
    return links


def related(sig: np.ndarray, size: np.ndarray, label: np.ndarray, major: np.ndarray, across: bool, least: int, percent: int) -> list[tuple[int, int]]:
    """A forest of the pairs with enough collisions."""
    return forest(label, major, across, lambda r, todo, _: able(sig, size, r, todo, least, percent)[0].tolist())


def linked(sets: list[np.ndarray], sig: np.ndarray, label: np.ndarray, major: np.ndarray, across: bool, least: int, percent: int) -> list[tuple[int, int]]:
    """A forest of the pairs whose full sets are similar; rows of one tree are not compared again."""
    size = np.array([len(s) for s in sets])

    def partners(r, todo, label):
        todo, _ = able(sig, size, r, todo, least, percent)
        step = 64
        while len(todo := todo[label[todo] != label[r]]):
            now, todo = todo[:step], todo[step:]
            shared = overlaps(sets[r], [sets[x] for x in now.tolist()])
            yield from now[100 * shared >= percent * (size[r] + size[now] - shared)].tolist()

    return forest(label, major, across, partners)


def _tasks(members: DataFrame, group: str) -> DataFrame:
    """key and task of every member (group, key, label, bytes) of a group of several labels, with whether it is of the
    greatest label (major) and whether only pairs of a major and another are asked for (across)."""
    counts = members.groupBy(group, "label").agg(F.count("*").alias("c"), F.sum("bytes").alias("b"))
    top = F.max(F.struct("c", "label", "b"))
    shape = counts.groupBy(group).agg(top.alias("top"), F.sum("c").alias("c"), F.sum("b").alias("b"), F.count("*").alias("k")).filter("k > 1")
    blocks = lambda c, b: F.greatest(F.ceil(c / MOST), F.ceil(b / BLOCK_BYTES), F.lit(1)).cast("int")
    shape = shape.select(
        group, F.col("top.label").alias("top"), blocks(F.col("c"), F.col("b")).alias("n_all"), blocks(F.col("top.c"), F.col("top.b")).alias("n_top"),
        blocks(F.col("c") - F.col("top.c"), F.col("b") - F.col("top.b")).alias("n_rest"),
    )
    lot = F.xxhash64("key")
    mine = F.pmod(lot, F.when(F.col("major"), F.col("n_top")).otherwise(F.col("n_rest"))).cast("int")
    task = lambda i, j, across: F.struct(i.alias("i"), j.alias("j"), across.alias("across"))
    others = lambda n: F.sequence(F.lit(0), n - 1)
    placed = members.join(shape, group).withColumn("major", F.col("label") == F.col("top")).withColumn("mine", mine)
    with_top = F.when(F.col("major"), F.transform(others(F.col("n_rest")), lambda j: task(F.col("mine"), j, F.lit(True))))
    with_top = with_top.otherwise(F.transform(others(F.col("n_top")), lambda i: task(i, F.col("mine"), F.lit(True))))
    with_rest = F.transform(others(F.col("n_rest")), lambda o: task(-1 - F.least("mine", o), F.greatest("mine", o), F.lit(False)))
    many = F.when(F.col("major"), with_top).otherwise(F.concat(with_top, with_rest))
    all_in_one = F.array(task(F.lit(0), F.lit(0), F.lit(False)))
    rows = placed.select(group, "key", "label", "major", F.explode(F.when(F.col("n_all") == 1, all_in_one).otherwise(many)).alias("t"))
    return rows.select(F.hash(group, "t.i", "t.j").alias("lot"), F.struct(group, "t.i", "t.j").alias("task"), "key", "label", "major", "t.across")


def _compare(rows: DataFrame, bucket_rows: int, least: int, percent: int, full: bool) -> DataFrame:
    """Pairs of labels that each task joins. rows: those of _tasks with sig, n and, for full sets, items."""
    buckets = max(1, -(-bucket_rows // BUCKET_BYTES))
    columns = ["task", "key", "label", "major", "across", "sig", "n"] + ["items"] * full
    dealt = rows.select(F.pmod("lot", F.lit(buckets)).alias("bucket"), F.to_json("task").alias("task"), *columns[1:])

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("task", "ascending"), ("key", "ascending")]))
        task, keys, labels = (table.column(c).to_pylist() for c in ("task", "key", "label"))
        major, across, size = (table.column(c).to_numpy() for c in ("major", "across", "n"))
        sigs = table.column("sig").to_pylist()
        items = table.column("items") if full else None
        found: list[tuple[bytes, bytes]] = []
        at = 0
        while at < len(task):
            end = at
            while end < len(task) and task[end] == task[at]:
                end += 1
            rows = [k for k in range(at, end) if k == at or keys[k] != keys[k - 1]]
            if len({labels[k] for k in rows}) > 1:
                label, some = np.unique([labels[k].hex() for k in rows], return_inverse=True)[1], np.array(rows)
                args = (_matrix([sigs[k] for k in rows]), *([] if full else [size[some]]), label, major[some], bool(across[at]), least, percent)
                pairs = linked([np.frombuffer(items[k].as_py(), _U) for k in rows], *args) if full else related(*args)
                found += [(labels[rows[a]], labels[rows[b]]) for a, b in pairs]
            at = end
        return pa.Table.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    return dealt.groupBy("bucket").applyInArrow(run, "a binary, b binary")


def _tied(edges: DataFrame, nodes: DataFrame, least: int, percent: int) -> DataFrame:
    """Of the pairs (leader, key) those with enough collisions."""
    one = nodes.select(F.col("key").alias("leader"), F.col("n").alias("m"), F.col("sig").alias("sig_l"))
    pairs = edges.join(one, "leader").join(nodes.select("key", "n", "sig"), "key")
    pairs = pairs.filter(100 * F.least("m", "n") >= percent * F.greatest("m", "n")).select("leader", "key", "sig_l", "sig")

    def run(batches):
        for batch in common.slices(batches, 8192):
            equal = (_matrix(batch.column(2).to_pylist()) == _matrix(batch.column(3).to_pylist())).sum(1)
            kept = batch.filter(pa.array(equal >= least))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    return pairs.mapInArrow(run, "a binary, b binary")


def _labelled(keys: DataFrame, components: DataFrame, column: str) -> DataFrame:
    """keys with the component of `column` in its place, or itself."""
    named = components.select(F.col("node").alias(column), F.col("component").alias("__pw_to"))
    return keys.join(named, column, "left").withColumn(column, F.coalesce("__pw_to", column)).drop("__pw_to")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, exact: bool = False) -> DataFrame:
    """Adds n_shingles, component_id (the smallest doc_id reachable by links) and kept (it is the document's own)."""
    least = collisions(percent)
    spark = docs.sparkSession
    common.prepare(spark)
    scratch = common.Scratch(spark)
    own = [c for c in docs.columns if c not in ("n_shingles", "component_id", "kept")]
    signed = scratch.written(_signatures(docs, size, exact), "signatures")
    usable = signed.filter("key is not null and doc_id is not null")
    if exact:
        least, posts, prefix = 0, F.col("n"), F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    else:
        posts, prefix = F.lit(K), F.lit(K - least + 1)

    # classes of equal sets, and their pairs that more than one class has
    classes = scratch.written(usable.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n")), "classes")
    reps = usable.join(classes.select("key", F.col("rep").alias("doc_id")), ["key", "doc_id"])
    nodes = scratch.written(reps.groupBy("key").agg(F.max("n").alias("n"), F.max("sig").alias("sig")), "nodes")
    posted = scratch.written(reps.select("key", F.explode("pairs").alias("pair")), "pairs")
    shared = scratch.written(posted.groupBy("pair").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    by_key = posted.join(shared, "pair").groupBy("key").agg(F.sort_array(F.collect_set(F.struct("df", "pair"))).alias("p"))
    by_key = by_key.join(nodes.select("key", "n"), "key") if exact else by_key
    prefixes = by_key.withColumn("room", (prefix - (posts - F.size("p"))).cast("int")).filter("room > 0").select(
        "key", F.explode(F.slice("p", F.lit(1), F.col("room"))["pair"]).alias("pair"), F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["df"]).alias("weight"),
    )
    lists = scratch.written(prefixes, "lists")
    scratch.keep("signatures", "classes", "nodes", "lists")

    # merging: each list's most central member with all others, then the others across what is tied
    leaders = scratch.written(lists.groupBy("pair").agg(F.max(F.struct("weight", "key"))["key"].alias("leader"), F.count("*").alias("n")).filter("n > 1"), "leaders")
    met = lists.select("pair", "key").join(leaders, "pair").filter("leader <> key")
    edges = met.groupBy("leader", "key").agg(F.count("*").alias("lists")).select("leader", "key")
    tied = connected_components(_tied(edges, nodes, least, percent), "a", "b", scratch, "tied")
    rest = _labelled(met.filter("n > 2").select("pair", "key", F.col("key").alias("label")), tied, "label")
    tasks = scratch.written(_tasks(rest.withColumn("bytes", F.lit(K * 2)), "pair"), "tasks")
    n_rows = tasks.count()
    more = _compare(tasks.join(nodes, "key"), n_rows * 1024, least, percent, full=False)
    merged = connected_components(more.groupBy("a", "b").agg(F.count("*").alias("n")), "a", "b", scratch, "merged")
    family = _labelled(_labelled(classes.select("key", "rep", F.col("key").alias("family")), tied, "family"), merged, "family")
    family = scratch.written(family, "family")
    several = family.groupBy("family").agg(F.count("*").alias("members")).filter("members > 1")
    wanted = scratch.written(family.join(several, "family").select("key", F.col("rep").alias("doc_id"), "family"), "wanted")
    scratch.keep("signatures", "classes", "wanted")

    # full sets of the families
    def full(batches):
        for batch in common.slices(batches):
            sets = shingle_sets([common.utf8(t) for t in batch.column("text").to_pylist()], size)
            right = [k for k, (s, key) in enumerate(zip(sets, batch.column("key").to_pylist(), strict=True)) if _digest(s) == key]  # rows of a repeated id
            sets = [sets[k] for k in right]
            kept = batch.take(pa.array(right, pa.int64()))
            columns = [kept.column("key"), kept.column("family"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([b"" if exact else _short(signature(s)) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "family", "n", "items", "sig"])

    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # then the texts stay where they are
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(wanted) if few else wanted, "doc_id").select("key", "family", "text")
    sets = scratch.written(texts.mapInArrow(full, "key binary, family binary, n long, items binary, sig binary"), "sets")

    # links: in families of more than a block the greatest set meets all others first, then all across what is linked
    sized = sets.select("family", "key", F.col("key").alias("label"), (F.col("n") * 8 + 2 * K).alias("bytes"))
    large = sized.groupBy("family").agg(F.count("*").alias("c"), F.sum("bytes").alias("b")).filter((F.col("c") > MOST) | (F.col("b") > BLOCK_BYTES)).select("family")
    hubs = _hub_links(sets.join(large, "family"), percent)
    stars = connected_components(hubs, "a", "b", scratch, "stars")
    tasks = scratch.written(_tasks(_labelled(sized, stars, "label"), "family"), "links_of")
    held = tasks.join(sets.select("key", "n", "items", "sig"), "key")
    n_bytes = tasks.join(sized.select("key", "bytes"), "key").agg(F.sum("bytes")).first()[0] or 0
    links = _compare(held, n_bytes, least, percent, full=True)

    # rows that share an id link their classes
    repeated = usable.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("z")).filter("a <> z").select("doc_id", "a")
    same = _labelled(_labelled(usable.join(repeated, "doc_id").select("a", F.col("key").alias("b")), stars, "a"), stars, "b")
    every = links.unionByName(same).groupBy("a", "b").agg(F.count("*").alias("n"))
    whole = connected_components(every, "a", "b", scratch, "whole")
    by_class = _labelled(_labelled(classes.select("key", "rep", F.col("key").alias("root")), stars, "root"), whole, "root")
    by_class = scratch.written(by_class, "by_class")
    least_id = by_class.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_class = by_class.join(least_id, "root").select("key", "component_id")
    verdict = signed.filter("doc_id is not null").select("doc_id", "key", "n").join(by_class, "key", "left")
    verdict = verdict.groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min("component_id").alias("component_id"))
    verdict = scratch.written(verdict.withColumn("component_id", F.coalesce("component_id", "doc_id")), "verdict")
    scratch.keep("verdict")
    joined = docs.filter("doc_id is not null").select(*(F.col(f"`{c}`") for c in own)).withColumn("__pw_id", F.col("doc_id").cast("long")).join(verdict.withColumnRenamed("doc_id", "__pw_id"), "__pw_id", "left")
    joined = joined.withColumn("kept", F.coalesce(F.col("__pw_id") == F.col("component_id"), F.lit(True))).drop("__pw_id")
    return joined.unionByName(_unlinked(docs.filter("doc_id is null").select(*(F.col(f"`{c}`") for c in own)), size))


def _unlinked(rows: DataFrame, size: int) -> DataFrame:
    """Rows without an id: their set's size, no component, and they stay."""

    def run(batches):
        for batch in common.slices(batches):
            n = [len(s) for s in shingle_sets([common.utf8(t) for t in batch.column(batch.num_columns - 1).to_pylist()], size)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*batch.schema.names[:-1], "n_shingles"])

    kinds = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes)
    sized = rows.withColumn("__pw_text", F.col("text").cast("string")).mapInArrow(run, f"{kinds}, n_shingles long")
    return sized.withColumn("component_id", F.lit(None).cast("long")).withColumn("kept", F.lit(True))


def _hub_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links of each family's member with the greatest set to others."""
    hub = sets.groupBy("family").agg(F.max(F.struct("n", "key")).alias("h")).select("family", F.col("h.key").alias("hub"))
    hub = sets.select("key", F.col("items").alias("hub_items")).join(hub, F.col("key") == F.col("hub")).select("family", "hub", "hub_items")
    pairs = sets.join(hub, "family").filter("hub <> key").select("hub", "key", "hub_items", "items")

    def run(batches):
        for batch in common.slices(batches, 64):
            found = []
            for a, b, one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, two = np.frombuffer(one, _U), np.frombuffer(two, _U)
                shared = int(overlaps(one, [two])[0])
                if 100 * shared >= percent * (len(one) + len(two) - shared):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    return pairs.mapInArrow(run, "a binary, b binary")
