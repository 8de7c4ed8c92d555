"""Each operator against a brute-force version, a round trip or held-out accuracy, and on awkward tables."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from photowarden.llm import catalog, chat, common, components, langid, mainblocks, media, mixing, neardup, packing, sharding, substring, topk
from tests.conftest import duck, rows_of
from tests.llm.layouts import LAYOUTS

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables(spark, sf):
    return {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "pages", "conversations", "embeddings")}


def awkward(spark):
    """Nulls, empty, white space, very long, ties, repeated rows, clashing extra columns."""
    base = " ".join(f"word{k}" for k in range(60))
    near = base.replace("word5 ", "other ")
    rows = [
        (1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None), (4, base, "en", "a"), (4, base, "en", "a"), (5, near, "en", "b"), (6, base.upper(), "de", "a"),
        (7, " ".join(["repeat this passage"] * 3000), "en", "a"), (None, "no id here at all, none", "fr", "c"), (8, "one two", "en", "a"), (9, "one two", "en", "a"), (10, "123 456 !!!", "en", "a"), (11, "x" * 70_000, "es", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = {c: F.lit(7) for c in ("shard", "slot", "kept", "n_words", "topic", "probability", "score", "component_id", "sequence_id", "block", "_old", "_chunk", "_id", "_p", "rep")}
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumns(clash)


def empty(spark):
    return awkward(spark).filter("false")


# ---- sharding --------------------------------------------------------------------------------------------------------


def test_flow_is_cheapest():
    rng = np.random.default_rng(0)
    for _ in range(30):
        old = rng.integers(0, 40, 5)
        cap = np.array(sharding.even_capacities(int(old.sum()), 7))
        cost = (np.arange(5)[:, None] != np.arange(7)).astype(float)
        flow = sharding.min_cost_flow(old, cap, cost)
        assert (flow.sum(1) == old).all() and (flow.sum(0) == cap).all()
        assert (flow * cost).sum() == np.maximum(old - cap[:5], 0).sum()  # what no shard can keep


def test_flow_with_a_cost_matrix():
    flow = sharding.min_cost_flow(np.array([4, 4]), np.array([4, 4]), np.array([[5.0, 1.0], [1.0, 5.0]]))
    assert flow.tolist() == [[0, 4], [4, 0]]


def test_reshard(spark, tables, tmp_path):
    docs = tables["documents"]
    rows, plan = sharding.reshard(docs, F.pmod(F.crc32("source"), F.lit(6)), 8, str(tmp_path / "s"))
    got = rows.toPandas()
    assert sorted(got.doc_id) == sorted(docs.toPandas().doc_id) and list(rows.columns) == [*docs.columns, "shard", "slot"]
    size = got.text.map(lambda t: len(t.encode()) + 16)
    loads = size.groupby(got.shard).sum()
    assert len(loads) == 8 and (loads - loads.mean()).abs().max() <= 2 * size.max()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert plan.moved_bytes == sum(max(0, b - (plan.capacities[i] if i < 8 else 0)) for i, b in plan.old_bytes.items())


def test_reshard_awkward(spark, tmp_path):
    rows, _ = sharding.reshard(awkward(spark), F.lit(0), 3, str(tmp_path / "s"))
    got = rows.toPandas()
    assert len(got) == 13 and set(got.shard) <= {0, 1, 2} and "_old" in got and set(got["_old"]) == {7}
    none, _ = sharding.reshard(empty(spark), F.lit(0), 3, str(tmp_path / "e"))
    assert none.count() == 0


def test_sharding_query(spark, sf, tables):
    """op1's rows against sizes, checksums, places and shares counted plainly, and the least possible move."""
    got = catalog.QUERIES["op1_sharding"](spark, sf).toPandas()
    want = {r["doc_id"]: (len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in tables["documents"].collect()}
    assert len(got) == len(want) and {r.doc_id: (r["size"], r.text_crc32) for _, r in got.iterrows()} == want
    assert set(got.law) == {"bytes"} and set(got.shard) == set(range(catalog.N_SHARDS)) and got.grown_shard.isna().all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    loads = got.groupby("shard")["size"].sum()
    assert (loads - loads.mean()).abs().max() <= got["size"].max()


def test_null_shard_keys(spark, tmp_path):
    """Rows without a shard key are in an old shard of their own; none is lost."""
    df = spark.createDataFrame([(k if k % 3 else None, "x" * (k % 7), None if k % 2 else k % 4) for k in range(60)], "doc_id long, text string, s int")
    rows, plan = sharding.reshard(df, F.col("s"), 4, str(tmp_path / "s"))
    got = rows.toPandas()
    assert len(got) == 60 and plan.old_bytes[sharding.NO_SHARD] == sum(16 + k % 7 for k in range(1, 60, 2))
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    every, _ = sharding.reshard(df, F.lit(None).cast("int"), 2, str(tmp_path / "n"))
    assert every.count() == 60


def test_unaffected_shard_is_not_written(spark, tmp_path):
    df = spark.createDataFrame([(k, "x" * 84, k % 2) for k in range(8)], "doc_id long, text string, s int")
    rows, plan = sharding.reshard(df, F.col("s"), 2, str(tmp_path / "s"))
    assert plan.moved_bytes == 0 and plan.affected == [] and rows.count() == 8


# ---- mixing ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, sf, name):
    assert rows_of(catalog.QUERIES[name](spark, sf).toPandas()) == rows_of(duck(sf).sql(catalog.ORACLES[name]).df())


def test_rake_goes_on_until_margins_are_met(spark):
    """Few rounds at a time reach the residual; cells that can't meet their targets end the raking; the residual is told."""
    cells = spark.createDataFrame([("a", "x", 50.0), ("a", "y", 0.5), ("b", "x", 0.5), ("b", "y", 10.0), ("c", "y", 4.0)], "s string, l string, w0 double")
    aims = {"s": spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "s string, target double"), "l": spark.createDataFrame([("x", 1.0), ("y", 2.0)], "l string, target double")}
    once = mixing.residual(mixing._rounds(mixing._aimed(cells, aims), ["s", "l"], 1), ["s", "l"])
    raked, left = mixing.rake_until(cells, aims, rounds=1, most=1e-6)
    got = raked.toPandas()
    assert once > 1e-4 >= 1e-6 >= left
    assert got.groupby("s").raked.sum().tolist() == pytest.approx([65 / 3] * 3, abs=1e-3) and got.groupby("l").raked.sum().tolist() == pytest.approx([65 / 3, 130 / 3], abs=1e-3)
    apart = spark.createDataFrame([("a", "x", 3.0), ("b", "y", 1.0)], "s string, l string, w0 double")
    aims = {"s": spark.createDataFrame([("a", 1.0), ("b", 1.0)], "s string, target double"), "l": spark.createDataFrame([("x", 3.0), ("y", 1.0)], "l string, target double")}
    assert mixing.rake_until(apart, aims)[1] == pytest.approx(0.25)
    assert mixing.rake_until(apart.limit(0), aims)[1] == 0.0
    docs = spark.createDataFrame([(1, "a", "x", 3, 9.0), (2, "b", "y", 1, 9.0)], "doc_id long, s string, l string, tokens long, residual double")
    assert {r.residual for r in mixing.mix_to_targets(docs, aims).collect()} == {0.25}


def test_rake_meets_margins(spark):
    cells = spark.createDataFrame([("a", "x", 10.0), ("a", "y", 20.0), ("b", "x", 30.0), ("b", "y", 5.0)], "s string, l string, w0 double")
    t = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "s string, target double")
    got = mixing.rake(cells, {"s": t, "l": 1.0}, rounds=60).toPandas()
    assert got.groupby("s").raked.sum().to_dict() == pytest.approx({"a": 32.5, "b": 32.5})
    assert got.groupby("l").raked.sum().to_dict() == pytest.approx({"x": 40, "y": 25})


def test_mixing_awkward(spark):
    df = awkward(spark).withColumns({"topic": mixing.text_topic(), "tokens": mixing.count_tokens()})
    assert 0 < mixing.mix_to_targets(df, catalog.MIX_TARGETS).count() <= 13
    assert mixing.mix_to_targets(df.filter("false"), catalog.MIX_TARGETS).count() == 0
    assert mixing.mix_to_targets(df.filter("tokens = 0"), catalog.MIX_TARGETS).count() == 0


@pytest.mark.parametrize("total", [None, 5000.0])
def test_many_cells_are_joined_with_salt(spark, monkeypatch, total):
    """Beyond the bound of a broadcast the same documents are sampled, hot cell or not."""
    rows = [(k, "hot" if k % 3 else f"s{k}", "en", "prose", 10 + k % 7) for k in range(900)] + [(None, None, None, "prose", 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens long")
    want = rows_of(mixing.mix_to_targets(df, catalog.MIX_TARGETS, total=total).toPandas())
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    got = mixing.mix_to_targets(df, catalog.MIX_TARGETS, total=total)
    assert rows_of(got.toPandas()) == want and 0 < len(want)


def test_tiny_cell_leaves_the_others(spark):
    """With a stated total, a document of a new source and language costs the others next to nothing."""
    rows = [(k, "abcd"[min(k % 10, 3)], "en" if k % 3 else "de", "prose", 1000) for k in range(2000)]
    schema = "doc_id long, source string, lang string, topic string, tokens long"
    skewed = [*rows, (-1, "tiny", "xx", "prose", 20), (-2, None, None, None, 0)]
    total = sum(r[-1] for r in rows)
    got = mixing.mix_to_targets(spark.createDataFrame(skewed, schema), catalog.MIX_TARGETS, total=total).toPandas()
    assert not got.duplicated(["doc_id", "copy"]).any()
    copies = got.groupby("doc_id").size()
    p = got.groupby("doc_id").probability.first()
    assert ((copies == np.floor(p)) | (copies == np.floor(p) + 1)).all() and copies[-1] > 1
    assert got.tokens.sum() == pytest.approx(total, rel=0.02)
    plain = mixing.mix_to_targets(spark.createDataFrame(rows, schema), catalog.MIX_TARGETS, total=total).toPandas()
    assert got.doc_id[got.doc_id >= 0].nunique() == pytest.approx(plain.doc_id.nunique(), rel=0.02)
    shares = got.groupby("source").tokens.sum() / got.tokens.sum()
    cells = spark.createDataFrame(skewed, schema).groupBy("source", "lang", "topic").agg(F.sum("tokens").cast("double").alias("w0"))
    raked = mixing.rake(cells, catalog.MIX_TARGETS).toPandas().groupby("source").raked.sum()
    assert all(shares[s] == pytest.approx(raked[s] / raked.sum(), abs=0.02) for s in "abcd")
    assert mixing.mix_to_targets(spark.createDataFrame([], schema), catalog.MIX_TARGETS, total=total).count() == 0


# ---- media -----------------------------------------------------------------------------------------------------------


def test_jpeg_round_trip():
    rng = np.random.default_rng(1)
    raw = [b"", b"a", b"\xff" * 300, bytes(range(256)) * 40, rng.integers(0, 256, 64 * 8191 + 64 * 7, dtype=np.uint8).tobytes()]
    payloads = [b + bytes(-len(b) % 64 if b else 64) for b in raw]
    stored = media.store_payloads(payloads, [len(b) for b in raw])
    back = media.thumbnails(stored)
    assert [b"".join(p.tobytes() for _, p in f) for f in back] == payloads and len(back[-1]) == 2


def test_jpeg_with_ac_and_color():
    """A hand-made 4:2:0 image of 16x16: DC and AC symbols, three components, no restart markers."""
    ac = (bytes([0, 3] + [0] * 14), bytes([0x01, 0x00, 0xF0]))  # codes 00: one extra bit, 01: end of block, 10: 16 zeros
    dc = huff = media.huffman_codes(media.DC_COUNTS, media.DC_SYMBOLS)
    codes = media.huffman_codes(*ac)
    bits = ""
    values = [5, -3, 100, 7]  # luminance DC of the four blocks
    pred = 0
    for v in values:
        d, pred = v - pred, v
        cat = abs(d).bit_length()
        bits += format(huff[cat][0], f"0{huff[cat][1]}b") + (format(d if d > 0 else d + (1 << cat) - 1, f"0{cat}b") if cat else "")
        bits += format(codes[0x01][0], "02b") + "1" + format(codes[0xF0][0], "02b") + format(codes[0x00][0], "02b")
    for _ in range(2):
        bits += format(dc[0][0], f"0{dc[0][1]}b") + format(codes[0x00][0], "02b")
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    seg = media._segment
    data = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\0" + bytes([16]) + media.QUANT[1:]) + seg(0xC0, bytes([8, 0, 16, 0, 16, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    data += seg(0xC4, b"\0" + media.DC_COUNTS + media.DC_SYMBOLS) + seg(0xC4, b"\x10" + ac[0] + ac[1]) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    ((frame, pixels),) = media.thumbnails([data])[0]
    assert (frame.width, frame.height) == (16, 16)
    assert pixels.tolist() == np.clip(np.array(values) * 16 // 8 + 128, 0, 255).reshape(2, 2).tolist()


def test_damaged_images_cost_only_themselves(spark):
    good = media.store_payloads([b"x" * 64], [64])[0]
    bad = [good[:40], b"junk", good[:-12] + b"\xff\xd9", None]
    found = media.thumbnails([good, *bad, good])
    assert found[0] is not None and found[-1] is not None and found[1] is None and found[2] is None and found[4] is None
    df = spark.createDataFrame([(1, good), (2, None), (3, b"junk")], "doc_id long, media binary")
    got = {r["doc_id"]: r["feature"] for r in media.read_media(df).collect()}
    assert got[1] and got[2] is None and got[3] is None


def test_hostile_images():
    """A scan without a frame, false comments, sizes that the scan can't hold, a missing quantiser: null, and only theirs."""
    good = media.store_payloads([b"x" * 64], [64])[0]
    seg, at = media._segment, good.index(b"\xff\xda")
    no_frame = b"\xff\xd8" + good[at:]
    huge = good.replace(b"\x08\x00\x08\x02\x00\x01", b"\x08\xff\xff\xff\xff\x01")
    no_size = good.replace(b"\x08\x00\x08\x02\x00\x01", b"\x08\x00\x00\x02\x00\x01")
    no_quant = good.replace(seg(0xDB, b"\0" + media.QUANT), b"")
    odd = [good.replace(b"bytes=64", c) for c in (b"bytes=zz", b"bytes=\xb2\xb2", b"bytes=-1")]
    assert huge != good and no_size != good and no_quant != good and odd[0] != good
    found = media.thumbnails([good, no_frame, huge, no_size, no_quant, *odd])
    assert [f is not None for f in found] == [True, False, False, False, False, True, True, True]


def test_odd_comments_in_a_table(spark):
    good = media.store_payloads([b"x" * 64], [60])[0]
    df = spark.createDataFrame([(1, good), (2, good.replace(b"bytes=60", b"bytes=zz")), (3, b"\xff\xd8" + good[good.index(b"\xff\xda") :])], "doc_id long, media binary")
    got = {r["doc_id"]: r["n_bytes"] for r in media.read_media(df).collect()}
    assert got == {1: 60, 2: 64, 3: None}


def test_jpeg_with_a_scan_for_each_component():
    """Legal baseline: three scans; the first component's is luminance, 9 x 9 pixels in 2 x 2 blocks."""
    huff, seg = media.huffman_codes(media.DC_COUNTS, media.DC_SYMBOLS), media._segment
    values, pred, bits = [4, -6, 30, 2], 0, ""
    for v in values:
        d, pred = v - pred, v
        cat = abs(d).bit_length()
        bits += format(huff[cat][0], f"0{huff[cat][1]}b") + (format(d if d > 0 else d + (1 << cat) - 1, f"0{cat}b") if cat else "") + "0"
    bits += "1" * (-len(bits) % 8)
    luma = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    flat = int((format(huff[0][0], f"0{huff[0][1]}b") + "0" + "1" * 8)[:8], 2).to_bytes(1, "big")
    data = b"\xff\xd8" + seg(0xDB, b"\0" + media.QUANT) + seg(0xC0, bytes([8, 0, 9, 0, 9, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    data += seg(0xC4, b"\0" + media.DC_COUNTS + media.DC_SYMBOLS) + seg(0xC4, b"\x10" + media.AC_COUNTS + media.AC_SYMBOLS)
    for c, scan in ((1, luma), (2, flat), (3, flat)):
        data += seg(0xDA, bytes([1, c, 0, 0, 63, 0])) + scan
    ((frame, pixels),) = media.thumbnails([data + b"\xff\xd9"])[0]
    assert (frame.width, frame.height) == (9, 9) and pixels.tolist() == (np.array(values) + 128).reshape(2, 2).tolist()


def test_media_query(spark):
    got = {(r["doc_id"], r["n_bytes"]): r for r in media.read_media(media.store_text(awkward(spark))).collect()}
    for r in awkward(spark).collect():
        b = (r["text"] or "").encode()
        row = got[r["doc_id"], len(b)]
        payload = b + bytes(-len(b) % 64 if b else 64)
        assert (row["payload_bytes"], row["payload_sha256"], row["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media.read_media(media.store_text(empty(spark))).count() == 0


# ---- substring dedup -------------------------------------------------------------------------------------------------


def brute_substring(rows, size=20):
    seen, out = set(), []
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    for doc, text in rows:
        words = WORD.findall((text or "").encode())
        gone = set()
        for k in range(len(words) - size + 1):
            w = tuple(words[k : k + size])
            if w in seen:
                gone.update(range(k, k + size))
            seen.add(w)
        out.append((doc, len(words), len(gone), hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()))
    return sorted(out, key=repr)


def test_substring(spark, tables):
    for df in (awkward(spark), tables["documents"].select("doc_id", "text")):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = substring.dedup_windows(df)
        assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()), key=repr) == brute_substring(rows)
        assert set(df.columns) <= set(got.columns)
    assert substring.dedup_windows(empty(spark)).count() == 0


def thue_morse(n, a, b):
    x = [0]
    while len(x) < n:
        x += [1 - y for y in x]
    return "".join((a, b)[y] for y in x)


def test_word_hashes_part_words_that_a_power_of_two_would_not():
    one, other = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    for seed in (0, 1):
        (h,), counts = common.word_hashes([f"{one} {other} {one}".encode(), one.encode()], (seed,))
        assert h[0] != h[1] and h[0] == h[2] == h[3] and counts.tolist() == [3, 1]


def test_substring_parts_windows_of_different_words(spark):
    """Windows are told by their words: these differ in one word of a shape on which weak hashes collide."""
    rest = " ".join(f"w{k}" for k in range(19))
    rows = [(k, f"{thue_morse(n, a, b)} {rest}") for k, (n, a, b) in enumerate([(1024, "a", "b"), (1024, "b", "a"), (2048, "a", "b"), (2048, "b", "a")])]
    got = substring.dedup_windows(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r["n_removed"] for r in got.orderBy("doc_id").collect()] == [0, 0, 0, 0]


def test_substring_grouping_is_by_digest_alone(spark, monkeypatch):
    """Even a sketch hash that is the same for all windows removes nothing else."""
    monkeypatch.setattr(substring, "_counters", lambda w, row, bits: np.zeros(len(w), np.int64))
    w, doc_row, start, counts, raw = substring._windows([" ".join(f"a{k}" for k in range(50)), " ".join(f"a{k}" for k in range(20, 70))], 20)
    at, key, new = substring._candidates(np.ones(len(w), bool), doc_row, start, counts, raw, 20)
    assert int((~new).sum()) == 11 and sorted(at.tolist()) == list(range(len(w)))


def test_substring_ids(spark):
    """Ids beyond 2^53 beside a null id, null ids last, other nullable columns unchanged."""
    t = " ".join(f"w{k}" for k in range(25))
    u = " ".join(f"u{k}" for k in range(25))
    big = 1152921504606847025
    rows = [(None, t, None), (40, t, big), (big, u, 1), (big + 25, u, None), (None, u, big), (2**63 - 1, t, 3), (-5, "x " + u, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra long")
    got = substring.dedup_windows(df).collect()
    assert sorted(((r["doc_id"], r["extra"], r["n_removed"]) for r in got), key=repr) == sorted([(None, None, 25), (40, big, 0), (big, 1, 25), (big + 25, None, 25), (None, big, 25), (2**63 - 1, 3, 25), (-5, None, 0)], key=repr)
    many = spark.createDataFrame([(None, f"{k % 7} {t} {k % 7}") for k in range(50)], "doc_id long, text string")
    got = sorted(r["n_removed"] for r in substring.dedup_windows(many).collect())
    assert got[0] == 0 and got[1:7] == [25] * 6 and got[7:] == [27] * 43


def test_cut_text_keeps_its_white_space(spark):
    a, tail = " ".join(f"a{k}" for k in range(30)), "new\nlines  stay"
    df = spark.createDataFrame([(1, a), (2, f"start here\n{a} {tail}")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in substring.dedup_windows(df).collect()}
    assert got == {1: a, 2: f"start here {tail}"}


# ---- near duplicates -------------------------------------------------------------------------------------------------


def brute_near(rows, size=4, percent=80):
    sets = []
    for doc, text in rows:
        w = WORD.findall(bytes(common.lowered(np.frombuffer((text or "").encode(), np.uint8))))
        sets.append((doc, {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()))
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return sorted((d, len(s), find(d)) for d, s in sets)


def test_near_duplicates(spark, tables):
    df = tables["documents"].select("doc_id", "text")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect())
    assert got == brute_near([(r["doc_id"], r["text"]) for r in df.collect()])


def test_near_duplicate_group_in_blocks(spark, monkeypatch):
    """A hub with copies that differ from each other, more than one block of them, and a chain."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    rows = [(1000, " ".join(base))]
    for k in range(150):
        w = list(base)
        for at in rng.choice(120, int(rng.integers(1, 6)), replace=False):
            w[at] = f"x{k}_{at}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_near(rows)
    for most, exact in ((neardup.MOST, False), (20, False), (20, True)):
        monkeypatch.setattr(neardup, "MOST", most)
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, exact=exact).collect())
        assert got == want


def test_near_duplicates_of_two_groups_and_strays(spark, monkeypatch):
    """Two groups around unlike centres that share passages, members that fit neither, chains; in blocks of eight."""
    monkeypatch.setattr(neardup, "MOST", 8)
    rng = np.random.default_rng(8)
    common_part = [f"c{k}" for k in range(60)]
    rows = []
    for g in range(3):
        base = common_part + [f"g{g}_{k}" for k in range(60)]
        for k in range(40):
            w = list(base)
            for at in rng.choice(120, int(rng.integers(0, 9)), replace=False):
                w[at] = f"x{g}_{k}_{at}"
            rows.append((len(rows), " ".join(w)))
    chain = [f"h{k}" for k in range(150)]
    for k in range(30):
        rows.append((len(rows), " ".join(chain[k * 2 : k * 2 + 90])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_near(rows)
    for exact in (False, True):
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, exact=exact).collect()) == want


def test_near_duplicates_with_null_and_repeated_ids(spark):
    """A null id links nothing, even where its text is another's; rows that share an id join their links; any columns."""
    long, short, other = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("a", 25), ("b", 6), ("c", 30)))
    rows = [(None, long), (None, long), (5, long), (1, long), (1, short), (7, short), (2, long), (9, other), (9, other), (None, other)]
    narrow = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (narrow, narrow.withColumn("more", F.lit("x")), narrow.withColumns({"kept": F.lit(3), "key": F.lit(1), "family": F.lit(1)})):
        got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()), key=repr)
        want = [(None, 22, None, True)] * 2 + [(None, 27, None, True)] + [(1, 22, 1, True)] * 2 + [(2, 22, 1, False), (5, 22, 1, False), (7, 3, 1, False)] + [(9, 27, 9, True)] * 2
        assert got == sorted(want, key=repr)


def test_near_duplicates_awkward(spark):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(awkward(spark)).select("doc_id", "n_shingles", "component_id", "kept").collect()}
    assert (1, 0, 1, True) in got and (2, 0, 2, True) in got and (6, 57, 4, False) in got and (9, 1, 8, False) in got and (None, 3, None, True) in got
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_at_another_threshold(spark):
    """Pairs of a similarity just above and below one half."""
    rows = []
    for k in range(40):
        w = [f"w{k}_{j}" for j in range(103)]
        other = w[: 70 if k % 4 else 60] + [f"x{k}_{j}" for j in range(33)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, percent=50).collect())
    assert got == brute_near(rows, percent=50) and len({c for _, _, c in got}) == 50
    assert neardup.collisions(80) == 36 and neardup.collisions(100) == 64
    for bad in (0, 10, 101):
        with pytest.raises(ValueError):
            neardup.near_duplicates(df, percent=bad)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    b = np.unique(np.concatenate((a[:300], rng.integers(0, 2**63, 100, dtype=np.uint64))))
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    same = np.mean(neardup.signature(a) == neardup.signature(b))
    assert abs(same - j) < 0.25 and (neardup.signature(a[:3]) != 0).all()


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 60), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(links, "a", "b").collect()}
    assert got == {k: 0 for k in range(21)} | {50: 50, 60: 50}


# ---- language --------------------------------------------------------------------------------------------------------


def test_language(spark, sf):
    got = catalog.QUERIES["op6_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out & (got.lang_pred != "und")]
    assert (held.lang == held.lang_pred).mean() > 0.9 and got.score.between(0, 1).all()


def test_language_awkward(spark):
    model = langid.train(["the cat and the dog " * 20, "der hund und die katze " * 20], ["en", "de"])
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.predict(awkward(spark), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (10, "und")} <= got
    assert langid.predict(empty(spark), None).count() == 0 and langid.train([], []) is None
    assert {r["lang_pred"] for r in langid.predict(awkward(spark), None).collect()} == {"und"}


def test_language_trains_on_the_whole_sample(monkeypatch):
    """Every window is seen in every epoch, so a language of one short text too."""
    seen = []

    def count(model, x, y, weight):
        seen.append(y.copy())
        return [np.zeros_like(p) for p in model.parameters()]

    monkeypatch.setattr(langid, "_gradients", count)
    langid.train(["abc " * 3000] * 200 + ["xyz"], ["a"] * 200 + ["b"])
    y = np.concatenate(seen)
    n, short = divmod(int((y == 0).sum()) // langid.EPOCHS, 200)  # 47 windows a text, and a short part of some
    assert (y == 0).sum() % langid.EPOCHS == 0 and n == 47 and 0 < short < 200 and (y == 1).sum() in (langid.EPOCHS, 2 * langid.EPOCHS)


def test_language_sample_is_of_whole_texts(spark):
    """Windows of all places of a long text, each one that the text has, about as many as asked for; blocks of one language."""
    long = " ".join(f"word{k}" for k in range(60_000))
    df = spark.createDataFrame([(1, long, "en"), (2, "kurz", "de"), (3, None, "de"), (4, "", "fr"), (5, "no label", None)], "doc_id long, text string, lang string")
    texts, labels = langid.training_sample(df, 500)
    cut = {long[a : a + langid.WINDOW].encode() for a in range(0, len(long), langid.WINDOW)}
    assert labels.count("de") == 1 and set(labels) == {"en", "de"} and abs(labels.count("en") - 500) < 100
    at = [long.find(t.decode()) for t, k in zip(texts, labels, strict=True) if k == "en"]
    assert all(t in cut for t, k in zip(texts, labels, strict=True) if k == "en") and max(at) > 0.95 * len(long) and len(set(at)) == len(at)
    many = spark.range(2 * langid.MOST_LANGUAGES + 1).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.greatest(F.lit(1000), "id").cast("string").alias("lang"))
    _, labels = langid.training_sample(many)
    assert len(set(labels)) == langid.MOST_LANGUAGES and "1000" in labels and len(labels) <= langid.MOST_WINDOWS


def test_letters_are_of_category_l():
    model = langid.train(["the cat and the dog " * 20, "der hund und die katze " * 20], ["en", "de"])
    langs, scores = langid.predict_text(model, ["x² + ½", "² ½ ① ₃", "12 _", "é", "日本", "\u0301"])
    assert [k == "und" for k in langs] == [False, True, True, False, False, True] and [s == 0 for s in scores] == [False, True, True, False, False, True]


def test_convolution_is_the_plain_one():
    """Pooled responses against loops over places, filters and bytes; a document's score against its windows' mean."""
    rng = np.random.default_rng(3)
    model = langid.train(["abc def ghi " * 50, "xyz uvw rst " * 50], ["a", "b"])
    x = rng.integers(0, 256, (3, langid.WINDOW))
    got = model.pooled(x)
    for n in range(3):
        want = []
        for w, bank, bias in zip(langid.WIDTHS, model.banks, model.biases, strict=True):
            flat = bank.reshape(w, langid.EMBED, langid.FILTERS)
            places = [sum(model.embed[x[n, at + j]] @ flat[j] for j in range(w)) for at in range(langid.WINDOW - w + 1)]
            want += list(np.max(places, 0) + bias)
        assert np.allclose(got[n], want, atol=1e-4)
    text = "abc uvw " * 100
    windows, lengths = langid.windows_of(text.encode())
    logs = model.log_probabilities(windows)
    best = int((logs * lengths[:, None]).sum(0).argmax())
    (lang,), (score,) = langid.predict_text(model, [text])
    assert lang == model.languages[best] and score == pytest.approx((np.exp(logs[:, best]) * lengths).sum() / lengths.sum(), abs=1e-5)


def test_language_gradients():
    rng = np.random.default_rng(0)
    model = langid.train(["abc def ghi " * 5, "xyz uvw rst " * 5], ["a", "b"])
    for k, p in enumerate(model.parameters()):
        model_p = p.astype(np.float64)
        p[...] = model_p
    x, y, w = rng.integers(97, 123, (4, langid.WINDOW)), np.array([0, 1, 0, 1]), np.ones(4)
    grads = langid._gradients(model, x, y, w)

    def loss():
        return float(-model.log_probabilities(x)[np.arange(4), y].astype(np.float64).mean())

    for p, g in list(zip(model.parameters(), grads, strict=True))[-2:]:
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        step = 1e-2
        p[at] += step
        up = loss()
        p[at] -= 2 * step
        down = loss()
        p[at] += step
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.05, abs=1e-4)


# ---- main text -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labeller():
    return mainblocks.trained()


def test_pages(spark, sf, labeller):
    """The driver's own page layout, cut with regular expressions."""
    import html

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in mainblocks.extract(pages, labeller).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", p)).split()) for p in re.split(r"</?(?:p|h1|br)>", article)]
        want = " ".join(p for p in parts if p)
        assert got[r["page_id"]] == (want, len(want))


def test_made_pages(labeller):
    maker = mainblocks.PageMaker(1234)
    made = [maker.example() for _ in range(150)]
    right = np.concatenate([k == (y > 0) for k, (_, y, _) in zip(labeller.label([x for x, _, _ in made]), made, strict=True)])
    assert right.mean() > 0.97


def test_other_layouts(labeller):
    page = """<html><body><header class="site-header"><p>My Site</p></header><div class="cookie-banner"><p>We use cookies.</p></div>
    <main><h1>A title of it</h1><p>First   paragraph with &amp; and <a href=x>a link</a> in it.</p><p>Second one, which goes on for a while.</p><form><input><p>Search here</p></form></main>
    <section class="comments"><h2>Comments</h2><div class="comment"><p>I disagree with it.</p></div></section><aside class="sidebar"><ul><li><a href=1>One</a></li></ul></aside><footer>&copy; all</footer></body></html>"""
    ((text, _),) = mainblocks.main_text([page], labeller)
    assert text.startswith("A title of it First paragraph with & and a link in it. Second one") and "cookies" not in text and "disagree" not in text and "©" not in text


def test_long_blocks_and_many_names():
    """A block's vector counts words after the 64th, and its path has the ninth name of a class."""
    plain, long = (mainblocks.Block("word " * 64 + end, mainblocks.Node(), 0) for end in ("word", "comment"))
    one, two = mainblocks.page_vectors([plain])[0], mainblocks.page_vectors([long])[0]
    words = slice(mainblocks.PATH_DIM, mainblocks.PATH_DIM + mainblocks.WORD_DIM)
    assert not np.array_equal(one[words], two[words]) and np.count_nonzero(two[words]) == 2
    names = "a b c d e f g h comments".split()
    (block,) = mainblocks.leaf_blocks(f'<div class="{" ".join(names)}">text</div>')
    assert block.path.names == ("div", *names)


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_independent_layouts(labeller, name):
    page, want = LAYOUTS[name]
    assert mainblocks.main_text([page], labeller)[0][0] == want


def test_raw_elements_end_at_their_end_tag():
    blocks = lambda page: [b.text for b in mainblocks.leaf_blocks(page)]
    assert blocks("<body><script>for(i=0;i<n;i++){}</script><p>Hello world text</p></body>") == ["Hello world text"]
    assert blocks("<script><!-- x</script><p>a</p><script>'<p>'; \"</SCRIPT ><p>b</p>") == ["a", "b"]
    assert blocks("<style>a > b {} </stylex></style><p>a</p><textarea><p>x</textarea>b") == ["a", "b"]
    assert blocks("<p title='a > b' data-x=\"<p>no</p>\">a</p>") == ["a"]
    assert blocks("<!--> a <!-- <p>x</p> --> b <!x> c </> d") == ["a b c d"]
    assert blocks("<p>a<p title=\"never closed>b</p><p>c") == ["a", "b", "c"]
    assert blocks("<div>a<div>b</div></section></div>c &lt;&amp; d") == ["a", "b", "c <& d"]
    assert blocks("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]


@pytest.mark.parametrize("part", ["<p title=\"x' ", "<div>x", "<x>", "</x>", "<p a=\"'>", "<li><ul><x>", "<", "<!--", "<script>", "<![CDATA[", "&#", "<p a=", "<a b='c' "])
def test_hostile_pages_take_linear_time(part):
    import time

    start = time.perf_counter()
    mainblocks.leaf_blocks(part * (500_000 // len(part)))
    assert time.perf_counter() - start < 10


def test_slashes_and_references():
    """A slash closes only void and foreign elements; a reference doesn't go on beyond its text."""
    blocks = lambda page: [b.text for b in mainblocks.leaf_blocks(page)]
    assert blocks("<script src=//cdn.x/a/>var x=1; if(a<b){}</script><p>Hello</p>") == ["Hello"]
    assert blocks("<style type=text/css/>p{color:red}</style><p>Hello</p>") == ["Hello"]
    assert blocks('<script src="a.js"/>var y;</script><p>Hello</p>') == ["Hello"]
    assert blocks("<p>x &am<b>p;</b> y") == ["x &amp; y"] and blocks("<p>&l<!-- c -->t; z") == ["&lt; z"] and blocks("<p>&lt;b&gt; &amp;amp;") == ["<b> &amp;"]
    assert blocks("<svg><title/><style/></svg><p>Hello<br/>you</p>") == ["Hello", "you"] and blocks("<div/>in<p>Hello") == ["in", "Hello"]


def test_pages_awkward(spark, labeller):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<p>unclosed <b>text"), (4, "u", "<<<>>> &amp; < b"), (5, None, "<script>var a = '<p>x</p>'"), (None, "u", "<article><p>" + "word " * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_blocks": F.lit(2)})
    got = {r["page_id"]: r for r in mainblocks.extract(df, labeller).collect()}
    assert len(got) == 6 and got[1]["text"] == "" and got[1]["n_chars"] == 0 and got[5]["text"] == ""
    assert mainblocks.extract(df.filter("false"), labeller).count() == 0


def test_lstm_gradients():
    rng = np.random.default_rng(0)
    model = mainblocks.Labeller(1)
    x, mask = mainblocks.padded([rng.random((5, mainblocks.INPUTS)).astype(np.float32), rng.random((3, mainblocks.INPUTS)).astype(np.float32)])
    y = rng.integers(0, 2, mask.shape).astype(np.float32)

    def loss():
        z = model.forward(x, mask).astype(np.float64)
        return float(((np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - z * y) * mask).sum() / mask.sum())

    for p, g in zip(model.parameters(), model.gradients(x, mask, y), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        p[at] += 1e-2
        up = loss()
        p[at] -= 2e-2
        down = loss()
        p[at] += 1e-2
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.05, abs=1e-4)


# ---- packing ---------------------------------------------------------------------------------------------------------


def test_tokens_are_the_tokenizers(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r["text"] for r in tables["documents"].limit(60).collect()] + ["", "  a  b ", "\n x", "it's 'since <|endoftext|> x", "a\x85b c  ", "ñandú 123 ½ 日本語", "x" * 5000]
    rng = np.random.default_rng(0)
    odd = np.array(list(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u2003\u2028\u202f\u3000\u200b\ufeff  \n ab1!'sé½語\u0301"))
    texts += ["".join(rng.choice(odd, int(rng.integers(1, 40)))) for _ in range(3000)]
    own = packing.tokenizer(packing.tokenizer_path())
    for t in texts:
        assert np.frombuffer(own.encode(t), np.uint32).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_best_fit():
    rng = np.random.default_rng(0)
    lengths = np.sort(rng.integers(1, 101, 400))[::-1]
    window, offset = packing.best_fit_decreasing(lengths, 100)
    rooms, want = [], []
    for n in lengths.tolist():  # the same by looking at every window
        fits = [(r, -k) for k, r in enumerate(rooms) if r >= n]
        k = -min(fits)[1] if fits else len(rooms)
        if not fits:
            rooms.append(100)
        rooms[k] -= n
        want.append(rooms[k])
    used = defaultdict(int)
    for w, o, n in zip(window.tolist(), offset.tolist(), lengths.tolist(), strict=True):
        assert used[w] == o
        used[w] += n
    assert max(used.values()) <= 100 and len(used) == len(rooms)


def test_packing(spark, tables):
    docs = tables["documents"]
    got = packing.pack_documents(docs, keep_ids=True).toPandas()
    own = packing.tokenizer(packing.tokenizer_path())
    for doc, g in got.groupby("doc_id"):
        text = docs.filter(f"doc_id = {doc}").first()["text"] if doc < 5 else None
        g = g.sort_values("start")
        assert (g.start == g.length.cumsum() - g.length).all() and g.length.sum() == g.doc_tokens.iloc[0]
        if text is not None:
            assert b"".join(g.ids) == own.encode(text) + np.array([1], np.uint32).tobytes()
        assert all(zlib.crc32(i) == c for i, c in zip(g.ids, g.ids_crc32, strict=True))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 2048
    assert got.length.sum() / (got.sequence_id.nunique() * 2048) > 0.95


def test_packing_without_ids(spark):
    """Pieces of rows that have no id or share one are dealt to many bins."""
    df = spark.range(600).select(F.when(F.col("id") % 2 == 0, 7).cast("long").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    got = packing.pack_documents(df, docs_per_bin=50).toPandas()
    assert len(got) == 600 and (got.sequence_id // 2**32).nunique() == 12


def test_packing_keeps_wide_ids_beside_a_null_id(spark):
    ids = [1152921504606847025, 1152921504606847050, None, -(1 << 62) - 1]
    df = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    got = packing.pack_documents(df).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted(ids, key=repr) and {r.sequence_id for r in got} == {0}


def test_frequent_pieces_pass_to_the_next_generation(monkeypatch):
    monkeypatch.setattr(packing, "MOST_KNOWN", 40)
    bpe, plain = packing.Bpe(packing.tokenizer_path()), packing.Bpe(packing.tokenizer_path())
    for k in range(30):
        text = "the cat " + " ".join(f"w{k}x{j}" for j in range(12)) + " the cat"
        assert bpe.encode(text) == plain._ids([text])[0]
        assert len(bpe._known) <= 40 and len(bpe._before) <= 40 and " cat" in bpe._known.keys() | bpe._before.keys()


def test_words_go_to_the_model_once(monkeypatch):
    """Words, numbers and marks don't pass the layers before the model, and a word is made once whatever stands beside it."""
    bpe, made = packing.Bpe(packing.tokenizer_path()), []
    text = "Eine été ñandú, (été) 123! été's it's été; 4été\u0301 Eine été."
    want = bpe._ids([text])[0]
    model, ids = bpe._model, bpe._ids
    monkeypatch.setattr(bpe, "_model", type("Model", (), {"tokenize": lambda self, word: made.append(word) or model.tokenize(word)})())
    monkeypatch.setattr(bpe, "_ids", lambda texts: made.extend(texts) or ids(texts))
    assert bpe.encode(text) == want and bpe.encode(text) == want
    assert len(made) == len(set(made)) and [x for x in made if "\u0301" in x] == ["été\u0301"]
    assert len(made) == 16 and "ĠÃ©tÃ©" in made


def test_packing_awkward(spark):
    got = packing.pack_documents(awkward(spark)).toPandas()
    assert got[got.doc_id == 1].length.tolist() == [1] and got.doc_id.isna().sum() == 1 and len(got[got.doc_id == 4]) == 2
    assert packing.pack_documents(empty(spark)).count() == 0


# ---- top-k -----------------------------------------------------------------------------------------------------------


def brute_top(rows, k):
    out = []
    for q, v in rows:
        if q % 50 == 0:
            scored = sorted(((-int(round(float(np.dot(v, w)))), i) for i, w in rows if i != q and len(w) == len(v)))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["clusters", "ties", "equal"])
def test_top_k(spark, kind):
    rng = np.random.default_rng(4)
    n = 700
    centres = rng.integers(-100, 100, (8, 6))
    v = {"clusters": centres[rng.integers(0, 8, n)] + rng.integers(-3, 4, (n, 6)), "ties": rng.integers(-1, 2, (n, 6)), "equal": np.ones((n, 6), int)}[kind]
    rows = [(k, [float(x) for x in v[k]]) for k in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect())
    assert got == brute_top(rows, 5)


@pytest.mark.parametrize("repeats", [1, 2, 6, 9])
def test_top_k_repeated_rows(spark, repeats):
    """A query's own repeated rows take no place of the others of its block that share its vector; a flag makes one a query."""
    block = lambda c: common.spread(c, topk.LEAST_BLOCKS)
    others = [r["id"] for r in spark.range(51, 1000).filter(block("id") == block(F.lit(50).cast("long"))).orderBy("id").limit(8).collect()]
    ids = [50] * repeats + [others[0], *others]
    df = spark.createDataFrame([(i, [1.0, 2.0], k == 0) for k, i in enumerate(ids)], "vec_id long, embedding array<double>, asks boolean")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("asks"), 5).collect())
    assert got == [(50, n + 1, i, 5) for n, i in enumerate([others[0], *others[:4]])]


def test_first_owners():
    rng = np.random.default_rng(1)
    for _ in range(200):
        ids = np.sort(rng.integers(0, 9, int(rng.integers(1, 40))))
        for own in range(-1, 9):
            some = topk.first_owners(ids, 3)
            assert some[some != own][:3].tolist() == ids[ids != own][:3].tolist()


def test_trees_prune():
    rng = np.random.default_rng(4)
    centres = rng.integers(-1000, 1000, (12, 4)).astype(float)
    v = np.unique(centres[rng.integers(0, 12, 3000)] + rng.integers(-20, 21, (3000, 4)), axis=0)
    found = topk.DualSearch(topk.CoverTree(v[::40]), np.full(len(v[::40]), -1), topk.CoverTree(v), [np.array([k]) for k in range(len(v))], 5)
    assert found.pruned and found.scored < 0.5 * len(v) * len(v[::40])


def test_tree_of_the_embeddings(spark, sf):
    """A true tree also where little can be pruned: many nodes, the share scored is reported, and the result is brute force's."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").filter(topk.valid("embedding")).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("v")).orderBy("vec_id").collect()
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["v"] for r in rows])
    tree, asks = topk.CoverTree(v), np.flatnonzero(ids % 50 == 0)
    assert len(tree.centre) > 1
    found = topk.DualSearch(topk.CoverTree(v[asks]), ids[asks], topk.CoverTree.load(tree.dump()), [ids[k : k + 1] for k in range(len(ids))], 5)
    print(f"nodes {len(tree.centre)}, scored {found.scored / (len(asks) * len(ids)):.3f}, pruned {found.pruned}")
    got = sorted((int(ids[q]), n + 1, int(found.top_id[k, n]), int(found.top_score[k, n])) for k, q in enumerate(asks) for n in range(5))
    assert got == brute_top(list(zip(ids.tolist(), v.tolist(), strict=True)), 5)


def test_scores_beyond_doubles(spark):
    """Integer scores above 2^53 and 2^62, beyond a long, and negative."""
    rows = [(0, [3e9, 1.0]), (1, [3e9, 1.0]), (2, [3e9, 2.0]), (3, [-3e9, 5.0]), (4, [2.0**52 - 1, -1.0]), (50, [2.0**40, 3.0]), (5, [2.0**40, 7.0]), (6, [2.0**40, 8.0]), (7, [1e200, 0.0]), (8, [-1e200, 0.0])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 9).collect()]
    got += [tuple(r) for r in topk.top_k(spark.createDataFrame([(k, [1e200 * k, 1.0]) for k in range(1, 80)], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 2).collect()]
    assert got[-2:] == [(50, 1, 1, 2**63 - 1), (50, 2, 2, 2**63 - 1)]
    got = got[:-2]
    cut = lambda x: min(max(x, -(2**63) + 1), 2**63 - 1)
    want = []
    for q, v in rows:
        if q % 50 == 0:
            scored = sorted((-cut(sum(int(a) * int(b) for a, b in zip(v, w, strict=True))), i) for i, w in rows if i != q)
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert sorted(got) == sorted(want)


def test_several_blocks_and_groups(spark, monkeypatch):
    for name, value in (("REFERENCES", 40), ("QUERIES", 3), ("GROUP", 2)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in rng.integers(-9, 10, 5 if k % 3 else 6)]) for k in range(900)]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5).collect())
    assert got == brute_top(rows, 5)


def test_cover_tree_invariants():
    rng = np.random.default_rng(0)
    tree = topk.CoverTree(rng.random((500, 3)) * 100)

    def points(node):
        return tree.leaf[node] if tree.leaf[node] is not None else np.concatenate([points(c) for c in tree.children[node]])

    assert sorted(points(0).tolist()) == list(range(500))
    for node in range(len(tree.centre)):
        p = points(node)
        assert np.sqrt(((tree.points[p] - tree.points[tree.centre[node]]) ** 2).sum(1)).max() <= tree.radius[node] + 1e-9
        if tree.leaf[node] is None:
            assert tree.centre[node] in [tree.centre[c] for c in tree.children[node]]


def test_top_k_awkward(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [3.0, 1.0]), (6, [1.0]), (50, [1.0, 1.0]), (None, [9.0, 9.0]), (100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect())
    assert got == [(0, 1, 5, 5), (0, 2, 50, 3), (50, 1, 5, 4), (50, 2, 0, 3)]
    assert topk.top_k(df.filter("false"), F.col("vec_id") % 50 == 0, 5).count() == 0


# ---- chat ------------------------------------------------------------------------------------------------------------


def test_chat_query(spark, sf, tables):
    got = {r["conv_id"]: r for r in catalog.QUERIES["op10_chat"](spark, sf).collect()}
    convs = defaultdict(list)
    for r in tables["conversations"].collect():
        convs[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    convs[-1] = [(0, "user", catalog.PLANTED_TURN), (1, "assistant", catalog.PLANTED_TURN)]
    assert set(got) == set(convs)
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        row = got[conv]
        assert row["n_turns"] == len(turns) and row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_escape_is_reversible():
    for s in ["<|im_end|>", "\\<|", "<\\|im_end|>", "<", "\\", "<|<|\\\\|", "a\nb", ""]:
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
        assert chat.unescape_role(chat.escape_role(s)) == s and "\n" not in chat.escape_role(s)


def test_rewriting_template_is_found():
    def moving(messages):  # only the last user turn is marked
        last = max((k for k, m in enumerate(messages) if m["role"] == "user"), default=-1)
        return "".join(("[NOW]" if k == last else "") + f"{m['role']}:{m['text']};" for k, m in enumerate(messages))

    m = [{"role": "user", "text": "a"}, {"role": "assistant", "text": "b"}, {"role": "user", "text": "c"}]
    got = chat.locate(m, moving)
    assert got["rewrites"] == [2] and got["spans"][0] is None and got["spans"][2] is None
    plain = chat.locate(m, chat.marked_template)
    assert plain["rewrites"] == [] and [plain["output"][a:b] for a, b in plain["texts"]] == ["a", "b", "c"]


def test_roles_and_texts_that_hold_the_marker():
    mark = chat.unused([])
    m = [{"role": f"user{mark}", "text": "a"}, {"role": "assistant", "text": mark}, {"role": mark, "text": f"{mark}{chat.unused([{'role': mark, 'text': ''}])}"}]
    got = chat.locate(m, chat.marked_template)
    assert [got["output"][a:b] for a, b in got["texts"]] == [x["text"] for x in m] and not got["rewrites"]


def test_chat_awkward(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "x"), (None, 0, "assistant", "no id"), (2, None, "a\nb", "t" * 50_000), (3, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("spans", F.lit(1))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got[1]["n_turns"] == 3 and got[None]["loss_chars"] == 5 and got[2]["n_turns"] == 1 and got[3]["loss_chars"] == 0
    assert chat.read_back(chat.format_conversations(df.filter("false"))).count() == 0


def test_word_hashes_are_slice_independent():
    rng = np.random.default_rng(0)
    text = b" ".join(bytes(rng.integers(97, 123, int(n)).astype(np.uint8)) for n in rng.integers(1, 9, 200_000))
    (whole,), n = common.word_hashes([text], (0,))
    (parts,), _ = common.word_hashes(text.split(), (0,))
    assert (whole == parts).all() and n[0] == 200_000
    assert (common.window_hashes(whole, 4)[70_000:70_010] == common.window_hashes(whole[70_000:70_013], 4)).all()
