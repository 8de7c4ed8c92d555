"""Collocations, near-duplicate vectors and fill-in-middle against DuckDB, brute force and awkward tables."""

import collections
import hashlib
import itertools
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from photowarden.llm import catalog, chat, embdup, fim, neardup, phrases
from tests.conftest import duck, rows_of
from tests.llm.test_operators import awkward, empty


@pytest.mark.parametrize("name", ["op11_phrases", "op12_near_vectors", "op13_fill_in_middle"])
def test_queries_against_sql(spark, sf, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    want = duck(sf).sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


# ---- collocations ----------------------------------------------------------------------------------------------------


def plain_counts(docs):
    """Counts of every phrase of one to five words, by language."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                for k in range(len(words) - m + 1):
                    f[lang, tuple(words[k : k + m])] += 1
    return f, n


def plain_phrases(docs, least, top):
    f, n = plain_counts(docs)
    held = {p: c for p, c in f.items() if c >= least and len(p[1]) > 1}
    inside = collections.defaultdict(int)
    for (lang, words), c in held.items():
        for m in range(2, len(words)):
            for k in range(len(words) - m + 1):
                inside[lang, words[k : k + m]] = max(inside[lang, words[k : k + m]], c)
    out = collections.defaultdict(list)
    for (lang, words), a in held.items():
        if inside[lang, words] < a:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
            out[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return {(lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)}


def some_texts(seed, n):
    """Few words, so that phrases repeat, with all kinds of white space, separators, cases and nulls."""
    rng = np.random.default_rng(seed)
    words = ["a", "B", "the", "of", "Zebra", "x\x1cy", "été", "cafÉ", " ", "9", "a-b", "\U0001f600"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?", "\x0b", " ; "]
    for k in range(n):
        m = int(rng.integers(0, 60))
        text = "".join(words[min(11, int(rng.geometric(0.25)) - 1)] + gaps[int(rng.integers(len(gaps)))] for _ in range(m))
        yield (["en", "de", None, "und", ""][k % 5], None if k % 17 == 3 else text)


@pytest.mark.parametrize(("least", "top", "shard"), [(3, 2000, 200), (2, 7, 1 << 20), (5, 50, 1500)])
def test_phrases_against_plain(spark, least, top, shard):
    docs = [*some_texts(least, 150), ("en", "one two three four five six, " * 40), ("en", "one two three four five six, " * 40), ("de", "w " * 300), (None, " \n ,,"), ("en", "")]
    rows = spark.createDataFrame(docs, "lang string, text string").repartition(3).withColumn("phrase", F.lit(1)).withColumn("n", F.lit(2))
    got = phrases.mine_phrases(rows, least, top, shard)
    assert {tuple(r) for r in got.collect()} == plain_phrases(docs, least, top)


def test_suffix_array_and_intervals():
    rng = np.random.default_rng(5)
    for _ in range(20):
        ids = np.append(rng.integers(0, 4, 200), 0)
        order, same, room = phrases.suffix_array(ids)
        text = [tuple(itertools.takewhile(bool, ids[k : k + 5].tolist())) for k in range(len(ids))]
        assert [text[k] for k in order] == sorted(t for t in text if t)
        assert room.tolist() == [len(text[k]) for k in order]
        for m in range(1, 6):
            at, count = phrases.intervals(order, same, room, m)
            assert dict(zip((text[k][:m] for k in at), count.tolist(), strict=True)) == collections.Counter(t[:m] for t in text if len(t) >= m)
    assert all(not len(x) for x in phrases.suffix_array(np.zeros(1, np.int64)))


def test_long_texts_are_cut_at_separators():
    text = b"one two. three four, five " * 50 + b"x" * 500 + b" last"
    parts = list(phrases._parts(text, 64))
    assert b"".join(parts) == text and len(parts) > 5
    assert all(p[-1:] in b".," for p in parts[:-1])
    assert list(phrases._parts(b"no separator " * 50, 64)) == [b"no separator " * 50]


def test_products_beyond_64_bits(spark):
    big = 3 * 10**12
    counts = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "b c", 2, 7), ("en", "c", 1, 7)], "lang string, phrase string, words int, f long")
    rows = {r.phrase: r for r in phrases.score_phrases(counts, spark.createDataFrame([("en", 10**14)], "lang string, n long")).collect()}
    assert rows["a b"].score == 1000 * big * 10**14 // (big * (big + 1)) and rows["b c"].score == 1000 * 7 * 10**14 // ((big + 1) * 7)


def test_phrases_of_awkward_and_empty_tables(spark):
    docs = [(r.lang, r.text) for r in awkward(spark).select("lang", "text").collect()]
    assert {tuple(r) for r in phrases.mine_phrases(awkward(spark), 2, 30).collect()} == plain_phrases(docs, 2, 30)
    assert phrases.mine_phrases(empty(spark)).count() == 0


# ---- near-duplicate vectors ------------------------------------------------------------------------------------------


def plain_links(vectors, threshold):
    good = [k for k, (i, v) in enumerate(vectors) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = collections.Counter(), {k: k for k in range(len(vectors))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(good, 2):
        x, y = (np.array(vectors[k][1], np.float64) for k in (a, b))
        if len(x) == len(y) and embdup._cosine(x, y) >= threshold:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    lowest = {}
    for k in good:
        lowest[find(k)] = min(lowest.get(find(k), vectors[k][0]), vectors[k][0])
    return sorted(((i, links[k], lowest[find(k)] if k in good else i) for k, (i, _) in enumerate(vectors)), key=repr)


def clusters(seed, dims, n):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dims)) * 2.0 ** -np.arange(dims)
    noise = np.linalg.norm(centres, axis=1).mean() * 0.35 / np.sqrt(dims)
    return [(1 << 60) + 7 * k for k in range(n)], centres[rng.integers(0, 6, n)] + rng.standard_normal((n, dims)) * noise


@pytest.mark.parametrize(("dims", "threshold", "rows"), [(40, 0.95, 16), (3, 0.95, 8), (70, 0.8, 300), (12, 0.99, 5)])
def test_near_vectors_against_all_pairs(spark, monkeypatch, dims, threshold, rows):
    monkeypatch.setattr(embdup, "LEAST_ROWS", rows)
    monkeypatch.setattr(embdup, "BLOCKS", 1000)
    ids, v = clusters(dims, dims, 220)
    vectors = [(i, [float(x) for x in row]) for i, row in zip(ids, v, strict=True)]
    vectors += [(i + 1, row) for i, row in vectors[:20]] + [(5, vectors[3][1]), (5, vectors[100][1]), (6, [2.0 * x for x in vectors[3][1]]), (7, [-x for x in vectors[3][1]])]
    vectors += [(1, None), (2, []), (3, [0.0] * dims), (4, [None] + [1.0] * (dims - 1)), (8, [float("nan")] * dims), (9, [float("inf")] * dims), (None, vectors[3][1]), (10, [1.0, 2.0]), (11, [1.0, 2.0]), (12, [1e200, 2e200]), (13, [1e-320, 2e-320])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(4).withColumn("vec", F.lit("x")).withColumn("class", F.lit(1)).withColumn("n_links", F.lit(0))
    got = embdup.near_vectors(df, threshold).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == plain_links(vectors, threshold)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_a_group_of_copies_and_near_copies(spark):
    """No more rows than classes leave a pair of blocks; counts are those of all pairs."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal(64)
    v = np.concatenate((np.repeat(base[None], 1500, 0), base + rng.standard_normal((700, 64)) * 0.02, rng.standard_normal((300, 64)))).astype(np.float32)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(8)
    got = {r.vec_id: r for r in embdup.near_vectors(df).collect()}
    assert all(got[k].n_links == 2199 and got[k].component_id == 0 for k in range(2200))
    assert all(got[k].n_links == 0 and got[k].kept for k in range(2200, 2500))


def test_tiles_stop_early_and_miss_nothing():
    rng = np.random.default_rng(8)
    u = rng.standard_normal((900, 48))
    v = np.concatenate((u[:300] + rng.standard_normal((300, 48)) * 0.2, rng.standard_normal((400, 48))))
    axes = {48: np.linalg.qr(rng.standard_normal((48, 48)))[0]}  # any axes give the same links
    blocks = [{"block": k, "classes": list(range(1000 * k, 1000 * k + len(x))), "copies": [1] * len(x), "vecs": [r.tobytes() for r in x]} for k, x in enumerate((u, v))]
    ids, found, links = embdup.compare_blocks(*blocks, axes, 0.95)
    unit = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (u, v)]
    want = unit[0] @ unit[1].T >= 0.95
    assert found.tolist() == [*want.sum(1), *want.sum(0)] and len(links) <= len(ids)
    own_ids, own, _ = embdup.compare_blocks(blocks[0], blocks[0], axes, 0.3)
    assert own.tolist() == ((unit[0] @ unit[0].T >= 0.3).sum(1) - 1).tolist() and own_ids.tolist() == list(range(900))


def test_near_vectors_of_an_empty_table(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert embdup.near_vectors(vectors.filter("false")).count() == 0
    none = embdup.near_vectors(vectors.withColumn("embedding", F.lit(None).cast("array<float>"))).collect()
    assert len(none) == vectors.count() and all(r.n_links == 0 and r.kept and r.component_id == r.vec_id for r in none)


# ---- fill-in-middle --------------------------------------------------------------------------------------------------


def plain_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.integers(-5, 1 << 62), st.text(st.sampled_from("abZ <PSM>\né\U0001f600.\x00"), max_size=40))
def test_middle_against_plain(doc_id, text):
    row = fim.transform(doc_id, text)
    assert row == plain_middle(doc_id, text)
    assert fim.restore(row[4], row[1]) == text


def test_middle_of_awkward_tables(spark):
    more = spark.createDataFrame([((1 << 60) + 1, "ab" * 400_000), (None, "x <M> y"), ((1 << 60) + 3, "\x00<P"), (-4, "tail <")], "doc_id long, text string")
    rows = awkward(spark).select("doc_id", "text").unionByName(more).withColumn("output", F.lit(1)).withColumn("form", F.lit("psm")).withColumn("sha256", F.lit(0))
    got = fim.restored(fim.fill_in_middle(rows)).collect()
    want = collections.Counter((r.doc_id, *plain_middle(r.doc_id, r.text)) for r in rows.collect())
    assert collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == want
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert all(r.output_sha256 == sha(r.output) and r.sha256 == sha(r.text) for r in got)
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter((r.doc_id, r.text or "") for r in rows.collect())
    assert fim.restored(fim.fill_in_middle(empty(spark))).count() == 0


def test_rates_and_seed(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plain = {r.form for r in fim.fill_in_middle(docs, fim_rate=0).select("form").distinct().collect()}
    suffix_first = {r.form for r in fim.fill_in_middle(docs, fim_rate=100, spm_rate=100).filter("n > 0").select("form").distinct().collect()}
    assert plain == {"plain"} and suffix_first <= {"spm", "plain"} and "spm" in suffix_first
    forms = [[tuple(r) for r in fim.fill_in_middle(docs, seed=s).select("doc_id", "output_sha256").orderBy("doc_id").collect()] for s in (1, 1, 2)]
    assert forms[0] == forms[1] != forms[2]


# ---- templates that tell their tails ---------------------------------------------------------------------------------


def test_tails_give_what_prefixes_give():
    rng = np.random.default_rng(4)
    pieces = ["<|im_end|>", "\ue000mark\ue001", "a\\b", "\n", "", "hello", chat.START]
    for n in (0, 1, 2, 5, 9, 33):
        messages = [{"role": str(rng.choice(["user", "assistant", "x\n"])), "text": "".join(rng.choice(pieces, rng.integers(0, 5)))} for _ in range(n)]
        assert chat.locate(messages, chat.marked_template) == chat.locate(messages, lambda m: chat.marked_template(m))


def test_a_template_with_wrong_tails_is_a_black_box():
    def render(messages):
        return "".join(f"[{m['role']}:{m['text']}]" for m in messages) + ("!" if len(messages) > 5 else "")

    render.tail = lambda messages, k: f"[{messages[k]['role']}:{messages[k]['text']}]"
    messages = [{"role": "user", "text": f"t{k}"} for k in range(9)]
    got = chat.locate(messages, render)
    assert got == chat.locate(messages, lambda m: render(m)) and got["rewrites"] == [6, 7, 8]


def test_many_turns_in_linear_time():
    messages = [{"role": ("user", "assistant")[k % 2], "text": "x" * 200} for k in range(4000)]
    start = time.perf_counter()
    got = chat.locate(messages, chat.marked_template)
    assert time.perf_counter() - start < 2 and all(got["output"][a:b] == "x" * 200 for a, b in got["texts"])


def test_every_prefix_is_rendered():
    seen = []

    def render(messages):  # what it tells of its tails isn't true at three turns, which no power of two shows
        seen.append(len(messages))
        return ("?" if len(messages) == 3 else "") + "".join(f"[{m['role']}:{m['text']}]" for m in messages)

    render.tail = lambda messages, k: f"[{messages[k]['role']}:{messages[k]['text']}]"
    got = chat.locate([{"role": "user", "text": f"t{k}"} for k in range(4)], render)
    assert got["rewrites"] == [2, 3] and set(seen) == {0, 1, 2, 3, 4}


# ---- near-duplicates beyond what is broadcast ------------------------------------------------------------------------


def test_near_duplicates_of_more_than_is_broadcast(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = lambda: sorted(map(tuple, neardup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()))
    want = rows()
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    assert rows() == want
