"""The pipeline against its stages done plainly."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from photowarden.llm import common, langid, mixing, packing
from photowarden.llm.catalog import MIX_TARGETS
from tests.llm.test_operators import WORD, awkward, brute_near


def test_stages_and_result(spark, sf):
    docs = common.table(spark, sf, "documents")
    start = {r["doc_id"]: r for r in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf), "test")
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        kept.append({r["doc_id"]: r for r in docs.collect()})
    # language: every document with a letter stays
    assert set(kept[0]) == {d for d, r in start.items() if r["text"] and langid._LETTER.search(r["text"])}
    # near-dedup: the least id of each component stays
    near = brute_near([(d, r["text"]) for d, r in kept[0].items()], size=5)
    assert set(kept[1]) == {d for d, _, c in near if d == c}
    # substring dedup: no window starts twice, and what has no repeat is unchanged
    seen, repeated = set(), set()
    for d in sorted(kept[1]):
        words = WORD.findall(kept[1][d]["text"].encode())
        for k in range(len(words) - 19):
            w = tuple(words[k : k + 20])
            if w in seen:
                repeated.add(d)
            seen.add(w)
    assert all(kept[2][d]["text"] == kept[1][d]["text"] for d in kept[2] if d not in repeated)
    assert set(kept[1]) - set(kept[2]) <= repeated
    # mixing: probabilities by plain raking
    table = docs_table(kept[2])
    p = raked(table)
    want = {r["doc_id"] for r in table if draw(r["doc_id"]) < p[r["source"], r["lang"], r["topic"]] - 1e-9}
    assert want <= set(kept[3]) and len(set(kept[3]) - want) <= 1
    # packing: all ids of what is left
    got = corpus_pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    own = packing.tokenizer(packing.tokenizer_path())
    assert got.length.sum() == sum(len(own.encode(r["text"])) // 4 + 1 for r in kept[3].values())


def test_language_without_usable_labels(spark):
    """Without a model only null texts and those without a letter go, and lang stays null."""
    texts = [None, "", "12 34 !", "some words", "x", "один два"]
    for label in (None, "en"):  # no label; a label only where there is no letter
        rows = [(k, t, label if k == 2 else None, "web", 1) for k, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        got = corpus_pipeline.language(spark, df, "")
        assert got.columns == list(corpus_pipeline.COLUMNS)
        assert sorted(tuple(r) for r in got.collect()) == [r for r in rows if r[0] > 2]


def test_a_contradicted_label_is_replaced(spark):
    """A label that the text contradicts with a high score changes; one that it doesn't, and unlabelled texts, are predicted."""
    en, de = ["the", "cat", "and", "with", "house", "that", "this"], ["der", "hund", "und", "mit", "haus", "dass", "diese"]
    rng = np.random.default_rng(0)
    text = lambda words: " ".join(rng.choice(words, 60))
    rows = [(k, text(en if k % 2 else de), "en" if k % 2 else "de", None, 1) for k in range(200)] + [(900, text(de), "en", "x", 1), (901, text(en), None, "x", 1), (None, text(de), "de", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(3))
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language(spark, df, "").collect()}
    assert got == {k: "en" if k % 2 else "de" for k in range(200)} | {900: "de", 901: "en", None: "de"}


def test_stages_on_awkward_tables(spark):
    """Nulls everywhere, repeated rows, clashing columns and empty tables pass every stage."""
    df = awkward(spark).withColumn("n_chars", F.length("text").cast("long"))
    for docs in (df, df.filter("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, "")
            assert got.columns == list(corpus_pipeline.COLUMNS), name
            rows = got.count()
            assert (rows > 0) == (docs.count() > 0), name
        assert (corpus_pipeline.pack(spark, docs, "").count() > 0) == (docs.count() > 0)


def docs_table(rows):
    out = []
    for r in rows.values():
        t = r["text"] or ""
        topic = "data" if sum(c in "0123456789" for c in t) * 50 >= max(len(t), 1) else "lists" if t.count("\n") * 120 >= max(len(t), 1) else "prose"
        out.append({"doc_id": r["doc_id"], "source": r["source"] or "", "lang": r["lang"] or "", "topic": topic, "tokens": len(WORD.findall(t.encode()))})
    return out


def draw(doc_id):
    import hashlib

    return int(hashlib.md5(str(doc_id).encode()).hexdigest()[:8], 16) / 2**32


def raked(table):
    cells = {}
    for r in table:
        key = (r["source"], r["lang"], r["topic"])
        cells[key] = cells.get(key, 0) + r["tokens"]
    keys = sorted(cells)
    w0 = np.array([cells[k] for k in keys], float)
    w = w0.copy()
    targets = []
    for axis, power in enumerate(MIX_TARGETS.values()):
        values = sorted({k[axis] for k in keys})
        own = np.array([w0[[i for i, k in enumerate(keys) if k[axis] == v]].sum() ** power for v in values])
        targets.append(dict(zip(values, own / own.sum() * w0.sum(), strict=True)))
    for _ in range(mixing.ROUNDS):
        for axis, target in enumerate(targets):
            for v, t in target.items():
                at = [i for i, k in enumerate(keys) if k[axis] == v]
                if w[at].sum() > 0:
                    w[at] *= t / w[at].sum()
    f = np.where(w0 > 0, w / np.maximum(w0, 1e-300), 0)
    return dict(zip(keys, f / f.max(), strict=True))
