"""Fill-in-middle: a text is cut at two of its unit ends into prefix, middle and suffix, and reordered under markers.

Units are runs of A-Z and a-z, and every other code point by itself. An Arrow-batched pandas UDF works on a batch of rows:
`regex` finds the units one after the other and only their end offsets are kept, four bytes each, so a cut is two lookups
and three slices. The draws come from the SHA-256 of a seed and the document's id: they are the same in every run, on any
partitioning, after any retry. No row meets another, so there is no shuffle and nothing that skew could load.

Defined results: a null text is an empty one; an empty text, and one that contains a marker, stays plain, because only a
text without markers can be told from its markers again; a null id is drawn as the seed alone; rows that share an id share
the draws, and each gives its own row; very long texts are cut whole; an empty table gives no rows; other columns, also of
clashing names, are ignored.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photowarden.llm import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are reordered, and of 100 reordered ones so many have the suffix first.
FIM_RATE, SPM_RATE = 90, 20
SEED = 1
_UNIT = regex.compile(r"[A-Za-z]+|[^A-Za-z]")
_ROW = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"
_TEXT = "text string, sha256 string"


def unit_ends(text: str) -> array:
    """The offset behind each unit, after a 0: unit k is text[ends[k]:ends[k + 1]]."""
    return array("I", [0]) + array("I", (m.end() for m in _UNIT.finditer(text)))


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four integers below 2^32 for an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def transform(doc_id: int | None, text: str, seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> tuple:
    """Units, form, code points of prefix and middle, and the output."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    ends = unit_ends(text)
    n = len(ends) - 1
    if not text or h3 % 100 >= fim_rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[: ends[a]], text[ends[a] : ends[b]], text[ends[b] :]
    if h4 % 100 < spm_rate:
        return n, "spm", len(prefix), len(middle), f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", len(prefix), len(middle), f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that an output was made of. Its parts hold no marker, and none arises where a part meets a marker."""
    if form == "plain":
        return output
    first, rest = output[len(PREFIX) :].split(SUFFIX if form == "psm" else PREFIX, 1)
    second, middle = rest.split(MIDDLE, 1)
    return first + middle + second if form == "psm" else second + middle + first


def _sha256(text: str) -> str:
    return hashlib.sha256(common.utf8(text)).hexdigest()


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """One row a document: doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars, output, output_sha256."""
    common.prepare(docs.sparkSession)

    @F.pandas_udf(_ROW)
    def cut(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [transform(None if i is None else int(i), t or "", seed, fim_rate, spm_rate) for i, t in zip(ids, texts, strict=True)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"], dtype=object)
        return out.assign(output_sha256=out["output"].map(_sha256))

    # an id goes as text: in a pandas Series a null beside it would make it a float
    rows = docs.select("doc_id", cut(F.col("doc_id").cast("string"), F.col("text").cast("string")).alias("_cut"))
    return rows.select("doc_id", "_cut.*")


def restored(rows: DataFrame) -> DataFrame:
    """Adds text and sha256, rebuilt from output and form alone."""
    common.prepare(rows.sparkSession)

    @F.pandas_udf(_TEXT)
    def rebuild(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        texts = pd.Series([restore(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)
        return pd.DataFrame({"text": texts, "sha256": texts.map(_sha256)})

    return rows.withColumn("_made", rebuild("output", "form")).select("*", F.col("_made.text").alias("text"), F.col("_made.sha256").alias("sha256")).drop("_made")
