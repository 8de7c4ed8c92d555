"""Packing documents into fixed windows by best-fit decreasing.

Each document is tokenised, ends with a separator id, and is cut into full windows and one remainder. Remainders are
placed, longest first, into the open window with the least sufficient room; a segment tree over the remaining
capacities finds it in log2(capacity) steps. Pieces are dealt by a hash of their id, start and checksum to bins of the
pieces of about `docs_per_bin` documents, so that bins are independent tasks of bounded size at any scale, also where many
rows have no id or share one; the waste is at most a few open windows a bin.

Defined results: null or empty text is a document of the separator alone; very long texts are many pieces, all of them
kept; null ids are one more key; repeated rows are packed each on its own; pieces of equal length go in order of id, start
and checksum, and windows of equal room latest first; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photowarden.llm import common

CAPACITY = 2048
END_ID = 1
DOCS_PER_BIN = 4096
TOKENIZER = "byte_bpe_50k.json"
#: Pieces whose ids a worker keeps.
MOST_KNOWN = 1 << 18
# The characters that Unicode calls white space.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
# Words as byte-level BPE splits them, of characters whose kind no version of Unicode has changed. A word that
# another character follows, which might belong to it, is left to _PIECE.
_LATIN, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "!-/:-@\\[-`{-~"
_WORD = f"(?:'(?:s|t|re|ve|m|ll|d)|(?: ?[{_LATIN}]++| ?[0-9]++| ?[{_MARKS}]++)(?![^\t\n\r -~{_LATIN}]))"
_ONE_WORD, _WORD_OR_PIECE = re.compile(_WORD), re.compile(f"{_WORD}|{_PIECE.pattern}")
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _byte_characters() -> dict[int, str]:
    """The character of each byte in a byte-level BPE file: printable ones stand for themselves, others count from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


_BYTES = _byte_characters()
_SPACE_BYTE = _BYTES[32]


class _Known(dict):
    """Ids by piece; what is missing is taken from the generation before, or made."""

    def __init__(self, make, before: dict[str, bytes]):
        self.make, self.before = make, before

    def __missing__(self, piece: str) -> bytes:
        found = self[piece] = self.before.get(piece) or self.make(piece)  # frequent pieces pass from one generation to the next
        return found


class Bpe:
    """Ids of a byte-level BPE file as little-endian 32-bit bytes, made by `tokenizers` with add_special_tokens=False.

    Where white space begins a token always begins, so a run of white space with the word after it is tokenised
    independently of the rest: each different such piece is given to `tokenizers` once and kept (the tests compare whole
    texts). Where the file has the usual split, words, numbers and marks of ASCII and Latin letters are cut here as it cuts
    them, and go to its model in `tokenizers` without the layers before it, which cost more than the merges. A text with a
    special token's string in it is given to `tokenizers` whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the unit of parallelism
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._model = self._tok.model
        split = json.loads(self._tok.pre_tokenizer.__getstate__()) if self._tok.pre_tokenizer and not self._tok.normalizer else {}
        usual = split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        self._cut, self._make = (_WORD_OR_PIECE, self._word_or_piece) if usual else (_PIECE, self._piece)
        self._special = [t.content for t in self._tok.get_added_tokens_decoder().values()]
        self._before: dict[str, bytes] = {}
        self._known = _Known(self._make, self._before)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self._tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        return self._ids([piece])[0]

    def _word_or_piece(self, piece: str) -> bytes:
        bare = piece.removeprefix(" ")
        if bare.isascii() and bare.isalpha():
            word = _SPACE_BYTE * (len(bare) < len(piece)) + bare
        elif _ONE_WORD.fullmatch(piece):
            word = piece.encode().decode("latin-1").translate(_BYTES)
        else:
            return self._piece(piece)
        return array("I", [t.id for t in self._model.tokenize(word)]).tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        ids, out = self._known.__getitem__, []
        for t in texts:
            whole = any(s in t for s in self._special)
            out.append(self._piece(t) if whole else b"".join(map(ids, self._cut.findall(t))))
        if len(self._known) > MOST_KNOWN // 2:
            self._before = dict(self._known)
            self._known = _Known(self._make, self._before)
        return out


_loaded: dict[str, Bpe] = {}


def tokenizer(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenize(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids: doc_id, start, length, ids_crc32, doc_tokens, and with keep_ids the ids."""
    common.prepare(docs.sparkSession)
    end = array("I", [end_id]).tobytes()

    def cut(batches):
        tok = tokenizer(path or tokenizer_path())
        for batch in common.slices(batches):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), tok.encode_all([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids += end
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    part = ids[4 * s : 4 * (s + capacity)]
                    rows.append((doc, s, len(part) // 4, zlib.crc32(part), n, part))
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 5 + [pa.binary()] * keep_ids
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _PIECES + ", ids binary" * keep_ids)


class OpenWindows:
    """Open windows by remaining room: a binary segment tree whose leaf r counts the windows with room r."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.count = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        i, count = room + self.size, self.count
        while i:
            count[i] += by
            i >>= 1

    def put(self, window: int, room: int) -> None:
        if room:
            self.at[room].append(window)
            self._add(room, 1)

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of at least `need`, removed, with its room."""
        i, count = need + self.size, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up, until a subtree to the right has a window
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        self._add(room, -1)
        return self.at[room].pop(), room


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each length, given longest first."""
    windows, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree, opened = OpenWindows(capacity), 0
    for k, need in enumerate(lengths.tolist()):
        got = tree.take_tightest(need) if need < capacity else None
        if got is None:
            window, room = opened, capacity
            opened += 1
        else:
            window, room = got
        windows[k], offsets[k] = window, capacity - room
        tree.put(window, room - need)
    return windows, offsets


def pack(pieces: DataFrame, n_docs: int, capacity: int = CAPACITY, docs_per_bin: int = DOCS_PER_BIN) -> DataFrame:
    """Adds sequence_id (bin, then number within the bin) and offset; other columns of the pieces stay."""
    bins = max(1, math.ceil(n_docs / docs_per_bin))
    kept = pieces.columns
    schema = ", ".join(f"`{n}` {k}" for n, k in pieces.dtypes) + ", sequence_id long, offset long"

    def place(table: pa.Table) -> pa.Table:
        keys = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        table = table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_end"))
        window, offset = best_fit_decreasing(table.column("length").to_numpy(), capacity)
        first = table.column("_bin")[0].as_py() << 32
        return table.select(kept).append_column("sequence_id", pa.array(window + first)).append_column("offset", pa.array(offset))

    lot = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(bins))
    return pieces.withColumn("_bin", lot).groupBy("_bin").applyInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, docs_per_bin: int = DOCS_PER_BIN) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with keep_ids the ids too."""
    return pack(tokenize(docs, path, capacity, end_id, keep_ids), docs.count(), capacity, docs_per_bin)
