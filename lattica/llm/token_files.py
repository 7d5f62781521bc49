"""Token-id files of directly addressable codes.

A file holds the ids of consecutive documents.  Ids are split into chunks of eight bits.  Level 0 has
the lowest chunk of every id and a bitmap that tells which ids go on; level 1 has the next chunk of
those that do, and so on.  A rank directory counts the bitmap's ones before each block of 512 bits, so
any id is found by one lookup and one short count for each of its levels, without decoding a block.

Layout, little-endian: b"DACF", u32 levels, u64 documents, u64 ids; document ids (i64 each), null
flags of document ids (u8 each), end offsets (u64 each); for each level: u64 entries, chunks (u8 each),
bitmap ((entries + 7) // 8 bytes), directory (u32 for each 512 entries begun).
Files are rows (place, ..., file binary) of a Parquet table, so any file system Spark writes to can hold them.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import cut, parts_for, small_batches, table

RANK_BITS = 512
#: A file is closed once it has this many ids.
FILE_IDS = 1 << 20
#: Pieces of text whose ids a worker remembers.
CACHE_PIECES = 2_000_000
FILES = "part int, seq int, n_docs long, n_ids long, file binary"


# ---------------------------------------------------------------- format


def pack(ids: np.ndarray, doc_ids: list, ends: np.ndarray) -> bytes:
    """One file of ids (unsigned 32-bit) of documents that end at the offsets ends."""
    levels, rest = [], ids.astype("<u4")
    while True:
        more = rest > 0xFF
        bitmap = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        directory = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
        levels += [np.array([len(rest)], "<u8").tobytes(), (rest & 0xFF).astype("u1").tobytes(), bitmap.tobytes(), directory.astype("<u4").tobytes()]
        if not more.any():
            break
        rest = rest[more] >> 8
    null = np.array([x is None or x != x for x in doc_ids], dtype=bool)
    plain = np.array([0 if n else int(x) for x, n in zip(doc_ids, null, strict=True)], dtype="<i8")
    head = b"DACF" + np.array([len(levels) // 4], "<u4").tobytes() + np.array([len(doc_ids), len(ids)], "<u8").tobytes()
    return head + plain.tobytes() + null.astype("u1").tobytes() + ends.astype("<u8").tobytes() + b"".join(levels)


class TokenFile:
    """Reads a file made by pack()."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"DACF":
            raise ValueError("not a token file")
        n_levels = int(np.frombuffer(data, "<u4", 1, 4)[0])
        docs, self.n_ids = map(int, np.frombuffer(data, "<u8", 2, 8))
        self.at = 24
        plain, null = self._take(data, "<i8", docs), self._take(data, "u1", docs)
        self.doc_ids = [None if n else int(x) for x, n in zip(plain, null, strict=True)]
        self.ends = self._take(data, "<u8", docs).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n = int(self._take(data, "<u8", 1)[0])
            self.levels.append((self._take(data, "u1", n), self._take(data, "u1", (n + 7) // 8), self._take(data, "<u4", -(-n // RANK_BITS))))

    def _take(self, data: bytes, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(data, kind, n, self.at)
        self.at += out.nbytes
        return out

    def id_at(self, i: int) -> int:
        """The id at place i of the file, found level by level."""
        value, shift = 0, 0
        for chunks, bitmap, directory in self.levels:
            value |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_BITS
            bits = np.unpackbits(bitmap[block * RANK_BITS // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK_BITS]
            i, shift = int(directory[block]) + int(bits.sum()), shift + 8
        return value

    def ids(self) -> np.ndarray:
        """All ids of the file."""
        out, at = np.zeros(self.n_ids, "<u4"), np.arange(self.n_ids)
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            out[at] |= chunks.astype("<u4") << np.uint32(8 * level)
            at = at[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)]
        return out


# ---------------------------------------------------------------- tokenizing

_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
#: The byte-level pre-tokenizer's rule, for texts below U+0250 and for any text.
_NEAR = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_NEAR_TEXT = re.compile("[\0-ɏ]*").fullmatch
_SPACED = re.compile(rf" (?:[{_L}]+|[{_N}]+)").fullmatch
_ANY = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


class PieceEncoder:
    """Ids of texts by the tokenizers library, which sees each distinct piece of text once.

    The library splits a text into pieces by a fixed rule and encodes each alone; so do we, keeping the
    pieces' ids.  Pieces of a space and letters or digits go to the library many at a time in one text.
    With encode_special_tokens, special tokens that a text spells out are text like other; without it, as
    the library has it by default, they get their own ids: texts with an added token in them go to the library whole.
    """

    def __init__(self, path: str, encode_special_tokens: bool = True) -> None:
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = encode_special_tokens
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values() if not (encode_special_tokens and x.special)]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else None
        self.any = regex.compile(_ANY)
        self.known: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        spaced = [x for x in pieces if _SPACED(x)]
        other = list(pieces.difference(spaced))
        for i in range(0, len(spaced), 1024):
            e, some = self.tokenizer.encode("".join(spaced[i : i + 1024]), add_special_tokens=False), spaced[i : i + 1024]
            words, ids = np.array(e.word_ids), np.array(e.ids, "<u4")
            cuts = np.flatnonzero(np.diff(words)) + 1
            if len(cuts) + 1 == len(some):
                self.known.update(zip(some, (x.tobytes() for x in np.split(ids, cuts)), strict=True))
            else:  # the library split it otherwise
                other += some
        for x, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self.known[x] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if self.added and (whole := [i for i, x in enumerate(texts) if self.added(x)]):
            out: list[bytes] = [b""] * len(texts)
            for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, "<u4").tobytes()
            rest = sorted(set(range(len(texts))).difference(whole))
            for i, x in zip(rest, self._encode_plain([texts[i] for i in rest]), strict=True):
                out[i] = x
            return out
        return self._encode_plain(texts)

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """encode() of texts without added tokens."""
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        split = [(_NEAR if x.isascii() or _NEAR_TEXT(x) else self.any).findall(x) for x in texts]
        new = set().union(*split).difference(self.known)
        if new:
            self._learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, x)) for x in split]


_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, encode_special_tokens: bool = True) -> PieceEncoder:
    key = path, encode_special_tokens
    if key not in _encoders:
        _encoders[key] = PieceEncoder(*key)
    return _encoders[key]


# ---------------------------------------------------------------- writing and reading


def _write(path: str, end_id: int, encode_special_tokens: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        seq, docs, held, n = 0, [], [], 0

        def close() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(held), "<u4")
            ends = np.cumsum([len(x) // 4 for x in held])
            return pd.DataFrame({"part": [part], "seq": [seq], "n_docs": [len(docs)], "n_ids": [len(ids)], "file": [pack(ids, docs, ends)]})

        for b in batches:
            ids, texts = b["doc_id"].tolist(), b["text"].tolist()
            for i in range(0, len(ids), 256):
                for d, x in zip(ids[i : i + 256], encoder(path, encode_special_tokens).encode([x or "" for x in texts[i : i + 256]]), strict=True):
                    docs.append(d)
                    held.append(x + end)
                    n += len(x) // 4 + 1
                    if n >= FILE_IDS:
                        yield close()
                        seq, docs, held, n = seq + 1, [], [], 0
        if docs:
            yield close()

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, encode_special_tokens: bool = True) -> DataFrame:
    """Encode docs(doc_id, text) to token files in ascending doc_id order (nulls first).

    Returns the table of files as written to the shared folder: part, seq (their order), n_docs, n_ids,
    file.  A null text is an empty one; every document gets end_id after its ids.  Rows of one doc_id
    are ordered by a hash of the text, so that they may lie in many parts.  tokenizer_path must be readable on every executor.  encode_special_tokens as for PieceEncoder.
    """
    small_batches(docs.sparkSession)
    n = parts_for(docs, "text", 16, 1)
    mark = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id", mark).sortWithinPartitions("doc_id", mark, "text")
    return cut(ordered.mapInPandas(_write(tokenizer_path, end_id, encode_special_tokens), FILES), "token-files")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for data, first in zip(b["file"], b["first"], strict=True):
            f = TokenFile(data)
            ids, starts = f.ids(), np.concatenate(([0], f.ends[:-1]))
            raw = ids.tobytes()
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts, f.ends, strict=True)]
            yield pd.DataFrame({"doc_id": pd.array(f.doc_ids, dtype="Int64"), "start": starts + first, "n_tokens": f.ends - starts, "ids_crc32": crc})


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document of a table of token files: doc_id, start (ids of all documents before it),
    n_tokens (with the end id), ids_crc32.  An empty table gives no rows."""
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = files.select("part", "seq", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("inside"))
    firsts = cut(inside.join(before, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("first")), "token-file-starts")
    return files.select("part", "seq", "file").join(firsts, ["part", "seq"]).select("first", "file").mapInPandas(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, encode_special_tokens=False))
