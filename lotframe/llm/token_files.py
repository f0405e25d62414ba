"""Token-ID files: one zstandard frame per document under a shared dictionary.

Documents are dealt to parts by ranges of doc_id and encoded in that order. A
part is a sequence of packs, each a row of the written table whose ``body`` is
one self-contained binary: a header, an index entry per document (doc_id, place
and length of its frame, number of ids) and the frames. The dictionary is trained
on the serialized id arrays of ``SAMPLE_DOCUMENTS`` documents, so that short
documents compress as well; its SHA-256 stands in every pack and is checked on
reading. Any document can be read without touching the others' frames.

The table is written by Spark's own writer, whose commit keeps the files of lost
or repeated tasks out. A part counts ids as it goes; only one total per part is
summed up over the parts.

Defined results: null text is encoded as empty (its end id alone); null doc_id
comes first and is kept; rows that share a doc_id are ordered by text; an empty
table gives no packs; extra columns are ignored.

Layout of a pack (little-endian): magic ``TOKPACK1``, id width u32, number of
documents u32, dictionary SHA-256 (32 bytes, zeros if there is none); then per
document: has doc_id u8, doc_id i64, frame offset u64, frame length u32, ids u64.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..sources.staging import new_folder
from .columns import documents

MAGIC = b"TOKPACK1"
HEAD = struct.Struct("<8sII32s")
ENTRY = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u4"), ("n_ids", "<u8")])
#: The dictionary is fitted on this many documents, those with the smallest hashes of their ids.
SAMPLE_DOCUMENTS = 400
DICTIONARY_BYTES = 1 << 15
LEVEL = 3
#: A pack is closed when it has this many ids; a longer document has one of its own.
PACK_IDS = 1 << 20
END_ID = 0
BATCH_CHARS = 1 << 23
#: Stretches that are cut into words at once, and new words that go to the library in one text.
PORTION = 1 << 18
WORDS_A_CALL = 1 << 11
#: Bytes of encoded stretches, and as many of words, that a worker remembers.
MEMO_BYTES = 32 << 20
_encoders: dict[str, Encoder] = {}


#: What Unicode and Python count as white space, apart from the space.
_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 32]
#: Code points below these have had their letters and digits settled for long, whatever the Unicode version.
_RARE = r"[\x{0530}-\x{10ffff}]"


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes printable bytes as they are and the others as letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _slices(data: bytes | pa.Buffer, ends: np.ndarray) -> pa.LargeBinaryArray:
    """Consecutive slices of ``data``; ``ends`` begins with the first one's begin."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(data)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, buffers)


def _contents(values: pa.LargeBinaryArray) -> tuple[bytes | pa.Buffer, np.ndarray]:
    """The inverse of ``_slices``, of an array that is no slice of another."""
    _, ends, data = values.buffers()
    return data or b"", np.frombuffer(ends, np.int64, len(values) + 1) if ends else np.zeros(1, np.int64)


class Memo:
    """Values of ``make``, which takes many keys at once; those made lately are remembered, ``MEMO_BYTES`` at most."""

    def __init__(self, make: Callable[[pa.LargeStringArray], pa.LargeBinaryArray]):
        self.make = make
        self.forget()

    def forget(self) -> None:
        self.keys, self.known = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def values(self, keys: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """In the order of ``keys``, which may repeat."""
        dealt = keys.dictionary_encode()
        distinct = dealt.dictionary
        at = pc.index_in(distinct, value_set=self.keys)
        new = distinct.filter(at.is_null())
        places = at.fill_null(0).to_numpy().astype(np.int64)
        places[at.is_null().to_numpy(zero_copy_only=False)] = len(self.keys) + np.arange(len(new))
        self.keys, self.known = pa.concat_arrays([self.keys, new]), pa.concat_arrays([self.known, self.make(new)])
        values = self.known.take(pa.array(places))
        if self.keys.nbytes + self.known.nbytes > MEMO_BYTES:
            self.keys, self.known = distinct, values
            if self.keys.nbytes + self.known.nbytes > MEMO_BYTES:
                self.forget()
        return values.take(dealt.indices)


def _is_regular(text: str) -> bool:
    """No space stands next to other white space, so every space begins a stretch."""
    return "  " not in text and not any(s in text and (f" {s}" in text or f"{s} " in text) for s in _SPACES)


class Encoder:
    """Encodes with a tokenizer file, many texts at once, and remembers stretches between single spaces.

    Byte-level BPE of this kind never joins a space to what stands before it, so
    a text may be cut at every single space between two other characters, and the
    stretches' ids are those of the whole. The new stretches of a batch are cut into
    words by the public pattern, all at once, and new words go to the library's BPE
    model some thousands a call; most of the time of a plain call goes into preparing
    words that have been seen before. A text with special tokens or runs of white
    space, stretches of rarer scripts, and every text under a tokenizer of another
    kind, are encoded by a plain call.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        shown = repr(self.tokenizer.pre_tokenizer)
        self.cuts = self.tokenizer.normalizer is None and "ByteLevel(add_prefix_space=False" in shown and "use_regex=True" in shown
        self.find_words = regex.compile(public_tokenizers.PATTERN).findall
        letters = _byte_letters()
        # The same model, for words that are cut and written in byte letters already.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = CharDelimiterSplit(" ")
        vocabulary = self.tokenizer.get_vocab()
        self.token_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, number in vocabulary.items():
            self.token_bytes[number] = len(token)
        # Only then a word's tokens have as many letters as the word has bytes.
        kind = self.tokenizer.model
        self.cuts &= isinstance(kind, BPE) and not kind.continuing_subword_prefix and not kind.end_of_word_suffix
        self.cuts &= all(letter in vocabulary for letter in letters.values())
        self.letters = np.array([ord(letters[b]) for b in range(255)] + [ord(" ")], "<u4")
        self.memo = Memo(self._stretches)
        self.words = Memo(self._new_words)

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _new_words(self, words: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of words, which the model takes some thousands a call; their tokens are told apart by their letters."""
        made = [pa.array([], pa.large_binary())]
        for at in range(0, len(words), WORDS_A_CALL):
            spelled = words[at : at + WORDS_A_CALL].cast(pa.large_binary()).to_pylist()
            # No UTF-8 holds the byte 255, so it can stand between words.
            text = self.letters[np.frombuffer(b"\xff".join(spelled), np.uint8)].tobytes().decode("utf-32-le")
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            ends = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum([len(word) for word in spelled])) + 1
            made.append(_slices(ids.tobytes(), self.width * np.concatenate(([0], ends))))
        return pa.concat_arrays(made)

    def _stretches(self, pieces: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of stretches, each a space and one of ``pieces``."""
        return pa.concat_arrays([
            pa.array([], pa.large_binary()),
            *(self._portion(pieces[at : at + PORTION]) for at in range(0, len(pieces), PORTION)),
        ])

    def _portion(self, pieces: pa.LargeStringArray) -> pa.LargeBinaryArray:
        # Next to the space of another stretch a lone space would be taken for a run.
        odd = pc.or_(pc.match_substring_regex(pieces, _RARE), pc.equal(pieces, ""))
        text = "".join([" " + piece for piece in pieces.filter(pc.invert(odd)).to_numpy(zero_copy_only=False)])
        words = pa.array(self.find_words(text), pa.large_string())
        data, ends = _contents(self.words.values(words))
        # A stretch begins wherever a word begins with a space.
        begins = np.flatnonzero(pc.starts_with(words, " ").to_numpy(zero_copy_only=False))
        made = _slices(data, ends[np.append(begins, len(words))])
        whole = self._whole([" " + piece for piece in pieces.filter(odd).to_pylist()])
        order = np.argsort(np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        return pa.concat_arrays([made, pa.array(whole, pa.large_binary())]).take(pa.array(order)) if whole else made

    def _cut(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that may be cut at their spaces."""
        if not texts:
            return []
        firsts, spaces, rests = zip(*(text.partition(" ") for text in texts))
        # Nothing stands before a text's first stretch, so it is encoded by itself.
        found = self._whole(list(firsts))
        cut = [at for at, space in enumerate(spaces) if space]
        pieces = pc.split_pattern(pa.array([rests[at] for at in cut], pa.large_string()), " ")
        data, ends = _contents(self.memo.values(pieces.flatten()))
        bounds = ends[pieces.offsets.to_numpy()].tolist()
        for at, begin, end in zip(cut, bounds, bounds[1:]):
            found[at] += memoryview(data)[begin:end]
        return found

    def _may_be_cut(self, text: str) -> bool:
        return self.cuts and _is_regular(text) and not any(s in text for s in self.specials)

    def release(self) -> None:
        """Gives back what batches took beyond what is remembered, for other work of the same worker."""
        pa.default_memory_pool().release_unused()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, serialized."""
        cut = [self._may_be_cut(text) for text in texts]
        whole = iter(self._whole([text for text, may in zip(texts, cut) if not may]))
        parts = iter(self._cut([text for text, may in zip(texts, cut) if may]))
        return [next(parts) if may else next(whole) for may in cut]


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def trained_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """Empty if the sample is too small to train on."""
    sample = docs.where("text is not null").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    texts = [row.text for row in sample.select("text").limit(SAMPLE_DOCUMENTS).toLocalIterator()]
    arrays = encoder(tokenizer).encode(texts)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def packed(entries: list[tuple[int | None, bytes, int]], width: int, dictionary_hash: bytes) -> bytes:
    """One pack from (doc_id, frame, number of ids)."""
    index = np.zeros(len(entries), ENTRY)
    index["known"] = [doc_id is not None for doc_id, _, _ in entries]
    index["doc_id"] = [doc_id or 0 for doc_id, _, _ in entries]
    index["length"] = [len(frame) for _, frame, _ in entries]
    index["offset"] = np.concatenate(([0], np.cumsum(index["length"].astype(np.uint64))[:-1]))
    index["n_ids"] = [n for _, _, n in entries]
    head = HEAD.pack(MAGIC, width, len(entries), dictionary_hash)
    return head + index.tobytes() + b"".join(frame for _, frame, _ in entries)


class Pack:
    """Reads documents of one pack."""

    def __init__(self, body: bytes, dictionary: bytes):
        magic, self.width, n, expected = HEAD.unpack_from(body)
        if magic != MAGIC:
            raise ValueError("not a token pack")
        if expected != _hash(dictionary):
            raise ValueError("the pack was written with another dictionary")
        self.index = np.frombuffer(body, ENTRY, n, HEAD.size)
        self.frames = memoryview(body)[HEAD.size + self.index.nbytes :]
        self.reader = _decompressor(dictionary)

    def ids(self, at: int) -> np.ndarray:
        entry = self.index[at]
        frame = self.frames[int(entry["offset"]) : int(entry["offset"]) + int(entry["length"])]
        raw = self.reader.decompress(frame, max_output_size=int(entry["n_ids"]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def _hash(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest() if dictionary else bytes(32)


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _text_portions(rows: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str]]]:
    for pdf in rows:
        ids = [None if pd.isna(i) else int(i) for i in pdf.doc_id]
        texts, begin, size = pdf.text.tolist(), 0, 0
        for at, text in enumerate(texts):
            size += len(text)
            if size >= BATCH_CHARS or at + 1 == len(texts):
                yield ids[begin : at + 1], texts[begin : at + 1]
                begin, size = at + 1, 0


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Writes ``docs`` (doc_id, text) to ``path``/packs and the dictionary to ``path``/dictionary."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = trained_dictionary(docs, tokenizer)
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, pen = encoder(tokenizer), _compressor(dictionary)
        end, key = np.array([end_id], tool.kind).tobytes(), _hash(dictionary)
        part, start, pack_no = TaskContext.get().partitionId(), 0, 0
        entries: list[tuple[int | None, bytes, int]] = []
        held = 0

        def pack() -> pd.DataFrame:
            known = [i for i, _, _ in entries if i is not None]
            return pd.DataFrame([{
                "part": part, "pack": pack_no, "start": start, "n_ids": held,
                "first_id": min(known, default=None), "last_id": max(known, default=None),
                "body": packed(entries, tool.width, key),
            }]).astype({"first_id": "Int64", "last_id": "Int64"})

        for ids, texts in _text_portions(batches):
            for doc_id, raw in zip(ids, tool.encode(texts)):
                n = len(raw) // tool.width + 1
                if entries and held + n > PACK_IDS:
                    yield pack()
                    start, pack_no, held = start + held, pack_no + 1, 0
                    entries.clear()
                entries.append((doc_id, pen.compress(raw + end), n))
                held += n
        if entries:
            yield pack()
        tool.release()

    schema = "part int, pack long, start long, n_ids long, first_id long, last_id long, body binary"
    ordered = docs.withColumn("text", F.coalesce("text", F.lit(""))).repartitionByRange("doc_id")
    ordered.sortWithinPartitions("doc_id", "text").mapInPandas(write, schema).write.parquet(f"{path}/packs")


def _dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids``."""
    dictionary = _dictionary(spark, path)
    packs = spark.read.parquet(f"{path}/packs")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, start, body in zip(pdf.part, pdf.start, pdf.body):
                pack = Pack(body, dictionary)
                arrays = (pack.ids(i) for i in range(len(pack.index)))
                rows = [(zlib.crc32(a.tobytes()), a.tolist() if with_ids else None) for a in arrays]
                sizes = pack.index["n_ids"].astype(np.int64)
                frame = {
                    "part": part, "doc_id": pd.array(pack.index["doc_id"], "Int64"),
                    "begin": start + np.cumsum(sizes) - sizes, "n_tokens": sizes, "ids_crc32": [c for c, _ in rows],
                }
                frame["doc_id"][pack.index["known"] == 0] = pd.NA
                if with_ids:
                    frame["ids"] = [i for _, i in rows]
                yield pd.DataFrame(frame)

    schema = "part int, doc_id long, begin long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    found = packs.select("part", "start", "body").mapInPandas(read, schema)
    totals = packs.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    extra = ["ids"] if with_ids else []
    return found.join(offsets, "part").select(
        "doc_id", (F.col("begin") + F.col("_offset")).alias("start"), "n_tokens", "ids_crc32", *extra
    )


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """``doc_id`` and ``ids`` of some documents; only packs and frames that hold them are read."""
    dictionary, wanted = _dictionary(spark, path), set(doc_ids)
    holds = F.lit(False)
    for doc_id in sorted(wanted):
        holds = holds | F.lit(doc_id).between(F.col("first_id"), F.col("last_id"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for body in pdf.body:
                pack = Pack(body, dictionary)
                at = [i for i, e in enumerate(pack.index) if e["known"] and int(e["doc_id"]) in wanted]
                yield pd.DataFrame({"doc_id": [int(pack.index[i]["doc_id"]) for i in at], "ids": [pack.ids(i).tolist() for i in at]})

    return spark.read.parquet(f"{path}/packs").where(holds).select("body").mapInPandas(read, "doc_id long, ids array<long>")


def token_file_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes ``docs`` to the shared folder and reads the files back."""
    path = new_folder(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer)
    return read_token_files(docs.sparkSession, path)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_file_digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
