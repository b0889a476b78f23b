"""Encoding of a corpus with a public byte-level tokenizer, and decoding.

Texts are cut into pre-tokens once. Each block of texts keeps, for every position, the slot of its pre-token in the block's
own list of distinct pre-tokens; only these lists are shuffled. Every distinct pre-token of the corpus is encoded once, its
ids go back to the blocks' slots, and the texts are put together again by position.
"""

from __future__ import annotations

import importlib.util
import json
import math
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.shared import write_shared



def _folder() -> str:
    """Where the public vocabularies lie: the setting, or the package that holds them if one is installed."""
    spec = importlib.util.find_spec("public_tokenizers")
    held = list(spec.submodule_search_locations or []) if spec else []
    return os.environ.get("PUBLIC_TOKENIZERS") or (held[0] if held else "")


BYTE_BPE = f"{_folder()}/byte_bpe_50k.json"
#: A block ends after so many characters (a longer text is a block of its own) or texts.
BLOCK_CHARS = 2_000_000
BLOCK_TEXTS = 20_000
#: Distinct pre-tokens in one row of a block's list, and in a task's cache of lengths.
LIST_WORDS = 4_096
CACHE_WORDS = 500_000
#: Words that more blocks hold than a COMMON-th of all words in lists, and than LEAST_COMMON, are joined by broadcast.
COMMON, LEAST_COMMON = 10_000, 1_000


#: The pattern of byte-level vocabularies, with classes for letters, numbers and white space; a fixed value but for the order of its first parts, which exclude each other.
PATTERN = " ?[{letters}]+|'(?:s|t|re|ve|m|ll|d)| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"
#: Characters of the property White_Space; fixed values.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Bytes that byte-level vocabularies write as themselves; the others are written as the letters from U+0100 on, in order.
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _letters() -> dict[int, str]:
    """How byte-level vocabularies write each byte."""
    others = [b for b in range(256) if b not in set(PLAIN_BYTES)]
    return {b: chr(b) for b in PLAIN_BYTES} | {b: chr(256 + i) for i, b in enumerate(others)}


def _cutter(path: str):
    """A function that cuts a text into pre-tokens as the tokenizer does.

    A pattern of plain classes does it where a text holds only characters assigned since Unicode 3.2, whose classes all libraries
    agree on (checked for each of them by a test); other texts are cut by the tokenizer's own code.
    """
    loaded = _tokenizer(path)
    own = loaded.pre_tokenizer.pre_tokenize_str
    settled = [chr(c) for c in range(0x10000) if unicodedata.ucd_3_2_0.category(chr(c)) not in ("Cn", "Cs")]
    classes = {name: _class([c for c in settled if unicodedata.category(c)[0] == kind]) for name, kind in (("letters", "L"), ("numbers", "N"))}
    pattern = re.compile(PATTERN.format(space=SPACE, **classes))
    unsure = re.compile(f"[^{_class(settled)}]")
    usual = json.loads(loaded.pre_tokenizer.__getstate__()) == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}

    def cut(text: str) -> list[str]:
        if usual and (text.isascii() or not unsure.search(text)):
            return pattern.findall(text)
        return [text[a:b] for _, (a, b) in own(text)]

    return cut


def _class(chars: list[str]) -> str:
    return "".join(f"{a}-{b}" for a, b in _ranges(chars))


def _ranges(chars: list[str]) -> list[tuple[str, str]]:
    """The runs of neighbouring characters, escaped for a character class."""
    runs: list[list[int]] = []
    for c in map(ord, chars):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return [(f"\\U{a:08x}", f"\\U{b:08x}") for a, b in runs]


def _encoder(path: str):
    """A function that encodes a pre-token."""
    model, letters = _tokenizer(path).model, _letters()
    return lambda word: [t.id for t in model.tokenize("".join(map(letters.__getitem__, word.encode())))]


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = True  # the strings of special tokens are ordinary text
    return loaded


def _cut(path: str):
    """Blocks of texts: a row for each text with the slots of its pre-tokens, and rows with the block's pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _cutter(path)
        block = TaskContext.get().partitionId() << 32
        slots: dict[str, int] = {}
        docs: list = []
        codes: list[bytes] = []
        chars = 0

        def flush() -> pa.RecordBatch:
            words = list(slots)
            lists = [words[i : i + LIST_WORDS] for i in range(0, len(words), LIST_WORDS)]
            n, m = len(docs), len(lists)
            return pa.RecordBatch.from_arrays(
                [pa.array([block] * (n + m), pa.int64()), pa.array([*docs, *[None] * m], pa.int64()), pa.array([*codes, *[None] * m], pa.binary()), pa.array([*[None] * n, *range(0, m * LIST_WORDS, LIST_WORDS)], pa.int32()), pa.array([*[None] * n, *lists], pa.list_(pa.string()))],
                names=["block", "doc_id", "codes", "first_slot", "words"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                pieces = cut(text)
                docs.append(doc_id)
                codes.append(np.fromiter((slots.setdefault(p, len(slots)) for p in pieces), np.int32, len(pieces)).tobytes())
                chars += len(text)
                if chars >= BLOCK_CHARS or len(docs) >= BLOCK_TEXTS:
                    yield flush()
                    block, slots, docs, codes, chars = block + 1, {}, [], [], 0
        if docs:
            yield flush()

    return run


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            ids = [encode(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return run


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, first those of slots with their ids, then the texts; only one block's ids are held."""
    of, parts, table = None, [], None
    for batch in batches:
        blocks = batch.column(0).to_numpy(zero_copy_only=False)
        is_text = batch.column(1).is_null().to_numpy(zero_copy_only=False)  # slot is null
        edges = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(is_text) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if blocks[a] != of:
                of, parts, table = blocks[a], [], None
            piece = batch.slice(a, b - a)
            if not is_text[a]:
                ids = piece.column(2)
                parts.append((piece.column(1).to_numpy(zero_copy_only=False), ids.value_lengths().to_numpy(zero_copy_only=False), ids.flatten().to_numpy(zero_copy_only=False)))
                continue
            if table is None:
                table = _table(parts)
            lengths, starts, flat = table
            raw = piece.column(4)
            sizes = np.array([len(x) // 4 for x in raw.to_pylist()], np.int64)
            codes = np.frombuffer(b"".join(raw.to_pylist()), np.int32)
            each = lengths[codes]
            ends = np.cumsum(each)
            at = np.repeat(starts[codes] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)
            offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
            yield pa.RecordBatch.from_arrays([piece.column(3), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[at], pa.int32()))], names=["doc_id", "ids"])


def _table(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each slot the number of ids and where they start."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    slots, counts, flat = (np.concatenate(x) for x in zip(*parts))
    lengths, starts = np.zeros(len(slots), np.int64), np.zeros(len(slots), np.int64)
    lengths[slots] = counts
    starts[slots] = np.cumsum(counts) - counts
    return lengths, starts, flat


def encode_corpus(documents: DataFrame, tokenizer: str = BYTE_BPE) -> DataFrame:
    """(doc_id, ids): the token ids of every ``text``, without special tokens.

    Empty and null texts have an empty list. A word that very many blocks hold is no hot key: such words, COMMON at most, are joined
    by broadcast. Strings of special tokens are ordinary text. Rows with a repeated or null doc_id
    come out once each. ``tokenizer`` is a byte-level BPE file of the tokenizers library that every executor can read.
    """
    cut = write_shared(documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_cut(tokenizer), "block bigint, doc_id bigint, codes binary, first_slot int, words array<string>"), "pretokens")
    listed = cut.filter(F.col("words").isNotNull()).select("block", "first_slot", F.posexplode("words").alias("at", "word")).select("block", (F.col("first_slot") + F.col("at")).alias("slot"), "word")
    counted = listed.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    encoded = write_shared(counted.mapInArrow(_encode(tokenizer), "word string, n bigint, ids array<int>"), "encoded")
    total, most = encoded.agg(F.sum("n"), F.max("n")).first()
    bound = max(LEAST_COMMON, math.ceil((total or 0) / COMMON))
    if (most or 0) > bound:
        common = encoded.filter(F.col("n") > bound).drop("n")  # COMMON words at most
        rest = listed.join(F.broadcast(common.select("word")), "word", "left_anti").join(encoded.filter(F.col("n") <= bound), "word")
        joined = rest.select("block", "slot", "ids").unionByName(listed.join(F.broadcast(common), "word").select("block", "slot", "ids"))
    else:
        joined = listed.join(encoded, "word")
    back = joined.select("block", "slot", "ids", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("binary").alias("codes"))
    texts = cut.filter(F.col("codes").isNotNull()).select("block", F.lit(None).cast("int").alias("slot"), F.lit(None).cast("array<int>").alias("ids"), "doc_id", "codes")
    ordered = back.unionByName(texts).repartition("block").sortWithinPartitions("block", F.col("slot").isNull())
    return ordered.mapInArrow(_assemble, "doc_id bigint, ids array<int>")


def token_bytes(tokenizer: str = BYTE_BPE) -> dict[int, bytes]:
    """The bytes of every token by id; as large as the vocabulary."""
    letters = {c: b for b, c in _letters().items()}
    vocabulary = json.load(open(tokenizer))["model"]["vocab"]
    return {i: bytes(map(letters.__getitem__, token)) for token, i in vocabulary.items() if all(c in letters for c in token)}


def _join_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, doc_id, at, bytes) of the tokens of each list, one list after the other; only one list is held.

    The bytes of neighbouring rows are neighbours in a batch, so those of a list are one piece of it.
    """
    of, doc, parts, at = None, None, [], 0
    for batch in batches:
        rows, places, tokens = batch.column(0).to_numpy(), batch.column(2), batch.column(3)
        held = memoryview(tokens.buffers()[2] or b"")
        offsets = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset :] if len(tokens) else np.zeros(1, np.int32)
        order = places.fill_null(-1).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(rows)) + 1).tolist(), batch.num_rows]
        ids, texts = [], []
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if rows[a] != of:
                if of is not None:
                    ids.append(doc)
                    texts.append(b"".join(parts).decode("utf-8", "replace"))
                of, doc, parts, at = rows[a], batch.column(1)[a].as_py(), [], 0
            if order[a] >= 0:
                if not np.array_equal(order[a:b], np.arange(at, at + b - a)):
                    raise RuntimeError("tokens of a list came out of order")
                at += b - a
            parts.append(bytes(held[offsets[a] : offsets[b]]))
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    if of is not None:
        yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([b"".join(parts).decode("utf-8", "replace")], pa.string())], names=["doc_id", "text"])


def decode_corpus(encoded: DataFrame, tokenizer: str = BYTE_BPE) -> DataFrame:
    """(doc_id, text) of each (doc_id, ids); ids that are in no vocabulary are left out, empty and null lists are empty texts.

    The ids of each list are exploded with their places and joined with the token-byte table, which is as large as the
    vocabulary and is broadcast. No row moves, so the tokens of a list stay together and in order, which is checked.
    """
    spark = encoded.sparkSession
    tokens = F.broadcast(spark.createDataFrame(list(token_bytes(tokenizer).items()), "id int, bytes binary"))
    lists = encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"), F.monotonically_increasing_id().alias("row"))
    exploded = lists.select("row", "doc_id", F.posexplode_outer("ids").alias("at", "id"))
    return exploded.join(tokens, "id", "left").select("row", "doc_id", "at", "bytes").mapInArrow(_join_tokens, "doc_id bigint, text string")


def token_sizes(documents: DataFrame, tokenizer: str = BYTE_BPE) -> DataFrame:
    """The columns of ``documents`` other than text, with ``n_tokens`` bigint; 0 for empty and null texts."""
    names = [c for c in documents.columns if c != "text"]
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, encode, sizes = _cutter(tokenizer), _encoder(tokenizer), {}

        def size(word: str) -> int:
            if word not in sizes:
                if len(sizes) >= CACHE_WORDS:
                    sizes.clear()
                sizes[word] = len(encode(word))
            return sizes[word]

        for batch in batches:
            counts = [sum(map(size, cut(t.as_py() or ""))) for t in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(counts, pa.int64())], names=[*names, "n_tokens"])

    return documents.select(*names, "text").mapInArrow(run, f"{schema}, n_tokens bigint")
