"""Texts that name a page: by its title, or its title without the trailing parenthetical, as whole words.

The words of a title stand in a text as an n-gram between other words. Texts yield the n-grams that may be the start of a title,
told by a bitmap of bounded size, and those that may be a whole one are joined with the titles by equality.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_NAME = 4
#: Bits of the bitmap; a title more than it can tell apart only costs rows of the join.
MAP_BITS = 23
_WORD = re.compile(r"\w+")
#: Before and after a text; no title has it.
EDGE = "\0"


def names_of(title: str | None) -> set[str]:
    full = (title or "").replace("_", " ")
    return {n for n in (full, re.sub(r"\s*\([^)]*\)$", "", full)) if len(n) >= LEAST_NAME}


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) & ((1 << MAP_BITS) - 1)


def titles_names(titles: DataFrame) -> DataFrame:
    """``titles`` (title and other columns) with each name of its title: ``name``, its words ``key``, what is around them ``lead`` and ``tail``, and ``hashes`` of its beginnings."""
    fields = titles.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, title in enumerate(batch.column("title").to_pylist()):
                for name in sorted(names_of(title)):
                    words = [m.span() for m in _WORD.finditer(name)]
                    a, b = (words[0][0], words[-1][1]) if words else (len(name), len(name))
                    at.append(i)
                    out.append((name, name[a:b], name[:a], name[b:], [_hash(name[a:e]) for _, e in words] or [_hash("")]))
            rows = batch.take(pa.array(at, pa.int64()))
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate([pa.string()] * 4 + [pa.list_(pa.int32())])]
            yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[*fields.names, "name", "key", "lead", "tail", "hashes"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return titles.mapInArrow(run, f"{kinds}, name string, key string, lead string, tail string, hashes array<int>")


def _bitmap(names: DataFrame) -> np.ndarray:
    """The bits of the names' beginnings; of 2**MAP_BITS, so at most 2**(MAP_BITS - 6) rows come to the driver."""
    h = names.select(F.explode("hashes").alias("h")).distinct()
    words = h.groupBy(F.shiftright("h", 5).alias("w")).agg(F.sum(F.expr("shiftleft(1L, h & 31)")).alias("b")).toPandas()
    bits = np.zeros(1 << (MAP_BITS - 5), np.uint32)
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).astype(np.uint32)
    return bits


def spots(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Of each row of ``texts`` (text and other columns, which come out) the n-grams that may be names: ``key``, and what is before and after."""
    spark, fields = texts.sparkSession, [f for f in texts.schema if f.name != "text"]
    shared = spark.sparkContext.broadcast(_bitmap(names).tobytes())

    def found(text: str, bits: np.ndarray) -> set[tuple[str, str, str]]:
        held = lambda s: bits[(h := _hash(s)) >> 5] >> (h & 31) & 1
        spans = [m.span() for m in _WORD.finditer(text)]
        n, out = len(spans), set()
        before = lambda i: text[spans[i - 1][1] : spans[i][0]] if i else EDGE + text[: spans[0][0]]
        after = lambda j: text[spans[j][1] : spans[j + 1][0]] if j + 1 < n else text[spans[j][1] :] + EDGE
        for i, (a, _) in enumerate(spans):
            for j in range(i, n):
                gram = text[a : spans[j][1]]
                if not held(gram):
                    break
                out.add((gram, before(i), after(j)))
        if held(""):  # a title without words
            gaps = [before(i) for i in range(n)] + [after(n - 1)] if n else [EDGE + text + EDGE]
            out |= {("", g, "") for g in gaps if len(g) > LEAST_NAME}
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint32)
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = found(text or "", bits)
                at += [i] * len(own)
                out += own
            rows = batch.take(pa.array(at, pa.int64()))
            columns = [pa.array([x[k] for x in out], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in fields), *columns], names=[*(f.name for f in fields), "key", "before", "after"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return texts.mapInArrow(run, f"{kinds}, key string, before string, after string")


def fits() -> Column:
    """Whether a name (lead, tail) is what a text has at a spot (before, after), with no word character at either side."""
    lead, tail, before, after = (F.col(c) for c in ("lead", "tail", "before", "after"))
    inside = (lead == "") | (before.endswith(lead) & (F.length(before) > F.length(lead)))
    outside = (tail == "") | (after.startswith(tail) & (F.length(after) > F.length(tail)))
    free = before.substr(F.when(before.startswith(EDGE), F.lit(1)).otherwise(F.lit(2)), F.length(before))
    free = F.when(before.endswith(EDGE), free).otherwise(free.substr(F.lit(1), F.length(free) - 1))
    return F.when(F.col("key") == "", free.contains(F.col("name"))).otherwise(inside & outside)
