"""Packing of tokenized documents into fixed-length sequences.

A document's token ids and an end id are cut into pieces of a full sequence and a
rest. Full pieces are sequences of their own; the rests are dealt to random groups (by a hash, so that a rerun
deals alike) and each group is packed by first-fit decreasing, with a tournament tree over the room left
in its sequences: the first sequence with enough room is found in one walk from the root.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

LENGTH = 1024
#: Rests that one task packs at a time are about half as many; more leave less padding.
GROUP = 4096
#: Segments of text whose ids a worker remembers: some 60 MB where a corpus has as many.
REMEMBERED = 250_000


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBpe(dict):
    """Token ids of a byte-level BPE vocabulary file, as little-endian unsigned 32-bit bytes.

    Pieces never hold white space after other characters, so a text falls into segments at single
    spaces whose ids do not depend on each other; the ids of frequent segments are remembered.
    """

    #: White space before a space would belong to the same run: such texts are encoded as one.
    _RUN = re.compile(r"[\s\x1c-\x1f\x85] ")

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {s: b for b, s in byte_symbols().items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(byte.__getitem__, s)): i for s, i in spec["model"]["vocab"].items() if s not in special}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.ordinary = self.bpe.encode_ordinary

    def plain(self, text: str) -> bytes:
        return np.array(self.bpe.encode(text, allowed_special="all"), "<u4").tobytes()

    def __missing__(self, segment: str) -> bytes:
        if "<|" in segment:
            ids = self.plain(" " + segment)
        else:
            ids = self.ordinary(" " + segment)
            ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(segment) <= 48:
            if len(self) >= REMEMBERED:
                self.clear()
            self[segment] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if text.endswith(" ") or self._RUN.search(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        return self.plain(first) + b"".join(map(self.__getitem__, rest))


@functools.lru_cache(maxsize=2)
def _bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def _pieces(batches, path: str, end_id: int, length: int):
    bpe = _bpe(path)
    end = np.array([end_id], "<u4").tobytes()
    for batch in small(batches):
        source, start, size, crc, total = [], [], [], [], []
        for i, text in enumerate(batch.column(batch.num_columns - 1)):
            ids = bpe.ids(text.as_py() or "") + end
            n, view = len(ids) // 4, memoryview(ids)
            for at in range(0, n, length):
                part = view[4 * at : 4 * (at + length)]
                source.append(i)
                start.append(at)
                size.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                total.append(n)
        own = [c.take(pa.array(source, pa.int64())) for c in batch.columns[:-1]]
        made = [pa.array(x, pa.int64()) for x in (start, size, crc, total)]
        yield pa.RecordBatch.from_arrays([*own, *made], names=[*batch.schema.names[:-1], "start", "length", "ids_crc32", "doc_tokens"])


def token_pieces(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", end_id: int = 0, length: int = LENGTH) -> DataFrame:
    """Per piece: ``keep`` and ``start, length, ids_crc32, doc_tokens``."""
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["start long", "length long", "ids_crc32 long", "doc_tokens long"])
    return rows.mapInArrow(lambda it: _pieces(it, path, end_id, length), schema)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. ``tree[1]`` is the most room any bin has, a node's children are 2i and 2i + 1."""
    n = len(sizes)
    leaves = 1 << max(0, int(n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        size, at = int(sizes[i]), 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        bins[i], offsets[i] = at - leaves, capacity - tree[at]
        tree[at] -= size
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
    return bins, offsets


def _pack(group: pd.DataFrame, capacity: int, groups: int) -> pd.DataFrame:
    group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
    bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
    # even numbers; sequences of full pieces have the odd ones
    return group.assign(sequence_id=2 * (bins * groups + group["group"]), offset=offsets).drop(columns=["group"])


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, length: int = LENGTH) -> DataFrame:
    """Per piece ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every token lies in exactly one piece; in each sequence the pieces lie one after the other from offset 0.
    A null or empty text is the end id alone; repeated rows are packed each; other columns
    are ignored. ``path`` is a vocabulary file that every executor can open.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pieces = materialize(token_pieces(rows, path, text_col="text", end_id=end_id, length=length), "pieces")
    rests = pieces.where(F.col("length") < length)
    # on average GROUP / 2 rests a group, by a hash that no key steers
    groups = max(1, -(-rests.count() * 2 // GROUP))
    # repeated rows have equal hashes and rests; their number in the written table tells them apart
    dealt = rests.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id(), F.lit("deal")), F.lit(groups)))
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    out = out.replace("doc_id long", f"doc_id {pieces.schema['doc_id'].dataType.simpleString()}", 1)
    packed = dealt.groupBy("group").applyInPandas(lambda g: _pack(g, length, groups), out)
    whole = pieces.where(F.col("length") == length)
    whole = whole.withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(whole)

