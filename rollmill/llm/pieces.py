"""Encoding and decoding with a piece vocabulary (BPE by scores, with bytes for unknown characters).

Merges join the two neighbours whose joint piece has the best score, the leftmost on ties, over a whole text. A sequence of tokens is what
they make of its text if and only if every two neighbours are what they make of their own text: merges
inside and between two neighbours come in the same order with or without the rest. So one token alone ends each
prefix: the one, of all pieces that end there, that goes with the last token of the prefix before it. A table of
these, filled by one pass of an automaton, is read backwards for the ids.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small

SPACE = "▁"
#: Chunks whose ids, and pairs of tokens whose fit, a worker remembers: some 100 MB and 60 MB where a corpus has as many.
REMEMBERED, PAIRS = 500_000, 500_000
#: What an unknown token shows as, and a byte that belongs to no character.
UNKNOWN, BROKEN = " ⁇ ", "�"


class Pieces:
    """A vocabulary, and the texts of ids. Vocabularies with another normaliser, with pieces of users' own or without bytes for unknown characters are refused."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kind = model.normalizer_spec, proto.ModelProto.SentencePiece
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        trained = model.trainer_spec
        if not plain or trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
            raise ValueError(f"{path} is no BPE vocabulary with byte fallback and without normalising")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError(f"{path} has user-defined or unused pieces")
        self.pieces = [p.piece for p in model.pieces]
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == kind.NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError(f"{path} has pieces with a space inside")
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        #: What each id shows: characters, or one byte.
        self.shows = [p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        for b, i in self.byte.items():
            self.shows[i] = bytes([b])
        for i, p in enumerate(model.pieces):
            if p.type in (kind.CONTROL, kind.UNKNOWN):
                self.shows[i] = UNKNOWN.encode() if p.type == kind.UNKNOWN else b""
        self.raw = frozenset(self.byte.values())
        self.silent = frozenset(i for i, s in enumerate(self.shows) if not s)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces with spaces, bytes put together to characters, without the space that encoding adds in front."""
        data = b"".join(map(self.shows.__getitem__, ids))
        first = next((i for i in ids if self.shows[i]), None)
        cut = first is not None and first not in self.raw and self.pieces[first].startswith(SPACE)
        try:
            if self.silent.isdisjoint(ids):  # such an id ends a run of bytes
                return data[cut:].decode()
        except UnicodeDecodeError:
            pass
        return self._broken(ids, cut)

    def _broken(self, ids: list[int], cut: bool) -> str:
        """As ``decode``, run by run of bytes; each byte that is part of no character is one sign of a broken character."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.raw:
                run += self.shows[i]
            else:
                out += [_characters(bytes(run)), self.shows[i].decode()]
                run.clear()
        shown = "".join([*out, _characters(bytes(run))])
        return shown[1:] if cut else shown


class PieceBpe(Pieces, dict):
    """Maps a chunk (spaces, then other characters; spaces stand for themselves) to its ids as little-endian 32-bit bytes.

    No piece goes on with a space after another character, so chunks do not depend on each other.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.first = len(self.pieces)  # a character without a piece is the token first + its number
        self.events: dict[int, list[tuple[float, str, str]]] = {}
        self.find = ahocorasick.Automaton()
        for piece, i in self.id.items():
            if (merges := self._merges(piece)) is not None:
                self.events[i] = merges
                self.find.add_word(piece, (i, len(piece)))
        self.find.make_automaton()
        self.single = {p for p in self.id if len(p) == 1}
        self.goes: dict[int, bool] = {}
        #: Characters that some piece has next to each other; between others nothing merges.
        self.joins = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        # a line feed in no piece never merges: chunks end before and after it
        self.chunk = re.compile(" +[^ \n]*|\n|[^ \n]+" if not any("\n" in p for p in self.id) else " +[^ ]*")

    def _merges(self, piece: str) -> list[tuple[float, str, str]] | None:
        """The merges of a piece's own text in order: score, and the first and last symbol after it. None if they don't end in the piece."""
        symbols, made = list(piece), []
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = self.score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return None
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            made.append((best, symbols[0], symbols[-1]))
        return made

    def together(self, x: int, y: int) -> bool:
        """Whether merging leaves the tokens x, y side by side: replays the merges of both, and looks before each whether the symbols at the border would merge first."""
        left, right = self.text(x), self.text(y)
        last, first = left[-1], right[0]
        ex, ey, i, j = self.events.get(x, ()), self.events.get(y, ()), 0, 0
        while True:
            hx = ex[i][0] if i < len(ex) else None
            hy = ey[j][0] if j < len(ey) else None
            over = self.score.get(last + first)
            if over is not None and (hx is None or over > hx) and (hy is None or over >= hy):
                return False
            if hx is None and hy is None:
                return True
            if hy is None or (hx is not None and hx >= hy):
                last, i = ex[i][2], i + 1
            else:
                first, j = ey[j][1], j + 1

    def text(self, token: int) -> str:
        return self.pieces[token] if token < self.first else chr(token - self.first)

    def _odd(self, shown: str):
        """As the automaton gives them, (place of the last character, (token, length)) of all tokens in the order of their ends, but with characters that have no piece of their own."""
        found = self.find.iter(shown)
        at, known = next(found, (len(shown), None))
        for k, c in enumerate(shown):
            if c not in self.single:
                yield k, (self.first + ord(c), 1)
            while at == k:
                yield at, known
                at, known = next(found, (len(shown), None))

    def table(self, shown: str) -> list[int]:
        """The last token of every prefix."""
        last = [-1] * (len(shown) + 1)
        goes = self.goes
        for at, (token, size) in self.find.iter(shown) if self.single.issuperset(shown) else self._odd(shown):
            at += 1
            if last[at] < 0:
                i = at - size
                if i == 0:
                    last[at] = token
                elif (before := last[i]) >= 0:
                    pair = before << 21 | token
                    fits = goes.get(pair)
                    if fits is None:
                        if len(goes) >= PAIRS:
                            goes.clear()
                        fits = goes[pair] = self.together(before, token)
                    if fits:
                        last[at] = token
        return last

    def tokens(self, chunk: str) -> list[int]:
        shown = chunk.replace(" ", SPACE)
        last, at, out = self.table(shown), len(shown), []
        while at:
            token = last[at]
            if token < self.first:
                out.append(token)
                at -= len(self.pieces[token])
            else:
                out.extend(self.byte[b] for b in reversed(shown[at - 1].encode()))
                at -= 1
        return out[::-1]

    def __missing__(self, chunk: str) -> bytes:
        if chunk[-1] in ".,;:!?" and chunk[-2:-1].isalpha() and chunk[-2:] not in self.joins:
            ids = self[chunk[:-1]] + self[chunk[-1]]
        else:
            ids = np.array(self.tokens(chunk), "<i4").tobytes()
        if len(chunk) <= 48:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as bytes; none for an empty one."""
        return b"".join(map(self.__getitem__, self.chunk.findall(" " + text.replace(SPACE, " ")))) if text else b""


def _characters(run: bytes) -> str:
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append(BROKEN)
            at += 1
    return "".join(out)


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> PieceBpe:
    return PieceBpe(path)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Pieces:
    return Pieces(path)


def _encode(batches, path: str):
    bpe = pieces(path)
    for batch in small(batches):
        ids = [bpe.encode(t.as_py() or "") for t in batch.column(batch.num_columns - 1)]
        ends = np.cumsum([0, *[len(x) // 4 for x in ids]])
        made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*batch.schema.names[:-1], "ids"])


def _decode(batches, path: str):
    known = vocabulary(path)
    for batch in small(batches):
        ids = batch.column(batch.num_columns - 1)
        flat, ends = ids.flatten().to_numpy(zero_copy_only=False), ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).cumsum()
        texts, at = [], 0
        for end in ends.tolist():
            texts.append(known.decode(flat[at:end].tolist()))
            at = end
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` and ``ids``, the ids of each whole text without begin or end.

    A null or empty text has none. Repeated rows are encoded each; columns beside ``keep`` are ignored, so their names cannot clash;
    an empty table gives an empty one. Texts of any length take time and memory in proportion to it. ``path`` is a vocabulary file that every executor can open. No shuffle.
    """
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["ids array<int>"])
    return rows.mapInArrow(lambda it: _encode(it, path), schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """The columns of ``encoded`` and the text of its ids; null ids count as none, ids outside the vocabulary are an error. No shuffle."""
    rows = encoded.select(*[c for c in encoded.columns if c not in (ids_col, to)], F.col(ids_col).cast("array<int>").alias(ids_col))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + ["decoded string"])
    return rows.mapInArrow(lambda it: _decode(it, path), schema).withColumnRenamed("decoded", to)
