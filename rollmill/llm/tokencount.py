"""Exact token counts by prefix dynamic programming over a BPE vocabulary with word ends.

A sequence of tokens is what BPE makes of its text if and only if every two neighbours are what
BPE makes of their own text. So the last token of each prefix follows from shorter
prefixes: it is the one token ending there that goes with the last token before
it. One pass over a word gives the count at every prefix; one pass over a text's words gives running totals, from which
truncation and budget questions are answered without encoding again.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import byte_symbols

LIMIT = 2048
#: Words and chunks whose counts a worker remembers.
REMEMBERED = 1_500_000
#: Stands for the end of a word inside the matcher; no byte maps to it.
END = "\n"
NEVER = 1 << 60
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


class PrefixCounter(dict):
    """Maps a chunk (a run without white space, normalised) to its number of tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]))
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern)
        self.symbol = [s for _, s in sorted(byte_symbols().items())]
        self.rank = {(vocab[a], vocab[b]): i for i, (a, b) in enumerate(model["merges"])}
        self.born: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for i, (a, b) in enumerate(model["merges"]):
            made = vocab[a + b]
            self.born[made], self.parts[made] = i, (vocab[a], vocab[b])
        self.find = ahocorasick.Automaton()
        single = set(self.symbol)
        for token, i in vocab.items():
            shown = token.removesuffix(suffix) + END if token.endswith(suffix) else token
            if i in self.born or token.removesuffix(suffix) in single:
                self.find.add_word(shown, (i, len(shown)))
        self.find.make_automaton()
        self.longest = max(map(len, vocab))
        self.goes: dict[int, bool] = {}

    def together(self, x: int, y: int) -> bool:
        """Whether BPE leaves the tokens x, y side by side.

        Undoes their merges from the last to the first. At each step the two symbols at the border
        would merge if their merge came before (on the right side: not after) the one that takes each of them away.
        """
        taken_x = taken_y = NEVER
        while True:
            own = self.rank.get((x, y), NEVER)
            if own < taken_x and own <= taken_y and own < NEVER:
                return False
            bx, by = self.born.get(x, -1), self.born.get(y, -1)
            if bx < 0 and by < 0:
                return True
            if bx > by:
                taken_x, x = bx, self.parts[x][1]
            else:
                taken_y, y = by, self.parts[y][0]

    def table(self, shown: str) -> tuple[list[int], list[int]]:
        """Last token and count of every prefix of a word in symbols (with END: of a whole word)."""
        n = len(shown)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        goes = self.goes
        for at, (token, size) in self.find.iter(shown):
            at += 1
            if last[at] < 0:
                i = at - size
                if i:
                    before = last[i]
                    pair = before << 20 | token
                    fits = goes.get(pair)
                    if fits is None:
                        if len(goes) > 2_000_000:
                            goes.clear()
                        fits = goes[pair] = before >= 0 and self.together(before, token)
                    if fits:
                        last[at] = token
                        count[at] = count[i] + 1
                else:
                    last[at] = token
                    count[at] = 1
        return last, count

    def shown(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join(map(self.symbol.__getitem__, word.encode()))

    def word(self, word: str) -> int:
        return self.table(self.shown(word) + END)[1][-1]

    def __missing__(self, chunk: str) -> int:
        if chunk.isalpha():
            n = self.word(chunk)
        elif chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
            n = self[chunk[:-1]] + self[chunk[-1]]
        else:
            n = sum(self.word(w) if len(w) == len(chunk) else self[w] for w in self.pattern.findall(chunk))
        if len(chunk) <= 48:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = n
        return n

    def chunks(self, text: str) -> list[str]:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # letter by letter: a final sigma must not depend on its place
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # split() takes these for white space, the vocabulary does not
            return [c for c in _SPACE.split(text) if c]
        return text.split()

    def count(self, text: str) -> int:
        if "<|" in text and (found := self.special.findall(text)):
            return len(found) + sum(self.count(part) for part in self.special.split(text))
        return sum(map(self.__getitem__, self.chunks(text)))

    # ---- prefix questions -----------------------------------------------------------------

    def _runs(self, text: str):
        """(start, end, tokens up to there) of every chunk and special string."""
        total = 0
        for m in re.finditer(rf"{self.special.pattern}|(?:(?!{self.special.pattern}){_SPACE.pattern.replace('[', '[^', 1)[:-1]})+", text):
            total += 1 if self.special.fullmatch(m[0]) else sum(map(self.__getitem__, self.chunks(m[0])))
            yield m.start(), m.end(), total

    def running(self, text: str) -> list[tuple[int, int]]:
        """(end in the text, tokens up to there) after every chunk and special string."""
        return [(end, total) for _, end, total in self._runs(text)]

    def prefix_counts(self, word: str) -> list[int]:
        """Tokens of every prefix of a word (by characters), each taken as a text of its own, from one table."""
        shown = self.shown(word)
        last, count = self.table(shown)
        ends = [0] * (len(shown) + 1)
        for at in range(1, len(shown) + 1):
            for i in range(max(0, at - 64), at):
                token, _ = self.find.get(shown[i:at] + END, (None, 0))
                if token is not None and (i == 0 or last[i] >= 0 and self.together(last[i], token)):
                    ends[at] = count[i] + 1
                    break
        places = [0]
        for c in word:
            places.append(places[-1] + len(c.encode()))
        return [ends[p] for p in places]

    def _cut(self, chunk: str, budget: int) -> int:
        """Characters of the longest prefix of a chunk that has at most ``budget`` tokens, if the whole has more.

        Where normalising changes the number of characters nothing is cut.
        """
        if not unicodedata.is_normalized("NFC", chunk) or any(len(c.lower()) != 1 for c in chunk):
            return 0
        for m in self.pattern.finditer("".join(c.lower() for c in chunk)):
            word = m[0][: self.longest * budget + 1]  # more characters take more tokens
            n = self.word(m[0])
            if n > budget:  # what is behind this word has more tokens still
                if word[0] == "'" and len(word) <= 3:  # prefixes of a contraction are two words
                    ends = [sum(map(self.word, self.pattern.findall(word[:i]))) for i in range(len(word))]
                else:
                    ends = self.prefix_counts(word)
                return m.start() + max(i for i, k in enumerate(ends) if k <= budget)
            budget -= n
        return 0

    def fitting(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens, but for white space at its end: whole chunks as
        far as they fit, then as much of the next one as fits (of special strings and of chunks that normalising lengthens or shortens: nothing)."""
        fits = before = 0
        for start, end, total in self._runs(text):
            if total > budget:
                more = 0 if self.special.fullmatch(text[start:end]) else self._cut(text[start:end], budget - before)
                return start + more if more else fits
            fits, before = end, total
        return len(text)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _count(batches, path: str, limit: int, cuts: bool):
    c = counter(path)
    for batch in batches:
        texts = [t.as_py() or "" for t in batch.column(batch.num_columns - 1)]
        n = [c.count(t) for t in texts]
        own = [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
        names = ["n_bytes", "n_tokens", "over_limit"]
        if cuts:
            own.append(pa.array([c.fitting(t, limit) if x > limit else len(t) for t, x in zip(texts, n, strict=True)], pa.int64()))
            names.append("fitting_chars")
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], names=[*batch.schema.names[:-1], *names])


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", cuts: bool = True) -> DataFrame:
    """Per document ``doc_id, n_bytes, n_tokens, over_limit`` and, with ``cuts``, ``fitting_chars``: how many characters of
    the text fit the limit. A null text counts as empty; repeated rows are
    counted each; other columns are ignored. ``path`` is a vocabulary file that every executor can open. No shuffle.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean" + ", fitting_chars long" * cuts
    return rows.mapInArrow(lambda it: _count(it, path, limit, cuts), schema)
