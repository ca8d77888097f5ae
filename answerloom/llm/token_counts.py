"""Exact token counts of texts and of all their prefixes, by dynamic programming over prefixes.

The tokens of a text under byte pair encoding are those of its pieces (the pre-tokens) one after the other, and no
piece crosses white space. In a piece, a sequence of tokens is the encoding of its characters if and only if each
token and each two neighbours encode to themselves. So the last token of every prefix follows from the prefixes
before it: it is the one token that ends there and can stand behind the last token of what is left. The count of a
prefix is one more than that of the rest.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.arrays import flat, slices
from answerloom.session import ship

#: Pieces whose counts a worker keeps; beyond it, it starts anew.
CACHE = 400_000
#: Texts of these characters only are split here, others by the tokenizer's own splitter: for newer characters the
#: tables of two libraries may differ.
_PLAIN = re.compile(r"[^\x20-\x7e\xa1-ɏ]")
#: A word of letters that every normal form keeps and that have one lower-case letter each, and a stop or comma.
_LETTERS_ONLY = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([.,]?)").fullmatch
#: White space as Unicode has it; Python's own split takes four control characters more.
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_MORE = re.compile("[\x1c-\x1f]")
#: Stands for a special token; it holds white space, so that no word equals it.
_SPECIAL = " special "


def _split(text: str) -> list[str]:
    return [w for w in _WHITE.split(text) if w] if _MORE.search(text) else text.split()


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [letters[b] for b in range(256)]


_LETTERS = _byte_letters()


class PrefixCounter:
    """Token counts of pieces and prefixes for one vocabulary file of the `tokenizers` library (BPE, byte letters)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, normal = spec["model"], json.dumps(spec["normalizer"])
        self.lowers = '"Lowercase"' in normal
        splitter = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or splitter["behavior"] != "Removed" or not splitter["invert"]:
            raise ValueError("A byte-level BPE vocabulary whose pattern gives the pieces is expected.")
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.starts = {t[:i] for t in self.ids for i in range(1, len(t) + 1)}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {tuple(p): i for i, p in enumerate(pairs)}
        self.pieces = regex.compile(splitter["pattern"]["Regex"]).findall
        specials = [t["content"] for t in spec["added_tokens"]]
        self.specials = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.follows: dict[int, bool] = {}
        self.of_piece, self.of_word = _Kept(self.piece_count), _Kept(self.word_count)

    def _encode_to_themselves(self, *tokens: str) -> bool:
        """Whether merging the characters of these tokens ends with the tokens."""
        symbols: list[str] = []
        for t in tokens:
            ended = bool(self.end) and t.endswith(self.end)
            letters = list(t.removesuffix(self.end) if ended else t)
            if ended:
                letters[-1] += self.end
            symbols += letters
        ranks = self.ranks
        while len(symbols) > 1:
            best, at = min((ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if best == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return tuple(symbols) == tokens

    def _may_follow(self, before: int, token: int) -> bool:
        """Whether a token can stand behind another one, or at the beginning (before = -1)."""
        key = ((before + 1) << 32) | token
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > 4 * CACHE:
                self.follows.clear()
            pair = (self.tokens[token],) if before < 0 else (self.tokens[before], self.tokens[token])
            self.follows[key] = known = self._encode_to_themselves(*pair)
        return known

    def _inner(self, letters: str) -> tuple[list[int], list[int]]:
        """Last token and token count of each prefix that goes on (so that it has no end mark)."""
        n, ids, starts, follows = len(letters), self.ids, self.starts, self.follows
        lasts, counts = [-1] * (n + 1), [0] * (n + 1)
        for start in range(n):
            before = lasts[start]
            head = (before + 1) << 32
            for stop in range(start + 1, n + 1):
                if lasts[stop] >= 0:  # only one token can end there
                    continue
                text = letters[start:stop]
                token = ids.get(text)
                if token is None:
                    if text not in starts:
                        break
                    continue
                known = follows.get(head | token)
                if known or (known is None and self._may_follow(before, token)):
                    lasts[stop] = token
                    counts[stop] = counts[start] + 1
        return lasts, counts

    def _ended(self, letters: str, stop: int, lasts: list[int], counts: list[int]) -> int:
        """Token count of the prefix of `stop` letters as a piece of its own."""
        if not self.end:
            return counts[stop]
        for start in range(stop):
            token = self.ids.get(letters[start:stop] + self.end)
            if token is not None and self._may_follow(lasts[start], token):
                return counts[start] + 1
        raise ValueError("The vocabulary lacks a single byte.")

    def prefixes(self, piece: str) -> list[int]:
        """Tokens of each prefix of a piece's byte letters (as a piece of its own); the last is the whole piece."""
        letters = piece if piece.isascii() and piece.isprintable() else "".join(_LETTERS[b] for b in piece.encode())
        lasts, counts = self._inner(letters)
        return [self._ended(letters, stop, lasts, counts) for stop in range(1, len(letters) + 1)]

    def piece_count(self, piece: str) -> int:
        letters = piece if piece.isascii() and piece.isprintable() else "".join(_LETTERS[b] for b in piece.encode())
        whole = self.ids.get(letters + self.end)
        if whole is not None and self._may_follow(-1, whole):
            return 1
        return self._ended(letters, len(letters), *self._inner(letters))

    def word_pieces(self, word: str) -> list[str]:
        """Pieces of a word (a run without white space)."""
        simple = _LETTERS_ONLY(word) if self.lowers else None
        if simple:
            letters, mark = simple.groups()
            return [letters.lower(), mark] if mark else [letters.lower()]
        if word.isascii() and word.isprintable():
            return self.pieces(word.lower() if self.lowers else word)
        word = self.library.normalizer.normalize_str(word) if self.library.normalizer else word
        if _PLAIN.search(word):
            return [word[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(word)]
        return self.pieces(word)

    def word_count(self, word: str) -> int:
        if word == _SPECIAL:
            return 1
        return sum(map(self.of_piece.__getitem__, self.word_pieces(word)))

    def words(self, text: str) -> list[str]:
        """Words of a text in order; a special token that the text spells out stands as a word of its own."""
        if not self.specials or not self.specials.search(text):
            return _split(text)
        out: list[str] = []
        for i, part in enumerate(self.specials.split(text)):
            out += ([_SPECIAL] if i else []) + _split(part)
        return out

    def sizes(self, text: str) -> list[int]:
        """Tokens of each word of a text."""
        return list(map(self.of_word.__getitem__, self.words(text)))

    def count(self, text: str) -> int:
        return sum(self.sizes(text))

    def fitting(self, words: list[str], sizes: list[int], limit: int) -> tuple[int, int]:
        """Words that fit the limit whole, and byte letters of the next word that still fit."""
        totals = list(accumulate(sizes))
        whole = bisect_right(totals, limit)
        left = limit - (totals[whole - 1] if whole else 0)
        letters = 0
        for piece in self.word_pieces(words[whole]) if whole < len(words) and words[whole] != _SPECIAL else []:
            inner = self.prefixes(piece)
            if inner[-1] > left:
                return whole, letters + max((i + 1 for i, c in enumerate(inner) if c <= left), default=0)
            left -= inner[-1]
            letters += len(inner)
        return whole, letters


class _Kept(dict):
    """Results of a function by argument, up to CACHE of them."""

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, key: str) -> int:
        if len(self) > CACHE:
            self.clear()
        self[key] = out = self.function(key)
        return out


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each worker process and vocabulary."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(
    docs: DataFrame,
    path: str,
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_prefixes: bool = False,
) -> DataFrame:
    """Exact token counts: id, n_bytes, n_tokens, fit_words, fit_letters, prefix_counts.

    `path` is a vocabulary file that executors can open. No special tokens are added; those that a text spells out
    count as one token each. The first `fit_words` words (runs without white space) fit `limit` tokens whole, and of the
    next word the first `fit_letters` bytes as normalised (both null if all fits). With `with_prefixes`, prefix_counts
    has the count after each word; `within_budget` answers any other limit from it without a tokenizer.

    Nulls: a null text is empty (0 tokens), ids stay as they are. Repeated rows give equal rows. Extra columns are
    ignored. Texts are read whole; a long one is a batch of its own. An empty table gives an empty result.
    """
    schema = "id long, n_bytes long, n_tokens long, fit_words long, fit_letters long, prefix_counts array<int>"

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in slices(batches, "text"):
            totals, whole, rest, prefixes = [], [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                words = own.words(text)
                own_sizes = list(map(own.of_word.__getitem__, words))
                total = sum(own_sizes)
                fit = own.fitting(words, own_sizes, limit) if total > limit else (None, None)
                totals.append(total)
                whole.append(fit[0])
                rest.append(fit[1])
                prefixes.append(list(accumulate(own_sizes)) if with_prefixes else None)
            sizes = np.diff(flat(batch.column(1))[1])
            numbers = [pa.array(x, pa.int64()) for x in (sizes, totals, whole, rest)]
            yield pa.record_batch(
                [batch.column(0), *numbers, pa.array(prefixes, pa.list_(pa.int32()))],
                names=["id", "n_bytes", "n_tokens", "fit_words", "fit_letters", "prefix_counts"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def within_budget(counts: DataFrame, limit: int) -> DataFrame:
    """Words of each text that fit another limit, from stored prefix counts alone."""
    fitting = F.size(F.filter("prefix_counts", lambda c: c <= limit))
    return counts.select("id", "n_tokens", fitting.alias("fit_words"), (F.col("n_tokens") > limit).alias("over_limit"))
