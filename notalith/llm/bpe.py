"""Byte-pair encoding and decoding by backtracking over longest matches.

A word is a string of symbols (bytes, the last one marked as a word's end). An Aho-Corasick
style search gives the longest token at each place, and the next shorter one of each token by
its prefix link; a token is taken if it may stand after the one before it, which a table of
compatible pairs remembers, and otherwise the search backs up. A bit for each place stops any
place from being tried twice, so the work is linear. Two tokens are compatible if merging by
rank leaves the border between them alone; that is decided by splitting both back along the
merges. Decoding looks ids up in one buffer by an offset table.

Words repeat, so an encoder keeps what it has found for words in a bounded table.

Null texts count as empty: no ids, and the empty text decoded. Texts of any length are encoded
whole. Repeated rows give repeated results; other columns have no influence.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table

#: Words an encoder remembers, and characters of the longest one that it does.
WORDS, WORD_CHARS = 300_000, 64
#: Pairs that the compatibility table holds.
PAIRS = 2_000_000
#: Characters outside blocks that have been complete for long.
NEWER = regex.compile(r"[^\u0000-\u024F\u0391-\u03C9\u0400-\u045F\u2000-\u206F\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3]")


def byte_symbols() -> dict[int, str]:
    """The visible character by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """Vocabulary and merges of a byte-level BPE whose last symbol of a word may be marked."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        names = [""] * (max(self.vocab.values()) + 1)
        for t, i in self.vocab.items():
            names[i] = t
        marks = [self.spelled(t) for t in names]
        self.split: list[tuple[int, int] | None] = [None] * len(names)
        self.order: dict[tuple[int, int], int] = {}
        self.rank = [-1] * len(names)
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            t, ia, ib = self.vocab[a + b], self.vocab[a], self.vocab[b]
            if self.split[t] is None:
                self.split[t], self.rank[t] = (ia, ib), r
            self.order.setdefault((ia, ib), r)
        self.auto = ahocorasick.Automaton()
        by = {s: i for i, s in enumerate(marks) if s and self.sound(i)}
        for s, i in by.items():
            self.auto.add_word(s, i)
        self.length = [len(s) for s in marks]
        self.auto.make_automaton()
        #: The longest token that is a proper prefix of each token, or -1.
        self.shorter = [next((by[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in by), -1) for s in marks]
        self.compatible: dict[tuple[int, int], bool] = {}
        self.names = names
        self.data = "".join(names).encode()
        self.offsets = np.cumsum([0, *(len(n.encode()) for n in names)])

    def spelled(self, token: str) -> str:
        """A token as symbols: its characters, the last moved to a plane of its own if it ends a word."""
        if self.suffix and token.endswith(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + 0x10000) if body else ""
        return token

    def crossed(self, left: int, right: int, limit: int) -> bool:
        """Whether merging in order of rank, up to limit, joins something across the border of two tokens.

        The merges that made the two are undone at the border from the last to the first; before
        each of them a merge across the border must not have come first. Of equal ranks the
        leftmost comes first, so only a merge on the right yields to its equal.
        """
        while True:
            if self.order.get((left, right), limit) < limit:
                return True
            if self.rank[left] > self.rank[right]:
                limit, left = self.rank[left], self.split[left][1]
            elif self.rank[right] >= 0:
                limit, right = self.rank[right] + 1, self.split[right][0]
            else:
                return False

    def fits(self, a: int, b: int) -> bool:
        """Whether b after a is left as it is."""
        key = (a, b)
        if (known := self.compatible.get(key)) is None:
            if len(self.compatible) >= PAIRS:
                self.compatible.clear()
            known = self.compatible[key] = not self.crossed(a, b, len(self.names))
        return known

    def longest(self, s: str) -> list[int]:
        """For each place of s the longest token that starts there."""
        found, size = [-1] * len(s), [0] * len(s)
        for end, i in self.auto.iter(s):
            n = self.length[i]
            at = end - n + 1
            if n > size[at]:
                found[at], size[at] = i, n
        return found

    def encode(self, s: str) -> list[int]:
        """The ids of a word of symbols."""
        if (whole := self.auto.get(s, -1)) >= 0:
            return [whole]
        # the search's first choices throughout; where they suit each other it would change nothing
        greedy = [i for _, i in self.auto.iter_long(s)]
        if sum(map(self.length.__getitem__, greedy)) == len(s) and all(map(self.fits, greedy, greedy[1:])):
            return greedy
        longest, n = self.longest(s), len(s)
        dead = bytearray(n + 1)
        out: list[int] = []
        pos, token = 0, longest[0] if s else -1
        while pos < n:
            prior = out[-1] if out else -1
            while token >= 0:
                end = pos + self.length[token]
                if not dead[end] and (prior < 0 or self.fits(prior, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                pos = end
                token = longest[pos] if pos < n else -1
            else:
                dead[pos] = 1
                if not out:
                    raise ValueError("the vocabulary lacks a symbol")
                last = out.pop()
                pos -= self.length[last]
                token = self.shorter[last]
        return out

    def sound(self, token: int) -> bool:
        """Whether merging makes a token's symbols into that token."""
        parts = self.split[token]
        return parts is None or (self.sound(parts[0]) and self.sound(parts[1]) and not self.crossed(*parts, self.rank[token]))

    def token(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].decode()


class WordCoder:
    """Encoder and decoder of a vocabulary whose words end in a mark."""

    def __init__(self, spec: dict):
        self.spec, self.library = spec, None
        self.merges = Merges(spec)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names = {i: t for t, i in self.special.items()}
        steps = spec["normalizer"]["normalizers"] if spec.get("normalizer") else []
        self.kinds = [x["type"] for x in steps]
        if self.kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"normalizers not known: {self.kinds}")
        if steps[1]["pattern"] != {"Regex": r"\s+"} or steps[1]["content"] != " ":
            raise ValueError("only white space may be replaced, by a space")
        parts = spec["pre_tokenizer"]["pretokenizers"]
        self.word = regex.compile(parts[0]["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.symbols = byte_symbols()
        self.known: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def normalised(self, text: str) -> str:
        """NFC and lower case; white space may stay, as it only ends words however much of it there is."""
        text = unicodedata.normalize("NFC", text)
        if text.isascii():
            return text.lower()
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def symbols_of(self, word: str) -> str:
        return "".join([self.symbols[b] for b in word.encode("utf-8", "replace")])

    def spell(self, symbols: str) -> tuple[str, str]:
        """The ids and the tokens of a word of symbols, each joined by a space."""
        if self.merges.suffix:
            symbols = symbols[:-1] + chr(ord(symbols[-1]) + 0x10000)
        ids = self.merges.encode(symbols)
        return " ".join(map(str, ids)), " ".join(map(self.merges.token, ids))

    def of(self, word: str) -> tuple[str, str]:
        """spell(), remembered in two generations: what the older one has not given for long goes."""
        got = self.older.get(word) or self.spell(self.symbols_of(word))
        if len(word) <= WORD_CHARS:
            if len(self.known) >= WORDS:
                self.known, self.older = {}, self.known
            self.known[word] = got
        return got

    def rare(self, text: str) -> list[tuple[str, str]]:
        """The words of a text with letters that Unicode's versions class differently, cut by the library."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(json.dumps(self.spec))
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [self.spell(w) for w, _ in cut]

    def encode(self, text: str) -> tuple[int, str, str]:
        """Number of ids, ids joined by a space, and the decoded text."""
        found: list[tuple[str, str]] = []
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.special:
                found.append((str(self.special[piece]), piece))
            elif NEWER.search(piece):
                found += self.rare(piece)
            else:
                words = self.word.findall(self.normalised(piece))
                got = list(map(self.known.get, words))
                if None in got:
                    got = [g or self.of(w) for g, w in zip(got, words, strict=True)]
                found += got
        if not found:
            return 0, "", ""
        ids, tokens = map(" ".join, zip(*found, strict=True))
        return ids.count(" ") + 1, ids, tokens

    def decode(self, ids: list[int]) -> str:
        """The tokens of ids joined by a space, as a vocabulary without a decoder has it."""
        return " ".join(self.names.get(i) or self.merges.token(i) for i in ids)


def load_spec(path: str) -> dict:
    return json.loads(Path(path).read_text())


_coders: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    """One coder a worker process and vocabulary."""
    if path not in _coders:
        _coders[path] = WordCoder(load_spec(path))
    return _coders[path]


def encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    c = coder(path)
    sha = lambda t: hashlib.sha256(t.encode("utf-8", "replace")).hexdigest()
    for b in batches:
        n, ids, decoded = [], [], []
        for t in b.column("text"):
            count, i, d = c.encode(t.as_py() or "")
            n.append(count)
            ids.append(sha(i))
            decoded.append(sha(d))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda b: encode_batches(b, path), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_table(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
