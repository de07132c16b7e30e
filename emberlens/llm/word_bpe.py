"""BPE with word ends: a priority queue of merge ranks over a doubly linked list of symbols; decoding concatenates vocabulary strings.

A text is cut at the file's added tokens, normalised (NFC, runs of white space to one space, lower case) and split into words by the file's
pattern. A word's symbols are its bytes, the last one with the mark of a word's end. The pair of lowest rank, leftmost first, is merged until none is left:
each merge unlinks one symbol and queues the pairs that it makes; queued pairs whose symbols have changed meanwhile are skipped when they come up.
A Python worker contracts each distinct word once and keeps the ids of up to CACHED_PIECES.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from emberlens.llm.batches import slices
from emberlens.llm.bpe import Numbering, gather

#: Distinct words whose ids a Python worker keeps over its tasks; when there are more, it starts over. A bound on memory alone.
CACHED_PIECES = 600_000
#: Words of more characters are contracted anew each time. A bound on memory alone.
LONGEST_KEPT = 256
PLACE = (1 << 40) - 1


def byte_letters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others in order from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(others)) for b in range(256)]


class WordCoder:
    """A Python worker's vocabulary, merges, and the words that it has contracted."""

    def __init__(self, tokenizer_file: str):
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        model, kinds = spec["model"], [x["type"] for x in spec["normalizer"]["normalizers"]]
        cut, spelled = spec["pre_tokenizer"]["pretokenizers"]
        known = model["type"] == "BPE" and kinds == ["NFC", "Replace", "Lowercase"] and (cut["behavior"], cut["invert"], spelled["type"], spelled["use_regex"]) == ("Removed", True, "ByteLevel", False)
        if not known or spec["decoder"] or model["dropout"] or model["unk_token"] or model["ignore_merges"] or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{tokenizer_file} is no lower-case BPE of words with ends")
        self.file, self.split, vocab = tokenizer_file, regex.compile(cut["pattern"]["Regex"]), model["vocab"]
        end = model["end_of_word_suffix"]
        self.inner, self.last = ([vocab[c + tail] for c in byte_letters()] for tail in ("", end))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = [vocab[a + b] for a, b in pairs]
        self.rank = {vocab[a] << 32 | vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.assigned: set[str] = set()  # characters that have come up
        tokens = {i: t for t, i in {**vocab, **self.special}.items()}
        self.known = np.zeros(max(tokens) + 1, bool)
        self.known[list(tokens)] = True
        self.words, self.word_starts, self.word_sizes = self._strings([tokens.get(i, "") for i in range(len(self.known))])
        self.numerals, self.numeral_starts, self.numeral_sizes = self._strings([str(i) for i in range(len(self.known))])
        self._forget()

    @staticmethod
    def _strings(each: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The strings' bytes, each with a space behind it, and where they begin and how many they are."""
        data = [f"{s} ".encode() for s in each]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        return np.frombuffer(b"".join(data), np.uint8), np.cumsum(sizes) - sizes, sizes

    def _forget(self) -> None:
        self.numbers, self.starts, self.sizes, self.flat = Numbering(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def contract(self, word: bytes) -> list[int]:
        """Ids of one word."""
        symbols = [self.inner[b] for b in word]
        symbols[-1] = self.last[word[-1]]
        n, rank, made = len(symbols), self.rank, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [r << 40 | i for i in range(n - 1) if (r := rank.get(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapify(queue)
        while queue:
            top = heappop(queue)
            i, r = top & PLACE, top >> 40
            j = after[i]
            if symbols[i] < 0 or j == n or rank.get(symbols[i] << 32 | symbols[j]) != r:
                continue  # stale: one of the two symbols has been merged since
            symbols[i], symbols[j] = made[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(symbols[i] << 32 | symbols[k])) is not None:
                    heappush(queue, r << 40 | i)
            p = before[i]
            if p >= 0 and (r := rank.get(symbols[p] << 32 | symbols[i])) is not None:
                heappush(queue, r << 40 | p)
        return [s for s in symbols if s >= 0]

    def _split(self, text: str) -> list[str]:
        """Words of a stretch without added tokens."""
        if text.isascii():
            return self.split.findall(text.lower())
        new = set(text) - self.assigned
        if any(unicodedata.category(c) == "Cn" for c in new):  # not in this Python's Unicode tables: the library's own decide on such a text
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(self.file)
            plain = library.normalizer.normalize_str(text)
            return [plain[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(plain)]
        self.assigned |= new
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # a sigma at a word's end is one like any other
        return self.split.findall(text.lower())  # white space only parts words, so its runs can stay as they are

    def split_text(self, text: str) -> list[str]:
        """Words in order; an added token has a space before it, as no word has."""
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [*self._split(text[at : m.start()]), " " + m[0]]
            at = m.end()
        return out + self._split(text[at:])

    def _ids_of(self, word: str) -> list[int]:
        return [self.special[word[1:]]] if word[0] == " " else self.contract(word.encode())

    def _learn(self, words: list[str]) -> None:
        ids = [self._ids_of(w) if w else [] for w in words]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), "<u4", int(sizes.sum()))])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.numbers) > CACHED_PIECES:
            self._forget()
        number, known, out = self.numbers.__getitem__, len(self.numbers), []
        split = [self.split_text(t) for t in texts]
        long = [[(i, w) for i, w in enumerate(words) if len(w) > LONGEST_KEPT] for words in split]
        for words, those in zip(split, long, strict=True):
            for i, _ in those:
                words[i] = ""  # stands for a long word
        cut = [np.fromiter(map(number, words), np.int64, len(words)) for words in split]
        if len(self.numbers) > known:
            self._learn(list(islice(self.numbers, known, None)))
        for n, those in zip(cut, long, strict=True):
            if not those:
                out.append(gather(self.flat, self.starts[n], self.sizes[n]))
                continue
            parts, at = [], 0
            for i, w in those:
                parts += [gather(self.flat, self.starts[n[at:i]], self.sizes[n[at:i]]), np.array(self._ids_of(w), "<u4")]
                at = i + 1
            out.append(np.concatenate([*parts, gather(self.flat, self.starts[n[at:]], self.sizes[n[at:]])]))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The ids' vocabulary strings, a space between them, as UTF-8: the library's rule where a file has no decoder."""
        if len(ids) and (int(ids.max()) >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return gather(self.words, self.word_starts[ids], self.word_sizes[ids]).tobytes()[:-1]

    def spelled(self, ids: np.ndarray) -> bytes:
        """Decimal ids with a space between them."""
        return gather(self.numerals, self.numeral_starts[ids], self.numeral_sizes[ids]).tobytes()[:-1]


@lru_cache(maxsize=1)
def word_coder(tokenizer_file: str) -> WordCoder:
    """The worker's coder: tasks that Spark gives to one worker share what it has learnt."""
    return WordCoder(tokenizer_file)


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer_file: str) -> Iterator[tuple[pa.Array, list[np.ndarray], WordCoder]]:
    for big in batches:
        for batch in slices(big):
            coder = word_coder(tokenizer_file)
            yield batch.column(0), coder.encode([t or "" for t in batch.column(1).to_pylist()]), coder


def _lists(ids: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, "<u4"), *ids]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)), pa.array(flat))


def encode_words(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, ids array<int>: a row for each document.

    Ids are those of the tokenizers library without special tokens around the text; the file's added tokens inside a text become their ids, as there. A null
    text is an empty one; empty texts and texts of white space have no ids. Texts are encoded whole, however long. Repeated rows give repeated results, an
    empty table none; other columns are ignored, whatever their names. ``tokenizer_file`` must be readable on the executors.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids, _ in _encoded(batches, tokenizer_file):
            yield pa.RecordBatch.from_arrays([doc_id, _lists(ids)], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, ids array<int>")


def decode_words(encoded: DataFrame, tokenizer_file: str) -> DataFrame:
    """(doc_id, ids, ...) -> doc_id, ids, decoded string: vocabulary strings, a space between them. Null ids are no ids; ids outside the vocabulary, nulls among them, raise an error."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coder, ids = word_coder(tokenizer_file), []
            for x in batch.column(1).to_pylist():
                if x and any(i is None or i < 0 for i in x):
                    raise ValueError("an id is not in the vocabulary")
                ids.append(np.array(x or [], "<u4"))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids), pa.array([coder.decode(x).decode() for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, ids array<int>, decoded string")


def word_round_trip(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Encode and decode in one pass over the texts: doc_id, n_tokens, ids_sha256 (decimal ids, a space between them), decoded_sha256; a row for each document.

    Odd rows as in ``encode_words``; a text without ids has 0 tokens and the digests of nothing.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda each: pa.array([hashlib.sha256(x).hexdigest() for x in each], pa.string())
        for doc_id, ids, coder in _encoded(batches, tokenizer_file):
            yield pa.RecordBatch.from_arrays(
                [doc_id, pa.array([len(x) for x in ids], pa.int64()), digest(map(coder.spelled, ids)), digest(map(coder.decode, ids))],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
