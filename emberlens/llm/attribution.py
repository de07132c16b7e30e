"""Token counts by offset-mapped attribution.

Whole documents are encoded once. The tokens' character spans are interval-joined to the spans of fields or sections, and a token that
crosses a boundary is allocated by a stated rule. So the sections' counts add up to the document's.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

RULES = ("first", "largest", "split")


def load_encoding(ranks_file: str, pattern: str):
    """A tiktoken encoding from a file of ranks, and the byte length of each id's token."""
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def token_spans(text: str, encoding, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each token in characters. A token that begins or ends inside a character covers all of it."""
    data = text.encode()
    ends = np.cumsum(sizes[np.asarray(encoding.encode_ordinary(text), np.int64)])
    if len(data) == len(text):
        return np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends, ends
    first = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    char = np.cumsum(first) - 1  # the character each byte belongs to
    starts = np.concatenate([[0], ends[:-1]])
    return char[starts], char[ends - 1] + 1


def allocate(starts: np.ndarray, ends: np.ndarray, lows: np.ndarray, highs: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Interval join of tokens and sections: tokens allocated to each section, tokens that cross a bound of it, tokens in no section.

    Sections are sorted and disjoint. A token meets the sections it overlaps. Rule 'first': it goes to the first of them; 'largest': to the one
    that holds most of its characters, ties to the first; 'split': to each by its share of the characters that lie in sections.
    """
    n = len(lows)
    a, b = np.searchsorted(highs, starts, "right"), np.searchsorted(lows, ends, "left")  # sections a .. b - 1
    met = np.maximum(b - a, 0)
    token = np.repeat(np.arange(len(starts)), met)
    section = np.repeat(a, met) + np.arange(len(token)) - np.repeat(np.cumsum(met) - met, met)
    overlap = np.minimum(ends[token], highs[section]) - np.maximum(starts[token], lows[section])
    token, section, overlap = (x[overlap > 0] for x in (token, section, overlap))  # empty sections hold nothing
    first = np.ones(len(token), bool)
    first[1:] = token[1:] != token[:-1]
    crossing = np.bincount(section[overlap < (ends - starts)[token]], minlength=n)
    if rule == "first":
        got = np.bincount(section[first], minlength=n).astype(float)
    elif rule == "largest":
        order = np.lexsort((section, -overlap, token))
        t = token[order]
        top = np.ones(len(t), bool)
        top[1:] = t[1:] != t[:-1]
        got = np.bincount(section[order][top], minlength=n).astype(float)
    else:
        got = np.bincount(section, weights=overlap / np.bincount(token, weights=overlap, minlength=len(starts))[token], minlength=n)
    return got, crossing, float(len(starts) - first.sum())


def record_of(docs: DataFrame, parts: list[tuple[str, Column]], separator: str = "\n") -> DataFrame:
    """doc_id, record, sections: the parts joined to one text, null parts as empty, and each part's name and span (characters).

    A part's span takes in the separator behind it, so the spans cover the record.
    """
    values = [F.concat(F.coalesce(v.cast("string"), F.lit("")), F.lit(separator if i + 1 < len(parts) else "")) for i, (_, v) in enumerate(parts)]
    sections, at = [], F.lit(0)
    for (name, _), v in zip(parts, values, strict=True):
        sections.append(F.struct(F.lit(name).alias("name"), at.alias("low"), (at + F.length(v)).alias("high")))
        at = at + F.length(v)
    return docs.select("doc_id", F.concat(*values).alias("record"), F.array(*sections).alias("sections"))


def attribute_tokens(records: DataFrame, ranks_file: str, pattern: str, rule: str = "first") -> DataFrame:
    """(doc_id, record, sections array<struct<name, low, high>>) -> doc_id, section, chars, tokens, crossing, record_tokens; a row per section.

    Sections may leave gaps but not overlap, in any order. tokens: allocated by ``rule``; crossing: tokens that lie in the section only partly;
    record_tokens: of the whole record. A null record is empty and a null or empty list of sections gives no rows. Repeated rows give
    repeated results. A record is encoded whole, in one piece, however long.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = load_encoding(ranks_file, pattern)
        for batch in batches:
            ids, names, chars, tokens, crossing, totals = [], [], [], [], [], []
            for doc_id, text, sections in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sections = sorted(sections or [], key=lambda s: (s["low"], s["high"]))
                starts, ends = token_spans(text or "", encoding, sizes)
                lows, highs = (np.array([s[k] for s in sections], np.int64) for k in ("low", "high"))
                got, crossed, _ = allocate(starts, ends, lows, highs, rule)
                ids += [doc_id] * len(sections)
                names += [s["name"] for s in sections]
                chars += (highs - lows).tolist()
                tokens += got.tolist()
                crossing += crossed.tolist()
                totals += [len(starts)] * len(sections)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(chars, pa.int64()), pa.array(tokens, pa.float64()), pa.array(crossing, pa.int64()), pa.array(totals, pa.int64())],
                ["doc_id", "section", "chars", "tokens", "crossing", "record_tokens"],
            )

    return records.select("doc_id", "record", "sections").mapInArrow(count, "doc_id long, section string, chars long, tokens double, crossing long, record_tokens long")
