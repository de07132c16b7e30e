"""Byte-level BPE by recursive DuckDB queries in each partition.

A text is cut into pieces by the vocabulary's pattern. A task's distinct pieces become token-position rows, one for each byte. A recursive
query joins neighbouring rows with the merge table and contracts, in every piece at once, the pair of lowest rank, leftmost first, until no
piece has a pair left. Decoding joins ids with the vocabulary and aggregates the tokens' bytes in order.

A long piece is first cut between neighbouring bytes that no token has side by side: no merge can cross such a place, so its parts contract
on their own. A part that is still long is contracted in windows, whose joints are then mended until each two neighbouring tokens are what they
contract to: that makes the whole what the piece contracts to.

The merge table holds every way to cut a vocabulary token into two; a pair's rank is the rank of what it makes.
"""

from __future__ import annotations

import base64
import hashlib
import tempfile
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from emberlens.llm.batches import slices

#: Distinct pieces whose ids a Python worker keeps over its tasks; when there are more, it goes on with the third that came most often. A bound on memory alone.
CACHED_PIECES = 300_000
#: Bytes of texts that are Python strings at a time, bytes of new pieces in one query, and tokens in one decoding query. Bounds on memory alone.
SLICE_BYTES, QUERY_BYTES, DECODE_TOKENS = 2_000_000, 250_000, 100_000

#: Pieces of more bytes are cut into parts, and parts of more bytes into windows of so many. The tokens don't depend on either.
SHORT_PIECE, WINDOW = 64, 32

#: Each step contracts the leftmost pair of lowest rank of every piece. k = piece * 2^22 + position; best = made * 2^46 + k.
ENCODE = """
WITH RECURSIVE steps(k, tok, step) AS (
    SELECT k, tok, 0 FROM bytes_of
  UNION ALL
    SELECT k, CASE WHEN k = best & 70368744177663 THEN (best >> 46)::INT ELSE tok END, step + 1 FROM (
        SELECT s.k, s.tok, s.step, b.best, lag(s.k) OVER (ORDER BY s.k) AS before FROM steps s JOIN (
            SELECT k >> 22 AS w, min((m.made::BIGINT << 46) + k) AS best FROM (
                SELECT k, tok, CASE WHEN lead(k) OVER (ORDER BY k) >> 22 = k >> 22 THEN lead(tok) OVER (ORDER BY k) END AS after FROM steps
            ) p JOIN merges m ON m.head = p.tok AND m.tail = p.after GROUP BY 1
        ) b ON b.w = s.k >> 22
    ) WHERE before IS NULL OR before <> best & 70368744177663
)
SELECT s.tok FROM steps s JOIN (SELECT k >> 22 AS w, max(step) AS last FROM steps GROUP BY 1) f ON f.w = s.k >> 22 AND f.last = s.step ORDER BY s.k
"""
#: The same, with all non-overlapping places of the lowest pair at once: few steps, dearer ones. k = piece * 2^40 + position.
ENCODE_LONG = """
WITH RECURSIVE bytes_in AS (SELECT k >> 40 AS w, k & 1099511627775 AS pos, tok FROM bytes_of), steps(w, pos, tok, step) AS (
    SELECT w, pos, tok, 0 FROM bytes_in
  UNION ALL
    SELECT w, pos, CASE WHEN merged THEN made ELSE tok END, step + 1 FROM (
        SELECT *, coalesce(lag(merged) OVER places, false) AS eaten FROM (
            SELECT *, made IS NOT NULL AND made = least_made
                      AND (n - coalesce(max(CASE WHEN made IS DISTINCT FROM least_made THEN n END) OVER (PARTITION BY w ORDER BY n), 0)) % 2 = 1 AS merged FROM (
                SELECT p.*, m.made, min(m.made) OVER (PARTITION BY p.w) AS least_made FROM (
                    SELECT w, pos, tok, step, lead(tok) OVER places AS after, row_number() OVER places AS n FROM steps WINDOW places AS (PARTITION BY w ORDER BY pos)
                ) p LEFT JOIN merges m ON m.head = p.tok AND m.tail = p.after
            ) WHERE least_made IS NOT NULL
        ) WINDOW places AS (PARTITION BY w ORDER BY n)
    ) WHERE NOT eaten
)
SELECT tok FROM (SELECT *, max(step) OVER (PARTITION BY w) AS last FROM steps) WHERE step = last ORDER BY w, pos
"""
DECODE = "SELECT t.doc, string_agg(v.shown, '' ORDER BY t.pos) AS shown FROM tokens t JOIN vocabulary v ON v.id = t.id GROUP BY t.doc ORDER BY t.doc"


def read_ranks(ranks_file: str) -> dict[bytes, int]:
    with open(ranks_file, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Numbering(dict):
    """Numbers its keys as they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` with these starts and sizes, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def pairs_of(data: np.ndarray) -> np.ndarray:
    """A number for each pair of neighbouring bytes."""
    return data[:-1].astype(np.int32) * 256 + data[1:]


class Coder:
    """A Python worker's DuckDB with the merge table and the vocabulary."""

    def __init__(self, ranks_file: str, pattern: str):
        self.ranks, self.split = read_ranks(ranks_file), regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens, self.stable = {rank: token for token, rank in self.ranks.items()}, {}
        self.token_bytes = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.adjoin = np.zeros(65536, bool)  # pairs of bytes that some token has side by side
        for token, rank in self.ranks.items():
            self.token_bytes[rank] = len(token)
            self.adjoin[pairs_of(np.frombuffer(token, np.uint8))] = True
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "preserve_insertion_order": True, "temp_directory": tempfile.mkdtemp(prefix="bpe-spill-")})
        merges = [(self.ranks[t[:i]], self.ranks[t[i:]], made) for t, made in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        head, tail, made = (pa.array(x, pa.int32()) for x in zip(*merges, strict=True))
        self._table("merges", pa.table({"head": head, "tail": tail, "made": made}))
        # a byte is shown as the character of its number, so that string_agg can gather bytes
        shown = [t.decode("latin-1") for t in self.ranks]
        self._table("vocabulary", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "shown": pa.array(shown, pa.string())}))
        self.numbers, self.starts, self.sizes, self.uses, self.flat = Numbering(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _forget(self) -> None:
        """Keeps the pieces that came most often, those that came once not."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: CACHED_PIECES // 3])
        kept, pieces = kept[self.uses[kept] > 1], list(self.numbers)
        self.numbers = Numbering((pieces[i], n) for n, i in enumerate(kept))
        self.flat, self.sizes, self.uses = gather(self.flat, self.starts[kept], self.sizes[kept]), self.sizes[kept], self.uses[kept]
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _contract(self, pieces: list[bytes], query: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one after the other, and how many each has."""
        flat, counts, at = [], [], 0
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        shift = 40 if query is ENCODE_LONG else 22
        while at < len(pieces):
            stop = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), QUERY_BYTES, "right")))
            n = sizes[at:stop]
            joined = np.frombuffer(b"".join(pieces[at:stop]), np.uint8)
            k = np.repeat((np.arange(len(n)) << shift) - (np.cumsum(n) - n), n) + np.arange(len(joined))
            self._table("bytes_of", pa.table({"k": k, "tok": self.byte_ids[joined]}))
            ids = self.db.sql(query).to_arrow_table().column("tok").to_numpy().astype("<u4")
            ends = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum(n)) + 1  # a piece ends where its bytes do
            flat.append(ids)
            counts.append(np.diff(ends, prepend=0))
            at = stop
        return np.concatenate([np.zeros(0, "<u4"), *flat]), np.concatenate([np.zeros(0, np.int64), *counts])

    def _contract_long(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for long pieces, by their parts; parts that repeat are contracted once."""
        number, owners = Numbering(), []
        for piece in pieces:
            cuts = np.flatnonzero(~self.adjoin[pairs_of(np.frombuffer(piece, np.uint8))]) + 1
            owners.append(np.fromiter((number[piece[a:b]] for a, b in zip([0, *cuts], [*cuts, len(piece)], strict=True)), np.int64, len(cuts) + 1))
        parts, starts, sizes, flats, base = list(number), np.zeros(len(number), np.int64), np.zeros(len(number), np.int64), [], 0
        long = np.fromiter((len(p) > SHORT_PIECE for p in parts), bool, len(parts))
        for at, work in ((np.flatnonzero(~long), self._contract_short), (np.flatnonzero(long), self._contract_by_windows)):
            ids, counts = work([parts[i] for i in at])
            starts[at], sizes[at] = base + np.cumsum(counts) - counts, counts
            base += len(ids)
            flats.append(ids)
        whole = [np.zeros(0, np.int64), *owners]
        return gather(np.concatenate(flats), starts[np.concatenate(whole)], sizes[np.concatenate(whole)]), np.array([sizes[o].sum() for o in owners], np.int64)

    def _contract_short(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self._contract(pieces, ENCODE)

    def _contract_each(self, pieces: list[bytes], query: str) -> list[list[int]]:
        ids, counts = self._contract(pieces, query)
        return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if pieces else []

    def _holds(self, pairs: list[tuple[int, int]]) -> list[bool]:
        """Whether two tokens side by side contract to themselves; kept for every pair that was asked for."""
        new = list({p for p in pairs if p not in self.stable})
        if len(self.stable) + len(new) > CACHED_PIECES:
            self.stable, new = {}, list(set(pairs))
        for pair, got in zip(new, self._contract_each([self.tokens[a] + self.tokens[b] for a, b in new], ENCODE), strict=True):
            self.stable[pair] = got == list(pair)
        return [self.stable[p] for p in pairs]

    def _contract_by_windows(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Contracts windows of the pieces on their own, then mends the joints between them.

        Tokens t1 t2 ... are the right ones when every two neighbours contract to themselves: the first merge across a joint would also be made in
        those two tokens alone, as what else goes on in them doesn't depend on the rest. So only joints are looked at: where two tokens don't
        hold, a stretch around the joint is contracted anew, twice as wide each round, until all its new joints hold.
        """
        distinct, tokens, open_, own = Numbering(), [], [], []  # open_[i]: the joint behind token i is not known to hold; own: its piece
        which = [[distinct[piece[i : i + WINDOW]] for i in range(0, len(piece), WINDOW)] for piece in pieces]
        made = self._contract_each(list(distinct), ENCODE)
        for n, windows in enumerate(which):
            for w in windows:
                open_ += [False] * (len(made[w]) - 1) + [True]
                tokens += made[w]
            open_[-1] = False
            own += [n] * (len(tokens) - len(own))
        tried, reach = set(), 1
        while True:
            at = [i for i, o in enumerate(open_) if o]
            bad = [i for i, ok in zip(at, self._holds([(tokens[i], tokens[i + 1]) for i in at]), strict=True) if not ok]
            if not bad:
                break
            open_ = [False] * len(open_)
            ends = np.searchsorted(own, np.arange(len(pieces) + 1))
            spans: list[list[int]] = []
            for i in bad:
                low, high = max(int(ends[own[i]]), i + 1 - reach), min(int(ends[own[i] + 1]), i + 1 + reach)
                if spans and low <= spans[-1][1] and own[spans[-1][0]] == own[i]:
                    spans[-1][1] = high
                else:
                    spans.append([low, high])
            held = [b"".join(self.tokens[t] for t in tokens[low:high]) for low, high in spans]
            # a stretch of many bytes is contracted in few steps, which may go wrong where a made pair comes before what made it: all its joints are looked at
            sure = [len(h) <= 8 * WINDOW or h in tried for h in held]
            tried.update(h for h in held if len(h) > 8 * WINDOW)
            new: list[list[int]] = [[]] * len(held)
            for query, mine in ((ENCODE, [j for j, ok in enumerate(sure) if ok]), (ENCODE_LONG, [j for j, ok in enumerate(sure) if not ok])):
                for j, got in zip(mine, self._contract_each([held[j] for j in mine], query), strict=True):
                    new[j] = got
            next_tokens, next_open, next_own, done = [], [], [], 0
            for (low, high), got, ok in zip(spans, new, sure, strict=True):
                next_tokens += tokens[done:low] + got
                next_open += open_[done:low] + [not ok] * (len(got) - 1) + [high < ends[own[low] + 1]]
                next_own += own[done:low] + [own[low]] * len(got)
                if low > ends[own[low]]:
                    next_open[-len(got) - 1] = True
                done = high
            tokens, open_, own, reach = next_tokens + tokens[done:], next_open + open_[done:], next_own + own[done:], reach * 2
        return np.array(tokens, "<u4"), np.bincount(own, minlength=len(pieces)).astype(np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        """Ids of new pieces: a piece that is a token is that token, as in the tiktoken library."""
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        long = np.fromiter((len(p) > SHORT_PIECE for p in pieces), bool, len(pieces))
        starts, sizes, base, flats = np.zeros(len(pieces), np.int64), np.ones(len(pieces), np.int64), len(self.flat), [self.flat]
        known = lambda at: (whole[at].astype("<u4"), sizes[at])
        short = lambda at: self._contract_short([pieces[i] for i in at])
        by_parts = lambda at: self._contract_long([pieces[i] for i in at])
        for at, work in ((np.flatnonzero(whole >= 0), known), (np.flatnonzero((whole < 0) & ~long), short), (np.flatnonzero((whole < 0) & long), by_parts)):
            ids, counts = work(at)
            starts[at], sizes[at] = base + np.cumsum(counts) - counts, counts
            base += len(ids)
            flats.append(ids)
        self.starts, self.sizes, self.flat = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes]), np.concatenate(flats)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.numbers) > CACHED_PIECES:
            self._forget()
        number, known = self.numbers.__getitem__, len(self.numbers)
        cut = [np.fromiter(map(number, self.split.findall(t)), np.int64) for t in texts]
        if len(self.numbers) > known:
            self._learn([p.encode() for p in islice(self.numbers, known, None)])
        self.uses = np.bincount(np.concatenate([np.zeros(0, np.int64), *cut]), minlength=len(self.numbers)) + np.pad(self.uses, (0, len(self.numbers) - len(self.uses)))
        return [gather(self.flat, self.starts[n], self.sizes[n]) for n in cut]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(ids):
            stop, total = at, 0
            while stop < len(ids) and (stop == at or total + len(ids[stop]) <= DECODE_TOKENS):
                total += len(ids[stop])
                stop += 1
            sizes = np.array([len(x) for x in ids[at:stop]])
            flat = np.concatenate(ids[at:stop]).astype(np.int32)
            rows = pa.table({"doc": np.repeat(np.arange(stop - at, dtype=np.int32), sizes), "pos": np.arange(len(flat), dtype=np.int32), "id": flat})
            self.db.register("tokens", rows)
            got = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("tokens")
            part = [b""] * (stop - at)
            for doc, shown in zip(got.column("doc").to_pylist(), got.column("shown").to_pylist(), strict=True):
                part[doc] = shown.encode("latin-1")
            out += part
            at = stop
        return out


@lru_cache(maxsize=1)
def coder_of(ranks_file: str, pattern: str) -> Coder:
    """The worker's coder: tasks that Spark gives to one worker share its tables and what it has learnt."""
    return Coder(ranks_file, pattern)


def encode_documents(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, ids array<int>: a row for each document.

    A null text is an empty one; an empty one has no ids. A text is encoded whole, in one piece. Repeated rows give repeated results, an
    empty table none; other columns are ignored. ``ranks_file`` must be readable on the executors; it is a parameter, never copied.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for big in batches:
            for batch in slices(big, most=SLICE_BYTES):
                coder = coder or coder_of(ranks_file, pattern)
                ids = coder.encode([t or "" for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids)], ["doc_id", "ids"])
                pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, ids array<int>")


def _lists(ids: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)), pa.array(flat))


def decode_documents(encoded: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """(doc_id, ids) -> doc_id, ids, decoded binary. Null ids are no ids. Ids outside the vocabulary raise an error."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or coder_of(ranks_file, pattern)
            ids = [np.array(x or [], "<u4") for x in batch.column(1).to_pylist()]
            if any(len(x) and int(x.max()) >= len(coder.ranks) for x in ids):
                raise ValueError("an id is not in the vocabulary")
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids), pa.array(coder.decode(ids), pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, ranks_file: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """Encode and decode in one pass over the texts: doc_id, n_tokens, ids_sha256 (little-endian uint32), decoded_sha256; a row for each document.

    A null text is an empty one; an empty one has 0 tokens and the digests of nothing. A text is encoded whole, however long. Repeated rows
    give repeated results, an empty table none; other columns are ignored, whatever their names, but for those in ``keep``, which stand behind the results. The digest of the decoded bytes is that of the text.
    """

    kept = docs.select(*(keep or [])).dtypes
    kept_names = [c for c, _ in kept]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for big in batches:
            for batch in slices(big, most=SLICE_BYTES):
                coder = coder or coder_of(ranks_file, pattern)
                ids = coder.encode([t or "" for t in batch.column(1).to_pylist()])
                back = coder.decode(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()), *batch.columns[2:],
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *kept_names],
                )
                pa.default_memory_pool().release_unused()  # else the pool holds what earlier batches took, beside a full JVM heap

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", {c} {kind}" for c, kind in kept)
    return docs.select("doc_id", "text", *kept_names).mapInArrow(work, schema)
