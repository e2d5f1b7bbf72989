"""Byte-level BPE by DuckDB inside each Spark task: recursive queries contract pairs, ordered aggregation decodes.

The rank file and the split pattern define the vocabulary; ids are ranks. Distinct matches of the pattern become
token-position rows. A recursive query joins neighbours with the merge table and contracts each word's leftmost
minimum-rank pair until no pair is left. A text's ids are those of its matches in order.

A word of more than ``LONG`` bytes is cut where two bytes meet that stand side by side in no token, as no merge crosses
there. What is still longer has a query of its own, which contracts all places of the minimum-rank pair in one round (none
can beat it later, as every token of a rank file contracts to itself). Either query takes a bounded number of bytes and runs
a bounded number of rounds at a time, as a recursive query keeps the rows of all its rounds: they stay within ``ROWS``.

Null texts count as empty. Texts and words of any length are encoded whole; any bytes that the ids stand for decode to
themselves. An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_map, slices, utf8
from .tokens import TOKEN_SLICE, Recent, chunks

#: A word's best pair as one number: rank times _PLACES plus position.
_PLACES = 1 << 28
ROUND_BYTES = 1 << 18
LONG = 64
ROWS = 1 << 20

_CONTRACT = f"""
WITH RECURSIVE step(word, round, pos, id) AS (
  SELECT word, 0, pos, id FROM seed
  UNION ALL
  SELECT s.word, s.round + 1, CASE WHEN s.pos > b.best % {_PLACES} THEN s.pos - 1 ELSE s.pos END, CASE WHEN s.pos = b.best % {_PLACES} THEN (b.best // {_PLACES})::INT ELSE s.id END
  FROM step s JOIN (
    SELECT p.word, min(m.rank * {_PLACES} + p.pos) AS best
    FROM step p JOIN step q ON q.word = p.word AND q.pos = p.pos + 1 JOIN merges m ON m.pair = p.id::BIGINT * 65536 + q.id
    WHERE p.round < $rounds GROUP BY p.word) b ON s.word = b.word
  WHERE s.pos <> b.best % {_PLACES} + 1),
last AS (SELECT word, max(round) AS round FROM step GROUP BY word)
SELECT s.word, s.pos, s.id FROM step s JOIN last l ON s.word = l.word AND s.round = l.round
"""
#: Of pairs that overlap, as in a run of one letter, every second is taken, from the left.
_CONTRACT_LONG = """
WITH RECURSIVE step(word, round, pos, id) AS (
  SELECT word, 0, pos, id FROM seed
  UNION ALL
  SELECT word, round + 1, pos, CASE WHEN taken THEN best ELSE id END
  FROM (
    SELECT *, lag(taken, 1, false) OVER (PARTITION BY word ORDER BY pos) AS gone
    FROM (
      SELECT *, coalesce(rank = best, false) AND (pos - coalesce(max(CASE WHEN rank IS DISTINCT FROM best THEN pos END) OVER (PARTITION BY word ORDER BY pos ROWS UNBOUNDED PRECEDING), 0)) % 2 = 1 AS taken
      FROM (
        SELECT p.*, m.rank, min(m.rank) OVER (PARTITION BY word) AS best
        FROM (SELECT word, round, row_number() OVER w AS pos, id, lead(id) OVER w AS follower FROM step WHERE round < $rounds WINDOW w AS (PARTITION BY word ORDER BY pos)) p
        LEFT JOIN merges m ON m.pair = p.id::BIGINT * 65536 + p.follower)))
  WHERE best IS NOT NULL AND NOT gone),
last AS (SELECT word, max(round) AS round FROM step GROUP BY word)
SELECT s.word, s.pos::INT AS pos, s.id FROM step s JOIN last l ON s.word = l.word AND s.round = l.round
"""
#: For each word its ids and their bytes in hex, in turns.
_DECODE = "SELECT t.word, string_agg(v.piece, ' ' ORDER BY t.pos) AS pieces FROM tokens t JOIN vocabulary v ON v.id = t.id GROUP BY t.word"


class Bpe:
    """Encodes and decodes distinct words in an in-memory DuckDB with one thread."""

    def __init__(self, path: str, pattern: str, entries: int = 250_000):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        pairs = [(ranks[w[:k]] * 65536 + ranks[w[k:]], rank) for w, rank in ranks.items() for k in range(1, len(w)) if w[:k] in ranks and w[k:] in ranks]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "preserve_insertion_order": False, "temp_directory": ""})
        self._load("merges", {"pair": np.array([p for p, _ in pairs], dtype=np.int64), "rank": np.array([r for _, r in pairs], dtype=np.int64)})
        self._load("vocabulary", {"id": np.array(list(ranks.values()), dtype=np.int64), "piece": [f"{rank} {w.hex()}" for w, rank in ranks.items()]})
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        #: Which two bytes stand side by side in some token.
        self.beside = np.zeros((256, 256), dtype=bool)
        for w in ranks:
            self.beside[list(w[:-1]), list(w[1:])] = True
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.words: dict[str, tuple[bytes, int, bytes]] = Recent(entries)
        self.chunks: dict[str, tuple[bytes, int, bytes]] = Recent(entries)

    def _load(self, name: str, columns: dict) -> None:
        given = pa.table(columns)  # noqa: F841  DuckDB reads the variable
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")

    def _contract(self, word: np.ndarray, pos: np.ndarray, ids: np.ndarray, long: bool) -> list[tuple[int, bytes, int, bytes]]:
        """For each word its number, decimal ids (a space after each), their number and the bytes that they decode to."""
        self._load("seed", {"word": word, "pos": pos, "id": ids})
        size = len(word)
        while True:
            query = (_CONTRACT_LONG if long else _CONTRACT).replace("$rounds", str(max(4, ROWS // max(size, 1))))
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE tokens AS {query}")
            (left,) = self.db.execute("SELECT count(*) FROM tokens").fetchall()[0]
            if left == size:
                break
            size = left
            self.db.execute("CREATE OR REPLACE TEMP TABLE seed AS SELECT word, pos, id FROM tokens")
        got, out = self.db.sql(_DECODE).to_arrow_table(), []
        for w, pieces in zip(got["word"].to_pylist(), got["pieces"].to_pylist(), strict=True):
            parts = pieces.split(" ")
            out.append((w, (" ".join(parts[::2]) + " ").encode(), len(parts) // 2, bytes.fromhex("".join(parts[1::2]))))
        return out

    def _encode(self, new: list[str]) -> None:
        """Ids, their number and the decoded bytes of words not met before, a bounded number of bytes at a time."""
        data, bounds = utf8(pa.array(new, pa.string()))
        known = np.array([self.ranks.get(w.encode(), -1) for w in new], dtype=np.int64)
        cut = np.zeros(len(data) + 1, dtype=bool)
        for w in np.flatnonzero((known < 0) & (np.diff(bounds) > LONG)):
            a, b = bounds[w], bounds[w + 1]
            cut[a + 1 : b] = ~self.beside[data[a : b - 1], data[a + 1 : b]]
        cut[bounds] = True
        at = np.flatnonzero(cut)
        owner, sizes = np.searchsorted(bounds, at[:-1], "right") - 1, np.diff(at)
        token = known[owner]
        rows = np.where(token < 0, sizes, 1)  # a word that is a token is one row
        found: list = [None] * len(owner)
        for long in (False, True):
            some = np.flatnonzero((rows > LONG) == long)
            group = (np.cumsum(rows[some]) - rows[some]) // ROUND_BYTES
            for part in np.split(some, np.flatnonzero(np.diff(group)) + 1) if len(some) else ():
                n = rows[part]
                pos = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
                ids = np.where(np.repeat(token[part], n) < 0, self.single[data[np.repeat(at[part], n) + pos]], np.repeat(token[part], n)).astype(np.int32)
                for w, *got in self._contract(np.repeat(part, n).astype(np.int32), pos, ids, long):
                    found[w] = got
        begins = np.searchsorted(owner, np.arange(len(new) + 1))
        for w, lo, hi in zip(new, begins.tolist(), begins[1:].tolist(), strict=False):
            self.words[w] = tuple(found[lo]) if hi - lo == 1 else (b"".join(x[0] for x in found[lo:hi]), sum(x[1] for x in found[lo:hi]), b"".join(x[2] for x in found[lo:hi]))

    def __call__(self, distinct: list[str]) -> list[tuple[bytes, int, bytes]]:
        """For each chunk its decimal ids (a space after each), their number, and the bytes that they decode to."""
        found = {x: self.pattern.findall(x) for x in self.chunks.missing(distinct)}
        if new := self.words.missing(list({w for parts in found.values() for w in parts})):
            self._encode(new)
        for x, parts in found.items():
            got = [self.words[w] for w in parts]
            self.chunks[x] = got[0] if len(got) == 1 else (b"".join(g[0] for g in got), sum(g[1] for g in got), b"".join(g[2] for g in got))
        return [self.chunks[x] for x in distinct]


_loaded: dict[tuple[str, str], Bpe] = {}


def _coder(path: str, pattern: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded.get((path, pattern)) or _loaded.setdefault((path, pattern), Bpe(path, pattern))
        for batch in slices(batches, "text", TOKEN_SLICE):
            distinct, codes, row_at = chunks(batch["text"])
            got = bpe(distinct)
            index = pa.array(codes, pa.int32())
            ids, id_at = utf8(pa.array([g[0] for g in got], pa.binary()).take(index))
            text, text_at = utf8(pa.array([g[2] for g in got], pa.binary()).take(index))
            counts = np.concatenate([[0], np.cumsum(np.array([g[1] for g in got], dtype=np.int64)[codes])]) if len(codes) else np.zeros(1, dtype=np.int64)
            ids, text, id_at, text_at = ids.tobytes(), text.tobytes(), id_at[row_at], text_at[row_at]
            numbers = pa.array(np.diff(counts[row_at]), pa.int64())
            spans = list(zip(id_at, id_at[1:], text_at, text_at[1:], strict=False))
            if digests:
                made = [[hashlib.sha256(ids[a : max(a, b - 1)]).hexdigest() for a, b, _, _ in spans], [hashlib.sha256(text[c:d]).hexdigest() for _, _, c, d in spans]]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], numbers, *map(pa.array, made)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                lists = pa.array([np.array(ids[a:b].split(), dtype=np.int32) for a, b, _, _ in spans], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], lists, pa.array([text[c:d] for _, _, c, d in spans], pa.binary())], ["doc_id", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, ids and the bytes decoded from them."""
    return arrow_map(docs.select("doc_id", "text"), _coder(ranks, pattern, False), "doc_id long, ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the decimal ids and of the decoded bytes, without moving either."""
    return arrow_map(docs.select("doc_id", "text"), _coder(ranks, pattern, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
