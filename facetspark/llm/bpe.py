"""Byte-level BPE by DuckDB queries inside each partition.

New words of a partition become rows of (word, position, token). A recursive query joins neighbouring
tokens with the merge table and contracts every word's leftmost pair of least rank, round by round,
until no pair of the word can be merged. Decoding joins ids with the vocabulary and aggregates their
bytes in order.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from facetspark.llm.chunks import WordCache, encode_batches
from facetspark.llm.common import map_batches, map_rows

#: Words given to one recursive query, counted in bytes; bounds its memory.
WORD_BYTES = 400_000
#: Ids decoded by one query; a longer document takes several.
DECODE_IDS = 400_000
END = np.array([-1], np.int32)

#: A row is a token and the one behind it in its word, with the id of the two merged if they can be. The merge at
#: ``best`` drops its left row; the row behind becomes the merged token; only rows beside the merge look a pair up again.
ENCODE_SQL = """
WITH RECURSIVE step(w, pos, tok, following, merged, done) AS (
  SELECT t.w, t.pos, t.tok, t.following, m.id, false
  FROM word_tokens t LEFT JOIN merges m ON m.pair = t.tok * {ids} + t.following
  UNION ALL
  SELECT s.w, s.pos, s.tok, s.following, CASE WHEN s.changed THEN m.id ELSE s.merged END, s.done
  FROM (
    SELECT t.w, CASE WHEN t.pos > b.pos THEN t.pos - 1 ELSE t.pos END AS pos,
           CASE WHEN t.pos = b.pos + 1 THEN b.id ELSE t.tok END AS tok,
           CASE WHEN t.pos = b.pos - 1 THEN b.id ELSE t.following END AS following,
           t.merged, t.pos BETWEEN b.pos - 1 AND b.pos + 1 AS changed, b.pos IS NULL AS done
    FROM (SELECT * FROM step WHERE NOT done) t LEFT JOIN (
      SELECT w, best % {wide} AS pos, best // {wide} AS id
      FROM (SELECT w, min(merged * {wide} + pos) AS best FROM step WHERE NOT done AND merged IS NOT NULL GROUP BY w)
    ) b USING (w)
    WHERE b.pos IS NULL OR t.pos <> b.pos
  ) s LEFT JOIN merges m ON m.pair = CASE WHEN s.changed THEN s.tok * {ids} + s.following END
)
SELECT w, tok FROM step WHERE done ORDER BY w, pos
""".format(wide=1 << 40, ids=1 << 22)

#: One ordered aggregate over many documents, each followed by a row of the id -1, whose text is a comma.
DECODE_SQL = "SELECT string_agg(v.hex, '' ORDER BY i) FROM given JOIN vocabulary v ON given.tok = v.id"


def load_ranks(lines: Iterator[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every pair of tokens whose bytes together are a token: left id, right id, id of the whole."""
    rows = [
        (ranks[t[:k]], ranks[t[k:]], rank)
        for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
    ]
    return tuple(np.array(c, np.int64) for c in zip(*rows))


class PartitionBpe:
    """The queries of one partition, in an in-memory DuckDB of one thread."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import pyarrow as pa
        import regex

        self.pa, self.ranks = pa, ranks
        self.cache = WordCache(regex.compile(pattern).findall)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        left, right, whole = merge_table(ranks)
        self._table("merges", pair=(left << 22) + right, id=whole)
        self._table("vocabulary", id=np.array([*ranks.values(), -1], np.int32), hex=[*(t.hex() for t in ranks), ","])

    def _table(self, name, **columns):
        self.con.register("incoming", self.pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def __enter__(self):
        return self

    def __exit__(self, *_):
        """A worker runs several tasks; nothing of one is left when the next begins."""
        self.con.close()
        self.cache = None

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        return self.cache.encode(chunks, self.encode_words)

    def encode_words(self, texts: list[str]) -> list[bytes]:
        """Ids of each word; a word that is a token is that token, as in the public library."""
        words = [t.encode() for t in texts]
        out: list = [None] * len(words)
        held, size = [], 0
        for k, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
                continue
            held.append(k)
            size += len(word)
            if size >= WORD_BYTES:
                self._contract(words, held, out)
                held, size = [], 0
        if held:
            self._contract(words, held, out)
        return out

    def _contract(self, words, held, out):
        lengths = np.array([len(words[k]) for k in held])
        starts = np.cumsum(lengths) - lengths
        tokens = self.byte_ids[np.frombuffer(b"".join(words[k] for k in held), np.uint8)]
        which = np.repeat(np.arange(len(held), dtype=np.int32), lengths)
        following = np.append(tokens[1:], -1)
        following[starts[1:] - 1] = -1
        self.con.register("word_tokens", self.pa.table({
            "w": which, "pos": np.arange(len(tokens)) - starts[which], "tok": tokens, "following": following,
        }))
        found = self.con.execute(ENCODE_SQL).fetchnumpy()
        self.con.unregister("word_tokens")
        ids = found["tok"].astype("<u4").tobytes()
        start = 0
        for k, end in zip(held, (4 * np.cumsum(np.bincount(found["w"], minlength=len(held)))).tolist()):
            out[k] = ids[start:end]
            start = end

    def decode(self, documents: list[bytes]) -> list[bytes]:
        tokens = np.concatenate([x for d in documents for x in (np.frombuffer(d, "<u4").astype(np.int32), END)] or [END])
        text = "".join(self._hex(tokens[a:a + DECODE_IDS]) for a in range(0, len(tokens), DECODE_IDS))
        return [bytes.fromhex(part) for part in text.split(",")[:len(documents)]]

    def _hex(self, tokens: np.ndarray) -> str:
        self.con.register("given", self.pa.table({"i": np.arange(len(tokens)), "tok": tokens}))
        text = self.con.execute(DECODE_SQL).fetchall()[0][0]
        self.con.unregister("given")
        return text


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Ids of every whole text: ``doc_id, ids`` (little-endian unsigned 32-bit integers).

    Input ``doc_id``, ``text``; other columns are ignored. A null or empty text has no ids; rows with
    null or repeated ids are encoded one by one; an empty table gives an empty result.
    """
    def run(parts):
        with PartitionBpe(ranks, pattern) as bpe:
            yield from encode_batches(parts, bpe.encode_chunks, "<u4")

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, ids binary")


def decoded(rows, bpe: PartitionBpe) -> Iterator[tuple]:
    """``(key, ids)`` as ``(key, ids, bytes)``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1]) // 4
        if size >= DECODE_IDS:
            yield from ((*r, text) for r, text in zip(held, bpe.decode([r[1] for r in held])))
            held, size = [], 0
    yield from ((*r, text) for r, text in zip(held, bpe.decode([r[1] for r in held])))


def decode_documents(encoded: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Texts of ``encode_documents``' result: ``doc_id, text``; bytes that are no UTF-8 are replaced."""

    def run(rows):
        with PartitionBpe(ranks, pattern) as bpe:
            for key, _, text in decoded(rows, bpe):
                yield key, text.decode("utf-8", "replace")

    return map_rows(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Encodes and decodes every document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    The cases of ``encode_documents`` hold; no text leaves the partition.
    """

    def run(parts):
        with PartitionBpe(ranks, pattern) as bpe:
            for key, ids, text in decoded(encode_batches(parts, bpe.encode_chunks, "<u4"), bpe):
                yield key, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
