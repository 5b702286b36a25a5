"""Token ids in Huffman-coded segments.

The ids of documents in ascending ``doc_id`` order are cut into segments of whole documents. A segment
is one row of a Parquet dataset; its ids are coded with one canonical code for the whole corpus, of
at most MAX_BITS bits a symbol, built from the global counts. Blocks of BLOCK ids can be decoded
independently: the bit offset of each is kept as a checkpoint. Decoding looks MAX_BITS bits up in a
table and moves all blocks of a segment forward together.
"""

from __future__ import annotations

import json
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetspark.llm.chunks import WordCache, encode_batches
from facetspark.llm.common import batches_of, block_count, map_batches, map_rows, rows_of, stored, summed
from facetspark.scale import scratch_path

MAX_BITS = 18
BLOCK = 256
#: A segment is closed at so many ids.
SEGMENT_IDS = 1 << 20
#: Bytes of stored ids a file holds about.
FILE_BYTES = 32 << 20
COUNT_BYTES = 8 << 20
SEGMENT_DDL = (
    "file int, segment int, first_id long, n_ids long, doc_ids binary, doc_lengths binary, bits binary, checkpoints binary"
)


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` bits (package-merge); 0 for symbols that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError("more symbols than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    # weights and, of each item, whether it is a leaf, level by level
    levels, weights = [], leaves
    for _ in range(max_bits - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([leaves, pairs])
        sort = np.argsort(merged, kind="stable")
        levels.append(sort < len(leaves))
        weights = merged[sort]
    taken = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        n_leaves = int(is_leaf[:taken].sum())
        lengths[order[:n_leaves]] += 1
        taken = 2 * (taken - n_leaves)
    lengths[order[:taken]] += 1
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes = np.zeros(len(lengths), np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, int(lengths[order[0]]) if len(order) else 0
    for symbol in order.tolist():
        code <<= int(lengths[symbol]) - last
        last = int(lengths[symbol])
        codes[symbol] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> np.ndarray:
    """For each value of the next MAX_BITS bits, the symbol times 32 plus the length of its code."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = 1 << (MAX_BITS - lengths[order])  # codes in canonical order fill the table from 0 on
    table = np.ones(1 << MAX_BITS, np.int64)
    table[: span.sum()] = np.repeat(order * 32 + lengths[order], span)
    return table


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of ``ids``, most significant first, and the bit offset of each block."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    size = lengths[ids]
    start = np.cumsum(size) - size
    word = start >> 5
    value = codes[ids].astype(np.uint64) << (64 - (start & 31) - size).astype(np.uint64)
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))  # a code starts in every word: none is longer than one
    sums = np.add.reduceat(value, first)
    words = np.append((sums >> np.uint64(32)), np.uint64(0))
    words[1:] += sums & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes(), start[::BLOCK]


def unpack(bits: bytes, checkpoints: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """The ``n`` ids of a segment; every block starts at its checkpoint."""
    # the last block may be short and then reads on behind the end
    raw = np.frombuffer(bits + bytes(BLOCK * MAX_BITS // 8 + 8), np.uint8)
    # the 32 bits from each byte on: an offset inside a byte and MAX_BITS fit
    words = np.zeros(len(raw) - 3, np.int64)
    for k in range(4):
        words |= raw[k: len(raw) - 3 + k].astype(np.int64) << (24 - 8 * k)
    at = np.array(checkpoints, np.int64)
    out = np.zeros((min(BLOCK, n), len(at)), np.uint32)
    mask, top = (1 << MAX_BITS) - 1, 32 - MAX_BITS
    for row in out:
        found = table[(words[at >> 3] >> (top - (at & 7))) & mask]
        row[:] = found >> 5
        at += found & 31
    return out.T.ravel()[:n]


def byte_letters() -> str:
    """The letter that the tokenizer file writes for each byte: visible Latin-1 as it is, the others from 256 on in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return "".join(chr(b if b in visible else next(others)) for b in range(256))


def tokenized(docs: DataFrame, path: str, pattern: str, end_id: int | None) -> DataFrame:
    """``doc_id, n, ids`` by the tokenizer of ``path`` without special tokens, ``end_id`` behind each document.

    Each task adds a row with nothing but the ``counts`` of its ids.

    The tokenizer must be a byte-level one that splits by ``pattern`` and has no normaliser. Its model
    gets every distinct word once. Added tokens of the file are recognised inside texts, as the library does by
    default, and what stands between them is split by itself. Ids are little-endian unsigned numbers of ``id_type``.
    """
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    kind, symbols = id_type(path, end_id), n_symbols(path, end_id)
    width = int(kind[-1])
    added = {t["content"]: t["id"] for t in json.loads(spec).get("added_tokens") or []}
    tail = b"" if end_id is None else np.array([end_id], kind).tobytes()

    def run(parts):
        import regex
        from tokenizers import Tokenizer

        tokenize = Tokenizer.from_str(spec).model.tokenize
        letters = byte_letters()
        matches = regex.compile(pattern).findall
        between = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

        def split(chunk):
            if between is None or not between.search(chunk):
                return matches(chunk)
            return [w for part in between.split(chunk) for w in ([part] if part in added else matches(part))]

        space = letters[32]

        def spelled(word):
            if word[:1] == " " and word[1:].isalpha() and word.isascii():  # its letters stand for themselves
                return space + word[1:]
            return word.encode().decode("latin-1").translate(letters)

        def encode_words(words):
            return [
                array(code, [added[w]] if w in added else [t.id for t in tokenize(spelled(w))]).tobytes() for w in words
            ]

        def encode(chunks):
            return cache.encode(chunks, encode_words)

        code = "H" if kind == "<u2" else "I"
        cache = WordCache(split)
        total, held, size = np.zeros(symbols, np.int64), [], 0
        for key, ids in encode_batches(parts, encode, kind):
            ids += tail
            held.append(ids)
            size += len(ids)
            if size >= COUNT_BYTES:
                total += np.bincount(np.frombuffer(b"".join(held), kind), minlength=symbols)
                held, size = [], 0
            yield key, len(ids) // width, ids, None
        total += np.bincount(np.frombuffer(b"".join(held), kind), minlength=symbols)
        if total.any():
            yield None, None, None, zlib.compress(total.astype("<i8").tobytes(), 1)

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n long, ids binary, counts binary")


def n_symbols(path: str, end_id: int | None) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab_size(), (end_id or 0) + 1)


def id_type(path: str, end_id: int | None) -> str:
    """Two bytes an id where the vocabulary allows it."""
    return "<u2" if n_symbols(path, end_id) <= 1 << 16 else "<u4"


def global_counts(ids: DataFrame, n_symbols: int) -> np.ndarray:
    """Sum of the counts that the tasks of ``tokenized`` left in their last rows."""

    def total(rows):
        return sum((np.frombuffer(zlib.decompress(c), "<i8") for (c,) in rows), np.zeros(n_symbols, np.int64))

    return summed(ids.where("counts IS NOT NULL").select("counts"), total, n_symbols)


def write_segments(ids: DataFrame, kind: str, lengths: np.ndarray, path: str) -> None:
    """Writes ``doc_id, n, ids`` in ascending order of id to ``path``: one or more segments a range of ids.

    Rows with a null id come first; the order among equal ids is that of their lengths and bytes.
    """
    codes = canonical_codes(lengths)
    width = int(kind[-1])

    def run(batches):
        from pyspark import TaskContext

        file = TaskContext.get().partitionId()

        def segments():
            held, size, number, first = [], 0, 0, 0
            for row in rows_of(batches):
                held.append(row)
                size += len(row[1]) // width
                if size >= SEGMENT_IDS:
                    yield segment(held, size, number, first)
                    held, number, first, size = [], number + 1, first + size, 0
            if held:
                yield segment(held, size, number, first)

        def segment(held, size, number, first):
            known = np.array([r[0] if r[0] is not None else 0 for r in held], "<i8")
            # the lowest bit of a length says that the id is null
            counts = np.array([len(r[1]) // width * 2 + (r[0] is None) for r in held], "<i8")
            bits, checkpoints = pack(np.frombuffer(b"".join(r[1] for r in held), kind).astype(np.int64), lengths, codes)
            return (
                file, number, first, size, known.tobytes(), counts.tobytes(), bits, checkpoints.astype("<u8").tobytes(),
            )

        return batches_of(segments(), SEGMENT_DDL)

    files = block_count(ids, FILE_BYTES)
    ordered = ids.repartitionByRange(files, "doc_id", "n").sortWithinPartitions("doc_id", "n", "ids")
    ordered.select("doc_id", "ids").mapInArrow(run, SEGMENT_DDL).write.option("compression", "none").parquet(path)


def read_documents(segments: DataFrame, lengths: np.ndarray, finish, ddl: str) -> DataFrame:
    """Decodes segments; ``finish(doc_id, start, ids)`` makes a row of ``ddl`` of every document."""
    totals = segments.groupBy("file").agg(F.sum("n_ids").alias("n")).collect()  # a row for each file
    before, start = {}, 0
    for row in sorted(totals, key=lambda r: r["file"]):
        before[row["file"]] = start
        start += row["n"]

    def run(rows):
        table = decode_table(lengths)
        for file, _, first, n, doc_ids, counts, bits, checkpoints in rows:
            ids = unpack(bits, np.frombuffer(checkpoints, "<u8"), n, table)
            at = 0
            for doc_id, count in zip(np.frombuffer(doc_ids, "<i8").tolist(), np.frombuffer(counts, "<i8").tolist()):
                own = ids[at: at + count // 2]
                yield finish(None if count % 2 else doc_id, before[file] + first + at, own)
                at += count // 2

    return map_rows(segments, run, ddl)


def digest(doc_id, start, ids):
    return doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def binary_output(docs: DataFrame, path: str, pattern: str, end_id: int = 2, out: str | None = None) -> DataFrame:
    """Encodes, writes and reads back all documents: ``doc_id, start, n_tokens, ids_crc32``.

    Input ``doc_id``, ``text``; other columns are ignored. A null or empty text is the end id alone.
    Rows with null ids come first, repeated rows follow each other; an empty table gives no segments
    and an empty result. The files stay in ``out``, a new folder in the shared one by default; the code
    lengths lie beside the segments.
    """
    spark = docs.sparkSession
    out = out or scratch_path(spark, "token-ids")
    kind = id_type(path, end_id)
    ids = stored(tokenized(docs, path, pattern, end_id), "token-id-lists")
    lengths = code_lengths(global_counts(ids, n_symbols(path, end_id)))
    write_segments(ids.where("ids IS NOT NULL").select("doc_id", "n", "ids"), kind, lengths, f"{out}/segments")
    book = [(int(s), int(lengths[s])) for s in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "symbol int, bits int").coalesce(1).write.parquet(f"{out}/code")
    return read_binary(spark, out, digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_binary(spark, out: str, finish, ddl: str) -> DataFrame:
    """Documents of a folder of segments, decoded by the code that lies beside them."""
    book = spark.read.schema("symbol int, bits int").parquet(f"{out}/code").collect()  # a row for each symbol of the vocabulary
    lengths = np.zeros(1 + max((r["symbol"] for r in book), default=0), np.int64)
    for row in book:
        lengths[row["symbol"]] = row["bits"]
    segments = spark.read.schema(SEGMENT_DDL).parquet(f"{out}/segments")
    return read_documents(segments, lengths, finish, ddl)
