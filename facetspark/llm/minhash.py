"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 64-bit numbers make every coordinate of a signature: the first places the
shingles, the second ranks them after a circular shift by the coordinate's number.

Equal shingle sets become one node. In every bucket of a band the nodes are compared with the bucket's
hub, and what is confirmed on the full sets is contracted to components. Only then are the nodes of
different components in one bucket compared with each other, in blocks, so the copies of a large group
are never expanded into pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetspark.llm.common import map_rows, stored, utf8, words_of
from facetspark.llm.components import connected_components

SHINGLE = 5
#: Similarity from which documents are linked, in percent.
SIMILAR = 75
#: 32 bands of 4 coordinates: a pair at the least similarity meets in no bucket with probability 5e-6.
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
#: Pairs are confirmed on full sets from so many equal coordinates on; 4.5 standard deviations below the least similarity.
LEAST_EQUAL = 74
#: Nodes of a bucket that are compared together.
BLOCK = 128
SIGNED_COLUMNS = ("node", "component", "signature", "n")
BLOCK_COLUMNS = ("node", "component", "signature", "shingles")
#: Shingles whose signatures are made together.
TOGETHER = 1 << 16
#: Words a task remembers the hashes of; a hash is made again in less time than a large table takes.
KNOWN_WORDS = 1 << 16
#: Texts that are fetched again are first picked by so many values of their id's hash; bounds what is broadcast.
RESIDUES = 1 << 20

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, one: np.uint64, two: np.uint64) -> np.ndarray:
    """A permutation of the 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * one
    x = (x ^ (x >> np.uint64(27))) * two
    return x ^ (x >> np.uint64(31))


def lowered(text: str | None) -> bytes:
    """A-Z in lower case and nothing else; bytes.lower() knows ASCII only."""
    return utf8(text).lower()


class Shingler:
    """Hashes of the distinct shingles of texts."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def hashes(self, text: str | None) -> np.ndarray:
        import xxhash

        words = words_of(lowered(text))
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < SHINGLE:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        for word in set(words).difference(self.known):
            self.known[word] = xxhash.xxh3_64_intdigest(word, SHINGLE)
        ids = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = len(ids) - SHINGLE + 1
        value = ids[:n].copy()
        for k in range(1, SHINGLE):
            value = (value ^ (value >> np.uint64(32))) * _M3 + ids[k:k + n]
        return np.unique(_mix(value, _M1, _M2))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 32-bit coordinates for each (non-empty) set."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    placed = _mix(np.concatenate(sets), _M2, _M1)  # the first permutation
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        ranked = _mix(placed - np.uint64(k), _M1, _M2)  # the second one, shifted
        out[:, k] = np.minimum.reduceat(ranked, starts) >> np.uint64(32)
    return out


def sketches(rows) -> Iterator[tuple]:
    """``(doc_id, text)`` as ``(doc_id, crc, n_shingles, node, signature)``; the node is a 128-bit digest of the set."""
    import xxhash

    shingler, held, size = Shingler(), [], 0

    def flush():
        full = [s for _, _, s in held if len(s)]
        found = iter(signatures(full)) if full else iter(())
        for doc_id, crc, s in held:
            if len(s):
                yield doc_id, crc, len(s), xxhash.xxh3_128_digest(s.tobytes()), next(found).tobytes()
            else:
                yield doc_id, crc, 0, None, None

    for doc_id, text in rows:
        held.append((doc_id, zlib.crc32(utf8(text)), shingler.hashes(text)))
        size += len(held[-1][2])
        if size >= TOGETHER:
            yield from flush()
            held, size = [], 0
    yield from flush()


def bucket_values(signs: np.ndarray) -> np.ndarray:
    """The bucket of each band, one row a signature."""
    parts = signs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    value = np.repeat((np.arange(1, BANDS + 1, dtype=np.uint64) * _M3)[None, :], len(parts), 0)
    for k in range(ROWS):
        value = _mix(value ^ parts[:, :, k], _M1, _M2) * _M3
    return value


def buckets(rows) -> Iterator[tuple]:
    """``(node, signature)`` as ``(bucket, node)``, one row a band."""
    held = []

    def flush():
        signs = np.frombuffer(b"".join(s for _, s in held), np.uint32).reshape(-1, COORDINATES)
        for (node, _), own in zip(held, bucket_values(signs).view(np.int64).tolist()):
            yield from ((bucket, node) for bucket in own)

    for row in rows:
        held.append(row)
        if len(held) == 1024:
            yield from flush()
            held = []
    if held:
        yield from flush()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two full sets, sorted shingle hashes of 64 bits, are similar enough."""
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both > 0 and 100 * both >= SIMILAR * (len(a) + len(b) - both)


def low_bits(shingles: np.ndarray) -> bytes:
    """32 bits of each hash of a sorted set, sorted too."""
    return (shingles >> np.uint64(32)).astype("<u4").tobytes()


def similar_on_low_bits(a: np.ndarray, b: np.ndarray, percent: int) -> bool | None:
    """Whether two sets are similar by 32 bits of each element; None where it takes all 64 to tell.

    The overlap found is never too small; where it exceeds what is needed by no more than chance might add, nothing
    is sure.
    """
    place = np.searchsorted(b, a)
    both = int((b[np.minimum(place, len(b) - 1)] == a).sum())
    need = -(-percent * (len(a) + len(b)) // (100 + percent))
    if both < need:
        return False
    return True if both >= need + 2 + 8 * len(a) * len(b) // 2**32 else None


def perhaps_in(df: DataFrame, key: str | list[str], wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be in ``wanted``; few others while ``wanted`` is small.

    Compares hash residues, of which 64 are bits of one row: at most RESIDUES rows are broadcast, whatever the size of
    ``wanted``, and a join on the key itself follows. Spares the shuffle most of the wide rows that nobody asked for.
    """
    place = F.pmod(F.xxhash64(*([key] if isinstance(key, str) else key)), F.lit(64 * RESIDUES))
    residue = F.shiftright(place, 6)
    bit = F.expr("shiftleft(1L, cast(_place & 63 AS int))")
    few = wanted.select(place.alias("_place")).groupBy(F.shiftright("_place", 6).alias("_residue")).agg(F.bit_or(bit).alias("_bits"))
    near = df.withColumn("_place", place).join(F.broadcast(few), residue == F.col("_residue"))
    return near.where(F.col("_bits").bitwiseAND(bit) != 0).select(*df.columns)


def full_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, low: bool = False) -> DataFrame:
    """``(node, shingles)`` of ``wanted (node)``: all shingle hashes of each, made again from a text that has them.

    With ``low`` they are ``low_bits`` of all hashes.
    """
    wanted = wanted.select("node").distinct()
    ids = stored(perhaps_in(nodes.select("node", "doc_id"), "node", wanted).join(wanted, "node"), "wanted-ids")
    some = perhaps_in(docs.select("doc_id", "text"), "doc_id", ids)
    found = some.join(ids, some["doc_id"].eqNullSafe(ids["doc_id"])).select("node", "text")

    def own(rows):  # equal ids may have several texts
        import xxhash

        shingler = Shingler()
        for node, text in rows:
            shingles = shingler.hashes(text)
            if xxhash.xxh3_128_digest(shingles.tobytes())[:len(node)] == node:
                yield node, low_bits(shingles) if low else shingles.tobytes()

    return stored(map_rows(found, own, "node binary, shingles binary").dropDuplicates(["node"]), "full-sets")


def with_both(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """``pairs (a, b)`` with the columns of ``facts (node, ...)`` for each side, as ``_a`` and ``_b``."""
    for side in ("a", "b"):
        named = facts.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in facts.columns if c != "node"])
        pairs = pairs.join(named, side)
    return pairs


def confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The ``pairs (a, b)`` that are similar on their full sets.

    Each element is sent as 32 bits; only pairs that these leave open are decided on all 64.
    """
    ends = pairs.selectExpr("a AS node").unionAll(pairs.selectExpr("b AS node"))

    def run(rows):
        for a, b, x, y in rows:
            found = similar_on_low_bits(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), SIMILAR)
            if found is not False:
                yield a, b, found is True

    both = with_both(pairs, full_sets(ends, nodes, docs, low=True)).select("a", "b", "shingles_a", "shingles_b")
    found = stored(map_rows(both, run, "a binary, b binary, sure boolean"), "links-on-low-bits")
    return found.where("sure").select("a", "b").unionAll(confirm_in_full(found.where("NOT sure").select("a", "b"), nodes, docs))


def confirm_in_full(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    if pairs.isEmpty():
        return pairs
    sets = full_sets(pairs.selectExpr("a AS node").unionAll(pairs.selectExpr("b AS node")), nodes, docs)

    def run(rows):
        for a, b, x, y in rows:
            if similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)):
                yield a, b

    return map_rows(with_both(pairs, sets).select("a", "b", "shingles_a", "shingles_b"), run, "a binary, b binary")


def hub_pairs(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of each bucket's hub with its other nodes whose sizes and signatures allow the similarity."""
    hub = members.select("bucket", F.col("hub").alias("a"), F.col("node").alias("b")).where("a <> b")
    pairs = stored(hub.select("a", "b").distinct(), "hub-pairs")
    wanted = pairs.selectExpr("a AS node").unionAll(pairs.selectExpr("b AS node"))
    facts = perhaps_in(nodes.select("node", "n", "signature"), "node", wanted)
    near = with_both(pairs, facts).where(f"100 * least(n_a, n_b) >= {SIMILAR} * greatest(n_a, n_b)")

    def run(rows):
        for a, b, x, y in rows:
            if np.count_nonzero(np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)) >= LEAST_EQUAL:
                yield a, b

    return map_rows(near.select("a", "b", "signature_a", "signature_b"), run, "a binary, b binary")


def paired_blocks(rest: DataFrame, facts: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Blocks of the nodes of ``rest (bucket, node, component, main, total)`` with ``facts``, each two that may have links.

    A row is a block of nodes outside the bucket's largest component (``columns`` with ``_l``) with itself or another block.
    """
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("total") / BLOCK))
    blocks = stored(
        rest.join(facts, "node")
        .groupBy("bucket", (F.col("component") == F.col("main")).alias("main"), salt.alias("salt"))
        .agg(*[F.collect_list(c).alias(c) for c in columns]),
        "blocks",
    )
    left = blocks.where("NOT main").select("bucket", *[F.col(c).alias(f"{c}_l") for c in ("salt", *columns)])
    joined = left.join(blocks, "bucket").where("main OR salt_l <= salt")
    return joined.select("bucket", *(f"{c}_l" for c in columns), *columns)


def cross_links(members: DataFrame, nodes: DataFrame, labels: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between nodes of one bucket that are in different components, at least one a node and component.

    The nodes outside a bucket's largest component are compared with all of the bucket, in blocks of BLOCK nodes:
    first by size and signature, then those that have a likely partner there by their full sets. A block is a row, so
    no task holds a bucket; pairs are looked at inside a task, in the first bucket they share, and only nodes with
    likely partners and confirmed links leave it.
    """
    placed = members.join(labels, "node", "left").select(
        "bucket", "node", F.coalesce("component", "node").alias("component")
    )
    counts = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("bucket").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("parts")
    ).where("parts > 1").drop("parts")
    rest = stored(placed.join(mixed, "bucket"), "mixed-buckets")
    signed = perhaps_in(nodes.select("node", "n", "signature"), "node", rest)
    likely = map_rows(paired_blocks(rest, signed, SIGNED_COLUMNS), _likely_nodes, "bucket long, node binary")
    likely = stored(likely.distinct(), "likely-nodes")
    facts = perhaps_in(nodes.select("node", "signature"), "node", likely).join(full_sets(likely, nodes, docs), "node")
    blocks = paired_blocks(rest.join(likely, ["bucket", "node"]), facts, BLOCK_COLUMNS)
    return map_rows(blocks, _compare_blocks, "a binary, b binary").distinct()


def _likely_partners(bucket, signature, n, signs, sizes) -> np.ndarray:
    """Places of the nodes whose size and signature allow the similarity and whose first common bucket this is."""
    raw = np.frombuffer(signature, np.uint32)
    equal = signs == raw
    fits = 100 * np.minimum(sizes, n) >= SIMILAR * np.maximum(sizes, n)
    likely = np.flatnonzero((equal.sum(1) >= LEAST_EQUAL) & fits)
    if not len(likely):
        return likely
    band = int(np.flatnonzero(bucket_values(raw[None, :])[0].view(np.int64) == bucket)[0])
    return likely[equal[likely].reshape(-1, BANDS, ROWS).all(2).argmax(1) == band]


def _likely_nodes(rows):
    for bucket, nodes_l, parts_l, signatures_l, sizes_l, nodes, parts, signs, sizes in rows:
        right = np.frombuffer(b"".join(signs), np.uint32).reshape(len(nodes), COORDINATES)
        sizes = np.array(sizes)
        asked = set()
        for node, part, signature, n in zip(nodes_l, parts_l, signatures_l, sizes_l):
            for k in _likely_partners(bucket, signature, n, right, sizes).tolist():
                if parts[k] != part:
                    asked |= {node, nodes[k]}
        yield from ((bucket, node) for node in asked)


def _compare_blocks(rows):
    for bucket, nodes_l, parts_l, signatures_l, sets_l, nodes, parts, signs, sets in rows:
        right = np.frombuffer(b"".join(signs), np.uint32).reshape(len(nodes), COORDINATES)
        full = [np.frombuffer(s, np.uint64) for s in sets]
        sizes = np.array([len(s) for s in full])
        for node, part, signature, shingles in zip(nodes_l, parts_l, signatures_l, sets_l):
            own = np.frombuffer(shingles, np.uint64)
            linked = set()
            for k in _likely_partners(bucket, signature, len(own), right, sizes).tolist():
                other = parts[k]
                if other != part and other not in linked and similar(own, full[k]):
                    linked.add(other)
                    yield min(node, nodes[k]), max(node, nodes[k])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Components of near-duplicates: ``doc_id, n_shingles, component_id, kept, text_crc32``, one row a document.

    Input ``doc_id``, ``text``; other columns are ignored. Documents with 75 % or more of their five-word
    shingles (lower-cased A-Z) in common are linked; fewer than five words are one shingle; null, empty and
    wordless texts have no shingle and are linked with nothing. ``component_id`` is the least id in the
    component; ``kept`` marks the documents that have it. Rows with the same id are judged by their own
    texts. Null ids never name a component that has another id; a component of null ids alone is kept. An
    empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    sketch = stored(map_rows(docs, sketches, "doc_id long, text_crc32 long, n long, node binary, signature binary"), "sketches")
    nodes = stored(
        sketch.where("node IS NOT NULL").groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("signature").alias("signature")), "nodes"
    )
    # one shuffle of the bucket rows; a window spills, so a bucket of any size is passed through
    found = map_rows(nodes.select("node", "signature"), buckets, "bucket long, node binary")
    own = Window.partitionBy("bucket")
    hubs = found.select("bucket", "node", F.min("node").over(own).alias("hub"), F.count(F.lit(1)).over(own).alias("n"))
    members = stored(hubs.where("n > 1").select("bucket", "node", "hub"), "members")

    pairs = stored(hub_pairs(members, nodes), "likely-hub-pairs")
    links = stored(confirm(pairs, nodes, docs), "hub-links")
    labels = connected_components(links)
    links = links.unionAll(stored(cross_links(members, nodes, labels, docs), "cross-links"))
    labels = connected_components(links)

    named = nodes.select("node", "doc_id").join(labels, "node", "left").select(
        "node", "doc_id", F.coalesce("component", "node").alias("component")
    )
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select("node", "component_id")
    out = sketch.select("doc_id", "text_crc32", F.col("n").alias("n_shingles"), "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"),
        "text_crc32",
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns."""
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("_doc"), F.col("text_crc32").alias("_crc"))
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    return docs.join(gone, F.col("_doc").eqNullSafe(docs["doc_id"]) & (F.col("_crc") == crc), "left_anti")
