"""An exact Jaccard join of word n-grams by PartEnum signatures.

Sizes of sets are cut into bands such that similar sets lie in one band or in two neighbouring ones, and a set posts
signatures for its own band and the next. Within a band, similar sets differ in at most k elements. The domain of
elements is partitioned into groups of parts, and for each group all subsets of parts are enumerated that leave out as
many parts as elements may differ there; a signature is a hash of the elements in such a subset. So many groups are
taken that two similar sets agree on one subset at least: every link has a common signature.

Equal sets are one node. The nodes that share a signature are a list; its least node is its hub. Hubs are confirmed
against their members on the full sets first, and what is linked is contracted. Only the members of lists that still
have several components are looked at pair by pair, once a hub and in blocks: first by parity sketches, whose differing
bits never outnumber the differing elements, then those that some other sketch lets be similar on their full sets. Pairs
stay in the task; a node at most, or a link that joins two components, leaves it.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetspark.llm.common import arrow_schema, batches_of, block_count, map_rows, stored, utf8
from facetspark.llm.components import connected_components
from facetspark.llm.minhash import Shingler, full_sets, low_bits, perhaps_in, similar_on_low_bits, with_both

#: Jaccard similarity from which sets are linked, in percent.
SIMILAR = 80
#: Up to this many differing elements, subsets that leave out two parts are enumerated; beyond, one part.
FEW_APART = 8
#: Groups beyond those needed, in percent; see ``Layout``.
SPARE = 10
#: Bits of a parity sketch for each element, at least, and the most of them.
SKETCH_BITS = 1
MOST_BITS = 1 << 17
#: Signatures a task packs together; stored bytes of documents a bucket of signatures stands for.
PACKED = 1 << 20
BUCKET_BYTES = 8 << 20
#: Elements whose signatures are made together.
TOGETHER = 1 << 17
#: Members that are compared with their hub in one go; a hub with more is sent several times.
MEMBERS = 1024
#: Nodes of a block in which a hub's members are compared, and the elements of their sets.
BLOCK = 256
BLOCK_ELEMENTS = 1 << 19
HASH_BYTES = 5
#: Bytes of the digest that names a set: each signature of a set carries them.
NODE_BYTES = 12

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def most_apart(size_a, size_b, similar: int = SIMILAR):
    """Elements in one of two similar sets only, at most."""
    return (size_a + size_b) * (100 - similar) // (100 + similar)


@dataclass(frozen=True)
class Layout:
    """How the sets of a band are partitioned; ``apart`` elements differ at most.

    ``leave_out`` parts of a group may be left out, so a group has a common subset unless more than that many elements
    differ in it, which happens in ``apart // (leave_out + 1)`` groups at most: ``sure`` groups do have one. A subset
    of a set may be empty and would be shared with many others. Such signatures are posted only by sets in which
    ``sure`` groups or more have an empty subset: if one of two similar sets has fewer, a common subset is not empty.
    """

    band: int
    apart: int
    leave_out: int
    parts: int
    groups: int

    @property
    def sure(self) -> int:
        return self.groups - self.apart // (self.leave_out + 1)

    @property
    def subsets(self) -> list[tuple[int, ...]]:
        return list(itertools.combinations(range(self.parts), self.parts - self.leave_out))


def band_ends(largest: int) -> list[int]:
    """The largest size of each band, up to a band that holds ``largest``."""
    ends, least = [], 1
    while not ends or ends[-1] < largest:
        ends.append(least * 100 // SIMILAR)
        least = ends[-1] + 1
    return ends


def layout(band: int, end: int) -> Layout | None:
    """None where similar sets are equal."""
    apart = most_apart(end, end)
    if apart == 0:
        return None
    leave_out, parts = (1, 4) if apart == 1 else (2, 5) if apart <= FEW_APART else (1, 3)
    needed = apart // (leave_out + 1) + 1
    return Layout(band, apart, leave_out, parts, needed + (needed * SPARE // 100 if apart > FEW_APART else 0))


def signatures(sets: list[np.ndarray], layouts: list[Layout]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of each set in its layout, and the number of the set each belongs to."""
    found, owners = [], []
    kinds: dict[tuple, list[int]] = {}
    for k, lay in enumerate(layouts):
        kinds.setdefault((lay.parts, lay.leave_out), []).append(k)
    for (parts, leave_out), mine in kinds.items():
        sizes = np.array([len(sets[k]) for k in mine])
        groups = np.array([layouts[k].groups for k in mine])
        sure = np.array([layouts[k].sure for k in mine])
        band = np.array([layouts[k].band for k in mine], np.uint64)
        slots = groups * parts
        base = np.cumsum(slots) - slots
        elements = np.concatenate([sets[k] for k in mine])
        own = np.repeat(np.arange(len(mine)), sizes)
        part = ((mix(elements + band[own]) >> np.uint64(32)) * slots[own].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(int(slots.sum()), np.uint64)
        np.add.at(total, base[own] + part, mix(elements ^ _M3))
        filled = np.bincount(base[own] + part, minlength=len(total)).reshape(-1, parts) > 0
        total = total.reshape(-1, parts)
        of_group = np.repeat(np.arange(len(mine)), groups)
        number = np.arange(len(of_group)) - np.repeat(np.cumsum(groups) - groups, groups)
        weak = filled.sum(1) <= leave_out  # some subset of the group is empty
        poor = np.bincount(of_group, weak, minlength=len(mine)) >= sure
        name = mix((band[of_group] << np.uint64(40)) + number.astype(np.uint64) * np.uint64(64))
        for s, subset in enumerate(itertools.combinations(range(parts), parts - leave_out)):
            value = name + np.uint64(s + 1)
            some = poor[of_group]
            for p in subset:
                value = mix(value) + total[:, p] * _M3
                some = some | filled[:, p]
            found.append(mix(value[some]))
            owners.append(np.array(mine)[of_group[some]])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


# --- parity sketches -------------------------------------------------------------


def parity_sketch(elements: np.ndarray, size: int | None = None) -> bytes:
    """One bit for each place of a hash table, of ``size`` bytes if given: whether an odd number of elements falls there."""
    bits = 8 * size if size else min(MOST_BITS, max(64, 1 << int(SKETCH_BITS * len(elements) - 1).bit_length()))
    counts = np.bincount((mix(elements) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch of ``size`` bytes of the same set."""
    raw = np.frombuffer(sketch, np.uint8)
    return np.bitwise_xor.reduce(raw.reshape(-1, size), 0)


def perhaps_similar(n_a: int, sketch_a: bytes, n_b: int, sketch_b: bytes) -> bool:
    if 100 * min(n_a, n_b) < SIMILAR * max(n_a, n_b):
        return False
    size = min(len(sketch_a), len(sketch_b))
    differ = int(np.bitwise_count(folded(sketch_a, size) ^ folded(sketch_b, size)).sum())
    return differ <= most_apart(n_a, n_b)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both > 0 and 100 * both >= SIMILAR * (len(a) + len(b) - both)


# --- signatures on Spark ---------------------------------------------------------


class Packer:
    """Signatures of a task, packed by bucket: the nodes, how many signatures each has, and those."""

    def __init__(self, buckets: int):
        self.buckets, self.hashes, self.owners, self.nodes, self.n = buckets, [], [], [], 0

    def add(self, hashes: np.ndarray, owners: np.ndarray, nodes: list[bytes]):
        self.hashes.append(hashes)
        self.owners.append(owners + len(self.nodes))
        self.nodes += nodes
        self.n += len(hashes)

    def flush(self) -> Iterator[tuple]:
        if self.n:
            hashes, owners = np.concatenate(self.hashes), np.concatenate(self.owners)
            bucket = ((hashes >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((owners, bucket))
            hashes, owners, bucket = mix(hashes[order]), owners[order], bucket[order]
            for part in np.split(np.arange(len(order)), np.flatnonzero(np.diff(bucket)) + 1):
                own, first, count = np.unique(owners[part], return_index=True, return_counts=True)
                low = hashes[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()
                counts = zlib.compress(count.astype("<u4").tobytes(), 1)
                head = len(own).to_bytes(8, "little") + len(counts).to_bytes(8, "little") + counts
                yield int(bucket[part[0]]), head + b"".join(self.nodes[k] for k in own.tolist()) + low
        self.hashes, self.owners, self.nodes, self.n = [], [], [], 0


def unpacked(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Signature hashes, the number of the node of each, and the distinct nodes in ascending order."""
    hashes, counts, nodes = [], [], []
    for raw in payloads:
        n, at = int.from_bytes(raw[:8], "little"), 16 + int.from_bytes(raw[8:16], "little")
        counts.append(np.frombuffer(zlib.decompress(raw[16:at]), "<u4").astype(np.int64))
        nodes += [raw[at + NODE_BYTES * k:at + NODE_BYTES * (k + 1)] for k in range(n)]
        low = np.frombuffer(raw, np.uint8, offset=at + NODE_BYTES * n).reshape(-1, HASH_BYTES)
        wide = np.zeros((len(low), 8), np.uint8)
        wide[:, :HASH_BYTES] = low
        hashes.append(wide.view("<u8").ravel())
    names = sorted(set(nodes))
    number = {node: k for k, node in enumerate(names)}
    own = np.fromiter(map(number.__getitem__, nodes), np.int64, len(nodes))
    return np.concatenate(hashes), np.repeat(own, np.concatenate(counts)), names


#: A row is the set of a document, or a hub, the nodes that share a signature with it, and the lists of three nodes
#: and more (numbers of ``members``).
SET_DDL = "doc_id long, text_crc32 long, n long, node binary, sketch binary"
POST_DDL = SET_DDL + ", bucket int, payload binary"
FOUND_DDL = SET_DDL + ", hub binary, members array<binary>, lists binary"
NO_SET = (None,) * 5


def stars(hashes: np.ndarray, owner: np.ndarray, names: list[bytes]) -> Iterator[tuple]:
    """The lists of nodes that share a signature, by hub, the least of each; equal lists once."""
    order = np.lexsort((owner, hashes))
    hashes, owner = hashes[order], owner[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])) if len(hashes) else np.zeros(0, bool)
    hashes, owner = hashes[new], owner[new]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(hashes)))
    digest = np.add.reduceat(mix(owner.astype(np.uint64) + np.uint64(1)), first) if len(first) else np.zeros(0, np.uint64)
    shared = np.flatnonzero(size > 1)
    _, keep = np.unique(np.stack([owner[first[shared]].astype(np.uint64), digest[shared]], 1), axis=0, return_index=True)
    chosen = shared[np.sort(keep)]
    chosen = chosen[np.argsort(owner[first[chosen]], kind="stable")]
    hub = owner[first[chosen]]
    for part in np.split(np.arange(len(chosen)), np.flatnonzero(np.diff(hub)) + 1):
        if not len(part):
            continue
        lists = [owner[first[k] + 1:first[k] + size[k]] for k in chosen[part].tolist()]
        members = np.unique(np.concatenate(lists))
        long = [x for x in lists if len(x) > 1]
        packed = b"".join(np.append(len(x), np.searchsorted(members, x)).astype("<u4").tobytes() for x in long)
        yield names[hub[part[0]]], [names[k] for k in members.tolist()], zlib.compress(packed, 1) if long else None


def signed_sets(docs: DataFrame) -> DataFrame:
    """``FOUND_DDL`` of ``docs (doc_id, text)``: the set of each row, and what shares signatures.

    A node is the digest of a set, 96 bits. Texts are read once: sets go along with the signatures.
    """
    import bisect

    ends = band_ends(1 << 40)
    layouts = [layout(k, end) for k, end in enumerate(ends)]
    buckets = block_count(docs, BUCKET_BYTES)

    def post(rows):
        import xxhash

        shingler, packer, seen = Shingler(), Packer(buckets), set()
        sets, lays, owners, nodes, size = [], [], [], [], 0

        def add():
            hashes, own = signatures(sets, lays)
            packer.add(hashes, np.array(owners, np.int64)[own] if len(own) else own, nodes)

        for doc_id, text in rows:
            own = shingler.hashes(text)
            crc = zlib.crc32(utf8(text))
            if not len(own):
                yield doc_id, crc, 0, None, None, crc % buckets, None
                continue
            node = xxhash.xxh3_128_digest(own.tobytes())[:NODE_BYTES]
            yield doc_id, crc, len(own), node, parity_sketch(own), crc % buckets, None
            if node in seen:  # a set is posted once
                continue
            if len(seen) >= 500_000:
                seen.clear()
            seen.add(node)
            band = bisect.bisect_left(ends, len(own))
            for lay in layouts[band:band + 2]:
                if lay:
                    sets.append(own)
                    lays.append(lay)
                    owners.append(len(nodes))
            nodes.append(node)
            size += len(own)
            if size >= TOGETHER:
                add()
                sets, lays, owners, nodes, size = [], [], [], [], 0
                if packer.n >= PACKED:
                    yield from ((*NO_SET, *row) for row in packer.flush())
        if sets:
            add()
        yield from ((*NO_SET, *row) for row in packer.flush())

    schema = arrow_schema(FOUND_DDL)

    def meet(group):
        is_set = pc.is_null(group.column("payload"))
        own = group.filter(is_set).drop_columns(["bucket", "payload"])
        none = {f.name: pa.nulls(len(own), f.type) for f in list(schema)[5:]}
        rows = ()
        if len(own) < len(group):
            rows = ((*NO_SET, *star) for star in stars(*unpacked(group.filter(pc.invert(is_set)).column("payload").to_pylist())))
        own = pa.table({f.name: own.column(f.name) if f.name in own.column_names else none[f.name] for f in schema}, schema=schema)
        return pa.concat_tables([own, pa.Table.from_batches(list(batches_of(rows, FOUND_DDL)), schema=schema)])

    posted = map_rows(docs.select("doc_id", "text"), post, POST_DDL)
    return posted.groupBy("bucket").applyInArrow(meet, FOUND_DDL)


# --- confirming and contracting --------------------------------------------------


def compared(rows) -> Iterator[tuple]:
    """``(key, hub, node, low)`` with a hub before its members, as ``(a, b, sure)`` for members that are similar.

    ``low`` has 32 bits of each element; a pair that these leave open is not sure.
    """
    key = own = None
    for at, is_hub, node, low in rows:
        low = np.frombuffer(low, "<u4")
        if is_hub:
            key, own = at, low
        elif at == key:
            found = similar_on_low_bits(low, own, SIMILAR)
            if found is not False:
                yield key, node, found is True


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The distinct ``pairs (a, b)`` that are similar on their full sets; sizes and sketches are looked at first.

    Sets are made again where the texts are read and sent to the hub ``a`` of each pair once; a hub with many members
    is salted. Each element is sent as 32 bits; pairs that these leave open are decided on all 64.
    """
    if pairs.isEmpty():
        return pairs
    ends = pairs.selectExpr("a AS node").unionAll(pairs.selectExpr("b AS node")).distinct()
    sizes = perhaps_in(nodes.select("node", "n"), "node", ends)
    fit = with_both(pairs, sizes).where(f"100 * least(n_a, n_b) >= {SIMILAR} * greatest(n_a, n_b)")
    fit = stored(fit.select("a", "b", "n_a", "n_b"), "fitting-pairs")
    ends = fit.selectExpr("a AS node").unionAll(fit.selectExpr("b AS node")).distinct()
    sketches = perhaps_in(nodes.select("node", "sketch"), "node", ends)

    def near(rows):
        for a, b, n_a, n_b, x, y in rows:
            if perhaps_similar(n_a, x, n_b, y):
                yield a, b

    both = with_both(fit, sketches).select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    likely = stored(map_rows(both, near, "a binary, b binary"), "likely")
    salts = likely.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("salts"))
    hubs = salts.select(
        F.col("a").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"),
        F.lit(True).alias("hub"), F.col("a").alias("node"),
    )
    members = likely.join(salts, "a").select(
        F.col("a").alias("key"), F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), F.lit(False).alias("hub"), F.col("b").alias("node")
    )
    roles = stored(hubs.unionAll(members), "roles")
    ids = perhaps_in(nodes.select("node", "doc_id"), "node", roles).join(roles.select("node").distinct(), "node")

    def low_sets(rows):
        import xxhash

        shingler = Shingler()
        for _, text in rows:
            own = shingler.hashes(text)
            yield xxhash.xxh3_128_digest(own.tobytes())[:NODE_BYTES], low_bits(own)

    sets = map_rows(perhaps_in(docs.select("doc_id", "text"), "doc_id", ids), low_sets, "node binary, low binary")
    placed = roles.join(sets, "node").repartition("key", "salt").sortWithinPartitions("key", "salt", F.desc("hub"))
    found = stored(
        map_rows(placed.select("key", "hub", "node", "low"), compared, "a binary, b binary, sure boolean").distinct(), "links"
    )
    return found.where("sure").select("a", "b").unionAll(confirmed_in_full(found.where("NOT sure").select("a", "b"), nodes, docs))


def confirmed_in_full(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    if pairs.isEmpty():
        return pairs
    sets = full_sets(pairs.selectExpr("a AS node").unionAll(pairs.selectExpr("b AS node")), nodes, docs)

    def run(rows):
        for a, b, x, y in rows:
            if similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)):
                yield a, b

    return stored(map_rows(with_both(pairs, sets).select("a", "b", "shingles_a", "shingles_b"), run, "a binary, b binary"), "full-links")


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components."""
    for side in ("a", "b"):
        pairs = pairs.join(labels.selectExpr(f"node AS {side}", f"component AS component_{side}"), side, "left")
    kept = F.coalesce("component_a", "a") != F.coalesce("component_b", "b")
    return pairs.where(kept).select("a", "b")


def list_members(found: DataFrame, hubs: DataFrame) -> DataFrame:
    """``hub, list, node`` of the lists of ``hubs (hub)`` with two members or more; a list's number is a hash of its nodes.

    The hub is left out: it was compared with each of its members.
    """

    def run(rows):
        for hub, members, lists in rows:
            raw = np.frombuffer(zlib.decompress(lists), "<u4")
            at = 0
            while at < len(raw):
                own = [members[k] for k in raw[at + 1:at + 1 + raw[at]].tolist()]
                at += 1 + int(raw[at])
                name = zlib.crc32(b"".join(own)) << 31 ^ zlib.adler32(b"".join(own))
                yield from ((hub, name, node) for node in own)

    some = found.where("lists IS NOT NULL").join(hubs, "hub", "left_semi")
    return map_rows(some.select("hub", "members", "lists"), run, "hub binary, list long, node binary").distinct()


def mixed_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``hub, node, component`` of the members of lists with several components, once a hub."""
    placed = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("hub", "list").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    return placed.join(mixed.select("hub", "list"), ["hub", "list"]).select("hub", "node", "component").distinct()


def paired_blocks(rest: DataFrame, facts: DataFrame, fact: str) -> DataFrame:
    """Blocks of the nodes of ``rest (hub, node, component)`` with ``facts (node, n, <fact>)``, each two that may have links.

    A row is a block of nodes outside the hub's largest component (columns ``…_l``) with itself or another block.
    """
    columns = ("node", "component", "n", fact)
    placed = stored(rest.join(facts.select("node", "n"), "node"), "placed-members")
    counts = placed.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("elements"))
    sizes = counts.groupBy("hub").agg(
        F.max_by("component", F.struct("k", "component")).alias("main"),
        F.ceil(F.greatest(F.sum("k") / BLOCK, F.sum("elements") / BLOCK_ELEMENTS)).alias("salts"),
        F.count(F.lit(1)).alias("parts"),
    ).where("parts > 1")
    is_main = (F.col("component") == F.col("main")).alias("main")
    salt = F.pmod(F.xxhash64("node"), F.col("salts")).alias("salt")
    dealt = placed.join(sizes, "hub").select("hub", is_main, salt, "node", "component", "n")
    blocks = stored(
        dealt.join(facts.select("node", fact), "node").groupBy("hub", "main", "salt").agg(*[F.collect_list(c).alias(c) for c in columns]),
        "blocks",
    )
    left = blocks.where("NOT main").select("hub", *[F.col(c).alias(f"{c}_l") for c in ("salt", *columns)])
    joined = left.join(blocks, "hub").where("main OR salt_l <= salt")
    return joined.select(*(f"{c}_l" for c in columns), *columns, (~F.col("main") & (F.col("salt_l") == F.col("salt"))).alias("same"))


def sketch_stack(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches of ``width`` bytes, a row a set, in words of 64 bits."""
    return np.stack([folded(s, width) for s in sketches]).view(np.uint64)


def perhaps_linked(rows) -> Iterator[tuple]:
    """The nodes of paired blocks that sizes and sketches let be similar to one of another component."""
    for nodes_l, parts_l, sizes_l, sketches_l, nodes, parts, sizes, sketches, _ in rows:
        width = min(map(len, (*sketches_l, *sketches)))
        left, right = sketch_stack(sketches_l, width), sketch_stack(sketches, width)
        sizes = np.array(sizes)
        code = {p: k for k, p in enumerate(dict.fromkeys((*parts, *parts_l)))}
        part = np.array([code[p] for p in parts])
        asked = np.zeros(len(nodes), bool)
        for node, own_part, n, sketch in zip(nodes_l, parts_l, sizes_l, left):
            fits = (part != code[own_part]) & (100 * np.minimum(sizes, n) >= SIMILAR * np.maximum(sizes, n))
            near = np.flatnonzero(fits)
            near = near[np.bitwise_count(right[near] ^ sketch).sum(1, dtype=np.int64) <= most_apart(sizes[near], n)]
            if len(near):
                asked[near] = True
                yield (node,)
        yield from ((nodes[k],) for k in np.flatnonzero(asked).tolist())


def joining_links(rows) -> Iterator[tuple]:
    """Links of paired blocks that join components, on full sets; what two nodes have linked is not linked again."""
    for nodes_l, parts_l, sizes_l, sets_l, nodes, parts, sizes, sets, same in rows:
        full_l, full = ([np.frombuffer(s, np.uint64) for s in side] for side in (sets_l, sets))
        least = min(map(len, (*full_l, *full)))  # a byte an element, a power of two
        width = min(MOST_BITS // 8, max(8, 1 << least.bit_length() - 1))
        sketches_l, sketches = (sketch_stack([parity_sketch(s, width) for s in side], width) for side in (full_l, full))
        sizes = np.array(sizes)
        code = {p: k for k, p in enumerate(dict.fromkeys((*parts, *parts_l)))}
        part, part_l = (np.array([code[p] for p in side]) for side in (parts, parts_l))
        name = np.arange(len(code))  # of the component that each is part of by now
        for i, (node, own, n) in enumerate(zip(nodes_l, full_l, sizes_l)):
            fits = (name[part] != name[part_l[i]]) & (100 * np.minimum(sizes, n) >= SIMILAR * np.maximum(sizes, n))
            if same:
                fits[:i + 1] = False
            near = np.flatnonzero(fits)
            differ = np.bitwise_count(sketches[near] ^ sketches_l[i]).sum(1, dtype=np.int64)
            fit = differ <= most_apart(sizes[near], n)
            for k in near[fit][np.argsort(differ[fit], kind="stable")].tolist():
                x, y = name[part_l[i]], name[part[k]]
                if x != y and similar(own, full[k]):
                    name[name == y] = x
                    yield min(node, nodes[k]), max(node, nodes[k])


def cross_links(members: DataFrame, nodes: DataFrame, labels: DataFrame, docs: DataFrame) -> DataFrame:
    """Links that join the components of ``members (hub, list, node)``, as all similar pairs of each list would."""
    rest = stored(mixed_members(members, labels), "mixed-members")
    if rest.isEmpty():
        return rest.selectExpr("node AS a", "node AS b")
    sketches = stored(perhaps_in(nodes.select("node", "n", "sketch"), "node", rest), "member-sketches")
    asked = stored(map_rows(paired_blocks(rest, sketches, "sketch"), perhaps_linked, "node binary").distinct(), "asked")
    rest = rest.join(asked, "node", "left_semi")
    facts = full_sets(asked, nodes, docs).withColumn("n", (F.octet_length("shingles") / 8).cast("long"))
    links = map_rows(paired_blocks(rest, facts, "shingles"), joining_links, "a binary, b binary")
    return stored(links.distinct(), "cross-links")


def with_more(links: DataFrame, labels: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links with ``more``, and the components they make: those known are contracted further."""
    if more.isEmpty():
        return links, labels
    named = more
    for side in ("a", "b"):
        known = labels.selectExpr(f"node AS {side}", f"component AS known_{side}")
        named = named.join(known, side, "left").withColumn(f"c_{side}", F.coalesce(f"known_{side}", side))
    moved = connected_components(named.selectExpr("c_a AS a", "c_b AS b"))
    moved = stored(moved.withColumnsRenamed({"node": "old", "component": "new"}), "moved")
    grown = labels.join(moved, labels["component"] == moved["old"], "left").select("node", F.coalesce("new", "component").alias("component"))
    fresh = moved.selectExpr("old AS node", "new AS component").join(labels, "node", "left_anti")
    return links.unionAll(more), stored(grown.unionAll(fresh), "labels")


def ngram_join(docs: DataFrame) -> DataFrame:
    """Components of documents with similar n-grams: ``doc_id, n_shingles, component_id, text_crc32``, a row a document.

    Input ``doc_id``, ``text``; other columns are ignored. A document's set are its distinct five-word shingles (A-Z
    lower-cased, words are runs of anything but ASCII white space); fewer than five words are one shingle; null, empty
    and wordless texts have none and are linked with nothing. Documents are linked from a Jaccard similarity of 0.8
    on, all of them found; ``component_id`` is the least id reachable. Rows with the same id are judged by their own
    texts; null ids name no component that has another id. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    found = stored(signed_sets(docs), "signed-sets")
    sketched = found.where("hub IS NULL").select("doc_id", "text_crc32", "n", "node", "sketch")
    nodes = stored(
        sketched.where("node IS NOT NULL").groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "set-nodes",
    )
    found = found.where("hub IS NOT NULL").select("hub", "members", "lists")

    # one hub a node first: that contracts most of a group
    pairs = stored(found.select(F.col("hub").alias("a"), F.explode("members").alias("b")).distinct(), "star-pairs")
    links = confirmed(stored(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first-pairs"), nodes, docs)
    labels = stored(connected_components(links), "labels")
    more = stored(apart(pairs, labels), "second-pairs")
    links, labels = with_more(links, labels, confirmed(more, nodes, docs))
    hubs = apart(more, labels).selectExpr("a AS hub").distinct()
    members = stored(list_members(found, hubs), "lists")
    links, labels = with_more(links, labels, cross_links(members, nodes, labels, docs))

    named = nodes.select("node", "doc_id").join(labels, "node", "left").select(
        "node", "doc_id", F.coalesce("component", "node").alias("component")
    )
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select("node", "component_id")
    out = sketched.select("doc_id", "text_crc32", F.col("n").alias("n_shingles"), "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "text_crc32")
