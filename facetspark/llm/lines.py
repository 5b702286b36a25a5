"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity, by the number of lines that hold them, counted over
the whole corpus in a table of fixed size (words that share a counter share their rank; any common order is exact).
Two sets of a given similarity share a word among the first few of each in that order, so only those words are
posted. Postings of one word meet in one bucket, where length, position and a bitmap of the sets bound the
overlap. Sets that this leaves together form groups there, named by their least member. A set's words are then sent
once to each of its groups, where pairs are verified on the words; a pair is counted in the first group it shares.
What leaves a task is a row a set, never its pairs. Lines that match an earlier line are removed.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetspark.llm.common import arrow_schema, batches_of, block_count, give_back, map_batches, map_rows, stored, summed, utf8
from facetspark.llm.minhash import perhaps_in

#: Jaccard similarity of two lines' words from which they match, in percent.
SIMILAR = 80
#: Counters of the rarity table.
COUNTERS = 1 << 20
#: Bytes of stored documents a bucket of postings stands for; texts and postings handled together.
BUCKET_BYTES = 4 << 20
SLICE_BYTES = 1 << 20
POSTINGS = 400_000
#: Pairs looked at together.
PAIRS = 1 << 16
#: A word in more lines is dealt to a grid of buckets, in each of which two parts of its postings meet.
HOT_LINES = 50_000
#: Bytes of words from which a group is split into parts, each two of which meet in a cell.
GROUP_BYTES = 1 << 20
#: Sets a task remembers to have posted.
KNOWN = 500_000
NO_DOC = 2**63 - 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class LineSets:
    """The lines of some texts as sets of words: ``code`` by ``line``, sorted and distinct; ``hashes`` by code."""

    def __init__(self, texts: pa.Array):
        split = pc.split_pattern(pc.fill_null(texts, ""), "\n")
        self.lines_of = np.diff(split.offsets.to_numpy())
        words = pc.ascii_split_whitespace(split.flatten())
        self.n_lines = len(words)
        coded = words.flatten().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        line = np.repeat(np.arange(self.n_lines), np.diff(words.offsets.to_numpy()))
        filled = pc.greater(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
        full = filled[code]
        pairs = sorted_distinct((line[full] << 32) | code[full])
        self.line, self.code = pairs >> 32, pairs & 0xFFFFFFFF
        self.hashes = word_hashes(coded.dictionary)
        self.size = np.bincount(self.line, minlength=self.n_lines)

    @property
    def word(self) -> np.ndarray:
        return self.hashes[self.code]

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent sums over each line's words: equal sets have equal digests."""
        first = np.flatnonzero(new_value(self.line))
        out = []
        for k in (1, 2):
            total = np.zeros(self.n_lines, np.uint64)
            if len(first):
                total[self.line[first]] = np.add.reduceat(mix(self.hashes + np.uint64(k))[self.code], first)
            out.append(mix(total))
        return out[0], out[1]

    def bitmaps(self, words: int = 2) -> np.ndarray:
        """64 bits times ``words`` (a power of two) a line, one set for each word."""
        bits = np.zeros((self.n_lines, words), np.uint64)
        place = (mix(self.hashes) & np.uint64(64 * words - 1)).astype(np.int64)[self.code]
        np.bitwise_or.at(bits, (self.line, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        return bits


def new_value(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the row before it."""
    if not len(columns[0]):
        return np.zeros(0, bool)
    return np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))


def sorted_distinct(values: np.ndarray) -> np.ndarray:
    """As ``np.unique``, which hashes where sorting is many times faster."""
    values = np.sort(values)
    return values[new_value(values)]


def word_hashes(words: pa.Array) -> np.ndarray:
    """64 bits a word: the mixed sum of a value for each byte at its place."""
    words = words.cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    starts, ends = ends[:-1], ends[1:]
    if not len(starts) or starts[0] == ends[-1]:
        return mix((ends - starts).astype(np.uint64))
    data = np.frombuffer(words.buffers()[2], np.uint8)[starts[0]:ends[-1]]
    place = np.arange(len(data)) - np.repeat(starts - starts[0], ends - starts)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix((place.astype(np.uint64) << np.uint64(8)) + data + np.uint64(1)), out=total[1:])
    return mix(total[ends - starts[0]] - total[starts - starts[0]] + (ends - starts).astype(np.uint64))


def slices(batches):
    """Batches ``(doc_id, text)`` in parts of bounded size."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def counter_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(20)).astype(np.int64) & (COUNTERS - 1)


def rarity(lines: DataFrame) -> np.ndarray:
    """Lines that hold a word of each counter: the sum of what the tasks of ``line_classes`` left in their last rows."""

    def total(rows):
        return sum((np.frombuffer(zlib.decompress(c), "<i8") for (c,) in rows), np.zeros(COUNTERS, np.int64))

    return summed(lines.where("counts IS NOT NULL").select("counts"), total, COUNTERS)


def prefix_length(size):
    """Words of a set of which a similar set must have one, in any common order of words."""
    return size + (-size * SIMILAR // 100) + 1


def overlap_needed(a, b):
    return -(-(a + b) * SIMILAR // (100 + SIMILAR))


def least_partner(size):
    return -(-size * SIMILAR // 100)


def postings(sets: LineSets, counts: np.ndarray, wanted: np.ndarray, digest: np.ndarray) -> dict[str, np.ndarray]:
    """The first words of the ``wanted`` lines in order of rarity; words that no other line has are left out."""
    count = counts[counter_of(sets.hashes)]
    by_rank = np.lexsort((sets.hashes, count))
    rank = np.empty(len(by_rank), np.int64)
    rank[by_rank] = np.arange(len(by_rank))
    chosen = wanted[sets.line]
    key = np.sort((sets.line[chosen] << 32) | rank[sets.code[chosen]])
    line, code = key >> 32, by_rank[key & 0xFFFFFFFF]
    first = np.flatnonzero(new_value(line))
    size = np.diff(np.append(first, len(line)))
    at = np.arange(len(line)) - np.repeat(first, size)
    size = np.repeat(size, size)
    count = count[code]
    keep = np.flatnonzero((at < prefix_length(size)) & (count > 1))
    out = {
        "word": sets.hashes[code[keep]], "cls": digest[line[keep]], "size": size[keep].astype(np.uint32),
        "at": at[keep].astype(np.uint32), "bits": sets.bitmaps()[line[keep]],
    }
    return deal_hot(out, count[keep])


def deal_hot(found: dict[str, np.ndarray], count: np.ndarray) -> dict[str, np.ndarray]:
    """Postings of frequent words once for each bucket of their grid row and column."""
    parts = np.sqrt(count // HOT_LINES).astype(np.int64) + 1
    if not (parts > 1).any():
        return found
    repeat = np.repeat(np.arange(len(parts)), parts)
    other = np.arange(len(repeat)) - np.repeat(np.cumsum(parts) - parts, parts)
    own = (mix(found["cls"]) >> np.uint64(8)).astype(np.int64)[repeat] % parts[repeat]
    low, high = np.minimum(own, other), np.maximum(own, other)
    out = {k: v[repeat] for k, v in found.items()}
    cell = mix(out["word"] + mix((low * parts[repeat] + high + 1).astype(np.uint64)))
    out["word"] = np.where(parts[repeat] > 1, cell, out["word"])
    return out


FIELDS = (("word", "<u8", 1), ("cls", "<u8", 1), ("size", "<u4", 1), ("at", "<u4", 1), ("bits", "<u8", 2))


def packed(found: dict[str, np.ndarray], part: np.ndarray) -> bytes:
    """Postings as bytes; only the small numbers are worth compressing."""
    small = zlib.compress(b"".join(found[k][part].astype("<u4").tobytes() for k in ("size", "at")), 1)
    return b"".join([
        len(part).to_bytes(8, "little"), *(found[k][part].astype("<u8").tobytes() for k in ("word", "cls", "bits")), small,
    ])


def unpacked(payloads: list[bytes]) -> dict[str, np.ndarray]:
    out = {k: [] for k, _, _ in FIELDS}
    for raw in payloads:
        n = int.from_bytes(raw[:8], "little")
        out["word"].append(np.frombuffer(raw, "<u8", n, 8))
        out["cls"].append(np.frombuffer(raw, "<u8", n, 8 + 8 * n))
        out["bits"].append(np.frombuffer(raw, "<u8", 2 * n, 8 + 16 * n).reshape(-1, 2))
        small = np.frombuffer(zlib.decompress(raw[8 + 32 * n:]), "<u4").reshape(2, n)
        out["size"].append(small[0])
        out["at"].append(small[1])
    return {k: np.concatenate(v) for k, v in out.items()}


def windows(rank: np.ndarray, size: np.ndarray):
    """Pairs of rows with one ``rank`` whose sizes let them be similar, in parts. Rows are sorted by both."""
    key = (rank.astype(np.int64) << 32) | size
    low = np.searchsorted(key, (rank.astype(np.int64) << 32) | least_partner(size))
    todo = np.maximum(np.arange(len(key)) - low, 0)
    ends = np.cumsum(todo)
    start = 0
    while start < len(key):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        own = np.repeat(np.arange(start, stop), todo[start:stop])
        yield own, np.arange(len(own)) - np.repeat(ends[start:stop] - todo[start:stop] - before, todo[start:stop]) + low[own]
        start = stop


def enough_bits(size: np.ndarray, bits: np.ndarray, own: np.ndarray, other: np.ndarray, need: np.ndarray) -> np.ndarray:
    differ = np.bitwise_count(bits[own] ^ bits[other]).sum(1, dtype=np.int64)
    return size[own] + size[other] - differ >= 2 * need


def candidate_groups(found: dict[str, np.ndarray]) -> np.ndarray:
    """Distinct rows ``(class, group)`` of the postings of some words.

    Classes that share a posted word are linked where length, position and bitmap let them be similar; a group is
    what such links connect at one word, named by its least class. No other classes than these can be similar.
    """
    size, at = found["size"].astype(np.int64), found["at"].astype(np.int64)
    order = np.lexsort((found["cls"], size, found["word"]))
    order = order[new_value(found["word"][order], found["cls"][order])]
    word, cls, bits, size, at = found["word"][order], found["cls"][order].view(np.int64), found["bits"][order], size[order], at[order]
    group = np.arange(len(order))
    for own, other in windows(np.cumsum(new_value(word)), size):
        need = overlap_needed(size[own], size[other])
        most = 1 + np.minimum(at[own], at[other]) + np.minimum(size[own] - at[own], size[other] - at[other]) - 1
        own, other, need = (v[most >= need] for v in (own, other, need))
        hit = enough_bits(size, bits, own, other, need)
        join_groups(group, own[hit], other[hit])
    several = np.flatnonzero(np.bincount(group, minlength=len(group))[group] > 1)
    name = np.full(len(group), NO_DOC)
    np.minimum.at(name, group[several], cls[several])
    rows = np.stack([cls[several], name[group[several]]], 1)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    return rows[new_value(rows[:, 0], rows[:, 1])]


def join_groups(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Puts the groups of ``a`` and ``b`` together; ``group`` names the least row of each row's group."""
    while len(a):
        x, y = group[a], group[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(group, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := group[group], group):
            group[:] = up


LINE_DDL = "doc_id long, text_hash long, line_no int, cls long, digest long, counts binary"


def text_hash():
    """Tells rows with the same id, or without one, from each other; rows equal in both lose the same lines."""
    return F.xxhash64("text")


def line_classes(docs: DataFrame) -> DataFrame:
    """Every line with a word: its document, the hash of the text it stands in, its number and set (two digests).

    Each task adds a row with nothing but its counts of lines by word counter.
    """

    schema = arrow_schema(LINE_DDL)

    def run(batches):
        give_back()
        total = np.zeros(COUNTERS, np.int64)
        for part in slices(batches):
            sets = LineSets(part.column(1))
            total += np.bincount(counter_of(sets.word), minlength=COUNTERS)
            one, two = sets.digests()
            number = np.arange(sets.n_lines) - np.repeat(np.cumsum(sets.lines_of) - sets.lines_of, sets.lines_of)
            full = np.flatnonzero(sets.size)
            own = pa.array(np.repeat(np.arange(part.num_rows), sets.lines_of)[full])
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(own).cast(pa.int64()), part.column(2).take(own), pa.array(number[full].astype(np.int32)),
                pa.array(one[full].view(np.int64)), pa.array(two[full].view(np.int64)), pa.nulls(len(full), pa.binary()),
            ], schema=schema)
        if total.any():
            yield from batches_of([(None,) * 5 + (zlib.compress(total.astype("<i8").tobytes(), 1),)], LINE_DDL)
        give_back()

    return docs.select("doc_id", "text", text_hash()).mapInArrow(run, LINE_DDL)


def likely_groups(docs: DataFrame, counts: np.ndarray, buckets: int) -> DataFrame:
    """Distinct rows ``node, hub``: classes that may be similar have a hub in common."""
    ddl = "bucket int, payload binary"
    table = docs.sparkSession.sparkContext.broadcast(counts)  # COUNTERS numbers

    def post(batches):
        seen, held, n = set(), [], 0

        def flush():
            found = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            bucket = ((mix(found["word"]) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(part):
                    yield int(bucket[part[0]]), packed(found, part)

        for part in slices(batches):
            sets = LineSets(part.column(1))
            digest, _ = sets.digests()
            wanted = np.zeros(sets.n_lines, bool)
            for k in np.flatnonzero(sets.size).tolist():  # a set is posted once
                value = int(digest[k])
                if value not in seen:
                    seen.add(value)
                    wanted[k] = True
            if len(seen) > KNOWN:
                seen.clear()
            held.append(postings(sets, table.value, wanted, digest))
            n += len(held[-1]["word"])
            if n >= POSTINGS:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()

    schema = arrow_schema("node long,hub long")

    def meet(group):
        rows = candidate_groups(unpacked(group.column("payload").to_pylist()))
        return pa.table([pa.array(rows[:, 0]), pa.array(rows[:, 1])], schema=schema)

    posted = map_batches(docs.select("doc_id", "text"), post, ddl)
    return posted.groupBy("bucket").applyInArrow(meet, "node long, hub long").distinct()


WORDS_DDL = "node long,doc long,line int,n_bytes long,words string"


def line_words(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``node, doc, line, n_bytes, words`` of ``classes (node, doc_id, text_hash, line_no, digest)``.

    ``words`` are the distinct words of the class's first line, ``doc`` and ``line`` are its place. Lines are taken
    from the texts where these are read: only those that may be asked for are shuffled.
    """
    some = perhaps_in(docs.select("doc_id", "text", text_hash().alias("text_hash")), "text_hash", classes)
    every = some.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "own"))
    asked = perhaps_in(every, ["text_hash", "line_no"], classes)
    wanted = classes.withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash", "line_no": "_line"})
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")) & (F.col("line_no") == F.col("_line"))
    found = asked.join(wanted, same).select("node", "digest", F.coalesce("_doc", F.lit(NO_DOC)), "_line", "own")

    def run(batches):
        for batch in batches:
            # texts may have equal hashes; the digest tells whose line it is
            own = batch.column(4)
            one, two = LineSets(own).digests()
            mine = (one.view(np.int64) == batch.column(0).to_numpy()) & (two.view(np.int64) == batch.column(1).to_numpy())
            places = zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)))
            for ours, place, line in zip(mine.tolist(), places, own.to_pylist()):
                if ours and (words := set(utf8(line).split())):
                    joined = b" ".join(words)
                    yield *place, len(joined), joined.decode()

    return map_batches(found, run, WORDS_DDL).dropDuplicates(["node"])


LINKS_DDL = "node long,n_links long,doc long,line int"


def links_of(shared: DataFrame, words: DataFrame, buckets: int) -> DataFrame:
    """``node, n_links, partner`` of the classes with links: how many, and the least place of a linked class.

    The parts of a large group meet two by two in cells; only pairs of different parts count in a cell of two.
    """
    size = shared.join(words.select("node", "n_bytes"), "node").groupBy("hub").agg(
        F.ceil(F.sum("n_bytes") / GROUP_BYTES).cast("int").alias("parts")
    )
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    placed = shared.join(size, "hub").select(
        "node", "hub", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    )
    cells = placed.groupBy("node").agg(
        F.collect_list(F.struct("hub", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))).alias("cells")
    )
    hubs = F.array_distinct(F.transform("cells", lambda c: c["hub"]))
    sent = words.join(cells, "node").select(
        F.explode("cells").alias("cell"), hubs.alias("hubs"), "node", "doc", "line", "words"
    ).select("cell.*", "hubs", "node", "doc", "line", "words")
    bucket = F.pmod(F.xxhash64("hub", "low", "high"), F.lit(buckets)).alias("bucket")
    found = sent.groupBy(bucket).applyInArrow(verified, LINKS_DDL)
    return found.groupBy("node").agg(F.sum("n_links").alias("n_links"), F.min(F.struct("doc", "line")).alias("partner"))


def verified(table: pa.Table) -> pa.Table:
    """The links of the classes in some cells, a row a class and cell."""
    table = table.combine_chunks()
    sets = LineSets(pa.array(table.column("words").to_pylist(), pa.string()))
    hub, low, high, part = (table.column(c).to_numpy() for c in ("hub", "low", "high", "part"))
    order = np.lexsort((sets.size, high, low, hub))
    rank = np.cumsum(new_value(hub[order], low[order], high[order]))
    size, bits = sets.size[order].astype(np.int64), sets.bitmaps(8)[order]
    part, both_parts, hub = part[order], (low != high)[order], hub[order].tolist()
    codes = sets.code.tolist()
    ends = np.cumsum(sets.size)
    members = [set(codes[e - n:e]) for e, n in zip(ends[order].tolist(), size.tolist())]
    hubs = [set(h) for h in table.column("hubs").take(pa.array(order)).to_pylist()]
    place = list(zip(table.column("doc").to_numpy()[order].tolist(), table.column("line").to_numpy()[order].tolist()))
    sizes, n_links, best = size.tolist(), [0] * len(order), [None] * len(order)
    for own, other in windows(rank, size):
        meet = ~both_parts[own] | (part[own] != part[other])
        own, other = own[meet], other[meet]
        likely = enough_bits(size, bits, own, other, overlap_needed(size[own], size[other]))
        for a, b in zip(own[likely].tolist(), other[likely].tolist()):
            if min(hubs[a] & hubs[b]) != hub[a]:
                continue  # a pair counts in the first group it shares
            both = len(members[a] & members[b])
            if 100 * both < SIMILAR * (sizes[a] + sizes[b] - both):
                continue
            n_links[a] += 1
            n_links[b] += 1
            if best[a] is None or place[b] < best[a]:
                best[a] = place[b]
            if best[b] is None or place[a] < best[b]:
                best[b] = place[a]
    node = table.column("node").to_numpy()[order].tolist()
    rows = ((node[k], n_links[k], *best[k]) for k in range(len(order)) if n_links[k])
    return pa.Table.from_batches(list(batches_of(rows, LINKS_DDL)), schema=arrow_schema(LINKS_DDL))


def matched_lines(docs: DataFrame) -> DataFrame:
    """Every line with a word: ``doc_id, text_hash, line_no, class_doc, class_line, n_links, removed``.

    Input ``doc_id``, ``text``; other columns are ignored. Lines end at \\n, words are runs of anything but ASCII
    white space. Two lines match when their sets of words have a Jaccard similarity of 0.8 or more. A class is a
    set of words, named by its first line; ``n_links`` counts the other classes that match it. A line is removed
    when it matches a line that stands earlier, in a smaller doc_id or before it in its document, removed or not.
    Lines without a word and null texts have no row and are never removed. Rows with the same id stand at the same
    place and take no lines from each other where their line numbers are equal; rows without an id stand last. An
    empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    place = F.struct(F.coalesce("doc_id", F.lit(NO_DOC)).alias("doc"), F.col("line_no").alias("line"))
    found = stored(line_classes(docs), "lines")
    lines = found.where("cls IS NOT NULL").drop("counts")
    classes = stored(
        lines.groupBy("cls", "digest").agg(
            F.min(F.struct(place.alias("place"), F.col("doc_id"), F.col("text_hash"))).alias("first")
        ).select(
            F.col("cls").alias("node"), "digest", F.col("first.place").alias("first"), F.col("first.doc_id").alias("doc_id"),
            F.col("first.text_hash").alias("text_hash"),
        ),
        "line-classes",
    )
    buckets = block_count(docs, BUCKET_BYTES)
    shared = stored(likely_groups(docs, rarity(found), buckets), "line-groups")
    ends = shared.select("node").distinct()
    wanted = perhaps_in(classes, "node", shared).join(ends, "node", "left_semi")
    wanted = wanted.select("node", "doc_id", "text_hash", F.col("first.line").alias("line_no"), "digest")
    words = stored(line_words(docs, stored(wanted, "wanted-lines")), "line-words")
    # groups carry words: more and smaller buckets than of postings
    partners = stored(links_of(shared, words, 4 * buckets), "line-links").withColumnRenamed("node", "a")
    facts = classes.join(partners.withColumnRenamed("a", "node"), "node", "left").select(
        F.col("node").alias("cls"), "digest", "first", F.least("first", "partner").alias("least"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("doc_id").alias("class_doc"),
    )
    return lines.join(facts, ["cls", "digest"]).select(
        "doc_id", "text_hash", "line_no", "class_doc", F.col("first.line").alias("class_line"), "n_links", (F.col("least") < place).alias("removed")
    )


def line_report(docs: DataFrame) -> DataFrame:
    """One row a document: ``doc_id, n_lines, n_removed, n_links, removed_lines`` (``matched_lines`` put together).

    ``n_lines`` counts the lines with a word, ``n_links`` sums their links, ``removed_lines`` names the numbers of
    the removed ones in ascending order, with commas between. Rows with the same id are put together.
    """
    found = matched_lines(docs).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("removed").cast("long")).alias("n_removed"), F.sum("n_links").alias("n_links"),
        F.array_sort(F.collect_list(F.when(F.col("removed"), F.col("line_no")))).alias("removed_lines"),
    )
    ids = docs.select("doc_id").distinct()
    zero = F.lit(0).cast("long")
    return ids.join(found, ids["doc_id"].eqNullSafe(found["doc_id"]), "left").select(
        ids["doc_id"], *[F.coalesce(c, zero).alias(c) for c in ("n_lines", "n_removed", "n_links")],
        F.coalesce(F.array_join("removed_lines", ","), F.lit("")).alias("removed_lines"),
    )


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed lines cut from ``text``; all columns and rows stay.

    Each row loses the lines that ``matched_lines`` removes from its own text, also where rows have the same id or none.
    """
    gone = matched_lines(docs).where("removed").groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(
        F.collect_set("line_no").alias("_gone")  # equal rows have the same numbers
    )
    kept = F.array_join(F.filter(
        F.transform(F.split("text", "\n", -1), lambda line, k: F.when(~F.array_contains("_gone", k), line)), lambda line: line.isNotNull()
    ), "\n")
    joined = docs.join(gone, F.col("_doc").eqNullSafe(docs["doc_id"]) & (F.col("_hash") == text_hash()), "left")
    return joined.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept)).select(docs.columns)
