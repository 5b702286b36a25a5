"""The n-gram join against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from facetspark.llm import partenum
from test_corpus_small import WORDS, documents, odd_rows, sentence


def layout_of(size, ends):
    return next(k for k, end in enumerate(ends) if size <= end)


@pytest.mark.parametrize("size", [4, 5, 7, 9, 12, 16, 20, 27, 35, 60, 150, 700])
def test_similar_sets_share_a_signature(size):
    draw = np.random.default_rng(size)
    ends = partenum.band_ends(2000)
    for _ in range(150):
        base = draw.integers(0, 2**63, size, dtype=np.uint64)
        drop = draw.integers(0, size // 9 + 2)
        add = draw.integers(0, size // 9 + 2)
        other = np.append(base[drop:], draw.integers(0, 2**63, add, dtype=np.uint64))
        both = size - drop
        if 100 * both < 80 * (size + add) or not add + drop:
            continue
        bands = [layout_of(len(x), ends) for x in (base, other)]
        assert abs(bands[0] - bands[1]) <= 1
        lay = partenum.layout(max(bands), ends[max(bands)])
        a, b = (set(partenum.signatures([x], [lay])[0].tolist()) for x in (base, other))
        assert a & b


def test_groups_guarantee_a_common_subset():
    ends = partenum.band_ends(10_000)
    for k, end in enumerate(ends):
        lay = partenum.layout(k, end)
        assert (lay is None) == (2 * end // 9 == 0)
        if lay:
            assert lay.sure >= 1 and lay.apart == 2 * end // 9 and len(lay.subsets[0]) == lay.parts - lay.leave_out


def test_sketches_bound_the_difference():
    draw = np.random.default_rng(3)
    for _ in range(200):
        a = draw.integers(0, 2**63, int(draw.integers(1, 300)), dtype=np.uint64)
        b = np.append(a[int(draw.integers(0, len(a))):], draw.integers(0, 2**63, int(draw.integers(0, 40)), dtype=np.uint64))
        if not len(b):
            continue
        differ = len(np.setxor1d(a, b))
        x, y = partenum.parity_sketch(a), partenum.parity_sketch(b)
        size = min(len(x), len(y))
        assert np.bitwise_count(partenum.folded(x, size) ^ partenum.folded(y, size)).sum() <= differ
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert partenum.perhaps_similar(len(a), x, len(b), y)


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k:k + 5]) for k in range(max(len(words) - 4, 1))) if words else frozenset()


def plain_join(rows):
    """doc_id, set size and least id reachable, by comparing all pairs; ids are distinct."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {(i, len(s), root(i)) for i, s in sets.items()}


def copies():
    """Groups of near copies at all sizes, chains, and a passage in every document."""
    draw = random.Random(11)
    common = sentence(draw, 30)
    rows = []
    for k in range(40):
        words = sentence(draw, draw.choice([3, 5, 8, 9, 10, 14, 25, 40, 90, 300])).split()
        for _ in range(draw.choice([1, 2, 6])):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(draw.choice([0, 1, 1, 2])):
                words[draw.randrange(len(words))] = draw.choice(WORDS)
            if draw.random() < 0.3:
                words.append(draw.choice(WORDS))
    for k in range(60):  # much in common, not enough
        rows.append((len(rows), common + " " + sentence(draw, draw.choice([5, 8, 12, 20]))))
    return rows


@pytest.mark.parametrize("block", [256, 2])
def test_join_agrees_with_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(partenum, "BLOCK", block)
    rows = copies()
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in partenum.ngram_join(documents(spark, rows)).collect()}
    assert got == plain_join(rows)


def test_join_of_odd_documents(spark):
    rows = odd_rows()
    got = partenum.ngram_join(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert by_id[1] == {(0, 1)} and by_id[2] == {(0, 2)} and by_id[3] == {(0, 3)}
    assert {c for _, c in by_id[4] | by_id[5]} == {4} and by_id[12] == {(7996, 12)} and by_id[10] == by_id[11] == {(1, 10)}
    assert partenum.ngram_join(documents(spark, [])).count() == 0


def test_near_misses_of_a_group_make_no_rows_of_pairs(spark, monkeypatch):
    """A hundred texts of one common part, nearly similar: what leaves the tasks grows with the texts, not their pairs."""
    draw = random.Random(5)
    base = sentence(draw, 40)
    rows = [(k, " ".join([base, *(f"own{draw.randrange(10**6)}" for _ in range(6))])) for k in range(100)]
    made, plain = [], partenum.stored

    def counted(df, name):
        out = plain(df, name)
        if name.startswith("cross"):
            made.append(out.count())
        return out

    monkeypatch.setattr(partenum, "stored", counted)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in partenum.ngram_join(documents(spark, rows)).collect()}
    assert got == plain_join(rows)
    assert made and max(made) <= len(rows)


def test_links_of_blocks_join_components():
    """Links of two blocks: all that joins, none twice, and nothing inside a component."""
    draw = np.random.default_rng(7)
    base = np.sort(draw.integers(0, 2**63, 100, dtype=np.uint64))
    sets = [np.sort(np.append(base[4:], draw.integers(0, 2**63, 4, dtype=np.uint64))) for _ in range(30)]
    sets += [np.sort(np.append(base[40:], draw.integers(0, 2**63, 40, dtype=np.uint64))) for _ in range(30)]  # not similar
    nodes = [bytes([k]) * 16 for k in range(60)]
    for same in (False, True):
        side = (nodes, nodes, [100] * 60, [s.tobytes() for s in sets])
        found = list(partenum.joining_links([(*side, *side, same)]))
        assert len(found) == len(set(found)) == 29 and {x for pair in found for x in pair} == set(nodes[:30])
        sketched = (*side[:3], [partenum.parity_sketch(s) for s in sets])
        assert set(nodes[:30]) <= {node for node, in partenum.perhaps_linked([(*sketched, *sketched, same)])}
    one = (nodes[:30], [nodes[0]] * 30, [100] * 30, [s.tobytes() for s in sets[:30]])
    assert not list(partenum.joining_links([(*one, *one, False)]))


def test_packed_signatures_name_their_nodes_in_few_bytes():
    draw = np.random.default_rng(3)
    nodes = [draw.bytes(partenum.NODE_BYTES) for _ in range(3000)]
    packer = partenum.Packer(1)
    hashes = draw.integers(0, 2**63, 3001, dtype=np.uint64)
    packer.add(hashes, np.append(np.arange(3000), 7), nodes)
    (_, payload), = packer.flush()
    assert len(payload) < 18.5 * 3001
    back, owner, names = partenum.unpacked([payload])
    assert names == sorted(nodes)
    low = np.uint64((1 << 8 * partenum.HASH_BYTES) - 1)
    want = {(nodes[k], int(h)) for k, h in zip([*range(3000), 7], (partenum.mix(hashes) & low).tolist())}
    assert {(names[k], h) for k, h in zip(owner.tolist(), back.tolist())} == want
