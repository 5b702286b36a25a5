"""Operators on small and odd inputs, against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from facetspark.llm import bpe, chat, classifier, components, decontamination, huffman, lines, minhash, rules, sharding, suffix
from facetspark.llm.common import words_of
from facetspark.llm.queries import bpe_ranks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("node", "component", "score", "kept", "blk", "bucket", "a", "b", "shard", "slot", "n", "ids", "quality", "size", "first")


def documents(spark, rows, clash=True):
    """``rows`` of (doc_id, text) with more columns, some of which have the names of inner ones."""
    df = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHING}) if clash else df


WORDS = "amber brook cedar delta ember frost grove heron inlet jetty kelp larch maple notch otter pine quill ridge sedge thorn".split()


def sentence(draw, n):
    return " ".join(draw.choice(WORDS) + draw.choice(WORDS) for _ in range(n))


def odd_rows():
    draw = random.Random(3)
    base = sentence(draw, 60)
    changed = base.replace(base.split()[30], "otherword")
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, base), (5, base), (6, changed), (6, changed), (None, base), (None, None),
        (7, "\n".join([base, sentence(draw, 12), base])), (8, "é" * 40 + " ünï çode " + base), (9, "x"), (10, "a b c d"), (11, "A B c D"),
        (12, " ".join(sentence(draw, 400) for _ in range(20))), (13, "w" * 5000), (14, "\x1c odd \u00a0 space  twice\n\n\nlines "),
        (15, changed + "\n" + sentence(draw, 30)),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, odd_rows())


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


# --- decontamination ------------------------------------------------------------

def edit_distance_inside(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        above = row
        row = [0]
        for k, d in enumerate(item, 1):
            row.append(min(above[k] + 1, row[-1] + 1, above[k - 1] + (c != d)))
        best = min(best, row[-1])
    return best


def test_myers_agrees_with_the_plain_recurrence():
    draw = random.Random(1)
    for _ in range(200):
        item = "".join(draw.choice("abc") for _ in range(draw.randint(1, 90)))
        text = "".join(draw.choice("abc") for _ in range(draw.randint(0, 60)))
        want = edit_distance_inside(item, text)
        assert min(len(item), decontamination.Pattern(item).search(text, len(item))[0]) == want


def test_items_are_found_up_to_their_budget_and_not_beyond(spark):
    draw = random.Random(2)
    items = [(k, sentence(draw, 12)) for k in range(4)] + [(4, None), (5, " ... "), (6, "short")]
    rows, want = [(50, None), (51, "")], set()
    for k, item in items[:4]:
        text = decontamination.normalised(item)
        for errors in (0, 1, decontamination.budget(len(text)), decontamination.budget(len(text)) + 6):
            spots = sorted(draw.sample(range(0, len(text), 2), errors))
            broken = "".join("7" if i in spots else c for i, c in enumerate(text))
            doc = len(rows) + 100
            rows.append((doc, sentence(draw, 30).upper() + " - " + broken.replace(" ", "\n ", 2) + " " + sentence(draw, 20)))
            for other, candidate in items[:4]:
                c = decontamination.normalised(candidate)
                distance = edit_distance_inside(c, decontamination.normalised(rows[-1][1]))
                if distance <= decontamination.budget(len(c)):
                    want.add((doc, other, distance))
    docs = documents(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = {tuple(r)[:3] for r in decontamination.find_contamination(docs, bench).collect()}
    assert got == want and len(want) >= 12
    clean = docs.where(~decontamination.is_contaminated(F.col("text"), bench))
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _, _ in want}


def test_items_begin_and_end_where_words_do(spark):
    items = [(1, "art"), (2, "a"), (3, "No!"), (4, "the birthday of a queen"), (5, "Art")]
    rows = [(1, "a birthday party"), (2, "the cat"), (3, "nothing here"), (4, "ART"), (5, "no, a part"), (6, "state of the-art"), (7, "xthe birthday of a queen")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {tuple(r) for r in decontamination.find_contamination(documents(spark, rows), bench).collect()}
    assert found == {
        (1, 2, 0, 1), (4, 1, 0, 3), (4, 5, 0, 3), (5, 3, 0, 2), (5, 2, 0, 4), (6, 1, 0, 16), (6, 5, 0, 16), (7, 2, 0, 18), (7, 4, 1, 24),
    }
    assert {r.doc_id for r in documents(spark, rows).where(~decontamination.is_contaminated(F.col("text"), bench)).collect()} == {2, 3}


def test_decontamination_of_odd_and_empty_tables(spark, odd, empty):
    bench = spark.createDataFrame([(1, odd_rows()[3][1])], "item_id long, text string")
    got = Counter(r.doc_id for r in decontamination.find_contamination(odd, bench).collect())
    assert got == Counter({4: 1, 5: 1, 6: 2, None: 1, 7: 1, 8: 1, 15: 1})
    assert decontamination.find_contamination(empty, bench).count() == 0
    assert decontamination.find_contamination(odd, bench.limit(0)).count() == 0


# --- classifier -----------------------------------------------------------------

def test_isotonic_fit_is_monotone_and_pools():
    rates = classifier.isotonic(np.array([4, 0, 4, 4, 0, 2]), np.array([1, 0, 3, 1, 0, 2.0]))
    assert (np.diff(rates) >= 0).all() and rates[2] == rates[3] == 0.5 and rates[5] == 1


def test_classifier_of_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 16)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = classifier.score_quality(odd, labels).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    assert {r.score for r in classifier.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert classifier.score_quality(empty, labels).count() == 0


def test_labels_of_held_out_rows_do_not_matter(spark, odd):
    held = [k for k in range(1, 16) if zlib.crc32(str(k).encode()) % 5 == 0]
    rows = [(k, int(k > 7)) for k in range(1, 16)]
    other = [(k, 1 - q if k in held else q) for k, q in rows]
    a, b = (spark.createDataFrame(x, "doc_id long, quality int") for x in (rows, other))
    scores = [sorted((str(r.doc_id), r.score) for r in classifier.score_quality(odd, x).collect()) for x in (a, b)]
    assert held and scores[0] == scores[1]


# --- chats ----------------------------------------------------------------------

def test_parts_are_flattened_in_order_and_read_back(spark):
    parts = [
        ("text", "look <image:1> \\ at", None, None), ("image", None, "s3://x/<1>.png", 2), ("audio", None, "a\\b", 3),
        ("video", "a <clip>", "v.mp4", 1), None, (None, "lost", None, None), ("image", None, None, 1), ("image", None, "", 1), ("document", None, "d.pdf", None), ("text", None, None, None), ("text", "</turn>\n<turn:user>", None, None),
    ]
    rows = [(1, 0, "user", parts, "x"), (1, 1, "assistant", [("text", "fine", None, None), ("image", None, "i", 1), ("text", "!", None, None)], "x"),
            (2, None, None, None, "x"), (None, 1, "user", [], "x")]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS_TYPE}, formatted string")
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    one = got[1]
    assert chat.parse_chat(one.formatted) == [
        ("user", [("text", "look <image:1> \\ at"), ("image", "s3://x/<1>.png"), ("audio", "a\\b"), ("other", '{"type":"video","text":"a <clip>","ref":"v.mp4","units":1}'), ("other", '{"text":"lost"}'),
                  ("image", None), ("image", ""), ("document", "d.pdf"), ("text", "</turn>\n<turn:user>")]),
        ("assistant", [("text", "fine"), ("image", "i"), ("text", "!")]),
    ]
    assert [(f.type, f.ref, f.tokens) for f in one.attachments] == [
        ("image", "s3://x/<1>.png", 512), ("audio", "a\\b", 75), ("video", "v.mp4", 0), ("image", None, 256), ("image", "", 256),
        ("document", "d.pdf", 512), ("image", "i", 256)]
    assert one.expanded_tokens == 1867
    assert "".join(one.formatted[a:b] for a, b in chat.loss_spans(one.formatted)) == "fine!"
    assert chat.parse_chat(got[2].formatted) == [("", [])] and chat.parse_chat(got[None].formatted) == [("user", [])]
    assert chat.chat_digests(chat.format_chats(df.limit(0))).count() == 0


def test_texts_of_any_kind_survive_the_template(spark):
    draw = random.Random(5)
    texts = ["".join(draw.choice("\\<>/turn:# \n\x00é😀") for _ in range(draw.randint(0, 60))) for _ in range(300)] + [None, "x" * 200_000 + "</turn>\n"]
    rows = [(k % 40, k, draw.choice(["user", "assistant", "sys>tem"]), t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(F.col("text")))
    for r in chat.chat_digests(chat.format_chats(df)).collect():
        own = [(role, t or "") for c, _, role, t in rows if c == r.conv_id]
        loss = "".join(t for role, t in own if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


# --- rules ----------------------------------------------------------------------

def plain_counts(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_counts_agree_with_plain_ones():
    draw = random.Random(7)
    texts = ["".join(draw.choice("ab \n\t#|é\u00a0") for _ in range(draw.randint(0, 120))) for _ in range(400)] + [t for _, t in odd_rows()]
    for t in texts:
        assert rules.text_counts(t) == plain_counts(t)


def test_ratios_and_verdicts(spark, odd, empty):
    trusted = spark.createDataFrame([(4,), (4,), (12,), (None,)], "doc_id long")
    ratios = rules.fit_ratios(odd, trusted)
    corpus, target = Counter(), Counter()
    for i, t in odd_rows():
        found = rules.ngram_buckets((t or "").encode()).tolist()
        corpus.update(found)
        if i in (4, 12):
            target.update(found)
    p = np.array([target[k] for k in range(rules.BUCKETS)]) + 1.0
    q = np.array([corpus[k] for k in range(rules.BUCKETS)]) + 1.0
    assert (ratios == np.rint(np.log(p / p.sum() / (q / q.sum())) * rules.UNIT)).all()
    for r in rules.score_rules(odd, ratios).collect():
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
        assert r.kept == (not r.base_failed and r.score >= rules.THRESHOLD)
    assert rules.filter_by_rules(empty, trusted).count() == 0
    assert not rules.fit_ratios(odd, trusted.limit(0)).any()


def test_all_trusted_ids_count(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    assert not rules.fit_ratios(docs, docs.select("doc_id")).any()  # the trusted texts are the corpus


# --- near-duplicates ------------------------------------------------------------

def plain_components(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 75 * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def near(df):
    rows = minhash.near_duplicates(df).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows)


def test_components_of_odd_and_empty_tables(spark, odd, empty):
    assert near(odd) == plain_components(odd_rows())
    assert near(empty) == Counter()


def test_chains_and_groups_are_linked_through_any_member(spark):
    """Texts drift step by step, so that neighbours are similar and the ends are not; beside them a group of copies."""
    draw = random.Random(11)
    rows, words = [], sentence(draw, 120).split()
    for k in range(60):
        rows.append((draw.randrange(10**6), " ".join(words)))
        at = draw.randrange(len(words))
        words[at:at + 2] = sentence(draw, 2).split()
    copy = sentence(draw, 80).split()
    for k in range(80):
        own = list(copy)
        for _ in range(draw.randint(0, 4)):
            own[draw.randrange(len(own))] = sentence(draw, 1)
        rows.append((draw.randrange(10**6), " ".join(own)))
    assert near(documents(spark, rows)) == plain_components(rows)


def near_copies():
    draw = random.Random(23)
    copy = sentence(draw, 60).split()
    rows = []
    for k in range(30):
        own = list(copy)
        for _ in range(draw.randint(0, 3)):
            own[draw.randrange(len(own))] = sentence(draw, 1)
        rows.append((k, " ".join(own)))
    return rows


def test_confirming_sends_four_bytes_an_element(spark, monkeypatch):
    sent, plain = [], minhash.with_both

    def looked_at(pairs, facts):
        if "shingles" in facts.columns:
            sent.append(max(r[0] for r in facts.select(F.octet_length("shingles")).collect()))
        return plain(pairs, facts)

    monkeypatch.setattr(minhash, "with_both", looked_at)
    rows = near_copies()
    assert near(documents(spark, rows)) == plain_components(rows)
    assert sent[0] == 4 * 56


def test_only_nodes_with_likely_partners_are_sent_in_full():
    draw = np.random.default_rng(4)
    base = draw.integers(0, 2**63, 200, dtype=np.uint64)
    sets = [base, base[4:], draw.integers(0, 2**63, 200, dtype=np.uint64)]
    signs = minhash.signatures(sets)
    values = minhash.bucket_values(signs).view(np.int64)
    bucket = int(values[0][np.flatnonzero(values[0] == values[1])[0]])
    side = ([b"a", b"b", b"c"], [b"a", b"b", b"c"], [x.tobytes() for x in signs], [len(x) for x in sets])
    found = set(minhash._likely_nodes([(bucket, *(x[:2] for x in side), *side)]))
    assert {(bucket, b"a"), (bucket, b"b")} <= found and (bucket, b"c") not in found
    one = (side[0][:2], [b"a", b"a"], side[2][:2], side[3][:2])  # one component
    assert not list(minhash._likely_nodes([(bucket, *one, *one)]))


def test_pairs_left_open_by_low_bits_are_decided_in_full(spark, monkeypatch):
    a = np.arange(1, 101, dtype=np.uint64) << np.uint64(32)
    low = lambda x: np.frombuffer(minhash.low_bits(x), "<u4")
    assert minhash.similar_on_low_bits(low(a), low(a), 75) is True
    assert minhash.similar_on_low_bits(low(a[:86]), low(a[14:]), 75) is False
    assert minhash.similar_on_low_bits(low(a), low(a[25:]), 75) is None
    monkeypatch.setattr(minhash, "similar_on_low_bits", lambda *_: None)
    rows = near_copies()
    assert near(documents(spark, rows)) == plain_components(rows)


def test_contraction_finds_components(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5000, 5000), (6000, 6001), (6001, 6000)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.component, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [list(range(301)), list(range(1000, 1200)), [6000, 6001]]
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- repeated passages ----------------------------------------------------------

def plain_repeats(rows, length=suffix.LENGTH):
    least = {}
    for i, t in rows:
        data = (t or "").encode()
        for k in range(len(data) - length + 1):
            w = data[k:k + length]
            if i is not None:
                least[w] = min(i, least.get(w, i))
    out = Counter()
    for i, t in rows:
        data = (t or "").encode()
        mask = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            if i is not None and least[data[k:k + length]] < i:
                mask[k:k + length] = True
        spans = int((np.diff(np.append(0, mask.astype(int))) == 1).sum())
        kept = bytes(b for b, m in zip(data, mask) if not m)
        out[i, len(data), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def repeats(df, **options):
    return Counter(map(tuple, suffix.remove_repeats(df, **options).collect()))


def test_repeats_of_odd_and_empty_tables(spark, odd, empty):
    assert repeats(odd) == plain_repeats(odd_rows())
    assert repeats(empty) == Counter()


def test_repeats_of_texts_made_of_few_passages(spark):
    draw = random.Random(13)
    pool = ["".join(draw.choice(letters) for _ in range(draw.randint(30, 140))) for letters in ("ab", "abcdefgh ", "aé", "xyz") for _ in range(6)]
    pool += ["a" * 70, "ab" * 60, "z" * 49, "z" * 50]
    rows = [(k, "".join(draw.choice(pool) + draw.choice(["", "-", "é"]) for _ in range(draw.randint(0, 7)))) for k in range(150)]
    draw.shuffle(rows)
    assert repeats(documents(spark, rows), block_bytes=2000) == plain_repeats(rows)


def test_suffix_sort_sorts_and_survives_equal_hashes(monkeypatch):
    draw = np.random.default_rng(1)
    data = draw.integers(97, 99, 3000).astype(np.uint8)
    s = suffix.Suffixes(data)
    at = draw.permutation(2900)
    segments = np.sort(draw.integers(0, 40, 2900))
    order = s.sort(at, segments)
    raw = data.tobytes()
    for k in range(40):
        own = [raw[a:a + suffix.LENGTH] for a in at[order][segments == k]]
        assert own == sorted(own) and sorted(at[order][segments == k]) == sorted(at[segments == k])
    texts = [bytes(draw.integers(97, 123, 60).astype(np.uint8)) for _ in range(30)] + [b"q" * 60] * 2
    args = (np.zeros(32, np.uint64), np.full(32, 5), np.arange(32)[::-1].copy())
    want = suffix.least_documents(texts, *args)
    monkeypatch.setattr(suffix.Suffixes, "equal", lambda self, a, b, size: np.ones(len(a), bool))
    assert all((x == y).all() for x, y in zip(suffix.least_documents(texts, *args), want))


# --- token ids ------------------------------------------------------------------

def test_code_lengths_are_optimal_and_limited():
    import heapq

    draw = np.random.default_rng(4)
    for n, most in ((1, 18), (2, 18), (300, 18), (300, 9), (8, 3)):
        counts = draw.geometric(0.01, n) ** 2
        lengths = huffman.code_lengths(counts, most)
        assert lengths.max() <= most and (n == 1 or (0.5 ** lengths).sum() == 1)
        heap = list(map(int, counts))
        heapq.heapify(heap)
        total = 0
        while len(heap) > 1:
            heapq.heappush(heap, both := heapq.heappop(heap) + heapq.heappop(heap))
            total += both
        if most == 18 and n > 1 and lengths.max() < 18:
            assert (counts * lengths).sum() == total


def test_blocks_decode_independently():
    draw = np.random.default_rng(5)
    ids = draw.geometric(0.02, 5000) - 1
    lengths = huffman.code_lengths(np.bincount(ids))
    bits, checkpoints = huffman.pack(ids, lengths, huffman.canonical_codes(lengths))
    table = huffman.decode_table(lengths)
    assert (huffman.unpack(bits, checkpoints, len(ids), table) == ids).all()
    assert (huffman.unpack(bits, checkpoints[3:5], 2 * huffman.BLOCK, table) == ids[3 * huffman.BLOCK:5 * huffman.BLOCK]).all()
    assert not len(huffman.unpack(b"", np.zeros(0), 0, table))


def test_files_hold_what_the_library_encodes(spark, odd, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = sorted(huffman.binary_output(odd, path, public_tokenizers.PATTERN).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in odd_rows()), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    want = Counter()
    for i, t in odd_rows():
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    assert huffman.binary_output(empty, path, public_tokenizers.PATTERN).count() == 0


# --- lines ----------------------------------------------------------------------

def plain_lines(rows):
    found = []
    for row, (i, t) in enumerate(rows):
        for k, line in enumerate((t or "").split("\n")):
            words = frozenset(line.encode().split())
            if words:
                found.append((row, i, (2**63 - 1 if i is None else i, k), words))
    first = {}
    for _, _, place, words in found:
        first[words] = min(place, first.get(words, place))
    sets = list(first)
    links = {w: [v for v in sets if v != w and 100 * len(v & w) >= 80 * len(v | w)] for w in sets}
    out = {i: [0, 0, 0, []] for i, _ in rows}
    for _, i, place, words in found:
        own = out[i]
        own[0] += 1
        own[2] += len(links[words])
        if min([first[words], *(first[v] for v in links[words])]) < place:
            own[1] += 1
            own[3].append(place[1])
    return {(i, a, b, c, ",".join(map(str, sorted(d)))) for i, (a, b, c, d) in out.items()}


def line_rows(draw):
    pool = [sentence(draw, draw.randint(1, 14)) for _ in range(25)]

    def varied(line):
        words = line.split()
        for _ in range(draw.randint(0, 2)):
            words[draw.randrange(len(words))] = draw.choice(WORDS)
        draw.shuffle(words)
        return " ".join(words)

    return [(k, "\n".join(varied(draw.choice(pool)) for _ in range(draw.randint(0, 6)))) for k in range(120)]


def test_lines_agree_with_all_pairs(spark, odd, empty, monkeypatch):
    rows = line_rows(random.Random(17))
    assert set(map(tuple, lines.line_report(documents(spark, rows)).collect())) == plain_lines(rows)
    assert set(map(tuple, lines.line_report(odd).collect())) == plain_lines(odd_rows())
    assert lines.line_report(empty).count() == 0
    monkeypatch.setattr(lines, "HOT_LINES", 3)  # every word is dealt to a grid
    monkeypatch.setattr(lines, "GROUP_BYTES", 100)  # and every group to cells
    assert set(map(tuple, lines.line_report(documents(spark, rows)).collect())) == plain_lines(rows)


def test_groups_of_line_sets_hold_all_similar_pairs():
    draw = random.Random(23)
    rows = line_rows(draw)
    sets = lines.LineSets(pa.array([t for _, t in rows]))
    counts = np.bincount(lines.counter_of(sets.word), minlength=lines.COUNTERS)
    digest, _ = sets.digests()
    shared = {}
    for node, hub in lines.candidate_groups(lines.postings(sets, counts, sets.size > 0, digest)).tolist():
        shared.setdefault(node, set()).add(hub)
    members = {}
    for line, code in zip(sets.line.tolist(), sets.code.tolist()):
        members.setdefault(int(digest[line:line + 1].view(np.int64)[0]), set()).add(code)
    nodes = sorted(members)
    similar = [(a, b) for a in nodes for b in nodes if a < b and 100 * len(members[a] & members[b]) >= 80 * len(members[a] | members[b])]
    assert similar and all(shared[a] & shared[b] for a, b in similar)


def test_word_hashes_tell_words_apart():
    words = ["", "a", "b", "ab", "ba", "aa", "aaa", "\u00e9", "e", "x" * 5000, "x" * 4999]
    hashes = lines.word_hashes(pa.array(words))
    assert len(set(hashes.tolist())) == len(words)
    assert lines.word_hashes(pa.array(words[3:])).tolist() == hashes[3:].tolist()
    assert lines.word_hashes(pa.array(words).slice(3)).tolist() == hashes[3:].tolist()
    assert len(lines.word_hashes(pa.array([], pa.string()))) == 0


def test_lines_are_cut_from_texts(spark):
    rows = [(1, "one two three\nfour"), (2, "four\nfive six\n\nthree two one"), (3, None), (4, "")]
    got = {r.doc_id: r.text for r in lines.drop_lines(documents(spark, rows)).collect()}
    assert got == {1: "one two three\nfour", 2: "five six\n", 3: None, 4: ""}


def plain_cuts(rows):
    """The text of every row without the lines that match one at an earlier place."""
    found = []
    for row, (i, t) in enumerate(rows):
        for k, line in enumerate((t or "").split("\n")):
            if words := frozenset(line.encode().split()):
                found.append((row, (2**63 - 1 if i is None else i, k), words))
    gone = {
        (row, place[1]) for row, place, words in found
        if any(p < place and 100 * len(words & v) >= 80 * len(words | v) for _, p, v in found)
    }
    return Counter(
        (i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (row, k) not in gone))
        for row, (i, t) in enumerate(rows)
    )


def test_rows_with_one_id_or_none_lose_their_own_lines_only(spark, odd):
    cuts = lambda df: Counter((r.doc_id, r.text) for r in lines.drop_lines(df).collect())
    rows = [(None, "a b c d e\nunique one two"), (None, "zzz\na b c d e"), (None, "zzz\na b c d e"), (7, "p q\nr s"), (7, "t\np q")]
    assert cuts(documents(spark, rows)) == plain_cuts(rows)
    assert cuts(documents(spark, rows))[None, "a b c d e\nunique one two"] == 1
    assert cuts(odd) == plain_cuts(odd_rows())
    some = [(None if k % 3 == 0 else i // 2, t) for k, (i, t) in enumerate(line_rows(random.Random(19)))]
    assert cuts(documents(spark, some)) == plain_cuts(some)


def test_lines_asked_for_leave_their_texts_before_the_shuffle(spark):
    rows = [(1, "a b\nc d e c"), (1, "x\ny z"), (None, "p q\n\nr s"), (2, "k\n" * 500)]
    docs = documents(spark, rows, clash=False)
    asked = {(1, "c d e c"), (1, "x"), (None, "r s")}
    digest = lambda line: [int(d.view(np.int64)[0]) for d in lines.LineSets(pa.array([line])).digests()]
    split = docs.select("doc_id", lines.text_hash().alias("h"), F.posexplode(F.split("text", "\n", -1)).alias("k", "line")).collect()
    classes = [(digest(r.line)[0], r.doc_id, r.h, r.k, digest(r.line)[1]) for r in split if (r.doc_id, r.line) in asked]
    wanted = spark.createDataFrame(classes, "node long, doc_id long, text_hash long, line_no int, digest long")
    found = lines.line_words(docs, wanted)
    got = {(r.doc, r.line, r.n_bytes, frozenset(r.words.split())) for r in found.collect()}
    assert got == {(1, 1, 5, frozenset("cde")), (1, 0, 1, frozenset("x")), (2**63 - 1, 2, 3, frozenset("rs"))}
    assert "posexplode" in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_row_of_residues_tells_keys_apart(spark, monkeypatch):
    monkeypatch.setattr(minhash, "RESIDUES", 16)
    some = spark.range(16).toDF("key")
    left = minhash.perhaps_in(spark.range(20_000).toDF("key"), "key", some)
    kept = {r.key for r in left.collect()}
    assert left.columns == ["key"] and set(range(16)) <= kept and len(kept) < 1_000
    assert minhash.perhaps_in(some, "key", some.limit(0)).count() == 0


# --- shards ---------------------------------------------------------------------

def test_shards(spark, odd, empty):
    rows = sharding.shard_documents(odd).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in odd_rows())
    for shard in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))
    assert all(r.grown_shard in (r.shard, 16) and r.law == "key" for r in rows)
    assert len({r.shard for r in rows if r.doc_id == 6}) == 1
    assert sharding.shard_documents(empty).count() == 0


def test_a_changed_weight_moves_rows_only_in_its_subtree(spark):
    ids = spark.range(20_000).withColumn("text", F.lit("x"))
    tree = sharding.topology(16)
    place = lambda leaves: {r.id: r.s for r in ids.select("id", sharding.assign(F.col("id"), leaves).alias("s")).collect()}
    before = place(tree)
    counts = Counter(before.values())
    assert set(counts) == set(range(16)) and min(counts.values()) > 1000
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 2.0 if x.shard == 5 else 1.0) for x in tree]
    after = place(heavier)
    moved = {(before[i], after[i]) for i in before if before[i] != after[i]}
    region = {x.shard: x.region for x in tree}
    assert moved and all(region[b] == region[5] for _, b in moved)
    within = Counter(after.values())
    assert within[5] > 1.6 * within[6]


# --- byte-level BPE -------------------------------------------------------------

def test_ids_and_texts_of_odd_tables(spark, odd, empty):
    import tiktoken

    ranks = bpe_ranks()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [r for r in odd_rows() if r[0] != 13] + [(13, "w" * 300), (16, "it's <|endoftext|> DON'T 12 34,5 ... \r\n\t日本語 😀")]
    want = Counter()
    for i, t in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        want[i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    df = documents(spark, rows)
    assert Counter(map(tuple, bpe.round_trip(df, ranks, public_tokenizers.PATTERN).collect())) == want
    back = bpe.decode_documents(bpe.encode_documents(df, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t or "") for i, t in rows)
    assert bpe.round_trip(empty, ranks, public_tokenizers.PATTERN).count() == 0


def test_a_document_of_millions_of_ids_is_decoded():
    own = bpe.PartitionBpe(bpe_ranks(), public_tokenizers.PATTERN)
    ids = own.encode_chunks([" some", " words", " 12"])
    text = b"".join(own.decode(ids))
    assert text == b" some words 12"
    times = 12_000_000 // (len(b"".join(ids)) // 4) + 1
    assert own.decode([ids[0], b"".join(ids) * times, b"", ids[1]]) == [b" some", text * times, b"", b" words"]


def test_a_long_word_is_one_pretoken():
    import tiktoken

    ranks = bpe_ranks()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    word = dict((i, t) for i, t in odd_rows() if i)[13]
    got = bpe.PartitionBpe(ranks, public_tokenizers.PATTERN).encode_chunks([word])[0]
    assert len(word) == 5000 and np.frombuffer(got, "<u4").tolist() == library.encode_ordinary(word)


def test_words_are_runs_of_anything_but_ascii_space():
    assert words_of("a\u00a0b\x1c c\x0b\x0cd\u2003".encode()) == ["a\u00a0b\x1c".encode(), b"c", "d\u2003".encode()]


def peak_mb(fn):
    import tracemalloc

    tracemalloc.start()
    fn()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def test_verified_lines_take_little_memory():
    rng = random.Random(5)
    texts = [" ".join(rng.sample([f"w{k}" for k in range(400)], 10)) for _ in range(1500)]
    zero = np.zeros(len(texts), np.int32)
    table = pa.table({
        "hub": pa.array(zero.astype("i8")), "part": zero, "low": zero, "high": zero, "hubs": [[0]] * len(texts),
        "node": np.arange(len(texts)), "doc": np.arange(len(texts)), "line": zero, "words": texts,
    })
    lines.verified(table)
    assert peak_mb(lambda: lines.verified(table)) < 60


def test_shingler_remembers_few_words():
    texts = [" ".join(f"word{k}" for k in range(a, a + 1000)) for a in range(0, 200_000, 1000)]
    shingler = minhash.Shingler()

    def run():
        for text in texts:
            assert len(shingler.hashes(text)) == 996

    assert peak_mb(run) < 15
    assert (shingler.hashes(texts[0]) == minhash.Shingler().hashes(texts[0])).all()
