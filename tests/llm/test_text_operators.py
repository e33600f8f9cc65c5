"""Operators over texts against brute force, on documents with every odd case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerlight.llm import chunks, decontaminate, eliasfano, graph, ngrams, pii, repeats, similar, suffixes, tokens
from ledgerlight.llm.segments import Seg

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")


def many(frame):
    return Counter(tuple(r) for r in frame.collect())


def words(text):
    return ALNUM.findall((text or "").translate(LOW))


def test_tokens_match_the_patterns():
    texts = ["Aé-b 12_x", "", "ÀB c\x0bD", "x" * 999, "\x00a\x7fb"]
    blob = np.frombuffer("\n".join([*texts, ""]).encode(), np.uint8)
    for table, pattern in ((tokens.ALNUM, ALNUM), (tokens.SOLID, SOLID)):
        w = tokens.Words(blob, np.array([len(t.encode()) for t in texts]), table)
        want = [pattern.findall(t.translate(LOW)) for t in texts]
        assert w.counts.tolist() == [len(x) for x in want]
        flat = [x for y in want for x in y]
        assert [blob[a:z].tobytes().decode().translate(LOW) for a, z in zip(w.starts, w.ends)] == flat
        assert len(set(w.hash.tolist())) == len(set(flat))
    x = np.array([0, 1, 5, 2**63], np.uint64)
    assert (tokens.unmix(tokens.mix(x)) == x).all()


# ---- decontamination


def leaks(rows, items, window=10):
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[k : k + window])].add("null" if i is None else str(i))
    sizes = {len(k) for k in wins}
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[g]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.fixture(scope="module")
def items(spark, rows):
    longer = [t for _, t, *_ in rows if t and len(t.split()) > 40]
    data = [(7, " ".join(longer[0].split()[5:30])), (12, " ".join(longer[1].split()[:12]).upper()), (12, None), (None, " ".join(longer[2].split()[3:15])), (3, "changed"), (5, ""), (6, "?!"), (8, "东京 never seen words"), (7, " ".join(longer[0].split()[5:30]))]
    return data, spark.createDataFrame([(i, t, "x", 1) for i, t in data], "item_id long, text string, doc_id string, seg int")


def test_decontamination(docs, rows, items, empty):
    data, frame = items
    want = leaks([(r[0], r[1]) for r in rows], data)
    assert many(decontaminate.decontaminate(docs, frame)) == want
    blocks = decontaminate.report(decontaminate.find_phrases(decontaminate.build_index(docs), frame, block_bytes=64))
    assert many(blocks) == want
    assert decontaminate.decontaminate(empty, frame).count() == 0
    assert decontaminate.decontaminate(docs, frame.limit(0)).filter("contaminated").count() == 0
    clean = decontaminate.keep_clean(docs, frame)
    assert clean.columns == docs.columns
    assert clean.count() == sum(n for k, n in want.items() if not k[-1])


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x x beta"), (2, "beta alpha"), (3, "alpha x x x x beta"), (4, "alpha"), (5, "beta")], "doc_id long, text string")
    got = decontaminate.find_near(decontaminate.build_index(d), [("q", "beta alpha")], 3)
    assert sorted(r.doc_id for r in got.collect()) == [1, 2]


# ---- suffix arrays


def test_suffix_arrays_and_shared_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(1, 70))).astype(np.uint8)
        b = s.tobytes()
        want = sorted(range(len(b)), key=lambda i: b[i:])
        sa = suffixes.suffix_array(s)
        assert sa.tolist() == want
        shared, phi = suffixes.permuted_lcp(s, sa)
        for a, c in zip(want, want[1:]):
            n = next((k for k in range(len(b)) if max(a, c) + k >= len(b) or b[a + k] != b[c + k]), 0)
            assert (shared[c], phi[c]) == (n, a)


def covered(rows):
    holders = defaultdict(set)
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            holders[b[p : p + 50]].add(math.inf if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if min(holders[b[p : p + 50]]) < (math.inf if i is None else i):
                gone[p : p + 50] = True
        spans = int(np.sum(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return Counter(out)


def test_suffix_dedup(docs, rows, empty):
    assert many(repeats.suffix_dedup(docs).drop("spans")) == covered([(r[0], r[1]) for r in rows])
    assert repeats.suffix_dedup(empty).count() == 0


# ---- language model


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(docs, rows, empty, order):
    texts = [(r[0], [*SOLID.findall((r[1] or "").translate(LOW)), None]) for r in rows]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    grams = [Counter() for _ in range(3)]
    for i, t in texts:
        if not held(i):
            s = ["<s>", *t]
            grams[0].update(t)
            grams[1].update(zip(s, s[1:]))
            grams[2].update(zip(s, s[1:], s[2:]))
    total, types, k = sum(grams[0].values()), len(grams[0]), 500.0
    want = defaultdict(list)
    for i, t in texts:
        s, base, score = ["<s>", *t], 0.0, 0.0
        for n, w in enumerate(t):
            p = (grams[0][w] + 1) / (total + types + 1)
            base += math.log10(p)
            above = grams[0][None] if n == 0 else grams[0][s[n]]
            p = grams[1][s[n], w] / (above + k) + k / (above + k) * p
            if order > 2 and n:
                above = grams[1][s[n - 1], s[n]]
                p = grams[2][s[n - 1], s[n], w] / (above + k) + k / (above + k) * p
            score += math.log10(p)
        want[i].append((len(t), sum(grams[0][w] > 0 for w in t), base, score))
    for r in ngrams.score(docs, order=order).collect():
        assert r.held_out == held(r.doc_id) and r.train_tokens == total
        assert any((r.n_tokens, r.n_known) == w[:2] and abs(r.base_score - w[2]) < 1e-6 and abs(r.score - w[3]) < 2e-4 * r.n_tokens for w in want[r.doc_id])
    assert ngrams.score(empty, order=order).count() == 0


def test_texts_are_tokenised_once(monkeypatch):
    texts = [None, "b a  B c\n", "", "É " * 70000, "a"]
    blob = "".join((t or "") + "\n" for t in texts).encode()
    lens = [None if t is None else len(t.encode()) for t in texts]
    row = {"seg": 3, "ids": [4, 5, 6, None, 8], "lens": lens, "blob": ngrams._tokenised(lens, blob)}
    monkeypatch.setattr(ngrams, "Words", None)
    t = ngrams._Tokens(Seg(row))
    words = [[*SOLID.findall((x or "").translate(LOW)), None] for x in texts]
    assert t.n.tolist() == [len(w) for w in words] and t.first.tolist() == [0, 1, 6, 7, 70008]
    names = {}
    for place, w in zip(t.word.tolist(), sum(words, []), strict=True):
        assert names.setdefault(place, w) == w
    assert len(names) == len(set(names.values())) == len(t.keys()) and names[int(t.end)] is None
    assert t.train.sum() == sum(len(w) for i, w in zip(row["ids"], words, strict=True) if i is not None and zlib.crc32(str(i).encode()) % 7 != 2)
    assert sum(len(ngrams.dec(r["counts"], np.int64)) for r in ngrams._emit_words(Seg(row), 5)) == len(names)


def test_orders_by_packed_numbers():
    rng = np.random.default_rng(9)
    for top in (3, 1000, 1 << 30, 1 << 62):
        keys = [rng.integers(0, max(2, int(top ** (k / 3))), 3000) for k in (3, 2, 1)]
        for some in (keys[:1], keys[:2], keys, [keys[1] * 0, keys[2]]):
            assert (tokens.order_by(*some) == np.lexsort(some[::-1])).all()
    assert len(tokens.order_by(np.zeros(0, np.int64))) == 0 and tokens.order_by(np.array([7])).tolist() == [0]
    h = rng.integers(0, 1 << 63, 5000).astype(np.uint64) >> np.uint64(50)
    for keys in (h, tokens.mix(h)):
        values, counts, place = tokens.uniques(keys)
        want = np.unique(keys, return_counts=True)
        assert (values == want[0]).all() and (counts == want[1]).all() and (values[place] == keys).all()


def test_words_of_a_regular_build_have_hashes_of_their_own():
    one = np.array([bin(i).count("1") & 1 for i in range(4096)], np.uint8) + 97
    blob = np.concatenate([one, [10], 195 - one, [10]]).astype(np.uint8)  # the Thue-Morse word and its complement
    w = tokens.Words(blob, np.array([4096, 4096]), tokens.ALNUM)
    assert len(set(w.hash.tolist())) == 2


def test_trie_level_round_trip():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 1 << 20, (5000, 2)) // np.array([1 << 10, 1]), axis=0).astype(np.uint64)
    log10 = -rng.random(len(pairs)) * 15
    raw = eliasfano.Level.pack(pairs[:, 0], pairs[:, 1], log10)
    level = eliasfano.Level.mapped(raw)
    assert (level.find(pairs[:, 0], pairs[:, 1]) == np.arange(len(pairs))).all()
    assert len(raw) < 10 * len(pairs)
    assert np.abs(-level.lookup(pairs[:, 0], pairs[:, 1]).astype(float) * level.STEP - log10).max() <= level.STEP
    have = set(map(tuple, pairs.tolist()))
    for c, w in rng.integers(0, 1 << 20, (500, 2)).tolist():
        got = level.lookup(np.array([c], np.uint64), np.array([w], np.uint64))[0]
        assert (got != level.NONE) == ((c, w) in have)
    values = np.sort(rng.integers(0, 1 << 40, 300)).astype(np.uint64)
    n, width, low, high = eliasfano.Sequence.parts(values)
    s = eliasfano.Sequence(n, width, low, high)
    asked = np.sort(rng.integers(0, 1 << 41, 500)).astype(np.uint64)
    assert (s.get(np.arange(n)) == values).all() and (s.successor(asked) == np.searchsorted(values, asked)).all()


@pytest.mark.parametrize("size", [0, 1, 2, 700, 20000])
def test_many_queries_of_a_trie_level_scan_its_bits_once(size, monkeypatch):
    rng = np.random.default_rng(size)
    pairs = np.unique(rng.integers(0, 1 << 16, (size, 2)) // np.array([1 << 8, 1]), axis=0).astype(np.uint64)
    level = eliasfano.Level.mapped(eliasfano.Level.pack(pairs[:, 0], pairs[:, 1], -rng.random(len(pairs))))
    asked = np.unique(np.concatenate([pairs, rng.integers(0, 1 << 17, (size, 2)).astype(np.uint64)]), axis=0)
    place = {tuple(x): i for i, x in enumerate(pairs.tolist())}
    want = np.array([place.get(tuple(x), -1) for x in asked.tolist()], int)
    counted, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: counted.append(np.size(x)) or count(x))
    assert (level.find(asked[:, 0], asked[:, 1]) == want).all()
    assert sum(counted) <= 2 * size  # it was 100 words and more for each query
    assert [level.find(*asked[i : i + 1].T)[0] for i in range(0, len(asked), 97)] == want[::97].tolist()


def test_distinct_pairs():
    rng = np.random.default_rng(4)
    for top in (1, 50, 1 << 20, 1 << 30):  # the last ones don't fit one word with their places
        a, b = rng.integers(0, top, (2, 3000))
        a, b = np.append(a, a[:500]), np.append(b, b[:500])
        x, y, place = tokens.distinct(a, b)
        assert list(zip(x.tolist(), y.tolist(), strict=True)) == sorted(set(zip(a.tolist(), b.tolist(), strict=True)))
        assert (x[place] == a).all() and (y[place] == b).all()
    assert all(len(x) == 0 for x in tokens.distinct(a[:0], b[:0]))


# ---- chunks


def test_chunk_dedup(docs, rows, empty):
    first = {}
    cut = {}
    for r in rows:
        b = (r[1] or "").encode()
        ends = chunks.chunk_ends(len(b), [c for c in chunks.cuts(np.frombuffer(b, np.uint8)).tolist() if 16 <= c < len(b)] if b else [])
        cut[id(r)] = [b[a:z] for a, z in zip([0, *ends], ends)]
        assert b"".join(cut[id(r)]) == b and all(len(c) <= chunks.MOST + chunks.LEAST for c in cut[id(r)])
        for c in cut[id(r)]:
            first[c] = min(first.get(c, math.inf), math.inf if r[0] is None else r[0])
    want = Counter((r[0], len((r[1] or "").encode()), len(cut[id(r)]), sum(first[c] < (math.inf if r[0] is None else r[0]) for c in cut[id(r)])) for r in rows)
    got = chunks.chunk_dedup(docs)
    assert many(got.select("doc_id", "n_bytes", "n_chunks", "n_repeats")) == want
    assert all(r.n_removed == sum(z - a for a, z in zip(r.spans[::2], r.spans[1::2])) and 2 * r.n_spans == len(r.spans) for r in got.collect())
    # what is removed, byte by byte: runs of repeated chunks from MIN_RUN bytes on, or of a whole text
    removed = Counter()
    for r in rows:
        b, at, gone = (r[1] or "").encode(), 0, []
        for c in cut[id(r)]:
            if first[c] < (math.inf if r[0] is None else r[0]):
                if gone and gone[-1][1] == at:
                    gone[-1][1] += len(c)
                else:
                    gone.append([at, at + len(c)])
            at += len(c)
        gone = [x for x in gone if x[1] - x[0] >= chunks.MIN_RUN or x[1] - x[0] == len(b)]
        kept = b"".join(b[z:a] for (_, z), (a, _) in zip([[0, 0], *gone], [*gone, [len(b), 0]]))
        removed[r[0], sum(z - a for a, z in gone), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    assert many(got.select("doc_id", "n_removed", "n_spans", "kept_sha256")) == removed
    copies = [r for r in got.collect() if r.doc_id is not None and r.n_bytes and r.n_removed == r.n_bytes]
    assert copies  # whole copies go entirely
    assert chunks.chunk_dedup(empty).count() == 0


def test_chunks_resist_shifts(spark):
    rng = np.random.default_rng(2)
    body = bytes(rng.integers(97, 123, 4000).astype(np.uint8)).decode()
    d = spark.createDataFrame([(1, body), (2, "some words in front " + body[:2000] + " inserted " + body[2000:])], "doc_id long, text string")
    got = {r.doc_id: r for r in chunks.chunk_dedup(d).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed > 3500


def test_words_without_end_are_chunked_alike_at_any_phase(spark):
    rng = random.Random(3)
    words = ["charges apply ", *("".join(rng.choices("abcdefghij klmnop", k=rng.randrange(8, 40))) for _ in range(200))]
    uncut = [w for w in words if not _zeros((w * 20).encode())][:4]
    assert len(uncut) == 4
    for w in uncut:
        long = w * 200
        d = spark.createDataFrame([(1, long[:3000]), (2, "ZZ" + long[1:1500]), (3, "other words in front " + long[len(w) // 2 :][:1200])], "doc_id long, text string")
        got = {r.doc_id: r for r in chunks.chunk_dedup(d).collect()}
        assert got[1].n_removed == 0
        assert all(got[k].n_removed > 0.75 * got[k].n_bytes for k in (2, 3)), w


def _zeros(b):
    h = chunks._GEAR[np.frombuffer(b, np.uint8)]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint16(k)
    return (h[15:] >> np.uint16(16 - chunks.BITS) == 0).any()


def test_cuts_of_a_text_do_not_depend_on_its_neighbours():
    texts = [b"abc" * 100, b"x" * 70, b"the rate is fixed. " * 30, b"", b"y" * 200]
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    at = chunks.cuts(np.frombuffer(b"".join(texts), np.uint8), starts)
    for a, t in zip(starts.tolist(), texts):
        if t:
            assert [c - a for c in at.tolist() if a + 16 <= c < a + len(t)] == [c for c in chunks.cuts(np.frombuffer(t, np.uint8)).tolist() if 16 <= c < len(t)]


# ---- similar documents


def similar_brute(rows):
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    n, parent, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[top(b)] = top(a)
    least = defaultdict(lambda: math.inf)
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[top(k)] = min(least[top(k)], r[0])
    return Counter((r[0], r[0] if not sets[k] else None if least[top(k)] == math.inf else least[top(k)], links[k]) for k, r in enumerate(rows))


def test_similar(docs, rows, empty, monkeypatch):
    want = similar_brute(rows)
    assert many(similar.classes(docs)) == want
    monkeypatch.setattr(similar, "BLOCK", 2)  # components in several blocks
    assert many(similar.classes(docs)) == want
    assert similar.classes(empty).count() == 0
    kept = similar.keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    again = similar_brute([(r.doc_id, r.text) for r in got])
    assert all(k[2] == 0 for k in again)  # nothing near is left
    assert {r[1] for r in rows if not words(r[1])} <= {r.text for r in got}


def test_prefix_depth_reaches_the_recall():
    d = similar.depth_for(0.8)
    assert 1 - (1 - 0.8**d) ** similar.TREES >= similar.RECALL
    assert 1 - (1 - 0.8 ** (d + 1)) ** similar.TREES < similar.RECALL


def test_components(spark):
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(0, 40) if i % 10 != 9] + [("100", "050")]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "node string, root string")).collect()}
    assert all(got[f"{i:03}"] == f"{i // 10 * 10:03}" for i in range(40)) and got["100"] == "050"


# ---- personal data


def base_brute(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_personal_data(spark, empty):
    rng = np.random.default_rng(3)
    pieces = ["a.b@c.d", "x@y", "@z.com", "p@q.r.s@t.u", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+12", "++1 234 567 890 1", "é", " ", "-", "..", "12345678901234567890123", "0004.3.2.1", "call (555) 123-4567 now", "bob (at) foo dot com"]
    texts = ["".join(rng.choice(pieces) + (" " if rng.random() < 0.4 else "") for _ in range(rng.integers(1, 9))) for _ in range(300)] + [None, "", "1" * 20000, "+1 " * 5000, "a@" * 3000]
    d = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    for r in pii.find(d).collect():
        t = texts[r.doc_id] or ""
        base = base_brute(t) if len(t) < 1000 else None
        if base is not None:
            assert r.base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest(), t
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
            assert {f"{k}:{a}:{z}" for k, a, z in base} <= set(r.spans.split(",")) or not base
    assert pii.find(empty).count() == 0


def test_overlaps_by_bisection():
    rng = np.random.default_rng(4)
    for _ in range(200):
        base = sorted((int(a), int(a + n)) for a, n in zip(rng.integers(0, 200, 12), rng.integers(1, 20, 12)))
        taken = pii.Taken()
        for a, z in base:
            taken.add(a, z)
        for a, n in zip(rng.integers(0, 220, 50).tolist(), rng.integers(1, 15, 50).tolist()):
            assert taken.free(a, a + n) == (not any(a < e and s < a + n for s, e in base))


def test_time_grows_with_the_text_alone():
    import time

    text = "call (555) 123-4567 or a.b@c.org, " * 3000
    took = []
    for k in (1, 4):
        began = time.thread_time()
        pii.model().spans(text * k)
        took.append(time.thread_time() - began)
    assert took[1] < 10 * took[0]


def test_added_spans_and_redaction(spark):
    yes = ["call me at (555) 123-4567 please", "write bob (at) foo dot com now", "card 4111.1111.1111.1111 ok"]
    no = ["order 123-45-678 and 2020-01-02 12", "the cat sat at home. dot", "version 10.20.30 of 1999"]
    d = spark.createDataFrame([(k, t, len(t)) for k, t in enumerate([*yes, *no])] + [(9, None, 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in pii.redact(d).collect()}
    assert [got[k].text for k in range(3)] == ["call me at [PHONE] please", "write [EMAIL] now", "card [CARD] ok"]
    assert [got[k + 3].text for k in range(3)] == no and got[9].text is None
    assert all(got[k].n_chars == len(got[k].text) for k in range(6))


def test_released_tables_are_gone(spark, docs):
    import glob

    from ledgerlight.llm import store

    base = store.shared_dir(spark).removeprefix("file://")
    assert chunks.chunk_dedup(docs).count() and glob.glob(f"{base}/segments_*")
    store.release(spark)
    assert not glob.glob(f"{base}/segments_*") and not [t for t in spark.catalog.listTables() if t.name.startswith("segments_")]
