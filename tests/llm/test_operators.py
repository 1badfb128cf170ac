"""Each operator against brute force on a small table with every awkward case, and on an empty one."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from fixtures import documents, frame, prose

import corpus_pipeline
from bitloom.llm import common, imatch, langid, lattice_lm, line_spread, mixing, near_copies, quality_crf, registry, sentence_spans, simhash_cover, suffix_dedup, suffix_sort, tiling


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def test_every_query_is_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(registry.QUERIES) | {"pipeline"} <= names
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 11))


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())


def test_words():
    for _, t, *_ in documents():
        assert common.words_of(t) == words(t)
    assert common.words_of("A Ä\x0bb\x1fc") == ["a Ä".encode(), b"b\x1fc"]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3)]
    got = {x.node: x.root for x in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    touched = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in touched}


# 1
def test_crf_marginals_are_those_of_all_labelings():
    r = np.random.default_rng(1)
    emit, change = r.normal(size=(3, 5)), r.normal(size=(2, 2))
    size = np.array([5, 3, 1])
    p, pairs, z = quality_crf.marginals(emit, size, change)
    total = np.zeros((2, 2))
    for d in range(3):
        n, weights, good, moves = size[d], [], np.zeros(5), np.zeros((2, 2))
        for k in range(2**n):
            y = [k >> t & 1 for t in range(n)]
            w = np.exp(sum(emit[d, t] * y[t] for t in range(n)) + sum(change[a, b] for a, b in zip(y, y[1:])))
            weights.append(w)
            good[:n] += w * np.array(y)
            for a, b in zip(y, y[1:]):
                moves[a, b] += w
        assert np.allclose(p[d], good / sum(weights)) and np.isclose(z[d], np.log(sum(weights)))
        total += moves / sum(weights)
    assert np.allclose(pairs, total)


def test_quality_learns_lines_and_scores_everything(spark, docs, none):
    junk = lambda k: "\n".join(" ".join(w + "%%%" for w in prose(k, 8).split()) for _ in range(3))
    rows = [(1000 + i, junk(i) if i % 3 == 0 else prose(i, 50), "en", "s") for i in range(120)]
    labels = spark.createDataFrame([(r[0], int(r[0] % 3 != 1), 7) for r in rows if r[0] < 1090] + [(300, 1, 0), (301, None, 0), (None, 1, 1)], "doc_id long, quality int, text int")
    train = frame(spark, documents(rows))
    model = quality_crf.fit(train, labels)
    got = {r.id: r.score for r in quality_crf.score(train, model).collect()}
    assert all((got[r[0]] >= 0.7) == (r[0] % 3 != 1) for r in rows[90:])
    assert got[300] == got[301] == got[302] == model.prior and all(0 <= s <= 1 for s in got.values())
    assert quality_crf.score(docs, model).count() == docs.count()
    flat = quality_crf.fit(none, labels)
    assert quality_crf.score(none, flat).count() == 0 and flat.scores(["some text"])[0] == pytest.approx(flat.prior)


# 2
def test_fingerprints_of_edits(docs, none):
    got = imatch.fingerprint_edits(docs).collect()
    rows = sorted(((-(1 << 63) if r[0] is None else r[0], r[1] or "") for r in documents()), key=lambda r: r[0])
    assert len(got) == len(rows)
    ids = Counter(r[0] for r in rows)
    by = {r.id: r for r in got}
    prints = defaultdict(set)
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        if ids[i] == 1:
            r = by[i]
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(imatch.edited(text, after).encode()).hexdigest()
            assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
            prints[text].add(r.fingerprint)
    assert all(len(x) == 1 for x in prints.values()) and len({x for s in prints.values() for x in s}) >= len(prints) - 2
    long = [by[i] for i in range(39)]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.2
    assert imatch.fingerprint_edits(none).count() == 0


def test_many_fingerprints_equal_single_ones_and_hash_a_word_once(monkeypatch):
    texts = [prose(100 + k % 30, 5 + 7 * k) for k in range(60)] + ["", "one", None]
    counts = Counter(w for t in texts for w in set(words(t)))
    hashed = {w: xxhash.xxh64_intdigest(w, 7) for w in counts}
    for least in (2, 99):
        lexicon = np.sort(np.array([hashed[w] for w, n in counts.items() if n >= least], np.uint64))
        single = [imatch.fingerprint(imatch.term_hashes(t), lexicon) for t in texts]
        prints = imatch.Prints(lexicon)
        assert np.array_equal(prints(texts[:20]), single[:20]) and np.array_equal(prints(texts), single)
        # Each hash is that of all words of a subset, sorted.
        t = max(texts[:60], key=len)
        terms = np.sort(np.array([hashed[w] for w in set(words(t)) if least == 99 or hashed[w] in lexicon], np.uint64))
        assert single[texts.index(t)][0].tolist() == [xxhash.xxh64_intdigest(terms[imatch._depths(terms)[:, k] > 0].tobytes(), k) % 65535 + 1 for k in range(16)]
    pairs = [(single[a], single[b]) for a in range(0, 63, 3) for b in range(0, 63, 4)]
    for (a, b), got in zip(pairs, imatch.likenesses(*map(np.array, zip(*pairs))), strict=True):
        used, same, seen = (a != 0) | (b != 0), 0, 0
        for level in range(imatch.LEVELS - 1, -1, -1):
            seen, same = seen + used[level].sum(), same + (used[level] & (a[level] == b[level])).sum()
            if seen >= imatch.ENOUGH:
                break
        assert got == (1 if np.array_equal(a, b) else same / seen)
    calls, h = Counter(), xxhash.xxh64_intdigest
    monkeypatch.setattr(imatch.xxhash, "xxh64_intdigest", lambda x, k=0: calls.update([(bytes(x), k)]) or h(x, k))
    terms, place, ends = imatch._terms(texts)
    assert set(calls) == {(w, 7) for w in counts} and max(calls.values()) == 1
    assert all(np.array_equal(terms[place[a:b]], sorted({hashed[w] for w in words(t)})) for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True))


def test_lexicon_is_the_band_whatever_the_partitions(spark):
    rows = [(i, " ".join(w for k, w in enumerate(["a", "b", "c", "d"]) if i % (3**k) == 0), "en", "s") for i in range(300)]
    want = sorted(xxhash.xxh64_intdigest(w, 7) for w in (b"b", b"c"))
    for parts in (1, 7):
        assert imatch.lexicon(frame(spark, rows).repartition(parts), rarest=0.1, commonest=0.5).tolist() == want


# 3
def test_mix_meets_targets(spark, docs, none):
    rows = [(i, "w " * (1 + i * 37 % 90), "en", None if i % 7 == 6 else f"s{i % 7}") for i in range(600)] + [r for r in documents() if r[0] and r[0] >= 300]
    got = mixing.mix_sources(frame(spark, rows)).collect()
    assert len(got) == len(rows) and Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(want[s] for s in sizes if s not in open_)
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s] + 1e-9}
        want |= {s: 2.0 * sizes[s] for s in over} if over else share
        if not over:
            break
        open_ -= over
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    block = int(sum(sizes.values()) ** 0.5 / 8)
    assert all(abs(taken[s] - want[s]) <= 4 * block + 1 for s in sizes)
    again = mixing.mix_sources(frame(spark, rows).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix_sources(none).count() == 0
    assert mixing.mixed_documents(docs).columns == [*docs.columns, "words_taken"]


def test_mix_meets_targets_of_small_sources(spark):
    rows = [(i, "w " * 2000, "en", f"big{i % 3}") for i in range(1500)] + [(5000 + 100 * k + j, "w " * (1 + k), "en", f"small{k:02}") for k in range(40) for j in range(1 + k % 10)]
    got = mixing.mix_sources(frame(spark, rows)).collect()
    target, taken = {}, Counter()
    for r in got:
        target[r.source] = r.target
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= max(3, 0.06 * t) for s, t in target.items())


# 4
def brute(lattice, pieces, word):
    known, t = dict(zip(pieces, lattice.logp, strict=False)), b" " + word
    f = [0.0] + [-np.inf] * len(t)
    for j in range(1, len(t) + 1):
        for i in range(max(0, j - 8), j):
            if t[i:j] in known:
                f[j] = np.logaddexp(f[j], f[i] + known[t[i:j]])
    return f[-1]


def test_lattice_sums_over_all_cuts():
    pieces = sorted({bytes([b]) for b in range(256)} | {b" a", b"ab", b"abc", b" abcdefg", "é".encode()})
    lattice = lattice_lm.Lattice(pieces, np.log(np.full(len(pieces), 1 / len(pieces))))
    tokens = [b"a", b"abc", b"abcdefg", b"ababab", "éabé".encode(), b"x" * 70, b"\0"]
    assert np.allclose(lattice.word_scores(tokens), [brute(lattice, pieces, w) for w in tokens])
    n = lattice.expected(tokens, np.ones(len(tokens)))
    assert np.isclose(sum(c * len(p) for c, p in zip(n, pieces)), sum(len(w) + 1 for w in tokens))


def test_lattice_has_pieces_of_every_length():
    pieces, logp = lattice_lm.vocabulary(lattice_lm.VOCABULARY)
    assert {b" function", b" something"} <= set(pieces)
    lattice, known = lattice_lm.Lattice(pieces, logp), dict(zip(pieces, logp))
    tokens = [b"guarantee", b"function", b"something", b"functions", b"responsibilities", b"a", "überraschungen".encode(), b"x" * 40]

    def every_cut(t):
        f = [0.0] + [-np.inf] * len(t)
        for j in range(1, len(t) + 1):
            f[j] = np.logaddexp.reduce([f[i] + known.get(t[i:j], -np.inf) for i in range(j)])
        return f[-1]

    assert np.allclose(lattice.word_scores(tokens), [every_cut(b" " + w) for w in tokens])
    n = lattice.expected(tokens, np.ones(len(tokens)))
    assert np.isclose(sum(c * len(p) for c, p in zip(n, pieces)), sum(len(w) + 1 for w in tokens))


def test_scores_of_documents(docs, none):
    held = common.remainder("doc_id", 10) == 0
    got = lattice_lm.score_documents(docs, ~held, frequent=0.01).collect()
    count, ends = Counter(), 0
    for i, text, *_ in documents():
        if i is None or __import__("zlib").crc32(str(i).encode()) % 10:
            count.update(words(text))
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    base = lambda c: np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    want = Counter()
    for i, text, *_ in documents():
        w = words(text)
        want[(i, len(w) + 1, sum(count[x] > 0 for x in w) + 1, n, round(sum(base(count[x]) for x in w) + base(ends), 4))] += 1
    assert Counter((r.id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lattice_lm.score_documents(none, ~held).count() == 0


# 5
def test_golay_cells_and_links(spark):
    errors, ends = simhash_cover._coset(0)
    assert (np.diff(ends) == 1).all() and len(errors) == 2048
    r = random.Random(5)
    fps = [r.getrandbits(64) for _ in range(60)] + [0]
    for x in list(fps):
        fps += [x ^ sum(1 << b for b in r.sample(range(64), k)) for k in (1, 2, 2, 3)]
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in fps})
    got = {(x.a, x.b) for x in simhash_cover.links(spark.createDataFrame([(x,) for x in fps], "fp long"), 2).collect()}
    assert got == {(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}


def test_near_groups(spark, docs, none):
    rows = documents()

    def fp(text):
        w = words(text)
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [(i, fp(t)) for i, t, *_ in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    least = {g: min((prints[k][0] for k in range(len(rows)) if group[k] == g and prints[k][0] is not None), default=None) for g in group}
    got = simhash_cover.near_groups(docs).collect()
    assert Counter((r.id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == Counter((i, f, least[group[k]]) for k, (i, f) in enumerate(prints))
    kept = simhash_cover.keep_one(docs)
    assert kept.columns == docs.columns and simhash_cover.near_groups(none).count() == 0


def test_pipeline_drops_edited_copies(spark, docs, none):
    def edited(k, gaps):
        w = prose(7000 + k, 300).split()
        for g in gaps:
            w[g] = "edited"
        return " ".join(w)

    rows = [(2000 + 10 * k + j, edited(k, range(10, 300, 60 // j) if j else []), "en", "s1") for k in range(12) for j in range(3)]
    rows += [(3000 + k, prose(7000 + k, 300) + " " + prose(8000 + k, 200), "en", "s1") for k in range(12)]  # half of it another text
    rows += [(4000 + k, edited(50, [30 + 3 * k]), "en", "s1") for k in range(40)]  # one group
    rows = documents(rows)
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for _, t, *_ in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in group}
    d = frame(spark, rows).repartition(3)
    assert Counter((r.id, r.component_id) for r in near_copies.near_groups(d).collect()) == Counter((r[0], least[group[k]]) for k, r in enumerate(rows))
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, d, "")
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == d.columns and ids == set(least.values())
    assert not ids & {2001 + 10 * k for k in range(12)} and {3000 + k for k in range(12)} <= ids
    assert near_copies.near_groups(none).count() == 0


def test_near_copies_meet_at_covers(spark, monkeypatch):
    def edited(k, n, at):
        w = prose(7500 + k, n).split()
        w[at] = "edited"
        return " ".join(w)

    rows = [(2 * k, prose(7500 + k, 600), "en", "s") for k in range(30)] + [(2 * k + 1, edited(k, 600, 300), "en", "s") for k in range(30)]
    rows += [(500 + k, prose(9500 + k, 600), "en", "s") for k in range(30)] + [(900, "", "en", "s"), (901, None, "en", "s")]
    d = frame(spark, rows)
    prints = near_copies._prints(d, "doc_id", "text", 5, 28, 5).where("id < 900").cache()
    fps = {r.node: (r.fp, r.size, r.id) for r in prints.collect()}
    for _, t, *_ in rows[:5]:
        found = near_copies.shingle_set(t, 5)
        assert near_copies.simhash(found) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in found) > len(found))
    got = {frozenset((r.a, r.b)) for r in near_copies.cover_pairs(prints).collect()}
    apart = lambda x, y: ((fps[x][0] ^ fps[y][0]) & (1 << 64) - 1).bit_count()
    pairs = [frozenset((x, y)) for x in fps for y in fps if x < y]
    home = {n: int(simhash_cover.anchors(np.array([fps[n][0]]), 0)[1][0]) for n in fps}
    hub = {h: min(n for n in fps if home[n] == h) for h in home.values()}
    assert all(p in got for p in pairs if apart(*p) <= 2 and any(hub[home[n]] == n for n in p))
    assert all(apart(*p) <= 12 for p in got)
    # Without bands, covers alone find most copies with one word edited; both together find all.
    whole = lambda: sum(r.id % 2 == 1 and r.component_id == r.id - 1 for r in near_copies.near_groups(d).where("id < 60").collect())
    assert whole() == 30
    monkeypatch.setattr(near_copies, "band_hashes", lambda found, bands, rows: [])
    alone = near_copies.near_groups(d, bands=0).where("id < 60").collect()
    assert 20 <= sum(r.id % 2 == 1 and r.component_id == r.id - 1 for r in alone) <= 30


def test_replicas_and_members_of_buckets_are_not_broadcast(spark):
    nodes = spark.createDataFrame([(k, 9, k * 0x9E3779B97F4A7C15 % (1 << 62), [k // 2, 100 + k]) for k in range(60)], "node long, size int, fp long, buckets array<long>")
    for out, key in ((near_copies.cover_pairs(nodes, within=64), "anchor"), (near_copies._shared(nodes), "bucket")):
        ran = out._jdf.queryExecution()
        ran.toRdd().count()
        joins = re.findall(rf"(\w+Join) \[{key}#", ran.executedPlan().toString().split("== Initial Plan ==")[0])
        assert joins == ["SortMergeJoin"]
    assert Counter(near_copies._shared(nodes).select("bucket", "node", "hub.node").collect()) == Counter((k // 2, k, k // 2 * 2) for k in range(60))


# 6
def test_languages(docs, none, spark):
    de = lambda k: " ".join(random.Random(k).choice("der die und nicht über schön straße wäre haus gegen".split()) for _ in range(30))
    rows = [(1000 + i, de(i) if i % 2 else prose(i, 30), "de" if i % 2 else "en", None) for i in range(200)]
    d = frame(spark, documents(rows))
    model = langid.fit(d.where("doc_id >= 1000 and doc_id < 1150"), "doc_id", "text", "lang")
    out = langid.identify(d, model)
    assert out.columns == [c for c in d.columns if c != "score"] + ["lang_pred", "score", "rejected"]
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[r[0]].lang_pred == r[2] and not got[r[0]].rejected for r in rows[150:])
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (300, 301, 302, 303))
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.keep_identified(d, model)
    assert kept.columns == d.columns and kept.where("doc_id in (300, 301, 302, 303)").count() == 0 and kept.where("doc_id >= 1000").count() == 200
    blank = langid.fit(none, "doc_id", "text", "lang")
    assert {r.lang_pred for r in langid.identify(docs, blank).collect()} == {"und"}


def test_long_texts_count_alike():
    text = langid._fold(prose(1, 400)) * 3000
    whole = next(c for _, c in langid._grams([text]))
    h2, h3 = langid._hashes(np.frombuffer(b" " + text + b" ", np.uint8))
    assert np.array_equal(whole, np.bincount(h2, minlength=langid.DIM) + np.bincount(h3, minlength=langid.DIM))


# 7
def test_suffix_order_and_windows():
    r = random.Random(1)
    for _ in range(60):
        n = r.randint(1, 50)
        t = np.array([r.randint(1, r.choice([3, 4, 257])) for _ in range(n)] + [0], np.uint16)
        got = np.concatenate(list(suffix_sort.descending_suffixes(t, 200, memory=r.choice([3, 1 << 20]))))
        assert got.tolist() == sorted(range(n + 1), key=lambda i: t[i:].tolist(), reverse=True)
    for _ in range(40):
        segments = [bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 12))]
        found, want = defaultdict(set), defaultdict(set)
        for a, b, c in suffix_sort.equal_windows(segments, 8, memory=r.choice([5, 1 << 20])):
            for x, y, z in zip(a.tolist(), b.tolist(), c.tolist()):
                found[z].add((x, y))
        for k, s in enumerate(segments):
            for i in range(len(s) - 7):
                want[s[i : i + 8]].add((k, i))
        assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_repeated_bytes(docs, none):
    last = 1 << 63
    rows = sorted((last if i is None else i, (t or "").encode()) for i, t, *_ in documents())
    first: dict[bytes, int] = {}
    want = Counter()
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if first.setdefault(t[k : k + 50], i) < i:
                gone[k : k + 50] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        want[(None if i == last else i, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), kept)] += 1
    got = suffix_dedup.remove_repeats(docs).collect()
    assert Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_texts_are_dealt_once_and_findings_go_packed(spark):
    d = frame(spark, [(k, prose(600 + k % 50, 120), "en", "s") for k in range(200)])
    out = suffix_dedup.remove_repeats(d)
    assert out.where("n_removed > 0 and n_bytes > n_removed").count() == 0 and out.where("n_removed = n_bytes").count() == 150
    plan = out._jdf.queryExecution().executedPlan()
    out._jdf.queryExecution().toRdd().count()
    assert plan.toString().split("== Initial Plan ==")[0].count("ReusedExchange") == 1
    assert spark.conf.get(suffix_dedup.CLEANUP) == "false"
    # A shard's lost segments of many documents: some four bytes each.
    r = random.Random(3)
    doc, o = np.array([r.randrange(10**6) for _ in range(20_000)]), np.array([r.randrange(200) for _ in range(20_000)])
    to, packed = suffix_dedup._to_buckets(16, doc, o, np.full(len(doc), -1))
    assert len(to) == 16 and sum(map(len, packed)) < 5 * len(doc)
    back = np.concatenate([suffix_dedup._unpack(x) for x in packed], axis=1)
    assert sorted(zip(*back.tolist(), strict=True)) == sorted(zip(doc.tolist(), o.tolist(), [-1] * len(doc), strict=True))
    assert suffix_dedup._to_buckets(16, doc[:0], o[:0], o[:0]) == ([], []) and suffix_dedup._unpack(suffix_dedup._pack(doc[:1], o[:1], o[:1])).tolist() == [[doc[0]], [o[0]], [o[0]]]


def test_shards_get_few_bytes_of_ids_in_no_order():
    texts = [prose(700 + k, 60) for k in range(200)]
    sizes = []
    for ids in (range(200), [random.Random(k).randrange(1 << 40) for k in range(200)]):
        rows = [x for b in suffix_dedup._anchors(500)(iter([pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts)], ["id", "t"])])) for x in b.to_pylist()]
        judged = Counter()
        for x in rows:
            known = np.cumsum(np.frombuffer(zlib.decompress(x["ids"]), np.int64))
            judged.update(known[np.frombuffer(x["d"], np.uint16)].tolist())
        assert judged == Counter({i: len(suffix_dedup.segments(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0]) for i, t in zip(ids, texts, strict=True)})
        sizes.append(sum(len(x["ids"]) for x in rows))
    assert sizes[1] < 12 * sum(judged.values())


def test_segments_of_many_documents_are_found_together(monkeypatch):
    texts = [prose(400 + k, k % 7 * 9).encode() for k in range(300)]
    each = [suffix_dedup.segments(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts]
    together = suffix_dedup.segments(np.frombuffer(b"".join(texts), np.uint8), suffix_dedup._ends(texts))
    assert np.array_equal(together[0], np.concatenate([e[0] for e in each])) and np.array_equal(together[2], np.repeat(range(300), [len(e[0]) for e in each]))
    r, calls, own = random.Random(7), [], suffix_dedup._segments
    lost = [[{"o": o, "mask": r.choice([-1, 1 | 1 << int(hi[o] - lo[o])])} for o in range(len(lo)) if r.random() < (1 if k % 3 else 0.3)] or None for k, (_, _, _, lo, hi) in enumerate(each)]
    kind = pa.list_(pa.struct([("o", pa.int32()), ("mask", pa.int64())]))
    pack = zstandard.ZstdCompressor()
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array([pack.compress(t) for t in texts]), pa.array(lost, kind)], ["doc", "z", "lost"])
    monkeypatch.setattr(suffix_dedup, "_segments", lambda *a: calls.append(1) or own(*a))
    got = [row for b in suffix_dedup._cleaned(True)(iter([batch])) for row in b.to_pylist()]
    assert len(calls) <= 3
    for k, (t, row) in enumerate(zip(texts, got, strict=True)):
        gone = np.zeros(len(t), int)
        for x in lost[k] or []:
            for w in range(each[k][3][x["o"]], each[k][4][x["o"]] + 1):
                if x["mask"] < 0 or x["mask"] >> (w - each[k][3][x["o"]]) & 1:
                    gone[w : w + 50] = 1
        kept = bytes(c for c, g in zip(t, gone) if not g)
        assert row == {"id": k, "n_bytes": len(t), "n_removed": int(gone.sum()), "n_spans": int((np.diff(gone, prepend=0) == 1).sum()), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept}


# 8
def test_sentence_spans(docs, none):
    places = defaultdict(set)
    for i, t, *_ in documents():
        s = sentence_spans.sentences(t)[0]
        for k in range(len(s) - 2):
            places[tuple(s[k : k + 3])].add((i is None, i or 0, k, t))
    want = Counter()
    for i, t, *_ in documents():
        s, at = sentence_spans.sentences(t)
        gone = {k + j for k in range(len(s) - 2) if min(places[tuple(s[k : k + 3])]) != (i is None, i or 0, k, t) for j in range(3)}
        want[(i, len(s), len(gone), sentence_spans.cut(t, at, gone) if gone else t)] += 1
    out = sentence_spans.remove_repeats(docs)
    assert out.columns == [*docs.columns, "n_sentences", "n_removed"]
    assert Counter((r.doc_id, r.n_sentences, r.n_removed, r.text) for r in out.collect()) == want
    assert sentence_spans.remove_repeats(none).count() == 0
    passage = " ".join(f"w{k}" for k in range(60))  # without full stops, and met at any place
    a, b = (set(sentence_spans.sentences(x + " " + passage)[0]) for x in ("one two", "one two three four five six seven eight"))
    assert len(a & b) >= 3


def test_texts_are_cut_and_spans_dealt_out_once(spark):
    text = prose(31, 200)
    rows = [(i if i % 9 else None, text if i % 2 else prose(9000 + i, 100), "en", "s") for i in range(60)]
    d = frame(spark, rows).repartition(2)
    out = sentence_spans.remove_repeats(d)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
    spans = sentence_spans._spans(d, "doc_id", "text", 3, 12)
    hot = spans.where("kind = 0").groupBy("h", "g").count().agg({"count": "max"}).first()[0]
    assert hot <= 4 < spans.where("kind = 1").count()  # as many as partitions, and none the second time but for equal places
    # A text without repeats isn't cut again.
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in out.where("doc_id % 2 = 0").collect()}
    assert all(got[i] == (len(sentence_spans.sentences(rows[i][1])[0]), 0, rows[i][1]) for i in range(60) if i % 2 == 0 and i % 9)


def test_passages_of_51_words_hold_a_span_at_every_offset():
    r = random.Random(8)
    some = lambda n: [f"w{min(19_999, int(r.paretovariate(0.6)))}" for _ in range(n)]
    passages = [some(51) for _ in range(40)] + [["ha"] * 51, ["a", "b"] * 25 + ["a"], ["a", "b", "c"] * 17]
    for passage in passages:
        for offset in range(1, 30):
            spans = []
            for before in (some(offset), some(r.randrange(1, 40))):
                s, at = sentence_spans.sentences(" ".join(before + passage + some(20)))
                lo = len(" ".join(before)) + 1
                hi = lo + len(" ".join(passage))
                spans.append({tuple(s[k : k + 3]) for k in range(len(s) - 2) if at[k][0] >= lo and at[k + 2][1] <= hi})
            assert spans[0] & spans[1]


# 9
def plain_tiling(item, doc, m):
    """Marks the longest match of unmarked words, again and again."""
    used_i, used_d, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for x in range(len(item)):
            for y in range(len(doc)):
                k = 0
                while x + k < len(item) and y + k < len(doc) and item[x + k] == doc[y + k] and x + k not in used_i and y + k not in used_d:
                    k += 1
                if k > best[0]:
                    best = (k, x, y)
        if best[0] < m:
            return out
        k, x, y = best
        used_i |= set(range(x, x + k))
        used_d |= set(range(y, y + k))
        out.append(best)


def test_tiles_equal_plain_tiling():
    r = random.Random(2)
    for _ in range(80):
        item, doc = ([r.randint(1, 4) for _ in range(r.randint(1, 25))] for _ in range(2))
        got = tiling.tiles(np.array(item, np.uint64), np.array(doc, np.uint64), 3)
        assert sum(t[0] for t in got) == sum(t[0] for t in plain_tiling(item, doc, 3))


def test_decontamination(spark, docs, none):
    items = [(1, prose(999, 60)), (2, " ".join(prose(999, 60).split()[30:] + prose(999, 60).split()[:30])), (3, prose(4000, 40)), (4, "Two words"), (5, None), (6, ""), (None, prose(309, 50)), (7, prose(8, 86))]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    hit = {r.id: r for r in tiling.contaminated(docs, bench).collect()}
    assert {100, 101, 102, 103, 305, 309, 8} == set(hit) and hit[100].items == 2 and hit[100].item == 1 and hit[305].coverage == 1
    in_blocks = {r.id for r in tiling.contaminated(docs, bench, block_words=40).collect()}
    assert in_blocks == set(hit)
    kept = tiling.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 8
    assert tiling.tiled(none, bench).count() == 0 and tiling.decontaminate(docs, bench.limit(0)).count() == docs.count()


# 10
def test_line_spread(spark, docs, none):
    rows = documents([(500 + i, f"own {i}\n  shared line \nalso {i % 2}\n\nend", "en", f"t{i % 9}" if i else None) for i in range(30)])
    sites, first = defaultdict(set), {}
    for i, t, _, s in rows:
        for line in (t or "").split("\n"):
            if line.strip(" "):
                sites[line.strip(" ")] |= {s} - {None}
                first[line.strip(" ")] = min(first.get(line.strip(" "), 1 << 63), (1 << 63) if i is None else i)
    want = Counter()
    for i, t, *_ in rows:
        lines = [] if t is None else t.split("\n")
        gone = [bool(x.strip(" ")) and len(sites[x.strip(" ")]) >= 8 and first[x.strip(" ")] != i for x in lines]
        want[(i, None if t is None else "\n".join(x for x, g in zip(lines, gone) if not g), sum(bool(x.strip(" ")) for x in lines), sum(gone))] += 1
    out = line_spread.remove_spread_lines(frame(spark, rows))
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect())
    assert got == want and sum(k[3] for k in want) >= 29
    assert line_spread.remove_spread_lines(docs, keep_counts=False).columns == docs.columns
    assert line_spread.remove_spread_lines(none).count() == 0


def test_pipeline_stages_keep_columns_and_clean_documents(spark, tmp_path):
    clean = [(1000 + i, prose(5000 + i, 80), "en" if i % 2 else "de", f"s{i % 3}") for i in range(60)]
    rows = documents(clean)
    folder = str(tmp_path)
    spark.createDataFrame([(1, prose(999, 60))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    d = frame(spark, rows)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, folder)
        assert out.columns[: len(d.columns)] == d.columns and (k == 4 or out.columns == d.columns)
        out.write.parquet(f"{folder}/{k}")
        d = spark.read.parquet(f"{folder}/{k}")
        if k < 4:
            assert d.where("doc_id >= 1000").count() == 60
    assert d.where("doc_id between 100 and 103").count() == 0
