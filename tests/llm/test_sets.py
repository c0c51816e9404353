"""The n-gram join against brute force, and mixing, sharding and line deduplication."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quadrille.llm import jaccard, linededup, mixing, sharding

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width, percent):
    sets = [grams(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def edited(rng, words, share):
    out = list(words)
    for k in range(len(out)):
        if rng.random() < share:
            out[k] = f"x{rng.randrange(10**6)}"
    return out


def corpus(seed):
    """Unrelated texts, chains of near copies, a passage that most share, tiny texts, hot copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows, texts = [], []
    for _ in range(60):
        own = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 9, 12, 20, 40, 150, 600]))
        texts.append(own + passage if rng.random() < 0.6 else own)
    for base in list(texts[:20]):
        text = base
        for _ in range(4):
            text = edited(rng, text, rng.choice([0.0, 0.004, 0.01, 0.03]))
            texts.append(text)
    texts += [texts[3]] * 40
    rng.shuffle(texts)
    for i, t in enumerate(texts):
        rows.append((i * 3 % 1009, " ".join(t).upper() if i % 7 == 0 else " ".join(t)))
    return rows


@pytest.mark.parametrize(("width", "percent", "seed"), [(3, 90, 1), (5, 80, 2)])
def test_join_is_exact(spark, documents, width, percent, seed):
    rows = corpus(seed)
    got = jaccard.join(documents(rows), width, percent).collect()
    assert sorted(map(tuple, got)) == brute(rows, width, percent)


@pytest.mark.parametrize("counted", [0.0, 0.4, 6.0])
def test_join_is_exact_whatever_share_is_counted(spark, documents, monkeypatch, counted):
    monkeypatch.setattr(jaccard, "COUNTED", counted)
    rng = random.Random(4)
    lines = [" ".join(rng.choices([f"v{i}" for i in range(80)], k=k)) for k in (4, 9, 30, 70)]
    rows = [(d, "\n".join([t, *rng.sample(lines, rng.randrange(0, 4))])) for d, t in corpus(4)]
    assert sorted(map(tuple, jaccard.join(documents(rows), 5, 80).collect())) == brute(rows, 5, 80)


@pytest.mark.parametrize("percent", [50, 70])
def test_join_of_sizes_far_apart(spark, documents, percent):
    words = [f"w{i}" for i in range(3000)]
    rows = [(100 * i + j, " ".join(f"{i}{w}" for w in words[:n])) for i, pair in enumerate([(10, 20), (12, 23), (21, 30), (22, 31), (300, 429), (1000, 2000)]) for j, n in enumerate(pair)]
    assert sorted(map(tuple, jaccard.join(documents(rows), 1, percent).collect())) == brute(rows, 1, percent)


def test_blocks_are_joined_with_each_other(spark, documents, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)
    rows = corpus(5)
    assert sorted(map(tuple, jaccard.join(documents(rows), 3, 80).collect())) == brute(rows, 3, 80)


def test_parts_without_sets(spark):
    same = np.arange(100_000, dtype=np.uint64).astype(">u8").tobytes()
    hashed = spark.range(100).selectExpr("id fp", "pmod(xxhash64(id), 2) part")
    fps = [r.fp for r in hashed.filter("part = 1").orderBy("fp").limit(2).collect()]
    placed = jaccard.blocked(spark.createDataFrame([(fp, 100_000, 1) for fp in fps], "fp long, n long, bundle long"), 80)
    sets = spark.createDataFrame([(fp, 100_000, same) for fp in fps], "fp long, n long, grams binary")
    assert {tuple(sorted(r)) for r in jaccard.verified(placed, sets, 80).collect()} == {tuple(fps)}
    alone = placed.limit(1).selectExpr("fp", "pair", "1 side")
    assert jaccard.verified(alone, sets, 80).collect() == []


def test_tree_join():
    rng = np.random.default_rng(7)
    for percent in (50, 80, 90, 100):
        base = np.unique(rng.integers(0, 2**60, 200).astype(np.uint64))
        sets = [np.unique(np.concatenate([base[rng.random(len(base)) > rng.choice([0, 0.02, 0.1, 0.5])], rng.integers(0, 2**60, rng.integers(0, 25)).astype(np.uint64)])) for _ in range(60)]
        tree = sorted(sets[:40], key=lambda x: x.astype(">u8").tobytes())
        got = set(jaccard.tree_join(tree, sets[20:], percent))
        want = {(i, j) for i, x in enumerate(tree) for j, y in enumerate(sets[20:]) if 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y))}
        assert got == want


def test_similar_sets_share_of_their_prefixes():
    for percent in (50, 70, 80, 90, 100):
        for a in range(1, 60):
            for b in range(a, 100 * a // percent + 1):
                least = -(-percent * (a + b) // (100 + percent))  # so many must be shared
                # even if all that one lacks come first, a shared one is within the prefix
                assert a - least + 1 <= jaccard.prefix_of(a, percent) and b - least + 1 <= jaccard.prefix_of(b, percent)


def test_a_common_passage_connects_nothing_else(spark, documents):
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = documents([(i, passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))) for i in range(80)])
    filed = jaccard.filed(rows, jaccard.fingerprints(rows, 5, 80), 5, 80)
    assert jaccard.stars(filed, 80).count() == 0


def test_copies_in_several_tasks_share_nothing(spark):
    text = " ".join(f"word{k}" for k in range(400))
    one = spark.createDataFrame([(0, text)], "doc_id long, text string")
    # a task each, so that none meets another's copy
    copies = spark.createDataFrame([(k, text) for k in range(4)], "doc_id long, text string").repartitionByRange(4, "doc_id")
    grams = lambda docs: {(r.h, r.fp) for r in jaccard.filed(docs, jaccard.fingerprints(docs, 5, 80), 5, 80).collect()}
    assert grams(copies) == grams(one)
    assert sorted(map(tuple, jaccard.join(copies, 5, 80).collect())) == [(k, 396, 0) for k in range(4)]


def test_join_edges(spark, edges, nothing):
    got = {r.doc_id: r for r in jaccard.join(edges, 3, 90).collect()}
    assert got[1].n_shingles == got[2].n_shingles == got[3].n_shingles == 0 and got[2].component_id == 2
    assert got[5].component_id == got[6].component_id == 5
    assert got[None].component_id is None and got[4].n_shingles == 977
    assert jaccard.join(nothing, 3, 90).count() == 0
    kept = jaccard.one_of_each(edges, 3, 90)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 7]


def test_mix_meets_targets(spark, documents):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(0, 80))), rng.choice("aaaaabcd") if i % 11 else None) for i in range(700)]
    out = mixing.mix(documents(rows)).collect()
    again = mixing.mix(documents(rows[::-1])).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == 700
    taken, size, target = Counter(), Counter(), {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    names = sorted((s for s in size if s), key=str) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    free = [target[s] / weight[s] for s in names if target[s] < 2 * size[s] - 1e-6]
    assert max(free) - min(free) < 1e-6  # one level for all that are not at their limit
    for s in names:
        assert abs(taken[s] - target[s]) <= 4  # blocks of a word, a few for the points' discrepancy


def test_mix_follows_its_schedule(spark, documents, monkeypatch):
    """Other points give other sources their slots, and so other words are taken."""
    rows = [(i, "w " * (5 + i % 7), "abc"[i % 3]) for i in range(300)]
    by_points = {r.doc_id: r.taken for r in mixing.mix(documents(rows), slots=200).collect()}
    monkeypatch.setattr(mixing, "GOLDEN", 1)  # all points lie at the start, in the first source
    in_order = {r.doc_id: r.taken for r in mixing.mix(documents(rows), slots=200).collect()}
    assert by_points != in_order
    assert all(n == 0 for d, n in in_order.items() if d % 3) and any(n for d, n in by_points.items() if d % 3)


CLASHES = ["_kept", "_bad", "_copies", "_part", "_hash", "_value", "_spread", "_range", "_base", "_inner", "_key", "_row", "_id", "_of", "_text", "_at", "_copy", "text_hash", "component_id", "places", "rank"]


@pytest.mark.parametrize("operator", ["one_of_each", "clean", "mixture", "shard"])
def test_clashing_names_keep_their_values(spark, operator):
    from pyspark.sql import functions as F

    from quadrille.llm import decontaminate

    docs = spark.createDataFrame([(i, f"some words of number {i} that are its own", "s") for i in range(6)], "doc_id long, text string, source string").select("*", *[(F.col("doc_id") * 100 + k).alias(c) for k, c in enumerate(CLASHES)])
    items = spark.createDataFrame([(1, "an item that no document has at all")], "item_id long, text string")
    made = {"one_of_each": lambda: jaccard.one_of_each(docs), "clean": lambda: decontaminate.clean(docs, items), "mixture": lambda: mixing.mixture(docs), "shard": lambda: sharding.shard(docs)}[operator]()
    rows = made.collect()
    assert len(rows) >= 6 and set(docs.columns) <= set(made.columns)
    assert all(r[c] == r.doc_id * 100 + k for r in rows for k, c in enumerate(CLASHES))


def test_mix_against_brute_force(spark, documents):
    """Slot by slot: the source by its golden-ratio point, then the next block of words of the source, repeated end to end, if there is one."""
    from pyspark.sql import functions as F

    from quadrille.llm.common import spread31

    rng = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 60))), rng.choice("aaabc")) for i in range(160)]
    docs, slots = documents(rows), 300
    out = {r.doc_id: r for r in mixing.mix(docs, slots=slots).collect()}
    order = [r.doc_id for r in docs.select("doc_id", spread31(11, F.col("doc_id"), F.xxhash64("text")).alias("h")).orderBy("h", "doc_id").collect()]
    quota, target, tape = {}, {}, {}
    for d in order:
        tape.setdefault(out[d].source, []).extend([d] * out[d].size)
        target[out[d].source] = out[d].target
    names, total = sorted(target), sum(target.values())
    whole = sum(int(target[s] + 0.5) for s in names)
    quota = {s: 2 * len(tape[s]) for s in names}  # all there is
    block = max(1, whole // slots)
    places = whole // block + 1
    taken, first, at = Counter(), {}, dict.fromkeys(names, 0)

    def take(s, place):
        for k in range(at[s], min(at[s] + block, quota[s])):
            d = tape[s][k % len(tape[s])]
            taken[d] += 1
            first.setdefault(d, place)
        at[s] += block

    for place in range(places):
        point, up = place * mixing.GOLDEN % 2**31 / 2**31, 0.0
        for s in names:
            up += target[s] / total
            if point < up or s == names[-1]:
                if at[s] < quota[s]:
                    take(s, place)
                break
    assert all(r.slots == places for r in out.values())
    assert {d: r.taken for d, r in out.items()} == {d: taken[d] for d in out}
    assert {d: r.first_place for d, r in out.items()} == {d: first.get(d) for d in out}


def test_mix_schedule_is_interleaved(spark, documents):
    rows = [(i, "w " * 20, "ab"[i % 2]) for i in range(400)]
    targets = mixing.source_targets(documents(rows).selectExpr("doc_id", "source", "20L size"))
    slots = mixing.schedule(targets, 1000).orderBy("place").limit(100).collect()
    of_a = [r.source_id for r in slots].count(0)
    share = {r.source: r.target for r in targets.collect()}
    assert abs(of_a / 100 - share["a"] / sum(share.values())) < 0.05


def test_mix_edges(spark, edges, nothing):
    out = mixing.mix(edges).collect()
    assert len(out) == 9 and all(r.taken <= 2 * r.size for r in out)
    assert {r.size for r in out if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.mix(nothing).count() == 0 and mixing.mixture(nothing).count() == 0
    assert mixing.mixture(edges).columns == edges.columns
    placed = mixing.mixture(edges, place="at")
    assert placed.columns == [*edges.columns, "at"] and placed.filter("at is null").count() == 0


def test_shard(spark, documents, edges, nothing):
    rows = [(i, f"text {i % 300} é") for i in range(1003)]
    out = sharding.shard(documents(rows), 8).collect()
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        text = dict(rows)[r.doc_id].encode()
        assert r.size == len(text) + 1 and r.text_crc32 == zlib.crc32(text)
    assert sorted(len(v) for v in by.values()) == [125] * 5 + [126] * 3
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r.doc_id for r in out}) == 1003
    ids = [r.doc_id for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(ids, range(1003))[0, 1]) < 0.2  # shuffled
    odd = sharding.shard(edges, 8)
    assert odd.count() == 9 and {r.size for r in odd.collect() if r.doc_id in (1, 2)} == {1}
    assert sharding.shard(nothing, 8).count() == 0


def test_communication_matrix():
    m = sharding.communication_matrix([10, 0, 37, 5], 8, 1)
    assert m.sum(1).tolist() == [10, 0, 37, 5] and sorted(m.sum(0)) == [6] * 4 + [7] * 4 and (m >= 0).all()
    many = sum(sharding.communication_matrix([100, 300], 4, s)[0] for s in range(200))
    assert np.allclose(many / 200, 25, atol=1.2)


def test_draw_beyond_numpys_range(monkeypatch):
    rng = np.random.default_rng(3)
    shares = np.bincount([sharding.draw(rng, 1_500_000_000, 1_500_000_000, 3) for _ in range(8000)], minlength=4) / 8000
    assert np.abs(shares - [0.125, 0.375, 0.375, 0.125]).max() < 0.02
    monkeypatch.setattr(sharding, "NUMPY_MOST", 0)
    for good, bad, n in ((7, 5, 6), (3, 40, 20), (40, 3, 20), (300, 500, 90)):
        own = np.bincount([sharding.draw(rng, good, bad, n) for _ in range(6000)], minlength=n + 1) / 6000
        theirs = np.bincount(rng.hypergeometric(good, bad, n, 60_000), minlength=n + 1) / 60_000
        assert np.abs(own - theirs).max() < 0.03
    matrix = sharding.communication_matrix([10, 0, 37, 5], 8, 1)
    assert matrix.sum(1).tolist() == [10, 0, 37, 5] and sorted(matrix.sum(0)) == [6] * 4 + [7] * 4 and (matrix >= 0).all()


def dropped(rows, least_docs, least_chars):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    hot = {k for k, n in held.items() if n >= least_docs and len(k) >= least_chars}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in hot]
        out.append((str(d), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("least_chars", [1, 5])
def test_line_dedup(spark, documents, least_chars):
    rng = random.Random(9)
    hot = ["Hot Line", "hot line  ", "\tHOT LINE", "", " ", "ab", "é"]
    rows = [(i, "\n".join(rng.choice(hot) if rng.random() < 0.5 else f"line {rng.randrange(200)}" for _ in range(rng.randrange(0, 9)))) for i in range(150)] + [(None, "hot line\nx"), (1000, None)]
    got = linededup.drop_lines(documents(rows), 10, least_chars).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in got) == dropped(rows, 10, least_chars)


def test_line_dedup_edges(spark, edges, nothing):
    out = linededup.drop_lines(edges, 2)
    assert set(edges.columns) <= set(out.columns) and out.count() == 9
    assert {r.n_dropped for r in out.collect() if r.doc_id in (5, 6)} == {2}
    assert linededup.drop_lines(nothing, 2).count() == 0


def test_rows_of_one_id_are_one_document(spark, documents):
    same = linededup.drop_lines(documents([(7, "one\ntwo\none")] * 12), 10).collect()
    assert len(same) == 12 and {(r.n_lines, r.n_dropped) for r in same} == {(3, 0)}
    others = [(7, f"one\nmine {i}") for i in range(12)] + [(20 + i, f"one\nhis {i % 5}") for i in range(9)]
    got = linededup.drop_lines(documents(others), 10).collect()
    assert {r.kept_text for r in got} == {t.split("\n")[1] for _, t in others} and all(r.n_dropped == 1 for r in got)
    assert {r.n_dropped for r in linededup.drop_lines(documents(others), 11).collect()} == {0}
    none = linededup.drop_lines(documents([(None, "x")] * 4), 4).collect()
    assert [r.n_dropped for r in none] == [1] * 4


def test_line_dedup_beyond_the_filters_bound(spark, documents, monkeypatch):
    rng = random.Random(10)
    rows = [(i, "\n".join(f"line {rng.randrange(300)}" for _ in range(30))) for i in range(120)]
    monkeypatch.setattr(linededup, "KEYS_PER_SHARD", 40)
    monkeypatch.setattr(linededup, "FILTER_BYTES", 300)
    got = linededup.drop_lines(documents(rows), 10).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in got) == dropped(rows, 10, 1)


def test_line_dedup_of_clashing_columns_and_many_hot_lines(spark):
    text = "\n".join(f"hot {i}" for i in range(30_000))
    docs = spark.createDataFrame([(i, text + f"\nown {i}", "a", "b", "c", "d", 1) for i in range(3)], "doc_id long, text string, _hot string, _of string, _text string, h1 string, at int")
    got = linededup.drop_lines(docs, 3)
    assert got.columns == [*docs.columns, "kept_text", "n_lines", "n_dropped"]
    assert sorted((r._hot, r.kept_text, r.n_dropped) for r in got.collect()) == [("a", f"own {i}", 30_000) for i in range(3)]


def test_full_filters_are_built_anew(spark):
    rng = np.random.default_rng(8)
    h1, h2 = rng.integers(-(2**62), 2**62, (2, 400))
    hot = spark.createDataFrame([(int(a), int(b)) for a, b in zip(h1, h2)], "h1 long, h2 long")
    few = linededup.build_filters(hot.limit(12), 2)
    with pytest.raises(Exception, match="full"):
        linededup.change_filters(few, hot, hot.limit(0), 2).collect()
    changed = linededup.change_filters(few, hot, hot.limit(0), 2, hot=hot)
    assert linededup.screen(hot.selectExpr("1L doc_id", "h1", "h2"), changed, 2).count() == 400


def test_counts_can_be_undone(spark, documents):
    rows = [(i, f"common\nown {i}\nthird {i % 3}") for i in range(30)]
    before = linededup.counts(documents(rows))
    more = documents([(100 + i, "common\nnew") for i in range(5)])
    after = linededup.change(linededup.change(before, added=more), deleted=more)
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, before.collect()))


def test_cuckoo_filters_follow_deletions(spark, documents):
    rng = np.random.default_rng(4)
    h1, h2 = rng.integers(-(2**62), 2**62, (2, 5000))
    f = linededup.filled(h1, h2)
    assert f.has(h1, h2).all()
    f.delete(h1[:2500], h2[:2500])
    assert f.has(h1[2500:], h2[2500:]).all() and f.has(h1[:2500], h2[:2500]).mean() < 0.01
    hot = spark.createDataFrame([(int(a), int(b)) for a, b in zip(h1[:200], h2[:200])], "h1 long, h2 long")
    filters = linededup.build_filters(hot, 4)
    changed = linededup.change_filters(filters, hot.limit(0), hot.limit(100), 4)
    keys = hot.selectExpr("1L doc_id", "h1", "h2")
    left = linededup.screen(keys, changed, 4).count()
    assert 100 <= left <= 105 and linededup.screen(keys, filters, 4).count() == 200


def test_kept_hash(spark, documents):
    got = linededup.drop_lines(documents([(1, "a\nb")]), 10).selectExpr("sha2(kept_text, 256) h").first().h
    assert got == hashlib.sha256(b"a\nb").hexdigest()


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    from quadrille.llm.components import components

    rng = random.Random(seed)
    ids = [rng.randrange(-(2**62), 2**62) for _ in range(300)]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(200)] + [(ids[i], ids[i + 1]) for i in range(60)] + [(ids[100], i) for i in ids[200:240]]
    parent = {i: i for p in pairs for i in p if p[0] != p[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: find(i) for i in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
