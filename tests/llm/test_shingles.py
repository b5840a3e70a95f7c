"""Problems 2, 3 and 4 against brute force, with nulls, copies, reordered parts, ties and clashing columns."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scrivane.llm import copies, neardup, overlap, words
from scrivane.llm.blocks import Jaccard

TEXT = "id long, resume_str string, category string, text string, rep long, keep_id long, a long, tokens string"


def brute(rows):
    sets, bags = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if i is not None and len(w) >= 30:
            sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
            bags[i] = sorted(w)
    similar = {(a, b) for a, b in combinations(sorted(sets), 2) if 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}
    same = {(a, b) for a, b in combinations(sorted(sets), 2) if bags[a] == bags[b]}
    return similar, same


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)] + ["Élan", "naïve", "Straße", "x2"]
    rows = []
    for k in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([30, 31, 45, 120, 300]))]
        rows.append(base)
        for _ in range(rng.randrange(4)):
            edited = list(base)
            for _ in range(rng.randrange(1, max(2, len(base) // 12))):
                at = rng.randrange(len(edited))
                what = rng.randrange(3)
                if what == 0:
                    edited[at] = rng.choice(vocabulary)
                elif what == 1:
                    edited.insert(at, rng.choice(vocabulary))
                else:
                    del edited[at]
            rows.append(edited)
        if k % 5 == 0:  # parts in another order, another layout, and exact copies
            cut = len(base) // 2
            rows.append(base[cut:] + base[:cut])
            rows.append([w.upper() for w in base])
            rows += [base] * 3
    out = [(i, (" ", ", ", "\n")[i % 3].join(w)) for i, w in enumerate(rows)]
    out += [(9001, None), (9002, ""), (9003, " \n "), (9004, "short text"), (None, out[0][1]), out[3], out[3]]
    out.append((9005, "same words " * 20_000))
    return out


@pytest.fixture(scope="module")
def table(spark, corpus):
    return spark.createDataFrame([(i, t, "C", "other", 5, 6, 7, "z") for i, t in corpus], TEXT)


@pytest.fixture(scope="module")
def splits(spark, corpus):
    names = ["train", " Train ", "validation", "TEST", None, "holdout"]
    rows = [(i, names[i % 6], f"s{i % 3}") for i, _ in corpus if i is not None]
    return spark.createDataFrame(rows + rows[:5], "resume_id long, split string, source string")


def pairs(df, *columns):
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_near_duplicates_equal_brute_force(table, corpus):
    similar, same = brute(set(corpus))
    assert pairs(neardup.near_duplicates(table), "id_a", "id_b") == similar - same and similar - same


def test_links_count_classes(table, corpus):
    """One row a record; links are the other classes whose representative is similar, counted by brute force."""
    rows = {r.id: r for r in neardup.near_duplicate_links(table).collect()}
    texts = {i: re.findall(r"[^\W_]+", t.lower()) for i, t in set(corpus) if i is not None and t and len(re.findall(r"[^\W_]+", t)) >= 30}
    assert set(rows) == set(texts)
    classes = {}
    for i in sorted(texts):
        w = texts[i]
        key = (frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)), tuple(sorted(w)))
        classes.setdefault(key, []).append(i)
    rep = {i: members[0] for members in classes.values() for i in members}
    sets = {members[0]: shingles for (shingles, _), members in classes.items()}
    links = dict.fromkeys(sets, 0)
    for a, b in combinations(sorted(sets), 2):
        if 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
    assert {i: (r.class_id, r.links) for i, r in rows.items()} == {i: (rep[i], links[rep[i]]) for i in rep}
    assert sum(links.values()) > 20


@pytest.mark.parametrize("hot", [overlap.HOT, 4, 1])
def test_overlaps_equal_brute_force(table, splits, corpus, hot):
    of = {r.resume_id: (r.split or "").strip().lower() for r in splits.collect()}
    similar, same = brute(set(corpus))
    cross = {p for p in similar | same if {of.get(p[0]), of.get(p[1])} in ({"train", "validation"}, {"train", "test"})}
    found = overlap.overlaps(table, splits, hot=hot)
    assert pairs(found, "id_a", "id_b") == cross and cross
    assert all(0 < r.coverage <= 1 and r.similarity >= 0.7 for r in found.collect())
    report = overlap.overlap_report(table, splits).collect()
    assert sum(r.pairs for r in report) == len(cross) and {r.split for r in report} <= {"validation", "test"}


@pytest.mark.parametrize("options", [{}, {"hot": 1}, {"hot": 2, "salts": 3}, {"hot": 1, "hot_keys": 0}])
def test_copies_equal_brute_force(table, corpus, options):
    _, same = brute(set(corpus))
    group = {}
    for a, b in sorted(same):
        group[b] = min(group.get(b, a), a)
    got = pairs(copies.hidden_copies(table, **options), "keep_id", "copy_id")
    assert got == {(a, b) for b, a in group.items()} and got
    counts = {r.keep_id: r.copies for r in copies.copy_counts(table, **options).collect()}
    assert sum(counts.values()) == len({i for i, t in corpus if i is not None and len(re.findall(r"[^\W_]+", t or "")) >= 30})


def test_hot_keys_take_the_salted_way(spark):
    many = " ".join(f"w{k}" for k in range(40))
    df = spark.range(4000).selectExpr("id", f"CASE WHEN id % 3 < 2 THEN '{many}' ELSE concat('{many} x', id) END AS resume_str")
    got = copies.hidden_copies(df, hot=1000).groupBy("keep_id").count().collect()
    assert [(r.keep_id, r["count"]) for r in got] == [(0, 2666)]


def test_a_paragraph_shared_by_most_records(spark):
    """The paragraph's fingerprints are hot; the records are similar only where the rest is."""
    rng = random.Random(5)
    common = " ".join(f"c{k}" for k in range(40))
    rows = [(k, common + " " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(40))) for k in range(60)]
    rows += [(100 + k, rows[k][1] + " tail") for k in range(10)]
    df = spark.createDataFrame([(i, t, "C", "o", 1, 1, 1, "z") for i, t in rows], TEXT)
    splits = spark.createDataFrame([(i, "train" if i < 100 else "test", "s") for i, _ in rows], "resume_id long, split string, source string")
    assert pairs(overlap.overlaps(df, splits, hot=30), "id_a", "id_b") == {(k, 100 + k) for k in range(10)}
    assert pairs(neardup.near_duplicates(df), "id_a", "id_b") == {(k, 100 + k) for k in range(10)}


def revisions(seed=11, clusters=3, size=25):
    """Clusters of light revisions, which follow one leader, clusters that are similar to each other, and copies."""
    rng = random.Random(seed)
    rows = []
    for _ in range(clusters):
        base = [f"w{rng.randrange(3000)}" for _ in range(320)]
        for shift in (0, 1, 2):  # three leaders that differ in a tenth of the words
            own = [w if rng.random() > 0.012 * shift else f"v{rng.randrange(10**6)}" for w in base]
            for _ in range(size):
                light = list(own)
                for _ in range(rng.randrange(3)):
                    light[rng.randrange(len(light))] = f"u{rng.randrange(10**6)}"
                rows.append(light)
    rng.shuffle(rows)
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


@pytest.mark.parametrize("longest", [20_000, 3])
def test_clusters_of_revisions_and_lists_in_parts(spark, monkeypatch, longest):
    """Followers derive their answers; lists longer than the bound are cut into parts that meet pairwise."""
    from scrivane.llm import signatures

    monkeypatch.setattr(signatures, "LIST", longest)
    rows = revisions()
    df = spark.createDataFrame([(i, t, "C", "o", 1, 1, 1, "z") for i, t in rows], TEXT)
    similar, same = brute(rows)
    assert pairs(neardup.near_duplicates(df), "id_a", "id_b") == similar - same and len(similar) > 1000
    r = neardup.relations(signatures.texts(df, "id", "resume_str"), Jaccard())
    assert r.followers.where("rep <> leader").count() > 10
    links = {x.id: (x.class_id, x.links) for x in neardup.near_duplicate_links(df).collect()}
    reps = {c for c, _ in links.values()}
    want = {c: sum(1 for p in similar if c in p and set(p) <= reps) for c in reps}
    assert {c: n for c, n in links.values()} == want
    splits = spark.createDataFrame([(i, "train" if i % 3 else "test", "s") for i, _ in rows], "resume_id long, split string, source string")
    cross = {p for p in similar | same if (p[0] % 3 == 0) != (p[1] % 3 == 0)}
    assert pairs(overlap.overlaps(df, splits), "id_a", "id_b") == cross
    held = {x.id: x.pairs for x in overlap.overlap_records(df, splits).collect()}
    assert held == {i: sum(i in p for p in cross) for i, _ in rows if i % 3 == 0 and any(i in p for p in cross)}


def test_buckets_are_dealt_evenly(spark):
    from pyspark.sql import functions as F

    from scrivane.llm.blocks import labels_for

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    labels = labels_for(spark, 3 * partitions).tolist()
    assert len(set(labels)) == 3 * partitions and labels_for(spark, 17 * partitions) is None
    rows = spark.createDataFrame([(k,) for k in labels], "k int").groupBy(F.pmod(F.hash("k"), F.lit(partitions))).count().collect()
    assert [r["count"] for r in rows] == [3] * partitions


def test_lowered_threshold_covers_followers():
    sim = Jaccard()
    low = neardup.lowered(sim)
    for n in range(30, 400, 7):
        d = int(neardup.DIFFER * n)
        for m in (n, int(n * 1.2), int(n / 0.75)):
            e = int(neardup.DIFFER * m)
            # followers of n - d .. n + d and m - e .. m + e shingles whose overlap is the least that is similar
            for a, b in ((n + d, m + e), (n - d, m - e), (n + d, m - e)):
                leaders = sim.overlap(a + b) - max(a - n, 0) - max(b - m, 0)
                assert low.holds(leaders, n, m) or leaders > min(n, m)


def test_frequencies_estimate_hot_values_at_any_load(spark):
    from scrivane.llm.words import Frequencies, _LEVELS

    rng = np.random.default_rng(1)
    counts = rng.poisson(40_000, 1 << 12)
    counts[7] += 50_000
    f = Frequencies(np.searchsorted(_LEVELS, counts).astype(np.uint8))
    value = np.array([7, 8], dtype=np.uint64) << np.uint64(52)
    hot, plain = f.excess(value).tolist()
    assert hot > 40_000 and plain <= overlap.HOT


def test_empty_tables(spark, table, splits):
    none = table.where("false")
    assert neardup.near_duplicates(none).collect() == [] and copies.hidden_copies(none).collect() == []
    assert overlap.overlaps(none, splits).collect() == [] and overlap.overlaps(table, splits.where("false")).collect() == []


@given(st.text(max_size=200))
@settings(max_examples=200, deadline=None)
def test_word_hashes_follow_the_definition(text):
    import xxhash

    assert words.word_hashes(text).tolist() == [xxhash.xxh64_intdigest(w) for w in words.words(text)]


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**63)), min_size=1, max_size=60), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_winnowing_takes_the_least_of_every_window(grams, window):
    count, hashes = np.array([c for c, _ in grams]), np.array([h for _, h in grams], dtype=np.uint64)
    key = [(c, h >> 44) for c, h in grams]
    size = min(window, len(key))
    want = sorted({min(range(s, s + size), key=lambda q: (key[q], -q)) for s in range(len(key) - size + 1)})
    assert overlap.winnow(count, hashes, window).tolist() == want


@given(st.integers(1, 400), st.integers(1, 400), st.integers(0, 400))
def test_bounds_never_lose_a_pair(na, nb, inter):
    sim = Jaccard()
    inter = min(inter, na, nb)
    if sim.holds(inter, na, nb):
        assert inter >= sim.overlap(na + nb) and sim.least(na) <= nb <= sim.most(na)
        o = sim.overlap(na + nb)
        assert sim.prefix(na) >= na - o + sim.shared(o) or o < sim.shared(o)


def test_chain_and_alignment():
    a = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], dtype=np.uint64)
    b = np.array([0, 2, 3, 4, 5, 99, 7, 8, 9, 10], dtype=np.uint64)
    assert overlap.chain(np.array([[5, 0], [1, 1], [6, 6], [2, 3], [9, 2]])).tolist() == [[1, 1], [2, 3], [6, 6]]
    assert overlap.aligned_words(a, b, np.array([[2, 2], [7, 7]])) == 8
