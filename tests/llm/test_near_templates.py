"""Pages of one template: unlike ones in common buckets, without a round for each."""

from __future__ import annotations

import random

from sitesmith.llm import simhash


def test_prefix_pairs_hold_all_like_pairs(spark):
    """Against all pairs, for sets of all sizes, also just at the similarity, and with groups whose members need not meet."""
    rng = random.Random(4)
    sets = []
    for size in [1, 2, 3, 4, 5, 9, 10, 18, 36, 45, 90, 180]:
        base = [rng.randrange(10**12) for _ in range(size)]
        for part in (1.0, 0.8, 0.9, 0.85, 0.7):
            kept = base[: max(1, round(size * part))]
            sets.append(frozenset(kept))
            sets.append(frozenset(kept + [rng.randrange(10**12) for _ in range(round(size * 0.1))]))
        swap = round(size / 9)
        sets.append(frozenset(base[swap:] + [rng.randrange(10**12) for _ in range(swap)]))
    frame = list(range(200))
    sets += [frozenset(frame + [10**6 * (i + 1) + j for j in range(40)]) for i in range(50)]  # 200 / 280 in common
    rows = [(i, i if i % 7 else -1, len(x), h) for i, x in enumerate(sets) for h in x]
    got = [tuple(r) for r in simhash.prefix_pairs(spark.createDataFrame(rows, "node long, g long, n long, h long")).collect()]
    like = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and (i % 7 or j % 7)}
    first = len(sets) - 50
    assert like <= set(got) and len(got) == len(set(got)) and len(like) > 100
    assert not [p for p in got if p[0] >= first]
    assert simhash.prefix_pairs(spark.createDataFrame([], "node long, g long, n long, h long")).count() == 0


def pages(n: int):
    rng = random.Random(n)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    frame, out = [word() for _ in range(250)], []
    for i in range(n):
        out.append(frame + [word() for _ in range(50)])
        if i % 10 == 0:  # a near copy
            out.append([*out[-1][:-1], word()])
    return [(i, " ".join(x)) for i, x in enumerate(out)]


def test_template_pages_take_no_round_each(spark):
    """Pages that share 250 words and have 50 of their own stay apart, copies of them are found, and the jobs are as many for fifty times the pages."""
    sc, jobs = spark.sparkContext, {}
    for n in (20, 1000):
        rows = pages(n)
        sc.setJobGroup(f"pages-{n}", "pages")
        got = {r["doc_id"]: r["component"] for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component").collect()}
        jobs[n] = len(sc.statusTracker().getJobIdsForGroup(f"pages-{n}"))
        assert len(set(got.values())) == n
        assert all(got[i] == got[i + 1] for i in range(0, len(rows), 11))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1000] < 2 * jobs[20]


def test_groups_of_a_bucket_that_meet_in_their_midst(spark):
    """Two groups in one bucket that a single pair links, neither end of which is first or last in its group by number or by another order."""
    texts = {}
    inner = lambda x, group: all(min(f(y) for y in group) < f(x) < max(f(y) for y in group) for f in (lambda v: v, lambda v: v ^ 0x2545F4914F6CDD1D))
    for seed in range(500):
        rng = random.Random(seed)
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)).encode() for _ in range(400)]
        ids = {o: simhash.text_key(words[o : o + 204]) for o in (*range(90, 98), 110, 125, *range(138, 146))}
        low, high = ([i for o, i in ids.items() if (o < 120) == side] for side in (True, False))
        if inner(ids[110], low) and inner(ids[125], high):
            texts = {i: b" ".join(words[o : o + 204]).decode() for o, i in ids.items()}
            break
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "mark long, text string").selectExpr("mark", "cast(text as binary) text")
    nodes = spark.createDataFrame([(i, i, 0, 0 if i in low else 7) for i in texts], "node long, mark long, t0 long, t1 long")
    links = {frozenset(r) for r in simhash.near_links(docs, nodes, 2, 16).collect()}
    assert frozenset((ids[110], ids[125])) in links


def test_small_buckets_make_no_row_a_shingle(spark, monkeypatch):
    """All of a bucket of up to PAIRED members are compared as they are, though they are several groups."""
    monkeypatch.setattr(simhash, "prefix_pairs", lambda *_: 1 / 0)
    texts = {simhash.text_key(t.encode().split()): t for _, t in pages(simhash.PAIRED - 5) + pages(3)}
    assert len(texts) == simhash.PAIRED + 1
    out = min(texts)  # in a bucket of its own, so that the other holds PAIRED
    docs = spark.createDataFrame(list(texts.items()), "mark long, text string").selectExpr("mark", "cast(text as binary) text")
    nodes = spark.createDataFrame([(i, i, 2**12 - 1 if i == out else 0) for i in texts], "node long, mark long, t0 long")
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items() if i != out}
    like = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert like and {tuple(r) for r in simhash.near_links(docs, nodes, 1, 16).collect()} == like


def test_members_of_large_buckets_are_looked_up_by_number(spark):
    """Near copies of one number meet once each in the large buckets of its variants, whatever the tables and batches of them."""
    texts = {simhash.text_key(t.encode().split()): t for _, t in pages(60)}
    docs = spark.createDataFrame(list(texts.items()), "mark long, text string").selectExpr("mark", "cast(text as binary) text")
    nodes = spark.createDataFrame([(i, i, 0, 0) for i in texts], "node long, mark long, t0 long, t1 long")
    nums = simhash.numbers(nodes, range(2))
    assert nums.count() == 2 * len(texts) and simhash.flipped(nums.select("num").distinct(), 16).count() == 2 * 17
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    like = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    want = None
    for sent, at_once in ((500_000, 140), (0, 17)):
        simhash_limits = (simhash.SENT_NODES, simhash.NODE_VARIANTS)
        simhash.SENT_NODES, simhash.NODE_VARIANTS = sent, at_once
        try:
            got = {tuple(r) for r in simhash.near_links(docs, nodes, 2, 16).collect()}
        finally:
            simhash.SENT_NODES, simhash.NODE_VARIANTS = simhash_limits
        assert got == (got if want is None else want) and got <= like
        want = got
    whole = lambda links: {frozenset(c) for c in _components(links)}
    assert want and whole(want) == whole(like)


def _components(links):
    at = {}
    for u, v in links:
        a, b = at.get(u, {u}), at.get(v, {v})
        if a is not b:
            a |= b
            at |= dict.fromkeys(a, a)
    return {id(x): x for x in at.values()}.values()
