"""Sharding, mixing and line dedup on small inputs with odd rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from reelrank.llm import linededup, mixing, sharding

SCHEMA = "doc_id long, text string, source string, size string, shard string"
ODD = [(None, None, None, "x", "y"), (1, "", "a", "x", "y"), (1, "", "a", "x", "y"),
       (2, "w " * 5000, "b", None, None), (3, "one two", "b", "x", "y"), (4, "   ", "c", "x", "y")]


def test_rendezvous_moves_only_into_the_new_shard(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    rows = sharding.shard_records(df, "doc_id", [1.0, 1.0, 2.0]).collect()
    assert all(r.grown_shard in (r.shard, 3) for r in rows)
    n = Counter(r.shard for r in rows)
    assert abs(n[2] - 2000) < 200 and abs(n[0] - 1000) < 200
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    again = {r.doc_id: r.shard for r in sharding.shard_records(df.repartition(7), "doc_id", [1.0, 1.0, 2.0, 2.0]).collect()}
    assert all(again[r.doc_id] == r.grown_shard for r in rows)


def test_sharding_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    rows = sharding.shard_records(df, "doc_id", [1.0] * 8).collect()
    assert len(rows) == len(ODD) and all(isinstance(r.shard, int) for r in rows)
    assert sharding.shard_records(df.limit(0), "doc_id", [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("doc_id"), [])


def _fill(sizes, weights, budget, cap):
    target, open_ = {}, set(sizes)
    while True:
        rest, w = budget - sum(target.values()), sum(weights[s] for s in open_)
        over = [s for s in open_ if weights[s] * rest / w > cap * sizes[s]]
        if not over:
            return target | {s: weights[s] * rest / w for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            open_.remove(s)


def test_water_filling_against_plain_rounds(spark):
    sizes = {"a": 10, "b": 500, "c": 40, "d": 7, "e": 90}
    weights = dict(zip(sizes, (3, 1, 2, 3, 1)))
    src = spark.createDataFrame([(s, n, weights[s]) for s, n in sizes.items()], "_rr_src string, size long, weight int")
    budget = 1.5 * sum(sizes.values())
    got = {r["_rr_src"]: r.target for r in mixing.water_fill(src, budget, 2.0).collect()}
    want = _fill(sizes, weights, budget, 2.0)
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(budget)
    all_capped = mixing.water_fill(src, 1e9, 2.0).collect()
    assert all(r.target == 2 * r.size for r in all_capped)


def test_mix_takes_near_the_target(spark):
    rows = [(i, "w " * (1 + i % 13), f"s{0 if i % 3 else i % 5}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kw = dict(source="source", size=mixing.word_count(F.col("text")), key="doc_id")
    out = mixing.plan_mix(df, **kw).collect()
    for s in {r.source for r in out}:
        mine = [r for r in out if r.source == s]
        assert abs(sum(r.reps * r.size for r in mine) - mine[0].target) <= 7
        assert mine[0].source_size == sum(r.size for r in mine) and max(r.reps for r in mine) <= 2
    again = {r.doc_id: r.reps for r in mixing.plan_mix(df.repartition(5), **kw).collect()}
    assert again == {r.doc_id: r.reps for r in out}
    taken = Counter(r.doc_id for r in mixing.mix(df, **kw).collect())
    assert taken == Counter({r.doc_id: r.reps for r in out if r.reps})


def test_mix_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    kw = dict(source="source", size=mixing.word_count(F.col("text")), key="doc_id")
    out = mixing.plan_mix(df, **kw).collect()
    assert len(out) == len(ODD) and {r.size for r in out} == {0, 2, 5000}
    assert mixing.mix(df, **kw).columns == df.columns
    mixing.mix(df, **kw).collect()
    assert mixing.plan_mix(df.limit(0), **kw).count() == 0


def _jaccard(a, b, k=linededup.SHINGLE):
    sa, sb = ({x[i:i + k] for i in range(max(1, len(x) - k + 1))} for x in (a, b))
    return len(sa & sb) / len(sa | sb)


def _brute(docs):
    """Kept (doc, position) pairs: brute force over all lines."""
    occ = sorted((d, p, x) for d, t in docs for p, x in enumerate(t.split("\n")) if x.strip(" "))
    lines = sorted({x for *_, x in occ})
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            if _jaccard(a, b) >= 0.8:
                root[find(a)] = find(b)
    first = {}
    for d, p, x in occ:
        first.setdefault(find(x), (d, p))
    return set(first.values())


def _corpus():
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    base = [" ".join(word() for _ in range(rng.randint(15, 60))) for _ in range(60)]
    docs = []
    for d in range(70):
        lines = []
        for _ in range(rng.randint(1, 6)):
            w = rng.choice(base).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = word()
            lines.append(" ".join(w))
        docs.append((d, "\n".join(lines)))
    # a chain of lines that drift apart, so that the centre links only some
    chain = base[0].split() + base[1].split()
    for d in range(100, 112):
        chain[(d - 100) * 3] = word()
        docs.append((d, " ".join(chain) + "\n\nTerms: é ü ß " * 3))
    return docs


def test_line_dedup_against_brute_force(spark):
    docs = _corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = linededup.line_decisions(df, "doc_id", "text").collect()
    text = dict(docs)
    kept = {(r.doc_id, p) for r in got for p, x in enumerate(text[r.doc_id].split("\n")) if x.strip(" ") and p not in r.removed}
    assert kept == _brute(docs)
    out = {r.doc_id: r.text for r in linededup.dedup_lines(df, "doc_id", "text").collect()}
    for r in got:
        left = "\n".join(x for p, x in enumerate(text[r.doc_id].split("\n")) if p not in r.removed)
        assert out.get(r.doc_id) == (left if r.n_kept else None)


def test_line_dedup_odd_rows(spark):
    df = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (2, "same\nsame", None), (2, "same\nsame", None), (3, "same", "x"),
                                (4, "long " * 20000, "x"), (5, "\n \n", "x")], "doc_id long, text string, n_lines string")
    out = {(r.doc_id, r.text) for r in linededup.dedup_lines(df, "doc_id", "text").collect()}
    assert out == {(None, None), (1, ""), (2, "same"), (4, "long " * 20000), (5, "\n \n")}
    assert linededup.dedup_lines(df, "doc_id", "text").columns == df.columns
    assert linededup.dedup_lines(df.limit(0), "doc_id", "text").count() == 0


def test_shingle_sets_hold_every_shingle(spark):
    lines = ["é" * 3, "abcdefgh", "x".join(map(str, range(300)))]
    df = spark.createDataFrame([(x,) for x in lines], "l string")
    sizes = [r[0] for r in df.select(F.size(linededup.shingle_set(F.col("l")))).collect()]
    assert sizes == [len({x[i:i + 8] for i in range(max(1, len(x) - 7))}) for x in lines]


def test_lines_of_few_shingles_repeated_are_compared(spark):
    lines = ["Onaterth Onion " * 500, "Onaterth Onion " * 501, "Tion " * 1200, "Tion " * 1201 + "Tio", "ab" * 9000, "short"]
    lines += [" ".join(f"{i}w{j}" for j in range(300)) for i in range(4)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    found = linededup.lines_of(df, "doc_id", "text")
    assert linededup.signatures(found, linededup.SHINGLE, 27).count() == len(lines)
    out = sorted(r.doc_id for r in linededup.dedup_lines(df, "doc_id", "text").collect())
    assert out == [0, 2, 4, 5, 6, 7, 8, 9]


def test_signatures_depend_on_the_shingle_set_alone(spark):
    import random

    rng = random.Random(12)
    base = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(200)).replace("  ", "a ") for _ in range(40)]
    base = [x.strip().ljust(200, "z") for x in base]
    # a period repeated has the same shingles however often, with its first characters behind it
    lines = [(i, k, x * k + x[:7]) for i, x in enumerate(base) for k in (1, 2, 3, 4)]
    df = spark.createDataFrame([(i * 10 + k, x) for i, k, x in lines], "doc_id long, text string")
    found = linededup.lines_of(df, "doc_id", "text")
    sig = {r["_rr_h"]: tuple(r["_rr_m"]) for r in linededup.signatures(found, linededup.SHINGLE, 27).collect()}
    of = {r["_rr_id"]: sig[r["_rr_h"]] for r in found.collect()}
    assert all(of[i * 10 + k] == of[i * 10 + 1] for i, k, _ in lines)
    # repeated, and a few characters changed: one line of each is kept
    docs = [(i * 10 + k, x * k + (x[:7] if k == 1 else x[:7] + "#!" * k)) for i, x in enumerate(base) for k in (1, 2, 3, 4)]
    out = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()
    assert {(r.doc_id, 0) for r in out} == _brute(docs) == {(i * 10 + 1, 0) for i in range(40)}


def test_short_lines_against_brute_force(spark):
    lines = [f"Chapter {i}" for i in range(100, 140)] + [f"Page {i} of {j}" for i in range(10, 16) for j in range(60, 66)]
    lines += [f"Section {i}.{j}" for i in range(1, 9) for j in range(10, 15)]
    docs = [(i, x) for i, x in enumerate(lines)] + [(1000 + i, f"{x}.") for i, x in enumerate(lines)]
    assert {len(x) for _, x in docs} <= set(range(9, 21))
    out = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()
    assert {(r.doc_id, 0) for r in out} == _brute(docs)


def test_filter_of_hashes_lets_few_others_pass(spark):
    """Many more hashes than one slot each could tell apart: what passes is the wanted ones and few others."""
    rows = spark.range(400000).select(F.xxhash64("id").alias("h"), "id")
    wanted = rows.where("id < 100000").select(F.col("h").alias("w"))
    got = linededup.only_hashes(rows, "h", wanted, "w")
    assert got.where("id < 100000").count() == 100000
    # one bit in 2**25 each; with 2**20 slots some 27,000 others pass
    assert got.where("id >= 100000").count() < 3000


def test_near_copies_meet_a_few_members_before_all_pairs(spark, monkeypatch):
    """A large bucket of near copies: few pairs are left after its pivots, and the components are those of all pairs."""
    import random

    rng = random.Random(5)
    base = [rng.choice("etaoin") + "".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(60)]
    lines = []
    for _ in range(200):
        words = list(base)
        for _ in range(rng.choice((1, 2, 2, 3))):
            words[rng.randrange(60)] = f"x{rng.randrange(10 ** 6)}"
        lines.append(" ".join(words))
    docs = list(enumerate(lines))
    left, plain = [], linededup._open_pairs
    monkeypatch.setattr(linededup, "_open_pairs", lambda *a: left.append(plain(*a)) or left[-1])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = linededup.lines_of(df, "doc_id", "text")
    with_pivots = {tuple(r) for r in linededup.line_components(found).collect()}
    monkeypatch.setattr(linededup, "TURNS", 0)
    assert with_pivots == {tuple(r) for r in linededup.line_components(found).collect()}
    some, every = (x.count() for x in left)
    assert 0 < every and some < 0.75 * every, (some, every)


def test_bit_sets_are_written_for_members_of_busy_centres_only(spark, monkeypatch):
    """Of 200 members only those of a centre with an unlinked one and two components keep their bit sets."""
    words = [f"_rr_{k}{w}" for k in "dm" for w in range(linededup.WORDS)]
    star = [(1000 + i, i // 4, 0.9 if i % 4 or i < 100 else 0.5) for i in range(200)]
    # the members of centres below 40 are one component each, of the others each is its own
    roots = [(h, c) for h, c, _ in star if c < 40]
    df = spark.createDataFrame(star, "_rr_h long, _rr_center long, j double").select(
        "*", *[F.lit(5).cast("long").alias(c) for c in words], F.lit(9).alias("_rr_i"), F.lit(10).alias("_rr_n"))
    written, plain = [], linededup.C.materialize
    monkeypatch.setattr(linededup.C, "materialize", lambda d: written.append(plain(d)) or written[-1])
    busy = linededup._busy(df, spark.createDataFrame(roots, "node long, root long"), 0.8)
    got = {(r["_rr_h"], r["_rr_center"], r["root"], r["j"], r["_rr_nb"], r["_rr_d0"]) for r in busy.collect()}
    assert got == {(h, c, h, j, 1, 5) for h, c, j in star if c >= 40}
    assert all(d.count() <= 40 for d in written if "_rr_d0" in d.columns)
