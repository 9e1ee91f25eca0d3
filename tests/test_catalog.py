"""Title matching, id dedupe, subtitle selection."""

from reelrank.operators import catalog as ct


def test_title_match_statuses(spark):
    titles = spark.createDataFrame(
        [("1", 2001, "Foo", False), ("2", 2002, "Bar", False), ("3", 2003, "Baz", False),
         ("4", None, "Bad", True), ("5", 2001, "  FOO ", False)],
        "netflix_id string, year int, title string, malformed boolean")
    cat = spark.createDataFrame(
        [("0000010", 2001, "foo"), ("0000020", 2002, "Bar"), ("0000021", 2002, "bar"),
         ("0000030", 1999, "Baz")], "imdb_id string, year int, title string")
    got = {r.netflix_id: (r.status, r.imdb_ids) for r in ct.title_match(titles, cat).collect()}
    assert got == {"1": ("matched", "0000010"), "2": ("conflict", "0000020/0000021"),
                   "3": ("no_match", None), "4": ("malformed", None), "5": ("matched", "0000010")}
    summary = {r.status: r.n for r in ct.title_match_summary(ct.title_match(titles, cat)).collect()}
    assert summary == {"matched": 2, "conflict": 1, "no_match": 1, "malformed": 1, "lines": 5}


def test_unique_ids_drop_repeats_and_sort_by_length(spark):
    ids = spark.createDataFrame([(x,) for x in ["30", "4", "30", "100", "21", "5"]], "imdb_id string")
    got = [(r.rank, r.imdb_id) for r in ct.unique_ids(ids).orderBy("rank").collect()]
    assert got == [(1, "4"), (2, "5"), (3, "21"), (4, "100")]
    b = ct.id_batches(ct.unique_ids(ids), 3).orderBy("rank").collect()
    assert [r.batch for r in b] == [0, 0, 0, 1]


def test_best_subtitles_rules(spark):
    rows = [
        # movie 1: set 11 has sum_cd 1 (complete) -> chosen over set 10 (sum_cd 2)
        ("1", 10, "f1", "l1", "srt", 2), ("1", 10, "f2", "l2", "srt", 2),
        ("1", 11, "f3", "l3", "srt", 1),
        # movie 2: best set (sum_cd 2) incomplete -> movie dropped, no fallback
        ("2", 20, "g1", "m1", "srt", 2), ("2", 21, "g2", "m2", "srt", 3),
        # movie 3: only non-srt
        ("3", 30, "h1", "n1", "sub", 1),
        # movie 4: sum_cd 10 vs 9 compared as integers
        ("4", 40, "k1", "o1", "srt", 10), ("4", 41, "k2", "o2", "srt", 9),
    ]
    subs = spark.createDataFrame(rows, "movie_id string, sub_id long, file_id string, link string, "
                                       "sub_format string, sum_cd int")
    got = sorted((r.movie_id, r.sub_id, r.pos, r.file_id) for r in ct.best_subtitles(subs).collect())
    assert got == [("1", 11, 1, "f3")]


def test_subs_requested_strips_zeros(spark):
    subs = spark.createDataFrame([("123", 1), ("9", 2)], "movie_id string, sub_id long")
    req = spark.createDataFrame([("0000123",)], "imdb_id string")
    assert [r.sub_id for r in ct.subs_requested(subs, req).collect()] == [1]


def test_file_names(spark):
    df = spark.createDataFrame([("http://x/y/abc.gz",)], "link string")
    assert ct.file_names(df).first().file_name == "abc.srt"


def test_title_match_fuzzy(spark):
    titles = spark.createDataFrame(
        [("1", 1977, "Star War", False), ("2", 1977, "Star Wrs", False), ("3", 1980, "Star Wars", False),
         ("4", 1999, "Matrix", False), ("5", 1999, "Zzz", False), ("6", None, "x", True)],
        "netflix_id string, year int, title string, malformed boolean")
    cat = spark.createDataFrame(
        [("0076759", 1977, "Star Wars"), ("0080684", 1980, "Star Wars: Episode V"),
         ("0133093", 1999, "The Matrix"), ("0999999", 1999, "Matrix!")],
        "imdb_id string, year int, title string")
    got = {r.netflix_id: (r.status, r.imdb_ids) for r in ct.title_match_fuzzy(titles, cat, 1).collect()}
    assert got == {"1": ("matched", "0076759"), "2": ("matched", "0076759"),
                   "3": ("no_match", None), "4": ("matched", "0999999"),
                   "5": ("no_match", None), "6": ("malformed", None)}
    got2 = {r.netflix_id: r.imdb_ids for r in ct.title_match_fuzzy(titles, cat, 4).collect()}
    assert got2["4"] == "0133093/0999999"


def test_deletion_variants(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("abc",)], "s string")
    v = df.select(ct.deletion_variants(F.col("s"), 2).alias("v")).first().v
    assert sorted(v) == sorted(["abc", "bc", "ac", "ab", "c", "b", "a"])


def test_fuzzy_segments_find_every_pair(spark):
    """Against every pair: short, long, empty and non-ASCII titles, edits of every kind."""
    import random

    rng = random.Random(6)

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, prev = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        return row[-1]

    def edit(t):
        t = list(t)
        for _ in range(rng.randint(0, 3)):
            at, kind = rng.randint(0, len(t)), rng.randint(0, 2)
            t[at:at + (kind > 0)] = [] if kind == 1 else [rng.choice("abé")]
        return "".join(t)

    base = ["", "a", "ab", "abc", "aaaa", "abab", "éèab"] + ["".join(rng.choices("abé", k=rng.randint(4, 30))) for _ in range(12)]
    cat = [(f"{i:03d}", 2000 + i % 2, t) for i, t in enumerate(base + [edit(t) for t in base * 3])]
    asked = [(str(i), 2000 + i % 2, edit(rng.choice(base)), False) for i in range(80)]
    c = spark.createDataFrame(cat, "imdb_id string, year int, title string")
    t = spark.createDataFrame(asked, "netflix_id string, year int, title string, malformed boolean")
    for k in (1, 2, 3):
        got = {r.netflix_id: r.imdb_ids for r in ct.title_match_fuzzy(t, c, k).collect()}
        want = {n: "/".join(sorted(i for i, yy, tt in cat if yy == y and lev(title, tt) <= k)) or None for n, y, title, _ in asked}
        assert got == want


def test_fuzzy_keys_do_not_grow_with_the_title(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("x" * 30 + "abcdefghij" * n,) for n in (1, 9, 90)], "t string")
    n = [r.n for r in df.select(F.size(ct.probe_segments(F.col("t"), 2)).alias("n")).collect()]
    assert max(n) <= 5 * 3 * 5


def test_long_id_lists_are_not_written_once_a_row(spark, tmp_path):
    """Titles of one key lie together in the files, so their list of ids costs little more than one row's."""
    from pyspark.sql import functions as F

    from reelrank.sinks import formats as fm

    cat = spark.range(4000).select(F.sha2(F.col("id").cast("string"), 256).alias("imdb_id"), F.lit(2000).alias("year"),
                                   F.concat(F.lit("t"), F.col("id") % 100).alias("title"))
    titles = spark.range(4000).select(F.col("id").cast("string").alias("netflix_id"), F.lit(2000).alias("year"),
                                      F.concat(F.lit("T"), F.col("id") % 100).alias("title"), F.lit(False).alias("malformed"))
    m = ct.title_match(titles, cat)
    assert m.count() == 4000 and m.where("status = 'conflict' and length(imdb_ids) = 40 * 65 - 1").count() == 4000
    spark.conf.set("spark.sql.files.minPartitionNum", "4")
    try:
        fm.write_matches(ct.title_match(titles, cat), str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    size = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert size < 8 * 100 * 40 * 65   # 4000 rows hold 40 times what the 100 keys do
