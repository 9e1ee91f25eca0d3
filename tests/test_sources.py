"""Line sources, carry-forward and the text-format parsers."""

import gzip
import os

from pyspark.sql import functions as F

from reelrank.sinks import formats as fm
from reelrank.sources import lines as ln
from reelrank.sources import parsers as ps


def _lines(spark, rows):
    return spark.createDataFrame(rows, "source string, line_no long, value string")


def test_number_lines_dense_per_source(spark):
    rows = [(s, k) for s in ("a", "b", "c") for k in range(0, 300, 3)]
    df = spark.createDataFrame(rows, "source string, k long")
    out = ln.number_lines(df, ["k"], partitions=7).collect()
    for s in ("a", "b", "c"):
        got = sorted((r.k, r.line_no) for r in out if r.source == s)
        assert [n for _, n in got] == list(range(1, 101))


def test_carry_forward_across_blocks(spark):
    vals = ["h1:", "a", "b", "c", "d", "h2:", "e", "f", "g", "h", "i", "j"]
    df = _lines(spark, [("f", i + 1, v) for i, v in enumerate(vals)] + [("g", 1, "x"), ("g", 2, "h3:"), ("g", 3, "y")])
    out = ln.carry_forward(df, F.when(F.col("value").endswith(":"), F.col("value")), block=2)
    got = {(r.source, r.value): r.header for r in out.collect()}
    assert got[("f", "d")] == "h1:" and got[("f", "j")] == "h2:"
    assert got[("g", "x")] is None and got[("g", "y")] == "h3:"


def test_test_set_round_trip(spark):
    t = spark.createDataFrame([(5, 2), (5, 1), (3, 9)], "movie_id long, user_id long")
    lines = fm.test_set_lines(t)
    assert [r.value for r in lines.orderBy("line_no").collect()] == ["3:", "9", "5:", "1", "2"]
    back = ps.test_set_parse(lines)
    assert sorted(tuple(r) for r in back.collect()) == [("3", "9"), ("5", "1"), ("5", "2")]


def test_read_lines_encodings_and_gzip(spark, tmp_dir):
    p = os.path.join(tmp_dir, "in")
    os.makedirs(p)
    with open(os.path.join(p, "a.txt"), "wb") as f:
        f.write("12:\r\n1,5,2005-01-01\r\nJos\xe9,3,2005-01-02\r\n".encode("iso-8859-1"))
    with gzip.open(os.path.join(p, "b.txt.gz"), "wb") as f:
        f.write("7:\n2,4,2004-01-01\n".encode("iso-8859-1"))
    lines = ln.read_lines(spark, p, encoding="ISO-8859-1")
    r = ps.ratings_from_blocks(lines).collect()
    got = sorted((x.movie_id, x.user_id, x.rating) for x in r)
    assert got == [("12", "1", 5), ("12", "José", 3), ("7", "2", 4)]
    utf = ln.read_lines(spark, os.path.join(p, "b.txt.gz"))
    assert [x.value for x in utf.orderBy("line_no").collect()] == ["7:", "2,4,2004-01-01"]


def test_read_documents_latin1(spark, tmp_dir):
    d = os.path.join(tmp_dir, "subs", "0012345")
    os.makedirs(d)
    with open(os.path.join(d, "cd1.srt"), "wb") as f:
        f.write("1\n00:00:01,000 --> 00:00:02,000\ncaf\xe9\n".encode("iso-8859-1"))
    docs = ln.read_documents(spark, os.path.join(tmp_dir, "subs"), glob="*.srt").collect()
    assert docs[0].parent == "0012345" and "café" in docs[0].text


def test_read_keyed_ratings_file_layout(spark, tmp_dir):
    d = os.path.join(tmp_dir, "by_user")
    os.makedirs(d)
    with open(os.path.join(d, "42.txt"), "w") as f:
        f.write("7,3\n\n9,5\n")
    r = ln.read_keyed_ratings(spark, d, key="user_id", other="movie_id").collect()
    assert sorted(tuple(x) for x in r) == [("42", "7", 3), ("42", "9", 5)]


def test_skip_lines(spark):
    df = _lines(spark, [("f", i, str(i)) for i in range(1, 6)])
    assert [r.value for r in ln.skip_lines(df, 3).orderBy("line_no").collect()] == ["4", "5"]


def test_id_maps_last_wins_each_direction(spark):
    df = _lines(spark, [("m", 1, "0012,100,2001,A"), ("m", 2, "0012,200,2001,B"),
                        ("m", 3, "0034,100,2002,C")])
    by_imdb, by_netflix = ps.id_maps(df)
    assert sorted(tuple(r) for r in by_imdb.collect()) == [("12", "200"), ("34", "100")]
    assert sorted(tuple(r) for r in by_netflix.collect()) == [("12", "200"), ("34", "100")]


def test_id_map_year_keeps_commas(spark):
    df = _lines(spark, [("m", 1, "0012,100,2001,Me, Myself, Irene")])
    r = ps.id_map_year_parse(df).collect()[0]
    assert (r.year, r.title) == (2001, "Me, Myself, Irene")


def test_titles_parse_malformed(spark):
    df = _lines(spark, [("t", 1, "1,2003,Dinosaur Planet"), ("t", 2, "2,NULL,Bad, Year")])
    got = {r.netflix_id: (r.year, r.title, r.malformed) for r in ps.titles_parse(df).collect()}
    assert got == {"1": (2003, "Dinosaur Planet", False), "2": (None, "Bad, Year", True)}


def test_subs_list_parse(spark):
    vals = ["12:2", "a#http://x/a.gz", "b#http://x/b.gz", "34:1", "c#http://x/c.gz"]
    df = _lines(spark, [("s", i + 1, v) for i, v in enumerate(vals)])
    got = sorted(tuple(r) for r in ps.subs_list_parse(df).collect())
    assert got == [("12", 2, 1, "a", "http://x/a.gz"), ("12", 2, 2, "b", "http://x/b.gz"),
                   ("34", 1, 1, "c", "http://x/c.gz")]


def test_predictions_text_round_trip(spark, tmp_dir):
    p = spark.createDataFrame([(5, 1, 3), (6, 2, 4)], "movie_id long, user_id long, prediction int")
    path = os.path.join(tmp_dir, "pred")
    fm.write_predictions_text(p, path)
    back = ln.read_predictions(spark, path).collect()
    assert sorted(tuple(r) for r in back) == [("5", "1", 3), ("6", "2", 4)]


def test_bucketed_layout_joins_without_exchange(spark):
    r = spark.createDataFrame([(1, 10, 3), (1, 11, 4), (2, 10, 5)], "user_id long, movie_id long, rating int")
    fm.save_ratings_bucketed(r, "rr_by_user", "user_id", 4)
    fm.save_ratings_bucketed(r, "rr_by_user2", "user_id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table("rr_by_user").join(spark.table("rr_by_user2"), "user_id")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert j.count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS rr_by_user")
        spark.sql("DROP TABLE IF EXISTS rr_by_user2")


def test_malformed_fields_do_not_fail_under_ansi(spark):
    df = _lines(spark, [("mv_1.txt", 1, "1:"), ("mv_1.txt", 2, "7,x,notadate"), ("mv_1.txt", 3, "8,4,2005-01-01")])
    got = sorted((r.user_id, r.rating, str(r.rated_on)) for r in ps.ratings_from_blocks(df).collect())
    assert got == [("7", None, "None"), ("8", 4, "2005-01-01")]


def test_short_lines_give_nulls_not_errors(spark):
    df = _lines(spark, [("m", 1, "0012"), ("m", 2, "0034,100,2002,C")])
    got = sorted((r.imdb_id, r.netflix_id) for r in ps.id_map_rows(df).collect())
    assert got == [("12", None), ("34", "100")]


def test_read_lines_split_file_keeps_order(spark, tmp_dir):
    p = os.path.join(tmp_dir, "big")
    os.makedirs(p)
    expected = []
    for f in ("a.txt", "b.txt"):
        rows = []
        for m in range(40):
            rows.append(f"{m}:")
            rows.extend(f"u{f[0]}{m}_{i}" for i in range(m % 7 + 1))
        with open(os.path.join(p, f), "w") as fh:
            fh.write("\n".join(rows) + "\n")
        cur = None
        for r in rows:
            if r.endswith(":"):
                cur = r[:-1]
            else:
                expected.append((cur, r))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        lines = ln.read_lines(spark, p)
        raw = spark.read.text(p).rdd.getNumPartitions()
        got = sorted((r.movie_id, r.user_id) for r in ps.test_set_parse(lines).collect())
        seq = {r.source.split("/")[-1]: [] for r in lines.select("source").distinct().collect()}
        for r in lines.orderBy("source", "line_no").collect():
            seq[r.source.split("/")[-1]].append(r.value)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert raw > 4          # the files really were read in several splits
    assert got == sorted(expected)
    for f in ("a.txt", "b.txt"):
        with open(os.path.join(p, f)) as fh:
            assert seq[f] == fh.read().splitlines()


def test_numbers_go_on_across_partitions_without_a_row_per_source(spark):
    """Files of one line, a file over all partitions, and rows without a source; columns not kept go."""
    rows = [("big", i) for i in range(300)] + [(f"s{i}", i) for i in range(200)] + [(None, 1)]
    df = spark.createDataFrame(rows, "source string, k int").withColumn("x", F.col("k") * 2)
    out = ln.number_lines(df, ["k"], partitions=7, keep=["k"])
    assert out.columns == ["source", "k", "line_no"]
    got = {(r.source, r.k): r.line_no for r in out.collect()}
    assert got == {**{("big", i): i + 1 for i in range(300)}, **{(f"s{i}", i): 1 for i in range(200)}}
    spark.conf.set("reelrank.broadcast.maxBytes", "1")  # no broadcast of the sources, and no exchange of the lines either
    try:
        out = ln.number_lines(df, ["k"], partitions=7)
        assert out.count() == 500
    finally:
        spark.conf.unset("reelrank.broadcast.maxBytes")
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_few_folders_gives_the_setting_back(spark):
    from reelrank.session import few_folders

    conf = "spark.sql.maxConcurrentOutputFileWriters"
    old = spark.conf.get(conf)
    with few_folders(spark, 5):
        assert spark.conf.get(conf) == "5"
    assert spark.conf.get(conf) == old
