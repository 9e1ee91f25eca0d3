"""Lines that don't parse, their routing, byte-preserving reads and whole outputs."""

import os

import pytest
from pyspark.sql import functions as F

from reelrank.sinks import atomic
from reelrank.sinks import formats as fm
from reelrank.sources import lines as ln
from reelrank.sources import parsers as ps
from reelrank.sources import routing


def _lines(spark, values, source="f"):
    return spark.createDataFrame([(source, i + 1, v) for i, v in enumerate(values)], "source string, line_no long, value string")


def _status(df):
    return [r.status for r in df.orderBy("source", "line_no").collect()]


def test_rating_lines(spark):
    good = _lines(spark, ["12:", "1,5,2005-01-01", "2,4", "", "3,x,2005-01-01", "4,1,2005-01-01,9", ",3,2005-01-01", "5,2,never\r\n"])
    bad = _lines(spark, ["", "7,3,2005-01-01"], "g")
    df = ps.rating_lines(good.unionByName(bad))
    assert _status(df) == ["header", "ok", "short", "blank", "malformed", "extra", "malformed", "ok", "malformed", "orphan"]
    got = sorted((r.movie_id, r.user_id, r.rating, str(r.rated_on)) for r in df.where("status = 'ok'").collect())
    assert got == [("12", "1", 5, "2005-01-01"), ("12", "5", 2, "None")]
    check = {r.source: tuple(r)[2:] for r in ps.rating_block_check(df).collect()}
    assert check == {"f": (6, 2, 1, 1, 2, "malformed"), "g": (2, 0, 0, 0, 2, "malformed")}


def test_title_without_a_comma_is_no_crash(spark):
    df = _lines(spark, ["1,2000,A,B", "abc", "2,NULL,C", "", "3,1999", "4, 2001 ,D"])
    got = [(r.netflix_id, r.year, r.title, r.malformed) for r in ps.titles_parse(df).orderBy("line_no").collect()]
    assert got == [("1", 2000, "A,B", False), ("abc", None, "", True), ("2", None, "C", True), ("3", 1999, "", False), ("4", 2001, "D", False)]
    assert _status(ps.title_lines(df)) == ["ok", "short", "malformed", "blank", "ok", "ok"]


def test_few_fields_under_ansi(spark):
    """Every other parser gives nulls for missing fields."""
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    df = _lines(spark, ["7"])
    assert [tuple(r) for r in ps.id_map_year_parse(df).collect()] == [("7", None, None, None)]
    assert [tuple(r)[:2] for r in ps.id_map_rows(df).collect()] == [("7", None)]
    assert [tuple(r) for r in ps.test_set_parse(df).collect()] == [(None, "7")]


def test_subs_blocks_against_their_count(spark):
    df = ps.subs_lines(_lines(spark, ["x#y", "1:2", "a#l", "b#m", "2:3", "c#n", "3:1", "d#o", "e#p", "", "4:2", "bare", "f#q", "5:0",
                                      "6:99999999999", "g#r", "7:2", "", "h#s"]))
    assert _status(df) == ["orphan", "header", "ok", "ok", "header", "ok", "header", "ok", "extra", "blank", "header", "malformed", "ok",
                           "header", "malformed", "extra", "header", "malformed", "ok"]
    got = {r.movie_id: (r.n_files, r.n_lines, r.n_ok, r.status) for r in ps.subs_list_check(df).collect()}
    assert got == {"1": (2, 2, 2, "ok"), "2": (3, 1, 1, "short"), "3": (1, 2, 1, "extra"), "4": (2, 2, 1, "malformed"), "5": (0, 0, 0, "ok"),
                   "6": (None, 1, 0, "malformed"), "7": (2, 2, 1, "malformed")}


def test_route_loses_no_line(spark, tmp_dir):
    values = ["12:", "1,5,2005-01-01", "2,4", "", "3,x,2005-01-01"] * 3
    r = routing.route(ps.rating_lines(_lines(spark, values)), os.path.join(tmp_dir, "out"))
    assert sum(r.counts.values()) == len(values)
    assert r.counts["ok"] == r.accepted.count() == 3 and r.rejected.count() == sum(r.counts[s] for s in routing.REJECTS)
    assert r.accepted.columns == ["source", "line_no", "movie_id", "user_id", "rating", "rated_on"]
    empty = routing.route(ps.rating_lines(_lines(spark, [])), os.path.join(tmp_dir, "none"))
    assert sum(empty.counts.values()) == 0 and empty.accepted.count() == empty.rejected.count() == 0


def test_latin1_lines_keep_blank_ones(spark, tmp_dir):
    p = os.path.join(tmp_dir, "a.txt")
    with open(p, "wb") as f:
        f.write("é1\r\n\r\n\nb\x85c\n".encode("iso-8859-1"))
    got = [(r.line_no, r.value) for r in ln.read_lines(spark, p, encoding="ISO-8859-1").orderBy("line_no").collect()]
    assert got == [(1, "é1"), (2, ""), (3, ""), (4, "b\x85c")]
    skipped = ln.skip_lines(ln.read_lines(spark, p, encoding="latin1"), 2)
    assert sorted(r.value for r in skipped.collect()) == ["", "b\x85c"]
    with pytest.raises(ValueError):
        ln.read_lines(spark, p, encoding="UTF-16")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_commit_replaces_only_its_values(spark, tmp_dir):
    p = os.path.join(tmp_dir, "t")
    mk = lambda *rows: spark.createDataFrame(rows, "algorithm string, n int")
    assert _rows(atomic.read(spark, p, "algorithm", mk(("a", 1)).schema)) == []
    atomic.commit(mk(("a", 1), ("a", 2), ("b", 3), (None, 0)), p, "algorithm")
    atomic.commit(mk(("a", 9)), p, "algorithm")
    back = lambda: _rows(atomic.read(spark, p, "algorithm", "algorithm string, n int"))
    assert back() == sorted([("a", 9), ("b", 3), (None, 0)], key=repr)
    atomic.commit(mk(("a", 9)).where("false"), p, "algorithm", ["b"])
    assert back() == sorted([("a", 9), (None, 0)], key=repr)


def test_failed_commit_leaves_the_old_rows(spark, tmp_dir):
    p = os.path.join(tmp_dir, "t")
    old = spark.createDataFrame([("a", 1), ("b", 2)], "algorithm string, n int")
    atomic.commit(old, p, "algorithm")
    dies = spark.range(40, numPartitions=4).select(
        F.lit("a").alias("algorithm"), F.when(F.col("id") < 39, 5).otherwise(F.raise_error(F.lit("killed")).cast("int")).alias("n"))
    with pytest.raises(Exception, match="killed"):
        atomic.commit(dies, p, "algorithm")
    assert _rows(atomic.read(spark, p, "algorithm", old.schema)) == _rows(old)


def test_outputs_of_an_algorithm_are_replaced(spark, tmp_dir):
    pred = spark.createDataFrame([("x", 1, 1, 3), ("y", 1, 1, 4)], "algorithm string, movie_id long, user_id long, prediction int")
    err = spark.createDataFrame([("x", 2, 2), ("y", 2, 2)], "algorithm string, movie_id long, user_id long")
    met = spark.createDataFrame([("x", 0.5), ("y", 0.25)], "algorithm string, rmse double")
    for _ in range(2):  # a rerun does not append
        fm.write_outputs(pred, err, met, tmp_dir)
    x = F.col("algorithm") == "x"
    fm.write_outputs(pred.where(x).withColumn("prediction", F.lit(1)), err.where("false"), met.where(x), tmp_dir, ["x"])
    read = lambda name, df: _rows(atomic.read(spark, f"{tmp_dir}/{name}", "algorithm", df.schema))
    assert read("predictions", pred) == [("x", 1, 1, 1), ("y", 1, 1, 4)]
    assert read("errors", err) == [("y", 2, 2)] and read("metrics", met) == _rows(met)


def test_algorithms_without_predictions_score_zero(spark):
    from reelrank.operators import evaluate as ev

    r = spark.createDataFrame([(1, 1, 3), (2, 1, 5)], "user_id long, movie_id long, rating int")
    p = spark.createDataFrame([("a", 1, 1, 4), ("a", 1, 2, 4)], "algorithm string, movie_id long, user_id long, prediction int")
    got = ev.rmse(p, r, r.select("movie_id", "user_id"), ["a", "none"]).collect()
    assert {x.algorithm: (x.n_pred, x.rmse, x.coverage) for x in got} == {"a": (2, 1.0, 1.0), "none": (0, 0.0, 0.0)}


def test_found_and_kept_movies(spark):
    from reelrank.operators import catalog as ct

    rows = [("1", 10, "a", "l", "srt", 1), ("2", 11, "b", "l", "srt", 2), ("3", 12, "c", "l", "sub", 1), ("1", 13, "d", "l", "srt", 3)]
    df = spark.createDataFrame(rows, "movie_id string, sub_id long, file_id string, link string, sub_format string, sum_cd int")
    assert tuple(ct.subtitle_summary(df).first()) == (3, 1) and tuple(ct.subtitle_summary(df.where("false")).first()) == (0, 0)


def test_broadcast_bound_measures_long_values(spark):
    from reelrank.operators.joins import fits_broadcast

    spark.conf.set("reelrank.broadcast.maxBytes", "10000")
    try:
        df = spark.createDataFrame([("x" * 20_000, [1])], "s string, a array<int>")
        assert not fits_broadcast(df) and fits_broadcast(df.withColumn("s", F.lit("x"))) and fits_broadcast(df.where("false"))
        assert not fits_broadcast(spark.range(10_000))
    finally:
        spark.conf.unset("reelrank.broadcast.maxBytes")


def test_stem_of_a_file(spark, tmp_dir):
    for name in ("0012.plots.txt", "77"):
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write("x")
    assert sorted(r.stem for r in ln.read_documents(spark, tmp_dir).collect()) == ["0012.plots", "77"]
