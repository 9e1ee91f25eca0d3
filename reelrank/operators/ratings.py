"""Rating statistics shared by the neighbourhood recommenders.

Tables (all ids BIGINT):

* ``ratings(user_id, movie_id, rating INT)`` - one row per (user, movie);
* ``test(movie_id, user_id)`` - target pairs to predict.

The central piece is :func:`pair_stats`: for every needed (user, co-rater)
pair it computes, in one aggregate, the sums over *all* co-rated movies

    n, s_u = sum r_u, s_v = sum r_v, s_uv = sum r_u r_v, s_uu, s_vv

Leave-one-out variants then subtract the target movie's own term
algebraically instead of re-scanning ratings per target (integer sums, so
the subtraction is exact).

Scale notes
-----------
No (target, co-rater) table is written.

Ratings over the broadcast bound (counted, see :mod:`joins`) meet as lists: each
requested user gets the later raters of each of its movies, in a fixed order of the users, as one row of arrays (cut for movies with
many raters), and the sums of two users are taken once, where those rows are (of all raters, for :func:`pair_features`, which
are grouped by the test user next), so neither single
rater pairs nor users' whole rating vectors are exchanged.  Under the bound each pair
walks the lighter user's ratings and probes the partner's, map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import fits_broadcast, hint, materialize

#: Ratings of a list in a row; a movie with more has several.
SPLIT = 512
#: (user, co-rater, movie) rows of a task.
TASK_ROWS = 1_000_000
SUMS = ("n", "s_u", "s_v", "s_uv", "s_uu", "s_vv")


def user_avg(ratings: DataFrame) -> DataFrame:
    """A1: mean of all ratings of each user (target included, as the model does).

    Returns (user_id, n_ratings BIGINT, sum_ratings BIGINT, avg_rating DOUBLE).
    """
    return ratings.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_ratings"),
        F.sum(F.col("rating").cast("bigint")).alias("sum_ratings"),
        F.avg(F.col("rating").cast("double")).alias("avg_rating"))


def user_ratings_loo(ratings: DataFrame, test: DataFrame) -> DataFrame:
    """A test user's ratings with the target movie left out.

    Returns (movie_id, user_id, rated_movie_id, rating) for each test pair.
    """
    t = test.select("movie_id", "user_id")
    r = ratings.select("user_id", F.col("movie_id").alias("rated_movie_id"), "rating")
    return (t.join(r, "user_id")
            .where(F.col("rated_movie_id") != F.col("movie_id"))
            .select("movie_id", "user_id", "rated_movie_id", "rating"))


def corater_candidates(ratings: DataFrame, test: DataFrame) -> DataFrame:
    """Co-raters of each target movie, the target user excluded.

    Returns (movie_id, user_id, [other test columns], corater_id, vote).  The
    size of this table is the algorithms' own work (every co-rater
    contributes to the sum); it is a join of the test pairs with one movie's
    raters, skew-split by AQE.
    """
    t = test
    r = ratings.select("movie_id", F.col("user_id").alias("corater_id"),
                       F.col("rating").alias("vote"))
    return (t.join(r, "movie_id")
            .where(F.col("corater_id") != F.col("user_id")))


def _degree_bits(ratings: DataFrame, key: str = "user_id") -> DataFrame | None:
    """(key, bits) of users (or movies) with more than ``SPLIT`` ratings, None if there is
    none: their list is cut into ``2**bits`` parts by a hash of what it holds."""
    deg = ratings.groupBy(key).agg(F.count(F.lit(1)).alias("deg"))
    if (deg.agg(F.max("deg")).first()[0] or 0) <= SPLIT:
        return None
    return materialize(deg.where(F.col("deg") > SPLIT)
                       .select(key, F.ceil(F.log2(F.col("deg") / SPLIT)).cast("int").alias("bits")))


def _power(bits):
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits)


def _narrow(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with the whole numbers ``cols`` in the narrowest type that holds them all, as lists of them travel."""
    cols = [c for c in cols if dict(df.dtypes)[c] in ("smallint", "int", "bigint")]
    if not cols:
        return df
    held = df.agg(*(f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max)))).first()
    for c in cols:
        lo, hi = held[f"lo_{c}"] or 0, held[f"hi_{c}"] or 0
        kind = next(k for k, n in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if -(1 << n) <= lo and hi < 1 << n)
        df = df.withColumn(c, F.col(c).cast(kind))
    return df


def _order(user):
    """What decides which of two users gets their pair, the same for every movie."""
    return F.struct(F.xxhash64(user), user)


def movie_lists(rows: DataFrame, cols: tuple[str, ...], ordered: bool = True) -> DataFrame:
    """The raters of each movie in rows of arrays: ``movie_id``, ``part``, ``vs`` (user ids) and
    ``v_<col>`` in the same order; a movie of many raters has several rows (see :func:`_degree_bits`).
    ``ordered``: the ``n_req`` ones with ``requested`` come first, by :func:`_order`, whose ranges the parts are."""
    kind, flag = dict(rows.dtypes)["user_id"], ["requested"] if ordered else []
    bits = _degree_bits(rows, "movie_id")
    part = F.lit(0).cast("long")
    if bits is not None:
        rows = rows.join(hint(bits, fits_broadcast(bits)), "movie_id", "left")
        # the leading bits, so that parts follow the order
        part = F.when(F.col("bits").isNull(), part).otherwise(F.call_function("shiftright", F.xxhash64("user_id"), F.lit(64) - F.coalesce("bits", F.lit(1))))
    rows = _narrow(rows.select("movie_id", part.alias("part"), "user_id", *flag, *cols), ["user_id", *cols])
    # lists of single columns would leave nulls out
    listed = rows.groupBy("movie_id", "part").agg(F.collect_list(F.struct("user_id", *flag, *cols)).alias("l"))
    if ordered:
        place = lambda x: F.struct((~x["requested"]).alias("last"), F.xxhash64(x["user_id"].cast(kind)).alias("o"), *(x[c].alias(c) for c in ("user_id", *cols)))
        listed = (listed.withColumn("l", F.sort_array(F.transform("l", place)))
                  .withColumn("n_req", F.size(F.filter("l", lambda x: ~x["last"]))))
    return listed.select("movie_id", "part", *(["n_req"] if ordered else []), F.col("l.user_id").alias("vs"), *(F.col(f"l.{c}").alias(f"v_{c}") for c in cols))


def meet_raters(rows: DataFrame, cols: tuple[str, ...], asked: DataFrame | None = None) -> DataFrame:
    """Each two raters of a movie in ``rows(user_id, movie_id, requested, <cols>)`` of which one is requested, once: ``u``, ``u_<col>``,
    ``v``, ``v_<col>`` and the movie's id (not if ``asked``), hash-partitioned by u, so that what is grouped by (u, v) needs no further
    exchange.  Of two requested users u is the first by :func:`_order`, else u is the requested one.

    A u gets its movies' later raters as arrays: a pair costs a few numbers a common movie, not all ratings of v.
    ``asked(u, vs, ..)``, rows of arrays of the same kind, is dealt out with them; then a user also meets itself.
    """
    kinds, lists = dict(rows.dtypes), movie_lists(rows, cols)
    made = (rows.groupBy("movie_id").agg(F.count(F.lit(1)).alias("d"), F.sum(F.col("requested").cast("long")).alias("c"))
            .agg(F.sum(F.col("c") * (F.col("d") - F.col("c") / 2))).first()[0] or 0)
    arrays = ["vs", *(f"v_{c}" for c in cols)]
    mine = [F.col(c).alias(f"a_{c}") for c in ("part", "n_req", *arrays)]
    # the parts of a movie meet each other; most movies have one, and no join
    several = lists.groupBy("movie_id").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("movie_id")
    if lists.where("part <> 0").isEmpty():
        met = lists.select("*", *mine)
    else:
        lists, several = materialize(lists), materialize(several)
        cut = lists.join(hint(several, fits_broadcast(several)), "movie_id", "left_semi")
        met = (lists.join(hint(several, fits_broadcast(several)), "movie_id", "left_anti").select("*", *mine)
               .unionByName(cut.join(cut.select("movie_id", *mine), "movie_id")))
    first = (F.when(F.col("a_part") == F.col("part"), F.col("at") + F.lit(1 if asked is not None else 2))
             .when(F.col("a_part") < F.col("part"), 1).otherwise(F.col("n_req") + 1))
    met = (met.select("*", F.posexplode(F.slice("a_vs", F.lit(1), F.col("a_n_req"))).alias("at", "u"))
           .withColumn("first", first).withColumn("left", F.size("vs") - F.col("first") + 1).where("left > 0")
           .select("movie_id", F.col("u").cast(kinds["user_id"]).alias("u"), *(F.get(f"a_v_{c}", F.col("at")).cast(kinds[c]).alias(f"u_{c}") for c in cols),
                   *(F.slice(c, F.col("first"), F.col("left")).alias(c) for c in arrays)))
    if asked is not None:
        met = met.drop("movie_id").unionByName(asked.withColumn("vs", F.col("vs").cast(met.schema["vs"].dataType)), allowMissingColumns=True)
    return _dealt(met, _tasks(rows, made), kinds, cols)


def _tasks(rows: DataFrame, made) -> int:
    """As many tasks as keep the ``made`` rows of one in memory."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(made) // TASK_ROWS))


def _dealt(met: DataFrame, tasks: int, kinds: dict, cols: tuple[str, ...]) -> DataFrame:
    """Rows with arrays ``vs``, ``v_<col>`` hash-partitioned by u, then a row per element."""
    keep = [c for c in met.columns if c != "vs" and c not in [f"v_{c}" for c in cols]]
    return (met.repartition(tasks, "u").select("*", F.posexplode("vs").alias("at", "v"))
            .select(*keep, F.col("v").cast(kinds["user_id"]).alias("v"),
                    *(F.get(f"v_{c}", F.col("at")).cast(kinds[c]).alias(f"v_{c}") for c in cols)))


def all_raters(mine: DataFrame, rows: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """Each row of ``mine(u, movie_id, ..)`` with every rater ``v``, ``v_<col>`` of its movie in ``rows(user_id, movie_id, <cols>)``,
    hash-partitioned by u.  Unlike :func:`meet_raters` every u gets all of its pairs."""
    kinds, lists = dict(rows.dtypes), movie_lists(rows, cols, ordered=False).drop("part")
    made = (rows.groupBy("movie_id").agg(F.count(F.lit(1)).alias("d"))
            .join(mine.groupBy("movie_id").agg(F.count(F.lit(1)).alias("c")), "movie_id")
            .agg(F.sum(F.col("c") * F.col("d"))).first()[0] or 0)
    return _dealt(mine.join(lists, "movie_id"), _tasks(rows, made), kinds, cols)


def common_movies(rows: DataFrame, pairs: DataFrame, cols: tuple[str, ...] = ("rating",)) -> DataFrame:
    """``(u, u_<col>, asked, v, v_<col>)``: a row with ``asked`` 0 for every movie that two users have in
    common of which one is a u of ``pairs(u, v)``, and others for the distinct pairs: 1 if (u, v), 2 if (v, u) is one, 3 both,
    see :func:`meet_raters` and :func:`both_ways`.  The pairs' groups are those with an ``asked`` row.
    ``rows`` holds one row per (user_id, movie_id).
    """
    rows = rows.select("user_id", "movie_id", *cols).where("user_id is not null and movie_id is not null")
    users, kind = rows.select("user_id").distinct(), dict(rows.dtypes)["user_id"]
    lo, hi = rows.agg(F.min("user_id"), F.max("user_id")).first()
    # a u or v that is no user has no common movie, and might not fit the lists' type
    pairs = pairs.select(F.col("u").cast(kind).alias("u"), F.col("v").cast(kind).alias("v")).where(F.col("u").between(F.lit(lo), F.lit(hi)))
    requested = materialize(pairs.select(F.col("u").alias("user_id")).distinct().withColumn("requested", F.lit(True)))
    other = users.join(hint(requested, fits_broadcast(requested)), "user_id", "left").withColumnRenamed("user_id", "v")
    swapped = F.col("requested").isNotNull() & (_order(F.col("v")) < _order(F.col("u")))
    asked = (pairs.join(other, "v").withColumn("swapped", swapped)
             .groupBy(F.when(F.col("swapped"), F.col("v")).otherwise(F.col("u")).alias("u"))
             .agg(F.collect_set(F.when(~F.col("swapped"), F.col("v"))).alias("f"), F.collect_set(F.when(F.col("swapped"), F.col("u"))).alias("b")))
    asked = materialize(asked.select("u", F.explode(F.array(
        F.struct(F.array_except("f", "b").alias("vs"), F.lit(1).alias("asked")), F.struct(F.array_except("b", "f").alias("vs"), F.lit(2).alias("asked")),
        F.struct(F.array_intersect("f", "b").alias("vs"), F.lit(3).alias("asked")))).alias("x")).select("u", "x.vs", "x.asked").where(F.size("vs") > 0))
    rows = rows.join(hint(requested, fits_broadcast(requested)), "user_id", "left").na.fill(False, ["requested"])
    return meet_raters(rows, cols, asked).na.fill(0, ["asked"])


def both_ways(df: DataFrame, forth, back, swaps: dict[str, str]) -> DataFrame:
    """The rows of ``df`` for which ``forth`` holds, and those for which ``back`` holds with the columns of ``swaps`` taken from the named ones."""
    swaps = swaps | {v: k for k, v in swaps.items()}
    ways = F.array(F.when(forth, F.struct(*df.columns)), F.when(back, F.struct(*(F.col(swaps.get(c, c)).alias(c) for c in df.columns))))
    return df.select(F.explode(F.array_compact(ways)).alias("way")).select("way.*")


def _terms(x, y) -> dict:
    """The sums of :data:`SUMS` but n, over the ratings x of u and y of v."""
    return {"s_u": x, "s_v": y, "s_uv": x * y, "s_uu": x * x, "s_vv": y * y}


#: What changes places with the users of a pair.
SWAPS = {"u": "v", "s_u": "s_v", "s_uu": "s_vv"}


def _merged_stats(ratings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sums of the (u, v) of ``pairs`` over their common movies, for ratings of any size."""
    met = common_movies(ratings.withColumn("rating", F.col("rating").cast("long")), pairs)
    sums = (met.groupBy("u", "v")
            .agg(F.bit_or("asked").alias("asked"), F.sum((F.col("asked") == 0).cast("long")).alias("n"),
                 *(F.sum(t).alias(c) for c, t in _terms(F.col("u_rating"), F.col("v_rating")).items())))
    return both_ways(sums, F.col("asked").bitwiseAND(F.lit(1)) != 0, F.col("asked").bitwiseAND(F.lit(2)) != 0, SWAPS).drop("asked")


def _with_votes(rows: DataFrame):
    """``rows`` whose ``user_id`` holds the rating too, as one number, and what takes both out of such a number
    (None, if none is large enough); a null rating is 0 there."""
    held = rows.agg(F.min("user_id").alias("u0"), F.max("user_id").alias("u1"), F.min("rating").alias("lo"), F.max("rating").alias("hi")).first()
    lo, width = held.lo or 0, (held.hi or 0) - (held.lo or 0) + 2
    if dict(rows.dtypes)["user_id"] != "bigint" or max(abs(held.u0 or 0), abs(held.u1 or 0)) + 1 > (1 << 62) // width:
        return rows, None
    packed = rows.withColumn("user_id", F.col("user_id") * F.lit(width) + F.coalesce(F.col("rating") - F.lit(lo - 1), F.lit(0)))

    def apart(df: DataFrame) -> DataFrame:
        at = F.pmod("v", F.lit(width))
        return df.withColumn("v_rating", F.when(at > 0, at + F.lit(lo - 1))).withColumn("v", F.expr(f"(v - pmod(v, {width})) div {width}"))
    return packed.drop("rating"), apart


def _merged_features(ratings: DataFrame, test: DataFrame) -> DataFrame:
    """(u, v, movie_id, vote, r_target, sums) of the distinct test pairs, for ratings of any size.

    A test user's movies, its targets marked, meet their raters; the rows of a (user, co-rater) are summed
    where they are, and those of the targets stay: what is grouped by the test user needs no exchange either.
    """
    rows = (ratings.select("user_id", "movie_id", F.col("rating").cast("long").alias("rating"))
            .where("user_id is not null and movie_id is not null"))
    mine = (rows.join(test.select("user_id"), "user_id", "left_semi")
            .select("user_id", "movie_id", "rating", F.lit(1).alias("rated"), F.lit(0).alias("target"))
            .unionByName(test.select("user_id", "movie_id", F.lit(None).cast("long").alias("rating"),
                                     F.lit(0).alias("rated"), F.lit(1).alias("target")))
            .groupBy(F.col("user_id").alias("u"), "movie_id")
            .agg(F.max("rating").alias("u_rating"), (F.max("rated") + 2 * F.max("target")).alias("kind")))
    packed, apart = _with_votes(rows)
    met = all_raters(materialize(mine), packed, ("rating",) if apart is None else ())
    met = (met if apart is None else apart(met)).where("u <> v")
    both = Window.partitionBy("u", "v")
    common = F.col("kind").bitwiseAND(F.lit(1)) != 0
    return (met.select("u", "v", "movie_id", "kind", F.col("v_rating").alias("vote"), F.col("u_rating").alias("r_target"),
                       F.sum(common.cast("long")).over(both).alias("n"),
                       *(F.coalesce(F.sum(F.when(common, t)).over(both), F.lit(0)).alias(c)
                         for c, t in _terms(F.col("u_rating"), F.col("v_rating")).items()))
            .where(F.col("kind") >= 2).drop("kind"))


def _walked_stats(ratings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sums of the (u, v) of ``pairs``, for ratings under the broadcast bound: each
    pair walks the ratings of the lighter user and looks the partner's up by the unique key
    (user, movie), both in broadcast tables."""
    deg = ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("deg"))
    p = pairs.distinct()
    p = (p.join(F.broadcast(deg.select(F.col("user_id").alias("u"), F.col("deg").alias("du"))), "u")
          .join(F.broadcast(deg.select(F.col("user_id").alias("v"), F.col("deg").alias("dv"))), "v"))
    # Walk the ratings of the lighter user; look up the other by unique key.
    flip = (F.col("dv") < F.col("du")) | ((F.col("dv") == F.col("du")) & (F.col("v") < F.col("u")))
    p = p.select("u", "v",
                 F.when(flip, F.col("v")).otherwise(F.col("u")).alias("walk"),
                 F.when(flip, F.col("u")).otherwise(F.col("v")).alias("probe"),
                 flip.alias("flip"))
    rw = ratings.select(F.col("user_id").alias("walk"), "movie_id",
                        F.col("rating").cast("bigint").alias("r_walk"))
    rp = ratings.select(F.col("user_id").alias("probe"), "movie_id",
                        F.col("rating").cast("bigint").alias("r_probe"))
    m = p.join(F.broadcast(rw), "walk")
    if _packable(ratings):
        # one BIGINT key (user << 32 | movie): a long-keyed hash relation
        key = lambda user, movie: F.shiftleft(user.cast("bigint"), 32) + movie
        m = m.withColumn("_k", key(F.col("probe"), F.col("movie_id")))
        rpk = rp.select(key(F.col("probe"), F.col("movie_id")).alias("_k"), "r_probe")
        m = m.join(F.broadcast(rpk), "_k")
    else:
        m = m.join(F.broadcast(rp), ["probe", "movie_id"])
    ru = F.when(F.col("flip"), F.col("r_probe")).otherwise(F.col("r_walk"))
    rv = F.when(F.col("flip"), F.col("r_walk")).otherwise(F.col("r_probe"))
    return (m.select("u", "v", ru.alias("ru"), rv.alias("rv"))
            .groupBy("u", "v")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum("ru").alias("s_u"), F.sum("rv").alias("s_v"),
                 F.sum(F.col("ru") * F.col("rv")).alias("s_uv"),
                 F.sum(F.col("ru") * F.col("ru")).alias("s_uu"),
                 F.sum(F.col("rv") * F.col("rv")).alias("s_vv")))


def _packable(ratings: DataFrame) -> bool:
    """True if user ids fit 31 bits and movie ids 32 bits (checked, one job)."""
    b = ratings.agg(F.min("user_id").alias("u0"), F.max("user_id").alias("u1"),
                    F.min("movie_id").alias("m0"), F.max("movie_id").alias("m1")).first()
    if b is None or b.u0 is None:
        return False
    return b.u0 >= 0 and b.m0 >= 0 and b.u1 < (1 << 31) and b.m1 < (1 << 32)


def pair_stats(ratings: DataFrame, pairs: DataFrame,
               u: str = "user_id", v: str = "corater_id") -> DataFrame:
    """Co-rating sums for each distinct requested pair (u, v).

    Returns (user_id, corater_id, n, s_u, s_v, s_uv, s_uu, s_vv), all BIGINT.
    Pairs without a co-rated movie get no row (callers treat that as n = 0).
    """
    ratings = ratings.select("user_id", "movie_id", "rating")
    pairs = pairs.select(F.col(u).alias("u"), F.col(v).alias("v"))
    merge = _walked_stats if fits_broadcast(ratings) else _merged_stats
    return merge(ratings, pairs).where("n > 0").select(F.col("u").alias("user_id"), F.col("v").alias("corater_id"), *SUMS)


def pair_features(ratings: DataFrame, test: DataFrame) -> DataFrame:
    """Everything the neighbourhood formulas need, one row per (target, co-rater).

    Columns: movie_id, user_id, corater_id, vote, r_target, n, s_u, s_v,
    s_uv, s_uu, s_vv (sums over all co-rated movies, target included), and
    ``w``: the leave-one-out cosine of the two users (A3, target excluded).
    A test pair that is repeated counts once.
    """
    test = test.select("movie_id", "user_id").where("movie_id is not null and user_id is not null").distinct()
    if fits_broadcast(ratings):
        cand = corater_candidates(ratings, test).select(F.col("user_id").alias("u"), F.col("corater_id").alias("v"), "movie_id", "vote")
        own = ratings.select(F.col("user_id").alias("u"), "movie_id", F.col("rating").alias("r_target"))
        f = (cand.join(_walked_stats(ratings, cand.select("u", "v")), ["u", "v"], "left").na.fill(0, list(SUMS))
             .join(F.broadcast(own), ["u", "movie_id"], "left"))
    else:
        f = _merged_features(ratings, test)
    f = f.withColumnsRenamed({"u": "user_id", "v": "corater_id"})
    zero = F.lit(0).cast("bigint")
    rt = F.coalesce(F.col("r_target").cast("bigint"), zero)
    vt = F.when(F.col("r_target").isNull(), zero).otherwise(F.col("vote").cast("bigint"))
    num = F.col("s_uv") - rt * vt
    nu = F.col("s_uu") - rt * rt
    nv = F.col("s_vv") - vt * vt
    den = F.sqrt(nu.cast("double")) * F.sqrt(nv.cast("double"))
    # Q4: a zero norm on one side gives 0 instead of a division error.
    w = F.when((nu + nv > 0) & (den > 0), num.cast("double") / den).otherwise(F.lit(0.0))
    return f.select("movie_id", "user_id", "corater_id", "vote", "r_target", *SUMS, w.alias("w"))


def user_cosine(ratings: DataFrame, test: DataFrame) -> DataFrame:
    """A3: leave-one-out cosine for every (target pair, co-rater)."""
    return pair_features(ratings, test).select(
        "movie_id", "user_id", "corater_id", "w")


def relative_avg(ratings: DataFrame, test: DataFrame) -> DataFrame:
    """A2: each user's mean over the movies the partner also rated.

    Means are over all co-rated movies, target included (0 if none).
    """
    f = pair_features(ratings, test)
    n = F.col("n")
    return f.select(
        "movie_id", "user_id", "corater_id",
        F.when(n > 0, F.col("s_u") / n).otherwise(F.lit(0.0)).alias("user_rel_avg"),
        F.when(n > 0, F.col("s_v") / n).otherwise(F.lit(0.0)).alias("corater_rel_avg"))
