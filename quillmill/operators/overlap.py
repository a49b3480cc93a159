"""Similarity by shared words: blocked on tokens, so that only pairs with something in common are ever made.

Overlap is |A n B| / min(|A|, |B|). Pairs that share no token have overlap 0 and never meet. Which tokens rows are joined on is
decided by frequency: each set is indexed by its rarest tokens only (prefix filtering), enough of them that a pair above the
threshold must share one; where that is a common word, by the first two or more that they share.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written


def _frequency(*sets: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(sets[0].sparkSession)
    tokens = functools.reduce(DataFrame.union, [s.select(F.explode("tokens").alias("token")) for s in sets])
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f")).transform(written)


_MET = 256  # owners of a key from which on it is made longer


def overlap_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(i, j, overlap) with i < j and overlap at least the threshold. sets: id, tokens (distinct). Equal sets are paired once for all, in lots of some eight."""
    rows = sets.select("id", F.array_sort("tokens").alias("tokens")).where(F.size("tokens") > 0).transform(written)
    many = rows.groupBy("tokens").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 8)
    lot = F.pmod(F.xxhash64("id"), F.coalesce(F.ceil(F.col("c") / 8), F.lit(1)))
    lots = rows.join(many, "tokens", "left").groupBy("tokens", lot.alias("lot")).agg(F.min("id").alias("id"), F.collect_list("id").alias("ids")).transform(written)
    same = lots.where(F.size("ids") > 1).select(F.explode("ids").alias("i"), "ids").select("i", F.explode("ids").alias("j"), F.lit(1.0).alias("overlap")).where(F.lit(threshold) <= 1)
    met = _met(lots, threshold).select(F.explode("x").alias("i"), "y", "overlap").select("i", F.explode("y").alias("j"), "overlap")
    return same.where("i < j").union(met.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "overlap"))


def _met(sets: DataFrame, threshold: float) -> DataFrame:
    """(x, y, overlap): ids of each two sets (id, ids, tokens) that reach the threshold, once.

    A pair at the threshold shares c >= threshold * n tokens, n the smaller size. With tokens in one order, the rarest first, the
    first that they share is not among the last c - 1 of either; nor are the first two among the last c - 2, and so on. So they meet by
    the first that they share; where more than a bounded number of sets of that c do so, by the first two, and so on up to c, when all who
    meet are pairs of the result, unless that would make more pairs than it saves. A set is an owner of its keys for the c of its own
    size, and is looked up for those of smaller sets. What meets is judged in the join, so pairs that fall short are never written.
    """
    codes = _codes(_frequency(sets).where(F.col("f") > 1))
    rows = sets.select("id", "ids", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(codes.select("token", "code"), "token")
    own_c = F.greatest(F.lit(1), F.ceil(F.col("n") * threshold - 1e-9).cast("int"))
    coded = rows.groupBy("id", "n").agg(F.first("ids").alias("ids"), F.sort_array(F.collect_list("code")).alias("t")).withColumn("own_c", own_c).transform(written)
    placed = coded.select("*", F.posexplode("t").alias("p", "code"))
    owned = placed.where(F.col("p") <= F.size("t") - F.col("own_c")).select("code", F.col("own_c").alias("c")).distinct().transform(written)
    rows = placed.join(owned, "code").where((F.col("c") <= F.col("own_c")) & (F.col("p") <= F.size("t") - F.col("c")))
    rows = rows.select("c", F.array("code").alias("s"), (F.col("c") == F.col("own_c")).alias("own"), "id", "ids", "n", "t", "p").transform(written)
    counts = (F.count_if("own").alias("o"), F.count(F.lit(1)).alias("m"))
    found, level = None, 1
    while True:
        crowded = rows.groupBy("c", "s").agg(*counts).where((F.col("o") > _MET) & (F.col("c") > level)).transform(written)
        if crowded.isEmpty():
            here = _judged(rows, level, threshold)
            return here if found is None else found.union(here)
        longer = _longer(rows.join(crowded.select("c", "s"), ["c", "s"], "left_semi").withColumn("up", F.col("s")), F.size("t") - F.col("c") + level).transform(written)
        counted = longer.groupBy("c", "up", "s").agg(*counts).transform(written)
        cost = counted.groupBy("c", F.col("up").alias("s")).agg(F.sum(F.col("o") * F.col("m")).alias("cost"))
        split = crowded.join(cost, ["c", "s"], "left").where(F.coalesce("cost", F.lit(0)) < F.col("o") * F.col("m") / 2).select("c", "s").transform(written)
        here = _judged(rows.join(split, ["c", "s"], "left_anti"), level, threshold)
        found = here if found is None else found.union(here)
        useful = counted.join(split.withColumnRenamed("s", "up"), ["c", "up"], "left_semi").where("o > 0 AND m > 1").select("c", "s")
        rows = longer.drop("up").join(useful, ["c", "s"], "left_semi").transform(written)
        level += 1


_CELL, _PAIRS = 1000, 5_000_000  # sets of a key that meet in a cell, on either side; pairs that meet in a task


def _judged(rows: DataFrame, level: int, threshold: float) -> DataFrame:
    """(x, y, overlap) of those who meet by s and have no earlier token in common.

    Pairs, not bytes, are the work: a key's sets meet in cells of a thousand by a thousand, and there are tasks by the number of pairs.
    """
    long = lambda n: F.lit(n).cast("long")
    keys = rows.groupBy("c", "s").agg(F.count_if("own").alias("o"), F.count(F.lit(1)).alias("m")).where("o > 0 AND m > 1").transform(written)
    tasks = (keys.agg(F.sum(F.col("o") * F.col("m"))).first()[0] or 0) // _PAIRS
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4000, tasks))
    wide = keys.where(F.col("m") > _CELL).select("c", "s", F.ceil(F.col("o") / _CELL).alias("kx"), F.ceil(F.col("m") / _CELL).alias("ky"))
    dealt = rows.join(wide, ["c", "s"], "left").withColumns({k: F.coalesce(k, long(1)) for k in ("kx", "ky")})
    own, every = lambda k: F.pmod(F.xxhash64("id"), F.col(k)), lambda k: F.explode(F.sequence(long(0), F.col(k) - 1))
    x = dealt.where("own").select("c", "s", F.col("id").alias("xi"), F.col("ids").alias("x"), F.col("n").alias("nx"), F.col("t").alias("tx"), own("kx").alias("gx"), every("ky").alias("gy"))
    y = dealt.select("c", "s", F.col("id").alias("yi"), F.col("ids").alias("y"), F.col("n").alias("ny"), F.col("t").alias("ty"), "own", every("kx").alias("gx"), own("ky").alias("gy"))
    cell = ["c", "s", "gx", "gy"]
    both = x.repartition(n, *cell).join(y.repartition(n, *cell), cell).where("NOT own OR xi < yi").withColumn("shared", F.array_intersect("tx", "ty"))
    right = (F.slice("shared", 1, level) == F.col("s")) & (F.size("shared") / F.least("nx", "ny") >= threshold)
    return both.where(right).select("x", "y", (F.size("shared") / F.least("nx", "ny")).alias("overlap"))


def best_matches(new: DataFrame, existing: DataFrame, threshold: float = 0.7, earlier: bool = False) -> DataFrame:
    """For each new title the existing one it overlaps most; of equals, the earliest. Both: id, tokens. On request only those of smaller id."""
    best = _nearest(new, existing, 1, earlier).select(F.col("a").alias("new_id"), F.get("best", F.lit(0)).alias("m"))
    return best.select("new_id", F.col("m.b").alias("match_id"), (-F.col("m.less")).alias("overlap")).where(F.col("overlap") >= threshold)


def relevance(items: DataFrame, articles: DataFrame, k: int = 5) -> DataFrame:
    """The k articles whose titles share most with an item's topics, of equals those of smaller id; those that share nothing are left out. Both: id, tokens (distinct)."""
    rows = _nearest(items, articles, k).select(F.col("a").alias("item_id"), F.posexplode("best").alias("at", "m"))
    return rows.select("item_id", (F.col("at") + 1).alias("rank"), F.col("m.b").alias("article_id"), (-F.col("m.less")).alias("score"))


def _coded(sets: DataFrame, codes: DataFrame) -> DataFrame:
    """id, n (the set's size) and t, the codes of its tokens that have one, rarest first; sets without any are left out."""
    rows = sets.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(codes.select("token", "code"), "token")
    return rows.groupBy("id", "n").agg(F.sort_array(F.collect_list("code")).alias("t")).transform(written)


def _codes(frequency: DataFrame) -> DataFrame:
    """frequency with code: numbers that ascend with frequency."""
    return frequency.orderBy("f", "token").withColumn("code", F.monotonically_increasing_id()).transform(written)


def _longer(rows: DataFrame, last: Column) -> DataFrame:
    """rows (t, s, p) with s, of which the last is t's item p, longer by each later item of t as far as index last; those that were not longer go."""
    reach = F.when(F.col("p") < last, F.sequence(F.col("p") + 1, last))
    return rows.withColumn("p", F.explode(reach)).withColumn("s", F.concat("s", F.array(F.get("t", "p"))))


def _nearest(items: DataFrame, articles: DataFrame, k: int, earlier: bool = False) -> DataFrame:
    """(a, best): for each item that shares a token with an article the k articles of highest overlap, of equals those of smaller id; best has structs of less (the overlap, negative) and b."""
    return _seen(items, articles, k, earlier).groupBy("a").agg(F.slice(F.sort_array(F.array_distinct(F.collect_list("m"))), 1, k).alias("best"))


def _seen(items: DataFrame, articles: DataFrame, k: int, earlier: bool = False) -> DataFrame:
    """(a, m): the pairs that are made, some more than once; each item's k best are among them.

    Lists of articles by what they have in common. Tokens s that an article has list it, by its size and id. If s is all that an
    article shares with an item, others of its size on that list share as much or more; so unless it is among the first k of them, k
    others precede it in the result. It is then enough to see the first k by size of each list whose tokens an item has. Lists of
    no more than k are seen whole, and longer s need not be looked at; nor such that list the same articles as s without its last
    token. Work grows with the lists, and no pair of an item and an article that is not first on one is made.
    With earlier, only articles of smaller id than the item count: if the first on a list does not, no other does; k is 1 then.
    """
    codes = _codes(_frequency(articles))
    posts = _coded(articles, codes).select(F.col("id").alias("b"), F.col("n").alias("nb"), F.posexplode("t").alias("p", "code"), "t").select("b", "nb", "t", "p", F.array("code").alias("s"))
    asked = _coded(items, codes).select(F.col("id").alias("a"), F.col("n").alias("na"), F.posexplode("t").alias("p", "code"), "t").select("a", "na", "t", "p", F.array("code").alias("s"))
    end = F.size("t") - 1
    found, parents = None, None
    while True:
        posts = posts.transform(written)
        counted = posts.groupBy("s").agg(F.count(F.lit(1)).alias("m"))
        if parents is not None:
            shorter = parents.select(F.col("s").alias("_s"), F.col("m").alias("_m"))
            counted = counted.join(shorter, F.slice("s", F.lit(1), F.size("s") - 1) == F.col("_s")).where("m < _m").select("s", "m")
        counted = counted.transform(written)
        at = F.row_number().over(Window.partitionBy("s", "nb").orderBy("b"))
        heads = posts.withColumn("at", at).where(F.col("at") <= k).groupBy("s").agg(F.collect_list(F.struct("nb", "b", "t")).alias("heads"))
        lists = counted.join(heads, "s").transform(written)
        met = asked.join(lists, "s")
        scored = F.transform("heads", lambda h: F.struct((-F.size(F.array_intersect("t", h["t"])) / F.least("na", h["nb"])).alias("less"), h["b"].alias("b")))
        scored = F.filter(scored, lambda x: x["b"] < F.col("a")) if earlier else scored
        here = met.select("a", "na", "t", "p", "s", "m", F.slice(F.sort_array(scored), 1, k).alias("best")).transform(written)
        some = here.where(F.size("best") > 0).select("a", "best")
        found = some if found is None else found.union(some)
        parents = counted.where(F.col("m") > k)
        posts = _longer(posts.join(parents.select("s"), "s", "left_semi"), end).select("b", "nb", "t", "p", "s")
        asked = _longer(here.where(F.col("m") > k), end).select("a", "na", "t", "p", "s")
        if parents.isEmpty() or posts.isEmpty():
            break
    return found.select("a", F.explode("best").alias("m"))


def _merged_in_order(frame: pd.DataFrame, cap: int) -> pd.DataFrame:
    """A part's links taken one after another: for every group that is joined with another, where it goes and that group's size.

    A link that is not within the part may be taken or not, so nothing is done after it at the group it ends at, nor at any that a later
    link joins to that; unless the two pass the cap, as groups only grow.
    """
    frame = frame.sort_values(["overlap", "i", "j"], ascending=False)
    waits: set[int] = set()
    size: dict[int, int] = {}
    into: dict[int, int] = {}

    def top(x: int) -> int:
        while x in into:
            x = into[x]
        return x

    for a, na, b, nb, within in zip(*(frame[c].tolist() for c in ("a", "na", "b", "nb", "within")), strict=True):
        size.setdefault(a, na)
        size.setdefault(b, nb)
        x, y = sorted((top(a), top(b)))
        if x == y or size[x] + size[y] > cap:
            continue
        if not within or x in waits or y in waits:
            waits |= {x, y}
            continue
        into[y] = x
        size[x] += size[y]
    ends = {g: top(g) for g in into}
    ends |= {g: g for g in ends.values()}
    return pd.DataFrame({"g": list(ends), "to": list(ends.values()), "n": [size[g] for g in ends.values()]}, dtype="int64")


def cluster(pairs: DataFrame, sets: DataFrame, cap: int = 8, in_task: int = 500_000) -> DataFrame:
    """Groups of at most cap, strongest links first: what taking all links in descending order of (overlap, i, j) would give.

    A round has a task take the strongest in_task or so of the links that are left, in order; then all links are led to the groups they
    now join, of those between two groups the strongest stays, and those within a group or between groups that together pass the cap
    go, as groups only grow. Where texts have many links most groups are full after the first, so few of the rest are left to any task.
    """
    ensure_checkpoint_dir(pairs.sparkSession)
    one = F.lit(1)
    edges = pairs.select(F.col("i").alias("a"), one.alias("na"), F.col("j").alias("b"), one.alias("nb"), F.struct("overlap", "i", "j").alias("s")).where(F.lit(cap) >= 2).transform(written)
    labels = sets.select("id", F.col("id").alias("group_id"))
    while (first := _strongest(edges, in_task)) is not None:
        links = edges.where(first).select(F.lit(0).alias("part"), "a", "na", "b", "nb", F.lit(True).alias("within"), "s.*")
        moved = links.groupBy("part").applyInPandas(lambda frame: _merged_in_order(frame, cap), "g long, to long, n long").transform(written)
        labels = labels.join(moved.select(F.col("g").alias("group_id"), "to"), "group_id", "left").select("id", F.coalesce("to", "group_id").alias("group_id")).transform(written)
        left = edges.where(~first)
        for x, n in (("a", "na"), ("b", "nb")):
            left = left.join(moved.toDF(x, "to", "n"), x, "left").withColumns({x: F.coalesce("to", x), n: F.coalesce("n", n)}).drop("to", "n")
        left = left.where((F.col("a") != F.col("b")) & (F.col("na") + F.col("nb") <= cap))
        turned = F.col("a") > F.col("b")
        left = left.select(F.least("a", "b").alias("a"), F.when(turned, F.col("nb")).otherwise(F.col("na")).alias("na"), F.greatest("a", "b").alias("b"), F.when(turned, F.col("na")).otherwise(F.col("nb")).alias("nb"), "s")
        edges = left.groupBy("a", "na", "b", "nb").agg(F.max("s").alias("s")).transform(written)
    return labels


def _strongest(edges: DataFrame, n: int) -> Column | None:
    """What the first n or so of edges by descending (overlap, i, j) of s meet, and all with the last one's overlap and i; nothing if there are none."""
    levels = edges.groupBy("s.overlap").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("overlap")).collect()  # as many as sizes of sets give fractions
    whole, taken = None, 0
    for level in levels:
        if taken + level["c"] > n:
            here = F.col("s.overlap") == level["overlap"]
            least = edges.where(here).agg(F.percentile_approx("s.i", 1 - (n - taken) / level["c"])).first()[0]
            some = here & (F.col("s.i") >= least)
            return some if whole is None else whole | some
        taken += level["c"]
        whole = F.col("s.overlap") >= level["overlap"]
    return whole


def elect(titles: DataFrame, threshold: float = 0.7) -> DataFrame:
    """First writer wins. Items (id, tokens) in order of id; one is kept unless it overlaps an already kept one.

    Equal token sets stand or fall with the first of them, so only firsts are paired. Each round keeps the sets that no
    undecided earlier one overlaps and drops those these overlap; its result is checkpointed. A chain in which each set overlaps
    just the next takes a round for every second link.
    """
    ensure_checkpoint_dir(titles.sparkSession)
    rows = titles.select("id", F.array_sort(F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>")))).alias("tokens"))
    firsts = rows.where(F.size("tokens") > 0).groupBy("tokens").agg(F.min("id").alias("first")).transform(written)
    pairs = overlap_pairs(firsts.select(F.col("first").alias("id"), "tokens"), threshold).transform(written)
    left, lost = pairs.select("i", "j"), pairs.select("j").limit(0)
    while not left.isEmpty():
        held = left.select("i").distinct().join(left.select(F.col("j").alias("i")), "i", "left_anti")
        out = left.join(held, "i", "left_semi").select("j").distinct().transform(written)
        left = left.join(out, "j", "left_anti").join(out.toDF("i"), "i", "left_anti").transform(written)
        lost = lost.union(out).transform(written)
    ends = pairs.select(F.col("i").alias("first"), F.col("j").alias("to"), "overlap").union(pairs.select("j", "i", "overlap"))
    near = ends.join(lost.toDF("first"), "first", "left_semi").join(lost.toDF("to"), "to", "left_anti").groupBy("first", "overlap").agg(F.min("to").alias("to"))
    best = near.groupBy("first").agg(F.array_sort(F.collect_list(F.struct((-F.col("overlap")).alias("less"), "to"))).alias("near"))
    earlier = F.get(F.filter("near", lambda x: x["to"] < F.col("id")), F.lit(0))["to"]
    out = rows.join(firsts.join(best, "first", "left"), "tokens", "left").select("id", F.when(F.col("near").isNotNull(), earlier).otherwise(F.coalesce("first", "id")).alias("merged_into"))
    return out.select("id", (F.col("id") == F.col("merged_into")).alias("kept"), "merged_into")


def ensure_checkpoint_dir(spark) -> None:
    import re
    import tempfile

    if spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    elif not spark.sparkContext.getCheckpointDir():
        if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors of their own
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillmill-"))
