"""Extras read from the specification: loops, prior work, and weekly figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.state import settle
from .similarity import Fold, Similar, _ranges, salted_join


def loops(turns: DataFrame, *, by="session_id", key="tool_name", time="timestamp", times=3, seconds=600) -> DataFrame:
    """Turns at which the same key was seen `times` or more within the last `seconds`."""
    w = Window.partitionBy(by, key).orderBy(F.col("_at")).rangeBetween(-seconds * 1_000_000, 0)
    rows = turns.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn("_at", F.unix_micros(time))
    return rows.withColumn("seen", F.count("*").over(w)).filter(F.col("seen") >= times).drop("_at")


def _seen(placed: DataFrame) -> DataFrame:
    """rep, place, since, other (a class's first row in a place), until (its last one's time) of rows (id, rep, at, place)."""
    seen = placed.filter("at is not null and place is not null").groupBy("rep", "place").agg(F.min(F.struct("at", "id")).alias("first"), F.max("at").alias("until"))
    return seen.select("rep", "place", F.col("first.at").alias("since"), F.col("first.id").alias("other"), "until")


def works(rows: DataFrame, *, n=3, same="project") -> Fold:
    """For similar(), with the same `rows` and options as prior_work(): of the works that two blocks hold for a class in a place only those go that may be among its best. What `n` better
    ones precede for all rows of the class is left out; cosines within two millionths count as equal."""
    placed = rows.select("id", F.col("started_at").alias("at"), F.col(same).alias("place"))
    kind, place = (placed.schema[c].dataType.simpleString() for c in ("id", "place"))

    def carry(members: DataFrame) -> DataFrame:
        entry = F.struct("place", F.unix_micros("since").alias("since"), F.unix_micros("until").alias("until"), "other")
        return _seen(members.join(placed.hint("merge"), "id")).groupBy(F.col("rep").alias("id")).agg(F.collect_list(entry).alias("carried"))

    def run(ids, carried, others, carried2, i, j, sim):
        import numpy as np
        import pyarrow as pa

        def opened(column):
            whole = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
            size = np.asarray(whole.value_lengths().fill_null(0)).astype(np.int64)
            flat = whole.flatten()
            return size, np.cumsum(size) - size, np.repeat(np.arange(len(size)), size), flat, *(np.asarray(flat.field(c)) for c in ("since", "until"))

        one, two = opened(carried), opened(carried2)
        places = [x[3].field("place") for x in (one, two)]
        code = np.asarray(pa.concat_arrays(places).dictionary_encode().indices).astype(np.int64)
        code, other_code, many = code[: len(places[0])], code[len(places[0]) :], 1 + int(code.max(initial=0))
        # of each pair each place of the one, and the same place of the other
        pair, e = np.repeat(np.arange(len(i)), one[0][i]), _ranges(one[1][i], one[0][i])
        key = two[2] * many + other_code
        order = np.argsort(key, kind="stable")
        wanted = j[pair] * many + code[e]
        at = np.searchsorted(key[order], wanted)
        hit = np.flatnonzero(np.append(key[order], -1)[at] == wanted)
        pair, e, f = pair[hit], e[hit], order[at[hit]]
        out = []
        for names, own, x, work, y in ((ids, e, one, f, two), (others, f, two, e, one)):
            early, cosine = y[4][work] < x[4][own], sim[pair]
            some = np.flatnonzero(early)
            some = some[np.lexsort((-cosine[some], own[some]))]
            first = np.flatnonzero(np.diff(own[some], prepend=-1))
            last = first + n - 1
            full = last < np.append(first[1:], len(some))
            least = np.full(len(x[3]), -np.inf)
            least[own[some[first[full]]]] = cosine[some[last[full]]]
            keep = np.flatnonzero((y[4][work] < x[5][own]) & (cosine >= least[own] - 2e-6))
            own, work = own[keep], work[keep]
            columns = [names.take(pa.array(x[2][own])), x[3].field("place").take(pa.array(own)), cosine[keep], y[4][work], y[3].field("other").take(pa.array(work)), early[keep]]
            out.append(pa.table(dict(zip(("rep", "place", "sim", "begun", "other", "early"), columns, strict=True))))
        return pa.concat_tables(out)

    return Fold(carry, run, f"rep {kind}, place {place}, sim double, begun long, other {kind}, early boolean")


def _met(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """rep, place, sim, since, other, early of pairs (a, b, sim). A pair travels once, to the one class and then to the other; it becomes works only where the class has a row later than the other's first."""
    one, two = seen.toDF("a", "place", "since", "other", "until"), seen.toDF("b", "place", "since2", "other2", "until2")
    # to the first class a pair goes as an entry of two lists, its cosine in millionths
    near = pairs.select("a", "b", F.round(F.round("sim", 6) * 1e6).cast("int").alias("k")).groupBy("a").agg(F.collect_list("b").alias("bs"), F.collect_list("k").alias("ks"))
    near = near.join(one.hint("merge"), "a").select("a", "place", "since", "other", "until", F.explode(F.arrays_zip("bs", "ks")).alias("x"))
    both = near.select("a", "place", "since", "other", "until", F.col("x.bs").alias("b"), F.col("x.ks").alias("k")).join(two.hint("merge"), ["b", "place"]).withColumn("sim", F.col("k") / F.lit(1e6))
    work = lambda rep, since, other, begun, until: F.struct(F.col(rep).alias("rep"), F.col(since).alias("since"), F.col(other).alias("other"), F.col(begun).alias("begun"), F.col(until).alias("until"))
    ways = F.filter(F.array(work("a", "since2", "other2", "since", "until"), work("b", "since", "other", "since2", "until2")), lambda x: x["since"] < x["until"])
    return both.select("place", "sim", F.explode(ways).alias("w")).select("w.rep", "place", "sim", "w.since", "w.other", (F.col("w.since") < F.col("w.begun")).alias("early"))


def prior_work(found: Similar, rows: DataFrame, *, n=3, same="project") -> DataFrame:
    """id, other, sim, rank: for each of `rows` (id, started_at, project) the most similar earlier work of the same project, cosines rounded to six digits, ties to smaller ids.
    Equal texts count once, by the first of them in the project: so a text that many rows copy is one piece of work, and no row meets its copies.

    `found`: of similar(), with all pairs or with works() of the same rows and options. Of works that all rows of a class may
    see the best `n` suffice; of the rest a work goes that `n` better ones precede. So rows meet few works.
    """
    placed = settle(found.members.join(rows.select("id", F.col("started_at").alias("at"), F.col(same).alias("place")).hint("merge"), "id"))
    seen = _seen(placed)
    if "early" in found.pairs.columns:
        sim = F.round(F.round("sim", 6) * 1e6).cast("int") / F.lit(1e6)
        works = settle(found.pairs.select("rep", "place", sim.alias("sim"), F.timestamp_micros("begun").alias("since"), "other", "early"))
    else:
        works = _met(found.pairs, seen)
    order = (F.desc("sim"), "other")
    early = works.filter("early").withColumn("k", F.row_number().over(Window.partitionBy("rep", "place").orderBy(*order))).filter(F.col("k") <= n)
    own = seen.filter("since < until").select("rep", "place", F.lit(1.0).alias("sim"), "since", "other")
    named = ("rep", "place", "sim", "since", "other")
    line = F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("far"), "other", "since")))
    late = works.filter("not early").select(*named).union(own).groupBy("rep", "place").agg(line.alias("line"))
    none = F.filter("line", lambda x: F.lit(False))

    def add(s, x):  # low: the `n` earliest times of those before
        wanted = F.coalesce(x["since"] < F.get(s["low"], F.lit(n - 1)), F.lit(True))
        return F.when(wanted, F.struct(F.concat(s["kept"], F.array(x)).alias("kept"), F.slice(F.array_sort(F.concat(s["low"], F.array(x["since"]))), 1, n).alias("low"))).otherwise(s)

    kept = F.aggregate("line", F.struct(none.alias("kept"), F.transform(none, lambda x: x["since"]).alias("low")), add)["kept"]
    late = late.select("rep", "place", F.explode(kept).alias("w")).select("rep", "place", (-F.col("w.far")).alias("sim"), "w.since", "w.other")
    met = salted_join(placed, settle(early.select(*named).union(late)), ["rep", "place"]).filter("since < at")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= n).select("id", "other", "sim", "rank")


def own_works(rows: DataFrame, *, n=1) -> Fold:
    """As works(), for own_solutions()."""
    return works(rows.filter("released"), n=n, same="actor")


def own_solutions(found: Similar, rows: DataFrame, *, n=1) -> DataFrame:
    """As prior_work(), among an actor's own released rows."""
    return prior_work(found, rows.filter("released"), n=n, same="actor")


def stuck(turns: DataFrame, *, by="session_id", times=3) -> DataFrame:
    """Sessions in which the same tool failed `times` or more."""
    return turns.filter(F.col("error").isNotNull()).groupBy(by, "tool_name").agg(F.count("*").alias("errors")).filter(F.col("errors") >= times)


def helpers(stuck: DataFrame, sessions: DataFrame, compactions: DataFrame, *, n=2, by="session_id") -> DataFrame:
    """by, tool_name, helper, rank: for each stuck session the newest `n` released compactions of the same org and project by other people. `sessions`: by, actor, org_id,
    project; `compactions`: id, actor, org_id, project, started_at, released.

    Of each project only the newest `n` of each of the first `n` + 1 people are met, so no stuck session meets a whole project.
    """
    place = ["org_id", "project"]
    newest = (F.desc("started_at"), "helper")
    rows = compactions.filter("released").select("org_id", "project", F.col("actor").alias("other"), F.col("id").alias("helper"), "started_at")
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*place, "other").orderBy(*newest))).filter(F.col("_r") <= n)
    # the newest n rows of others are held by the n + 1 people who come first
    people = rows.filter("_r = 1").withColumn("_p", F.row_number().over(Window.partitionBy(*place).orderBy(*newest))).filter(F.col("_p") <= n + 1)
    rows = rows.join(people.select(*place, "other").hint("merge"), [*place, "other"], "left_semi")
    asked = stuck.select(by, "tool_name").join(sessions.select(by, "actor", *place).hint("merge"), by)
    met = asked.join(rows.drop("_r").hint("merge"), place).filter(F.col("other") != F.col("actor"))
    line = Window.partitionBy(by, "tool_name").orderBy(*newest)
    return met.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= n).select(by, "tool_name", "helper", "rank")


def weekly(rows: DataFrame, *, by: tuple[str, ...], time="started_at", cost="est_cost_usd") -> DataFrame:
    """by, week (its first day, Thursdays by the epoch), sessions, contributors, cost."""
    week = F.window(F.col(time), "7 days")["start"].alias("week")
    return rows.groupBy(*by, week).agg(F.count("*").alias("sessions"), F.count_distinct("actor").alias("contributors"), F.round(F.sum(cost), 2).alias("cost"))


def cost_jumps(weeks: DataFrame, *, by: tuple[str, ...], factor=2.0) -> DataFrame:
    """Weeks that cost `factor` times the one before or more ; a week after one without rows is no jump."""
    order = Window.partitionBy(*by).orderBy("week")
    before = F.when(F.lag("week").over(order) == F.col("week") - F.expr("interval 7 days"), F.lag("cost").over(order))
    return weeks.withColumn("before", before).filter(F.col("cost") >= factor * F.col("before"))


def cost_trend(weeks: DataFrame, *, by: tuple[str, ...]) -> DataFrame:
    """by, weeks, total, slope, mean: the line through the weekly costs of weekly(), from a group's first week to its last; a week without rows costs nothing and counts. The slope is
    the change a week; a single week has none. A group's weeks are as many as the calendar has, however many rows there are."""
    one = "interval 7 days"
    ends = weeks.groupBy(*by).agg(F.min("week").alias("first"), F.max("week").alias("last"))
    spine = ends.select(*by, F.posexplode(F.sequence("first", "last", F.expr(one))).alias("x", "week"))
    on = F.lit(True)
    for c in by:
        on = on & F.col(f"s.{c}").eqNullSafe(F.col(f"w.{c}"))
    filled = spine.alias("s").join(weeks.alias("w").hint("merge"), on & (F.col("s.week") == F.col("w.week")), "left")
    rows = filled.select(*[F.col(f"s.{c}").alias(c) for c in by], F.col("s.x").cast("double").alias("x"), F.coalesce("w.cost", F.lit(0.0)).alias("cost"))
    return rows.groupBy(*by).agg(F.count("*").alias("weeks"), F.round(F.sum("cost"), 2).alias("total"), F.round(F.regr_slope("cost", "x"), 4).alias("slope"), F.round(F.avg("cost"), 4).alias("mean"))
