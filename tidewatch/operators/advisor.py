"""Index advice over (query, config, cost) tables, and causes of slow statements."""

from __future__ import annotations

import math
import random
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.sources.store import cut, shared_folder, shuffled


def redundant_indexes(indexes: DataFrame, table: str = "table_name", columns: str = "columns", unique: str | None = None) -> DataFrame:
    """Indexes whose columns are the beginning of another's on the same table.

    Sorted by columns, an index is redundant if the next one continues it.
    """
    following = F.lead(columns).over(Window.partitionBy(table).orderBy(columns))
    out = indexes.withColumn("covered_by", following).where(F.startswith(F.col("covered_by"), F.concat(columns, F.lit(","))))
    return out.where(~F.col(unique)) if unique else out


def distinct_types(indexes: DataFrame) -> DataFrame:
    """``indexes`` (table_name, columns, index_type, benefit) without those that another type makes redundant.

    In order of columns, then of type, an index whose columns are the beginning of the next one's, or all
    of them, meets it: the one of less benefit goes; of equal ones the next if the first is global, else the
    first. What stays meets the one after. A table's candidates are one row, folded once.
    """
    found = F.struct("columns", "index_type", "benefit")
    begins = lambda a, b: F.startswith(F.concat(b["columns"], F.lit(",")), F.concat(a["columns"], F.lit(",")))
    kept = "array<struct<columns:string,index_type:string,benefit:double>>"

    def meet(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        stays = F.when(last["benefit"] == x["benefit"], last["index_type"] == "global").otherwise(last["benefit"] > x["benefit"])
        swapped = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(x))
        return F.when((F.size(acc) == 0) | ~begins(F.try_element_at(acc, F.lit(-1)), x), F.concat(acc, F.array(x))).when(stays, acc).otherwise(swapped)

    listed = F.array_sort(F.collect_list(found)).cast(kept)
    each = indexes.groupBy("table_name").agg(listed.alias("_all"))
    folded = F.aggregate(F.slice("_all", F.lit(2), F.greatest(F.size("_all") - 1, F.lit(0))), F.slice("_all", 1, 1), meet)
    return each.select("table_name", F.explode(folded).alias("i")).select("table_name", "i.*")


def workload_cost(cost: DataFrame) -> DataFrame:
    return cost.groupBy("config_id").agg(F.sum(F.col("cost") * F.col("freq")).alias("cost"))


def infer_benefit(cost: DataFrame, members: DataFrame, origin: int = 0) -> DataFrame:
    """(set_id, cost): a set of configurations costs each query the least of its members' costs, or its plain cost."""
    plain = cost.where(F.col("config_id") == origin).select("query_id", "freq", F.col("cost").alias("_plain"))
    best = cost.join(members, "config_id").groupBy("set_id", "query_id").agg(F.min("cost").alias("_best"))
    saved = best.join(plain, "query_id").select("set_id", (F.greatest(F.col("_plain") - F.col("_best"), F.lit(0.0)) * F.col("freq")).alias("_saved"))
    total = plain.agg(F.sum(F.col("_plain") * F.col("freq")).alias("_all"))  # one row
    return saved.groupBy("set_id").agg(F.sum("_saved").alias("_saved")).crossJoin(F.broadcast(total)).select("set_id", (F.col("_all") - F.col("_saved")).alias("cost"))


def coverage(cost: DataFrame, origin: int = 0) -> DataFrame:
    """(any_of array, saved): what the workload saves once a set has one of ``any_of``; a set's savings are the sum over all that it meets.

    A query with the savings s1 >= s2 >= ... of its configurations saves s1 - s2 if a set has the first of them,
    s2 - s3 more if it has one of the first two, and so on: in all, the most that a member of the set saves.
    Queries with the same order of configurations are summed up, so the table does not grow with the workload, but
    with the number of orders that occur.
    """
    saved = F.struct(F.col("saved"), F.col("config_id").alias("id"))
    plain = cost.where(F.col("config_id") == origin).select("query_id", "freq", F.col("cost").alias("_plain"))
    each = cost.where(F.col("config_id") != origin).select("query_id", "config_id", "cost").join(plain, "query_id")
    helps = each.select("query_id", "config_id", ((F.col("_plain") - F.col("cost")) * F.col("freq")).alias("saved")).where("saved > 0")
    most = helps.groupBy("query_id", "config_id").agg(F.max("saved").alias("saved"))
    ranked = most.groupBy("query_id").agg(F.sort_array(F.collect_list(saved), asc=False).alias("s"))
    rest = lambda i: F.coalesce(F.try_element_at("s", i + 2)["saved"], F.lit(0.0))
    first = lambda i: F.array_sort(F.transform(F.slice("s", F.lit(1), i + 1), lambda x: x["id"]))
    steps = F.transform("s", lambda x, i: F.struct(first(i).alias("any_of"), (x["saved"] - rest(i)).alias("saved")))
    return ranked.select(F.explode(steps).alias("x")).select("x.*").where("saved > 0").groupBy("any_of").agg(F.sum("saved").alias("saved"))


def greedy(cost: DataFrame, most: int, storage: dict[int, float] | None = None, room: float = math.inf, origin: int = 0) -> list[int]:
    """Configurations chosen one after the other by what each adds; every round is one aggregate over the cost table."""
    chosen: list[int] = []
    current = cost.where(F.col("config_id") == origin).select("query_id", "freq", F.col("cost").alias("_now"))
    while len(chosen) < most and room >= 0:
        wide = [c for c, size in (storage or {}).items() if size > room]
        gain = cost.join(current.drop("freq"), "query_id").where(~F.col("config_id").isin([origin, *chosen, *wide])).groupBy("config_id").agg(F.sum(F.greatest(F.col("_now") - F.col("cost"), F.lit(0.0)) * F.col("freq")).alias("gain"))
        # One row a configuration that fits the room that is left; the others are no candidates any more.
        best = gain.where("gain > 0").orderBy(F.col("gain").desc(), "config_id").first()
        if best is None:
            break
        fitting = best["config_id"]
        chosen.append(fitting)
        room -= (storage or {}).get(fitting, 0)
        step = cost.where(F.col("config_id") == fitting).select("query_id", F.col("cost").alias("_new"))
        current = cut(current.join(step, "query_id", "left").select("query_id", "freq", F.least("_now", F.coalesce("_new", "_now")).alias("_now")))
    return chosen


def tree_search(benefit, items: list[int], size: dict[int, float], room: float, rounds: int = 200, seed: int = 0) -> tuple[list[int], float]:
    """Monte-Carlo tree search for a set of items within ``room`` that has the most ``benefit`` (a function of a set).

    A set below which all is seen is not entered again, so the result is exact if ``rounds`` is twice the number of
    sets that fit, and the search ends early.
    """
    rng = random.Random(seed)
    visits: dict[frozenset, int] = {}
    worth: dict[frozenset, float] = {}
    seen: set[frozenset] = set()
    best: tuple[float, frozenset] = (benefit(frozenset()), frozenset())

    def options(state: frozenset) -> list[int]:
        used = sum(size[i] for i in state)
        return [i for i in items if i not in state and used + size[i] <= room]

    for _ in range(rounds):
        if frozenset() in seen:
            break
        state, path = frozenset(), [frozenset()]
        while children := [c for i in options(state) if (c := state | {i}) not in seen]:
            fresh = [c for c in children if c not in visits]
            total = math.log(visits.get(state, 1) + 1)
            state = rng.choice(fresh) if fresh else max(children, key=lambda c: worth[c] / visits[c] + math.sqrt(2 * total / visits[c]))
            path.append(state)
            if fresh:
                break
        end = state
        while choices := options(end):
            end = end | {rng.choice(choices)}
        for leaf in (state, end):
            best = max(best, (benefit(leaf), leaf), key=lambda b: (b[0], -len(b[1])))
        value = benefit(end)
        for p in path:
            visits[p] = visits.get(p, 0) + 1
            worth[p] = worth.get(p, 0.0) + value
        for p in reversed(path):
            if all(p | {i} in seen for i in options(p)):
                seen.add(p)
    return sorted(best[1]), best[0]


def _descend(rng: random.Random, size: dict[int, float], room: float, visits: dict, worth: dict, seen: set) -> tuple[list[tuple], tuple]:
    """One walk down the tree of sets, by upper confidence bound to the first set not visited yet, and a random way on until nothing fits."""

    def options(state: tuple) -> list[int]:
        left = room - sum(size[i] for i in state)
        return [i for i in size if i not in state and size[i] <= left]

    state, path = (), [()]
    while children := [c for i in options(state) if (c := tuple(sorted((*state, i)))) not in seen]:
        fresh = [c for c in children if c not in visits]
        total = math.log(visits.get(state, 1) + 1)
        state = rng.choice(fresh) if fresh else max(children, key=lambda c: worth[c] / visits[c] + math.sqrt(2 * total / visits[c]) * rng.random())
        path.append(state)
        if fresh:
            break
    end = state
    while choices := options(end):
        end = tuple(sorted((*end, rng.choice(choices))))
    return path, end


def search_sets(cost: DataFrame, size: dict[int, float], room: float, rounds: int = 12, walks: int = 2048, seed: int = 0, origin: int = 0) -> tuple[list[int], float]:
    """(configurations, benefit): the set within ``room`` that saves the workload most, by tree search with many walks at once.

    In each round ``walks`` rows, a seed each, walk down the tree of sets by its statistics so far;
    the sets they reach are priced in one job by coverage(), which sums the workload up once, so configurations that
    help the same statement do not add up. The driver keeps the tree's statistics (``rounds * walks`` sets at most)
    and nothing of the workload. A set below which all is seen is not entered again, and the search ends
    when that holds for the empty set: then the answer is exact. Of equal benefits the smaller set, then the first.
    """
    spark = cost.sparkSession
    items = sorted(size)
    all_cost = cost.where(F.col("config_id") == origin).agg(F.coalesce(F.sum(F.col("cost") * F.col("freq")), F.lit(0.0))).first()[0]
    gain: dict[tuple, float] = {(): 0.0}
    visits: dict[tuple, int] = {}
    worth: dict[tuple, float] = {}
    seen: set[tuple] = set()
    scale = max(all_cost, 1e-9)
    covers = cut(coverage(cost, origin).withColumn("any_of", F.col("any_of").cast("array<int>")))

    def fits(state: tuple) -> list[tuple]:
        left = room - sum(size[i] for i in state)
        return [tuple(sorted((*state, i))) for i in items if i not in state and size[i] <= left]

    for k in range(rounds):
        if () in seen:
            break
        known = (dict(size), room, dict(visits), dict(worth), set(seen))

        def walked(batches, known=known, k=k):
            import pandas as pd

            for pdf in batches:
                found = [_descend(random.Random(f"{seed}/{k}/{i}"), *known) for i in pdf["id"]]
                yield pd.DataFrame({"path": [[list(p) for p in path] for path, _ in found], "last": [list(end) for _, end in found]})

        # A row for each walk, with the sets on its way: as many as its parameters say.
        ways = [([tuple(p) for p in r["path"]], tuple(r["last"])) for r in spark.range(walks).mapInPandas(walked, "path array<array<int>>, last array<int>").collect()]
        new = sorted({x for path, last in ways for x in (*path, last)} - set(gain))
        if new:
            sets = spark.createDataFrame([(list(x),) for x in new], "set_id array<int>")  # as many rows as the round has reached sets
            met = covers.join(F.broadcast(sets), F.arrays_overlap("any_of", "set_id"))
            # Decimals add up alike in any order, so sets that save the same stay equal.
            saved = met.groupBy("set_id").agg(F.sum(F.col("saved").cast("decimal(38,6)")).alias("saved"))
            gain |= {x: 0.0 for x in new} | {tuple(r["set_id"]): float(r["saved"]) for r in saved.collect()}
        for path, last in ways:
            for p in path:
                visits[p] = visits.get(p, 0) + 1
                worth[p] = worth.get(p, 0.0) + gain[last] / scale
        for p in sorted({p for path, _ in ways for p in path}, key=len, reverse=True):
            if all(c in seen for c in fits(p)):
                seen.add(p)
    best = max(gain, key=lambda x: (round(gain[x], 6), -len(x), tuple(-i for i in x)))
    return list(best), gain[best]


def index_report(cost: DataFrame, origin: int = 0) -> DataFrame:
    """(config_id, improved, worsened, total, improvement): what each configuration does to the workload."""
    plain = cost.where(F.col("config_id") == origin).select("query_id", F.col("cost").alias("_plain"))
    each = cost.where(F.col("config_id") != origin).join(plain, "query_id")
    n = lambda c: F.sum(F.when(c, F.col("freq")).otherwise(0))
    return each.groupBy("config_id").agg(
        n(F.col("cost") < F.col("_plain")).alias("improved"), n(F.col("cost") > F.col("_plain")).alias("worsened"), F.sum("freq").alias("total"),
        (1 - F.sum(F.col("cost") * F.col("freq")) / F.sum(F.col("_plain") * F.col("freq"))).alias("improvement"),
    )


# --- causes of slow statements; their features are in causes.py ----------------------------------


def nearest_causes(df: DataFrame, key: str, library: DataFrame, most: int = 10_000) -> DataFrame:
    """(key, label, probability): the best score of each label over the library's rows, as shares of all scores.

    ``library`` has label, pattern array<int> and weight array<double>; a score adds the weights of
    the features that both have. The library is broadcast, once it is counted to have at most ``most`` rows.
    """
    from tidewatch.operators.results import bounded

    shared = F.zip_with(F.zip_with("features", "pattern", lambda a, b: a * b), "weight", lambda x, w: x * w)
    scored = df.select(key, "features").crossJoin(bounded(library, most, "rows in the library")).select(key, "label", F.aggregate(shared, F.lit(0.0), lambda a, x: a + x).alias("_s"))
    best = scored.groupBy(key, "label").agg(F.max("_s").alias("_s")).where("_s > 0")
    return best.select(key, "label", (F.col("_s") / F.sum("_s").over(Window.partitionBy(key))).alias("probability"))


#: Kinds and patterns that one task compares.
CHUNK = 2048


def _best_scores(asked: pa.Table, told: pa.Table) -> pa.Table:
    """(key, label, score): of each asked row and label the best score over the told patterns, where it is above zero."""
    if not asked.num_rows or not told.num_rows:
        return pa.table({"key": asked["key"].slice(0, 0), "label": told["label"].slice(0, 0), "score": pa.array([], pa.float64())})
    table = lambda x: x.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
    labels = told["label"].combine_chunks().dictionary_encode(null_encoding="encode")
    order = np.argsort(codes := labels.indices.to_numpy(), kind="stable")
    kinds, starts = np.unique(codes[order], return_index=True)
    scores = table(asked["features"]) @ (table(told["pattern"]) * table(told["weight"]))[order].T
    best = np.fmax.reduceat(scores, starts, axis=1)  # NaN, where a weight is missing, is no score
    row, column = np.nonzero(best > 0)
    return pa.table({"key": asked["key"].take(pa.array(row)), "label": labels.dictionary.take(pa.array(kinds[column])), "score": best[row, column]})


def kind_causes(kinds: DataFrame, key: str, library: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """What nearest_causes() returns, for many different ``features`` and a library of any size.

    Both are dealt into chunks of about ``chunk`` rows; each chunk of kinds meets each of the library in a task, as
    matrices, and passes on the best score of a kind for each label. All pairs are scored, and no table is in one place.
    """
    kinds, library = cut(kinds.select(F.col(key).alias("key"), "features")), cut(library.select("label", "pattern", "weight"))
    a, b = (max(1, -(-df.count() // chunk)) for df in (kinds, library))
    deal = lambda by, n: F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Arrays of unequal length have no score together.
    asked = kinds.select("key", "features", F.size("features").alias("n"), deal("features", a).alias("a"), each(b).alias("b"))
    told = library.where("size(pattern) = size(weight)").select("label", "pattern", "weight", F.size("pattern").alias("n"), deal("pattern", b).alias("b"), each(a).alias("a"))
    met = asked.where("n > 0").groupBy("n", "a", "b").cogroup(told.where("n > 0").groupBy("n", "a", "b"))
    types = dict(kinds.dtypes)["key"], dict(library.dtypes)["label"]
    scored = met.applyInArrow(_best_scores, f"key {types[0]}, label {types[1]}, score double")
    best = scored.groupBy("key", "label").agg(F.max("score").alias("_s"))
    return best.select(F.col("key").alias(key), "label", (F.col("_s") / F.sum("_s").over(Window.partitionBy("key"))).alias("probability"))


def label_weights(library: DataFrame) -> DataFrame:
    """(label, weight array<double>): how far each label's summed pattern lies from what the other labels suggest, as shares.

    What they suggest is the sum of their patterns over their squared distances, divided by the sum
    of those squares. Two labels with the same sums have no distance, and get no weights (NULL).
    """
    items = library.select("label", F.posexplode("pattern").alias("i", "x"))
    sums = items.groupBy("label", "i").agg(F.sum("x").cast("double").alias("v"))
    # As many rows as labels times features: the labels' patterns are summed up already.
    both = sums.join(sums.select(F.col("label").alias("other"), "i", F.col("v").alias("u")), "i").where("label <> other")
    apart = both.groupBy("label", "other").agg(F.nullif(F.sum((F.col("v") - F.col("u")) ** 2), F.lit(0.0)).alias("d"))
    scale = apart.groupBy("label").agg(F.sum("d").alias("n"))
    suggested = both.join(apart, ["label", "other"]).groupBy("label", "i").agg(F.sum(F.col("u") / F.col("d")).alias("s"))
    rest = sums.join(suggested, ["label", "i"]).join(scale, "label").withColumn("r", F.abs(F.col("s") / F.col("n") - F.col("v")))
    share = rest.select("label", "i", (F.col("r") / F.nullif(F.sum("r").over(Window.partitionBy("label")), F.lit(0.0))).alias("w"))
    return share.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda s: s["w"]).alias("weight"))


def _shares(predicates: DataFrame) -> DataFrame:
    """(query_id, shares): each query's columns with the share of rows that its condition on them leaves."""
    by_column = predicates.groupBy("query_id", "column").agg(F.min("share").alias("share"))
    return by_column.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("column", "share"))).alias("shares"))


def _indexed_rows(columns: Column) -> Column:
    """Rows that an index leaves of a query's: its leading columns help up to the first one that the query has no condition on."""
    start = F.struct(F.lit(1.0).alias("share"), F.lit(True).alias("on"))
    step = lambda a, c: F.struct(F.when(a["on"] & F.col("shares")[c].isNotNull(), a["share"] * F.col("shares")[c]).otherwise(a["share"]).alias("share"), (a["on"] & F.col("shares")[c].isNotNull()).alias("on"))
    return F.greatest(F.lit(1.0), F.col("rows") * F.aggregate(columns, start, step, lambda a: a["share"]))


def cost_table(queries: DataFrame, predicates: DataFrame, indexes: DataFrame, upkeep: float = 0.1) -> DataFrame:
    """(query_id, config_id, cost, freq): a simple model of costs, for where no database can be asked.

    ``queries`` has (query_id, table_name, freq, rows, writes boolean), ``predicates`` (query_id, column,
    share), ``indexes`` (config_id, table_name, columns array). A query costs the rows it reads, by a scan
    (configuration 0) or by an index on its table; a writing one also ``upkeep`` of its rows for the index.
    """
    asked = queries.join(_shares(predicates), "query_id", "left")
    plain = asked.select("query_id", F.lit(0).alias("config_id"), F.col("rows").alias("cost"), "freq")
    paid = F.when(F.col("writes"), F.col("rows") * upkeep).otherwise(0.0)
    return plain.unionByName(asked.join(indexes, "table_name").select("query_id", "config_id", (_indexed_rows(F.col("columns")) + paid).alias("cost"), "freq"))


def grown_candidates(queries: DataFrame, predicates: DataFrame, most: int = 5, least: float = 0.05) -> DataFrame:
    """(table_name, columns array, cost, gain): indexes on every asked column, and on one more column, up to ``most``, as long
    as that takes ``least`` of the table's cost with the narrower one away."""
    asked = queries.join(_shares(predicates), "query_id")
    known = queries.select("query_id", "table_name").join(predicates.select("query_id", "column"), "query_id").select("table_name", "column").distinct()

    def priced(wide: DataFrame) -> DataFrame:
        each = wide.join(asked, "table_name")
        return each.groupBy("table_name", "columns", *([] if "before" not in wide.columns else ["before"])).agg(F.sum(_indexed_rows(F.col("columns")) * F.col("freq")).alias("cost"))

    plain = asked.groupBy("table_name").agg(F.sum(F.col("rows") * F.col("freq")).alias("plain"))
    kept = priced(known.select("table_name", F.array("column").alias("columns"))).join(plain, "table_name").where("cost < plain").select("table_name", "columns", "cost")
    found = kept
    for _ in range(most - 1):
        wider = kept.join(known, "table_name").where(~F.array_contains("columns", F.col("column")))
        wider = wider.select("table_name", F.array_append("columns", F.col("column")).alias("columns"), F.col("cost").alias("before"))
        kept = priced(wider).where(F.col("cost") <= F.col("before") * (1 - least)).select("table_name", "columns", "cost")
        found = found.unionByName(kept)
    return found.join(plain, "table_name").select("table_name", "columns", "cost", (F.col("plain") - F.col("cost")).alias("gain"))


def post_filter(cost: DataFrame, indexes: DataFrame, improved: float = 0.1, negative: float = 0.2, large: float = math.inf, room: float = math.inf, count: int | None = None, origin: int = 0) -> DataFrame:
    """(config_id, gain, mean_rate, negative_share, storage): the configurations that are worth having, in order of gain.

    Dropped are those that help no statement, those whose mean rate over the statements they help is below
    ``improved`` while their benefit is below ``large``, and those with a mean rate below ``negative`` that
    harm more than that share of statements; then what no longer fits ``room``, in order, and all after
    ``count``. ``indexes`` has (config_id, storage).
    """
    plain = cost.where(F.col("config_id") == origin).select("query_id", F.col("cost").alias("_plain"))
    each = cost.where(F.col("config_id") != origin).join(plain, "query_id").withColumn("_saved", F.col("_plain") - F.col("cost"))
    helps, harms = F.col("_saved") > 0, F.col("_saved") < 0
    n = lambda c: F.sum(F.when(c, F.col("freq")).otherwise(0))
    judged = each.groupBy("config_id").agg(
        F.sum(F.col("_saved") * F.col("freq")).alias("gain"), F.sum(F.when(helps, F.col("_saved"))).alias("_benefit"),
        (F.sum(F.when(helps, F.col("_saved") / F.col("_plain") * F.col("freq"))) / n(helps)).alias("mean_rate"), (n(harms) / F.sum("freq")).alias("negative_share"),
    ).where("_benefit > 0 and gain > 0")
    low = (F.col("mean_rate") < improved) & (F.col("_benefit") < large)
    harmful = (F.col("mean_rate") < negative) & (F.col("negative_share") > negative)
    kept = judged.where(~low & ~harmful).join(indexes.select("config_id", "storage"), "config_id").drop("_benefit")
    if room == math.inf and count is None:
        return kept.orderBy(F.col("gain").desc(), "config_id")
    # One row a configuration that is left; each takes what room the ones before it leave.
    chosen, left = [], room
    for r in kept.orderBy(F.col("gain").desc(), "config_id").toLocalIterator():
        if count is not None and len(chosen) == count:
            break
        if r["storage"] <= left:
            chosen.append(r["config_id"])
            left -= r["storage"]
    return kept.where(F.col("config_id").isin(chosen)).orderBy(F.col("gain").desc(), "config_id")


def contained_pairs(indexes: DataFrame) -> DataFrame:
    """(short, long) configurations of one table where the columns of one are all among the other's."""
    a, b = (indexes.select("table_name", F.col("config_id").alias(n), F.col("columns").alias(f"_{n}")) for n in ("short", "long"))
    inside = (F.size(F.array_except("_short", "_long")) == 0) & ((F.size("_short") < F.size("_long")) | ((F.size("_short") == F.size("_long")) & (F.col("short") < F.col("long"))))
    return a.join(b, "table_name").where((F.col("short") != F.col("long")) & inside).select("short", "long")


def same_columns(cost: DataFrame, indexes: DataFrame, rate: float = 0.8) -> DataFrame:
    """(config_id): what may go, as another configuration with its columns, or among them, has over ``rate`` of what both gain together.

    Of such a pair the longer one goes, if the shorter gains that much, else the shorter, if the longer does.
    """
    pairs = contained_pairs(indexes).withColumn("set_id", F.struct("short", "long"))
    members = pairs.select("set_id", F.explode(F.array("short", "long")).alias("config_id"))
    singles = indexes.select(F.struct(F.col("config_id").alias("short"), F.col("config_id").alias("long")).alias("set_id"), "config_id")
    origin = cost.where("config_id = 0").agg(F.sum(F.col("cost") * F.col("freq")).alias("_all"))
    sets = infer_benefit(cost, members.unionByName(singles)).crossJoin(F.broadcast(origin)).select("set_id", (F.col("_all") - F.col("cost")).alias("gain"))
    one = sets.where("set_id.short = set_id.long").select(F.col("set_id.short").alias("_id"), F.col("gain").alias("_gain"))
    both = pairs.join(sets, "set_id")
    both = both.join(one.withColumnsRenamed({"_id": "short", "_gain": "_s"}), "short", "left").join(one.withColumnsRenamed({"_id": "long", "_gain": "_l"}), "long", "left")
    gone = F.when(F.coalesce("_s", F.lit(0.0)) / F.col("gain") > rate, F.col("long")).when(F.coalesce("_l", F.lit(0.0)) / F.col("gain") > rate, F.col("short"))
    return both.where("gain > 0").select(gone.alias("config_id")).where("config_id is not null").distinct()


def redundant_existing(indexes: DataFrame) -> DataFrame:
    """(index_name): existing indexes whose columns begin another one's of the same table, unless only unused ones make them redundant.

    ``indexes`` has (table_name, index_name, columns array, unused boolean).
    """
    n = F.size("columns")
    short = indexes.select("table_name", "index_name", F.col("columns").alias("_c"), F.col("unused").alias("_u"))
    # The join hashes on the first column too, which both begin with.
    heads = short.withColumn("_head", F.col("_c")[0]).join(indexes.select("table_name", F.col("index_name").alias("_other"), "columns", F.col("unused").alias("_v"), F.col("columns")[0].alias("_head")), ["table_name", "_head"])
    begins = F.slice("columns", F.lit(1), F.size("_c")) == F.col("_c")
    later = (F.size("_c") < n) | ((F.size("_c") == n) & (F.col("index_name") < F.col("_other")))
    return heads.where(begins & later & (~F.col("_v") | F.col("_u"))).select("index_name").distinct()


def advise(queries: DataFrame, predicates: DataFrame, storage_of: Column, most: int = 5, choose: int = 10, room: float = math.inf) -> DataFrame:
    """(table_name, columns, gain, storage): candidates are grown, priced, filtered, and chosen one by one by what each adds."""
    shared_folder(queries.sparkSession)
    number = F.row_number().over(Window.orderBy(F.col("gain").desc(), "table_name", "columns"))  # as many rows as candidates
    # Both are read many times over, so each is worked out once.
    indexes = grown_candidates(queries, predicates, most).withColumn("config_id", number).withColumn("storage", storage_of).checkpoint()
    cost = cost_table(queries, predicates, indexes).checkpoint()
    useful = indexes.join(post_filter(cost, indexes).select("config_id"), "config_id").join(same_columns(cost, indexes), "config_id", "left_anti").checkpoint()
    sizes = {r["config_id"]: float(r["storage"]) for r in useful.select("config_id", "storage").collect()}
    chosen = greedy(cost.join(useful.select("config_id"), "config_id", "left_semi").unionByName(cost.where("config_id = 0")), choose, sizes, room)
    return useful.where(F.col("config_id").isin(chosen)).select("table_name", "columns", "gain", "storage")


def swarm(rows: DataFrame, cost: Callable[[list[Column]], Column], low: list[float], high: list[float], particles: int = 20, rounds: int = 60, seed: int = 0) -> tuple[list[float], float]:
    """(point, cost): particle-swarm search in a box for the point at which the mean ``cost`` of the rows is least.

    ``cost`` is an expression of the rows' columns and of a point's coordinates. A round prices all
    particles in one job: their places, a row each, are broadcast, and each task passes on a partial
    sum for each particle. The driver holds the particles and nothing of the rows. A point whose cost
    is NULL (no rows) is never the best; if all are, the centre is returned with infinite cost.
    """
    spark = rows.sparkSession
    rng = np.random.default_rng(seed)
    a, b = np.array(low, float), np.array(high, float)

    def priced(at: np.ndarray) -> np.ndarray:
        places = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(at)], "_particle int, _at array<double>")
        mean = F.avg(cost([F.col("_at")[k] for k in range(len(a))]))
        out = np.full(len(at), np.inf)
        for r in rows.crossJoin(F.broadcast(places)).groupBy("_particle").agg(mean.alias("_cost")).where("_cost is not null").collect():
            out[r["_particle"]] = r["_cost"]
        return out

    at = rng.uniform(a, b, (particles, len(a)))
    speed = np.zeros_like(at)
    own, own_cost = at.copy(), priced(at)
    for _ in range(rounds if np.isfinite(own_cost).any() else 0):
        best = own[own_cost.argmin()]
        speed = 0.7 * speed + 1.5 * rng.random(at.shape) * (own - at) + 1.5 * rng.random(at.shape) * (best - at)
        at = np.clip(at + speed, a, b)
        now = priced(at)
        better = now < own_cost
        own[better], own_cost[better] = at[better], now[better]
    if not np.isfinite(own_cost).any():
        return ((a + b) / 2).tolist(), math.inf
    return own[own_cost.argmin()].tolist(), float(own_cost.min())
