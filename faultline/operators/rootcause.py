"""Root causes of every failure of every asset in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as K
from ..functions.days import DAY_US, floor_days, micros
from ..functions.text import fixed
from ..sources.storage import materialized
from .features import KEYS
from .moments import FIELDS, mean, merged, merged_before, moments, none, spread
from .ordered import HOT_ROWS, UNBOUNDED, split_cells

Z_LIMIT = 2.0
# Days of the window before a past failure, similarity and list lengths.
PAST_WINDOW_DAYS = 7
MIN_SIMILARITY = 0.3
TOP_SIMILAR = 5
TOP_CAUSES = 5
TOP_ADVISED = 3
WORD_BITS = 62
FAILURE = [*KEYS, "ts"]  # failures of an asset at one instant share their analysis


def window_statistics(
    history: DataFrame, features: Sequence[str], window_days: int = 7, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """For every failure instant t of an asset: statistics of each feature in [t - w, t) and before t - w.

    Columns ``asset_id, ts, n_window, n_baseline, s`` with ``s`` an array of
    ``feature, window_mean, window_sd, first, last, base_mean, base_sd``. Null values are left out of means and spreads.

    Time is cut into blocks of the length of the window, so a window is the end of one block and the beginning of
    the next. Both are running moments inside a block, read at t - w backwards and at t forwards, and are
    merged; the baseline is the running moments of the asset at t - w. So the cost is linear however many failures a
    window holds, and values of any scale keep their relative precision. A hot asset is cut into cells of time,
    whose moments are merged in front of the running ones.
    """
    width = window_days * DAY_US
    here = micros("ts")
    names = [f"x{i}" for i in range(len(features))]
    values = [F.col(c).cast("double").alias(n) for c, n in zip(features, names)]
    row = F.struct(here.alias("at"), F.col("event_id").alias("id"), *names)
    # every failure twice: with its values at t, and as a question at t - w
    events = history.select(*FAILURE, "event_id", *values).select(*FAILURE, *names, row.alias("row"))
    kinds = {f.name: f.dataType for f in events.schema.fields}
    event = F.struct(F.lit(False).alias("probe"), here.alias("pos"), *names, "row")
    ask = F.struct(F.lit(True).alias("probe"), (here - width).alias("pos"), *[
        F.lit(None).cast(kinds[c]).alias(c) for c in (*names, "row")
    ])
    points = events.select(*FAILURE, F.explode(F.array(event, ask)).alias("e")).select(*FAILURE, "e.*")
    points = points.withColumn("block", F.floor(F.col("pos") / F.lit(width)).cast("long"))
    cut, cells = split_cells(points, KEYS, ["pos"], hot_rows)

    inside = Window.partitionBy(*KEYS, "block", *cells)
    frames = {
        "head": inside.orderBy("pos").rangeBetween(UNBOUNDED, -1),
        "rest": inside.orderBy(F.col("pos").desc()).rangeBetween(UNBOUNDED, 0),
        "base": Window.partitionBy(*KEYS, *cells).orderBy("pos").rangeBetween(UNBOUNDED, -1),
    }
    count = F.count_if(~F.col("probe"))
    state = cut.select(
        "*",
        *[moments(F.col(n), frame).alias(f"{k}_{n}") for k, frame in frames.items() for n in names],
        *[count.over(frame).alias(f"{k}_n") for k, frame in frames.items()],
        *[f("row").over(frames[k]).alias(f"{k}_{f.__name__}") for k in ("head", "rest") for f in (F.min, F.max)],
    )
    if cells:
        state = _with_cells(state, cut.where("_hot"), cells, names)

    # one row per instant: what its failures read at t and its questions at t - w, as plain numbers
    probe, taken = F.col("probe"), {}
    for k, side in (("head", ~probe), ("rest", probe), ("base", probe)):
        taken |= {f"{k}_n": F.when(side, F.col(f"{k}_n"))}
        taken |= {f"{k}_{n}_{c}": F.when(side, F.col(f"{k}_{n}")[c]) for n in names for c in FIELDS}
        if k != "base":
            taken |= {f"{k}_{n}_{f}": F.when(side, F.col(f"{k}_{f}")[n]) for n in names for f in ("min", "max")}
    both = state.select(*FAILURE, *[c.alias(n) for n, c in taken.items()]).groupBy(*FAILURE).agg(
        *[F.max(n).alias(n) for n in taken]
    )

    def part(k: str, n: str) -> Column:
        return F.struct(*[F.col(f"{k}_{n}_{c}").alias(c) for c in FIELDS])

    # the end of the first block lies before the beginning of the second
    def picked(n: str, f: str, k: str, other: str) -> Column:
        return F.when(F.col(f"{k}_n") > 0, F.col(f"{k}_{n}_{f}")).otherwise(F.col(f"{other}_{n}_{f}"))

    put_together = both.select(
        *FAILURE, (F.col("rest_n") + F.col("head_n")).alias("n_window"), F.col("base_n").alias("n_baseline"),
        *[merged(part("rest", n), part("head", n)).alias(f"window_{n}") for n in names],
        *[part("base", n).alias(f"base_{n}") for n in names],
        *[picked(n, "min", "rest", "head").alias(f"first_{n}") for n in names],
        *[picked(n, "max", "head", "rest").alias(f"last_{n}") for n in names],
    )

    def one(n: str, c: str) -> Column:
        window, base = F.col(f"window_{n}"), F.col(f"base_{n}")
        return F.struct(
            F.lit(c).alias("feature"), mean(window).alias("window_mean"), spread(window).alias("window_sd"),
            F.col(f"first_{n}").alias("first"), F.col(f"last_{n}").alias("last"),
            mean(base).alias("base_mean"), spread(base).alias("base_sd"),
        )

    return put_together.select(
        *FAILURE, "n_window", "n_baseline", F.array(*[one(n, c) for n, c in zip(names, features)]).alias("s")
    )


def _with_cells(state: DataFrame, hot: DataFrame, cells: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Running moments of the cells of hot assets continued over the other cells of the block or asset."""
    measures = [*[moments(F.col(n)).alias(n) for n in names], F.count_if(~F.col("probe")).alias("_rows")]
    ends = [F.min("row").alias("min"), F.max("row").alias("max")]
    for kind, keys, backwards in (("head", [*KEYS, "block"], False), ("rest", [*KEYS, "block"], True), ("base", KEYS, False)):
        extra = ends if kind != "base" else []
        parts = materialized(hot.groupBy(*keys, *cells).agg(*measures, *extra))
        carried = merged_before(parts, keys, cells, names, backwards)
        order = [F.desc(c) if backwards else F.asc(c) for c in cells]
        earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(UNBOUNDED, -1)
        sums = parts.select(
            *keys, *cells, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
            *([F.min("min").over(earlier).alias("_min"), F.max("max").over(earlier).alias("_max")] if extra else []),
        )
        # a cell that holds no row of a key has no entry there
        table = carried.join(sums, [*keys, *cells])
        joined = state.join(table, [*keys, *cells], "left")
        changed = {f"{kind}_n": F.col(f"{kind}_n") + F.coalesce("_rows_before", F.lit(0))}
        for n in names:
            changed[f"{kind}_{n}"] = merged(F.coalesce(F.col(f"{n}_before"), none()), F.col(f"{kind}_{n}"))
        if extra:
            changed[f"{kind}_min"] = F.least(f"{kind}_min", "_min")
            changed[f"{kind}_max"] = F.greatest(f"{kind}_max", "_max")
        state = joined.withColumns(changed).select(*state.columns)
    return state


def per_failure(history: DataFrame, analysed: DataFrame) -> DataFrame:
    """Rows per asset and instant put on the single failures of the log."""
    return history.select(*FAILURE, "event_id").join(analysed, FAILURE)


def severity(abs_z: Column) -> Column:
    top, high, medium, low = K.SEVERITY
    return F.when(abs_z >= 4, top).when(abs_z >= 3, high).when(abs_z >= 2, medium).otherwise(low)


def _anomaly(s: Column, n: Column) -> Column:
    z = F.try_divide(s["window_mean"] - s["base_mean"], s["base_sd"])
    shift = (s["window_mean"] - s["base_mean"]) / s["base_mean"] * 100
    trend = F.when(n > 1, F.when(s["last"] > s["first"], K.RISING).otherwise(K.FALLING)).otherwise(K.STEADY)
    return F.struct(
        s["feature"].alias("feature"),
        z.alias("z_score"),
        severity(F.abs(z)).alias("severity"),
        s["window_mean"].alias("window_mean"),
        s["base_mean"].alias("baseline_mean"),
        F.when(s["base_mean"] != 0, shift).otherwise(0.0).alias("deviation_pct"),
        F.when(z > 0, K.INCREASE).otherwise(K.DECREASE).alias("impact"),
        trend.alias("trend"),
        F.coalesce(s["window_sd"], F.lit(0.0)).alias("volatility"),
    )


def detect_anomalies(stats: DataFrame, limit: float = Z_LIMIT, min_baseline_rows: int = 0) -> DataFrame:
    """Add ``anomalies``: features with |z| above the limit, largest first.

    Zero or missing baseline spread gives no anomaly. Works row by row, no shuffle.
    """
    found = F.filter(
        F.transform("s", lambda s: _anomaly(s, F.col("n_window"))),
        lambda a: F.abs(a["z_score"]) > limit,
    )
    if min_baseline_rows:
        found = F.when(F.col("n_baseline") >= min_baseline_rows, found).otherwise(F.slice(found, 1, 0))
    by_size = F.array_sort(found, lambda a, b: F.when(
        F.abs(a["z_score"]) > F.abs(b["z_score"]), -1
    ).when(F.abs(a["z_score"]) < F.abs(b["z_score"]), 1).when(a["feature"] < b["feature"], -1).when(
        a["feature"] > b["feature"], 1
    ).otherwise(0))
    return stats.select(
        *FAILURE, "n_window", "n_baseline", by_size.alias("anomalies")
    )


def anomaly_rows(anomalies: DataFrame) -> DataFrame:
    """One row per asset, instant and anomalous feature."""
    return anomalies.select(*FAILURE, F.inline("anomalies"))


def _signature(anomalies: str = "anomalies") -> Column:
    return F.array_sort(F.transform(anomalies, lambda a: a["feature"]))


def _mask(names: Column | str, order: Sequence[str]) -> Column:
    """A set of names as words of ``WORD_BITS`` bits; bit i stands for the i-th name of ``order``."""
    place = F.create_map(*[F.lit(v) for i, n in enumerate(order) for v in (n, i)])
    known = F.filter(F.transform(names, lambda n: F.get(F.array(place[n]), F.lit(0))), lambda i: i.isNotNull())
    size = -(-len(order) // WORD_BITS)

    def word(w: int) -> Column:
        own = F.filter(known, lambda i: F.floor(i / F.lit(WORD_BITS)) == w)
        one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i % WORD_BITS)
        return F.aggregate(own, F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(one(i)))

    return F.array(*[word(w) for w in range(size)])


def _has(mask: Column, place: Column) -> Column:
    word = F.get(mask, F.floor(place / F.lit(WORD_BITS)).cast("int"))
    return F.call_function("shiftright", word, place % WORD_BITS).bitwiseAND(F.lit(1).cast("long")) == 1


def _common(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def _bits(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda acc, w: acc + F.bit_count(w))


def similar_sets(now: DataFrame, past: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """Pairs of sets of an asset where the past one holds at least ``least`` of the current one.

    ``now``: asset_id, now_mask, n_now (its size); ``past``: asset_id, past_mask; each set once. Adds ``common_mask`` and ``shared``.

    A past set that holds m of the n features of a current set holds one of any n - m + 1 of them. Those are chosen by
    rarity among the past sets of the asset, and only they are joined; a pair that meets on several counts where it meets
    on the rarest. Masks decide what the pair shares.
    """
    bits = lambda mask: F.filter(
        F.sequence(F.lit(0), F.size(mask) * WORD_BITS - 1), lambda i: _has(F.col(mask), i)
    )
    index = past.select(*KEYS, "past_mask", F.explode(bits("past_mask")).alias("place"))
    counts = index.groupBy(*KEYS, "place").agg(F.count(F.lit(1)).alias("n"))
    rarest = counts.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("n", "place"))).alias("_rarest"))
    held = F.filter(F.transform("_rarest", lambda r: r["place"]), lambda i: _has(F.col("now_mask"), i))
    wanted = F.ceil(F.col("n_now") * F.lit(least) - 1e-9).cast("int")
    prefix = F.slice("_held", 1, F.greatest(F.size("_held") - F.greatest(wanted, F.lit(1)) + 1, F.lit(0)))
    asked = now.join(rarest, KEYS).withColumn("_held", held).withColumn("_prefix", prefix).select(
        *now.columns, "_prefix", F.explode("_prefix").alias("place")
    )
    met = asked.join(index, [*KEYS, "place"])
    rarest_met = F.get(F.filter("_prefix", lambda i: _has(F.col("past_mask"), i)), F.lit(0))
    pairs = met.where(rarest_met == F.col("place")).withColumn("common_mask", _common("now_mask", "past_mask"))
    pairs = pairs.withColumn("shared", _bits(F.col("common_mask"))).where(F.col("shared") / F.col("n_now") >= least)
    return pairs.select(*now.columns, "past_mask", "common_mask", "shared")


def similar_failures(current: DataFrame, past: DataFrame) -> DataFrame:
    """Add ``similar``: up to five earlier failures of the asset with the most shared anomalies.

    ``past`` holds the anomalies over the fixed past window; a past failure counts with
    the features that are anomalous now, so its score is shared / current. Among equal
    scores the earliest failures win. Failures are first reduced to the distinct sets of
    anomalous features of the asset, each with its five earliest dates; per current set
    the five earliest dates of each score level then suffice for any later failure, at
    most 5 x features entries, so the rows of an asset are never paired with each other, and
    sets only where they share a rare feature (:func:`similar_sets`).
    """
    found = past.select(*FAILURE, _signature().alias("past_set")).where(F.size("past_set") > 0)
    # the names of the features that were ever anomalous: at most as many as there are features
    order = sorted(r["f"] for r in found.select(F.explode("past_set").alias("f")).distinct().collect())
    if not order:
        kind = f"date {past.schema['ts'].dataType.simpleString()}, similarity_score double, common_anomalies array<string>, days_ago long"
        return current.withColumn("similar", F.array().cast(f"array<struct<{kind.replace(' ', ':')}>>".replace(",:", ",")))
    now = current.withColumn("n_now", F.size("anomalies")).withColumn("now_mask", _mask(_signature(), order))
    before = found.select(*FAILURE, _mask("past_set", order).alias("past_mask"))
    by_date = Window.partitionBy(*KEYS, "past_mask").orderBy("ts")
    dates = before.select("*", F.row_number().over(by_date).alias("_n")).where(F.col("_n") <= TOP_SIMILAR)
    dates = materialized(dates.groupBy(*KEYS, "past_mask").agg(F.sort_array(F.collect_list("ts")).alias("dates")))
    sets = now.where(F.col("n_now") > 0).select(*KEYS, "now_mask", "n_now").distinct()
    pairs = similar_sets(sets, dates.select(*KEYS, "past_mask")).join(dates, [*KEYS, "past_mask"])
    # two past sets may share the same features with the current one: rank by level
    dated = pairs.select(*KEYS, "now_mask", "n_now", "common_mask", "shared", F.explode("dates").alias("date"))
    level = Window.partitionBy(*KEYS, "now_mask", "n_now", "shared").orderBy("date", "common_mask")
    kept = dated.select("*", F.row_number().over(level).alias("_n")).where(F.col("_n") <= TOP_SIMILAR)
    entry = F.struct((-F.col("shared") / F.col("n_now")).alias("order_key"), "date", "common_mask")
    own = [*KEYS, "now_mask", "n_now"]
    lists = kept.groupBy(*own).agg(F.array_sort(F.collect_list(entry)).alias("_candidates"))
    earlier = F.filter("_candidates", lambda c: c["date"] < F.col("ts"))
    names = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("name")) for i, n in enumerate(order)])

    def shown(c: Column) -> Column:
        common = F.transform(F.filter(names, lambda n: _has(c["common_mask"], n["place"])), lambda n: n["name"])
        return F.struct(
            c["date"].alias("date"), (-c["order_key"]).alias("similarity_score"),
            common.alias("common_anomalies"),
            floor_days(F.col("ts"), c["date"]).alias("days_ago"),
        )

    similar = F.transform(F.slice(F.coalesce(earlier, F.array()), 1, TOP_SIMILAR), shown)
    return now.join(lists, own, "left").select(*current.columns, similar.alias("similar"))


def _words(feature: Column) -> Column:
    return F.regexp_replace(feature, "_", " ")


def _cause(a: Column) -> Column:
    n_similar = F.size("similar")
    recurrence = F.size(F.filter("similar", lambda s: F.array_contains(s["common_anomalies"], a["feature"])))
    share = recurrence / F.greatest(n_similar, F.lit(1))
    strength = F.least(F.abs(a["z_score"]) / 4.0, F.lit(1.0))
    confidence = (
        F.when((share > 0.5) & (strength > 0.75), K.CONF_HIGH)
        .when((share > 0.3) | (strength > 0.5), K.CONF_MEDIUM)
        .otherwise(K.CONF_LOW)
    )
    trend = F.when(a["trend"] == K.STEADY, "").otherwise(F.concat(F.lit(" (tendência "), a["trend"], F.lit(")")))
    text = F.concat(
        F.initcap(_words(a["feature"])), F.lit(": "), F.lower(a["impact"]), F.lit(" de "),
        fixed(F.abs(a["deviation_pct"]), 1), F.lit("% em relação ao baseline"), trend,
    )
    return F.struct(
        a["feature"].alias("cause_feature"),
        (strength * 0.7 + share * 0.3).alias("probability_score"),
        confidence.alias("confidence"),
        a["z_score"].alias("z_score"),
        a["deviation_pct"].alias("deviation_pct"),
        recurrence.alias("historical_recurrence"),
        a["severity"].alias("severity"),
        text.alias("description"),
    )


def rank_causes(found: DataFrame) -> DataFrame:
    """Add ``causes``, best first (ties keep the order of the z-scores). Row by row."""
    causes = F.transform("anomalies", _cause)
    indexed = F.transform(causes, lambda c, i: F.struct((-c["probability_score"]).alias("k"), i.alias("i"), c.alias("c")))
    return found.withColumn("causes", F.transform(F.array_sort(indexed), lambda e: e["c"]))


def analysis_confidence(anomalies: str = "anomalies", similar: str = "similar") -> Column:
    """0.6 x mean strength + 0.4 x history, 0 without anomalies."""
    total = F.aggregate(anomalies, F.lit(0.0), lambda acc, a: acc + F.abs(a["z_score"]))
    strength = F.least(F.try_divide(total, F.size(anomalies)) / 4.0, F.lit(1.0))
    history = F.least(F.size(similar) / F.lit(3.0), F.lit(1.0))
    return F.when(F.size(anomalies) > 0, strength * 0.6 + history * 0.4).otherwise(0.0)


def _advice(c: Column, longest_key: bool) -> Column:
    rules = sorted(K.ACTION_RULES, key=lambda r: -len(r[0])) if longest_key else K.ACTION_RULES
    action = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, text in rules:
        action = action.when(F.contains(F.lower(c["cause_feature"]), F.lit(key)), text)
    return action.otherwise(F.concat(
        F.lit("Analisar comportamento de "), _words(c["cause_feature"]), F.lit(" - Desvio de "),
        fixed(c["deviation_pct"], 1), F.lit("%"),
    ))


def recommend(found: DataFrame, longest_key: bool = False) -> DataFrame:
    """Add ``recommendations``: the action for each of the top three causes and a general one.

    The first matching keyword of the rule table decides, or the longest one on request.
    """
    top, high, _, _ = K.SEVERITY
    each = F.transform(F.slice("causes", 1, TOP_ADVISED), lambda c, i: F.struct(
        (i + 1).alias("priority"),
        _advice(c, longest_key).alias("action"),
        c["cause_feature"].alias("cause"),
        c["confidence"].alias("confidence"),
        F.when(c["severity"].isin(top, high), "ALTA").otherwise("MÉDIA").alias("urgency"),
    ))
    general = F.struct(
        F.lit(99).alias("priority"),
        F.concat(F.lit("Revisar logs operacionais de "), F.col(KEYS[0]), F.lit(" no período precedente à falha")).alias("action"),
        F.lit("análise_geral").alias("cause"),
        F.lit("ALTA").alias("confidence"),
        F.lit("MÉDIA").alias("urgency"),
    )
    return found.withColumn(
        "recommendations", F.when(F.size("causes") > 0, F.concat(each, F.array(general))).otherwise(each)
    )


def cause_report(
    history: DataFrame, features: Sequence[str], window_days: int = 7, limit: float = Z_LIMIT,
    recommendations: bool = True, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Full report per failure; ``status`` tells the failures without rows in the window."""
    current = materialized(detect_anomalies(window_statistics(history, features, window_days, hot_rows), limit))
    past = current
    if window_days != PAST_WINDOW_DAYS:
        past = materialized(detect_anomalies(window_statistics(history, features, PAST_WINDOW_DAYS, hot_rows), limit))
    found = rank_causes(similar_failures(current, past))
    if recommendations:
        found = recommend(found)
    extra = ["recommendations"] if recommendations else []
    return per_failure(history, found).select(
        *FAILURE, "event_id",
        F.when(F.col("n_window") > 0, "ok").otherwise("no rows in window").alias("status"),
        F.lit(window_days).alias("window_days"),
        F.size("anomalies").alias("n_anomalies"),
        F.size("similar").alias("n_similar"),
        F.slice("causes", 1, TOP_CAUSES).alias("top_causes"),
        "similar",
        *extra,
        analysis_confidence().alias("confidence_score"),
    )
