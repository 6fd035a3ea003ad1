"""Journeys and multi-touch attribution.

All models run on the exploded touchpoint table.  A path is never gathered into one row:
per-path facts come from a (path, channel) pre-aggregate that holds at most one row per
channel, so a bot with millions of touches costs no more than its share of the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.expr import days_between, epoch_us, fixed, once
from spendlens.functions.skew import join_back, one_row, ordered_scan, with_totals
from spendlens.session import staged

PATH = ["client_id", "path_id"]
TOUCH = [*PATH, "event_id", "ts", "channel", "cost", "is_conversion", "value", "is_first", "is_last", "next_channel"]
# State names of the Markov chain.
START, CONVERSION, NO_CONVERSION = "START", "CONVERSION", "NULL"
# Walk limits of the two Markov variants.
MAX_STEPS, LIVE_MASS, GREEDY_STEPS = 100, 0.001, 20


def build_journeys(events: DataFrame, as_of: str | None = None, lookback_days: int | None = None) -> DataFrame:
    """Touchpoints up to each conversion, plus the trailing unconverted path.

    Input: client_id, user_id, event_id, ts, channel, campaign_id, cost, is_conversion, value.
    Adds path_no, path_id, position in the path, and the neighbouring channels inside it.
    """
    if lookback_days is not None:
        newest = F.lit(as_of).cast("timestamp_ntz")
        events = events.where(F.col("ts") >= newest - F.make_dt_interval(F.lit(lookback_days)))
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    flag = F.col("is_conversion").cast("bigint")
    rows = ordered_scan(
        events, ["user_id"], ["ts", "event_id"], hour,
        lag={"prev_channel": F.col("channel"), "prev_converts": F.col("is_conversion")},
        lead={"next_channel": F.col("channel")},
        before={"path_no": flag},
    )
    opens = F.col("prev_channel").isNull() | F.col("prev_converts")
    closes = F.col("is_conversion") | F.col("next_channel").isNull()
    return rows.select(
        *events.columns, "path_no",
        F.concat_ws(":", F.col("user_id").cast("string"), F.col("path_no").cast("string")).alias("path_id"),
        opens.alias("is_first"), closes.alias("is_last"),
        F.when(~opens, F.col("prev_channel")).alias("prev_channel"),
        F.when(~closes, F.col("next_channel")).alias("next_channel"),
    )


def paths(journeys: DataFrame) -> DataFrame:
    """One row per conversion path."""
    return journeys.groupBy("client_id", "user_id", "path_id").agg(
        F.max("is_conversion").alias("converted"),
        F.sum(F.when(F.col("is_conversion"), F.col("value")).otherwise(0.0)).alias("value"),
        F.count(F.lit(1)).alias("touchpoints"),
        F.min("ts").alias("first_touch_at"),
        F.max("ts").alias("last_touch_at"),
    ).withColumn("duration_hours", days_between("last_touch_at", "first_touch_at") * 24)


def path_channels(journeys: DataFrame) -> DataFrame:
    """One row per path and channel, with the path facts beside it."""
    at = F.struct("ts", "event_id")
    by = journeys.groupBy(*PATH, "channel").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("cost").alias("cost"),
        F.min(at).alias("first_at"),
        F.max(at).alias("last_at"),
        F.max("is_conversion").alias("converts"),
        F.sum(F.when(F.col("is_conversion"), F.col("value")).otherwise(0.0)).alias("v"),
    )
    path = Window.partitionBy(*PATH)  # at most one row per channel
    return by.select(
        *PATH, "channel", "n", "cost", "first_at", "last_at",
        F.max("converts").over(path).alias("converted"),
        F.sum("v").over(path).alias("value"),
        F.sum("n").over(path).alias("path_touches"),
        F.count(F.lit(1)).over(path).alias("path_channels"),
        (F.col("first_at") == F.min("first_at").over(path)).alias("opens"),
        (F.col("last_at") == F.max("last_at").over(path)).alias("closes"),
    )


def _shares(credit: DataFrame, name: str, floor: float | None = None) -> DataFrame:
    """Credit per channel divided by the client's total."""
    total = F.sum("credit").over(Window.partitionBy("client_id"))  # one row per channel here
    den = F.greatest(total, F.lit(floor)) if floor is not None else total
    return credit.select("client_id", "channel", F.try_divide(F.col("credit"), den).alias(name))


def _credit(pc: DataFrame, credit: Column) -> DataFrame:
    return pc.where("converted").groupBy("client_id", "channel").agg(F.sum(credit).alias("credit"))


def shapley_value(pc: DataFrame) -> DataFrame:
    """Shapley shares of the value game.

    The game adds up over channels, so a path's value splits evenly over its distinct
    channels; no coalition is enumerated and no channel is cut.
    """
    return _shares(_credit(pc, F.col("value") / F.col("path_channels")), "shapley")


def first_touch(pc: DataFrame, floor: float | None = None) -> DataFrame:
    return _shares(_credit(pc.where("opens"), F.col("value")), "first_touch", floor)


def last_touch(pc: DataFrame, floor: float | None = None) -> DataFrame:
    return _shares(_credit(pc.where("closes"), F.col("value")), "last_touch", floor)


def linear(pc: DataFrame, floor: float | None = None) -> DataFrame:
    return _shares(_credit(pc, F.col("value") * F.col("n") / F.col("path_touches")), "linear", floor)


def time_decay(journeys: DataFrame, half_life_days: float = 7.0, floor: float = 1.0) -> DataFrame:
    """Weights 2^(-days before the last touch / half life), normalised in the path.

    Weights are summed per day first (relative to the day's end), so a path adds one row per
    channel and day to the path-level step; shifting the reference cancels in the quotient.
    """
    day = F.floor(epoch_us("ts") / F.lit(86400e6))
    age_in_day = (day + 1) - epoch_us("ts") / F.lit(86400e6)
    daily = journeys.withColumn("day_no", day).groupBy(*PATH, "channel", "day_no").agg(
        F.sum(F.pow(F.lit(2.0), -age_in_day / half_life_days)).alias("w"),
        F.max("is_conversion").alias("converts"),
        F.sum(F.when(F.col("is_conversion"), F.col("value")).otherwise(0.0)).alias("v"),
    )
    path = Window.partitionBy(*PATH)
    w = F.col("w") * F.pow(F.lit(2.0), (F.col("day_no") - F.max("day_no").over(path)) / F.lit(half_life_days))
    daily = daily.select(*PATH, "channel", w.alias("w"),
                         F.max("converts").over(path).alias("converted"), F.sum("v").over(path).alias("value"))
    share = F.col("w") / F.sum("w").over(path)
    daily = daily.select("client_id", "channel", "converted", (share * F.col("value")).alias("part"))
    return _shares(daily.where("converted").groupBy("client_id", "channel").agg(F.sum("part").alias("credit")),
                   "time_decay", floor)


def position_based(journeys: DataFrame, paths_df: DataFrame, floor: float | None = None) -> DataFrame:
    """40/20/40 split; two touches 50/50, one touch 100.

    First and last channel are single rows of a path; the middle is what the channel counts
    leave after taking them out.
    """
    pc = path_channels(journeys)
    n, k = F.col("path_touches"), F.col("n")
    ends = F.col("opens").cast("int") + F.col("closes").cast("int")
    weight = (
        F.when(n == 1, F.lit(1.0))
        .when(n == 2, ends * 0.5)
        .otherwise(ends * 0.4 + (k - ends) * 0.2 / F.greatest(n - 2, F.lit(1)))
    )
    return _shares(_credit(pc, F.col("value") * weight), "position_based", floor)


def transition_edges(journeys: DataFrame) -> DataFrame:
    """Counts and row-normalised probabilities of START → channels → CONVERSION / NULL."""
    edge = lambda a, b: F.struct(a.alias("from_state"), b.alias("to_state"))
    end = F.when(F.col("is_conversion"), F.lit(CONVERSION)).otherwise(F.lit(NO_CONVERSION))
    step = edge(F.col("channel"), F.when(F.col("is_last"), end).otherwise(F.col("next_channel")))
    both = F.array_compact(F.array(F.when(F.col("is_first"), edge(F.lit(START), F.col("channel"))), step))
    edges = journeys.select("client_id", F.inline(both)).groupBy("client_id", "from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    row = Window.partitionBy("client_id", "from_state")  # at most channels + 2 rows
    return edges.withColumn("p", F.col("n") / F.sum("n").over(row))


def _scenarios(edges: DataFrame) -> DataFrame:
    """The transition table once per removed channel, and once whole (removed = '')."""
    states = edges.where(~F.col("from_state").isin(START)).groupBy("client_id").agg(F.collect_set("from_state").alias("channels"))
    return join_back(edges, states, ["client_id"]).select(
        "client_id", F.explode(F.concat(F.array(F.lit("")), F.col("channels"))).alias("removed"),
        "from_state", "to_state", "p")


def _greedy_rate(scenarios: DataFrame) -> DataFrame:
    """Rate per client and removed channel of the walk that follows the likeliest edge (ties: channel name).

    Every state is reduced to its chance of conversion and its best way on; the walk is a fold over that map in the row.
    It ends at the first state that can convert, and gives 0 where it comes back to a state or has no way on.
    """
    kept = scenarios.where("from_state <> removed and to_state <> removed")
    converts, other = F.col("to_state") == CONVERSION, ~F.col("to_state").isin(CONVERSION, NO_CONVERSION)
    states = kept.groupBy("client_id", "removed", "from_state").agg(
        F.sum(F.when(F.col("removed") == "", F.lit(None)).otherwise(F.col("p"))).alias("left"),
        F.max(F.when(converts, F.col("p"))).alias("conversion"),
        F.min(F.when(other, F.struct((-F.col("p")).alias("down"), F.col("to_state").alias("to")))).alias("way"))
    scale = F.coalesce("left", F.lit(1.0))  # what is left of a state's edges sums to 1 again
    out = F.struct((F.col("conversion") / scale).alias("conversion"), (-F.col("way.down") / scale).alias("p"), F.col("way.to").alias("to"))
    g = states.groupBy("client_id", "removed").agg(F.map_from_entries(F.collect_list(F.struct("from_state", out.alias("out")))).alias("net"))
    begin = F.struct(F.lit(START).alias("here"), F.lit(1.0).alias("p"), F.array().cast("array<string>").alias("seen"), F.lit(0.0).alias("rate"), F.lit(True).alias("live"))

    def step(acc: Column, _: Column) -> Column:
        out = F.try_element_at("net", acc["here"])
        live = acc["live"] & out.isNotNull() & ~F.array_contains(acc["seen"], acc["here"])
        ends = live & out["conversion"].isNotNull()
        onward = F.coalesce(live & out["conversion"].isNull() & out["to"].isNotNull(), F.lit(False))
        return F.struct(
            F.when(onward, out["to"]).otherwise(acc["here"]).alias("here"), F.when(onward, acc["p"] * out["p"]).otherwise(acc["p"]).alias("p"),
            F.array_append(acc["seen"], acc["here"]).alias("seen"),
            F.when(ends, acc["p"] * out["conversion"]).otherwise(acc["rate"]).alias("rate"), onward.alias("live"))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(GREEDY_STEPS)), begin, step, lambda acc: acc["rate"])
    return once(g, {"rate": walked}).select("client_id", "removed", "rate")


def _effects(rates: DataFrame, name: str, equal_when_none: bool) -> DataFrame:
    """Drop in the conversion rate per removed channel, as shares of the client's total."""
    client = Window.partitionBy("client_id")  # one row per channel and the whole chain
    base = F.max(F.when(F.col("removed") == "", F.col("rate"))).over(client)
    effects = rates.withColumn("base_rate", base).where("removed <> ''")
    effects = effects.withColumn("effect", F.greatest(F.lit(0.0), F.col("base_rate") - F.col("rate")))
    total = F.sum("effect").over(client)
    none = 1 / F.count(F.lit(1)).over(client) if equal_when_none else F.lit(0.0)
    return effects.select("client_id", F.col("removed").alias("channel"), "base_rate",
                          F.col("rate").alias("removed_rate"),
                          F.when(total > 0, F.col("effect") / total).otherwise(none).alias(name))


def _walk_rate(scenarios: DataFrame) -> DataFrame:
    """Conversion rate per client and removed channel: the mass is walked inside the row.

    A scenario is one small matrix, so the steps are array functions over it.
    """
    kept = scenarios.where("from_state <> removed and to_state <> removed")
    out = Window.partitionBy("client_id", "removed", "from_state")  # one row per target state
    kept = kept.withColumn("p", F.col("p") / F.sum("p").over(out))
    pair = lambda a, b: F.concat_ws("\u0001", a, b)
    g = kept.groupBy("client_id", "removed").agg(
        F.collect_set("from_state").alias("f"), F.collect_set("to_state").alias("t"),
        F.map_from_entries(F.collect_list(F.struct(pair(F.col("from_state"), F.col("to_state")), "p"))).alias("edges"))
    ends = F.array(F.lit(START), F.lit(CONVERSION))
    g = once(g, {"edges": F.col("edges"), "states": F.array_sort(F.array_distinct(F.concat("f", "t", ends)))})
    into = F.transform("states", lambda b: F.transform("states", lambda a: F.coalesce(F.try_element_at("edges", pair(a, b)), F.lit(0.0))))
    g = once(g, {"into": into, "states": F.col("states"), "goal": F.array_position("states", F.lit(CONVERSION)).cast("int")})
    add = lambda x, y: x + y
    total = lambda xs: F.aggregate(xs, F.lit(0.0), add)

    def step(acc: Column, _: Column) -> Column:
        mass = F.transform("into", lambda row: total(F.zip_with(row, acc["mass"], lambda p, m: p * m)))
        moved = F.when(acc["live"], mass).otherwise(acc["mass"])
        gained = F.when(acc["live"], F.element_at(acc["mass"], F.col("goal"))).otherwise(0.0)
        return F.struct(moved.alias("mass"), (acc["rate"] + gained).alias("rate"), (acc["live"] & (total(moved) >= LIVE_MASS)).alias("live"))

    start = F.struct(F.transform("states", lambda s: F.when(s == START, 1.0).otherwise(0.0)).alias("mass"), F.lit(0.0).alias("rate"), F.lit(True).alias("live"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(MAX_STEPS)), start, step, lambda acc: acc["rate"])
    return once(g, {"rate": walked}).select("client_id", "removed", "rate")


def markov_removal(edges: DataFrame) -> DataFrame:
    """Removal effects by walking the probability mass over the edge table."""
    return _effects(_walk_rate(_scenarios(staged(edges, "edges"))), "markov", equal_when_none=False)


def markov_greedy(edges: DataFrame) -> DataFrame:
    """Removal effects along the most likely route (ties: channel name)."""
    rates = _greedy_rate(_scenarios(staged(edges, "edges")))
    return _effects(rates, "markov_greedy", equal_when_none=True)


def channel_masks(pc: DataFrame) -> DataFrame:
    """Journeys counted per client and set of channels (a bit mask over the client's sorted channels).

    A mask is one long: more channels than its 62 bits are an error, as their coalitions could not be listed.
    """
    order = Window.partitionBy("client_id").orderBy("channel")
    bits = pc.select("client_id", "channel").distinct().withColumn("bit", F.row_number().over(order) - 1)
    sized = with_totals(bits, ["client_id"], n_channels=F.count(F.lit(1)))
    fits = F.when(F.col("n_channels") <= 62, F.col("n_channels")).otherwise(F.raise_error(F.lit("more than 62 channels")).cast("bigint"))
    sized = sized.withColumn("n_channels", fits)
    coded = join_back(pc.select(*PATH, "channel", "converted"), sized, ["client_id", "channel"])
    path_mask = coded.groupBy(*PATH).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"),
                                         F.max("converted").alias("converted"), F.max("n_channels").alias("n_channels"))
    return path_mask.groupBy("client_id", "n_channels", "mask").agg(
        F.count(F.lit(1)).alias("journeys"), F.count_if("converted").alias("conversions"))


def coalition_values(masks: DataFrame, step: int = 4) -> DataFrame:
    """v(S) = converted / all journeys that touch S, for every coalition of a client's channels.

    A journey misses S if its mask lies inside the complement of S.  Sums over all subsets of a mask
    build up ``step`` channels a round: a row adds itself to the masks that hold it within those channels
    and equal it elsewhere.  A client's rows never exceed its 2^n coalitions times 2^step, and they spread over
    all tasks by mask.
    """
    counted = staged(masks, "channel-masks")
    widest = counted.agg(F.max("n_channels")).first()[0] or 0
    sums = ("journeys", "conversions")
    totals = counted.groupBy("client_id", "n_channels").agg(*[F.sum(c).alias(c) for c in sums])
    empty = totals.select("client_id", "n_channels", *[F.lit(0).cast("bigint").alias(c) for c in ("mask", *sums)])
    inside = counted.select(*empty.columns).unionByName(empty)
    for first in range(0, widest, step):
        room = F.expr(f"shiftleft(1L, greatest(least(cast(n_channels as int) - {first}, {step}), 0)) - 1")
        own = F.shiftright("mask", first).bitwiseAND(F.lit((1 << step) - 1).cast("bigint"))
        wider = F.filter(F.sequence(own, room), lambda u: u.bitwiseAND(own) == own)
        grown = inside.withColumn("own", own).withColumn("wider", F.explode(wider))
        inside = grown.groupBy("client_id", "n_channels", (F.col("mask") + F.shiftleft(F.col("wider") - F.col("own"), first)).alias("mask")).agg(
            *[F.sum(c).alias(c) for c in sums])
    everything = totals.select("client_id", *[F.col(c).alias(f"all_{c}") for c in sums])
    touched = join_back(inside, everything, ["client_id"]).select(
        "client_id", "n_channels", F.expr("shiftleft(1L, cast(n_channels as int)) - 1 - mask").alias("s"),
        *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in reversed(sums)])
    return touched.where("journeys > 0").withColumn("v", F.col("conversions") / F.col("journeys"))


def shapley_rate(pc: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Shapley shares of the conversion-rate game over all journeys.

    ``values`` takes a caller's own coalition table (client_id, n_channels, s, v).
    φ_c = Σ_S w(|S|)·(v(S∪c) − v(S)): each coalition adds to its members and subtracts from the
    others, so one explode over bits replaces the self-join of coalitions.  Values are summed by size
    first; the weight 1 / (n · C(n−1, |S|)) is a running product of doubles.
    """
    v = coalition_values(channel_masks(pc)) if values is None else values
    per_bit = v.select("client_id", F.col("n_channels").cast("int").alias("n"), "s", "v",
                       F.explode(F.sequence(F.lit(0), F.col("n_channels").cast("int") - 1)).alias("bit"))
    within = F.expr("s & shiftleft(1L, bit)") != 0
    others = F.bit_count("s").cast("int") - within.cast("int")
    by_size = per_bit.groupBy("client_id", "n", "bit", others.alias("others")).agg(
        F.sum(F.when(within, F.col("v")).otherwise(-F.col("v"))).alias("gain"))
    choices = F.when(F.col("others") == 0, F.lit(1.0)).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.col("others")), F.lit(1.0), lambda acc, i: acc * (F.col("n") - i) / i))
    phi = by_size.groupBy("client_id", "bit").agg(F.sum(F.col("gain") / (F.col("n") * choices)).alias("phi"))
    order = Window.partitionBy("client_id").orderBy("channel")
    bits = pc.select("client_id", "channel").distinct().withColumn("bit", F.row_number().over(order) - 1)
    total = F.sum("phi").over(Window.partitionBy("client_id"))
    return join_back(phi, bits, ["client_id", "bit"]).select(
        "client_id", "channel", F.when(total > 0, F.col("phi") / total).otherwise(F.col("phi")).alias("shapley_rate"))


def channel_stats(pc: DataFrame) -> DataFrame:
    """Touches and cost over all paths; conversions count a converted path once per channel."""
    return pc.groupBy("client_id", "channel").agg(
        F.sum("n").alias("touchpoints"), F.sum("cost").alias("cost"),
        F.count_if("converted").alias("conversions"))


def report_totals(p: DataFrame) -> DataFrame:
    return p.groupBy("client_id").agg(
        F.count_if("converted").alias("conversions"),
        F.sum(F.when(F.col("converted"), F.col("value")).otherwise(0.0)).alias("total_value"),
        F.avg("touchpoints").alias("avg_touchpoints"))


def path_length_distribution(p: DataFrame) -> DataFrame:
    return p.where("converted").groupBy("touchpoints").agg(F.count(F.lit(1)).alias("paths"))


def in_conversion_range(journeys: DataFrame, start: str, end: str) -> DataFrame:
    """Paths whose last touch falls in the closed date range (unconverted ones included)."""
    ends = journeys.where("is_last").select(*PATH, F.col("ts").cast("date").alias("__d"))
    keep = ends.where(F.col("__d").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).drop("__d")
    return journeys.join(keep, PATH, "left_semi")


def attribution_report(journeys: DataFrame, start: str | None = None, end: str | None = None,
                       model: str = "shapley") -> DataFrame:
    """All channel models side by side with the channel totals, per client."""
    if start and end:
        journeys = in_conversion_range(journeys, start, end)
    journeys = staged(journeys.select(*TOUCH), "journeys")  # the channel pre-aggregate and the transitions both read them
    pc = staged(path_channels(journeys), "path-channels")  # read by five models
    out = channel_stats(pc)
    parts = [shapley_value(pc), markov_removal(transition_edges(journeys)).select("client_id", "channel", "markov"),
             first_touch(pc), last_touch(pc), linear(pc)]
    for part in parts:
        out = out.join(part, ["client_id", "channel"], "full")
    totals = pc.where("opens").groupBy("client_id").agg(F.sum(F.when(F.col("converted"), F.col("value")).otherwise(0.0)).alias("client_value"))
    out = join_back(out, totals, ["client_id"], "left")
    share = {m: F.coalesce(F.col(m), F.lit(0.0)) for m in ("shapley", "markov", "first_touch", "last_touch", "linear")}
    ranked = Window.partitionBy("client_id").orderBy(share[model].desc(), "channel")
    return out.select(
        "client_id", "channel",
        *[F.round(c, 4).alias(m) for m, c in share.items()],
        F.round(share[model] * 100, 2).alias("contribution_pct"),
        F.coalesce("touchpoints", F.lit(0)).alias("touchpoints"),
        F.coalesce("conversions", F.lit(0)).alias("conversions"),
        F.round(F.coalesce("cost", F.lit(0.0)), 2).alias("cost"),
        F.round(F.col("client_value") * share["shapley"], 2).alias("attributed_value"),
        F.row_number().over(ranked).alias("rank"),
    )


def attribution_insights(report: DataFrame) -> DataFrame:
    """At most five texts per client, in rule order then channel rank."""
    r, ch = F.col("rank"), F.col("channel")
    top = F.when(r == 1, F.format_string("%s is the top contributor with %s%% attribution", ch, fixed(F.col("contribution_pct"), 1)))
    gap = F.abs(F.col("first_touch") - F.col("last_touch")) > 0.15
    stage = F.when((r <= 3) & gap, F.when(
        F.col("first_touch") > F.col("last_touch"),
        F.concat(ch, F.lit(" is stronger at awareness (first touch) than conversion (last touch)")),
    ).otherwise(F.concat(ch, F.lit(" is stronger at conversion (last touch) than awareness (first touch)"))))
    differ = F.when(F.abs(F.col("shapley") - F.col("markov")) > 0.1,
                    F.concat(F.lit("Models disagree on "), ch, F.lit(" - consider deeper analysis")))
    lines = report.select("client_id", "rank", F.posexplode(F.array(top, stage, differ)).alias("rule", "insight")).where("insight is not null")
    pos = Window.partitionBy("client_id").orderBy("rule", "rank")  # at most three texts per channel
    return lines.withColumn("position", F.row_number().over(pos)).where("position <= 5").select("client_id", "position", "insight")


def placed_touches(journeys: DataFrame) -> DataFrame:
    """(client_id, path_id, pos, channel, is_last): touches with their position in the path, from 0."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    numbered = ordered_scan(journeys, ["user_id"], ["ts", "event_id"], hour, row_number="row_no")
    base = numbered.groupBy("path_id").agg(F.min("row_no").alias("first_row"))
    return join_back(numbered, base, ["path_id"]).select(*PATH, (F.col("row_no") - F.col("first_row")).alias("pos"), "channel", "is_last")


def path_prints(placed: DataFrame, p: DataFrame) -> DataFrame:
    """Paths with an order-sensitive 128-bit print of their channel sequence.

    The print is an XOR over (position, channel) hashes and needs no gathering of the path.
    """
    prints = placed.groupBy(*PATH).agg(
        F.bit_xor(F.xxhash64("pos", "channel")).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit(7), "channel", "pos")).alias("h2"))
    return join_back(p, prints, PATH)


ARROW = " → "
SPELLED = 8  # positions of a tied sequence that are looked at in one round


def _joined(touches: DataFrame) -> DataFrame:
    """(path_id, text): the given touches of each path in order, each but the path's last followed by the arrow."""
    token = F.concat("channel", F.when(F.col("is_last"), F.lit("")).otherwise(F.lit(ARROW))).alias("token")
    spelled = touches.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("pos", token))).alias("t"))
    return spelled.select("path_id", F.array_join(F.transform("t", lambda x: x["token"]), "").alias("text"))


def first_in_order(tied: DataFrame, placed: DataFrame, n: int) -> DataFrame:
    """The path_ids of the n smallest sequences of ``tied`` (path_id, touchpoints; all sequences differ), written out as text.

    Settled from the front: SPELLED positions a round.  What is below the n-th smallest beginning is taken, what is
    above is dropped, and only those that share it go on to their next positions.  No channel holds the arrow.
    """
    taken, pending, at = [], tied, 0
    touches = staged(placed.join(tied.select("path_id"), "path_id").select("path_id", "pos", "channel", "is_last"), "tied")
    while n > 0:
        part = touches.where(F.col("pos").between(at, at + SPELLED - 1))
        begun = staged(pending.join(_joined(part), "path_id", "left").select("path_id", F.coalesce("text", F.lit("")).alias("text")), "begun")
        least = begun.orderBy("text").limit(n).agg(F.max("text").alias("cut"), F.count(F.lit(1)).alias("n")).first()
        if least["n"] < n or at > 0 and least["cut"] == "":  # all of them, or nothing left to tell them apart
            return reduce(DataFrame.unionByName, [*taken, begun.orderBy("text", "path_id").limit(n).select("path_id")])
        below = begun.where(F.col("text") < least["cut"]).select("path_id")
        pending = begun.where(F.col("text") == least["cut"]).select("path_id")
        taken.append(below)
        n, at = n - below.count(), at + SPELLED
        if pending.count() == n:
            return reduce(DataFrame.unionByName, [*taken, pending])
    return reduce(DataFrame.unionByName, taken)


def path_analysis(journeys: DataFrame, p: DataFrame, min_conversions: int = 5, top: int = 20) -> DataFrame:
    """The most frequent exact channel sequences of converted paths; ties in the order of the sequences.

    At most ``top`` sequences are written out, however many are tied at the cut.
    """
    placed = staged(placed_touches(journeys), "placed")
    marked = staged(path_prints(placed, p), "path-prints")
    groups = marked.groupBy("touchpoints", "h1", "h2").agg(
        F.count(F.lit(1)).alias("total_paths"), F.count_if("converted").alias("conversions"),
        F.sum(F.when(F.col("converted"), F.col("value")).otherwise(0.0)).alias("total_value"),
        F.min("path_id").alias("path_id"))
    eligible = staged(groups.where(F.col("conversions") >= min_conversions), "sequences")
    cut = eligible.orderBy(F.desc("conversions")).limit(top).agg(F.min("conversions").alias("least")).first()["least"]
    above = eligible.where(F.col("conversions") > F.lit(cut))
    tied = eligible.where(F.col("conversions") == F.lit(cut))
    chosen = first_in_order(tied.select("path_id"), placed, top - above.count()) if cut is not None else tied.select("path_id")
    best = above.unionByName(tied.join(chosen, "path_id", "left_semi"))
    texts = _joined(placed.join(best.select("path_id"), "path_id").select("path_id", "pos", "channel", "is_last")).withColumnRenamed("text", "path")
    return best.join(texts, "path_id").orderBy(F.desc("conversions"), "path").limit(top).select(
        "path", "conversions", "total_paths", "total_value",
        (F.col("total_value") / F.col("conversions")).alias("avg_value"),
        (F.col("conversions") / F.col("total_paths")).alias("conversion_rate"))


def channel_synergy(pc: DataFrame) -> DataFrame:
    """lift(a→b): conversion rate of paths holding both over that of paths holding a.

    Pairs are formed on the counted channel sets, not inside paths.
    """
    sets = pc.groupBy(*PATH).agg(F.array_sort(F.collect_set("channel")).alias("set"), F.max("converted").alias("converted"))
    counted = sets.groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.count_if("converted").alias("c"))
    pairs = counted.select(F.explode("set").alias("channel_a"), "set", "n", "c").select(
        "channel_a", F.explode("set").alias("channel_b"), "n", "c")
    both = pairs.groupBy("channel_a", "channel_b").agg(F.sum("n").alias("paths"), (F.sum("c") / F.sum("n")).alias("rate"))
    alone = both.where("channel_a = channel_b").select("channel_a", F.col("rate").alias("base_rate"))
    return both.where("channel_a <> channel_b").join(alone, "channel_a").select(
        "channel_a", "channel_b", "paths", "rate", F.try_divide("rate", "base_rate").alias("lift"))


def touchpoint_attributions(journeys: DataFrame) -> DataFrame:
    """Per touchpoint the value each model gives it.

    Path rules (first, last, linear, decay, position) are per touch; the channel models split
    the path value by the channel's share among the path's channels, evenly over its touches.
    """
    journeys = staged(journeys, "journeys")
    pc = staged(path_channels(journeys), "path-channels")
    edges = transition_edges(journeys)
    sh = join_back(pc.where("converted"), shapley_value(pc), ["client_id", "channel"])
    sh = join_back(sh, markov_removal(edges).select("client_id", "channel", "markov"), ["client_id", "channel"])
    path = Window.partitionBy(*PATH)  # one row per channel
    per_touch = sh.select(
        *PATH, "channel", "value", "path_touches", F.max(F.col("last_at.ts")).over(path).alias("end_ts"),
        (F.try_divide(F.col("shapley"), F.sum("shapley").over(path)) * F.col("value") / F.col("n")).alias("shapley_value"),
        (F.coalesce(F.try_divide(F.col("markov"), F.sum("markov").over(path)), F.lit(0.0)) * F.col("value") / F.col("n")).alias("markov_value"))
    rows = join_back(journeys.drop("value"), per_touch, [*PATH, "channel"])
    w = F.pow(F.lit(2.0), -days_between("end_ts", "ts") / F.lit(7.0))
    rows = with_totals(rows.withColumn("w", w), PATH, w_total=F.sum("w"))
    n, v = F.col("path_touches"), F.col("value")
    ends = F.col("is_first").cast("int") + F.col("is_last").cast("int")
    u_shape = F.when(n == 1, F.lit(1.0)).when(n == 2, ends * 0.5).when(ends > 0, F.lit(0.4)).otherwise(0.2 / F.greatest(n - 2, F.lit(1)))
    return rows.select(
        *PATH, "event_id", "channel",
        F.when(F.col("is_first"), v).otherwise(0.0).alias("first_touch_value"),
        F.when(F.col("is_last"), v).otherwise(0.0).alias("last_touch_value"),
        (v / n).alias("linear_value"),
        (v * F.col("w") / F.col("w_total")).alias("time_decay_value"),
        (v * u_shape).alias("position_value"),
        "shapley_value", "markov_value")


def budget_by_attribution(report: DataFrame, total_budget: float, current: DataFrame) -> DataFrame:
    """Total budget by Shapley share; a client without any share keeps its current budgets."""
    total = F.sum("shapley").over(Window.partitionBy("client_id"))  # one row per channel
    return join_back(report, current, ["client_id", "channel"], "left").select(
        "client_id", "channel",
        F.when(total > 0, F.lit(total_budget) * F.col("shapley") / total).otherwise(F.col("current_budget")).alias("recommended_budget"))


def budget_shift(report: DataFrame, spend: DataFrame) -> DataFrame:
    """Shapley share against the current spend share, in percent of the latter."""
    rows = join_back(report.select("client_id", "channel", "shapley"), spend, ["client_id", "channel"])
    share = F.try_divide(F.col("spend"), F.sum("spend").over(Window.partitionBy("client_id")))
    return rows.select("client_id", "channel", share.alias("spend_share"), "shapley",
                       (F.try_divide(F.col("shapley") - share, share) * 100).alias("shift_pct"))


def single_vs_multi_channel(pc: DataFrame) -> DataFrame:
    one = pc.where("opens").withColumn("kind", F.when(F.col("path_channels") == 1, "single").otherwise("multi"))
    return one.groupBy("kind").agg(F.count(F.lit(1)).alias("paths"), F.avg(F.col("converted").cast("double")).alias("conversion_rate"))


def journey_features(journeys: DataFrame) -> DataFrame:
    """Touch count, distinct channels, switches, whole days, first / last channel codes."""
    # Channel codes, 0 for any other.
    codes = {"meta": 1, "google": 2, "tiktok": 3, "email": 4, "organic": 5}
    code = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), F.lower("channel")), F.lit(0))
    at = F.struct("ts", "event_id")
    return journeys.withColumn("code", code).groupBy(*PATH).agg(
        F.count(F.lit(1)).alias("touchpoint_count"),
        F.count_distinct("channel").alias("unique_channels"),
        F.count_if(F.col("prev_channel").isNotNull() & (F.col("prev_channel") != F.col("channel"))).alias("channel_switches"),
        F.floor(days_between(F.max("ts"), F.min("ts"))).alias("journey_duration_days"),
        F.min_by("code", at).alias("first_channel_code"),
        F.max_by("code", at).alias("last_channel_code"))


def days_to_convert(p: DataFrame) -> DataFrame:
    return p.where("converted").select(*PATH, F.datediff(F.col("last_touch_at").cast("date"), F.col("first_touch_at").cast("date")).alias("days"),
                                       "duration_hours")
