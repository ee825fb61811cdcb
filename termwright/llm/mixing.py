"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bucket_bits, located, shuffled_hash, shuffled_rank, source_key, written, whole_row

WHOLE = 1 << 40  # units that the target weights are rounded to: far finer than one block of any corpus
LANE = 1 << 14  # slots that one task schedules
STRIP = 128  # slots whose choices are gathered before they join the others


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and bind it in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _long(value: Column | int) -> Column:
    return (F.lit(value) if isinstance(value, int) else value).cast("long")


def _wide(value: Column) -> Column:
    return value.cast("decimal(19,0)")


def _div(a: Column, b: Column) -> Column:
    """Whole division of non-negative numbers."""
    return F.call_function("div", a, b)


def _moment(stretches: Column, units: Column, blocks: Column, up: bool) -> Column:
    """When an even flow of the sources has given ``blocks`` blocks of a source with ``units``: the
    slot, rounded down or up. Whole numbers throughout.

    A stretch ends when a source runs out: ``done`` blocks of such sources lie before it, and the
    sources that flow in it have ``all`` units. Stretches stand in the order in which the
    sources run out; the one looked for is the first whose own source lasts as long.
    """
    stretch = F.get(F.filter(stretches, lambda s: _wide(blocks) * _wide(s["units"]) <= _wide(s["blocks"]) * _wide(units)), F.lit(0))

    def at(s: Column) -> Column:
        over = _wide(s["all"]) * _wide(blocks)
        return s["done"] + _div(over + _wide(units - 1) if up else over, _wide(units))

    return _let(stretch, at)


def _given(stretches: Column, sources: Column, t: Column) -> Column:
    """Of each source at slot ``t`` of the even flow: its whole blocks, and whether a part of one more."""
    stretch = F.get(F.filter(stretches, lambda s: _wide(t - s["done"]) * _wide(s["units"]) <= _wide(s["blocks"]) * _wide(s["all"])), F.lit(0))

    def at(s: Column) -> Column:
        def own(x: Column) -> Column:
            flows = _wide(x["blocks"]) * _wide(s["units"]) >= _wide(s["blocks"]) * _wide(x["units"])
            over = _wide(t - s["done"]) * _wide(x["units"])
            return F.struct(
                F.when(flows, F.least(_div(over, _wide(s["all"])), x["blocks"])).otherwise(x["blocks"]).alias("whole"),
                (flows & (over % _wide(s["all"]) != 0)).alias("part"),
            )

        return F.transform(sources, own)

    return _let(stretch, at)


def _borders(stretches: Column, sources: Column, total: Column, lane: int) -> Column:
    """Blocks that each source has given at the borders of the lanes, an array for each border.

    At a border a source has its whole blocks of the even flow, or one more: those that are due
    first get it, and a block that was given before stays given.
    """
    lanes = _div(total + lane - 1, _long(lane))

    def step(state: Column, m: Column) -> Column:
        t = F.least(m * lane, total)
        before = F.element_at(state, -1)

        def after(given: Column) -> Column:
            base = F.zip_with(given, before, lambda g, b: F.greatest(g["whole"], b))

            def settled(base: Column) -> Column:
                extra = t - F.aggregate(base, _long(0), lambda a, x: a + x)
                more = F.filter(
                    F.transform(given, lambda g, i: F.when(g["part"] & (F.get(base, i) == g["whole"]), F.struct(_moment(stretches, F.get(sources, i)["units"], g["whole"] + 1, True).alias("due"), i.alias("i")))),
                    lambda x: x.isNotNull(),
                )
                # Where more was given before than the flow leaves room for, the last due wait for the next lane.
                less = F.filter(
                    F.transform(given, lambda g, i: F.when(F.get(base, i) > F.get(before, i), F.struct((-_moment(stretches, F.get(sources, i)["units"], F.get(base, i), True)).alias("due"), i.alias("i")))),
                    lambda x: x.isNotNull(),
                )
                up = F.transform(F.slice(F.array_sort(more), F.lit(1), F.greatest(extra, _long(0)).cast("int")), lambda x: x["i"])
                down = F.transform(F.slice(F.array_sort(less), F.lit(1), F.greatest(-extra, _long(0)).cast("int")), lambda x: x["i"])
                return _let(F.struct(up.alias("up"), down.alias("down")), lambda c: F.transform(base, lambda b, i: b + F.array_contains(c["up"], i).cast("long") - F.array_contains(c["down"], i).cast("long")))

            return F.concat(state, F.array(_let(base, settled)))

        return _let(_given(stretches, sources, t), after)

    start = F.array(F.transform(sources, lambda x: _long(0)))
    return F.aggregate(F.when(lanes > 0, F.sequence(_long(1), lanes)).otherwise(F.array().cast("array<bigint>")), start, step)


def plan_of(counts: DataFrame, block_rows: int, lane: int, weights: DataFrame | None, alpha: float) -> DataFrame:
    """One row: ``sources`` (key, rows, units, blocks), ``stretches`` and ``borders`` (see above).

    ``counts``: __src, __n. ``weights``: columns source and weight; a source without one, or
    with none above 0, comes after all others. Without weights a source's target is its row
    count to the power ``alpha``.
    """
    if weights is None:
        targets = counts.withColumn("__w", F.pow(F.col("__n").cast("double"), F.lit(float(alpha))))
    else:
        named = weights.select(source_key(F.col("source")).alias("__src"), F.col("weight").cast("double").alias("__w")).groupBy("__src").agg(F.max("__w").alias("__w"))
        targets = counts.join(named, "__src", "left").fillna(0.0, ["__w"])
    # A row holds the table of sources: it grows with their number, not with the rows.
    one = targets.groupBy().agg(F.array_sort(F.collect_list(F.struct("__src", "__n", F.greatest("__w", F.lit(0.0)).alias("__w")))).alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, s: a + s["__w"])
    blocks = lambda s: _div(s["__n"] + block_rows - 1, _long(block_rows))
    one = one.withColumn("w", F.when(total > 0, total).otherwise(F.lit(1.0))).select(
        F.transform(
            "s",
            lambda s: F.struct(
                s["__src"].alias("key"),
                s["__n"].alias("rows"),
                F.greatest(_long(1), F.round(s["__w"] / F.col("w") * WHOLE).cast("long")).alias("units"),
                blocks(s).alias("blocks"),
            ),
        ).alias("sources")
    )
    ends = F.array_sort(F.transform("sources", lambda x, i: F.struct((x["blocks"].cast("double") / x["units"]).alias("end"), i.alias("i"), x["units"].alias("units"), x["blocks"].alias("blocks"))))
    one = one.withColumn("ends", ends)
    start = F.struct(
        F.aggregate("ends", _long(0), lambda a, x: a + x["units"]).alias("all"),
        _long(0).alias("done"),
        F.array().cast("array<struct<units:bigint,blocks:bigint,all:bigint,done:bigint>>").alias("out"),
    )
    walked = F.aggregate(
        "ends",
        start,
        lambda a, x: F.struct(
            (a["all"] - x["units"]).alias("all"),
            (a["done"] + x["blocks"]).alias("done"),
            F.concat(a["out"], F.array(F.struct(x["units"].alias("units"), x["blocks"].alias("blocks"), a["all"].alias("all"), a["done"].alias("done")))).alias("out"),
        ),
    )
    one = one.withColumn("stretches", walked["out"]).withColumn("total", F.aggregate("sources", _long(0), lambda a, x: a + x["blocks"]))
    return one.withColumn("borders", _borders(F.col("stretches"), F.col("sources"), F.col("total"), lane)).drop("ends")


def _lane_of(i: Column, block: Column, release: Column, deadline: Column, borders: Column, lane: int) -> Column:
    """The lane that gives a block: the first at whose end the source has given it."""
    last = F.size(borders).cast("long") - 2
    tried = F.sequence(F.least(_div(release, _long(lane)), last), F.least(_div(deadline - 1, _long(lane)) + 2, last))
    return F.coalesce(F.get(F.filter(tried, lambda m: F.get(F.get(borders, (m + 1).cast("int")), i) > block), F.lit(0)), last)


def _earliest_deadline_first(jobs: Column, start: Column, slots: Column) -> Column:
    """The jobs of a lane in the order of its slots: of each source's next block, released ones come
    first, and of these the one that is due first."""
    queues = F.transform(F.array_sort(F.array_distinct(F.transform(jobs, lambda j: j["i"]))), lambda i: F.array_sort(F.filter(jobs, lambda j: j["i"] == i)))

    def run(queues: Column) -> Column:
        def step(state: Column, t: Column) -> Column:
            heads = F.zip_with(
                queues,
                state["next"],
                lambda q, at: _let(F.get(q, at), lambda j: F.when(j.isNotNull(), F.struct((j["release"] > start + t).alias("waits"), j["deadline"].alias("deadline"), j["i"].alias("i"), j.alias("job")))),
            )
            return _let(
                F.array_min(heads),
                lambda pick: F.struct(
                    F.zip_with(queues, state["next"], lambda q, at: at + (F.get(q, F.lit(0))["i"] == pick["i"]).cast("int")).alias("next"),
                    F.concat(state["out"], F.array(pick["job"])).alias("out"),
                ),
            )

        none = F.slice(jobs, 1, 0)
        begin = F.struct(F.transform(queues, lambda q: F.lit(0)).alias("next"), F.array().cast("array<array<struct<i:int,block:bigint,release:bigint,deadline:bigint>>>").alias("out"))

        def strip(state: Column, s: Column) -> Column:
            inner = F.aggregate(
                F.sequence(s * STRIP, F.least((s + 1) * STRIP, slots) - 1),
                F.struct(state["next"].alias("next"), none.alias("out")),
                step,
            )
            return _let(inner, lambda x: F.struct(x["next"].alias("next"), F.concat(state["out"], F.array(x["out"])).alias("out")))

        return F.flatten(F.aggregate(F.sequence(_long(0), _div(slots + STRIP - 1, _long(STRIP)) - 1), begin, strip)["out"])

    return _let(queues, run)


def schedule(blocks: DataFrame, plan: DataFrame, lane: int) -> DataFrame:
    """i, block, release, deadline and slot of each block (``blocks``: i, block).

    A block's release and deadline are the slots in which an even flow at the target weights
    begins and ends it. Lanes of ``lane`` slots are scheduled side by side, earliest deadline first.
    """
    jobs = blocks.withColumn("plan", plan.select(F.struct("sources", "stretches", "borders")).scalar()).select("*", "plan.*")
    units = F.get("sources", "i")["units"]
    jobs = jobs.withColumn("release", _moment(F.col("stretches"), units, F.col("block"), False)).withColumn("deadline", _moment(F.col("stretches"), units, F.col("block") + 1, True))
    jobs = jobs.select(_lane_of(F.col("i"), F.col("block"), F.col("release"), F.col("deadline"), F.col("borders"), lane).alias("lane"), F.struct(F.col("i").cast("int").alias("i"), "block", "release", "deadline").alias("job"))
    lanes = jobs.groupBy("lane").agg(F.collect_list("job").alias("jobs"))  # as many as a lane has slots
    order = _earliest_deadline_first(F.col("jobs"), F.col("lane") * lane, F.size("jobs").cast("long"))
    return lanes.select("lane", F.posexplode(order).alias("at", "job")).select("job.*", (F.col("lane") * lane + F.col("at")).alias("slot"))


def _told_apart(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` without ``__nameless``; of nameless rows with the same source and hash all but one get a new hash, by their number among
    these. So rows without an id are as spread as others, and which hashes there are does not depend on where rows stand."""
    nameless = rows.where("__nameless")
    n = nameless.count()
    if n == 0:
        return rows.drop("__nameless")
    alike = nameless.withColumn("__alike", F.concat_ws("|", "__h", "__src")).withColumn("__any", F.xxhash64("__at"))
    numbered = shuffled_rank(alike, "__alike", "__any", ["__at"], bucket_bits(n))
    new = shuffled_hash(seed, F.col("__rank"), F.col("__h").cast("string"), F.lit(""))
    numbered = numbered.withColumn("__h", F.when(F.col("__rank") == 0, F.col("__h")).otherwise(new))
    return written(rows.where("not __nameless").unionByName(numbered.select(rows.columns)).drop("__nameless"), "mix-apart")


def pfair_mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    block_rows: int = 8,
    lane: int = LANE,
    alpha: float = 0.5,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str | None = "text",
    source_col: str = "source",
    keep: list[str] | None = None,
) -> DataFrame:
    """Interleave the sources block by block at their target weights; every row is kept.

    Rows of a source are shuffled by the seed and cut into blocks of ``block_rows``. In an even
    flow each source gives its blocks at its weight's share of the slots until it has none
    left; its share then passes to the others in proportion. Block k of a source is released
    in the slot in which that flow begins it and due at the end of the slot in which the flow ends it;
    at each slot the released block with the earliest deadline runs. So at every slot each
    source is less than one block from its target. Targets are weights in units of 2^-40, and all
    reckoning is in whole numbers: nothing drifts, whatever the length of the schedule.

    Slots are scheduled in lanes of ``lane``, each by itself. At a lane's end every source has
    its target rounded down or up; where two lanes meet a source may so be off by a little more
    than a block in rare cases. A corpus of ``lane`` blocks or fewer is one lane.

    Returns ``keep`` (all columns of ``docs`` if None) plus __mix, a struct of block, slot, release,
    deadline, offset (row in the block) and position (place in the whole order, gapless from 0).
    A null source is a source of its own; there may be any number of sources (a slot's cost
    grows with those in its lane). Null texts are kept. Places depend on ids, texts and sources only, not on
    where rows stand: the same rows in other files get the same places. Rows that agree in all three (in text and
    source, if they have no id) are interchangeable. Other columns may have any name but __mix. An empty table gives no rows.
    """
    if block_rows < 1 or lane < 1:
        raise ValueError("block_rows and lane must be 1 or more")
    docs, where = located(docs)
    carried = [] if keep is None else keep
    narrow = docs.select(
        F.struct(where.alias("at"), *[F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(carried)]).alias("__doc"),
        source_key(F.col(f"`{source_col}`")).alias("__src"),
        shuffled_hash(seed, F.col(f"`{id_col}`"), F.col(f"`{text_col}`") if text_col else None, F.lit("\x00")).alias("__h"),
        where.alias("__at"),
        F.col(f"`{id_col}`").isNull().alias("__nameless"),
    )
    narrow = _told_apart(written(narrow, "mix-rows"), seed)
    counts = narrow.groupBy("__src").agg(F.count(F.lit(1)).alias("__n"))
    plan = written(plan_of(counts, block_rows, lane, weights, alpha), "mix-plan")
    rows = plan.select(F.aggregate("sources", _long(0), lambda a, x: a + x["rows"]).alias("n")).first()["n"]
    per_block = _long(block_rows)
    ranked = shuffled_rank(narrow, "__src", "__h", ["__at"], bucket_bits(rows)).withColumn("__block", _div(F.col("__rank"), per_block)).withColumn("__offset", F.col("__rank") % per_block)
    ranked = written(ranked.select("__doc", "__src", "__block", "__offset"), "mix-ranked")
    index = plan.select(F.posexplode("sources").alias("i", "x")).select("i", F.col("x.key").alias("__src"), F.col("x.blocks").alias("blocks"), F.col("x.rows").alias("rows"))
    # The table of sources is broadcast: it grows with their number only.
    heads = ranked.where("__offset = 0").join(F.broadcast(index), "__src").select("i", F.col("__block").alias("block"))
    slots = written(schedule(heads, plan, lane), "mix-slots")
    short = slots.join(F.broadcast(index), "i").where(F.col("block") == F.col("blocks") - 1).select(F.struct("slot", (F.col("blocks") * block_rows - F.col("rows")).alias("short")).alias("e"))
    ends = short.groupBy().agg(F.collect_list("e").alias("ends")).scalar()
    placed = slots.join(F.broadcast(index.select("i", "__src")), "i").select("__src", F.col("block").alias("__block"), "slot", "release", "deadline")
    lost = F.aggregate(F.filter("__ends", lambda e: e["slot"] < F.col("slot")), _long(0), lambda a, e: a + e["short"])
    placed = placed.withColumn("__ends", ends).withColumn("__first", F.col("slot") * per_block - lost).drop("__ends")
    mix = F.struct(F.col("__block").alias("block"), "slot", "release", "deadline", F.col("__offset").alias("offset"), (F.col("__first") + F.col("__offset")).alias("position")).alias("__mix")
    found = ranked.join(placed, ["__src", "__block"]).select("__doc", mix)
    if keep is not None:
        return found.select(*[F.col(f"__doc.k{n}").alias(c) for n, c in enumerate(keep)], "__mix")
    found = found.select(F.col("__doc.at").alias("at"), "__mix")
    rows = docs.select(where.alias("here"), whole_row(docs).alias("row"))
    return rows.join(found, F.col("here") == F.col("at")).select("row.*", "__mix")
