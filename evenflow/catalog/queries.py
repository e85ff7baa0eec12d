"""Registered queries: each takes (spark, folder of parquet tables) and returns a DataFrame.

Every query reads whole tables; parameters only choose window, block and landmark sizes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenflow.functions.columns import bucket, clean_text, recode
from evenflow.operators import experiment, grid, monitor, prep, ranking, repair, stateful, stats
from evenflow.operators.bounds import Bounds, bounds_table, category_counts, distribution, fit_bounds
from evenflow.operators.many_categories import fit_sparse_bounds, sparse_tumbling_blocks, sparse_window_monitor
from evenflow.operators.order import OrderedStream, category_dictionary, ordered_stream
from evenflow.operators.sketch import backward_sketch, forward_sketch
from evenflow.operators.segments import segmented_repair
from evenflow.session import ensure_checkpoint_dir, materialize, ship_package
from evenflow.sources import tables
from evenflow.sources.streams import append_sink, decode_messages, encode_messages, read_files
from evenflow.streaming.arrivals import arrival_gaps
from evenflow.streaming.event_order import list_states, order_events
from evenflow.streaming.stateful import stream_monitor, stream_repair

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Sizes used by the registered queries.
W, S, X = 40, 20, 20
USER_W, USER_S, USER_X = 20, 10, 10
CHUNK_STRATEGIES = ("optimal", "naive", "naive_reversed", "internal_swap", "greedy_swap", "weighted_greedy_swap")
RUN_REPORT = ("strategy", "edits", "fair_checks", "total_swaps", "compat_total_blocks", "compat_fair_blocks",
              "compat_windows", "compat_fair_windows", "total_blocks", "fair_blocks", "fair_windows")
GRID = [(100, 50, 100), (200, 50, 100), (500, 50, 50), (500, 50, 100)]


def query(name: str):
    def register(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return function(spark, folder)
        QUERIES[name] = run
        return function
    return register


def load(spark: SparkSession, folder: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    return df.select(*columns) if columns else df


def event_stream(spark, folder, *columns, **kw) -> OrderedStream:
    """All events as one stream."""
    df = load(spark, folder, "events", "ts", "event_id", "event_type", *columns)
    return ordered_stream(df, [], ["ts", "event_id"], **kw)


def user_streams(spark, folder, *columns) -> OrderedStream:
    """One stream per user."""
    df = load(spark, folder, "events", "user_id", "ts", "event_id", "event_type", *columns)
    return ordered_stream(df, ["user_id"], ["ts", "event_id"])


def item_stream(spark, folder, *columns, **kw) -> OrderedStream:
    """All line items as one stream."""
    by = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return ordered_stream(load(spark, folder, "lineitem", *by, *columns), [], by, **kw)


def event_bounds(spark, folder, block: int) -> Bounds:
    return fit_bounds(load(spark, folder, "events"), "event_type", block)


# -- categories, bounds, preparation ---------------------------------------------------------------------------

@query("category_dictionary")
def _(spark, folder):
    return category_dictionary(load(spark, folder, "events"), "event_type")


@query("distribution")
def _(spark, folder):
    return distribution(load(spark, folder, "orders"), "o_orderpriority")


@query("bounds")
def _(spark, folder):
    return bounds_table(load(spark, folder, "events"), "event_type", S)


@query("apportion")
def _(spark, folder):
    return bounds_table(load(spark, folder, "documents"), "lang", 7).select("category", "reorder_target")


@query("intersectional_distribution")
def _(spark, folder):
    return prep.intersectional_distribution(load(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("intersectional_bounds")
def _(spark, folder):
    crossed = prep.intersect(load(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"], "cross")
    return bounds_table(crossed, "cross", 50)


@query("topk_other")
def _(spark, folder):
    return prep.collapse_to_top(load(spark, folder, "part", "p_partkey", "p_type"), "p_type", 3, "type_top")


@query("recode_default")
def _(spark, folder):
    df = load(spark, folder, "customer", "c_custkey", "c_mktsegment")
    mapping = {"BUILDING": "building", "MACHINERY": "machinery"}
    return df.select("c_custkey", recode(clean_text("c_mktsegment"), mapping, "other").alias("segment"))


@query("bucket_strict")
def _(spark, folder):
    buckets = {"browse": ["view", "click"], "account": ["signup", "purchase"], "fault": ["error"]}
    return load(spark, folder, "events", "event_id", "event_type").select(
        "event_id", bucket(F.col("event_type"), buckets).alias("bucket"))


@query("bucket_else")
def _(spark, folder):
    df = prep.keep_members(load(spark, folder, "events", "event_id", "event_type"), "event_type",
                           ["view", "click", "error", "purchase"])
    moods = {"light": ["view", "click"], "dark": ["error"]}
    return df.withColumn("mood", bucket(F.col("event_type"), moods, "neutral")).drop("event_type")


@query("drop_value_keep_null")
def _(spark, folder):
    docs = load(spark, folder, "documents", "doc_id", "lang")
    quality = load(spark, folder, "labels", "doc_id", "quality")
    return prep.drop_value(docs.join(quality, "doc_id", "left"), "quality", 0)


@query("clean_dates")
def _(spark, folder):
    dirty = load(spark, folder, "orders", "o_orderkey", "o_orderdate", "o_orderstatus").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "d/M/yyyy"))
        .when(F.col("o_orderstatus") == "P", F.lit("--"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
    )
    return tables.clean_dates(dirty, "day", day_first=True)[0]


@query("quantile_bins")
def _(spark, folder):
    orders = load(spark, folder, "orders", "o_orderkey", "o_totalprice")
    model = prep.fit_adaptive_bins(orders, "o_totalprice")
    return model.transform(orders, "bin").select("o_orderkey", "bin")


@query("adaptive_bins_ties")
def _(spark, folder):
    sizes = load(spark, folder, "part", "p_partkey", "p_size").withColumn("size_class", F.least("p_size", F.lit(20)))
    model = prep.fit_adaptive_bins(sizes, "size_class")
    return model.transform(sizes, "bin").select("p_partkey", "bin")


@query("bin_summary")
def _(spark, folder):
    events = load(spark, folder, "events", "value")
    return prep.bin_summary(events, prep.fit_adaptive_bins(events, "value", 4))


@query("labelled_bins")
def _(spark, folder):
    customers = load(spark, folder, "customer", "c_custkey", "c_acctbal")
    model = prep.fit_quantile_bins(customers, "c_acctbal", 3)
    return customers.select("c_custkey", model.label(["low", "medium", "high"]).alias("balance"))


@query("attribute_catalog")
def _(spark, folder):
    return tables.attribute_catalog(load(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("minute_clock")
def _(spark, folder):
    stream = event_stream(spark, folder)
    return prep.minute_clock(stream, "stream_date").select("event_id", "stream_date")


@query("json_messages")
def _(spark, folder):
    events = load(spark, folder, "events", "event_id", "event_type", "value")
    sent = encode_messages(events, F.col("event_type"))
    wire = sent.select(
        F.encode("key", "utf-8").alias("key"), F.encode("value", "utf-8").alias("value"),
        F.lit(0).alias("partition"), F.lit(0).cast("long").alias("offset"), F.current_timestamp().alias("timestamp"),
    )
    return decode_messages(wire, events.schema).select("stream_key", "event_id", "event_type", "value")


# -- order and sketches ----------------------------------------------------------------------------------------

@query("positions")
def _(spark, folder):
    return event_stream(spark, folder).df.select("event_id", "pos")


@query("positions_by_user")
def _(spark, folder):
    return user_streams(spark, folder).df.select("user_id", "event_id", "pos")


@query("prefix_sketch")
def _(spark, folder):
    stream = event_stream(spark, folder, tile_rows=4096)
    return forward_sketch(stream, "event_type", event_bounds(spark, folder, S)).drop("ts", "event_type")


@query("suffix_sketch")
def _(spark, folder):
    stream = user_streams(spark, folder)
    return backward_sketch(stream, "event_type", event_bounds(spark, folder, S)).drop("ts", "event_type")


# -- monitoring ------------------------------------------------------------------------------------------------

@query("window_monitor")
def window_monitor_events(spark, folder):
    return monitor.window_monitor(event_stream(spark, folder), "event_type", event_bounds(spark, folder, S), W)


@query("window_monitor_by_user")
def _(spark, folder):
    return monitor.window_monitor(user_streams(spark, folder), "event_type", event_bounds(spark, folder, USER_S),
                                  USER_W)


@query("window_monitor_items")
def _(spark, folder):
    stream = item_stream(spark, folder, "l_linestatus", tile_rows=1 << 13)
    return monitor.window_monitor(stream, "l_linestatus", fit_bounds(load(spark, folder, "lineitem"), "l_linestatus", 10), 100)


@query("window_monitor_floor_only")
def _(spark, folder):
    bounds = event_bounds(spark, folder, S).floor_only()
    return monitor.window_monitor(event_stream(spark, folder), "event_type", bounds, W)


@query("window_monitor_target_floor")
def _(spark, folder):
    bounds = event_bounds(spark, folder, S).target_as_floor()
    return monitor.window_monitor(event_stream(spark, folder), "event_type", bounds, W)


@query("tumbling_blocks")
def _(spark, folder):
    return monitor.tumbling_blocks(event_stream(spark, folder), "event_type", event_bounds(spark, folder, S))


@query("window_monitor_suppliers")
def _(spark, folder):
    """Suppliers of the line items: as many categories as suppliers."""
    bounds = fit_sparse_bounds(load(spark, folder, "lineitem"), "l_suppkey", 10)
    return sparse_window_monitor(item_stream(spark, folder), "l_suppkey", bounds, 50)


@query("window_monitor_user_mix")
def _(spark, folder):
    """Users of each event type's stream, one stream per type; a user is a category."""
    df = load(spark, folder, "events", "ts", "event_id", "event_type", "user_id")
    stream = ordered_stream(df, ["event_type"], ["ts", "event_id"])
    return sparse_window_monitor(stream, "user_id", fit_sparse_bounds(df, "user_id", 5), 20)


@query("tumbling_blocks_parts")
def _(spark, folder):
    """Parts of the line items in aligned blocks: items missing below the floors and beyond the ceilings."""
    bounds = fit_sparse_bounds(load(spark, folder, "lineitem"), "l_partkey", 100)
    return sparse_tumbling_blocks(item_stream(spark, folder), "l_partkey", bounds)


@query("block_deficits")
def _(spark, folder):
    return monitor.block_deficits(event_stream(spark, folder), "event_type", event_bounds(spark, folder, S))


@query("remaining_deficit")
def _(spark, folder):
    return monitor.remaining_deficit(user_streams(spark, folder), "event_type", event_bounds(spark, folder, USER_S))


@query("first_unfair_block")
def _(spark, folder):
    return monitor.first_unfair_block(user_streams(spark, folder), "event_type", event_bounds(spark, folder, USER_S))


@query("sliding_blocks")
def _(spark, folder):
    stream = item_stream(spark, folder, "l_returnflag")
    return monitor.sliding_blocks(stream, "l_returnflag", fit_bounds(load(spark, folder, "lineitem"), "l_returnflag", 30))


@query("sliding_fair_count")
def _(spark, folder):
    return monitor.sliding_fair_count(user_streams(spark, folder), "event_type", event_bounds(spark, folder, USER_S))


@query("backward_blocks")
def _(spark, folder):
    return monitor.backward_blocks(event_stream(spark, folder), "event_type", event_bounds(spark, folder, S))


@query("hopping_windows")
def _(spark, folder):
    return monitor.hopping_windows(event_stream(spark, folder), "event_type", event_bounds(spark, folder, S), W, 7)


@query("hopping_summary")
def _(spark, folder):
    return monitor.hopping_summary(user_streams(spark, folder), "event_type",
                                   event_bounds(spark, folder, USER_S).floor_only(), USER_W, 5)


@query("monitor_running")
def _(spark, folder):
    return monitor.monitor_running(event_stream(spark, folder), "event_type", event_bounds(spark, folder, S), W)


@query("monitor_summary")
def _(spark, folder):
    return monitor.monitor_summary(user_streams(spark, folder), "event_type", event_bounds(spark, folder, USER_S),
                                   USER_W)


@query("monitor_summary_bounded")
def _(spark, folder):
    return monitor.monitor_summary(user_streams(spark, folder), "event_type", event_bounds(spark, folder, USER_S),
                                   USER_W, max_windows=25)


@query("window_updates")
def _(spark, folder):
    updates = monitor.window_updates(user_streams(spark, folder), "event_type", event_bounds(spark, folder, USER_S),
                                     USER_W)
    return updates.select("user_id", "window_number", "is_fair", "fair_text", "metrics.*", "attribute",
                          F.array_join("window_items", ",").alias("items"))


@query("interarrival")
def _(spark, folder):
    return arrival_gaps(event_stream(spark, folder), "ts")


@query("latency_report")
def _(spark, folder):
    report = monitor.latency_report(load(spark, folder, "events"), ["event_type"], "value", X + 1)
    return report.select("event_type", "calls", *[
        F.round(c, 6).alias(c) for c in ("mean_ms", "p90_ms", "windows_per_second")])


@query("stream_window_monitor")
def _(spark, folder):
    return drain(spark, stream_monitor(
        live_events(spark, folder), ["user_id"], ["ts", "event_id"], "event_type",
        event_bounds(spark, folder, USER_S), USER_W,
    ))


@query("stream_repair")
def _(spark, folder):
    return drain(spark, stream_repair(
        live_events(spark, folder), ["user_id"], ["ts", "event_id"], "event_type",
        event_bounds(spark, folder, USER_S), USER_W, USER_X,
    ))


@query("stream_repair_closed")
def _(spark, folder):
    """A bounded replay: every user's last event closes the user, so all rows are delivered."""
    live = live_events(spark, folder)
    last = load(spark, folder, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    marked = live.join(last, "user_id").withColumn("closes", F.col("event_id") == F.col("last.event_id")).drop("last")
    repaired = stream_repair(marked, ["user_id"], ["ts", "event_id"], "event_type", event_bounds(spark, folder, USER_S),
                             USER_W, USER_X, "naive_reversed", closes="closes")
    event = F.get_json_object("value", "$.event_id").cast("long")
    return drain(spark, repaired).select("user_id", "out_pos", "category", event.alias("event_id"))


REPLAY_BATCHES, REPLAY_FILES = 7, 4


@query("stream_event_order")
def _(spark, folder):
    """The events arrive out of order, some of them late, in micro-batches; every user's rows come out in event order."""
    events = load(spark, folder, "events", "user_id", "ts", "event_id", "event_type")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    low, length = events.agg(F.min(micros), F.max(micros) - F.min(micros)).first()
    if length is None:
        low, length = 0, 0
    # Every row is up to a sixtieth of the whole time under way, each twentieth row six times as long.
    travel = ((F.col("event_id") * 7919) % 1009) * F.expr(f"{length} div 60540") * F.when(F.col("event_id") % 20 == 0, 6).otherwise(1)
    number = F.least(F.lit(REPLAY_BATCHES - 1), F.floor((micros - low + travel) * REPLAY_BATCHES / (length + 1)))
    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("_batch"), "event_id")) == 1
    arriving = materialize(events.withColumn("_batch", number.cast("int")).withColumn("closes", last), ["_batch"])
    path = f"{ensure_checkpoint_dir(spark)}/replay-{uuid.uuid4().hex}"
    for batch in range(REPLAY_BATCHES):  # files of a batch are older than those of the next
        arriving.where(F.col("_batch") == batch).drop("_batch").repartition(REPLAY_FILES).write.mode("append").parquet(path)
    live = read_files(spark, path, arriving.drop("_batch").schema, REPLAY_FILES)
    ordered = order_events(live, ["user_id"], "ts", ["event_id"], length // 50000, closes="closes")
    with list_states(spark):
        rows = drain(spark, ordered)
    return rows.select("user_id", "event_id", F.when(~F.col("late"), F.col("place")).alias("place"), "late")


def live_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a file stream."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder).select(
        "user_id", "ts", "event_id", "event_type")


def drain(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Run a stream over what is there now and return what it wrote, in the shared checkpoint folder."""
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    run = append_sink(df, f"{base}/out", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


# -- repair ----------------------------------------------------------------------------------------------------

def event_chunks(spark, folder):
    return repair.cut_chunks(event_stream(spark, folder), "event_type", event_bounds(spark, folder, S), W, X, ["event_id"])


def _repair_query(name):
    @query(f"repair_{name}")
    def _(spark, folder):
        return repair.repair_chunks(event_chunks(spark, folder), [name]).drop("pos")


for _name in CHUNK_STRATEGIES:
    _repair_query(_name)


@query("repair_remainder")
def _(spark, folder):
    return repair.repair_chunks(event_chunks(spark, folder), ["optimal"]).drop("pos")


@query("repair_optimal_fair_blocks")
def _(spark, folder):
    """Fair sliding blocks of every optimally repaired chunk."""
    repaired = repair.repair_chunks(event_chunks(spark, folder), ["optimal"])
    rows = repaired.select("chunk", "category", F.col("position_in_chunk").cast("long").alias("place"))
    return monitor.sliding_fair_count(OrderedStream(rows, ("chunk",), "place"), "category",
                                      event_bounds(spark, folder, S))


@query("repair_keeps_rows")
def _(spark, folder):
    """Per chunk and strategy: rows and events of every category, and rows out of first-in-first-out order."""
    repaired = repair.repair_chunks(event_chunks(spark, folder), CHUNK_STRATEGIES)
    seat = along("chunk", "strategy", "category", order="position_in_chunk")
    late = F.lag("source_position").over(seat) > F.col("source_position")
    return repaired.withColumn("_late", late).groupBy("chunk", "strategy", "category").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("event_ids"), F.count_if("_late").alias("out_of_order"))


def along(*partition, order):
    return Window.partitionBy(*partition).orderBy(order)


@query("chunk_pattern_bound")
def _(spark, folder):
    potential = repair.chunk_potential(event_chunks(spark, folder))
    return potential.select("chunk", "tileable", "pattern_copies", F.array_join(
        F.transform("remainders", lambda x: x.cast("string")), ",").alias("remainders"))


@query("chunk_potential")
def _(spark, folder):
    return repair.chunk_potential(event_chunks(spark, folder)).select("chunk", "longest_fair", "attainable_blocks")


@query("chunk_scores_before")
def _(spark, folder):
    return chunk_plan_scores(spark, folder, ["before"]).drop("strategy")


@query("chunk_scores")
def _(spark, folder):
    chunks = event_chunks(spark, folder)
    labelled = chunks.df.select(*chunks.by, repair.chunk_labels().alias("labels"))
    scores = repair.plan_scores(labelled, "labels", ["before", *CHUNK_STRATEGIES], chunks.bounds, W, X)
    return monitor.score_totals(scores.withColumn("total_blocks", F.col("windows") * (W // S)), ["strategy"])


def chunk_plan_scores(spark, folder, strategies) -> DataFrame:
    chunks = event_chunks(spark, folder)
    labelled = chunks.df.select(*chunks.by, repair.chunk_labels().alias("labels"))
    plans = repair.plan_templates(labelled, "labels", strategies, chunks.bounds, W, X)
    return repair.score_templates(plans, chunks.by, "labels", chunks.bounds, W)


def user_trace(spark, folder, *columns, **kw):
    return stateful.stateful_repair(user_streams(spark, folder, *columns), "event_type", event_bounds(spark, folder, USER_S),
                                    USER_W, USER_X, **kw)


@query("repair_stateful")
def _(spark, folder):
    return user_trace(spark, folder, log_edits=False).delivered(["event_id"]).drop("pos")


@query("repair_stateful_reversed")
def _(spark, folder):
    """Windowed repair of every user's stream by the reversed pattern."""
    return user_trace(spark, folder, primary="naive_reversed", log_edits=False).delivered(["event_id"]).drop("pos")


@query("repair_one_stream")
def _(spark, folder):
    """All events as one stream, repaired in segments that run at the same time."""
    trace = segmented_repair(event_stream(spark, folder), "event_type", event_bounds(spark, folder, USER_S), USER_W, USER_X,
                             primary="naive_reversed", log_edits=False, segment_rows=1 << 11)
    return trace.delivered(["event_id"]).drop("pos")


@query("repair_captures_reversed")
def _(spark, folder):
    return user_trace(spark, folder, primary="naive_reversed").captures(["event_id"]).drop("pos")


@query("strategy_compare_reversed")
def _(spark, folder):
    """Run report of a repair by the reversed pattern, before and after."""
    trace = user_trace(spark, folder, primary="naive_reversed")
    report = stateful.strategy_metrics(trace, ["naive_reversed"], by=[])
    return report.select(*RUN_REPORT)


@query("repair_stateful_delivery")
def _(spark, folder):
    """Every row of every user is delivered exactly once."""
    delivered = user_trace(spark, folder, log_edits=False).delivered(["event_id"])
    return delivered.groupBy("user_id", "category").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("events"), F.sum("event_id").alias("event_ids"))


@query("repair_captures")
def _(spark, folder):
    return user_trace(spark, folder).captures(["event_id"]).drop("pos")


@query("strategy_compare")
def _(spark, folder):
    return stateful.strategy_metrics(user_trace(spark, folder), CHUNK_STRATEGIES, by=[])


# -- ranking quality -------------------------------------------------------------------------------------------

def shuffled_captures(spark, folder) -> DataFrame:
    """Chunks of events in arrival order and in a seeded order, with the event value as relevance."""
    size = W + X
    stream = event_stream(spark, folder, "value")
    chunked = stream.df.withColumns({
        "chunk": F.expr(f"pos div {size}"), "place": F.col("pos") % size,
        "seed": prep.shuffle_key(F.lit(1), "event_id"),
        "relevance": F.when(F.col("value") < 20, 0.0).otherwise(F.col("value")),
    })
    shuffled = chunked.withColumn("place", F.row_number().over(along("chunk", order="seed")) - 1)
    sides = [df.select(F.lit(phase).alias("phase"), "chunk", F.col("place").cast("long").alias("place"), "relevance")
             for phase, df in (("original", chunked), ("reordered", shuffled))]
    return sides[0].unionByName(sides[1])


@query("ndcg_window")
def _(spark, folder):
    scored = ranking.ndcg_windows(shuffled_captures(spark, folder), ["phase", "chunk"], "place", "relevance",
                                  [S, 50, None])
    return scored.select("phase", "chunk", F.coalesce("k", F.lit(0)).alias("k"), F.round("ndcg", 9).alias("ndcg"))


@query("ndcg_block")
def _(spark, folder):
    scored = ranking.ndcg_blocks(shuffled_captures(spark, folder), ["phase", "chunk"], "place", "relevance", S)
    return scored.withColumn("ndcg", F.round("ndcg", 9))


@query("ndcg_summary")
def _(spark, folder):
    report = ranking.ndcg_report(shuffled_captures(spark, folder), [], ["chunk"], "relevance", S, [50], "place")
    return report.drop("wilcoxon_p").select("cutoff", "k", "n", *[
        F.round(c, 6).alias(c) for c in report.columns if c not in ("cutoff", "k", "n", "wilcoxon_p")])


@query("ndcg_cost_of_repair")
def _(spark, folder):
    captures = user_trace(spark, folder, "value").captures(["value"])
    return ranking.ndcg_report(captures, [], ["user_id", "episode", "edit_event"], "value", USER_S, [50])


# -- runs, statistics, grids -----------------------------------------------------------------------------------

def seeded_events(spark, folder, runs) -> OrderedStream:
    return prep.seeded_runs(load(spark, folder, "events", "event_id", "event_type"), runs, ["event_id"])


@query("seeded_shuffle_monitor")
def _(spark, folder):
    return monitor.monitor_summary(seeded_events(spark, folder, 3), "event_type", event_bounds(spark, folder, S), W)


def run_metrics(spark, folder, runs=10) -> DataFrame:
    """Fair blocks and windows of seeded runs under three ways to judge a block, as a long metric table."""
    stream, bounds = seeded_events(spark, folder, runs), event_bounds(spark, folder, USER_S)
    judged = {"two_sided": bounds, "floor_only": bounds.floor_only(), "target_floor": bounds.target_as_floor()}
    wide = monitor.monitor_summaries(stream, "event_type", {name: (b, USER_W) for name, b in judged.items()})
    wide = wide.withColumnRenamed("case", "strategy")
    return stats.unpivot_metrics(wide, ["run_id", "strategy"], ["fair_blocks", "fair_windows"])


@query("describe_runs")
def _(spark, folder):
    described = stats.describe(run_metrics(spark, folder), ["strategy", "metric"])
    return described.select("strategy", "metric", "n", "median", "mode", "several_modes",
                            F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("significance")
def _(spark, folder):
    table = stats.significance(run_metrics(spark, folder), [], "two_sided")
    return table.select("strategy", "metric", "n", "n_nonzero", "significant", *[
        F.round(c, 6).alias(c) for c in ("base_mean", "primary_mean", "mean_diff", "t_stat", "t_p", "w_plus",
                                         "wilcoxon_z")])


@query("wilcoxon_exact")
def _(spark, folder):
    pairs = run_pairs(spark, folder)
    return stats.wilcoxon(pairs, ["metric"], "base", "other").select(
        "metric", "n_nonzero", "w_plus", F.round("wilcoxon_p", 9).alias("wilcoxon_p"))


def run_pairs(spark, folder) -> DataFrame:
    """Two run metrics paired by run: one value per run and side."""
    stream, bounds = seeded_events(spark, folder, 10), event_bounds(spark, folder, USER_S)
    cases = {"base": (bounds, USER_W), "other": (bounds, 2 * USER_W)}
    sides = monitor.monitor_summaries(stream, "event_type", cases).groupBy("run_id").agg(*[
        F.max(F.when(F.col("case") == c, F.col("pct_fair"))).alias(c) for c in cases])
    return sides.select(F.lit("pct_fair").alias("metric"), "base", "other")


@query("paired_t")
def _(spark, folder):
    tested = stats.paired_t(run_pairs(spark, folder), ["metric"], "base", "other")
    return tested.select("metric", "n", *[F.round(c, 6).alias(c) for c in ("mean_diff", "t_stat", "t_p")])


def grid_results(spark, folder) -> DataFrame:
    counts = category_counts(load(spark, folder, "events"), "event_type")
    return grid.monitor_grid(seeded_events(spark, folder, 2), "event_type", counts, GRID)


@query("grid_monitor")
def _(spark, folder):
    return grid_results(spark, folder)


@query("grid_missing")
def _(spark, folder):
    done = grid_results(spark, folder)
    categories = len(category_counts(load(spark, folder, "events"), "event_type"))
    wanted = grid.grid_configs(grid.sweep_table(spark), categories)
    return grid.missing_configs(wanted, done, grid.CONFIG)


@query("config_averages")
def _(spark, folder):
    configs = grid.grid_configs(grid.sweep_table(spark))
    averages = grid.config_averages(grid_results(spark, folder), configs, ["windows", "fair_blocks", "fair_windows"])
    name = tables.config_name(F.col("window"), F.col("block"), F.col("landmark"), F.lit("monitor"))
    return averages.withColumn("config", name).withColumn("parsed_block", tables.block_size_of(F.col("config")))


@query("sweep_summary")
def _(spark, folder):
    summary = grid.sweep_summary(grid_results(spark, folder), grid.sweep_table(spark), "W", "window", "fair_blocks")
    return summary.select("sweep_value", "mean", F.round("std", 6).alias("std"))


@query("grid_repair")
def _(spark, folder):
    counts = category_counts(load(spark, folder, "events"), "event_type")
    return grid.repair_grid(seeded_events(spark, folder, 2), "event_type", counts, [(100, 50, 100), (500, 50, 50)],
                            ["optimal", "naive", "internal_swap"], max_windows=500)


@query("grid_repair_reversed")
def _(spark, folder):
    """The windows of the standard slow phase, repaired by the reversed pattern: one job for all configurations."""
    counts = category_counts(load(spark, folder, "events"), "event_type")
    report = grid.repair_grid(seeded_events(spark, folder, 2), "event_type", counts, GRID, ["naive_reversed"],
                              "naive_reversed", grid.PHASES["slow"][0])
    return report.select(*grid.CONFIG, "run_id", *RUN_REPORT)


@query("experiment_sweeps")
def _(spark, folder):
    """The standard experiment: every point of the three sweeps, both phases with their strategies, ten runs."""
    return experiment.run_experiment(load(spark, folder, "events", "event_id", "event_type"), "event_type",
                                     ["event_id"], grid.sweep_table(spark))


@query("experiment_significance")
def _(spark, folder):
    """The optimal strategy against every other one of both standard phases, paired by run."""
    points = grid.sweep_table(spark, {"W": {"window": [100, 200], "block": [50], "landmark": [100]}})
    return experiment.compare_experiment(experiment.run_experiment(
        load(spark, folder, "events", "event_id", "event_type"), "event_type", ["event_id"], points, runs=3))
