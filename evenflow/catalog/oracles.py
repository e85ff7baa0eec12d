"""The same results in plain SQL, written from the definitions and not from the Spark plans.

Blocks are counted with sliding frames over every category, bounds with integer arithmetic. A query without
an entry here is iterative (planners, swaps, windowed repair) or needs functions plain SQL lacks.
"""

from __future__ import annotations

from evenflow.catalog.queries import GRID, REPLAY_BATCHES, S, USER_S, USER_W, USER_X, W, X
from evenflow.operators.grid import PHASES, SWEEPS

ORACLES: dict[str, str] = {}
SLOW_WINDOWS = PHASES["slow"][0]

EVENT_ORDER = "ts, event_id"
ITEM_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def positioned(table: str, attr: str, order: str, keys: str = "", extra: str = "") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    cols = "".join(f"{c}, " for c in (keys, extra) if c)
    return f"SELECT {cols}{attr} AS g, row_number() OVER ({part}ORDER BY {order}) - 1 AS pos FROM {table}"


def bounds_cte(table: str, attr: str, block: int, mode: str = "two_sided") -> str:
    low, high = {"two_sided": ("lo", "hi"), "floor_only": ("lo", str(block)), "target_floor": ("tgt", str(block))}[mode]
    return f"""
      bnd AS (
        SELECT g, gidx, n, total, lo0 AS lo0, hi0, tgt0, {low}0 AS lo, {high if high.isdigit() else high + '0'} AS hi
        FROM (
          SELECT g, gidx, n, total, lo0, lo0 + CASE WHEN rest > 0 THEN 1 ELSE 0 END AS hi0,
                 lo0 + CASE WHEN row_number() OVER (ORDER BY rest DESC, gidx) <= {block} - sum(lo0) OVER ()
                       THEN 1 ELSE 0 END AS tgt0
          FROM (
            SELECT g, row_number() OVER (ORDER BY g) - 1 AS gidx, n, CAST(sum(n) OVER () AS BIGINT) AS total,
                   (n * {block}) // CAST(sum(n) OVER () AS BIGINT) AS lo0,
                   (n * {block}) % CAST(sum(n) OVER () AS BIGINT) AS rest
            FROM (SELECT {attr} AS g, count(*) AS n FROM {table} WHERE {attr} IS NOT NULL GROUP BY 1)
          )
        )
      )"""


def block_ctes(block: int, keys: str = "") -> str:
    """``cnt``: per row and category the count in the block that ends there; ``blk``: verdict per block end."""
    k = f"{keys}, " if keys else ""
    return f"""
      cnt AS (
        SELECT {k}pos, cat, gidx, lo, hi, c FROM (
          SELECT s.*, b.g AS cat, b.gidx, b.lo, b.hi,
                 CAST(sum(CASE WHEN s.g = b.g THEN 1 ELSE 0 END) OVER
                   (PARTITION BY {k}b.g ORDER BY pos ROWS BETWEEN {block - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS c
          FROM s CROSS JOIN bnd b
        ) WHERE pos >= {block - 1}
      ),
      blk AS (SELECT {k}pos, bool_and(c BETWEEN lo AND hi) AS fair FROM cnt GROUP BY {k}pos)"""


def window_cte(window: int, block: int, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    blocks = window // block
    return f"""
      win AS (
        SELECT {k}pos - {window - 2} AS window_number, fair_blocks, fair_blocks = {blocks} AS is_fair FROM (
          SELECT {k}pos, CAST(sum(CASE WHEN fair THEN 1 ELSE 0 END) OVER
                   (PARTITION BY {k}pos % {block} ORDER BY pos ROWS BETWEEN {blocks - 1} PRECEDING AND CURRENT ROW)
                   AS BIGINT) AS fair_blocks
          FROM blk
        ) WHERE pos >= {window - 1}
      )"""


def monitored(source: str, table: str, attr: str, window: int, block: int, keys: str = "", mode: str = "two_sided") -> str:
    """WITH clause up to ``win``."""
    return (f"WITH s AS ({source}), {bounds_cte(table, attr, block, mode)}, {block_ctes(block, keys)}, "
            f"{window_cte(window, block, keys)} ")


EVENTS = positioned("events", "event_type", EVENT_ORDER, extra="event_id")
USERS = positioned("events", "event_type", EVENT_ORDER, "user_id", "event_id")


def event_windows(mode: str = "two_sided", window: int = W, block: int = S) -> str:
    return monitored(EVENTS, "events", "event_type", window, block, mode=mode)


def user_windows(mode: str = "two_sided") -> str:
    return monitored(USERS, "events", "event_type", USER_W, USER_S, "user_id", mode)


def summary(by: str, blocks: int) -> str:
    k = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
      SELECT {k}count(*) AS windows, count(*) * {blocks} AS total_blocks,
             CAST(sum(fair_blocks) AS BIGINT) AS fair_blocks,
             CAST(sum(fair_blocks) AS BIGINT) * 100 / (count(*) * {blocks}) AS pct_fair,
             count(*) FILTER (WHERE is_fair) AS fair_windows, count(*) FILTER (WHERE is_fair) * 100 / count(*) AS pct_fair_windows
      FROM win {group}"""


def per_category(expression: str, names: list[str], prefix: str) -> str:
    return ", ".join(
        f"{expression.format(name=name)} AS {prefix}{i}" for i, name in enumerate(names)
    )


# -- categories, bounds, preparation ---------------------------------------------------------------------------

ORACLES["category_dictionary"] = """
  SELECT event_type AS category, row_number() OVER (ORDER BY event_type) - 1 AS gidx, n
  FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)"""
ORACLES["distribution"] = """
  SELECT o_orderpriority AS category, row_number() OVER (ORDER BY o_orderpriority) - 1 AS gidx, n,
         CAST(sum(n) OVER () AS BIGINT) AS total, n / CAST(sum(n) OVER () AS BIGINT) AS percentage
  FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)"""
BOUNDS_ROWS = "SELECT g AS category, n / total AS percentage, tgt0 AS reorder_target, lo0 AS floor, hi0 AS ceiling FROM bnd"
ORACLES["bounds"] = f"WITH {bounds_cte('events', 'event_type', S)} {BOUNDS_ROWS}"
ORACLES["apportion"] = f"WITH {bounds_cte('documents', 'lang', 7)} SELECT g AS category, tgt0 AS reorder_target FROM bnd"
CROSS = "o_orderstatus || ' | ' || o_orderpriority"
ORACLES["intersectional_distribution"] = f"""
  SELECT g AS category, row_number() OVER (ORDER BY g) - 1 AS gidx, n, CAST(sum(n) OVER () AS BIGINT) AS total,
         n / CAST(sum(n) OVER () AS BIGINT) AS percentage
  FROM (SELECT {CROSS} AS g, count(*) AS n FROM orders GROUP BY 1)"""
ORACLES["intersectional_bounds"] = f"WITH {bounds_cte('orders', CROSS, 50)} {BOUNDS_ROWS}"
ORACLES["topk_other"] = """
  WITH top AS (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 3)
  SELECT p_partkey, p_type, CASE WHEN p_type IN (SELECT p_type FROM top) THEN p_type ELSE 'Other' END AS type_top
  FROM part"""
ORACLES["recode_default"] = """
  SELECT c_custkey, CASE trim(c_mktsegment) WHEN 'BUILDING' THEN 'building' WHEN 'MACHINERY' THEN 'machinery'
                    ELSE 'other' END AS segment FROM customer"""
ORACLES["bucket_strict"] = """
  SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'browse'
                        WHEN event_type IN ('signup', 'purchase') THEN 'account' ELSE 'fault' END AS bucket FROM events"""
ORACLES["bucket_else"] = """
  SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'light' WHEN event_type = 'error' THEN 'dark'
                   ELSE 'neutral' END AS mood
  FROM events WHERE event_type IN ('view', 'click', 'error', 'purchase')"""
ORACLES["drop_value_keep_null"] = """
  SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)
  WHERE l.quality IS DISTINCT FROM 0"""
ORACLES["clean_dates"] = """
  SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS day FROM orders WHERE o_orderstatus <> 'P'"""


def edges_cte(table: str, value: str, sizes: list[int]) -> str:
    """Interpolated quantile edges k/q with exact integer ranks, coinciding edges once."""
    fractions = ", ".join(f"({q}, {k})" for q in sizes for k in range(q + 1))
    return f"""
      ranked AS (SELECT {value} AS v, row_number() OVER (ORDER BY {value}) - 1 AS r, count(*) OVER () AS n
                 FROM {table} WHERE {value} IS NOT NULL),
      frac(q, k) AS (VALUES {fractions}),
      edge AS (
        SELECT DISTINCT q, CASE WHEN rest = 0 THEN a.v ELSE a.v + (b.v - a.v) * (rest / q) END AS e
        FROM (SELECT q, k, (k * (n - 1)) // q AS lo, (k * (n - 1)) % q AS rest, n - 1 AS top
              FROM frac, (SELECT count(*) AS n FROM ranked))
        JOIN ranked a ON a.r = lo JOIN ranked b ON b.r = least(lo + 1, top)
      ),
      inner_edge AS (SELECT q, e FROM (SELECT q, e, min(e) OVER (PARTITION BY q) AS a, max(e) OVER (PARTITION BY q) AS z
                                       FROM edge) WHERE e > a AND e < z)"""


def adaptive_cte(table: str, key: str, value: str, max_bins: int) -> str:
    sizes = list(range(1, max_bins + 1))
    return f"""{edges_cte(table, value, sizes)},
      coded AS (
        SELECT qs.q, t.{key} AS id, t.{value} AS v,
               (SELECT count(*) FROM inner_edge i WHERE i.q = qs.q AND t.{value} > i.e) AS code
        FROM {table} t, (SELECT DISTINCT q FROM frac) qs
      ),
      share AS (SELECT q, code, count(*) AS n FROM coded GROUP BY 1, 2),
      best AS (SELECT max(q) AS q FROM (SELECT q, min(n) / sum(n) AS smallest FROM share GROUP BY q)
               WHERE smallest >= 0.15)"""


ORACLES["quantile_bins"] = f"""
  WITH {adaptive_cte('orders', 'o_orderkey', 'o_totalprice', 5)}
  SELECT id AS o_orderkey, code AS bin FROM coded JOIN best USING (q)"""
ORACLES["adaptive_bins_ties"] = f"""
  WITH sized AS (SELECT p_partkey, least(p_size, 20) AS size_class FROM part),
  {adaptive_cte('sized', 'p_partkey', 'size_class', 5)}
  SELECT id AS p_partkey, code AS bin FROM coded JOIN best USING (q)"""
ORACLES["bin_summary"] = f"""
  WITH {adaptive_cte('events', 'event_id', 'value', 4)},
  bounds AS (SELECT row_number() OVER (ORDER BY e) - 1 AS bin, e AS lo, lead(e) OVER (ORDER BY e) AS hi
             FROM edge JOIN best USING (q)),
  counted AS (SELECT code, count(*) AS n FROM coded JOIN best USING (q) GROUP BY 1)
  SELECT 'value' AS column, bin, printf('%s%.2f, %.2f]', CASE WHEN bin = 0 THEN '[' ELSE '(' END, lo, hi) AS range,
         coalesce(n, 0) AS count, printf('%.1f%%', coalesce(n, 0) * 100 / (SELECT sum(n) FROM counted)) AS percent
  FROM bounds LEFT JOIN counted ON code = bin WHERE hi IS NOT NULL"""
ORACLES["labelled_bins"] = f"""
  WITH {edges_cte('customer', 'c_acctbal', [3])}
  SELECT c_custkey, CASE (SELECT count(*) FROM inner_edge WHERE c_acctbal > e)
                    WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS balance FROM customer"""
ORACLES["attribute_catalog"] = """
  SELECT attribute, row_number() OVER (PARTITION BY attribute ORDER BY value) - 1 AS rank, value FROM (
    SELECT DISTINCT 'o_orderstatus' AS attribute, o_orderstatus AS value FROM orders
    UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders)"""
ORACLES["minute_clock"] = f"""
  WITH s AS ({EVENTS}) SELECT event_id, TIMESTAMP '2020-01-01 00:00:00' + to_minutes(pos) AS stream_date FROM s"""
ORACLES["json_messages"] = "SELECT event_type AS stream_key, event_id, event_type, value FROM events"

# -- order and sketches ----------------------------------------------------------------------------------------

ORACLES["positions"] = f"WITH s AS ({EVENTS}) SELECT event_id, pos FROM s"
ORACLES["positions_by_user"] = f"WITH s AS ({USERS}) SELECT user_id, event_id, pos FROM s"
ORACLES["prefix_sketch"] = f"""
  WITH s AS ({EVENTS}) SELECT event_id, pos, {per_category(
      "CAST(count(*) FILTER (WHERE g = '{name}') OVER (ORDER BY pos) AS BIGINT)", EVENT_TYPES, "p")} FROM s"""
ORACLES["suffix_sketch"] = f"""
  WITH s AS ({USERS}) SELECT user_id, event_id, pos, {per_category(
      "CAST(count(*) FILTER (WHERE g = '{name}') OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND "
      "UNBOUNDED FOLLOWING) AS BIGINT)", EVENT_TYPES, "b")} FROM s"""

# -- monitoring ------------------------------------------------------------------------------------------------

ORACLES["window_monitor"] = event_windows() + "SELECT * FROM win"
ORACLES["window_monitor_by_user"] = user_windows() + "SELECT * FROM win"
ORACLES["window_monitor_items"] = monitored(
    positioned("lineitem", "l_linestatus", ITEM_ORDER), "lineitem", "l_linestatus", 100, 10) + "SELECT * FROM win"
ORACLES["window_monitor_floor_only"] = event_windows("floor_only") + "SELECT * FROM win"
ORACLES["window_monitor_target_floor"] = event_windows("target_floor") + "SELECT * FROM win"


def many_categories(source: str, table: str, attr: str, block: int) -> str:
    """WITH clause up to ``bnd``, for attributes that no column per category can hold."""
    return f"""WITH s AS ({source}),
      cnt AS (SELECT {attr} AS g, count(*) AS n FROM {table} WHERE {attr} IS NOT NULL GROUP BY 1),
      bnd AS (SELECT g, n * {block} // t AS lo, n * {block} // t + CASE WHEN n * {block} % t > 0 THEN 1 ELSE 0 END AS hi
              FROM cnt, (SELECT sum(n)::BIGINT AS t FROM cnt)),
      need AS (SELECT count(*) AS kinds, coalesce(sum(lo), 0) AS places FROM bnd WHERE lo > 0)"""


def many_windows(source: str, table: str, attr: str, window: int, block: int, key: str = "") -> str:
    k, same = (f"{key}, ", lambda a, b: f"AND {a}.{key} = {b}.{key}") if key else ("", lambda a, b: "")
    of = lambda alias: f"{alias}.{key}, " if key else ""
    return f"""{many_categories(source, table, attr, block)},
      ends AS (SELECT {k}g, unnest(range(pos, pos + {block})) AS e FROM s),
      per AS (SELECT {k}e, g, count(*) AS c FROM ends GROUP BY ALL),
      blk AS (SELECT {k}e, count(*) FILTER (c < lo OR c > hi) AS bad, count(*) FILTER (lo > 0) AS have
              FROM per JOIN bnd USING (g) GROUP BY ALL),
      fair AS (SELECT {k}e, CASE WHEN bad = 0 AND have = kinds THEN 1 ELSE 0 END AS ok FROM blk, need),
      win AS (SELECT {of('s')}s.pos AS e, sum(f.ok)::BIGINT AS fair_blocks
              FROM (SELECT {k}pos, unnest(range(pos - {window - block}, pos + 1, {block})) AS at FROM s WHERE pos >= {window - 1}) s
              JOIN fair f ON f.e = s.at {same('f', 's')} GROUP BY ALL)
    SELECT {k}e - {window - 2} AS window_number, fair_blocks, fair_blocks = {window // block} AS is_fair FROM win"""


ORACLES["window_monitor_suppliers"] = many_windows(
    positioned("lineitem", "l_suppkey", ITEM_ORDER), "lineitem", "l_suppkey", 50, 10)
ORACLES["window_monitor_user_mix"] = many_windows(
    positioned("events", "user_id", EVENT_ORDER, "event_type"), "events", "user_id", 20, 5, "event_type")
ORACLES["tumbling_blocks_parts"] = f"""{many_categories(
    positioned("lineitem", "l_partkey", ITEM_ORDER), "lineitem", "l_partkey", 100)},
  per AS (SELECT pos // 100 AS block, g, count(*) AS c FROM s GROUP BY ALL),
  blk AS (SELECT block, sum(c) AS n, sum(least(c, lo)) AS met, sum(greatest(c - hi, 0)) AS over FROM per JOIN bnd USING (g) GROUP BY ALL)
  SELECT block, (places - met)::BIGINT AS deficit, over::BIGINT AS excess, met = places AND over = 0 AS is_fair
  FROM blk, need WHERE n = 100"""


def aligned(source: str, table: str, attr: str, block: int, keys: str = "", mode: str = "two_sided") -> str:
    """WITH clause up to ``tum``: one row per complete aligned block and category."""
    k = f"{keys}, " if keys else ""
    return f"""WITH s AS ({source}), {bounds_cte(table, attr, block, mode)},
      whole AS (SELECT {k}pos // {block} AS block FROM s GROUP BY ALL HAVING count(*) = {block}),
      tum AS (
        SELECT {k}w.block, b.g AS cat, b.gidx, b.lo, b.hi, count(*) FILTER (WHERE s.g = b.g) AS c
        FROM whole w JOIN s ON s.pos // {block} = w.block {f'AND s.{keys} = w.{keys}' if keys else ''}
        CROSS JOIN bnd b GROUP BY ALL
      ) """.replace(f"SELECT {k}w.block", f"SELECT {'w.' + keys + ', ' if keys else ''}w.block")


def counts_of(names: list[str], prefix: str = "c", value: str = "c") -> str:
    return ", ".join(f"CAST(max(CASE WHEN gidx = {i} THEN {value} END) AS BIGINT) AS {prefix}{i}" for i in range(len(names)))


ORACLES["tumbling_blocks"] = aligned(EVENTS, "events", "event_type", S) + f"""
  SELECT block, {counts_of(EVENT_TYPES)}, bool_and(c BETWEEN lo AND hi) AS is_fair FROM tum GROUP BY block"""
ORACLES["block_deficits"] = aligned(EVENTS, "events", "event_type", S) + f"""
  SELECT block, {counts_of(EVENT_TYPES, 'd', 'greatest(lo - c, 0)')},
         CAST(sum(greatest(lo - c, 0)) AS BIGINT) AS deficit FROM tum GROUP BY block"""
ORACLES["remaining_deficit"] = aligned(USERS, "events", "event_type", USER_S, "user_id") + """
  SELECT user_id, block, deficit, CAST(sum(deficit) OVER (PARTITION BY user_id ORDER BY block DESC) AS BIGINT)
         AS remaining_deficit
  FROM (SELECT user_id, block, CAST(sum(greatest(lo - c, 0)) AS BIGINT) AS deficit FROM tum GROUP BY 1, 2)"""
ORACLES["first_unfair_block"] = aligned(USERS, "events", "event_type", USER_S, "user_id") + f"""
  SELECT user_id, min(CASE WHEN NOT fair THEN block * {USER_S} END) AS first_unfair_start
  FROM (SELECT user_id, block, bool_and(c BETWEEN lo AND hi) AS fair FROM tum GROUP BY 1, 2) GROUP BY 1"""
ORACLES["sliding_blocks"] = f"""
  WITH s AS ({positioned("lineitem", "l_returnflag", ITEM_ORDER)}), {bounds_cte("lineitem", "l_returnflag", 30)},
  {block_ctes(30)}
  SELECT pos - 29 AS block_start, {counts_of(['A', 'N', 'R'])}, bool_and(c BETWEEN lo AND hi) AS is_fair
  FROM cnt GROUP BY pos"""
ORACLES["sliding_fair_count"] = user_windows() + """
  SELECT user_id, count(*) AS sliding_blocks, count(*) FILTER (WHERE fair) AS fair_blocks FROM blk GROUP BY 1"""
ORACLES["backward_blocks"] = aligned(EVENTS, "events", "event_type", S, mode="floor_only") + """
  SELECT block, bool_and(c >= lo) AS is_fair FROM tum GROUP BY block"""
ORACLES["hopping_windows"] = event_windows() + "SELECT * FROM win WHERE (window_number - 1) % 7 = 0"
ORACLES["hopping_summary"] = user_windows("floor_only") + f"""
  , hop AS (SELECT user_id, window_number - 1 AS start, is_fair FROM win WHERE (window_number - 1) % 5 = 0),
  covered AS (SELECT DISTINCT user_id, start + j * {USER_S} AS block_start
              FROM hop, range({USER_W // USER_S}) AS steps(j))
  SELECT user_id, windows, fair_windows, distinct_blocks, fair_distinct_blocks FROM
    (SELECT user_id, count(*) AS windows, count(*) FILTER (WHERE is_fair) AS fair_windows FROM hop GROUP BY 1)
    JOIN (SELECT c.user_id, count(*) AS distinct_blocks, count(*) FILTER (WHERE b.fair) AS fair_distinct_blocks
          FROM covered c JOIN blk b ON b.user_id = c.user_id AND b.pos = c.block_start + {USER_S - 1} GROUP BY 1)
    USING (user_id)"""
ORACLES["monitor_running"] = event_windows() + f"""
  SELECT *, CAST(sum(fair_blocks) OVER (ORDER BY window_number) AS BIGINT) AS fair_so_far,
         CAST(sum(fair_blocks) OVER (ORDER BY window_number) AS BIGINT) * 100 / (window_number * {W // S}) AS pct_so_far
  FROM win"""
ORACLES["monitor_summary"] = user_windows() + summary("user_id", USER_W // USER_S)
ORACLES["monitor_summary_bounded"] = user_windows() + summary("user_id", USER_W // USER_S).replace(
    "FROM win", "FROM win WHERE window_number <= 25")
ORACLES["stream_window_monitor"] = user_windows() + f"""
  SELECT *, CAST(sum(fair_blocks) OVER w AS BIGINT) AS fair_so_far,
         CAST(sum(fair_blocks) OVER w AS BIGINT) * 100 / (window_number * {USER_W // USER_S}) AS pct_so_far
  FROM win WINDOW w AS (PARTITION BY user_id ORDER BY window_number)"""
ORACLES["stream_event_order"] = f"""
  WITH span AS (SELECT min(epoch_us(ts)) AS low, max(epoch_us(ts)) - min(epoch_us(ts)) AS length FROM events),
  arrived AS (
    SELECT user_id, event_id, epoch_us(ts) AS us, length // 50000 * 1000 AS delay,
           least({REPLAY_BATCHES - 1}, floor((epoch_us(ts) - low + (event_id * 7919) % 1009 * (length // 60540)
             * CASE WHEN event_id % 20 = 0 THEN 6 ELSE 1 END) * {REPLAY_BATCHES} / (length + 1))) AS batch
    FROM events, span),
  marked AS (
    SELECT *, coalesce(us < max(us) OVER (PARTITION BY user_id ORDER BY batch GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - delay,
                       false) AS late FROM arrived)
  SELECT user_id, event_id,
         CASE WHEN NOT late THEN row_number() OVER (PARTITION BY user_id, late ORDER BY us, event_id) - 1 END AS place, late
  FROM marked"""
ORACLES["window_updates"] = user_windows() + f"""
  , items AS (SELECT user_id, pos - {USER_W - 2} AS window_number,
                     string_agg(g, ',') OVER (PARTITION BY user_id ORDER BY pos
                                              ROWS BETWEEN {USER_W - 1} PRECEDING AND CURRENT ROW) AS items FROM s)
  SELECT user_id, window_number, is_fair,
         CASE WHEN is_fair THEN 'Window is fair' ELSE 'Window is not fair' END AS fair_text,
         {USER_W} AS window_size, {USER_S} AS block_size, window_number AS windows_covered,
         CAST(sum(fair_blocks) OVER w AS BIGINT) AS fair_blocks, window_number * {USER_W // USER_S} AS total_blocks,
         round(CAST(sum(fair_blocks) OVER w AS BIGINT) * 100 / (window_number * {USER_W // USER_S}), 2)
           AS fair_block_pct, 'event_type' AS attribute, items
  FROM win JOIN items USING (user_id, window_number)
  WINDOW w AS (PARTITION BY user_id ORDER BY window_number)"""
ORACLES["interarrival"] = """
  SELECT row_number() OVER (ORDER BY ts, event_id) AS item_number,
         date_diff('microsecond', first(ts) OVER (ORDER BY ts, event_id), ts) / 1000 AS buffering_time_ms,
         coalesce(date_diff('microsecond', lag(ts) OVER (ORDER BY ts, event_id), ts) / 1000, 0) AS interarrival_ms
  FROM events"""
ORACLES["latency_report"] = f"""
  SELECT event_type, count(value) AS calls, round(avg(value), 6) AS mean_ms,
         round(quantile_cont(value, 0.9), 6) AS p90_ms, round({X + 1} * (1000 / avg(value)), 6) AS windows_per_second
  FROM events GROUP BY 1"""

# -- repair ----------------------------------------------------------------------------------------------------

SIZE = W + X
CHUNKED = f"""s AS ({EVENTS}),
  chunked AS (SELECT pos // {SIZE} AS chunk, pos % {SIZE} AS place, g, event_id FROM s),
  {bounds_cte('events', 'event_type', S)},
  tally AS (SELECT chunk, gidx, b.g, tgt0 AS tgt, lo0, hi0, count(*) FILTER (WHERE c.g = b.g) AS n
            FROM chunked c CROSS JOIN bnd b GROUP BY ALL)"""
# Strategies that need whole blocks: whole chunks, and the last rows of the stream as they are.
WHOLE = CHUNKED.replace("event_id FROM s)", f"event_id FROM s WHERE pos // {SIZE} < (SELECT count(*) // {SIZE} FROM s))")


def and_tail(name: str) -> str:
    return f"""
  UNION ALL SELECT pos // {SIZE}, '{name}', pos % {SIZE}, pos % {SIZE}, g, event_id FROM s
  WHERE pos // {SIZE} >= (SELECT count(*) // {SIZE} FROM s)"""


ORACLES["repair_keeps_rows"] = f"""
  WITH {CHUNKED}
  SELECT chunk, strategy, g AS category, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS event_ids, 0 AS out_of_order
  FROM chunked, (VALUES ('optimal'), ('naive'), ('naive_reversed'), ('internal_swap'), ('greedy_swap'),
                        ('weighted_greedy_swap')) AS names(strategy) GROUP BY ALL"""
ORACLES["chunk_pattern_bound"] = f"""
  WITH {CHUNKED},
  copies AS (SELECT chunk, min(CASE WHEN tgt > 0 THEN n // tgt END) AS m,
                    bool_and(size % {S} = 0 AND size * lo0 <= n * {S} AND n * {S} <= size * hi0) AS tileable
             FROM tally JOIN (SELECT chunk, sum(n) AS size FROM tally GROUP BY 1) USING (chunk) GROUP BY 1)
  SELECT chunk, any_value(tileable) AS tileable, any_value(m) AS pattern_copies,
         string_agg(CAST(n - tgt * m AS BIGINT), ',' ORDER BY gidx) AS remainders
  FROM tally JOIN copies USING (chunk) GROUP BY chunk"""
ORACLES["chunk_scores_before"] = f"""
  WITH {CHUNKED},
  cnt AS (
    SELECT chunk, place, lo, hi, c FROM (
      SELECT chunk, place, lo, hi, sum(CASE WHEN c.g = b.g THEN 1 ELSE 0 END) OVER
        (PARTITION BY chunk, b.g ORDER BY place ROWS BETWEEN {S - 1} PRECEDING AND CURRENT ROW) AS c
      FROM chunked c CROSS JOIN bnd b) WHERE place >= {S - 1}),
  blk AS (SELECT chunk, place, bool_and(c BETWEEN lo AND hi) AS fair FROM cnt GROUP BY 1, 2),
  win AS (
    SELECT chunk, place, fair_blocks, fair_blocks = {W // S} AS is_fair FROM (
      SELECT chunk, place, sum(CASE WHEN fair THEN 1 ELSE 0 END) OVER
        (PARTITION BY chunk, place % {S} ORDER BY place ROWS BETWEEN {W // S - 1} PRECEDING AND CURRENT ROW)
        AS fair_blocks FROM blk) WHERE place >= {W - 1})
  {summary("chunk", W // S).replace("SELECT chunk,", "SELECT chunk, 0 AS changed,")}"""
ORACLES["repair_naive_reversed"] = f"""
  WITH {WHOLE},
  copies AS (SELECT chunk, min(CASE WHEN tgt > 0 THEN n // tgt END) AS m FROM tally GROUP BY 1),
  rest AS (SELECT chunk, gidx, g, tgt, m, n - tgt * m AS rest, least(tgt, n - tgt * m) AS ep
           FROM tally JOIN copies USING (chunk)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY ep DESC, gidx) AS by_size,
                    sum(rest) OVER (PARTITION BY chunk) AS spare FROM rest),
  pieces AS (
    SELECT chunk, g, spare, 0 AS part, rep, 0 AS piece, by_size AS seq, ep AS n FROM ranked, range({SIZE}) r(rep)
      WHERE rep < m AND spare > 0
    UNION ALL SELECT chunk, g, spare, 0, rep, 1, by_size, tgt - ep FROM ranked, range({SIZE}) r(rep)
      WHERE rep < m AND spare > 0
    UNION ALL SELECT chunk, g, spare, 0, rep, 0, gidx, tgt FROM ranked, range({SIZE}) r(rep) WHERE rep < m AND spare = 0
    UNION ALL SELECT chunk, g, spare, 1, 0, 0, by_size, ep FROM ranked WHERE spare > 0
    UNION ALL SELECT chunk, g, spare, 2, 0, 0, gidx, rest - ep FROM ranked WHERE spare > 0),
  word AS (SELECT chunk, g, spare, row_number() OVER (PARTITION BY chunk ORDER BY part, rep, piece, seq, i) - 1 AS slot
           FROM pieces, range({SIZE}) u(i) WHERE i < n),
  placed AS (SELECT chunk, g, CASE WHEN spare > 0 THEN {SIZE - 1} - slot ELSE slot END AS place FROM word),
  seats AS (SELECT chunk, g, place, row_number() OVER (PARTITION BY chunk, g ORDER BY place) AS k FROM placed),
  items AS (SELECT chunk, g, place, event_id, row_number() OVER (PARTITION BY chunk, g ORDER BY place) AS k FROM chunked)
  SELECT chunk, 'naive_reversed' AS strategy, s.place AS position_in_chunk, i.place AS source_position,
         g AS category, event_id FROM items i JOIN seats s USING (chunk, g, k)""" + and_tail("naive_reversed")
# The naive strategy as a recursion: one pass over the ranked categories of the current leftover block per step.
KINDS = len(EVENT_TYPES)
ORACLES["repair_naive"] = f"""
  WITH RECURSIVE {WHOLE},
  copies AS (SELECT chunk, min(CASE WHEN tgt > 0 THEN n // tgt END) AS m FROM tally GROUP BY 1),
  -- state: what is left per category (gidx order), room in the current leftover block, whether it is its first pass
  start AS (SELECT chunk, list(CAST(n - tgt * m AS BIGINT) ORDER BY gidx) AS rest,
                   list(CAST(tgt AS BIGINT) ORDER BY gidx) AS tgts, any_value(m) AS m FROM tally JOIN copies USING (chunk) GROUP BY chunk),
  passes AS (
    SELECT chunk, m, tgts, rest, {S} AS room, true AS fresh, 0 AS pass, CAST([] AS BIGINT[]) AS placed FROM start
    UNION ALL
    SELECT chunk, m, tgts,
           list_transform(range(1, {KINDS + 1}), lambda c: rest[c] - coalesce(list_sum(
             list_transform(takes, lambda t: CASE WHEN t.c = c THEN t.n ELSE 0 END)), 0)),
           CASE WHEN room = used THEN {S} ELSE room - used END, room = used, pass + 1,
           flatten(list_transform(takes, lambda t: list_transform(range(t.n), lambda i: t.c - 1)))
    FROM (
      SELECT *, CAST(list_sum(list_transform(takes, lambda t: t.n)) AS BIGINT) AS used FROM (
        SELECT *, list_transform(range(1, len(wish) + 1), lambda k: {{'c': wish[k].c, 'n': greatest(0, least(
                    wish[k].n, room - coalesce(list_sum(list_transform(wish[1:k-1], lambda x: x.n)), 0)))::BIGINT}}) AS takes
        FROM (
          SELECT *, list_transform(list_sort(list_filter(list_transform(range(1, {KINDS + 1}),
                      lambda c: {{'rank': tgts[c] - rest[c], 'c': c}}), lambda x: rest[x.c] > 0)),
                      lambda x: {{'c': x.c, 'n': least(rest[x.c], CASE WHEN fresh OR tgts[x.c] > 0 THEN tgts[x.c]
                                                              ELSE {S} END)}}) AS wish
          FROM passes WHERE list_sum(rest) > 0)))
  ),
  leftovers AS (SELECT chunk, flatten(list(placed ORDER BY pass)) AS word FROM passes GROUP BY chunk),
  firsts AS (SELECT chunk, g AS gidx, min(i) AS seen FROM (
               SELECT chunk, unnest(word[1:{S}]) AS g, generate_subscripts(word[1:{S}], 1) AS i FROM leftovers) GROUP BY ALL),
  pattern AS (SELECT chunk, gidx, tgt, m, row_number() OVER (PARTITION BY chunk ORDER BY coalesce(seen, 1000), gidx) AS rank
              FROM tally JOIN copies USING (chunk) LEFT JOIN firsts USING (chunk, gidx)),
  word AS (
    SELECT chunk, gidx, row_number() OVER (PARTITION BY chunk ORDER BY rep, rank, i) - 1 AS place
    FROM pattern, range({SIZE}) r(rep), range({S}) u(i) WHERE rep < m AND i < tgt
    UNION ALL
    SELECT chunk, g, {S} * m + i - 1 FROM (
      SELECT chunk, unnest(word) AS g, generate_subscripts(word, 1) AS i FROM leftovers) JOIN copies USING (chunk)),
  seats AS (SELECT chunk, b.g, place, row_number() OVER (PARTITION BY chunk, gidx ORDER BY place) AS k
            FROM word JOIN bnd b USING (gidx)),
  items AS (SELECT chunk, g, place, event_id, row_number() OVER (PARTITION BY chunk, g ORDER BY place) AS k FROM chunked)
  SELECT chunk, 'naive' AS strategy, s.place AS position_in_chunk, i.place AS source_position,
         g AS category, event_id FROM items i JOIN seats s USING (chunk, g, k)""" + and_tail("naive")
# The swap heuristics as recursions over label lists: one category of one block per step, then one landmark label
# per step. Blocks are judged by the target as a minimum.


def held(block_start: str, category: str) -> str:
    return f"len(list_filter(word[{block_start} + 1:{block_start} + {S}], lambda x: x = {category}))"


def lacking(block: str) -> str:
    return f"list_filter(range(0, {KINDS}), lambda c: {held(f'({block}) * {S}', 'c')} < tgts[c + 1])"


INTERNAL = f"""
  words AS (SELECT chunk, list(gidx ORDER BY place) AS word FROM chunked JOIN bnd USING (g) GROUP BY chunk),
  goal AS (SELECT list(CAST(tgt0 AS BIGINT) ORDER BY gidx) AS tgts FROM bnd),
  inner_swaps AS (
    SELECT chunk, tgts, word, 0 AS here, CAST([] AS BIGINT[]) AS todo, CAST([] AS BIGINT[]) AS need, false AS in_pass,
           0 AS moved, false AS done, 0 AS step FROM words, goal
    UNION ALL
    SELECT chunk, tgts, CASE WHEN at_edge THEN word ELSE list_transform(range(1, {SIZE} + 1), lambda p:
             CASE WHEN list_contains(takers[1:pairs], p) THEN todo[1]
                  WHEN list_contains(givers[1:pairs], p) THEN word[takers[list_position(givers[1:pairs], p)]]
                  ELSE word[p] END) END,
           CASE WHEN at_edge AND len(short) = 0 THEN here + 1 ELSE here END,
           CASE WHEN at_edge THEN short ELSE todo[2:] END,
           CASE WHEN at_edge THEN list_transform(short, lambda c: tgts[c + 1] - {held(f'here * {S}', 'c')}) ELSE need[2:] END,
           CASE WHEN at_edge THEN len(short) > 0 ELSE in_pass END, CASE WHEN at_edge THEN 0 ELSE moved + pairs END,
           at_edge AND (here >= {W // S - 1} OR (in_pass AND moved = 0)), step + 1
    FROM (
      SELECT *, CASE WHEN at_edge OR donor IS NULL THEN 0 ELSE least(need[1], len(takers), len(givers)) END AS pairs
      FROM (
        SELECT *, list_filter(range(here * {S} + 1, (here + 1) * {S} + 1), lambda p: word[p] <> todo[1]) AS takers,
               list_reverse(list_filter(range(donor * {S} + 1, (donor + 1) * {S} + 1), lambda p: word[p] = todo[1])) AS givers
        FROM (
          SELECT *, len(todo) = 0 AS at_edge, {lacking('here')} AS short,
                 list_filter(range(here + 1, {W // S}), lambda j: len({lacking('j')}) = 0)[1] AS donor
          FROM inner_swaps WHERE NOT done)))
  ),
  swapped AS (SELECT chunk, any_value(tgts) AS tgts, arg_max(word, step) AS word FROM inner_swaps GROUP BY chunk)"""


def greedy(weight: str) -> str:
    return f"""
  landmark_swaps AS (
    SELECT chunk, tgts, word, false AS done, 0 AS step FROM swapped
    UNION ALL
    SELECT chunk, tgts, CASE WHEN cat IS NULL THEN word ELSE list_transform(range(1, {SIZE} + 1), lambda p:
             CASE WHEN p = best + 1 THEN cat WHEN p = giver THEN word[best + 1] ELSE word[p] END) END,
           cat IS NULL, step + 1
    FROM (
      SELECT *, slots[list_position(scores, list_max(scores))] AS best FROM (
        SELECT *, list_max(list_filter(range({W} + 1, {SIZE} + 1), lambda p: word[p] = cat)) AS giver,
               list_transform(slots, lambda p: list_sum(list_transform(range(0, {X} + 1), lambda o:
                 CASE WHEN o + greatest(0, (p - o) // {S}) * {S} > {W - S} THEN 0
                      ELSE ({weight}) * missing[o + greatest(0, (p - o) // {S}) * {S} + 1] END))) AS scores
        FROM (
          SELECT *, list_filter(range(here * {S}, (here + 1) * {S}), lambda p: word[p + 1] <> cat) AS slots,
                 list_transform(range(0, {W - S} + 1), lambda b: greatest(0, tgts[cat + 1] - {held('b', 'cat')})) AS missing
          FROM (
            SELECT *, list_filter({lacking('here')}, lambda c: list_contains(word[{W} + 1:], c))[1] AS cat FROM (
              SELECT *, list_filter(range(0, {W // S}), lambda j: len({lacking('j')}) > 0)[1] AS here
              FROM landmark_swaps WHERE NOT done AND step <= {X})))))
  ),
  final AS (SELECT chunk, arg_max(word, step) AS word FROM landmark_swaps GROUP BY chunk)"""


def seated(name: str, source: str) -> str:
    """Rows of the chunks attached to the words in ``source``."""
    return f"""
  seats AS (SELECT chunk, b.g, i - 1 AS place, row_number() OVER (PARTITION BY chunk, gidx ORDER BY i) AS k
            FROM (SELECT chunk, unnest(word) AS gidx, generate_subscripts(word, 1) AS i FROM {source}) JOIN bnd b USING (gidx)),
  items AS (SELECT chunk, g, place, event_id, row_number() OVER (PARTITION BY chunk, g ORDER BY place) AS k FROM chunked)
  SELECT chunk, '{name}' AS strategy, s.place AS position_in_chunk, i.place AS source_position,
         g AS category, event_id FROM items i JOIN seats s USING (chunk, g, k){and_tail(name)}"""


ORACLES["repair_internal_swap"] = f"WITH RECURSIVE {WHOLE}, {INTERNAL}, {seated('internal_swap', 'swapped')}"
ORACLES["repair_greedy_swap"] = (
    f"WITH RECURSIVE {WHOLE}, {INTERNAL}, {greedy('1')}, {seated('greedy_swap', 'final')}")
ORACLES["repair_weighted_greedy_swap"] = (
    f"WITH RECURSIVE {WHOLE}, {INTERNAL}, {greedy(f'{X} - o')}, {seated('weighted_greedy_swap', 'final')}")

# Longest fair region by brute force: q whole blocks, every split of the q*R extras over the categories, and the
# tail that the left-over items then allow.
GROUPS = range(len(EVENT_TYPES))
REGION = f"""
  wide AS (SELECT chunk, {", ".join(f"max(CASE WHEN gidx = {i} THEN {v} END) AS {v}{i}" for i in GROUPS
                                    for v in ("n", "lo0", "hi0"))} FROM tally GROUP BY chunk),
  split AS (
    SELECT chunk, q, {S} - ({" + ".join(f"lo0{i}" for i in GROUPS)}) AS r_extra,
           {", ".join(f"n{i} - q * lo0{i} - e{i} AS z{i}, e{i}, lo0{i} AS f{i}, hi0{i} - lo0{i} AS loose{i}" for i in GROUPS)}
    FROM wide, range(1, {SIZE // S + 1}) AS whole(q), {", ".join(f"range({SIZE // S + 1}) AS x{i}(e{i})" for i in GROUPS)}),
  possible AS (
    SELECT chunk, q * {S} + least({S - 1}, {" + ".join(f"least(f{i}, z{i})" for i in GROUPS)} + least(r_extra,
           {" + ".join(f"(loose{i} = 1 AND z{i} > f{i})::INT" for i in GROUPS)})) AS len
    FROM split WHERE {" AND ".join(f"z{i} >= 0 AND e{i} <= q * loose{i}" for i in GROUPS)}
      AND {" + ".join(f"e{i}" for i in GROUPS)} = q * r_extra),
  longest AS (SELECT w.chunk, CAST(least({SIZE}, coalesce(max(len), 0)) AS INTEGER) AS longest_fair
              FROM wide w LEFT JOIN possible p USING (chunk) GROUP BY 1)"""
ORACLES["chunk_potential"] = f"""
  WITH {CHUNKED}, {REGION}
  SELECT chunk, longest_fair, greatest(0, longest_fair - {S - 1}) AS attainable_blocks FROM longest"""
ORACLES["repair_optimal_fair_blocks"] = f"""
  WITH {CHUNKED}, {REGION}
  SELECT chunk, CAST(size - {S - 1} AS BIGINT) AS sliding_blocks, greatest(0, longest_fair - {S - 1}) AS fair_blocks
  FROM longest JOIN (SELECT chunk, sum(n) AS size FROM tally GROUP BY 1) USING (chunk) WHERE size >= {S}"""
# The windowed repair as a recursion over every user's rows: one step per fair window or repaired chunk.
USER_SIZE = USER_W + USER_X


def repeated(times: str, value: str) -> str:
    return f"list_transform(range(greatest(0, {times})), lambda i: {value})"


def reversed_run(source: str, window: int, block: int, landmark: int, limit: int | None = None) -> str:
    """Repair by the reversed pattern; a run ends once it covered ``limit`` windows. ``user_id`` is its key."""
    size, bounded = window + landmark, "" if limit is None else f" AND st < {limit}"
    return f"""s AS ({source}),
  {bounds_cte('events', 'event_type', block)},
  limits AS (SELECT list(CAST(tgt0 AS BIGINT) ORDER BY gidx) AS tgts, list(CAST(lo0 AS BIGINT) ORDER BY gidx) AS lows,
                    list(CAST(hi0 AS BIGINT) ORDER BY gidx) AS highs FROM bnd),
  run AS (
    SELECT user_id, list(event_id ORDER BY pos) AS ids, list(CAST(gidx AS BIGINT) ORDER BY pos) AS word, 0 AS st, 0 AS edits, 0 AS step,
           'start' AS kind, CAST([] AS BIGINT[]) AS chunk_ids, CAST([] AS BIGINT[]) AS chunk, CAST([] AS BIGINT[]) AS places
    FROM s JOIN bnd USING (g) GROUP BY user_id
    UNION ALL
    SELECT user_id, CASE WHEN act = 'edit' THEN ids[1:st] || list_transform(ord, lambda q: old_ids[q]) || ids[st + {size} + 1:] ELSE ids END,
           CASE WHEN act = 'edit' THEN word[1:st] || tmpl || word[st + {size} + 1:] ELSE word END,
           st + CASE act WHEN 'fair' THEN 1 WHEN 'edit' THEN {landmark + 1} ELSE 0 END, edits + (act = 'edit')::INT, step + 1, act,
           old_ids, old, ord
    FROM (
      SELECT *, list_transform(range(1, {size} + 1), lambda p: list_filter(range(1, {size} + 1), lambda i: old[i] = tmpl[p])[
                  len(list_filter(tmpl[1:p], lambda x: x = tmpl[p]))]) AS ord
      FROM (
        SELECT *, CASE WHEN act <> 'edit' THEN CAST([] AS BIGINT[]) WHEN list_sum(rest) = 0
            THEN flatten({repeated('copies', f"flatten(list_transform(range(0, {KINDS}), lambda c: {repeated('tgts[c + 1]', 'c')}))")})
            ELSE list_reverse(flatten({repeated('copies', 'prefix || missing')}) || prefix
                 || flatten(list_transform(range(0, {KINDS}), lambda c: {repeated('rest[c + 1] - least(tgts[c + 1], rest[c + 1])', 'c')}))) END AS tmpl
        FROM (
          SELECT *, flatten(list_transform(by_size, lambda x: {repeated('least(tgts[x.c + 1], rest[x.c + 1])', 'x.c')})) AS prefix,
                 flatten(list_transform(by_size, lambda x: {repeated('tgts[x.c + 1] - least(tgts[x.c + 1], rest[x.c + 1])', 'x.c')})) AS missing
          FROM (
            SELECT *, list_sort(list_transform(range(0, {KINDS}), lambda c: {{'k': -least(tgts[c + 1], rest[c + 1]), 'c': c}})) AS by_size
            FROM (
              SELECT *, list_transform(range(1, {KINDS} + 1), lambda c: held[c] - copies * tgts[c]) AS rest
              FROM (
                SELECT *, list_min(list_transform(list_filter(range(1, {KINDS} + 1), lambda c: tgts[c] > 0), lambda c: held[c] // tgts[c])) AS copies
                FROM (
                  SELECT *, list_transform(range(0, {KINDS}), lambda c: len(list_filter(old, lambda x: x = c))) AS held
                  FROM (
                    SELECT run.*, limits.*, word[st + 1:st + {size}] AS old, ids[st + 1:st + {size}] AS old_ids,
                           CASE WHEN len(list_filter(range(0, {window // block * KINDS}), lambda k:
                                  len(list_filter(word[st + k // {KINDS} * {block} + 1:st + (k // {KINDS} + 1) * {block}], lambda x: x = k % {KINDS}))
                                  NOT BETWEEN lows[k % {KINDS} + 1] AND highs[k % {KINDS} + 1])) = 0 THEN 'fair'
                                WHEN st + {size} <= len(word) THEN 'edit' ELSE 'stop' END AS act
                    FROM run, limits WHERE kind <> 'stop' AND st + {window} <= len(word){bounded}))))))))
  ),
  ends AS (SELECT user_id, arg_max(ids, step) AS ids, arg_max(word, step) AS word FROM run GROUP BY user_id)"""


USER_RUN = reversed_run(USERS, USER_W, USER_S, USER_X)
ORACLES["repair_stateful_reversed"] = f"""
  WITH RECURSIVE {USER_RUN}
  SELECT user_id, CAST(0 AS BIGINT) AS episode, CAST(i - 1 AS BIGINT) AS out_pos, g AS category, event_id FROM (
    SELECT user_id, unnest(ids) AS event_id, unnest(word) AS gidx, generate_subscripts(ids, 1) AS i FROM ends) JOIN bnd USING (gidx)"""
ONE_RUN = reversed_run(positioned("events", "event_type", EVENT_ORDER, extra="event_id, 0 AS user_id"), USER_W, USER_S, USER_X)
ORACLES["repair_one_stream"] = f"""
  WITH RECURSIVE {ONE_RUN}
  SELECT CAST(0 AS BIGINT) AS episode, CAST(i - 1 AS BIGINT) AS out_pos, g AS category, event_id FROM (
    SELECT unnest(ids) AS event_id, unnest(word) AS gidx, generate_subscripts(ids, 1) AS i FROM ends) JOIN bnd USING (gidx)"""
ORACLES["stream_repair_closed"] = f"SELECT user_id, out_pos, category, event_id FROM ({ORACLES['repair_stateful_reversed']})"
ORACLES["repair_captures_reversed"] = f"""
  WITH RECURSIVE {USER_RUN},
  places AS (
    SELECT user_id, edits - 1 AS edit_event, i, chunk_ids[i] AS old_id, chunk[i] AS old_g, chunk_ids[places[i]] AS new_id, chunk[places[i]] AS new_g
    FROM run, range(1, {USER_SIZE} + 1) AS r(i) WHERE kind = 'edit')
  SELECT user_id, CAST(0 AS BIGINT) AS episode, phase, CAST(edit_event AS BIGINT) AS edit_event, CAST(i - 1 AS INTEGER) AS position_in_chunk,
         g AS category, event_id FROM (
    SELECT user_id, 'original' AS phase, edit_event, i, old_g AS gidx, old_id AS event_id FROM places
    UNION ALL SELECT user_id, 'reordered', edit_event, i, new_g, new_id FROM places) JOIN bnd USING (gidx)"""


def reversed_report(run: str, window: int, block: int, landmark: int, key: str = "") -> str:
    """Run report before and after that repair, per ``key`` or over all runs."""
    size, blocks, by = window + landmark, window // block, f"{key}, " if key else ""
    return f"""
  WITH RECURSIVE {run},
  sides AS (
    SELECT user_id, edits, 'before' AS strategy, chunk AS w, 0 AS moved FROM run WHERE kind = 'edit'
    UNION ALL
    SELECT user_id, edits, 'naive_reversed', list_transform(places, lambda q: chunk[q]),
           len(list_filter(range(1, {size} + 1), lambda p: chunk[p] <> chunk[places[p]])) FROM run WHERE kind = 'edit'),
  blocks AS (
    SELECT user_id, edits, strategy, moved, v, sum(fair::INT) AS fair FROM (
      SELECT user_id, edits, strategy, moved, v, len(list_filter(range(1, {KINDS} + 1), lambda c:
               len(list_filter(w[v + b * {block} + 1:v + (b + 1) * {block}], lambda x: x = c - 1)) NOT BETWEEN lows[c] AND highs[c])) = 0 AS fair
      FROM sides, limits, range(0, {landmark} + 1) AS wins(v), range(0, {blocks}) AS parts(b)) GROUP BY ALL),
  chunks AS (SELECT user_id, edits, strategy, any_value(moved) AS moved, sum(fair) AS fair_blocks, sum((fair = {blocks})::INT) AS fair_windows,
                    count(*) AS windows FROM blocks GROUP BY ALL),
  whole AS (SELECT {by}strategy, sum(moved) AS moved, sum(fair_blocks) AS fb, sum(fair_windows) AS fw, sum(windows) AS wn FROM chunks GROUP BY ALL),
  checks AS (SELECT {by}count(*) FILTER (WHERE kind = 'edit') AS edits, count(*) FILTER (WHERE kind = 'fair') AS fair_checks FROM run GROUP BY ALL)
  SELECT {by}strategy, edits, fair_checks, CAST(moved AS BIGINT) AS total_swaps,
         CAST((fair_checks + edits) * {blocks} + edits * {blocks * (landmark + 1)} AS BIGINT) AS compat_total_blocks,
         CAST(fb + CASE WHEN strategy = 'before' THEN fair_checks * {blocks} ELSE 0 END AS BIGINT) AS compat_fair_blocks,
         CAST(wn + CASE WHEN strategy = 'before' THEN fair_checks ELSE 0 END AS BIGINT) AS compat_windows,
         CAST(fw + CASE WHEN strategy = 'before' THEN fair_checks ELSE 0 END AS BIGINT) AS compat_fair_windows,
         CAST((wn + fair_checks) * {blocks} AS BIGINT) AS total_blocks, CAST(fb + fair_checks * {blocks} AS BIGINT) AS fair_blocks,
         CAST(fw + fair_checks AS BIGINT) AS fair_windows
  FROM whole {'JOIN checks USING (' + key + ')' if key else ', checks'}"""


ORACLES["strategy_compare_reversed"] = reversed_report(USER_RUN, USER_W, USER_S, USER_X)
ORACLES["repair_stateful_delivery"] = """
  SELECT user_id, event_type AS category, count(*) AS n, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS event_ids
  FROM events GROUP BY 1, 2"""

# -- ranking quality -------------------------------------------------------------------------------------------

CAPTURES = f"""
  base AS (SELECT pos // {SIZE} AS chunk, pos % {SIZE} AS place, md5('1:' || event_id) AS seed, event_id,
                  CASE WHEN value < 20 THEN 0.0 ELSE value END AS rel
           FROM ({positioned("events", "event_type", EVENT_ORDER, extra="event_id, value")})),
  cap AS (SELECT 'original' AS phase, chunk, place, rel FROM base
          UNION ALL SELECT 'reordered', chunk, row_number() OVER (PARTITION BY chunk ORDER BY seed) - 1, rel FROM base)"""


def ndcg_cte(keys: str, place: str, source: str = "cap") -> str:
    """``gains``: own and ideal rank with relevance, per group."""
    return f"""(SELECT {keys}, rel, {place} + 1 AS rank,
      row_number() OVER (PARTITION BY {keys} ORDER BY rel DESC NULLS LAST) AS ideal FROM {source})"""


def ndcg_value(k: str) -> str:
    if k == "0":
        return "sum(rel / log2(rank + 1)) / nullif(sum(rel / log2(ideal + 1)), 0)"
    return (f"sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1) END) / "
            f"nullif(sum(CASE WHEN ideal <= {k} THEN rel / log2(ideal + 1) END), 0)")


def ndcg_window_rows(ks: list[int]) -> str:
    return " UNION ALL ".join(
        f"SELECT phase, chunk, {k} AS k, {ndcg_value(str(k))} AS ndcg FROM "
        f"{ndcg_cte('phase, chunk', 'place')} GROUP BY phase, chunk" for k in ks)


BLOCK_ROWS = (f"SELECT phase, chunk, block_index, {ndcg_value('0')} AS ndcg FROM "
              + ndcg_cte("phase, chunk, block_index", "in_block",
                         f"(SELECT *, place // {S} AS block_index, place % {S} AS in_block FROM cap)")
              + " GROUP BY phase, chunk, block_index")
ORACLES["ndcg_window"] = f"""
  WITH {CAPTURES} SELECT phase, chunk, k, round(ndcg, 9) AS ndcg FROM ({ndcg_window_rows([S, 50, 0])})"""
ORACLES["ndcg_block"] = f"WITH {CAPTURES} SELECT phase, chunk, block_index, round(ndcg, 9) AS ndcg FROM ({BLOCK_ROWS})"


def t_test(by: str, pairs: str) -> str:
    """Paired t with its p-value from the finite series of Student's distribution for whole degrees of freedom."""
    return f"""
      SELECT {by}, n, mean_diff, t_stat,
             CASE WHEN t_stat IS NULL THEN 'NaN'::DOUBLE
             WHEN nu % 2 = 1 THEN 1 - 2 / pi() * (theta + CASE WHEN nu = 1 THEN 0 ELSE sin(theta) * list_sum(list_transform(
                 range(1, (nu - 1) // 2 + 1), lambda k: cos(theta) ** (2 * k - 1) * coalesce(list_product(
                 list_transform(range(1, k), lambda j: 2 * j / (2 * j + 1))), 1))) END)
             ELSE 1 - sin(theta) * list_sum(list_transform(range(0, nu // 2), lambda k: cos(theta) ** (2 * k)
                 * coalesce(list_product(list_transform(range(1, k + 1), lambda j: (2 * j - 1) / (2 * j))), 1))) END AS t_p
      FROM (SELECT *, n - 1 AS nu, atan(abs(t_stat) / sqrt(n - 1)) AS theta FROM (
        SELECT {by}, count(*) AS n, avg(b - a) AS mean_diff,
               avg(b - a) / (nullif(stddev_samp(b - a), 0) / sqrt(count(*))) AS t_stat
        FROM {pairs} GROUP BY ALL))"""


def signed_ranks(by: str, pairs: str) -> str:
    return f"""
      SELECT {by}, count(*) AS n_nonzero, sum(CASE WHEN d > 0 THEN rank ELSE 0 END) AS w_plus,
             sum(ties * ties - 1) AS ties
      FROM (SELECT {by}, d, count(*) OVER (PARTITION BY {by}, abs(d)) AS ties,
                   rank() OVER (PARTITION BY {by} ORDER BY abs(d))
                   + (count(*) OVER (PARTITION BY {by}, abs(d)) - 1) / 2 AS rank
            FROM (SELECT {by}, b - a AS d FROM {pairs}) WHERE d <> 0) GROUP BY ALL"""


WILCOXON_Z = """(w_plus - n_nonzero * (n_nonzero + 1) / 4)
  / nullif(sqrt(n_nonzero * (n_nonzero + 1) * (2 * n_nonzero + 1) / 24 - ties / 48), 0)"""
ORACLES["ndcg_summary"] = f"""
  WITH {CAPTURES},
  scored AS (SELECT CASE k WHEN {S} THEN 'block_size' ELSE CAST(k AS VARCHAR) END AS cutoff, k, phase, chunk, 0 AS part,
                    ndcg FROM ({ndcg_window_rows([S, 50])})
             UNION ALL SELECT 'per_block', {S}, phase, chunk, block_index, ndcg FROM ({BLOCK_ROWS})),
  pairs AS (SELECT cutoff, k, chunk, part, max(CASE WHEN phase = 'original' THEN ndcg END) AS a,
                   max(CASE WHEN phase = 'reordered' THEN ndcg END) AS b
            FROM scored GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL),
  basic AS (SELECT cutoff, k, avg(a) AS am, median(a) AS amed, stddev_samp(a) AS asd, avg(b) AS bm, median(b) AS bmed,
                   stddev_samp(b) AS bsd FROM pairs GROUP BY ALL),
  t AS ({t_test('cutoff, k', 'pairs')}), w AS ({signed_ranks('cutoff, k', 'pairs')})
  SELECT cutoff, k, n, round(am, 6) AS orig_mean, round(amed, 6) AS orig_median, round(asd, 6) AS orig_std,
         round(bm, 6) AS reord_mean, round(bmed, 6) AS reord_median, round(bsd, 6) AS reord_std,
         round(bm - am, 6) AS mean_diff, round((bm - am) * 100 / am, 6) AS pct_change, round(t_stat, 6) AS t_stat,
         round(t_p, 6) AS t_p, round({WILCOXON_Z}, 6) AS wilcoxon_z
  FROM basic JOIN t USING (cutoff, k) JOIN w USING (cutoff, k)"""

# -- runs, statistics, grids -----------------------------------------------------------------------------------


def shuffled(runs: int, extra: str = "") -> str:
    return f"""SELECT run_id, {extra and extra + ", "}event_type AS g, row_number() OVER
      (PARTITION BY run_id ORDER BY md5(run_id || ':' || event_id), event_id) - 1 AS pos
      FROM events, range(1, {runs + 1}) AS runs(run_id)"""


def run_windows(runs: int, window: int, block: int, mode: str = "two_sided") -> str:
    return monitored(shuffled(runs), "events", "event_type", window, block, "run_id", mode)


ORACLES["seeded_shuffle_monitor"] = run_windows(3, W, S) + summary("run_id", W // S)
RUNS = " UNION ALL ".join(
    f"SELECT '{mode}' AS strategy, * FROM ({run_windows(10, USER_W, USER_S, mode)} {summary('run_id', USER_W // USER_S)})"
    for mode in ("two_sided", "floor_only", "target_floor"))
LONG = f"""wide AS ({RUNS}),
  long AS (SELECT run_id, strategy, 'fair_blocks' AS metric, CAST(fair_blocks AS DOUBLE) AS value FROM wide
           UNION ALL SELECT run_id, strategy, 'fair_windows', CAST(fair_windows AS DOUBLE) FROM wide)"""
ORACLES["describe_runs"] = f"""
  WITH {LONG},
  freq AS (SELECT strategy, metric, value, count(*) AS times FROM long GROUP BY ALL),
  top AS (SELECT strategy, metric, max(times) AS most, count(*) AS kinds FROM freq GROUP BY ALL)
  SELECT strategy, metric, n, med AS median, mode, modes > 1 AND kinds <> n AS several_modes, mean, std FROM
    (SELECT strategy, metric, count(*) AS n, median(value) AS med, round(avg(value), 6) AS mean,
            round(stddev_samp(value), 6) AS std FROM long GROUP BY ALL)
    JOIN (SELECT strategy, metric, kinds, min(value) AS mode, count(*) AS modes
          FROM freq JOIN top USING (strategy, metric) WHERE times = most GROUP BY ALL) USING (strategy, metric)"""
ORACLES["significance"] = f"""
  WITH {LONG},
  pairs AS (SELECT o.strategy, metric, run_id, o.value AS a, p.value AS b FROM long o JOIN long p USING (run_id, metric)
            WHERE o.strategy <> 'two_sided' AND p.strategy = 'two_sided'),
  t AS ({t_test('strategy, metric', 'pairs')}), w AS ({signed_ranks('strategy, metric', 'pairs')}),
  m AS (SELECT strategy, metric, avg(a) AS base_mean, avg(b) AS primary_mean FROM pairs GROUP BY ALL)
  SELECT strategy, metric, n, n_nonzero, coalesce(t_p < 0.05, false) AS significant, round(base_mean, 6) AS base_mean,
         round(primary_mean, 6) AS primary_mean, round(mean_diff, 6) AS mean_diff, round(t_stat, 6) AS t_stat,
         round(t_p, 6) AS t_p, round(w_plus, 6) AS w_plus, round({WILCOXON_Z}, 6) AS wilcoxon_z
  FROM m JOIN t USING (strategy, metric) JOIN w USING (strategy, metric)"""
PAIRS = f"""
  narrow AS ({run_windows(10, USER_W, USER_S)} {summary('run_id', USER_W // USER_S)}),
  broad AS ({run_windows(10, 2 * USER_W, USER_S)} {summary('run_id', 2 * USER_W // USER_S)}),
  pairs AS (SELECT 'pct_fair' AS metric, n.pct_fair AS a, b.pct_fair AS b FROM narrow n JOIN broad b USING (run_id))"""
ORACLES["paired_t"] = f"""
  WITH {PAIRS} SELECT metric, n, round(mean_diff, 6) AS mean_diff, round(t_stat, 6) AS t_stat, round(t_p, 6) AS t_p
  FROM ({t_test('metric', 'pairs')})"""
ORACLES["wilcoxon_exact"] = f"""
  WITH {PAIRS}, w AS ({signed_ranks('metric', 'pairs')}),
  signs AS (SELECT list_sum(list_transform(range(1, n_nonzero + 1), lambda r: r * ((mask >> (r - 1)) & 1))) AS rank_sum,
                   w_plus FROM w, range(1024) AS masks(mask))
  SELECT metric, n_nonzero, w_plus,
         round((SELECT least(1.0, 2 * least(count(*) FILTER (WHERE rank_sum <= w_plus), count(*) FILTER (WHERE rank_sum >= w_plus)) / 1024)
                FROM signs), 9) AS wilcoxon_p FROM w"""
GRID_ROWS = " UNION ALL ".join(
    f'SELECT {w} AS "window", {s} AS block, {x} AS landmark, * FROM ({run_windows(2, w, s)} {summary("run_id", w // s)})'
    for w, s, x in GRID)
ORACLES["grid_monitor"] = GRID_ROWS
ORACLES["grid_repair_reversed"] = " UNION ALL ".join(
    f"""SELECT {w} AS "window", {s} AS block, {x} AS landmark, user_id AS run_id, * EXCLUDE (user_id) FROM ({reversed_report(reversed_run(
        f"SELECT run_id AS user_id, event_id, g, pos FROM ({shuffled(2, 'event_id')}) WHERE pos < {SLOW_WINDOWS + w + x}",
        w, s, x, SLOW_WINDOWS), w, s, x, "user_id")})"""
    for w, s, x in GRID)
POINTS = ", ".join(
    f"('{name}', {w}, {s}, {x})" for name, axis in SWEEPS.items()
    for w in axis["window"] for s in axis["block"] for x in axis["landmark"])
CONFIGS = f"""
  points(sweep, "window", block, landmark) AS (VALUES {POINTS}),
  configs AS (SELECT "window", block, landmark, string_agg(sweep, ',' ORDER BY sweep) AS sweeps FROM points
              WHERE "window" % block = 0 AND landmark <= "window" AND ("window" + landmark) % block = 0
              GROUP BY ALL)"""
ORACLES["grid_missing"] = f"""
  WITH {CONFIGS}, done AS ({GRID_ROWS})
  SELECT * FROM configs ANTI JOIN done USING ("window", block, landmark)
  WHERE block >= (SELECT count(DISTINCT event_type) FROM events)"""
ORACLES["config_averages"] = f"""
  WITH {CONFIGS}, done AS ({GRID_ROWS})
  SELECT "window", block, landmark, avg(windows) AS windows, avg(fair_blocks) AS fair_blocks,
         avg(fair_windows) AS fair_windows, any_value(sweeps) AS sweeps,
         'W' || "window" || '_s' || block || '_X' || landmark || '_monitor' AS config, block AS parsed_block
  FROM done LEFT JOIN configs USING ("window", block, landmark) GROUP BY ALL"""
ORACLES["sweep_summary"] = f"""
  WITH {CONFIGS}, done AS ({GRID_ROWS})
  SELECT "window" AS sweep_value, avg(fair_blocks) AS mean, round(stddev_samp(fair_blocks), 6) AS std
  FROM done SEMI JOIN (SELECT * FROM points WHERE sweep = 'W') p USING ("window", block, landmark) GROUP BY 1"""
