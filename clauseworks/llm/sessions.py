"""Sessions of events by gaps, final events and a greatest length, by triage.

*Hard* breaks (a final event before, or a gap) depend on two neighbours alone, so SQL windows find them, and with them
*islands* without a hard break inside. Nearly all islands span no more than ``longest`` and are sessions as they are.
Only overlong islands must be cut greedily (a session's first event decides where the next begins, and so on): these
go through grouped Arrow functions. Both kinds are then summarised by one aggregation.

No step takes a client whole. The windows take a client's *slice* of time (as long as a gap); what a slice must know of
those before it comes from a summary of one row a slice. A row of the summary holds a slice's last event, its last hard
break, and so on; only these rows are put in order by client, and a client has at most one for each slice of the
calendar, however many events it has. An overlong island is cut in *chunks* of time, in three steps: each
chunk by itself works out, for any session that may be running when it begins, which one runs when it ends (a step
function with at most as many steps as the client has events in ``longest`` and a gap); functions of ``FAN`` successive
chunks are composed, and so on, until one group walks from the island's first event; the sessions that run at the
beginning go back down to the chunks, which then place their events. So a group is bounded by what a client does in a
chunk or a few chunks' first hours, and the rounds grow with the logarithm of an island's length.

Defined cases: events without id, client or time take no part; of several rows with one id the least by client and
time counts; an event that does not say when it arrived is timely; a value that is null, infinite or no number adds
nothing and ends no session; an event without kind ends none; late events before a client's first session belong to
none; events at one time are ordered by id; an empty table gives no rows; only the columns named are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseworks.llm.common import drop_written, written

MINUTE = 60_000_000
#: Length of a chunk of an overlong island, and chunks whose functions are composed in one group.
CHUNK = 360 * MINUTE
FAN = 64


@dataclass(frozen=True)
class Rules:
    """When a session ends; times in microseconds."""

    gap: int = 15 * MINUTE
    longest: int = 60 * MINUTE
    lateness: int = 15 * MINUTE
    final_kinds: tuple[str, ...] = ("purchase", "signup")
    final_value: float = 60.0
    chunk: int = CHUNK
    fan: int = FAN


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time with or without a zone, the latter read as UTC whatever the session's zone."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(name))
    return F.unix_micros(F.col(name).cast("timestamp"))


def cleaned(clicks: DataFrame, rules: Rules) -> DataFrame:
    """(client, slice, ts, id, late, final, cents), a row for each event that takes part."""
    ts, arrived = micros(clicks, "ts"), micros(clicks, "arrived_at")
    finite = F.when(F.abs(F.col("value")) < F.lit(float("inf")), F.col("value"))
    final = F.coalesce((finite >= rules.final_value) & F.col("kind").isin(*rules.final_kinds), F.lit(False))
    rows = clicks.where(F.col("click_id").isNotNull() & F.col("client_id").isNotNull() & F.col("ts").isNotNull()).select(
        F.col("click_id").alias("id"), F.col("client_id").alias("client"), ts.alias("ts"),
        F.coalesce(arrived - ts > rules.lateness, F.lit(False)).alias("late"), final.alias("final"),
        F.coalesce(F.floor(finite * 100 + 0.5), F.lit(0)).cast("long").alias("cents"),
    )
    once = rows.groupBy("id").agg(F.min(F.struct("client", "ts", "late", "final", "cents")).alias("r")).select("id", "r.*")
    return once.withColumn("slice", F.floor(F.col("ts") / F.lit(min(rules.gap, rules.longest))).cast("long"))


def hard_breaks(rows: DataFrame, rules: Rules) -> DataFrame:
    """Adds the last hard break in the slice up to a row (s_ts, s_id), and ``at_end``: no timely event of the client follows."""
    by_time = Window.partitionBy("client").orderBy("slice")
    lasts = rows.where("not late").groupBy("client", "slice").agg(F.max(F.struct("ts", "id", "final")).alias("last"))
    lasts = lasts.select("client", "slice", "last", F.lag("last").over(by_time).alias("prev"), F.lead("slice").over(by_time).isNull().alias("no_more"))
    inside = Window.partitionBy("client", "slice").orderBy("ts", "late", "id")
    so_far, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    timely = F.when(~F.col("late"), F.struct("ts", "final"))
    out = rows.join(lasts, ["client", "slice"], "left")
    out = out.withColumn("p", F.coalesce(F.last(timely, ignorenulls=True).over(before), F.struct(F.col("prev.ts"), F.col("prev.final"))))
    hard = ~F.col("late") & (F.col("p.ts").isNull() | F.col("p.final") | (F.col("ts") - F.col("p.ts") >= rules.gap))
    out = out.withColumn("s", F.last(F.when(hard, F.struct("ts", "id")), ignorenulls=True).over(so_far))
    at_end = ~F.col("late") & F.col("no_more") & (F.col("last.ts") == F.col("ts")) & (F.col("last.id") == F.col("id"))
    return out.select("client", "slice", "ts", "id", "late", "final", "cents", at_end.alias("at_end"), F.col("s.ts").alias("s_ts"), F.col("s.id").alias("s_id"))


def islands(rows: DataFrame, rules: Rules) -> DataFrame:
    """Adds a row's island (i_ts, i_id: its first event) and ``long``: it spans more than ``longest``."""
    by_time = Window.partitionBy("client").orderBy("slice")
    begun = F.struct("s_ts", "s_id")
    on = rows.groupBy("client", "slice").agg(
        F.max(F.when(F.col("s_ts").isNotNull(), begun)).alias("begun"),
        F.max(F.when(F.col("s_ts").isNull() & ~F.col("late"), F.col("ts"))).alias("goes_on"),
    )
    on = on.withColumn("carry", F.last("begun", ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, -1)))
    over = F.coalesce(F.col("goes_on") - F.col("carry.s_ts") > rules.longest, F.lit(False))
    on = on.withColumn("carry_long", F.max(over).over(Window.partitionBy("client", "carry")))
    on = on.withColumn("begun_long", F.coalesce(F.lead("carry_long").over(by_time), F.lit(False)))
    out = rows.join(on, ["client", "slice"])
    last_here = (F.col("s_ts") == F.col("begun.s_ts")) & (F.col("s_id") == F.col("begun.s_id"))
    out = out.select(
        "client", "ts", "id", "late", "final", "cents", "at_end",
        F.coalesce("s_ts", "carry.s_ts").alias("i_ts"), F.coalesce("s_id", "carry.s_id").alias("i_id"),
        F.when(F.col("s_ts").isNull(), F.col("carry_long")).when(last_here, F.col("begun_long")).otherwise(F.lit(False)).alias("long"),
    )
    return out.where(F.col("i_ts").isNotNull())


ISLAND = ["client", "i_ts", "i_id"]
_STEPS = "upto array<bigint>, out_ts array<bigint>, out_id array<bigint>"
Steps = tuple[np.ndarray, np.ndarray, np.ndarray]


def _apply(steps: Steps, start: tuple[int, int]) -> tuple[int, int]:
    """The session (time and id of its first event) that runs at a chunk's end, if ``start`` runs at its beginning."""
    upto, out_ts, out_id = steps
    j = int(np.searchsorted(upto, start[0], side="right"))
    return (int(out_ts[j]), int(out_id[j])) if j < len(upto) else start


def chunk_steps(ts: np.ndarray, ids: np.ndarray, begin: int, longest: int) -> Steps:
    """The step function of a chunk's timely events, in order: a session that began before upto[j] gives way to out[j]."""
    first = np.flatnonzero(np.r_[True, ts[1:] != ts[:-1]]) if len(ts) else np.empty(0, np.int64)
    at = ts[first]
    after = np.searchsorted(at, at + longest, side="right")
    # an event may be the first of a session that a running one gives way to, if the event before is near enough
    n = int(np.searchsorted(at, begin + longest, side="right")) + 1
    now = np.arange(min(n, len(at)))
    while (more := after[now] < len(at)).any():
        now[more] = after[now[more]]
    upto = at[: len(now)] - longest
    if len(now):
        keep = np.r_[now[1:] != now[:-1], True]
        upto, now = upto[keep], now[keep]
    return upto, at[now], ids[first[now]]


def compose(first: Steps, then: Steps) -> Steps:
    """The function of two successive chunks."""
    upto, out_ts, out_id = first
    j = np.searchsorted(then[0], out_ts, side="right")
    hit = j < len(then[0])
    new_ts, new_id = out_ts.copy(), out_id.copy()
    new_ts[hit], new_id[hit] = then[1][j[hit]], then[2][j[hit]]
    beyond = then[0] > (upto[-1] if len(upto) else np.iinfo(np.int64).min)
    upto, new_ts, new_id = (np.r_[a, b[beyond]] for a, b in zip((upto, new_ts, new_id), then, strict=True))
    keep = np.r_[(new_ts[1:] != new_ts[:-1]), True] if len(upto) else np.empty(0, bool)
    return upto[keep], new_ts[keep], new_id[keep]


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def _functions_of(table: pa.Table) -> list[tuple[int, Steps]]:
    """(node, steps), in order, of a table of step functions."""
    table = table.sort_by("node")
    rows = zip(*(table[c].to_pylist() for c in ("node", "upto", "out_ts", "out_id")), strict=True)
    return [(n, tuple(np.array(x, np.int64) for x in steps)) for n, *steps in rows]


def _out(keys: tuple, columns: dict) -> pa.Table:
    n = len(next(iter(columns.values())))
    return pa.table({**{k: pa.array([v.as_py()] * n, pa.int64()) for k, v in zip(ISLAND, keys, strict=False)}, **columns})


def _leaf(rules: Rules):
    def leaf(key: tuple, table: pa.Table) -> pa.Table:
        table = table.filter(pc.invert(table["late"])).sort_by([("ts", "ascending"), ("id", "ascending")])
        chunk = key[3].as_py() + key[1].as_py() // rules.chunk
        steps = chunk_steps(_column(table, "ts"), _column(table, "id"), chunk * rules.chunk, rules.longest)
        return _out(key, {"node": pa.array([key[3].as_py()], pa.int64()), **_lists(steps)})

    return leaf


def _lists(steps: Steps) -> dict:
    return {n: pa.array([s.tolist()], pa.list_(pa.int64())) for n, s in zip(("upto", "out_ts", "out_id"), steps, strict=True)}


def _up(key: tuple, table: pa.Table) -> pa.Table:
    (_, steps), *rest = _functions_of(table)
    for _, then in rest:
        steps = compose(steps, then)
    return _out(key, {"node": pa.array([key[3].as_py()], pa.int64()), **_lists(steps)})


def _down(key: tuple, table: pa.Table) -> pa.Table:
    """The session that runs at the beginning of each node, from the one that runs at the beginning of the first."""
    start = (table["in_ts"][0].as_py(), table["in_id"][0].as_py())
    nodes, ts, ids = [], [], []
    for node, steps in _functions_of(table):
        nodes.append(node)
        ts.append(start[0])
        ids.append(start[1])
        start = _apply(steps, start)
    n = len(nodes)
    return _out(key, {
        "node": pa.array(nodes, pa.int64()), "in_ts": pa.array(ts, pa.int64()), "in_id": pa.array(ids, pa.int64()),
        "out_ts": pa.array([start[0]] * n, pa.int64()),
    })


def _place(rules: Rules):
    def place(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("ts", "ascending"), ("late", "ascending"), ("id", "ascending")])
        ts, ids, timely = _column(table, "ts"), _column(table, "id"), ~_column(table, "late")
        own = np.flatnonzero(timely)
        starts, running = [], table["in_ts"][0].as_py()
        while (j := int(np.searchsorted(ts[own], running + rules.longest, side="right"))) < len(own):
            starts.append(own[j])
            running = int(ts[own[j]])
        at = np.searchsorted(np.array(starts, np.int64), np.arange(len(ts)), side="right")
        of_ts = np.r_[table["in_ts"][0].as_py(), ts[starts]].astype(np.int64)[at]
        of_id = np.r_[table["in_id"][0].as_py(), ids[starts]].astype(np.int64)[at]
        out = table.select(["client", "ts", "id", "late", "final", "cents", "at_end"])
        out = out.append_column("x_ts", pa.array(of_ts)).append_column("x_id", pa.array(of_id))
        return out.append_column("cut", pa.array(of_ts != table["fin_ts"][0].as_py()))

    return place


_KEYS = "client bigint, i_ts bigint, i_id bigint"
_PLACED = "client bigint, ts bigint, id bigint, late boolean, final boolean, cents bigint, at_end boolean, x_ts bigint, x_id bigint, cut boolean"


def cut(rows: DataFrame, rules: Rules) -> DataFrame:
    """Places the rows of overlong islands: x_ts and x_id are the session's first event, ``cut``: another follows in the island."""
    node = (F.floor(F.col("ts") / F.lit(rules.chunk)) - F.floor(F.col("i_ts") / F.lit(rules.chunk))).cast("long")
    rows = rows.withColumn("node", node)
    steps = f"{_KEYS}, node bigint, {_STEPS}"
    levels = [written(rows.select(*ISLAND, "node", "ts", "id", "late").groupBy(*ISLAND, "node").applyInArrow(_leaf(rules), steps), "steps")]
    most, parent = levels[0].agg(F.max("node")).first()[0] or 0, F.floor(F.col("node") / F.lit(rules.fan)).cast("long")
    while most >= rules.fan:
        levels.append(written(levels[-1].withColumn("parent", parent).groupBy(*ISLAND, "parent").applyInArrow(_up, steps), "steps"))
        most //= rules.fan
    # before its first event an island runs a session so old that any event begins a new one
    zero = F.lit(0).cast("long")
    runs = levels[-1].select(*ISLAND).distinct().select(*ISLAND, zero.alias("parent"), (F.col("i_ts") - F.lit(rules.longest + 1)).alias("in_ts"), zero.alias("in_id"))
    fin, made = None, []
    for level in reversed(levels):
        met = level.withColumn("parent", parent).join(runs, [*ISLAND, "parent"]).groupBy(*ISLAND, "parent")
        made.append(written(met.applyInArrow(_down, f"{_KEYS}, node bigint, in_ts bigint, in_id bigint, out_ts bigint"), "runs"))
        # the session that runs when the island ends
        fin = made[0].select(*ISLAND, F.col("out_ts").alias("fin_ts")).distinct()
        runs = made[-1].select(*ISLAND, F.col("node").alias("parent"), "in_ts", "in_id")
    begins = written(runs.withColumnRenamed("parent", "node").join(fin, ISLAND), "begins")
    drop_written(*levels, *made)
    placed = rows.join(begins, [*ISLAND, "node"]).groupBy(*ISLAND, "node").applyInArrow(_place(rules), _PLACED)
    out = written(placed, "placed")
    drop_written(begins)
    return out


def placed(clicks: DataFrame, rules: Rules) -> DataFrame:
    """Every event that a session has or is late for, with its session's first event (x_ts, x_id)."""
    rows = written(cleaned(clicks, rules), "clicks")
    broken = written(hard_breaks(rows, rules), "breaks")
    drop_written(rows)
    out = written(islands(broken, rules), "islands")
    drop_written(broken)
    easy = out.where("not long").select(
        "client", "ts", "id", "late", "final", "cents", "at_end", F.col("i_ts").alias("x_ts"), F.col("i_id").alias("x_id"), F.lit(False).alias("cut")
    )
    return easy.unionByName(cut(out.where("long").drop("long"), rules))


def sessions(clicks: DataFrame, rules: Rules | None = None) -> DataFrame:
    """A row for each session, of (click_id, ts, arrived_at, client_id, kind, value)."""
    timely = ~F.col("late")
    found = placed(clicks, rules or Rules()).groupBy("client", "x_ts", "x_id").agg(
        F.max(F.when(timely, F.col("ts"))).alias("end_us"),
        F.count_if(timely).alias("n_clicks"),
        F.count_if(F.col("late")).alias("n_late"),
        F.sum(F.when(timely, F.col("cents")).otherwise(0)).alias("value_cents"),
        F.max(F.when(timely, F.struct("ts", "id", "final"))).alias("last"),
        F.max("at_end").alias("at_end"),
        F.max("cut").alias("cut"),
        F.array_sort(F.collect_list(F.when(timely, F.struct("ts", "id")))).alias("path"),
    )
    closed = F.when(F.col("last.final"), "end").when(F.col("at_end"), "none").when(F.col("cut"), "length").otherwise("gap")
    return found.select(
        F.col("client").alias("client_id"), F.col("x_id").alias("session_id"), F.col("x_ts").alias("start_us"), "end_us", "n_clicks", "n_late",
        "value_cents", closed.alias("closed_by"),
        F.sha2(F.array_join(F.transform("path", lambda p: p["id"].cast("string")), ","), 256).alias("path_sha256"),
    )


SQL = r"""
WITH RECURSIVE c AS (SELECT DISTINCT ON (click_id) click_id AS id, client_id AS client, epoch_us(ts) AS ts,
                            coalesce(epoch_us(arrived_at) - epoch_us(ts) > 900000000, false) AS late,
                            coalesce(value >= 60 AND isfinite(value) AND kind IN ('purchase', 'signup'), false) AS final,
                            CASE WHEN isfinite(value) THEN CAST(floor(100 * value + 0.5) AS BIGINT) ELSE 0 END AS cents
                     FROM clicks WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL ORDER BY click_id, client_id, ts),
o AS (SELECT *, row_number() OVER w AS rn, lag(ts) OVER w AS pts, lag(final) OVER w AS pfinal FROM c WHERE NOT late WINDOW w AS (PARTITION BY client ORDER BY ts, id)),
t AS (SELECT *, sum(CASE WHEN pts IS NULL OR pfinal OR ts - pts >= 900000000 THEN 1 ELSE 0 END) OVER (PARTITION BY client ORDER BY rn) AS isl FROM o),
u AS (SELECT client, isl, ts, min(rn) AS rn FROM t GROUP BY ALL),
nx AS MATERIALIZED (SELECT a.client, a.isl, a.ts, b.ts AS nts, b.rn AS nrn FROM u a ASOF JOIN u b ON a.client = b.client AND a.isl = b.isl AND a.ts + 3600000000 < b.ts),
s AS (SELECT client, isl, min(ts) AS ts, min(rn) AS rn FROM t GROUP BY client, isl
      UNION ALL SELECT s.client, s.isl, nx.nts, nx.nrn FROM s JOIN nx ON s.client = nx.client AND s.isl = nx.isl AND s.ts = nx.ts),
g AS (SELECT t.*, s.rn AS srn, s.ts AS sts FROM t ASOF JOIN s ON t.client = s.client AND t.rn >= s.rn),
z AS (SELECT client, srn, any_value(sts) AS sts, arg_min(id, rn) AS session_id, max(ts) AS end_us, count(*) AS n_clicks, sum(cents) AS cents,
             arg_max(final, rn) AS final, max(rn) AS last_rn, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rn) AS path FROM g GROUP BY client, srn),
q AS (SELECT client, sts, max(srn) AS srn FROM z GROUP BY client, sts),
l AS (SELECT c.client, q.srn, count(*) AS n_late FROM c ASOF JOIN q ON c.client = q.client AND c.ts >= q.sts WHERE c.late GROUP BY c.client, q.srn)
SELECT z.client AS client_id, session_id, sts AS start_us, end_us, n_clicks, coalesce(n_late, 0) AS n_late, CAST(z.cents AS BIGINT) AS value_cents,
       CASE WHEN z.final THEN 'end' WHEN n.ts IS NULL THEN 'none' WHEN n.ts - n.pts >= 900000000 THEN 'gap' ELSE 'length' END AS closed_by,
       sha256(path) AS path_sha256
FROM z LEFT JOIN t n ON n.client = z.client AND n.rn = z.last_rn + 1 LEFT JOIN l ON l.client = z.client AND l.srn = z.srn
"""
