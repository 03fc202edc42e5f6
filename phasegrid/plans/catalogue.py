"""The registered queries over the driver's tables, each with its SQL where SQL can express it.

Roles: in events a subject is user_id, an environment event_type, a minute the day of the month; in lineitem a
subject is a supplier, an environment the return flag and a phase the line status. Doubles are rounded to six decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import cluster, inference, linear, mixed, order, phase, rank, scale, series, signal, validity
from ..sources import recordings as recordings_source
from . import levels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals (never -0.0), counts to long."""
    out = {c: F.round(c, 6) + 0.0 for c, t in df.dtypes if t in ("double", "float") or t.startswith("decimal")}
    return df.withColumns({c: v.cast("double") for c, v in out.items()})


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(lambda name: table(spark, sf_dir, name)))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def minutes(events: DataFrame) -> DataFrame:
    return events.select("event_id", "user_id", "event_type", "ts", "value", F.dayofmonth("ts").alias("minute"))


M = "m as (select event_id, user_id, event_type, ts, value, dayofmonth(ts) as minute from events)"
PHASE = "case when minute between 1 and 10 then 'static' when minute between 11 and 20 then 'dynamic' end"


def R(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 as {name}"


# ---- features of phases ----


@query(f"with {M}, d as (select user_id, event_type, avg(value) filter (minute between 11 and 20) - avg(value) filter (minute between 1 and 10) as delta from m where user_id is not null and event_type is not null group by 1, 2) select user_id, {R('stddev_samp(delta)', 'reactivity_sd')}, count(delta) as n_env from d group by 1")
def reactivity_sd(t):
    return phase.reactivity(minutes(t("events")), "user_id", "event_type", C.minute_phase(F.col("minute")))


@query(f"with {M} select user_id, event_type, {R('avg(value) filter (minute between 1 and 10)', 'static_mean')}, {R('avg(value) filter (minute between 11 and 20)', 'dynamic_mean')}, {R('avg(value) filter (minute between 11 and 20) - avg(value) filter (minute between 1 and 10)', 'delta')} from m group by 1, 2")
def phase_delta_pivot(t):
    return phase.phase_means(minutes(t("events")), ["user_id", "event_type"], C.minute_phase(F.col("minute")))


@query(f"with {M}, d as (select user_id, event_type, avg(value) filter (minute = 20) - avg(value) filter (minute = 10) as delta from m where minute in (10, 20) group by 1, 2) select user_id, {R('stddev_samp(delta)', 'delta_sd')}, count(delta) as n_env from d group by 1")
def timepoint_20_10_sd(t):
    return phase.point_difference(minutes(t("events")), "user_id", "event_type", "minute", 10, 20, F.col("value"))


@query(f"with e as (select l_suppkey, l_returnflag, avg(l_quantity) as v from lineitem where l_suppkey is not null and l_returnflag is not null group by 1, 2) select l_suppkey, {R('avg(v)', 'mean_env')}, {R('stddev_samp(v)', 'sd_env')}, count(v) as n_env from e group by 1")
def raw_mean_env_sd(t):
    return phase.dispersion(t("lineitem"), "l_suppkey", "l_returnflag", F.col("l_quantity"))


@query(f"with d as (select l_suppkey, l_returnflag, avg(l_quantity) filter (l_linestatus = 'O') - avg(l_quantity) filter (l_linestatus = 'F') as delta from lineitem group by 1, 2) select l_suppkey, {R('stddev_samp(delta)', 'reactivity_sd')}, count(delta) as n_env from d group by 1")
def phase_pivot_delta_sd(t):
    p = F.when(F.col("l_linestatus") == "F", "static").when(F.col("l_linestatus") == "O", "dynamic")
    return phase.reactivity(t("lineitem"), "l_suppkey", "l_returnflag", p, "l_quantity")


@query(f"select l_suppkey, {R('avg(l_tax * 100 - l_discount * 100) filter (l_linestatus = $$O$$) - avg(l_tax * 100 - l_discount * 100) filter (l_linestatus = $$F$$)', 'delta_gap')} from lineitem group by 1")
def delta_gap(t):
    p = F.when(F.col("l_linestatus") == "F", "static").when(F.col("l_linestatus") == "O", "dynamic")
    return phase.gap_change(t("lineitem"), ["l_suppkey"], p, F.col("l_discount") * 100, F.col("l_tax") * 100)


@query(f"with {M} select event_id, {R('value - avg(value) filter (minute in (1, 2, 3)) over (partition by user_id, event_type)', 'corrected')} from m")
def baseline_correct(t):
    return phase.baseline_corrected(minutes(t("events")), ["user_id", "event_type"], (1, 2, 3)).select("event_id", "corrected")


SERIES = f"{M}, s as (select user_id, event_type, minute, avg(value) as value from m group by 1, 2, 3)"
DYNAMIC = f"{SERIES}, p as (select *, (value + lag(value) over w) / 2 * (minute - lag(minute) over w) as area from s where minute between 11 and 20 and value is not null window w as (partition by user_id, event_type order by minute))"


def minute_series(t):
    return minutes(t("events")).groupBy("user_id", "event_type", "minute").agg(F.avg("value").alias("value"))


@query(f"with {DYNAMIC} select user_id, event_type, {R('case when count(value) > 1 then regr_slope(value, minute) end', 'slope')}, {R('sum(area)', 'auc')}, {R('stddev_samp(value)', 'sd')}, count(value) as n_points from p group by 1, 2")
def dynamic_slope_auc_sd(t):
    return phase.dynamics(minute_series(t), ["user_id", "event_type"])


@query("select o_custkey, arg_min(o_orderpriority, o_orderkey) filter (o_orderpriority is not null) as o_orderpriority, arg_min(o_totalprice, o_orderkey) filter (o_totalprice > 100000) as big from orders group by 1")
def first_nonnull_by_id(t):
    rows = t("orders").withColumn("big", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")))
    return phase.first_known(rows, ["o_custkey"], ["o_orderpriority", "big"], "o_orderkey")


@query("with s(scenario, letter) as (values ('first', 'A'), ('second', 'N'), ('third', 'R')) select scenario, l_returnflag, count(*) as n from lineitem, s where contains(l_returnflag, letter) group by 1, 2")
def scenario_fanout(t):
    rows = t("lineitem")
    s = rows.sparkSession.createDataFrame([("first", "A"), ("second", "N"), ("third", "R")], "scenario string, segment string")
    return phase.scenario_rows(rows, "l_returnflag", s).groupBy("scenario", "l_returnflag").agg(F.count("*").alias("n"))


@query(f"with {M}, w as (select user_id, event_type, minute, avg(value) as v from m group by 1, 2, 3) select user_id, event_type, " + ", ".join(R(f"max(v) filter (minute = {k})", f"ev_{k}") for k in (1, 5, 10)) + " from w group by 1, 2")
def minute_pivot_wide(t):
    return phase.pivot_minutes(minutes(t("events")), ["user_id", "event_type"], (1, 5, 10), "ev")


# ---- series ----


@query("select user_id, minute, " + R("avg(value)", "mean_value") + ", count(value) as n from (select user_id, unnest(range(1, 21))::int as minute from (select distinct user_id from events)) g left join (select user_id as u, (hour(ts) + 1)::int as h, value from events) e on g.user_id = e.u and g.minute = e.h group by 1, 2")
def minute_bucket_grid(t):
    return series.minute_grid(t("events").select("user_id", "ts", "value"), ["user_id"], F.hour("ts") * 60, "value")


@query("with q as (select user_id, value, ntile(4) over (partition by user_id order by ts, event_id) as quarter, count(*) over (partition by user_id) as c from events) select user_id, quarter, " + R("case when max(c) >= 4 then avg(value) end", "mean_value") + ", count(*) as n from q group by 1, 2")
def quarter_means(t):
    return series.quarter_means(t("events"), ["user_id"], ["ts", "event_id"], "value").withColumn("quarter", F.col("quarter").cast("long"))


@query(
    "with p as (select *, row_number() over w as i, count(*) over (partition by user_id) as n, first_value(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following) as a, last_value(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following) as b, "
    "sum(value) over (partition by user_id order by ts, event_id rows between 3 preceding and 2 following) as s from events window w as (partition by user_id order by ts, event_id)) "
    f"select event_id, {R('(s + greatest(3 - (i - 1), 0) * a + greatest(2 - (n - i), 0) * b) / 6', 'smooth')} from p"
)
def centered_moving_avg_edge(t):
    return series.moving_average_edges(t("events"), ["user_id"], ["ts", "event_id"], "value", 6).select("event_id", "smooth")


@query(
    "with p as (select *, case when count(value) over f = 5 then avg(value) over f end as m from events window f as (partition by user_id order by ts, event_id rows between 2 preceding and 2 following)) "
    f"select event_id, {R('coalesce(first_value(m ignore nulls) over (partition by user_id order by ts, event_id rows between current row and unbounded following), last_value(m ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row))', 'smooth')} from p"
)
def rolling_mean_filled(t):
    return series.rolling_mean_filled(t("events"), ["user_id"], ["ts", "event_id"], "value", 5).select("event_id", "smooth")


@query(
    "with v as (select event_id, user_id, ts, case when value <= 60 then value end as value, row_number() over (partition by user_id order by ts, event_id) as i from events), "
    "k as (select *, case when value is not null then i end as ki from v), "
    "g as (select *, last_value(value ignore nulls) over b as bv, last_value(ki ignore nulls) over b as bi, first_value(value ignore nulls) over a as av, first_value(ki ignore nulls) over a as ai from k "
    "window b as (partition by user_id order by i rows between unbounded preceding and current row), a as (partition by user_id order by i rows between current row and unbounded following)) "
    f"select event_id, {R('coalesce(value, bv + (av - bv) * (i - bi) / nullif(ai - bi, 0), bv, av)', 'filled')} from g"
)
def gap_interpolate(t):
    rows = t("events").withColumn("value", F.when(F.col("value") <= 60, F.col("value")))
    return series.interpolated(rows, ["user_id"], ["ts", "event_id"], "value").select("event_id", "filled")


GAPS = "g as (select user_id, event_id, ts, epoch(ts) - lag(epoch(ts)) over (partition by user_id order by ts, event_id) as rr from events)"


def gaps(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t("events").select("user_id", "event_id", "ts", (sec - F.lag(sec).over(w)).alias("rr"))


@query(
    f"with {GAPS}, d as (select *, rr - lag(rr) over (partition by user_id order by ts, event_id) as d from g where rr is not null), a as (select user_id, count(rr) as n, avg(rr) as m, stddev_pop(rr) as s, sqrt(avg(d * d)) as r, 100 * avg(case when abs(d) > 50 then 1.0 when d is not null then 0.0 end) as p from d group by 1) "
    f"select user_id, n, {R('case when n >= 5 then 60000 / m end', 'hr')}, {R('case when n >= 5 then m end', 'mean_rr')}, {R('case when n >= 5 then s end', 'sdnn')}, {R('case when n >= 5 then r end', 'rmssd')}, {R('case when n >= 5 then p end', 'pnn50')} from a"
)
def diff_rmssd_pnn(t):
    return series.variability(gaps(t).where("rr is not null"), ["user_id"], ["ts", "event_id"])


@query(
    "with p as (select l_orderkey, l_linenumber, l_suppkey, l_extendedprice / 30 as rr from lineitem), s as (select *, avg(case when rr between 300 and 2000 then 1.0 else 0.0 end) over (partition by l_suppkey) as share from p), "
    "k as (select * from s where case when share >= 0.6 then rr between 300 and 2000 else rr between 250 and 2500 end), m as (select *, median(rr) over (partition by l_suppkey) as med from k), d as (select *, median(abs(rr - med)) over (partition by l_suppkey) as mad from m), "
    "o as (select *, abs(rr - med) <= 3 * 1.4826 * mad as ok from d), c as (select *, sum(ok::int) over (partition by l_suppkey) as n from o) "
    f"select l_suppkey, count(*) as n_kept, {R('avg(rr)', 'mean_rr')} from c where ok or n < 10 group by 1"
)
def mad_clean(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_extendedprice") / 30).alias("rr"))
    return series.clean_intervals(rows, ["l_suppkey"]).groupBy("l_suppkey").agg(F.count("*").alias("n_kept"), F.avg("rr").alias("mean_rr"))


@query(
    "with q as (select user_id, quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events where value >= 0 group by 1) "
    f"select user_id, count(*) as n_all, count(case when value >= 0 and (b = a or value between a - 1.5 * (b - a) and b + 1.5 * (b - a)) then 1 end) as n_kept, {R('avg(case when value >= 0 and (b = a or value between a - 1.5 * (b - a) and b + 1.5 * (b - a)) then value end)', 'mean_kept')} from events left join q using (user_id) group by 1"
)
def iqr_fence(t):
    kept = series.fence(t("events"), ["user_id"], "value", 1.5)
    return kept.groupBy("user_id").agg(F.count("*").alias("n_all"), F.count("fenced").alias("n_kept"), F.avg("fenced").alias("mean_kept"))


@query(f"select user_id, {R('case when count(ts) > 1 and max(ts) > min(ts) then round((count(ts) - 1) / ((epoch(max(ts)) - epoch(min(ts))) / 86400)) end', 'fs')} from events group by 1")
def sampling_rate(t):
    return series.sampling_rate(t("events").withColumn("t_sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 86400), ["user_id"])


@query(f"select c_custkey, {R('case when stddev_pop(c_acctbal) over w = 0 then 0 else (c_acctbal - avg(c_acctbal) over w) / stddev_pop(c_acctbal) over w end', 'z')} from customer window w as (partition by c_mktsegment)")
def within_group_z(t):
    return series.group_z(t("customer"), "c_acctbal", ["c_mktsegment"]).select("c_custkey", "z")


@query(
    "with s as (select n_nationkey, sum(c_acctbal) as v from customer join nation on c_nationkey = n_nationkey group by 1), c as (select *, sum(v) over (order by v desc, n_nationkey rows unbounded preceding) / sum(v) over () as cumulative from s) "
    "select (count(*) filter (cumulative < 0.8)) + 1 as needed, count(*) as n from c"
)
def cum_threshold(t):
    s = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey").agg(F.sum("c_acctbal").alias("v"))
    placed = order.running_sum(order.positions(s, [F.desc("v"), F.asc("n_nationkey")]), "position", "v", "upto")
    total = s.agg(F.sum("v").alias("all"))
    return placed.join(F.broadcast(total), F.lit(True)).agg((F.count(F.when(F.col("upto") / F.col("all") < 0.8, 1)) + 1).alias("needed"), F.count("*").alias("n"))


# ---- cleaning and encoding ----


@query("select event_id, case when lower(trim(p)) in ('-', '', 'n/a') then null else try_cast(trim(p) as double) end as number from (select event_id, case event_id % 4 when 0 then ' ' || value::varchar when 1 then '-' when 2 then 'N/A' else props end as p from (select event_id, floor(value) as value, props from events))")
def try_numeric_tokens(t):
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(" "), F.floor("value").cast("double").cast("string"))).when(F.col("event_id") % 4 == 1, "-").when(F.col("event_id") % 4 == 2, "N/A").otherwise(F.col("props"))
    return t("events").select("event_id", C.number(text).alias("number"))


@query(f"with {M} select event_type, case when minute in (0, 5, 10) then 'static' when minute in (10, 15, 20) then 'dynamic' end as survey, {PHASE} as phase, count(*) as n from m group by 1, 2, 3")
def dim_map_phase(t):
    m = minutes(t("events")).select("event_type", C.survey_phase(F.col("minute")).alias("survey"), C.minute_phase(F.col("minute")).alias("phase"))
    return m.groupBy("event_type", "survey", "phase").agg(F.count("*").alias("n"))


@query("with s as (select upper(trim(substr(c_mktsegment, 1, 1))) as code from customer), c as (select code, case when code in ('A', 'B') then 'AB' when code in ('C', 'D') then 'CD' when code in ('E', 'F') then 'EF' when code in ('G', 'H') then 'GH' end as condition from s) select code, condition, case when code in ('A', 'C', 'E', 'G') then 'static' when code in ('B', 'D', 'F', 'H') then 'dynamic' end as phase, (case when condition in ('AB', 'GH') then -1 when condition in ('CD', 'EF') then 1 end)::int as direction, count(*) as n from c group by 1, 2, 3, 4")
def dim_map_direction(t):
    code = F.lower(F.substring("c_mktsegment", 1, 1))
    rows = t("customer").select(C.environment(code).alias("code"), C.condition(code).alias("condition"), C.segment_phase(code).alias("phase"), C.direction(code).alias("direction"))
    return rows.groupBy("code", "condition", "phase", "direction").agg(F.count("*").alias("n"))


@query("select c_custkey, case when c_acctbal > 9000 then null when c_acctbal >= 4500 then 'high' when c_acctbal <= 4400 then 'low' end as label, case when c_acctbal > 9000 then 0.0 when c_acctbal >= 4500 then 1.0 else 0.0 end as bit, (case when c_acctbal < 0 and c_nationkey <= 12 and c_acctbal <= 9000 then 1 else 0 end)::int as flag from customer")
def tie_policy_binarise(t):
    x = F.when(F.col("c_acctbal") <= 9000, F.col("c_acctbal"))
    return t("customer").select("c_custkey", C.two_sided(x, 4500, 4400, "high", "low").alias("label"), C.at_least(x, 4500).alias("bit"), C.flag((x < 0) & (F.col("c_nationkey") <= 12)).alias("flag"))


@query(f"select l_orderkey, l_linenumber, {R('l_quantity * l_tax', 'l_quantity_x_l_tax')}, {R('(l_quantity + l_tax) / 2', 'mean_two')} from lineitem")
def products_and_row_mean(t):
    p = C.products(["l_quantity", "l_tax"])
    return t("lineitem").select("l_orderkey", "l_linenumber", *(v.alias(n) for n, v in p.items()), C.row_mean(F.col("l_quantity"), F.col("l_tax"), F.lit(None).cast("double")).alias("mean_two"))


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders) where n = 1")
def keyed_dedupe(t):
    return rank.first_per_key(t("orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("select feature, (sum(gap))::bigint as n_null, count(*) as n_rows, " + R("100.0 * sum(gap) / count(*)", "pct_null") + " from (select 'value' as feature, (case when value <= 60 then 0 else 1 end) as gap from events union all select 'props', (props is null)::int from events) group by 1")
def missing_summary(t):
    return scale.missing_summary(t("events").withColumn("value", F.when(F.col("value") <= 60, F.col("value"))), ["value", "props"])


@query("select p_partkey, upper(trim(p_name)) as name, regexp_replace(lower(trim(p_type)), '\\W+', '_', 'g') as kind from part")
def text_normalise(t):
    return t("part").select("p_partkey", C.environment(F.col("p_name")).alias("name"), F.regexp_replace(F.lower(F.trim("p_type")), r"\W+", "_").alias("kind"))


# ---- joins and sets ----


@query(
    "with a as (select o_custkey as id, count(*) as n_orders from orders group by 1), b as (select c_custkey as id, c_acctbal from customer), c as (select user_id as id, avg(value) as v from events group by 1) "
    f"select id, n_orders, c_acctbal, {R('v', 'mean_value')} from a full join b using (id) full join c using (id)"
)
def outer_chain(t):
    a = t("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n_orders"))
    b = t("customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    c = t("events").groupBy(F.col("user_id").alias("id")).agg(F.avg("value").alias("mean_value"))
    # One aggregate over the union of the long forms, in place of a chain of outer joins.
    return rank.same_columns(a, b, c).groupBy("id").agg(F.max("n_orders").alias("n_orders"), F.max("c_acctbal").alias("c_acctbal"), F.max("mean_value").alias("mean_value"))


@query("with a as (select l_suppkey, l_returnflag, count(*) as n_open from lineitem where l_linestatus = 'O' group by 1, 2), b as (select l_suppkey, l_returnflag, count(*) as n_done from lineitem where l_linestatus = 'F' group by 1, 2) select l_suppkey, l_returnflag, n_open, n_done from a full join b using (l_suppkey, l_returnflag)")
def composite_outer(t):
    rows = t("lineitem")
    a = rows.where("l_linestatus = 'O'").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n_open"))
    b = rows.where("l_linestatus = 'F'").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n_done"))
    return a.join(b, ["l_suppkey", "l_returnflag"], "outer")


@query("select o_orderkey, c_mktsegment, n_name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey")
def left_dim(t):
    people = t("customer").join(F.broadcast(t("nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return t("orders").join(people, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_mktsegment", "n_name")


@query("select doc_id, quality, lang, source from labels join documents using (doc_id)")
def inner_label(t):
    return t("labels").join(t("documents").select("doc_id", "lang", "source"), "doc_id").select("doc_id", "quality", "lang", "source")


@query("select o_custkey as id from orders union all select c_custkey from customer")
def union_all(t):
    return rank.same_columns(t("orders").select(F.col("o_custkey").alias("id")), t("customer").select(F.col("c_custkey").alias("id")))


@query("select distinct l_returnflag, l_linestatus from lineitem")
def distinct_pairs(t):
    return t("lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("select o_custkey as id from orders intersect select c_custkey from customer where c_acctbal > 5000")
def intersect_keys(t):
    return t("orders").select(F.col("o_custkey").alias("id")).intersect(t("customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("id")))


@query("select c_custkey as id from customer except select o_custkey from orders")
def except_keys(t):
    return t("customer").select(F.col("c_custkey").alias("id")).subtract(t("orders").select(F.col("o_custkey").alias("id")))


@query("select a.label as label_a, b.label as label_b, count(*) as n from (select distinct label from embeddings) a, (select distinct label from embeddings) b where a.label < b.label group by 1, 2")
def unordered_pairs(t):
    a = t("embeddings").select(F.col("label").alias("label_a")).distinct()
    return a.join(a.withColumnRenamed("label_a", "label_b"), F.col("label_a") < F.col("label_b")).groupBy("label_a", "label_b").agg(F.count("*").alias("n"))


# ---- aggregation ----


@query("select lang, quality, count(d.doc_id) as n from (select distinct lang from documents) l cross join (select distinct quality from labels) q left join (select doc_id, lang, quality from labels join documents using (doc_id)) d using (lang, quality) group by 1, 2")
def crosstab_long(t):
    # Every language has labelled documents of the tables, so margins of the joined rows give all cells.
    rows = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id").select("lang", "quality")
    grid = t("documents").select("lang").distinct().join(t("labels").select("quality").distinct(), F.lit(True))
    return grid.join(rows.groupBy("lang", "quality").agg(F.count("*").alias("n")), ["lang", "quality"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


@query(f"select lang, {R('avg(toxic)', 'rate')}, count(*) as n from labels join documents using (doc_id) group by 1")
def rate_by_group(t):
    return t("labels").join(t("documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.avg("toxic").alias("rate"), F.count("*").alias("n"))


@query("select label, vec_id, row_number() over (partition by label order by vec_id) as place from embeddings")
def collect_members(t):
    """Membership as rows: a list for each group would grow with the group."""
    return order.places_in_group(t("embeddings").select("label", "vec_id"), ["label"], ["vec_id"], "place")


@query("with n as (select l_linestatus, l_returnflag, count(*) as n from lineitem group by 1, 2) select l_linestatus, string_agg('C' || l_returnflag || ':' || n::varchar, ', ' order by l_returnflag) as sizes, min(n) as min_size, max(n) as max_size from n group by 1")
def sizes_string(t):
    return validity.sizes_text(t("lineitem"), ["l_linestatus"], "l_returnflag")


@query(f"select event_type, {R('avg(value)', 'mean')}, {R('median(value)', 'median')}, {R('quantile_cont(value, 0.1)', 'p10')}, {R('min(value)', 'min')}, {R('max(value)', 'max')}, {R('stddev_pop(value)', 'sd')}, count(value) as n from events group by 1")
def spread_stats(t):
    rows = t("events").select("event_type", "value")
    plain = rows.groupBy("event_type").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.stddev_pop("value").alias("sd"), F.count("value").alias("n"))
    q = order.quantiles(rows, "value", [0.5, 0.1], ["event_type"]).groupBy("event_type").agg(F.max(F.when(F.col("q") == 0.5, F.col("at"))).alias("median"), F.max(F.when(F.col("q") == 0.1, F.col("at"))).alias("p10"))
    return plain.join(q, "event_type", "left")


@query("select count(distinct user_id) as n_users, count(distinct event_type) as n_types, count(distinct dayofmonth(ts)) as n_days from events")
def distinct_counts(t):
    return t("events").agg(F.count_distinct("user_id").alias("n_users"), F.count_distinct("event_type").alias("n_types"), F.count_distinct(F.dayofmonth("ts")).alias("n_days"))


# ---- ranks ----


@query("with s as (select s_suppkey, case when s_acctbal >= 0 then floor(s_acctbal / 100) end as v from supplier), r as (select *, case when v is not null then rank() over (order by v desc nulls last) end as r from s) select s_suppkey, coalesce(r, max(r) over ()) as place from r")
def rank_min_mask(t):
    rows = t("supplier").select("s_suppkey", F.when(F.col("s_acctbal") >= 0, F.floor(F.col("s_acctbal") / 100)).alias("v"))
    return order.global_rank(rows, "v", "place", descending=True).select("s_suppkey", "place")


@query(
    "with p as (select p_brand, p_partkey, p_retailprice as up, case when p_size > 3 then p_size end as down from part), a as (select *, rank() over (partition by p_brand order by up desc nulls last) as ru, case when down is not null then rank() over (partition by p_brand order by down asc nulls last) end as rd from p) "
    "select p_partkey, (ru + coalesce(rd, max(rd) over (partition by p_brand), 0))::double + (case when up < 1000 then 3 else 0 end) as score from a"
)
def composite_rank(t):
    rows = t("part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("up"), F.when(F.col("p_size") > 3, F.col("p_size")).alias("down"))
    return rank.composite_rank(rows, ["up"], ["down"], ["p_brand"], penalty=F.when(F.col("up") < 1000, 3.0).otherwise(0.0)).select("p_partkey", "score")


@query("select l_returnflag, l_orderkey, l_linenumber, l_extendedprice from (select *, row_number() over (partition by l_returnflag order by l_extendedprice, l_orderkey, l_linenumber) as n from lineitem) where n = 1")
def argmin_per_group(t):
    best = F.min(F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("b")
    return t("lineitem").groupBy("l_returnflag").agg(best).select("l_returnflag", "b.l_orderkey", "b.l_linenumber", "b.l_extendedprice")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey limit 10")
def top_rows(t):
    return rank.top_rows(t("orders").select("o_orderkey", "o_totalprice"), rank.nulls_last("-o_totalprice", "o_orderkey"), 10)


@query(
    "with f as (select l_orderkey, l_linenumber, unnest([{'feature': 'discount', 'value': l_discount}, {'feature': 'quantity', 'value': l_quantity / 500}, {'feature': 'tax', 'value': l_tax}]) as s from lineitem) "
    f"select l_orderkey, l_linenumber, feature, {R('value', 'value')}, place from (select l_orderkey, l_linenumber, s.feature as feature, s.value as value, row_number() over (partition by l_orderkey, l_linenumber order by s.value desc nulls last, s.feature) as place from f) where place <= 2"
)
def row_top_features(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("discount"), (F.col("l_quantity") / 500).alias("quantity"), F.col("l_tax").alias("tax"))
    return rank.extreme_features(rows, ["l_orderkey", "l_linenumber"], ["discount", "quantity", "tax"], 2).withColumn("place", F.col("place").cast("long"))


@query(
    "with m as (select c_nationkey as i, n_regionkey as g, avg(c_acctbal) as m from customer join nation on c_nationkey = n_nationkey group by 1, 2), p as (select i, g, (count(*) filter (c_acctbal >= m) + 1) / (count(*) + 1) as p from m, customer group by 1, 2), r as (select *, (count(*) over (partition by g) - row_number() over (partition by g order by p, i) + 1) * p as s from p) "
    f"select i, {R('p', 'p')}, {R('least(1.0, max(s) over (partition by g order by p, i rows unbounded preceding))', 'p_holm')} from r"
)
def holm_step_down(t):
    """Empirical upper tails of the nations' mean balances among all balances, corrected inside each region."""
    means = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("c_nationkey").alias("i"), F.col("n_regionkey").alias("g")).agg(F.avg("c_acctbal").alias("m"))
    # A row for each nation, of which there are 25 at any size.
    tails = t("customer").select("c_acctbal").crossJoin(F.broadcast(means)).groupBy("i", "g").agg(((F.count(F.when(F.col("c_acctbal") >= F.col("m"), 1)) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))
    return rank.holm(tails, "p", ["g"], ["i"]).select("i", "p", "p_holm")


# ---- scaling and correlation ----

SUPPLIER = "x as (select l_suppkey, avg(l_quantity) as q, avg(l_extendedprice) as e, case when l_suppkey % 7 <> 0 then avg(l_discount) end as d, avg(l_tax) as t from lineitem group by 1)"
NAMES = ("q", "e", "d", "t")


def supplier(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("e"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t")).withColumn("d", F.when(F.col("l_suppkey") % 7 != 0, F.col("d")))


@query(f"with {SUPPLIER} select l_suppkey, {R('coalesce(d, (select avg(d) from x))', 'd')} from x")
def mean_impute(t):
    return scale.impute(supplier(t), ["d"]).select("l_suppkey", "d")


@query(f"with {SUPPLIER} select l_suppkey, {R('coalesce(d, (select median(d) from x))', 'd')} from x")
def median_impute(t):
    return scale.impute(supplier(t), ["d"], "median").select("l_suppkey", "d")


@query(f"with {SUPPLIER} select l_suppkey, {R('(q - avg(q) over ()) / (stddev_pop(q) over () * sqrt(2))', 'q')}, {R('(e - avg(e) over ()) / (stddev_pop(e) over () * sqrt(2))', 'e')}, {R('(t - avg(t) over ()) / stddev_pop(t) over ()', 't')} from x")
def block_z_sqrtp(t):
    return scale.block_standardise(supplier(t), {"one": ["q", "e"], "two": ["t"]}).select("l_suppkey", "q", "e", "t")


@query(f"with {SUPPLIER} select l_suppkey, {R('(q - (select median(q) from x)) / (select quantile_cont(q, 0.75) - quantile_cont(q, 0.25) from x)', 'q')} from x")
def robust_scale(t):
    return scale.robust_scale(supplier(t), ["q"]).select("l_suppkey", "q")


@query(f"with {SUPPLIER} select l_suppkey, {R('(d - avg(d) over ()) / stddev_samp(d) over ()', 'd')} from x")
def z_sample(t):
    return scale.standardise(supplier(t), ["d"], sample=True).select("l_suppkey", "d")


@query(f"with x as (select l_quantity as a, l_extendedprice / 1000 as b, l_tax * 100 as c from lineitem) select {R('3 / 2.0 * (1 - (var_samp(a) + var_samp(b) + var_samp(c)) / var_samp(a + b + c))', 'alpha')}, count(*) as n, 3::int as k from x")
def cronbach_alpha(t):
    rows = t("lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"), (F.col("l_tax") * 100).alias("c"))
    return linear.cronbach_alpha(rows, ["a", "b", "c"])


@query(f"with {SUPPLIER} " + " union all ".join(f"select '{a}' as a, '{b}' as b, {R(f'corr({a}, {b}) filter ({a} is not null and {b} is not null)', 'r')}, count(*) filter ({a} is not null and {b} is not null) as n from x" for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]))
def pearson_long(t):
    return linear.pearson_long(supplier(t), list(NAMES))


@query(f"with {SUPPLIER} select row, col, {R('r', 'r')} from (" + " union all ".join(f"select '{b}' as row, '{a}' as col, corr({a}, {b}) as r from x" for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]) + ")")
def lower_triangle(t):
    return linear.lower_triangle(linear.pearson_long(supplier(t), list(NAMES)), list(NAMES))


@query(f"with c as (select c_custkey, floor(c_acctbal / 50) as x, c_nationkey as y from customer), r as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as x, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as y from c) select 'x' as a, 'y' as b, {R('corr(x, y)', 'rho')}, count(*) as n from r")
def spearman_rho(t):
    return linear.spearman(t("customer").select("c_custkey", F.floor(F.col("c_acctbal") / 50).alias("x"), F.col("c_nationkey").alias("y")), "c_custkey", "x", "y")


@query(f"with {SUPPLIER} select {R('avg(sqrt(q * q + e * e))', 'mean_norm')}, {R('stddev_pop(sqrt(q * q + e * e))', 'sd_norm')} from x")
def block_energy(t):
    return linear.row_energy(supplier(t), ["q", "e"])


# ---- clusters ----

VEC = "v as (select vec_id, label, list_transform(embedding, lambda z: z::double) as x from embeddings), l as (select vec_id, label, unnest(range(1, 65)) as d, unnest(x) as v from v)"
DIMS = 64  # of the embeddings
GAP = "sqrt(list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
CENTRE = f"{VEC}, cd as (select label, d, avg(v) as m, count(*) as size from l group by 1, 2), c as (select label, list(m order by d) as m, max(size) as size from cd group by 1)"


def vectors(t):
    return t("embeddings").select("vec_id", F.col("label").alias("cluster"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


@query(f"with {VEC}, g as (select label, d, sum(v) as s, sum(v * v) as q, count(*) as n from l group by 1, 2), e as (select d, sum(q) - sum(s * s / n) as w, sum(s * s / n) - sum(s) * sum(s) / sum(n) as b, sum(n)::bigint as n, count(*) as k from g group by 1) select {R('(sum(b) / (max(k) - 1)) / (sum(w) / (max(n) - max(k)))', 'ch')}, max(n) as n, max(k) as k from e")
def calinski_harabasz(t):
    return validity.calinski_harabasz(vectors(t))


@query(f"with {CENTRE}, s as (select label, avg({GAP.format('x', 'm')}) as s from v join c using (label) group by 1), cs as (select * from c join s using (label)), w as (select a.label, max((a.s + b.s) / {GAP.format('a.m', 'b.m')}) as r from cs a join cs b on a.label <> b.label group by 1) select {R('avg(r)', 'db')} from w")
def davies_bouldin(t):
    return validity.davies_bouldin(vectors(t))


@query(f"with {VEC}, d as (select a.vec_id, a.label, b.label as other, avg({GAP.format('a.x', 'b.x')}) as d from v a join v b on a.vec_id <> b.vec_id group by 1, 2, 3), e as (select vec_id, label, max(d) filter (other = label) as a, min(d) filter (other <> label) as b from d group by 1, 2) select {R('avg(case when b is null then null when a is null then 0 else (b - a) / greatest(a, b) end)', 'silhouette')}, count(case when b is null then null when a is null then 0 else 1 end) as n from e")
def silhouette_exact(t):
    return validity.silhouette(vectors(t), "vec_id")


@query(f"with {VEC}, d as (select a.vec_id, a.label, b.label as other, avg({GAP.format('a.x', 'b.x')} ** 2) as d from v a join v b on a.vec_id <> b.vec_id group by 1, 2, 3), e as (select vec_id, label, max(d) filter (other = label) as a, min(d) filter (other <> label) as b from d group by 1, 2) select {R('avg(case when b is null then null when a is null then 0 else (b - a) / greatest(a, b) end)', 'silhouette2')}, count(case when b is null then null when a is null then 0 else 1 end) as n from e")
def silhouette_squared(t):
    return validity.squared_silhouette(vectors(t), "vec_id")


@query("with c as (select label as a, vec_id % 10 as b, count(*) as n from embeddings group by 1, 2), r as (select sum(n * (n - 1) / 2) as r from (select sum(n) as n from c group by a)), q as (select sum(n * (n - 1) / 2) as q from (select sum(n) as n from c group by b)), p as (select sum(n * (n - 1) / 2) as c, sum(n)::bigint as n from c) select round(case when (r + q) / 2 = r * q / (n * (n - 1) / 2) then 1 else (c - r * q / (n * (n - 1) / 2)) / ((r + q) / 2 - r * q / (n * (n - 1) / 2)) end, 6) + 0.0 as ari, n from p, r, q")
def adjusted_rand(t):
    return validity.agreement(t("embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 10).alias("b")), "a", "b")


@query(f"with f as (select c_mktsegment as cluster, c_acctbal as v from customer), g as (select cluster, sum(v) as s, sum(v * v) as q, count(*) as n from f group by 1), t as (select sum(s * s / n) - sum(s) * sum(s) / sum(n) as b, sum(q) - sum(s * s / n) as w, count(*) - 1 as df1, (sum(n) - count(*))::bigint as df2 from g) select 'c_acctbal' as feature, {R('(b / df1) / (w / df2)', 'f')}, {R('b / (b + w)', 'eta2')}, df1, df2 from t")
def anova_f_eta2(t):
    return validity.discriminability(t("customer").withColumnRenamed("c_mktsegment", "cluster"), ["c_acctbal"])


@query(f"with {CENTRE}, d as (select vec_id, label as cluster, size, {GAP.format('x', 'm')} as distance from v join c using (label)), z as (select *, case when stddev_pop(distance) over w = 0 then 0 else (distance - avg(distance) over w) / stddev_pop(distance) over w end as z from d window w as (partition by cluster)) select vec_id, cluster, {R('distance', 'distance')}, {R('z', 'z')}, size, z > 2.0 as outlier from z")
def centroid_outliers(t):
    return validity.distance_outliers(vectors(t), "vec_id", 2.0)


TINY = "case when vec_id < 4 then 90 when vec_id < 9 then 91 else label end"


def tiny(t):
    return vectors(t).withColumn("cluster", F.when(F.col("vec_id") < 4, 90).when(F.col("vec_id") < 9, 91).otherwise(F.col("cluster")))


@query(f"select vec_id, cluster, size from (select *, count(*) over (partition by cluster) as size from (select vec_id, ({TINY})::int as cluster from embeddings)) where size <= 6")
def tiny_clusters(t):
    return validity.tiny_members(tiny(t), "vec_id")


@query(
    f"with v as (select vec_id, ({TINY})::int as label, list_transform(embedding, lambda z: z::double) as x from embeddings), l as (select vec_id, label, unnest(range(1, 65)) as d, unnest(x) as v from v), cd as (select label, d, avg(v) as m, count(*) as size from l group by 1, 2), c as (select label, list(m order by d) as m, max(size) as size from cd group by 1), "
    f"p as (select a.label as cluster, a.size, b.label as other, {GAP.format('a.m', 'b.m')} as d from c a join c b on a.label <> b.label), m as (select avg(d) as md from p), n as (select cluster, size, arg_min(other, d) as nearest, min(d) as d from p group by 1, 2) "
    f"select cluster, size, nearest, {R('d / md', 'ratio')}, case when d / md < 0.5 then 'borderline' when d / md > 1.5 then 'outlier' else 'distinct' end as cause from n, m where size <= 6"
)
def tiny_cause(t):
    return validity.tiny_causes(tiny(t))


RUNS = "r as (select run, vec_id as id, (embedding[run + 1] > 0)::int + 2 * (embedding[run + 31] > 0)::int as cluster from embeddings, (select unnest(range(0, 20)) as run) where (vec_id + run) % 5 <> 0)"


def runs(t):
    """Twenty partitions of four fifths of the vectors each, by the signs of two components."""
    ids = t("embeddings").select(F.col("vec_id").alias("id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("run")).where("(id + run) % 5 <> 0")
    sign = lambda at: (F.get("embedding", F.col("run") + at) > 0).cast("int")
    return ids.select("run", "id", (sign(0) + 2 * sign(30)).alias("cluster"))


@query(f"with {RUNS} select a.id as id_a, b.id as id_b, {R('avg((a.cluster = b.cluster)::int)', 'together')}, count(*) as n_runs from r a join r b on a.run = b.run group by 1, 2")
def coclustering_share(t):
    """The whole matrix, both ways round."""
    return validity.coclustering(runs(t), wanted=F.lit(True))


@query(f"with {VEC}, p as (select label as cluster, 'e' || d::varchar as feature, avg(v) as m from l group by 1, 2), g as (select 'e' || d::varchar as feature, avg(v) as gm, stddev_pop(v) as s from l group by 1) select cluster, feature, {R('m', 'mean_value')}, {R('(m - gm) / s', 'z_value')} from p join g using (feature)")
def cluster_profile(t):
    rows = t("embeddings").select(F.col("label").alias("cluster"), *(F.col("embedding")[i].cast("double").alias(f"e{i + 1}") for i in range(DIMS)))
    return validity.profile(rows, [f"e{i + 1}" for i in range(DIMS)])


@query(f"with {VEC}, p as (select label as cluster, 'e' || d::varchar as feature, avg(v) as m from l group by 1, 2) select feature, {R('var_samp(m)', 'var_means')} from p group by 1 order by var_samp(m) desc, feature limit 3")
def telling_features(t):
    rows = t("embeddings").select(F.col("label").alias("cluster"), *(F.col("embedding")[i].cast("double").alias(f"e{i + 1}") for i in range(DIMS)))
    return validity.telling_features(validity.profile(rows, [f"e{i + 1}" for i in range(DIMS)]), 3)


# ---- inference ----

SEGMENTS = "g as (select c_mktsegment as g, count(*) as n, avg(c_acctbal) as m, var_samp(c_acctbal) as v from customer group by 1)"


def segments(t):
    return inference.group_moments(t("customer"), "c_mktsegment", "c_acctbal")


@query(f"with {SEGMENTS}, w as (select *, n / v as w from g), q as (select sum(w) as tw, sum(w * m) / sum(w) as tm, count(*) as k from w), s as (select k, sum(w * (m - tm) ** 2) as s, sum((1 - w / tw) ** 2 / (n - 1)) as t from w, q group by 1) select {R('(s / (k - 1)) / (1 + 2 * (k - 2) / (k * k - 1) * t)', 'f')}, k - 1 as df1, {R('(k * k - 1) / (3 * t)', 'df2')} from s")
def welch_f(t):
    return inference.welch(segments(t), [])


@query(f"with {SEGMENTS}, t as (select sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) as b, sum((n - 1) * v) as w from g) select {R('b / (b + w)', 'eta2')} from t")
def eta_squared(t):
    return inference.eta_squared(segments(t), [])


@query(f"with {SEGMENTS} select a.g as a, b.g as b, {R('a.m - b.m', 'diff')}, {R('abs(a.m - b.m) / sqrt((a.v / a.n + b.v / b.n) / 2)', 'q')}, {R('(a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1))', 'df')} from g a join g b on a.g < b.g")
def games_howell_t(t):
    return inference.games_howell(segments(t), "c_mktsegment", [])


@query(f"with f as (select c_mktsegment as g, unnest([c_acctbal / 1000, c_nationkey]) as v, unnest([1, 2]) as d from customer), c as (select g, d, sum(v) as s, sum(v * v) as q, count(*) as n from f group by 1, 2), e as (select d, sum(s * s / n) - sum(s) * sum(s) / sum(n) as b, sum(q) - sum(s * s / n) as w, sum(n)::bigint as n, count(*) as k from c group by 1) select {R('(sum(b) / (max(k) - 1)) / (sum(w) / (max(n) - max(k)))', 'f')}, max(n) as n, max(k) as k from e")
def pseudo_f(t):
    return inference.pseudo_f(t("customer").select("c_mktsegment", (F.col("c_acctbal") / 1000).alias("a"), F.col("c_nationkey").cast("double").alias("b")), "c_mktsegment", ["a", "b"])


CROSS = "t as (select quality as a, toxic as b from labels), c as (select r.a, q.b, nr, nc, na, count(t.a) as n from (select a, count(*) as nr from t group by 1) r cross join (select b, count(*) as nc from t group by 1) q cross join (select count(*) as na from t) s left join t on t.a = r.a and t.b = q.b group by 1, 2, 3, 4, 5), e as (select *, nr * nc / na::double as x from c)"


@query(f"with {CROSS} select {R('sum((abs(n - x) - least(0.5, abs(n - x))) ** 2 / x)', 'chi2')}, 1::bigint as df, {R('min(x)', 'least_expected')} from e")
def chi2_yates(t):
    return inference.chi_square(inference.contingency(t("labels"), "quality", "toxic"))


@query(f"with g as (select count(*) filter (quality = 1) as n1, sum(toxic) filter (quality = 1) as x1, count(*) filter (quality = 0) as n2, sum(toxic) filter (quality = 0) as x2 from labels), p as (select *, (x1 + x2) / (n1 + n2) as p from g) select {R('(x1 / n1 - x2 / n2) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2))', 'z')} from p")
def two_prop_z(t):
    n = lambda q, x: F.sum(F.when(F.col("quality") == q, x)).cast("double")
    g = t("labels").agg(n(1, F.lit(1)).alias("n1"), n(1, F.col("toxic")).alias("x1"), n(0, F.lit(1)).alias("n2"), n(0, F.col("toxic")).alias("x2"))
    return g.select(inference.two_proportions(*(F.col(c) for c in ("n1", "x1", "n2", "x2"))).alias("z"))


TRAITS = "x as (select c_mktsegment as g, unnest(['balance', 'nation']) as feature, unnest([c_acctbal / 1000, c_nationkey]) as v from customer), g as (select feature, g, count(v) as n, avg(v) as m, var_samp(v) as v from x group by 1, 2)"


@query(
    f"with {TRAITS}, w as (select *, n / v as w from g), q as (select feature, sum(w) as tw, sum(w * m) / sum(w) as tm, count(*) as k from w group by 1), s as (select feature, k, sum(w * (m - tm) ** 2) as s, sum((1 - w / tw) ** 2 / (n - 1)) as t from w join q using (feature) group by 1, 2), "
    "e as (select feature, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) as b, sum((n - 1) * v) as w from g group by 1) "
    f"select feature, {R('(s / (k - 1)) / (1 + 2 * (k - 2) / (k * k - 1) * t)', 'f')}, k - 1 as df1, {R('(k * k - 1) / (3 * t)', 'df2')}, {R('b / (b + w)', 'eta2')} from s join e using (feature)"
)
def trait_statistics(t):
    """Welch's F and eta squared of several traits by one aggregate over their long form."""
    rows = t("customer").select("c_mktsegment", (F.col("c_acctbal") / 1000).alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    moments = inference.group_moments(rank.long_features(rows, ["c_mktsegment"], ["balance", "nation"]), "c_mktsegment", "value", ["feature"])
    return inference.welch(moments, ["feature"]).join(inference.eta_squared(moments, ["feature"]), "feature")


LANGS = "g as (select lang, count(*) as n, count(*) filter (toxic = 0) as x from labels join documents using (doc_id) where toxic is not null and lang is not null group by 1)"


@query(
    f"with {LANGS}, p as (select a.lang as a, b.lang as b, a.n as n1, a.x as x1, b.n as n2, b.x as x2, (a.x + b.x) / (a.n + b.n) as p, least(a.n, b.n) * least(a.x + b.x, a.n + b.n - a.x - b.x) / (a.n + b.n) as least from g a join g b on a.lang < b.lang) "
    f"select a, b, case when least < 5 then 'fisher' else 'z' end as test, {R('case when least >= 5 then (x1 / n1 - x2 / n2) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2)) end', 'z')} from p"
)
def share_pairs(t):
    """Pairs of languages by their share of clean documents, with the test that fits each pair."""
    rows = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id").select("lang", "toxic")
    return inference.binary_tests(rows, "lang", ["toxic"], alpha=1.1)["pairs"].select("a", "b", "test", "z")


@query(f"with x as (select c_mktsegment as g, c_acctbal > 4500 as a, c_nationkey < 12 as b from customer), u as (select g, unnest([a, b])::int as v, unnest([0, 1]) as i from x), c as (select i, g, count(*) as n, sum(v) as x from u group by 1, 2), w as (select *, sum(n) over (partition by i) as big, sum(x) over (partition by i) as hit from c) select {R('sum((x - n * hit / big) ** 2 / (n * hit / big) + (x - n * hit / big) ** 2 / (n * (1 - hit / big)))', 'chi2')} from w")
def summed_chi2(t):
    rows = t("customer").select("c_mktsegment", (F.col("c_acctbal") > 4500).cast("double").alias("a"), (F.col("c_nationkey") < 12).cast("double").alias("b"))
    return inference.summed_chi2(rows, "c_mktsegment", ["a", "b"])


BEATS = f"{GAPS}, i as (select user_id as subject, ts, event_id, 600 + rr % 500 as rr from g where rr is not null), c as (select *, sum(rr) over (partition by subject order by ts, event_id rows unbounded preceding) / 1000 as t_sec from i), m as (select *, floor(t_sec / 60)::int + 1 as minute from c where rr between 300 and 2000 and t_sec < 1200)"


@query(
    f"with {BEATS}, d as (select *, rr - lag(rr) over (partition by subject, minute order by t_sec) as d from m), a as (select subject, minute, count(*) as n, avg(rr) as mrr, stddev_pop(rr) as sd, sqrt(avg(d * d)) as rm from d group by 1, 2) "
    f"select subject, u.minute, coalesce(a.n, 0) as n, {R('case when n >= 5 then 60000 / mrr end', 'hr')}, {R('case when n >= 5 then sd end', 'sdnn')}, {R('case when n >= 5 then rm end', 'rmssd')} from (select distinct subject, unnest(range(1, 21))::int as minute from c) u left join a using (subject, minute)"
)
def heart_minute_grid(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rr = gaps(t).where("rr is not null").withColumn("rr", 600 + F.col("rr") % 500).withColumn("t_sec", F.sum("rr").over(w) / 1000)
    got = signal.heart_minutes(rr.select(F.col("user_id").alias("subject"), "t_sec", "rr"), ["subject"])
    return got.select("subject", "minute", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "hr", "sdnn", "rmssd")


@query("select count(*) as n, sum(l_orderkey)::bigint as id, " + R("avg(l_quantity)", "mean_time_min") + " from lineitem")
def normalised_names(t):
    """Names made regular, canonical ones given, columns found whatever their case."""
    odd = t("lineitem").select(F.col("l_orderkey").alias(" No"), F.col("l_quantity").alias("Time (min)"))
    rows = C.normal_names(odd)
    at = C.find_column(rows, "TIME_MIN")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id"), F.avg(at).alias(f"mean_{at}"))


@query(f"with {M}, w as (select user_id, event_type, minute, avg(value) as v from m where minute in (1, 5, 10) group by 1, 2, 3) select user_id, event_type, {R('avg(v)', 'mean_ev')} from w group by 1, 2")
def prefix_row_mean(t):
    wide = phase.pivot_minutes(minutes(t("events")).where("minute in (1, 5, 10)"), ["user_id", "event_type"], (1, 5, 10), "ev")
    return wide.select("user_id", "event_type", C.row_mean(*(F.col(c) for c in C.minute_columns(wide, "ev").values())).alias("mean_ev"))


@query("select c_custkey as id, count(*) as n_rows from (select c_custkey, unnest([c_acctbal::varchar, 'n/a', '—']) as v from customer) where try_cast(v as double) is not null group by 1")
def numbers_only(t):
    """Rows whose value is a number, as ids are kept."""
    rows = t("customer").select("c_custkey", F.explode(F.array(F.col("c_acctbal").cast("string"), F.lit("n/a"), F.lit("—"))).alias("v"))
    return rows.where(C.number(F.col("v")).isNotNull()).groupBy(F.col("c_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("select unnest(['c_acctbal', 'c_nationkey']) as feature, unnest([count(c_acctbal), count(c_nationkey)]) as n_known from customer")
def informative_columns(t):
    """Columns with several values in enough rows; constant and empty ones are dropped."""
    rows = t("customer").select("c_acctbal", "c_nationkey", F.lit(1.0).alias("same"), F.lit(None).cast("double").alias("none"))
    kept = scale.informative(rows, rows.columns)
    return rank.long_features(rows, [], kept).groupBy("feature").agg(F.count("value").alias("n_known"))


@query(f"with {SUPPLIER} select count(*) as n from x where d is not null and q is not null")
def listwise_rows(t):
    return supplier(t).dropna(subset=["d", "q"]).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {VEC}, p as (select a.vec_id as id_a, b.vec_id as id_b, {GAP.format('a.x', 'b.x')} as d from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id) select id_a, id_b, {R('d', 'distance')} from p")
def distances_of_some(t):
    """The rows asked for against all others."""
    return validity.distances(vectors(t), "vec_id", F.col("vec_id") % 100 == 0)


@query("with b as (select unnest(['static', 'dynamic', 'other']) as phase, unnest([10, 20, 31]) as upto, unnest([1, 11, 21]) as low) select phase, count(*) as n from events join b on dayofmonth(ts) between low and upto group by 1")
def block_lookup(t):
    """Rows matched with a small table of blocks."""
    m = minutes(t("events")).select(F.coalesce(C.minute_phase(F.col("minute")), F.lit("other")).alias("phase"))
    known = m.sparkSession.createDataFrame([("static",), ("dynamic",), ("other",)], "phase string")
    return m.join(known, "phase").groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


BLOCKS = {"QUANTITY": ["q", "e"], "RATE": ["d", "t"]}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reactivity of every subject with its number of environments, imputed and block-scaled."""
    got = phase.reactivity(minutes(table(spark, sf_dir, "events")), "user_id", "event_type", C.minute_phase(F.col("minute")))
    got = got.withColumn("n_env", F.col("n_env").cast("double"))
    return scale.block_standardise(scale.impute(got, ["reactivity_sd", "n_env"]), {"R": ["reactivity_sd", "n_env"]})


# ---- beyond SQL: fitted models, recordings, streams ----


def supplier_matrix(t) -> DataFrame:
    return order.cut(scale.standardise(scale.impute(order.cut(supplier(t)), list(NAMES)), list(NAMES)))


@query()
def kmeans_partition(t):
    s = cluster.kmeans(supplier_matrix(t), "l_suppkey", list(NAMES), 3)
    return s.labels.withColumn("inertia", F.lit(s.objective))


@query()
def ward_partition(t):
    return cluster.ward(supplier_matrix(t), "l_suppkey", list(NAMES), 3).labels


@query()
def gmm_diag_partition(t):
    s = cluster.gmm(supplier_matrix(t), "l_suppkey", list(NAMES), 2, "diag")
    return s.labels.withColumns({"bic": F.lit(s.extra["bic"]), "aic": F.lit(s.extra["aic"])})


@query()
def gmm_grid_best(t):
    x = supplier_matrix(t)
    rows = [(s.extra["kind"], s.k, s.extra["bic"], s.extra["aic"]) for s in cluster.gmm_grid(x, "l_suppkey", list(NAMES))]
    return x.sparkSession.createDataFrame(rows, "kind string, k int, bic double, aic double")


@query()
def component_scores(t):
    x = supplier(t).dropna()
    c = linear.components(x, list(NAMES))
    return linear.scores(x, list(NAMES), c["vectors"][:, :2], c["mean"], c["sd"]).select("l_suppkey", "pc1", "pc2")


@query()
def block_validity(t):
    x = supplier(t)
    v = linear.validity(x, list(NAMES))
    return x.sparkSession.createDataFrame([(v["n"], v["kmo"], v["bartlett_p"], v["mean_abs_r"], v["valid"])], "n long, kmo double, bartlett_p double, mean_abs_r double, valid boolean")


@query()
def polychoric_pair(t):
    rows = t("part").select(F.least(F.floor(F.col("p_size") / 13), F.lit(3)).alias("a"), F.floor(F.col("p_retailprice") / 300).alias("b"))
    return rows.agg(F.count("*").alias("n")).withColumn("rho", F.lit(linear.polychoric(rows, "a", "b")))


ORDERED, CONTINUOUS = ["qty_level", "l_linenumber"], ["l_extendedprice", "l_discount"]
_LEVELLED = "select least(floor(l_quantity / 10), 4)::double as qty_level, l_linenumber::double as l_linenumber, l_extendedprice::double / 1000 as l_extendedprice, l_discount::double as l_discount from lineitem"
_LEVEL_PAIRS = " union all ".join(f"select '{a}' as a, '{b}' as b, {a} as x, {b} as y from l" for a in ORDERED for b in CONTINUOUS)
_LEVEL_SUMS = f"l as ({_LEVELLED}), v as ({_LEVEL_PAIRS}), s as (select a, b, x, count(*) as n, sum(y) as t, sum(y * y) as q from v where x is not null and y is not null group by a, b, x)"


def levelled(t):
    return t("lineitem").select(F.least(F.floor(F.col("l_quantity") / 10), F.lit(4)).alias("qty_level"), "l_linenumber", (F.col("l_extendedprice") / 1000).alias("l_extendedprice"), "l_discount")


@query(f"with {_LEVEL_SUMS} select a, b, x as level, n, {R('t / n', 'mean')}, {R('q / n', 'mean_square')} from s")
def polyserial_moments(t):
    got = mixed.level_moments(levelled(t), ORDERED, CONTINUOUS)
    return got.select("a", "b", "level", "n", (F.col("total") / F.col("n")).alias("mean"), (F.col("squares") / F.col("n")).alias("mean_square"))


@query(f"""with {_LEVEL_SUMS}, o as (select *, row_number() over (partition by a, b order by x) as p, sum(n) over (partition by a, b order by x) / sum(n) over (partition by a, b) as share from s),
    u as (select *, case when share < 1 then list_reduce(list_prepend(0.0::double, list_transform(range(40), lambda i: i::double)),
        lambda z, i: z - (0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(60), lambda k: pow(z, 2 * k + 1) * sqrt(pi()) / (pow(2, k + 1) * gamma(k + 1.5)))) - share) / (exp(-z * z / 2) / sqrt(2 * pi()))) end as cut from o),
    m as (select a, b, sum(n) as n, sum(t) / sum(n) as mean, sum(q) / sum(n) - pow(sum(t) / sum(n), 2) as var, sum(n * p) / sum(n) as mid, sum(p * t) / sum(n) as joint, sum(exp(-cut * cut / 2) / sqrt(2 * pi())) as dens from u group by a, b)
    select a, b, 'polyserial' as kind, {R('(joint - mid * mean) / sqrt(var) / dens', 'r')}, n::bigint as n from m""")
def polyserial_pairs(t):
    rows = levelled(t)
    return rows.sparkSession.createDataFrame(mixed.polyserial_long(rows, ORDERED, CONTINUOUS), "a string, b string, kind string, r double, n long")


@query()
def mixed_matrix(t):
    rows, names = levelled(t), [*ORDERED, *CONTINUOUS]
    r = mixed.mixed_matrix(rows, ORDERED, CONTINUOUS, likelihood=True)
    return rows.sparkSession.createDataFrame([(a, b, float(r[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)], "row string, col string, r double")


LEVEL_STUDIES = [("person", "F0"), ("person", "F1"), ("person", "F3"), ("person", "F5"), ("scenario_all", "all"), ("scenario_static", "all"), ("scenario_dynamic", "F2")]


def level_tables(t):
    """Subjects are users; the hour names a signal, the day of the month a segment of a pair of environments."""
    e = t("events").where("value is not null and user_id is not null")
    segment = F.substring(F.lit("ABCDEFGH"), (F.dayofmonth("ts") % 8 + 1).cast("int"), F.lit(1))
    name = F.concat(F.element_at(F.array(*map(F.lit, ("st_", "HR_", "eda_"))), (F.hour("ts") % 3 + 1).cast("int")), "event_type")
    e = e.select(F.col("user_id").alias("id"), segment.alias("segment"), name.alias("feature"), "event_type", "value").withColumns({"pair": C.condition(F.col("segment")), "phase": C.segment_phase(F.col("segment"))})
    return e.select("id", F.col("pair").alias("env"), "feature", "value"), e.select("id", F.col("segment").alias("env"), F.col("event_type").alias("feature"), "value"), e.select("id", "segment", "pair", "phase", "feature", "value")


@query("""with e as (select user_id::varchar as id, substr('ABCDEFGH', dayofmonth(ts) % 8 + 1, 1) as seg, case hour(ts) % 3 when 0 then 'st_' when 1 then 'HR_' else 'eda_' end || event_type as feature, event_type, value from events where value is not null and user_id is not null),
    g as (select *, case when seg in ('A', 'B') then 'AB' when seg in ('C', 'D') then 'CD' when seg in ('E', 'F') then 'EF' else 'GH' end as pair, case when seg in ('A', 'C', 'E', 'G') then 'static' else 'dynamic' end as phase from e),
    s as (select id, feature, avg(value) as value from g group by 1, 2),
    v as (select id, pair, event_type as f, avg(value) filter (phase = 'static') as a, avg(value) filter (phase = 'dynamic') as b from g group by 1, 2, 3),
    d as (select id, f || '_delta_dynamic_minus_static' as feature, avg(b - a) as value from v group by 1, 2 having avg(b - a) is not null),
    c as (select concat_ws('|', id, seg, pair, phase) as id, phase, feature, avg(value) as value from g group by 1, 2, 3),
    u as (select 0 as study, id, feature, value from s union all select 1, id, feature, value from s union all select 2, id, feature, value from s where feature like 'HR\\_%' escape '\\'
          union all select 3, id, feature, value from s union all select 3, id, feature, value from d union all select 4, id, feature, value from c
          union all select 5, id, feature, value from c where phase = 'static' union all select 6, id, feature, value from c where phase = 'dynamic' and feature like 'st\\_%' escape '\\')
    select study, count(*) as n, count(distinct id) as n_rows, count(distinct feature) as n_features, round(sum(value), 4) + 0.0 as total from u group by study""")
def level_rows(t):
    rows = levels.study_rows(*level_tables(t), LEVEL_STUDIES)
    return rows.groupBy("study").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_rows"), F.count_distinct("feature").alias("n_features"), F.round(F.sum("value"), 4).alias("total"))


@query()
def level_metrics(t):
    studies = [("person", "F3"), ("scenario_dynamic", "F2")]
    grid = levels.Grid(ks=(2, 3), kinds=("diag",), components=3, n_init=2, restarts=3, rounds=100)
    return levels.run_levels(levels.study_rows(*level_tables(t), studies), studies, grid, only_metrics=True)["metrics"]


@query()
def subsample_agreement(t):
    x = supplier_matrix(t)
    picks = validity.subsamples(x, "l_suppkey", 100, 0.8)
    runs = cluster.ward_runs(x.join(picks, "l_suppkey"), "l_suppkey", list(NAMES), 2).withColumnRenamed("l_suppkey", "id")
    return validity.spread(validity.run_agreement(order.cut(runs), "id"))


@query()
def permutation_profile(t):
    rows = t("customer").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") / 1000).alias("a"), F.col("c_nationkey").cast("double").alias("b"))
    got = inference.permutation_profile(rows, "c_custkey", "c_mktsegment", ["a", "b"], 5000)
    return rows.agg(F.count("*").alias("n")).withColumns({"f": F.lit(got["f"]), "p": F.lit(got["p"])})


@query()
def trait_tests(t):
    rows = t("customer").select("c_mktsegment", (F.col("c_acctbal") / 1000).alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    return inference.trait_tests(rows, "c_mktsegment", ["balance", "nation"])[0]


@query()
def pairwise_shares(t):
    rows = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id")
    got = inference.pairwise_shares(rows, "lang", "toxic")
    return rows.sparkSession.createDataFrame([(g["a"], g["b"], g["test"], g["p"]) for g in got], "a string, b string, test string, p double")


@query(
    "with x as (select l_quantity as a, l_discount as b, l_extendedprice / 1000 as y from lineitem), m as (select count(*) as n, avg(a) as ma, avg(b) as mb, avg(y) as my, var_pop(a) as saa, var_pop(b) as sbb, covar_pop(a, b) as sab, covar_pop(a, y) as say, covar_pop(b, y) as sby, var_pop(y) as syy from x), "
    "s as (select *, saa * sbb - sab * sab as det from m), c as (select *, (sbb * say - sab * sby) / det as ca, (saa * sby - sab * say) / det as cb from s), r as (select *, n * (syy - ca * say - cb * sby) as rest from c), v as (select *, rest / (n - 3) as v, 1 - rest / (n * syy) as r2 from r), "
    "o as (select 'intercept' as term, my - ca * ma - cb * mb as coef, sqrt(v / n * (1 + (ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / det)) as se, r2, n from v union all select 'l_quantity', ca, sqrt(v / n * sbb / det), r2, n from v union all select 'l_discount', cb, sqrt(v / n * saa / det), r2, n from v) "
    f"select term, {R('coef', 'coef')}, {R('se', 'se')}, {R('r2', 'r2')}, {R('1 - (1 - r2) * (n - 1) / (n - 3)', 'adj_r2')} from o"
)
def least_squares(t):
    rows = t("lineitem").select("l_quantity", "l_discount", (F.col("l_extendedprice") / 1000).alias("price"))
    g = linear.least_squares(rows, "price", ["l_quantity", "l_discount"])
    return rows.sparkSession.createDataFrame([(n, float(c), float(e), float(g["r2"]), float(g["adj_r2"])) for n, c, e in zip(g["names"], g["coef"], g["se"])], "term string, coef double, se double, r2 double, adj_r2 double")


@query()
def random_intercept(t):
    m = minutes(t("events")).withColumn("minute", F.col("minute").cast("double"))
    g = linear.random_intercept(m, "value", ["minute"], "user_id")
    return m.sparkSession.createDataFrame([(n, float(c), float(s), float(g["var_group"]), float(g["var_residual"])) for n, c, s in zip(g["names"], g["coef"], g["se"])], "term string, coef double, se double, var_group double, var_residual double")


@query()
def logistic_gee(t):
    m = minutes(t("events")).select("user_id", (F.col("minute") / 31).alias("minute"), (F.col("value") > 50).cast("double").alias("high"))
    g = inference.odds_table(linear.logistic_gee(m, "high", ["minute"], "user_id"))
    return m.sparkSession.createDataFrame([(r["term"], r["odds"], r["low"], r["high"], r["note"]) for r in g], "term string, odds double, low double, high double, note string")


SEGMENT_S = 600  # a recording is ten minutes of a subject, so its length is bounded by the sampling rate
RECORDING = ["subject", "segment"]


def recordings(t) -> DataFrame:
    """Values of a subject in order of time, taken as samples at 4 Hz, in segments of ten minutes."""
    placed = order.places_in_group(t("events").where("user_id is not null").select(F.col("user_id").alias("subject"), "ts", "event_id", "value"), ["subject"], ["ts", "event_id"])
    rows = placed.select("subject", ((F.col("place") - 1) / 4).alias("t_sec"), "value")
    return rows.withColumn("segment", F.floor(F.col("t_sec") / SEGMENT_S))


@query()
def signal_quality(t):
    return signal.quality(recordings(t), RECORDING)


@query()
def skin_measures(t):
    return signal.skin_measures(signal.skin_parts(recordings(t), RECORDING, 4.0), RECORDING, last=float("inf"))


@query()
def interval_spectrum(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rr = gaps(t).where("rr is not null").withColumn("rr", 600 + F.col("rr") % 500).withColumn("t_sec", F.sum("rr").over(w) / 1000)
    rr = rr.select(F.col("user_id").alias("subject"), F.floor(F.col("t_sec") / SEGMENT_S).alias("segment"), "t_sec", "rr")
    return signal.heart_spectrum(rr, RECORDING)


@query()
def fourier_resample(t):
    return signal.resampled(recordings(t), RECORDING, 1.0)


QUERIES["flagship"] = lambda spark, sf_dir: rounded(flagship(spark, sf_dir))
ORACLES["flagship"] = (
    f"with {M}, d as (select user_id, event_type, avg(value) filter (minute between 11 and 20) - avg(value) filter (minute between 1 and 10) as delta from m where user_id is not null and event_type is not null group by 1, 2), "
    "r as (select user_id, stddev_samp(delta) as s, count(delta)::double as n from d group by 1), i as (select user_id, coalesce(s, (select avg(s) from r)) as s, n from r), p as (select *, avg(s) over () as ms, stddev_pop(s) over () as ss, avg(n) over () as mn, stddev_pop(n) over () as sn from i) "
    f"select user_id, {R('case when ss > 0 then (s - ms) / (ss * sqrt(2)) else 0 end', 'reactivity_sd')}, {R('case when sn > 0 then (n - mn) / (sn * sqrt(2)) else 0 end', 'n_env')} from p"
)


# ---- encoders, components and tables of results, each beside its SQL ----


@query("""with c as (select c_custkey, case c_custkey % 7 when 0 then ' M ' when 1 then 'f' when 2 then '남' when 3 then '여자' when 4 then '1' when 5 then 'Female' else c_mktsegment end as told from customer)
    select c_custkey, case lower(trim(told)) when 'm' then 1 when '남' then 1 when '1' then 1 when 'f' then 0 when '여자' then 0 when 'female' then 0 end as sex from c""")
def sex_codes(t):
    told = F.when(F.col("c_custkey") % 7 < 6, F.try_element_at(F.array(*map(F.lit, (" M ", "f", "남", "여자", "1", "Female"))), (F.col("c_custkey") % 7 + 1).cast("int"))).otherwise(F.col("c_mktsegment"))
    return t("customer").select("c_custkey", C.sex(told).cast("int").alias("sex"))


@query(f"with {SUPPLIER} select l_suppkey, case when q is null then null else least(greatest(q, 24), 26) end as q, case when d is not null then greatest(d, 0.05) end as d from (select l_suppkey, {R('q', 'q')}, {R('d', 'd')} from x)")
def clipped_values(t):
    x = rounded(supplier(t))
    return x.select("l_suppkey", C.clipped(F.col("q"), 24, 26).alias("q"), C.clipped(F.col("d"), low=0.05).alias("d"))


@query(f"with {SUPPLIER} select l_suppkey, {R('(d - avg(d) over ()) / stddev_pop(d) over ()', 'd')} from x")
def z_population(t):
    return scale.standardise(supplier(t), ["d"]).select("l_suppkey", "d")


_THREE = "x as (select l_quantity::double as a, l_extendedprice::double as b, l_quantity * l_discount as c from lineitem), r as (select corr(a, b) as r, corr(a, c) as s, corr(b, c) as u, count(*) as n from x), p as (select *, (r - s * u) / sqrt((1 - s * s) * (1 - u * u)) as pr, (s - r * u) / sqrt((1 - r * r) * (1 - u * u)) as ps, (u - r * s) / sqrt((1 - r * r) * (1 - s * s)) as pu, 1 + 2 * r * s * u - r * r - s * s - u * u as det from r)"


@query(f"with {_THREE} select n, {R('(r * r + s * s + u * u) / (r * r + s * s + u * u + pr * pr + ps * ps + pu * pu)', 'kmo')}, {R('-(n - 1 - 11 / 6.0) * ln(det)', 'chi2')}, 3.0::double as df from p")
def kmo_bartlett(t):
    rows = t("lineitem").select(F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"), (F.col("l_quantity") * F.col("l_discount")).alias("c"))
    n, _, cov = linear.moments(rows, ["a", "b", "c"])
    corr = linear.correlation(cov)
    chi2, df, _ = linear.bartlett(corr, n)
    return rows.sparkSession.createDataFrame([(n, linear.kmo(corr)[0], chi2, float(df))], "n long, kmo double, chi2 double, df double")


# Of two columns the components are known: (z1 + z2) / sqrt 2 and their difference, with eigenvalues 1 + r and 1 - r.
@query(f"""with x as (select l_orderkey, l_linenumber, l_quantity::double as a, l_quantity * l_tax as b from lineitem), m as (select avg(a) as ma, stddev_pop(a) as sa, avg(b) as mb, stddev_pop(b) as sb, corr(a, b) as r from x),
    e as (select l_orderkey, l_linenumber, (a - ma) / sa as z, (b - mb) / sb as w, r from x, m)
    select l_orderkey, l_linenumber, {R('abs((z + w) / sqrt(2.0)) * case when abs(z + w) < 5e-7 then 0 else 1 end', 'pc1')}, {R('abs((z - w) / sqrt(2.0)) * case when abs(z - w) < 5e-7 then 0 else 1 end', 'pc2')}, {R('1 + r', 'value1')}, {R('(1 + r) / 2', 'share1')}, case when (1 + r) / 2 >= 0.9 then 1 else 2 end as enough_90 from e""")
def two_components(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("a"), (F.col("l_quantity") * F.col("l_tax")).alias("b"))
    c = linear.components(rows, ["a", "b"])
    scored = linear.scores(rows, ["a", "b"], c["vectors"], c["mean"], c["sd"])
    return scored.select("l_orderkey", "l_linenumber", F.abs("pc1").alias("pc1"), F.abs("pc2").alias("pc2"), F.lit(float(c["values"][0])).alias("value1"), F.lit(float(c["share"][0])).alias("share1"), F.lit(linear.enough(c["cumulative"], 0.9)).alias("enough_90"))


_RANKS = ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}" for c in ("q", "e", "t"))


@query(f"with {SUPPLIER}, k as (select {_RANKS} from x) select 'e' as b, 'q' as a, {R('corr(q, e)', 'rho')}, count(*) as n from k union all select 't', 'q', {R('corr(q, t)', 'rho')}, count(*) from k union all select 't', 'e', {R('corr(e, t)', 'rho')}, count(*) from k")
def spearman_pairs(t):
    return linear.spearman_matrix(order.cut(supplier(t)), "l_suppkey", ["q", "e", "t"]).drop("p")


# Distances of the suppliers of the first three keys, in the order of (label, key) as a heat map wants them.
@query(f"""with {SUPPLIER}, l as (select l_suppkey as id, (l_suppkey % 3)::int as cluster, q, e / 1000 as e from x), o as (select *, row_number() over (order by cluster, id) as p from l)
    select a.p as "row", b.p as col, a.cluster as cluster_a, b.cluster as cluster_b, {R('sqrt(pow(a.q - b.q, 2) + pow(a.e - b.e, 2))', 'distance')} from o a join o b on a.id <> b.id where a.id % 100 = 0""")
def label_ordered_distances(t):
    x = order.cut(supplier(t).select(F.col("l_suppkey").alias("id"), (F.col("l_suppkey") % 3).cast("int").alias("cluster"), F.array("q", F.col("e") / 1000).alias("x")))
    pairs = validity.distances(x, "id", F.col("id") % 100 == 0)
    return validity.label_ordered(pairs, x.select("id", "cluster"), "distance")


@query(f"""with c as (select l_returnflag || '_k' || l_linenumber as key, count(distinct l_suppkey) as min_size, corr(l_quantity, l_tax) + 0.6 as ari from lineitem group by 1), m as (select *, min_size >= 40 and (ari is null or ari >= 0.6) as usable from c)
    select key, min_size, {R('ari', 'ari')}, usable from m where usable or not (select max(usable) from m)""")
def usable_candidates(t):
    c = t("lineitem").groupBy(F.concat_ws("_k", "l_returnflag", F.col("l_linenumber").cast("string")).alias("key")).agg(F.count_distinct("l_suppkey").alias("min_size"), (F.corr("l_quantity", "l_tax") + 0.6).alias("ari"))
    return validity.usable(c, 40, 0.6)


@query(f"""with {SUPPLIER}, p as (select l_suppkey % 4 as cluster, avg(q) as q, avg(e) as e, avg(t) as t from x group by 1), g as (select avg(q) as mq, stddev_pop(q) as sq, avg(e) as me, stddev_pop(e) as se, avg(t) as mt, stddev_pop(t) as st from x),
    z as (select cluster, unnest([{{'f': 'e', 'z': (e - me) / se}}, {{'f': 'q', 'z': (q - mq) / sq}}, {{'f': 't', 'z': (t - mt) / st}}]) as v from p, g),
    r as (select cluster, v.f || ' (' || format('{{:+.2f}}', v.z) || ')' as w, row_number() over (partition by cluster order by v.z desc, v.f) as up, row_number() over (partition by cluster order by v.z, v.f) as down from z)
    select cluster, 'high: ' || string_agg(w, ', ' order by up) filter (where up <= 2) || '; low: ' || string_agg(w, ', ' order by down) filter (where down <= 2) as text from r group by cluster""")
def cluster_words(t):
    x = supplier(t).withColumn("cluster", F.col("l_suppkey") % 4)
    return validity.interpretation(validity.profile(order.cut(x), ["q", "e", "t"]), 2)


@query(r"""with k as (select distinct lower(split_part(p_brand, '#', 1)) || '_k' || p_size || case when p_size % 2 = 0 then '_diag' else '' end as key from part)
    select key, regexp_extract(key, '^([a-z]+)_k', 1) as model, try_cast(regexp_extract(key, '_k([0-9]+)', 1) as int) as k, case when ends_with(key, '_diag') then 'diag' end as kind from k""")
def partition_names(t):
    key = F.concat(F.lower(F.split("p_brand", "#")[0]), F.lit("_k"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "_diag").otherwise(""))
    return recordings_source.label_sets(t("part").select(key.alias("key")))
