"""The registered queries as SQL, written independently of the operators."""

from __future__ import annotations

APP = """
app as (
  select o_orderkey, o_orderdate, o_totalprice, o_orderpriority, c_mktsegment, n_regionkey, c_acctbal,
         case when o_orderkey % 10 = 3 then -99.0 else c_acctbal end as acct_s,
         strftime(o_orderdate, '%Y-%m') as month,
         cast((o_totalprice > 250000) <> (o_orderkey % 5 = 0) as int) as y
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""

SCORE = APP + """,
score as (select *, least(floor(o_totalprice / 60) / 10000, 0.9999) as score from app)"""

LINE = """
line as (select *, cast(l_returnflag = 'R' as int) as y from lineitem)"""

EVT = """
evt as (
  select event_id, user_id, event_type, ts,
         case when event_id % 7 <> 0 then value end as value,
         case when event_id % 50 = 0 then value end as rare,
         'same' as single,
         regexp_extract(props, '[0-9]+') as k,
         strftime(ts, '%Y-%m-%d') as day
  from events)"""


def long(source: str, cols: list[str], kind: str = "double", keep: str = "", where: str = "true") -> str:
    """CTE ``long``: one row per cell."""
    parts = [
        f"select '{c}' as var_name, cast({c} as {kind}) as value{keep} from {source} where {c} is not null and {where}"
        for c in cols
    ]
    return "long as (\n  " + "\n  union all ".join(parts) + ")"


def cuts(k: str, source: str = "long", where: str = "true", name: str = "cuts") -> str:
    """CTE: distinct values at the positions floor(i * (n / k))."""
    return f"""{name}_sorted as (
  select var_name, value, row_number() over (partition by var_name order by value) - 1 as rn,
         count(*) over (partition by var_name) as n
  from {source} where {where}),
{name} as (
  select distinct s.var_name, s.value as cut, n
  from {name}_sorted s join range(1, 200) i(i) on i.i < {k}
   and s.rn = cast(floor(i.i * (n / cast({k} as double))) as bigint))"""


def bins(closed: str, special: bool = True, cut_name: str = "cuts", source: str = "long", name: str = "bins") -> str:
    """CTE: rows to bins; -1 is the special value."""
    op = "<=" if closed == "left" else "<"
    number = f"(select count(*) from {cut_name} c where c.var_name = l.var_name and c.cut {op} l.value)"
    if special:
        number = f"case when l.value = -99 then -1 else {number} end"
    return f"""{name}_rows as (select l.var_name, y, {number} as bin_no from {source} l),
{name}_counts as (
  select var_name, cast(bin_no as int) as bin_no, count(*) as total, cast(sum(y) as bigint) as bad
  from {name}_rows group by all),
{name}_ranked as (
  select var_name, cut, row_number() over (partition by var_name order by cut) - 1 as idx from {cut_name}),
{name} as (
  select b.var_name, bin_no, lo.cut as lo, case when bin_no >= 0 then hi.cut end as hi, total, bad
  from {name}_counts b
  left join {name}_ranked lo on lo.var_name = b.var_name and lo.idx = bin_no - 1
  left join {name}_ranked hi on hi.var_name = b.var_name and hi.idx = bin_no)"""


def counts(source: str = "long", name: str = "counts") -> str:
    return f"""{name} as (
  select var_name, value as bin, count(*) as total, cast(sum(y) as bigint) as bad from {source} group by all)"""


def woe(source: str = "counts", name: str = "woe", key: str = "bin") -> str:
    """CTE: WOE table of a count table."""
    return f"""{name}_shares as (
  select *, total - bad as good, bad / total as bad_rate,
         bad / sum(bad) over v as bad_pcnt, (total - bad) / sum(total - bad) over v as good_pcnt
  from {source} window v as (partition by var_name)),
{name}_logs as (
  select *, case when bad = 0 then cast('-Infinity' as double) when good = 0 then cast('Infinity' as double)
                 else ln(bad_pcnt / good_pcnt) end as lg
  from {name}_shares),
{name} as (
  select var_name, {key}, total, bad, good, bad_rate, bad_pcnt, good_pcnt,
         case when isinf(lg) then lg else round(lg, 4) end as woe,
         sum((bad_pcnt - good_pcnt) * lg) over v as iv, count(*) over v as "groups",
         case when count(*) over v < 2 then 'single_group'
              when bool_or(bad = 0 or good = 0) over v then 'zero_cell' else 'ok' end as status
  from {name}_logs window v as (partition by var_name))"""


def screen(source: str = "woe", min_iv: float = 0.02, name: str = "screen") -> str:
    return f"""{name} as (
  select var_name, case when status <> 'single_group' then iv end as iv, "groups", status,
         status <> 'single_group' and iv > {min_iv} as selected
  from (select distinct var_name, first(iv) over (partition by var_name) as iv, "groups", status from {source}))"""


def r6(expr: str, name: str | None = None) -> str:
    name = name or expr
    return f"case when isinf({expr}) then {expr} else round({expr}, 6) end as {name}"


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(c.strip() for c in ctes) + "\n"


APP_BINS = ["o_totalprice", "acct_s"]


def binned(k: int = 5) -> list[str]:
    """CTE ``binned``: applications with left-closed bins of price and
    balance."""
    return [
        APP,
        "base as (select 'o_totalprice' as var_name, o_totalprice as value from app"
        " union all select 'acct_s', acct_s from app where acct_s <> -99)",
        cuts(str(k), "base"),
        """binned as (
  select *, cast((select count(*) from cuts c where c.var_name = 'o_totalprice' and c.cut <= o_totalprice) as int)
              as o_totalprice_Bin,
         cast(case when acct_s = -99 then -1
              else (select count(*) from cuts c where c.var_name = 'acct_s' and c.cut <= acct_s) end as int)
              as acct_s_Bin
  from app)""",
    ]


ENCODED = ["o_totalprice_Bin", "acct_s_Bin", "o_orderpriority", "c_mktsegment", "n_regionkey"]


def encoded() -> list[str]:
    """CTE ``encoded``: applications with the WOE of every variable."""
    picks = ", ".join(f"w{i}.woe as {c}_woe" for i, c in enumerate(ENCODED))
    joins = " ".join(
        f"join woe w{i} on w{i}.var_name = '{c}' and w{i}.bin = cast(b.{c} as varchar)" for i, c in enumerate(ENCODED)
    )
    return [
        *binned(),
        long("binned", ENCODED, "varchar", ", y"),
        counts(),
        woe(),
        f"encoded as (select o_orderkey, y, {picks} from binned b {joins})",
    ]


# -- curves ---------------------------------------------------------------------


def curve(source: str, by: str = "", name: str = "curve") -> str:
    """CTE: cumulative counts by ascending score."""
    part = f"partition by {by} " if by else ""
    key = f"{by}, " if by else ""
    return f"""{name} as (
  select *, cast(sum(total) over w as double) as ct, cast(sum(bad) over w as double) as cb,
         cast(sum(total) over ({part}) as double) as n, cast(sum(bad) over ({part}) as double) as b
  from (select {key}score, count(*) as total, sum(y) as bad from {source} group by all)
  window w as ({part}order by score rows unbounded preceding))"""


KS_ABS = "max(abs(cb / b - (ct - cb) / (n - b)))"
# null for a group without bads or goods
KS = "case when min(b * (n - b)) > 0 then greatest(0, max((ct - cb - (total - bad)) / (n - b) - (cb - bad) / b)) end"
AREA = "sum(bad * (ct - cb - (total - bad) / 2.0)) / nullif(any_value(b * (n - b)), 0)"
AUC = f"case when {AREA} < 0.5 then 1 - {AREA} else {AREA} end"


def gains(source: str) -> str:
    """Final select of a gains table from rows (band, score, y)."""
    return f"""
select cast(band as int) as band, round((mx + mn) / 2, 6) as mean_score, round(mn, 6) as min_score,
       round(mx, 6) as max_score, customers, bad, round(bad / customers, 6) as bad_rate,
       round(sum(bad) over u / sum(bad) over () - sum(customers - bad) over u / sum(customers - bad) over (), 6) as ks,
       round(bad / customers / (sum(bad) over () / sum(customers) over ()), 6) as gain_index,
       round(sum(bad) over u / sum(bad) over (), 6) as cum_recall
from (select band, max(score) as mx, min(score) as mn, count(*) as customers, cast(sum(y) as bigint) as bad
      from {source} group by band)
window u as (order by band rows unbounded preceding)"""


def rank_bands(source: str, part: int, name: str, tie: str = "o_orderkey") -> str:
    """CTE: rows in equal rank bands, best first."""
    return f"""{name} as (
  select score, y, 1 + (select count(*) from range(1, {part}) i(i)
                        where round_even(i.i * (n / {part}.0), 0) <= pos) as band
  from (select score, y, row_number() over (order by score desc, {tie}) - 1 as pos,
               cast(count(*) over () as double) as n from {source}))"""


MINS = """mins as (
  select case when band = max(band) over () then 0.0 else round(min(score), 5) end as m from ranked group by band)"""

FIXED = """fixed as (
  select score, y, 1 + (select count(*) from (select distinct m from mins) q where q.m > t.score) as band
  from test t)"""

def slot(key: str, salt: str = "split") -> str:
    """Slot 0..9 of a key under a salt."""
    return f"(('0x' || substr(md5('{salt}:' || cast({key} as varchar)), 1, 8))::bigint % 10)"


TEXT_KEY = "'K' || lpad(cast(o_orderkey as varchar), 12, '0')"

HALVES = """
train as (select * from score where """ + slot("o_orderkey") + """ < 7),
test as (select * from score where """ + slot("o_orderkey") + """ >= 7)"""


def score_bands(source: str, name: str = "bands") -> str:
    return f"""{name}_long as (select 'score' as var_name, score as value from {source}),
{cuts("20", f"{name}_long", name=f"{name}_cuts")},
{name}_idx as (select cut, row_number() over (order by cut) as idx, count(*) over () as cnt from {name}_cuts),
{name}_rows as (select y, (select count(*) from {name}_cuts c where c.cut <= s.score) as rk from {source} s),
{name} as (
  select case when rk = m then 19 else rk end as number,
         case when rk = 0 then 0.0 else round(lo.cut * 100, 3) end as lo,
         case when rk = m then 100.0 else round(hi.cut * 100, 3) end as hi, customers, bad
  from (select rk, (select max(cnt) from {name}_idx) as m, count(*) as customers, cast(sum(y) as bigint) as bad
        from {name}_rows group by rk) r
  left join {name}_idx lo on lo.idx = rk left join {name}_idx hi on hi.idx = rk + 1)"""


def band_columns(source: str, n: str, rate: int) -> str:
    return f"""
select cast(number as int) as number, round(lo, 6) as lo, round(hi, 6) as hi, customers, bad, customers - bad as good,
       round(customers / cast({n} as double), 6) as share,
       round(case when customers > 0 then bad / customers end, {rate}) as bad_rate,
       round(sum(customers) over u / {n}, 4) as cum_share,
       round(sum(bad) over u / sum(bad) over () - sum(customers - bad) over u / sum(customers - bad) over (), 4) as ks,
       round(sum(bad) over u / sum(bad) over (), 4) as cum_recall
from {source} window u as (order by number desc rows unbounded preceding)"""


APPLIED = """applied as (
  select b.number, b.lo, b.hi, count(t.s) as customers, cast(coalesce(sum(t.y), 0) as bigint) as bad,
         (select count(*) from test) as n
  from bands b left join (select round(score * 100, 3) as s, y from test) t on t.s >= b.lo and t.s < b.hi
  group by b.number, b.lo, b.hi)"""

RELATED = APP + """,
rel as (
  select o_totalprice as a, o_totalprice + c_acctbal * 10 as b,
         case when o_orderkey % 7 <> 0 then c_acctbal - n_regionkey * 100 end as c,
         c_acctbal as e, cast(o_orderkey % 11 as double) as f from app)"""


def correlations(names: list[str]) -> str:
    """CTE ``corrs`` of all column pairs, earlier name first."""
    pairs = [
        f"select '{x}' as var_name1, '{z}' as var_name2, corr({x}, {z}) as corref from rel"
        for i, x in enumerate(names)
        for z in names[i + 1 :]
    ]
    return "corrs as (\n  " + "\n  union all ".join(pairs) + ")"


ORACLES: dict[str, str] = {}


def add(name: str, *parts: str) -> None:
    *ctes, select = parts
    ORACLES[name] = (with_(*ctes) if ctes else "") + select


# -- sources, cleaning -----------------------------------------------------------

add("delimited_roundtrip",
    "select cast(c_custkey as varchar) as c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
add("delimited_mixed_headers",
    "select cast(c_custkey as varchar) as c_custkey, cast(c_nationkey as int) as c_nationkey, c_acctbal from customer")
add("report_blocks", LINE, long("line", ["l_discount", "l_tax"], "varchar", ", y"), counts(),
    "select 'bad-rate:' || var_name as block_id, var_name, bin, total, bad, round(bad / total, 6) as bad_rate from counts")
add("append_report", LINE, long("line", ["l_discount", "l_tax"], "varchar", ", y"), counts(),
    "select var_name, bin, total, bad, round(bad / total, 6) as bad_rate from counts")
add("null_tokens",
    "select event_id, case when event_type <> 'error' and event_id % 11 <> 0 then event_type end as event_type"
    " from events")
add("infer_numeric", EVT,
    "select cast(event_id as varchar) as event_id, round(cast(k as double), 6) as k, event_type,"
    " round(value, 6) as v from evt")
add("sentinel_to_null", APP,
    "select o_orderkey, nullif(acct_s, -99) as acct_s, nullif(o_totalprice, -99) as o_totalprice, o_orderpriority"
    " from app")
add("null_to_sentinel", EVT,
    "select cast(event_id as double) as event_id, coalesce(value, -99) as value,"
    " case when event_id % 11 <> 0 then event_type else '-99' end as event_type from evt")
add("time_range",
    "select o_orderkey, o_totalprice from orders"
    " where o_orderdate between timestamp '1996-01-01' and timestamp '1997-12-31 23:59:59'")
add("month_key",
    "select strftime(o_orderdate, '%Y-%m') as month, count(*) as n, max(strftime(o_orderdate, '%Y-%m-%d')) as last_day"
    " from orders group by 1")
add("recode_other",
    "select cast(case when l_linenumber in (1, 3, 6) then l_linenumber else 998 end as int) as term, count(*) as n"
    " from lineitem group by 1")
add("dictionary_projection", "select c_custkey, c_acctbal, c_mktsegment from customer")
add("null_share_prune", EVT,
    "select var_name, round(s, 6) as null_share, s < 0.95 as keep from ("
    + " union all ".join(
        f"select '{c}' as var_name, 1 - count({c}) / cast(count(*) as double) as s from evt"
        for c in ("event_id", "value", "rare", "event_type"))
    + ")")
add("safe_ratio",
    "select l_discount, l_tax, round(case when l_discount = 0 and l_tax = 0 then 0"
    " when l_tax = 0 then null else l_discount / l_tax end, 6) as ratio, count(*) as n from lineitem group by all")
add("rule_flag",
    "select c_custkey, cast(case when c_mktsegment = 'MACHINERY' then 0"
    " when c_acctbal >= 5000 and c_mktsegment = 'BUILDING' then 0 else 1 end as int) as flag,"
    " case when c_mktsegment in ('AUTOMOBILE', 'HOUSEHOLD') then 1.0::double else 0.0::double end as member"
    " from customer")
add("days_between",
    "kept as (select event_id, case when ts < timestamp '2024-01-25' then ts end as t from events)",
    "select event_id, cast(floor(epoch(timestamp '2024-01-15 12:00:00' - t) / 86400) as bigint) as days_since,"
    " cast(floor(epoch(t - timestamp '2024-01-15 12:00:00') / 86400) as bigint) as days_until from kept")
add("category_merge",
    "select case when l_returnflag in ('A', 'R') then 'closed' else l_returnflag end as l_returnflag,"
    " case when l_linenumber in (1, 2) then 'first lines' when l_linenumber in (6, 7) then 'last lines'"
    " else cast(l_linenumber as varchar) end as code, count(*) as n from lineitem group by all")
add("manual_rebin", APP,
    "select case when acct_s = -99 or acct_s >= 3000 then 'rich or unknown' when acct_s >= 0 then 'middle'"
    " else 'debt' end as label, count(*) as n, cast(sum(y) as bigint) as bad from app group by 1")
add("scorecard_lookup", APP, long("app", APP_BINS, keep=", y"), cuts("4", where="value <> -99"), bins("left"),
    woe("bins", "woe", "bin_no"),
    "regions as (select 'n_regionkey' as var_name, n_regionkey as value, y from app)",
    counts("regions", "rcounts"), woe("rcounts", "rwoe"),
    """numbered as (
  select o_orderkey, n_regionkey,
         (select count(*) from cuts c where c.var_name = 'o_totalprice' and c.cut <= o_totalprice) as pb,
         case when acct_s = -99 then -1
              else (select count(*) from cuts c where c.var_name = 'acct_s' and c.cut <= acct_s) end as ab
  from app)""",
    "select o_orderkey, p.woe as o_totalprice_points, a.woe as acct_s_points, r.woe as n_regionkey_points"
    " from numbered left join woe p on p.var_name = 'o_totalprice' and p.bin_no = pb"
    " left join woe a on a.var_name = 'acct_s' and a.bin_no = ab left join rwoe r on r.bin = n_regionkey")

# -- joins, de-duplication -----------------------------------------------------------

add("inner_join",
    "select o_orderkey, o_custkey, o_totalprice, c_custkey, c_name from orders join customer on o_custkey = c_custkey")
add("multi_key_join", EVT,
    "select v.user_id, v.day, views, clicks from"
    " (select user_id, day, count(*) as views from evt where event_type = 'view' group by all) v join"
    " (select user_id, day, count(*) as clicks from evt where event_type = 'click' group by all) c"
    " on v.user_id = c.user_id and v.day = c.day")
add("left_enrich",
    "firsts as (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn from orders)",
    "select c_custkey, c_mktsegment, o_orderkey, o_totalprice from customer"
    " left join firsts on o_custkey = c_custkey and rn = 1")
add("vendor_chain_join",
    "select l_orderkey, count(*) as n, sum(case when l_returnflag = 'A' then l_quantity end) as qty_a,"
    " sum(case when l_returnflag = 'N' then l_quantity end) as qty_n,"
    " sum(case when l_returnflag = 'R' then l_quantity end) as qty_r from lineitem group by 1"
    " having qty_a is not null and qty_n is not null and qty_r is not null")
add("allow_list_semi",
    "select o_orderkey, o_custkey, o_totalprice from orders"
    " where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
add("latest_record", EVT,
    "gappy as (select *, case when event_id % 97 <> 0 then ts end as t from evt)",
    "select user_id, event_id, event_type, value from"
    " (select *, row_number() over (partition by user_id order by t desc nulls first, event_id desc) as rn from gappy)"
    " where rn = 1")
add("first_record",
    "select o_custkey, o_orderstatus as status, o_orderkey, o_totalprice from"
    " (select *, row_number() over (partition by o_custkey, o_orderstatus order by o_orderkey) as rn from orders)"
    " where rn = 1")
add("distinct_rows", "select distinct l_returnflag, l_linestatus, l_linenumber from lineitem")
add("union_by_name",
    "select c_name as name, c_acctbal as acctbal, c_mktsegment as segment from customer"
    " union all select s_name, s_acctbal, null from supplier")

# -- profiling --------------------------------------------------------------------------

_EVT_VARS = ["event_id", "user_id", "event_type", "value", "rare", "single", "k"]
_DAILY = """daily as (select var_name, day, avg(missing) as null_share from cells group by all),
stats as (
  select var_name, avg(null_share) as mean_null_share,
         stddev_pop(null_share) / nullif(avg(null_share), 0) as null_std_over_mean
  from daily group by 1)"""


def cells(names: list[str]) -> str:
    return "cells as (" + " union all ".join(
        f"select '{c}' as var_name, day, cast({c} as varchar) as v, cast({c} is null as int) as missing from evt"
        for c in names
    ) + ")"


add("quality_profile", EVT, cells(_EVT_VARS), _DAILY,
    "whole as (select var_name, avg(missing) as s, count(distinct v) as d from cells group by 1)",
    "select var_name, round(s, 6) as null_share, d as different_values, round(mean_null_share, 6) as mean_null_share,"
    " round(null_std_over_mean, 6) as null_std_over_mean, s < 0.95 and d <> 1 as use,"
    " case when s >= 1 then 'all_null' when s >= 0.95 then 'mostly_null' when d = 1 then 'single_value' end as reason"
    " from whole join stats using (var_name)")
add("monthly_null_matrix", EVT, cells(["value", "rare", "user_id"]), _DAILY,
    "select var_name, day, round(null_share, 6) as null_share, round(mean_null_share, 6) as mean_null_share,"
    " round(null_std_over_mean, 6) as null_std_over_mean from daily join stats using (var_name)")

# -- bins, WOE, IV ------------------------------------------------------------------------

add("bin_bad_rate", LINE, long("line", ["l_quantity", "l_tax"], "varchar", ", y"), counts(),
    "select var_name, bin, total, bad, round(bad / total, 6) as bad_rate,"
    " round(sum(bad) over v / sum(total) over v, 6) as overall_rate from counts window v as (partition by var_name)")
add("rate_encode", APP,
    "select o_orderkey, round(avg(y) over (partition by o_orderpriority), 6) as o_orderpriority_rate,"
    " round(avg(y) over (partition by c_mktsegment), 6) as c_mktsegment_rate from app")
_WOE_OUT = ("total, bad, good, round(bad_rate, 6) as bad_rate, round(bad_pcnt, 6) as bad_pcnt,"
            " round(good_pcnt, 6) as good_pcnt")
add("woe_iv", LINE, long("line", ["l_quantity", "l_discount", "l_tax"], "varchar", ", y"), counts(), woe(),
    f'select var_name, bin, {_WOE_OUT}, {r6("woe")}, {r6("iv")}, "groups", status from woe')
add("woe_report", APP,
    "flagged as (select *, o_totalprice > 250000 as high from app)",
    long("flagged", ["high", "n_regionkey", "o_orderpriority"], "varchar", ", y"), counts(), woe(),
    f'select var_name, bin, {r6("woe")}, {_WOE_OUT}, {r6("iv")}, status from woe')
add("woe_encode", *encoded(),
    "select o_orderkey, " + ", ".join(r6(f"{c}_woe") for c in ENCODED) + " from encoded")
add("iv_screen", APP,
    "wide as (select *, cast(o_totalprice > 250000 as varchar) as high, 'x' as constant,"
    " cast(y as varchar) as leak from app)",
    long("wide", ["high", "constant", "leak", "n_regionkey", "o_orderpriority"], "varchar", ", y"),
    counts(), woe(), screen(),
    f'select var_name, {r6("iv")}, "groups", status, selected from screen')
add("iv_rank", *binned(),
    long("binned", ["o_totalprice_Bin", "acct_s_Bin", "o_orderpriority"], "varchar", ", y"),
    counts(), woe(), screen(min_iv=0.0),
    "select split_part(var_name, '_Bin', 1) as var_name, round(iv, 6) as iv from screen"
    " where iv >= 0.0001 and not isinf(iv)")
add("chi_adjacent", LINE, long("line", ["l_quantity", "l_extendedprice"], keep=", y"), cuts("8"),
    bins("left", special=False),
    """chis as (
  select var_name, bin_no, power(total * rate - bad, 2) / (total * rate) as chi
  from (select *, sum(bad) over v / sum(total) over v as rate from bins window v as (partition by var_name)))""",
    "select var_name, bin_no, next_bin, round(chi + next_chi, 6) as chi2 from"
    " (select *, lead(bin_no) over w as next_bin, lead(chi) over w as next_chi from chis"
    " window w as (partition by var_name order by bin_no)) where next_bin is not null")
add("equal_freq_cuts",
    "wide as (select *, l_extendedprice as priced from lineitem)",
    long("wide", ["l_quantity", "l_discount", "l_tax", "l_extendedprice", "priced"]), cuts("10"),
    "select var_name, n, cut from cuts")
add("equal_freq_bins", APP, long("app", APP_BINS, keep=", y"),
    "groups_of as (select var_name, 10 - cast(bool_or(value = -99) as int) as k from long group by 1)",
    "plain as (select * from long join groups_of using (var_name) where value <> -99)",
    """cuts as (
  select distinct var_name, value as cut from
    (select var_name, value, k, row_number() over (partition by var_name order by value) - 1 as rn,
            count(*) over (partition by var_name) as n from plain) s
  join range(1, 10) i(i) on i.i < k and rn = cast(floor(i.i * (n / cast(k as double))) as bigint))""",
    bins("right"), "select * from bins")
add("equal_freq_screen", APP, long("app", APP_BINS, keep=", y"),
    "groups_of as (select var_name, 10 - cast(bool_or(value = -99) as int) as k from long group by 1)",
    "plain as (select * from long join groups_of using (var_name) where value <> -99)",
    """cuts as (
  select distinct var_name, value as cut from
    (select var_name, value, k, row_number() over (partition by var_name order by value) - 1 as rn,
            count(*) over (partition by var_name) as n from plain) s
  join range(1, 10) i(i) on i.i < k and rn = cast(floor(i.i * (n / cast(k as double))) as bigint))""",
    bins("right"),
    "mlong as (select 'month' as var_name, month as value, y from app)",
    cuts("10", "mlong", name="mcuts"),
    bins("right", special=False, cut_name="mcuts", source="mlong", name="mbins"),
    "direct as (select 'n_regionkey' as var_name, cast(n_regionkey as varchar) as value, y from app"
    " union all select 'o_orderpriority', o_orderpriority, y from app)",
    counts("direct"),
    "every as (select var_name, cast(bin_no as varchar) as bin, total, bad, 'binned' as route from bins"
    " union all select var_name, cast(bin_no as varchar), total, bad, 'binned' from mbins"
    " union all select var_name, bin, total, bad, 'direct' from counts)",
    woe("every"), screen(),
    f'select s.var_name, {r6("iv")}, "groups", status, selected, route from screen s'
    " join (select distinct var_name, route from every) e on e.var_name = s.var_name")
add("chi_bins", APP, long("app", APP_BINS, keep=", y"), cuts("5", where="value <> -99"), bins("left"),
    "select *, round(bad / total, 6) as bad_rate from bins")
add("chi_prebin", APP,
    "wide as (select *, cast(substr(o_orderpriority, 1, 1) as double) as prio from app)",
    long("wide", ["o_totalprice", "acct_s", "prio"], keep=", y"),
    cuts("100", where="value <> -99 and var_name <> 'prio'"),
    "grouped as (select var_name, y, value = -99 as is_special, case when value = -99 or var_name = 'prio' then value"
    " else coalesce((select min(cut) from cuts c where c.var_name = l.var_name and c.cut >= l.value), 1e11) end as grp"
    " from long l)",
    "select var_name, grp, is_special, count(*) as total, cast(sum(y) as bigint) as bad from grouped group by all")

_CHI = "power({t} * rate - {b}, 2) / ({t} * rate)"
_PAIRS = "[ivs[i].chi + ivs[i + 1].chi for i in range(1, len(ivs))]"
add("chi_merge", APP,
    "wide as (select *, cast(substr(o_orderpriority, 1, 1) as double) as prio from app)",
    long("wide", ["o_totalprice", "acct_s", "prio", "n_regionkey"], keep=", y"),
    cuts("100", where="value <> -99 and var_name not in ('prio', 'n_regionkey')"),
    "grouped as (select var_name, y, value = -99 as is_special, case when value = -99 or var_name in ('prio', 'n_regionkey') then value"
    " else coalesce((select min(cut) from cuts c where c.var_name = l.var_name and c.cut >= l.value), 1e11) end as grp"
    " from long l)",
    "groups_of as (select var_name, grp, is_special, count(*) as total, sum(y)::bigint as bad from grouped group by all)",
    """per as (select var_name, sum(total)::bigint as n, count(*) as k, bool_or(is_special) as special,
    sum(bad) filter (where not is_special) / sum(total) filter (where not is_special) as rate, list(grp order by grp) as every
  from groups_of group by var_name)""",
    f"""merged as (
  select g.var_name, list(struct_pack(hi := grp, chi := {_CHI.format(t='total', b='bad')}) order by grp) as ivs,
         5 - any_value(special)::int as wanted
  from groups_of g join per using (var_name) where not is_special group by g.var_name
  union all
  select var_name, list_concat(list_concat(ivs[1:(spot - 1)], [struct_pack(hi := ivs[spot + 1].hi, chi := pairs[spot])]), ivs[(spot + 2):len(ivs)]), wanted
  from (select *, list_position(pairs, list_min(pairs)) as spot from (select *, {_PAIRS} as pairs from merged where len(ivs) > wanted)))""",
    "least as (select * from merged qualify row_number() over (partition by var_name order by len(ivs)) = 1)",
    f"""kept as (
  select var_name, [i.hi for i in ivs[1:(len(ivs) - 1)]] as cuts, true as going from least
  union all
  select var_name, case when gone is null then cuts else list_concat(cuts[1:(gone - 1)], cuts[(gone + 1):len(cuts)]) end, gone is not null
  from (select *, case when spot is null then null when spot = len(bins) then len(cuts) when spot = 1 then 1
               when chis[spot - 1] + chis[spot] < chis[spot] + chis[spot + 1] then spot - 1 else spot end as gone
    from (select *, nullif(list_position([b.bad = 0 or b.bad = b.total for b in bins], true), 0) as spot,
                 [{_CHI.format(t='b.total', b='b.bad')} for b in bins] as chis
      from (select var_name, cuts, rate, list(struct_pack(total := total, bad := bad) order by bin) as bins
        from (select k.var_name, k.cuts, p.rate, len(list_filter(k.cuts, lambda c: c <= g.grp)) as bin, sum(g.total) as total, sum(g.bad) as bad
          from kept k join groups_of g on g.var_name = k.var_name and not g.is_special join per p on p.var_name = k.var_name
          where k.going and len(k.cuts) > 0 group by all)
        group by all))))""",
    "last as (select * from kept qualify row_number() over (partition by var_name order by len(cuts), going) = 1)",
    """final as (select p.var_name, p.n, case when k <= 5 and p.var_name in ('prio', 'n_regionkey') then every[1:(k - 1)]
    when rate in (0, 1) then [] else l.cuts end as cuts from per p join last l using (var_name))""",
    "select var_name, n, (generate_subscripts(cuts, 1) - 1)::int as position, unnest(cuts) as cut from final"
    " union all select var_name, n, null, null from final where len(cuts) = 0")
ORACLES["chi_merge"] = ORACLES["chi_merge"].replace("with ", "with recursive ", 1)

# -- evaluation ------------------------------------------------------------------------------

add("ks", SCORE, curve("score"), f"select round({KS_ABS}, 6) as ks_abs, round({KS}, 6) as ks from curve")
add("auc", SCORE, curve("score"), f"select round({AUC}, 6) as auc from curve")
add("roc_points", SCORE, curve("score"),
    "select round(score, 6) as threshold, round(1 - (ct - cb - (total - bad)) / (n - b), 6) as fpr,"
    " round(1 - (cb - bad) / b, 6) as tpr from curve union all select null, 0.0, 0.0")
MONTHLY = (
    f"select month as period, round({KS}, 6) as ks, round({AREA}, 6) as auc, cast(any_value(n) as bigint) as total,"
    " cast(any_value(b) as bigint) as bad from curve group by month")
add("monthly_ks_auc", SCORE,
    "turned as (select * replace (case when substr(month, 6, 2) = '03' then 1 - score else score end as score) from score)",
    curve("turned", "month"), MONTHLY)
add("stacked_monthly", SCORE, "kept as (select * from score where month <> '1995-12')", curve("kept", "month"), MONTHLY)
COARSE = f"coarse as (select {TEXT_KEY} as key, y, floor(score * 100) / 100 as score from score)"
DIGEST = "('0x' || substr(md5(key), 1, 13))::bigint"
add("rank_slice_text_tie", SCORE, COARSE,
    f"ranked as (select y, row_number() over (order by score desc, {DIGEST}) - 1 as pos from coarse)",
    "select round(sum(case when pos >= 10 and pos < 400 then y else 0 end) / sum(y), 6) as recall,"
    " round(sum(case when pos >= 10 and pos < 400 then y else 0 end) / 390.0, 6) as precision from ranked")
add("gains_text_tie", SCORE, COARSE, rank_bands("coarse", 20, "ranked", DIGEST), gains("ranked"))
add("skewed_mixed_keys",
    "select s_nationkey, count(*) as n, cast(sum(l_quantity) as double) as quantity from lineitem join supplier"
    " on l_suppkey = s_suppkey group by s_nationkey")
add("band_join",
    "select case when l_extendedprice < 900 then 'low' when l_extendedprice < 30000 then 'middle' else 'high' end as band,"
    " count(*) as n from lineitem group by 1")
add("bin_labels", APP,
    "base as (select 'acct_s' as var_name, acct_s as value from app where acct_s <> -99)",
    cuts("4", "base"),
    "edges as (select cut, row_number() over (order by cut) as i, count(*) over () as m from cuts)",
    "numbered as (select acct_s, case when acct_s <> -99 then (select count(*) from cuts c where c.cut <= acct_s) end as k from app)",
    "select case when k is null then 'b-1NA' when k = 0 then 'b0[-inf, ' || cast(floor(hi.cut) as bigint) || ')'"
    " when k = lo.m then 'b' || (k + 1) || '[' || cast(floor(lo.cut) as bigint) || ',inf)'"
    " else 'b' || k || '[' || cast(floor(lo.cut) as bigint) || ',' || cast(floor(hi.cut) as bigint) || ')' end as label,"
    " count(*) as n from numbered left join edges lo on lo.i = k left join edges hi on hi.i = k + 1 group by 1")
add("name_list_attributes", *binned(),
    "names as (select * from (values (0, 'n_regionkey'), (1, 'acct_s_Bin'), (2, 'unknown'), (3, 'o_totalprice_Bin'),"
    " (4, 'acct_s_Bin')) t(position, var_name))",
    "found as (select 'n_regionkey' as var_name, count(distinct n_regionkey) as groups from binned"
    " union all select 'acct_s_Bin', count(distinct acct_s_Bin) from binned"
    " union all select 'o_totalprice_Bin', count(distinct o_totalprice_Bin) from binned)",
    "select position, var_name, groups from names left join found using (var_name)")
add("label_domain", APP,
    "select cast(case when o_orderkey % 9 = 0 then 0 else y end as int) as y, count(*) as n from app"
    " where o_orderkey % 9 = 0 or o_orderkey % 13 <> 0 group by 1")
add("prune_columns", EVT,
    "select 'event_id' as var_name, count(event_id) as filled from evt union all select 'value', count(value) from evt"
    " union all select 'single', count(*) from evt")
add("fold_counts", SCORE,
    f"keyed as (select *, {TEXT_KEY} as key from score)",
    f"select cast({slot('key', 'fold')} as int) as fold, count(*) as n, cast(sum(y) as bigint) as bad from keyed"
    f" where {slot('key')} < 7 group by 1")
add("corr_pairs_large_mean", APP,
    "rel as (select o_totalprice / 1000 + 1.7e9 - 1.7e9 as a, o_totalprice / 900 + c_acctbal / 1e6 + 1.7e9 - 1.7e9 as b from app)",
    "select 'a' as var_name1, 'b' as var_name2, round(corr(a, b), 4) as corref from rel")
add("rank_slice_pr", SCORE,
    "ranked as (select y, row_number() over (order by score desc, o_orderkey) - 1 as pos from score)",
    "select round(sum(case when pos >= 10 and pos < 400 then y else 0 end) / sum(y), 6) as recall,"
    " round(sum(case when pos >= 10 and pos < 400 then y else 0 end) / 390.0, 6) as precision from ranked")
add("gains_table", SCORE,
    "coarse as (select o_orderkey, y, floor(score * 100) / 100 as score from score)",
    rank_bands("coarse", 20, "ranked"), gains("ranked"))
add("gains_fixed", SCORE, HALVES, rank_bands("train", 10, "ranked"), MINS, FIXED, gains("fixed"))
add("evaluate_sample", SCORE, HALVES, rank_bands("train", 10, "ranked"), MINS, FIXED, curve("test"),
    "bands as (" + gains("fixed") + ")",
    f"stats as (select round({KS}, 6) as sample_ks, round({AREA}, 6) as sample_auc from curve)",
    "select * from bands, stats")
add("score_bands", SCORE, score_bands("score"),
    "sized as (select *, sum(customers) over () as n from bands)", band_columns("sized", "n", 6))
add("band_apply", SCORE, HALVES, score_bands("train"), APPLIED, band_columns("applied", "n", 4))
add("monitor_band_share", SCORE, HALVES, score_bands("train"), APPLIED,
    "select cast(number as int) as number, round(lo, 6) as lo, round(hi, 6) as hi, customers,"
    " round(customers / cast(n as double), 6) as share from applied")
add("band_cut", SCORE,
    "select cast(case when p < 5 or p >= 60 then null when p < 20 then 0 when p < 40 then 1 else 2 end as int) as segment,"
    " count(*) as n, cast(sum(y) as bigint) as bad from (select score * 100 as p, y from score) group by 1")
add("stability_table", *binned(),
    long("binned", ["o_totalprice_Bin", "acct_s_Bin", "o_orderpriority"], "varchar", ", y, month"),
    "cells as (select var_name, month as period, value as bin, count(*) as n, avg(y) as r from long group by all)",
    "select var_name, period, bin, n, round(n / sum(n) over (partition by var_name, period), 6) as share,"
    " round(r, 6) as bad_rate from cells")
add("month_target_cube", APP,
    "select month as period, y as target, count(*) as n, cast(grouping(month, y) as bigint) as level"
    " from app group by cube (month, y)")

# -- selection and models -----------------------------------------------------------------------

add("corr_pairs", RELATED, correlations(["a", "b", "c", "e", "f"]),
    "select var_name1, var_name2, round(corref, 6) as corref from corrs where abs(corref) > 0.7")
add("corr_pairs_wide", RELATED.replace("as f from app", "as f, -o_totalprice as a2,"
    " c_acctbal + cast(o_orderkey % 11 as double) as e2 from app"),
    correlations(["a", "b", "c", "e", "f", "a2", "e2"]),
    "select var_name1, var_name2, round(corref, 6) as corref from corrs where abs(corref) > 0.7")
add("corr_prune", RELATED, correlations(["a", "b", "c", "e", "f"]), *binned()[1:],
    "flagged as (select *, o_totalprice > 250000 as high from binned)",
    long("flagged", ["o_totalprice_Bin", "acct_s_Bin", "high", "n_regionkey"], "varchar", ", y"),
    counts(), woe(), screen(min_iv=0.0),
    "ivs as (select case var_name when 'o_totalprice_Bin' then 'a' when 'acct_s_Bin' then 'e' when 'high' then 'b'"
    " else 'c' end as var_name, iv from screen)",
    "losers as (select case when x.iv >= z.iv then var_name2 else var_name1 end as var_name from corrs"
    " join ivs x on x.var_name = var_name1 join ivs z on z.var_name = var_name2 where abs(corref) > 0.7)",
    "select var_name, round(iv, 6) as iv from ivs where var_name not in (select var_name from losers)")
add("vif",
    "factor as (select 1 / (1 - power(sum(l_quantity * l_extendedprice), 2)"
    " / (sum(l_quantity * l_quantity) * sum(l_extendedprice * l_extendedprice))) as f from lineitem)",
    "select 'l_quantity' as var_name, round(f, 6) as vif from factor"
    " union all select 'l_extendedprice', round(f, 6) from factor")
add("split_70_30", SCORE,
    f"keyed as (select *, {TEXT_KEY} as key from score)",
    f"select case when {slot('key')} < 7 then 'train' else 'test' end as part, count(*) as n,"
    " cast(sum(y) as bigint) as bad from keyed group by 1")
add("score_batch", *encoded(),
    "select o_orderkey, round(1 / (1 + exp(-(-0.1 + "
    + " + ".join(f"{w} * {c}_woe" for c, w in zip(ENCODED, (1.0, 0.5, 0.25, -0.5, 2.0)))
    + "))), 6) as score from encoded")
add("corr_pairs_outliers",
    """far as (select *, (l_linenumber + 7 * (l_orderkey % 1000)) % 1999 = 0 as far, (l_linenumber + 7 * (l_orderkey % 1000)) % 5 as fifth from lineitem),
cols as (select case when far then 1e12 else l_extendedprice end as a, case when not far then l_extendedprice + l_quantity * 100 end as b,
         case when not far and fifth <> 0 then l_quantity / 1000 + 1e6 end as c from far),
corrs as (select 'a' as var_name1, 'b' as var_name2, corr(a, b) as corref from cols where a is not null and b is not null
  union all select 'a', 'c', corr(a, c) from cols where a is not null and c is not null
  union all select 'b', 'c', corr(b, c) from cols where b is not null and c is not null)""",
    "select var_name1, var_name2, round(corref, 6) as corref from corrs where abs(corref) > 0.7")
# Three columns by determinants: the factor of a column is its square sum times the minor without it over the determinant.
add("vif_prune_drop",
    """x as (select l_extendedprice as a, l_discount as b, l_extendedprice + l_quantity * 500 as c from lineitem),
g as (select sum(a * a) as aa, sum(a * b) as ab, sum(a * c) as ac, sum(b * b) as bb, sum(b * c) as bc, sum(c * c) as cc from x),
three as (select *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) as det from g),
first as (select unnest(['l_extendedprice', 'l_discount', 'mixed']) as var_name,
         unnest([aa * (bb * cc - bc * bc) / det, bb * (aa * cc - ac * ac) / det, cc * (aa * bb - ab * ab) / det]) as vif from three),
gone as (select * from first qualify row_number() over (order by vif desc) = 1),
pairs as (select 'l_extendedprice' as u, 'l_discount' as v, aa * bb / (aa * bb - ab * ab) as vif from g
  union all select 'l_extendedprice', 'mixed', aa * cc / (aa * cc - ac * ac) from g
  union all select 'l_discount', 'mixed', bb * cc / (bb * cc - bc * bc) from g),
rest as (select unnest([u, v]) as var_name, p.vif from pairs p, gone where gone.var_name not in (u, v))""",
    "select var_name, round(vif, 6) as vif, false as kept, 1 as step from gone where vif > 6"
    " union all select var_name, round(vif, 6), true, 1 from rest where (select max(vif) from rest) <= 6")
add("skewed_both_sides",
    "l as (select case when l_linenumber < 3 then 0 else l_suppkey end as k, l_linenumber as nr from lineitem)",
    "r as (select case when c_custkey % 3 = 0 then 0 else c_custkey end as k, c_nationkey as nation from customer)",
    "select nation, nr, count(*) as n, cast(sum(k) as bigint) as keys from l join r using (k) group by all")
add("skewed_left_join",
    "l as (select case when event_id % 4 <> 0 then case when event_id % 3 = 0 then 1 else user_id end end as k, event_type from events)",
    "r as (select case when o_orderkey % 50 = 0 then 1 else o_custkey * 3 end as k, o_orderstatus as status from orders)",
    "select event_type, status, count(*) as n, count(l.k) as with_key from l left join r on l.k = r.k group by all")

# -- fits ---------------------------------------------------------------------------


def inverted(source: str, name: str, k: int) -> list[str]:
    """CTEs that invert the k x k matrix ``m`` of every row of ``source``, pivot by pivot."""
    out, last = [], source
    for p in range(1, k + 1):
        cell = (
            f"case when i = {p} and j = {p} then 1 / m[{p}][{p}] when i = {p} then m[{p}][j] / m[{p}][{p}]"
            f" when j = {p} then -m[i][{p}] / m[{p}][{p}] else m[i][j] - m[i][{p}] * m[{p}][j] / m[{p}][{p}] end"
        )
        rows = f"list_transform(range(1, {k + 1}), lambda i: list_transform(range(1, {k + 1}), lambda j: {cell}))"
        now = name if p == k else f"{name}_{p}"
        out.append(f"{now} as materialized (select * replace ({rows} as m) from {last})")
        last = now
    return out


def newton(k: int, penalty: float, steps: int = 9) -> list[str]:
    """CTE ``fits``: ``(model, b, m)``, coefficients and inverse Hessian of
    every model, from ``rows_of (fold, xs, y, w)`` and ``models (model, fold,
    use, ridge)``; a model leaves its fold out and uses the columns marked 1."""
    out = [f"b0 as materialized (select model, fold, use, ridge, [0.0 for i in range({k})] as b from models)"]
    hessian = ", ".join(
        "[" + ", ".join(f"sum(v * x[{i}] * x[{j}])" + (f" + any_value(1 - use[{i}] + use[{i}] * ridge[{i}])" if i == j else "") for j in range(1, k + 1)) + "]"
        for i in range(1, k + 1)
    )
    gradient = ", ".join(f"sum(w * (y - p) * x[{i}]) - any_value(use[{i}] * ridge[{i}] * b[{i}])" for i in range(1, k + 1))
    for t in range(1, steps + 1):
        out += [
            f"""s{t} as materialized (select model, any_value(fold) as fold, any_value(use) as use, any_value(ridge) as ridge, any_value(b) as b, [{hessian}] as m, [{gradient}] as g
  from (select *, w * p * (1 - p) as v from (select model, n.fold, use, ridge, b, y, w, x, 1 / (1 + exp(-list_dot_product(x, b))) as p
    from (select n.*, r.y, r.w, list_transform(range(1, {k + 1}), lambda i: r.xs[i] * n.use[i]) as x from b{t - 1} n join rows_of r on r.fold <> n.fold) n))
  group by model)""",
            *inverted(f"s{t}", f"i{t}", k),
            f"b{t} as materialized (select model, fold, use, ridge, list_transform(range(1, {k + 1}), lambda i: b[i] + list_dot_product(m[i], g)) as b, m from i{t})",
        ]
        if t < steps:
            out[-1] = out[-1].replace(", m from", " from")
    return [*out, f"fits as (select * from b{steps})"]


_WOE_NAMES = [f"{c}_woe" for c in ENCODED]


def _encoded_rows(intercept: bool, fold: str = "0", where: str = "true") -> str:
    xs = ", ".join((["1.0"] if intercept else []) + _WOE_NAMES)
    return f"rows_of as materialized (select fold, xs, y, count(*)::double as w from (select {fold} as fold, [{xs}] as xs, y::double as y from encoded where {where}) group by all)"


_L2 = "models as (select 0 as model, -1 as fold, [1, 1, 1, 1, 1, 1] as use, [0.0, 1, 1, 1, 1, 1] as ridge)"
_TRAIN = slot("o_orderkey") + " < 7"
add("lr_coefficients", *encoded(), _encoded_rows(True, where=_TRAIN), _L2, *newton(6, 1.0),
    f"select unnest({['intercept', *_WOE_NAMES]}) as var_name, round(unnest(b), 6) as coef from fits")
add("sign_filter", *encoded(), _encoded_rows(True, where=_TRAIN), _L2, *newton(6, 1.0),
    f"select var_name, round(coef, 6) as coef, coef > 0 as kept from (select unnest({_WOE_NAMES}) as var_name, unnest(b[2:6]) as coef from fits)")
# All subsets are fitted; the path through them follows the greatest p-value. The normal tail is summed by Simpson's rule.
add("pvalue_backward", *encoded(), _encoded_rows(False, where=_TRAIN),
    "models as (select s as model, -1 as fold, [(s >> i) & 1 for i in range(5)] as use, [0.0, 0, 0, 0, 0] as ridge from range(1, 32) t(s))",
    *newton(5, 0.0),
    "tests as (select model, i, b[i + 1] as coef, abs(b[i + 1]) / sqrt(m[i + 1][i + 1]) as z from fits, range(5) t(i) where use[i + 1] = 1)",
    "p_values as (select *, case when z > 38 then 0.0 else 2 * 12 / 3000.0 / 3 * list_sum([(case when j in (0, 3000) then 1 when j % 2 = 1 then 4 else 2 end)"
    " * exp(-power(z + j * 12 / 3000.0, 2) / 2) / sqrt(2 * pi()) for j in range(3001)]) end as p from tests)",
    "worst as (select * from p_values qualify row_number() over (partition by model order by p desc, i) = 1)",
    "path as (select 31 as model union all select model - (1 << i)::int from path join worst using (model) where p > 0.05 and model <> 1 << i)",
    "steps as (select w.* from path join worst w using (model))",
    f"names as (select unnest({_WOE_NAMES}) as var_name, unnest(range(5)) as i)",
    "select var_name, round(coef, 6) as coef, round(p, 6) as p_value, false as kept from steps join names using (i) where p > 0.05"
    " union all select var_name, round(coef, 6), round(p, 6), true from p_values join names using (i)"
    " where model = (select min(model) from path) and (select max(p) from steps where model = (select min(model) from path)) <= 0.05")
ORACLES["pvalue_backward"] = ORACLES["pvalue_backward"].replace("with ", "with recursive ", 1)
# All subsets are fitted in all folds; a pass walks through those that the variables left give.
add("cv_backward", *encoded(), _encoded_rows(True, slot("o_orderkey", "fold")),
    "models as (select s * 10 + f as model, f as fold, list_concat([1], [(s >> i) & 1 for i in range(5)]) as use,"
    " [0.0, 1, 1, 1, 1, 1] as ridge from range(1, 31) t(s), range(10) u(f))",
    *newton(6, 1.0, 7),
    "judged as (select model, list_dot_product(b, [x * u for x, u in zip(xs, use)]) as z, sum(w) as total, sum(w * y) as bad"
    " from fits f join rows_of r on r.fold = f.fold group by all)".replace("[x * u for x, u in zip(xs, use)]", "list_transform(range(1, 7), lambda i: xs[i] * use[i])"),
    "ranked as (select *, sum(total - bad) over (partition by model order by z) as good_upto from judged)",
    "areas as (select model // 10 as s, sum(bad * (good_upto - (total - bad) / 2)) / (sum(bad) * sum(total - bad)) as auc from ranked group by model)",
    "means as (select s, avg(auc) as auc from areas group by s)",
    """walk as (select mask, i, (mask >> (i + 1)) << (i + 1) as rest, auc from range(1, 32) t(mask), range(5) u(i)
  join means on s = (mask >> (i + 1)) << (i + 1) where (mask >> i) & 1 = 1)""",
    "drops as (select * from (select *, auc > coalesce(lag(auc) over (partition by mask order by i), 1) as better from walk)"
    " where better qualify row_number() over (partition by mask order by i) = 1)",
    "path as (select 31 as mask, 0 as round, null::bigint as i, null::double as auc"
    " union all select p.mask - (1 << d.i)::int, p.round + 1, d.i, d.auc from path p join drops d on d.mask = p.mask)",
    f"names as (select unnest({_WOE_NAMES}) as var_name, unnest(range(5)) as i)",
    "select var_name, false as kept, round::int as round, round(auc, 6) as auc from path join names using (i)"
    " union all select var_name, true, 0, null from names where (select min(mask) from path) >> i & 1 = 1")
ORACLES["cv_backward"] = ORACLES["cv_backward"].replace("with ", "with recursive ", 1)
# b is the sum of a and ten times e, so the first of the three goes at once; the factors of the others come from the inverse.
_LEFT = ["b", "c", "e", "f", "flat"]
add("vif_prune", RELATED,
    "x as (select a, b, coalesce(c, 0.0) as c, e, f, 0.1 as flat from rel)",
    "g as (select [" + ", ".join("[" + ", ".join(f"sum({u} * {v})" for v in _LEFT) + "]" for u in _LEFT) + "] as m,"
    " sum(power(b - a - 10 * e, 2)) / sum(b * b) as apart from x)",
    "kept as (select m as g, m from g where apart < 1e-10)",
    *inverted("kept", "inv", 5),
    f"factors as (select unnest({_LEFT}) as var_name, unnest([g[i][i] * m[i][i] for i in range(1, 6)]) as vif from inv)",
    "select 'a' as var_name, 'inf'::double as vif, false as kept, 1 as step from kept"
    " union all select var_name, round(vif, 6), true, 1 from factors where (select max(vif) from factors) <= 10")
add("band_join_many",
    """bands as (select o_orderkey, case when o_orderkey % 991 <> 0 then floor(o_totalprice / 100) * 25 end as lo,
    case when o_orderkey % 997 <> 0 then floor(o_totalprice / 100) * 25 + o_orderkey % 7 * 3 end as hi from orders),
ends as (select o_orderkey, coalesce(lo, '-inf'::double) as lo, coalesce(hi, 'inf'::double) as hi from bands)""",
    "select o_orderkey, count(*) as n, round(max(l_extendedprice), 6) as highest from ends join lineitem"
    " on l_extendedprice >= lo and l_extendedprice < hi group by o_orderkey")
