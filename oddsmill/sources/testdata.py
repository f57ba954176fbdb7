"""Head-to-head views over the synthetic tables, in SQL that Spark and DuckDB both accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: From this date on, matches with order status O count as not yet played.
AS_OF = "2000-01-01"

VIEWS: dict[str, str] = {
    "matches": """
        with l as (
          select l_orderkey, l_suppkey, cast(l_quantity as int) pts,
                 row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) rn
          from {lineitem}),
        h as (select * from l where rn = 1), a as (select * from l where rn = 2)
        select concat_ws('_', cast(cast(o_orderdate as date) as string), cast(o_orderkey as string),
                         cast(h.l_suppkey as string), cast(a.l_suppkey as string)) fixture_id,
               year(o_orderdate) season, cast(o_orderdate as date) match_date,
               h.l_suppkey home_team_id, h.pts home_score, a.l_suppkey away_team_id, a.pts away_score,
               o_orderkey source_match_id, o_orderstatus status
        from {orders} join h on h.l_orderkey = o_orderkey join a on a.l_orderkey = o_orderkey
        where h.l_suppkey <> a.l_suppkey""",
    "season_log": """
        select 2020 + user_id % 5 season, event_id row_idx,
               case when event_type = 'signup' then 1 else 10 end n_cells,
               case when event_type = 'signup' then split_part('Round 1,Semi Final,Challenge Cup R3,S8 Round 2,Notes', ',', cast(1 + event_id % 5 as int)) end heading,
               (event_type = 'signup' and event_id % 7 = 0) other_link,
               (event_type = 'signup' and event_id % 2 = 0) league_link,
               case when event_type <> 'signup' then
                 case when event_id % 3 = 0 then concat(split_part('Jan,Feb,Mar,Apr,May,Jun,Jul,Aug,Sep,Oct,Nov,Dec', ',', cast(1 + event_id % 12 as int)), ' ', cast(1 + event_id % 28 as string))
                      else cast(1 + event_id % 28 as string) end end date_txt,
               case when event_id % 11 = 0 then '' else cast(cast(floor(value) as int) % 60 as string) end home_score_txt,
               case when event_id % 13 = 0 then '' else cast(cast(floor(value * 3) as int) % 60 as string) end away_score_txt,
               concat(cast(1 + event_id % 20 as string), ',', lpad(cast(event_id % 1000 as string), 3, '0')) attendance_txt,
               case when event_id % 17 = 0 then null else cast(event_id - event_id % 2 as string) end source_match_id
        from {events}""",
    "lineup_rows": """
        select user_id match_id, event_id row_idx,
               case when event_type = 'purchase' then 'FB' when event_type = 'error' and event_id % 5 = 0 then 'HC' else upper(event_type) end position,
               case when event_id % 19 = 0 then null else concat('Player ', cast(event_id % 40 as string)) end home_name,
               case when event_id % 23 = 0 then null else concat('Player ', cast(event_id % 41 as string)) end away_name,
               case when event_id % 3 = 0 then null else cast(event_id % 40 as string) end source_player_id
        from {events}""",
    "team_map": """
        select s_suppkey team_id, s_name source_team_name,
               case when s_suppkey % 3 = 0 then null else 1994 + s_suppkey % 3 end valid_from,
               case when s_suppkey % 5 = 0 then 1998 end valid_to
        from {supplier}
        union all
        select s_suppkey + 100000, s_name, 1998, null from {supplier} where s_suppkey % 5 = 0""",
    "upsert_batch": """
        select o_orderkey k, o_totalprice v, 1 batch_seq from {orders} where o_orderkey % 3 = 0
        union all
        select o_orderkey, o_totalprice + 1, 2 from {orders} where o_orderkey % 9 = 0""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def duckdb_view(name: str) -> str:
    return VIEWS[name].format(**{t: t for t in TABLES})


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Played matches."""
    return view(spark, sf_dir, "matches").filter(f"NOT (status = 'O' AND match_date >= DATE'{AS_OF}')")


def future(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches still to be played, without scores."""
    return view(spark, sf_dir, "matches").filter(f"status = 'O' AND match_date >= DATE'{AS_OF}'").drop("home_score", "away_score")
