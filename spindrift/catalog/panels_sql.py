"""The test panels in SQL, as the start of a WITH list."""

DAILY = """
daily as (
  select 'S' || lpad(cast(l_suppkey as varchar), 5, '0') as code, date, open, high, low, close, volume, amount, l_suppkey as code_no,
    case when (l_suppkey + month(date)) % 7 = 0 then null else amount end as gappy,
    case when (l_suppkey + month(date)) % 7 = 0 then null else cast(floor(volume / 40) as bigint) % 3 end::double as level
  from (
    select l_suppkey, cast(date_trunc('month', l_shipdate) as date) as date,
      arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) as open,
      max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low,
      arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) as close,
      sum(l_quantity) as volume, sum(l_extendedprice * (1 - l_discount)) as amount
    from lineitem group by 1, 2
  )
)"""

MINUTE = """
minute as (
  select 'U' || cast(code_no as varchar) as code, trade_time, cast(trade_time as date) as date, open, high, low, close, volume, amount, event_flag, error_count,
    code_no, cast(code_no % 2 as integer) as shard_index, case when (code_no + hour(trade_time)) % 5 != 0 then amount end as gappy
  from (
    select user_id % 10 as code_no, date_trunc('hour', ts) as trade_time, arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low,
      avg(value) as close, count(*)::double as volume, sum(value) as amount, max(case when event_type = 'purchase' then 1.0 else 0.0 end)::double as event_flag,
      count(*) filter (event_type = 'error')::double as error_count
    from events group by 1, 2
  )
)"""
