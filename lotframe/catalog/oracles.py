"""DuckDB SQL that gives the expected rows of each query.

Ingest results are checked against the lots themselves, so their SQL shares no
logic with the parser; operators inside the parser are checked by plain window
SQL over the same grid.
"""

from __future__ import annotations

from ..functions.text import CATEGORY_HEADINGS
from ..operators.canonical import FULL_FIELDS
from ..sources.mapping import DEFAULT_SYNONYMS, mapping_entries
from .derived import AS_OF, FLAT_HEADER, GROUP_HEADER, HYBRID_HEADER, ORDERS_PER_BLOCK, SHEET_ROWS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


def cents(amount: str) -> str:
    return f"cast(floor({amount} * 100 + 0.5) as bigint)"


def _pennies(n: str) -> str:
    return f"lpad(cast({n} % 100 as varchar), 2, '0')"


def money(n: str) -> str:
    return f"(cast({n} // 100 as varchar) || '.' || {_pennies(n)})"


def grouped_money(n: str) -> str:
    return f"(format('{{:,}}', {n} // 100) || '.' || {_pennies(n)})"


def headed(text: str) -> str:
    """Normalised header."""
    stripped = rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"
    return rf"regexp_replace(regexp_replace(lower({stripped}), '[-_/]+', ' ', 'g'), '\s+', ' ', 'g')"


DAY_TEXT = (
    "case layout when 0 then strftime(day, '%Y-%m-%d') when 1 then strftime(day, '%m/%d/%Y')"
    " else strftime(day, '%-m/%-d/%Y') end"
)

FACTS = f"""facts as (
  select l_suppkey as suppkey, cast(l_suppkey % 3 as int) as layout, l_orderkey as orderkey, o_custkey as custkey,
    l_partkey as partkey, l_linenumber as linenumber, cast(l_quantity as bigint) as qty,
    {cents('l_extendedprice')} as cost, {cents('l_extendedprice / l_quantity')} as unit,
    cast(l_quantity as bigint) * {cents('p_retailprice')} as value, cast(l_shipdate as date) as day,
    p_type as type, p_size as size
  from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey)"""

LOTS = f"""{FACTS},
lots as (
  select 'B' || suppkey as "Broker",
    case when layout = 1 then 'S' || suppkey else 'C' || custkey end as "Account",
    case when layout = 0 then lpad(cast(custkey as varchar), 8, '0') else cast(9000 + suppkey as varchar) end as "Account#",
    'P' || partkey as "Symbol", cast(qty as varchar) as "Quantity", {DAY_TEXT} as "Acquisition Date",
    {money('unit')} as "Cost per Unit",
    case when layout = 0 then {grouped_money('cost')} else {money('cost')} end as "Total Cost",
    {money('value')} as "Value", case when layout <> 1 then type end as "Type", cast(null as varchar) as "Source",
    layout, size, linenumber, suppkey, cost as cost_c, value as value_c, day, qty
  from facts)"""

COLUMNS = ", ".join(f'"{field}"' for field in FULL_FIELDS)

GRID = f"""{FACTS},
heads as (
  select distinct l_suppkey as suppkey from lineitem),
head_rows as (
  select suppkey, 0 as row_no, ['Statement of holdings'] as cells from heads
  union all select suppkey, 1, ['Acct No: draft'] from heads
  union all select suppkey, 2, ['Acct No: ' || (suppkey + 9000) || '; Currency: USD'] from heads
  union all select suppkey, 3, cast([] as varchar[]) from heads
  union all select suppkey, 4, case suppkey % 3 when 0 then ['Filter', 'Setting']
    when 1 then ['Account', 'Net Account Value', 'Total Gain $'] else ['Holdings by security'] end from heads
  union all select suppkey, 5, case suppkey % 3 when 0 then ['Currency', 'USD']
    when 1 then ['S' || suppkey, '0', '0'] else ['Prepared for clients'] end from heads
  union all select suppkey, 6, case suppkey % 3 when 0 then ['', ''] when 1 then [' '] else cast([] as varchar[]) end from heads
  union all select suppkey, 7, case suppkey % 3 when 0 then {_list(FLAT_HEADER)}
    when 1 then {_list(HYBRID_HEADER)} else {_list(GROUP_HEADER)} end from heads),
blocked as (select *, 1 + orderkey // {ORDERS_PER_BLOCK} as block from facts),
lot_rows as (
  select suppkey, block, partkey, 1 as kind, orderkey, linenumber, cost,
    case layout
      when 0 then ['C' || custkey, lpad(cast(custkey as varchar), 8, '0'), 'P' || partkey, cast(qty as varchar),
        {DAY_TEXT}, {money('unit')}, {grouped_money('cost')}, {money('value')}, type]
      when 1 then ['', {DAY_TEXT}, cast(qty as varchar), {money('unit')}, {money('cost')}, {money('value')}]
      else ['C' || custkey, '', cast(qty as varchar), {DAY_TEXT}, {money('unit')}, {money('cost')}, {money('value')}, type]
    end as cells
  from blocked),
sums as (
  select suppkey, layout, block, partkey, type, cast(sum(qty) as bigint) as qty, cast(sum(cost) as bigint) as cost,
    cast(sum(value) as bigint) as value
  from blocked where layout <> 0 group by all),
edges as (select distinct suppkey, layout, block from blocked where layout <> 0),
body as (
  select * from lot_rows union all select * from lot_rows where linenumber = 1
  union all select suppkey, block, partkey, 0, 0, 0, cost, case layout
    when 1 then ['P' || partkey, '', cast(qty as varchar), '', {money('cost')}, {money('value')}]
    else ['Holding ' || partkey, 'P' || partkey, cast(qty as varchar), '', '', {money('cost')}, {money('value')}, type] end
  from sums
  union all select suppkey, block, -1, 0, 0, 0, 0, ['Mutual Fund', '', '', '', '', '', '', ''] from edges where layout = 2
  union all select suppkey, block, 9000000000000000000, 0, 0, 0, 0, case layout
    when 1 then ['TOTAL', '', '', '', '', ''] else ['Total', '', '', '', '', '', '', ''] end from edges),
numbered as (
  select suppkey, block, block * 4294967296 + row_number() over (partition by suppkey, block
    order by partkey, kind, orderkey, linenumber, cost, array_to_string(cells, '|')) as row_no, cells
  from body),
grid as (
  select suppkey, '/reports/B' || suppkey || '_2002.csv' as file, 0 as block, cast(row_no as bigint) as row_no, cells from head_rows
  union all
  select suppkey, '/reports/B' || suppkey || '_2002.csv', block, cast(row_no as bigint), cells from numbered)"""

SEGMENTS = rf"""{GRID},
flagged as (
  select *, not regexp_matches(array_to_string(cells, ''), '\S') as is_blank from grid),
islands as (
  select *, sum(case when is_blank then 1 else 0 end) over (partition by file order by row_no) as island from flagged),
starts as (
  select *, min(case when not is_blank and len(cells) <> 1 then row_no end) over (partition by file, island) as table_row
  from islands),
segs as materialized (
  select suppkey, file, block, row_no, cells, table_row,
    first_value(cells) over (partition by file, table_row order by row_no) as header
  from starts where not is_blank and row_no >= table_row)"""

#: Headers of the raw tables by their first two cells; the second kind of report names two columns alike.
_RAW_HEADERS = {
    "Filter|Setting": ["Filter", "Setting"],
    "Account|Account #": FLAT_HEADER,
    "Account|Net Account Value": ["Account", "Net Account Value", "Total Gain $"],
    "Symbol|Date Acquired": ["Symbol", "Date Acquired", "Qty #", "Price Paid $", "Value $", "Value $#2"],
    "Description|Symbol": GROUP_HEADER,
}


def _united_columns() -> str:
    names = dict.fromkeys(name for header in _RAW_HEADERS.values() for name in header)
    cases = {
        name: " ".join(
            f"when '{key}' then coalesce(cells[{header.index(name) + 1}], '')" for key, header in _RAW_HEADERS.items() if name in header
        )
        for name in names
    }
    return ", ".join(f"case header[1] || '|' || header[2] {case} end as \"{name}\"" for name, case in cases.items())


_HOLDERS = """select 'C' || c_custkey || chr(10) || 'sub, "x"' as "Account", ' ' || c_mktsegment || ' ' as "Symbol",
  cast(cast(c_acctbal as decimal(18,2)) as varchar) as "Value" from customer"""

MAPPING = (
    "entries(ord, raw, canonical) as (values "
    + ", ".join(f"({i}, {_text(v)}, {_text(c)})" for i, (v, c) in enumerate(mapping_entries(DEFAULT_SYNONYMS)))
    + f"),\nmapping as (select {headed('raw')} as variant, arg_max(canonical, ord) as canonical from entries group by 1)"
)

PAIRS = rf"""{GRID}, {MAPPING},
lines as (select file, row_no, regexp_split_to_array(array_to_string(cells, ','), '[;,]') as parts from grid),
segments as (select file, row_no, unnest(generate_series(0, len(parts) - 1)) as seg_no, unnest(parts) as segment from lines),
signed as (
  select *, case when contains(segment, ':') then strpos(segment, ':') else strpos(segment, '=') end as spot from segments),
pairs as (
  select file, row_no, cast(seg_no as bigint) as seg_no, canonical as field,
    regexp_replace(substr(segment, spot + 1), '^\s+|\s+$', '', 'g') as value
  from signed join mapping on variant = {headed('substr(segment, 1, spot - 1)')}
  where spot > 0 and regexp_matches(substr(segment, spot + 1), '\S'))"""

SERIES = """days as (
  select user_id as series_id, cast(date_diff('day', date '2024-01-01', cast(ts as date)) as bigint) as pos,
    cast(sum(cast(value as decimal(18,2))) as double) as total,
    cast(sum(case when event_type in ('click', 'purchase') then cast(value as decimal(18,2)) end) as double) as part
  from events group by all),
pr as (
  select series_id, pos, part / nullif(lag(part) over (partition by series_id order by pos), 0) - 1 as r
  from days where part is not null),
br as (
  select series_id, pos, (total / nullif(lag(total) over (partition by series_id order by pos), 0) - 1)
    * case when series_id % 2 = 0 then 100 else 1 end as r
  from days)"""

GAPPY = "gp as (select series_id, pos, case when pos % 7 <> 3 then r end as r from pr)"


def growth(initial: str, final: str, years: str) -> str:
    return (
        f"case when {initial} > 0 and {final} > 0 and {years} > 0"
        f" then round(pow(({final}) / ({initial}), 1.0 / ({years})) - 1, 6) end"
    )


def _years(day: str, as_of: str) -> str:
    return f"(date_diff('day', {day}, date '{as_of}') / 365.25)"


_BETA = "case when var_samp(b) > {floor} then round(covar_samp(p, b) / var_samp(b), 6) end"

_DIRTY = """dirty as (
  select c_custkey, cast(cast(c_acctbal as decimal(18,2)) as varchar) as plain from customer),
texts as (
  select c_custkey, plain, case c_custkey % 12
    when 0 then '1,' || lpad(cast(c_custkey % 1000 as varchar), 3, '0') || '.50'
    when 1 then '$' || plain when 2 then plain || 'd' when 3 then 'nan' when 4 then ' ' || plain || ' '
    when 5 then cast(c_custkey as varchar) || 'e2' when 6 then '' when 7 then '(' || plain || ')'
    when 8 then plain || '%' when 9 then '-' when 10 then '+' || cast(c_custkey as varchar) || '.'
    else plain end as text from dirty)"""

_NUMBER = """case c_custkey % 12 {grouped} when 4 then cast(plain as double) when 5 then c_custkey * 100.0
    when 10 then cast(c_custkey as double) when 11 then cast(plain as double) end"""

_SPOTTY = f"""{LOTS},
spotty as (
  select * replace (case when size % 4 = 0 then null else "Type" end as "Type") from lots where size <> 7)"""

_POSITIONS = f"""{LOTS},
positions as (
  select "Broker", case when size % 9 <> 0 then size / 10.0 end as beta,
    case when size % 7 = 0 then -value_c else value_c end / 100.0 as weight from lots)"""

_HEADINGS = ", ".join(map(_text, CATEGORY_HEADINGS))

ORACLES: dict[str, str] = {
    "lots_with_metrics": f"""with {LOTS}
select {COLUMNS}, round({_years('day', AS_OF)}, 6) as "Years Held",
  {growth('cost_c / 100.0', 'value_c / 100.0', _years('day', AS_OF))} as "CAGR" from lots""",
    "cagr_rows": f"""with {FACTS}
select orderkey, partkey, suppkey, linenumber, cost,
  {growth('cost / 100.0', 'value / 100.0', '((linenumber - 2) / 2.0)')} as cagr from facts""",
    "cagr_coerced": f"""with {FACTS}
select orderkey, partkey, suppkey, cost, case when linenumber <> 3 then
  {growth('cost / 100.0', 'value / 100.0', '(linenumber + 1)')} end as cagr from facts""",
    "years_held": """select l_orderkey, l_partkey, l_linenumber,
  round(floor(epoch(timestamp '1998-07-01 00:00:00' - (l_shipdate + to_hours(l_linenumber - 1))) / 86400) / 365.25, 6) as years
from lineitem""",
    "initial_value": f"""with {FACTS}
select orderkey, partkey, suppkey, linenumber,
  round(case when linenumber = 2 then qty * (unit / 100.0) else cost / 100.0 end, 2) as initial from facts""",
    "numeric_coerce": f"""with {_DIRTY}
select c_custkey, text, {_NUMBER.format(grouped="when 0 then 1000 + c_custkey % 1000 + 0.5")} as number from texts""",
    "numeric_strict": f"""with {_DIRTY}
select c_custkey, text, {_NUMBER.format(grouped="")} as number from texts""",
    "date_coerce": """select o_orderkey, case o_orderkey % 9 when 7 then null when 8 then null
  when 3 then case when day(o_orderdate) <= 12
    then strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)), '%Y-%m-%d')
    else strftime(o_orderdate, '%Y-%m-%d') end
  else strftime(o_orderdate, '%Y-%m-%d') end as day from orders""",
    "nan_to_null": "select c_custkey, case when c_custkey % 5 > 2 then c_mktsegment end as text from customer",
    "header_normalise": """select p_partkey,
  replace(lower(p_name), '_', ' ') || ' ' || lower(p_brand) || ' (' || lower(p_type) || ')' as name from part""",
    "mapping_load": """select lower(p_name) as variant, 'F' || max(p_partkey) as canonical from part group by lower(p_name)""",
    "blank_rows": f"with {SEGMENTS} select file, row_no, is_blank from flagged",
    "table_segments": f"with {SEGMENTS} select file, row_no, table_row from segs",
    "table_headers": f"""with {SEGMENTS},
tabs as (select file, table_row, any_value(array_to_string(header, '|')) as header,
  cast(count(*) - 1 as bigint) as n_rows from segs group by all),
counted as (select *, row_number() over (partition by file order by table_row) as table_no from tabs)
select file, table_no, table_row, header, n_rows from counted where n_rows > 0""",
    "align_rows": f"""with {SEGMENTS},
ragged as (select *, case when len(cells) > 4 and row_no % 5 = 0 then cells[1:len(cells) - 2] || ['', '']
  else cells end as fixed from segs where row_no > table_row)
select file, row_no, array_to_string(fixed, '|') as cells from ragged""",
    "table_samples": f"""with {SEGMENTS},
ranked as (select *, row_number() over (partition by file, table_row order by row_no) as sample_no
  from segs where row_no > table_row)
select file, table_row, sample_no, array_to_string(cells, '|') as cells from ranked where sample_no <= 2""",
    "sheet_filter": f"with {GRID} select file, 'Layout 1' as sheet, row_no from grid where suppkey % 3 = 1",
    "header_mapping": f"""with {SEGMENTS}, {MAPPING},
tabs as (select file, table_row, any_value(header) as header, count(*) as n from segs group by all),
counted as (select *, row_number() over (partition by file order by table_row) as table_no from tabs),
cols as (select file, table_no, unnest(header) as raw_name, unnest(generate_series(0, len(header) - 1)) as pos
  from counted where n > 1),
named as (select file, table_no, cast(pos as bigint) as pos, raw_name, coalesce(canonical, raw_name) as name
  from cols left join mapping on variant = {headed('raw_name')})
select *, min(pos) over (partition by file, table_no, name) as first_pos,
  max(pos) over (partition by file, table_no, name) as last_pos from named""",
    "kv_pairs": f"with {PAIRS} select * from pairs",
    "kv_last_wins": f"with {PAIRS} select file, field, arg_max(value, row_no * 1000 + seg_no) as value from pairs group by all",
    "kv_fill": f"""with {LOTS}
select '/reports/B' || suppkey || '_2002.csv' as file, "Account#" as account_no,
  cast(sum(case when linenumber = 1 then 2 else 1 end) as bigint) as n from lots group by all""",
    "kv_fallback_rows": """select 'K' || c_custkey as "Broker", cast(null as varchar) as "Account", 'A' || c_custkey as "Account#",
  'T' || c_nationkey as "Symbol", cast(null as varchar) as "Quantity", cast(null as varchar) as "Acquisition Date",
  cast(null as varchar) as "Cost per Unit", cast(null as varchar) as "Total Cost",
  cast(cast(c_acctbal as decimal(18,2)) as varchar) as "Value", cast(null as varchar) as "Type",
  cast(null as varchar) as "Source" from customer""",
    "account_summary": """select distinct '/reports/B' || l_suppkey || '_2002.csv' as file,
  case when l_suppkey % 3 = 1 then 'S' || l_suppkey end as account from lineitem""",
    "account_fill": f"""with {LOTS}
select '/reports/B' || suppkey || '_2002.csv' as file, "Account",
  cast(sum(case when linenumber = 1 then 2 else 1 end) as bigint) as n from lots group by all""",
    "broker_from_path": f"with {GRID} select 'B' || suppkey as broker, count(*) as n_rows from grid group by all",
    "classify_tables": f"""with {SEGMENTS}
select file, table_row, table_row = 4 and suppkey % 3 = 1 as is_summary, table_row = 7 and suppkey % 3 <> 0 as is_holdings,
  cast(count(*) - 1 as bigint) as n_rows from segs group by all""",
    "symbol_group_detect": f"""with {SEGMENTS}
select distinct file, table_row, table_row = 7 and suppkey % 3 = 2 as is_group from segs""",
    "detect_structure": """select distinct '/reports/B' || l_suppkey || '_2002.csv' as file,
  case when l_suppkey % 3 = 1 then 'hybrid' else 'standard' end as structure from lineitem""",
    "valid_tables": f"""with {SEGMENTS}
select file, table_row, cast(count(*) - 1 as bigint) as n_rows from segs where table_row = 7 group by all""",
    "route_tables": f"""with {SEGMENTS}
select file, table_row, case suppkey % 3 when 0 then 'plain' when 1 then 'hybrid' else 'group' end as route,
  cast(count(*) - 1 as bigint) as n_rows from segs where table_row = 7 group by all""",
    "hybrid_realign": rf"""with {SEGMENTS},
carried as (select *, last_value(case when regexp_matches(cells[1], '\S')
    and not regexp_full_match(trim(cells[1]), '\d{{1,2}}/\d{{1,2}}/\d{{4}}') then trim(cells[1]) end ignore nulls)
    over (partition by file order by row_no) as symbol
  from segs where suppkey % 3 = 1 and table_row = 7 and row_no > 7)
select file, row_no, array_to_string([symbol] || cells[2:], '|') as cells from carried where cells[1] = ''""",
    "symbol_group_realign": f"""with {SEGMENTS},
carried as (select *, last_value(nullif(cells[2], '') ignore nulls) over (partition by file order by row_no) as symbol
  from segs where suppkey % 3 = 2 and table_row = 7 and row_no > 7)
select file, row_no, array_to_string([cells[1], symbol] || cells[3:], '|') as cells from carried
where cells[2] = '' and symbol is not null and lower(trim(cells[1])) not in ({_HEADINGS})""",
    "category_filter": f"""with {GRID}
select file, cells[1] as heading, count(*) as n from grid where lower(trim(cells[1])) in ({_HEADINGS}) group by all""",
    "canonical_projection": f"""with {LOTS}
select {COLUMNS} from lots union all select {COLUMNS} from lots where linenumber = 1""",
    "union_tables": """select 'C' || c_custkey as "Account", cast(cast(c_acctbal as decimal(18,2)) as varchar) as "Value" from customer
union all select 'S' || s_suppkey, cast(cast(s_acctbal as decimal(18,2)) as varchar) from supplier""",
    "union_missing_columns": """select 'C' || c_custkey as "Account", cast(cast(c_acctbal as decimal(18,2)) as varchar) as "Value",
  c_mktsegment as "Type" from customer
union all select 'S' || s_suppkey, cast(cast(s_acctbal as decimal(18,2)) as varchar), null from supplier""",
    "union_by_name": f"""with {SEGMENTS}
select file, row_no, {_united_columns()} from segs where row_no > table_row""",
    "blank_to_null": f"""with {_SPOTTY}
select {COLUMNS} from spotty union all select {', '.join(['null'] * len(FULL_FIELDS))} from lots where size = 7""",
    "drop_all_null": f"with {_SPOTTY} select {COLUMNS} from spotty",
    "dedupe_lots": f"""with {LOTS}
select "Account", "Symbol", "Type", min(qty) as first_quantity from lots group by all""",
    "clean_lots": f"with {_SPOTTY} select distinct {COLUMNS} from spotty",
    "append_dedupe": f"with {LOTS} select distinct {COLUMNS} from lots",
    "append_roundtrip": _HOLDERS,
    "manifest_ingest": _HOLDERS,
    "ingest_flat": f"with {LOTS} select distinct {COLUMNS} from lots where layout = 0",
    "ingest_hybrid": f"with {LOTS} select distinct {COLUMNS} from lots where layout = 1",
    "ingest_symbol_group": f"with {LOTS} select distinct {COLUMNS} from lots where layout = 2",
    "ingest_all": f"""with {LOTS}
select distinct {COLUMNS}, round({_years('day', AS_OF)}, 6) as "Years Held",
  {growth('cost_c / 100.0', 'value_c / 100.0', _years('day', AS_OF))} as "CAGR" from lots""",
    "ingest_audit": f"""with {LOTS},
lines as (select suppkey, layout, count(*) as n, count(distinct ({COLUMNS.replace('"Source"', "0")})) as distinct_lots,
  cast(sum(case when linenumber = 1 then 2 else 1 end) as bigint) as printed from lots group by all),
marks as (select suppkey, count(distinct (orderkey // {ORDERS_PER_BLOCK}, partkey)) as summaries,
  count(distinct orderkey // {ORDERS_PER_BLOCK}) as blocks from facts group by all)
select '/reports/B' || suppkey || '_2002.csv' as file, case layout when 1 then 'hybrid' else 'standard' end as structure,
  cast(case layout when 2 then 1 else 2 end as bigint) as tables, cast(0 as bigint) as empty_tables,
  cast(printed + case layout when 0 then 1 when 1 then 1 + summaries + blocks else summaries + 2 * blocks end as bigint)
    as table_rows,
  cast(case layout when 0 then 9 when 1 then 7 else 8 end as bigint) as renamed_columns,
  printed as rows_extracted, distinct_lots as lots, cast(0 as bigint) as blank_rows_removed,
  printed - distinct_lots as duplicates_removed, cast(1 as bigint) as key_values
from lines join marks using (suppkey)""",
    "grid_scan_csv": f"""with {GRID}
select 'B' || suppkey || '_2002' as report, cast(block as bigint) as block,
  cast(row_number() over (partition by suppkey, block order by row_no) - 1 as bigint) as row_no,
  case when regexp_matches(array_to_string(cells, ''), '.') or len(cells) <> 1 then array_to_string(cells, '|') else '' end as cells
from grid""",
    "workbook_scan": f"""with {GRID},
placed as (select suppkey, block, cells, row_number() over (partition by suppkey, block order by row_no) - 1 as place from grid),
sheets as (select *, place // {SHEET_ROWS} as sheet, max(len(cells)) over (partition by suppkey, block, place // {SHEET_ROWS}) as width from placed)
select 'B' || suppkey || '_2002' as report, cast(block as bigint) as block, 'S' || (sheet + 1) as sheet,
  cast(place % {SHEET_ROWS} as bigint) as row_no, array_to_string(list_resize(cells, width, ''), '|') as cells
from sheets""",
    "stream_ingest": _HOLDERS,
    "flat_scan": f"with {LOTS} select {COLUMNS} from lots",
    "beta_strict": f"""with {SERIES},
both_sides as (select series_id, p.r as p, b.r as b from (from pr where r is not null) p
  full join (from br where r is not null) b using (series_id, pos))
select series_id, count(p) as n_p, count(b) as n_b,
  case when count(p) = count(b) and count(*) = count(p) and count(*) >= 2 then {_BETA.format(floor='0')} end as beta
from both_sides group by all""",
    "beta_paired": f"""with {SERIES}, {GAPPY},
pairs as (select series_id, gp.r as p, br.r as b from gp join br using (series_id, pos))
select series_id, count(p + b) as n, case when count(p + b) >= 2 then
  case when var_samp(b) filter (p is not null) > 1e-18
    then round(covar_samp(p, b) / (var_samp(b) filter (p is not null)), 6) end end as beta
from pairs group by all""",
    "beta_truncated": f"""with {SERIES}, {GAPPY},
p as (select series_id, r, row_number() over (partition by series_id order by pos) as rank from gp where r is not null),
b as (select series_id, r, row_number() over (partition by series_id order by pos) as rank from br where r is not null),
pairs as (select series_id, p.r as p, b.r as b from p join b using (series_id, rank))
select series_id, count(*) as n, case when count(*) >= 2 then {_BETA.format(floor='0')} end as beta from pairs group by all""",
    "returns_scale": f"""with {SERIES},
m as (select series_id, avg(abs(r)) as mean from br group by all)
select series_id, pos, round(case when mean > 1 then r / 100 else r end, 6) as r from br join m using (series_id)""",
    "beta_broadcast": f"""with {FACTS}, {SERIES},
p as (select r, row_number() over (order by series_id, pos) as rank from pr where r is not null),
b as (select r, row_number() over (order by series_id, pos) as rank from br where r is not null),
pairs as (select p.r as p, b.r as b from p join b using (rank)),
beta as (select {_BETA.format(floor='0')} as beta from pairs)
select orderkey, partkey, suppkey, linenumber, cost, (select beta from beta) as "Beta" from facts""",
    "beta_holdings": f"""with {_POSITIONS}
select "Broker", round(sum(weight * beta) / sum(weight), 6) as beta from positions
where weight > 0 and beta is not null group by all
union all select 'all', round(sum(weight * beta) / sum(weight), 6) from positions where weight > 0 and beta is not null""",
    "cagr_series": f"""with {SERIES},
ends as (select series_id, count(*) as n, arg_min(total, pos) as a, arg_max(total, pos) as z from days group by all)
select series_id, n, case when n >= 2 then {growth('a', 'z', '(n - 1)')} end as cagr from ends""",
    "cagr_dated_values": f"""with {SERIES},
ends as (select series_id, count(*) as n, min(pos) as first_pos, max(pos) as last_pos, arg_min(total, pos) as a,
  arg_max(total, pos) as z from days where total > 1 group by all),
spans as (select *, case when series_id % 3 <> 0 and last_pos > first_pos then (last_pos - first_pos) * 400 / 365.25
  else n / 12.0 end as years from ends)
select series_id, n, round(years, 6) as years, {growth('a', 'z', 'years')} as cagr from spans""",
    "metrics_reports": f"""with {_POSITIONS}, {SERIES}, {GAPPY},
scaled as (select series_id, case when avg(abs(r)) > 1 then 0.01 else 1 end as s from gp group by all),
scaled_b as (select series_id, case when avg(abs(r)) > 1 then 0.01 else 1 end as s from br group by all),
pairs as (select series_id, gp.r * scaled.s as p, br.r * scaled_b.s as b from gp join br using (series_id, pos)
  join scaled using (series_id) join scaled_b using (series_id)
  where series_id % 2 = 0 and gp.r is not null and br.r is not null),
by_series as (select 'B' || series_id as portfolio, case when count(*) >= 2 and var_samp(b) > 1e-18
  then covar_samp(p, b) / var_samp(b) end as beta from pairs group by all),
by_weight as (select "Broker" as portfolio, sum(case when weight > 0 then weight * beta end)
  / nullif(sum(case when weight > 0 and beta is not null then weight end), 0) as beta from positions group by all),
ends as (select series_id, count(*) as n, min(pos) as first_pos, max(pos) as last_pos, arg_min(total, pos) as a,
  arg_max(total, pos) as z from days where total > 1 group by all),
spans as (select *, case when series_id % 3 <> 0 and last_pos > first_pos then (last_pos - first_pos) * 400 / 365.25
  else n / 12.0 end as years from ends),
grown as (select 'B' || series_id as portfolio, {growth('a', 'z', 'years')} as cagr from spans),
known as (select 'B' || series_id as portfolio from br union select "Broker" from positions),
found as (select known.portfolio, s.beta as by_series, w.beta as by_weight, cagr from known
  left join by_series s using (portfolio) left join by_weight w using (portfolio) left join grown using (portfolio))
select portfolio, round(coalesce(by_series, by_weight), 6) as beta,
  case when by_series is not null then 'timeseries' when by_weight is not null then 'holdings' end as beta_method,
  cagr, coalesce(by_series, by_weight, cagr) is not null as ok from found""",
    "metrics_report": f"""with {SERIES},
scales as (select case when (select avg(abs(r)) from pr) > 1 then 0.01 else 1 end as sp,
  case when (select avg(abs(r)) from br) > 1 then 0.01 else 1 end as sb),
pairs as (select pr.r * sp as p, br.r * sb as b from pr join br using (series_id, pos), scales
  where pr.r is not null and br.r is not null),
market as (select pos, cast(sum(total) as decimal(18,2)) as v from days group by all),
ends as (select arg_min(v, pos) as a, arg_max(v, pos) as z, (max(pos) - min(pos)) * 30 / 365.25 as years from market)
select round(covar_samp(p, b) / var_samp(b), 6) as beta, 'timeseries' as beta_method,
  (select {growth('cast(a as double)', 'cast(z as double)', 'years')} from ends) as cagr, true as ok from pairs""",
}
