"""Scalar functions over strings, numbers, times, JSON, arrays and maps."""

from __future__ import annotations

from fernweft.plans.catalog import Catalog

CATALOG = Catalog()

CATALOG.add_sql(
    "f1_hashes",
    "documents",
    "select doc_id, cast(length(text) as bigint) as chars, cast(octet_length(text) as bigint) as bytes, md5(text) as m, sha2(text, 256) as s from {documents}",
    "select doc_id, length(text) as chars, strlen(text) as bytes, md5(text) as m, sha256(text) as s from documents",
)
CATALOG.add_sql(
    "f2_regexp_replace",
    "documents",
    r"select doc_id, md5(regexp_replace(text, '[0-9]+', '#')) as digits, md5(regexp_replace(text, '[ \\t\\n]+', ' ')) as spaces from {documents}",
    r"select doc_id, md5(regexp_replace(text, '[0-9]+', '#', 'g')) as digits, md5(regexp_replace(text, '[ \t\n]+', ' ', 'g')) as spaces from documents",
)
CATALOG.add_sql("f3_lower_trim", "documents", "select doc_id, md5(lower(text)) as low, md5(trim(text)) as trimmed, left(text, 7) as head, right(text, 7) as tail from {documents}")
CATALOG.add_sql(
    "f4_upper",
    "documents",
    "select doc_id, md5(upper(replace(text, 'ß', 'ss'))) as up, initcap(lang) as cap from {documents}",
    "select doc_id, md5(upper(replace(text, 'ß', 'ss'))) as up, upper(lang[1]) || lang[2:] as cap from documents",
)
CATALOG.add_sql(
    "f5_tokens",
    "documents",
    "select word, count(*) as n from (select explode(split(lower(text), '[^a-z]+')) as word from {documents}) where word <> '' group by word",
    "select word, count(*) as n from (select unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as word from documents) where word <> '' group by word",
)
CATALOG.add_sql(
    "f6_url_host",
    "pages",
    "select page_id, parse_url(url, 'HOST') as host from {pages}",
    "select page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host from pages",
)
CATALOG.add_sql(
    "f7_calendar",
    "orders",
    """select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, weekofyear(o_orderdate) as w, dayofweek(o_orderdate) as d,
              datediff(o_orderdate, date '1995-01-01') as days, cast(cast(date_trunc('month', o_orderdate) as date) as string) as month_start from {orders}""",
    """select o_orderkey, cast(year(o_orderdate) as int) as y, cast(month(o_orderdate) as int) as m, cast(weekofyear(o_orderdate) as int) as w,
              cast(dayofweek(o_orderdate) + 1 as int) as d, cast(datediff('day', date '1995-01-01', cast(o_orderdate as date)) as int) as days,
              cast(cast(date_trunc('month', o_orderdate) as date) as string) as month_start from orders""",
)
CATALOG.add_sql(
    "f8_arithmetic",
    "lineitem",
    """select l_orderkey, l_partkey, l_linenumber, floor(l_quantity / 7) * 1.0D as fl, mod(l_partkey, 13) as md, cast(l_partkey div 13 as bigint) as dv, abs(l_discount - 0.05D) as ab,
              sign(l_tax - 0.04D) as sg, ceil(l_quantity / 7) * 1.0D as ce from {lineitem}""",
    """select l_orderkey, l_partkey, l_linenumber, floor(l_quantity / 7) * 1.0::double as fl, mod(l_partkey, 13) as md, cast(l_partkey // 13 as bigint) as dv, abs(l_discount - 0.05::double) as ab,
              cast(sign(l_tax - 0.04::double) as double) as sg, ceil(l_quantity / 7) * 1.0::double as ce from lineitem""",
)
CATALOG.add_sql(
    "f8_rounding",
    "lineitem",
    """select l_orderkey, l_partkey, l_linenumber, cast(round(cast(l_extendedprice as decimal(12,2)), 1) as double) as up,
              cast(bround(cast(l_extendedprice as decimal(12,2)), 1) as double) as even from {lineitem}""",
    """select l_orderkey, l_partkey, l_linenumber, cast(round(cast(l_extendedprice as decimal(12,2)), 1) as double) as up,
              cast(case when abs(cents) % 10 = 5 then (cents - 5) / 10 + abs((cents - 5) // 10) % 2 else round(cents / 10) end as double) / 10 as even
       from (select *, cast(cast(l_extendedprice as decimal(12,2)) * 100 as bigint) as cents from lineitem)""",
)
CATALOG.add_sql(
    "f9_json_path",
    "events",
    "select event_id, cast(get_json_object(props, '$.k') as int) as k from {events}",
    "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events",
)
CATALOG.add_sql(
    "f10_json_struct",
    "events",
    "select from_json(props, 'k int').k as k, to_json(named_struct('n', count(*))) as js, count(variant_get(parse_json(props), '$.k', 'int')) as n from {events} group by 1",
    "select cast(json_extract_string(props, '$.k') as int) as k, '{\"n\":' || count(*) || '}' as js, count(*) as n from events group by 1",
)
CATALOG.add_sql(
    "f10_json_tuple",
    "events",
    "select event_id, k, missing from {events} lateral view json_tuple(props, 'k', 'none') t as k, missing",
    "select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.none') as missing from events",
)
CATALOG.add_sql(
    "f11_arrays_zip",
    "nation",
    """select n_nationkey, zipped[1].a as a, zipped[1].b as b, size(zipped) as n
       from (select n_nationkey, arrays_zip(a, b) as zipped from (select n_nationkey, array(n_name, 'x') as a, array(1, n_regionkey, 3) as b from {nation}))""",
    "select n_nationkey, 'x' as a, n_regionkey as b, 3 as n from nation",
)
CATALOG.add_sql(
    "f11_arrays",
    "embeddings",
    """select vec_id, size(filter(embedding, x -> x > 0)) as positive, exists(embedding, x -> x > 0.3) as strong, array_position(transform(slice(embedding, 1, 5), x -> x > 0), true) as first,
              size(array_intersect(sequence(1, 6), array(label, label + 2))) as common, element_at(embedding, 2) as second, array_max(embedding) as top from {embeddings}""",
    """select vec_id, cast(len(list_filter(embedding, lambda x: x > 0)) as int) as positive, list_max(embedding) > 0.3 as strong,
              cast(coalesce(list_position(list_transform(embedding[1:5], lambda x: x > 0), true), 0) as bigint) as first,
              cast(len(list_intersect([1, 2, 3, 4, 5, 6], [label, label + 2])) as int) as common, embedding[2] as second, list_max(embedding) as top from embeddings""",
)
CATALOG.add_sql(
    "f12_maps",
    "nation",
    """select n_nationkey, m['name'] as name, array_join(array_sort(map_keys(m)), ',') as keys, array_join(array_sort(map_values(map_filter(m, (k, v) -> k <> 'name'))), ',') as rest,
              transform_values(m, (k, v) -> upper(v))['key'] as up from (select n_nationkey, map('name', n_name, 'key', concat('k', n_regionkey)) as m from {nation})""",
    "select n_nationkey, n_name as name, 'key,name' as keys, 'k' || n_regionkey as rest, 'K' || n_regionkey as up from nation",
)
CATALOG.add_sql(
    "f12_map_pairs",
    "nation",
    """select n_nationkey, array_join(array_sort(transform(map_entries(m), e -> concat(e.key, '=', e.value))), ',') as entries, map_zip_with(m, w, (k, a, b) -> concat(a, b))['key'] as pair
       from (select n_nationkey, map('name', n_name, 'key', concat('k', n_regionkey)) as m, map('key', 'z', 'more', 'y') as w from {nation})""",
    "select n_nationkey, 'key=k' || n_regionkey || ',name=' || n_name as entries, 'k' || n_regionkey || 'z' as pair from nation",
)
CATALOG.add_sql(
    "f13_soundex",
    "nation",
    "select n_nationkey, soundex(word) as sound from (select n_nationkey, element_at(array('Robert', 'Rupert', 'Tymczak', 'Honeyman'), n_regionkey % 4 + 1) as word from {nation})",
    "select n_nationkey, ['R163', 'R163', 'T522', 'H555'][n_regionkey % 4 + 1] as sound from nation",
)
CATALOG.add_sql(
    "f13_strings",
    "part",
    """select p_partkey, split_part(p_name, ' ', 1) as first, levenshtein(p_brand, p_type) as dist, translate(p_brand, 'Ba', 'xy') as tr, lpad(cast(p_size as string), 4, '0') as padded,
              concat_ws('-', p_brand, p_type) as both, reverse(p_brand) as back, repeat('z', p_size % 4) as zs, instr(p_type, 'E') as at, array_join(regexp_extract_all(p_name, '[0-9]', 0), '') as digits from {part}""",
    """select p_partkey, split_part(p_name, ' ', 1) as first, cast(levenshtein(p_brand, p_type) as int) as dist, translate(p_brand, 'Ba', 'xy') as tr, lpad(cast(p_size as varchar), 4, '0') as padded,
              concat_ws('-', p_brand, p_type) as both, reverse(p_brand) as back, repeat('z', p_size % 4) as zs, cast(instr(p_type, 'E') as int) as at, array_to_string(regexp_extract_all(p_name, '[0-9]', 0), '') as digits from part""",
)
CATALOG.add_sql(
    "f14_dates",
    "orders",
    """select o_orderkey, cast(add_months(cast(o_orderdate as date), 1) as string) as next, cast(last_day(cast(o_orderdate as date)) as string) as last, date_format(o_orderdate, 'yyyy/MM/dd') as shown,
              cast(cast(make_date(year(o_orderdate), 2, 1) as date) as string) as feb, unix_date(cast(o_orderdate as date)) as n from {orders}""",
    """select o_orderkey, cast(cast(cast(o_orderdate as date) + interval 1 month as date) as string) as next, cast(last_day(cast(o_orderdate as date)) as string) as last, strftime(o_orderdate, '%Y/%m/%d') as shown,
              cast(make_date(year(o_orderdate), 2, 1) as varchar) as feb, cast(datediff('day', date '1970-01-01', cast(o_orderdate as date)) as int) as n from orders""",
)
CATALOG.add_sql(
    "f14_spans",
    "orders",
    """select o_orderkey, cast(months_between(date_trunc('month', o_orderdate), date '1995-01-01') as int) as months, cast(timestampdiff(hour, timestamp_ntz'1995-01-01', o_orderdate) as bigint) as hours,
              cast(make_timestamp(year(o_orderdate), 3, 1, 12, 30, 0) as timestamp_ntz) as made, quarter(o_orderdate) as q, dayofyear(o_orderdate) as doy from {orders}""",
    """select o_orderkey, cast(datediff('month', date '1995-01-01', cast(o_orderdate as date)) as int) as months, datediff('hour', timestamp '1995-01-01', o_orderdate) as hours,
              make_timestamp(year(o_orderdate), 3, 1, 12, 30, 0) as made, cast(quarter(o_orderdate) as int) as q, cast(dayofyear(o_orderdate) as int) as doy from orders""",
)
CATALOG.add_sql(
    "f15_buckets",
    "lineitem",
    "select width_bucket(l_quantity, 0, 50, 7) as bucket, count(*) as n from {lineitem} group by 1",
    "select cast(case when l_quantity < 0 then 0 when l_quantity >= 50 then 8 else floor(l_quantity / (50.0::double / 7)) + 1 end as bigint) as bucket, count(*) as n from lineitem group by 1",
)
CATALOG.add_sql(
    "f15_math",
    "lineitem",
    """select l_orderkey, l_partkey, l_linenumber, round(exp(l_discount), 9) as e, round(ln(l_quantity), 9) as lg, round(power(l_tax, 2), 9) as sq, round(sin(l_quantity), 9) as si, round(atan2(l_quantity, l_tax + 1), 9) as an,
              greatest(l_discount, l_tax) as hi, least(l_discount, l_tax) as lo, conv(cast(l_partkey as string), 10, 16) as hx from {lineitem}""",
    """select l_orderkey, l_partkey, l_linenumber, round(exp(l_discount), 9) as e, round(ln(l_quantity), 9) as lg, round(power(l_tax, 2), 9) as sq, round(sin(l_quantity), 9) as si, round(atan2(l_quantity, l_tax + 1), 9) as an,
              greatest(l_discount, l_tax) as hi, least(l_discount, l_tax) as lo, printf('%X', l_partkey) as hx from lineitem""",
)
