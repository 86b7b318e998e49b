"""Functions of the SQL dialects that Spark has no word for, as SQL functions that Catalyst inlines.

install() creates those that a statement names as temporary functions of the session. None runs Python.
A null first argument gives null, but for those in OF_NULLS, as in the dialects.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

_EUCLID = "aggregate(array_repeat(0, 92), named_struct('a', abs(a), 'b', abs(b)), (s, _) -> if(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b))).a"
_IPV4 = r"^(\\d{1,3})\\.(\\d{1,3})\\.(\\d{1,3})\\.(\\d{1,3})(/(\\d{1,2}))?$"
_ADDRESS = "aggregate(transform(split(split_part({0}, '/', 1), '[.]'), x -> cast(x as bigint)), 0L, (s, x) -> s * 256 + x)"
_DOTTED = "concat_ws('.', shiftright({0}, 24) & 255, shiftright({0}, 16) & 255, shiftright({0}, 8) & 255, {0} & 255)"
_BITS = "cast(if(contains({0}, '/'), split_part({0}, '/', 2), '32') as int)"
_MASK = "(4294967295L & shiftleft(4294967295L, 32 - {0}))"
_OBJECT, _LIST = "from_json({0}, 'map<string,variant>')", "from_json({0}, 'array<variant>')"
#: Whole months and days between dates, a month being borrowed from b's.
_AGE_MONTHS = "(year(a) - year(b)) * 12 + month(a) - month(b) - if(day(a) < day(b), 1, 0)"
_AGE_DAYS = "day(a) - day(b) + if(day(a) < day(b), day(last_day(b)), 0)"


def _part(number: str, unit: str) -> str:
    return f"if({number} = 0, null, concat({number}, if({number} = 1, ' {unit}', ' {unit}s')))"


def _sorted(m: str) -> str:
    """A map of variants as JSON text, its keys in order."""
    return f"to_json(map_from_entries(transform(array_sort(map_keys({m})), x -> struct(x, element_at({m}, x)))))"


#: name -> (parameters, result type, body)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    # numbers
    "gcd": ("a BIGINT, b BIGINT", "BIGINT", _EUCLID),
    "lcm": ("a BIGINT, b BIGINT", "BIGINT", f"if(a = 0 or b = 0, if(a is null or b is null, null, 0L), abs(a) div {_EUCLID} * abs(b))"),
    "truncate": ("x DOUBLE, d INT", "DOUBLE", "sign(x) * floor(abs(x) * power(10, d) + 1e-9) / power(10, d)"),
    "div_trunc": ("a DOUBLE, b DOUBLE", "DOUBLE", "sign(a / b) * floor(abs(a / b))"),
    "min_scale": ("s STRING", "BIGINT", "cast(length(rtrim('0', if(contains(s, '.'), split_part(s, '.', 2), ''))) as bigint)"),
    "numeric_scale": ("s STRING", "BIGINT", "cast(length(if(contains(s, '.'), split_part(s, '.', 2), '')) as bigint)"),
    "trim_scale": ("s STRING", "STRING", "if(contains(s, '.'), rtrim('.', rtrim('0', s)), s)"),
    "to_hex": ("n BIGINT", "STRING", "lower(hex(n))"),
    # text
    "quote_ident": ("s STRING", "STRING", "if(s rlike '^[a-z_][a-z0-9_$]*$', s, concat('\"', replace(s, '\"', '\"\"'), '\"'))"),
    "quote_literal": ("s STRING", "STRING", "concat(if(contains(s, chr(92)), ' E', ''), chr(39), replace(replace(s, chr(92), concat(chr(92), chr(92))), chr(39), concat(chr(39), chr(39))), chr(39))"),
    "quote_nullable": ("s STRING", "STRING", "coalesce(concat(chr(39), replace(s, chr(39), concat(chr(39), chr(39))), chr(39)), 'NULL')"),
    "string_to_array": ("s STRING, sep STRING", "ARRAY<STRING>", "if(s = '', cast(array() as array<string>), split(s, concat(chr(92), 'Q', sep, chr(92), 'E'), -1))"),
    "regexp_split_to_array": ("s STRING, p STRING", "ARRAY<STRING>", "split(s, p, -1)"),
    "strcmp": ("a STRING, b STRING", "BIGINT", "case when a = b then 0L when a < b then -1L when a > b then 1L end"),
    "substring_upto": ("s STRING, sep STRING, n INT", "STRING", "substring_index(s, sep, n)"),
    "to_ascii_text": ("s STRING", "STRING", "translate(s, 'ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy')"),
    "insert_text": ("s STRING, p INT, n INT, t STRING", "STRING", "if(p < 1 or p > length(s), s, overlay(s placing t from p for if(n < 0 or p + n > length(s), length(s), n)))"),
    # addresses
    "inet_aton": ("s STRING", "BIGINT", f"if(s rlike '{_IPV4}' and not contains(s, '/'), {_ADDRESS.format('s')}, null)"),
    "inet_ntoa": ("n BIGINT", "STRING", f"if(n between 0 and 4294967295, {_DOTTED.format('n')}, null)"),
    "is_ipv4": ("s STRING", "BOOLEAN", f"coalesce(s rlike '{_IPV4}' and not contains(s, '/') and forall(split(s, '[.]'), x -> try_cast(x as int) <= 255), false)"),
    "inet_host": ("s STRING", "STRING", "split_part(s, '/', 1)"),
    "masklen": ("s STRING", "BIGINT", f"cast({_BITS.format('s')} as bigint)"),
    "family": ("s STRING", "BIGINT", "if(contains(s, ':'), 6L, 4L)"),
    "netmask": ("s STRING", "STRING", _DOTTED.format(_MASK.format(_BITS.format("s")))),
    "hostmask": ("s STRING", "STRING", _DOTTED.format("(4294967295L ^ " + _MASK.format(_BITS.format("s")) + ")")),
    "network": ("s STRING", "STRING", "concat(" + _DOTTED.format("(" + _ADDRESS.format("s") + " & " + _MASK.format(_BITS.format("s")) + ")") + ", '/', " + _BITS.format("s") + ")"),
    "inet_broadcast": ("s STRING", "STRING", "concat(" + _DOTTED.format("(" + _ADDRESS.format("s") + " | (4294967295L ^ " + _MASK.format(_BITS.format("s")) + "))") + ", '/', " + _BITS.format("s") + ")"),
    "set_masklen": ("s STRING, n INT", "STRING", "concat(split_part(s, '/', 1), '/', n)"),
    "inet_contains": ("net STRING, s STRING", "BOOLEAN", f"({_ADDRESS.format('s')} & {_MASK.format(_BITS.format('net'))}) = ({_ADDRESS.format('net')} & {_MASK.format(_BITS.format('net'))}) and {_BITS.format('s')} >= {_BITS.format('net')}"),
    "inet_same_family": ("a STRING, b STRING", "BOOLEAN", "contains(a, ':') = contains(b, ':')"),
    # arrays
    "array_length": ("a ARRAY<BIGINT>, d INT", "BIGINT", "if(d = 1 and cardinality(a) > 0, cast(cardinality(a) as bigint), null)"),
    "array_upper": ("a ARRAY<BIGINT>, d INT", "BIGINT", "if(d = 1 and cardinality(a) > 0, cast(cardinality(a) as bigint), null)"),
    "array_lower": ("a ARRAY<BIGINT>, d INT", "BIGINT", "if(d = 1 and cardinality(a) > 0, 1L, null)"),
    "array_ndims": ("a ARRAY<BIGINT>", "BIGINT", "if(cardinality(a) > 0, 1L, null)"),
    "array_dims": ("a ARRAY<BIGINT>", "STRING", "if(cardinality(a) > 0, concat('[1:', cardinality(a), ']'), null)"),
    "array_cat": ("a ARRAY<BIGINT>, b ARRAY<BIGINT>", "ARRAY<BIGINT>", "concat(coalesce(a, cast(array() as array<bigint>)), coalesce(b, cast(array() as array<bigint>)))"),
    "array_replace": ("a ARRAY<BIGINT>, x BIGINT, y BIGINT", "ARRAY<BIGINT>", "transform(a, e -> if(e <=> x, y, e))"),
    "array_positions": ("a ARRAY<BIGINT>, x BIGINT", "ARRAY<BIGINT>", "filter(transform(a, (e, i) -> if(e <=> x, cast(i + 1 as bigint), null)), p -> p is not null)"),
    "array_fill": ("x BIGINT, n INT", "ARRAY<BIGINT>", "array_repeat(x, n)"),
    "trim_array": ("a ARRAY<BIGINT>, n INT", "ARRAY<BIGINT>", "slice(a, 1, cardinality(a) - n)"),
    "array_set_element": ("a ARRAY<BIGINT>, i INT, x BIGINT", "ARRAY<BIGINT>", "transform(sequence(1, greatest(i, cardinality(a))), k -> if(k = i, x, get(a, k - 1)))"),
    "array_to_text": ("a ARRAY<BIGINT>, sep STRING, nulls STRING", "STRING", "array_join(transform(a, x -> cast(x as string)), sep, nulls)"),
    "num_nulls": ("a ARRAY<STRING>", "BIGINT", "cast(cardinality(filter(a, x -> x is null)) as bigint)"),
    "num_nonnulls": ("a ARRAY<STRING>", "BIGINT", "cast(cardinality(filter(a, x -> x is not null)) as bigint)"),
    # dates and times
    "make_time_text": ("h INT, m INT, s DOUBLE", "STRING", "concat(lpad(h, 2, '0'), ':', lpad(m, 2, '0'), ':', lpad(cast(floor(s) as int), 2, '0'))"),
    "makedate": ("y INT, n INT", "DATE", "if(n > 0, date_add(make_date(y, 1, 1), n - 1), null)"),
    "time_to_sec": ("t STRING", "BIGINT", "if(startswith(t, '-'), -1L, 1L) * aggregate(transform(split(ltrim('-', t), ':'), x -> cast(x as bigint)), 0L, (s, x) -> s * 60 + x)"),
    "sec_to_time": ("n BIGINT", "STRING", "concat(if(n < 0, '-', ''), lpad(abs(n) div 3600, greatest(2, length(cast(abs(n) div 3600 as string))), '0'), ':', lpad(abs(n) div 60 % 60, 2, '0'), ':', lpad(abs(n) % 60, 2, '0'))"),
    "age_months": ("a TIMESTAMP_NTZ, b TIMESTAMP_NTZ", "BIGINT", "cast(timestampdiff(MONTH, b, a) as bigint)"),
    "age_text": ("a DATE, b DATE", "STRING", f"coalesce(nullif(concat_ws(' ', {_part(f'({_AGE_MONTHS}) div 12', 'year')}, {_part(f'({_AGE_MONTHS}) % 12', 'mon')}, {_part(_AGE_DAYS, 'day')}), ''), if(a is null or b is null, null, '00:00:00'))"),
    "justify_hours_text": ("h BIGINT", "STRING", "concat(h div 24, ' days ', lpad(h % 24, 2, '0'), ':00:00')"),
    "justify_days_text": ("d BIGINT", "STRING", "concat(d div 30, ' mons ', d % 30, ' days')"),
    "period_add": ("p BIGINT, n BIGINT", "BIGINT", "(p div 100 * 12 + p % 100 - 1 + n) div 12 * 100 + (p div 100 * 12 + p % 100 - 1 + n) % 12 + 1"),
    "period_diff": ("a BIGINT, b BIGINT", "BIGINT", "(a div 100 - b div 100) * 12 + a % 100 - b % 100"),
    "to_days": ("d DATE", "BIGINT", "cast(datediff(d, date '1970-01-01') + 719528 as bigint)"),
    "from_days": ("n BIGINT", "DATE", "date_add(date '1970-01-01', cast(n - 719528 as int))"),
    "yearweek_iso": ("d DATE", "BIGINT", "cast(extract(YEAROFWEEK FROM d) * 100 + weekofyear(d) as bigint)"),
    "week_sunday": ("d DATE", "BIGINT", "cast((dayofyear(d) + 7 - dayofweek(d)) div 7 as bigint)"),
    "to_char_number": ("x DECIMAL(18,2)", "STRING", "to_char(x, '999,999,999,999.99')"),
    "isfinite_date": ("d DATE", "BOOLEAN", "d is not null or null"),
    # conversions that wrap, as in the column store's dialect
    "toint8": ("n BIGINT", "BIGINT", "(n + 128) - floor((n + 128) / 256) * 256 - 128"),
    "toint16": ("n BIGINT", "BIGINT", "(n + 32768) - floor((n + 32768) / 65536) * 65536 - 32768"),
    "touint8": ("n BIGINT", "BIGINT", "n & 255"),
    "touint16": ("n BIGINT", "BIGINT", "n & 65535"),
    "touint32": ("n BIGINT", "BIGINT", "n & 4294967295"),
    # JSON texts
    "jsonb_typeof": ("j STRING", "STRING", "case when j is null then null when try_parse_json(j) is null then null else lower(regexp_replace(replace(replace(replace(replace(schema_of_variant(parse_json(j)), 'BIGINT', 'number'), 'DOUBLE', 'number'), 'VOID', 'null'), 'DECIMAL', 'number'), '[<(].*$', '')) end"),
    "jsonb_exists": ("j STRING, k STRING", "BOOLEAN", "coalesce(array_contains(json_object_keys(j), k), false)"),
    "jsonb_exists_any": ("j STRING, k ARRAY<STRING>", "BOOLEAN", "arrays_overlap(json_object_keys(j), k)"),
    "jsonb_exists_all": ("j STRING, k ARRAY<STRING>", "BOOLEAN", "cardinality(array_except(k, json_object_keys(j))) = 0"),
    "json_valid": ("j STRING", "BOOLEAN", "if(j is null, null, try_parse_json(j) is not null)"),
    "json_keys": ("j STRING", "STRING", "to_json(json_object_keys(j))"),
    "json_quote": ("s STRING", "STRING", "concat('\"', replace(replace(s, chr(92), concat(chr(92), chr(92))), '\"', concat(chr(92), '\"')), '\"')"),
    "json_unquote": ("s STRING", "STRING", "if(s rlike '^\".*\"$', get_json_object(concat('[', s, ']'), '$[0]'), s)"),
    "json_set_key": ("j STRING, k STRING, v STRING", "STRING", _sorted(f"map_concat(map_filter({_OBJECT.format('j')}, (a, b) -> a <> k), map(k, parse_json(v)))")),
    "json_insert_key": ("j STRING, k STRING, v STRING", "STRING", "if(array_contains(json_object_keys(j), k), " + _sorted(_OBJECT.format("j")) + ", " + _sorted(f"map_concat({_OBJECT.format('j')}, map(k, parse_json(v)))") + ")"),
    "json_replace_key": ("j STRING, k STRING, v STRING", "STRING", _sorted(f"transform_values({_OBJECT.format('j')}, (x, y) -> if(x = k, parse_json(v), y))")),
    "json_remove_key": ("j STRING, k STRING", "STRING", _sorted(f"map_filter({_OBJECT.format('j')}, (a, b) -> a <> k)")),
    "json_merge_patch_flat": ("a STRING, b STRING", "STRING", _sorted(f"map_concat(map_filter({_OBJECT.format('a')}, (k, v) -> not array_contains(json_object_keys(b), k)), map_filter({_OBJECT.format('b')}, (k, v) -> not is_variant_null(v)))")),
    "jsonb_concat_flat": ("a STRING, b STRING", "STRING", _sorted(f"map_concat(map_filter({_OBJECT.format('a')}, (k, v) -> not array_contains(json_object_keys(b), k)), {_OBJECT.format('b')})")),
    "json_strip_nulls_flat": ("j STRING", "STRING", _sorted(f"map_filter({_OBJECT.format('j')}, (k, v) -> not is_variant_null(v))")),
    "jsonb_contains_flat": ("a STRING, b STRING", "BOOLEAN", f"forall(map_entries({_OBJECT.format('b')}), e -> coalesce(to_json({_OBJECT.format('a')}[e.key]) <=> to_json(e.value), false))"),
    "json_array_append": ("j STRING, v STRING", "STRING", f"to_json(array_append({_LIST.format('j')}, parse_json(v)))"),
    "json_array_insert": ("j STRING, i INT, v STRING", "STRING", f"to_json(concat(slice({_LIST.format('j')}, 1, i), array(parse_json(v)), slice({_LIST.format('j')}, i + 1, 1000000)))"),
    "jsonb_delete_index": ("j STRING, i INT", "STRING", f"to_json(concat(slice({_LIST.format('j')}, 1, i), slice({_LIST.format('j')}, i + 2, 1000000)))"),
    "json_overlaps_lists": ("a STRING, b STRING", "BOOLEAN", f"arrays_overlap(transform({_LIST.format('a')}, x -> to_json(x)), transform({_LIST.format('b')}, x -> to_json(x)))"),
}


#: Functions that say something of a null first argument, too.
OF_NULLS = frozenset(("quote_nullable", "is_ipv4", "array_cat", "array_fill", "jsonb_exists"))


def install(spark: SparkSession, text: str) -> None:
    """Create the functions that a statement calls."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        if re.search(rf"\b{name}\s*\(", text):
            guarded = body if name in OF_NULLS else f"if({parameters.split()[0]} is null, null, {body})"
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {guarded}")
