"""Pieces of DuckDB SQL used by the correctness queries."""

WS = r"[\t\n\x0B\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^{WS}+|{WS}+$', '', 'g')"


def slug(c: str) -> str:
    return f"trim(regexp_replace(lower({strip(c)}), '[^a-z0-9]+', '_', 'g'), '_')"


def zero_fill(d: str) -> str:
    return f"CASE WHEN length({d}) >= 8 THEN {d} ELSE lpad({d}, 8, '0') END"


def normalize_number(c: str) -> str:
    d = f"regexp_extract({strip(c)}, '(?i)^(?:REQ-)?([0-9]+)$', 1)"
    return f"CASE WHEN {d} = '' THEN {strip(c)} ELSE {zero_fill(d)} END"


def number_sort_value(c: str) -> str:
    return f"coalesce(TRY_CAST(nullif(regexp_extract({strip(c)}, '([0-9]+)$', 1), '') AS BIGINT), 0)"


def log_text(c: str) -> str:
    w = strip(f"regexp_replace(coalesce({c}, ''), '{WS}+', ' ', 'g')")
    return f"CASE WHEN length({w}) <= 90 THEN {w} ELSE concat(substring({w}, 1, 87), '...') END"


def complete(input_type: str, value: str) -> str:
    return f"CASE WHEN {input_type} = 'checkbox' THEN {strip(value)} = 'true' ELSE {strip(value)} <> '' END"


def days_since(c: str, as_of: str) -> str:
    return (f"coalesce(greatest(0, date_sub('day', TRY_CAST(substring({c}, 1, 19) AS TIMESTAMP), "
            f"TIMESTAMP '{as_of}')), 0)")
