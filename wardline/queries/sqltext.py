"""SQL fragments the twins share, written for RE2 (ASCII ``\\s`` and ``\\b`` made Unicode by hand)."""

from wardline.rules.fields import FIELD_ALIASES

WS = r"[\t\n\x0b\f\r \x{85}\pZ]"
NOT_WS = r"[^\t\n\x0b\f\r \x{85}\pZ]"
ALNUM = r"[\pL\pN]"


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values_sql(rows) -> str:
    return ", ".join(
        "(" + ", ".join(quote(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows
    )


FIELD_ALIAS_VALUES = values_sql(
    [(i, a, f) for i, (a, f) in enumerate((a, f) for f, names in FIELD_ALIASES.items() for a in names)]
)


def strip_sql(column: str) -> str:
    return f"regexp_replace({column}, '^{WS}+|{WS}+$', '', 'g')"


def clean_sql(column: str) -> str:
    text = f"regexp_replace(coalesce({column}, ''), '<[^>]+>', ' ', 'g')"
    for entity, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"')):
        text = f"replace({text}, '{entity}', '{plain}')"
    return f"trim(regexp_replace({text}, '{WS}+', ' ', 'g'))"


def words_sql(column: str) -> str:
    return f"len(regexp_extract_all(coalesce({column}, ''), '{ALNUM}{NOT_WS}*'))"


def sparse_sql(column: str, n: int = 10) -> str:
    return f"({words_sql(column)} < {n})"


def code_sql(column: str, codes: dict) -> str:
    key = f"lower(trim({column}))"
    exact = " ".join(f"when {key} = {quote(k)} then {quote(v)}" for k, v in codes.items())
    prefix = " ".join(
        f"when starts_with({key}, {quote(k)}) or starts_with({quote(k)}, {key}) then {quote(v)}" for k, v in codes.items()
    )
    return f"case when {key} = '' then null {exact} {prefix} else {column} end"


def word_sql(patterns) -> str:
    """Unicode word-bounded alternatives for RE2."""
    return r"(?i)(?:^|[^\pL\pN_])(?:" + "|".join(patterns) + r")(?:[^\pL\pN_]|$)"


def lines_sql(column: str) -> str:
    """One sentence per line, as ``sentence_lines``."""
    text = f"regexp_replace(coalesce({column}, ''), '[.\\n;!]+', chr(10), 'g')"
    text = f"regexp_replace({text}, '[\\t\\x0b\\f\\r \\x{{85}}\\pZ]+', ' ', 'g')"
    return f"regexp_replace({text}, ' ?\\n ?|^ | $', chr(10), 'g')"


def span_sql(lines: str, pattern: str, width: int = 140) -> str:
    found = f"nullif(regexp_extract({lines}, '(?im)^.*?(?:{pattern}).*$', 0), '')"
    return f"(case when length({found}) > {width} then substr({found}, 1, {width - 3}) || '...' else {found} end)"


def pct_sql(part: str, whole: str, digits: int = 1) -> str:
    return ratio_sql(f"(100 * ({part}))", whole, digits)


def ratio_sql(part: str, whole: str, digits: int = 4) -> str:
    scale = 10**digits
    return (
        f"coalesce((({part})::bigint * {2 * scale} + ({whole})::bigint) // nullif(2 * ({whole})::bigint, 0)"
        f" / {float(scale)}, 0.0)::double"
    )
