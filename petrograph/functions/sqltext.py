"""DuckDB spellings of the rules in ``exprs`` (used only by oracle SQL)."""

from __future__ import annotations

from petrograph import schemas as S


def round_fixed(e: str, n: int) -> str:
    p = 10 ** n
    return f"CAST(sign({e}) * floor(abs({e}) * {p} + 0.5) / {p} AS DOUBLE)"


def _scaled(e: str, n: int) -> str:
    return f"CAST(floor(abs({e}) * {10 ** n} + 0.5) AS BIGINT)"


def to_fixed(e: str, n: int) -> str:
    m = _scaled(e, n)
    sign = f"(CASE WHEN ({e}) < 0 THEN '-' ELSE '' END)"
    if n == 0:
        return f"({sign} || CAST({m} AS VARCHAR))"
    p = 10 ** n
    return (f"({sign} || CAST({m} // {p} AS VARCHAR) || '.' || "
            f"lpad(CAST({m} % {p} AS VARCHAR), {n}, '0'))")


def pct_text(e: str, n: int = 0) -> str:
    return f"({to_fixed(f'({e}) * 100', n)} || '%')"


def fmt_number(e: str) -> str:
    m = _scaled(e, 3)
    return (f"((CASE WHEN ({e}) < 0 THEN '-' ELSE '' END) || format('{{:,}}', {m} // 1000) || "
            f"(CASE WHEN {m} % 1000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST({m} % 1000 AS VARCHAR), 3, '0'), '0') END))")


def fmt_currency(e: str) -> str:
    m = _scaled(e, 2)
    return (f"((CASE WHEN ({e}) < 0 THEN '-' ELSE '' END) || '$' || format('{{:,}}', {m} // 100) || '.' || "
            f"lpad(CAST({m} % 100 AS VARCHAR), 2, '0'))")


def truncate_text(e: str, n: int) -> str:
    return f"(CASE WHEN length({e}) <= {n} THEN {e} ELSE substring({e}, 1, {n}) || '...' END)"


def label_prefix(e: str, n: int = S.LABEL_PREFIX_CHARS) -> str:
    return f"(substring({e}, 1, {n}) || '...')"


def or_zero(e: str) -> str:
    return f"coalesce(CASE WHEN isnan(CAST({e} AS DOUBLE)) THEN 0.0 ELSE CAST({e} AS DOUBLE) END, 0.0)"


def or_default(e: str, d: float) -> str:
    return (f"(CASE WHEN {e} IS NULL OR isnan(CAST({e} AS DOUBLE)) OR {e} = 0 THEN CAST({float(d)} AS DOUBLE) "
            f"ELSE CAST({e} AS DOUBLE) END)")


def severity_band(e: str) -> str:
    arms = " ".join(f"WHEN {e} = '{k}' THEN '{v}'" for k, v in S.SEVERITY_COLOURS)
    return f"(CASE {arms} ELSE '{S.SEVERITY_DEFAULT_COLOUR}' END)"


def impact_band(e: str) -> str:
    return (f"(CASE WHEN {e} IS NULL THEN NULL WHEN {e} > {S.IMPACT_RED_ABOVE} THEN 'red' "
            f"WHEN {e} > {S.IMPACT_YELLOW_ABOVE} THEN 'yellow' ELSE 'green' END)")


def strength_band(e: str) -> str:
    return (f"(CASE WHEN {e} > {S.STRONG_ABOVE} THEN 'strong' WHEN {e} > {S.MEDIUM_ABOVE} "
            f"THEN 'medium' ELSE 'weak' END)")


def event_node_colour(e: str) -> str:
    (c1, v1), (c2, v2) = S.EVENT_NODE_COLOURS
    return f"(CASE WHEN {e} = '{c1}' THEN '{v1}' WHEN {e} = '{c2}' THEN '{v2}' ELSE '{S.EVENT_NODE_DEFAULT_COLOUR}' END)"


def elapsed_seconds(ts: str, as_of: str) -> str:
    return f"CAST(floor((epoch_us({as_of}) - epoch_us({ts})) / 1000000.0) AS BIGINT)"


def time_ago(ts: str, as_of: str) -> str:
    s = elapsed_seconds(ts, as_of)
    return (f"(CASE WHEN {s} < 60 THEN CAST({s} AS VARCHAR) || 's ago' "
            f"WHEN {s} < 3600 THEN CAST(CAST(floor({s} / 60) AS BIGINT) AS VARCHAR) || 'm ago' "
            f"WHEN {s} < 86400 THEN CAST(CAST(floor({s} / 3600) AS BIGINT) AS VARCHAR) || 'h ago' "
            f"ELSE CAST(CAST(floor({s} / 86400) AS BIGINT) AS VARCHAR) || 'd ago' END)")
