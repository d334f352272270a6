"""Pieces of the DuckDB statements that stand beside the Spark queries."""

from __future__ import annotations


def sql_time(c: str) -> str:
    t = f"trim({c})"
    return (
        f"CASE WHEN regexp_full_match({t}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]{{1,6}})?)?(Z|[+-][0-9]{{2}}:[0-9]{{2}})?)?') "
        f"THEN try_cast(CASE WHEN length({t}) = 10 THEN {t} || ' 00:00:00+00:00' WHEN regexp_matches({t}, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') THEN {t} ELSE {t} || '+00:00' END AS TIMESTAMPTZ) END"
    )


def sql_label(c: str) -> str:
    return f"regexp_replace(lower({c}), '^\\s+|\\s+$', '', 'g')"


def sql_name(c: str) -> str:
    return (
        f"trim(regexp_replace(translate(strip_accents(lower({c})), '‘’‛ʼʹ′＇`´‐‑‒–—―−﹣－', '''''''''''''''''''---------'), '[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200d}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}]+', ' ', 'g'))"
    ).replace("{{", "{").replace("}}", "}")
