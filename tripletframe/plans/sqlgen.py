"""DuckDB text builders shared by oracle queries."""

from __future__ import annotations

from tripletframe.functions.keys import hkey_sql


def negatives_ctes(src: str, answer: str, key: str, out: str, batch: int | None = None, salt: str = "neg",
                   group: tuple[str, ...] = (), prefix: str = "ng") -> tuple[list[str], str]:
    """CTEs reproducing :func:`sample_negatives`; returns (ctes, final relation name).

    The final relation has every column of ``src`` plus ``out``.
    """
    g = list(group)
    part = f"partition by {', '.join(g)}" if g else ""
    on = " and ".join([f"a.{c} = b.{c}" for c in g] + ["a._t = b._p"])
    run = f"least(_p // {batch}, greatest(1, cast(ceil((_gn - 1) / {batch}) as bigint)) - 1) * {batch}" if batch else "0"
    size = f"case when _lo // {batch} = greatest(1, cast(ceil((_gn - 1) / {batch}) as bigint)) - 1 then _gn - _lo else {batch} end" if batch else "_gn"
    ctes = [
        f"""{prefix}_b as (select s.*, {hkey_sql(f"'{salt}'", 's.' + key)} as _h from {src} s)""",
        f"""{prefix}_i as (select *, row_number() over ({part} order by _h, {key}) - 1 as _p, count(*) over ({part}) as _gn
  from {prefix}_b)""",
        f"{prefix}_l as (select *, {run} as _lo from {prefix}_i)",
        f"{prefix}_n as (select *, {size} as _n from {prefix}_l)",
        f"""{prefix}_j as (select *, case when _n > 1 then _lo + (_p - _lo + 1 + {hkey_sql(f"'{salt}|pick'", key)} % (_n - 1)) % _n end as _t
  from {prefix}_n)""",
        f"""{prefix} as (select a.* exclude (_h, _p, _gn, _lo, _n, _t), b.{answer} as {out}
  from {prefix}_j a join {prefix}_j b on {on})""",
    ]
    return ctes, prefix


def with_ctes(ctes: list[str], body: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + body
