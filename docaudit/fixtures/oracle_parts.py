"""SQL fragments shared by the DuckDB texts."""

from __future__ import annotations

from docaudit.functions.geo import city_rows

CITY = "city(rank, code, name, short_name, tier, lat, lng, lim) as (values " + ", ".join(
    f"({r}, '{code}', '{name}', '{short}', '{tier}', cast({lat} as double), cast({lng} as double), cast({lim} as decimal(14,2)))"
    for r, code, name, short, tier, lat, lng, lim in city_rows()
) + ")"


def city_map(texts: str, name: str = "cmap") -> str:
    """CTEs: the city table and the city each distinct text of ``texts`` (column txt) resolves to."""
    return f"""{CITY}, {name} as (
      select txt, rank, short_name, name as full_name, tier, lat, lng, lim from (
        select t.txt, c.*, row_number() over (partition by t.txt order by
          case when trim(t.txt) in (c.code, c.name, c.short_name) then 0 else 1 end, length(c.short_name) desc, c.rank) as rn
        from (select distinct txt from ({texts}) where txt is not null) t
        join city c on trim(t.txt) in (c.code, c.name, c.short_name) or contains(trim(t.txt), c.short_name)
          or contains(trim(t.txt), c.name)) where rn = 1)"""


def km(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    a = (
        f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians({lng2} - {lng1}) / 2), 2))"
    )
    return f"(6371.0 * 2 * atan2(sqrt({a}), sqrt(1 - {a})))"


def dec(expr: str) -> str:
    return f"try_cast(trim({expr}) as decimal(38,2))"


IDENTITY = "case when trim(coalesce(invoice_code,'')) = '' or trim(coalesce(invoice_number,'')) = '' then null " \
    "else upper(trim(invoice_code)) || '#' || upper(trim(invoice_number)) end"

TO_BOOL = "case when lower(trim({0})) in ('true','1','yes','y','t') then true " \
    "when lower(trim({0})) in ('false','0','no','n','f') then false end"

USCC_OK = """(length({0}) = 18 and regexp_full_match({0}, '[0-9A-HJ-NPQRTUWXY]{{18}}') and
  substr({0}, 18, 1) = substr('0123456789ABCDEFGHJKLMNPQRTUWXY', cast((31 - list_sum(list_transform(range(1, 18),
    lambda i: (strpos('0123456789ABCDEFGHJKLMNPQRTUWXY', substr({0}, i, 1)) - 1) *
      [1,3,9,27,19,26,16,17,20,29,25,13,8,24,10,30,28][i])) % 31) % 31 as int) + 1, 1))"""
