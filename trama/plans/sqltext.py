"""SQL text of the column functions, for the oracle side of the queries."""

from __future__ import annotations

from trama.functions.constants import AREA_STATE, FISCAL_REGION, NON_GEOGRAPHIC, POSTCODE_RANGES, SPECIAL, VOTER_STATE
from trama.functions.identifiers import _UUID4


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def digit(x: str, place: int) -> str:
    return f"(ascii(substr({x}, {place}, 1)) - 48)"


def weighted(x: str, weights: list[int], start: int = 1) -> str:
    return "(" + " + ".join(f"{digit(x, start + i)} * {w}" for i, w in enumerate(weights)) + ")"


def one_sign(x: str) -> str:
    return f"({x} = repeat(left({x}, 1), length({x})))"


def in_list(x: str, values) -> str:
    return f"{x} IN ({', '.join(repr(v) for v in values)})"


def cpf_check(b: str) -> str:
    first = f"({weighted(b, list(range(10, 1, -1)))} * 10 % 11 % 10)"
    second = f"(({weighted(b, list(range(11, 2, -1)))} + {first} * 2) * 10 % 11 % 10)"
    return f"({first}::VARCHAR || {second}::VARCHAR)"


def cpf_valid(d: str) -> str:
    return f"(length({d}) = 11 AND NOT {one_sign(d)} AND {cpf_check(d)} = substr({d}, 10, 2))"


def cnpj_clean(x: str) -> str:
    return f"upper(regexp_replace({x}, '[^0-9A-Za-z]', '', 'g'))"


def cnpj_check(b: str) -> str:
    w = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    close = lambda t: f"(CASE WHEN {t} % 11 < 2 THEN 0 ELSE 11 - {t} % 11 END)"
    first = close(weighted(b, w))
    second = close(f"({weighted(b, [6, *w[:-1]])} + {first} * 2)")
    return f"({first}::VARCHAR || {second}::VARCHAR)"


def cnpj_valid(s: str) -> str:
    return f"(regexp_full_match({s}, '[0-9A-Z]{{12}}[0-9]{{2}}') AND NOT {one_sign(s)} AND {cnpj_check(s)} = substr({s}, 13, 2))"


def postcode_state(d: str) -> str:
    n = f"try_cast(substr({d}, 1, 5) AS INTEGER)"
    cases = " ".join(f"WHEN {n} BETWEEN {a} AND {b} THEN '{s}'" for a, b, s in POSTCODE_RANGES)
    return f"(CASE WHEN length({d}) = 8 THEN CASE {cases} END END)"


def area_state(a: str) -> str:
    return f"(CASE {a} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AREA_STATE.items()) + " END)"


def region(one: str) -> str:
    return f"(CASE {one} " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(s) for s in v)}]" for k, v in FISCAL_REGION.items()) + " END)"


def mask_region(x: str) -> str:
    d = digits(x)
    return f"(CASE WHEN length({d}) = 11 THEN {region(f'substr({d}, 9, 1)')} WHEN length({d}) = 6 AND contains({x}, '*') THEN {region(f'substr({d}, 6, 1)')} END)"


def subscriber_kind(s: str) -> str:
    a = f"substr({s}, 1, 1)"
    return f"(CASE WHEN length({s}) = 9 AND {a} = '9' THEN 'movel' WHEN length({s}) = 8 AND {a} IN ('2','3','4','5') THEN 'fixo' WHEN length({s}) = 8 AND {a} IN ('6','7','8','9') THEN 'movel' ELSE 'indefinido' END)"


def phone_rows(source: str, column: str, keep: str) -> str:
    """A query of keep and valido, e164, ddd, assinante, tipo, uf, faixa, csp, chave for the column of source."""
    national = " OR ".join(f"starts_with(d, '{p}')" for p in NON_GEOGRAPHIC)
    return f"""
    SELECT {keep}, CASE WHEN sp OR na THEN true ELSE coalesce(geo AND kind <> 'indefinido', false) END AS valido,
      CASE WHEN sp OR na THEN d WHEN geo THEN '+55' || c END AS e164,
      CASE WHEN NOT (sp OR na) THEN area END AS ddd,
      CASE WHEN sp OR na THEN d ELSE sub END AS assinante,
      CASE WHEN sp THEN 'especial' WHEN na THEN 'nao-geografico' WHEN geo THEN kind ELSE 'indefinido' END AS tipo,
      CASE WHEN NOT (sp OR na) AND geo THEN {area_state('area')} END AS uf,
      CASE WHEN NOT (sp OR na) AND geo AND length(sub) >= 6 THEN area || substr(sub, 1, 5) END AS faixa,
      CASE WHEN NOT (sp OR na) THEN csp END AS csp,
      coalesce(CASE WHEN sp OR na THEN d WHEN geo THEN '+55' || c END, 'raw:' || coalesce(d, '')) AS chave
    FROM (SELECT *, {subscriber_kind('sub')} AS kind, coalesce(full_ AND {in_list('area', AREA_STATE)}, false) AS geo
      FROM (SELECT *, CASE WHEN full_ THEN substr(c, 1, 2) END AS area, CASE WHEN full_ THEN substr(c, 3) END AS sub
        FROM (SELECT *, length(c) IN (10, 11) AS full_ FROM (
          SELECT *, CASE WHEN starts_with(a, '0055') THEN substr(a, 5) WHEN starts_with(a, '55') AND length(a) IN (12, 13) THEN substr(a, 3)
                         WHEN starts_with(a, '0') AND length(a) IN (11, 12) THEN substr(a, 2) ELSE a END AS c
          FROM (SELECT *, CASE WHEN csp IS NOT NULL THEN substr(d, 4) ELSE d END AS a
            FROM (SELECT *, {in_list('d', SPECIAL)} AS sp, (({national}) AND length(d) IN (10, 11)) AS na,
                    CASE WHEN regexp_full_match(d, '0[0-9]{{2}}[0-9]{{2}}[0-9]{{8,9}}') THEN substr(d, 2, 2) END AS csp
                  FROM (SELECT *, {digits(column)} AS d FROM {source})))))))"""


def plate_kind(p: str) -> str:
    return f"(CASE WHEN regexp_full_match({p}, '[A-Z]{{3}}[0-9]{{4}}') THEN 'antiga' WHEN regexp_full_match({p}, '[A-Z]{{3}}[0-9][A-Z][0-9]{{2}}') THEN 'mercosul' END)"


def voter_valid(d: str) -> str:
    big = f"substr({d}, 9, 2) IN ('01', '02')"
    close = lambda r: f"(CASE WHEN {r} = 10 THEN 0 WHEN {r} = 0 AND {big} THEN 1 ELSE {r} END)"
    first = close(f"({weighted(d, [2, 3, 4, 5, 6, 7, 8, 9])} % 11)")
    second = close(f"(({digit(d, 9)} * 7 + {digit(d, 10)} * 8 + {first} * 9) % 11)")
    states = in_list(f"substr({d}, 9, 2)", VOTER_STATE)
    return f"(length({d}) = 12 AND {states} AND substr({d}, 11, 2) = {first}::VARCHAR || {second}::VARCHAR)"


def pis_valid(d: str) -> str:
    r = f"(11 - {weighted(d, [3, 2, 9, 8, 7, 6, 5, 4, 3, 2])} % 11)"
    return f"(length({d}) = 11 AND NOT {one_sign(d)} AND {digit(d, 11)} = CASE WHEN {r} >= 10 THEN 0 ELSE {r} END)"


def renavam_valid(d: str) -> str:
    r = f"({weighted(d, [3, 2, 9, 8, 7, 6, 5, 4, 3, 2])} * 10 % 11)"
    return f"(length({d}) = 11 AND NOT {one_sign(d)} AND {digit(d, 11)} = CASE WHEN {r} = 10 THEN 0 ELSE {r} END)"


def licence_valid(d: str) -> str:
    a = f"({weighted(d, list(range(9, 0, -1)))} % 11)"
    b = f"({weighted(d, list(range(1, 10)))} % 11 - CASE WHEN {a} >= 10 THEN 2 ELSE 0 END)"
    return f"(length({d}) = 11 AND NOT {one_sign(d)} AND substr({d}, 10, 2) = (CASE WHEN {a} >= 10 THEN 0 ELSE {a} END)::VARCHAR || (CASE WHEN {b} < 0 OR {b} >= 10 THEN 0 ELSE {b} END)::VARCHAR)"


def health_valid(d: str) -> str:
    total = weighted(d, list(range(15, 4, -1)))
    r = f"(11 - {total} % 11)"
    permanent = f"(CASE WHEN {r} = 10 THEN substr({d}, 1, 11) || '001' || (11 - ({total} + 2) % 11)::VARCHAR ELSE substr({d}, 1, 11) || '000' || (CASE WHEN {r} = 11 THEN 0 ELSE {r} END)::VARCHAR END)"
    provisional = f"({weighted(d, list(range(15, 0, -1)))} % 11 = 0)"
    return f"(length({d}) = 15 AND CASE WHEN left({d}, 1) IN ('1', '2') THEN {permanent} = {d} WHEN left({d}, 1) IN ('7', '8', '9') THEN {provisional} ELSE false END)"


def mod10(x: str, start: int, size: int) -> str:
    parts = []
    for i in range(size):
        v = f"({digit(x, start + i)} * {2 if (size - 1 - i) % 2 == 0 else 1})"
        parts.append(f"({v} // 10 + {v} % 10)")
    return f"((10 - ({' + '.join(parts)}) % 10) % 10)"


def slip_valid(d: str) -> str:
    bars = f"(substr({d}, 1, 4) || substr({d}, 34, 14) || substr({d}, 5, 5) || substr({d}, 11, 10) || substr({d}, 22, 10))"
    r = f"(11 - {weighted(bars, [2 + (42 - i) % 8 for i in range(43)])} % 11)"
    return f"(length({d}) = 47 AND {mod10(d, 1, 9)} = {digit(d, 10)} AND {mod10(d, 11, 10)} = {digit(d, 21)} AND {mod10(d, 22, 10)} = {digit(d, 32)} AND CASE WHEN {r} IN (0, 10, 11) THEN 1 ELSE {r} END = {digit(d, 33)})"


def payment_kind(k: str) -> str:
    d = digits(k)
    c = cnpj_clean(k)
    return f"""(CASE WHEN regexp_full_match({k}, '{_UUID4}') THEN 'evp' WHEN regexp_full_match({k}, '[\\w.+-]+@[\\w-]+(\\.[\\w-]+)+') THEN 'email'
      WHEN regexp_full_match({k}, '\\+55[0-9]{{10,11}}') THEN 'telefone'
      WHEN regexp_full_match({k}, '[0-9.\\-/ ]+') AND {cpf_valid(d)} THEN 'cpf'
      WHEN regexp_full_match({k}, '[0-9.\\-/ ]+') AND {cnpj_valid(d)} THEN 'cnpj'
      WHEN regexp_full_match({k}, '[0-9A-Za-z.\\-/]+') AND length({c}) = 14 AND {cnpj_valid(c)} THEN 'cnpj' END)"""


def flexible_date(x: str) -> str:
    d = digits(f"trim({x})")
    return f"(CASE WHEN contains(trim({x}), '/') THEN try_strptime(regexp_extract(trim({x}), '^([0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}})', 1), '%d/%m/%Y') WHEN length({d}) >= 8 THEN try_strptime(substr({d}, 1, 8), '%Y%m%d') END)::DATE"
