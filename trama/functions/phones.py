"""Telephone numbers of the Brazilian plan as column expressions."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from trama.functions.constants import AREA_STATE, NON_GEOGRAPHIC, PHONE_PATTERN, SPECIAL, SPELLINGS
from trama.functions.identifiers import digits, let


def subscriber_kind(s: Column) -> Column:
    """movel, fixo or indefinido by length and first digit."""
    n, a = F.length(s), F.substring(s, 1, 1)
    return F.when((n == 9) & (a == "9"), "movel").when((n == 8) & a.isin("2", "3", "4", "5"), "fixo").when((n == 8) & a.isin("6", "7", "8", "9"), "movel").otherwise("indefinido")


def block(area: Column, subscriber: Column) -> Column:
    """Area code and the first five digits, for subscribers of six digits or more."""
    return F.when((area != "") & (F.length(subscriber) >= 6), F.concat(area, F.substring(subscriber, 1, 5)))


def area_state(area: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in AREA_STATE.items() for x in kv])[area]


def normalise(raw: Column, default_area: str | None = None) -> Column:
    """STRUCT<valido, e164, ddd, assinante, tipo, uf, faixa, csp, chave> of a number in any spelling.

    In order: public service numbers; numbers without area; a carrier code
    before the area; country code or trunk zero; the default area for numbers
    without one. Null or unreadable input gives valido false and the key raw:digits.
    """
    return let(digits(F.trim(raw)), lambda d: let(_stripped(d, default_area), lambda s: _described(d, s)))


def _stripped(d: Column, default_area: str | None) -> Column:
    """STRUCT<csp, c>: the carrier code, and area and subscriber without any prefix."""
    carrier = F.when(d.rlike("^0[0-9]{2}[0-9]{2}[0-9]{8,9}$"), F.substring(d, 2, 2))

    def prefix(a: Column) -> Column:
        b = F.when(a.startswith("0055"), a.substr(F.lit(5), F.length(a))).when(a.startswith("55") & F.length(a).isin(12, 13), a.substr(F.lit(3), F.length(a))).when(a.startswith("0") & F.length(a).isin(11, 12), a.substr(F.lit(2), F.length(a))).otherwise(a)
        return let(b, lambda x: F.when(F.length(x).isin(8, 9), F.concat(F.lit(default_area), x)).otherwise(x)) if default_area else b

    return F.struct(carrier.alias("csp"), let(F.when(carrier.isNotNull(), d.substr(F.lit(4), F.length(d))).otherwise(d), prefix).alias("c"))


def _described(d: Column, s: Column) -> Column:
    special = d.isin(*SPECIAL)
    national = F.lit(False)
    for p in NON_GEOGRAPHIC:
        national = national | d.startswith(p)
    fixed = F.coalesce(special | (national & F.length(d).isin(10, 11)), F.lit(False))
    c, carrier = s["c"], s["csp"]
    full = F.length(c).isin(10, 11)
    area = F.when(full, F.substring(c, 1, 2))
    subscriber = F.when(full, c.substr(F.lit(3), F.length(c)))
    kind = subscriber_kind(subscriber)
    geo = F.coalesce(full & area.isin(*AREA_STATE), F.lit(False))
    key = F.when(fixed, d).when(geo, F.concat(F.lit("+55"), c))
    return F.struct(
        F.coalesce(fixed | (geo & (kind != "indefinido")), F.lit(False)).alias("valido"),
        key.alias("e164"),
        F.when(~fixed, area).alias("ddd"),
        F.when(fixed, d).otherwise(subscriber).alias("assinante"),
        F.when(fixed & special, "especial").when(fixed, "nao-geografico").when(geo, kind).otherwise("indefinido").alias("tipo"),
        F.when(~fixed & geo, area_state(area)).alias("uf"),
        F.when(~fixed & geo, block(area, subscriber)).alias("faixa"),
        F.when(~fixed, carrier).alias("csp"),
        F.coalesce(key, F.concat(F.lit("raw:"), F.coalesce(d, F.lit("")))).alias("chave"),
    )


def formatted(area: Column, subscriber: Column) -> Column:
    nine = F.concat(F.lit("("), area, F.lit(") "), F.substring(subscriber, 1, 1), F.lit(" "), F.substring(subscriber, 2, 4), F.lit("-"), F.substring(subscriber, 6, 4))
    eight = F.concat(F.lit("("), area, F.lit(") "), F.substring(subscriber, 1, 4), F.lit("-"), F.substring(subscriber, 5, 20))
    return F.when(F.length(subscriber) == 9, nine).otherwise(eight)


def spellings(area: Column, subscriber: Column, most: int = 24) -> Column:
    """The plausible spellings, with and without the ninth digit, in order and without repeats."""
    return let(F.struct(area.alias("a"), subscriber.alias("s")), lambda x: _spellings(x["a"], x["s"], most))


def _spellings(area: Column, subscriber: Column, most: int) -> Column:
    def fill(body: Column) -> list[Column]:
        half = F.when(F.length(body) == 9, 5).otherwise(4)
        values = {"ddd": area, "c": body, "p1": F.substr(body, F.lit(1), half), "p2": F.substr(body, half + 1, F.lit(20))}
        return [F.concat(*[x for text, name, _, _ in Formatter().parse(s) for x in ([F.lit(text)] if text else []) + ([values[name]] if name else [])]) for s in SPELLINGS]

    first = subscriber.substr(1, 1)
    other = F.when((F.length(subscriber) == 9) & (first == "9"), F.substring(subscriber, 2, 8)).when((F.length(subscriber) == 8) & first.isin("6", "7", "8", "9"), F.concat(F.lit("9"), subscriber))
    both = F.array_distinct(F.array_compact(F.array(*fill(subscriber), *fill(other))))
    return F.when(area.isNotNull() & subscriber.isNotNull(), F.slice(both, 1, most)).otherwise(F.array().cast("array<string>"))


def find(text: Column, default_area: str | None = None) -> Column:
    """ARRAY of normalise() for the valid numbers in a text, in order of place, repeats of a key left out."""
    got = F.filter(F.transform(F.regexp_extract_all(text, F.lit(PHONE_PATTERN), F.lit(0)), lambda x: normalise(x, default_area)), lambda t: t["valido"])
    return F.array_distinct(got)
