"""Seeded worlds of companies with known groups, for measuring the engine: groups that belong together, and traps
that only look so. Everything in them is invented."""

from __future__ import annotations

import random
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

from trama.functions.constants import AREA_STATE, FISCAL_REGION
from trama.operators.expansion import Registry

SYLLABLES = "BA BRE CAN DOR EL FAR GUI JA LUM MOR NES OL PRA QUI RIS SAN TOR UR VEL ZIN".split()
WORK = "COMERCIO SERVICOS TRANSPORTES CONSULTORIA ALIMENTOS INFORMATICA".split()


def check_digits(base: str) -> str:
    """Check digits of a company number, on the driver."""
    out = base
    for start in (5, 6):
        weights = list(range(start, 1, -1)) + list(range(9, 1, -1))
        r = sum((ord(c) - 48) * w for c, w in zip(out, weights)) % 11
        out += str(0 if r < 2 else 11 - r)
    return out[len(base) :]


@dataclass
class World:
    seed: int
    establishments: list[tuple] = field(default_factory=list)
    companies: list[tuple] = field(default_factory=list)
    partners: list[tuple] = field(default_factory=list)
    truth: dict[str, str] = field(default_factory=dict)
    traps: list[tuple[str, str]] = field(default_factory=list)


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.w = World(seed)
        self.used: set[str] = set()

    def _new(self, make) -> str:
        while (v := make()) in self.used:
            pass
        self.used.add(v)
        return v

    def name(self, n: int = 2) -> str:
        return " ".join("".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(2, 3))) for _ in range(n))

    def root(self) -> str:
        return self._new(lambda: f"{self.r.randrange(10**7, 10**8)}")

    def mobile(self, area: str) -> str:
        return self._new(lambda: f"+55{area}9{self.r.randrange(6 * 10**7, 10**8)}")

    def mask(self, state: str) -> str:
        """A masked number whose last visible digit agrees with a state's fiscal region."""
        region = [d for d, s in FISCAL_REGION.items() if state in s]
        return f"***{self.r.randrange(10**5):05d}{self.r.choice(region or ['8'])}**"

    def day(self) -> date:
        return date(2002, 1, 1) + timedelta(days=self.r.randrange(8000))

    def company(self, area: str, phones: list[str], mail: str, people: list[tuple[str, str]], opened: date, status: str = "02", units: int = 1, cep: str | None = None) -> str:
        root, state = self.root(), AREA_STATE[area]
        title = f"{self.name()} {self.r.choice(WORK)}"
        self.w.companies.append((root, f"{title} LTDA", "2062", "10000,00", "01"))
        for k in range(1, units + 1):
            base = f"{root}{k:04d}"
            number = base + check_digits(base)
            second = phones[(k + 1) % len(phones)] if len(phones) > 1 and self.r.random() < 0.4 else None
            self.w.establishments.append((number, root, int(k == 1), title, status, state, "CIDADE", "CENTRO", f"RUA {self.name()}, {self.r.randint(1, 999)}", cep or f"{self.r.randrange(10**7, 10**8)}", mail, phones[(k - 1) % len(phones)], second, opened.strftime("%Y%m%d"), "6201501"))
        for n, m in people:
            self.w.partners.append((root, n, m, "49", opened.strftime("%Y%m%d"), ""))
        return root

    def group(self, g: int) -> None:
        area = self.r.choice(sorted(AREA_STATE))
        state, label = AREA_STATE[area], f"g{g:03d}"
        people = [(self.name(3), self.mask(state)) for _ in range(self.r.randint(1, 2))]
        domain = f"{self.name(1).lower()}{g}.test" if self.r.random() < 0.6 else "gmail.com"
        for c in range(self.r.randint(1, 3)):
            phones = [self.mobile(area) for _ in range(self.r.randint(1, 2))]
            for p in phones:
                self.w.truth[p] = label
            hidden = c > 0 and self.r.random() < 0.25  # the partners of some companies aren't declared
            self.company(area, phones, f"contato{c}@{domain}" if domain != "gmail.com" else f"{self.name(1).lower()}{g}{c}@gmail.com", [] if hidden else people, self.day(), units=self.r.randint(1, 2))

    def add_traps(self) -> None:
        r = self.r
        known = sorted(self.w.truth)
        # an accountant's telephone and mail at many unrelated companies
        hub = self.mobile("11")
        for i in range(6):
            area = r.choice(sorted(AREA_STATE))
            own = self.mobile(area)
            self.w.truth[own] = f"a{i}"
            self.company(area, [own, hub], "contabil@escritorio.test", [(self.name(3), self.mask(AREA_STATE[area]))], self.day(), units=2)
        self.w.traps.append(("contador", hub))
        # neighbours in one block and in one sequence that have nothing to do with each other
        base = r.randrange(6 * 10**7, 9 * 10**7)
        for i in range(4):
            p = f"+55219{base + i * 7}"
            if p not in self.used:
                self.used.add(p)
                self.w.truth[p] = f"b{i}"
                self.company("21", [p], f"{self.name(1).lower()}{i}@gmail.com", [(self.name(3), self.mask("RJ"))], self.day())
        self.w.traps.append(("sequencia", f"+55219{base}"))
        # a number given up by one company and taken by another
        if known:
            p = known[0]
            self.company(p[3:5], [p], "", [(self.name(3), self.mask(AREA_STATE[p[3:5]]))], date(2001, 5, 1), status="08")
            self.w.traps.append(("linha", p))
        # one name, two people; and one person lent to unrelated companies
        name = self.name(3)
        for i, m in enumerate(("SP", "BA")):
            p = self.mobile("71" if m == "BA" else "11")
            self.w.truth[p] = f"h{i}"
            self.company(p[3:5], [p], "", [(name, self.mask(m))], self.day())
        self.w.traps.append(("homonimo", name))
        straw = (self.name(3), self.mask("MG"))
        for i in range(3):
            p = self.mobile("31")
            self.w.truth[p] = f"l{i}"
            self.company("31", [p], "", [straw, (self.name(3), self.mask("MG"))], self.day())
        self.w.traps.append(("laranja", straw[0]))
        # a network opened in one batch around one telephone, without common partners
        shell, start = self.mobile("41"), date(2019, 3, 1)
        self.w.truth[shell] = "f0"
        for i in range(5):
            self.company("41", [shell], f"{self.name(1).lower()}{i}@gmail.com", [(self.name(3), self.mask("PR"))], start + timedelta(days=4 * i))
        self.w.traps.append(("fachada", shell))


def world(seed: int, groups: int = 12, traps: bool = True) -> World:
    m = Maker(seed)
    for g in range(groups):
        m.group(g)
    if traps:
        m.add_traps()
    return m.w


EST = "cnpj string, cnpj_basico string, matriz int, nome_fantasia string, situacao string, uf string, municipio string, bairro string, logradouro string, cep string, email string, e164_1 string, e164_2 string, inicio string, cnae string"


def tables(spark: SparkSession, worlds: list[World]) -> tuple[Registry, DataFrame]:
    """(registry, truth) of some worlds as frames; truth is (mundo, phone, grupo). Worlds don't share numbers by design
    of the seeds; where they do, the rows stay apart by company."""
    est = spark.createDataFrame([e for w in worlds for e in w.establishments], EST)
    emp = spark.createDataFrame([c for w in worlds for c in w.companies], "cnpj_basico string, razao_social string, natureza string, capital string, porte string")
    soc = spark.createDataFrame([p for w in worlds for p in w.partners], "cnpj_basico string, nome string, doc string, qualificacao string, entrada string, representante string")
    truth = spark.createDataFrame([(w.seed, p, g) for w in worlds for p, g in w.truth.items()], "mundo int, phone string, grupo string")
    return Registry(est, emp, soc), truth
