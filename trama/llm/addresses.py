"""Establishments at the same place, however their address is written.

Addresses are parsed into town, number, street type, street words, district and
postal code. Candidates share the town, the number (or the mark "without
number") and a postal code or the sound of a part of a street word. Pairs are
compared component by component into agreement levels, with a level of its own
for a missing value; the weights of the levels are estimated by
expectation-maximization over the counts of the level patterns (Fellegi and
Sunter's model), and pairs whose posterior reaches THRESHOLD and whose streets have a word in common are links.

Spellings that parse alike in every part are compared once, however many firms
share them; they too get the posterior of their levels. The result is a list of
linked spellings and their members; only same_place() lists pairs of establishments.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trama.operators.hot_join import hot_keys, in_slots, slot
from trama.session import Work

THRESHOLD = 0.5
#: Rounds of expectation-maximization.
ROUNDS = 60

#: Street types and their short forms.
TYPES = {
    "RUA": "R RU RUA",
    "AVENIDA": "AV AVE AVEN AVDA AVENIDA",
    "TRAVESSA": "T TV TR TRAV TRV TRAVESSA",
    "RODOVIA": "ROD RODOVIA",
    "ESTRADA": "EST ESTR ESTRADA",
    "LARGO": "LG LGO LARGO",
    "ALAMEDA": "AL ALAM ALAMEDA",
    "PRACA": "P PC PCA PCE PRC PRACA",
}
#: Titles and other words before a street's name, and their short forms.
TITLES = {
    "CORONEL": "CEL CRL CORONEL",
    "GENERAL": "GEN GAL GENERAL",
    "MARECHAL": "MAL MARECHAL",
    "CAPITAO": "CAP CPT CAPITAO",
    "TENENTE": "TEN TTE TENENTE",
    "SARGENTO": "SGT SARG SARGENTO",
    "MAJOR": "MAJ MJ MAJOR",
    "BRIGADEIRO": "BRIG BRIGADEIRO",
    "ALMIRANTE": "ALM ALMIRANTE",
    "DOUTOR": "DR DOUTOR",
    "DOUTORA": "DRA DOUTORA",
    "PROFESSOR": "PROF PROFESSOR",
    "PROFESSORA": "PROFA PROFESSORA",
    "ENGENHEIRO": "ENG ENGO ENGENHEIRO",
    "PADRE": "PE PDE PADRE",
    "CONEGO": "CON CGO CONEGO",
    "MONSENHOR": "MONS MNS MONSENHOR",
    "VISCONDE": "VISC VDE VISCONDE",
    "BARAO": "BR BAR BARAO",
    "PRESIDENTE": "PRES PRESIDENTE",
    "SENADOR": "SEN SENADOR",
    "DEPUTADO": "DEP DEPUTADO",
    "VEREADOR": "VER VEREADOR",
    "PREFEITO": "PREF PREFEITO",
    "MINISTRO": "MIN MINISTRO",
    "DESEMBARGADOR": "DES DESEMBARGADOR",
    "COMENDADOR": "COM COMEND COMENDADOR",
    "SANTO": "STO SANTO",
    "SANTA": "STA SANTA",
}
#: Words of districts and their short forms.
DISTRICTS = {
    "VILA": "VL V VILA",
    "JARDIM": "JD JARD JARDIM",
    "PARQUE": "PQ PQE PRQ PARQUE",
    "CONJUNTO": "CJ CONJ CONJUNTO",
    "RESIDENCIAL": "RES RESID RESIDENCIAL",
    "LOTEAMENTO": "LOT LTO LOTEAMENTO",
    "NUCLEO": "NUC NUCLEO",
    "SANTA": "STA SANTA",
    "ALTO": "ALT ALTO",
}
_LINKING = {"DA", "DO", "DAS", "DOS", "DE", "E"}
_NO_DISTRICT = {"", "NAO INFORMADO", "NAO CONSTA", "SEM BAIRRO", "NI", "N I"}


def _forms(table: dict[str, str]) -> dict[str, str]:
    return {short: full for full, shorts in table.items() for short in shorts.split()}


_TYPE, _TITLE, _DISTRICT = _forms(TYPES), _forms(TITLES), _forms(DISTRICTS)
_FLOOR = re.compile(r"(?<![A-Z0-9])\d+\s*[OA]?\s*\.?\s*AND(?:AR)?\b\.?|\bANDAR\s*\d+")
_UNIT = re.compile(r"\b(?:SALA|SL|LOJA|LJ|APTO|APT|AP|BLOCO|BL|CONJ|CJ|BOX|GALPAO|QUADRA|QD|LOTE|LT|CASA)\b\.?\s*(?:NO?\.?\s*)?(?:\d+[A-Z]?|[A-Z])(?![A-Z0-9])|\b(?:FUNDOS|FDS|TERREO|SOBRELOJA|SUBSOLO)\b")
_WITHOUT = re.compile(r"(?<![A-Z0-9])(?:S\s*[./]?\s*N\s*\.?\s*O?\.?(?![A-Z0-9])|SEM\s+N(?:UMERO|RO?|O)?\b\.?)")
_NUMBER = re.compile(r"(?:#\s*|(?<![A-Z])N\s*\.?\s*(?:O|RO)?\s*[.:]?\s*)?(?<![A-Z0-9])0*(\d+)(?![A-Z0-9])|(?:#|(?<![A-Z])NO?\.?)\s*0*(\d+)")
_WORD = re.compile(r"[A-Z?]+")


_PLAIN = {ord(c): unicodedata.normalize("NFKD", c)[0].upper() for c in "áàâãäçéèêëíìîïñóòôõöúùûüÁÀÂÃÄÇÉÈÊËÍÌÎÏÑÓÒÔÕÖÚÙÛÜªº"} | {ord("°"): "O"}


_FOREIGN = re.compile(r"[^\x00-\x7f]")


def _plain(m: re.Match) -> str:
    return _PLAIN.get(ord(c := m[0]), c)


def fold(text: str) -> str:
    """Upper case without accents; signs outside ASCII that don't decompose become "?" inside words, nothing at their ends."""
    if text.isascii():
        return text.upper()
    t = _FOREIGN.sub(_plain, text).upper()
    if t.isascii():
        return t
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).upper()
    t = re.sub(r"[^\x00-\x7f]+", "?", t)
    return re.sub(r"\?+(?![A-Z])|(?<![A-Z])\?+", "", t)


def parse_street(text: str | None) -> tuple[str, str, str]:
    """(number, type, words): number without leading zeros, "SN" if marked as without, "" if missing.

    Words are joined by blanks, titles in full, linking words left out.
    """
    t = fold(text or "")
    t = _UNIT.sub(" ", _FLOOR.sub(" ", t))
    number, at = "", None
    if m := _WITHOUT.search(t):
        number, at = "SN", m.span()
    if m := _NUMBER.search(t):
        if at is None or at[0] > 0:
            number, at = (m.group(1) or m.group(2)), m.span()
            number = number.lstrip("0") or "SN"
    if at is not None:
        head, tail = t[: at[0]], t[at[1] :]
        t = head if _WORD.search(head) else tail
    t = re.split(r"\s-\s", t.strip(" ,-:"))[0]
    parts = [p for p in (_WORD.findall(x) for x in t.split(",")) if p]
    kind = ""
    if len(parts) > 1 and len(parts[-1]) == 1 and parts[-1][0] in _TYPE:
        kind = _TYPE[parts.pop()[0]]
    words = [w for p in parts for w in p]
    if words and not kind and words[0] in _TYPE and len(words) > 1:
        # a single letter is a type only if two words follow, else it may be an initial
        if len(words[0]) > 1 or len(words) > 2 or words[0] == "R":
            kind = _TYPE[words.pop(0)]
    if words and words[0] in _TITLE:
        words[0] = _TITLE[words[0]]
    return number, kind, " ".join(w for w in words if w not in _LINKING)


@lru_cache(maxsize=50_000)
def parse_district(text: str | None) -> str:
    words = _WORD.findall(fold(text or ""))
    if " ".join(words) in _NO_DISTRICT:
        return ""
    words[0] = _DISTRICT.get(words[0], words[0])
    return " ".join(w for w in words if w not in _LINKING)


def parse_postcode(text: str | None) -> str:
    """Eight digits, or "" for a missing value or a placeholder."""
    d = re.sub(r"\D", "", text or "")
    d = d.zfill(8) if len(d) == 7 else d
    return d if len(d) == 8 and len(set(d)) > 1 else ""


_SAME_SOUND = str.maketrans({"Z": "S", "X": "S", "K": "C", "Q": "C", "Y": "I", "W": "V", "H": None, "?": None})


@lru_cache(maxsize=50_000)
def _sound(word: str) -> tuple[str, ...]:
    s = re.sub(r"(.)\1+", r"\1", word.translate(_SAME_SOUND))
    c = s[:1] + re.sub(r"[AEIOU]", "", s[1:])
    return "<" + c[:3], ">" + c[-3:]


def sounds(words: str) -> set[str]:
    """Keys of a street: the first and last consonants of its last word, the first of the word before,
    and the beginnings of its first and last word together.

    One slip of the pen spoils at most one of the two keys of the last word. A street without any of these has its words.
    """
    w = words.split()
    out = {f"~{w[0][:3]}{w[-1][:1]}"} if len(w) > 1 else set()
    if w and len(w[-1]) > 2:
        out.update(_sound(w[-1]))
    if len(w) > 1 and len(w[-2]) > 2:
        out.add(_sound(w[-2])[0])
    return out or {f"w{words}"}


def _distance(a: str, b: str, most: int) -> int:
    """Edits with exchange of neighbours, up to most + 1: equal ends are cut off, the rest is filled a row at once."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    a, b = a[n:], b[n:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) or len(b)
    if most == 1:
        return 1 if len(a) == len(b) and (len(a) == 1 or len(a) == 2 and a[0] == b[1] and a[1] == b[0]) else 2
    # Hyyro's rows as bits: up and down are the steps along a column, bits above its end are never read
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    end, far = 1 << len(a) - 1, len(a)
    up, down, same, before = (end << 1) - 1, 0, 0, 0
    for y in b:
        here = at.get(y, 0)
        same = (((here & up) + up) ^ up) | here | down | ((~same & here) << 1 & before)
        more, less = down | ~(same | up), same & up
        if more & end:
            far += 1
        elif less & end:
            far -= 1
        more, less = more << 1 | 1, less << 1
        up, down, before = less | ~(same | more), more & same, here
    return min(far, most + 1)


@lru_cache(maxsize=100_000)
def _letters(word: str) -> int:
    """The letters that occur, as bits (some letters may share one)."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


@lru_cache(maxsize=100_000)
def _signs(word: str) -> int:
    """The signs of a word as bits, a sign that occurs again as another bit (some signs may share theirs)."""
    out = 0
    for c in word:
        bit = 1 << (ord(c) & 63)
        while out & bit:
            bit <<= 64
        out |= bit
    return out


@lru_cache(maxsize=1 << 17)
def likeness(a: str, b: str) -> float:
    """1 equal, 0.9 or 0.8 a slip or two, 0.6 an initial of the other, else 0."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.6 if a[0] == b[0] else 0.0
    short = min(len(a), len(b))
    most = 3 if short >= 9 else 2 if short >= 5 else 1
    if short < 3 or abs(len(a) - len(b)) > most:
        return 0.0
    # each edit takes one sign at most and brings in one
    x, y = _signs(a), _signs(b)
    if (x & ~y).bit_count() > most or (y & ~x).bit_count() > most:
        return 0.0
    d = _distance(a, b, most)
    return 0.0 if d > most else (1.0, 0.9, 0.8, 0.7)[d]


def street_level(a: str, b: str) -> int:
    """3 equal words, 2 near (slips, initials, a part missing), 1 a word in common, 0 none."""
    if a == b:
        return 3
    x, y = a.split(), b.split()
    if not x or not y:
        return 0
    if len(x) == len(y):
        same = [likeness(v, w) for v, w in zip(x, y)]
        if all(same) and any(len(v) > 2 and len(w) > 2 for v, w in zip(x, y)):
            return 2
    # best alignment in order; the first of three words is a title or a common word, which tells little
    score = [[(0.0, 0, 0)] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, v in enumerate(x, 1):
        for j, w in enumerate(y, 1):
            best = max(score[i - 1][j], score[i][j - 1])
            s = likeness(v, w)
            if s:
                p = score[i - 1][j - 1]
                own = min(len(v), len(w)) > 2 and (i > 1 or len(x) < 3) and (j > 1 or len(y) < 3)
                best = max(best, (p[0] + s, p[1] + 1, p[2] + own))
            score[i][j] = best
    _, pairs, whole = score[-1][-1]
    short, long = min(len(x), len(y)), max(len(x), len(y))
    if whole and pairs == short and long - short <= 1 and (short > 1 or long == 1):
        return 2
    # a word written apart or together
    if likeness("".join(x), "".join(y)) >= 0.7:
        return 2
    return 1 if whole else 0


def parsed(establishments: DataFrame, repair=None) -> DataFrame:
    """(cnpj, town, number, kind, words, district, postcode, keys) of every row with a cnpj, a town and an address."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fix = repair() if repair else None
        town = lru_cache(maxsize=100_000)(lambda u, m: fold(f"{u}|{m}".strip()))
        for f in frames:
            logr = f.logradouro
            if fix is not None:
                logr = [s if s.isascii() else fix(s) for s in logr]
            street = [parse_street(s) for s in logr]
            out = pd.DataFrame({"cnpj": f.cnpj, "town": [town(u, m) for u, m in zip(f.uf, f.municipio)]})
            out["number"], out["kind"], out["words"] = zip(*street) if street else ((), (), ())
            out["district"] = [parse_district(s) for s in f.bairro]
            out["postcode"] = [parse_postcode(s) for s in f.cep]
            out["keys"] = [[*sounds(w), "=" + c] if c and not c.endswith("000") else list(sounds(w)) for w, c in zip(out["words"], out["postcode"])]
            yield out

    rows = establishments.filter("cnpj is not null and uf is not null and municipio is not null and logradouro <> ''").select("cnpj", "uf", "municipio", "bairro", "logradouro", "cep")
    return rows.mapInPandas(run, "cnpj string, town string, number string, kind string, words string, district string, postcode string, keys array<string>")


def _levels(pairs: DataFrame) -> DataFrame:
    """Adds the agreement levels street, kind, district, postcode (missing is -1) and pattern."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level = lru_cache(maxsize=50_000)(street_level)
        for f in frames:
            yield pd.DataFrame({"a": f.a, "b": f.b, "l_street": [level(x, y) for x, y in zip(f.words_a, f.words_b)], "l_district": [_district_level(x, y) for x, y in zip(f.district_a, f.district_b)], "l_kind": f.l_kind, "l_postcode": f.l_postcode})

    def both(c: str) -> Column:
        return (F.col(f"{c}_a") != "") & (F.col(f"{c}_b") != "")

    near = (F.levenshtein("postcode_a", "postcode_b") <= 2) | (F.substring("postcode_a", 1, 5) == F.substring("postcode_b", 1, 5))
    ready = pairs.select(
        "a",
        "b",
        "words_a",
        "words_b",
        "district_a",
        "district_b",
        F.when(~both("kind"), -1).otherwise((F.col("kind_a") == F.col("kind_b")).cast("int")).alias("l_kind"),
        F.when(~both("postcode"), -1).when(F.col("postcode_a") == F.col("postcode_b"), F.when(F.col("postcode_a").endswith("000"), 1).otherwise(2)).when(near, 1).otherwise(0).alias("l_postcode"),
    )
    return ready.mapInPandas(run, "a bigint, b bigint, l_street int, l_district int, l_kind int, l_postcode int")


def _district_level(a: str, b: str) -> int:
    if not a or not b:
        return -1
    if a == b:
        return 1
    x, y = a.split(), b.split()
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    return int(likeness(a.replace(" ", ""), b.replace(" ", "")) > 0 or all(max(likeness(v, w) for w in long) > 0 for v in short))


FIELDS = ("l_street", "l_kind", "l_district", "l_postcode")
#: What is taken of matches and of others before any pair is seen, worth PRIOR_PAIRS pairs of each: it speaks only
#: where there are few pairs.
PRIOR_PAIRS = 10
PRIOR = {
    "l_street": ({3: 0.45, 2: 0.45, 1: 0.05, 0: 0.05}, {3: 0.05, 2: 0.05, 1: 0.3, 0: 0.6}),
    "l_kind": ({1: 0.75, -1: 0.2, 0: 0.05}, {1: 0.4, -1: 0.1, 0: 0.5}),
    "l_district": ({1: 0.6, -1: 0.35, 0: 0.05}, {1: 0.2, -1: 0.2, 0: 0.6}),
    "l_postcode": ({2: 0.5, 1: 0.3, -1: 0.15, 0: 0.05}, {2: 0.2, 1: 0.3, -1: 0.1, 0: 0.4}),
}


def estimate(patterns: pd.DataFrame, rounds: int = ROUNDS) -> tuple[float, dict, dict, np.ndarray]:
    """(share of matches, m, u, posterior of each pattern) by expectation-maximization.

    patterns has the FIELDS and n. Levels, the missing one too, are values like
    any other; fields are taken as independent given match or no match. The start
    takes agreement as the sign of a match, so the first class is that of the matches.
    """
    n = patterns.n.to_numpy(float)
    post = np.clip((patterns.l_street >= 2).to_numpy(float) * 0.9 + 0.05, 0.05, 0.95)
    p, m, u = 0.5, {}, {}
    for _ in range(rounds):
        p = float(((post * n).sum() + PRIOR_PAIRS) / (n.sum() + 2 * PRIOR_PAIRS))
        lm, lu = np.log(max(p, 1e-9)) * np.ones(len(n)), np.log(max(1 - p, 1e-9)) * np.ones(len(n))
        for f in FIELDS:
            for v in patterns[f].unique():
                at = (patterns[f] == v).to_numpy()
                pm, pu = PRIOR[f][0][int(v)], PRIOR[f][1][int(v)]
                m[f, v] = ((post * n)[at].sum() + PRIOR_PAIRS * pm) / ((post * n).sum() + PRIOR_PAIRS)
                u[f, v] = (((1 - post) * n)[at].sum() + PRIOR_PAIRS * pu) / (((1 - post) * n).sum() + PRIOR_PAIRS)
                lm[at] += np.log(m[f, v])
                lu[at] += np.log(u[f, v])
        post = 1 / (1 + np.exp(np.clip(lu - lm, -500, 500)))
    return p, m, u, post


def candidates(addresses: DataFrame) -> DataFrame:
    """Pairs of addresses (a < b) of one town and number that share a postal code or a sound, each once.

    A block is named by a hash of town, number and key, which keeps what is
    shuffled small; a pair thrown together by equal hashes is dropped by place.
    Blocks that hold many of the keys are spread over slots.
    """
    cols = ("place", "words", "kind", "district", "postcode")
    keyed = addresses.select(F.explode("keys").alias("k"), "place", "aid").select(F.xxhash64("place", "k").alias("key"), "aid")
    hot = hot_keys(keyed, "key")
    one, two = keyed.withColumnRenamed("aid", "a"), keyed.withColumnRenamed("aid", "b")
    on = ["key"]
    if hot:
        one, two, on = one.withColumn("_slot", slot(F.col("key"), hot, F.col("a"))), in_slots(two, "key", hot), ["key", "_slot"]
    ids = one.join(two, on).filter("a < b").select("a", "b").distinct()
    left = addresses.select(F.col("aid").alias("a"), *[F.col(c).alias(f"{c}_a") for c in cols])
    right = addresses.select(F.col("aid").alias("b"), *[F.col(c).alias(f"{c}_b") for c in cols])
    return ids.join(left, "a").join(right, "b").filter("place_a = place_b")


def _with_itself(addresses: DataFrame) -> DataFrame:
    """The levels of two establishments whose addresses are spelt alike: every part equal or missing."""

    def part(c: str, agree: Column | int) -> Column:
        return F.when(F.col(c) == "", -1).otherwise(agree).alias(f"l_{c}")

    return addresses.select(F.col("aid").alias("a"), F.col("aid").alias("b"), F.lit(3).alias("l_street"), part("kind", 1), part("district", 1), part("postcode", F.when(F.col("postcode").endswith("000"), 1).otherwise(2)))


def linked_addresses(establishments: DataFrame, repair=None, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (aid, cnpj) gives each establishment's spellings of its address, links (a, b, w), a <= b,
    the spellings at the same place with the posterior of the levels at which they agree; a row with a = b says the same
    of the establishments that share one spelling. No pairs of establishments are listed.

    A spelling is a town, number, street type, words, district and postal code as parsed. Weights are estimated over all
    candidate pairs of spellings, each once, so a door with many establishments weighs no more than another. Rows without
    cnpj, town or address, or with neither a number nor the mark "without number", are at no known place. Repeated rows
    count once. An empty table gives no rows.
    """
    spark = establishments.sparkSession
    work = Work(spark, "addresses")
    rows = parsed(establishments, repair).filter("number <> '' and words <> ''")
    rows = work.save(rows.withColumn("aid", F.xxhash64("town", "number", "kind", "words", "district", "postcode")), "parsed")
    addresses = work.save(rows.select("aid", F.xxhash64("town", "number").alias("place"), "words", "kind", "district", "postcode", "keys").dropDuplicates(["aid"]), "spellings")
    compared = work.save(_levels(candidates(addresses)), "compared")
    alike = _with_itself(addresses)
    # at most 4 x 3 x 3 x 4 patterns; those of equal spellings are weighed, not counted
    patterns = compared.groupBy(*FIELDS).agg(F.count(F.lit(1)).alias("n")).unionByName(alike.select(*FIELDS).distinct().withColumn("n", F.lit(0).cast("bigint"))).groupBy(*FIELDS).agg(F.sum("n").alias("n")).toPandas()
    weights = []
    if len(patterns):
        _, _, _, post = estimate(patterns)
        weights = [(*(int(v) for v in row), float(w)) for row, w in zip(patterns[list(FIELDS)].to_numpy(), post)]
    table = spark.createDataFrame(weights, ", ".join(f"{f} int" for f in FIELDS) + ", w double").filter((F.col("w") >= threshold) & (F.col("l_street") > 0))
    members = rows.select("aid", "cnpj").distinct()
    # a spelling of one establishment alone needs no link to itself
    shared = members.groupBy("aid").agg((F.min("cnpj") < F.max("cnpj")).alias("many")).filter("many").select(F.col("aid").alias("a"))
    both = compared.unionByName(alike.join(shared, "a", "left_semi").select(*compared.columns))
    return members, both.join(F.broadcast(table), list(FIELDS)).select("a", "b", "w")


def same_place(establishments: DataFrame, repair=None, threshold: float = THRESHOLD) -> DataFrame:
    """(cnpj_a, cnpj_b, peso): linked_addresses() unfolded into pairs of different cnpj, cnpj_a < cnpj_b, with the posterior."""
    members, links = linked_addresses(establishments, repair, threshold)
    x, y = members.select(F.col("aid").alias("a"), F.col("cnpj").alias("x")), members.select(F.col("aid").alias("b"), F.col("cnpj").alias("y"))
    found = links.join(x, "a").join(y, "b").filter((F.col("x") != F.col("y")) & ((F.col("a") < F.col("b")) | (F.col("x") < F.col("y"))))
    return found.groupBy(F.least("x", "y").alias("cnpj_a"), F.greatest("x", "y").alias("cnpj_b")).agg(F.max("w").alias("peso"))
