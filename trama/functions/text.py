"""Text, date and page functions as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from trama.functions.constants import MONTHS


def column_name(name: str) -> str:
    """A header as a plain name: ASCII, lower case, other signs as single underscores."""
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    return re.sub("[^a-z0-9]+", "_", plain.lower()).strip("_")


def flexible_date(c: Column) -> Column:
    """A date from AAAAMMDD, AAAA-MM-DD or D/M/AAAA; null if there is no such day."""
    t = F.trim(c)
    d = F.regexp_replace(t, "[^0-9]", "")
    slashed = F.try_to_date(F.regexp_extract(t, r"^([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})", 1), "d/M/yyyy")
    return F.when(t.contains("/"), slashed).when(F.length(d) >= 8, F.try_to_date(F.substring(d, 1, 8), "yyyyMMdd"))


def long_date(c: Column) -> Column:
    months = F.array(*map(F.lit, MONTHS))
    return F.concat(F.dayofmonth(c).cast("string"), F.lit(" de "), F.element_at(months, F.month(c)), F.lit(" de "), F.year(c).cast("string"))


def name_key(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def mail_domain(c: Column, leave_out: tuple[str, ...] = ()) -> Column:
    """The domain in lower case, null for those left out (providers that anyone may use)."""
    d = F.lower(F.substring_index(c, "@", -1))
    return F.when(~d.isin(*leave_out), d) if leave_out else d


def person_key(name: Column, mask: Column) -> Column:
    """NAME [***dddddd**] where the mask is well formed, else NAME."""
    n, m = F.upper(F.trim(F.coalesce(name, F.lit("")))), F.trim(mask)
    return F.when(m.rlike(r"^\*{3}[0-9]{6}\*{2}$"), F.concat(n, F.lit(" ["), m, F.lit("]"))).otherwise(n)


def page_text(c: Column) -> Column:
    """A page as comparable text: no scripts, styles or tags, digits as 0, lower case, single blanks."""
    t = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " ")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    t = F.regexp_replace(F.lower(t), "[0-9]+", "0")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def shingles(text: Column, k: int = 3) -> Column:
    """The set of k-word sequences; a shorter text is its own only member, an empty one has none."""
    from trama.functions.identifiers import let

    none = F.array().cast("array<string>")

    def many(w: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.concat_ws(" ", F.slice(w, i, F.lit(k)))))

    # the words are bound once, not split again for every place
    return F.when(text == "", none).otherwise(let(F.split(text, " "), lambda w: F.when(F.size(w) < k, F.array(F.array_join(w, " "))).otherwise(many(w))))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members; 1 if both are empty, 0 if one is."""
    na, nb = F.size(a), F.size(b)
    common = F.size(F.array_intersect(a, b))
    return F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.0).otherwise(common / (na + nb - common))


def fingerprint(page: Column) -> Column:
    return F.substring(F.sha2(page_text(page), 256), 1, 16)


def verdict(status: Column, likeness: Column, base_status: Column, has_base: Column, limit: float = 0.90) -> Column:
    """STRUCT<descartar, motivo>: whether an answer can't be told from the answer to an impossible value."""
    reason = (
        F.when(status == 0, "sem resposta")
        .when(status >= 400, "erro da fonte")
        .when((base_status == 0) | ~has_base, "sem referencia")
        .when(base_status >= 400, "a fonte distingue pelo status")
        .when(likeness >= limit, "igual a de um valor impossivel")
        .otherwise("diferente da de um valor impossivel")
    )
    return F.struct(reason.isin("sem resposta", "erro da fonte", "igual a de um valor impossivel").alias("descartar"), reason.alias("motivo"))


def claim_id(kind: Column, key: Column) -> Column:
    return F.concat(F.lit("C-"), F.substring(F.sha2(F.concat_ws("|", kind, key), 256), 1, 10))


def target_kind(c: Column) -> Column:
    """STRUCT<tipo, valor> of a search value: email, cnpj, cep, dominio or telefone."""
    from trama.functions import identifiers as ids

    return ids.let(F.trim(c), _target)


def _target(t: Column) -> Column:
    from trama.functions import identifiers as ids
    from trama.functions import phones

    host = F.regexp_replace(F.regexp_replace(F.lower(t), r"^[a-z]+://", ""), r"^www\.|/.*$", "")
    kind = (
        F.when(t.contains("@"), "email")
        .when(ids.cnpj_valid(t), "cnpj")
        .when(t.rlike(r"^[0-9]{5}-[0-9]{3}$") & ids.postcode_valid(t), "cep")
        .when(t.rlike("[A-Za-z]") & t.contains("."), "dominio")
        .otherwise("telefone")
    )
    value = F.when(kind == "email", F.lower(t)).when(kind == "cnpj", ids.cnpj_clean(t)).when(kind == "cep", ids.digits(t)).when(kind == "dominio", host).otherwise(phones.normalise(t)["chave"])
    return F.struct(kind.alias("tipo"), value.alias("valor"))
