"""String functions of the venue model as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from atrium import params



def _bare(c: str, form: str) -> str:
    return "".join(x for x in unicodedata.normalize(form, c) if not unicodedata.combining(x))


#: Letters with marks, from Latin to the letterlike symbols, and what canonical decomposition leaves of them.
_MARKED = {c: _bare(c, "NFD") for c in map(chr, range(0xC0, 0x2200))}
ACCENTED = "".join(c for c, b in _MARKED.items() if b != c and len(b) == 1)
PLAIN = "".join(_MARKED[c] for c in ACCENTED)
#: Characters that compatibility decomposition turns into one ASCII character, such as ordinal signs, or into more, such as ligatures.
_COMPATIBLE = {c: _bare(c, "NFKD").encode("ascii", "ignore").decode().lower() for c in map(chr, [*range(0xA0, 0x2200), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)])}
_ONE = {c: b for c, b in _COMPATIBLE.items() if len(b) == 1}
_MORE = {c: b for c, b in _COMPATIBLE.items() if len(b) > 1 and c.isalpha() and c.islower()}


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text) -> Column:
    return F.filter(F.split(F.trim(F.lower(col(text))), r"\s+"), lambda w: w != "")


def title_case(text, particles=params.PARTICLES) -> Column:
    """Words capitalised but for particles after the first; null for an empty text."""
    one = F.transform(words(text), lambda w, i: F.when((i > 0) & w.isin(*particles), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))))
    return F.nullif(F.array_join(one, " "), F.lit(""))


def title_case_hyphens(text, particles=params.PARTICLES_MORE) -> Column:
    """As title_case, with more particles and capitals after hyphens; an empty text stays empty."""
    cap = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
    one = F.transform(words(text), lambda w, i: F.when((i > 0) & w.isin(*particles), w).otherwise(F.array_join(F.transform(F.split(w, "-"), cap), "-")))
    return F.array_join(one, " ")


def fold(text) -> Column:
    """Lower case without marks, on whatever letter they stand."""
    return F.translate(F.regexp_replace(F.lower(col(text)), r"\p{Mn}", ""), ACCENTED, PLAIN)


def ascii_fold(text) -> Column:
    """Lower case in ASCII: marks go, compatible forms become plain ones, and what isn't ASCII then goes."""
    out = F.translate(fold(text), "".join(_ONE), "".join(_ONE.values()))
    for c, plain in _MORE.items():
        out = F.replace(out, F.lit(c), F.lit(plain))
    return F.regexp_replace(out, r"[^\x00-\x7F]", "")


def escape_html(text) -> Column:
    out = col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def hex_colour(r, g, b) -> Column:
    return F.format_string("#%02x%02x%02x", col(r).cast("int"), col(g).cast("int"), col(b).cast("int"))


def letter(position) -> Column:
    """A for 0, and again after Z."""
    return F.chr((F.lit(65) + F.pmod(col(position), F.lit(26))).cast("long"))


def subtitle(kind, cat, code) -> Column:
    """The line under a search hit."""
    kind, cat, code = col(kind), col(cat), col(code)
    area = F.coalesce(*[F.when(cat == k, v) for k, v in params.AREA_LABELS.items()], F.lit("Área"))
    street = F.regexp_extract(code, r"^(AA|BB|CC|DD|[A-K])(?=[0-9])", 1)
    number = F.substr(code, F.lit(3)).try_cast("long").cast("string")
    return (
        F.when(kind == "area", area)
        .when(F.coalesce(code, F.lit("")) == "", "Estande")
        .when(code.startswith("TL"), F.concat(F.lit("Lugar nº "), number, F.lit(" · Travessa Literária")))
        .when(code.startswith("TI"), F.concat(F.lit("Estande "), code, F.lit(" · Alameda dos Artistas")))
        .when(street != "", F.concat(F.lit("Estande "), code, F.lit(" · Rua "), street))
        .otherwise(F.concat(F.lit("Estande "), code))
    )
