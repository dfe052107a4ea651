"""Scalar column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_separators(c) -> Column:
    """Remove the characters that separate fields in serialised paths."""
    return F.regexp_replace(col(c), "[,;:]", "")


def extract_valid(c, pattern: str) -> Column:
    """The whole value when it matches ``pattern``, null otherwise."""
    return F.nullif(F.regexp_extract(col(c), pattern, 0), F.lit(""))


def digest(*parts, blank: str = "_") -> Column:
    """md5 over the concatenated parts, nulls written as ``blank``."""
    return F.md5(F.concat(*[F.coalesce(col(p).cast("string"), F.lit(blank)) for p in parts]))


def keyed(array, index: int, key: str = "index", value: str = "value") -> Column:
    """Value of the first struct whose key equals ``index``; null when absent."""
    return F.get(F.filter(col(array), lambda x: x[key] == index), F.lit(0))[value]


def count_where(array, predicate) -> Column:
    return F.size(F.filter(F.coalesce(col(array), F.array()), predicate))


def uniform(seed, *ids) -> Column:
    """A number in [0, 1) that depends on the row's id only, so a recomputed task draws it again."""
    text = F.concat_ws("|", F.lit(str(seed)), *[col(i).cast("string") for i in ids])
    return F.conv(F.left(F.md5(text), F.lit(8)), 16, 10).cast("double") / float(1 << 32)


def snap_price(c) -> Column:
    """Nearest multiple of five (half to even) minus one cent."""
    return F.bround(col(c) / 5) * 5 - 0.01


def capitalise(c) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.left(col(c), F.lit(1))), F.lower(F.substring(col(c), 2, 1 << 30)))


def title_words(c) -> Column:
    """Every blank-separated word capitalised; a leading sharp s becomes ``Ss``."""
    word = lambda w: F.concat(F.when(F.left(w, F.lit(1)) == "ß", "Ss").otherwise(F.upper(F.left(w, F.lit(1)))),
                              F.lower(F.substring(w, 2, 1 << 30)))
    return F.array_join(F.transform(F.split(col(c), " "), word), " ")


# Accented letters and their plain forms, position by position.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyAAAAAAEEEEIIIIOOOOOUUUUCNY"


def plain_letters(c) -> Column:
    return F.translate(col(c), ACCENTED, PLAIN)


def slug_state(c) -> Column:
    """Plain letters, no quotes (or byte-literal prefix), blanks as underscores."""
    return F.replace(F.regexp_replace(plain_letters(c), "b'|'", ""), F.lit(" "), F.lit("_"))


def black_friday(year) -> Column:
    """The day after the fourth Thursday of November."""
    first = F.make_date(col(year), F.lit(11), F.lit(1))
    # weekday(): Monday=0 ... Thursday=3
    to_thursday = F.pmod(F.lit(3) - F.weekday(first), F.lit(7))
    return F.date_add(first, (to_thursday + 22).cast("int"))


def days_since_black_friday(date) -> Column:
    """Days since the latest one strictly before ``date``."""
    this_year, last_year = black_friday(F.year(col(date))), black_friday(F.year(col(date)) - 1)
    return F.datediff(col(date), F.when(col(date) <= this_year, last_year).otherwise(this_year))


def week_of_month(date) -> Column:
    d = col(date)
    weeks = F.datediff(F.trunc(d, "week"), F.trunc(F.trunc(d, "month"), "week"))
    return (weeks / 7).cast("int") + 1


def year_gap(start, end) -> Column:
    """Calendar-year boundaries crossed, as warehouses count years."""
    return F.year(col(end)) - F.year(col(start))


def cut(c, edges, labels, include_lowest=False, default=None) -> Column:
    """Right-closed bins ``(edges[i], edges[i+1]]`` named by ``labels``."""
    v, out = col(c), None
    for i, label in enumerate(labels):
        low = v >= edges[i] if include_lowest and i == 0 else v > edges[i]
        cond = low & (v <= edges[i + 1])
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out if default is None else out.otherwise(default)


def recode(c, mapping: dict, default=None) -> Column:
    """Id-to-id map evaluated row by row (no join) with a default."""
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
    found = F.element_at(F.create_map(*pairs), col(c))
    return found if default is None else F.coalesce(found, F.lit(default))


def decay_days(times, newest=None) -> Column:
    """Days from each epoch second in the array to ``newest`` (default: the latest in the array)."""
    newest = F.array_max(col(times)) if newest is None else col(newest)
    return F.transform(col(times), lambda t: (newest - t) / 86400.0)
