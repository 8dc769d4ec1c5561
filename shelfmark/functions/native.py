"""Column expressions that stay within whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import BRITISH, IRREGULAR, SMALL

PLAIN_ARTICLE = "^(.*), (The|A|An)$"


def words(text: Column) -> Column:
    """T1 for ASCII text: lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def collapse(text: Column) -> Column:
    """Each run of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\x{A0}]+", " "))


def plain_display_title(title: Column) -> Column:
    """N7 for a title that ends in an English article."""
    return F.regexp_replace(collapse(title), PLAIN_ARTICLE, "$2 $1")


def clean_title(title: Column) -> Column:
    """Bracketed notes after white space go."""
    return collapse(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+[(\[][^)\]]*[)\]]", " "))


def title_key(title: Column) -> Column:
    """A title without notes, articles, case and punctuation."""
    key = F.trim(F.regexp_replace(F.lower(plain_display_title(clean_title(title))), "[^a-z0-9]+", " "))
    return F.regexp_replace(key, "^(the|a|an) ", "")


def bare(text: Column) -> Column:
    """N10."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def without_residue(title: Column) -> Column:
    """Pasted cell references at the end go."""
    return F.regexp_replace(F.coalesce(title, F.lit("")), r"\+[0-9A-Za-z:]*:[0-9A-Za-z:]*\s*$", "")


def _two_way(pairs: dict[str, str], word: Column) -> Column:
    both = pairs | {b: a for a, b in pairs.items()}
    return F.element_at(F.create_map(*[F.lit(x) for kv in both.items() for x in kv]), word)


def _forms(*cases: Column) -> Column:
    return F.array_compact(F.array(*cases))


def plural_forms(word: Column) -> Column:
    """Singulars and plurals that an English word may have, in a fixed order."""
    n, w = F.length(word), word
    cut = lambda k, tail="": F.concat(F.substring(w, F.lit(1), n - k), F.lit(tail))
    ends = lambda pattern: w.rlike(f"(?:{pattern})$")
    ies, ves, es = ends("ies"), ends("ves"), ends("(?:s|x|z|ch|sh)es")
    vowel_y, fe, f, hiss = ends("[^aeiou]y"), ends("fe"), ends("f"), ends("(?:s|x|z|ch|sh)")
    long = n >= 4
    return _forms(
        _two_way(IRREGULAR, w),
        F.when(long & ies, cut(3, "y")), F.when(long & ies, cut(1)),
        F.when(long & ~ies & ves, cut(3, "f")), F.when(long & ~ies & ves, cut(3, "fe")), F.when(long & ~ies & ves, cut(1)),
        F.when(long & ~ies & ~ves & es, cut(2)),
        F.when(long & ~ies & ~ves & ~es & ends("s") & ~ends("ss|us|is"), cut(1)),
        F.when((n >= 6) & ends("[^aeiou]oes"), cut(2)),
        F.when(long & vowel_y, cut(1, "ies")).when(long & fe, cut(2, "ves")).when(long & f, cut(1, "ves")).when(long & hiss, cut(0, "es")).when(long, cut(0, "s")),
        F.when(long & ends("[^aeiou]o"), cut(0, "es")),
    )


def british_american(word: Column) -> Column:
    """The word as spelt on the other side of the Atlantic."""
    n = F.length(word)

    def swap(floor: int, pattern: str, new: str, unless: str = "") -> Column:
        test = (n >= floor) & word.rlike(pattern)
        return F.when(test & ~word.rlike(unless) if unless else test, F.regexp_replace(word, pattern, new))

    ise = "(e|ed|es|ing|ation|ations|er|ers)$"
    return _forms(
        _two_way(BRITISH, word),
        F.coalesce(swap(5, "^(.+)our(s|ed|ite|ites)?$", "$1or$2", "oor"), swap(5, "^(.+)or(s|ed|ite|ites)?$", "$1our$2", "oor")),
        F.coalesce(swap(6, f"^(.+)is{ise}", "$1iz$2"), swap(6, f"^(.+)iz{ise}", "$1is$2")),
        F.coalesce(swap(5, "^(.+)tre(s?)$", "$1ter$2"), swap(5, "^(.+)ter(s?)$", "$1tre$2")),
    )


def is_small(word: Column) -> Column:
    return word.isin(SMALL)


def truncated(text: Column, most_chars: int = 300, most_words: int = 12) -> Column:
    """Of an overlong query the first words that are not small."""
    kept = F.slice(F.filter(F.split(collapse(text), " "), lambda w: ~F.lower(w).isin(SMALL)), 1, most_words)
    return F.when(F.length(text) > most_chars, F.array_join(kept, " ")).otherwise(text)


def column_letter(index: Column) -> Column:
    """0 is A, 25 Z, 26 AA; up to three letters."""
    letter = lambda k: F.char((F.lit(65) + k).cast("bigint"))
    one = letter(index % 26)
    two = F.when(index >= 26, letter((F.floor(index / 26) - 1) % 26)).otherwise("")
    three = F.when(index >= 702, letter((F.floor((index - 26) / 676) - 1) % 26)).otherwise("")
    return F.concat(three, two, one)


def csv_cell(value: Column) -> Column:
    """No formula injection, quotes where needed."""
    safe = F.when(value.rlike("^[=+@\\t\\r-]"), F.concat(F.lit("'"), value)).otherwise(F.coalesce(value, F.lit("")))
    return F.when(safe.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


# --- ISBN (I1-I3) --------------------------------------------------------------------------------------------------


def _digit(d: Column, i: int) -> Column:
    return F.substring(d, i + 1, 1).cast("int")


def check13(core: Column) -> Column:
    total = reduce(Column.__add__, [_digit(core, i) * (3 if i % 2 else 1) for i in range(12)])
    return F.concat(core, ((10 - total % 10) % 10).cast("string"))


def check10(core: Column) -> Column:
    total = reduce(Column.__add__, [_digit(core, i) * (10 - i) for i in range(9)])
    c = (11 - total % 11) % 11
    return F.concat(core, F.when(c == 10, "x").otherwise(c.cast("string")))


def isbn_key(d: Column) -> Column:
    """The twelve digits that an ISBN-10 and its ISBN-13 share; the check digit plays no part."""
    return F.when(F.length(d) == 10, F.concat(F.lit("978"), F.substring(d, 1, 9))).otherwise(F.substring(d, 1, 12))


def isbn_forms(d: Column) -> Column:
    """Both written forms, for searches by their beginning."""
    ten = F.array(d, check13(F.concat(F.lit("978"), F.substring(d, 1, 9))))
    return F.when(F.length(d) == 10, ten).when(d.startswith("978"), F.array(d, check10(F.substring(d, 4, 9)))).otherwise(F.array(d))


def complete_isbn(d: Column) -> Column:
    return d.rlike("^(?:[0-9]{9}[0-9x]|97[89][0-9]{10})$")


def year_range(text: Column) -> Column:
    """The years of 2010, 2010-2011 or 2010/11."""
    a = F.regexp_extract(text, "^\\s*((?:19|20)[0-9]{2})", 1)
    b = F.regexp_extract(text, "^\\s*(?:19|20)[0-9]{2}\\s*[-/]\\s*((?:19|20)?[0-9]{2})\\s*$", 1)
    start = F.when(a != "", a.cast("int"))
    end = F.when(F.length(b) == 4, b.cast("int")).when(F.length(b) == 2, (start + F.pmod(b.cast("int") - start, F.lit(100))).cast("int")).otherwise(start)
    return F.struct(start.alias("start"), end.alias("end"))


def https_only(url: Column) -> Column:
    """The link, if it is an https one."""
    return F.when(url.rlike("^https://[^\\s/]+"), url)
