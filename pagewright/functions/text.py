"""Text repair as native expressions: white space, samples, letter-spaced words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.binding import let

#: White space of all kinds, by its Unicode property; fixed values.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_A = "\\p{IsAlphabetic}"
_MARK = "[\\u0300-\\u036F\\u1AB0-\\u1AFF\\u1DC0-\\u1DFF\\u20D0-\\u20FF\\uFE20-\\uFE2F]"
_SPACE = "[ \\t\\u00A0\\u202F]"
_LETTER = f"{_A}{_MARK}*+"
#: A letter-spaced phrase: letters one separator apart (the next letter stands alone), words two or more apart. It does not
#: start inside a word, nor with the words и and о, which are left to stand alone.
_PHRASE = f"(?<!{_A})(?![ИиОо](?!{_MARK})){_LETTER}(?!{_A})(?:{_SPACE}(?!{_SPACE}){_LETTER}(?!{_A})|{_SPACE}{{2,}}{_LETTER})++"

#: A letter of the script that old Russian prints space out, a fixed value.
CYRILLIC = "\\p{IsCyrillic}"

#: Two letters that each stand alone, without which no phrase is long enough to be joined.
_ALONE = f"{_SPACE}{_LETTER}{_SPACE}+{_LETTER}{_SPACE}"


def clean_ws(text: Column) -> Column:
    """Runs of white space of any kind become one space; trimmed."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def sample(text: Column, limit: int) -> Column:
    """The first characters, with an ellipsis if there are more; 0: empty."""
    if limit <= 0:
        return F.when(text.isNotNull(), F.lit(""))
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)


def _joined(phrase: Column, script: str | None) -> Column:
    """A phrase with its words joined if it is long enough to be meant so and holds a letter of the script, else as it is."""

    def judged(words: Column) -> Column:
        sizes = F.transform(words, lambda w: F.size(F.split(w, _SPACE, -1)))
        total = F.aggregate(sizes, F.lit(0), lambda a, n: a + n)
        good = (total - F.size(sizes) >= 2) & ((F.array_max(sizes) >= 4) | ((F.size(sizes) > 1) & (total >= 5)))
        good = good if script is None else good & F.rlike(phrase, F.lit(script))
        return F.when(good, F.array_join(F.transform(words, lambda w: F.regexp_replace(w, _SPACE, "")), " ")).otherwise(phrase)

    return let(F.split(phrase, f"{_SPACE}{{2,}}", -1), judged)


def despace(text: Column, script: str | None = None) -> Column:
    """Letter-spaced phrases joined: к ъ  с л о в у becomes къ слову. One pass of one expression over the text.

    script: a character class, of which a phrase must hold a letter to be joined; without it letters of all scripts do."""

    def repaired(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(_PHRASE), 0)
        whole = F.array_join(F.zip_with(F.split(t, _PHRASE, -1), found, lambda b, p: F.concat(b, F.coalesce(_joined(p, script), F.lit("")))), "")
        spaced = F.rlike(t, F.lit(_ALONE))
        return F.when(spaced if script is None else spaced & F.rlike(t, F.lit(script)), whole).otherwise(t)

    return let(text, repaired)


#: A capital and the rest of its word, fixed values.
_CAPITAL, _REST = "[А-ЯіІѢѲѴЁ]", "[а-яіѣѳѵъьё]"


def glue_initials(text: Column) -> Column:
    """A capital set apart from its word (a drop cap in a tag of its own) joins it."""
    apart = f"({_CAPITAL}){_SPACE}+({_REST})"
    return let(text, lambda t: F.when(F.rlike(t, F.lit(apart)), F.regexp_replace(t, f"(?U)\\b{apart}", "$1$2")).otherwise(t))
