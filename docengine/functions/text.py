"""Column helpers that give Java's regular expressions and string functions the meaning of a Unicode-aware reader.

Patterns are written once, in the common subset of Python and Java. ``java`` makes them case-insensitive and Unicode-aware
and lets only a newline end a line.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates lines: a pair or one of ten single characters.
OTHER_ENDS = "\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029"
LINE_END = f"\\r\\n|[\\n{OTHER_ENDS}]"
#: What (?U)\\s matches.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Stands between a raw value and its confidence in a packed match; the last one counts, as a text may hold it and a confidence doesn't.
UNIT = "\x1f"


def java(pattern: str, ignore_case: bool = True, multiline: bool = False) -> str:
    return f"(?{'i' if ignore_case else ''}Ud{'m' if multiline else ''})" + pattern


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends. Single spaces, which stay, aren't matched."""
    return F.regexp_replace(strip(c), "(?U)\\s\\s+|[\\s&&[^ ]]", " ")


def let(c: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``c``, which is evaluated and written into the plan once however often ``then`` uses it."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def apart(c: Column) -> Column:
    """``c`` kept out of whole-stage code by a lambda. Spark then generates its projection in small methods, which the JVM compiles; one method of
    more than 8000 bytes, as of many columns at once, is interpreted for every row."""
    return let(c, lambda x: x)


def only(df: DataFrame, condition: Column) -> DataFrame:
    """Rows of ``df`` for which ``condition`` holds, looked at after ``df``'s columns are made. Spark moves a filter below the columns that it reads and
    writes them out in it, patterns and texts with them, once for each use; arrays of one row or none stay where they are."""
    return df.select(F.inline(F.when(condition, F.array(F.struct(*df.columns)))))


def lines(c: Column) -> Column:
    """Lines without their ends; text that ends with a line end has no empty last line."""
    parts = F.when(c.rlike(f"[{OTHER_ENDS}]"), F.split(c, LINE_END)).otherwise(F.split(c, "\n"))  # Java compiles no pattern for one character
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def found(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def matches(c: Column, pattern: str) -> Column:
    """Whether ``pattern`` matches at the start."""
    flags, _, rest = pattern.partition(")")
    return c.rlike(f"{flags})^(?:{rest})") if pattern.startswith("(?") and rest else c.rlike(f"^(?:{pattern})")


def pack(raw: Column, confidence: float) -> Column:
    """raw and confidence in one string, null if raw is null or empty, so that coalesce() stops at the first match and
    each pattern runs once."""
    return let(raw, lambda x: F.when(x != "", F.concat(x, F.lit(f"{UNIT}{confidence}"))))


def raw_of(packed: Column) -> Column:
    return F.substr(packed, F.lit(1), F.length(packed) - F.length(F.substring_index(packed, UNIT, -1)) - 1)


def confidence_of(packed: Column) -> Column:
    return F.substring_index(packed, UNIT, -1).cast("double")


def folded(c: Column) -> Column:
    """``c`` in small letters; the four other characters that (?iU) takes for ASCII letters are those letters."""
    plain = c
    for odd, letter in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k")):
        c = F.replace(c, F.lit(odd), F.lit(letter))
    return F.lower(F.when(F.length(plain) == F.octet_length(plain), plain).otherwise(c))  # ASCII texts have none of them


def where_words(low: Column | None, words: list[str] | None, then: Column) -> Column:
    """``then`` where the folded text ``low`` holds one of ``words``, else null: spares texts without them the pattern."""
    return then if low is None or words is None else F.when(any_of([low.contains(w) for w in words]), then)


def beginning(first: str | None) -> str:
    """What begins a pattern whose matches begin with one of the characters ``first``."""
    return f"(?=[{first}])" if first else ""


def first_match(
    c: Column, table: list[tuple[str, str, str, float]], flags: dict[int, str] | None = None, low: Column | None = None, words: list[list[str] | None] | None = None, first: list[str | None] | None = None,
) -> Column:
    """The packed first match of an ordered table of (label, value, tail, confidence): by order of the table, not by place."""
    out = []
    for i, (a, v, t, confidence) in enumerate(table):
        pattern = f"{beginning(first and first[i])}{(flags or {}).get(i, '(?iUd)')}(?:{a})({v})(?:{t})"
        packed = F.concat(strip(F.regexp_extract(c, pattern, 1)), F.lit(f"{UNIT}{confidence}"))
        # Each pattern runs once, matched or not: of a packed value that is empty nothing is left. No lambda, so that Spark generates code for all of it.
        out.append(where_words(low, words and words[i], F.get(F.regexp_extract_all(packed, F.lit(f"(?s)^[^{UNIT}].*"), F.lit(0)), F.lit(0))))
    return F.coalesce(*out)


def evidence(c: Column, table: list[tuple[str, str, str, float]], flags: dict[int, str] | None = None, low: Column | None = None, words: list[list[str] | None] | None = None) -> Column:
    """struct<text, start, end> of the match that first_match takes: its stripped text and its value's place in ``c``."""
    out = []
    for i, (a, v, t, _) in enumerate(table):
        p = f"{(flags or {}).get(i, '(?iUd)')}({a})({v})(?:{t})"
        start = F.regexp_instr(c, F.lit(p)) - 1 + F.length(F.regexp_extract(c, p, 1))
        value = F.regexp_extract(c, p, 2)
        out.append(where_words(low, words and words[i], F.when(strip(value) != "", F.struct(strip(F.regexp_extract(c, p, 0)).alias("text"), start.alias("start"), (start + F.length(value)).alias("end")))))
    return F.coalesce(*out)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def count_true(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [c.cast("int") for c in conditions])
