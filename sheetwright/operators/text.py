"""Text operators: counts, finding and replacing, splitting, line differences, headings, scripts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Misspellings that are put right while typing.
AUTOCORRECT = {
    "teh": "the", "adn": "and", "hte": "the", "taht": "that", "wiht": "with", "thier": "their", "recieve": "receive", "occured": "occurred", "seperate": "separate", "definately": "definitely",
    "accomodate": "accommodate", "acheive": "achieve", "occurence": "occurrence", "enviroment": "environment", "goverment": "government", "begining": "beginning", "beleive": "believe",
    "calender": "calendar", "collegue": "colleague", "commitee": "committee", "concensus": "consensus",
}


def word_count(text: Column) -> Column:
    """Pieces between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words, chars, chars_no_spaces, paragraphs)."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        key,
        word_count(t).alias("words"),
        F.char_length(t).cast("long").alias("chars"),
        F.char_length(F.regexp_replace(t, r"\s", "")).cast("long").alias("chars_no_spaces"),
        F.size(F.filter(F.split(t, "\n"), lambda p: F.trim(p) != "")).cast("long").alias("paragraphs"),
    )


def paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, text): the lines of a text, CR and CRLF read as LF."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)
    return df.select(key, F.posexplode(lines).alias("ord", "text"))


def _pattern(needle: str, regex: bool, whole_word: bool, match_case: bool) -> str:
    p = needle if regex else re.sub(r"([\\.^$|?*+()\[\]{}-])", r"\\\1", needle)
    p = rf"(?<![\p{{L}}\p{{N}}_])(?:{p})(?![\p{{L}}\p{{N}}_])" if whole_word else p
    return p if match_case else "(?iu)" + p


def find(df: DataFrame, key: str, text: str, needle: str, regex: bool = False, whole_word: bool = False, match_case: bool = False) -> DataFrame:
    """(key, hits, first_at): matches in a text and the code point at which the first starts (from 0)."""
    p = F.lit(_pattern(needle, regex, whole_word, match_case))
    out = df.select(key, F.regexp_count(text, p).cast("long").alias("hits"), (F.regexp_instr(text, p) - 1).cast("long").alias("first_at"))
    return out.where("hits > 0")


def find_offsets(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, nth, at, hit): every match of a pattern with its place in code points."""
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    between = F.split(text, pattern, -1)
    # the k-th hit starts after k pieces between hits and k - 1 hits
    rows = df.select(key, hits.alias("h"), F.transform(between, F.char_length).alias("g")).where(F.size("h") > 0)
    rows = rows.select(key, "h", "g", F.posexplode("h").alias("nth", "hit"))
    before_g = F.aggregate(F.slice("g", 1, F.col("nth") + 1), F.lit(0), lambda a, x: a + x)
    before_h = F.aggregate(F.slice("h", 1, F.col("nth")), F.lit(0), lambda a, x: a + F.char_length(x))
    return rows.select(key, "nth", (before_g + before_h).cast("long").alias("at"), "hit")


def replace_all(text: Column, needle: str, new: str, regex: bool = False, whole_word: bool = False, match_case: bool = False) -> Column:
    replacement = new if regex else re.sub(r"([\\$])", r"\\\1", new)
    return F.regexp_replace(text, _pattern(needle, regex, whole_word, match_case), replacement)


def autocorrect(text: Column, table: dict[str, str] | None = None) -> Column:
    """Replaces tokens that stand between white space."""
    mapping = F.create_map(*[F.lit(x) for pair in (table or AUTOCORRECT).items() for x in pair])
    return F.array_join(F.transform(F.split(text, " ", -1), lambda w: F.coalesce(F.try_element_at(mapping, w), w)), " ")


def text_to_columns(df: DataFrame, name: str, delimiter: str, width: int, prefix: str) -> DataFrame:
    """df with prefix1 ... prefix<width>: the trimmed parts of a column; missing ones are null."""
    parts = F.split(F.col(name), re.sub(r"([\\.^$|?*+()\[\]{}-])", r"\\\1", delimiter), -1)
    return df.withColumns({f"{prefix}{i + 1}": F.trim(F.get(parts, F.lit(i))) for i in range(width)})


def line_diff(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """(key, same, added, removed): line i against line i; a changed line is one of each."""
    a, b = (paragraphs(df, key, text) for df in (old, new))
    both = a.withColumnRenamed("text", "a").join(b.withColumnRenamed("text", "b"), [key, "ord"], "full")
    same = F.col("a").eqNullSafe(F.col("b"))
    return both.groupBy(key).agg(
        F.count_if(same).alias("same"), F.count_if(~same & F.col("b").isNotNull()).alias("added"), F.count_if(~same & F.col("a").isNotNull()).alias("removed")
    )


def version_deltas(df: DataFrame, key: str, version: str, text: str) -> DataFrame:
    """(key, version, words, delta): words of each version less those of the newest."""
    w = df.select(key, version, word_count(F.col(text)).alias("words"))
    last = Window.partitionBy(key).orderBy(F.col(version).desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return w.withColumn("delta", F.col("words") - F.first("words").over(last))


#: White space as the editor's patterns know it.
_BLANK = r"[\s\u000b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def heading_level(line: Column) -> Column:
    """1 to 3 for lines that look like headings, 0 for others; the first rule that fits counts.

    Under 80 characters in capitals and at most 15 words: 1.  Under 80 in title case, 2 to 15 words without a sentence sign
    before the last character: 2.  Under 120 after a number with . or ), at most 12 words without such a sign: 2.  Under 80
    with a colon at the end and at most 10 words: 3.
    """
    t = F.regexp_replace(line, f"^{_BLANK}+|{_BLANK}+$", "")
    n = F.char_length(t)
    words = F.size(F.split(t, f"{_BLANK}+", -1))
    caps = (F.upper(t) == t) & (n > 3) & t.rlike("[A-Z]")
    title = ~t.rlike(f"(^|{_BLANK})[^A-Za-z0-9_{_BLANK[1:]}*[a-z]")
    plain = ~F.substring(t, F.lit(1), n - 1).rlike("[.!?;]")
    numbered = t.rlike(rf"^\d+[.)]{_BLANK}")
    short = n < 80
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, 0).when(short & caps & (words <= 15), 1).when(short & title & plain & words.between(2, 15), 2)
        .when((n < 120) & numbered & plain & (words <= 12), 2).when(short & t.endswith(":") & (words <= 10), 3).otherwise(0)
    )


SCRIPTS = {"latin": r"\p{IsLatin}", "greek": r"\p{IsGreek}", "cyrillic": r"\p{IsCyrillic}", "han": r"\p{IsHan}", "arabic": r"\p{IsArabic}", "hebrew": r"\p{IsHebrew}"}


def script_counts(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """Letters of each script in a text."""
    return df.select(*key, *[F.regexp_count(text, F.lit(p)).cast("long").alias(name) for name, p in SCRIPTS.items()])


def _fixed(value: Column) -> Column:
    """Two decimals of the binary value, exact halves to even; format_string() takes halves of the decimal digits up.  Digits behind the seventeenth are zeros."""
    v = value.cast("double")
    return F.when(F.abs(v) < float("inf"), F.call_function("format_number", v, F.lit("0.00"))).when(v.isNotNull(), F.format_string("%.2f", v))


def _scientific(value: Column) -> Column:
    """As _fixed(), three digits and an exponent; format_number() takes some exact halves up, so those before an even digit are cut."""
    v = value.cast("double")
    half = r"^(-?\d\.\d[02468])5(e[+-]\d+)$"
    four = F.format_string("%.3e", v)
    power = F.regexp_extract(four, r"e([+-]\d+)$", 1).cast("int") - 3
    whole = (F.abs(v) < 2.0**53) | ((power <= 22) & (v % F.concat(F.lit("1e"), power).cast("double") == 0))
    exact = F.when(four.rlike(half), (four.cast("double") == v) & (v * 32 % 1 == 0) & whole).otherwise(False)
    shown = F.regexp_replace(F.regexp_replace(F.call_function("format_number", v, F.lit("0.00E00")), "E-", "e-"), "E", "e+")
    return F.when(F.abs(v) < float("inf"), F.when(exact, F.regexp_replace(four, half, "$1$2")).otherwise(shown)).when(v.isNotNull(), F.format_string("%.2e", v))


def display(value: Column, kind: str) -> Column:
    """number, currency, percentage, scientific, date or time as a cell shows them; anything else as general."""
    from ..functions import cells

    shown = {
        "number": lambda: F.format_number(value, 2),
        "currency": lambda: F.concat(F.when(value < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(value), 2)),
        "percentage": lambda: F.concat(_fixed(value * 100), F.lit("%")),
        "scientific": lambda: _scientific(value),
        "date": lambda: F.date_format(cells.serial_date(value), "yyyy-MM-dd"),
        "time": lambda: cells.serial_time(value),
    }
    return shown.get(kind, lambda: cells.number_text(value))()


def roman(n: Column) -> Column:
    """Lower-case Roman numerals of 1 to 3999."""
    steps = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]
    out, rest = F.lit(""), n
    for value, sign in steps:
        out = F.concat(out, F.repeat(F.lit(sign), (rest / value).cast("int")))
        rest = rest % value
    return out


def alpha(n: Column) -> Column:
    """a to z, and from the start again."""
    return F.char((n - 1) % 26 + 97)
