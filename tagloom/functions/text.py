"""Row-local text functions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from tagloom.schema import FIELDS, JOIN

JAPANESE = r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"
JAPANESE_OR_HALFWIDTH = r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{FF66}-\x{FF9F}]"
YEAR = r"(1[0-9]{3}|20[0-9]{2})"

# Separator characters of names, without and with the underscore,
# of words, and of title words (all written as the inside of a regex class).
DICTIONARY_SEPARATORS = r" \t,;:/\-()\[\]&.\x{3000}、・"
FINDER_SEPARATORS = r" \t,;:/\-_()\[\]&.\x{3000}、・"
WORD_SEPARATORS = r" \t\x{3000}"
TITLE_SEPARATORS = r""" \t,;:/()\[\]&."'?!"""

# ASCII spellings and the words they may stand for.
DIACRITIC_WORDS = [
    ("Walkure", "Walküre"),
    ("Gotterdammerung", "Götterdämmerung"),
    ("Tannhauser", "Tannhäuser"),
    ("Freischutz", "Freischütz"),
    ("Sangerkrieg", "Sängerkrieg"),
    ("Jagervergnugen", "Jägervergnügen"),
    ("Konig", "König"),
    ("Nurnberg", "Nürnberg"),
]

# Movement-number styles, first match wins.
MOVEMENT_STYLES = [
    (r"^\d+-\d+\.", "5-1."),
    (r"^\d+\.", "1."),
    (r"^\d+\s+\S", "1 Allegro"),
    (r"^\(\s*[IVXLC]+[.\s]", "(I."),
    (r"^[IVXLC]+[.\s]", "I."),
    (r"^第[０-９0-9一二三四五六七八九十]+楽章", "第N楽章"),
]
NO_STYLE = "none"

# (?U): white space and digits of all scripts, not only of ASCII.


def strip(text: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def has_wide(text: Column) -> Column:
    """Is any character beyond ASCII? A cheap test before a pattern of such characters."""
    return F.octet_length(text) > F.length(text)


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def no_texts() -> Column:
    return F.array().cast("array<string>")


def single(values: Column) -> Column:
    """Joined text, null when there is no value."""
    return F.when(F.size(values) > 0, F.array_join(values, JOIN))


def only(values: Column) -> Column:
    """The value of a field with exactly one value, else null."""
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def has_multiple(values: Column) -> Column:
    """P2."""
    return F.size(values) > 1


def unified_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def folder_of(path: Column) -> Column:
    """Folder part, '' at the root."""
    return F.regexp_extract(unified_path(path), r"^(.*)/[^/]*$", 1)


def file_name_of(path: Column) -> Column:
    return F.substring_index(unified_path(path), "/", -1)


def stem_of(path: Column) -> Column:
    return F.regexp_replace(file_name_of(path), r"\.[^.]*$", "")


def recording_year(date: Column) -> Column:
    """P5 on the joined date text."""
    return F.nullif(F.regexp_extract(date, YEAR, 1), F.lit("")).cast("int")


def disc_number(disc: Column) -> Column:
    """P6 on the joined disc text."""
    number = F.trim(F.split_part(disc, F.lit("/"), F.lit(1))).try_cast("int")
    return F.when(number > 0, number).otherwise(1)


def is_japanese(text: Column) -> Column:
    """includes half-width kana."""
    return has_wide(text) & text.rlike(JAPANESE_OR_HALFWIDTH)


def has_japanese(text: Column) -> Column:
    """the form the rules use."""
    return has_wide(text) & text.rlike(JAPANESE)


def tokens(text: Column, separators: str) -> Column:
    """non-empty tokens in order."""
    return F.filter(F.split(text, f"[{separators}]+"), lambda t: t != "")


def segments(folder: Column) -> Column:
    return F.filter(F.transform(F.split(folder, "/"), strip), lambda s: s != "")


def is_placeholder(title: Column) -> Column:
    """white space around the title does not count."""
    return title.rlike(r"(?iU)^\s*(?:track\s*\d+|\d+(?:[-_]\d+)?|\S+\s*-\s*\d+)\s*$")


def title_from_stem(stem: Column) -> Column:
    """null when nothing usable is left."""
    candidate = strip(F.regexp_replace(stem, r"^\d+(-\d+)?[\s._-]+", ""))
    return F.when((candidate != "") & ~is_placeholder(candidate), candidate)


def movement_style(title: Column) -> Column:
    """F8. Every style begins with one of a few characters, so most titles need one test."""
    chain = F.when(~title.rlike(r"(?U)^[\d(IVXLC第]"), NO_STYLE)
    for pattern, label in MOVEMENT_STYLES:
        chain = chain.when(title.rlike("(?U)" + pattern), label)
    return chain.otherwise(NO_STYLE)


def has_life_span(name: Column) -> Column:
    """Brackets and blanks around the years do not change whether there are any."""
    return name.rlike(r"1[0-9]{3}\s*[-–]\s*[12][0-9]{3}")


def is_surname_first(name: Column) -> Column:
    return name.rlike(r"^[^,]+,\s*[^,]+$")


def has_caps_word(name: Column) -> Column:
    """A run of capitals first: the test of word boundaries is dear."""
    return name.rlike(r"\p{Lu}{5}") & name.rlike(r"(?U)\b\p{Lu}{5,}\b")


def name_problems(name: Column, judge_order: Column) -> Column:
    """codes of what is odd about a personal name."""
    return F.array_compact(
        F.array(
            F.when(has_life_span(name), "life_span"),
            F.when(judge_order & is_surname_first(name), "surname_first"),
            F.when(has_caps_word(name), "all_caps"),
        )
    )


def diacritic_words(title: Column) -> Column:
    """the ASCII spellings that occur, in order, each once."""
    known = F.create_map(*[F.lit(x) for a, _ in DIACRITIC_WORDS for x in (a.lower(), a)])
    found = F.transform(tokens(title, TITLE_SEPARATORS), lambda t: F.try_element_at(known, F.lower(t)))
    return F.array_distinct(F.array_compact(found))


def diacritic_suggestion(title: Column) -> Column:
    """The title with the found spellings replaced, case-sensitively."""

    def replaced(words: Column) -> Column:
        text = title
        for plain, correct in DIACRITIC_WORDS:
            wanted = F.when(F.array_contains(words, plain), correct).otherwise(plain)
            text = F.replace(text, F.lit(plain), wanted)
        return text

    return F.get(F.transform(F.array(diacritic_words(title)), replaced), F.lit(0))


def java_replacement(replacement: str) -> str:
    """A replacement in which ``$1``, ``${1}``, ``${name}``, ``$&`` and ``$$`` stand for
    something and any other ``$`` or ``\\`` for itself, as Java writes it."""

    def written(found: re.Match) -> str:
        group = found["group"] or found["braced"]
        if group:
            return f"${group}" if group.isdigit() else f"${{{group}}}"
        return "$0" if found[0] == "$&" else "\\$" if found[0][0] == "$" else "\\\\"

    return re.sub(r"\$(?:(?P<group>\d+)|\{(?P<braced>\d+|[A-Za-z][A-Za-z0-9]*)\}|[$&])?|\\", written, replacement)


def typo_hits(text: Column, typos: list[tuple[str, str]]) -> Column:
    """the patterns that match, in list order."""
    if not typos:
        return no_texts()
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(p)) for p, _ in typos]))


def typo_match(text: Column, typos: list[tuple[str, str]]) -> Column:
    """Does any pattern match? Patterns without groups are one alternation; one with
    groups is a test of its own, as numbers and names of groups would mix."""
    if not typos:
        return F.lit(False)
    grouped = [p for p, _ in typos if "(" in p or "\\Q" in p]
    plain = "|".join(f"(?:{p})" for p, _ in typos if p not in grouped)
    return reduce(or_, [text.rlike(p) for p in [*([plain] if plain else []), *grouped]])


def fix_typos(text: Column, typos: list[tuple[str, str]]) -> Column:
    for pattern, replacement in typos:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(java_replacement(replacement)))
    return text


def natural_key(text: Column) -> Column:
    """sort key. Runs of ASCII digits compare as numbers, longer zero padding
    last; other runs compare by the Unicode collation, where case and accents only
    decide between otherwise equal texts. A text without more runs comes first."""

    def part(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+", "")
        number = F.struct(
            F.lit(0).alias("kind"), F.length(digits).alias("size"), digits.alias("digits"), F.length(run).alias("padded"),
            F.collate(F.lit(""), "UNICODE").alias("text"),
        )
        words = F.struct(
            F.lit(1).alias("kind"), F.lit(0).alias("size"), F.lit("").alias("digits"), F.lit(0).alias("padded"),
            F.collate(run, "UNICODE").alias("text"),
        )
        return F.when(run.rlike("^[0-9]"), number).otherwise(words)

    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), part)


def first_difference(left: Column, right: Column) -> Column:
    """1-based position of the first differing character."""
    longest = F.greatest(F.length(left), F.length(right), F.lit(1))
    differs = F.filter(
        F.sequence(F.lit(1), longest),
        lambda i: F.substr(left, i, F.lit(1)) != F.substr(right, i, F.lit(1)),
    )
    return F.get(differs, F.lit(0))


def slug(text: Column) -> Column:
    """entity id made from a name."""
    dashed = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+", "-")
    bare = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.when(bare == "", "ensemble").otherwise(bare)


def numbers_in(text: Column) -> Column:
    """F16: numbers of one to three digits, distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)(?<!\d)\d{1,3}(?!\d)"), F.lit(0)))


def work_template(name: Column) -> Column:
    """the first number replaced by a slot; null without a number."""
    first = r"(?sU)^(.*?)(?<!\d)\d{1,3}(?!\d)(.*)$"
    return F.when(name.rlike(r"(?U)(?<!\d)\d{1,3}(?!\d)"), F.regexp_replace(name, first, "$1{0}$2"))


def trim_name(text: Column) -> Column:
    edge = r"""[ \t:;,.\-_/"'()\[\]]"""
    return F.regexp_replace(text, f"^{edge}+|{edge}+$", "")


def loosen_number(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=\p{L})\.\s*(?=\d)", ". ")


def head_of(segment: Column) -> Column:
    """Text before the first dash, null when it is empty or the whole segment."""
    head = strip(F.split_part(segment, F.lit("-"), F.lit(1)))
    return F.when((head != "") & (head != segment), head)


def alias_lines(text: Column) -> Column:
    """one alias per line."""
    lines = F.transform(F.split(text, r"[\r\n]+"), strip)
    return F.array_distinct(F.filter(lines, lambda x: x != ""))


def multi_value_summary() -> Column:
    """F21 over the columns of a track row."""
    parts = [
        F.when(F.size(f) > 1, F.concat(F.lit(f"{f}: "), F.size(f).cast("string"), F.lit(" values")))
        for f in FIELDS
    ]
    return F.array_join(F.array_compact(F.array(*parts)), " / ")
