"""Normalisation keys (F1), folder keys (F12) and mojibake decoding.

The key folds width, case, diacritics and hiragana, and keeps letters and
decimal digits. Every step but the last works character by character, so the
whole fold is one ``translate`` with a table made from the Unicode database,
plus a strip. It runs in the JVM: no Python worker, no join, no shuffle.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.pandas.functions import pandas_udf

# Written one by one, characters of one byte are a table in Java's patterns; ranges are a chain of tests.
_PLAIN = string.ascii_lowercase + string.digits


def key_of_text(text: str | None) -> str:
    """Definition of the key on one string; the reference for tests and the table."""
    if text is None or not text.strip():
        return ""
    lowered = "".join(
        c.lower() if len(c.lower()) == 1 else c for c in unicodedata.normalize("NFKC", text)
    )
    out = []
    for c in unicodedata.normalize("NFD", lowered):
        category = unicodedata.category(c)
        if category == "Mn" or ord(c) > 0xFFFF:
            continue
        if 0x3041 <= ord(c) <= 0x3096:
            c = chr(ord(c) + 0x60)
        if category[0] == "L" or category == "Nd":
            out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


@cache
def _fold_table() -> tuple[str, str, dict[str, str]]:
    """(from, to) for one-to-one folds and a map for the characters that expand."""
    ranges = [
        (0x41, 0x3400), (0xA000, 0xAC00), (0xF900, 0x10000), (0x1D400, 0x1D800),
        (0x1EE00, 0x1EF00), (0x1F100, 0x1F300), (0x2F800, 0x2FA20),
    ]
    source, target, dropped, many = [], [], [], {}
    for low, high in ranges:
        for code in range(low, high):
            c = chr(code)
            key = key_of_text(c)
            if len(key) == 1 and key != c:
                source.append(c)
                target.append(key)
            elif len(key) > 1:
                many[c] = key
            elif not key and unicodedata.category(c)[0] == "L":
                dropped.append(c)
    return "".join(source + dropped), "".join(target), many


@cache
def _char_class(chars: str) -> str:
    """Regex class of the characters, neighbours joined to ranges to keep tests few."""
    codes, ranges = sorted(map(ord, chars)), []
    for code in codes:
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _apply(sql_lambda: str, value: Column) -> Column:
    """Apply a lambda written in SQL: a long expression stays one call from Python."""
    return F.get(F.call_function("transform", F.array(value), F.expr(sql_lambda)), F.lit(0))


def _quoted(text: str) -> str:
    return "r'" + text + "'"


# Conjoining jamo become syllables, as canonical composition does: a leading
# consonant, a vowel and an optional tail, or an open syllable and a tail.
_JAMO_UNIT = (
    r"(?s)[\x{1100}-\x{1112}][\x{1161}-\x{1175}][\x{11A8}-\x{11C2}]?"
    r"|[\x{AC00}-\x{D7A3}][\x{11A8}-\x{11C2}]|."
)
_COMPOSE_JAMO = f"""
  w -> array_join(transform(regexp_extract_all(w, {_quoted(_JAMO_UNIT)}, 0), g ->
    coalesce(decode(unhex(lpad(hex(CASE
      WHEN length(g) > 1 AND ascii(g) < 4608 THEN
        (ascii(g) - 4352) * 588 + (ascii(substring(g, 2, 1)) - 4449) * 28 + 44032
        + CASE WHEN length(g) = 3 THEN ascii(substring(g, 3, 1)) - 4519 ELSE 0 END
      WHEN length(g) = 2 AND ascii(g) >= 44032 AND (ascii(g) - 44032) % 28 = 0 THEN
        ascii(g) + ascii(substring(g, 2, 1)) - 4519
    END), 4, '0')), 'UTF-16BE'), g)), '')
"""
_HAS_JAMO = r"[\x{1100}-\x{11FF}\x{3131}-\x{318E}\x{FFA1}-\x{FFDC}]"


def _plain(name: str) -> str:
    """SQL: is the text ``name`` of ASCII only?"""
    return f"octet_length({name}) = length({name})"


def _plain_class(inside: str) -> str:
    """The inside of a class without what no ASCII text has."""
    return re.sub(r"\\x\{[0-9A-Fa-f]+\}|[^\x00-\x7F]", "", inside)


def _plain_fold(name: str, keep: str = "", mark: str = "") -> str:
    return f"regexp_replace(lower({name}), {_quoted(f'[^{_PLAIN}{_plain_class(keep)}]')}, '{mark}')"


@cache
def _fold_sql(name: str, keep: str = "", mark: str = "") -> str:
    """SQL that folds the text ``name`` at once; characters of the class ``keep``
    stay, others that are no letter or digit become ``mark``."""
    source, target, many = _fold_table()
    pairs = ",".join(f"{c}:{key}" for c, key in many.items())
    expanded = f"""CASE WHEN {name} RLIKE {_quoted(_char_class("".join(many)))} THEN
      array_join(transform(regexp_extract_all({name}, r'(?s).', 0),
        c -> coalesce(try_element_at(str_to_map('{pairs}', ',', ':'), c), c)), '')
      ELSE {name} END"""
    other = rf"[^\p{{L}}\p{{Nd}}{keep}]|[\x{{10000}}-\x{{10FFFF}}]"
    wide = f"regexp_replace(translate({expanded}, '{source}', '{target}'), {_quoted(other)}, '{mark}')"
    return f"""CASE
      WHEN {_plain(name)} THEN {_plain_fold(name, keep, mark)}
      WHEN {name} RLIKE {_quoted(_HAS_JAMO)} THEN get(transform(array({wide}), {_COMPOSE_JAMO}), 0)
      ELSE {wide} END"""


def name_key(text: Column) -> Column:
    """normalisation key; '' for null or blank."""
    return F.coalesce(_apply(f"kt -> {_fold_sql('kt')}", text), F.lit(""))


def name_key_of(column: str) -> Column:
    """F1 of a column by its name, without a lambda."""
    return F.expr(f"coalesce({_fold_sql(column)}, '')")


def name_keys(values: Column) -> Column:
    """F1 over a list."""
    return F.call_function("transform", values, F.expr(f"kt -> coalesce({_fold_sql('kt')}, '')"))


@cache
def _tokens_sql(name: str, separators: str) -> str:
    parts = f"split({_fold_sql(name, separators)}, {_quoted(f'[{separators}]+')})"
    return f"coalesce(filter({parts}, t -> t <> ''), cast(array() AS array<string>))"


def token_keys(text: Column, separators: str) -> Column:
    """Keys of the tokens (F4 then F1), without empty ones. No separator folds to a
    letter and no letter to a separator, so folding first and splitting then
    gives the same keys with one pass over the text."""
    return _apply(f"kt -> {_tokens_sql('kt', separators)}", text)


def token_keys_of(column: str, separators: str) -> Column:
    """``token_keys`` of a column by its name, without a lambda."""
    plain = f"split({_plain_fold(column, separators)}, {_quoted(f'[{_plain_class(separators)}]+')})"
    parts = f"split({_fold_sql(column, separators)}, {_quoted(f'[{separators}]+')})"
    parts = f"CASE WHEN {_plain(column)} THEN {plain} ELSE {parts} END"
    return F.expr(f"coalesce(array_remove({parts}, ''), cast(array() AS array<string>))")


_SYMBOL = "\x01"


@cache
def _ngrams_sql(name: str, separators: str) -> str:
    parts = f"filter(split({_fold_sql(name, separators, _SYMBOL)}, {_quoted(f'[{separators}]+')}), t -> t <> '')"
    runs = ", ".join(
        f"transform(CASE WHEN size(ts) >= {n} THEN sequence(1, size(ts) - {n - 1}) ELSE cast(array() AS array<int>) END,"
        f" i -> translate(array_join(slice(ts, i, {n}), ''), '{_SYMBOL}', ''))"
        for n in (3, 2, 1)
    )
    return f"""coalesce(concat(array(coalesce({_fold_sql(name)}, '')),
      get(transform(array({parts}), ts -> concat({runs})), 0)), cast(array() AS array<string>))"""


def ngram_keys(text: Column, separators: str) -> Column:
    """Key of the whole text, then of runs of 3, 2, 1 tokens, left to right.
    A token of symbols only still counts as a token of a run."""
    return _apply(f"kt -> {_ngrams_sql('kt', separators)}", text)


@pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.str.normalize("NFC")


def folder_lookup_key(folder: Column) -> Column:
    """folder as used to find overrides. Needs composition, so one Arrow UDF;
    call it on unit-level or dictionary rows, not on tracks."""
    unified = F.regexp_replace(F.translate(F.trim(F.coalesce(folder, F.lit(""))), "\\", "/"), "/+$", "")
    return F.lower(_nfc(unified))


@pandas_udf(T.StringType())
def _decode_cp932(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for values in batches:
        yield values.map(
            lambda v: None if v is None else v.encode("latin-1").decode("cp932", "replace")
        )


def maybe_mojibake(text: Column) -> Column:
    """Cheap JVM guard: every character fits one byte and one is beyond ASCII."""
    return (F.octet_length(text) > F.length(text)) & text.rlike(r"^(?s)[\x00-\xFF]*$") & text.rlike(r"[\x80-\xFF]")


def decode_mojibake(text: Column) -> Column:
    """F7 on rows that passed ``maybe_mojibake``.

    Filter by the guard first: then only the few survivors reach Python. The
    text was misread only when ``has_japanese_run`` holds for the result."""
    return _decode_cp932(text)


# Two characters of two bytes each, one behind the other, as CP932 writes kana and kanji.
_PAIR = r"[\x81-\x9F\xE0-\xFC][\x40-\x7E\x80-\xFC]"


def maybe_japanese_run(text: Column) -> Column:
    """Guard before ``decode_mojibake``: kana and kanji come of two bytes only, so a text whose
    decoded form has a run of them holds two such pairs."""
    return (F.octet_length(text) > F.length(text)) & text.rlike(f"{_PAIR}{_PAIR}") & maybe_mojibake(text)


def has_japanese_run(text: Column) -> Column:
    return text.rlike(r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]{2,}")
