"""Canonical text, cleaning, paragraphs, sentences and words as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode, as opposed to the ASCII class that Java's \s means.
SPACE = r"\t-\r\x1c-\x20\x85\xa0  -     　"
WORD = r"[A-Za-z]+(?:['’-][A-Za-z]+)*"
ABBREVIATIONS = "approx apr aug ave ca ch co corp dec dr e.g eq etc feb fig fri i.e inc jan jr jul jun ltd mar max min mon mr mrs ms nov oct p pp prof sat sec sep sr st sun thu tue vol vs wed".split()
QUOTES = "\"'“”‘’«»"
#: Stands between sentences while they are told apart; a text that holds this noncharacter is split there.
_MARK = "\uffff"
_BLANKS = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_SENTENCE_END = r"([.!?])[" + SPACE + r"]+(?=[A-Z])"
#: Longer spellings first, so that one of them isn't cut short by its beginning.
_ABBREVIATED = r"(?<![^" + SPACE + _MARK + r"])((?i:" + "|".join(a.replace(".", r"\.") for a in sorted(ABBREVIATIONS, key=len, reverse=True)) + r")\.{1,9})" + _MARK
_FENCE = r"(?m)^[" + SPACE + r"]*(```|~~~)"


def canonicalise(text: Column) -> Column:
    """One leading BOM, the newline convention, blanks at line ends and long runs of blank lines don't count."""
    text = F.regexp_replace(text, r"\A﻿", "")
    text = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    text = F.regexp_replace(text, r"(?md)[ \t]+$", "")
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def _fence_step(state: Column, line: Column) -> Column:
    """state: open (marker or ''), at (lines before the opening), out (lines so far)."""
    start = F.regexp_extract(line, r"^[" + SPACE + r"]*(```|~~~)", 1)
    opens = (state["open"] == "") & (start != "")
    inside = state["open"] != ""
    closes = inside & (start == state["open"])
    mark = F.when(opens, start).when(closes, F.lit("")).otherwise(state["open"])
    at = F.when(opens, F.size(state["out"])).otherwise(state["at"])
    kept = F.when(opens | inside, F.lit("")).otherwise(line)
    return F.struct(mark.alias("open"), at.alias("at"), F.concat(state["out"], F.array(kept)).alias("out"))


def _fences(text: Column) -> Column:
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(F.split(text, "\n"), start, _fence_step)


def fence_state(text: Column) -> Column:
    """The fold over the lines of a text with a fence marker, else null."""
    return F.when(F.regexp_like(text, F.lit(_FENCE)), _fences(text))


def blank_fences(text: Column, state: Column) -> Column:
    """Blank the lines of closed fenced blocks; an unclosed one stays prose."""
    lines = F.split(text, "\n")
    restored = F.concat(F.slice(state["out"], 1, state["at"]), F.slice(lines, state["at"] + 1, F.size(lines)))
    return F.when(state.isNull(), text).when(state["open"] == "", F.array_join(state["out"], "\n")).otherwise(F.array_join(restored, "\n"))


def unclosed_fence(text: Column) -> Column:
    return F.coalesce(fence_state(text)["open"] != "", F.lit(False))


def unfenced(text: Column) -> Column:
    """Of canonical text: plain apostrophes and no front matter."""
    text = F.replace(text, F.lit("’"), F.lit("'"))
    return F.regexp_replace(text, r"(?s)\A---[" + SPACE + r"]*\n.*?\n---[" + SPACE + r"]*(?:\n|\z)", "")


def clean(text: Column) -> Column:
    """unfenced(), then without fenced code."""
    text = unfenced(text)
    return blank_fences(text, fence_state(text))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(_BLANKS))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n[" + SPACE + r"]*\n"), strip), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Split after . ! ? before a capital, unless an abbreviation ends there: then the gap becomes one blank.

    All places are marked first and those after an abbreviation unmarked, so
    no pattern looks back further than one character.
    """
    marked = F.regexp_replace(text, _SENTENCE_END, "$1" + _MARK)
    return F.filter(F.transform(F.split(F.regexp_replace(marked, _ABBREVIATED, "$1 "), _MARK), strip), lambda s: s != "")


def paragraph_sentences(text: Column) -> Column:
    return F.flatten(F.transform(paragraphs(text), sentences))


def words(text: Column) -> Column:
    """Lower-case words with plain apostrophes."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.replace(F.lower(w), F.lit("’"), F.lit("'")))


def blank_words(text: Column) -> Column:
    """How many words white space alone makes."""
    return F.regexp_count(text, F.lit(r"[^" + SPACE + r"]+"))


def count_of(text: Column, characters: str) -> Column:
    """Occurrences of any of the characters."""
    return F.length(text) - F.length(reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), characters, text))


SCRIPTS = {
    "latin": r"A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ",
    "other": r"Ͱ-ϿЀ-ԯ֐-׿؀-ۿݐ-ݿऀ-ॿ฀-๿ᄀ-ᇿ぀-ヿ㐀-䶿一-鿿가-힯",
}
