"""Text rules of the tool-call grammar and of prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The markup of transcripts.
THINKING_END = "</thinking>"
FONT_TAG = r'(?s)<font color="white" size=".72c">(.*?)</font>'


def after_thinking(text: Column) -> Column:
    """What follows the first end of thinking, up to a second one; the whole text without any."""
    return F.when(F.contains(text, F.lit(THINKING_END)), F.split_part(text, F.lit(THINKING_END), F.lit(2))).otherwise(text)


def tag_bodies(text: Column, tag: str, across_markup: bool = True) -> Column:
    """Bodies of every <tag>...</tag>; those of [^<]+ only, if markup may not be crossed."""
    body = "(.*?)" if across_markup else "([^<]+)"
    return F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>{body}</{tag}>"), F.lit(1))


def sub_queries(body: Column) -> Column:
    return F.split(body, ";")


def clip_numbers(body: Column) -> Column:
    """Sorted clip numbers of a list; anything but digits, blanks too, makes a part no number."""
    return F.array_sort(F.transform(F.filter(F.split(body, ";"), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("long")))


def whole_number(text: Column) -> Column:
    """A whole number with blanks around it, or NULL."""
    return F.trim(text).try_cast("int")


def answer_letter(text: Column, fallback: Column | None = None) -> Column:
    """First A-Z letter of the last <answer>; else the fallback ("-" as in evaluation, or a column as in the demo)."""
    bodies = tag_bodies(text, "answer")
    last = F.try_element_at(bodies, F.lit(-1))
    letter = F.regexp_extract(last, "[A-Z]", 0)
    return F.when(letter != "", letter).otherwise(F.lit("-") if fallback is None else fallback)


def without_font(text: Column) -> Column:
    """The body of the first white font tag, or the text itself."""
    return F.when(text.rlike(FONT_TAG), F.regexp_extract(text, FONT_TAG, 1)).otherwise(text)


def fill(template: str, **fields: Column) -> Column:
    """A template with {name} replaced by columns."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def data_url(content: Column, kind: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64(content), r"\r\n", ""))
