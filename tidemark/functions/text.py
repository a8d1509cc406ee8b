"""Column functions on text."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .. import constants as C


@F.pandas_udf(ArrayType(StringType()))
def _nfkc(pieces: pd.Series) -> pd.Series:
    return pieces.map(lambda own: [unicodedata.normalize("NFKC", p) for p in own], na_action="ignore")


#: Full-width forms of ASCII and the ideographic space, and what NFKC makes of them.
_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000", "".join(map(chr, range(0x21, 0x7F))) + " "
#: Where letters stand that are common in texts: Latin, Greek, Cyrillic, punctuation, arrows, boxes, kana, ideographs, Hangul.
_COMMON = ((0, 0x250), (0x370, 0x530), (0x2010, 0x2070), (0x2190, 0x2200), (0x2500, 0x2600), (0x3001, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4))


def _stable() -> str:
    """Character class of the common letters that NFKC leaves as they are and that join with nothing before them."""
    joins = {int(d[1], 16) for c in range(0x10000) if len(d := unicodedata.decomposition(chr(c)).split()) == 2 and d[0][0] != "<"}
    ranges = []
    for first, last in _COMMON:
        for c in range(first, last):
            if c not in joins and not unicodedata.combining(chr(c)) and unicodedata.normalize("NFKC", chr(c)) == chr(c):
                if ranges and ranges[-1][1] == c - 1:
                    ranges[-1][1] = c
                else:
                    ranges.append([c, c])
    return "".join(f"\\u{a:04X}-\\u{z:04X}" for a, z in ranges)


_STABLE = _stable()
#: Texts of these few ranges of them, which are quick to match: ASCII, letters of western Europe, curly quotes, ideographs.
_QUICK = r"^[\x00-\x9F\xC0-\u0131\u2018-\u201D\u4E00-\u9FFF]*\z"
#: What NFKC may change or join: other letters in a row, with the letter before them.
_PIECE = f"[{_STABLE}]?[^{_STABLE}]+"


def unstable(text: Column) -> Column:
    """The pieces of a text that NFKC may change; what lies between them stays, and no piece acts on another."""
    return F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))


def nfkc(text: Column) -> Column:
    """NFKC form. What it leaves as it is stays in the JVM, full-width forms too: Python gets the pieces that it may change."""
    narrow = F.translate(text, _WIDE, _NARROW)
    plain = narrow.rlike(_QUICK)
    formed = _nfkc(F.when(~plain, unstable(narrow)))
    joined = F.array_join(F.zip_with(F.split(narrow, _PIECE, -1), formed, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(plain, narrow).otherwise(joined)


def strip_markup(text: Column) -> Column:
    """URLs and tags become spaces, white space runs one space; null becomes empty."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)https?://\S+|www\.\S+", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    return F.regexp_replace(F.regexp_replace(out, r"(?U)\s+", " "), r"^ | $", "")


def clean_text(text: Column) -> Column:
    return strip_markup(nfkc(F.coalesce(text, F.lit(""))))


def target_text(target: Column, text: Column) -> Column:
    """``target ||| text`` of cleaned parts; a blank target leaves the text."""
    a, b = clean_text(target), clean_text(text)
    return F.when(a == "", b).otherwise(F.concat(a, F.lit(C.TARGET_DELIMITER), b))


def split_target(combined: Column) -> tuple[Column, Column]:
    at = F.instr(combined, C.TARGET_DELIMITER)
    target = F.when(at > 0, F.substr(combined, F.lit(1), at - 1))
    return target, F.when(at > 0, F.substr(combined, at + len(C.TARGET_DELIMITER))).otherwise(combined)


def without_source(title: Column, source: Column) -> Column:
    """Title without a trailing `` - source``."""
    end = F.concat(F.lit(" - "), source)
    return F.when(F.endswith(title, end), F.rtrim(F.substr(title, F.lit(1), F.length(title) - F.length(end)))).otherwise(title)


def hostname(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", ""), F.lit(""))


def word_count(text: Column) -> Column:
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+"))).cast("long")


def _compatible_letters() -> tuple[str, str]:
    """Letters that NFKC turns into what the price patterns look for, and one letter that the patterns take alike.

    A form of several digits (a ten in a circle) may stand as one digit, as patterns ask for
    runs of them; with a full stop or comma in it, as a full stop.
    """
    wanted = set("".join(C.PRICE_REPORT_PATTERNS)) - set(r"\d+|()[]?,.")
    found = {}
    for c in range(0x80, 0x30000):
        form = unicodedata.normalize("NFKC", chr(c)) if not 0xD800 <= c < 0xE000 else chr(c)
        if form == chr(c):
            continue
        if form in wanted:
            found[chr(c)] = form
        elif re.fullmatch(r"\d+", form):
            found[chr(c)] = "0"
        elif re.fullmatch(r"[\d,.]+", form):
            found[chr(c)] = "."
    return "".join(found), "".join(found.values())


_FORMS, _PLAIN = _compatible_letters()


def is_price_report(title: Column, normalize: bool = True) -> Column:
    """Whether a title in NFKC form is a price report; all in the JVM, by a table of the forms that matter."""
    text = F.coalesce(title, F.lit(""))
    return (F.translate(text, _FORMS, _PLAIN) if normalize else text).rlike("(?U)" + "|".join(C.PRICE_REPORT_PATTERNS))


def is_forum_post(title: Column) -> Column:
    return F.contains(title, F.lit(C.FORUM_MARKER))


def valid_ticker(ticker: Column) -> Column:
    return F.coalesce(F.upper(ticker).rlike(C.TICKER_PATTERN), F.lit(False))


def checked_ticker(ticker: Column) -> Column:
    return F.when(valid_ticker(ticker), F.upper(ticker)).otherwise(F.raise_error(F.concat(F.lit("invalid ticker: "), F.coalesce(ticker, F.lit("null")))))


#: Stands after a text to show where it ends.
_END = "end of the text"


def whole_json(text: Column) -> Column:
    """The variant of a text that is one JSON value as a whole; null for others, for text after a value, and for objects that repeat a key."""
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    alone = (F.try_variant_get(pair, "$[1]", "string") == _END) & F.try_variant_get(pair, "$[2]", "variant").isNull()
    return F.when(alone, F.try_variant_get(pair, "$[0]", "variant"))


def answer_label(raw: Column) -> Column:
    """Label of a judge's answer: of a JSON object its ``label``, and of text that is none the only label that it mentions; else null.

    JSON counts if the whole text is one value; one with text after it is no JSON.
    """
    text = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"^```(?:json)?\s*|\s*```$", "")
    own = F.lower(F.trim(F.try_variant_get(whole_json(text), "$.label", "string")))
    hits = F.filter(F.array(*map(F.lit, C.LABELS)), lambda name: F.contains(F.lower(text), name))
    return F.when(own.isin(*C.LABELS), own).when(F.size(hits) == 1, F.get(hits, F.lit(0)))


def stock_id(ticker: Column) -> Column:
    return F.substring_index(ticker, ".", 1)


def scorer_target(name: Column, ticker: Column) -> Column:
    return F.concat(name, F.lit("（"), stock_id(ticker), F.lit("）"))


def batch_name(path: Column, default: str = "2026-08-05") -> Column:
    found = F.regexp_extract(path, r"spot_check_sample_?([^/]*?)(?:_reviewed|_blank)?\.csv", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(default))


def model_version(name: Column, trained_at: Column) -> Column:
    return F.concat(name, F.lit("-"), F.left(trained_at, F.lit(10)))


def scorer_version(model: Column, tag: Column | None = None) -> Column:
    """Version of a scorer that asks a language model: its tag, or else its name, after ``llm-``."""
    return F.concat(F.lit("llm-"), model if tag is None else F.coalesce(tag, model))


def signed(x: Column, digits: int = 2) -> Column:
    """A number with its sign and so many digits; null stays."""
    return F.when(x.isNotNull(), F.format_string(f"%+.{digits}f", x.cast("double")))


def percent(x: Column, digits: int = 0) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f%%", x.cast("double") * 100))


def relative_time(then: Column, now: Column) -> Column:
    """How long ago: just now, minutes, hours, days up to seven, else the date."""
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 60)
    text = F.when(minutes < 1, "just now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min")))
    text = text.when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h")))
    return text.when(minutes <= 7 * 1440, F.concat(F.floor(minutes / 1440).cast("string"), F.lit(" d"))).otherwise(F.date_format(then, "yyyy-MM-dd"))


def allowed_ticker(ticker: Column, allowed: list[str]) -> Column:
    """Well formed, and on the list unless that is empty."""
    return valid_ticker(ticker) & (F.upper(ticker).isin(*allowed) if allowed else F.lit(True))


def retry_seconds(delay: Column) -> Column:
    """``"12s"`` to 13.0: the stated delay and one second."""
    return F.nullif(F.regexp_extract(delay, r"^([0-9.]+)s$", 1), F.lit("")).cast("double") + 1


def answer_parts(parts: Column) -> Column:
    """Text of the parts that are no thoughts."""
    return F.array_join(F.transform(F.filter(parts, lambda p: ~F.coalesce(p["thought"], F.lit(False))), lambda p: p["text"]), "")
