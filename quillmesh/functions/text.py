"""Text expressions: lines, summaries, quoting, token estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import col

# The line boundaries and blanks of Python's str type.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
RARE_BREAK = r"[\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
BLANK = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


# A character that is no blank: finding the first one is cheaper than stripping.
INK = "[^" + BLANK[1:]


def has_ink(c) -> Column:
    """The text is more than blanks."""
    return col(c).rlike(INK)


def lines_of(c) -> Column:
    """Lines of a text without their ends; no empty piece after the last end.

    Most texts have no line end but ``\\n``, and a split at one character is no search by pattern. The pieces are
    bound to a lambda, so that a text is split once wherever the expression stands.
    """
    parts = F.when(col(c).rlike(RARE_BREAK), F.split(col(c), LINE_BREAK)).otherwise(F.split(col(c), "\n"))
    whole = lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p)
    return F.get(F.transform(F.array(parts), whole), F.lit(0))


# The same blanks as characters.
_BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c) -> Column:
    return F.btrim(col(c), F.lit(_BLANKS))


def rstrip(c) -> Column:
    return F.rtrim(col(c), F.lit(_BLANKS))


def lstrip(c) -> Column:
    return F.ltrim(col(c), F.lit(_BLANKS))


def first_line(c, n: int | None = None) -> Column:
    """The first line, whole unless ``n`` cuts it."""
    line = strip(F.element_at(F.split(strip(c), LINE_BREAK), 1))
    return line if n is None else F.substring(line, 1, n)


def oneliner(c, n: int | None = None) -> Column:
    """All text on one line, whole unless ``n`` cuts it."""
    clean = F.regexp_replace(strip(c), f"{BLANK}+", " ")
    if n is None:
        return clean
    return F.when(F.length(clean) > n, F.concat(F.substring(clean, 1, n), F.lit("…"))).otherwise(clean)


def truncate(c, n: int) -> Column:
    return F.when(F.length(col(c)) <= n, col(c)).otherwise(F.concat(F.substring(col(c), 1, n), F.lit("...")))


def approx_tokens(c) -> Column:
    """A quarter of the characters, rounded up; 0 for empty or null."""
    return F.coalesce(F.floor((F.length(col(c)) + 3) / 4), F.lit(0)).cast("bigint")


def normalize_newlines(c, policy: str = "lf") -> Column:
    if policy not in ("lf", "crlf"):
        return col(c)
    lf = F.regexp_replace(col(c), r"\r\n?", "\n")
    return lf if policy == "lf" else F.regexp_replace(lf, "\n", "\r\n")


def rstrip_lines(c) -> Column:
    """Blanks off every line end; one newline at the end of a non-empty text."""
    kept = F.array_join(F.transform(lines_of(c), lambda x: rstrip(x)), "\n")
    return F.when((kept == "") | kept.endswith("\n"), kept).otherwise(F.concat(kept, F.lit("\n")))


def collapse_blank_lines(c) -> Column:
    """At most two blank lines in a row, blanks off line ends, text stripped."""
    lf = normalize_newlines(c)
    trimmed = F.regexp_replace(lf, r"(?m)[\s&&[^\n]]+$", "")
    return strip(F.regexp_replace(trimmed, "\n{4,}", "\n\n\n"))


def split_summary_body(c) -> tuple[Column, Column]:
    """(summary, body): cut at the first blank line, else after a sentence end."""
    s = strip(c)
    para = F.split(s, r"\n\s*\n", 2)
    by_sentence = r"(?s)^(.*?[.!?])\s+(.+)$"
    has_para, has_sentence = F.size(para) == 2, s.rlike(by_sentence)
    summary = F.when(has_para, strip(F.get(para, 0))).when(has_sentence, F.regexp_extract(s, by_sentence, 1)).otherwise(s)
    body = (
        F.when(has_para, strip(F.get(para, 1)))
        .when(has_sentence, strip(F.regexp_extract(s, by_sentence, 2)))
        .otherwise(F.lit(""))
    )
    return summary, body


def strip_triple_quotes(c) -> Column:
    pat = "(?s)^\\s*(\"\"\"|''')(.*?)\\1\\s*$"
    return F.when(col(c).rlike(pat), F.regexp_extract(col(c), pat, 2)).otherwise(col(c))


def strip_fences(c) -> Column:
    """Code fences off a text, then strip."""
    return strip(F.regexp_replace(col(c), r"(?im)^```(?:json)?\s*|\s*```$", ""))


def normalize_status(c) -> Column:
    return F.lower(F.translate(col(c), "_-", ""))


def csv_tags(c) -> Column:
    """Trimmed, non-empty items of a comma list."""
    return F.filter(F.transform(F.split(col(c), ","), lambda x: F.trim(x)), lambda x: x != "")


def is_env_name(base) -> Column:
    b = col(base)
    return b.startswith(".env.") | b.endswith(".env")


def is_template_env(base) -> Column:
    return col(base).rlike(r"\.(example|sample|template)$")


def strip_inline_comment(c) -> Column:
    """A ``#`` comment off a config line; a ``#`` inside open quotes stays."""
    s = col(c)
    before = F.substring_index(s, "#", 1)

    def even(q: str) -> Column:
        return F.length(F.regexp_replace(before, f"[^{q}]", "")) % 2 == 0

    return (
        F.when(lstrip(s).startswith("#"), "")
        .when(F.contains(s, F.lit(" #")), rstrip(F.substring_index(s, " #", 1)))
        .when(F.contains(s, F.lit("#")) & even("'") & even('"'), rstrip(before))
        .otherwise(s)
    )


def is_package(spec) -> Column:
    """An import target that is neither relative nor absolute nor a file URL."""
    return ~F.trim(col(spec)).rlike(r"^(\./|\.\./|/|file:)")


def exported_name(part) -> Column:
    """``A as B`` exports B."""
    return F.trim(F.when(F.contains(col(part), F.lit(" as ")), F.regexp_extract(col(part), r"(?s)^.*? as (.*)$", 1)).otherwise(col(part)))
