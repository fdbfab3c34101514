"""Text clean-up expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions import fixed_values as V

# Unicode white space, with the four separators U+001C..U+001F counted as white space too.
_SPACE = r"[\s\x1c-\x1f]"
_CASED_RUNS = r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"


def strip(text: Column) -> Column:
    """Removes Unicode white space at both ends (plain `trim` removes blanks only)."""
    return F.btrim(text, F.lit(V.WHITE_SPACE))


def title_case(text: Column) -> Column:
    """Capitalises every run of letters: ``o'neil 7eleven`` -> ``O'Neil 7Eleven``."""

    def capitalised(run: Column) -> Column:
        first = F.upper(F.substring(run, 1, 1))
        # Outside ASCII a first letter may become two, of which one stays upper case: ß -> Ss.
        # `initcap` knows these but is slow.
        first = F.when(F.octet_length(first) == 1, first).otherwise(F.initcap(first))
        return F.concat(first, F.lower(F.substring(run, 2, 2**31 - 1)))

    runs = F.regexp_extract_all(text, F.lit(_CASED_RUNS), F.lit(1))
    return F.array_join(F.transform(runs, capitalised), "")


def normalize_description(text: Column) -> Column:
    """Canonical merchant text: references, masks and trailing numbers out, then title case."""
    out = strip(text)
    for pattern, replacement in V.DESCRIPTION_RULES:
        out = F.regexp_replace(out, "(?U)" + pattern.replace(r"\s", _SPACE), replacement)
    return title_case(strip(out))


def normalize_date(text: Column) -> Column:
    """``M/D/Y`` -> ``Y-MM-DD``; anything that is not three slash-separated parts stays as it is."""
    parts = F.split(text, "/", -1)

    def pad(part: Column) -> Column:
        return F.when(F.length(part) < 2, F.lpad(part, 2, "0")).otherwise(part)

    return F.when(
        F.size(parts) == 3, F.concat_ws("-", parts[2], pad(parts[0]), pad(parts[1]))
    ).otherwise(text)


def field_name(form: Column, line: Column) -> Column:
    """``('1040', '1z')`` -> ``f_1040_1z``."""
    raw = F.lower(F.concat(F.lit("f_"), form, F.lit("_"), line))
    return F.regexp_replace(F.replace(raw, F.lit("-"), F.lit("_")), "[^a-z0-9_]", "")


def first_filled(*columns: Column, default: str = "") -> Column:
    """First of the columns that is neither NULL nor empty, else the default."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(default))


def repo_owner(url: Column) -> Column:
    """Owner part of a repository address, NULL for other hosts."""
    return F.nullif(F.regexp_extract(url, V.REPO_URL, 1), F.lit(""))


def repo_short_name(url: Column) -> Column:
    """Repository part of the address up to its first dot, NULL for other hosts."""
    return F.nullif(F.regexp_extract(url, V.REPO_URL, 2), F.lit(""))


def repo_name(url: Column) -> Column:
    """Last path part of any address, without trailing slashes and one ``.git``."""
    last = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/", -1), -1)
    return F.regexp_replace(last, r"\.git$", "")


def line_count(text: Column) -> Column:
    r"""Lines of a text: ``\n``, ``\r\n`` and ``\r`` end one, an unfinished last line counts."""

    def occurrences(mark: str) -> Column:
        removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))
        return (removed / len(mark)).cast("long")

    ends = occurrences("\n") + occurrences("\r") - occurrences("\r\n")
    unfinished = (F.octet_length(text) > 0) & ~F.right(text, F.lit(1)).isin("\n", "\r")
    return ends + unfinished.cast("long")


def is_text(content: Column) -> Column:
    """Whether the head of a file decodes as strict UTF-8.

    The head is read in blocks of 8,192 bytes until 4,096 characters are there; two blocks always
    suffice. A character cut by the end of a block is fine, one cut by the end of the file is not,
    unless the characters were already enough.
    """
    # What a cut character may still need to be complete, for every kind of first byte.
    endings = ["", "80", "8080", "A080", "808080", "908080"]
    whole = F.is_valid_utf8(content.cast("string"))

    def head(blocks: int) -> Column:
        return F.substring(content, 1, blocks * V.SNIFF_BYTES)

    def decodes(part: Column) -> Column:
        ok = F.is_valid_utf8(part.cast("string"))
        for ending in endings[1:]:
            ok = ok | F.is_valid_utf8(F.concat(part, F.unhex(F.lit(ending))).cast("string"))
        return ok

    def enough(part: Column) -> Column:
        # A cut last character is counted as one by `length`, so it must not be needed.
        cut = ~F.is_valid_utf8(part.cast("string"))
        return F.length(part.cast("string")) - cut.cast("int") >= V.SNIFF_CHARS

    def longer_than(blocks: int) -> Column:
        return F.octet_length(content) > blocks * V.SNIFF_BYTES

    after_two = F.when(decodes(head(2)) & enough(head(2)), True).otherwise(whole)
    after_one = F.when(longer_than(1), after_two).otherwise(whole)
    return F.when(whole, True).when(~decodes(head(1)), False).when(enough(head(1)), True).otherwise(after_one)


def has_shortstat(line: Column) -> Column:
    """Whether the line states inserted or deleted lines."""
    return line.rlike(V.ANY_CHANGE)


def shortstat_lines(line: Column) -> Column:
    """Inserted plus deleted lines of a shortstat line, 0 for what it does not state."""

    def figure(pattern: str) -> Column:
        return F.coalesce(F.regexp_extract(line, pattern, 1).try_cast("bigint"), F.lit(0).cast("bigint"))

    return figure(V.INSERTIONS) + figure(V.DELETIONS)
