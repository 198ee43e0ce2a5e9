"""Text, identity and label expressions. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Titles that are headings whatever their numbering.
COMMON_TITLES = tuple("abstract|appendix|background|conclusion|conclusions|discussion|experimental setup|experiments|introduction|limitations|method|methodology|methods|references|related work|results".split("|"))
STUB_CHARS = 200
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def strip(c: Column) -> Column:
    """Without white space, of any kind, at both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+\z", "")


def normalized_phrase(c: Column) -> Column:
    """Lower case, ß as ss, runs of other than letters and digits as one space, none at the ends."""
    folded = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "ß", "ss")
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def title_key(c: Column) -> Column:
    """A heading as it is compared with the common titles."""
    return F.regexp_replace(F.lower(c), ":+$", "")


def is_numbered_heading(c: Column) -> Column:
    """A number or roman numeral and a capitalised title; not a year, a sentence, or letters with digits only."""
    number = r"(?:\d+(?:\.\d+)*|[IVXLC]+)[.)]?\s+"
    title = F.regexp_replace(F.regexp_replace(c, "^" + number, ""), ":+$", "")
    return c.rlike("^" + number + r"[A-Z][A-Za-z0-9 .,:;()/_\-]{1,100}\z") & ~c.rlike(r"^\d{4}\b") & ~c.rlike(r"[.?!]\z") & ~title.rlike(r"^[A-Z]+\d+\z")


def is_paper_heading(c: Column) -> Column:
    return title_key(c).isin(*COMMON_TITLES) | is_numbered_heading(c)


def starts_body(c: Column) -> Column:
    return (title_key(c) == "abstract") | is_numbered_heading(c)


def is_section_heading(c: Column) -> Column:
    """For converted papers: also appendix letters; never the references."""
    return (title_key(c) != "references") & (is_paper_heading(c) | c.rlike(r"^[A-Z](?:\.\d+)*[.)]?\s+[A-Z]"))


def is_references_heading(c: Column) -> Column:
    return title_key(F.regexp_replace(c, r"(?i)^(?:\d+(?:\.\d+)*|[ivxlc]+)[.)]?\s+", "")) == "references"


def parent_id(source: Column, section: Column) -> Column:
    return F.md5(F.concat(source, F.lit("__"), section))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def locator(source: Column, section: Column) -> Column:
    return F.concat(F.coalesce(F.nullif(source, F.lit("")), F.lit("Unknown source")), F.lit("::"), F.coalesce(F.nullif(section, F.lit("")), F.lit("Unknown section")))


def uuid5(name: Column) -> Column:
    """The name-based UUID of version 5 in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def source_label(source: Column, section: Column, page_start: Column, page_end: Column) -> Column:
    """[source — section, p.a–b]; no pages unless both are there and not 0."""
    known = (F.coalesce(page_start, F.lit(0)) != 0) & (F.coalesce(page_end, F.lit(0)) != 0)
    pages = F.when(~known, "").when(page_start == page_end, F.concat(F.lit(", p."), page_start.cast("string"))).otherwise(F.concat(F.lit(", p."), page_start.cast("string"), F.lit("–"), page_end.cast("string")))
    return F.concat(F.lit("["), source, F.lit(" — "), section, pages, F.lit("]"))


def redacted(message: Column, key: str = "") -> Column:
    """An error text without the key and addresses, at most 500 characters."""
    out = F.replace(message, F.lit(key), F.lit("[redacted]")) if key else message
    return F.left(F.regexp_replace(out, r"https?://\S+", "[url]"), F.lit(500))


def bounded_text(c: Column, most: int = 6000, marker: str = "\n[... the middle part is left out ... ]\n") -> Column:
    """A text of at most ``most`` characters: as it is, or its head and tail around a marker."""
    room = most - len(marker)
    head, tail = room // 2, room - room // 2
    cut = F.concat(F.regexp_replace(F.left(c, F.lit(head)), r"(?U)\s+\z", ""), F.lit(marker), F.regexp_replace(F.right(c, F.lit(tail)), r"(?U)^\s+", ""))
    return F.when(F.length(c) <= most, c).otherwise(cut)


def known_citations(answer: Column, labels: Column) -> Column:
    """The answer without [labels] that aren't among the known ones."""
    cited = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"(\[[^\[\]]+\])"), F.lit(1)))
    return F.aggregate(F.array_except(cited, labels), answer, lambda text, label: F.replace(text, label, F.lit("")))


def mermaid_escape(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for sign, code in (('"', "#quot;"), ("\n", " "), ("\r", " "), ("[", "#91;"), ("]", "#93;"), ("(", "#40;"), (")", "#41;"), ("{", "#123;"), ("}", "#125;"), ("|", "#124;"), (">", "#62;"), ("<", "#60;")):
        out = F.replace(out, F.lit(sign), F.lit(code))
    return out
