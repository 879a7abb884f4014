"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token: a run of ASCII letters, digits, underscores, or one ideograph.
TOKEN = "[a-z0-9_]+|[一-鿿]"


def tokens(text: Column) -> Column:
    """Search tokens of a text, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def normalize_tag(tag: Column) -> Column:
    """Lower kebab case without outer hashes and dashes."""
    t = F.regexp_replace(F.trim(F.lower(tag)), "^#+", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[\\s_]+", "-"), "-{2,}", "-"), "^-+|-+$", "")


def normalize_tags(tags: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(tags, normalize_tag), lambda t: t != "")))


def cjk_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[一-鿿]"))


def route_language(text: Column) -> Column:
    """'zh' if two ideographs or a fifth of the letters are ideographs, else 'en'."""
    n, letters = cjk_count(text), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when(text.isNull() | (n == 0), "en").when((n >= 2) | ((letters > 0) & (n / letters >= 0.2)), "zh").otherwise("en")


def document_key(title: Column) -> Column:
    """A title without one trailing ' (...)'."""
    return F.regexp_replace(F.trim(F.coalesce(title, F.lit(""))), " \\([^()]*\\)$", "")


def strip_part_suffix(title: Column) -> Column:
    return F.regexp_replace(title, "(?i)\\s*\\((part \\d+|synthesis|stitched)\\)\\s*$", "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def file_stem(title: Column, longest: int = 120) -> Column:
    """A title as a file name: hostile characters away, blanks collapsed."""
    s = F.regexp_replace(title, '[\\\\/*?:"<>|$\\x00-\\x1f]', "")
    s = F.regexp_replace(F.regexp_replace(s, "\\s+", " "), "^[ .-]+|[ .-]+$", "")
    return F.regexp_replace(F.substring(s, 1, longest), "^[ .-]+|[ .-]+$", "")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, path '/' if none, no fragment; '' unless http(s) without user info."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rest = F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    good = scheme.isin("http", "https") & (host != "") & ~host.contains("@")
    return F.when(good, F.concat(scheme, F.lit("://"), host, rest)).otherwise("")


def route_source(url: Column) -> Column:
    """The parser a listing address goes to."""
    host = F.lower(F.regexp_extract(url, "^[A-Za-z]+://([^/:?#]*)", 1))
    path = F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    return (
        F.when(host.isin("github.com", "www.github.com") & path.startswith("/trending"), "github_trending")
        .when(host == "news.ycombinator.com", "hackernews")
        .when(host.isin("arxiv.org", "www.arxiv.org", "export.arxiv.org") & path.startswith("/list/"), "arxiv")
        .otherwise("feed")
    )


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def wikilinks(text: Column) -> Column:
    """Targets of [[target]] and [[target|alias]], trimmed."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("\\[\\[([^\\[\\]|#\\n]+)"), F.lit(1)), F.trim)


def section_refs(text: Column) -> Column:
    """Section labels a text names: sec. 4.7, section 2, a section sign or the ideograph forms; without doubles."""
    marked = F.regexp_extract_all(text, F.lit("(?i)(?:§\\s*|\\bsection\\s+|\\bsec\\.\\s*|第\\s*)(\\d+(?:\\.\\d+)*)"), F.lit(1))
    return F.array_distinct(marked)


def has_repeat_of_40(text: Column) -> Column:
    return text.rlike("([^\\s])\\1{39,}")


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("\\d+"), F.lit(0)))


FOREIGN = "[฀-๿Ѐ-ӿ؀-ۿऀ-ॿ가-힯]"
