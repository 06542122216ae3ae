"""Column expressions over web pages and their addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def meta(html: Column, name: str) -> Column:
    """Content of a meta element, or null."""
    found = F.regexp_extract(html, rf'(?is)<meta\s+name="{name}"\s+content="([^"]*)"', 1)
    return F.when(found != "", found)


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def body_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, white space folded."""
    bare = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def safe(url: Column) -> Column:
    """http or https, with a host, without credentials, blanks or control characters."""
    return F.coalesce(url.rlike(r"^(?i:https?)://[^/@?#\s]+(?:[/?#]|$)") & ~url.rlike(r"[\x00-\x20\x7f]"), F.lit(False))


def pdf_url(url: Column) -> Column:
    """Where the full text may lie: an abstract page's own file, or a link to a file."""
    linked = F.regexp_replace(url, r"^(https?://arxiv\.org)/abs/(.+)$", "$1/pdf/$2.pdf")
    return F.when(url.rlike(r"^https?://arxiv\.org/abs/"), linked).when(F.lower(url).rlike(r"\.pdf(?:[?#].*)?$"), url)


def quoted(text: Column, safe: str = "/") -> Column:
    """Percent-encoded UTF-8, but for letters, digits, _.-~ and the characters of safe."""
    out = F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    for c in safe:
        out = F.replace(out, F.lit("".join(f"%{b:02X}" for b in c.encode())), F.lit(c))
    return out
