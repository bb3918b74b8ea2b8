"""HTML to text by regular expressions, linear in the input (no nested repetition)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import base_name, trim_all

#: Blocks removed, in order, each for a space.
BLOCKS = ["(?is)<script\\b.*?</script>", "(?is)<style\\b.*?</style>", "(?s)<!--.*?-->", "<[^>]+>"]
#: Entities decoded, in order (so &amp;lt; ends as <).
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")]
TITLE = "(?is)<title[^>]*>([^<]+)</title>"


def html_to_text(html: Column) -> Column:
    out = html
    for pattern in BLOCKS:
        out = F.regexp_replace(out, pattern, " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return trim_all(F.regexp_replace(out, "\\s+", " "))


def html_title(html: Column, path: Column) -> Column:
    """The page's title, else the file's name. Entities stay as they are."""
    return F.coalesce(F.nullif(trim_all(F.regexp_extract(html, TITLE, 1)), F.lit("")), base_name(path))
