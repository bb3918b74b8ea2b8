"""Text functions as Column expressions, and their driver-side twins for single queries.

Patterns that the SQL side must write differently stand next to each other: Java's \\b follows
Unicode, so whole words use look-around over ASCII word characters.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no keywords.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from",
    "has", "he", "in", "is", "it", "its", "of", "on", "that", "the",
    "to", "was", "will", "with", "what", "when", "where", "who", "how",
    "this", "these", "those", "they", "their", "there", "which", "can",
    "could", "would", "should", "do", "does", "did", "have", "had", "been",
]

#: White space as the request's text model has it: Unicode spaces count.
SPACE = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
PUNCTUATION = "[^A-Za-z0-9_\\s]"
HEADING = "(?m)^(#{1,6})\\s+(.+)$"
#: What makes text look like code.
CODE_PATTERNS = [
    "(?m)^(function|class|def|import|const|let|var)\\s+",
    "(?m)^\\s*(public|private|protected)\\s+",
    "\\{[\\s\\S]*\\}",
]
#: Import statements of several languages; group 1 is the module.
IMPORT_PATTERNS = [
    "import\\s+.*?from\\s+['\"](.+?)['\"]",
    "import\\s+['\"](.+?)['\"]",
    "require\\(['\"](.+?)['\"]\\)",
    "from\\s+(\\S+)\\s+import",
    "using\\s+(\\S+);",
    "package\\s+(\\S+)",
]


def trim_all(c: Column) -> Column:
    """Trim every kind of white space, not only U+0020."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def tokens(c: Column) -> Column:
    """Parts between white space, empty ones at the edges included."""
    return F.split(c, f"{SPACE}+", -1)


def keywords(query: Column, custom_stop_words: tuple[str, ...] = ()) -> Column:
    """Distinct words of more than two characters that aren't stop words, in order."""
    stop = list(dict.fromkeys([*STOP_WORDS, *custom_stop_words]))
    words = tokens(F.regexp_replace(F.lower(query), PUNCTUATION, " "))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(stop)))


def keyword_list(query: str, custom_stop_words: tuple[str, ...] = ()) -> list[str]:
    """keywords() for one query in the driver."""
    stop = {*STOP_WORDS, *custom_stop_words}
    words = re.split(r"\s+", re.sub(r"[^\w\s]", " ", query.lower(), flags=re.ASCII))
    return list(dict.fromkeys(w for w in words if len(w) > 2 and w not in stop))


def whole_word(word: str | Column) -> str | Column:
    """Pattern of a whole word between ASCII word boundaries. Keywords hold no special characters."""
    ahead, behind = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
    if isinstance(word, str):
        return f"{ahead}{re.escape(word)}{behind}"
    return F.concat(F.lit(ahead), word, F.lit(behind))


def keyword_score(text: Column, words: Column | list[str], boosting: bool = True) -> Column:
    """Score of a text for keywords: damped term frequency, length normalisation, and a position boost.

    Words given as a list become one expression for each, whose patterns are compiled once and whose
    text is cut into words once a row; an array column is for words that differ from row to row.

    The boost compares an offset in characters with a length in words, so late hits count against
    a text; there is no lower limit, on purpose.
    """
    low = F.lower(text)
    n = F.size(tokens(low)).cast("double")
    norm = F.lit(1.0) / (F.lit(1.0) + F.log(F.lit(1.0) + n / 100.0))

    def one(w: Column | str) -> Column:
        literal = isinstance(w, str)
        tf = F.regexp_count(low, F.lit(whole_word(w)) if literal else whole_word(w)).cast("double")
        at = (F.instr(low, w) - 1).cast("double")
        boost = F.lit(1.0) + (F.lit(1.0) - at / n) if boosting else F.lit(1.0)
        return F.when(tf > 0, F.log(F.lit(1.0) + tf) * norm * boost).otherwise(0.0)

    if isinstance(words, list):
        total = F.lit(0.0)
        for w in words:
            total = total + one(w)
        return F.least(F.lit(1.0), total / len(words)) if words else F.lit(0.0)
    return F.when(F.size(words) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.aggregate(words, F.lit(0.0), lambda s, w: s + one(w)) / F.size(words)))


def truncate(text: Column, limit: int = 512) -> Column:
    """At most `limit` characters, the last three then dots."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))).otherwise(text)


def heading_level(content: Column) -> Column:
    mark = F.regexp_extract(content, HEADING, 1)
    return F.when(mark != "", F.length(mark))


def heading_title(content: Column) -> Column:
    return F.when(F.regexp_extract(content, HEADING, 1) != "", trim_all(F.regexp_extract(content, HEADING, 2)))


def looks_like_code(content: Column) -> Column:
    out = F.lit(False)
    for p in CODE_PATTERNS:
        out = out | content.rlike(p)
    return out


def imports(content: Column, limit: int = 10) -> Column:
    """Distinct imported modules that aren't relative, in order of pattern and place."""
    found = F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in IMPORT_PATTERNS])
    return F.slice(F.array_distinct(F.filter(found, lambda x: (x != "") & ~x.startswith("."))), 1, limit)


def percent(x: Column) -> Column:
    """x as a percentage with one place, halves up."""
    return F.concat(F.format_string("%.1f", F.floor(x * 1000.0 + 0.5) / 10.0), F.lit("%"))


def round2(x: Column) -> Column:
    """Two places, halves toward plus infinity."""
    return F.floor(x * 100.0 + 0.5) / 100.0


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), "[^.](\\.[^.]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/\\\\]*)[/\\\\]*$", 1)


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9]", "_")


def strip_leading_dots(path: Column) -> Column:
    return F.regexp_replace(path, "^[./\\\\]+", "")


def select_excerpt(text: Column, limit: int = 1000) -> Column:
    """A long selection is cut and says so."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("\n... (truncated)"))).otherwise(text)


def glob_pattern(glob: str) -> str:
    """A gitignore-like glob as an anchored regular expression over a relative path."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$" if "/" in glob.rstrip("/") else f"(^|/){out}(/|$)"


#: Fixed value: what a repository load leaves out unless told otherwise.
DEFAULT_IGNORE = "*.github*, *makefile*, **/TEST/**, **/tst/**, *.test.*, node_modules/**"


def ignore_patterns(text: str = DEFAULT_IGNORE) -> list[str]:
    """Globs of a comma-separated list."""
    return [p for p in (x.strip() for x in text.split(",")) if p]


def ignored(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_pattern(g))
    return out
