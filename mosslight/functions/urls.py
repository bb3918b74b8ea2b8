"""What kind of source a path or URL is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import extension

#: Fixed values.
REPOSITORY_URL = "^https?://[a-zA-Z0-9.-]+/[A-Za-z0-9_-]+/[A-Za-z0-9_.-]+"
SUPPORTED = [".pdf", ".md", ".markdown", ".html", ".htm", ".txt"]
OWNER_REPO = "^[A-Za-z0-9_-]+/[A-Za-z0-9_.-]+$"
HOST = "^[a-zA-Z0-9.-]+$"


def is_repository_url(url: Column) -> Column:
    return url.rlike(REPOSITORY_URL)


def is_web_url(url: Column) -> Column:
    return url.rlike("^https?://") & F.try_parse_url(url, F.lit("HOST")).isNotNull()


def url_host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def file_type(path: Column) -> Column:
    """github, web, or by extension; text where nothing else fits."""
    ext = extension(path)
    return F.when(is_repository_url(path), "github").when(is_web_url(path), "web").when(ext == ".pdf", "pdf").when(ext.isin(".md", ".markdown"), "markdown").when(ext.isin(".html", ".htm"), "html").otherwise("text")


def document_type(ext: Column) -> Column:
    """Type kept with a topic's document; anything unknown counts as markdown."""
    low = F.lower(ext)
    return F.when(low == "pdf", "pdf").when(low.isin("html", "htm"), "html").otherwise("markdown")


def is_supported(path: Column) -> Column:
    return is_repository_url(path) | is_web_url(path) | extension(path).isin(SUPPORTED)


def repository_api(url: Column) -> Column:
    """Base of the repository host's API."""
    host = url_host(url)
    return F.when(host == "github.com", "https://api.github.com").otherwise(F.concat(F.lit("https://"), host, F.lit("/api/v3")))


def auth_gate(status: Column, url: Column, html: Column) -> Column:
    """Why a fetched page is refused; null for a usable page."""
    login = url.contains("login") | url.contains("signin") | url.contains("auth")
    password = html.contains('type="password"') | html.contains("type='password'")
    return F.when(status.isin(401, 403), "authentication required").when((status < 200) | (status > 299), F.concat(F.lit("status "), status.cast("string"))).when(login, "redirected to a login page").when(password, "page has a login form")
