"""What kind of input a source is, and whether it may be read: predicates over tables of sources, without access to the network."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUFFIXES = {".txt": "text", ".md": "markdown", ".dclg": "tagged", ".dclg.xml": "tagged", ".dclx": "tagged_archive", ".json": "json", ".xml": "xml"}
MIME = {"text/html": ".html", "application/pdf": ".pdf", "text/plain": ".txt", "text/markdown": ".md", "application/json": ".json", "image/png": ".png", "image/jpeg": ".jpg", "application/xml": ".xml", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx"}
MAX_URL, MAX_BYTES = 2048, 100 << 20


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def suffix_kind(path: Column | str) -> Column:
    """The kind by suffix; 'document' for any other."""
    p = F.lower(_col(path))
    out = F.when(F.lit(False), "")
    for s in sorted(SUFFIXES, key=len, reverse=True):
        out = out.when(p.endswith(s), SUFFIXES[s])
    return out.otherwise("document")


def kind(source: Column | str, is_file: Column | None = None, interactive: bool = False) -> Column:
    """url; the kind of a file; else text. Interactive use rejects what is neither: null."""
    s = F.trim(_col(source))
    out = F.when(s.rlike("(?i)^https?://"), "url")
    if is_file is not None:
        out = out.when(is_file, suffix_kind(s))
    return out.otherwise(F.lit(None).cast("string") if interactive else F.lit("text"))


def is_tagged_xml(content: Column | str) -> Column:
    return F.contains(F.substring(_col(content).cast("string"), 1, 1024), F.lit("<doclang"))


def is_zip(content: Column | str) -> Column:
    return F.hex(F.substring(_col(content), 1, 4)) == "504B0304"


def json_kind(text: Column | str) -> Column:
    """document for a serialised document, graph for a graph export, json for other objects, null for what isn't JSON."""
    v = F.try_parse_json(_col(text).cast("string"))
    has = lambda k: F.try_variant_get(v, f"$.{k}", "variant").isNotNull()
    document = (has("schema_name") & has("version")) | (has("pages") & has("main_text"))
    return F.when(v.isNull(), None).when(has("nodes") & has("edges"), "graph").when(document, "document").otherwise("json")


def file_kinds(files: DataFrame) -> DataFrame:
    """(path, kind) of a binaryFile table, JSON and XML told by content."""
    k = suffix_kind("path")
    text = F.col("content").cast("string")
    return files.select("path", F.when(k == "json", F.coalesce(json_kind(text), F.lit("json"))).when((k == "xml") & is_tagged_xml("content"), "tagged").when(k == "xml", "document").otherwise(k).alias("kind"))


def host(url: Column | str) -> Column:
    return F.coalesce(F.try_parse_url(_col(url), F.lit("HOST")), F.lit(""))


def url_extension(url: Column | str, content_type: Column | str | None = None) -> Column:
    """The extension of the path if it is one that is known, else by the content type."""
    path = F.lower(F.coalesce(F.try_parse_url(_col(url), F.lit("PATH")), F.lit("")))
    ext = F.regexp_extract(path, r"(\.[a-z0-9]{2,5})$", 1)
    table = F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv))
    by_type = F.element_at(table, F.lower(F.trim(F.split_part(_col(content_type), F.lit(";"), F.lit(1))))) if content_type is not None else F.lit(None)
    return F.coalesce(F.when(ext.isin(*MIME.values(), ".htm", ".jpeg"), ext), by_type, F.lit(".html"))


@F.pandas_udf(T.BooleanType())
def is_public_ip(s: pd.Series) -> pd.Series:
    """Whether an address may be asked: not private, loopback, link-local, multicast, reserved or unspecified; null for what is no address."""

    def of(x: str | None) -> bool | None:
        try:
            ip = ipaddress.ip_address((x or "").strip("[]"))
        except ValueError:
            return None
        ip = getattr(ip, "ipv4_mapped", None) or ip
        return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified)

    return s.map(of).astype("object")


def url_problem(url: Column | str, content_length: Column | None = None) -> Column:
    """Why a URL is rejected, or null. Names are to be resolved, and their addresses asked again, before a fetch and after each redirect, by whoever fetches."""
    u = F.trim(_col(url))
    h = host(u)
    bad_host = F.lower(h).isin("localhost", "metadata.google.internal") | F.lower(h).rlike(r"\.(local|internal|localhost)$")
    out = F.when(u.isNull() | (u == ""), "empty").when(F.length(u) > MAX_URL, "too long").when(~u.rlike("(?i)^https?://"), "scheme").when(h == "", "no host").when(bad_host, "protected host").when(~F.coalesce(is_public_ip(h), F.lit(True)), "protected address")
    return out.when(content_length > MAX_BYTES, "too large") if content_length is not None else out


def text_problem(text: Column | str, path: Column | None = None) -> Column:
    """Why a text is rejected, or null."""
    t = _col(text)
    out = F.when(t.isNull(), "unreadable").when(F.trim(t) == "", "empty")
    return out.when(~suffix_kind(path).isin("text", "markdown"), "extension") if path is not None else out


def split_valid(df: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a problem, and the others with it."""
    d = df.withColumn("problem", problem)
    return d.filter("problem is null").drop("problem"), d.filter("problem is not null")
