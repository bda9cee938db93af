"""Scalar text functions as column expressions."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# What an identifier, its parts, a token and a line end look like; what a repository url, its parts and a ref may hold.
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*|[0-9]+"
IDENTIFIER_PART = "[A-Z]+(?![a-z])|[A-Z][a-z]+|[a-z]+|[0-9]+"
TOKEN_RUN = r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]"
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
REPO_URL = re.compile(r"https://(?:www\.)?github\.com/+([^/?#]+)/+([^/?#]+?)(?:\.git)?/*(?:[?#].*)?", re.I)
SEGMENT = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,99}")
REF = re.compile(r"[A-Za-z0-9][A-Za-z0-9._/-]{0,199}")
#: Namespace of point ids, our own.
NAMESPACE = "6f1c2b0e7d3a5e4f9b8a1d2c3e4f5a6b"


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def identifier_parts(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit(IDENTIFIER_PART), F.lit(0))


def lexical_tokens(text: Column) -> Column:
    """Lower-cased parts of each identifier or number, and the joined form if it has several."""

    def expand(raw: Column) -> Column:
        parts = F.transform(identifier_parts(raw), lambda p: F.lower(p))
        return let(parts, lambda p: F.when(F.size(p) > 1, F.concat(p, F.array(F.array_join(p, "")))).otherwise(p))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)), expand))


def token_estimate(text: Column) -> Column:
    """A quarter of each run's length, rounded up, summed."""
    runs = F.regexp_extract_all(text, F.lit(TOKEN_RUN), F.lit(0))
    return F.aggregate(runs, F.lit(0), lambda n, w: n + F.shiftright(F.length(w) + 3, 2))


#: What a byte of UTF-8 is to a token: 1 letter, 2 digit, 3 the first byte of any other character, 0 white space or a later byte.
TOKEN_BYTES = np.array([0 if 0x80 <= b < 0xC0 or chr(b) in " \t\n\x0b\f\r" else 3 if b > 0x7F or not chr(b).isalnum() else 2 if chr(b).isdigit() else 1 for b in range(256)], np.uint8)


def token_estimates(texts: pa.Array) -> pa.Array:
    """token_estimate of each text, for whole batches in a worker: runs are found among the bytes, a few numbers a byte and no regex."""
    wide = texts.cast(pa.large_string())
    _, edges, data = wide.buffers()
    at = np.frombuffer(edges, np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    kind = TOKEN_BYTES[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    begins = np.ones(len(kind), bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[at[at < len(kind)]] = True
    starts = np.flatnonzero(begins)
    size, what = np.diff(np.append(starts, len(kind))), kind[starts]
    upto = np.concatenate(([0], np.cumsum(np.where(what == 3, size, np.where(what > 0, (size + 3) >> 2, 0)))))
    found = np.diff(upto[np.searchsorted(starts, at)])
    return pa.array(found.astype(np.int32), mask=np.asarray(wide.is_null()))


def lines_of(content: Column) -> Column:
    """Universal line ends; no empty last line."""
    cut = F.split(content, LINE_END, -1)
    return let(cut, lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def citation(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def qualified_name(class_name: Column, symbol: Column) -> Column:
    return F.when(class_name != "", F.concat(class_name, F.lit("."), symbol)).otherwise(symbol)


def point_key(path: Column, class_name: Column, symbol: Column, start: Column, strategy: Column) -> Column:
    return F.concat(path, F.lit(":"), class_name, F.lit(":"), symbol, F.lit(":"), start.cast("string"), F.lit(":"), strategy)


def uuid5(key: Column, namespace: str = NAMESPACE) -> Column:
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(key, "UTF-8")))

    def shaped(h: Column) -> Column:
        variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
        return F.concat(
            F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)
        )

    return let(digest, shaped)


def cache_key(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.encode(F.lit(model), "UTF-8"), F.unhex(F.lit("00")), F.encode(text, "UTF-8")), 256)


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")


def slug_of(value: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]+", "-", value).strip("-")


def repo_of(url: str) -> tuple[str, str]:
    """(owner, name) of an https repository url; anything else is an error."""
    found = REPO_URL.fullmatch(url.strip())
    if not found or not all(SEGMENT.fullmatch(x) for x in found.groups()):
        raise ValueError(f"not an https repository url: {url!r}")
    return found[1], found[2]


def checked_ref(ref: str) -> str:
    if not REF.fullmatch(ref):
        raise ValueError(f"not a ref: {ref!r}")
    return ref


def collection_name(repo: str, model: str, strategy: str, suffix: str = "") -> str:
    try:
        source = "__".join(map(slug_of, repo_of(repo)))
    except ValueError:
        source = slug_of(repo.rstrip("/").rsplit("/", 1)[-1] or "local")
    return "__".join([source, slug_of(model.rsplit("/", 1)[-1]), strategy, *([slug_of(suffix)] if suffix else [])])


def checked_query(query: str) -> str:
    """A query must have text and no embedded flag."""
    if not query.strip():
        raise ValueError("empty query")
    if re.search(r"(?:^|\s)--[a-z]", query):
        raise ValueError(f"flag inside the query: {query!r}")
    return query
