"""What a scan skips, by name, depth, size and content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed as X
from ..functions.text import strip_controls

POLICY_REASONS = ("ignored-path", "ignored-directory", "ignored-filename", "ignored-extension", "ignored-depth", "symlink", "too-large")


def normalize(path: Column, fallback: Column | None = None) -> Column:
    """'/' between segments, no empty, '.' or '..' segments."""
    clean = lambda p: F.array_join(F.filter(F.split(F.translate(p, "\\", "/"), "/"), lambda s: ~s.isin("", ".", "..")), "/")
    out = clean(F.coalesce(path, F.lit("")))
    return out if fallback is None else F.when(out != "", out).otherwise(clean(F.coalesce(fallback, F.lit(""))))


def report_path(raw: Column, most: int = X.MAX_PATH) -> Column:
    """A path of a history as reports show it: no controls, no '..'; null if nothing is left or it is too long."""
    bare = strip_controls(raw)
    clean = normalize(bare)
    return F.when((F.length(bare) <= most) & (clean != ""), clean)


def is_ignored_path(path: Column, ignored: Sequence[str]) -> Column:
    """Whether a normalised path is an entry or lies below one."""
    hit = F.lit(False)
    for e in ignored:
        hit = hit | (path == e) | F.startswith(path, F.lit(e + "/"))
    return hit


def is_ignored_directory(name: Column, ignored: Sequence[str] = X.IGNORED_DIRECTORIES) -> Column:
    hit = name.isin(*ignored)
    for suffix in X.IGNORED_DIRECTORY_SUFFIXES:
        hit = hit | F.endswith(name, F.lit(suffix))
    return hit


def extension(name: Column) -> Column:
    """The last suffix in lower case; '' for none, for names that begin with their only dot or end with one."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^./]+)$", 1))


def skip_reason(name: Column, path: Column, is_directory: Column, *, ignored_paths: Sequence[str] = (), max_depth: int | None = None, follow: bool = True) -> Column:
    """The first policy that skips an entry; null if none does."""
    p = normalize(path, name)
    out = F.when(is_ignored_path(p, ignored_paths), "ignored-path").when(is_directory & is_ignored_directory(name), "ignored-directory")
    out = out.when(~is_directory & name.isin(*X.IGNORED_FILENAMES), "ignored-filename").when(~is_directory & extension(name).isin(*X.IGNORED_EXTENSIONS), "ignored-extension")
    if max_depth is not None:
        depth = F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))
        out = out.when(F.when(is_directory, depth + 1).otherwise(depth) > max_depth, "ignored-depth")
    return out


def skip_reason_with_parents(path: Column, *, ignored_paths: Sequence[str] = ()) -> Column:
    """As skip_reason for a file, its parents judged as directories."""
    p = normalize(path)
    parts = F.split(p, "/")
    name = F.element_at(parts, -1)
    parents = F.slice(parts, 1, F.size(parts) - 1)
    own = skip_reason(name, path, F.lit(False), ignored_paths=ignored_paths)
    return F.when(is_ignored_path(p, ignored_paths), "ignored-path").when(F.exists(parents, lambda d: is_ignored_directory(d)), "ignored-directory").otherwise(own)


def first_files(files: DataFrame, most: int = X.MAX_FILES) -> DataFrame:
    """The first `most` files in traversal order (traversal), and whether each is within."""
    return files.orderBy("traversal").limit(most)


def printable_share_removed(text: Column) -> Column:
    """Characters that text files don't hold: not printable, not white space."""
    return F.length(F.regexp_replace(text, r"[\t\n\x0B\f\r]|[^\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}]", ""))


def verdict(content: Column, *, window: int = X.SNIFF_BYTES, most: float = X.MAX_CONTROL_RATIO) -> Column:
    """text, nul-byte, undecodable or control-heavy, by the first bytes; a character that the window cuts is repaired."""
    head = F.substring(content, 1, window)
    cut = F.octet_length(content) > window
    hexed = F.hex(head)
    # a whole lead byte and fewer continuations than it asks for, at the very end
    tail = F.length(F.regexp_extract(hexed, r"^(?:..)*?((?:[CD][0-9A-F]|E[0-9A-F][89AB][0-9A-F]|E[0-9A-F]|F[0-4](?:[89AB][0-9A-F]){0,2}))$", 1)) / 2
    tail = F.coalesce(tail, F.lit(0.0)).cast("int")
    repaired = F.when(cut & ~F.is_valid_utf8(head.cast("string")), F.substr(head, F.lit(1), F.octet_length(head) - tail)).otherwise(head)
    text = repaired.cast("string")
    nul = F.rlike(hexed, F.lit(r"^(?:..)*?00"))
    return F.when(F.octet_length(head) == 0, "text").when(nul, "nul-byte").when(~F.is_valid_utf8(text), "undecodable").when(printable_share_removed(text) > F.length(text) * most, "control-heavy").otherwise("text")


def error_code(verdict_: Column) -> Column:
    return F.when(verdict_.isin("nul-byte", "control-heavy"), "binary").when(verdict_ == "undecodable", "invalid-encoding")
