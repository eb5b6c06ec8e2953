"""Scalar expressions of the model as Column builders."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions import constants as K


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strength_of(ctype: Column | str) -> Column:
    c = _c(ctype)
    return reduce(lambda e, kv: e.when(c == kv[0], F.lit(kv[1])), list(K.STRENGTH.items())[1:], F.when(c == "name", F.lit(1)))


def is_heuristic(ctype: Column | str) -> Column:
    return _c(ctype).isin(*K.HEURISTIC)


def gateable(ctype: Column | str) -> Column:
    return ~_c(ctype).isin(*K.INFORMATIONAL, *K.HEURISTIC)


def reportable(ctype: Column | str, heuristics: bool = False) -> Column:
    c = _c(ctype)
    return ~c.isin(*K.INFORMATIONAL) if heuristics else gateable(c)


def scope_keys(scope: Column | str) -> Column:
    """Scopes by kind and name, innermost first."""
    return F.transform(_c(scope), lambda s: F.concat_ws(":", s["kind"], s["name"]))


def scope_ranks(scope: Column | str) -> Column:
    rank = lambda kind: reduce(lambda e, kv: e.when(kind == kv[0], F.lit(kv[1])), list(K.LOCALITY.items())[1:], F.when(kind == "function", F.lit(1))).otherwise(F.lit(K.NO_LOCALITY))
    return F.transform(_c(scope), lambda s: rank(s["kind"]))


def locality_of_keys(keys_a: Column | str, keys_b: Column | str, ranks_b: Column | str) -> Column:
    """locality_of for scopes whose keys and ranks were made once for each node."""
    a, b = _c(keys_a), _c(keys_b)
    # The intersection is in the order of its first array.
    first = F.get(F.array_intersect(b, a), F.lit(0))
    rank = F.get(_c(ranks_b), (F.array_position(b, first) - 1).cast("int"))
    return F.when(a.isNull() | b.isNull(), F.lit(K.MISSING_ENDPOINT)).otherwise(F.coalesce(rank, F.lit(K.NO_LOCALITY)))


def locality_of(scope_a: Column | str, scope_b: Column | str) -> Column:
    """The rank of the innermost scope of b that a has too, by kind and name; 5 without one. A null scope is a
    missing endpoint: 99."""
    return locality_of_keys(scope_keys(scope_a), scope_keys(scope_b), scope_ranks(scope_b))


def round4(x: Column | str) -> Column:
    """Half up on the double."""
    return F.floor(_c(x) * F.lit(10000.0) + F.lit(0.5)) / F.lit(10000.0)


def clamp01(x: Column | str) -> Column:
    return F.least(F.greatest(_c(x), F.lit(0.0)), F.lit(1.0))


def pressure_of(strength: Column | str, locality: Column | str, degree: Column | str) -> Column:
    s = F.least(F.greatest(_c(strength), F.lit(1)), F.lit(9)).cast("double")
    loc = F.least(F.greatest(_c(locality), F.lit(1)), F.lit(5)).cast("double")
    d = F.greatest(_c(degree), F.lit(0)).cast("double")
    return round4(F.least(F.lit(1.0), s / 9.0 * (loc / 5.0) * (F.lit(1.0) + F.log2(F.lit(1.0) + d) / 3.0)))


def severity_of(ctype: Column | str, strength: Column | str, locality: Column | str, pressure: Column | str) -> Column:
    p = F.coalesce(_c(pressure), F.lit(0.0))
    guessed = F.when((_c(locality) >= 4) & (p >= 0.7), "high").when(p >= 0.35, "medium").otherwise("low")
    sure = F.when((_c(strength) >= 5) & (_c(locality) >= 3), "high").when(p >= 0.35, "medium").otherwise("low")
    return F.when(is_heuristic(ctype), guessed).otherwise(sure)


def severity_rank(severity: Column | str) -> Column:
    s = _c(severity)
    return F.when(s == "high", 2).when(s == "medium", 1).otherwise(0)


def sarif_level(strength: Column | str) -> Column:
    s = _c(strength)
    return F.when(s >= 7, "error").when(s >= 4, "warning").otherwise("note")


def to_posix(path: Column | str) -> Column:
    return F.translate(_c(path), "\\", "/")


def dir_of(path: Column | str) -> Column:
    """The part before the last slash; ``.`` for a bare file."""
    p = to_posix(path)
    return F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", "")).otherwise(".")


def short_path(path: Column | str) -> Column:
    """The last two segments."""
    return F.array_join(F.slice(F.split(to_posix(path), "/"), F.greatest(F.lit(-2), -F.size(F.split(to_posix(path), "/"))), F.lit(2)), "/")


def relative_path(path: Column | str, root: str) -> Column:
    p, r = to_posix(path), root.replace("\\", "/").rstrip("/")
    return F.when(p.startswith(r + "/"), F.substring(p, len(r) + 2, 1 << 20)).otherwise(p)


def same_dir(a: Column | str, b: Column | str) -> Column:
    """Whether two directories are one: slashes, case and a closing slash don't count; a missing one matches."""
    norm = lambda x: F.regexp_replace(F.lower(to_posix(x)), "/+$", "")
    return F.coalesce(norm(a) == norm(b), F.lit(True))


def glob_to_regex(glob: str) -> str:
    """``**/`` spans any directories, ``**`` anything, ``*`` and ``?`` stay within a segment."""
    out, i, g = "", 0, glob.replace("\\", "/")
    while i < len(g):
        if g.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif g.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(g[i], re.escape(g[i]))
            i += 1
    return f"^{out}$"


def matches_any(path: Column | str, globs: list[str] | tuple[str, ...]) -> Column:
    """One combined regex for all globs; none match nothing."""
    return to_posix(path).rlike("|".join(map(glob_to_regex, globs))) if globs else F.lit(False)


def in_scope(path: Column | str, globs: list[str], ignores: list[str]) -> Column:
    return ~matches_any(path, ignores) & (matches_any(path, globs) if globs else F.lit(True))


def unquote(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), "^['\"`]|['\"`]$", "")


def is_number(text: Column | str) -> Column:
    return _c(text).rlike(r"^-?[0-9]+(\.[0-9]+)?$")


def trivial_literal(text: Column | str) -> Column:
    """Numbers and literals of fewer than two characters within their quotes."""
    return is_number(unquote(text)) | (F.length(unquote(text)) < 2)


def constant_name(name: Column | str) -> Column:
    return _c(name).rlike("^[A-Z][A-Z0-9_]*$")


PRIMITIVE = ("string", "number", "boolean", "void", "undefined", "null", "any", "unknown", "never", "object", "symbol", "bigint", "true", "false", "str", "int", "float", "bool", "None", "bytes")


def normalize_type(t: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(_c(t), r'import\("[^"]*"\)\.', ""), r"\s+", " "))


def primitive_or_function_type(t: Column | str) -> Column:
    """Unions of nothing but primitive types or quoted literals, and function types."""
    parts = F.transform(F.split(normalize_type(t), r"\|"), lambda x: F.trim(x))
    plain = F.forall(parts, lambda x: x.isin(*PRIMITIVE) | x.rlike("^['\"0-9]"))
    return plain | normalize_type(t).rlike(r"=>|\(|^typeof ")


def module_level(scope: Column | str) -> Column:
    return ~F.exists(_c(scope), lambda s: s["kind"].isin("function", "class"))


def owner_name(scope: Column | str) -> Column:
    """The innermost function's name."""
    return F.get(F.filter(_c(scope), lambda s: s["kind"] == "function"), F.lit(0))["name"]


def file_line(text: str) -> tuple[str, int]:
    """``path:line`` in parts."""
    m = re.fullmatch(r"(.*):([0-9]+)", text)
    if not m:
        raise ValueError(f"expected file:line, got {text!r}")
    return m[1], int(m[2])


def edge_key(ctype: Column, kind_a: Column, identity_a: Column, path_a: Column, name_a: Column, kind_b: Column, identity_b: Column, path_b: Column, name_b: Column) -> Column:
    """What an edge is across snapshots: its type and ends, an end by identity or else by place and name."""
    end = lambda kind, identity, path, name: F.when(identity.isNotNull(), F.concat_ws(":", F.lit("i"), kind, identity)).otherwise(F.concat_ws(":", F.lit("p"), path, name))
    return F.concat_ws("|", ctype, end(kind_a, identity_a, path_a, name_a), end(kind_b, identity_b, path_b, name_b))


def cycle_key(files: Column | str) -> Column:
    return F.array_join(F.array_sort(_c(files)), "|")


def html_escape(text: Column | str) -> Column:
    out = _c(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
