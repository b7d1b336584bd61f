"""Function identity: qualifier, base name, arity and parameter types from signatures."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .constants import TYPE_NOISE

KEY_TYPE = T.StructType().add("qualifier", T.StringType()).add("base", T.StringType()).add("arity", T.IntegerType()).add("params", T.ArrayType(T.StringType()))
_OPEN, _CLOSE = "<([", ">)]"


def split_top(text: str, sep: str) -> list[str]:
    """Split where no bracket is open; ``<``, ``(`` and ``[`` open one."""
    cuts, depth, i = [0], 0, 0
    while i < len(text):
        depth += (text[i] in _OPEN) - (text[i] in _CLOSE)
        if depth == 0 and text.startswith(sep, i):
            cuts += [i, i + len(sep)]
            i += len(sep)
        else:
            i += 1
    cuts.append(len(text))
    return [text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)]


def compact(text: str) -> str:
    """No white space inside template arguments."""
    depth, out = 0, []
    for part in re.split(r"(\boperator\s*[-<>=!]+|[<>])", text):
        if part == "<":
            depth += 1
        elif part == ">":
            depth = max(0, depth - 1)
        out.append(re.sub(r"\s+", "", part) if depth and part not in ("<", ">") else part)
    return "".join(out)


def parameter_type(declaration: str) -> str:
    """A parameter's bare type: no decoration, qualifier, template arguments or name."""
    words = [w for w in re.sub(r"[*&\[\]]", " ", declaration).split() if w not in TYPE_NOISE]
    return words[0].partition("<")[0].rpartition("::")[2] if words else ""


def _parameters(text: str) -> list[str]:
    inner = text.strip()
    return [] if inner in ("", "void") else [p.strip() for p in split_top(inner, ",") if p.strip()]


def _list_start(sig: str) -> int:
    """The parenthesis that opens the parameters: the first outside template arguments, past an operator's symbol."""
    after = re.search(r"\boperator\s*(?:\(\s*\)|\[\s*\]|[-+*/%^&|~!=<>,]+|\w[\w:]*)\s*(?=\()", sig)
    if after:
        return after.end()
    depth = 0
    for i, c in enumerate(sig):
        depth += (c == "<") - (c == ">")
        if c == "(" and depth == 0:
            return i
    return -1


def parse_signature(sig: str | None) -> tuple[str, str, int, list[str]] | None:
    """``(qualifier, base, arity, parameter types)`` of ``ns::Cls::meth(int, char*) const``; arity -1 is unknown."""
    flat = compact(" ".join((sig or "").split()))
    if not flat:
        return None
    at = _list_start(flat)
    name, arity, params = flat if at < 0 else flat[:at], -1, []
    if at >= 0:
        end = flat.rfind(")")
        if end > at:
            declared = _parameters(flat[at + 1 : end])
            arity, params = len(declared), [parameter_type(d) for d in declared]
    operator = re.search(r"(?:^|[\s:])(operator\s*\S.*)$", name.strip())
    if operator:
        lead = name.strip()[: operator.start(1)]
        base = re.sub(r"\s+", " ", operator.group(1))
        owner = lead.split(" ")[-1]
        return "::".join(s for s in split_top(owner, "::") if s), base, arity, params
    words = name.strip().split(" ")
    segments = [s for s in split_top(words[-1].lstrip("*&"), "::") if s]
    if not segments:
        return None
    base = segments[-1].partition("<")[0].strip()
    return ("::".join(segments[:-1]).strip(), base, arity, params) if base else None


def owner_of(qualifier: str) -> str:
    return split_top(qualifier, "::")[-1] if qualifier else ""


def match_key(key: tuple[str, str, int, list[str]], with_params: bool = True) -> str:
    qualifier, base, arity, params = key
    return f"{owner_of(qualifier)}::{base}({arity}:{','.join(params) if with_params else ''})"


def function_key(stem: str, demangled: str | None, lines: list[str] | None) -> tuple[str, str, int, list[str]]:
    """The best identity there is: the demangled comment, else a qualified definition line, else one with a known arity, else the stem."""
    if (key := parse_signature(demangled)) is not None:
        return key
    parsed = [key for line in lines if (key := parse_signature(line))] if lines is not None else []
    best = next((x for x in parsed if x[0]), None) or next((x for x in parsed if x[2] >= 0), None)
    if best:
        return best
    bare = re.sub(r"-[0-9a-fA-F]{4,}$", "", stem.partition("(")[0]).rpartition("::")[2]
    return "", re.sub(r"[^A-Za-z0-9_]", "", bare), -1, []


@pandas_udf(KEY_TYPE)
def signature_key(sig: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_signature(s) or (None, None, None, None) for s in sig], columns=KEY_TYPE.names)


@pandas_udf(KEY_TYPE)
def key_of(stem: pd.Series, demangled: pd.Series, lines: pd.Series) -> pd.DataFrame:
    """``function_key`` on columns; the texts come from ``text.demangled_signature`` and ``text.definition_lines``."""
    return pd.DataFrame([function_key(s, d, ls) for s, d, ls in zip(stem, demangled, lines, strict=True)], columns=KEY_TYPE.names)


@pandas_udf(T.StringType())
def match_key_of(qualifier: pd.Series, base: pd.Series, arity: pd.Series, params: pd.Series) -> pd.Series:
    return pd.Series([match_key((q, b, int(a), list(p))) for q, b, a, p in zip(qualifier, base, arity, params, strict=True)])
