"""A C++ lexer and a light parser: items, calls, structure and validity of decompiled code.

There is no grammar behind it. Definitions, calls, branches and members are found from the
tokens and their brackets, in one pass without recursion, so that broken and very deep code is read as
well. Depth, histogram and validity are this parser's own measures and do not equal those of a
grammar; items, calls, identifiers and literals are meant to.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

from .constants import COMMON_IDENTIFIERS, STOP_IDENTIFIERS

_TOKEN = re.compile(
    r"""(?P<space>\s+)
    |(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<directive>^[ \t]*\#(?:[^\n\\]|\\.)*)
    |(?P<raw>R"(?P<mark>[^ ()\\\t\n]{0,16})\(.*?\)(?P=mark)")
    |(?P<string>(?:u8|[uUL])?"(?:\\.|[^"\\\n])*")
    |(?P<char>(?:u8|[uUL])?'(?:\\.|[^'\\\n])+')
    |(?P<number>(?:0[xX][0-9a-fA-F']+|0[bB][01']+|(?:\d[\d']*\.?[\d']*|\.\d[\d']*)(?:[eE][+-]?\d+)?)[uUlLfF]*)
    |(?P<word>[^\W\d]\w*)
    |(?P<punct>::|->\*?|\+\+|--|<<=|>>=|<=>|<<|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|\.\.\.|[{}()\[\];:,.?~<>=+\-*/%&|^!])
    |(?P<bad>.)""",
    re.VERBOSE | re.DOTALL | re.MULTILINE,
)
_PAIRS = {")": "(", "]": "[", "}": "{"}
_TYPE_WORDS = frozenset("void bool char short int long float double unsigned signed auto const static constexpr volatile inline extern mutable register typename struct class enum union virtual explicit friend".split())
_CONTROL = frozenset("if for while switch catch return sizeof alignof decltype throw new delete else do case goto typeid noexcept static_assert and or not using namespace template operator".split())
_AFTER_PARAMETERS = frozenset("const noexcept override final volatile try".split())


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


@dataclass
class Item:
    kind: str
    name: str
    body: str
    calls: list[str] = field(default_factory=list)


def tokenize(code: str) -> list[Token]:
    """All tokens but space, comments and directives."""
    out = []
    for m in _TOKEN.finditer(code):
        kind = m.lastgroup if m.lastgroup != "mark" else "raw"
        if kind not in ("space", "comment", "directive"):
            out.append(Token("string" if kind == "raw" else kind, m.group(), m.start(), m.end()))
    return out


def _closers(tokens: list[Token]) -> tuple[dict[int, int], bool]:
    """For each opening bracket its closing one; and whether all brackets pair up."""
    stack, pairs, good = [], {}, True
    for i, t in enumerate(tokens):
        if t.kind != "punct":
            continue
        if t.text in "([{":
            stack.append(i)
        elif t.text in _PAIRS:
            if stack and tokens[stack[-1]].text == _PAIRS[t.text]:
                pairs[stack.pop()] = i
            else:
                good = False
    return pairs, good and not stack


def _name_before(tokens: list[Token], at: int) -> int:
    """Where the possibly qualified name that ends before ``at`` begins, or ``at`` if there is none."""
    i = at
    while i > 0:
        t = tokens[i - 1]
        if t.kind == "word" and t.text not in _TYPE_WORDS and (i == at or tokens[i].text in ("::", "<", "~")):
            i -= 1
        elif t.text == "::" and i < at:
            i -= 1
        elif t.text == "~" and i < at and tokens[i].kind == "word":
            i -= 1
        elif t.text == ">" and (i == at or tokens[i].text in ("::", "(")):
            depth, j = 0, i - 1
            while j >= 0:
                depth += {">": 1, ">>": 2, "<": -1}.get(tokens[j].text, 0)
                if depth == 0:
                    break
                if tokens[j].text in (";", "{", "}"):
                    return i
                j -= 1
            if j <= 0 or depth or tokens[j - 1].kind != "word":
                return i
            i = j
        else:
            break
    while i < at and tokens[i].text == "::":
        i += 1
    return i


def _operator_name(tokens: list[Token], at: int) -> int | None:
    """If the symbol before ``at`` is an operator function's, where its ``operator`` stands."""
    for back in range(1, 4):
        if at - back >= 0 and tokens[at - back].text == "operator":
            return at - back
    return None


def _calls(tokens: list[Token], low: int, high: int, closers: dict[int, int]) -> list[str]:
    """The callee text of each call between two places, in order, repeats kept."""
    out = []
    for i in range(low, high):
        if tokens[i].text != "(" or i not in closers or i == low:
            continue
        begin = _name_before(tokens, i)
        if begin == i or tokens[begin].text in _CONTROL or tokens[i - 1].text in _CONTROL:
            continue
        # members are called through their object: take the whole chain
        while begin - 2 >= 0 and tokens[begin - 1].text in (".", "->") and tokens[begin - 2].kind == "word":
            begin = _name_before(tokens, begin - 1)
        before = tokens[begin - 1] if begin > low else None
        # "Type name(" declares; "return f(" and "x = f(" call
        if before is not None and ((before.kind == "word" and before.text not in ("return", "else", "do", "throw", "case", "and", "or", "not")) or before.text in ("*", "&") and begin - 2 >= low and tokens[begin - 2].text in _TYPE_WORDS):
            continue
        out.append("".join(t.text for t in tokens[begin:i]))
    return out


def scan(code: str, top_level_only: bool = False) -> list[Item]:
    """Structs, classes, functions and declarations in order of where they start.

    What lies inside a struct or a function is listed inside it and again on its own, unless
    ``top_level_only``. A function's calls are distinct and sorted.
    """
    tokens = tokenize(code)
    closers, _ = _closers(tokens)
    found: list[tuple[int, int, Item]] = []
    for i, t in enumerate(tokens):
        if t.text in ("struct", "class") and i + 1 < len(tokens) and tokens[i + 1].kind == "word" and not (i and tokens[i - 1].text in ("enum", "<", ",")):
            j = i + 2
            while j < len(tokens) and tokens[j].text not in ("{", ";", "(", ")", "=", "*", "&") and not (tokens[j].kind == "word" and tokens[j - 1].kind == "word" and tokens[j].text != "final"):
                j += 1
            end = closers.get(j) if j < len(tokens) and tokens[j].text == "{" else i + 1
            if end is not None:
                found.append((i, end, Item(t.text, tokens[i + 1].text, code[t.start : tokens[end].end])))
    bodies = []
    for i, t in enumerate(tokens):
        if t.text != "{" or i not in closers:
            continue
        head = _head(tokens, i, closers)
        if head is not None:
            first, name_at, open_at = head
            operator = _operator_name(tokens, open_at)
            name = "".join(x.text for x in tokens[operator if operator is not None else name_at : open_at])
            end = closers[i]
            calls = sorted(set(_calls(tokens, i, end, closers)))
            found.append((first, end, Item("function", name, code[tokens[first].start : tokens[end].end], calls)))
            bodies.append((first, end))
    found += _declarations(tokens, closers, code)
    found.sort(key=lambda x: (x[0], -x[1]))
    if not top_level_only:
        return [x[2] for x in found]
    out, reach = [], -1
    for a, b, item in found:
        if a > reach:
            out.append(item)
            reach = max(reach, b)
    return out


def _head(tokens: list[Token], brace: int, closers: dict[int, int]) -> tuple[int, int, int] | None:
    """Does a function's body open here? Its first token, its name's and its parameter list's."""
    low = brace - 1
    while low >= 0 and tokens[low].text not in (";", "{", "}"):
        low -= 1
    first = low + 1
    # an access label is no part of a definition
    while first + 1 < brace and tokens[first].text in ("public", "private", "protected") and tokens[first + 1].text == ":":
        first += 2
    depth = 0
    for i in range(first, brace):
        t = tokens[i].text
        if t == "(" and depth == 0 and i in closers and closers[i] < brace:
            start = _name_before(tokens, i)
            operator = _operator_name(tokens, i)
            named = start < i and tokens[start].text not in _CONTROL and tokens[i - 1].text not in _CONTROL
            if not named and operator is None:
                return None
            after = tokens[closers[i] + 1 : brace]
            if after and not (after[0].text in _AFTER_PARAMETERS or after[0].text in (":", "->", "&", "&&")):
                return None
            return first, start, i
        if t == "=" and depth == 0:
            return None
        depth += {"(": 1, ")": -1}.get(t, 0)
    return None


def _declarations(tokens: list[Token], closers: dict[int, int], code: str) -> list[tuple[int, int, Item]]:
    out, i = [], 0
    while i < len(tokens):
        j = i
        while j < len(tokens) and tokens[j].text not in (";", "{", "}"):
            j = closers.get(j, j) + 1 if tokens[j].text in ("(", "[") else j + 1
        if j < len(tokens) and tokens[j].text == ";" and j > i + 1 and tokens[i].kind == "word" and tokens[i].text not in _CONTROL | {"break", "continue", "default", "public", "private", "protected"}:
            stop = next((k for k in range(i, j) if tokens[k].text in ("=", "(", "[", ",")), j)
            name = stop - 1
            if name > i and tokens[name].kind == "word" and (tokens[name - 1].kind == "word" or tokens[name - 1].text in ("*", "&", ">", "&&") or tokens[stop].text == "(" and tokens[name - 1].text == "::" and tokens[i].text in _TYPE_WORDS):
                out.append((i, j, Item("declaration", tokens[name].text, code[tokens[i].start : tokens[j].end])))
        i = j + 1
    return out


def is_valid(code: str | None) -> bool:
    """Does it read as code: something there, brackets paired, strings closed, statements ended, no run of prose?"""
    tokens = tokenize(code or "")
    if not tokens or any(t.kind == "bad" and t.text not in "@\\$`" or t.kind == "bad" and t.text in "`" for t in tokens):
        return False
    closers, paired = _closers(tokens)
    if not paired:
        return False
    run = 0
    for i, t in enumerate(tokens):
        run = run + 1 if t.kind == "word" and t.text not in _TYPE_WORDS and t.text not in _CONTROL else 0
        if run >= 4:
            return False
        if t.text == "}" and i and tokens[i - 1].kind in ("word", "number") and not _in_list(tokens, i, closers):
            return False
    return tokens[-1].text in ("}", ";") or not any(t.text == "{" for t in tokens) and tokens[-1].text == ")"


def _in_list(tokens: list[Token], close: int, closers: dict[int, int]) -> bool:
    """Is this the end of an initializer or an enum, whose last entry needs no semicolon?"""
    opener = next(o for o, c in closers.items() if c == close)
    inside = tokens[opener + 1 : close]
    if any(t.text == ";" for t in inside):
        return False
    before = tokens[max(0, opener - 4) : opener]
    if before and before[-1].text == ")":
        return False
    return bool(before) and (before[-1].text in ("=", "(", ",", "{", "return", ">", "]") or any(t.text == "enum" for t in before) or before[-1].kind == "word" and len(inside) >= 1 and any(t.text == "," for t in inside) or len(inside) == 1)


def complexity(code: str) -> dict[str, int]:
    """Branches plus one, calls, and the deepest nesting of brackets."""
    tokens = tokenize(code)
    closers, _ = _closers(tokens)
    count = Counter(t.text for t in tokens)
    # the while that ends a do is its own branch; do itself adds none
    branches = sum(count[w] for w in ("if", "for", "while", "case", "default", "?", "&&", "||"))
    depth = deepest = 0
    for t in tokens:
        if t.kind == "punct":
            depth += (t.text in "([{") - (t.text in _PAIRS)
            deepest = max(deepest, depth)
    heads = {h[2] for i, t in enumerate(tokens) if t.text == "{" and i in closers and (h := _head(tokens, i, closers))}
    calls = sum(1 for i in range(len(tokens)) if tokens[i].text == "(" and i not in heads and _calls(tokens, i - 1 if i else 0, i + 1, closers) and i)
    return {"cyclomatic": 1 + branches, "calls": calls, "max_depth": deepest}


def number(text: str, compat: bool = False) -> str:
    """A literal's value as text, so that hex and decimal meet. ``compat`` drops a trailing f of hex digits too."""
    plain = text.replace("'", "")
    hexadecimal = plain[:2] in ("0x", "0X")
    stripped = plain.rstrip("uUlLfF") if compat or not hexadecimal else plain.rstrip("uUlL")
    for base in (0, 8 if re.fullmatch(r"0[0-7]+", stripped) and not compat else 0):
        try:
            return str(int(stripped, base))
        except ValueError:
            continue
    try:
        return str(float(stripped))
    except ValueError:
        return text


def parse(code: str | None) -> dict:
    """Anonymous tokens in order, counts of constructs, folded identifiers and literals."""
    tokens = tokenize(code or "")
    closers, _ = _closers(tokens)
    stream, histogram, names, literals = [], Counter(), set(), set()
    for i, t in enumerate(tokens):
        if t.kind == "word" and t.text not in _TYPE_WORDS and t.text not in _CONTROL:
            stream.append("ID")
            histogram["identifier"] += 1
            if t.text not in COMMON_IDENTIFIERS:
                names.add(t.text.replace("_", "").lower())
        elif t.kind == "number":
            stream.append("NUM")
            histogram["number"] += 1
            literals.add(number(t.text))
        elif t.kind in ("string", "char"):
            inner = t.text[t.text.index(t.text[-1]) + 1 : -1]
            histogram[t.kind] += 1
            for part in re.split(r"(\\.)", inner):
                if part:
                    stream.append("STR")
                    if part[0] != "\\":
                        literals.add(part)
        else:
            stream.append(t.text)
            if t.kind == "word":
                histogram[t.text] += 1
            elif t.text == "(" and _calls(tokens, max(i - 1, 0), i + 1, closers):
                histogram["call"] += 1
            elif t.text in ("{", ";", "=", "?", "&&", "||", "[", "->", "."):
                histogram[t.text] += 1
    return {"tokens": stream, "histogram": dict(histogram), "identifiers": sorted(names), "literals": sorted(literals), "blank": not (code or "").strip()}


def identifiers(code: str | None) -> list[str]:
    """Identifiers of two characters or more that are not on the stoplist, case kept."""
    return sorted({t.text for t in tokenize(code or "") if t.kind == "word" and len(t.text) >= 2 and t.text.lower() not in STOP_IDENTIFIERS and t.text not in _CONTROL and t.text not in _TYPE_WORDS})


def structs(code: str | None) -> list[tuple[str, int, list[str]]]:
    """``(name, order, members)`` of structs and classes with a body that has members; a later one of a name replaces it."""
    out: dict[str, list[str]] = {}
    for item in scan(code or ""):
        if item.kind not in ("struct", "class") or "{" not in item.body:
            continue
        tokens = tokenize(item.body)
        closers, _ = _closers(tokens)
        i = next(k for k, t in enumerate(tokens) if t.text == "{")
        members, end = [], closers.get(i, len(tokens))
        i += 1
        while i < end:
            t = tokens[i]
            if t.text == "{":
                i = closers.get(i, i) + 1
                continue
            if t.text == "(" and i in closers:
                if tokens[i - 1].kind == "word" and tokens[i - 1].text not in _CONTROL:
                    members.append(tokens[i - 1].text)
                i = closers[i] + 1
                continue
            if t.text in (";", "=", "[", ",", ":") and tokens[i - 1].kind == "word" and tokens[i - 1].text not in ("public", "private", "protected") and tokens[i - 1].text not in _TYPE_WORDS and tokens[i - 1].text not in _AFTER_PARAMETERS:
                members.append(tokens[i - 1].text)
            if t.text == "=":
                while i < end and tokens[i].text not in (";", ","):
                    i = closers.get(i, i) + 1
                continue
            if t.text == "[" and i in closers:
                i = closers[i]
            i += 1
        if members:
            out[item.name] = sorted(set(members))
    return [(n, i, m) for i, (n, m) in enumerate(out.items())]


def signature(code: str | None) -> tuple[str, str] | None:
    """The first function's name and what stands before its body, on one line."""
    for item in scan(code or ""):
        if item.kind == "function":
            return item.name, " ".join(item.body.split("{", 1)[0].split())
    return None


# -- on columns -------------------------------------------------------------------------------------------------------

_STRINGS = T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_ITEM = _struct(ordinal=T.IntegerType(), kind=T.StringType(), name=T.StringType(), body=T.StringType(), calls=_STRINGS)


@udtf(returnType=_ITEM)
class ScanCode:
    """``scan_code(code)`` as a table function, for LATERAL."""

    def eval(self, code: str):
        for i, item in enumerate(scan(code or "")):
            yield i, item.kind, item.name, item.body, item.calls


@pandas_udf(T.BooleanType())
def valid(code: pd.Series) -> pd.Series:
    return code.map(is_valid)


@pandas_udf(_struct(parsed_name=T.StringType(), calls=_STRINGS, cyclomatic=T.IntegerType(), n_calls=T.IntegerType(), max_depth=T.IntegerType(), signature=T.StringType()))
def shape(code: pd.Series) -> pd.DataFrame:
    """Of the first function its name, distinct calls and signature; of the whole text its complexity."""
    rows = []
    for c in code:
        first = next((x for x in scan(c or "") if x.kind == "function"), None)
        m = complexity(c or "")
        sig = signature(c)
        rows.append((first.name if first else None, first.calls if first else [], m["cyclomatic"], m["calls"], m["max_depth"], sig[1] if sig else None))
    return pd.DataFrame(rows, columns=["parsed_name", "calls", "cyclomatic", "n_calls", "max_depth", "signature"])


@pandas_udf(_struct(tokens=_STRINGS, histogram=T.MapType(T.StringType(), T.IntegerType()), identifiers=_STRINGS, literals=_STRINGS, blank=T.BooleanType()))
def parsed(code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(c) for c in code], columns=["tokens", "histogram", "identifiers", "literals", "blank"])


@pandas_udf(_STRINGS)
def code_identifiers(code: pd.Series) -> pd.Series:
    return code.map(identifiers)


@pandas_udf(T.ArrayType(_struct(name=T.StringType(), ord=T.IntegerType(), fields=_STRINGS)))
def code_structs(code: pd.Series) -> pd.Series:
    return code.map(lambda c: [{"name": n, "ord": i, "fields": m} for n, i, m in structs(c)])


@pandas_udf(T.ArrayType(_ITEM))
def code_items(code: pd.Series) -> pd.Series:
    return code.map(lambda c: [{"ordinal": i, "kind": x.kind, "name": x.name, "body": x.body, "calls": x.calls} for i, x in enumerate(scan(c or ""))])


def items(functions, code: str = "code"):
    """One row an item: the table's columns and ``ordinal, kind, item, body, calls``."""
    found = functions.withColumn("__item", F.explode(code_items(F.col(code))))
    return found.select(*functions.columns, "__item.ordinal", "__item.kind", F.col("__item.name").alias("item"), "__item.body", "__item.calls")


def register(spark) -> None:
    """Make ``scan_code`` usable from SQL."""
    spark.udtf.register("scan_code", ScanCode)


__all__ = ["ScanCode", "code_items", "code_identifiers", "code_structs", "complexity", "is_valid", "items", "number", "parse", "parsed", "register", "scan", "shape", "signature", "structs", "tokenize", "valid"]
