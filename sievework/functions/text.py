"""Scalar functions over names and code text, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as k

_COMMENT = r"(?s)/\*.*?\*/|//[^\n]*"


# -- names ------------------------------------------------------------------------------------------------------------


def strip_address(name: Column) -> Column:
    """``visit-00104000`` is ``visit``; a suffix has four hex digits at least."""
    return F.regexp_replace(name, k.ADDRESS_SUFFIX, "")


def address_of(name: Column) -> Column:
    """The address that a stem ends in, else null."""
    digits = F.regexp_extract(name, r"-([0-9a-fA-F]{4,})$", 1)
    return F.conv(F.nullif(digits, F.lit("")), 16, 10).cast("bigint")


def normalize_name(name: Column) -> Column:
    """The bare identifier: no parameters, no address, no qualifier, no other characters."""
    bare = F.substring_index(strip_address(F.substring_index(name, "(", 1)), "::", -1)
    return F.regexp_replace(bare, "[^A-Za-z0-9_]", "")


def base_names(name: Column) -> Column:
    """What a name may be as a plain symbol: itself, without qualifier and any hex suffix, and that one's last word."""
    base = F.regexp_replace(F.substring_index(name, "::", -1), k.ANY_HEX_SUFFIX, "")
    last = F.regexp_extract(base, r"(\S+)\s*$", 1)
    return F.array(name, base, F.when(last == "", base).otherwise(last))


def owner(qualifier: Column) -> Column:
    """The last segment of a qualifier without template arguments; those that have them need ``identity.parse_signature``."""
    return F.substring_index(qualifier, "::", -1)


def qualified(qualifier: Column, base: Column) -> Column:
    return F.when(F.coalesce(qualifier, F.lit("")) == "", base).otherwise(F.concat_ws("::", qualifier, base))


def match_key(owner: Column, base: Column, arity: Column, params: Column, with_params: bool = True) -> Column:
    """``owner::base(arity:types)``, which ignores namespaces."""
    types = F.array_join(params, ",") if with_params else F.lit("")
    return F.concat(owner, F.lit("::"), base, F.lit("("), arity.cast("string"), F.lit(":"), F.coalesce(types, F.lit("")), F.lit(")"))


def is_stdlib(qualifier: Column) -> Column:
    return F.coalesce(F.substring_index(qualifier, "::", 1).isin(*k.STDLIB_HEADS), F.lit(False))


def is_synthetic(name: Column) -> Column:
    return strip_address(F.coalesce(name, F.lit(""))).rlike(k.SYNTHETIC)


def valid_identifier(name: Column, longest: int = 60) -> Column:
    """May a rename produce this? Whether it is taken is a join, see ``operators.naming``."""
    return name.rlike(k.IDENTIFIER) & ~name.isin(*k.RESERVED) & ~is_synthetic(name) & (F.length(name) <= longest)


def unnamed(original: Column, new_name: Column) -> Column:
    """The new name is a placeholder, or the original is one and there is no new name."""
    new = F.coalesce(new_name, F.lit(""))
    return is_synthetic(new) | (is_synthetic(original) & (new == ""))


def crt_fallback(name: Column) -> Column:
    """Kept when nothing matches: neither start-up glue nor a name with a leading underscore."""
    return ~name.isin(*k.CRT_DENYLIST) & ~F.startswith(name, F.lit("_"))


def infer_case(name: Column) -> Column:
    """A binary's name without build suffixes, lower-cased; equals a case's lower-cased name."""
    noise = r"(?i)(?:[-_.](?:O[0-3sz]|Ofast|g\+\+|gcc|clang\+\+|clang|msvc|debug|release|stripped|static|[0-9a-f]{6,})|\.exe)+$"
    return F.lower(F.regexp_replace(name, noise, ""))


def model_spec(spec: Column, default: str, providers=("local", "gemini")) -> Column:
    """``provider:model`` as a struct; splits at the first colon, and only after a known provider."""
    s = F.trim(spec)
    head = F.substring_index(s, ":", 1)
    known = F.contains(s, F.lit(":")) & head.isin(*providers)
    return F.struct(F.when(known, head).otherwise(default).alias("provider"), F.when(known, F.substring(s, F.length(head) + 2, F.length(s))).otherwise(s).alias("model"))


def workspace_name(model: Column) -> Column:
    return F.replace(F.replace(model, F.lit("/"), F.lit("__")), F.lit(":"), F.lit("_"))


# -- code -------------------------------------------------------------------------------------------------------------


def strip_comments(code: Column) -> Column:
    return F.regexp_replace(code, _COMMENT, "")


def line_count(code: Column) -> Column:
    """Lines that are not blank."""
    return F.size(F.filter(F.split(code, r"\r\n|\n|\r"), lambda x: F.trim(F.regexp_replace(x, r"\s", "")) != ""))


def artifact_count(code: Column) -> Column:
    return F.regexp_count(code, F.lit(k.ARTIFACT))


def is_blank(code: Column) -> Column:
    return F.coalesce(F.regexp_replace(code, r"\s", "") == "", F.lit(True))


def is_library(*names: Column) -> Column:
    """Standard library or C runtime by any of a function's names; null names are passed over."""
    prefix = "^(?:" + "|".join(k.RUNTIME_PREFIXES) + ")"
    found = F.lit(False)
    for name in names:
        inside = F.exists(base_names(name), lambda b: b.rlike(prefix) | b.isin(*k.RUNTIME_NAMES))
        for ns in k.LIBRARY_NAMESPACES:
            inside = inside | F.startswith(name, F.lit(ns)) | F.contains(name, F.lit("::" + ns))
        found = found | F.coalesce(inside, F.lit(False))
    return found


def is_short(code: Column, least: int = 5) -> Column:
    return line_count(strip_comments(code)) < least


def is_named_thunk(name: Column) -> Column:
    return F.coalesce(F.startswith(name, F.lit("thunk_")), F.lit(False))


def is_stub(code: Column) -> Column:
    """A body that is one call to something that never returns."""
    return strip_comments(code).rlike(r"\{\s*(?:" + "|".join(k.STUB_CALLS) + r")\s*\([^;{}]*\)\s*;?\s*\}")


def is_named_and_clean(code: Column, name: Column) -> Column:
    return F.coalesce((name != "") & ~name.rlike(k.UNNAMED), F.lit(False)) & (artifact_count(code) == 0)


def score(code: Column, cyclomatic: Column, calls: Column, depth: Column) -> Column:
    """How much there is to gain: artifacts a line, comments and their lines included, and structure."""
    density = artifact_count(code) / F.greatest(line_count(code), F.lit(1))
    return F.when(is_blank(code), 0.0).otherwise(3.0 * density + (cyclomatic - 1) + 0.5 * calls + 0.5 * depth)


def demangled_signature(code: Column) -> Column:
    """The first block comment among the first 4000 characters that has a parenthesis and is no warning."""
    comments = F.regexp_extract_all(F.substring(code, 1, 4000), F.lit(r"(?s)/\*(.*?)\*/"), F.lit(1))
    flat = F.transform(comments, lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.get(F.filter(flat, lambda c: ~F.startswith(c, F.lit("WARNING")) & F.contains(c, F.lit("("))), F.lit(0))


def definition_lines(code: Column) -> Column:
    """What stands before the first brace, joined, and then line by line; comments and directives dropped."""
    plain = F.regexp_replace(F.substring(code, 1, 4000), r"(?s)/\*.*?\*/", " ")
    lines = F.transform(F.split(F.substring_index(plain, "{", 1), r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    lines = F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("//")) & ~F.startswith(x, F.lit("#")))
    return F.when(F.size(lines) > 0, F.concat(F.array(F.array_join(lines, " ")), lines)).otherwise(F.array().cast("array<string>"))


def body_fingerprint(name: Column, code: Column) -> Column:
    """SHA-1 of a body without its own name, addresses and spacing; equal for functions that differ in those only."""
    own = normalize_name(name)
    s = F.when(own == "", code).otherwise(F.replace(code, own, F.lit("F")))
    s = F.regexp_replace(s, "0x[0-9a-fA-F]{5,}", "0")
    s = F.regexp_replace(s, r"\b[0-9a-fA-F]{6,}\b", "0")
    return F.sha1(F.encode(F.trim(F.regexp_replace(s, r"\s+", " ")), "UTF-8"))


def identifiers(code: Column, shortest: int = 2) -> Column:
    """Distinct identifiers of ASCII text without comments, strings and the stoplist, case kept, sorted."""
    plain = F.regexp_replace(strip_comments(code), r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'', " ")
    words = F.regexp_extract_all(plain, F.lit(r"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= shortest) & ~F.lower(w).isin(*k.STOP_IDENTIFIERS))))


def fold_identifier(name: Column) -> Column:
    """``unit_price`` and ``UnitPrice`` alike."""
    return F.lower(F.replace(name, F.lit("_"), F.lit("")))


def code_of_reply(reply: Column) -> Column:
    """The first fenced block of a model's reply, else the reply without fences."""
    block = F.regexp_extract(reply, r"(?s)```(?:cpp|c\+\+|c)?\s*\n(.*?)```", 1)
    fenced = reply.rlike(r"(?s)```(?:cpp|c\+\+|c)?\s*\n(.*?)```")
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(fenced, trimmed(block)).otherwise(trimmed(F.regexp_replace(reply, r"```(?:cpp)?", "")))


def proposal_of_reply(reply: Column) -> Column:
    """The one identifier in a naming reply; null if it declines or has none."""
    line = F.regexp_extract(F.regexp_replace(reply, r"^\s+", ""), r"^([^\r\n]*)", 1)
    line = F.replace(F.regexp_replace(line, r"^[`*_ \t]+|[`*_ \t\r]+$", ""), F.lit("()"), F.lit(""))
    token = F.regexp_extract(F.substring_index(line, "(", 1), r"(\S+)\s*$", 1)
    token = F.regexp_replace(token, r"^[*&;:]+|[*&;:]+$", "")
    return F.when(token.rlike(k.IDENTIFIER) & (F.upper(token) != "UNKNOWN"), token)


def tail(text: Column, most: int = 2000) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.lit("..."), F.right(text, F.lit(most))))


def duration(seconds: Column) -> Column:
    """``0.4s``, ``42s``, ``1m32s``, ``1h10m``; negative is 0."""
    s = F.greatest(seconds.cast("double"), F.lit(0.0))
    whole = F.floor(s)
    return (
        F.when(s < 10, F.format_string("%.1fs", s))
        .when(whole < 60, F.format_string("%ds", whole))
        .when(whole < 3600, F.format_string("%dm%02ds", F.floor(whole / 60), whole % 60))
        .otherwise(F.format_string("%dh%02dm", F.floor(whole / 3600), F.floor((whole % 3600) / 60)))
    )
