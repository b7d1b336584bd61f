"""Patterns, names and weights that decide results."""

# Placeholders and generic names that a decompiler leaves.
ARTIFACTS = (
    r"\bFUN_[0-9a-fA-F]+\b",
    r"\b_?DAT_[0-9a-fA-F]+\b",
    r"\b[a-z]Var\d+\b",
    r"\b[a-z]Stack_[0-9a-fA-F]+\b",
    r"\blocal_[0-9a-fA-F]+\b",
    r"\bparam_\d+\b",
    r"\bundefined\d?\b",
    r"\bcode \*",
)
ARTIFACT = "|".join(ARTIFACTS)
UNNAMED = r"^FUN_[0-9a-fA-F]+$"
SYNTHETIC = r"^(?:FUN|LAB|SUB|UNK)_[0-9a-fA-F]+$"
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*$"
ADDRESS_SUFFIX = r"-[0-9a-fA-F]{4,}$"
ANY_HEX_SUFFIX = r"-[0-9a-fA-F]+$"

LIBRARY_NAMESPACES = ("std::", "__gnu_cxx::", "__cxxabiv1::", "__cxx11::")
STDLIB_HEADS = ("std", "__gnu_cxx", "__cxxabiv1")
RUNTIME_PREFIXES = (
    "__cxa_", "__cxxabiv", "_Unwind_", "_ITM_", "__gmon_start", "__libc_", "__do_global_", "_GLOBAL__sub_",
    "register_tm_clones", "deregister_tm_clones", "frame_dummy", "__stack_chk_", "__throw_",
)
RUNTIME_NAMES = ("_init", "_fini", "_start", "_dl_relocate_static_pie")
CRT_DENYLIST = (
    "_start", "_init", "_fini", "deregister_tm_clones", "register_tm_clones", "__do_global_dtors_aux", "frame_dummy",
    "__libc_csu_init", "__libc_csu_fini", "_dl_relocate_static_pie", "__stat",
)
STUB_CALLS = ("halt_baddata", "_Unwind_Resume", "__assert_fail", "abort")

# Words around a parameter's type that don't tell it apart.
TYPE_NOISE = ("const", "volatile", "struct", "class", "enum", "typename", "unsigned", "signed", "static", "inline")

# Names that a rename must never produce.
RESERVED = (
    "alignas", "alignof", "and", "asm", "auto", "bool", "break", "case", "catch", "char", "class", "const", "constexpr",
    "continue", "decltype", "default", "delete", "do", "double", "else", "enum", "explicit", "export", "extern", "false",
    "float", "for", "friend", "goto", "if", "inline", "int", "long", "main", "mutable", "namespace", "new", "noexcept",
    "not", "nullptr", "operator", "or", "private", "protected", "public", "register", "return", "short", "signed",
    "sizeof", "static", "struct", "switch", "template", "this", "throw", "true", "try", "typedef", "typename", "union",
    "unsigned", "using", "virtual", "void", "volatile", "while", "xor",
)

# Identifiers in any program, original or not: compared as written.
COMMON_IDENTIFIERS = (
    "std", "cout", "cin", "cerr", "endl", "string", "vector", "basic_string", "basic_ostream", "basic_istream",
    "operator", "printf", "scanf", "strlen", "strcmp", "strcpy", "memcpy", "memset", "malloc", "free", "main", "argc",
    "argv", "size_t", "uint8_t", "uint16_t", "uint32_t", "uint64_t", "int8_t", "int16_t", "int32_t", "int64_t",
)
# Identifiers that say nothing about recovery: compared in lower case.
STOP_IDENTIFIERS = (
    "int", "char", "bool", "double", "float", "long", "short", "unsigned", "signed", "void", "const", "static",
    "struct", "class", "return", "if", "else", "for", "while", "do", "switch", "case", "break", "continue", "true",
    "false", "nullptr", "null", "sizeof", "new", "delete", "this", "std", "cout", "cin", "cerr", "endl", "string",
    "vector", "size_t", "uint", "ulong", "auto", "namespace", "using", "include", "main",
)

SIMILARITY_WEIGHTS = {"structure": 0.35, "ast_shape": 0.15, "identifier_recovery": 0.30, "literal_recovery": 0.20}
PAIR_WEIGHTS = {"identifier": 0.4, "judge": 0.6}
HEADER_WEIGHTS = {"struct": 0.6, "judge": 0.4}
