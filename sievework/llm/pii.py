"""Personal data: strict formats, and boosted trees over looser candidates. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import let, prefix_scan, staged

KINDS = ("email", "ip", "card", "phone")

#: The strict formats. Starting a run of a class only at its first character, or where the last match
#: ended, and taking runs possessively gives the same leftmost matches without the square of a run's length.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: High-recall generators of candidates for the trees: (kind, pattern, what every match holds: without it the pattern need not run).
#: Their proposals overlap: each reads the text in which what was found before is covered. Parts of a mail address are as long as the mail
#: standards allow: 64 characters before the at sign, 63 to a label.
LOOSE = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@|\x20?[\[(]\x20?(?:at|AT|@)\x20?[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(]\x20?(?:dot|DOT|\.)\x20?[\])]\x20?|\x20dot\x20)[A-Za-z][A-Za-z0-9-]{0,62}+)++", r"@|[\[(]\x20?(?:at|AT)\x20?[\])]|\x20at\x20"),
    ("ip", r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,4}+(?:\x20?[\[(]\.[\])]\x20?[0-9]{1,4}+){3}|(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4})(?![0-9A-Fa-f:])", r"[0-9]|:"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}(?![0-9]|\.[0-9])", r"[0-9]"),
    ("phone", r"\+[0-9]{1,3}+[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4}+)[\x20./-]?[0-9]{3,4}+[\x20./-]?[0-9]{3,4}+(?![0-9])", r"\+"),
    ("card", r"(?<![0-9])[0-9]{13,19}+(?![0-9])", "[0-9]"),
    ("card", r"(?<![0-9.])[0-9]{4}[\x20.-]{1,2}(?:[0-9]{4}[\x20.-]{1,2}[0-9]{4}[\x20.-]{1,2}[0-9]{4}|[0-9]{6}[\x20.-]{1,2}[0-9]{5})(?![0-9])", "[0-9]"),
    ("phone", r"(?<![0-9+(.])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20./-]{1,2}[0-9]{3,4}[\x20./-]?[0-9]{3,4}(?![0-9.])", "[0-9]"),
    ("card", r"(?<![0-9.])[0-9](?:[\x20.-]{0,2}[0-9]){11,18}+(?![0-9])", "[0-9]"),
)

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_SPAN = "array<struct<kind:int,start:bigint,end:bigint,hit:string>>"
#: Stands for each code point of what is covered; no pattern matches it.
_COVER = "\ufffc"
_COVERED = f"repeat('{_COVER}', CAST(_len AS INT))"


def _raw(pattern: str) -> str:
    return f"r'{pattern}'"


def _pieces(text: str, pattern: str) -> str:
    """``(gap, hit, start, end, after)`` of all matches in order, with code-point positions, and the text after the last as a match of nothing.

    ``gap`` is what lies between a match and the one before, ``after`` the first characters of what follows it. This and what
    follows is SQL text, which Spark reads many times faster than as many calls.
    """
    ended = "concat(_hits, array(''))"
    starts = prefix_scan(f"zip_with(_gaps, {ended}, (_g, _h) -> length(_g) + length(_h))")
    after = "concat(slice(_gaps, 2, size(_hits)), array(''))"
    pairs = f"zip_with(zip_with(_gaps, {ended}, (_g, _h) -> struct(_g AS gap, _h AS hit)), {after}, (_p, _f) -> struct(_p.gap AS gap, _p.hit AS hit, substring(_f, 1, 12) AS after))"
    placed = "struct(_p.gap AS gap, _p.hit AS hit, _at + length(_p.gap) AS start, _at + length(_p.gap) + length(_p.hit) AS end, _p.after AS after)"
    both = let(f"split({text}, {_raw(pattern)}, -1)", "_gaps", f"zip_with({pairs}, {starts}, (_p, _at) -> {placed})")
    return let(f"regexp_extract_all({text}, {_raw(pattern)}, 0)", "_hits", both)


def _as_span(piece: str, kind: str) -> str:
    return f"struct({KINDS.index(kind)} AS kind, {piece}.start AS start, {piece}.end AS end, {piece}.hit AS hit)"


def _found(text: str, kind: str, pattern: str, check: str = "TRUE") -> str:
    """All matches in order as spans, of those whose ``hit`` passes ``check``."""
    return f"transform(filter({_pieces(text, pattern)}, _p -> _p.hit <> '' AND {check}), _p -> {_as_span('_p', kind)})"


def covered(text: str, spans: str, put: str) -> str:
    """``text`` with each span replaced by ``put``, which may use ``_kind`` and ``_len``; spans that overlap are one, of the first's kind.

    Text is read in stretches, so that cutting a piece out does not go through all that lies before it.
    """
    wide = 1_000

    def cut(a: str, b: str) -> str:
        first, last = f"CAST(floor({a} / {wide}) AS INT)", f"CAST(floor(({b} - 1) / {wide}) AS INT)"
        inside = lambda i, x, y: f"substring(element_at(_parts, {i} + 1), CAST({x} - {i} * {wide} + 1 AS INT), CAST({y} - {x} AS INT))"
        middle = f"array_join(slice(_parts, {first} + 2, greatest({last} - {first} - 1, 0)), '')"
        far = f"concat({inside(first, a, f'({first} + 1) * {wide}')}, {middle}, {inside(last, f'{last} * {wide}', b)})"
        return f"CASE WHEN {a} >= {b} THEN '' WHEN {first} = {last} THEN {inside(first, a, b)} ELSE {far} END"

    order = f"array_sort(transform({spans}, _s -> struct(_s.start AS start, _s.end AS end, _s.kind AS kind)))"
    before = prefix_scan("transform(_order, _s -> _s.end)", "greatest({0}, {1})")
    heads = "filter(zip_with(_order, _before, (_s, _b) -> struct(_s.kind AS kind, _s.start AS start, _b AS before)), _s -> _s.start >= _s.before)"
    ends = "concat(transform(slice(_heads, 2, size(_heads)), _s -> _s.before), array(_far))"
    one = f"concat({cut('_s.before', '_s.start')}, {let('_s.kind', '_kind', let('_e - _s.start', '_len', put))})"
    joined = f"concat(array_join(zip_with(_heads, {ends}, (_s, _e) -> {one}), ''), {cut('_far', f'CAST(length({text}) AS BIGINT)')})"
    body = let(heads, "_heads", let("array_max(transform(_order, _s -> _s.end))", "_far", joined))
    whole = let(order, "_order", let(before, "_before", let(f"regexp_extract_all({text}, r'(?s).{{1,{wide}}}', 0)", "_parts", body)))
    return f"CASE WHEN size({spans}) = 0 THEN {text} ELSE {whole} END"


def _digits(hit: str) -> str:
    return f"regexp_replace({hit}, '[^0-9]', '')"


def _luhn(hit: str) -> str:
    digit = "CAST(substring(_rev, _i, 1) AS INT)"
    value = f"CASE WHEN _i % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END"
    # longer runs are no card; the sum of one would take its length squared
    return let(f"reverse({_digits(hit)})", "_rev", f"CASE WHEN length(_rev) = 0 OR length(_rev) > 19 THEN FALSE ELSE aggregate(sequence(1, length(_rev)), 0, (_acc, _i) -> _acc + {value}) % 10 = 0 END")


def _valid(hit: str, kind: str) -> str:
    return {
        "email": "TRUE",
        "ip": rf"{hit} RLIKE r'^{_OCTET}(?:\.{_OCTET}){{3}}$'",
        "card": f"(length({_digits(hit)}) BETWEEN 13 AND 19 AND {_luhn(hit)})",
        "phone": f"length({_digits(hit)}) BETWEEN 9 AND 15",
    }[kind]


_NONE = f"CAST(array() AS {_SPAN})"


#: What a text holds if a strict format matches in it.
_NEEDS = {"email": "contains({0}, '@')", "phone": "contains({0}, '+')"}


def strict_spans(text: str = "text") -> str:
    """The base spans of a text, by kind in the order of ``KINDS`` and then by start."""
    per = [f"CASE WHEN {_NEEDS.get(k, 'TRUE').format(text)} THEN {_found(text, k, STRICT[k], _valid('_p.hit', k))} ELSE {_NONE} END" for k in KINDS]
    return f"concat({', '.join(per)})"


def loose_spans(text: str = "text") -> str:
    """What each generator proposes in a text, generator by generator."""
    return "concat({})".format(", ".join(f"CASE WHEN {text} RLIKE {_raw(needs)} THEN {_found(text, kind, pattern)} ELSE {_NONE} END" for kind, pattern, needs in LOOSE))


FEATURES = ["generator", "length", "digits", "seps", "sep_kinds", "letters", "at_sign", "dots", "groups", "luhn", "top_group", "last_group", "octets", "last_letters", "before", "after", "digits_before", "digits_after"]


def features(piece: str, generator: int | str) -> list[str]:
    """Format and context features of a candidate of a generator, a number or an expression, in the order of ``FEATURES``; no word of any language among them."""
    hit, gap, after = f"{piece}.hit", f"substring({piece}.gap, -24, 24)", f"{piece}.after"
    kind_of = lambda c: rf"CASE WHEN {c} = '' THEN 4 WHEN {c} RLIKE r'\s' THEN 0 WHEN {c} RLIKE '[0-9]' THEN 1 WHEN {c} RLIKE r'\p{{L}}' THEN 2 ELSE 3 END"
    groups = f"filter(split({hit}, '[^0-9]+'), _g -> _g <> '')"
    return [
        str(generator), f"length({hit})", f"length({_digits(hit)})", rf"length(regexp_replace({hit}, r'[^\s().\[\]:-]', ''))", f"size(array_distinct(filter(split(regexp_replace({hit}, '[A-Za-z0-9]', ''), ''), _c -> _c <> '')))",
        f"length(regexp_replace({hit}, '[^A-Za-z]', ''))", f"CAST(contains({hit}, '@') AS INT)", f"length(regexp_replace({hit}, '[^.]', ''))", f"size({groups})", f"CAST({_luhn(hit)} AS INT)",
        f"coalesce(array_max(transform({groups}, _g -> least(length(_g), 9))), 0)", f"least(coalesce(length(try_element_at({groups}, -1)), 0), 9)", f"size(filter({groups}, _g -> _g RLIKE r'^{_OCTET}$'))", f"length(regexp_extract({hit}, '([A-Za-z]*)$', 1))",
        # the text's first character stands like one after white space, one right behind another match does not
        f"CASE WHEN {piece}.start = 0 THEN 0 ELSE {kind_of(f'substring({gap}, -1, 1)')} END", kind_of(f"substring({after}, 1, 1)"), f"length({_digits(gap)})", f"length({_digits(after)})",
    ]


def _rewritten(kind: str) -> str:
    """Lines ``(text, at, to, truth)`` from a strict span ``p`` of a kind and what lies around it.

    The span as it stands; in a form that people give it to hide or to group it, still what it was; and in a form that
    looks like it and is none: digits that fail their check, parts out of range, a mail address without a domain.
    """
    hit, digits, ten = "p.hit", _digits("p.hit"), f"right({_digits('p.hit')}, 10)"
    roll = lambda salt, n: f"CAST(pmod(xxhash64(p.hit, p.gap, '{salt}'), {n}) AS INT)"
    pick = lambda salt, *xs: f"element_at(array({', '.join(xs)}), {roll(salt, len(xs))} + 1)"
    fours = lambda d: pick("sep", *[rf"regexp_replace({d}, r'(?<=\G[0-9]{{4}})(?!$)', '{sep}')" for sep in (".", "  ", "- ")], d)
    third = lambda a, b, c: f"concat('{a}', substring({ten}, 1, 3), '{b}', substring({ten}, 4, 3), '{c}', substring({ten}, 7, 4))"
    name, host = f"substring_index({hit}, '@', 1)", f"substring_index({hit}, '@', -1)"
    broken = f"concat(substring({digits}, 1, length({digits}) - 1), CAST((CAST(substring({digits}, -1, 1) AS INT) + 1 + {roll('d', 8)}) % 10 AS STRING))"
    loose, none = {
        "email": (
            f"replace(replace({hit}, '@', {pick('at', *map(repr, (' at ', ' [at] ', '(at)', ' (at) ')))}), '.', {pick('dot', *map(repr, (' dot ', ' [dot] ', '[.]', '.')))})",
            pick("no", f"concat({name}, ' at ', regexp_replace({host}, '[.].*', ''))", f"concat({name}, ' at noon')", name),
        ),
        "ip": (
            f"replace({hit}, '.', {pick('ip', *map(repr, ('[.]', ' [.] ', '(.)')))})",
            pick("v", f"concat({hit}, '.', substring({digits}, 1, 2))", f"regexp_replace({hit}, '^[0-9]+', '7312')", f"concat({hit}, '.0.1')"),
        ),
        "card": (fours(digits), fours(broken)),
        "phone": (
            pick("tel", third("(", ") ", "-"), third("", "-", "-"), third("0", " ", " "), third("", "/", "-")),
            pick("few", f"substring({digits}, 1, 7)", third("", "", ""), f"concat_ws('.', substring({ten}, 1, 3), substring({ten}, 4, 3), substring({ten}, 7, 3))", f"concat_ws(' ', substring({ten}, 1, 3), substring({ten}, 4, 3), substring({ten}, 7, 3))", f"concat(substring({ten}, 1, 4), '/', substring({ten}, 5, 2))", f"concat('+', substring({ten}, 1, 5))"),
        ),
    }[kind]
    lead = "substring(p.gap, -40, 40)"
    line = lambda item, truth: f"struct(concat({lead}, {item}, p.after) AS text, CAST(length({lead}) AS BIGINT) AS at, CAST(length({lead}) + length({item}) AS BIGINT) AS to, {truth} AS truth)"
    return f"array({line(hit, 'TRUE')}, {line(loose, 'TRUE')}, {line(none, 'FALSE')})"


def examples(docs: DataFrame) -> DataFrame:
    """``(fold, kind, *FEATURES, label, n)``: the candidates in all documents that have a digit or an @, ``n`` of them alike.

    Labels come from the strict formats. What they find is put back into its own surroundings as it stands, in looser forms, and in forms that
    are none (``_rewritten``); a candidate that is one of the former but for four characters before and one after, and is of its kind, is a true one. In the documents as they are, a
    candidate that is no strict span is a hard negative, unless its own digits pass the strict check of its kind. Folds are 0 to 9, by text.
    """
    held = docs.select(F.coalesce(docs["text"], F.lit("")).alias("text")).where("text RLIKE '[0-9@]'")
    fold = "CAST(pmod(xxhash64(text, 'fold'), 10) AS INT) AS fold"
    lines = []
    for k, kind in enumerate(KINDS):
        around = held.where(_NEEDS.get(kind, "TRUE").format("text")).selectExpr(fold, f"explode(filter({_pieces('text', STRICT[kind])}, _p -> _p.hit <> '' AND {_valid('_p.hit', kind)})) AS p")
        lines.append(around.selectExpr("fold", f"explode({_rewritten(kind)}) AS l").selectExpr("fold", "l.text", "l.at", "l.to", f"{k} AS kind", "l.truth"))
    made = reduce(DataFrame.union, lines).distinct()
    # in documents as they are each strict span is a truth of its own; around a rewritten one there may be others, which nobody knows of
    every = held.selectExpr(fold, "text", f"transform({strict_spans()}, _s -> struct(_s.start AS at, _s.end AS to, _s.kind AS kind, TRUE AS truth)) AS items", "TRUE AS whole")
    every = every.union(made.selectExpr("fold", "text", "array(struct(at, to, kind, truth))", "FALSE"))
    # all generators read a text while it is there, so that no copy of the corpus is stored
    proposed = [f"CASE WHEN text RLIKE {_raw(needs)} THEN transform(filter({_pieces('text', pattern)}, _p -> _p.hit <> ''), _p -> struct({g} AS g, {KINDS.index(kind)} AS kind, _p AS p)) END" for g, (kind, pattern, needs) in enumerate(LOOSE)]
    found = every.selectExpr("fold", "items", "whole", f"inline(flatten(filter(array({', '.join(proposed)}), _a -> _a IS NOT NULL)))")
    found = found.where("whole OR exists(items, _t -> _t.at < p.end AND p.start < _t.to)")
    meets = "exists(items, _t -> _t.truth AND _t.kind = kind AND abs(p.start - _t.at) <= 4 AND abs(p.end - _t.to) <= 1)"
    # what a strict format misses as it stands beside other digits is no negative
    passes = " ".join(f"WHEN {k} THEN p.hit RLIKE r'^(?:{STRICT[kind]})$' AND {_valid('p.hit', kind)}" for k, kind in enumerate(KINDS))
    columns = [f"CAST({x} AS DOUBLE) AS {name}" for x, name in zip(features("p", "g"), FEATURES, strict=True)]
    rows = found.selectExpr("fold", "kind", *columns, f"CAST({meets} OR (whole AND CASE kind {passes} END) AS DOUBLE) AS label")
    return rows.groupBy("fold", "kind", *FEATURES, "label").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Redactor:
    """Boosted trees as full binary trees ``(weight, features, thresholds, leaves)``, each kind's least probability, and how it did on the documents kept out.

    ``report`` is ``{kind: (precision, recall, true candidates)}`` of candidates of the folds that neither the trees nor the thresholds saw.
    """

    trees: list[tuple[float, list[int], list[float], list[float]]]
    depth: int
    least: dict[int, float]
    report: dict[str, tuple[float, float, int]] = field(default_factory=dict)

    def probability(self, x: str) -> str:
        """Of an array of ``FEATURES``. The trees are data that a fold walks, so the expression stays short however many there are."""
        listed = lambda values: "array({})".format(", ".join(f"{float(v)!r}D" if isinstance(v, float) else str(v) for v in values))
        trees = ", ".join(f"struct({float(w)!r}D AS w, {listed(f)} AS f, {listed(t)} AS t, {listed(v)} AS v)" for w, f, t, v in self.trees)
        leaf = f"aggregate(sequence(1, {self.depth}), 0, (_i, _d) -> 2 * _i + CASE WHEN {x}[_t.f[_i]] <= _t.t[_i] THEN 1 ELSE 2 END)"
        return f"1 / (1 + exp(-2 * aggregate(array({trees}), 0D, (_sum, _t) -> _sum + _t.w * _t.v[{leaf} - {(1 << self.depth) - 1}])))"

    def takes(self, piece: str, generator: int) -> str:
        """Is a generator's candidate personal data?"""
        least = self.least[KINDS.index(LOOSE[generator][0])]
        held = ", ".join(f"CAST({x} AS DOUBLE)" for x in features(piece, generator))
        return let(f"array({held})", "_f", f"{self.probability('_f')} >= {least!r}D")


def _full(node, depth: int) -> tuple[list[int], list[float], list[float]]:
    """A tree's splits and leaves, level by level; a leaf above the last level decides nothing below it."""
    features, thresholds, level = [], [], [node]
    for _ in range(depth):
        following = []
        for n in level:
            leaf = n.getClass().getSimpleName() == "LeafNode"
            features.append(0 if leaf else n.split().featureIndex())
            thresholds.append(0.0 if leaf else n.split().threshold())
            following += [n, n] if leaf else [n.leftChild(), n.rightChild()]
        level = following
    return features, thresholds, [float(n.prediction()) for n in level]


#: Rows of like candidates that one task learns from.
_LEARNT_A_TASK = 200_000


def fit(docs: DataFrame, rounds: int = 8, depth: int = 4, precision: float = 0.99) -> Redactor:
    """Boost trees on ``examples`` of all ``docs``, calibrate each kind's threshold and report how both do.

    All documents are learned from. Candidates of equal features are one row that weighs as many as there are; so training
    grows with the different ones. Trees learn from folds
    0 to 5. A kind's threshold is the lowest probability, 0.5 at least, at and above which candidates of folds 6 and 7 have ``precision``; a kind
    that never has it adds nothing. Folds 8 and 9 are for the report. Documents without strict spans give no trees.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = staged(examples(docs), "pii-examples")
    learn = rows.where("fold < 6").groupBy(*FEATURES, "label").agg(F.sum("n").cast("double").alias("n"))
    some = learn.agg(F.count_distinct("label"), F.count(F.lit(1))).first()
    if some[0] < 2:
        return Redactor([], depth, {})
    # the same rows in the same order, so that reruns agree; splits lie between all values, not between those of a sample, up to a million rows
    dealt = learn.repartition(1 + some[1] // _LEARNT_A_TASK, *FEATURES).sortWithinPartitions(*FEATURES, "label")
    x = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(dealt).select("x", "label", "n")
    java = GBTClassifier(labelCol="label", featuresCol="x", weightCol="n", maxIter=rounds, maxDepth=depth, maxBins=1024, stepSize=0.3, seed=5, maxMemoryInMB=32).fit(x)._java_obj
    made = Redactor([(float(w), *_full(t.rootNode(), depth)) for w, t in zip(java.treeWeights(), java.trees(), strict=True)], depth, {})
    scored = rows.where("fold >= 6").select("fold", "kind", "label", "n", F.expr(let("array({})".format(", ".join(FEATURES)), "_f", made.probability("_f"))).alias("p"))
    scored = scored.groupBy((F.col("fold") < 8).alias("tuning"), "kind", "p").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("true"))
    down = Window.partitionBy("kind").orderBy(F.col("p").desc()).rangeBetween(Window.unboundedPreceding, 0)
    good = scored.where("tuning").withColumn("precision", F.sum("true").over(down) / F.sum("n").over(down)).where((F.col("precision") >= precision) & (F.col("p") >= 0.5)).groupBy("kind").agg(F.min("p").alias("least"))
    made.least = {int(r["kind"]): float(r["least"]) for r in good.collect()}
    taken = F.lit(False)
    for k, v in made.least.items():
        taken = taken | ((F.col("kind") == k) & (F.col("p") >= v))
    right, all_taken = F.sum(F.when(taken, F.col("true"))), F.sum(F.when(taken, F.col("n")))
    per = scored.where("NOT tuning").groupBy("kind").agg(F.coalesce(right, F.lit(0.0)).alias("right"), F.coalesce(all_taken, F.lit(0)).alias("taken"), F.sum("true").cast("bigint").alias("true"))
    made.report = {KINDS[r["kind"]]: (r["right"] / r["taken"] if r["taken"] else 0.0, r["right"] / r["true"] if r["true"] else 0.0, r["true"]) for r in per.collect()}
    return made


def personal_data(docs: DataFrame, model: Redactor | None = None) -> DataFrame:
    """``row, base, added``: the strict spans of every whole text and those that the trees add.

    A span is ``(kind, start, end, hit)`` with code-point positions, end exclusive; kinds are
    indexes of ``KINDS``. Strict spans are leftmost and do not overlap within a kind; a match that
    fails its check is dropped without a retry. They are covered, and the generators read what is left one after the other: what reaches its kind's threshold
    is added and covered too, so added spans overlap neither strict ones nor each other. Without a ``model`` one is fit on ``docs``.

    Null and empty texts have no spans; null ids and repeated rows are alike; a text's work is linear in its length and its matches;
    an empty table gives no rows. ``row`` keeps all columns. One pass without a shuffle; each document is on its own.
    """
    model = model or fit(docs)
    at = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    # no strict format matches a text without a digit or an @; each generator tests what it needs itself
    at = at.selectExpr("row", "text", f"CASE WHEN text RLIKE '[0-9@]' THEN {strict_spans()} ELSE {_NONE} END AS base")
    at = at.selectExpr("row", "inline(array(struct(text, base)))").selectExpr("row", "base", f"inline(array(struct({covered('text', 'base', _COVERED)} AS text, {_NONE} AS added)))")
    for g in range(len(LOOSE)):
        at = _add(at, model, g)
    return at.select("row", "base", "added")


def _add(at: DataFrame, model: Redactor, g: int) -> DataFrame:
    """``at(row, base, text, added)`` after one generator: what it adds is covered in ``text``."""
    kind, pattern, needs = LOOSE[g]
    if KINDS.index(kind) not in model.least:
        return at
    at = at.selectExpr("*", f"CASE WHEN text RLIKE {_raw(needs)} THEN {_pieces('text', pattern)} END AS pieces")
    at = at.selectExpr("row", "base", "text", "added", f"CASE WHEN size(pieces) > 1 THEN transform(pieces, _p -> struct(_p AS p, _p.hit <> '' AND {model.takes('_p', g)} AS yes)) END AS marked")
    some = "coalesce(exists(marked, _m -> _m.yes), FALSE)"
    now = "array_join(transform(marked, _m -> concat(_m.p.gap, CASE WHEN _m.yes THEN repeat('" + _COVER + "', length(_m.p.hit)) ELSE _m.p.hit END)), '')"
    new = f"transform(filter(marked, _m -> _m.yes), _m -> {_as_span('_m.p', kind)})"
    # a generator of one row: a filter on what is added would else be moved below it, and repeat each step in the next
    one = f"struct(CASE WHEN {some} THEN {now} ELSE text END AS text, CASE WHEN {some} THEN concat(added, {new}) ELSE added END AS added)"
    return at.selectExpr("row", "base", f"inline(array({one}))")


def redacted(docs: DataFrame, model: Redactor | None = None) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; spans that overlap are replaced together, by the first's kind."""
    found = personal_data(docs, model)
    names = "element_at(array({}), _kind + 1)".format(", ".join(f"'[{k}]'" for k in KINDS))
    clean = F.expr(covered("row.text", "concat(base, added)", names))
    return found.select(*[clean.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op5 over the whole ``documents`` table."""
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    names = F.array(*map(F.lit, KINDS))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == F.lit(i))).cast("bigint").alias(f"n_{KINDS[i]}")
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return found.select("row.doc_id", *[count(i) for i in range(4)], F.sha2(F.encode(listed(F.col("base")), "UTF-8"), 256).alias("base_sha256"), listed(every).alias("spans"))
