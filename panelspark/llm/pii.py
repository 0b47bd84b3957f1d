"""Personal data in texts: expressions propose spans, checksums confirm them, words nearby move the score.

Everything is a column expression; no row leaves the JVM. Repeats in the patterns are possessive, so long
runs of digits neither recurse nor backtrack, and a run is only entered at its start or where the last match
ended, so a long run without a match is read once.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: SQL conditions on the text (cheap, decides whether to search at all) and on a match ``m``.
    present: str
    valid: str
    #: Score of a valid match, and the words that raise it when they stand near.
    score: float
    words: str
    base: bool = True
    #: Group with the match, for a pattern that consumes only its head: a false start then hides nothing after it.
    group: int = 0


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = (
    "aggregate(transform(sequence(1, length({d})), i -> cast(substring({d}, length({d}) - i + 1, 1) AS int) * (2 - i % 2)),"
    " 0, (a, x) -> a + x - if(x > 9, 9, 0)) % 10 = 0").format(d=_DIGITS)
_IBAN = "replace(m, ' ', '')"
_MOD97 = (
    "aggregate(transform(sequence(1, length({d})), i -> substring(concat(substring({d}, 5), substring({d}, 1, 4)), i, 1)), 0,"
    " (a, c) -> if(c >= 'A', a * 100 + ascii(c) - 55, a * 10 + cast(c AS int)) % 97) = 1").format(d=_IBAN)
_PART = "trim(LEADING '0' FROM p)"

#: Fixed values. Characters of an IBAN by country: the registry, then the codes in use beside it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST AO CV GW MZ", 26: "IS TR DZ IR", 27: "BI DJ FR GR IT MC MR SM CF CG CM GA GQ KM MG TD",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV BF BJ CI MA ML NE SN TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}


def _iban_pattern() -> str:
    """The head of an IBAN, ahead of which its whole stands as group 1; of a code without a length, the longest run."""
    known = {n: "|".join(codes.split()) for n, codes in IBAN_LENGTHS.items()}
    tails = [rf"(?:{codes})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in known.items()]
    other = rf"(?!{'|'.join(known.values())})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}"
    return rf"(?<![A-Za-z0-9])(?=((?:{'|'.join([*tails, other])})(?![A-Za-z0-9])))[A-Z]{{2}}[0-9]{{2}}"


#: In the order of results. The first four are the base kinds; their valid spans always stay.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         "instr(text, '@') > 0", "true", 0.9, "mail|contact|write"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
         "digits AND instr(text, '.') > 0", f"forall(split(m, '[.]'), p -> length({_PART}) <= 3 AND coalesce(try_cast({_PART} AS int), 0) <= 255)",
         0.6, r"\bip\b|host|server|address"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++",
         "digits", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}", 0.8, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]",
         "instr(text, '+') > 0", f"length({_DIGITS}) BETWEEN 9 AND 15", 0.7, "phone|call|tel|mobile|fax"),
    Kind("iban", _iban_pattern(),
         "digits", f"length({_IBAN}) BETWEEN 15 AND 34 AND {_MOD97}", 0.9, "iban|bank|account", base=False, group=1),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
         "digits AND instr(text, '-') > 0", "true", 0.3, "ssn|social|security", base=False),
)
#: Code points on either side, up to the next match of the kind, in which context words count, what they add, and the least score of an added span.
NEAR, RAISE, LEAST = 40, 0.2, 0.5
_SPAN = "struct<kind: string, start: int, `end`: int, score: double>"
_SPANS = f"array<{_SPAN}>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _parts(values: str) -> str:
    """SQL of an array in successive parts of as many elements as there are parts, at least 128."""
    return (
        f"element_at(transform(array({values}), v -> element_at(transform(array(greatest(128, cast(sqrt(size(v)) AS int))), n ->"
        " transform(sequence(0, size(v) div n), j -> slice(v, j * n + 1, n))), 1)), 1)")


def _scanned(values: str, out: str, step: str) -> str:
    """SQL of a fold ``(a, x) -> step`` over an array that carries ``a.at`` from 0 and gathers rows in ``a.out``.

    Appending copies the array appended to, so rows are gathered part by part: a text of n matches takes
    n * sqrt(n) copied references, not n * n.
    """
    empty = f"cast(array() AS array<{out}>)"
    return (
        f"aggregate({_parts(values)}, struct(0 AS at, cast(array() AS array<array<{out}>>) AS out),"
        f" (s, p) -> aggregate(p, struct(s.at AS at, {empty} AS out), (a, x) -> {step},"
        " r -> struct(r.at AS at, concat(s.out, array(r.out)) AS out)), s -> flatten(s.out))")


def findings(text: Column) -> list[tuple[str, Column]]:
    """Steps ``(name, column)`` to be added one after the other; the last one, ``_found``, is
    ``array<struct<kind, start, end, score>>`` by kind and start, in code points, end exclusive."""
    steps = [("_text", F.coalesce(text, F.lit("")))]
    on = lambda sql: sql.replace("digits", "_digits").replace("text", "_text")
    steps.append(("_digits", F.expr("_text RLIKE '[0-9]'")))
    for k in KINDS:
        steps.append((f"_m_{k.name}", F.expr(f"if({on(k.present)}, regexp_extract_all(_text, {_quoted(k.pattern)}, 0), array())")))
        if k.group:
            steps.append((f"_w_{k.name}", F.expr(f"if(size(_m_{k.name}) > 0, regexp_extract_all(_text, {_quoted(k.pattern)}, {k.group}), array())")))
    for k in KINDS:
        # gaps between matches give the starts: the same finds, read as separators
        steps.append((f"_g_{k.name}", F.expr(f"if(size(_m_{k.name}) > 0, split(_text, {_quoted(k.pattern)}, -1), array())")))
    for k in KINDS:
        m, g = f"_m_{k.name}", f"_g_{k.name}"
        # whole columns go in as arguments: inside a lambda they could be evaluated for each match
        pieces = (
            f"zip_with(zip_with(slice({g}, 1, size({m})), {m}, (g, m) -> struct(g AS g, m AS m)), slice({g}, 2, size({m})),"
            f" (x, h) -> struct(length(x.g) AS gap, length(x.m) AS step, x.m AS m, concat(right(x.g, {NEAR}), ' ', left(h, {NEAR})) AS near))")
        if k.group:
            pieces = (
                f"zip_with(zip_with(zip_with(slice({g}, 1, size({m})), {m}, (g, m) -> struct(g AS g, m AS m)), _w_{k.name}, (x, w) -> struct(x.g AS g, x.m AS m, w AS w)),"
                f" slice({g}, 2, size({m})), (x, h) -> struct(length(x.g) AS gap, length(x.m) AS step, x.w AS m,"
                f" concat(right(x.g, {NEAR}), ' ', substring(h, length(x.w) - length(x.m) + 1, {NEAR})) AS near))")
        located = _scanned(
            pieces, "struct<start: int, m: string, near: string>",
            "struct(a.at + x.gap + x.step AS at, concat(a.out, array(struct(a.at + x.gap AS start, x.m AS m, x.near AS near))) AS out)")
        scored = (
            f"transform(filter({located}, s -> {k.valid.replace('m,', 's.m,')}), s -> struct('{k.name}' AS kind, s.start AS start,"
            f" s.start + length(s.m) AS `end`, least(1.0D, {k.score}D + if(s.near RLIKE '(?i){k.words}', {RAISE}D, 0.0D)) AS score))"
            .replace("\\b", "\\\\b"))
        kept = scored if k.base else f"filter({scored}, s -> s.score >= {LEAST}D)"
        if k.group:  # heads may stand inside the match before them
            kept = _scanned(kept, _SPAN, "if(x.start >= a.at, struct(x.`end` AS at, concat(a.out, array(x)) AS out), a)")
        steps.append((f"_s_{k.name}", F.expr(f"if(size(_m_{k.name}) > 0, {kept}, cast(array() AS {_SPANS}))")))
    steps.append(("_found", F.concat(*[F.col(f"_s_{k.name}") for k in KINDS])))
    return steps


def _listed(spans: str) -> Column:
    return F.expr(f"concat_ws(',', transform({spans}, s -> concat_ws(':', s.kind, s.start, s.`end`)))")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, found, counts of the base kinds, base_sha256, spans)``, one row for each row of ``docs``.

    Null and empty texts hold nothing (the hash of an empty list); null and repeated ids are kept as they are;
    an empty table gives no rows. Spans of different kinds may overlap, those of one kind never do.
    """
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_given"))
    for name, column in findings(F.col("_given")):
        out = out.withColumn(name, column)
    base = [k.name for k in KINDS if k.base]
    out = out.withColumn("_base", F.concat(*[F.col(f"_s_{n}") for n in base]))
    return out.select(
        F.col("_id").alias(id_col), F.col("_found").alias("found"),
        *[F.size(f"_s_{n}").cast("long").alias(f"n_{n}") for n in base],
        F.sha2(_listed("_base"), 256).alias("base_sha256"), _listed("_found").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets, such as ``[EMAIL]``.

    Overlapping spans become one, named after the one that starts first (of equal starts, the longest). Rows
    without a span keep their text as it is, nulls too; all columns stay.
    """
    columns = docs.columns
    own = {c: f"c{i}" for i, c in enumerate(columns)}  # names of callers can't clash with the steps
    out = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    for name, column in findings(F.col(own[text_col])):
        out = out.withColumn(name, column)
    out = out.withColumn("_cuts", F.expr("array_sort(_found, (a, b) -> CASE WHEN a.start <> b.start THEN a.start - b.start ELSE b.`end` - a.`end` END)"))
    # a last cut of nothing brings the rest of the text
    out = out.withColumn("_pieces", F.expr(_scanned(
        "concat(_cuts, array(struct('' AS kind, length(_text) AS start, length(_text) AS `end`, 0.0D AS score)))",
        "struct<from: int, upto: int, tag: string>",
        "if(x.start >= a.at, struct(x.`end` AS at, concat(a.out, array(struct(a.at AS from, x.start AS upto,"
        " if(x.kind = '', '', concat('[', upper(x.kind), ']')) AS tag))) AS out), struct(greatest(a.at, x.`end`) AS at, a.out AS out))")))
    # a place in a text is found by reading up to it: each part of the pieces reads in its own stretch
    cut = F.expr(
        f"array_join(transform(filter({_parts('_pieces')}, p -> size(p) > 0),"
        " p -> array_join(element_at(transform(array(substring(_text, p[0].from + 1, element_at(p, -1).upto - p[0].from)),"
        " t -> transform(p, x -> concat(substring(t, x.from - p[0].from + 1, x.upto - x.from), x.tag))), 1), '')), '')")
    text = F.when(F.size("_found") > 0, cut).otherwise(F.col(own[text_col]))
    return out.select(*[(text if c == text_col else F.col(n)).alias(c) for c, n in own.items()])
