"""Personal data: expressions propose, checksums confirm, context words adjust the score.

All of it is DataFrame functions. Where a kind's expression matches, the text is
split at the matches and the gaps and matches are zipped and summed up, which
gives every match its place in code points. Sums run in parts of PART matches
and then over the parts, and context and gaps are cut from blocks of the text,
so a text with very many matches takes time in proportion. The expressions are
written so that a scan is linear: a match starts at the start of its run of
characters or where the last match ended, and repeated groups are possessive
(they could not backtrack to another match anyway).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters before and after a span in which a context word counts.
CONTEXT = 40
#: Matches that are summed up in one go; code points of a block of text.
PART, BLOCK = 256, 1024
#: What a context word adds to a span's score; spans of the method's own kinds need at least KEEP.
CONTEXT_SCORE, KEEP = 0.35, 0.5


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: what proposes it, a cheap test of the whole text, what confirms it."""

    name: str
    pattern: str
    hint: str
    confirm: str
    score: float
    words: str
    base: bool = True


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    doubled = f"2 * cast(substring({digits}, length({digits}) + 1 - i, 1) as int)"
    plain = f"cast(substring({digits}, length({digits}) + 1 - i, 1) as int)"
    each = f"if(i % 2 = 1, {plain}, if({doubled} > 9, {doubled} - 9, {doubled}))"
    return f"aggregate(transform(sequence(1, length({digits})), i -> {each}), 0, (a, d) -> a + d) % 10 = 0"


def _mod97(value: str) -> str:
    flat = f"replace({value}, ' ', '')"
    turned = f"split(concat(substring({flat}, 5), substring({flat}, 1, 4)), '')"
    return f"aggregate(filter({turned}, c -> c <> ''), 0, (a, c) -> if(c >= 'A', a * 100 + ascii(c) - 55, a * 10 + ascii(c) - 48) % 97) = 1"


# The length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
IBAN = "(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")"

_CARD_DIGITS = _digits("x.v")
#: Base kinds in their order, then the method's own.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')", "true", 0.9, "mail|contact|write|schreib|correo|courriel"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"text rlike '[0-9]\\.[0-9]'", r"forall(split(x.v, '\\.'), p -> p rlike '^0*[0-9]{1,3}$' and int(right(p, 3)) <= 255)", 0.6, "ip|host|server|address|from|adresse|direcci"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "text rlike '[0-9](?:[ -]?[0-9]){12}'", f"length({_CARD_DIGITS}) between 13 and 19 and {_luhn(_CARD_DIGITS)}", 0.8, "card|visa|credit|pay|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(text, '+')", f"length({_CARD_DIGITS}) between 9 and 15", 0.7, "phone|tel|call|mobile|fax|anruf|handy|appel|llam"),
    Kind("iban", rf"(?<![A-Za-z0-9_]){IBAN}(?![A-Za-z0-9_])", "text rlike '[A-Z]{2}[0-9]{2} ?[A-Z0-9]'", _mod97("x.v"), 0.9, "iban|account|bank|konto|compte|cuenta", False),
    Kind("ssn", r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])", "text rlike '[0-9]-[0-9]{2}-[0-9]'", "not x.v rlike '^(000|666|9..)-|-00-|-0000$'", 0.3, "ssn|social|security|tax", False),
    Kind("secret", r"(?<![A-Za-z0-9_])(?i:token|secret|password|api[_-]?key)[\x22']?\x20?[:=]\x20?[\x22']?[A-Za-z0-9_/+.-]{16,}+", "text rlike '(?i)token|secret|password|api[_-]?key'", "true", 0.6, "access|auth|login|key", False),
)
_SPAN = "array<struct<s:int,e:int,v:string>>"


def _bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _parts(array: str) -> str:
    """An array in parts of PART."""
    return f"transform(sequence(0, greatest(size({array}) - 1, 0) div {PART}), c -> slice({array}, c * {PART} + 1, {PART}))"


def _places(kind: Kind) -> Column:
    """All matches of a kind's expression in the column ``text``, with start and end."""
    pattern = kind.pattern.replace("\\", "\\\\").replace("'", "\\'")
    here = "a.pos + length(x.g)"
    add = f"concat(a.found, array(named_struct('s', {here}, 'e', {here} + length(x.m), 'v', x.m)))"
    step = f"if(x.m is null, a, named_struct('pos', {here} + length(x.m), 'found', {add}))"
    none = f"cast(array() as {_SPAN})"
    zipped = f"arrays_zip(split(text, '{pattern}', -1), regexp_extract_all(text, '{pattern}', 0))"
    zipped = f"transform({zipped}, z -> named_struct('g', z['0'], 'm', z['1']))"
    sums = f"transform({_parts('z')}, p -> aggregate(p, named_struct('pos', 0, 'found', {none}), (a, x) -> {step}))"
    starts = "aggregate(l, array(0), (a, x) -> concat(a, array(element_at(a, -1) + x.pos)))"
    moved = "flatten(transform(l, (x, i) -> transform(x.found, y -> named_struct('s', y.s + o[i], 'e', y.e + o[i], 'v', y.v))))"
    return F.expr(f"if({kind.hint}, {_bound(zipped, 'z', _bound(sums, 'l', _bound(starts, 'o', moved)))}, {none})")


def _cut(start: str, end: str) -> str:
    """The text from one place to another, out of ``blocks``."""
    return f"substring(array_join(slice(blocks, ({start}) div {BLOCK} + 1, ({end}) div {BLOCK} - ({start}) div {BLOCK} + 1), ''), ({start}) % {BLOCK} + 1, ({end}) - ({start}))"


def _scored(kind: Kind) -> str:
    """Confirmed places of a kind as spans with a score."""
    near = f"concat({_cut(f'greatest(x.s - {CONTEXT}, 0)', 'x.s')}, ' ', {_cut('x.e', f'x.e + {CONTEXT}')})"
    score = f"round(least(1.0D, {kind.score}D + if(lower({near}) rlike '\\\\b({kind.words})', {CONTEXT_SCORE}D, 0.0D)), 2)"
    spans = f"transform(filter(p_{kind.name}, x -> {kind.confirm}), x -> named_struct('kind', '{kind.name}', 'start', x.s, 'end', x.e, 'value', x.v, 'score', {score}))"
    return spans if kind.base else f"filter({spans}, y -> y.score >= {KEEP}D)"


def _blocks(some: str, text: str) -> Column:
    """The text in blocks of BLOCK code points, where it is needed."""
    return F.expr(f"if({some}, regexp_extract_all({text}, '(?s).{{1,{BLOCK}}}', 0), cast(array() as array<string>))").alias("blocks")


def find(df: DataFrame, text_col: str = "text", into: str = "pii") -> DataFrame:
    """All columns of ``df`` and ``into``: an array of (kind, start, end, value, score).

    Places are in code points, the end exclusive; spans come by kind as in KINDS,
    then by start. Those of base kinds are the leftmost non-overlapping matches
    of their expressions that pass the kind's check, whatever their score; those
    of own kinds also need a score of KEEP. A null or empty text has no span.
    Rows are never joined, dropped or repeated; a column named like ``into`` is
    replaced (``into`` can't be the text's own name). An empty table gives no
    rows.
    """
    if into == text_col:
        raise ValueError("the spans need a column beside the text")
    rest = [c for c in df.columns if c != into]
    kept = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("kept")
    found = df.select(kept, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    found = found.select("kept", "text", *[_places(k).alias(f"p_{k.name}") for k in KINDS])
    some = " + ".join(f"size(p_{k.name})" for k in KINDS)
    found = found.select("kept", *[f"p_{k.name}" for k in KINDS], _blocks(f"{some} > 0", "text"))
    spans = F.expr(f"concat({', '.join(_scored(k) for k in KINDS)})")
    return found.select("kept", spans.alias("spans")).select("kept.*", F.col("spans").alias(into))


def redact(df: DataFrame, text_col: str = "text", into: str = "pii") -> DataFrame:
    """``find`` with every span of the text replaced by its kind in angle brackets; spans that overlap become one.

    Of overlapping spans the one that starts first (then the longer) names the
    replacement; a null text stays null.
    """
    found = find(df, text_col, into)
    names = found.columns
    held = found.select(F.struct(*[F.col(f"`{c}`") for c in names if c != text_col]).alias("kept"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{into}`").alias("spans"))
    order = "array_sort(spans, (l, r) -> case when l.start < r.start then -1 when l.start > r.start then 1 when l.end > r.end then -1 when l.end < r.end then 1 else 0 end)"
    held = held.select("kept", "text", _blocks("size(spans) > 0", "text"), F.expr(order).alias("spans"))
    # where all before a span ends: the furthest end before its part, and in it
    part = _parts("spans")
    before = "aggregate(p, array(0), (a, x) -> concat(a, array(greatest(element_at(a, -1), array_max(x.end)))))"
    step = "named_struct('pos', greatest(a.pos, x.end), 'out', if(x.start >= a.pos, concat(a.out, array(named_struct('from', a.pos, 'to', x.start, 'kind', x.kind))), a.out))"
    empty = "cast(array() as array<struct<from:int,to:int,kind:string>>)"
    gaps = f"flatten(transform(p, (q, i) -> aggregate(q, named_struct('pos', o[i], 'out', {empty}), (a, x) -> {step}, a -> a.out)))"
    gaps = _bound(part, "p", _bound(before, "o", gaps))
    last = "array_max(spans.end)"
    held = held.withColumn("gaps", F.expr(f"if(size(spans) > 0, {gaps}, {empty})"))
    pieces = f"transform(gaps, x -> concat({_cut('x.from', 'x.to')}, '<', x.kind, '>'))"
    tail = _cut(last, "char_length(text)")
    masked = F.expr(f"if(size(spans) = 0 or text is null, text, concat(array_join({pieces}, ''), {tail}))")
    out = held.select("kept", masked.alias("text"))
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"kept.`{c}`").alias(c) for c in names])


def listing(spans: Column, kinds: list[str] | None = None) -> Column:
    """Spans as ``kind:start:end``, comma-joined; only those of ``kinds`` if given."""
    chosen = spans if kinds is None else F.filter(spans, lambda x: x["kind"].isin(kinds))
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
