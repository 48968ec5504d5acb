"""Text rules as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from silt.functions import words as W


def _in(word: Column, listed: list[str]) -> Column:
    return F.array_contains(F.array(*[F.lit(w) for w in listed]), word)


def split_words(text: Column) -> Column:
    """Words between whitespace, empties dropped."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def trim_chars(word: Column, chars: str) -> Column:
    """A word without these characters at its ends."""
    return F.btrim(word, F.lit(chars))


def normalised_words(text: Column) -> Column:
    """Lower-cased words with edge punctuation trimmed."""
    return F.filter(F.transform(split_words(text), lambda w: F.lower(trim_chars(w, W.EDGE))), lambda w: w != "")


def normalised(text: Column) -> Column:
    """One claim's text without the ways of typing it."""
    return F.array_join(normalised_words(text), " ")


def content_hash(text: Column) -> Column:
    """SHA-256 of the normalised text."""
    return F.sha2(normalised(text), 256)


def search_stem(word: Column) -> Column:
    """The first of ing, ed, es, s cut off a long enough word that does not end in ss."""
    out = word
    for suffix in ("s", "es", "ed", "ing"):
        fits = (F.length(word) > len(suffix) + 2) & word.endswith(suffix) & ~word.endswith("ss")
        out = F.when(fits, F.substr(word, F.lit(1), F.length(word) - len(suffix))).otherwise(out)
    return out


def claim_stem(word: Column) -> Column:
    """Like ``search_stem`` without the ss rule; then a doubled last letter becomes one."""
    cut = word
    for suffix in ("s", "es", "ed", "ing"):
        fits = (F.length(word) > len(suffix) + 2) & word.endswith(suffix)
        cut = F.when(fits, F.substr(word, F.lit(1), F.length(word) - len(suffix))).otherwise(cut)
    return F.regexp_replace(cut, r"^(.*)(.)\2$", "$1$2")


def negates(word: Column) -> Column:
    """Whether one normalised word negates."""
    bare = F.regexp_replace(word, r"^[^\p{L}\p{N}'’]+|[^\p{L}\p{N}'’]+$", "")
    return _in(bare, W.NEGATORS + W.CONTRACTED) | bare.endswith("n't") | bare.endswith("n’t")


def negative(text: Column) -> Column:
    """Whether a claim is negated anywhere."""
    return F.exists(normalised_words(text), negates)


def content_words(text: Column) -> Column:
    """What a claim is about: words less grammar and negators, stemmed, distinct in order."""
    kept = F.filter(normalised_words(text), lambda w: ~_in(w, W.GRAMMAR) & ~negates(w))
    return F.array_distinct(F.filter(F.transform(kept, claim_stem), lambda w: w != ""))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard overlap of two word sets; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def overlaps_enough(a: Column, b: Column) -> Column:
    """Overlap of three fifths or more, in whole numbers."""
    shared = F.size(F.array_intersect(a, b))
    return (F.size(a) > 0) & (F.size(b) > 0) & (5 * shared >= 3 * (F.size(a) + F.size(b) - shared))


def substituted(a: Column, b: Column) -> Column:
    """Whether each side has a content word the other lacks."""
    return (F.size(F.array_except(a, b)) > 0) & (F.size(F.array_except(b, a)) > 0)


def _claim_word(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}/._]+|[^\p{L}\p{N}/._]+$", ""))


def _without_openers(held: Column) -> Column:
    first = F.array_position(F.transform(held, lambda w: ~_in(w, W.OPENERS)), F.lit(True)).cast("int")
    return F.when(first == 0, F.array().cast("array<string>")).otherwise(F.slice(held, F.greatest(first, F.lit(1)), F.size(held)))


def lead(text: Column) -> Column:
    """A claim's two opening words, markers that open a turn dropped."""
    held = F.filter(F.transform(split_words(text), _claim_word), lambda w: w != "")
    return F.array_join(F.slice(_without_openers(held), 1, 2), " ")


def clause(text: Column) -> Column:
    """Words of the first clause: a comma or semicolon after the claim's first two words ends it."""
    raw = F.filter(F.transform(split_words(text), lambda w: F.struct(_claim_word(w).alias("w"), w.rlike("[,;]$").alias("stop"))), lambda x: x["w"] != "")
    first = F.array_position(F.transform(raw, lambda x: ~_in(x["w"], W.OPENERS)), F.lit(True)).cast("int")
    held = F.when(first == 0, F.slice(raw, 1, 0)).otherwise(F.slice(raw, F.greatest(first, F.lit(1)), F.size(raw)))
    stop = F.array_position(F.transform(held, lambda x, i: x["stop"] & (i >= 2)), F.lit(True)).cast("int")
    return F.transform(F.when(stop > 0, F.slice(held, 1, F.greatest(stop, F.lit(1)))).otherwise(held), lambda x: x["w"])


def _common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y)
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first == 0, n).otherwise(first - 1)


def revises(before: Column, after: Column) -> Column:
    """Whether a clause (words) changes only the value of another: same opening, differing middle."""
    shared = _common_prefix(before, after)
    rest_a, rest_b = F.slice(before, shared + 1, F.size(before)), F.slice(after, shared + 1, F.size(after))
    ending = _common_prefix(F.reverse(rest_a), F.reverse(rest_b))
    mid_a, mid_b = F.size(rest_a) - ending, F.size(rest_b) - ending
    opening = (F.size(before) >= 2) & (F.size(after) >= 2) & (shared >= 2) & ((shared + ending) * 2 >= F.least(F.size(before), F.size(after)))
    one_sided = F.when((mid_a == 0) | (mid_b == 0), F.greatest(mid_a, mid_b) <= 3).otherwise((mid_a <= 2) & (mid_b <= 2))
    return opening & ~((mid_a == 0) & (mid_b == 0)) & one_sided


def announces_change(text: Column) -> Column:
    """Whether a sentence announces a replacement that nothing in the three words before denies."""
    held = F.filter(F.transform(split_words(text), lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}']+|[^\p{L}\p{N}']+$", ""))), lambda w: w != "")
    joined = F.concat(F.lit(" "), F.array_join(held, "  "), F.lit(" "))  # doubled spaces let neighbours share none
    denied = "|".join(W.CHANGE_DENIED)
    markers = "|".join(m.replace(" ", "  ") for m in W.CHANGE_MARKERS)
    free = rf"(?<! (?:{denied}) )(?<! (?:{denied})  [^ ]{{1,40}} )(?<! (?:{denied})  [^ ]{{1,40}}  [^ ]{{1,40}} )"
    return joined.rlike(rf"{free} (?:{markers}) ") | joined.rlike(rf"{free} now (?! that )")


def query_shape(text: Column) -> Column:
    """What kind of question a query is: the first shape with a marker in it, else plain."""
    padded = F.concat(F.lit(" "), F.lower(F.trim(text)), F.lit(" "))
    out = F.lit("plain")
    for shape, markers in reversed(W.SHAPES.items()):
        out = F.when(reduce(lambda x, y: x | y, [F.contains(padded, F.lit(m)) for m in markers]), shape).otherwise(out)
    return out


def looks_like_injection(text: Column) -> Column:
    """Whether content reads like an instruction or pipes the network into a shell."""
    low = F.lower(text)
    has = lambda part: F.contains(low, F.lit(part))
    fetched = (has("curl") | has("wget")) & (has("| sh") | has("|sh"))
    return reduce(lambda x, y: x | y, [has(p) for p in W.DIRECTIVES + W.EXECUTABLE]) | fetched


def looks_like_secret(text: Column) -> Column:
    """Whether a text is probably a credential: a marker, or a key-shaped run after a prefix's first occurrence."""
    marked = [F.contains(text, F.lit(m)) for m in W.SECRET_MARKERS]
    for prefix in W.SECRET_PREFIXES:
        at = F.locate(prefix, text)
        marked.append((at > 0) & F.substr(text, at + len(prefix)).rlike("^[A-Za-z0-9_-]{16}"))
    return reduce(lambda x, y: x | y, marked)


def chosen(sentence: Column) -> Column:
    """Whether a sentence states a choice that no negation in the twelve characters before takes back."""
    low = F.replace(F.lower(sentence), F.lit("’"), F.lit("'"))
    hits = []
    for phrase in W.CHOICES:
        parts = F.split(low, phrase, -1)
        ends = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.right(p, F.lit(12)))
        hits.append((F.size(parts) > 1) & F.exists(ends, lambda e: ~e.rlike("not|n't|never|no ")))
    return reduce(lambda x, y: x | y, hits)


def first_sentence(text: Column) -> Column:
    """Up to a line end, ! or ?, or a full stop before whitespace or the end."""
    return F.trim(F.element_at(F.split(text, r"[\n!?]|\.(?=\s|$)", 2), 1))


def correction(text: Column) -> Column:
    """The claim that replaces what just happened, or null: a leading marker, its claim of eight bytes or more."""
    throat = "|".join(W.THROAT)
    # a cleared word is a whole word, whatever punctuation ends it
    rest = F.regexp_replace(F.ltrim(text), rf"(?i)^(?:(?:{throat})(?=[,.!?;:]*(?:\s|$))[,.!?;: \t]*)+", "")
    low, out = F.lower(rest), F.lit(None).cast("string")
    for opener in reversed(W.CORRECTION_OPENERS):
        claim = first_sentence(rest if opener in W.SAID_WITH else F.ltrim(F.substr(rest, F.lit(len(opener) + 1))))
        out = F.when(low.startswith(opener), claim).otherwise(out)
    return F.when(F.octet_length(out) >= 8, out)


def single_valued(predicate: Column) -> Column:
    """Whether a predicate names one current answer."""
    word = F.lower(F.trim(predicate))
    plural = word.endswith("s") & ~word.endswith("ss") & (F.octet_length(word) > 3)
    return F.when(_in(word, W.MANY_VALUED), False).when(_in(word, W.ONE_VALUED), True).otherwise(~plural)


def distinctive(text: Column) -> Column:
    """Distinct, sorted words of three bytes or more that tell memories apart."""
    parts = F.array_distinct(F.split(text, r"[^\p{L}\p{N}\-_./]+"))
    kept = F.filter(parts, lambda w: F.octet_length(w) > 2)
    return F.array_sort(F.array_except(F.transform(kept, F.lower), F.array(*[F.lit(w) for w in W.NOISE])))


def line_words(text: Column) -> Column:
    """A line's distinct, sorted words: letters, digits, _ - and / only."""
    bare = F.transform(split_words(text), lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}_\-/]", "")))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda w: w != "")))


def near_duplicate(a: Column, b: Column, a_text: Column, b_text: Column, threshold: float = 0.8) -> Column:
    """Whether two lines (their words and texts) say the same: enough shared, one polarity, no telling word on one side."""
    shared = F.size(F.array_intersect(a, b))
    telling = lambda x, y: F.exists(F.array_except(x, y), lambda w: w.rlike("[0-9/._]"))
    return (F.size(a) > 0) & (F.size(b) > 0) & (negative(a_text) == negative(b_text)) & (shared / F.least(F.size(a), F.size(b)) >= threshold) & ~telling(a, b) & ~telling(b, a)


def terms_of(query: Column) -> Column:
    """The distinct words a query asks about."""
    bare = F.transform(split_words(query), lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}./_\-]", "")))
    return F.array_distinct(F.filter(bare, lambda w: (w != "") & ~_in(w, W.STOPWORDS)))


def held_words(text: Column) -> Column:
    """The distinct stemmed words that a text holds, joined by spaces."""
    bare = F.transform(F.array_distinct(split_words(text)), lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}./_\-]", "")))
    held = F.transform(F.array_distinct(bare), search_stem)  # a step of its own: the stem looks at its word many times
    return F.array_join(F.array_distinct(F.filter(held, lambda w: w != "")), " ")


def covered(stems: Column, held: Column) -> Column:
    """The share of stems (without spaces) that a word of ``held_words`` is or holds; 1 if there are none."""
    hit = F.filter(stems, lambda t: F.contains(held, t))
    return F.when(F.size(stems) == 0, 1.0).otherwise(F.size(hit) / F.size(stems))


def tokens(text: Column) -> Column:
    """Roughly how many tokens: a quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def squash(text: Column) -> Column:
    """A third and further repeat of a character dropped."""
    return F.regexp_replace(text, r"(.)\1{2,}", "$1$1")


def command_head(command: Column) -> Column:
    """The program a command runs, past assignments and wrappers."""
    kept = F.filter(split_words(command), lambda w: ~F.contains(w, F.lit("=")) & ~_in(w, W.WRAPPERS))
    return F.when(F.size(kept) == 0, "").otherwise(F.substring_index(F.get(kept, F.lit(0)), "/", -1))


def related_commands(a: Column, b: Column) -> Column:
    """Whether two commands attempt the same thing: one program, or two builders."""
    x, y = command_head(a), command_head(b)
    return (x == y) | (_in(x, W.BUILDERS) & _in(y, W.BUILDERS))


def substantial(text: Column) -> Column:
    """Whether a recurring text has two content words beyond acknowledgement."""
    return F.size(F.filter(content_words(text), lambda w: ~_in(w, W.ACKNOWLEDGING))) >= 2


def quoted_commands(text: Column) -> Column:
    """Spans between backticks of more than two characters."""
    return F.filter(F.regexp_extract_all(text, F.lit("`([^`]+)`"), F.lit(1)), lambda s: F.length(s) > 2)


def fit(text: Column, limit: int) -> Column:
    """A line cut to ``limit`` bytes at a word boundary with an ellipsis; null where it doesn't fit and under 24 bytes are allowed.

    Characters of one to four bytes: of those that could fit, as many are kept as
    do, counted from the front.
    """
    whole = F.octet_length(text) <= limit
    if limit < 24:
        return F.when(whole, text)
    room = limit - 3  # the ellipsis takes three bytes
    head = F.substr(text, F.lit(1), F.lit(room))
    # the longest start of at most that many bytes: its characters' number is where the running bytes pass it
    fitting = F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(head), F.lit(1))), lambda i: F.octet_length(F.substr(head, F.lit(1), i)) <= room)
    cut = F.substr(text, F.lit(1), F.size(fitting))
    word = F.regexp_replace(cut, r"\s+\S*$", "")
    return F.when(whole, text).otherwise(F.concat(F.rtrim(word), F.lit("…")))
