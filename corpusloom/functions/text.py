"""Column functions on text: pieces, runs, classes, continuation marks. All of them stay in the JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, including U+001C to U+001F.
WHITE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
SEP = "@@"


@dataclass(frozen=True)
class ScriptProfile:
    """The core script: a character class for regular expressions, and its code points for the vocabulary's characters."""

    name: str
    chars: str
    first: int
    last: int


TELUGU = ScriptProfile("telugu", "ఀ-౿", 0x0C00, 0x0C7F)
LATIN = ScriptProfile("latin_letters", "A-Za-zÀ-ɏ", 0x41, 0x24F)


def pieces(text: Column) -> Column:
    """Whitespace-separated pieces; null for null, none for a blank text."""
    return F.filter(F.split(text, WHITE), lambda x: x != "")


def core_words(text: Column, profile: ScriptProfile = TELUGU) -> Column:
    """Maximal runs of core letters, wherever they stand."""
    return F.regexp_extract_all(text, F.lit(f"([{profile.chars}]+)"), F.lit(1))


def runs(piece: Column, profile: ScriptProfile = TELUGU) -> Column:
    """Alternating maximal runs of core and other characters."""
    return F.regexp_extract_all(piece, F.lit(f"([{profile.chars}]+|[^{profile.chars}]+)"), F.lit(1))


def let(value: Column, then) -> Column:
    """then(value) with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def has_core(piece: Column, profile: ScriptProfile = TELUGU) -> Column:
    return piece.rlike(f"[{profile.chars}]")


def token_class(piece: Column, profile: ScriptProfile = TELUGU) -> Column:
    """pure: core letters only; mixed: some; other: none."""
    return F.when(piece.rlike(f"^[{profile.chars}]+$"), "pure").when(has_core(piece, profile), "mixed").otherwise("other")


def marked(parts: Column, sep: str = SEP, always: bool = False) -> Column:
    """All parts but the last with the continuation mark, unless they end in it; always: also if they do."""
    add = lambda x: F.concat(x, F.lit(sep))
    head = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), add if always else lambda x: F.when(F.endswith(x, F.lit(sep)), x).otherwise(add(x)))
    return F.concat(head, F.slice(parts, -1, 1))


def is_continued(token: Column, sep: str = SEP) -> Column:
    return F.endswith(token, F.lit(sep))


def base_form(token: Column, sep: str = SEP) -> Column:
    """The token without its mark."""
    return F.when(is_continued(token, sep), F.substring(token, F.lit(1), F.length(token) - len(sep))).otherwise(token)


def joined(tokens: Column, sep: str = SEP, strip_rest: bool = False) -> Column:
    """Text of tokens: a mark before a blank glues; with strip_rest marks that are left over go, too."""
    s = F.replace(F.array_join(tokens, " "), F.lit(sep + " "), F.lit(""))
    return F.replace(s, F.lit(sep), F.lit("")) if strip_rest else s


def split_after(word: Column, least: int, head: int) -> Column:
    """A deterministic segmenter: words of at least so many letters are split after the head."""
    return F.when(F.length(word) >= least, F.array(F.substring(word, 1, head), F.substring(word, F.lit(head + 1), F.length(word)))).otherwise(F.array(word))


def segmented(text: Column, segment, profile: ScriptProfile = TELUGU, sep: str = SEP, split_mixed: bool = True, always: bool = False) -> Column:
    """Tokens of a text: core words in segments, mixed pieces cut into runs, continuation marks on all but each piece's last part.

    segment maps a column of a core word to an array of its parts. Without split_mixed only pure pieces are segmented. always: see marked.
    """

    def one(p: Column) -> Column:
        if not split_mixed:
            return F.when(p.rlike(f"^[{profile.chars}]+$"), let(segment(p), lambda x: marked(x, sep, always))).otherwise(F.array(p))
        parts = F.flatten(F.transform(runs(p, profile), lambda r: F.when(has_core(r, profile), segment(r)).otherwise(F.array(r))))
        return F.when(has_core(p, profile), let(parts, lambda x: marked(x, sep, always))).otherwise(F.array(p))

    return F.flatten(F.transform(pieces(text), one))


def characters(profile: ScriptProfile = TELUGU) -> list[str]:
    """The vocabulary's fallback characters: printable ASCII, the script's block, and these symbols (fixed values)."""
    symbols = "–—‘’“”…•·€₹°±×÷"
    return [*map(chr, range(32, 127)), *map(chr, range(profile.first, profile.last + 1)), *symbols]


def dampened(count: Column, how: str) -> Column:
    """log: round(log2(n + 1)) to even; ones: 1; none: n."""
    return {"log": F.bround(F.log2(count + 1)).cast("bigint"), "ones": F.lit(1).cast("bigint"), "none": count}[how]
