"""One consistent form for words that look the same (problem 6).

Look-alikes are mapped by a word's own characters: presentation and full-width forms become ordinary ones, and letters that belong to another script than
the rest of the word become those that they look like. The mapped words of all texts are grouped under the UNICODE collation, which makes composed and
decomposed letters equal and ignores invisible characters; the class's most frequent usual spelling replaces the others. Differences that a reader can
see stay: joiners after a virama, symbols such as a lone Greek letter, typographic quotes and dashes, composed accents. `fold` gives one word's form
without the collection, for operators that compare words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITE
from ..plans.tables import cut, join_counted
from .arrow import slices

# Unicode code points.
VIRAMAS = "\u094d\u09cd\u0a4d\u0acd\u0b4d\u0bcd\u0c4d\u0ccd\u0d4d"
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u3164\ufeff"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
LINE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u2028\u2029"
# Letters that look like Latin letters, each followed by its look-alike.
CYRILLIC = "АAВBЕEЅSІIЈJКKМMНHОOРPСCТTУYХXЬbҮYӀIԌGԚQԜWѴVаaгrеeоoрpсcуyхxѕsіiїïјjѵvһhҽeүyӏlԁdԛqԝwкk"
GREEK = "ΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧXαaγyιiκkνvοoρpσoυuχxϒYϜFϲcϳjϹCϺM"
ARMENIAN = "ՍUՏSՕOաwզqհhոnռnսuցgքfօo"
CHEROKEE = "ᎠDᎡRᎢTᎥiᎩYᎪAᎫJᎬEᎳWᎷMᎻHᎽYᏀGᏂhᏃZᏏbᏒRᏔWᏕSᏙVᏚSᏞLᏟCᏢPᏦKᏧdᏳGᏴB"
COPTIC = "ⲎHⲒIⲔKⲘMⲚNⲞOⲟoⲢPⲣpⲤCⲥcⲦTⲨYⲬXⳐL"
_LATIN = CYRILLIC + GREEK + ARMENIAN + CHEROKEE + COPTIC
LATIN_OF = {ord(a): b for a, b in zip(_LATIN[::2], _LATIN[1::2])}
# Malayalam letters that look like Tamil ones, and Gujarati and Gurmukhi signs and digits that look like Devanagari ones.
TAMIL_OF = {ord(a): b for a, b in ("ഉஉ", "ജஜ", "ണண", "ഴழ", "ശஶ", "ിி", "൦௦")}
DEVANAGARI_OF = {ord(a): b for a, b in ("ਂं", "ઁँ", "ંं", "ઃः", "઼़", "ઽऽ", "ુु", "ૂू", "્्", "੍्", "੦०", "૦०", "૨२", "૩३", "૪४", "૮८")}
#: Telugu and Kannada have the same letters at the same places of neighbouring blocks.
KANNADA_OF = {c: c + 0x80 for c in range(0x0C00, 0x0C80)}
TELUGU_OF = {c + 0x80: c for c in range(0x0C00, 0x0C80)}

PRESENTATION = "\ufb00-\ufb4f\ufb50-\ufdff\ufe30-\ufe4f\ufe70-\ufefc\uff01-\uffee\U0001d400-\U0001d7ff"
#: Characters that a word must have for its folded form to differ from it. The same class is used in Java's expressions.
_FOREIGN = "\u0370-\u058f\u13a0-\u13ff\u1f00-\u1fff\u2c80-\u2cff"
_ANY = "\u0300-\u036f\u0a02\u0a4d\u0a66\u0a80-\u0aff\u0d00-\u0d7f\u200c\u200d" + _FOREIGN + PRESENTATION + INVISIBLE
_COMPOSING = "\u093c\u0958-\u095f\u09bc\u09be\u09d7\u09dc-\u09df\u0a33\u0a36\u0a3c\u0a59-\u0a5e\u0b3c\u0b3e\u0b56\u0b57\u0b5c\u0b5d\u0b94\u0bbe\u0bd7\u0c56\u0cc2\u0cd5\u0cd6\u0d3e\u0d57\u212a\u212b\u2126\u0344\u0387"
SUSPECT = f"[{_ANY}{_COMPOSING}]|[\u0c00-\u0c7f][^{LINE_SPACE}{SPACES}]*?[\u0c80-\u0cff]|[\u0c80-\u0cff][^{LINE_SPACE}{SPACES}]*?[\u0c00-\u0c7f]"
ODD_SPACE = f"[{SPACES}]"
#: Parts into which the rows of a hot key are split.
SALTS = 16

_suspect = re.compile(SUSPECT)
_presentation = re.compile(f"[{PRESENTATION}]")
_loose_joiner = re.compile(f"(?<![{VIRAMAS}])[\u200c\u200d]+")
_gone = {ord(c): None for c in INVISIBLE}
_latin = re.compile("[A-Za-z\u00c0-\u024f\u1e00-\u1eff]")
_foreign = re.compile(f"[{_FOREIGN}]")
_fillers = {ord(c): None for c in "\u115f\u1160\u3164"}  # invisible, but the collation heeds them
_joiner = re.compile(f"(?<=[{VIRAMAS}])[\u200c\u200d]+")
_tamil, _devanagari = re.compile("[\u0b80-\u0bff]"), re.compile("[\u0900-\u097f]")
_telugu, _kannada = re.compile("[\u0c00-\u0c7f]"), re.compile("[\u0c80-\u0cff]")


def _ordinary(word: str) -> str:
    """Full-width and presentation forms as ordinary letters."""
    return _presentation.sub(lambda m: unicodedata.normalize("NFKC", m[0]), word)


def _alike(s: str) -> list[str]:
    """The word with letters of other scripts as their look-alikes in its own: one form, or two where Telugu and Kannada letters are as many."""
    if other := _foreign.findall(s):
        alike = [c for c in other if ord(c) in LATIN_OF]
        if _latin.search(s) or len(other) > 1 and len(alike) == len(other):
            s = s.translate(LATIN_OF)
    if _tamil.search(s):
        s = s.translate(TAMIL_OF)
    if _devanagari.search(s):
        s = s.translate(DEVANAGARI_OF)
    if t := len(_telugu.findall(s)):
        if k := len(_kannada.findall(s)):
            both = [s.translate(TELUGU_OF), s.translate(KANNADA_OF)]
            return both if t == k else both[:1] if t > k else both[1:]
    return [s]


def _usual(s: str) -> str:
    """The word in NFC without invisible characters; joiners stay after a virama."""
    return unicodedata.normalize("NFC", _loose_joiner.sub("", s.translate(_gone)))


def fold(word: str) -> str:
    """The word in its consistent form by its own characters. Empty for a word of invisible characters only; the same for a word without variants."""
    if not _suspect.search(word):
        return word
    return unicodedata.normalize("NFC", _alike(_usual(_ordinary(word)))[0])


def classes_of(word: str) -> list[tuple[str, str]] | None:
    """(key, form) for each class that a word with a suspect character may belong to; None for others.

    The key has look-alikes mapped and nothing else: canonical equivalence and invisible characters are left to the collation, which ignores joiners, too;
    as a joiner after a virama can be seen, a private character stands for it. The form is the class's usual spelling if no text has one.
    """
    if not _suspect.search(word):
        return None
    mark = lambda m: m[0].replace("\u200c", "\ue00c").replace("\u200d", "\ue00d")
    return [(_joiner.sub(mark, a.translate(_fillers)), _usual(a)) for a in _alike(_ordinary(word))]


_EDGE = {c: None for c in range(0x20000) if unicodedata.category(chr(c))[0] in "PS"}


def compare_key(piece: str) -> str:
    """What two words are compared by: the folded word in lower case without punctuation; may be empty."""
    return fold(piece).lower().translate(_EDGE)


class Keys(dict):
    """A bounded memory of a function of words: most words of a text have been seen before."""

    def __init__(self, of, most: int = 300_000):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        self[word] = x = self.of(word)
        return x


suspects = Keys(classes_of)
_odd_space = re.compile(ODD_SPACE)
#: Words after which a task hands over its counts: bounds its memory, not the result.
WORDS = 300_000


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        rows = []
        for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
            if t:
                rows += [(i, w) for w in {w for w in t.split() if suspects[w]}]
                if _odd_space.search(t):
                    rows.append((i, None))
        c = list(zip(*rows)) or [[]] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.string())], ["id", "value"])


def suspect_values(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, value): the distinct words of each document that hold a suspect character, and a null for odd spaces."""
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(lambda it: _values(it), "id bigint, value string")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, key, form, n) of the words of a task; a word without suspect characters has itself as key and form."""
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        rows = [(w, k, f, n) for w, n in seen.items() for k, f in suspects[w] or ((w, w),)]
        c = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in c[:3]), pa.array(c[3], pa.int64())], ["value", "key", "form", "n"])

    for b in slices(batches):
        for t in b.column("text").to_pylist():
            if t:
                seen.update(t.split())
        if len(seen) > WORDS:
            yield out()
            seen.clear()
    yield out()


def canonical_values(docs: DataFrame, text: str = "text") -> DataFrame:
    """(value, canonical, n) of every distinct word that isn't a usual spelling, with its number of occurrences.

    All words of the texts, their look-alikes mapped, are grouped under Spark's UNICODE collation, which heeds accents and case, holds canonically equivalent
    strings equal and ignores invisible characters. Members of a class that are written in the usual way are candidates for its canonical member: the
    most frequent one is taken, ties go by code points. The usual form of a variant is a candidate of no occurrence, so there is one in each class. A word
    that may belong to two classes goes to the one whose canonical member is more frequent, else to the first. A document without text, or none at all, adds
    no word. Words are counted in the tasks, so a frequent word is no hot key.
    """
    words = docs.select(F.col(text).alias("text")).mapInArrow(lambda it: _words(it), "value string, key string, form string, n bigint")
    return docs.sparkSession.sql(
        """
        WITH words AS (SELECT value, key, form, sum(n) AS n FROM {words} GROUP BY value, key, form),
        members AS (
          SELECT key, value AS member, n, CAST(NULL AS STRUCT<value: STRING, n: BIGINT>) AS variant FROM words WHERE value = form
          UNION ALL SELECT key, form, 0, struct(value, n) FROM words WHERE value <> form),
        classes AS (
          SELECT min_by(member, struct(-n, member)) AS canonical, max(n) AS top, collect_set(variant) AS variants
          FROM members GROUP BY collate(key, 'UNICODE') HAVING count(variant) > 0)
        SELECT v.value, min_by(canonical, struct(-top, canonical)) AS canonical, max(v.n) AS n FROM classes LATERAL VIEW explode(variants) AS v GROUP BY v.value""",
        words=words,
    )


def salted(rows: DataFrame, id: str = "id") -> DataFrame:
    """The rows with a salt by their id, so that a hot key beside it is spread over SALTS tasks."""
    return rows.withColumn("salt", F.pmod(F.xxhash64(id), F.lit(SALTS)).cast("int"))


def repeated(rows: DataFrame) -> DataFrame:
    """The rows once for each salt: the other side of a join with salted rows."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def variant_documents(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The ids of the documents that hold a variant: a word other than its canonical form, or a space other than U+0020.

    Null, empty and blank texts hold no words; blank ones may hold a space that counts. A repeated id is given once.
    """
    found = cut(suspect_values(docs, id, text))
    by_word = join_counted(found, cut(canonical_values(docs, text)), ["value"], "n", "inner").select(F.col("id").alias(id))
    return by_word.unionByName(found.where("value is null").select(F.col("id").alias(id))).distinct()


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with a flag: whether the text holds a suspect word or an odd space."""
    for b in slices(batches):
        odd = [bool(t) and (any(map(suspects.__getitem__, t.split())) or _odd_space.search(t) is not None) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text"), pa.array(odd, pa.bool_())], ["id", "text", "odd"])


def canonical_texts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text): every document with its text in the consistent form; ordinary spaces and line breaks stay as they are, null stays null.

    Texts without a suspect character pass through without a shuffle. For the others each piece is replaced by its canonical form. Ids may be null or
    repeated: replacements are joined back by a hash of id and text. Rows that share one share their replacements, which depend on the word alone.
    """
    t = F.col("text")
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(lambda it: _flagged(it), "id bigint, text string, odd boolean")
    some = rows.where("odd").select(F.xxhash64("id", "text").alias("key"), "id", "text")
    words = cut(suspect_values(some, "key", "text"))
    found = join_counted(words, cut(canonical_values(rows)), ["value"], "n", "inner").groupBy(F.col("id").alias("key")).agg(F.map_from_entries(F.collect_set(F.struct("value", "canonical"))).alias("_new"))
    parts = F.regexp_extract_all(t, F.lit(f"({WHITE}|{'[^' + WHITE[1:]})"), F.lit(1))
    replaced = F.when(F.col("_new").isNull(), t).otherwise(F.array_join(F.transform(parts, lambda p: F.coalesce(F.element_at("_new", p), p)), ""))
    done = some.join(found, "key", "left").select("id", F.translate(replaced, SPACES, " " * len(SPACES)).alias("text"))
    return rows.where("NOT odd").select("id", "text").unionByName(done).toDF(id, text)
