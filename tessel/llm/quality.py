"""Line-first cleaning with DataFrame functions only.

Each line is judged by punctuation, navigation and boilerplate rules; failing lines go, and a document that loses over
half of its text is rejected. Document measures (words, symbols, repeated lines and three-word windows) are taken on
the whole input text, inside its row: nothing is shuffled.

Defined cases: a null text is empty, has no words and fails; blank lines are kept and count for nothing; repeated rows
are judged alike; an empty table gives an empty result; only doc_id and text are read by `judge`, and `clean` keeps
all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import BLANKS

SYMBOLS = "#*$%&|<>"
#: What separates entries of menus.
SEPARATORS = "|»›•·→"
#: Phrases of boilerplate lines by language; a line of any language is held against all.
BOILERPLATE = {
    "en": ("all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "accept cookies", "subscribe to our newsletter", "sign up for our newsletter", "enable javascript", "skip to content", "share on facebook"),
    "de": ("alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "impressum", "cookies akzeptieren", "newsletter abonnieren", "zum inhalt springen"),
    "fr": ("tous droits réservés", "politique de confidentialité", "mentions légales", "accepter les cookies", "conditions générales", "aller au contenu"),
    "es": ("todos los derechos reservados", "política de privacidad", "términos de uso", "aviso legal", "aceptar cookies", "saltar al contenido"),
}
_ALL = sorted(x for own in BOILERPLATE.values() for x in own)
#: They are looked for in lower-case text, by first letters, as few places of a text have to be tried in full then.
PHRASES = "|".join(f"{first}(?:{'|'.join(x[1:] for x in _ALL if x[0] == first)})" for first in sorted({x[0] for x in _ALL}))
#: A line is boilerplate if such phrases make up this part of it: one in so many characters.
PART = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more: windows are hashed, sorted with their places, and repeated ones' places merged."""

    def covered(places: Column) -> Column:  # sorted starts; each adds the words up to the next start, three at most
        return total(F.transform(places, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - x, F.lit(3)))))

    def repeats(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        places = let(pairs, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: same(s, x, j + 1) | same(s, x, F.greatest(j - 1, F.lit(0)) + F.when(j == 0, F.size(s)).otherwise(0))), lambda x: x["i"])))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(places, covered))

    windows = let(words, lambda w: F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0))))
    return let(windows, repeats)


def phrase_part(low: Column) -> Column:
    """How many characters of a lower-case line are phrases."""
    return F.length(low) - F.length(F.regexp_replace(low, PHRASES, ""))


def fails(line: Column, symbols: Column, phrases: Column) -> Column:
    """A line's verdict; lengths are in characters. phrases: whether the text has any phrase."""
    n = F.length(line)
    punctuation = ((symbols >= 3) & (symbols * 10 >= n)) | ((count_of(line, "!") >= 4) & (count_of(line, "!") * 10 >= n))
    separators = count_of(line, SEPARATORS)
    navigation = (separators >= 3) & (separators * 20 >= n)
    boilerplate = F.when(phrases, let(phrase_part(F.lower(line)), lambda p: (p > 0) & (p * PART >= n))).otherwise(False)
    return punctuation | navigation | boilerplate


def measures(text: Column) -> Column:
    """All measures of a text as one struct."""
    whole = F.coalesce(text, F.lit(""))
    line = lambda x, phrases: let(count_of(x, SYMBOLS), lambda s: F.struct(x.alias("line"), s.alias("symbols"), x.rlike(r"[^\x20\x09-\x0D]").alias("full"), fails(x, s, phrases).alias("fails")))
    lines = let(F.lower(whole).rlike(PHRASES), lambda phrases: F.transform(F.split(whole, "\n"), lambda x: line(x, phrases)))

    def of_lines(ls: Column) -> Column:
        full = F.transform(F.filter(ls, lambda x: x["full"]), lambda x: x["line"])
        size = lambda chosen: total(F.transform(F.filter(ls, chosen), lambda x: F.length(x["line"])))
        return F.struct(
            total(F.transform(ls, lambda x: x["symbols"])).alias("n_symbols"),
            let(full, lambda f: F.size(f) - F.size(F.array_distinct(f))).alias("n_dup_lines"),
            size(lambda x: x["full"]).alias("text_chars"),
            size(lambda x: x["full"] & x["fails"]).alias("lost_chars"),
            F.size(F.filter(ls, lambda x: x["full"] & x["fails"])).alias("lost_lines"),
            F.array_join(F.transform(F.filter(ls, lambda x: ~(x["full"] & x["fails"])), lambda x: x["line"]), "\n").alias("text"),
        )

    of_words = lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeated_words(w).alias("n_repeat_words"))
    return F.struct(let(words_of(whole), of_words).alias("w"), let(lines, of_lines).alias("l"))


def verdicts(q: Column) -> dict[str, Column]:
    """What is asked about a text from its measures q."""
    w, ln = q["w"], q["l"]
    base = (w["n_words"] < 50) | (w["n_repeat_words"] * 100 > w["n_words"] * 50)
    out = {n: w[n].cast("long") for n in ("n_words", "word_chars")} | {n: ln[n].cast("long") for n in ("n_symbols", "n_dup_lines")}
    return out | {"n_repeat_words": w["n_repeat_words"].cast("long"), "base_failed": base, "kept": ~base & (ln["lost_chars"] * 2 <= ln["text_chars"]), "text": ln["text"]}


def once(value: Column) -> Column:
    """The value as a column of its own: what a generator makes isn't computed again in every expression and filter that reads it."""
    return F.explode(F.array(value))


def own_name(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def judge(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", once(measures(F.col("text"))).alias("q"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    found = verdicts(F.col("q"))
    return d.select("doc_id", *(found[n].alias(n) for n in names))


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with failing lines removed and n_chars renewed, in the columns of docs."""
    q = own_name(docs, "q")
    found = verdicts(F.col(q))
    kept = docs.select("*", once(measures(F.col("text"))).alias(q)).where(found["kept"])
    own = {"text": found["text"]} | ({"n_chars": F.length(found["text"]).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return kept.select(*(own.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
