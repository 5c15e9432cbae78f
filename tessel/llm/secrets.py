"""Secret scans with DataFrame functions only: fixed patterns, and a battery of randomness tests for other tokens.

A pattern's spans come from its matches and the pieces between them. Further long tokens with two of lower case, upper case and
digits are tested for being random. Their encoding's alphabet is inferred; two chi-squared tests (each symbol alike; groups of
symbols, with those letters apart that are common in words), a runs test of kinds of characters and a lag-one serial correlation give
p-values of "random". Per document, a false-discovery control with weights by length picks the tokens that are not random
(identifiers, paths, words); the others are reported as `random` spans. The values of the patterns' spans are tested as well; their
p-values are reported, and the spans stay whatever they are.

Defined cases: a null text is empty; repeated rows are scanned alike; an empty table gives an empty result; only doc_id
and text are read by `scan`, and `redact` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.quality import let, once, own_name, total

#: Kinds in the order they are listed, their patterns, the group whose length counts and its least length. Runs of
#: one class are matched whole, so the last two can ask for their least length in the pattern.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
TOKEN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
#: Tokens of mixed case are tested from this length on; in shorter ones words and keys can't be told apart.
MIXED = 20
BLOCK = 256
CHUNK = 4096


def running(values: Column, plus: Callable[[Column, Column], Column] = lambda a, x: a + x) -> Column:
    """Sums (or the like, of numbers from zero) of what stands before each value; blocks keep it far from quadratic."""

    def simple(xs: Column) -> Column:
        zero = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("before"))
        return F.aggregate(xs, zero, lambda a, x: F.struct(plus(a["sum"], x).alias("sum"), F.concat(a["before"], F.array(a["sum"])).alias("before")))

    def by_block(vs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / BLOCK).cast("int")), lambda j: simple(F.slice(vs, j * BLOCK + 1, F.lit(BLOCK))))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, simple(F.transform(bs, lambda b: b["sum"]))["before"], lambda b, at: F.transform(b["before"], lambda x: plus(at, x)))))

    return let(values, lambda vs: F.when(F.size(vs) > 0, by_block(vs)).otherwise(F.array().cast("array<int>")))


SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def spans_of(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """array of (start, kind, end, value) of the pattern's leftmost non-overlapping matches."""
    p = F.lit(pattern)
    whole = F.transform(F.regexp_extract_all(text, p, F.lit(0)), F.length)
    value = F.regexp_extract_all(text, p, F.lit(group))
    before = F.transform(F.split(text, pattern, -1), F.length)

    def placed(w: Column) -> Column:
        starts = let(before, lambda b: running(F.zip_with(F.slice(b, 1, F.size(w)), F.concat(F.array(F.lit(0)), F.slice(w, 1, F.size(w) - 1)), lambda x, y: x + y)))
        # a match starts after all pieces up to its own and all matches before it
        at = let(starts, lambda s: F.transform(s, lambda x, i: x + F.get(before, i) + F.when(i > 0, F.get(w, i - 1)).otherwise(0)))
        return F.transform(F.filter(F.arrays_zip(at.alias("at"), w.alias("w"), value.alias("v")), lambda m: F.length(m["v"]) >= least), lambda m: F.struct(m["at"].alias("start"), F.lit(kind).alias("kind"), (m["at"] + m["w"]).alias("end"), m["v"].alias("value")))

    return F.when(text.rlike(pattern), let(whole, placed)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> list[Column]:
    return [spans_of(text, *v, i) for i, v in enumerate(KINDS.values())]


def blanked(text: Column, pattern: str, group: int, least: int) -> Column:
    """The text with blanks for the pattern's spans."""
    p = F.lit(pattern)
    found = F.arrays_zip(F.regexp_extract_all(text, p, F.lit(0)).alias("w"), F.regexp_extract_all(text, p, F.lit(group)).alias("v"))
    left = F.transform(found, lambda m: F.when(F.length(m["v"]) >= least, F.repeat(F.lit(" "), F.length(m["w"]))).otherwise(m["w"]))
    return F.when(text.rlike(pattern), F.array_join(F.zip_with(F.split(text, pattern, -1), left, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(text)


def tail(z: Column) -> Column:
    """Two-sided p-value of a standard normal, by the logistic approximation."""
    x = F.least(F.abs(z), F.lit(30.0))
    return 2 / (1 + F.exp(1.5976 * x + 0.07056 * F.pow(x, F.lit(3))))


def chi_tail(x: Column, df: Column) -> Column:
    """p-value of a chi-squared value, by the cube root's normal approximation; only an excess counts."""
    z = (F.pow(F.greatest(x, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    return F.when(z > 0, tail(z) / 2).otherwise(F.lit(1.0))


#: Letters that make up most of words in the languages of Latin script.
COMMON = "aeinorst"
#: By size of alphabet: (symbols in groups for the chi-squared test, symbols by kind of character for the runs test). Groups are:
#: common letters, other lower case, other upper case, the rest; of hex digits four runs of four. Kinds are lower case, upper case, digits,
#: the rest; single-case alphabets have letters as the first group and kind.
ALPHABETS = {
    16: ((4, 4, 4, 4), (6, 0, 10, 0)),
    32: ((8, 18, 0, 6), (26, 0, 6, 0)),
    36: ((8, 18, 0, 10), (26, 0, 10, 0)),
    52: ((16, 18, 18, 0), (26, 26, 0, 0)),
    62: ((16, 18, 18, 10), (26, 26, 10, 0)),
    64: ((16, 18, 18, 12), (26, 26, 10, 2)),
}


def alphabets() -> Column:
    """ALPHABETS with what the tests need of each: its size, groups' shares and their number less one, sums of squares and cubes of kinds' shares."""
    rows = []
    for size, (groups, kinds) in ALPHABETS.items():
        second, third = (sum((x / size) ** e for x in kinds) for e in (2, 3))
        values = {"size": float(size), **{f"g{i}": g / size for i, g in enumerate(groups)}, "df": float(sum(g > 0 for g in groups) - 1), "second": second, "third": third}
        rows.append(F.struct(*(F.lit(v).alias(n) for n, v in values.items())))
    return F.array(*rows)


def kind_of(c: Column) -> Column:
    return F.when((c >= 97) & (c <= 122), 0).when((c >= 65) & (c <= 90), 1).when((c >= 48) & (c <= 57), 2).otherwise(3)


def group_of(c: Column, size: Column) -> Column:
    common = F.array(*(F.lit(ord(x)) for x in COMMON + COMMON.upper()))
    of_hex = F.floor(F.when(c >= 97, c - 87).otherwise(c - 48) / 4).cast("int")
    return F.when(size == 16, of_hex).when(F.array_contains(common, c), 0).otherwise(let(kind_of(c), lambda k: F.when(k < 2, k + 1).otherwise(3)))


def tests(codes: Column, alphabet: Column) -> Column:
    """The least of four p-values, corrected for four."""
    square = lambda x: x * x
    n, size = F.size(codes).cast("double"), alphabet["size"]
    alike = total(F.transform(F.array_distinct(codes), lambda c: let(F.size(F.filter(codes, lambda x: x == c)), square))).cast("double")
    each = chi_tail(size / n * alike - n, size - 1)

    def excess(groups: Column) -> Column:
        cell = lambda i: F.when(alphabet[f"g{i}"] > 0, square(F.size(F.filter(groups, lambda g: g == i)) - n * alphabet[f"g{i}"]) / (n * alphabet[f"g{i}"])).otherwise(0.0)
        return cell(0) + cell(1) + cell(2) + cell(3)

    grouped = chi_tail(let(F.transform(codes, lambda c: group_of(c, size)), excess), alphabet["df"])
    changes = let(F.transform(codes, kind_of), lambda ks: total(F.transform(ks, lambda x, i: F.when(x != F.coalesce(F.get(ks, i + 1), x), 1).otherwise(0)))).cast("double")
    second, third = alphabet["second"], alphabet["third"]
    spread = (n - 1) * (1 - second) * second + 2 * (n - 2) * (third - second * second)
    runs = tail((changes - (n - 1) * (1 - second)) / F.sqrt(F.greatest(spread, F.lit(1e-9))))
    middle = F.aggregate(codes, F.lit(0), lambda a, x: a + x) / n
    product = lambda a: F.aggregate(F.transform(a, lambda x, i: x * F.coalesce(F.get(a, i + 1), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x) / F.greatest(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x), F.lit(1e-9))
    serial = tail((let(middle, lambda m: let(F.transform(codes, lambda c: c - m), product)) + 1 / n) * F.sqrt(n))
    return F.least(F.lit(1.0), 4 * F.least(each, grouped, runs, serial))


def randomness(token: Column) -> Column:
    """p-value of "this token is random", by the alphabet of its encoding; case doesn't count in single-case ones."""

    def judged(bare: Column) -> Column:
        which = F.when(bare.rlike(r"^([0-9a-f]+|[0-9A-F]+)$"), 1).when(bare.rlike(r"^[A-Z2-7]+$"), 2).when(bare.rlike(r"^([a-z0-9]+|[A-Z0-9]+)$"), 3).when(bare.rlike(r"^[A-Za-z]+$"), 4).when(bare.rlike(r"^[A-Za-z0-9]+$"), 5).otherwise(6)
        codes = lambda p: F.filter(F.transform(F.split(F.when(p["size"] <= 36, F.lower(bare)).otherwise(bare), ""), lambda c: F.ascii(c)), lambda x: x > 0)
        return let(F.element_at(alphabets(), which), lambda p: let(codes(p), lambda c: tests(c, p)))

    return let(F.rtrim(token, F.lit("=")), judged)


def random_spans(text: Column, q: float = 0.05) -> Column:
    """Tokens outside the patterns' spans that the battery leaves as random, as (start, kind, end, value).

    Weighted Benjamini-Hochberg over the document's tokens: p-values are divided by length / mean length, so long tokens, where
    the tests have power, are dismissed more readily than short ones.
    """
    def without(t: Column, patterns: list) -> Column:
        return let(blanked(t, *patterns[0]), lambda x: without(x, patterns[1:])) if patterns else spans_of(t, TOKEN, 0, 16, len(KINDS))

    found = without(text, list(KINDS.values()))
    kinds = lambda t: t.rlike("[0-9]").cast("int") + t.rlike("[a-z]").cast("int") + t.rlike("[A-Z]").cast("int")
    single = lambda t: ~(t.rlike("[a-z]") & t.rlike("[A-Z]"))
    mixed = F.filter(found, lambda s: (kinds(s["value"]) >= 2) & (single(s["value"]) | (F.length(F.rtrim(s["value"], F.lit("="))) >= MIXED)))

    def decide(c: Column) -> Column:
        m = F.size(c)
        mean = total(F.transform(c, lambda s: F.length(s["value"]))) / m
        scored = F.sort_array(F.transform(c, lambda s: F.struct((randomness(s["value"]) * mean / F.length(s["value"])).alias("p"), s.alias("s"))))
        return let(scored, lambda s: let(F.aggregate(F.transform(s, lambda x, i: F.when(x["p"] <= (i + 1) * q / m, i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x)), lambda r: F.sort_array(F.transform(F.filter(s, lambda x, i: i >= r), lambda x: x["s"]))))

    nothing = F.array().cast(SPAN)
    return F.when(text.rlike(TOKEN), let(mixed, lambda c: F.when(F.size(c) > 0, decide(c)).otherwise(nothing))).otherwise(nothing)


def named(kind: Column) -> Column:
    return F.element_at(F.array(*(F.lit(k) for k in (*KINDS, "random"))), kind + 1)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", named(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, base: str, random: str) -> DataFrame:
    """docs with a struct of the spans by base kind and all of them (`every`), and with the other spans, in columns of these names.

    Columns are made one after the other, as the analyser resolves one level of nested functions at a time.
    """
    text = F.coalesce("text", F.lit(""))
    parts = let(F.struct(*(c.alias(k) for k, c in zip(KINDS, base_spans(text)))), lambda p: F.struct(*(p[k].alias(k) for k in KINDS), F.concat(*(p[k] for k in KINDS)).alias("every")))
    return docs.select("*", once(parts).alias(base)).select("*", once(random_spans(text)).alias(random))


def scan(docs: DataFrame) -> DataFrame:
    """Counts and spans by document; p_values has the p-value of every span's value."""
    f = scanned(docs.select("doc_id", "text"), "b", "r")
    every = F.concat("b.every", "r")
    values = F.transform(F.sort_array(every), lambda s: F.concat_ws(":", named(s["kind"]), s["start"].cast("string"), s["end"].cast("string"), F.format_string("%.3e", randomness(s["value"]))))
    return f.select("doc_id", *(F.size(f"b.{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(written(F.col("b.every")).cast("binary"), 256).alias("base_sha256"), written(every).alias("spans"), F.when(F.size(every) > 0, F.array_join(values, ",")).otherwise("").alias("p_values"))


def cut(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark for each of the sorted spans, of which overlapping ones are one; work grows with the text and the number of spans."""

    def joined(reach: Column) -> Column:  # reach: where the spans before each one end at the latest
        groups = F.filter(F.zip_with(spans, reach, lambda s, r: F.struct(s["start"].alias("start"), r.alias("before"))), lambda g: g["start"] >= g["before"])
        last = F.struct(F.length(text).alias("start"), F.array_max(F.transform(spans, lambda s: s["end"])).alias("before"))
        return F.concat(groups, F.array(last))  # the text between: from `before` to `start`

    def between(chunks: Column) -> Column:
        def piece(g: Column) -> Column:
            first = F.floor(g["before"] / CHUNK).cast("int")
            own = F.array_join(F.slice(chunks, first + 1, F.floor(g["start"] / CHUNK).cast("int") - first + 1), "")
            return F.substring(own, g["before"] - first * CHUNK + 1, g["start"] - g["before"])

        return let(running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x)), lambda reach: F.array_join(F.transform(joined(reach), piece), mark))

    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / CHUNK).cast("int")), lambda i: F.substring(text, i * CHUNK + 1, F.lit(CHUNK)))
    return let(chunks, between)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span replaced; overlapping spans are one. Columns are kept, n_chars is renewed."""
    base, random, name = (own_name(docs, x) for x in ("base", "random", "redacted"))
    d = scanned(docs, base, random)
    d = d.select("*", F.sort_array(F.concat(F.col(base)["every"], F.col(random))).alias(own_name(d, "every")))
    every = F.col(d.columns[-1])
    out = F.when(F.size(every) > 0, cut(F.col("text"), every, mark)).otherwise(F.col("text"))
    f = d.select("*", once(out).alias(name))
    own = {"text": F.col(name)} | ({"n_chars": F.length(name).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return f.select(*(own.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
