"""From a question to a typed request, and from a follow-up to its change.

A text is cut into tokens, and the terms of the model and of the vocabulary below are laid over them, longest first, each token
belonging to one term at most. Everything here reads text on the driver and returns a planner Request; data is touched only when that is compiled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from datetime import date

from tessel.functions.calendar import detect_baseline, detect_grain, resolve_ranges, without_baseline
from tessel.plans.model import Metric, Model, SemanticError
from tessel.plans.planner import Request
from tessel.plans.predicates import extract

#: What words say about a question, in English and Chinese.
VOCABULARY = {
    "counting": ("how many", "count", "counts", "number of", "数量", "多少"),
    "listing": ("list", "show", "give me", "列出"),
    "keys": ("id", "ids", "identifier", "identifiers", "keys", "编号"),
    "quotient": ("average", "avg", "mean", "rate", "ratio", "平均", "比例", "率"),
    "grouping": ("by", "per", "grouped by", "broken down by", "for each", "split by", "按", "依照", "根据"),
    "swapping": ("instead", "改为", "换成"),
}
#: The analysis that words ask for, first match first (R-04).
TEMPLATES = {
    "anomaly": ("anomaly", "anomalies", "anomalous", "outlier", "outliers", "unusual", "spike", "spikes", "异常"),
    "contribution": ("why", "contribution", "contributed", "contributes", "driver", "drivers", "drove", "贡献", "原因"),
    "trend": ("trend", "trends", "over time", "daily", "weekly", "monthly", "quarterly", "yearly", "趋势"),
    "segment": VOCABULARY["grouping"],
}
Tokens = list[str]


@dataclass(frozen=True)
class Tag:
    """A term laid over the tokens from `at` to `end` - 1."""

    at: int
    end: int
    key: str
    term: str


def tokens_of(text: str) -> Tokens:
    """Words in lower case; letters of scripts without blanks stand alone."""
    return re.findall(r"[a-z0-9_]+|[^\W\d_a-z]+(?<![\u3040-\u30ff\u3400-\u9fff])|[\u3040-\u30ff\u3400-\u9fff]", text.casefold())


def lay(tokens: Tokens, terms: Iterable[tuple[str, str]]) -> list[Tag]:
    """The (key, term) pairs found in the tokens: longer terms take their tokens first, and keys with an equally long term share them."""
    found = []
    for key, term in terms:
        own = tokens_of(term)
        found += [Tag(i, i + len(own), key, term) for i in range(len(tokens) - len(own) + 1) if own and tokens[i : i + len(own)] == own]
    owner: dict[int, tuple[int, int]] = {}
    out = []
    for t in sorted(found, key=lambda t: (t.at - t.end, t.at)):
        if all(owner.get(i, (t.at, t.end)) == (t.at, t.end) for i in range(t.at, t.end)):
            owner.update(dict.fromkeys(range(t.at, t.end), (t.at, t.end)))
            out.append(t)
    return sorted(out, key=lambda t: t.at)


def says(tokens: Tokens, word: str) -> list[Tag]:
    return lay(tokens, ((word, t) for t in VOCABULARY[word]))


def spoken(name: str) -> list[str]:
    """A name as it is and with spaces for underscores."""
    return [name, name.replace("_", " ")]


def metric_terms(model: Model) -> Iterable[tuple[str, str]]:
    return ((m.name, t) for m in model.metrics.values() for t in (*spoken(m.name), *m.synonyms))


def metrics_in(model: Model, question: str) -> list[Metric]:
    """R-01: the metrics whose terms the question holds, longest terms first.

    A counting question means no quotient unless it asks for one, and a question for a list of keys no count, unless the metric is
    called by its name. "Across all ..." is context and names nothing.
    """
    tokens = tokens_of(re.sub(r"\b(across|over) all \w+", " ", question, flags=re.I))
    asks = {w: bool(says(tokens, w)) for w in ("counting", "listing", "keys", "quotient")}

    def meant(term: tuple[str, str]) -> bool:
        m = model.metrics[term[0]]
        if term[1] in spoken(m.name):
            return True
        if m.kind == "ratio":
            return asks["quotient"] or not asks["counting"]
        return not (m.kind.startswith("count") and asks["listing"] and asks["keys"])

    tags = lay(tokens, filter(meant, metric_terms(model)))
    names = dict.fromkeys(t.key for t in sorted(tags, key=lambda t: t.at - t.end))
    return [model.metrics[n] for n in names]


def model_terms(model: Model) -> Iterable[tuple[str, str]]:
    """Terms of entities, and of dimensions (key entity.dimension) that aren't hidden."""
    for e in model.entities.values():
        yield from ((e.name, t) for t in (*spoken(e.name), *e.synonyms))
        for d, column in e.dimensions.items():
            if column not in e.hidden:
                yield from ((f"{e.name}.{d}", t) for t in (*spoken(d), f"{e.name} {d.replace('_', ' ')}", *e.dimension_synonyms.get(d, ())))


def mentions(model: Model, question: str) -> list[str]:
    """R-02: the entities and dimensions (entity.dimension) that a question names."""
    return list(dict.fromkeys(t.key for t in lay(tokens_of(question), model_terms(model))))


def groups_in(model: Model, question: str, metrics: list[Metric]) -> list[str]:
    """R-03: dimensions that follow a grouping word within three tokens, or another such dimension. Of several with one term: the metrics' own entity's, else an allowed one, else the nearest."""
    tokens = tokens_of(question)
    starts = [t.end for t in says(tokens, "grouping")]
    own, allowed, out = {m.entity for m in metrics}, set().union(*(m.dimensions or () for m in metrics)), []

    def rank(ref: str) -> tuple:
        try:
            steps = max((len(model.path(e, ref.split(".")[0])) for e in own), default=0)
        except SemanticError:
            steps = 99
        return ref.split(".")[0] not in own, ref not in allowed, steps, ref

    by_place: dict[tuple[int, int], list[str]] = {}
    for t in lay(tokens, (x for x in model_terms(model) if "." in x[0])):
        by_place.setdefault((t.at, t.end), []).append(t.key)
    for (at, end), refs in sorted(by_place.items()):
        if any(0 <= at - s <= 3 for s in starts):
            starts += [end, end + 1]  # "by a and b", "by a, b"
            best = min(refs, key=rank)
            if best not in out:
                out.append(best)
    return out


def template(question: str) -> str:
    """R-04: the analysis that a question asks for."""
    tokens = tokens_of(question)
    return next((name for name, words in TEMPLATES.items() if lay(tokens, ((name, w) for w in words))), "default")


def ranking(text: str) -> int | None:
    """The N of "top N"."""
    m = re.search(r"\b(?:top|first|limit)\s+(\d+)\b|前\s*(\d+)", text, re.I)
    n = int(m[1] or m[2]) if m else 0
    return n or None


def to_request(model: Model, question: str, today: date) -> Request:
    """The question's metrics, groups, dates, grain, baseline, filter and top N. No metric is an error, never a guess."""
    clause = extract(question)
    asked = question if clause is None else question[: question.lower().rindex(clause.lower())]
    metrics = metrics_in(model, asked)
    if not metrics:
        raise SemanticError("metric_expression: the question names no metric")
    top, baseline = ranking(asked), detect_baseline(asked)
    grain = detect_grain(asked) or ("monthly" if baseline else None)
    return Request(tuple(m.name for m in metrics), tuple(groups_in(model, asked, metrics)), grain, tuple(resolve_ranges(without_baseline(asked), today)), clause, top, bool(top), baseline)


Edit = Callable[[Model, Request, str, date], Request]


def _narrow(model: Model, r: Request, rest: str, today: date) -> Request:
    clause = extract(f"where {rest}")
    return replace(r, where=f"({r.where}) AND ({clause})" if r.where else clause)


def _widen(model: Model, r: Request, rest: str, today: date) -> Request:
    more = tuple(m.name for m in metrics_in(model, rest) if m.name not in r.metrics)
    groups = tuple(x for x in mentions(model, rest) if "." in x and x not in r.dimensions)
    if not more and not groups:
        raise SemanticError(f"metric_expression: nothing new is called {rest!r}")
    return replace(r, metrics=r.metrics + more, dimensions=r.dimensions + (() if more else groups))


def _leave_out(model: Model, r: Request, rest: str, today: date) -> Request:
    gone = {*mentions(model, rest), *(m.name for m in metrics_in(model, rest))}
    return replace(r, metrics=tuple(x for x in r.metrics if x not in gone) or r.metrics, dimensions=tuple(x for x in r.dimensions if x not in gone))


#: What the first word of a follow-up does with the rest.
VERBS: dict[str, Edit] = {
    **dict.fromkeys(("only", "just", "where", "filter to", "只看"), _narrow),
    **dict.fromkeys(("add", "include", "also show", "also", "加上"), _widen),
    **dict.fromkeys(("remove", "drop", "without", "leave out", "去掉"), _leave_out),
}


def _verb(model: Model, r: Request, text: str, today: date) -> Request:
    for word in sorted(VERBS, key=len, reverse=True):
        if m := re.match(rf"{word}{r'\b' if word.isascii() else ''}\s*(.+)$", text, re.I | re.S):
            return VERBS[word](model, r, m[1], today)
    return r


def _time(model: Model, r: Request, text: str, today: date) -> Request:
    found = resolve_ranges(without_baseline(text), today)
    return replace(r, ranges=tuple(found)) if found else r


def _comparison(model: Model, r: Request, text: str, today: date) -> Request:
    baseline = detect_baseline(text)
    return replace(r, baseline=baseline, grain=r.grain or "monthly") if baseline else r


def _order(model: Model, r: Request, text: str, today: date) -> Request:
    n = ranking(text)
    return replace(r, limit=n, descending=True) if n else r


def _shape(model: Model, r: Request, text: str, today: date) -> Request:
    """A grain, or groups in place of the former ones or beside them."""
    grain = detect_grain(text) or ("monthly" if lay(tokens_of(text), (("t", x) for x in ("over time", "时间趋势"))) and not r.grain else None)
    if grain:
        return replace(r, grain=grain)
    groups = tuple(groups_in(model, text, [model.metrics[x] for x in r.metrics]))
    if not groups:
        return r
    return replace(r, dimensions=groups if says(tokens_of(text), "swapping") else tuple(dict.fromkeys((*r.dimensions, *groups))))


def follow_up(model: Model, before: Request, text: str, today: date) -> tuple[Request, list[str]]:
    """R-11: the request with what the text changes, and the names of the fields that differ; none means that nothing matched."""
    out, said = before, text.strip().rstrip("?.!")
    for edit in (_verb, _time, _comparison, _order, _shape):
        out = edit(model, out, said, today)
    return out, [f for f in ("metrics", "dimensions", "grain", "ranges", "where", "limit", "baseline") if getattr(out, f) != getattr(before, f)]


def subjects(model: Model, question: str) -> list[tuple[str, int]]:
    """R-09: entities by score: their own name or a synonym 3, a metric of theirs 2, their table 1."""
    tokens, score = tokens_of(question), dict.fromkeys(model.entities, 0)
    for key in {t.key for t in lay(tokens, (x for x in model_terms(model) if "." not in x[0]))}:
        score[key] += 3
    for key in {t.key for t in lay(tokens, ((e.name, e.table) for e in model.entities.values()))}:
        score[key] += 1
    for m in metrics_in(model, question):
        score[m.entity] += 2
    return sorted(((e, s) for e, s in score.items() if s), key=lambda x: (-x[1], x[0]))


def contract(question: str) -> list[str] | None:
    """P-12: the columns that "return a, b" names, in order."""
    m = re.search(r"\breturn(?:ing)?\s+(?:columns?\s+)?((?:[a-z_]\w*)(?:\s*(?:,|\band\b)\s*[a-z_]\w*)*)", question, re.I)
    return [x for x in re.split(r"\s*(?:,|\band\b)\s*", m[1]) if x] if m else None


def meets(columns: list[str], wanted: list[str] | None, raw: dict[str, set[str]] | None = None) -> bool:
    """P-12: whether a result has the wanted columns in order. A column of ids must be one of the tables' own: raw names the origins of each result column."""
    if wanted is None:
        return True
    ids = [c for c in wanted if re.search(r"(^|_)(id|key)s?$", c)]
    return columns == wanted and (raw is None or all(len(raw.get(c, ())) == 1 and re.fullmatch(r"\w+\.\w+", *raw[c]) for c in ids))


def context_columns(columns: dict[str, list[str]], required: dict[str, set[str]], question: str, per_table: int = 100, most_tables: int = 50) -> dict[str, list[str]]:
    """P-13: what of a wide catalogue is shown for a question: required columns, then those it names, then others, within a budget."""
    said = set(tokens_of(question.replace("_", " ")))
    named = lambda c: bool(set(tokens_of(c.replace("_", " "))) & said)
    out = {}
    for t in sorted(columns, key=lambda t: (t not in required, not any(map(named, columns[t]))))[:most_tables]:
        need = required.get(t, set())
        shown = set(sorted(columns[t], key=lambda c: (c not in need, not named(c)))[:per_table])
        out[t] = [c for c in columns[t] if c in shown]
    return out
