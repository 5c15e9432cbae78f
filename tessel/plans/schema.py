"""Which tables and columns of a model a question needs: terms, metrics and nearness, completed by the joins between them."""

from __future__ import annotations

from dataclasses import dataclass, field

from tessel.plans.model import Model, SemanticError
from tessel.plans.questions import context_columns, lay, metrics_in, model_terms, tokens_of

#: What each kind of evidence adds to a table's score.
WEIGHTS = {"entity": 3.0, "metric": 4.0, "dimension": 2.0, "word": 0.5, "near": 1.0}


@dataclass
class Retrieved:
    scores: dict[str, float]
    entities: list[str]  # best first, then those that only complete joins
    joins: list[str] = field(default_factory=list)
    columns: dict[str, list[str]] = field(default_factory=dict)


def retrieve(model: Model, question: str, columns: dict[str, list[str]], most: int = 5, longest: int = 4, per_table: int = 100) -> Retrieved:
    """The `most` best entities, those on the n:1 paths between them, and their columns within the budget.

    An entity scores by its terms, its metrics and its dimensions in the question, by words of its columns' names, and by how near it is to
    one that scored. Hidden columns count for nothing and aren't shown. columns: by table, all its columns.
    """
    said = tokens_of(question)
    scores = dict.fromkeys(model.entities, 0.0)
    needed: dict[str, set[str]] = {e.table: set(e.primary_key) for e in model.entities.values()}
    for key in {t.key for t in lay(said, model_terms(model))}:
        entity, _, dimension = key.partition(".")
        scores[entity] += WEIGHTS["dimension" if dimension else "entity"]
        if dimension:
            needed[model.entities[entity].table].add(model.entities[entity].dimensions[dimension])
    for m in metrics_in(model, question):
        scores[m.entity] += WEIGHTS["metric"]
        words = set(tokens_of(f"{m.expression} {m.denominator or ''} {m.time or ''}"))
        table = model.entities[m.entity].table
        needed[table] |= {c for c in columns.get(table, ()) if c.lower() in words}
    for e in model.entities.values():
        words = {w for c in columns.get(e.table, ()) if c not in e.hidden for w in tokens_of(c.replace("_", " "))}
        scores[e.name] += WEIGHTS["word"] * len(words & set(said))
    direct = dict(scores)
    for e in model.entities:
        near = [s for r in model.relationships for a, b in ((r.left, r.right), (r.right, r.left)) if a == e and (s := direct[b]) > 0]
        if direct[e] > 0 and near:
            scores[e] += WEIGHTS["near"]
    chosen = [e for e in sorted(scores, key=lambda e: (-scores[e], e)) if scores[e] > 0][:most]
    joins: dict[str, None] = {}
    whole = list(chosen)
    for a in chosen:
        for b in chosen:
            if a == b:
                continue
            try:
                path = model.path(a, b, longest)
            except SemanticError:
                continue
            for step in path:
                left, right = model.entities[step.left].table, model.entities[step.right].table
                joins[f"{left}.{step.left_column} = {right}.{step.right_column}"] = None
                needed[left].add(step.left_column)
                needed[right].add(step.right_column)
                whole += [x for x in (step.left, step.right) if x not in whole]
    tables = {model.entities[e].table: [c for c in columns.get(model.entities[e].table, ()) if c not in model.entities[e].hidden] for e in whole}
    return Retrieved({e: s for e, s in scores.items() if s}, whole, list(joins), context_columns(tables, {t: needed[t] for t in tables}, question, per_table))
