"""Rules over binary facts.

Horn clauses are read from text and evaluated bottom up as joins. Relations are sets. A predicate may
call itself once in a clause (linear recursion): each round joins only what the round before found,
and ends when nothing is new, so cycles end, too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

Atom = tuple[str, tuple[str, ...]]

RULES = r"""
% chains
reports_to_chain(A, B) :- reports_to(A, B).
reports_to_chain(A, C) :- reports_to(A, B), reports_to_chain(B, C).
manages_chain(A, B) :- manages(A, B).
manages_chain(A, C) :- manages(A, B), manages_chain(B, C).
% shared places
coworker(P, Q) :- works_at(P, Firm), works_at(Q, Firm), P \= Q.
teammate(P, Q) :- member_of(P, Group), member_of(Q, Group), P \= Q.
same_location(P, Q) :- lives_in(P, Town), lives_in(Q, Town), P \= Q.
% knowledge
can_help_with(P, Subject) :- expert_in(P, Subject).
can_help_with(P, Subject) :- knows(P, Subject).
can_consult(P, Q, Subject) :- friend_of(P, Q), expert_in(Q, Subject).
can_consult(P, Q, Subject) :- colleague_of(P, Q), expert_in(Q, Subject).
can_consult(P, Q, Subject) :- coworker(P, Q), expert_in(Q, Subject).
% things and people
owner_of_type(P, Kind) :- owns(P, Item), type_of(Item, Kind).
friend_of_friend(P, R) :- friend_of(P, Q), friend_of(Q, R), P \= R.
work_connection(P, Q) :- colleague_of(P, Q).
work_connection(P, Q) :- coworker(P, Q).
"""


#: After so many rounds of a recursive predicate, what they found is written as one table.
MERGED = 8


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Atom, ...]
    unequal: tuple[tuple[str, str], ...] = ()


class RuleError(ValueError):
    pass


def is_variable(term: str) -> bool:
    return term[:1].isupper() or term.startswith("_")


def constant(term: str) -> str:
    return term[1:-1] if term.startswith("'") else term


_ATOM = re.compile(r"\s*([a-z]\w*)\s*\(\s*([^()]*?)\s*\)\s*")
_UNEQUAL = re.compile(r"\s*(\w+)\s*\\=\s*(\w+)\s*")


def parse_atom(text: str) -> Atom:
    m = _ATOM.fullmatch(text)
    if not m:
        raise RuleError(f"not an atom: {text.strip()!r}")
    return m[1], tuple(t.strip() for t in m[2].split(","))


def parse(text: str) -> list[Rule]:
    """Clauses ``head(...) :- body(...), X \\= Y.``; a line's part after % is a comment."""
    rules = []
    clean = re.sub(r"%[^\n]*", "", text)
    for clause in re.split(r"\.(?=\s|$)", clean):
        if not clause.strip():
            continue
        head, arrow, body = clause.partition(":-")
        if not arrow:
            raise RuleError(f"not a rule: {clause.strip()!r}")
        atoms, unequal = [], []
        for part in re.split(r",(?![^()]*\))", body):
            if m := _UNEQUAL.fullmatch(part):
                unequal.append((m[1], m[2]))
            else:
                atoms.append(parse_atom(part))
        rule = Rule(parse_atom(head), tuple(atoms), tuple(unequal))
        bound = {t for _, args in atoms for t in args}
        loose = [t for t in (*rule.head[1], *(t for u in unequal for t in u)) if is_variable(t) and t not in bound]
        if loose:
            raise RuleError(f"unbound {loose[0]} in {clause.strip()!r}")
        rules.append(rule)
    return rules


class Program:
    def __init__(self, facts: DataFrame, rules: str = RULES) -> None:
        self.facts, self.rules = facts, parse(rules)
        self.known: dict[str, DataFrame] = {}

    def relation(self, name: str) -> DataFrame:
        """The set of a predicate's rows, with columns arg0, arg1, ...: its facts, and what its rules derive."""
        if name not in self.known:
            own = [r for r in self.rules if r.head[0] == name]
            base = [self.facts.where(F.col("predicate") == name).select("arg0", "arg1")] if all(len(r.head[1]) == 2 for r in own) else []
            simple = [r for r in own if all(a[0] != name for a in r.body)]
            again = [r for r in own if r not in simple]
            for r in again:
                if sum(a[0] == name for a in r.body) > 1:
                    raise RuleError(f"{name} calls itself twice in a clause")
            out = reduce(DataFrame.unionByName, [*base, *(self._derive(r, {}) for r in simple)]).distinct()
            if again:
                out = delta = checkpoint(out)
                rounds = 0
                while not delta.isEmpty():
                    step = reduce(DataFrame.unionByName, [self._derive(r, {name: delta}) for r in again]).distinct()
                    delta = checkpoint(step.join(out, step.columns, "left_anti"))
                    out, rounds = out.unionByName(delta), rounds + 1
                    if rounds % MERGED == 0:
                        out = checkpoint(out)
            self.known[name] = out
        return self.known[name]

    def _rows(self, atom: Atom, given: dict[str, DataFrame]) -> DataFrame:
        name, args = atom
        rows = given[name] if name in given else self.relation(name)
        for k, t in enumerate(args):
            if not is_variable(t):
                rows = rows.where(F.col(f"arg{k}") == constant(t))
        first = {t: k for k, t in reversed(list(enumerate(args))) if is_variable(t)}
        for k, t in enumerate(args):
            if is_variable(t) and first[t] != k:
                rows = rows.where(F.col(f"arg{k}") == F.col(f"arg{first[t]}"))
        return rows.select(*[F.col(f"arg{k}").alias(t) for t, k in first.items() if t != "_"])

    def _derive(self, rule: Rule, given: dict[str, DataFrame]) -> DataFrame:
        out = self._rows(rule.body[0], given)
        for atom in rule.body[1:]:
            more = self._rows(atom, given)
            shared = [c for c in more.columns if c in out.columns]
            out = out.join(more, shared) if shared else out.crossJoin(more)
        side = lambda t: F.col(t) if is_variable(t) else F.lit(constant(t))
        for a, b in rule.unequal:
            out = out.where(side(a) != side(b))
        return out.select(*[side(t).alias(f"arg{k}") for k, t in enumerate(rule.head[1])])

    def ask(self, goal: str) -> DataFrame:
        """Bindings of the goal's variables, a column each; for a goal without any, one column ``holds``."""
        atom = parse_atom(goal.rstrip(" ."))
        rows = self._rows(atom, {})
        if any(is_variable(t) for t in atom[1]):
            return rows.distinct()
        name, args = atom
        same = reduce(lambda a, b: a & b, [F.col(f"arg{k}") == constant(t) for k, t in enumerate(args)])
        return self.relation(name).where(same).agg((F.count("*") > 0).alias("holds"))

    def holds(self, goal: str) -> bool:
        return not self.ask(goal).where("holds").isEmpty() if not any(is_variable(t) for t in parse_atom(goal.rstrip(" ."))[1]) else not self.ask(goal).isEmpty()

    def first(self, goal: str) -> dict[str, str] | None:
        """One binding, the smallest; None if there is none or the goal can't be read."""
        try:
            rows = self.ask(goal)
        except RuleError:
            return None
        row = rows.orderBy(*rows.columns).first()
        return row.asDict() if row else None


_QUOTED = re.compile(r"'([^']+)'")


def with_ids(goal: str, names: DataFrame) -> str:
    """The goal with its quoted names replaced by ids of ``names`` (name, id), in any case; of several the smallest."""
    asked = {n.lower() for n in _QUOTED.findall(goal)}
    if not asked:
        return goal
    known = names.where(F.lower("name").isin(*asked)).groupBy(F.lower("name").alias("name")).agg(F.min("id").alias("id"))
    ids = dict(map(tuple, known.collect()))  # a row for each name asked for, at most
    return _QUOTED.sub(lambda m: f"'{ids.get(m[1].lower(), m[1])}'", goal)


def general(goal: str) -> str:
    """The goal with each quoted constant that doesn't look like an id (over 30 letters, with an underscore) as a variable of its own."""
    fresh = iter(range(1 << 30))
    return _QUOTED.sub(lambda m: m[0] if "_" in m[1] and len(m[0]) > 30 or not m[1][0].islower() else f"X{next(fresh)}", goal)


def ask_by_name(program: Program, goal: str, names: DataFrame) -> tuple[DataFrame, bool]:
    """The bindings of a goal with names instead of ids, and whether only the general form of it had any."""
    exact = with_ids(goal, names)
    rows = program.ask(exact)
    if program.holds(exact) or (wider := general(exact)) == exact:
        return rows, False
    return program.ask(wider), True


def predicates(facts: DataFrame) -> DataFrame:
    """(predicate, n) of the facts there are."""
    return facts.groupBy("predicate").agg(F.count("*").alias("n"))


def sample_facts(facts: DataFrame, names: DataFrame, most: int = 10) -> DataFrame:
    """(line) of the first facts in order, ids as names where they have one."""
    first = facts.orderBy("predicate", "arg0", "arg1").limit(most)
    one = names.groupBy("id").agg(F.min("name").alias("name"))
    side = lambda k: one.select(F.col("id").alias(f"_i{k}"), F.col("name").alias(f"_n{k}"))
    named = first.join(side(0), F.col("arg0") == F.col("_i0"), "left").join(side(1), F.col("arg1") == F.col("_i1"), "left")
    return named.select(F.concat("predicate", F.lit("("), F.coalesce("_n0", "arg0"), F.lit(", "), F.coalesce("_n1", "arg1"), F.lit(")")).alias("line"))
