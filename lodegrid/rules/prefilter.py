"""Literals in front of the catalog: which rules can hold on a function, by one pass of an automaton over its text.

A predicate states what it needs: clauses of lower-case literals, of each of which one at least occurs where the predicate holds.
``dsl`` derives the clauses along with a predicate; they never say that a rule holds, only that it can't. All literals of all rules
stand in one Aho-Corasick automaton, so a text is read once however many rules there are, and a rule's own patterns then run on the
functions that have its words only. A rule without clauses is always tried.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from re import _constants as op
from re import _parser

from ..functions.text import slices

Clauses = tuple[frozenset, ...]
#: Shorter literals occur nearly everywhere.
SHORTEST = 3
#: Rules from which the pass over the texts costs less than it saves.
RULES_FROM = 16
_BITS = 62
#: Texts whose bits leave together; functions are short.
_ROWS = 2048


def both(*needs: Clauses) -> Clauses:
    """Clauses of a conjunction."""
    return tuple(dict.fromkeys(c for n in needs for c in n))


def either(*needs: Clauses) -> Clauses:
    """One clause for a disjunction: the most telling one of each side; none if a side needs nothing."""
    if not needs or not all(needs):
        return ()
    return (frozenset().union(*(max(n, key=lambda c: (min(map(len, c)), -len(c))) for n in needs)),)


def _branches(*needs: Clauses) -> Clauses:
    """Clauses of a disjunction, one from each side in every clause: as many as the side with the most has, its most telling ones first."""
    if not needs or not all(needs):
        return ()
    sides = [sorted(n, key=lambda c: (min(map(len, c)), -len(c)), reverse=True) for n in needs]
    return both(tuple(frozenset().union(*(s[min(k, len(s) - 1)] for s in sides)) for k in range(max(map(len, sides)))))


@lru_cache(maxsize=None)
def literals(pattern: str) -> Clauses:
    """What a text needs for the pattern to match somewhere in it, in any case; literals are ASCII without white space."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = _parser.parse(pattern)
    except re.error:  # a pattern only the JVM's engine knows: always tried
        return ()
    return both(tuple(_clauses(tree)))


def _clauses(tree) -> list[frozenset]:
    out, run = [], ""
    for kind, arg in [*tree, (None, None)]:
        if kind is op.LITERAL and 32 < arg < 127:
            run += chr(arg).lower()
            continue
        if len(run) >= SHORTEST:
            out.append(frozenset([run]))
        run = ""
        if kind is op.BRANCH:
            out += _branches(*(tuple(_clauses(a)) for a in arg[1]))
        elif kind is op.SUBPATTERN:
            out += _clauses(arg[-1])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and arg[0] > 0:
            out += _clauses(arg[2])
        elif kind is op.ATOMIC_GROUP:
            out += _clauses(arg)
        elif kind is op.ASSERT:
            out += _clauses(arg[1])
    return out


class Gate:
    """Rules by any key and what they need; ``column`` computes the bits of the rules that can hold, ``test`` reads one of ``bits``."""

    def __init__(self, needs: dict, bits: str = "can_hold"):
        self.bits = bits
        clauses = list(dict.fromkeys(c for n in needs.values() for c in n))
        number = {c: 1 << i for i, c in enumerate(clauses)}
        self.words: dict[str, int] = {}
        for c in clauses:
            for w in c:
                self.words[w] = self.words.get(w, 0) | number[c]
        self.masks = [sum(number[c] for c in n) for n in needs.values() if n]
        self.place = {r: divmod(k, _BITS) for k, r in enumerate(r for r, n in needs.items() if n)}

    def test(self, rule) -> str:
        """SQL condition in front of the rule's predicate, with the joining AND; empty for a rule that is always tried."""
        if rule not in self.place:
            return ""
        word, bit = self.place[rule]
        return f"({self.bits}[{word}] & {1 << bit}L) <> 0L AND "

    def column(self, text: Column) -> Column:
        words, masks = self.words, self.masks

        @F.arrow_udf(T.ArrayType(T.LongType()))
        def can_hold(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            find = automaton(words)
            packed: dict[int, list[int]] = {}  # clauses met -> bits; many functions meet the same ones
            for texts in slices(batches, _ROWS):
                out = []
                for t in texts:
                    if t is None:  # unknown, as the rule's own patterns say
                        out.append(None)
                        continue
                    met = 0
                    for _, m in find(t.lower()):
                        met |= m
                    bits = packed.get(met)
                    if bits is None:
                        if len(packed) >= 100_000:
                            packed.clear()
                        bits = packed[met] = pack(met, masks)
                    out.append(bits)
                yield pa.array(out, pa.list_(pa.int64()))

        return can_hold.asNondeterministic()(text)


def gate_of(needs: dict, bits: str) -> Gate | None:
    """A gate where enough of the rules need anything to be worth the pass."""
    return Gate(needs, bits) if sum(map(bool, needs.values())) >= RULES_FROM else None


def with_matches(df: DataFrame, text: str, **patterns: str) -> DataFrame:
    """The rows with a Boolean for each pattern, whether it is found in the text; a pattern runs where its words occur only."""
    gate = Gate({k: literals(p) for k, p in patterns.items()}, "__can")
    can = df.withColumn(gate.bits, gate.column(F.col(text)))
    return can.select(*df.columns, *[(F.expr(gate.test(k) + "true") & F.col(text).rlike(p)).alias(k) for k, p in patterns.items()])


def automaton(words: dict[str, int]):
    """Iterator factory over (end, clauses of the literal) of every literal in a lower-cased text, overlapping ones too."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for w, m in words.items():
        a.add_word(w, m)
    a.make_automaton()
    return a.iter


def pack(met: int, masks: list[int]) -> list[int]:
    """Bits of the rules all of whose clauses are met."""
    out = [0] * (len(masks) // _BITS + 1)
    for k, m in enumerate(masks):
        if met & m == m:
            out[k // _BITS] |= 1 << k % _BITS
    return out
