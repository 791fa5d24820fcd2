"""Small expression builder for the rule catalog.

A rule is a predicate over the columns of the ``functions`` relation (name,
params, tail, body, ...). Each node keeps the same predicate as Spark SQL text
(evaluated JVM-side with ``F.expr``) and as DuckDB SQL text (the correctness
oracle). File-grain sub-predicates are collected in ``flags`` so that they are
computed once per source file, before the function rows are exploded, and never
drag the whole file text along.

``needs`` are literals without which a predicate is false, an array or text empty, a number zero (see
``prefilter``); ``own`` marks texts cut out of the function's columns or the file, the only ones that can state any.
"""

from __future__ import annotations

import hashlib
import itertools
import re

from .prefilter import Clauses, both, either, literals

_var = itertools.count()
# Plain word alternations are substring tests: far cheaper than a case-folding regex over long texts.
_WORDS = re.compile(r"^[\w -]+(?:\|[\w -]+)*$", re.A)
LOWERED = {c: f"l_{c}" for c in ("name", "params", "tail", "body", "clean", "raw")}


def lowered(*cols: str) -> list[str]:
    """Projection of the lower-cased twins that word tests read."""
    return [f"lower({c}) AS {LOWERED[c]}" for c in cols]


def _contains(col: str, words: str, i: bool) -> str:
    base = col[6:-1] if col.startswith("lower(") else col
    if i or col != base:
        col = LOWERED.get(base, f"lower({base})")
        words = words.lower() if i else words
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words.split("|")) + ")"


def _spark_lit(p: str) -> str:
    assert not ("'" in p and '"' in p), p
    q = '"' if "'" in p else "'"
    return f"r{q}{p}{q}"


def _duck_lit(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _ci(p: str, i: bool) -> str:
    return f"(?i){p}" if i else p


def _no_re2(p: str) -> bool:
    """RE2 knows no look-around and no back-references."""
    return any(x in p for x in ("(?!", "(?<", "(?=", "\\1"))


class Node:
    def __init__(self, s: str, d: str | None, flags: dict | None = None, needs: Clauses = (), own: bool = False, gap: bool = False):
        self.s, self.d, self.flags = s, d, dict(flags or {})
        self.needs, self.own, self.gap = needs, own, gap

    def _join(self, other: "Node", s: str, d: str, cls=None, **kw):
        flags = {**self.flags, **other.flags}
        dd = None if self.d is None or other.d is None else d
        return (cls or type(self))(s, dd, flags, **kw)

    def _lits(self, p) -> Clauses:
        """Needs of a fixed pattern found in this text; none known for another origin or a pattern put together from columns."""
        return literals(p) if self.own and isinstance(p, str) else ()


class Pred(Node):
    def __and__(self, o: "Pred") -> "Pred":
        return self._join(o, f"({self.s} AND {o.s})", f"({self.d} AND {o.d})", needs=both(self.needs, o.needs))

    def __or__(self, o: "Pred") -> "Pred":
        return self._join(o, f"({self.s} OR {o.s})", f"({self.d} OR {o.d})", needs=either(self.needs, o.needs))

    def __invert__(self) -> "Pred":
        return Pred(f"(NOT {self.s})", None if self.d is None else f"(NOT {self.d})", self.flags)

    def num(self) -> "Num":
        return Num(f"(CASE WHEN {self.s} THEN 1 ELSE 0 END)",
                   None if self.d is None else f"(CASE WHEN {self.d} THEN 1 ELSE 0 END)", self.flags, self.needs)


class Num(Node):
    def _cmp(self, op: str, o) -> Pred:
        positive = not isinstance(o, Node) and ((op == ">" and o >= 0) or (op == ">=" and o >= 1))
        o = o if isinstance(o, Node) else Num(str(o), str(o))
        return self._join(o, f"({self.s} {op} {o.s})", f"({self.d} {op} {o.d})", Pred, needs=self.needs if positive else ())

    def __lt__(self, o): return self._cmp("<", o)
    def __le__(self, o): return self._cmp("<=", o)
    def __gt__(self, o): return self._cmp(">", o)
    def __ge__(self, o): return self._cmp(">=", o)

    def __add__(self, o: "Num") -> "Num":
        return self._join(o, f"({self.s} + {o.s})", f"({self.d} + {o.d})", Num, needs=either(self.needs, o.needs))


class Text(Node):
    """A string column or expression."""

    def has(self, p, i: bool = True) -> Pred:
        """Regex search; ``p`` is a pattern or a dynamic ``Text`` pattern."""
        if isinstance(p, Text):
            return self._join(p, f"({self.s} RLIKE {p.s})", f"regexp_matches({self.d}, {p.d})", Pred)
        fast = _contains(self.s, p, i) if _WORDS.match(p) else None
        lits = self._lits(p)
        p = _ci(p, i)
        d = None if self.d is None or _no_re2(p) else f"regexp_matches({self.d}, {_duck_lit(p)})"
        return Pred(fast or f"({self.s} RLIKE {_spark_lit(p)})", d, self.flags, both(lits, self.needs) if lits else ())

    def lower(self) -> "Text":
        return Text(f"lower({self.s})", self.d and f"lower({self.d})", self.flags, self.needs, self.own)

    def left(self, n: int) -> "Text":
        return Text(f"substring({self.s}, 1, {n})", self.d and f"substring({self.d}, 1, {n})", self.flags, self.needs, self.own)

    def __add__(self, o) -> "Text":
        # needs hold no white space, so a text joined by white space has none across its parts
        space = isinstance(o, str) and o.isspace()
        o = o if isinstance(o, Text) else lit(o)
        return self._join(o, f"concat({self.s}, {o.s})", f"concat({self.d}, {o.d})", Text, own=self.own and (space or (self.gap and o.own)), gap=space)

    def eq(self, o) -> Pred:
        lits = self._lits(re.escape(o)) if isinstance(o, str) else ()
        o = o if isinstance(o, Text) else lit(o)
        return self._join(o, f"({self.s} = {o.s})", f"({self.d} = {o.d})", Pred, needs=lits)

    def isin(self, *vals: str) -> Pred:
        v = ", ".join("'" + x + "'" for x in vals)
        return Pred(f"({self.s} IN ({v}))", self.d and f"({self.d} IN ({v}))", self.flags, either(*(self._lits(re.escape(x)) for x in vals)))

    def contains(self, o: "Text") -> Pred:
        return self._join(o, f"contains({self.s}, {o.s})", f"contains({self.d}, {o.d})", Pred)

    def _wrap(self, pre: str, p, i: bool, post: str) -> "Text":
        """Fixed or dynamic pattern between two fixed parts, as a SQL pattern expression."""
        if isinstance(p, Pat):
            return near(pre + "(?-s:", p, ")" + post)
        w = f"{pre}(?-s:{_ci(p, i)}){post}"
        t = lit(w)
        if _no_re2(w):
            t.d = None
        return t

    def _cutoff(self, w: "Text") -> "Text":
        return self._join(w, f"regexp_replace({self.s}, {w.s}, '')", f"regexp_replace({self.d}, {w.d}, '')", Text, own=self.own)

    def after(self, p, i: bool = True) -> "Text":
        """Text following the first match (the whole text where nothing matches)."""
        return self._cutoff(self._wrap("(?s)^.*?", p, i, ""))

    def before_last(self, p, i: bool = True) -> "Text":
        """Text in front of the last match ('' without one)."""
        w = self._wrap("(?s)^(.*)", p, i, "")
        return self._join(w, f"regexp_extract({self.s}, {w.s}, 1)", f"regexp_extract({self.d}, {w.d}, 1)", Text, needs=self._lits(p), own=self.own)

    def before(self, p, i: bool = True) -> "Text":
        """Text in front of the first match (the whole text where nothing matches)."""
        return self._cutoff(self._wrap("(?s)", p, i, ".*$"))

    def since(self, p, i: bool = True) -> "Text":
        """Text from the first match on, the match included ('' without one)."""
        w = self._wrap("(?s)^.*?(", p, i, ".*)$")
        return self._join(w, f"regexp_extract({self.s}, {w.s}, 1)", f"regexp_extract({self.d}, {w.d}, 1)", Text, needs=self._lits(p), own=self.own)

    def pos(self, p: str, i: bool = True) -> Num:
        """1-based offset of the first match, 0 where there is none."""
        q = _ci(p, i)
        d = self.d and (f"(CASE WHEN regexp_matches({self.d}, {_duck_lit(q)}) THEN "
                        f"length(regexp_replace({self.d}, {_duck_lit(f'(?s)(?-s:{q}).*$')}, '')) + 1 ELSE 0 END)")
        return Num(f"regexp_instr({self.s}, {_spark_lit(q)})", d, self.flags, self._lits(p))

    def extract(self, p: str, g: int = 1, i: bool = True) -> "Text":
        q = _ci(p, i)
        d = None if self.d is None or _no_re2(q) else f"regexp_extract({self.d}, {_duck_lit(q)}, {g})"
        return Text(f"regexp_extract({self.s}, {_spark_lit(q)}, {g})", d, self.flags, self._lits(p), self.own)

    def all(self, p: str, g: int = 1, i: bool = True) -> "Many":
        q = _ci(p, i)
        d = None if self.d is None or _no_re2(q) else f"regexp_extract_all({self.d}, {_duck_lit(q)}, {g})"
        return Many(f"regexp_extract_all({self.s}, {_spark_lit(q)}, {g})", d, self.flags, self._lits(p), self.own)

    def nonempty(self) -> Pred:
        return Pred(f"({self.s} <> '')", self.d and f"({self.d} <> '')", self.flags, self.needs)


class Many(Node):
    """An array of strings."""

    def _lam(self, f, kind):
        v = f"x{next(_var)}"
        p = f(Text(v, v, own=self.own))
        flags = {**self.flags, **p.flags}
        return v, p, flags

    def where(self, f) -> "Many":
        v, p, flags = self._lam(f, "filter")
        d = None if self.d is None or p.d is None else f"list_filter({self.d}, lambda {v}: {p.d})"
        return Many(f"filter({self.s}, {v} -> {p.s})", d, flags, both(self.needs, p.needs), self.own)

    def map(self, f) -> "Many":
        v, p, flags = self._lam(f, "map")
        d = None if self.d is None or p.d is None else f"list_transform({self.d}, lambda {v}: {p.d})"
        return Many(f"transform({self.s}, {v} -> {p.s})", d, flags, self.needs, p.own)

    def any(self, f) -> Pred:
        return self.where(f).size() > 0

    def every(self, f) -> Pred:
        return ~self.any(lambda x: ~f(x))

    def first(self) -> Text:
        return Text(f"coalesce(get({self.s}, 0), '')", self.d and f"coalesce({self.d}[1], '')", self.flags, self.needs, self.own)

    def size(self) -> Num:
        return Num(f"size({self.s})", self.d and f"len({self.d})", self.flags, self.needs)

    def distinct(self) -> "Many":
        return Many(f"array_distinct({self.s})", self.d and f"list_distinct({self.d})", self.flags, self.needs, self.own)

    def first_by(self, f) -> "Many":
        """The first element for each value of ``f``."""
        v, p, flags = self._lam(f, "key")
        i = f"i{v}"
        s = f"filter({self.s}, ({v}, {i}) -> array_position(transform({self.s}, {v} -> {p.s}), {p.s}) = {i} + 1)"
        d = None if self.d is None or p.d is None else f"list_filter({self.d}, lambda {v}, {i}: list_position(list_transform({self.d}, lambda {v}: {p.d}), {p.d}) = {i})"
        return Many(s, d, flags, self.needs, self.own)

    def overlaps(self, o: "Many") -> Pred:
        return self._join(o, f"arrays_overlap({self.s}, {o.s})", f"list_has_any({self.d}, {o.d})", Pred, needs=both(self.needs, o.needs))

    def same(self, o: "Many") -> Pred:
        return self._join(o, f"({self.s} = {o.s})", f"({self.d} = {o.d})", Pred)

    def text(self, sep: str = " ") -> Text:
        return Text(f"array_join({self.s}, '{sep}')", self.d and f"array_to_string({self.d}, '{sep}')", self.flags, self.needs, self.own and sep.isspace())

    def __add__(self, o: "Many") -> "Many":
        return self._join(o, f"concat({self.s}, {o.s})", f"list_concat({self.d}, {o.d})", Many, needs=either(self.needs, o.needs), own=self.own and o.own)


def lit(s: str) -> Text:
    return Text(_spark_lit(s), _duck_lit(s))


class Pat(Text):
    """A pattern put together from fixed parts and quoted identifiers."""


def near(*parts, i: bool = False) -> Pat:
    """Dynamic pattern: strings are fixed regex parts, columns are matched literally."""
    s, d, flags = [], [], {}
    if i:
        parts = ("(?i)", *parts)
    for p in parts:
        if isinstance(p, Pat):
            s.append(p.s), d.append(p.d)
        elif isinstance(p, Text):
            s += [_spark_lit(r"\Q"), p.s, _spark_lit(r"\E")]
            d += [_duck_lit(r"\Q"), p.d, _duck_lit(r"\E")]
        else:
            s.append(_spark_lit(p)), d.append(None if _no_re2(p) else _duck_lit(p))
        if isinstance(p, Text):
            flags.update(p.flags)
    return Pat(f"concat({', '.join(s)})", None if None in d else f"concat({', '.join(d)})", flags)


def word(x: Text, i: bool = False) -> Pat:
    return near(r"\b", x, r"\b", i=i)


def _col(n: str, own: bool = False) -> Text:
    return Text(n, n, own=own)


name, params, tail, body = (_col(n, own=True) for n in ("name", "params", "tail", "body"))
chain = _col("chain")
lname, ltail = name.lower(), tail.lower()
# Parameters with a name of their own: two words at least, the last one is the name.
named = params.all(r"[^\s,]\s+([A-Za-z_]\w*)\s*(?:,|$)", 1, i=False)
pnames = params.all(r"([A-Za-z_]\w*)[^,\w]*(?:,|$)", 1, i=False)


def _flag(grain: str, p: Pred) -> Pred:
    key = f"{grain}_" + hashlib.sha1(p.s.encode()).hexdigest()[:10]
    return Pred(key, None if p.d is None else key, {key: (grain, p)})


# Needs inside a file-grain flag are about the raw text, of which clean text and functions are parts; a flag's column states none.
_clean, _raw = _col("clean", own=True), _col("raw", own=True)


def in_file(p: str, i: bool = True, raw: bool = False) -> Pred:
    """The file's text (comments blanked unless ``raw``) matches."""
    return _flag("f", (_raw if raw else _clean).has(p, i))


def in_target(p: str, i: bool = True, raw: bool = True) -> Pred:
    """Some file of the target matches. Aggregated per target, joined to hits only."""
    return _flag("t", (_raw if raw else _clean).has(p, i))


def file_pred(p: Pred) -> Pred:
    return _flag("f", p)


def target_pred(p: Pred) -> Pred:
    return _flag("t", p)


def file_text(raw: bool = False) -> Text:
    return _raw if raw else _clean


def count_true(*preds: Pred) -> Num:
    out = preds[0].num()
    for p in preds[1:]:
        out = out + p.num()
    return out


class _Fn:
    """Columns of one element of the file's function array."""

    def __init__(self, v: str):
        self.name, self.params, self.tail, self.body = (Text(f"{v}.{c}", f"{v}.{c}", own=True) for c in ("name", "params", "tail", "body"))


def some_fn(cond) -> Pred:
    """A function of the same file satisfies ``cond``; no shuffle, the array is at hand."""
    v = f"f{next(_var)}"
    p = cond(_Fn(v))
    d = None if p.d is None else f"(len(list_filter(fns, lambda {v}: {p.d})) > 0)"
    return Pred(f"exists(fns, {v} -> {p.s})", d, p.flags, p.needs)


def fn_names(cond) -> Many:
    """Names of the file's functions satisfying ``cond``."""
    v = f"f{next(_var)}"
    p = cond(_Fn(v))
    d = None if p.d is None else f"list_transform(list_filter(fns, lambda {v}: {p.d}), lambda {v}: {v}.name)"
    return Many(f"transform(filter(fns, {v} -> {p.s}), {v} -> {v}.name)", d, p.flags, p.needs, own=True)


def file_many(m: Many) -> Many:
    """Carry a small per-file list to the function rows."""
    key = "f_" + hashlib.sha1(m.s.encode()).hexdigest()[:10]
    return Many(key, None if m.d is None else key, {key: ("f", m)})
