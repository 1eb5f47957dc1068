"""Model formulas: text to terms.

    y ~ cg + cov(age) + animal(id) + pe(id) + random(pen)
    cbind(y1, y2) ~ cg + animal(id)

A bare name is a fixed class. There is always an intercept. Terms that share group= share one covariance
matrix. Python's own parser reads the right-hand side, so there is no grammar of ours to keep.
"""

from __future__ import annotations

import ast
import difflib
from dataclasses import dataclass, field

FIXED, COVARIATE, IID, RELATIONSHIP = "fixed", "covariate", "iid", "relationship"
#: Marker -> kind of term, and the keywords it knows.
MARKERS = {
    "fixed": (FIXED, {"traits"}), "cov": (COVARIATE, {"nested", "traits"}), "random": (IID, {"group", "name", "base", "traits"}), "pe": (IID, {"group", "name", "base", "traits"}),
    "animal": (RELATIONSHIP, {"group", "name", "base", "traits"}), "maternal": (RELATIONSHIP, {"group", "name", "traits"}), "sire": (RELATIONSHIP, {"group", "name", "mgs", "traits"}), "rn": (RELATIONSHIP, {"group", "name", "base", "traits"}),
}


@dataclass(frozen=True)
class Term:
    """One term: its column, and for random ones the name of its group, the columns of its basis and a second column (maternal grandsire)."""

    kind: str
    column: str
    name: str
    group: str = ""
    base: tuple[str, ...] = ()
    nested: str | None = None
    mgs: str | None = None
    traits: tuple[str, ...] = ()

    @property
    def coefficients(self) -> int:
        return max(1, len(self.base))


@dataclass(frozen=True)
class Formula:
    traits: tuple[str, ...]
    terms: tuple[Term, ...] = field(default_factory=tuple)

    @property
    def fixed(self) -> list[Term]:
        return [t for t in self.terms if t.kind in (FIXED, COVARIATE)]

    @property
    def groups(self) -> dict[str, list[Term]]:
        out: dict[str, list[Term]] = {}
        for t in self.terms:
            if t.kind in (IID, RELATIONSHIP):
                out.setdefault(t.group, []).append(t)
        return out

    @property
    def columns(self) -> list[str]:
        """Every column the model reads, once."""
        return list(dict.fromkeys([*self.traits, *(c for t in self.terms for c in (t.column, t.nested, t.mgs, *t.base) if c)]))


def _text(node: ast.expr) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value
    raise ValueError(f"a column name is expected, not {ast.unparse(node)}")


def _names(node: ast.expr) -> tuple[str, ...]:
    if isinstance(node, ast.Call) and _text(node.func) in ("c", "cbind"):
        return tuple(map(_text, node.args))
    if isinstance(node, (ast.Tuple, ast.List)):
        return tuple(map(_text, node.elts))
    return (_text(node),)


def _summands(node: ast.expr) -> list[ast.expr]:
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        return _summands(node.left) + _summands(node.right)
    if isinstance(node, (ast.BinOp, ast.UnaryOp)):
        raise ValueError(f"{ast.unparse(node)}: only sums of terms; make interactions a column, and leave the intercept in")
    return [node]


def _term(node: ast.expr) -> Term | None:
    if isinstance(node, ast.Constant):
        if node.value == 1:
            return None
        raise ValueError("the intercept cannot be left out")
    if isinstance(node, ast.Name):
        return Term(FIXED, node.id, node.id)
    if not isinstance(node, ast.Call):
        raise ValueError(f"no term: {ast.unparse(node)}")
    marker = _text(node.func)
    if marker not in MARKERS:
        near = difflib.get_close_matches(marker, MARKERS, 1)
        raise ValueError(f"no marker {marker}()" + (f"; did you mean {near[0]}()?" if near else ""))
    kind, known = MARKERS[marker]
    given = {}
    for k in node.keywords:
        if k.arg not in known:
            near = difflib.get_close_matches(str(k.arg), known, 1)
            raise ValueError(f"{marker}() knows no {k.arg}" + (f"; did you mean {near[0]}?" if near else ""))
        given[k.arg] = _names(k.value)
    if len(node.args) != 1:
        raise ValueError(f"{marker}() takes one column")
    column = _text(node.args[0])
    one = lambda key: given[key][0] if key in given else None
    name = one("name") or (marker if kind in (IID, RELATIONSHIP) and marker not in ("random", "pe") else column if kind not in (IID,) else f"{marker}_{column}" if marker == "pe" else column)
    return Term(kind, column, name, one("group") or (name if kind in (IID, RELATIONSHIP) else ""), given.get("base", ()), one("nested"), one("mgs"), given.get("traits", ()))


def parse(formula: str) -> Formula:
    left, tilde, right = formula.partition("~")
    if not tilde:
        raise ValueError("a formula has the form y ~ terms")
    traits = _names(ast.parse(left.strip(), mode="eval").body)
    terms = [t for t in map(_term, _summands(ast.parse(right.strip(), mode="eval").body)) if t]
    names = [t.name for t in terms]
    if twice := {n for n in names if names.count(n) > 1}:
        raise ValueError(f"terms that share a name need name=: {sorted(twice)}")
    return Formula(traits, tuple(terms))
