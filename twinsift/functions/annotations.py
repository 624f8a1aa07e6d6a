"""Type annotations as text: splitting, unions, merging of two sides, and the typing names they need."""

from __future__ import annotations

import re

_PAIRS = {"[": "]", "(": ")", "{": "}"}
#: Names of the typing module that an annotation may need.
TYPING = ("Any", "Callable", "ClassVar", "Dict", "Final", "FrozenSet", "Generator", "Iterable", "Iterator", "List", "Literal", "Mapping", "Optional", "Sequence", "Set", "Tuple", "Type", "Union")


def split_outside(text: str, mark: str) -> list[str]:
    """Parts of text between marks that stand in no bracket and no quotes, without blanks around them."""
    parts, closing, quote, now = [], [], "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in _PAIRS:
            closing.append(_PAIRS[c])
        elif closing and c == closing[-1]:
            closing.pop()
        elif c == mark and not closing:
            parts.append(now.strip())
            now = ""
            continue
        now += c
    parts.append(now.strip())
    return [p for p in parts if p]


def members(annotation: str) -> list[str]:
    """The alternatives of an annotation, each once, in their order; Optional and Union are opened."""
    out: list[str] = []
    for part in split_outside(annotation, "|"):
        head, bracket, rest = part.partition("[")
        name = head.strip().rpartition(".")[2]
        if bracket and rest.endswith("]") and name in ("Union", "Optional"):
            inner = [m for x in split_outside(rest[:-1], ",") for m in members(x)]
            found = [*inner, "None"] if name == "Optional" else inner
        else:
            found = ["None" if part == "NoneType" else part]
        out += [m for m in found if m not in out]
    return out


def union_text(annotation: str) -> str:
    """One spelling of a union: alternatives with bars, None last."""
    found = members(annotation)
    return "Any" if "Any" in found else " | ".join([m for m in found if m != "None"] + ["None"] * ("None" in found))


def merged(a: str | None, b: str | None, strategy: str = "fallback_any") -> str:
    """One annotation for values of two: the common one; else a union, or Any."""
    if not a or not b:
        return a or b or "Any"
    x, y = union_text(a), union_text(b)
    if set(members(x)) == set(members(y)):
        return x
    return union_text(f"{x} | {y}") if strategy == "union" else "Any"


def compatible(a: str | None, b: str | None) -> bool:
    """Whether two annotations can stand for one: equal, missing, or Any."""
    return not a or not b or "Any" in (a, b) or set(members(a)) == set(members(b))


def outputs_type(annotations: list[str | None]) -> str:
    """The return annotation of a helper with these outputs."""
    known = [union_text(a) if a else "Any" for a in annotations]
    return "None" if not known else known[0] if len(known) == 1 else f"tuple[{', '.join(known)}]"


def typing_names(annotations) -> list[str]:
    """Names of the typing module in annotations, sorted; those that are reached through a module do not count."""
    used = {n for a in annotations if a for n in re.findall(r"(?<![\w.])[A-Z]\w*", re.sub(r"'[^']*'|\"[^\"]*\"", "", a))}
    return sorted(used & set(TYPING))


def parameters_text(names: list[str], types: dict[str, str | None]) -> str:
    return ", ".join(f"{n}: {types[n]}" if types.get(n) else n for n in names)
