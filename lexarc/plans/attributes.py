"""Attributes of a term: which index, which field type, which strategy."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .prefix import Apt, Diagnostic

#: Public use attributes by number.
USE = {1: "personal-name", 2: "corporate-name", 4: "title", 5: "title-series", 7: "isbn", 8: "issn", 12: "local-number", 21: "subject", 30: "date", 31: "publication-date", 33: "key-title", 35: "parallel-title", 54: "code-language", 59: "place", 62: "abstract", 63: "note", 1002: "name", 1003: "author", 1010: "body", 1011: "date-added", 1012: "date-modified", 1016: "any", 1018: "publisher", 1031: "material-type", 1035: "anywhere"}
LISTED = {3, 6, 9, 10, 13, 14, 32, 58, 60, 61}  # known numbers that no index here serves
SETS = ("bib-1", "bib1", "exp-1", "gils", "1.2.840.10003.3.1")


@dataclass(frozen=True)
class Leaf:
    """What a term asks for."""

    index: str
    kind: str
    strategy: str  # phrase, and-list, or-list, numeric, local
    relation: int
    truncation: int
    position: int
    ranked: bool
    weight: int
    most_terms: int | None
    always: bool
    nothing: bool = False
    xpath: bool = False
    hit_limit: int | None = None
    repeated: bool = False


def resolve(apt: Apt) -> Leaf:
    number = {t: int(v) if (v or "").lstrip("-").isdigit() else v for t in range(2, 15) if (v := apt.get(t)) is not None}
    use, nothing = apt.get(1) or "any", False
    if apt.attribute_set(1).lower() not in SETS:
        raise Diagnostic(121, apt.attribute_set(1))
    if use.isdigit():
        if int(use) in USE:
            use = USE[int(use)]
        elif int(use) in LISTED and number.get(14) == 1:
            use, nothing = "any", True
        else:
            raise Diagnostic(114, use)
    elif not use.startswith("/") and not re.fullmatch(r"[\w.:-]+", use):
        raise Diagnostic(114, use)
    structure, complete = number.get(4, -1), number.get(6, 1)
    kind, strategy = ("p" if complete in (2, 3) else "w"), "phrase"
    if structure == 109:
        kind, strategy = "n", "numeric"
    elif structure == 104:
        kind = "u"
    elif structure == 3:
        kind = "0"
    elif structure == 4:
        kind = "y"
    elif structure == 5:
        kind = "d"
    elif structure == 6:
        strategy = "and-list"
    elif structure in (105, 106):
        strategy = "or-list"
    elif structure == 107:
        strategy = "local"
    elif structure == "sm":
        kind = "s"
    elif isinstance(structure, str):
        kind = structure
    elif structure not in (-1, 1, 2, 101, 108):
        raise Diagnostic(118, str(structure))
    relation = number.get(2, 3)
    if relation not in (1, 2, 3, 4, 5, 102, 103):
        raise Diagnostic(117, str(relation))
    truncation = number.get(5, 100)
    if truncation not in (1, 2, 3, 100, 101, 102, 103, 104, 105, 106):
        raise Diagnostic(120, str(truncation))
    position = number.get(3, 3)
    if position not in (1, 2, 3):
        raise Diagnostic(119, str(position))
    if 8 in number:
        raise Diagnostic(22, "a term set limits scans only")
    return Leaf(use, kind, strategy, relation, truncation, position, relation == 102, number.get(9, 34), number.get(13), relation == 103, nothing, use.startswith("/"), number.get(12) or number.get(11), structure == "sm")
