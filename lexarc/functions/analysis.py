"""Field types and analysers: a text column becomes an array of terms.

The default analyser lower-cases and splits at one explicit class of ASCII separators, keeping every
other letter. A character map (``Charmap``) replaces it where order-preserving terms, multi-character
rewrites, cut marks or query-time equivalents are wanted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = r"[\x01-\x20!-/:-@\[-\x60{-~]+"
NUMERIC = r"[^0-9.,\-]+"
CONTROL = r"[\x01-\x20]+"
SIMPLE = r"[;,.()\-/?<> \r\n\t]+"
#: Words of the ICU chain, and the collation under which they are compared.
ICU_WORD, ICU = r"[\p{L}\p{M}\p{N}]+", "UNICODE_CI_AI"
#: Bytes of a query term at most.
MOST_QUERY_TERM = 511
FIRST_MARK = "\x01^"
#: What a strict character map makes of each byte of a character that it does not know.
UNKNOWN = "\ufffd"


@dataclass(frozen=True)
class FieldType:
    """How one index type makes terms.

    complete: the whole field is one term; separators: None for no analysis; fold: letters become small ones; icu: terms
    are compared without case and accents; most: characters after which a term is cut, none by default.
    """

    code: str
    complete: bool = False
    first_in_field: bool = False
    always_matches: bool = False
    separators: str | None = SEPARATORS
    sort: bool = False
    charmap: Charmap | None = None
    fold: bool = True
    icu: bool = False
    most: int | None = None


@dataclass(frozen=True)
class Charmap:
    """Character rules: lower and upper list the value set in collation order."""

    lower: str = "0123456789abcdefghijklmnopqrstuvwxyzüæäøöå"
    upper: str = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZÜÆÄØÖÅ"
    space: str = " \t\r\n!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    cut: str = ""
    maps: tuple[tuple[str, str], ...] = ()
    equivalent: tuple[str, ...] = ()
    strict: bool = False  # every byte of an unmapped character becomes UNKNOWN

    @staticmethod
    def parse(text: str) -> Charmap:
        """From lines ``lowercase …``, ``uppercase …``, ``space …``, ``cut …``, ``map (from) to``, ``equivalent …``; ranges as a-z."""

        def chars(spec: str) -> str:
            spec = (
                re
                .sub(r"\\x([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), spec)
                .replace("\\s", " ")
                .replace("\\t", "\t")
                .replace("\\n", "\n")
                .replace("\\r", "\r")
            )
            spec = re.sub(r"\{?(.)-(.)\}?", lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))), spec)
            return re.sub(r"[{}]", "", spec)

        got: dict = {"maps": [], "equivalent": []}
        for line in text.splitlines():
            word, _, rest = line.partition("#")[0].strip().partition(" ")
            rest = rest.strip()
            if word in ("lowercase", "uppercase", "space", "cut"):
                got[{"lowercase": "lower", "uppercase": "upper"}.get(word, word)] = chars(rest)
            elif word == "map" and (m := re.fullmatch(r"\((.+?)\)\s*(.*)|(\S)\s+(.*)", rest)):
                got["maps"].append((m[1] or m[3], (m[2] if m[1] else m[4]).replace("@", "")))
            elif word == "equivalent":
                got["equivalent"].append(chars(rest))
        return Charmap(**{k: tuple(v) if isinstance(v, list) else v for k, v in got.items()})

    def _maps(self) -> list[tuple[str, str, bool]]:
        """(from, to, only at the start of a field), longest first; case is folded before maps apply."""
        table = str.maketrans(self.upper, self.lower)
        out = [(s[1:], t, True) if s.startswith("^") and len(s) > 1 else (s, t, False) for s, t in self.maps]
        return sorted(((s.translate(table), t, first) for s, t, first in out), key=lambda m: (-len(m[0]), not m[2]))

    def mapped(self, text: Column) -> Column:
        """The text with capitals folded onto small letters, then maps applied, ``^x`` only at its start."""
        text = F.translate(text, self.upper, self.lower)
        for source, target, first in self._maps():
            text = F.regexp_replace(text, "^" + re.escape(source), target) if first else F.replace(text, F.lit(source), F.lit(target))
        if self.strict:
            known = "".join(re.escape(c) for c in self.lower + self.space + self.cut)
            for size, (low, high) in enumerate((("\x00", "\x7f"), ("\x80", "\u07ff"), ("\u0800", "\uffff"), ("\U00010000", "\U0010ffff")), 1):
                text = F.regexp_replace(text, f"[{low}-{high}&&[^{known}{UNKNOWN}]]", UNKNOWN * size)
        if self.cut:
            text = F.regexp_replace(text, f"^.*[{''.join(map(re.escape, self.cut))}]", "")
        return text

    def mapped_text(self, text: str) -> str:
        """The same on the driver, for query terms."""
        text = text.translate(str.maketrans(self.upper, self.lower))
        for source, target, first in self._maps():
            text = target + text[len(source) :] if first and text.startswith(source) else text if first else text.replace(source, target)
        if self.strict:
            text = "".join(c if c in self.lower + self.space + self.cut + UNKNOWN else UNKNOWN * len(c.encode()) for c in text)
        return re.split(f"[{''.join(map(re.escape, self.cut))}]", text)[-1] if self.cut else text

    @property
    def separators(self) -> str:
        return f"[{''.join(map(re.escape, self.space))}\\x00-\\x20]+"

    def collated(self, text: Column) -> Column:
        """Order-preserving: the n-th letter of the value set becomes code point 256 + n."""
        order = "".join(chr(256 + i) for i in range(len(self.lower)))
        return F.translate(text, self.lower, order)

    def alternatives(self, term: str) -> str | None:
        """A pattern that matches the term with equivalent characters exchanged; None where it has none."""
        sets = {c: e for e in self.equivalent for c in e}
        if not set(term) & set(sets):
            return None
        return "".join(f"[{re.escape(sets[c])}]" if c in sets else re.escape(c) for c in term)


FIELD_TYPES: dict[str, FieldType] = {
    t.code: t
    for t in (
        FieldType("w", first_in_field=True, always_matches=True),
        FieldType("p", complete=True, first_in_field=True),
        FieldType("u", separators=CONTROL),
        FieldType("n", separators=NUMERIC),
        FieldType("0", complete=True, separators=None),
        FieldType("y", complete=True, separators=None),
        FieldType("d", complete=True, separators=None),
        FieldType("s", complete=True, sort=True),
        FieldType("icu", icu=True, first_in_field=True, always_matches=True),
        FieldType("simple", separators=SIMPLE),
    )
}


def normalised(text: Column, kind: FieldType) -> Column:
    """The text as its terms are spelt, before it is split."""
    if kind.separators is None:
        return text
    if kind.charmap:
        text = kind.charmap.mapped(text) if kind.fold else text
        return kind.charmap.collated(text) if kind.sort else text
    return F.lower(text) if kind.fold else text


def terms(text: Column, kind: FieldType) -> Column:
    """Array of the terms of a field, in order; null and blank texts give an empty array."""
    norm = normalised(text, kind)
    seps = kind.charmap.separators if kind.charmap else kind.separators
    if kind.icu:
        out = F.regexp_extract_all(norm, F.lit(ICU_WORD), F.lit(0))
    elif seps is None:
        out = F.filter(F.array(norm), lambda x: x != "")
    elif kind.complete:
        out = F.filter(F.array(F.trim(F.regexp_replace(norm, seps, " "))), lambda x: x != "")
    else:
        out = F.filter(F.split(norm, seps), lambda x: x != "")
    out = F.transform(out, lambda x: F.substring(x, 1, kind.most)) if kind.most else out
    return F.coalesce(out, F.array().cast("array<string>"))


def query_terms(text: str, kind: FieldType) -> list[str]:
    """The same analysis of a query term, on the driver."""
    if kind.separators is None:
        return [text] if text else []
    if kind.icu:
        return re.findall(r"[^\W_]+", text.lower())
    if kind.charmap:
        text, seps = kind.charmap.mapped_text(text), kind.charmap.separators
    else:
        text, seps = text.lower() if kind.fold else text, kind.separators
    if kind.complete:
        text = re.sub(seps, " ", text).strip()
        return [text] if text else []
    return [x for x in re.split(seps, text) if x]
