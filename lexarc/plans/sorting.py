"""Sort specifications: Z39.50 style ``1=4 <i``, and SRU sort keys."""

from __future__ import annotations

from ..operators.ranking import SortKey
from .attributes import resolve
from .prefix import Apt, Diagnostic, joined


def sort_spec(text: str) -> list[SortKey]:
    """Pairs of a key and flags: ``1=4,4=109 >`` or ``title <``; < and a ascend, > and d descend, m takes the least or greatest
    of several values. Flags of case (i, s) and of missing values (!, ``=value``) change nothing: keys are folded, missing ones come first.
    """
    words, out = text.split(), []
    if len(words) % 2 or not words:
        raise Diagnostic(207, text)
    for key, flags in zip(words[::2], words[1::2]):
        attrs = tuple(("bib-1", int(t), v) for t, _, v in (a.partition("=") for a in key.split(",")) if t.isdigit() and v) if "=" in key else (("bib-1", 1, key),)
        if not attrs or not set(flags.partition("=")[0]) <= set("<>adism!n"):
            raise Diagnostic(207, f"{key} {flags}")
        own = resolve(Apt("", attrs))
        out.append(SortKey(own.index, bool(set(flags) & set(">d")), own.strategy == "numeric" or "n" in flags, own.repeated or "m" in flags))
    return out


def with_sort_leaves(tree: object, sortkeys: str) -> object:
    """SRU's ``path,schema,ascending,caseSensitive,missing`` keys, one after the other, as sort leaves of the query."""
    for n, key in enumerate(sortkeys.split()):
        path, _, rest = key.partition(",")
        ascending = ([*rest.split(","), "", ""])[1]
        if not path or n > 9:
            raise Diagnostic(207, key)
        tree = joined("or", tree, Apt(str(n), (("bib-1", 7, "2" if ascending in ("0", "false") else "1"), ("bib-1", 1, path))))
    return tree
