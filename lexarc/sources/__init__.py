"""Record readers: files or raw strings to records and postings. ``READERS`` maps a dotted name to a reader; more are added by ``register``."""

from collections.abc import Callable

from .dom import dom_postings, dom_records
from .markup import marc_files, marc_nodes, marcxml_nodes, read_status, sgml_nodes, xml_nodes
from .plain import listing, mail, pretokenised, record_type, text_records
from .regx import rule_records

READERS: dict[str, Callable] = {
    "text": text_records, "pretokenised": pretokenised, "mail": mail, "tree.sgml": sgml_nodes, "tree.xml": xml_nodes, "tree.marc": marc_nodes,
    "tree.marcxml": marcxml_nodes, "tree.rules": rule_records, "marc": marc_files, "dom": dom_postings, "dom.records": dom_records, "alvis": dom_postings,
}


def register(name: str, reader: Callable) -> None:
    """Adds a reader under a dotted name, or replaces one."""
    READERS[name] = reader


def names() -> list[str]:
    return sorted(READERS)


def reader(name: str):
    """The reader with the longest registered prefix of a dotted name, and the rest as its argument."""
    parts = name.split(".")
    for n in range(len(parts), 0, -1):
        if (key := ".".join(parts[:n])) in READERS:
            return READERS[key], ".".join(parts[n:])
    raise KeyError(name)


__all__ = ["READERS", "listing", "mail", "marc_files", "names", "pretokenised", "read_status", "reader", "record_type", "register", "text_records"]
