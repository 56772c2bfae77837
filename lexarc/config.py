"""Settings in layers: defaults, files, a group's own."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

#: Settings that are known, with their defaults; a dot and a group's name in front make one of the group.
KNOWN = {
    "recordType": "text", "recordId": "", "database": "Default", "storeData": "1", "storeKeys": "1", "encoding": "utf-8", "rank": "rank-1", "sortmax": "1000", "truncmax": "0",
    "estimatehits": "0", "facetNumRecs": "10", "facetMaxChunks": "2", "fileVerboseLimit": "1000", "followLinks": "1", "register": "", "shadow": "", "openRW": "1", "perm": "", "mapdb": "",
}


@dataclass
class Config:
    values: dict[str, str] = field(default_factory=dict)
    parent: Config | None = None

    @staticmethod
    def parse(text: str, parent: Config | None = None) -> Config:
        """Lines ``name: value``; ``${X}`` is taken from the environment; ``#`` begins a comment."""
        out = Config(parent=parent)
        for line in text.splitlines():
            m = re.match(r"\s*([\w.]+)\s*:\s*(.*?)\s*$", line.partition("#")[0])
            if m:
                out.values[m[1]] = re.sub(r"\$\{(\w+)\}", lambda v: os.environ.get(v[1], ""), m[2])
        return out

    def get(self, name: str, group: str | None = None, default: str | None = None) -> str | None:
        """The group's own value, else the general one, else the outer layer's, else the default."""
        for key in ([f"{group}.{name}"] if group else []) + [name]:
            if key in self.values:
                return self.values[key]
        if self.parent:
            return self.parent.get(name, group, default)
        return KNOWN.get(name, default) if default is None else default

    def set(self, name: str, value: str) -> None:
        self.values[name] = value

    def unknown(self) -> list[str]:
        """Names that mean nothing, to warn of."""
        return sorted(n for n in self.values if n.rpartition(".")[2] not in KNOWN and n.split(".")[0] not in KNOWN and (n.split(".") + [""])[1] not in KNOWN)

    def record_type(self, path: str, group: str | None = None) -> str:
        ending = path.rpartition(".")[2].lower()
        return self.get(f"recordType.{ending}", group) or self.get("recordType", group) or "text"

    def aliases(self) -> dict[str, list[str]]:
        """``mapdb: name db1 db2, name2 db3``."""
        return {words[0]: words[1:] for words in (x.split() for x in (self.get("mapdb") or "").split(",")) if len(words) > 1}
