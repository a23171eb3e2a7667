"""Prefixes and the IRIs they stand for."""

from __future__ import annotations

import re


class Namespaces:
    """A two-way map of prefixes and namespace IRIs."""

    def __init__(self, prefixes: dict[str, str] | None = None) -> None:
        self.by_prefix: dict[str, str] = {}
        self.by_iri: dict[str, str] = {}
        for p, ns in (prefixes or {}).items():
            self.add(p, ns)

    def add(self, prefix: str, namespace: str) -> None:
        """Binds a prefix; a later binding replaces an earlier one."""
        if not namespace:
            raise ValueError("a namespace cannot be empty")
        old = self.by_prefix.get(prefix)
        if old is not None and self.by_iri.get(old) == prefix:
            del self.by_iri[old]
        self.by_prefix[prefix], self.by_iri[namespace] = namespace, prefix

    def resolve(self, name: str) -> str:
        """The IRI of prefix:local."""
        prefix, colon, local = name.partition(":")
        if not colon or prefix not in self.by_prefix:
            raise KeyError(f"unknown prefix in {name}")
        return self.by_prefix[prefix] + local

    @staticmethod
    def split(iri: str) -> tuple[str, str] | None:
        """Namespace and local name, parted after the last # or, without one, the last /."""
        at = iri.rfind("#") if "#" in iri else iri.rfind("/")
        return (iri[: at + 1], iri[at + 1 :]) if at >= 0 else None

    def normalize(self, iri: str) -> str | None:
        """prefix:local if a bound namespace allows it, else None."""
        parts = self.split(iri)
        if parts and parts[0] in self.by_iri and re.fullmatch(r"[A-Za-z_][\w-]*|", parts[1]):
            return f"{self.by_iri[parts[0]]}:{parts[1]}"
        return None

    def auto(self, iri: str) -> str | None:
        """Like normalize(), binding a new prefix ns1, ns2, ... where needed."""
        parts = self.split(iri)
        if parts and parts[0] not in self.by_iri and re.fullmatch(r"[A-Za-z_][\w-]*", parts[1]):
            n = 1
            while f"ns{n}" in self.by_prefix:
                n += 1
            self.add(f"ns{n}", parts[0])
        return self.normalize(iri)

    def copy(self) -> Namespaces:
        return Namespaces(dict(self.by_prefix))
