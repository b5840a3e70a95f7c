"""Where data, models and results lie: below one root, local or shared; a path joined here is only a name."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Folders:
    root: str

    def _below(self, folder: str, parts: tuple[str, ...]) -> str:
        return "/".join((self.root.rstrip("/"), folder, *parts))

    def data(self, *parts: str) -> str:
        return self._below("data", parts)

    def models(self, *parts: str) -> str:
        return self._below("models", parts)

    def results(self, *parts: str) -> str:
        return self._below("results", parts)
