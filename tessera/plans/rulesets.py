"""Named rule sets in a folder of YAML files, one of them active."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

import yaml

from ..rules import RuleSet, default_rules, list_rules, rules_from, validate_rule

BUILT_IN = "builtin"


class RuleSets:
    """folder: TESSERA_RULESETS_DIR or ~/.tessera/rulesets. The built-in set can be read and made active only."""

    def __init__(self, folder: str | Path | None = None):
        self.folder = Path(folder or os.environ.get("TESSERA_RULESETS_DIR") or Path.home() / ".tessera" / "rulesets")

    def _file(self, name: str) -> Path:
        if not name or name != Path(name).name or name.startswith("."):
            raise ValueError(f"bad rule set name {name!r}")
        return self.folder / f"{name}.yaml"

    def _write(self, path: Path, text: str) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        fd, tmp = tempfile.mkstemp(dir=self.folder)
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(tmp, path)

    def names(self) -> list[str]:
        return [BUILT_IN, *sorted(p.stem for p in self.folder.glob("*.yaml"))]

    def save(self, name: str, rule_defs: dict[str, dict]) -> None:
        if name == BUILT_IN:
            raise ValueError("the built-in rule set is read-only")
        wrong = [w for n, raw in rule_defs.items() for w in validate_rule(n, raw)]
        if wrong:
            raise ValueError("; ".join(wrong))
        self._write(self._file(name), yaml.safe_dump({"rule_defs": rule_defs}, allow_unicode=True, sort_keys=False))

    def raw(self, name: str) -> dict:
        if name == BUILT_IN:
            return {}
        if not self._file(name).exists():
            raise FileNotFoundError(f"no rule set {name!r}")
        return yaml.safe_load(self._file(name).read_text("utf-8")) or {}

    def load(self, name: str | None = None) -> RuleSet:
        """The saved rules over the built-in ones, always with the default mapping."""
        data = self.raw(name or self.current())
        return RuleSet(rules_from({"rule_defs": data.get("rule_defs")}).rules, default_rules().specs)

    def info(self, name: str) -> dict:
        own = self.raw(name).get("rule_defs") or {}
        return {"name": name, "rules": len(self.load(name).rules), "own_rules": len(own), "version": self.load(name).version, "active": name == self.current()}

    def current(self) -> str:
        said = os.environ.get("TESSERA_RULESET")
        mark = self.folder / "current"
        name = said or (mark.read_text("utf-8").strip() if mark.exists() else BUILT_IN)
        return name if name in self.names() else BUILT_IN

    def switch(self, name: str) -> None:
        if name not in self.names():
            raise FileNotFoundError(f"no rule set {name!r}")
        self._write(self.folder / "current", name)

    def delete(self, name: str) -> None:
        if name == BUILT_IN or name == self.current():
            raise ValueError("neither the built-in nor the active rule set can be deleted")
        if not self._file(name).exists():
            raise FileNotFoundError(f"no rule set {name!r}")
        self._file(name).unlink()

    def export(self, name: str, path: str | Path) -> None:
        Path(path).write_text(yaml.safe_dump(self.raw(name), allow_unicode=True, sort_keys=False), "utf-8")

    def take(self, path: str | Path, name: str | None = None) -> str:
        """Import a file and make it the active set."""
        data = yaml.safe_load(Path(path).read_text("utf-8")) or {}
        name = name or Path(path).stem
        self.save(name, data.get("rule_defs") or {})
        self.switch(name)
        return name

    def migrate(self, path: str | Path, name: str = "mine") -> str | None:
        """Make an old single file of own rules the set `name` and put the file aside as .bak, so that this happens once.
        No file: nothing happens. A file without rules, or that is no YAML, is put aside without a set. Rules that
        are not valid, and a set of that name that is already there, are a ValueError, and the file stays."""
        old = Path(path)
        if not old.exists():
            return None
        try:
            data = yaml.safe_load(old.read_text("utf-8"))
        except (yaml.YAMLError, UnicodeDecodeError):
            data = None
        own = (data.get("rule_defs") if isinstance(data, dict) else None) or {}
        if own:
            if name in self.names():
                raise ValueError(f"there is a rule set {name!r} already")
            self.save(name, own)
        old.rename(old.with_suffix(".bak"))
        return name if own else None

    def shown(self, name: str | None = None) -> list[dict]:
        return list_rules(self.load(name))


def generate_rules(ask, sample: str) -> str:
    """Rules as YAML from a language model: ask(prompt) -> text, which the caller supplies. Fences are stripped and
    the rules are validated before they are returned."""
    from ..rules import parse_rules

    prompt = (
        "Write YAML with a mapping rule_defs of masking rules (each with match, a regular expression; mask and pseudo, templates of "
        "{first} {last} {head:N} {tail:N} {prefix} {digits} {hash:8}) for the sensitive values in this text:\n" + sample
    )
    text = ask(prompt).strip()
    if text.startswith("```"):
        text = text.split("\n", 1)[1].rsplit("```", 1)[0]
    parse_rules(text)
    return text
