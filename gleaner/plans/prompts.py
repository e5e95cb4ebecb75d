"""Prompts as files: a YAML head with id, version and required variables, and a template."""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass
from string import Template


@dataclass(frozen=True)
class PromptFile:
    prompt_id: str
    version: str
    required: tuple[str, ...]
    body: str

    @property
    def sha256(self) -> str:
        return hashlib.sha256(self.body.encode()).hexdigest()

    def render(self, **values) -> str:
        """The body with its ``${names}`` filled in; all required ones must be given."""
        if lost := sorted(set(self.required) - set(values)):
            raise ValueError(f"{self.prompt_id}: no value for {', '.join(lost)}")
        return Template(self.body).substitute({k: str(v) for k, v in values.items()})


def read(path: str) -> PromptFile:
    import yaml

    with open(path, encoding="utf-8") as f:
        text = f.read()
    head, mark, body = text.removeprefix("---\n").partition("\n---\n") if text.startswith("---\n") else ("", "-", text)
    if not mark:
        raise ValueError(f"{path}: the head is not closed")
    meta = yaml.safe_load(head) or {}
    name = os.path.splitext(os.path.basename(path))[0]
    return PromptFile(str(meta.get("prompt_id", name)), str(meta.get("version", "1")), tuple(meta.get("required_variables") or ()), body.strip())


class Prompts(dict):
    """Prompts of a folder by id; two of one id are an error."""

    @classmethod
    def of(cls, folder: str) -> Prompts:
        out = cls()
        for name in sorted(os.listdir(folder)):
            if name.endswith(".md"):
                p = read(os.path.join(folder, name))
                if p.prompt_id in out:
                    raise ValueError(f"{p.prompt_id} is there twice")
                out[p.prompt_id] = p
        return out

    def __missing__(self, prompt_id: str):
        raise KeyError(f"no prompt {prompt_id}")

    def inventory(self) -> list[dict]:
        return [{"prompt_id": p.prompt_id, "version": p.version, "sha256": p.sha256, "required_variables": list(p.required)} for _, p in sorted(self.items())]

    def trace(self, *ids: str) -> dict:
        """What identifies an answer's prompts together: the digest of their digests."""
        used = [self[i] for i in ids]
        return {"messages": [{"prompt_id": p.prompt_id, "version": p.version, "sha256": p.sha256} for p in used], "combined_sha256": hashlib.sha256("\n".join(p.sha256 for p in used).encode()).hexdigest()}
