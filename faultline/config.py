"""Limits of a run and the target it looks at, as arguments of the operators."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Target:
    name: str
    source_root: str
    build_dir: str | None = None
    fuzz_targets: tuple[str, ...] = ()
    harness_globs: tuple[str, ...] = ()

    @property
    def fuzz_target(self) -> str | None:
        return self.fuzz_targets[0] if self.fuzz_targets else None


@dataclass(frozen=True)
class Limits:
    """The defaults that recorded runs were made under."""

    llm_calls: int = 20
    findings: int = 50
    tokens: int = 32_000
    findings_per_file: int = 3
    patch_tokens: int = 100_000
    patches: int = 25
    calls_per_patch: int = 5
    retries: int = 2
    context_lines: int = 50
    crashes_per_bucket: int = 5
    snippet_lines: int = 200
    max_files: int | None = None


@dataclass(frozen=True)
class Run:
    target: Target
    limits: Limits = field(default_factory=Limits)
