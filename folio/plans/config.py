"""Run and correction settings, resolved on the driver."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path

from folio.operators.correct import Guard

PROVIDERS = ("none", "table", "model")
OUTPUT_MODES = ("sidecar", "primary_artifacts")


@dataclass(frozen=True)
class Profile:
    provider: str = "none"
    auth_ref: str | None = None
    model: str | None = None
    mode: str = "sidecar"
    timeout_seconds: int = 120
    page_batch_size: int = 1
    temperature: float | None = None
    guard: Guard = field(default_factory=Guard)


@dataclass(frozen=True)
class Override:
    """Fields that replace a profile's; ``None`` leaves them, zero does not."""

    provider: str | None = None
    mode: str | None = None
    timeout_seconds: int | None = None
    temperature: float | None = None
    model: str | None = None


@dataclass(frozen=True)
class Config:
    version: str = "v1alpha1"
    credentials: dict[str, str] = field(default_factory=dict)
    profiles: dict[str, Profile] = field(default_factory=dict)
    runtime_profile: str | None = None
    runtime_override: Override = field(default_factory=Override)
    allow_remote: bool = True


def resolve(config: Config, requested: str | None = None, override: Override | None = None) -> Profile:
    """The profile by request, by the runtime setting, or the only one; then the overrides, the caller's last."""
    if config.version != "v1alpha1":
        raise ValueError(f"unknown config version {config.version!r}")
    for name, profile in config.profiles.items():
        if name in PROVIDERS:
            raise ValueError(f"profile {name!r} has the name of a provider")
        if profile.auth_ref and profile.auth_ref not in config.credentials:
            raise ValueError(f"profile {name!r} names an unknown credential {profile.auth_ref!r}")
    if requested in config.profiles:
        chosen = config.profiles[requested]
    elif config.runtime_profile:
        if config.runtime_profile not in config.profiles:
            raise ValueError(f"unknown profile {config.runtime_profile!r}")
        chosen = config.profiles[config.runtime_profile]
    elif len(config.profiles) == 1:
        chosen = next(iter(config.profiles.values()))
    elif config.profiles and requested is None:
        raise ValueError("several profiles and none selected")
    else:
        chosen = Profile()
    for o in (config.runtime_override, override or Override()):
        chosen = replace(chosen, **{k: v for k, v in vars(o).items() if v is not None})
    if requested in PROVIDERS:
        chosen = replace(chosen, provider=requested)
    if chosen.provider not in PROVIDERS:
        raise ValueError(f"unsupported provider {chosen.provider!r}")
    if chosen.mode not in OUTPUT_MODES:
        raise ValueError(f"unsupported output mode {chosen.mode!r}")
    return replace(chosen, guard=chosen.guard.resolved())


def allow_remote(config: Config, profile: Profile, flag: bool) -> None:
    """A remote provider needs the flag and must not be forbidden by the config."""
    if profile.provider != "model":
        return
    if not config.allow_remote:
        raise PermissionError("the config forbids remote correction")
    if not flag:
        raise PermissionError("remote correction needs the allow_remote flag")


#: Where a config is looked for when no path is given, and what settings fall back to.
CONFIG_VARIABLE, MODEL_VARIABLE, TIMEOUT_VARIABLE = "FOLIO_CONFIG", "FOLIO_MODEL", "FOLIO_TIMEOUT_SECONDS"
DEFAULT_TIMEOUT = 120


def load(path: str | None = None, environ: Mapping[str, str] = os.environ) -> Config:
    """The config at ``path``, else where the environment says, else an empty one."""
    path = path or environ.get(CONFIG_VARIABLE, "").strip()
    if not path:
        return Config()
    raw = json.loads(Path(path).read_text())
    guard = lambda d: Guard(**d) if d is not None else Guard()
    profiles = {k: Profile(**{**v, "guard": guard(v.get("guard"))}) for k, v in raw.get("profiles", {}).items()}
    return Config(raw.get("version", ""), raw.get("credentials", {}), profiles, raw.get("runtime_profile"), Override(**raw.get("runtime_override", {})), raw.get("allow_remote", True))


def with_defaults(profile: Profile, environ: Mapping[str, str] = os.environ) -> Profile:
    """Model and timeout from the profile, else from the environment, else fixed ones; a guard that protects nothing becomes the default."""
    timeout = profile.timeout_seconds or int(environ.get(TIMEOUT_VARIABLE, "0") or 0) or DEFAULT_TIMEOUT
    return replace(profile, model=profile.model or environ.get(MODEL_VARIABLE) or None, timeout_seconds=timeout, page_batch_size=max(1, profile.page_batch_size), guard=profile.guard.resolved())


def check_pdf(path: str) -> None:
    if not path.lower().endswith(".pdf"):
        raise ValueError(f"input file must be .pdf: {path}")


def check_run(input_path: str, workers: int = 1, retries: int = 0) -> None:
    if not input_path:
        raise ValueError("input path is required")
    if workers < 1:
        raise ValueError("workers must be at least 1")
    if retries < 0:
        raise ValueError("retries must not be negative")


def output_mode(requested: str, can_rebuild: bool) -> tuple[str, list[str]]:
    """Rebuilding primary artifacts needs a provider that can; otherwise a sidecar and a warning."""
    if requested == "primary_artifacts" and not can_rebuild:
        return "sidecar", ["primary_artifacts_not_supported_by_provider"]
    return requested, []
