"""Access settings of a service: environment first, then secrets, then a TOML file, then defaults."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from configparser import RawConfigParser
from dataclasses import field, make_dataclass
from pathlib import Path
from typing import Any, NamedTuple

# Paths below the base address that the service defines.
SECURE_TOKEN_PATH = "/secure/sdg/ssis/gatewayoauthtoken/1.0.0/getAccessToken"
OAUTH_TOKEN_PATH = "/oauth/client_credential/accesstoken"
DATA_PATH = "/secure/ddads/openapi/1.0.0"
#: Settings in environment and files are named with this prefix unless another is given.
PREFIX = "MARKET"


class ServiceError(RuntimeError):
    """A service can't be reached, refuses, or isn't configured."""


class Setting(NamedTuple):
    """kind: needed (text that must be there), hidden (the same, and never shown), or a switch."""

    name: str
    kind: str = "needed"
    default: Any = ""

    def parse(self, text: Any) -> Any:
        """A switch is off if the text says so in any usual way, and else on."""
        return RawConfigParser.BOOLEAN_STATES.get(str(text).strip().lower(), True) if self.kind == "switch" else str(text)


#: oauth_only: use the OAuth endpoint alone, as production gateways want.
SETTINGS = (
    Setting("base_url"),
    Setting("security_application_identifier", "hidden"),
    Setting("client_id", "hidden"),
    Setting("client_secret", "hidden"),
    Setting("entity"),
    Setting("dataset"),
    Setting("verify_ssl", "switch", True),
    Setting("oauth_only", "switch", False),
)


class _Service:
    def missing(self) -> list[str]:
        return [s.name for s in SETTINGS if s.kind != "switch" and not getattr(self, s.name)]

    def ensure(self):
        if self.missing():
            raise ServiceError("missing settings: " + ", ".join(self.missing()))
        return self

    def address(self, path: str) -> str:
        return self.base_url.rstrip("/") + path

    @property
    def data_url(self) -> str:
        return self.address("/".join((DATA_PATH, self.entity.strip("/"), self.dataset.strip("/"))))


ServiceConfig = make_dataclass("ServiceConfig", [(s.name, type(s.default), field(default=s.default, repr=s.kind != "hidden")) for s in SETTINGS], bases=(_Service,), frozen=True, module=__name__)


def parse(given: Mapping[str, Any]) -> ServiceConfig:
    """The settings among these names; empty ones count as not given."""
    return ServiceConfig(**{s.name: s.parse(given[s.name]) for s in SETTINGS if given.get(s.name) not in (None, "")})


def _plain(source: Mapping[str, Any], prefix: str) -> dict[str, Any]:
    """What a source says, by lower-case name without the prefix: first its sections named by the prefix, over them what stands at its top."""
    mark = prefix.lower()
    sections = [v for k, v in source.items() if str(k).lower() == mark and isinstance(v, Mapping)]
    return {str(k).lower().removeprefix(f"{mark}_"): v for part in (*sections, source) for k, v in part.items() if v not in (None, "") and not isinstance(v, Mapping)}


def load(secrets: Mapping[str, Any] | None = None, path: str | Path | None = None, prefix: str = PREFIX, environment: Mapping[str, str] = os.environ) -> ServiceConfig:
    stored = tomllib.loads(Path(path).read_text(encoding="utf-8-sig")) if path and Path(path).exists() else {}
    named = {s.name: v for s in SETTINGS if (v := environment.get(f"{prefix}_{s.name}".upper()))}
    return parse(_plain(stored, prefix) | _plain(secrets or {}, prefix) | named)
