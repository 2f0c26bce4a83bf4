"""Session context: tenant and metadata defaults, with their merge rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from typing import Any

from .errors import TenantRequired

SINGLE, SCHEMA_PER_TENANT, CONJOINED = "single", "schema_per_tenant", "conjoined"


def tenant_schema(tenant: str) -> str:
    """The namespace of a tenant."""
    return "tenant_" + re.sub(r"[^A-Za-z0-9_]", "_", tenant).lower()


def lock_key(text: str) -> int:
    """The 64-bit FNV-1a hash of a name as a signed number."""
    h = 0xCBF29CE484222325
    for byte in text.encode():
        h = (h ^ byte) * 0x100000001B3 % (1 << 64)
    return h - (1 << 64) if h >> 63 else h


@dataclass(frozen=True)
class Context:
    tenant: str | None = None
    headers: dict[str, Any] = field(default_factory=dict)
    causation_id: str | None = None
    correlation_id: str | None = None
    user_id: str | None = None
    include_archived: bool = False

    def merged(self, other: Context | None) -> Context:
        """Headers merge by key, ids of `other` win, the archive flag is ORed."""
        if other is None:
            return self
        return replace(
            self,
            tenant=other.tenant or self.tenant,
            headers=self.headers | other.headers,
            causation_id=other.causation_id or self.causation_id,
            correlation_id=other.correlation_id or self.correlation_id,
            user_id=other.user_id or self.user_id,
            include_archived=self.include_archived or other.include_archived,
        )


def required_tenant(mode: str, tenant: str | None) -> str | None:
    """The tenant, or None where the mode has none."""
    if mode == SINGLE:
        return None
    if tenant is None:
        raise TenantRequired(f"tenancy mode {mode} needs a tenant")
    return tenant
