"""Values from the environment and names of runs; plain Python for the driver."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Mapping
from datetime import UTC, datetime

from .policy import DEFAULT, Policy


def split_list(value: str | None, lower: bool = False) -> tuple[str, ...]:
    """Values between commas, each once, in order."""
    words = (w.strip() for w in (value or "").split(","))
    return tuple(dict.fromkeys(w.lower() if lower else w for w in words if w))


def int_list(value: str | None) -> tuple[int, ...]:
    """The whole numbers between commas, each once, in order; the rest is skipped."""
    return tuple(dict.fromkeys(int(w) for w in split_list(value) if re.fullmatch(r"[+-]?\d+", w)))


def as_bool(value: str | None, default: bool = False) -> bool:
    word = (value or "").strip().lower()
    return word not in ("0", "false", "off", "no") if word else default


def as_int(value: str | None, default: int | None = None) -> int | None:
    word = (value or "").strip()
    return int(word) if re.fullmatch(r"[+-]?\d+", word) else default


def normalize_set(domains: Iterable[str], policy: Policy = DEFAULT) -> frozenset[str]:
    """Normalised domains, empty ones apart; functions.urls.normalize_domain() of each."""

    def one(d: str) -> str:
        low = (d or "").strip().rstrip(".").lower()
        first, _, rest = low.partition(".")
        return rest if first in policy.strip_labels and "." in rest else low

    return frozenset(n for d in domains if (n := one(d)))


def run_id(now: datetime | None = None, tag: str = "") -> str:
    """A name that sorts by time: 20250131T104500Z, with a tag if there is one."""
    at = (now or datetime.now(UTC)).astimezone(UTC).strftime("%Y%m%dT%H%M%SZ")
    clean = re.sub(r"[^A-Za-z0-9_-]+", "-", tag).strip("-")
    return f"{at}-{clean}" if clean else at


def run_folder(base: str, name: str | None = None, env: Mapping[str, str] = os.environ) -> str:
    """Where a run writes: WEFTLAKE_RUN_DIR, else a folder of the run's name under ``base``."""
    return env.get("WEFTLAKE_RUN_DIR") or f"{base.rstrip('/')}/{name or run_id()}"


def cache_folder(base: str, env: Mapping[str, str] = os.environ) -> str | None:
    """Where snapshots are kept; none if WEFTLAKE_CACHE_DISABLE is set."""
    if as_bool(env.get("WEFTLAKE_CACHE_DISABLE")):
        return None
    return env.get("WEFTLAKE_CACHE_DIR") or f"{base.rstrip('/')}/cache"
