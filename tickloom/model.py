"""Instruments, timeframes, windows and scan requests.

Bars are rows of one long table: key columns (such as symbol and side), ts_ms (a bar's opening, epoch milliseconds in
UTC, bigint), open, high, low, close, tick_volume (double). Integer time makes every calendar rule plain arithmetic
that does not depend on the session's time zone.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from datetime import UTC, datetime

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000
#: The closed set of output timeframes.
TIMEFRAMES = {"5m": 5 * MINUTE, "10m": 10 * MINUTE, "15m": 15 * MINUTE, "1h": HOUR, "1d": DAY}
SIDES = ("bid", "ask")
GAP_POLICIES = ("continuous_only", "strict")
BAR_COLUMNS = ("ts_ms", "open", "high", "low", "close", "tick_volume")


class Invalid(ValueError):
    """A request that cannot run; code is one of the preflight codes."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def step_of(timeframe: str) -> int:
    if timeframe not in TIMEFRAMES:
        raise Invalid("invalid_parameter", f"unknown timeframe {timeframe!r}; one of {', '.join(TIMEFRAMES)}")
    return TIMEFRAMES[timeframe]


def instrument(spec: str) -> tuple[str, str]:
    """SYMBOL:side, split at the first colon."""
    symbol, colon, side = spec.partition(":")
    if not symbol or not colon or side not in SIDES:
        raise Invalid("invalid_parameter", f"instrument {spec!r} is not SYMBOL:bid or SYMBOL:ask")
    return symbol, side


def _moment(text: str) -> int:
    if "T" in text and not text.endswith("Z"):
        raise Invalid("invalid_parameter", f"time {text!r} must end in Z")
    try:
        at = datetime.fromisoformat(text.removesuffix("Z"))
    except ValueError as e:
        raise Invalid("invalid_parameter", f"time {text!r}: {e}") from e
    return int(at.replace(tzinfo=UTC).timestamp() * 1000)


def window(text: str) -> tuple[int, int]:
    """START:END as a half-open range of epoch milliseconds; dates, or RFC 3339 moments that end in Z."""
    parts = text.split(":")
    for cut in range(1, len(parts)):
        left, right = ":".join(parts[:cut]), ":".join(parts[cut:])
        if ("T" in left) == left.endswith("Z") and ("T" in right) == right.endswith("Z") and left and right and ("T" in left or len(left) == 10):
            start, end = _moment(left), _moment(right)
            if start >= end:
                raise Invalid("invalid_parameter", f"window {text!r} is empty")
            return start, end
    raise Invalid("invalid_parameter", f"window {text!r} is not START:END")


def check_aligned(start_ms: int, timeframe: str) -> None:
    if start_ms % step_of(timeframe):
        raise Invalid("invalid_parameter", f"window start is not on a {timeframe} boundary")


def canonical(params: dict) -> str:
    return json.dumps(params, sort_keys=True, separators=(",", ":"))


def param_hash(params: dict) -> str:
    return hashlib.sha256(canonical(params).encode()).hexdigest()


def parse_params(pairs: list[str]) -> dict:
    """KEY=VAL, the value JSON if it parses and else a string."""
    out: dict = {}
    for p in pairs:
        key, eq, value = p.partition("=")
        if not eq or not key:
            raise Invalid("invalid_parameter", f"parameter {p!r} is not KEY=VALUE")
        if key in out:
            raise Invalid("invalid_parameter", f"parameter {key!r} is given twice")
        try:
            out[key] = json.loads(value)
        except json.JSONDecodeError:
            out[key] = value
    return out


@dataclass(frozen=True)
class ScanRequest:
    scan: str  # id@version
    instruments: tuple[str, ...]
    timeframe: str
    window: tuple[int, int]
    gap_policy: str = "continuous_only"
    params: dict = field(default_factory=dict)
    bootstrap: str | None = None
    bootstrap_n: int = 1000
    null: str | None = None
    null_n: int = 1000
    seed: int = 0
    dry_run: bool = False

    def job_seed(self) -> int:
        """A seed that depends on what the job computes and on the sweep's seed."""
        h = hashlib.sha256(self.seed.to_bytes(8, "little"))
        for part in (self.scan, *self.instruments, self.timeframe, f"{self.window[0]}/{self.window[1]}", param_hash(self.params)):
            raw = part.encode()
            h.update(len(raw).to_bytes(8, "little") + raw)
        return int.from_bytes(h.digest()[:8], "little")
