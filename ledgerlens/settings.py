"""Settings of a scoring job and their bounds."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


def _topics() -> dict[str, str]:
    return {"payments": "payments.raw", "rules": "risk.rules", "decisions": "risk.decisions", "dlq": "payments.dlq", "late": "payments.late"}


@dataclass(frozen=True)
class Settings:
    disorder_ms: int = 10_000
    dedup_ms: int = 86_400_000
    history_ms: int = 3_600_000
    device_ms: int = 2_592_000_000
    max_events: int = 100_000
    max_devices: int = 10_000
    review: int = 30
    reject: int = 70
    start: str = "committed"
    environment: str = "local"
    dlq_payload: str = "omit"
    pending_alert_ms: int = 60_000
    topics: dict[str, str] = field(default_factory=_topics)

    def __post_init__(self) -> None:
        if self.environment not in ("local", "staging", "production") or self.dlq_payload not in ("omit", "capture"):
            raise ValueError("unknown environment or payload mode")
        if self.environment != "local" and self.dlq_payload == "capture":
            raise ValueError("payloads are captured in a local environment only")
        if not 1_000 <= self.pending_alert_ms <= 86_400_000:
            raise ValueError("the alert on waiting payments is out of bounds")
        names = list(self.topics.values())
        if len(set(names)) != len(names) or not all(re.fullmatch(r"[a-zA-Z0-9._-]{1,249}", n) for n in names):
            raise ValueError("topics need distinct names of letters, digits, dots, dashes and underscores")
        if self.disorder_ms < 0 or self.dedup_ms < 1 or self.max_events < 1 or self.max_devices < 1 or self.start not in ("earliest", "committed"):
            raise ValueError("a limit or the start is out of bounds")
        if self.history_ms < 900_000 or not max(2_592_000_000, self.history_ms) <= self.device_ms <= 31_536_000_000:
            raise ValueError("a retention is out of bounds")
        if not 1 <= self.review < self.reject <= 100:
            raise ValueError("thresholds are out of bounds")

    @classmethod
    def of(cls, env: dict[str, str]) -> Settings:
        """Settings from an environment: LEDGERLENS_<FIELD>, whole numbers where numbers belong."""
        given: dict[str, object] = {}
        for name, f in cls.__dataclass_fields__.items():
            text = env.get(f"LEDGERLENS_{name.upper()}")
            if text is not None and name != "topics":
                given[name] = int(text) if f.type == "int" else text
        prefix = env.get("LEDGERLENS_TOPIC_PREFIX", "")
        if prefix:
            given["topics"] = {k: prefix + v for k, v in _topics().items()}
        return cls(**given)  # type: ignore[arg-type]
