"""One segment at a time through masking, refinement and finalising, as a session's updates
come; tables of texts go through ``refinement``.

A refiner is any callable ``refine(masked_text, hints, strict) -> text``; it is made once
per worker by a factory. Stand-ins for tests and offline runs are below.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from quillet.functions.chunking import guard_reasons, join_parts, refinement_windows
from quillet.operators.masking import Protection, Protector, audit, hints, restore
from quillet.operators.matching import Match, MatchConfig, Matcher

Refiner = Callable[[str, list[str], bool], str]
RETRYABLE = ("severe_content_loss", "truncated_refiner_output", "entity_sentence_boundary_lost")
PLACEHOLDER_FAILURES = ("unknown_placeholders", "placeholder_count", "placeholder_order_changed", "malformed_placeholder", "ambiguous_literal_placeholder")


def identity(text: str, hints: list[str], strict: bool) -> str:
    return text


def squeezing(text: str, hints: list[str], strict: bool) -> str:
    """Collapses white space, as a mild refiner would."""
    return " ".join(text.split())


def failing(text: str, hints: list[str], strict: bool) -> str:
    raise RuntimeError("no model")


@dataclass(frozen=True)
class Prepared:
    text: str
    protection: Protection
    baseline: str
    hints: list[str]
    matches: list[Match]


@dataclass
class Outcome:
    """What refining one text gives; segments are merged into one."""

    clean_text: str
    accepted: bool = True
    reasons: list[str] = field(default_factory=list)
    audit_issues: list[str] = field(default_factory=list)
    hints: list[str] = field(default_factory=list)
    retries: int = 0
    placeholder_retries: int = 0
    retry_reasons: list[str] = field(default_factory=list)
    masked_outputs: list[str] = field(default_factory=list)
    normalizations: list[str] = field(default_factory=list)
    error: str | None = None


def has_placeholder_failure(reasons: list[str]) -> bool:
    return any(r.startswith(PLACEHOLDER_FAILURES) for r in reasons)


def should_retry(reasons: list[str]) -> bool:
    return has_placeholder_failure(reasons) or any(r in RETRYABLE for r in reasons)


def prepare(text: str, protector: Protector, matcher: Matcher | None, allow_auto: bool = False, trusted=()) -> Prepared:
    """Mask exact spans, match fuzzily outside of them, then mask with the automatic
    matches too. The baseline is the text with all replacements."""
    exact = protector.protect(text, trusted)
    matches = matcher.match(text, allow_auto, [(s.start, s.end) for s in exact.spans]) if matcher else []
    auto = [m for m in matches if m.decision == "AUTO_NORMALIZE"]
    protection = protector.protect(text, trusted, auto) if auto else exact
    baseline, reasons = restore(protection.masked_text, protection)
    if reasons and text.strip():
        raise RuntimeError("a masked text does not restore: " + ",".join(reasons))
    limit = matcher.config.max_refiner_hints if matcher else MatchConfig.max_refiner_hints
    suggested = [m.canonical for m in matches if m.decision == "HINT_ONLY"]
    return Prepared(text, protection, baseline, list(dict.fromkeys([*hints(protection), *suggested]))[:limit], matches)


def introduced_hints(prepared: Prepared, restored: str) -> list[str]:
    """Hints that the output added more often than it consumed observed spans for."""
    out = []
    for name in prepared.hints:
        added = restored.count(name) - prepared.baseline.count(name)
        if added > 0:
            used = [m.observed for m in prepared.matches if m.canonical == name]
            if added > sum(prepared.baseline.count(o) > restored.count(o) for o in used):
                out.append(f"introduced_entity_from_hint:{name}")
    return out


def finalize(refined_masked: str, prepared: Prepared) -> tuple[str, list[str]]:
    """(text, reasons): the restored refinement, or the baseline and why."""
    text, reasons = restore(refined_masked, prepared.protection)
    if not reasons:
        reasons = introduced_hints(prepared, text) + guard_reasons(prepared.baseline, text)
    return (prepared.baseline, reasons) if reasons else (text, [])


def normalizations(prepared: Prepared) -> list[str]:
    return [f"{s.original}->{s.replacement}" for s in prepared.protection.spans if s.original != s.replacement]


def refine_segment(text: str, refiner: Refiner, protector: Protector, matcher: Matcher | None = None, allow_auto: bool = False, trusted=()) -> Outcome:
    """One segment: prepare, refine, finalise, and at most one strict retry. A failing
    refiner leaves the deterministic baseline."""
    ready = prepare(text, protector, matcher, allow_auto, trusted)
    out = Outcome(ready.baseline, hints=ready.hints, normalizations=normalizations(ready))
    for strict in (False, True):
        try:
            masked = refiner(ready.protection.masked_text, ready.hints, strict)
        except Exception as error:  # an external model may fail in any way
            out.accepted, out.error = False, f"refiner_error: {error}"
            out.reasons = ["refiner_error"]
            break
        out.masked_outputs.append(masked)
        out.clean_text, out.reasons = finalize(masked, ready)
        out.accepted = not out.reasons
        if strict or not should_retry(out.reasons):
            break
        out.retries += 1
        out.placeholder_retries += has_placeholder_failure(out.reasons)
        out.retry_reasons += out.reasons
    out.audit_issues = audit(out.clean_text, ready.protection)
    return out


def merge(outcomes: list[Outcome], numbered: bool = True) -> Outcome:
    """Segments as one: texts joined, counts summed, lists in order, accepted if all are."""
    tag = lambda i, xs: [f"segment_{i}:{x}" if numbered and len(outcomes) > 1 else x for x in xs]
    total = Outcome(join_parts(o.clean_text for o in outcomes), all(o.accepted for o in outcomes))
    for i, o in enumerate(outcomes):
        total.reasons += tag(i, o.reasons)
        total.retry_reasons += tag(i, o.retry_reasons)
        for name in ("audit_issues", "hints", "masked_outputs", "normalizations"):
            getattr(total, name).extend(getattr(o, name))
        total.retries += o.retries
        total.placeholder_retries += o.placeholder_retries
        total.error = total.error or o.error
    return total


def refine_text(text: str, refiner: Refiner, protector: Protector, matcher: Matcher | None = None, limit: int = 80, allow_auto: bool = False, trusted=()) -> Outcome:
    """A text of any length, in refinement windows; blank text is accepted as empty."""
    return merge([refine_segment(w, refiner, protector, matcher, allow_auto, trusted) for w in refinement_windows(text, limit)])
