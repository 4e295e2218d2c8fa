"""Replay of the whole field log: the six field actions and the office's three decisions, with a line's backorder requests, bags and notices as nested state.

Every command is taken whole or refused with a code and changes nothing. Quantities are folded as whole ten-thousandths, so sums are exact.
A request, bag item or notice leaves the state with a last row as soon as it is closed; what stays is bounded by the line's open quantities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from .fold import folded

UNIT = 10_000
#: What must be filled in for each action, and the kinds of notices that it answers (fixed values).
NEEDS = {"CONFIRM_AVAILABLE": "place", "BAG": "place", "DIRECT_ISSUE": "issued_to", "ISSUE_FROM_AVAILABLE": "issued_to", "ISSUE_FROM_BAG": "issued_to", "BACKORDER_REQUESTED": "notes"}
ANSWERS = {"CONFIRM_AVAILABLE": "REJECTED", "BAG": "REJECTED", "DIRECT_ISSUE": "REJECTED", "BACKORDER_REQUESTED": "RETURNED"}
PENDING, CONFIRMED, PARTLY, REJECTED, RETURNED, FULFILLED = "Pending", "Confirmed", "Partially Confirmed", "Rejected", "Returned for Review", "Fulfilled"
SCHEMA = """line_id long, kind string, line struct<status: string, located: double, available: double, bagged: double, issued: double, pending: double, confirmed: double, accepted: long, refused: long>,
 request struct<id: long, split_from: long, status: string, confirmed: double, pending: double, active: boolean>, bag struct<tag: string, bagged: double, issued: double, status: string>,
 notice struct<id: long, source_id: long, kind: string, notified: double, resolved: double, status: string>, refusal struct<id: long, action: string, code: string>"""


class Refused(Exception):
    """A command that breaks a rule; str() is its code."""


@dataclass
class Request:
    id: int
    reported: int
    pending: int
    status: str = PENDING
    confirmed: int = 0
    split_from: int | None = None
    active: bool = True


@dataclass
class Notice:
    id: int
    source: int
    kind: str
    notified: int
    raised: int
    resolved: int = 0
    status: str = "Active"


@dataclass
class Line:
    line_id: int
    requested: int
    located: int = 0
    available: int = 0
    bagged: int = 0
    issued: int = 0
    pending: int = 0
    confirmed: int = 0
    accepted: int = 0
    refused: int = 0
    #: Open requests, notices and bag items (put in, taken out); tags that are closed.
    requests: list[Request] = field(default_factory=list)
    notices: list[Notice] = field(default_factory=list)
    bags: dict[str, list[int]] = field(default_factory=dict)
    closed: set[str] = field(default_factory=set)
    number: int = 0

    def remaining(self) -> int:
        return max(0, self.requested - self.issued)

    def locatable(self) -> int:
        return max(0, min(max(0, self.requested - self.located), self.remaining()) - self.pending)

    def open_requests(self) -> list[Request]:
        return sorted((r for r in self.requests if r.active), key=lambda r: (r.reported, r.id))

    def status(self) -> str:
        rules = (
            (self.remaining() <= 0 < self.requested, "Issued"), (self.issued > 0, "Partially Issued"), (self.confirmed > 0, "Backordered"), (self.pending > 0, "Pending Backorder"), (self.bagged >= self.requested > 0, "Bagged"),
            (self.bagged > 0, "Partially Bagged"), (self.located >= self.requested > 0, "Located"), (self.located > 0, "Partially Located"),
        )
        return next((name for holds, name in rules if holds), "Open")


def _within(quantity: int, most: int) -> int:
    if quantity <= 0:
        raise Refused("LEDGER_RULE")
    if quantity > most:
        raise Refused("LIMIT_EXCEEDED")
    return quantity


def _act(s: Line, c: dict, q: int) -> int:
    """A field action; gives the quantity that it newly located."""
    action = c["action"]
    if action == "CONFIRM_AVAILABLE":
        s.located += _within(q, s.locatable())
        s.available += q
        return q
    if action == "BAG":
        _within(q, max(0, s.available + s.locatable()))
        tag = (c["tag"] or "").strip() or f"auto-{c['id']}"
        if tag in s.closed:
            raise Refused("BAG_CLOSED")
        fresh = max(0, q - s.available)
        s.located, s.available, s.bagged = s.located + fresh, s.available + fresh - q, s.bagged + q
        s.bags.setdefault(tag, [0, 0])[0] += q
        return fresh
    if action == "DIRECT_ISSUE":
        s.located += _within(q, min(s.locatable(), s.remaining()))
        s.issued += q
        return q
    if action == "ISSUE_FROM_AVAILABLE":
        s.available -= _within(q, min(s.available, s.remaining()))
        s.issued += q
        return 0
    if action == "ISSUE_FROM_BAG":
        if not (c["tag"] or "").strip():
            raise Refused("MISSING_FIELD")
        item = s.bags.get(c["tag"].strip())
        if item is None:
            raise Refused("NOT_FOUND")
        s.bagged -= _within(q, min(s.bagged, s.remaining(), item[0] - item[1]))
        s.issued += q
        item[1] += q
        return 0
    if q <= 0:
        raise Refused("LEDGER_RULE")
    # A backorder answers returned requests first, oldest first; only what is left is new.
    left, answered = q, []
    for r in s.open_requests():
        if r.status == RETURNED and r.pending > 0 and left > 0:
            answered.append((r, r.pending <= left))
            left -= min(left, r.pending)
    if left > 0:
        s.pending += _within(left, max(0, s.remaining() - s.available - s.bagged - s.pending - s.confirmed))
        s.requests.append(Request(c["id"], s.number, left))
    for r, whole in answered:
        r.reported, r.status = s.number, PENDING if whole else RETURNED
    return 0


def _decide(s: Line, c: dict, decision: str) -> None:
    """The office decides on the line's oldest request with something pending; no quantity means all of it."""
    r = next((r for r in s.open_requests() if r.pending > 0), None)
    if r is None:
        raise Refused("NOT_PENDING")
    q = _within(r.pending if c["quantity"] is None else c["quantity"], r.pending)
    if decision == "RETURN" and not c["notes"]:
        raise Refused("MISSING_FIELD")
    left, source, kind = r.pending - q, r.id, {"CONFIRM": "CONFIRMED", "REJECT": "REJECTED", "RETURN": "RETURNED"}[decision]
    if decision == "CONFIRM":
        r.confirmed, r.pending, r.status = r.confirmed + q, left, PARTLY if left else CONFIRMED
        s.pending, s.confirmed = s.pending - q, s.confirmed + q
        kind = kind if left else None
    elif decision == "REJECT":
        r.pending, s.pending = left, s.pending - q
        if not left and not r.confirmed:
            r.status, r.active = REJECTED, False
    elif r.confirmed or left:
        r.pending, source = left, c["id"]
        s.requests.append(Request(c["id"], r.reported, q, RETURNED, split_from=r.id))
    else:
        r.status = RETURNED
    if kind:
        live = next((n for n in s.notices if n.source == source and n.kind == kind), None)
        if live:
            live.notified += q
        else:
            s.notices.append(Notice(c["id"], source, kind, q, s.number))


def _settle(s: Line, fresh: int) -> None:
    """Newly located material meets confirmed parts first, then pending requests, each oldest first."""
    budget = min(fresh, s.confirmed)
    for r in s.open_requests():
        if r.status in (CONFIRMED, PARTLY):
            took = min(budget, r.confirmed)
            r.confirmed, budget, s.confirmed, fresh = r.confirmed - took, budget - took, s.confirmed - took, fresh - took
    budget = min(fresh, s.pending)
    for r in s.open_requests():
        if r.status == PENDING:
            took = min(budget, r.pending)
            r.pending, budget, s.pending = r.pending - took, budget - took, s.pending - took
    for r in s.requests:
        if r.active and not r.confirmed and not r.pending:
            r.status, r.active = FULFILLED, False


def _answer(s: Line, kind: str | None, budget: int) -> None:
    for n in sorted(s.notices, key=lambda n: (n.raised, n.id)):
        if n.kind == kind and budget > 0:
            took = min(budget, n.notified - n.resolved)
            n.resolved, budget = n.resolved + took, budget - took
            if n.resolved >= n.notified:
                n.status = "Resolved"


def _q(x: int) -> float:
    return x / UNIT


def _request(s: Line, r: Request) -> dict:
    return {"line_id": s.line_id, "kind": "request", "request": {"id": r.id, "split_from": r.split_from, "status": r.status, "confirmed": _q(r.confirmed), "pending": _q(r.pending), "active": r.active}}


def _notice(s: Line, n: Notice) -> dict:
    return {"line_id": s.line_id, "kind": "notice", "notice": {"id": n.id, "source_id": n.source, "kind": n.kind, "notified": _q(n.notified), "resolved": _q(n.resolved), "status": n.status}}


def _bag(s: Line, tag: str, item: list[int], status: str) -> dict:
    return {"line_id": s.line_id, "kind": "bag", "bag": {"tag": tag, "bagged": _q(item[0]), "issued": _q(item[1]), "status": status}}


def _step(s: Line, c: dict) -> Iterator[dict]:
    s.number += 1
    action, q = c["action"], c["quantity"] or 0
    try:
        if action in NEEDS:
            if not c[NEEDS[action]]:
                raise Refused("MISSING_FIELD")
            fresh = _act(s, c, q)
            _settle(s, fresh)
            _answer(s, ANSWERS.get(action), q if action == "BACKORDER_REQUESTED" else fresh)
        elif action and action.startswith("OFFICE_"):
            _decide(s, c, action.removeprefix("OFFICE_"))
        else:
            raise Refused("BAD_ACTION")
    except Refused as why:
        s.refused += 1
        yield {"line_id": s.line_id, "kind": "refusal", "refusal": {"id": c["id"], "action": action, "code": str(why)}}
        return
    s.accepted += 1
    live = {r.id for r in s.requests if r.active}
    for n in s.notices:
        if n.status == "Active" and (s.remaining() <= 0 or (n.kind != "REJECTED" and n.source not in live)):
            n.status = "Superseded"
    yield from (_request(s, r) for r in s.requests if not r.active)
    yield from (_notice(s, n) for n in s.notices if n.status != "Active")
    s.requests, s.notices = [r for r in s.requests if r.active], [n for n in s.notices if n.status == "Active"]
    if action == "ISSUE_FROM_BAG":
        tag = c["tag"].strip()
        if s.bags[tag][1] >= s.bags[tag][0]:
            yield _bag(s, tag, s.bags.pop(tag), "Closed")
            s.closed.add(tag)


def _end(s: Line) -> Iterator[dict]:
    buckets = {k: _q(getattr(s, k)) for k in ("located", "available", "bagged", "issued", "pending", "confirmed")}
    yield {"line_id": s.line_id, "kind": "line", "line": {"status": s.status(), **buckets, "accepted": s.accepted, "refused": s.refused}}
    yield from (_request(s, r) for r in s.requests)
    yield from (_notice(s, n) for n in s.notices)
    yield from (_bag(s, tag, item, "Active") for tag, item in s.bags.items())


def replay_full(log: DataFrame) -> DataFrame:
    """The log (id, line_id, ts, action, quantity, tag, place, issued_to, notes, requested) replayed by line in order of time and id.

    A row for each line, request, bag item and notice in its last state, and one for each refused command; kind tells which struct is filled. A null quantity is nothing for a field action and
    all that is pending for a decision. Unknown actions are refused with BAD_ACTION. A tag is closed once its item is issued in full."""
    rows = log.select("id", "line_id", "ts", "action", *[F.round(F.col(c) * UNIT).cast("long").alias(c) for c in ("quantity", "requested")], "tag", "place", "issued_to", "notes")
    return folded(rows, "line_id", ["ts", "id"], _parse_datatype_string(SCHEMA), lambda r: Line(r["line_id"], r["requested"]), _step, _end)


def part(replayed: DataFrame, kind: str) -> DataFrame:
    """The rows of one kind, as a table."""
    return replayed.filter(F.col("kind") == kind).select("line_id", f"{kind}.*")
