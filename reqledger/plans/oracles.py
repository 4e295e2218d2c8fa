"""SQL for DuckDB that gives the same rows as the registered queries."""

from __future__ import annotations

from ..functions import normalize as N
from ..operators.drafts import MOVES, REFUSALS
from ..sources.bridge import with_views

AS_OF = "2024-01-15 00:00:00"
REM = "greatest(0, qty_requested - qty_issued)"
NYL = "greatest(0, qty_requested - qty_confirmed_located)"
LOC = f"greatest(0, least({NYL}, {REM}) - qty_pending_backorder)"
NEW = f"greatest(0, {REM} - qty_available - qty_active_bagged - qty_pending_backorder - qty_confirmed_backorder)"
SHORT = f"greatest(0, {REM} - qty_available - qty_active_bagged)"
STATUS = f"""CASE WHEN {REM} <= 0 AND qty_requested > 0 THEN 'Issued' WHEN qty_issued > 0 THEN 'Partially Issued' WHEN qty_confirmed_backorder > 0 THEN 'Backordered' WHEN qty_pending_backorder > 0 THEN 'Pending Backorder'
  WHEN qty_active_bagged >= qty_requested AND qty_requested > 0 THEN 'Bagged' WHEN qty_active_bagged > 0 THEN 'Partially Bagged' WHEN qty_confirmed_located >= qty_requested AND qty_requested > 0 THEN 'Located'
  WHEN qty_confirmed_located > 0 THEN 'Partially Located' ELSE 'Open' END"""
COLS = {"requested": "qty_requested", "located": "qty_confirmed_located", "available": "qty_available", "bagged": "qty_active_bagged", "issued": "qty_issued", "pending": "qty_pending_backorder", "confirmed": "qty_confirmed_backorder", "remaining": REM}
REG = f"""WITH s AS (SELECT req_id, count(*) AS line_count, {', '.join(f'sum({c}) AS {k}' for k, c in COLS.items())} FROM lines WHERE active GROUP BY req_id),
reg AS (SELECT r.req_id, r.project_id, r.req_number, r.priority, r.date_required, coalesce(line_count, 0) AS line_count, {', '.join(f'cast(coalesce({k}, 0) AS double) AS {k}' for k in COLS)},
  cast(CASE WHEN requested > 0 THEN floor(cast(issued AS double) * 100 / cast(requested AS double) + 0.5) ELSE 0 END AS bigint) AS pct_issued FROM requisitions r LEFT JOIN s ON r.req_id = s.req_id WHERE r.active)"""
LOCATED = "located AS (SELECT line_id, cast(sum(quantity) AS decimal(14,4)) AS located FROM movements WHERE action = 'CONFIRM_AVAILABLE' GROUP BY line_id)"
ASKED = LOCATED.replace("located", "asked").replace("CONFIRM_AVAILABLE", "BACKORDER_REQUESTED")

BUDGETS = """q AS (SELECT b.*, located, t.pending AS waits, least(located, greatest(0, t.confirmed)) AS budget, CASE WHEN status IN ('Confirmed', 'Partially Confirmed') THEN qty_confirmed ELSE 0 END AS pool, CASE WHEN status = 'Pending' THEN qty_pending ELSE 0 END AS waiting
  FROM backorders b JOIN located USING (line_id) JOIN line_totals t USING (line_id) WHERE b.active), a AS (SELECT *, sum(pool) OVER (PARTITION BY line_id) AS held FROM q)"""


def _take(quantity: str, budget: str, order: str, key: str = "line_id") -> str:
    return f"greatest(0, least({quantity}, {budget} - coalesce(sum({quantity}) OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))"


CHECKS = {
    "chk_bag_ledger": """SELECT l.project_id, 'BAG_LEDGER' AS code, l.line_id AS entity_id, cast(qty_active_bagged - coalesce(held, 0) AS double) AS difference FROM lines l
LEFT JOIN (SELECT line_id, sum(qty_remaining) AS held FROM bag_items WHERE active GROUP BY line_id) h ON l.line_id = h.line_id WHERE l.active AND abs(qty_active_bagged - coalesce(held, 0)) > 1e-4""",
    "chk_backorder_excess": f"SELECT project_id, 'BACKORDER_EXCESS' AS code, line_id AS entity_id, cast(qty_pending_backorder + qty_confirmed_backorder - {NYL} AS double) AS difference FROM lines WHERE active AND qty_pending_backorder + qty_confirmed_backorder > {NYL}",
    "chk_orphan_bag_item": "SELECT project_id, 'ORPHAN_BAG_ITEM' AS code, line_id AS entity_id, cast(qty_remaining AS double) AS difference FROM bag_items WHERE qty_remaining > 0 AND line_id IN (SELECT line_id FROM lines WHERE NOT active)",
    "chk_notice_without_request": "SELECT project_id, 'NOTICE_WITHOUT_REQUEST' AS code, id AS entity_id, cast(qty_notified AS double) AS difference FROM notices WHERE active AND kind <> 'REJECTED' AND id NOT IN (SELECT id FROM backorders WHERE active AND qty_pending > 0)",
    "chk_row_constraints": """SELECT project_id, unnest(list_filter([CASE WHEN qty_requested <= 0 THEN 'NOTHING_REQUESTED' END, CASE WHEN abs(qty_confirmed_located - (qty_available + qty_active_bagged + qty_issued)) > 0.0001 THEN 'LOCATED_SPLIT' END,
  CASE WHEN qty_issued > qty_requested THEN 'ISSUED_OVER_REQUESTED' END, CASE WHEN qty_confirmed_located > qty_requested THEN 'LOCATED_OVER_REQUESTED' END, CASE WHEN qty_requested < 0 THEN 'NEGATIVE_REQUESTED' END, CASE WHEN qty_confirmed_located < 0 THEN 'NEGATIVE_CONFIRMED_LOCATED' END,
  CASE WHEN qty_active_bagged < 0 THEN 'NEGATIVE_ACTIVE_BAGGED' END, CASE WHEN qty_available < 0 THEN 'NEGATIVE_AVAILABLE' END, CASE WHEN qty_issued < 0 THEN 'NEGATIVE_ISSUED' END, CASE WHEN qty_pending_backorder < 0 THEN 'NEGATIVE_PENDING_BACKORDER' END,
  CASE WHEN qty_confirmed_backorder < 0 THEN 'NEGATIVE_CONFIRMED_BACKORDER' END, CASE WHEN coalesce(trim(iso_number), '') = '' THEN 'NO_ISO_NUMBER' END, CASE WHEN coalesce(trim(iso_sheet), '') = '' THEN 'NO_ISO_SHEET' END], lambda x: x IS NOT NULL)) AS code,
  line_id AS entity_id, cast(qty_requested AS double) AS difference FROM counted_lines""",
}
#: The reference's other checks; integrity_report_all unites these with CHECKS.
MORE_CHECKS = {
    "chk_backorder_ledger": """SELECT l.project_id, 'BACKORDER_LEDGER' AS code, l.line_id AS entity_id, cast(abs(qty_pending_backorder - coalesce(p, 0)) + abs(qty_confirmed_backorder - coalesce(c, 0)) AS double) AS difference FROM lines l
LEFT JOIN (SELECT line_id, sum(qty_pending) AS p, sum(qty_confirmed) AS c FROM backorders WHERE active GROUP BY line_id) b ON l.line_id = b.line_id
WHERE l.active AND (abs(qty_pending_backorder - coalesce(p, 0)) > 1e-4 OR abs(qty_confirmed_backorder - coalesce(c, 0)) > 1e-4)""",
    "chk_issued_history": """SELECT l.project_id, 'ISSUED_HISTORY' AS code, l.line_id AS entity_id, cast(qty_issued - coalesce(told, 0) AS double) AS difference FROM lines l
LEFT JOIN (SELECT line_id, sum(CASE WHEN starts_with(action, 'REVERSAL_') THEN -quantity ELSE quantity END) AS told FROM movements
  WHERE action IN ('DIRECT_ISSUE', 'ISSUE_FROM_AVAILABLE', 'ISSUE_FROM_BAG', 'CORRECTION_DIRECT_ISSUE', 'CORRECTION_ISSUE_FROM_AVAILABLE', 'CORRECTION_ISSUE_FROM_BAG', 'REVERSAL_DIRECT_ISSUE', 'REVERSAL_ISSUE_FROM_AVAILABLE', 'REVERSAL_ISSUE_FROM_BAG')
  GROUP BY line_id) t ON l.line_id = t.line_id WHERE l.active AND abs(qty_issued - coalesce(told, 0)) > 1e-4""",
    "chk_status": f"""SELECT l.project_id, 'STATUS' AS code, l.line_id AS entity_id, cast({REM} AS double) AS difference FROM lines l JOIN stored_statuses s ON l.line_id = s.line_id
WHERE l.active AND ((line_status = 'Issued' AND {REM} > 1e-4) OR (line_status = 'Open' AND qty_confirmed_located > 1e-4) OR ({REM} <= 1e-4 AND qty_requested > 0 AND line_status <> 'Issued'))""",
}
MORE_VIEWS = ("lines", "counted_lines", "bag_items", "notices", "backorders", "movements", "stored_statuses")
CHECK_VIEWS = ("lines", "counted_lines", "bag_items", "notices", "backorders")


def _replay() -> str:
    limit = """CASE action WHEN 'CONFIRM_AVAILABLE' THEN free WHEN 'BAG' THEN greatest(0, available + free) WHEN 'DIRECT_ISSUE' THEN least(free, left_) WHEN 'ISSUE_FROM_AVAILABLE' THEN least(available, left_)
      ELSE greatest(0, left_ - available - bagged - pending) END"""
    d = "decimal(14,4)"
    move = {
        "located": "CASE action WHEN 'CONFIRM_AVAILABLE' THEN q WHEN 'DIRECT_ISSUE' THEN q WHEN 'BAG' THEN fresh ELSE 0 END",
        "available": "CASE action WHEN 'CONFIRM_AVAILABLE' THEN q WHEN 'ISSUE_FROM_AVAILABLE' THEN -q WHEN 'BAG' THEN fresh - q ELSE 0 END",
        "bagged": "CASE action WHEN 'BAG' THEN q ELSE 0 END", "issued": "CASE action WHEN 'DIRECT_ISSUE' THEN q WHEN 'ISSUE_FROM_AVAILABLE' THEN q ELSE 0 END", "pending": "CASE action WHEN 'BACKORDER_REQUESTED' THEN q ELSE 0 END",
    }
    return f"""WITH c AS (SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY ts, id) AS n, action, quantity AS q FROM movements),
st AS (SELECT DISTINCT line_id, cast(0 AS bigint) AS n, {', '.join(f'cast(0 AS {d}) AS {k}' for k in move)}, cast(0 AS bigint) AS accepted, cast(0 AS bigint) AS refused FROM movements
UNION ALL SELECT line_id, n, {', '.join(f'cast(CASE WHEN ok THEN {k} + {v} ELSE {k} END AS {d})' for k, v in move.items())}, accepted + CASE WHEN ok THEN 1 ELSE 0 END, refused + CASE WHEN ok THEN 0 ELSE 1 END FROM (
  SELECT *, q > 0 AND q <= {limit} AS ok FROM (SELECT *, greatest(0, least(greatest(0, 1000 - located), left_) - pending) AS free, greatest(0, q - available) AS fresh FROM (
    SELECT st.line_id, c.n, c.action, c.q, greatest(0, 1000 - issued) AS left_, located, available, bagged, issued, pending, accepted, refused FROM st JOIN c ON st.line_id = c.line_id AND c.n = st.n + 1))))
SELECT line_id, {', '.join(f'cast({k} AS double) AS {k}' for k in move)}, accepted, refused FROM st WHERE accepted + refused = (SELECT count(*) FROM c WHERE c.line_id = st.line_id)"""


def _workflow() -> str:
    to = "CASE " + " ".join(f"WHEN c.action = '{a}' AND state IN ({', '.join(repr(x) for x in sources)}) THEN '{end}'" for a, (sources, end) in MOVES.items()) + " END"
    counts = {"accepted": "OK"} | {k.lower(): k for k in REFUSALS}
    return f"""WITH c AS (SELECT draft_id, row_number() OVER (PARTITION BY draft_id ORDER BY ts, id) AS n, action, allowed, reason FROM transitions),
st AS (SELECT DISTINCT draft_id, cast(0 AS bigint) AS n, 'DRAFT' AS state, {', '.join(f'cast(0 AS bigint) AS {k}' for k in counts)} FROM transitions
UNION ALL SELECT draft_id, n, CASE WHEN code = 'OK' THEN goal ELSE state END, {', '.join(f"{k} + CASE WHEN code = '{v}' THEN 1 ELSE 0 END" for k, v in counts.items())} FROM (
  SELECT *, CASE WHEN NOT allowed THEN 'FORBIDDEN' WHEN goal IS NULL THEN 'BAD_STATE' WHEN action = 'PLANNER_RETURN' AND length(trim(reason)) < 3 THEN 'MISSING_REASON' ELSE 'OK' END AS code FROM (
    SELECT st.draft_id, c.n, c.action, c.allowed, c.reason, state, {', '.join(counts)}, {to} AS goal FROM st JOIN c ON st.draft_id = c.draft_id AND c.n = st.n + 1)))
SELECT draft_id, state, {', '.join(counts)} FROM st WHERE n = (SELECT count(*) FROM c WHERE c.draft_id = st.draft_id)"""


def _corrections() -> str:
    move = {
        "located": "CASE WHEN action IN ('CONFIRM_AVAILABLE', 'DIRECT_ISSUE') THEN quantity ELSE 0 END", "available": "CASE WHEN action = 'CONFIRM_AVAILABLE' THEN quantity WHEN action IN ('BAG', 'ISSUE_FROM_AVAILABLE') THEN -quantity ELSE 0 END",
        "bagged": "CASE WHEN action = 'BAG' THEN quantity ELSE 0 END", "issued": "CASE WHEN action IN ('DIRECT_ISSUE', 'ISSUE_FROM_AVAILABLE') THEN quantity ELSE 0 END", "pending": "CASE WHEN action = 'BACKORDER_REQUESTED' THEN quantity ELSE 0 END",
    }
    told = [f"CASE WHEN {k} < 0 THEN '{k} below zero' END" for k in move] + [f"CASE WHEN {k} > 1000 THEN '{k} over requested' END" for k in ("located", "issued")]
    return f"""WITH whole AS (SELECT line_id, {', '.join(f'sum({v}) AS w_{k}' for k, v in move.items())} FROM movements GROUP BY line_id),
grp AS (SELECT line_id, day, {', '.join(f'sum({v}) AS d_{k}' for k, v in move.items())} FROM movements GROUP BY line_id, day),
aft AS (SELECT grp.line_id, day, {', '.join(f'cast(w_{k} - d_{k} AS double) AS {k}' for k in move)} FROM grp JOIN whole ON grp.line_id = whole.line_id)
SELECT *, concat_ws('; ', {', '.join(told)}) AS refused_because FROM aft"""


OWED = "greatest(0, qty_borrowed - qty_repaid)"
DRAFT_LINES = """dl AS (SELECT drawing, part_id, row_number() OVER (PARTITION BY drawing ORDER BY part_id) AS line_number, sheet IS NULL AS no_sheet, quantity IS NULL AS bad, coalesce(quantity <= 0, false) AS zero, coalesce(NOT regexp_matches(size, '^[0-9/-]+"?(x[0-9/-]+"?)?$'), false) AS odd FROM materials WHERE drawing IS NOT NULL)"""


def _sizes() -> str:
    return """CASE raw_size WHEN '6 IN' THEN '6"' WHEN '1.5' THEN '1-1/2"' WHEN '0.75' THEN '3/4"' WHEN '2X1 1/2' THEN '2"x1-1/2"' WHEN '1-1/2' THEN '1-1/2"' WHEN '3/4"' THEN '3/4"' WHEN 'SEE DETAIL' THEN 'SEE DETAIL' WHEN '2-Jan' THEN '1/2"' WHEN 'Mar-4' THEN '3/4"' END"""


def _m(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern.replace(chr(39), chr(39) * 2)}')"


MATERIALS = f"""typed AS (SELECT *, CASE WHEN {_m('commodity_code', N.SUPPORT_CODE)} THEN 'SUPPORT' WHEN {_m('description', N.STANDALONE_BOLT)} THEN 'BOLT' WHEN {_m('description', N.STANDALONE_GASKET)} THEN 'GASKET'
  WHEN {_m('description', N.PIPE)} THEN 'PIPE' WHEN {_m('description', N.STANDARD_FITTING)} THEN 'FITTING' ELSE 'SPECIALTY' END AS item_type,
  CASE WHEN raw_quantity LIKE '%''' THEN 'FT:measured quantity' WHEN {_m('description', N.UOM_SUPPORT)} THEN 'EA:pipe support' WHEN {_m('description', N.UOM_FITTING)} THEN 'EA:fitting' WHEN {_m('description', N.UOM_LENGTH)} THEN 'FT:length material'
  WHEN {_m('description', N.UOM_LIQUID)} THEN 'GAL:liquid' WHEN {_m('description', N.UOM_WEIGHT)} THEN 'LB:weight' ELSE 'EA:countable' END AS unit FROM material_text),
materials AS (SELECT part_id, {_sizes()} AS size, CASE raw_quantity WHEN '1,200' THEN 1200.0 WHEN '49.2''' THEN 49.2 WHEN '40 FT' THEN 40.0 END::double AS quantity, split_part(unit, ':', 1) AS uom, split_part(unit, ':', 2) AS uom_rule,
  CASE raw_drawing WHEN ' d 100  a' THEN 'D-100-A' WHEN 'D-44--10-' THEN 'D-44-10' WHEN '' THEN NULL ELSE raw_drawing END AS drawing, CASE raw_sheet WHEN 'SHT 1' THEN '01' WHEN 'Sheet 123' THEN '123' ELSE raw_sheet END AS sheet, item_type,
  CASE WHEN {_m('description', N.BLIND)} THEN 'BLINDS' WHEN item_type IN ('BOLT', 'GASKET', 'WASHER') THEN 'BOLTS & GASKETS' WHEN item_type = 'SUPPORT' THEN 'SUPPORTS' WHEN {_m('description', N.BIRDSCREEN)} THEN 'BIRDSCREENS'
  WHEN {_m('description', N.VALVE)} THEN 'VALVES' WHEN item_type IN ('PIPE', 'FITTING') OR {_m('description', N.PIPE_FITTING)} THEN 'PIPE & FITTINGS' ELSE 'OTHER MATERIALS' END AS takeoff_sheet FROM typed)"""
REVISIONS = """per AS (SELECT drawing_number, count(DISTINCT revision) AS revisions, bool_and(regexp_matches(revision, '^[0-9]+$')) AS numeric_, max(try_cast(revision AS int)) AS newest FROM iso_pages GROUP BY 1),
r AS (SELECT p.*, revisions, numeric_, coalesce(revisions = 1 OR try_cast(revision AS int) = newest, false) AS cur FROM iso_pages p JOIN per ON p.drawing_number = per.drawing_number),
h AS (SELECT drawing_number, count(DISTINCT content_hash) AS contents FROM r WHERE cur GROUP BY 1),
fates AS (SELECT drawing_number, revision, page, CASE WHEN revisions > 1 AND NOT numeric_ THEN 'unorderable_multiple_revisions' WHEN NOT cur THEN 'superseded' WHEN contents > 1 THEN 'duplicate_revision_conflict' WHEN place = 1 THEN 'accepted' ELSE 'duplicate' END AS fate
  FROM (SELECT r.*, contents, row_number() OVER (PARTITION BY r.drawing_number, cur ORDER BY source_path, page) AS place FROM r LEFT JOIN h ON r.drawing_number = h.drawing_number))"""


def oracle_sql() -> dict[str, str]:
    v = with_views
    rl, sums = ("requisitions", "lines"), ", ".join(f"sum({k}) AS {k}" for k in COLS)
    act = "CASE event_type WHEN 'view' THEN 'CONFIRM_AVAILABLE' WHEN 'click' THEN 'BAG' WHEN 'purchase' THEN 'ISSUE_FROM_AVAILABLE' WHEN 'error' THEN 'DIRECT_ISSUE' ELSE 'BACKORDER_REQUESTED' END"
    out = {
        "register": v(f"{REG} SELECT * FROM reg", *rl),
        "register_totals": v(f"{REG} SELECT project_id, count(*) AS requisitions, cast(sum(line_count) AS bigint) AS line_count, {sums} FROM reg GROUP BY project_id", *rl),
        "register_exceptions": v(f"{REG} SELECT project_id, count(*) AS requisitions, count(*) FILTER (remaining > 0) AS has_remaining, count(*) FILTER (located < requested) AS not_fully_located, count(*) FILTER (available > 0) AS has_available, count(*) FILTER (bagged > 0) AS has_bagged, count(*) FILTER (pending > 0) AS pending_backorder, count(*) FILTER (confirmed > 0) AS confirmed_backorder FROM reg GROUP BY project_id", *rl),
        "register_page": v(f"{REG} SELECT project_id, record, records, cast(ceil(records / 25) AS bigint) AS pages, req_number, sort_value FROM (SELECT project_id, req_number, remaining AS sort_value, row_number() OVER (PARTITION BY project_id ORDER BY remaining DESC, req_number) AS record, count(*) OVER (PARTITION BY project_id) AS records FROM reg) WHERE record BETWEEN 26 AND 50", *rl),
        "register_filters": v(f"WITH h AS (SELECT req_id, CASE WHEN sum({REM}) <= 0 AND sum(qty_requested) > 0 THEN 'Complete' WHEN sum(qty_issued) > 0 THEN 'Partially Issued' WHEN sum(qty_pending_backorder) + sum(qty_confirmed_backorder) > 0 THEN 'Backordered' WHEN sum(qty_confirmed_located) > 0 THEN 'In Progress' ELSE 'Open' END AS status FROM lines WHERE active GROUP BY 1) SELECT project_id, string_agg(DISTINCT priority, ',' ORDER BY priority) AS priorities, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses FROM requisitions LEFT JOIN h USING (req_id) GROUP BY project_id", *rl),
        "line_state": v(f"SELECT line_id, upper(iso_number) || '|' || upper(iso_sheet) AS iso_key, cast({NYL} AS double) AS not_yet_located, cast({REM} AS double) AS remaining, {STATUS} AS line_status FROM lines", "lines"),
        "line_ceilings": v(f"SELECT line_id, cast({LOC} AS double) AS locatable, cast(greatest(0, qty_available + {LOC}) AS double) AS reservable, cast({NEW} AS double) AS new_backorder, cast(greatest(0, qty_available) AS double) AS lendable, cast({SHORT} AS double) AS shortage FROM lines", "lines"),
        "action_limits": v(" UNION ALL ".join(f"SELECT line_id, '{a}' AS action, cast({x} AS double) AS max_quantity FROM lines" for a, x in (("CONFIRM_AVAILABLE", LOC), ("BAG", f"greatest(0, qty_available + {LOC})"), ("DIRECT_ISSUE", f"least({LOC}, {REM})"), ("ISSUE_FROM_AVAILABLE", f"least(qty_available, {REM})"), ("BACKORDER_REQUESTED", NEW), ("ISSUE_FROM_BAG", f"least(qty_active_bagged, {REM})"))), "lines"),
        "drawing_summary": v(f"SELECT project_id, iso_number, iso_sheet, iso_revision, count(*) AS line_count, count(DISTINCT req_id) AS requisitions, cast(sum(qty_requested) AS double) AS requested, cast(sum(qty_issued) AS double) AS issued, cast(sum({REM}) AS double) AS remaining, cast(CASE WHEN sum(qty_requested) > 0 THEN floor(cast(sum(qty_issued) AS double) * 100 / cast(sum(qty_requested) AS double) + 0.5) ELSE 0 END AS bigint) AS pct_issued FROM lines WHERE active GROUP BY ALL", "lines"),
        "header_rollup": v(f"SELECT req_id, CASE WHEN sum({REM}) <= 0 AND sum(qty_requested) > 0 THEN 'Complete' WHEN sum(qty_issued) > 0 THEN 'Partially Issued' WHEN sum(qty_pending_backorder) + sum(qty_confirmed_backorder) > 0 THEN 'Backordered' WHEN sum(qty_confirmed_located) > 0 THEN 'In Progress' ELSE 'Open' END AS status FROM lines WHERE active GROUP BY req_id", "lines"),
        "backorder_queue": v("SELECT project_id, id, line_id, status, cast(qty_pending AS double) AS qty_pending, cast(qty_confirmed AS double) AS qty_confirmed, row_number() OVER (PARTITION BY project_id ORDER BY line_id, reported_at, id) AS place FROM backorders WHERE active", "backorders"),
        "outstanding_notices": v("SELECT project_id, id, line_id, kind, severity, cast(qty_notified AS double) AS qty_notified, row_number() OVER (PARTITION BY project_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, raised_at, id) AS place FROM notices WHERE active", "notices"),
        "notices_by_line": v("SELECT line_id, count(*) AS notices, string_agg(cast(id AS string) || ':' || kind, ',' ORDER BY raised_at DESC, id DESC) AS listed FROM notices WHERE active GROUP BY line_id", "notices"),
        "active_bags_by_line": v("SELECT line_id, count(*) AS bags, cast(sum(qty_remaining) AS double) AS qty_in_bags, string_agg(DISTINCT bag_id, ',' ORDER BY bag_id) AS bag_ids FROM bag_items WHERE active AND qty_remaining > 0 GROUP BY line_id", "bag_items"),
        "dashboard_activity": v(f"SELECT project_id, action, count(*) AS n, cast(sum(quantity) AS double) AS quantity FROM movements WHERE ts > timestamp '{AS_OF}' - interval 24 hours AND ts <= timestamp '{AS_OF}' GROUP BY ALL", "movements"),
        "dashboard_backorders": v("SELECT project_id, status, count(*) AS n, cast(sum(qty_pending + qty_confirmed) AS double) AS quantity FROM backorders WHERE active GROUP BY ALL", "backorders"),
        "dashboard_bags": v("SELECT project_id, count(*) AS items, cast(sum(qty_remaining) AS double) AS quantity FROM bag_items WHERE active GROUP BY ALL", "bag_items"),
        "health": v(f"SELECT project_id, coalesce(b, 0) AS stale_backorders, coalesce(n, 0) AS stale_notices, coalesce(g, 0) AS stale_bags, last_activity, coalesce(b, 0) + coalesce(n, 0) + coalesce(g, 0) = 0 AS ok FROM (SELECT DISTINCT project_id FROM requisitions) LEFT JOIN (SELECT project_id, count(*) FILTER (reported_at < timestamp '{AS_OF}' - interval 7 days) AS b FROM backorders WHERE active AND status = 'Pending' GROUP BY 1) USING (project_id) LEFT JOIN (SELECT project_id, count(*) FILTER (raised_at < timestamp '{AS_OF}' - interval 3 days) AS n FROM notices WHERE active GROUP BY 1) USING (project_id) LEFT JOIN (SELECT project_id, count(*) FILTER (bagged_at < timestamp '{AS_OF}' - interval 30 days) AS g FROM bag_stock WHERE active AND qty_remaining > 0 GROUP BY 1) USING (project_id) LEFT JOIN (SELECT project_id, max(day) AS last_activity FROM movements GROUP BY 1) USING (project_id)", "requisitions", "backorders", "notices", "bag_stock", "movements"),
        "donor_candidates": v(f"WITH pairs AS (SELECT s.line_id AS receiver_id, d.line_id AS donor_id, d.qty_available AS lendable, {SHORT.replace('qty_', 's.qty_')} AS shortage FROM lines s JOIN lines d ON s.project_id = d.project_id AND upper(trim(s.commodity_code)) = upper(trim(d.commodity_code)) AND upper(trim(s.size)) = upper(trim(d.size)) AND upper(trim(s.uom)) = upper(trim(d.uom)) AND s.line_id <> d.line_id WHERE s.active AND d.active AND d.qty_available > 0 AND {SHORT.replace('qty_', 's.qty_')} > 0) SELECT receiver_id, donor_id, place, cast(lendable AS double) AS lendable, cast(shortage AS double) AS shortage FROM (SELECT *, row_number() OVER (PARTITION BY receiver_id ORDER BY lendable DESC, donor_id) AS place FROM pairs) WHERE place <= 25", "lines"),
        "time_saved": v("SELECT req_id, count(DISTINCT iso_number) AS drawings, count(*) FILTER (length(description) > 52) AS overflow, cast(17.30 + 33.36 * count(DISTINCT iso_number) + 20 * (count(*) - count(*) FILTER (length(description) > 52)) + 26 * count(*) FILTER (length(description) > 52) AS double) AS seconds FROM lines WHERE active GROUP BY req_id", "lines"),
        "settle_backorders": v(f"WITH {LOCATED}, {BUDGETS}, f AS (SELECT *, {_take('pool', 'budget', 'reported_at, id')} AS tc FROM a WHERE held >= budget), g AS (SELECT *, least(located - sum(tc) OVER (PARTITION BY line_id), greatest(0, waits)) AS left_over FROM f), k AS (SELECT *, {_take('waiting', 'left_over', 'reported_at, id')} AS tp FROM g) SELECT id, line_id, cast(tc AS double) AS take_confirmed, cast(tp AS double) AS take_pending, CASE WHEN qty_confirmed - tc + qty_pending - tp = 0 THEN 'Fulfilled' ELSE status END AS status FROM k WHERE tc > 0 OR tp > 0", "backorders", "line_totals"),
        "backorder_desync": v(f"WITH {LOCATED}, {BUDGETS} SELECT DISTINCT line_id, cast(held AS double) AS held, cast(budget AS double) AS asked FROM a WHERE held < budget", "backorders", "line_totals"),
        "settle_notices": v(f"WITH {LOCATED}, asked AS (SELECT line_id, cast(sum(quantity) AS decimal(14,4)) AS asked FROM movements WHERE action = 'BACKORDER_REQUESTED' GROUP BY 1), a AS (SELECT n.*, CASE kind WHEN 'REJECTED' THEN located ELSE asked END AS answer FROM notices n LEFT JOIN located USING (line_id) LEFT JOIN asked USING (line_id) WHERE active AND kind IN ('REJECTED', 'RETURNED')), t AS (SELECT *, {_take('qty_notified', 'answer', 'raised_at, id', 'line_id, kind')} AS taken FROM a WHERE answer IS NOT NULL) SELECT id, line_id, kind, cast(taken AS double) AS taken, CASE WHEN taken >= qty_notified THEN 'Resolved' ELSE 'Active' END AS status FROM t WHERE taken > 0", "notices"),
        "resubmit_returned": v(f"WITH {ASKED}, a AS (SELECT b.*, asked FROM backorders b JOIN asked USING (line_id) WHERE active AND status = 'Returned for Review'), t AS (SELECT *, {_take('qty_pending', 'asked', 'reported_at, id')} AS taken FROM a) SELECT line_id, count(*) FILTER (taken >= qty_pending) AS revived, cast(greatest(0, any_value(asked) - sum(qty_pending)) AS double) AS new_request FROM t GROUP BY line_id", "backorders"),
        "resubmit_requests": v(f"WITH {ASKED}, a AS (SELECT b.*, asked FROM backorders b JOIN asked USING (line_id) WHERE active AND status = 'Returned for Review'), t AS (SELECT *, {_take('qty_pending', 'asked', 'reported_at, id')} AS taken FROM a) SELECT line_id, id, cast(taken AS double) AS applied, cast(qty_pending AS double) AS qty_pending, CASE WHEN taken >= qty_pending THEN 'Pending' ELSE 'Returned for Review' END AS status FROM t WHERE taken > 0 UNION ALL SELECT line_id, NULL, 0, cast(asked - coalesce(s, 0) AS double), 'Pending' FROM asked LEFT JOIN (SELECT line_id, sum(taken) AS s FROM t GROUP BY 1) USING (line_id) WHERE asked > coalesce(s, 0)", "backorders"),
        "integrity_report": v("SELECT project_id, code, count(*) AS violations, round(sum(difference), 4) AS difference FROM (" + " UNION ALL ".join(f"({s})" for s in CHECKS.values()) + ") GROUP BY ALL", *CHECK_VIEWS),
        "repair_backorder_totals": v("SELECT l.line_id, cast(qty_pending_backorder AS double) AS pending_from, cast(coalesce(p, 0) AS double) AS pending_to, cast(qty_confirmed_backorder AS double) AS confirmed_from, cast(coalesce(c, 0) AS double) AS confirmed_to FROM lines l LEFT JOIN (SELECT line_id, sum(qty_pending) AS p, sum(qty_confirmed) AS c FROM backorders WHERE active GROUP BY 1) b ON l.line_id = b.line_id WHERE l.active AND (qty_pending_backorder <> coalesce(p, 0) OR qty_confirmed_backorder <> coalesce(c, 0))", "lines", "backorders"),
        "sweep_stale_notices": v("WITH i AS (SELECT line_id, sum(quantity) AS issued FROM movements WHERE action IN ('DIRECT_ISSUE', 'ISSUE_FROM_AVAILABLE') GROUP BY 1), r AS (SELECT n.id, kind, CASE WHEN coalesce(issued, 0) >= 1000 THEN 'No longer outstanding' WHEN kind <> 'REJECTED' AND b.id IS NULL THEN 'The request behind it is closed' END AS reason FROM notices n LEFT JOIN (SELECT id FROM backorders WHERE active) b ON n.id = b.id LEFT JOIN i ON i.line_id = n.line_id WHERE n.active) SELECT id, kind, CASE WHEN reason IS NULL THEN 'Active' ELSE 'Superseded' END AS status, reason FROM r", "notices", "backorders"),
        "replay_ledger": v(_replay(), "movements", recursive=True),
        "ledger_balance": v("SELECT line_id, cast(sum(CASE WHEN action IN ('CONFIRM_AVAILABLE', 'DIRECT_ISSUE') THEN quantity ELSE 0 END) AS double) AS located, cast(sum(CASE action WHEN 'CONFIRM_AVAILABLE' THEN quantity WHEN 'ISSUE_FROM_AVAILABLE' THEN -quantity ELSE 0 END) AS double) AS available, cast(sum(CASE WHEN action IN ('DIRECT_ISSUE', 'ISSUE_FROM_AVAILABLE') THEN quantity ELSE 0 END) AS double) AS issued, cast(sum(CASE action WHEN 'BACKORDER_REQUESTED' THEN quantity ELSE 0 END) AS double) AS pending, cast(sum(CASE action WHEN 'BAG' THEN quantity ELSE 0 END) AS double) AS bagged, count(*) AS commands FROM movements GROUP BY line_id", "movements"),
        "state_as_of": v(f"SELECT line_id, cast(sum(CASE WHEN action IN ('DIRECT_ISSUE', 'ISSUE_FROM_AVAILABLE') THEN quantity ELSE 0 END) AS double) AS issued, cast(sum(CASE action WHEN 'BACKORDER_REQUESTED' THEN quantity ELSE 0 END) AS double) AS pending, max(id) AS last_id FROM movements WHERE ts <= timestamp '{AS_OF}' GROUP BY line_id", "movements"),
        "decide_backorders": v("WITH d AS (SELECT *, CASE line_id % 4 WHEN 0 THEN 'CONFIRM' WHEN 1 THEN 'CONFIRM_HALF' WHEN 2 THEN 'REJECT' ELSE 'RETURN' END AS decision FROM backorders WHERE active AND status = 'Pending'), e AS (SELECT *, CASE decision WHEN 'CONFIRM' THEN qty_pending WHEN 'CONFIRM_HALF' THEN floor(qty_pending / 2) ELSE 0 END AS c FROM d) SELECT id, decision, CASE decision WHEN 'REJECT' THEN 'Rejected' WHEN 'RETURN' THEN 'Returned for Review' ELSE CASE WHEN qty_pending - c > 0 THEN 'Partially Confirmed' ELSE 'Confirmed' END END AS status, cast(c AS double) AS confirmed_delta, cast(CASE WHEN decision IN ('REJECT', 'RETURN') THEN 0 - qty_pending ELSE 0 - c END AS double) AS pending_delta FROM e", "backorders"),
        "line_history": v("SELECT line_id, id, action, cast(quantity AS double) AS quantity, coalesce(c_name, 'unknown') AS user_name, row_number() OVER (PARTITION BY line_id ORDER BY ts DESC, id DESC) AS place FROM movements LEFT JOIN customer ON c_custkey = line_id", "movements"),
        "select_revisions": v(f"WITH {REVISIONS} SELECT * FROM fates", "iso_pages"),
        "scan_counts": v(f"WITH {REVISIONS} SELECT fate, count(*) AS pages, count(DISTINCT drawing_number) AS drawings FROM fates GROUP BY fate", "iso_pages"),
        "purchase_rollup": v("SELECT project_id, commodity_code, size, uom, cast(sum(qty_requested) AS double) AS quantity, count(*) AS line_count FROM lines WHERE active GROUP BY ALL", "lines"),
        "iso_candidates": v("WITH t AS (SELECT DISTINCT iso_number, iso_sheet, iso_number || '-' || iso_sheet AS term FROM lines) SELECT term, term AS candidate FROM t UNION SELECT term, iso_number || '|' || iso_sheet FROM t UNION SELECT term, iso_number || '|' || cast(cast(iso_sheet AS int) AS string) FROM t", "lines"),
        "assign_bag_numbers": v("WITH m AS (SELECT project_id, regexp_extract(upper(trim(tag_number)), '^BT-([0-9]{4})-([0-9]+)$', ['y', 'c']) AS x FROM bag_stock), h AS (SELECT project_id, cast(x.y AS bigint) AS year, max(cast(x.c AS bigint)) AS top FROM m WHERE x.y <> '' GROUP BY 1, 2), b AS (SELECT i.project_id, bag_id, year(date_required) AS year, count(*) AS items FROM bag_items i JOIN requisitions r ON r.req_id = i.req_id GROUP BY 1, 2, 3), n AS (SELECT b.*, cast(coalesce(top, 0) + row_number() OVER (PARTITION BY b.project_id, b.year ORDER BY bag_id) AS varchar) AS n FROM b LEFT JOIN h ON h.project_id = b.project_id AND h.year = b.year) SELECT bag_id, items, 'BT-' || cast(year AS varchar) || '-' || CASE WHEN length(n) >= 5 THEN n ELSE lpad(n, 5, '0') END AS tag_number FROM n", "bag_items", "requisitions", "bag_stock"),
        "one_draft_per_number": v("SELECT req_id, CASE WHEN k = 1 THEN number END AS number, CASE WHEN k > 1 THEN 'ALREADY_STAGED' END AS issue FROM (SELECT req_id, number, row_number() OVER (PARTITION BY project_id, number ORDER BY req_id) AS k FROM (SELECT req_id, project_id, 'F' || cast(req_id // 3 AS string) AS number FROM requisitions))", "requisitions"),
        "normalize_materials": v(f"WITH {MATERIALS} SELECT * FROM materials", "material_text"),
        "row_confidence": v("SELECT part_id, cast(round(greatest(0, 1 - (CASE WHEN quantity = '' THEN 0.25 ELSE 0 END + CASE WHEN description = '' THEN 0.25 ELSE 0 END + CASE WHEN commodity_code = '' THEN 0.10 ELSE 0 END + CASE WHEN size = '' THEN 0.05 ELSE 0 END + CASE WHEN columns_uncertain THEN 0.15 ELSE 0 END + CASE WHEN wrapped THEN 0.05 ELSE 0 END + CASE WHEN category = '' THEN 0.10 ELSE 0 END)), 3) AS double) AS confidence, concat_ws('; ', CASE WHEN quantity = '' THEN 'no quantity' END, CASE WHEN description = '' THEN 'no description' END, CASE WHEN commodity_code = '' THEN 'no commodity code' END, CASE WHEN size = '' THEN 'no size' END, CASE WHEN columns_uncertain THEN 'column positions uncertain' END, CASE WHEN wrapped THEN 'row assembled from wrapped lines' END, CASE WHEN category = '' THEN 'category unclear' END) AS warnings FROM extracted", "extracted"),
        "read_paste": """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\r?\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS lines FROM documents), p AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS row FROM l),
c AS (SELECT doc_id, row, list_transform(CASE WHEN contains(line, chr(9)) THEN string_split(line, chr(9)) ELSE string_split(line, ',') END, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS c FROM p),
h AS (SELECT *, list_filter(c, lambda x: x <> '') AS f FROM c)
SELECT doc_id, cast(row AS bigint) AS row, c[1] AS commodity_code, c[2] AS size, c[3] AS description, c[4] AS quantity, c[5] AS uom, c[6] AS storage_location FROM h
WHERE NOT (row = 0 AND len(f) >= 2 AND len(list_filter(f, lambda x: NOT regexp_full_match(x, '(commodity|commodity\\s*code|code|item|item\\s*no\\.?|no\\.?|#|size|npd|bore|desc|description|material|qty|quantity|quant|uom|unit|units|u/m|loc|location|storage|storage\\s*location|remarks|notes)', 'i'))) = 0)""",
        "replay_workflow": v(_workflow(), "transitions", recursive=True),
        "group_extracted": v(f"WITH {MATERIALS}, {DRAFT_LINES} SELECT drawing, part_id, line_number, concat_ws(',', CASE WHEN no_sheet THEN 'NO_SHEET' END, CASE WHEN bad THEN 'BAD_QUANTITY' END, CASE WHEN zero THEN 'ZERO_QUANTITY' END, CASE WHEN odd THEN 'ODD_SIZE' END) AS issues FROM dl", "material_text"),
        "stage_status": v(f"WITH {MATERIALS}, {DRAFT_LINES}, s AS (SELECT drawing, count(*) AS line_count, cast(sum(no_sheet::int + bad::int + zero::int) AS bigint) AS errors, cast(sum(odd::int) AS bigint) AS warnings FROM dl GROUP BY drawing) SELECT *, CASE WHEN errors > 0 THEN 'Blocked' ELSE 'Ready' END AS status FROM s", "material_text"),
        "number_sequence_resume": v("SELECT project_id, cast(coalesce(max(try_cast(req_number AS bigint)), 0) + 1 AS bigint) AS next_number FROM requisitions GROUP BY project_id", "requisitions"),
        "package_number": v("SELECT project_id, date_required, count(DISTINCT iwp_number) AS candidates, CASE count(DISTINCT iwp_number) WHEN 0 THEN 'missing' WHEN 1 THEN 'unique' ELSE 'multiple' END AS fate, CASE WHEN count(DISTINCT iwp_number) = 1 THEN min(iwp_number) END AS package_number FROM requisitions GROUP BY project_id, date_required", "requisitions"),
        "content_hash": v("SELECT req_id, iso_number, iso_revision, count(*) AS rows, sha256(iso_number || '|' || iso_revision || chr(10) || string_agg(cast(line_number AS string) || '|' || commodity_code || '|' || size || '|' || description, chr(10) ORDER BY line_number)) AS content_hash FROM lines GROUP BY req_id, iso_number, iso_revision", "lines"),
        "spool_reconcile": v("WITH k AS (SELECT drawing_number, revision, count(DISTINCT content_hash) AS copies FROM iso_pages GROUP BY 1, 2), h AS (SELECT drawing_number, revision, source_path AS value, count(DISTINCT content_hash) AS held_by FROM iso_pages GROUP BY 1, 2, 3) SELECT h.*, copies, CASE WHEN held_by = copies THEN 'common' ELSE 'conflict' END AS fate FROM h JOIN k ON h.drawing_number = k.drawing_number AND h.revision = k.revision", "iso_pages"),
        "write_split": v("SELECT CASE WHEN round(1 - (CASE WHEN quantity = '' THEN 0.25 ELSE 0 END + CASE WHEN description = '' THEN 0.25 ELSE 0 END + CASE WHEN commodity_code = '' THEN 0.10 ELSE 0 END + CASE WHEN size = '' THEN 0.05 ELSE 0 END + CASE WHEN columns_uncertain THEN 0.15 ELSE 0 END + CASE WHEN wrapped THEN 0.05 ELSE 0 END + CASE WHEN category = '' THEN 0.10 ELSE 0 END), 3) >= 0.65 THEN 'clean' ELSE 'review' END AS bucket, count(*) AS rows, count(*) FILTER (concat_ws('; ', CASE WHEN quantity = '' THEN 'no quantity' END, CASE WHEN description = '' THEN 'no description' END, CASE WHEN commodity_code = '' THEN 'no commodity code' END, CASE WHEN size = '' THEN 'no size' END, CASE WHEN columns_uncertain THEN 'column positions uncertain' END, CASE WHEN wrapped THEN 'row assembled from wrapped lines' END, CASE WHEN category = '' THEN 'category unclear' END) <> '') AS with_warnings FROM extracted GROUP BY 1", "extracted"),
        "repay_swaps": v(f"WITH {LOCATED}, a AS (SELECT s.*, {OWED} AS owed, located FROM swaps s JOIN located ON donor_id = line_id WHERE status <> 'Cancelled' AND {OWED} > 0), t AS (SELECT *, {_take('owed', 'located', 'created_at, id', 'donor_id')} AS applied FROM a) SELECT id, donor_id, cast(applied AS double) AS applied, cast(owed - applied AS double) AS outstanding, CASE WHEN owed - applied <= 0 THEN 'Repaid' ELSE 'Partially Repaid' END AS status FROM t WHERE applied > 0", "swaps"),
        "open_swaps": v(f"SELECT project_id, id, donor_id, receiver_id, cast({OWED} AS double) AS owed, greatest(0, (epoch_us(timestamp '{AS_OF}') - epoch_us(created_at)) // 86400000000) AS age_days, row_number() OVER (PARTITION BY project_id ORDER BY created_at, id) AS place FROM swaps WHERE status <> 'Cancelled' AND {OWED} > 0", "swaps"),
        "swaps_for_line": v("SELECT line_id, count(*) AS swaps, cast(sum(lent) AS double) AS lent, cast(sum(borrowed) AS double) AS borrowed FROM (SELECT donor_id AS line_id, qty_borrowed AS lent, 0 AS borrowed FROM swaps WHERE status <> 'Cancelled' UNION ALL SELECT receiver_id, 0, qty_borrowed FROM swaps WHERE status <> 'Cancelled') GROUP BY line_id", "swaps"),
        "correctable_history": v("SELECT line_id, day, count(*) AS movements, cast(sum(quantity) AS double) AS quantity, max(id) AS last_id, string_agg(DISTINCT action, ',' ORDER BY action) AS actions FROM movements GROUP BY line_id, day", "movements"),
        "plan_corrections": v(_corrections(), "movements"),
        "field_notes_topk": v("WITH n AS (SELECT line_id, ts, id, action AS note FROM movements WHERE action <> 'CONFIRM_AVAILABLE' UNION ALL SELECT line_id, reported_at, id, status FROM backorders), p AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY ts DESC, id DESC, note) AS place, count(*) OVER (PARTITION BY line_id) AS notes FROM n) SELECT line_id, notes, notes > 20 AS truncated, string_agg(cast(id AS string) || ':' || note, ',' ORDER BY place) AS listed FROM p WHERE place <= 20 GROUP BY line_id, notes", "backorders"),
        "bag_closure": v("SELECT bag_id, count(*) AS items, CASE WHEN bool_or(active AND qty_remaining > 0) THEN 'Active' ELSE 'Closed' END AS status FROM bag_items GROUP BY bag_id", "bag_items"),
        "stream_sessions": "SELECT line_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY line_id ORDER BY ts, event_id) AS k FROM (SELECT user_id AS line_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < interval 30 minutes THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY line_id, k",
        "stream_dedup": f"SELECT event_id AS id, user_id AS line_id, {act} AS action, cast(ceil(value / 10) AS double) AS quantity FROM events",
        "stream_activity": f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, {act} AS action, count(*) AS n, sum(ceil(value / 10)) AS quantity FROM events GROUP BY ALL",
    }
    out |= {k: v(s, *CHECK_VIEWS) for k, s in CHECKS.items()}
    out |= {k: v(s, *MORE_VIEWS) for k, s in MORE_CHECKS.items()}
    every = " UNION ALL ".join(f"({s})" for s in (CHECKS | MORE_CHECKS).values())
    out["integrity_report_all"] = v(f"SELECT project_id, code, count(*) AS violations, round(sum(difference), 4) AS difference FROM ({every}) GROUP BY ALL", *MORE_VIEWS)
    return out | {"stream_ledger": out["replay_ledger"]}
