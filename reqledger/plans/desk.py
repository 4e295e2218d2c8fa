"""Queries of search, bags, decisions, drawing packages and members, each with its SQL for DuckDB. Lists, texts and codes are written out here, apart from the operators."""

from __future__ import annotations

from ..operators import bags, decisions, packages, search
from ..sources.bridge import with_views

AS_OF = "2024-01-15"
TYPES = ("CASE WHEN regexp_matches(coalesce(commodity_code, ''), '^5(UGSP|UG|US|MUG|FSS|FS|MHR|ABS|MS|CH|CC|CI|C|SH|S|DA|ISC|BG|MG|G)') THEN 'SUPPORT' WHEN starts_with(description, 'STUD BOLT') THEN 'BOLT' WHEN starts_with(description, 'GASKET') THEN 'GASKET' "
         "WHEN starts_with(description, 'PIPE') THEN 'PIPE' WHEN starts_with(description, 'ELBOW') THEN 'FITTING' ELSE 'SPECIALTY' END")
TAKEOFF = f"""t AS (SELECT *, {TYPES} AS item_type FROM bom_rows), k AS (SELECT row_id, drawing AS line_number, regexp_extract(drawing, '-([0-9]{{1,2}})$', 1) AS sheet, coalesce(schedule, '') AS pipe_spec,
  coalesce(cwa, '') AS cwa, 'IWP-' || cast(page % 20 AS varchar) AS iwp, coalesce(description, '') AS description, coalesce(nominal_size, '') AS size, coalesce(commodity_code, '') AS commodity_code, CASE WHEN item_type = 'PIPE' THEN replace(quantity, '''', '') ELSE quantity END AS quantity, CASE WHEN item_type = 'PIPE' THEN 'LF' ELSE 'EA' END AS uom, item_type,
  CASE WHEN item_type IN ('BOLT', 'GASKET') THEN 'BOLTS & GASKETS' WHEN item_type = 'SUPPORT' THEN 'SUPPORTS' WHEN starts_with(description, 'GATE VALVE') THEN 'VALVES' WHEN item_type IN ('PIPE', 'FITTING') THEN 'PIPE & FITTINGS' ELSE 'OTHER MATERIALS' END AS takeoff_sheet FROM t)"""
QUEUE = f"""q AS (SELECT s.project_id, tag_number, s.line_id, req_number, line_number, commodity_code, priority, bagged_at, CASE WHEN s.qty_issued > 0 THEN 'PARTIALLY_ISSUED' ELSE 'READY_FOR_FIELD' END AS readiness,
  bagged_at <= date '{AS_OF}' - 14 AS stale, upper(iso_number) || '|' || upper(iso_sheet) AS iso_key, cast(qty_remaining AS double) AS qty_remaining FROM bag_stock s JOIN lines l ON s.line_id = l.line_id JOIN requisitions r ON s.req_id = r.req_id WHERE s.active AND qty_remaining > 0)"""
TAGS = "t AS (SELECT project_id, tag_number, regexp_extract(upper(trim(tag_number)), '^([A-Z][A-Z0-9-]*)-([0-9]{4})-([0-9]+)$', ['p', 'y', 'c']) AS m FROM bag_stock)"
ISSUES = """n AS (SELECT draft_id, count(*) AS n FROM draft_lines GROUP BY 1), f AS (
  SELECT draft_id, 0 AS line_number, 'NO_FMR_NUMBER' AS code FROM drafts WHERE number IS NULL UNION ALL SELECT draft_id, 0, 'NO_IWP' FROM drafts WHERE trim(iwp) = '' UNION ALL SELECT draft_id, 0, 'NO_ISO' FROM drafts WHERE raw_drawing = ''
  UNION ALL SELECT draft_id, 0, 'NO_SHEET' FROM drafts WHERE raw_sheet = '' UNION ALL SELECT draft_id, 0, 'NO_LINES' FROM drafts WHERE draft_id NOT IN (SELECT draft_id FROM n)
  UNION ALL SELECT draft_id, line_number, 'NO_DESCRIPTION' FROM draft_lines WHERE trim(description) = '' UNION ALL SELECT draft_id, line_number, 'BAD_QUANTITY' FROM draft_lines WHERE try_cast(replace(raw_quantity, ',', '') AS double) IS NULL
  UNION ALL SELECT draft_id, line_number, 'ZERO_QUANTITY' FROM draft_lines WHERE try_cast(replace(raw_quantity, ',', '') AS double) <= 0 UNION ALL SELECT draft_id, line_number, 'ODD_SIZE' FROM draft_lines WHERE raw_size = 'SEE DETAIL'),
i AS (SELECT *, CASE WHEN code IN ('NO_IWP', 'ODD_SIZE') THEN 'warning' ELSE 'error' END AS severity FROM f)"""
STATUS = """CASE WHEN qty_requested - qty_issued <= 0 AND qty_requested > 0 THEN 'Issued' WHEN qty_issued > 0 THEN 'Partially Issued' WHEN qty_confirmed_backorder > 0 THEN 'Backordered' WHEN qty_pending_backorder > 0 THEN 'Pending Backorder'
  WHEN qty_active_bagged >= qty_requested AND qty_requested > 0 THEN 'Bagged' WHEN qty_active_bagged > 0 THEN 'Partially Bagged' WHEN qty_confirmed_located >= qty_requested AND qty_requested > 0 THEN 'Located' WHEN qty_confirmed_located > 0 THEN 'Partially Located' ELSE 'Open' END"""


def queries(over) -> dict:
    """over(f, *views) makes a query of a function of the named views."""
    takeoff = lambda f: over(lambda m: f(packages.takeoff_rows(m)), "bom_rows")
    queue = lambda f: over(lambda s, x, r: f(bags.active_queue(s, x, r, AS_OF)), "bag_stock", "lines", "requisitions")
    return {
        "search_lines": over(search.search_lines, "search_terms", "lines", "requisitions"),
        "requisition_detail": over(search.requisition_detail, "requisitions", "lines", "bag_items"),
        "active_bag_queue": queue(lambda q: q),
        "active_bag_summary": queue(bags.queue_summary),
        "bag_number_parse": over(bags.parse_tags, "bag_stock"),
        "bag_sequence_resume": over(bags.next_counters, "bag_stock"),
        "bag_fold_duplicates": over(bags.fold_duplicates, "bag_rows"),
        "raise_notices": over(decisions.raise_notices, "decided"),
        "incompatibility_reason": over(lambda x: decisions.refusals(decisions.neighbours(x)), "lines"),
        "validate_drafts": over(decisions.validate_drafts, "drafts", "draft_lines"),
        "assign_numbers": over(decisions.assign_numbers, "drafts", "published_numbers"),
        "publish_drafts": over(lambda d, x: decisions.publishable(d, decisions.validate_drafts(d, x, strict=False), x), "drafts", "draft_lines"),
        "classify_pages": over(packages.classify_pages, "page_text"),
        "page_counts": over(lambda p: packages.page_counts(packages.classify_pages(p)), "page_text"),
        "material_review": over(packages.material_review, "bom_rows"),
        "takeoff_rows": takeoff(lambda t: t),
        "takeoff_sheets": takeoff(packages.on_sheets),
        "takeoff_counts": takeoff(packages.takeoff_counts),
        "member_profile": over(packages.member_profiles, "members"),
        "permission_audit": over(packages.permission_audit, "requisitions", "members"),
    }


def oracle_sql() -> dict[str, str]:
    v = with_views
    missing = " , ".join(f"CASE WHEN coalesce(trim({c}), '') = '' THEN 'missing_{c}' END" for c in ("commodity_code", "description", "nominal_size", "quantity"))
    kinds = {
        "length(trim(text)) < 40": "ocr_required", "p LIKE '%ISOMETRIC DRAWING NUMBER%' AND p LIKE '%BILL OF MATERIALS%'": "iso",
        "(p LIKE '%INSTALLATION WORK PACKAGE%' OR p LIKE '%ISSUED FOR CONSTRUCTION%') AND (p LIKE '%IWP NUMBER%' OR regexp_matches(text, '(?i)\\b[A-Z]{2}-[A-Z0-9]+(-[A-Z0-9]+)+\\b'))": "cover", "p LIKE '%SECTION 15117%' AND p LIKE '%WELD/BRAZE LOG SHEET%'": "weld_log",
        "p LIKE '%PIPE HANGERS AND SUPPORTS%' AND p LIKE '%ATTACHMENT C%'": "pipe_support", "p LIKE '%FIELD MATERIAL REQUEST%'": "attachment", "p LIKE '%LOGISTICS PLAN%'": "logistics", "p LIKE '%ISOS IN PROCESSING%' AND p LIKE '%ISO REV WORKFLOW STATUS%'": "workflow_status",
        "p LIKE '%INSTALLATION WORK PACKAGE%'": "iwp_cover_ambiguous", "p LIKE '%ISOMETRIC DRAWING NUMBER%' OR p LIKE '%BILL OF MATERIALS%'": "partial_iso_structure",
    }
    pages = "c AS (SELECT page_id, CASE " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in kinds.items()) + " ELSE 'unrecognized_page' END AS kind FROM (SELECT *, regexp_replace(upper(text), '\\s+', ' ', 'g') AS p FROM page_text))"
    return {
        "search_lines": v("""WITH r AS (SELECT line_id, req_number, line_number, upper(iso_number) AS iso, upper(iso_number) || '|' || upper(iso_sheet) AS k FROM lines l JOIN requisitions q ON l.req_id = q.req_id WHERE l.active),
m AS (SELECT term, line_id FROM search_terms JOIN r ON length(term) = 3 AND substr(req_number, 1, 3) = upper(term) UNION SELECT term, line_id FROM search_terms JOIN r ON length(term) < 3 AND starts_with(req_number, upper(term)) UNION SELECT term, line_id FROM search_terms JOIN r ON length(term) = 4 AND (substr(iso, 1, 4) = upper(term) OR substr(req_number, 1, 4) = upper(term)) UNION SELECT term, line_id FROM search_terms JOIN r ON length(term) <= 3 AND starts_with(iso, upper(term))
  UNION SELECT term, line_id FROM search_terms JOIN r ON regexp_replace(upper(term), '^(.*)-([0-9]{1,2})$', '\\1|\\2') = k),
p AS (SELECT term, line_id, row_number() OVER (PARTITION BY term ORDER BY req_number, line_number, line_id) AS place, count(*) OVER (PARTITION BY term) AS matches FROM m JOIN r USING (line_id))
SELECT term, line_id, place, matches, matches > 200 AS truncated FROM p WHERE place <= 200""", "search_terms", "lines", "requisitions"),
        "requisition_detail": v(f"""WITH h AS (SELECT req_id, count(*) AS bag_items, sum(qty_remaining) AS in_bags FROM bag_items WHERE active AND qty_remaining > 0 GROUP BY 1),
l AS (SELECT req_id, count(*) AS line_count, string_agg(cast(line_number AS varchar) || ':' || {STATUS}, ',' ORDER BY line_number) AS listed, sum(qty_requested) AS requested, sum(qty_issued) AS issued, sum(greatest(0, qty_requested - qty_issued)) AS remaining FROM lines WHERE active GROUP BY 1)
SELECT r.req_id, req_number, priority, coalesce(line_count, 0) AS line_count, coalesce(listed, '') AS listed, cast(coalesce(requested, 0) AS double) AS requested, cast(coalesce(issued, 0) AS double) AS issued, cast(coalesce(remaining, 0) AS double) AS remaining, coalesce(bag_items, 0) AS bag_items, cast(coalesce(in_bags, 0) AS double) AS in_bags,
  cast(CASE WHEN requested > 0 THEN floor(cast(issued AS double) * 100 / cast(requested AS double) + 0.5) ELSE 0 END AS bigint) AS pct_issued FROM requisitions r LEFT JOIN l USING (req_id) LEFT JOIN h USING (req_id) WHERE r.active""", "requisitions", "lines", "bag_items"),
        "active_bag_queue": v(f"WITH {QUEUE} SELECT * FROM q", "bag_stock", "lines", "requisitions"),
        "active_bag_summary": v(f"WITH {QUEUE} SELECT project_id, count(DISTINCT tag_number) AS active_tags, count(*) AS active_items, count(*) FILTER (readiness = 'READY_FOR_FIELD') AS ready, count(*) FILTER (readiness <> 'READY_FOR_FIELD') AS partial, count(*) FILTER (stale) AS stale, sum(qty_remaining) AS quantity FROM q GROUP BY 1", "bag_stock", "lines", "requisitions"),
        "bag_number_parse": v(f"WITH {TAGS} SELECT DISTINCT tag_number, nullif(m.p, '') AS prefix, try_cast(m.y AS integer) AS year, try_cast(m.c AS bigint) AS counter FROM t", "bag_stock"),
        "bag_sequence_resume": v(f"WITH {TAGS} SELECT project_id, m.p AS prefix, cast(m.y AS integer) AS year, max(cast(m.c AS bigint)) + 1 AS next_counter FROM t WHERE m.p <> '' GROUP BY ALL", "bag_stock"),
        "bag_fold_duplicates": v("SELECT bag_id, line_id, min(row_id) AS row_id, cast(sum(quantity) AS double) AS quantity, count(*) AS merged, true AS active FROM bag_rows WHERE active GROUP BY 1, 2 UNION ALL SELECT bag_id, line_id, row_id, cast(quantity AS double), 1, false FROM bag_rows WHERE NOT active", "bag_rows"),
        "raise_notices": v("""WITH k AS (SELECT *, CASE WHEN decision = 'REJECT' THEN 'REJECTED' WHEN decision = 'RETURN' THEN 'RETURNED' WHEN decision = 'CONFIRM' AND NOT whole THEN 'CONFIRMED' END AS kind FROM decided),
g AS (SELECT line_id, request_id, kind, sum(quantity) AS quantity, arg_max(uom, (ts, id)) AS uom, arg_max(notes, (ts, id)) AS notes FROM k WHERE kind IS NOT NULL AND quantity > 0 GROUP BY 1, 2, 3)
SELECT line_id, request_id, kind, CASE kind WHEN 'REJECTED' THEN 'critical' WHEN 'RETURNED' THEN 'warning' ELSE 'info' END AS severity, cast(quantity AS double) AS quantity, cast(cast(quantity AS bigint) AS varchar) || ' ' || uom || CASE kind WHEN 'REJECTED' THEN ' rejected — source it on site' WHEN 'RETURNED' THEN ' returned — more detail needed' ELSE ' confirmed — on order' END AS headline, notes FROM g""", "decided"),
        "incompatibility_reason": v("""SELECT d.line_id AS donor_id, r.line_id AS receiver_id, CASE WHEN trim(d.commodity_code) = '' THEN 'no commodity code to match on' WHEN upper(trim(d.commodity_code)) <> upper(trim(r.commodity_code)) THEN 'a different commodity code' WHEN upper(trim(d.size)) <> upper(trim(r.size)) THEN 'a different size' WHEN upper(trim(d.uom)) <> upper(trim(r.uom)) THEN 'a different unit of measure' END AS reason
FROM lines d JOIN lines r ON d.req_id = r.req_id AND r.line_number = d.line_number + 1""", "lines"),
        "validate_drafts": v(f"WITH {ISSUES} SELECT draft_id, line_number, code, severity FROM i", "drafts", "draft_lines"),
        "assign_numbers": v("""WITH w AS (SELECT draft_id, project_id, upper(trim(coalesce(number, ''))) AS t FROM drafts WHERE state IN ('PENDING_MATERIAL_MANAGER', 'NUMBER_ASSIGNED') AND NOT archived), p AS (SELECT DISTINCT project_id, upper(trim(number)) AS t FROM published_numbers),
h AS (SELECT project_id, max(cast(t AS bigint)) AS highest FROM (SELECT project_id, t FROM w UNION ALL SELECT project_id, t FROM p) WHERE regexp_matches(t, '^[0-9]+$') GROUP BY 1),
c AS (SELECT w.*, CASE WHEN p.t IS NOT NULL OR row_number() OVER (PARTITION BY w.project_id, w.t ORDER BY draft_id) > 1 THEN 'NUMBER_IN_USE' ELSE 'OK' END AS code FROM w LEFT JOIN p ON p.project_id = w.project_id AND p.t = w.t WHERE w.t <> '')
SELECT draft_id, project_id, code, CASE WHEN code = 'OK' THEN t END AS assigned FROM c
UNION ALL SELECT draft_id, w.project_id, 'OK', cast(coalesce(highest, 0) + row_number() OVER (PARTITION BY w.project_id ORDER BY draft_id) AS varchar) FROM w LEFT JOIN h ON h.project_id = w.project_id WHERE t = ''""", "drafts", "published_numbers"),
        "publish_drafts": v(f"WITH {ISSUES}, b AS (SELECT DISTINCT batch_id FROM i JOIN drafts USING (draft_id) WHERE severity = 'error' AND code <> 'NO_FMR_NUMBER') SELECT sha256(project_id || '|' || cast(d.draft_id AS varchar)) AS req_key, d.draft_id, project_id, batch_id, n AS line_count FROM drafts d JOIN n ON d.draft_id = n.draft_id WHERE selected AND NOT archived AND state = 'NUMBER_ASSIGNED' AND batch_id NOT IN (SELECT batch_id FROM b)", "drafts", "draft_lines"),
        "classify_pages": v(f"WITH {pages} SELECT page_id, kind FROM c", "page_text"),
        "page_counts": v(f"WITH {pages} SELECT kind, count(*) AS pages FROM c GROUP BY 1", "page_text"),
        "material_review": v(f"SELECT row_id, array_to_string(list_sort(list_filter([{missing}, CASE WHEN row_id <> first THEN 'duplicate_bom_point_number' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM (SELECT *, min(row_id) OVER (PARTITION BY page, point) AS first FROM bom_rows)", "bom_rows"),
        "takeoff_rows": v(f"WITH {TAKEOFF} SELECT * FROM k", "bom_rows"),
        "takeoff_sheets": v(f"WITH {TAKEOFF} SELECT row_id, 'COMBINED' AS on_sheet, item_type, quantity FROM k UNION ALL SELECT row_id, takeoff_sheet, item_type, quantity FROM k", "bom_rows"),
        "takeoff_counts": v(f"WITH {TAKEOFF} SELECT takeoff_sheet, count(*) AS rows, count(DISTINCT line_number) AS drawings, count(*) FILTER (item_type = 'PIPE' AND pipe_spec = '') AS missing_pipe_spec FROM k GROUP BY 1", "bom_rows"),
        "member_profile": v("""SELECT user_id, project_id, CASE WHEN NOT search THEN 'CUSTOM' WHEN field_transact AND admin_backorder AND owner_edit AND plan_review AND assign_number THEN 'OWNER' WHEN field_transact AND NOT (admin_backorder OR owner_edit OR plan_review OR assign_number) THEN 'FIELD' WHEN plan_review AND NOT (field_transact OR admin_backorder OR owner_edit OR assign_number) THEN 'PLANNER'
  WHEN admin_backorder AND assign_number AND NOT (field_transact OR owner_edit OR plan_review) THEN 'ADMIN' WHEN NOT (field_transact OR admin_backorder OR owner_edit OR plan_review OR assign_number) THEN 'READ_ONLY' ELSE 'CUSTOM' END AS profile FROM members""", "members"),
        "permission_audit": v("SELECT project_id, coalesce(owners, 0) AS owners, coalesce(owners, 0) < 2 AS at_risk FROM (SELECT DISTINCT project_id FROM requisitions) LEFT JOIN (SELECT project_id, count(*) AS owners FROM members WHERE active AND owner_edit GROUP BY 1) USING (project_id)", "requisitions", "members"),
    }
