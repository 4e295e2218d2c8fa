"""Domain views over the star-schema tables. Each is one SELECT that Spark and the SQL oracles share, so that only the operators differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")
Q = "decimal(14,4)"
VIEWS = {
    "requisitions": """
SELECT o_orderkey AS req_id, 'P' || cast(o_orderkey % 4 AS string) AS project_id, cast(o_orderkey AS string) AS req_number,
  'IWP-' || cast(o_custkey AS string) AS iwp_number, c_name AS requested_by, cast(o_orderdate AS date) AS date_required,
  o_orderpriority AS priority, cast(o_orderdate AS date) AS last_activity, (o_orderstatus <> 'P' OR o_orderkey % 7 <> 0) AS active
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "raw_lines": """
SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS line_number,
  l_linestatus || l_returnflag AS state_code FROM lineitem l""",
    "lines": f"""
SELECT l_orderkey * 1000 + line_number AS line_id, l_orderkey AS req_id, 'P' || cast(l_orderkey % 4 AS string) AS project_id, line_number,
  'D-' || cast(l_partkey % 500 AS string) AS iso_number, lpad(cast(l_linenumber AS string), 2, '0') AS iso_sheet, cast(l_suppkey % 3 AS string) AS iso_revision,
  p_brand || '-' || p_type AS commodity_code, cast(p_size AS string) || '"' AS size, p_name AS description, CASE WHEN p_type = 'LARGE' THEN 'FT' ELSE 'EA' END AS uom,
  (l_orderkey + l_partkey) % 11 <> 0 AS active,
  cast(l_quantity AS {Q}) AS qty_requested,
  cast(CASE state_code WHEN 'FN' THEN l_quantity WHEN 'FA' THEN floor(l_quantity / 2) ELSE 0 END AS {Q}) AS qty_issued,
  cast(CASE state_code WHEN 'OA' THEN floor(l_quantity / 3) ELSE 0 END AS {Q}) AS qty_available,
  cast(CASE state_code WHEN 'OR' THEN floor(l_quantity / 4) ELSE 0 END AS {Q}) AS qty_active_bagged,
  cast(CASE state_code WHEN 'FN' THEN l_quantity WHEN 'FA' THEN floor(l_quantity / 2) WHEN 'OA' THEN floor(l_quantity / 3) WHEN 'OR' THEN floor(l_quantity / 4) ELSE 0 END AS {Q}) AS qty_confirmed_located,
  cast(CASE state_code WHEN 'ON' THEN floor(l_quantity / 5) ELSE 0 END AS {Q}) AS qty_pending_backorder,
  cast(CASE state_code WHEN 'FR' THEN floor(l_quantity / 6) ELSE 0 END AS {Q}) AS qty_confirmed_backorder
FROM raw_lines JOIN part ON l_partkey = p_partkey""",
    "counted_lines": f"""
SELECT line_id, project_id, CASE WHEN line_id % 211 = 0 THEN ' ' ELSE iso_number END AS iso_number, CASE WHEN line_id % 223 = 0 THEN NULL ELSE iso_sheet END AS iso_sheet, cast(CASE WHEN line_id % 61 = 0 THEN 0 WHEN line_id % 227 = 0 THEN -qty_requested ELSE qty_requested END AS {Q}) AS qty_requested,
  cast(qty_confirmed_located + CASE WHEN line_id % 67 = 0 THEN 1 WHEN line_id % 229 = 0 THEN -90 ELSE 0 END AS {Q}) AS qty_confirmed_located, cast(qty_available - CASE WHEN line_id % 233 = 0 THEN 40 ELSE 0 END AS {Q}) AS qty_available, cast(qty_active_bagged - CASE WHEN line_id % 239 = 0 THEN 40 ELSE 0 END AS {Q}) AS qty_active_bagged,
  cast(qty_issued + CASE WHEN line_id % 71 = 0 THEN 2 WHEN line_id % 241 = 0 THEN -90 ELSE 0 END AS {Q}) AS qty_issued, cast(qty_pending_backorder - CASE WHEN line_id % 251 = 0 THEN 40 ELSE 0 END AS {Q}) AS qty_pending_backorder, cast(qty_confirmed_backorder - CASE WHEN line_id % 257 = 0 THEN 40 ELSE 0 END AS {Q}) AS qty_confirmed_backorder FROM lines""",
    "stored_statuses": """
SELECT line_id, CASE WHEN line_id % 89 = 0 THEN 'Open' WHEN line_id % 83 = 0 THEN 'Issued' WHEN qty_issued >= qty_requested THEN 'Issued' WHEN qty_issued > 0 THEN 'Partially Issued'
  WHEN qty_confirmed_located > 0 THEN 'Partially Located' ELSE 'Open' END AS line_status FROM lines""",
    "movements": f"""
SELECT event_id AS id, user_id AS line_id, ts, cast(ts AS date) AS day, 'P' || cast(user_id % 4 AS string) AS project_id,
  CASE event_type WHEN 'view' THEN 'CONFIRM_AVAILABLE' WHEN 'click' THEN 'BAG' WHEN 'purchase' THEN 'ISSUE_FROM_AVAILABLE' WHEN 'error' THEN 'DIRECT_ISSUE' ELSE 'BACKORDER_REQUESTED' END AS action,
  cast(ceil(value / 10) AS {Q}) AS quantity FROM events""",
    "backorders": f"""
SELECT id, line_id, project_id, ts AS reported_at, day, CASE id % 4 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Confirmed' WHEN 2 THEN 'Partially Confirmed' ELSE 'Returned for Review' END AS status,
  quantity AS qty_requested,
  cast(CASE id % 4 WHEN 1 THEN quantity WHEN 2 THEN floor(quantity / 2) ELSE 0 END AS {Q}) AS qty_confirmed,
  cast(CASE id % 4 WHEN 1 THEN 0 WHEN 2 THEN quantity - floor(quantity / 2) ELSE quantity END AS {Q}) AS qty_pending, id % 9 <> 0 AS active
FROM movements WHERE action = 'BACKORDER_REQUESTED'""",
    "line_totals": f"""
SELECT line_id, cast(sum(CASE WHEN status IN ('Confirmed', 'Partially Confirmed') THEN qty_confirmed ELSE 0 END) + CASE WHEN line_id % 5 = 0 THEN 500 ELSE 0 END AS {Q}) AS confirmed, cast(floor(sum(CASE WHEN status = 'Pending' THEN qty_pending ELSE 0 END) / CASE WHEN line_id % 7 = 0 THEN 2 ELSE 1 END) AS {Q}) AS pending FROM backorders WHERE active GROUP BY line_id""",
    "notices": f"""
SELECT id, line_id, project_id, CASE id % 3 WHEN 0 THEN 'REJECTED' WHEN 1 THEN 'RETURNED' ELSE 'CONFIRMED' END AS kind,
  CASE id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, qty_requested AS qty_notified, reported_at AS raised_at, day, active FROM backorders""",
    "bag_items": f"""
SELECT line_id, req_id, project_id, iso_number, 'P' || cast(req_id AS string) || '-' || iso_number AS bag_id,
  cast(qty_active_bagged + CASE WHEN line_id % 97 = 0 THEN 1 ELSE 0 END AS {Q}) AS qty_remaining, active FROM lines WHERE qty_active_bagged > 0""",
    "transitions": """
SELECT event_id AS id, user_id AS draft_id, ts, CASE event_id % 6 WHEN 0 THEN 'SUBMIT' WHEN 1 THEN 'PLANNER_APPROVE' WHEN 2 THEN 'SEND_TO_MATERIAL' WHEN 3 THEN 'ASSIGN_NUMBER' WHEN 4 THEN 'PUBLISH' ELSE 'PLANNER_RETURN' END AS action,
  event_id % 7 <> 0 AS allowed, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS reason FROM events""",
    "swaps": f"""
SELECT id, line_id AS donor_id, line_id + 1 AS receiver_id, project_id, ts AS created_at, quantity AS qty_borrowed, cast(CASE WHEN id % 3 = 0 THEN floor(quantity / 3) ELSE 0 END AS {Q}) AS qty_repaid,
  CASE WHEN id % 11 = 0 THEN 'Cancelled' WHEN id % 3 = 0 THEN 'Partially Repaid' ELSE 'Open' END AS status FROM movements WHERE action = 'BAG'""",
    "field_log": f"""
SELECT event_id AS id, user_id AS line_id, ts, CASE WHEN event_id % 101 = 100 THEN 'UNDO' ELSE CASE event_id % 11 WHEN 0 THEN 'CONFIRM_AVAILABLE' WHEN 1 THEN 'BAG' WHEN 2 THEN 'ISSUE_FROM_BAG' WHEN 3 THEN 'BACKORDER_REQUESTED' WHEN 4 THEN 'OFFICE_CONFIRM' WHEN 5 THEN 'OFFICE_RETURN'
  WHEN 6 THEN 'BACKORDER_REQUESTED' WHEN 7 THEN 'DIRECT_ISSUE' WHEN 8 THEN 'OFFICE_REJECT' WHEN 9 THEN 'ISSUE_FROM_AVAILABLE' ELSE 'BACKORDER_REQUESTED' END END AS action,
  cast(CASE WHEN event_id % 37 = 0 THEN 0 WHEN event_id % 5 = 0 AND event_id % 11 IN (4, 5, 8) THEN NULL ELSE ceil(value / CASE WHEN event_id % 3 = 0 THEN 12 ELSE 40 END) END AS {Q}) AS quantity, CASE event_id % 13 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'T' || cast(event_id % 3 AS string) END AS tag,
  CASE WHEN event_id % 29 = 0 THEN '' ELSE 'RACK' END AS place, CASE WHEN event_id % 31 = 0 THEN NULL ELSE 'crew' END AS issued_to, CASE WHEN event_id % 17 = 0 THEN '' ELSE 'needed' END AS notes, cast(60 + user_id % 7 * 40 AS {Q}) AS requested FROM events""",
    "lenders": """
SELECT line_id, project_id, commodity_code, size, uom, row_number() OVER (PARTITION BY project_id, commodity_code, size, uom ORDER BY line_id) AS k FROM lines WHERE active AND qty_available > 0""",
    "borrow_requests": f"""
SELECT s.line_id * 4 + l.k AS id, s.line_id * 7919 % 100003 AS asked_at, CASE WHEN s.line_id % 37 = 0 THEN s.line_id WHEN s.line_id % 41 = 0 AND s.line_number > 1 THEN s.line_id - 1 ELSE l.line_id END AS donor_id, s.line_id AS receiver_id, cast(CASE WHEN s.line_id % 31 = 0 THEN 0 ELSE 1 + s.line_id % 9 END AS {Q}) AS quantity
FROM lines s JOIN lenders l ON s.project_id = l.project_id AND s.commodity_code = l.commodity_code AND s.size = l.size AND s.uom = l.uom AND l.k < 4 WHERE s.active AND s.line_id % 3 = 0 AND (s.qty_issued < s.qty_requested OR s.line_id % 5 = 0)""",
    "material_text": """
SELECT p_partkey AS part_id, CASE p_partkey % 8 WHEN 0 THEN '6 IN' WHEN 1 THEN '1.5' WHEN 2 THEN '0.75' WHEN 3 THEN '2X1 1/2' WHEN 4 THEN '1-1/2' WHEN 5 THEN '3/4"' WHEN 6 THEN 'SEE DETAIL' ELSE CASE WHEN p_partkey % 3 = 0 THEN '2-Jan' WHEN p_partkey % 3 = 1 THEN 'Mar-4' END END AS raw_size,
  CASE p_partkey % 5 WHEN 0 THEN '1,200' WHEN 1 THEN '49.2''' WHEN 2 THEN '40 FT' WHEN 3 THEN 'abc' ELSE '' END AS raw_quantity,
  CASE p_partkey % 9 WHEN 0 THEN 'PIPE ' WHEN 1 THEN 'GASKET ' WHEN 2 THEN 'STUD BOLT ' WHEN 3 THEN 'ELBOW ' WHEN 4 THEN 'GATE VALVE ' WHEN 5 THEN 'BLIND FLANGE ' WHEN 6 THEN 'PAINT ' WHEN 7 THEN 'U-BOLT GUIDE FOR PIPE ' ELSE '' END || upper(p_name) AS description,
  CASE WHEN p_partkey % 13 = 0 THEN '5UG' ELSE p_brand END AS commodity_code,
  CASE p_partkey % 6 WHEN 0 THEN ' d 100  a' WHEN 1 THEN 'D-44--10-' WHEN 2 THEN '' ELSE 'D-' || cast(p_partkey % 50 AS string) END AS raw_drawing,
  CASE p_partkey % 4 WHEN 0 THEN 'SHT 1' WHEN 1 THEN '12' WHEN 2 THEN 'A' ELSE 'Sheet 123' END AS raw_sheet FROM part""",
    "extracted": """
SELECT p_partkey AS part_id, CASE p_partkey % 8 WHEN 7 THEN '' ELSE cast(p_size AS string) END AS size, CASE p_partkey % 5 WHEN 4 THEN '' ELSE cast(p_partkey % 30 AS string) END AS quantity,
  CASE p_partkey % 11 WHEN 0 THEN '' ELSE p_name END AS description, CASE p_partkey % 13 WHEN 0 THEN '' ELSE p_brand END AS commodity_code, CASE p_partkey % 9 WHEN 8 THEN '' ELSE p_type END AS category,
  p_partkey % 17 = 0 AS columns_uncertain, p_partkey % 6 = 0 AS wrapped FROM part""",
    "bag_stock": f"""
SELECT l.line_id, l.req_id, l.project_id, CASE WHEN l.req_id % 7 = 0 THEN 'YARD ' || cast(l.req_id AS string) ELSE 'bt-' || cast(2022 + l.req_id % 3 AS string) || '-' || lpad(cast(l.req_id % 100000 AS string), 5, '0') END AS tag_number,
  r.date_required AS bagged_at, cast(CASE WHEN l.line_id % 5 = 0 THEN 2 ELSE 0 END AS {Q}) AS qty_issued, l.qty_active_bagged AS qty_remaining, l.active
FROM lines l JOIN requisitions r ON l.req_id = r.req_id WHERE l.qty_active_bagged > 0""",
    "bag_rows": """
SELECT line_id * 2 AS row_id, bag_id, line_id, qty_remaining AS quantity, active FROM bag_items
UNION ALL SELECT line_id * 2 + 1 AS row_id, bag_id, line_id, qty_remaining AS quantity, active FROM bag_items WHERE line_id % 10 = 3""",
    "search_terms": """
SELECT DISTINCT substr(req_number, 1, 3) AS term FROM requisitions UNION SELECT DISTINCT lower(iso_number) || '-' || iso_sheet AS term FROM lines UNION SELECT DISTINCT substr(iso_number, 1, 4) AS term FROM lines""",
    "decided": """
SELECT id, id % 50 AS request_id, line_id, ts, CASE id % 4 WHEN 0 THEN 'REJECT' WHEN 1 THEN 'RETURN' WHEN 2 THEN 'CONFIRM' ELSE 'UNKNOWN' END AS decision, id % 3 = 0 AS whole,
  CASE WHEN id % 10 = 0 THEN 0 ELSE quantity END AS quantity, CASE WHEN id % 5 = 0 THEN 'FT' ELSE 'EA' END AS uom, 'note ' || cast(id AS string) AS notes FROM movements""",
    "drafts": """
SELECT req_id AS draft_id, project_id, cast(floor(req_id / 2) AS bigint) AS batch_id, CASE WHEN req_id % 3 = 0 THEN NULL WHEN req_id % 3 = 1 THEN req_number ELSE 'X' || req_number END AS number, CASE WHEN req_id % 10 = 0 THEN ' ' ELSE iwp_number END AS iwp,
  CASE req_id % 8 WHEN 0 THEN '' ELSE 'd ' || cast(req_id % 50 AS string) END AS raw_drawing, CASE req_id % 9 WHEN 0 THEN '' ELSE cast(req_id % 12 AS string) END AS raw_sheet,
  CASE req_id % 4 WHEN 0 THEN 'PENDING_MATERIAL_MANAGER' WHEN 1 THEN 'NUMBER_ASSIGNED' WHEN 2 THEN 'DRAFT' ELSE 'NUMBER_ASSIGNED' END AS state, req_id % 6 <> 0 AS selected, req_id % 11 = 0 AS archived FROM requisitions""",
    "published_numbers": "SELECT project_id, req_number AS number FROM requisitions WHERE req_id % 5 = 0 UNION ALL SELECT project_id, 'x' || req_number FROM requisitions WHERE req_id % 7 = 0",
    "draft_lines": """
SELECT req_id AS draft_id, line_number, CASE line_id % 41 WHEN 0 THEN 'abc' WHEN 1 THEN '' WHEN 2 THEN '0' WHEN 3 THEN '1,200' ELSE cast(line_id % 90 + 1 AS string) END AS raw_quantity,
  CASE line_id % 37 WHEN 0 THEN 'SEE DETAIL' WHEN 1 THEN '' ELSE size END AS raw_size, CASE line_id % 43 WHEN 0 THEN ' ' ELSE description END AS description FROM lines""",
    "page_text": """
SELECT p_partkey AS page_id, CASE p_partkey % 12 WHEN 0 THEN 'short page' WHEN 1 THEN 'Isometric  Drawing Number D-1 and the Bill of' || chr(10) || 'Materials follow here' WHEN 2 THEN 'Installation Work Package cover, IWP Number 12, issued' WHEN 3 THEN 'issued for construction, package AB-12C-7 of this site'
  WHEN 4 THEN 'Section 15117 fabrication of metallic pipe and tubing, Attachment A - Weld/Braze Log Sheet' WHEN 5 THEN 'Pipe hangers and supports as told by attachment C of it' WHEN 6 THEN 'a Field Material Request is attached to this long page' WHEN 7 THEN 'Logistics plan of the site with many words in it, more'
  WHEN 8 THEN 'isos in processing: and the iso rev workflow status of all' WHEN 9 THEN 'Installation Work Package page with nothing to be read' WHEN 10 THEN 'only a Bill of Materials is here, without the drawing no' ELSE p_name || ' is not a page that any of the rules knows about' END AS text FROM part""",
    "bom_rows": """
SELECT l_orderkey * 1000 + line_number AS row_id, l_partkey % 300 AS page, l_linenumber AS point, CASE l_partkey % 7 WHEN 0 THEN 'PIPE ' WHEN 1 THEN 'GASKET ' WHEN 2 THEN 'STUD BOLT ' WHEN 3 THEN 'ELBOW ' WHEN 4 THEN '' ELSE 'GATE VALVE ' END || CASE WHEN l_partkey % 7 = 4 THEN '' ELSE p_name END AS description,
  CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE cast(p_size AS string) END AS nominal_size, CASE WHEN l_partkey % 13 = 0 THEN '5UG' WHEN l_partkey % 9 = 0 THEN ' ' ELSE p_brand END AS commodity_code,
  CASE l_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN cast(l_partkey % 40 AS string) || '.5''' ELSE cast(l_partkey % 12 AS string) END AS quantity,
  'D-' || cast(l_partkey % 300 AS string) || CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE '-0' || cast(l_suppkey % 4 AS string) END AS drawing, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 'S' || cast(l_suppkey % 5 AS string) END AS schedule,
  CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE 'CWA ' || cast(l_partkey % 4 AS string) END AS cwa, 'IWP-' || cast(l_partkey % 300 % 20 AS string) AS iwp
FROM raw_lines JOIN part ON l_partkey = p_partkey""",
    "members": """
SELECT c_custkey AS user_id, 'P' || cast(c_custkey % 4 AS string) AS project_id, c_custkey % 29 <> 0 AS search, c_custkey % 5 IN (1, 4) AS field_transact, c_custkey % 5 IN (3, 4) AS admin_backorder, c_custkey % 5 = 4 AS owner_edit,
  c_custkey % 5 IN (2, 4) AS plan_review, c_custkey % 5 IN (3, 4) AND c_custkey % 31 <> 0 AS assign_number, c_custkey % 6 <> 0 AS active FROM customer""",
    "controls": """
SELECT 'P' || cast(n_nationkey AS string) AS project_id, n_nationkey % 2 = 1 OR n_nationkey = 2 AS field_locked, n_nationkey % 3 = 2 AS import_locked, CASE WHEN n_nationkey = 1 THEN NULL ELSE 'stocktake of ' || n_name END AS reason FROM nation WHERE n_nationkey < 3""",
    "corrections": """
SELECT l.line_id AS id, l.line_id, l.req_id, l.project_id, r.last_activity AS applied_at, CASE WHEN l.line_id % 3 = 0 THEN 'CORRECTION_DIRECT_ISSUE' ELSE 'REVERSAL_DIRECT_ISSUE' END AS types, 'recount ' || cast(l.line_number AS string) AS reason
FROM lines l JOIN requisitions r ON l.req_id = r.req_id WHERE l.line_id % 10 = 3""",
    "review_items": """
SELECT draft_id, project_id, batch_id, number, archived, draft_id % 7 = 6 AS published, CASE draft_id % 7 WHEN 0 THEN 'DRAFT' WHEN 1 THEN 'PENDING_PLANNER_REVIEW' WHEN 2 THEN 'PLANNER_APPROVED' WHEN 3 THEN 'PLANNER_RETURNED' WHEN 4 THEN 'PENDING_MATERIAL_MANAGER' WHEN 5 THEN 'NUMBER_ASSIGNED' ELSE 'PUBLISHED' END AS state FROM drafts""",
    "batches": """
SELECT batch_id, CASE batch_id % 3 WHEN 0 THEN 'workbook' WHEN 1 THEN 'drawings' ELSE 'manual' END AS source, batch_id % 13 = 0 AS archived, batch_id % 7 = 0 AS published, cast(9 AS bigint) AS line_count, cast(1 AS bigint) AS error_count, cast(2 AS bigint) AS warning_count FROM (SELECT DISTINCT batch_id FROM drafts) d
UNION ALL SELECT cast(-1 - n_nationkey AS bigint), 'manual', false, false, cast(n_nationkey AS bigint), cast(0 AS bigint), cast(1 AS bigint) FROM nation""",
    "draft_issues": """
SELECT draft_id, CASE WHEN line_number = 7 THEN NULL ELSE line_number END AS line_number, CASE WHEN raw_quantity IN ('abc', '') THEN 'BAD_QUANTITY' WHEN raw_quantity = '0' THEN 'ZERO_QUANTITY' WHEN trim(description) = '' THEN 'NO_DESCRIPTION' ELSE 'ODD_SIZE' END AS code,
  CASE WHEN raw_quantity IN ('abc', '') OR trim(description) = '' THEN 'error' ELSE 'warning' END AS severity, line_number % 3 = 0 AS resolved FROM draft_lines WHERE raw_quantity IN ('abc', '', '0') OR trim(description) = '' OR raw_size = 'SEE DETAIL'""",
    "incoming": """
SELECT req_id AS draft_id, project_id, CASE req_id % 3 WHEN 0 THEN cast(req_id + 4 AS string) WHEN 1 THEN 'x' || cast(req_id + 8 - req_id % 8 AS string) ELSE NULL END AS number FROM requisitions WHERE req_id % 5 = 0""",
    "split_requests": "SELECT id, line_id, CASE WHEN id % 6 = 0 THEN NULL WHEN id % 17 = 0 THEN id + 100000000000 ELSE id - 1 END AS split_from_id, quantity AS qty_requested FROM movements",
    "pick_values": """
SELECT CASE p_partkey % 4 WHEN 0 THEN 'BACKORDER_REASON' WHEN 1 THEN 'UOM' WHEN 2 THEN 'PRIORITY' ELSE 'STORAGE_LOCATION' END AS list_name, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'P' || cast(cast(floor(p_partkey / 7) AS bigint) % 4 AS string) END AS project_id,
  p_type || ' ' || cast(p_size AS string) AS value, p_partkey % 7 <> 0 AS active FROM part""",
    "line_places": "SELECT project_id, CASE WHEN line_id % 9 = 0 THEN '' ELSE 'BIN ' || iso_sheet || '-' || cast(line_id % 60 AS string) END AS storage_location FROM lines",
    "owned_profiles": "SELECT 'P' || cast(n_nationkey % 4 AS string) AS project_id, CASE n_nationkey % 5 WHEN 0 THEN 'Default' WHEN 1 THEN 'TAKEOFF' ELSE n_name END AS name FROM nation WHERE n_nationkey < 8",
    "package_pages": """
SELECT p_partkey AS page_id, cast(floor(p_partkey / 25) AS bigint) AS package_id, p_partkey % 25 AS page, CASE WHEN p_partkey % 9 IN (3, 4, 5) THEN 1 ELSE 0 END AS images,
  CASE WHEN p_partkey % 27 = 3 THEN 'view  looking' WHEN p_partkey % 27 = 4 THEN 'north of it' WHEN p_partkey % 9 IN (3, 4, 5) THEN '' WHEN p_partkey % 9 = 2 AND p_partkey % 4 < 2 THEN 'Pipe hangers and supports as told by attachment C of it'
    WHEN p_partkey % 9 = 6 AND p_partkey % 5 < 3 THEN 'Isometric Drawing Number D-1 and the Bill of Materials follow here' WHEN p_partkey % 9 = 2 THEN 'a Field Material Request is attached to this long page' ELSE p_name || ' is not a page that any of the rules knows about' END AS text FROM part""",
    "cell_text": """
SELECT p_partkey AS part_id, CASE p_partkey % 7 WHEN 0 THEN '2-Jan' WHEN 1 THEN 'Mar 4' WHEN 2 THEN '1-DEC' WHEN 3 THEN '8-Maybe' WHEN 4 THEN '5-Foo' WHEN 5 THEN ' 3 april ' ELSE '1/2' END AS raw_size,
  CASE p_partkey % 5 WHEN 0 THEN '2024-03-09' WHEN 1 THEN '3/9/2024' WHEN 2 THEN ' Mar 9, 2024' WHEN 3 THEN 'soon' ELSE '' END AS raw_date, CASE p_partkey % 4 WHEN 0 THEN '1,' || lpad(cast(p_partkey % 1000 AS string), 3, '0') || '.5' WHEN 1 THEN ' 7 ' WHEN 2 THEN 'n/a' ELSE NULL END AS raw_number,
  CASE p_partkey % 3 WHEN 0 THEN ' yes' WHEN 1 THEN 'Y' ELSE NULL END AS raw_flag, CASE p_partkey % 3 WHEN 0 THEN 'TXN-1A1855A9-0000-4000-8000-0000000000FF' WHEN 1 THEN '1a1855a9-0000-4000-8000-0000000000ff' ELSE 'odd-key' END AS raw_key,
  ' User' || cast(p_partkey AS string) || '@Example.COM ' AS raw_email, p_brand || ' / ' || p_name AS package, 'CWA ' || cast(p_partkey % 3 AS string) AS area, p_partkey % 120 AS sheet_index FROM part""",
    "legacy_headers": """
SELECT 'FMR-' || cast(o_orderkey AS string) AS fmr_id, ' ' || cast(o_orderkey AS string) || ' ' AS fmr_number, CASE o_orderkey % 4 WHEN 0 THEN cast(cast(o_orderdate AS date) AS string) WHEN 1 THEN '' ELSE 'soon' END AS date_required,
  CASE o_orderkey % 5 WHEN 0 THEN ' ' ELSE 'In Progress' END AS current_status, CASE o_orderkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN ' YES ' ELSE 'no' END AS active FROM orders WHERE o_orderkey % 17 <> 0""",
    "legacy_lines": """
SELECT 'LN-' || cast(line_id AS string) AS line_id, 'FMR-' || cast(req_id AS string) AS fmr_id, CASE WHEN line_id % 61 = 0 THEN 'none' WHEN qty_requested > 45 THEN '1,0' || cast(cast(qty_requested AS bigint) AS string) ELSE cast(cast(qty_requested AS bigint) AS string) END AS qty_requested,
  cast(cast(qty_confirmed_located AS bigint) + CASE WHEN line_id % 53 = 0 THEN 1 ELSE 0 END AS string) AS qty_confirmed_located, cast(cast(qty_available AS bigint) AS string) AS qty_available, cast(cast(qty_active_bagged AS bigint) AS string) AS qty_active_bagged,
  cast(cast(qty_issued AS bigint) AS string) AS qty_issued, iso_number, CASE WHEN line_id % 71 = 0 THEN ' ' ELSE iso_sheet END AS iso_sheet, CASE line_id % 4 WHEN 0 THEN 'said "now"' WHEN 1 THEN 'two' || chr(10) || 'lines, here' ELSE description END AS notes FROM lines""",
    "legacy_requests": """
SELECT 'BO-' || cast(line_id AS string) AS request_id, 'FMR-' || cast(req_id AS string) AS fmr_id, CASE WHEN line_id % 47 = 0 THEN 'LN-0' ELSE 'LN-' || cast(line_id AS string) END AS line_id, cast(cast(qty_pending_backorder AS bigint) AS string) AS qty_pending,
  CASE line_id % 5 WHEN 0 THEN 'Pending Admin Review' WHEN 1 THEN ' returned to FIELD' WHEN 2 THEN '' WHEN 3 THEN 'Confirmed' ELSE NULL END AS status, CASE line_id % 3 WHEN 0 THEN 'CORR-1A1855A9-0000-4000-8000-0000000000FF' WHEN 1 THEN '' ELSE 'odd' END AS correlation_id FROM lines WHERE qty_pending_backorder > 0""",
    "grid_rows": """
SELECT o_orderkey AS sheet_id, 0 AS row, 'FIELD MATERIAL REQUEST' AS cells_text FROM orders UNION ALL SELECT o_orderkey, 1, 'IWP No:;' || cast(o_custkey AS string) || ';Item;x' FROM orders
UNION ALL SELECT o_orderkey, 2, CASE o_orderkey % 4 WHEN 0 THEN 'Item;Commodity Code;Size;Description;Qty;UOM' WHEN 1 THEN '#;Code;N.P.S;material description;Qty. Req;Unit' WHEN 2 THEN 'No;Cmdty;Dia;Desc;Required amount;U/M' ELSE 'alpha;beta;--' END FROM orders
UNION ALL SELECT l_orderkey, cast(line_number + 2 AS int), CASE WHEN line_number % 9 = 8 OR (l_orderkey % 10 = 5 AND line_number BETWEEN 2 AND 4) THEN ';;;;;' WHEN l_orderkey % 6 = 2 AND line_number = 4 THEN ';;;Total of all;9;' ELSE
  cast(line_number AS string) || ';' || p_brand || ';' || CASE WHEN l_partkey % 19 = 0 THEN 'SEE DETAIL' ELSE cast(p_size AS string) END || ';' || CASE WHEN l_partkey % 23 = 0 THEN ' ' ELSE p_name END || ';' || CASE l_partkey % 29 WHEN 0 THEN 'abc' WHEN 1 THEN '0' ELSE cast(cast(l_quantity AS bigint) AS string) END || ';' || CASE WHEN l_partkey % 2 = 0 THEN 'ft' ELSE 'EA' END END
FROM raw_lines JOIN part ON l_partkey = p_partkey""",
    "words": """
SELECT l_orderkey * 1000 + line_number AS word_id, l_orderkey AS page_id, cast(l_partkey % 600 AS double) AS x0, cast(l_suppkey % 10 AS double) * 3 + cast(line_number % 3 AS double) * 200 AS top, cast(600 AS double) AS page_width, cast(500 AS double) AS page_height,
  CASE WHEN l_partkey % 3 = 0 THEN 'd-' || cast(l_partkey % 12 AS string) ELSE p_brand END AS text FROM raw_lines JOIN part ON l_partkey = p_partkey""",
    "word_pages": "SELECT o_orderkey AS page_id, 'pkg-' || cast(o_custkey AS string) AS source_name FROM orders",
    "column_ranges": """
SELECT o_orderkey AS page_id, 'code' AS name, cast(20 AS double) AS x_from, cast(150 + o_orderkey % 3 * 20 AS double) AS x_to FROM orders UNION ALL SELECT o_orderkey, 'description', cast(150 + o_orderkey % 3 * 20 AS double), cast(350 AS double) FROM orders
UNION ALL SELECT o_orderkey, 'quantity', cast(350 AS double), cast(580 AS double) FROM orders""",
    "bom_words": """
SELECT o_orderkey * 1000000 + k AS word_id, o_orderkey AS page_id, cast(x AS double) AS x0, cast(y AS double) AS top, text FROM orders CROSS JOIN (VALUES (1, -1, 700, 40, 'BILL'), (2, -1, 730, 40, 'OF'), (3, -1, 750, 40, 'MATERIALS'), (4, 0, 698, 60, 'PT'), (5, 0, 715, 60, 'NO'), (6, 0, 760, 60, 'DESCRIPTION'), (7, 0, 852, 60, 'NPD'), (8, 0, 905, 60, 'CMDTY'), (9, 0, 935, 60, 'CODE'), (10, 0, 978, 60, 'Qty.'),
  (11, 1, 700, 56, 'PT'), (12, 1, 850, 56, 'NPD'), (13, 1, 908, 56, 'CMDTY'), (14, 1, 697, 64, 'NO'), (15, 1, 770, 64, 'DESCRIPTION'), (16, 1, 980, 64, 'QTY'), (17, 1, 906, 72, 'CODE'), (18, 2, 700, 60, 'ITEM'), (19, 2, 765, 60, 'DESC'), (20, 2, 980, 60, 'QUANTITY'), (21, -1, 705, 20, 'NO'), (22, -1, 760, 20, 'DESCRIPTION'), (23, -1, 900, 20, 'REMARKS'),
  (24, -1, 700, 9000, 'ISSUED'), (25, -1, 740, 9000, 'FOR'), (26, -1, 770, 9000, 'CONSTRUCTION'), (27, -1, 701, 9020, '7'), (28, -1, 745, 9020, 'AFTER'), (29, -1, 980, 9020, '2'), (30, 3, 700, 60, 'PT')) h(k, form, x, y, text) WHERE form = -1 OR form = CASE WHEN o_orderkey % 11 = 0 THEN 3 ELSE o_orderkey % 3 END
UNION ALL SELECT l_orderkey * 1000000 + line_number * 1000 + k, l_orderkey, cast(x AS double) + CASE WHEN k IN (2, 3) THEN l_partkey % 7 ELSE 0 END, cast(100 + line_number * 30 + y AS double), CASE k WHEN 1 THEN cast(line_number AS string) WHEN 2 THEN p_name WHEN 3 THEN 'SCH' || cast(l_suppkey % 90 AS string) WHEN 4 THEN cast(p_size AS string) || '"'
    WHEN 5 THEN CASE WHEN l_partkey % 23 = 0 THEN 'LBS,' ELSE 'C' || cast(1000000 + p_partkey AS string) END WHEN 6 THEN cast(cast(l_quantity AS bigint) AS string) || CASE WHEN l_partkey % 6 = 0 THEN '.5''' ELSE '' END WHEN 7 THEN '3' WHEN 8 THEN 'FULL' WHEN 9 THEN 'BORE' WHEN 10 THEN 'FLANGES' WHEN 11 THEN 'PIPE' WHEN 12 THEN 'SUPPORTS' WHEN 13 THEN 'SHEET' WHEN 14 THEN 'A1' WHEN 15 THEN 'X' ELSE '4' END
  FROM raw_lines JOIN part ON l_partkey = p_partkey CROSS JOIN (VALUES (1, 702, 0), (2, 742, 1), (3, 800, 2), (4, 855, 0), (5, 910, 1), (6, 982, 0), (7, 948, 3), (8, 745, 9), (9, 790, 9), (10, 703, 18), (11, 703, 18), (12, 740, 18), (13, 720, 24), (14, 760, 24), (15, 705, 0), (16, 1003, 1)) w(k, x, y)
  WHERE CASE k WHEN 1 THEN l_partkey % 31 <> 0 WHEN 4 THEN l_suppkey % 6 <> 0 WHEN 6 THEN l_orderkey % 13 <> 0 WHEN 7 THEN l_suppkey % 7 = 0 WHEN 8 THEN l_partkey % 5 = 0 WHEN 9 THEN l_partkey % 5 = 0 WHEN 10 THEN line_number % 4 = 0 AND l_orderkey % 2 = 0 WHEN 11 THEN line_number % 4 = 0 AND l_orderkey % 2 = 1 WHEN 12 THEN line_number % 4 = 0 AND l_orderkey % 2 = 1
    WHEN 13 THEN line_number % 5 = 2 WHEN 14 THEN line_number % 5 = 2 WHEN 15 THEN l_partkey % 37 = 5 WHEN 16 THEN l_suppkey % 9 = 1 ELSE true END""",
    "form_rows": """
SELECT o_orderkey AS sheet_id, CASE o_orderkey % 13 WHEN 0 THEN 'Instructions (2)' WHEN 1 THEN 'NOTES' WHEN 2 THEN 'Notes to buyer' WHEN 3 THEN 'cover' ELSE 'FMR ' || cast(o_orderkey AS string) END AS sheet_name, 0 AS row, CASE o_orderkey % 5 WHEN 0 THEN 'FMR No:;' || cast(o_orderkey AS string) || ';SHT:;' || cast(o_orderkey % 9 AS string) WHEN 1 THEN 'title;FMR: F-' || cast(o_orderkey AS string) || ' ;;'
  WHEN 2 THEN 'FMR #;SHT:; ;77' WHEN 3 THEN 'form;FMR Number.' || chr(10) || 'S-' || cast(o_orderkey AS string) || ';Sheet;A12' ELSE 'no label here;FMR No' END AS cells_text FROM orders
UNION ALL SELECT o_orderkey, CASE o_orderkey % 13 WHEN 0 THEN 'Instructions (2)' WHEN 1 THEN 'NOTES' WHEN 2 THEN 'Notes to buyer' WHEN 3 THEN 'cover' ELSE 'FMR ' || cast(o_orderkey AS string) END, 1, CASE o_orderkey % 4 WHEN 0 THEN 'Drawing No.;Rev:;;;' WHEN 1 THEN 'ISO = d 10 ' || cast(o_orderkey % 7 AS string) || ';Rev:;B:2' WHEN 2 THEN 'x;iso no;D--' || cast(o_orderkey % 30 AS string) || ';IWP;Craft:;Deliver To;north' ELSE '' END FROM orders
UNION ALL SELECT o_orderkey, CASE o_orderkey % 13 WHEN 0 THEN 'Instructions (2)' WHEN 1 THEN 'NOTES' WHEN 2 THEN 'Notes to buyer' WHEN 3 THEN 'cover' ELSE 'FMR ' || cast(o_orderkey AS string) END, 2, CASE o_orderkey % 4 WHEN 0 THEN ';7;' WHEN 1 THEN 'Requestor;;;' || o_orderpriority || ';Priority:;' || o_orderpriority ELSE 'Urgency;;; ;far' END FROM orders
UNION ALL SELECT o_orderkey, CASE o_orderkey % 13 WHEN 0 THEN 'Instructions (2)' WHEN 1 THEN 'NOTES' WHEN 2 THEN 'Notes to buyer' WHEN 3 THEN 'cover' ELSE 'FMR ' || cast(o_orderkey AS string) END, 3, CASE WHEN o_orderkey % 8 = 0 THEN 'D-' || cast(o_orderkey % 40 AS string) ELSE 'Craft: Pipe' || chr(10) || 'Warehouse = W' || cast(o_orderkey % 3 AS string) END || ';Need By;' || cast(cast(o_orderdate AS date) AS string) FROM orders
UNION ALL SELECT o_orderkey, CASE o_orderkey % 13 WHEN 0 THEN 'Instructions (2)' WHEN 1 THEN 'NOTES' WHEN 2 THEN 'Notes to buyer' WHEN 3 THEN 'cover' ELSE 'FMR ' || cast(o_orderkey AS string) END, 4, CASE WHEN o_orderkey % 6 = 5 THEN 'alpha;beta' ELSE 'Item;Code;Size;Description;' || CASE WHEN o_orderkey % 7 = 0 THEN 'Many' ELSE 'Qty' END || ';UOM;' || CASE WHEN o_orderkey % 4 = 3 THEN 'Drawing-No' ELSE 'Remarks' END END FROM orders
UNION ALL SELECT l_orderkey, CASE l_orderkey % 13 WHEN 0 THEN 'Instructions (2)' WHEN 1 THEN 'NOTES' WHEN 2 THEN 'Notes to buyer' WHEN 3 THEN 'cover' ELSE 'FMR ' || cast(l_orderkey AS string) END, cast(line_number + 4 AS int), CASE WHEN l_orderkey % 17 = 0 THEN ';;;;;;' ELSE cast(line_number AS string) || ';' || p_brand || ';' || cast(p_size AS string) || ';' || p_name || ';' || cast(cast(l_quantity AS bigint) AS string) || ';EA;' || CASE WHEN line_number = 1 THEN '' ELSE 'D-9-' || cast(l_partkey % 5 AS string) END END
  FROM raw_lines JOIN part ON l_partkey = p_partkey""",
    "iso_pages": """
SELECT 'D-' || cast(l_partkey % 500 AS string) AS drawing_number, CASE WHEN l_partkey % 50 = 0 AND l_suppkey % 3 = 2 THEN 'B' ELSE cast(l_suppkey % 3 AS string) END AS revision,
  cast(l_suppkey % 2 AS string) AS content_hash, 'src' || cast(l_orderkey % 10 AS string) AS source_path, l_orderkey * 1000 + line_number AS page FROM raw_lines""",
}
NEEDS = {"lines": ["raw_lines"], "stored_statuses": ["raw_lines", "lines"], "backorders": ["movements"], "notices": ["movements", "backorders"], "swaps": ["movements"], "bag_items": ["raw_lines", "lines"], "iso_pages": ["raw_lines"], "bag_stock": ["raw_lines", "lines", "requisitions"], "bag_rows": ["raw_lines", "lines", "bag_items"], "search_terms": ["requisitions", "raw_lines", "lines"],
         "decided": ["movements"], "drafts": ["requisitions"], "draft_lines": ["raw_lines", "lines"], "bom_rows": ["raw_lines"],
         "corrections": ["raw_lines", "lines", "requisitions"], "review_items": ["requisitions", "drafts"], "batches": ["requisitions", "drafts"], "draft_issues": ["raw_lines", "lines", "draft_lines"], "incoming": ["requisitions"], "split_requests": ["movements"],
         "line_places": ["raw_lines", "lines"], "legacy_lines": ["raw_lines", "lines"], "legacy_requests": ["raw_lines", "lines"], "grid_rows": ["raw_lines"], "words": ["raw_lines"], "published_numbers": ["requisitions"], "bom_words": ["raw_lines"], "form_rows": ["raw_lines"], "line_totals": ["movements", "backorders"], "counted_lines": ["raw_lines", "lines"], "lenders": ["raw_lines", "lines"], "borrow_requests": ["raw_lines", "lines", "lenders"]}


def _order(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        out += [x for x in [*NEEDS.get(n, []), n] if x not in out]
    return out


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """The SQL with the named views (and those they need) as common table expressions."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in _order(list(names)))
    tail = sql.strip()
    if tail.upper().startswith("WITH "):
        ctes, tail = f"{ctes},\n{tail[5:]}", ""
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{tail}"


def domain(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named views as DataFrames over the Parquet tables of a folder."""
    tables = [t for t in BASE if any(t in VIEWS[n] for n in _order(list(names)))]
    out = []
    for n in names:
        args = {f"t_{t}": spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
        ctes = ", ".join([*[f"{t} AS (SELECT * FROM {{t_{t}}})" for t in tables], *[f"{v} AS ({VIEWS[v]})" for v in _order([n])]])
        out.append(spark.sql(f"WITH {ctes} SELECT * FROM {n}", **args))
    return out
