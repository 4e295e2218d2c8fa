"""Queries of staging, the office, former exports, files and workbook grids, each with its SQL for DuckDB. Lists and codes are written out here, apart from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells
from ..operators import bags, grids, legacy, office, packages, staging, words
from ..sources import sheets
from ..sources.bridge import domain, with_views
from . import desk

COUNTS = """li AS (SELECT draft_id, count(*) AS lines, count(*) FILTER (length(description) > 52) AS overflow FROM draft_lines GROUP BY 1), io AS (SELECT draft_id, count(*) FILTER (severity = 'error' AND NOT resolved) AS eo, count(*) FILTER (severity = 'warning' AND NOT resolved) AS wo,
  count(*) FILTER (severity = 'error') AS ea, count(*) FILTER (severity = 'warning') AS wa FROM draft_issues GROUP BY 1)"""
MOVES = """mv AS (SELECT * FROM (VALUES ('DRAFT', 'SUBMIT', 'owner_edit'), ('PLANNER_RETURNED', 'SUBMIT', 'owner_edit'), ('PENDING_PLANNER_REVIEW', 'PLANNER_APPROVE', 'plan_review'), ('PENDING_PLANNER_REVIEW', 'PLANNER_RETURN', 'plan_review'),
  ('PLANNER_APPROVED', 'SEND_TO_MATERIAL', 'plan_review'), ('PENDING_MATERIAL_MANAGER', 'ASSIGN_NUMBER', 'assign_number'), ('NUMBER_ASSIGNED', 'ASSIGN_NUMBER', 'assign_number'), ('NUMBER_ASSIGNED', 'PUBLISH', 'assign_number')) t(state, action, permission)),
rq AS (SELECT draft_id, project_id, state, permission, string_agg(action, ',' ORDER BY action) AS actions FROM review_items JOIN mv USING (state) WHERE NOT archived AND NOT published GROUP BY ALL)"""
HEADINGS = """al AS (SELECT * FROM (VALUES ('line_number', 'ITEM'), ('line_number', 'ITEMNO'), ('line_number', 'LINE'), ('line_number', 'NO'), ('commodity_code', 'COMMODITYCODE'), ('commodity_code', 'COMMODITY'), ('commodity_code', 'CMDTY'), ('commodity_code', 'MATERIALCODE'), ('commodity_code', 'CODE'), ('commodity_code', 'PARTNO'),
  ('size', 'SIZE'), ('size', 'NPS'), ('size', 'DN'), ('size', 'DIA'), ('size', 'DIAMETER'), ('description', 'DESCRIPTION'), ('description', 'MATERIALDESCRIPTION'), ('description', 'MATERIAL'), ('description', 'DESC'), ('quantity', 'QTY'), ('quantity', 'QUANTITY'), ('quantity', 'QTYREQ'), ('quantity', 'QTYREQUIRED'), ('quantity', 'REQQTY'),
  ('uom', 'UOM'), ('uom', 'UNIT'), ('uom', 'UM'), ('uom', 'UNITS'), ('storage_location', 'LOCATION'), ('storage_location', 'STORAGELOCATION'), ('storage_location', 'BIN'), ('storage_location', 'RACK')) t(field, alias)),
gl AS (SELECT sheet_id, row, string_split(cells_text, ';') AS c FROM grid_rows), gc AS (SELECT sheet_id, row, unnest(c) AS cell, generate_subscripts(c, 1) - 1 AS col FROM gl),
gm AS (SELECT sheet_id, row, col, cell, CASE WHEN trim(cell) = '#' THEN 'line_number' ELSE field END AS field FROM gc LEFT JOIN al ON regexp_replace(upper(cell), '[^A-Z0-9]', '', 'g') = alias),
gs AS (SELECT sheet_id, row, count(DISTINCT field) AS score, count(*) FILTER (trim(cell) <> '') AS filled, count(*) FILTER (field IS NOT NULL) AS named FROM gm WHERE row < 40 GROUP BY 1, 2)"""
HEAD = """hd AS (SELECT sheet_id, row AS header_row, score FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY score DESC, row) AS k FROM gs WHERE score >= 2) WHERE k = 1),
fp AS (SELECT h.sheet_id, h.header_row, h.score, """ + ", ".join(f"min(col) FILTER (field = '{f}') AS {f}" for f in ("line_number", "commodity_code", "size", "description", "quantity", "uom", "storage_location")) + " FROM hd h JOIN gm g ON h.sheet_id = g.sheet_id AND h.header_row = g.row GROUP BY ALL)"
FIT = """fh AS (SELECT sheet_id, row FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY named * 100 + filled DESC, row) AS k FROM gs WHERE filled >= 2) WHERE k = 1), fc AS (SELECT g.* FROM gm g JOIN fh USING (sheet_id, row)),
ff AS (SELECT sheet_id, field, min(col) AS col FROM fc WHERE field IS NOT NULL GROUP BY 1, 2), f1 AS (SELECT sheet_id, string_agg(field || '@' || cast(col AS varchar), ',' ORDER BY field) AS matched, bool_or(field = 'description') AS d, bool_or(field = 'quantity') AS q FROM ff GROUP BY 1),
f2 AS (SELECT sheet_id, string_agg(trim(cell), ',' ORDER BY col) AS unmatched FROM fc WHERE field IS NULL AND trim(cell) <> '' GROUP BY 1)"""
LEGACY = """hk AS (SELECT DISTINCT fmr_id FROM legacy_headers), gk AS (SELECT DISTINCT line_id FROM legacy_lines WHERE fmr_id IN (SELECT fmr_id FROM hk)),
rs AS (SELECT 'headers' AS sheet, fmr_id AS old_id, true AS known FROM legacy_headers UNION ALL SELECT 'lines', line_id, fmr_id IN (SELECT fmr_id FROM hk) FROM legacy_lines UNION ALL SELECT 'requests', request_id, fmr_id IN (SELECT fmr_id FROM hk) AND line_id IN (SELECT line_id FROM gk) FROM legacy_requests)"""
WORD_LINES = """o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY top, x0, word_id) AS rn FROM words),
r AS (SELECT page_id, word_id, rn, top AS began, 1 AS line FROM o WHERE rn = 1 UNION ALL SELECT o.page_id, o.word_id, o.rn, CASE WHEN abs(o.top - r.began) <= 5 THEN r.began ELSE o.top END, CASE WHEN abs(o.top - r.began) <= 5 THEN r.line ELSE r.line + 1 END FROM r JOIN o ON o.page_id = r.page_id AND o.rn = r.rn + 1)"""
NUMBER = "coalesce(try_cast(replace(coalesce({}, ''), ',', '') AS double), 0)"


def read_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of lines written as an export and read back."""
    rows, path = domain(spark, sf_dir, "legacy_lines")[0], sheets.fresh(spark, "export")
    sheets.write_export(rows.union(rows.filter("line_id like '%7'").select(*[F.lit(" ") for _ in rows.columns])), path)
    return sheets.read_export(spark, path, [*rows.columns, "not_there"])


def write_takeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sheets.fresh(spark, "takeoff")
    sheets.write_takeoff(packages.takeoff_rows(domain(spark, sf_dir, "bom_rows")[0]), path, without=("SUPPORTS",))
    return sheets.read_takeoff(spark, path)


def read_takeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the form written to sheets and read back."""
    path = sheets.fresh(spark, "takeoff")
    sheets.write_takeoff(packages.takeoff_rows(domain(spark, sf_dir, "bom_rows")[0]), path)
    return sheets.read_takeoff_rows(spark, path)


def manifest_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = domain(spark, sf_dir, "bom_rows")[0], sheets.fresh(spark, "manifests")
    sheets.write_manifests(rows, packages.material_review(rows), path)
    return sheets.manifest_history(spark, path)


def clean_cells(rows: DataFrame) -> DataFrame:
    c = F.col
    return rows.select(
        "part_id", cells.size_from_date(c("raw_size")).alias("fraction"), cells.iso_date(c("raw_date")).alias("iso_date"), cells.number(c("raw_number")).alias("number"), cells.yes(c("raw_flag")).alias("flag"), cells.uuid(c("raw_key")).alias("key"),
        cells.email(c("raw_email")).alias("email"), cells.file_name(c("area"), c("package")).alias("file_name"), cells.sheet_name(c("area"), c("sheet_index")).alias("sheet_name"), cells.holds(c("package"), "brand#1%WIDGET").alias("found"), cells.starts(c("package"), "brand#2").alias("begins"),
    )


def upserted(headers: DataFrame, requisitions: DataFrame) -> DataFrame:
    """Headers of the former system put over the requisitions of the same number."""
    now = requisitions.select("req_number", "priority", F.lit("stored").alias("origin"))
    then = legacy.typed_headers(headers).select("req_number", F.col("status").alias("priority"), F.lit("loaded").alias("origin"))
    return staging.upsert(now, then, ["req_number"], ["origin"])


def queries(over) -> dict:
    four = ("review_items", "draft_lines", "draft_issues")
    return {
        "project_paused": over(office.field_gate, "movements", "controls"),
        "correction_history": over(office.correction_history, "corrections", "requisitions", "lines"),
        "split_lineage": over(office.split_lineage, "split_requests"),
        "register_search_iso": over(lambda r, x: office.register_search(r, x, "D-44-01", sort="FULFILLMENT", exception="HAS_REMAINING"), "requisitions", "lines"),
        "register_search_number": over(lambda r, x: office.register_search(r, x, "1", kind="NUMBER", status="Open", sort="DATE_REQUIRED", descending=False, page=90, size=10), "requisitions", "lines"),
        "pick_lists": over(office.pick_lists, "requisitions", "pick_values", "line_places"),
        "bag_queue_order": over(lambda s, x, r: office.bag_queue_order(bags.active_queue(s, x, r, desk.AS_OF)), "bag_stock", "lines", "requisitions"),
        "review_queue": over(staging.review_queue, "review_items", "draft_lines"),
        "review_counts": over(lambda i, x, m: staging.review_counts(staging.review_queue(i, x), m), "review_items", "draft_lines", "members"),
        "draft_list": over(staging.draft_list, "batches", *four),
        "batch_review": over(staging.batch_review, *four),
        "batch_recount": over(staging.batch_recount, *four),
        "staging_summary": over(staging.staging_summary, *four),
        "package_summary": over(staging.package_summary, *four),
        "existing_or_staged": over(lambda i, r, w: staging.existing_or_staged(i, r, w), "incoming", "requisitions", "review_items"),
        "renumber_lines": over(lambda x: staging.renumber_lines(x.filter("raw_size <> 'SEE DETAIL'")), "draft_lines"),
        "profile_shadowing": over(staging.profiles, "requisitions", "owned_profiles"),
        "snapshot_upsert": over(upserted, "legacy_headers", "requisitions"),
        "image_runs": over(lambda p: packages.image_runs(p, packages.classify_pages(p)), "package_pages"),
        "row_modes": over(packages.row_modes, "bom_rows"),
        "clean_cells": over(clean_cells, "cell_text"),
        "line_id_resolution": over(legacy.resolve_ids, "legacy_headers", "legacy_lines", "legacy_requests"),
        "migrate_lines": over(legacy.typed_lines, "legacy_headers", "legacy_lines"),
        "migrate_requests": over(lambda h, x, r: legacy.typed_requests(r, legacy.resolve_ids(h, x, r)), "legacy_headers", "legacy_lines", "legacy_requests"),
        "migrate_problems": over(legacy.line_problems, "legacy_lines"),
        "migrate_gate": over(legacy.load_gate, "legacy_lines"),
        "read_export": read_export,
        "write_takeoff": write_takeoff,
        "read_takeoff": read_takeoff,
        "manifest_history": manifest_history,
        "line_grouping": over(words.line_grouping, "words"),
        "bucket_words": over(lambda w, r: words.bucket_words(w, words.line_grouping(w), r), "words", "column_ranges"),
        "drawing_identity": over(words.drawing_identity, "words", "word_pages"),
        "group_drawings": over(lambda m, p: packages.group_drawings(m, packages.material_review(m), p.select(F.col("drawing_number").alias("drawing"))), "bom_rows", "iso_pages"),
        "find_header_row": over(grids.header_rows, "grid_rows"),
        "extract_lines": over(grids.material_lines, "grid_rows"),
        "fit_report": over(grids.fit_report, "grid_rows"),
        "learn_headings": over(grids.learn_headings, "grid_rows"),
    }


def oracle_sql() -> dict[str, str]:
    v, four = with_views, ("review_items", "draft_lines", "draft_issues")
    rem = "greatest(0, qty_requested - qty_issued)"
    reg = f"s AS (SELECT req_id, count(*) AS line_count, sum(qty_requested) AS requested, sum(qty_issued) AS issued, sum({rem}) AS remaining FROM lines WHERE active GROUP BY 1)"
    page = "SELECT project_id, record, records, req_number, priority, line_count, requested, remaining, pct_issued FROM p"
    cols = "project_id, req_number, priority, coalesce(line_count, 0) AS line_count, cast(coalesce(requested, 0) AS double) AS requested, cast(coalesce(remaining, 0) AS double) AS remaining, cast(CASE WHEN requested > 0 THEN floor(cast(issued AS double) * 100 / cast(requested AS double) + 0.5) ELSE 0 END AS bigint) AS pct_issued"
    types = desk.TAKEOFF
    cell = lambda f: f"coalesce(trim(c[cast({f} AS bigint) + 1]), '')"
    sums = lambda e, w: f"SELECT batch_id, count(*) AS sheets, cast(coalesce(sum(lines), 0) AS bigint) AS lines, cast(coalesce(sum({e}), 0) AS bigint) AS errors, cast(coalesce(sum({w}), 0) AS bigint) AS warnings"
    joined = "FROM review_items LEFT JOIN li USING (draft_id) LEFT JOIN io USING (draft_id) GROUP BY batch_id"
    num = NUMBER.format
    return {
        "project_paused": v("SELECT id, m.project_id, CASE WHEN field_locked THEN 'Material movement is paused' || CASE WHEN reason IS NULL THEN ' on this project.' ELSE ': ' || reason END END AS refusal FROM movements m LEFT JOIN controls c ON m.project_id = c.project_id", "movements", "controls"),
        "correction_history": v("SELECT c.project_id, place, id, req_number, line_number, description, types, reason FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY applied_at DESC, id) AS place FROM corrections) c JOIN requisitions r ON c.req_id = r.req_id JOIN lines l ON c.line_id = l.line_id WHERE place <= 100", "corrections", "requisitions", "lines"),
        "split_lineage": v("""WITH c AS (SELECT id, id AS root_id, 0 AS depth, qty_requested FROM split_requests WHERE split_from_id IS NULL OR split_from_id NOT IN (SELECT id FROM split_requests) UNION ALL SELECT s.id, c.root_id, c.depth + 1, s.qty_requested FROM split_requests s JOIN c ON s.split_from_id = c.id)
SELECT id, root_id, cast(depth AS bigint) AS depth, count(*) OVER w AS requests, cast(sum(qty_requested) OVER w AS double) AS quantity, cast(max(depth) OVER w AS bigint) AS chain_depth FROM c WINDOW w AS (PARTITION BY root_id)""", "split_requests", recursive=True),
        "register_search_iso": v(f"""WITH {reg}, m AS (SELECT DISTINCT req_id FROM lines WHERE active AND (upper(iso_number) || '|' || upper(iso_sheet) IN ('D-44-01', 'D-44|01', 'D-44|1') OR iso_number ILIKE 'D-44-01%')),
f AS (SELECT {cols}, CASE WHEN requested > 0 THEN cast(issued AS double) / cast(requested AS double) ELSE 0 END AS k FROM requisitions r LEFT JOIN s USING (req_id) WHERE active AND (req_number ILIKE 'D-44-01%' OR iwp_number ILIKE '%D-44-01%' OR requested_by ILIKE '%D-44-01%' OR req_id IN (SELECT req_id FROM m)) AND remaining > 0),
p AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY k DESC, req_number) AS record, count(*) OVER (PARTITION BY project_id) AS records FROM f) {page} WHERE record <= 25""", "requisitions", "lines"),
        "register_search_number": v(f"""WITH {reg}, o AS (SELECT req_id FROM lines WHERE active GROUP BY 1 HAVING NOT (sum({rem}) <= 0 AND sum(qty_requested) > 0) AND sum(qty_issued) <= 0 AND sum(qty_pending_backorder) + sum(qty_confirmed_backorder) <= 0 AND sum(qty_confirmed_located) <= 0),
f AS (SELECT {cols}, date_required FROM requisitions r LEFT JOIN s USING (req_id) WHERE active AND req_number LIKE '1%' AND req_id IN (SELECT req_id FROM o)), p AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY date_required, req_number) AS record, count(*) OVER (PARTITION BY project_id) AS records FROM f),
q AS (SELECT *, least(90, cast(ceil(records / 10) AS bigint)) AS turned FROM p) {page.replace('FROM p', 'FROM q')} WHERE record BETWEEN (turned - 1) * 10 + 1 AND turned * 10""", "requisitions", "lines"),
        "pick_lists": v("""WITH pr AS (SELECT DISTINCT project_id FROM requisitions), u AS (SELECT project_id, storage_location, row_number() OVER (PARTITION BY project_id ORDER BY storage_location) AS k FROM (SELECT DISTINCT project_id, storage_location FROM line_places WHERE storage_location <> ''))
SELECT project_id, list_name, value FROM pick_values WHERE active AND project_id IS NOT NULL UNION SELECT pr.project_id, list_name, value FROM pick_values v, pr WHERE active AND v.project_id IS NULL UNION SELECT project_id, 'STORAGE_LOCATION', storage_location FROM u WHERE k <= 100""", "requisitions", "pick_values", "line_places"),
        "bag_queue_order": v("SELECT project_id, tag_number, line_id, row_number() OVER (PARTITION BY project_id ORDER BY bagged_at, tag_number, line_id) AS oldest_first, row_number() OVER (PARTITION BY project_id ORDER BY bagged_at DESC, tag_number, line_id) AS newest_first FROM bag_stock WHERE active AND qty_remaining > 0", "bag_stock"),
        "review_queue": v(f"WITH {MOVES}, l AS (SELECT draft_id, count(*) AS n, string_agg(cast(line_number AS varchar) || 'x' || raw_quantity, ',' ORDER BY line_number) AS t FROM draft_lines GROUP BY 1) SELECT rq.*, coalesce(n, 0) AS line_count, coalesce(t, '') AS listed FROM rq LEFT JOIN l USING (draft_id)", "review_items", "draft_lines"),
        "review_counts": v(f"""WITH {MOVES}, w AS (SELECT project_id, permission, count(*) AS n FROM rq GROUP BY 1, 2) SELECT user_id, m.project_id, cast(coalesce(sum(n), 0) AS bigint) AS waiting FROM members m LEFT JOIN w ON m.project_id = w.project_id
  AND ((permission = 'owner_edit' AND owner_edit) OR (permission = 'plan_review' AND plan_review) OR (permission = 'assign_number' AND assign_number)) WHERE active GROUP BY 1, 2""", "review_items", "members"),
        "draft_list": v(f"WITH {COUNTS} SELECT b.batch_id, r.draft_id, source, b.archived, coalesce(lines, line_count) AS line_count, coalesce(eo, error_count) AS error_count, coalesce(wo, warning_count) AS warning_count FROM batches b LEFT JOIN review_items r ON b.batch_id = r.batch_id LEFT JOIN li ON r.draft_id = li.draft_id LEFT JOIN io ON r.draft_id = io.draft_id WHERE NOT b.published", "batches", *four),
        "batch_review": v("""WITH l AS (SELECT draft_id, string_agg(cast(line_number AS varchar) || ':' || description, ',' ORDER BY line_number, description) AS t FROM draft_lines GROUP BY 1), i AS (SELECT draft_id, string_agg(coalesce(cast(line_number AS varchar) || ':', '') || code, ',' ORDER BY line_number NULLS FIRST, code) AS t FROM draft_issues GROUP BY 1)
SELECT batch_id, r.draft_id, coalesce(l.t, '') AS lines, coalesce(i.t, '') AS issues FROM review_items r LEFT JOIN l ON r.draft_id = l.draft_id LEFT JOIN i ON r.draft_id = i.draft_id""", *four),
        "batch_recount": v(f"WITH {COUNTS} {sums('eo', 'wo')} {joined}", *four),
        "staging_summary": v(f"WITH {COUNTS} {sums('ea', 'wa')} {joined}", *four),
        "package_summary": v(f"WITH {COUNTS}, k AS (SELECT batch_id, count(DISTINCT (draft_id, line_number)) AS n FROM review_items JOIN draft_issues USING (draft_id) WHERE line_number IS NOT NULL GROUP BY 1), t AS ({sums('ea', 'wa')}, cast(coalesce(sum(overflow), 0) AS bigint) AS overflow {joined}) SELECT t.*, coalesce(n, 0) AS lines_to_check FROM t LEFT JOIN k USING (batch_id)", *four),
        "existing_or_staged": v("""WITH w AS (SELECT DISTINCT project_id, upper(number) AS u FROM review_items WHERE number IS NOT NULL AND NOT published AND NOT archived), i AS (SELECT *, number IS NOT NULL AND row_number() OVER (PARTITION BY project_id, upper(number) ORDER BY draft_id) > 1 AS again FROM incoming),
j AS (SELECT i.draft_id, i.project_id, i.number, req_id AS existing_req_id, again OR w.u IS NOT NULL AS waiting_already FROM i LEFT JOIN requisitions r ON i.project_id = r.project_id AND i.number = r.req_number LEFT JOIN w ON i.project_id = w.project_id AND upper(i.number) = w.u)
SELECT draft_id, project_id, existing_req_id, waiting_already, CASE WHEN NOT waiting_already THEN number END AS number FROM j""", "incoming", "requisitions", "review_items"),
        "renumber_lines": v("SELECT draft_id, line_number AS old_number, row_number() OVER (PARTITION BY draft_id ORDER BY line_number) AS new_number FROM draft_lines WHERE raw_size <> 'SEE DETAIL'", "draft_lines"),
        "profile_shadowing": v("SELECT project_id, name, false AS built_in FROM owned_profiles UNION ALL SELECT project_id, name, true FROM (SELECT DISTINCT project_id FROM requisitions) p, (VALUES ('default'), ('extracted'), ('takeoff')) b(name) WHERE NOT EXISTS (SELECT 1 FROM owned_profiles o WHERE o.project_id = p.project_id AND lower(o.name) = b.name)", "requisitions", "owned_profiles"),
        "snapshot_upsert": v("SELECT r.req_number, CASE WHEN h.fmr_id IS NULL THEN priority ELSE coalesce(nullif(trim(current_status), ''), 'Open') END AS priority, CASE WHEN h.fmr_id IS NULL THEN 'stored' ELSE 'loaded' END AS origin FROM requisitions r LEFT JOIN legacy_headers h ON trim(fmr_number) = r.req_number", "legacy_headers", "requisitions"),
        "image_runs": v("""WITH k AS (SELECT *, CASE WHEN length(trim(text)) < 40 THEN 'ocr_required' WHEN text LIKE 'Isometric%' THEN 'iso' WHEN text LIKE 'Pipe hangers%' THEN 'pipe_support' WHEN text LIKE 'a Field%' THEN 'attachment' ELSE 'unrecognized_page' END AS kind FROM package_pages),
r AS (SELECT package_id, min(page) AS first_page, max(page) AS last_page, count(*) AS n, upper(regexp_replace(string_agg(text, ' ' ORDER BY page), '\\s+', ' ', 'g')) AS t FROM (SELECT *, page - row_number() OVER (PARTITION BY package_id ORDER BY page) AS g FROM k WHERE images = 1 AND length(trim(text)) <= 80) GROUP BY package_id, g)
SELECT r.package_id, first_page, last_page, b.kind AS before, a.kind AS after, coalesce(b.kind IN ('iso', 'pipe_support', 'attachment') AND a.kind IN ('iso', 'pipe_support', 'attachment') AND (contains(t, 'LOOKING NORTH') OR b.kind = 'pipe_support' OR a.kind = 'pipe_support'), false) AS approved
FROM r LEFT JOIN k b ON r.package_id = b.package_id AND b.page = first_page - 1 LEFT JOIN k a ON r.package_id = a.package_id AND a.page = last_page + 1 WHERE n <= 6""", "package_pages"),
        "row_modes": v("SELECT row_id, NOT starts_with(description, 'PIPE ') AS by_default, true AS include_pipe, starts_with(description, 'PIPE ') AS pipe_only, false AS spools_only FROM bom_rows", "bom_rows"),
        "clean_cells": v(f"""SELECT part_id, CASE raw_size WHEN '2-Jan' THEN '1/2' WHEN 'Mar 4' THEN '3/4' WHEN '8-Maybe' THEN '5/8' END AS fraction, CASE WHEN trim(raw_date) IN ('2024-03-09', '3/9/2024', 'Mar 9, 2024') THEN '2024-03-09' END AS iso_date, {num('raw_number')} AS number, coalesce(trim(raw_flag) = 'yes', false) AS flag,
  CASE WHEN raw_key = 'odd-key' THEN raw_key ELSE '1a1855a9-0000-4000-8000-0000000000ff' END AS key, 'user' || cast(part_id AS varchar) || '@example.com' AS email, 'MTO ' || regexp_replace(area || '-' || package, '[^A-Za-z0-9._-]+', '_', 'g') || '.csv' AS file_name,
  area || '(' || CASE WHEN sheet_index < 10 THEN '0' ELSE '' END || cast(sheet_index AS varchar) || ')' AS sheet_name, lower(package) LIKE '%brand#1%widget%' AS found, starts_with(lower(package), 'brand#2') AS begins FROM cell_text""", "cell_text"),
        "line_id_resolution": v(f"WITH {LEGACY} SELECT sheet, old_id, CASE WHEN known THEN sha256(sheet || '|' || old_id) END AS new_id, NOT known AS orphan FROM rs", "legacy_headers", "legacy_lines", "legacy_requests"),
        "migrate_lines": v(f"""WITH q AS (SELECT *, {num('qty_requested')} AS r, {num('qty_confirmed_located')} AS l, {num('qty_issued')} AS i FROM legacy_lines) SELECT sha256('lines|' || line_id) AS line_key, sha256('headers|' || h.fmr_id) AS req_key, trim(fmr_number) AS req_number, CASE WHEN h.date_required NOT IN ('', 'soon') THEN h.date_required END AS date_required,
  coalesce(nullif(trim(current_status), ''), 'Open') AS status, upper(trim(active)) = 'YES' AS active, r AS qty_requested, greatest(0, r - l) AS not_yet_located, greatest(0, r - i) AS remaining FROM q JOIN legacy_headers h ON q.fmr_id = h.fmr_id""", "legacy_headers", "legacy_lines"),
        "migrate_requests": v(f"""WITH {LEGACY} SELECT sha256('requests|' || request_id) AS request_key, CASE WHEN coalesce(trim(status), '') = '' OR status = 'Pending Admin Review' THEN 'Pending' WHEN lower(trim(status)) = 'returned to field' THEN 'Returned for Review' ELSE trim(status) END AS status, {num('qty_pending')} AS qty_pending,
  CASE WHEN correlation_id LIKE 'CORR-%' THEN lower(substr(correlation_id, 6)) ELSE nullif(correlation_id, '') END AS correlation_id FROM legacy_requests JOIN rs ON sheet = 'requests' AND known AND old_id = request_id""", "legacy_headers", "legacy_lines", "legacy_requests"),
        "migrate_problems": v(f"WITH {_problems()} SELECT line_id, problems FROM b WHERE problems <> ''", "legacy_lines"),
        "migrate_gate": v(f"WITH {_problems()} SELECT count(*) FILTER (problems = '') AS sound, count(*) FILTER (problems <> '') AS bad, count(*) FILTER (problems <> '') > 0 AS refused FROM b", "legacy_lines"),
        "read_export": v("SELECT *, cast(NULL AS varchar) AS not_there FROM legacy_lines", "legacy_lines"),
        "write_takeoff": v(f"""WITH {types}, r AS (SELECT * FROM k WHERE takeoff_sheet <> 'SUPPORTS'), w AS (SELECT 'COMBINED' AS on_sheet, line_number FROM r UNION ALL SELECT takeoff_sheet, line_number FROM r)
SELECT f.on_sheet, count(line_number) AS rows, count(DISTINCT line_number) AS drawings FROM (VALUES ('COMBINED'), ('BLINDS'), ('PIPE & FITTINGS'), ('BOLTS & GASKETS'), ('SUPPORTS'), ('VALVES'), ('BIRDSCREENS'), ('OTHER MATERIALS')) f(on_sheet) LEFT JOIN w ON f.on_sheet = w.on_sheet GROUP BY 1""", "bom_rows"),
        "read_takeoff": v(f"WITH {types} SELECT unnest(['COMBINED', takeoff_sheet]) AS on_sheet, cwa, iwp, line_number, sheet, pipe_spec, trim(description) AS description, size, trim(commodity_code) AS commodity_code, quantity, uom, '' AS epic_paint_code, '' AS cust_paint_code, '' AS color FROM k", "bom_rows"),
        "manifest_history": v("""WITH d AS (SELECT *, coalesce(trim(commodity_code), '') = '' OR coalesce(trim(description), '') = '' OR coalesce(trim(nominal_size), '') = '' OR coalesce(trim(quantity), '') = '' OR row_id <> min(row_id) OVER (PARTITION BY page, point) AS doubt FROM bom_rows)
SELECT 'PK-' || cast(page % 20 AS varchar) AS package_number, count(DISTINCT page) AS runs, count(DISTINCT drawing) AS drawings, count(*) AS rows, count(*) FILTER (doubt) AS review_rows, round(count(*) FILTER (doubt) / count(*), 4) AS review_rate FROM d GROUP BY 1""", "bom_rows"),
        "line_grouping": v(f"WITH {WORD_LINES} SELECT page_id, word_id, cast(line AS bigint) AS line FROM r", "words", recursive=True),
        "bucket_words": v(f"WITH {WORD_LINES} SELECT r.page_id, cast(line AS bigint) AS line, name AS column_name, string_agg(text, ' ' ORDER BY x0, r.word_id) AS text FROM r JOIN words w ON r.word_id = w.word_id JOIN column_ranges c ON c.page_id = r.page_id AND x0 >= x_from AND x0 < x_to GROUP BY 1, 2, 3", "words", "column_ranges", recursive=True),
        "drawing_identity": v("""WITH f AS (SELECT *, upper(text) AS number FROM words WHERE starts_with(text, 'd-')), t AS (SELECT page_id, number FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY x0 + top DESC, word_id) AS k FROM f WHERE x0 >= 330 AND top >= 400) WHERE k = 1),
n AS (SELECT page_id, number, count(*) AS c, min((top, x0, word_id)) AS first FROM f GROUP BY 1, 2), m AS (SELECT page_id, number FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY c DESC, first) AS k FROM n) WHERE k = 1)
SELECT p.page_id, coalesce(t.number, m.number, upper(source_name)) AS drawing, CASE WHEN t.number IS NOT NULL THEN 'title_block' WHEN m.number IS NOT NULL THEN 'repeated' ELSE 'file_name' END AS rule FROM word_pages p LEFT JOIN t ON p.page_id = t.page_id LEFT JOIN m ON p.page_id = m.page_id""", "words", "word_pages"),
        "group_drawings": v("""WITH b AS (SELECT *, row_number() OVER (PARTITION BY drawing ORDER BY row_id) AS line_number, row_id <> min(row_id) OVER (PARTITION BY page, point) AS again FROM bom_rows), d AS (SELECT drawing_number AS drawing FROM iso_pages UNION SELECT drawing FROM bom_rows)
SELECT drawing, line_number, cast(point AS varchar) AS source_row, code, severity FROM (SELECT *, 'MISSING_QUANTITY' AS code, 'error' AS severity FROM b WHERE coalesce(trim(quantity), '') = '' UNION ALL SELECT *, 'MISSING_DESCRIPTION', 'error' FROM b WHERE coalesce(trim(description), '') = ''
  UNION ALL SELECT *, 'MISSING_COMMODITY_CODE', 'warning' FROM b WHERE coalesce(trim(commodity_code), '') = '' UNION ALL SELECT *, 'MISSING_NOMINAL_SIZE', 'warning' FROM b WHERE coalesce(trim(nominal_size), '') = '' UNION ALL SELECT *, 'DUPLICATE_BOM_POINT_NUMBER', 'warning' FROM b WHERE again)
UNION ALL SELECT drawing, NULL, NULL, 'NO_MATERIAL', 'error' FROM d WHERE drawing NOT IN (SELECT drawing FROM bom_rows) UNION ALL SELECT drawing, NULL, NULL, 'NEEDS_FMR_NUMBER', 'warning' FROM d""", "bom_rows", "iso_pages"),
        "find_header_row": v(f"WITH {HEADINGS}, {HEAD} SELECT * FROM fp", "grid_rows"),
        "extract_lines": v(f"""WITH {HEADINGS}, {HEAD}, x AS (SELECT g.sheet_id, row, {cell('description')} AS description, {cell('quantity')} AS q, {cell('size')} AS z, {cell('uom')} AS u, {cell('commodity_code')} AS commodity_code FROM gl g JOIN fp ON g.sheet_id = fp.sheet_id AND row > header_row),
b AS (SELECT *, description = '' AND q = '' AS blank FROM x), e AS (SELECT sheet_id, min(row) AS stop FROM (SELECT *, lag(blank, 1, false) OVER w AND lag(blank, 2, false) OVER w AND blank AS third FROM b WINDOW w AS (PARTITION BY sheet_id ORDER BY row)) WHERE third OR (NOT blank AND lower(description) LIKE 'total%') GROUP BY 1)
SELECT b.sheet_id, row + 1 AS source_row, row_number() OVER (PARTITION BY b.sheet_id ORDER BY row) AS line_number, commodity_code, CASE WHEN regexp_full_match(z, '[0-9]+') THEN z || '"' ELSE nullif(z, '') END AS size, description, try_cast(q AS double) AS quantity, upper(u) AS uom,
  concat_ws(',', CASE WHEN try_cast(q AS double) IS NULL THEN 'BAD_QUANTITY' END, CASE WHEN try_cast(q AS double) = 0 THEN 'ZERO_QUANTITY' END, CASE WHEN description = '' THEN 'NO_DESCRIPTION' END, CASE WHEN z = 'SEE DETAIL' THEN 'ODD_SIZE' END) AS issues
FROM b LEFT JOIN e ON b.sheet_id = e.sheet_id WHERE NOT blank AND row < coalesce(stop, 1000000)""", "grid_rows"),
        "fit_report": v(f"""WITH {HEADINGS}, {FIT} SELECT h.sheet_id, h.row AS header_row, coalesce(matched, '') AS matched, coalesce(unmatched, '') AS unmatched, concat_ws(',', CASE WHEN NOT coalesce(d, false) THEN 'description' END, CASE WHEN NOT coalesce(q, false) THEN 'quantity' END) AS missing, coalesce(d AND q, false) AS usable
FROM fh h LEFT JOIN f1 ON h.sheet_id = f1.sheet_id LEFT JOIN f2 ON h.sheet_id = f2.sheet_id""", "grid_rows"),
        "learn_headings": v(f"""WITH {HEADINGS}, {FIT} SELECT min(trim(cell)) AS heading, CASE min(upper(cell)) WHEN 'REQUIRED AMOUNT' THEN 'quantity' WHEN 'IWP NO:' THEN 'line_number' END AS field, count(DISTINCT sheet_id) AS sheets FROM fc WHERE field IS NULL AND trim(cell) <> '' GROUP BY coalesce(nullif(regexp_replace(upper(cell), '[^A-Z0-9]', '', 'g'), ''), upper(trim(cell)))""", "grid_rows"),
    }


def _problems() -> str:
    n = NUMBER.format
    r, x, i, a, g = (n(c) for c in ("qty_requested", "qty_confirmed_located", "qty_issued", "qty_available", "qty_active_bagged"))
    rules = {"NOTHING_REQUESTED": f"{r} <= 0", "LOCATED_SPLIT": f"abs({x} - ({a} + {g} + {i})) > 1e-4", "ISSUED_OVER_REQUESTED": f"{i} > {r}", "LOCATED_OVER_REQUESTED": f"{x} > {r}", "NEGATIVE": f"least({r}, {x}, {i}, {a}, {g}) < 0", "NO_ISO": "coalesce(trim(iso_number), '') = ''", "NO_SHEET": "coalesce(trim(iso_sheet), '') = ''"}
    return "b AS (SELECT line_id, concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in rules.items()) + ") AS problems FROM legacy_lines)"
