"""Queries of the field log, borrowing and ageing, with their SQL for DuckDB. Nested state is lists of structs there, folded by recursion, and rules are written out once more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bom, borrow, fieldlog, grids
from ..sources.bridge import domain, with_views
from ..streaming import alerts
from ..streaming.streams import movements
from . import office

Query = Callable[[SparkSession, str], DataFrame]

_REQ = "struct(rep bigint, id bigint, status varchar, conf double, pend double, act boolean, src bigint)[]"
_NOTE = "struct(raised bigint, id bigint, src bigint, kind varchar, qty double, done double, status varchar)[]"
_BAG = "struct(tag varchar, put double, taken double, status varchar)[]"
BUCKETS = ("located", "available", "bagged", "issued", "pending", "confirmed")


def _req(rep: str = "r.rep", status: str = "r.status", conf: str = "r.conf", pend: str = "r.pend", act: str = "r.act") -> str:
    return f"struct_pack(rep := {rep}, id := r.id, status := {status}, conf := {conf}, pend := {pend}, act := {act}, src := r.src)"


def _before(rows: str, holds: str, value: str) -> str:
    """The sum of a value over the rows before the i-th that hold."""
    return f"coalesce(list_sum(list_transform(list_filter({rows}[1:i - 1], lambda x: {holds}), lambda x: {value})), 0)"


_FRESH_REQ = "[struct_pack(rep := {rep}, id := cid, status := '{status}', conf := 0::double, pend := {pend}::double, act := true, src := {src})]"
REPLAY = f"""WITH c AS (SELECT id AS cid, line_id, row_number() OVER (PARTITION BY line_id ORDER BY ts, id) AS cn, action, cast(quantity AS double) AS qn, cast(coalesce(quantity, 0) AS double) AS q, trim(coalesce(tag, '')) AS tag, place, issued_to, notes, cast(requested AS double) AS asked FROM field_log),
st AS (SELECT DISTINCT line_id, cast(0 AS bigint) AS n, asked AS requested, {", ".join(f"0::double AS {b}" for b in BUCKETS)}, cast(0 AS bigint) AS accepted, cast(0 AS bigint) AS refused, []::{_REQ} AS reqs, []::{_REQ} AS gone, []::{_NOTE} AS live, []::{_NOTE} AS past, []::{_BAG} AS bags,
  cast(NULL AS bigint) AS last_id, cast(NULL AS varchar) AS last_action, cast(NULL AS varchar) AS code FROM c
UNION ALL SELECT line_id, cn, requested, {", ".join(BUCKETS)}, accepted + ok::bigint, refused + (NOT ok)::bigint,
  list_sort(list_filter(reqs, lambda r: r.act)), list_concat(gone, list_filter(reqs, lambda r: NOT r.act)), list_filter(notes2, lambda x: x.status = 'Active'), list_concat(past, list_filter(notes2, lambda x: x.status <> 'Active')), bags, cid, action, code FROM (
 SELECT * REPLACE (list_transform(reqs, lambda r: {_req(status="CASE WHEN r.act AND r.conf = 0 AND r.pend = 0 THEN 'Fulfilled' ELSE r.status END", act="r.act AND (r.conf > 0 OR r.pend > 0)")}) AS reqs),
  list_transform(notes1, lambda x: CASE WHEN NOT ok THEN x ELSE struct_pack(raised := x.raised, id := x.id, src := x.src, kind := x.kind, qty := x.qty, done := x.done, status := CASE WHEN x.done >= x.qty THEN 'Resolved'
   WHEN issued >= requested OR (x.kind <> 'REJECTED' AND len(list_filter(reqs, lambda r: r.id = x.src AND r.act AND (r.conf > 0 OR r.pend > 0))) = 0) THEN 'Superseded' ELSE 'Active' END) END) AS notes2 FROM (
  SELECT * REPLACE (list_transform(reqs, lambda r, i: {_req(pend="r.pend - CASE WHEN r.status = 'Pending' THEN greatest(0, least(r.pend, pbud - " + _before("reqs", "x.status = ''Pending''".replace("''", "'"), "x.pend") + ")) ELSE 0 END")}) AS reqs, pending - least(pbud, ppool) AS pending),
   CASE WHEN NOT ok THEN live WHEN kind IS NOT NULL THEN CASE WHEN len(list_filter(live, lambda x: x.src = nsrc AND x.kind = kind)) > 0
     THEN list_transform(live, lambda x: struct_pack(raised := x.raised, id := x.id, src := x.src, kind := x.kind, qty := x.qty + CASE WHEN x.src = nsrc AND x.kind = kind THEN dq ELSE 0 END, done := x.done, status := x.status))
     ELSE list_append(live, struct_pack(raised := cn, id := cid, src := nsrc, kind := kind, qty := dq, done := 0::double, status := 'Active')) END
    ELSE list_transform(live, lambda x, i: struct_pack(raised := x.raised, id := x.id, src := x.src, kind := x.kind, qty := x.qty, done := x.done + CASE WHEN x.kind = answers THEN greatest(0, least(x.qty - x.done, answer - {_before("live", "x.kind = answers", "x.qty - x.done")})) ELSE 0 END, status := x.status)) END AS notes1 FROM (
   SELECT *, least(fresh - least(cbud, cpool), pending) AS pbud, coalesce(list_sum(list_transform(list_filter(reqs, lambda r: r.status = 'Pending'), lambda r: r.pend)), 0) AS ppool FROM (
    SELECT * REPLACE (list_transform(reqs, lambda r, i: {_req(conf="r.conf - CASE WHEN r.status IN ('Confirmed', 'Partially Confirmed') THEN greatest(0, least(r.conf, cbud - " + _before("reqs", "x.status IN ('Confirmed', 'Partially Confirmed')", "x.conf") + ")) ELSE 0 END")}) AS reqs, confirmed - least(cbud, cpool) AS confirmed) FROM (
     SELECT *, least(fresh, confirmed) AS cbud, coalesce(list_sum(list_transform(list_filter(reqs, lambda r: r.status IN ('Confirmed', 'Partially Confirmed')), lambda r: r.conf)), 0) AS cpool FROM (
      SELECT * REPLACE (
        CASE WHEN ok THEN CASE action WHEN 'CONFIRM_AVAILABLE' THEN located + q WHEN 'DIRECT_ISSUE' THEN located + q WHEN 'BAG' THEN located + fresh ELSE located END ELSE located END AS located,
        CASE WHEN ok THEN CASE action WHEN 'CONFIRM_AVAILABLE' THEN available + q WHEN 'BAG' THEN available + fresh - q WHEN 'ISSUE_FROM_AVAILABLE' THEN available - q ELSE available END ELSE available END AS available,
        CASE WHEN ok THEN CASE action WHEN 'BAG' THEN bagged + q WHEN 'ISSUE_FROM_BAG' THEN bagged - q ELSE bagged END ELSE bagged END AS bagged,
        CASE WHEN ok AND action IN ('DIRECT_ISSUE', 'ISSUE_FROM_AVAILABLE', 'ISSUE_FROM_BAG') THEN issued + q ELSE issued END AS issued,
        CASE WHEN ok THEN CASE action WHEN 'BACKORDER_REQUESTED' THEN pending + greatest(0, q - ret) WHEN 'OFFICE_CONFIRM' THEN pending - dq WHEN 'OFFICE_REJECT' THEN pending - dq ELSE pending END ELSE pending END AS pending,
        CASE WHEN ok AND action = 'OFFICE_CONFIRM' THEN confirmed + dq ELSE confirmed END AS confirmed,
        CASE WHEN NOT ok THEN bags WHEN action = 'BAG' AND item IS NULL THEN list_append(bags, struct_pack(tag := btag, put := q, taken := 0::double, status := 'Active'))
          WHEN action IN ('BAG', 'ISSUE_FROM_BAG') THEN list_transform(bags, lambda b: CASE WHEN b.tag <> btag THEN b WHEN action = 'BAG' THEN struct_pack(tag := b.tag, put := b.put + q, taken := b.taken, status := b.status)
            ELSE struct_pack(tag := b.tag, put := b.put, taken := b.taken + q, status := CASE WHEN b.taken + q >= b.put THEN 'Closed' ELSE 'Active' END) END) ELSE bags END AS bags,
        list_sort(CASE WHEN NOT ok THEN reqs WHEN action = 'BACKORDER_REQUESTED' THEN list_concat(list_transform(reqs, lambda r, i: CASE WHEN r.status = 'Returned for Review' AND r.pend > 0 AND {_before("reqs", "x.status = 'Returned for Review'", "x.pend")} < q
            THEN {_req(rep="cn", status="CASE WHEN " + _before("reqs", "x.status = 'Returned for Review'", "x.pend") + " + r.pend <= q THEN 'Pending' ELSE r.status END")} ELSE r END), CASE WHEN q > ret THEN {_FRESH_REQ.format(rep="cn", status="Pending", pend="(q - ret)", src="NULL::bigint")} ELSE [] END)
          WHEN action = 'OFFICE_CONFIRM' THEN list_transform(reqs, lambda r: CASE WHEN r.id <> t.id THEN r ELSE {_req(conf="r.conf + dq", pend="r.pend - dq", status="CASE WHEN r.pend > dq THEN 'Partially Confirmed' ELSE 'Confirmed' END")} END)
          WHEN action = 'OFFICE_REJECT' THEN list_transform(reqs, lambda r: CASE WHEN r.id <> t.id THEN r ELSE {_req(pend="r.pend - dq", status="CASE WHEN r.pend > dq OR r.conf > 0 THEN r.status ELSE 'Rejected' END", act="r.pend > dq OR r.conf > 0")} END)
          WHEN action = 'OFFICE_RETURN' AND (t.conf > 0 OR t.pend > dq) THEN list_concat(list_transform(reqs, lambda r: CASE WHEN r.id <> t.id THEN r ELSE {_req(pend="r.pend - dq")} END), {_FRESH_REQ.format(rep="t.rep", status="Returned for Review", pend="dq", src="t.id")})
          WHEN action = 'OFFICE_RETURN' THEN list_transform(reqs, lambda r: CASE WHEN r.id <> t.id THEN r ELSE {_req(status="'Returned for Review'")} END) ELSE reqs END) AS reqs),
       CASE WHEN NOT ok THEN NULL WHEN action = 'OFFICE_REJECT' THEN 'REJECTED' WHEN action = 'OFFICE_RETURN' THEN 'RETURNED' WHEN action = 'OFFICE_CONFIRM' AND t.pend > dq THEN 'CONFIRMED' END AS kind,
       CASE WHEN action = 'OFFICE_RETURN' AND (t.conf > 0 OR t.pend > dq) THEN cid ELSE t.id END AS nsrc,
       CASE WHEN action = 'BACKORDER_REQUESTED' THEN 'RETURNED' WHEN action IN ('CONFIRM_AVAILABLE', 'BAG', 'DIRECT_ISSUE') THEN 'REJECTED' ELSE '-' END AS answers, CASE WHEN action = 'BACKORDER_REQUESTED' THEN q ELSE fresh END AS answer FROM (
       SELECT *, code = 'OK' AS ok, CASE WHEN code <> 'OK' THEN 0 WHEN action IN ('CONFIRM_AVAILABLE', 'DIRECT_ISSUE') THEN q WHEN action = 'BAG' THEN greatest(0, q - available) ELSE 0 END AS fresh FROM (
        SELECT * REPLACE (CASE WHEN action IN ('CONFIRM_AVAILABLE', 'BAG') AND coalesce(place, '') = '' OR action IN ('DIRECT_ISSUE', 'ISSUE_FROM_AVAILABLE', 'ISSUE_FROM_BAG') AND coalesce(issued_to, '') = '' OR action = 'BACKORDER_REQUESTED' AND coalesce(notes, '') = '' OR action = 'ISSUE_FROM_BAG' AND tag = '' THEN 'MISSING_FIELD'
          WHEN action = 'ISSUE_FROM_BAG' AND (item IS NULL OR item.status <> 'Active') THEN 'NOT_FOUND' WHEN starts_with(action, 'OFFICE_') AND t IS NULL THEN 'NOT_PENDING' WHEN action = 'UNDO' THEN 'BAD_ACTION' WHEN dq <= 0 THEN 'LEDGER_RULE'
          WHEN dq > CASE action WHEN 'CONFIRM_AVAILABLE' THEN free WHEN 'BAG' THEN greatest(0, available + free) WHEN 'DIRECT_ISSUE' THEN least(free, left_) WHEN 'ISSUE_FROM_AVAILABLE' THEN least(available, left_) WHEN 'ISSUE_FROM_BAG' THEN least(bagged, left_, item.put - item.taken)
            WHEN 'BACKORDER_REQUESTED' THEN CASE WHEN q <= ret THEN q ELSE ret + greatest(0, left_ - available - bagged - pending - confirmed) END ELSE t.pend END THEN 'LIMIT_EXCEEDED'
          WHEN action = 'BAG' AND item.status = 'Closed' THEN 'BAG_CLOSED' WHEN action = 'OFFICE_RETURN' AND coalesce(notes, '') = '' THEN 'MISSING_FIELD' ELSE 'OK' END AS code) FROM (
         SELECT *, greatest(0, least(greatest(0, requested - located), left_) - pending) AS free, CASE WHEN starts_with(action, 'OFFICE_') THEN coalesce(qn, t.pend) ELSE q END AS dq, list_filter(bags, lambda b: b.tag = btag)[1] AS item FROM (
          SELECT st.*, c.* EXCLUDE (line_id, asked), greatest(0, requested - issued) AS left_, list_filter(reqs, lambda r: r.pend > 0)[1] AS t, coalesce(list_sum(list_transform(list_filter(reqs, lambda r: r.status = 'Returned for Review'), lambda r: r.pend)), 0) AS ret,
           CASE WHEN tag = '' THEN 'auto-' || cast(cid AS varchar) ELSE tag END AS btag FROM st JOIN c ON st.line_id = c.line_id AND c.cn = st.n + 1))))))))))),
fin AS (SELECT * FROM st WHERE n = (SELECT count(*) FROM c WHERE c.line_id = st.line_id))"""
STATUS = """CASE WHEN issued >= requested AND requested > 0 THEN 'Issued' WHEN issued > 0 THEN 'Partially Issued' WHEN confirmed > 0 THEN 'Backordered' WHEN pending > 0 THEN 'Pending Backorder' WHEN bagged >= requested AND requested > 0 THEN 'Bagged'
 WHEN bagged > 0 THEN 'Partially Bagged' WHEN located >= requested AND requested > 0 THEN 'Located' WHEN located > 0 THEN 'Partially Located' ELSE 'Open' END"""
PARTS = {
    "replay_full": ("line", f"SELECT line_id, {STATUS} AS status, {', '.join(BUCKETS)}, accepted, refused FROM fin"),
    "replay_requests": ("request", "SELECT line_id, r.id AS id, r.src AS split_from, r.status AS status, r.conf AS confirmed, r.pend AS pending, r.act AS active FROM (SELECT line_id, unnest(list_concat(gone, reqs)) AS r FROM fin)"),
    "replay_bags": ("bag", "SELECT line_id, b.tag AS tag, b.put AS bagged, b.taken AS issued, b.status AS status FROM (SELECT line_id, unnest(bags) AS b FROM fin)"),
    "replay_notices": ("notice", "SELECT line_id, x.id AS id, x.src AS source_id, x.kind AS kind, x.qty AS notified, x.done AS resolved, x.status AS status FROM (SELECT line_id, unnest(list_concat(past, live)) AS x FROM fin)"),
    "replay_refusals": ("refusal", "SELECT line_id, last_id AS id, last_action AS action, code FROM st WHERE code <> 'OK'"),
}

#: Requests that pass the standing checks, in order by material; a material's lines and their balances are one list.
SWAPS = """WITH side AS (SELECT line_id, upper(trim(commodity_code)) || '|' || upper(trim(size)) || '|' || upper(trim(uom)) AS stuff, upper(trim(commodity_code)) AS code, cast(qty_available AS double) AS shelf, cast(greatest(0, qty_requested - qty_issued) - qty_available - qty_active_bagged AS double) AS needs FROM lines),
rq AS (SELECT q.id, asked_at, donor_id, receiver_id, cast(q.quantity AS double) AS quantity, d.stuff, CASE WHEN d.line_id IS NULL OR r.line_id IS NULL THEN 'NOT_FOUND' WHEN q.quantity <= 0 THEN 'LEDGER_RULE' WHEN donor_id = receiver_id THEN 'SAME_LINE' WHEN d.code = '' OR d.stuff <> r.stuff THEN 'INCOMPATIBLE' END AS code
  FROM borrow_requests q LEFT JOIN side d ON d.line_id = donor_id LEFT JOIN side r ON r.line_id = receiver_id),
o AS (SELECT *, row_number() OVER (PARTITION BY stuff ORDER BY asked_at, id) AS k FROM rq WHERE code IS NULL),
b0 AS (SELECT stuff, list(struct_pack(line := line_id, shelf := shelf, needs := needs)) AS ls FROM side WHERE line_id IN (SELECT donor_id FROM o UNION SELECT receiver_id FROM o) GROUP BY stuff),
st AS (SELECT stuff, cast(0 AS bigint) AS k, ls, cast(NULL AS bigint) AS id, cast(NULL AS varchar) AS code FROM b0
UNION ALL SELECT stuff, k, CASE WHEN code <> 'OK' THEN ls ELSE list_transform(ls, lambda x: struct_pack(line := x.line, shelf := x.shelf - CASE WHEN x.line = donor_id THEN q ELSE 0 END, needs := x.needs + CASE WHEN x.line = donor_id THEN q WHEN x.line = receiver_id THEN -q ELSE 0 END)) END, id, code FROM (
  SELECT *, CASE WHEN d.shelf <= 0 THEN 'NOTHING_TO_LEND' WHEN q > d.shelf THEN 'LIMIT_EXCEEDED' WHEN r.needs <= 0 THEN 'NOT_SHORT' WHEN q > r.needs THEN 'LIMIT_EXCEEDED' ELSE 'OK' END AS code FROM (
    SELECT st.stuff, o.k, ls, o.id, donor_id, receiver_id, o.quantity AS q, list_filter(ls, lambda x: x.line = donor_id)[1] AS d, list_filter(ls, lambda x: x.line = receiver_id)[1] AS r FROM st JOIN o ON st.stuff = o.stuff AND o.k = st.k + 1))),
told AS (SELECT id, code FROM rq WHERE code IS NOT NULL UNION ALL SELECT id, code FROM st WHERE k > 0),
mv AS (SELECT rq.id, unnest([donor_id, receiver_id]) AS line_id, unnest(['SWAP_LENT', 'SWAP_BORROWED']) AS action, unnest([-quantity, quantity]) AS quantity FROM rq JOIN told ON rq.id = told.id AND told.code = 'OK')"""
LINE_NOW = """SELECT line_id, lent, borrowed, located, available, issued, CASE WHEN issued >= asked AND asked > 0 THEN 'Issued' WHEN issued > 0 THEN 'Partially Issued' WHEN confirmed > 0 THEN 'Backordered' WHEN pending > 0 THEN 'Pending Backorder' WHEN bagged >= asked AND asked > 0 THEN 'Bagged'
 WHEN bagged > 0 THEN 'Partially Bagged' WHEN located >= asked AND asked > 0 THEN 'Located' WHEN located > 0 THEN 'Partially Located' ELSE 'Open' END AS line_status FROM (
 SELECT l.line_id, lent, borrowed, cast(qty_confirmed_located AS double) - lent + borrowed AS located, cast(qty_available AS double) - lent AS available, cast(qty_issued AS double) + borrowed AS issued, qty_requested AS asked, qty_confirmed_backorder AS confirmed, qty_pending_backorder AS pending, qty_active_bagged AS bagged
 FROM lines l JOIN (SELECT line_id, coalesce(sum(-quantity) FILTER (action = 'SWAP_LENT'), 0) AS lent, coalesce(sum(quantity) FILTER (action = 'SWAP_BORROWED'), 0) AS borrowed FROM mv GROUP BY 1) m ON m.line_id = l.line_id)"""
SWAP_PARTS = {
    "plan_swaps": "SELECT rq.id, donor_id, receiver_id, quantity, told.code FROM rq JOIN told ON rq.id = told.id",
    "swap_movements": "SELECT id, line_id, action, quantity FROM mv",
    "swap_lines_after": LINE_NOW,
}


def _double(df: DataFrame) -> DataFrame:
    return df.withColumn("quantity", F.col("quantity").cast("double"))

#: Ageing: a limit that passed before the close, or before the end of the log less the delay. Conflicts: a key is claimed anew once its 48 hours are over, so claims are a recursion over a key's rows.
STREAMS = {
    "stream_ageing": """WITH o AS (SELECT event_id AS id, ts, CASE event_type WHEN 'signup' THEN 'request' WHEN 'error' THEN 'notice' WHEN 'click' THEN 'bag' END AS kind FROM events), k AS (SELECT *, CASE WHEN id % 4 <> 0 THEN ts + to_days(cast(id % 34 AS integer)) END AS closed FROM o WHERE kind IS NOT NULL),
x AS (SELECT id, k.kind, closed, days, ts + to_days(days) AS due FROM k JOIN (VALUES ('request', 7), ('notice', 3), ('bag', 14), ('bag', 30)) l(kind, days) ON k.kind = l.kind)
SELECT id, kind, days FROM x WHERE closed > due OR closed IS NULL AND due < (SELECT max(greatest(ts, coalesce(closed, ts))) FROM k) - interval 1 hour""",
    "stream_conflicts": """WITH RECURSIVE r AS (SELECT user_id AS line_id, event_id AS id, ts + to_hours(h) AS came, more AS body, h FROM events JOIN (VALUES (1, 0, 0), (7, 2, 0), (11, 5, 1), (13, 72, 2), (17, 100, 3)) v(every, h, more) ON event_id % every = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY came) AS k FROM r), c AS (SELECT line_id, id, k, came AS began, body AS held, came, body FROM n WHERE k = 1
  UNION ALL SELECT n.line_id, n.id, n.k, CASE WHEN n.came > began + interval 48 hours THEN n.came ELSE began END, CASE WHEN n.came > began + interval 48 hours THEN n.body ELSE held END, n.came, n.body FROM c JOIN n ON n.id = c.id AND n.k = c.k + 1)
SELECT line_id, id, cast(floor(epoch(came - began) / 3600) AS bigint) AS hours FROM c WHERE body <> held""",
}

_NAMES = {"item_no": "NO PT PTNO ITEM ITEMNO", "size": "NPD NPDIN SIZE DIA IN", "description": "DESCRIPTION DESC", "ident": "CMDTYCODE CMDTY CMDTYCD COMMODITY COMMODITYCODE IDENT IDENTNO MATERIALCODE", "qty": "QTY QUANTITY", "remarks": "REMARKS REMARK"}
_CODE = "(?i)^(PS[-A-Z0-9]*|[A-Z]{0,3}[0-9]{5,}[A-Z0-9]*|C[A-Z0-9]{6,}|[0-9][A-Z]{1,6}[0-9]*(-[A-Z0-9]+)+|[0-9][A-Z]{1,6}[0-9]*[A-Z]?[0-9]*[A-Z]?)$"
_QTY = "^[0-9]+([.][0-9]+)?[''′]?$"
#: Lines by recursion, as the first word's top counts; then the section, its headings and rules, and the spans of rows.
BOM = f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY top, x0, word_id) AS rn FROM bom_words),
r AS (SELECT page_id, word_id, rn, top AS began, cast(1 AS bigint) AS line FROM o WHERE rn = 1 UNION ALL SELECT o.page_id, o.word_id, o.rn, CASE WHEN abs(o.top - r.began) <= 5 THEN r.began ELSE o.top END, CASE WHEN abs(o.top - r.began) <= 5 THEN r.line ELSE r.line + 1 END FROM r JOIN o ON o.page_id = r.page_id AND o.rn = r.rn + 1),
w AS (SELECT o.page_id, o.word_id, x0, top, trim(text) AS text, line, lag(trim(text), 1, '') OVER (PARTITION BY o.page_id, line ORDER BY x0, o.word_id) AS prior FROM o JOIN r ON r.word_id = o.word_id AND r.page_id = o.page_id),
ln AS (SELECT page_id, line, list(text ORDER BY x0, word_id) AS toks, string_agg(text, ' ' ORDER BY x0, word_id) AS txt FROM w GROUP BY 1, 2),
s1 AS (SELECT page_id, min(line) AS b FROM ln WHERE regexp_matches(txt, '(?i)\\bBILL\\s+OF\\s+MATERIALS?\\b') GROUP BY 1), s2 AS (SELECT s1.page_id, b, min(line) AS e FROM s1 LEFT JOIN ln ON ln.page_id = s1.page_id AND line > b AND regexp_matches(txt, '(?i)\\b(REV\\.?\\s*NO\\.?|ISSUED\\s+FOR\\s+CONSTRUCTION)\\b') GROUP BY 1, 2),
ins AS (SELECT ln.* FROM ln JOIN s2 ON s2.page_id = ln.page_id WHERE line > b AND (e IS NULL OR line < e)),
hd AS (SELECT page_id, line, name, min(x0) AS x FROM (SELECT w.*, coalesce(h1.name, h2.name) AS name FROM w LEFT JOIN nm h1 ON h1.t = regexp_replace(upper(text), '[^A-Z0-9]', '', 'g') LEFT JOIN nm h2 ON h2.t = regexp_replace(upper(prior || text), '[^A-Z0-9]', '', 'g')) WHERE name IS NOT NULL GROUP BY 1, 2, 3),
fo AS (SELECT t.page_id, t.line, h.name, min(h.x) AS x FROM (SELECT DISTINCT hd.page_id, hd.line FROM hd JOIN ins USING (page_id, line)) t JOIN hd h ON h.page_id = t.page_id AND h.line BETWEEN t.line - 1 AND t.line + 1 GROUP BY 1, 2, 3),
pk AS (SELECT page_id, min(line) AS line FROM (SELECT page_id, line FROM fo GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY 1),
cl AS (SELECT page_id, name, x, lead(x) OVER (PARTITION BY page_id ORDER BY x, name) AS nx FROM fo JOIN pk USING (page_id, line)),
gp AS (SELECT page_id, name, max(struct_pack(g := nxt - x0, at_ := (nxt + x0) / 2)) AS m FROM (SELECT *, lead(x0) OVER (PARTITION BY page_id, name ORDER BY x0) AS nxt FROM (SELECT DISTINCT cl.page_id, name, x0 FROM cl JOIN (SELECT w.page_id, x0 FROM w JOIN ins USING (page_id, line)) q ON q.page_id = cl.page_id AND x0 BETWEEN x AND nx)) WHERE nxt IS NOT NULL GROUP BY 1, 2),
ed AS (SELECT page_id, name, x, coalesce(lag(ru) OVER (PARTITION BY page_id ORDER BY x, name), 0) AS x_from, coalesce(ru, 'infinity'::double) AS x_to FROM (SELECT cl.*, CASE WHEN m.g > 12 THEN m.at_ ELSE (x + nx) / 2 END AS ru FROM cl LEFT JOIN gp ON gp.page_id = cl.page_id AND gp.name = cl.name)),
ce AS (SELECT w.page_id, line, name, trim(string_agg(text, ' ' ORDER BY x0, word_id)) AS cell FROM w JOIN ed ON ed.page_id = w.page_id AND x0 >= x_from AND x0 < x_to GROUP BY 1, 2, 3),
kd AS (SELECT i.page_id, i.line, txt, CASE WHEN regexp_matches(pl, 'SHEET|REVISION|DRAWNBY|CHECKEDBY|APPROVED|SCALE|PROJECTNO|CONTRACTNO|WEIGHT|PIECEMARKS|CONTON|ISOMETRICSPECIFICNOTE|GENERALNOTE') OR coalesce(named, 0) >= 3 OR txt = '' THEN 'none'
   WHEN len(toks) <= 4 AND NOT (len(list_filter(toks[1:2], lambda t: regexp_matches(t, '^[0-9]{{1,3}}$'))) > 0 AND len(list_filter(toks[-2:], lambda t: regexp_matches(t, '{_QTY}'))) > 0) AND regexp_matches(pl, '^(PIP|FITTINGS|FLANGES|VALVES|GASKETS|BOLT|SUPPORTS|HANGERS|INSTR|MISC|SPECIAL|PAINT|INSULATION|BILLOFMATERIAL)') THEN 'category'
   WHEN regexp_matches(coalesce(it.cell, ''), '^[0-9]{{1,3}}$') THEN 'row' WHEN coalesce(it.cell, '') = '' THEN 'rest' ELSE 'none' END AS kind
  FROM (SELECT *, regexp_replace(upper(txt), '[^A-Z0-9]', '', 'g') AS pl FROM ins WHERE page_id IN (SELECT page_id FROM pk)) i LEFT JOIN (SELECT page_id, line, count(*) AS named FROM hd GROUP BY 1, 2) h ON h.page_id = i.page_id AND h.line = i.line LEFT JOIN ce it ON it.page_id = i.page_id AND it.line = i.line AND it.name = 'item_no'),
sp AS (SELECT page_id, line, cast(row_no AS bigint) AS row_no, kind, coalesce(category, '') AS category, txt AS text FROM (SELECT *, count(*) FILTER (kind = 'row') OVER d AS row_no, last_value(CASE WHEN kind IN ('row', 'category') THEN kind END IGNORE NULLS) OVER d AS mark, last_value(CASE WHEN kind = 'category' THEN txt END IGNORE NULLS) OVER d AS category FROM kd WINDOW d AS (PARTITION BY page_id ORDER BY line ROWS UNBOUNDED PRECEDING)) WHERE kind = 'row' OR (kind = 'rest' AND mark = 'row')),
qc AS (SELECT w.page_id, row_no, w.text, abs(x0 - x) AS far, row_number() OVER (PARTITION BY w.page_id, row_no ORDER BY abs(x0 - x), top, x0, w.text) AS k FROM w JOIN sp ON sp.page_id = w.page_id AND sp.line = w.line JOIN ed ON ed.page_id = w.page_id AND ed.name = 'qty' AND x0 >= x_from AND x0 < x_to WHERE regexp_matches(w.text, '{_QTY}')),
pv AS (SELECT sp.page_id, row_no, sp.line, kind, category, {", ".join(f"coalesce(max(cell) FILTER (name = '{n}'), '') AS {n}" for n in _NAMES)} FROM sp LEFT JOIN ce ON ce.page_id = sp.page_id AND ce.line = sp.line GROUP BY ALL),
tk AS (SELECT *, list_filter(string_split_regex(ident, '\\s+'), lambda t: t <> '') AS ti, list_filter(string_split_regex(qty, '\\s+'), lambda t: t <> '') AS tq FROM pv),
sx AS (SELECT *, coalesce(list_filter(ti, lambda t: regexp_matches(t, '{_CODE}'))[1], '') AS code, array_to_string(list_filter(ti, lambda t: NOT regexp_matches(t, '{_CODE}')), ' ') AS si, coalesce(list_filter(tq, lambda t: regexp_matches(t, '{_QTY}'))[-1], '') AS num, array_to_string(list_filter(tq, lambda t: NOT regexp_matches(t, '{_QTY}')), ' ') AS sq FROM tk),
fl AS (SELECT page_id, row_no, line, category, item_no, size, CASE kind WHEN 'row' THEN code ELSE ident END AS ident, CASE kind WHEN 'row' THEN num ELSE qty END AS qty, CASE WHEN kind <> 'row' THEN description ELSE CASE WHEN code = trim(description || ' ' || si) THEN '' ELSE description || ' ' || si END || ' ' || sq END AS description FROM sx)"""
BOM_PARTS = {
    "column_edges": "SELECT page_id, name, x, x_from, x_to FROM ed",
    "bom_row_spans": "SELECT * FROM sp",
    "bom_material_rows": "SELECT * FROM (SELECT page_id, row_no, max(category) AS category, count(*) AS lines, " + ", ".join(f"coalesce(arg_min({n}, line) FILTER ({n} <> ''), '') AS {n}" for n in ("item_no", "size", "ident", "qty")) + ", trim(regexp_replace(string_agg(description, ' ' ORDER BY line), ' +', ' ', 'g')) AS description FROM fl GROUP BY 1, 2) WHERE description <> '' OR qty <> ''",
    "pick_code_qty": "SELECT a.page_id, a.row_no, a.text AS quantity, CASE WHEN b.k IS NULL THEN '' WHEN a.far <= 20 AND b.far - a.far >= 8 THEN 'ignored_numeric_annotation' ELSE 'multiple_quantity_candidates' END AS note FROM qc a LEFT JOIN qc b ON b.page_id = a.page_id AND b.row_no = a.row_no AND b.k = 2 WHERE a.k = 1",
}
_NM = "nm AS (SELECT name, unnest(string_split(t, ' ')) AS t FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _NAMES.items()) + ") v(name, t))"

_LABELS = {"fmr_number": "FMR NO;FMR NUMBER;FMR #;FMR", "iwp_number": "IWP NO;IWP NUMBER;IWP #;IWP", "iso_number": "ISO NO;ISO NUMBER;DRAWING NO;DRAWING;ISO", "iso_sheet": "SHEET;SHT;SHEET NO;ISO SHEET", "iso_revision": "REV;REVISION", "requested_by": "REQUESTED BY;REQUESTOR;REQUESTED",
           "date_required": "DATE REQUIRED;REQUIRED DATE;NEED BY;RAD", "priority": "PRIORITY;URGENCY", "destination": "DESTINATION;DELIVER TO;DELIVERY", "warehouse": "WAREHOUSE;STORE;STORES", "craft": "CRAFT;DISCIPLINE"}
_HEADS = f"{office.HEADINGS}, {office.HEAD}".replace("grid_rows", "src")
_LAB = "regexp_replace(upper(trim({})), '[:.\\s]+$', '')"
_SPLIT = "^(.+?)\\s*[:=]\\s*(.+)$"
#: Cells with their neighbours by joins of rows, every way to a value with its rank, and the first of each field.
LABELS = f"""hl AS (SELECT field, unnest(string_split(t, ';')) AS a FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _LABELS.items())}) v(field, t)),
cx AS (SELECT g.sheet_id, g.row, trim(unnest(g.c)) AS raw, generate_subscripts(g.c, 1) AS col, g.c, d1.c AS c1, d2.c AS c2 FROM gl g LEFT JOIN fp ON fp.sheet_id = g.sheet_id LEFT JOIN gl d1 ON d1.sheet_id = g.sheet_id AND d1.row = g.row + 1 LEFT JOIN gl d2 ON d2.sheet_id = g.sheet_id AND d2.row = g.row + 2 WHERE g.row < coalesce(header_row, 30)),
pp AS (SELECT *, list_filter(list_transform(string_split(raw, chr(10)), lambda t: trim(t)), lambda t: t <> '') AS ps, list_filter(list_transform([c[col + 1], c[col + 2], c[col + 3], c1[col], c2[col]], lambda t: trim(coalesce(t, ''))), lambda t: t <> '' AND NOT regexp_matches(t, '(?m)[:=]\\s*$'))[1] AS near FROM cx WHERE raw <> ''),
pi AS (SELECT sheet_id, row, col, ps, unnest(ps) AS t, generate_subscripts(ps, 1) AS i FROM pp),
vl AS (SELECT sheet_id, row, col, 0 AS rk, i, field, trim(regexp_extract(t, '{_SPLIT}', 2)) AS value FROM pi JOIN hl ON regexp_matches(t, '{_SPLIT}') AND {_LAB.format(f"regexp_extract(t, '{_SPLIT}', 1)")} = a
  UNION ALL SELECT sheet_id, row, col, 1, i, field, ps[i + 1] FROM pi JOIN hl ON {_LAB.format("t")} = a WHERE i < len(ps) UNION ALL SELECT sheet_id, row, col, 2, 0, field, near FROM pp JOIN hl ON {_LAB.format("raw")} = a WHERE near IS NOT NULL),
v1 AS (SELECT sheet_id, field, arg_min(value, (row, col, rk, i)) AS value FROM vl WHERE value <> '' GROUP BY 1, 2),
tc AS (SELECT h.sheet_id, header_row, field, min(i) AS at_ FROM (SELECT sheet_id, header_row, unnest(c) AS cell, generate_subscripts(c, 1) AS i FROM gl JOIN fp USING (sheet_id) WHERE row = header_row) h JOIN hl ON regexp_replace(upper(cell), '[^A-Z0-9]', '', 'g') = regexp_replace(a, '[^A-Z0-9]', '', 'g') GROUP BY ALL),
v2 AS (SELECT tc.sheet_id, field, arg_min(trim(c[at_]), row) AS value FROM tc JOIN gl ON gl.sheet_id = tc.sheet_id AND row > header_row WHERE trim(coalesce(c[at_], '')) <> '' GROUP BY 1, 2),
lv AS (SELECT sheet_id, field, coalesce(v1.value, v2.value) AS value, CASE WHEN v1.value IS NOT NULL THEN 'label' ELSE 'column' END AS place FROM v1 FULL JOIN v2 USING (sheet_id, field))"""
_KEPT = "src AS (SELECT * FROM form_rows WHERE NOT regexp_matches(trim(sheet_name), '(?i)^instructions|^notes$|^legend|^cover'))"
_CELL = "trim(coalesce(c[{} + 1], ''))"
CORPUS = f"""{LABELS}, bd AS (SELECT g.sheet_id, row, {_CELL.format("description")} AS ds, {_CELL.format("quantity")} AS qs FROM gl g JOIN fp ON fp.sheet_id = g.sheet_id WHERE row > header_row),
en AS (SELECT *, ds = '' AND qs = '' AS blank, max(CASE WHEN ds <> '' AND regexp_matches(ds, '(?i)^(total|grand total|subtotal|end of)') OR b3 = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY sheet_id ORDER BY row) AS past FROM (SELECT *, sum(CASE WHEN ds = '' AND qs = '' THEN 1 ELSE 0 END) OVER (PARTITION BY sheet_id ORDER BY row ROWS 2 PRECEDING) AS b3 FROM bd)),
lc AS (SELECT sheet_id, count(*) AS lines FROM en WHERE past = 0 AND NOT blank GROUP BY 1), hv AS (SELECT sheet_id, {", ".join(f"max(value) FILTER (field = '{f}') AS {f}" for f in _LABELS)} FROM lv GROUP BY 1),
xs AS (SELECT k.sheet_id, k.sheet_name, hv.* EXCLUDE (sheet_id), coalesce(lines, 0) AS lines, concat_ws(',', CASE WHEN fmr_number IS NULL THEN 'MISSING_HEADER:fmr_number' END, CASE WHEN iso_number IS NULL THEN 'MISSING_HEADER:iso_number' END, CASE WHEN header_row IS NULL THEN 'NO_TABLE' END,
  CASE WHEN header_row IS NOT NULL AND description IS NULL THEN 'MISSING_COLUMN:description' END, CASE WHEN header_row IS NOT NULL AND quantity IS NULL THEN 'MISSING_COLUMN:quantity' END, CASE WHEN header_row IS NOT NULL AND coalesce(lines, 0) = 0 THEN 'NO_LINES' END) AS rejected_for
  FROM (SELECT DISTINCT sheet_id, sheet_name FROM src) k LEFT JOIN hv ON hv.sheet_id = k.sheet_id LEFT JOIN fp ON fp.sheet_id = k.sheet_id LEFT JOIN lc ON lc.sheet_id = k.sheet_id)"""
_DRAWING = "nullif(regexp_replace(regexp_replace(regexp_replace(upper(trim(iso_number)), '\\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), '')"
_SHEET = "coalesce(CASE WHEN trim(iso_sheet) = '' THEN NULL WHEN regexp_extract(iso_sheet, '([0-9]+)\\s*$', 1) = '' THEN upper(trim(iso_sheet)) ELSE CASE WHEN length(cast(cast(regexp_extract(iso_sheet, '([0-9]+)\\s*$', 1) AS bigint) AS varchar)) >= 2 THEN cast(cast(regexp_extract(iso_sheet, '([0-9]+)\\s*$', 1) AS bigint) AS varchar) ELSE lpad(cast(cast(regexp_extract(iso_sheet, '([0-9]+)\\s*$', 1) AS bigint) AS varchar), 2, '0') END END, '01')"
SHEETS = {
    "labeled_values": f"WITH src AS (SELECT * FROM form_rows), {_HEADS}, {LABELS} SELECT sheet_id, field, value, place FROM lv",
    "extract_corpus": f"WITH {_KEPT}, {_HEADS}, {CORPUS} SELECT * REPLACE ({_DRAWING} AS iso_number, {_SHEET} AS iso_sheet) FROM xs",
    "extract_rejects": f"WITH {_KEPT}, {_HEADS}, {CORPUS} SELECT sheet_id, split_part(r, ':', 1) AS code, split_part(r, ':', 2) AS field FROM (SELECT sheet_id, unnest(string_split(rejected_for, ',')) AS r FROM xs WHERE rejected_for <> '')",
}


def queries(over: Callable[..., Query]) -> dict[str, Query]:
    replayed = lambda kind: over(lambda log: fieldlog.part(fieldlog.replay_full(log), kind), "field_log")
    planned = lambda f: over(lambda q, x: f(borrow.plan_swaps(q, x), x), "borrow_requests", "lines")
    return {name: replayed(kind) for name, (kind, _) in PARTS.items()} | {
        "plan_swaps": planned(lambda s, _: _double(s)), "swap_movements": planned(lambda s, _: borrow.movements(s)), "swap_lines_after": planned(borrow.after),
        "labeled_values": over(grids.labeled_values, "form_rows"), "extract_corpus": over(grids.extract_corpus, "form_rows"), "extract_rejects": over(lambda g: grids.rejects(grids.extract_corpus(g)), "form_rows"),
        **{name: over(f, "bom_words") for name, f in (("column_edges", bom.column_edges), ("bom_row_spans", bom.row_spans), ("bom_material_rows", bom.material_rows), ("pick_code_qty", bom.pick_quantities))},
        "stream_ageing": alerts.stream_ageing, "stream_conflicts": alerts.stream_conflicts, "stream_balance": alerts.stream_balance,
        "stream_integrity": lambda spark, d: alerts.stream_integrity(domain(spark, d, "lines")[0], movements(spark, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {name: with_views(f"{REPLAY} {told}", "field_log", recursive=True) for name, (_, told) in PARTS.items()} | {name: with_views(f"{SWAPS} {told}", "borrow_requests", "lines", recursive=True) for name, told in SWAP_PARTS.items()} | STREAMS | {name: with_views(BOM.replace("WITH o AS", f"WITH {_NM}, o AS", 1) + " " + told, "bom_words", recursive=True) for name, told in BOM_PARTS.items()} | {name: with_views(told, "form_rows") for name, told in SHEETS.items()}
