"""Material rows from the placed words of a page: the section of the list, its columns from the headings, the lines of each row, and the choice of a quantity.

A page is the unit and pages are apart: all its steps are done at once where its words are, over columns of a run of pages, so words are shuffled once and nothing is joined or written. Forms are those of RE2, as in the SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from . import words as W
from .pages import Words, by_page, columns

# Fixed values of the baseline profile: the section's begin and end, headings without punctuation by column, headings within the list, marks of lines that are no rows, and forms of a cell.
SECTION, SECTION_END = r"(?i)\bBILL\s+OF\s+MATERIALS?\b", r"(?i)\b(REV\.?\s*NO\.?|ISSUED\s+FOR\s+CONSTRUCTION|ISOMETRIC\s+SPECIFIC\s+NOTE|PIECE\s+MARKS|CUT\s+LENGTH|LINE\s+NUMBER|PROJECT\s+NO)\b"
HEADINGS = {
    "item_no": ("NO", "PT", "PTNO", "ITEM", "ITEMNO"),
    "size": ("NPD", "NPDIN", "SIZE", "DIA", "IN"),
    "description": ("DESCRIPTION", "DESC"),
    "ident": ("CMDTYCODE", "CMDTY", "CMDTYCD", "COMMODITY", "COMMODITYCODE", "IDENT", "IDENTNO", "MATERIALCODE"),
    "qty": ("QTY", "QUANTITY"),
    "remarks": ("REMARKS", "REMARK"),
}
CATEGORIES = ("PIPE", "PIPING", "FITTINGS", "FLANGES", "VALVES", "GASKETS", "BOLTS", "BOLTING", "SUPPORTS", "PIPESUPPORTS", "HANGERS", "INSTRUMENTS", "INSTRUMENT", "INSTR", "MISC", "MISCELLANEOUS", "SPECIALTYITEMS", "SPECIALITEMS", "PAINT", "INSULATION", "BILLOFMATERIALS", "BILLOFMATERIAL")
IGNORED = ("SHEET", "REVISION", "DRAWNBY", "CHECKEDBY", "APPROVED", "SCALE", "PROJECTNO", "CONTRACTNO", "WEIGHT", "PIECEMARKS", "CONTON", "ISOMETRICSPECIFICNOTE", "GENERALNOTE")
CODE = r"(?i)^(PS[\-A-Z0-9]*|[A-Z]{0,3}\d{5,}[A-Z0-9]*|C[A-Z0-9]{6,}|\d[A-Z]{1,6}\d*(-[A-Z0-9]+)+|\d[A-Z]{1,6}\d*[A-Z]?\d*[A-Z]?)$"
ITEM, QUANTITY = r"^\d{1,3}$", r"^\d+(\.\d+)?['′]?$"
#: Least headings of a heading row, a gap between columns, and how near to its heading a quantity is beyond doubt, and by how much.
LEAST, GAP, NEAR, AHEAD = 3, 12.0, 20.0, 8.0

TOLERANCE = W.TOLERANCE
NAMES = sorted(HEADINGS)


def _pieces() -> tuple[list[str], np.ndarray, np.ndarray]:
    """Begins and ends of headings, the heading that each of them is, and the one that two of them are; the last row and column are for all other words."""
    known = {h: NAMES.index(n) for n, hs in HEADINGS.items() for h in hs}
    pieces = sorted({x for h in known for i in range(len(h) + 1) for x in (h[:i], h[i:])})
    whole, pairs = np.full(len(pieces) + 1, -1), np.full((len(pieces) + 1, len(pieces) + 1), -1)
    for i, a in enumerate(pieces):
        whole[i] = known.get(a, -1)
        pairs[i, :-1] = [known.get(a + b, -1) for b in pieces]
    return pieces, whole, pairs


PIECES, WHOLE, PAIRS = _pieces()
L, D, S = LongType(), DoubleType(), StringType()
EDGES = StructType([StructField(*c) for c in (("page_id", L), ("name", S), ("x", D), ("x_from", D), ("x_to", D))])
SPANS = StructType([StructField(*c) for c in (("page_id", L), ("line", L), ("row_no", L), ("kind", S), ("category", S), ("text", S))])
ROWS = StructType([StructField(*c) for c in (("page_id", L), ("row_no", L), ("category", S), ("lines", L), ("item_no", S), ("size", S), ("ident", S), ("qty", S), ("description", S))])
QUANTITIES = StructType([StructField(*c) for c in (("page_id", L), ("row_no", L), ("quantity", S), ("note", S))])


class Edges(NamedTuple):
    """Columns of the pages that have a list: by page and name, whether there is one, its heading's x and its range. row: of each page, or -1."""

    row: np.ndarray
    there: np.ndarray
    x: np.ndarray
    begin: np.ndarray
    end: np.ndarray


class Spans(NamedTuple):
    """Lines of material rows: the line, the row's number on its page, whether it begins the row, and the category."""

    at: np.ndarray
    no: np.ndarray
    begins: np.ndarray
    category: pa.Array

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """The row of each line, and the first line of each row."""
        return np.cumsum(self.begins) - 1, np.flatnonzero(self.begins)

def given_edges(table: pa.Table) -> Edges:
    """The columns given for one page."""
    there, x, begin, end = np.zeros((1, len(NAMES)), bool), *(np.full((1, len(NAMES)), np.nan) for _ in range(3))
    for e in table.to_pylist():
        if e["name"] in HEADINGS:
            at = NAMES.index(e["name"])
            there[0, at], x[0, at], begin[0, at], end[0, at] = True, e["x"], e["x_from"], e["x_to"]
    return Edges(np.zeros(1, np.int64), there, x, begin, end)


def _first(where: np.ndarray, of: np.ndarray, n: int, none: int) -> np.ndarray:
    """The first place where something holds, for each of n groups; of: the group of each place."""
    at, out = np.flatnonzero(where), np.full(n, none)
    out[of[at][::-1]] = at[::-1]
    return out


def _like(text: pa.Array, form: str) -> np.ndarray:
    return pc.match_substring_regex(text, form).fill_null(False).to_numpy(zero_copy_only=False)


def _joined(text: pa.Array, group: np.ndarray, n: int, between: str = " ") -> pa.Array:
    """The texts of each of n groups, in which the texts come in order; nulls are left out."""
    if text.null_count:
        kept = text.is_valid()
        text, group = text.filter(kept), group[kept.to_numpy(zero_copy_only=False)]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=n))])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), text), between)


def _plain(text: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_upper(text), "[^A-Z0-9]+", "")


def _at(text: pa.Array, at: np.ndarray) -> pa.Array:
    """The texts at these places; none where the place is -1."""
    return text.take(pa.array(at, mask=at < 0)).fill_null("")


class Lists:
    """A run of whole pages: the words in their lines by x0, the lines with their text, and which are in the list's section (between its begin and its end, both left out)."""

    def __init__(self, w: Words) -> None:
        begin = np.flatnonzero(np.concatenate([[True], w.page[1:] != w.page[:-1]]))
        sizes = np.diff(np.append(begin, len(w.page)))
        fresh = self._fresh(w.top, begin, sizes)
        self.line = np.cumsum(fresh) - 1
        order = np.lexsort((w.word, w.x0, self.line))
        self.x0, self.top, text = w.x0[order], w.top[order], w.text.take(pa.array(order))
        self.pages, self.first = w.page[begin], np.flatnonzero(fresh)
        self.page = np.repeat(np.arange(len(begin)), sizes)[self.first]
        self.size = np.diff(np.append(self.first, len(w.page)))
        n = len(self.page)
        self.number = np.arange(n) - np.searchsorted(self.page, np.arange(len(begin)))[self.page] + 1
        told = text.dictionary_encode()
        # What is asked of a word is asked once for each text; the last place is for nulls.
        self.word, self.code, self.known = text, told.indices.fill_null(len(told.dictionary)).to_numpy(zero_copy_only=False), told.dictionary
        self.text = _joined(text, self.line, n)
        began = _first(_like(self.text, SECTION), self.page, len(begin), n)[self.page]
        after = np.arange(n) > began
        self.inside = after & (np.arange(n) < _first(after & _like(self.text, SECTION_END), self.page, len(begin), n)[self.page])
        self.there, self.x = self._headings()

    @staticmethod
    def _fresh(top: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether a word begins a line: from the top, it joins the line if its top is within tolerance of the line's first word. All pages go on word by word together."""
        fresh, order = np.ones(len(top), bool), np.argsort(-sizes, kind="stable")
        begin, left = begin[order], np.searchsorted(-sizes[order], -np.arange(1, sizes.max()), side="left")
        began = top[begin]
        for k, n in enumerate(left, 1):
            now = top[begin[:n] + k]
            new = ~(np.abs(now - began[:n]) <= TOLERANCE)
            fresh[begin[:n] + k] = new
            began[:n] = np.where(new, now, began[:n])
        return fresh

    def says(self, form: str) -> np.ndarray:
        """Whether each word has this form."""
        return np.append(_like(self.known, form), False)[self.code]

    def _headings(self) -> tuple[np.ndarray, np.ndarray]:
        """By line and name, whether the heading is there and its first place; a heading may be two words."""
        piece = np.append(pc.index_in(_plain(self.known), value_set=pa.array(PIECES, pa.string())).fill_null(len(PIECES)).to_numpy(zero_copy_only=False), len(PIECES))[self.code]
        before = np.roll(piece, 1)
        before[self.first] = PIECES.index("")
        name = np.where(WHOLE[piece] >= 0, WHOLE[piece], PAIRS[before, piece])
        there, x = np.zeros((len(self.page), len(NAMES)), bool), np.full((len(self.page), len(NAMES)), np.inf)
        at = np.flatnonzero(name >= 0)
        key = self.line[at] * len(NAMES) + name[at]
        there.ravel()[key] = True
        x.ravel()[key[::-1]] = self.x0[at][::-1]
        return there, x

    def edges(self) -> Edges:
        """The heading row is the first line of the section that, with the lines above and below, names three columns or more. Between two headings the rule stands in the widest gap of the section's word starts if that is wider than 12, else half way."""
        at, row = np.flatnonzero(self.inside & self.there.any(1)), np.full(len(self.pages), -1)
        there, x = self.there[at], self.x[at]
        for beside in (at - 1, at + 1):
            near = np.clip(beside, 0, len(self.page) - 1)
            same = ((near == beside) & (self.page[near] == self.page[at]))[:, None]
            there, x = there | self.there[near] & same, np.fmin(x, np.where(same, self.x[near], np.inf))
        best = _first(there.sum(1) >= LEAST, self.page[at], len(self.pages), -1)
        there, x = there[best[best >= 0]], x[best[best >= 0]]
        row[best >= 0] = np.arange(len(x))
        order = np.lexsort((x, ~there))  # by place, then by name; what is not there is last
        placed, x_at = np.take_along_axis(there, order, 1), np.take_along_axis(x, order, 1)
        rule = np.where(placed[:, 1:], (x_at[:, :-1] + x_at[:, 1:]) / 2, np.inf)
        held = self.inside & (row[self.page] >= 0)
        of, starts = row[self.page[self.line]][held[self.line]], self.x0[held[self.line]]
        order_of = np.lexsort((starts, of))
        of, starts = of[order_of], starts[order_of]
        pair = np.flatnonzero((of[1:] == of[:-1]) & (starts[1:] > starts[:-1]))
        of, a, b = of[pair], starts[pair], starts[pair + 1]
        column = (placed[of] & (x_at[of] <= a[:, None])).sum(1) - 1
        after = np.minimum(column + 1, len(NAMES) - 1)
        kept = (column >= 0) & (column + 1 < len(NAMES)) & placed[of, after] & (b <= x_at[of, after])
        of, column, a, b = of[kept], column[kept], a[kept], b[kept]
        widest = np.lexsort(((b + a) / 2, b - a, column, of))
        of, column, a, b = of[widest], column[widest], a[widest], b[widest]
        last = np.append((of[1:] != of[:-1]) | (column[1:] != column[:-1]), True)[: len(of)] & (b - a > GAP)
        rule[of[last], column[last]] = ((b + a) / 2)[last]
        begin, end = np.empty_like(x), np.empty_like(x)
        np.put_along_axis(begin, order, np.hstack([np.zeros((len(x), 1)), rule]), 1)
        np.put_along_axis(end, order, np.hstack([rule, np.full((len(x), 1), np.inf)]), 1)
        return Edges(row, there, x, begin, end)

    def edge_table(self) -> pa.Table:
        e = self.edges()
        at, name = np.nonzero(e.there)
        page = self.pages[e.row >= 0][at]
        return pa.table({"page_id": page, "name": pa.array(NAMES).take(pa.array(name)), "x": e.x[at, name], "x_from": e.begin[at, name], "x_to": e.end[at, name]})

    def cells(self, e: Edges, place: np.ndarray, n: int, names: list[int]) -> list[pa.Array]:
        """Texts of n lines by column, for the columns named; place: of each line, or -1. Words outside of all columns are left out."""
        word = np.flatnonzero(place[self.line] >= 0)
        row = e.row[self.page[self.line[word]]]
        out = []
        for name in names:
            held = word[e.there[row, name] & (self.x0[word] >= e.begin[row, name]) & (self.x0[word] < e.end[row, name])]
            out.append(pc.utf8_trim(_joined(self.word.take(pa.array(held)), place[self.line[held]], n), " "))
        return out

    def spans(self, e: Edges) -> Spans:
        """The lines of each material row: a line with an item number begins one, lines without go on with it, a category ends it and holds for the rows below. A line is a heading again, a category, the begin of a row, the rest of one, or nothing."""
        at = np.flatnonzero(self.inside & (e.row[self.page] >= 0))
        place = np.full(len(self.page), -1)
        place[at] = np.arange(len(at))
        text, page, first, size = self.text.take(pa.array(at)), self.page[at], self.first[at], self.size[at]
        item = self.cells(e, place, len(at), [NAMES.index("item_no")])[0]
        plain, number, quantity = _plain(text), self.says(ITEM), self.says(QUANTITY)
        numbered = (number[first] | number[first + np.minimum(size, 2) - 1]) & (quantity[first + size - 1] | quantity[first + np.maximum(size, 2) - 2])
        none = _like(plain, "|".join(IGNORED)) | (self.there[at].sum(1) >= LEAST) | pc.equal(text, "").to_numpy(zero_copy_only=False)
        category = ~none & (size <= 4) & ~numbered & _like(plain, "^(" + "|".join(CATEGORIES) + ")")
        begins = ~none & ~category & _like(item, ITEM)
        rest = ~none & ~category & pc.equal(item, "").to_numpy(zero_copy_only=False)
        here, top = np.arange(len(at)), np.searchsorted(page, page)
        mark = np.maximum.accumulate(np.where(begins | category, here, -1)) if len(at) else here
        titled = np.maximum.accumulate(np.where(category, here, -1)) if len(at) else here
        no = np.cumsum(begins)
        no = no - no[top] + begins[top]
        kept = np.flatnonzero(begins | rest & (mark >= top) & begins[mark])
        return Spans(at[kept], no[kept], begins[kept], _at(text, np.where(titled >= top, titled, -1)).take(pa.array(kept)))

    def span_table(self, e: Edges | None = None) -> pa.Table:
        s = self.spans(e or self.edges())
        kind = pa.array(["rest", "row"]).take(pa.array(s.begins.astype(np.int8)))
        return pa.table({"page_id": self.pages[self.page[s.at]], "line": self.number[s.at], "row_no": s.no, "kind": kind, "category": s.category, "text": self.text.take(pa.array(s.at))})

    def material_table(self, e: Edges | None = None) -> pa.Table:
        """One row for each span that holds a description or a quantity: item, category, text of its columns, how many lines it took.

        In a row's first line the code is the first token of its column that looks like one, and the quantity the last number of its own; what else stands there runs on from the description. The
        description joins all lines; the other columns are the first that is filled."""
        e = e or self.edges()
        s = self.spans(e)
        place, n = np.full(len(self.page), -1), len(s.at)
        place[s.at] = np.arange(n)
        item, size, ident, qty, description = self.cells(e, place, n, [NAMES.index(c) for c in ("item_no", "size", "ident", "qty", "description")])
        begins = pa.array(s.begins)

        def chosen(cell: pa.Array, form: str, last: bool) -> tuple[pa.Array, pa.Array]:
            """The first or last token of the form, and the other tokens."""
            parts = pc.split_pattern_regex(pc.if_else(begins, cell, ""), r"\s+")
            of, token = pc.list_parent_indices(parts).to_numpy(), parts.flatten()
            filled = pc.not_equal(token, "").to_numpy(zero_copy_only=False)
            fits = filled & _like(token, form)
            at = np.full(n, -1)
            found = np.flatnonzero(fits)[:: 1 if last else -1]
            at[of[found]] = found
            left = np.flatnonzero(filled & ~fits)
            return _at(token, at), _joined(token.take(pa.array(left)), of[left], n)

        code, spill = chosen(ident, CODE, False)
        number, loose = chosen(qty, QUANTITY, True)
        described = pc.binary_join_element_wise(description, spill, " ")
        described = pc.if_else(pc.equal(code, pc.utf8_trim(described, " ")), "", described)
        whole = pc.if_else(begins, pc.binary_join_element_wise(described, loose, " "), description)
        row, begin = s.rows()

        def filled(cell: pa.Array) -> pa.Array:
            return _at(cell, _first(pc.not_equal(cell, "").to_numpy(zero_copy_only=False), row, len(begin), -1))

        told = pc.utf8_trim(pc.replace_substring_regex(_joined(whole, row, len(begin)), " +", " "), " ")
        out = {"page_id": self.pages[self.page[s.at[begin]]], "row_no": s.no[begin], "category": s.category.take(pa.array(begin)), "lines": np.bincount(row, minlength=len(begin))}
        out |= {"item_no": filled(item), "size": filled(size), "ident": filled(pc.if_else(begins, code, ident)), "qty": filled(pc.if_else(begins, number, qty)), "description": told}
        table = pa.table(out)
        return table.filter(pc.or_(pc.not_equal(table["description"], ""), pc.not_equal(table["qty"], "")))

    def quantity_table(self, e: Edges | None = None) -> pa.Table:
        """The quantity of each row among the numbers in its column: the one nearest to the heading, then the highest, then the leftmost. A second one is an annotation if the first is near enough and well ahead, else a doubt."""
        e = e or self.edges()
        s, name = self.spans(e), NAMES.index("qty")
        row, begin = s.rows()
        place = np.full(len(self.page), -1)
        place[s.at] = row
        word = np.flatnonzero((place[self.line] >= 0) & self.says(QUANTITY))
        of = e.row[self.page[self.line[word]]]
        held = e.there[of, name] & (self.x0[word] >= e.begin[of, name]) & (self.x0[word] < e.end[of, name])
        word, of = word[held], of[held]
        far, text = np.abs(self.x0[word] - e.x[of, name]), self.word.take(pa.array(word))
        order = np.lexsort((pc.rank(text, tiebreaker="dense").to_numpy() if len(text) else far, self.x0[word], self.top[word], far, place[self.line[word]]))
        word, far, text, row = word[order], far[order], text.take(pa.array(order)), place[self.line[word]][order]
        best = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])[: len(row)])
        second = np.minimum(best + 1, len(row) - 1)
        two = (second > best) & (row[second] == row[best])
        sure = (far[best] <= NEAR) & (far[second] - far[best] >= AHEAD)
        note = pa.array(["", "ignored_numeric_annotation", "multiple_quantity_candidates"]).take(pa.array(np.where(two, np.where(sure, 1, 2), 0)))
        at = begin[row[best]]
        return pa.table({"page_id": self.pages[self.page[s.at[at]]], "row_no": s.no[at], "quantity": text.take(pa.array(best)), "note": note})

def _told(words: DataFrame, edges: DataFrame | None, told: Callable[[Lists, Edges | None], pa.Table], out: StructType) -> DataFrame:
    """What is told of each page's list, by its own columns or by those given."""
    if edges is None:
        return by_page(words, lambda w: told(Lists(w), None), out)
    schema = to_arrow_schema(out)

    def one(page: pa.Table, given: pa.Table) -> pa.Table:
        if not page.num_rows or not given.num_rows:
            return schema.empty_table()
        w = columns(page).ordered()
        return told(Lists(w._replace(text=w.text.cast(pa.string()))), given_edges(given)).cast(schema)

    return words.groupBy("page_id").cogroup(edges.groupBy("page_id")).applyInArrow(one, out)


def placed(words: DataFrame) -> DataFrame:
    """The words with their visual line."""
    lines = W.line_grouping(words.select("page_id", "word_id", "x0", "top", F.trim("text").alias("text")), carried=("text",))
    return lines.select("page_id", "word_id", "x0", "top", "text", "line")


def column_edges(words: DataFrame) -> DataFrame:
    """The columns of each page's list: the heading's x and the range that the column owns."""
    return by_page(words, lambda w: Lists(w).edge_table(), EDGES)


def row_spans(words: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    return _told(words, edges, Lists.span_table, SPANS)


def material_rows(words: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    return _told(words, edges, Lists.material_table, ROWS)


def pick_quantities(words: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    return _told(words, edges, Lists.quantity_table, QUANTITIES)
