"""Notes, typos and HTML of pivots that are held as arrays, in Arrow batches.

Spark columns draw what happens to a variant; here it happens to its few cells. All choices are the digests of ``perturb``,
so a cell looks the same whichever way it was made.
"""

from __future__ import annotations

import hashlib
import html as entities
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators.cells import NO_PATH
from tabloom.operators.perturb import INVISIBLE, PATH_MARK
from tabloom.operators.units import NULL_TOKENS

_NULLS = frozenset(NULL_TOKENS)


def _digest(text: str) -> str:
    return hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()


def _unit(digest: str) -> float:
    return int(digest[:8], 16) / 4294967296.0


def _joined(path: str) -> str:
    return "" if path == NO_PATH else path.replace(PATH_MARK, "|")


def _filled(value: str | None) -> bool:
    return value is not None and value.strip(" ") not in _NULLS


def _textual(text: str | None) -> bool:
    return text is not None and text.strip("0123456789") != ""


def _escaped(text: str) -> str:
    return entities.escape(text, quote=False) if "&" in text or "<" in text or ">" in text else text


def _share(size: int, strength: int) -> int:
    return max(1, int(size * strength / 100))


def noted(r: Sequence[str], c: Sequence[str], values: Sequence[str | None], key: str, seed: int, strength: int, templates: list[str]) -> list[str | None]:
    """The values with a note in a share of the filled ones, see ``perturb.add_notes``."""
    out, places = list(values), []
    for i, value in enumerate(values):
        if _filled(value):
            row, col = _joined(r[i]), _joined(c[i])
            places.append((_digest(f"{seed}|note|{key}|{row}|{col}"), row, col, i))
    places.sort()
    last = places[_share(len(places), strength) - 1][:3] if places else ()
    for *place, i in places:
        if tuple(place) > last:
            break
        cell = f"{key}|{place[1]}|{place[2]}"
        text = templates[int(_unit(_digest(f"{seed}|note-template|{cell}")) * len(templates))]
        if "{number}" in text:
            text = text.replace("{number}", str(1 + int(_unit(_digest(f"{seed}|note-number|{cell}")) * 5)))
        out[i] = text.replace("{value}", values[i])
    return out


def noisy(text: str, seed: str, strength: int) -> str:
    """``perturb.noisy`` of one text."""
    invisible = lambda i: INVISIBLE[int(_unit(_digest(f"{seed}|sign|{i}")) * len(INVISIBLE))]
    spots = lambda n, draw: [i for _, i in sorted((_digest(f"{seed}|{draw}|{i}"), i) for i in gaps)[:n]]
    chars, free = list(text), [not c.isdecimal() for c in text]
    gaps = [i for i in range(1, len(chars)) if free[i - 1] and free[i]]
    if not gaps:
        return text + invisible(len(chars))
    share = int(len(gaps) * strength / 100)
    if share > 0 and _digest(f"{seed}|kind") < "8":
        for i in spots(share, "gap") + (spots(share, "second") if _digest(f"{seed}|rounds") < "8" else []):
            chars[i - 1], chars[i] = chars[i], chars[i - 1]
    else:
        for i in spots(max(share, 1), "gap"):
            chars[i] = invisible(i) + chars[i]
    return "".join(chars)


def mistyped(
    r: Sequence[str], c: Sequence[str], values: Sequence[str | None], key: str, seed: int, strength: int
) -> tuple[list[str], list[str], list[str | None]]:
    """Cells with noise in a share of their values, row labels and column labels, see ``perturb.typos``."""
    others = {col: _joined(col) for col in c}
    slots = []
    for row, col, value in zip(r, c, values):
        if _textual(value):
            slots.append((_digest(f"{seed}|typo|{key}|data|{_joined(row)}|{others[col]}"), "data", row, others[col], None, value))
    for kind, side in (("row_path", r), ("col_path", c)):
        for path in dict.fromkeys(side):
            parts = [] if path == NO_PATH else path.split(PATH_MARK)
            spots = [i for i, part in enumerate(parts) if _textual(part)]
            if spots:
                level = spots[int(_unit(_digest(f"{seed}|level-{kind}|{key}|{_joined(path)}")) * len(spots))]
                slots.append((_digest(f"{seed}|typo|{key}|{kind}|{_joined(path)}|"), kind, path, "", level, parts[level]))
    slots.sort()
    noise: dict[tuple, str] = {}
    for h, kind, path, other, level, text in slots[: _share(len(slots), strength)]:
        out = noisy(text, h, strength)
        if level is not None:
            parts = path.split(PATH_MARK)
            out = PATH_MARK.join([*parts[:level], out, *parts[level + 1 :]])
        noise.setdefault((kind, path, other), out)
    named = lambda kind, path: noise.get((kind, path, ""), path)
    shown = [noise.get(("data", row, others[col]), value) for row, col, value in zip(r, c, values)]
    return [named("row_path", row) for row in r], [named("col_path", col) for col in c], shown


def page(
    r: Sequence[str], c: Sequence[str], values: Sequence[str | None], label: str | None, everywhere: bool, blank_rows: list[float], blank_columns: list[float]
) -> str:
    """A pivot as HTML: sorted lines, below a line with ``label`` if there is one, and blank lines at the drawn places.

    The label stands over every column or the first; of cells in the same place the first is shown.
    """
    row_levels, col_levels = r[0].count(PATH_MARK) + 1, c[0].count(PATH_MARK) + 1
    lines: dict[str, dict[str, str]] = {}
    for row, col, value in zip(r, c, values):
        lines.setdefault(row, {}).setdefault(col, _escaped(value) if value else "")
    rows = [(row, "data") for row in sorted(lines)]
    cols: list[tuple[str, str | None]] = [(col, col) for col in sorted(set(c))]
    first = cols[0][0]
    if label is not None:
        label = _escaped(label)
        rows.insert(0, (PATH_MARK.join([label] * row_levels), "header"))
    for draw in blank_rows:
        rows.insert(int(draw * (len(rows) + 1)), (PATH_MARK * (row_levels - 1), "blank"))
    for draw in blank_columns:
        cols.insert(int(draw * (len(cols) + 1)), (PATH_MARK * (col_levels - 1), None))
    names = [_escaped(name).split(PATH_MARK) for name, _ in cols]
    corner, places = "<th></th>" * row_levels, [place for _, place in cols]
    text = ["<table><thead>"]
    for k in range(col_levels):
        text += "<tr>", corner, "<th>", "</th><th>".join([n[k] for n in names if k < len(n)]), "</th></tr>"
    text.append("</thead><tbody>")
    for name, kind in rows:
        if kind == "data":
            mine, name = lines[name], _escaped(name)
            shown = [mine.get(place, "") for place in places]
        elif kind == "header":
            shown = [label if everywhere or name == first else "" for name, _ in cols]
        else:
            shown = [""] * len(cols)
        text += "<tr><th>", name.replace(PATH_MARK, "</th><th>"), "</th><td>", "</td><td>".join(shown), "</td></tr>"
    text.append("</tbody></table>")
    return "".join(text)


def _values(array: pa.Array) -> list:
    return array.to_numpy(zero_copy_only=False).tolist()


def _lists(array: pa.Array) -> list:
    """The lists of an array as slices, null for null."""
    parts, sizes = _values(array.flatten()), np.asarray(array.value_lengths().fill_null(0))
    ends = np.cumsum(sizes).tolist()
    return [parts[a:b] if known else None for a, b, known in zip([0, *ends], ends, _values(array.is_valid()))]


@F.arrow_udf(T.StringType())
def _pages(
    cells: pa.Array, variant: pa.Array, seed: pa.Array, unit: pa.Array, notes: pa.Array, templates: pa.Array, typos: pa.Array, label: pa.Array,
    everywhere: pa.Array, blank_rows: pa.Array, blank_columns: pa.Array,
) -> pa.Array:
    sides = [_values(cells.flatten().field(name)) for name in ("r", "c", "value")]
    ends = np.cumsum(np.asarray(cells.value_lengths().fill_null(0))).tolist()
    drawn = [_values(x) for x in (variant, seed, unit, notes)] + [_lists(templates)] + [_values(x) for x in (typos, label, everywhere)]
    drawn += [_lists(blank_rows), _lists(blank_columns)]
    out = []
    for start, end, key, n, mark, strength, forms, noise, *look in zip([0, *ends], ends, *drawn):
        r, c, values = (side[start:end] for side in sides)
        if mark is not None:
            values = [f"{v} {mark}" if _filled(v) else v for v in values]
        if strength:
            values = noted(r, c, values, key, n, strength, forms)
        if noise:
            r, c, values = mistyped(r, c, values, key, n, noise)
        r, c = (["" if path == NO_PATH else path for path in side] for side in (r, c))
        out.append(page(r, c, values, *look))
    return pa.array(out, pa.string())


def pages(cells: Column | str, variant: str, seed: int, unit: Column, notes: Column, templates: Column, typos: Column, label: Column,
          everywhere: Column, blank_rows: Column, blank_columns: Column) -> Column:
    """HTML of pivots, whose ``cells`` have the paths ``r`` and ``c``, levels joined by ``PATH_MARK``, and ``value``.

    ``unit`` goes behind filled values; ``notes`` and ``typos`` are strengths in percent, 0 for none; ``label`` stands in a line above,
    ``everywhere`` over each column; blank lines are draws of their places, see ``perturb.insert_draws``. A unit or label that is null is left out.
    """
    return _pages(cells, variant, F.lit(seed), unit, notes, templates, typos, label, everywhere, blank_rows, blank_columns)
