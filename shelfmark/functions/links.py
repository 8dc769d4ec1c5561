"""Links to spreadsheets, their exports and their rows."""

from __future__ import annotations

import re
from urllib.parse import parse_qs, quote, urlsplit

HOST = "docs.google.com"
_ID, _GID, _COLUMN = re.compile("[A-Za-z0-9_-]{20,}"), re.compile("[0-9]+"), re.compile("[A-Z]{1,3}")


def https_link(url: object) -> str | None:
    try:
        parts = urlsplit(url.strip()) if isinstance(url, str) else None
    except ValueError:
        return None
    return url.strip() if parts and parts.scheme.lower() == "https" and parts.hostname else None


def parse_sheet_link(link: object) -> tuple[str, str | None] | None:
    """(id, tab) of a link to a spreadsheet or of a bare id; links to published copies are none."""
    s = link.strip() if isinstance(link, str) else ""
    if _ID.fullmatch(s):
        return s, None
    try:
        u = urlsplit(s if re.match("[A-Za-z][A-Za-z0-9+.-]*:", s) else f"https://{s}")
    except ValueError:
        return None
    m = re.match(r"/spreadsheets(?:/u/[0-9]+)?/d/([^/]+)(?:/|$)", u.path)
    if u.scheme not in ("http", "https") or u.hostname != HOST or u.username or not m or m[1] == "e" or not _ID.fullmatch(m[1]):
        return None
    tabs = [*parse_qs(u.fragment).get("gid", []), *parse_qs(u.query).get("gid", [])]
    return m[1], next((g for g in tabs if _GID.fullmatch(g)), None)


def _base(sheet_id: str) -> str:
    return f"https://{HOST}/spreadsheets/d/{quote(sheet_id, safe='')}"


def csv_link(sheet_id: str, gid: str = "") -> str:
    return f"{_base(sheet_id)}/export?format=csv" + (f"&gid={gid}" if _GID.fullmatch(gid) else "")


def row_link(sheet_id: str, gid: str, row: int, last_column: str = "G") -> str:
    """A link that marks the row; a tab without a known id can't be pointed into."""
    if not _GID.fullmatch(gid):
        return f"{_base(sheet_id)}/edit"
    column = last_column if _COLUMN.fullmatch(last_column) else "G"
    return f"{_base(sheet_id)}/edit?gid={gid}#gid={gid}&range=A{max(1, row)}:{column}{max(1, row)}"


def cell_link(cell: dict | None) -> str | None:
    """The cell's own link, else that of its first linked part, else of its formula."""
    cell = cell or {}
    runs = [r.get("format", {}).get("link", {}).get("uri") for r in cell.get("textFormatRuns") or []]
    formula = re.search(r'HYPERLINK\s*\(\s*"((?:[^"]|"")*)"', (cell.get("userEnteredValue") or {}).get("formulaValue") or "", re.I)
    found = [cell.get("hyperlink"), *runs, formula[1].replace('""', '"') if formula else None]
    return next((u for u in map(https_link, found) if u), None)
