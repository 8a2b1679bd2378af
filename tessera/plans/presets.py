"""Ready-made queries over ``edits``."""

from __future__ import annotations

import re

# The queries by name, as dashboards show them.
PRESETS = {
    "hot_pages": """SELECT title, lang, count(*) AS edits, count(distinct user) AS editors
FROM edits
WHERE is_bot = false AND project = 'wikipedia' AND namespace = 0
GROUP BY title, lang
ORDER BY edits DESC
LIMIT 15
WINDOW 10m""",
    "busiest_langs": """SELECT lang, count(*) AS edits
FROM edits
WHERE is_bot = false AND project = 'wikipedia' AND namespace = 0
GROUP BY lang
ORDER BY edits DESC
LIMIT 12
WINDOW 10m""",
    "new_pages": """SELECT title, lang, user, new_len AS bytes
FROM edits
WHERE type = 'new' AND is_bot = false AND project = 'wikipedia' AND namespace = 0
ORDER BY ts DESC
LIMIT 20
WINDOW 15m""",
    "big_removals": """SELECT title, lang, user, delta, comment
FROM edits
WHERE is_bot = false AND project = 'wikipedia' AND namespace = 0 AND delta < -1000
ORDER BY delta ASC
LIMIT 15
WINDOW 15m""",
    "reverts": """SELECT title, lang, user, comment
FROM edits
WHERE is_bot = false AND project = 'wikipedia' AND namespace = 0
  AND (comment LIKE '%revert%' OR comment LIKE '%undo%' OR comment LIKE '%rvv%')
ORDER BY ts DESC
LIMIT 15
WINDOW 15m""",
    "busiest_editors": """SELECT user, count(*) AS edits, count(distinct title) AS pages, sum(delta) AS net_bytes
FROM edits
WHERE is_bot = false AND project = 'wikipedia' AND namespace = 0
GROUP BY user
ORDER BY edits DESC
LIMIT 15
WINDOW 10m""",
    "anon_activity": """SELECT lang, count(*) AS anon_edits
FROM edits
WHERE is_bot = false AND project = 'wikipedia' AND namespace = 0 AND is_anon
GROUP BY lang
ORDER BY anon_edits DESC
LIMIT 10
WINDOW 15m""",
    "edit_size": """SELECT count(*) AS edits,
       percentile(delta, 50) AS typical_bytes,
       percentile(delta, 95) AS large_bytes,
       percentile(delta, 99) AS huge_bytes,
       max(delta) AS largest
FROM edits
WHERE is_bot = false AND project = 'wikipedia' AND namespace = 0 AND type = 'edit'
WINDOW 10m""",
    "bots_vs_humans": """SELECT case when is_bot then 'bot' else 'human' end AS editor,
       count(*) AS edits,
       count(distinct user) AS accounts
FROM edits
GROUP BY editor
ORDER BY edits DESC
WINDOW 10m""",
    "projects": """SELECT project, count(*) AS edits
FROM edits
GROUP BY project
ORDER BY edits DESC
LIMIT 10
WINDOW 10m""",
    "headline": """SELECT count(*) AS edits,
       count(distinct user) AS editors,
       count(distinct title) AS pages,
       sum(delta) AS net_bytes
FROM edits
WINDOW 5m""",
    "languages": """SELECT lang, count(*) AS edits
FROM edits
WHERE lang != '-'
GROUP BY lang
ORDER BY edits DESC
LIMIT 12
WINDOW 5m""",
}


def preset(name: str, window: str | None = None, table: str = "edits") -> str:
    """A preset as it is, or over another window or table."""
    sql = PRESETS[name].replace("FROM edits", f"FROM {table}")
    return re.sub(r"WINDOW \w+$", f"WINDOW {window}", sql) if window else sql
