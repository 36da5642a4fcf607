"""The same views as SQL, for checking the queries in another engine."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "contributed_to": """SELECT DISTINCT l_partkey AS artist_id, l_orderkey AS release_id FROM lineitem
        WHERE l_partkey <> 0""",
    "produced_by": """SELECT DISTINCT l_orderkey AS release_id, l_suppkey AS producer_id FROM lineitem
        WHERE l_suppkey <> 0""",
    "label_name": """SELECT c_custkey AS label_id,
        CASE WHEN c_acctbal < 0 THEN 'Not On Label' ELSE c_name END AS name FROM customer""",
    "released_on": """SELECT DISTINCT o_orderkey AS release_id, o_custkey AS label_id
        FROM orders JOIN label_name ON o_custkey = label_id
        WHERE o_custkey <> 0 AND name <> 'Not On Label'""",
    "artist_name": "SELECT p_partkey AS artist_id, p_name AS name FROM part",
    "releases": """SELECT o_orderkey AS release_id, o_orderpriority AS title,
        CAST(year(o_orderdate) AS INTEGER) AS year FROM orders""",
    "listens": """SELECT 'u' || user_id AS label, CAST(event_id AS VARCHAR) AS release,
        'u' || user_id || '/' || event_id AS path,
        CASE WHEN event_type = 'purchase' THEN '__rating_5' WHEN event_type = 'click' THEN '__rating_4'
             WHEN event_type = 'view' AND value < 20 THEN '__skipping' WHEN event_type = 'view' THEN '__rating_3'
             WHEN event_type = 'error' THEN '__purge' WHEN value < 20 THEN '__rating___nothing'
             ELSE '__nothing' END AS tag,
        CAST(floor(value) AS BIGINT) AS seconds, CAST(json_extract_string(props, '$.k') AS INTEGER) AS files,
        'host' || json_extract_string(props, '$.k') AS who, ts, CAST(ts AS DATE) AS day,
        event_id AS release_id, user_id FROM events""",
    "log_lines": """SELECT CASE WHEN files = 1 THEN '' WHEN files = 2 THEN '# ' || line WHEN files = 3 THEN path
             WHEN files = 4 THEN line || 'x' ELSE line END AS line, ts, release_id
        FROM (SELECT *, path || ' ' || tag || ' (time:' || seconds || ':' || files || ') ' || who || ' '
                     || strftime(ts, '%Y%m%d') AS line FROM listens)""",
    "favourite": """SELECT user_id FROM listens WHERE tag = '__rating_5' GROUP BY user_id
        ORDER BY count(*) DESC, user_id LIMIT 1""",
    "own_log": "SELECT * FROM listens WHERE user_id IN (SELECT user_id FROM favourite)",
    "seeds": "SELECT release_id FROM own_log WHERE tag = '__rating_5'",
    "sources": """SELECT artist_id, count(*) AS seeds FROM contributed_to
        WHERE release_id IN (SELECT release_id FROM seeds) GROUP BY artist_id""",
    "seed_artists": """SELECT DISTINCT artist_id FROM (SELECT min(artist_id) AS artist_id FROM contributed_to
        WHERE release_id IN (SELECT release_id FROM seeds) GROUP BY release_id)""",
    "seed_labels": "SELECT DISTINCT label_id FROM released_on WHERE release_id IN (SELECT release_id FROM seeds)",
    "artist_degree": "SELECT artist_id, count(*) AS degree FROM contributed_to GROUP BY artist_id",
    "label_degree": "SELECT label_id, count(*) AS degree FROM released_on GROUP BY label_id",
    "producer_degree": "SELECT producer_id, count(*) AS degree FROM produced_by GROUP BY producer_id",
    "known": """SELECT o_orderkey AS release_id, coalesce(l.label, 'c' || o_custkey) AS label,
        CAST(o_orderkey AS VARCHAR) AS release,
        coalesce(l.label, 'c' || o_custkey) || '/' || o_orderkey AS path, o_orderdate AS created_at
        FROM orders LEFT JOIN listens l ON l.release_id = o_orderkey""",
    "audio": """SELECT label, release, 'a' || l_partkey || ' - t' || l_linenumber || '-' || l_suppkey || '.mp3' AS track,
        path || '/a' || l_partkey || ' - t' || l_linenumber || '-' || l_suppkey || '.mp3' AS path, created_at,
        CAST(trunc(l_extendedprice) AS BIGINT) AS size, l_quantity * 37.5 AS duration,
        CAST(epoch(l_shipdate) AS BIGINT) AS time
        FROM lineitem JOIN known ON l_orderkey = release_id""",
    # hop queries for a view "sources"; the hops of "seed_artists" follow the same text
}


def _hops(tag: str, src: str) -> dict[str, str]:
    """The six hop views from the artists in ``src``, written as plain path joins."""
    return {
        f"{tag}_own": f"SELECT c.artist_id AS s, c.release_id AS r1 FROM contributed_to c JOIN {src} USING (artist_id)",
        f"{tag}_same": f"""SELECT DISTINCT a.s, b.release_id AS r2 FROM {tag}_own a
            JOIN contributed_to b ON b.artist_id = a.s AND b.release_id <> a.r1""",
        f"{tag}_shared": f"""SELECT DISTINCT a.s, b.release_id AS r2 FROM {tag}_own a
            JOIN contributed_to o ON o.release_id = a.r1 AND o.artist_id <> a.s
            JOIN contributed_to b ON b.artist_id = o.artist_id AND b.release_id <> a.r1""",
        f"{tag}_similar": f"""SELECT DISTINCT a.s, b.release_id AS r2 FROM {tag}_own a
            JOIN contributed_to o ON o.release_id = a.r1 AND o.artist_id <> a.s
            JOIN contributed_to b ON b.artist_id = o.artist_id""",
        f"{tag}_label": f"""SELECT DISTINCT a.s, y.release_id AS r2, y.label_id AS hub FROM {tag}_own a
            JOIN released_on x ON x.release_id = a.r1
            JOIN released_on y ON y.label_id = x.label_id AND y.release_id <> a.r1
            JOIN contributed_to o ON o.release_id = y.release_id AND o.artist_id <> a.s""",
        f"{tag}_producer": f"""SELECT DISTINCT a.s, y.release_id AS r2, y.producer_id AS hub
            FROM (SELECT DISTINCT s, r1, producer_id FROM {tag}_own JOIN produced_by ON release_id = r1) a
            JOIN produced_by y ON y.producer_id = a.producer_id AND y.release_id <> a.r1
            WHERE EXISTS (SELECT 1 FROM contributed_to o WHERE o.release_id = y.release_id AND o.artist_id <> a.s)""",
        f"{tag}_rows": f"""SELECT s, r2, 1.0::DOUBLE AS weight, 1 AS hops FROM {tag}_shared
            UNION ALL SELECT s, r2, 1.5::DOUBLE, 1 FROM {tag}_same
            UNION ALL SELECT s, r2, 1 / ln(degree), 2 FROM {tag}_label JOIN label_degree ON hub = label_id
                WHERE degree < 1000
            UNION ALL SELECT s, r2, 1 / ln(degree), 2 FROM {tag}_producer JOIN producer_degree ON hub = producer_id
                WHERE degree < 1000
            UNION ALL SELECT s, r2, 2.0::DOUBLE, 2 FROM {tag}_shared
            UNION ALL SELECT s, r2, 2.5::DOUBLE, 3 FROM {tag}_similar""",
    }


VIEWS.update(_hops("src", "sources"))
VIEWS.update(_hops("one", "seed_artists"))


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Put the views that ``body`` names, and those they name, in front of it."""
    views = {**VIEWS, **(extra or {})}
    order: list[str] = []
    open_: set[str] = set()

    def visit(text: str) -> None:
        for name in views:
            if name not in order and name not in open_ and re.search(rf"\b{name}\b", text):
                open_.add(name)
                visit(views[name])
                order.append(name)

    visit(body)
    if not order:
        return body
    heads = ",\n".join(f"{name} AS MATERIALIZED ({views[name]})" for name in order)
    return f"WITH {heads}\n{body}"
