"""SQL of the text queries that SQL can express on whole tables."""

from __future__ import annotations

_PAIRS = r"""
    WITH baskets AS (
        SELECT row_number() OVER () AS r, list_distinct(list_filter(list_transform(items, lambda x: lower(regexp_replace(x, '^[\s#]+|\s+$', '', 'g'))), lambda x: x IS NOT NULL AND x <> '')) AS items
        FROM (SELECT value.tags AS items FROM memories
              UNION ALL SELECT CASE WHEN labels LIKE '[%' THEN from_json(labels, '["VARCHAR"]') ELSE string_split(labels, ',') END FROM goals)
    ), held AS (SELECT r, unnest(items) AS item FROM baskets),
    size AS (SELECT count(DISTINCT r) AS n FROM held),
    single AS (SELECT item, count(*) AS c FROM held GROUP BY item),
    double AS (SELECT x.item AS item_a, y.item AS item_b, count(*) AS n_ab FROM held x JOIN held y ON x.r = y.r AND x.item < y.item GROUP BY 1, 2),
    pairs AS (
        SELECT item_a, item_b, a.c AS n_a, b.c AS n_b, n_ab, n FROM double, size, single a, single b
        WHERE a.item = item_a AND b.item = item_b AND n_ab >= 3 AND n_ab * 1000 >= n
    )"""

ORACLE: dict[str, str] = {
    "p6_found": f"{_PAIRS} SELECT item_a, item_b FROM pairs WHERE n_ab * n >= 3 * n_a * n_b",
    "p6_odds": f"""{_PAIRS} SELECT *, round(n_ab * n / (n_a * n_b), 6) AS lift,
        round(ln((n_ab + 0.5) * (n - n_a - n_b + n_ab + 0.5) / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5))), 6) AS log_odds FROM pairs""",
}
