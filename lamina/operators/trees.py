"""Layer trees (id, parent_id, is_group, place, opacity, visible): walks from the roots, closures, order and checks; and matching of edges to targets."""

from __future__ import annotations

from lamina.plans.sql import Dialect, Text, num


def _walk(columns: str, root: str, step: str) -> str:
    return f"WITH RECURSIVE w AS (SELECT {columns}, {root} FROM {{tree}} t WHERE parent_id IS NULL UNION ALL SELECT {columns.replace('id', 't.id', 1) if columns == 'id' else ', '.join('t.' + c.strip() for c in columns.split(','))}, {step} FROM w JOIN {{tree}} t ON t.parent_id = w.id)"


def effective_opacity() -> Text:
    """(id, opacity, visible, depth): products and conjunctions over all folders above."""
    return lambda d: _walk("id, parent_id", "opacity AS o, visible AS s, 0 AS depth", "w.o * t.opacity, w.s AND t.visible, w.depth + 1") + " SELECT id, round(o, 9) AS opacity, s AS visible, depth FROM w"


def visible_leaves() -> Text:
    return lambda d: _walk("id, is_group", "visible AS s", "w.s AND t.visible") + " SELECT id FROM w WHERE s AND NOT is_group"


def depth_first() -> Text:
    """(id, rank): the order of a walk that takes children by place: a node comes after the folders above it and all that stands in earlier siblings of theirs or its own."""

    def text(d: Dialect) -> str:
        sizes = "s AS (SELECT above AS id, count(*) AS size FROM a GROUP BY above)"
        before = "b AS (SELECT t.id, 1 + sum(s.size) OVER (PARTITION BY t.parent_id ORDER BY t.place, t.id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS own FROM {tree} t JOIN s ON s.id = t.id)"
        return f"WITH RECURSIVE {_ancestors()}, {sizes}, {before} SELECT a.id, CAST(sum(b.own) AS BIGINT) AS rank FROM a JOIN b ON b.id = a.above GROUP BY a.id"

    return text


def descendants(root: str) -> Text:
    return lambda d: f"WITH RECURSIVE w AS (SELECT id FROM {{tree}} t WHERE id = '{root}' UNION ALL SELECT t.id FROM w JOIN {{tree}} t ON t.parent_id = w.id) SELECT id FROM w WHERE id <> '{root}'"


def _ancestors() -> str:
    return "a AS (SELECT id, id AS above, 0 AS up FROM {tree} t UNION ALL SELECT a.id, t.parent_id, a.up + 1 FROM a JOIN {tree} t ON t.id = a.above WHERE t.parent_id IS NOT NULL)"


def common_folder(ids: tuple[str, ...]) -> Text:
    """The deepest folder above all of ``ids``."""
    names = ", ".join(f"'{i}'" for i in ids)
    return lambda d: f"WITH RECURSIVE {_ancestors()} SELECT id FROM (SELECT above AS id, max(up) AS far FROM a WHERE id IN ({names}) AND above NOT IN ({names}) GROUP BY above HAVING count(*) = {len(ids)}) q ORDER BY far LIMIT 1"


def topmost_selected(ids: tuple[str, ...]) -> Text:
    """Of a selection, what is not inside a selected folder."""
    names = ", ".join(f"'{i}'" for i in ids)
    return lambda d: f"WITH RECURSIVE {_ancestors()} SELECT DISTINCT id FROM a WHERE id IN ({names}) AND id NOT IN (SELECT id FROM a WHERE id IN ({names}) AND up > 0 AND above IN ({names}))"


def siblings() -> Text:
    return lambda d: "SELECT parent_id, count(*) AS n, round(avg(opacity), 6) AS opacity FROM {tree} t GROUP BY parent_id"


def violations() -> Text:
    """Rows of a tree that break its rules: repeated ids, missing parents, parents that are no folders, and what no root reaches (cycles)."""

    def text(d: Dialect) -> str:
        return (
            "WITH RECURSIVE w AS (SELECT id, 0 AS depth FROM {tree} t WHERE parent_id IS NULL UNION ALL SELECT t.id, w.depth + 1 FROM w JOIN {tree} t ON t.parent_id = w.id) "
            "SELECT 'repeated' AS rule, id FROM {tree} t GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'orphan', t.id FROM {tree} t LEFT JOIN {tree} p ON p.id = t.parent_id WHERE t.parent_id IS NOT NULL AND p.id IS NULL "
            "UNION ALL SELECT 'not a folder', t.id FROM {tree} t JOIN {tree} p ON p.id = t.parent_id WHERE NOT p.is_group UNION ALL SELECT 'deep', id FROM w WHERE depth > 64 "
            "UNION ALL SELECT 'unreachable', t.id FROM {tree} t LEFT JOIN w ON w.id = t.id WHERE w.id IS NULL"
        )

    return text


def folder_mask_product() -> Text:
    """(id, coverage): the product of all folders' mask levels above a leaf, masks being their places."""
    return lambda d: _walk("id, is_group, place", "CASE WHEN is_group THEN (1 + place % 4) / 4e0 ELSE 1e0 END AS c", "w.c * CASE WHEN t.is_group THEN (1 + t.place % 4) / 4e0 ELSE 1e0 END") + " SELECT id, round(c, 9) AS coverage FROM w WHERE NOT is_group"


def mask_chain() -> Text:
    """(layer_id, coverage): each layer's mask is the one two below it in its document; levels multiply down the chain."""

    def text(d: Dialect) -> str:
        return (
            "WITH RECURSIVE w AS (SELECT document_id, layer_id, z, opacity AS c FROM {layers} l WHERE z <= 2 UNION ALL SELECT l.document_id, l.layer_id, l.z, w.c * l.opacity FROM w JOIN {layers} l ON l.document_id = w.document_id AND l.z = w.z + 2) "
            "SELECT layer_id, round(c, 9) AS coverage FROM w"
        )

    return text


def remapped_copy(root: str) -> Text:
    """A subtree's copy: (id, parent_id) with new ids; links to parents inside the copy follow, others stay."""

    def text(d: Dialect) -> str:
        return (
            f"WITH RECURSIVE w AS (SELECT id, parent_id FROM {{tree}} t WHERE id = '{root}' UNION ALL SELECT t.id, t.parent_id FROM w JOIN {{tree}} t ON t.parent_id = w.id) "
            "SELECT concat('copy-', w.id) AS id, CASE WHEN p.id IS NULL THEN w.parent_id ELSE concat('copy-', p.id) END AS parent_id FROM w LEFT JOIN w p ON p.id = w.parent_id"
        )

    return text


# Matching of edges to targets


def snap_nearest(tolerance: float, step: float = 25) -> Text:
    """(event_id, snapped, moved): each value to the nearest grid line or other target within the tolerance; the first of equals, or itself.

    Targets are bucketed by the tolerance, so only neighbouring buckets meet.
    """

    def text(d: Dialect) -> str:
        targets = f"SELECT {num(step)} * k AS target, CAST(k AS INT) AS place FROM (SELECT {d.explode(d.series('0', str(int(500 / step))), 'k')}) g UNION ALL SELECT DISTINCT 10e0 * (user_id % 50) + 3e0, 1000 + CAST(user_id % 50 AS INT) FROM {{heat}} h"
        bucket = lambda e: f"CAST(floor({e} / {num(tolerance)}) AS BIGINT)"
        spread = f"SELECT target, place, b + o AS b FROM (SELECT target, place, {bucket('target')} AS b, {d.explode(d.array(['-1', '0', '1']), 'o')} FROM ({targets}) t) u"
        met = f"SELECT h.event_id, h.value, t.target, row_number() OVER (PARTITION BY h.event_id ORDER BY round(abs(t.target - h.value), 9), t.place) AS n FROM {{heat}} h JOIN ({spread}) t ON t.b = {bucket('h.value')} WHERE abs(t.target - h.value) <= {num(tolerance)}"
        return f"SELECT h.event_id, round(coalesce(m.target, h.value), 6) AS snapped, m.target IS NOT NULL AS moved FROM {{heat}} h LEFT JOIN (SELECT * FROM ({met}) q WHERE n = 1) m ON m.event_id = h.event_id"

    return text


def overlapping_boxes(cell: int = 8) -> Text:
    """(a, b): pairs of parts whose boxes overlap, found by the grid cells that both touch. Boxes: place and size by key and size."""

    def text(d: Dialect) -> str:
        # the plane grows with the table: a strip of 1,000 for every 1,000 keys
        top = f"p_partkey * 91 % 991 + 1000 * CAST({d.div('p_partkey', '1000')} AS BIGINT)"
        boxes = f"SELECT p_partkey AS id, p_partkey * 37 % 997 AS x0, {top} AS y0, p_partkey * 37 % 997 + p_size % 13 + 1 AS x1, {top} + p_size % 7 + 1 AS y1 FROM {{part}} p"
        cells = f"SELECT id, x0, y0, x1, y1, cx, {d.explode(d.series(d.div('y0', str(cell)), d.div('y1 - 1', str(cell))), 'cy')} FROM (SELECT *, {d.explode(d.series(d.div('x0', str(cell)), d.div('x1 - 1', str(cell))), 'cx')} FROM ({boxes}) b) c"
        return f"SELECT DISTINCT a.id AS a, b.id AS b FROM ({cells}) a JOIN ({cells}) b ON b.cx = a.cx AND b.cy = a.cy WHERE a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"

    return text


def patched() -> Text:
    """Keyed replacement: new tiles win, old ones stay where there is none. Here grey pixels of even images are patched where x + y is a multiple of 3."""

    def text(d: Dialect) -> str:
        anti = "LEFT ANTI JOIN" if d.spark else "ANTI JOIN"
        new = "SELECT image_id, y, x, 255 - v AS v FROM {px} p WHERE image_id % 2 = 0 AND (x + y) % 3 = 0"
        return f"SELECT o.image_id, o.y, o.x, o.v FROM {{px}} o {anti} ({new}) n ON n.image_id = o.image_id AND n.y = o.y AND n.x = o.x UNION ALL SELECT image_id, y, x, v FROM ({new}) n"

    return text


def missing_assets() -> Text:
    """Layers whose image is missing: records matched to images by id."""
    return lambda d: "SELECT l.layer_id FROM {layers} l LEFT JOIN (SELECT DISTINCT image_id FROM {px} p WHERE image_id % 5 <> 0) i ON i.image_id = l.layer_id WHERE i.image_id IS NULL"


def next_free_name() -> Text:
    """The least n for which no layer is called 'Layer n', by document; names are ids modulo 60."""

    def text(d: Dialect) -> str:
        used = "SELECT DISTINCT document_id, layer_id % 60 AS n FROM {layers} l"
        tried = f"SELECT document_id, {d.explode(d.series('1', '61'), 'n')} FROM (SELECT DISTINCT document_id FROM {{layers}} l) e"
        return f"SELECT t.document_id, concat('Layer ', CAST(min(t.n) AS STRING)) AS name FROM ({tried}) t LEFT JOIN ({used}) u ON u.document_id = t.document_id AND u.n = t.n WHERE u.n IS NULL GROUP BY t.document_id"

    return text


def reordered() -> Text:
    """(layer_id, z): layers moved to the bottom of their documents where the id is a multiple of 7; the others keep their order."""
    return lambda d: "SELECT layer_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY CASE WHEN layer_id % 7 = 0 THEN 0 ELSE 1 END, z) AS INT) AS z FROM {layers} l"


def nearest_patch(offsets: int = 6) -> Text:
    """(image_id, dx, dy, score): of ring offsets the one at which the border differs least from what it would be copied from, the first of equals."""
    ring = [(dx, dy) for dy in (-2, 0, 2) for dx in (-2, 0, 2) if dx or dy][:offsets]

    def text(d: Dialect) -> str:
        tried = " UNION ALL ".join(f"SELECT p.image_id, {k} AS k, {dx} AS dx, {dy} AS dy, CAST((p.v - q.v) * (p.v - q.v) AS DOUBLE) AS e FROM {{px}} p JOIN {{px}} q ON q.image_id = p.image_id AND q.x = p.x + {dx} AND q.y = p.y + {dy} WHERE p.x BETWEEN 2 AND 5 AND p.y BETWEEN 2 AND 5" for k, (dx, dy) in enumerate(ring))
        scored = f"SELECT image_id, k, dx, dy, round(avg(e), 4) AS score FROM ({tried}) t GROUP BY image_id, k, dx, dy"
        return f"SELECT image_id, dx, dy, score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score, k) AS n FROM ({scored}) s) r WHERE n = 1"

    return text
