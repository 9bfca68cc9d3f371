"""Names, colours and events: text functions, validation, debouncing, changed digests, transactions and other record-wise work."""

from __future__ import annotations

from lamina.functions import color as c
from lamina.plans.sql import Dialect, Text, num


def hex_colours() -> Text:
    return lambda d: f"SELECT image_id, y, x, {c.hex_colour(d, 'r', 'g', 'b')} AS hex FROM {{px}} p"


def parsed_colours() -> Text:
    """Back from text: red, green and blue of '#RRGGBB'."""
    byte = lambda d, at: f"CAST(conv(substring(hex, {at}, 2), 16, 10) AS INT)" if d.spark else f"CAST(concat('0x', substring(hex, {at}, 2)) AS INT)"
    return lambda d: f"SELECT image_id, y, x, {byte(d, 2)} AS r, {byte(d, 4)} AS g, {byte(d, 6)} AS b FROM ({hex_colours()(d)}) h"


def layer_names() -> Text:
    """White space collapsed, cut to 40 characters, 'Text' where nothing is left."""
    every = lambda d, e: f"regexp_replace({e}, '[ \\\\t\\\\n\\\\r]+', ' ')" if d.spark else f"regexp_replace({e}, '[ \\t\\n\\r]+', ' ', 'g')"
    return lambda d: f"SELECT doc_id, coalesce(nullif(substring(trim({every(d, 'text')}), 1, 40), ''), 'Text') AS name FROM {{documents}} t"


def valid_names() -> Text:
    """Names that are not blank and at most 16,384 bytes long."""
    size = lambda d: "octet_length(text)" if d.spark else "octet_length(encode(text))"
    return lambda d: f"SELECT doc_id FROM {{documents}} t WHERE length(trim(text)) > 0 AND {size(d)} <= 16384"


def blend_keys() -> Text:
    """Four-character blend keys to modes, Normal for those unknown; keys are dealt out by order."""
    #: The format's keys.
    keys = {"norm": "Normal", "dark": "Darken", "mul ": "Multiply", "idiv": "Color Burn", "lbrn": "Linear Burn", "lite": "Lighten", "scrn": "Screen", "div ": "Color Dodge", "lddg": "Linear Dodge (Add)", "over": "Overlay", "sLit": "Soft Light", "hLit": "Hard Light", "vLit": "Vivid Light", "lLit": "Linear Light", "pLit": "Pin Light", "hMix": "Hard Mix", "diff": "Difference", "smud": "Exclusion", "fsub": "Subtract", "fdiv": "Divide", "hue ": "Hue", "sat ": "Saturation", "colr": "Color", "lum ": "Luminosity"}

    def text(d: Dialect) -> str:
        names = d.array([f"'{k}'" for k in [*keys, "xxxx"]])
        return f"SELECT o_orderkey, CASE k " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in keys.items()) + f" ELSE 'Normal' END AS mode FROM (SELECT o_orderkey, {d.at(names, f'o_orderkey % {len(keys) + 1}')} AS k FROM {{orders}} o) q"

    return text


def dimensions() -> Text:
    """Whole numbers from 1 to 30,000, read from text with blanks around; others give 0. The texts are made from prices."""

    def text(d: Dialect) -> str:
        made = "CASE WHEN o_orderkey % 5 = 0 THEN concat(' ', CAST(o_orderkey AS STRING), ' ') WHEN o_orderkey % 5 = 1 THEN '1.5' WHEN o_orderkey % 5 = 2 THEN '-1' WHEN o_orderkey % 5 = 3 THEN CAST(o_orderkey * 1000003 AS STRING) ELSE '30000' END"
        digits = "trim(t) RLIKE '^[0-9]{{1,9}}$'" if d.spark else "regexp_matches(trim(t), '^[0-9]{{1,9}}$')"
        return f"SELECT o_orderkey, CASE WHEN {digits} THEN CASE WHEN CAST(trim(t) AS BIGINT) BETWEEN 1 AND 30000 THEN CAST(trim(t) AS BIGINT) ELSE 0 END ELSE 0 END AS side FROM (SELECT o_orderkey, {made} AS t FROM {{orders}} o) q"

    return text


def manifest_violations() -> Text:
    """Layer records that break a rule: opacity out of range, unknown modes, places twice in a document, and groups before version 2 (here z)."""

    def text(d: Dialect) -> str:
        return (
            "SELECT 'opacity' AS rule, layer_id FROM {layers} l WHERE opacity < 0 OR opacity > 0.95e0 UNION ALL SELECT 'mode', layer_id FROM {layers} l WHERE blend_mode NOT IN ('Normal', 'Multiply', 'Screen', 'Overlay', 'Darken', 'Lighten', 'Difference') "
            "UNION ALL SELECT 'place', max(layer_id) FROM {layers} l GROUP BY document_id, z % 40 HAVING count(*) > 1 UNION ALL SELECT 'version', layer_id FROM {layers} l WHERE z < 2 AND blend_mode = 'Normal'"
        )

    return text


def package_digest() -> Text:
    """(document_id, digest): SHA-256 of a document's record, then its assets' names and sizes in order."""
    entry = "concat(lpad(CAST(layer_id AS STRING), 8, '0'), ':', CAST(layer_id % 977 AS STRING))"

    def text(d: Dialect) -> str:
        listed = f"array_join(array_sort(collect_list({entry})), ',')" if d.spark else f"string_agg({entry}, ',' ORDER BY {entry})"
        whole = f"concat('document ', CAST(document_id AS STRING), ';', {listed})"
        return f"SELECT document_id, {f'sha2({whole}, 256)' if d.spark else f'sha256({whole})'} AS digest FROM {{layers}} l GROUP BY document_id"

    return text


# Events


def debounced(gap_seconds: float) -> Text:
    """(user_id, started, ended, n): runs of events with no quiet gap between them; a handler fires once for each."""

    def text(d: Dialect) -> str:
        micros = "unix_micros(CAST(ts AS TIMESTAMP))" if d.spark else "epoch_us(ts)"
        marked = f"SELECT user_id, {micros} AS t, CASE WHEN {micros} - lag({micros}) OVER (PARTITION BY user_id ORDER BY ts, event_id) < {int(gap_seconds * 1e6)} THEN 0 ELSE 1 END AS starts, event_id FROM {{heat}} h"
        numbered = f"SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM ({marked}) m"
        return f"SELECT user_id, CAST(min(t) AS BIGINT) AS started, CAST(max(t) AS BIGINT) AS ended, count(*) AS n FROM ({numbered}) r GROUP BY user_id, run"

    return text


def changed_only() -> Text:
    """Events whose type differs from the user's one before: touched is not changed."""
    return lambda d: "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM {heat} h) q WHERE before IS NULL OR before <> event_type"


def foreign_changes() -> Text:
    """Events that are not echoes of one's own: none of the user's 'purchase' events lies within a second before."""

    def text(d: Dialect) -> str:
        micros = "unix_micros(CAST(ts AS TIMESTAMP))" if d.spark else "epoch_us(ts)"
        own = f"max(CASE WHEN event_type = 'purchase' THEN {micros} END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        return f"SELECT event_id FROM (SELECT event_id, {micros} AS t, {own} AS own FROM {{heat}} h) q WHERE own IS NULL OR t - own > 3600000000"

    return text


def latest_wins() -> Text:
    """(user_id, event_type, value): the newest value of each key."""
    return lambda d: "SELECT user_id, event_type, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM {heat} h) q WHERE n = 1"


def transactions() -> Text:
    """(user_id, first_id, last_id, n): nested begin and end events as one entry each, between places where the depth is 0; here values above 250 begin."""

    def text(d: Dialect) -> str:
        deep = "SELECT user_id, event_id, sum(CASE WHEN value > 250 THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS depth FROM {heat} h"
        zero = f"SELECT *, sum(CASE WHEN depth = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CASE WHEN depth = 0 THEN 1 ELSE 0 END AS entry FROM ({deep}) q"
        return f"SELECT user_id, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n FROM ({zero}) z GROUP BY user_id, entry"

    return text


def history_cap(entries: int = 20, most: float = 4000) -> Text:
    """The newest entries of each user's log, at most so many and so large in all."""
    return lambda d: f"SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n, sum(value) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM {{heat}} h) q WHERE n <= {entries} AND used <= {num(most)}"


def retained_once() -> Text:
    """(user_id, retained): the values of a user's distinct event types, each once, as images shared by snapshots are."""
    return lambda d: "SELECT user_id, round(sum(v), 4) AS retained FROM (SELECT user_id, event_type, max(value) AS v FROM {heat} h GROUP BY user_id, event_type) q GROUP BY user_id"


def backoff() -> Text:
    """(event_id, wait): milliseconds to the next check after n failures, doubled up to the seventh."""
    return lambda d: "SELECT event_id, CAST(250 * pow(2e0, least(7, event_id % 10)) AS BIGINT) AS wait FROM {heat} h"


def heat_histogram() -> Text:
    """(x, bin, n, total): events by hour and value bin."""
    return lambda d: "SELECT x, CAST(floor(value / 50e0) AS INT) AS bin, count(*) AS n, round(sum(value), 3) AS total FROM {heat} h GROUP BY x, CAST(floor(value / 50e0) AS INT)"


def text_runs() -> Text:
    """(conv_id, first_turn, n): runs of turns of one role, as attribute runs over a text."""

    def text(d: Dialect) -> str:
        starts = "SELECT conv_id, turn, role, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS s FROM {conversations} c"
        runs = f"SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM ({starts}) q"
        return f"SELECT conv_id, role, min(turn) AS first_turn, count(*) AS n FROM ({runs}) r GROUP BY conv_id, role, run"

    return text
